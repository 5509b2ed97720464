"""Problem 3: source files that do not parse.

A lexer per language splits a file into literals, comments and code; a pushdown stack runs over the brackets of the code.
That finds literals and comments that never end, brackets that don't match, and files that end too early. Lines of merge
conflicts count where they are code, so a marker within a string or comment does not. What passes goes token by token
through the language's statement grammar (`grammar`): two operands side by side, operators without operand, statements
cut off, signs and words of another language. Java and Go have a fixed top level. Python is read by Python's own parser.

Only syntax counts. Cases: null sources, empty or blank files and other extensions are never flagged; a null path has no
language; line ends may be mixed. The work is one pass over each file, whatever its length, within the scan's tasks; no
shuffle.
"""

from __future__ import annotations

import ast
import re
import warnings
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.functions.lexing import language_of, scan, skeleton, unbalanced
from annalist.llm.grammar import grammar_error

_CONFLICT = re.compile(r"^(?:<{7}|>{7}|\|{7})(?: .*)?$|^={7}$", re.M)
_INNER = re.compile(r"\([^()\[\]{}]*\)|\[[^()\[\]{}]*\]|\{[^()\[\]{}]*\}")

_DIFF = re.compile(r"^(?:@@ -\d|\+\+\+ \S|--- \S|diff --git |index [0-9a-f]{7,})", re.M)
_JAVA_TOP = re.compile(
    r"(?:\s+|;|package\s+[\w.\s]+;|import\s+(?:static\s+)?[\w.\s]+(?:\.\s*\*\s*)?;|@[\w.]+(?!\s*\{)(?:\s*\(\))?|(?:open\s+)?module\s+[\w.]+\s*\{\}"
    r"|(?:(?:public|protected|private|abstract|final|static|strictfp|sealed|non-sealed)\s+)*(?:class|interface|enum|record|@\s*interface)\s+\w+[^;{}]*\{\})*\Z"
)
_GO_LINE = re.compile(r"import[ \t]*(?:\(\)|(?:[\w.]+[ \t]+)?\"\")$|func\b[^{}]*\(\)|(?:var|const|type)\b")
_GO_GOES_ON = tuple("+-*/%&|^=<>.,!")
_C_DIRECTIVE = re.compile(r"^[ \t]*#[ \t]*(\w*)((?:[^\\\n]|\\[^\n]|\\\n)*)", re.M)
_JS_LATE = re.compile(r"(?<![\w$.])(?:if|while|for|switch)\s*\(\)\s*(?:\Z|\})|(?<![\w$.])(?:function)\s*\*?\s*[\w$]*\s*\(\)\s*\Z|(?<![\w$.])class\s+[\w$]+\s*\Z|(?<![\w$.])import\s*\{\}\s*(?!\s*from)")


def preprocessed(code: str) -> str:
    """C++ without directives and with the first branch of every condition (of `#if 0` the other one)."""
    out, pos, kept = [], 0, []  # kept: per open condition whether its present branch is taken, and whether one was
    for m in _C_DIRECTIVE.finditer(code):
        if all(k for k, _ in kept):
            out.append(code[pos : m.start()])
        pos, word = m.end(), m.group(1)
        if word in ("if", "ifdef", "ifndef"):
            taken = m.group(2).strip() not in ("0", "false")
            kept.append((taken, taken))
        elif kept and word in ("else", "elif", "elifdef", "elifndef"):
            kept[-1] = (not kept[-1][1], True)
        elif kept and word == "endif":
            kept.pop()
    if all(k for k, _ in kept):
        out.append(code[pos:])
    return "".join(out)


def _reduced(code: str) -> str:
    """Code with the contents of all brackets taken out, innermost first."""
    while True:
        short = _INNER.sub(lambda m: m.group()[0] + "\0" + m.group()[-1], code)
        if short == code:
            return code.replace("(\0)", "()").replace("[\0]", "[]").replace("{\0}", "{}")
        code = short.replace("(\0)", "\1").replace("[\0]", "\2").replace("{\0}", "\3")
        if not _INNER.search(code):
            return code.replace("\1", "()").replace("\2", "[]").replace("\3", "{}")


def _go_top(top: str) -> bool:
    """Whether reduced code is a package clause and declarations, each on lines of its own."""
    lines = [x.strip() for x in re.split(r"[\n;]", top)]
    lines = [x for x in lines if x]
    if not lines or not re.match(r"package[ \t]+\w+$", lines[0]):
        return False
    return all(_GO_LINE.match(x) or before.endswith(_GO_GOES_ON) for before, x in zip(lines, lines[1:]))


def _python(s: str) -> str | None:
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            ast.parse(s)
    except (SyntaxError, ValueError) as e:
        return "parser: " + str(e)[:60]
    except (RecursionError, MemoryError):
        return None
    return None


def syntax_error(path: str | None, source: str | None) -> str | None:
    """Why a file is not valid, or None."""
    lang = language_of(path)
    if lang is None or source is None or not source.strip():
        return None
    s = source.removeprefix("\ufeff").replace("\r\n", "\n").replace("\r", "\n")
    if s.startswith("#!") and lang in ("javascript", "typescript"):
        s = s[s.find("\n") :] if "\n" in s else ""
    pieces = scan(lang, s)
    for p in pieces:
        if not p.ok:
            return {"s": "unterminated literal", "t": "unterminated template", "c": "unterminated comment"}.get(p.kind, "unterminated")
    code = skeleton(s, pieces)
    if _CONFLICT.search(code):
        return "merge conflict"
    if lang == "cpp":
        code = preprocessed(code)
    b = unbalanced(code)
    if b:
        return "premature end: " + b[0] if b[0].startswith("unclosed") else b[0]
    if lang == "python":
        return _python(s)
    if not code.strip():
        return None
    if _DIFF.search(code):
        return "a difference of files"
    e = grammar_error(lang, code)
    if e or lang == "cpp":
        return e and f"not {lang}: {e}"[:60]
    top = _reduced(code)
    if lang == "java":
        return None if _JAVA_TOP.match(top) else "not java: top level"
    if lang == "go":
        return None if _go_top(top) else "not go: top level"
    return "premature end" if _JS_LATE.search(top) else None


def flag_syntax(tasks: DataFrame, path: str = "file_path", source: str = "source") -> DataFrame:
    """Adds `language` and `syntax_problem` (null: valid, or no case), in the place of columns of these names."""

    @F.pandas_udf("language string, syntax_problem string")
    def check(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for paths, sources in batches:
            yield pd.DataFrame({
                "language": [language_of(p) for p in paths],
                "syntax_problem": [syntax_error(p, s) for p, s in zip(paths, sources)],
            }).astype(object)

    kept = [c for c in tasks.columns if c not in ("language", "syntax_problem")]
    return tasks.withColumn("__s", check(F.col(path), F.col(source))).select(*kept, F.col("__s.language").alias("language"), F.col("__s.syntax_problem").alias("syntax_problem"))


def syntax_rates(flagged: DataFrame) -> DataFrame:
    """Files, invalid files and their rate per repository and language; files without source are not counted."""
    bad = F.count("syntax_problem")
    n = F.count("source")
    return flagged.filter(F.col("language").isNotNull() & F.col("source").isNotNull()).groupBy("repository_id", "language").agg(n.alias("files"), bad.alias("invalid"), F.round(bad / n, 6).alias("rate"))
