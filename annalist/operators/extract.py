"""Function records from source text in six languages (EXT1-8), by lexical structure.

Python files that parse are read through their syntax tree; others, and the brace languages, through the scanner: code
without literals and comments, matched brackets, and the shapes of definitions. A function whose region doesn't close or
parse is marked; the file's other functions survive. Calls belong to the innermost named or anonymous function of
JavaScript and TypeScript, in the other languages to the innermost named one. Null sources and unknown extensions have
no functions.
"""

from __future__ import annotations

import ast
import re
import warnings
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.functions.lexing import language_of, scan
from annalist.schemas import EXTRACTED

#: Words that a bracket may follow without being a call.
_NO_CALL = set(
    "if for while switch catch return function func sizeof new typeof await yield delete throw else do case in of instanceof void super this synchronized try assert decltype alignof noexcept static_assert operator "
    "template import constructor async class struct interface enum const let var int long float double bool char string auto unsigned signed short".split()
)
_GO_WORDS = {"range", "go", "defer", "select"}
_ID = r"[A-Za-z_$][\w$]*"
_DEFS = {
    "go": re.compile(rf"\bfunc\s+(?:\([^()]*\)\s*)?({_ID})\s*(?:\[[^\]]*\]\s*)?\("),
    "java": re.compile(rf"(?<![\w$.@])({_ID})\s*\("),
    "cpp": re.compile(r"(?<![\w.>])((?:~?[A-Za-z_]\w*(?:<[^<>;(){}]*>)?::)*(?:operator\s*[^\s(]{1,3}|~?[A-Za-z_]\w*))\s*\("),
    "javascript": re.compile(rf"\bfunction\b\s*\*?\s*({_ID})?\s*(?:<[^<>]*>\s*)?\(|=>|(?<![\w$.])(?:(?:static|async|get|set|public|private|protected|readonly|override)\s+)*(?:\*\s*)?(#?{_ID})\s*(?:<[^<>()]*>\s*)?\("),
}
_DEFS["typescript"] = _DEFS["javascript"]
_ASSIGNED = re.compile(rf"\b(?:const|let|var)\s+({_ID})\s*(?::[^=;{{}}]*)?=\s*(?:async\s*)?(?:<[^<>]*>\s*)?\Z")
_ARROW_HEAD = re.compile(rf"(?:\)\s*:\s*[^=;(){{}}]+|{_ID})$")
_NEXT_STATEMENT = re.compile(r"\s*(?:const|let|var|function|export|import|class|return|\Z)")
_BOUNDS = re.compile(r"[;{}]")
_CALL = {
    "javascript": re.compile(rf"(\bnew\s+)?((?:{_ID}\s*\??\.\s*)*#?{_ID})\s*(?:\?\.)?\("),
    "go": re.compile(rf"((?:{_ID}\s*\.\s*)*{_ID})\s*\("),
    "java": re.compile(rf"(\bnew\s+)?((?:{_ID}\s*\.\s*)*{_ID})(?:\s*<[^<>;(){{}}]*>)?\s*\("),
    "cpp": re.compile(r"((?:[A-Za-z_]\w*\s*(?:::|\.|->)\s*)*~?[A-Za-z_]\w*)\s*\("),
}
_CALL["typescript"] = _CALL["javascript"]


def _blanked(lang: str, s: str) -> str:
    """Code of the same length: literals as quotes, comments as blanks, their line breaks kept."""
    out, pos = [], 0
    for p in scan(lang, s):
        fill = " " if p.kind == "c" else '"'
        out += [s[pos : p.start], re.sub(r"[^\n]", fill, s[p.start : p.end])]
        if p.kind == "t" and not s[p.start : p.end].endswith("`"):
            out[-1] = out[-1][:-2] + '"{'  # the template goes on behind an expression
        if p.kind == "t" and s[p.start] == "}":
            out[-1] = "}" + out[-1][1:]
        pos = p.end
    return "".join([*out, s[pos:]])


def _pairs(code: str) -> dict[int, int]:
    """Where each bracket closes; unmatched ones are missing."""
    stack, out = [], {}
    for m in re.finditer(r"[()\[\]{}]", code):
        c = m.group()
        if c in "([{":
            stack.append((c, m.start()))
        elif stack and stack[-1][0] == {")": "(", "]": "[", "}": "{"}[c]:
            out[stack.pop()[1]] = m.start()
        elif any(x[0] == {")": "(", "]": "[", "}": "{"}[c] for x in stack):
            while stack[-1][0] != {")": "(", "]": "[", "}": "{"}[c]:
                stack.pop()
            out[stack.pop()[1]] = m.start()
    return out


def _body(lang: str, code: str, close: int, arrow: bool, pairs: dict[int, int]) -> int:
    """Start of the brace that opens a function's body behind its parameters, or -1."""
    i, n = close, len(code)
    m = re.compile(r"\s*").match(code, i)
    i = m.end()
    if lang in ("javascript", "typescript"):
        if not arrow and i < n and code[i] == ":":
            m = re.compile(r":\s*[^={};()]*(?:\{[^{}]*\}[^={};()]*)?(?=\{)").match(code, i)
            if not m:
                return -1
            i = m.end()
        return i if i < n and code[i] == "{" else -1
    if lang == "go":
        m = re.compile(r"(?:\([^()]*\)|(?:interface|struct)\s*\{\s*\}|[^\n{};=]|func\([^()]*\))*").match(code, i)
        i = m.end()
    elif lang == "java":
        m = re.compile(r"(?:throws\s+[\w.,\s]+)?").match(code, i)
        i = m.end()
    else:
        m = re.compile(r"(?:const\b|noexcept\b(?:\([^()]*\))?|override\b|final\b|mutable\b|&&?|->\s*[\w:<>,\s*&]+|try\b|\s)*").match(code, i)
        i = m.end()
        if i < n and code[i] == ":" and code[i + 1 : i + 2] != ":":  # the constructor's initialisers
            step = re.compile(r"[:,]\s*[\w:<>, ]+?\s*(?=[({])")
            while (m := step.match(code, i)) and m.end() in pairs:
                i = re.compile(r"\s*").match(code, pairs[m.end()] + 1).end()
        m = re.compile("").match(code, i)
        i = m.end()
    return i if i < n and code[i] == "{" else -1


def _brace_functions(lang: str, s: str) -> list[dict]:
    code = _blanked(lang, s)
    pairs = _pairs(code)
    opener = {b: a for a, b in pairs.items()}
    found = []  # (start, end, name or None, error)
    heads = set()  # where parameters of definitions open
    script = lang in ("javascript", "typescript")
    bounds = [m.start() for m in _BOUNDS.finditer(code)]

    def statement(at: int) -> int:
        """Where the statement around a place begins, whatever its length: behind the last brace or semicolon before it."""
        k = bisect_left(bounds, at)
        return bounds[k - 1] + 1 if k else 0

    for m in _DEFS[lang].finditer(code):
        tok = m.group()
        if tok == "=>":
            at = m.start()
            while at > 0 and code[at - 1].isspace():
                at -= 1
            start = opener.get(at - 1) if at and code[at - 1] == ")" else None
            if start is None:
                low = statement(at)
                w = _ARROW_HEAD.search(code[low:at])
                if not w:
                    continue
                start = low + w.start()
                if code[start] == ")":
                    start = opener.get(start)
                    if start is None:
                        continue
            head = code[statement(start) : start].rstrip()
            if head.endswith("async"):
                start = code.rindex("async", 0, start)
                head = head[:-5].rstrip()
            got = _ASSIGNED.search(head + " ")
            name = got.group(1) if got else None
            i = re.compile(r"\s*").match(code, m.end()).end()
            if i < len(code) and code[i] == "{":
                end, error = (pairs[i] + 1, False) if i in pairs else (len(code), True)
            else:
                end, error, depth = i, False, 0
                while end < len(code):
                    c = code[end]
                    if c in "([{":
                        if end not in pairs:
                            error = True
                            break
                        end = pairs[end] + 1
                        continue
                    if c in ")]};," or c == "\n" and _NEXT_STATEMENT.match(code, end):
                        break
                    end += 1
            found.append((start, end, name, error))
            continue
        open_ = m.end() - 1
        name = m.group(1) if lang != "javascript" and not script else (m.group(1) or m.group(2))
        keyword = script and tok.startswith("function")
        start = m.start() + len(tok) - len(tok.lstrip())
        if not keyword and (name is None or name in _NO_CALL) and not (name == "constructor" and script):
            continue
        if open_ not in pairs:
            if lang == "go" or keyword:
                found.append((start, len(code), name, True))
            continue
        brace = _body(lang, code, pairs[open_] + 1, False, pairs)
        if brace < 0:
            continue
        if not keyword and lang != "go":
            low = statement(start)
            before = code[low:start].rstrip() or code[low - 1 : low]
            if lang == "cpp":
                lead = re.sub(r"^[ \t]*#[^\n]*$|^\s*(?:public|private|protected)\s*:", "", code[low:start], flags=re.M)
                if re.search(r"\b(?:return|else|new|case|throw)\s*$|[=(,?!+<>&|]\s*$", lead) and not re.search(r"[\w>]\s*[&*]+\s*$", lead):
                    continue
                start = start - len(lead.lstrip()) if lead.strip() else start
            elif lang == "java":
                if re.search(r"(?:[.=(,&|?!+]|->|\bnew(?:\s+[\w.<>]+)?|\breturn|\belse|\bthrow)$", before):
                    continue
                start -= len(code[low:start].lstrip())
            elif before.endswith((".", "new", "=", "(", ":", "?", "&&", "||", "return", "=>")) or (before and before[-1] not in "{};)" and not before.endswith(",")):
                continue
        if keyword:
            low = statement(start)
            lead = re.search(r"\basync\s+\Z", code[low:start])
            start -= len(lead.group()) if lead else 0
            head = code[low:start].rstrip()
            if name is None or head.endswith(tuple("=(,:?&|")):
                got = _ASSIGNED.search(head + " ")
                name = got.group(1) if got else None  # a function expression goes by its variable
        end, error = (pairs[brace] + 1, False) if brace in pairs else (len(code), True)
        heads.add(open_)
        found.append((start, end, name, error))
    found.sort(key=lambda x: (x[0], -x[1]))
    called = _callees(lang, code, found, heads)
    return [{"name": name, "source": s[a:b], "language": lang, "callees": list(called[k]), "has_error": error, "pos": k} for k, (a, b, name, error) in enumerate(found) if name is not None]


def _callees(lang: str, code: str, found: list[tuple], heads: set[int]) -> list[dict[str, None]]:
    """The names each function calls, in order: one pass over the calls with a stack of the functions around them."""
    script = lang in ("javascript", "typescript")
    out: list[dict[str, None]] = [{} for _ in found]
    around: list[int] = []
    nxt = 0
    for m in _CALL[lang].finditer(code):
        at = m.start()
        while nxt < len(found) and found[nxt][0] <= at:
            while around and found[around[-1]][1] <= found[nxt][0]:
                around.pop()
            around.append(nxt)
            nxt += 1
        while around and found[around[-1]][1] <= at:
            around.pop()
        if not around or m.end() - 1 in heads or lang == "java" and code[at - 1 : at] == "@":
            continue
        new = m.group(1) if m.re.groups == 2 else None
        text = m.group(m.re.groups)
        simple = re.split(r"::|->|\.|\?\.", re.sub(r"\s", "", text))[-1]
        if new and script or simple in _NO_CALL or (lang == "go" and simple in _GO_WORDS):
            continue
        if lang == "java" and new:
            simple = re.sub(r"\s", "", text)
        if simple:
            out[around[-1]].setdefault(simple)
    return out


class _Calls(ast.NodeVisitor):
    def __init__(self) -> None:
        self.names: dict[str, None] = {}

    def visit_FunctionDef(self, node: ast.AST) -> None:  # noqa: N802
        for d in node.decorator_list:
            self.visit(d)

    visit_AsyncFunctionDef = visit_FunctionDef  # noqa: N815

    def visit_Call(self, node: ast.Call) -> None:  # noqa: N802
        f = node.func
        if isinstance(f, ast.Name):
            self.names.setdefault(f.id)
        elif isinstance(f, ast.Attribute):
            self.names.setdefault(f.attr)
        self.generic_visit(node)


def _python_tree(s: str) -> list[dict] | None:
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(s)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None
    out: list[dict] = []

    def walk(node: ast.AST) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)):
                calls = _Calls()
                for part in (child.args, child.returns, *child.body):
                    if part is not None:
                        calls.visit(part)
                out.append({"name": child.name, "source": ast.get_source_segment(s, child) or "", "language": "python", "callees": list(calls.names), "has_error": False, "pos": len(out)})
            walk(child)

    walk(tree)
    return out


_PY_DEF = re.compile(r"^[ \t]*(?:async[ \t]+)?def[ \t]+(\w+)", re.M)


def _python_functions(s: str) -> list[dict]:
    got = _python_tree(s)
    if got is not None:
        return got
    blocks = re.split(r"(?m)^(?=\S)", s)  # the file doesn't parse: block by block
    out: list[dict] = []
    for b in blocks:
        part = _python_tree(b)
        if part is None:
            part = [{"name": m.group(1), "source": b[m.start() :].strip("\n") if i == 0 else m.group(), "language": "python", "callees": [], "has_error": True, "pos": 0} for i, m in enumerate(_PY_DEF.finditer(_blanked("python", b)))]
        out += part
    for i, f in enumerate(out):
        f["pos"] = i
    return out


def functions_of(source: str | None, path: str | None) -> list[dict]:
    """EXT1: the functions of a file in order of their beginnings."""
    lang = language_of(path)
    if lang is None or not source:
        return []
    s = source.replace("\r\n", "\n")
    return _python_functions(s) if lang == "python" else _brace_functions(lang, s)


def extract(files: DataFrame, path: str = "file_path", source: str = "source") -> DataFrame:
    """Every file's functions beside the file's other columns: name, source, language, callees, has_error, pos, content_hash (EXT7)."""
    keys = [c for c in files.columns if c != source]

    @F.pandas_udf(f"array<{EXTRACTED.simpleString()}>")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for paths, sources in batches:
            yield pd.Series([functions_of(s, p) for p, s in zip(paths, sources)], dtype=object)

    rows = files.withColumn("__f", run(F.col(path), F.col(source))).select(*keys, F.explode("__f").alias("f"))
    return rows.select(*keys, "f.name", "f.source", "f.language", "f.callees", "f.has_error", "f.pos", F.sha2("f.source", 256).alias("content_hash"))
