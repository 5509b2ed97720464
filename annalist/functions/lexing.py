"""Lexical structure of source files: literals, comments and brackets of Python, JavaScript, TypeScript, Go, Java and C++.

`scan` walks a file once and yields its literals and comments; what lies between them is code. It only stops where a
literal or comment may begin, so its cost is one search per literal and not one step per character.
"""

from __future__ import annotations

import re
from typing import NamedTuple

#: Extension to language.
LANGUAGES = {
    ".py": "python",
    ".js": "javascript",
    ".ts": "typescript",
    ".go": "go",
    ".java": "java",
    ".cpp": "cpp",
    ".cc": "cpp",
    ".cxx": "cpp",
    ".h": "cpp",
    ".hpp": "cpp",
}


def language_of(path: str | None) -> str | None:
    """The language of a path by its extension in any case; None for others."""
    if not path:
        return None
    name = path.rsplit("/", 1)[-1]
    dot = name.rfind(".")
    return LANGUAGES.get(name[dot:].lower()) if dot > 0 else None


class Piece(NamedTuple):
    """kind: s string, c comment, r regular expression, t part of a template. body: the literal's contents. ok: whether it ends."""

    kind: str
    start: int
    end: int
    body_start: int
    body_end: int
    ok: bool = True


_DQ = re.compile(r'[^"\\\n]*(?:\\(?:\r\n|.|\n)[^"\\\n]*)*"')
_SQ = re.compile(r"[^'\\\n]*(?:\\(?:\r\n|.|\n)[^'\\\n]*)*'")
_TDQ = re.compile(r'[^"\\]*(?:(?:\\.|"(?!""))[^"\\]*)*"""', re.S)
_TSQ = re.compile(r"[^'\\]*(?:(?:\\.|'(?!''))[^'\\]*)*'''", re.S)
_REGEX = re.compile(r"/(?![*/])(?:[^\\/\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])+/[A-Za-z]*")
_TEMPLATE = re.compile(r"[^`\\$]*(?:(?:\\.|\$(?!\{))[^`\\$]*)*(`|\$\{)", re.S)
_RAWCPP = re.compile(r'([^()\\\s]{0,16})\(')
_LINE = re.compile(r"[^\n]*")
_OPEN = {
    "python": re.compile(r"""#|\"\"\"|'''|["']"""),
    "javascript": re.compile(r"""//|/\*|["'`]|/|[{}]"""),
    "go": re.compile(r"""//|/\*|["'`]"""),
    "java": re.compile(r"""//|/\*|\"\"\"|["']"""),
    "cpp": re.compile(r"""//|/\*|["']"""),
}
_OPEN["typescript"] = _OPEN["javascript"]
#: Words of JavaScript after which a slash begins a regular expression.
_BEFORE_REGEX = {"return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "do", "else", "instanceof", "yield", "await"}
_WORD_END = re.compile(r"[\w$]+$")


def _line_end(s: str, at: int) -> int:
    end = s.find("\n", at)
    return len(s) if end < 0 else end


def _quoted(s: str, at: int, quote: str, start: int) -> Piece:
    m = (_DQ if quote == '"' else _SQ).match(s, at + 1)
    if m:
        return Piece("s", start, m.end(), at + 1, m.end() - 1)
    end = _line_end(s, at)
    return Piece("s", start, end, at + 1, end, False)


def _triple(s: str, at: int, quote: str, start: int, raw_ok: bool = True) -> Piece:
    m = (_TDQ if quote == '"' else _TSQ).match(s, at + 3)
    if m:
        return Piece("s", start, m.end(), at + 3, m.end() - 3)
    return Piece("s", start, len(s), at + 3, len(s), False)


def scan(lang: str, s: str) -> list[Piece]:
    """Literals and comments in order. A template literal gives one piece per text part; its expressions are code."""
    out: list[Piece] = []
    search, pos, n = _OPEN[lang].search, 0, len(s)
    script = lang in ("javascript", "typescript")
    depth, templates = 0, []  # templates: brace depth at which an expression of a template ends
    last_end = 0  # end of the last piece
    while True:
        m = search(s, pos)
        if not m:
            return out
        at, tok = m.start(), m.group()
        if tok == "{":
            depth += 1
            pos = at + 1
            continue
        if tok == "}":
            pos = at + 1
            if templates and templates[-1] == depth:
                templates.pop()
                depth -= 1
                p, opened = _template(s, at)
                if opened:
                    depth += 1
                    templates.append(depth)
                out.append(p)
                pos = last_end = p.end
            else:
                depth -= 1
            continue
        if tok == "//" or tok == "#":
            end = _line_end(s, at)
            p = Piece("c", at, end, at + len(tok), end)
        elif tok == "/*":
            end = s.find("*/", at + 2)
            p = Piece("c", at, n, at + 2, n, False) if end < 0 else Piece("c", at, end + 2, at + 2, end)
        elif tok == "/":
            if not _regex_here(s, at, last_end, out):
                pos = at + 1
                continue
            r = _REGEX.match(s, at)
            if not r:
                pos = at + 1
                continue
            p = Piece("r", at, r.end(), at + 1, r.end())
        elif tok == "`":
            if script:
                p, opened = _template(s, at)
                if opened:
                    depth += 1
                    templates.append(depth)
            else:
                end = s.find("`", at + 1)
                p = Piece("s", at, n, at + 1, n, False) if end < 0 else Piece("s", at, end + 1, at + 1, end)
        elif len(tok) == 3:
            start = _prefix(s, at, lang)
            p = _triple(s, at, tok[0], start)
        elif lang == "python":
            p = _quoted(s, at, tok, _prefix(s, at, lang))
        elif lang == "cpp":
            p = _cpp(s, at, tok)
            if p is None:
                pos = at + 1
                continue
        else:
            p = _quoted(s, at, tok, at)
        out.append(p)
        pos = last_end = max(p.end, at + 1)


def _template(s: str, at: int) -> tuple[Piece, bool]:
    """The text part of a template from the mark at `at` on; whether it ends with the start of an expression."""
    m = _TEMPLATE.match(s, at + 1)
    if not m:
        return Piece("t", at, len(s), at + 1, len(s), False), False
    opened = m.group(1) != "`"
    return Piece("t", at, m.end(), at + 1, m.start(1)), opened


def _prefix(s: str, at: int, lang: str) -> int:
    if lang != "python":
        return at
    start = at
    while start > 0 and at - start < 2 and s[start - 1] in "rRbBuUfF":
        start -= 1
    return at if start > 0 and (s[start - 1].isalnum() or s[start - 1] == "_") else start


def _regex_here(s: str, at: int, last_end: int, out: list[Piece]) -> bool:
    """Whether a slash begins a regular expression: where an operand is due."""
    i = at - 1
    while i >= last_end and s[i] in " \t\r\n":
        i -= 1
    if i < last_end:
        return not out or out[-1].kind == "c"
    c = s[i]
    if c.isalnum() or c in "_$":
        w = _WORD_END.search(s, max(last_end, i - 20), i + 1)
        return bool(w) and w.group() in _BEFORE_REGEX
    return c not in ")]}"


def _cpp(s: str, at: int, tok: str) -> Piece | None:
    if tok == '"':
        i = at
        while i > 0 and s[i - 1] in "uUL8R":
            i -= 1
        if at > i and s[at - 1] == "R" and not (i > 0 and (s[i - 1].isalnum() or s[i - 1] == "_")):
            m = _RAWCPP.match(s, at + 1)
            if m:
                end = s.find(f"){m.group(1)}\"", m.end())
                if end < 0:
                    return Piece("s", i, len(s), m.end(), len(s), False)
                return Piece("s", i, end + len(m.group(1)) + 2, m.end(), end)
        return _quoted(s, at, tok, at)
    before = s[at - 1] if at else ""
    if before.isalnum() and re.search(r"(?:^|[^\w'])\d[\w']*$", s[max(0, at - 40) : at]):
        return None  # a digit separator
    return _quoted(s, at, tok, at)


def skeleton(s: str, pieces: list[Piece]) -> str:
    """The code with each literal as an empty string and each comment as white space; line breaks in comments stay one."""
    parts, pos = [], 0
    for p in pieces:
        parts.append(s[pos : p.start])
        if p.kind == "c":
            parts.append("\n" if "\n" in s[p.start : p.end] else " ")
        elif p.kind == "t":
            a, b = s[p.start] == "`", s[p.end - 1] == "`" and p.end - p.start > 1 or not p.ok
            parts.append('""' if a and b else '""+(' if a else ')+""' if b else ")+(")
        else:
            parts.append('""')
        pos = p.end
    parts.append(s[pos:])
    return "".join(parts)


_BRACKETS = re.compile(r"[()\[\]{}]")
_PAIR = {")": "(", "]": "[", "}": "{"}


def unbalanced(code: str) -> tuple[str, int] | None:
    """The first bracket that a pushdown stack can't match: (what, position), or the innermost one left open at the end."""
    stack: list[str] = []
    where: list[int] = []
    for m in _BRACKETS.finditer(code):
        c = m.group()
        if c in "([{":
            stack.append(c)
            where.append(m.start())
        elif stack and stack[-1] == _PAIR[c]:
            stack.pop()
            where.pop()
        else:
            return ("unexpected " + c, m.start())
    return ("unclosed " + stack[-1], where[-1]) if stack else None
