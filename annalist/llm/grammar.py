"""Statement grammar on the token stream of JavaScript, TypeScript, Go, Java and C++.

Operands and operators alternate. A walk over the tokens keeps what is due next - an operand, an operator, either, or the
start of a statement - and a stack of open brackets with what they hold. That finds two operands side by side, operators
without operand, statements that a brace cuts off, conditions without a body and `else` without `if`, whatever lies
between the tokens. Names aren't resolved, so where a language lets types and names stand side by side, they may.

The walk is linear and takes code without literals and comments (`lexing.skeleton`).
"""

from __future__ import annotations

import re

_TOKEN = re.compile(
    r"""\n|[^\W\d][\w$]*|\$[\w$]*|""|\.?\d(?:[\w.]|(?<=[eEpP])[-+]|'(?=\w))*|\.\.\.|=>|->\*?|<-|:=|::|\?\?=?|\?\.(?!\d)|===|!==|\*\*=?|&&=?|\|\|=?|<<=|&\^=?|\+\+|--|<=>|[-+*/%&|^!=<]=|<<|[^\w\s]"""
)

#: The languages' words by what may stand beside them.
#: An operand is due after these.
_UNARY = {
    "javascript": set("return throw new typeof void delete await yield case in of instanceof extends default else do".split()),
    "go": set("return case go defer range".split()),
    "java": set("return throw new case instanceof extends implements throws import package assert else do default".split()),
    "cpp": set("return throw new delete case goto co_await co_return co_yield sizeof alignof typeid not compl typename using else do".split()),
}
#: These end a statement or go before a word, which may be missing.
_FREE = set("return break continue yield default else do co_return fallthrough goto case new delete throw".split())
#: Conditions in brackets follow, and a body.
_HEADS = {"javascript": {"if", "while", "for", "switch", "with"}, "java": {"if", "while", "for", "switch", "synchronized"}, "cpp": {"if", "while", "for", "switch"}, "go": set()}
#: Words of a language that stand beside others: modifiers, declarations, infix words, words that are names elsewhere.
_BESIDE = {
    "javascript": set("let const var function class async await static get set of in instanceof as from import export default extends try finally catch if else for while do switch with case break continue return throw new typeof void delete yield super this accessor using".split()),
    "java": set(
        "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native new package private "
        "protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while record sealed permits non var yield when module requires exports opens provides uses to with open transitive".split()
    ),
    "go": set("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split()),
    "cpp": set(
        "alignas alignof and asm auto bool break case catch char class co_await co_return co_yield concept const consteval constexpr constinit const_cast continue decltype default delete do double dynamic_cast else enum explicit export extern false final "
        "float for friend goto if inline int long mutable namespace new noexcept not nullptr operator or override private protected public register reinterpret_cast requires return short signed sizeof static static_assert static_cast struct switch "
        "template this thread_local throw true try typedef typeid typename union unsigned using virtual void volatile wchar_t while xor import module bitand bitor compl and_eq or_eq xor_eq not_eq signals slots emit".split()
    ),
}
_BESIDE["typescript"] = _BESIDE["javascript"] | set(
    "type interface enum namespace module declare abstract readonly public private protected is keyof infer asserts satisfies override unique implements global out require object any string number boolean symbol never unknown".split()
)
for _of in (_UNARY, _HEADS):
    _of["typescript"] = _of["javascript"]
#: Words that the language keeps and has no use for.
_NEVER = {"javascript": {"enum"}, "typescript": set(), "go": set(), "java": {"const", "goto"}, "cpp": set()}
#: Signs that the language doesn't have.
_NO_SIGN = {
    "javascript": set(":= :: -> <=> \\ \ufffd".split()), "go": set("=> === !== -> :: ? ?. ?? ?\x3f= @ # $ ** <=> \\ \ufffd".split()),
    "java": set(":= => === !== ?. ?? ** **= <=> # ` \\ \ufffd".split()), "cpp": set(":= => === !== ?. ?? @ ` # \\ \ufffd".split()),
}
_NO_SIGN["typescript"] = _NO_SIGN["javascript"]
#: Words that go on with the line before theirs.
_INFIX, _INFIX_TYPES = set("in of instanceof extends else from with".split()), set("as implements is satisfies".split())
#: Words that go on with the statement of the brace before them.
_GOES_ON = set("else catch finally while in of instanceof as from extends implements".split())
_TYPES = set("class struct interface enum record namespace union extern module switch".split())
_PREFIX = {"javascript": set("+ - ! ~ ++ -- ... @ #".split()), "go": set("+ - ! ^ * & <- ... ~".split()), "java": set("+ - ! ~ ++ -- @ ...".split()), "cpp": set("+ - ! ~ ++ -- * & && :: ... ^".split())}
_PREFIX["typescript"] = _PREFIX["javascript"] | {"|", "&"}
_POSTFIX = {"++", "--", "!"}
#: Operators that take an operand on both sides.
_BINARY = set("= += -= *= /= %= &= |= ^= <<= == != === !== <= && || | ^ % / + - * & ** **= &&= ||= ?? ??= << &^ &^= := <=> ~ =>".split())
_CLOSE = {")": "(", "]": "[", "}": "{"}
_NAME = re.compile(r"[^\W\d]|\$")
#: Names that a C preprocessor may replace by anything.
_CAPITALS = re.compile(r"_*[A-Z][A-Z0-9_]*$|__\w+$|\w+_[A-Z]{2,}$")
#: A text right behind a name or bracket is a tagged template.
_TAGGED = re.compile(r'(?<=[\w$)\]])""')


def grammar_error(lang: str, code: str) -> str | None:
    """The first place of code whose brackets match that no program of the language has, or None."""
    beside, unary, heads, prefix = _BESIDE[lang], _UNARY[lang], _HEADS[lang], _PREFIX[lang]
    script, go, java, cpp = lang in ("javascript", "typescript"), lang == "go", lang == "java", lang == "cpp"
    typescript = lang == "typescript"
    never = _NEVER[lang] | _NO_SIGN[lang]
    # due: s a statement begins, e an operand, x either, a an operator
    due, prev, before, line = "s", "", "", True
    stack: list[tuple[str, str, list]] = []  # bracket, what it holds, words of the statement around it
    kind = "block"
    words: list[str] = []  # of the statement
    ifs, asks = [0], [0]  # per bracket: conditions without else, questions without their colon
    body = False  # the statement of a condition is due
    names = 0  # plain names side by side
    stmt_bracket = False  # whether the last bracket that closed held a condition
    for tok in _TOKEN.findall(_TAGGED.sub("`", code) if script else code):
        if tok == "\n":
            line = True
            continue
        if tok == "`" and script:
            if due == "a":
                continue
            tok = '""'
        elif tok == "**" and not script:
            tok = "*"
        c = tok[0]
        if tok in never:
            return tok
        if prev in heads and tok != "(" and before not in (".", "?.", "::") and not (script and (tok in (":", "await", ",", "}", "=") or prev == "with")) and not (cpp and (tok in ("constexpr", "consteval", "!") or _CAPITALS.match(tok))):
            return f"{prev} {tok}"
        literal = tok == '""' or c.isdigit() or c == "." and len(tok) > 1 and tok[1].isdigit()
        if line and script and prev in ("break", "continue", "return", "debugger") and before not in (".", "?."):
            due, words = "s", []
        if line and due == "a" and kind != "(" and (script or go):
            # a line that can't go on begins a statement
            if literal or _NAME.match(c) and tok not in _INFIX and not (typescript and tok in _INFIX_TYPES) or c in "{@#":
                due, words = ("s", []) if kind in ("block", "switch") else ("x", words)
                names = 0
        if literal or _NAME.match(c):
            if body and tok == "else":
                return "no statement before else"
            if due == "a":
                word = not literal
                if literal:
                    if not (cpp and tok == '""' and (prev == '""' or _NAME.match(prev)) or tok == '""' and go and _NAME.match(prev) or prev in beside or prev in ("}", ">")):
                        if not (tok == '""' and script and prev in ("from", "import", "module", "with", "assert")) and not (prev == ")" and stmt_bracket):
                            return f"{prev} {tok}"
                elif prev == '""' or prev[0].isdigit():
                    if tok not in beside and not (cpp and (prev == '""' or _CAPITALS.match(tok))):
                        return f"{prev} {tok}"
                elif script and tok not in beside and prev not in beside and (_NAME.match(prev) or prev == "]" or prev == ")" and not stmt_bracket):
                    if prev != ")" or not typescript:
                        return f"{prev} {tok}"
                if word and _NAME.match(prev) and tok not in beside and prev not in beside and not (cpp and (_CAPITALS.match(tok) or _CAPITALS.match(prev))):
                    names += 1
                    if names > 1 and not script:
                        return f"{before} {prev} {tok}"
                else:
                    names = 0
            else:
                names = 0
            if tok == "else":
                if due not in ("s", "x") and not (script or go):
                    return "else within a statement"
                if prev not in ("}", ";") and not (script and line):
                    return f"{prev} else"
                if not go and ifs[-1] <= 0:
                    return "else without if"
                ifs[-1] -= 1
            elif tok == "if" and due != "e":
                ifs[-1] += 1
            if tok not in _GOES_ON and (due == "s" or due == "x" and prev == "}" and kind == "block"):
                words = []
            if not literal and prev not in (".", "?."):
                words.append(tok)
            body = tok in ("else", "do") and not go and prev not in (".", "?.")
            if tok in unary and prev not in (".", "?.", "->", "::"):
                due = "x" if tok in _FREE or tok in beside else "e"
            elif tok in beside and tok not in ("this", "super", "true", "false", "nullptr"):
                due = "x"
            else:
                due = "a"
        elif c in "([{":
            if c == "(":
                holds = "head" if before not in (".", "?.") and (prev in heads or prev in ("constexpr", "await") and before in heads) else "block" if go and prev in ("import", "var", "const", "type") else "("
            elif c == "[":
                holds = "["
            else:
                holds = _brace(prev, before, words, due, kind, script, go, java, cpp)
            stack.append((c, kind, words, names))
            kind = holds
            ifs.append(0)
            asks.append(0)
            words = []
            body = False
            due = "s" if holds == "block" else "x"
        elif c in ")]}":
            if due == "e" and prev != "{" and not (prev in ("*", "&", "&&", ">", "...") or cpp and (kind == "[" and prev in ("=", "&") or prev == "=" and before == "operator")):
                return f"{prev} {tok}"
            if body and c == "}":
                return "no statement before }"
            if c == "}" and due == "a" and kind == "block" and (java or cpp) and prev != "}":
                if not (cpp and prev == ")" and words and _CAPITALS.match(words[0]) or cpp and _CAPITALS.match(prev)):
                    return f"{prev} }}"
            if prev == "," and c == ")" and (java or cpp):
                return ", )"
            was = kind
            _, kind, words, names = stack.pop()
            ifs.pop()
            asks.pop()
            stmt_bracket = was == "head"
            if c == ")":
                body = was == "head"
                due = "s" if was == "head" else ("a" if script or go else "x")
                if was == "head" and words and words[-1:] == ["while"] and "do" in words:
                    body, due = False, "a"
            elif c == "]":
                due = "x" if not script else "a"
            else:
                due = "x"
                if was in ("block", "switch", "enum") and kind in ("block", "switch"):
                    names = 0
                    if not (script and words):
                        words = words if "do" in words[-1:] else []
        elif c == ";":
            if due == "e" and prev not in (">", "*", "&", "&&", "...") or prev == "," and due != "a":
                return f"{prev} ;"
            asks[-1] = 0
            due, words, names, body = ("s" if kind not in ("(", "head") else "x"), [], 0, False
        elif c == ",":
            if due in ("e", "s") and prev not in (">", "*", "&", "&&", "...", ")", "]", "}", ",", "(", "[", "{"):
                return f"{prev} ,"
            if prev == "(" and not cpp:
                return "( ,"
            due, names = "x", 0
        elif tok in (".", "?.", "::", "->", "->*"):
            due = "e" if tok in (".", "?.") and not (go and tok == ".") else "x"
            names = 0
        elif tok in ("<", ">", "?", ":", "...", "@", "#", "<-"):
            due, names = "x", 0
            if script and tok == "?":
                asks[-1] += 1
            elif script and tok == ":":
                if asks[-1]:
                    asks[-1] -= 1
                elif not typescript and (kind in ("(", "[", "head") or kind == "block" and len(words) > 1 and words[0] not in ("case", "default")):
                    return f"{prev} :"  # a type
            if tok == ":" and prev not in ("?",) and kind in ("block", "switch") and words and words[0] in ("case", "default"):
                due, words = "s", []
        elif tok in ("++", "--"):
            due = "a" if due == "a" else "e" if due == "e" or due == "s" else "x"
        elif tok == "!":
            due = "x" if due == "a" else "e"
        elif tok in _BINARY:
            if tok == "=" and (prev == ":" or cpp and len(words) == 2 and words[0] == "const" and prev == words[1]):
                return f"{prev} ="
            if due in ("e", "s") and tok not in prefix and not (java and tok == "*" and prev == ".") and not (script and tok == "*" and due == "s") and prev not in (">", "*", "&", "&&", "operator", "}", ")", "]", "..."):
                return f"{prev} {tok}"
            if tok in ("*", "&", "&&", "|") or tok == "=>" or prev == "operator":
                due = "x"
            else:
                due = "e"
            names = 0
        else:
            return f"stray {tok}"
        if cpp and prev == "import" and c in "{(*":
            return f"import {tok}"
        if cpp and prev in ("public", "private", "protected") and tok not in (":", "slots", "Q_SLOTS") and before not in (":", ",", "virtual") and not _NAME.match(tok):
            return f"{prev} {tok}"
        if cpp and prev in ("public", "private", "protected") and tok not in ("slots", "Q_SLOTS", "virtual") and _NAME.match(tok) and before not in (":", ",", "virtual"):
            return f"{prev} {tok}"
        if prev == "@" or prev == "." and before == "@x":
            tok = "@x"  # an annotation's or decorator's name stands beside anything
        elif tok == "." and prev == "@x":
            prev = "@x"
        before, prev, line = prev, tok, False
    if due == "e" and prev not in (">", "*", "&", "&&") or prev in (":", ",", "::", "<", "?", "->", "=>"):
        return f"{prev} at the end"
    if body:
        return "no statement at the end"
    if (java or cpp) and due == "a" and prev != "}" and not (cpp and _CAPITALS.match(prev)):
        return "premature end"
    if (java or cpp) and due in ("x", "s") and prev in (")", "]") and not (cpp and len(words) == 1):
        return "premature end"
    return None


def _brace(prev: str, before: str, words: list[str], due: str, kind: str, script: bool, go: bool, java: bool, cpp: bool) -> str:
    """What a brace holds: block (statements or members), enum, init (values) or any."""
    if _TYPES.intersection(words):
        if "enum" in words:
            return "enum"
        return "block" if java or cpp or "class" in words or "switch" in words else "any"
    if prev == ")" or prev in ("else", "do", "try", "finally", "=>") or cpp and prev in ("const", "noexcept", "override", "final", "mutable"):
        return "block"
    if java:
        if prev in ("=", "]", ",", "(") or prev == "{" and kind == "init":
            return "init"
        return "block"
    if cpp:
        if kind in ("init", "any") and prev in ("{", ","):
            return "init"
        if prev in (";", "}", "{", "", ":") and kind != "init":
            return "block"
        return "init" if prev in ("=", ",", "(", "return") or prev == "{" else "any"
    if script:
        return "block" if due == "s" else "any"
    return "any"
