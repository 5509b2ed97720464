"""Problem 10: sentences of documents in many languages and scripts.

A text is cut into units first: heading lines, fenced code blocks, list items and paragraphs. Within a unit every mark
that may end a sentence is a candidate, in Thai every blank between Thai words. A semi-Markov dynamic program then picks
whole sentence spans: a span is scored by its length, by how it opens and closes (the words around its boundary, known
abbreviations, ordinals, initials), and by whether its quotations and brackets are balanced, all jointly, and the best
division of the unit wins. So a mark within a quotation is no end if the span would leave the quotation open.

The program is exact and linear in the unit's candidates: a span may be of any length; spans that have begun are carried
from mark to mark, and one is dropped only when it can no longer win. Texts are processed whole, one pass within the
scan's tasks. Offsets are code points of the text as it is, whatever its line ends. Null, empty and blank texts have no
sentences; repeated rows repeat theirs; the column `lang` is not used, as it may be wrong.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What it costs to cut within a quotation or bracket.
UNBALANCED = 10.0
#: Code points below and above which a span is less likely a sentence, and the most that this costs; characters of scripts without blanks count WIDE-fold.
SHORT, LONG, LENGTH_COST, WIDE = 12, 200, 1.0, 3
#: What it costs a span that opens as a question or exclamation (¿, ¡) and closes otherwise.
OPEN_CLOSE = 1.0

#: Abbreviations, without their last dot and in lower case.
#: After these the sentence goes on.
_NEVER = set(
    "dr mr mrs ms prof sr sra srta dra jr st mt mme mlle mm m hr hrn fr dipl ing rev hon gen col lt capt sgt e.g i.e eg ie cf vs viz al p.ex p.ej ex ej z.b z d.h d.i bzw vgl evtl ggf inkl exkl sog s.o s.u geb gest "
    "c.-à-d ee т.е т.к т.н им проф акад г-н ул د أ م डॉ पृ श्री सुश्री सं dept dist incl excl resp abbr ibid aka".split()
)
#: Before a number or a small letter the sentence goes on.
_NUMBER = set(
    "no nos nr n° núm num fig figs figg abb abschn art arts sec secs sect ch chap cap kap pág pag págs pp p s vol vols ed eds eq eqs par abs bd v ver max min approx aprox env ca circa c см рис гл стр с табл п ср ок прим ст tab app anm bsp zzgl jan feb mar apr jun jul aug sep sept oct nov dec".split()
)
#: They may end a sentence; before a small letter they don't.
_MAY = set("etc usw usf u.a o.ä u.ä a.m p.m am pm u.s u.k u.n inc ltd co corp llc bros uu o u т п д е др пр г гг в вв тыс млн млрд руб коп т.п т.д и.о v.chr n.chr a.c d.c b.c a.d std min sek mio mrd st".split())
_ORDINAL_AFTER = set("der die das den dem des am im vom zum zur beim ab bis seit jede jeder jedes jeden diese dieser dieses unser unsere mein meine ihr ihre und oder".split())
#: Words that open sentences; behind an initial or an abbreviation of a name they tell that it ended one.
_OPENS = set(
    "the this that these those there it its he she we they you i a an in on at for from if when while after before as since once although because but and so then next now here what why how who where which please note see use run only all each every some no not "
    "der die das ein eine dies diese dieser dieses es er sie wir ihr man im in am beim wenn als nach vor seit weil aber und dann danach nun hier was warum wie wer wo bitte nur alle jede jeder kein keine "
    "le la les un une ce cette ces il elle on nous vous ils elles dans sur pour si quand après avant comme mais et puis ensuite ici pourquoi comment tous chaque "
    "el los las una unos este esta estos estas ello él ella nosotros ellos en con para cuando después antes como pero y luego aquí qué por cómo todos cada "
    "это этот эта эти он она они мы вы в на если когда после до но и затем потом здесь почему как все каждый".split()
)
#: Verbs of speech that go on after a question or exclamation, in lower case.
_SAYS = set(
    "said says asked asks replied answered wrote shouted cried exclaimed whispered added thought wondered "
    "sagte sagt fragte fragt antwortete rief ruft schrieb meinte dachte flüsterte ergänzte "
    "dit demanda demande répondit répond écrivit cria crie ajouta pensa murmura "
    "dijo dice preguntó pregunta respondió responde contestó escribió gritó exclamó añadió pensó "
    "сказал сказала спросил спросила ответил ответила написал написала крикнул крикнула подумал подумала добавил добавила".split()
)
_WORD = re.compile(r"[^\W\d_]+")
_PARTICLES = "とってがはをにのでもや、，；：・的地得着了过吗呢"

_MARK = re.compile(r"[.!?]+…*|…+[.!?]*|[。！？｡．]+|[।॥؟۔]+")
_MARKS = re.compile(r"[.!?…。！？｡．।॥؟۔]+")
_THAI = re.compile(r"[฀-๿]")
_THAI_BLANK = re.compile(r"(?<=[฀-๿])(?:[ \t ]+(?:\r?\n[ \t ]*)?|\r?\n[ \t ]*)(?=[฀-๿])")
_CODE = re.compile(r"`[^`]*`|https?://\S+")
_CLOSERS = "\"'”’»›」』）)]}*_“】》〉"
_OPENERS = "\"'“„‘«‹「『（([{¿¡*`_【《〈—"
_OPENERS_BUT_ASKING = _OPENERS.replace("¿", "").replace("¡", "") + " "
_BALANCE = re.compile(r'["“”„«»「」『』()（）\[\]【】《》{}]')
_PAIRS = {")": "(", "）": "（", "]": "[", "」": "「", "』": "『", "»": "«", "}": "{", "】": "【", "》": "《"}
_OPENING_MARKS = "([{«„“‘'「『（【《—–-"
_CLOSING_MARKS = ")]}»”’'.,;:!?」』）】》—–…"
_LIST = re.compile(r"[ \t]*(?:([-*+•‣◦])|(\d{1,9})[.)])(?:[ \t]+|$)")
_HEAD = re.compile(r" {0,3}#{1,6}(?:[ \t]|$)")
_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})")
_SPECIAL = "`~#=-*+•‣◦"
_RULE = re.compile(r" {0,3}(?:=+|-{2,})[ \t]*$")
_IDENT = re.compile(r"[A-Za-z]\w*_\w+|[A-Za-z_]\w*\(|[\w-]+\.(?:go|py|js|ts|md|json|yaml|yml|java|cpp|h|gz|txt|toml|sh|html|css)\b|--?\w")
_BEFORE = re.compile(r"[^\s(\[{\"'“„«‹「（]+$")


def _cjk(c: str) -> bool:
    return "぀" <= c <= "ヿ" or "㐀" <= c <= "鿿" or "가" <= c <= "힣" or "豈" <= c <= "﫿" or "ｦ" <= c <= "ﾟ"


def _thai(c: str) -> bool:
    return "฀" <= c <= "๿"


def units(text: str) -> list[tuple[int, int, int, bool]]:
    """(start, end, where its words begin, whether it is taken whole) of headings, code blocks, list items and paragraphs."""
    out: list[tuple[int, int, int, bool]] = []
    start, body, fence, number = -1, 0, "", None  # of the open unit; of the open block; of the last list item
    pos, lines = 0, re.split(r"(?<=\n)|(?<=\r)(?!\n)", text)
    last = 0  # end of the open unit's last line

    def close() -> None:
        nonlocal start
        if start >= 0:
            out.append((start, last, body, False))
        start = -1

    for line in lines:
        at, pos = pos, pos + len(line)
        bare = line.rstrip("\r\n")
        end = at + len(bare)
        if fence:
            m = _FENCE.match(bare)
            if m and m.group(1)[0] == fence[0] and len(m.group(1)) >= len(fence) and not bare.strip().strip(fence[0]):
                out.append((start, end, end, True))
                start, fence = -1, ""
            last = end
            continue
        inner = bare.strip()
        if not inner:
            close()
            continue
        if inner[0] not in _SPECIAL and not inner[0].isdigit():
            if start < 0:
                start, body, number = at, at, None
            last = end
            continue
        m = _FENCE.match(bare)
        if m and not (m.group(1)[0] == "`" and "`" in bare.strip().lstrip("`")):
            close()
            start, fence, last, number = at, m.group(1), end, None
            continue
        if _HEAD.match(bare):
            close()
            out.append((at, end, end, True))
            number = None
            continue
        if start >= 0 and number is None and _RULE.match(bare) and "\n" not in text[start:last].strip():
            out.append((start, end, end, True))
            start = -1
            continue
        m = _LIST.match(bare)
        if m and not (bare.strip().startswith("**")):
            n = int(m.group(2)) if m.group(2) else None
            if n is None or start < 0 or n == 1 or (number is not None and n == number + 1):
                close()
                start, body, last, number = at, at + m.end(), end, n if n is not None else -1
                continue
        if start < 0:
            start, body = at, at
            number = None
        last = end
    if fence:
        out.append((start, last, last, True))
    else:
        close()
    return out


class _Counts(dict):
    """Places of a character in a text, found once; `before`: how many lie before a place."""

    def __init__(self, s: str):
        self.s = s

    def __missing__(self, c: str) -> list[int]:
        got = self[c] = [m.start() for m in re.finditer(re.escape(c), self.s)]
        return got

    def before(self, c: str, end: int) -> int:
        return bisect_left(self[c], end)


def _candidates(s: str, words: int) -> list[tuple[int, int, float]]:
    """(end, start of what follows, score) of each place in a unit where a sentence may end."""
    code = [(m.start(), m.end()) for m in _CODE.finditer(s, words)] if "`" in s or "://" in s else []
    counts = _Counts(s)
    out: list[tuple[int, int, float]] = []
    k, n = 0, len(s)
    found = [m.span() for m in _MARKS.finditer(s, words)]
    if any(b > a + 1 for a, b in found):
        found = [m.span() for a, b in found for m in _MARK.finditer(s, a, b)]
    if _THAI.search(s, words):
        found = sorted([*found, *(m.span() for m in _THAI_BLANK.finditer(s, words))])
    for a, b in found:
        after = s[b] if b < n else ""
        if b == a + 1 and s[a] == "." and ("a" <= after <= "z" or "0" <= after <= "9"):
            continue  # within a name or number
        while k < len(code) and code[k][1] <= a:
            k += 1
        if k < len(code) and code[k][0] <= a:
            if not (s[code[k][0]] == "h" and b >= code[k][1]):
                continue
        mark = s[a:b]
        if not mark.strip():
            if not (s[a - 1] == "ๆ" or s[b] == "ๆ"):
                out.append((a, b, 3.0))
            continue
        kind = mark[0] if mark[0] not in "!?" else "!"
        if kind == "." and len(mark) > 1 and set(mark) == {"."}:
            kind = "…" if len(mark) > 2 else "."
        end, closed, bracket = b, False, False
        while end < n and not s[end].isalnum():
            c = s[end]
            if c in "   " and end + 1 < n and s[end + 1] in "»›":
                end += 2
                closed = True
                continue
            if c not in _CLOSERS:
                break
            if c == "“" and counts.before("„", end) <= counts.before("“", end):
                break
            if c == '"' and counts.before('"', end) % 2 == 0:
                break
            if c == "'" and not (end + 1 == n or s[end + 1].isspace()):
                break
            if c in _PAIRS and counts.before(_PAIRS[c], end) <= counts.before(c, end):
                break
            if c in "*_" and not (end + 1 >= n or s[end + 1].isspace() or s[end + 1] in "*_"):
                break
            closed = closed or c not in "*_"
            bracket = bracket or c in ")）]"
            end += 1
        nxt = end
        while nxt < n and s[nxt].isspace():
            nxt += 1
        if nxt >= n:
            continue
        blank, c = nxt > end, s[nxt]
        prev = s[a - 1] if a else ""
        wide = mark[0] in "。！？｡．" or (mark[0] == "…" and _cjk(prev)) or (mark[0] == "…" and (prev == "%" or prev.isdigit()) and _cjk(c)) or (_cjk(c) and not blank)
        score = _score(s, a, end, nxt, kind, mark, closed, bracket, blank, wide, prev, c)
        if score is not None:
            out.append((end, nxt, score))
    return out


def _opens(s: str, at: int) -> bool:
    w = _WORD.match(s, at)
    return bool(w) and w.group().lower() in _OPENS


def _score(s: str, a: int, end: int, nxt: int, kind: str, mark: str, closed: bool, bracket: bool, blank: bool, wide: bool, prev: str, c: str) -> float | None:
    """How well a sentence closes before `end` and another opens at `nxt`; None: no candidate."""
    if c in ",;:،，、；：)）]}»”」』%/=&|":
        return None
    if wide:
        if mark[0] == "…" and len(mark) < 2 and set(mark) == {"…"}:
            return None
        if closed and c in _PARTICLES:
            return -6.0
        return 4.0
    dash = c in "—–-" and not (s[nxt + 1 : nxt + 2].isalnum() and c == "-")
    if dash and (closed or kind == "…"):
        return -6.0
    if not blank:
        if kind == ".":
            if not (c.isupper() or c in "¿¡«„“\"`(" or (c.isalpha() and not c.islower())):
                return None
            if c.isupper() and not (s[nxt + 1 : nxt + 2].islower() or s[nxt + 1 : nxt + 2] in (" ", "'", "’")):
                return None
            if not (prev.isalpha() and (prev.islower() or not prev.isupper()) or prev in ")`»”\"" or prev.isdigit()):
                return None
            if c in "`\"(" and not prev.isalpha():
                return None
        elif not (c.isupper() or c in "¿¡«„“`" or _cjk(c) or (c.isalpha() and not c.islower())):
            return None
    lower = c.islower()
    ident = bool(_IDENT.match(s, nxt)) or c == "`"
    score = 3.0 if kind == "." else 1.0 if kind == "…" else 4.0
    if kind == "." and not closed:
        m = _BEFORE.search(s, max(0, a - 24), a)
        token = m.group() if m else ""
        low = token.lower().lstrip("*_¿¡-")
        low = low.rsplit("'", 1)[-1].rsplit("’", 1)[-1]
        if "." in token and token.rsplit(".", 1)[-1].istitle() and low not in _NEVER and low not in _MAY:
            token = token.rsplit(".", 1)[-1]  # the blank before it is missing
            low = token.lower()
        spelled = "." in low and all(len(x) == 1 for x in low.split("."))
        if low in _NEVER:
            return -8.0
        if low in _NUMBER and (c.isdigit() or c in "(#§" or lower and not ident):
            return -8.0
        if low in _NUMBER or low in _MAY or spelled:
            if lower and not ident or c.isdigit():
                return -6.0
            score = 0.5
            if spelled and token.isupper() and not _opens(s, nxt):
                return -1.0
        elif len(token) == 1 and token.isupper():
            return 1.5 if blank and _opens(s, nxt) and not s[max(0, a - 4) : a - 1].rstrip().endswith(".") else -4.0
        elif token.isdigit() and len(token) <= 2:
            w = re.search(r"(\w+)\s+\d+$", s[max(0, a - 30) : a])
            if w and w.group(1).lower() in _ORDINAL_AFTER:
                return -6.0
    if lower and not ident:
        if closed or kind == "…" or kind == "!" and _SAYS.intersection(_WORD.findall(s, nxt, nxt + 16)[:1]):
            return -6.0
        return score - 1.5
    if bracket and lower:
        return -6.0
    if c.isupper() or c.isdigit() or ident or c in _OPENERS:
        score += 1.0 if c.isdigit() else 2.0
    elif c.isalpha():
        score += 2.0
    return score - (0.5 if not blank else 0)


def _length_cost(n: int) -> float:
    """0 for a sentence's usual length, up to LENGTH_COST for very short and very long spans."""
    if n < SHORT:
        return LENGTH_COST * (SHORT - n) / SHORT
    return 0.0 if n <= LONG else min(LENGTH_COST, LENGTH_COST * (n - LONG) / (4 * LONG))


def _asks_cost(s: str, a: int, b: int) -> float:
    """A span that opens with ¿ or ¡ closes with ? or !."""
    opening = s[a : a + 3].lstrip(_OPENERS_BUT_ASKING)[:1]
    if opening not in ("¿", "¡"):
        return 0.0
    return 0.0 if ("?" if opening == "¿" else "!") in s[max(a, b - 6) : b] else OPEN_CLOSE


def _pairs(s: str) -> list[tuple[int, int]]:
    """Quotations and brackets that open and close in a unit; marks without partner (inches, smileys, `a)`) are none.

    A straight quotation mark opens behind white space or an opening mark and closes before white space or a closing one;
    elsewhere it closes what is open. Kinds don't touch one another.
    """
    out: list[tuple[int, int]] = []
    open_: dict[str, list[int]] = {}
    for m in _BALANCE.finditer(s):
        c, at = m.group(), m.start()
        if c == '"':
            before, after = s[at - 1 : at], s[at + 1 : at + 2]
            left, right = not before or before.isspace() or before in _OPENING_MARKS, not after or after.isspace() or after in _CLOSING_MARKS
            opener = c if right and not left or left == right and open_.get(c) else None
        elif c == "“":
            opener = "„" if open_.get("„") else None
        elif c == "”":
            opener = "“" if open_.get("“") else "„"
        else:
            opener = _PAIRS.get(c)
        if opener is None:
            open_.setdefault(c, []).append(at)
        elif open_.get(opener):
            out.append((open_[opener].pop(), at))
    return out


def split_unit(s: str, words: int) -> list[tuple[int, int]]:
    """Spans of the best division of a unit; `words`: where its text begins behind a list marker.

    A cut costs UNBALANCED for every pair of marks that it leaves open, as neither span is balanced then. A state is a
    span that has begun and the score of all before it; it falls when no length and no opening can bring it past the span
    that begins here, so few are carried on.
    """
    asks = "¿" in s or "¡" in s
    most = LENGTH_COST + (OPEN_CLOSE if asks else 0.0)
    cand = _candidates(s, words)
    end = len(s)
    if cand and _BALANCE.search(s):
        ends, nexts = [x[0] for x in cand], [x[1] for x in cand]
        change = [0] * (len(cand) + 1)
        for p, q in _pairs(s):
            i, j = bisect_right(ends, p), bisect_right(nexts, q)
            if i < j:
                change[i] += 1
                change[j] -= 1
        cand = [(b, nxt, g - UNBALANCED * n) for (b, nxt, g), n in zip(cand, accumulate(change))]
    cand = [x for x in cand if x[2] >= -most]  # a cut that costs more than any length is never made
    if not cand:
        return [(0, end)]
    if not asks and all(g > 2 * LENGTH_COST for _, _, g in cand):
        return list(zip([0, *(x[1] for x in cand)], [*(x[0] for x in cand), end]))  # no length changes what these gain
    wide = WIDE if _cjk(s[cand[0][0] - 1]) or s[cand[0][0] - 1] in "。！？｡．" else 1
    starts, bounds, back = [0], [0], [0]
    states: list[tuple[float, int]] = [(0.0, 0)]
    for b, nxt, gain in [*cand, (end, end, 0.0)]:
        top, best = -1e18, -1
        for v, i in states:
            a = starts[i]
            if b <= a or v <= top:
                continue
            v -= _length_cost((b - a) * wide)
            if asks and v > top:
                v -= _asks_cost(s, a, b)
            if v > top:
                top, best = v, i
        if best < 0:
            continue
        top += gain
        starts.append(nxt)
        bounds.append(b)
        back.append(best)
        states = [x for x in states if x[0] + most >= top]
        states.append((top, len(starts) - 1))
    spans, k = [], len(starts) - 1
    while k:
        spans.append((starts[back[k]], bounds[k]))
        k = back[k]
    return spans[::-1]


def sentences(text: str | None) -> list[tuple[int, int]]:
    """Offsets (start, end) of the sentences of a text, in code points."""
    out: list[tuple[int, int]] = []
    if not text or not text.strip():
        return out
    for a, b, words, whole in units(text):
        s = text[a:b]
        for x, y in [(0, len(s))] if whole else split_unit(s, words - a):
            while x < y and s[x].isspace():
                x += 1
            while y > x and s[y - 1].isspace():
                y -= 1
            if y > x:
                out.append((a + x, a + y))
    return out


def split_sentences(docs: DataFrame, key: str = "doc_id", text: str = "text", with_text: bool = True) -> DataFrame:
    """(key, sent_no, sent_start, sent_end, sentence) for every sentence of every text; the sentence itself only if asked for."""
    kind = dict(docs.dtypes)[key]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, no, begins, ends, own = [], [], [], [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                for k, (x, y) in enumerate(sentences(t)):
                    at.append(i)
                    no.append(k)
                    begins.append(x)
                    ends.append(y)
                    if with_text:
                        own.append(t[x:y])
            cols = [b.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, pa.int64()) for c in (no, begins, ends))]
            names = [key, "sent_no", "sent_start", "sent_end"]
            if with_text:
                cols, names = [*cols, pa.array(own, pa.string())], [*names, "sentence"]
            yield pa.RecordBatch.from_arrays(cols, names)

    schema = f"`{key}` {kind}, sent_no bigint, sent_start bigint, sent_end bigint" + (", sentence string" if with_text else "")
    return docs.filter(F.col(text).isNotNull()).select(F.col(key), F.col(text)).mapInArrow(cut, schema)
