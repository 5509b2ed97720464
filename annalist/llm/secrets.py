"""Problem 5: credentials embedded in source code, configuration and documentation.

A text is split lexically: literals, comments and code for source files, keys and values for configuration, plain text
for the rest. A literal is a credential if it is assigned or passed to an identifier named like one and is no
placeholder; comments, strings and prose are read for the forms credentials take by themselves: private keys, user info
of URLs, authorization headers, query parameters, tokens of known formats, and `name=value`. What is found is the
literal's content as written. `mask` replaces just that, and leaves delimiters, escapes and line breaks as they stand.

Not flagged: placeholders, references to variables, vaults or the environment, hashes and checksums, public keys and
certificates, values that are plainly something else (addresses, paths, numbers, flags, sentences, and plain words
unless a password's name asks for them).
Cases: null and empty texts hold nothing; a row's equal credentials are one; texts may be of any length and are read
whole. One pass within the scan's tasks; a filter on names and signs of credentials runs before Python is reached.
"""

from __future__ import annotations

import base64
import binascii
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalist.functions.lexing import language_of, scan

_PEM = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----(?:(?!-----BEGIN)[\s\S])*?-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_URL = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*://[^\s:/@\"'`<>]*:([^\s@/\"'`]+)@[\w.\[-]")
_SCHEME = re.compile(r"\b(bearer|basic|token)[ \t]+([A-Za-z0-9_\-.~+/:]{8,}=*)", re.I)
_PARAM_WORDS = "token|key|secret|password|passwd|pwd|auth|sig|signature"
_PARAM = re.compile(rf"[?&;](?:[\w-]*(?:{_PARAM_WORDS}))=([^&\s\"'`<>#)\]]+)", re.I)
#: Formats of widely used tokens.
_KNOWN = re.compile(
    r"(?<![A-Za-z0-9_])(?:(?:AKIA|ASIA)[0-9A-Z]{16}(?![A-Za-z0-9_])|gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9_])|github_pat_[A-Za-z0-9_]{40,}|(?:sk|rk)_live_[A-Za-z0-9]{16,}|xox[abprs]-[A-Za-z0-9-]{10,}[A-Za-z0-9]"
    r"|AIza[A-Za-z0-9_\-]{35}|glpat-[A-Za-z0-9_\-]{20}|SG\.[A-Za-z0-9_\-]{16,}\.[A-Za-z0-9_\-]{16,}|eyJ[A-Za-z0-9_\-]{10,}\.[A-Za-z0-9_\-]{10,}\.[A-Za-z0-9_\-]{5,})"
)
_PAIR = re.compile(r"(?<![\w$.-])([A-Za-z_][\w.\-]*)[\"'`]?[ \t]*(?:=(?![=>~])|:(?![:=/]))[ \t]*(?:\"([^\"\n]*)\"|'([^'\n]*)'|`([^`\n]*)`|([^\s\"'`,;<>()\[\]{}&|][^\s\"'`,;<>()\[\]{}&|]*))")
_IS_WORDS = "pass(?:word|phrase|wd|code)?|pwd|secret|token|(?:api|access|secret) ?key|key|credential|passwort|kennwort|contraseña|mot de passe"
_IS = re.compile(rf"\b({_IS_WORDS})s?(?:[ \t]+(?:is|was|to|ist|es|est|lautet))?[ \t:]+(?:\"([^\"\s]+)\"|'([^'\s]+)'|`([^`\s]+)`)", re.I)
_CLI_WORDS = "password|passwd|pass|token|secret|api-?key|apikey"
_CLI = re.compile(rf"(?<!\S)--?((?:[\w-]*-)?(?:{_CLI_WORDS}))[ =][\"']?([^\s\"'`]+)", re.I)
_USER = re.compile(r"(?<!\S)-u[ \t]+[\"']?[\w.@-]+:([^\s\"'`]+)")

#: Words of identifiers. A strong word names a credential; a weak one does for values that look random.
_STRONG = set("password passwd pwd passphrase passwort kennwort contrasena contraseña clave senha secret apikey credential credentials cred creds bearer jeton schluessel schlüssel pw passcode pass".split())
#: Of these even a plain word, or several, is the value.
_PASSWORDS = set("password passwd pwd passphrase passwort kennwort contrasena contraseña senha passcode passe".split())
_WEAK = set("token tokens auth authorization key pat".split())
_KEY_OF = set("api access secret private signing session encryption auth master client shared service account storage license".split())
_TOKEN_OF = set("access auth refresh api bearer session bot deploy id oauth".split())
_LATER = set("old new tmp prod dev test staging backup default current value".split())
#: Words that, after a credential's name, make it something else.
_NOT = set(
    "hash hashes sha sha1 sha256 sha512 md5 digest checksum label labels name url uri path file dir id ids len length size type types count prefix suffix hint prompt policy field fields expiry expires expiration ttl timeout header message msg error text title "
    "help doc docs description format pattern regex public pem cert certificate fingerprint etag env var variable ref vault min max limit enabled required rotation days age column index param params parameter placeholder example".split()
)
#: Words given to a password's name that are none: kinds, states and parts of sentences.
_NO_PASSWORD = set(
    "a an and any are ask be bearer bool boolean can cannot char confirm confirmed current digest disabled do does empty enabled enter env environment error expired failed false field file for forgot forgotten form from hidden in incorrect input invalid is it "
    "keychain keyring label ldap length login manual match mismatch missing must new no none not null object of old on optional or password passwords plain please prompt protected reset required same secret set should show simple static stdin string strong text the this to true "
    "type undefined unset username user value varchar vault visible was weak with wrong your".split()
)
_PHRASE = re.compile(r"[a-zäöüßñ]{5,}|[a-zäöüßñ0-9]+(?: [a-zäöüßñ0-9]+){2,}")
_WORDS = re.compile(r"[A-ZÄÖÜ]+(?=[A-ZÄÖÜ][a-zäöüßñ])|[A-ZÄÖÜ]?[a-zäöüßñ]+\d*|[A-ZÄÖÜ]+\d*|\d+")

_PLACEHOLDER = re.compile(
    r"""^(?:|change[-_ ]?(?:me|it|this)|todo|tbd|fixme|none|null|nil|undefined|n/?a|empty|dummy|fake|test|example|sample|placeholder|redacted|removed|hidden|masked|default|secret|password|passwd|token|key|apikey|api[-_]key|value|string|str|bytes?|true|false|yes|no|on|off|required|optional
    |x{3,}|X{3,}|\*+|\.+|-+|_+|0+|#+|\?+|<.*>?|\[.*\]|\{.*\}|\(.*\)|%.*%|\$.*|@.*@|(?:your|my|the|insert|enter|replace|put|some|set)[-_ .].*|replace.*|.*_here|.*-here|.*placeholder.*|.*(?:example|dummy|changeme).*
    |(?:vault|env|ref|secret|secrets|ssm|arn|op|kms|file|keyring|keychain|gcp-?sm|aws-?sm|azkv|sops|enc|cipher|bws|doppler|consul|config|var|data|local|module)[:!].*|ref\+.*|ENC\[.*|ENC\(.*|!(?:Ref|Sub|vault|env|secret).*)$""",
    re.I | re.X,
)
_INNER_PLACEHOLDER = re.compile(r"\$\{|\{\{|\}\}|\$\(|<[A-Za-z][\w -]*>|%\(|^%[sdv]$|(?:^|[:/@=])%[sdv](?:$|[:/@&])|x{6,}|X{6,}|\*{4,}|\{\w*\}|\$[A-Z_]{3,}|#\{")
_REFERENCE = re.compile(r"^(?:os\.|process\.|env\.|config\.|settings\.|self\.|this\.|System\.|secrets\.|vars\.|ctx\.|params\.|args\.|conf\.|app\.|viper\.|getenv)|^[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+$|^[a-z]+(?:\.[a-z_]+)+$|\w\($")
_OTHER = re.compile(r"^(?:[-+]?[\d.,:]+(?:ms|s|m|h|d|kb|mb|gb|%)?|[a-z][a-z0-9+.-]*://\S*|[./~][\w./-]*|[A-Za-z]:\\.*|[a-z]+(?:[-_/.: ][a-z]+)*|[A-Z][a-z]+|[A-Z]+|data:.*)$")
_TOKENISH = re.compile(r"^[A-Za-z0-9_\-.~+/:=|]{16,}$")
_UUID = re.compile(r"^[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$")


def _words_sign() -> str:
    """What an identifier contains that has one of the words above, written as _WORDS takes words: small, capitalised or in capitals."""
    words = sorted(_STRONG | _WEAK | {"keys", "passe"})
    small, cap, upper = ("|".join(f(w) for w in words) for f in (str, str.capitalize, str.upper))
    starts = ["".join(sorted({f(w)[0] for w in words})) for f in (str, str.upper)]
    lower, capitals = "a-zäöüßñ", "A-ZÄÖÜ"
    return (
        f"(?<![{lower}{capitals}])(?=[{starts[0]}])(?:{small})(?![{lower}])"
        f"|(?=[{starts[1]}])(?:(?:{cap})(?![{lower}])|(?<![{capitals}])(?:{upper})(?![{lower}]|[{capitals}](?![{lower}])))"
    )


def _any(words: str) -> str:
    """The alternatives behind a look at their first letters, which spares trying each at every place."""
    return f"(?=[{''.join(sorted(set(re.findall(r'(?:^|[|(:])([a-z])', words))))}])(?:{words})"


#: What every text with a credential contains, from the detectors' own words and forms, for Java's and Python's regular expressions.
SIGN = (
    rf"{_words_sign()}|PRIVATE KEY|://[^\s/@]*:[^\s/@]+@|AKIA|ASIA|gh[pousr]_|github_pat_|[sr]k_live_|xox[abprs]-|AIza|glpat-|SG\.[A-Za-z0-9_\-]|eyJ|-u[ \t]+[^\s:]+:"
    rf"|(?iu:{_any(_PARAM_WORDS)}=|\b{_any('bearer|basic|token')}[ \t]|\b{_any(_IS_WORDS)}s?[ \t:]|-(?:{_CLI_WORDS})[ =])"
)
_SIGN = re.compile(SIGN)


def name_strength(name: str) -> int:
    """2: names a credential; 1: may; 0: doesn't. The identifier is read word by word."""
    words = [w.lower() for w in _WORDS.findall(name)]
    if not words:
        return 0
    plain = [w.rstrip("0123456789") or w for w in words]
    best = 0
    for i, w in enumerate(plain):
        before = plain[i - 1] if i else ""
        if w in _STRONG and not (w == "pass" and i + 1 < len(plain)) and not (w == "clave" and len(plain) == 1):
            k = 2
        elif w in ("key", "keys") and before in _KEY_OF or w == "passe" and plain[i - 2 : i] == ["mot", "de"] or w == "token" and before in _TOKEN_OF:
            k = 2
        elif w in _WEAK and before != "public" and all(x in _LATER for x in plain[i + 1 :]):
            k = 1
        else:
            continue
        if not any(x in _NOT or y in _NOT for x, y in zip(words[i + 1 :], plain[i + 1 :])):
            best = max(best, k)
    return best


def is_placeholder(value: str) -> bool:
    v = value.strip()
    return bool(_PLACEHOLDER.match(v) or _INNER_PLACEHOLDER.search(v) or _REFERENCE.search(v)) or len(set(v)) <= 2


def looks_random(value: str) -> bool:
    """Long, without blanks, with letters and digits: what tokens look like."""
    if not _TOKENISH.match(value) or "://" in value:
        return False
    return bool(_UUID.match(value)) or ((any(c.isdigit() for c in value) or re.search(r"[a-z][A-Z]{2,}", value)) and any(c.isalpha() for c in value) and len(set(value)) >= 8 and not re.match(r"^[a-z]+(?:[-_./:][a-z]+)*[-_./:]?\d{0,4}$", value))


def is_phrase(value: str, name: str) -> bool:
    """Whether plain words are the password that the name asks for: one or several in lower case, none of which says what it is or isn't."""
    if not _PHRASE.fullmatch(value) or is_placeholder(value) or _NO_PASSWORD.intersection(value.split()):
        return False
    return any(w.lower().rstrip("0123456789") in _PASSWORDS for w in _WORDS.findall(name)) and name_strength(name) == 2


def is_value(value: str, strength: int) -> bool:
    """Whether a value given to a name of this strength is a usable credential."""
    if strength == 0 or len(value) < 4 or len(value) == 4 and (strength < 2 or value.isalnum() and (value.isalpha() or value.isdigit())):
        return False
    if any(c.isspace() for c in value) or is_placeholder(value) or _OTHER.match(value) or "-----BEGIN" in value:
        return False
    return strength == 2 or looks_random(value)


def _basic(pair: str) -> bool:
    try:
        return b":" in base64.b64decode(pair + "=" * (-len(pair) % 4), validate=True)
    except (binascii.Error, ValueError):
        return False


def _plain_text(s: str, out: list[tuple[int, int]], base: int = 0, prose: bool = True) -> None:
    """Credentials that show themselves by form or by a name written before them."""
    for m in _PEM.finditer(s):
        if len(re.sub(r"\\[nr]|[^A-Za-z0-9+/]", "", m.group())) >= 80 and not _INNER_PLACEHOLDER.search(m.group()):
            out.append((base + m.start(), base + m.end()))
    if "://" in s:
        for m in _URL.finditer(s):
            if not is_placeholder(m.group(1)) and m.group(1).lower() not in ("pass", "pw", "password"):
                out.append((base + m.start(1), base + m.end(1)))
    for m in _PARAM.finditer(s):
        v = m.group(1)
        if looks_random(v) and not is_placeholder(v) or _KNOWN.match(v):
            out.append((base + m.start(1), base + m.end(1)))
    for m in _SCHEME.finditer(s):
        kind, v = m.group(1).lower(), m.group(2)
        end = m.end(2)
        v2 = v.rstrip(".:")
        end -= len(v) - len(v2)
        if kind == "basic" and _basic(v2) or kind != "basic" and looks_random(v2) and not is_placeholder(v2):
            out.append((base + m.start(2), base + end))
    for m in _KNOWN.finditer(s):
        if not _INNER_PLACEHOLDER.search(m.group()):
            out.append((base + m.start(), base + m.end()))
    if "=" in s or ":" in s:
        for m in _PAIR.finditer(s):
            k = name_strength(m.group(1))
            if k:
                g = next(i for i in (2, 3, 4, 5) if m.group(i) is not None)
                v = m.group(g)
                if g == 5:
                    v = v.rstrip(".")
                if v and (is_value(v, k) or g != 5 and is_phrase(v, m.group(1))):
                    out.append((base + m.start(g), base + m.start(g) + len(v)))
    if prose:
        for m in _IS.finditer(s):
            g = next(i for i in (2, 3, 4) if m.group(i) is not None)
            if is_value(m.group(g), name_strength(m.group(1).replace(" ", "_")) or 1):
                out.append((base + m.start(g), base + m.end(g)))
        for m in _CLI.finditer(s):
            if is_value(m.group(2), 2):
                out.append((base + m.start(2), base + m.end(2)))
        for m in _USER.finditer(s):
            if is_value(m.group(1), 2):
                out.append((base + m.start(1), base + m.end(1)))


_BEFORE = re.compile(r"([A-Za-z_$][\w$.\-]*)[\"'`]?\s*(?:\[[^\]]*\])?\s*(?:\?|!)?\s*(?::\s*[A-Za-z_][\w.<>\[\]| ]*?\s*=|:=|=|:|=>|,|\()\s*(?:(?:new\s+)?[A-Za-z_][\w:.]*\(\s*)?[({\[]?\s*[rbfuLR]{0,2}\Z")
_SUBSCRIPT = re.compile(r"\[\s*[\"']([\w.\-]+)[\"']\s*\]\s*=\s*[rbfu]{0,2}\Z")
_COMPARED = re.compile(r"[=!<>]=\s*[rbfuLR]{0,2}\Z")


#: Code points before a literal in which its name stands, white space not counted.
NAME_WITHIN = 120


def _before(s: str, at: int) -> str:
    """The code before a place, as far back as its name may stand; white space is no distance."""
    n = NAME_WITHIN
    got = s[max(0, at - n) : at]
    while n < at and len(got.strip()) < NAME_WITHIN // 2:
        n *= 2
        got = s[max(0, at - n) : at]
    return got


def _code(lang: str, s: str, out: list[tuple[int, int]]) -> None:
    left = -1  # where the comments right before the literal begin
    for p in scan(lang, s):
        a, b = p.body_start, p.body_end
        if p.kind == "c":
            left = left if left >= 0 and not s[end : p.start].strip() else p.start
            end = p.end
            if b - a >= 5 and _SIGN.search(s, a, b):
                _plain_text(s[a:b], out, a)
            continue
        at, left = (left if left >= 0 and not s[end : p.start].strip() else p.start), -1
        if b - a < 4 or p.kind == "r":
            continue
        body = s[a:b]
        if "\n" not in body and (" " not in body or _PHRASE.fullmatch(body)):
            before = _before(s, at)
            if not _COMPARED.search(before):
                m = _SUBSCRIPT.search(before) or _BEFORE.search(before)
                name = m.group(1).split(".")[-1] if m else ""
                if m and (is_value(body, name_strength(name)) or is_phrase(body, name) and not m.group().rstrip().endswith((",", "("))):
                    out.append((a, b))
                    continue
        if _SIGN.search(body):
            _plain_text(body, out, a, prose=False)


_CONFIG = re.compile(
    r"^[ \t]*(?:-[ \t]+)?(?:export[ \t]+|set[ \t]+)?[\"']?([A-Za-z_][\w.\- ]*?)[\"']?[ \t]*[:=][ \t]*(?:\"((?:[^\"\\\n]|\\.)*)\"|'((?:[^'\n]|'')*)'|([^\s\"'#;][^\n]*?))[ \t]*,?[ \t]*(?:[ \t][#;][^\n]*)?\r?$",
    re.M,
)


def _config(s: str, out: list[tuple[int, int]]) -> None:
    for m in _CONFIG.finditer(s):
        k = name_strength(m.group(1))
        if k:
            g = next(i for i in (2, 3, 4) if m.group(i) is not None)
            v = m.group(g)
            if g == 4:
                v = re.split(r"[ \t]+[#;]", v)[0].rstrip(", \t")
            if is_value(v, k) or is_phrase(v, m.group(1)):
                out.append((m.start(g), m.start(g) + len(v)))
    _plain_text(s, out)


def find(text: str | None, path: str | None) -> list[tuple[int, int]]:
    """Spans of the credentials in a text, outermost only, in order. path None: plain text."""
    if not text or not _SIGN.search(text):
        return []
    out: list[tuple[int, int]] = []
    lang = language_of(path)
    if lang:
        _code(lang, text, out)
    elif path is not None and "." in path.rsplit("/", 1)[-1]:
        _config(text, out)
    else:
        _plain_text(text, out)
    kept: list[tuple[int, int]] = []
    for a, b in sorted(set(out), key=lambda x: (x[0], -x[1])):
        if not kept or b > kept[-1][1]:
            kept.append((a, b))
    return kept


_KEEP = re.compile(r"\\(?:u[0-9a-fA-F]{4}|x[0-9a-fA-F]{2}|\r\n|.|\n)|\s+")


def mask(text: str | None, path: str | None) -> str | None:
    """The text with every character of its credentials as x, but for escapes and white space."""
    spans = find(text, path)
    if not spans:
        return text
    parts, pos = [], 0
    for a, b in spans:
        parts.append(text[pos:a])
        inner, at = [], a
        for m in _KEEP.finditer(text, a, b):
            inner += ["x" * (m.start() - at), m.group()]
            at = m.end()
        parts += [*inner, "x" * (b - at)]
        pos = b
    return "".join([*parts, text[pos:]])


def may_hold(text: str) -> Column:
    return F.col(text).isNotNull() & F.col(text).rlike(SIGN)


def find_secrets(rows: DataFrame, origin: str, row_id: str, text: str, path: str | None = None) -> DataFrame:
    """(origin, row_id, secret): each distinct credential of each row. path: column of the text's file name, None for prose."""

    @F.pandas_udf("array<string>")
    def secrets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series([list(dict.fromkeys(t[x:y] for x, y in find(t, p))) for t, p in zip(b["text"], b["path"])])

    given = F.struct(F.col(text).alias("text"), (F.col(path) if path else F.lit(None).cast("string")).alias("path"))
    some = rows.filter(may_hold(text)).select(F.col(row_id).alias("row_id"), secrets(given).alias("s"))
    return some.select(F.lit(origin).alias("origin"), "row_id", F.explode("s").alias("secret"))


def redact(rows: DataFrame, text: str, path: str | None = None) -> DataFrame:
    """The rows with credentials masked in `text`; column `redacted`, in the place of one of this name, tells whether anything was."""

    @F.pandas_udf("string")
    def masked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series([mask(t, p) for t, p in zip(b["text"], b["path"])], dtype=object)

    # a function of Python's is called for every row, so texts that hold nothing don't go there
    given = F.struct(F.when(may_hold(text), F.col(text)).alias("text"), (F.col(path) if path else F.lit(None).cast("string")).alias("path"))
    out = rows.withColumn("__new", F.coalesce(masked(given), F.col(text)))
    return out.withColumn("redacted", ~F.col("__new").eqNullSafe(F.col(text))).withColumn(text, F.col("__new")).drop("__new")
