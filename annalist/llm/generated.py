"""Problem 4: generated, minified, vendored files and data kept as code.

Every file becomes a tree: directories over files over windows of consecutive code lines. Hashes are built bottom-up
(Merkle): a window's from its lines without white space and comments, a file's from all its lines, a directory's from
its sorted children, level by level up to the repository. The copies of known libraries are trees of the same kind.

- A file is vendored if its hash, or the larger part of its windows (or of the library file's), is a library's. Altered
  copies keep most windows; a few shared lines of boilerplate stay far below.
- A file or directory whose hash occurs in repositories of different owners, or in one and in a library, is a shared
  subtree; all files below it are vendored, unless it holds less than SHARED_WINDOWS windows, which are equal by chance.
  Files without code take no part. `shared_subtrees` reports the directories.
- Generated files say so in a comment that stands before the code, in so many words at the comment's beginning, or are
  laid out as one pattern filled in again and again.
- Minified files have lines of code far longer than people write, with few blanks; bundles carry a loader's names.
- Data kept as code: most of the file, comments aside, are number lists and strings without blanks.

Config files and other extensions are no cases; neither are null, empty and blank sources. Line ends, indentation and
case of the extension don't matter. Windows are joined by hash against the library's; its size decides how Spark joins,
nothing is broadcast by hand. No stage gathers a file's pairs: counts are aggregated before they are shuffled.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.functions.lexing import Piece, language_of, scan, skeleton
from annalist.session import Scratch

#: Lines in a window, and the share of a file's (or a library file's) windows that makes a copy.
WINDOW, COPY_SHARE = 3, 0.6
#: Windows that a shared subtree holds at least.
SHARED_WINDOWS = 5
#: Share of data from which a file is data; length of a line of code that nobody writes, and the blanks it may have.
DATA_SHARE, LONG_LINE, FEW_BLANKS = 0.5, 160, 0.12

#: Lines from which repetition counts, and the share of different pairs of lines below which code is a filled-in pattern.
REPEAT_LINES, REPEAT_SHARE = 12, 0.35
_NAME = re.compile(r"[A-Za-z_$][\w$]*|\d+")

_MARK = re.compile(
    r"""^(?:code\ generated\b|@generated\b|<auto-?generated|auto-?generated\b|automatically\ generated\b|machine[- ]generated\b|generated\ (?:by|from|with|using|on|file|code|automatically)\b
    |(?:this|the)\ (?:file|code|module|source)\ (?:is|was|has\ been)\ (?:(?:auto|machine)[- ]?(?:matically)?[- ]?)?(?:generated|written|produced|created)\ (?:by|from|with|using|automatically|on)
    |this\ (?:file|code|module)\ is\ (?:auto|machine)[- ]?(?:generated|written|made)
    |do\ not\ (?:edit|modify|change)\b|don't\ edit\b|(?:datei\ |diese\ datei\ wurde\ )?automatisch\ (?:erzeugt|generiert|erstellt)|nicht\ von\ hand\ (?:ändern|bearbeiten)
    |(?:ce\ )?(?:fichier|code)\ (?:est\ |a\ été\ )?(?:produit|généré)|généré\ (?:par|automatiquement)|(?:archivo|código|fichero)\ (?:es\ |fue\ )?(?:generado|producido)|generado\ (?:por|automáticamente)|no\ (?:editar|modificar)
    |(?:gerado|generato)\ (?:por|da|automaticamente)|сгенерирован|автоматически\ с(?:генерирован|оздан)|(?:файл\ )?создан\ автоматически|(?:このファイルは)?自動生成|(?:此文件|本文件)?(?:由.{0,20})?自动生成|请勿(?:手动)?(?:修改|编辑)|編集しないで)""",
    re.I | re.X,
)
_LEAD = re.compile(r"^[\s/*#!<>=~+-]*")
_NUMBERS = re.compile(r"(?:[-+]?(?:0[xX][0-9a-fA-F]+|\d[\d._]*(?:[eE][-+]?\d+)?)[fFuUlL]*\s*,\s*){4,}")
_NOT_BLOB = re.compile(r"[^A-Za-z0-9+/=_\\\n-]")
_BUNDLE = re.compile(r"__webpack_require__|webpackJsonp|System\.register\(\[|parcelRequire|__commonJS\b")
_SPACE = re.compile(r"\s+")


def _is_mark(comment: str) -> bool:
    return any(_MARK.match(_LEAD.sub("", line)) or line.strip(" /*#!<>-").lower().startswith("auto-generated") for line in comment.split("\n"))


def _has_header(s: str, pieces: list[Piece]) -> bool:
    """A mark in the comments (or Python's leading string) before the first code."""
    pos = 0
    if s.startswith("#!"):
        pos = s.find("\n") + 1 or len(s)
    for i, p in enumerate(pieces):
        if p.end <= pos:
            continue
        if s[pos : p.start].strip():
            return False
        if p.kind == "c":
            if _is_mark(s[p.body_start : p.body_end]):
                return True
        elif not (p.kind == "s" and s[p.start : p.start + 3] in ('"""', "'''")):
            return False
        elif _is_mark(s[p.body_start : p.body_end]):
            return True
        pos = p.end
    return False


def layout_kind(path: str, source: str) -> str | None:
    """generated, minified, data or None, from the file alone."""
    lang = language_of(path)
    if lang is None or not source.strip():
        return None
    s = source.replace("\r\n", "\n").replace("\r", "\n")
    pieces = scan(lang, s)
    if _has_header(s, pieces):
        return "generated"
    comments = sum(p.end - p.start for p in pieces if p.kind == "c")
    code = skeleton(s, pieces)
    data = sum(len(m) for m in _NUMBERS.findall(code))
    for p in pieces:
        if p.kind in "st" and p.body_end - p.body_start >= 40 and not _NOT_BLOB.search(s, p.body_start, p.body_end):
            data += p.body_end - p.body_start
    if data > DATA_SHARE * max(1, len(s) - comments):
        return "data"
    lines = code.split("\n")
    long = [x for x in lines if len(x) > LONG_LINE]
    dense = sum(len(x) for x in long if sum(map(x.count, " \t")) < FEW_BLANKS * len(x))
    if dense > 0.5 * max(1, len(code.strip())) or _BUNDLE.search(code):
        return "minified"
    return "generated" if _repeats(code) else None


def _repeats(code: str) -> bool:
    """Whether code is a pattern filled in again and again: few different pairs of lines once names and numbers are blanked."""
    lines = [x for x in (_SPACE.sub(" ", line).strip() for line in _NAME.sub("w", code).split("\n")) if len(x) > 1]
    if len(lines) < REPEAT_LINES:
        return False
    return len(set(zip(lines, lines[1:]))) < REPEAT_SHARE * (len(lines) - 1)


def code_lines(path: str, source: str) -> list[str]:
    """Lines with code, without white space and comments; lone brackets and the like are left out."""
    lang = language_of(path)
    s = source.replace("\r\n", "\n").replace("\r", "\n")
    if lang:
        parts, pos = [], 0
        for p in scan(lang, s):
            if p.kind == "c":
                parts += [s[pos : p.start], "\n" if "\n" in s[p.start : p.end] else " "]
                pos = p.end
        s = "".join([*parts, s[pos:]])
    return [x for x in (_SPACE.sub("", line) for line in s.split("\n")) if len(x) > 1]


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def windows(lines: list[str]) -> list[int]:
    """Distinct hashes of runs of WINDOW lines; a shorter file is one window."""
    if not lines:
        return []
    return list({_hash("\n".join(lines[i : i + WINDOW])) for i in range(max(1, len(lines) - WINDOW + 1))})


def describe(files: DataFrame, keys: list[str], path: str, source: str) -> DataFrame:
    """(keys, path, kind, content, windows) of each file in a language: the leaves of the trees."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            kinds, contents, wins = [], [], []
            for p, s in zip(b[path], b[source]):
                lines = code_lines(p, s)
                kinds.append(layout_kind(p, s))
                contents.append(_hash("\n".join(lines)))
                wins.append(windows(lines))
            yield b[[*keys, path]].assign(kind=kinds, content=contents, windows=wins)

    rows = files.filter(F.col(source).isNotNull() & F.col(path).isNotNull()).select(*keys, path, source)
    rows = rows.filter(F.lower(path).rlike(r"\.(py|js|ts|go|java|cpp|cc|cxx|h|hpp)$"))
    types = dict(files.dtypes)
    schema = ", ".join([*(f"`{k}` {types[k]}" for k in [*keys, path]), "kind string", "content bigint", "windows array<bigint>"])
    return rows.mapInPandas(run, schema)


def find_vendored(leaves: DataFrame, library: DataFrame, scratch: Scratch) -> DataFrame:
    """(task_id, lib_file_id, share): the library file that shares most windows, where the share reaches COPY_SHARE."""
    lib = scratch.cut(library.select("lib_file_id", F.size("windows").alias("lib_n"), F.explode("windows").alias("w")), "library")
    own = leaves.select("task_id", F.size("windows").alias("n"), F.explode("windows").alias("w"))
    common = own.join(lib, "w").groupBy("task_id", "lib_file_id", "n", "lib_n").agg(F.count(F.lit(1)).alias("c"))
    share = F.greatest(F.col("c") / F.col("n"), F.col("c") / F.col("lib_n"))
    good = common.withColumn("share", share).filter(F.col("share") >= COPY_SHARE)
    best = good.groupBy("task_id").agg(F.max(F.struct("share", (-F.col("lib_file_id")).alias("neg"))).alias("b"))
    return best.select("task_id", (-F.col("b.neg")).alias("lib_file_id"), F.col("b.share").alias("share"))


def find_shared(leaves: DataFrame, library: DataFrame, owners: DataFrame | None, scratch: Scratch) -> DataFrame:
    """(task_id): files in or under subtrees that trees of different owners have in common; owners: (tree, owner) of repositories; if None, all count as one owner's.

    A library's versions are trees of one owner. Of several versions of a path one is in the tree, and only its equals are
    marked. Files climb to the directories above them by an explode, so no task holds a tree.
    """
    named = [F.col(c) for c in ("library", "lib_version") if c in library.columns]
    code = leaves.filter(F.size("windows") > 0).select("task_id", F.col("repository_id").cast("string").alias("tree"), F.col("file_path").alias("path"), "content", F.size("windows").alias("n"))
    lib = library.filter(F.size("windows") > 0).select(F.concat_ws(" ", F.lit("library"), *named).alias("tree"), F.concat_ws(" ", F.lit("library"), *named[:1]).alias("owner"), F.col("file_name").alias("path"), "content")
    own = lib.select("tree", "owner").distinct()
    of = owners.select(F.col("tree").cast("string").alias("tree"), "owner") if owners is not None else code.select("tree", F.lit("").alias("owner"))
    own = scratch.cut(own.unionByName(of.distinct()), "owners")
    files = code.select("tree", "path", "content").unionByName(lib.select("tree", "path", "content")).groupBy("tree", "path").agg(F.max("content").alias("content"))
    files = scratch.cut(files, "files")
    nodes = files.select("tree", F.col("path").alias("dir"), F.col("content").alias("hash"), F.lit(1).cast("long").alias("files"))
    alike = scratch.cut(shared_subtrees(nodes, own).select(F.col("hash").alias("content")), "alike")
    single = code.filter(F.col("n") >= SHARED_WINDOWS).join(alike, "content", "left_semi").select("task_id")
    dirs = scratch.cut(merkle_directories(files, scratch), "dirs")
    shared = scratch.cut(dirs.join(shared_subtrees(dirs, own).select("hash"), "hash", "left_semi").select("tree", "dir").distinct(), "shared")
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    below = code.join(files, ["tree", "path", "content"], "left_semi").select("task_id", "tree", "path", "n", F.explode(above).alias("dir")).join(shared, ["tree", "dir"])
    below = scratch.cut(below, "below")
    once = below.groupBy("tree", "dir", "path").agg(F.max("n").alias("n"))
    much = once.groupBy("tree", "dir").agg(F.sum("n").alias("n")).filter(F.col("n") >= SHARED_WINDOWS)
    return below.join(much.select("tree", "dir"), ["tree", "dir"], "left_semi").select("task_id").unionByName(single).distinct()


def not_hand_written(tasks: DataFrame, library: DataFrame, scratch: Scratch, owners: DataFrame | None = None) -> DataFrame:
    """(task_id, repository_id, file_path, reason, lib_file_id, share); reason null: hand-written. Files in no language are left out. owners: as in `find_shared`."""
    leaves = scratch.cut(describe(tasks, ["task_id", "repository_id"], "file_path", "source"), "leaves")
    lib = scratch.cut(describe(library, ["lib_file_id", *(c for c in ("library", "lib_version") if c in library.columns)], "file_name", "source"), "library_leaves")
    found = find_vendored(leaves, lib, scratch)
    shared = find_shared(leaves, lib, owners, scratch).withColumn("shared", F.lit(True))
    rows = leaves.select("task_id", "repository_id", "file_path", "kind").join(found, "task_id", "left").join(shared, "task_id", "left")
    reason = F.when(F.col("lib_file_id").isNotNull() | F.col("shared"), F.lit("vendored")).otherwise(F.col("kind"))
    return rows.select("task_id", "repository_id", "file_path", reason.alias("reason"), "lib_file_id", "share")


def merkle_directories(leaves: DataFrame, scratch: Scratch) -> DataFrame:
    """(tree, dir, hash, files): every directory of every tree; leaves: (tree, path, content). One aggregation per level.

    Children are combined as a sum over hashes of (name, hash), which is independent of order and pre-aggregated before
    the shuffle, so a directory of any number of files is no burden to a task.
    """
    rows = leaves.groupBy("tree", "path").agg(F.max("content").alias("h"))
    parts = F.split("path", "/")
    rows = rows.select("tree", F.col("path").alias("at"), F.size(parts).alias("level"), "h", F.lit(1).cast("long").alias("files"))
    pending = scratch.cut(rows, "nodes")
    deepest = pending.agg(F.max("level")).first()[0] or 0
    done = None
    for level in range(deepest, 0, -1):
        here = pending.filter(F.col("level") == level) if done is None else pending.filter(F.col("level") == level).unionByName(done.filter(F.col("level") == level))
        cut = F.length("at") - F.length(F.substring_index("at", "/", -1)) - 1
        up = here.select("tree", F.expr("substring(`at`, 1, length(`at`) - length(substring_index(`at`, '/', -1)) - 1)").alias("dir"), F.xxhash64(F.substring_index("at", "/", -1), "h").alias("c"), "files")
        made = up.groupBy("tree", "dir").agg(F.xxhash64(F.sum(F.col("c").cast("decimal(38,0)")), F.count(F.lit(1))).alias("h"), F.sum("files").alias("files"))
        made = scratch.cut(made.select("tree", F.col("dir").alias("at"), F.lit(level - 1).alias("level"), "h", "files"), f"level{level}")
        done = made if done is None else done.unionByName(made)
    if done is None:
        return pending.limit(0).select("tree", F.col("at").alias("dir"), F.col("h").alias("hash"), "files")
    return done.select("tree", F.col("at").alias("dir"), F.col("h").alias("hash"), "files")


def shared_subtrees(directories: DataFrame, owners: DataFrame, least: int = 2) -> DataFrame:
    """(hash, trees, owners, files, example): directory hashes that occur in trees of at least `least` owners; owners: (tree, owner)."""
    j = directories.join(owners, "tree", "left").withColumn("owner", F.coalesce("owner", F.col("tree").cast("string")))
    per = j.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("n"), F.max("files").alias("files"), F.min("dir").alias("example"))
    out = per.groupBy("hash").agg(F.sum("n").alias("trees"), F.count(F.lit(1)).alias("owners"), F.max("files").alias("files"), F.min("example").alias("example"))
    return out.filter(F.col("owners") >= least)
