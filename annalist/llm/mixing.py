"""Problem 9: sources mixed to target shares of the total tokens.

Hash-threshold histograms: each record has a hash; tokens are summed by source and hash bucket, the budget of a source
ends in one bucket, and only that bucket, written once, is refined by the next bits of the hash, until one record is left
in it. What lies below the threshold is chosen by a filter; nothing is sorted. As thresholds grow with the budget,
smaller budgets choose subsets of larger ones, unless a record is passed over.

The record on the threshold is taken if the budget is passed by MISSING of it at most, and left out if no more than that
stays open. A record too large for either is passed over and the threshold moves on behind it, so one long text doesn't
spoil a small source's share; the choice is then a few ranges of hashes. With many records none is so large.

The total is as large as the scarcest source allows at its most repeats, or a given number of tokens if that is less. A
source whose budget exceeds its tokens is repeated in whole; the threshold decides who is used once more. Sums are
partial before the shuffle, whatever a source's share of the rows; the driver and broadcasts see one row per source and
bucket at most, and sources are those of the targets (MOST_SOURCES at most).

Cases: sources match by trimmed lower case; null sources, and sources without target, take no part and are reported with
target 0; a source with a target but no tokens is left out of the total's bound and reported with share 0; records
without tokens are never chosen; records of one id have one hash, so they stand or fall together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.llm.tokens import VOCABULARY, token_count
from annalist.session import Scratch

BITS = 10
#: Share of a budget that may stay open before a record is passed over.
MISSING = 0.005
MOST_SOURCES = 10_000


def sized(docs: DataFrame, path: str = VOCABULARY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, source, tokens, h): h is a hash without sign, of 63 bits."""
    n = token_count(text, path)
    return docs.select(F.col(key).alias("id"), F.lower(F.trim("source")).alias("source"), n.alias("tokens"), F.shiftrightunsigned(F.xxhash64(F.col(key).cast("string"), F.lit("mix")), 1).alias("h"))


def plan(totals: list[tuple[str, int]], targets: list[tuple[str, float, int]], total: int | None = None) -> dict[str, tuple[int, float, float, int]]:
    """source -> (full rounds, tokens of the last round, target share, tokens there are)."""
    have = dict(totals)
    active = {s: (w, r) for s, w, r in targets if w > 0 and r > 0 and have.get(s, 0) > 0}
    if not active:
        return {}
    most = min(have[s] * r / w for s, (w, r) in active.items())
    size = most if total is None else min(float(total), most)
    out = {}
    for s, (w, r) in active.items():
        need = min(w * size, float(have[s]) * r)
        full = min(r, int(need / have[s] + 1e-9))
        out[s] = (full, max(0.0, need - full * have[s]) if full < r else 0.0, w, have[s])
    return out


class _Cut:
    """The search of one source's ranges of hashes, level by level."""

    def __init__(self, budget: float):
        self.left, self.open, self.begin = budget, MISSING * budget, 0
        self.ranges: list[tuple[int, int]] = []
        self.levels: list[tuple[int, list[tuple[int, int, int, int]]]] = []  # shift and the buckets still to come (number, tokens, least record, whether one hash), last level last

    def _end(self, at: int) -> None:
        if at > self.begin:
            self.ranges.append((self.begin, at))

    def go_on(self) -> tuple[int, int] | None:
        """Takes buckets while they fit; the bucket (number, shift) to refine next, or None at the end."""
        while self.levels:
            shift, rest = self.levels[-1]
            if not rest:
                self.levels.pop()
                continue
            b, t, least, one = rest.pop(0)
            if self.left >= t:
                self.left -= t
            elif not one and shift and least <= self.left + self.open:
                return b, shift
            elif one and t <= self.left + self.open:
                self._end(b + 1 << shift)
                return None
            else:  # nothing in it fits
                self._end(b << shift)
                if self.left <= self.open:
                    return None
                self.begin = b + 1 << shift
        self._end(1 << 63)
        return None


def thresholds(scratch: Scratch, rows: DataFrame, budgets: dict[str, float]) -> dict[str, list[tuple[int, int]]]:
    """source -> ranges (from, below) of hashes whose records are within the budget, to MISSING of it where records allow.

    rows: (id, source, tokens, h). Each round sums one level of the boundary buckets, by source and next bits; from the
    second on it reads these buckets only.
    """
    spark = scratch.spark
    cuts = {s: _Cut(b) for s, b in budgets.items()}
    asked = {s: (0, 63) for s, b in budgets.items() if b > 0}
    while asked:
        small = spark.createDataFrame([(s, p, low, low - min(BITS, low)) for s, (p, low) in asked.items()], "source string, prefix bigint, low int, shift int")
        inside = rows.join(F.broadcast(small), "source").filter(F.expr("low = 63 or shiftright(h, low) = prefix"))
        if any(low < 63 for _, low in asked.values()):
            inside = scratch.cut(inside, "boundary")
        hist = inside.groupBy("source", "low", F.expr("shiftright(h, shift)").alias("bucket")).agg(F.sum("tokens").alias("t"), F.min("tokens").alias("least"), F.min("h").alias("a"), F.max("h").alias("b"))
        by: dict[str, list] = {}
        for r in hist.collect():  # at most 2**BITS rows a source
            by.setdefault(r["source"], []).append((r["bucket"], r["t"], r["least"], r["a"] == r["b"]))
        nxt = {}
        for s, (_, low) in asked.items():
            cuts[s].levels.append((low - min(BITS, low), sorted(by.get(s, []))))
            more = cuts[s].go_on()
            if more:
                nxt[s] = more
        asked = nxt
    return {s: c.ranges for s, c in cuts.items()}


def mix(scratch: Scratch, docs: DataFrame, targets: list[tuple[str, float, int]], total: int | None = None, path: str = VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """(chosen, report): chosen (doc_id, source, tokens, repeats); report (source, target_share, records, tokens, share, most_repeats)."""
    if len(targets) > MOST_SOURCES:
        raise ValueError("too many sources")
    targets = [(s.strip().lower(), w, r) for s, w, r in targets]
    rows = scratch.cut(sized(docs, path), "sized")
    used = rows.filter(F.col("source").isin([s for s, _, _ in targets]) & (F.col("tokens") > 0))
    totals = [(r[0], r[1]) for r in used.groupBy("source").agg(F.sum("tokens")).collect()]
    goal = plan(totals, targets, total)
    cut = thresholds(scratch, used, {s: g[1] for s, g in goal.items()})
    ranges = [(s, g[0], [(a, min(b, (1 << 63) - 1), b >> 63 == 1) for a, b in cut[s]]) for s, g in goal.items()]
    small = scratch.spark.createDataFrame(ranges, "source string, rounds int, ranges array<struct<first:bigint,below:bigint,everything:boolean>>")
    within = F.exists("ranges", lambda r: (F.col("h") >= r["first"]) & (r["everything"] | (F.col("h") < r["below"])))
    chosen = used.join(F.broadcast(small), "source").withColumn("repeats", F.col("rounds") + within.cast("int"))
    chosen = chosen.filter(F.col("repeats") > 0).select(F.col("id").alias("doc_id"), "source", "tokens", "repeats")
    want = scratch.spark.createDataFrame([(s, float(w)) for s, w, _ in targets], "source string, target_share double")
    got = chosen.groupBy("source").agg(F.count(F.lit(1)).alias("records"), F.sum(F.col("tokens") * F.col("repeats")).alias("tokens"), F.max("repeats").alias("most_repeats"))
    seen = rows.groupBy("source").agg(F.sum("tokens").alias("available"))
    all_ = got.agg(F.sum("tokens").alias("all"))
    report = seen.join(want, "source", "full_outer").join(got, "source", "left").join(F.broadcast(all_), how="left")
    report = report.select(
        "source", F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.coalesce("available", F.lit(0)).alias("available"), F.coalesce("records", F.lit(0)).alias("records"),
        F.coalesce("tokens", F.lit(0)).alias("tokens"), F.round(F.coalesce(F.col("tokens") / F.col("all"), F.lit(0.0)), 6).alias("share"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"),
    )
    return chosen, report
