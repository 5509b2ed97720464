"""The commit graph: listing, edges, heads, ancestors, gaps and lanes (PRJ1-2, AGG3, SRT1, JOI10-11, GRA9-11, SET3)."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalist.functions.scalar import first_line, truthy
from annalist.operators.hierarchy import Forest
from annalist.operators.scan import running_sum
from annalist.session import Scratch

#: Rows of a repository's list that one task draws at a time.
RANGE = 50_000


def normalised(commits: DataFrame) -> DataFrame:
    """PRJ1, PRJ2, AGG3: each (repository, sha) once, the first delivered one, in the shape of a listing."""
    rest = ("message", "author", "commit_date", "parents", "pos")
    one = commits.filter(F.col("sha").isNotNull()).groupBy("repository_id", "sha").agg(F.min_by(F.struct(*rest), "pos").alias("c"))
    return one.select(
        "repository_id", "sha", F.substring("sha", 1, 7).alias("short_sha"), first_line(F.col("c.message")).alias("message"), truthy(F.col("c.author"), "unknown").alias("author"),
        F.col("c.commit_date").alias("commit_date"), F.coalesce("c.parents", F.array().cast("array<string>")).alias("parents"), (F.coalesce(F.size("c.parents"), F.lit(0)) > 1).alias("is_merge"), F.col("c.pos").alias("pos"),
    )


def newest_first() -> list[Column]:
    """SRT1: by the date's text, null and empty last, ties in order of discovery."""
    return [F.coalesce("commit_date", F.lit("")).desc(), F.col("pos").asc()]


def listing(scratch: Scratch, commits: DataFrame) -> DataFrame:
    """QRY5: normalised commits with `row`, their place in the repository's list; a repository of any size spreads over ranges."""
    rows = normalised(commits).withColumn("__one", F.lit(1).cast("long"))
    return running_sum(scratch, rows, ["repository_id"], newest_first(), "__one", "row").drop("__one").withColumn("row", F.col("row").cast("int"))


def parent_edges(listed: DataFrame) -> DataFrame:
    """JOI11: (repository_id, sha, parent_sha, parent_no) of parents that the repository holds; the case of digits is ignored."""
    ends = listed.select("repository_id", F.lower("sha").alias("k"), F.col("sha").alias("parent_sha"))
    edges = listed.select("repository_id", "sha", F.posexplode("parents").alias("parent_no", "p")).withColumn("k", F.lower("p"))
    return edges.join(ends, ["repository_id", "k"]).select("repository_id", "sha", "parent_sha", "parent_no")


def branch_heads(branches: DataFrame, listed: DataFrame) -> DataFrame:
    """JOI10: names of the branches whose head a commit is, in order; branches: (repository_id, name, head_sha)."""
    names = branches.filter(F.col("head_sha").isNotNull()).groupBy("repository_id", F.col("head_sha").alias("sha")).agg(F.array_join(F.array_sort(F.collect_set("name")), ",").alias("names"))
    return listed.select("repository_id", "sha").join(names, ["repository_id", "sha"])


def ancestors(scratch: Scratch, forest: Forest, edges: DataFrame, heads: DataFrame) -> DataFrame:
    """GRA9: (repository_id, head_sha, sha) of each head's ancestors, the head among them.

    forest: of first parents; edges: (repository_id, sha, parent_sha), all parents; heads: (repository_id, head_sha). A
    history is old, so it isn't walked commit by commit. What a head reaches of a segment is all from the segment's start
    to some place; a round extends such reaches over whole segments, so rounds follow how often side branches nest.
    """
    lone = forest.cyclic.select("id", F.col("id").alias("head"), F.lit(0).cast("long").alias("off"))
    names = forest.names.select("id", F.col("tree").alias("repository_id"), F.col("label").alias("sha"))
    place = scratch.cut(forest.nodes.select("id", "head", "off").unionByName(lone).join(names, "id"), "place")
    a = place.select("repository_id", "sha", "head", "off")
    b = place.select("repository_id", F.col("sha").alias("parent_sha"), F.col("head").alias("to_head"), F.col("off").alias("to_off"))
    hops = edges.join(a, ["repository_id", "sha"]).join(b, ["repository_id", "parent_sha"])
    hops = scratch.cut(hops.filter((F.col("head") != F.col("to_head")) | (F.col("off") != F.col("to_off") + 1)).select("head", "off", "to_head", "to_off"), "hops")
    start = heads.select("repository_id", F.col("head_sha").alias("sha")).join(a, ["repository_id", "sha"]).select(F.struct("repository_id", "sha").alias("src"), "head", "off")
    reach = scratch.cut(start, "reach")
    front = reach.withColumn("was", F.lit(-1).cast("long"))
    while True:
        new = front.join(hops.withColumnRenamed("off", "at"), "head").filter((F.col("at") <= F.col("off")) & (F.col("at") > F.col("was")))
        new = new.groupBy("src", F.col("to_head").alias("head")).agg(F.max("to_off").alias("off"))
        old = reach.withColumnRenamed("off", "was")
        better = new.join(old, ["src", "head"], "left").withColumn("was", F.coalesce("was", F.lit(-1))).filter(F.col("off") > F.col("was"))
        front = scratch.cut(better.select("src", "head", "off", "was"), "front")
        if front.isEmpty():
            break
        nxt = scratch.cut(reach.unionByName(front.select("src", "head", "off")).groupBy("src", "head").agg(F.max("off").alias("off")), "reach")
        scratch.drop(reach)
        reach = nxt
    rows = reach.withColumnRenamed("off", "upto").join(place, "head").filter(F.col("off") <= F.col("upto"))
    return rows.select(F.col("src.repository_id").alias("repository_id"), F.col("src.sha").alias("head_sha"), place["sha"])


def gap(listed: DataFrame, repositories: DataFrame) -> DataFrame:
    """SET3: commits after the documented head, oldest first as `step`; all of them if the head is unknown."""
    mark = repositories.select(F.col("id").alias("repository_id"), F.col("documented_head_sha").alias("sha"))
    at = listed.join(mark, ["repository_id", "sha"]).select("repository_id", F.col("row").alias("mark"))
    rows = listed.join(at, "repository_id", "left").filter(F.col("mark").isNull() | (F.col("row") < F.col("mark")))
    last = listed.groupBy("repository_id").agg(F.max("row").alias("last"))
    rows = rows.join(last, "repository_id")
    return rows.select("repository_id", "sha", (F.coalesce(F.col("mark") - 1, F.col("last")) - F.col("row")).alias("step"))


def assign_lanes(rows: list[tuple[str, list[str]]], lanes: list[str | None] | None = None) -> list[int]:
    """GRA10 over (sha, parents) newest first: the leftmost lane kept for a commit, else the first free one; the first parent inherits it, others reserve their own.

    lanes: for each lane the commit it is kept for, None if free, as the rows before have left them; it is carried on in place.
    """
    lanes = [] if lanes is None else lanes
    free = [i for i, sha in enumerate(lanes) if sha is None]
    kept: dict[str, list[int]] = {}
    for i, sha in enumerate(lanes):
        if sha is not None:
            kept.setdefault(sha, []).append(i)
    out = []

    def first_free() -> int:
        if free:
            return heapq.heappop(free)
        lanes.append(None)
        return len(lanes) - 1

    for sha, parents in rows:
        own = kept.pop(sha, None) or [first_free()]
        mine = min(own)
        for i in own:
            if i != mine:
                lanes[i] = None
                heapq.heappush(free, i)
        out.append(mine)
        lanes[mine] = parents[0] if parents else None
        if lanes[mine] is None:
            heapq.heappush(free, mine)
        else:
            kept.setdefault(lanes[mine], []).append(mine)
        for p in parents[1:]:
            if p is not None and p not in kept:
                i = first_free()
                lanes[i] = p
                kept[p] = [i]
    return out


def lanes(scratch: Scratch, listed: DataFrame, size: int = RANGE) -> DataFrame:
    """GRA10: (repository_id, row, sha, lane) of all commits.

    The order of a list decides, so its ranges of `size` rows are drawn one after another, those of all repositories at
    the same time. A range starts with the lanes that the one before has left, a row without sha and number.
    """
    cols = "repository_id bigint, row int, sha string, lane int, open array<string>"

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        before, own = pdf[pdf["row"].isna()], pdf[pdf["row"].notna()].sort_values("row")
        open_ = list(before["parents"].iloc[0]) if len(before) else []
        own = own.assign(lane=assign_lanes([(s, list(p)) for s, p in zip(own["sha"], own["parents"])], open_), open=None)
        out = own[["repository_id", "row", "sha", "lane", "open"]]
        if len(own):
            left = pd.DataFrame({"repository_id": [pdf["repository_id"].iloc[0]], "row": [None], "sha": [None], "lane": [None], "open": [open_]})
            out = pd.concat([out.astype(object), left.astype(object)])
        return out

    rows = listed.select("repository_id", "row", "sha", "parents")
    last = rows.agg(F.max("row")).first()[0] or 0
    done, left = None, None
    for at in range(0, last + 1, size):
        part = rows.filter((F.col("row") >= at) & (F.col("row") < at + size))
        given = part if left is None else part.unionByName(left)
        drawn = given.groupBy("repository_id").applyInPandas(draw, cols)
        if last >= size:
            drawn = scratch.cut(drawn, "lanes")
        left = drawn.filter(F.col("row").isNull()).select("repository_id", "row", "sha", F.col("open").alias("parents"))
        own = drawn.filter(F.col("row").isNotNull()).select("repository_id", "row", "sha", "lane")
        done = own if done is None else done.unionByName(own)
    return done
