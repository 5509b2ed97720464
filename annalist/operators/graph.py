"""Cycles condensed and the order of what is left (GRA3-8, SCH1).

Components are found by colouring: every node takes the largest number that reaches it, and within a colour those that
reach the number's own node form its component. Components leave, the rest is coloured again. Levels are peeled: a
component's level is one above its highest dependency's. Each round is a join of edges with a table in the shared
folder, so graphs of any size pass; rounds follow the longest path, which in call graphs is short.

A graph of up to SMALL rows, which are counted first, is as large as one changeset; it is worked on in one task by linear
algorithms, with the same results.

Tables: nodes (n bigint), edges (n, dep) meaning n depends on dep. Self edges, repeated edges and edges of unknown nodes
are ignored; an empty graph has no components.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.session import Scratch

#: Rows of nodes and edges that one task may take.
SMALL = 200_000


def _spread(scratch: Scratch, start: DataFrame, edges: DataFrame, within: bool) -> DataFrame:
    """Carries the largest colour along edges (a -> b) until nothing changes. start: (n, c); within: only where b's colour is the same already."""
    now = start
    while True:
        sent = now.select(F.col("n").alias("a"), "c").join(edges, "a").groupBy(F.col("b").alias("n")).agg(F.max("c").alias("got"))
        moved = now.join(sent, "n", "left").select("n", F.greatest("c", F.coalesce("got", F.col("c"))).alias("c"), (F.coalesce("got", F.col("c")) > F.col("c")).alias("up"))
        nxt = scratch.cut(moved, "colour")
        more = not nxt.filter("up").isEmpty()
        scratch.drop(now)
        now = nxt.select("n", "c")
        now._scratch_path = nxt._scratch_path
        if not more:
            return now


def tarjan(nodes: list[int], edges: list[tuple[int, int]]) -> dict[int, int]:
    """node -> smallest node of its component, without recursion."""
    to: dict[int, list[int]] = {n: [] for n in nodes}
    for a, b in edges:
        if a in to and b in to:
            to[a].append(b)
    index: dict[int, int] = {}
    low: dict[int, int] = {}
    out: dict[int, int] = {}
    path: list[int] = []
    place: dict[int, int] = {}
    for root in to:
        if root in index:
            continue
        work = [(root, iter(to[root]))]
        index[root] = low[root] = len(index)
        place[root] = len(path)
        path.append(root)
        while work:
            n, rest = work[-1]
            for m in rest:
                if m not in index:
                    index[m] = low[m] = len(index)
                    place[m] = len(path)
                    path.append(m)
                    work.append((m, iter(to[m])))
                    break
                if m not in out:
                    low[n] = min(low[n], index[m])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[n])
                if low[n] == index[n]:
                    cut = place[n]
                    name = min(path[cut:])
                    out.update(dict.fromkeys(path[cut:], name))
                    del path[cut:]
    return out


def peeled_levels(comps: list[int], links: list[tuple[int, int]], first: int) -> dict[int, int]:
    """Longest chains of links x -> y by Kahn's order; raises on a cycle."""
    level = dict.fromkeys(comps, first)
    waits = dict.fromkeys(comps, 0)
    back: dict[int, list[int]] = {}
    for x, y in {(x, y) for x, y in links if x in waits and y in waits}:
        waits[x] += 1
        back.setdefault(y, []).append(x)
    free = [c for c, w in waits.items() if not w]
    for c in free:
        for x in back.get(c, ()):
            level[x] = max(level[x], level[c] + 1)
            waits[x] -= 1
            if not waits[x]:
                free.append(x)
    if len(free) < len(level):
        raise ValueError("the condensation is not acyclic")
    return level


def _small(a: DataFrame, b: DataFrame, limit: int) -> bool:
    """Whether both together have at most `limit` rows; counting stops there."""
    return a.limit(limit + 1).count() + b.limit(limit + 1).count() <= limit


def _in_one_task(points: DataFrame, pairs: DataFrame, work, schema: str) -> DataFrame:
    """points (a), pairs (a, b), of counted size, in one task."""
    rows = points.select("a", F.lit(None).cast("bigint").alias("b")).unionByName(pairs.select("a", "b")).withColumn("one", F.lit(0))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        lone = pdf["b"].isna()
        got = work([int(x) for x in pdf.loc[lone, "a"]], [(int(x), int(y)) for x, y in zip(pdf.loc[~lone, "a"], pdf.loc[~lone, "b"])])
        return pd.DataFrame(sorted(got.items()), columns=[c.split()[0] for c in schema.split(", ")])

    return rows.groupBy("one").applyInPandas(run, schema)


def components(scratch: Scratch, nodes: DataFrame, edges: DataFrame, small: int = SMALL) -> DataFrame:
    """(n, comp): strongly connected components named by their smallest node."""
    if _small(nodes, edges, small):
        points = nodes.select(F.col("n").cast("bigint").alias("a")).distinct()
        return _in_one_task(points, edges.select(F.col("n").cast("bigint").alias("a"), F.col("dep").cast("bigint").alias("b")), tarjan, "n bigint, comp bigint")
    rest = scratch.cut(nodes.select("n").distinct(), "rest")
    both = edges.filter(F.col("n") != F.col("dep")).select(F.col("n").alias("a"), F.col("dep").alias("b")).distinct()
    live = scratch.cut(both.join(rest.withColumnRenamed("n", "a"), "a", "left_semi").join(rest.withColumnRenamed("n", "b"), "b", "left_semi"), "live")
    done = None
    while not rest.isEmpty():
        colour = _spread(scratch, scratch.cut(rest.select("n", F.col("n").alias("c")), "colour"), live, False)
        ca = colour.select(F.col("n").alias("a"), F.col("c").alias("ca"))
        cb = colour.select(F.col("n").alias("b"), F.col("c").alias("cb"))
        back = scratch.cut(live.join(ca, "a").join(cb, "b").filter(F.col("ca") == F.col("cb")).select(F.col("b").alias("a"), F.col("a").alias("b")), "back")
        start = scratch.cut(colour.select("n", F.when(F.col("n") == F.col("c"), 1).otherwise(0).alias("c")), "colour")
        hit = _spread(scratch, start, back, True).filter(F.col("c") == 1).select("n")
        found = scratch.cut(hit.join(colour, "n"), "found")
        done = found if done is None else done.unionByName(found)
        left = scratch.cut(rest.join(found, "n", "left_anti"), "rest")
        gone = found.select("n")
        live = scratch.cut(live.join(gone.withColumnRenamed("n", "a"), "a", "left_anti").join(gone.withColumnRenamed("n", "b"), "b", "left_anti"), "live")
        scratch.drop(rest)
        rest = left
    if done is None:
        return nodes.limit(0).select("n", F.col("n").alias("comp"))
    small = done.groupBy("c").agg(F.min("n").alias("comp"))
    return done.join(small, "c").select("n", "comp")


def component_edges(comps: DataFrame, edges: DataFrame) -> DataFrame:
    """GRA5: (comp, dep_comp) between different components, each once."""
    a = comps.select("n", "comp")
    b = comps.select(F.col("n").alias("dep"), F.col("comp").alias("dep_comp"))
    return edges.join(a, "n").join(b, "dep").filter(F.col("comp") != F.col("dep_comp")).select("comp", "dep_comp").distinct()


def component_sizes(comps: DataFrame) -> DataFrame:
    """GRA6: (comp, size, is_cycle)."""
    n = F.count(F.lit(1))
    return comps.groupBy("comp").agg(n.alias("size"), (n > 1).alias("is_cycle"))


def component_ids(scratch: Scratch, comps: DataFrame, places: DataFrame) -> DataFrame:
    """GRA4: (comp, comp_id): components numbered from 0 by their earliest member; places: (n, pos), of a repeated node the last one counts."""
    from annalist.operators.scan import row_numbers

    at = places.groupBy("n").agg(F.max("pos").alias("pos"))
    first = comps.join(at, "n").groupBy("comp").agg(F.min(F.struct("pos", "n")).alias("first"))
    return row_numbers(scratch, first, ["first"], "comp_id").select("comp", "comp_id")


def levels(scratch: Scratch, comps: DataFrame, cedges: DataFrame, small: int = SMALL) -> DataFrame:
    """GRA7: (comp, level): 0 without dependency, else one above the highest dependency. A cycle among components raises."""
    return _levels(scratch, comps.select("comp").distinct(), cedges.select(F.col("comp").alias("x"), F.col("dep_comp").alias("y")), 0, small)


def bottom_levels(scratch: Scratch, comps: DataFrame, cedges: DataFrame, small: int = SMALL) -> DataFrame:
    """GRA8: (comp, level): 1 without dependent, else one above the highest dependent; the scheduler's priority."""
    return _levels(scratch, comps.select("comp").distinct(), cedges.select(F.col("dep_comp").alias("x"), F.col("comp").alias("y")), 1, small)


def _levels(scratch: Scratch, comps: DataFrame, links: DataFrame, first: int, small: int) -> DataFrame:
    """Peels components all of whose links x -> y lead to peeled ones."""
    if _small(comps, links, small):
        pairs = links.select(F.col("x").alias("a"), F.col("y").alias("b"))
        return _in_one_task(comps.select(F.col("comp").alias("a")), pairs, lambda p, e: peeled_levels(p, e, first), "comp bigint, level int")
    rest = scratch.cut(comps, "rest")
    links = scratch.cut(links.join(rest.withColumnRenamed("comp", "x"), "x", "left_semi").join(rest.withColumnRenamed("comp", "y"), "y", "left_semi"), "links")
    out, level = None, first
    while not rest.isEmpty():
        held = links.select(F.col("x").alias("comp")).distinct()
        free = scratch.cut(rest.join(held, "comp", "left_anti").withColumn("level", F.lit(level)), "free")
        if free.isEmpty():
            raise ValueError("the condensation is not acyclic")
        out = free if out is None else out.unionByName(free)
        rest = scratch.cut(rest.join(free, "comp", "left_anti"), "rest")
        links = scratch.cut(links.join(free.select(F.col("comp").alias("y")), "y", "left_anti"), "links")
        level += 1
    return out if out is not None else comps.withColumn("level", F.lit(first)).limit(0)


def topological_order(lv: DataFrame, scratch: Scratch) -> DataFrame:
    """(comp, level, seq): components numbered so that dependencies come first, by level and then by component."""
    from annalist.operators.scan import row_numbers

    return row_numbers(scratch, lv, ["level", "comp"], "seq")


def queue_order(scratch: Scratch, lv: DataFrame, cedges: DataFrame) -> DataFrame:
    """GRA7: (comp, level, seq) in the order of a first-in-first-out queue that begins with the components without dependencies.

    A component joins the queue when its last dependency leaves it, so all of a level come before the next level; within a
    level the place of that dependency decides, and then the number. One round per level.
    """
    from annalist.operators.scan import row_numbers

    top = lv.agg(F.max("level")).first()[0]
    done, count = None, 0
    for level in range(0 if top is None else top + 1):
        here = lv.filter(F.col("level") == level)
        if done is None:
            here = here.withColumn("last", F.lit(0).cast("long"))
        else:
            deps = cedges.join(done.select(F.col("comp").alias("dep_comp"), "seq"), "dep_comp").groupBy("comp").agg(F.max("seq").alias("last"))
            here = here.join(deps, "comp")
        new = row_numbers(scratch, here.select("comp", "level", "last"), ["last", "comp"], "n")
        new = scratch.cut(new.select("comp", "level", (F.col("n") + count).alias("seq")), "queue")
        count += new.count()
        done = new if done is None else done.unionByName(new)
    return done if done is not None else lv.withColumn("seq", F.lit(0).cast("long")).limit(0)


def ready(lv: DataFrame, bottom: DataFrame, slots: int, within: tuple[str, ...] = ()) -> DataFrame:
    """LIM2: of each level (of each group `within`) the `slots` components with the highest bottom level, then the lowest number: what a scheduler starts first."""
    from pyspark.sql import Window as W

    if slots < 1:
        raise ValueError("at least one slot")
    j = lv.join(bottom.withColumnRenamed("level", "bottom"), "comp")
    n = F.row_number().over(W.partitionBy(*within, "level").orderBy(F.col("bottom").desc(), "comp"))
    return j.withColumn("place", n).filter(F.col("place") <= slots)
