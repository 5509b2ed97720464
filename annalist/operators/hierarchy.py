"""Problem 1: parent-child rows to full hierarchies.

Bottom-up leaf peeling, reverse peel order, cycles as the residue. Peeling single leaves would take as many rounds as the
tree is high, and a history is as long as its project is old, so whole leaf segments are peeled: a segment is a maximal
run of nodes below the last fork, found by pointers that follow one another. Every node that becomes a leaf segment's end was a fork, so
each phase at least halves the leaves; phases and rounds grow with the logarithm of the rows.

Bottom-up, each peeled segment sends its subtree size to the node it hangs from, and with it an interval: nodes are
numbered in preorder, and the descendants of a node are the numbers from its own to its own plus its subtree size. That
is the descendant list in constant space; `descendants` expands it. Top-down, in reverse peel order, segments get depth,
root and path from the segment they hang from. What is never peeled lies on a cycle; what hangs from it never ends.

Every round is a join and its result a table in the shared folder. No list of nodes reaches the driver, only counts.

Cases: rows without a key are no nodes; null or unknown parents make roots; a node that is its own parent is a cycle;
repeated rows of one node count once (the smallest position, null positions last).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from annalist.operators.scan import running_sum
from annalist.session import Scratch


def commit_nodes(commits: DataFrame) -> DataFrame:
    """(tree, node, label, parent): of several rows of one commit the one with the smallest pos; its parent is the first of `parents`."""
    first = F.when(F.size("parents") > 0, F.lower(F.element_at("parents", 1))).alias("parent")
    one = F.min(F.struct(F.col("pos").isNull(), "pos", F.col("sha").alias("label"), first)).alias("r")
    rows = commits.filter(F.col("sha").isNotNull() & F.col("repository_id").isNotNull())
    return rows.groupBy(F.col("repository_id").alias("tree"), F.lower("sha").alias("node")).agg(one).select("tree", "node", "r.label", "r.parent")


@dataclass
class Forest:
    """Tables of a peeled forest. Nodes and segments go by the numbers in `names`."""

    scratch: Scratch
    names: DataFrame  # id, tree, node, label
    nodes: DataFrame  # id, head, off: segment and place in it, of every peeled node
    segments: DataFrame  # head, phase, len, up, pseg, poff: the node it hangs from, that node's segment and place
    cyclic: DataFrame  # id: nodes on cycles
    phases: int

    def depths(self) -> DataFrame:
        """(tree, node, label, root, depth) for every node; a node whose ancestry never ends has root '' and depth -1."""
        tops = self._tops()
        known = self.nodes.join(tops, "head").select("id", "root", (F.col("base") + F.col("off")).alias("depth"))
        return self.names.join(known, "id", "left").select(
            "tree", "node", "label", F.coalesce("root", F.lit("")).alias("root"), F.when(F.col("root").isNull(), -1).otherwise(F.col("depth")).cast("long").alias("depth")
        )

    def _tops(self) -> DataFrame:
        """(head, base, root, path) of the segments that reach a root, by reverse peel order; path: (head of each segment from the root on, where the next one hangs); root: the root's label, which goes down with the segments, so no node looks for it."""
        got = None
        for phase in reversed(range(self.phases)):
            s = self.segments.filter(F.col("phase") == phase)
            none = F.array().cast("array<struct<head:bigint,tail:bigint,tail_off:bigint>>")
            labels = self.names.select(F.col("id").alias("head"), F.col("label").alias("root"))
            new = s.filter(F.col("up").isNull()).join(labels, "head").select("head", F.lit(0).cast("long").alias("base"), "root", none.alias("path"))
            if got is not None:
                above = got.select(F.col("head").alias("pseg"), F.col("base").alias("pbase"), "root", F.col("path").alias("ppath"))
                hung = s.filter(F.col("pseg").isNotNull()).join(above, "pseg")
                step = F.struct(F.col("pseg").alias("head"), F.col("up").alias("tail"), F.col("poff").alias("tail_off"))
                new = new.unionByName(hung.select("head", (F.col("pbase") + F.col("poff") + 1).alias("base"), "root", F.concat("ppath", F.array(step)).alias("path")))
            new = self.scratch.cut(new, "tops")
            got = new if got is None else got.unionByName(new)
        return got if got is not None else self.nodes.limit(0).select("head", F.col("off").alias("base"), F.lit("").alias("root"), F.array().cast("array<struct<head:bigint,tail:bigint,tail_off:bigint>>").alias("path"))

    def totals(self) -> DataFrame:
        """(head, total): subtree sizes of segments, in peel order."""
        got = None
        for phase in range(self.phases):
            s = self.segments.filter(F.col("phase") == phase).select("head", "len")
            if got is not None:
                below = got.join(self.segments.select("head", "pseg"), "head").groupBy(F.col("pseg").alias("head")).agg(F.sum("total").alias("below"))
                s = s.join(below, "head", "left").select("head", (F.col("len") + F.coalesce("below", F.lit(0))).alias("total"))
            else:
                s = s.select("head", F.col("len").alias("total"))
            new = self.scratch.cut(s, "totals")
            got = new if got is None else got.unionByName(new)
        return got if got is not None else self.nodes.limit(0).select("head", F.col("off").alias("total"))

    def intervals(self) -> DataFrame:
        """(id, root, depth, pre, size, head, off, path): preorder number within the tree from 0, nodes of the subtree with the node itself."""
        sc, totals, tops = self.scratch, self.totals(), self._tops()
        hung = self.segments.filter(F.col("up").isNotNull()).join(totals, "head").select("head", "up", "pseg", "total")
        at_node = hung.groupBy(F.col("up").alias("id")).agg(F.sum("total").alias("hung"))
        nodes = self.nodes.join(at_node, "id", "left")
        nodes = sc.cut(running_sum(sc, nodes, ["head"], ["off"], "hung", "before"), "nodes")
        sibs = running_sum(sc, hung, ["up"], ["head"], "total", "sib")
        starts = self.segments.join(sibs.select("head", "sib"), "head", "left").join(nodes.select(F.col("id").alias("up"), "before"), "up", "left")
        starts = sc.cut(starts.select("head", "phase", "up", "pseg", "poff", F.col("sib"), F.col("before")), "starts")
        got = None
        for phase in reversed(range(self.phases)):
            s = starts.filter(F.col("phase") == phase)
            new = s.filter(F.col("up").isNull()).select("head", F.lit(0).cast("long").alias("start"))
            if got is not None:
                above = got.select(F.col("head").alias("pseg"), F.col("start").alias("pstart"))
                new = new.unionByName(s.join(above, "pseg").select("head", (F.col("pstart") + F.col("poff") + F.col("before") + 1 + F.col("sib")).alias("start")))
            new = sc.cut(new, "start")
            got = new if got is None else got.unionByName(new)
        if got is None:
            got = self.nodes.limit(0).select("head", F.col("off").alias("start"))
        seg = tops.join(got, "head").join(totals, "head")
        size = F.col("total") - F.col("off") - F.col("before")
        return nodes.join(seg, "head").select("id", "root", (F.col("base") + F.col("off")).alias("depth"), (F.col("start") + F.col("off") + F.col("before")).alias("pre"), size.alias("size"), "head", "off", "path")


def peel(spark: SparkSession, rows: DataFrame, scratch: Scratch) -> Forest:
    """rows: (tree, node, label, parent), one row per (tree, node); parents are looked up within the tree."""
    names = scratch.cut(rows.withColumn("id", F.monotonically_increasing_id()), "names")
    parents = names.select("tree", F.col("node").alias("parent"), F.col("id").alias("up"))
    active = scratch.cut(names.join(parents, ["tree", "parent"], "left").select("id", "up"), "links")
    names = names.select("id", "tree", "node", "label")
    peeled, cyclic, phase = None, None, 0
    while True:
        forks = active.filter(F.col("up").isNotNull()).groupBy("up").agg(F.count(F.lit(1)).alias("n"))
        above = forks.select("up", F.col("n").alias("nup"))
        below = forks.select(F.col("up").alias("id"), F.lit(True).alias("inner"))
        run = active.join(above, "up", "left").join(below, "id", "left")
        single = F.coalesce(F.col("nup") == 1, F.lit(False))
        walk = run.select(
            "id", F.col("up").alias("parent"), F.col("inner").isNull().alias("leaf"),
            F.when(single, F.col("up")).otherwise(F.col("id")).alias("ptr"), single.cast("long").alias("off"), (~single).alias("done"),
        )
        walk, open_ = _cut_counting(scratch, walk, ~F.col("done"))
        while open_:
            nxt, n = _cut_counting(scratch, _follow(walk), ~F.col("done"))
            scratch.drop(walk)
            walk = nxt
            if n == open_:
                break  # a run that ends moves towards its head, so only pure cycles stand still
            open_ = n
        still = walk.filter(~F.col("done")).select("id")
        cyclic = still if cyclic is None else cyclic.unionByName(still)
        ends = walk.filter(F.col("leaf") & F.col("done")).select(F.col("ptr").alias("end"))
        marked = walk.filter("done").join(ends, F.col("ptr") == F.col("end"), "left")
        marked, rest = _cut_counting(scratch, marked.select("id", "parent", "ptr", "off", F.col("end").isNotNull().alias("peel")), ~F.col("peel"))
        scratch.drop(active)
        own = marked.filter("peel").select("id", "parent", F.col("ptr").alias("head"), "off", F.lit(phase).alias("phase"))
        peeled = own if peeled is None else peeled.unionByName(own)
        active = marked.filter(~F.col("peel")).select("id", F.col("parent").alias("up"))
        phase += 1
        if rest == 0:
            break
    nodes = peeled.select("id", "head", "off")
    heads = peeled.filter(F.col("off") == 0).select("head", "phase", F.col("parent").alias("up"))
    lens = peeled.groupBy("head").agg(F.count(F.lit(1)).alias("len"))
    where = nodes.select(F.col("id").alias("up"), F.col("head").alias("pseg"), F.col("off").alias("poff"))
    segments = scratch.cut(heads.join(lens, "head").join(where, "up", "left"), "segments")
    return Forest(scratch, names, nodes, segments, cyclic, phase)


#: Pointers that one round follows, one after another: runs get HOPS + 1 times as long with each round.
HOPS = 5


def _follow(walk: DataFrame, hops: int = HOPS) -> DataFrame:
    """Lets every open pointer follow `hops` pointers; those at a segment's head stay there. All hops meet the same table, which Spark reads once."""
    moved = walk.filter(~F.col("done"))
    for _ in range(hops):
        to = walk.select(F.col("id").alias("ptr"), F.col("ptr").alias("ptr2"), F.col("off").alias("off2"), F.col("done").alias("done2"))
        moved = moved.join(to, "ptr").select("id", "parent", "leaf", F.col("ptr2").alias("ptr"), (F.col("off") + F.col("off2")).alias("off"), F.col("done2").alias("done"))
    return walk.filter("done").unionByName(moved)


def _cut_counting(scratch: Scratch, df: DataFrame, what) -> tuple[DataFrame, int]:
    seen = Observation()
    out = scratch.cut(df.observe(seen, F.count(F.when(what, 1)).alias("n")), "walk")
    return out, seen.get["n"]


def hierarchy(forest: Forest) -> DataFrame:
    """One row per node: depth, root, subtree size, preorder number, path and ancestry (rooted, cycle, below_cycle).

    path lists (label of a segment's first node, its last node on the path, how many nodes of it are on the path) from
    the root to the node itself. It has at most log2 entries of the rows, where the nodes themselves would be as many as
    the depth; `full_paths` writes them out.
    """
    iv = forest.intervals()
    names = forest.names
    steps = iv.select("id", F.posexplode(F.concat("path", F.array(F.struct(F.col("head"), F.col("id").alias("tail"), F.col("off").alias("tail_off"))))).alias("no", "s"))
    steps = steps.select("id", "no", "s.head", "s.tail", (F.col("s.tail_off") + 1).alias("n"))
    a = names.select(F.col("id").alias("head"), F.col("label").alias("first"))
    b = names.select(F.col("id").alias("tail"), F.col("label").alias("last"))
    paths = steps.join(a, "head").join(b, "tail").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("no", "first", "last", "n"))).alias("p"))
    paths = paths.select("id", F.transform("p", lambda s: F.struct(s["first"].alias("first"), s["last"].alias("last"), s["n"].alias("n"))).alias("path"))
    known = iv.drop("path").join(paths, "id").select("id", "root", "depth", "pre", "size", "path")
    circles = forest.cyclic.select("id", F.lit(True).alias("circle"))
    ancestry = F.when(F.col("root").isNotNull(), "rooted").when(F.col("circle"), "cycle").otherwise("below_cycle")
    return names.join(known, "id", "left").join(circles, "id", "left").select(
        "tree", "label", F.coalesce("root", F.lit("")).alias("root"), F.coalesce("depth", F.lit(-1)).cast("long").alias("depth"),
        "pre", (F.col("size") - 1).alias("n_below"), "path", ancestry.alias("ancestry"),
    )


def full_paths(forest: Forest) -> DataFrame:
    """(tree, label, path): every node's path written out, root first. The output is as large as the sum of the depths."""
    iv, names = forest.intervals(), forest.names
    steps = iv.select("id", F.posexplode(F.concat("path", F.array(F.struct(F.col("head"), F.col("id").alias("tail"), F.col("off").alias("tail_off"))))).alias("no", "s")).select("id", "no", "s.head", "s.tail_off")
    on = forest.nodes.withColumnRenamed("id", "via").withColumnRenamed("off", "via_off")
    rows = steps.join(on, "head").filter(F.col("via_off") <= F.col("tail_off"))
    rows = rows.join(names.select(F.col("id").alias("via"), F.col("label").alias("via_label")), "via")
    paths = rows.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("no", "via_off", "via_label"))).alias("p"))
    return paths.join(names, "id").select("tree", "label", F.transform("p", lambda s: s["via_label"]).alias("path"))


def descendants(forest: Forest) -> DataFrame:
    """(tree, label, below): all pairs of a node and one below it, from the full paths; as many rows as the sum of the depths."""
    p = full_paths(forest)
    up = p.select("tree", F.col("label").alias("below"), F.explode(F.slice("path", F.lit(1), F.size("path") - 1)).alias("label"))
    return up.select("tree", "label", "below")
