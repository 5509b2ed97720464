"""Problem 8: items of varying length into containers of fixed capacity.

Vector bin packing by the dot-product heuristic: a container has limits on tokens, on segments and on loss-bearing
tokens; of the items that still fit, the one goes in whose demand has the largest dot product with what is left, each
dimension in shares of its limit and weighted by how scarce it is among the items. Items larger than a container are cut
into full containers and a rest; no other item is ever split.

Loss-bearing are the tokens after a text's first paragraph, which asks or names; a text of one paragraph bears loss in
whole. The limit LOSS_SHARE is below one, so containers mix texts that bear much loss with such as bear little. Where
one piece bears more loss than a container takes, it stays whole and its first loss-bearing tokens are masked: its
loss_tokens are the limit.

A task packs the texts of its own scan, in groups of GROUP items at a time; what lies in containers filled below CARRY
moves on to the next group, which is the larger by it, so containers close ill-filled only at a task's end. There is no
shuffle, no group grows with the data, and a container's number carries the task's, so numbers are unique.

Cases: texts without tokens (null, empty) are not placed; repeated rows are placed as often as they occur; capacities
below one token raise.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalist.llm.tokens import VOCABULARY, encoder, token_count

GROUP = 4096
CARRY = 0.95
#: One segment at most for so many tokens of capacity, and never less than LEAST_SEGMENTS in a container.
TOKENS_PER_SEGMENT, LEAST_SEGMENTS = 16, 4
#: Loss-bearing tokens that a container takes, as a share of its capacity.
LOSS_SHARE = 0.94
_PARAGRAPH = re.compile(r"\r?\n[ \t]*\r?\n\s*")


def limits(capacity: int, loss_share: float = LOSS_SHARE) -> tuple[int, int, int]:
    """(tokens, segments, loss-bearing tokens) that a container holds."""
    if capacity < 1:
        raise ValueError("a container holds one token at least")
    return capacity, max(LEAST_SEGMENTS, capacity // TOKENS_PER_SEGMENT), max(1, int(capacity * loss_share))


def pieces(tokens: int, loss: int, capacity: int, loss_limit: int) -> list[tuple[int, int, int, int]]:
    """(number, first token, tokens, loss-bearing tokens) of an item: one piece, or full containers and a rest; the loss-bearing tokens come last and count up to the limit."""
    out, free = [], tokens - loss
    for at in range(0, tokens, capacity):
        n = min(capacity, tokens - at)
        out.append((len(out), at, n, min(loss_limit, n - max(0, min(at + n, free) - at))))
    return out


#: Shares of loss-bearing tokens by which kinds of items are listed; they only shorten the search.
_CLASSES = (0.0, 0.5, 0.75, 0.85, 0.9, 0.94, 0.97, 0.985, 1.0)


class _Kinds:
    """Kinds of items with a share of loss-bearing tokens between two bounds, from the largest on."""

    def __init__(self, kinds: list[tuple[int, int]], low: float, high: float):
        self.kinds, self.low, self.high = kinds, low, high
        self.down = [-t for t, _ in kinds]
        self.nxt = list(range(len(kinds) + 1))  # the next kind that has items
        self.at = 0  # the first that may still fit the open container

    def alive(self, k: int) -> int:
        nxt, root = self.nxt, k
        while nxt[root] != root:
            root = nxt[root]
        while nxt[k] != root:
            nxt[k], k = root, nxt[k]
        return root

    def best(self, room: int, free: int, a: float, c: float, top: tuple[float, int, int]) -> tuple[tuple[float, int, int], int]:
        """The largest (product, tokens, loss) above `top` of what fits, and its place; else `top` and -1."""
        most = room if free >= room * self.low else int(free / self.low)
        i = self.at = self.alive(max(self.at, bisect_left(self.down, -most)))
        kinds, nxt, n, found = self.kinds, self.nxt, len(self.kinds), -1
        bound = a + self.high * c
        limit = top[0] * (1 - 1e-12)
        while i < n:
            t, x = kinds[i]
            if t * bound < limit:
                break
            if x <= free:
                got = (t * a + x * c, t, x)
                if got > top:
                    top, found, limit = got, i, got[0] * (1 - 1e-12)
            i = nxt[i + 1]
            if nxt[i] != i:
                i = self.alive(i)
        return top, found


def pack(items: list[tuple[int, int]], tokens: int, segments: int, loss: int) -> list[list[int]]:
    """Containers as lists of item numbers. items: (tokens, loss-bearing tokens), each within the limits.

    Equal items are one kind, as the heuristic can't tell them apart. Kinds are listed by their share of loss-bearing
    tokens, so that their size bounds their dot product, and the search of a list ends where no smaller one can be better.
    """
    of: dict[tuple[int, int], list[int]] = {}
    for i in range(len(items) - 1, -1, -1):
        of.setdefault(items[i], []).append(i)
    kinds = sorted(of, reverse=True)
    lists = []
    for low, high in zip(_CLASSES, _CLASSES[1:]):
        own = [k for k in kinds if low * k[0] < k[1] <= high * k[0] or low == k[1] == 0]
        if own:
            lists.append(_Kinds(own, low, high))
    lists.reverse()
    left = len(items)
    demand = [sum(t for t, _ in items) / tokens, len(items) / segments, sum(x for _, x in items) / loss]
    most = max(demand, default=1.0) or 1.0
    by_tokens, by_loss = demand[0] / most / tokens**2, demand[2] / most / loss**2
    out: list[list[int]] = []
    while left:
        room, seats, free, own = tokens, segments, loss, []
        for k in lists:
            k.at = 0
        while seats and room:
            # the segments' part of the product is the same for all items
            a, c = by_tokens * room, by_loss * free
            top, where, at = (-1.0, 0, 0), None, -1
            for k in lists:
                top, found = k.best(room, free, a, c, top)
                if found >= 0:
                    where, at = k, found
            if where is None:
                break
            kind = of[top[1:]]
            own.append(kind.pop())
            if not kind:
                where.nxt[at] = at + 1
            room -= top[1]
            free -= top[2]
            seats -= 1
            left -= 1
        out.append(own)
    return out


def pack_documents(docs: DataFrame, capacities: list[tuple[int, int]], loss_share: float = LOSS_SHARE, path: str = VOCABULARY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(capacity_id, container_id, position, key, piece, token_start, tokens, loss_tokens). capacities: (id, tokens), a few."""
    caps = {cid: limits(c, loss_share) for cid, c in capacities}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 33
        e = encoder(path)
        number = dict.fromkeys(caps, 0)
        open_: dict[int, list[tuple]] = {c: [] for c in caps}
        group = dict.fromkeys(caps, GROUP)

        def flush(cid: int, last: bool) -> pa.RecordBatch | None:
            items, (cap, seats, most) = open_[cid], caps[cid]
            cols: list[list] = [[] for _ in types]
            kept = []
            for own in pack([(x[3], x[4]) for x in items], cap, seats, most):
                mine = [items[i] for i in own]
                if not last and len(own) < seats and sum(x[3] for x in mine) < CARRY * cap and sum(x[4] for x in mine) < CARRY * most:
                    kept += mine
                    continue
                box = base + number[cid]
                number[cid] += 1
                m = len(mine)
                for col, values in zip(cols, ([cid] * m, [box] * m, range(m), *zip(*mine))):
                    col.extend(values)
            open_[cid], group[cid] = kept, len(kept) + max(GROUP, len(kept))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types.values())], list(types)) if cols[0] else None

        for b in batches:
            types = {"capacity_id": pa.int32(), "container_id": pa.int64(), "position": pa.int32(), key: b.column(0).type, "piece": pa.int32(), "token_start": pa.int64(), "tokens": pa.int64(), "loss_tokens": pa.int64()}
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                n = len(e.encode_ordinary(t)) if t else 0
                if not n:
                    continue
                m = _PARAGRAPH.search(t)
                asks = len(e.encode_ordinary(t[: m.end()])) if m and 0 < m.start() and m.end() < len(t) else 0
                loss = max(1, n - asks)
                for cid, (c, _, most) in caps.items():
                    open_[cid] += [(k, *p) for p in pieces(n, loss, c, most)]
            for cid in caps:
                while len(open_[cid]) >= group[cid]:
                    done = flush(cid, False)
                    if done is not None:
                        yield done
        for cid in caps:
            if open_[cid]:
                done = flush(cid, True)
                if done is not None:
                    yield done

    kind = dict(docs.dtypes)[key]
    schema = f"capacity_id int, container_id bigint, position int, `{key}` {kind}, piece int, token_start bigint, tokens bigint, loss_tokens bigint"
    return docs.filter(F.col(text).isNotNull()).select(F.col(key), F.col(text)).mapInArrow(run, schema)


def _with_limits(capacities: list[tuple[int, int]], loss_share: float) -> Column:
    rows = [F.struct(*[F.lit(x).cast("bigint").alias(n) for x, n in zip((c, *limits(c, loss_share)), ("capacity_tokens", "most_tokens", "most_segments", "most_loss"))]) for _, c in capacities]
    return F.create_map(*[x for (cid, _), r in zip(capacities, rows) for x in (F.lit(cid), r)])[F.col("capacity_id")]


def _containers(packed: DataFrame) -> DataFrame:
    return packed.groupBy("capacity_id", "container_id").agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n"), F.sum("loss_tokens").alias("l"))


def fill_rates(packed: DataFrame, capacities: list[tuple[int, int]], loss_share: float = LOSS_SHARE) -> DataFrame:
    """(capacity_id, capacity_tokens, containers, least, items, tokens, loss_tokens, fill, fill_segments, fill_loss): the share of each limit in use; least: containers that any packing needs. Two partial aggregations."""
    out = _containers(packed).groupBy("capacity_id").agg(F.count(F.lit(1)).alias("containers"), F.sum("n").alias("items"), F.sum("t").alias("tokens"), F.sum("l").alias("loss_tokens"))
    out = out.withColumn("m", _with_limits(capacities, loss_share))
    share = lambda a, b: F.round(F.col(a) / (F.col("containers") * F.col(b)), 6)
    least = F.greatest(*[F.ceil(F.col(a) / F.col(b)) for a, b in (("tokens", "m.most_tokens"), ("items", "m.most_segments"), ("loss_tokens", "m.most_loss"))])
    return out.select(
        "capacity_id", "m.capacity_tokens", "containers", least.alias("least"), "items", "tokens", "loss_tokens",
        share("tokens", "m.most_tokens").alias("fill"), share("items", "m.most_segments").alias("fill_segments"), share("loss_tokens", "m.most_loss").alias("fill_loss"),
    )


def violations(packed: DataFrame, docs: DataFrame, capacities: list[tuple[int, int]], loss_share: float = LOSS_SHARE, path: str = VOCABULARY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(capacity_id, id, what): containers above a limit, and items whose tokens are not placed once each or that are split although they fit. Empty for every packing."""
    m = F.col("m")
    over = _containers(packed).withColumn("m", _with_limits(capacities, loss_share))
    over = over.filter((F.col("t") > m["most_tokens"]) | (F.col("n") > m["most_segments"]) | (F.col("l") > m["most_loss"])).select("capacity_id", F.col("container_id").alias("id"), F.lit("limit").alias("what"))
    of = packed.groupBy("capacity_id", key).agg(F.sum("tokens").alias("got"), F.count_distinct("token_start").alias("parts"), F.max(F.col("token_start") + F.col("tokens")).alias("end"))
    want = docs.select(key, token_count(text, path).alias("tokens")).filter(F.col("tokens") > 0).groupBy(key).agg(F.max("tokens").alias("size"), F.sum("tokens").alias("want"))
    want = want.select("*", F.explode(F.array(*[F.lit(cid) for cid, _ in capacities])).alias("capacity_id")).withColumn("m", _with_limits(capacities, loss_share))
    wrong = want.join(of, [key, "capacity_id"], "full_outer")
    bad = ~F.coalesce((F.col("got") == F.col("want")) & (F.col("end") == F.col("size")) & ((F.col("parts") == 1) | (F.col("size") > m["most_tokens"])), F.lit(False))
    return over.unionByName(wrong.filter(bad).select("capacity_id", F.col(key).cast("bigint").alias("id"), F.lit("tokens").alias("what")))
