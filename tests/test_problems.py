"""Problems 1, 2, 6 and 7 against brute force, and their edge cases."""

import random
from datetime import datetime, timedelta

import pytest

from annalist.operators import changefeed, hierarchy, history, snapshots
from annalist.schemas import COMMITS, DOCUMENTATIONS
from annalist.sources.bucket_store import BucketStore, ConcurrentChange, bucket_values

SNAP = "snapshot_no int, loaded_at timestamp_ntz, registry_id bigint, repository_id bigint, file_path string, function_name string, content_hash string, is_deleted boolean, bucket string, at int"
T0 = datetime(2024, 1, 1)


def commit_rows(parents, tree=1):
    """parents: sha -> list or None."""
    return [(tree, s, s[:7], "m", "a", None, p, False, i) for i, (s, p) in enumerate(parents.items())]


def brute(parents):
    out = {}
    for s in parents:
        seen, at, path = set(), s, []
        while at not in seen:
            seen.add(at)
            path.append(at)
            p = (parents[at] or [None])[0]
            if p is None or p.lower() not in parents:
                break
            at = p.lower()
        else:
            path = None
        out[s] = path[::-1] if path else None
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_hierarchy_matches_brute_force(spark, scratch, seed):
    r = random.Random(seed)
    shas = [f"c{i:03d}" for i in range(120)]
    parents = {}
    for i, s in enumerate(shas):
        k = r.random()
        parents[s] = None if k < 0.04 else [] if k < 0.06 else ["unknown"] if k < 0.08 else [r.choice(shas[max(0, i - 4) : i] or [None])] if k < 0.95 else [r.choice(shas)]
        if parents[s] == [None]:
            parents[s] = None
        if parents[s] and r.random() < 0.3:
            parents[s] = [parents[s][0].upper(), *parents[s][1:]]
    want = brute(parents)
    forest = hierarchy.peel(spark, hierarchy.commit_nodes(spark.createDataFrame(commit_rows(parents), COMMITS)), scratch)
    got = {r["label"]: (r["root"], r["depth"]) for r in forest.depths().collect()}
    assert got == {s: (p[0], len(p) - 1) if p else ("", -1) for s, p in want.items()}
    paths = {r["label"]: list(r["path"]) for r in hierarchy.full_paths(forest).collect()}
    assert paths == {s: p for s, p in want.items() if p}
    below = {}
    for p in want.values():
        for a in (p or [])[:-1]:
            below.setdefault(a, set()).add(p[-1])
    pairs = {}
    for row in hierarchy.descendants(forest).collect():
        pairs.setdefault(row["label"], set()).add(row["below"])
    assert pairs == below
    rows = {r["label"]: r for r in hierarchy.hierarchy(forest).collect()}
    for s, row in rows.items():
        if want[s]:
            assert row["n_below"] == len(below.get(s, ()))
            inside = {x for x, y in rows.items() if y["root"] == row["root"] and y["pre"] is not None and row["pre"] < y["pre"] <= row["pre"] + row["n_below"]}
            assert inside == below.get(s, set())
            assert sum(p["n"] for p in row["path"]) == len(want[s]) and row["path"][-1]["last"] == s


def test_hierarchy_edges(spark, scratch):
    rows = [
        (1, "a", "a", None, None, None, ["A"], None, 3),  # its own parent
        (1, "b", "b", None, None, None, ["a"], None, 4),  # below a cycle
        (1, "x", "x", None, None, None, ["y"], None, 2),
        (1, "x", "x", None, None, None, None, None, 1),  # the first delivered row counts
        (2, "x", "x", None, None, None, [None], None, None),
        (None, "x", "x", None, None, None, None, None, 5),
        (1, None, None, None, None, None, None, None, 6),
    ]
    f = hierarchy.peel(spark, hierarchy.commit_nodes(spark.createDataFrame(rows, COMMITS)), scratch)
    got = {(r["tree"], r["label"]): (r["root"], r["depth"]) for r in f.depths().collect()}
    assert got == {(1, "a"): ("", -1), (1, "b"): ("", -1), (1, "x"): ("x", 0), (2, "x"): ("x", 0)}
    empty = hierarchy.peel(spark, hierarchy.commit_nodes(spark.createDataFrame([], COMMITS)), scratch)
    assert empty.depths().count() == 0 and hierarchy.hierarchy(empty).count() == 0


def test_snapshots_edges(spark):
    s = lambda no, load, rid, fn, h, gone=None, repo=1: (no, T0 + timedelta(seconds=load) if load is not None else None, rid, repo, "f", fn, h, gone, "x", 1)
    rows = [
        s(1, 1, 1, "same", "AB"), s(1, 1, 2, "hash", "a"), s(1, 1, 3, "gone", "a"), s(1, 1, 4, None, None), s(1, 1, 5, "null", None),
        s(2, 9, 9, "other", "x", None, 2),  # a delivery without repository 1
        s(3, 1, 1, "same", "ab"), s(3, 1, 1, "same", "ab"), s(3, 1, 2, "hash", "b"), s(3, 2, 3, "gone", "a", True), s(3, 1, 3, "gone", "z"), s(3, 1, 4, None, "n"), s(3, 1, 5, "null", None), s(3, 1, 6, "new", "q", False),
        s(None, 1, 7, "lost", "q"),
    ]
    got = {(r["snapshot_no"], r["function_name"], r["change_kind"]) for r in snapshots.snapshot_changes(spark.createDataFrame(rows, SNAP)).collect()}
    assert got == {(3, "hash", "changed"), (3, "gone", "removed"), (3, None, "changed"), (3, "new", "added")}
    assert snapshots.snapshot_changes(spark.createDataFrame([], SNAP)).count() == 0


RAW = "origin string, repository_id bigint, file_path string, function_name string, at bigint, id bigint, value string, gone boolean"


def brute_versions(rows):
    keys = {}
    for o, rep, f, n, at, i, v, g in rows:
        keys.setdefault((o, rep, f, n), {}).setdefault(at, []).append((i, g, v))
    out = set()
    for k, times in keys.items():
        open_ = None
        for at in sorted(times):
            _, g, v = max(times[at])
            if g:
                if open_:
                    out.add((*k, open_[0], open_[1], at))
                open_ = None
            elif open_ is None or open_[0] != v:
                if open_:
                    out.add((*k, open_[0], open_[1], at))
                open_ = (v, at)
        if open_:
            out.add((*k, open_[0], open_[1], None))
    return out


@pytest.mark.parametrize("hot", [10**9, 5])
def test_history_matches_brute_force(spark, scratch, hot):
    r = random.Random(3)
    rows = []
    for i in range(400):
        key = ("o", r.choice([1, 1, 2, None]), r.choice(["f", None]), r.choice(["", "g"]))
        rows.append((*key, r.randrange(40) * history.DAY // 3, i, r.choice("abc"), r.random() < 0.2))
    rows += rows[:30]
    r.shuffle(rows)
    store = history.HistoryStore(scratch, scratch.path("h"), buckets=4, hot=hot)
    cut, later = 300, 350
    frame = lambda x: spark.createDataFrame(x, RAW)
    store.load(frame([x for x in rows if x[5] < cut]))
    assert store.apply(frame([x for x in rows if cut <= x[5] < later]))
    assert store.apply(frame([x for x in rows if x[5] >= later]))
    got = [tuple(x) for x in store.versions().collect()]
    assert len(got) == len(set(got)) and set(got) == brute_versions(rows)


def test_history_empty(spark, scratch):
    log = spark.createDataFrame([], DOCUMENTATIONS)
    from pyspark.sql import functions as F

    none = history.to_changes(log, "d", "created_at", F.col("commit_sha"))
    store = history.HistoryStore(scratch, scratch.path("h"), buckets=2)
    store.load(none)
    store.apply(none)
    assert history.as_text(store.versions()).count() == 0


DOCS = "id bigint, repository_id bigint, file_path string, function_name string, commit_sha string, is_deleted boolean, bucket int, deleted int"


def brute_feed(rows):
    by = {}
    for i, rep, f, n, c, g, *_ in sorted(set(rows), key=lambda x: x[0]):
        key, flag = (rep, f, n), bool(g)
        seen, last = by.setdefault(key, (set(), [None]))
        if c is not None and (c, flag) in seen:
            continue
        seen.add((c, flag))
        last[0] = (i, flag)
    return {v[0][0] for s, v in by.values() if v[0] and not v[0][1]}


@pytest.mark.parametrize("batches", [1, 4])
def test_feed_matches_brute_force(spark, scratch, batches):
    r = random.Random(5)
    rows = [(i, r.choice([1, 2, None]), "f", r.choice(["a", "b", None]), r.choice(["c1", "c2", "c3", None]), r.choice([True, False, None, False]), 7, 7) for i in range(300)]
    rows += rows[:40]
    r.shuffle(rows)
    feed = changefeed.FeedTable(spark, scratch.path("feed"), buckets=4)
    n = len(rows) // batches + 1
    for k in range(batches):
        feed.apply(spark.createDataFrame(rows[k * n : (k + 1) * n], DOCS))
    ids = feed.current_ids()
    assert {x["id"] for x in ids.collect()} == brute_feed(rows)
    feed.apply(spark.createDataFrame(rows, DOCS))  # delivered once more
    assert {x["id"] for x in feed.current_ids().collect()} == brute_feed(rows)
    feed.apply(spark.createDataFrame([(None, 1, "f", "a", "c", False, 0, 0)], DOCS))
    current = changefeed.current_rows(spark.createDataFrame(rows, DOCS), feed.current_ids())
    assert sorted(x["id"] for x in current.collect()) == sorted(brute_feed(rows))


def test_feed_empty(spark, scratch):
    feed = changefeed.FeedTable(spark, scratch.path("feed"), buckets=2)
    feed.apply(spark.createDataFrame([], DOCS))
    assert feed.current_ids().count() == 0


def test_store_commits_once(spark, scratch):
    from pyspark.sql import types as T

    store = BucketStore(spark, scratch.path("s"), {"t": T.StructType([T.StructField("k", T.LongType())])}, 4)
    rows = spark.range(20).withColumnRenamed("id", "k").withColumn("bucket", store.bucket("k"))
    before = store.manifest()
    one, two = store.write("t", rows), store.write("t", rows.limit(3))
    store.commit(before, {"t": ([one], one[1])})
    with pytest.raises(ConcurrentChange):
        store.commit(before, {"t": ([two], two[1])})
    assert store.read("t").count() == 20  # the loser's rows are not seen
    assert store.vacuum() == 1 and store.read("t").count() == 20


def test_store_racing_writers(spark, scratch):
    from concurrent.futures import ThreadPoolExecutor

    from pyspark.sql import types as T

    store = BucketStore(spark, scratch.path("s"), {"t": T.StructType([T.StructField("k", T.LongType())])}, 4)
    before = store.manifest()

    def one(_):
        try:
            return store.commit(before, {"t": ([], [])})["generation"]
        except ConcurrentChange:
            return 0

    with ThreadPoolExecutor(8) as pool:
        assert sorted(pool.map(one, range(8))) == [0] * 7 + [1]


def test_bucket_values_are_sparks(spark):
    from pyspark.sql import functions as F

    values = bucket_values(50)
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v int").select("v", F.pmod(F.hash("v"), F.lit(50)).alias("b")).orderBy("b").collect()]
    assert got == values


def test_stores_keep_their_buckets(spark, scratch):
    """Opened again under other shuffle partitions, a feed and a history go on in the buckets they have."""
    r = random.Random(9)
    rows = [(i, r.choice([1, 2]), "f", r.choice("abcd"), r.choice(["c1", "c2", "c3", None]), r.random() < 0.3, 7, 7) for i in range(200)]
    raw = [("o", x[1], "f", x[3], r.randrange(40), x[0], r.choice("abc"), x[5]) for x in rows]
    at, ah = scratch.path("feed"), scratch.path("history")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for k, parts in enumerate((17, 23, 4)):
            spark.conf.set("spark.sql.shuffle.partitions", str(parts))
            feed, store = changefeed.FeedTable(spark, at), history.HistoryStore(scratch, ah)
            own = slice(k * 70, (k + 1) * 70)
            feed.apply(spark.createDataFrame(rows[own], DOCS))
            (store.apply if k else store.load)(spark.createDataFrame(raw[own], RAW))
            assert feed.store.buckets == store.store.buckets == 17
        assert {x["id"] for x in feed.current_ids().collect()} == brute_feed(rows)
        assert {tuple(x) for x in store.versions().collect()} == brute_versions(raw)
        with pytest.raises(ValueError, match="17 buckets"):
            changefeed.FeedTable(spark, at, 16)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_batches_shuffle_only_what_arrives(spark, scratch):
    """The base of a feed is merged where it lies: one scan of the touched buckets, no exchange of them."""
    feed = changefeed.FeedTable(spark, scratch.path("feed"), buckets=8)
    rows = [(i, 1, "f", str(i), "c", False, 7, 7) for i in range(400)]
    feed.apply(spark.createDataFrame(rows, DOCS))
    touched = feed.apply(spark.createDataFrame([(1000, 1, "f", "x", "c", False, 7, 7)], DOCS))
    assert len(touched) == 1
    before = feed.store.manifest()["tables"]["state"]
    assert len({f for x in before.values() for f in x}) == 2  # the other buckets' files are as they were
    plan = feed.store.read("state", touched).groupBy("bucket", "file_path").count()._jdf.queryExecution().executedPlan().toString()
    assert "SelectedBucketsCount: 1 out of 8" in plan and "Exchange" not in plan
    assert feed.current_ids().count() == 401


def test_paths_and_descendants_of_the_table(spark):
    """Both written out over all commits, against parents followed one by one."""
    from annalist.plans import problems

    d = "/root/testdata/sf0.001"
    first = {}
    for r in sorted(spark.read.parquet(f"{d}/commits.parquet").filter("sha is not null and repository_id is not null").collect(), key=lambda r: r["pos"]):
        first.setdefault((r["repository_id"], r["sha"].lower()), (r["sha"], (r["parents"] or [""])[0] or ""))
    want = {}
    for (repo, k), (sha, _) in first.items():
        path, seen, at = [], set(), (repo, k)
        while at in first and at not in seen:
            seen.add(at)
            path.append(first[at][0])
            at = (repo, first[at][1].lower())
        want[(repo, sha)] = None if at in seen else path[::-1]
    got = problems.QUERIES["p1_full_paths"](spark, d).collect()
    assert {(r["repository_id"], r["sha"]): r["path"] and r["path"].split("/") for r in got} == want and len(got) == len(want)
    pairs = [tuple(r) for r in problems.QUERIES["p1_descendants"](spark, d).collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == {(repo, up, sha) for (repo, sha), p in want.items() if p for up in p[:-1]}
