"""Host pages, the changeset, the queue order and the schedule on small inputs whose outcome is known."""

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from annalist.operators import changeset, docloop, graph
from annalist.schemas import DOCUMENTATIONS
from annalist.sources import host
from annalist.streaming import push


def pages(spark, rows):
    return spark.createDataFrame(rows, host.PAGES)


def test_pages_that_failed_or_cannot_be_read_have_no_rows(spark):
    rows = pages(spark, [
        ("o/a", "branches", None, 0, 200, '[{"name": "m", "commit": {"sha": "1"}}, {"name": "n"}]'), ("o/b", "branches", None, 0, 404, '[{"name": "m"}]'), ("o/c", "branches", None, 0, 200, "{"),
        ("o/d", "branches", None, 0, 200, None), ("o/a", "repository", None, 0, 200, '{"default_branch": "m"}'), ("o/b", "repository", None, 0, 500, None),
        ("o/a", "commit", "s1", 0, 200, '{"files": [{"filename": "a.py", "status": "added"}, {"filename": "b.py", "status": "renamed"}]}'), ("o/a", "commit", "s2", 0, 200, "{}"),
        ("o/a", "file:x/a.py", "m", 0, 200, "text"), ("o/a", "file:x/b.py", "m", 0, 404, "no"),
    ])
    assert {tuple(r) for r in host.branches(rows).collect()} == {("o/a", "m", "1"), ("o/a", "n", None)}
    assert {tuple(r) for r in host.default_branches(rows).collect()} == {("o/a", "m"), ("o/b", None)}
    assert {tuple(r) for r in host.commit_files(rows).collect()} == {("o/a", "s1", "added", "a.py"), ("o/a", "s1", "renamed", "b.py")}
    assert {tuple(r) for r in push.statuses(host.commit_files(rows), ["sha"]).collect()} == {("s1", "added", "a.py")}
    assert {tuple(r) for r in host.file_texts(rows).collect()} == {("o/a", "m", "x/a.py", "text"), ("o/a", "m", "x/b.py", "")}
    assert host.branches(rows.limit(0)).count() == host.commits(rows.limit(0)).count() == 0


def test_a_listing_ends_at_its_first_failed_or_short_page(spark):
    item = lambda i: f'{{"sha": "{i}", "commit": {{"message": "a\\nb", "author": {{"name": "n"}}}}, "author": {{"login": ""}}, "parents": [{{"sha": "p"}}]}}'
    page = lambda *ids: "[" + ",".join(map(item, ids)) + "]"
    rows = pages(spark, [
        ("o/a", "commits", "m", 0, 200, page(1, 2)), ("o/a", "commits", "m", 1, 200, page(3)), ("o/a", "commits", "m", 2, 200, page(4, 5)),
        ("o/b", "commits", "m", 0, 200, page(1, 2)), ("o/b", "commits", "m", 1, 502, page(3, 4)), ("o/b", "commits", "m", 2, 200, page(5, 6)),
        ("o/c", "commits", "m", 1, 200, page(1, 2)), ("o/d", "commits", "m", 0, 200, "[]"),
    ])
    got = host.commits(rows, 2).collect()
    assert sorted((r["full_name"], r["place"], r["sha"]) for r in got) == [("o/a", 0, "1"), ("o/a", 1, "2"), ("o/a", 2, "3"), ("o/b", 0, "1"), ("o/b", 1, "2")]
    assert {(r["message"], r["author"], tuple(r["parents"])) for r in got} == {("a", "n", ("p",))}


def test_unreadable_payloads_are_kept(spark):
    df = spark.createDataFrame([('{"repository": {"full_name": "o/a"}}',), ("{",), ("{}",), (None,)], "value string")
    assert push.parse(df).count() == 1 and {r["value"] for r in push.unreadable(df).collect()} == {"{", "{}", None}


def test_queue_order_is_kahns(spark, scratch):
    r = random.Random(4)
    n = 40
    deps = {c: {r.randrange(c) for _ in range(r.choice([0, 1, 2, 3]))} if c else set() for c in range(n)}
    name = list(range(n))
    r.shuffle(name)  # numbers say nothing about the order
    deps = {name[c]: {name[x] for x in xs} for c, xs in deps.items()}
    waits = {c: len(xs) for c, xs in deps.items()}
    queue, want = deque(sorted(c for c, w in waits.items() if not w)), []
    while queue:
        c = queue.popleft()
        want.append(c)
        for x in sorted(x for x, xs in deps.items() if c in xs):
            waits[x] -= 1
            if not waits[x]:
                queue.append(x)
    comps = spark.createDataFrame([(c, c) for c in deps], "n bigint, comp bigint")
    ce = spark.createDataFrame([(c, x) for c, xs in deps.items() for x in xs], "comp bigint, dep_comp bigint")
    got = graph.queue_order(scratch, scratch.cut(graph.levels(scratch, comps, ce)), ce).orderBy("seq").collect()
    assert [x["comp"] for x in got] == want and [x["seq"] for x in got] == list(range(n))
    assert graph.queue_order(scratch, graph.levels(scratch, comps.limit(0), ce), ce).count() == 0


FILES = "repository_id bigint, file_path string, status string, content string"
KNOWN = "repository_id bigint, file_path string, function_name string, content_hash string, is_deleted boolean"


def model():
    return docloop.Model(lambda code, context, issues: f"{len(code)}|{context}", lambda code, text: '{"approved": true, "score": 8}', sleep=lambda s: None)


def test_changeset_cases(spark, scratch):
    files = spark.createDataFrame([
        (1, "a.py", "added", "def f():\n    g()\n\ndef f():\n    h()\n"), (1, "b.py", "modified", ""), (1, "c.py", "modified", None), (1, "d.py", "removed", None), (1, "e.txt", "added", "text"),
        (1, "h.py", "modified", "x = 1\n"), (1, "i.py", "renamed", "def r():\n    pass\n"),
    ], FILES)
    known = spark.createDataFrame([(1, "b.py", "b", "x", False), (1, "c.py", "c", "x", False), (1, "d.py", "d", "x", False), (1, "d.py", "old", "x", True), (1, "h.py", "k", "x", False), (1, "z.py", "h", "x", False)], KNOWN)
    log = spark.createDataFrame([(9, 1, "h", "z.py", "about h", "c", 3, None, False)], DOCUMENTATIONS)
    out = changeset.process(scratch, model(), files, known, log, "s")
    assert {(r["id"], r["function_name"], r["content"], r["is_deleted"]) for r in out.appended.collect()} == {
        (10, "d", None, True), (11, "k", None, True), (12, "f", "16|# h (documentation):\nabout h", False),
    }
    assert {(r["file_path"], r["function_name"]): r["is_deleted"] for r in out.registry.collect()} == {("b.py", "b"): False, ("c.py", "c"): False, ("d.py", "d"): True, ("d.py", "old"): True, ("h.py", "k"): True, ("z.py", "h"): False, ("a.py", "f"): False}
    assert {r["file_path"]: r["outcome"] for r in out.files.collect()} == {"a.py": "processed", "b.py": "empty", "c.py": "empty", "d.py": "removed", "e.txt": "processed", "h.py": "processed", "i.py": "skipped"}
    none = changeset.process(scratch, model(), files.limit(0), known, log, "s")
    assert none.appended.count() == none.results.count() == 0 and none.registry.count() == 6


def test_concurrency_is_at_least_one(spark, scratch):
    tasks = spark.createDataFrame([(1, 1, "f", "code", "added", "")], "n bigint, comp bigint, name string, source string, mode string, existing_documentation string")
    levels, deps = spark.createDataFrame([(1, 0)], "comp bigint, level int"), spark.createDataFrame([], "n bigint, dep bigint")
    with pytest.raises(ValueError, match="concurrency"):
        docloop.run_levels(scratch, model(), tasks, deps, levels, concurrency=0)
    got = docloop.run_levels(scratch, model(), tasks, deps, levels, concurrency=1)
    assert got.select("documentation").first()[0] == "4|" and docloop.tallies(got).first().asDict() == {"documented": 1, "failed": 0}
    assert docloop.run_levels(scratch, model(), tasks.limit(0), deps, levels.limit(0)).agg(F.count(F.lit(1))).first()[0] == 0
