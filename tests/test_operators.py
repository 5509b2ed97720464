"""Operators without SQL: scans, graphs, extraction, the loop, streams, sources."""

import json
import random

import pytest
from pyspark.sql import functions as F

from annalist.operators import commits, docloop, extract, graph, logs, registry, scan
from annalist.streaming import push


def test_running_sum_and_numbers(spark, scratch):
    r = random.Random(1)
    rows = [(r.choice(["hot", "hot", "a", None]), i, r.randrange(5)) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, o bigint, v bigint")
    got = {(x["g"], x["o"]): x["s"] for x in scan.running_sum(scratch, df, ["g"], ["o"], "v", "s").collect()}
    for g, o, _ in rows:
        assert got[(g, o)] == sum(v for a, b, v in rows if a == g and b < o)
    numbers = scan.row_numbers(scratch, df, ["o"]).collect()
    assert sorted(x["row_no"] for x in numbers) == list(range(500))
    prev = {(x["g"], x["o"]): x["p"] for x in scan.previous(df, ["g"], "o", F.col("v"), "p", 7).collect()}
    age = {(x["g"], x["o"]): x["n"] for x in scan.numbered(df, ["g"], "o", "n", True, 7).collect()}
    for g in ("hot", "a", None):
        own = [(o, v) for a, o, v in rows if a == g]
        for k, (o, _) in enumerate(own):
            assert prev[(g, o)] == (own[k - 1][1] if k else None)
            assert age[(g, o)] == len(own) - k


@pytest.mark.parametrize("seed", [1, 2])
def test_components_both_ways(spark, scratch, seed):
    r = random.Random(seed)
    n = 14
    edges = [(r.randrange(n), r.randrange(n)) for _ in range(18)]
    nodes, e = spark.range(n).withColumnRenamed("id", "n"), spark.createDataFrame(edges, "n bigint, dep bigint")
    reach = {a: {a} for a in range(n)}
    for _ in range(n):
        for a, b in edges:
            for s in reach.values():
                if a in s:
                    s.add(b)
    want = {a: min(b for b in range(n) if b in reach[a] and a in reach[b]) for a in range(n)}
    for small in (graph.SMALL, 0):
        comps = scratch.cut(graph.components(scratch, nodes, e, small))
        assert {x["n"]: x["comp"] for x in comps.collect()} == want
        ce = graph.component_edges(comps, e)
        pairs = {(want[a], want[b]) for a, b in edges if want[a] != want[b]}
        lv = {x["comp"]: x["level"] for x in graph.levels(scratch, comps, ce, small).collect()}
        bl = {x["comp"]: x["level"] for x in graph.bottom_levels(scratch, comps, ce, small).collect()}
        assert set(lv) == set(want.values())
        for c in lv:
            assert lv[c] == max([lv[d] + 1 for x, d in pairs if x == c], default=0)
            assert bl[c] == max([bl[x] + 1 for x, d in pairs if d == c], default=1)
    order = {x["comp"]: x["seq"] for x in graph.topological_order(graph.levels(scratch, comps, ce), scratch).collect()}
    assert all(order[d] < order[x] for x, d in pairs) and sorted(order.values()) == list(range(len(order)))
    with pytest.raises(ValueError, match="acyclic"):
        graph.levels(scratch, spark.range(2).withColumnRenamed("id", "comp"), spark.createDataFrame([(0, 1), (1, 0)], "comp bigint, dep_comp bigint"), 0)


def names(path, source):
    return [(f["name"], f["callees"], f["has_error"]) for f in extract.functions_of(source, path)]


def test_extraction():
    assert names("a.py", "@d(y())\ndef f(a=g()):\n    def inner():\n        return h()\n    z.m(k(1))\n    return lambda q: lam(q)\n") == [("f", ["g", "m", "k", "lam"], False), ("inner", ["h"], False)]
    assert names("b.py", "def ok():\n    return a()\n\ndef bad(x:\n    return b()\n") == [("ok", ["a"], False), ("bad", [], True)]
    js = 'import x from "y";\nconst f = async (p) => { q(p); list.map(v => hidden(v)); new Thing(); };\nclass C { constructor() { init() } go(a) { this.run("(" + a); } }\nuse(function () { lost() });\nfunction* gen() { yield nxt() }\n'
    assert names("a.js", js) == [("f", ["q", "map"], False), ("constructor", ["init"], False), ("go", ["run"], False), ("gen", ["nxt"], False)]
    assert names("a.ts", "export function f(a: string, b: Map<string, number>): Promise<string> { return g(a); }") == [("f", ["g"], False)]
    assert names("a.go", 'package m\nfunc (s *Store) Get(k string) map[string]int {\n\tif k == "(" { s.hit(k) }\n\treturn other(k)\n}\n') == [("Get", ["hit", "other"], False)]
    assert names("A.java", "public class A { public A(int a) { super(a); setup(); } List<X> get(String k) throws E { return new HashMap<>(find(k)); } }") == [("A", ["setup"], False), ("get", ["HashMap", "find"], False)]
    cpp = "static bool foo(const std::string& s) { return bar(s) && o.baz(1); }\nint& Foo::ref(int a) const { return a::b::call(a); }\nFoo::Foo(int a) : a_(a), b_{1} { init(); }\nint broken(int a) { if (a) { call();\n"
    got = names("a.CPP", cpp)
    assert got[:2] == [("foo", ["bar", "baz"], False), ("Foo::ref", ["call"], False)]
    assert got[2][0] == "Foo::Foo" and "init" in got[2][1] and got[3] == ("broken", ["call"], True)
    assert names("a.txt", "def f(): pass") == [] and names("a.py", None) == [] and names("a.py", "") == []


def test_lanes():
    rows = [("m", ["a", "b"]), ("a", ["r"]), ("b", ["r"]), ("r", [])]
    assert commits.assign_lanes(rows) == [0, 0, 1, 0]
    assert commits.assign_lanes([("c", ["b"]), ("b", ["a"]), ("a", [])]) == [0, 0, 0]
    assert commits.assign_lanes([("o", ["x", "y", "z"]), ("y", []), ("n", []), ("z", []), ("x", [])]) == [0, 1, 1, 2, 0]


def plain_lanes(rows):
    lanes, out = [], []
    for sha, parents in rows:
        mine = lanes.index(sha) if sha in lanes else lanes.index(None) if None in lanes else len(lanes)
        lanes = [None if x == sha else x for x in lanes] + [None] * (mine == len(lanes))
        out.append(mine)
        lanes[mine] = parents[0] if parents else None
        for p in parents[1:]:
            if p not in lanes:
                i = lanes.index(None) if None in lanes else len(lanes)
                lanes[i : i + 1] = [p]
    return out


def test_lanes_of_all_rows(spark, scratch):
    r = random.Random(3)
    lists = {}
    for repo, n in ((1, 6000), (2, 40), (None, 15), (3, 7)):
        lists[repo] = [(f"s{i}", [f"s{i + r.randrange(1, 9)}" for _ in range(r.choice([0, 1, 1, 1, 2, 3]))]) for i in range(n)]
    df = spark.createDataFrame([(k, i, s, p) for k, x in lists.items() for i, (s, p) in enumerate(x)], "repository_id bigint, row int, sha string, parents array<string>")
    want = {(k, i, s): lane for k, x in lists.items() for i, ((s, _), lane) in enumerate(zip(x, plain_lanes(x)))}
    for got in (commits.lanes(scratch, df), commits.lanes(scratch, df.filter("row < 40"), 7)):
        rows = {(x["repository_id"], x["row"], x["sha"]): x["lane"] for x in got.collect()}
        assert len(rows) in (len(want), 102) and all(want[k] == v for k, v in rows.items())
    assert commits.lanes(scratch, df).count() == len(want) and commits.lanes(scratch, df.limit(0)).count() == 0


def test_loop_and_levels(spark, scratch):
    def generate(code, context, issues):
        if code == "boom":
            raise RuntimeError("no")
        return f"doc of {code}" + (" better" if issues else "") + (" with " + context.replace("\n", "|") if context else "")

    def critique(code, text):
        ok = "better" in text or code != "picky"
        return "Sure! " + json.dumps({"approved": ok and code != "never", "issues": ["more"], "score": 9 if ok else 3}) + " Done."

    model = docloop.Model(generate, critique, lambda c, e: "keep" if e == "fine" else "regenerate", lambda s: None)
    assert docloop.document_one(model, "x", "modified", "fine", "")["written"] is False
    assert docloop.document_one(model, "picky", "added", "", "")["iteration"] == 2
    last = docloop.document_one(model, "never", "added", "", "")
    assert (last["iteration"], last["approved"], last["written"]) == (3, False, True)
    assert docloop.run_component(model, [{"source": "boom", "mode": "added", "existing_documentation": "", "context": ""}])[1:] == ("RuntimeError: no", 3)
    with pytest.raises(KeyError):
        docloop.parse_reply("{}")
    tasks = spark.createDataFrame([(0, 0, "a", "leaf", "added", None), (1, 1, "b", "boom", "added", ""), (2, 2, "c", "top", "added", ""), (3, 3, "d", "m1", "added", ""), (4, 3, "e", "m2", "added", "")], "n bigint, comp bigint, name string, source string, mode string, existing_documentation string")
    deps = spark.createDataFrame([(2, 0), (2, 1), (3, 4), (4, 3)], "n bigint, dep bigint")
    levels = spark.createDataFrame([(0, 0), (1, 0), (3, 0), (2, 1)], "comp bigint, level int")
    got = {r["name"]: r for r in docloop.run_levels(scratch, model, tasks, deps, levels, spark.createDataFrame([(0, "ext", "known")], "n bigint, name string, text string")).collect()}
    assert got["a"]["documentation"] == "doc of leaf with # ext (documentation):|known"
    assert got["b"]["error"] and got["b"]["attempts"] == 3
    assert got["c"]["documentation"].startswith("doc of top with # a (documentation):|doc of leaf")
    assert got["d"]["documentation"] == "doc of m1 with # e (source):|m2"
    t = docloop.tallies(docloop.run_levels(scratch, model, tasks, deps, levels)).first()
    assert (t["documented"], t["failed"]) == (4, 1)


def test_push_parsing_and_stream(spark, tmp_path):
    full = {"repository": {"full_name": "o/r"}, "pusher": {"name": "p"}, "ref": "refs/heads/refs/heads/x", "after": "s", "commits": [{"added": ["a.py", "b.md"], "removed": ["c.go"]}, {"added": ["a.py"], "modified": ["d.ts", "e.PY"]}]}
    payloads = [json.dumps(full), json.dumps({"repository": {"full_name": "o/q"}}), "not json", "{}"]
    got = push.parse(spark.createDataFrame([(p,) for p in payloads], "value string"))
    rows = {r["full_name"]: r for r in got.collect()}
    assert set(rows) == {"o/r", "o/q"} and rows["o/r"]["branch"] == "x" and rows["o/q"]["commits"] == [] and rows["o/q"]["pusher"] == ""
    files = {tuple(r) for r in push.changed_files(got, ["full_name"]).collect()}
    assert files == {("o/r", "added", "a.py"), ("o/r", "removed", "c.go"), ("o/r", "modified", "d.ts")}
    land = tmp_path / "in"
    land.mkdir()
    (land / "1.json").write_text(payloads[0])
    (land / "2.json").write_text(payloads[1])
    out = str(tmp_path / "out")
    q = push.start(push.push_stream(spark, str(land), 1), out, str(tmp_path / "cp"), lambda p: {"files": push.changed_files(p, ["full_name"])})
    q.processAllAvailable()
    q.stop()
    assert {tuple(r) for r in spark.read.parquet(f"{out}/files").drop("batch").collect()} == files
    assert spark.read.parquet(f"{out}/notifications").count() == 2


def test_replay_equals_prefix_and_rest(spark):
    steps = spark.createDataFrame([(f"s{i}", i) for i in range(5)], "sha string, step int")
    files = spark.createDataFrame([("s1", "added", "a.py"), ("s1", "renamed", "b.py"), ("s3", "removed", "c.md")], "sha string, status string, file_path string")
    seen, marks = [], []
    n = push.replay(spark, steps, lambda sha, f: seen.append((sha, f.count())), marks.append, files)
    assert n == 5 and marks == [f"s{i}" for i in range(5)] and seen == [("s0", 0), ("s1", 1), ("s2", 0), ("s3", 0), ("s4", 0)]


def test_log_append_and_registry(spark, scratch):
    from annalist.schemas import DOCUMENTATIONS

    log = spark.createDataFrame([(7, 1, "f", "a.py", "d", "c", 3, None, False)], DOCUMENTATIONS)
    new = spark.createDataFrame([(1, "g", "a.py", "x", "c2", 5, None, 2), (1, "h", "a.py", "y", "c2", 5, None, 1)], "repository_id bigint, function_name string, file_path string, content string, commit_sha string, score int, is_deleted boolean, seq bigint").withColumn("created_at", F.lit(None).cast("timestamp_ntz"))
    got = {r["function_name"]: (r["id"], r["is_deleted"]) for r in logs.append(log, new, scratch).collect()}
    assert got == {"h": (8, False), "g": (9, False)}
    fns = spark.createDataFrame([(1, "a", "f", "h1", 0), (1, "a", "g", "h2", 1), (1, "a", "f", "h3", 2)], "repository_id bigint, file_path string, function_name string, content_hash string, pos bigint")
    assert {(r["function_name"], r["content_hash"], r["pos"]) for r in registry.last_wins(fns).collect()} == {("f", "h3", 0), ("g", "h2", 1)}


def test_code_tree(spark, tmp_path):
    from annalist.sources.code_tree import CodeTree

    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "__init__.py").write_text("x")
    (tmp_path / ".h.py").write_text("y")
    spark.dataSource.register(CodeTree)
    got = {tuple(r) for r in spark.read.format("code_tree").load(str(tmp_path)).collect()}
    assert got == {("p/__init__.py", "x"), (".h.py", "y")}


def test_create_all(spark, tmp_path):
    from annalist.schemas import create_all

    create_all(spark, f"file://{tmp_path}")
    create_all(spark, f"file://{tmp_path}")
    assert spark.read.parquet(f"{tmp_path}/documentations.parquet").count() == 0


def test_task_graph_against_brute_force(spark, scratch):
    """Components, levels and order of the real calls of all queued files, in one task and in rounds."""
    from annalist.plans import catalog

    d = "/root/testdata/sf0.001"
    key = lambda r: (r["repository_id"], r["file_path"], r["name"])
    where = {key(r): (r["n"], r["comp"]) for r in catalog.task_components(spark, d).collect()}
    broken = catalog.task_functions(spark, d).filter("not has_error").join(spark.read.parquet(f"{d}/function_tasks.parquet").select("task_id", "repository_id"), "task_id")
    assert set(where) == {key(r) for r in broken.collect()} and len({n for n, _ in where.values()}) == len(where)
    pairs = {(key(r), (r["repository_id"], r["target_file"], r["target_name"])) for r in catalog.task_calls(spark, d).filter("kind = 'internal'").collect()}
    assert pairs
    links = {(where[a][0], where[b][0]) for a, b in pairs}
    to = {}
    for a, b in links:
        to.setdefault(a, set()).add(b)
    reach = {}
    for n, _ in where.values():
        seen, todo = {n}, [n]
        while todo:
            new = to.get(todo.pop(), set()) - seen
            seen |= new
            todo += new
        reach[n] = seen
    want = {n: min(m for m in reach[n] if n in reach[m]) for n in reach}
    assert dict(where.values()) == want
    nodes, edges = spark.createDataFrame([(n,) for n in want], "n bigint"), spark.createDataFrame(sorted(links), "n bigint, dep bigint")
    comps = scratch.cut(graph.components(scratch, nodes, edges, 0))
    assert {r["n"]: r["comp"] for r in comps.collect()} == want
    ce = {(want[a], want[b]) for a, b in links if want[a] != want[b]}
    of = {n: k[0] for k, (n, _) in where.items()}
    assert {(r["repository_id"], r["comp"], r["dep_comp"]) for r in catalog.task_component_edges(spark, d).collect()} == {(of[a], a, b) for a, b in ce}
    sizes = {r["comp"]: (r["repository_id"], r["size"]) for r in catalog.task_component_sizes(spark, d).collect()}
    assert sizes == {c: (of[c], list(want.values()).count(c)) for c in set(want.values())}
    lv = {r["comp"]: r["level"] for r in catalog.task_levels(spark, d).collect()}
    bl = {r["comp"]: r["level"] for r in catalog.task_bottom_levels(spark, d).collect()}
    for c in set(want.values()):
        assert lv[c] == max((lv[b] + 1 for a, b in ce if a == c), default=0) and bl[c] == max((bl[a] + 1 for a, b in ce if b == c), default=1)
    assert {r["comp"]: r["level"] for r in graph.levels(scratch, comps, graph.component_edges(comps, edges), 0).collect()} == lv
    order = catalog.task_order(spark, d).collect()
    seq = {r["comp"]: r["seq"] for r in order}
    assert all(seq[b] < seq[a] for a, b in ce) and set(seq) == set(lv)
    for repo in set(of.values()):
        assert sorted(r["seq"] for r in order if r["repository_id"] == repo) == list(range(sum(of[c] == repo for c in lv)))
    first = {(r["repository_id"], r["level"]): 0 for r in catalog.task_schedule(spark, d).collect()}
    assert set(first) == {(of[c], x) for c, x in lv.items()}


def test_extraction_of_long_heads_and_many_functions():
    """The text of a function reaches back over all of its head, and a file's functions cost their number, not its square."""
    import time

    notes = "".join(f'  @Note{i}("a {i}")\n' for i in range(60))
    got = extract.functions_of("class A {\n" + notes + "  public int f(int a) { return g(a); }\n}\n", "A.java")
    assert [(f["name"], f["callees"]) for f in got] == [("f", ["g"])] and got[0]["source"].count("@Note") == 60
    blanks = " " * 900
    got = extract.functions_of(f"const a ={blanks}async{blanks}(x) => {{ b(x) }}\nlet c ={blanks}function (y) {{ d(y) }}\n", "a.js")
    assert [(f["name"], f["callees"]) for f in got] == [("a", ["b"]), ("c", ["d"])]
    began = time.time()
    got = extract.functions_of("".join(f"function f{i}(x) {{ return g{i}(x) + (function () {{ return h(x) }})(); }}\n" for i in range(5000)), "a.js")
    assert len(got) == 5000 and got[7]["callees"] == ["g7"] and time.time() - began < 5
