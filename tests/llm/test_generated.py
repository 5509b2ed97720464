"""Problem 4: kinds of files nobody wrote by hand, copies of libraries, shared subtrees."""

from annalist.llm import generated as g

HAND = "import a\n\ndef f(x):\n    y = g(x)\n    if y > 3:\n        return h(y)\n    return [y, x]\n\n" + "".join(f"def k{i}(a, b):\n    c{i} = a * {i}\n    {'for z in b:' if i % 2 else 'while a:'}\n        use(z, '{i}')\n    return c{i} {'+' if i % 3 else '-'} b\n\n" for i in range(4))


def test_headers():
    marks = ["# Code generated by x. DO NOT EDIT.", "# @generated by y", "# <auto-generated> z 1.0 </auto-generated>", "# This file was generated by x 2.1; changes will be lost.", "# AUTOGENERATED FILE - edit x.schema instead", "# Do not edit by hand! Source of truth: x.yaml", "# Generated from a.idl on 2024-01-01, do not modify", "# Automatisch erzeugt mit x, nicht von Hand ändern", "# Fichier produit par x : ne pas modifier", "# This file is machine-written. Run `make x` to refresh it."]
    for m in marks:
        assert g.layout_kind("a.py", m + "\n" + HAND) == "generated", m
        assert g.layout_kind("a.js", m.replace("#", "/*!\n *", 1) + "\n */\nconst a = 1;\n") == "generated", m
    for m in ["# Reads reports generated by the x job.", "# Was generated by the x wizard once, rewritten by hand since.", '# Writes the header "DO NOT EDIT" into every file this module creates.', "# Checks that the @generated mark is present in x output."]:
        assert g.layout_kind("a.py", m + "\n" + HAND) is None, m
    assert g.layout_kind("a.py", HAND + '\n# Code generated by x. DO NOT EDIT.\ns = "@generated"\n') is None


def test_layouts():
    assert g.layout_kind("a.js", "!function(a){a.b=4}(c);" + "d&&e(f,'g');" * 60) == "minified"
    assert g.layout_kind("a.py", "T = [\n" + "    1, 2, 3, 4, 5, 6, 7, 8,\n" * 40 + "]\n") == "data"
    assert g.layout_kind("a.py", 'B = "' + "QUJDREVGR0g5+/" * 40 + '"\n') == "data"
    assert g.layout_kind("a.py", HAND + "T = [1, 2, 3, 4, 5, 6, 7, 8]\n") is None
    assert g.layout_kind("a.py", HAND + 'Q = "select ' + ", ".join(f"t.c{i}" for i in range(90)) + ' from t"\n') is None
    assert g.layout_kind("a.go", "package m\n" + "".join(f'func (m *A) Get{x}(v int) int {{\n    return m.f("{x}", v)\n}}\n\n' for x in "abcdefghij")) == "generated"
    assert g.layout_kind("a.yaml", "# @generated\na: 1\n") is None and g.layout_kind("a.py", " \n") is None


def frames(spark, tasks, lib):
    t = spark.createDataFrame(tasks, "task_id bigint, repository_id bigint, file_path string, source string").selectExpr("*", "'x' as kind", "'x' as windows", "1L as lib_file_id")
    return t, spark.createDataFrame(lib, "lib_file_id bigint, file_name string, source string").selectExpr("*", "'x' as content")


def test_copies_of_libraries(spark, scratch):
    lib = "".join(f"def lib{i}(a):\n    v{i} = a[{i}]\n    out = call_{i}(v{i})\n    return out\n\n" for i in range(12))
    altered = "# patched\r\n" + lib.replace("    ", "\t").replace("call_3", "mine").replace("\n", "\r\n")
    part = HAND + lib.split("def lib1")[0]
    tasks = [(1, 1, "v/a.py", lib), (2, 2, "b.PY", altered), (3, 1, "c.py", part), (4, 1, "d.py", HAND), (5, 1, "e.py", None), (6, 1, "f.py", ""), (7, 1, None, lib), (8, 1, "g.yaml", lib), (9, 3, "v/a.py", lib), (9, 3, "v/a.py", lib)]
    t, l = frames(spark, tasks, [(5, "a.py", lib), (6, "b.py", "")])
    got = {r["task_id"]: (r["reason"], r["lib_file_id"]) for r in g.not_hand_written(t, l, scratch).collect()}
    assert got == {1: ("vendored", 5), 2: ("vendored", 5), 3: (None, None), 4: (None, None), 6: (None, None), 9: ("vendored", 5)}
    assert g.not_hand_written(t.limit(0), l, scratch).count() == 0
    assert g.not_hand_written(t, l.limit(0), scratch).filter("reason = 'vendored'").count() == 0


def test_merkle_directories(spark, scratch):
    rows = [(1, "x/lib/a.py", 10), (1, "x/lib/s/b.py", 20), (1, "m.py", 1), (2, "y/z/q/a.py", 10), (2, "y/z/q/s/b.py", 20), (2, "m.py", 2), (3, "k/a.py", 10), (3, "k/s/b.py", 21), (3, "k/s/b.py", 21)]
    d = scratch.cut(g.merkle_directories(spark.createDataFrame(rows, "tree bigint, path string, content bigint"), scratch))
    by = {(r["tree"], r["dir"]): (r["hash"], r["files"]) for r in d.collect()}
    assert by[(1, "x/lib")] == by[(2, "y/z/q")] != by[(3, "k")] and by[(1, "x/lib")][1] == 2 and by[(1, "x/lib/s")] == by[(2, "y/z/q/s")]
    owners = spark.createDataFrame([(1, "o1"), (2, "o2"), (3, "o3")], "tree bigint, owner string")
    assert sorted(r["files"] for r in g.shared_subtrees(d, owners).collect()) == [1, 2]
    assert g.shared_subtrees(d, spark.createDataFrame([(1, "o"), (2, "o"), (3, "o")], "tree bigint, owner string")).count() == 0
    assert g.merkle_directories(spark.createDataFrame([], "tree bigint, path string, content bigint"), scratch).count() == 0


def test_shared_subtrees_are_vendored(spark, scratch):
    """Copies among repositories of different owners that no library file holds; the rest stays hand-written."""
    a, b = HAND.replace("k", "p"), HAND.replace("k", "q")
    own = [HAND.replace("g(x)", f"own_{i}(x)").replace("use(", f"use_{i}(") for i in range(4)]
    tasks = [(10, 1, "x/dep/a.py", a), (11, 1, "x/dep/s/b.py", b), (12, 1, "m.py", own[0]), (20, 2, "y/z/a.py", a), (21, 2, "y/z/s/b.py", b), (22, 2, "m.py", own[1]), (30, 3, "k/c.py", own[2]), (31, 3, "e/__init__.py", "\n"), (40, 4, "j/c.py", own[2]), (41, 4, "e/__init__.py", "\n"), (42, 4, "n/t.py", "import os\n"), (50, 2, "n/t.py", "import os\n")]
    t, l = frames(spark, tasks, [(5, "a.py", "def other():\n    return 1\n")])
    owners = spark.createDataFrame([(1, "o1"), (2, "o2"), (3, "o3"), (4, "o3")], "tree bigint, owner string")
    got = {r["task_id"]: (r["reason"], r["lib_file_id"]) for r in g.not_hand_written(t, l, scratch, owners).collect()}
    assert {k for k, v in got.items() if v == ("vendored", None)} == {10, 11, 20, 21}
    assert all(v == (None, None) for k, v in got.items() if k not in (10, 11, 20, 21)) and len(got) == len(tasks)


def test_equal_repositories_up_to_the_root(spark, scratch):
    d = g.merkle_directories(spark.createDataFrame([(1, "a.py", 1), (1, "x/b.py", 2), (2, "a.py", 1), (2, "x/b.py", 2), (3, "y/a.py", 1), (3, "y/x/b.py", 2)], "tree bigint, path string, content bigint"), scratch)
    by = {(r["tree"], r["dir"]): r["hash"] for r in d.collect()}
    assert by[(1, "")] == by[(2, "")] == by[(3, "y")] != by[(3, "")]
