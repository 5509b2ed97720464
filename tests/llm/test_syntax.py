"""Problem 3: files that parse and files that don't, in every language; Python against its own parser."""

import ast
import random

import pytest

from annalist.llm.syntax import flag_syntax, syntax_error, syntax_rates

VALID = {
    "a.py": 'def f(x):\n    """<<<<<<< kept\n    ("""\n    return f"{x!r:>{10}}"  # it\'s (\n',
    "a.js": "import { x } from './y.js';\n\n/* ( */\nconst f = async (a) => {\n  const r = /[({'\"\\/]+/g;\n  const t = `v ${a ? `n ${a}` : '}'} (\n<<<<<<< text\n`;\n  for (const k of a) { if (k / 2 > 1) { r.test(k) } }\n  return a ?? { b: 1, ...a };\n};\nexport default f\n",
    "min.js": '!function(a){a.b=4}(c);d&&e(f,"g");var h=function(i){for(var j=0;j<i.length;j++)k(i[j]);return i};m={n:1,o:"p",q:!0};',
    "a.ts": "export interface A {\n  size: number;\n  label?: string;\n}\nconst f = async (m: string[], n: Map<string, number>): Promise<void> => {\n  let x = m as unknown as string;\n};\n",
    "a.go": 'package m\n\nimport (\n\t"fmt"\n)\n\ntype A struct {\n\tx int\n}\n\nvar q = `it\'s (\n{`\n\nfunc (s *A) F(a map[string]int, b []string) (string, error) {\n\tfor _, i := range b {\n\t\tfmt.Println(i, \'(\')\n\t}\n\treturn "", nil\n}\n',
    "A.JAVA": 'package a.b;\n\nimport java.util.List;\n\n@Deprecated\npublic class A<T extends B> implements C {\n    private static final String X = "{(";\n    public A(int a) { super(a); }\n    List<String> f(int... a) throws E {\n        char c = \'"\';\n        if (a instanceof D) return null;\n        int[] z = new int[3];\n        return x -> { return 1; };\n    }\n}\n',
    "a.cpp": '#include <string>\n#define A(x) \\\n  f(x)\n\nnamespace n {\nstatic const char* s = R"x(" ( )x";\ntemplate <typename T> class C : public B {\n public:\n  explicit C(int a) : a_(a) {}\n  bool operator()(int x) const noexcept { return x < 1\'000; }\n};\nauto l = [=](int& x) mutable { return x; };\n}  // namespace n\n',
    "a.h": "#pragma once\nint f(const std::vector<int>& a);\nunsigned long long int x = 5;\n",
}
BROKEN = {
    "a.py": ["def f(:\n  pass\n", "x = (1\n", 's = "a\n', "<<<<<<< HEAD\n>>>>>>> x\n", "def f():\n", "import { a } from './b.js';\n", "a b c\n", 's = """x\n'],
    "a.js": ["function f(a {\n}\n", "const s = 'a\n", "if (a) {\n", "const a = [1, 2};\n", "def f(x):\n    return x\n", "package a;\n\nimport b.C;\n\npublic class C {\n}\n", "const x: string = 'a';\n", "interface A {\n  a: b;\n}\n", "/* open\n", "`a ${b", "const a =\n", "<!DOCTYPE html>\n<html></html>\n", "404: Not Found\n", "--- a/x\n+++ b/x\n@@ -1,2 +1,2 @@\n-a\n+b\n", "<<<<<<< ours\na()\n=======\nb()\n>>>>>>> theirs\n", "{% if a %}\nb()\n{% endif %}\n", "return \ufffd\ufffd;\n"],
    "a.ts": ["import a\nfrom b import c\n\ndef f(x):\n  return 1\n", "public int f() {\n  return 1;\n}\n", "func F(a int) string {\n  return a\n}\n", "#include <string>\nint a;\n", "class A {\n", "rate limit exceeded, retry after 2 seconds\n"],
    "a.go": ["package m\nfunc f() {\n", "func f() {}\n", "package a;\n\nimport b.C;\n", 'export function f() {\n  return "";\n}\n', "package m\nfunc f() { a := b ? c : d }\n", "package m\nvar s = `a\n"],
    "A.java": ["public class A {\n", "import a\n", "public class A { void f() { return 0 } }\n", "class A { String s = \"a; }\n", "def f(x):\n    return x\n", "const a = 1;\n", "package m\n\nfunc F() int {\n\treturn 1\n}\n", "../shared/x.java is stored elsewhere\n"],
    "a.cc": ["int f( {\n}\n", "int f() { return 1; \n", "def f(x):\n    return x\n", "package m\n\nfunc F(a string) int {\n\treturn 1\n}\n", "import { a } from './b';\n", "const x = require('y');\n", "int f() { return 0 }\n", "version https://x\n"],
}


@pytest.mark.parametrize("path", VALID)
def test_valid(path):
    for text in (VALID[path], VALID[path].replace("\n", "\r\n"), VALID[path].replace("    ", "\t")):
        assert syntax_error(path, text) is None


@pytest.mark.parametrize(("path", "text"), [(p, t) for p, ts in BROKEN.items() for t in ts])
def test_broken(path, text):
    assert syntax_error(path, text)
    assert syntax_error(path.upper(), text)


def test_python_agrees_with_its_parser():
    r = random.Random(1)
    base = VALID["a.py"] + "class A:\n    async def m(self, *a, **k):\n        return [x for x in a if (x, {1: 2}[1])]\n"
    for _ in range(400):
        s = list(base)
        for _ in range(r.randrange(3)):
            i = r.randrange(len(s))
            s[i] = r.choice(["", "(", ")", '"', ":", "\n", "x", " "])
        text = "".join(s)
        try:
            ast.parse(text)
            ok = True
        except (SyntaxError, ValueError):
            ok = False
        if text.strip():
            assert (syntax_error("a.py", text) is None) == ok or "<<<<<<<" in text


@pytest.mark.parametrize("path", ["a.js", "a.ts", "a.go", "A.JAVA", "a.cpp"])
def test_truncation_within_a_block_is_found(path):
    text = VALID[path]
    cut = max(text.rfind("return"), text.rfind("as unknown"))
    assert syntax_error(path, text[:cut])


def test_frames(spark):
    rows = [(1, 1, "a.py", "x = ("), (2, 1, "a.PY", "x = 1"), (3, 1, "a.py", None), (4, 1, "a.py", ""), (5, 1, "a.yaml", "("), (6, None, None, "("), (7, 2, "a.go", "(" * 200_000), (8, 2, "a.go", " \n")]
    df = spark.createDataFrame(rows, "task_id bigint, repository_id bigint, file_path string, source string").selectExpr("*", "'c' as language", "'c' as syntax_problem")
    out = flag_syntax(df)
    assert {r["task_id"] for r in out.filter("syntax_problem is not null").collect()} == {1, 7}
    rates = {(r["repository_id"], r["language"]): (r["files"], r["invalid"], r["rate"]) for r in syntax_rates(out).collect()}
    assert rates == {(1, "python"): (3, 1, 0.333333), (2, "go"): (2, 1, 0.5)}
    assert flag_syntax(df.limit(0)).count() == 0
