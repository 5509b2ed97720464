"""Statement grammar: programs that are valid pass, and the smallest changes that make them invalid are found."""

import pytest

from annalist.functions.lexing import scan, skeleton, unbalanced
from annalist.llm import syntax
from annalist.llm.grammar import grammar_error

VALID = {
    "javascript": [
        'while (n --> 0) x();',
        'a: for(;;){ continue a; }',
        'label: for (;;) { continue label; }',
        'import x from "y" with { type: "json" };\n',
        "import a, {b as c} from 'x'\nexport default class {}\nexport * as d from 'e'",
        'const f = async ({a, b = 1}, ...c) => ({...a, [b]: c?.d ?? 0})',
        "class A extends B { static #x = 1; get y() { return this.#x } static { f() } async *g() {} 'q'() {} }",
        'if (a) b()\nelse c()',
        'do x++; while (x < 3)\ny()',
        'var a = 1\n  , b = 2\nlet c',
        "const o = { a, b() {}, get c() { return 1 }, async d() {}, 'e': 1, 3: 4, }",
        'x = a ? b : c\n(function(){})()',
        'for (const [k, v] of m) f(k)\nfor await (const x of y) {}',
        'return',
        'switch (a) { case 1: case 2: b(); break; default: c() }',
        'let x = /a/g.test(b) ? `x${a}y` : void 0',
        'try { a() } catch { b() } finally { c() }',
        "new Foo;\nthrow new Error('x')",
        'export const a = 1, b = () => {}\n',
        'a\n++b',
        'yield\nlet of = 1; of = of + 1',
        'async () => { await x }',
        'if (a) {} else if (b) {} else {}',
        'x = function () {} \n y = class {}',
        'async function* a(){ yield* b() }',
        'const {a: {b}} = c',
        'a = b\n/c/g',
        'delete a.b, void 0',
        'if (a) return; else b()',
        '`a`\nb',
        'var get = 1, set = 2, async = 3',
        'import.meta.url',
        'const a = b => c => d',
        'for (;;);',
        'while (a);',
        '({}).x',
        '[1,,2]',
        'f(a, b, )',
        '!function(){}()',
        'a?.[0]?.(b)',
        '(a, b) => { }',
        'label:\nfor(;;){}',
        'export { a as default, b }',
        'let x = a in b || c instanceof D',
        'if (x) ;',
    ],
    "typescript": [
        'class A { static accessor x = 1; private readonly y?: string; constructor(private a: B, public b = 2) { super() } abstract f(): void; declare z: number }',
        'function f<T extends keyof U = any>(x: T, y?: U[T]): x is string { return x as unknown as T }',
        "type A = | 'a' | 'b'\ntype B<T> = T extends (infer U)[] ? U : never",
        'interface A extends B<C>, D { a: string; b?: number\n  c(): void\n  readonly [k: string]: any; new (x: number): A; get d(): string }',
        "enum A { B = 1, C, D = 'x' }",
        "declare module 'x' { export function f(a: number): string; }",
        'let x = y!; let z = <any>y; const a = b satisfies C',
        'abstract class A<T> implements B<T> { protected abstract f(x: T): Promise<T[]>; static #p: number }',
        'type M = { readonly [K in keyof T]-?: T[K] }',
        "export type { A } from './a'\nimport type B from 'b'\nimport { type C } from 'c'",
        'function f(this: A, ...r: number[]): asserts x is B {}',
        'let t: [a: string, b?: number, ...c: boolean[]] = x',
        'const f = <T,>(x: T) => x',
        '@A({b: 1}) class C { @d() e: string; @f g() {} }',
        'namespace A.B { const c = 1 }',
        'let f: (a: number) => void = () => {}',
        'let u: unique symbol',
        'declare global { interface Window { a: any } }',
        'function f(a: string): string;\nfunction f(a: any) { return a }',
        "type T = typeof import('x')",
        'let x: A.B<C>[] | undefined\nlet y',
        'const a = b as const',
        'if (a!.b) c()',
        'for (const x of <any[]>y) {}',
        'export default interface A {}',
        'type F = new (...a: any[]) => object',
        'let o = { a: 1 } as B',
        'x = y ? (z as any) : w',
        'abstract class A { abstract get x(): number; set y(v) {} }',
        'declare const a: number',
        'type G = A<B<C>>;',
        'let v = a < b && c > d',
    ],
    "java": [
        'for (String x :\n   xs) { f(x); }',
        'class A<T extends B & C> extends D implements E<F[]>, G { private static final int[] x = {1, 2,}; @A(b = {1}) public <U> U f(final int a, String... b) throws X, Y { return (U) (int) b[0]; } }',
        'package a.b;\nimport static a.b.C.*;\npublic enum E { A(1) { void f() {} }, B; private final int x; E() {} }',
        'record P(int x, String y) implements Q { P { if (x < 0) throw new R(); } }',
        'class A { int f(Object o) { return switch (o) { case Integer i when i > 0 -> i; case String s -> { yield 1; } default -> 0; }; } }',
        'class A { Runnable r = () -> { }; Function<A, B> f = a -> b; Supplier<X> s = A::new; }',
        'class A { void f() { a: for (;;) { continue a; } if (x) y(); else z(); do { } while (x); try (A a = b; C c = d) { } catch (E | F e) { } finally { } } }',
        'class A { { init(); } static { x = 1; } abstract void g(); @Override public String toString() { return "a" + b; } }',
        '@interface A { int x() default 1; String[] y() default {}; }',
        'class A { List<? extends B> x = new ArrayList<>() {{ add(1); }}; int y = x >>> 2 >> 1; boolean b = c instanceof D d && e; }',
        'class A { void f() { int x = (int) y; String s = (String) z; assert x > 0 : "m"; synchronized (this) { } final var v = new int[3][]; char c = \'x\'; long l = 1L; throw new E(); } }',
        'sealed interface S permits A, B {}\nnon-sealed class A implements S {}',
        'class A { A(int x) { this(); super(x); } int a, b = 2; ; }',
        'class A { void f() { switch (x) { case 1: case 2: y(); break; default: } } }',
        'class A { void f() { if (a) ; for (;;) ; } }',
        'module a.b { requires transitive c; exports d to e; opens f; uses g; provides h with i; }',
        'class A { @B final int x = 1; public @C String f(@D int a) { return a > 0 ? "x" : null; } }',
        'class A { void f() { if (a) { } else if (b) { } else { } while (c) d(); return; } }',
    ],
    "cpp": [
        'class Foo :\n  public Bar, private virtual Baz {\n public:\n  Foo() : a(1), b{2} {}\n};',
        'for (auto x :\n  xs) f(x);',
        '#pragma once\nint x;\nMACRO(x)',
        'template <typename T, int N = 3> struct A<T*, N> : B<T> { using C = D; T* f() const noexcept override; static constexpr int x = 1; A& operator=(const A&) = default; ~A(); explicit operator bool() const; friend class E; };',
        'auto f = [&, x = 1](int a) mutable -> int { return a; };',
        'int a[] = {1, 2, 3,}; const char* s = "a" "b" PRId64 "c";',
        'namespace a::b { enum class E : int { A = 1, B }; } // x',
        'extern "C" { int f(void); }',
        'int main(int argc, char** argv) { if (x) y(); else z(); for (;;) ; do { } while (0); switch (a) { case 1: b(); break; default: c(); } return 0; }',
        'std::vector<std::pair<int, int>> v{{1, 2}, {3, 4}}; auto [a, b] = v[0];',
        'template <class... Ts> void f(Ts&&... ts) { (g(std::forward<Ts>(ts)), ...); }',
        "unsigned long long x = 1'000ULL; int* p = new int[3]; delete[] p; T&& r = std::move(t);",
        '#define A(x) x\nA(b)\nstatic inline int f() { return *p++ + -1; }',
        'Q_OBJECT\npublic slots:\n  void f();',
        'typedef struct { int a : 3; } S; int (*fp)(int, char) = &f;',
        'try { f(); } catch (const std::exception& e) { } catch (...) { }',
        'if constexpr (x) { } else if (auto y = f(); y) { }',
        'auto x = a < b ? c : d; y = (int)z; w = sizeof(int); q = a->b.c::d;',
        'bool operator==(const A& a, const B& b) { return a.x == b.x; } bool operator()(int x) const;',
        'template<> struct A<> {};',
        'int f() { return R; }\nMODULE_END()',
        'asm volatile("nop"); goto end; end: ;',
        'void f(int, char*, A&, B&&, ...);',
        'using A = void (*)(int); A a{}; const int& r = x; int const* const p = 0;',
        'static_assert(sizeof(A) == 4, "x"); [[nodiscard]] int f(); alignas(16) int x;',
        'class A { Q_OBJECT };',
        'concept C = requires(T t) { { t.f() } -> D; };',
    ],
    "go": [
        'package a\n\nimport (\n\t"b"\n\tc "d"\n)\n\nfunc (r *T) f(a, b int, c ...string) (x int, err error) {\n\tif v, ok := m[k]; ok && !v {\n\t\treturn 1, nil\n\t} else if z {\n\t}\n\tfor i := 0; i < 3; i++ {\n\t}\n\tfor range ch {\n\t}\n\tgo func() { x <- <-y }()\n\tdefer f()\n\tswitch t := v.(type) {\n\tcase int, string:\n\t\tfallthrough\n\tdefault:\n\t}\n\tselect {\n\tcase x := <-c:\n\tcase c <- 1:\n\t}\n\treturn\n}\n',
        'package a\ntype S struct {\n\tA, B int `json:"a"`\n\t*C\n\tD map[string][]*E\n\tF func(int) (string, error)\n\tG chan<- int\n}\ntype I interface {\n\tf(x int) error\n\t~int | ~string\n}\nvar x = []int{1, 2,\n\t3,\n}\nconst (\n\ta = iota\n\tb\n)\n',
        'package a\nfunc f[T any, U comparable](x T) *U { return &x[1:2][:3] }\nvar y = map[string]S{"a": {1, 2}, "b": {}}\nfunc g() {\nL:\n\tfor {\n\t\tbreak L\n\t}\n\tif x := f(); x != nil {\n\t\tpanic(x)\n\t}\n\t*p = 1\n\ta, b = b, a\n\tx.y.(T).z()\n}\n',
        'package a\nfunc f() {\n\tx := &T{\n\t\ta: 1,\n\t}\n\tfoo(a,\n\t\tb)\n\ts := x.\n\t\ty()\n}\n',
    ],
}
INVALID = {
    "java": [
        'class A { void f() { int x = 3 } }',
        'class A { void f() { if (x) } }',
        'class A { int x = 1 2; }',
        'class A { void f() { else { } } }',
        'class A { void f() { f(a, ); } }',
        'class A { void f() { x = ; } }',
        'class A { int x = * 3; }',
        'class A { int a b c; }',
        'class A { int x = 3 }',
    ],
    "cpp": [
        'int main() { if (x) }',
        'int x = 1 2;',
        'int f() { int x = 3 }',
        'void f() { else { } }',
        'int x = ;',
        'int f() { return a + ; }',
        'public class A { };',
        'void f() { x = a b c; }',
    ],
    "javascript": [
        'let x = 1 2',
        'else { }',
        'let x = ;',
        'foo(a b)',
        'if (x) }',
        'var a = b +',
        'x = = 3',
        'for (let i = 0; i < 3; i++ { }',
        'let a b',
        'f(,)',
        'if (a) else b()',
        "x = 'a' 'b'",
        'return return 1 2',
    ],
    "typescript": [
        'let x: number = 1 2',
        'else { }',
        'const a: = 3',
        'let a b: string',
    ],
    "go": [
        'package a\nvar x = 1 2\n',
        'package a\nfunc f() {\n\tx := 1 2\n}\n',
        'package a\nfunc f() {\n\tx := \n}\n',
        'package a\nfunc f() { a + }\n',
    ],
}


def error(lang, code):
    code = skeleton(code, scan(lang, code))
    if lang == "cpp":
        code = syntax.preprocessed(code)
    return unbalanced(code) or grammar_error(lang, code)


@pytest.mark.parametrize(("lang", "code"), [(k, x) for k, v in VALID.items() for x in v])
def test_valid(lang, code):
    assert error(lang, code) is None


@pytest.mark.parametrize(("lang", "code"), [(k, x) for k, v in INVALID.items() for x in v])
def test_invalid(lang, code):
    assert error(lang, code)


@pytest.mark.parametrize("lang", VALID)
def test_a_doubled_literal_or_lost_operand_is_found(lang):
    """Every valid program with a number put behind another one, or the operand behind an operator taken away."""
    import re

    for code in VALID[lang]:
        s = re.sub(r"(?<![\w.\"'`/])(= )(\d+)(?=[;,)\s])", r"\1\2 7", code, count=1)
        if s != code and "regex" not in code:
            assert error(lang, s), s
        s = re.sub(r"(?<![\w.\"'`/:])(= )(\d+)(?=[;])", r"\1", code, count=1)
        if s != code:
            assert error(lang, s), s


def test_long_code_takes_linear_time():
    import time

    began = time.time()
    assert error("java", "class A { void f() {" + " x = y(1, 2) + 3;" * 50_000 + "} }") is None
    assert time.time() - began < 10


MORE = [
    ("a.js", "#!/usr/bin/env node\nlet a = 1\n"),
    ("a.js", "switch (a) {\n  case 'x':\n    if (b) {\n      c = 1\n    }\n    break\n  case 'y':\n    return\n  default:\n}\n"),
    ("a.js", "const { a: b, c: d } = require('x')\nlet e = String.raw`\\a` + tag`b${c}d`\n"),
    ("a.js", "module.exports = {\n  a: Symbol.for('x'),\n  class: 1,\n  *b() {}\n}\ner = null\nis = false\n"),
    ("a.h", "#ifdef A\n#define F(x) do { \\\n  g(x); \\\n} while (0)\nstruct A {\n#else\nstruct B {\n#endif\n  int x;\n};\n#if 0\n}}}\n#endif\nNS_END()\n"),
    ("a.h", "#ifdef __cplusplus\nextern \"C\" {\n#endif\nchar **f(int **p, char **);\n#ifdef __cplusplus\n}\n#endif\n"),
    ("a.hpp", "namespace a _GLIBCXX_VIS { _GLIBCXX_BEGIN\n inline int f() _NOEXCEPT { return 1; }\n_GLIBCXX_END }\n"),
]


@pytest.mark.parametrize(("path", "code"), MORE)
def test_valid_files(path, code):
    assert syntax.syntax_error(path, code) is None


def test_no_text_makes_a_check_fail():
    import random

    r = random.Random(1)
    signs = "abX09 \n\t(){}[]<>;:,.=+-*/%&|^!?@#$`'\"\\_é\r\0"
    words = "if else for function class return => -> :: case switch do while const enum struct template operator #if #else #endif = 'x' \"y\" `z${ }` import func package".split()
    for _ in range(1500):
        s = "".join(r.choice(signs) for _ in range(r.randint(0, 80))) if r.random() < 0.5 else " ".join(r.choice(words) if r.random() < 0.7 else r.choice(signs) for _ in range(r.randint(0, 40)))
        for e in ("py", "js", "ts", "go", "java", "cpp"):
            syntax.syntax_error(f"a.{e}", s)
