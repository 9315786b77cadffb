"""Known answers of the JavaScript tree, where reading tokens alone goes wrong."""

import pytest

from larkspur.sources import javascript, js_tree


def calls(source):
    return [(r[0], r[1]) for r in javascript.analyse(source) if r[0] in ("call", "new") and r[1] != "require"]


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ("const cp = require('child_process'); function f(cp) { cp.exec(x) }", [("call", "cp.exec")]),
        ("const cp = require('child_process'); { let cp = fake; cp.exec(x) } cp.fork(y)", [("call", "cp.exec"), ("call", "child_process.fork")]),
        ("let cp; function load() { cp = require('child_process') } cp.exec(x)", [("call", "child_process.exec")]),
        ("function f() { var h = require('https'); if (1) { h.get(u) } } h.get(v)", [("call", "https.get"), ("call", "h.get")]),
        ("const cp = require('child_process'); cp?.exec?.('ls')", [("call", "child_process.exec")]),
        ("class A { #cp = require('child_process'); run() { return this.#cp.exec('x') } }", [("call", "this.#cp.exec")]),
        ("class B extends A { constructor() { super(); fetch(u) } }", [("call", "super"), ("call", "fetch")]),
        ("const { exec: run = d, ...rest } = require('child_process'); run(x); rest.spawn(y)", [("call", "child_process.exec"), ("call", "child_process.spawn")]),
        ("import d, { get as g, default as e } from 'https'; import * as all from 'dns'; g(u); d.request(v); e.put(w); all.lookup(h)", [("call", "https.get"), ("call", "https.request"), ("call", "https.put"), ("call", "dns.lookup")]),
        ("const f = async ({ a }, [b]) => { await a(b); }; f(1)", [("call", "a"), ("call", "f")]),
        ("x = a ?? eval; y ||= eval(b); `${eval(c)}`", [("call", "eval"), ("call", "eval")]),
        ("var s = 'eval(x)', r = /eval(y)/, t = a / eval(z) / 2", [("call", "eval")]),
        ("new Function('a'); new WebSocket; new (f())(1)", [("new", "Function"), ("new", "WebSocket"), ("call", "f")]),
        ("(0, eval)(code); window['eval'](x)", [("call", "window.<computed>")]),
        ("function eval_(){} function g() { return\neval(x) }", [("call", "eval")]),
        ("if (a) /x/.test(b); else c()", [("call", "c")]),
        ("\\u0065val(x)", [("call", "eval")]),
    ],
)
def test_calls(source, want):
    assert calls(source) == want


def test_marks_of_calls():
    rows = {r[1]: r[3] for r in javascript.analyse("const d = require('dns'); eval(g(atob(s))); d.lookup(`a`); h('t'); require(n); k(...a); m(/r/)") if r[0] == "call"}
    assert rows == {"require": "computed,direct", "eval": "computed,decoded", "g": "computed,decoded", "atob": "computed", "dns.lookup": "computed", "h": "text", "k": "computed", "m": ""}


def test_environment_literals_and_arrays():
    rows = javascript.analyse("send(process.env); a = process.env.HOME; ({ ...process.env }); const x = {'key': 'v', get: 1}; import 'mod'; y = [" + "'s'," * 30 + "]; [" + "'s'," * 24 + "]; `p${q}r`")
    assert [r[1] for r in rows if r[0] == "env"] == ["whole", "one", "whole"]
    assert [r[3] for r in rows if r[0] == "array"] == ["30"]
    assert [r[3] for r in rows if r[0] == "literal" and r[3] != "s"] == ["key", "v", "mod", "p", "r"]


TODAY = [
    "class A { static #n = 0; static { this.#n = 1 } get x() { return this.#n } async *gen() { yield* b } 'k'() {} [c] = 1 }",
    "for await (const [k, v] of Object.entries(o)) { if (k) continue; else break }",
    "try { a() } catch { b() } finally { c() }",
    "const big = 1_000n ** 2n, h = 0xFF_FFn; a &&= b; c ??= d?.[e]?.(f)",
    "export default async function* () { const m = await import('./x.mjs'); }\nexport { a as b }; export * as ns from 'y'",
    "label: for (var i = 0, n = 5; i < n; i++) { do { x() } while (y) switch (z) { case 1: default: break label } }",
    "({ get a() { return 1 }, set a(v) {}, async b() {}, *c() {}, [d]: 1, 'e': 2, 3: 4, get: 5, async, ...f })",
    "const g = async x => ({ ...x, y: (a, b = 2, ...c) => a ? b : d => e })",
    "#!/usr/bin/env node\nlet x = tag`a${`b${c}`}`\n(function () { return new.target })",
]


@pytest.mark.parametrize("source", TODAY)
def test_present_syntax_has_a_tree(source):
    assert all(r[0] != "parse_failed" for r in javascript.analyse(source))


@pytest.mark.parametrize("source", ["(" * 290 + "1" + ")" * 290, "a" + ".b(c)" * 3000, "+".join(["'a'"] * 5000), "if (a) b(); else " * 1500 + "c()", "x = " + "!" * 250 + "y"])
def test_long_and_nested_sources(source):
    js_tree.parse(source)
    assert all(r[0] != "parse_failed" for r in javascript.analyse(source))


@pytest.mark.parametrize("source", ["(" * 301 + ")" * 301, "[" * 400 + "]" * 400, "f(", "a b", "var", "()", "`${a", "class A { b c }", "import x", "\"open\n\""])
def test_broken_sources_fall_back_to_their_text(source):
    assert javascript.analyse(source) == [("parse_failed", None, 0, ""), ("literal", None, 0, source)]
