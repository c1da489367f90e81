"""Source structure in languages other than Python, on hand-written files."""

import pytest

from tallygraph.functions.arrow import structure_of
from tallygraph.functions.scanners import scan

TS = """// tax tools
import { Rate as R, Base } from "./rate";
import * as fs from 'fs';
/** Computes a tax. */
export function computeTax(order: Order, rate: R): number { return apply(order) * rate.x; }
export const apply = async (o: Order) => { return fs.read(`}`); };
export interface Order { total: number }
export class Ledger extends Base implements Order {
  // adds one
  add(o: Order): void { if (o) { this.items.push(computeTax(o, null)); } }
}
"""
GO = """package main
import (
  "fmt"
  str "strings"
)
// Ledger holds rows.
type Ledger struct { rows []Order }
type Order struct { n int }
func (l *Ledger) Add(o Order, n int) error { fmt.Println(o); return nil }
func main() { l := Ledger{}; l.Add(Order{}, 1); str.ToUpper("a}") }
"""
RUST = """use crate::base::{Base, Rate as R};
/// A ledger.
pub struct Ledger { rows: Vec<Order> }
pub struct Order { n: i32 }
impl Base for Ledger { fn add(&mut self, o: Order, n: usize) -> R { total(&o) } }
pub fn total<'a>(o: &'a Order) -> R { R::new('}') }
"""


def names(s):
    return [(x["kind"], x["name"], x["params"]) for x in s["symbols"]]


def edges(s, name):
    return {t: k for x in s["symbols"] if x["name"] == name for t, k in x["edges"]}


def test_typescript():
    s = scan(TS, "typescript")
    assert s["status"] == "clean" and s["doc"] == "tax tools" and s["imports"] == [["./rate", "R", "Rate"], ["./rate", "Base", "Base"], ["fs", "fs", "*"]]
    assert names(s) == [("function", "computeTax", ["order", "rate"]), ("function", "apply", ["o"]), ("class", "Order", []), ("class", "Ledger", []), ("method", "Ledger.add", ["o"])]
    assert edges(s, "computeTax") == {"Order": "uses_type", "R": "uses_type", "apply": "calls"}
    assert edges(s, "Ledger") == {"Base": "inherits", "Order": "inherits", "computeTax": "calls"}
    assert [x["doc"] for x in s["symbols"]] == ["Computes a tax.", "", "", "", "adds one"]
    assert s["symbols"][0]["signature"] == "export function computeTax(order: Order, rate: R): number"


def test_go():
    s = scan(GO, "go")
    assert [n for _, n, _ in names(s)] == ["Ledger", "Order", "Ledger.Add", "main"] and s["imports"] == [["fmt", "fmt", ""], ["strings", "str", ""]]
    assert edges(s, "Ledger.Add") == {"Ledger": "uses_type", "Order": "uses_type", "fmt": "calls"} and edges(s, "main")["str"] == "calls"


def test_rust():
    s = scan(RUST, "rust")
    assert [n for _, n, _ in names(s)] == ["Ledger", "Order", "Ledger.add", "total"] and s["imports"] == [["crate::base", "Base", "Base"], ["crate::base", "R", "Rate"]]
    assert edges(s, "Ledger")["Base"] == "inherits" and edges(s, "Ledger.add") == {"Order": "uses_type", "R": "uses_type", "total": "calls"}


@pytest.mark.parametrize(
    ("path", "source", "want"),
    [
        ("a.java", "class A extends B { int f(int x, C y) { return g(x); } }\nclass C { }", ["A", "A.f", "C"]),
        ("a.cs", "using S;\npublic class A : B { public int F(C o) { return 1; } }\nclass C { }", ["A", "A.F", "C"]),
        ("a.php", "<?php\n// c {\nclass A extends B { public function f(C $o, $n = 1) { return g($o); } }\nfunction g($o) { }", ["A", "A.f", "g"]),
        ("a.c", "#include \"b.h\"\nstruct C { int n; };\nstatic int f(struct C *o, int n) { return g(n); }\nint g(int n) { return n; }", ["C", "f", "g"]),
        ("a.cpp", "class A : public B { int f(C o) { return g(o); } };\nint g(C &o) { return 1; }", ["A", "A.f", "g"]),
        ("a.rb", "class A < B\n  def f(o)\n    if o\n      g(o)\n    end\n  end\nend\ndef g(o)\n  1\nend\n", ["A", "A.f", "g"]),
        ("a.jsx", "export default function F() { return 1; }\nfunction g(a, b) { return F(); }", ["F", "g"]),
        ("a.py", "class A:\n    def f(self):\n        pass", ["A", "A.f"]),
    ],
)
def test_names(path, source, want):
    s = structure_of(path, source)
    assert s["status"] == "clean" and [x["name"] for x in s["symbols"]] == want


@pytest.mark.parametrize(("path", "source"), [("a.js", "function a( { }"), ("a.ts", "x = 'abc\n'"), ("a.go", "/* open"), ("a.rs", "fn f() { ] }"), ("a.rb", "class A\n def f\n end\n"), ("a.py", "def f(:")])
def test_a_file_that_does_not_close_is_partial_and_has_no_symbols(path, source):
    assert structure_of(path, source) == {"status": "partial", "symbols": [], "imports": [], "doc": ""}


def test_other_and_empty_files():
    assert structure_of("a.txt", "x {")["status"] == structure_of(None, "x")["status"] == "unsupported"
    assert structure_of("a.go", None)["status"] == structure_of("a.ts", "")["status"] == "clean"


def test_hash_follows_the_body_and_not_the_layout():
    h = lambda src: scan(src, "java")["symbols"][0]["hash"]
    assert h("class A { int f() { return 1; } }") == h("class A {\n  int f() { return 1; }\n}") != h("class A { int f() { return 2; } }")
