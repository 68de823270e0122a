import pytest

from arborlens.sources.extract import extract, parse_source, part


def names(found):
    return {s["qualified_name"].split("::", 1)[1]: s for s in found.symbols}


PY = '''"""Doc with def fake(): inside."""
import os, json as j
from . import near
from ..pkg.mod import thing as other, more
from typing import *
if TYPE_CHECKING:
    from app.types import T

LIMIT = 3
_hidden: int = 4

@app.route("/x")
def handler(a, b=1) -> str:
    def inner():
        pass
    text = "def no(): pass"
    return text

async def _fetch():
    pass

class Store(Base, pkg.Other, metaclass=Meta):
    size = 1

    def get(self, key):
        return key

    @property
    def count(self): return 1

    def __len__(self):
        return 0

class Plain:
    pass

def test_it(): assert True
'''


def test_python():
    found = parse_source("a/b.py", PY)
    got = names(found)
    assert {k: v["kind"] for k, v in got.items() if k != "Store.size"} == {
        "LIMIT": "variable", "_hidden": "variable", "handler": "function", "_fetch": "function", "Store": "class", "Store.get": "method",
        "Store.count": "property", "Store.__len__": "method", "Plain": "class", "test_it": "test",
    }
    assert got["handler"]["decorators"] == ['@app.route("/x")'] and got["handler"]["signature"] == "(a, b=1) -> str"
    assert (got["handler"]["line_start"], got["handler"]["line_end"]) == (12, 17)
    assert got["_fetch"]["is_async"] and got["_fetch"]["visibility"] == "private" and got["Store.__len__"]["visibility"] == "public"
    assert (got["Store"]["line_start"], got["Store"]["line_end"]) == (22, 32)
    assert {e[2] for e in found.edges if e[0] == "extends"} == {"a/b.py::Base", "a/b.py::pkg.Other"}
    assert ("child_of", "a/b.py::Store.get", "a/b.py::Store") in found.edges
    assert ("contains", "a/b.py", "a/b.py::Store.get") not in found.edges
    imports = {(i["specifier"], tuple((n["name"], n["alias"]) for n in i["names"]), i["is_type_only"], i["is_namespace"]) for i in found.imports}
    assert imports == {
        ("os", (("os", None),), False, False), ("json", (("json", "j"),), False, False), (".", (("near", None),), False, False),
        ("..pkg.mod", (("thing", "other"), ("more", None)), False, False), ("typing", (("*", None),), False, True),
        ("app.types", (("T", None),), True, False),
    }


TS = """import def, { a, b as c } from './x';
import * as ns from "../y";
import type { T } from './t';
import './side';
// export function no() {}
export const add = async (x: number): Promise<number> => {
  return x;
};
const LIMIT = 3, OTHER = 4;
let state = { a: 1 };
export default function () { return 1; }
@Component()
export class Store extends Base {
  private items: string[] = [];
  static make(): Store { return new Store(); }
  get size() { return 1; }
  async load(key: string): Promise<void> {
    if (key) { this.load(key); }
  }
}
interface Shape { area(): number; name: string }
export type Id = string | number;
enum Color { Red }
function testThing() {}
export * from './all';
export { a as z, b } from './some';
export { LIMIT };
"""


def test_typescript():
    found = parse_source("src/a.ts", TS)
    got = names(found)
    assert {k: v["kind"] for k, v in got.items()} == {
        "add": "function", "LIMIT": "const", "state": "variable", "default": "function", "Store": "class", "Store.items": "property",
        "Store.make": "method", "Store.size": "property", "Store.load": "method", "Shape": "interface", "Shape.area": "method",
        "Shape.name": "property", "Id": "type_alias", "Color": "enum", "testThing": "function",
    }
    assert got["add"]["is_async"] and got["add"]["is_exported"] and got["add"]["signature"] == "(x: number): Promise<number>"
    assert got["Store"]["decorators"] == ["@Component()"] and got["Store.items"]["visibility"] == "private"
    assert got["testThing"]["is_test"] and not got["state"]["is_exported"]
    assert {(i["specifier"], tuple((n["name"], n["alias"]) for n in i["names"])) for i in found.imports} == {
        ("./x", (("default", "def"), ("a", None), ("b", "c"))), ("../y", (("*", "ns"),)), ("./t", (("T", None),)), ("./side", ()),
    }
    assert [i["is_side_effect"] for i in found.imports] == [False, False, False, True] and found.imports[2]["is_type_only"]
    exports = {(e["name"], e["kind"], e["specifier"]) for e in found.exports}
    assert {("*", "star", "./all"), ("z", "re_export", "./some"), ("b", "re_export", "./some"), ("LIMIT", "clause", None), ("Store", "declaration", None)} <= exports


RS = """use crate::a::{self, b::C as D, e::*};
pub use super::f::G;
mod inner;
pub struct Point { x: i32 }
enum Kind { A, B }
pub(crate) trait Shape { fn area(&self) -> f64; }
type Alias = Vec<u8>;
pub const MAX: usize = 3;
static COUNT: u32 = 0;
macro_rules! make { () => {} }
impl<T> Shape for Point<T> where T: Copy {
    fn area(&self) -> f64 { let s = "}"; 1.0 }
}
impl Point {
    pub async fn load(&mut self, n: u8) -> Result<()> { Ok(()) }
}
#[test]
fn works() { assert!(true); fn hidden() {} }
mod tests { fn not_top() {} }
"""


def test_rust():
    found = parse_source("src/p.rs", RS)
    got = names(found)
    assert {k: v["kind"] for k, v in got.items()} == {
        "Point": "struct", "Kind": "enum", "Shape": "trait", "Alias": "type_alias", "MAX": "const", "COUNT": "variable", "make": "macro",
        "Point.area": "method", "Point.load": "method", "works": "function",
    }
    assert got["works"]["is_test"] and got["Shape"]["visibility"] == "crate" and got["Point.load"]["is_async"]
    assert got["Point.load"]["signature"] == "(&mut self, n: u8) -> Result<()>"
    assert ("implements", "src/p.rs::Point", "src/p.rs::Shape") in found.edges
    assert ("contains", "src/p.rs", "src/p.rs::Point.area") in found.edges
    specs = [(i["specifier"], i["names"][0]["name"], i["names"][0]["alias"]) for i in found.imports]
    assert specs == [("crate::a", "a", None), ("crate::a::b::C", "C", "D"), ("crate::a::e::*", "*", None), ("super::f::G", "G", None), ("mod::inner", "inner", None)]
    assert [(e["name"], e["specifier"]) for e in found.exports] == [("G", "super::f")]


GO = """package p
import (
\t"fmt"
\tm "code.example/x/math"
\t. "code.example/dot"
\t_ "code.example/blank"
)
import "os"
const Max = 1
var (
\tcount int
\tErr = f("}")
)
type Shape interface { Area() float64 }
type Point struct {
\t*Base
\tpkg.Other
\tX int
}
type ID = string
func (p *Point) Move(dx int) error { return nil }
func TestMove(t *T) {}
func helper() (int, error) {
\treturn 1, nil
}
"""


def test_go():
    found = parse_source("p/a.go", GO)
    got = names(found)
    assert {k: v["kind"] for k, v in got.items()} == {
        "Max": "const", "count": "variable", "Err": "variable", "Shape": "interface", "Point": "struct", "ID": "type_alias",
        "Point.Move": "method", "TestMove": "function", "helper": "function",
    }
    assert got["TestMove"]["is_test"] and got["Max"]["is_exported"] and got["helper"]["visibility"] == "private"
    assert {e[2] for e in found.edges if e[0] == "embeds"} == {"p/a.go::Base", "p/a.go::Other"}
    imports = {i["specifier"]: i for i in found.imports}
    assert set(imports) == {"fmt", "code.example/x/math", "code.example/dot", "code.example/blank", "os"}
    assert imports["code.example/x/math"]["names"] == [{"name": "math", "alias": "m"}]
    assert imports["code.example/dot"]["is_namespace"] and imports["code.example/blank"]["is_side_effect"]


@pytest.mark.parametrize("path", ["a.py", "a.ts", "a.rs", "a.go"])
@pytest.mark.parametrize("text", ["", "\n\n", "def (", "class {{{", "func (", "fn x(", "import {", "'''", '"', "impl", "export default", "type x struct {", "@d\n", "from x import ("])
def test_broken_code_does_not_crash(path, text):
    assert parse_source(path, text) is not None


def test_table(spark):
    rows = [("a/b.py", bytearray(PY.encode()), "x"), ("c.md", bytearray(b"# x"), "x"), (None, bytearray(b"x = 1"), "x"), ("d.py", None, "x"), ("e.go", bytearray(b"\xff\xfe"), "x")]
    found = extract(spark.createDataFrame(rows, "path string, content binary, symbols string"))
    assert {r.path for r in found.select("path").collect()} == {"a/b.py", "d.py", "e.go"}
    assert part(found, "symbols").where("kind = 'class'").count() == 2
    assert extract(spark.createDataFrame([], "path string, content binary")).count() == 0
