"""Golden tests of the extraction job, one snippet per language."""

import pytest

from corpusgraph.extraction import extract

SNIPPETS = {
    "go": '''package shop

import (
	"fmt"
	str "strings"
)

import "os"

const Limit = 3

const (
	Small = iota
	Large
)

var total int

type Cart struct {
	Items []string // not a } brace
}

type Shelf interface {
	Put(item string)
}

type Price int64

func (c *Cart) Add(
	item string,
) error {
	fmt.Println("func Fake() {", item)
	return check(item)
}

func check(s string) error {
	if str.Contains(s, "}") { return os.ErrExist }
	return nil
}
''',
    "python": '''import os
from typing import (
    Any,
    List,
)

@decorate(1)
@other
def first(a,
          b):
    """def fake():
    text"""
    return os.getcwd(a)

class Base:
    def __init__(self):
        self.go()

    def _hidden(self):
        pass

    async def go(self):
        return [x for x in first(1, 2)]

# def comment(): pass
def last(): return "def nope():"
''',
    "javascript": '''import { a } from './a.js';
import def, {
  b,
} from "pkg/b";
import 'side-effect';

export function load(url) {
  return fetch(url).then((r) => r.json());
}

export default class Box {
  constructor(n) { this.n = n; }
  size(k) {
    if (k) { return helper(k); }
    return new Map();
  }
}

const twice = (x) => x + x;
const long = async (y) => {
  return twice(y);
};
const value = 4;
''',
    "typescript": '''interface Person {
  name: string;
}
type Id = string | number;
enum Color { Red, Green }
export abstract class Repo<T> {
  private find(id: Id): T { return lookup(id); }
}
''',
    "rust": '''use std::fmt;
pub struct Point { x: f64 }
enum Shape { Dot }
pub trait Draw {
    fn draw(&self);
}
impl Draw for Point {
    fn draw(&self) { std::mem::drop(1); helper('}'); }
}
type Alias = Point;
const MAX: u32 = 3;
static NAME: &str = "fn x() {";
mod inner { }
pub fn helper(c: char) -> bool {
    println!("no call");
    true
}
''',
    "java": '''package a.b;
import java.util.List;

public class Store extends Base {
    private final int size = 3;
    public Store(int n) { super(n); }
    @Override
    public List<String> names(String key) throws Exception {
        return index.lookup(key, new ArrayList<>());
    }
    enum Mode { ON }
}
interface Shop { void sell(int n); }
''',
    "kotlin": '''import kotlinx.coroutines.flow.Flow

data class Item(val id: String) {
    val label = id
    fun show(): String { return format(id) }
}
enum class Kind { A, B }
interface Repo { fun load(): Item }
object Registry {
    const val MAX = 3
}
fun main() { println(Item("x").show()) }
typealias Name = String
val top = 1
''',
    "ruby": '''require 'json'
require_relative "lib/tool"

module Shop
  class Cart
    def add(item)
      items.each do |i|
        check(i) if valid?(i)
      end
    end

    def self.open; end
  end
end
''',
    "c": '''#include <stdio.h>
#include "util.h"

struct node {
    int v;
};

enum color { RED };
typedef struct node node_t;

static int *find(struct node *n, int k)
{
    return lookup(n->next, k);
}

int main(void) { printf("{"); return find(0, 1) != 0; }
''',
    "cpp": '''#include <vector>
int Calc::twice(int a) {
    return std::max<int>(ptr->area(), Calc::once(a));
}
''',
    "elixir": '''defmodule App.Accounts do
  alias App.Repo
  import Ecto.Query

  def get(id) do
    Repo.get(User, id)
  end

  defp short(x), do: helper(x)

  defmacro check(x) do
    quote(do: x)
  end
end

defprotocol App.Size do
end
''',
    "hcl": '''resource "aws_instance" "web" {
  ami = "x" # }
}
variable "region" {}
provider "aws" {
  region = var.region
}
locals {
  a = 1
}
''',
    "protobuf": '''syntax = "proto3";
import "google/protobuf/empty.proto";
message User {
  string name = 1;
}
enum Role { ADMIN = 0; }
service Users {
  rpc Get (User) returns (User);
}
''',
    "dart": '''import 'package:app/app.dart';

class Circle extends Shape {
  final double r;
  Circle(this.r);
  double area() { return pi(r); }
  int get size => 1;
  set size(int v) { keep(v); }
}
mixin Fly { }
extension Ext on String { }
typedef Op = int Function(int);
void main() { print(Circle(2)); }
''',
    "scala": '''import a.b.C
object Main {
  def run(x: Int): Int = { go(x) }
}
case class P(x: Int)
trait T
''',
    "csharp": '''public class Shop {
    public int Sell(string item) {
        return 1;
    }
}
''',
    "swift": '''class Shop {
    func sell(_ item: String) -> Int {
        return 1
    }
}
''',
    "php": '''<?php
class Shop {
    public function sell($item) { return "}"; }
}
function help() { }
''',
    "lua": '''local function help(x)
  if x then return 1 elseif y then return 2 end
  for i = 1, 2 do print(i) end
end
function Shop.sell(a) return a end
''',
    "bash": '''function build {
  echo "}"
}
deploy() {
  build
}
''',
    "apex": '''public with sharing class Acct {
    public static void run(String s) {
        System.debug('class X {');
    }
}
''',
    "yaml": "a: 1\n",
}

# (name, kind, start, end, parent) per language
SYMBOLS = {
    "go": {("Limit", "constant", 10, 10, ""), ("Small", "constant", 13, 13, ""), ("Large", "constant", 14, 14, ""),
           ("total", "variable", 17, 17, ""), ("Cart", "struct", 19, 21, ""), ("Shelf", "interface", 23, 25, ""),
           ("Price", "type", 27, 27, ""), ("Add", "method", 29, 34, ""), ("check", "function", 36, 39, "")},
    "python": {("first", "function", 7, 13, ""), ("Base", "class", 15, 23, ""), ("__init__", "function", 16, 17, "Base"),
               ("go", "function", 22, 23, "Base"), ("last", "function", 26, 26, "")},
    "javascript": {("load", "function", 7, 9, ""), ("Box", "class", 11, 17, ""), ("constructor", "method", 12, 12, "Box"),
                   ("size", "method", 13, 16, "Box"), ("twice", "function", 19, 19, ""), ("long", "function", 20, 22, "")},
    "typescript": {("Person", "interface", 1, 3, ""), ("Id", "type", 4, 4, ""), ("Color", "enum", 5, 5, ""),
                   ("Repo", "class", 6, 8, ""), ("find", "method", 7, 7, "Repo")},
    "rust": {("Point", "struct", 2, 2, ""), ("Shape", "enum", 3, 3, ""), ("Draw", "trait", 4, 6, ""), ("Point", "impl", 7, 9, ""),
             ("draw", "function", 8, 8, "Point"), ("Alias", "type", 10, 10, ""), ("MAX", "constant", 11, 11, ""),
             ("NAME", "variable", 12, 12, ""), ("inner", "module", 13, 13, ""), ("helper", "function", 14, 17, "")},
    "java": {("Store", "class", 4, 12, ""), ("size", "field", 5, 5, "Store"), ("Store", "constructor", 6, 6, "Store"),
             ("names", "method", 8, 10, "Store"), ("Mode", "enum", 11, 11, "Store"), ("Shop", "interface", 13, 13, ""), ("sell", "method", 13, 13, "Shop")},
    "kotlin": {("Item", "class", 3, 6, ""), ("label", "field", 4, 4, "Item"), ("show", "method", 5, 5, "Item"), ("Kind", "enum", 7, 7, ""),
               ("Repo", "interface", 8, 8, ""), ("load", "method", 8, 8, "Repo"), ("Registry", "object", 9, 11, ""), ("MAX", "constant", 10, 10, "Registry"),
               ("main", "function", 12, 12, ""), ("Name", "type", 13, 13, ""), ("top", "variable", 14, 14, "")},
    "ruby": {("Shop", "module", 4, 14, ""), ("Cart", "class", 5, 13, "Shop"), ("add", "method", 6, 10, "Cart"), ("open", "method", 12, 12, "Cart")},
    "c": {("node", "struct", 4, 6, ""), ("color", "enum", 8, 8, ""), ("node_t", "type", 9, 9, ""), ("find", "function", 11, 14, ""),
          ("main", "function", 16, 16, "")},
    "cpp": {("Calc::twice", "function", 2, 4, "")},
    "elixir": {("App.Accounts", "module", 1, 14, ""), ("get", "function", 5, 7, "App.Accounts"), ("short", "function", 9, 9, "App.Accounts"),
               ("check", "macro", 11, 13, "App.Accounts"), ("App.Size", "interface", 16, 17, "")},
    "hcl": {("aws_instance.web", "resource", 1, 3, ""), ("region", "variable", 4, 4, ""), ("aws", "module", 5, 7, ""), ("locals", "variable", 8, 10, "")},
    "protobuf": {("User", "struct", 3, 5, ""), ("Role", "enum", 6, 6, ""), ("Users", "interface", 7, 9, ""), ("Get", "method", 8, 8, "Users")},
    "dart": {("Circle", "class", 3, 9, ""), ("Circle", "constructor", 5, 5, "Circle"), ("area", "method", 6, 6, "Circle"),
             ("size", "getter", 7, 7, "Circle"), ("size", "setter", 8, 8, "Circle"), ("Fly", "mixin", 10, 10, ""),
             ("Ext", "extension", 11, 11, ""), ("Op", "type", 12, 12, ""), ("main", "function", 13, 13, "")},
    "scala": {("Main", "object", 2, 4, ""), ("run", "method", 3, 3, "Main"), ("P", "class", 5, 5, ""), ("T", "trait", 6, 6, "")},
    "csharp": {("Shop", "class", 1, 5, ""), ("Sell", "method", 2, 4, "Shop")},
    "swift": {("Shop", "class", 1, 5, ""), ("sell", "function", 2, 4, "Shop")},
    "php": {("Shop", "class", 2, 4, ""), ("sell", "method", 3, 3, "Shop"), ("help", "function", 5, 5, "")},
    "lua": {("help", "function", 1, 4, ""), ("Shop.sell", "function", 5, 5, "")},
    "bash": {("build", "function", 1, 3, ""), ("deploy", "function", 4, 6, "")},
    "apex": {("Acct", "class", 1, 5, ""), ("run", "method", 2, 4, "Acct")},
    "yaml": set(),
}
IMPORTS = {
    "go": ["fmt", "os", "strings"],
    "python": ["from typing import (\n    Any,\n    List,\n)", "import os"],
    "javascript": ["./a.js", "pkg/b", "side-effect"],
    "rust": ["use std::fmt;"], "java": ["import java.util.List;"], "kotlin": ["import kotlinx.coroutines.flow.Flow"],
    "ruby": ["json", "lib/tool"], "c": ["stdio.h", "util.h"], "cpp": ["vector"], "elixir": ["App.Repo", "Ecto.Query"],
    "protobuf": ["google/protobuf/empty.proto"], "dart": ["package:app/app.dart"], "scala": ["import a.b.C"],
}
REFS = {
    "go": [("Contains", 37), ("Println", 32), ("check", 33)],
    "python": [("decorate", 7), ("first", 23), ("getcwd", 13), ("go", 17)],
    "javascript": [("fetch", 8), ("helper", 14), ("json", 8), ("then", 8), ("twice", 21)],
    "typescript": [("lookup", 7)],
    "rust": [("helper", 8), ("std::mem::drop", 8)],
    "java": [("lookup", 9)],
    "kotlin": [("Item", 12), ("format", 5), ("println", 12), ("show", 12)],
    "ruby": [("check", 8), ("valid?", 8)],
    "c": [("find", 16), ("lookup", 13), ("printf", 16)],
    "cpp": [("area", 3), ("max", 3), ("once", 3)],
    "elixir": [("get", 6), ("helper", 9), ("quote", 12)],
    "dart": [("Circle", 13), ("keep", 8), ("pi", 6), ("print", 13)],
    "scala": [("go", 3)], "apex": [("debug", 3)],
}


@pytest.fixture(scope="module")
def facts(spark):
    rows = [("r", i, lang, src) for i, (lang, src) in enumerate(sorted(SNIPPETS.items()))]
    src = spark.createDataFrame(rows, "repo string, file_id bigint, language string, content string")
    lines = extract.masked_lines(src)
    defs = extract.written_definitions(lines)
    symbols = [r.asDict() for r in extract.symbols_of(lines, definitions=defs).collect()]
    imports = [r.asDict() for r in extract.imports_of(lines).collect()]
    refs = [r.asDict() for r in extract.refs_of(lines, defs).collect()]
    return symbols, imports, refs


@pytest.mark.parametrize("lang", sorted(SNIPPETS))
def test_symbols(facts, lang):
    got = {(s["name"], s["kind"], s["start_line"], s["end_line"], s["parent"]) for s in facts[0] if s["language"] == lang}
    assert got == SYMBOLS[lang]


@pytest.mark.parametrize("lang", sorted(SNIPPETS))
def test_imports(facts, lang):
    assert sorted(i["raw_path"] for i in facts[1] if i["language"] == lang) == IMPORTS.get(lang, [])


@pytest.mark.parametrize("lang", sorted(SNIPPETS))
def test_refs(facts, lang):
    assert sorted((r["name"], r["line"]) for r in facts[2] if r["language"] == lang) == REFS.get(lang, [])


def test_signatures(facts):
    by = {(s["language"], s["name"], s["kind"]): s["signature"] for s in facts[0]}
    assert by["go", "check", "function"] == "(s string)"
    assert by["java", "Store", "class"].strip() == "public class Store extends Base"
    assert by["python", "Base", "class"] == "class Base:"
    assert by["go", "Limit", "constant"] == ""


def test_java_locals_are_no_fields(spark):
    java = "class K {\n    Foo shared = new Foo();\n    K() {\n        Foo own = new Foo();\n    }\n    void run() {\n        Foo f = make(shared);\n        int n;\n    }\n}\n"
    source = spark.createDataFrame([("r", 1, "java", java)], "repo string, file_id bigint, language string, content string")
    symbols = extract.symbols_of(extract.masked_lines(source)).collect()
    assert {(s["name"], s["kind"], s["parent"]) for s in symbols} == {
        ("K", "class", ""), ("shared", "field", "K"), ("K", "constructor", "K"), ("run", "method", "K"),
    }


def symbols(spark, language, content):
    source = spark.createDataFrame([("r", 1, language, content)], "repo string, file_id bigint, language string, content string")
    return [r.asDict() for r in extract.symbols_of(extract.masked_lines(source)).collect()]


SEVERAL = {
    "javascript": ("function a(){} function c(x){ return {k: 1}; }\nclass K { m(){} n(a, {b}){} static o(){ if (a) { p(); } } }\nlet s = 'function no(){}'; function t(){}",
                   {("a", "function", 1, ""), ("c", "function", 1, ""), ("K", "class", 2, ""), ("m", "method", 2, "K"), ("n", "method", 2, "K"),
                    ("o", "method", 2, "K"), ("t", "function", 3, "")}),
    "java": ("class A { int x; A() { int y = 1; go(y); } void f() { } class B { void f() { } } } interface C { int g(int a); }",
             {("A", "class", 1, ""), ("x", "field", 1, "A"), ("A", "constructor", 1, "A"), ("f", "method", 1, "A"), ("B", "class", 1, "A"),
              ("f", "method", 1, "B"), ("C", "interface", 1, ""), ("g", "method", 1, "C")}),
    "go": ("type (\n\tA struct {\n\t\tName string\n\t}\n\tB[T any] interface { M() }\n\tC = int\n\tD func(int)\n)\nfunc f() {}; func g() {}\n",
           {("A", "struct", 2, ""), ("B", "interface", 5, ""), ("C", "type", 6, ""), ("D", "type", 7, ""), ("f", "function", 9, ""), ("g", "function", 9, "")}),
    "rust": ("struct P { x: f64 } impl P { fn new() -> P { P { x: 1.0 } } fn y(&self) {} } mod m { pub fn z() {} }",
             {("P", "struct", 1, ""), ("P", "impl", 1, ""), ("new", "function", 1, "P"), ("y", "function", 1, "P"), ("m", "module", 1, ""), ("z", "function", 1, "m")}),
    "php": ("<?php class A { public function f() { } private function g() { } } function h() { }",
            {("f", "method", 1, ""), ("g", "method", 1, ""), ("h", "function", 1, "")}),
    "c": ("int f(int a) { return a; } int g(void) { for (int i = 0; i < 3; i++) { f(i); } return 0; } struct s { int v; };",
          {("f", "function", 1, ""), ("g", "function", 1, ""), ("s", "struct", 1, "")}),
    "kotlin": ("class A { fun f() { g() } ; fun h(x: Int) = x } object O { val z = 1 }",
               {("A", "class", 1, ""), ("f", "method", 1, "A"), ("h", "method", 1, "A"), ("O", "object", 1, ""), ("z", "field", 1, "O")}),
    "csharp": ("class A { int F(int a) { return a; } void G() { } }", {("A", "class", 1, ""), ("F", "method", 1, "A"), ("G", "method", 1, "A")}),
    "protobuf": ("message A { string n = 1; enum K { X = 0; } message B { } } service S { rpc Get (A) returns (A); rpc Put (A) returns (A); }",
                 {("A", "struct", 1, ""), ("K", "enum", 1, "A"), ("B", "struct", 1, "A"), ("S", "interface", 1, ""), ("Get", "method", 1, "S"), ("Put", "method", 1, "S")}),
}


@pytest.mark.parametrize("language", sorted(SEVERAL))
def test_several_definitions_on_a_line(spark, language):
    content, want = SEVERAL[language]
    assert {(s["name"], s["kind"], s["start_line"], s["parent"]) for s in symbols(spark, language, content)} == want


def test_a_minified_file_keeps_every_function(spark):
    n = 5000
    found = symbols(spark, "javascript", "".join(f"function f{k}(a,b){{g{k}(a);if(b){{return 1}}}}" for k in range(n)))
    assert {s["name"] for s in found} == {f"f{k}" for k in range(n)} and all(s["parent"] == "" and s["signature"] == "(a,b)" for s in found)


SIGNATURES = [
    ("go", "func Map[T any](x T) T {\n}\n", "Map", "(x T)"),
    ("go", "func (c *C) Add(\n\titem string, // the )\n\tf func(int) (int, error),\n) error {\n}\n", "Add", "(\n\titem string, // the )\n\tf func(int) (int, error),\n)"),
    ("python", "def f(a,\n      b=(1, ')'), *c):\n    pass\n", "f", "(a,\n      b=(1, ')'), *c)"),
    ("javascript", "(function () {\nfunction g(\n  a,\n  b\n) {\n}\n})();\n", "g", "(\n  a,\n  b\n)"),
    ("java", "class A {\n  <T> void put(Map<K, V> m,\n      int n) {\n  }\n}\n", "put", "(Map<K, V> m,\n      int n)"),
    ("typescript", "export function id<T extends A>(x: T): T { return x; }\n", "id", "(x: T)"),
    ("rust", "fn pair<A, B>(a: A, b: (B, B)) -> A { a }\n", "pair", "(a: A, b: (B, B))"),
]


@pytest.mark.parametrize("language, content, name, want", SIGNATURES)
def test_signatures_over_lines(spark, language, content, name, want):
    assert [s["signature"] for s in symbols(spark, language, content) if s["name"] == name] == [want]


def test_blocks_across_chunks_of_lines(spark, monkeypatch):
    content = "class A {\n" + "".join(f"  m{k}() {{\n    go();\n  }}\n" for k in range(40)) + "}\nfunction last() {\n}\n"
    whole = symbols(spark, "javascript", content)
    monkeypatch.setattr(extract.R, "CHUNK_SHIFT", 1)
    placed = lambda found: sorted((s["name"], s["start_line"], s["end_line"], s["parent"], s["depth"]) for s in found)
    assert placed(symbols(spark, "javascript", content)) == placed(whole)
    by = {s["name"]: (s["start_line"], s["end_line"]) for s in whole}
    assert by["A"] == (1, 122) and by["m39"] == (119, 121) and by["last"] == (123, 124)


def test_members_of_a_line_are_no_calls(spark):
    source = spark.createDataFrame([("r", 1, "javascript", "class K { m(){ m(); k() } m(a){} }")], "repo string, file_id bigint, language string, content string")
    assert sorted(r["name"] for r in extract.extract_refs(source).collect()) == ["k", "m"]
