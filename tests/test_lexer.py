"""Definitions of ten languages: braces in strings, comments and templates, heads over several lines, nested ones."""

import time

import pytest

from stratalens.sources.lexer import definitions, tokens
from stratalens.sources.structure import parse_file

#: Source, and (name, kind, line, end_line, parent) of its definitions.
CASES = {
    "typescript": (
        "// { comment\nexport const limit = 10\nexport const make = (x: number) => {\n  return { \"}\": `}${x}` };\n};\nexport default async function\n  loadAll(a: string,\n"
        "          b = \"{\") : Promise<{x: number}> {\n  const re = /[{}\"]/g;\n  if (a) { return foo(function inner() { return 1 }) }\n}\nexport abstract class Store<T extends Base>\n"
        "  extends Base<T> {\n  @Log({ level: 1 })\n  async open(id: string): Promise<void> {\n    for (const a of b) { work(a) }\n  }\n  handler = (e) => { x() }\n}\n"
        "interface Shape { area(): number; }\ntype Pair<T> = { a: T; b: T };\nenum Color { Red }\nlet y\nif (y) { z() }\n",
        [("limit", "const", 2, 2, None), ("make", "const", 3, 5, None), ("loadAll", "function", 6, 11, None), ("inner", "function", 10, 10, "loadAll"), ("Store", "class", 12, 19, None), ("open", "method", 15, 17, "Store"),
         ("Shape", "interface", 20, 20, None), ("Pair", "type", 21, 21, None), ("Color", "enum", 22, 22, None), ("y", "const", 23, 23, None)],
    ),
    "javascript": ("class A { get x() { return '}' } static of(a) { return new A }\n}\nfunction* gen() {\n  yield `${'}'}`\n}\nfoo.function = 1\n", [("A", "class", 1, 2, None), ("x", "method", 1, 1, "A"), ("of", "method", 1, 1, "A"), ("gen", "function", 3, 5, None)]),
    "go": (
        "package main\n// func nope() {\ntype Server struct { Name string }\ntype (\n\tA struct { x int }\n\tB interface {\n\t\tFoo()\n\t}\n)\nfunc (s *Server) Serve(\n\taddr string,\n) error {\n\tfmt.Println(`}`, '}', \"}\")\n\tgo func() { x() }()\n}\nfunc main() {}\n",
        [("Server", "type", 3, 3, None), ("A", "type", 5, 5, None), ("B", "type", 6, 8, None), ("Serve", "method", 10, 15, None), ("main", "function", 16, 16, None)],
    ),
    "rust": (
        "pub struct Point<'a> { x: &'a str }\nstruct Unit;\nimpl<'a, T: Foo<U>> std::fmt::Display for Point<'a> {\n    fn fmt(&self) -> R { let c = '{'; let s = r#\"}\"}\"#; Ok(()) }\n}\ntrait T { fn a(&self); }\npub async fn run<T>(\n    x: T,\n) -> impl Future\nwhere T: Send {\n}\n",
        [("Point", "struct", 1, 1, None), ("Unit", "struct", 2, 2, None), ("Point", "class", 3, 5, None), ("fmt", "function", 4, 4, "Point"), ("T", "trait", 6, 6, None), ("a", "function", 6, 6, "T"), ("run", "function", 7, 11, None)],
    ),
    "java": (
        "public class A<T> extends B {\n  @Override\n  public String toString() { return \"}\"; }\n  Map<String, X> m = new HashMap<>() {{ put(\"a\", 1); }};\n  A(int x) throws E { if (x > 0) { y(); } }\n  enum K { X; int f() { return 1; } }\n  Class<?> c = A.class;\n}\nrecord P(int x) { }\n",
        [("A", "class", 1, 8, None), ("toString", "method", 3, 3, "A"), ("A", "method", 5, 5, "A"), ("K", "enum", 6, 6, "A"), ("f", "method", 6, 6, "K"), ("P", "class", 9, 9, None)],
    ),
    "c": (
        "#include <x.h>\n#define M(x) { x\ntypedef struct { int a; } T;\nstruct node { struct node *next; };\nstatic struct node *make(int a, char *b) {\n  char *s = \"{\"; /* } */\n}\nint proto(int);\nint\nmain(void)\n{\n  struct node n = { 0 };\n}\n",
        [("node", "struct", 4, 4, None), ("make", "function", 5, 7, None), ("main", "function", 10, 13, None)],
    ),
    "cpp": (
        "namespace ns {\ntemplate <class T> class Foo : public Bar {\n public:\n  Foo() : x(1) {}\n  int get() const { return x; }\n};\nint Foo::bar(int a) { return a; }\nenum class E { A };\n}\n",
        [("Foo", "class", 2, 6, None), ("Foo", "method", 4, 4, "Foo"), ("get", "method", 5, 5, "Foo"), ("bar", "function", 7, 7, None), ("E", "enum", 8, 8, None)],
    ),
    "csharp": ("namespace N {\n  public class A : B {\n    public int X { get; set; }\n    public async Task<int> Run(string s = @\"{\") { if (x) { } return 1; }\n    struct S { }\n  }\n}\n", [("A", "class", 2, 6, None), ("Run", "method", 4, 4, "A"), ("S", "struct", 5, 5, "A")]),
    "kt": ("class A(val x: Int) : B() {\n  fun String.ext(a: Int): Int { return 1 }\n  fun one() = 1\n  companion object { fun make() { } }\n}\nobject O { }\n", [("A", "class", 1, 5, None), ("ext", "function", 2, 2, "A"), ("one", "function", 3, 3, "A"), ("make", "function", 4, 4, "A"), ("O", "class", 6, 6, None)]),
    "swift": ("protocol P { func f() }\npublic struct S<T>: P {\n  func f() { let s = \"{\" }\n}\nfunc top(a: Int) -> Int { return 1 }\n", [("P", "class", 1, 1, None), ("f", "function", 1, 1, "P"), ("S", "class", 2, 4, None), ("f", "function", 3, 3, "S"), ("top", "function", 5, 5, None)]),
    "php": ("<?php\n# comment {\nclass A { public function f($x) { return \"{$x}\"; } }\nfunction top() { $f = function($y) { }; }\ntrait T { }\n", [("A", "class", 3, 3, None), ("f", "function", 3, 3, "A"), ("top", "function", 4, 4, None), ("T", "trait", 5, 5, None)]),
    "ruby": ("module M\n  class A\n    def f\n      if x\n        1\n      end\n    end\n    def self.g?\n    end\n  end\nend\n", [("M", "class", 1, 11, None), ("A", "class", 2, 10, "M"), ("f", "function", 3, 7, "A"), ("g?", "function", 8, 9, "A")]),
}


@pytest.mark.parametrize("lang", sorted(CASES))
def test_definitions(lang):
    source, want = CASES[lang]
    assert [(n, k, a, b, p) for n, k, a, b, _, p in parse_file(source, lang)] == want


def test_depth_signature_and_odd_files():
    nested = "class A { class B { class C { class D { class E { } } } } }"
    assert [x[0] for x in parse_file(nested, "java")] == ["A", "B", "C", "D"]
    assert parse_file("  function long(" + "a, " * 80 + "b) { }", "typescript")[0][4].endswith("...")
    for text in ("", "}", "{", '"', "/*", "class", "func (", "impl<", "fun a.", "x" * 1000, "}}}}class A {"):
        for lang in CASES:
            parse_file(text, lang)
    assert [t.text for t in tokens('a("}") // x\n+ 1.5', "go")] == ["a", "(", '"', ")", "+", "1.5"]


@pytest.mark.parametrize("text", ["{" * 60_000, "/*" * 40_000, '"' * 60_000, "impl " * 15_000, "impl<" * 15_000, "func (" * 15_000, "fun a." * 15_000, "class A { int f() { } }\n" * 5_000, "const a = 1\n" * 20_000])
def test_long_files_take_linear_time(text):
    for lang in ("rust", "go", "typescript", "kt", "java"):
        began = time.process_time()
        definitions(text, lang)
        assert time.process_time() - began < 15
