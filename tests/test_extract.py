"""Extractors, language by language: (kind, name, visibility) in pre-order with depth, and what else they say."""

import pytest

from lattica.functions.collapse import collapse
from lattica.operators import types
from lattica.sources import extract, scan


def shape(language, text):
    imports, top = extract.EXTRACTORS[language](text)
    out = []

    def add(d, depth):
        out.append("  " * depth + f"{d.kind} {d.name}" + {"Public": "+", "PublicCrate": "~", "Private": "-"}[d.visibility])
        for c in d.children:
            add(c, depth + 1)

    for d in top:
        add(d, 0)
    return imports, out


def decls(language, text):
    out = {}

    def add(d):
        out.setdefault(d.name, d)
        for c in d.children:
            add(c)

    for d in extract.EXTRACTORS[language](text)[1]:
        add(d)
    return out


CASES = {
    "Rust": (
        """use std::fmt::{self, Display};
pub use crate::a;

/// A point { in space }.
#[derive(Debug)]
pub struct Point<T> { pub x: T, pub(crate) y: Vec<(T, T)>, z: u8 }
pub struct Unit;
pub(crate) enum Color { Red, Green(u8), Blue { a: u8 } }
pub trait Shape { fn area(&self) -> f64; fn name(&self) -> String { "x}".into() } }
impl<T: Clone> Shape for Point<T> where T: Copy {
    fn area(&self) -> f64 { 0.0 }
}
impl Point<u8> { pub async fn go(self, n: u8, f: fn(u8) -> u8) {} }
const MAX: usize = 3;
static mut S: [u8; 2] = [1, 2];
type Pair = (u8, u8);
mod tests { fn hidden() {} }
macro_rules! m { () => {} }
""",
        (["use std::fmt::{self, Display};", "pub use crate::a;"], ["Struct Point+", "  Field x+", "  Field y~", "  Field z-", "Struct Unit+", "Enum Color~", "  Variant Red~", "  Variant Green~", "  Variant Blue~", "Trait Shape+", "  Method area+", "  Method name+", "Impl Shape for Point<T>-", "  Method area-", "Impl Point<u8>-", "  Method go+", "Constant MAX-", "Static S-", "TypeAlias Pair-", "Module tests-", "Macro m-"]),
    ),
    "TypeScript": (
        """import { a } from './a';
export class Dog extends Animal implements Pet, Loud {
  private name: string = "x";
  constructor(name: string) { super(); }
  async bark(times: number): Promise<void> { for (;;) {} }
}
interface Pet { id: number; feed(x: Food): void; }
export type Id = string | number;
export enum Size { Small, Large = 2 }
export const f = async (x: number) => { return x; };
function g<T>(x: T): T { return x; }
let hidden = 1;
""",
        (["import { a } from './a'"], ["Struct Dog+", "  Field name-", "  Method constructor+", "  Method bark+", "Trait Pet-", "  Field id+", "  Method feed+", "TypeAlias Id+", "Enum Size+", "  Variant Small+", "  Variant Large+", "Constant f+", "Function g-"]),
    ),
    "JavaScript": ("export function a(x) { return x }\nclass B { m() {} #p = 1 }\nvar c = 1\nlet d = 2\n", ([], ["Function a+", "Struct B-", "  Method m+", "  Field p+", "Constant c-"])),
    "Go": (
        """package p

import (
    "fmt"
    x "a/b"
)

// Server serves.
type Server struct {
    Addr string
    port int
    Logger
}

type Doer interface {
    Do(n int) error
}

type ID = string

const (
    A = iota
    b
)

var Z = map[string]int{"a": 1}

func New(a, b int, c string) (*Server, error) { return nil, nil }

func (s *Server) run() {
    if true {
    }
}
""",
        (['import "fmt"', 'import "a/b"'], ["Struct Server+", "  Field Addr+", "  Field port-", "Trait Doer+", "  Method Do+", "TypeAlias ID+", "Constant A+", "Constant b-", "Static Z+", "Function New+", "Method Server.run-"]),
    ),
    "Java": (
        """package p;
import java.util.List;
/** Keeps things. */
public class Box<T> extends Base implements A, B {
    private final List<T> items = new ArrayList<>();
    public Box(int n) { if (n > 0) { } }
    @Test public void works() throws Exception { }
    protected <R> R map(Function<T, R> f) { return null; }
    interface Inner { void go(); }
}
enum Color { RED, GREEN(1); int code() { return 0; } }
""",
        (["import java.util.List;"], ["Struct Box+", "  Field items-", "  Method Box+", "  Method works+", "  Method map-", "  Trait Inner-", "    Method go-", "Enum Color-", "  Variant RED+", "  Variant GREEN+", "  Method code-"]),
    ),
    "C": (
        """#include <stdio.h>
#include "a.h"
#define MAX 10
/* adds */
int add(int a, int b);
static int counter = 0;
struct point { int x; int y; };
enum color { RED, GREEN };
typedef unsigned long ulong_t;
int add(int a, int b) { return a + b; }
static void run(void) { while (1) { if (counter && 1) break; } }
#ifdef X
int hidden(void);
#endif
""",
        (["#include <stdio.h>", '#include "a.h"'], ["Macro MAX+", "Function add+", "Static counter-", "Struct point+", "  Field x+", "  Field y+", "Enum color+", "  Variant RED+", "  Variant GREEN+", "TypeAlias ulong_t+", "Function add+", "Function run-"]),
    ),
    "C++": (
        """#include <vector>
namespace geo {
class Shape : public Base, private Other {
public:
    Shape(int n);
    virtual double area() const = 0;
private:
    int id;
};
template <typename T> T twice(T x) { return x + x; }
}
double geo::Shape::area() const { return 1.0; }
using Ints = std::vector<int>;
""",
        (["#include <vector>"], ["Module geo+", "  Struct Shape+", "    Method Shape+", "    Method area+", "    Field id-", "  Function twice+", "Function geo::Shape::area+", "TypeAlias Ints+"]),
    ),
    "Protobuf": ('syntax = "proto3";\nimport "a.proto";\nmessage A { string id = 1; repeated B bs = 2; oneof k { int32 n = 3; } }\nenum E { ZERO = 0; }\nservice S { rpc Go (A) returns (B); }\n', (['import "a.proto"'], ["ConfigKey syntax+", "Message A+", "  Field id+", "  Field bs+", "  Field k+", "    Field n+", "Enum E+", "  Variant ZERO+", "Service S+", "  RpcMethod Go+"])),
    "GraphQL": ("# all\ntype User implements Node & Thing {\n  id: ID!\n  posts(first: Int): [Post]\n}\ninterface Node { id: ID! }\nenum Role {\n  ADMIN\n  USER\n}\nscalar Date\nquery GetUser($id: ID) { user(id: $id) { id } }\n", ([], ["SchemaType User+", "  Field id+", "  Field posts+", "Trait Node+", "  Field id+", "Enum Role+", "  Variant ADMIN+", "  Variant USER+", "TypeAlias Date+", "Function GetUser+"])),
    "Kotlin": ("import a.b.C\n@Deprecated(\"no\") data class P(val x: Int) : Base(), I {\n  private val y = 1\n  suspend fun go(n: Int): String { return \"}\" }\n}\nenum class E { A, B; fun f() {} }\ninterface I { fun f() }\nobject O\nfun String.ext(): Int = 1\ntypealias T = Int\nval top = 2\n", (["import a.b.C"], ["Struct P+", "  Field y-", "  Method go+", "Enum E+", "  Variant A+", "  Variant B+", "Trait I+", "  Method f+", "Struct O+", "Function ext+", "TypeAlias T+", "Constant top+"])),
    "Swift": ("import UIKit\npublic struct P: Codable {\n  private let x: Int\n  public func go(n: Int) async -> String { return \"\" }\n  init(x: Int) { self.x = x }\n}\nprotocol Q { func f() }\nenum E { case a, b(Int)\n case c }\nextension P: Q { func f() {} }\nlet top = 1\n", (["import UIKit"], ["Struct P+", "  Field x-", "  Method go+", "  Method init~", "Trait Q~", "  Method f~", "Enum E~", "  Variant a+", "  Variant b+", "  Variant c+", "Impl P~", "  Method f~", "Constant top~"])),
    "C#": ("using System;\nnamespace A.B {\n  public class C : D, I {\n    private int x = 1;\n    public string Name { get; set; }\n    protected override async Task<int> Go(int n) { return 1; }\n    [Test] public void Works() { }\n  }\n  enum E { One, Two = 2 }\n  public interface I { void F(); }\n}\n", (["using System;"], ["Module A.B+", "  Struct C+", "    Field x-", "    Field Name+", "    Method Go~", "    Method Works+", "  Enum E-", "    Variant One+", "    Variant Two+", "  Trait I+", "    Method F+"])),
    "Objective-C": ("#import <UIKit/UIKit.h>\n@interface Dog : Animal <Pet, Loud>\n@property (nonatomic) NSString *name;\n- (void)bark:(int)times loud:(BOOL)l;\n@end\n@implementation Dog\n- (void)bark:(int)times loud:(BOOL)l {\n}\n+ (id)make {\n}\n@end\n@protocol Pet\n- (void)feed;\n@end\n", (["#import <UIKit/UIKit.h>"], ["Struct Dog+", "  Field name+", "  Method bark:loud:+", "  Method make+", "Trait Pet+", "  Method feed+"])),
    "Ruby": ("require 'set'\nmodule A\n  MAX = 3\n  # Holds.\n  class B < C\n    attr_reader :x, :y\n    def go(n)\n      if n\n        1\n      end\n    end\n    private\n    def hidden; end\n    def self.make\n      [1].each do |i|\n      end\n    end\n  end\nend\ndef top\nend\n", (["require 'set'"], ["Module A+", "  Constant MAX+", "  Struct B+", "    Field x+", "    Field y+", "    Method go+", "    Method hidden-", "    Method self.make-", "Function top+"])),
    "JSON": ('{\n  "name": "x",\n  "scripts": {\n    "build": "tsc {"\n  },\n  "dependencies": {\n    "react": "^1"\n  }\n}\n', (["react"], ["ConfigKey name+", "ConfigKey scripts+", "  ConfigKey build+", "ConfigKey dependencies+", "  ConfigKey react+"])),
    "TOML": ('title = "a # b"\n[package]\nname = "x"\n[dependencies]\nserde = { version = "1" }\n[dependencies.tokio]\nversion = "1"\n', (["serde", "tokio"], ["ConfigKey title+", "ConfigKey package+", "  ConfigKey name+", "ConfigKey dependencies+", "  ConfigKey serde+", "ConfigKey dependencies.tokio+", "  ConfigKey version+"])),
    "YAML": ("version: 3\nservices:\n  web:\n    image: x\n  db:\n    image: y\nname: z\n", ([], ["ConfigKey version+", "ConfigKey services+", "  ConfigKey web+", "  ConfigKey db+", "ConfigKey name+"])),
    "SQL": ("CREATE TABLE IF NOT EXISTS users (\n  id INT PRIMARY KEY,\n  name VARCHAR(10),\n  CONSTRAINT c UNIQUE (name)\n);\ncreate or replace view v as select 1;\nCREATE UNIQUE INDEX i ON users (id);\nCREATE FUNCTION f() RETURNS int AS $$ $$;\n", ([], ["TableDef users+", "  Field id+", "  Field name+", "TableDef v+", "ConfigKey i+", "Function f+"])),
    "Markdown": ("# A\n## B\ntext\n### C\n# D\n", ([], ["Heading A+", "  Heading B+", "    Heading C+", "Heading D+"])),
    "Shell": ("source lib.sh\n# runs\nrun() {\n}\nfunction stop {\n}\nexport A=1\nalias ll='ls'\nif () {\n", (["lib.sh"], ["ShellFunction run+", "ShellFunction stop+", "Constant A+", "Constant ll+"])),
    "XML": ('<?xml version="1.0"?>\n<!-- <no/> -->\n<root a="x>y">\n  <item/>\n  <item/>\n  <other><deep/></other>\n</root>\n', ([], ["Element root+", "  Element item+", "  Element other+"])),
    "HTML": ('<html><head><title>Hi</title>\n<link rel="stylesheet" href="a.css">\n<script src="b.js"></script></head>\n<body><main id="m">\n<section>\n<div id="d"></div>\n<div></div></body></html>\n', (["a.css", "b.js"], ["Element title+", "Element main#m+", "Element section+", "Element div#d+"])),
    "CSS": ('@import url("a.css");\n:root { --main: red; }\n.a, .b > c { color: var(--main); }\n@media (max-width: 3px) { .x { } }\n', (["a.css"], ["Class :root+", "  Constant --main+", "Class .a, .b > c+", "Macro @media+"])),
    "Gradle": ("plugins {\n  id 'java'\n}\ndef v = '1'\ndependencies {\n  implementation 'a:b:1'\n}\ntask hello {\n}\ntasks.register('bye') {\n}\n", (["a:b:1"], ["Module plugins+", "  ConfigKey java+", "Constant v+", "Module dependencies+", "Function hello+", "Function bye+"])),
    "CMake": ("project(App)\nfind_package(Boost)\nadd_library(core a.c)\nadd_executable(app main.c)\nset(SOURCES a.c)\nset(lower a)\noption(WITH_X \"x\" ON)\nfunction(f)\nmacro(m)\nadd_subdirectory(sub)\n", (["Boost", "sub"], ["Module App+", "Module core+", "Function app+", "Constant SOURCES+", "ConfigKey WITH_X+", "Function f+", "Macro m+"])),
    "Properties": ("a.b=1\na.c : 2\n# no\nplain=3\n", ([], ["ConfigKey a+", "  ConfigKey a.b+", "  ConfigKey a.c+", "ConfigKey plain+"])),
    "Python": ("import os\nfrom a import b\nX = 1\n@deco\ndef f(a, *, b=1): pass\nclass C(D):\n    '''Doc.'''\n    def m(self, x): return x\n    def _p(self): pass\n", (["import os", "from a import b"], ["Constant X+", "Function f+", "Struct C+", "  Method m+", "  Method _p-"])),
}


@pytest.mark.parametrize("language", sorted(CASES))
def test_shape(language):
    text, want = CASES[language]
    assert shape(language, text) == want


def test_every_language_has_an_extractor():
    from lattica.sources.languages import ENDINGS, NAMES

    assert set(ENDINGS.values()) | set(NAMES.values()) <= set(extract.EXTRACTORS)


def test_details():
    rust = decls("Rust", CASES["Rust"][0])
    assert rust["Point"].doc == "A point { in space }." and rust["Point"].line == 6 and rust["Point"].signature == "pub struct Point<T>"
    assert rust["Shape for Point<T>"].rels == ["implements Shape"]
    assert rust["go"].metrics == (1, 0, 3) and rust["go"].asynchronous
    java = decls("Java", CASES["Java"][0])
    assert java["Box"].rels == ["extends Base", "implements A", "implements B"] and java["Box"].doc == "Keeps things." and java["works"].test
    assert decls("TypeScript", CASES["TypeScript"][0])["Dog"].rels == ["extends Animal", "implements Pet", "implements Loud"]
    assert decls("Go", CASES["Go"][0])["New"].metrics == (1, 0, 3) and decls("Go", CASES["Go"][0])["Server"].doc == "Server serves."
    assert decls("C++", CASES["C++"][0])["Shape"].rels == ["extends Base", "extends Other"]
    assert decls("C", CASES["C"][0])["run"].metrics == (4, 2, 0) and decls("C", CASES["C"][0])["add"].doc == "adds"
    assert decls("Kotlin", CASES["Kotlin"][0])["P"].deprecated and decls("C#", CASES["C#"][0])["Works"].test


def test_metrics_by_hand():
    body = """
    if a && b { for x in y { match x { 1 => {} _ => { while c {} } } } } else if d || e { } else { }
    let f = |z| { if z { } };
    """
    assert scan.metrics(scan.blanked(body, "Rust"), "Rust") == (9, 4)
    assert scan.metrics("switch (a) { case 1: if (x) return; default: do { y(); } while (z); }", "C") == (5, 2)
    assert scan.metrics("const g = () => { if (a) {} }; return x ? y : z;", "TypeScript") == (2, 0)
    assert scan.parameters("fn f(g: fn(u8) -> u8, n: HashMap<u8, u8>)", 0, "Rust") == 2
    assert scan.parameters("void f(void)", 0, "C") == 0


def test_collapse():
    text = 'class A {\n  f() { if (x) { "}" } /* } */ }\n  // {\n  g = r#"{"#;\n  h() {}\n}\n'
    assert collapse(text) == 'class A {\n  f() { ... }\n  // {\n  g = r#"{"#;\n  h() { ... }\n}\n'
    assert collapse("") == "" and collapse("{ { ") == "{ { ... }" and collapse("a } b {c}") == "a } b {c}"


TYPES = [
    ("pub fn f(&self, a: &mut Vec<Foo>, b: u32) -> Result<Bar, Error>", "Rust", ["Vec", "Foo"], ["Result", "Bar"]),
    ("static Foo *make(const Bar *b, int n)", "C", ["Bar"], ["Foo"]),
    ("func (s *Server) Run(ctx context.Context, a, b Foo) (*Bar, error)", "Go", ["context", "Context", "a", "Foo"], ["Bar"]),
    ("async go(a: Foo<Bar>, b?: string): Promise<Baz>", "TypeScript", ["Foo", "Bar"], ["Promise", "Baz"]),
    ("def f(self, a: Foo = None, b: int = 1) -> list[Bar]", "Python", ["Foo"], ["list", "Bar"]),
    ("fun go(a: Foo = Foo(), b: Int): Bar?", "Kotlin", ["Foo"], ["Bar"]),
    ("@Override public List<Foo> get(final Bar b, int n)", "Java", ["Bar"], ["List", "Foo"]),
    ("public func f(a: Foo, b: [Bar]) throws -> Baz", "Swift", ["Foo", "Bar"], ["Baz"]),
    ("def f(a)", "Ruby", [], []),
]


@pytest.mark.parametrize("signature,language,takes,gives", TYPES)
def test_signature_types(signature, language, takes, gives):
    assert types.signature_types(signature, language) == (takes, gives)
