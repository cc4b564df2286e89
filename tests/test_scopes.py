"""Scopes of languages with braces: what each declares, calls, extends and imports; odd and very long texts."""

from __future__ import annotations

import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from treeline.operators import facts
from treeline.operators.braces import GO, JAVA, PHP, SCRIPT, brace_facts

TS = r"""import D, { A, Bee as B } from './d'
import * as ns from '../ns';
import './side'
const { part, q: r } = require('lib')
/** An animal
 * of the zoo. */
@Entity({a: 1})
export class Animal<T> extends ns.Base<T, {}> implements X, Y {
  name: string
  #secret = 1
  private cb = async (a) => { run(a) }
  constructor(name: string) { super(name); this.name = name }
  get speak<K extends string>(x: K): string {
    if (check(x)) { return `${this.fmt({a: x})} makes } a {` }
    return x.replace(/[{'"]/g, "").match(1)
  }
}
interface S { ser(): string; de(d: string): void }
type Alias = { a: string }
function add(a: number, b = other()): number { return a + b / 2 }
const multiply = (a: number, b: number): number => a * helper(b);
const obj = { fmt(a, b) { return join(a, b) }, x: { y() { } } }
export default async function load(url) {
  const [u, setU] = useState<User | null>(null)
  useEffect(() => { fetch(url).then(r => r.json()) }, [url])
  function inner() { return new ns.Thing(1, 2,) }
}
enum E { A = 1 }
"""

JAVA_TEXT = r"""package a.b;
import java.util.List;
import static java.lang.Math.*;
/** Doc
 * here. */
@RestController
@RequestMapping("/api")
public class Dog extends Animal implements Printable, Z<Q, R> {
    private final List<String> xs = make();
    static { boot(); }
    public Dog(String name) { super(name); this.bark(1); }
    @Override
    public <T> Map<String, T> print(int a, String b) throws E {
        System.out.println(getName("}"));
        for (int i = 0; i < n(); i++) { new Foo<>(i).go(); }
        bark(2);
        Runnable r = () -> { super.print(1); };
        return new int[] {1, 2};
    }
    void bark(int n) {}
    enum K { A(1), B(2) { int z() { return '}'; } }; K(int x) {} }
    record P(int x) { P { ok(x); } }
    interface I extends J { void m(); }
}
"""

GO_TEXT = r"""package main
import (
  "fmt"
  h "net/http"
)
import "os"
type Base struct { id int }
type Server struct {
  *Base
  h.Handler
  name string `json:"{"`
}
type R interface { Read(p []byte) (int, error) }
func (s *Server) Start(port int) error {
  if err := s.listen(port); err != nil { return fmt.Errorf("x %d {", port) }
  go func() { s.run() }()
  return nil
}
func (l *List[T]) Len() int { return size(l) }
func Map[T any](xs []T, f func(T) T) []T {
  for _, x := range items(xs) { f(x) }
  r := '{'
  return out(xs, r)
}
"""

PHP_TEXT = r"""<html>{ <?php
namespace App;
use App\Models\User as U;
use Lib\{A, B as C};
# note {
#[Attr(1)]
abstract class Repo extends \Base implements I {
    use Soft;
    private $x = 'a{b';
    public function __construct(private U $u) { parent::__construct($u); }
    public static function make(): self { return new self(1); }
    public function find($id) { $this->log("id {$id}"); return self::make()->run(U::q($id)); }
    abstract protected function go();
}
trait T { function t() { helper(); } }
function top($a) { $f = function ($x) use ($a) { return other($x); }; return <<<EOT
 { foo(
EOT; }
?> } <?php top(1);
"""


def symbols(found):
    return [(s[0], s[1], s[4], s[5]) for s in found["symbols"]]


def calls(found):
    return [(c[0], c[1], c[2], c[4]) for c in found["calls"]]


def test_scripts():
    f = brace_facts(TS, SCRIPT)
    assert symbols(f) == [
        ("Animal", "class", 7, 17), ("Animal.cb", "method", 11, 11), ("Animal.constructor", "constructor", 12, 12), ("Animal.speak", "method", 13, 16), ("S", "interface", 18, 18),
        ("add", "function", 20, 20), ("multiply", "function", 21, 21), ("load", "function", 23, 27), ("load.inner", "function", 26, 26), ("E", "enum", 28, 28),
    ]
    assert f["symbols"][0][3] == "An animal of the zoo." and f["symbols"][0][6] == ["Entity"] and f["symbols"][5][2] == "add(a: number, b = other())"
    assert calls(f) == [
        ("Animal.cb", "run", "function", 1), ("Animal.constructor", "super", "function", 1), ("Animal.speak", "check", "function", 1), ("Animal.speak", "this.fmt", "method", 1),
        ("Animal.speak", "x.replace", "method", 2), ("Animal.speak", "().match", "method", 1), ("", "other", "function", 0), ("multiply", "helper", "function", 1), ("", "join", "function", 2),
        ("load", "useState", "function", 1), ("load", "useEffect", "function", 2), ("load", "fetch", "function", 1), ("load", "().then", "method", 1), ("load", "r.json", "method", 0),
        ("load.inner", "ns.Thing.<init>", "constructor", 2),
    ]
    assert f["inheritances"] == [("Animal", "ns.Base"), ("Animal", "X"), ("Animal", "Y")]
    assert f["imports"] == [
        ("./d", [], [], False, "D"), ("./d", ["A", "Bee"], ["A", "B"], True, None), ("../ns", [], [], False, "ns"), ("./side", [], [], False, None), ("lib", ["part", "q"], ["part", "r"], True, None),
    ]


def test_java():
    f = brace_facts(JAVA_TEXT, JAVA)
    assert symbols(f) == [
        ("Dog", "class", 6, 24), ("Dog.Dog", "constructor", 11, 11), ("Dog.print", "method", 12, 19), ("Dog.bark", "method", 20, 20), ("Dog.K", "enum", 21, 21), ("Dog.K.K", "constructor", 21, 21),
        ("Dog.P", "record", 22, 22), ("Dog.P.P", "constructor", 22, 22), ("Dog.I", "interface", 23, 23), ("Dog.I.m", "method", 23, 23),
    ]
    assert f["symbols"][0][3] == "Doc here." and f["symbols"][0][6] == ["RestController", "RequestMapping"] and f["symbols"][2][6] == ["Override"]
    assert calls(f) == [
        ("Dog", "make", "function", 0), ("Dog", "boot", "function", 0), ("Dog.Dog", "Animal.<init>", "constructor", 1), ("Dog.Dog", "Dog.bark", "method", 1), ("Dog.print", "System.out.println", "static_method", 1),
        ("Dog.print", "getName", "function", 1), ("Dog.print", "n", "function", 0), ("Dog.print", "Foo.<init>", "constructor", 1), ("Dog.print", "().go", "method", 0), ("Dog.print", "Dog.bark", "method", 1),
        ("Dog.print", "Animal.print", "method", 1), ("Dog.P.P", "ok", "function", 1),
    ]
    assert f["inheritances"] == [("Dog", "Animal"), ("Dog", "Printable"), ("Dog", "Z"), ("Dog.I", "J")]
    assert f["imports"] == [("java.util.List", [], [], False, "List"), ("java.lang.Math", ["*"], ["*"], True, None)]


def test_go():
    f = brace_facts(GO_TEXT, GO)
    assert symbols(f) == [("Base", "struct", 7, 7), ("Server", "struct", 8, 12), ("R", "interface", 13, 13), ("Server.Start", "method", 14, 18), ("List.Len", "method", 19, 19), ("Map", "function", 20, 24)]
    assert calls(f) == [
        ("Server.Start", "s.listen", "method", 1), ("Server.Start", "fmt.Errorf", "method", 2), ("Server.Start", "s.run", "method", 0), ("List.Len", "size", "function", 1),
        ("Map", "items", "function", 1), ("Map", "f", "function", 1), ("Map", "out", "function", 2),
    ]
    assert f["inheritances"] == [("Server", "Base"), ("Server", "h.Handler")]
    assert f["imports"] == [("fmt", [], [], False, "fmt"), ("net/http", [], [], False, "h"), ("os", [], [], False, "os")]


def test_php():
    f = brace_facts(PHP_TEXT, PHP)
    assert symbols(f) == [
        ("Repo", "class", 6, 14), ("Repo::__construct", "method", 10, 10), ("Repo::make", "method", 11, 11), ("Repo::find", "method", 12, 12), ("Repo::go", "method", 13, 13),
        ("T", "trait", 15, 15), ("T::t", "method", 15, 15), ("top", "function", 16, 18),
    ]
    assert calls(f) == [
        ("Repo::__construct", "Base::__construct", "static_method", 1), ("Repo::make", "Repo::__construct", "constructor", 1), ("Repo::find", "Repo::log", "method", 1), ("Repo::find", "Repo::make", "static_method", 0),
        ("Repo::find", "()::run", "method", 1), ("Repo::find", "U::q", "static_method", 1), ("T::t", "helper", "function", 0), ("top", "other", "function", 1), ("", "top", "function", 1),
    ]
    assert f["inheritances"] == [("Repo", "Base"), ("Repo", "I")]
    assert f["imports"] == [("App\\Models\\User", [], [], False, "U"), ("Lib\\A", [], [], False, "A"), ("Lib\\B", [], [], False, "C")]


PIECES = "class function func type struct interface extends implements new return const import from use => -> :: ?. . , ; : = { } ( ) [ ] < > @ # / ` ${ ' \" \\ \n // /* */ /** <?php ?> <<<A A a b m 1 this super".split(" ")


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=40), st.sampled_from([SCRIPT, JAVA, GO, PHP]))
def test_broken_files_do_not_fail(pieces, tongue):
    text = " ".join(pieces)
    n = text.count("\n") + 1
    for found in (brace_facts(text, tongue), brace_facts("<?php " + text, tongue)):
        assert all(1 <= s[4] <= s[5] <= n for s in found["symbols"])
        assert all(1 <= c[3] <= n and c[4] >= 0 for c in found["calls"])


@pytest.mark.parametrize(
    "text",
    ["x = {" + "a: {b: [1, f(2)]}, " * 10_000 + "}", "f(" + "{a: 1}, " * 20_000 + ")", "class A {\n" + "m() { g() }\n" * 10_000 + "}", "a\n" + ".b(1)\n" * 20_000, "f(" * 20_000, "{" * 20_000, "'" * 33_333, "x = " + "a < " * 20_000, "@A " * 20_000],
    ids=["object", "arguments", "methods", "chain", "calls", "braces", "quotes", "less", "marks"],
)
def test_time_grows_with_length(text):
    began = time.process_time()
    for tongue in (SCRIPT, JAVA, GO):
        brace_facts(text, tongue)
    assert time.process_time() - began < 20


def test_null_empty_and_unknown_files(spark):
    rows = [("r", "a.ts", "typescript", None), ("r", "b.java", "java", ""), ("r", "c.rs", "rust", "fn a() {}"), ("r", "d.go", "go", GO_TEXT)]
    found = facts.extract(spark.createDataFrame(rows, "repo string, rel_path string, language string, content string"))
    assert sorted((r.rel_path, r.error, len(r.symbols)) for r in found.collect()) == [("a.ts", None, 0), ("b.java", None, 0), ("d.go", None, 6)]
