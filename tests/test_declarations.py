"""Declarations of six languages, on sources written for this test."""

import random
import time

import pytest

from loomquery.sources.declarations import declarations, tokens

SOURCES = {
'a.ts':'''import d, { x as y, type Q } from "./m";
import * as ns from '../n';
import "side";
export { z } from "./re";
export class OrderService<T> extends ns.Base<T> implements I {
  private items: Box<Order>[] = [];
  readonly a?: string
  repo = new Repo(1)
  constructor(private db: Db, n = 3) { super(); const q: Queue = make(); }
  async run(o: Order | null): Promise<Order[]> {
    let b = new B();
    if (o) { b = new C() }
    this.late = new Late();
    b.cancel();
    for (const i of o) { }
  }
  get size(): number { return 1 }
}
interface Shape extends Round { area(): number; r: number; B: (x: number) => void }
export const make = async (b: B): Promise<X> => { const v = b.go(); };
function top(a: A) { a.x({ k: 1 }) }
enum E { A, B }
''',
'a.py':'''import os, a.b as c
from .x import (p, q as r)
class B(pkg.A, metaclass=M):
    n: int = 3
    def __init__(self, db: Db, k=1) -> None:
        """doc: {"""
        self.db = Db()
        self.name: str = "x"
        x = Order(1)
        if x:
            x = Other()
        x.cancel()
    @staticmethod
    def s(a: "List[Q]") -> Optional[T]:
        return {1: 2}
y = B(2)
def top(z: B):
    w = z.make()
''',
'a.go':'''package m
import (
  "fmt"
  alias "x/y"
)
type K struct {
	A, B string
	P *pkg.T `json:"x"`
	Embedded
}
type I interface { Do(x int) error }
func (r *K) Run(b *Order, n int) (*Res, error) {
	x := Foo{A: 1}
	y := &pkg.Bar{}
	var z Baz
	z.Cancel()
	if n > 0 { x = Other{} }
	return nil, nil
}
func Top[T any](a A) *B { q := new(Q); q.Go() }
''',
'a.rs':'''use crate::a::{b, c as d};
pub use std::fmt;
#[derive(Debug)]
pub struct K<'a> { pub a: u32, pub(crate) b: String }
impl<'a> Shape for K<'a> {
    pub fn run(&self, o: &Order, n: u32) -> Result<T, E> {
        let mut x = Foo::new(1);
        let y: Box<Bar> = make();
        let z = Baz { a: 1 };
        x.cancel();
    }
    fn other() -> Self { K { a: 1 } }
}
fn main() { let k: K = K::other(); }
''',
'a.cpp':'''#include <vector>
#include "m/x.h"
#define X {
template <class T> class K : public virtual ns::Base, private Other {
 public:
  K(int x) : a(x) {}
  const int a = 3;
  std::vector<int> *b;
  void m(int x);
  int go(Order &o, const B *p) const { auto q = new Q(1); o.cancel(); Foo f(2); Bar g; return 1; }
};
struct P { int x, y; };
static int Engine::cancel(int id) { Order* w = make(); w->go(); }
int main() { if (x) { y(); } }
''',
'a.cs':'''using System.Text;
using X = A.B;
namespace N.M {
[Attr(1)]
public sealed class K<T> : Ns.Base<T>, IFace where T : class {
    private readonly Repo repo;
    public int Size { get; set; }
    public List<Order> Items = new();
    public K(Db db) { this.db = db; }
    public async Task<Res> Run(Order o, int n = 1) {
        var b = new B(1);
        Queue q = Make();
        b.Cancel();
        if (n > 0) { b = new C(); }
        foreach (var x in y) { }
    }
    public int One() => 1;
}
public record R(string A, int B);
}
'''}

WANT = {
    'a.ts': {
        'symbols': [('OrderService', 'class', True, 5, 18, 0, None, None), ('constructor', 'method', False, 9, 9, 2, 'OrderService', None), ('run', 'method', False, 10, 16, 1, 'OrderService', 'Promise<Order[]>'), ('size', 'method', False, 17, 17, 0, 'OrderService', 'number'), ('Shape', 'interface', False, 19, 19, 0, None, None), ('make', 'function', True, 20, 20, 1, None, 'Promise<X>'), ('top', 'function', False, 21, 21, 1, None, None), ('E', 'enum', False, 22, 22, 0, None, None)],
        'imports': [('./m', ['d', 'x', 'Q'], 1), ('../n', ['*'], 2), ('side', [], 3), ('./re', ['z'], 4)],
        'parents': [('OrderService', 'Base', 5), ('Shape', 'Round', 19)],
        'fields': [('OrderService', 'items', 'Box<Order>[]', 6), ('OrderService', 'a', 'string', 7), ('OrderService', 'repo', 'Repo', 8), ('OrderService', 'late', 'Late', 13), ('Shape', 'r', 'number', 19), ('Shape', 'B', '(x:number)=>void', 19)],
        'bindings': [(9, 'OrderService', 'db', 'Db', 9, 2), (9, 'OrderService', 'q', 'Queue', 9, 2), (10, 'OrderService', 'o', 'Order', 10, 3), (10, 'OrderService', 'b', 'B', 11, 3), (10, 'OrderService', 'b', 'C', 12, 4), (20, None, 'b', 'B', 20, 8), (20, None, 'v', None, 20, 8), (21, None, 'a', 'A', 21, 9)],
        'calls': [('super', None, 9, 9, 'OrderService', 0), ('make', None, 9, 9, 'OrderService', 0), ('cancel', 'b', 14, 10, 'OrderService', 0), ('go', 'b', 20, 20, None, 0), ('x', 'a', 21, 21, None, 1)],
    },
    'a.py': {
        'symbols': [('B', 'class', True, 3, 15, 0, None, None), ('__init__', 'method', True, 5, 12, 2, 'B', 'None'), ('s', 'method', True, 14, 15, 1, 'B', 'Optional[T]'), ('top', 'function', True, 17, 19, 1, None, None)],
        'imports': [('os', [], 1), ('a.b', [], 1), ('.x', ['p', 'q'], 2)],
        'parents': [('B', 'A', 3)],
        'fields': [('B', 'n', 'int', 4), ('B', 'db', 'Db', 7), ('B', 'name', 'str', 8)],
        'bindings': [(5, 'B', 'db', 'Db', 5, 2), (5, 'B', 'x', 'Order', 9, 2), (5, 'B', 'x', 'Other', 11, 3), (14, 'B', 'a', 'Q', 14, 4), (0, None, 'y', 'B', 16, 0), (17, None, 'z', 'B', 17, 5), (17, None, 'w', None, 18, 5)],
        'calls': [('Db', None, 7, 5, 'B', 0), ('Order', None, 9, 5, 'B', 1), ('Other', None, 11, 5, 'B', 0), ('cancel', 'x', 12, 5, 'B', 0), ('B', None, 16, 0, None, 1), ('make', 'z', 18, 17, None, 0)],
    },
    'a.go': {
        'symbols': [('K', 'struct', True, 6, 10, 0, None, None), ('I', 'interface', True, 11, 11, 0, None, None), ('Run', 'method', True, 12, 19, 2, 'K', '(*Res,error)'), ('Top', 'function', True, 20, 20, 1, None, '*B')],
        'imports': [('fmt', ['*'], 2), ('x/y', ['*'], 2)],
        'parents': [('K', 'Embedded', 9)],
        'fields': [('K', 'A', 'string', 7), ('K', 'B', 'string', 7), ('K', 'P', '*pkg.T', 8)],
        'bindings': [(12, 'K', 'b', 'Order', 12, 3), (12, 'K', 'n', 'int', 12, 3), (12, 'K', 'r', 'K', 12, 3), (12, 'K', 'x', 'Foo', 13, 3), (12, 'K', 'y', 'Bar', 14, 3), (12, 'K', 'z', 'Baz', 15, 3), (12, 'K', 'x', 'Other', 17, 6), (20, None, 'a', 'A', 20, 8), (20, None, 'q', 'Q', 20, 8)],
        'calls': [('Cancel', 'z', 16, 12, 'K', 0), ('Go', 'q', 20, 20, None, 0)],
    },
    'a.rs': {
        'symbols': [('K', 'struct', True, 4, 4, 0, None, None), ('run', 'method', True, 6, 11, 2, 'K', 'Result<T,E>'), ('other', 'method', False, 12, 12, 0, 'K', 'Self'), ('main', 'function', False, 14, 14, 0, None, None)],
        'imports': [('crate::a', ['b', 'c'], 1), ('std', ['fmt'], 2)],
        'parents': [],
        'fields': [('K', 'a', 'u32', 4), ('K', 'b', 'String', 4)],
        'bindings': [(6, 'K', 'o', 'Order', 6, 3), (6, 'K', 'n', 'u32', 6, 3), (6, 'K', 'x', 'Foo', 7, 3), (6, 'K', 'y', 'Bar', 8, 3), (6, 'K', 'z', 'Baz', 9, 3), (14, None, 'k', 'K', 14, 7)],
        'calls': [('make', None, 8, 6, 'K', 0), ('cancel', 'x', 10, 6, 'K', 0), ('other', 'K', 14, 14, None, 0)],
    },
    'a.cpp': {
        'symbols': [('K', 'class', True, 4, 11, 0, None, None), ('K', 'method', True, 6, 6, 1, 'K', None), ('go', 'method', True, 10, 10, 2, 'K', 'int'), ('P', 'struct', True, 12, 12, 0, None, None), ('cancel', 'method', True, 13, 13, 1, 'Engine', 'int'), ('main', 'function', True, 14, 14, 0, None, 'int')],
        'imports': [('vector', ['*'], 1), ('m/x.h', ['*'], 2)],
        'parents': [('K', 'Base', 4), ('K', 'Other', 4)],
        'fields': [('K', 'a', 'int', 7), ('K', 'b', 'std::vector<int>*', 8), ('P', 'x', 'int', 12), ('P', 'y', 'int', 12)],
        'bindings': [(6, 'K', 'x', 'int', 6, 2), (10, 'K', 'o', 'Order', 10, 3), (10, 'K', 'p', 'B', 10, 3), (10, 'K', 'q', 'Q', 10, 3), (10, 'K', 'f', 'Foo', 10, 3), (10, 'K', 'g', 'Bar', 10, 3), (13, 'Engine', 'id', 'int', 13, 5), (13, 'Engine', 'w', 'Order', 13, 5)],
        'calls': [('cancel', 'o', 10, 10, 'K', 0), ('make', None, 13, 13, 'Engine', 0), ('go', 'w', 13, 13, 'Engine', 0), ('y', None, 14, 14, None, 0)],
    },
    'a.cs': {
        'symbols': [('K', 'class', True, 5, 18, 0, None, None), ('K', 'method', True, 9, 9, 1, 'K', None), ('Run', 'method', True, 10, 16, 2, 'K', 'Task<Res>'), ('One', 'method', True, 17, 17, 0, 'K', 'int'), ('R', 'record', True, 19, 19, 0, None, None)],
        'imports': [('System.Text', ['*'], 1), ('A.B', ['*'], 2)],
        'parents': [('K', 'Base', 5), ('K', 'IFace', 5)],
        'fields': [('K', 'repo', 'Repo', 6), ('K', 'Size', 'int', 7), ('K', 'Items', 'List<Order>', 8), ('K', 'db', None, 9), ('R', 'A', 'string', 19), ('R', 'B', 'int', 19)],
        'bindings': [(9, 'K', 'db', 'Db', 9, 4), (10, 'K', 'o', 'Order', 10, 5), (10, 'K', 'n', 'int', 10, 5), (10, 'K', 'b', 'B', 11, 5), (10, 'K', 'q', 'Queue', 12, 5), (10, 'K', 'b', 'C', 14, 6)],
        'calls': [('Make', None, 12, 10, 'K', 0), ('Cancel', 'b', 13, 10, 'K', 0)],
    },
}


@pytest.mark.parametrize("path", sorted(SOURCES))
def test_declarations(path):
    found = declarations(path, SOURCES[path])
    assert {k: getattr(found, k) for k in WANT[path]} == WANT[path]


@pytest.mark.parametrize("path", sorted(SOURCES))
def test_broken_sources_end(path):
    """Cut-off and shuffled texts give rows or none, and no error; lines stay inside the text."""
    rng, text = random.Random(1), SOURCES[path]
    for n in range(300):
        broken = text[: rng.randint(0, len(text))] if n % 2 else "".join(rng.sample(text, len(text)))
        found = declarations(path, broken)
        assert all(1 <= s[3] <= s[4] <= broken.count("\n") + 1 for s in found.symbols)


def test_long_sources_take_time_in_proportion():
    for unit, path in (("f(", "a.ts"), ("{", "a.cpp"), ("x = y\n", "a.py"), ("class K<", "a.cs"), ("a, ", "a.go"), ("'"*3, "a.py"), ("/*", "a.rs"), ("if x:\n ", "a.py")):
        times = []
        for n in (5_000, 20_000):
            start = time.process_time()
            declarations(path, unit * n)
            times.append(time.process_time() - start)
        assert times[1] < 10 * times[0] + 0.5, (unit, times)


def test_nothing_to_read():
    for path, text in ((None, "x"), ("a.txt", "class K {"), ("a.ts", None), ("a.ts", "")):
        found = declarations(path, text)
        assert not found.symbols and not found.bindings
    assert [t.text for t in tokens("if a:\n  b\nc", "python")] == ["if", "a", "{", "b", "\n", "}", "c", "\n"]
