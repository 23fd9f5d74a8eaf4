"""Outlines of real-looking files, worked out by hand."""

from tracewell.functions.outline import outline

PY = '''import os  # class No:
"""
def not_this(): pass
"""
@decorator
class Pipeline(Base, metaclass=Meta):
    """Doc with def inside."""
    size: int = 3

    def __init__(
        self,
        config: dict[str, int],  # why: (
    ) -> None:
        def helper(x):
            return {"a": 1}
        self.x = "def no(): {"

    async def run(self, a=":") -> str: return a

    class Inner:
        pass


def free(a, b): return (
    a
)
'''
TS = '''import { a } from "x";
/* class Hidden { } */
export class Store<T> extends Base {
  private items: T[] = [];
  constructor(private n: number) { super("function no() {"); }
  async get(key: string): Promise<T> {
    if (key) { return this.items[0]; }
    for (const x of y) { z(x); }
  }
  static of = (n) => { return n; }
}
function* walk(node) {
  const inner = (x) => { return `}${x}{`; };
}
export const make = async (opts: Opts): Promise<void> => {
}
interface Opts { name: string }
'''
GO = '''package main
// func Old() {}
type Server struct {
	name string
}

func (s *Server) Run(ctx context.Context, f func() error) error {
	go func() { s.name = "}" }()
	return nil
}
type Runner interface {
	Run() error
}
func Map[T any](x T) T { return x }
'''
RUST = '''use std::fmt;
/// struct Doc {
pub struct Point<'a> { x: &'a str }
impl<'a> fmt::Display for Point<'a> {
    fn fmt(&self, f: &mut fmt::Formatter) -> fmt::Result {
        let c = '{'; let s = r#"fn no() {"#;
        write!(f, "{}", self.x)
    }
}
pub(crate) async fn load(path: &str) -> Result<(), Error> {
    if path.is_empty() { return Err(Error); }
}
mod tests { fn a() {} }
'''
JAVA = '''package a.b;
@Entity
public class Account implements Comparable<Account> {
    private Map<String, Integer> m = new HashMap<>() {{ put("a", 1); }};
    public Account(String name) { this.name = name; }
    @Override
    public int compareTo(Account o) throws IllegalStateException {
        synchronized (this) { while (true) { break; } }
        return 0;
    }
    enum Kind { A, B }
    void later();
}
'''
C = '''#include <stdio.h>
#define BLOCK(x) do { x } while (0)
struct node {
    int v;
};
static int add(int a,
               int b)
{
    if (a) { return '{'; }
    return a + b;
}
int later(void);
namespace app { class Box : public Base { Box() : n(1) {} int get() const { return n; } }; }
int Box::size() const noexcept { return 0; }
'''


def names(text, language):
    return [(line, end, depth, kind, name) for line, end, depth, kind, name, _ in outline(text, language)]


def test_python():
    assert names(PY, "python") == [(6, 21, 0, "class", "Pipeline"), (10, 16, 1, "function", "__init__"), (18, 18, 1, "function", "run"), (20, 21, 1, "class", "Inner"), (24, 26, 0, "function", "free")]
    heads = [x[5] for x in outline(PY, "python")]
    assert heads[0] == "class Pipeline(Base, metaclass=Meta)" and heads[1] == "def __init__( self, config: dict[str, int], ) -> None"


def test_script():
    want = [(3, 11, 0, "class", "Store"), (5, 5, 1, "method", "constructor"), (6, 9, 1, "method", "get"), (12, 14, 0, "function", "walk"), (15, 16, 0, "function", "make"), (17, 17, 0, "interface", "Opts")]
    assert [x for x in names(TS, "typescript") if x[4] != "of"] == want
    assert outline(TS, "typescript")[2][5] == "async get(key: string): Promise<T>"


def test_go():
    assert names(GO, "go") == [(3, 5, 0, "struct", "Server"), (7, 10, 0, "function", "Run"), (11, 13, 0, "interface", "Runner"), (14, 14, 0, "function", "Map")]


def test_rust():
    assert names(RUST, "rust") == [(3, 3, 0, "struct", "Point"), (4, 9, 0, "impl", "fmt::Display for Point<'a>"), (5, 8, 1, "function", "fmt"), (10, 12, 0, "function", "load"), (13, 13, 0, "mod", "tests"), (13, 13, 1, "function", "a")]


def test_java():
    assert names(JAVA, "java") == [(2, 13, 0, "class", "Account"), (5, 5, 1, "method", "Account"), (6, 10, 1, "method", "compareTo"), (11, 11, 1, "enum", "Kind")]


def test_c():
    assert names(C, "cpp") == [(3, 5, 0, "struct", "node"), (6, 11, 0, "function", "add"), (13, 13, 0, "namespace", "app"), (13, 13, 1, "class", "Box"), (13, 13, 2, "function", "Box"), (13, 13, 2, "function", "get"), (14, 14, 0, "function", "Box::size")]


def test_odd_texts():
    assert outline(None, "python") == outline("", "go") == outline("x", "cobol") == outline("x", None) == []
    assert names("class A:\n    def f(self", "python") == [(1, 2, 0, "class", "A"), (2, 2, 1, "function", "f")]
    assert names("class A { m() {", "javascript") == [(1, 1, 0, "class", "A"), (1, 1, 1, "method", "m")]
    assert names("}}} function f() { }", "javascript") == [(1, 1, 0, "function", "f")]
    assert names("\"\"\"never closed\ndef f(): pass", "python") == []


def test_as_rows_and_lines(spark):
    from tracewell.operators import outlines as O

    many = "\n".join(f"def f{k}(): pass" for k in range(7))
    files = [("a.py", "python", PY), ("b.txt", None, "\n".join(map(str, range(80)))), ("c.py", "python", many), ("d.go", "go", None), ("e.rs", "rust", RUST)]
    df = spark.createDataFrame([f + ("x",) for f in files], "path string, language string, content string, line string")
    rows = {(r.path, r.line, r.name) for r in O.outlines(df).collect()}
    assert {("a.py", 10, "__init__"), ("e.rs", 5, "fmt"), ("c.py", 7, "f6")} <= rows and not any(p in ("b.txt", "d.go") for p, _, _ in rows)
    got = {r.path: r.outline for r in O.source_outlines(df, most=5).collect()}
    assert got["c.py"] == "\n".join(f"def f{k}()" for k in range(4)) + "\n... (3 more)"
    assert got["b.txt"] == "\n".join(map(str, range(50))) and got["d.go"] == "" and got["a.py"].splitlines()[1].startswith("    def __init__")
    assert O.outlines(df.limit(0)).count() == O.source_outlines(df.limit(0)).count() == 0
