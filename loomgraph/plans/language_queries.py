"""Queries of parsers: sources of many shapes, made from the driver's rows, with what each should give."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.plans import index
from loomgraph.plans.registry import query

#: By shape: suffix, source, symbols (kind, name below the module, first and last line), and edges other than DEFINES
#: (source, kind, callee, receiver). @V is a number of the file.
SHAPES: list[tuple[str, str, list[tuple], list[tuple]]] = [
    (
        "js",
        """import x, {y} from 'y@V';
export default class Widget@V extends Base {
  #count = init();
  render(size = dflt()) {
    return draw@V(this.box(size).width());
  }
}
export async function draw@V() { await x.load(); }
""",
        [("Class", "Widget@V", 2, 7), ("Method", "Widget@V.render", 4, 6), ("Function", "draw@V", 8, 8)],
        [
            ("", "IMPORTS", "import x, {y} from 'y@V';", "import x, {y} from 'y@V';"), ("Widget@V", "INHERITS", "Base", ""), ("Widget@V.render", "CALLS", "dflt", ""),
            ("Widget@V.render", "CALLS", "draw@V", ""), ("Widget@V.render", "CALLS", "width", "this.box(size)"), ("Widget@V.render", "CALLS", "box", "this"), ("draw@V", "CALLS", "load", "x"),
        ],
    ),
    (
        "mjs",
        """function outer@V(a) {
  // comment call(1)
  const s = `t ${inner(a)} } {` + "x(y)" + 'z(\\')';
  if (/re(g)[/(]/.test(s)) { while (more()) { } }
  function nested() { deep@V(); }
  list.filter(e => ok(e))
    .catch(e => { log.warn(e); });
  new Thing(arg()).go(); new Plain(); import("z"); tag`v`;
  return (async (q) => { await q(); })();
}
outer@V(1);
""",
        [("Function", "outer@V", 1, 10), ("Function", "outer@V.nested", 5, 5)],
        [
            ("outer@V", "CALLS", "inner", ""), ("outer@V", "CALLS", "test", "/re(g)[/(]/"), ("outer@V", "CALLS", "more", ""), ("outer@V.nested", "CALLS", "deep@V", ""),
            ("outer@V", "CALLS", "catch", "list.filter(e => ok(e))"), ("outer@V", "CALLS", "filter", "list"), ("outer@V", "CALLS", "ok", ""), ("outer@V", "CALLS", "warn", "log"),
            ("outer@V", "CALLS", "go", "new Thing(arg())"), ("outer@V", "CALLS", "arg", ""), ("outer@V", "CALLS", "tag", ""), ("outer@V", "CALLS", "q", ""),
        ],
    ),
    (
        "cjs",
        """const api@V = {
  get size() { return count@V(); },
  async load(id) { return this.fetch(id); },
  late: function () { hidden(); },
  arrow: () => hidden(),
};
function make() {
  const K = class extends Base { run() { items[0](); (f)(); } };
  return { build() { return K.of?.(1); } };
}
""",
        [("Method", "size", 2, 2), ("Method", "load", 3, 3), ("Function", "make", 7, 10), ("Method", "make.run", 8, 8), ("Method", "make.build", 9, 9)],
        [
            ("size", "CALLS", "count@V", ""), ("load", "CALLS", "fetch", "this"), ("make.run", "CALLS", "items", ""), ("make.run", "CALLS", "f", ""), ("make.build", "CALLS", "of", "K"),
        ],
    ),
    (
        "jsx",
        """function View@V(props) {
  return (
    <ul className="x (y)" onClick={() => pick@V()}>
      It's text (not a call) {props.items.map(i => <li key={i}>{show(i)} call(1)</li>)}
    </ul>
  );
}
""",
        [("Function", "View@V", 1, 7)],
        [("View@V", "CALLS", "pick@V", ""), ("View@V", "CALLS", "map", "props.items"), ("View@V", "CALLS", "show", "")],
    ),
    (
        "ts",
        """import type { A } from "./a@V";
export abstract class Store@V<T extends { a: number }> extends Base<T> implements I {
  private readonly x: Map<string, () => void> = new Map();
  constructor(private a: number, b?: string) { super(); this.init<string>(b!); }
  abstract run(): void;
  over(a: string): void;
  over(a: any): { k: number } { return make<Foo>({ a: g@V() }); }
  public get val(): number { return (x as any).c(); }
}
""",
        [
            ("Class", "Store@V", 2, 9), ("Method", "Store@V.constructor", 4, 4), ("Method", "Store@V.over", 6, 6), ("Method", "Store@V.over", 7, 7),
            ("Method", "Store@V.val", 8, 8),
        ],
        [
            ("", "IMPORTS", 'import type { A } from "./a@V";', 'import type { A } from "./a@V";'), ("Store@V.constructor", "CALLS", "init", "this"),
            ("Store@V.over", "CALLS", "make", ""), ("Store@V.over", "CALLS", "g@V", ""), ("Store@V.val", "CALLS", "c", "(x as any)"),
        ],
    ),
    (
        "ts",
        """interface Shape@V extends Other {
  area(): number
  name: string
  scale?(by: number): Shape@V
}
namespace geo {
  export function grow<T>(s: T, f: (x: T) => T): T { return f(s as T); }
}
declare function outside(a: number): void;
function check(a: unknown): asserts a is string { if (a < b && c > (d)) { fail@V(); } }
""",
        [("Class", "Shape@V", 1, 5), ("Method", "Shape@V.area", 2, 2), ("Method", "Shape@V.scale", 4, 4), ("Function", "grow", 7, 7), ("Function", "check", 10, 10)],
        [("grow", "CALLS", "f", ""), ("check", "CALLS", "fail@V", "")],
    ),
    (
        "java",
        """package p.q;
import static a.B.*;
@Ann(value = "x")
public class Sample@V<T extends Foo> extends a.b.Base implements I, J {
    private int x = compute();
    @Override
    public <U> Map<String, List<U>> run(int a, @NonNull String b) throws E {
        helper@V(); this.x.go(arg(1)).next();
        new Thread(() -> work()) { void body() { inner(); } }.start();
        return null;
    }
    Sample@V(int q) { super(q); int[] z = {1, 2}; List.<String>of(1); }
    abstract void last();
}
""",
        [
            ("Class", "Sample@V", 3, 14), ("Method", "Sample@V.run", 6, 11), ("Method", "Sample@V.run.body", 9, 9), ("Method", "Sample@V.Sample@V", 12, 12), ("Method", "Sample@V.last", 13, 13),
        ],
        [
            ("", "IMPORTS", "import static a.B.*;", "import static a.B.*;"), ("Sample@V", "INHERITS", "a.b.Base", ""), ("Sample@V.run", "CALLS", "helper@V", ""), ("Sample@V.run", "CALLS", "next", ""),
            ("Sample@V.run", "CALLS", "go", ""), ("Sample@V.run", "CALLS", "arg", ""), ("Sample@V.run", "CALLS", "start", ""), ("Sample@V.run", "CALLS", "work", ""),
            ("Sample@V.run.body", "CALLS", "inner", ""), ("Sample@V.Sample@V", "CALLS", "of", ""),
        ],
    ),
    (
        "java",
        """enum Color@V implements K {
    RED(1) { void paint() { dye(); } }, BLUE(2);
    Color@V(int v) { set(v); }
}
interface K extends L { default int size() { return count@V(); } int plain(); }
record P(int x, int y) { P { check(x); } int sum() { return add(x, y); } }
@interface An { String value() default ""; }
class G extends Gen<T> { }
""",
        [
            ("Class", "Color@V", 1, 4), ("Method", "Color@V.paint", 2, 2), ("Method", "Color@V.Color@V", 3, 3), ("Class", "K", 5, 5), ("Method", "K.size", 5, 5), ("Method", "K.plain", 5, 5),
            ("Method", "sum", 6, 6), ("Class", "G", 8, 8),
        ],
        [("Color@V.paint", "CALLS", "dye", ""), ("Color@V.Color@V", "CALLS", "set", ""), ("K.size", "CALLS", "count@V", ""), ("sum", "CALLS", "add", "")],
    ),
    (
        "java",
        '''class Text@V {
    /* call(0) { */ char c = '{', d = '\\'';
    String s() {
        String t = """
            block { call(1) "quoted" }
            """; // call(2)
        return "a \\" call(3) {" + t.trim();
    }
    Runnable r = () -> { dropped(); };
    void m() { switch (k()) { case 1 -> one(); default -> { two@V(); } } assert (b); String::valueOf; }
}
''',
        [("Class", "Text@V", 1, 11), ("Method", "Text@V.s", 3, 8), ("Method", "Text@V.m", 10, 10)],
        [("Text@V.s", "CALLS", "trim", ""), ("Text@V.m", "CALLS", "k", ""), ("Text@V.m", "CALLS", "one", ""), ("Text@V.m", "CALLS", "two@V", "")],
    ),
    (
        "cs",
        """using System;
global using static System.Math;
namespace N.M {
  [Attr(1)]
  public sealed class Acc@V<T> : Base, IFoo<T>, N.C, IBar where T : class, new() {
    public int X { get; set; } = Make();
    public string Y => Calc();
    public Acc@V(int a) : base(Get(a)) { Init(); }
    ~Acc@V() { Gone(); }
    public static Acc@V operator +(Acc@V a, Acc@V b) { return Add(a, b); }
    public int this[int i] { get { return At(i); } }
    int Square(int a) => Times@V(a, a);
    (int, string) Pair() { return (1, Two()); }
    void IFoo.Explicit() { }
  }
}
""",
        [
            ("Class", "Acc@V", 4, 15), ("Method", "Acc@V.Acc@V", 8, 8), ("Method", "Acc@V.Square", 12, 12), ("Method", "Acc@V.Pair", 13, 13), ("Method", "Acc@V.Explicit", 14, 14),
        ],
        [
            ("", "IMPORTS", "using System;", "using System;"), ("", "IMPORTS", "global using static System.Math;", "global using static System.Math;"), ("Acc@V", "INHERITS", "Base", ""),
            ("Acc@V", "INHERITS", "IBar", ""), ("Acc@V.Acc@V", "CALLS", "Get", ""), ("Acc@V.Acc@V", "CALLS", "Init", ""), ("Acc@V.Square", "CALLS", "Times@V", ""), ("Acc@V.Pair", "CALLS", "Two", ""),
        ],
    ),
    (
        "cs",
        """class Job@V {
  [Obsolete("x")] public async Task<List<int>> RunAsync<U>(int a, [From("q")] string b) where U : struct
  {
    var s = $"x {Fmt(a)} {{no()}}"; var v = @"c:\\dir ""q"" call()"; // call(1)
    await this.a.Foo<int>(b)?.Bar(); Gen<string>(1); base.Go(); nameof(X); typeof(A);
    if (a > 0) { foreach (var q in Items()) lock (q) { } } using (var z = Open()) { }
    int Local(int k) { return Inner(k); }
    x.Where(y => y.Ok@V()).Select(new B(Arg()).C()); throw new Exception(Msg());
  }
}
""",
        [("Class", "Job@V", 1, 10), ("Method", "Job@V.RunAsync", 2, 9)],
        [
            ("Job@V.RunAsync", "CALLS", c, r)
            for c, r in (
                ("Fmt", ""), ("Foo<int>", "this.a"), ("Bar", ""), ("Gen", ""), ("Go", "base"), ("nameof", ""), ("Items", ""), ("Open", ""), ("Inner", ""),
                ("Select", "x.Where(y => y.Ok@V())"), ("Where", "x"), ("Ok@V", "y"), ("C", "new B(Arg())"), ("Arg", ""), ("Msg", ""),
            )
        ],
    ),
    (
        "cs",
        """namespace N;
interface IX@V : IY, IZ<int> { void F(); int P { get; } }
struct S@V : IX@V { public void M() { Run@V(); } }
enum E : byte { A = 1, B = 2 }
record R(int Q) { void Inside() { Seen(); } }
delegate void D(int x);
#if DEBUG call( {
#endif
abstract class Shape { protected abstract double Area(); }
""",
        [
            ("Class", "IX@V", 2, 2), ("Method", "IX@V.F", 2, 2), ("Class", "S@V", 3, 3), ("Method", "S@V.M", 3, 3), ("Class", "E", 4, 4), ("Method", "Inside", 5, 5), ("Class", "Shape", 9, 9),
            ("Method", "Shape.Area", 9, 9),
        ],
        [("IX@V", "INHERITS", "IY", ""), ("S@V", "INHERITS", "IX@V", ""), ("S@V.M", "CALLS", "Run@V", ""), ("Inside", "CALLS", "Seen", "")],
    ),
]

_LANGUAGE = {"js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "javascript", "ts": "typescript", "java": "java", "cs": "csharp"}


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _values(columns: str, rows: list[tuple]) -> str:
    """SQL: the rows by shape, for every file, with the file's number and module put in."""
    lines = ", ".join("(" + ", ".join(_text(x) if isinstance(x, str) else str(x) for x in row) + ")" for row in rows)
    put = "replace(replace({0}, '@V', v), '@M', m) AS {0}"
    numbers = ("lineno", "end_lineno")
    shown = ", ".join(f"CAST({c} AS INT) AS {c}" if c in numbers else put.format(c) for c in columns.split(", "))
    shape = f"p_partkey % {len(SHAPES)}"
    return f"""SELECT {shown} FROM (VALUES {lines}) AS t(shape, {columns})
JOIN (SELECT {shape} AS shape, CAST(p_partkey % 40 AS VARCHAR) AS v, concat('code.m', p_partkey) AS m FROM part) AS f USING (shape)"""


def _symbol_rows() -> list[tuple]:
    out = []
    for shape, (suffix, source, symbols, _) in enumerate(SHAPES):
        out.append((shape, "Module:@M", "Module", "@M", 1, source.count("\n") + 1, _LANGUAGE[suffix]))
        out += [(shape, f"{kind}:@M.{name}", kind, f"@M.{name}", low, high, _LANGUAGE[suffix]) for kind, name, low, high in symbols]
    return out


def _edge_rows() -> list[tuple]:
    out = []
    for shape, (_, _, symbols, edges) in enumerate(SHAPES):
        kinds = {name: kind for kind, name, *_ in symbols} | {"": "Module"}
        own = lambda name: f"{kinds[name]}:@M" + (f".{name}" if name else "")  # noqa: B023, E731
        out += [(shape, own(name.rpartition(".")[0]), "DEFINES", own(name), "", "", "exact") for _, name, *_ in symbols]
        out += [(shape, own(src), kind, "", callee[:60], receiver, "unresolved" if kind == "CALLS" else "exact") for src, kind, callee, receiver in edges]
    return out


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    pick = lambda at: F.element_at(F.array(*[F.lit(s[at]) for s in SHAPES]), (F.col("p_partkey") % len(SHAPES) + 1).cast("int"))
    text = F.replace(pick(1), F.lit("@V"), (F.col("p_partkey") % 40).cast("string"))
    path = F.concat(F.lit("code/m"), F.col("p_partkey").cast("string"), F.lit("."), pick(0))
    return part.select(path.alias("path"), text.cast("binary").alias("content"))


@query("PAR-03_symbols", _values("id, kind, qualified_name, lineno, end_lineno, lang", _symbol_rows()))
def parse_symbols(spark, sf_dir):
    return index.parse_files(_files(spark, sf_dir))[0].select("id", "kind", "qualified_name", "lineno", "end_lineno", "lang")


@query("PAR-03_edges", _values("src, kind, dst, callee_name, receiver, confidence", _edge_rows()))
def parse_edges(spark, sf_dir):
    return index.parse_files(_files(spark, sf_dir))[1].select("src", "kind", "dst", "callee_name", "receiver", "confidence")
