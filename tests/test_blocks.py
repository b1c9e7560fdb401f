"""Methods and members of types, cut out of source texts."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from codestrata.operators import blocks

JAVA = '''package p;
/* class Gone { */
@Deprecated
public abstract class Outer<T extends Comparable<T>> extends Base<T> implements A, B<T> {
    private static final int X = 1, Y = f(2, 3);
    Map<String, List<Integer>> m = new HashMap<>();
    int[] arr = {1, 2}, brr[];
    static { X = 2; }
    Runnable r = () -> { int z = 1; };
    public Outer(int a, @Ann(x = 1) Map<K, V> b) { super(a); }
    Outer() {}

    @Override
    public <R> List<R> go(final int n,
            String... s) throws IOException, E {
        for (int i = 0; i < n; i++) {
            if (a && b || c) { x(); } // "} "
        }
        List<?> q = null; int w = a ? 1 : 2;

        new Thread(new Runnable() { public void run() { int l; try { } catch (E e) { } } });
        return "}}{;";
    }
    abstract void sig(int k);
    int one() { return 1; } int two() { return '{'; }
    class In { int f; void g() {} enum E { A, B(1) { void h() {} }; int v; E() {} void m2() {} } }
    interface Q extends A, B { int C = 1; void a(); default void d() { while (x) ; } }
}
class Open { void last() { if (x) {
'''
SCHEMA = "repository string, file string, text string"


@pytest.fixture(scope="module")
def sources(spark):
    return spark.createDataFrame([
        ("r", "A.java", JAVA), ("r", "none.java", None), ("r", "empty.java", ""),
        ("r", "prose.java", "no code at all; (not even) a brace"),
        ("r", "odd.java", "} } void x(int a) { } { int b; }"),
    ], SCHEMA)


def test_methods(sources):
    found = {
        (r.file, r.method, r.parameters): (r.nloc, r.ccn, r.tokens, r.length)
        for r in blocks.method_metrics(sources).collect()
    }
    assert found == {
        ("A.java", "Outer::Outer", 2): (1, 1, 27, 1),
        ("A.java", "Outer::Outer", 0): (1, 1, 5, 1),
        ("A.java", "Outer::go", 2): (9, 7, 99, 10),
        ("A.java", "run", 0): (1, 2, 18, 1),
        ("A.java", "Outer::one", 0): (1, 1, 8, 1),
        ("A.java", "Outer::two", 0): (1, 1, 8, 1),
        ("A.java", "In::g", 0): (1, 1, 5, 1),
        ("A.java", "h", 0): (1, 1, 5, 1),
        ("A.java", "E::E", 0): (1, 1, 5, 1),
        ("A.java", "E::m2", 0): (1, 1, 5, 1),
        ("A.java", "Q::d", 0): (1, 2, 10, 1),
        ("A.java", "Open::last", 0): (1, 2, 9, 2),
        ("odd.java", "x", 1): (1, 1, 7, 1),
    }


def test_members_belong_to_the_innermost_type(sources):
    found = {r.type_name: r for r in blocks.type_structure(sources).collect()}
    assert {name: (r.kind, r.methods, r.attributes) for name, r in found.items()} == {
        "Outer": ("class", 4, 6), "In": ("class", 1, 1), "E": ("enum", 1, 1),
        "Q": ("interface", 2, 1), "Open": ("class", 1, 0),
    }
    assert (found["Outer"].is_abstract, found["Outer"].extends) == (True, "Base")
    assert found["Outer"].implements == "A;B" and found["Q"].extends == "A;B"


@pytest.mark.parametrize("statement, attributes", [
    ("int a;", 1), ("int a, b[], c;", 3), ("final Map<K, List<V>> a = f(b, c), d;", 2),
    ("int[] a = {1, 2}, b = {3}, c;", 3), ("@Size(min = 1, max = 2) String s;", 1),
    ("Object o = new Object() { int inner; };", 1), ("Runnable r = () -> { int x; };", 1),
    (";", 0), ("static { int x = 1; }", 0), ("{ int x = 1; }", 0), ("a.b.C<D, E>[] f;", 1),
    ("native void f(int a, int b);", 0), ("int f = g(h(1, i(2, 3)), 4);", 1),
])
def test_attributes(spark, statement, attributes):
    frame = spark.createDataFrame([("r", "f", f"class C {{ {statement} }}")], SCHEMA)
    (row,) = blocks.type_structure(frame).collect()
    assert row.attributes == attributes


def test_line_ends_and_comments_do_not_change_sizes(spark):
    text = "class C {{ int f(int a) {{{0}  // if ({0}{0} /* a ? b{0} */ return a;{0} }} }}"
    rows = spark.createDataFrame(
        [("r", str(i), text.format(end)) for i, end in enumerate(["\n", "\r\n", "\r"])], SCHEMA)
    found = {(r.nloc, r.ccn, r.tokens, r.length) for r in blocks.method_metrics(rows).collect()}
    assert found == {(3, 1, 10, 6)}


def test_one_shuffle_and_no_python(spark, sources):
    plan = blocks.method_metrics(sources)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Python" not in plan


def test_a_long_file_and_an_empty_table(spark, sources):
    body = "void m(int a) { if (a) { b(); } }\n"
    long = spark.range(1).select(
        F.lit("r").alias("repository"), F.lit("L.java").alias("file"),
        F.concat(F.lit("class L {\n"), F.repeat(F.lit(body), 20000), F.lit("}")).alias("text"))
    (row,) = blocks.method_metrics(long).groupBy("method", "nloc", "ccn").count().collect()
    assert tuple(row) == ("L::m", 1, 2, 20000)
    assert blocks.type_structure(long).first().methods == 20000
    assert blocks.method_metrics(sources.limit(0)).collect() == []
    assert blocks.type_structure(sources.limit(0)).collect() == []


def test_texts_read_by_one_task_are_cut_by_many(spark):
    one = spark.range(0, 400, 1, 1).select(
        F.lit("r").alias("repository"), F.concat("id", F.lit(".java")).alias("file"),
        F.concat(F.lit("class A { void f"), "id", F.lit("() { x(); } }")).alias("text"))
    assert one.rdd.getNumPartitions() == 1
    cut = blocks.pieces(one).groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert len(cut) > 8 and max(row["count"] for row in cut) < 400
    # A file stays in one task.
    tasks = blocks.pieces(one).select("file", F.spark_partition_id().alias("task")).distinct()
    assert tasks.count() == 400
    assert blocks.method_metrics(one).count() == 400
