import random

import pytest
from pyspark.sql import functions as F

from quarryflow.operators import context as C
from quarryflow.operators import context, graph, harness, sql_guard, vector
from quarryflow.plans.catalogue import _CASES

EDGES = [("a", "b", "X"), ("b", "c", "X"), ("c", "a", "X"), ("a", "d", "X"), ("a", "d", "X"), ("d", "d", "X"), ("e", "f", "X")]


@pytest.fixture(scope="module")
def g(spark):
    nodes = spark.createDataFrame([(x, "N", x) for x in "abcdefz"], "id string, node_type string, label string")
    return nodes.cache(), spark.createDataFrame(EDGES, "src_id string, dst_id string, edge_type string").cache()


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_reachability(g):
    nodes, edges = g
    kept, left = graph.subgraph(nodes, edges, "a")
    assert ids(kept) == ["a", "b", "c", "d"] and left.count() == 6
    assert ids(graph.subgraph(nodes, edges, "d", reverse=True)[0]) == ["a", "b", "c", "d"]
    assert ids(graph.subgraph(nodes, edges, "unknown")[0]) == [] and ids(graph.subgraph(nodes, edges, "z")[0]) == ["z"]
    assert graph.full_chain(nodes, edges, "a")[1].count() == 5
    assert ids(graph.expand(nodes, edges, "b", 1)[0]) == ["a", "b", "c"] and ids(graph.expand(nodes, edges, "b", -2)[0]) == ["b"]


def test_tiers_take_the_least(g, spark):
    got = {r["id"]: r["tier"] for r in context.candidate_tiers(g[1], spark.createDataFrame([("d", 1), ("f", 4)], "id string, rank int")).collect()}
    assert got == {"d": 2, "f": 2, "a": 4, "b": 4, "c": 4}


def test_packing_is_not_a_running_sum(spark):
    blocks = spark.createDataFrame([("q", i, s) for i, s in enumerate((6, 5, 4, 1))], "q string, i int, s int")
    rows = context.pack(blocks, "q", ["i"], F.col("s"), budget=10).orderBy("i").collect()
    assert [r["kept"] for r in rows] == [True, False, True, False] and rows[-1]["used"] == 10


@pytest.mark.parametrize("chunk", [1, 7, 20_000])
def test_packing_large_groups_equals_the_fold(spark, chunk):
    rnd = random.Random(chunk)
    rows = [(g, rnd.choice((i, i // 3, None)), rnd.choice((0, 1, 2, 5, 30, 61, 500)), 40) for g in ("a", "b", None) for i in range(90)]
    rows += [rows[5], rows[5], ("late", 1, 0, 400), ("late", 1, 1, 400), ("full", 1, 5, 300), ("full", 2, 0, 300)]
    blocks = spark.createDataFrame(rows, "q string, i int, s int, kept_before int").repartition(4)
    got = C.pack_parallel(blocks, "q", ["i"], F.col("s"), budget=300, used=F.col("kept_before"), carry=("kept_before",), chunk=chunk)
    place = lambda r: (r[0] is not None, r[0] or "", r[1] is not None, r[1] or 0, r[3], r[2])
    want, total = [], {}
    for q, i, s, start in sorted(rows, key=place):
        total.setdefault(q, start)
        kept = total[q] + s <= 300
        total[q] += s if kept else 0
        want.append((q, i, start, s, kept, total[q]))
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(want, key=str)
    assert C.pack_parallel(blocks.limit(0), "q", ["i"], F.col("s")).collect() == []


def test_search_examples_and_embedding(spark):
    rows = spark.createDataFrame([("a", "SQL", [1.0, 0.0]), ("b", "SQL", [1.0, 0.0]), ("c", "X", [1.0, 0.1]), ("z", "SQL", [0.0, 0.0])], "node_id string, layer string, embedding array<float>")
    found = vector.search(rows, [2.0, 0.0], 3).collect()
    assert [r["node_id"] for r in found] == ["a", "b", "c"] and found[0]["score"] == 1.0
    assert [r["node_id"] for r in vector.search(rows, [2.0, 0.0], 9, layer="SQL").collect()] == ["a", "b", "z"]
    vectors = vector.embed(spark.createDataFrame([("one two",), (None,)], "text string")).collect()
    assert abs(sum(x * x for x in vectors[0]["embedding"]) - 1) < 1e-5
    one = lambda i, s: spark.createDataFrame([(i, s, "t")], "node_id string, score double, text string")
    hits = one("m", 0.9).union(one("h1", 0.8)).union(one("h2", 0.7))
    assert [r["node_id"] for r in vector.examples(one("x", 0.0), one("m", 0.0), hits, 2).orderBy("tier").collect()] == ["x", "m", "h1"]


def test_summary_and_manual(spark):
    none = spark.createDataFrame([], "node_type string, label string")
    assert context.chain_summary(none).first()["summary"] == "처리 흐름: 관련 코드를 찾지 못했습니다."
    entries = [{"domain": "loan", "url": "/loan/a", "body": "x"}]
    text = context.assemble_manual(entries, ["book", "loan"], "loan")
    assert "## 2. loan" in text and "## 2. book" not in text
    with pytest.raises(ValueError):
        context.assemble_manual(entries, ["loan"], "none")
    assert spark.createDataFrame([(text,)], "c string").select(context.heading_count(F.col("c")).alias("n")).first()["n"] == 1


def test_guard_and_answer(spark):
    spark.createDataFrame([(i, b"x") for i in range(150)], "i int, b binary").createOrReplaceTempView("orders")
    verdict = sql_guard.validate(spark, "SELECT i, b FROM orders", {"ORDERS"})
    assert verdict.ok and verdict.notes and len(sql_guard.run(spark, verdict)) == 100
    for sql, ok, again, _ in _CASES:
        v = sql_guard.validate(spark, sql.format(t="orders", k=3), {"orders"})
        assert (v.ok, v.retryable) == ({"true": True, "false": False}[ok], {"true": True, "false": False, "NULL": None}[again]), (sql, v)
    assert sql_guard.validate(spark, "WITH x AS (SELECT * FROM orders) SELECT * FROM x", {"orders"}, strict=False).ok
    assert sql_guard.extract_sql("so:\n```sql\nSELECT 1\n```") == "SELECT 1" and sql_guard.extract_sql("I say select 2") == "select 2" and sql_guard.extract_sql("no") is None
    said = iter(["nothing", "```SELECT i FROM orders LIMIT 3```"])
    assert len(sql_guard.answer(spark, "q", lambda p: next(said), {"orders"}).rows) == 3
    assert sql_guard.answer(spark, "q", lambda p: "```DELETE FROM orders```", {"orders"}).status == 400
    assert sql_guard.answer(spark, "q", lambda p: "SELECT nope FROM orders", {"orders"}).rows == []


REACHING = (
    "SELECT java_method('java.lang.System','getenv','PATH') FROM t1",
    "SELECT a FROM t1 WHERE reflect('x', 'y') = 1",
    "SELECT `try_reflect` ('x','y') FROM t1",
    "SELECT IDENTIFIER('java_method')('java.lang.System','getProperty','java.version') FROM t1",
    "SELECT IDENTIFIER('a') FROM t1",
    "SELECT b FROM IDENTIFIER('secret')",
    "SELECT * FROM t1 JOIN IDENTIFIER('sec' || 'ret') USING (a)",
    "SELECT TRANSFORM(a) USING 'cat' AS (b) FROM t1",
    "SELECT * FROM (SELECT TRANSFORM(a) USING 'cat' AS (b) FROM t1)",
    "SELECT * FROM range(3)",
    "SELECT * FROM t1, explode(array(1))",
    "SELECT * FROM t1 LATERAL VIEW explode(a) x AS y",
    "SELECT (SELECT max(java_method('a','b')) FROM t1) FROM t1",
    "SELECT a FROM t1 WHERE a IN (SELECT reflect('a','b') FROM t1)",
    "SELECT a FROM t1 WHERE EXISTS (SELECT * FROM IDENTIFIER('secret'))",
    "SELECT a FROM t1 ORDER BY java_method('a','b')",
    "SELECT sum(a) OVER (ORDER BY reflect('a','b')) FROM t1",
    "SELECT transform(array(a), x -> java_method('a', x)) FROM t1",
    "SELECT a FROM t1 GROUP BY a HAVING reflect('a','b') = 1",
    "SELECT input_file_name(), current_user(), version() FROM t1",
    "SELECT system.builtin.java_method('a','b') FROM t1",
    "SELECT * FROM VALUES (java_method('a','b')) AS v(x), t1",
    "SELECT :p FROM t1",
    "SELECT * FROM t1 TABLESAMPLE (10 PERCENT)",
    "SELECT /*+ BROADCAST(t1) */ xpath_string('<a/>', 'a') FROM t1",
    "SELECT * FROM t1 |> WHERE a = 1",
    "SELECT own(a) FROM t1",
)


@pytest.mark.parametrize("sql", REACHING)
def test_the_guard_refuses_what_reaches_out(spark, sql):
    v = sql_guard.validate(spark, sql, {"t1"})
    assert not v.ok and not v.retryable and v.sql is None and "not allowed" in v.reason
    with pytest.raises(sql_guard.Refused):
        sql_guard.run(spark, sql_guard.Verdict(True, sql, tables=frozenset({"T1"})))


def test_a_replaced_function_is_not_the_built_in_one(spark):
    assert sql_guard.validate(spark, "SELECT upper(a) FROM t1", {"t1"}).ok
    spark.udf.register("upper", lambda s: "gone")
    try:
        assert not sql_guard.validate(spark, "SELECT upper(a) FROM t1", {"t1"}).ok
    finally:
        spark._jsparkSession.sessionState().catalog().dropTempFunction("upper", True)
        spark._jsparkSession.sessionState().functionRegistry().dropFunction(spark._jvm.org.apache.spark.sql.catalyst.FunctionIdentifier("upper"))


def test_resolved_names_must_be_known(spark):
    spark.createDataFrame([(1, 2)], "a int, b int").createOrReplaceTempView("t1")
    spark.createDataFrame([(7, 7)], "a int, b int").createOrReplaceTempView("secret")
    # A common table expression that reads a table of its own name is more than the parsed names show.
    hidden = "WITH secret AS (SELECT * FROM secret) SELECT * FROM secret"
    assert not sql_guard.validate(spark, hidden, {"t1"}).ok
    loose = sql_guard.validate(spark, hidden, {"t1"}, strict=False)
    with pytest.raises(sql_guard.Refused, match="secret"):
        sql_guard.run(spark, loose)
    fine = sql_guard.validate(spark, "WITH x AS (SELECT a FROM t1) SELECT count(*) AS n FROM x", {"t1"}, strict=False)
    assert sql_guard.run(spark, fine) == [{"n": 1}]
    assert not sql_guard.validate(spark, "SELECT * FROM other.t1", {"t1"}).ok and not sql_guard.validate(spark, "SELECT * FROM parquet.`/tmp`", {"t1"}).ok


ORDINARY = (
    "SELECT DISTINCT a FROM t1 WHERE b IN (1, 2) AND a NOT IN (SELECT b FROM t1) OR a IS NOT NULL AND NOT EXISTS (SELECT 1 FROM t1 x WHERE x.a = t1.b)",
    "SELECT CASE WHEN a = 1 THEN 'x' ELSE 'y' END AS c, cast(a AS string), DATE '2020-01-01' + INTERVAL 3 DAY, CURDATE(), NOW(), CURRENT_DATE, CURRENT_TIMESTAMP FROM t1",
    "SELECT EXTRACT(YEAR FROM CURRENT_DATE), SUBSTRING('abc' FROM 1 FOR 2), TRIM(BOTH 'x' FROM 'xax'), TIMESTAMPDIFF(DAY, NOW(), NOW()), -a, a DIV 2, a % 2, (SELECT max(b) FROM t1) FROM t1",
    "SELECT a, sum(b) OVER (PARTITION BY a ORDER BY b ROWS BETWEEN 1 PRECEDING AND CURRENT ROW), lag(a) OVER w FROM t1 WINDOW w AS (ORDER BY b)",
    "SELECT x.a, count(DISTINCT y.b) AS n, count(*) FILTER (WHERE y.b > 1) FROM t1 x INNER JOIN t1 y ON x.a <= y.a LEFT OUTER JOIN t1 z USING (b) CROSS JOIN (SELECT 1 AS k) GROUP BY x.a HAVING n > 0 ORDER BY n DESC NULLS LAST, 1 LIMIT 5 OFFSET 0",
    "SELECT a FROM (SELECT a FROM t1 UNION ALL SELECT b FROM t1 EXCEPT SELECT 9) q WHERE a BETWEEN 0 AND 9 AND cast(a AS string) RLIKE '.' AND a <=> 1 AND cast(a AS string) LIKE '%1%'",
    "SELECT date_format(NOW(), 'yyyy-MM'), concat('a', a) || 'b', coalesce(a, b), if(a > 1, a, b), round(avg(b), 2) FROM t1 GROUP BY a, b",
)


@pytest.mark.parametrize("sql", ORDINARY)
def test_ordinary_statements_pass_and_run(spark, sql):
    spark.createDataFrame([(1, 2)], "a int, b int").createOrReplaceTempView("t1")
    v = sql_guard.validate(spark, sql, {"t1"})
    assert v.ok, v.reason
    sql_guard.run(spark, v)


def test_long_chains_and_cycles_end(spark):
    edges = spark.createDataFrame([(f"n{k}", f"n{k + 1}", "X") for k in range(20)] + [("n20", "n5", "X")], "src_id string, dst_id string, edge_type string")
    starts = spark.createDataFrame([("n0",), ("n19",), ("lost",)], "id string")
    got = {(r["start"], r["id"]) for r in graph.closure(edges, starts).collect()}
    assert got == {("n0", f"n{k}") for k in range(21)} | {("n19", f"n{k}") for k in range(5, 21)} | {("lost", "lost")}


def brute_closure(edges, starts):
    follow, out = {}, set()
    for a, b in edges:
        follow.setdefault(a, set()).add(b)
    for s in starts:
        seen, todo = {s}, [s]
        while todo:
            for x in follow.get(todo.pop(), ()):
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        out |= {(s, x) for x in seen}
    return out


@pytest.mark.parametrize(("growth", "size", "arrows", "plain"), [(0, 40, 45, 1), (1, 60, 200, 2), (8, 30, 30, 4)])
def test_any_graph_is_walked_to_its_end(spark, monkeypatch, growth, size, arrows, plain):
    """Paths, cycles of several lengths, ladders (where paths multiply), hubs, loops, repeats and nulls."""
    rnd = random.Random(growth)
    monkeypatch.setattr(graph, "PLAIN", plain)
    edges = [(f"p{k}", f"p{k + 1}") for k in range(size)] + [(f"p{size}", "p7"), ("p3", "p3"), ("p1", "p2"), (None, "p1"), ("p2", None)]
    edges += [(f"l{k}{a}", f"l{k + 1}{b}") for k in range(12) for a in "xyz" for b in "xyz"] + [("hub", f"p{k}") for k in range(0, size, 3)]
    edges += [(f"r{rnd.randrange(size)}", f"r{rnd.randrange(size)}") for _ in range(arrows)]
    starts = ["p0", "p20", "l0x", "hub", "r1", "r2", "lost"]
    df = spark.createDataFrame([(*e, "X") for e in edges], "src_id string, dst_id string, edge_type string")
    ids = spark.createDataFrame([(x,) for x in [*starts, "p0"]], "id string")
    for reverse in (False, True):
        ways = [(b, a) if reverse else (a, b) for a, b in edges]
        want = {p for p in brute_closure([w for w in ways if w[0] is not None], starts) if p[1] is not None}
        rows = [(r["start"], r["id"]) for r in graph.closure(df, ids, reverse, growth).collect()]
        assert {r for r in rows if r[1] is not None} == want and len(rows) == len(set(rows))


def test_a_chain_of_ten_thousand_takes_few_rounds(spark, monkeypatch):
    rounds, write = [], graph.Scratch.write
    monkeypatch.setattr(graph.Scratch, "write", lambda self, df, name: (rounds.append(name), write(self, df, name))[1])
    edges = spark.range(10_000).select(F.col("id").cast("string").alias("src_id"), (F.col("id") + 1).cast("string").alias("dst_id"))
    got = graph.closure(edges, spark.createDataFrame([("0",), ("9000",)], "id string"))
    assert {r["start"]: r["count"] for r in got.groupBy("start").count().collect()} == {"0": 10_001, "9000": 1_001}
    assert sum(r.startswith("level") for r in rounds) <= 20


def test_grades_of_runs(spark):
    rows = spark.createDataFrame([("a", 1, True)] * 5 + [("b", 1, True)] * 4 + [("b", 2, False)] + [("c", 1, False)], "g string, n int, ok boolean")
    assert {r["g"]: r["verdict"] for r in harness.verdicts(rows, "g", F.col("ok")).collect()} == {"a": harness.CONFIRMED, "b": harness.RESERVE, "c": harness.EXCLUDED}
    text = spark.createDataFrame([("a b", 1), ("a", 2), (None, 3)], "t string, i int").select("i", harness.holds_words(F.col("t"), ["a"], [["b", "c"], []]).alias("k"))
    assert {r["i"]: r["k"] for r in text.collect()} == {1: True, 2: False, 3: False}


def test_only_nodes_that_lead_on_are_doubled(spark, monkeypatch):
    path = [(f"n{i}", f"n{i + 1}") for i in range(40)] + [(f"n{i}", f"leaf{i % 3}") for i in range(40)] + [("leaf0", "leaf0")]
    edges, seen = spark.createDataFrame(path, "src_id string, dst_id string"), []
    whole = graph._doubled
    monkeypatch.setattr(graph, "_doubled", lambda jump, *rest: seen.append(jump.count()) or whole(jump, *rest))
    got = {tuple(r) for r in graph.closure(edges, spark.createDataFrame([("n0",), ("n30",), ("leaf1",)], "id string")).collect()}
    reached = lambda a: {(f"n{a}", f"n{i}") for i in range(a, 41)} | {(f"n{a}", f"leaf{i % 3}") for i in range(a, 40)}
    assert got == reached(0) | reached(30) | {("leaf1", "leaf1")}
    assert seen and max(seen) == 39


def test_large_groups_are_numbered_by_ranges(spark, monkeypatch):
    monkeypatch.setattr(C, "RANGE", 50)
    plans, nearest = [], C._nearest
    monkeypatch.setattr(C, "_nearest", lambda *given: plans.append(nearest(*given)) or plans[-1])
    sizes = [(i * 7) % 61 for i in range(400)]
    got = C.pack_parallel(spark.createDataFrame(list(enumerate(sizes)), "i int, s int").withColumn("q", F.lit("all")), "q", ["i"], F.col("s"), budget=2000, chunk=30).orderBy("i").collect()
    total, want = 0, []
    for s in sizes:
        want.append(total + s <= 2000)
        total += s if want[-1] else 0
    assert [r["kept"] for r in got] == want and got[-1]["used"] == total and len(plans) > 1
    assert plans[0]._jdf.queryExecution().optimizedPlan().toString().count("row_number() windowspecdefinition(__key#") == 1
    assert "__part" in plans[0]._jdf.queryExecution().optimizedPlan().toString().split("row_number() windowspecdefinition(")[1].split(" ASC")[0]
