"""Queries over the driver's tables, each in the shape of an operator, and the SQL that each must agree with.

Roles: nation and region are the two-level hierarchy, part the lent item, customer the member, orders the loan, lineitem
the overdue row, events the audit log, pages the URLs, documents and embeddings the chunks."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryflow.functions import scalar as S
from quarryflow.operators import context as C
from quarryflow.operators import ddl, graph, harness, sql_guard, stacktrace, vector, vector_index
from quarryflow.operators.relational import where_given
from quarryflow.sources.files import table
from quarryflow.sources.scratch import Scratch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
AS_OF = "1997-06-15"


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def _money(c: str):
    return F.round(c, 2)


# Lists, lookups, counts


@query("SELECT c_custkey, c_name, c_acctbal, c_mktsegment, n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey WHERE lower(c_name) LIKE '%customer#%1%' AND c_mktsegment = 'BUILDING' ORDER BY c_acctbal DESC, c_custkey LIMIT 10 OFFSET 10")
def list_page_left_join(spark, d):
    rows = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    rows = where_given(rows, ("customer#%1", S.contains_ci("c_name", "customer#%1")), ("BUILDING", F.col("c_mktsegment") == "BUILDING"), ("", F.col("n_name") == ""), (None, F.col("n_name") == "x"))
    return rows.select("c_custkey", "c_name", "c_acctbal", "c_mktsegment", "n_name").orderBy(F.desc("c_acctbal"), "c_custkey").offset(10).limit(10)


@query("SELECT count(*) AS cnt FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 0")
def list_count_no_join(spark, d):
    return table(spark, d, "customer").where((F.col("c_mktsegment") == "BUILDING") & (F.col("c_acctbal") > 0)).agg(F.count(F.lit(1)).alias("cnt"))


@query("SELECT o_orderkey, o_orderstatus, o_totalprice, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderkey = 7")
def detail_lookup(spark, d):
    rows = table(spark, d, "orders").where("o_orderkey = 7").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.select("o_orderkey", "o_orderstatus", "o_totalprice", "c_name", "n_name")


@query("SELECT 'R' || r_regionkey AS code, r_name AS name, NULL AS upper_code FROM region UNION ALL SELECT 'N' || n_nationkey, n_name, 'R' || n_regionkey FROM nation")
def category_list(spark, d):
    top = table(spark, d, "region").select(F.concat(F.lit("R"), "r_regionkey").alias("code"), F.col("r_name").alias("name"), F.lit(None).cast("string").alias("upper_code"))
    low = table(spark, d, "nation").select(F.concat(F.lit("N"), "n_nationkey").alias("code"), F.col("n_name").alias("name"), F.concat(F.lit("R"), "n_regionkey").alias("upper_code"))
    return top.unionByName(low).orderBy("code")


def _loans(spark, d):
    return table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))


@query("SELECT o_orderkey, o_orderdate, o_totalprice, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderstatus = 'O' ORDER BY o_orderdate DESC, o_orderkey LIMIT 20")
def loan_list_3way(spark, d):
    return _loans(spark, d).where("o_orderstatus = 'O'").select("o_orderkey", "o_orderdate", "o_totalprice", "c_name", "n_name").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(20)


_FOUR = "FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"


def _overdues(spark, d):
    return table(spark, d, "lineitem").join(_loans(spark, d), F.col("l_orderkey") == F.col("o_orderkey"))


@query(f"SELECT l_orderkey, l_linenumber, l_shipdate, l_quantity, o_orderdate, c_name, n_name {_FOUR} WHERE l_returnflag = 'R' ORDER BY l_shipdate DESC, l_orderkey, l_linenumber, l_quantity, o_orderdate, c_name, n_name LIMIT 20 OFFSET 5")
def overdue_list_4way(spark, d):
    columns = ["l_orderkey", "l_linenumber", "l_shipdate", "l_quantity", "o_orderdate", "c_name", "n_name"]
    return _overdues(spark, d).where("l_returnflag = 'R'").select(*columns).orderBy(F.desc("l_shipdate"), "l_orderkey", "l_linenumber", "l_quantity", "o_orderdate", "c_name", "n_name").offset(5).limit(20)


@query("SELECT count(*) AS cnt FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE l_returnflag = 'R' AND c_mktsegment = 'BUILDING'")
def overdue_count_3way(spark, d):
    rows = table(spark, d, "lineitem").where("l_returnflag = 'R'").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, d, "customer").where("c_mktsegment = 'BUILDING'"), F.col("o_custkey") == F.col("c_custkey"))
    return rows.agg(F.count(F.lit(1)).alias("cnt"))


@query("SELECT o_custkey, o_orderstatus, count(*) AS cnt FROM orders GROUP BY 1, 2")
def member_active_count(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey", "o_orderstatus").agg(F.count(F.lit(1)).alias("cnt"))


@query(f"SELECT o_orderkey, o_custkey, o_orderdate FROM orders WHERE o_orderdate < TIMESTAMP '{AS_OF}' AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def unreturned_anti_join(spark, d):
    late = table(spark, d, "orders").where(F.col("o_orderdate") < F.lit(AS_OF).cast("timestamp_ntz"))
    return late.join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey", "o_custkey", "o_orderdate")


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'P'")
def active_filter(spark, d):
    return table(spark, d, "orders").where("o_orderstatus = 'P'").select("o_orderkey", "o_custkey", "o_totalprice")


@query("SELECT o_orderstatus, l_orderkey IS NULL AS not_returned, count(*) AS cnt FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2")
def status_null_matrix(spark, d):
    rows = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return rows.groupBy("o_orderstatus", F.col("l_orderkey").isNull().alias("not_returned")).agg(F.count(F.lit(1)).alias("cnt"))


@query("SELECT l_orderkey, l_linenumber, count(*) AS cnt FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_having(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("cnt")).where("cnt > 1")


@query("SELECT p_partkey, p_name, count(*) AS cnt FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2 ORDER BY cnt DESC, p_partkey LIMIT 10")
def top10_items(spark, d):
    counted = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("cnt"))
    return counted.join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).select("p_partkey", "p_name", "cnt").orderBy(F.desc("cnt"), "p_partkey").limit(10)


@query(f"SELECT o_orderkey, c_name, date_diff('day', CAST(o_orderdate AS DATE), DATE '{AS_OF}') AS days FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderdate >= DATE '1997-05-01' AND o_orderdate < DATE '1997-06-01'")
def month_window_report(spark, d):
    rows = table(spark, d, "orders").where("o_orderdate >= timestamp_ntz '1997-05-01' AND o_orderdate < timestamp_ntz '1997-06-01'").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return rows.select("o_orderkey", "c_name", F.datediff(F.lit(AS_OF).cast("date"), F.col("o_orderdate").cast("date")).cast("long").alias("days"))


@query("SELECT count(DISTINCT event_type) AS types, count(DISTINCT user_id) AS users, count(*) FILTER (WHERE event_type = 'click') AS clicks FROM events")
def distinct_and_count_distinct(spark, d):
    return table(spark, d, "events").agg(F.countDistinct("event_type").alias("types"), F.countDistinct("user_id").alias("users"), F.count_if(F.col("event_type") == "click").alias("clicks"))


@query("SELECT count(*) AS cnt FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey WHERE l_orderkey IS NULL")
def active_loan_count(spark, d):
    return table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").agg(F.count(F.lit(1)).alias("cnt"))


@query("SELECT DISTINCT event_type FROM events")
def distinct_values(spark, d):
    return table(spark, d, "events").select("event_type").distinct()


# Dates, pages, transitions


@query(f"SELECT o_orderkey, CAST(o_orderdate AS DATE) + 14 AS due, CAST(o_orderdate AS DATE) + 21 AS extended, greatest(date_diff('day', CAST(o_orderdate AS DATE) + 14, DATE '{AS_OF}'), 0) AS days FROM orders")
def due_date_calc(spark, d):
    day = F.col("o_orderdate").cast("date")
    return table(spark, d, "orders").select("o_orderkey", S.due_date(day).alias("due"), S.extended_due_date(S.due_date(day)).alias("extended"), S.overdue_days(S.due_date(day), F.lit(AS_OF).cast("date")).cast("long").alias("days"))


@query("SELECT o_custkey, count(*) AS total, CAST(ceil(count(*) / 3.0) AS INTEGER) AS total_pages, 11 AS first_page, least(20, CAST(ceil(count(*) / 3.0) AS INTEGER)) AS last_page, 33 AS first_index FROM orders GROUP BY 1")
def pagination_math(spark, d):
    p = S.pagination("total", page_index=12, page_size=3)
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("total")).select("o_custkey", "total", *(p[c].alias(c) for c in ("total_pages", "first_page", "last_page", "first_index")))


@query("""SELECT k AS member_id, code IS NULL AS ok, code FROM (SELECT k, CASE WHEN c_custkey IS NULL THEN 'MEMBER_NOT_FOUND' WHEN c_acctbal < 0 THEN 'OVERDUE_MEMBER' WHEN coalesce(n, 0) >= 5 THEN 'LOAN_LIMIT_EXCEEDED' END AS code
FROM (SELECT c_custkey AS k FROM customer UNION ALL SELECT -1) q LEFT JOIN customer ON k = c_custkey LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) ON k = o_custkey)""")
def loanable_check(spark, d):
    from quarryflow.operators.lifecycle import loanable

    customers = table(spark, d, "customer")
    members = customers.select(F.col("c_custkey").alias("member_id"), F.when(F.col("c_acctbal") < 0, "2").otherwise("1").alias("member_status"))
    loans = table(spark, d, "orders").select(F.col("o_custkey").alias("member_id"), F.when(F.col("o_orderstatus") == "O", "1").otherwise("2").alias("loan_status"))
    asked = members.select("member_id").union(spark.createDataFrame([(-1,)], "member_id long"))
    return loanable({"member": members, "loan": loans}, asked)


@query(f"""SELECT o_orderkey AS loan_id, CAST(o_orderdate AS DATE) + 15 AS start_date, date_diff('day', CAST(o_orderdate AS DATE) + 15, DATE '{AS_OF}') + 1 AS days, 'new' AS kind FROM orders
WHERE CAST(o_orderdate AS DATE) + 14 < DATE '{AS_OF}' AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)
UNION ALL SELECT l_orderkey, CAST(l_shipdate AS DATE), greatest(date_diff('day', CAST(l_shipdate AS DATE), DATE '{AS_OF}'), 0) + 1, 'active' FROM lineitem WHERE l_returnflag = 'R'""")
def refresh_overdue_batch(spark, d):
    day, due = F.lit(AS_OF).cast("date"), S.due_date(F.col("o_orderdate").cast("date"))
    late = table(spark, d, "orders").where(due < day).join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti")
    new = late.select(F.col("o_orderkey").alias("loan_id"), F.date_add(due, 1).alias("start_date"), F.lit("new").alias("kind"))
    active = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("loan_id"), F.col("l_shipdate").cast("date").alias("start_date"), F.lit("active").alias("kind"))
    return new.unionByName(active).select("loan_id", "start_date", (S.overdue_days("start_date", day) + 1).cast("long").alias("days"), "kind")


@query("SELECT c_custkey, CASE WHEN c_custkey = 5 THEN 'x' ELSE c_name END AS c_name, c_nationkey, CASE WHEN c_custkey = 5 THEN 1.5 ELSE c_acctbal END AS c_acctbal, c_mktsegment FROM customer")
def apply_update(spark, d):
    from quarryflow.operators.relational import updated

    return updated(table(spark, d, "customer"), "c_custkey", 5, {"c_name": "x", "c_acctbal": 1.5})


@query("SELECT * FROM customer WHERE c_custkey NOT IN (1, 5)")
def apply_delete(spark, d):
    from quarryflow.operators.relational import deleted

    return deleted(table(spark, d, "customer"), "c_custkey", 1, 5)


@query("SELECT * FROM customer UNION ALL SELECT -7, 'new', NULL, 2.5, NULL")
def apply_insert(spark, d):
    from quarryflow.operators.relational import inserted

    return inserted(table(spark, d, "customer"), spark.createDataFrame([(-7, "new", 2.5)], "c_custkey long, c_name string, c_acctbal double"))


@query("SELECT c_custkey, c_name, c_nationkey, coalesce(b, c_acctbal) AS c_acctbal, c_mktsegment FROM customer LEFT JOIN (SELECT o_custkey, round(max(o_totalprice), 2) AS b FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) ON c_custkey = o_custkey")
def apply_merge(spark, d):
    from quarryflow.operators.relational import merged

    changes = table(spark, d, "orders").where("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(_money(F.max("o_totalprice")).alias("c_acctbal"))
    return merged(table(spark, d, "customer"), "c_custkey", changes)


@query("SELECT event_type, count(*) AS cnt, min(ts) AS first_ts, max(ts) AS last_ts FROM events GROUP BY 1")
def audit_counts(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("cnt"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


# Graph: region -> nation -> customer -> orders


def _graph(spark, d):
    region, nation, customer, orders = (table(spark, d, t) for t in ("region", "nation", "customer", "orders"))
    node = lambda df, kind, key, label: df.select(F.concat(F.lit(f"{kind}::"), key).alias("id"), F.lit(kind).alias("node_type"), F.col(label).cast("string").alias("label"))
    nodes = [node(region, "REGION", "r_regionkey", "r_name"), node(nation, "NATION", "n_nationkey", "n_name"), node(customer, "CUSTOMER", "c_custkey", "c_name"), node(orders, "ORDER", "o_orderkey", "o_orderkey")]
    edge = lambda df, a, ak, b, bk, kind: df.select(F.concat(F.lit(f"{a}::"), ak).alias("src_id"), F.concat(F.lit(f"{b}::"), bk).alias("dst_id"), F.lit(kind).alias("edge_type"))
    edges = [edge(nation, "REGION", "n_regionkey", "NATION", "n_nationkey", "HAS"), edge(customer, "NATION", "c_nationkey", "CUSTOMER", "c_custkey", "HAS"), edge(orders, "CUSTOMER", "o_custkey", "ORDER", "o_orderkey", "PLACED")]
    return reduce(DataFrame.unionByName, nodes), reduce(DataFrame.unionByName, edges)


_NODES = "nodes AS (SELECT 'REGION::' || r_regionkey AS id, 'REGION' AS node_type, r_name AS label FROM region UNION ALL SELECT 'NATION::' || n_nationkey, 'NATION', n_name FROM nation UNION ALL SELECT 'CUSTOMER::' || c_custkey, 'CUSTOMER', c_name FROM customer UNION ALL SELECT 'ORDER::' || o_orderkey, 'ORDER', CAST(o_orderkey AS VARCHAR) FROM orders)"
_EDGES = "edges AS (SELECT 'REGION::' || n_regionkey AS src_id, 'NATION::' || n_nationkey AS dst_id, 'HAS' AS edge_type FROM nation UNION ALL SELECT 'NATION::' || c_nationkey, 'CUSTOMER::' || c_custkey, 'HAS' FROM customer UNION ALL SELECT 'CUSTOMER::' || o_custkey, 'ORDER::' || o_orderkey, 'PLACED' FROM orders)"
_DOWN = "down AS (SELECT '{0}' AS id UNION SELECT dst_id FROM edges JOIN down ON src_id = id)"
_UP = "up AS (SELECT '{0}' AS id UNION SELECT src_id FROM edges JOIN up ON dst_id = id)"


@query(f"WITH RECURSIVE {_NODES}, {_EDGES}, {_DOWN.format('REGION::1')} SELECT nodes.* FROM nodes SEMI JOIN down USING (id)")
def graph_downstream(spark, d):
    return graph.subgraph(*_graph(spark, d), "REGION::1")[0]


def _neighbours(spark, d, exact):
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
    index = vector_index.VectorIndex.build(rows, f"{Scratch(spark, 'vectors').root}/index")
    queries = rows.where("id % 100 = 0").select(F.col("id").alias("query"), "vector")
    found = index.search(queries, 10, exact=exact)
    return found.select(F.col("query").alias("query_id"), F.col("id").alias("vec_id"), F.round("score", 6).alias("score"), "rank")


@query("""WITH s AS (SELECT q.vec_id AS query_id, e.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 12) AS score FROM embeddings q, embeddings e WHERE q.vec_id % 100 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s WHERE isfinite(score)) SELECT query_id, vec_id, round(score, 6) AS score, rank FROM r WHERE rank <= 10""")
def vector_index_exact(spark, d):
    return _neighbours(spark, d, True)


def vector_index_search(spark, d):
    """The same by probing cells; tests hold it against the exact result."""
    return _neighbours(spark, d, False)


QUERIES["vector_index_search"] = vector_index_search


#: Runs of 5,000 orders, each order followed by the next and leading to its customer.
_RUNS = "SELECT o_orderkey AS k, o_custkey AS c, o_orderkey // 5000 AS run FROM orders"


@query(f"""WITH o AS ({_RUNS}), s AS (SELECT * FROM o WHERE k % 5000 IN (0, 4321)), own AS (SELECT s.k AS start, o.k, o.c FROM s JOIN o USING (run) WHERE o.k >= s.k)
SELECT 'ORDER::' || start AS start, 'ORDER::' || k AS id FROM own UNION SELECT 'ORDER::' || start, 'CUSTOMER::' || c FROM own""")
def graph_deep_runs(spark, d):
    """What is reached over up to 5,000 steps, from several orders at once."""
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"))
    named = lambda kind, c: F.concat(F.lit(f"{kind}::"), c)
    following = orders.select("k").join(orders.select((F.col("k") - 1).alias("k"), F.col("k").alias("next")), "k").where(F.col("next") % 5000 != 0)
    edges = following.select(named("ORDER", "k").alias("src_id"), named("ORDER", "next").alias("dst_id"))
    edges = edges.unionByName(orders.select(named("ORDER", "k").alias("src_id"), named("CUSTOMER", "c").alias("dst_id")))
    starts = orders.where((F.col("k") % 5000).isin(0, 4321)).select(named("ORDER", "k").alias("id"))
    return graph.closure(edges, starts)


@query(f"WITH RECURSIVE {_NODES}, {_EDGES}, {_DOWN.format('NATION::3')} SELECT edges.* FROM edges WHERE src_id IN (SELECT id FROM down)")
def graph_downstream_edges(spark, d):
    return graph.subgraph(*_graph(spark, d), "NATION::3")[1].select("src_id", "dst_id", "edge_type")


@query(f"WITH RECURSIVE {_NODES}, {_EDGES}, {_UP.format('ORDER::5')} SELECT nodes.* FROM nodes SEMI JOIN up USING (id)")
def graph_upstream(spark, d):
    return graph.subgraph(*_graph(spark, d), "ORDER::5", reverse=True)[0]


@query(f"WITH RECURSIVE {_NODES}, {_EDGES}, {_DOWN.format('CUSTOMER::4')}, {_UP.format('CUSTOMER::4')} SELECT nodes.* FROM nodes WHERE id IN (SELECT id FROM down UNION SELECT id FROM up)")
def graph_chain_full(spark, d):
    return graph.full_chain(*_graph(spark, d), "CUSTOMER::4")[0]


@query(f"""WITH {_NODES}, {_EDGES}, both_ways AS (SELECT src_id AS a, dst_id AS b FROM edges UNION SELECT dst_id, src_id FROM edges), k1 AS (SELECT 'CUSTOMER::4' AS id UNION SELECT b FROM both_ways WHERE a = 'CUSTOMER::4'),
k2 AS (SELECT id FROM k1 UNION SELECT b FROM both_ways JOIN k1 ON a = id) SELECT nodes.* FROM nodes SEMI JOIN k2 USING (id)""")
def graph_expand_k(spark, d):
    return graph.expand(*_graph(spark, d), "CUSTOMER::4", 2)[0]


@query(f"WITH {_NODES}, {_EDGES} SELECT nodes.* FROM nodes JOIN edges ON id = src_id WHERE edge_type = 'HAS' AND dst_id = 'NATION::6'")
def graph_sqls_by_table(spark, d):
    nodes, edges = _graph(spark, d)
    return nodes.join(edges.where((F.col("edge_type") == "HAS") & (F.col("dst_id") == "NATION::6")).select(F.col("src_id").alias("id")), "id")


@query(f"WITH {_NODES}, {_EDGES} SELECT 'nodes:' || node_type AS metric, CAST(count(*) AS DOUBLE) AS value FROM nodes GROUP BY 1 UNION ALL SELECT 'edges:' || edge_type, CAST(count(*) AS DOUBLE) FROM edges GROUP BY 1 UNION ALL SELECT 'unresolved_ratio', 0.0")
def graph_stats(spark, d):
    nodes, edges = _graph(spark, d)
    return graph.graph_stats(nodes, edges, spark.createDataFrame([], "outcome string"))


@query(f"""WITH RECURSIVE {_EDGES}, walk AS (SELECT 'REGION::' || r_regionkey AS start, 'REGION::' || r_regionkey AS id FROM region UNION SELECT start, dst_id FROM edges JOIN walk ON src_id = id WHERE dst_id LIKE 'NATION%')
SELECT 'REGION::' || r_regionkey AS id, list_sort(list(n_name)) AS tables FROM region JOIN walk ON start = 'REGION::' || r_regionkey JOIN nation ON walk.id = 'NATION::' || n_nationkey GROUP BY 1""")
def downstream_tables(spark, d):
    nodes, edges = _graph(spark, d)
    upper = edges.where("edge_type = 'HAS' AND dst_id LIKE 'NATION%'")
    labelled = nodes.where("node_type IN ('REGION', 'NATION')").withColumn("node_type", F.when(F.col("node_type") == "NATION", "TABLE").otherwise(F.col("node_type")))
    return graph.downstream_tables(labelled, upper, nodes.where("node_type = 'REGION'").select("id"))


@query("SELECT split_part(trim(regexp_replace(url, '^https?:/', ''), '/'), '/', 1) AS domain, count(*) AS cnt, min(url) AS first_url FROM pages GROUP BY 1")
def urls_by_domain(spark, d):
    path = F.regexp_replace("url", "^https?:/", "")
    return table(spark, d, "pages").groupBy(S.first_url_segment(path).alias("domain")).agg(F.count(F.lit(1)).alias("cnt"), F.min("url").alias("first_url"))


# Vectors and context

_PROBE = "(SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)"


def _probe(spark, d):
    return list(table(spark, d, "embeddings").where("vec_id = 0").first()["embedding"])


def _topk(spark, d, rows):
    found = vector.search(rows, _probe(spark, d), 10, id_col="vec_id")
    return found.select("vec_id", "label", F.round("score", 6).alias("score"))


@query(f"SELECT vec_id, label, round(list_cosine_similarity(embedding::DOUBLE[], {_PROBE}), 6) AS score FROM embeddings ORDER BY list_cosine_similarity(embedding::DOUBLE[], {_PROBE}) DESC, vec_id LIMIT 10")
def cosine_topk(spark, d):
    return _topk(spark, d, table(spark, d, "embeddings"))


@query(f"SELECT vec_id, label, round(list_cosine_similarity(embedding::DOUBLE[], {_PROBE}), 6) AS score FROM embeddings WHERE label = 3 ORDER BY list_cosine_similarity(embedding::DOUBLE[], {_PROBE}) DESC, vec_id LIMIT 10")
def cosine_topk_filtered(spark, d):
    return _topk(spark, d, table(spark, d, "embeddings").where("label = 3"))


@query("SELECT doc_id, concat_ws(chr(10), 'source: ' || source || ' | lang: ' || lang, 'quality: ' || quality, '---', text) AS chunk FROM documents LEFT JOIN labels USING (doc_id)")
def chunk_text(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return rows.select("doc_id", F.concat_ws("\n", F.concat(F.lit("source: "), "source", F.lit(" | lang: "), "lang"), F.concat(F.lit("quality: "), F.col("quality").cast("string")), F.lit("---"), "text").alias("chunk"))


@query(f"""WITH RECURSIVE {_EDGES}, {_DOWN.format('NATION::3')}, {_UP.format('NATION::3')}
SELECT id, min(tier) AS tier FROM (SELECT 'NATION::3' AS id, 2 AS tier UNION ALL SELECT id, 3 FROM down UNION ALL SELECT id, 4 FROM up) GROUP BY 1""")
def context_tiers(spark, d):
    return C.candidate_tiers(_graph(spark, d)[1], spark.createDataFrame([("NATION::3", 1)], "id string, rank int"))


@query("""WITH RECURSIVE items AS (SELECT p_brand, p_partkey, p_size, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) AS n FROM part),
fold AS (SELECT p_brand, 0::BIGINT AS n, 0::BIGINT AS used, NULL::BIGINT AS p_partkey, false AS kept FROM part GROUP BY 1
UNION ALL SELECT i.p_brand, i.n, CASE WHEN used + p_size <= 310 THEN used + p_size ELSE used END, i.p_partkey, used + p_size <= 310 FROM fold f JOIN items i ON i.p_brand = f.p_brand AND i.n = f.n + 1)
SELECT p_brand, p_partkey, kept, used FROM fold WHERE n > 0""")
def context_pack(spark, d):
    parts = table(spark, d, "part").withColumn("first", -F.col("p_size"))
    return C.pack(parts, "p_brand", ["first", "p_partkey"], F.col("p_size"), budget=310).select("p_brand", "p_partkey", "kept", "used")


@query("""WITH RECURSIVE items AS MATERIALIZED (SELECT row_number() OVER (ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS n, l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS size FROM lineitem),
took AS (SELECT CAST(0 AS BIGINT) AS n, CAST(12345 AS BIGINT) AS room UNION ALL SELECT i.n, t.room - i.size FROM took t JOIN items i ON i.n > t.n AND i.size <= t.room QUALIFY row_number() OVER (ORDER BY i.n) = 1)
SELECT l_orderkey, l_linenumber, t.n IS NOT NULL AS kept, CAST(sum(CASE WHEN t.n IS NULL THEN 0 ELSE size END) OVER (ORDER BY items.n) AS BIGINT) AS used FROM items LEFT JOIN (SELECT n FROM took WHERE n > 0) t ON t.n = items.n""")
def context_pack_one_group(spark, d):
    """All line items in one group, in the order of their prices."""
    lines = table(spark, d, "lineitem").withColumns({"everything": F.lit("all"), "first": -F.col("l_extendedprice")})
    packed = C.pack_parallel(lines, "everything", ["first", "l_orderkey", "l_linenumber"], F.col("l_quantity"), budget=12345)
    return packed.select("l_orderkey", "l_linenumber", "kept", "used")


@query("SELECT doc_id, source AS file, CAST(1 AS INTEGER) AS line_start, CAST(len(string_split(text, chr(10))) AS INTEGER) AS line_end, substring(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), 1, 200) AS snippet FROM documents")
def references_snippet(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.col("source").alias("file_path"), F.lit(1).alias("start_line"), F.size(F.split("text", "\n")).alias("end_line"), F.col("doc_id").cast("string").alias("label"), F.lit(True).alias("kept"), F.col("text").alias("code"))
    return C.references(rows).select(F.col("class_method").cast("long").alias("doc_id"), "file", "line_start", "line_end", "snippet")


@query("SELECT '처리 흐름: ' || (SELECT string_agg(r_name, ' / ' ORDER BY r_name) FROM region) || ' → ' || (SELECT string_agg(n_name, ' / ' ORDER BY n_name) FROM nation) || ' → 테이블(' || (SELECT string_agg(c_mktsegment, ', ' ORDER BY c_mktsegment) FROM (SELECT DISTINCT c_mktsegment FROM customer)) || ')' AS summary")
def chain_summary(spark, d):
    named = lambda t, kind, c: table(spark, d, t).select(F.lit(kind).alias("node_type"), F.col(c).alias("label"))
    return C.chain_summary(named("region", "URL", "r_name").unionByName(named("nation", "IMPL_METHOD", "n_name")).unionByName(named("customer", "TABLE", "c_mktsegment")))


# Extraction and the guard, on texts that the tables' rows make

_TRACE = "ERROR request failed\njava.lang.IllegalStateException: no loan\n\tat app.loan.LoanService.find(LoanService.java:{k})\n\tat java.base/java.lang.Thread.run(Thread.java:10)\n\tat org.web.Filter.doFilter(Filter.java:7)\nCaused by: java.lang.NullPointerException\n\tat app.loan.LoanDao.load(LoanDao.java:9)\n\tat app.X.y(Native Method)"


def _traces(spark, d):
    """A log for each order, its number in the first own frame; every fourth one is no trace."""
    text = F.when(F.col("o_orderkey") % 4 != 0, F.replace(F.lit(_TRACE), F.lit("{k}"), F.col("o_orderkey").cast("string"))).otherwise("all is well")
    return stacktrace.parse_traces(table(spark, d, "orders").select("o_orderkey", text.alias("content")), own_prefix="app.")


@query("""SELECT o_orderkey, position, full_class, package, class_name, method_name, file_name, CAST(coalesce(line, o_orderkey) AS INTEGER) AS line_number FROM orders, (VALUES (0, 'app.loan.LoanService', 'app.loan', 'LoanService', 'find', 'LoanService.java', NULL),
(1, 'org.web.Filter', 'org.web', 'Filter', 'doFilter', 'Filter.java', 7), (2, 'app.loan.LoanDao', 'app.loan', 'LoanDao', 'load', 'LoanDao.java', 9)) AS t(position, full_class, package, class_name, method_name, file_name, line) WHERE o_orderkey % 4 <> 0""")
def stacktrace_frames(spark, d):
    return stacktrace.frame_rows(_traces(spark, d), "o_orderkey")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 <> 0 THEN 'java.lang.IllegalStateException, java.lang.NullPointerException' ELSE '' END AS classes, CAST(CASE WHEN o_orderkey % 4 <> 0 THEN 2 ELSE 0 END AS INTEGER) AS own_frames,
CAST(CASE WHEN o_orderkey % 4 <> 0 THEN o_orderkey END AS INTEGER) AS origin_line, o_orderkey % 4 <> 0 AS is_trace FROM orders""")
def stacktrace_summary(spark, d):
    classes = F.array_join(F.transform("exception_chain", lambda e: e["exception_class"]), ", ")
    return _traces(spark, d).select("o_orderkey", classes.alias("classes"), F.size("our_frames").alias("own_frames"), F.col("origin_frame.line_number").alias("origin_line"), "is_trace")


@query("""SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN ['TB_L' || p_size, 'TB_BOOK'] WHEN 1 THEN ['TB_M' || p_size] WHEN 2 THEN ['TB_LOAN'] WHEN 3 THEN [] ELSE ['TB_LOAN'] END AS refs FROM part""")
def table_refs(spark, d):
    """Statements of five shapes: a join, an update, an insert, no table of ours, and repeated names."""
    size = F.col("p_size").cast("string")
    shapes = [
        F.concat(F.lit("select * from tb_l"), size, F.lit(" l join TB_BOOK b on 1 = 1")),
        F.concat(F.lit("update TB_M"), size, F.lit(" set a = 1")),
        F.lit("insert into TB_LOAN values (1)"),
        F.lit("select 1 from other"),
        F.lit("SELECT * FROM TB_LOAN JOIN tb_loan x, tb_skip"),
    ]
    sql = F.get(F.array(*shapes), (F.col("p_partkey") % 5).cast("int"))
    return table(spark, d, "part").select("p_partkey", sql.alias("sql")).select("p_partkey", S.table_refs("sql").alias("refs"))


@query("""WITH t AS (SELECT n_nationkey AS k, 't' || lpad(n_nationkey::VARCHAR, 2, '0') AS name, n_name FROM nation)
SELECT string_agg('TABLE ' || name || CASE WHEN k % 4 < 2 THEN ' -- of ' || n_name ELSE '' END || chr(10) || '  - id VARCHAR(' || k + 5 || ') [PK, NOT NULL]  -- key of ' || k
|| CASE WHEN k % 2 = 0 THEN chr(10) || '  - cnt INT [DEFAULT ' || k || ']' ELSE '' END || CASE WHEN k % 3 = 0 THEN chr(10) || '  - m VARCHAR(5) [FK -> t00.id]' ELSE '' END || chr(10) || '  - note TEXT', chr(10) || chr(10) ORDER BY name) AS schema_text FROM t""")
def schema_text(spark, d):
    """A CREATE TABLE statement for each nation, with columns, keys and comments as its number decides."""
    k, optional = F.col("n_nationkey"), lambda condition, *parts: F.when(condition, F.concat(*parts)).otherwise("")
    made = F.concat(
        F.lit("CREATE TABLE t"), F.lpad(k.cast("string"), 2, "0"), F.lit(" (id VARCHAR("), (k + 5).cast("string"), F.lit(") NOT NULL COMMENT 'key of "), k.cast("string"), F.lit("', "),
        optional(k % 2 == 0, F.lit("cnt INT DEFAULT "), k.cast("string"), F.lit(", ")),
        optional(k % 3 == 0, F.lit("m VARCHAR(5), ")),
        F.lit("note TEXT, PRIMARY KEY (id)"),
        optional(k % 3 == 0, F.lit(", CONSTRAINT f FOREIGN KEY (m) REFERENCES t00 (id)")),
        F.lit(")"),
        optional(k % 4 < 2, F.lit(" COMMENT='of "), F.col("n_name"), F.lit("'")),
        F.lit(";"),
    )
    return ddl.schema_text(ddl.parse_ddl(table(spark, d, "nation").select(made.alias("content"))))


#: Statements about a table {t} with a number {k}; what the guard says if {t} is known, its row limit as SQL.
_CASES = (
    ("SELECT * FROM `{t}` LIMIT {k}", "true", "NULL", "k"),
    ("SELECT n_name FROM `{t}`", "true", "NULL", "100"),
    ("SELECT * FROM `{t}` ORDER BY 1 LIMIT {k}00", "true", "NULL", "least(100 * k, 100)"),
    ("SELECT * FROM `{t}` LIMIT {k}, 20", "true", "NULL", "20"),
    ("select count(*), max(length(a)) AS m from `{t}` where b between 1 and {k} and not c like '%x' group by d having count(*) > 1", "true", "NULL", "100"),
    ("SELECT a, row_number() OVER (PARTITION BY b ORDER BY c) FROM `{t}` x LEFT JOIN (SELECT {k} AS b) y USING (b)", "true", "NULL", "100"),
    ("SELECT * FROM `{t}` WHERE a IN (SELECT b FROM secret)", "false", "true", "NULL"),
    ("SELECT * FROM (SELECT * FROM nowhere) q, `{t}`", "false", "true", "NULL"),
    ("WITH x AS (SELECT * FROM `{t}`) SELECT * FROM x", "false", "true", "NULL"),
    ("SELEC x FRM `{t}`", "false", "true", "NULL"),
    (" -- {t}", "false", "true", "NULL"),
    ("DELETE FROM `{t}`", "false", "false", "NULL"),
    ("SELECT {k} FROM `{t}`; SELECT 2", "false", "false", "NULL"),
    ("SELECT 'INTO OUTFILE' FROM `{t}`", "false", "false", "NULL"),
    ("SELECT 1 FROM `{t}` UNION SELECT {k} FROM `{t}`", "false", "false", "NULL"),
    ("SELECT java_method('java.lang.System', 'getenv', 'PATH') FROM `{t}`", "false", "false", "NULL"),
    ("SELECT IDENTIFIER('java_method')('java.lang.System', 'exit') FROM `{t}`", "false", "false", "NULL"),
    ("SELECT * FROM IDENTIFIER('{t}')", "false", "false", "NULL"),
    ("SELECT TRANSFORM(a) USING 'cat' AS (b) FROM `{t}`", "false", "false", "NULL"),
    ("SELECT * FROM `{t}`, range({k})", "false", "false", "NULL"),
)
_VERDICTS = ", ".join(f"({n}, {ok}, {again}::BOOLEAN, '{limit}', {sql.startswith(('SELECT', 'select')) and ok == 'true'})" for n, (sql, ok, again, limit) in enumerate(_CASES))


@query(f"""SELECT n_nationkey, n AS case_no, ok AND (n_regionkey < 3 OR NOT ok) AS ok, CASE WHEN ok AND n_regionkey >= 3 THEN true ELSE again END AS retryable,
CAST(CASE WHEN NOT ok OR n_regionkey >= 3 THEN NULL WHEN lim = 'k' THEN n_nationkey WHEN lim LIKE 'least%' THEN least(100 * n_nationkey, 100) ELSE TRY_CAST(lim AS INTEGER) END AS INTEGER) AS row_limit
FROM nation, (VALUES {_VERDICTS}) AS t(n, ok, again, lim, reads)""")
def sql_guard_verdicts(spark, d):
    """Every case about every nation's name as a table, of which those of the first three regions are known."""
    nations = table(spark, d, "nation")
    cases = F.array(*(F.struct(F.lit(n).alias("case_no"), F.lit(sql).alias("sql")) for n, (sql, *_) in enumerate(_CASES)))
    each = nations.select("n_nationkey", "n_name", F.inline(cases))
    filled = F.replace(F.replace("sql", F.lit("{t}"), "n_name"), F.lit("{k}"), F.col("n_nationkey").cast("string"))
    known = {r["n_name"] for r in nations.where("n_regionkey < 3").select("n_name").toLocalIterator()}
    return sql_guard.verdict_rows(each.withColumn("sql", filled), ["n_nationkey", "case_no"], "sql", known)


@query("SELECT event_type, count(*) AS runs, round(avg(value), 4) AS mean_value, round(max(value), 4) AS max_value, round(arg_min(value, event_id), 4) AS first_value, CASE WHEN arg_min(value, event_id) > 1.5 * (sum(value) - arg_min(value, event_id)) / (count(*) - 1) THEN true ELSE false END AS cold_start FROM events GROUP BY 1")
def run_stats(spark, d):
    return harness.run_stats(table(spark, d, "events"), "event_type", "event_id", "value")


@query("SELECT user_id, good, total, CASE WHEN good = total THEN '시연 확정' WHEN good >= 0.8 * total THEN '예비' ELSE '제외' END AS verdict FROM (SELECT user_id, count(*) FILTER (WHERE value < 90) AS good, count(*) AS total FROM events GROUP BY 1)")
def run_verdicts(spark, d):
    return harness.verdicts(table(spark, d, "events"), "user_id", F.col("value") < 90)


@query("SELECT doc_id, coalesce(contains(text, 'th') AND (contains(text, 'ing') OR contains(text, 'tion')), false) AS good FROM documents")
def keyword_checks(spark, d):
    return table(spark, d, "documents").select("doc_id", harness.holds_words(F.col("text"), ["th"], [["ing", "tion"], []]).alias("good"))
