"""Extraction, graph building, chunks and traces over source files made from the driver's tables, and the SQL that each
must agree with. Every supplier is a module of four Java files and a mapper file; every nation a CREATE TABLE statement;
every event a log with a stack trace."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryflow.functions import scalar as S
from quarryflow.operators import context as C
from quarryflow.operators import ddl, graph, java_source, mapper_xml, stacktrace, vector
from quarryflow.sources.files import table
from quarryflow.sources.scratch import Scratch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: A module's files by name; {k} is the supplier's key.
JAVA = {
    "S{k}Controller.java": """package app.s{k};

@Controller
@RequestMapping("/s{k}")
public class S{k}Controller {
    @Resource(name = "s{k}Service")
    private S{k}Service s{k}Service;

    /* 목록 {k} */
    @RequestMapping(value = "/list.do", method = {RequestMethod.GET, RequestMethod.POST})
    public String list(int id, Map<String, String> model) {
        model.put("a", s{k}Service.find(id));
        return help("x");
    }

    private String help(String s) { return s; }
}
""",
    "S{k}Service.java": "package app.s{k};\npublic interface S{k}Service {\n    String find(int id);\n}\n",
    "S{k}ServiceImpl.java": """package app.s{k};
@Service("s{k}Service")
public class S{k}ServiceImpl extends Base implements S{k}Service {
    @Autowired
    private S{k}Mapper s{k}Mapper;
    @Override
    public String find(int id) {
        if (id < 0) { throw new IllegalArgumentException("} " + id); }
        s{k}Mapper.gone(id);
        return s{k}Mapper.select(id);
    }
}
""",
    "S{k}Mapper.java": "package app.s{k};\npublic interface S{k}Mapper { String select(int id); }\n",
}
XML = {
    "S{k}Mapper.xml": """<mapper namespace="app.s{k}.S{k}Mapper">
    <!-- find {k} -->
    <select id="select" parameterType="int" resultType="string">
        SELECT * FROM TB_S{k} A JOIN tb_all B ON A.X = B.X
        <where><if test="id > 0">AND A.ID = #{id}</if></where>
    </select>
    <update id="mark">UPDATE TB_S{k} SET A = 'a' WHERE B &lt; 5</update>
</mapper>
""",
}
TRACE = "ERROR request {k}\njava.lang.IllegalStateException: no {k}\n\tat app.loan.Loan{k}.find(Loan{k}.java:{k})\n\tat java.base/java.lang.Thread.run(Thread.java:10)\nCaused by: java.lang.NullPointerException: none\n\tat org.web.Filter.doFilter(Filter.java:7)\n\tat app.X.y(Native Method)"
DDL = "CREATE TABLE t{k} (id VARCHAR(20) NOT NULL COMMENT 'key {k}', cnt INT DEFAULT 0, m VARCHAR(5), PRIMARY KEY (id), CONSTRAINT f FOREIGN KEY (m) REFERENCES t0 (mid)) COMMENT='table {k}';"


def _filled(df: DataFrame, key: str, template: str, name: str) -> DataFrame:
    return df.withColumn(name, F.replace(F.lit(template), F.lit("{k}"), F.col(key).cast("string")))


def _files(spark: SparkSession, d: str, templates: dict[str, str]) -> DataFrame:
    rows = table(spark, d, "supplier").select("s_suppkey")
    return reduce(DataFrame.unionByName, [_filled(_filled(rows, "s_suppkey", name, "path"), "s_suppkey", text, "content").select("path", "content") for name, text in templates.items()])


def query(sql: str):
    def add(fn):
        name = f"extract_{fn.__name__}"
        QUERIES[name], ORACLES[name] = fn, sql
        return fn

    return add


def _each(*rows: str) -> str:
    """A row for each supplier of each list of values, in which {k} is its key."""
    put = lambda v: "replace(" + v + ", '{k}', CAST(s_suppkey AS VARCHAR))" if v.startswith("'") else v
    return " UNION ALL ".join(f"SELECT {', '.join(put(x.strip()) for x in r.split('|'))} FROM supplier" for r in rows)


def _named(columns: str, *rows: str) -> str:
    return f"SELECT * FROM ({_each(*rows)}) AS t({columns})"


def _classes(spark, d):
    return java_source.parse_java(_files(spark, d, JAVA))


def _statements(spark, d):
    return mapper_xml.parse_mappers(_files(spark, d, XML))


def _graph(spark, d):
    """Over classes and statements that are written once: nodes and edges use them several times."""
    scratch = Scratch(spark, "extracted")
    return graph.build_graph(scratch.write(_classes(spark, d), "classes"), scratch.write(_statements(spark, d), "statements"))


# Java and mapper files


@query(_named("file_path, package, class_name, kind, layer, start_line, end_line, parent, above, n_methods", "'S{k}Controller.java' | 'app.s{k}' | 'S{k}Controller' | 'class' | 'CONTROLLER' | 3 | 17 | NULL | '' | 2", "'S{k}Service.java' | 'app.s{k}' | 'S{k}Service' | 'interface' | 'SERVICE_INTERFACE' | 2 | 4 | NULL | '' | 1", "'S{k}ServiceImpl.java' | 'app.s{k}' | 'S{k}ServiceImpl' | 'class' | 'SERVICE_IMPL' | 2 | 12 | 'Base' | 'S{k}Service' | 1", "'S{k}Mapper.java' | 'app.s{k}' | 'S{k}Mapper' | 'interface' | 'MAPPER' | 2 | 2 | NULL | '' | 1"))
def classes(spark, d):
    return _classes(spark, d).select("file_path", "package", "class_name", "kind", "layer", "start_line", "end_line", F.col("extends").alias("parent"), F.array_join("implements", ",").alias("above"), F.size("methods").alias("n_methods"))


@query(_named("class_name, method_name, return_type, parameters, start_line, end_line, url, verbs, comment", "'S{k}Controller' | 'list' | 'String' | 'int id,Map<String, String> model' | 10 | 14 | '/s{k}/list.do' | 'GET,POST' | '/* 목록 {k} */'", "'S{k}Controller' | 'help' | 'String' | 'String s' | 16 | 16 | NULL | '' | NULL", "'S{k}Service' | 'find' | 'String' | 'int id' | 3 | 3 | NULL | '' | NULL", "'S{k}ServiceImpl' | 'find' | 'String' | 'int id' | 6 | 11 | NULL | '' | NULL", "'S{k}Mapper' | 'select' | 'String' | 'int id' | 2 | 2 | NULL | '' | NULL"))
def methods(spark, d):
    rows = _classes(spark, d).select("class_name", F.explode("methods").alias("m"))
    shown = F.array_join(F.transform("m.parameters", lambda p: F.concat(p["type"], F.lit(" "), p["name"])), ",")
    return rows.select("class_name", "m.method_name", "m.return_type", shown.alias("parameters"), "m.start_line", "m.end_line", "m.url", F.array_join("m.http_methods", ",").alias("verbs"), F.col("m.leading_comment").alias("comment"))


@query(_named("class_name, annotation, args", "'S{k}Controller' | 'Controller' | ''", "'S{k}Controller' | 'RequestMapping' | 'value=/s{k}'", "'S{k}ServiceImpl' | 'Service' | 'value=s{k}Service'"))
def class_annotations(spark, d):
    rows = _classes(spark, d).select("class_name", F.explode("class_annotations").alias("a"))
    args = F.array_join(F.transform(F.map_entries("a.args"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return rows.select("class_name", F.col("a.name").alias("annotation"), args.alias("args"))


@query(_named("class_name, field_type, field_name, annotation, given", "'S{k}Controller' | 'S{k}Service' | 's{k}Service' | 'Resource' | 's{k}Service'", "'S{k}ServiceImpl' | 'S{k}Mapper' | 's{k}Mapper' | 'Autowired' | NULL"))
def injected_fields(spark, d):
    rows = _classes(spark, d).select("class_name", F.explode("injected_fields").alias("f"))
    return rows.select("class_name", "f.field_type", "f.field_name", "f.annotation", F.try_element_at("f.annotation_args", F.lit("name")).alias("given"))


@query(_named("class_name, caller, receiver, called, line", "'S{k}Controller' | 'list' | 'model' | 'put' | 12", "'S{k}Controller' | 'list' | 's{k}Service' | 'find' | 12", "'S{k}Controller' | 'list' | NULL | 'help' | 13", "'S{k}ServiceImpl' | 'find' | 's{k}Mapper' | 'gone' | 9", "'S{k}ServiceImpl' | 'find' | 's{k}Mapper' | 'select' | 10"))
def calls(spark, d):
    rows = _classes(spark, d).select("class_name", F.explode("methods").alias("m")).select("class_name", F.col("m.method_name").alias("caller"), F.explode("m.calls").alias("c"))
    return rows.select("class_name", "caller", "c.receiver", F.col("c.method_name").alias("called"), "c.line")


@query(_named("namespace, sql_id, sql_type, start_line, end_line, refs, result_type, parameter_type", "'app.s{k}.S{k}Mapper' | 'select' | 'select' | 3 | 6 | 'TB_S{k},TB_ALL' | 'string' | 'int'", "'app.s{k}.S{k}Mapper' | 'mark' | 'update' | 7 | 7 | 'TB_S{k}' | NULL | NULL"))
def statements(spark, d):
    return _statements(spark, d).select("namespace", "sql_id", "sql_type", "start_line", "end_line", F.array_join("referenced_tables", ",").alias("refs"), "result_type", "parameter_type")


@query(_named("namespace, sql_id, purpose, simpler", "'app.s{k}.S{k}Mapper' | 'select' | 'find {k}' | 'SELECT * FROM TB_S{k} A JOIN tb_all B ON A.X = B.X'", "'app.s{k}.S{k}Mapper' | 'mark' | 'S{k}Mapper.mark — 수정 (테이블: TB_S{k})' | 'UPDATE TB_S{k} SET A = ''a'' WHERE B < 5'"))
def statement_purposes(spark, d):
    rows = mapper_xml.purpose(_statements(spark, d), _files(spark, d, XML))
    return rows.select("namespace", "sql_id", "purpose", F.trim(mapper_xml.simplified()).alias("simpler"))


def _varied_mappers(spark, d):
    """A mapper file a supplier, of a shape that its key decides: how many statements stand in comments before the first
    one, whether there is a second one in a CDATA section, a self-closing one, an end, and a content at all."""
    k = F.col("s_suppkey")
    hidden = F.transform(F.sequence(F.lit(1), k % 4 + 1), lambda j: F.concat(F.lit("  <!-- <select id='no"), j, F.lit("'>SELECT 1 FROM TB_NO</select> -->")))
    text = lambda *parts: F.concat(*(p if not isinstance(p, str) else F.lit(p) for p in parts))
    find = [
        text("  <select id=\"find", k, "\" resultType='R", k, "'"),
        F.lit("    parameterType=\"long\" note=\"a > b\">"),
        text("    SELECT * FROM TB_", k % 7, " A <if test='a &lt; 1'>JOIN tb_b B</if> WHERE A.X &lt; ", k, " &#38; 1 <!-- kept -->"),
        F.lit("  </select>"),
    ]
    drop = text("  <delete id='drop", k, "'><![CDATA[DELETE FROM TB_X WHERE A < ", k, "]]></delete\n>")
    some = lambda condition, line: F.array_compact(F.array(F.when(condition, line)))
    lines = F.concat(
        F.array(F.lit("<?xml version=\"1.0\"?>"), text("<mapper namespace='app.m", k, "'>")),
        hidden.cast("array<string>"),
        F.array(*find),
        some(k % 3 == 0, drop),
        some(k % 2 == 0, F.lit("  <update id='empty'/>")),
        some(k % 5 != 4, F.lit("</mapper>")),
    )
    content = F.when(k % 11 != 10, F.array_join(lines, "\n"))
    return table(spark, d, "supplier").select(F.concat(F.lit("m"), k, F.lit(".xml")).alias("path"), content.alias("content"))


@query("""WITH m AS (SELECT s_suppkey AS k, s_suppkey % 4 + 4 AS line FROM supplier WHERE s_suppkey % 5 <> 4 AND s_suppkey % 11 <> 10)
SELECT 'm' || k || '.xml' AS file_path, 'app.m' || k AS namespace, 'find' || k AS sql_id, 'select' AS sql_type, CAST(line AS INTEGER) AS start_line, CAST(line + 3 AS INTEGER) AS end_line,
'SELECT * FROM TB_' || k % 7 || ' A <if test=''a < 1''>JOIN tb_b B</if> WHERE A.X < ' || k || ' & 1 <!-- kept -->' AS sql_text, 'TB_' || k % 7 || ',TB_B' AS refs, 'R' || k AS result_type, 'long' AS parameter_type FROM m
UNION ALL SELECT 'm' || k || '.xml', 'app.m' || k, 'drop' || k, 'delete', CAST(line + 4 AS INTEGER), CAST(line + 5 AS INTEGER), '<![CDATA[DELETE FROM TB_X WHERE A < ' || k || ']]>', 'TB_X', NULL, NULL FROM m WHERE k % 3 = 0""")
def varied_statements(spark, d):
    refs = F.array_join("referenced_tables", ",").alias("refs")
    return mapper_xml.parse_mappers(_varied_mappers(spark, d)).select("file_path", "namespace", "sql_id", "sql_type", "start_line", "end_line", "sql_text", refs, "result_type", "parameter_type")


@query("SELECT 'm' || s_suppkey || '.xml' AS path, s_suppkey % 11 <> 10 AS is_text FROM supplier WHERE s_suppkey % 5 = 4 OR s_suppkey % 11 = 10")
def failed_mappers(spark, d):
    failed = mapper_xml.failed_mappers(_varied_mappers(spark, d))
    return failed.select("path", (F.col("error") != "not readable as UTF-8").alias("is_text"))


@query("SELECT 'S' || s_suppkey || 'Bad.java' AS path FROM supplier")
def failed_files(spark, d):
    broken = _files(spark, d, JAVA | {"S{k}Bad.java": "class A{k} { void f( { } }"})
    return java_source.failed_files(broken).select("path")


# Graph


@query(_named("id, node_type, label, start_line, summary", "'CONTROLLER_METHOD::S{k}Controller.list' | 'CONTROLLER_METHOD' | 'S{k}Controller.list' | 10 | '/* 목록 {k} */'", "'CONTROLLER_METHOD::S{k}Controller.help' | 'CONTROLLER_METHOD' | 'S{k}Controller.help' | 16 | NULL", "'SERVICE_METHOD::S{k}Service.find' | 'SERVICE_METHOD' | 'S{k}Service.find' | 3 | NULL", "'IMPL_METHOD::S{k}ServiceImpl.find' | 'IMPL_METHOD' | 'S{k}ServiceImpl.find' | 6 | NULL", "'MAPPER_METHOD::S{k}Mapper.select' | 'MAPPER_METHOD' | 'S{k}Mapper.select' | 2 | NULL", "'URL::/s{k}/list.do' | 'URL' | '/s{k}/list.do' | NULL | '/* 목록 {k} */'", "'SQL::app.s{k}.S{k}Mapper.select' | 'SQL' | 'S{k}Mapper.select' | 3 | 'select'", "'SQL::app.s{k}.S{k}Mapper.mark' | 'SQL' | 'S{k}Mapper.mark' | 7 | 'update'", "'TABLE::TB_S{k}' | 'TABLE' | 'TB_S{k}' | NULL | NULL") + " UNION ALL SELECT 'TABLE::TB_ALL', 'TABLE', 'TB_ALL', NULL, NULL")
def graph_nodes(spark, d):
    return _graph(spark, d)[0].select("id", "node_type", "label", "start_line", "summary")


_EDGES = _named("src_id, dst_id, edge_type", "'URL::/s{k}/list.do' | 'CONTROLLER_METHOD::S{k}Controller.list' | 'HANDLES'", "'CONTROLLER_METHOD::S{k}Controller.list' | 'SERVICE_METHOD::S{k}Service.find' | 'CALLS'", "'CONTROLLER_METHOD::S{k}Controller.list' | 'CONTROLLER_METHOD::S{k}Controller.help' | 'CALLS'", "'SERVICE_METHOD::S{k}Service.find' | 'IMPL_METHOD::S{k}ServiceImpl.find' | 'IMPLEMENTS'", "'IMPL_METHOD::S{k}ServiceImpl.find' | 'MAPPER_METHOD::S{k}Mapper.select' | 'CALLS'", "'MAPPER_METHOD::S{k}Mapper.select' | 'SQL::app.s{k}.S{k}Mapper.select' | 'EXECUTES'", "'SQL::app.s{k}.S{k}Mapper.select' | 'TABLE::TB_S{k}' | 'REFERENCES'", "'SQL::app.s{k}.S{k}Mapper.select' | 'TABLE::TB_ALL' | 'REFERENCES'", "'SQL::app.s{k}.S{k}Mapper.mark' | 'TABLE::TB_S{k}' | 'REFERENCES'")


@query(_EDGES)
def graph_edges(spark, d):
    return _graph(spark, d)[1]


@query(_named("src_id, method, outcome, reason", "'CONTROLLER_METHOD::S{k}Controller.list' | 'put' | 'ignored' | NULL", "'CONTROLLER_METHOD::S{k}Controller.list' | 'find' | 'resolved' | NULL", "'CONTROLLER_METHOD::S{k}Controller.list' | 'help' | 'resolved' | NULL", "'IMPL_METHOD::S{k}ServiceImpl.find' | 'gone' | 'unresolved' | 'unknown method'", "'IMPL_METHOD::S{k}ServiceImpl.find' | 'select' | 'resolved' | NULL"))
def graph_calls(spark, d):
    return graph.resolve_calls(_classes(spark, d)).select("src_id", "method", "outcome", "reason")


@query("SELECT * FROM (VALUES ('URL::/s5/list.do'), ('CONTROLLER_METHOD::S5Controller.list'), ('CONTROLLER_METHOD::S5Controller.help'), ('SERVICE_METHOD::S5Service.find'), ('IMPL_METHOD::S5ServiceImpl.find'), ('MAPPER_METHOD::S5Mapper.select'), ('SQL::app.s5.S5Mapper.select'), ('TABLE::TB_S5'), ('TABLE::TB_ALL')) AS t(id)")
def graph_chain(spark, d):
    nodes, edges, _ = _graph(spark, d)
    return graph.chain(nodes, edges, "/s5/list.do")[1].select("id")


@query("SELECT '/s' || s_suppkey || '/list.do' AS url FROM supplier")
def graph_urls(spark, d):
    return graph.list_urls(_graph(spark, d)[0]).select(F.col("label").alias("url"))


@query("SELECT 's' || s_suppkey AS domain, ['/s' || s_suppkey || '/list.do'] AS urls FROM supplier")
def graph_domains(spark, d):
    return graph.urls_by_domain(_graph(spark, d)[0])


@query("SELECT 'IMPL_METHOD::S3ServiceImpl.find' AS id")
def graph_symbol(spark, d):
    return graph.node_by_symbol(_graph(spark, d)[0], "S3ServiceImpl", "find").select("id")


@query("SELECT 'SQL::app.s' || s_suppkey || '.S' || s_suppkey || 'Mapper.select' AS id FROM supplier")
def graph_statements_of_a_table(spark, d):
    nodes, edges, _ = _graph(spark, d)
    return graph.sqls_by_table(nodes, edges, "TB_ALL").select("id")


@query(_named("url, title, tables, sql_count, chain_line", "'/s{k}/list.do' | 'list' | 'TB_ALL,TB_S{k}' | 1 | 'S{k}Controller.list → S{k}ServiceImpl.find → SQL 1건'"))
def manual_entries(spark, d):
    nodes, edges, _ = _graph(spark, d)
    return C.manual_rows(nodes, edges).select("url", "title", F.array_join("tables", ",").alias("tables"), F.col("sql_count").cast("int").alias("sql_count"), "chain_line")


# Chunks


#: Texts of a module's chunks, line feeds written as § and bars as ¦.
_CHUNK_TEXTS = (
    """'IMPL_METHOD::S{k}ServiceImpl.find' | 'SERVICE_IMPL' | NULL | 'TB_ALL,TB_S{k}' | '계층: ServiceImpl ¦ 클래스: S{k}ServiceImpl ¦ 메서드: find§관련 테이블: TB_ALL, TB_S{k}§---§    @Override§"""
    """    public String find(int id) {§        if (id < 0) { throw new IllegalArgumentException("} " + id); }§        s{k}Mapper.gone(id);§        return s{k}Mapper.select(id);§    }'""",
    """'CONTROLLER_METHOD::S{k}Controller.help' | 'CONTROLLER' | NULL | '' | '계층: Controller ¦ 클래스: S{k}Controller ¦ 메서드: help§---§    private String help(String s) { return s; }'""",
    """'CONTROLLER_METHOD::S{k}Controller.list' | 'CONTROLLER' | '/s{k}/list.do' | 'TB_ALL,TB_S{k}' | '계층: Controller ¦ 클래스: S{k}Controller ¦ 메서드: list§URL: /s{k}/list.do§주석: 목록 {k}§관련 테이블: TB_ALL, TB_S{k}§---§"""
    """    @RequestMapping(value = "/list.do", method = {RequestMethod.GET, RequestMethod.POST})§    public String list(int id, Map<String, String> model) {§        model.put("a", s{k}Service.find(id));§        return help("x");§    }'""",
)
_SQL_TEXTS = (
    "'SQL::app.s{k}.S{k}Mapper.mark' | 'S{k}Mapper' | '계층: SQL ¦ Mapper: S{k}Mapper ¦ SQL ID: mark§유형: update§관련 테이블: TB_S{k}§XML 파일: S{k}Mapper.xml§---§UPDATE TB_S{k} SET A = ''a'' WHERE B < 5'",
    "'SQL::app.s{k}.S{k}Mapper.select' | 'S{k}Mapper' | '계층: SQL ¦ Mapper: S{k}Mapper ¦ SQL ID: select§유형: select§관련 테이블: TB_S{k}, TB_ALL§XML 파일: S{k}Mapper.xml§---§"
    "SELECT * FROM TB_S{k} A JOIN tb_all B ON A.X = B.X§        <where><if test=\"id > 0\">AND A.ID = #{id}</if></where>'",
)


def _in_one_line(text):
    return F.translate(text, "\n|", "§¦")


@query(_named("node_id, layer, url, tables, text", *_CHUNK_TEXTS))
def method_chunks(spark, d):
    nodes, edges, _ = _graph(spark, d)
    chunks = vector.method_chunks(_classes(spark, d), _files(spark, d, JAVA), nodes, edges)
    return chunks.select("node_id", "layer", "url", F.array_join("tables", ",").alias("tables"), _in_one_line("text").alias("text"))


@query(_named("node_id, class_name, text", *_SQL_TEXTS))
def sql_chunks(spark, d):
    return vector.sql_chunks(_statements(spark, d)).select("node_id", "class_name", _in_one_line("text").alias("text"))


@query("SELECT vec_id AS node_id, CASE WHEN vec_id = 1 THEN 0 WHEN vec_id = 2 THEN 1 ELSE 2 END AS tier FROM (SELECT vec_id FROM embeddings WHERE vec_id < 3 AND vec_id > 0 UNION ALL SELECT vec_id FROM (SELECT vec_id FROM embeddings WHERE vec_id <> 2 ORDER BY list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)) DESC, vec_id LIMIT 4))")
def few_shots(spark, d):
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("node_id"), F.lit("t").alias("text"), "embedding")
    probe = list(rows.where("node_id = 0").first()["embedding"])
    hits = vector.search(rows, probe, 8)
    return vector.examples(rows.where("node_id = 1"), rows.where("node_id = 2"), hits).select("node_id", "tier")


@query("SELECT source AS grp, bool_and(NOT regexp_matches(coalesce(text, ''), '\\bif\\s*\\(|\\bthrow\\b')) AS trivial FROM documents WHERE source IS NOT NULL AND text IS NOT NULL GROUP BY 1")
def trivial_groups(spark, d):
    rows = table(spark, d, "documents").where("source IS NOT NULL AND text IS NOT NULL").select(F.col("source").alias("grp"), F.col("text").alias("code"))
    return C.is_trivial(rows, "grp")


# Traces, catalogs, slices, scalars


def _traces(spark, d):
    return stacktrace.parse_traces(_filled(table(spark, d, "events").select("event_id"), "event_id", TRACE, "content"), own_prefix="app.")


@query("SELECT event_id, 0 AS position, 'app.loan.Loan' || event_id AS full_class, 'app.loan' AS package, 'Loan' || event_id AS class_name, 'find' AS method_name, 'Loan' || event_id || '.java' AS file_name, CAST(event_id AS INTEGER) AS line_number FROM events UNION ALL SELECT event_id, 1, 'org.web.Filter', 'org.web', 'Filter', 'doFilter', 'Filter.java', 7 FROM events")
def trace_frames(spark, d):
    return stacktrace.frame_rows(_traces(spark, d), "event_id")


@query("SELECT event_id, 'java.lang.IllegalStateException: no ' || event_id || ', java.lang.NullPointerException: none' AS chain, 1 AS own_frames, CAST(event_id AS INTEGER) AS origin_line, true AS is_trace FROM events")
def trace_summaries(spark, d):
    chain = F.array_join(F.transform("exception_chain", lambda e: F.concat(e["exception_class"], F.lit(": "), e["message"])), ", ")
    return _traces(spark, d).select("event_id", chain.alias("chain"), F.size("our_frames").alias("own_frames"), F.col("origin_frame.line_number").alias("origin_line"), "is_trace")


@query("SELECT doc_id FROM documents")
def trace_none(spark, d):
    return stacktrace.parse_traces(table(spark, d, "documents").select("doc_id", F.col("text").alias("content"))).where("NOT coalesce(is_trace, false)").select("doc_id")


_CATALOG = " UNION ALL ".join(f"SELECT 't' || n_nationkey AS table_name, 'table ' || n_nationkey AS table_comment, {row} FROM nation" for row in ("'id' AS column_name, 'VARCHAR(20)' AS data_type, false AS nullable, NULL AS default_value, 'key ' || n_nationkey AS column_comment, true AS is_pk, NULL AS fk_ref_table, NULL AS fk_ref_column, 0 AS position", "'cnt', 'INT', true, '0', NULL, false, NULL, NULL, 1", "'m', 'VARCHAR(5)', true, NULL, NULL, false, 't0', 'mid', 2"))


@query(_CATALOG)
def catalog(spark, d):
    return ddl.parse_ddl(_filled(table(spark, d, "nation").select("n_nationkey"), "n_nationkey", DDL, "content"))


@query("SELECT 't' || n_nationkey AS table_name, '### t' || n_nationkey || ' table ' || n_nationkey || '§§| column | type | comment |§|---|---|---|§| id | VARCHAR(20) | key ' || n_nationkey || ' |§| cnt | INT |  |§| m | VARCHAR(5) |  |' AS markdown FROM nation")
def catalog_appendix(spark, d):
    return C.appendix(catalog(spark, d)).select("table_name", F.replace("markdown", F.lit("\n"), F.lit("§")).alias("markdown"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN ['TB_P' || p_partkey, 'TB_X'] ELSE [] END AS refs FROM part")
def table_names(spark, d):
    sql = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("select * from tb_p"), "p_partkey", F.lit(" a JOIN TB_x, tb_no b join tb_X"))).otherwise("select 1 from other")
    return table(spark, d, "part").select("p_partkey", S.table_refs(sql).alias("refs"))


@query("SELECT doc_id, array_to_string(list_slice(string_split(text, chr(10)), 2, 3), chr(10)) AS part, '    ' || string_split(text, chr(10))[1] || CASE WHEN contains(text, chr(10)) THEN chr(10) || '>>> ' || string_split(text, chr(10))[2] ELSE '' END AS marked FROM documents WHERE text IS NOT NULL AND NOT contains(text, chr(13))")
def line_slices(spark, d):
    rows = table(spark, d, "documents").where("text IS NOT NULL AND NOT contains(text, '\r')")
    return rows.select("doc_id", S.line_slice("text", F.lit(2), F.lit(3)).alias("part"), S.marked_slice("text", F.lit(1), F.lit(2), F.lit(2)).alias("marked"))


@query("SELECT doc_id, CASE source WHEN 'web' THEN 'Web' WHEN 'books' THEN 'Books' END AS label, coalesce(nullif(lang, ''), 'none') AS lang, regexp_matches(text, '[가-힣]') AS hangul FROM documents")
def scalar_labels(spark, d):
    return table(spark, d, "documents").select("doc_id", S.label_of("source", {"web": "Web", "books": "Books"}).alias("label"), S.default_if_blank("lang", "none").alias("lang"), S.has_hangul("text").alias("hangul"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS moment, strftime(o_orderdate, '%Y-%m-%d') AS day, 'OD' || upper(substring(sha256(CAST(o_orderkey AS VARCHAR)), 1, 16)) AS code FROM orders")
def scalar_cells(spark, d):
    moment = F.col("o_orderdate")
    return table(spark, d, "orders").select("o_orderkey", S.cell(moment, "timestamp_ntz").alias("moment"), S.cell(moment.cast("date"), "date").alias("day"), S.surrogate_id("OD", "o_orderkey").alias("code"))
