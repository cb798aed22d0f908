import os

import pytest
from quarryflow.functions import scalar as S
from quarryflow.operators import ddl, graph, java_source, mapper_xml, stacktrace, vector
from quarryflow.sources import files

CONTROLLER = '''package app.loan;
import java.util.*;

/** 대출 */
@Controller
@RequestMapping("/loan")
public class LoanController {
    @Resource(name = "loanService")
    private LoanService loanService;

    /* 목록 조회 */
    @GetMapping("/list.do")
    public String list(@ModelAttribute LoanVO vo, Map<String, List<String>> model) throws Exception {
        if (vo == null) { return "x"; }
        model.put("a", loanService.find(vo.getId()).trim());
        return new StringBuilder("(").append(this.<String>help("b")).toString();
    }

    @RequestMapping(value = "save.do", method = {RequestMethod.POST, RequestMethod.PUT})
    public String save(LoanVO... vo) { loanService.gone(); return help("s"); }

    private String help(String s) { return s; }
}
'''
SERVICE = "package app.loan;\npublic interface LoanService { String find(String id); }\n"
IMPL = '''package app.loan;
@Service("loanService")
public class LoanServiceImpl extends Base implements LoanService {
    @Autowired private LoanMapper loanMapper;
    public LoanServiceImpl() { super(); }
    @Override
    public String find(String id) {
        Runnable r = () -> loanMapper.select(id);
        int[] a = {1, 2};
        return loanMapper.select(id);
    }
}
class Base { static final String X = "a;b}"; }
'''
MAPPER = "package app.loan;\npublic interface LoanMapper { String select(String id); }\n"
VO = "package app.loan;\npublic class LoanVO { private String id; public String getId() { return id; } }\n"
CODES = "package app.loan;\npublic enum Status { OUT(\"1\"), IN(\"2\"); private final String c; Status(String c) { this.c = c; } public String code() { return c; } }\n"
XML = '''<?xml version="1.0"?>
<!DOCTYPE mapper PUBLIC "-//x//" "http://x">
<mapper namespace="app.loan.LoanMapper">
    <!-- find one -->
    <select id="select" parameterType="string" resultType="app.loan.LoanVO">
        SELECT * FROM TB_LOAN L JOIN tb_book B ON 1 = 1
        <where><if test="a != null">AND L.A &lt; #{a}</if></where>
        LIMIT #{x}, #{y}
    </select>
    <delete>DELETE FROM TB_X</delete>
    <update id="mark">UPDATE TB_LOAN SET A = #{a}</update>
</mapper>
'''
JAVA = {"c.java": CONTROLLER, "s.java": SERVICE, "i.java": IMPL, "m.java": MAPPER, "v.java": VO, "e.java": CODES, "bad.java": None}


def parsed(spark):
    return java_source.parse_java(spark.createDataFrame(list(JAVA.items()), "path string, content string"))


def statements(spark):
    return mapper_xml.parse_mappers(spark.createDataFrame([("l.xml", XML), ("n.xml", None)], "path string, content string"))


def test_java_classes(spark):
    rows = {r["class_name"]: r for r in parsed(spark).collect()}
    assert {k: r["layer"] for k, r in rows.items()} == {"LoanController": "CONTROLLER", "LoanService": "SERVICE_INTERFACE", "LoanServiceImpl": "SERVICE_IMPL", "Base": "ETC", "LoanMapper": "MAPPER", "LoanVO": "VO", "Status": "ETC"}
    c = rows["LoanController"]
    assert c["package"] == "app.loan" and (c["start_line"], c["end_line"]) == (5, 23)
    assert c["injected_fields"][0]["annotation_args"] == {"name": "loanService"} and c["injected_fields"][0]["field_type"] == "LoanService"
    listed, save, help_ = c["methods"]
    assert listed["url"] == "/loan/list.do" and listed["http_methods"] == ["GET"] and listed["leading_comment"] == "/* 목록 조회 */" and (listed["start_line"], listed["end_line"]) == (12, 17)
    assert [(p["type"], p["name"]) for p in listed["parameters"]] == [("LoanVO", "vo"), ("Map<String, List<String>>", "model")]
    assert [(x["receiver"], x["method_name"]) for x in listed["calls"]] == [("model", "put"), ("loanService.find(vo.getId())", "trim"), ("loanService", "find"), ("vo", "getId"), ('new StringBuilder("(").append(this.<String>help("b"))', "toString"), ('new StringBuilder("(")', "append"), ("this", "help")]
    assert save["url"] == "/loan/save.do" and save["http_methods"] == ["POST", "PUT"] and save["parameters"] == [] and [x["method_name"] for x in save["calls"]] == ["gone", "help"]
    assert help_["url"] is None
    assert rows["LoanServiceImpl"]["extends"] == "Base" and rows["LoanServiceImpl"]["implements"] == ["LoanService"]
    assert [m["method_name"] for m in rows["LoanServiceImpl"]["methods"]] == ["find"] and [m["method_name"] for m in rows["Status"]["methods"]] == ["code"]
    assert [r["path"] for r in java_source.failed_files(spark.createDataFrame(list(JAVA.items()), "path string, content string")).collect()] == ["bad.java"]
    odd = spark.createDataFrame([("x.java", "class A { void f( { } }"), ("y.java", "class B { }"), ("z.java", None)], "path string, content string")
    assert [r["class_name"] for r in java_source.parse_java(odd).collect()] == ["B"]
    assert {r["path"]: r["reason"].split(":")[0] for r in java_source.failed_files(odd).collect()} == {"x.java": "IndexError", "z.java": "not UTF-8 text"}


def test_an_unclosed_table_keeps_its_comments():
    got = ddl.catalog_of("CREATE TABLE a (x INT COMMENT 'key', y VARCHAR(5) COMMENT 'name'; CREATE TABLE b (z INT);")
    assert [(r["table_name"], r["column_name"], r["column_comment"], r["data_type"]) for r in got] == [("a", "x", "key", ""), ("a", "y", "name", ""), ("b", "z", None, "INT")]
    assert ddl.catalog_of("CREATE TABLE c (x INT COMMENT 'k'") [0]["column_comment"] == "k"


def test_mapper_statements(spark):
    a, b = statements(spark).orderBy("start_line").collect()
    assert (a["sql_id"], a["sql_type"], a["start_line"], a["end_line"], a["namespace"]) == ("select", "select", 5, 9, "app.loan.LoanMapper")
    assert a["referenced_tables"] == ["TB_LOAN", "TB_BOOK"] and "L.A < #{a}" in a["sql_text"] and b["sql_id"] == "mark"
    simple = statements(spark).where("sql_id = 'select'").select(mapper_xml.simplified().alias("s")).first()["s"]
    assert "where" not in simple and simple.endswith("LIMIT 10") and "\n\n" not in simple
    texts = spark.createDataFrame([("l.xml", XML)], "path string, content string")
    assert [r["purpose"] for r in mapper_xml.purpose(statements(spark), texts).orderBy("start_line").collect()] == ["find one", "LoanMapper.mark — 수정 (테이블: TB_LOAN)"]


def test_graph_from_sources(spark):
    classes, sqls = parsed(spark), statements(spark)
    nodes, edges, calls = (x.cache() for x in graph.build_graph(classes, sqls))
    kinds = {r[0]: r[1] for r in edges.groupBy("edge_type").count().collect()}
    assert kinds == {"HANDLES": 2, "CALLS": 5, "IMPLEMENTS": 1, "EXECUTES": 1, "REFERENCES": 3}
    assert {r["outcome"]: r["count"] for r in calls.groupBy("outcome").count().collect()} == {"resolved": 5, "ignored": 5, "unresolved": 1}
    found, kept, left = graph.chain(nodes, edges, "/loan/list.do")
    assert found and {r["node_type"] for r in kept.collect()} == {"URL", "CONTROLLER_METHOD", "SERVICE_METHOD", "IMPL_METHOD", "MAPPER_METHOD", "SQL", "TABLE"}
    assert left.where("edge_type = 'CALLS'").count() == 4  # repeats are kept
    assert graph.chain(nodes, edges, "/none")[0] is False
    assert [r["label"] for r in graph.list_urls(nodes).collect()] == ["/loan/list.do", "/loan/save.do"]
    assert [r["id"] for r in graph.sqls_by_table(nodes, edges, "TB_BOOK").collect()] == ["SQL::app.loan.LoanMapper.select"]
    assert graph.node_by_symbol(nodes, "LoanServiceImpl", "find").first()["node_type"] == "IMPL_METHOD"
    texts = spark.createDataFrame([(k, v) for k, v in JAVA.items() if v], "path string, content string")
    chunk = vector.method_chunks(classes, texts, nodes, edges).where("method_name = 'list'").first()
    assert chunk["tables"] == ["TB_BOOK", "TB_LOAN"] and chunk["text"].startswith("계층: Controller | 클래스: LoanController | 메서드: list\nURL: /loan/list.do\n주석: 목록 조회\n관련 테이블: TB_BOOK, TB_LOAN\n---\n    @GetMapping")
    assert vector.sql_chunks(sqls).where("method_name = 'mark'").first()["text"].split("\n")[:3] == ["계층: SQL | Mapper: LoanMapper | SQL ID: mark", "유형: update", "관련 테이블: TB_LOAN"]
    stats = {r["metric"]: r["value"] for r in graph.graph_stats(nodes, edges, calls).collect()}
    assert abs(stats["unresolved_ratio"] - 1 / 6) < 1e-9 and stats["nodes:URL"] == 2


def test_ddl(spark):
    text = "CREATE TABLE t (a VARCHAR(5) NOT NULL DEFAULT 'x', b DECIMAL(5,2) COMMENT 'it''s', c DATETIME DEFAULT CURRENT_TIMESTAMP, PRIMARY KEY (a)) COMMENT='tt'; SELECT 1; CREATE TABLE u (a INT, broken COMMENT 'note');"
    rows = ddl.catalog_of(text)
    assert [(r["column_name"], r["data_type"], r["nullable"], r["default_value"], r["column_comment"], r["is_pk"]) for r in rows[:3]] == [("a", "VARCHAR(5)", False, "x", None, True), ("b", "DECIMAL(5, 2)", True, None, "it's", False), ("c", "DATETIME", True, "CURRENT_TIMESTAMP()", None, False)]
    assert ddl.catalog_of("") == [] and ddl.parse_ddl(spark.createDataFrame([(text,), (None,)], "content string")).where("table_name = 't'").count() == 3


def test_stack_trace(spark):
    log = "x\njava.lang.RuntimeException: boom \n\tat a.b.C.run(C.java:5)\n\tat java.base/x.Y.z(Y.java:1)\n\tat q.R.s(Native Method)\nCaused by: e.BadError: why\n\tat own.K.<init>(K.java:9)"
    rows = stacktrace.parse_traces(spark.createDataFrame([(1, log), (2, "nothing"), (3, None)], "i int, content string"), own_prefix="own.").orderBy("i").collect()
    assert [(e["exception_class"], e["message"]) for e in rows[0]["exception_chain"]] == [("java.lang.RuntimeException", "boom"), ("e.BadError", "why")]
    assert [f["line_number"] for f in rows[0]["all_frames"]] == [5, 9] and rows[0]["origin_frame"]["class_name"] == "K"
    assert rows[1]["is_trace"] is False and rows[1]["origin_frame"] is None


def test_scans_and_slices(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "X.java").write_text("l1\r\nl2\nl3")
    (tmp_path / "Y.java").write_bytes(b"\xff\xfe")
    found = files.scan_sources(spark, str(tmp_path), "*.java").collect()
    assert [r["content"] for r in found] == [None, "l1\r\nl2\nl3"]
    row = spark.createDataFrame([("l1\r\nl2\nl3", 2, 3)], "c string, a int, b int").select(S.line_slice("c", "a", "b").alias("s"), S.marked_slice("c", "a", "b", "b").alias("m")).first()
    assert row["s"] == "l2\nl3" and row["m"] == "    l2\n>>> l3"
    (tmp_path / "manual_1.md").write_text("old")
    assert files.latest_manual(spark, str(tmp_path)).first()["content"] == "old"
    assert files.procedure_cache("{broken") == {} and files.procedure_cache('{"a": {}}') == {"a": {}}


MAPPERS = {
    "ok.xml": "\ufeff<?xml version='1.0' encoding='EUC-KR'?>\r\n<!DOCTYPE mapper PUBLIC '-//x//' 'http://nowhere/x.dtd'>\r\n<mapper namespace='a.B'>\r\n<!-- <select id='no'>x</select> -->\r\n<SELECT id='가' note=\"a > 'b'\"\r\n>\r\n 조회 &lt; <if test=\"a &gt; 1\">x</if>\r\n</SELECT><sql id='part'>y</sql><update id='self'/><insert id='i'><selectKey>z</selectKey>v</insert></mapper>",
    "comment.xml": "<mapper namespace='c'><delete id='d'>a <!-- <select id='no'>n</select> --> b</delete></mapper>",
    "none.xml": "<mapper/>",
    "open.xml": "<mapper namespace='o'><select id='a'>x</select>",
    "twice.xml": "<mapper><select id='a' id='b'>x</select></mapper>",
    "two.xml": "<mapper/><mapper/>",
    "text.xml": "hello",
    "empty.xml": "",
    "null.xml": None,
}


def test_mapper_files_of_any_kind(spark):
    files = spark.createDataFrame(list(MAPPERS.items()), "path string, content string").repartition(3)
    rows = [(r["file_path"], r["namespace"], r["sql_id"], r["sql_type"], r["start_line"], r["end_line"], r["sql_text"]) for r in mapper_xml.parse_mappers(files).orderBy("file_path", "start_line", "sql_id").collect()]
    assert rows == [
        ("comment.xml", "c", "d", "delete", 1, 1, "a <!-- <select id='no'>n</select> --> b"),
        ("ok.xml", "a.B", "가", "select", 5, 8, '조회 < <if test="a > 1">x</if>'),
        ("ok.xml", "a.B", "i", "insert", 8, 8, "<selectKey>z</selectKey>v"),
    ]
    failed = {r["path"]: r["error"] for r in mapper_xml.failed_mappers(files).collect()}
    assert set(failed) == {"open.xml", "twice.xml", "two.xml", "text.xml", "empty.xml", "null.xml"} and "line 1" in failed["open.xml"] and all(failed.values())
    assert mapper_xml.failed_mappers(files.limit(0)).collect() == []


def test_a_large_mapper_file_takes_linear_time():
    import time

    body = "".join(f"<select id='s{k}'>\nSELECT {k} FROM TB_A\n</select>\n" for k in range(30_000))
    began = time.process_time()
    _, found, error = mapper_xml.read_mapper("x", f"<mapper namespace='n'>\n{body}</mapper>")
    assert error is None and len(found) == 30_000 and found[-1]["end_line"] == 1 + 3 * 30_000 and time.process_time() - began < 10


def test_few_files_are_parsed_at_once(spark, monkeypatch):
    files = spark.createDataFrame([(f"C{i}.java", f"class C{i} {{ void f() {{ }} }}") for i in range(7)], "path string, content string").coalesce(1)
    assert java_source.FILES < 1000
    monkeypatch.setattr(java_source, "FILES", 3)
    assert sorted(r["class_name"] for r in java_source.parse_java(files).collect()) == [f"C{i}" for i in range(7)]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the driver's tables")
def test_a_graph_is_built_from_files_that_are_parsed_once(spark):
    from quarryflow.plans import extraction

    for part in extraction._graph(spark, "/root/testdata/sf0.001"):
        plan = part._jdf.queryExecution().optimizedPlan().toString()
        assert "MapInPandas" not in plan and "MapInArrow" not in plan
