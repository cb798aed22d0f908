import threading

import pytest
from pyspark.sql import functions as F

from quarryflow.operators import context as C
from quarryflow.operators import relational as R
from quarryflow.plans import service
from quarryflow.sources import files, publish
from quarryflow.streaming.events import windowed_counts

from .library import tables
from .test_extraction import JAVA, XML


@pytest.fixture(scope="module")
def index(spark):
    java = spark.createDataFrame(list(JAVA.items()), "path string, content string")
    xml = spark.createDataFrame([("l.xml", XML)], "path string, content string")
    return service.build_index(java, xml, spark.createDataFrame([("CREATE TABLE TB_LOAN (A INT);",)], "content string"))


def test_question(index):
    c = service.ask_context(index, "LoanServiceImpl find loan")
    assert c.summary.startswith("처리 흐름: /loan/list.do") and c.text.startswith(c.summary) and not c.truncated
    assert {r["class_method"] for r in c.references} >= {"LoanServiceImpl.find", "LoanController.list", "LoanMapper.select"}
    small = service.ask_context(index, "LoanServiceImpl find loan", budget=len(c.summary) + 1)
    assert small.text == c.summary and small.references == [] and small.truncated


def test_many_questions_are_answered_as_one_is(index, spark):
    asked, budget = ["LoanServiceImpl find loan", "", "대출 mapper"], 450
    got = service.ask_contexts(index, spark.createDataFrame(list(enumerate(asked)), "q int, text string"), budget=budget).collect()
    assert sorted(r["q"] for r in got) == list(range(len(asked)))
    for r in got:
        one = service.ask_context(index, asked[r["q"]], budget=budget)
        assert (r["summary"], r["text"], r["truncated"]) == (one.summary, one.text, one.truncated)
        assert [x.asDict() for x in r["references"]] == one.references
    assert service.ask_contexts(index, spark.createDataFrame([], "q int, text string")).collect() == []


def test_a_block_is_kept_once_however_many_ask(index, spark):
    asked = spark.createDataFrame([(q, "LoanServiceImpl find loan") for q in range(6)], "q int, text string")
    packed, blocks, summaries = service.question_blocks(index, service.question_hits(index, asked))
    assert not {"code", "block", "summary"} & set(packed.columns) and summaries.count() == 6
    rows, texts = packed.collect(), blocks.collect()
    assert len(texts) == len({r["at"] for r in rows}) == len({r["at"] for r in texts}) and len(rows) == 6 * len(texts)
    assert {r["at"]: len(r["block"]) for r in texts} == {r["at"]: r["size"] for r in rows}


def test_equal_questions_are_worked_on_once(index, spark, monkeypatch):
    rows, write = [], service.Scratch.write

    def counted(self, df, name):
        out = write(self, df, name)
        rows[-1] += [(name, out.count())] if name not in ("hits", "groups") else []
        return out

    monkeypatch.setattr(service.Scratch, "write", counted)
    for n in (1, 5):
        hits = spark.createDataFrame([(q, r["id"], rank) for q in range(n) for rank, r in enumerate(index.nodes.where("node_type = 'IMPL_METHOD'").select("id").collect(), 1)], "q int, id string, rank int")
        rows.append([])
        assert service.question_packs(index, hits).groupBy("q").count().count() == n
    assert rows[0] == rows[1]


@pytest.mark.parametrize("budget", [450, 20])
def test_groups_of_many_pieces(index, spark, monkeypatch, budget):
    monkeypatch.setattr(C, "PIECE", 2)
    asked = spark.createDataFrame([(7, "LoanServiceImpl find loan"), (8, "LoanServiceImpl find loan")], "q int, text string")
    one = service.ask_context(index, "LoanServiceImpl find loan", budget=budget)
    for r in service.ask_contexts(index, asked, budget=budget).collect():
        assert (r["summary"], r["text"], r["truncated"]) == (one.summary, one.text, one.truncated)
    hits = service.question_hits(index, asked)
    brief = sorted(map(tuple, service.question_packs(index, hits, budget).collect()))
    whole = service.question_blocks(index, hits, budget)[0]
    assert brief == sorted(map(tuple, whole.select("q", "id", "tier", "kept", "used").collect())) and len(brief) > 4
    assert min(r[4] for r in brief) >= len(one.summary) and any(r[3] for r in brief) == bool(one.references)


def test_texts_beyond_the_budget_are_not_written(index, spark, monkeypatch):
    made, write = {}, service.Scratch.write

    def kept(self, df, name):
        made[name] = write(self, df, name)
        return made[name]

    monkeypatch.setattr(service.Scratch, "write", kept)
    service.ask_contexts(index, spark.createDataFrame([(1, "LoanServiceImpl find loan")], "q int, text string"), budget=100)
    rows = made["blocks"].select("size", "block", "code").collect()
    assert any(r["size"] > 100 for r in rows)
    assert all((r["block"] is None) == (r["code"] is None) == (r["size"] > 100) for r in rows)


def test_failure(index):
    log = "java.lang.RuntimeException: x\n\tat app.loan.LoanServiceImpl.find(LoanServiceImpl.java:{0})\n\tat q.R.s(R.java:1)"
    c = service.diagnose_context(index, log.format(9), "app.")
    assert ">>>         int[] a = {1, 2};" in c.text and c.warning is None and c.chain[0] == "/loan/list.do"
    assert "outside" in service.diagnose_context(index, log.format(99), "app.").warning
    assert service.diagnose_context(index, log.format(9), "nobody.").warning == "no frame of this system"
    assert service.diagnose_context(index, "hello", "app.").status == 400
    assert "nearest" in service.diagnose_context(index, log.format(9).replace(".find(", ".gone("), "app.").warning


def test_manual_and_stats(index):
    text = service.manual(index, lambda f: f"tables: {', '.join(f['tables'])}")
    assert "### list\n`/loan/list.do`\n\nDelegates to the service.\n\nLoanController.list → LoanServiceImpl.find → SQL 1건" in text and "## Appendix" in text and "| A | INT |" in text
    stats = {r["metric"]: r["value"] for r in service.index_stats(index).collect()}
    assert stats["chunks"] == 6 and stats["catalog_tables"] == 1


def test_list_page(spark):
    t = tables(spark)
    rows, page = service.list_page(t, R.book_list, R.book_count, page_index=2, page_size=2)
    assert [r["bookId"] for r in rows.collect()] == ["B2", "B3"]
    assert page.first().asDict() == {"total": 5, "page_index": 2, "page_size": 2, "total_pages": 3, "first_page": 1, "last_page": 3, "first_index": 2}


def test_stream_counts(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-01 00:10:00", "a"), ("2024-01-01 00:50:00", "a"), ("2024-01-01 01:10:00", "b")], "ts string, event_type string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = windowed_counts(stream).writeStream.outputMode("complete").format("memory").queryName("counted").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r["event_type"], r["cnt"]) for r in spark.table("counted").collect()) == [("a", 2), ("b", 1)]


def test_titles_and_saved_procedures(index, spark, tmp_path):
    cached = spark.createDataFrame([("/loan/list.do", "1. saved", "2026-01-01")], "url string, procedure string, generated_at string")
    text = service.manual(index, lambda f: "made", titles={"list": "Loans"}, cached=cached)
    assert "### Loans\n`/loan/list.do`\n\n1. saved" in text
    assert files.save_manual(spark, str(tmp_path), "old", "2026-01-01T09:00:00.5").endswith("manual_20260101T090000_5.md")
    files.save_manual(spark, str(tmp_path), text, "2026-01-02T09:00:00")
    assert files.latest_manual(spark, str(tmp_path)).first()["content"] == text
    files.save_procedures(spark, str(tmp_path / "cache.json"), {"/a": {"procedure": "가"}})
    assert files.procedure_cache((tmp_path / "cache.json").read_text()) == {"/a": {"procedure": "가"}} and files.procedure_cache("{") == {}


def test_a_stored_index_and_its_job(spark, tmp_path):
    java = spark.createDataFrame(list(JAVA.items()), "path string, content string")
    xml = spark.createDataFrame([("l.xml", XML)], "path string, content string")
    ddl = spark.createDataFrame([("CREATE TABLE TB_LOAN (A INT);",)], "content string")
    gate = threading.Event()
    job = service.IndexJob(lambda progress: gate.wait(60) and service.build_index(java, xml, ddl, folder=str(tmp_path), progress=progress))
    thread = job.start()
    with pytest.raises(RuntimeError, match="already running"):
        job.start()
    gate.set()
    thread.join(300)
    state = job.status()
    assert state["status"] == "done" and state["current"] == state["total"] and state["stats"]["chunks"] == 6
    again = service.load_index(spark, str(tmp_path))
    assert again.chunks.count() == 6 and service.ask_context(again, "LoanServiceImpl find loan").text == service.ask_context(job.index, "LoanServiceImpl find loan").text
    broken = service.IndexJob(lambda progress: 1 / 0)
    broken.start().join(60)
    assert broken.status()["status"] == "error" and "zero" in broken.status()["error"]


def test_an_index_is_published_whole(spark, tmp_path):
    java = spark.createDataFrame(list(JAVA.items()), "path string, content string")
    xml = spark.createDataFrame([("l.xml", XML)], "path string, content string")
    ddl = spark.createDataFrame([("CREATE TABLE TB_LOAN (A INT);",)], "content string")
    root = str(tmp_path / "index")
    with pytest.raises(FileNotFoundError):
        service.load_index(spark, root)
    service.build_index(java, xml, ddl, folder=root)
    first = publish.current(spark, root)
    held = service.load_index(spark, root)

    def dies(stage, done, total):
        if stage == "chunks":
            raise RuntimeError("killed")

    with pytest.raises(RuntimeError, match="killed"):
        service.build_index(java.limit(1), xml, ddl, folder=root, progress=dies)
    assert publish.current(spark, root) == first and service.load_index(spark, root).nodes.count() == held.nodes.count()
    service.build_index(java.limit(1), xml, ddl, folder=root)
    second = publish.current(spark, root)
    assert second != first and service.load_index(spark, root).classes.count() == 1
    assert held.nodes.count() > 3  # who has begun with the old version can go on
    assert publish.drop_old(spark, root, keep=1) == [first.split("/")[-1]] and publish.current(spark, root) == second
    into = service.load_index(spark, root).incoming.where("dst_id = 'TABLE::TB_LOAN'")
    assert "EqualTo(dst_id" in into._jdf.queryExecution().executedPlan().toString() and into.count() == into.distinct().count() > 0
    stored = [r["dst_id"] for r in spark.read.parquet(f"{second}/incoming").coalesce(1).collect()]
    assert len(stored) > 1
    assert not [p for p in (tmp_path / "index").iterdir() if p.name.startswith(".CURRENT") and not p.name.endswith(".crc")]
