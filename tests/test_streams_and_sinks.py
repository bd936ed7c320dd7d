import json

from tidewell.operators.deliveries import DeliveryStore
from tidewell.sources import files
from tidewell.sources.sinks import KeyedTable, append_once
from tidewell.streaming import jobs as J


def write(path, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(json.dumps(r) for r in rows))


def job(i, kind="query", text="hello", job_id=None):
    return {"entry_id": i, "job_id": job_id, "telegram_update_id": None, "job_type": kind, "chat_id": 1, "text": text, "received_at": None}


def test_router_resumes_from_its_checkpoint(spark, tmp_path):
    src, out, mark = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "mark")
    write(src / "a.json", [job(1), job(2, "nonsense"), job(None)])
    J.route(J.read_jobs(spark, str(src)), out, mark).awaitTermination()
    write(src / "b.json", [job(3, "ingest"), job(4, text=" ")])
    J.route(J.read_jobs(spark, str(src)), out, mark).awaitTermination()
    assert sorted(r.entry_id for r in spark.read.parquet(f"{out}/jobs").collect()) == [1, 3]
    assert sorted(str(r.error) for r in spark.read.parquet(f"{out}/dead_letters").collect()) == ["empty text", "no entry_id", "unknown type"]


def test_streamed_deduplication(spark, tmp_path):
    src = tmp_path / "in"
    write(src / "a.json", [job(1, job_id="5"), job(2, job_id="6")])
    write(src / "b.json", [job(3, job_id=" 05 "), job(4, job_id="9")])
    store = DeliveryStore(spark, str(tmp_path / "store"), 4)
    J.deduplicate(J.read_jobs(spark, str(src)), store, str(tmp_path / "mark")).awaitTermination()
    assert sorted(r.entry_id for r in J.first_entries(store).collect()) == [1, 2, 4]


def test_keyed_table_is_idempotent(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path / "t"), "k", "seq")
    assert t.read() is None
    a = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y"), (None, 1, "z")], "k string, seq int, v string")
    t.merge(a)
    t.merge(a)
    t.merge(spark.createDataFrame([("a", 2, "new"), ("b", 0, "old")], "k string, seq int, v string"))
    assert sorted((r.k, r.v) for r in t.read().collect()) == [("a", "new"), ("b", "y")] and t.version() == 3


def test_append_once(spark, tmp_path):
    for _ in range(2):
        append_once(spark.range(3), str(tmp_path / "x"), 7)
    assert spark.read.parquet(str(tmp_path / "x")).count() == 3


def test_readers(spark, tmp_path):
    import zipfile

    import pytest

    (tmp_path / "chat.txt").write_text("1/2/23, 7:05 - A: b\r\nc")
    with zipfile.ZipFile(tmp_path / "c.zip", "w") as z:
        z.write(tmp_path / "chat.txt", "chat.txt")
    (tmp_path / "bad.zip").write_bytes(b"no archive")
    want = [(0, "1/2/23, 7:05 - A: b"), (1, "c")]
    assert [(r.line_no, r.line) for r in files.export_lines(spark, str(tmp_path / "chat.txt")).orderBy("line_no").collect()] == want
    assert [(r.line_no, r.line) for r in files.zipped_export_lines(spark, str(tmp_path / "*.zip")).orderBy("line_no").collect()] == want
    (tmp_path / "q.csv").write_text("query_id,candidate_id,relevance,answer_bearing\n1,a,3,1\n1,b,,0\n")
    assert [(r.candidate_id, r.relevance) for r in files.judgments(spark, str(tmp_path / "q.csv")).collect()] == [("a", 3)]
    (tmp_path / "r.csv").write_text("query_id,candidate_id,relevance,answer_bearing\n1,a,7,1\n")
    with pytest.raises(Exception, match="bad grade"):
        files.judgments(spark, str(tmp_path / "r.csv")).collect()
