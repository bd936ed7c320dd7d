import os

import pytest

from tidewell.api import Engine, main
from tidewell.operators.models import completions, graded_batches, parsed, rubric_grades, two_pass_grades
from tidewell.operators.systems import glued_texts
from tidewell.plans.feeds import graded_batches as registered_batches
from tidewell.sources import sinks
from tidewell.streaming import jobs

DATA = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@needs_tables
def test_engine(spark, tmp_path):
    e = Engine(spark, DATA, str(tmp_path / "state"))
    assert e.health()["ok"] and not Engine(spark, "/nowhere").health()["ok"]
    listed = [r.sent_at for r in e.messages(since="2000", min_quality=3, limit=20).collect()]
    assert len(listed) == 20 and listed == sorted(listed, reverse=True)
    with pytest.raises(ValueError):
        e.messages(limit=0)
    assert e.item(-5) is None and e.item(e._table("documents", "doc_id").first().doc_id)
    name = e.topics().orderBy("canonical").first().canonical
    assert e.topic(name)["items"] and e.topic("no such topic at all")["items"] == []
    first = e.pending().first()
    pasted = spark.createDataFrame([(first.link_id.lower(), "A head\nand more"), ("LNK-000000", "x"), (first.link_id, " ")], "link_id string, content string")
    assert [(r.url, r.title) for r in e.paste(pasted, 1).collect()] == [(first.url, "A head")]
    assert {r.outcome for r in e.skip([first.link_id, "LNK-000000"], 2).collect()} <= {"skipped", "conflict", "not_found"}
    raw = spark.createDataFrame([(1, "because 3 links http://a.test", "x", False), (2, " ", "x", False), (3, "note", "x", True)], "entry_id long, text string, received_at string, skip_grading boolean")
    assert e.ingest(raw, rubric_grades, 7) == e.ingest(raw, rubric_grades, 7) == {"received": 3, "refused": 1, "graded": 2, "stored": 2}
    assert e.job(7)["stored"] == 2 and e.job(8) is None and e.metrics().first().jobs == 1
    assert main(["x"]) == 2


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    path = str(tmp_path)
    sinks.append_section(df, f"{path}/sections", "one")
    with pytest.raises(Exception, match="(?i)exists"):
        sinks.append_section(df, f"{path}/sections", "one")
    sinks.write_checked(df, f"{path}/checked", "k")
    assert sinks.read_checked(spark, f"{path}/checked", "k").count() == 2
    df.where("k = 1").write.mode("append").parquet(f"{path}/checked/rows")
    with pytest.raises(ValueError):
        sinks.read_checked(spark, f"{path}/checked", "k")
    built = []
    for _ in range(2):
        assert sinks.resumed(spark, f"{path}/stage", lambda: built.append(1) or df).count() == 2
    assert built == [1]
    with sinks.Lock(spark, f"{path}/lock"):
        with pytest.raises(RuntimeError):
            sinks.Lock(spark, f"{path}/lock").__enter__()
    with sinks.Lock(spark, f"{path}/lock"):
        pass
    sinks.publish(df, f"{path}/queue")
    sinks.publish(df.where("k = 1"), f"{path}/queue")
    assert sorted(r.value for r in spark.read.text(f"{path}/queue").collect()) == ['{"k":1,"v":"a"}', '{"k":1,"v":"a"}', '{"k":2}']
    told = sinks.report("R", {"S": df.orderBy("k")}, rows=1)
    assert told == "# R\n\n## S\n\n| k | v |\n|---|---|\n| 1 | a |\n\n(1 more rows)\n"


def test_bodies_and_start(spark, tmp_path):
    rows = jobs.validated(jobs.decoded(spark.createDataFrame([('{"entry_id": 1, "job_type": "query", "text": "x"}',), ("no json",), (None,)], "value string"))).collect()
    assert sorted((r.entry_id or 0, r.error or "ok") for r in rows) == [(0, "no entry_id"), (0, "no entry_id"), (1, "ok")]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "old.json").write_text('{"entry_id": 1, "job_type": "start"}\n')
    os.utime(tmp_path / "in" / "old.json", (1_600_000_000, 1_600_000_000))
    for latest, n in ((True, 0), (False, 1)):
        q = jobs.read_jobs(spark, str(tmp_path / "in"), latest=latest).writeStream.format("memory").queryName(f"start_{latest}").trigger(availableNow=True).start()
        q.awaitTermination()
        assert spark.table(f"start_{latest}").count() == n


def test_model_calls(spark):
    df = spark.createDataFrame([("a", "x"), ("b", " "), ("c", None)], "key string, prompt string")
    got = {r.key: r.reply for r in completions(df, lambda ps: [p.upper() for p in ps]).collect()}
    assert got == {"a": "X", "b": None, "c": None}
    assert parsed('```json\n[[{"quality": 2}], [{"quality": 3}]]\n```') == [{"quality": 2}, {"quality": 3}] and parsed("nothing") == []
    asked = spark.createDataFrame([("a", "p", 2)], "key string, prompt string, n int")
    with pytest.raises(Exception, match="instead of 2 after 3 attempts"):
        graded_batches(asked, lambda ps: ['[{"quality": 1}]']).collect()


def test_two_passes(spark):
    m = spark.createDataFrame([(1, "because of 7 " + "x" * 20), (2, "hm"), (3, ("word " * 1500) + "see http://a.test because 1")], "entry_id long, text string")
    up = lambda df: df.selectExpr("entry_id", "4 as quality", "1.0d as confidence", "'insight' as category")
    got = {r.entry_id: (r.first_quality, r.quality, r.n_pieces) for r in two_pass_grades(m, rubric_grades, up).collect()}
    assert got == {1: (3, 4, 1), 2: (1, 1, 1), 3: (5, 5, 2)}


@needs_tables
def test_every_batch_has_as_many_grades_as_messages(spark):
    got = registered_batches(spark, DATA).agg({"n": "sum"}).first()[0]
    assert got == spark.read.parquet(f"{DATA}/messages.parquet").where("text is not null").select("msg_id").distinct().count()


def test_glued_texts_keep_to_the_budget(spark):
    m = spark.createDataFrame([(1, "a b c"), (2, "a b c"), (3, " ".join("w" * 1 for _ in range(10)))], "doc long, text string")
    held = spark.createDataFrame([(1, 9, "x y z"), (1, 5, "p q"), (2, 5, "p q r s t u"), (3, 1, "z")], "doc long, link long, link_text string")
    got = {r.doc: (r.full_text, r.trimmed_text, r.links_trimmed, r.links_dropped) for r in glued_texts(m, held, 8).collect()}
    assert got[1] == ("a b c p q x y z", "a b c p q x", 1, 0)
    assert got[2] == ("a b c p q r s t u", "a b c p q r s", 1, 0)
    assert got[3][2:] == (0, 1)
