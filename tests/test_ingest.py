import hashlib
import json
import uuid

from pyspark.sql import functions as F

from tidewell.functions import text as T
from tidewell.operators import ingest as I
from tidewell.operators.ordered import last_marked, row_numbers


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "x string").select(expression(F.col("x")).alias("y")).first().y


def test_ids_equal_the_standard_library(spark):
    for name in ("msg-2024-01-01T00:00:00-hé 👍", "link-https://example.test/a?b=1", ""):
        assert one(spark, name, T.uuid5) == str(uuid.uuid5(uuid.NAMESPACE_URL, name))
    for text in ('a"b\\c\n\td', "ñ 👍", "\x01\x1f"):
        assert one(spark, text, T.json_string) == json.dumps(text, ensure_ascii=False)


def test_text_functions(spark):
    assert one(spark, " Vector  Searches-2 ", T.topic_key) == "vector searche 2"
    assert one(spark, "see (https://a.test/x). and https://a.test/x, https://b.test/y!", T.links_in) == ["https://a.test/x", "https://b.test/y"]
    assert one(spark, "https://www.a.test/blog/2024/my-page/part", T.url_title) == "a.test / my-page / part"
    assert one(spark, "+44 7700 900123", T.masked_digits) == "+## #### ####23"
    assert one(spark, "x" * 400, T.snippet) == "x" * 299 + "…"
    assert one(spark, "https://youtu.be/AbC_1-2?t=3", T.video_id) == "AbC_1-2"
    assert one(spark, "The café's 2 tests", T.bm25_tokens) == ["caf", "s", "2", "tests"]


def test_heuristic_reasons(spark):
    data = [("", False), (None, True), ("<Media omitted>", True), ("caption <Media omitted>", True), ("👍!!", False), (" Thanks ", False), ("ok?", False), ("got it", False), ("nice article", False), (" ", False)]
    df = spark.createDataFrame([(i, *d) for i, d in enumerate(data)], "i int, text string, is_media boolean")
    got = [r.reason for r in I.with_reasons(df).orderBy("i").collect()]
    assert got == ["empty", "empty", "media_only_no_caption", None, "no_alphanumeric", "short_acknowledgment", None, "short_acknowledgment", None, "empty"]


def test_parser_rules(spark):
    lines = ["continuation without head", "1/2/23, 7:05 pm - A B: first", "  ", "second line", "3/2/23, 08:00 - group created", "still the event", "04/02/2023, 23:10:11 - C: has: colon", "5/2/23, 9:00 am - D: <Media omitted>"]
    df = spark.createDataFrame([("f", i, x) for i, x in enumerate(lines)], "source_id string, line_no long, line string")
    got = [(r.line_no, str(r.ts), r.text, r.is_media) for r in I.parse_export(df).orderBy("line_no").collect()]
    assert got == [(1, "2023-02-01 19:05:00", "first\nsecond line", False), (6, "2023-02-04 23:10:11", "has: colon", False), (7, "2023-02-05 09:00:00", "<Media omitted>", True)]


def test_message_identity(spark):
    df = spark.createDataFrame([(1, "s", 1, "d", "a\r\nb"), (2, "s", 2, "d", "a\nb "), (2, "s", 2, "d", "a\nb "), (3, "s", 3, "d", None)], "msg_id long, source_id string, pos long, datetime_iso string, text string")
    want = {i + 1: hashlib.sha256(json.dumps(["s", "d", "a\nb", i + 1], ensure_ascii=False).encode()).hexdigest() for i in range(2)}
    assert {r.msg_id: r.message_id for r in I.message_identities(df).collect()} == want


def test_packing_follows_the_sequential_rule(spark):
    texts = [4 * n for n in (3, 9, 5, 20, 1, 1, 1, 1, 1, 1, 2)]
    df = spark.createDataFrame([("s", i, i, "x" * n) for i, n in enumerate(texts)], "source_id string, pos long, msg_id long, text string")
    got = [r.batch_no for r in I.packed_batches(df, budget=15, most=5).orderBy("msg_id").collect()]
    assert got == [0, 0, 1, 2, 3, 3, 3, 3, 3, 4, 4]


def test_pieces_cover_the_text(spark):
    text = " ".join(f"word{i}" for i in range(500))
    df = spark.createDataFrame([(1, text), (2, ""), (3, None), (4, "x" * 2500)], "k long, t string")
    got = I.text_pieces(df, "k", "t", 1000).orderBy("k", "piece_no").collect()
    assert " ".join(r.piece for r in got if r.k == 1) == text
    assert [len(r.piece) for r in got if r.k == 4] == [1000, 1000, 500]


def test_row_numbers_and_marks_across_partitions(spark):
    data = [("hot" if i % 3 else f"g{i % 7}", i, i % 50 == 1) for i in range(3000)]
    df = spark.createDataFrame(data, "g string, o long, m boolean").repartition(7)
    want, seen, last, mark = {}, {}, {}, {}
    for g, o, m in sorted(data):
        seen[g] = seen.get(g, 0) + 1
        want[o] = seen[g]
        last[g] = o if m else last.get(g)
        mark[o] = last[g]
    assert {r.o: r.rn for r in row_numbers(df, ["g"], ["o"]).collect()} == want
    assert {r.o: r.at for r in last_marked(df, ["g"], "o", "m", "at").collect()} == mark
