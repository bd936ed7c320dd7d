import __spark_entry__ as entry

from tidewell.operators import links as L


def test_links_with_content_that_no_index_has(spark, rows):
    data = [("a", "scraped", " ", "what", None), ("a", "scraped", "s", None, None), ("b", None, "s", None, None), ("c", "blocked", "s", None, None), ("d", "scraped", "\u00a0\n", " ", None), ("e", "", None, None, "p"), ("f", "scraped", "s", None, None)]
    scraped = spark.createDataFrame(data, "url string, status string, summary string, what_it_is string, problem_solved string")
    indexed = spark.createDataFrame([("f",), (None,)], "url string")
    assert rows(L.restorable_links(scraped, indexed)) == [("a",), ("b",), ("e",)]


def test_both_halves_are_restored(spark, rows, tmp_path):
    def write(name, data, schema):
        spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{name}.parquet")

    write("grades", [(1, 1, 5), (2, 2, 4), (3, 3, 3)], "grade_id long, msg_id long, quality int")
    write("documents", [(2, "message", None), (8, "link", "u2")], "doc_id long, candidate_type string, url string")
    fields = ("final_url", "title", "source", "raw_text", "what_it_is", "problem_solved", "how_useful", "link_intent", "scraped_at", "sent_at")
    links = [(i, f"u{i}", "scraped", "said", *[None] * len(fields), None, None, (1,)) for i in (1, 2)]
    write("scraped_links", links, "link_id long, url string, status string, summary string, " + ", ".join(f"{f} string" for f in fields) + ", topics array<string>, entities array<string>, message_context struct<msg_id: long>")
    assert rows(entry.queries()["restore_all"](spark, str(tmp_path)), "kind", "item") == [("link", "u1"), ("message", "1")]
