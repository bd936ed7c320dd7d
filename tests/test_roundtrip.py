import __spark_entry__ as entry


def test_stamps_of_every_readable_form_come_back(spark, rows, tmp_path):
    stamps = ["2023-05-01T10:20:30", "2023-05-01T10:20:30+02:00", "2023-05-01T10:20:30.250Z", "1672624075", "1/5/23, 2:05 pm", "7 février 2024 à 20:23", "no stamp", None]
    data = [(i, "s", i, x, f"first {i}\n\nsecond", False) for i, x in enumerate(stamps)] + [(9, "s", 9, stamps[0], None, False)]
    spark.createDataFrame(data + data[:1], "msg_id long, source_id string, pos long, datetime_iso string, text string, is_media boolean").write.parquet(f"{tmp_path}/messages.parquet")
    spark.createDataFrame([("s", "Europe/Berlin")], "source_id string, tz_name string").write.parquet(f"{tmp_path}/ingestion_sources.parquet")
    want = ["2023-05-01 08:20:30", "2023-05-01 08:20:30", "2023-05-01 10:20:30", "2023-01-02 01:47:55", "2023-05-01 12:05:00", "2024-02-07 19:23:00"]
    got = rows(entry.queries()["chat_roundtrip_all"](spark, str(tmp_path)), "source_id", "pos", "sent_at", "text", "is_media")
    assert got == [("s", i, x, f"first {i}\nsecond", False) for i, x in enumerate(want)]
