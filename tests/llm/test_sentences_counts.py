from tidewell.llm import sentences as S


def test_rare_counts_decide_however_many_there_are(spark):
    names = ["Valen", "Okoro", "Lind", "Brandt", "Sato"]
    docs = [(i, f"Our team met Xq. {names[i % 5]} by the lake today. The {w} sorts the old notes. It works well.", "en") for i, w in enumerate(["worker", "job", "plugin", "reader", "page"] * 8)]
    text = "We saw Xq. Brandt in the hall. It was late."
    got = S.sentences(spark.createDataFrame([*docs, (99, text, "en")], "doc_id long, text string, lang string")).where("doc_id = 99").orderBy("sentence_no").collect()
    assert [text[r.start_pos : r.end_pos] for r in got] == ["We saw Xq. Brandt in the hall.", "It was late."]


def test_a_long_abbreviation_is_learnt(spark):
    docs = [(i, f"Das ist die stellvertr. Leitung und das Haus der Nummer {i}. Die Notiz ist alt und die Seite ist neu.", "de") for i in range(3000)]
    got = S.sentences(spark.createDataFrame(docs, "doc_id long, text string, lang string")).groupBy("doc_id").count().where("count <> 2").count()
    assert got == 0
