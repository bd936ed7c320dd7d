import random

import pytest

from tidewell.llm import sentences as S

SUBJECTS = ["The worker", "A small job", "My notebook", "Our team", "This plugin", "Every reader"]
VERBS = ["sorts", "drops", "counts", "keeps", "moves", "reads"]
OBJECTS = ["the old notes", "half of the links", "some drafts", "all pages", "every reply"]


CASES = [
    ["The worker sorts some drafts.", "My notebook keeps all pages."],
    ["Our team asked Dr. Valen about approx. 12 pages, e.g. the long ones.", "A small job counts 3.14 pages."],
    ['"It broke. Again." was all the old notes said.', "This plugin reads every reply!"],
    ["See https://a.test/x.html?v=1.2 first.", "The worker moves on."],
    ["The worker drops all pages. 👀", "Our team reads some drafts."],
    ["What now?", "the reader waits in lower case.", "My notebook counts."],
]
BLOCKS = "# Heading here\nThe worker sorts\nsome drafts.\n\n- one item\n- another. with two parts\n\nlast line without stop"
SCRIPTS = [("今日は晴れ。明日は雨！", "ja", ["今日は晴れ。", "明日は雨！"]), ("यह ठीक है। वह नहीं है।", "hi", ["यह ठीक है।", "वह नहीं है।"]), ("Λειτουργεί τώρα; Ναι.", "el", ["Λειτουργεί τώρα;", "Ναι."])]


@pytest.fixture(scope="module")
def split(spark):
    """Sentences of the cases, told by the statistics of 900 other documents."""
    rng = random.Random(8)
    plain = lambda: f"{rng.choice(SUBJECTS)} {rng.choice(VERBS)} {rng.choice(OBJECTS)}"
    docs = []
    for i in range(900):
        docs.append((i, " ".join([plain() + ".", f"Dr. Valen {rng.choice(VERBS)} approx. {rng.randrange(99)} pages, e.g. the long ones.", plain() + rng.choice("!?"), f'"It broke. Again." was all {rng.choice(OBJECTS)} said.', plain() + "."]), "en"))
    docs += [(2000, None, "en"), (2001, "  ", None), (2002, "", "xx")]
    asked = [(" ".join(c), "en") for c in CASES] + [(BLOCKS, "en")] + [x[:2] for x in SCRIPTS]
    docs += [(3000 + i, *x) for i, x in enumerate(asked)]
    texts = {d[0]: d[1] for d in docs}
    out = {}
    for r in S.sentences(spark.createDataFrame(docs, "doc_id long, text string, lang string")).where("doc_id >= 3000").orderBy("doc_id", "sentence_no").collect():
        out.setdefault(texts[r.doc_id], []).append(texts[r.doc_id][r.start_pos : r.end_pos])
    return out


@pytest.mark.parametrize("want", CASES)
def test_sentences(split, want):
    assert split[" ".join(want)] == want


def test_blocks(split):
    assert split[BLOCKS] == ["# Heading here", "The worker sorts\nsome drafts.", "- one item", "- another. with two parts", "last line without stop"]


def test_scripts(split):
    for text, _, want in SCRIPTS:
        assert split[text] == want
    assert S.language("это русский текст", "en") == "ru" and S.language("der Hund und die Katze", None) == "de" and S.language("x", "fr_FR") == "fr"


def test_statistics():
    """Starters, collocations and abbreviations from plain counts."""
    upper, lower = S._hashed("The"), S._hashed("of")
    model = S.Model([("en", "s", *upper, 90), ("en", "s", *S._hashed("Our"), 10), ("en", "m", *lower, 80), ("en", "m", *upper, 1), ("en", "m", *S._hashed("notes"), 19)], {"en": 100}, {"en": 900})
    assert model.starter("en", upper) > S.SURE > -S.SURE > model.starter("en", lower)
    name = S._hashed("Valen")
    assert model._own("en", name, 30, 40) > 0.5 and model._own("en", lower, 30, 40) == 0.0
    assert S.Model.abbreviation(40, 0, 100, 1000, "dr") == 1.0 and S.Model.abbreviation(40, 60, 100, 1000, "dog") == 0.0
    assert S.Model.abbreviation(400, 0, 1000, 10_000, "stellvert") == 0.0 and S.Model.abbreviation(4000, 0, 4100, 10**7, "stellvert") == 1.0
    assert S.log_likelihood(5, 10, 50, 100) == pytest.approx(0, abs=1e-9)


def test_operator(spark):
    docs = [(1, "One here. Two there.", "en", 5), (1, "One here. Two there.", "en", 5), (2, None, None, 5), (3, " \n ", "en", 5), (4, "🙂", None, 5), (None, "x.", "en", 5), (5, "word " * 60_000, "en", 5)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, end_pos int")
    got = sorted((r.doc_id, r.start_pos, r.end_pos) for r in S.sentences(df).collect())
    assert got == [(1, 0, 9), (1, 10, 20), (4, 0, 1), (5, 0, 299_999)]
    assert S.sentences(df.limit(0)).count() == 0
