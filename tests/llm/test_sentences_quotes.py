import pytest

from tidewell.llm import sentences as S


@pytest.mark.parametrize("left, right", ["“”", "«»", "()"])
def test_a_sentence_includes_a_long_quotation(spark, left, right):
    inner = "It broke again and nobody knew why. " * 60
    text = f"Our team wrote {left}{inner.strip(' .')}{right} on the board. It works."
    got = S.sentences(spark.createDataFrame([(1, text, "en")], "doc_id long, text string, lang string")).orderBy("sentence_no").collect()
    assert [text[r.start_pos : r.end_pos] for r in got] == [text[: -len(" It works.")], "It works."]


def test_straight_quotes_far_apart_are_no_pair():
    assert S._spans('5" ' + "x" * 2000 + ' 7"', 0, 2006) == [] and S._spans('say "no" now', 0, 12) == [(4, 7)]
