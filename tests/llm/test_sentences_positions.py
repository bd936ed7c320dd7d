from collections import Counter

import pyarrow as pa

from tidewell.llm import sentences as S


def counted(text, lang):
    batch = pa.RecordBatch.from_pydict({"doc_id": [1], "text": [text], "lang": [lang]})
    return [r for b in S._scan(iter([batch])) for r in b.to_pylist()]


def test_every_token_of_a_script_without_spaces_counts():
    text = "今日は晴れPython言語「花」です"
    starts = [i for i in range(1, len(text)) if text[i - 1].isalnum() and not (text[i].isascii() and text[i].isalpha() and text[i - 1].isascii())]
    want = Counter(S._hashed(S.following(text, i, len(text))) for i in starts)
    assert Counter({(r["bucket"], r["shape"]): r["n"] for r in counted(text, "ja") if r["what"] == "m"}) == want


def test_words_before_other_marks_and_at_the_end_stand_without_period():
    words = Counter({r["key"]: r["n"] for r in counted('The dog, a "dog" and one more dog', "en") if r["what"] == "w"})
    assert words["dog"] == 3 and words["the"] == 1
    assert not [r for r in counted("It was late (etc.), so we met Dr. Valen.", "en") if r["what"] == "w" and r["key"] in ("etc", "dr", "valen")]


def test_a_long_word_before_a_period_is_read_whole():
    word = "donaudampfschifffahrtsgesellschaftskapitänsmützen" * 3
    text = f"Das ist {word}. Und so weiter."
    assert next(S.endings(text, 0, len(text), "de"))[1] == word


def test_a_sentence_includes_a_long_straight_quotation():
    inner = "It broke again and nobody knew why. " * 60
    text = f'Our team wrote "{inner.strip(" .")}" on the board. It works.'
    assert [e[0] for e in S.endings(text, 0, len(text), "en")] == [len(text) - len(" It works.")]
    wide = f'A 5" board and one of 7" came. {"It works. " * 200}He said "no. Never." then.'
    assert S._spans(wide, 0, len(wide)) == [(wide.index('"no'), wide.index('" then'))]


def test_thai_spaces_and_line_breaks_before_any_letter_are_looked_at():
    text = "มันทำงานแล้ว 12 คนมา \"ดีมาก\" ครับ"
    assert {e[0] for e in S.endings(text, 0, len(text), "th")} >= {text.index(" 12"), text.index(' "ดี'), text.index(" ครับ")}
    lines = "今日は晴れ\n明日は雨が降るでしょうと彼は言いました"
    assert [e[1] for e in S.endings(lines, 0, len(lines), "ja")] == ["L"]
