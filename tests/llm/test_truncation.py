from tidewell.llm import truncation as T

ASK = "ask_id long, url string, partial_text string, block_reason string, text int"
LINK = "link_id long, url string, raw_text string, codes int"


def test_states():
    said = {"It ends here.": 0, "it ends 👀": 1, "see https://a.test/b": 1, "the other half of the": 2, "cut here... Read more": 3, "cut [truncated]": 3, "moiti\\u00": 3, "so it goes...": 4, "": 0, "word …": 3}
    assert {k: T.tail_of(k)[0] for k in said} == said
    assert T.tail_of("a\nb 12 c.d", "c.d")[1:] == ("b", "0", "HOST")


def values(spark, asked, scraped=()):
    return T.link_values(spark.createDataFrame(list(scraped), LINK), spark.createDataFrame(asked, ASK))


def test_cut_values(spark):
    whole = ["the cat sat on the wooden mat. and then it slept in the sun.", "we looked at the cat sat on the wooden mat. nice.", "it slept in the sun. all day."]
    asked = [(i, "https://a.test/x", t, "paywall: only the first 3 lines are free", 1) for i, t in enumerate(whole * 3)]
    asked += [
        (100, "https://b.test/x", "the cat sat on the woo", "paywall: only the fi", 1),
        (101, "https://b.test/x", "so the cat sat on the wooden mat", "paywall", 1),
        (102, "https://b.test/x", None, None, 1),
        (103, None, "  ", "", 1),
        (104, "https://b.test/x", "a text that was cut... Read more", "payw", 1),
        (104, "https://b.test/x", "a text that was cut... Read more", "payw", 1),
        (None, "https://b.test/x", "it slept in", "x", 1),
    ]
    judged = T.cut_values(values(spark, asked))
    assert sorted((r.row_id, r.field) for r in judged.where("cut").collect()) == [(100, "block_reason"), (100, "partial_text"), (104, "block_reason"), (104, "partial_text")]
    share = {r.host: (r.n_values, r.n_cut) for r in T.truncation_by_host(judged).collect()}
    assert share == {"a.test": (18, 0), "b.test": (6, 4)}


def test_fixed_widths_and_longer_copies(spark):
    asked = [(i, "https://a.test/x", (f"{i} " + "abc def ghi " * 60)[: 200 if i < 30 else 210 + i], None, 1) for i in range(60)]
    got = {r.row_id for r in T.cut_values(values(spark, asked)).where("cut").collect()}
    assert set(range(30)) <= got


def test_empty(spark):
    assert T.cut_values(values(spark, spark.createDataFrame([], ASK).collect())).count() == 0


def test_join_and_worker_counts_agree(spark, monkeypatch):
    texts = ["the cat sat on the wooden mat.\nand then it slept", "the cat sat on the woo", "then it slept in the sun...", "on the wooden bench"]
    asked = [(i, "https://a.test/x", t, None, 1) for i, t in enumerate(texts)]
    one = sorted(map(tuple, T.cut_values(values(spark, asked)).collect()))
    monkeypatch.setattr(T, "CONTEXTS", 0)
    assert sorted(map(tuple, T.cut_values(values(spark, asked)).collect())) == one


def test_both_ways_agree_on_other_white_space_and_digits(spark, monkeypatch):
    texts = ["we saw　the long road", "we saw　the lo", "on page ٤٢ of it.", "on page ٤", "we saw the lo", "b 12 cats ran off.\nb 7 cats ra"]
    asked = [(i, "https://a.test/x", t, None, 1) for i, t in enumerate(texts)]
    one = sorted(map(str, T.cut_values(values(spark, asked)).collect()))
    monkeypatch.setattr(T, "CONTEXTS", 0)
    assert sorted(map(str, T.cut_values(values(spark, asked)).collect())) == one


def test_many_values_with_one_header(spark):
    """A prefix that all share: cut values are found without comparing each with each."""
    head = "menu home about contact login search topics archive imprint " * 3
    whole = [(i, "https://a.test/x", head + f"story {i} tells of things that happened in town number {i} and nothing else of note at all.", None, 1) for i in range(300)]
    cut = [(1000 + i, "https://a.test/x", whole[i][2][: 210 + i % 40], None, 1) for i in range(40)]
    got = {r.row_id: r.evidence for r in T.cut_values(values(spark, whole + cut)).where("cut").collect()}
    assert {1000 + i for i in range(40)} == set(got) and set(got.values()) == {"longer copy"}
