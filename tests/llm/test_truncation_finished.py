from tidewell.llm import truncation as T

ASK = "ask_id long, url string, partial_text string, block_reason string"
LINK = "link_id long, url string, raw_text string"


def cut(spark, asked):
    return {r.row_id for r in T.cut_values(T.link_values(spark.createDataFrame([], LINK), spark.createDataFrame(asked, ASK))).where("cut").collect()}


def test_a_long_finished_value_is_cut_where_a_longer_copy_goes_on(spark):
    whole = "The harvest feed marks the first rose of a day as seen, version 2. " * 3
    asked = [(1, "https://a.test/x", whole.strip(), None), (2, "https://b.test/x", whole + "Nothing else was said about it.", None)]
    # a stock sentence opens other texts too
    asked += [(3, "https://a.test/y", "We will move on to the next one.", None), (4, "https://b.test/y", "We will move on to the next one. It is late.", None)]
    assert cut(spark, asked) == {1}


def test_a_finished_value_at_the_limit_of_its_host_is_cut(spark):
    at = lambda i, n, end: f"{i:03d} some words that fill the line".ljust(n - len(end), "x")[: n - len(end)] + end
    asked = [(i, "https://a.test/x", at(i, 200, "wor"), None) for i in range(12)] + [(50, "https://a.test/x", at(50, 200, "d."), None), (51, "https://a.test/x", at(51, 190, "d."), None), (52, "https://b.test/x", at(52, 200, "d."), None)]
    # a page that a host repeats, and pages of one form, are whole
    asked += [(100 + i, "https://c.test/x", at(7, 150, "d."), None) for i in range(20)] + [(200 + i, "https://d.test/x", at(i, 120, "d."), None) for i in range(20)]
    got = cut(spark, asked)
    assert 50 in got and not got & {51, 52, *range(100, 120), *range(200, 220)}
