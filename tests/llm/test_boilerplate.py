import itertools
import random

import pandas as pd

from tidewell.llm import boilerplate as B

SCHEMA = "link_id long, url string, title string, raw_text string, host int, path string"


def test_alignment_is_a_longest_common_subsequence():
    def length(a, b):
        d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                d[i + 1][j + 1] = d[i][j] + 1 if a[i] == b[j] else max(d[i][j + 1], d[i + 1][j])
        return d[-1][-1]

    rng = random.Random(1)
    for _ in range(400):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(12))] for _ in range(2))
        pairs = B.aligned(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and len(pairs) == length(a, b)
        assert all(p[0] > q[0] and p[1] > q[1] for p, q in zip(pairs, pairs[1:]))


def page(i, words):
    body = " ".join(words) + "."
    return f"Unser Laden am Fluss\nKontaktbogen hier entlang\n\n# Kapitel {i}\n{body}\n{'- ein Punkt' if i % 4 == 0 else f'- Punkt {words[0]}'}\nWeitere Worte {i}: {body}\n© 2024 a.test. Alle Rechte vorbehalten\r\nFuss des Hauses"


def test_shared_lines_go_and_the_body_stays(spark):
    rng = random.Random(2)
    names = ["".join(w) for w in itertools.product("abcdefg", "aeiou", "mnrst", "ek")]
    pages = [(i, f"https://a.test/p/{i:03d}?x=1", None, page(i, rng.sample(names, 9)), 1, "clash") for i in range(40)]
    pages += [pages[3], (100, None, None, None, 1, ""), (101, "https://a.test/z", None, "", 1, ""), (102, "https://b.test/one", "Lone", "Lone\nOnly page of its host.\nTags: a, b", 1, ""), (None, "https://a.test/q", None, "x", 1, "")]
    got = {}
    for r in B.boilerplate_lines(spark.createDataFrame(pages, SCHEMA)).collect():
        got.setdefault(r.link_id, []).append(r.line_no)
    assert all(sorted(got[i]) == [0, 1, 7, 8] for i in range(40))
    assert got[102] == [2] and set(got) == {*range(40), 102}
    assert B.boilerplate_lines(spark.createDataFrame([], SCHEMA)).count() == 0


def test_forms():
    other = ["Home | Docs | About", "[A](/a) [B](/b)", "Startseite > Thema", "Last updated: 3 May 2024", "5 min read · 3 Sep 2022", "→ Results 0.5.6", "Why we moved (31)", "Mehr zum Thema", "Get our weekly digest in your inbox", "Tags: a, b", "Seite 2 von 9", "Nach oben"]
    body = ["# Installation", "| a | 1 | 2 |", "pip install thing==1.2"]
    unsure = ["- fewer retries", "The session cookie expires after ten minutes.", "Next steps", "Sign in with a local account first."]
    assert [B.written_form(x) for x in other] == [B.OTHER] * len(other)
    assert [B.written_form(x) for x in body] == [B.BODY] * len(body)
    assert [B.written_form(x) for x in unsure] == [B.UNSURE] * len(unsure)


def test_very_long_page_and_empty_batches():
    frame = pd.DataFrame({"link_id": [1], "host": ["h"], "title": [None], "raw_text": ["a line of words.\n" * 20_000]})
    assert sum(len(x) for x in B._differences(iter([frame]))) == 0
    assert sum(len(x) for x in B._differences(iter([]))) == 0
