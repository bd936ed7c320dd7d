import itertools

from tidewell.llm import spellings as S


def test_parts():
    assert S.parse("Dr. Maggie K. O'Dell-Smith")[0] == ["margaret", "o'dell", "smith"]
    assert S.parse("BrightFieldLabs")[0] == ["bright", "field", "labs"] and S.parse("brightfield.example")[0] == ["brightfield"]
    assert S.parse("The Bright Co., Inc.")[0] == ["bright", "company"]
    assert S.parse("  ") is None and S.parse("#vector_search")[0] == ["vector", "search"]


def test_one_edit_against_brute_force():
    def near(a):
        out = {a}
        for i in range(len(a) + 1):
            out |= {a[:i] + c + a[i:] for c in "ab"} | {a[:i] + c + a[i + 1 :] for c in "ab"} | {a[:i] + a[i + 1 :]}
            if i + 1 < len(a):
                out.add(a[:i] + a[i + 1] + a[i] + a[i + 2 :])
        return out

    words = ["".join(w) for n in range(5) for w in itertools.product("ab", repeat=n)]
    for a in words:
        close = near(a)
        for b in words:
            assert S.one_edit(a, b) == (b in close), (a, b)


def test_alignment():
    assert S.fits(["bright", "foods", "bros"], ["bright", "foods", "brothers"]) and S.fits(["bright", "mari"], ["bright", "maritime", "systems"])
    assert not S.fits(["bright", "data"], ["bright", "maritime", "systems"]) and not S.fits(["c", "m"], ["clara", "moor"])


GROUPS = [
    ["Clara Hohenfeld", "CLARA HOHENFELD", "Hohenfeld, Clara", "C. Hohenfeld", "Dr. Clara Hohenfeld", "@clarahohenfeld", "clara.hohenfeld", "chohenfeld", "Clara Hohenfled", "Clara B. Hohenfeld", "Clára Hohenfeld"],
    ["Robert Hohenfeld", "Bob Hohenfeld"],
    ["Bright Maritime Systems", "Bright Maritime Sys.", "BrightMaritimeSystems", "Bright Mari.", "The Bright Maritime Systems (HQ)", "Systems Bright Maritime", "Bright Maritime Systems GmbH"],
    ["Bright Foods Brothers", "Bright Foods Bros."],
    ["optical character recognition", "OCR", "#opticalcharacterrecognition"],
    ["vector search", "Vector-Search", "vectorsearch", "vector sesrch"],
    ["graph search"],
    ["graph store"],
]


def test_groups_and_pairs(spark):
    names = [(n,) for g in GROUPS for n in g] * 3 + [(None,), (" ",), ("J. Unknown",), ("Bright",)]
    df = spark.createDataFrame(names, "name string")
    got = {tuple(r) for r in S.same_spellings(df).collect()}
    want = {tuple(sorted(p)) for g in GROUPS for p in itertools.combinations(g, 2)}
    assert got == want
    assert S.same_spellings(df.limit(0)).count() == 0
