import pytest

from tidewell.llm import personal as P

LEXICON = [("Mira", "given"), ("Tomas", "given"), ("Grace", "given"), ("Oldenkamp", "family"), ("Brenwick", "family"), ("Harvest", "family")]
TEXT = "tbl string, row_id long, text string, kind string"


@pytest.fixture(scope="module")
def lexicon(spark):
    return spark.createDataFrame(LEXICON + [(None, "given")], "word string, kind string")


CASES = [
    ("write to mira.o+x@post.test please", [("email", "mira.o+x@post.test")]),
    ("my mail is mira (at) post (dot) test", [("email", "mira (at) post (dot) test")]),
    ("clone git@code.test:tools/x.git now", []),
    ("ping @some_bot", []),
    ("call +44 (0)7700 900 123 after lunch", [("phone", "+44 (0)7700 900 123")]),
    ("ring (555) 555-0142 ext 4", [("phone", "(555) 555-0142")]),
    ("SSN 900-12-3456 was in the form", [("id_number", "900-12-3456")]),
    ("id card QQ123456C attached", [("id_number", "QQ123456C")]),
    ("DNI 99123456-Z para el registro", [("id_number", "99123456-Z")]),
    ("Order 4129-0802-77 is out. Host 10.1.2.33 fails. The ticket is 2025-56-07042 ok", []),
    ("The meetup is at 12b Old Mill St, second floor", [("street_address", "12b Old Mill St")]),
    ("ship it to Kupferstraße 18 today", [("street_address", "Kupferstraße 18")]),
    ("on est au 9, rue des Tanneurs-Bleus ce soir", [("street_address", "9, rue des Tanneurs-Bleus")]),
    ("oficina en Calle del Molino Viejo, 24", [("street_address", "Calle del Molino Viejo, 24")]),
    ("The Gravel Street board has 31 cards", []),
    ("Thanks to Mira K. Oldenkamp for the notes", [("person_name", "Mira K. Oldenkamp")]),
    ("Dr. tomas brenwick gave the talk", [("person_name", "tomas brenwick")]),
    ("intro: Brenwick, Mira, works on search", [("person_name", "Brenwick, Mira")]),
    ("They asked for my ID 99123456K again. DNI 99.123.456-T para el registro", [("id_number", "99123456K"), ("id_number", "99.123.456-T")]),
    ("Gracias a wanda brenwick por el enlace. signed, Brenwick", [("person_name", "wanda brenwick")]),
    ("Grace period ends. The harvest feed will rise.", []),
    ("", []),
    (None, []),
]


def test_spans_kinds_and_placeholders(spark, lexicon):
    rows = [("t", i, text, "clash") for i, (text, _) in enumerate(CASES)] * 2 + [("t", None, "a@b.test", "")]
    df = spark.createDataFrame(rows, TEXT)
    got = sorted((r.row_id, r.kind, r.found_text) for r in P.personal_data(df, lexicon).collect())
    assert got == sorted((i, k, f) for i, (_, found) in enumerate(CASES) for k, f in found)
    clean = {r.row_id: r.text for r in P.redacted(df, lexicon).collect()}
    assert clean[0] == "write to [EMAIL] please" and clean[15] == "Thanks to [PERSON_NAME] for the notes" and clean[6] == "SSN [ID_NUMBER] was in the form"
    assert clean[14] == CASES[14][0] and clean[22] is None


def test_empty_tables(spark, lexicon):
    assert P.personal_data(spark.createDataFrame([], TEXT), lexicon).count() == 0
    assert P.personal_data(spark.createDataFrame([("t", 1, "x@y.test", "")], TEXT), lexicon.limit(0)).count() == 1


def test_votes_and_reliabilities():
    agree = (P.PHONE, P.ABSTAIN, P.PHONE, P.ABSTAIN, P.ABSTAIN)
    clash = (P.ID, P.ABSTAIN, P.PHONE, P.PHONE, P.ABSTAIN)
    denied = (P.PHONE, P.ABSTAIN, P.ABSTAIN, P.ABSTAIN, P.NONE)
    post = P.estimate({P._pattern(agree): 100, P._pattern(clash): 5, P._pattern(denied): 40})
    assert P.votes_of(P._pattern(clash)) == clash
    assert post[P._pattern(agree)].argmax() == P.PHONE and post[P._pattern(clash)].argmax() == P.PHONE and post[P._pattern(denied)].argmax() == P.NONE


def test_a_very_long_text():
    text = "word " * 200_000 + "mail a.b@c.test"
    assert [s[2] for s in P.spans(text, P.Lexicon(LEXICON))] == ["a.b@c.test"]
