"""Variant spellings of persons, organisations and subjects.

Spellings are folded to tokens. Equal tokens in any order are one form; a symmetric-delete index
on tokens (and on the tokens written together) joins forms one edit apart; forms that give less
than the whole name (initials, abbreviations, acronyms, first word, handles) are aligned with the
whole ones by optimal assignment and join one only when no other whole name fits.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.operators.components import connected_components
from tidewell.session import materialise

# Titles, legal forms and articles that aren't part of a name.
TITLES = frozenset("dr mr mrs ms miss prof professor sir dame herr frau monsieur mme señor senor señora senora sr sra dott ing phd md jr".split())
LEGAL = frozenset("inc gmbh ag ltd llc sa plc bv nv oy ab spa srl sarl sas kg ohg ug pty limited incorporated lp llp as kk".split())
DROPPED = frozenset("the hq".split())
DOMAINS = frozenset("example com org net io co dev ai test edu gov info app".split())
# Words that are written in several ways in names of organisations, each with the usual one.
WORDS = dict(pair.split("=") for pair in "laboratories=labs laboratory=labs lab=labs tech=technologies technology=technologies bros=brothers intl=international univ=university uni=university inst=institute fdn=foundation fndn=foundation grp=group sys=systems syst=systems co=company corp=corporation assn=association dept=department natl=national mfg=manufacturing svcs=services".split())
# Short forms of given names, each with the name it stands for.
NICKNAMES = dict(
    pair.split("=")
    for pair in "bob=robert rob=robert robbie=robert bobby=robert bert=robert ben=benjamin benny=benjamin benji=benjamin alex=alexander sasha=alexander sandy=alexander xander=alexander lex=alexander kate=katherine kathy=katherine katie=katherine kat=katherine cathy=katherine kit=katherine maggie=margaret meg=margaret peggy=margaret greta=margaret marge=margaret margie=margaret rita=margaret liz=elizabeth beth=elizabeth betty=elizabeth lizzie=elizabeth eliza=elizabeth lisa=elizabeth betsy=elizabeth ellie=elizabeth bill=william will=william billy=william willy=william willi=william liam=william wim=william harry=harold hal=harold gabe=gabriel gabi=gabriel gabo=gabriel joe=josephine jo=josephine josie=josephine fifi=josephine hannes=johannes hans=johannes jo=johannes johann=johannes jan=johannes kolya=nikolai niko=nikolai nick=nikolai kolja=nikolai klaus=nikolai dima=dmitri mitya=dmitri dimitri=dmitri paco=francisco pancho=francisco kiko=francisco fran=francisco frank=francisco curro=francisco nacho=ignacio iggy=ignacio uschi=ursula ulla=ursula ursel=ursula uli=ursula yoli=yolanda yola=yolanda yoyo=yolanda vroni=veronica vera=veronica ronnie=veronica nica=veronica roni=veronica theo=theodora dora=theodora thea=theodora teddy=theodora dorie=theodora leo=leopold poldi=leopold conny=cornelia nele=cornelia corrie=cornelia nelly=cornelia neli=cornelia zach=zacharias zack=zacharias zac=zacharias ottie=ottilie tilly=ottilie otti=ottilie tilda=ottilie priya=priyanka pri=priyanka mike=michael mick=michael tom=thomas tommy=thomas jim=james jimmy=james jack=john johnny=john dave=david dan=daniel danny=daniel sam=samuel steve=stephen tony=anthony andy=andrew chris=christopher matt=matthew ed=edward ted=edward ned=edward rick=richard dick=richard rich=richard sue=susan susie=susan jen=jennifer jenny=jennifer becky=rebecca debbie=deborah pat=patricia tricia=patricia vicky=victoria tina=christina nina=antonina lena=helena gina=regina pepe=jose lola=dolores charo=rosario lupe=guadalupe".split()
)

WHOLE, INITIAL, SHORTENED, SINGLE = range(4)
_HUMPS = re.compile(r"(?<=[a-zà-ÿ])(?=[A-ZÀ-Þ])")
_PIECE = re.compile(r"[^\W_]+(?:['’][^\W_]+)*\.?")


def folded(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", text.replace("ß", "ss").replace("ø", "o").replace("ł", "l")).casefold() if not unicodedata.combining(c))


def parse(name: str) -> tuple[list[str], int, str, bool] | None:
    """(tokens in order, form, written together, looks like a proper name), or None for a blank."""
    text = unicodedata.normalize("NFKC", name).strip()
    proper = any(c.isupper() for c in text[:1] + "".join(w[:1] for w in text.split()))
    text = re.sub(r"\((?:hq|HQ)\)|\[[^\]]*\]", " ", text)
    if text[:1] in "@#":
        text = text[1:]
    m = re.fullmatch(r"(?:https?://)?(?:www\.)?([\w-]+)\.([a-z]{2,8})/?", text)
    domain = bool(m and m.group(2) in DOMAINS)
    if domain:
        text, proper = m.group(1), True
    if " " not in text and len(_HUMPS.findall(text)) >= 1 and not text.isupper():
        text = _HUMPS.sub(" ", text)
    dotted = re.fullmatch(r"([^\W\d_]{3,})\.([^\W\d_]{3,})", text)
    if dotted:
        text = " ".join(dotted.groups())
    pieces = _PIECE.findall(folded(text).replace("-", " ").replace("_", " "))
    if not pieces:
        return None
    kept = [p for p in pieces if p.rstrip(".") not in TITLES] or pieces
    kept = [p for p in kept if p.rstrip(".") not in LEGAL] or kept
    kept = [p for p in kept if p not in DROPPED] or kept
    long = [p for p in kept if len(p.rstrip(".")) > 1]
    if len(long) >= 2:
        kept = long  # initials between or beside two whole words say nothing new
    kept = [kept[0], *(WORDS.get(p.rstrip("."), p) for p in kept[1:])]
    short = any(p.endswith(".") and len(p) > 2 for p in kept)
    tokens = [p.rstrip(".") for p in kept]
    tokens = [NICKNAMES.get(t, t) if len(tokens) > 1 else t for t in tokens]
    form = SHORTENED if short else INITIAL if any(len(t) == 1 for t in tokens) and len(tokens) > 1 else SINGLE if len(tokens) == 1 else WHOLE
    return tokens, form, "".join(tokens), proper


def one_edit(a: str, b: str) -> bool:
    """At most one insertion, deletion, substitution or exchange of neighbours apart."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return a == b
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :] or a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :]
    longer, shorter = (a, b) if len(a) > len(b) else (b, a)
    return longer[i + 1 :] == shorter[i:]


def abbreviates(short: str, whole: str) -> bool:
    """short begins like whole and its letters stand in whole in this order."""
    if not short or not whole or short[0] != whole[0] or len(short) > len(whole):
        return False
    rest = iter(whole)
    return all(c in rest for c in short)


def matched(edges: list[set[int]], taken: dict[int, int]) -> bool:
    """Whether every row of edges that isn't taken yet gets a column of its own, by augmenting paths; taken (row to column) stays."""
    owner = {k: i for i, k in taken.items()}

    def place(i: int, seen: set[int]) -> bool:
        for k in edges[i]:
            if k not in seen and owner.get(k) not in taken:
                seen.add(k)
                if k not in owner or place(owner[k], seen):
                    owner[k] = i
                    return True
        return False

    return all(i in taken or place(i, set()) for i in range(len(edges)))


def fits(partial: list[str], whole: list[str]) -> bool:
    """Whether the tokens of a shortened name can be assigned to different tokens of a whole one.

    One must be equal or one edit off; the others may be initials, abbreviations or prefixes, and
    one edit is allowed in all. Of the whole name only tokens behind the assigned ones may be left
    over; then the order stands. The assignment with the fewest edits is found by matching: all
    tokens without edit, else all but one.
    """
    n = len(partial)
    if n > len(whole):
        return False
    free: list[set[int]] = [set() for _ in partial]
    equal, edited = set(), set()
    for i, t in enumerate(partial):
        for k in range(n) if n == len(whole) else (i,):
            w = whole[k]
            if t == w:
                free[i].add(k)
                if len(t) > 2:
                    equal.add((i, k))
            elif len(t) >= 4 and len(w) >= 4 and one_edit(t, w):
                edited.add((i, k))
            elif abbreviates(t, w) and (len(t) == 1 or w.startswith(t) or len(t) <= 5):
                free[i].add(k)
    return any(matched(free, {i: k}) for i, k in equal | edited)


def deletions(token: str) -> list[str]:
    return [*{token, *(token[:i] + token[i + 1 :] for i in range(len(token)))}]


def _parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for name in b["name"]:
            p = parse(name)
            if p:
                tokens, form, glue, proper = p
                rows.append((name, " ".join(sorted(tokens)), " ".join(tokens), form, glue, proper))
        yield pd.DataFrame(rows, columns=["name", "sig", "toks", "form", "glue", "proper"])


def _edit_keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Keys two forms share when one token, or the whole written together, is one edit off."""
    for b in batches:
        rows = []
        for sig, glue in zip(b["sig"], b["glue"]):
            tokens = sig.split(" ")
            if len(tokens) > 1:
                for i, t in enumerate(tokens):
                    if len(t) >= 4:
                        rest = " ".join(tokens[:i] + tokens[i + 1 :])
                        rows += [(f"t{rest}|{d}", sig) for d in deletions(t)]
            if len(glue) >= 5:
                rows += [(f"g{d}", sig) for d in deletions(glue)]
        yield pd.DataFrame(rows, columns=["key", "sig"])


def _close(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        keep = []
        for a, c, ga, gc in zip(b["a"], b["b"], b["ga"], b["gb"]):
            x, y = a.split(" "), c.split(" ")
            same = one_edit(ga, gc) and min(len(ga), len(gc)) >= 5
            if not same and len(x) == len(y) > 1:
                lone, other = [*x], []
                for t in y:
                    if t in lone:
                        lone.remove(t)
                    else:
                        other.append(t)
                same = len(lone) == len(other) == 1 and min(len(lone[0]), len(other[0])) >= 4 and one_edit(lone[0], other[0])
            keep.append(same)
        yield b.loc[keep, ["a", "b"]]


def _aligned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        keep = [fits(p.split(" "), w.split(" ")) for p, w in zip(b["part"], b["toks"])]
        yield b.loc[keep, ["sig", "root"]]


def _first_keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = [(d, toks, root) for toks, root in zip(b["toks"], b["root"]) for d in deletions(toks.split(" ")[0])]
        yield pd.DataFrame(rows, columns=["key", "toks", "root"])


def _only(links: DataFrame) -> DataFrame:
    """(sig, root) kept where a shortened form fits one entity only."""
    return links.groupBy("sig").agg(F.min("root").alias("root"), F.max("root").alias("other")).where("root = other").select("sig", "root")


def spelling_entities(names: DataFrame) -> DataFrame:
    """names (name) -> (name, entity): spellings of the same person, organisation or subject share the entity.

    Null and blank names fall away, repeats count once. A form that fits several entities joins
    none of them. A shared family name or first word alone joins nothing.
    """
    parsed = materialise(names.where("name is not null").distinct().mapInPandas(_parsed, "name string, sig string, toks string, form int, glue string, proper boolean"), "spellings")
    # One row per folded form; what follows works on forms, so exact copies cost nothing.
    forms = parsed.groupBy("sig").agg(F.min("toks").alias("toks"), F.min("form").alias("form"), F.min("glue").alias("glue"), F.max("proper").alias("proper"))
    forms = materialise(forms, "forms")
    whole = forms.where(f"form in ({WHOLE}, {SINGLE})")
    # The same letters written together, in any of the orders met, are the same form.
    glued = parsed.where(f"form in ({WHOLE}, {SINGLE})").select("sig", "glue").distinct()
    together = glued.groupBy("glue").agg(F.min("sig").alias("low"))
    same = glued.join(together, "glue").where("low <> sig").select(F.col("sig").alias("a"), F.col("low").alias("b"))
    keys = glued.mapInPandas(_edit_keys, "key string, sig string").distinct()
    heads = keys.groupBy("key").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("key")
    keys = keys.join(heads, "key")
    pairs = keys.withColumnRenamed("sig", "a").join(keys.withColumnRenamed("sig", "b"), "key").where("a < b").select("a", "b").distinct()
    glue_of = glued.groupBy("sig").agg(F.min("glue").alias("glue"))
    pairs = pairs.join(glue_of.withColumnsRenamed({"sig": "a", "glue": "ga"}), "a").join(glue_of.withColumnsRenamed({"sig": "b", "glue": "gb"}), "b")
    close = pairs.mapInPandas(_close, "a string, b string")
    rooted = connected_components(materialise(same.union(close), "near"))
    entities = whole.join(rooted.withColumnRenamed("node", "sig"), "sig", "left").select("sig", "toks", "glue", "form", "proper", F.coalesce("root", "sig").alias("root"))
    entities = materialise(entities, "entities")
    size = F.size(F.split("toks", " "))
    full = entities.where(size > 1)
    first, last = F.element_at(F.split("toks", " "), 1), F.element_at(F.split("toks", " "), -1)
    # Shortened forms: initial and family name, apart or written together; acronym; first word.
    short_keys = (
        full.where(size == 2).select(F.explode(F.array(F.concat(F.lit("i"), F.substring(first, 1, 1), F.lit(" "), last), F.concat(F.lit("i"), F.substring(last, 1, 1), F.lit(" "), first), F.concat(F.lit("j"), F.substring(first, 1, 1), last), F.concat(F.lit("j"), F.substring(last, 1, 1), first))).alias("key"), "root")
        .union(full.where(size >= 2).select(F.concat(F.lit("c"), F.array_join(F.transform(F.split("toks", " "), lambda t: F.substring(t, 1, 1)), "")), "root"))
        .union(full.where("proper").select(F.concat(F.lit("f"), first), "root"))
        .groupBy("key").agg(F.min("root").alias("root"), F.max("root").alias("other")).where("root = other").select("key", "root")
    )
    lone = entities.where(f"form = {SINGLE}").join(full.select("root").distinct(), "root", "left_anti")
    a, b = F.element_at(F.split("toks", " "), 1), F.element_at(F.split("toks", " "), 2)
    initial = F.when(F.length(a) == 1, F.concat(F.lit("i"), a, F.lit(" "), b)).otherwise(F.concat(F.lit("i"), b, F.lit(" "), a))
    asked = forms.where((F.col("form") == INITIAL) & (size == 2)).select("sig", initial.alias("key"), F.lit(0).alias("rank"))
    asked = asked.union(lone.select("sig", F.explode(F.filter(F.array(F.when(F.length("glue") >= 5, F.concat(F.lit("j"), "glue")), F.when(F.col("proper") & F.length("glue").between(2, 6), F.concat(F.lit("c"), "glue")), F.when(F.col("proper") & (F.length("glue") >= 5), F.concat(F.lit("f"), "glue"))), lambda k: k.isNotNull())).alias("key"), F.lit(0)))
    by_key = _only(asked.join(short_keys, "key").select("sig", "root"))
    # Abbreviated words: the first word finds the candidates through its deletions, alignment decides.
    parts = forms.where(f"form = {SHORTENED}").select("sig", F.col("toks").alias("part"))
    seek = parts.select("sig", "part", F.element_at(F.split("part", " "), 1).alias("head")).select("sig", "part", F.explode(F.concat(F.array("head"), F.transform(F.sequence(F.lit(1), F.length("head")), lambda i: F.concat(F.col("head").substr(F.lit(1), i - 1), F.col("head").substr(i + 1, F.length("head")))))).alias("key")).distinct()
    index = full.select("toks", "root").mapInPandas(_first_keys, "key string, toks string, root string")
    by_parts = _only(seek.join(index, "key").select("sig", "part", "toks", "root").distinct().mapInPandas(_aligned, "sig string, root string").distinct())
    joined = by_key.union(by_parts).groupBy("sig").agg(F.min("root").alias("root"))
    final = entities.select("sig", "root").union(forms.where(f"form in ({INITIAL}, {SHORTENED})").select("sig", F.col("sig").alias("root"))).join(joined.withColumnRenamed("root", "better"), "sig", "left").select("sig", F.coalesce("better", "root").alias("entity"))
    return parsed.select("name", "sig").join(final, "sig").select("name", "entity")


def same_spellings(names: DataFrame) -> DataFrame:
    """names (name) -> (name_a, name_b): pairs of different spellings of one entity, name_a the smaller in code point order."""
    entities = materialise(spelling_entities(names), "entity_of")
    a, b = entities.withColumnRenamed("name", "name_a"), entities.withColumnRenamed("name", "name_b")
    return a.join(b, "entity").where("name_a < name_b").select("name_a", "name_b").distinct()
