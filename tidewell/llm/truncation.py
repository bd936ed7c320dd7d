"""Values that end before their original did.

Three kinds of evidence, all joins by prefix over every value:
1. a value is a strict prefix of a longer copy elsewhere and breaks off inside a word or sentence, or anywhere once it is too long to be a stock sentence;
2. its last words are a strict prefix of what follows the same words in other texts, run on there and do not end there;
3. its length is one at which values of the field pile up, and it is unfinished, or one at which mostly unfinished values of its host pile up.
Marks that a cut leaves behind (an ellipsis with "more", half an escape) settle a value alone.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import partial
from itertools import repeat

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.session import broadcast_if_small, materialise, spread

#: A length is a cut width when at least PILE times as many values have it as the lengths around it on average, and PILE_LEAST at least.
PILE, PILE_LEAST, AROUND = 5.0, 8, 12
#: The windows of words end a sentence often enough when at least this share of their occurrences does.
END_SHARE = 0.08
#: Shortest value whose longer copies are looked up, and shortest length that can be a cut width.
SHORTEST, PREFIX = 16, 24
#: Length from which a finished value with a longer copy is no stock sentence that other texts open with as well.
COPIED = 100
LINE = "⏎"
#: Contexts up to which the workers get them whole and count by themselves; beyond, windows and contexts are joined.
CONTEXTS = 200_000

_MARK = re.compile(r"(?:(?:\.\.\.|…)\s*[(\[]?(?:show|read|see|view|load)?\s*(?:more|mehr|plus|más)\b\W*|\((?:more|mehr|suite|más)\W*\)|\[(?:truncated|cut|more|gekürzt|tronqué|cortado|\.\.\.|…)\]|\[\+\]|(?:weiterlesen|lire la suite|leer más)\W*|\\u[0-9a-fA-F]{0,3}|\\x[0-9a-fA-F]?|\\|�+|&#?[A-Za-z0-9]{1,6}|\s…|[.!?]…|<[a-zA-Z/]?[^<>]{0,40}|\s[\[({])$", re.I)
_ELLIPSIS = re.compile(r"(\S?)(\s*)(?:\.\.\.|…)$")
_ENDED = re.compile(r"[.!?。！？।؟][\"'”’»›」』)\]]*(?:\s*[\U0001F000-\U0001FAFF☀-➿:;][)(DPp]?)*$|\w[\"”»」』]$")
_WEAK = re.compile(r"(?:(?:https?://|www\.)\S+|(?<!\S)[#@][\w-]+|[\U0001F000-\U0001FAFF☀-➿️]+|:[)(DP]|;\)|\blol|```|\|)$")
_DIGITS = re.compile(r"\d+")


def tail_of(text: str | None, host: str = "") -> tuple[int, str, str, str]:
    """(state, a, b, w): state 0 finished, 1 weakly finished, 2 unfinished, 3 marked as cut, 4 ends in a bare ellipsis; and the last three words."""
    t = (text or "").rstrip()
    if not t:
        return 0, "", "", ""
    # The patterns look at how a text ends; what they can match is never longer than this.
    last = t[-120:]
    m, e = _MARK.search(last), _ELLIPSIS.search(last)
    state = 3 if m else 4 if e else 0 if _ENDED.search(last) else 1 if _WEAK.search(last) else 2
    if e and not m:
        t = t[: len(t) - len(last) + e.start() + len(e.group(1))].rstrip()
    line = t.rsplit("\n", 1)[-1].strip()
    line = _DIGITS.sub("0", line.replace(host, "HOST") if host else line)
    words = [LINE, LINE, *line.split()][-3:]
    return state, *words


@F.pandas_udf(T.StructType([T.StructField("state", T.IntegerType()), *(T.StructField(c, T.StringType()) for c in "abw")]))
def _tails(text: pd.Series, host: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([tail_of(t, h or "") for t, h in zip(text, host)], columns=["state", "a", "b", "w"])


def _core(word):
    """A word without terminal punctuation."""
    return F.regexp_replace(word, r"[.!?…]+[\"'”’»)\]]*$", "")


_TERMINAL = re.compile(r"[.!?…]+[\"'”’»)\]]*$")


def _counted(batches: Iterator[pa.RecordBatch], contexts: dict | None, pairs: bool) -> Iterator[pa.RecordBatch]:
    """What follows the contexts in the texts of a partition, already added up: (a, b, next, kind, n); a is empty for contexts of one word.

    Without contexts every window of the texts is counted, by the same rules.
    """
    schema = pa.schema([("a", pa.string()), ("b", pa.string()), ("next", pa.string()), ("kind", pa.string()), ("n", pa.int64())])
    found: Counter = Counter()

    def emit() -> pa.RecordBatch:
        rows = [(*k, n) for k, n in found.items()]
        found.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)

    for batch in batches:
        # No window reaches over a line break, so each different line is looked at once; a text's last line has no end that counts.
        lines: Counter = Counter()
        for text, host in zip(batch.column("text").to_pylist(), batch.column("host").to_pylist()):
            parts = (text.replace(host, "HOST") if host else text).strip().split("\n")
            last = parts.pop()
            lines.update(parts)
            lines[last, False] += 1
        for line, n in lines.items():
            whole = isinstance(line, str)
            words = [LINE, LINE, *_DIGITS.sub("0", line if whole else line[0]).split()]
            if whole:
                words.append(LINE)
            for i, w in enumerate(map(contexts.get, words[1:-2]) if contexts is not None else repeat(None, max(0, len(words) - 3))):
                c = words[i + 2]
                if contexts is not None:
                    if w is None:
                        continue
                    if pairs and (w := w.get(words[i])) is None:
                        continue
                    if c[:2] not in w and c[:1] not in w:
                        continue
                core = _TERMINAL.sub("", c) if c[-1] in ".!?…\"'”’»)]" else c
                kind = "runs" if core == c and words[i + 3] != LINE else "dots" if "…" in c[len(core) :] or "..." in c[len(core) :] else "ends"
                found[words[i] if pairs else "", words[i + 1], core, kind] += n
        if len(found) > 300_000:
            yield emit()
    if found:
        yield emit()


def _grams(tails: DataFrame, prose: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, next, kind, n): how the contexts of the tails go on in all texts; keys are (a, b) or (b)."""
    contexts = tails.select(*keys, F.substring("w", 1, 2).alias("w")).distinct()
    schema = "a string, b string, next string, kind string, n long"
    if contexts.limit(CONTEXTS + 1).count() <= CONTEXTS:
        after: dict = {}
        for r in contexts.collect():
            (after.setdefault(r.b, {}).setdefault(r.a, set()) if "a" in keys else after.setdefault(r.b, set())).add(r.w)
        return prose.select("text", "host").mapInArrow(partial(_counted, contexts=after, pairs="a" in keys), schema).groupBy(*keys, "next", "kind").agg(F.sum("n").alias("n"))
    every = prose.select("text", "host").mapInArrow(partial(_counted, contexts=None, pairs="a" in keys), schema)
    return every.groupBy(*keys, "next", "kind").agg(F.sum("n").alias("n")).join(tails.select(*keys).distinct(), keys, "left_semi")


def _tally(tails: DataFrame, grams: DataFrame, keys: list[str], tag: str) -> DataFrame:
    """For each tail: how often its last word ends a sentence or line elsewhere, trails off, runs on, or is the start of a longer word."""
    same, longer = F.col("next") == F.col("w"), F.col("next").startswith(F.col("w")) & (F.length("next") > F.length("w"))
    total = lambda when, name: F.sum(F.when(when, F.col("n")).otherwise(0)).alias(name + tag)
    own = [c for c in tails.columns if c not in (*keys, "w")]
    # The first letters belong to the key, so that a common context doesn't bring all its words together.
    first = F.array_distinct(F.array(F.substring("next", 1, 1), F.substring("next", 1, 2)))
    grown = tails.withColumn("_p", F.substring("w", 1, 2)).join(grams.withColumn("_p", F.explode(first)), [*keys, "_p"], "left")
    return grown.groupBy(*keys, "w", *own).agg(*(total(same & (F.col("kind") == k), name) for k, name in (("ends", "ended"), ("dots", "dots"), ("runs", "onward"))), total(longer, "grown"))


def cut_values(values: DataFrame) -> DataFrame:
    """values (tbl, row_id, field, host, text, codes) -> the same rows without text, once each, with `cut` and the first `evidence` of it.

    `codes` marks fields of short codes with an optional detail, which are told by their longer
    copies only. Null, empty and blank values are no cases and fall away. Whole-row copies count
    once. A complete text without full stop is not cut: its last words end elsewhere too.
    """
    values = values.where("text is not null and trim(text) <> ''")
    prose = spread(values.where("not codes"))
    # Prefixes are hashed at lengths that are powers of two.
    level = lambda n: F.pow(F.lit(2), F.floor(F.log2(n))).cast("int")
    tails = prose.select("tbl", "row_id", "field", "host", F.length("text").alias("len"), F.octet_length("text").alias("bytes"), F.xxhash64("text").alias("same"), level(F.length("text")).alias("k"), F.xxhash64(F.substring("text", F.lit(1), level(F.length("text")))).alias("h"), _tails("text", "host").alias("t")).select("*", "t.*").drop("t").distinct()
    tails = materialise(tails, "tails")
    # 3: lengths, in characters and in bytes, at which values pile up.
    piled, limits = [], []
    for size in ("len", "bytes"):
        around = Window.partitionBy("tbl", "field").orderBy(size).rangeBetween(-AROUND, AROUND)
        sizes = tails.groupBy("tbl", "field", size).agg(F.count(F.lit(1)).alias("n"))
        piles = sizes.withColumn("near", (F.sum("n").over(around) - F.col("n")) / (2 * AROUND)).where(f"n >= {PILE_LEAST} and n >= {PILE} * near and {size} > {PREFIX}")
        piled.append(broadcast_if_small(piles.select("tbl", "field", size, F.lit(True).alias(f"piled_{size}"))))
        # A host's own limit holds whatever the last character; equal texts count once, and a page the host repeats is mostly finished.
        inside = Window.partitionBy("tbl", "field", "host").orderBy(size).rangeBetween(-AROUND, AROUND)
        own = tails.groupBy("tbl", "field", "host", size, "same").agg(F.min("state").alias("state")).groupBy("tbl", "field", "host", size).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("state") == 0).alias("finished"))
        own = own.withColumn("near", (F.sum("n").over(inside) - F.col("n")) / (2 * AROUND)).where(f"n >= {PILE_LEAST} and n >= {PILE} * near and 2 * finished <= n and {size} > {PREFIX}")
        limits.append(broadcast_if_small(own.select("tbl", "field", "host", size, F.lit(True).alias(f"limit_{size}"))))
    # 2: how the last words of unfinished values go on elsewhere: three words, else the last two.
    open_tails = tails.where("state in (1, 2, 4)").groupBy("a", "b", _core("w").alias("w")).agg(F.count(F.lit(1)).alias("own"), F.sum(F.when(F.col("state") == 4, 1).otherwise(0)).alias("dotted"))
    tally = materialise(_tally(open_tails, _grams(open_tails, prose, ["a", "b"]), ["a", "b"], "3"), "tally")
    alone = tally.where("ended3 + dots3 + onward3 + grown3 = 0").select("b", "w").distinct()
    pairs = _tally(alone, _grams(alone, prose, ["b"]), ["b"], "2")
    # 1: a longer copy that goes on where this value ends. Both are hashed at the powers of two; where a longer text
    # shares the last of these prefixes, it is hashed again at each length that the values with this prefix have, and
    # the two hashes of the rest must agree. No value is compared with another one.
    steps = F.transform(F.sequence(F.lit(SHORTEST.bit_length() - 1), F.floor(F.log2(F.length("text"))).cast("int")), lambda i: F.pow(F.lit(2), i).cast("int"))
    opened = prose.where(F.length("text") > SHORTEST).select("text", F.explode(steps).alias("k")).where("length(text) > k").select("text", "k", F.xxhash64(F.expr("substring(text, 1, k)")).alias("h"))
    longest = opened.groupBy("k", "h").agg(F.max(F.length("text")).alias("longest"))
    open_ends = tails.where(f"len >= {SHORTEST} and (state in (1, 2) or state = 0 and len >= {COPIED})")
    open_ends = materialise(open_ends.join(longest, ["k", "h"]).where("longest > len").select("tbl", "row_id", "field", "k", "h"), "open_ends")
    ends = prose.where(F.length("text") >= SHORTEST).join(broadcast_if_small(open_ends.select("tbl", "row_id", "field").distinct()), ["tbl", "row_id", "field"], "left_semi")
    ends = ends.select("tbl", "row_id", "field", F.col("text").alias("t"), level(F.length("text")).alias("k"), F.length("text").alias("at"))
    hashes = lambda rest: (F.xxhash64(rest).alias("h1"), F.xxhash64(F.lit(1), rest).alias("h2"))
    ends = ends.select("tbl", "row_id", "field", "k", "at", F.xxhash64(F.expr("substring(t, 1, k)")).alias("h"), *hashes(F.expr("substring(t, k + 1)")))
    ends = materialise(ends, "ends")
    lengths = ends.groupBy("k", "h").agg(F.collect_set("at").alias("ats"))
    starts = opened.join(broadcast_if_small(lengths), ["k", "h"]).select("k", "h", "ats", F.expr("substring(text, k + 1, k)").alias("next")).distinct()
    starts = starts.select("k", "h", "next", F.explode("ats").alias("at")).where("length(next) > at - k").select("k", "h", "at", *hashes(F.expr("substring(next, 1, at - k)"))).distinct()
    copied = ends.join(starts, ["k", "h", "at", "h1", "h2"], "left_semi").select("tbl", "row_id", "field", F.lit(True).alias("copied")).distinct()
    judged = tails.withColumn("w", _core("w"))
    for rows, keys in ((piled[0], ["tbl", "field", "len"]), (piled[1], ["tbl", "field", "bytes"]), (limits[0], ["tbl", "field", "host", "len"]), (limits[1], ["tbl", "field", "host", "bytes"]), (tally, ["a", "b", "w"]), (pairs, ["b", "w"]), (copied, ["tbl", "row_id", "field"])):
        judged = judged.join(rows, keys, "left")
    n = lambda c: F.coalesce(c, F.lit(0))
    yes = lambda c: F.coalesce(c, F.lit(False))
    rest3, rest2 = n("onward3") + n("grown3"), n("onward2") + n("grown2")
    three, two = n("ended3") + rest3 > 0, n("ended2") + rest2 > 0
    ended, rest = F.when(three, n("ended3")).otherwise(n("ended2")), F.when(three, rest3).otherwise(rest2)
    # An ending that several values have, and that nowhere grows, is an ending of its own.
    usual = (n("own") >= 3) & (n("grown3") == 0)
    runs_on = (three | two) & (ended < END_SHARE * (ended + rest)) & ~(usual & (rest3 == 0))
    unknown = ~three & ~two & ~usual & F.col("w").rlike(r"[\p{L}\p{N}]$")
    limit = yes("limit_len") | yes("limit_bytes")
    pile = yes("piled_len") | yes("piled_bytes") | limit
    trails_off = (n("dotted") + n("dots3") >= 2) & (n("dotted") + n("dots3") > n("ended3") + rest3)
    cut = (F.col("state") == 3) | (F.col("state") == 4) & ~trails_off | (F.col("state") == 2) & (pile | runs_on | unknown) | (F.col("state") == 1) & pile | (F.col("state") == 0) & limit | F.col("state").isin(0, 1, 2) & yes("copied")
    by = F.when(~cut, None).when(yes("copied"), "longer copy").when(F.col("state") == 3, "mark").when(F.col("state") == 4, "ellipsis").when((F.col("state") == 2) & runs_on, "longer phrase").when(pile & (F.col("state") > 0), "cut width").when(limit, "host limit").otherwise("unknown word")
    prose_out = judged.select("tbl", "row_id", "field", "host", cut.alias("cut"), by.alias("evidence"))
    return prose_out.unionByName(_cut_codes(values.where("codes")))


def _cut_codes(values: DataFrame) -> DataFrame:
    """Codes with an optional detail: one is cut when longer copies go on inside the code's word or inside the detail."""
    rows = values.select("tbl", "row_id", "field", "host", F.regexp_replace(F.rtrim("text"), r"[0-9]+", "0").alias("form"), F.col("text").rlike(r"[\[({…]\s*$|\.\.\.\s*$|�$").alias("marked")).distinct()
    forms = rows.groupBy("field", "form").agg(F.count(F.lit(1)).alias("n"))
    forms = materialise(forms, "forms")
    # Every prefix of every distinct form: forms are few, because details are templates and digits are one.
    prefixes = forms.select("field", F.col("form").alias("longer"), F.explode(F.sequence(F.lit(1), F.length("form") - 1)).alias("k")).select("field", F.expr("substring(longer, 1, k)").alias("form"), F.expr("substring(longer, k + 1, 1)").alias("next"))
    grown = forms.where("length(form) > 1").join(prefixes, ["field", "form"]).groupBy("field", "form").agg(F.max(F.col("next").rlike(r"[\p{L}\p{N}_]")).alias("inside"))
    bare = F.col("form").rlike(r"^[a-z]+(?:_[a-z]+)*$")
    whole = F.col("inside").isNull() | bare & ~F.col("inside")
    return rows.join(grown, ["field", "form"], "left").select("tbl", "row_id", "field", "host", (~whole | F.col("marked")).alias("cut"), F.when(~whole, "longer code").when(F.col("marked"), "mark").alias("evidence"))


def link_values(scraped: DataFrame, asked: DataFrame) -> DataFrame:
    """The three fields as rows (tbl, row_id, field, host, text, codes)."""
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][\w+.-]*://([^/?#]+)", 1)).alias("host")
    one = lambda df, tbl, key, field, codes: df.select(F.lit(tbl).alias("tbl"), F.col(key).alias("row_id"), F.lit(field).alias("field"), host, F.col(field).alias("text"), F.lit(codes).alias("codes"))
    return one(scraped, "scraped_links", "link_id", "raw_text", False).unionByName(one(asked, "ask_links", "ask_id", "partial_text", False)).unionByName(one(asked, "ask_links", "ask_id", "block_reason", True)).where("row_id is not null")


def evidence_counts(judged: DataFrame) -> DataFrame:
    """(field, evidence, n): by what the values told as cut were told."""
    return judged.where("cut").groupBy("field", "evidence").agg(F.count(F.lit(1)).alias("n"))


def truncation_by_host(judged: DataFrame) -> DataFrame:
    """(host, n_values, n_cut, cut_share): how often each source cuts its values."""
    return judged.groupBy("host").agg(F.count(F.lit(1)).alias("n_values"), F.sum(F.col("cut").cast("long")).alias("n_cut")).withColumn("cut_share", F.round(F.col("n_cut") / F.col("n_values"), 6))
