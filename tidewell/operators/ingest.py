"""From chat exports to graded messages."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.functions import text as T
from tidewell.operators.instants import InstantDictionary, normalise_instants
from tidewell.operators.ordered import greedy_batches, last_marked, row_numbers
from tidewell.session import broadcast_if_small

MIN_QUALITY, BORDERLINE, CONTEXT = 4, 3, 3
#: More lines than a text can have.
LINES = 1 << 32

HEADER = r"^(\d{1,2}/\d{1,2}/\d{2,4}), (\d{1,2}:\d{2}(?::\d{2})?(?:[\x{20}\x{A0}\x{202F}][AaPp][Mm])?)(?: -)? (.*)$"
_DATES = ["d/M/yyyy", "d/M/yy"]
_TIMES = ["h:mm:ss a", "h:mm a", "H:mm:ss", "H:mm"]


def dated(messages: DataFrame, zones: DataFrame) -> DataFrame:
    """messages (source_id, pos, datetime_iso, text) with text and a readable stamp -> (source_id, pos, ts, text), whole-row copies once.

    Stamps are read by the instant dictionary; one without zone is local to that of zones (source_id, zone).
    """
    told = messages.where("text is not null").join(broadcast_if_small(zones), "source_id", "left")
    rows = told.select(F.lit("messages").alias("tbl"), F.struct("source_id", "pos", "text").alias("row_key"), F.col("datetime_iso").alias("raw"), "zone")
    return normalise_instants(rows, InstantDictionary(messages.sparkSession)).select("row_key.source_id", "row_key.pos", F.timestamp_micros("utc_us").alias("ts"), "row_key.text")


def export_lines(messages: DataFrame) -> DataFrame:
    """messages (source_id, pos, ts, text) -> lines (source_id, line_no, line) of an export with a placeholder author.

    line_no is pos * LINES + the line's number in its text, which is always below LINES; blank
    lines inside a text are kept and vanish in parsing.
    """
    head = F.concat(F.date_format("ts", "d/M/yyyy, HH:mm:ss"), F.lit(" - Member: "))
    lines = messages.select("source_id", "pos", F.posexplode(F.split(F.concat(head, "text"), "\n")).alias("k", "line"))
    return lines.select("source_id", (F.col("pos").cast("decimal(19,0)") * F.lit(LINES).cast("decimal(11,0)") + F.col("k")).cast("decimal(30,0)").alias("line_no"), "line")


def parse_export(lines: DataFrame) -> DataFrame:
    """lines (source_id, line_no, line) -> messages (source_id, line_no of the header, ts, text, is_media).

    A header line opens a message only if what follows the stamp has ": "; a header without it is
    a system event, dropped together with its continuation lines. Other non-blank lines go on the
    message. is_media is decided on the header line. Works for files of any length: the header a
    line belongs to is found without gathering a file.
    """
    head = lines.select("source_id", "line_no", "line", F.col("line").rlike(HEADER).alias("is_head"))
    owned = last_marked(head, ["source_id"], "line_no", "is_head", "head_no").where("head_no is not null")
    body = F.regexp_extract("line", HEADER, 3)
    part = F.when(F.col("is_head"), F.when(body.contains(": "), F.regexp_replace(body, r"^.*?: ", ""))).otherwise(F.col("line"))
    texts = owned.select("source_id", "head_no", "line_no", "is_head", "line", part.alias("part"))
    whole = texts.groupBy("source_id", "head_no").agg(F.max(F.when(F.col("is_head"), F.col("line"))).alias("head"), F.array_sort(F.collect_list(F.struct("line_no", "part"))).alias("parts"))
    said = F.filter(F.col("parts.part"), lambda p: p.isNotNull() & (T.strip(p) != ""))
    stamp = F.regexp_replace(F.concat_ws(" ", F.regexp_extract("head", HEADER, 1), F.regexp_extract("head", HEADER, 2)), r"[\x{A0}\x{202F}]", " ")
    ts = F.coalesce(*[F.try_to_timestamp(stamp, F.lit(f"{d} {t}")) for d in _DATES for t in _TIMES])
    kept = whole.where(F.regexp_extract("head", HEADER, 3).contains(": "))
    return kept.select("source_id", F.col("head_no").alias("line_no"), ts.alias("ts"), F.array_join(said, "\n").alias("text"), F.col("head").contains("<Media omitted>").alias("is_media"))


def with_reasons(messages: DataFrame) -> DataFrame:
    """messages plus `reason`, null where the heuristic filter keeps them."""
    return messages.withColumn("reason", T.heuristic_reason(F.col("text"), F.coalesce("is_media", F.lit(False))))


def message_identities(messages: DataFrame) -> DataFrame:
    """(msg_id, occurrence, message_id): sha256 over source, stamp, text and the running number of equal ones, in order of pos."""
    rows = messages.where("datetime_iso is not null and text is not null").select("msg_id", "source_id", "datetime_iso", T.normalised(F.col("text")).alias("norm"), "pos").distinct()
    numbered = row_numbers(rows, ["source_id", "datetime_iso", "norm"], ["pos", "msg_id"], "occurrence")
    told = F.concat(F.lit("["), F.concat_ws(", ", T.json_string(F.col("source_id")), T.json_string(F.col("datetime_iso")), T.json_string(F.col("norm")), F.col("occurrence").cast("string")), F.lit("]"))
    return numbered.select("msg_id", "occurrence", F.sha2(told, 256).alias("message_id"))


def unseen_messages(messages: DataFrame, grades: DataFrame) -> DataFrame:
    """Messages that no earlier run has graded."""
    return messages.select("msg_id", "source_id").distinct().join(grades.select("msg_id").distinct(), "msg_id", "left_anti")


def import_outcomes(messages: DataFrame, grades: DataFrame) -> DataFrame:
    """Per source: total, dropped by the heuristic, not yet graded, of low quality, stored."""
    best = grades.groupBy("msg_id").agg(F.max("quality").alias("quality"))
    rows = with_reasons(messages.select("msg_id", "source_id", "text", "is_media").distinct()).join(best, "msg_id", "left")
    kept = F.col("reason").isNull()
    return rows.groupBy("source_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(~kept).alias("dropped"), F.count_if(kept & F.col("quality").isNull()).alias("ungraded"), F.count_if(kept & (F.col("quality") < MIN_QUALITY)).alias("low_quality"), F.count_if(kept & (F.col("quality") >= MIN_QUALITY)).alias("stored"))


def packed_batches(messages: DataFrame, budget: int = 2000, most: int = 5) -> DataFrame:
    """messages (source_id, pos, msg_id, text) -> (source_id, batch_no, msg_id, tokens): greedy batches of each source in order.

    A new batch starts when the budget or the number of messages would be exceeded. A source of any
    size is spread: what each partition makes of every batch that may be open before it is a
    summary of one row, and chaining these tells the batch that is open.
    """
    rows = messages.where("text is not null and pos is not null").select("source_id", "pos", "msg_id", T.estimated_tokens(F.col("text")).alias("tokens")).distinct()
    return greedy_batches(rows, ["source_id"], ["pos", "msg_id", "tokens"], "tokens", budget, most, "batch_no").select("source_id", "batch_no", "msg_id", "tokens")


def text_pieces(texts: DataFrame, key: str, column: str, step: int) -> DataFrame:
    """(key, piece_no, piece): long texts cut at the last white space after a third of the step, else hard; blank pieces vanish."""

    def cut(text: str) -> list[str]:
        out, at = [], 0
        while at < len(text):
            end = min(len(text), at + step)
            if end < len(text):
                space = max(text.rfind(c, at + step // 3, end) for c in "\n ")
                end = space if space > at else end
            if text[at:end].strip():
                out.append(text[at:end].strip())
            at = end + (end < len(text) and text[end] in "\n ")
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, i, p) for k, t in zip(b["k"], b["t"]) if t for i, p in enumerate(cut(t))]
            yield pd.DataFrame(rows, columns=[key, "piece_no", "piece"])

    return texts.select(F.col(key).alias("k"), F.col(column).alias("t")).where("k is not null").distinct().mapInPandas(run, f"{key} long, piece_no long, piece string")


def context_windows(messages: DataFrame, grades: DataFrame) -> DataFrame:
    """For each borderline message the ids of up to three kept messages before and after it in its source.

    Positions count in the kept list. Neighbours are found by joining on the position, not by
    gathering a source.
    """
    kept = with_reasons(messages.select("msg_id", "source_id", "pos", "text", "is_media").distinct()).where("reason is null").select("msg_id", "source_id", "pos")
    numbered = row_numbers(kept, ["source_id"], ["pos", "msg_id"], "rn")
    final = grades.where("quality is not null").groupBy("msg_id").agg(F.max("quality").alias("quality"))
    asked = numbered.join(final.where(F.col("quality") == BORDERLINE), "msg_id")
    near = asked.select("msg_id", "source_id", F.col("rn").alias("own"), F.explode(F.sequence(F.col("rn") - CONTEXT, F.col("rn") + CONTEXT)).alias("rn")).where("rn <> own")
    found = near.join(numbered.select("source_id", "rn", F.col("msg_id").alias("other")), ["source_id", "rn"], "left")
    side = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(c & F.col("other").isNotNull(), F.struct("rn", "other")))), lambda x: x["other"].cast("string")), ",")
    return found.groupBy("msg_id").agg(side(F.col("rn") < F.col("own")).alias("before_ids"), side(F.col("rn") > F.col("own")).alias("after_ids"))


def merged_passes(grades: DataFrame, verified: DataFrame) -> DataFrame:
    """First-pass grades with the second opinion where the first was borderline; promoted where that lifts them over the threshold."""
    second = verified.select("grade_id", F.col("quality").alias("second"), F.col("confidence").alias("second_confidence"))
    both = grades.join(second, "grade_id", "left")
    final = F.when(F.col("quality") == BORDERLINE, F.coalesce("second", "quality")).otherwise(F.col("quality"))
    return both.select("grade_id", F.col("quality").alias("first_quality"), final.alias("quality"), ((F.col("quality") == BORDERLINE) & (final >= MIN_QUALITY)).alias("promoted"))


def merged_piece_grades(pieces: DataFrame) -> DataFrame:
    """pieces (msg_id, grade_id, quality, confidence, topics) -> one grade per message: best quality (first on ties), first six distinct topics, mean confidence."""
    listed = pieces.groupBy("msg_id").agg(F.max_by("grade_id", F.struct("quality", -F.col("grade_id"))).alias("best_grade_id"), F.max("quality").alias("quality"), F.round(F.avg("confidence"), 6).alias("confidence"), F.array_sort(F.collect_list(F.struct("grade_id", F.coalesce("topics", F.array().cast("array<string>")).alias("topics")))).alias("all"))
    return listed.select("msg_id", "best_grade_id", "quality", "confidence", F.array_join(F.slice(F.array_distinct(F.flatten(F.col("all.topics"))), 1, 6), "|").alias("topics"))


def normalised_grades(grades: DataFrame) -> DataFrame:
    """Quality clamped to 1..5, unknown categories as noise, topics trimmed and without blanks."""
    topics = F.filter(F.transform(F.coalesce("topics", F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))
    return grades.select("grade_id", F.greatest(F.lit(1), F.least(F.lit(5), F.coalesce("quality", F.lit(1)))).alias("quality"), F.when(F.lower("category").isin(T.CATEGORIES), F.lower("category")).otherwise("noise").alias("category"), F.size(topics).cast("long").alias("n_topics"))
