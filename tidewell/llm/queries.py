"""Queries of the llm problems, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.boilerplate import boilerplate_lines
from tidewell.llm.cooccurrence import baskets, frequent_pairs
from tidewell.llm.mixing import mixture, mixture_shares, posterior_shares
from tidewell.llm.packing import container_lists, fill_report, pack
from tidewell.llm.personal import personal_data, redacted, table_texts
from tidewell.llm.sentences import sentence_places, sentences
from tidewell.llm.spellings import same_spellings, spelling_entities
from tidewell.llm.tokens import token_counts
from tidewell.llm.truncation import cut_values, evidence_counts, link_values, truncation_by_host
from tidewell.session import materialise
from tidewell.tables import table


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boilerplate_lines(table(spark, sf_dir, "scraped_links", "link_id", "url", "title", "raw_text"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).select("link_id", "line_no")


def p1_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many lines the neighbours tell, and how many their form alone."""
    return _lines(spark, sf_dir).groupBy("evidence").agg(F.count(F.lit(1)).alias("n"))


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_values(link_values(table(spark, sf_dir, "scraped_links", "link_id", "url", "raw_text"), table(spark, sf_dir, "ask_links", "ask_id", "url", "partial_text", "block_reason")))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(spark, sf_dir).where("cut").select("tbl", "row_id", "field")


def p2_host_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation_by_host(_judged(spark, sf_dir))


def p2_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence_counts(_judged(spark, sf_dir))


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table_texts(table(spark, sf_dir, "messages", "msg_id", "text"), table(spark, sf_dir, "grades", "grade_id", "original_text"), table(spark, sf_dir, "ingest_requests", "entry_id", "text"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(_texts(spark, sf_dir), table(spark, sf_dir, "name_lexicon"))


def p4_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redacted(_texts(spark, sf_dir), table(spark, sf_dir, "name_lexicon"))


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    entities = table(spark, sf_dir, "scraped_links", "entities").select(F.explode("entities").alias("name"))
    return entities.union(table(spark, sf_dir, "grades", "topics").select(F.explode("topics")))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return same_spellings(_names(spark, sf_dir))


def p5_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_entities(_names(spark, sf_dir))


def p6_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = table(spark, sf_dir, "scraped_links", "link_id", "entities", "topics")
    return frequent_pairs([baskets(table(spark, sf_dir, "grades", "grade_id", "topics"), "grade_id", "topics", "grade_topics"), baskets(links, "link_id", "entities", "link_entities"), baskets(links, "link_id", "topics", "link_topics")])


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p6_pairs(spark, sf_dir).select("field", "item_a", "item_b")


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = materialise(token_counts(table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", []), "sizes")
    return pack(sizes, table(spark, sf_dir, "container_sizes"))


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return container_lists(_packed(spark, sf_dir))


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_report(_packed(spark, sf_dir))


def _sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialise(token_counts(table(spark, sf_dir, "documents", "doc_id", "source", "text"), "doc_id", ["source"]), "sizes")


def _mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(_sized(spark, sf_dir), table(spark, sf_dir, "mixture_targets"), texts=table(spark, sf_dir, "documents", "doc_id", "text"))


def p9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir)


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture_shares(materialise(_mixed(spark, sf_dir), "mixed"), table(spark, sf_dir, "mixture_targets"))


def p9_posteriors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same mix by the classifier's posteriors alone, as if no document but those of the sample had a label."""
    return posterior_shares(_sized(spark, sf_dir), table(spark, sf_dir, "mixture_targets"), table(spark, sf_dir, "documents", "doc_id", "text"))


def p10_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences(table(spark, sf_dir, "documents", "doc_id", "text", "lang"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_places(table(spark, sf_dir, "documents", "doc_id", "text", "lang")).select("doc_id", "end_pos")


QUERIES = {"p1_found": p1_found, "p1_evidence": p1_evidence, "p2_found": p2_found, "p2_host_share": p2_host_share, "p2_evidence": p2_evidence, "p4_found": p4_found, "p4_redacted": p4_redacted, "p5_found": p5_found, "p5_entities": p5_entities, "p6_found": p6_found, "p6_pairs": p6_pairs, "p8_containers": p8_containers, "p8_fill": p8_fill, "p9_mixture": p9_mixture, "p9_shares": p9_shares, "p9_posteriors": p9_posteriors, "p10_found": p10_found, "p10_sentences": p10_sentences}

_PAIRS = """with r as (
  select distinct 'grade_topics' as field, grade_id as key, topics as items from grades
  union all select distinct 'link_entities', link_id, entities from scraped_links
  union all select distinct 'link_topics', link_id, topics from scraped_links),
n as (select field, count(distinct key) as n from r group by field),
i as (select distinct field, key, item from (select field, key, lower(trim(unnest(items))) as item from r) where item <> ''),
m as (select field, item, count(*) as n_item from i group by field, item),
p as (select a.field, a.item as item_a, b.item as item_b, count(*) as n_ab from i a join i b on a.field = b.field and a.key = b.key and a.item < b.item group by all having count(*) >= 5)
select p.field, p.item_a, p.item_b{} from p join m x on x.field = p.field and x.item = p.item_a join m y on y.field = p.field and y.item = p.item_b join n on n.field = p.field
where p.n_ab * n.n >= 4 * x.n_item * y.n_item"""

ORACLE_SQL: dict[str, str] = {
    "p6_found": _PAIRS.format(""),
    "p6_pairs": _PAIRS.format(", p.n_ab, x.n_item as n_a, y.n_item as n_b, n.n, round(p.n_ab * n.n / (x.n_item * y.n_item), 6) as ratio, round(log2(p.n_ab * n.n / (x.n_item * y.n_item)), 6) as pmi"),
}
