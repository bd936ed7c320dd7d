"""Items that appear together: pair counts and their ratio to chance."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.session import BROADCAST_ROWS, materialise

#: A pair counts from MIN_TOGETHER records on, and from LIFT times what chance gives.
MIN_TOGETHER, LIFT = 5, 4
#: Items from which the pairs of one basket are made by several tasks.
LARGE = 500


def baskets(records: DataFrame, key: str, items: str, field: str) -> DataFrame:
    """records -> (field, key, items): items without outer spaces, in lower case, once each and sorted; whole-row copies once.

    Null keys fall away; null and empty arrays stay as records without items, null and blank items are left out.
    """
    clean = F.filter(F.transform(F.coalesce(F.col(items), F.array().cast("array<string>")), lambda x: F.lower(F.trim(x))), lambda x: x.isNotNull() & (x != ""))
    return records.where(F.col(key).isNotNull()).select(F.lit(field).alias("field"), F.col(key).alias("key"), F.array_sort(F.array_distinct(clean)).alias("items")).groupBy("field", "key", "items").agg(F.lit(1).alias("_one")).drop("_one")


def frequent_pairs(rows: list[DataFrame], min_together: int = MIN_TOGETHER, lift: float = LIFT) -> DataFrame:
    """Baskets (field, key, items) -> (field, item_a, item_b, n_ab, n_a, n_b, n, ratio, pmi), item_a the smaller in code point order.

    An item in more than one in `lift` of all records can't reach the ratio with any other
    (n_ab <= n_b), nor can one in fewer than min_together records reach the count; both are known
    from the marginals, before any pair is made. Pairs are combined map-side.
    """
    all_rows = materialise(reduce(DataFrame.unionByName, rows), "baskets")
    totals = all_rows.groupBy("field").agg(F.count(F.lit(1)).alias("n"))
    marginals = all_rows.select("field", F.explode("items").alias("item")).groupBy("field", "item").agg(F.count(F.lit(1)).alias("n_item")).where(F.col("n_item") >= min_together)
    marginals = materialise(marginals.join(F.broadcast(totals), "field").where(F.col("n_item") * F.lit(lift) <= F.col("n")), "marginals")
    able = marginals.select("field", "item")
    if able.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        # Both members of a pair are looked up where the pair is made, so nothing of the others is shuffled.
        listed, only = all_rows, lambda df, c: df.join(F.broadcast(able.withColumnRenamed("item", c)), ["field", c], "left_semi")
    else:
        listed = all_rows.select("field", "key", F.explode("items").alias("item")).join(able, ["field", "item"], "left_semi").groupBy("field", "key").agg(F.array_sort(F.collect_list("item")).alias("items"))
        listed, only = materialise(listed, "able"), lambda df, c: df
    listed = listed.where("size(items) > 1")
    # Two generators in a row stream the pairs of a basket; those of a large one are spread by their first item.
    opened = lambda df: df.select("field", "key", "items", F.posexplode("items").alias("i", "item_a")).where("i + 1 < size(items)").select("field", "key", "item_a", F.slice("items", F.col("i") + 2, F.size("items")).alias("rest"))
    firsts = only(opened(listed.where(F.size("items") <= LARGE)), "item_a").unionByName(only(opened(listed.where(F.size("items") > LARGE)), "item_a").repartition("field", "key", "item_a"))
    pairs = only(firsts.select("field", "item_a", F.explode("rest").alias("item_b")), "item_b").groupBy("field", "item_a", "item_b").agg(F.count(F.lit(1)).alias("n_ab")).where(F.col("n_ab") >= min_together)
    side = lambda c: marginals.select("field", F.col("item").alias(f"item_{c}"), F.col("n_item").alias(f"n_{c}"))
    both = pairs.join(side("a"), ["field", "item_a"]).join(side("b"), ["field", "item_b"]).join(F.broadcast(totals), "field")
    ratio = F.col("n_ab") * F.col("n") / (F.col("n_a") * F.col("n_b"))
    return both.where(F.col("n_ab") * F.col("n") >= F.lit(lift) * F.col("n_a") * F.col("n_b")).select("field", "item_a", "item_b", "n_ab", "n_a", "n_b", "n", F.round(ratio, 6).alias("ratio"), F.round(F.log2(ratio), 6).alias("pmi"))
