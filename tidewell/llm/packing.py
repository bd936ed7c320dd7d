"""Filling fixed-capacity containers: bounded-space best-fit packing, leftovers merged in rounds.

Every partition keeps a fixed number of open containers, puts each item where it leaves least
room, and closes the fullest when none has room. What is still open at the end of a partition is
taken apart and packed again with that of other partitions, in ever fewer partitions, down to one.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.session import materialise, spread

#: Open containers per partition and kind, partitions merged into one in each round, and kinds written into one plan.
OPEN, MERGE, KINDS = 64, 16, 500

SCHEMA = "container_kind string, capacity_tokens int, container_id string, doc_id long, piece_no int, first_token long, n_tokens long, closed boolean"


class Windows:
    """Open containers of one capacity, found by the room they have left."""

    def __init__(self, capacity: int, most: int = OPEN):
        self.capacity, self.most = capacity, most
        self.rooms: list[tuple[int, int]] = []
        self.items: dict[int, list[tuple]] = {}
        self.count = 0

    def place(self, item: tuple, size: int) -> list[list[tuple]]:
        """Put an item in; the containers that closed because of it come back."""
        k = bisect_left(self.rooms, (size, -1))
        closed = []
        if k == len(self.rooms):
            if len(self.rooms) >= self.most:
                _, fullest = self.rooms.pop(0)
                closed.append(self.items.pop(fullest))
            self.count += 1
            self.items[self.count] = []
            room, which = self.capacity, self.count
        else:
            room, which = self.rooms.pop(k)
        self.items[which].append(item)
        if room == size:
            closed.append(self.items.pop(which))
        else:
            insort(self.rooms, (room - size, which))
        return closed


def _pack(kinds: list[tuple[str, int]], label: str, last: bool):
    """A mapInPandas function over pieces (container_kind, doc_id, piece_no, first_token, n_tokens)."""
    capacities = dict(kinds)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        open_: dict[str, Windows] = {}
        made = 0
        rows: list[tuple] = []

        def write(kind: str, items: list[tuple], closed: bool) -> None:
            nonlocal made
            made += 1
            rows.extend((kind, capacities[kind], f"{label}-{part}-{made}", *i, closed) for i in items)

        for b in batches:
            for kind, *item in b.itertuples(index=False):
                w = open_.get(kind) or open_.setdefault(kind, Windows(capacities[kind]))
                for items in w.place(tuple(item), item[3]):
                    write(kind, items, True)
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])
            rows = []
        for kind, w in open_.items():
            for items in w.items.values():
                write(kind, items, last)
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    return run


def pack(items: DataFrame, containers: DataFrame) -> DataFrame:
    """items (doc_id, n_tokens), containers (container_kind, capacity_tokens) -> one row per placed piece.

    Result: container_kind, capacity_tokens, container_id, doc_id, piece_no, first_token, n_tokens,
    used_tokens (of the whole container). A document is split only if it alone exceeds the
    capacity: into pieces that fill whole containers and a rest that is packed like any other.
    Items of no tokens, null ids, and containers without a positive capacity fall away; whole-row
    copies count once; an empty table, of documents or of containers, gives an empty result.
    """
    kinds = sorted({(r.container_kind, r.capacity_tokens) for r in containers.where("capacity_tokens > 0 and container_kind is not null").select("container_kind", "capacity_tokens").collect()})
    items = items.where("doc_id is not null and n_tokens > 0").select("doc_id", "n_tokens").distinct()
    # Every document goes into a container of every kind: each row is written once per kind, KINDS of them in one pass.
    written = [items.select("doc_id", "n_tokens", F.inline(F.array(*[F.struct(F.lit(k).alias("container_kind"), F.lit(c).cast("int").alias("capacity_tokens")) for k, c in kinds[i : i + KINDS]]))) for i in range(0, len(kinds), KINDS)]
    if not written:
        return items.sparkSession.createDataFrame([], SCHEMA).drop("closed")
    whole = reduce(DataFrame.unionByName, written).withColumn("full", F.floor(F.col("n_tokens") / F.col("capacity_tokens")))
    capacity = F.col("capacity_tokens").cast("long")
    split = whole.where("full > 0").select("container_kind", "capacity_tokens", "doc_id", F.explode(F.sequence(F.lit(0), F.col("full").cast("int") - 1)).alias("piece_no"))
    filled = split.select("container_kind", "capacity_tokens", F.concat_ws("-", F.lit("w"), "doc_id", "piece_no").alias("container_id"), "doc_id", "piece_no", (F.col("piece_no") * capacity).alias("first_token"), capacity.alias("n_tokens"))
    rest = whole.where("n_tokens % capacity_tokens > 0").select("container_kind", "doc_id", F.col("full").cast("int").alias("piece_no"), (F.col("full") * capacity).alias("first_token"), (F.col("n_tokens") - F.col("full") * capacity).alias("n_tokens"))
    rest = materialise(rest, "pieces")
    placed: list[DataFrame] = []
    rest = spread(rest)
    parts, level = max(1, rest.rdd.getNumPartitions()), 0
    while True:
        packed = materialise(rest.mapInPandas(_pack(kinds, f"l{level}", parts == 1), SCHEMA), "packed")
        placed.append(packed.where("closed").drop("closed"))
        if parts == 1:
            break
        parts, level = max(1, parts // MERGE), level + 1
        # Large pieces first: what remains is few containers per partition, so this order is cheap.
        rest = packed.where("not closed").select("container_kind", "doc_id", "piece_no", "first_token", "n_tokens")
        rest = rest.repartition(parts, "doc_id").sortWithinPartitions(F.desc("n_tokens"), "doc_id", "piece_no") if parts > 1 else rest.coalesce(1).sortWithinPartitions(F.desc("n_tokens"), "doc_id", "piece_no")
    out = filled
    for p in placed:
        out = out.unionByName(p)
    return out


def container_lists(packed: DataFrame) -> DataFrame:
    """One row per container: its kind, capacity, used tokens and its documents as (doc_id, piece_no, n_tokens), in order."""
    piece = F.struct("doc_id", "piece_no", "first_token", "n_tokens")
    return packed.groupBy("container_kind", "capacity_tokens", "container_id").agg(F.sum("n_tokens").alias("used_tokens"), F.array_sort(F.collect_list(piece)).alias("pieces"))


def fill_report(packed: DataFrame) -> DataFrame:
    """(container_kind, capacity_tokens, n_containers, n_pieces, n_tokens, fill): how well each kind is used."""
    return packed.groupBy("container_kind", "capacity_tokens").agg(F.countDistinct("container_id").alias("n_containers"), F.count(F.lit(1)).alias("n_pieces"), F.sum("n_tokens").alias("n_tokens")).withColumn("fill", F.round(F.col("n_tokens") / (F.col("n_containers") * F.col("capacity_tokens")), 6))
