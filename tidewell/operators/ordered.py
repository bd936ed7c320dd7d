"""Operators on order that no single group of any size can slow down.

Rows are range-partitioned by group and order and written once; each partition works on its own,
and a summary of one row per partition carries what crosses the borders.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.session import materialise


def _placed(df: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    by = [*group, *order]
    return materialise(df.repartitionByRange(*[F.col(c).asc_nulls_first() for c in by]).sortWithinPartitions(*by).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()), "placed")


def row_numbers(df: DataFrame, group: list[str], order: list[str], name: str = "rn") -> DataFrame:
    """Number the rows of each group from 1 in the order given, ties in any order; null keys form a group."""
    placed = _placed(df, group, order)
    key = F.to_json(F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in group]))
    keyed = placed.withColumn("_key", F.xxhash64(key))
    ends = keyed.groupBy("_part").agg(F.min_by("_key", "_at").alias("first"), F.max_by("_key", "_at").alias("last"))
    # Only the first and the last key of a partition can reach across its borders.
    counts = {(r._part, r._key): r.n for r in keyed.join(F.broadcast(ends), "_part").where("_key = first or _key = last").groupBy("_part", "_key").agg(F.count(F.lit(1)).alias("n")).collect()}
    order_of = sorted((r._part, r.first, r.last) for r in ends.collect())
    carried: dict[int, tuple[int, int]] = {}
    open_key, total = None, 0
    for part, first, last in order_of:
        offset = total if first == open_key else 0
        carried[part] = (first, offset)
        total = counts[part, last] + (offset if first == last else 0)
        open_key = last
    names = df.columns

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at: dict[int, tuple] = {}
        for b in batches:
            out = []
            for part, k in zip(b["_part"], b["_key"]):
                now = at.get(part)
                if now is None:
                    first, offset = carried[part]
                    now = (k, offset + 1)
                elif now[0] == k:
                    now = (k, now[1] + 1)
                else:
                    now = (k, 1)
                at[part] = now
                out.append(now[1])
            b[name] = out
            yield b[[*names, name]]

    # Files may be split or merged in reading; sorting by place restores the order within each partition.
    again = keyed.repartition("_part").sortWithinPartitions("_part", "_at")
    return again.mapInPandas(number, ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema] + [f"{name} long"]))


def last_marked(df: DataFrame, group: list[str], order: str, mark: str, name: str) -> DataFrame:
    """For each row the latest `order` value at or before it, in its group, where `mark` is true; null before the first."""
    placed = _placed(df, group, [order])
    heads = placed.where(F.col(mark)).groupBy("_part", *group).agg(F.max(order).alias("_last"))
    # What a partition's first group inherits: the last mark of that group in any partition before it.
    parts = placed.groupBy("_part").agg(F.min_by(F.struct(*group), "_at").alias("_g"))
    inherit = parts.select("_part", *[F.col(f"_g.{c}").alias(c) for c in group]).alias("p").join(heads.alias("h"), [F.col(f"p.{c}").eqNullSafe(F.col(f"h.{c}")) for c in group] + [F.col("h._part") < F.col("p._part")]).groupBy("p._part", *[F.col(f"p.{c}") for c in group]).agg(F.max("h._last").alias("_before"))

    within = Window.partitionBy("_part", *group).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    filled = placed.withColumn("_own", F.last(F.when(F.col(mark), F.col(order)), ignorenulls=True).over(within))
    return filled.join(inherit, ["_part", *group], "left").withColumn(name, F.coalesce("_own", "_before")).drop("_part", "_at", "_own", "_before")


class _Runs:
    """The greedy rule on rows that follow, for a batch opened at each of the first `starts` of them: runs that meet go on as one."""

    def __init__(self, budget: int, most: int, starts: int):
        self.budget, self.most, self.starts, self.rows, self.head, self.live = budget, most, starts, 0, [], []

    def add(self, size: int) -> None:
        for run in self.live:
            if run[0] + size > self.budget or run[1] >= self.most:
                run[:3] = 0, 0, run[2] + 1
            run[:2] = run[0] + size, run[1] + 1
        if self.rows < self.starts:
            self.head.append(size)
            self.live.append([size, 1, 1, {self.rows: 0}])
        self.rows += 1
        if len(self.live) > 1:
            met: dict = {}
            for run in self.live:
                first = met.setdefault((run[0], run[1]), run)
                if first is not run:
                    first[3].update({k: lead + run[2] - first[2] for k, lead in run[3].items()})
            self.live = list(met.values())

    def summary(self) -> tuple[list[int], list[list[int]]]:
        """The first sizes, and for a batch opened at each of them what is open at the end: (used, messages, batches opened)."""
        ends = {k: [used, n, opened + lead] for used, n, opened, leads in self.live for k, lead in leads.items()}
        return self.head, [ends[k] for k in range(len(self.head))]


def _carried(now: tuple[int, int, int], head: list[int], ends: list[list[int]], budget: int, most: int) -> tuple[int, int, int]:
    """The open batch (number, used, messages) after rows with this summary, where `now` was open before; (-1, 0, 0): none was."""
    number, used, n = now
    for k, size in enumerate(head):
        if not n or used + size > budget or n >= most:
            return number + ends[k][2], ends[k][0], ends[k][1]
        used, n = used + size, n + 1
    return number, used, n


def greedy_batches(df: DataFrame, group: list[str], order: list[str], size: str, budget: int, most: int, name: str) -> DataFrame:
    """Number from 0 the batches of each group in the order given; one closes before the row that would exceed the budget or the number of rows. Null keys form a group."""
    placed = _placed(df, group, order)
    key = F.to_json(F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in group]))
    # Files may be split or merged in reading; sorting by place restores the order within each partition.
    again = placed.withColumn("_key", key).repartition("_part").sortWithinPartitions("_part", "_at")

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Of each partition only the first and the last group can reach across its borders.
        part = first = last = None
        done = []

        def told() -> tuple:
            (a, run), (b, end) = first, last
            head, ends = run.summary()
            tail = end.summary()[1][0] if end is not run else None
            return part, a, b, head, ends, tail

        for b in batches:
            for p, k, x in zip(b["_part"], b["_key"], b[size]):
                if p != part:
                    if part is not None:
                        done.append(told())
                    part, first = p, (k, _Runs(budget, most, most))
                    last = first
                elif k != last[0]:
                    last = (k, _Runs(budget, most, 1))
                last[1].add(x)
        if part is not None:
            done.append(told())
        yield pd.DataFrame(done, columns=["part", "first", "last", "head", "ends", "tail"])

    summaries = again.select("_part", "_at", "_key", size).mapInPandas(summed, "part int, first string, last string, head array<long>, ends array<array<long>>, tail array<long>").collect()
    carried: dict[int, tuple[int, int, int]] = {}
    open_key, now = None, (-1, 0, 0)
    for r in sorted(summaries, key=lambda r: r.part):
        carried[r.part] = now if r.first == open_key else (-1, 0, 0)
        now = _carried(carried[r.part], r.head, r.ends, budget, most) if r.tail is None else (r.tail[2] - 1, r.tail[0], r.tail[1])
        open_key = r.last
    names = df.columns

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = key = None
        for b in batches:
            out = []
            for p, k, x in zip(b["_part"], b["_key"], b[size]):
                if p != part:
                    no, used, n = carried[p]
                elif k != key:
                    no, used, n = -1, 0, 0
                part, key = p, k
                if not n or used + x > budget or n >= most:
                    no, used, n = no + 1, 0, 0
                used, n = used + x, n + 1
                out.append(no)
            b[name] = out
            yield b[[*names, name]]

    return again.mapInPandas(number, ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema] + [f"{name} long"]))
