"""Mixing sources to target shares of the total size.

Each document belongs to the sources softly: one with a usable label to that source, any other (or
every one, where posteriors are asked for) as a classifier trained on a bounded sample of labelled
documents sees it, with its whole posterior. Projected-gradient least squares finds a rate between
0 and the cap for each document so that expected token totals match the targets. Documents of one
label have the same rate throughout, so they go as one, by their summed tokens. Of the others the
executors add up the totals in each round; a document's rate follows from the residuals so far, so
these alone are sent out, and rates are written every WRITTEN rounds.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.session import BROADCAST_ROWS, broadcast_if_small, materialise

#: Documents per source the classifier is trained on at most, and of all sources together; hash buckets of its features; steps in which the two likeliest sources are told; buckets of the draw; documents added to each group to close the last gap.
SAMPLE, SAMPLE_ALL, BUCKETS, STEPS, DRAWS, CLOSING = 400, 20_000, 1 << 14, 8, 1 << 16, 4
#: The gradient ends when no source's part of the total moved by STILL in SPAN rounds; ROUNDS without that is an error. Rounds after which executors write their rates.
STILL, SPAN, ROUNDS, WRITTEN = 1e-4, 10, 20_000, 32


def _features(text: str) -> np.ndarray:
    words = re.findall(r"\w+", text.casefold())
    return np.fromiter({zlib.crc32(w.encode()) % BUCKETS for w in words} or {0}, int)


class SourceModel:
    """Multinomial naive Bayes over hashed words."""

    def __init__(self, names: list[str], rows: list[tuple[str, str]]):
        self.names = names
        at = {s: i for i, s in enumerate(names)}
        counts = np.ones((len(names), BUCKETS)) * 0.05
        prior = np.ones(len(names))
        for source, text in rows:
            counts[at[source], _features(text)] += 1
            prior[at[source]] += 1
        self.log = np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32)
        self.prior = np.log(prior / prior.sum())

    def posterior(self, text: str) -> np.ndarray:
        f = _features(text)
        score = self.prior + self.log[:, f].sum(axis=1) / max(1.0, np.sqrt(len(f)))
        p = np.exp(score - score.max())
        return p / p.sum()

    def memberships(self, text: str) -> str:
        return likeliest(self.posterior(text))


def likeliest(p: np.ndarray) -> str:
    """The two likeliest sources, by number, with their weights in STEPS: "i:k,j:l"; these bound how often a document is repeated."""
    i, j = (np.argsort(-p, kind="stable")[:2] if len(p) > 1 else (0, 0))
    k = STEPS if i == j else int(round(STEPS * p[i] / (p[i] + p[j])))
    return f"{i}:{STEPS}" if k == STEPS else ",".join(f"{a}:{w}" for a, w in sorted(((int(i), k), (int(j), STEPS - k))))


def members_of(key: str) -> list[tuple[int, float]]:
    return [(int(a), int(w) / STEPS) for a, w in (x.split(":") for x in key.split(","))]


class Descent:
    """Documents, or groups of equal ones, on their way down the gradient.

    p (documents x sources) tells their memberships, size their tokens as a part of the wanted
    total, cap the largest rate. `lean` is the step of each source: a document's own step, that of
    its sources per token, moves small and large documents and sources alike.
    """

    def __init__(self, p: np.ndarray, size: np.ndarray, cap: np.ndarray, lean: np.ndarray, x: np.ndarray, before: np.ndarray | None = None):
        self.adds, self.cap, self.x, self.before = p * size[:, None], cap, x, x if before is None else before
        self.step = (p @ lean) / np.maximum(size, 1e-300)

    def move(self, momentum: float, residual: np.ndarray) -> None:
        y = self.x + momentum * (self.x - self.before)
        self.before, self.x = self.x, np.clip(y - self.step * (self.adds @ residual), 0, self.cap)

    def totals(self) -> np.ndarray:
        return self.x @ self.adds


def steps_of(held: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Steps of the sources from what they hold and the row sums of the scaled problem's matrix, whose largest bounds its largest singular value."""
    return np.divide(1.0, held, out=np.zeros_like(held), where=held > 0) / max(rows.max(initial=0.0), 1e-300)


def row_sums(p: np.ndarray, size: np.ndarray, held: np.ndarray) -> np.ndarray:
    return (size * (p @ np.divide(1.0, held, out=np.zeros_like(held), where=held > 0))) @ p


def descend(near: Descent, far: Callable[[list], np.ndarray], want: np.ndarray) -> None:
    """Accelerated projected gradient for |totals - want|^2, restarted where that grows.

    near moves along; far gets the moves so far, each (momentum, residual), and tells the totals of
    all other documents behind them.
    """
    moves: list[tuple[float, np.ndarray]] = []
    now = before = near.totals() + far(moves)
    trail, last, t = [now], np.inf, 1.0
    for _ in range(ROUNDS):
        off = float(((now - want) ** 2).sum())
        t = 1.0 if off > last else t
        last, t2 = off, (1 + np.sqrt(1 + 4 * t * t)) / 2
        moves.append(((t - 1) / t2, now - want + (t - 1) / t2 * (now - before)))
        t = t2
        near.move(*moves[-1])
        before, now = now, near.totals() + far(moves)
        trail.append(now)
        if len(trail) > SPAN and np.abs(now - trail[-1 - SPAN]).max() < STILL:
            return
    raise RuntimeError(f"the gradient still moves after {ROUNDS} rounds")


def projected_rates(members: list[list[tuple[int, float]]], tokens: np.ndarray, caps: np.ndarray, targets: np.ndarray, others: Others | None = None) -> np.ndarray:
    """Rates r in [0, cap] of groups that minimise |sum_g r_g tokens_g members_g - targets|^2.

    members lists the (source, weight) of each group, weights adding up to 1. With `others`, their
    documents are part of the sum, each with a rate of its own, which `others` holds behind it.
    """
    p = np.zeros((len(members), len(targets)))
    for g, m in enumerate(members):
        for s, w in m:
            p[g, s] += w
    total = max(targets.sum(), 1e-300)
    size = tokens / total
    held = size @ p + (others.tokens / total if others else 0.0)
    rows = row_sums(p, size, held) + (others.rows(held, total) if others else 0.0)
    start = min(1.0, 1 / max(size @ caps + (others.capped / total if others else 0.0), 1e-12))
    lean = steps_of(held, rows)
    near = Descent(p, size, caps, lean, start * caps)
    descend(near, others.begin(total, lean, start) if others else lambda _: np.zeros(len(targets)), targets / total)
    return near.x


def _vectors(cells: pd.Series, n: int) -> np.ndarray:
    """Posteriors of a batch, each written as its numbers in a row."""
    return np.frombuffer(b"".join(cells), np.float32).reshape(-1, n).astype(float)


class Others:
    """Documents with posteriors: soft (n_tokens, cap, p), whose rates and sums the executors make.

    Up to BROADCAST_ROWS of them are fetched and moved at once; the moves are the same.
    """

    def __init__(self, soft: DataFrame, n: int):
        self.n, self.soft, self.moves, self.done = n, soft, [], 0
        zero = {"tokens": np.zeros(n), "most": np.zeros(n), "all": np.zeros(3)}

        def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            got, least = {k: v.copy() for k, v in zero.items()}, np.full(n + 1, np.inf)
            for b in batches:
                if len(b):
                    p, size, cap = _vectors(b["p"], n), b["n_tokens"].to_numpy(float), b["cap"].to_numpy(float)
                    got["tokens"] += size @ p
                    got["most"] += (size * cap) @ p
                    got["all"] += len(b), size.sum(), (size * cap).sum()
                    np.minimum.at(least, p.argmax(axis=1), size)
                    least[n] = min(least[n], size.min())
            yield pd.DataFrame({"sums": [np.concatenate([*got.values()]).tobytes()], "least": [least.tobytes()]})

        rows = self.soft.select("p", "n_tokens", "cap").mapInPandas(sums, "sums binary, least binary").collect()
        added = sum((np.frombuffer(r.sums) for r in rows), np.zeros(2 * n + 3))
        least = np.min([np.full(n + 1, np.inf), *(np.frombuffer(r.least) for r in rows)], axis=0)
        self.tokens, self.most, (self.docs, self.size, self.capped) = added[:n], added[n : 2 * n], added[2 * n :]
        self.least = np.where(np.isinf(least[:n]), least[n], least[:n])
        self.near = self.soft.select("p", "n_tokens", "cap").toPandas() if 0 < self.docs <= BROADCAST_ROWS else None

    def _sum(self, make: Callable[[pd.DataFrame], np.ndarray], df: DataFrame) -> np.ndarray:
        def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            yield pd.DataFrame({"sums": [sum((make(b) for b in batches if len(b)), np.zeros(n)).tobytes()]})

        n = self.n
        return sum((np.frombuffer(r.sums) for r in df.mapInPandas(sums, "sums binary").collect()), np.zeros(n))

    def rows(self, held: np.ndarray, total: float) -> np.ndarray:
        n = self.n
        make = lambda b: row_sums(_vectors(b["p"], n), b["n_tokens"].to_numpy(float) / total, held)
        return make(self.near) if self.near is not None else self._sum(make, self.soft.select("p", "n_tokens"))

    def begin(self, total: float, lean: np.ndarray, start: float) -> Callable[[list], np.ndarray]:
        """What `descend` asks: the totals behind the moves so far."""
        n = self.n

        def placed(b: pd.DataFrame, moves: list) -> Descent:
            cap = b["cap"].to_numpy(float)
            at = (b["x"].to_numpy(float), b["x_before"].to_numpy(float)) if "x" in b else (start * cap,)
            d = Descent(_vectors(b["p"], n), b["n_tokens"].to_numpy(float) / total, cap, lean, *at)
            for m in moves:
                d.move(*m)
            return d

        self.placed = placed
        if self.near is not None:
            near = placed(self.near, [])

            def at_hand(moves: list) -> np.ndarray:
                if moves:
                    near.move(*moves[-1])
                self.moves = moves
                return near.totals()

            return at_hand

        def far(moves: list) -> np.ndarray:
            if len(moves) - self.done > WRITTEN:
                self.soft = materialise(self._moved(moves[self.done : -1]), "rates")
                self.done = len(moves) - 1
            self.moves, left = moves, moves[self.done :]
            return self._sum(lambda b: placed(b, left).totals(), self.soft.drop("doc_id", "source"))

        return far

    def _moved(self, moves: list) -> DataFrame:
        placed, columns = self.placed, [c for c in self.soft.columns if c not in ("x", "x_before")]

        def rates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if len(b):
                    d = placed(b, moves)
                    yield b[columns].assign(x=d.x, x_before=d.before)

        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in self.soft.schema if f.name in columns)
        return self.soft.mapInPandas(rates, f"{schema}, x double, x_before double")

    def rated(self) -> DataFrame:
        """The documents with their rate x."""
        return self._moved(self.moves[self.done :]).drop("x_before")


def _total(shares: np.ndarray, least: np.ndarray, most: np.ndarray, held: float, grain: float = 0.0) -> float:
    """The total at which the shares come out best, and of equally good ones the largest: a source gives between one document and all it may.

    Where documents are drawn one by one, `grain` is their mean size: what a draw misses by counts too.
    """
    has = shares > 0
    low, high, want = least[has], np.maximum(most[has], least[has]), shares[has]

    def off(total: float) -> float:
        got = np.clip(want * total, low, high)
        return round(float(np.abs(got / got.sum() - want).sum() + np.sqrt(want * grain / total).sum()), 9)

    totals = [t for t in {held, *(high / want), *(low / want), *(np.geomspace(low.min(), held, 100) if grain else ())} if t <= held]
    return min(totals, key=lambda t: (off(t), -t))


def mixture(documents: DataFrame, targets: DataFrame, total_tokens: float | None = None, texts: DataFrame | None = None) -> DataFrame:
    """documents (doc_id, source, n_tokens), texts (doc_id, text; by default documents), targets (source, target_share, max_repeats) -> (doc_id, source, n_tokens, repeats).

    Each chosen record comes once with its repeats, at most max_repeats of its source. Without
    total_tokens the total is the one at which the shares come out best, the largest at which all
    can be met if there is any (no more than the tokens there are); a source without documents can't be met and is passed over, and one with
    documents gets one at least. Sources without target get rate 0; null ids and texts without
    tokens fall away; whole-row copies count once; an empty table gives an empty result.
    """
    return _mix(documents, targets, total_tokens, documents if texts is None else texts, False)[0].select("doc_id", "source", "n_tokens", "repeats")


def _mix(documents: DataFrame, targets: DataFrame, total_tokens: float | None, texts: DataFrame, posteriors: bool) -> tuple[DataFrame, list[str]]:
    """The chosen records with their posteriors p, and the names of the sources; with `posteriors` no label but the sample's is used."""
    told = targets.where("source is not null and target_share > 0").groupBy("source").agg(F.sum("target_share").alias("share"), F.max("max_repeats").alias("cap")).collect()
    spark = documents.sparkSession
    names = sorted(r.source for r in told)
    share = {r.source: r.share for r in told}
    cap = {r.source: max(1, r.cap or 1) for r in told}
    at = {s: i for i, s in enumerate(names)}
    texts = texts.select("doc_id", "text").where("doc_id is not null")
    rows = documents.where("doc_id is not null and n_tokens > 0").select("doc_id", "source", "n_tokens")
    nothing = rows.limit(0).select("doc_id", "source", "n_tokens", F.lit(0).alias("repeats"), F.lit(None).cast("binary").alias("p")), names
    if not names:
        return nothing
    numbers = spark.createDataFrame([(s, f"{i}:{STEPS}") for s, i in at.items()], "source string, group string")
    numbers = F.broadcast(numbers) if len(names) <= BROADCAST_ROWS else numbers
    labelled = rows.join(numbers, "source", "left").select("doc_id", "source", "n_tokens", "group")
    if not posteriors and not labelled.where("group is null").limit(1).count():
        # Every document has a usable label: its membership is that source alone.
        known, soft = labelled.distinct(), None
    else:
        # Of each source at most SAMPLE documents, the first by hash in each of as many slots; only their texts are fetched.
        slots = max(1, min(SAMPLE, SAMPLE_ALL // len(names)))
        picked = labelled.where("group is not null").withColumn("_h", F.xxhash64("doc_id")).groupBy("source", F.pmod("_h", F.lit(slots)).alias("_b")).agg(F.min_by("doc_id", "_h").alias("doc_id"))
        sample = texts.join(broadcast_if_small(picked.select("doc_id", "source"), max(SAMPLE_ALL, BROADCAST_ROWS)), "doc_id")
        model = SourceModel(names, [(r.source, r.text or "") for r in sample.select("source", "text").limit(max(SAMPLE_ALL, len(names))).collect()])

        def belong(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                seen = [model.posterior(t or "").astype(np.float32) for t in b["text"]]
                yield b[["doc_id", "source", "n_tokens"]].assign(cap=[min(cap[names[j]] for j, _ in members_of(likeliest(p))) for p in seen], p=[p.tobytes() for p in seen])

        open_rows = labelled if posteriors else labelled.where("group is null")
        fetched = texts.join(broadcast_if_small(open_rows.drop("group")), "doc_id").select("doc_id", "source", "n_tokens", "text")
        soft = materialise(fetched.mapInPandas(belong, "doc_id long, source string, n_tokens long, cap int, p binary").distinct(), "posteriors")
        known = labelled.limit(0) if posteriors else labelled.where("group is not null").distinct()
    known = materialise(known, "memberships")
    groups = known.groupBy("group").agg(F.sum("n_tokens").alias("tokens"), F.min("n_tokens").alias("least"), F.count(F.lit(1)).alias("docs")).orderBy("group").collect()
    others = Others(soft, len(names)) if soft is not None else None
    others = others if others and others.docs else None
    if not groups and not others:
        return nothing
    members = [members_of(g.group) for g in groups]
    caps = np.array([float(min(cap[names[j]] for j, _ in m)) for m in members])
    tokens = np.array([g.tokens for g in groups], float)
    shares = np.array([share[s] for s in names])
    most, least = (others.most, others.least) if others else (np.zeros(len(names)), np.full(len(names), np.inf))
    for m, g, k in zip(members, groups, caps):
        for j, w in m:
            most[j] += w * g.tokens * k
            least[j] = min(least[j], g.least)
    shares = np.where(most > 0, shares, 0.0)
    shares /= max(shares.sum(), 1e-300)
    held = tokens.sum() + (others.size if others else 0.0)
    total = total_tokens or _total(shares, least, most, held, held / others.docs if posteriors else 0.0)
    rates = projected_rates(members, tokens, caps, shares * total, others)
    by_label = _by_label(known, groups, rates)
    if not others:
        return by_label, names
    drawn = materialise(_whole(materialise(others.rated().where("x > 0"), "rated"), len(names)).where("repeats > 0"), "drawn")
    return drawn if posteriors else by_label.unionByName(drawn), names


def _whole(rated: DataFrame, n: int) -> DataFrame:
    """Whole repeats of documents with rate x: those between two are settled one after the other, each so that what rates and repeats differ by, carried on, stays small in every source."""
    base = F.floor(F.col("x") + F.lit(1e-9)).cast("int")
    rated = rated.withColumn("repeats", base).withColumn("part", F.col("x") - base)
    between = rated.where("part > 1e-9")

    def settled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        off = np.zeros(n)
        for b in batches:
            if len(b):
                adds, more = _vectors(b["p"], n) * b["n_tokens"].to_numpy(float)[:, None], []
                for a, part in zip(adds, b["part"]):
                    more.append(int(2 * (off @ a) + (1 - 2 * part) * (a @ a) < 0))
                    off += (more[-1] - part) * a
                yield b[["doc_id", "source", "n_tokens", "repeats", "p"]].assign(repeats=b["repeats"] + more)

    lines = between.repartition(1 + between.count() // BROADCAST_ROWS, "doc_id").sortWithinPartitions(F.xxhash64("doc_id"), "doc_id")
    drawn = lines.mapInPandas(settled, "doc_id long, source string, n_tokens long, repeats int, p binary")
    return rated.where("part <= 1e-9").select("doc_id", "source", "n_tokens", "repeats", "p").unionByName(drawn)


def _by_label(known: DataFrame, groups: list, rates: np.ndarray) -> DataFrame:
    """The chosen records of groups that stand for sources."""
    spark = known.sparkSession
    few = len(groups) <= BROADCAST_ROWS
    small = lambda rows, schema: F.broadcast(spark.createDataFrame(rows, schema)) if few else spark.createDataFrame(rows, schema)
    # Whole repeats for all, and the fraction to documents in the order of a hash, up to the tokens it stands for.
    chosen = small([(g.group, float(r), float(g.tokens)) for g, r in zip(groups, rates)], "group string, rate double, held double")
    drawn = known.join(chosen, "group").withColumn("draw", F.pmod(F.xxhash64("doc_id"), F.lit(DRAWS)).cast("int")).withColumn("base", F.floor(F.col("rate") + F.lit(1e-9)).cast("int"))
    # Tokens up to each draw, from a histogram of at most DRAWS rows a group.
    hist = drawn.groupBy("group", "draw").agg(F.sum("n_tokens").alias("k"))
    line = Window.partitionBy("group").orderBy("draw")
    edges = hist.withColumn("upto", F.sum("k").over(line)).join(chosen, "group")
    part = (F.col("rate") - F.floor(F.col("rate") + F.lit(1e-9))) * F.col("held")
    limits = edges.where(F.col("upto") - F.col("k") / 2 <= part).groupBy("group").agg(F.max("draw").alias("limit"))
    out = drawn.join(F.broadcast(limits) if few else limits, "group", "left").withColumn("repeats", F.col("base") + F.when(F.col("draw") <= F.coalesce("limit", F.lit(-1)), 1).otherwise(0))
    out = materialise(out, "drawn")
    # The hash order stops short of the wanted tokens by part of a document: add what comes nearest to the gap, and to an empty group its smallest.
    got = {r.group: r.k for r in out.groupBy("group").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("k")).collect()}
    want = {g.group: float(r) * g.tokens for g, r in zip(groups, rates)}
    added: list[tuple[str, int]] = []
    for _ in range(CLOSING):
        open_ = [(g, w - got.get(g, 0), not got.get(g, 0)) for g, w in want.items() if w - got.get(g, 0) >= 1]
        left = small(open_ or [("", 0.0, False)], "group string, gap double, empty boolean")
        taken = small(added or [("", -1)], "group string, doc_id long")
        free = out.where((F.col("repeats") == F.col("base")) & (F.col("repeats") < F.ceil(F.col("rate")))).join(taken, ["group", "doc_id"], "left_anti").join(left, "group")
        best = free.where("empty or n_tokens < 2 * gap").groupBy("group").agg(F.min(F.struct(F.abs(F.col("n_tokens") - F.col("gap")).alias("off"), "doc_id", "n_tokens")).alias("one")).collect()
        for r in best:
            added.append((r.group, r.one.doc_id))
            got[r.group] = got.get(r.group, 0) + r.one.n_tokens
        if not best:
            break
    more = small(added or [("", -1)], "group string, doc_id long").withColumn("more", F.lit(1))
    repeats = F.col("repeats") + F.coalesce("more", F.lit(0))
    return out.join(more, ["group", "doc_id"], "left").withColumn("repeats", repeats).where("repeats > 0").select("doc_id", "source", "n_tokens", "repeats", F.lit(None).cast("binary").alias("p"))


def posterior_shares(documents: DataFrame, targets: DataFrame, texts: DataFrame) -> DataFrame:
    """(source, target_share, expected_share, actual_share): a mix that trusts the classifier's posteriors alone.

    expected_share counts each chosen document to the sources its posterior names, actual_share to
    its label. The two differ by what the classifier can't tell; an empty table gives no rows.
    """
    chosen, names = _mix(documents, targets, None, texts, True)
    chosen = materialise(chosen.withColumn("k", F.col("n_tokens") * F.col("repeats")), "posterior_mix")
    n = len(names)

    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        k = sum((b["k"].to_numpy(float) @ _vectors(b["p"], n) for b in batches if len(b)), np.zeros(n))
        yield pd.DataFrame({"source": names, "k": k})

    expected = chosen.select("k", "p").mapInPandas(parts, "source string, k double").groupBy("source").agg(F.sum("k").alias("expected"))
    actual = chosen.groupBy("source").agg(F.sum("k").alias("actual"))
    total = chosen.agg(F.sum("k").alias("total"))
    wanted = targets.where("source is not null").groupBy("source").agg(F.sum("target_share").alias("target_share"))
    both = wanted.join(expected, "source", "left").join(actual, "source", "left").join(F.broadcast(total), F.lit(True))
    part = lambda c: F.round(F.coalesce(c, F.lit(0)) / F.col("total"), 6)
    return both.where("total > 0").select("source", "target_share", part("expected").alias("expected_share"), part("actual").alias("actual_share"))


def mixture_shares(chosen: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, n_docs, n_tokens, actual_share, max_repeats_used): what each source contributes in the end."""
    got = chosen.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("n_tokens") * F.col("repeats")).alias("n_tokens"), F.max("repeats").alias("max_repeats_used"))
    total = got.agg(F.sum("n_tokens").alias("total"))
    wanted = targets.where("source is not null").groupBy("source").agg(F.sum("target_share").alias("target_share"))
    both = wanted.join(got, "source", "full").join(F.broadcast(total), F.lit(True))
    return both.select("source", "target_share", F.coalesce("n_docs", F.lit(0)).alias("n_docs"), F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"), F.round(F.coalesce("n_tokens", F.lit(0)) / F.col("total"), 6).alias("actual_share"), F.coalesce("max_repeats_used", F.lit(0)).alias("max_repeats_used"))
