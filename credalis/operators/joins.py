"""Alignment, coverage and nearest-neighbour joins. Catalyst picks the join strategy."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from credalis.functions.text import normalise_answer
from credalis.operators.ranking import spearman, top_k
from credalis.session import checkpointed


def align_by_unit(items: DataFrame, first: DataFrame, on: str = "unit") -> DataFrame:
    """Items beside their earlier scores."""
    return items.join(first, on)


def pair_conditions(df: DataFrame, key: Sequence[str], condition: str, a: str, b: str, columns: Sequence[str]) -> DataFrame:
    """Two conditions of one key side by side as ``<column>_a`` and ``<column>_b``.

    One aggregation instead of a self join; keys lacking either side are dropped.
    """
    def side(v: str) -> Column:
        return F.any_value(F.when(F.col(condition) == v, F.struct(*columns)), True)

    wide = df.filter(F.col(condition).isin(a, b)).groupBy(*key).agg(side(a).alias("_a"), side(b).alias("_b"))
    wide = wide.filter("_a is not null and _b is not null")
    return wide.select(
        *key, *[F.col(f"_a.{c}").alias(f"{c}_a") for c in columns], *[F.col(f"_b.{c}").alias(f"{c}_b") for c in columns]
    )


def model_agreement(a: DataFrame, b: DataFrame, on: Sequence[str], keys: Sequence[str], score: str) -> DataFrame:
    """Rank correlation of a score, share of equal correctness, both-wrong count.

    Keys that ``a`` lacks are taken from ``b``, so a row of ``a`` need not be repeated for each of its partners.
    """
    own = [k for k in keys if k in a.columns]
    j = a.select(*dict.fromkeys([*own, *on]), F.col(score).alias("_x"), F.col("correct").alias("_ca")).join(
        # sizes guessed before rows are exploded are far too small: a broadcast would take all rows through the driver
        b.select(*dict.fromkeys([*on, *[k for k in keys if k not in own]]), F.col(score).alias("_y"), F.col("correct").alias("_cb")).hint("merge"), list(on)
    )
    j = checkpointed(j.select(*keys, "_x", "_y", "_ca", "_cb"))  # ranks read the joined rows many times
    agg = j.groupBy(*keys).agg(
        F.avg((F.col("_ca") == F.col("_cb")).cast("double")).alias("error_agreement"),
        F.count_if(~F.col("_ca") & ~F.col("_cb")).alias("both_wrong"),
    )
    return agg.join(spearman(j, keys, "_x", "_y"), list(keys))


def log_coverage(expected: DataFrame, log: DataFrame, keys: Sequence[str], examples: int = 5) -> DataFrame:
    """Requests found in a log, missing ones and the first missing units, per experiment."""
    have = log.select("key").distinct().withColumn("_have", F.lit(True))
    j = expected.join(have, "key", "left")
    lost = F.col("_have").isNull()
    counts = j.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("requests"), F.count_if(~lost).alias("found"), F.count_if(lost).alias("missing")
    )
    first = top_k(j.filter(lost).select(*keys, "unit"), keys, [F.col("unit")], examples)
    named = first.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list("unit")), ",").alias("missing_units"))
    return counts.join(named, list(keys), "left")


def spend_estimate(expected: DataFrame, log: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct requests answered, new ones and the tokens of the new ones, per experiment."""
    one = expected.groupBy(*keys, "key").agg(F.count(F.lit(1)).alias("_times"), F.min("tokens").alias("tokens"))
    j = one.join(log.select("key").distinct().withColumn("_have", F.lit(True)), "key", "left")
    lost = F.col("_have").isNull()
    return j.groupBy(*keys).agg(
        F.sum("_times").alias("requests"), F.count_if(~lost).alias("cached"), F.count_if(lost).alias("new_requests"),
        F.sum(F.when(lost, F.col("tokens")).otherwise(0)).alias("new_tokens"),
    )


def compare_tables(left: DataFrame, right: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Shared and one-sided ids and differing fields of two copies, one row."""
    a = left.select(F.col(key).alias("_ka"), *[F.col(f).alias(f"_a_{f}") for f in fields])
    b = right.select(F.col(key).alias("_kb"), *[F.col(f).alias(f"_b_{f}") for f in fields])
    j = a.join(b, F.col("_ka") == F.col("_kb"), "full_outer")
    both = F.col("_ka").isNotNull() & F.col("_kb").isNotNull()
    differs = {f: both & ~F.col(f"_a_{f}").eqNullSafe(F.col(f"_b_{f}")) for f in fields}
    some = F.lit(False)
    for d in differs.values():
        some = some | d
    return j.agg(
        F.count_if(both).alias("shared"), F.count_if(F.col("_kb").isNull()).alias("only_left"),
        F.count_if(F.col("_ka").isNull()).alias("only_right"), F.count_if(some).alias("differing"),
        *[F.count_if(d).alias(f"{f}_differs") for f, d in differs.items()],
    )


def differing_examples(left: DataFrame, right: DataFrame, key: str, fields: Sequence[str], k: int = 5) -> DataFrame:
    """Smallest ids whose copies differ."""
    j = left.select(key, F.struct(*fields).alias("_a")).join(right.select(key, F.struct(*fields).alias("_b")), key)
    return j.filter(~F.col("_a").eqNullSafe(F.col("_b"))).select(key).orderBy(key).limit(k)


GOLD_TILE, POOL_BLOCK = 4096, 8192
"""Rows of one tile of the similarity matrix: the memory bound of a task."""
BALLS = 1024
"""Largest number of balls; their centres are held by every task."""
BALL_ROWS = 256
"""Pool answers of a ball, on average, in a smaller pool."""
LLOYD = 2
"""Times that centres move to the mean of their ball."""
PROBE = 4
"""Golds first look into the balls with the best bounds until these hold ``PROBE * k`` answers."""
WORTH = 0.5
"""Share of all pairs up to which balls are searched; beyond it every tile is."""
SLACK = 1e-9
"""Part of the norms that a bound gives way, as products round differently in tiles of other shapes."""


@dataclass(frozen=True)
class Balls:
    """Centres, radii and sizes of the balls that hold the pool."""

    centres: np.ndarray
    radius: np.ndarray
    size: np.ndarray

    def bounds(self, vectors: np.ndarray) -> np.ndarray:
        """Upper bound on the dot product of each vector with any member of each ball."""
        length = np.linalg.norm(vectors, axis=1)[:, None]
        at = vectors @ self.centres.T
        return at + length * self.radius + SLACK * length * (np.linalg.norm(self.centres, axis=1) + self.radius + 1)


def _vectors(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, float) for v in column])


def _nearest_centre(vectors: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nearest centre, distance to it) of each vector."""
    ball = ((centres**2).sum(axis=1) - 2 * vectors @ centres.T).argmin(axis=1)
    return ball, np.linalg.norm(vectors - centres[ball], axis=1)


def _in_balls(names: DataFrame, n: int) -> tuple[DataFrame, Balls]:
    """The pool with its ball, and the balls: centres start at vectors drawn by hash and move to means."""
    spark = names.sparkSession
    count = int(min(BALLS, max(1, n // BALL_ROWS)))
    start = names.orderBy(F.xxhash64("pname"), "pname").limit(count).select("pvec").toPandas()  # at most BALLS vectors
    centres = _vectors(start["pvec"])
    schema = T.StructType([*names.schema.fields, T.StructField("ball", T.IntegerType()), T.StructField("_far", T.DoubleType())])
    for turn in range(LLOYD + 1):
        held = spark.sparkContext.broadcast(centres)

        def assign(parts, held=held):
            for pdf in parts:
                if len(pdf):
                    ball, far = _nearest_centre(_vectors(pdf["pvec"]), held.value)
                    yield pdf.assign(ball=ball, _far=far)

        placed = names.mapInPandas(assign, schema)
        if turn < LLOYD:
            mean = placed.select("ball", F.posexplode("pvec").alias("d", "x")).groupBy("ball", "d").agg(F.avg("x").alias("x"))
            for r in mean.groupBy("ball").agg(F.array_sort(F.collect_list(F.struct("d", "x"))).alias("m")).select("ball", "m.x").collect():
                centres[r["ball"]] = r["x"]
    placed = checkpointed(placed)
    radius, size = np.zeros(count), np.zeros(count, int)
    for r in placed.groupBy("ball").agg(F.max("_far").alias("r"), F.count(F.lit(1)).alias("n")).collect():
        radius[r["ball"]], size[r["ball"]] = r["r"], r["n"]
    return placed.drop("_far"), Balls(centres, radius, size)


def _first_balls(balls: Balls, want: int):
    """Balls by falling bound until they hold ``want`` answers."""

    def run(parts):
        for pdf in parts:
            if len(pdf):
                bound = balls.bounds(_vectors(pdf["gvec"]))
                order = np.argsort(-bound, axis=1, kind="stable")
                held = balls.size[order].cumsum(axis=1)
                yield pdf.assign(balls=[o[: int(np.searchsorted(h, want)) + 1].tolist() for o, h in zip(order, held, strict=True)])

    return run


def _other_balls(balls: Balls):
    """Balls not yet searched whose bound reaches the similarity ``least`` found so far."""

    def run(parts):
        for pdf in parts:
            if len(pdf):
                reach = balls.bounds(_vectors(pdf["gvec"])) >= pdf["least"].to_numpy(float)[:, None]
                reach[:, balls.size == 0] = False
                for row, seen in zip(reach, pdf["balls"], strict=True):
                    row[list(seen)] = False
                yield pdf.drop(columns="least").assign(balls=[np.flatnonzero(r).tolist() for r in reach])

    return run


def _tile_winners(golds: DataFrame, pool: DataFrame, on: Sequence[str], k: int, max_sim: float, candidates: int | None) -> DataFrame:
    """Best ``k`` distinct allowed names of each gold in each tile."""

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            pm = _vectors(right["pvec"])
            pnames, pnorms = right["pname"].to_numpy(), right["pnorm"].to_numpy()
            for start in range(0, len(left), 256):
                part = left.iloc[start : start + 256]
                for row, gid, ban in zip(_vectors(part["gvec"]) @ pm.T, part["id"], part["banned"], strict=True):
                    out += _pick(row, gid, list(ban), pnames, pnorms, k, max_sim, candidates)
        return pd.DataFrame(out, columns=["id", "pname", "pnorm", "sim"])

    return golds.groupBy(*on).cogroup(pool.groupBy(*on)).applyInPandas(best, "id string, pname string, pnorm string, sim double")


def _search(golds: DataFrame, pool: DataFrame, balls: Balls, tiles: int, k: int, max_sim: float) -> DataFrame:
    """Winners among the balls that each gold lists; large balls and many golds meet in tiles."""
    parts = F.element_at(F.array(*[F.lit(int(max(1, -(-s // POOL_BLOCK)))) for s in balls.size]), F.col("ball") + 1)
    g = golds.select("id", "banned", "gvec", F.explode("balls").alias("ball"))
    g = g.withColumns({"tile": F.pmod(F.xxhash64("id"), F.lit(tiles)).cast("int"), "part": F.explode(F.sequence(F.lit(0), parts - 1))})
    p = pool.withColumns({"part": F.pmod(F.xxhash64("pname"), parts).cast("int"), "tile": F.explode(F.sequence(F.lit(0), F.lit(tiles - 1)))})
    return _tile_winners(g, p, ["ball", "part", "tile"], k, max_sim, None)


def _merged(winners: DataFrame, k: int) -> DataFrame:
    """Best ``k`` names of each gold over its tiles."""
    merged = winners.groupBy("id", "pnorm").agg(F.max(F.struct("sim", "pname")).alias("_b")).select("id", "pnorm", "_b.sim", "_b.pname")
    return top_k(merged, ["id"], [F.col("sim").desc(), F.col("pname")], k)


def nearest_distractors(
    golds: DataFrame, pool: DataFrame, k: int = 3, max_sim: float = 0.92, candidates: int | None = None,
) -> DataFrame:
    """The ``k`` most similar pool answers of each gold that are no aliases of it.

    ``golds(id, name, vector, aliases)``, ``pool(name, vector)``. Similarity is the
    dot product. A pool answer is skipped above ``max_sim``, when it equals the
    gold or an alias after normalisation, when either contains the other (both
    longer than 3), or when a nearer one normalises to the same text.

    A gold with fewer than ``k`` such answers has null distractors.

    The pool lies in balls around a bounded number of centres. A gold first searches the balls
    with the highest bounds on its similarity; the ``k``-th allowed answer found there rules out
    every ball whose bound is lower, and the rest is searched once. That is exact, as bounds
    hold for every member. Where bounds rule out little, all tiles of the similarity matrix
    are searched instead, each keeping its best ``k`` names per gold. ``candidates`` restricts
    each of those tiles to its nearest ones.
    """
    return _nearest(golds, pool, k, max_sim, candidates)[0]


def nearest_pairs(golds: DataFrame, pool: DataFrame, k: int = 3, max_sim: float = 0.92) -> DataFrame:
    """One row: golds, pool answers, and the pairs whose similarity is computed."""
    _, n_golds, n_pool, pairs = _nearest(golds, pool, k, max_sim, None)
    return golds.sparkSession.createDataFrame([(n_golds, n_pool, pairs)], "golds long, pool long, pairs long")


def _nearest(golds: DataFrame, pool: DataFrame, k: int, max_sim: float, candidates: int | None) -> tuple[DataFrame, int, int, int]:
    names = pool.filter(normalise_answer("name") != "").dropDuplicates(["name"]).select(
        F.col("name").alias("pname"), normalise_answer("name").alias("pnorm"), F.col("vector").alias("pvec")
    )
    banned = F.array_distinct(F.transform(F.concat(F.array("name"), "aliases"), normalise_answer))
    g = golds.select(F.col("id").cast("string").alias("id"), banned.alias("banned"), F.col("vector").alias("gvec"))
    n_golds, n_pool = golds.count(), names.count()
    tiles, pairs = max(1, -(-n_golds // GOLD_TILE)), n_golds * n_pool
    winners = None
    if candidates is None and n_pool >= 2 * BALL_ROWS and n_golds:
        found, spent = _by_balls(g, names, n_pool, tiles, k, max_sim, WORTH * pairs)
        if found is not None:
            winners, pairs = found, spent
    if winners is None:
        blocks = max(1, -(-n_pool // POOL_BLOCK))
        dealt = g.withColumns({"tile": F.pmod(F.xxhash64("id"), F.lit(tiles)).cast("int"), "block": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))})
        p = names.withColumns({"block": F.pmod(F.xxhash64("pname"), F.lit(blocks)).cast("int"), "tile": F.explode(F.sequence(F.lit(0), F.lit(tiles - 1)))})
        winners = _tile_winners(dealt, p, ["tile", "block"], k, max_sim, candidates)
    item = F.struct((-F.col("sim")).alias("s"), "pname")
    out = _merged(winners, k).groupBy("id").agg(F.array_sort(F.collect_list(item)).alias("_p"))
    enough = out.filter(F.size("_p") == k).select("id", F.transform("_p", lambda x: x["pname"]).alias("distractors"))
    return golds.select(F.col("id").cast("string").alias("id")).join(enough, "id", "left"), n_golds, n_pool, pairs


def _by_balls(g: DataFrame, names: DataFrame, n_pool: int, tiles: int, k: int, max_sim: float, most: float) -> tuple[DataFrame | None, int]:
    """(winners, pairs computed), or None when more than ``most`` pairs would be."""
    pool, balls = _in_balls(names, n_pool)
    sizes = F.array(*[F.lit(int(s)) for s in balls.size])
    spent = F.sum(F.aggregate("balls", F.lit(0).cast("long"), lambda a, b: a + F.element_at(sizes, b + 1)))
    schema = T.StructType([*g.schema.fields, T.StructField("balls", T.ArrayType(T.IntegerType()))])
    first = checkpointed(g.mapInPandas(_first_balls(balls, PROBE * k), schema))
    pairs = first.agg(spent).first()[0]
    if pairs > most:
        return None, pairs
    probe = checkpointed(_search(first, pool, balls, tiles, k, max_sim))
    least = _merged(probe, k).groupBy("id").agg(F.min("sim").alias("least"), F.count(F.lit(1)).alias("_n")).where(F.col("_n") == k)
    left = first.join(least.select("id", "least"), "id", "left").withColumn("least", F.coalesce("least", F.lit(float("-inf"))))
    rest = checkpointed(left.mapInPandas(_other_balls(balls), schema))
    pairs += rest.agg(spent).first()[0]
    if pairs > most:
        return None, pairs
    return probe.unionByName(_search(rest, pool, balls, tiles, k, max_sim)), pairs


def _pick(row, gid, banned, names, norms, k, max_sim, candidates) -> list[tuple]:
    """Nearest ``k`` allowed names of one gold inside one tile."""
    want = len(row) if candidates is None else min(candidates, len(row))
    reach = min(want, 64)
    while True:
        # everything at least as near as the reach-th, so equal similarities stay together
        edge = np.partition(row, len(row) - reach)[len(row) - reach]
        near = np.flatnonzero(row >= edge)
        near = near[np.lexsort((names[near], -row[near]))]
        got: list[tuple] = []
        seen: set[str] = set()
        for j in near if candidates is None else near[:want]:
            n = norms[j]
            if row[j] > max_sim or n in banned or n in seen:
                continue
            if any((n in b or b in n) for b in banned if len(b) > 3 and len(n) > 3):
                continue
            seen.add(n)
            got.append((gid, names[j], n, float(row[j])))
            if len(got) == k:
                return got
        if reach >= want:
            return got
        reach = min(want, reach * 8)


def closest_length_pair(df: DataFrame, question: str, complete: str, words: str, score: str, unit: str) -> DataFrame:
    """Complete set against the incomplete set of nearest length, per question.

    A win counts 1, a tie 0.5. The complete row is joined to its question, and the
    nearest incomplete one is the minimum of ``(|difference|, unit)``.
    """
    full = df.filter(complete).groupBy(question).agg(
        F.min_by(F.struct(F.col(words).alias("w"), F.col(score).alias("s")), unit).alias("_c")
    )
    j = df.filter(~F.col(complete)).join(full, question)
    gap = F.abs(F.col(words) - F.col("_c.w"))
    near = j.groupBy(question).agg(
        F.min(F.struct(gap.alias("gap"), F.col(unit).alias("u"), F.col(score).alias("s"))).alias("_n"), F.first("_c").alias("_c")
    )
    win = F.when(F.col("_c.s") > F.col("_n.s"), 1.0).when(F.col("_c.s") == F.col("_n.s"), 0.5).otherwise(0.0)
    return near.select(question, F.col("_n.gap").alias("gap"), win.alias("win"))


def confused_pairs(df: DataFrame, keys: Sequence[str], out: str) -> DataFrame:
    """Counts of (gold, chosen) among errors."""
    return df.filter(F.col("top") != F.col("gold")).groupBy(*keys, "gold", F.col("top").alias("chosen")).agg(
        F.count(F.lit(1)).alias(out)
    )


def confused_pair_overlap(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct and shared confusions of two models, and the share of errors on shared pairs."""
    on = [*keys, "gold", "chosen"]
    j = confused_pairs(a, keys, "na").join(confused_pairs(b, keys, "nb"), on, "full_outer")
    na, nb = F.col("na"), F.col("nb")
    return j.groupBy(*keys).agg(
        F.count(na).alias("pairs_a"), F.count(nb).alias("pairs_b"), F.count_if(na.isNotNull() & nb.isNotNull()).alias("shared"),
        (F.sum(F.when(nb.isNotNull(), na)) / F.sum(na)).alias("share_on_shared"),
    )


def order_collisions(requests: DataFrame, key: str, payload: str) -> DataFrame:
    """Keys sent with more than one payload (min and max of a digest suffice)."""
    h = F.sha2(F.col(payload), 256)
    g = requests.groupBy(key).agg(F.min(h).alias("_a"), F.max(h).alias("_b"), F.count(F.lit(1)).alias("n"))
    return g.filter("_a <> _b").select(key, "n")


def mismatch_count(new: DataFrame, saved: DataFrame, keys: Sequence[str], tol: float = 1e-9) -> DataFrame:
    """Rows whose recomputed ``p_max`` is missing in, or differs from, the saved table."""
    old = saved.select("unit", F.col("p_max").alias("_old"))
    j = new.filter("p_max is not null").join(old, "unit", "left")
    bad = F.col("_old").isNull() | (F.abs(F.col("_old") - F.col("p_max")) > tol)
    return j.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if(bad).alias("mismatches"))
