"""Resamples drawn from a dyadic tree of counts over score buckets.

Rows collapse to buckets: the range of a score is halved ``DEPTH`` times, and a bucket that
holds several values and a large share of its key is opened again over its own range. A
bucket keeps counts, means and variances, so a score with few values loses nothing and a
continuous one costs as many buckets as any other.

A resample of ``n`` rows starts with ``n`` at the root and is split downwards: the left half
of a node takes a binomial part of what the node got (a hypergeometric part for draws
without replacement). That is the exact multinomial law of the buckets. Neighbours that a
metric cannot tell apart are one bucket. Inside a bucket, sums have their exact mean and
variance given the count, as a normal draw; ranks are tied; and estimates are moved by what
bucketing changes in the estimate of the data.

One row per key and block of draws, with the key's buckets as a bounded array, goes to the
tasks. Draws depend on the seed, the key and the block only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from credalis.functions.seeded import key_hash
from credalis.functions.statfn import hypergeometric_inverse
from credalis.operators.prefix import attach_rows, null_safe_join
from credalis.session import checkpointed

DEPTH = 11
"""Halvings of a score's range."""
PAIR_DEPTH = 7
"""Halvings of each of two scores' ranges."""
OPEN_SHARE = 1 / 512
"""A bucket with a larger share of its key's rows is opened."""
OPEN_DEPTH = 5
ROUNDS = 4
"""Times that buckets are opened."""
DRAWS = 40
"""Resamples of one key that a task makes at once."""
HYPERGEOMETRIC = 10**9
"""Numpy draws hypergeometric numbers below this count only."""


def _cell(x: str, low: str, high: str, depth: int) -> Column:
    part = F.floor((F.col(x) - F.col(low)) / (F.col(high) - F.col(low)) * F.lit(float(1 << depth)))
    return F.when(F.col(high) > F.col(low), F.least(part, F.lit((1 << depth) - 1))).otherwise(0).cast("long")


def _moments(by: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Range and, for each flag, count, mean and variance of ``_x`` per bucket."""
    aggs = [F.min("_x").alias("_low"), F.max("_x").alias("_high"), F.avg("_x").alias("x")]
    for k, on in ((0, ~F.col("_f")), (1, F.col("_f"))):
        x = F.when(on, F.col("_x"))
        aggs += [F.count(x).alias(f"n{k}"), F.coalesce(F.avg(x), F.lit(0.0)).alias(f"m{k}"), F.coalesce(F.var_pop(x), F.lit(0.0)).alias(f"v{k}")]
    return by.groupBy(*keys).agg(*aggs)


def buckets(df: DataFrame, keys: Sequence[str], value: str | Column, flag: str | Column | None = None) -> DataFrame:
    """(keys, x, n0, m0, v0, n1, m1, v1) per bucket; rows without value or flag are left out."""
    keys = list(keys)
    x = F.col(value) if isinstance(value, str) else value
    f = F.lit(False) if flag is None else F.col(flag) if isinstance(flag, str) else flag
    base = df.select(*keys, x.cast("double").alias("_x"), f.cast("boolean").alias("_f")).where("_x is not null and _f is not null")
    span = base.groupBy(*keys).agg(F.min("_x").alias("_a"), F.max("_x").alias("_b"), F.count(F.lit(1)).alias("_n"))
    rows = attach_rows(base, span, keys).withColumn("_cell", _cell("_x", "_a", "_b", DEPTH))
    found = []
    for k in range(ROUNDS + 1):
        level = checkpointed(_moments(rows, [*keys, "_n", "_cell"]))
        wide = (F.col("n0") + F.col("n1") > F.col("_n") * OPEN_SHARE) & (F.col("_low") < F.col("_high"))
        if k == ROUNDS or not level.where(wide).limit(1).count():
            found.append(level)
            break
        found.append(level.where(~wide))
        opened = level.where(wide).select(*keys, "_cell", F.col("_low").alias("_l"), F.col("_high").alias("_h"))
        rows = null_safe_join(rows, opened, [*keys, "_cell"])
        rows = rows.withColumn("_cell", F.col("_cell") * (1 << OPEN_DEPTH) + _cell("_x", "_l", "_h", OPEN_DEPTH)).drop("_l", "_h")
    return reduce(DataFrame.unionByName, found).select(*keys, *FIELDS)


def pair_buckets(df: DataFrame, keys: Sequence[str], a: str, c: str, flag: str | Column | None = None) -> DataFrame:
    """Buckets of two scores together: (keys, i, j, x, y, n0, n1), with the means ``x`` and ``y`` of row i and column j."""
    keys = list(keys)
    f = F.lit(False) if flag is None else F.col(flag) if isinstance(flag, str) else flag
    base = df.select(*keys, F.col(a).cast("double").alias("_x"), F.col(c).cast("double").alias("_y"), f.cast("boolean").alias("_f"))
    base = base.where("_x is not null and _y is not null and _f is not null")
    span = base.groupBy(*keys).agg(F.min("_x").alias("_a"), F.max("_x").alias("_b"), F.min("_y").alias("_c"), F.max("_y").alias("_d"))
    rows = attach_rows(base, span, keys)
    for out, v, low, high in (("i", "_x", "_a", "_b"), ("j", "_y", "_c", "_d")):
        rows = rows.withColumn(out, _cell(v, low, high, PAIR_DEPTH))
    return rows.groupBy(*keys, "i", "j").agg(
        F.avg("_x").alias("x"), F.avg("_y").alias("y"), F.count_if(~F.col("_f")).alias("n0"), F.count_if("_f").alias("n1")
    )


FIELDS = ("x", "n0", "m0", "v0", "n1", "m1", "v1")
PAIR_FIELDS = ("i", "j", "x", "y", "n0", "n1")


def split_counts(n: np.ndarray, total: int, draws: int, rng: np.random.Generator, replace: bool = True) -> np.ndarray:
    """(draws, len(n)) counts of resamples of ``total`` rows, split from the root of a binary tree."""
    n = np.asarray(n, np.int64)
    depth = max(int(len(n) - 1).bit_length(), 0)
    sums = [np.concatenate([n, np.zeros((1 << depth) - len(n), np.int64)])]
    while len(sums[-1]) > 1:
        sums.append(sums[-1][0::2] + sums[-1][1::2])
    got = np.full((draws, 1), total, np.int64)
    for level in reversed(sums[:-1]):
        left, right = level[0::2], level[1::2]
        if replace:
            first = rng.binomial(got, left / np.maximum(left + right, 1))
        else:
            first = without_replacement(left, right, got, rng)
        got = np.stack([first, got - first], axis=2).reshape(draws, -1)
    return got[:, : len(n)]


def without_replacement(left: np.ndarray, right: np.ndarray, got: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """How many of ``got`` rows (draws, nodes) fall on the left, without replacement."""
    big = np.maximum(left, right) >= HYPERGEOMETRIC
    first = rng.hypergeometric(np.where(big, 0, left), np.where(big, 0, right), np.where(big, 0, got))
    for k in np.flatnonzero(big):  # fewer nodes than rows / 10**9
        first[:, k] = [hypergeometric_inverse(int(left[k]), int(right[k]), int(c), u) for c, u in zip(got[:, k], rng.random(len(got)), strict=True)]
    return first


Stat = Callable[[dict[str, np.ndarray], int, np.random.Generator], list[np.ndarray]]
"""(buckets, draws, generator) -> result columns, each of one number a draw, or of ``draws`` rows of several."""


def _run(names: Sequence[str], keys: int, fields: Sequence[str], b: int, stat: Stat, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                row = batch.slice(r, 1)
                packed = row.column("_buckets").flatten()
                table = {f: packed.field(k).to_numpy(zero_copy_only=False) for k, f in enumerate(fields)}
                block = row.column("_block")[0].as_py()
                draws = min(DRAWS, b - block * DRAWS)
                rng = np.random.Generator(np.random.Philox(key=int(row.column("_h")[0].as_py()[:16], 16)))
                out = stat(table, draws, rng)
                many = len(out[0]) // draws
                number = np.repeat(np.arange(block * DRAWS, block * DRAWS + draws, dtype=np.int32), many)
                columns = [row.column(k).take(pa.array(np.zeros(len(number), np.int64))) for k in range(keys)]
                columns += [pa.array(number), *[pa.array(v, mask=np.isnan(v) if v.dtype.kind == "f" else None) for v in out]]
                yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)

    return run


def draw(table: DataFrame, keys: Sequence[str], b: int, seed: str, stat: Stat, out: str, fields: Sequence[str] = FIELDS) -> DataFrame:
    """(keys, b, columns ``out``): ``stat`` on ``b`` resamples of each key's buckets, in the order of ``fields``."""
    keys = list(keys)
    packed = table.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("_buckets"))  # bounded by the depths
    packed = packed.where(F.size("_buckets") > 0)
    blocks = packed.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit((b - 1) // DRAWS))))
    blocks = blocks.withColumn("_h", key_hash(seed, *keys, "_block"))
    cores = table.sparkSession.sparkContext.defaultParallelism
    schema = T.StructType([*[table.schema[k] for k in keys], T.StructField("b", T.IntegerType()), *T.StructType.fromDDL(out).fields])
    spread = blocks.repartition(cores, *keys, "_block")
    return spread.mapInArrow(_run(blocks.columns, len(keys), fields, b, stat, to_arrow_schema(schema)), schema)


def drawn_sides(t: dict[str, np.ndarray], draws: int, rng: np.random.Generator, total: int | None = None, replace: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Drawn counts of the rows without and with the flag."""
    n = np.concatenate([t["n0"], t["n1"]])
    got = split_counts(n, int(n.sum()) if total is None else total, draws, rng, replace)
    return got[:, : len(t["n0"])], got[:, len(t["n0"]) :]


def _sums(t: dict[str, np.ndarray], zero: np.ndarray, one: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Sum of the values of each draw: exact means, and a normal part with the exact variance inside buckets."""
    spread = zero @ t["v0"] + one @ t["v1"]
    return zero @ t["m0"] + one @ t["m1"] + np.sqrt(spread) * rng.standard_normal(len(zero))


def mean_stat(t: dict[str, np.ndarray], draws: int, rng: np.random.Generator) -> list[np.ndarray]:
    zero, one = drawn_sides(t, draws, rng)
    return [_sums(t, zero, one, rng) / (zero.sum(axis=1) + one.sum(axis=1))]


def mean_draws(df: DataFrame, keys: Sequence[str], value: str | Column, b: int, seed: str = "boot") -> DataFrame:
    """Bootstrap means ``(keys, b, stat)``."""
    return draw(buckets(df, keys, value), keys, b, seed, mean_stat, "stat double")


def sums_stat(t: dict[str, np.ndarray], draws: int, rng: np.random.Generator) -> list[np.ndarray]:
    zero, one = drawn_sides(t, draws, rng)
    hits = one.sum(axis=1).astype(float)
    return [zero.sum(axis=1) + hits, hits, _sums(t, zero, one, rng)]


def sum_draws(df: DataFrame, keys: Sequence[str], value: str, flag: str, b: int, seed: str) -> DataFrame:
    """(keys, b, n, k, s): rows, rows with the flag, and sum of the value."""
    return draw(buckets(df, keys, value, flag), keys, b, seed, sums_stat, "n double, k double, s double")


def halves_stat(t: dict[str, np.ndarray], draws: int, rng: np.random.Generator) -> list[np.ndarray]:
    total = int(t["n0"].sum() + t["n1"].sum())
    zero, one = drawn_sides(t, draws, rng, total // 2, replace=False)
    hits = one.sum(axis=1).astype(float)
    # of n rows in a bucket, c without replacement: the spread shrinks by (n - c) / (n - 1)
    left = [np.where(t[n] > 1, (t[n] - c) / np.maximum(t[n] - 1, 1), 0) for n, c in (("n0", zero), ("n1", one))]
    spread = (zero * left[0]) @ t["v0"] + (one * left[1]) @ t["v1"]
    s = zero @ t["m0"] + one @ t["m1"] + np.sqrt(spread) * rng.standard_normal(draws)
    all_ = [float(total), float(t["n1"].sum()), float(t["n0"] @ t["m0"] + t["n1"] @ t["m1"])]
    own = [np.full(draws, float(total // 2)), hits, s]
    both = [np.stack([o, a - o], axis=1).ravel() for o, a in zip(own, all_, strict=True)]
    return [np.tile([True, False], draws), *both]


def half_draws(df: DataFrame, keys: Sequence[str], value: str, flag: str, b: int, seed: str) -> DataFrame:
    """(keys, b, half, n, k, s): sums of half of the rows, drawn without replacement, and of the other half."""
    return draw(buckets(df, keys, value, flag), keys, b, seed, halves_stat, "half boolean, n double, k double, s double")


def auroc_of(zero: np.ndarray, one: np.ndarray) -> np.ndarray:
    """AUROC of each row of counts in score order, ties half; nan for one class."""
    zero, one = zero.astype(float), one.astype(float)
    won = (one * (np.cumsum(zero, axis=1) - zero / 2)).sum(axis=1)
    pairs = zero.sum(axis=1) * one.sum(axis=1)
    return np.where(pairs > 0, won / np.maximum(pairs, 1), np.nan)


def told_apart(t: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Counts with neighbouring buckets of one class joined: no pair of classes is ordered inside them."""
    side = np.where(t["n1"] == 0, 0, np.where(t["n0"] == 0, 1, 2))
    new = np.append(True, (side[1:] != side[:-1]) | (side[1:] == 2))
    return {k: np.add.reduceat(t[k], np.flatnonzero(new)) for k in ("n0", "n1")}


def auroc_stat(t: dict[str, np.ndarray], draws: int, rng: np.random.Generator) -> list[np.ndarray]:
    t = told_apart(t)
    here = auroc_of(t["n0"][None], t["n1"][None])
    return [auroc_of(*drawn_sides(t, draws, rng)), np.repeat(here, draws)]


def auroc_draws(df: DataFrame, keys: Sequence[str], score: str, positive: str, b: int, seed: str = "boot") -> DataFrame:
    """(keys, b, auroc, of_buckets): AUROC of each resample, and of the buckets themselves."""
    return draw(buckets(df, keys, score, positive), keys, b, seed, auroc_stat, "auroc double, of_buckets double")


def detection_stat(tpr: float) -> Stat:
    def stat(t: dict[str, np.ndarray], draws: int, rng: np.random.Generator) -> list[np.ndarray]:
        zero, one = drawn_sides(t, draws, rng)
        here = [np.repeat(v, draws) for v in (auroc_of(t["n0"][None], t["n1"][None]), _fpr(t["x"], t["n0"][None], t["n1"][None], tpr))]
        return [auroc_of(zero, one), _fpr(t["x"], zero, one, tpr), *here]

    return stat


def _fpr(x: np.ndarray, zero: np.ndarray, one: np.ndarray, tpr: float) -> np.ndarray:
    """Share of zeros at or above the linear ``1 - tpr`` percentile of the ones."""
    cum, n = np.cumsum(one, axis=1), one.sum(axis=1)
    at = (1 - tpr) * (n - 1)
    low, high = (x[np.minimum((cum <= np.maximum(r(at), 0)[:, None]).sum(axis=1), len(x) - 1)] for r in (np.floor, np.ceil))
    cut = low + (high - low) * (at - np.floor(at))
    size = zero.sum(axis=1)
    share = (zero * (x[None] >= cut[:, None])).sum(axis=1) / np.maximum(size, 1)
    return np.where((n > 0) & (size > 0), share, np.nan)


def detection_draws(df: DataFrame, keys: Sequence[str], score: str, positive: str, b: int, tpr: float = 0.95, seed: str = "boot") -> DataFrame:
    """(keys, b, auroc, fpr, and both of the buckets)."""
    return draw(buckets(df, keys, score, positive), keys, b, seed, detection_stat(tpr), "auroc double, fpr double, auroc_buckets double, fpr_buckets double")


def _along(place: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Counts of each place, for every draw."""
    order = np.argsort(place, kind="stable")
    heads = np.flatnonzero(np.append(True, np.diff(place[order]) > 0))
    return np.add.reduceat(counts[:, order], heads, axis=1)


def paired_auroc_stat(t: dict[str, np.ndarray], draws: int, rng: np.random.Generator) -> list[np.ndarray]:
    own = (t["n0"][None], t["n1"][None])
    out = []
    for zero, one, times in ((*drawn_sides(t, draws, rng), 1), (*own, draws)):
        a, c = (auroc_of(_along(t[k], zero), _along(t[k], one)) for k in "ij")
        out.append(np.repeat(a - c, times))
    return out


def paired_auroc_draws(df: DataFrame, keys: Sequence[str], a: str, c: str, positive: str, b: int, seed: str = "boot") -> DataFrame:
    """(keys, b, diff, of_buckets): AUROC of ``a`` minus AUROC of ``c`` on the same resamples."""
    return draw(pair_buckets(df, keys, a, c, positive), keys, b, seed, paired_auroc_stat, "diff double, of_buckets double", PAIR_FIELDS)


def _spearman(t: dict[str, np.ndarray], counts: np.ndarray) -> np.ndarray:
    n = counts.sum(axis=1, keepdims=True).astype(float)
    ranks = []
    for k in "ij":
        along = _along(t[k], counts)
        middle = np.cumsum(along, axis=1) - (along - 1) / 2
        ranks.append(middle[:, np.unique(t[k], return_inverse=True)[1].reshape(-1)] - (n + 1) / 2)
    xx, yy, xy = ((counts * u * v).sum(axis=1) for u, v in ((ranks[0], ranks[0]), (ranks[1], ranks[1]), (ranks[0], ranks[1])))
    return np.where((xx > 1e-9) & (yy > 1e-9), xy / np.sqrt(np.maximum(xx * yy, 1e-300)), np.nan)


def spearman_stat(t: dict[str, np.ndarray], draws: int, rng: np.random.Generator) -> list[np.ndarray]:
    counts = split_counts(t["n0"], int(t["n0"].sum()), draws, rng)
    return [_spearman(t, counts), np.repeat(_spearman(t, t["n0"][None]), draws)]


def spearman_draws(df: DataFrame, keys: Sequence[str], x: str, y: str, b: int, seed: str = "boot") -> DataFrame:
    """(keys, b, rho, of_buckets)."""
    return draw(pair_buckets(df, keys, x, y), keys, b, seed, spearman_stat, "rho double, of_buckets double", PAIR_FIELDS)


def flip_stat(t: dict[str, np.ndarray], draws: int, rng: np.random.Generator) -> list[np.ndarray]:
    n = t["n0"]
    signs = 2.0 * rng.binomial(n, 0.5, (draws, len(n))) - n
    # the sum of signs and the signed distances from a bucket's mean are uncorrelated
    return [(signs @ t["m0"] + np.sqrt(n @ t["v0"]) * rng.standard_normal(draws)) / n.sum()]


def flip_draws(df: DataFrame, keys: Sequence[str], value: str, b: int, seed: str = "flip") -> DataFrame:
    """(keys, b, stat): means of the values under random signs."""
    return draw(buckets(df, keys, value), keys, b, seed, flip_stat, "stat double")


def row_stat(t: dict[str, np.ndarray], draws: int, rng: np.random.Generator) -> list[np.ndarray]:
    zero, one = drawn_sides(t, draws, rng)
    w = np.stack([zero, one], axis=2).astype(float).reshape(draws, -1)
    value = np.stack([t["m0"], t["m1"]], axis=1).ravel()
    flags = np.tile([False, True], len(t["m0"]))
    return [np.tile(value, draws), np.tile(flags, draws), w.ravel()]


def bucket_rows(table: DataFrame, keys: Sequence[str], value: str, flag: str) -> DataFrame:
    """The buckets as weighted rows (keys, value, flag, w)."""
    sides = F.array(*[F.struct(F.col(f"m{k}").alias(value), F.lit(bool(k)).alias(flag), F.col(f"n{k}").cast("double").alias("w")) for k in (0, 1)])
    return table.select(*keys, F.inline(sides)).where("w > 0")


def weighted_draws(table: DataFrame, keys: Sequence[str], value: str, flag: str, b: int, seed: str = "boot") -> DataFrame:
    """(keys, b, value, flag, w): resampled buckets as weighted rows, for metrics of any kind."""
    return draw(table, keys, b, seed, row_stat, f"{value} double, {flag} boolean, w double").where("w > 0")
