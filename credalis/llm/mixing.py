"""Mixing to target weights by soft membership.

A classifier fitted on a labelled table gives each document a posterior over domains. A
nonnegative rate per document is then fitted by projected gradient least squares, so that
the expected tokens of each domain, sum of rate * tokens * posterior, match the targets.

The gradient in a rate depends on the document through its posterior only, so a step is one
short vector: the driver keeps the list of steps (at most ``STEPS`` of one number a domain),
and each pass recomputes the rates from it while it sums the domain totals. No state is
written between steps. Steps are scaled by the second moments of the domains over documents
that are free to move; a step after which the totals are further away is halved.

Null or empty text has no tokens; its rate follows its posterior and moves no total. Targets
out of reach are met as closely as rates allow. Without labels all posteriors are equal.
Repeated rows get equal rates. An empty table gives an empty result. Columns beside id and
text are never inputs.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credalis.llm.frames import arrow_of, batch_of, stored, text_chunks, trim, with_text
from credalis.llm.toxicity import BITS, Model, compact, feature_lists, features, fit_lists, ordered_texts, used
from credalis.llm.words import ALPHANUMERIC, words_of

MAX_ROWS = 6_000
"""Labelled rows the classifier is fitted on at most."""
SHARD_ROWS = 2_000
SCORE_BYTES = 1 << 21
STEPS = 24
RIDGE = 1e-3
CLOSE = 1e-3
"""Largest distance of a domain's share from its target at which fitting ends."""


def domain_labels(labels: DataFrame, domains: Sequence[tuple[int, int]], id_col: str = "doc_id") -> DataFrame:
    """(i, domain): position of each row's (quality, toxic) in ``domains``."""
    domain = F.coalesce(*[F.when((F.col("quality") == q) & (F.col("toxic") == t), F.lit(k)) for k, (q, t) in enumerate(domains)])
    return labels.select(F.col(id_col).alias("i"), domain.alias("domain")).where("i is not null and domain is not null")


def _fit_shard(k: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        trim()
        order = pc.sort_indices(table.column("draw"))
        lists = compact(feature_lists(ordered_texts(table, order)))
        domain = table.column("domain").take(order).to_numpy()
        rows: list[tuple[int, int, float]] = []
        for d in range(k):
            model = fit_lists(*lists, (domain == d).astype(float))
            rows += [(d, int(a), float(w)) for a, w in zip([*model.at, 1 << BITS], [*model.weight, model.bias], strict=True)]
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("domain", "at", "weight"), zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.float64()), strict=True)})

    return run


def domain_models(docs: DataFrame, labels: DataFrame, k: int, id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_ROWS) -> list[Model]:
    """One model for each domain against the rest, averaged over shards of labelled rows."""
    known = labels.groupBy("i").agg(F.max("domain").alias("domain")).orderBy(F.xxhash64("i")).limit(max_rows)
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("text")).join(F.broadcast(known), "i")  # no more than max_rows ids
    shards = max(1, -(-known.count() // SHARD_ROWS))
    rows = rows.select(F.pmod(F.xxhash64("i"), F.lit(shards)).alias("shard"), F.xxhash64("i", F.lit("draw"), "text").alias("draw"), "text", "domain")
    fitted = rows.groupBy("shard").applyInArrow(_fit_shard(k), "domain int, at long, weight double")
    mean = fitted.groupBy("domain", "at").agg((F.sum("weight") / shards).alias("weight")).orderBy("domain", "at").toArrow()
    domain, at, weight = (mean.column(c).to_numpy() for c in ("domain", "at", "weight"))
    out = []
    for d in range(k):
        own = (domain == d) & (at < 1 << BITS)
        out.append(Model(at[own], weight[own], float(weight[(domain == d) & ~own].sum())))
    return out


def _posterior(held: Broadcast, text: str | None, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models: list[Model] = held.value
        wanted = used(models)
        for _, ids, texts in text_chunks(with_text(batches, text), SCORE_BYTES):
            words = words_of(texts, ALPHANUMERIC)
            found = features(words, wanted)
            score = np.stack([m.scores(*found, len(texts)) for m in models], axis=1) + 1e-9
            yield batch_of(schema, ids, words.counts, (score / score.sum(axis=1, keepdims=True)).tolist())

    return run


def posteriors(docs: DataFrame, models: list[Model], id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """Per row: ``i`` (the id, or with ``keep`` the whole row), tokens, posterior."""
    rows = docs.select(F.struct("*").alias("i")) if keep else docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))
    ddl = f"i {rows.schema['i'].dataType.simpleString()}, tokens long, posterior array<double>"
    held = docs.sparkSession.sparkContext.broadcast(models)
    return rows.mapInArrow(_posterior(held, text_col if keep else None, arrow_of(ddl)), ddl)


def rate_of(steps: Sequence[Sequence[float]], floor: float) -> Column:
    """A document's rate after the steps, from its posterior."""
    rate = F.lit(1.0) if floor < 1 else F.lit(float(floor))
    for v in steps:
        move = sum((F.col("posterior")[k] * F.lit(float(x)) for k, x in enumerate(v)), F.lit(0.0))
        rate = F.greatest(F.lit(float(floor)), rate - move)
    return rate


def fit_steps(scored: DataFrame, shares: Sequence[float], budget: float = 1.0, floor: float = 0.0) -> list[list[float]]:
    """Projected gradient steps over ``scored`` (tokens, posterior): totals reach ``budget * shares`` of all tokens."""
    k = len(shares)
    t, p, r = F.col("tokens").cast("double"), F.col("posterior"), F.col("r")
    free = F.when(r > floor, t).otherwise(0.0)
    sums = [F.sum(t).alias("n"), *[F.sum(t * p[a] * r).alias(f"e{a}") for a in range(k)], *[F.sum(free * p[a] * p[b]).alias(f"m{a}_{b}") for a in range(k) for b in range(k)]]
    target = np.array(shares, float) / sum(shares) * budget
    steps: list[list[float]] = []
    least = np.inf
    for pass_ in range(STEPS):
        got = scored.select("tokens", "posterior", rate_of(steps, floor).alias("r")).agg(*sums).first()
        if not got["n"]:
            break
        gap = np.array([got[f"e{a}"] for a in range(k)]) / got["n"] - target
        if gap @ gap > least:
            steps[-1] = [x / 2 for x in steps[-1]]
            continue
        least = gap @ gap
        if np.abs(gap).max() < CLOSE or pass_ == STEPS - 1:
            break
        moment = np.array([[got[f"m{a}_{b}"] for b in range(k)] for a in range(k)]) / got["n"]
        steps.append(np.linalg.solve(moment + RIDGE * np.eye(k), gap).tolist())
    return steps


def mixing_rates(docs: DataFrame, labels: DataFrame, shares: Sequence[float], budget: float = 1.0, floor: float = 0.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, tokens, posterior, rate. ``labels``: (i, domain)."""
    scored = stored(posteriors(docs, domain_models(docs, labels, len(shares), id_col, text_col), id_col, text_col))
    steps = fit_steps(scored, shares, budget, floor)
    return scored.select(F.col("i").alias(id_col), "tokens", "posterior", rate_of(steps, floor).alias("rate"))


def mixed_rows(docs: DataFrame, labels: DataFrame, shares: Sequence[float], budget: float = 1.0, floor: float = 0.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows, each repeated by its rate: the whole part always, the rest by a draw from id and text."""
    models = domain_models(docs, labels, len(shares), id_col, text_col)
    steps = fit_steps(stored(posteriors(docs, models, id_col, text_col).drop("i")), shares, budget, floor)
    draw = (F.shiftrightunsigned(F.xxhash64(F.lit("copies"), f"i.{id_col}", f"i.{text_col}"), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    times = F.floor(rate_of(steps, floor) + draw).cast("int")
    rows = posteriors(docs, models, id_col, text_col, keep=True).select("i", times.alias("times")).where("times > 0")
    return rows.select("i", F.explode(F.sequence(F.lit(1), "times"))).select("i.*")
