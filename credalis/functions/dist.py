"""Expressions over one categorical distribution (``MAP<STRING,DOUBLE>``)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-12
"""Floor before logarithms (fixed value)."""
TEMPER_FLOOR = 1e-4
"""Probability floor of temperature and logistic maps (fixed value)."""


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def fold(values: Column, term) -> Column:
    """Sum of ``term(x)`` over an array of doubles."""
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + term(x))


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and use it inside ``body``.

    Without it a total inside a lambda is recomputed for every element.
    """
    return F.transform(F.array(value), body)[0]


def mass(d: Column | str) -> Column:
    """Sum of the probabilities of a map."""
    return fold(F.map_values(_c(d)), lambda p: p)


def prob(d: Column | str, key: Column) -> Column:
    """Probability of ``key``; a missing key counts 0."""
    return F.coalesce(_c(d)[key], F.lit(0.0))


def normalise(d: Column | str, on_error: str = "raise") -> Column:
    """Rescale a map to sum 1; negative or all-zero input raises or gives null."""
    d = _c(d)
    total = mass(d)
    bad = F.exists(F.map_values(d), lambda p: p < 0) | (total <= 0)
    scaled = let(total, lambda t: F.transform_values(d, lambda k, p: p / t))
    if on_error == "null":
        return F.when(~bad, scaled)
    problem = F.raise_error(F.lit("probabilities must be non-negative and not all zero"))
    return F.when(bad, problem.cast("map<string,double>")).otherwise(scaled)


def entropy_of(values: Column) -> Column:
    """Shannon entropy in nats of an array of probabilities."""
    return fold(values, lambda p: F.when(p > 0, -p * F.ln(p)).otherwise(0.0))


def entropy(d: Column | str) -> Column:
    """Shannon entropy in nats of a map."""
    return entropy_of(F.map_values(_c(d)))


def norm_entropy(d: Column | str) -> Column:
    """Entropy over ``ln K``; null below two options."""
    d = _c(d)
    return F.when(F.size(d) >= 2, entropy(d) / F.ln(F.size(d)))


def exactly(d: Column | str, names: Sequence[str]) -> list[Column]:
    """Probabilities of a map over these keys, in their order; other keys, a missing one or a null are an error."""
    d = _c(d)
    p = [d[F.lit(o)] for o in names]
    right = reduce(lambda a, b: a & b, [x.isNotNull() for x in p], F.coalesce(F.size(d) == len(names), F.lit(False)))
    other = F.raise_error(F.lit("a distribution over other options than " + ", ".join(map(str, names)))).cast("double")
    return [F.when(right, x).otherwise(other) for x in p]


def log_score(d: Column | str, gold: Column | str, eps: float = EPS) -> Column:
    """``-ln max(p(gold), eps)``."""
    return -F.ln(F.greatest(prob(d, _c(gold)), F.lit(eps)))


def brier(d: Column | str, gold: Column | str) -> Column:
    """Squared error against the one-hot answer over the listed options."""
    gold = _c(gold)
    return F.aggregate(
        F.map_entries(_c(d)),
        F.lit(0.0),
        lambda a, e: a
        + F.pow(e["value"] - F.when(e["key"] == gold, 1.0).otherwise(0.0), F.lit(2.0)),
    )


def choice_confidence(d: Column | str) -> Column:
    """``(K p_max - 1) / (K - 1)`` clipped to [0, 1]; null below two options."""
    d = _c(d)
    k = F.size(d).cast("double")
    raw = (k * F.array_max(F.map_values(d)) - 1) / (k - 1)
    return F.when(k >= 2, F.least(F.lit(1.0), F.greatest(F.lit(0.0), raw)))


def tv_distance(p: Column | str, q: Column | str) -> Column:
    """Total variation over the union of keys."""
    gap = F.map_zip_with(
        _c(p), _c(q),
        lambda k, a, b: F.abs(F.coalesce(a, F.lit(0.0)) - F.coalesce(b, F.lit(0.0))),
    )
    return F.lit(0.5) * mass(gap)


def js_divergence(p: Column | str, q: Column | str) -> Column:
    """Jensen-Shannon divergence in nats; null when the option sets differ."""
    p, q = _c(p), _c(q)

    def half(a, m):
        return F.when(a > 0, a * F.ln(a / m)).otherwise(0.0)

    terms = F.map_zip_with(p, q, lambda k, a, b: half(a, (a + b) / 2) + half(b, (a + b) / 2))
    same = F.size(terms) == F.greatest(F.size(p), F.size(q))
    return F.when(same & (F.size(p) == F.size(q)), mass(terms) / 2)


def clipped_logit(p: Column | str, eps: float = 1e-3) -> Column:
    """Log-odds with ``p`` clipped to ``[eps, 1 - eps]``."""
    q = F.least(F.greatest(_c(p), F.lit(eps)), F.lit(1 - eps))
    return F.ln(q / (1 - q))


def expected_scores(d: Column | str, ideal: Column | str, eps: float = TEMPER_FLOOR) -> Column:
    """Struct of expected Brier and log loss of ``d`` under ``ideal``, and of ``ideal``."""
    d, ideal = _c(d), _c(ideal)
    support = F.filter(F.map_entries(ideal), lambda e: e["value"] > 0)

    def expect(score):
        return F.aggregate(support, F.lit(0.0), lambda a, e: a + e["value"] * score(e))

    return F.struct(
        expect(lambda e: brier(d, e["key"])).alias("brier"),
        expect(lambda e: log_score(d, e["key"], eps)).alias("log_loss"),
        expect(lambda e: brier(ideal, e["key"])).alias("ideal_brier"),
        expect(lambda e: -F.ln(e["value"])).alias("ideal_log_loss"),
    )


def temper(d: Column | str, t: Column | float) -> Column:
    """Temperature scaling: floor, power ``1/t``, renormalise."""
    t = t if isinstance(t, Column) else F.lit(float(t))
    powered = F.transform_values(
        _c(d), lambda k, p: F.pow(F.greatest(p, F.lit(TEMPER_FLOOR)), F.lit(1.0) / t)
    )
    return let(powered, lambda m: let(mass(m), lambda s: F.transform_values(m, lambda k, p: p / s)))


def apply_platt(p: Column | str, slope: Column | float, intercept: Column | float) -> Column:
    """Logistic map of the clipped logit of ``p``."""
    z = slope * clipped_logit(p, TEMPER_FLOOR) + intercept
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def percent_reading(expected_level: Column | str) -> Column:
    """Probability read from an expected level 0..9: the middle of its decile."""
    return (_c(expected_level) + 0.5) / 10


def odds_reading(fmt: Column, yes: Column, levels: Column, chosen: Column) -> Column:
    """Per-option readings by answer format: yes/no, level or stated distribution."""
    return (
        F.when(fmt == "noul", yes)
        .when(fmt == "score", F.transform(levels, percent_reading))
        .otherwise(chosen)
    )


def renormalised_errors(read: Column, star: Column) -> Column:
    """Struct of errors of a reading against stated odds, raw and renormalised."""
    total = fold(read, lambda x: x)
    floored = F.greatest(total, F.lit(1e-9))
    norm = let(floored, lambda t: F.transform(read, lambda x: x / t))

    def gap(a, b):
        return fold(F.zip_with(a, b, lambda x, y: F.abs(x - y)), lambda x: x)

    k = F.size(star)
    kl = fold(
        F.zip_with(
            star, norm,
            lambda s, x: F.when(s > 0, s * F.ln(s / F.greatest(x, F.lit(1e-6)))).otherwise(0.0),
        ),
        lambda x: x,
    )
    return F.struct(
        total.alias("sum"),
        (gap(read, star) / k).alias("mae_raw"),
        (gap(norm, star) / k).alias("mae_renormalised"),
        (gap(norm, star) * 0.5).alias("tv_renormalised"),
        kl.alias("kl_renormalised"),
    )


def subset_mass(d: Column | str, keys: Column | str) -> Column:
    """Mass on the options in an array of keys."""
    keys = _c(keys)
    return mass(F.map_filter(_c(d), lambda k, p: F.array_contains(keys, k)))


def valid_spread(d: Column | str, keys: Column | str) -> Column:
    """Normalised entropy of the mass inside a key subset; 0 without mass."""
    keys = _c(keys)
    part = F.map_filter(_c(d), lambda k, p: F.array_contains(keys, k))
    total = mass(part)
    inside = let(total, lambda t: F.transform(F.map_values(part), lambda p: p / t))
    return F.when(total <= 0, 0.0).when(F.size(keys) < 2, 0.0).otherwise(
        entropy_of(inside) / F.ln(F.size(keys))
    )


def _scored(d: Column, option: Column, position: Column) -> Column:
    return F.named_struct(
        F.lit("p"), prob(d, option), F.lit("pos"), -position, F.lit("option"), option
    )


def ranked_options(d: Column | str, options: Column | str) -> Column:
    """Options as structs ``(p, pos, option)``, best first, ties by display order."""
    d = _c(d)
    scored = F.transform(
        _c(options),
        lambda o, i: _scored(d, o, i),
    )
    return F.sort_array(scored, asc=False)


def top_option(d: Column | str, options: Column | str) -> Column:
    """Most likely option, the first listed on ties."""
    d = _c(d)
    return F.array_max(F.transform(_c(options), lambda o, i: _scored(d, o, i)))["option"]


def runner_up_share(ranked: Column) -> Column:
    """Share of the mass outside the top option that the second option holds."""
    rest = 1 - ranked[0]["p"]
    return F.when(rest > 1e-9, ranked[1]["p"] / rest)


def remap_labels(d: Column | str, code_to_label: Column | str) -> Column:
    """Replace option codes by labels and normalise; null when the key sets differ."""
    d, m = _c(d), _c(code_to_label)
    same = F.size(F.array_except(F.map_keys(d), F.map_keys(m))) == 0
    same = same & (F.size(d) == F.size(m))
    return F.when(same, normalise(F.transform_keys(d, lambda k, p: F.element_at(m, k)), "null"))


def verification_confidence(p_yes: Column | str) -> Column:
    """Confidence of a yes/no answer."""
    p = _c(p_yes)
    return F.greatest(p, 1 - p)


def label_distribution(counts: Column | str) -> Column:
    """Annotator counts to probabilities."""
    c = _c(counts)
    total = F.aggregate(F.map_values(c), F.lit(0.0), lambda a, x: a + x)
    return let(total, lambda t: F.transform_values(c, lambda k, v: v / t))


def ideal_distribution(
    cell: Column, options: Column, ruled_out: Column, stated: Column, chances: Column
) -> Column:
    """Ideal answer: stated option, stated chances, or uniform over what is left."""
    left = F.array_except(options, ruled_out)
    spread = let(
        left,
        lambda kept: F.map_from_arrays(
            options,
            F.transform(
                options,
                lambda o: F.when(F.array_contains(kept, o), F.lit(1.0) / F.size(kept)).otherwise(0.0),
            ),
        ),
    )
    point = F.map_from_arrays(
        options, F.transform(options, lambda o: F.when(o == stated, 1.0).otherwise(0.0))
    )
    return F.when(cell == "stated", point).when(cell == "chances", chances).otherwise(spread)
