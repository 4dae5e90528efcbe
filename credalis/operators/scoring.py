"""From answers per replicate to one scored row per unit."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from credalis.functions import dist as D
from credalis.functions.dist import fold, let
from credalis.operators.prefix import FEW_VALUES, attach, few_values, running_sums, small_groups

CONFIDENT = 0.5
"""Top probability from which a wrong answer counts as confident (fixed value)."""


FEW_REPLICATES = 1_000
"""Up to this many answers of a unit are held in its row as arrays."""
FEW_ORDERS = 32
"""Up to this many orders of a unit are paired inside its row."""
SORTED_BY_ENDS = 3
"""Up to this many values, all pair differences follow from the largest and the smallest."""
LOOKED_AT = 1_000
"""Answers whose models are taken for all there are, until a pass over all answers confirms it."""


def replicate_values(answers: DataFrame, unit: Sequence[str], options: str = "options", probabilities: str = "dist", extra: Sequence[Column] = ()) -> DataFrame:
    """One row per unit: ``options``, and ``_r``, the probabilities of each of its answers on them; one exchange."""
    p = F.transform(options, lambda o: D.prob(probabilities, o))
    return answers.groupBy(*unit).agg(F.min(options).alias("options"), F.collect_list(p).alias("_r"), *extra)


def common_options(df: DataFrame, options: str = "options") -> list | None:
    """The options that the first row lists, if they are few; whether all rows list them is left to ``lists_other``."""
    row = df.select(options).first()
    return row[0] if row and row[0] and len(row[0]) <= FEW_VALUES else None


def lists_other(names: Sequence, options: str = "options") -> Column:
    """Whether a row lists other options than ``names``, or in another order."""
    return ~F.col(options).eqNullSafe(F.array(*[F.lit(o) for o in names]))


def by_ends(answers: DataFrame, unit: Sequence[str], *bad: Column) -> bool:
    """Whether no unit has more than ``SORTED_BY_ENDS`` answers and none of ``bad`` holds in any; of a unit only a hash is moved."""
    any_bad = reduce(lambda a, b: a | b, bad)
    per = answers.groupBy(F.xxhash64(*unit).alias("_h")).agg(F.count(F.lit(1)).alias("n"), F.max(any_bad).alias("bad"))
    got = per.agg(F.max("n").alias("n"), F.max("bad").alias("bad")).first()
    return (got["n"] or 0) <= SORTED_BY_ENDS and not got["bad"]


def ends(names: Sequence, probabilities: str = "dist") -> list[Column]:
    """Number of answers, and the largest and smallest probability of each option: of fixed width, so nothing is sorted."""
    p = [D.prob(probabilities, F.lit(o)) for o in names]
    return [F.count(F.lit(1)).alias("_n"), *[a for i, x in enumerate(p) for a in (F.max(x).alias(f"_z{i}"), F.min(x).alias(f"_a{i}"))]]


def spread_of_ends(k: int) -> Column:
    """``spread_of_values`` of at most three answers: each option's pair differences add up to ``n - 1`` times its range."""
    return reduce(lambda a, b: a + b, [F.col(f"_z{i}") - F.col(f"_a{i}") for i in range(k)]) / F.col("_n")


def mean_of_values(r: str = "_r") -> Column:
    """Mean of the answers' probabilities by option, not yet normalised."""
    return F.transform(F.col(r)[0], lambda _, i: fold(F.transform(r, lambda x: x[i]), lambda x: x) / F.size(r))


def normalised(p: Column) -> Column:
    return let(p, lambda q: let(fold(q, lambda x: x), lambda t: F.transform(q, lambda x: F.when(t > 0, x / t).otherwise(0.0))))


def spread_of_values(r: str = "_r") -> Column:
    """Mean total variation between pairs of answers: the sorted values of an option, each times how many are below less how many above."""
    n = F.size(r)

    def pairs(i: Column) -> Column:
        ordered = F.array_sort(F.transform(r, lambda x: x[i]))
        return fold(F.transform(ordered, lambda x, k: x * (2 * k + 1 - n)), lambda x: x)

    return F.when(n > 1, fold(F.transform(F.col(r)[0], lambda _, i: pairs(i)), lambda x: x) / (n * (n - 1))).otherwise(0.0)


def replicate_mean(
    answers: DataFrame, unit: Sequence[str], options: str = "options", probabilities: str = "dist"
) -> DataFrame:
    """Mean distribution over replicates on the unit's options.

    Omitted options count 0, unlisted ones are dropped, the mean is renormalised.
    One row per (unit, option). Where all answers list the same few options, a unit is one row of
    sums in the exchange. Else a unit's answers meet in its row; where a unit has very many,
    sums per option are combined before the shuffle instead, with the same result.
    """
    names = common_options(answers, options)
    if names and not answers.agg(F.max(lists_other(names, options))).first()[0]:
        sums = [F.sum(D.prob(probabilities, F.lit(o))).alias(f"_s{i}") for i, o in enumerate(names)]
        per = answers.groupBy(*unit).agg(F.count(F.lit(1)).alias("n_reps"), *sums)
        p = normalised(F.array(*[F.col(f"_s{i}") / F.col("n_reps") for i in range(len(names))]))
        both = F.arrays_zip(F.array(*[F.lit(o) for o in names]).alias("option"), p.alias("p"))
        return per.select(*unit, F.posexplode(both).alias("pos", "_o"), "n_reps").select(*unit, "pos", "_o.option", "_o.p", "n_reps")
    if small_groups(answers, unit, FEW_REPLICATES):
        per = replicate_values(answers, unit, options, probabilities)
        both = F.arrays_zip(F.col("options").alias("option"), normalised(mean_of_values()).alias("p"))
        return per.select(*unit, F.posexplode(both).alias("pos", "_o"), F.size("_r").cast("long").alias("n_reps")).select(*unit, "pos", "_o.option", "_o.p", "n_reps")
    long = answers.select(*unit, probabilities, F.posexplode(options).alias("pos", "option"))
    per = long.groupBy(*unit, "pos", "option").agg(
        F.avg(D.prob(probabilities, F.col("option"))).alias("p"), F.count(F.lit(1)).alias("n_reps")
    )
    # one row per listed option is left, so this window holds one option list
    total = F.sum("p").over(Window.partitionBy(*unit))
    return per.withColumn("_total", total).withColumn(
        "p", F.when(F.col("_total") > 0, F.col("p") / F.col("_total")).otherwise(0.0)
    ).drop("_total")


def distribution_of(mean: DataFrame, unit: Sequence[str]) -> DataFrame:
    """Collapse (unit, option) rows into ``options`` and ``dist`` in display order."""
    item = F.struct("pos", "option", "p")
    per = mean.groupBy(*unit).agg(
        F.array_sort(F.collect_list(item)).alias("_o"), F.max("n_reps").alias("n_reps")
    )
    return per.select(
        *unit, "n_reps", F.transform("_o", lambda o: o["option"]).alias("options"),
        F.map_from_arrays(F.transform("_o", lambda o: o["option"]), F.transform("_o", lambda o: o["p"])).alias("dist"),
    )


def replicate_spread(answers: DataFrame, unit: Sequence[str], options: str = "options", probabilities: str = "dist") -> DataFrame:
    """Mean pairwise total variation between replicates, without forming pairs.

    For one option, the sum of ``|a - b|`` over pairs is linear in the sorted
    values: a level with ``c`` copies of ``x`` after ``k0`` smaller values of
    ``R`` contributes ``x c (2 k0 + c - R)``. Of up to three answers on the same few options,
    largest and smallest values suffice. Else a unit's values are sorted in its row; where a
    unit has very many, its levels are ordered in buckets.
    """
    names = common_options(answers, options)
    if names and by_ends(answers, unit, lists_other(names, options)):
        return answers.groupBy(*unit).agg(*ends(names, probabilities)).select(*unit, spread_of_ends(len(names)).alias("rep_tv"))
    if small_groups(answers, unit, FEW_REPLICATES):
        return replicate_values(answers, unit, options, probabilities).select(*unit, spread_of_values().alias("rep_tv"))
    long = answers.select(*unit, probabilities, F.explode(options).alias("option"))
    lv = long.groupBy(*unit, "option", D.prob(probabilities, F.col("option")).alias("x")).agg(
        F.count(F.lit(1)).cast("double").alias("c")
    )
    k = [*unit, "option"]
    cum = attach(running_sums(lv, k, ["x"], ["c"]), lv.groupBy(*k).agg(F.sum("c").alias("reps")), k)
    part = F.col("x") * F.col("c") * (2 * F.col("before_c") + F.col("c") - F.col("reps"))
    r = F.max("reps")
    return cum.groupBy(*unit).agg(
        F.when(r > 1, F.sum(part) / (r * (r - 1))).otherwise(0.0).alias("rep_tv")
    )


def top_flips(answers: DataFrame, unit: Sequence[str]) -> DataFrame:
    """Whether the top option differs between replicates.

    Where all answers list the same few options, a top option is its place, so that nothing is sorted before the exchange.
    """
    names = common_options(answers)
    if names and not answers.agg(F.max(lists_other(names))).first()[0]:
        p = [f"_p{i}" for i in range(len(names))]
        most = F.greatest(*p) if len(p) > 1 else F.col(p[0])
        place = F.coalesce(*[F.when(F.col(c) == most, i) for i, c in enumerate(p)])
        top = answers.select(*unit, *[D.prob("dist", F.lit(o)).alias(c) for o, c in zip(names, p, strict=True)]).select(*unit, place.alias("_top"))
    else:
        top = answers.select(*unit, D.top_option("dist", "options").alias("_top"))
    return top.groupBy(*unit).agg((F.min("_top") != F.max("_top")).alias("rep_flip"))


def score_items(
    answers: DataFrame, items: DataFrame, yes_no: Sequence[str] = (), scores: Sequence[str] = ()
) -> DataFrame:
    """One scored row per unit of ``items(unit, options, gold, ...)``.

    ``answers`` has ``unit``, ``dist``, ``model`` and one column per yes/no or
    score question. A unit whose answers put nothing on its options is an error.
    """
    averages = [*[F.avg(q).alias(f"p_{q}") for q in yes_no], *[F.avg(q).alias(f"s_{q}") for q in scores]]
    extra = [*averages, F.array_sort(F.collect_set("model")).alias("models")]
    names = common_options(items)
    models = sorted({r[0] for r in answers.select("model").head(LOOKED_AT)} - {None})
    if (
        names and len(models) <= FEW_VALUES and not items.agg(F.max(lists_other(names))).first()[0]
        and by_ends(answers, ["unit"], F.coalesce(~F.col("model").isin(models), F.lit(False)))
    ):
        # every figure of a unit has a fixed width: nothing is collected or sorted before the exchange
        k = range(len(names))
        sums = [F.sum(D.prob("dist", F.lit(o))).alias(f"_s{i}") for i, o in enumerate(names)]
        said = [F.max(F.col("model").eqNullSafe(F.lit(m))).alias(f"_m{i}") for i, m in enumerate(models)]
        per = answers.groupBy("unit").agg(*averages, *ends(names), *sums, *said)
        mean = F.array(*[F.col(f"_s{i}") / F.col("_n") for i in k])
        held = [F.when(F.col(f"_m{i}"), F.lit(m)) for i, m in enumerate(models)]
        rows = items.join(per, "unit").withColumns({
            "models": F.array_compact(F.array(*held)) if held else F.array().cast("array<string>"), "n_reps": F.col("_n"),
            "dist": F.map_from_arrays("options", normalised(mean)), "rep_tv": spread_of_ends(len(names)),
        }).drop("_n", *[f"{c}{i}" for i in k for c in ("_z", "_a", "_s")], *[f"_m{i}" for i in range(len(models))])
    elif small_groups(answers, ["unit"], FEW_REPLICATES):
        # answers and items meet once, on the unit; everything else is arithmetic inside a row
        maps = answers.groupBy("unit").agg(F.collect_list("dist").alias("_d"), *extra)
        p = F.transform("_d", lambda d: F.transform("options", lambda o: D.prob(d, o)))
        rows = items.join(maps, "unit").withColumn("_r", p).drop("_d")
        rows = rows.withColumns({
            "n_reps": F.size("_r").cast("long"), "dist": F.map_from_arrays("options", normalised(mean_of_values())), "rep_tv": spread_of_values(),
        }).drop("_r")
    else:
        joined = answers.join(items.select("unit", "options"), "unit")
        dist = distribution_of(replicate_mean(joined, ["unit"]), ["unit"]).drop("options")
        rows = items.join(dist, "unit").join(joined.groupBy("unit").agg(*extra), "unit").join(replicate_spread(joined, ["unit"]), "unit")
    empty = F.raise_error(F.concat(F.col("unit"), F.lit(": no probability on any listed option")))
    top = D.top_option("dist", "options")
    rows = rows.withColumn("top", F.when(D.mass("dist") == 0, empty.cast("string")).otherwise(top))
    return rows.withColumns(
        {
            "p_max": F.array_max(F.map_values("dist")),
            "correct": F.col("top") == F.col("gold"),
            "p_gold": F.when(F.col("gold").isNotNull(), D.prob("dist", F.col("gold"))),
            "norm_entropy": D.norm_entropy("dist"),
        }
    )


def _listed_alike(rows: DataFrame, keys: Sequence[str]) -> bool:
    """Whether cells are small and each lists the same options in all its rows."""
    h = F.xxhash64("options")
    per = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.min(h).alias("a"), F.max(h).alias("z"), F.min(F.coalesce(F.size("options"), F.lit(0))).alias("k")
    )
    return per.filter((F.col("n") > FEW_REPLICATES) | (F.col("a") != F.col("z")) | (F.col("k") < 1)).isEmpty()


def aggregate_cells(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Replicates to one row per design cell; a cell without mass becomes uniform.

    ``rows`` has ``options``, ``dist``, ``gold``, ``first_listed`` and
    ``swap_target``, the latter three constant inside a cell. Where all rows list the same few
    options, a cell is one row of sums in the exchange.
    """
    keys = list(keys)
    consts = [F.min(c).alias(c) for c in ("gold", "first_listed", "swap_target")]
    names = common_options(rows)
    if names and None not in names and not rows.agg(F.max(lists_other(names))).first()[0]:
        return _cells_of_sums(rows, keys, names, consts)
    if _listed_alike(rows, keys):
        per = rows.groupBy(*keys).agg(
            F.min("options").alias("options"), F.collect_list(F.transform("options", lambda o: D.prob("dist", o))).alias("_r"), *consts
        )
        n = F.size("_r")

        def cell_option(o: Column, i: Column) -> Column:
            def stats(x: Column) -> Column:
                return let(fold(x, lambda v: v) / n, lambda m: F.struct(
                    i.alias("pos"), o.alias("option"), m.alias("p"),
                    F.when(n > 1, F.sqrt(fold(x, lambda v: (v - m) * (v - m)) / (n - 1))).alias("sd"),
                ))

            return let(F.transform("_r", lambda a: a[i]), stats)

        item = F.transform("options", cell_option)
        cell = per.select(*keys, "gold", "first_listed", "swap_target", n.cast("long").alias("n_reps"), F.explode(F.array(item)).alias("_o"))
        joined = cell.withColumn("_t", fold(F.transform("_o", lambda o: o["p"]), lambda x: x))
    else:
        long = rows.select(*keys, "dist", F.posexplode("options").alias("pos", "option"))
        p = D.prob("dist", F.col("option"))
        per = long.groupBy(*keys, "pos", "option").agg(
            F.avg(p).alias("p"), F.count(F.lit(1)).alias("n_reps"),
            F.when(F.count(F.lit(1)) > 1, F.stddev_samp(p)).alias("sd"),
        )
        item = F.struct("pos", "option", "p", "sd")
        cell = per.groupBy(*keys).agg(
            F.array_sort(F.collect_list(item)).alias("_o"), F.max("n_reps").alias("n_reps"), F.sum("p").alias("_t")
        )
        joined = attach(cell, rows.groupBy(*keys).agg(*consts), keys)
    k = F.size("_o")
    mean = F.map_from_arrays(
        F.transform("_o", lambda o: o["option"]),
        F.transform("_o", lambda o: F.when(F.col("_t") > 0, o["p"] / F.col("_t")).otherwise(F.lit(1.0) / k)),
    )
    out = joined.withColumn("dist", mean)
    out = out.withColumn("top", D.top_option("dist", F.map_keys("dist")))
    gold_sd = F.filter("_o", lambda o: o["option"] == F.col("gold"))[0]["sd"]
    return out.select(
        *keys, "gold", k.alias("K"), "n_reps", D.prob("dist", F.col("gold")).alias("p_gold"),
        F.array_max(F.map_values("dist")).alias("p_max"), (F.col("top") == F.col("gold")).alias("correct"),
        (F.col("top") == F.col("first_listed")).alias("chose_first_listed"),
        F.coalesce(F.col("top") == F.col("swap_target"), F.lit(False)).alias("chose_swap_target"),
        D.norm_entropy("dist").alias("norm_entropy"), D.log_score("dist", "gold").alias("nll"),
        D.brier("dist", "gold").alias("brier"), gold_sd.alias("rep_sd_p_gold"),
    )


def _cells_of_sums(rows: DataFrame, keys: Sequence[str], names: Sequence[str], consts: Sequence[Column]) -> DataFrame:
    """:func:`aggregate_cells` of rows that list exactly ``names``."""
    k = range(len(names))
    fixed = ["gold", "first_listed", "swap_target"]
    wide = rows.select(*dict.fromkeys([*keys, *fixed]), *[D.prob("dist", F.lit(o)).alias(f"_p{i}") for i, o in enumerate(names)])
    sums = [a for i in k for a in (F.sum(f"_p{i}").alias(f"_s{i}"), F.stddev_samp(f"_p{i}").alias(f"_d{i}"))]
    cell = wide.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_reps"), *consts, *sums)
    cell = cell.withColumns({f"_s{i}": F.col(f"_s{i}") / F.col("n_reps") for i in k})
    cell = cell.withColumn("_t", reduce(lambda a, b: a + b, [F.col(f"_s{i}") for i in k]))
    cell = cell.withColumns({f"_q{i}": F.when(F.col("_t") > 0, F.col(f"_s{i}") / F.col("_t")).otherwise(F.lit(1.0) / len(names)) for i in k})
    cell = cell.withColumn("p_max", F.greatest(*[F.col(f"_q{i}") for i in k]) if len(names) > 1 else F.col("_q0"))
    top = F.coalesce(*[F.when(F.col(f"_q{i}") == F.col("p_max"), F.lit(o)) for i, o in enumerate(names)])
    dist = F.create_map(*[c for i, o in enumerate(names) for c in (F.lit(o), F.col(f"_q{i}"))])
    sd = F.coalesce(*[F.when(F.col("gold") == F.lit(o), F.col(f"_d{i}")) for i, o in enumerate(names)])
    out = cell.withColumns({"dist": dist, "top": top})
    return out.select(
        *keys, "gold", F.lit(len(names)).alias("K"), "n_reps", D.prob("dist", F.col("gold")).alias("p_gold"),
        "p_max", (F.col("top") == F.col("gold")).alias("correct"),
        (F.col("top") == F.col("first_listed")).alias("chose_first_listed"),
        F.coalesce(F.col("top") == F.col("swap_target"), F.lit(False)).alias("chose_swap_target"),
        D.norm_entropy("dist").alias("norm_entropy"), D.log_score("dist", "gold").alias("nll"),
        D.brier("dist", "gold").alias("brier"), F.when(F.col("n_reps") > 1, sd).alias("rep_sd_p_gold"),
    )


def ensemble_decompose(members: DataFrame, item: Sequence[str], labels: Sequence[str] = ()) -> DataFrame:
    """Member distributions to total, aleatoric and mutual information (nats).

    Input rows are (item, member, label, p). Logarithms get ``p + 1e-12``. With ``labels``, rows are
    (item, member, dist) over exactly these: an item is one row of the exchange, with one sum for each label,
    and ``second`` is the most likely of the other labels.
    """
    if labels:
        p = [f"_p{i}" for i in range(len(labels))]
        rows = members.select(*item, *[x.alias(c) for x, c in zip(D.exactly("dist", labels), p, strict=True)])
        own = reduce(lambda a, b: a + b, [-F.col(c) * F.ln(F.col(c) + 1e-12) for c in p])
        per = rows.groupBy(*item).agg(F.count(F.lit(1)).alias("_members"), F.sum(own).alias("_ent"), *[F.sum(c).alias(c) for c in p])
        per = per.select(*item, (F.col("_ent") / F.col("_members")).alias("aleatoric"), *[(F.col(c) / F.col("_members")).alias(c) for c in p])
        # equal probabilities go to the label that is last in order, as in a maximum of (p, label)
        most = F.greatest(*p) if len(p) > 1 else F.col(p[0])
        top = F.coalesce(*[F.when(F.col(f"_p{labels.index(o)}") == most, F.lit(o)) for o in sorted(labels, reverse=True)])
        total = reduce(lambda a, b: a + b, [-F.col(c) * F.ln(F.col(c) + 1e-12) for c in p])
        rest = [F.when(F.col("top") != F.lit(o), F.col(c)) for o, c in zip(labels, p, strict=True)]
        best = F.greatest(*rest) if len(p) > 1 else F.lit(None).cast("double")
        second = F.coalesce(*[F.when(rest[labels.index(o)] == best, F.lit(o)) for o in sorted(labels, reverse=True)])
        got = per.withColumn("top", top).select(*item, "aleatoric", "top", second.alias("second"), most.alias("p_max"), total.alias("total"))
        mi = F.greatest(F.col("total") - F.col("aleatoric"), F.lit(0.0))
        return got.select(*item, "top", "p_max", "total", "aleatoric", mi.alias("mi"), F.lit(len(labels)).cast("long").alias("K"), "second")
    ent = -F.col("p") * F.ln(F.col("p") + 1e-12)
    per = members.groupBy(*item, "label").agg(
        F.avg("p").alias("p"), F.sum(ent).alias("_ent"), F.count(F.lit(1)).alias("_members")
    )
    total = F.sum(-F.col("p") * F.ln(F.col("p") + 1e-12))
    aleatoric = F.sum("_ent") / F.max("_members")
    return per.groupBy(*item).agg(
        F.max(F.struct("p", "label"))["label"].alias("top"), F.max("p").alias("p_max"),
        total.alias("total"), aleatoric.alias("aleatoric"),
        F.greatest(total - aleatoric, F.lit(0.0)).alias("mi"), F.count(F.lit(1)).alias("K"),
    )


def max_abs_diff(answers: DataFrame, unit: Sequence[str], options: Sequence[str] = ()) -> DataFrame:
    """Largest per-option difference over all replicate pairs: ``max - min`` suffices.

    With few options in all, a unit is one row of the exchange, with two columns for each option.
    ``options`` names them where every answer lists exactly these; else they are found in one more pass.
    """
    if options:
        k = range(len(options))
        rows = answers.select(*unit, *[x.alias(f"_p{i}") for i, x in enumerate(D.exactly("dist", options))])
        per = rows.groupBy(*unit).agg(*[a for i in k for a in (F.max(f"_p{i}").alias(f"_z{i}"), F.min(f"_p{i}").alias(f"_a{i}"))])
        gaps = [F.col(f"_z{i}") - F.col(f"_a{i}") for i in k]
        return per.select(*unit, (F.greatest(*gaps) if len(gaps) > 1 else gaps[0]).alias("max_abs_diff"))
    options = few_values(answers, F.explode(F.map_keys("dist")))
    if options is not None:
        some = answers.where(F.size("dist") > 0)  # a unit without any option has no row
        if not options:
            return some.groupBy(*unit).agg(F.lit(None).cast("double").alias("max_abs_diff"))
        own = [F.element_at("dist", F.lit(o)) for o in options]
        wide = some.groupBy(*unit).agg(*[a for i, x in enumerate(own) for a in (F.max(x).alias(f"_z{i}"), F.min(x).alias(f"_a{i}"))])
        gaps = F.array(*[F.col(f"_z{i}") - F.col(f"_a{i}") for i in range(len(options))])
        return wide.select(*unit, F.array_max(gaps).alias("max_abs_diff"))
    long = answers.select(*unit, F.explode("dist").alias("option", "p"))
    per = long.groupBy(*unit, "option").agg((F.max("p") - F.min("p")).alias("d"))
    return per.groupBy(*unit).agg(F.max("d").alias("max_abs_diff"))


def order_invariance(answers: DataFrame, unit: Sequence[str], labels: Sequence[str] = ()) -> DataFrame:
    """Mean pairwise Jensen-Shannon divergence between orders, and top agreement.

    A unit's orders meet in its row. Where a unit has many, equal distributions
    collapse first and only distinct ones are paired, weighted by how many order
    pairs they stand for. A unit with a null key has no pairs. With ``labels``, every distribution is over
    exactly these, and an order moves as its numbers.
    """
    if labels and small_groups(answers.select(F.xxhash64(*unit).alias("_h")), ["_h"], FEW_ORDERS):
        return _invariance_of_numbers(answers, unit, labels)
    if small_groups(answers, unit, FEW_ORDERS):
        per = answers.groupBy(*unit).agg(F.collect_list(F.struct("options", "dist")).alias("_a"))
        js = F.transform("_a", lambda x, i: fold(
            F.slice("_a", i + 2, F.size("_a")), lambda y: F.coalesce(D.js_divergence(x["dist"], y["dist"]), F.lit(0.0))
        ))
        tops = F.transform("_a", lambda x: D.top_option(x["dist"], x["options"]))
        one = F.struct(F.size("_a").cast("long").alias("orders"), (F.array_min("_t") == F.array_max("_t")).alias("agree"))
        keyed = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in unit])
        sums = F.when(keyed, fold(js, lambda x: x)).otherwise(0.0)
        got = per.select(*unit, "_a", tops.alias("_t")).select(*unit, F.inline(F.array(one.withField("_js", sums))))
        n = F.col("orders")
        return got.select(*unit, "orders", "agree", F.when(n > 1, F.col("_js") * 2 / (n * (n - 1))).alias("mean_js"))
    k = F.array_sort(F.map_entries("dist"))
    distinct = answers.groupBy(*unit, k.alias("_k")).agg(
        F.any_value("options").alias("options"), F.count(F.lit(1)).cast("double").alias("c"),
    ).withColumn("dist", F.map_from_entries("_k"))
    a = distinct.select(*unit, F.col("_k").alias("_ka"), F.col("dist").alias("_da"), F.col("c").alias("_ca"))
    b = distinct.select(*unit, F.col("_k").alias("_kb"), F.col("dist").alias("_db"), F.col("c").alias("_cb"))
    pairs = a.join(b, list(unit)).filter("_ka < _kb")
    js = pairs.groupBy(*unit).agg(F.sum(F.col("_ca") * F.col("_cb") * D.js_divergence("_da", "_db")).alias("_js"))
    top = D.top_option("dist", "options")
    n = F.sum("c")
    base = distinct.groupBy(*unit).agg(
        n.alias("orders"), (F.min(top) == F.max(top)).alias("agree")
    )
    return base.join(js, list(unit), "left").select(
        *unit, F.col("orders").cast("long").alias("orders"), "agree",
        F.when(F.col("orders") > 1, F.coalesce(F.col("_js"), F.lit(0.0)) * 2 / (F.col("orders") * (F.col("orders") - 1))).alias("mean_js"),
    )


def _invariance_of_numbers(answers: DataFrame, unit: Sequence[str], labels: Sequence[str]) -> DataFrame:
    """:func:`order_invariance` of few orders a unit over known labels; the first three orders are paired without a lambda."""
    rows = answers.select(*unit, F.array(*D.exactly("dist", labels)).alias("_p"), D.top_option("dist", "options").alias("_top"))
    per = rows.groupBy(*unit).agg(F.collect_list("_p").alias("_a"), (F.min("_top") == F.max("_top")).alias("agree"))

    def half(a: Column, m: Column) -> Column:
        return F.when(a > 0, a * F.ln(a / m)).otherwise(0.0)

    def js(x: Column, y: Column) -> Column:
        return reduce(lambda s, t: s + t, [half(x[i], (x[i] + y[i]) / 2) + half(y[i], (x[i] + y[i]) / 2) for i in range(len(labels))]) / 2

    n, a = F.size("_a"), F.col("_a")
    three = F.when(n < 2, 0.0).when(n == 2, js(a[0], a[1])).otherwise(js(a[0], a[1]) + js(a[0], a[2]) + js(a[1], a[2]))
    more = fold(F.transform("_a", lambda x, i: fold(F.slice("_a", i + 2, F.size("_a")), lambda y: js(x, y))), lambda x: x)
    keyed = reduce(lambda x, y: x & y, [F.col(c).isNotNull() for c in unit])
    sums = F.when(~keyed, 0.0).when(n <= 3, three).otherwise(more)
    return per.select(*unit, n.cast("long").alias("orders"), "agree", F.when(n > 1, sums * 2 / (n * (n - 1))).alias("mean_js"))


def complete_units(answers: DataFrame, expected: DataFrame) -> DataFrame:
    """Answers of units with exactly the expected number of replicates."""
    have = answers.groupBy("unit").agg(F.count(F.lit(1)).alias("_have"))
    full = have.join(expected, "unit").filter(F.col("_have") == F.col("replicates")).select("unit")
    return answers.join(full, "unit", "left_semi")


def per_option(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distributions as (keys, option, p) rows."""
    return df.select(*keys, F.explode("dist").alias("option", "p"))


def mean_of(c: Column, when: Column | None = None) -> Column:
    """Average of a boolean or number, optionally over a condition."""
    v = c.cast("double")
    return F.avg(v if when is None else F.when(when, v))
