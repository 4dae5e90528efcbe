"""Queries over single distributions, checked on every answer of the answers view."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credalis.functions import dist as D
from credalis.operators import scoring as S
from credalis.plans.catalog import query
from credalis.plans.views import OPTIONS, Tables


def summary(df: DataFrame, cols: dict[str, Column], keys: Sequence[str] = ("set_name", "replicate")) -> DataFrame:
    """Mean, smallest and largest value of each expression per group."""
    named = df.select(*keys, *[c.cast("double").alias(n) for n, c in cols.items()])
    aggs = [F.count(F.lit(1)).alias("n")]
    for n in cols:
        aggs += [
            F.round(F.avg(n), 8).alias(f"{n}_avg"), F.round(F.min(n), 8).alias(f"{n}_min"),
            F.round(F.max(n), 8).alias(f"{n}_max"),
        ]
    return named.groupBy(*keys).agg(*aggs)


def summary_sql(cols: dict[str, str], source: str = "answers", keys: str = "set_name, replicate") -> str:
    parts = []
    for n, e in cols.items():
        parts += [
            f"round(avg({n}), 8) AS {n}_avg", f"round(min({n}), 8) AS {n}_min", f"round(max({n}), 8) AS {n}_max",
        ]
    inner = ", ".join(f"({e})::DOUBLE AS {n}" for n, e in cols.items())
    return f"SELECT {keys}, count(*) AS n, {', '.join(parts)} FROM (SELECT {keys}, {inner} FROM {source}) GROUP BY {keys}"


ENT = "-(pa*ln(pa) + pb*ln(pb) + pc*ln(pc) + pd*ln(pd))"
PGOLD = "CASE gold WHEN 'A' THEN pa WHEN 'B' THEN pb WHEN 'C' THEN pc ELSE pd END"
PMAX = "greatest(pa, pb, pc, pd)"


def reversed_dist() -> Column:
    """A second distribution of the same answer: the options in reverse order."""
    opts = F.array(*[F.lit(o) for o in OPTIONS])
    return F.map_from_arrays(opts, F.reverse(F.map_values("dist")))


@query("normalise_dist", summary_sql({"a": "pa", "total": "pa + pb + pc + pd"}), "answers")
def normalise_dist(t: Tables) -> DataFrame:
    raw = F.transform_values("dist", lambda k, p: p * (F.col("replicate") + 2))
    d = D.normalise(raw)
    return summary(t.answers, {"a": D.prob(d, F.lit("A")), "total": D.mass(d)})


@query("entropy", summary_sql({"h": ENT, "hn": f"({ENT}) / ln(4)"}), "answers")
def entropy(t: Tables) -> DataFrame:
    return summary(t.answers, {"h": D.entropy("dist"), "hn": D.norm_entropy("dist")})


@query(
    "log_score",
    summary_sql({"s": f"-ln(greatest({PGOLD}, 1e-12))", "absent": "-ln(1e-12::DOUBLE)"}), "answers",
)
def log_score(t: Tables) -> DataFrame:
    return summary(t.answers, {"s": D.log_score("dist", "gold"), "absent": D.log_score("dist", F.lit("Z"))})


@query(
    "brier",
    summary_sql({
        "s": "pow(pa - (gold='A')::INT, 2) + pow(pb - (gold='B')::INT, 2) + pow(pc - (gold='C')::INT, 2) + pow(pd - (gold='D')::INT, 2)",
        "absent": "pa*pa + pb*pb + pc*pc + pd*pd",
    }), "answers",
)
def brier(t: Tables) -> DataFrame:
    return summary(t.answers, {"s": D.brier("dist", "gold"), "absent": D.brier("dist", F.lit("Z"))})


@query("choice_confidence", summary_sql({"c": f"least(1, greatest(0, (4 * {PMAX} - 1) / 3))"}), "answers")
def choice_confidence(t: Tables) -> DataFrame:
    return summary(t.answers, {"c": D.choice_confidence("dist")})


@query(
    "tv_distance",
    summary_sql({
        "d": "0.5 * (2 * abs(pa - pd) + 2 * abs(pb - pc))",
        "part": "0.5 * (abs(pa - pd) + pb + pc + pd)",
    }), "answers",
)
def tv_distance(t: Tables) -> DataFrame:
    only_a = F.create_map(F.lit("A"), D.prob("dist", F.lit("D")))
    return summary(t.answers, {"d": D.tv_distance("dist", reversed_dist()), "part": D.tv_distance("dist", only_a)})


@query(
    "js_divergence",
    summary_sql({
        "d": "pa*ln(2*pa/(pa+pd)) + pd*ln(2*pd/(pa+pd)) + pb*ln(2*pb/(pb+pc)) + pc*ln(2*pc/(pb+pc))",
    }), "answers",
)
def js_divergence(t: Tables) -> DataFrame:
    return summary(t.answers, {"d": D.js_divergence("dist", reversed_dist())})


@query(
    "clipped_logit",
    summary_sql({
        "a": "ln(least(greatest(pa, 1e-3), 1 - 1e-3) / (1 - least(greatest(pa, 1e-3), 1 - 1e-3)))",
        "b": "ln(least(greatest(pa, 1e-4), 1 - 1e-4) / (1 - least(greatest(pa, 1e-4), 1 - 1e-4)))",
    }), "answers",
)
def clipped_logit(t: Tables) -> DataFrame:
    pa = D.prob("dist", F.lit("A"))
    return summary(t.answers, {"a": D.clipped_logit(pa), "b": D.clipped_logit(pa, D.TEMPER_FLOOR)})


def _expected_sql() -> dict[str, str]:
    ideal = {"pa": "pd", "pb": "pc", "pc": "pb", "pd": "pa"}
    sq, isq = "(pa*pa + pb*pb + pc*pc + pd*pd)", "(pa*pa + pb*pb + pc*pc + pd*pd)"
    brier = " + ".join(f"{q} * ({sq} - 2 * {p} + 1)" for p, q in ideal.items())
    log = " + ".join(f"-{q} * ln(greatest({p}, 1e-4))" for p, q in ideal.items())
    ib = " + ".join(f"{q} * ({isq} - 2 * {q} + 1)" for q in ideal.values())
    return {"brier": brier, "log_loss": log, "ideal_brier": ib, "ideal_log_loss": ENT}


@query("expected_scores", summary_sql(_expected_sql()), "answers")
def expected_scores(t: Tables) -> DataFrame:
    df = t.answers.withColumn("e", D.expected_scores("dist", reversed_dist()))
    return summary(df, {n: F.col(f"e.{n}") for n in ("brier", "log_loss", "ideal_brier", "ideal_log_loss")})


def _temper_sql(t: float) -> str:
    w = [f"pow(greatest({p}, 1e-4), 1.0::DOUBLE / {t})" for p in ("pa", "pb", "pc", "pd")]
    return f"{w[0]} / ({' + '.join(w)})"


@query("temper", summary_sql({"warm": _temper_sql(2.0), "cold": _temper_sql(0.5)}), "answers")
def temper(t: Tables) -> DataFrame:
    a = F.lit("A")
    return summary(t.answers, {"warm": D.prob(D.temper("dist", 2.0), a), "cold": D.prob(D.temper("dist", 0.5), a)})


@query(
    "apply_platt",
    summary_sql({"c": f"1 / (1 + exp(-(0.7 * ln(least(greatest({PMAX}, 1e-4), 1 - 1e-4) / (1 - least(greatest({PMAX}, 1e-4), 1 - 1e-4))) - 0.2)))"}),
    "answers",
)
def apply_platt(t: Tables) -> DataFrame:
    return summary(t.answers, {"c": D.apply_platt(F.array_max(F.map_values("dist")), 0.7, -0.2)})


@query(
    "odds_readings",
    """SELECT fmt, count(*) AS n, round(avg(r1), 8) AS r1, round(avg(r2), 8) AS r2 FROM (
       SELECT CASE replicate WHEN 0 THEN 'noul' WHEN 1 THEN 'score' ELSE 'instructed' END AS fmt,
              CASE replicate WHEN 0 THEN known WHEN 1 THEN (level + 0.5) / 10 ELSE pa END AS r1,
              CASE replicate WHEN 0 THEN 1 - known WHEN 1 THEN (9 - level + 0.5) / 10 ELSE pb END AS r2
       FROM answers) GROUP BY fmt""",
    "answers",
)
def odds_readings(t: Tables) -> DataFrame:
    fmt = F.when(F.col("replicate") == 0, "noul").when(F.col("replicate") == 1, "score").otherwise("instructed")
    r = D.odds_reading(
        fmt, F.array("known", 1 - F.col("known")), F.array("level", 9 - F.col("level")),
        F.array(D.prob("dist", F.lit("A")), D.prob("dist", F.lit("B"))),
    )
    df = t.answers.select(fmt.alias("fmt"), r.alias("r"))
    return df.groupBy("fmt").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("r")[0]), 8).alias("r1"),
        F.round(F.avg(F.col("r")[1]), 8).alias("r2"),
    )


@query(
    "renormalised_readings",
    """WITH e AS (SELECT set_name, pa, pb, pc, pd, 0.8 * pa AS ra, 1.1 * pb AS rb, pc AS rc, 0.5 * pc AS rd FROM answers),
       n AS (SELECT *, ra + rb + rc + rd AS s FROM e),
       x AS (SELECT set_name, s AS sum, (abs(ra-pa)+abs(rb-pb)+abs(rc-pc)+abs(rd-pd))/4 AS mae_raw,
         (abs(ra/s-pa)+abs(rb/s-pb)+abs(rc/s-pc)+abs(rd/s-pd)) AS g,
         pa*ln(pa/greatest(ra/s,1e-6)) + pb*ln(pb/greatest(rb/s,1e-6)) + pc*ln(pc/greatest(rc/s,1e-6)) + pd*ln(pd/greatest(rd/s,1e-6)) AS kl FROM n)
       SELECT coalesce(set_name, 'all') AS set_name, count(*) AS n, round(avg(sum), 8) AS sum, round(avg(mae_raw), 8) AS mae_raw,
              round(avg(g / 4), 8) AS mae_renormalised, round(avg(g / 2), 8) AS tv_renormalised, round(avg(kl), 8) AS kl_renormalised
       FROM x GROUP BY ROLLUP (set_name)""",
    "answers",
)
def renormalised_readings(t: Tables) -> DataFrame:
    p = {o: D.prob("dist", F.lit(o)) for o in OPTIONS}
    read = F.array(0.8 * p["A"], 1.1 * p["B"], p["C"], 0.5 * p["C"])
    df = t.answers.select("set_name", D.renormalised_errors(read, F.map_values("dist")).alias("e"))
    cols = ("sum", "mae_raw", "mae_renormalised", "tv_renormalised", "kl_renormalised")
    return df.rollup("set_name").agg(
        F.count(F.lit(1)).alias("n"), *[F.round(F.avg(f"e.{c}"), 8).alias(c) for c in cols]
    ).withColumn("set_name", F.coalesce("set_name", F.lit("all")))


@query(
    "valid_spread",
    summary_sql({"v": "-(pa/(pa+pc)*ln(pa/(pa+pc)) + pc/(pa+pc)*ln(pc/(pa+pc)))/ln(2)", "none": "0"}), "answers",
)
def valid_spread(t: Tables) -> DataFrame:
    keys = F.array(F.lit("A"), F.lit("C"))
    return summary(t.answers, {"v": D.valid_spread("dist", keys), "none": D.valid_spread("dist", F.array(F.lit("Y"), F.lit("Z")))})


@query(
    "top_option",
    f"""WITH r AS (SELECT *, {PMAX} AS p1, list_sort([pa, pb, pc, pd], 'DESC')[2] AS p2 FROM answers)
       SELECT set_name, CASE p1 WHEN pa THEN 'A' WHEN pb THEN 'B' WHEN pc THEN 'C' ELSE 'D' END AS top,
              count(*) AS n, round(avg(p1), 8) AS p_top, round(avg(p2), 8) AS p_second, round(avg(p2 / (1 - p1)), 8) AS runner_up_share
       FROM r GROUP BY 1, 2""",
    "answers",
)
def top_option(t: Tables) -> DataFrame:
    r = t.answers.select("set_name", D.ranked_options("dist", "options").alias("r"), D.top_option("dist", "options").alias("top"))
    return r.groupBy("set_name", "top").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("r")[0]["p"]), 8).alias("p_top"),
        F.round(F.avg(F.col("r")[1]["p"]), 8).alias("p_second"),
        F.round(F.avg(D.runner_up_share(F.col("r"))), 8).alias("runner_up_share"),
    )


@query("remap_labels", summary_sql({"w": "pa", "z": "pd"}), "answers")
def remap_labels(t: Tables) -> DataFrame:
    codes = F.create_map(*[F.lit(x) for o, lab in zip(OPTIONS, "wxyz", strict=True) for x in (o, lab)])
    d = D.remap_labels("dist", codes)
    return summary(t.answers, {"w": D.prob(d, F.lit("w")), "z": D.prob(d, F.lit("z"))})


@query(
    "confidence_formula_check",
    f"""SELECT set_name, round(max(abs(reported - c)), 8) AS residual_max, max(abs(reported - c)) < 1e-6 AS matches,
              round(min(s), 8) AS sum_min, round(max(s), 8) AS sum_max, count(*) AS n FROM (
       SELECT set_name, (4 * {PMAX} - 1) / 3 + CASE WHEN set_name = 'R' THEN 1e-3 ELSE 0 END AS reported,
              least(1, greatest(0, (4 * {PMAX} - 1) / 3)) AS c, pa + pb + pc + pd AS s FROM answers) GROUP BY 1""",
    "answers",
)
def confidence_formula_check(t: Tables) -> DataFrame:
    """Reported confidence against the documented formula; set R is off on purpose."""
    c = D.choice_confidence("dist")
    bump = F.when(F.col("set_name") == "R", 1e-3).otherwise(0.0)
    reported = (4 * F.array_max(F.map_values("dist")) - 1) / 3 + bump
    df = t.answers.select("set_name", F.abs(reported - c).alias("r"), D.mass("dist").alias("s"))
    return df.groupBy("set_name").agg(
        F.round(F.max("r"), 8).alias("residual_max"), (F.max("r") < 1e-6).alias("matches"),
        F.round(F.min("s"), 8).alias("sum_min"), F.round(F.max("s"), 8).alias("sum_max"), F.count(F.lit(1)).alias("n"),
    )


@query(
    "max_abs_diff",
    """SELECT set_name, count(*) AS n, round(avg(d), 8) AS mean, round(max(d), 8) AS largest FROM (
       SELECT unit, any_value(set_name) AS set_name, greatest(max(pa)-min(pa), max(pb)-min(pb), max(pc)-min(pc), max(pd)-min(pd)) AS d
       FROM answers GROUP BY unit) GROUP BY 1""",
    "answers",
)
def max_abs_diff(t: Tables) -> DataFrame:
    d = S.max_abs_diff(t.answers, ["set_name", "unit"])
    return d.groupBy("set_name").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("max_abs_diff"), 8).alias("mean"), F.round(F.max("max_abs_diff"), 8).alias("largest")
    )


@query(
    "ensemble_decompose",
    """WITH m AS (SELECT unit, any_value(set_name) AS set_name, option, avg(p) AS p, sum(-p * ln(p + 1e-12)) AS e, count(*) AS k
         FROM answers_long GROUP BY unit, option),
       u AS (SELECT unit, any_value(set_name) AS set_name, sum(-p * ln(p + 1e-12)) AS total, sum(e) / max(k) AS aleatoric, max(p) AS p_max FROM m GROUP BY unit)
       SELECT set_name, count(*) AS n, round(avg(total), 8) AS total, round(avg(aleatoric), 8) AS aleatoric,
              round(avg(greatest(total - aleatoric, 0)), 8) AS mi, round(avg(p_max), 8) AS p_max FROM u GROUP BY 1""",
    "answers_long",
)
def ensemble_decompose(t: Tables) -> DataFrame:
    """Replicates play the ensemble members."""
    e = S.ensemble_decompose(t.answers, ["set_name", "unit"], OPTIONS)
    return e.groupBy("set_name").agg(
        F.count(F.lit(1)).alias("n"), *[F.round(F.avg(c), 8).alias(c) for c in ("total", "aleatoric", "mi", "p_max")]
    )


FLOORS = (1e-2, 1e-3, 1e-4, 1e-6)
"""Log-loss floors (fixed values)."""


@query(
    "score_floors",
    f"""SELECT set_name, count(*) AS n, round(avg((p = 0)::INT), 8) AS zero_on_answer,
       {', '.join(f"round(avg(-ln(greatest(p, {f}))), 8) AS log_loss_{i}" for i, f in enumerate(FLOORS))}
       FROM (SELECT set_name, CASE WHEN {PGOLD} < 0.02 THEN 0 ELSE {PGOLD} END AS p FROM answers) GROUP BY 1""",
    "answers",
)
def score_floors(t: Tables) -> DataFrame:
    """Options below 2 % count as omitted, so the floors matter."""
    kept = F.map_filter("dist", lambda k, p: p >= 0.02)
    p = D.prob(kept, F.col("gold"))
    df = t.answers.select("set_name", p.alias("p"))
    return df.groupBy("set_name").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("p") == 0).cast("double")), 8).alias("zero_on_answer"),
        *[F.round(F.avg(-F.ln(F.greatest("p", F.lit(f)))), 8).alias(f"log_loss_{i}") for i, f in enumerate(FLOORS)],
    )


@query(
    "label_distribution",
    """WITH c AS (SELECT o_custkey AS item, o_orderstatus AS label, count(*) AS k FROM orders GROUP BY 1, 2)
       SELECT item, label, round(k / sum(k) OVER (PARTITION BY item), 8) AS p FROM c""",
)
def label_distribution(t: Tables) -> DataFrame:
    """Orders play annotators: counts of statuses per customer."""
    counts = t.orders.groupBy(F.col("o_custkey").alias("item"), F.col("o_orderstatus").alias("label")).count()
    maps = counts.groupBy("item").agg(
        F.map_from_entries(F.collect_list(F.struct("label", F.col("count").cast("double")))).alias("c")
    )
    return maps.select("item", F.explode(D.label_distribution("c")).alias("label", "p")).select(
        "item", "label", F.round("p", 8).alias("p")
    )


@query(
    "subset_mass",
    summary_sql({"valid": "pa + pc", "ruled_out": "pb + pd", "confidence": "greatest(known, 1 - known)", "is_right": "((known >= 0.5) = (gold IN ('A','B')))::INT"}),
    "answers",
)
def subset_mass(t: Tables) -> DataFrame:
    truth = F.col("gold").isin("A", "B")
    return summary(t.answers, {
        "valid": D.subset_mass("dist", F.array(F.lit("A"), F.lit("C"))),
        "ruled_out": D.subset_mass("dist", F.array(F.lit("B"), F.lit("D"))),
        "confidence": D.verification_confidence("known"), "is_right": (F.col("known") >= 0.5) == truth,
    })


@query(
    "ideal_distribution",
    """SELECT set_name, replicate, gold, count(*) AS n,
       round(avg(CASE replicate WHEN 0 THEN (gold = 'A')::INT::DOUBLE WHEN 1 THEN pa ELSE CASE WHEN gold = 'A' THEN 0 ELSE 1.0/3 END END), 8) AS ideal_a
       FROM answers GROUP BY 1, 2, 3""",
    "answers",
)
def ideal_distribution(t: Tables) -> DataFrame:
    cell = F.when(F.col("replicate") == 0, "stated").when(F.col("replicate") == 1, "chances").otherwise("ruled")
    d = D.ideal_distribution(cell, F.col("options"), F.array("gold"), F.col("gold"), F.col("dist"))
    df = t.answers.select("set_name", "replicate", "gold", D.prob(d, F.lit("A")).alias("a"))
    return df.groupBy("set_name", "replicate", "gold").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("a"), 8).alias("ideal_a")
    )
