"""A step in a monthly trend: least squares on monthly sums."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from credalis.functions.text import years_since
from credalis.operators import resample as B

SPECS = ("linear", "quadratic", "spline_4", "spline_6")
Z = 1.959963984540054
"""Normal quantile of the robust intervals."""


def monthly_values(df: DataFrame, keys: Sequence[str], value: str, cutoff: str, month: str = "month") -> DataFrame:
    """Monthly count, mean, time in years and step indicator."""
    t = df.groupBy(*keys, F.col(month).alias("month")).agg(F.count(value).cast("double").alias("n"), F.avg(value).alias("y"))
    return t.withColumns({"t": years_since("month"), "step": (F.col("month") >= cutoff).cast("double")})


def item_ols(df: DataFrame, keys: Sequence[str], value: str, cutoff: str) -> DataFrame:
    """Row-level OLS ``value ~ 1 + t + step`` from monthly sums.

    Time and step are constant inside a month, so monthly sums are sufficient; the
    3 x 3 system is solved in closed form by centring.
    """
    m = monthly_values(df, keys, value, cutoff)
    return _step_fit(m.withColumn("w", F.lit(1.0)), keys)


def _step_fit(m: DataFrame, keys: Sequence[str]) -> DataFrame:
    n = F.col("n") * F.col("w")

    def s(c: Column) -> Column:
        return F.sum(n * c)

    t, d, y = F.col("t"), F.col("step"), F.col("y")
    a = m.groupBy(*keys).agg(
        F.sum(n).alias("s0"), s(t).alias("st"), s(d).alias("sd"), s(y).alias("sy"), s(t * t).alias("stt"), s(d * d).alias("sdd"),
        s(t * d).alias("std"), s(t * y).alias("sty"), s(d * y).alias("sdy"),
    )

    def c(xy: str, x: str, z: str) -> Column:
        return F.col(xy) - F.col(x) * F.col(z) / F.col("s0")

    tt, dd, td, ty, dy = c("stt", "st", "st"), c("sdd", "sd", "sd"), c("std", "st", "sd"), c("sty", "st", "sy"), c("sdy", "sd", "sy")
    det = tt * dd - td * td
    ok = det > 1e-12
    return a.select(
        *keys, F.when(ok, (ty * dd - dy * td) / det).alias("slope_per_year"), F.when(ok, (dy * tt - ty * td) / det).alias("step"),
    )


def item_ols_interval(df: DataFrame, value: str, cutoff: str, b: int) -> DataFrame:
    """Slope and step with intervals from resampled months; resamples of one period drop out."""
    m = monthly_values(df, [], value, cutoff)
    w = B.cluster_weights(m, [], "month", b, "trend")
    d = _step_fit(m.join(w, "month"), ["b"])
    iv = d.agg(*B.interval(d, [], "slope_per_year", out="slope_"), *B.interval(d, [], "step", out="step_"), F.count("step").alias("resamples"))
    return item_ols(df, [], value, cutoff).join(F.broadcast(iv), F.lit(True))


def natural_spline(t: np.ndarray, df: int) -> np.ndarray:
    """Basis of the natural cubic splines with ``df`` knots at quantiles (spans 1 and t too)."""
    u = np.unique(t)
    knots = np.r_[u[0], np.percentile(u, 100 * np.linspace(0, 1, df)[1:-1]), u[-1]]

    def d(k: int) -> np.ndarray:
        a = np.maximum(t - knots[k], 0) ** 3 - np.maximum(t - knots[-1], 0) ** 3
        return a / (knots[-1] - knots[k])

    return np.column_stack([np.ones_like(t), t, *[d(k) - d(df - 2) for k in range(df - 2)]])


def design(t: np.ndarray, spec: str, step: np.ndarray | None) -> np.ndarray:
    if spec == "linear":
        x = np.column_stack([np.ones_like(t), t])
    elif spec == "quadratic":
        x = np.column_stack([np.ones_like(t), t, t**2])
    else:
        x = natural_spline(t, int(spec.split("_")[1]))
    return x if step is None else np.column_stack([x, step])


def _wls(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, float]:
    r = np.sqrt(w)
    coef = np.linalg.lstsq(x * r[:, None], y * r, rcond=None)[0]
    resid = y - x @ coef
    n, k = x.shape
    half = n / 2
    ll = -half * np.log((w * resid**2).sum()) - (1 + np.log(np.pi / half)) * half + 0.5 * np.log(w).sum()
    return coef, resid, 2 * k - 2 * ll, k * np.log(n) - 2 * ll


def _hac(x: np.ndarray, resid: np.ndarray, w: np.ndarray, lags: int = 3) -> np.ndarray:
    r = np.sqrt(w)
    xw = x * r[:, None]
    g = xw * (resid * r)[:, None]
    s = g.T @ g
    for lag in range(1, lags + 1):
        c = g[lag:].T @ g[:-lag]
        s += (1 - lag / (lags + 1)) * (c + c.T)
    bread = np.linalg.pinv(xw.T @ xw)
    return bread @ s @ bread


def step_trend(df: DataFrame, keys: Sequence[str], value: str, cutoff: str, b: int, block: int = 6, seed: int = 0) -> DataFrame:
    """Step at the cutoff under four trends, with HAC and residual-block intervals, AIC and BIC.

    Each group is a monthly series: rows are summed to months before they meet here.
    """
    m = monthly_values(df, keys, value, cutoff)
    src, group = (m, list(keys)) if keys else (m.withColumn("_all", F.lit(0)), ["_all"])
    fields = [f for f in src.schema.fields if f.name in group]
    num = ("step", "hac_lo", "hac_hi", "block_lo", "block_hi", "aic_with", "aic_without", "bic_with", "bic_without")
    schema = T.StructType([*fields, T.StructField("spec", T.StringType()), *[T.StructField(c, T.DoubleType()) for c in num]])

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("month")
        t, y, w, step = (pdf[c].to_numpy(float) for c in ("t", "y", "n", "step"))
        rows = []
        for spec in SPECS:
            x = design(t, spec, step)
            coef, resid, aic, bic = _wls(x, y, w)
            _, _, aic0, bic0 = _wls(design(t, spec, None), y, w)
            se = float(np.sqrt(_hac(x, resid, w)[-1, -1]))
            rng = np.random.Generator(np.random.Philox(key=seed))
            fitted, n, size = x @ coef, len(y), min(block, len(y))
            starts = rng.integers(0, n - size + 1, (b, -(-n // size)))
            noise = resid[(starts[:, :, None] + np.arange(size)).reshape(b, -1)[:, :n]]
            # the step is linear in the weighted values, so all resamples are one product
            boots = ((fitted + noise) * np.sqrt(w)) @ np.linalg.pinv(x * np.sqrt(w)[:, None])[-1]
            lo, hi = np.percentile(boots, [2.5, 97.5])
            key = {k: pdf[k].iloc[0] for k in group}
            rows.append({**key, "spec": spec, **dict(zip(num, (coef[-1], coef[-1] - Z * se, coef[-1] + Z * se, lo, hi, aic, aic0, bic, bic0), strict=True))})
        return pd.DataFrame(rows)

    out = src.groupBy(*group).applyInPandas(solve, schema)
    return out if keys else out.drop("_all")
