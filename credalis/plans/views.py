"""Probability rows derived from the given tables, as DataFrames and as SQL.

The tables hold no probability answers, so each view derives them from whole
tables with the same md5-based rule in Spark and in the checking SQL.
"""

from __future__ import annotations

from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from credalis.functions.seeded import key_hash

CUTOFF = "1999-07"
"""First month of the later period in the ``rows`` view."""
OPTIONS = ("A", "B", "C", "D")


def hex4(h: Column, i: int) -> Column:
    """The ``i``-th 16-bit number of a hex hash."""
    return F.conv(F.substring(h, 4 * i + 1, 4), 16, 10).cast("double")


def bits(h: Column, start: int, digits: int) -> Column:
    """``digits`` hex digits of a hash, up to 16, as one long: parsed once for all numbers in it."""
    return F.conv(F.substring(h, start, digits), 16, -10).cast("long")


def part16(c: str, shift: int) -> Column:
    """16 bits of a long as a double."""
    return F.shiftrightunsigned(c, shift).bitwiseAND(F.lit(65535)).cast("double")


def spread(df: DataFrame, *by: str) -> DataFrame:
    """Give every core a share of a table that arrives in fewer splits than cores.

    A single small file is one task, and the derived columns are costly. A table of
    many splits is left alone, so nothing is shuffled at scale.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *by) if df.rdd.getNumPartitions() < cores else df


class Tables:
    """The given tables and the views over them, read lazily."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def rows(self) -> DataFrame:
        """Scored answers: unit, month, p_max, post, correct, set_name, p_known."""
        unit = F.concat_ws(
            "|", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
            F.round(F.col("l_extendedprice") * 100).cast("long"),
        )
        month = F.date_format("l_shipdate", "yyyy-MM")
        df = spread(self.lineitem, "l_orderkey", "l_partkey").select(
            unit.alias("unit"), month.alias("month"),
            F.round(F.lit(0.5) + 5 * F.col("l_discount"), 9).alias("p_max"),
            (month >= CUTOFF).alias("post"), F.col("l_returnflag").alias("set_name"),
            F.round(1 - 10 * F.col("l_tax"), 9).alias("p_known"),
            F.col("l_quantity").alias("_q"), F.col("l_suppkey").alias("supp"),
            F.col("l_orderkey").alias("okey"), F.col("l_linenumber").alias("line"),
        )
        drop = F.when(F.col("post"), F.lit(0.25)).otherwise(F.lit(0.0))
        return df.withColumn("correct", (F.col("_q") - 0.5) / 50 < F.col("p_max") - drop).drop("_q")

    @cached_property
    def answers(self) -> DataFrame:
        """Three answers per unit over options A-D, with gold option and a yes/no answer.

        Only the replicate number is a generator output. Hash, bits and weights are columns that
        are used several times, so each is worked out once, and not at all where nothing needs it.
        """
        opts = F.array(*[F.lit(o) for o in OPTIONS])
        gold = F.element_at(opts, (hex4(key_hash("gold", "unit"), 0) % 4 + 1).cast("int"))
        base = self.rows.select("unit", "set_name", "month", "post", gold.alias("gold"))
        base = base.select("*", F.explode(F.array(*[F.lit(r) for r in range(3)])).alias("replicate"))
        kept = ["unit", "set_name", "month", "post", "replicate", "gold"]
        base = base.withColumn("_h", key_hash("rep", "unit", "replicate"))
        base = base.select(*kept, bits(F.col("_h"), 1, 16).alias("_hi"), bits(F.col("_h"), 17, 12).alias("_lo"))
        raw = [f"_w{i}" for i in range(len(OPTIONS))]
        base = base.withColumns({w: part16("_hi", 48 - 16 * i) + 1 for i, w in enumerate(raw)})
        base = base.withColumn("_t", reduce(lambda x, y: x + y, [F.col(w) for w in raw]))
        return base.select(
            "unit", "set_name", "month", "post", "replicate", opts.alias("options"),
            # built key by key: the optimizer reads a probability out of it without making the map
            F.create_map(*[c for o, w in zip(OPTIONS, raw, strict=True) for c in (F.lit(o), F.col(w) / F.col("_t"))]).alias("dist"), "gold",
            (part16("_lo", 32) / 65536).alias("known"), (part16("_lo", 16) / 65536 * 9).alias("level"),
            F.concat(F.lit("m"), (part16("_lo", 0) % 2).cast("int").cast("string")).alias("model"),
        )

    @cached_property
    def cells(self) -> DataFrame:
        """Design cells: order priority as condition, customer as item."""
        return self.orders.select(
            F.col("o_custkey").alias("item"), F.substring("o_orderpriority", 1, 1).cast("int").alias("dose"),
            (F.col("o_totalprice") / 500000).alias("value"), F.col("o_orderstatus").alias("arm"),
            "o_orderkey",
        )

    @cached_property
    def scores_binary(self) -> DataFrame:
        """Labelled documents: score = characters, positive = quality, stratum = language."""
        words = F.size(F.split("text", " "))
        return self.labels.join(self.documents, "doc_id").select(
            "doc_id", "lang", "source", "text",
            F.col("n_chars").cast("double").alias("score"),
            (F.col("n_chars") / words).alias("ratio"),
            (F.col("quality") == 1).alias("positive"), (F.col("toxic") == 1).alias("toxic"),
        )

    @cached_property
    def questions(self) -> DataFrame:
        """Short dated questions built from orders, with answer, month and category."""
        d = F.col("o_orderdate")
        text = F.concat(
            F.lit("Was order "), F.col("o_orderkey").cast("string"), F.lit(" by customer "),
            F.col("o_custkey").cast("string"), F.lit(" on "), F.date_format(d, "MMMM d, yyyy"),
            F.lit(" worth more than "), F.round(F.col("o_totalprice")).cast("long").cast("string"), F.lit("?"),
        )
        return spread(self.orders, "o_orderkey").select(
            F.concat(F.lit("q"), F.col("o_orderkey").cast("string")).alias("unit"), text.alias("question"),
            F.date_format(d, "yyyy-MM").alias("month"), F.col("o_orderstatus").alias("category"),
            F.col("o_orderpriority").alias("relation"), F.col("o_custkey").alias("subject"),
            F.col("o_totalprice").alias("value"), F.col("o_orderkey").alias("okey"),
        )


def _hex(h: str, i: int) -> str:
    return f"(('0x' || substr({h}, {4 * i + 1}, 4))::BIGINT)::DOUBLE"


# name -> (views it needs, SELECT). The SQL side of the views above.
CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "rows": (
        (),
        f"""SELECT *, (l_quantity - 0.5) / 50 < p_max - CASE WHEN post THEN 0.25::DOUBLE ELSE 0::DOUBLE END AS correct FROM (
        SELECT concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey,
               CAST(round(l_extendedprice * 100) AS BIGINT)) AS unit,
               strftime(l_shipdate, '%Y-%m') AS month, round(0.5::DOUBLE + 5 * l_discount, 9) AS p_max,
               strftime(l_shipdate, '%Y-%m') >= '{CUTOFF}' AS post, l_returnflag AS set_name,
               round(1 - 10 * l_tax, 9) AS p_known, l_quantity, l_suppkey AS supp,
               l_orderkey AS okey, l_linenumber AS line FROM lineitem)""",
    ),
    "answers": (
        ("rows",),
        f"""SELECT unit, set_name, month, post, replicate, gold, known, level, model,
               wa / t AS pa, wb / t AS pb, wc / t AS pc, wd / t AS pd FROM (
        SELECT *, wa + wb + wc + wd AS t FROM (
        SELECT unit, set_name, month, post, replicate,
               1 + {_hex("h", 0)} AS wa, 1 + {_hex("h", 1)} AS wb, 1 + {_hex("h", 2)} AS wc, 1 + {_hex("h", 3)} AS wd,
               {_hex("h", 4)} / 65536 AS known, {_hex("h", 5)} / 65536 * 9 AS level,
               'm' || CAST({_hex("h", 6)}::BIGINT % 2 AS VARCHAR) AS model,
               ['A','B','C','D'][({_hex("g", 0)}::BIGINT % 4 + 1)] AS gold FROM (
        SELECT unit, set_name, month, post, replicate, md5('rep|' || unit || '|' || replicate) AS h,
               md5('gold|' || unit) AS g
        FROM rows, (SELECT unnest([0, 1, 2]) AS replicate))))""",
    ),
    "answers_long": (
        ("answers",),
        """SELECT unit, set_name, month, post, replicate, gold, model, o.opt AS option, o.pos AS pos,
               CASE o.opt WHEN 'A' THEN pa WHEN 'B' THEN pb WHEN 'C' THEN pc ELSE pd END AS p
        FROM answers, (SELECT unnest(['A','B','C','D']) AS opt, unnest([0,1,2,3]) AS pos) o""",
    ),
    "unit_mean": (
        ("answers",),
        """SELECT *, CASE greatest(pa, pb, pc, pd) WHEN pa THEN 'A' WHEN pb THEN 'B' WHEN pc THEN 'C' ELSE 'D' END AS top,
               greatest(pa, pb, pc, pd) AS p_max,
               -(pa * ln(pa) + pb * ln(pb) + pc * ln(pc) + pd * ln(pd)) / ln(4) AS norm_entropy,
               CASE gold WHEN 'A' THEN pa WHEN 'B' THEN pb WHEN 'C' THEN pc ELSE pd END AS p_gold FROM (
        SELECT unit, any_value(set_name) AS set_name, any_value(month) AS month, bool_or(post) AS post,
               any_value(gold) AS gold, sum(pa) / sum(pa + pb + pc + pd) AS pa, sum(pb) / sum(pa + pb + pc + pd) AS pb,
               sum(pc) / sum(pa + pb + pc + pd) AS pc, sum(pd) / sum(pa + pb + pc + pd) AS pd,
               avg(known) AS p_known, avg(level) AS s_level FROM answers GROUP BY unit)""",
    ),
    "cells": (
        (),
        """SELECT o_custkey AS item, CAST(substr(o_orderpriority, 1, 1) AS INT) AS dose,
               o_totalprice / 500000 AS value, o_orderstatus AS arm, o_orderkey FROM orders""",
    ),
    "scores_binary": (
        (),
        """SELECT doc_id, lang, source, text, n_chars::DOUBLE AS score,
               n_chars / len(string_split(text, ' '))::DOUBLE AS ratio,
               quality = 1 AS positive, toxic = 1 AS toxic FROM labels JOIN documents USING (doc_id)""",
    ),
    "questions": (
        (),
        """SELECT 'q' || o_orderkey AS unit, 'Was order ' || o_orderkey || ' by customer ' || o_custkey || ' on '
               || strftime(o_orderdate, '%B %-d, %Y') || ' worth more than ' || CAST(round(o_totalprice) AS BIGINT) || '?' AS question,
               strftime(o_orderdate, '%Y-%m') AS month, o_orderstatus AS category, o_orderpriority AS relation,
               o_custkey AS subject, o_totalprice AS value, o_orderkey AS okey FROM orders""",
    ),
}
