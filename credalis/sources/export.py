"""Checks before publishing: no dataset text, no private fields."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Names of fields that would carry text, and the string limit.
TEXT_FIELDS = frozenset(
    "answer_text context customer_message facts hypothesis input instructions message original "
    "paragraph paragraphs passage premise prompt question questions request sentence sentences "
    "state text utterance".split()
)
MAX_STRING = 100


def _has_string(c: Column, dtype: T.DataType) -> Column:
    """Whether a value is, or contains, a string (map keys do not count)."""
    if isinstance(dtype, T.StringType):
        return c.isNotNull()
    if isinstance(dtype, T.StructType):
        out = F.lit(False)
        for f in dtype.fields:
            out = out | _has_string(c[f.name], f.dataType)
        return out
    if isinstance(dtype, T.ArrayType):
        return F.coalesce(F.exists(c, lambda x: _has_string(x, dtype.elementType)), F.lit(False))
    if isinstance(dtype, T.MapType):
        return F.coalesce(F.exists(F.map_values(c), lambda x: _has_string(x, dtype.valueType)), F.lit(False))
    return F.lit(False)


def _long_string(c: Column, dtype: T.DataType, limit: int) -> Column:
    if isinstance(dtype, T.StringType):
        return F.coalesce(F.length(c) > limit, F.lit(False))
    if isinstance(dtype, T.StructType):
        out = F.lit(False)
        for f in dtype.fields:
            out = out | F.lit(len(f.name) > limit) | _long_string(c[f.name], f.dataType, limit)
        return out
    if isinstance(dtype, T.ArrayType):
        return F.coalesce(F.exists(c, lambda x: _long_string(x, dtype.elementType, limit)), F.lit(False))
    if isinstance(dtype, T.MapType):
        keys = F.exists(F.map_keys(c), lambda k: _long_string(k, dtype.keyType, limit))
        values = F.exists(F.map_values(c), lambda x: _long_string(x, dtype.valueType, limit))
        return F.coalesce(keys | values, F.lit(False))
    return F.lit(False)


def _text_fields(c: Column, dtype: T.DataType, path: str, depth: int) -> list[Column]:
    """One candidate path per text-named field, null when it does not offend."""
    out: list[Column] = []
    if isinstance(dtype, T.StructType):
        for f in dtype.fields:
            where = f"{path}.{f.name}" if path else f.name
            sub = c[f.name]
            if f.name in TEXT_FIELDS:
                hit = F.lit(True) if depth == 0 else _has_string(sub, f.dataType)
                out.append(F.when(hit, F.lit(where)))
            out += _text_fields(sub, f.dataType, where, depth + 1)
    elif isinstance(dtype, T.MapType):
        names = F.array(*[F.lit(n) for n in sorted(TEXT_FIELDS)])
        bad = F.filter(
            F.map_entries(c),
            lambda e: F.array_contains(names, e["key"]) & _has_string(e["value"], dtype.valueType),
        )
        out.append(F.when(F.size(bad) > 0, F.concat(F.lit(f"{path}."), bad[0]["key"])))
    elif isinstance(dtype, T.ArrayType) and isinstance(dtype.elementType, T.StructType):
        for f in dtype.elementType.fields:
            if f.name in TEXT_FIELDS:
                hit = F.exists(c, lambda x, f=f: _has_string(x[f.name], f.dataType))
                out.append(F.when(hit, F.lit(f"{path}[].{f.name}")))
    return out


def leak_scan(df: DataFrame, limit: int = MAX_STRING) -> DataFrame:
    """Add ``text_field`` (path or null) and ``long_string`` to every row of a typed frame."""
    row = F.struct(*[F.col(c) for c in df.columns])
    paths = _text_fields(row, df.schema, "", 0)
    found = F.coalesce(*paths, F.lit(None).cast("string")) if paths else F.lit(None).cast("string")
    return df.withColumns({"text_field": found, "long_string": _long_string(row, df.schema, limit)})


def _holds(x) -> bool:
    if isinstance(x, str):
        return True
    items = x.values() if isinstance(x, dict) else x if isinstance(x, list) else ()
    return any(_holds(v) for v in items)


def _scan(x, path: str, depth: int, limit: int) -> str | None:
    if isinstance(x, str):
        return f"{path}: long string" if len(x) > limit else None
    pairs = x.items() if isinstance(x, dict) else enumerate(x) if isinstance(x, list) else ()
    for k, v in pairs:
        where = f"{path}[{k}]" if isinstance(x, list) else f"{path}.{k}".lstrip(".")
        if isinstance(x, dict):
            if k in TEXT_FIELDS and (depth == 0 or _holds(v)):
                return f"{where}: text field"
            if len(k) > limit:
                return f"{where[:40]}: long key"
        if (hit := _scan(v, where, depth + 1, limit)) is not None:
            return hit
    return None


def leak_in_json(c: Column | str, limit: int = MAX_STRING) -> Column:
    """First problem of a free-form JSON document, or null."""

    @F.pandas_udf(T.StringType())
    def scan(texts: pd.Series) -> pd.Series:
        return texts.map(lambda s: None if s is None else _scan(json.loads(s), "", 0, limit))

    return scan(c)


def export_rows(df: DataFrame, path: str, limit: int = MAX_STRING) -> None:
    """Write rows, or refuse the whole write when any row could carry text."""
    scanned = leak_scan(df, limit)
    bad = scanned.agg(
        F.count_if(F.col("text_field").isNotNull()).alias("fields"), F.count_if("long_string").alias("long"),
        F.min("text_field").alias("example"),
    ).first()
    if bad["fields"] or bad["long"]:
        raise ValueError(f"{bad['fields']} rows with a text field ({bad['example']}), {bad['long']} with a long string")
    from credalis.sources.rows import write_rows

    write_rows(df, path)


def _strip(c: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.StructType):
        kept = [_strip(c[f.name], f.dataType).alias(f.name) for f in dtype.fields if not f.name.startswith("_")]
        return F.when(c.isNotNull(), F.struct(*kept)) if kept else F.lit(None)
    if isinstance(dtype, T.ArrayType):
        return F.transform(c, lambda x: _strip(x, dtype.elementType))
    if isinstance(dtype, T.MapType):
        kept = F.map_filter(c, lambda k, v: ~F.startswith(k, F.lit("_")))
        return F.transform_values(kept, lambda k, v: _strip(v, dtype.valueType))
    return c


def strip_private(df: DataFrame) -> DataFrame:
    """Drop fields and map keys starting with ``_`` at every depth."""
    return df.select(
        *[_strip(F.col(f.name), f.dataType).alias(f.name) for f in df.schema.fields if not f.name.startswith("_")]
    )
