"""Lookups in small tables and joins between result tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbside.functions.nulls import as_col, n_distinct
from kerbside.sources.dims import RACE, SEVERITY


def lookup(code: Column | str, pairs: Iterable[tuple]) -> Column:
    """Value paired with the code. A null code matches a pair whose code is null; a code in
    no pair gives null. For the inline dimensions: one constant map instead of a join."""
    code, pairs = as_col(code), list(pairs)
    known = F.create_map(*[F.lit(x) for k, v in pairs if k is not None for x in (k, v)])
    value = F.try_element_at(known, code)
    for k, v in pairs:
        if k is None:
            value = F.when(code.isNull(), F.lit(v)).otherwise(value)
    return value


def severity_name(code: Column | str, lang: str = "en") -> Column:
    return lookup(code, [(row[2], row[1 if lang == "es" else 0]) for row in SEVERITY])


def severity_rank(code: Column | str) -> Column:
    return lookup(code, [(row[2], row[4]) for row in SEVERITY])


def race_name(code: Column | str) -> Column:
    return lookup(code, [(code_, name) for name, code_ in RACE])


def with_severity(
    df: DataFrame, code_col: str, out: str, rank: str | None = None, lang: str = "en"
) -> DataFrame:
    """Name (and rank) of an injury code. A missing code is "unknown"; an unlisted one null."""
    df = df.withColumn(out, severity_name(code_col, lang))
    return df.withColumn(rank, severity_rank(code_col)) if rank else df


def with_race(df: DataFrame, code_col: str, out: str) -> DataFrame:
    return df.withColumn(out, race_name(code_col))


def translate(
    df: DataFrame, dim: DataFrame, col: str, out: str, key: str = "en", value: str = "es"
) -> DataFrame:
    """Value of the row of ``dim`` that matches ``col``; null where none does. ``key`` must
    be unique in ``dim``."""
    small = dim.select(F.col(key).alias("_key"), F.col(value).alias(out))
    return df.join(small, df[col].eqNullSafe(small["_key"]), "left").drop("_key")


def join_suffix(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left join; a column both sides have besides the key becomes ``c_x`` and ``c_y``."""
    clash = (set(left.columns) & set(right.columns)) - {key}
    left = left.withColumnsRenamed({c: f"{c}_x" for c in clash})
    right = right.withColumnsRenamed({c: f"{c}_y" for c in clash})
    return left.join(right, key, "left")


def keep_in(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Rows whose key occurs in ``other`` (a null key matches a null key)."""
    return _filter_join(df, other, key, "left_semi")


def not_in(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Rows whose key does not occur in ``other``; a null key stays unless listed."""
    return _filter_join(df, other, key, "left_anti")


def _filter_join(df: DataFrame, other: DataFrame, key: str, how: str) -> DataFrame:
    keys = other.select(F.col(key).alias("_key")).distinct()
    return df.join(keys, df[key].eqNullSafe(keys["_key"]), how)


def distinct_values(df: DataFrame, *cols: str) -> DataFrame:
    return df.select(*cols).distinct()


def distinct_count(df: DataFrame, col: str, out: str = "n") -> DataFrame:
    """One row: number of distinct values, null being one of them."""
    return df.agg(n_distinct(col).alias(out))
