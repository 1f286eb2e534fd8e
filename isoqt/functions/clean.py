"""Null, NaN, number and identifier handling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isoqt.fixed_values import DATASETS_DEFAULTING_TO_MALE
from isoqt.functions.formulas import col


def finite(c) -> Column:
    """The value, or null for NaN and infinities (Spark orders NaN above every number)."""
    value = col(c).cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def number(c, decimal: str = ".") -> Column:
    """Text to double; text that is no number gives null."""
    text = F.trim(col(c).cast("string"))
    if decimal != ".":
        text = F.replace(text, F.lit(decimal), F.lit("."))
    return finite(text.try_cast("double"))


def coerce_numeric(df: DataFrame, cols) -> DataFrame:
    return df.withColumns({c: number(c) for c in cols if c in df.columns})


def clip(c, lo: float = 200.0, hi: float = 700.0) -> Column:
    return F.when(col(c).isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), col(c))))


def default_sex(df: DataFrame, datasets=DATASETS_DEFAULTING_TO_MALE) -> DataFrame:
    """Datasets that note only female sex: a known age without sex means male (0)."""
    missing = F.lower("dataset").isin(*datasets) & F.col("age").isNotNull() & F.col("sex").isNull()
    return df.withColumn("sex", F.when(missing, F.lit(0)).otherwise(F.col("sex")))


# ---- identifiers --------------------------------------------------------------------------
def record_id(path) -> Column:
    """Last path part without its extension."""
    return F.regexp_replace(F.element_at(F.split(col(path), "/"), -1), r"\.[^.]*$", "")


def study_id(path) -> Column:
    """Last path part as a number."""
    return F.element_at(F.split(col(path), "/"), -1).try_cast("bigint")


def numeric_id(name) -> Column:
    """Number before the first underscore: '00001_hr' gives 1."""
    return F.element_at(F.split(col(name), "_"), 1).try_cast("bigint")
