"""Messages delivered more than once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _rank(delivered: Column, seq: Column) -> Column:
    """(delivery time, seq) as one decimal.

    It orders like the struct of the two, and unlike a struct it is a
    fixed-width aggregation buffer, so Spark keeps the partial aggregation in
    hash maps instead of sorting every partition. A missing time comes last.
    """
    micros = F.coalesce(F.unix_micros(delivered), F.lit(2**61)).cast("decimal(20,0)")
    return (micros * F.lit(str(2**64)).cast("decimal(20,0)") + seq.cast("decimal(20,0)")).cast("decimal(38,0)")


def first_copies(df: DataFrame, ident: Column, seq: str, delivered: str) -> DataFrame:
    """For each identifier the ``seq`` of the copy to keep: the earliest delivered, then the smallest ``seq``.

    One hash aggregation with map-side partial results: a key that holds a
    third of all rows costs one row per map task. Rows without an identifier
    are no copies of anything and don't appear. An empty table gives no rows.
    """
    rows = df.select(ident.alias("ident"), F.col(seq).alias("seq"), _rank(F.col(delivered), F.col(seq)).alias("r"))
    return rows.where(F.col("ident").isNotNull()).groupBy("ident").agg(F.min_by("seq", "r").alias("seq"), F.count("*").alias("copies"))


def keep_first(df: DataFrame, ident: Column, seq: str, delivered: str) -> DataFrame:
    """``df`` with exactly one copy of each identifier; rows without one all stay. All columns pass through."""
    keep = first_copies(df, ident, seq, delivered).select(F.col("seq").alias("__keep"))
    named = df.where(ident.isNotNull()).join(keep, F.col(seq) == F.col("__keep"), "left_semi")
    return named.unionByName(df.where(ident.isNull()))


def surplus(df: DataFrame, ident: Column, seq: str, delivered: str) -> DataFrame:
    """The rows that ``keep_first`` drops. The join back is on the unique ``seq``, so no key is hot."""
    keep = first_copies(df, ident, seq, delivered).select(F.col("seq").alias("__keep"))
    return df.where(ident.isNotNull()).join(keep, F.col(seq) == F.col("__keep"), "left_anti")
