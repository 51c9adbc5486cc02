"""Running values per key in the order of a sequence number, without one task per key.

A window over a hot key is one task's work. Here windows run over (key, block of
the sequence), and only one row a block is ordered per key to carry
values from block to block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Sequence numbers in one block.
BLOCK = 1 << 16


def _keyed(df: DataFrame, keys: list[str], seq: str, block: int) -> DataFrame:
    """``df`` with its keys as one text, in which null equals null, and its block: what is grouped, windowed and joined by, so rows are shuffled by it once."""
    part = lambda k: F.coalesce(F.concat(F.length(F.col(k).cast("string")), F.lit(":"), F.col(k).cast("string")), F.lit("-"))
    return df.withColumn("__run_key", F.concat(*map(part, keys))).withColumn("__run_block", F.floor(F.col(seq) / block))


def _carried(d: DataFrame, tail: dict[str, Column], over: dict[str, Column]) -> DataFrame:
    """(__k, __b, ...): for each key and block what earlier blocks leave behind; one row a block is ordered."""
    tails = d.groupBy("__run_key", "__run_block").agg(*[c.alias(n) for n, c in tail.items()])
    return tails.select(F.col("__run_key").alias("__run_k"), F.col("__run_block").alias("__run_b"), *[c.alias(n) for n, c in over.items()])


def last_before(df: DataFrame, keys: list[str], seq: str, values: dict[str, Column], block: int = BLOCK) -> DataFrame:
    """``df`` with a column for each of ``values``: its last value that isn't null of an earlier row of the key, null if there is none.

    ``seq`` must be unique within a key for a defined order. Null keys are one key.
    """
    d = _keyed(df, keys, seq, block)
    own = {f"__run_v{i}": v for i, v in enumerate(values.values())}
    d = d.withColumns(own)
    over = Window.partitionBy("__run_key").orderBy("__run_block").rowsBetween(Window.unboundedPreceding, -1)
    tail = {f"__run_t{i}": F.max_by(v, F.when(F.col(v).isNotNull(), F.col(seq))) for i, v in enumerate(own)}
    carry = _carried(d, tail, {f"__run_c{i}": F.last(f"__run_t{i}", ignorenulls=True).over(over) for i in range(len(own))})
    here = Window.partitionBy("__run_key", "__run_block").orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumns({f"__run_h{i}": F.last(v, ignorenulls=True).over(here) for i, v in enumerate(own)})
    got = d.join(carry, (F.col("__run_key") == F.col("__run_k")) & (F.col("__run_block") == F.col("__run_b")))
    return got.select(*[F.col(f"`{c}`") for c in df.columns], *[F.coalesce(f"__run_h{i}", f"__run_c{i}").alias(out) for i, out in enumerate(values)])


def count_before(df: DataFrame, keys: list[str], seq: str, flag: Column, out: str, block: int = BLOCK) -> DataFrame:
    """``df`` with ``out``: how many earlier rows of the key have ``flag``."""
    d = _keyed(df, keys, seq, block).withColumn("__run_flag", F.coalesce(flag.cast("bigint"), F.lit(0)))
    over = Window.partitionBy("__run_key").orderBy("__run_block").rowsBetween(Window.unboundedPreceding, -1)
    carry = _carried(d, {"__run_t": F.sum("__run_flag")}, {"__run_c": F.coalesce(F.sum("__run_t").over(over), F.lit(0))})
    here = Window.partitionBy("__run_key", "__run_block").orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("__run_h", F.coalesce(F.sum("__run_flag").over(here), F.lit(0)))
    got = d.join(carry, (F.col("__run_key") == F.col("__run_k")) & (F.col("__run_block") == F.col("__run_b")))
    return got.select(*[F.col(f"`{c}`") for c in df.columns], (F.col("__run_h") + F.col("__run_c")).alias(out))
