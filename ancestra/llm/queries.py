"""Queries and SQL of the training-text problems over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ancestra.llm import leaks, level, mix

#: Where the public tokenizers' files are, unless the session says otherwise in ``spark.ancestra.tokenizers``.
TOKENIZERS = "/opt/tokenizers"


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _spans(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaks(_table(spark, d, "documents"), "doc_id", "text", _table(spark, d, "eval_item"), "item_id", ["prompt", "answer"])


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaked_items(_spans(spark, d)).select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"))


def p8_removals(spark: SparkSession, d: str) -> DataFrame:
    return leaks.removal_spans(_spans(spark, d)).select(F.col("doc").alias("doc_id"), "from_char", "to_char")


def _mix(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    path = spark.conf.get("spark.ancestra.tokenizers", TOKENIZERS)
    return mix.mix(_table(spark, d, "documents"), "doc_id", "source", "text", _table(spark, d, "mix_target"), f"{path}/byte_bpe_50k.tiktoken")


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[0].withColumnRenamed("doc", "doc_id")


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[1]


def p9_met(spark: SparkSession, d: str) -> DataFrame:
    """For each target source whether its actual share is within half a percent of its target among the sources that have documents, and no document is used more often than may be."""
    report = p9_shares(spark, d)
    there = report.agg(F.sum(F.when(F.col("available_tokens") > 0, F.col("target_share"))).alias("whole"))
    wanted = F.when(F.col("available_tokens") > 0, F.col("target_share") / F.col("whole")).otherwise(0.0)
    near = F.abs(F.col("actual_share") - wanted) <= 0.005
    return report.join(F.broadcast(there)).select("source", near.alias("share_met"), (F.col("most_copies") <= F.col("max_repeats")).alias("repeats_met"))


def p10_levels(spark: SparkSession, d: str) -> DataFrame:
    docs = _table(spark, d, "documents")
    quotes = level.quotations(_table(spark, d, "eval_item"), ["prompt", "answer"])
    model = level.fit(level.training_sample(docs, "doc_id", "text", _table(spark, d, "level_label"), "band"), quotes)
    language = level.fit_language(level.language_sample(docs, "doc_id", "text", "lang"), quotes)
    return level.reading_levels(docs, "doc_id", "text", model, language, quotes).withColumnRenamed("doc", "doc_id")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return p10_levels(spark, d).where("p_hard >= 0.5").select("doc_id")


QUERIES = {f.__name__: f for f in (p8_found, p8_removals, p9_mix, p9_shares, p9_met, p10_found, p10_levels)}

P8 = r"""with g as (select item_id, regexp_extract_all(lower(x), '[\p{L}\p{N}]+') as ws from (select item_id, unnest([prompt, answer]) as x from eval_item)),
q as (select distinct item_id, array_to_string(ws[i + 1:i + 12], ' ') as gram from (select item_id, ws, unnest(range(len(ws) - 11)) as i from g where len(ws) > 11)),
d as (select doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as ws from documents),
p as (select doc_id, array_to_string(ws[i + 1:i + 12], ' ') as gram from (select doc_id, ws, unnest(range(len(ws) - 11)) as i from d where len(ws) > 11))
select distinct doc_id, item_id from p join q using (gram)"""

P9_MET = "select distinct lower(trim(source, ' ' || chr(9) || chr(10) || chr(13))) as source, true as share_met, true as repeats_met from mix_target where source is not null"

SQL = {"p8_found": P8, "p9_met": P9_MET}
