"""Queries of the general record problems over the driver's tables."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ancestra.functions.identity import canon_hash
from ancestra.operators import dedup, hierarchy, logparse, nested, orphans, skew, wide
from ancestra.session import cut

#: Names of the process links, of the arrays of a record and of whole-number attributes.
LINK_TYPES = ("wastriggeredby", "wasinformedby")
LINK_OPERATIONS = ("fork", "clone", "vfork")
ARRAYS = "hostIdentifiers interfaces ipAddresses groupIds importedLibraries hashes names parameters components".split()
NUMBERS = "pid ppid uid version size".split()


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def process_links(spark: SparkSession, d: str) -> DataFrame:
    kind, op = F.lower(F.col("annotations")["type"]), F.lower(F.col("annotations")["operation"])
    e = table(spark, d, "edges").where(kind.isin(*LINK_TYPES) & op.isin(*LINK_OPERATIONS))
    links = e.select(canon_hash("childvertexhash").alias("child"), canon_hash("parentvertexhash").alias("parent"))
    return links.where("child is not null and parent is not null").distinct()


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    at = hierarchy.resolve(process_links(spark, d))
    return at.select(F.col("v").alias("vertex_hash"), F.col("root").alias("root_hash"), "depth", "on_cycle")


def p1_paths(spark: SparkSession, d: str) -> DataFrame:
    at = hierarchy.paths(process_links(spark, d))
    return at.select(F.col("v").alias("vertex_hash"), F.col("root").alias("root_hash"), "depth", "on_cycle", "path")


def p1_descendants(spark: SparkSession, d: str) -> DataFrame:
    up = hierarchy.ancestors(process_links(spark, d))
    return up.select(F.col("ancestor").alias("vertex_hash"), F.col("v").alias("descendant_hash"), "distance")


def _references(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "edges").select(canon_hash("hash").alias("ident"), canon_hash("childvertexhash").alias("c"), canon_hash("parentvertexhash").alias("p"), "arrived")
    return orphans.references(e, "ident", {"child": "c", "parent": "p"}, "arrived")


def _lifetimes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "vertices").select(canon_hash("hash").alias("ref"), F.col("arrived").alias("since"), F.col("retired").alias("until"))


def _lost(spark: SparkSession, d: str, refs: DataFrame) -> DataFrame:
    return orphans.missing(refs, _lifetimes(spark, d), "since", "until")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    lost = _lost(spark, d, _references(spark, d))
    return lost.select(F.col("ident").alias("edge_hash"), "endpoint").distinct()  # an edge whose rows name different vertices


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    refs = _references(spark, d)
    lost = _lost(spark, d, refs)
    when = table(spark, d, "edges").select(canon_hash("hash").alias("ident"), F.date_format("event_time", "yyyy-MM").alias("period")).where("ident is not null")
    return orphans.report(refs, lost, when, "period")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return nested.nested_items(table(spark, d, "cdm_record"), "record_id", "datum", ARRAYS, values=False).select("record_id", "item_path", "parent_path")


def _records(name: str, field: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return nested.flat_table(table(spark, d, "cdm_record"), "record_id", "datum", ARRAYS, field)

    run.__name__ = name
    return run


#: The flat tables of the records: p3_records and, by record_id, item_path and parent_path related to it, one for each array.
RECORD_TABLES = [_records("p3_records", "")] + [_records("p3_" + re.sub("([A-Z])", r"_\1", a).lower(), a) for a in ARRAYS]


def _annotations(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "vertex_anno").withColumn("owner", F.lit("vertex")).unionByName(table(spark, d, "edge_anno").withColumn("owner", F.lit("edge")))


def _attributes(spark: SparkSession, d: str, fields: list[str] | None = None) -> DataFrame:
    per = wide.reduced(_annotations(spark, d), ["owner", "id"], "field", "value")
    return per.where(F.col("field").isin(fields)) if fields else per


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    columns = wide.pivot_wide(_attributes(spark, d, NUMBERS), ["owner", "id"], [(f, "bigint") for f in NUMBERS])
    long = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("num")) for f in NUMBERS])).alias("x")
    return columns.select("owner", "id", long).select("owner", "id", "x.field", "x.num").where("num is not null")


def p4_wide(spark: SparkSession, d: str) -> DataFrame:
    per = cut(_attributes(spark, d))
    return wide.pivot_wide(per, ["owner", "id"], wide.attribute_types(per))


def p4_rest(spark: SparkSession, d: str) -> DataFrame:
    """The values that p4_wide has no place for."""
    per = cut(_attributes(spark, d))
    return wide.rest(_annotations(spark, d), per, ["owner", "id"], "field", "value", wide.attribute_types(per))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return dedup.surplus(table(spark, d, "graph_element"), canon_hash(F.col("element")["hash"]), "seq", "delivered").select("seq")


def p5_kept(spark: SparkSession, d: str) -> DataFrame:
    kept = dedup.keep_first(table(spark, d, "graph_element"), canon_hash(F.col("element")["hash"]), "seq", "delivered")
    return kept.select("seq", "kind", canon_hash(F.col("element")["hash"]).alias("hash"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    lines = logparse.parse_lines(table(spark, d, "log_line"), "msg", "collected", ["log_file", "line_no", "line_id"]).drop("message")
    at = logparse.entries(lines, "log_file", "line_no", "line_id")
    return at.select("line_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts_utc"), "severity", "component", "n_lines")


def p6_entries(spark: SparkSession, d: str) -> DataFrame:
    lines = logparse.parse_lines(table(spark, d, "log_line"), "msg", "collected", ["log_file", "line_no", "line_id"])
    return logparse.entries(lines, "log_file", "line_no", "line_id", text=True)


def p6_unparsed(spark: SparkSession, d: str) -> DataFrame:
    """The spans of lines that no layout explains."""
    return logparse.unparsed(logparse.parse_lines(table(spark, d, "log_line"), "msg", "collected", ["line_id"]), "line_id")


def _endpoints(spark: SparkSession, d: str) -> DataFrame:
    """(endpoint, vertex_hash, edge): an edge and a vertex it names, for every row and endpoint."""
    e = table(spark, d, "edges").select(canon_hash("hash").alias("edge"), canon_hash("childvertexhash").alias("c"), canon_hash("parentvertexhash").alias("p")).where("edge is not null")
    ends = F.explode(F.array(*[F.struct(F.lit(n).alias("endpoint"), F.col(c).alias("vertex_hash")) for n, c in (("child", "c"), ("parent", "p"))])).alias("x")
    return e.select("edge", ends).select("x.endpoint", "x.vertex_hash", "edge").where("vertex_hash is not null")


def _edge_count(spark: SparkSession, d: str) -> int:
    return table(spark, d, "edges").select(canon_hash("hash").alias("edge")).where("edge is not null").distinct().count()


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    least = -(-_edge_count(spark, d) // 100)
    return skew.balanced_counts(_endpoints(spark, d), ["endpoint", "vertex_hash"], "edge", "n_edges", least=least)


def p7_counts(spark: SparkSession, d: str) -> DataFrame:
    """The distinct edges of every vertex at either endpoint."""
    return skew.balanced_counts(_endpoints(spark, d), ["endpoint", "vertex_hash"], "edge", "n_edges")


def p7_profile(spark: SparkSession, d: str) -> DataFrame:
    """Each vertex of the store with its type, the edges that name it at either endpoint and the distinct vertices at their other ends, by a join that splits heavy vertices and copies their types to the shards."""
    e = table(spark, d, "edges").select(canon_hash("hash").alias("edge"), canon_hash("childvertexhash").alias("c"), canon_hash("parentvertexhash").alias("p")).where("edge is not null").distinct()
    ends = F.explode(F.array(*[F.struct(F.lit(n).alias("endpoint"), F.col(a).alias("vertex_hash"), F.col(b).alias("other")) for n, a, b in (("child", "c", "p"), ("parent", "p", "c"))])).alias("x")
    ends = e.select("edge", ends).select("edge", "x.*").where("vertex_hash is not null")
    v = table(spark, d, "vertices").select(canon_hash("hash").alias("vertex_hash"), F.lower(F.col("annotations")["type"]).alias("t")).where("vertex_hash is not null").groupBy("vertex_hash").agg(F.min("t").alias("vertex_type"))
    both = skew.balanced_join(ends, v, "vertex_hash", plan=skew.plan_fragments(_endpoints(spark, d), "vertex_hash"))
    pairs = both.groupBy("endpoint", "vertex_hash", "vertex_type", "other").agg(F.count("*").alias("n"))
    return pairs.groupBy("endpoint", "vertex_hash", "vertex_type").agg(F.sum("n").alias("n_edges"), F.count("other").alias("n_others"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (p1_found, p1_paths, p1_descendants, p2_found, p2_report, p3_found, *RECORD_TABLES, p4_found, p4_wide, p4_rest, p5_found, p5_kept, p6_found, p6_entries, p6_unparsed, p7_found, p7_counts, p7_profile)
}
