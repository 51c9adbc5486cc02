"""Queries of readers and writers: the store, or the log lines, written in a format and read back, over whole tables."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ancestra.functions.identity import annotations_text
from ancestra.operators import nested
from ancestra.operators.graph import Store
from ancestra.queries.reference import store
from ancestra.session import run_dir
from ancestra.sources import readers, writers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _place(spark: SparkSession) -> str:
    return f"{run_dir(spark)}/f-{uuid.uuid4().hex}"


def _content(s: Store) -> DataFrame:
    """(kind, id, child, parent, text) of a store; edges by ends, whatever their ids."""
    text = annotations_text(F.col("annotations")).alias("text")
    none = F.lit(None).cast("string")
    return s.vertices.select(F.lit("vertex").alias("kind"), "id", none.alias("child"), none.alias("parent"), text).unionByName(s.edges.select(F.lit("edge").alias("kind"), none.alias("id"), "child", "parent", text).distinct())


def _round_trip(write: Callable, read: Callable) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, d: str) -> DataFrame:
        s, path = store(spark, d), _place(spark)
        write(s.vertices, s.edges, path)
        return _content(read(spark, path))

    return run


QUERIES |= {
    "s_parquet": _round_trip(writers.write_parquet, readers.read_parquet),
    "s_messages": _round_trip(writers.write_elements_json, readers.read_elements_json),
    "s_json": _round_trip(writers.write_json, lambda spark, path: readers.read_json(spark, path, lines=True)),
    "s_dot": _round_trip(writers.write_dot, readers.read_dot),
    "s_text": _round_trip(writers.write_text, readers.read_text),
}


@query
def s_jdbc(spark: SparkSession, d: str) -> DataFrame:
    """Through a relational database: that of ``spark.ancestra.jdbc``, which all executors must reach, or else one in a folder of the driver's, by what comes with Spark.

    On a local master the tasks write and read that, elsewhere the driver does.
    """
    s, url = store(spark, d), spark.conf.get("spark.ancestra.jdbc", None)
    if url:
        writers.write_jdbc(s.vertices, s.edges, url)
        return _content(readers.read_jdbc(spark, url))
    master = spark.sparkContext.master
    far = not master.startswith("local") or master.startswith("local-cluster")
    own = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    folder = tempfile.mkdtemp(prefix="ancestra-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    url = f"jdbc:derby:{folder}/db"
    writers.write_jdbc(s.vertices, s.edges, f"{url};create=true", own, by_driver=far)
    got = readers.read_jdbc(spark, url, own, by_driver=far)
    if far:  # nothing is read from it any more
        with contextlib.suppress(Py4JJavaError):  # the database says by an error that it is closed
            spark._jvm.org.apache.derby.iapi.jdbc.AutoloadedDriver().connect(f"{url};shutdown=true", spark._jvm.java.util.Properties())
        shutil.rmtree(folder, ignore_errors=True)
    return _content(got)


def _written(write: Callable, only: str = "") -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, d: str) -> DataFrame:
        s, path = store(spark, d), _place(spark)
        write(s.vertices, s.edges, path)
        return spark.read.text(path).where(F.col("value").rlike(only)).withColumnRenamed("value", "line")

    return run


QUERIES |= {
    "s_datalog": _written(writers.write_datalog),
    "s_turtle": _written(writers.write_turtle, " prov:\\w+ data:"),
    "s_provn": _written(writers.write_provn, "^\\w+\\(data:\\w+, data:|^document|^endDocument"),
}


@query
def s_dsl(spark: SparkSession, d: str) -> DataFrame:
    """Vertices as lines of the pipe format, with blanks and colons kept by backslashes, read back."""
    s, path = store(spark, d), _place(spark)
    plain = lambda c: F.regexp_replace(c, "([: ])", r"\\$1")
    pairs = F.transform(F.map_entries(F.map_filter("annotations", lambda k, v: ~F.lower(k).isin("type", "id", "from", "to"))), lambda x: F.concat(plain(x["key"]), F.lit(":"), plain(F.coalesce(x["value"], F.lit("")))))
    typed = s.vertices.where(F.col("annotations")["type"].isin(readers.VERTEX_TYPES))
    lines = typed.select(F.array_join(F.concat(F.array(F.concat(F.lit("type:"), F.col("annotations")["type"]), F.concat(F.lit("id:"), "id")), pairs), " ").alias("value"))
    lines.write.text(path)
    return _content(readers.read_dsl(spark, path))


@query
def s_audit(spark: SparkSession, d: str) -> DataFrame:
    """The audit records among the log lines, read as records."""
    path = _place(spark)
    spark.read.parquet(f"{d}/log_line.parquet").select(F.regexp_replace(F.coalesce("msg", F.lit("")), "[\r\n]", "").alias("value")).write.text(path)
    return readers.read_audit(spark, path).select("time", "event_id", "record", annotations_text(F.col("fields")).alias("text"))


@query
def s_cdm(spark: SparkSession, d: str) -> DataFrame:
    """Records as vertices and edges."""
    raw = spark.read.parquet(f"{d}/cdm_record.parquet")
    bodies = nested.normalise(raw, "record_id", "datum", []).join(raw.select("record_id", "rectype"), "record_id")
    return _content(readers.cdm_store(bodies))
