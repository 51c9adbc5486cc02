"""Readers: text and JSON formats into ``Store`` tables.

Every reader is a plan over ``spark.read``; lines that are no element of the
format are left out. Elements known by a name of their own get the id of that name.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ancestra.functions.identity import edge_id, reference_id, vertex_id
from ancestra.operators.graph import Store
from ancestra.session import Pile
from ancestra.sources.writers import PIECE, jdbc_options

MAP = "map<string,string>"
#: Line formats.
DOT_NODE = r'(?s)"(.*)" \[label="(.*)" shape="(\w*)" fillcolor="(\w*)"'
DOT_EDGE = r'(?s)"(.*)" -> "(.*)" \[label="(.*)" color="(\w*)"'
DOT_DEPENDENCY = r'(?s)"(.*)" -> "(.*)" \[label="WasDependentOn"'
TEXT_VERTEX = r"^VERTEX \((.*?)\): \{(.*)\}$"
TEXT_EDGE = r"^EDGE \((.*?) -> (.*?)\): \{(.*)\}$"
VERTEX_TYPES = "Vertex Entity Agent Activity Process Artifact Principal Object Subject Event".split()
EDGE_TYPES = "Edge SimpleEdge Used WasControlledBy WasDerivedFrom WasGeneratedBy WasTriggeredBy ActedOnBehalfOf WasAssociatedWith WasAttributedTo WasInformedBy".split()


def _pairs(parts: Column, sep: str = ":") -> Column:
    """``k:v`` texts as a map; the first separator splits, later keys win, texts without one are left out."""
    good = F.filter(parts, lambda x: F.instr(x, sep) > 1)
    entries = F.transform(good, lambda x: F.struct(F.substring_index(x, sep, 1).alias("key"), F.substring(x, F.instr(x, sep) + 1, F.length(x)).alias("value")))
    return _map_of(entries)


def _map_of(entries: Column) -> Column:
    """A map of entries whose later values win, whatever the session's policy for repeated keys."""
    keys = F.transform(entries, lambda e: e["key"])
    kept = F.filter(entries, lambda e, i: ~F.array_contains(F.slice(keys, i + 2, F.size(keys)), e["key"]))
    return F.coalesce(F.map_from_entries(kept), F.create_map().cast(MAP))


def _lines(spark: SparkSession, path: str, whole_stream: bool = False) -> DataFrame:
    return (spark.readStream if whole_stream else spark.read).text(path)


def parse_dsl(lines: DataFrame) -> DataFrame:
    """Element rows (kind, id, child, parent, annotations) of lines ``key:value key:value``, also for streams; a backslash keeps a blank or colon in its token."""
    plain = lambda x: F.regexp_replace(x, r"\\(?=[: ])", "")
    tokens = F.split("value", r"(?<!\\) ")
    pairs = F.transform(F.filter(tokens, lambda t: t.rlike(r"(?<!\\):")), lambda t: F.struct(plain(F.element_at(F.split(t, r"(?<!\\):"), 1)).alias("key"), plain(F.element_at(F.split(t, r"(?<!\\):", 2), 2)).alias("value")))
    rows = lines.select(_map_of(pairs).alias("m"))
    reserved = F.map_filter("m", lambda k, v: ~F.lower(k).isin("id", "type", "from", "to"))
    first = lambda n: F.try_element_at(F.map_values(_only("m", n)), F.lit(1)).alias(n)
    rows = rows.where(F.size("m") > 0).select(*map(first, ("id", "type", "from", "to")), reserved.alias("a"))
    a = F.map_concat(F.map_filter("a", lambda k, v: k != "type"), F.create_map(F.lit("type"), F.col("type")))
    rows = rows.where(F.col("type").isin(VERTEX_TYPES + EDGE_TYPES)).withColumn("annotations", a)
    vertex = F.col("type").isin(VERTEX_TYPES)
    child, parent = reference_id(F.col("from")), reference_id(F.col("to"))
    return rows.select(
        F.when(vertex, "vertex").otherwise("edge").alias("kind"),
        F.when(vertex, F.when(F.col("id").isNull(), vertex_id(F.col("annotations"))).otherwise(reference_id(F.col("id")))).otherwise(edge_id(child, parent, F.col("annotations"))).alias("id"),
        F.when(~vertex, child).alias("child"),
        F.when(~vertex, parent).alias("parent"),
        "annotations",
        (vertex & F.col("id").isNotNull()).alias("ref"),
    )


def _only(m: str, name: str) -> Column:
    return F.map_filter(m, lambda k, v: F.lower(k) == name)


def elements_to_store(rows: DataFrame) -> Store:
    """Element rows as a store."""
    v = rows.where("kind = 'vertex'").select("id", "annotations", "ref")
    e = rows.where("kind = 'edge'").select("id", "child", "parent", "annotations", F.lit(False).alias("ref"))
    return Store.of(v, e)


def read_dsl(spark: SparkSession, path: str) -> Store:
    return elements_to_store(parse_dsl(_lines(spark, path)))


def read_dot(spark: SparkSession, path: str, reference: bool = True) -> Store:
    """Nodes and edges of DOT lines. With ``reference`` a node's key is its name or id; else a node is hashed by content and edges name nodes by that hash."""
    x = _lines(spark, path)
    label = lambda c: _pairs(F.split(F.regexp_replace(c, r'\\"', '"'), r"\\n"))
    edge = F.col("value").rlike(DOT_EDGE)
    nodes = x.where(~edge & F.col("value").rlike(DOT_NODE)).select(F.regexp_extract("value", DOT_NODE, 1).alias("k"), label(F.regexp_extract("value", DOT_NODE, 2)).alias("annotations"))
    nodes = nodes.select((reference_id(F.col("k")) if reference else vertex_id(F.col("annotations"))).alias("id"), "annotations", F.lit(reference).alias("ref"))
    edges = x.where(edge).select(F.regexp_extract("value", DOT_EDGE, 1).alias("c"), F.regexp_extract("value", DOT_EDGE, 2).alias("p"), label(F.regexp_extract("value", DOT_EDGE, 3)).alias("annotations"))
    edges = edges.select((reference_id(F.col("c")) if reference else F.col("c")).alias("child"), (reference_id(F.col("p")) if reference else F.col("p")).alias("parent"), "annotations")
    edges = edges.select(edge_id(F.col("child"), F.col("parent"), F.col("annotations")).alias("id"), "child", "parent", "annotations", F.lit(False).alias("ref"))
    return Store.of(nodes, edges)


def dependency_map(spark: SparkSession, path: str) -> Iterator[tuple[str, str]]:
    """The distinct ``WasDependentOn`` pairs of a DOT file, in order, a part at a time: each costs a path search."""
    x = _lines(spark, path).where(F.col("value").rlike(DOT_DEPENDENCY))
    rows = x.select(F.regexp_extract("value", DOT_DEPENDENCY, 1).alias("a"), F.regexp_extract("value", DOT_DEPENDENCY, 2).alias("b")).distinct().orderBy("a", "b")
    return ((r.a, r.b) for r in rows.toLocalIterator())


JSON_SCHEMA = f"id string, type string, `from` string, `to` string, annotations {MAP}"


def read_json(spark: SparkSession, path: str, lines: bool = False) -> Store:
    """Objects ``{id, type, annotations}`` and ``{from, to, type, annotations}``: an array a file, which one task reads, or with ``lines`` one a line, which many can. A vertex needs a non-empty id and type; an edge both ends and type."""
    x = spark.read.schema(JSON_SCHEMA).json(path, multiLine=not lines)
    a = F.map_concat(F.map_filter(F.coalesce("annotations", F.create_map().cast(MAP)), lambda k, v: (k != "type") & v.isNotNull()), F.create_map(F.lit("type"), F.col("type")))
    typed = x.where("type is not null and type <> ''").withColumn("a", a)
    v = typed.where("id is not null and id <> '' and annotations is not null and `from` is null").select(reference_id(F.col("id")).alias("id"), F.col("a").alias("annotations"), F.lit(True).alias("ref"))
    e = typed.where("`from` is not null and `to` is not null").select(reference_id(F.col("from")).alias("child"), reference_id(F.col("to")).alias("parent"), F.col("a").alias("annotations"))
    return Store.of(v, e.select(edge_id(F.col("child"), F.col("parent"), F.col("annotations")).alias("id"), "child", "parent", "annotations"))


def read_text(spark: SparkSession, path: str) -> Store:
    """Lines ``VERTEX (h): {k:v,}`` and ``EDGE (c -> p): {k:v,}``; values hold no commas."""
    x = _lines(spark, path)
    body = lambda c: _pairs(F.split(c, ","))
    v = x.where(F.col("value").rlike(TEXT_VERTEX)).select(F.regexp_extract("value", TEXT_VERTEX, 1).alias("id"), body(F.regexp_extract("value", TEXT_VERTEX, 2)).alias("annotations"))
    e = x.where(F.col("value").rlike(TEXT_EDGE)).select(F.regexp_extract("value", TEXT_EDGE, 1).alias("child"), F.regexp_extract("value", TEXT_EDGE, 2).alias("parent"), body(F.regexp_extract("value", TEXT_EDGE, 3)).alias("annotations"))
    return Store.of(v, e.select(edge_id(F.col("child"), F.col("parent"), F.col("annotations")).alias("id"), "child", "parent", "annotations"))


#: PROV JSON sections and the fields that hold an edge's ends (effect, cause).
PROV_VERTICES = {"entity": "Entity", "activity": "Activity", "agent": "Agent"}
PROV_EDGES = {
    "used": ("Used", "prov:activity", "prov:entity"),
    "wasGeneratedBy": ("WasGeneratedBy", "prov:entity", "prov:activity"),
    "wasDerivedFrom": ("WasDerivedFrom", "prov:generatedEntity", "prov:usedEntity"),
    "wasInformedBy": ("WasInformedBy", "prov:informed", "prov:informant"),
    "wasAssociatedWith": ("WasAssociatedWith", "prov:activity", "prov:agent"),
    "wasAttributedTo": ("WasAttributedTo", "prov:entity", "prov:agent"),
    "actedOnBehalfOf": ("ActedOnBehalfOf", "prov:delegate", "prov:responsible"),
}


def read_prov_json(spark: SparkSession, path: str) -> Store:
    """W3C PROV JSON documents, one a line: sections of identifiers with attribute objects."""
    section = "map<string,map<string,string>>"
    names = [*PROV_VERTICES, *PROV_EDGES]
    x = spark.read.schema(", ".join(f"`{n}` {section}" for n in names)).json(path)
    vs, es = [], []
    for n, kind in PROV_VERTICES.items():
        one = x.select(F.explode(n).alias("k", "a"))
        vs.append(one.select(reference_id(F.col("k")).alias("id"), F.map_concat(F.map_filter("a", lambda k, v: (k != "type") & v.isNotNull()), F.create_map(F.lit("type"), F.lit(kind))).alias("annotations"), F.lit(True).alias("ref")))
    for n, (kind, effect, cause) in PROV_EDGES.items():
        one = x.select(F.explode(n).alias("k", "a")).where(F.col("a")[effect].isNotNull() & F.col("a")[cause].isNotNull())
        es.append(one.select(reference_id(F.col("a")[effect]).alias("child"), reference_id(F.col("a")[cause]).alias("parent"), F.map_concat(_drop_keys("a", effect, cause, "type"), F.create_map(F.lit("type"), F.lit(kind))).alias("annotations")))
    v, e = vs[0], es[0]
    for more in vs[1:]:
        v = v.unionByName(more)
    for more in es[1:]:
        e = e.unionByName(more)
    return Store.of(v, e.select(edge_id(F.col("child"), F.col("parent"), F.col("annotations")).alias("id"), "child", "parent", "annotations"))


def _drop_keys(m: str, *keys: str) -> Column:
    return F.map_filter(m, lambda k, v: ~k.isin(*keys) & v.isNotNull())


def read_events_csv(spark: SparkSession, path: str) -> Store:
    """Process monitor CSV: each row is an event of a process on a path. Reads are Used, all others WasGeneratedBy."""
    x = spark.read.csv(path, header=True)
    name, pid, op, at = (F.col(f"`{c}`") for c in ("Process Name", "PID", "Operation", "Path"))
    rows = x.where(pid.isNotNull() & op.isNotNull() & at.isNotNull())
    proc = F.create_map(F.lit("type"), F.lit("Process"), F.lit("name"), F.coalesce(name, F.lit("")), F.lit("pid"), pid)
    art = F.create_map(F.lit("type"), F.lit("Artifact"), F.lit("path"), at)
    reads = F.lower(op).rlike("read|query|open|load")
    a = F.create_map(F.lit("type"), F.when(reads, "Used").otherwise("WasGeneratedBy"), F.lit("operation"), op, F.lit("time"), F.coalesce(F.col("`Time of Day`"), F.lit("")) if "Time of Day" in x.columns else F.lit(""))
    rows = rows.select(proc.alias("p"), art.alias("f"), a.alias("annotations"), reads.alias("reads"))
    v = rows.select(F.explode(F.array("p", "f")).alias("annotations")).select(vertex_id(F.col("annotations")).alias("id"), "annotations")
    p, f = vertex_id(F.col("p")), vertex_id(F.col("f"))
    e = rows.select(F.when(F.col("reads"), p).otherwise(f).alias("child"), F.when(F.col("reads"), f).otherwise(p).alias("parent"), "annotations")
    return Store.of(v, e.select(edge_id(F.col("child"), F.col("parent"), F.col("annotations")).alias("id"), "child", "parent", "annotations"))


#: A traced system call, and which calls read, write or start processes.
TRACE_CALL = r"^(?:\[pid +)?(\d+)\]? +(?:(\d+\.\d+) )?(\w+)\((.*?)\) += +(-?\d+)"
TRACE_READS, TRACE_WRITES, TRACE_FORKS = ("read", "pread64", "open", "openat", "execve", "mmap"), ("write", "pwrite64", "creat", "truncate", "unlink"), ("fork", "vfork", "clone")


def read_trace(spark: SparkSession, path: str) -> Store:
    """System call traces, a call a line with its process first; calls that failed are left out. The first quoted argument is the path."""
    x = _lines(spark, path).where(F.col("value").rlike(TRACE_CALL))
    got = [F.regexp_extract("value", TRACE_CALL, i) for i in range(1, 6)]
    rows = x.select(got[0].alias("pid"), got[1].alias("time"), got[2].alias("op"), F.regexp_extract(got[3], r'"([^"]*)"', 1).alias("path"), got[4].try_cast("bigint").alias("result")).where("result >= 0")
    proc = lambda c: F.create_map(F.lit("type"), F.lit("Process"), F.lit("pid"), c)
    art = F.create_map(F.lit("type"), F.lit("Artifact"), F.lit("path"), F.col("path"))
    kind = F.when(F.col("op").isin(*TRACE_FORKS) & (F.col("result") > 0), "WasTriggeredBy").when(F.col("op").isin(*TRACE_READS) & (F.col("path") != ""), "Used").when(F.col("op").isin(*TRACE_WRITES) & (F.col("path") != ""), "WasGeneratedBy")
    rows = rows.withColumn("kind", kind).where("kind is not null")
    me = proc(F.col("pid"))
    other = F.when(F.col("kind") == "WasTriggeredBy", proc(F.col("result").cast("string"))).otherwise(art)
    a = F.create_map(F.lit("type"), F.col("kind"), F.lit("operation"), F.col("op"), F.lit("time"), F.col("time"))
    rows = rows.select(me.alias("p"), other.alias("o"), a.alias("annotations"), (F.col("kind") == "Used").alias("reads"))
    v = rows.select(F.explode(F.array("p", "o")).alias("annotations")).select(vertex_id(F.col("annotations")).alias("id"), "annotations")
    p, o = vertex_id(F.col("p")), vertex_id(F.col("o"))
    e = rows.select(F.when(F.col("reads"), p).otherwise(o).alias("child"), F.when(F.col("reads"), o).otherwise(p).alias("parent"), "annotations")
    return Store.of(v, e.select(edge_id(F.col("child"), F.col("parent"), F.col("annotations")).alias("id"), "child", "parent", "annotations"))


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    """Linux audit records as (time, event_id, record, fields): the header and a map of ``key=value`` fields."""
    head = r"^(?:node=\S+ )?type=(\S+) msg=audit\((\d+\.\d+):(\d+)\): ?(.*)$"
    x = _lines(spark, path).where(F.col("value").rlike(head))
    pairs = F.transform(F.expr(r"""regexp_extract_all(rest, '([\\w-]+)=("[^"]*"|\\S+)', 0)"""), lambda t: F.struct(F.substring_index(t, "=", 1).alias("key"), F.regexp_replace(F.substring(t, F.instr(t, "=") + 1, F.length(t)), '^"|"$', "").alias("value")))
    x = x.select(F.regexp_extract("value", head, 2).alias("time"), F.regexp_extract("value", head, 3).alias("event_id"), F.regexp_extract("value", head, 1).alias("record"), F.regexp_extract("value", head, 4).alias("rest"))
    return x.select("time", "event_id", "record", _map_of(pairs).alias("fields"))


def read_blocks(spark: SparkSession, path: str) -> Store:
    """Coin blocks, one JSON object a line: blocks, transactions, payments and addresses, joined by PROV edges."""
    schema = "hash string, height string, tx array<struct<hash:string,inputs:array<struct<prev_out:struct<addr:string,n:string,tx_index:string,value:string>>>,out:array<struct<addr:string,n:string,tx_index:string,value:string>>>>"
    t = spark.read.schema(schema).json(path).select(F.col("hash").alias("block"), "height", F.explode("tx").alias("t"))
    block = F.create_map(F.lit("type"), F.lit("Activity"), F.lit("blockHash"), F.col("block"), F.lit("blockHeight"), F.coalesce("height", F.lit("")))
    tx = F.create_map(F.lit("type"), F.lit("Activity"), F.lit("transactionHash"), F.col("t.hash"))
    t = t.where("block is not null and t.hash is not null").select(block.alias("b"), tx.alias("x"), F.col("t.inputs.prev_out").alias("ins"), F.col("t.out").alias("outs"))
    pay = lambda p: F.create_map(F.lit("type"), F.lit("Entity"), F.lit("transactionIndex"), F.coalesce(p["tx_index"], F.lit("")), F.lit("transactionValue"), F.coalesce(p["n"], F.lit("")))
    who = lambda p: F.create_map(F.lit("type"), F.lit("Agent"), F.lit("address"), p["addr"])
    ea = lambda kind, value=None: F.create_map(F.lit("type"), F.lit(kind)) if value is None else F.create_map(F.lit("type"), F.lit(kind), F.lit("transactionValue"), F.coalesce(value, F.lit("")))
    ins, outs = t.select("x", F.explode("ins").alias("p")), t.select("x", F.explode("outs").alias("p"))
    parts = [
        t.select(F.col("x").alias("c"), F.col("b").alias("q"), ea("WasInformedBy").alias("a")),
        ins.select(F.col("x").alias("c"), pay(F.col("p")).alias("q"), ea("Used", F.col("p.value")).alias("a")),
        outs.select(pay(F.col("p")).alias("c"), F.col("x").alias("q"), ea("WasGeneratedBy", F.col("p.value")).alias("a")),
        *[d.where("p.addr is not null").select(pay(F.col("p")).alias("c"), who(F.col("p")).alias("q"), ea("WasAttributedTo").alias("a")) for d in (ins, outs)],
    ]
    e = parts[0]
    for more in parts[1:]:
        e = e.unionByName(more)
    v = e.select(F.explode(F.array("c", "q")).alias("annotations")).select(vertex_id(F.col("annotations")).alias("id"), "annotations")
    e = e.select(vertex_id(F.col("c")).alias("child"), vertex_id(F.col("q")).alias("parent"), F.col("a").alias("annotations"))
    return Store.of(v, e.select(edge_id(F.col("child"), F.col("parent"), F.col("annotations")).alias("id"), "child", "parent", "annotations"))


#: Record types that become vertices, the fields of an event that name other records, and event types that read.
CDM_VERTICES = {"RECORD_HOST": "Host", "RECORD_PRINCIPAL": "Principal", "RECORD_SUBJECT": "Subject", "RECORD_FILE_OBJECT": "Object"}
CDM_READS = ("EVENT_READ", "EVENT_RECVFROM", "EVENT_RECVMSG", "EVENT_LOADLIBRARY", "EVENT_EXECUTE", "EVENT_OPEN", "EVENT_MMAP")


def cdm_store(bodies: DataFrame, rectype: str = "rectype") -> Store:
    """A store from normalised records (``body`` variant): records by uuid are vertices, an event links its subject and object."""
    get = lambda p: F.try_variant_get("body", p, "string")
    kinds = F.create_map(*[F.lit(x) for kv in CDM_VERTICES.items() for x in kv])
    v = bodies.where(get("$.uuid").isNotNull() & kinds[F.col(rectype)].isNotNull())
    a = F.map_filter(F.create_map(F.lit("type"), kinds[F.col(rectype)], F.lit("uuid"), get("$.uuid"), F.lit("subtype"), get("$.type"), F.lit("pid"), get("$.cid"), F.lit("cmdLine"), get("$.cmdLine"), F.lit("hostName"), get("$.hostName"), F.lit("username"), get("$.username")), lambda k, x: x.isNotNull())
    v = v.select(reference_id(get("$.uuid")).alias("id"), a.alias("annotations"), F.lit(True).alias("ref"))
    e = bodies.where((F.col(rectype) == "RECORD_EVENT") & get("$.subject").isNotNull() & get("$.predicateObject").isNotNull())
    reads = get("$.type").isin(*CDM_READS)
    s, o = reference_id(get("$.subject")), reference_id(get("$.predicateObject"))
    ea = F.map_filter(F.create_map(F.lit("type"), F.lit("SimpleEdge"), F.lit("operation"), get("$.type"), F.lit("event id"), get("$.sequence"), F.lit("time"), get("$.timestampNanos")), lambda k, x: x.isNotNull())
    e = e.select(F.when(reads, s).otherwise(o).alias("child"), F.when(reads, o).otherwise(s).alias("parent"), ea.alias("annotations"))
    return Store.of(v, e.select(edge_id(F.col("child"), F.col("parent"), F.col("annotations")).alias("id"), "child", "parent", "annotations"))


def read_elements_json(spark: SparkSession, path: str) -> Store:
    """The message format of the log: objects ``{element: {annotations, hash[, childVertexHash, parentVertexHash]}}``, one a line."""
    x = spark.read.schema(f"element struct<annotations:{MAP},hash:string,childVertexHash:string,parentVertexHash:string>").json(path).select("element.*")
    v = x.where("hash is not null and childVertexHash is null").select(F.col("hash").alias("id"), "annotations")
    e = x.where("hash is not null and childVertexHash is not null").select(F.col("hash").alias("id"), F.col("childVertexHash").alias("child"), F.col("parentVertexHash").alias("parent"), "annotations")
    return Store.of(v, e)


def read_parquet(spark: SparkSession, path: str) -> Store:
    """A store written by ``writers.write_parquet``."""
    return Store(spark.read.parquet(f"{path}/vertices"), spark.read.parquet(f"{path}/edges"))


def read_jdbc(spark: SparkSession, url: str, properties: dict[str, str] | None = None, by_driver: bool = False) -> Store:
    """A store written by ``writers.write_jdbc``, read by 16 tasks a table, each a range of first letters of ids; together the ranges hold every id.

    With ``by_driver``, for a database that only the driver reaches, it reads the tables at once and stores them piece by piece.
    """
    marks = "123456789abcdef"
    c = '"id"'  # quoted as the SQL standard has it, as Spark made the column
    ranges = [f"{c} < '{marks[0]}'", *[f"{c} >= '{a}' and {c} < '{b}'" for a, b in zip(marks, marks[1:], strict=False)], f"{c} >= '{marks[-1]}'"]
    own = F.from_json("annotations", MAP).alias("annotations")
    get = lambda table, *cols: _got_by_driver(spark, url, table, properties or {}, cols) if by_driver else spark.read.jdbc(url, table, predicates=ranges, properties=properties or {})
    v = get("vertices", "id", "annotations").select("id", own)
    e = get("edges", "id", "child", "parent", "annotations").select("id", "child", "parent", own)
    return Store.of(v, e)


def _got_by_driver(spark: SparkSession, url: str, table: str, properties: dict[str, str], cols: tuple[str, ...]) -> DataFrame:
    """Columns of text of a table."""
    jvm = spark._jvm
    empty = spark.createDataFrame([], ", ".join(f"{c} string" for c in cols))
    schema = empty._jdf.schema()
    dialect = jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(url)
    connection = dialect.createConnectionFactory(jdbc_options(spark, url, table, properties)).apply(-1)
    pile = Pile(empty)
    try:
        names = ", ".join(dialect.quoteIdentifier(c) for c in cols)
        found = connection.createStatement().executeQuery(f"select {names} from {table}")
        rows = jvm.org.apache.spark.sql.execution.datasources.jdbc.JdbcUtils.resultSetToRows(found, schema).grouped(PIECE)
        while rows.hasNext():
            some = jvm.scala.jdk.javaapi.CollectionConverters.asJava(rows.next())
            pile.add(DataFrame(spark._jsparkSession.createDataFrame(some, schema), spark))
            del some
            gc.collect()  # the piece's DataFrames, which hold its rows in the JVM
            jvm.System.gc()  # else the heap grows as far as it may, whatever is held
    finally:
        connection.close()
    return pile.read()
