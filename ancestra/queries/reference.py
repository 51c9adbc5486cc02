"""Queries of the graph engine over the driver's tables: the store is ``vertices`` and ``edges``, the stream ``graph_element``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ancestra import session
from ancestra.functions.identity import canon_hash, edge_id, vertex_id
from ancestra.operators import federation, stats
from ancestra.operators import transformers as t
from ancestra.operators.graph import Store
from ancestra.plans.language import QueryError
from ancestra.plans.session import Session
from ancestra.sources import writers
from ancestra.streaming import filters as f

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


_stores: dict[tuple, Store] = {}


def _state(spark: SparkSession, path: str) -> int:
    """When a table was last written."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).getModificationTime()


def store(spark: SparkSession, d: str) -> Store:
    """The store of a folder of tables, loaded once a session: repeated rows are sorted out, and vertices and edges written in the order of their keys."""
    paths = [f"{d}/{t}.parquet" for t in ("vertices", "edges")]
    key = (spark.sparkContext.applicationId, session.cleared, *[(p, _state(spark, p)) for p in paths])
    if key not in _stores:
        v = spark.read.parquet(paths[0]).select(canon_hash("hash").alias("id"), "annotations", "ref")
        e = spark.read.parquet(paths[1]).select(canon_hash("hash").alias("id"), canon_hash("childvertexhash").alias("child"), canon_hash("parentvertexhash").alias("parent"), "annotations", "ref")
        _stores[key] = Store.of(v, e).kept()
    return _stores[key]


def program(text: str) -> Query:
    """A query-language program; its graph ``$out`` as (kind, id), or the table its last command gives."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        s = Session(store(spark, d))
        got = s.run(text)
        return got if isinstance(got, DataFrame) else s.graphs["$out"].rows()

    return run


START = "$start = $base.getVertex(name == 'hedgerun');"
FILES = "$files = $base.getVertex(path like '/etc/%');"

#: One program per construct of the language.
PROGRAMS = {
    "r_vertex_equal": "$out = $base.getVertex(type == 'Process' and uid == '1001');",
    "r_vertex_not_equal": "$out = $base.getVertex(name != 'loomd');",
    "r_vertex_not": "$out = $base.getVertex(not name == 'loomd');",
    "r_vertex_less": "$out = $base.getVertex(pid < '2');",
    "r_vertex_range": "$out = $base.getVertex(pid >= '15' and pid <= '2' or version > '3');",
    "r_vertex_like": "$out = $base.getVertex(\"command line\" like '%job 1%');",
    "r_vertex_not_like": "$out = $base.getVertex(path not like '/etc/%');",
    "r_vertex_regex": "$out = $base.getVertex(path ~ '[0-9]{3}[.](log|bin)');",
    "r_vertex_any": "$out = $base.getVertex(* == '1001');",
    "r_vertex_constraint": "%p = type == 'Artifact'; %q = %p and subtype == 'file'; $out = $base.getVertex(%q and not version == '0');",
    "r_edge": "$out = $base.getEdge(type == 'Used' and operation == 'read');",
    "r_edge_all": "$out = $base.getEdge();",
    "r_edge_with_endpoints": "$out = $base.getEdgeWithEndpoints(operation == 'fork');",
    "r_edge_endpoints": "$out = $base.getEdge(operation == 'fork').getEdgeEndpoints();",
    "r_edge_source": "$out = $base.getEdge(type == 'WasGeneratedBy').getEdgeSource();",
    "r_edge_destination": "$out = $base.getEdge(type == 'WasGeneratedBy').getEdgeDestination();",
    "r_union": "$a = $base.getVertex(type == 'Agent'); $b = $base.getVertex(uid == '1001'); $out = $a + $b;",
    "r_difference": "$a = $base.getVertex(type == 'Agent'); $out = $base.getVertex() - $a;",
    "r_intersection": "$a = $base.getVertex(type == 'Process'); $out = $a & $base.getVertex(uid == '1001');",
    "r_assign_ops": "$out = $base.getVertex(type == 'Agent'); $out += $base.getVertex(type == 'Process'); $out -= $base.getVertex(uid == '1001'); $out &= $base.getVertex(* like '1%');",
    "r_match": "$a = $base.getVertex(type == 'Process'); $b = $base.getVertex(type == 'Agent'); $out = $a.getMatch($b, 'uid');",
    "r_neighbor_a": START + "$out = $base.getNeighbor($start, 'ancestor');",
    "r_neighbor_both": START + "$out = $base.getNeighbor($start, 'both');",
    "r_lineage_a": START + "$out = $base.getLineage($start, 3, 'a');",
    "r_lineage_d": START + "$out = $base.getLineage($start, 2, 'd');",
    "r_lineage_both": START + "$out = $base.getLineage($start, 2, 'b');",
    "r_path": START + FILES + "$out = $base.getPath($start, $files, 3);",
    "r_path_legs": START + FILES + "$via = $base.getVertex(name == 'loomd'); $out = $base.getPath($start, $via, 2, $files, 2);",
    "r_shortest_path": START + "$sock = $base.getVertex(subtype == 'network socket'); $out = $base.getShortestPath($start, $sock, 6);",
    "r_link": START + "$sock = $base.getVertex(protocol == 'tcp'); $out = $base.getLink($start, $sock, 2);",
    "r_subgraph": "$skeleton = $base.getVertex(type == 'Process'); $out = $base.getSubgraph($skeleton);",
    "r_span": "$skeleton = $base.getEdge(operation == 'fork'); $out = $skeleton.span($base);",
    "r_collapse": "$out = $base.collapseEdge('type');",
    "r_subset": "$out = $base.subset(10, -10);",
    "r_limit": "$out = $base.limit(25);",
    "r_path_lengths": START + FILES + "pathlengths $base $start $files 4;",
    "r_stat": "stat $base;",
    "r_histogram": "stat edge operation histogram $base;",
    "r_mean": "env set precision 6; stat edge size mean $base;",
    "r_std": "env set precision 6; stat edge size std $base;",
    "r_distribution": "env set precision 6; stat edge size distribution 7 $base;",
    "r_describe_keys": "describe $base vertex;",
    "r_describe_count": "describe $base edge type count;",
    "r_describe_minmax": "describe $base vertex pid minmax;",
    "r_comments_and_escapes": "# every kind\n$out = $base.getVertex(path like '/tmp/\\%1%' or name == 'hedger\\un'); # of text\n",
    "r_empty": "$out = vertices() + $base.getVertex(nokey != 'x') + $base.getEdge(nokey < 'x');",
    "r_unknown_key_not": "$out = $base.getVertex(not nokey == 'x');",
    "r_local_lineage": START + "$out = $base.getLocalLineage($start, 2, 'd');",
    "r_link_of_subset": START + "$sock = $base.getVertex(protocol == 'tcp'); $part = $base.getEdge(type == 'Used' or type == 'WasGeneratedBy'); $out = $part.getLink($start, $sock, 2);",
    "r_size_guard": "$none = vertices(); stat vertex pid mean $none;",
    "r_list": START + "%p = name == 'x'; env set limit 7; list;",
    "r_native_braces": "native 'select count(*) as n from vertices where annotations[\"pid\"] rlike \"^[0-9]{3}$\"';",
    "r_native": "native 'select annotations[\"type\"] as kind, count(*) as n from vertices group by 1';",
}
QUERIES |= {k: program(x) for k, x in PROGRAMS.items()}


@query
def r_literals(spark: SparkSession, d: str) -> DataFrame:
    s = store(spark, d)
    ids = [r.id for r in s.vertices.where(F.col("annotations")["type"] == "Agent").select("id").orderBy("id").limit(20).collect()]
    return s.vertices_by_id(*ids, "x" * 40).rows()


@query
def r_edge_literals(spark: SparkSession, d: str) -> DataFrame:
    s = Session(store(spark, d))
    ids = [r.id for r in s.store.edges.where(F.col("annotations")["operation"] == "fork").select("id").orderBy("id").limit(20).collect()]
    s.run("$out = edges({});".format(", ".join(f"'{i}'" for i in [*ids, "none"])))
    return s.graphs["$out"].rows()


@query
def r_dump_constraint(spark: SparkSession, d: str) -> DataFrame:
    text = Session(store(spark, d)).run("%p = a == '1' or not b like 'x'; %p &= c > '2'; dump %p;")
    return spark.createDataFrame([(text,)], "text string")


@query
def r_dump(spark: SparkSession, d: str) -> DataFrame:
    v, e = Session(store(spark, d)).run("$x = $base.getEdgeWithEndpoints(operation == 'fork'); dump all $x;")
    return v.select(F.lit("vertex").alias("kind"), "id").unionByName(e.select(F.lit("edge").alias("kind"), "id"))


@query
def r_export_guard(spark: SparkSession, d: str) -> DataFrame:
    """What a dump of more than the limit says."""
    s = Session(store(spark, d))
    try:
        s.run("env set exportLimit 3; dump $base;")
    except QueryError as e:
        return spark.createDataFrame([("exportLimit 3" in str(e),)], "refused boolean")
    return spark.createDataFrame([(False,)], "refused boolean")


@query
def r_workspace(spark: SparkSession, d: str) -> DataFrame:
    """The variables that are left after erase, and after reset."""
    s = Session(store(spark, d))
    s.run("$a = vertices('a'); $b = $a; %p = x == '1'; erase $a;")
    left = sorted([*s.graphs, *s.constraints])
    s.run("reset workspace;")
    return spark.createDataFrame([(" ".join(left), len(s.graphs) + len(s.constraints))], "left string, after_reset int")


@query
def r_refine(spark: SparkSession, d: str) -> DataFrame:
    """Paths between the ends of edges with two operations, for each pair."""
    return store(spark, d).base.refine_dependencies([("fork", "read"), ("write", "fork")], "operation", 2).rows()


@query
def r_remote_create(spark: SparkSession, d: str) -> DataFrame:
    """A graph of three vertices on another host, linked and exported from here."""
    s = store(spark, d)
    ids = [r.id for r in s.vertices.select("id").orderBy("id").limit(3).collect()]
    own = Session(s, {"there": s})
    v, e = own.run("remote create $x 'there' {}; remote export $x;".format(" ".join(f"'{i}'" for i in ids)))
    return v.select(F.lit("vertex").alias("kind"), "id").unionByName(e.select(F.lit("edge").alias("kind"), "id"))


@query
def r_with_keys(spark: SparkSession, d: str) -> DataFrame:
    return store(spark, d).base.vertices_with_keys("local address", "remote port").rows()


@query
def r_identity(spark: SparkSession, d: str) -> DataFrame:
    s = store(spark, d)
    v = s.vertices.select("id", vertex_id(F.col("annotations")).alias("content_id"))
    return v.unionByName(s.edges.select("id", edge_id(F.col("child"), F.col("parent"), F.col("annotations")).alias("content_id")))


@query
def r_export(spark: SparkSession, d: str) -> DataFrame:
    v, e = store(spark, d).base.get_edge_with_endpoints().export()
    return v.select(F.lit("vertex").alias("kind"), "id", F.size("annotations").alias("n")).unionByName(e.select(F.lit("edge").alias("kind"), "id", F.size("annotations").alias("n")))


@query
def r_remote_lineage(spark: SparkSession, d: str) -> DataFrame:
    """Two halves of the store, by source, as two hosts whose lineages meet at sockets."""
    s = store(spark, d)
    e = spark.read.parquet(f"{d}/edges.parquet").select(canon_hash("hash").alias("id"), (F.col("source") == "audit").alias("first")).groupBy("id").agg(F.max("first").alias("first"))
    here = Store(s.vertices, s.edges.join(e.where("first"), "id", "left_semi"))
    there = Store(s.vertices, s.edges.join(e.where("first"), "id", "left_anti"))
    g = here.base
    start = g.get_vertex(_named("hedgerun"))
    return federation.remote_lineage(g.get_lineage(start, 3, "a"), start, 3, "a", [there]).rows()


def _named(name: str):
    from ancestra.functions.predicates import Compare

    return Compare("name", "==", name)


@query
def r_attribute_rows(spark: SparkSession, d: str) -> DataFrame:
    return writers.attribute_rows(store(spark, d).vertices)


@query
def r_adjacency(spark: SparkSession, d: str) -> DataFrame:
    return writers.adjacency(store(spark, d).edges, "a").select("id", F.array_join("neighbours", ",").alias("neighbours"))


@query
def r_sample(spark: SparkSession, d: str) -> DataFrame:
    """Of a sample of 40 vertices and 40 edges how many there are, how many different ones, and how many the store has."""
    g = store(spark, d).base
    got = g.sample(40).rows()
    known = g.rows().withColumnsRenamed({"kind": "k", "id": "i"})
    both = got.join(known, (F.col("kind") == F.col("k")) & (F.col("id") == F.col("i")), "left")
    return both.groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct("id").alias("n_distinct"), F.count("i").alias("n_known"))


@query
def r_private_histogram(spark: SparkSession, d: str) -> DataFrame:
    """For each value of a histogram with noise of scale 1 whether its count is within 40 of the true one (missed once in e^40) and not below 0."""
    true = stats.histogram(store(spark, d).base, "edge", "operation")
    noisy = stats.noisy(true, "n", 1.0, seed=7).withColumnsRenamed({"value": "v", "n": "m"})
    return true.join(noisy, F.col("value") == F.col("v")).select("value", ((F.abs(F.col("n") - F.col("m")) <= 40) & (F.col("m") >= 0)).alias("near"))


# transformations: the result graph by content

TRANSFORMS = {
    "t_last_name": ("LastName", ""),
    "t_merge_io": ("MergeIO", ""),
    "t_no_memory": ("NoMemory", ""),
    "t_no_units": ("NoUnits", ""),
    "t_no_versions": ("NoVersions", ""),
    "t_drop_keys": ("DropKeys", 'keys="event id,size,time"'),
    "t_blacklist": ("Blacklist", 'pattern="^/(etc|tmp)/"'),
    "t_blacklist_default": ("Blacklist", ""),
    "t_no_ephemeral_reads": ("NoEphemeralReads", "limited=false"),
    "t_no_ephemeral_reads_default": ("NoEphemeralReads", ""),
    "t_no_ephemeral_writes": ("NoEphemeralWrites", ""),
    "t_opm_to_prov": ("OPM2Prov", ""),
    "t_prov_to_opm": ("Prov2OPM", ""),
    "t_opm_to_prov_tc": ("OPM2ProvTC", "operation=cdmOperation uid=owner"),
    "t_prov_tc_to_opm": ("ProvTC2OPM", "operation=cdmOperation"),
    "t_simple_forks": ("SimpleForks", ""),
    "t_sanitization": ("Sanitization", "sanitizationLevel=low"),
    "t_abe": ("ABE", "level=low key=0123456789abcdef"),
    "t_only_agents": ("OnlyAgents", ""),
    "t_aggregation": ("Aggregation", ""),
}


def _transform(name: str, args: str) -> Query:
    return lambda spark, d: t.apply(name, store(spark, d).base, args).rows()


QUERIES |= {k: _transform(*x) for k, x in TRANSFORMS.items()}


@query
def t_only_addresses(spark: SparkSession, d: str) -> DataFrame:
    """Orders as transactions that customers pay and suppliers are paid in, a line item a payment: who pays whom how much."""
    o, li = (spark.read.parquet(f"{d}/{x}.parquet") for x in ("orders", "lineitem"))
    a = lambda kind, **more: F.create_map(*[x for k, c in (("type", F.lit(kind)), *more.items()) for x in (F.lit(k), c)])
    tx = lambda c: F.concat(F.lit("o"), F.col(c).cast("string"))
    paid = F.concat(F.lit("in"), F.col("o_orderkey").cast("string"))
    payer = F.concat(F.lit("c"), F.col("o_custkey").cast("string"))
    got = F.concat_ws("-", F.lit("out"), F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    payee = F.concat(F.lit("s"), F.col("l_suppkey").cast("string"))
    entity, activity = a("Entity"), a("Activity")

    def rows(df: DataFrame, ea, child, ca, parent, pa) -> DataFrame:
        return df.select(F.lit("").alias("id"), ea.alias("ea"), child.alias("child"), ca.alias("ca"), parent.alias("parent"), pa.alias("pa"))

    e = rows(o, a("Used"), tx("o_orderkey"), activity, paid, entity)
    e = e.unionByName(rows(o, a("WasAttributedTo"), paid, entity, payer, a("Agent", address=payer)))
    e = e.unionByName(rows(li, a("WasGeneratedBy", transactionValue=F.col("l_quantity").cast("int").cast("string")), got, entity, tx("l_orderkey"), activity))
    e = e.unionByName(rows(li, a("WasAttributedTo"), got, entity, payee, a("Agent", address=payee)))
    return t.only_addresses(e).select(F.col("ca")["address"].alias("payee"), F.col("pa")["address"].alias("payer"), F.col("ea")["transactionValue"].alias("value")).distinct()


def _walks(name: str, args: str, way: str, depth: int | None = None) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        g = store(spark, d).base
        source = g.get_vertex(_named("hedgerun"))
        return t.apply(name, g, args, source=source, depth=depth, way=way).rows()

    return run


QUERIES |= {
    "t_prune": _walks("Prune", "", "ancestors", 2),
    "t_temporal_a": _walks("TemporalTraversal", 'order="event id"', "ancestors"),
    "t_temporal_d": _walks("TemporalTraversal", "order=time", "descendants"),
    "t_contextual": _walks("ContextualTemporalTraversal", "order=time", "descendants"),
    "t_beep": _walks("BEEP", "", "ancestors"),
}


# stream filters, in batch over the message log

_streams: dict[tuple, DataFrame] = {}


def _log(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The message log as rows of elements without the annotations of ends, and the vertices that have them."""
    x = spark.read.parquet(f"{d}/graph_element.parquet")
    rows = x.select("seq", "source", "kind", canon_hash(F.col("element")["hash"]).alias("id"), canon_hash(F.col("element")["childvertexhash"]).alias("child"), canon_hash(F.col("element")["parentvertexhash"]).alias("parent"), F.col("element")["annotations"].alias("annotations"), "event_time")
    v = spark.read.parquet(f"{d}/vertices.parquet").select(canon_hash("hash").alias("id"), "annotations")
    return rows.where("kind = 'vertex' or (child is not null and parent is not null)"), v


def stream(spark: SparkSession, d: str) -> DataFrame:
    """The message log as rows of elements, an edge with the annotations of both ends, as filters meet them; put together and written once a session."""
    paths = [f"{d}/{t}.parquet" for t in ("graph_element", "vertices")]
    key = (spark.sparkContext.applicationId, session.cleared, *[(p, _state(spark, p)) for p in paths])
    if key not in _streams:
        whole = f.elements_of(*_log(spark, d))
        _streams[key] = session.stored(whole.repartitionByRange(session.tasks_of(spark), "seq"))
    return _streams[key]


def filtered(change: Callable[[DataFrame], DataFrame]) -> Query:
    """(seq, kind, id, text) of what a filter lets through; ``text`` is the annotations in order of key."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        from ancestra.functions.identity import annotations_text

        return change(stream(spark, d)).select("seq", "kind", "id", annotations_text(F.col("annotations")).alias("text"))

    return run


def _dated(rows: DataFrame) -> DataFrame:
    """Rows with their event time as an annotation, where they have one."""
    day = F.date_format("event_time", "yyyy-MM-dd HH:mm:ss")
    return rows.withColumn("annotations", F.when(day.isNull(), F.col("annotations")).otherwise(t.put(F.coalesce("annotations", F.create_map().cast(t.MAP)), "day", day)))


QUERIES |= {
    "f_add_annotation": filtered(lambda x: f.add_annotation(x, {"host": "h1"})),
    "f_drop_keys": filtered(lambda x: f.drop_keys(x, "time", "event id", "type")),
    "f_blacklist": filtered(lambda x: f.blacklist(x, "^/(etc|usr)/")),
    "f_filter_provenance": filtered(lambda x: f.filter_provenance(x, "uid", "1001")),
    "f_drop_principals": filtered(f.drop_principals),
    "f_convert_time": filtered(lambda x: f.convert_time(_dated(x), "day", "yyyy-MM-dd HH:mm:ss", "day", "dd/MM/yyyy HH", "edge")),
    "f_opm_to_prov": filtered(lambda x: f.opm_to_prov(x, keep_unknown=False)),
    "f_opm_to_prov_tc": filtered(lambda x: f.opm_to_prov_tc(x, {"operation": "cdmOperation"})),
    "f_deduplicate": filtered(f.deduplicate),
    "f_drop_repeat_edges": filtered(lambda x: f.drop_repeat_edges(x, "operation")),
    "f_io_runs": filtered(lambda x: f.io_runs(x, "path", "version")),
    "f_version_on_write": filtered(f.version_on_write),
    "f_version_process": filtered(f.version_process),
    "f_cycle_avoidance": filtered(f.cycle_avoidance),
    "f_linux_threads": filtered(f.linux_threads),
}


@query
def f_audit_sanity(spark: SparkSession, d: str) -> DataFrame:
    return f.audit_sanity(stream(spark, d))


@query
def f_cross_namespaces(spark: SparkSession, d: str) -> DataFrame:
    return f.cross_namespaces(stream(spark, d), ["path", "version"], ["uid"])


@query
def f_attribute_label(spark: SparkSession, d: str) -> DataFrame:
    return f.attribute_label(stream(spark, d), ["hedgerun"])


@query
def f_process_features(spark: SparkSession, d: str) -> DataFrame:
    return f.process_features(f.deduplicate(stream(spark, d)))


@query
def f_process_profile(spark: SparkSession, d: str) -> DataFrame:
    return f.process_profile(f.deduplicate(stream(spark, d)))


@query
def f_fuse(spark: SparkSession, d: str) -> DataFrame:
    return f.fuse(f.deduplicate(stream(spark, d)), "audit", "camflow", "name").select("seq", "kind", "id", "child", "parent")


@query
def f_artifact_features(spark: SparkSession, d: str) -> DataFrame:
    return f.artifact_features(stream(spark, d))


@query
def f_clam_prov(spark: SparkSession, d: str) -> DataFrame:
    """Reads with the call site of the same process nearest in time; writes stand for call sites, as no source has any."""
    x = f.deduplicate(stream(spark, d))
    at = F.col("annotations")["time"].try_cast("double")
    w = x.where(f.is_edge() & f.of_type("annotations", "WasGeneratedBy") & at.isNotNull() & F.col("pa")["pid"].isNotNull())
    calls = w.select("id", F.col("pa")["pid"].alias("key"), at.alias("at"), F.create_map(F.lit("call site"), F.col("id")).alias("annotations"))
    got = f.clam_prov(x.where(f.is_edge() & f.of_type("annotations", "Used")), calls, 7200.0)
    return got.select("seq", "id", F.col("annotations")["call site"].alias("site"))


@query
def f_android_threads(spark: SparkSession, d: str) -> DataFrame:
    """Threads merged into their leaders; a process's parent stands for its group here, as no source names groups."""
    group = lambda a: F.when((F.col(a)["type"] == "Process") & F.col(a)["ppid"].isNotNull(), t.put(F.col(a), "tgid", F.col(a)["ppid"])).otherwise(F.col(a))
    x = stream(spark, d).withColumns({a: group(a) for a in ("annotations", "ca", "pa")})
    return f.android_threads(x).select("seq", "kind", "id")


@query
def f_llvm_filter(spark: SparkSession, d: str) -> DataFrame:
    """Processes by name as functions, forks as calls: what leads to one of them."""
    named = lambda a: F.when(F.col(a)["name"].isNotNull(), t.put(F.col(a), "FunctionName", F.col(a)["name"])).otherwise(F.col(a))
    ident = lambda a: F.when(F.col(a)["type"] == "Artifact", t.put(F.col(a), "ID", F.col(a)["path"])).otherwise(F.col(a))
    x = stream(spark, d)
    for change in (named, ident):
        x = x.withColumns({a: change(a) for a in ("annotations", "ca", "pa")})
    calls = x.where(f.is_edge() & (F.col("annotations")["operation"] == "fork") & F.col("ca")["name"].isNotNull() & F.col("pa")["name"].isNotNull()).select(F.col("pa")["name"].alias("caller"), F.col("ca")["name"].alias("callee")).distinct()
    return f.llvm_filter(x, calls, ["hedgerun"]).select("seq", "kind", "id")


@query
def f_graph_finesse(spark: SparkSession, d: str) -> DataFrame:
    rows, v = _log(spark, d)
    return f.graph_finesse(f.deduplicate(rows), vertices=v).select("seq", "kind", "id")


@query
def f_fusion(spark: SparkSession, d: str) -> DataFrame:
    return f.fusion(f.deduplicate(stream(spark, d)), "audit", "camflow", "name")


