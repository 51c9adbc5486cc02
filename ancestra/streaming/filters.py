"""Stream filters over rows of elements.

A row is (seq, source, kind, id, child, parent, annotations, ca, pa, event_time): a vertex
or an edge, an edge with the annotations of both ends. Filters without state are plain
projections and work on batch and streaming DataFrames alike. Filters that depend on
order are, in batch, running values by ``seq``; their streaming forms are in ``stateful``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ancestra.functions.identity import edge_id, vertex_id
from ancestra.operators import cycles
from ancestra.operators import transformers as t
from ancestra.operators.running import count_before, last_before
from ancestra.session import Pile, stored

MAP = "map<string,string>"
COLUMNS = ["seq", "source", "kind", "id", "child", "parent", "annotations", "ca", "pa", "event_time"]


def elements_of(graph_rows: DataFrame, vertices: DataFrame) -> DataFrame:
    """Rows of elements with the annotations of ends, from rows without and the vertices."""
    v = vertices.select("id", "annotations").dropDuplicates(["id"])
    e = graph_rows.join(v.select(F.col("id").alias("child"), F.col("annotations").alias("ca")), "child", "left").join(v.select(F.col("id").alias("parent"), F.col("annotations").alias("pa")), "parent", "left")
    return e.select(*COLUMNS)


def _both(rows: DataFrame, change) -> DataFrame:
    """Apply a change to the annotations of elements and of ends."""
    for c in ("annotations", "ca", "pa"):
        rows = rows.withColumn(c, change(F.col(c)))
    return rows


def is_edge() -> Column:
    return F.col("kind") == "edge"


def of_type(a: str, *types: str) -> Column:
    return F.coalesce(F.col(a)["type"].isin(*types), F.lit(False))


# without state


def add_annotation(rows: DataFrame, new: dict[str, str]) -> DataFrame:
    """The given annotations on every element, also one without any, and on ends that are known; they replace those of the same name."""
    rows = rows.withColumn("annotations", F.coalesce("annotations", F.create_map().cast(MAP)))
    more = F.create_map(*[F.lit(x) for kv in new.items() for x in kv])
    return _both(rows, lambda a: F.when(a.isNull(), a).otherwise(F.map_concat(F.map_filter(a, lambda k, v: ~k.isin(list(new))), more)))


def drop_keys(rows: DataFrame, *keys: str) -> DataFrame:
    """Without the given annotations; ``type`` always stays."""
    gone = [k for k in keys if k != "type"]
    return _both(rows, lambda a: F.map_filter(a, lambda k, v: ~k.isin(gone))) if gone else rows


def blacklist(rows: DataFrame, pattern: str) -> DataFrame:
    """Without vertices, and edges with an end, whose path matches."""
    bad = lambda a: F.coalesce(F.col(a)["path"].rlike(pattern), F.lit(False))
    return rows.where(F.when(is_edge(), ~bad("ca") & ~bad("pa")).otherwise(~bad("annotations")))


def filter_provenance(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Without elements that have the annotation, themselves or at an end."""
    has = lambda a: F.coalesce(F.col(a)[key] == value, F.lit(False))
    return rows.where(~has("annotations") & ~(is_edge() & (has("ca") | has("pa"))))


def drop_principals(rows: DataFrame) -> DataFrame:
    return rows.where(F.when(is_edge(), ~of_type("annotations", "Edge")).otherwise(~of_type("annotations", "Principal")))


def convert_time(rows: DataFrame, key: str, pattern: str, new_key: str, new_pattern: str, kind: str = "edge") -> DataFrame:
    """A time annotation written anew under ``new_key``; values that don't fit the pattern leave the element as it is."""
    got = F.date_format(F.try_to_timestamp(F.col("annotations")[key], F.lit(pattern)), new_pattern)
    return rows.withColumn("annotations", F.when((F.col("kind") == kind) & got.isNotNull(), t.put(F.col("annotations"), new_key, got)).otherwise(F.col("annotations")))


def opm_to_prov(rows: DataFrame, keep_unknown: bool = True) -> DataFrame:
    """OPM types as PROV types; elements of other types stay, or are dropped."""
    v = F.create_map(*[F.lit(x) for kv in t.VERTEX_TYPES.items() for x in kv])
    e = F.create_map(*[F.lit(x) for kv in t.EDGE_TYPES.items() for x in kv])
    kind = F.col("annotations")["type"]
    new = F.when(is_edge(), e[kind]).otherwise(v[kind])
    if not keep_unknown:
        rows = rows.where(new.isNotNull())
    rows = rows.withColumn("annotations", F.when(new.isNotNull(), t.put(F.col("annotations"), "type", new)).otherwise(F.col("annotations")))
    for c in ("ca", "pa"):
        x = v[F.col(c)["type"]]
        rows = rows.withColumn(c, F.when(x.isNotNull(), t.put(F.col(c), "type", x)).otherwise(F.col(c)))
    return rows


def opm_to_prov_tc(rows: DataFrame, names: dict[str, str]) -> DataFrame:
    rows = opm_to_prov(rows)
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return _both(rows, lambda a: F.when(a.isNull(), a).otherwise(F.transform_keys(F.map_filter(a, lambda k, v: ~k.isin(list(names.values()))), lambda k, v: F.coalesce(table[k], k)))) if names else rows


# order or other rows matter


def deduplicate(rows: DataFrame) -> DataFrame:
    """The first row of every element by ``seq``, rows without an id gone; a stream must have a watermark, and forgets ids when it passes.

    One aggregation with map-side partial results, so an element that holds most rows is a row a task.
    """
    if rows.isStreaming:
        return rows.dropDuplicatesWithinWatermark(["id"])
    cols = [F.col(c) for c in rows.columns if c != "id"]
    first = rows.where("id is not null").groupBy("id").agg(F.min_by(F.struct(*cols), "seq").alias("__first"))
    return first.select(*[F.col(c) if c == "id" else F.col(f"__first.{c}").alias(c) for c in rows.columns])


def audit_sanity(rows: DataFrame) -> DataFrame:
    """(seq, id, endpoint): ends of edges that no earlier vertex row has."""
    e = rows.where(is_edge()).select("seq", "id", F.explode(F.array("child", "parent")).alias("endpoint"))
    v = rows.where(~is_edge()).groupBy(F.col("id").alias("endpoint")).agg(F.min("seq").alias("at"))
    return e.join(v, "endpoint", "left").where("at is null or at > seq").select("seq", "id", "endpoint").distinct()


def drop_repeat_edges(rows: DataFrame, *by: str) -> DataFrame:
    """Without edges whose ``by`` annotations equal those of the edge before between the same ends."""
    value = F.struct(*[F.col("annotations")[k].alias(f"b{i}") for i, k in enumerate(by)]) if by else F.struct(F.lit(1).alias("b0"))
    e = last_before(rows.where(is_edge()), ["child", "parent"], "seq", {"__last": value})
    kept = e.where(F.col("__last").isNull() | ~F.col("__last").eqNullSafe(value)).drop("__last")
    return kept.unionByName(rows.where(~is_edge()))


def io_runs(rows: DataFrame, *keys: str) -> DataFrame:
    """Of a run of reads, or of writes, between an artifact (by ``keys``) and a process the first; a read ends a run of writes and the other way round."""
    used, made = of_type("annotations", "Used"), of_type("annotations", "WasGeneratedBy")
    has = lambda a: F.size(F.filter(F.array(*[F.col(a)[k] for k in keys]), lambda x: x.isNull())) == 0
    io = is_edge() & F.coalesce(F.when(used, has("pa")).when(made, has("ca")), F.lit(False))
    key = lambda a: F.concat_ws("\x00", *[F.col(a)[k] for k in keys])
    d = rows.where(io).withColumn("__file", F.when(used, key("pa")).otherwise(key("ca"))).withColumn("__proc", F.when(used, F.col("child")).otherwise(F.col("parent")))
    op = F.when(used, "r").otherwise("w")
    d = last_before(d.withColumn("__op", op), ["__file", "__proc"], "seq", {"__last": F.col("__op")})
    kept = d.where(F.col("__last").isNull() | (F.col("__last") != F.col("__op"))).select(*rows.columns)
    return kept.unionByName(rows.where(~io))


def version_on_write(rows: DataFrame, key: str = "version", initial: int = 0, chain: tuple[str, str] = ("edge_type", "versioning")) -> DataFrame:
    """Every edge gives its child a new version; parents are met in their version at that time. Adds an edge from each new version to the one before.

    A version is the number of earlier edges with the vertex as child, so it is a running count over the rows of both ends.
    """
    e = rows.where(is_edge())
    # of one edge the parent's row comes first, so a self-loop links the new version to the old
    e = _counted_ends(e, F.lit(True))
    at = lambda a, x: t.put(F.coalesce(a, F.create_map().cast(MAP)), key, x.cast("string"))
    new, old, par = at(F.col("ca"), F.col("nc") + initial + 1), at(F.col("ca"), F.col("nc") + initial), at(F.col("pa"), F.col("np") + initial)
    return _with_vertices(_edge_rows(e, new, par, F.col("annotations")).unionByName(_edge_rows(e, new, old, F.create_map(F.lit(chain[0]), F.lit(chain[1])))))


def _counted_ends(e: DataFrame, flag: Column) -> DataFrame:
    """Edges with ``nc`` and ``np``: how many edges with ``flag`` came before that have the child, or the parent, as child."""
    ends = F.array(F.struct(F.col("child").alias("v"), F.lit(True).alias("c"), flag.alias("f")), F.struct(F.col("parent").alias("v"), F.lit(False).alias("c"), F.lit(False).alias("f")))
    seen = e.select("seq", F.explode(ends).alias("y")).select("seq", "y.*").withColumn("__o", F.col("seq") * 2 + F.col("c").cast("int"))
    n = count_before(seen, ["v"], "__o", F.col("f"), "n")
    both = n.groupBy("seq").agg(F.max(F.when(F.col("c"), F.col("n"))).alias("nc"), F.max(F.when(~F.col("c"), F.col("n"))).alias("np"))
    return e.join(both, "seq")


def version_process(rows: DataFrame, key: str = "version", initial: int = 0, chain: tuple[str, str] = ("edge_type", "versioning")) -> DataFrame:
    """Every read of an artifact gives the process a new version; only those edges, and the links between versions, go on."""
    reads = is_edge() & of_type("annotations", "Used") & of_type("ca", "Process") & of_type("pa", "Artifact")
    e = count_before(rows.where(reads), ["child"], "seq", F.lit(True), "n")
    at = lambda x: t.put(F.col("ca"), key, x.cast("string"))
    new = at(F.col("n") + initial + 1)
    return _with_vertices(_edge_rows(e, new, F.col("pa"), F.col("annotations")).unionByName(_edge_rows(e, new, at(F.col("n") + initial), F.create_map(F.lit(chain[0]), F.lit(chain[1])))))


def _edge_rows(e: DataFrame, ca: Column, pa: Column, a: Column) -> DataFrame:
    d = e.select("seq", "source", F.lit("edge").alias("kind"), ca.alias("ca"), pa.alias("pa"), a.alias("annotations"), "event_time")
    child, parent = vertex_id(F.col("ca")), vertex_id(F.col("pa"))
    return d.select("seq", "source", "kind", edge_id(child, parent, F.col("annotations")).alias("id"), child.alias("child"), parent.alias("parent"), "annotations", "ca", "pa", "event_time")


def _with_vertices(e: DataFrame) -> DataFrame:
    """Edges and the vertices at their ends, each once, at its first edge."""
    none = F.lit(None)
    ends = e.select("seq", "source", "event_time", F.explode(F.array(F.struct(F.col("child").alias("id"), F.col("ca").alias("a")), F.struct(F.col("parent").alias("id"), F.col("pa").alias("a")))).alias("x"))
    first = ends.select("seq", "source", "event_time", F.col("x.id").alias("id"), F.col("x.a").alias("annotations")).groupBy("id").agg(F.min_by(F.struct("seq", "source", "event_time", "annotations"), "seq").alias("y"))
    v = first.select("y.seq", "y.source", F.lit("vertex").alias("kind"), "id", none.cast("string").alias("child"), none.cast("string").alias("parent"), "y.annotations", none.cast(MAP).alias("ca"), none.cast(MAP).alias("pa"), "y.event_time")
    return e.unionByName(v)


def cycle_avoidance(rows: DataFrame, rounds: int = 1000) -> DataFrame:
    """The edges that go on when every one gives its child a new version: the first between two ends, and later ones only if their parent got a new version since the first.

    What goes on depends on earlier rows only. Starting from the first edges, rounds add the later ones that those let on,
    until none is added; each round is one running value. Self-loops are dropped. Gives rows with ``put`` true.
    """
    e = stored(rows.where(is_edge() & (F.col("child") != F.col("parent"))))
    first = e.groupBy("child", "parent").agg(F.min("seq").alias("f"))
    d = stored(e.select("seq", "child", "parent").join(first, ["child", "parent"]))
    puts = stored(d.where("seq = f").select("seq", F.col("child").alias("v")))
    open_ = stored(d.where("seq <> f"))
    for _ in range(rounds):
        both = puts.select("seq", "v", F.lit(None).cast("bigint").alias("f"), F.col("seq").alias("p")).unionByName(open_.select("seq", F.col("parent").alias("v"), "f", F.lit(None).cast("bigint").alias("p")))
        at = last_before(both.withColumn("__o", F.col("seq") * 2 + F.col("p").isNotNull().cast("int")), ["v"], "__o", {"lp": F.col("p")})
        new = at.where("p is null and lp > f").select("seq")
        new = stored(open_.join(new, "seq", "left_semi").select("seq", F.col("child").alias("v")))
        if new.isEmpty():
            break
        puts = stored(puts.unionByName(new))
        open_ = stored(open_.join(new.select("seq"), "seq", "left_anti"))
    else:
        raise RuntimeError(f"edges still go on after {rounds} rounds")
    return e.join(puts.select("seq"), "seq", "left_semi")


#: Edges that one task goes through in order. It holds them as numbers, and the names of vertices once: 0.9 GB at most for 6 million edges, as measured.
IN_ORDER = 8_000_000


def _held(batches) -> tuple[pa.Array, np.ndarray, np.ndarray, list]:
    """Edges (seq, src, dst) of one task in order: numbers of ends, and the names these stand for."""
    codes: dict = {}
    seqs, ends = [], ([], [])
    for batch in batches:
        seqs.append(batch.column("seq"))
        for c, held in zip(("src", "dst"), ends, strict=True):
            got = batch.column(c).dictionary_encode(null_encoding="encode")
            own = np.array([codes.setdefault(x, len(codes)) for x in got.dictionary.to_pylist()], np.int32)
            held.append(own[got.indices.to_numpy(zero_copy_only=False)])
    if not seqs:
        return pa.array([], pa.int64()), np.zeros(0, np.int32), np.zeros(0, np.int32), []
    seq = pa.chunked_array(seqs)
    order = pc.sort_indices(seq)
    at = order.to_numpy()
    src, dst = (np.concatenate(x)[at] for x in ends)
    return pa.array(seq.take(order).to_numpy() if not seq.null_count else seq.take(order).to_pylist(), pa.int64()), src, dst, list(codes)


def _closing_in_order(batches):
    """(seq) of edges (seq, src, dst) of one task that close a cycle."""
    seq, src, dst, names = _held(batches)
    yield pa.RecordBatch.from_arrays([seq.filter(pa.array(cycles.closing(src, dst, len(names))))], names=["seq"])


def _versions_in_order(batches):
    """(seq, child, nc, parent, np) of edges (seq, src, dst) of one task: the versions an edge leads between."""
    seq, src, dst, names = _held(batches)
    closes = cycles.closing(src, dst, len(names))
    now = [0] * len(names)
    nc, np_ = np.zeros(len(src), np.int64), np.zeros(len(src), np.int64)
    for i, (c, p, new) in enumerate(zip(memoryview(src), memoryview(dst), memoryview(closes), strict=True)):
        if new:
            now[c] += 1
        nc[i], np_[i] = now[c], now[p]
    nc[src == dst] -= 1  # a self-loop leads from the old version to the new
    names = pa.array(names, pa.string())
    for i in range(0, len(src), 100_000):
        one = slice(i, i + 100_000)
        yield pa.RecordBatch.from_arrays([seq[one], names.take(pa.array(src[one])), pa.array(nc[one]), names.take(pa.array(dst[one])), pa.array(np_[one])], names=["seq", "child", "nc", "parent", "np"])


def closes_cycle(rows: DataFrame, rounds: int = 64, in_order: int = IN_ORDER) -> DataFrame:
    """(seq): the edges whose parent reached their child over earlier edges (self-loops included); they get a new version of the child.

    At most ``in_order`` edges, counted, are gone through in order by one task. Of more, only edges on a cycle of the whole graph
    can be such, so vertices without edges in or out are trimmed away, round by round, until what is left is few enough; of a core of more than that
    the smallest possible latest edge of a walk between two vertices is found by doubling, for all pairs.
    """
    e = stored(rows.where(is_edge()).select("seq", F.col("child").alias("src"), F.col("parent").alias("dst")))
    n = e.count()
    if n <= in_order:
        return e.coalesce(1).mapInArrow(_closing_in_order, "seq bigint")
    core = e.where("src <> dst")
    while True:
        core = stored(core.join(core.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").join(core.select(F.col("dst").alias("src")).distinct(), "src", "left_semi"))
        now = core.count()
        if now <= in_order:
            return core.select("seq", "src", "dst").coalesce(1).mapInArrow(_closing_in_order, "seq bigint").union(e.where("src = dst").select("seq"))
        if now == n:
            break
        n = now
    walk = stored(core.groupBy("src", "dst").agg(F.min("seq").alias("b")))
    for _ in range(rounds):
        far = walk.select("src", F.col("dst").alias("m"), "b").join(walk.select(F.col("src").alias("m"), "dst", F.col("b").alias("b2")), "m").select("src", "dst", F.greatest("b", "b2").alias("b"))
        more = stored(walk.unionByName(far).groupBy("src", "dst").agg(F.min("b").alias("b")))
        if more.join(walk, ["src", "dst", "b"], "left_anti").isEmpty():
            break
        walk = more
    else:
        raise RuntimeError(f"walks of more than 2^{rounds} edges")
    back = walk.select(F.col("src").alias("dst"), F.col("dst").alias("src"), "b")
    hit = core.join(back, ["src", "dst"]).where("b < seq").select("seq")
    return hit.union(e.where("src = dst").select("seq")).distinct()


def _finesse_versions(e: DataFrame, in_order: int) -> DataFrame:
    """(seq, child, nc, parent, np): the versions of ends that ``graph_finesse`` leads each edge between."""
    e = e.select("seq", "child", "parent")
    if e.count() <= in_order:
        return e.where("seq is not null").select("seq", F.col("child").alias("src"), F.col("parent").alias("dst")).coalesce(1).mapInArrow(_versions_in_order, "seq bigint, child string, nc bigint, parent string, np bigint")
    closing = stored(closes_cycle(e.withColumn("kind", F.lit("edge")), in_order=in_order)).withColumn("__closes", F.lit(True))
    e = e.join(closing, "seq", "left").withColumn("__closes", F.coalesce("__closes", F.lit(False)))
    n = _counted_ends(e, F.col("__closes"))
    new = F.col("nc") + F.col("__closes").cast("int")
    loop = F.col("child").eqNullSafe(F.col("parent"))
    return n.select("seq", "child", F.when(loop, F.col("np")).otherwise(new).alias("nc"), "parent", F.when(loop, new).otherwise(F.col("np")).alias("np"))


def graph_finesse(rows: DataFrame, key: str = "version", initial: int = 0, vertices: DataFrame | None = None, in_order: int = IN_ORDER) -> DataFrame:
    """Edges with versions: an edge that would close a cycle gives its child a new version (a self-loop leads from the old version to the new).

    With ``vertices`` (id, annotations) edges, which must have both ends, need no annotations of them: every version is named once, and edges take its id.
    """
    e = stored(rows.where(is_edge()))
    n = _finesse_versions(e, in_order)
    at = lambda a, x: F.when(x > 0, t.put(F.coalesce(a, F.create_map().cast(MAP)), key, (x + initial).cast("string"))).otherwise(a)
    if vertices is None:
        e = e.join(n.select("seq", "nc", "np"), "seq")
        return _with_vertices(_edge_rows(e, at(F.col("ca"), F.col("nc")), at(F.col("pa"), F.col("np")), F.col("annotations")))
    n = stored(n)
    ends = n.select("seq", F.explode(F.array(F.struct(F.col("child").alias("v"), F.col("nc").alias("n")), F.struct(F.col("parent").alias("v"), F.col("np").alias("n")))).alias("x"))
    named = ends.groupBy("x.v", "x.n").agg(F.min("seq").alias("first"))
    named = named.join(vertices.select(F.col("id").alias("v"), "annotations").dropDuplicates(["v"]), "v", "left").withColumn("a", at(F.col("annotations"), F.col("n")))
    named = stored(named.select("v", "n", "first", "a", vertex_id(F.col("a")).alias("id")))
    end = lambda v, n_, i, a: named.select(F.col("v").alias(v), F.col("n").alias(n_), F.col("id").alias(i), F.col("a").alias(a))
    to = n.join(end("child", "nc", "__c", "__ca"), ["child", "nc"]).join(end("parent", "np", "__p", "__pa"), ["parent", "np"]).select("seq", "__c", "__p", "__ca", "__pa")
    d = e.select("seq", "source", "annotations", "event_time").join(to, "seq")
    made = d.select("seq", "source", F.lit("edge").alias("kind"), edge_id(F.col("__c"), F.col("__p"), F.col("annotations")).alias("id"), F.col("__c").alias("child"), F.col("__p").alias("parent"), "annotations", F.col("__ca").alias("ca"), F.col("__pa").alias("pa"), "event_time")
    first = named.groupBy("id").agg(F.min_by(F.struct(F.col("first").alias("seq"), "a"), "first").alias("y")).select(F.col("y.seq").alias("seq"), "id", F.col("y.a").alias("annotations"))
    none = F.lit(None)
    v = first.join(e.select("seq", "source", "event_time"), "seq").select("seq", "source", F.lit("vertex").alias("kind"), "id", none.cast("string").alias("child"), none.cast("string").alias("parent"), "annotations", none.cast(MAP).alias("ca"), none.cast(MAP).alias("pa"), "event_time")
    return made.unionByName(v)


def cross_namespaces(rows: DataFrame, artifact_keys: list[str], process_keys: list[str]) -> DataFrame:
    """(seq, artifact, reader, writer): reads of an artifact that a process of other namespaces wrote before. Artifacts and processes are told by those of the given annotations they have."""
    named = lambda a, keys: t.java_list(F.transform(F.array_sort(F.map_entries(F.map_filter(F.col(a), lambda k, v: k.isin(keys) & v.isNotNull()))), lambda x: F.concat(x["key"], F.lit("="), x["value"])))
    w = rows.where(is_edge() & of_type("annotations", "WasGeneratedBy")).select("seq", named("ca", artifact_keys).alias("artifact"), named("pa", process_keys).alias("writer"))
    r = rows.where(is_edge() & of_type("annotations", "Used")).select("seq", named("pa", artifact_keys).alias("artifact"), named("ca", process_keys).alias("reader"))
    firsts = w.where("artifact <> '[]' and writer <> '[]'").groupBy("artifact", "writer").agg(F.min("seq").alias("at"))
    return r.where("artifact <> '[]' and reader <> '[]'").join(firsts, "artifact").where("writer <> reader and at < seq").select("seq", "artifact", "reader", "writer")


def nearest_in_time(left: DataFrame, right: DataFrame, key: str, at: str, window: float) -> DataFrame:
    """Pairs (l_id, r_id) of rows with the same ``key`` and times within [-window/2, window/2), each row in at most one pair.

    Time is cut into cells of half a window, so a row meets its own cell and the two beside it. Pairs are taken greedily by
    distance, then ids: a pair goes if it is the best of both its rows; rounds repeat over what is left.
    """
    half = window / 2
    cell = F.floor(F.col(at) / half)
    a = left.select(F.col("id").alias("l_id"), F.col(key).alias("k"), F.col(at).alias("l_at"), cell.alias("cell"))
    b = right.select(F.col("id").alias("r_id"), F.col(key).alias("k"), F.col(at).alias("r_at"), F.explode(F.array(cell - 1, cell, cell + 1)).alias("cell"))
    d = F.col("r_at") - F.col("l_at")
    pairs = stored(a.join(b, ["k", "cell"]).where((d >= -half) & (d < half)).select("l_id", "r_id", F.abs(d).alias("d")))
    taken: Pile | None = None
    while not pairs.isEmpty():
        best = lambda own, other: pairs.groupBy(own).agg(F.min(F.struct("d", other)).alias("b")).select(own, F.col(f"b.{other}").alias(other))  # noqa: B023, E731
        go = stored(best("l_id", "r_id").join(best("r_id", "l_id"), ["l_id", "r_id"]))
        if taken is None:
            taken = Pile(go)
        else:
            taken.add(go)
        pairs = stored(pairs.join(go.select("l_id"), "l_id", "left_anti").join(go.select("r_id"), "r_id", "left_anti"))
    return taken.read() if taken else pairs.select("l_id", "r_id")


def clam_prov(rows: DataFrame, calls: DataFrame, window: float, key: str = "pid") -> DataFrame:
    """Edges with the annotations of the call site nearest in time of the same process: ``calls(id, key, at, annotations)``."""
    e = rows.where(is_edge()).withColumn("at", F.col("annotations")["time"].try_cast("double")).withColumn("k", F.coalesce(F.col("ca")[key], F.col("pa")[key]))
    both = nearest_in_time(e.where("at is not null and k is not null").select("id", F.col("k").alias("key"), "at"), calls.select("id", F.col("key"), "at"), "key", "at", window)
    more = both.join(calls.select(F.col("id").alias("r_id"), F.col("annotations").alias("site")), "r_id").select(F.col("l_id").alias("id"), "site")
    e = e.join(more, "id", "left")
    whole = F.when(F.col("site").isNull(), F.col("annotations")).otherwise(F.map_concat(F.map_filter("annotations", lambda k, v: ~F.array_contains(F.map_keys("site"), k)), F.col("site")))
    return e.withColumn("annotations", whole).select(*rows.columns).unionByName(rows.where(~is_edge()))


def fusion(rows: DataFrame, first: str, second: str, key: str, reach: int = 5) -> DataFrame:
    """(l_id, r_id): vertices of two sources that agree in ``key`` without regard to case and lie within ``reach`` places of each other in the two sequences; each vertex is in at most one pair.

    A pair is a fused vertex. Places count the vertices of a source with the annotation.
    """
    v = rows.where(~is_edge() & F.col("annotations")[key].isNotNull()).withColumn("k", F.lower(F.col("annotations")[key]))
    place = lambda s: count_before(v.where(F.lower("source") == s.lower()), ["source"], "seq", F.lit(True), "at").select("id", "k", F.col("at").cast("double").alias("at"))
    return nearest_in_time(place(first), place(second), "k", "at", 2 * reach + 1)


def attribute_label(rows: DataFrame, malicious: list[str], name: str = "name", label: str = "label", bad: str = "malicious", good: str = "benign") -> DataFrame:
    """(id, label): processes by name, and the children of malicious ones, over any number of steps in the order of edges.

    A taint passes an edge only if it is later than the edge that tainted the parent: the earliest time each vertex is tainted is found round by round.
    """
    v = rows.where(~is_edge() & of_type("annotations", "Process") & F.col("annotations")[name].isNotNull()).groupBy("id").agg(F.max(F.col("annotations")[name].isin(malicious).cast("int")).alias("m"))
    e = stored(rows.where(is_edge()).select("seq", "child", "parent"))
    front = stored(v.where("m = 1").select("id", F.lit(-1).cast("bigint").alias("at")))
    known = front
    while not front.isEmpty():
        reach = e.join(front.withColumnRenamed("id", "parent"), "parent").where("seq > at").groupBy(F.col("child").alias("id")).agg(F.min("seq").alias("at"))
        better = reach.join(known.withColumnRenamed("at", "old"), "id", "left").where("old is null or at < old").select("id", "at")
        front = stored(better)
        known = stored(known.unionByName(front).groupBy("id").agg(F.min("at").alias("at")))
    tainted = known.select("id", F.lit(bad).alias("label"))
    rest = v.select("id").join(known.select("id"), "id", "left_anti").select("id", F.lit(good).alias("label"))
    return tainted.unionByName(rest).withColumnRenamed("label", label)


def llvm_filter(rows: DataFrame, calls: DataFrame, functions: list[str]) -> DataFrame:
    """Processes of the functions from which a listed one can be reached over ``calls(caller, callee)``, and edges that touch only such; an artifact takes part in at most two edges."""
    seen = Pile(rows.sparkSession.createDataFrame([(f,) for f in functions], "f string"))
    front = seen.read()
    while not front.isEmpty():
        up = calls.join(front.select(F.col("f").alias("callee")), "callee", "left_semi").select(F.col("caller").alias("f")).distinct()
        front = seen.add(up.join(seen.read(), "f", "left_anti"))
    known = seen.read().distinct()
    fn = lambda d, a, tag: d.join(known.select(F.col("f").alias(tag)), F.col(a)["FunctionName"] == F.col(tag), "left")
    v = fn(rows.where(~is_edge() & of_type("annotations", "Process")), "annotations", "__f").where("__f is not null").select(*rows.columns)
    e = fn(fn(rows.where(is_edge()), "ca", "__c"), "pa", "__p")
    proc = F.when(of_type("annotations", "Used"), F.col("__c").isNotNull()).when(of_type("annotations", "WasGeneratedBy"), F.col("__p").isNotNull()).otherwise(F.col("__c").isNotNull() & F.col("__p").isNotNull())
    art = F.when(of_type("annotations", "Used"), F.col("pa")["ID"]).when(of_type("annotations", "WasGeneratedBy"), F.col("ca")["ID"])
    e = count_before(e.where(proc).withColumn("__a", F.coalesce(art, F.col("id"))), ["__a"], "seq", F.lit(True), "__n").where("__n < 2")
    return v.unionByName(e.select(*rows.columns))


def linux_threads(rows: DataFrame) -> DataFrame:
    """Adds an artifact for each thread group, which every process of it uses and generates."""
    p = deduplicate(rows.where(~is_edge() & (F.lower(F.col("annotations")["type"]) == "process")))
    group = F.create_map(F.lit("type"), F.lit("Artifact"), F.lit("location"), F.concat(F.lit("threadgroup:["), F.coalesce(F.col("annotations")["tgid"], F.lit("null")), F.lit("]")))
    d = p.select("seq", "source", "event_time", F.col("annotations").alias("ca"), group.alias("pa"))
    kind = lambda x: F.create_map(F.lit("type"), F.lit(x))
    uses = _edge_rows(d, F.col("ca"), F.col("pa"), kind("Used"))
    makes = _edge_rows(d, F.col("pa"), F.col("ca"), kind("WasGeneratedBy"))
    made = _with_vertices(uses.unionByName(makes)).where((F.col("kind") == "edge") | of_type("annotations", "Artifact"))
    return rows.unionByName(made.select(*rows.columns))


def android_threads(rows: DataFrame) -> DataFrame:
    """Threads merged into their group's leader: annotations of all, several values joined by commas, the leader's own pid kept and the threads' in ``tpids``; edges lead to leaders, a missing one gets a bare vertex."""
    p = rows.where(~is_edge() & of_type("annotations", "Process") & F.col("annotations")["tgid"].isNotNull())
    tgid = F.col("annotations")["tgid"]
    each = p.select(tgid.alias("g"), F.explode("annotations").alias("k", "v")).where("k not in ('tgid', 'type')").distinct()
    named = each.withColumn("k", F.when((F.col("k") == "pid") & (F.col("v") != F.col("g")), "tpids").otherwise(F.col("k")))
    per = named.groupBy("g", "k").agg(F.array_join(F.array_sort(F.collect_set("v")), ",").alias("v"))
    whole = per.groupBy("g").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("m"))
    whole = whole.select("g", F.map_concat(F.map_filter("m", lambda k, v: k != "pid"), F.create_map(F.lit("type"), F.lit("Process"), F.lit("tgid"), F.col("g"), F.lit("pid"), F.col("g"))).alias("m"))
    at = lambda a: F.when(F.col(a)["type"] == "Process", F.col(a)["tgid"])
    e = rows.where(is_edge()).withColumn("cg", at("ca")).withColumn("pg", at("pa"))
    e = e.join(whole.select(F.col("g").alias("cg"), F.col("m").alias("cm")), "cg", "left").join(whole.select(F.col("g").alias("pg"), F.col("m").alias("pm")), "pg", "left")
    return _with_vertices(_edge_rows(e, F.coalesce("cm", "ca"), F.coalesce("pm", "pa"), F.col("annotations")))


def process_features(rows: DataFrame, beginning: float = 1.0) -> DataFrame:
    """One row of features per process: counts, average time between events, distinct files, extensions and hosts, bytes, and the share of activity within ``beginning`` seconds of the first event."""
    used, made = of_type("annotations", "Used"), of_type("annotations", "WasGeneratedBy")
    e = rows.where(is_edge() & (used | made)).withColumn("p", F.when(used, F.col("child")).otherwise(F.col("parent"))).withColumn("a", F.when(used, F.col("pa")).otherwise(F.col("ca")))
    e = e.select("p", "seq", used.alias("read"), F.col("annotations")["time"].try_cast("double").alias("time"), F.coalesce(F.col("annotations")["size"].try_cast("double"), F.lit(0.0)).alias("size"), F.col("a")["path"].alias("path"), F.col("a")["remote address"].alias("host"))
    first = e.groupBy(F.col("p").alias("p0")).agg(F.min("time").alias("t0"))
    e = e.join(first, F.col("p") == F.col("p0"))
    e = last_before(e, ["p"], "seq", {"last_read": F.when(F.col("read"), F.col("time")), "last_write": F.when(~F.col("read"), F.col("time"))})
    ext = F.nullif(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1), F.lit(""))
    early = F.col("time") <= F.col("t0") + beginning
    return e.groupBy(F.col("p").alias("id")).agg(
        F.count_if("read").alias("n_reads"),
        F.count_if(~F.col("read")).alias("n_writes"),
        F.avg(F.when(F.col("read"), F.col("time") - F.col("last_read"))).alias("avg_between_reads"),
        F.avg(F.when(~F.col("read"), F.col("time") - F.col("last_write"))).alias("avg_between_writes"),
        F.count_distinct("path").alias("n_files"),
        F.count_distinct(ext).alias("n_extensions"),
        F.count_distinct("host").alias("n_hosts"),
        F.sum(F.when(F.col("read"), F.col("size")).otherwise(0.0)).alias("bytes_read"),
        F.sum(F.when(~F.col("read"), F.col("size")).otherwise(0.0)).alias("bytes_written"),
        F.count_if(early).alias("n_beginning"),
        F.count_distinct(F.when(early, F.col("path"))).alias("n_files_beginning"),
        F.min("time").alias("first_time"),
        F.max("time").alias("last_time"),
    )


def artifact_features(rows: DataFrame) -> DataFrame:
    """One row per artifact: reads, writes, and the processes of each."""
    used, made = of_type("annotations", "Used"), of_type("annotations", "WasGeneratedBy")
    e = rows.where(is_edge() & (used | made)).select(F.when(used, F.col("parent")).otherwise(F.col("child")).alias("id"), F.when(used, F.col("child")).otherwise(F.col("parent")).alias("p"), used.alias("read"))
    return e.groupBy("id").agg(F.count_if("read").alias("n_reads"), F.count_if(~F.col("read")).alias("n_writes"), F.count_distinct(F.when(F.col("read"), F.col("p"))).alias("n_readers"), F.count_distinct(F.when(~F.col("read"), F.col("p"))).alias("n_writers"))


#: Extensions of files of interest, and of programs, where no others are given.
SENSITIVE = ("doc", "docx", "pdf", "xls", "xlsx", "txt", "csv")
EXECUTABLE = ("exe", "dll", "bin", "sh")
#: What is counted of a flow, and of these what is counted for its beginning too.
FLOW_COUNTS = ("events", "length", "file_events", "sensitive_events", "registry_events", "network_events")
FLOW_ITEMS = ("files", "directories", "extensions")


def process_profile(rows: DataFrame, beginning: float = 1.0, sensitive: tuple[str, ...] = SENSITIVE, executable: tuple[str, ...] = EXECUTABLE) -> DataFrame:
    """One row of features for every process that reads, writes, or starts or is started by another.

    For reads (``used_``) and writes (``made_``): FLOW_COUNTS and distinct FLOW_ITEMS, each also within ``beginning`` seconds of the
    process's first flow (``_beginning``), the average time between events and spent in them. Besides: life time, processes and threads started,
    distinct names of those started, whether it was started here, registry settings, whether it started a program it had written, user, name, command line, pid and ppid.

    Distinct items are counted by grouping twice, so no list of them is held and no row is copied for each count. Edges and flows are
    read by several parts of this, so they are written out first.
    A file is an artifact with a path, unless its class is Registry; a network artifact has a remote address.
    """
    rows = stored(rows.where(is_edge()))
    used, made = of_type("annotations", "Used"), of_type("annotations", "WasGeneratedBy")
    number = lambda a: F.col("annotations")[a].try_cast("double")
    flows = rows.where(is_edge() & (used | made)).withColumn("p", F.when(used, F.col("child")).otherwise(F.col("parent"))).withColumn("a", F.when(used, F.col("pa")).otherwise(F.col("ca")))
    registry = F.coalesce(F.lower(F.col("a")["class"]) == "registry", F.lit(False))
    flows = flows.select("p", "seq", used.alias("read"), number("time").alias("time"), F.coalesce(number("size"), F.lit(0.0)).alias("length"), F.coalesce(number("duration"), F.lit(0.0)).alias("spent"), F.col("annotations")["operation"].alias("operation"), registry.alias("registry"), F.when(~registry, F.col("a")["path"]).alias("path"), (~registry & F.col("a")["path"].isNull() & F.col("a")["remote address"].isNotNull()).alias("network"))
    first = flows.groupBy(F.col("p").alias("p0")).agg(F.min("time").alias("t0"))
    flows = flows.join(first, F.col("p") == F.col("p0"))
    flows = last_before(flows, ["p"], "seq", {"last_read": F.when(F.col("read"), F.col("time")), "last_made": F.when(~F.col("read"), F.col("time"))})
    flows = flows.withColumn("early", F.coalesce(F.col("time") <= F.col("t0") + beginning, F.lit(False)))
    ext = F.nullif(F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)), F.lit(""))
    flows = flows.withColumns({"extensions": ext, "files": F.col("path"), "directories": F.regexp_extract("path", r"^(.*)/[^/]*$", 1)})
    flows = stored(flows)
    one = {
        "events": F.lit(1.0),
        "length": F.col("length"),
        "file_events": F.col("path").isNotNull().cast("double"),
        "sensitive_events": F.coalesce(ext.isin(*sensitive), F.lit(False)).cast("double"),
        "registry_events": F.col("registry").cast("double"),
        "network_events": F.col("network").cast("double"),
    }
    sums = []
    for name, test in (("used", F.col("read")), ("made", ~F.col("read"))):
        for k, x in one.items():
            sums.append(F.sum(F.when(test, x).otherwise(0.0)).alias(f"{name}_{k}"))
            sums.append(F.sum(F.when(test & F.col("early"), x).otherwise(0.0)).alias(f"{name}_{k}_beginning"))
        sums.append(F.avg(F.when(test, F.col("time") - F.col("last_read" if name == "used" else "last_made"))).alias(f"{name}_between"))
        sums.append(F.avg(F.when(test, F.col("spent"))).alias(f"{name}_spent"))
    sums += [F.count_if(~F.col("read") & F.col("registry") & (F.col("operation") == op)).alias(n) for n, op in (("registry_set_info", "RegSetInfoKey"), ("registry_set_value", "RegSetValue"))]
    out = flows.groupBy("p").agg(*sums)
    for item in FLOW_ITEMS:
        each = flows.where(F.col(item).isNotNull()).groupBy("p", "read", item).agg(F.max("early").alias("early"))
        per = each.groupBy(F.col("p").alias("q")).agg(*[F.count_if(t_ & e).alias(f"{n}_{item}{tail}") for n, t_ in (("used", F.col("read")), ("made", ~F.col("read"))) for tail, e in (("", F.lit(True)), ("_beginning", F.col("early")))])
        out = out.join(per, F.col("p") == F.col("q"), "left").drop("q")
    starts = rows.where(is_edge() & of_type("annotations", "WasTriggeredBy")).select(F.col("parent").alias("p"), F.col("child").alias("c"), F.coalesce(F.col("ca")["pid"] == F.col("pa")["pid"], F.lit(False)).alias("thread"), F.col("ca")["name"].alias("name"), F.col("ca")["path"].alias("path"))
    started = starts.groupBy(F.col("p").alias("q")).agg(F.count_if(~F.col("thread")).cast("double").alias("started"), F.count_if("thread").cast("double").alias("threads"))
    names = starts.where(~F.col("thread") & F.col("name").isNotNull()).groupBy("p", "name").agg(F.lit(1).alias("n")).groupBy(F.col("p").alias("q")).agg(F.count("*").alias("started_names"))
    wrote = flows.where(~F.col("read") & ext.isin(*executable)).select(F.col("p").alias("wp"), F.col("path").alias("wpath")).distinct()
    runs = starts.join(wrote, (F.col("p") == F.col("wp")) & (F.col("path") == F.col("wpath"))).select(F.col("p").alias("q")).distinct().withColumn("writes_then_executes", F.lit(True))
    new = starts.select(F.col("c").alias("q")).distinct().withColumn("is_new", F.lit(True))
    every = out.select("p").union(starts.select("p")).union(starts.select("c")).distinct().withColumnRenamed("p", "id")
    ends = F.explode(F.array(F.struct(F.col("child").alias("q"), F.col("ca").alias("a")), F.struct(F.col("parent").alias("q"), F.col("pa").alias("a")))).alias("x")
    life = rows.where(is_edge()).select(number("time").alias("time"), ends).where(F.col("x.a")["type"] == "Process").groupBy(F.col("x.q").alias("q")).agg((F.max("time") - F.min("time")).alias("life"))
    agent = F.coalesce(F.col("pa")["name"], F.col("pa")["uid"])
    user = rows.where(is_edge() & of_type("annotations", "WasControlledBy")).groupBy(F.col("child").alias("q")).agg(F.max_by(agent, F.when(agent.isNotNull(), F.col("seq"))).alias("user"))
    who = rows.where(is_edge()).select(ends).select("x.q", *[F.col("x.a")[k].alias(k.replace(" ", "_")) for k in ("name", "command line", "pid", "ppid")]).groupBy("q").agg(*[F.max(k).alias(k) for k in ("name", "command_line", "pid", "ppid")])
    got = every.join(out, F.col("id") == F.col("p"), "left").drop("p")
    for more in (started, names, runs, new, life, user, who):
        got = got.join(more, F.col("id") == F.col("q"), "left").drop("q")
    zero = [c for c in got.columns if c not in ("id", "used_between", "made_between", "used_spent", "made_spent", "life", "user", "name", "command_line", "pid", "ppid", "is_new", "writes_then_executes")]
    return got.na.fill(0, zero).na.fill(False, ["is_new", "writes_then_executes"])


def fuse(rows: DataFrame, first: str, second: str, key: str, reach: int = 5) -> DataFrame:
    """The stream with every pair of ``fusion`` as one vertex, which has the annotations of both, the second's where they differ, and ``source_reporter`` fused; edges lead to it.

    A fused vertex comes where the later of its two stood. Other elements stay as they are, edges at no fused vertex included.
    """
    pairs = stored(fusion(rows, first, second, key, reach))
    v = rows.where(~is_edge())
    both = pairs.join(v.select(F.col("id").alias("l_id"), F.col("annotations").alias("la"), F.col("seq").alias("ls")), "l_id").join(v.select(F.col("id").alias("r_id"), F.col("annotations").alias("ra"), F.col("seq").alias("rs"), "source", "event_time"), "r_id")
    whole = F.map_concat(F.map_filter("la", lambda k, x: ~F.array_contains(F.map_keys("ra"), k) & (k != "source_reporter")), F.map_filter("ra", lambda k, x: k != "source_reporter"), F.create_map(F.lit("source_reporter"), F.lit("fused")))
    both = stored(both.select("l_id", "r_id", F.greatest("ls", "rs").alias("seq"), "source", whole.alias("annotations"), "event_time"))
    names = both.select(F.explode(F.array("l_id", "r_id")).alias("old"), F.col("annotations").alias("new"))
    none = F.lit(None)
    made = both.select("seq", "source", F.lit("vertex").alias("kind"), vertex_id(F.col("annotations")).alias("id"), none.cast("string").alias("child"), none.cast("string").alias("parent"), "annotations", none.cast(MAP).alias("ca"), none.cast(MAP).alias("pa"), "event_time")
    rest = v.join(names.select(F.col("old").alias("id")), "id", "left_anti").select(*COLUMNS)
    e = rows.where(is_edge())
    for c, a in (("child", "ca"), ("parent", "pa")):
        e = e.join(names.select(F.col("old").alias(c), F.col("new").alias(f"__{a}")), c, "left")
    moved = F.col("__ca").isNotNull() | F.col("__pa").isNotNull()
    new_c, new_p = (F.when(F.col(f"__{a}").isNotNull(), vertex_id(F.col(f"__{a}"))).otherwise(F.col(c)) for c, a in (("child", "ca"), ("parent", "pa")))
    e = e.withColumns({"__c": new_c, "__p": new_p})
    e = e.withColumn("id", F.when(moved, edge_id(F.col("__c"), F.col("__p"), F.col("annotations"))).otherwise(F.col("id")))
    e = e.select("seq", "source", "kind", "id", F.col("__c").alias("child"), F.col("__p").alias("parent"), "annotations", F.coalesce("__ca", "ca").alias("ca"), F.coalesce("__pa", "pa").alias("pa"), "event_time")
    return rest.unionByName(made).unionByName(e)
