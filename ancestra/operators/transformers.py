"""Graph-to-graph transformations.

A transformation sees a graph's edges flat, each with the annotations of both
ends, as one DataFrame (id, ea, child, ca, parent, pa); isolated vertices aren't
seen and vanish. What it gives back is hashed by content, so elements whose
annotations have become the same merge, and is added to the store.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ancestra.functions.identity import edge_id, vertex_id
from ancestra.operators.graph import Graph, Store
from ancestra.session import Pile, stored

MAP = "map<string,string>"
#: Identity keys that never belong to content, vocabularies and operations.
IDENTITY_KEYS = ("hash", "childVertexHash", "parentVertexHash")
VERTEX_TYPES = {"Agent": "Agent", "Process": "Activity", "Artifact": "Entity"}
EDGE_TYPES = {"Used": "Used", "WasControlledBy": "WasAssociatedWith", "WasDerivedFrom": "WasDerivedFrom", "WasGeneratedBy": "WasGeneratedBy", "WasTriggeredBy": "WasInformedBy"}
LINKING = ("mmap", "rename", "link")
NULL_TEXT = "NULL"


def flat(g: Graph) -> DataFrame:
    """The edges of ``g`` with the annotations of both ends; an end that is no vertex of the store has none."""
    none = F.create_map().cast(MAP)
    v = g.store.vertices
    e = g.edge_rows.select("id", F.coalesce("annotations", none).alias("ea"), "child", "parent")
    e = e.join(v.select(F.col("id").alias("child"), F.col("annotations").alias("ca")), "child", "left")
    e = e.join(v.select(F.col("id").alias("parent"), F.col("annotations").alias("pa")), "parent", "left")
    return e.select("id", "ea", "child", F.coalesce("ca", none).alias("ca"), "parent", F.coalesce("pa", none).alias("pa"))


def rebuild(rows: DataFrame, g: Graph) -> Graph:
    """The graph of flat rows, hashed by content, over the store with the new elements. Ends without annotations keep their ids."""
    own = lambda a, old: F.when(F.size(a) > 0, vertex_id(a)).otherwise(F.col(old))
    made = rows.select("ea", own(F.col("ca"), "child").alias("child"), "ca", own(F.col("pa"), "parent").alias("parent"), "pa")
    made = stored(made.withColumn("id", edge_id(F.col("child"), F.col("parent"), F.col("ea"))))
    v = made.select(F.col("child").alias("id"), F.col("ca").alias("annotations")).unionByName(made.select(F.col("parent").alias("id"), F.col("pa").alias("annotations")))
    v = v.dropDuplicates(["id"]).withColumn("ref", F.lit(False))
    e = made.select("id", "child", "parent", F.col("ea").alias("annotations"), F.lit(False).alias("ref")).dropDuplicates(["id"])
    store = Store(g.store.vertices.unionByName(v).dropDuplicates(["id"]), g.store.edges.unionByName(e).dropDuplicates(["id"]))
    return Graph(store, v.select("id"), e.select("id"), remotes=g.remotes)


def strip(rows: DataFrame, *keys: str) -> DataFrame:
    """Without ``keys`` and identity keys on edges and both ends."""
    gone = [*keys, *IDENTITY_KEYS]
    return rows.select("id", *[F.map_filter(c, lambda k, v: ~k.isin(gone)).alias(c) if c in ("ea", "ca", "pa") else F.col(c) for c in rows.columns if c != "id"])


def put(a: Column, key: str, value: Column) -> Column:
    """``a`` with ``key`` set to ``value``."""
    return F.map_concat(F.map_filter(a, lambda k, v: k != key), F.create_map(F.lit(key), value))


def is_file(a: Column) -> Column:
    return F.coalesce((a["type"] == "Artifact") & a["path"].isNotNull(), F.lit(False))


def has_part(op: Column, *names: str) -> Column:
    """Whether an operation such as ``mmap (read)`` has one of ``names`` as its main or its second part."""
    parts = F.transform(F.split(F.regexp_replace(op, r"\)", ""), r"\("), lambda x: F.trim(x))
    return F.coalesce((F.size(parts) <= 2) & F.arrays_overlap(parts, F.array(*map(F.lit, names))), F.lit(False))


def _op() -> Column:
    return F.col("ea")["operation"]


def _keep(test: Column) -> Column:
    return ~F.coalesce(test, F.lit(False))


def last_name(rows: DataFrame) -> DataFrame:
    plain = F.coalesce(_op().isin(*LINKING), F.lit(False))
    return strip(rows.where(~plain & ~(has_part(_op(), *LINKING) & has_part(_op(), "read"))))


def merge_io(rows: DataFrame) -> DataFrame:
    return strip(rows, "time", "size")


def no_memory(rows: DataFrame) -> DataFrame:
    return strip(rows.where(_keep(F.col("ca")["subtype"] == "memory") & _keep(F.col("pa")["subtype"] == "memory")))


def no_units(rows: DataFrame) -> DataFrame:
    return strip(rows.where(_keep(_op() == "unit")), "unit")


def no_versions(rows: DataFrame) -> DataFrame:
    return strip(rows.where(_keep(_op() == "update")), "version")


def drop_keys(rows: DataFrame, *keys: str) -> DataFrame:
    return strip(rows, *keys)


def _source_paths(source: Graph | None) -> DataFrame | None:
    return None if source is None else source.vertex_rows.select(F.col("annotations")["path"].alias("__path")).where("__path is not null").distinct()


def blacklist(rows: DataFrame, pattern: str, source: Graph | None = None) -> DataFrame:
    """Without edges that have an end whose path matches ``pattern`` and isn't a path of the source graph."""
    rows = strip(rows)
    paths = _source_paths(source)
    for a in ("ca", "pa"):
        bad = F.coalesce(F.col(a)["path"].rlike(pattern), F.lit(False))
        if paths is None:
            rows = rows.where(~bad)
        else:
            known = rows.join(paths, F.col(a)["path"] == F.col("__path"), "left")
            rows = known.where(~bad | F.col("__path").isNotNull()).drop("__path")
    return rows


def _lonely(rows: DataFrame, file: str, other: str, reading: bool) -> DataFrame:
    """(f, n, pid): how many processes write, or read, each file, and one of their pids."""
    op = has_part(_op(), "read", "recv") if reading else has_part(_op(), "write", "send")
    near = rows.where(op & (is_file(F.col("ca")) | is_file(F.col("pa"))))
    pid = F.coalesce(F.col(f"{other[0]}a")["pid"], F.lit(""))
    return near.select(F.col(file).alias("f"), pid.alias("pid")).groupBy("f").agg(F.min("pid").alias("p0"), F.max("pid").alias("p1"))


def no_ephemeral_reads(rows: DataFrame, ignore: str | None = None, source: Graph | None = None) -> DataFrame:
    """Without reads of files that nobody, or only the reading process, wrote. ``ignore`` limits this to paths it matches; files of the source graph stay."""
    rows = strip(rows)
    written = _lonely(rows, "child", "parent", reading=False)
    read = is_file(F.col("pa")) & has_part(_op(), "read", "recv")
    if ignore is not None:
        read = read & F.coalesce(F.col("pa")["path"].rlike(ignore), F.lit(False))
    near = rows.join(written, F.col("parent") == F.col("f"), "left")
    own = F.coalesce(F.col("ca")["pid"], F.lit(""))
    alone = F.col("f").isNull() | ((F.col("p0") == F.col("p1")) & (F.col("p0") == own))
    paths = _source_paths(source)
    if paths is not None:
        near = near.join(paths, F.col("pa")["path"] == F.col("__path"), "left")
        read = read & F.col("__path").isNull()
    return near.where(~(read & alone)).select(*rows.columns)


def no_ephemeral_writes(rows: DataFrame) -> DataFrame:
    """Without writes of files that nobody, or only the writing process, reads."""
    rows = strip(rows)
    seen = _lonely(rows, "parent", "child", reading=True)
    near = rows.join(seen, F.col("child") == F.col("f"), "left")
    own = F.coalesce(F.col("pa")["pid"], F.lit(""))
    alone = F.col("f").isNull() | ((F.col("p0") == F.col("p1")) & (F.col("p0") == own))
    return near.where(~(is_file(F.col("ca")) & has_part(_op(), "write", "send") & alone)).select(*rows.columns)


def only_addresses(rows: DataFrame) -> DataFrame:
    """Address to address, for every transaction that pays from the one to the other."""
    kind = F.col("ea")["type"]
    owner = rows.where(kind == "WasAttributedTo").groupBy(F.col("child").alias("pay")).agg(F.min(F.struct(F.col("parent").alias("id"), F.map_entries("pa").alias("a"))).alias("o"))
    owner = owner.select("pay", F.col("o.id").alias("address"), F.map_from_entries("o.a").alias("a"))
    paid = rows.where(kind == "Used").select(F.col("child").alias("tx"), F.col("parent").alias("pay")).distinct()
    got = rows.where(kind == "WasGeneratedBy").select(F.col("parent").alias("tx"), F.col("child").alias("pay"), F.col("ea")["transactionValue"].alias("value")).distinct()
    src = paid.join(owner, "pay").select("tx", F.col("address").alias("parent"), F.col("a").alias("pa")).dropDuplicates(["tx", "parent"])
    dst = got.join(owner, "pay").select("tx", "value", F.col("address").alias("child"), F.col("a").alias("ca"))
    both = dst.join(src, "tx")
    base = F.create_map(F.lit("type"), F.lit("ActedOnBehalfOf"))
    ea = F.when(F.col("value").isNull(), base).otherwise(F.map_concat(base, F.create_map(F.lit("transactionValue"), F.col("value"))))
    return both.select(F.lit("").alias("id"), ea.alias("ea"), "child", "ca", "parent", "pa")


def _contracted(steps: DataFrame, rounds: int = 32) -> DataFrame:
    """(k, node): vertices of ``steps(src, dst)`` that walks lead to each other, with the one that stands for them.

    Each vertex takes the largest number that a walk brings to it; who has a walk back to that
    number's own vertex is in its component. Large components come out whole if the hubs have the large numbers. A component
    that is missed, or cut at ``rounds``, only costs the caller time: what is merged does belong together.
    """
    inner = steps.select(F.col("src").alias("k")).distinct().join(steps.select(F.col("dst").alias("k")).distinct(), "k")
    core = stored(steps.join(inner.select(F.col("k").alias("src")), "src", "left_semi").join(inner.select(F.col("k").alias("dst")), "dst", "left_semi"))
    colour = stored(inner.select("k", F.col("k").alias("node")))
    front = colour
    for _ in range(rounds):
        told = core.join(front.select(F.col("k").alias("src"), "node"), "src").groupBy(F.col("dst").alias("k")).agg(F.max("node").alias("told"))
        both = stored(colour.join(told, "k", "left").select("k", F.greatest("node", "told").alias("node"), F.coalesce(F.col("told") > F.col("node"), F.lit(False)).alias("new")))
        colour, front = both.select("k", "node"), both.where("new").select("k", "node")
        if front.isEmpty():
            break
    same = core.join(colour.select(F.col("k").alias("src"), "node"), "src").join(colour.select(F.col("k").alias("dst"), F.col("node").alias("n2")), "dst").where("node = n2")
    same = stored(same.select("src", "dst", "node"))
    back = Pile(colour.where("k = node"))
    front = back.read()
    for _ in range(rounds):
        hop = same.join(front.select(F.col("k").alias("dst")), "dst").select(F.col("src").alias("k"), "node").distinct()
        front = back.add(hop.join(back.read().select("k"), "k", "left_anti"))
        if front.isEmpty():
            break
    return back.read()


def only_agents(rows: DataFrame) -> DataFrame:
    """Agent to agent, wherever a walk leads from a vertex of the one to another vertex of the other.

    No pairs of vertices are made: components are contracted, and each node collects the agents it can reach,
    each with the first and the last of that agent's vertices. These two tell whether a walk on a cycle only leads back to where it began.
    """
    a_child = F.coalesce(F.col("ca")["type"] == "Agent", F.lit(False))
    a_parent = F.coalesce(F.col("pa")["type"] == "Agent", F.lit(False))
    who = F.when(a_child, F.col("ca")).when(a_parent, F.col("pa"))
    ends = stored(rows.select("child", "parent", F.when(a_child, F.col("parent")).otherwise(F.col("child")).alias("v"), who.alias("a")).withColumn("agent", F.when(F.col("a").isNotNull(), vertex_id(F.col("a")))))
    links = ends.select("child", "parent").where("child <> parent").distinct()
    into, out = links.groupBy(F.col("parent").alias("v")).agg(F.count("*").alias("i")), links.groupBy(F.col("child").alias("v")).agg(F.count("*").alias("o"))
    held = ends.where("agent is not null").select("v", "agent")
    every = into.join(out, "v", "full_outer").select("v", F.least(F.coalesce("i", F.lit(0)), F.coalesce("o", F.lit(0))).alias("n"))
    number = stored(every.orderBy("n", "v").select("v", F.monotonically_increasing_id().alias("k")))  # hubs last
    steps = links.join(number.select(F.col("v").alias("child"), F.col("k").alias("src")), "child").join(number.select(F.col("v").alias("parent"), F.col("k").alias("dst")), "parent")
    steps = stored(steps.select("src", "dst"))
    agents = stored(held.select("agent").distinct().select("agent", F.monotonically_increasing_id().alias("g")))
    node = _contracted(steps)

    def contract(df: DataFrame, c: str) -> DataFrame:
        return df.join(node.select(F.col("k").alias(c), "node"), c, "left").withColumn(c, F.coalesce("node", c)).drop("node")

    # a contracted node keeps its link to itself: its vertices reach each other
    steps = stored(contract(contract(steps, "src"), "dst").distinct())
    first, last = F.min("lo").alias("lo"), F.max("hi").alias("hi")
    direct = held.join(number, "v").join(agents, "agent").select("k", "g", F.col("k").alias("lo"), F.col("k").alias("hi"))
    direct = stored(contract(direct, "k").groupBy("k", "g").agg(first, last))
    reached: Pile | None = None
    front = direct
    while True:
        told = steps.join(front.select(F.col("k").alias("dst"), "g", "lo", "hi"), "dst").groupBy(F.col("src").alias("k"), "g").agg(first, last)
        if reached is None:
            reached = Pile(told)
            front = reached.read()
        else:
            known = reached.read().groupBy("k", "g").agg(F.min("lo").alias("lo0"), F.max("hi").alias("hi0"))
            front = reached.add(told.join(known, ["k", "g"], "left").where("lo0 is null or lo < lo0 or hi > hi0"))
        if front.isEmpty():
            break
    ahead = reached.read().groupBy("k", "g").agg(first, last).select("k", F.col("g").alias("h"), F.col("lo").alias("lo1"), F.col("hi").alias("hi1"))
    pairs = direct.join(ahead, "k").where("not (lo = hi and lo1 = hi1 and lo = lo1)").select("g", "h").distinct()
    names = ends.where("agent is not null").dropDuplicates(["agent"]).select("agent", "a").join(agents, "agent")
    src = names.select("g", F.col("agent").alias("child"), F.col("a").alias("ca"))
    dst = names.select(F.col("g").alias("h"), F.col("agent").alias("parent"), F.col("a").alias("pa"))
    made = pairs.join(src, "g").join(dst, "h")
    return made.select(F.lit("").alias("id"), F.create_map(F.lit("type"), F.lit("ActedOnBehalfOf")).alias("ea"), "child", "ca", "parent", "pa")


def prune(rows: DataFrame, g: Graph, source: Graph, depth: int, way: str) -> DataFrame:
    """Without the edges of the lineage of the source graph; a depth under 1 prunes nothing."""
    if depth < 1:
        return strip(rows)
    gone = g.get_lineage(source, depth, way).e
    return strip(rows.join(gone.select(F.col("id").alias("__g")), F.col("id") == F.col("__g"), "left_anti"))


def _typed(vertex: dict[str, str], edge: dict[str, str]) -> Callable[[DataFrame], DataFrame]:
    def run(rows: DataFrame) -> DataFrame:
        rows = strip(rows)
        for c, names in (("ea", edge), ("ca", vertex), ("pa", vertex)):
            table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
            kind = F.col(c)["type"]
            rows = rows.withColumn(c, F.when(kind.isNull(), F.col(c)).otherwise(put(F.col(c), "type", F.coalesce(table[kind], kind))))
        return rows

    return run


opm_to_prov = _typed(VERTEX_TYPES, EDGE_TYPES)
prov_to_opm = _typed({v: k for k, v in VERTEX_TYPES.items()}, {v: k for k, v in EDGE_TYPES.items()})


def rename_keys(rows: DataFrame, names: dict[str, str]) -> DataFrame:
    """Keys renamed; a renamed key replaces one that was there."""
    if not names:
        return rows
    for c in ("ea", "ca", "pa"):
        a = F.col(c)
        table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
        moved = F.map_filter(a, lambda k, v: k.isin(list(names)))
        kept = F.map_filter(a, lambda k, v: ~k.isin(list(names)))
        moved = F.transform_keys(moved, lambda k, v: table[k])
        rows = rows.withColumn(c, F.map_concat(_without(kept, moved), moved))
    return rows


def _without(a: Column, other: Column) -> Column:
    """``a`` without the keys of ``other``."""
    return F.map_filter(a, lambda k, v: ~F.array_contains(F.map_keys(other), k))


def opm_to_prov_tc(rows: DataFrame, names: dict[str, str]) -> DataFrame:
    return rename_keys(opm_to_prov(rows), names)


def prov_tc_to_opm(rows: DataFrame, names: dict[str, str]) -> DataFrame:
    return rename_keys(prov_to_opm(rows), names)


def simple_forks(rows: DataFrame) -> DataFrame:
    """A fork or clone and the first execve of its process become one edge, ``fork (execve)``, and the process one vertex.

    First is what has the smallest event id. Other edges of the process go to the fused vertex; its later execves stay.
    """
    rows = strip(rows)
    event = F.coalesce(F.col("ea")["event id"].try_cast("bigint"), F.lit(2**62))
    pid = F.col("ca")["pid"]
    kind = F.when(_op().isin("fork", "clone"), "fork").when(_op() == "execve", "execve")
    marked = rows.withColumn("kind", kind)
    mine = marked.where(F.col("kind").isNotNull() & pid.isNotNull())
    # a pid may hold most rows: its first event and id are found with partial results, then joined back by id
    first = mine.groupBy("kind", pid.alias("p")).agg(F.min(F.struct(event.alias("t"), "id")).alias("f"))
    firsts = mine.join(first.select(F.col("f.id").alias("__f")), F.col("id") == F.col("__f"), "left_semi")
    forks = firsts.where("kind = 'fork'").select(pid.alias("pid"), F.col("id").alias("fid"), F.col("ea").alias("fea"), F.col("child").alias("fc"), F.col("ca").alias("fca"), F.col("parent").alias("fp"), F.col("pa").alias("fpa"))
    execs = firsts.where("kind = 'execve'").select(pid.alias("xpid"), F.col("id").alias("xid"), F.col("child").alias("xc"), F.col("ca").alias("xca"))
    both = forks.join(execs, F.col("pid") == F.col("xpid"), "full")
    fused = both.select(F.coalesce("pid", "xpid").alias("pid"), F.coalesce("xc", "fc").alias("v"), F.coalesce("xca", "fca").alias("va"), "fid", "fea", "fp", "fpa", "xid")
    ea = F.when(F.col("xid").isNotNull(), put(F.col("fea"), "operation", F.concat(F.col("fea")["operation"], F.lit(" (execve)")))).otherwise(F.col("fea"))
    first = fused.where("fid is not null").select(F.col("fid").alias("id"), ea.alias("ea"), F.col("v").alias("child"), F.col("va").alias("ca"), F.col("fp").alias("parent"), F.col("fpa").alias("pa"))
    names = fused.select("pid", "v", "va")
    gone = firsts.where("kind = 'execve'").select(F.col("id").alias("__g"))
    rest = marked.where(F.coalesce(F.col("kind") != "fork", F.lit(True))).join(gone, F.col("id") == F.col("__g"), "left_anti").drop("kind")
    for c, a in (("child", "ca"), ("parent", "pa")):
        to = names.select(F.col("pid").alias("__pid"), F.col("v").alias("__v"), F.col("va").alias("__va"))
        rest = rest.join(to, F.col(a)["pid"] == F.col("__pid"), "left").withColumn(c, F.coalesce("__v", c)).withColumn(a, F.coalesce("__va", a)).drop("__pid", "__v", "__va")
    return first.unionByName(rest.select(*first.columns))


def java_list(items: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(items, ", "), F.lit("]"))


def aggregate_values(x: Column, how: str) -> Column:
    """The texts of a group as one, ordered by the number each denotes (0 if none) and itself: unique, list, minmax, sum or count; null if there are none.

    Only unique and list, whose result it is, hold all of a group's values.
    """
    number = F.coalesce(x.try_cast("double"), F.lit(0.0))
    pair = F.when(x.isNotNull(), F.struct(number.alias("n"), x.alias("t")))
    if how in ("unique", "list"):
        ordered = F.array_sort((F.collect_set if how == "unique" else F.collect_list)(pair))
        return F.when(F.size(ordered) > 0, java_list(F.transform(ordered, lambda p: p["t"])))
    if how == "minmax":
        return F.concat(F.lit("["), F.min(pair)["t"], F.lit(", "), F.max(pair)["t"], F.lit("]"))
    if how == "sum":
        total = F.sum(F.when(x.isNotNull(), number))
        return F.concat(F.lit("["), F.when(total == F.floor(total), total.try_cast("bigint").cast("string")).otherwise(total.cast("string")), F.lit("]"))
    if how == "count":
        return F.when(F.count(x) > 0, F.concat(F.lit("["), F.count(x).cast("string"), F.lit("]")))
    raise ValueError(how)


#: Fixed values: (annotation, new annotation, function) where no others are given.
AGGREGATIONS = [("time", "time range", "minmax"), ("size", "total size", "sum"), ("event id", "event ids", "list"), ("storageID", "storageIDs", "list"), ("unit", "unit count", "count"), ("version", "version count", "count")]


def aggregation(rows: DataFrame, rules: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """Elements that agree in all other annotations become one, whose aggregated annotations come under new names."""
    rules = rules or AGGREGATIONS
    keys = [k for k, _, _ in rules]
    bare = strip(rows, *keys).select("id", F.col("ea").alias("be"), F.col("ca").alias("bc"), F.col("pa").alias("bp"))
    near = rows.join(bare, "id")
    vid = lambda bare_map, old: F.when(F.size(bare_map) > 0, vertex_id(F.col(bare_map))).otherwise(F.col(old))
    near = near.withColumn("nc", vid("bc", "child")).withColumn("np", vid("bp", "parent"))
    near = stored(near.withColumn("ne", edge_id(F.col("nc"), F.col("np"), F.col("be"))))
    ends = near.select("nc", F.col("child").alias("old"), "ca", "bc").union(near.select("np", "parent", "pa", "bp")).toDF("v", "old", "a", "b").dropDuplicates(["v", "old"])

    def folded(group: DataFrame, ident: str, a: str, b: str, out: str) -> DataFrame:
        per = group.groupBy(ident).agg(F.any_value(b).alias("b"), *[aggregate_values(F.col(a)[k], how).alias(f"k{i}") for i, (k, _, how) in enumerate(rules)])
        whole = F.col("b")
        for i, (_, new, _) in enumerate(rules):
            got = F.col(f"k{i}")
            whole = F.when(got.isNotNull(), put(whole, new, got)).otherwise(whole)
        return per.select(F.col(ident).alias(f"{out}_id"), whole.alias(out))

    vs = stored(folded(ends, "v", "a", "b", "va"))
    es = folded(near.dropDuplicates(["id"]), "ne", "ea", "be", "ev")
    one = near.select("ne", "nc", "np").dropDuplicates(["ne"]).join(es, F.col("ne") == F.col("ev_id"))
    one = one.join(vs.select(F.col("va_id").alias("nc"), F.col("va").alias("ca")), "nc").join(vs.select(F.col("va_id").alias("np"), F.col("va").alias("pa")), "np")
    return one.select(F.col("ne").alias("id"), F.col("ev").alias("ea"), F.col("nc").alias("child"), "ca", F.col("np").alias("parent"), "pa")


def temporal_traversal(rows: DataFrame, key: str, source: Graph, way: str) -> DataFrame:
    """Ancestors: edges no later than the last that touches the source graph; descendants: none earlier than the first. Edges whose ``key`` is no number stay."""
    rows = strip(rows)
    if way[:1] not in ("a", "d"):
        raise ValueError("direction: ancestors or descendants")
    x = F.col("ea")[key].try_cast("double")
    src = source.v.select(F.col("id").alias("__s")).distinct()
    near = rows.join(src, F.col("child") == F.col("__s"), "left_semi").select(x.alias("x")).union(rows.join(src, F.col("parent") == F.col("__s"), "left_semi").select(x.alias("x")))
    bound = near.agg((F.max if way[:1] == "a" else F.min)("x").alias("__b"))
    out = rows.join(F.broadcast(bound))  # one row
    fine = (x <= F.col("__b")) if way[:1] == "a" else (x >= F.col("__b"))
    return out.where(F.coalesce(fine, x.isNull())).select(*rows.columns)


def contextual_temporal_traversal(rows: DataFrame, key: str, source: Graph, rounds: int = 10_000) -> DataFrame:
    """Walk against the edges from the first source vertex: an edge to a vertex counts if it is later than the earliest edge the vertex was reached by; what a reached vertex depends on counts too.

    First is the smallest id. One job a level; a level's vertices are new ones only.
    """
    rows = stored(strip(rows).withColumn("t", F.col("ea")[key].try_cast("double")))
    front = stored(source.v.orderBy("id").limit(1))
    seen = Pile(front.select("id"))
    taken: Pile | None = None
    for k in range(rounds):
        base = rows if taken is None else taken.read()
        first = base.join(front.withColumnRenamed("id", "__f"), F.col("child") == F.col("__f"), "left_semi").groupBy(F.col("child").alias("__f")).agg(F.min("t").alias("t0"))
        here = front.select(F.col("id").alias("__f")).join(first, "__f", "left")
        up = rows.join(here, F.col("parent") == F.col("__f")).where("t is not null and (t0 is null or t > t0)").select(*rows.columns)
        down = rows.join(front.withColumnRenamed("id", "__f"), F.col("child") == F.col("__f"), "left_semi")
        got = up.unionByName(down).dropDuplicates(["id"])
        if taken is None:
            taken = Pile(got)
            piece = taken.read()
        else:
            piece = taken.add(got)
        ends = piece.select(F.explode(F.array("child", "parent")).alias("id")).distinct()
        new = ends.join(seen.read(), "id", "left_anti")
        front = seen.add(new)
        if front.isEmpty():
            break
    else:
        raise RuntimeError(f"the walk doesn't end within {rounds} levels")
    return taken.read().dropDuplicates(["id"]).drop("t")


#: Annotations to blank at each level, with the way each is blanked (None: whole).
LEVELS = {
    "low": {"cwd": None, "fsgid": None, "fsuid": None, "sgid": None, "suid": None, "remote address": "ip", "path": "path", "time": "time"},
    "medium": {"command line": None, "uid": None, "gid": None, "remote address": "ip", "path": "path", "time": "time", "size": None},
    "high": {"name": None, "euid": None, "remote address": "ip", "path": "path", "time": "time", "operation": None},
}


def _blank_parts(parts: Column, at: tuple[int, ...], sep: str, blank: Callable[[Column], Column]) -> Column:
    return F.array_join(F.transform(parts, lambda x, i: F.when(i.isin(*at), blank(x)).otherwise(x)), sep)


def _blank(value: Column, how: str | None, level: str, blank: Callable[[Column], Column]) -> Column:
    if how is None:
        return blank(value)
    rank = ("low", "medium", "high").index(level)
    if how == "ip":
        four, six = F.split(value, r"\."), F.split(value, ":")
        return F.when((F.instr(value, ".") > 0) & (F.size(four) == 4), _blank_parts(four, (rank + 1,), ".", blank)).when((F.instr(value, ".") == 0) & (F.size(six) == 8), _blank_parts(six, (2 * rank + 2, 2 * rank + 3), ":", blank)).otherwise(value)
    if how == "path":
        return _blank_parts(F.split(value, "/", 5), (rank + 2,), "/", blank)
    day = (r"^(\d+)-(\d+)-(\d+) (\d+):(\d+):(\d+)\.(\d+)$",)
    got = [F.regexp_extract(value, day[0], i) for i in range(1, 8)]
    hidden = {0: (2,), 1: (3,), 2: (4, 5, 6)}[rank]
    y, mo, d, h, mi, s, ms = [blank(x) if i in hidden else x for i, x in enumerate(got)]
    return F.when(value.rlike(day[0]), F.concat(y, F.lit("-"), mo, F.lit("-"), d, F.lit(" "), h, F.lit(":"), mi, F.lit(":"), s, F.lit("."), ms)).otherwise(value)


def epoch_text(value: Column) -> Column:
    """Seconds since 1970 as ``yyyy-M-d H:m:s.S`` in UTC; other texts stay."""
    t = F.timestamp_millis(F.floor(value.try_cast("double") * 1000).cast("bigint"))
    return F.coalesce(F.concat(F.date_format(t, "y-M-d H:m:s."), (F.unix_millis(t) % 1000).cast("string")), value)


def _hidden(rows: DataFrame, level: str, blank: Callable[[Column], Column]) -> DataFrame:
    rows = rows.withColumn("ea", F.when(F.col("ea")["time"].isNull(), F.col("ea")).otherwise(put(F.col("ea"), "time", epoch_text(F.col("ea")["time"]))))
    for c in ("ea", "ca", "pa"):
        rows = rows.withColumn(c, F.transform_values(c, lambda k, v: reduce(lambda acc, kv: F.when(k == kv[0], _blank(v, kv[1], level, blank)).otherwise(acc), LEVELS[level].items(), v)))
    return rows


def sanitization(rows: DataFrame, level: str = "low") -> DataFrame:
    """Times as text, then parts of times, paths and addresses, or whole values, blanked by level."""
    return _hidden(rows, level, lambda x: F.lit(NULL_TEXT))


def encryption(rows: DataFrame, keys: dict[str, str], level: str = "low") -> DataFrame:
    """The same parts encrypted with AES (ECB, PKCS padding) in base 64, each level with its own key of 16, 24 or 32 bytes; wrapping keys for readers is left to their owner."""
    key = F.lit(keys[level])
    return _hidden(rows, level, lambda x: F.base64(F.aes_encrypt(x, key, F.lit("ECB"), F.lit("PKCS"))))


def arguments(text: str) -> dict[str, str]:
    """``k=v k="v v"`` as a dict."""
    return {m[1].strip(): m[2] if m[2] is not None else m[3] for m in re.finditer(r'([\w ]*\w)\s*=\s*(?:"([^"]*)"|([^\s,]+))', text or "")}


#: How paths of no interest begin, what they are called whole, and how files begin reads of which are no news end.
NOISE_PREFIXES = ("/tmp", "pipe:", "/unknown")
NOISE_NAMES = (r".*scoreboard.*", r"\.", "stdin", r"\(null\)", "/dev/null", "stderr", "stdout")
LIBRARY_SUFFIXES = (r"\.so(\..*)*", r"\.conf", r"\.lock", r"\.pb", r"\.desktop", r"\.service")


def path_pattern(prefixes: tuple[str, ...] = (), names: tuple[str, ...] = (), suffixes: tuple[str, ...] = ()) -> str:
    """A pattern that is found in paths with one of the prefixes or suffixes, or with one of the whole names."""
    kinds = ((prefixes, "^(?:{})"), (names, "^(?:{})$"), (suffixes, "(?:{})$"))
    return "|".join(shape.format("|".join(xs)) for xs, shape in kinds if xs)


NOISE_PATHS = path_pattern(NOISE_PREFIXES, NOISE_NAMES)
LIBRARY_PATHS = path_pattern(suffixes=LIBRARY_SUFFIXES)


def beep(rows: DataFrame, source: Graph, way: str) -> DataFrame:
    """The chain of transformations for a backward or forward search.

    Steps that read their input several times get it written out, else plans would grow by a factor a step.
    """
    rows = temporal_traversal(stored(rows), "event id", source, way)
    rows = drop_keys(rows, "event id")
    for step in (no_units, no_memory, no_versions, merge_io):
        rows = step(rows)
    rows = blacklist(simple_forks(stored(rows)), NOISE_PATHS, source)
    rows = no_ephemeral_reads(stored(rows), LIBRARY_PATHS if way[:1] == "a" else None, source)
    return no_ephemeral_writes(stored(rows))


def way_of(text: str | None) -> str:
    """'a', 'd' or 'b' from a prefix of ancestors, descendants or both."""
    low = (text or "").lower()
    for full in ("ancestors", "descendants", "both"):
        if low and full.startswith(low):
            return full[0]
    raise ValueError(f"direction: {text!r}")


def apply(name: str, g: Graph, text: str = "", source: Graph | None = None, depth: int | None = None, way: str | None = None) -> Graph:
    """Run a transformation by its name in the query language."""
    rows, args = flat(g), arguments(text)
    plain = {"lastname": last_name, "mergeio": merge_io, "nomemory": no_memory, "nounits": no_units, "noversions": no_versions, "noephemeralwrites": no_ephemeral_writes, "onlyaddresses": only_addresses, "onlyagents": only_agents, "opm2prov": opm_to_prov, "prov2opm": prov_to_opm, "simpleforks": simple_forks, "aggregation": aggregation}
    low = name.lower()
    if low in plain:
        made = plain[low](rows)
    elif low == "dropkeys":
        made = drop_keys(rows, *[k.strip() for k in args.get("keys", text).split(",") if k.strip()])
    elif low == "blacklist":
        made = blacklist(rows, args.get("pattern", NOISE_PATHS), source)
    elif low == "noephemeralreads":
        made = no_ephemeral_reads(rows, None if args.get("limited") == "false" else args.get("pattern", LIBRARY_PATHS), source)
    elif low in ("opm2provtc", "provtc2opm"):
        made = (opm_to_prov_tc if low == "opm2provtc" else prov_tc_to_opm)(rows, args)
    elif low == "sanitization":
        made = sanitization(rows, args.get("sanitizationLevel", "low"))
    elif low == "abe":
        made = encryption(rows, {args.get("level", "low"): args["key"]}, args.get("level", "low"))
    elif source is None and low in ("prune", "temporaltraversal", "contextualtemporaltraversal", "beep"):
        raise ValueError(f"{name} needs a source graph")
    elif low == "prune":
        made = prune(rows, g, source, depth if depth is not None else 1, way_of(way))
    elif low == "temporaltraversal":
        made = temporal_traversal(rows, args.get("order", "event id"), source, way_of(way))
    elif low == "contextualtemporaltraversal":
        made = contextual_temporal_traversal(rows, args.get("order", "timestamp"), source)
    elif low == "beep":
        made = beep(rows, source, way_of(way))
    else:
        raise ValueError(f"unknown transformation {name!r}")
    return rebuild(made, g)

