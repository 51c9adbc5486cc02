"""Graphs as pairs of id tables over a store of vertices and edges.

A ``Store`` holds everything; a ``Graph`` names some of its vertices and edges by id.
Operators are lazy, but for the traversals, which run a job or two a hop and
cut the plan after it. Edges point from child (effect) to parent (cause):
ancestors follow child to parent.

Links are written once a store and direction, as narrow rows in the order of the end a walk comes from. A hop scans them
against its frontier: as a filter on the scan for a few ids, else as a semi join, in which Spark broadcasts a frontier
that is small as written and shuffles otherwise. No hop sorts out repeated edges again.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ancestra.functions.predicates import Predicate, has_keys
from ancestra.session import Pile, cut, stored, tasks_of

#: Frontiers of up to this many ids are a filter on the scan of links.
FEW = 10


@dataclass
class Store:
    """``vertices(id, annotations, ref)`` and ``edges(id, child, parent, annotations, ref)``, ids unique and not null."""

    vertices: DataFrame
    edges: DataFrame
    _links: dict[str, DataFrame] = field(default_factory=dict, repr=False, compare=False)

    @property
    def spark(self) -> SparkSession:
        return self.vertices.sparkSession

    @staticmethod
    def of(vertices: DataFrame, edges: DataFrame) -> Store:
        """A store from tables that may hold repeated rows, null ids and further columns: one row an id stays, edges without an endpoint go."""
        v = vertices.select("id", "annotations", F.coalesce("ref", F.lit(False)).alias("ref") if "ref" in vertices.columns else F.lit(False).alias("ref")).where("id is not null")
        e = edges.select("id", "child", "parent", "annotations", F.coalesce("ref", F.lit(False)).alias("ref") if "ref" in edges.columns else F.lit(False).alias("ref")).where("id is not null and child is not null and parent is not null")
        return Store(v.dropDuplicates(["id"]), e.dropDuplicates(["id"]))

    def kept(self) -> Store:
        """The same store written out once, repeated rows gone: vertices in the order of id, edges in that of child and id, a hot child spread over files."""
        v, e, n = self.vertices, self.edges, tasks_of(self.spark)
        return Store(stored(v.repartitionByRange(n, "id").sortWithinPartitions("id")), stored(e.repartitionByRange(n, "child", "id").sortWithinPartitions("child", "id")))

    def links(self, way: str) -> DataFrame:
        """(id, src, dst) of all edges in the direction of a walk, written once in the order of src and id."""
        if way not in self._links:
            self._links[way] = _sorted_links(self.edges, way)
        return self._links[way]

    @property
    def base(self) -> Graph:
        return Graph(self, self.vertices.select("id"), self.edges.select("id"), whole=True)

    def empty(self) -> Graph:
        none = self.spark.createDataFrame([], "id string")
        return Graph(self, none, none)

    def vertices_by_id(self, *ids: str) -> Graph:
        """The vertices of the store with these ids; ids of more than 32 characters name nothing."""
        return self._literal(self.vertices, ids, True)

    def edges_by_id(self, *ids: str) -> Graph:
        return self._literal(self.edges, ids, False)

    def _literal(self, rows: DataFrame, ids: tuple[str, ...], vertex: bool) -> Graph:
        good = [i for i in ids if i and len(i) <= 32]
        none = self.empty()
        if not good:
            return none
        got = rows.where(F.col("id").isin(good)).select("id")
        return Graph(self, got, none.e) if vertex else Graph(self, none.v, got)


def _sorted_links(edges: DataFrame, way: str) -> DataFrame:
    src, dst = ("child", "parent") if way == "a" else ("parent", "child")
    rows = edges.select("id", F.col(src).alias("src"), F.col(dst).alias("dst"))
    return stored(rows.repartitionByRange(tasks_of(edges.sparkSession), "src", "id").sortWithinPartitions("src", "id"))


def _semi(rows: DataFrame, ids: DataFrame, on: str = "id") -> DataFrame:
    """Rows whose ``on`` is among ``ids``."""
    return rows.join(ids.select(F.col("id").alias("__in")), F.col(on) == F.col("__in"), "left_semi")


def _anti(rows: DataFrame, ids: DataFrame, on: str = "id") -> DataFrame:
    return rows.join(ids.select(F.col("id").alias("__in")), F.col(on) == F.col("__in"), "left_anti")


def direction_of(text: str) -> str:
    """'a', 'd' or 'b' by the first letter; anything else means both."""
    return text[:1] if text[:1] in ("a", "d") else "b"


@dataclass
class Graph:
    """The ids of some vertices and edges. ``whole`` tells that it is all of the store; ``remotes`` are linked graphs of other stores."""

    store: Store
    v: DataFrame
    e: DataFrame
    whole: bool = False
    remotes: frozenset = field(default_factory=frozenset)

    def _with(self, v: DataFrame, e: DataFrame) -> Graph:
        return Graph(self.store, v, e, remotes=self.remotes)

    def _none(self) -> DataFrame:
        return self.v.limit(0)

    # rows of the graph's elements

    @property
    def vertex_rows(self) -> DataFrame:
        return self.store.vertices if self.whole else _semi(self.store.vertices, self.v)

    @property
    def edge_rows(self) -> DataFrame:
        return self.store.edges if self.whole else _semi(self.store.edges, self.e)

    def distinct(self) -> Graph:
        return Graph(self.store, self.v.distinct(), self.e.distinct(), self.whole, self.remotes)

    def kept(self) -> Graph:
        """The same graph with its ids written out, for a variable that several statements use."""
        return self if self.whole else Graph(self.store, stored(self.v.distinct()), stored(self.e.distinct()), False, self.remotes)

    # set operations

    def __add__(self, other: Graph) -> Graph:
        return Graph(self.store, self.v.unionByName(other.v), self.e.unionByName(other.e), remotes=self.remotes | other.remotes)

    def __sub__(self, other: Graph) -> Graph:
        return Graph(self.store, _anti(self.v, other.v), _anti(self.e, other.e), remotes=self.remotes - other.remotes)

    def __and__(self, other: Graph) -> Graph:
        return Graph(self.store, _semi(self.v, other.v), _semi(self.e, other.e), remotes=self.remotes & other.remotes)

    # filters

    def get_vertex(self, where: Predicate | None = None) -> Graph:
        rows = self.vertex_rows if where is None else self.vertex_rows.where(where.column(F.col("annotations")))
        return self._with(rows.select("id").distinct() if where is None else rows.select("id"), self._none())

    def get_edge(self, where: Predicate | None = None) -> Graph:
        rows = self.edge_rows if where is None else self.edge_rows.where(where.column(F.col("annotations")))
        return self._with(self._none(), rows.select("id"))

    def get_edge_with_endpoints(self, where: Predicate | None = None) -> Graph:
        found = self.get_edge(where)
        return self._with(found.get_edge_endpoints().v, found.e)

    def vertices_with_keys(self, *keys: str) -> Graph:
        return self._with(self.vertex_rows.where(has_keys(F.col("annotations"), list(keys))).select("id"), self._none())

    def get_edge_endpoints(self) -> Graph:
        ends = self.edge_rows.select(F.explode(F.array("child", "parent")).alias("id"))
        return self._with(ends.distinct(), self._none())

    def get_edge_source(self) -> Graph:
        return self._with(self.edge_rows.select(F.col("child").alias("id")).distinct(), self._none())

    def get_edge_destination(self) -> Graph:
        return self._with(self.edge_rows.select(F.col("parent").alias("id")).distinct(), self._none())

    def get_match(self, other: Graph, *keys: str) -> Graph:
        """Vertices of either graph that agree with one of the other on all ``keys``; absent keys never agree.

        Each side is first reduced to its distinct key values, so the join is one of unique keys and no pairs arise.
        """
        if not keys:
            raise ValueError("getMatch needs keys")
        values = F.struct(*[F.col("annotations")[k].alias(f"k{i}") for i, k in enumerate(keys)])

        def keyed(g: Graph) -> DataFrame:
            return g.vertex_rows.where(has_keys(F.col("annotations"), list(keys))).select("id", values.alias("k"))

        a, b = keyed(self), keyed(other)
        hit_a = a.join(b.select("k").distinct(), "k", "left_semi").select("id")
        hit_b = b.join(a.select("k").distinct(), "k", "left_semi").select("id")
        return self._with(hit_a.union(hit_b).distinct(), self._none())

    # traversal

    def _steps(self, way: str) -> DataFrame:
        """(id, src, dst) of the graph's edges in the direction of a walk, written out."""
        return self.store.links(way) if self.whole else _sorted_links(self.edge_rows, way)

    def get_neighbor(self, start: Graph, way: str = "b") -> Graph:
        """One hop: the start vertices, the neighbours and the edges between."""
        v, e = start.v, self._none()
        for w in "ad" if direction_of(way) == "b" else direction_of(way):
            src, dst = ("child", "parent") if w == "a" else ("parent", "child")
            hop = _semi(self.edge_rows.select("id", F.col(src).alias("src"), F.col(dst).alias("dst")), start.v.distinct(), "src")
            v, e = v.union(hop.select(F.col("dst").alias("id"))), e.union(hop.select("id"))
        return self._with(v.distinct(), e.distinct())

    def _walk(self, start: DataFrame, way: str, depth: int | None) -> tuple[DataFrame, DataFrame]:
        """(id, depth) of all vertices within ``depth`` hops of ``start``, and (id, dst, depth) of the edges walked.

        An edge counts at the hop that reads it, also if it leads back. Frontiers
        are distinct ids, so a hot vertex is read once, and every hop writes only what is new. Without a depth the walk goes on until nothing is.
        """
        steps = self._steps(way)
        seen = Pile(start.select("id").distinct().select("id", F.lit(0).alias("depth")))
        front = seen.read()
        edges: Pile | None = None
        for k in count(1):
            if (depth is not None and k > depth) or not (n := front.count()):
                break
            hop = _hop(steps, front, n).select("id", "dst", F.lit(k).alias("depth"))
            if edges is None:
                edges = Pile(hop)
                taken = edges.read()
            else:
                taken = edges.add(hop)
            new = _anti(taken.select(F.col("dst").alias("id")).distinct(), seen.read())
            front = seen.add(new.select("id", F.lit(k).alias("depth")))
        none = start.select("id", F.lit(None).cast("string").alias("dst"), F.lit(0).alias("depth")).limit(0)
        return seen.read(), edges.read() if edges else none

    def get_lineage(self, start: Graph, depth: int | None = None, way: str = "b") -> Graph:
        """Everything within ``depth`` hops of ``start``. Both directions are two walks, not an undirected one. Start vertices count even if the graph lacks them; without any, or without edges, the result is empty."""
        if start.v.isEmpty() or self.e.isEmpty():
            return self._with(self._none(), self._none())
        v, e = start.v.limit(0), start.v.limit(0)
        for w in "ad" if direction_of(way) == "b" else direction_of(way):
            seen, edges = self._walk(start.v, w, depth)
            v, e = v.union(seen.select("id")), e.union(edges.select("id"))
        return self._with(v.distinct(), e.distinct())

    def get_link(self, src: Graph, dst: Graph, depth: int) -> Graph:
        """Vertices on undirected walks of at most ``depth`` links between the two graphs, and all edges among them."""
        steps = [self._steps("a"), self._steps("d")]
        near = _levels(steps, dst.v, depth)
        ahead = _levels(steps, src.v, depth)
        on = near.select("id", F.col("depth").alias("d1")).join(ahead.select("id", F.col("depth").alias("d2")), "id").where(F.col("d1") + F.col("d2") <= depth)
        return self._induced(on.select("id"))

    def _induced(self, ids: DataFrame) -> Graph:
        v = stored(ids.distinct())
        edges = _semi(_semi(self.edge_rows.select("id", "child", "parent"), v, "child"), v, "parent")  # v is as small as it is written, so Spark can broadcast it
        return self._with(v, edges.select("id"))

    def get_simple_path(self, src: Graph, dst: Graph, depth: int | None = None) -> Graph:
        """Vertices and edges on ancestor walks of at most ``depth`` edges from ``src`` to ``dst``.

        An edge belongs to the answer if the fewest hops from ``src`` to its child, itself, and the
        fewest hops from its parent to ``dst`` add up to at most ``depth``.
        """
        back, ahead = self._steps("d"), self._steps("a")
        to_dst = _levels([back], dst.v, depth)
        # only vertices that lead to dst are walked, and no further than what is left of the depth
        from_src = _levels([ahead], src.v.join(to_dst.select("id"), "id", "left_semi"), depth, to_dst)
        a = from_src.select(F.col("id").alias("src"), F.col("depth").alias("d1"))
        b = to_dst.select(F.col("id").alias("dst"), F.col("depth").alias("d2"))
        on = ahead.join(a, "src").join(b, "dst")
        on = stored((on if depth is None else on.where(F.col("d1") + 1 + F.col("d2") <= depth)).select("id", "src", "dst"))
        return self._along(on, _semi(src.v, dst.v))

    def _along(self, on: DataFrame, meet: DataFrame) -> Graph:
        """The edges ``on(id, src, dst)``, their ends and the vertices of ``meet``."""
        v = on.select(F.col("src").alias("id")).union(on.select(F.col("dst").alias("id"))).union(meet.select("id"))
        return self._with(v.distinct(), on.select("id"))

    def get_path(self, src: Graph, *legs: tuple[Graph, int | None]) -> Graph:
        """A chain of simple paths; a leg starts where the one before met its end, and the first that finds nothing ends the chain."""
        out, here = None, src
        for via, depth in legs:
            leg = self.get_simple_path(here, via, depth)
            met = _semi(leg.v, via.v)
            if met.isEmpty():
                break
            out = leg if out is None else out + leg
            here = self._with(stored(met), self._none())
        return out.distinct() if out is not None else self._with(self._none(), self._none())

    def get_shortest_path(self, src: Graph, dst: Graph, depth: int | None = None) -> Graph:
        """For every vertex of ``src`` all ancestor walks with the fewest edges, at most ``depth``, to its nearest vertices of ``dst``; one that is in both is its own.

        Levels to the nearest end fall by one along such a walk and along no other, so they tell the edges of all starts at once.
        """
        to_dst = _levels([self._steps("d")], dst.v, depth)
        a = to_dst.select(F.col("id").alias("src"), F.col("depth").alias("d1"))
        b = to_dst.select(F.col("id").alias("dst"), F.col("depth").alias("d2"))
        down = stored(self._steps("a").join(a, "src").join(b, "dst").where("d1 = d2 + 1").select("id", "src", "dst"))
        reached = _levels([down], _semi(src.v, to_dst), None)
        return self._along(_semi(down, reached, "src"), _semi(src.v, dst.v))

    def path_lengths(self, src: Graph, dst: Graph, depth: int) -> list[int]:
        """The hops at which a walk over ancestors from ``src`` meets ``dst``; vertices of the hop before don't count, so a cycle can give several."""
        steps = self._steps("a")
        front, out = stored(src.v.distinct()), []
        for k in range(1, depth + 1):
            reached = _hop(steps, front, front.count()).select(F.col("dst").alias("id")).distinct()
            new = stored(_anti(reached, front))
            if new.isEmpty():
                break
            if not _semi(new, dst.v).isEmpty():
                out.append(k)
            front = new
        return out

    def get_subgraph(self, skeleton: Graph) -> Graph:
        """The graph's vertices among those of the skeleton and its edges' ends, and its edges among them."""
        ids = skeleton.v.union(skeleton.get_edge_endpoints().v).distinct()
        return self._induced(_semi(self.v, ids))

    def span(self, other: Graph) -> Graph:
        return other.get_subgraph(self)

    def refine_dependencies(self, pairs: Iterable[tuple[str, str]], key: str, depth: int | None = None) -> Graph:
        """For every pair (a, b): the paths from the sources of edges with ``key`` a to the destinations of edges with ``key`` b. What a pair gives is written out, so plans don't grow with the pairs."""
        from ancestra.functions.predicates import Compare

        v: Pile | None = None
        e: Pile | None = None
        for a, b in pairs:
            got = self.get_simple_path(self.get_edge(Compare(key, "=", a)).get_edge_source(), self.get_edge(Compare(key, "=", b)).get_edge_destination(), depth)
            if v is None:
                v, e = Pile(got.v), Pile(got.e)
            else:
                v.add(got.v)
                e.add(got.e)
        return self._with(v.read().distinct(), e.read().distinct()) if v else self._with(self._none(), self._none())

    # edges that stand for one another, ranks, samples

    def collapse_edge(self, *keys: str) -> Graph:
        """Of the edges with the same ends and ``keys`` the one with the smallest id; vertices stay."""
        cols = [F.col("annotations")[k].alias(f"k{i}") for i, k in enumerate(keys)]
        one = self.edge_rows.groupBy("child", "parent", *cols).agg(F.min("id").alias("id"))
        return self._with(self.v, one.select("id"))

    def subset(self, start: int, end: int | None = None, what: str = "both") -> Graph:
        """Elements with rank in [start, end) in the order of id, from 0; negative ranks count from the end. Out of bounds raises ValueError."""
        v, e = self._none(), self._none()
        if what in ("both", "vertex"):
            v = _ranked(self.v, start, end)
        if what in ("both", "edge"):
            e = _ranked(self.e, start, end)
        return self._with(v, e)

    def limit(self, n: int) -> Graph:
        """The first n vertices and the first n edges in the order of id."""
        return self._with(self.v.distinct().orderBy("id").limit(n), self.e.distinct().orderBy("id").limit(n))

    def sample(self, n: int, what: str = "both", seed: int = 0) -> Graph:
        """n random elements without replacement, the same for the same seed."""
        pick = lambda ids: ids.distinct().orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(n)
        return self._with(pick(self.v) if what in ("both", "vertex") else self._none(), pick(self.e) if what in ("both", "edge") else self._none())

    # results

    def export(self) -> tuple[DataFrame, DataFrame]:
        """Vertices and edges with annotations; endpoints that aren't vertices of the graph come as vertices without annotations."""
        e = self.edge_rows
        v = self.vertex_rows
        ends = e.select(F.explode(F.array("child", "parent")).alias("id")).distinct()
        bare = _anti(ends, v).select("id", F.create_map().cast("map<string,string>").alias("annotations"), F.lit(True).alias("ref"))
        return v.select("id", "annotations", "ref").unionByName(bare), e

    def rows(self) -> DataFrame:
        """(kind, id): the graph as one table."""
        return self.v.distinct().select(F.lit("vertex").alias("kind"), "id").union(self.e.distinct().select(F.lit("edge").alias("kind"), "id"))


def _hop(steps: DataFrame, front: DataFrame, n: int) -> DataFrame:
    """The links whose src is one of the ``n`` distinct ids of ``front``."""
    if n <= FEW:
        return steps.where(F.col("src").isin([r.id for r in front.select("id").collect()]))
    return _semi(steps, front, "src")


def _levels(steps: list[DataFrame], start: DataFrame, limit: int | None, room: DataFrame | None = None) -> DataFrame:
    """(id, depth): the fewest hops over any of ``steps`` to every vertex within ``limit`` of ``start``.

    ``room(id, depth)`` leaves out vertices it hasn't got, and those whose depth there and here exceed ``limit``.
    """
    seen = Pile(start.select("id").distinct().select("id", F.lit(0).alias("depth")))
    front = seen.read()
    for k in count(1):
        if (limit is not None and k > limit) or not (n := front.count()):
            break
        hops = [_hop(s, front, n).select(F.col("dst").alias("id")) for s in steps]
        new = reduce(lambda x, y: x.union(y), hops).distinct()
        if room is not None:
            new = _semi(new, room if limit is None else room.where(F.col("depth") + k <= limit))
        front = seen.add(_anti(new, seen.read()).select("id", F.lit(k).alias("depth")))
    return seen.read()


def _ranked(ids: DataFrame, start: int, end: int | None) -> DataFrame:
    """Ids with rank in [start, end): sorted by range over all tasks; a rank is a partition's offset and the place within it.

    The only thing on the driver is one count a partition.
    """
    rows = cut(ids.distinct().orderBy("id")).withColumn("m", F.monotonically_increasing_id())
    part = F.shiftright("m", 33).cast("int")
    counts = dict(rows.groupBy(part.alias("p")).count().collect())  # one row a partition
    n = sum(counts.values())
    lo = start + n if start < 0 else start
    hi = n if end is None else end + n if end < 0 else end
    if lo < 0 or hi > n or lo >= hi:
        raise ValueError(f"[{start}, {end}) is out of the bounds of {n} elements")
    at, offsets = 0, [0] * (max(counts) + 1)
    for p in sorted(counts):
        offsets[p] = at
        at += counts[p]
    base = F.element_at(F.from_json(F.lit(str(offsets)), "array<bigint>"), part + 1)
    rank = base + F.col("m").bitwiseAND(F.lit((1 << 33) - 1))
    return rows.withColumn("k", rank).where((F.col("k") >= lo) & (F.col("k") < hi)).select("id")


def annotation(c: str) -> Column:
    return F.col("annotations")[c]
