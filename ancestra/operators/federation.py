"""Lineage over several stores, joined where their network sockets meet."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ancestra.functions.predicates import Compare
from ancestra.operators.graph import Graph, Store, _levels

SOCKET = Compare("subtype", "=", "network socket")
#: The annotations that name the two ends of a socket.
LOCAL, REMOTE = ("local address", "local port"), ("remote address", "remote port")


def _ends(keys: tuple[str, str]) -> Column:
    return F.concat_ws("|", *[F.col("annotations")[k] for k in keys])


def union_store(*stores: Store) -> Store:
    """All stores as one; the same id is the same element."""
    v, e = stores[0].vertices, stores[0].edges
    for s in stores[1:]:
        v, e = v.unionByName(s.vertices), e.unionByName(s.edges)
    return Store(v.dropDuplicates(["id"]), e.dropDuplicates(["id"]))


def remote_lineage(found: Graph, start: Graph, depth: int, way: str, others: list[Store]) -> Graph:
    """``found`` together with what a lineage reaches in other stores.

    A socket of ``found`` meets the sockets of another store whose local and remote ends are its own swapped;
    from there the walk goes on for the hops that are left (a socket counts at its fewest hops). Sockets without
    all four annotations meet nothing.
    """
    sockets = found.get_vertex(SOCKET)
    keys = [*LOCAL, *REMOTE]
    whole = sockets.vertex_rows.where(" and ".join(f"annotations['{k}'] is not null" for k in keys))
    at = _levels([found._steps("a" if way[:1] == "a" else "d")], start.v, depth)
    near = whole.join(at, "id").select(_ends(REMOTE).alias("l"), _ends(LOCAL).alias("r"), "depth").groupBy("l", "r").agg(F.min("depth").alias("depth"))
    store = union_store(found.store, *others)
    v, e = found.v, found.e
    for other in others:
        theirs = other.vertices.where(SOCKET.column(F.col("annotations"))).where(" and ".join(f"annotations['{k}'] is not null" for k in keys))
        met = theirs.select("id", _ends(LOCAL).alias("l"), _ends(REMOTE).alias("r")).join(near, ["l", "r"]).select("id", "depth")
        for used in sorted(r.depth for r in met.select("depth").distinct().collect()):  # at most one row a hop
            if used >= depth:
                continue
            begin = Graph(other, met.where(F.col("depth") == used).select("id"), other.empty().e)
            there = other.base.get_lineage(begin, depth - used, way)
            v, e = v.union(there.v), e.union(there.e)
        v = v.union(met.select("id"))
    return Graph(store, v.distinct(), e.distinct(), remotes=found.remotes)


def discrepancies(known: Graph, response: Graph) -> int:
    """How many vertices and edges of ``known`` a response lacks."""
    lost = known - response
    return lost.v.count() + lost.e.count()
