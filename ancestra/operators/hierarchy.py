"""Parent-child rows into full hierarchies, by tree contraction.

Rounds alternate raking (leaves leave the tree) and compression (of the
vertices with one child an independent set leaves, and its children link to
its parents), so the tree vanishes in a logarithmic number of rounds even
if it is one chain. What left in each round is kept, and the rounds
reversed give every vertex its root, depth and path; descendants follow from paths. A cycle never has a leaf:
compression shrinks it to one vertex linked to itself, which tells it
from a root. Vertices spliced out between two vertices of a cycle are on it.

If paths are wanted, a link carries the vertices that were spliced out of it, in order: a vertex is in at most
one link at a time, so a chain of n vertices carries n names a round, and no pairs are made.
As soon as all that is left fits one task (``FINISH`` links and names, counted), the same rounds go on in that task on arrays.

All joins are on vertex keys that are unique on both sides, but for the
lookup of parents on the way back; there the parents with many children,
a list bounded by the number of tasks, are salted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ancestra.session import Pile, stored, tasks_of

#: Rounds after which the input is taken to be faulty (every round removes a constant share of the vertices).
MAX_ROUNDS = 400
#: Links, and names they carry, that one task contracts on arrays (about 100 bytes each).
FINISH = 200_000
NAMES = "array<string>"


def parents_of(links: DataFrame, child: str = "child", parent: str = "parent") -> DataFrame:
    """(v, p): every endpoint once, with its parent or null.

    Rows with a null endpoint are no links. Repeated links count once; of
    several parents of one child the smallest is its parent.
    """
    real = links.select(F.col(child).alias("c"), F.col(parent).alias("q")).where("c is not null and q is not null")
    both = real.select(F.col("c").alias("v"), F.col("q").alias("p")).unionByName(real.select(F.col("q").alias("v"), F.lit(None).cast("string").alias("p")))
    return both.groupBy("v").agg(F.min("p").alias("p"))


def _lot(v: str, k: int) -> Column:
    """A vertex's random number in round ``k``."""
    return F.xxhash64(F.col(v), F.lit(k))


def _hot_parents(nodes: DataFrame, tasks: int) -> list[str]:
    """Parents with more children than half a task's share: fewer than ``2 * tasks``."""
    n = nodes.agg(F.count("p").alias("n")).first().n
    per = nodes.where("p is not null").groupBy("p").count()
    return [r.p for r in per.where(F.col("count") > max(1000, n // (2 * tasks))).collect()]


def contract(p: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], np.ndarray]:
    """The rounds of contraction on arrays, of a forest in which vertex i links to ``p[i]`` (-1: to none).

    Gives (vertices, parents, links, children or -1) of what left in each round, and the vertices that end linked to themselves.
    """
    n = len(p)
    p, w = p.copy(), np.ones(n, np.int64)
    rng = np.random.default_rng(0)
    live = np.flatnonzero(p >= 0)
    rounds, loops = [], [live[p[live] == live]]
    live = live[p[live] != live]
    while len(live):
        kids, child, lot = np.bincount(p[live], minlength=n), np.full(n, -1), rng.random(n)
        child[p[live]] = live
        leaf, one = live[kids[live] == 0], live[kids[live] == 1]
        link = one[(lot[one] < lot[child[one]]) & (lot[one] < lot[p[one]])]
        c = child[link]
        w[c] += w[link]
        p[c] = p[link]
        gone = np.concatenate([leaf, link])  # a leaf may have been linked on in this round
        rounds.append((gone, p[gone], w[gone], np.concatenate([np.full(len(leaf), -1), c])))
        stay = np.ones(n, bool)
        stay[gone] = False
        live = live[stay[live]]
        loops.append(live[p[live] == live])
        live = live[p[live] != live]
    return rounds, np.concatenate(loops)


FOUND = "v string, top string, root string, depth bigint, on_cycle int, way array<string>, ring array<string>"


def _finish(want_paths: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (v, p, w, m, mid) as rows of FOUND: how each vertex hangs below ``top``, a vertex without a link here, or on or below a cycle found here (``root``). ``ring`` has the cycle, upwards, at one of its vertices."""
    held = [b for b in batches if len(b)]
    if not held:
        return
    rows = pa.Table.from_batches(held)
    k = len(rows)
    both = pa.chunked_array([*rows["v"].chunks, *rows["p"].chunks]).combine_chunks().dictionary_encode()
    names, codes = both.dictionary.to_pylist(), both.indices.to_numpy()
    v, n = codes[:k].tolist(), len(names)
    up, far = np.full(n, -1), np.zeros(n, np.int64)
    up[codes[:k]], far[codes[:k]] = codes[k:], rows["w"].to_numpy()
    least = dict(zip(v, rows["m"].to_pylist(), strict=True))
    mids = dict(zip(v, rows["mid"].to_pylist(), strict=True)) if want_paths else {}
    rounds, loops = contract(up)
    top, ring = np.arange(n), np.zeros(n, bool)
    label: dict[int, str] = {}
    rings: dict[int, list[str]] = {}
    ring[loops] = True
    for gone, parents, _, child in reversed(rounds):
        top[gone] = top[parents]
        ring[gone] = (child >= 0) & ring[np.maximum(child, 0)]
    for x in loops.tolist():
        on, i = [], x
        while not on or i != x:
            on.append(i)
            i = int(up[i])
        label[x] = min(min(names[i], least.get(i) or names[i]) for i in on)
        rings[x] = [y for i in on for y in (names[i], *reversed(mids.get(i) or ()))] if want_paths else []
    depth = np.zeros(n, np.int64)
    order = [i for gone, *_ in rounds for i in gone.tolist() if not ring[i]]
    kids: dict[int, list[int]] = {}
    for i in order:
        kids.setdefault(int(up[i]), []).append(i)
    kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.string())]
    cols: list[list] = [[] for _ in kinds]
    chars = 0

    def batch() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in FOUND.split(", ")])
        for c in cols:
            c.clear()
        return made

    for first in range(n):
        if up[first] >= 0 and not ring[first]:
            continue
        todo, way = [(first, 0)], []
        while todo:  # depth first, with one way up at a time
            i, at = todo.pop()
            del way[at:]
            if i != first:
                depth[i] = depth[up[i]] + far[i]
                way += mids.get(i) or ()
            t = int(top[i])
            if up[i] >= 0:
                for c, x in zip(cols, (names[i], names[t], label.get(t), int(depth[i]), int(ring[i]), list(way) if want_paths else None, rings.get(i)), strict=True):
                    c.append(x)
                chars += 40 * len(way) if want_paths else 0
            if want_paths:
                way.append(names[i])
            todo += [(j, len(way)) for j in kids.get(i, ())]
            if len(cols[0]) >= 50_000 or chars > 1 << 24:
                yield batch()
                chars = 0
    if cols[0]:
        yield batch()


def resolve(links: DataFrame, child: str = "child", parent: str = "parent", want_paths: bool = False, finish: int = FINISH) -> DataFrame:
    """(v, root, depth, on_cycle) of every endpoint of ``links``, and (way, ring) if ``want_paths``.

    ``root`` is the topmost vertex and ``depth`` the links up to it. If the
    way up ends in a cycle, ``root`` is the smallest vertex on the cycle and
    ``depth`` counts the links up to it; vertices on the cycle have depth 0,
    ``on_cycle`` 1. ``way`` has the vertices above, from the root or the first vertex on the cycle down, and is empty for these; it is one
    value, so a way must fit a row. ``ring`` has all of a cycle, going up, at one vertex of it, and is null elsewhere.
    An empty table gives no rows.
    """
    spark = links.sparkSession
    tasks = tasks_of(spark)
    none, empty = F.lit(None).cast(NAMES), F.array().cast(NAMES)
    mid = F.coalesce("mid", empty) if want_paths else none
    nodes = stored(parents_of(links, child, parent))
    start = [F.lit(0).cast("bigint").alias("depth"), (empty if want_paths else none).alias("way")]
    # vertices that are done: roots, and later what is left of a cycle, named by the smallest vertex seen on it
    pile = Pile(nodes.where("p is null or v = p").select("v", F.col("v").alias("root"), F.col("p").isNotNull().cast("int").alias("on_cycle"), *start, F.when(F.col("p").isNotNull(), F.array("v")).alias("ring")))
    live = nodes.where("p is not null and v <> p").select("v", "p", F.lit(1).cast("bigint").alias("w"), F.lit(None).cast("string").alias("m"), none.alias("mid"))
    hot: list[str] | None = None
    left: list[DataFrame] = []
    while True:
        size = live.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.greatest(F.size("mid"), F.lit(0))), F.lit(0)).alias("carried")).first()
        if size.n + size.carried <= finish or not size.n:
            break
        if len(left) == MAX_ROUNDS:
            raise RuntimeError("contraction doesn't end")
        hot = _hot_parents(nodes, tasks) if hot is None else hot
        k = len(left)
        kids = live.groupBy(F.col("p").alias("v")).agg(F.count("*").alias("nc"), F.min("v").alias("c"))
        seen = live.join(kids, "v", "left").withColumn("nc", F.coalesce("nc", F.lit(0)))
        # a vertex with one child whose lot is smaller than its child's and its parent's: no two neighbours are chosen
        chosen = (F.col("nc") == 1) & (_lot("v", k) < _lot("c", k)) & (_lot("v", k) < _lot("p", k))
        seen = seen.withColumn("out", F.when(F.col("nc") == 0, "leaf").when(chosen, "link"))
        spliced = seen.where("out = 'link'").select(F.col("c").alias("v"), F.col("v").alias("u"), F.col("p").alias("p2"), F.col("w").alias("w2"), F.col("m").alias("m2"), mid.alias("mid2"))
        moved = F.col("u").isNotNull()
        after = seen.join(spliced, "v", "left").select(
            "v",
            F.when(moved, F.col("p2")).otherwise(F.col("p")).alias("p"),
            F.when(moved, F.col("w") + F.col("w2")).otherwise(F.col("w")).alias("w"),
            F.when(moved, F.least("m", "m2", "u")).otherwise(F.col("m")).alias("m"),
            (F.when(moved, F.concat("mid2", F.array("u"), mid)).otherwise(F.col("mid")) if want_paths else none).alias("mid"),
            F.when(F.col("out") == "link", F.col("c")).alias("c"),
            "out",
        )
        after = stored(after)  # the round's job
        left.append(after.where("out is not null"))
        # upwards from the vertex that is left: those spliced out last come first
        pile.add(after.where("out is null and v = p").select("v", F.least("v", "m").alias("root"), F.lit(1).alias("on_cycle"), *start, (F.concat(F.array("v"), F.reverse(mid)) if want_paths else none).alias("ring")))
        live = after.where("out is null and v <> p").select("v", "p", "w", "m", "mid")
    if size.n:
        got = live.coalesce(1).mapInArrow(lambda it: _finish(want_paths, it), FOUND)
        ends = pile.read().select(F.col("v").alias("top"), F.col("root").alias("own"))
        got = stored(got).join(ends, "top", "left")
        pile.add(got.withColumn("root", F.coalesce("root", "own")))
    salts = max(2, tasks)
    for gone in reversed(left):
        found = pile.read()
        up = found.select(F.col("v").alias("p"), F.col("root").alias("proot"), F.col("depth").alias("pdepth"), F.col("way").alias("pway"))
        if hot:
            spread = F.when(F.col("p").isin(hot), F.pmod(F.xxhash64("v"), F.lit(salts))).otherwise(F.lit(0)).cast("int")
            up = up.withColumn("s", F.explode(F.when(F.col("p").isin(hot), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
            got = gone.withColumn("s", spread).join(up, ["p", "s"])
        else:
            got = gone.join(up, "p")
        on = found.where("on_cycle = 1").select(F.col("v").alias("c"), F.lit(1).alias("on_cycle"))
        got = got.join(on, "c", "left").withColumn("on_cycle", F.coalesce("on_cycle", F.lit(0)))
        off = F.col("on_cycle") == 0
        pile.add(got.select(
            "v",
            F.col("proot").alias("root"),
            "on_cycle",
            F.when(off, F.col("pdepth") + F.col("w")).otherwise(F.lit(0)).alias("depth"),
            (F.when(off, F.concat("pway", F.array("p"), mid)).otherwise(empty) if want_paths else none).alias("way"),
            none.alias("ring"),
        ))
    out = pile.read().withColumn("depth", F.col("depth").cast("int"))
    return out if want_paths else out.drop("way", "ring")


def paths(links: DataFrame, child: str = "child", parent: str = "parent", finish: int = FINISH) -> DataFrame:
    """(v, root, depth, on_cycle, path): ``path`` runs from the root to the vertex, joined by '/'.

    The path of a vertex below a cycle starts at the vertex of the cycle where
    its way up ends; a vertex on a cycle has itself as path.
    """
    at = resolve(links, child, parent, True, finish)
    return at.select("v", "root", "depth", "on_cycle", F.array_join(F.concat("way", F.array("v")), "/").alias("path"))


def ancestors(links: DataFrame, child: str = "child", parent: str = "parent", finish: int = FINISH) -> DataFrame:
    """(v, ancestor, distance): each vertex with all strict ancestors; the reverse view is all descendants.

    The pairs are read off the ways up. Vertices on or below a cycle have every vertex of the cycle once, at its
    distance going up; to a vertex on the cycle itself is no ancestor.
    """
    at = stored(resolve(links, child, parent, True, finish))
    ways = at.select("v", "depth", F.posexplode("way").alias("i", "ancestor"))
    off = ways.select("v", "ancestor", (F.col("depth") - F.col("i")).cast("int").alias("distance"))
    places = at.where("ring is not null").select("root", F.size("ring").alias("n"), F.posexplode("ring").alias("place", "on"))
    # a vertex below a cycle comes to it at the first vertex of its way, which is in ``off``
    entry = at.select("v", "root", "depth", F.when(F.col("on_cycle") == 1, F.col("v")).otherwise(F.get("way", F.lit(0))).alias("entry"))
    entry = entry.join(places.select(F.col("on").alias("entry"), F.col("place").alias("first")), "entry")
    around = entry.join(places, "root").where("on <> entry")
    ring = around.select("v", F.col("on").alias("ancestor"), (F.col("depth") + F.pmod(F.col("place") - F.col("first"), F.col("n"))).cast("int").alias("distance"))
    return off.unionByName(ring)


def descendant_counts(links: DataFrame, child: str = "child", parent: str = "parent") -> DataFrame:
    """(v, n_below): the number of strict descendants of every vertex, 0 for leaves; off cycles only."""
    at = stored(resolve(links, child, parent, True))
    per = at.select(F.explode("way").alias("v")).groupBy("v").agg(F.count("*").alias("n"))
    return at.where("on_cycle = 0").join(per, "v", "left").select("v", F.coalesce("n", F.lit(0)).alias("n_below"))
