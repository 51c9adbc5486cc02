"""Keys that hold most rows: fragment-replicate by estimated load.

A key's load is estimated by that of its hash bucket: one histogram over all
rows, with map-side partial counts. A driver-side plan, whose size depends on the
number of tasks alone, packs buckets into tasks (largest first, each into the
task with the least load) and splits a bucket of more than half a task's share
into proportionate shards. Rows go to the task the plan names through
``repartitionById``, and whatever is counted or joined there needs no further shuffle;
the matching side of a join is copied only to the tasks that hold shards of its key.

The plan reaches the tasks as three arrays of numbers, looked up by bucket, so its
expressions are as small for a thousand tasks as for eight, and no key is on the driver.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ancestra.session import tasks_of

#: Hash buckets a task; the histogram and the plan have this many rows a task.
BUCKETS_PER_TASK = 64


def _ints(values: list[int]) -> Column:
    """One array literal."""
    return F.from_json(F.lit("[" + ",".join(map(str, values)) + "]"), "array<int>")


def _columns(key: str | list[str]) -> list[Column]:
    return [F.col(f"`{k}`") for k in ([key] if isinstance(key, str) else key)]


@dataclass
class FragmentPlan:
    """Where each key's rows go.

    Bucket ``b`` has the tasks ``slots[first[b]]`` to ``slots[first[b] + width[b] - 1]``, all different:
    one if it is light, one a shard if it is heavy. ``loads`` are the rows planned for each task.
    """

    tasks: int
    first: list[int]
    width: list[int]
    slots: list[int]
    loads: list[int] = field(default_factory=list)

    def bucket(self, key: list[Column], otherwise: Column | None = None) -> Column:
        h = F.xxhash64(*key)
        if otherwise is not None:
            h = F.when(reduce(lambda a, b: a & b, [k.isNull() for k in key]), otherwise).otherwise(h)
        return F.pmod(h, F.lit(len(self.first))).cast("int") + 1

    def parts(self, key: list[Column]) -> Column:
        """In how many tasks rows of the key are."""
        return F.element_at(_ints(self.width), self.bucket(key))

    def task(self, key: list[Column], spread: Column) -> Column:
        """The task of a row: rows that agree in key and ``spread`` have the same. Null keys go by ``spread``."""
        b = self.bucket(key, spread)
        at = F.element_at(_ints(self.first), b) + F.pmod(spread, F.element_at(_ints(self.width), b)).cast("int")
        return F.coalesce(F.element_at(_ints(self.slots), at + 1), F.lit(0))  # never null, so no filter for that parts plans that share a shuffle

    def task_list(self, key: list[Column]) -> Column:
        """All tasks that hold rows of a key, for the matching side."""
        b = self.bucket(key)
        return F.slice(_ints(self.slots), F.element_at(_ints(self.first), b) + 1, F.element_at(_ints(self.width), b))


def plan_fragments(df: DataFrame, key: str | list[str], tasks: int | None = None) -> FragmentPlan:
    """Estimate loads by hash bucket of the key and pack them into tasks.

    A shard has at most half a task's share of the rows, so there are fewer than ``BUCKETS_PER_TASK * tasks``
    entries besides ``4 * tasks`` shards however many rows and keys there are. An empty table gives a plan without shards.
    """
    tasks = tasks or tasks_of(df.sparkSession)
    buckets = tasks * BUCKETS_PER_TASK
    keys = _columns(key)
    held = df.where(reduce(lambda a, b: a | b, [k.isNotNull() for k in keys]))
    counts = held.groupBy(F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int").alias("b")).count().collect()  # one row a bucket
    load = {r.b: r["count"] for r in counts}
    most = max(1.0, sum(load.values()) / tasks / 2)
    items = [(n / p, b) for b in range(buckets) for n in [load.get(b, 0)] for p in [max(1, math.ceil(n / most))] for _ in range(p)]
    heap = [(0.0, t) for t in range(tasks)]
    own: list[list[int]] = [[] for _ in range(buckets)]
    for n, b in sorted(items, key=lambda x: (-x[0], x[1])):
        at, t = heapq.heappop(heap)
        own[b].append(t)
        heapq.heappush(heap, (at + n, t))
    first, width, slots = [], [], []
    for ts in own:
        ts = sorted(set(ts))
        first.append(len(slots))
        width.append(len(ts))
        slots += ts
    return FragmentPlan(tasks, first, width, slots, [round(n) for n, _ in sorted(heap, key=lambda x: x[1])])


def placed(df: DataFrame, key: str | list[str], plan: FragmentPlan, by: list[str] | None = None) -> DataFrame:
    """``df`` with ``__task``, every row in the task the plan names.

    Rows that agree in the key and in the columns ``by`` (all that can be hashed, if not given) are in one
    task, so grouping or joining by ``__task`` and these shuffles nothing more.
    """
    names = by if by is not None else [c for c, t in df.dtypes if not t.startswith(("map", "variant"))]
    spread = F.xxhash64(*[F.col(f"`{c}`") for c in names])
    return df.withColumn("__task", plan.task(_columns(key), spread)).repartitionById(plan.tasks, F.col("__task"))


def copied(df: DataFrame, key: str | list[str], plan: FragmentPlan, to: str = "__to") -> DataFrame:
    """The matching side: each row once in every task, ``to``, that holds rows of its key. Rows with a null in the key match nothing and go."""
    held = df.where(reduce(lambda a, b: a & b, [k.isNotNull() for k in _columns(key)]))
    return held.withColumn(to, F.explode(plan.task_list(_columns(key)))).repartitionById(plan.tasks, F.col(to))


def pinned(df: DataFrame) -> DataFrame:
    """``df`` as it is, but no join above is moved below it: Spark would push a semi or anti join under the shuffle that put rows in their tasks."""
    return df.withColumn("__pin", F.monotonically_increasing_id())


def unpinned(df: DataFrame) -> DataFrame:
    return df.where("__pin >= 0").drop("__pin")


def _unused(name: str, taken: set[str]) -> str:
    while name in taken:
        name += "_"
    return name


def balanced_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner", on: Column | None = None, plan: FragmentPlan | None = None) -> DataFrame:
    """Join ``left`` with ``right`` on a column ``key`` of both, with heavy keys split over tasks.

    ``how`` is inner, left, left_semi or left_anti. ``on`` is a further
    condition over both sides. Rows of ``left`` are sharded, rows of
    ``right`` copied to the shards of their key, so each left row meets every
    match exactly once. Null keys match nothing: inner and left_semi leave
    them out, left and left_anti keep them. The key comes out once, from the
    left; a column of ``right`` with the name of one of ``left`` comes out with
    ``_right`` after it, and in ``on`` the name means the left one.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"how: {how}")
    clash = (set(left.columns) & set(right.columns)) - {key}
    if how in ("inner", "left"):
        right = right.withColumnsRenamed({c: _unused(f"{c}_right", {*left.columns, *right.columns}) for c in clash})
    else:
        right = right.drop(*clash)
    plan = plan or plan_fragments(left, key)
    a = placed(left, key, plan)
    b = copied(right, key, plan).withColumnRenamed(key, "__key")
    cond = [F.col("__task") == F.col("__to"), F.col(key) == F.col("__key")] + ([on] if on is not None else [])
    cond = reduce(lambda x, y: x & y, cond)
    if how in ("left_semi", "left_anti"):
        return unpinned(pinned(a).join(b, cond, how)).select(*left.columns)
    return a.join(b, cond, how).drop("__task", "__to", "__key")


def balanced_counts(df: DataFrame, key: str | list[str], of: str, out: str = "n", plan: FragmentPlan | None = None, least: int = 0) -> DataFrame:
    """(key..., out): how many distinct values of ``of`` each key has, of those with at least ``least``.

    One shuffle puts rows in the tasks the plan names. Rows of a heavy key are sharded by ``of``, so a task counts values
    nobody else has; its partial counts are merged per key. Only keys with several shards
    can grow by that, so what is below ``least`` is left out before. Null values and keys with a null aren't counted.
    """
    names = [key] if isinstance(key, str) else key
    plan = plan or plan_fragments(df, key)
    rows = placed(df.select(*names, of).dropna(), names, plan, [of])
    part = rows.groupBy("__task", *names, of).agg(F.lit(1).alias("__one")).groupBy("__task", *names).agg(F.count("*").alias("__n"))
    if least > 1:
        part = part.where((F.col("__n") >= least) | (plan.parts(_columns(names)) > 1))
    return part.groupBy(*names).agg(F.sum("__n").alias(out)).where(F.col(out) >= least)
