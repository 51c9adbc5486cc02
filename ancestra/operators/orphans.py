"""References to records that don't exist, no longer exist or arrive later."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ancestra.operators.skew import FragmentPlan, copied, pinned, placed, plan_fragments, unpinned


def references(rows: DataFrame, ident: str, fields: dict[str, str], at: str) -> DataFrame:
    """(ident, endpoint, ref, at): the non-null references of ``rows``, one for every row and endpoint.

    ``fields`` maps the name of an endpoint to its column.
    """
    ends = F.explode(F.array(*[F.struct(F.lit(n).alias("endpoint"), F.col(c).alias("ref")) for n, c in fields.items()]))
    flat = rows.where(F.col(ident).isNotNull()).select(F.col(ident).alias("ident"), F.col(at).alias("at"), ends.alias("e"))
    return flat.select("ident", "e.endpoint", "e.ref", "at").where("ref is not null")


def missing(refs: DataFrame, keys: DataFrame, since: str | None = None, until: str | None = None, plan: FragmentPlan | None = None) -> DataFrame:
    """(ident, endpoint, ref): the distinct references that no row of ``keys(ref, ...)`` satisfies.

    The distinct (ref, at) pairs are anti-joined with the keys, and those left joined back to the references. Repeated
    references count once, dated by the earliest ``at``. With ``since`` and ``until`` a key counts only for
    references dated from ``since`` up to, not including, ``until`` (null: without end). A null date or a null
    ``since`` satisfies nothing. Without them dates don't matter.

    References are skewed (many rows name one parent), so they go where ``plan`` puts them, heavy keys in shards by
    ``ident``, and the few key rows are copied to those tasks. That is the only shuffle: repeated references, distinct pairs, anti-join and join back are all found within a task.
    """
    plan = plan or plan_fragments(refs, "ref")
    at = F.coalesce(F.unix_micros("at"), F.lit(-(2**63))) if since else F.lit(0).cast("bigint")
    here = placed(refs.select("ident", "endpoint", "ref", at.alias("__at")), "ref", plan, ["ident"])
    one = here.groupBy("__task", "ref", "ident", "endpoint").agg(F.min("__at").alias("__at"))
    pairs = one.select("__task", "ref", "__at").distinct()
    cols = [F.col("ref").alias("__key")]
    cond = [F.col("__task") == F.col("__to"), F.col("ref") == F.col("__key")]
    if since:
        cols.append(F.unix_micros(since).alias("__since"))
        cond.append(F.col("__since") <= F.col("__at"))
        if until:
            cols.append(F.unix_micros(until).alias("__until"))
            cond.append(F.col("__until").isNull() | (F.col("__at") < F.col("__until")))
    there = copied(keys.select(*cols).where(F.col("__since").isNotNull() if since else F.lit(True)), "__key", plan)
    lost = unpinned(pinned(pairs).join(there, reduce(lambda a, b: a & b, cond), "left_anti"))
    back = lost.select(F.col("__task").alias("__t"), F.col("ref").alias("__r"), F.col("__at").alias("__a"))
    return one.join(back, (F.col("__task") == F.col("__t")) & (F.col("ref") == F.col("__r")) & (F.col("__at") == F.col("__a")), "left_semi").select("ident", "endpoint", "ref")


def report(refs: DataFrame, lost: DataFrame, periods: DataFrame, period: str) -> DataFrame:
    """Orphans joined back for counts per endpoint and period.

    ``periods`` has the period of each ``ident`` (null where unknown, a period
    of its own). Gives (endpoint, period, n_refs, n_orphans).
    """
    marked = refs.select("ident", "endpoint", F.lit(0).alias("lost")).unionByName(lost.select("ident", "endpoint", F.lit(1).alias("lost")))
    per = marked.groupBy("ident", "endpoint").agg(F.max("lost").alias("lost"))
    named = per.join(periods.groupBy("ident").agg(F.min(period).alias("period")), "ident", "left")
    return named.groupBy("endpoint", "period").agg(F.count("*").alias("n_refs"), F.sum("lost").alias("n_orphans"))
