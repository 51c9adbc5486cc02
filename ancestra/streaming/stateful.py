"""Streaming forms of the filters that keep state, and the commit of a stream to several sinks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ancestra.operators import transformers
from ancestra.streaming import filters


def deduplicate(rows: DataFrame, at: str = "event_time", late: str = "1 hour") -> DataFrame:
    """Each id once, as long as its copies come within the watermark of each other."""
    return rows.withWatermark(at, late).dropDuplicatesWithinWatermark(["id"])


def _kept_state(state: GroupState, start):
    """(value, until) of a key; None if its time has passed, and the state is gone then."""
    if state.hasTimedOut:
        state.remove()
        return None
    return state.get if state.exists else (start, 0)


def _keep_state(state: GroupState, value, until: int) -> None:
    """Keep a key's value until the watermark is past ``until``."""
    state.update((value, until))
    state.setTimeoutTimestamp(max(until, state.getCurrentWatermarkMs() + 1))


def _later(until: int, times: pd.Series, idle_ms: int) -> int:
    times = times.dropna()
    return max(until, int(times.max().timestamp() * 1000) + idle_ms) if len(times) else until


def _changes(flat: DataFrame, keys: list[str], values: list[str], late: str, idle_ms: int) -> DataFrame:
    """The rows (seq, keys..., values..., event_time) at which a key's values differ from those of its row before, by ``seq`` within a batch.

    The state of a key is one text, and is dropped when the watermark is ``idle_ms`` past its last row.
    """
    out = ["seq", *keys, *values]
    types = dict(flat.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in out)

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = _kept_state(state, None)
        if held is None:
            return
        last, until = held
        for part in parts:
            keep = []
            for row in part.sort_values("seq")[[*out, "event_time"]].itertuples(index=False):
                now = repr(tuple(None if pd.isna(x) else x for x in row[1 + len(keys) : -1]))
                if now != last:
                    keep.append(row[:-1])
                last = now
            until = _later(until, part["event_time"], idle_ms)
            if keep:
                yield pd.DataFrame(keep, columns=out)
        _keep_state(state, last, until)

    watermarked = flat.select(*out, "event_time").withWatermark("event_time", late)
    return watermarked.groupBy(*keys).applyInPandasWithState(run, schema, "last string, until bigint", "append", GroupStateTimeout.EventTimeTimeout)


def drop_repeat_edges(rows: DataFrame, by: list[str], late: str = "1 hour", idle_ms: int = 3_600_000) -> DataFrame:
    """(seq, child, parent, by_0, ...) of edges whose ``by`` annotations differ from those of the edge before between the same ends."""
    names = [f"by_{i}" for i in range(len(by))]
    flat = rows.where("kind = 'edge'").select("seq", "child", "parent", *[F.col("annotations")[k].alias(n) for k, n in zip(by, names, strict=True)], "event_time")
    return _changes(flat, ["child", "parent"], names, late, idle_ms)


def io_runs(rows: DataFrame, *keys: str, late: str = "1 hour", idle_ms: int = 3_600_000) -> DataFrame:
    """(seq, file, process, operation) of the first read of a run of reads, and of the first write of a run of writes, between an artifact (by ``keys``) and a process."""
    kind = F.col("annotations")["type"]
    io = rows.where(F.col("kind") == "edge").where(kind.isin("Used", "WasGeneratedBy"))
    used = kind == "Used"
    named = lambda a: F.when(F.size(F.filter(F.array(*[F.col(a)[k] for k in keys]), lambda x: x.isNull())) == 0, F.concat_ws("\x00", *[F.col(a)[k] for k in keys]))
    flat = io.select("seq", F.when(used, named("pa")).otherwise(named("ca")).alias("file"), F.when(used, F.col("child")).otherwise(F.col("parent")).alias("process"), F.when(used, "read").otherwise("write").alias("operation"), "event_time")
    return _changes(flat.where("file is not null and process is not null"), ["file", "process"], ["operation"], late, idle_ms)


def version_process(rows: DataFrame, key: str = "version", initial: int = 0, chain: tuple[str, str] = ("edge_type", "versioning"), late: str = "1 hour", idle_ms: int = 3_600_000) -> DataFrame:
    """The edges of ``filters.version_process`` for a stream: reads with the new version of their process, and the links to the version before.

    The state of a process is how many reads it has had. Vertices come with their edges, as annotations of ends.
    """
    used = rows.where((F.col("kind") == "edge") & filters.of_type("annotations", "Used") & filters.of_type("ca", "Process") & filters.of_type("pa", "Artifact"))
    maps = ["annotations", "ca", "pa"]
    flat = used.select("child", "seq", "source", *[F.to_json(m).alias(m) for m in maps], "event_time").withWatermark("event_time", late)
    out = ["seq", "source", *maps, "event_time", "n"]
    schema = "seq bigint, source string, annotations string, ca string, pa string, event_time timestamp, n bigint"

    def run(_: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = _kept_state(state, 0)
        if held is None:
            return
        n, until = held
        for part in parts:
            part = part.sort_values("seq")
            part["n"] = range(n, n + len(part))
            n += len(part)
            until = _later(until, part["event_time"], idle_ms)
            yield part[out]
        _keep_state(state, n, until)

    e = flat.groupBy("child").applyInPandasWithState(run, schema, "n bigint, until bigint", "append", GroupStateTimeout.EventTimeTimeout)
    e = e.withColumns({m: F.from_json(m, filters.MAP) for m in maps})
    at = lambda x: transformers.put(F.col("ca"), key, x.cast("string"))
    new = at(F.col("n") + initial + 1)
    both = F.array(F.struct(new.alias("ca"), F.col("pa").alias("pa"), F.col("annotations").alias("a")), F.struct(new.alias("ca"), at(F.col("n") + initial).alias("pa"), F.create_map(F.lit(chain[0]), F.lit(chain[1])).alias("a")))
    x = e.select("seq", "source", "event_time", F.explode(both).alias("x"))
    return filters._edge_rows(x, F.col("x.ca"), F.col("x.pa"), F.col("x.a"))


def nearest_calls(edges: DataFrame, calls: DataFrame, key: str, window: str, late: str = "1 minute") -> DataFrame:
    """Stream-stream join of edges and call sites of the same key whose times lie within half a window: state is dropped as the watermark passes."""
    a = edges.withWatermark("event_time", late).alias("a")
    b = calls.withWatermark("event_time", late).alias("b")
    near = F.expr(f"b.event_time >= a.event_time - interval {window} and b.event_time < a.event_time + interval {window}")
    return a.join(b, (F.col(f"a.{key}") == F.col(f"b.{key}")) & near)


def commit(rows: DataFrame, sinks: list[Callable[[DataFrame, int], None]], checkpoint: str):
    """Every batch to every sink; a batch is kept while they write, so it is computed once. ``checkpoint`` must be in a folder all executors share."""

    def each(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            for sink in sinks:
                sink(batch, number)
        finally:
            batch.unpersist()

    return rows.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
