"""Attribute-value rows into wide, typed tables.

Rows are first reduced to one per entity and attribute in the JVM, with
map-side partial aggregation, so an entity that holds a third of all rows
becomes as many rows as it has attributes. Entities are then hash-bucketed,
and each bucket is pivoted with Arrow: entity and attribute are dictionary
encoded, values scattered into one numpy array per type by row and column
index, and the result emitted as Arrow tables. What the typed columns can't
hold is in ``rest``: the two tables together have every value.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ancestra.functions.identity import BLANKS, canon_name
from ancestra.operators.skew import balanced_join

#: What denotes a whole number, and what a decimal one, blanks around it aside.
WHOLE = r"^[+-]?([0-9]+|[0-9]{1,3}(,[0-9]{3})+)(\.0+)?$"
HEX = r"^0[xX][0-9a-fA-F]+$"
DECIMAL = r"^[+-]?([0-9]+|[0-9]{1,3}(,[0-9]{3})+)(\.[0-9]+)?([eE][+-]?[0-9]{1,3})?$"


#: What stands for whole numbers too long to be told apart.
BEYOND = "9" * 38


def whole_number(c: Column) -> Column:
    """The whole number a text denotes, as decimal(38,0), or null.

    One of more than 37 digits, or of more than 16 hexadecimal ones, after leading zeros, is BEYOND: it has no place in a column,
    but still contradicts any number that has.
    """
    t = F.btrim(c, F.lit(BLANKS + " "))
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"\.0+$", ""), ",", ""), r"^([+-]?)0+(?=[0-9])", "$1")
    digits = F.regexp_extract(t, r"^0[xX]0*([0-9a-fA-F]*)$", 1)
    beyond = F.lit(BEYOND).cast("decimal(38,0)")
    return (
        F.when(t.rlike(WHOLE), F.when(F.length(plain) > 38, beyond).otherwise(F.coalesce(plain.try_cast("decimal(38,0)"), beyond)))
        .when(t.rlike(HEX), F.when(F.length(digits) > 16, beyond).otherwise(F.conv(F.when(digits == "", "0").otherwise(digits), 16, 10).try_cast("decimal(38,0)")))
    )


def real_number(c: Column) -> Column:
    """The number a decimal text denotes, as double, or null."""
    t = F.btrim(c, F.lit(BLANKS + " "))
    return F.when(t.rlike(DECIMAL), F.regexp_replace(t, ",", "").try_cast("double"))


def reduced(df: DataFrame, ident: list[str], field: str, value: str) -> DataFrame:
    """(ident..., field, whole, real, text, n_values): one row per entity and attribute.

    Attribute names compare without case and outer blanks. ``whole`` is the
    whole number that all values denoting one agree on, ``real`` the number
    likewise (null if they contradict each other or none is one), ``text`` the
    smallest non-blank text, ``n_values`` the count of non-null values. Rows with
    a null entity or a null or blank attribute are left out. Entity columns named like
    one of the results raise ValueError; further columns are ignored.
    """
    if clash := set(ident) & {"field", "whole", "real", "text", "n_values"}:
        raise ValueError(f"entity columns have names of results: {sorted(clash)}")
    rows = df.select(*ident, canon_name(field).alias("field"), whole_number(F.col(value)).alias("__w"), real_number(F.col(value)).alias("__r"), F.nullif(F.btrim(F.col(value), F.lit(BLANKS)), F.lit("")).alias("__t"))
    rows = rows.dropna(subset=[*ident, "field"])
    per = rows.groupBy(*ident, "field").agg(F.min("__w").alias("__w0"), F.max("__w").alias("__w1"), F.min("__r").alias("__r0"), F.max("__r").alias("__r1"), F.min("__t").alias("text"), F.count("__t").alias("n_values"))
    fits = F.col("__w0").between(F.lit(-(2**63)).cast("decimal(38,0)"), F.lit(2**63 - 1).cast("decimal(38,0)"))
    return per.select(*ident, "field", F.when((F.col("__w0") == F.col("__w1")) & fits, F.col("__w0").cast("bigint")).alias("whole"), F.when(F.col("__r0") == F.col("__r1"), F.col("__r0")).alias("real"), "text", "n_values")


def attribute_types(per: DataFrame, least_share: float = 0.9) -> list[tuple[str, str]]:
    """(attribute, type) of all attributes, from the reduced rows.

    An attribute is ``bigint`` if at least ``least_share`` of its entities have a
    whole number, else ``double`` if as many have a number, else ``string``. What comes to
    the driver is one row per attribute: the columns of the wide table.
    """
    n = per.groupBy("field").agg(F.count("text").alias("n"), F.count("whole").alias("w"), F.count("real").alias("r"))
    kind = F.when((F.col("w") > 0) & (F.col("w") >= F.col("n") * least_share), "bigint").when((F.col("r") > 0) & (F.col("r") >= F.col("n") * least_share), "double").otherwise("string")
    return [(r.field, r.kind) for r in n.select("field", kind.alias("kind")).orderBy("field").collect()]


def pivot_wide(per: DataFrame, ident: list[str], columns: list[tuple[str, str]]) -> DataFrame:
    """One row per entity, one typed column per (attribute, type) of ``columns``.

    ``per`` are reduced rows. Entities without any of the attributes don't
    appear; a missing or contradictory attribute is null. Attribute names equal to
    an entity column get the prefix ``attr ``. A bucket is cut into tables of whole
    entities, so memory follows the batch and not the bucket. An empty table gives no rows.
    """
    names = [c for c, _ in columns]
    outs = [f"attr {c}" if c in ident else c for c in names]
    kinds = dict(columns)
    arrow = {"bigint": pa.int64(), "double": pa.float64(), "string": pa.string()}
    source = {"bigint": "whole", "double": "real", "string": "text"}
    types = dict(per.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in ident) + "".join(f", `{o.replace('`', '``')}` {kinds[c]}" for o, c in zip(outs, names, strict=True))
    place = {c: i for i, c in enumerate(names)}

    def scatter(table: pa.Table) -> pa.RecordBatch:
        table = table.combine_chunks()
        keys = [table.column(c).combine_chunks() for c in ident]
        codes = np.zeros(len(table), np.int64)
        for k in keys:
            d = k.dictionary_encode()
            codes = codes * len(d.dictionary) + d.indices.to_numpy(zero_copy_only=False)
        _, first, row = np.unique(codes, return_index=True, return_inverse=True)
        enc = table.column("field").combine_chunks().dictionary_encode()
        to = np.array([place[f] for f in enc.dictionary.to_pylist()], np.int64) if len(enc.dictionary) else np.zeros(0, np.int64)
        col = to[enc.indices.to_numpy(zero_copy_only=False)] if len(table) else np.zeros(0, np.int64)
        grids = {}
        for kind in set(kinds.values()):
            held = table.column(source[kind]).combine_chunks()
            empty = {"bigint": 0, "double": 0.0, "string": None}[kind]
            own = np.array([kinds[c] == kind for c in names])
            at = np.cumsum(own) - 1  # the column within the grid of its type
            grid = np.full((len(first), own.sum()), empty, dtype={"bigint": np.int64, "double": np.float64, "string": object}[kind])
            valid = np.zeros(grid.shape, bool)
            there = held.is_valid().to_numpy(zero_copy_only=False) & own[col]
            values = (held.fill_null(empty) if kind != "string" else held).to_numpy(zero_copy_only=False)
            grid[row[there], at[col[there]]] = values[there]
            valid[row[there], at[col[there]]] = True
            grids[kind] = grid, valid, at
        arrays = [k.take(pa.array(first)) for k in keys]
        for i, c in enumerate(names):
            grid, valid, at = grids[kinds[c]]
            arrays.append(pa.array(grid[:, at[i]], arrow[kinds[c]], mask=~valid[:, at[i]]))
        return pa.RecordBatch.from_arrays(arrays, names=[*ident, *outs])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for b in batches:
            if not len(b):
                continue
            t = pa.Table.from_batches([b])
            t = t if rest is None else pa.concat_tables([rest, t])
            last = {c: t.column(c)[len(t) - 1] for c in ident}
            cut_at = len(t)  # the rows are sorted by entity: the last one may go on in the next batch
            while cut_at and all(t.column(c)[cut_at - 1] == last[c] for c in ident):
                cut_at -= 1
            if cut_at:
                yield scatter(t.slice(0, cut_at))
            rest = t.slice(cut_at)
        if rest is not None and len(rest):
            yield scatter(rest)

    rows = per.where(F.col("field").isin(names)).select(*ident, "field", "whole", "real", "text")
    return rows.repartition(*ident).sortWithinPartitions(*ident).mapInArrow(run, schema)


def rest(df: DataFrame, per: DataFrame, ident: list[str], field: str, value: str, columns: list[tuple[str, str]]) -> DataFrame:
    """(ident..., field, value): the distinct texts of each entity and attribute that its cell of ``pivot_wide`` doesn't stand for.

    ``per`` are the reduced rows of ``df``, ``columns`` as for ``pivot_wide``. A cell stands for the texts that denote
    its number (if a decimal one, in at most 15 digits), or for its very text. So where values contradict each
    other, or aren't of the column's type, all of them are here. Blanks around a value aren't kept, null and blank values are none.
    """
    t = F.nullif(F.btrim(F.col(value), F.lit(BLANKS)), F.lit(""))
    rows = df.select(*ident, canon_name(field).alias("field"), t.alias("value")).dropna(subset=[*ident, "field", "value"]).distinct()
    kinds = F.broadcast(df.sparkSession.createDataFrame(columns, "field string, __kind string"))
    cells = per.join(kinds, "field").select(*ident, "field", "__kind", "whole", "real", "text")
    exact = F.length(F.regexp_replace("value", "[^0-9]", "")) <= 15
    same = (
        F.when(F.col("__kind") == "bigint", whole_number(F.col("value")) == F.col("whole"))
        .when(F.col("__kind") == "double", (real_number(F.col("value")) == F.col("real")) & exact)
        .otherwise(F.col("value") == F.col("text"))
    )
    own = F.to_json(F.struct(*ident, "field")).alias("__own")
    both = balanced_join(rows.select("*", own), cells.select(own, "__kind", "whole", "real", "text"), "__own")
    return both.where(~F.coalesce(same, F.lit(False))).select(*ident, "field", "value")
