"""Deeply nested records into related flat tables.

One Arrow pass reads each JSON text, drops wrappers that only name a type, takes
named arrays as arrays however they were written, and explodes them level by level
into child items that carry record key, surrogate keys of item and parent, parent path and ordinal. Nothing is
shuffled, and neither the length of a value nor the depth of a record is limited.
``flat_table`` gives the flat table of the records or of one array, with the
columns of the merged schema of all of its rows, which a first pass infers.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from json.decoder import scanstring

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: One-field objects with these names only state the type of what they hold.
TYPE_WRAPPERS = frozenset("array map string bytes int long float double boolean enum record".split())

#: Items, or characters of them, after which the Arrow pass gives out a batch.
BATCH_ROWS, BATCH_CHARS = 50_000, 1 << 24

#: An object with more distinct keys over all rows is a map with data for keys, and one column of JSON text.
MOST_KEYS = 200


def _wrapper(name: str) -> bool:
    return name in TYPE_WRAPPERS or re.fullmatch(r"\w+(\.\w+)+", name) is not None


def unwrap(value):
    while isinstance(value, dict) and len(value) == 1 and _wrapper(next(iter(value))):
        value = next(iter(value.values()))
    return value


def _refuse(name: str):
    raise ValueError(name)


def _finite(text: str) -> float | str:
    """A number, or its text where no double holds it."""
    x = float(text)
    return text if x in (float("inf"), float("-inf")) else x


def _whole(text: str) -> int | str:
    """A whole number, or its text where it has more digits than Python reads."""
    return int(text) if len(text) <= 4000 else text


BLANK = re.compile(r"[ \t\n\r]*")
PLAIN = re.compile(r"(-?(?:0|[1-9][0-9]*))(\.[0-9]+)?([eE][-+]?[0-9]+)?|true|false|null")


def _parse_deep(text: str):
    """``parse`` of a text at any depth, with a stack of its own."""
    at, stack, root = 0, [], [None]
    put = lambda v: root.__setitem__(0, v)
    skip = lambda i: BLANK.match(text, i).end()

    def key(i: int) -> int:
        nonlocal put
        if text[i : i + 1] != '"':
            raise ValueError("key")
        k, i = scanstring(text, i + 1, True)
        i = skip(i)
        if text[i : i + 1] != ":":
            raise ValueError("colon")
        put = lambda v, d=stack[-1], k=k: d.__setitem__(k, v)
        return skip(i + 1)

    at = skip(0)
    while True:
        c = text[at : at + 1]
        if c in ("{", "["):
            made = {} if c == "{" else []
            put(made)
            stack.append(made)
            at = skip(at + 1)
            if text[at : at + 1] != ("}" if c == "{" else "]"):
                if c == "{":
                    at = key(at)
                else:
                    put = made.append
                continue
        elif c == '"':
            value, at = scanstring(text, at + 1, True)
            put(value)
        elif m := PLAIN.match(text, at):
            word = m.group()
            put({"true": True, "false": False, "null": None}[word] if m.group(1) is None else _finite(word) if m.group(2) or m.group(3) else _whole(word))
            at = m.end()
        else:
            raise ValueError("value")
        while stack:
            at = skip(at)
            c = text[at : at + 1]
            if c == ("}" if isinstance(stack[-1], dict) else "]"):
                stack.pop()
                at += 1
            elif c == ",":
                at = skip(at + 1)
                if isinstance(stack[-1], dict):
                    at = key(at)
                else:
                    put = stack[-1].append
                break
            else:
                raise ValueError("separator")
        else:
            if skip(at) != len(text):
                raise ValueError("rest")
            return root[0]


def parse(text: str):
    """The value of a complete JSON text; anything else raises ValueError. Numbers that Python can't hold come as their text."""
    try:
        return json.loads(text, parse_constant=_refuse, parse_float=_finite, parse_int=_whole)
    except RecursionError:
        return _parse_deep(text)


def dump(value) -> str:
    """``value`` as JSON text, at any depth."""
    try:
        return json.dumps(value, separators=(",", ":"))
    except RecursionError:
        pass
    out, stack = [], [value]
    while stack:
        v = stack.pop()
        if isinstance(v, _Raw):
            out.append(v)
        elif isinstance(v, dict):
            parts = [x for k, y in v.items() for x in (_Raw("," + json.dumps(k) + ":"), y)]
            parts[:1] = [_Raw(x[1:]) for x in parts[:1]]
            stack += [_Raw("}"), *reversed(parts), _Raw("{")]
        elif isinstance(v, list):
            parts = [x for y in v for x in (_Raw(","), y)][1:]
            stack += [_Raw("]"), *reversed(parts), _Raw("[")]
        else:
            out.append(json.dumps(v))
    return "".join(out)


class _Raw(str):
    """Text that is already JSON."""


def _as_list(value) -> list | None:
    """The items of a named array, however it is written; None for null."""
    value = unwrap(value)
    if isinstance(value, str):
        text = value.strip()
        if text[:1] in ("[", "{"):
            try:
                value = unwrap(parse(text))
            except ValueError:
                pass
    if value is None or isinstance(value, list):
        return value
    return [value]


def canonical(value, arrays: frozenset[str]):
    """``value`` without wrappers and with every array named in ``arrays`` as a list."""
    root = [value]
    todo: list[tuple] = [(root, 0)]
    while todo:
        into, at = todo.pop()
        v = unwrap(into[at])
        if isinstance(v, dict):
            v = {k: _as_list(x) if k in arrays else x for k, x in v.items()}
            todo += [(v, k) for k in v]
        elif isinstance(v, list):
            v = list(v)
            todo += [(v, i) for i in range(len(v))]
        into[at] = v
    return root[0]


def canonical_value(text: str | None, arrays: frozenset[str]) -> dict | None:
    """One record in one spelling; None if its text isn't one complete JSON object."""
    if text is None:
        return None
    try:
        body = canonical(parse(text), arrays)
    except ValueError:
        return None
    return body if isinstance(body, dict) else None


def canonical_text(text: str | None, arrays: frozenset[str]) -> str | None:
    """The text of ``canonical_value``."""
    body = canonical_value(text, arrays)
    return None if body is None else dump(body)


def normalise(df: DataFrame, key: str, text: str, arrays: list[str]) -> DataFrame:
    """(key, body): each record as a variant in one spelling; texts that aren't complete JSON objects are left out. What no variant can hold raises."""
    names = frozenset(arrays)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = pa.array([canonical_text(t, names) for t in b.column(1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), texts], names=[key, "body"])

    kind = dict(df.dtypes)[key]
    flat = df.select(key, F.col(text).cast("string").alias("body")).mapInArrow(run, f"`{key}` {kind}, body string")
    return flat.where("body is not null").select(key, F.parse_json("body").alias("body"))


def items_of(body: dict, arrays: frozenset[str]) -> Iterator[tuple[str, str, str, int, object, int, int]]:
    """(path, parent path, field, ordinal, item, number, parent's number) of every non-null item of the named arrays of a record, level by level.

    Items are numbered from 1 in this order, the record is 0: record and number are a surrogate key.
    """
    level: list[tuple[str, object, int]] = [("", body, 0)]
    number = 0
    while level:
        below: list[tuple[str, object, int]] = []
        for parent, item, own in level:
            todo = [(parent, item)]
            while todo:
                path, v = todo.pop()
                if isinstance(v, list):  # an array that isn't named, or an item that is one
                    todo += [(f"{path}[{i}]", y) for i, y in enumerate(v)]
                    continue
                for k, x in v.items() if isinstance(v, dict) else ():
                    here = f"{path}.{k}" if path else k
                    if k not in arrays:
                        todo.append((here, x))
                        continue
                    for i, y in enumerate(x or ()):
                        if y is not None:
                            at = f"{here}[{i}]"
                            number += 1
                            yield at, parent, k, i, y, number, own
                            below.append((at, y, number))
        level = below


def _well_formed(text: str) -> str:
    """``text`` with lone surrogates, which no column can hold, as question marks."""
    return text.encode("utf-8", "replace").decode()


def nested_items(df: DataFrame, key: str, text: str, arrays: list[str], values: bool = True) -> DataFrame:
    """(key, item_path, parent_path, field, ordinal, item, item_no, parent_no): every non-null item of the named arrays of JSON texts at any depth.

    ``item_no`` numbers the items of a record from 1, and ``parent_no`` is that of the item that holds the array, 0 for the record. Null items count for ordinals and paths, but give no rows, nor do null texts and those that aren't
    one complete JSON object. ``item`` is JSON text; without ``values`` it is null, which saves writing it.
    """
    names = frozenset(arrays)
    columns = [key, "item_path", "parent_path", "field", "ordinal", "item", "item_no", "parent_no"]
    kinds = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            owner: list[int] = []
            chars = 0

            def batch(b=b) -> pa.RecordBatch:
                key_column = b.column(0).take(pa.array(owner, pa.int64()))
                return pa.RecordBatch.from_arrays([key_column, *[pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)]], names=columns)

            for n in range(len(b)):
                body = canonical_value(b.column(1)[n].as_py(), names)
                for path, parent, field, i, v, no, own in items_of(body, names) if body is not None else ():
                    item = dump(v) if values else None
                    rows.append((_well_formed(path), _well_formed(parent), field, i, item, no, own))
                    owner.append(n)
                    chars += len(path) + len(parent) + len(item or "")
                    if len(rows) >= BATCH_ROWS or chars >= BATCH_CHARS:
                        yield batch()
                        rows, owner, chars = [], [], 0
            if rows:
                yield batch()

    kind = dict(df.dtypes)[key]
    return df.select(key, F.col(text).cast("string").alias("body")).mapInArrow(run, f"`{key}` {kind}, item_path string, parent_path string, field string, ordinal int, item string, item_no int, parent_no int")


def child_table(items: DataFrame, key: str, field: str, columns: dict[str, str]) -> DataFrame:
    """The flat table of one array: key, item_path, parent_path, ordinal and typed ``columns`` (name: type) of its items.

    An item that isn't an object has its value in a column ``value`` if that is
    asked for. A value that can't be read as its column's type is null.
    """
    v = F.parse_json("item")
    way = lambda c: f'$["{c}"]' if "'" in c else f"$['{c}']"
    scalar = F.try_variant_get(v, "$", columns["value"]) if "value" in columns else None
    cols = [F.coalesce(F.try_variant_get(v, way(c), t), scalar).alias(c) if c == "value" else F.try_variant_get(v, way(c), t).alias(c) for c, t in columns.items()]
    return items.where(F.col("field") == field).select(key, "item_path", "parent_path", "ordinal", *cols)


Way = tuple[str, ...]


def fields_of(item, arrays: frozenset[str], folded: set[Way] | frozenset[Way] = frozenset()) -> Iterator[tuple[Way, object]]:
    """(way, value) of what an item holds outside of named arrays: scalars, further arrays, and the objects at ``folded``. The item itself is at ()."""
    todo: list[tuple[Way, object]] = [((), item)]
    while todo:
        way, v = todo.pop()
        if isinstance(v, dict) and way not in folded:
            todo += [((*way, k), x) for k, x in v.items() if k not in arrays]
        else:
            yield way, v


def _kind(v) -> str:
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "boolean"
    if isinstance(v, int):
        return "int" if abs(v) <= 1 << 53 else "bigint" if -(1 << 63) <= v < 1 << 63 else "string"
    return "double" if isinstance(v, float) else "string"


def _merged_kind(kinds: set[str]) -> str:
    """The type that holds every value of these kinds as it is."""
    held = kinds - {"null"}
    if held and held <= {"int", "bigint"}:
        return "bigint"
    if held and held <= {"int", "double"}:
        return "double"
    return "boolean" if held == {"boolean"} else "string"


def _rows_of(body: dict, field: str | None, arrays: frozenset[str]) -> Iterator[tuple[str, str, str, int, object, int, int]]:
    """The record itself, as the item of the field ``""``, and its items; only those of ``field`` if it is given."""
    if not field:
        yield "", "", "", 0, body, 0, 0
    if field != "":
        yield from (x for x in items_of(body, arrays) if field is None or x[2] == field)


def infer_schema(df: DataFrame, text: str, arrays: list[str], most: int = 100_000) -> dict[str, dict[Way, str]]:
    """The merged schema of all records: field ("" for the records) to the ways of its columns and their types.

    Each task gives every way and kind of value once. Maps with data for keys count as one way; more
    than ``most`` ways and kinds besides raise ValueError.
    """
    names = frozenset(arrays)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[str, Way, str]] = set()
        keys: dict[tuple[str, Way], set[str]] = {}
        folded: dict[str, set[Way]] = {}
        for b in batches:
            new = []
            for t in b.column(0):
                body = canonical_value(t.as_py(), names)
                for _, _, field, _, item, _, _ in _rows_of(body, None, names) if body is not None else ():
                    for way, v in fields_of(item, names, folded.setdefault(field, set())):
                        for n in range(1, len(way)):
                            mine = keys.setdefault((field, way[:n]), set())
                            mine.add(way[n])
                            if len(mine) > MOST_KEYS and way[:n] not in folded[field]:
                                folded[field].add(way[:n])
                                new.append((field, way[:n], "map"))
                        row = (field, way, _kind(v))
                        if row not in seen:
                            seen.add(row)
                            new.append(row)
            if new:
                yield pa.RecordBatch.from_arrays([pa.array([json.dumps(r) for r in new], pa.string())], names=["row"])

    found = df.select(F.col(text).cast("string").alias("t")).mapInArrow(run, "row string").distinct().limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} fields in the records' schema")
    rows = [(field, tuple(way), kind) for field, way, kind in (json.loads(r.row) for r in found)]
    below: dict[tuple[str, Way], set[str]] = {}
    for field, way, _ in rows:
        for n in range(1, len(way)):
            below.setdefault((field, way[:n]), set()).add(way[n])
    maps = {x for x, k in below.items() if len(k) > MOST_KEYS} | {(field, way) for field, way, kind in rows if kind == "map"}
    kinds: dict[str, dict[Way, set[str]]] = {"": {}} | {a: {} for a in arrays}
    for field, way, kind in rows:
        way = next((way[:n] for n in range(1, len(way)) if (field, way[:n]) in maps), way)
        kinds[field].setdefault(way, set()).add("map" if (field, way) in maps else kind)
    return {field: {w: "map" if "map" in k else _merged_kind(k) for w, k in sorted(ways.items())} for field, ways in kinds.items()}


def flat_table(df: DataFrame, key: str, text: str, arrays: list[str], field: str = "") -> DataFrame:
    """The flat table of the array ``field``: key, item_no, parent_no, item_path, parent_path, ordinal and a typed column for everything its items hold; of the records if it is "".

    Objects within an item give columns with dotted names, further arrays and maps JSON text, an item that isn't an object the column
    ``value``. A column has the type that holds all its values, else it is text. A name that is taken, letters' case aside, gets a number.
    """
    names = frozenset(arrays)
    columns = infer_schema(df, text, arrays)[field]
    folded = frozenset(w for w, k in columns.items() if k == "map")
    fixed = ["item_no", "parent_no", "item_path", "parent_path", "ordinal"] if field else []
    whole = ("item_no", "parent_no", "ordinal")
    taken = {c.lower() for c in (key, *fixed)}
    outs = []
    for way in columns:
        name = plain = _well_formed(".".join(way)) if way else "value"
        n = 1
        while name.lower() in taken:
            n += 1
            name = f"{plain} {n}"
        taken.add(name.lower())
        outs.append(name)
    types = {"bigint": (pa.int64(), T.LongType()), "double": (pa.float64(), T.DoubleType()), "boolean": (pa.bool_(), T.BooleanType()), "string": (pa.string(), T.StringType()), "map": (pa.string(), T.StringType())}
    schema = T.StructType([df.schema[key]] + [T.StructField(c, T.IntegerType() if c in whole else T.StringType()) for c in fixed] + [T.StructField(o, types[k][1]) for o, k in zip(outs, columns.values(), strict=True)])
    kinds = [pa.int32() if c in whole else pa.string() for c in fixed] + [types[k][0] for k in columns.values()]

    def held(v, kind: str):
        if v is None or kind in ("bigint", "boolean"):
            return v
        if kind == "double":
            return float(v)
        return _well_formed(v) if isinstance(v, str) and kind == "string" else dump(v)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            owner: list[int] = []
            cells: list[list] = [[] for _ in kinds]
            chars = 0

            def batch(b=b) -> pa.RecordBatch:
                key_column = b.column(0).take(pa.array(owner, pa.int64()))
                return pa.RecordBatch.from_arrays([key_column, *[pa.array(x, t) for x, t in zip(cells, kinds, strict=True)]], names=schema.fieldNames())

            for n in range(len(b)):
                t = b.column(1)[n].as_py()
                body = canonical_value(t, names)
                for path, parent, _, i, item, no, own in _rows_of(body, field, names) if body is not None else ():
                    got = dict(fields_of(item, names, folded))
                    row = [*([no, own, _well_formed(path), _well_formed(parent), i] if field else []), *[held(got.get(w), k) for w, k in columns.items()]]
                    for to, x in zip(cells, row, strict=True):
                        to.append(x)
                        chars += len(x) if isinstance(x, str) else 8
                    owner.append(n)
                    if len(owner) >= BATCH_ROWS or chars >= BATCH_CHARS:
                        yield batch()
                        owner, cells, chars = [], [[] for _ in kinds], 0
            if owner:
                yield batch()

    return df.select(key, F.col(text).cast("string").alias("body")).mapInArrow(run, schema)
