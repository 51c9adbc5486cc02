"""Identity of vertices and edges: canonical spelling of hashes and content hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as a blank around a hash.
BLANKS = " \t\r\n"


def canon_hash(c: Column | str) -> Column:
    """The one spelling of a hash: lower case, without dashes and outer blanks; null where nothing is left."""
    c = F.col(c) if isinstance(c, str) else c
    return F.nullif(F.lower(F.translate(F.btrim(c, F.lit(BLANKS)), "-", "")), F.lit(""))


def canon_name(c: Column | str) -> Column:
    """Names that compare without regard to case and outer blanks; null where nothing is left."""
    c = F.col(c) if isinstance(c, str) else c
    return F.nullif(F.lower(F.btrim(c, F.lit(BLANKS))), F.lit(""))


def annotations_text(a: Column) -> Column:
    """``{k1=v1, k2=v2}`` with keys in order; null values read as empty, null or empty keys are left out."""
    pairs = F.array_sort(F.map_entries(F.coalesce(a, F.create_map().cast("map<string,string>"))))
    kept = F.filter(pairs, lambda x: x["key"] != "")
    text = F.transform(kept, lambda x: F.concat(x["key"], F.lit("="), F.coalesce(x["value"], F.lit(""))))
    return F.concat(F.lit("{"), F.array_join(text, ", "), F.lit("}"))


def vertex_id(a: Column) -> Column:
    return F.md5(annotations_text(a).cast("binary"))


def edge_id(child: Column, parent: Column, a: Column) -> Column:
    text = F.concat(F.coalesce(child, F.lit("null")), F.lit(","), annotations_text(a), F.lit(","), F.coalesce(parent, F.lit("null")))
    return F.md5(text.cast("binary"))


def reference_id(c: Column) -> Column:
    """The id of an element known by a given name: the name itself if it is an MD5, else the MD5 of ``{id=name}``."""
    return F.when(c.rlike("^[0-9a-fA-F]{32}$"), F.lower(c)).otherwise(F.md5(F.concat(F.lit("{id="), c, F.lit("}")).cast("binary")))
