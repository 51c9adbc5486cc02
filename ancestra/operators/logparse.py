"""Log lines of differing layouts into entries with fields.

Every line is parsed whole by a weighted grammar: heads of the known
layouts, the continuation lines they bring, and, far below these in weight, a
line nothing is known about, whose span comes out as unparsed. Lines are then
put together into entries: a head begins one, all other lines belong to
the head before them in their file.

One file may hold most lines, so a file isn't one task's work: heads are
carried forward within blocks of lines, and only one row a block is
ordered per file. Entries are counted by partial aggregation.
"""

from __future__ import annotations

import calendar
import re
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ancestra.functions.earley import Grammar
from ancestra.session import stored

#: The layouts. Fields: ts, zone, level, component, message; level2 is a level that belongs to the head before it.
LAYOUTS = r"""
Line -> Logger4 ; 0
Line -> Postmaster ; 0
Line -> Bracketed ; 0
Line -> TwoLine ; 0
Line -> Audit ; 0
Line -> Glog ; 0
Line -> Syslog ; 0
Line -> Frame ; -2
Line -> Cause ; -2
Line -> LevelLine ; -2
Line -> Indented ; -4
Line -> Blank ; -4
Line -> Opaque ; -50
Rest -> message=/.*/ ; 0
Iso -> /\d{4}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])[ T](?:[01]\d|2[0-3]):[0-5]\d:[0-5]\d/ Fraction ; 0
Iso -> /\d{4}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])[ T](?:[01]\d|2[0-3]):[0-5]\d:[0-5]\d/ ; -1
Fraction -> /[.,]\d+/ ; 0
Level -> /(?:TRACE|DEBUG|INFO|WARN|WARNING|ERROR|FATAL|CRITICAL)(?![A-Za-z0-9_])/ ; 0
Logger4 -> /\[/ ts=Iso /\] +/ level=Level / +/ component=/[^\s\[\]]+/ / - ?/ Rest ; 0
Logger4 -> /\[/ ts=Iso /\] +/ level=Level / +/ component=/[^\s\[\]]+/ / -/ ; -1
Bracketed -> ts=Iso zone=/(?:Z|[+-]\d\d:?\d\d)/ / +/ level=Level / +\[/ component=/[^\[\]]+/ /\]/ ; -1
Bracketed -> ts=Iso zone=/(?:Z|[+-]\d\d:?\d\d)/ / +/ level=Level / +\[/ component=/[^\[\]]+/ /\] / Rest ; 0
Bracketed -> ts=Iso / +/ level=Level / +\[/ component=/[^\[\]]+/ /\] ?/ Rest ; -1
PgLevel -> /(?:DEBUG[1-5]?|LOG|INFO|NOTICE|WARNING|ERROR|FATAL|PANIC)(?=:)/ ; 0
App -> /[^\s]+/ ; -1
App -> App / +/ /[^\s]+/ ; -1
PgHead -> ts=Iso / / zone=/[A-Z]{1,5}|[+-]\d\d(?::?\d\d)?/ / \[\d+\] / ; 0
Postmaster -> PgHead component=App / / level=PgLevel /: */ Rest ; 0
Postmaster -> PgHead component=App / / level=PgLevel /: */ ; -1
Postmaster -> PgHead level=PgLevel /: */ Rest ; -1
Month -> /Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec/ ; 0
Clock12 -> Month / (?:0?[1-9]|[12]\d|3[01]), \d{4},? (?:0?[1-9]|1[0-2]):[0-5]\d:[0-5]\d[ \u202f][AP]M/ ; 0
TwoLine -> ts=Clock12 / / component=/[^\s]+/ / / /[^\s]+ */ ; 0
Audit -> /(?:node=\S+ )?type=/ component=/[^\s=]+/ / msg=audit\(/ ts=/\d+(?:\.\d+)?/ /:\d+\): ?/ Rest ; 0
Audit -> /(?:node=\S+ )?type=/ component=/[^\s=]+/ / msg=audit\(/ ts=/\d+(?:\.\d+)?/ /:\d+\): ?/ ; -1
Glog -> level=/[IWEF](?=\d{4} )/ ts=/(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01]) (?:[01]\d|2[0-3]):[0-5]\d:[0-5]\d(?:\.\d+)?/ / +\d+ / component=/[^\s:\]]+/ /:\d+\]/ ; -1
Glog -> level=/[IWEF](?=\d{4} )/ ts=/(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01]) (?:[01]\d|2[0-3]):[0-5]\d:[0-5]\d(?:\.\d+)?/ / +\d+ / component=/[^\s:\]]+/ /:\d+\] / Rest ; 0
BsdTime -> Month / (?: [1-9]|0[1-9]|[12]\d|3[01]) (?:[01]\d|2[0-3]):[0-5]\d:[0-5]\d/ ; 0
Tag -> component=/[^\s\[\]:]+/ /\[\d+\]/ ; 0
Tag -> component=/[^\s\[\]:]+/ ; -1
Syslog -> ts=BsdTime / \S+ / Tag /: ?/ Rest ; 0
Syslog -> ts=BsdTime / \S+ / Tag /: ?/ ; -1
Frame -> /\s+at \S.*/ ; 0
Frame -> /\s+@ 0x[0-9a-f]+.*/ ; 0
Frame -> /\s*\.\.\. \d+ (?:more|common frames).*/ ; 0
Cause -> /(?:Caused by: |Suppressed: )?[\w$.]+(?:Exception|Error|Throwable)\b.*/ ; 0
LevelLine -> level2=/(?:SEVERE|WARNING|INFO|CONFIG|FINE|FINER|FINEST)(?=:)/ /: ?/ Rest ; 0
LevelLine -> level2=/(?:SEVERE|WARNING|INFO|CONFIG|FINE|FINER|FINEST)(?=:)/ /: ?/ ; -1
Indented -> /\s+\S.*/ ; 0
Blank -> /\s*$/ ; 0
Opaque -> unparsed=/.*/ ; 0
"""

#: Layouts whose lines begin an entry, the spellings of levels, months and zones.
HEADS = frozenset("Logger4 Postmaster Bracketed TwoLine Audit Glog Syslog".split())
LEVELS = {
    "DEBUG": "TRACE DEBUG DEBUG1 DEBUG2 DEBUG3 DEBUG4 DEBUG5 FINE FINER FINEST CONFIG",
    "INFO": "INFO LOG NOTICE I",
    "WARN": "WARN WARNING W",
    "ERROR": "ERROR SEVERE E",
    "FATAL": "FATAL CRITICAL PANIC F",
}
SEVERITY = {word: level for level, words in LEVELS.items() for word in words.split()}
MONTHS = {m: i + 1 for i, m in enumerate("Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split())}
ZONES = {"UTC": 0, "GMT": 0, "Z": 0, "WET": 0, "CET": 60, "CEST": 120, "BST": 60, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420, "IST": 330, "JST": 540}

#: Lines of a file in one block.
BLOCK = 8192

PARSED = "layout string, head boolean, ts timestamp, level string, component string, message string, level2 string, unparsed_from int, unparsed_to int"
_arrow = pa.schema([("layout", pa.string()), ("head", pa.bool_()), ("ts", pa.timestamp("us", "UTC")), ("level", pa.string()), ("component", pa.string()), ("message", pa.string()), ("level2", pa.string()), ("unparsed_from", pa.int32()), ("unparsed_to", pa.int32())])


def _minutes(zone: str | None) -> int:
    if not zone:
        return 0
    if m := re.fullmatch(r"([+-])(\d\d):?(\d\d)?", zone):
        return (-1 if m[1] == "-" else 1) * (int(m[2]) * 60 + int(m[3] or 0))
    return ZONES.get(zone, 0)


def instant(layout: str, text: str, zone: str | None, year: int | None) -> datetime | None:
    """The time in UTC of a head's time text; None if there is no such date."""
    try:
        if layout == "Audit":
            return datetime.fromtimestamp(int(text.partition(".")[0]), UTC)
        digits = [int(x) for x in re.findall(r"\d+", text)]
        if layout == "Glog":
            md, h, mi, s = digits[:4]
            parts = (year, md // 100, md % 100, h, mi, s)
        elif layout == "Syslog":
            d, h, mi, s = digits[:4]
            parts = (year, MONTHS[text[:3]], d, h, mi, s)
        elif layout == "TwoLine":
            d, y, h, mi, s = digits[:5]
            parts = (y, MONTHS[text[:3]], d, h % 12 + 12 * text.endswith("PM"), mi, s)
        else:
            parts = tuple(digits[:6])
        if parts[0] is None:
            return None
        return datetime.fromtimestamp(calendar.timegm(datetime(*parts).timetuple()) - 60 * _minutes(zone), UTC)
    except (ValueError, OverflowError, OSError):
        return None


def parse_line(grammar: Grammar, text: str, year: int | None) -> tuple:
    """The columns of PARSED for one line."""
    text = text.lstrip("\ufeff").rstrip("\r\n")
    best = grammar.parse(text) if text else (0.0, "Blank", [])
    _, layout, fields = best or (0.0, "Opaque", [("unparsed", 0, len(text))])
    f = {name: (a, b) for name, a, b in fields}
    get = lambda name: text[slice(*f[name])] if name in f else None
    head = layout in HEADS
    rest = f.get("unparsed", (None, None))
    message = get("message")
    if message is None:
        message = "" if head or layout == "LevelLine" else text
    return (layout, head, instant(layout, get("ts"), get("zone"), year) if head else None, SEVERITY.get(get("level") or ""), get("component"), message, SEVERITY.get(get("level2") or ""), *rest)


def parse_lines(df: DataFrame, msg: str, collected: str, keep: list[str], layouts: str = LAYOUTS) -> DataFrame:
    """``keep`` columns and those of PARSED for every line; a null line counts as an empty one."""
    names = [c for c, _ in (x.split(" ") for x in PARSED.split(", "))]
    if clash := set(names) & set(keep):
        raise ValueError(f"columns to keep have names of results: {sorted(clash)}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(layouts, "Line")
        for b in batches:
            rows = [parse_line(grammar, t or "", y) for t, y in zip(b.column(len(keep)).to_pylist(), b.column(len(keep) + 1).to_pylist(), strict=True)]
            cols = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
            made = [pa.array(c, t.type) for c, t in zip(cols, _arrow, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], *made], names=[*keep, *names])

    types = dict(df.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in keep) + ", " + PARSED
    return df.select(*keep, F.col(msg).alias("__msg"), F.year(collected).alias("__year")).mapInArrow(run, schema)


def with_entry(lines: DataFrame, file: str, no: str, ident: str) -> DataFrame:
    """Parsed lines with ``entry_no`` and ``entry_id``: number and id of the head each belongs to.

    Lines are in order of (``no``, ``ident``) within ``file``. Lines before a file's
    first head, and lines without file or number, belong to no entry and are left out. The
    parsed lines are written to the shared folder first: two branches read them, and parsing is the dear part.
    """
    lines = stored(lines)
    lines = lines.where(F.col(file).isNotNull() & F.col(no).isNotNull()).withColumn("__block", F.floor(F.col(no) / BLOCK))
    here = F.when(F.col("head"), F.struct(F.col(no).alias("no"), F.col(ident).alias("id")))
    before = Window.partitionBy(file, "__block").orderBy(no, ident).rowsBetween(Window.unboundedPreceding, 0)
    marked = lines.withColumn("__own", F.last(here, ignorenulls=True).over(before))
    tails = lines.groupBy(file, "__block").agg(F.max(here).alias("__tail"))
    earlier = Window.partitionBy(file).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    carried = tails.select(F.col(file).alias("__f"), F.col("__block").alias("__b"), F.last("__tail", ignorenulls=True).over(earlier).alias("__carry"))
    whole = marked.join(carried, (F.col(file) == F.col("__f")) & (F.col("__block") == F.col("__b")), "left")
    own = F.coalesce("__own", "__carry")
    return whole.withColumn("entry_no", own["no"]).withColumn("entry_id", own["id"]).where("entry_id is not null").drop("__block", "__own", "__carry", "__f", "__b")


def entries(lines: DataFrame, file: str, no: str, ident: str, text: bool = False) -> DataFrame:
    """One row per entry: file, ``line_id``, ts, severity, component, n_lines and, with ``text``, message and n_unparsed.

    ``lines`` are parsed lines. ``severity`` comes from the head, or from the entry's second
    line in the layout that puts it there; it is empty where there is none. ``message`` is the
    head's message and all continuation lines, joined by line feeds, ``n_unparsed`` how many of them no layout explains. An empty table gives no rows.
    """
    own = with_entry(lines, file, no, ident)
    rest = F.when(~F.col("head"), F.struct(F.col(no).alias("no"), F.col(ident).alias("id"), F.col("level2").alias("l")))
    aggs = [
        F.max(F.when(F.col("head"), F.struct("ts", "level", "component", "layout"))).alias("h"),
        F.min(rest).alias("second"),
        F.count("*").cast("int").alias("n_lines"),
    ]
    if text:
        aggs.append(F.count("unparsed_to").cast("int").alias("n_unparsed"))
        aggs.append(F.array_sort(F.collect_list(F.struct(F.col(no).alias("no"), F.col(ident).alias("id"), F.col("message").alias("m")))).alias("all"))
    per = own.groupBy(file, "entry_no", "entry_id").agg(*aggs)
    level = F.coalesce("h.level", F.when(F.col("h.layout") == "TwoLine", F.col("second.l")), F.lit(""))
    cols = [file, F.col("entry_id").alias("line_id"), F.col("h.ts").alias("ts"), level.alias("severity"), F.coalesce("h.component", F.lit("")).alias("component"), "n_lines"]
    if text:
        cols.append(F.ltrim(F.array_join(F.transform("all", lambda x: x["m"]), "\n"), F.lit("\n")).alias("message"))
        cols.append("n_unparsed")
    return per.select(*cols)


def unparsed(lines: DataFrame, ident: str) -> DataFrame:
    """(ident, from_char, to_char, text): the spans of parsed lines that no layout explains; lines without one don't appear."""
    left = lines.where("unparsed_to is not null")
    return left.select(ident, F.col("unparsed_from").alias("from_char"), F.col("unparsed_to").alias("to_char"), F.expr("substr(message, unparsed_from + 1, unparsed_to - unparsed_from)").alias("text"))
