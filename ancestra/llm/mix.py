"""Mixing sources to target weights.

Sizes are tokens of a public tokenizer, counted once. A document's place is a
hash of its id, so thresholds over places select whole documents without
sorting: sums of tokens by source and hash bucket give the bucket in which each
source's budget ends, and only that bucket is refined, ten bits of the hash at a
time, until it holds one document. Budgets are nested: a larger budget selects a
superset. What reaches the driver is one histogram a level over the target sources.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ancestra.functions.identity import canon_name
from ancestra.session import stored

#: Fixed value: how the byte-level BPE vocabulary of 50,256 ranks cuts text before merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Bits of the hash, and bits refined at each level.
PLACE_BITS, LEVEL_BITS = 60, 10

_encodings: dict[int, object] = {}


def encoding(data: bytes):
    """The tokenizer of a file's ranks, kept per process."""
    key = hash(data)
    if key not in _encodings:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
        _encodings[key] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[key]


def token_counts(docs: DataFrame, ident: str, source: str, text: str, path: str) -> DataFrame:
    """(doc, source, n_tokens, place) of every document; a null text has 0 tokens, ``source`` is in canonical spelling.

    The file of ranks (a megabyte or two, of fixed size) is read by the driver at ``path`` and broadcast, so executors need no copy.
    """
    with open(path, "rb") as f:
        data = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(data.value)
        for b in batches:
            n = pa.array([len(enc.encode_ordinary(t)) if t else 0 for t in b.column(2).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), n], names=["doc", "source", "n_tokens"])

    flat = docs.select(F.col(ident).cast("bigint").alias("doc"), canon_name(source).alias("source"), F.col(text).alias("text"))
    counted = flat.mapInArrow(run, "doc bigint, source string, n_tokens bigint")
    return counted.withColumn("place", F.shiftrightunsigned(F.xxhash64("doc"), 64 - PLACE_BITS))


@dataclass
class Share:
    """What one source gives: every document ``full`` times, those with a place under ``threshold`` once more."""

    source: str
    target: float
    repeats: int
    available: int
    budget: int
    full: int = 0
    threshold: int = 0


def _bucket(level: int) -> Column:
    return F.pmod(F.shiftright("place", PLACE_BITS - LEVEL_BITS * (level + 1)), F.lit(1 << LEVEL_BITS))


def plan_mix(counts: DataFrame, targets: list[tuple[str, float, int]], total: int | None = None) -> list[Share]:
    """Budgets and thresholds of all target sources.

    ``total`` is the size of the mix in tokens; None takes the largest total at which every source
    that has any documents meets its share. Shares are taken relative to those sources. A source
    whose budget is more than ``max_repeats`` times what it has gives just that.
    """
    names = [s for s, _, _ in targets]
    own = counts.where(F.col("source").isin(names) & (F.col("n_tokens") > 0))
    hist: dict[str, list] = {}
    for r in own.groupBy("source", _bucket(0).alias("b")).agg(F.sum("n_tokens").alias("n"), F.count("*").alias("docs")).collect():
        hist.setdefault(r.source, []).append((r.b, r.n, r.docs))
    have = {s: sum(n for _, n, _ in h) for s, h in hist.items()}
    there = [(s, w, k) for s, w, k in targets if have.get(s) and w > 0 and k > 0]
    whole = sum(w for _, w, _ in there)
    if total is None:
        total = min((int(have[s] * k * whole / w) for s, w, k in there), default=0)
    shares = []
    for s, w, k in targets:
        got = have.get(s, 0)
        budget = min(int(round(total * w / whole)), got * k) if got and w > 0 and k > 0 else 0
        shares.append(Share(s, w, k, got, budget, budget // got if got else 0))
    open_: dict[str, tuple[int, int]] = {x.source: (0, x.budget - x.full * x.available) for x in shares if x.available and x.full < x.repeats}
    by = {x.source: x for x in shares}
    for level in range(PLACE_BITS // LEVEL_BITS):
        if level:
            if not open_:
                break
            width = PLACE_BITS - LEVEL_BITS * level
            near = own.where(F.col("source").isin(list(open_)))
            at = F.create_map(*[x for s, (base, _) in open_.items() for x in (F.lit(s), F.lit(base >> width))])
            near = near.where(F.shiftright("place", width) == at[F.col("source")])
            hist = {}
            for r in near.groupBy("source", _bucket(level).alias("b")).agg(F.sum("n_tokens").alias("n"), F.count("*").alias("docs")).collect():
                hist.setdefault(r.source, []).append((r.b, r.n, r.docs))
        step = 1 << (PLACE_BITS - LEVEL_BITS * (level + 1))
        for s in list(open_):
            base, rest = open_.pop(s)
            edge = base
            for b, n, docs in sorted(hist.get(s, [])):
                if n <= rest:
                    rest -= n
                    edge = base + (b + 1) * step
                    continue
                if docs > 1 and step > 1:
                    open_[s] = (base + b * step, rest)
                elif 2 * rest >= n:  # one document more comes nearer than none
                    edge = base + (b + 1) * step
                break
            by[s].threshold = edge if s not in open_ else open_[s][0]
    return shares


def select_mix(counts: DataFrame, shares: list[Share]) -> DataFrame:
    """(doc, source, n_tokens, copies) of the documents drawn; ``copies`` is at least 1."""
    copies = F.lit(0)
    for x in shares:
        more = (F.col("place") < x.threshold).cast("int") if x.threshold else F.lit(0)
        copies = F.when(F.col("source") == x.source, F.lit(x.full) + more).otherwise(copies)
    drawn = counts.where(F.col("source").isin([x.source for x in shares]) & (F.col("n_tokens") > 0))
    return drawn.select("doc", "source", "n_tokens", copies.alias("copies")).where("copies > 0")


def mix(docs: DataFrame, ident: str, source: str, text: str, targets: DataFrame, path: str, total: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The documents drawn, with copies, and the report of actual shares.

    ``targets`` has source, target_share and max_repeats, a row a source (the largest share of repeated ones
    counts); it is read to the driver, so it must be small: more than 10,000 sources raise ValueError. Documents without a
    source, of a source not named or without tokens aren't drawn. A source without documents is reported with share 0.
    """
    rows = targets.select(canon_name("source").alias("s"), "target_share", "max_repeats").where("s is not null").groupBy("s").agg(F.max("target_share").alias("w"), F.max("max_repeats").alias("k")).limit(10_001).collect()
    if len(rows) > 10_000:
        raise ValueError("more than 10,000 target sources")
    counts = stored(token_counts(docs, ident, source, text, path))
    shares = plan_mix(counts, [(r.s, float(r.w or 0), int(r.k or 0)) for r in sorted(rows)], total)
    drawn = select_mix(counts, shares)
    spark = docs.sparkSession
    wanted = spark.createDataFrame([(x.source, x.target, x.repeats, x.available) for x in shares], "source string, target_share double, max_repeats int, available_tokens bigint")
    got = drawn.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("n"), F.count("*").alias("n_docs"), F.max("copies").alias("most_copies"))
    whole = got.agg(F.sum("n").alias("whole"))
    report = wanted.join(got, "source", "left").join(F.broadcast(whole), how="left").select(
        "source", "target_share", (F.coalesce("n", F.lit(0)) / F.greatest("whole", F.lit(1))).alias("actual_share"), F.coalesce("n", F.lit(0)).alias("n_tokens"), "available_tokens", F.coalesce("n_docs", F.lit(0)).alias("n_docs"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"), "max_repeats"
    )
    return drawn, report
