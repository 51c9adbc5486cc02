"""Evaluation texts that stand, whole or in part, in a corpus.

Each training shard (texts up to ``SHARD_WORDS`` words) gets an FM-index;
every run of ``n`` words of every test item is searched in it backward, and
occurrences are located. No text is shuffled. Test items come in blocks of about
``BLOCK_WORDS`` words, whatever their ids: what is on the driver and sent to the tasks is one block, and a
larger test set means more passes over the corpus, each written out, and not a larger block.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ancestra.llm.fmindex import FMIndex
from ancestra.session import Pile

WORD = re.compile(r"[^\W_]+")
SHARD_WORDS = 300_000
BLOCK_WORDS = 2_000_000


def words(text: str | None) -> list[str]:
    """The longest runs of letters and digits, in lower case."""
    return [w.lower() for w in WORD.findall(text)] if text else []


class Phrases:
    """All runs of ``n`` words of the parts of test items, each the list of its words, coded by the words that occur in them."""

    def __init__(self, items: list[tuple[int, list[str]]], n: int):
        self.n = n
        self.code: dict[str, int] = {}
        grams: dict[tuple[int, ...], dict[int, None]] = {}
        for ident, part in items:
            ids = [self.code.setdefault(w, len(self.code) + 1) for w in part]
            for i in range(len(ids) - n + 1):
                grams.setdefault(tuple(ids[i : i + n]), {})[ident] = None
        self.grams = np.array(list(grams), np.int64).reshape(-1, n)
        self.owners = [list(own) for own in grams.values()]
        self.sigma = len(self.code) + 1

    def hits(self, text: np.ndarray) -> list[tuple[int, int]]:
        """(position, phrase) of every occurrence in a shard."""
        if not len(self.grams) or len(text) < self.n:
            return []
        index = FMIndex(text, self.sigma)
        lo, hi = index.search(self.grams)
        phrase = np.repeat(np.arange(len(lo)), hi - lo)
        if not len(phrase):
            return []
        rows = np.concatenate([np.arange(a, b) for a, b in zip(lo[hi > lo], hi[hi > lo], strict=True)])
        return list(zip(index.locate(rows).tolist(), phrase.tolist(), strict=True))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping or touching half-open spans as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _scan(phrases: Phrases, shard_words: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n = phrases.n
    texts: dict[int, str] = {}
    shard: list[np.ndarray] = []
    begin: list[tuple[int, int, int]] = []  # (place in the shard, row number, first word of the piece)
    idents: dict[int, int] = {}
    rows = 0
    size = 0

    def flush() -> pa.RecordBatch | None:
        nonlocal size
        if not size:
            return None
        found = phrases.hits(np.concatenate(shard))
        starts = np.array([b[0] for b in begin])
        spans: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for at, p in found:
            place, row, first = begin[int(np.searchsorted(starts, at, "right")) - 1]
            w = at - place + first
            for item in phrases.owners[p]:
                spans.setdefault((row, item), []).append((w, w + n))
        out: list[tuple] = []
        for row in sorted({r for r, _ in spans}):
            marks = [m.span() for m in WORD.finditer(texts[row])]
            for (r, item), own in sorted(spans.items()):
                if r == row:
                    for a, b in merged(own):
                        out.append((idents[row], item, b - a, marks[a][0], marks[b - 1][1]))
        size = 0
        shard.clear()
        begin.clear()
        last = max(texts)  # the one a further piece may come of
        for r in [r for r in texts if r != last]:
            del texts[r], idents[r]
        if not out:
            return None
        cols = list(zip(*out, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()], strict=True)], names=["doc", "item", "n_words", "from_char", "to_char"])

    for b in batches:
        for ident, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if not text:
                continue
            ids = np.array([phrases.code.get(w, 0) for w in words(text)] + [0], np.int32)
            row, rows = rows, rows + 1
            idents[row], texts[row] = ident, text
            at = 0
            while at < len(ids) - 1:
                room = shard_words - size
                if room < n and size:
                    if made := flush():
                        yield made
                    continue
                piece = ids[at : at + room]
                begin.append((size, row, at))
                shard += [piece, np.zeros(1, np.int32)]
                size += len(piece) + 1
                if at + room >= len(ids):
                    break
                at += max(1, len(piece) - n + 1)  # pieces of one text overlap by n - 1 words
            if size >= shard_words:
                if made := flush():
                    yield made
            if not size:
                texts.clear()
                idents.clear()
    if made := flush():
        yield made


def _blocks(rows: DataFrame, n: int, block_words: int) -> Iterator[list[tuple[int, list[str]]]]:
    """The items' parts in blocks of about ``block_words`` words; a longer part comes in pieces that overlap by ``n - 1`` words. At least one block, maybe empty."""
    block: list[tuple[int, list[str]]] = []
    size, first = 0, True
    for r in rows.toLocalIterator():
        for part in list(r)[1:]:
            ws = words(part)
            for at in range(0, max(0, len(ws) - n + 1), block_words):
                piece = ws[at : at + block_words + n - 1]
                block.append((r.item, piece))
                size += len(piece)
                if size >= block_words:
                    yield block
                    block, size, first = [], 0, False
    if block or first:
        yield block


def leaks(docs: DataFrame, ident: str, text: str, items: DataFrame, item: str, parts: list[str], n: int = 12, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(doc, item, n_words, from_char, to_char): every passage of ``n`` or more words that a text shares with a part of an item.

    Passages of one item that overlap or touch come as one span; ``from_char`` and ``to_char`` are
    what to remove. A text in several pieces, and an item of which parts are in several blocks, can give overlapping spans of one
    passage. Items may repeat an id, and count as one then. Null or
    empty texts and parts, null ids of items, and parts of fewer than ``n`` words, give no rows.
    """
    if shard_words < 2 * n:
        raise ValueError("shard_words")
    source = docs.select(F.col(ident).cast("bigint").alias("doc"), F.col(text).alias("text"))
    rows = items.select(F.col(item).cast("bigint").alias("item"), *[F.col(p).alias(f"part_{i}") for i, p in enumerate(parts)]).where("item is not null")
    found: DataFrame | None = None
    pile: Pile | None = None
    for block in _blocks(rows, n, block_words):
        if found is not None:  # more than one block: what each finds is written out
            if pile is None:
                pile = Pile(found)
            else:
                pile.add(found)
        phrases = Phrases(block, n)
        found = source.mapInArrow(lambda it, p=phrases: _scan(p, shard_words, it), "doc bigint, item bigint, n_words int, from_char int, to_char int")
    if pile is None:
        return found
    pile.add(found)
    return pile.read()


def leaked_items(spans: DataFrame) -> DataFrame:
    """The distinct (doc, item) of ``leaks``."""
    return spans.select("doc", "item").distinct()


def removal_spans(spans: DataFrame) -> DataFrame:
    """(doc, from_char, to_char): the spans of all items merged, per text."""
    order = F.array_sort(F.collect_set(F.struct(F.col("from_char").alias("a"), F.col("to_char").alias("b"))))
    per = spans.groupBy("doc").agg(order.alias("s"))
    step = lambda acc, x: F.when(
        (F.size(acc) > 0) & (x["a"] <= F.element_at(acc, -1)["b"]),
        F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["a"].alias("a"), F.greatest(F.element_at(acc, -1)["b"], x["b"]).alias("b")))),
    ).otherwise(F.concat(acc, F.array(x)))
    empty = F.array().cast("array<struct<a:int,b:int>>")
    return per.select("doc", F.explode(F.aggregate("s", empty, step)).alias("x")).select("doc", F.col("x.a").alias("from_char"), F.col("x.b").alias("to_char"))
