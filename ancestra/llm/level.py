"""Reading level of documents.

Prose is taken out of its markup, cut into sentences, and every sentence's band is
classified by a regularised softmax model over words and character n-grams. The
distributions of a document's sentences, weighted by words, are then calibrated
to a band of the document. A second model over character n-grams, fitted on the
documents' own labels, tells the language. All models are fitted on the driver on bounded
samples of labelled documents; they are small and of fixed size. Scoring reads every document whole,
in one Arrow pass without a shuffle, and works on whole batches: words are numbers,
and a word's weights are looked up once and summed by sentence and document.

Texts without sentence marks are cut into windows and scored by a model that was
shown the labelled texts without their marks too, so missing marks make nothing harder.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ancestra.functions.identity import canon_name
from ancestra.llm.leaks import WORD
from ancestra.session import stored

BANDS = 5
DIM = 4096
#: Labelled documents the level models are fitted on at most, documents the language model is fitted on for each language at most, and the longest of them in characters.
SAMPLE_DOCS, LANGUAGE_DOCS, SAMPLE_CHARS = 2000, 300, 100_000
#: Languages told apart at most, those with the most documents, and documents with its label a language needs.
LANGUAGES, LEAST_DOCS = 50, 3
#: Words of a window where there are no sentence marks; words a document needs to be judged.
WINDOW, LEAST_WORDS = 14, 15
#: Words of a run shared with a test item that make it a quotation, and words of test items in one block.
QUOTE, BLOCK_WORDS = 5, 4_000_000
#: Characters of text worked on at once, and words whose weights are kept.
PART_CHARS, KEPT_WORDS = 1 << 22, 500_000

_FENCE = re.compile(r"(```|~~~).*?(?:\1|\Z)", re.S)
_TAGGED = re.compile(r"<(pre|code|blockquote|script|style)\b[^>]*>.*?(?:</\1\s*>|\Z)", re.S | re.I)
_LINK = re.compile(r"!?\[[^\]\n]*\]\([^)\n]*\)|<a\b[^>]*>.*?</a\s*>|(?:https?|ftp)://\S+|www\.\S+", re.S | re.I)
_INLINE = re.compile(r"`[^`\n]*`")
_CODE_LINE = re.compile(r"(?m)^(?: {4}|\t|>|\$ ).*$")
_TAG = re.compile(r"</?[a-zA-Z][^>\n]*>")
_MARK = re.compile(r"(?<=[.!?…])[\"')\]]*\s+")
_END = re.compile(r"[.!?…](?=\s|$)")


def prose(text: str) -> list[str]:
    """The paragraphs of a text without code, links, quotations and tags."""
    if "```" in text or "~~~" in text:
        text = _FENCE.sub("\n\n", text)
    tags = "<" in text
    if tags:
        text = _TAGGED.sub("\n\n", text)
    if tags or "](" in text or "://" in text or "www." in text.lower():
        text = _LINK.sub(" ", text)
    if "`" in text:
        text = _INLINE.sub(" ", text)
    text = _CODE_LINE.sub("", text)
    if tags:
        text = _TAG.sub("\n", text)
    return [p for p in text.split("\n") if p and not p.isspace()]


@dataclass
class Batch:
    """The words of some texts as numbers, in sentences: ``slen`` words each, of the document ``sdoc``, to be cut in windows if ``cut``. ``marked`` tells which documents have sentence marks."""

    codes: np.ndarray
    slen: np.ndarray
    sdoc: np.ndarray
    cut: np.ndarray
    marked: np.ndarray

    @property
    def docs(self) -> int:
        return len(self.marked)

    @property
    def owner(self) -> np.ndarray:
        """The document of each word."""
        return np.repeat(self.sdoc, self.slen)

    def without(self, hit: np.ndarray) -> Batch:
        """Without the words of ``hit``, and without sentences half of which they are."""
        if not hit.any():
            return self
        sid = np.repeat(np.arange(len(self.slen)), self.slen)
        gone = np.bincount(sid, hit, len(self.slen)) * 2 >= self.slen
        keep = ~hit & ~gone[sid]
        left = np.bincount(sid, keep, len(self.slen)).astype(np.int64)
        there = left > 0
        return Batch(self.codes[keep], left[there], self.sdoc[there], self.cut[there], self.marked)

    def windowed(self) -> Batch:
        """Sentences to be cut as windows of at most WINDOW words."""
        parts = np.where(self.cut, -(-self.slen // WINDOW), 1)
        own = np.repeat(np.arange(len(self.slen)), parts)
        at = np.arange(len(own)) - np.repeat(np.cumsum(parts) - parts, parts)
        slen = np.where(self.cut[own], np.minimum(WINDOW, self.slen[own] - WINDOW * at), self.slen[own])
        return Batch(self.codes, slen, self.sdoc[own], np.zeros(len(own), bool), self.marked)

    def bare(self) -> Batch:
        """The same words without sentence marks."""
        n = np.bincount(self.sdoc, self.slen, self.docs).astype(np.int64)
        docs = np.flatnonzero(n)
        return Batch(self.codes, n[docs], docs, np.ones(len(docs), bool), np.zeros(self.docs, bool)).windowed()

    def of(self, docs: np.ndarray) -> Batch:
        """The documents of a mask; the others keep their numbers, without words."""
        keep = docs[self.sdoc]
        return Batch(self.codes[np.repeat(keep, self.slen)], self.slen[keep], self.sdoc[keep], self.cut[keep], self.marked)


class Words(dict):
    """Numbers of words, given as they come."""

    def __init__(self):
        super().__init__()
        self.names: list[str] = []

    def __missing__(self, w: str) -> int:
        n = self[w] = len(self.names)
        self.names.append(w)
        return n

    def read(self, texts: list[str | None]) -> Batch:
        flat: list[str] = []
        slen: list[int] = []
        sdoc: list[int] = []
        cut: list[bool] = []
        marked: list[bool] = []
        for d, text in enumerate(texts):
            paragraphs = prose(text) if text else []
            marks = sum(len(_END.findall(p)) for p in paragraphs)
            total, own = 0, []
            for k, p in enumerate(paragraphs):
                for s in _MARK.split(p) if marks else [p]:
                    ws = WORD.findall(s.lower())
                    if ws:
                        total += len(ws)
                        own.append((ws, s, k))
            plain = not marks or total > 90 * marks
            marked.append(not plain)
            last = -1
            for ws, s, k in own:
                flat += ws
                if plain and last == k:  # a paragraph is one run of words
                    slen[-1] += len(ws)
                    continue
                last = k
                slen.append(len(ws))
                sdoc.append(d)
                cut.append(plain or (len(ws) > 8 * WINDOW and not re.search(r"[.!?…]", s)))
        codes = np.fromiter(map(self.__getitem__, flat), np.int64, len(flat))
        return Batch(codes, np.array(slen, np.int64), np.array(sdoc, np.int64), np.array(cut, bool), np.array(marked, bool))


_BASE = np.uint64(0x9E3779B97F4A7C15)


def _run_hash(rows: list[np.ndarray]) -> np.ndarray:
    h = np.zeros(len(rows[0]), np.uint64)
    for r in rows:
        h = h * _BASE + r.astype(np.uint64)
    return h


class Quotes:
    """All runs of QUOTE words of a block of test items: numbers of their words, and the runs in the order of a hash."""

    def __init__(self, parts: list[list[str]]):
        self.words: dict[str, int] = {}
        codes = [np.array([self.words.setdefault(w, len(self.words) + 1) for w in ws], np.int64) for ws in parts if len(ws) >= QUOTE]
        runs = [np.lib.stride_tricks.sliding_window_view(c, QUOTE) for c in codes]
        self.runs = np.unique(np.concatenate(runs), axis=0) if runs else np.zeros((0, QUOTE), np.int64)
        h = _run_hash(list(self.runs.T))
        order = np.argsort(h)
        self.runs, self.hashes = self.runs[order], h[order]

    def hits(self, b: Batch, names: list[str]) -> np.ndarray:
        """Which words of a batch lie in a run of a test item, within a sentence."""
        hit = np.zeros(len(b.codes), bool)
        if not len(self.runs) or len(b.codes) < QUOTE:
            return hit
        known = np.fromiter((self.words.get(w, 0) for w in names), np.int64, len(names))
        q = known[b.codes]
        sid = np.repeat(np.arange(len(b.slen)), b.slen)
        n = len(q) - QUOTE + 1
        fits = sid[:n] == sid[QUOTE - 1 :]
        for j in range(QUOTE):
            fits &= q[j : j + n] > 0
        at = np.flatnonzero(fits)
        rows = np.stack([q[at + j] for j in range(QUOTE)], 1)
        h = _run_hash(list(rows.T))
        lo = np.searchsorted(self.hashes, h)
        found = np.zeros(len(at), bool)
        step = 0
        while True:  # runs with the same hash stand together
            same = (lo + step < len(self.hashes)) & (self.hashes[np.minimum(lo + step, len(self.hashes) - 1)] == h)
            if not same.any():
                break
            found |= same & (self.runs[np.minimum(lo + step, len(self.runs) - 1)] == rows).all(1)
            step += 1
        for j in range(QUOTE):
            hit[at[found] + j] = True
        return hit


def quotations(items: DataFrame, parts: list[str], block_words: int = BLOCK_WORDS) -> list[Quotes]:
    """The runs of QUOTE words of all test items, in blocks of about ``block_words`` words. Null parts have none."""
    out, held, n = [], [], 0
    for r in items.select(*parts).toLocalIterator():
        for part in r:
            ws = WORD.findall(part.lower()) if part else []
            if len(ws) >= QUOTE:
                held.append(ws)
                n += len(ws)
        if n >= block_words:
            out.append(Quotes(held))
            held, n = [], 0
    return [*out, Quotes(held)] if held or not out else out


def _grams(word: str) -> list[int]:
    w = f"<{word}>"
    return [zlib.crc32(w[i : i + n].encode("utf-8", "replace")) % DIM for n in (3, 4, 5) for i in range(max(0, len(w) - n + 1))]


def _features_of(names: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word feature of each word, all of their n-gram features, and how many each has."""
    word = np.array([zlib.crc32(w.encode("utf-8", "replace")) % DIM for w in names], np.int64)
    grams = [_grams(w) for w in names]
    return word, np.concatenate([np.array(g, np.int64) for g in grams]) if grams else np.zeros(0, np.int64), np.array([len(g) for g in grams], np.int64)


def _gram_means(weights: np.ndarray, grams: np.ndarray, n: np.ndarray) -> np.ndarray:
    if not len(n):
        return np.zeros((0, weights.shape[1]))
    return np.add.reduceat(weights[grams], np.cumsum(n) - n) / n[:, None]


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


@dataclass
class LanguageModel:
    """Log probabilities of character n-grams in each language; a text's language makes its words' n-grams likeliest."""

    names: list[str]
    gram: np.ndarray

    def vectors(self, grams: np.ndarray, n: np.ndarray) -> np.ndarray:
        return _gram_means(self.gram, grams, n)


N_LENGTH = 4


def _length(n: np.ndarray, marked: np.ndarray) -> np.ndarray:
    one = np.ones(len(n))
    return np.where(marked[:, None], np.stack([one, np.log1p(n) / 2, n / 30.0, 0 * one], 1), np.stack([0 * one, 0 * one, 0 * one, one], 1))


@dataclass
class LevelModel:
    """Weights of words, character n-grams and length for each band, and the calibration of documents."""

    word: np.ndarray
    gram: np.ndarray
    length: np.ndarray
    document: dict[bool, np.ndarray] = field(default_factory=dict)

    def vectors(self, word: np.ndarray, grams: np.ndarray, n: np.ndarray) -> np.ndarray:
        return self.word[word] + _gram_means(self.gram, grams, n)

    def features(self, b: Batch, vectors: np.ndarray, letters: np.ndarray) -> np.ndarray:
        """A row of features for every document; zeros for those without words."""
        out = np.zeros((b.docs, 2 * BANDS + 5))
        if not len(b.slen):
            return out
        start, n = np.cumsum(b.slen) - b.slen, b.slen.astype(float)
        p = _softmax(np.add.reduceat(vectors[b.codes], start) / n[:, None] + _length(n, b.marked[b.sdoc]) @ self.length)
        total = np.bincount(b.sdoc, n, b.docs)
        has = total > 0
        mean = np.stack([np.bincount(b.sdoc, p[:, k] * n, b.docs) for k in range(BANDS)], 1)[has] / total[has, None]
        chars = np.bincount(b.sdoc, np.add.reduceat(letters[b.codes], start), b.docs)[has] / total[has]
        own = np.stack([np.log1p(total / np.maximum(1, np.bincount(b.sdoc, minlength=b.docs))), np.bincount(b.sdoc, n * n, b.docs) / np.maximum(1, total) / 30.0], 1)[has] * b.marked[has, None]
        out[has] = np.column_stack([mean, np.log(mean + 1e-3) / 3, own, mean @ np.arange(BANDS), chars / 5, np.ones(has.sum())])
        return out

    def bands(self, b: Batch, vectors: np.ndarray, letters: np.ndarray) -> np.ndarray:
        """The calibrated distribution over bands of every document."""
        x = self.features(b, vectors, letters)
        return _softmax(np.where(b.marked[:, None], x @ self.document[True], x @ self.document[False]))


def _softmax_fit(x: np.ndarray, y: np.ndarray, l2: float, steps: int = 400, rate: float = 0.1) -> np.ndarray:
    w, m, v = (np.zeros((x.shape[1], BANDS)) for _ in range(3))
    hot = np.eye(BANDS)[y]
    for t in range(1, steps + 1):
        g = x.T @ (_softmax(x @ w) - hot) / len(x) + l2 * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def _fit_sentences(batches: list[Batch], band: np.ndarray, names: list[str], steps: int = 120, l2: float = 2e-5) -> LevelModel:
    """Softmax regression on the sentences of ``batches``, each with the band (0 to 4) of its document."""
    used, tok = np.unique(np.concatenate([b.codes for b in batches]), return_inverse=True)
    n = np.concatenate([b.slen for b in batches])
    start = np.cumsum(n) - n
    lens = np.concatenate([_length(b.slen.astype(float), b.marked[b.sdoc]) for b in batches])
    hot = np.eye(BANDS)[np.concatenate([band[b.sdoc] for b in batches])]
    sent = np.repeat(np.arange(len(n)), n)
    wid, gid, glen = _features_of([names[i] for i in used])
    gword = np.repeat(np.arange(len(used)), glen)
    shapes = [(DIM, BANDS), (DIM, BANDS), (N_LENGTH, BANDS)]
    w = [np.zeros(s) for s in shapes]
    m, v = [np.zeros(s) for s in shapes], [np.zeros(s) for s in shapes]
    for t in range(1, steps + 1):
        per = w[0][wid] + _gram_means(w[1], gid, glen)
        d = (_softmax(np.add.reduceat(per[tok], start) / n[:, None] + lens @ w[2]) - hot) / len(start)
        back = (d / n[:, None])[sent]
        dper = np.stack([np.bincount(tok, back[:, k], len(used)) for k in range(BANDS)], 1)
        g0 = np.stack([np.bincount(wid, dper[:, k], DIM) for k in range(BANDS)], 1)
        dg = (dper / glen[:, None])[gword]
        g1 = np.stack([np.bincount(gid, dg[:, k], DIM) for k in range(BANDS)], 1)
        for i, g in enumerate((g0, g1, lens.T @ d)):
            g = g + l2 * w[i]
            m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
            w[i] -= 0.3 * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    return LevelModel(*w)


def _own(texts: list[str], quotes: list[Quotes]) -> tuple[Words, Batch]:
    """The words of texts that no test item has."""
    words = Words()
    b = words.read(texts)
    hit = np.zeros(len(b.codes), bool)
    for q in quotes:
        hit |= q.hits(b, words.names)
    return words, b.without(hit).windowed()


def fit(labelled: list[tuple[str, int]], quotes: list[Quotes]) -> LevelModel:
    """Both level models from (text, band from 1 to 5). Fewer than two usable texts give a model that calls everything band 1.

    The calibration sees sentence models that weren't fitted on the document at hand.
    """
    labelled = [(t, k) for t, k in labelled if t and 1 <= k <= BANDS]
    words, b = _own([t for t, _ in labelled], quotes)
    band = np.array([k - 1 for _, k in labelled], np.int64)
    good = np.bincount(b.sdoc, b.slen, b.docs) >= LEAST_WORDS
    if good.sum() < 2:
        model = LevelModel(np.zeros((DIM, BANDS)), np.zeros((DIM, BANDS)), np.zeros((N_LENGTH, BANDS)))
        flat = np.zeros((2 * BANDS + 5, BANDS))
        flat[-1, 0] = 20.0
        model.document = {True: flat, False: flat}
        return model
    bare, half = b.bare(), np.cumsum(good) % 2 == 0
    features, letters = _features_of(words.names), np.array([len(w) for w in words.names], float)
    seen: dict[bool, list] = {True: [], False: []}
    for own in (half, ~half):
        other = [x.of(good & ~own) for x in (b, bare)]
        m = _fit_sentences(other, band, words.names)
        vectors = m.vectors(*features)
        seen[False].append((m.features(bare, vectors, letters)[good & own], band[good & own]))
        seen[True].append((m.features(b, vectors, letters)[good & own & b.marked], band[good & own & b.marked]))
    model = _fit_sentences([b.of(good), bare.of(good)], band, words.names)
    for marked in (True, False):
        x, y = (np.concatenate([part[i] for part in seen[marked]]) for i in (0, 1))
        if not len(y):
            x, y = (np.concatenate([part[i] for part in seen[False]]) for i in (0, 1))
        model.document[marked] = _softmax_fit(x, y, 1e-3)
    return model


def fit_language(labelled: list[tuple[str, str]], quotes: list[Quotes]) -> LanguageModel:
    """The language model from (text, language): smoothed n-gram counts of the texts of each. Without any text there is no language."""
    names = sorted({lang for _, lang in labelled})
    counts = np.full((DIM, max(1, len(names))), 0.0)
    words, b = _own([t for t, _ in labelled], quotes)
    if len(b.codes):
        _, grams, n = _features_of(words.names)
        lang = np.array([names.index(k) for _, k in labelled])[b.owner]
        per = np.bincount(b.codes * len(names) + lang, minlength=len(n) * len(names)).reshape(len(n), len(names))
        for k in range(len(names)):
            counts[:, k] = np.bincount(grams, np.repeat(per[:, k], n), DIM)
    share = (counts + 0.5) / (counts + 0.5).sum(0)
    return LanguageModel(names, np.log(share))


def training_sample(docs: DataFrame, ident: str, text: str, labels: DataFrame, band: str, most: int = SAMPLE_DOCS) -> list[tuple[str, int]]:
    """(text, band) of at most ``most`` labelled documents, those first in the order of a hash; a document's band is the median of its raters'."""
    per = labels.where(F.col(band).isNotNull()).groupBy(F.col(ident).alias("__doc")).agg(F.round(F.median(band)).cast("int").alias("__band"))
    chosen = per.orderBy(F.xxhash64("__doc"), "__doc").limit(most)  # bounded: it can be broadcast
    rows = docs.select(F.col(ident), F.col(text).alias("__text")).where(F.col("__text").isNotNull() & (F.length("__text") <= SAMPLE_CHARS)).join(F.broadcast(chosen), F.col(ident) == F.col("__doc"))
    return [(r[0], r[1]) for r in rows.orderBy("__doc").select("__text", "__band").collect()]


def language_sample(docs: DataFrame, ident: str, text: str, lang: str, most: int = LANGUAGE_DOCS) -> list[tuple[str, str]]:
    """(text, language) of about ``most`` documents of each language, by a hash of the id. A language is a label's part before a dash, without regard to case.

    Labels may be wrong at times: the model only needs most of them right.
    """
    kind = F.split(canon_name(lang), "[-_]")[0]
    own = docs.select(F.col(ident).alias("__doc"), F.col(text).alias("__text"), kind.alias("__lang")).where(F.col("__lang").isNotNull() & F.col("__text").isNotNull() & (F.length("__text") <= SAMPLE_CHARS))
    n = own.groupBy("__lang").count().where(F.col("count") >= LEAST_DOCS).orderBy(F.desc("count"), "__lang").limit(LANGUAGES).collect()
    if not n:
        return []
    place = F.pmod(F.xxhash64("__doc"), F.lit(1 << 40))
    wanted = F.create_map(*[x for r in n for x in (F.lit(r[0]), F.lit(min(1 << 40, (most << 40) // r[1])))])
    rows = own.where(place < wanted[F.col("__lang")]).orderBy(place, "__doc").select("__text", "__lang").limit(2 * most * len(n))
    return [(r[0], r[1]) for r in rows.collect()]


SCORES = pa.schema([("doc", pa.int64()), ("lang", pa.string()), ("n_words", pa.int32()), ("n_sentences", pa.int32()), ("band", pa.int32()), ("expected", pa.float64()), ("p_hard", pa.float64())])


class Scorer:
    """Scores texts by both models; the weights of words it has met are kept."""

    def __init__(self, model: LevelModel, language: LanguageModel, quotes: Quotes):
        self.model, self.language, self.quotes = model, language, quotes
        self._forget()

    def _forget(self) -> None:
        self.words = Words()
        self.vectors = np.zeros((0, BANDS))
        self.tongues = np.zeros((0, self.language.gram.shape[1]))
        self.letters = np.zeros(0)

    def _learn(self) -> None:
        new = self.words.names[len(self.letters) :]
        if new:
            word, grams, n = _features_of(new)
            self.vectors = np.concatenate([self.vectors, self.model.vectors(word, grams, n)])
            self.tongues = np.concatenate([self.tongues, self.language.vectors(grams, n) * n[:, None]])
            self.letters = np.concatenate([self.letters, [len(w) for w in new]])

    def marks(self, texts: list[str | None]) -> list[bytes]:
        """Which words of each text lie in a quotation, as bits."""
        b = self.words.read(texts)
        ends = np.cumsum(np.bincount(b.sdoc, b.slen, b.docs).astype(np.int64))[:-1]
        return [np.packbits(x).tobytes() for x in np.split(self.quotes.hits(b, self.words.names), ends)]

    def score(self, idents: list, texts: list[str | None], marks: list[bytes] | None = None) -> pa.RecordBatch:
        if len(self.words) > KEPT_WORDS:
            self._forget()
        b = self.words.read(texts)
        self._learn()
        hit = self.quotes.hits(b, self.words.names)
        if marks is not None:
            n = np.bincount(b.sdoc, b.slen, b.docs).astype(np.int64)
            hit |= np.concatenate([np.unpackbits(np.frombuffer(m or b"", np.uint8), count=k) if k else np.zeros(0, np.uint8) for m, k in zip(marks, n, strict=True)]).astype(bool)
        b = b.without(hit).windowed()
        n = np.bincount(b.sdoc, b.slen, b.docs).astype(np.int32)
        lang = np.full(b.docs, "", object)
        if len(b.codes) and self.language.names:
            start = np.cumsum(b.slen) - b.slen
            per = np.add.reduceat(self.tongues[b.codes], start)
            sums = np.stack([np.bincount(b.sdoc, per[:, k], b.docs) for k in range(per.shape[1])], 1)
            lang[n > 0] = np.array(self.language.names, object)[sums.argmax(1)][n > 0]
        p = self.model.bands(b, self.vectors, self.letters)
        no = ~((n >= LEAST_WORDS) & (lang == "en"))
        cols = [idents, lang.tolist(), n, np.bincount(b.sdoc, minlength=b.docs).astype(np.int32), (p.argmax(1) + 1).astype(np.int32), p @ np.arange(1, BANDS + 1), p[:, 3:].sum(1)]
        arrays = [pa.array(c, f.type, mask=no if f.name in ("band", "expected", "p_hard") else None) for c, f in zip(cols, SCORES, strict=True)]
        return pa.RecordBatch.from_arrays(arrays, schema=SCORES)


def _parts(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in parts of about PART_CHARS characters."""
    at, size = 0, 0
    lengths = [len(t) if t else 0 for t in b.column(1).to_pylist()]
    for i, n in enumerate(lengths):
        size += n
        if size >= PART_CHARS:
            yield b.slice(at, i + 1 - at)
            at, size = i + 1, 0
    if at < len(b):
        yield b.slice(at)


def reading_levels(docs: DataFrame, ident: str, text: str, model: LevelModel, language: LanguageModel, quotes: list[Quotes]) -> DataFrame:
    """(doc, lang, n_words, n_sentences, band, expected, p_hard) of every document.

    ``band`` is the likeliest band, ``expected`` its mean, ``p_hard`` the probability of band 4 or 5. Documents with
    fewer than LEAST_WORDS words of prose of their own (one-line answers, bare links, null texts) or not in English have null there.
    Of several blocks of test items each but the last costs a pass that writes which words it quotes, so one block at a time is in memory.
    """
    flat = docs.select(F.col(ident).cast("bigint").alias("doc"), F.col(text).alias("text"))
    for q in quotes[:-1]:
        seen = "marks" in flat.columns

        def mark(batches: Iterator[pa.RecordBatch], q=q, seen=seen) -> Iterator[pa.RecordBatch]:
            scorer = Scorer(model, language, q)
            for b in batches:
                for part in _parts(b):
                    new = scorer.marks(part.column(1).to_pylist())
                    if seen:
                        new = [bytes(x | y for x, y in zip(a, c, strict=True)) for a, c in zip(part.column(2).to_pylist(), new, strict=True)]
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(new, pa.binary())], names=["doc", "text", "marks"])

        flat = stored(flat.mapInArrow(mark, "doc bigint, text string, marks binary"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model, language, quotes[-1])
        for b in batches:
            for part in _parts(b):
                yield scorer.score(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist() if part.num_columns > 2 else None)

    return flat.mapInArrow(run, "doc bigint, lang string, n_words int, n_sentences int, band int, expected double, p_hard double")
