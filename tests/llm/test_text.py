"""Training-text operators against brute force, exact sums and held-out accuracy."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("ancestra.llm")
from ancestra.llm import leaks, level, mix  # noqa: E402
from ancestra.llm.fmindex import FMIndex  # noqa: E402

DATA = "/root/testdata/sf0.1"  # sf0.01 has ten labelled documents of band 4 or 5, too few to tell shares by a tenth
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def test_index_finds_all_occurrences():
    rng = np.random.default_rng(3)
    for _ in range(120):
        n = int(rng.integers(0, 70))
        text = rng.integers(0, 4, n).astype(np.int32)
        index = FMIndex(text, 4)
        k = int(rng.integers(1, 6))
        phrases = rng.integers(1, 4, (8, k))
        for p, a, b in zip(phrases, *index.search(phrases), strict=True):
            want = [i for i in range(n - k + 1) if (text[i : i + k] == p).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def brute(docs, items, n):
    out = set()
    for d, t in docs:
        ws = leaks.words(t)
        grams = {tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)}
        for i, *parts in items:
            for p in parts:
                ps = leaks.words(p)
                if any(tuple(ps[j : j + n]) in grams for j in range(len(ps) - n + 1)):
                    out.add((d, i))
    return out


@pytest.mark.parametrize(("shard", "block"), [(10_000, 1000), (30, 30)])
def test_leaks_match_brute_force(spark, shard, block):
    rng = random.Random(5)
    word = lambda: rng.choice("a b c d Éa f2 g".split())
    docs = [(i, " ".join(word() for _ in range(rng.randrange(0, 90)))) for i in range(40)] + [(40, None), (41, ""), (42, "A, b; c! D-Éa f2 g " * 30)]
    items = [(i, " ".join(word() for _ in range(12)), " ".join(word() for _ in range(9))) for i in range(6)] + [(7, None, "a b"), (8, docs[3][1], "")]
    d = spark.createDataFrame(docs, "doc bigint, text string")
    q = spark.createDataFrame(items, "item bigint, p string, a string")
    spans = leaks.leaks(d, "doc", "text", q, "item", ["p", "a"], n=5, block_words=block, shard_words=shard)
    assert {tuple(r) for r in leaks.leaked_items(spans).collect()} == brute(docs, items, 5)
    text = dict(docs)
    for r in spans.collect():
        assert len(leaks.words(text[r.doc][r.from_char : r.to_char])) == r.n_words
    got = [(r.doc, r.from_char, r.to_char) for r in leaks.removal_spans(spans).collect()]
    by = {}
    for doc, a, b in sorted(got):
        assert by.get(doc, -1) < a
        by[doc] = b


def test_items_of_one_id_over_blocks(spark):
    rng = random.Random(3)
    parts = [" ".join(rng.choice("abcdefgh") + str(rng.randrange(50)) for _ in range(14)) for _ in range(4)]
    d = spark.createDataFrame([(i, f"x {p} y") for i, p in enumerate(parts)], "doc bigint, text string")
    q = spark.createDataFrame([(1, parts[0]), (2, parts[1]), (2, parts[2]), (3, parts[3]), (None, parts[0])], "item bigint, p string").withColumn("doc", F.lit(7))
    for words in (14, 5, 1000):
        got = leaks.leaked_items(leaks.leaks(d, "doc", "text", q, "item", ["p"], block_words=words))
        assert sorted(map(tuple, got.collect())) == [(0, 1), (1, 2), (2, 2), (3, 3)]


def test_leaks_of_nothing(spark):
    d = spark.createDataFrame([(1, "x")], "doc bigint, text string")
    q = spark.createDataFrame([], "item bigint, p string")
    assert leaks.leaks(d, "doc", "text", q, "item", ["p"]).collect() == []


def test_mix_meets_shares(spark):
    rng = random.Random(9)
    docs = [(i, rng.choice(["A", "a ", "b", "c", None]), "word " * rng.randrange(1, 30)) for i in range(3000)] + [(9001, "a", None)]
    d = spark.createDataFrame(docs, "doc bigint, source string, text string")
    t = spark.createDataFrame([("a", 0.6, 1), ("B", 0.3, 3), ("none", 0.1, 2)], "source string, target_share double, max_repeats int")
    drawn, report = mix.mix(d, "doc", "source", "text", t, TOKENIZER)
    got = {r.source: r for r in report.collect()}
    assert abs(got["a"].actual_share - 2 / 3) < 0.005 and abs(got["b"].actual_share - 1 / 3) < 0.005
    assert got["none"].actual_share == 0 and got["a"].most_copies == 1
    assert max(r.copies for r in drawn.collect()) <= 3 and drawn.where("source = 'c' or source is null").count() == 0
    small = {r.doc for r in mix.mix(d, "doc", "source", "text", t, TOKENIZER, total=3000)[0].collect()}
    large = {r.doc for r in mix.mix(d, "doc", "source", "text", t, TOKENIZER, total=9000)[0].collect()}
    assert small < large
    empty, none = mix.mix(d.limit(0), "doc", "source", "text", t, TOKENIZER)
    assert empty.collect() == [] and {r.n_tokens for r in none.collect()} == {0}


EASY = "the cat sat on a mat and the dog ran to my red box".split()
HARD = "the interoperability necessitates a multidimensional characterization notwithstanding the heterogeneous instrumentation which a probabilistic decomposition subordinates".split()


def make(rng, band):
    out = []
    for _ in range(rng.randrange(4, 8)):
        pool = HARD if rng.random() < (band - 1) / 4 else EASY
        out.append(" ".join(rng.choice(pool if rng.random() < 0.8 else EASY) for _ in range(4 + 5 * band)) + ".")
    return " ".join(out)


def languages(rng):
    texts = {"en": EASY + HARD, "de": "der Hund liegt nicht unter dem Tisch weil ich ihn schnell gesehen habe".split(), "fr": "le chien ne peut pas courir dans le jardin avec nous pour toujours".split()}
    return [(" ".join(rng.choice(ws) for _ in range(40)), lang) for lang, ws in texts.items() for _ in range(20)]


def test_levels_on_held_out_documents():
    rng = random.Random(2)
    docs = [(make(rng, b), b) for b in (1, 2, 4, 5) for _ in range(50)]
    rng.shuffle(docs)
    none = [level.Quotes([])]
    scorer = level.Scorer(level.fit(docs[:120], none), level.fit_language(languages(rng), none), none[0])
    right = 0
    for text, band in docs[120:]:
        forms = [text, text.replace(".", ""), "```\ninteroperability\n```\n" + text + " http://x.invalid/necessitates"]
        got = scorer.score([1, 2, 3], forms).to_pydict()
        assert got["lang"] == ["en"] * 3
        right += sum((p >= 0.5) == (band >= 4) for p in got["p_hard"])
    assert right >= 0.9 * 3 * 80


@pytest.mark.parametrize("block_words", [1000, 5])
def test_levels_leave_out_what_is_not_prose(spark, block_words):
    rng = random.Random(4)
    items = spark.createDataFrame([(" ".join(HARD[:9]), None), (None, "x y"), (" ".join(HARD[5:]), "")], "p string, q string").coalesce(1)
    quotes = level.quotations(items, ["p", "q"], block_words)
    assert len(quotes) == (1 if block_words == 1000 else 2)
    model = level.fit([(make(rng, b), b) for b in (1, 1, 5, 5) for _ in range(20)], [level.Quotes([])])
    tongue = level.fit_language(languages(rng), quotes)
    easy = " ".join(make(rng, 1) for _ in range(2))
    texts = [easy, easy + " " + " ".join(HARD) + ".", "Use a map.", "http://x.invalid/a", None, "", "le chat est sur la table et je ne peut pas plus ici avec nous dans le jardin pour toujours encore", make(rng, 5)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc bigint, text string").withColumn("lang", F.lit("x"))
    got = {r.doc: r for r in level.reading_levels(d, "doc", "text", model, tongue, quotes).collect()}
    assert got[0].p_hard < 0.5 and got[1].p_hard < 0.5 and got[7].p_hard >= 0.5
    assert got[0].n_words == got[1].n_words  # the quotation, whole, isn't the text's own
    assert all(got[i].band is None for i in range(2, 7)) and got[6].lang == "fr"
    assert level.reading_levels(d.limit(0), "doc", "text", model, tongue, quotes).collect() == []


@pytest.mark.skipif(not os.path.exists(f"{DATA}/documents.parquet"), reason="no test data")
def test_prose_without_function_words_is_english(spark):
    none = level.Quotes([])
    tongue = level.fit_language(level.language_sample(spark.read.parquet(f"{DATA}/documents.parquet"), "doc_id", "text", "lang"), [none])
    assert {"en", "de", "es", "fr"} <= set(tongue.names)
    scorer = level.Scorer(level.fit([], [none]), tongue, none)
    got = scorer.score([1, 2], ["Programmers often misunderstand pointer arithmetic", "She reads short books every day"]).to_pydict()
    assert got["lang"] == ["en", "en"] and got["band"] == [None, None]


def test_a_sample_without_labels_calls_nothing_hard():
    none = level.Quotes([])
    scorer = level.Scorer(level.fit([("x", 1), (None, 5)], [none]), level.fit_language([], [none]), none)
    assert scorer.score([1], [" ".join(HARD)]).to_pydict()["band"] == [None]


@pytest.mark.skipif(not os.path.exists(f"{DATA}/documents.parquet"), reason="no test data")
def test_bands_of_held_out_labelled_documents(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "level_label"))
    quotes = level.quotations(spark.read.parquet(f"{DATA}/eval_item.parquet"), ["prompt", "answer"])
    tongue = level.fit_language(level.language_sample(docs, "doc_id", "text", "lang"), quotes)
    known = level.training_sample(docs, "doc_id", "text", labels, "band")
    found = hard = wrong = 0
    for k in range(3):
        scorer = level.Scorer(level.fit([x for i, x in enumerate(known) if i % 3 != k], quotes), tongue, quotes[0])
        held = [x for i, x in enumerate(known) if i % 3 == k]
        got = scorer.score(list(range(len(held))), [t for t, _ in held]).to_pydict()["p_hard"]
        hard += sum(b >= 4 for _, b in held)
        found += sum(b >= 4 and p is not None and p >= 0.5 for p, (_, b) in zip(got, held, strict=True))
        wrong += sum(b < 4 and p is not None and p >= 0.5 for p, (_, b) in zip(got, held, strict=True))
    assert found >= 0.9 * hard and wrong <= 0.1 * hard, (hard, found, wrong)
