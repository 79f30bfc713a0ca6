"""Language labels: forward-backward against enumeration, gradients, code-switched text, edge cases."""

from __future__ import annotations

import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from metricspark.llm import language_crf as lc

SYLLABLES = {"aa": ["tion", "the", "ing", "and"], "bb": ["ción", "que", "ñe", "los"], "cc": ["sch", "über", "ung", "ich"]}


def sentence(rng, lang, words):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(words))


def enumerate_chain(p, a, s):
    """Posteriors and expected transitions from all label sequences."""
    n, labels = p.shape
    post, pairs, total = np.zeros_like(p), np.zeros((labels, labels)), 0.0
    for path in itertools.product(range(labels), repeat=n):
        w = s[path[0]] * np.prod([p[t, y] for t, y in enumerate(path)]) * np.prod([a[x, y] for x, y in zip(path, path[1:])])
        total += w
        for t, y in enumerate(path):
            post[t, y] += w
        for x, y in zip(path, path[1:]):
            pairs[x, y] += w
    return post / total, pairs / total


def test_posteriors_against_enumeration():
    chance = np.random.default_rng(1)
    for labels in (1, 2, 3):
        counts = np.array([0, 7, 1, 0, 4, 3, 0])
        p, a, s = chance.random((15, labels)) + 0.01, chance.random((labels, labels)) + 0.01, chance.random(labels) + 0.01
        want, at = [], 0
        for n in counts[counts > 0]:
            want.append(enumerate_chain(p[at:at + n], a, s)[0])
            at += n
        for piece in (1, 2, 3, 64):
            assert lc.chain_posteriors(p, counts, a, s, piece) == pytest.approx(np.concatenate(want))
    same = chance.random((2, 5, 3)) + 0.01
    a, s = chance.random((3, 3)) + 0.01, chance.random(3) + 0.01
    gamma, pairs = lc._expected(same, a, s)
    both = [enumerate_chain(x, a, s) for x in same]
    assert gamma == pytest.approx(np.stack([x for x, _ in both])) and pairs == pytest.approx(sum(x for _, x in both))


def test_long_chains_are_stable():
    chance = np.random.default_rng(2)
    p = np.exp(chance.normal(0, 30, (50_000, 3)))
    p /= p.max(axis=1, keepdims=True)
    post = lc.chain_posteriors(p, np.array([49_999, 1]), np.exp(np.eye(3) * 3), np.ones(3))
    assert np.isfinite(post).all() and post.sum(axis=1) == pytest.approx(np.ones(50_000))
    assert post == pytest.approx(lc.chain_posteriors(p, np.array([49_999, 1]), np.exp(np.eye(3) * 3), np.ones(3), 977))


def test_words_and_features():
    words = lc.text_words(["", "Ça n'é 12 áb", "x", "́ 9"], lc.Letters())
    parts = ["".join(map(chr, words.codes[a:a + n])) for a, n in zip(words.starts, words.lengths)]
    assert parts == ["ça", "n", "é", "áb", "x"] and words.counts.tolist() == [0, 4, 1, 0]
    ids, counts = lc.gram_features(words.codes, words.starts, words.lengths)
    # a word of n letters has n + 3 - k n-grams of length k over itself and its two ends
    assert counts.tolist() == [sum(max(0, int(n) + 3 - k) for k in lc.GRAMS) for n in words.lengths] and len(ids) == counts.sum()
    hashes = words.hashes()
    assert len(set(hashes.tolist())) == 5 and hashes[4] == lc.text_words(["y X"], lc.Letters()).hashes()[1]


@pytest.fixture(scope="module")
def tagged(spark):
    rng = random.Random(6)
    rows = [(i, sentence(rng, lang, rng.randint(3, 60)), lang) for i, lang in enumerate(rng.choice(["aa", "aa", "bb", "cc"]) for _ in range(400))]
    docs = spark.createDataFrame(rows + [(None, "the tion", "aa"), (900, None, "aa"), (901, "9 - 8", None), (902, "", "bb")], "doc_id long, text string, lang string")
    return rows, docs, lc.train(docs)


def test_held_out_accuracy(spark, tagged, no_docs):
    rows, docs, _ = tagged
    got = {r.doc_id: r for r in lc.languages(docs.withColumn("score", F.lit("x")).withColumn("place", F.lit(1))).collect()}
    assert len(got) == docs.count() and all(r.held_out == (zlib.crc32(str("" if i is None else i).encode()) % 4 == 2) for i, r in got.items())
    wrong = [i for i, _, lang in rows if got[i].held_out and got[i].lang_pred != lang]
    assert len(wrong) <= 2 and all(0 <= r.score <= 1 for r in got.values())
    assert all(got[i].lang_pred == lc.UNKNOWN and got[i].score == 0 for i in (900, 901, 902)) and got[None].lang_pred == "aa"
    assert lc.languages(no_docs.withColumn("lang", F.lit("a"))).count() == 0
    nothing = lc.languages(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in nothing} == {lc.UNKNOWN}
    assert {r.lang_pred for r in lc.languages(docs.withColumn("lang", F.lit("xx"))).collect()} == {"xx", lc.UNKNOWN}


def test_held_out_labels_are_not_used(tagged):
    _, docs, model = tagged
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2
    other = lc.train(docs.withColumn("lang", F.when(held, "zz").otherwise(F.col("lang"))))
    assert other.langs == model.langs and (other.weights == model.weights).all()


def test_code_switched_text(spark, tagged):
    _, _, model = tagged
    rng = random.Random(7)
    rows, truth = [], {}
    for i in range(60):
        langs = rng.sample(sorted(SYLLABLES), 2)
        parts = [sentence(rng, lang, rng.randint(5, 15)) for lang in langs]
        rows.append((i, ", ".join(parts)))
        truth[i] = (langs, len(parts[0]))
    frame = spark.createDataFrame(rows * 2, "doc_id long, text string")
    right = total = 0
    for r in lc.tag_languages(frame, model).collect():
        langs, cut = truth[r.doc_id]
        assert [s.start for s in r.spans] == sorted(s.start for s in r.spans) and all(x.end <= y.start for x, y in zip(r.spans, r.spans[1:]))
        for s in r.spans:
            first = max(0, min(cut, s.end) - s.start)
            right += first * (s.lang == langs[0]) + (s.end - s.start - first) * (s.lang == langs[1])
            total += s.end - s.start
    assert right / total > 0.95


def test_edge_rows(spark, edge_docs):
    model = lc.train(edge_docs.withColumn("lang", F.col("source")))
    rows = lc.tag_languages(edge_docs, model).collect()
    assert len(rows) == edge_docs.count()
    texts = {(r.doc_id, r.text): r for r in edge_docs.select("doc_id", "text").collect()}
    assert len({(r.lang_pred, r.score) for r in rows if r.doc_id == 10}) == 1 and texts
    whole = {r.doc_id: r for r in rows}
    assert whole[4].lang_pred == whole[5].lang_pred == whole[6].lang_pred == lc.UNKNOWN
