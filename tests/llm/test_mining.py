"""Phrases, hard negatives and the positive-unlabelled classifier, against brute force and on edge cases."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import negatives, phrases, positives

RNG = random.Random(11)
WORDS = ["New", "york", "times", "the", "of", "a|b", "é", "x"]
LINES = ["new york times said", "NEW York\ttimes", "the  of", "of the", ""]


def sentence(n):
    return " ".join(RNG.choice(WORDS) if RNG.random() < 0.6 else RNG.choice(LINES) + RNG.choice([".", "", ",\n"]) for _ in range(n))


@pytest.fixture(scope="module")
def texts(spark):
    rows = [(i % 9 or None, sentence(RNG.randint(1, 30)), [None, "en", "und", "fr"][i % 4], "x", 1, 2) for i in range(60)]
    rows += [rows[5], rows[5], (None, None, None, None, None, None), (1, "", "en", "", 0, 0), (2, " \t.\n;", "de", "", 0, 0), (3, "a" * 5000 + " new york " * 900, "en", "", 0, 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, word string, key long, n long")


def brute_phrases(rows, least, most):
    upper = {i: i + 32 for i in range(65, 91)}
    f, totals = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(upper)):
            words = re.findall("[^ \t]+", piece)
            totals[lang] += len(words)
            f.update((lang, *words[i : i + k]) for k in range(1, 5) for i in range(len(words) - k + 1))
    found = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    inside = Counter()
    for (lang, *words), a in found.items():
        for i in range(len(words)):
            for j in range(i + 2, len(words) + 1):
                if j - i < len(words):
                    inside[(lang, *words[i:j])] = max(inside[(lang, *words[i:j])], a)
    out = []
    for p, a in found.items():
        if 100 * inside[p] >= 80 * a:
            continue
        lang, *words = p
        cuts = [(2000000 * a // (f[(lang, *words[:k])] + f[(lang, *words[k:])]), k) for k in range(1, len(words))]
        score, k = min(cuts)
        out.append((lang, -score, -a, " ".join(words).encode(), f[(lang, *words[:k])], f[(lang, *words[k:])]))
    result, ranks = [], Counter()
    for lang, score, a, phrase, le, r in sorted(out):
        ranks[lang] += 1
        if ranks[lang] <= most:
            result.append((lang, ranks[lang], phrase.decode(), -a, le, r, totals[lang], -score))
    return result


@pytest.mark.parametrize("least, most, bound", [(5, 2000, 1_000_000), (2, 7, 0)])
def test_phrases_equal_brute_force(texts, monkeypatch, least, most, bound):
    monkeypatch.setattr(phrases, "BROADCAST", bound)
    got = phrases.report(texts, least=least, most=most)
    want = brute_phrases([(r["lang"], r["text"]) for r in texts.collect()], least, most)
    assert want and sorted(map(tuple, got.collect())) == sorted(want)
    assert not texts.sparkSession.catalog.listTables()


def test_phrases_of_nothing(texts):
    assert phrases.report(texts.limit(0)).collect() == []
    assert phrases.report(texts.select("lang", "text"), least=10**6).collect() == []


def test_a_shared_hash_is_found(spark):
    rows = [(1, "en", "a", 2), (1, "en", "a", 3), (2, "en", "b", 1), (2, "fr", "b", 1), (3, "en", "c", 1), (3, "en", "d", 1), (0, "en", "e", 1)]
    got = phrases.by_key(spark.createDataFrame(rows, "key long, lang string, word string, n long"))
    assert {(r["key"], r["n"], r["shared"]) for r in got.collect()} == {(1, 5, False), (2, 2, True), (3, 2, True), (0, 1, True)}
    assert phrases.Keys("en", 0)[b"a"] != phrases.Keys("en", 1)[b"a"] != phrases.Keys("fr", 1)[b"a"]


def test_scores_are_exact(spark):
    big = 9_000_000_000_000_000_000
    rows = spark.createDataFrame([(big, [big, big], [big, 2 * 10**6]), (7, [3, 3], [4, 4])], "a long, pre array<long>, suf array<long>")
    got = [tuple(r) for r in phrases.score(rows).select("l", "r", "score").collect()]
    assert got == [(big, big, 1000000), (3, 4, 2000000)]


def test_windows_of_neighbours_dont_cross_pieces():
    assert phrases.tokens("A b.c\td\ne".encode()) == [b"a", b"b", b"\xff", b"c", b"d", b"\xff", b"e"]


# hard negatives


def brute_negatives(rows, anchors, k, m, low, high):
    out = []
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    for i, (aid, alabel, av) in enumerate(rows):
        if not anchors(aid):
            continue
        scored = sorted((-dot(av, v), vid, j, label) for j, (vid, label, v) in enumerate(rows) if j != i)
        for ps, pid, _, _ in [s for s in scored if s[3] == alabel][:k]:
            hard = [s for s in scored if s[3] != alabel and low * -ps <= 100 * -s[0] <= high * -ps][:m]
            out += [(aid, pid, n, s[1], -ps, -s[0]) for n, s in enumerate(hard, 1)]
    return sorted(out)


@pytest.mark.parametrize("scale, shard, block", [(1, 7, 3), (1, 8192, 512), (2.0**23, 9, 100)])
def test_negatives_equal_brute_force(spark, scale, shard, block):
    rng = np.random.default_rng(3)
    rows = [(i, i % 3, (rng.integers(-4, 5, size=6) / 16 * scale).tolist()) for i in range(90)]
    rows += [(90, 0, [0.0] * 6), (100, 1, [0.0] * 6), (101, 1, [0.25 * scale, 0.5 * scale]), (102, 2, []), (3, 2, [0.125 * scale] * 6)]
    bad = [(None, 1, [0.0]), (110, None, [0.0]), (120, 1, None), (130, 1, [float("nan")]), (140, 1, [math.inf]), (150, 1, [None, 0.5])]
    table = spark.createDataFrame([(*r, 1, 2) for r in rows + bad + rows[:4]], "vec_id long, label int, embedding array<double>, row long, shard long")
    got = negatives.mine(table, anchors=F.col("vec_id") % 10 == 0, positives=4, negatives=3, shard=shard, block=block)
    whole = [(i, label, [math.floor(256 * x) for x in v]) for i, label, v in rows]
    want = brute_negatives(whole, lambda i: i % 10 == 0, 4, 3, 50, 95)
    assert want and sorted(map(tuple, got.collect())) == want
    assert negatives.mine(table.limit(0)).collect() == []


def test_reading_stops_early_and_loses_no_tie():
    rng = np.random.default_rng(4)
    vectors = np.concatenate([rng.integers(-9, 10, size=(4000, 4)), [[200, -200, 200, 200]] * 7]).astype(float)
    ids = rng.permutation(len(vectors)).astype(np.int64)
    shard = negatives.Shard(np.arange(len(ids)), ids, vectors)
    anchor = np.array([3.0, -2.0, 0.0, 1.0])
    met = [len(at) for at, _, _ in shard.read(anchor)]
    assert sum(met) == len(ids) and len(met) > 4
    read = []
    plain = shard.read
    shard.read = lambda a: (read.append(len(x[0])) or x for x in plain(a))
    got = negatives.positives_of(shard, -1, anchor, 5)
    want = sorted((-int(v @ anchor), int(i)) for v, i in zip(vectors, ids))[:5]
    assert [(-s, i) for s, i, _ in got] == want and sum(read) < 200


# the positive-unlabelled classifier


def corpus(n, rng):
    rows = []
    for i in range(n):
        words = [rng.choice(["tree", "water", "The", "and", "house", "of", "river.", "long"]) for _ in range(rng.randint(15, 200))]
        bad = i % 5 == 0
        rows.append((i, " ".join(w.upper() + "!!" if bad and i % 2 else w + " |" if bad else w for w in words), int(not bad)))
    return rows


def test_classifier_learns_from_positives_and_unlabelled(spark):
    rows = corpus(1500, random.Random(2))
    docs = spark.createDataFrame([(i, t, 1, b"") for i, t, _ in rows] + [(None, None, 1, b""), (-1, "", 1, b""), (-2, "word " * 300_000, 1, b"")], "doc_id long, text string, quality int, measures binary")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows if i % 3] + [(1, None), (None, 1), (4, 0)], "doc_id long, quality int")
    measures = positives.measures_of(docs)
    model = positives.train(measures, labels)
    assert 0.6 < model.prior < 0.95  # four in five
    got = {r["doc_id"]: r["score"] for r in positives.score(measures, model).collect()}
    truth = {i: q for i, _, q in rows}
    out = [i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([(got[i] >= positives.BAR) == truth[i] for i in out]) > 0.97
    assert all(0 <= s <= 1 for s in got.values()) and got[None] == got[-1] and len(got) == docs.count()
    # labels of the held-out quarter change nothing
    other = positives.train(measures, labels.withColumn("quality", F.when(positives.held_out(F.col("doc_id")), 0).otherwise(F.col("quality"))))
    assert np.allclose(other.weights, model.weights) and other.centre == model.centre
    # one label alone: the bar is where the model puts the posterior
    alone = positives.train(measures, labels.filter("quality = 1"))
    assert alone.centre == pytest.approx(2 * positives.BAR - 1)
    got = {r["doc_id"]: r["score"] for r in positives.score(measures, alone).collect()}
    assert np.mean([(got[i] >= positives.BAR) == truth[i] for i in out]) > 0.9


def test_classifier_without_rows(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0)], "doc_id long, quality int")
    measures = positives.measures_of(docs)
    assert [r["score"] for r in positives.score(measures, positives.train(measures, labels)).collect()] == [pytest.approx(0, abs=1e-6)]
    none = positives.measures_of(docs.limit(0))
    assert positives.score(none, positives.train(none, labels.limit(0))).count() == 0


def test_risk_from_moments_equals_the_plain_sums():
    rng = np.random.default_rng(1)
    rows = rng.random((50, len(positives.MEASURES))).astype(np.float32) * 3
    features = positives.spread(rows)
    assert np.allclose(features[:, :-1].sum(axis=1), len(positives.MEASURES))
    moments = positives.Moments(50, features.T @ features / 50)
    w = rng.normal(size=positives.WIDTH)
    for y in (1, -1):
        assert moments.loss(w, y) == pytest.approx(np.mean((features @ w - y) ** 2) / 4)
        step = 1e-6 * rng.normal(size=positives.WIDTH)
        assert (moments.loss(w + step, y) - moments.loss(w - step, y)) / 2 == pytest.approx(moments.slope(w, y) @ step, rel=1e-4)
    assert np.allclose(positives.inverse(moments.second + np.eye(positives.WIDTH)) @ (moments.second + np.eye(positives.WIDTH)), np.eye(positives.WIDTH))


def test_the_risk_stays_non_negative():
    rng = np.random.default_rng(5)
    p, u = (positives.spread(rng.random((n, len(positives.MEASURES)))) for n in (12, 40))  # fewer rows than features
    p, u = positives.Moments(12, p.T @ p / 12), positives.Moments(40, u.T @ u / 40)
    w = positives.minimise(p, u, 0.9)
    kept, rest = positives.risk(w, p, u, 0.9)
    assert kept >= 0 and kept + max(0, rest) < 0.2  # 0.25 at the start


def test_prior_and_cut():
    p, u = np.zeros(positives.BINS), np.zeros(positives.BINS)
    p[3000:3100] = 1000
    u[3000:3100] = 600
    u[500:600] = 400
    assert positives.prior_of(p, u) == pytest.approx(0.6, abs=0.02)
    assert positives.cut_of(u, p) == pytest.approx(8 * 1800 / 4000 - 4, abs=0.01)  # between 600 and 3000
