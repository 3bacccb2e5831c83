"""Scores of texts against sums over listed segmentations."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from proofline.llm import scoring

DOCS = "doc_id long, text string"
SCORES = {b" a": -2.0, b" ab": -3.0, b"a": -4.0, b"b": -5.0, b"ab": -6.0, b"ba": -7.0, b"abc": -8.0, b"cd": -9.0, "é".encode(): -10.0}


def cuts(text, shares):
    """Every way to write bytes as pieces."""
    if not text:
        return [[]]
    return [[text[:n], *rest] for n in range(1, len(text) + 1) if text[:n] in shares for rest in cuts(text[n:], shares)]


def weights_of(shares, found=None):
    """Weight of every piece, and of a word's end under None."""
    raw = {p: 1000 * x + (found or {}).get(p, 0) for p, x in shares.items()}
    raw[None] = 1000 + found[None] if found else 1000 * math.fsum(x for p, x in shares.items() if p[:1] != b" ")
    opening = math.fsum(x for p, x in raw.items() if p and p[:1] == b" ")
    other = math.fsum(x for p, x in raw.items() if not p or p[:1] != b" ")
    return {p: x / (opening if p and p[:1] == b" " else other) for p, x in raw.items()}


def ways(word, shares, weights):
    found = cuts(b" " + word.encode(), shares)
    return [(way, math.prod(weights[p] for p in way) * weights[None]) for way in found]


def plain(docs, rounds):
    shares = scoring.shares_of(SCORES)
    tokens = [re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for _, t in docs]
    out = [i is not None and zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in docs]
    counts = Counter(w for ws, o in zip(tokens, out, strict=True) if not o for w in [*ws, ""])
    total, distinct = sum(counts.values()), len(counts)
    weights = weights_of(shares)
    for _ in range(rounds):
        found = Counter()
        for word in counts:
            if word:
                listed = ways(word, shares, weights)
                for way, p in listed:
                    for piece in way:
                        found[piece] += p / math.fsum(q for _, q in listed)
                found[None] += 1
        weights = weights_of(shares, found)
    words = [n for w, n in counts.items() if w]
    once, twice = words.count(1), words.count(2)
    discount = once / (once + 2 * twice) if once and twice else 0.5
    share = (discount * len(words) + 1) / (total + 2)

    def probability(word):
        if not word:
            return (counts[""] + 1) / (total + 2)
        return max(counts[word] - discount, 0) / (total + 2) + share * math.fsum(p for _, p in ways(word, shares, weights))

    rows = []
    for (i, _), ws, held in zip(docs, tokens, out, strict=True):
        ws = [*ws, ""]
        base = math.fsum(math.log10((counts[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in ws)
        rows.append((i, held, len(ws), sum(counts[w] > 0 for w in ws), total, base, math.fsum(math.log10(probability(w)) for w in ws)))
    return sorted(rows, key=repr)


@pytest.fixture
def small_vocabulary(monkeypatch):
    monkeypatch.setattr(scoring, "read_vocabulary", lambda spark, path: scoring.shares_of(SCORES))


def texts(rng, count):
    pool = ["".join(rng.choice("abcdéxA") for _ in range(rng.randint(1, 7))) for _ in range(40)]
    return [(i, rng.choice([" ", "\n\t "]).join(rng.choices(pool, k=rng.randint(0, 30)))) for i in range(count)]


@pytest.mark.parametrize("rounds", [0, 1, 2])
def test_scores_are_sums_over_all_segmentations(spark, small_vocabulary, monkeypatch, rounds):
    docs = texts(random.Random(rounds), 60) + [(3, None), (4, ""), (None, "ab abc d"), (None, "new"), (5, "twice"), (5, "twice")]
    expected = plain(docs, rounds)
    assert any(r[1] for r in expected)
    for size in (scoring.SLICE, 40):
        monkeypatch.setattr(scoring, "SLICE", size)
        found = scoring.scores(spark.createDataFrame(docs, DOCS).repartition(3), rounds=rounds)
        rows = sorted((tuple(r) for r in found.collect()), key=repr)
        assert [r[:5] for r in rows] == [r[:5] for r in expected]
        # Expected numbers are summed in parts of 1,024.
        np.testing.assert_allclose([r[5] for r in rows], [r[5] for r in expected], rtol=1e-12)
        np.testing.assert_allclose([r[6] for r in rows], [r[6] for r in expected], rtol=1e-4)


def test_probabilities_of_all_short_words_do_not_exceed_one():
    shares = scoring.shares_of({b" a": -1.0, b"b": -2.0, b" ab": -3.0, b"ba": -4.0})
    pieces = scoring.tree_of(shares)
    listed = [""]
    total = 0.0
    for _ in range(3):
        listed = [w + c for w in listed for c in map(chr, range(1, 128)) if c not in " \t\n\x0b\x0c\r"]
        total += math.fsum(np.exp(scoring.word_scores(pa.array(listed[:200_000]), pieces)))
        if len(listed) > 20_000:
            break
    assert 0 < total < 1


def test_long_words_and_short_ones_take_the_same_recursion():
    pieces = scoring.tree_of(scoring.shares_of(SCORES))
    word = "abcdé" * 40
    long = word + "ab" * 200
    together = scoring._pass(scoring.edges_of(pa.array([word, long]), pieces), pieces.weights, False)
    alone = scoring._pass(scoring.edges_of(pa.array([long]), pieces), pieces.weights, False)
    np.testing.assert_allclose(alone, together[-len(alone) :], rtol=1e-12)
    back = scoring._pass(scoring.edges_of(pa.array([long]), pieces), pieces.weights, True)
    assert back[0] == pytest.approx(alone[-1], rel=1e-12)


def test_vocabulary_is_read_as_pieces_that_words_can_hold(spark):
    shares = scoring.read_vocabulary(spark)
    assert math.fsum(shares.values()) == pytest.approx(1)
    assert all(bytes([b]) in shares for b in range(256))
    assert b" the" in shares and b"the" in shares and b"The" not in shares
    assert not any(re.search(rb"[A-Z]", p) and len(p) > 1 or b" " in p[1:] for p in shares)


def test_an_end_of_a_text_and_a_very_long_word(spark, small_vocabulary):
    docs = [(0, None), (2, "é" * 30_000), (3, "ab ab " * 20_000)]
    rows = {r.doc_id: r for r in scoring.scores(spark.createDataFrame(docs, DOCS)).collect()}
    assert [rows[i].n_tokens for i in (0, 2, 3)] == [1, 2, 40_001]
    assert all(math.isfinite(r.score) and r.score < 0 for r in rows.values())
    assert scoring.scores(spark.createDataFrame([], DOCS)).collect() == []


def test_scores_that_are_logarithms_are_shares(spark):
    shares = scoring.shares_of({b" x": math.log(0.25), b"y": math.log(0.75)})
    assert shares[b" x"] == pytest.approx(0.25 * (1 - scoring.BYTE_SHARE))
