"""Phrase search and quantiles against plain Python."""

import random

import numpy as np
from pyspark.sql import functions as F

from proofline.functions import text as X
from proofline.operators import phrases as PH
from proofline.operators import questions as QS
from proofline.operators.quantiles import quantiles


def _case(seed):
    """Texts and phrases over few words; half of the phrases open with the same four."""
    draw = random.Random(seed)
    word = lambda: draw.choice(["a", "b", "cd", "e5", "ff"])
    texts = [(i, " ".join(word() for _ in range(draw.randint(0, 60)))) for i in range(60)]
    texts += [(60, None), (61, "..."), (62, "A--b\nCD"), (63, "a b a b a b a b a b")]
    shared = [(i, "a b a b " + " ".join(word() for _ in range(draw.randint(0, 9)))) for i in range(40)]
    other = [(40 + i, " ".join(word() for _ in range(draw.randint(1, 7)))) for i in range(40)]
    return texts, shared + other + [(90, None), (91, " ? "), (92, "a B!"), (93, "a b")]


def _plain(texts, phrases):
    import re

    split = lambda t: re.findall("[0-9a-z]+", t.lower())
    found = set()
    for i, t in texts:
        for k, p in phrases:
            if t is None or p is None or not split(p):
                continue
            have, want = split(t), split(p)
            if any(have[at : at + len(want)] == want for at in range(len(have))):
                found.add((i, k))
    return found


def test_phrases_with_one_opening_are_found_both_ways(spark):
    for seed in (1, 2):
        texts, phrases = _case(seed)
        said = spark.createDataFrame(texts, "id INT, text STRING").select("id", X.normalize_words(F.col("text")).alias("words"))
        asked = spark.createDataFrame(phrases, "key INT, phrase STRING")
        wanted = _plain(texts, phrases)
        for most in (PH.AUTOMATON_CHARS, 0):
            rows = [(r.id, r.key) for r in PH.phrase_hits(said, asked, "id", "key", most).collect()]
            assert len(rows) == len(set(rows)) and set(rows) == wanted
        left = {r.id for r in PH.without_phrases(said, asked, "id", "key").collect()}
        assert left == {i for i, _ in texts} - {i for i, _ in wanted}


def test_no_phrases_and_no_texts(spark):
    texts, phrases = _case(3)
    said = spark.createDataFrame(texts, "id INT, text STRING").select("id", X.normalize_words(F.col("text")).alias("words"))
    asked = spark.createDataFrame(phrases, "key INT, phrase STRING")
    for most in (PH.AUTOMATON_CHARS, 0):
        assert PH.phrase_hits(said.where("id < 0"), asked, "id", "key", most).count() == 0
        assert PH.phrase_hits(said, asked.where("key < 0"), "id", "key", most).count() == 0
    assert PH.phrase_hits(said, asked.where("key = 91"), "id", "key").count() == 0


def test_a_phrase_set_in_reach_moves_no_text(spark):
    texts, phrases = _case(4)
    path = spark.createDataFrame(texts, "id INT, text STRING").select("id", X.normalize_words(F.col("text")).alias("words"))
    known = [" a b ", " ff "]
    plan = path.select("id", PH.said(F.col("words"), known))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_leaks_name_whole_words_of_a_split(spark):
    rows = [("1", "Is the Acme-Corp fine?", "eval"), ("2", "Is acme corporate?", "eval"), ("3", "ACME corp", "dev"),
            ("4", "Now FILL IN x", "dev"), ("5", None, "eval")]
    cases = spark.createDataFrame(rows, "id STRING, question STRING, split STRING")
    assert sorted(r.id for r in QS.leaks(cases, ["Acme Corp", "--"], "fill in").collect()) == ["1", "4"]


def test_quantiles_are_exact_for_every_shape_of_values(spark):
    draw = np.random.default_rng(7)
    groups = {
        "even": draw.normal(size=30_001), "ties": draw.integers(0, 3, 20_000).astype(float),
        "hot": np.r_[np.full(20_000, 4.5), draw.random(10_000)], "wide": np.exp(draw.normal(size=9_999) * 40),
        "one": np.array([2.5]), "two": np.array([1.0, 2.0]),
    }
    shares = [0.0, 0.05, 0.5, 0.95, 0.999, 1.0]
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [(None, 3.0), ("none", None), ("two", None)]
    table = spark.createDataFrame(rows, "g STRING, v DOUBLE")
    for accuracy in (10_000, 20):  # a coarse sketch only widens what is counted
        got = {r.g: r for r in quantiles(table, ["g"], "v", shares, accuracy).collect()}
        assert set(got) == {*groups, None, "none"}
        for g, vs in groups.items():
            assert got[g].n == len(vs)
            assert np.allclose(got[g].q, np.quantile(vs, shares), rtol=1e-12, atol=0)
        assert (got["none"].rows, got["none"].n, got["none"].q) == (1, 0, None)
        assert (got["two"].rows, got[None].q) == (3, [3.0] * 6)
    alone = quantiles(table, [], "v", [0.5]).collect()
    assert len(alone) == 1 and alone[0].n == len(rows) - 2


def test_a_bracket_that_misses_its_rank_is_opened(spark, monkeypatch):
    table = spark.range(1000).select(F.col("id").cast("double").alias("v"))
    real = F.percentile_approx

    def wrong(column, ends, accuracy):
        brackets = accuracy._jc.toString() == "100"  # the cuts of running totals stay as they are
        return real(column, F.array(F.lit(0.1), F.lit(0.2)) if brackets else ends, accuracy)

    monkeypatch.setattr(F, "percentile_approx", wrong)
    got = quantiles(table, [], "v", [0.05, 0.9], accuracy=100)
    monkeypatch.undo()
    assert np.allclose(got.first().q, [49.95, 899.1])
