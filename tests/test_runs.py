import random

import pyarrow as pa

from proofline.operators import phrases as PH


def _tables(spark):
    rnd = random.Random(1)
    said = lambda n: " ".join(rnd.choice("abcd") for _ in range(n))
    texts = [(i, f" {said(rnd.randint(0, 60))} ") for i in range(200)] + [(900, None), (901, "  "), (5, " a b c ")]
    phrases = [(i, said(rnd.randint(1, 7))) for i in range(100)] + [(998, "!!"), (999, None)]
    asked = {(t, p) for t, words in texts if words for p, phrase in phrases if phrase and phrase != "!!" and f" {phrase} " in words}
    return spark.createDataFrame(texts, "t long, words string"), spark.createDataFrame(phrases, "p long, phrase string"), asked


def test_runs_and_automaton_find_every_phrase(spark, monkeypatch):
    texts, phrases, asked = _tables(spark)
    monkeypatch.setattr(PH, "SLICE_BYTES", 200)
    monkeypatch.setattr(PH, "SLICE_TEXTS", 3)
    for most in (0, 10**9):
        found = [(r.t, r.p) for r in PH.phrase_hits(texts, phrases, "t", "p", most_chars=most).collect()]
        assert len(found) == len(set(found)) and set(found) == asked


def test_a_full_filter_loses_nothing(spark, monkeypatch):
    texts, phrases, asked = _tables(spark)
    monkeypatch.setattr(PH, "LEAST_BITS", 1 << 6)
    monkeypatch.setattr(PH, "MOST_BITS", 1 << 6)
    assert {(r.t, r.p) for r in PH.phrase_hits(texts, phrases, "t", "p", most_chars=0).collect()} == asked


def test_only_likely_runs_leave_their_task(spark):
    texts = spark.createDataFrame([(1, " " + " ".join(f"w{i}" for i in range(2000)) + " ")], "t long, words string")
    hits = PH._hits_by_runs(texts, spark.createDataFrame([(" w7 w8 w9 ",), (" x ",)], "_phrase string"), "t")
    # Every run of a text was a row before.
    assert "Generate" not in hits._jdf.queryExecution().optimizedPlan().toString()
    assert [tuple(r) for r in hits.collect()] == [(1, " w7 w8 w9 ")]


def test_slices_hold_every_text():
    texts = pa.array(["", None, "abc", "d" * 5, "é"]).slice(1)
    whole = [(first, data.tobytes(), offsets.tolist()) for first, data, offsets in PH._slices(texts)]
    assert whole == [(0, b"abcddddd\xc3\xa9", [0, 0, 3, 8, 10])]
