"""Spelling variants against a plain version over all pairs of words."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from proofline.llm import spelling
from proofline.llm.arrays import text_slices

DOCS = "doc_id long, text string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def one_edit(a, b):
    if len(a) < len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def counted(docs):
    found = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            if doc_id is not None and h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= 6 and n >= 5}


def plain(docs):
    words = counted(docs)
    near = {w: [x for x in words if x != w and one_edit(w, x)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-words[x], x), default=None)
        if best is not None and words[best] >= 5 * words[w]:
            form[w] = best
    rows = []
    for w in words:
        root = w
        while root in form:
            root = form[root]
        rows.append((w, form.get(w), root, words[w], len(near[w]), words[form[w]] if w in form else None))
    return sorted(rows)


def edited(rng, word, letters):
    at, kind = rng.randrange(len(word) + 1), rng.randrange(3)
    return word[:at] + ("" if kind == 1 else rng.choice(letters)) + word[at + (kind > 0) :]


def words_of(rng, letters, count, sizes=(6, 14)):
    base = ["".join(rng.choice(letters) for _ in range(rng.randint(*sizes))) for _ in range(count)]
    return base + [edited(rng, w, letters) for w in base for _ in range(3)]


def rows_of(table):
    return sorted(tuple(r) for r in table.select("word", "form", "root", "n", "n_near", "form_n").collect())


@pytest.mark.parametrize("letters", ["ab", "abcdeé", "abcdefghijklmnopqrstuvwxyzßÿ×"])
def test_variants_are_those_of_all_pairs(spark, letters):
    rng = random.Random(letters)
    pool = [(w, rng.choice([1, 5, 6, 30, 160])) for w in words_of(rng, letters, 60)]
    runs = [w.upper() if rng.random() < 0.1 and w.isascii() else w for w, n in pool for _ in range(n)]
    rng.shuffle(runs)
    docs = [(i, "".join(w + rng.choice([" ", ", ", " ", "\U0001f600", "7", "\n"]) for w in runs[i::40])) for i in range(40)]
    docs += [docs[0], (7, None), (8, ""), (None, " ".join(pool[0][0] for _ in range(30)))]
    assert rows_of(spelling.variants(spark.createDataFrame(docs, DOCS))) == plain(docs)


def test_long_lists_and_small_dictionaries_change_no_result(spark, monkeypatch):
    rng = random.Random(5)
    # Half of all words share their opening, so one list holds them.
    pool = words_of(rng, "abc", 60) + ["opening" + w for w in words_of(rng, "abcd", 60, (1, 4))]
    docs = [(i, " ".join(rng.choices(pool, k=600))) for i in range(30)]
    expected = plain(docs)
    assert len(expected) > 200
    monkeypatch.setattr(spelling, "MOST_LIST", 3)
    assert rows_of(spelling.variants(spark.createDataFrame(docs, DOCS))) == expected
    monkeypatch.setattr(spelling, "MOST_CUT", 8)
    assert rows_of(spelling.variants(spark.createDataFrame(docs, DOCS))) == expected
    monkeypatch.setattr(spelling, "MOST_GRAMS", 5)
    monkeypatch.setattr(spelling, "LONG_GRAM", 0)
    assert rows_of(spelling.variants(spark.createDataFrame(docs, DOCS))) == expected


def test_forms_are_followed_to_the_last_and_ties_go_to_the_smallest(spark):
    times = {"abcdef": 625, "abcdeg": 125, "abcdhg": 25, "abchhg": 5, "zzzzza": 50, "zzzzzb": 50, "zzzzzc": 10}
    docs = [(None, " ".join([w] * n)) for w, n in times.items()]
    found = {r[0]: r[1:] for r in rows_of(spelling.variants(spark.createDataFrame(docs, DOCS)))}
    assert found["abchhg"] == ("abcdhg", "abcdef", 5, 1, 25)
    assert found["zzzzzc"] == ("zzzzza", "zzzzza", 10, 2, 50)
    assert found["zzzzza"] == (None, "zzzzza", 50, 2, None)


def test_every_two_words_one_edit_apart_share_a_list():
    rng = random.Random(2)
    for letters in ("ab", "abcd"):
        pool = words_of(rng, letters, 300)
        grams = Counter(w[i : i + q] for w in pool for q in range(2, 7) for i in range(len(w) - q + 1))
        kept = [g for g, n in grams.items() if len(g) == 2 or rng.random() < 0.3]
        rng.shuffle(kept)
        ranks = {g: i for i, g in enumerate(kept)}
        opens = spelling.openings(ranks)
        for w in pool:
            other = edited(rng, w, letters)
            if len(w) < 6 or len(other) < 6 or not one_edit(w, other):
                continue
            size = max(len(w), len(other))
            assert set(spelling._keys(w, size, ranks, opens)) & set(spelling._keys(other, size, ranks, opens)), (w, other)


def test_near_tells_single_edits_of_short_and_long_words():
    rng = random.Random(3)
    for size in (6, 7, 31, 32, 33, 60):
        for _ in range(200):
            a = "".join(rng.choice("abé") for _ in range(size))
            b = edited(rng, a, "abé") if rng.random() < 0.7 else edited(rng, edited(rng, a, "abé"), "abé")
            a, b = (a, b) if len(a) >= len(b) else (b, a)
            keys, sizes = np.zeros(2, np.int64), np.array([len(a), len(b)])
            left, _ = spelling._list_pairs(keys, pa.array([a, b]), sizes)
            assert spelling.near(a, b) == one_edit(a, b) == bool(len(left)), (a, b)


def test_runs_and_their_hashes_in_slices_of_any_size():
    docs = [(i, "Abcédefgh " * i + "x" * (60 + i) + "Āÿ" + "b" * 7) for i in range(12)] + [(None, "abcdefg" * 30), (3, None)]
    whole = None
    for limit in (1, 200, 1 << 20):
        found = Counter()
        column = pa.array([t for _, t in docs])
        for first, last, data, offsets in text_slices(column, limit):
            found.update(spelling.slice_words(data, offsets, [i for i, _ in docs[first:last]]).to_pylist())
        kept = {w: n for w, n in found.items() if len(w) >= 6 and n >= 5}
        assert kept == counted(docs)
        assert whole in (None, found)
        whole = found


def test_very_long_runs_are_words_like_any_other(spark):
    long = "ab" * 20_000
    docs = [(None, " ".join([long] * 6 + [long + "c"] * 40)), (1, "q" * 100_000)]
    found = rows_of(spelling.variants(spark.createDataFrame(docs, DOCS)))
    assert [(len(r[0]), len(r[2]), *r[3:]) for r in found] == [(40_000, 40_001, 6, 1, 40), (40_001, 40_001, 40, 1, None)]
