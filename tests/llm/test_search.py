"""Ranked search against plain Python over all documents."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest

from proofline.llm import search

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, items, best=50):
    bags = [(i, Counter(terms(t))) for i, t in docs]
    sizes = [sum(b.values()) for _, b in bags]
    n_docs, n_terms = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for _, b in bags for t in b)
    asked = defaultdict(set)
    for item, text in items:
        asked[item] |= set(terms(text))
    rows = []
    for item, wanted in asked.items():
        scored = []
        for (doc, bag), size in zip(bags, sizes, strict=True):
            score = 0
            for t in wanted & bag.keys():
                m = 100 - 50 + (50 * size * n_docs) // n_terms
                weight = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                score += weight * ((1_000_000_000 * bag[t]) // (1000 * bag[t] + 20 * m))
            if score > 0:
                scored.append((-score, doc is None, doc, score))
        ranked = sorted(scored, key=lambda s: (s[0], s[1], s[2] or 0))[:best]
        rows += [(item, rank, doc, score) for rank, (*_, doc, score) in enumerate(ranked, 1)]
    return sorted(rows, key=repr)


def found(spark, docs, items, **more):
    table = search.search(spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(items, ITEMS), **more)
    assert table.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in table.collect()), key=repr)


def tables(seed, count=150):
    rng = random.Random(seed)
    pool = [f"{chr(97 + i % 26)}{i}" for i in range(300)] + ["The", "naïve", "\U0001f600x", "7"]
    # A few terms are in nearly every text.
    text = lambda n: rng.choice([" ", "; ", "\n"]).join(rng.choice(pool[: rng.choice([3, 30, 304])]) for _ in range(n))
    docs = [(i, text(rng.randint(0, 60))) for i in range(count)]
    docs += [docs[5], docs[5], (5, text(20)), (None, docs[5][1]), (None, None), (900, ""), (901, None), (902, "a0 " * 3000)]
    items = [(i, text(rng.randint(1, 25))) for i in range(12)] + [(3, text(4)), (None, "a0 b1 the"), (50, None), (51, "!!"), (52, "unheard")]
    return docs, items + [items[0]]


@pytest.mark.parametrize("owners", [1, 3])
def test_ranks_are_those_of_all_documents(spark, owners):
    docs, items = tables(owners)
    expected = plain(docs, items)
    assert len(expected) > 300
    assert found(spark, docs, items, owners=owners) == expected


def test_slices_and_bundles_of_any_size_rank_alike(spark, monkeypatch):
    docs, items = tables(9)
    expected = plain(docs, items, best=7)
    monkeypatch.setattr(search, "BUNDLE_ITEMS", 4)
    monkeypatch.setattr(search, "SLICE", 300)
    monkeypatch.setattr(search, "SLICE_ROWS", 11)
    assert found(spark, docs, items, best=7, owners=2) == expected


def test_equal_scores_go_by_id(spark):
    docs = [(i, "same words here") for i in (9, 3, 7)] + [(None, "same words here"), (1, "others"), (2, "more others")]
    rows = found(spark, docs, [(1, "words")])
    assert [(r[1], r[2]) for r in rows] == [(1, 3), (2, 7), (3, 9), (4, None)]


def test_nothing_to_search(spark):
    assert found(spark, [], [(1, "word")]) == []
    assert found(spark, [(1, "word"), (2, "other")], []) == []
    assert found(spark, [(1, None)], [(1, "word")]) == []


def test_the_first_owners_hold_the_rarest_terms(spark, monkeypatch):
    seen = []
    kept = search.materialize
    monkeypatch.setattr(search, "materialize", lambda df, name, *a: seen.append((name, out := kept(df, name, *a))) or out)
    docs, items = tables(4)
    found(spark, docs, items)
    lists = dict(seen)["postings"].selectExpr("owner", "weight").distinct().collect()
    weights = {o: [r.weight for r in lists if r.owner == o] for o in range(3)}
    assert all(weights.values()) and min(weights[0]) >= max(weights[1]) and min(weights[1]) >= max(weights[2])
