"""What the near-copy stage links, and what it reads for it."""

import random
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa

import corpus_pipeline
from proofline.llm import arrays, similar, simhash

DOCS = "doc_id long, text string"


def _words(rng, count):
    return " ".join(f"x{rng.randrange(10**6)}" for _ in range(count))


def test_stage_links_what_simhash_links(spark, table):
    rng = random.Random(1)
    repeated = " ".join(f"alpha{i} beta{i} gamma" for i in range(60)) + " "
    # The repeated lines decide the SimHash; the other words most of the distinct shingles.
    rows = [(i, repeated * 60 + _words(rng, 150)) for i in (3, 1, 2)] + [(9, _words(rng, 80)), (8, ""), (7, None)]
    linked = simhash.near_duplicates(table(rows, DOCS)).select("doc_id", "component_id").collect()
    assert {r.doc_id: r.component_id for r in linked} == {1: 1, 2: 1, 3: 1, 9: 9, 8: 7, 7: 7}
    assert len({r.group for r in similar.near_copies(table(rows, DOCS)).collect()}) == 5
    kept = corpus_pipeline.near_copy_stage(spark, table(rows, DOCS), "").collect()
    assert sorted(r.doc_id for r in kept) == [1, 7, 9]


def _sets(texts):
    hashes, sizes = [], []
    for _, _, data, offsets in arrays.text_slices(pa.array(texts)):
        some, counts = similar.shingle_sets(data, offsets)
        hashes.append(some)
        sizes.append(counts)
    return np.concatenate(hashes), np.concatenate(sizes)


def test_long_sketches_differ_in_no_more_bits_than_the_sets():
    rng = random.Random(4)
    texts = ["", "one two"]
    for count in (20, 256, 257, 300, 3000, 9000):
        text = _words(rng, count).split()
        texts += [" ".join(text), " ".join(text[: int(0.9 * count)]), " ".join(text[: count // 2] + _words(rng, count // 2).split())]
    hashes, sizes = _sets(texts)
    sketches, sets = similar._long_sketches(hashes, sizes), np.split(hashes, np.cumsum(sizes)[:-1])
    assert all(8 * len(s) >= max(512, 2 * n) for s, n in zip(sketches, sizes))
    for i in range(len(sets)):
        for j in range(len(sets)):
            bits = min(len(sketches[i]), len(sketches[j])) * 8
            odd = np.bincount((arrays.mixed(np.setxor1d(sets[i], sets[j])) % np.uint64(bits)).astype(int), minlength=bits) & 1
            assert similar._differing(sketches[i], sketches[j]) == odd.sum()


def test_long_sketches_leave_few_pairs():
    rng = random.Random(5)
    base = _words(rng, 4000).split()
    # Similarities of 0.9, 0.7 and 0.5; the short sketch of 512 bits rules none of them out.
    texts = [" ".join(base)] + [" ".join(base[: int(4000 * kept)]) for kept in (0.9, 0.7, 0.5)]
    hashes, sizes = _sets(texts)
    long = similar._long_sketches(hashes, sizes)
    rows = [(1, None, 0)] + [(1, b, b) for b in (1, 2, 3)]
    batch = pa.RecordBatch.from_pylist([{"a": a, "b": b, "size": int(sizes[n]), "long": long[n]} for a, b, n in rows])
    (found,) = similar._passing_batches(Fraction(4, 5), iter([batch]))
    assert found.to_pylist() == [{"a": 1, "b": 1}]


def test_few_texts_are_unpacked_at_once(monkeypatch):
    rng = random.Random(6)
    texts = [_words(rng, count) for count in (0, 3, 700, 40, 5, 9, 2000)] * 30
    packed = pa.array([zlib.compress(t.encode(), 1) for t in texts], pa.binary())
    seen = []

    def slices(column, kept=similar.text_slices):
        seen.append(len(column))
        return kept(column)

    monkeypatch.setattr(similar, "text_slices", slices)
    found = list(similar._unpacked(packed, 5))
    hashes, sizes = _sets(texts)
    want = np.split(hashes, np.cumsum(sizes)[:-1])
    assert len(found) == len(want) and all((a == b).all() for a, b in zip(found, want))
    assert sum(seen) == len(texts) and max(seen) <= similar.UNPACKED
