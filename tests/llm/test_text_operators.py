"""Near copies, repeated passages, benchmark leaks, licenses and token counts against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash

import corpus_pipeline
from proofline.llm import arrays, components, decontamination, licenses, simhash, similar, suffixes, tokens

DOCS = "doc_id long, text string"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def by_text(rows):
    return sorted((tuple(r) for r in rows), key=str)


# --- SimHash -------------------------------------------------------------------------------------
def simhash_of(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def grouped(prints, most=2):
    """The smallest id reachable from each row over links of at most ``most`` bits."""
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= most:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(prints))]


def test_xxh64_of_every_length():
    raw = random.Random(1).randbytes(200)
    data = np.frombuffer(raw + bytes(arrays.PAD), np.uint8).copy()
    lengths = np.arange(0, 130)
    got = simhash.xxh64(data, np.full(130, 3), lengths)
    assert [int(x) for x in got] == [xxhash.xxh64_intdigest(raw[3 : 3 + n], seed=42) for n in lengths]


def test_fingerprints_in_slices_of_any_size():
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["A", "bc", "é", "dEf", "x" * 40]) for _ in range(rng.randint(0, 900))) for _ in range(40)]
    texts += [None, "", " \n\t", "One", "one  two", "ONE\vtwo three", "z" * 5000]
    column = pa.array(texts)
    for limit in (1, 700, 1 << 20):
        got = [int(x) for _, _, d, o in arrays.text_slices(column, limit) for x in simhash.fingerprints(d, o)]
        assert got == [simhash_of(t) for t in texts]


def test_near_copies_match_all_pairs(table):
    rng = random.Random(3)
    base = [" ".join(rng.choice("alpha beta gamma delta eps zeta eta".split()) for _ in range(rng.randint(30, 200))) for _ in range(25)]
    rows = []
    for i in range(160):
        words = rng.choice(base).split()
        for _ in range(rng.choice([0, 0, 1, 2])):
            words[rng.randrange(len(words))] = "omega"
        rows.append((1000 - i, " ".join(words)))
    rows += [(None, rows[0][1]), (5, None), (6, ""), (7, " "), rows[3], rows[3], (2000, rows[4][1])]
    prints = [simhash_of(t) for _, t in rows]
    groups = grouped(prints)
    least = {}
    for (i, _), g in zip(rows, groups):
        if i is not None:
            least[g] = min(least.get(g, i), i)
    want = by_text((i, f"{p:016x}", least.get(g)) for (i, _), p, g in zip(rows, prints, groups))
    docs = table(rows, DOCS)
    got = simhash.near_duplicates(docs).select("doc_id", simhash.fingerprint_hex().alias("f"), "component_id")
    assert by_text(got.collect()) == want
    kept = simhash.one_of_each(table([(i, t, "x", "y") for i, t in rows], f"{DOCS}, fp string, `_fp2` string")).collect()
    assert len(kept) == len(set(groups))
    assert sorted(r.doc_id for r in kept) == sorted(least.values())


def test_long_lists_and_chains_of_fingerprints(table, monkeypatch):
    rng = random.Random(4)
    walk, prints = 0x0123456789ABCDEF, []
    for _ in range(60):
        walk ^= (1 << rng.randrange(64)) | (1 << rng.randrange(64))
        prints.append(walk)
    prints += [0xFFFF0000FFFF0000 ^ v for v in rng.sample(range(1 << 16), 300)]
    prints = sorted(set(prints))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    groups = grouped(prints)
    table_of = table([(s,) for s in signed], "fp long")
    found = {r.node: r.root for r in components.components(simhash.near_links(table_of)).collect()}
    least = {}
    for s, g in zip(signed, groups):
        least[g] = min(least.get(g, s), s)
    assert [found.get(s, s) for s in signed] == [least[g] for g in groups]


def test_components_of_no_edges_loops_and_nulls(table):
    assert components.components(table([], "a long, b long")).collect() == []
    edges = [(i, i + 1) for i in range(40)] + [(7, 7), (None, 3), (100, 99), (99, 100), (99, 98)]
    got = {r.node: r.root for r in components.components(table(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 98: 98, 99: 98, 100: 98}


# --- repeated passages ---------------------------------------------------------------------------
def cut_of(rows):
    """(doc_id, bytes, removed, runs, digest, kept bytes) of every row."""
    raw = [(i, (t or "").encode()) for i, t in rows]
    rank = lambda i: float("inf") if i is None else i
    least = {}
    for i, b in raw:
        for k in range(len(b) - 49):
            s = b[k : k + 50]
            least[s] = min(least.get(s, rank(i)), rank(i))
    out = []
    for i, b in raw:
        gone = bytearray(len(b))
        for k in range(len(b) - 49):
            if least[b[k : k + 50]] < rank(i):
                gone[k : k + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(b, gone) if not g)
        runs = sum(1 for k in range(len(gone)) if gone[k] and not (k and gone[k - 1]))
        out.append((i, len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest(), kept))
    return out


def passages(seed):
    rng = random.Random(seed)
    text = lambda n: " ".join(rng.choice(["the", "of", "énd", "ring", "aa", "thin", "x"]) for _ in range(n))
    shared = [text(rng.randint(5, 60)) for _ in range(6)]
    rows = []
    for i in range(90):
        parts = [rng.choice([text(rng.randint(1, 20)), rng.choice(shared), "a" * rng.randint(1, 120)]) for _ in range(rng.randint(0, 8))]
        rows.append((rng.choice([i, i, i, None, 7]), " ".join(parts)))
    rows += [(200, None), (201, ""), (202, rows[3][1]), (1, rows[5][1]), (300, "ab" * 500), (301, "ab" * 40 + "c" + "ab" * 90)]
    return rows + [(302, "a" * 3000), (303, "b" * 49), (304, "b" * 49), (305, "b" * 50), (306, "é" * 50)] + rows[:5]


@pytest.mark.parametrize("frequent", [suffixes.FREQUENT_LEAST, 1])
def test_repeats_match_every_string(table, frequent, monkeypatch):
    monkeypatch.setattr(suffixes, "GATHERED", 300)
    rows = passages(5)
    want = cut_of(rows)
    got = suffixes.remove_repeats(table(rows, DOCS), frequent_least=frequent)
    assert by_text(got.collect()) == by_text(w[:5] for w in want)
    wide = table([(i, t, "en", 0) for i, t in rows], f"{DOCS}, content string, n_chars int")
    kept = suffixes.without_repeats(wide, frequent_least=frequent)
    assert kept.columns == wide.columns
    whole = [(i, t if w[1] < 50 else w[5].decode("utf-8", "ignore")) for (i, t), w in zip(rows, want) if w[1] < 50 or w[5]]
    assert by_text((r.doc_id, r.text) for r in kept.collect()) == by_text(whole)
    assert all(r.n_chars in (0, len(r.text)) for r in kept.collect() if r.text)


def test_repeats_of_an_empty_table(table):
    assert suffixes.remove_repeats(table([], DOCS)).collect() == []
    assert suffixes.without_repeats(table([], DOCS)).collect() == []


def test_anchors_do_not_depend_on_blocks(monkeypatch):
    raw = random.Random(6).randbytes(3000)
    data = np.frombuffer(raw + bytes(arrays.PAD), np.uint8).copy()
    offsets = np.array([0, 700, 700, 730, 3000])

    def cover():
        rows, place, value, low, high = suffixes.anchors(data, offsets)
        return sorted((int(s), int(p), int(v)) for p, v, a, b in zip(place, value, low, high) for s in range(a, b + 1))

    whole = cover()
    assert [s for s, _, _ in whole] == [*range(651), *range(730, 2951)]
    monkeypatch.setattr(suffixes, "BLOCK", 101)
    assert cover() == whole


# --- benchmark leaks -----------------------------------------------------------------------------
def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def leaks_of(docs, items):
    windows = {}
    for i, t in items:
        w = words_of(t)
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(i)
    out = []
    for i, t in docs:
        w, hit, met = words_of(t), set(), set()
        for n in {len(k) for k in windows}:
            for k in range(len(w) - n + 1):
                if (found := windows.get(tuple(w[k : k + n]))) is not None:
                    hit |= set(range(k, k + n))
                    met |= {x for x in found if x is not None}
        ids = sorted(map(str, met))
        out.append((i, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return by_text(out)


def test_leaks_match_every_window(table):
    rng = random.Random(7)
    vocabulary = "one TWO three, four. five six-seven eight n9 élan Über".split()
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i % 30, text(rng.randint(8, 40))) for i in range(40)] + [(50, "the"), (51, "A, B"), (None, "x the y z"), (52, None), (53, "!!")]
    docs = [(i, " ".join(rng.choice([text(rng.randint(1, 30)), rng.choice(items)[1] or ""]) for _ in range(4))) for i in range(60)]
    docs += [(1, "a b the"), (1, "a b the"), (None, "A b"), (70, None), (71, ""), (72, docs[0][1])]
    frames = table(docs, DOCS), table(items, "item_id long, text string")
    want = leaks_of(docs, items)
    assert by_text(decontamination.decontaminate(*frames).collect()) == want
    left = decontamination.without_leaks(*frames).collect()
    assert sorted(str(r.doc_id) for r in left) == sorted(str(w[0]) for w in want if not w[5])


def test_leaks_of_empty_tables(table):
    docs, items = table([(1, "a b")], DOCS), table([(1, "a")], "item_id long, text string")
    assert decontamination.decontaminate(docs, items.limit(0)).where("contaminated").count() == 0
    assert decontamination.decontaminate(docs.limit(0), items).collect() == []


# --- licenses ------------------------------------------------------------------------------------
def test_notices_with_gaps_and_wrong_words(table):
    mit = licenses.TEMPLATES["MIT-text"]
    damaged = mit.split()
    damaged[10:12] = ["oddly", "changed", "words"]
    del damaged[30]
    rows = [
        (1, "Some code.\nReleased under the MIT License. The end"),
        (2, f"x {mit} y {mit.upper()}"),
        (3, " ".join(damaged)),
        (4, "released under the terms of some other license"),
        (5, None), (6, ""), (7, "MIT"), (7, "MIT"), (None, "licensed under cc by nc 4.0"),
    ]
    got = licenses.scan(table(rows, DOCS)).collect()
    found = by_text((r.doc_id, r.license) for r in got)
    assert found == by_text([(1, "MIT"), (2, "MIT-text"), (2, "MIT-text"), (3, "MIT-text"), (None, "CC-BY-NC-4.0")])
    texts = dict(rows[:3])
    for r in got:
        assert 0.8 <= r.coverage <= 1
        if r.doc_id == 1:
            assert texts[1].encode()[r.start_byte : r.end_byte] == b"Released under the MIT License"
            assert (r.first_word, r.last_word, r.matched, r.coverage) == (2, 6, 5, 1.0)
        if r.doc_id == 3:
            assert r.coverage < 1
    assert licenses.scan(table([], DOCS)).collect() == []


def test_the_words_that_name_a_license_decide(table):
    rows = [
        (1, "Licensed under the Mozilla Public License, version 2.0"), (2, "licensed under cc by-sa 4.0"), (3, "released under an mit license"),
        (4, "Licensed under the Eclipse Public License, version 2.0"), (5, "licensed under cc by 3.0"), (6, "licensed with CC BY-NC 4.0"),
        (7, "This work is licensed under the GNU General Public License, version 2."), (8, f"a {licenses.TEMPLATES['Apache-2.0-header']} b"),
        (9, licenses.TEMPLATES["MIT-whole"]), (10, licenses.TEMPLATES["BSD-2-whole"]), (11, licenses.TEMPLATES["BSD-3-whole"]),
        (12, licenses.TEMPLATES["ISC-whole"].replace("AUTHOR", "WRITER")), (13, licenses.TEMPLATES["AGPL-3.0-header"]),
    ]
    found = {(r.doc_id, r.license) for r in licenses.scan(table(rows, DOCS)).collect()}
    names = {1: "MPL-2.0", 2: "CC-BY-SA-4.0", 3: "MIT", 6: "CC-BY-NC-4.0", 7: "GPL-2.0", 8: "Apache-2.0-header", 9: "MIT-whole", 10: "BSD-2-whole"}
    assert found == {*names.items(), (11, "BSD-3-whole"), (12, "ISC-whole"), (13, "AGPL-3.0-header")}


def test_scan_finds_what_aligning_at_every_place_finds():
    """Templates with up to a fifth of their words exchanged in place, among words of no template: reported
    if some place of the text aligns well enough and the naming words stand in the span. (Words of a
    template strewn among others, no two in a row, are no candidate; the docstring of the operator says so.)"""
    chance = random.Random(4)
    templates = licenses.Templates(licenses.TEMPLATES, licenses.NAMING)
    common = "river mill walk town every day along runs past old".split()
    hits = 0
    for _ in range(150):
        number = chance.randrange(len(templates.names))
        named = {w for run in licenses.NAMING.get(templates.names[number], []) for w in run.split()}
        words = re.findall("[a-z0-9]+", licenses.TEMPLATES[templates.names[number]].lower())
        for i in chance.sample(range(len(words)), min(int(len(words) * 0.2), chance.randrange(len(words)))):
            if words[i] not in named or chance.random() < 0.2:
                words[i] = f"x{chance.randrange(100)}"
        text = [*chance.choices(common, k=chance.randrange(30)), *words, *chance.choices(common, k=chance.randrange(30))]
        hashes = licenses._hashes(" ".join(text))
        good = []
        for place in range(-licenses.BAND, len(hashes)):
            begin = max(0, place - licenses.BAND)
            around = hashes[begin : place + len(templates.words[number]) + licenses.BAND]
            matched, first, last = licenses.banded_alignment(templates.words[number], around, place - begin)
            if matched >= licenses.LEAST_COVERAGE * len(templates.words[number]) and templates.named(number, around[first : last + 1]):
                good.append((begin + first, begin + last))
        spans = licenses._spans(hashes, templates, {})
        hits += bool(good)
        # Each good place is reported, or a span that overlaps it and matches as much.
        assert all(any(a <= g[1] and g[0] <= b for _, a, b, _ in spans) for g in good), (templates.names[number], text)
    assert hits > 80


def longest_common(a, b, diagonal, band):
    """Matched words of the best alignment inside the band, by the whole table."""
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            inside = abs((j - 1) - (i - 1) - diagonal) <= band
            best[i][j] = max(best[i - 1][j], best[i][j - 1], (best[i - 1][j - 1] + 1) if inside and a[i - 1] == b[j - 1] else 0)
    return best[-1][-1]


def test_alignment_counts_as_the_whole_table_does():
    rng = np.random.default_rng(8)
    for _ in range(60):
        a, b = rng.integers(0, 4, rng.integers(3, 14)), rng.integers(0, 4, rng.integers(3, 20))
        matched, first, last = licenses.banded_alignment(a.astype(np.uint64), b.astype(np.uint64), 2, 4)
        assert matched == longest_common(list(a), list(b), 2, 4)
        if matched:
            assert 0 <= first <= last < len(b) and last - first + 1 >= matched


# --- token counts --------------------------------------------------------------------------------
def test_sums_answer_every_limit(table):
    rng = random.Random(9)
    lengths = [rng.choice([0, 1, 5, 900, 1023, 1024, 1025, 5000, rng.randint(0, 7000)]) for _ in range(500)]
    sums = tokens.length_sums(table([(i, n) for i, n in enumerate(lengths)] + [(1, None)], "doc_id long, length long"))
    counts = Counter(lengths)
    for r in sums.collect():
        assert r.n_docs == counts[r.length]
        assert r.docs_at_least == sum(n >= r.length for n in lengths)
        assert r.tokens_at_least == sum(n for n in lengths if n >= r.length)
        assert r.docs_through == sum(n <= r.length for n in lengths)
        assert r.kept_at_limit == sum(min(n, r.length) for n in lengths)
        assert (r.total_docs, r.total_tokens) == (500, sum(lengths))
    limits = [1, 512, 1024, 4096, 10_000]
    for r in tokens.at_limits(sums, limits).collect():
        assert (r.docs_at_least, r.kept_at_limit) == (sum(n >= r.context for n in lengths), sum(min(n, r.context) for n in lengths))
    ordered = sorted(lengths)
    for r in tokens.at_quantiles(sums, [0.1, 0.5, 1.0]).collect():
        assert r.length == next(n for n in ordered if sum(m <= n for m in lengths) >= r.quantile * 500)
    assert tokens.length_sums(table([], "doc_id long, length long")).collect() == []


def test_lengths_are_the_encoders(table):
    tiktoken = pytest.importorskip("tiktoken")
    rows = [(1, "Hello  world's é 123"), (2, None), (3, ""), (3, ""), (None, "<|endoftext|>" * 3), (5, "a" * 3000)]
    with open(tokens.VOCABULARY, "rb") as file:
        encode = tokens._encoder(file.read(), tokens.PATTERN).encode_ordinary
    assert tiktoken
    got = by_text(tokens.encoded_lengths(table(rows, DOCS)).collect())
    assert got == by_text((i, len(encode(t or ""))) for i, t in rows)


def test_long_runs_are_cut_where_the_pattern_cuts():
    import regex

    with open(tokens.VOCABULARY, "rb") as file:
        ranks = file.read()
    merge = tokens._encoder(ranks, r"(?s).+").encode_ordinary
    ink = "[^" + tokens.WHITE[1:]
    pattern = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?(?:(?![\p{{L}}\p{{N}}]){ink})+|{tokens.WHITE}+(?!{ink})|{tokens.WHITE}+"
    pieces = [" ", "  ", "\n", "\t", "\u3000", "\x1c", "\xa0", "a", "word", "7", "--", "'s", "é"]
    chance = random.Random(5)
    for _ in range(500):
        text = "".join(chance.choice(pieces) * chance.choice([1, 1, 3]) for _ in range(chance.randrange(14)))
        wanted = sum(len(merge(piece)) for piece in regex.findall(pattern, text))
        for long_run in (2, 3, 5):
            assert tokens.encoded_length(text, ranks, tokens.PATTERN, long_run) == wanted, repr(text)


def test_very_long_texts_are_encoded(table):
    texts = [" " * 2_000_000, "a" + "\n" * 2_000_000 + "b", "ab1" * 700_000, "-" * 700_000, "word " * 400_000]
    got = {r.doc_id: r.length for r in tokens.encoded_lengths(table(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got[0] == 2_000_000 and got[1] == 1_000_003 and got[4] >= 400_000 and set(got) == set(range(5))


def test_texts_that_share_an_id_each_keep_a_row(table):
    a, b = (" ".join(f"{c}{i}" for i in range(40)) for c in "ab")
    rows = [(1, a), (1, b), (2, a), (3, b), (3, "c d e f"), (None, "g h i j"), (None, "g h i j")]
    kept = simhash.one_of_each(table(rows, DOCS)).collect()
    assert by_text(kept) == by_text([(1, a), (1, b), (3, "c d e f"), (None, "g h i j")])


# --- near copies by shingles ---------------------------------------------------------------------
def five_words(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)] * bool(words))


def similar_groups(rows):
    """The smallest id of each row's group; rows with 5-word Jaccard of 0.8 or more are linked."""
    sets = [five_words(t) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) and group[i] != group[j]:
                group = [group[j] if g == group[i] else g for g in group]
    least = {}
    for (i, _), g in zip(rows, group):
        if i is not None:
            least[g] = min(least.get(g, i), i)
    return [(i, least.get(g)) for (i, _), g in zip(rows, group)]


def test_stage_links_every_pair_of_similar_texts(spark, table):
    rng = random.Random(12)
    line = "this line stands in very many of the texts and says nothing at all"
    base = [[f"w{rng.randrange(400)}" for _ in range(rng.randint(8, 240))] for _ in range(14)]
    rows = []
    for i in range(170):
        words = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
            words[rng.randrange(len(words))] = f"x{rng.randrange(900)}"
        rows.append((1000 - i, " ".join(words) + (f" {line}" if i % 3 == 0 else "")))
    rows += [(None, rows[0][1]), (None, "alone without any id"), (5, None), (6, ""), (7, "One two"), (8, "one  TWO"), rows[3]]
    want = similar_groups(rows)
    got = similar.near_copies(table(rows, DOCS)).select("doc_id", "component_id").collect()
    assert by_text(got) == by_text(want)
    kept = corpus_pipeline.near_copy_stage(spark, table(rows, DOCS), "").collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == sorted({c for _, c in want if c is not None})
    assert [r.text for r in kept if r.doc_id is None] == ["alone without any id"]
    assert similar.near_copies(table([], DOCS)).collect() == []
