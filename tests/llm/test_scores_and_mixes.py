"""URL models, mixing, quality, neighbours, quotations and the pipeline."""

import math
import os
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

import corpus_pipeline
from proofline.llm import mixing, neighbours, quality, quotes, suffixes, urls
from proofline.llm.queries import REGISTRY
from proofline.session import materialize

SMALL = "/root/testdata/sf0.001"
LARGER = "/root/testdata/sf0.01"
given = pytest.mark.skipif(not os.path.isdir(LARGER), reason="the given tables are not here")


def by_text(rows):
    return sorted((tuple(r) for r in rows), key=str)


# --- urls ----------------------------------------------------------------------------------------
def ratios_of(weighted):
    """ln P(accepted) - ln P(rejected) of each gram of five characters, by recursion."""

    def chance(gram, order, which):
        if order < 0:
            return 1 / urls.ALPHABET
        context, tail = gram[len(gram) - 1 - order : -1], gram[len(gram) - 1 - order :]
        counts = defaultdict(int)
        for g, w in weighted:
            if g[len(g) - 1 - order : -1] == context:
                counts[g[len(g) - 1 - order :]] += w[which]
        total, kinds = sum(counts.values()), sum(v > 0 for v in counts.values())
        below = chance(gram, order - 1, which)
        return (counts[tail] + kinds * below) / (total + kinds) if total + kinds else below

    return {g: round((math.log(chance(g, 4, 0)) - math.log(chance(g, 4, 1))) * urls.UNIT) for g, _ in weighted}


def test_log_ratios_follow_the_recursion(table):
    rng = random.Random(1)
    weighted = [("".join(rng.choice("ab") for _ in range(5)), (rng.randint(0, 3), rng.randint(0, 3))) for _ in range(40)]
    got = urls.log_ratios(table([(g, *w) for g, w in weighted], "gram string, accepted long, rejected long"))
    want = ratios_of(weighted)
    assert {r.gram: pytest.approx(r.ratio, abs=2) for r in got.collect()} == want


def test_hosts_paths_and_the_longest_rule(table):
    cases = [
        ("http://A.Example.NET/en/x?y#z", "a.example.net", "/en/x", "example.net/en/", "allow"),
        ("http://example.net/de/", "example.net", "/de/", "net/", "block"),
        ("https://www.example.com/de/1", "www.example.com", "/de/1", "example.com/de/", "block"),
        ("https://notexample.com/de/1", "notexample.com", "/de/1", None, None),
        ("x://org/fr/?q", "org", "/fr/", "org/fr/", "allow"),
        ("http://a.net?x=/", "a.net", "", None, None),
        ("http://a.net:80/", "a.net:80", "/", None, None),
        ("a://b://c/d", "b:", "//c/d", None, None),
        ("http://É.NET/", "É.net".replace("É", "É"), "/", "net/", "block"),
        ("no scheme", "", "", None, None),
        (None, "", "", None, None),
        ("", "", "", None, None),
        ("http://line\nbreak.org/fr/\nx", "line\nbreak.org", "/fr/\nx", "org/fr/", "allow"),
    ]
    got = urls.judge(table([(i, c[0], "h") for i, c in enumerate(cases)], "page_id long, url string, host string")).collect()
    assert len(got) == len(cases)
    for r in got:
        _, host, path, rule, verdict = cases[r.page_id]
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == verdict if verdict else r.verdict in ("allow", "block")
    assert urls.judge(table([], "page_id long, url string")).collect() == []


def test_models_separate_what_rules_leave_open(table):
    rng = random.Random(2)
    good, bad = ["garden", "museum", "recipes"], ["casino", "pills", "freebets"]
    rules = (("allow", "good.io", "/"), ("block", "evil.io", "/"))
    rows = []
    for i in range(600):
        words, host = rng.choice([(good, "good.io"), (bad, "evil.io")])
        rows.append((i, f"http://{host}/{rng.choice(words)}/{i}"))
    rows += [(1000 + i, f"http://open.io/{w}/{i}") for i, w in enumerate(good + bad)]
    judged = urls.judge(table(rows, "page_id long, url string"), rules).where("page_id >= 1000")
    got = {r.page_id: r.verdict for r in judged.collect()}
    assert got == {**{1000 + i: "allow" for i in range(3)}, **{1003 + i: "block" for i in range(3)}}


# --- mixing --------------------------------------------------------------------------------------
def targets_of(sizes):
    """Targets by filling up: full sources stop, the rest share what is left by weight."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    full, total = set(), sum(sizes.values())
    while True:
        left = total - sum(3 * sizes[s] for s in full)
        share = {s: left * weight[s] / sum(weight[x] for x in names if x not in full) for s in names if s not in full}
        over = {s for s, v in share.items() if v > 3 * sizes[s] + 1e-9}
        if not over:
            return {s: 3 * sizes[s] if s in full else share[s] for s in names}
        full |= over


def test_mix_meets_targets_and_repeats_epochs(table):
    rng = random.Random(3)
    rows = []
    for i in range(900):
        source = rng.choice(["b", "b", "b", "b", "a", "z", None, "", "é", "tiny"] if i % 60 else ["tiny"])
        rows.append((i, " ".join(["w"] * (1 if source == "tiny" else rng.randint(0, 60))), source, 3))
    rows += [(2000, None, "a", 3), (2001, "", "void", 3), (None, "x y", "a", 3), rows[5], rows[5]]
    docs = table(rows, "doc_id long, text string, source string, size int")
    got = mixing.mix(docs, keep_source=True).collect()
    assert len(got) == len(rows)
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in got:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert 0 <= r.taken <= 3 * r.size
    want = targets_of(sizes)
    for s in sizes:
        assert target[s] == pytest.approx(want[s])
        assert abs(taken[s] - target[s]) <= 1
    whole = {s: target[s] // sizes[s] if sizes[s] else 0 for s in sizes}
    assert all(r.taken >= whole[r.source] * r.size for r in got)
    assert by_text(mixing.mix(docs).collect()) == by_text(mixing.mix(docs.repartition(7)).collect())
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == ["doc_id", "text", "source", "size", "source_size", "target", "taken"]
    assert mixed.count() == sum(r.taken > 0 for r in got)
    assert mixing.mix(table([], "doc_id long, text string, source string")).collect() == []


def test_heavier_documents_are_drawn_more_often(table):
    rows = [(i, "word " * 10 if i % 2 else "#### " * 10, "s") for i in range(4000)] + [(10_000 + i, "w " * 40, "t") for i in range(4000)]
    got = mixing.mix(table(rows, "doc_id long, text string, source string"), weights=(1, 9)).where("doc_id < 10000").collect()
    drawn = [sum(r.taken > 0 for r in got if r.doc_id % 2 == k) for k in (0, 1)]
    assert drawn[1] > 3 * drawn[0] > 0


# --- quality -------------------------------------------------------------------------------------
@given
def test_quality_on_rows_held_out(spark):
    scored = {r.doc_id: r for r in REGISTRY["op3_quality"].run(spark, LARGER).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{LARGER}/labels.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and r.predicted == (r.score >= 0.7) for i, r in scored.items())
    held = [(scored[i].predicted, q) for i, q in labels.items() if scored[i].held_out]
    assert np.mean([p == q for p, q in held]) >= 0.97


def test_quality_of_odd_texts_and_tables(table):
    texts = [None, "", "   ", "a", "Short but fine words.", "é" * 3, "x" * 100_000, "\n\n"]
    docs = table([(i, t, "label") for i, t in enumerate(texts)] + [(None, "a", ""), (1, "", "")], "doc_id long, text string, quality string")
    none = table([], "doc_id long, quality int")
    got = quality.classify(docs, none).collect()
    assert len(got) == 10 and all(r.score == pytest.approx(quality.PRIOR_GOOD) for r in got)
    one = table([(3, 1), (4, 1), (4, 1), (0, None), (None, 0), (5, 7)], "doc_id long, quality int")
    assert all(0 <= r.score <= 1 for r in quality.classify(docs, one).collect())
    assert quality.classify(docs.limit(0), one).collect() == []
    assert quality.keep_good(docs, none, 0.2).columns == docs.columns


def test_log_densities_match_the_plain_formula():
    rng = np.random.default_rng(4)
    size = len(quality.FEATURES)
    means, shapes = rng.normal(size=(2, size)), rng.normal(size=(2, size, size))
    covs = shapes @ shapes.transpose(0, 2, 1) + np.eye(size)
    model = quality.Model(means, np.linalg.cholesky(covs), np.linalg.slogdet(covs)[1], 0.3)
    rows = rng.normal(size=(20, size))
    logs = [-0.5 * (np.einsum("ni,ij,nj->n", rows - m, np.linalg.inv(c), rows - m) + np.linalg.slogdet(c)[1]) for m, c in zip(means, covs)]
    odds = 0.3 / 0.7 * np.exp(logs[1] - logs[0])
    assert model.scores(rows) == pytest.approx(odds / (1 + odds))


# --- neighbours ----------------------------------------------------------------------------------
def test_neighbours_recall_ties_and_odd_vectors(table):
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(3000, 16)) + 3 * rng.normal(size=(20, 16))[rng.integers(0, 20, 3000)]
    vectors[1000:1900] = vectors[7]  # a third of all rows
    rows = [(int(i), [float(x) for x in v]) for i, v in enumerate(vectors)]
    odd = [(5000, None), (5050, [0.0] * 16), (5100, [float("nan")] * 16), (5150, [1.0] * 15 + [float("inf")]), (5200, [None] + [1.0] * 15)]
    odd += [(None, rows[0][1]), rows[50], (5250, []), (5300, [1.0, 2.0])]
    docs = table(rows + odd, "vec_id long, embedding array<double>")
    got = neighbours.nearest(docs, docs.where("vec_id % 50 = 0")).collect()
    found = defaultdict(list)
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        found[r.query_id].append((r.vec_id, r.score))
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    hits = 0
    for q in range(0, 3000, 50):
        cosine = unit @ unit[q]
        cosine[q] = -9
        best = sorted(range(3000), key=lambda i: (-round(cosine[i], 12), i))[:5]
        hits += len({v for v, _ in found[q]} & set(best))
        assert len(found[q]) == 5
        assert [s for _, s in found[q]] == pytest.approx([cosine[v] for v, _ in found[q]], abs=1e-12)
    assert hits >= 0.95 * 5 * 60
    assert set(found) == set(range(0, 3000, 50))
    assert [v for v, _ in found[1000]] == [7, 1001, 1002, 1003, 1004]


def test_few_vectors(table):
    schema = "vec_id long, embedding array<float>"
    few = table([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (50, [0.0, 2.0])], schema)
    got = neighbours.nearest(few, few.where("vec_id % 50 = 0")).collect()
    assert by_text((r.query_id, r.rank, r.vec_id) for r in got) == by_text([(0, 1, 1), (0, 2, 50), (50, 1, 1), (50, 2, 0)])
    assert neighbours.nearest(few.limit(0), few).collect() == []


# --- quotations ----------------------------------------------------------------------------------
def test_quotes_link_to_the_message_they_repeat(table):
    schema = "conv_id long, turn long, role string, text string, position string"
    rows = [
        (1, 0, "user", "How do I sort a list?\n\nIt is long.", ""),
        (1, 1, "assistant", "Use sorted.", ""),
        (1, 2, "user", "Another matter: tuples?", ""),
        (1, 3, "assistant", "On Monday, someone wrote:\n> how do I  SORT\n> a list\n\nOr call sort in place.", ""),
        (1, 4, "user", ">> It is long.\n> Or call sort in place.\nThanks", ""),
        (1, 5, "user", "> never said\nHm", ""),
        (1, None, "user", "late", ""),
        (2, 3, "user", "> Use sorted.\nother conversation", ""),
        (None, 1, "user", None, ""),
        (None, 1, "user", None, ""),
    ]
    got = quotes.reply_ordered(table(rows, schema)).collect()
    by_turn = {(r.conv_id, r.turn): r for r in got}
    assert len(got) == len(rows)
    assert [by_turn[1, t].reply_to for t in (0, 1, 2, 3, 4, 5, None)] == [None, 0, 1, 0, 3, 4, 5]
    assert [by_turn[1, t].linked for t in (0, 3, 4, 5)] == [False, True, True, False]
    assert [(by_turn[1, t].n_quotes, by_turn[1, t].n_linked) for t in (3, 4, 5)] == [(1, 1), (2, 2), (1, 0)]
    assert by_turn[1, 3].text == "Or call sort in place." and by_turn[1, 4].text == "Thanks"
    assert [by_turn[1, t].position for t in (0, 1, 2, 3, 4, 5, None)] == [1, 2, 3, 4, 5, 6, 7]
    assert by_turn[2, 3].reply_to is None and not by_turn[2, 3].linked
    assert sorted(r.position for r in got if r.conv_id is None) == [1, 2]
    assert quotes.reply_ordered(table([], schema)).collect() == []


def test_any_part_from_a_line_or_sentence_on_links(table):
    """Random parts of random messages, against a plain search of their words."""
    chance = random.Random(12)
    rows, wanted = [], {}
    plain = lambda text: [w.strip(quotes.MARKS) for w in text.lower().split() if w.strip(quotes.MARKS)]
    for conv in range(40):
        messages = []
        for turn in range(8):
            lines = [" ".join(chance.choice(["red", "Blue", "green,", "so.", "(why", "not)?"]) for _ in range(chance.randrange(1, 6))) for _ in range(chance.randrange(1, 5))]
            own = "\n".join(lines)
            text, link = own, None
            if turn and chance.random() < 0.7:
                source = chance.choice(messages).split("\n")
                first = chance.randrange(len(source))
                part = source[first : chance.randrange(first, len(source)) + 1]
                part[-1] = " ".join(part[-1].split()[: chance.randrange(1, 6)])
                passage = plain(" ".join(part))
                # Wrapped anew, and followed by a passage that nobody wrote.
                text = "> " + " \n> ".join(" ".join(part).split()) + "\n" + own + "\n> nobody wrote this"
                for earlier, message in enumerate(messages):
                    begins, at = [], 0
                    for line in message.split("\n"):
                        fresh = True
                        for raw in line.split():
                            if raw.strip(quotes.MARKS):
                                begins += [at] if fresh else []
                                at, fresh = at + 1, False
                            fresh = fresh or raw.endswith((".", "?"))
                    if link is None and passage and any(plain(message)[b : b + len(passage)] == passage for b in begins):
                        link = earlier
                assert link is not None or not passage
            messages.append(own)
            rows.append((conv, turn, "user", text))
            wanted[conv, turn] = link
    got = quotes.reply_ordered(table(rows, "conv_id long, turn long, role string, text string")).collect()
    assert {(r.conv_id, r.turn): r.reply_to if r.linked else None for r in got} == wanted


def test_answers_between_quotes_stay_apart(table):
    schema = "conv_id long, turn long, role string, text string"
    rows = [
        (1, 0, "user", "First question?\nSecond question?"),
        (1, 1, "user", "> First question?\nA1\nA2\n> Second question?\nB1\nB2"),
        (1, 2, "user", "something else"),
        (1, 3, "user", "> A1\n> A2\nthanks"),
        (1, 4, "user", "> B1 B2\nright"),
        (2, 0, "user", " page\x0cbreak\r\nand more \n"),
    ]
    got = {(r.conv_id, r.turn): r for r in quotes.reply_ordered(table(rows, schema)).collect()}
    assert got[1, 1].text == "A1\nA2\n\nB1\nB2" and (got[1, 1].n_quotes, got[1, 1].n_linked) == (2, 2)
    assert [got[1, t].reply_to for t in (1, 3, 4)] == [0, 1, 1] and got[1, 3].linked and got[1, 4].linked
    assert got[2, 0].text == " page\x0cbreak\r\nand more \n"


def test_positions_of_a_long_conversation(table):
    turns = list(range(0, 9000, 3))
    random.Random(6).shuffle(turns)
    got = quotes.reply_ordered(table([(1, t, "user", f"m{t}") for t in turns], "conv_id long, turn long, role string, text string")).collect()
    assert all(r.position == r.turn // 3 + 1 and r.reply_to == (r.turn - 3 if r.turn else None) for r in got)


# --- pipeline ------------------------------------------------------------------------------------
@given
def test_stages_do_what_they_say(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    kept = [docs]
    for name, stage in corpus_pipeline.STAGES:
        kept.append(materialize(stage(spark, kept[-1], SMALL), "stage"))
    ids = [{r.doc_id for r in d.select("doc_id").collect()} for d in kept]
    assert all(b <= a for a, b in zip(ids, ids[1:]))
    assert all(d.columns == docs.columns for d in kept[:5])
    good = quality.classify(docs, spark.read.parquet(f"{SMALL}/labels.parquet")).where("predicted = 1")
    assert ids[1] == {r.doc_id for r in good.collect()}
    texts = [(r.doc_id, r.text) for r in kept[2].collect()]
    cut = suffixes.remove_repeats(kept[2]).collect()
    assert ids[3] == {r.doc_id for r in cut if r.n_removed < r.n_bytes or not r.n_bytes}
    assert len(texts) == len(cut)
    whole = corpus_pipeline.run(spark, SMALL)
    assert by_text(whole.collect()) == by_text(kept[5].collect())
    assert whole.where("taken <= 0").count() == 0


@given
@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_every_query_runs_on_the_smallest_tables(spark, name):
    assert REGISTRY[name].run(spark, SMALL).count() > 0
