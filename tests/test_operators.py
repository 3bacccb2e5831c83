"""Retrieval, printed numbers, sampling, facts and questions against brute force on small data."""

from decimal import Decimal

import numpy as np
from pyspark.sql import functions as F

from proofline.functions import amounts as A
from proofline.functions import text as X
from proofline.operators import facts as FA
from proofline.operators import gates as G
from proofline.operators import index as IX
from proofline.operators import printed as PR
from proofline.operators import questions as Q
from proofline.operators import retrieval as R
from proofline.operators import selection as SEL

STATEMENT = """
CONSOLIDATED BALANCE SHEETS (in millions)
Total assets
$
364,980
352,583
Diluted earnings per share
$
6.08
6.13
See Note 105 on page 212.
Total net sales increased 2% to $391.0 billion.
Dividends of $15 billion were paid.
Capital expenditures were ( 9,447 ) in the year.
"""


def test_topk_equals_brute_force_with_one_hot_filing(spark):
    rng = np.random.default_rng(5)
    n = 600
    filing = np.where(rng.random(n) < 0.5, 0, rng.integers(1, 6, n))
    vectors = rng.normal(size=(n, 8)).astype(np.float32)
    vectors[3] = 0
    chunks = spark.createDataFrame(
        [(int(f), int(i), i, v.tolist()) for i, (f, v) in enumerate(zip(filing, vectors))],
        "accession INT, chunk_id BIGINT, ordinal INT, vector ARRAY<FLOAT>",
    )
    asked = rng.normal(size=(200, 8)).astype(np.float32)
    target = np.where(rng.random(200) < 0.6, 0, rng.integers(1, 7, 200))
    questions = spark.createDataFrame(
        [(i, int(f), v.tolist()) for i, (f, v) in enumerate(zip(target, asked))], "question_id INT, accession INT, vector ARRAY<FLOAT>"
    )
    got = {}
    for row in R.scoped_topk(questions, chunks, 4, block_rows=16).collect():
        got.setdefault(row.question_id, []).append((row.rank, row.chunk_id, row.score))
    norms = np.linalg.norm(vectors.astype(float), axis=1)
    units = vectors / np.where(norms == 0, 1, norms)[:, None]
    for i in range(200):
        mine = np.flatnonzero(filing == target[i])
        scores = np.round(units[mine] @ (asked[i] / np.linalg.norm(asked[i].astype(float))), 9)
        best = sorted(zip(-scores, mine))[:4]
        assert [c for _, c, _ in sorted(got.get(i, []))] == [c for _, c in best]


def test_printed_values(spark):
    values = [
        ("364980000000", False, True, True), ("352583000000", False, True, True), ("391035000000", False, True, True),
        ("9447000000", False, True, True), ("-9447000000", False, True, True), ("383285000000", False, False, False),
        ("105000000", False, False, True), ("15200000000", False, False, True), ("16000000000", False, False, False),
        ("6.08", True, True, True), ("6.07", True, False, False), ("6.075", True, False, True),
    ]
    texts = spark.createDataFrame([("a", STATEMENT)], "accession STRING, text STRING")
    asked = spark.createDataFrame(
        [("a", Decimal(v), p, s, m) for v, p, s, m in values],
        "accession STRING, value DECIMAL(38,9), per_share BOOLEAN, strict BOOLEAN, loose BOOLEAN",
    ).withColumn("nano", A.to_nano(F.col("value")))
    found = PR.lookup(asked, PR.printed_numbers(texts)).withColumn("inline", PR.prints_in(F.lit(STATEMENT), F.col("nano"), F.col("per_share")))
    rows = found.collect()
    assert len(rows) == len(values)
    for r in rows:
        # 6.075 rounds to the cent 6.08 (half to even), which is printed.
        assert (r.prints, r.may_print) == (r.strict, r.loose), r
        assert r.inline == r.prints, r


def test_period_rules(spark):
    facts = spark.createDataFrame(
        [
            (1, "us-gaap", "Revenues", "USD", Decimal(10), "2023-09-30", "2024-09-28", 2024, "10-K", "f1", "2024-11-01", 0),
            (1, "us-gaap", "Revenues", "USD", Decimal(3), "2024-06-30", "2024-09-28", 2024, "10-K", "f1", "2024-11-01", 1),
            (1, "us-gaap", "Revenues", "USD", Decimal(9), "2022-09-25", "2023-09-30", 2024, "10-K", "f1", "2024-11-01", 2),
            (1, "us-gaap", "Assets", "USD", Decimal(7), None, "2024-09-28", 2024, "10-K", "f1", "2024-11-01", 3),
            (1, "us-gaap", "Assets", "USD", Decimal(8), None, "2024-09-30", 2024, "10-K", "f1", "2024-11-01", 4),
            (1, "us-gaap", "Revenues", "USD", Decimal(11), "2023-09-30", "2024-09-28", 2025, "10-K", "f2", "2025-11-01", 0),
        ],
        "cik INT, taxonomy STRING, concept STRING, unit STRING, value DECIMAL(38,9), start STRING, `end` STRING, fiscal_year INT, form STRING, accession STRING, filed STRING, ordinal INT",
    ).withColumns({c: F.to_date(c) for c in ("start", "end", "filed")})
    wanted = spark.createDataFrame(
        [("f1", "USD", ["Revenues", "Assets"], "2024-09-28", 0), ("f1", "USD", ["Revenues"], "2024-09-28", 1),
         ("f1", "USD", ["Nothing", "Assets", "Revenues"], "2024-09-28", 0), ("f1", "USD", ["Nothing"], "2024-09-28", 3)],
        "accession STRING, unit STRING, tags ARRAY<STRING>, report_date STRING, years_before INT",
    ).select("accession", "unit", "tags", F.to_date("report_date").alias("report_date"), "years_before", F.lit("us-gaap").alias("taxonomy"), F.col("tags")[0].alias("k"))
    got = {(r.k, r.years_before): (r.concept, r.conflict, r.fact.value if r.fact else None) for r in FA.first_tag_reported(wanted, facts).collect()}
    assert got[("Revenues", 0)] == ("Revenues", False, 10) and got[("Revenues", 1)] == ("Revenues", False, 9)
    # A conflict in an earlier tag stops the search.
    assert got[("Nothing", 0)][:2] == ("Assets", True) and got[("Nothing", 3)] == (None, False, None)
    asked = wanted.where("k = 'Revenues' AND years_before = 0").select("accession", F.lit(1).alias("cik"), "unit", F.array(F.lit("Revenues")).alias("tags"), "report_date", "years_before")
    assert sorted(r.value for r in FA.values_for_period(asked, facts).collect()) == [10, 11]


def test_scopes(spark):
    filings = spark.createDataFrame([(1, 2023, "a"), (1, 2024, "b"), (2, 2020, "c")], "cik INT, fiscal_year INT, accession STRING")
    asked = spark.createDataFrame([(0, 1, None), (1, 1, 2023), (2, 1, 2022), (3, 3, None), (4, 2, None)], "q INT, cik INT, fiscal_year INT")
    got = {r.q: (r.accession, r.out_of_scope) for r in R.resolve_scope(asked, filings).collect()}
    assert got == {0: ("b", False), 1: ("a", False), 2: (None, True), 3: (None, True), 4: ("c", False)}


def test_gates(spark):
    df = spark.createDataFrame([("Revenue in 2019?", 2024, 0.9), ("Revenue in FY23?", 2024, 0.1), ("Revenue?", 2024, 0.9)], "q STRING, y INT, best DOUBLE")
    gate = G.gate_named("period+cosine", F.col("q"), F.col("y"), F.col("best"), 0.5)
    rows = [r.g for r in df.select(gate.alias("g")).collect()]
    assert [(r.admitted, r.rejection) for r in rows] == [(False, "out_of_period"), (False, "gate_rejected"), (True, "gate_rejected")]
    assert rows[0].reason == "the question names fiscal 2019; this filing reports fiscal 2022 to 2024"
    assert rows[0].scores == {"period": 0.0, "cosine": 0.9} and rows[0].confidence == 0.9
    assert rows[1].reason == "best passage scored 0.100, below the 0.5 threshold"


def allocate(total, capacity):
    placed = dict.fromkeys(capacity, 0)
    while total:
        for name in capacity:
            if total and placed[name] < capacity[name]:
                placed[name] += 1
                total -= 1
    return placed


def test_even_allocation_equals_going_round(spark):
    rng = np.random.default_rng(1)
    groups = {g: {n: int(rng.integers(0, 9)) for n in range(int(rng.integers(1, 9)))} for g in range(40)}
    totals = {g: int(rng.integers(0, sum(c.values()) + 1)) for g, c in groups.items()}
    capacity = spark.createDataFrame([(g, n, n, v) for g, c in groups.items() for n, v in c.items()], "g INT, name INT, position INT, capacity BIGINT")
    total = spark.createDataFrame(list(totals.items()), "g INT, total BIGINT")
    got = {}
    for row in SEL.even_allocation(capacity, total, ["g"]).collect():
        got.setdefault(row.g, {})[row.name] = row.allocation
    assert got == {g: allocate(totals[g], c) for g, c in groups.items()}


def test_a_spread_sample_takes_each_fact_before_any_twice(spark):
    rows = [(f"{s}-{c}-{f}-{p}", s, c, f) for s in ("x", "y") for c in range(3) for f in range(4) for p in range(5)]
    pool = spark.createDataFrame(rows, "id STRING, s STRING, c INT, f INT").withColumn("quota", F.lit(14))
    picked = SEL.spread_sample(pool, ["s"], "quota", 14, 3, group=F.struct("c", "f"), concept=F.col("c"))
    for stratum in ("x", "y"):
        mine = sorted((r for r in picked.where(F.col("s") == stratum).collect()), key=lambda r: r.pick)
        assert len(mine) == 14 and len({(r.c, r.f) for r in mine[:12]}) == 12
        assert all(len({r.c for r in mine[i : i + 3]}) == 3 for i in (0, 3, 6, 9))
    again = SEL.spread_sample(pool.where("s = 'x'"), ["s"], "quota", 14, 3, group=F.struct("c", "f"), concept=F.col("c"))
    assert {r.id for r in again.collect()} == {r.id for r in picked.where("s = 'x'").collect()}


def test_peer_rings_ask_about_each_company_as_often(spark):
    companies = spark.createDataFrame([(f"t{i}", "g" if i < 7 else "h") for i in range(9)], "ticker STRING, peer_group STRING")
    filings = companies.select("ticker", F.lit(2024).alias("fiscal_year"), F.concat(F.lit("a"), "ticker").alias("accession"))
    every = {(r.accession, r.asked_company) for r in Q.peer_pairs(filings, companies).collect()}
    assert len(every) == 7 * 6 + 2
    ring = [(r.accession, r.asked_company) for r in Q.peer_pairs(filings, companies, 3).collect()]
    assert len(ring) == len(set(ring)) == 7 * 3 + 2 and set(ring) <= every
    asked = [c for _, c in ring]
    assert all(asked.count(f"t{i}") == 3 for i in range(7))
    assert {(r.accession, r.asked_company) for r in Q.peer_pairs(filings, companies, 99).collect()} == every


def test_a_walk_meets_every_peer_once(spark):
    companies = spark.createDataFrame([(f"t{i}", "g" if i < 23 else "h" if i < 25 else "i") for i in range(26)], "ticker STRING, peer_group STRING")
    filings = companies.select("ticker", F.lit(2024).alias("fiscal_year"), F.concat(F.lit("a"), "ticker").alias("accession"))
    every = {(r.accession, r.asked_company) for r in Q.peer_pairs(filings, companies).collect()}
    seats = Q.peer_seats(filings, companies).persist()
    rounds = [[(r.accession, r.asked_company) for r in Q.walked_peers(seats, seats, first, width, 7).collect()] for first, width in ((0, 2), (2, 2), (4, 4), (8, 99))]
    met = [pair for found in rounds for pair in found]
    assert len(met) == len(set(met)) and set(met) == every
    assert len(rounds[0]) == 23 * 2 + 2 and len({c for _, c in rounds[0]}) > 10
    other = Q.walked_peers(seats, seats, 0, 2, 8).collect()
    assert {(r.accession, r.asked_company) for r in other} != set(rounds[0])


def test_index_audit_sees_each_defect(spark):
    rows = [(f"000000000{f}-24-000001", f"000000000{f}-24-000001:Item 1#{i}", i, [1.0, float(i)]) for f in range(3) for i in range(4)]
    chunks = spark.createDataFrame(rows, "accession STRING, chunk_id STRING, ordinal INT, vector ARRAY<FLOAT>")
    manifest = IX.filing_digests(chunks)
    assert all(r.problems == [] for r in IX.audit(chunks, manifest, 2).collect())
    other = chunks.withColumn("vector", F.when(F.col("ordinal") == 3, F.array(F.lit(1.0), F.lit(9.0)).cast("array<float>")).otherwise(F.col("vector")))
    assert all(r.problems == ["digest"] for r in IX.audit(other, manifest, 2).collect())
    assert IX.index_digest(IX.filing_digests(chunks.repartition(3)), "m", True).first() == IX.index_digest(manifest, "m", True).first()
    assert IX.vector_sizes(chunks).count() == 1


def test_leaks(spark):
    rows = [("a", "eval", "What was Apple's revenue?"), ("b", "dev", "What was Apple's revenue?"), ("c", "dev", "Does the Passage answer this?"), ("d", "eval", "Pineapple sales?")]
    cases = spark.createDataFrame(rows, "id STRING, split STRING, question STRING")
    assert sorted(r.id for r in Q.leaks(cases, ["apple"], "does the passage answer").collect()) == ["a", "c"]


def test_words_column_pads(spark):
    assert spark.sql("SELECT 'A-b' AS t").select(X.normalize_words(F.col("t")).alias("w")).first().w == " a b "
