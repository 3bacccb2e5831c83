"""Whole jobs on small inputs."""

import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from proofline.functions import text as X
from proofline.operators import gates as G
from proofline.operators import printed as PR
from proofline.operators import questions as Q
from proofline.operators import regression as RG
from proofline.plans import acquiring as AC
from proofline.plans import evaluation as EV
from proofline.plans import indexing as IX
from proofline.plans import questions as PQ
from proofline.sources import readers as RD
from proofline.sources import store as ST
from proofline.sources import writers as W

REVENUE = "Total revenue was $1,234 million in fiscal 2024, and the market grew. " * 6
RISKS = "Competition may harm the business, and suppliers may fail. " * 6
PAGE = f"<html><body><p>Item 1. Business</p><p>{REVENUE}</p><p>Item 1A. Risk Factors</p><p>{RISKS}</p></body></html>"


def documents(spark, report_date="2024-09-28"):
    rows = [
        ("0000000001-24-000001", 1, "10-K", "One", "2024-11-01", report_date, "one.htm", bytearray(PAGE.encode())),
        ("0000000002-24-000001", 2, "10-K", "Two", "2024-11-01", None, "two.htm", bytearray(b"<p>x</p>")),
    ]
    return spark.createDataFrame(
        rows, "accession STRING, cik BIGINT, form STRING, company STRING, filing_date STRING, report_date STRING, document STRING, content BINARY"
    ).withColumns({c: F.to_date(c) for c in ("filing_date", "report_date")})


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index"))
    written, refused = IX.index_filings(documents(spark), IX.hashing_embedder(), path)
    assert [r.violations for r in refused.collect()] == [["report_date"]]
    assert [(r.accession, r.dimensions) for r in written.collect()] == [("0000000001-24-000001", 64)]
    chunks = ST.read_chunks(spark, path)
    return EV.Index(written.select("cik", "fiscal_year", "accession"), chunks), path


def test_an_index_written_again_replaces_its_filing(spark, tmp_path):
    path = str(tmp_path / "twice")
    IX.index_filings(documents(spark), IX.hashing_embedder(), path)
    before = ST.read_chunks(spark, path).count()
    IX.index_filings(documents(spark), IX.hashing_embedder(), path)
    assert ST.read_chunks(spark, path).count() == before


def test_a_split_is_asked_graded_and_recorded(spark, index):
    held, _ = index
    questions = spark.createDataFrame(
        [
            ("right", 1, 2024, "What was total revenue in fiscal 2024?", True, None, True, Decimal("1234000000")),
            ("wrong", 1, 2024, "How much was total revenue in fiscal 2024?", True, None, True, Decimal("1234000000")),
            ("refuse", 1, 2024, "What was total revenue in fiscal 2019?", False, "wrong_year", True, None),
            ("gate", 1, 2024, "Total revenue in fiscal 2018?", False, "wrong_year", False, None),
            ("outside", 9, 2024, "What was total revenue?", False, "other_company", True, None),
        ],
        "id STRING, cik BIGINT, fiscal_year INT, question STRING, answerable BOOLEAN, negative_kind STRING, e2e BOOLEAN, expected_value DECIMAL(38,9)",
    ).select(
        "*", F.lit("golden").alias("kind"), F.lit("dev").alias("split"), F.lit(None).cast("int").alias("fold"), F.lit("ONE").alias("ticker"),
        F.lit("0.005").cast("decimal(10,6)").alias("tolerance"), F.lit(False).alias("per_share"), F.lit(None).cast("string").alias("expected_item"),
    )
    embedded = IX.embedded(questions, IX.hashing_embedder(), F.col("question"))
    asked = []

    def generate(prompts):
        # A stand-in for a model: the reply depends on the case.
        replies = (
            F.when(F.col("id") == "right", "Total revenue was $1,234 million [1].")
            .when(F.col("id") == "wrong", "Total revenue was $9,999 million [1].")
            .otherwise(X.refusal_token(F.col("nonce")))
        )
        asked.append(sorted(r.id for r in prompts.select("id").collect()))
        return prompts.withColumns(
            {"text": replies, "prompt_tokens": F.lit(10).cast("long"), "completion_tokens": F.lit(2).cast("long"), "generator_seconds": F.lit(0.5)}
        )

    gates = lambda q, y, best: G.all_of(G.period_guard(q, y), G.cosine_gate(best, 0.0))
    records = {r.id: r for r in EV.run_split(embedded, held, gates, generate).collect()}
    # Declined rows never reach the generator.
    assert asked == [["refuse", "right", "wrong"]]
    assert {k: r.outcome for k, r in records.items()} == {
        "right": "answered", "wrong": "unsupported_claim", "refuse": "model_declined", "gate": "scored_only", "outside": "out_of_scope",
    }
    right = records["right"]
    assert (right.numeric_correct, right.citation_supported, right.gold_retrieved, right.cited_items) == (True, True, True, ["Item 1"])
    assert records["wrong"].numeric_correct is None and records["refuse"].scores["period"] == 0.0
    assert right.retrieved[0].startswith("0000000001-24-000001:Item 1#") and right.generated and not records["gate"].generated


def test_recorded_calls_answer_and_misses_show(spark):
    from proofline.functions.canonical import content_key
    from proofline.operators import retrieval as R

    key = content_key(kind=F.lit("generate"), model=F.lit("m"), options=F.lit("{}"), prompt=F.lit("hello"))
    made = spark.range(2).select(
        F.lit("generate").alias("kind"), key.alias("key"), F.col("id").alias("position"),
        F.concat(F.lit('{"text":"t'), F.col("id").cast("string"), F.lit('","seconds":1.5}')).alias("response"),
    )
    prompts = spark.createDataFrame([("hello",), ("other",)], "prompt STRING")
    got = {r.prompt: (r.text, r.not_recorded) for r in EV.recorded_generator(R.latest_recordings(made), "m")(prompts).collect()}
    assert got == {"hello": ("t1", False), "other": (None, True)}


def facts_document(cik, accession, year, value):
    fact = {"end": f"{year}-09-28", "val": value, "accn": accession, "fy": year, "fp": "FY", "form": "10-K", "filed": f"{year}-11-01"}
    return json.dumps({"cik": cik, "entityName": "E", "facts": {"us-gaap": {"Assets": {"units": {"USD": [fact, fact]}}, "Other": {"units": {"USD": [fact]}}}}})


def listing(accessions, pages=()):
    recent = {
        "form": ["10-K"] * len(accessions), "accessionNumber": list(accessions), "primaryDocument": ["d.htm"] * len(accessions),
        "filingDate": ["2024-11-01"] * len(accessions), "reportDate": ["2024-09-28"] * len(accessions),
    }
    return recent, json.dumps({"name": "E", "filings": {"recent": recent, "files": list(pages)}})


def test_a_roster_is_pinned_with_a_reserve_in_the_gap(spark):
    acc = lambda n: f"{n:010d}-24-000001"
    roster = spark.createDataFrame(
        [("A", 1, "A", "dev", 0, False), ("B", 2, "B", "eval", 1, False), ("R1", 3, "R1", None, 0, True), ("R2", 4, "R2", None, 1, True)],
        "ticker STRING, cik BIGINT, name STRING, split STRING, position INT, reserve BOOLEAN",
    )
    # A is sound and only listed on an older page, B has no facts, R1's year has two filings.
    texts = [(1, facts_document(1, acc(1), 2024, 5)), (4, facts_document(4, acc(4), 2024, 6))]
    two = json.loads(facts_document(3, acc(3), 2024, 7))
    two["facts"]["us-gaap"]["Assets"]["units"]["USD"].append({**two["facts"]["us-gaap"]["Assets"]["units"]["USD"][0], "accn": acc(33)})
    texts.append((3, json.dumps(two)))
    page = {"name": "CIK0000000001-submissions-001.json", "filingFrom": "2020-01-01", "filingTo": "2024-10-30"}
    older, _ = listing([acc(1)])
    listings = [(1, listing([], [page])[1]), (3, listing([acc(3), acc(33)])[1]), (4, listing([acc(4)])[1])]
    tables = AC.acquire(
        roster, [2024],
        spark.createDataFrame(texts, "cik BIGINT, text STRING"),
        spark.createDataFrame(listings, "cik BIGINT, text STRING"),
        spark.createDataFrame([(1, page["name"], json.dumps(older))], "cik BIGINT, name STRING, text STRING"),
        spark.createDataFrame([(acc(1), bytearray(b"<p>one</p>")), (acc(4), bytearray(b"<p>four</p>"))], "accession STRING, content BINARY"),
        spark.createDataFrame([("Assets",)], "concept STRING"),
    )
    assert sorted((r.ticker, r.split) for r in tables["companies"].collect()) == [("A", "dev"), ("R2", "eval")]
    (gap,) = tables["excluded"].collect()
    assert (gap.ticker, gap.replaced_by, gap.reason) == ("B", "R2", "0 10-K filings carry the year")
    filings = {r.ticker: r for r in tables["filings"].collect()}
    assert filings["A"].text_chars == 3 and filings["R2"].url.endswith("/4/000000000424000001/d.htm")
    assert {(r.cik, r.concept) for r in tables["facts"].select("cik", "concept").collect()} == {(1, "Assets"), (4, "Assets")}
    assert tables["concepts"].count() == 4
    assert AC.changed_since(tables["filings"], tables["filings"].withColumn("document_sha256", F.lit("x"))).count() == 2


@pytest.mark.parametrize("value", ['"12"', "NaN", "true", "null"])
def test_a_value_that_is_not_a_number_refuses_the_document(spark, value):
    text = facts_document(1, "a", 2024, 5).replace('"val": 5', f'"val": {value}')
    facts, refused = RD.parse_company_facts(spark.createDataFrame([(text,), (facts_document(2, "b", 2024, 1.25),)], "text STRING"))
    assert [r.value for r in facts.collect()] == [Decimal("1.25")] * 3
    assert refused.count() == 1


def test_listings_of_unequal_length_are_refused(spark):
    recent, text = listing(["0000000001-24-000001"])
    broken = json.loads(text)
    broken["filings"]["recent"]["form"] = []
    filings, _, refused = RD.parse_submissions(spark.createDataFrame([(1, text), (2, json.dumps(broken))], "cik BIGINT, text STRING"))
    assert filings.count() == 1 and [r.cik for r in refused.collect()] == [2]
    assert RD.filing_with(filings, F.lit("000000000124000001")).count() == 1


def test_a_roster_file_is_checked(spark):
    good = 'fold_seed = 3\n[[companies]]\nticker="A"\ncik=1\nname="A"\nsplit="dev"\n[[reserves]]\nticker="R"\ncik=2\nname="R"\n'
    companies, settings = RD.read_roster(spark, good)
    assert companies.count() == 2 and settings == {"fold_seed": 3}
    with pytest.raises(ValueError):
        RD.read_roster(spark, good.replace('ticker="R"', 'ticker="A"'))
    with pytest.raises(ValueError):
        RD.read_roster(spark, good.replace('"dev"', '"x"'))


def test_cases_are_written_and_read_back_the_same(spark, tmp_path):
    cases = spark.createDataFrame(
        [(f"id{i}", "dev", None, False, "T", 1, 2024, "a", "What was it?", "t/0", True, None, "c", 2024, None, Decimal("1.5"), "USD", Decimal("0.005"), None) for i in range(5)],
        RD.S.GOLDEN_CASE,
    ).withColumn("period_end", F.to_date(F.lit("2024-09-28")))
    path = str(tmp_path / "golden.jsonl")
    W.write_json_lines(cases, path, "id")
    sound, refused, repeated = RD.read_golden(spark, path)
    assert sound.select(cases.columns).exceptAll(cases).count() == 0 and sound.count() == 5
    assert refused.count() == 0 and repeated.count() == 0
    (tmp_path / "bad.jsonl").write_text('{"id": "a", "split": "dev"}\nnot json\n\n{"id": "a", "cik": "x"}\n')
    _, refused, repeated = RD.read_golden(spark, str(tmp_path / "bad.jsonl"))
    assert sorted(r.line or r.id for r in refused.collect()) == ["a", "not json", '{"id": "a", "cik": "x"}']
    assert repeated.count() == 0
    lines = [r.value for r in W.canonical_lines(cases, "id").collect()]
    assert lines == sorted(lines) and list(json.loads(lines[0])) == sorted(cases.columns) and ": " not in lines[0]


def records(spark, n=240):
    base = spark.range(n).withColumn("k", F.col("id").cast("int"))
    k = F.col("k")
    return base.select(
        F.col("id").cast("string").alias("id"), F.lit("golden").alias("kind"), (k % 2).alias("fold"), (k % 10).cast("string").alias("ticker"),
        (k % 3 == 0).alias("answerable"), F.when(k % 3 != 0, "wrong_year").alias("negative_kind"), F.lit(True).alias("e2e"),
        F.create_map(F.lit("cosine"), (k % 100) / 100, F.lit("recorded"), (k % 7) / 7, F.lit("period"), F.when(k % 5 == 0, 0.0).otherwise(1.0)).alias("scores"),
        F.when(k % 4 == 0, "model_declined").otherwise("answered").alias("outcome"), F.lit(True).alias("generated"), F.lit("text").alias("generation"),
        (k % 2 == 1).alias("numeric_correct"), F.lit(True).alias("citation_supported"), F.lit(0.5).alias("generator_seconds"),
        F.lit(1).cast("long").alias("prompt_tokens"), F.lit(None).cast("long").alias("completion_tokens"),
        F.create_map(F.lit("embed"), F.lit(0.5)).alias("stages"), F.lit(None).cast("string").alias("expected_item"),
        F.array().cast("array<string>").alias("cited_items"), F.lit(None).cast("boolean").alias("item_split_sane"),
    )


def test_a_report_has_every_table(spark):
    tables = EV.report(records(spark), spark.createDataFrame([("a", True, 1.0, 1.0)], RD.S.REPEAT_RECORD), resamples=50)
    page = EV.report_markdown(tables)
    assert len(tables) == 11 and page.count("## ") == 11
    arms = {r.arm: r for r in tables["Arms, end-to-end tier"].collect()}
    # A gated arm answers a subset of what the ungated arm answers.
    assert all(arms[a].false_answers <= arms["A"].false_answers for a in "BCDEF")
    assert all(arms[a].recall_cost + arms[a].correct == arms["A"].correct for a in "BCDEF")


def test_a_regression_is_seen_and_its_size_decides(spark):
    base = records(spark).drop("k")
    old = RG.judge(base, 0.5)
    same = EV.regression_check(base, old, 0.5, 0.5)
    assert same["Verdict"].first().passed and same["Changes"].count() == 0
    lost = base.withColumn("numeric_correct", F.when(F.col("id").isin("3", "9", "15"), False).otherwise(F.col("numeric_correct")))
    worse = EV.regression_check(lost, old, 0.5, 0.5)
    assert not worse["Verdict"].first().passed
    assert max(r.net for r in worse["Changes"].collect()) == 3
    assert not EV.regression_check(base, old, 0.4, 0.5)["Verdict"].first().passed
    gone = EV.regression_check(base.where("id <> '3'"), old, 0.5, 0.5)["Verdict"].first()
    assert gone.gone == 1 and not gone.passed


def test_a_default_threshold_is_fitted_on_all_runs(spark):
    a = records(spark).where("id < 100")
    b = records(spark).where("id >= 100")
    assert EV.default_threshold(a, b).first() == EV.default_threshold(records(spark)).first()


def small_corpus(spark, n):
    companies = spark.range(n).select(
        F.concat(F.lit("T"), "id").alias("ticker"), F.col("id").alias("cik"), F.concat(F.lit("Name"), "id").alias("name"),
        F.lit("eval").alias("split"), (F.col("id") % 2).cast("int").alias("fold"), F.lit("all").alias("peer_group"),
    )
    filings = companies.select("ticker", "cik", F.concat(F.lit("F"), "cik").alias("accession"), F.lit(2024).alias("fiscal_year"), F.to_date(F.lit("2024-12-31")).alias("report_date"), "split")
    years = F.explode(F.sequence(F.lit(2017), F.lit(2024))).alias("year")
    facts = filings.select("cik", "accession", years).select(
        "cik", "accession", F.lit("us-gaap").alias("taxonomy"), F.lit("Assets").alias("concept"), F.lit("USD").alias("unit"),
        (F.col("cik") * 1111 + F.col("year") * 7919).cast("decimal(38,9)").alias("value"), F.lit(None).cast("date").alias("start"),
        F.make_date("year", F.lit(12), F.lit(31)).alias("end"), F.col("year").alias("fiscal_year"), F.lit("10-K").alias("form"), F.col("year").alias("ordinal"),
    )
    printed = facts.where("year(end) >= 2023").groupBy("accession").agg(F.concat_ws(" ", F.collect_list(F.format_number("value", 0))).alias("t"))
    texts = printed.select("accession", F.concat(F.lit("Balances: "), "t", F.lit(" and premiums earned.")).alias("text"))
    concepts = spark.createDataFrame([("assets", ["Nope", "Assets"], "USD", ["{company}'s assets in {year}?", "State {company}'s assets of {year}."])], "key STRING, tags ARRAY<STRING>, unit STRING, phrasings ARRAY<STRING>")
    sector = spark.createDataFrame([("deposits", "Deposits", "deposits", ["total deposits"]), ("premiums", "Premiums", "premiums", ["premiums earned"]), ("assets", "Assets", "assets", ["zzz"])], "key STRING, tag STRING, label STRING, absent_phrases ARRAY<STRING>")
    off = spark.createDataFrame([(f"o{i}", "Where is {company}?", f"word{i}") for i in range(4)] + [("b", "What?", "balances")], "key STRING, question STRING, marker STRING")
    return PQ.Corpus(companies, filings, facts, texts, concepts, sector, ["What {label} of {company} in {year}?"], off)


def test_a_company_stays_short_only_if_every_peer_was_asked_about(spark):
    c = small_corpus(spark, 8)
    printed = PR.printed_numbers(c.texts).persist()
    key = lambda rows: sorted((r.accession, r.asked_accession, r.key, r.years_before, r.drop_reason or "") for r in rows.collect())
    ask = lambda wanted, total: Q.other_companies_until(
        c.filings, c.companies, c.facts, printed, c.concepts, c.companies.select("split", "ticker", F.lit(wanted).alias("wanted"), F.lit(total).alias("total")), 3
    )
    every = key(Q.other_companies(c.filings, c.companies, c.facts, printed, c.concepts))
    assert len(every) == 8 * 7 * 2
    assert key(ask(10**6, 0)) == every == key(ask(0, 10**6))
    some = key(ask(3, 20))
    assert len(some) < len(every) and set(some) <= set(every)
    kept = [k[0] for k in some if not k[4]]
    assert len(kept) >= 20 and all(kept.count(f"F{i}") >= 3 for i in range(8))


def test_a_question_set_fills_its_quotas(spark):
    n = 8
    corpus = small_corpus(spark, n)
    tables = PQ.build(corpus, 5, {"eval": (2, 4)})
    cases = tables["cases"].collect()
    assert len({c.id for c in cases}) == len(cases)
    positives = [c for c in cases if c.answerable]
    negatives = [c for c in cases if not c.answerable]
    assert len(positives) == n * 2 * 2 == len(negatives)
    kinds = {k: sum(c.negative_kind == k for c in negatives) for k in ("wrong_year", "other_company", "unreported_concept", "off_domain")}
    assert set(kinds.values()) == {8}
    for ticker in {c.ticker for c in cases}:
        mine = [c for c in cases if c.ticker == ticker and c.e2e]
        assert sum(c.answerable for c in mine) == 2 and sum(not c.answerable for c in mine) == 4
    assert tables["shortages"].count() == 0
    drops = {(r.kind, r.key, r.reason): r.n for r in tables["drops"].collect()}
    assert drops[("unreported_concept", "premiums", "phrase_in_text")] == n and drops[("unreported_concept", "assets", "reported_by_company")] == n
    assert drops[("off_domain", "b", "marker_in_text")] == n and drops[("unreported_concept", None, "phrase_in_text")] == n
    sample = next(c for c in positives if c.id.endswith("y1:p0"))
    assert sample.question == f"{'Name' + sample.ticker[1:]}'s assets in 2023?" and sample.concept == "us-gaap:Assets"
    again = PQ.build(corpus, 5, {"eval": (2, 4)})["cases"]
    assert again.exceptAll(tables["cases"]).count() == 0
