"""Labelled questions from reported facts and filing text.

Inputs, one row each:
  companies  ticker, cik, name, split, fold, peer_group
  filings    ticker, cik, accession, fiscal_year, report_date, split
  facts      see ``operators.facts``
  printed    ``operators.printed.printed_numbers`` of a filing's passages, or of its whole text
  words      accession, words (``normalize_words`` of the whole text)
  concepts   key, tags (array, in order), unit, phrasings (array)
  sector     key, tag, label, absent_phrases (array)
  off_domain key, question, marker

Every function returns one row per checked fact with ``drop_reason``; null means kept.
``cases_of`` turns kept rows into questions, ``drops_of`` counts the others.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofline import schemas as S
from proofline.functions import amounts as A
from proofline.functions import text as X
from proofline.operators import facts as FA
from proofline.operators import phrases as PH
from proofline.operators import printed as PR
from proofline.operators.running import running_totals
from proofline.session import materialize

# --- fixed values: concepts, their tags in the order they are tried, and their units ---------------
CONCEPTS = (
    ("revenue", ("Revenues", "RevenueFromContractWithCustomerExcludingAssessedTax", "RevenueFromContractWithCustomerIncludingAssessedTax", "SalesRevenueNet"), "USD"),
    ("net_income", ("NetIncomeLoss",), "USD"),
    ("operating_income", ("OperatingIncomeLoss",), "USD"),
    ("research_and_development", ("ResearchAndDevelopmentExpense", "ResearchAndDevelopmentExpenseExcludingAcquiredInProcessCost"), "USD"),
    ("selling_general_administrative", ("SellingGeneralAndAdministrativeExpense",), "USD"),
    ("diluted_eps", ("EarningsPerShareDiluted",), "USD/shares"),
    ("total_assets", ("Assets",), "USD"),
    ("total_liabilities", ("Liabilities",), "USD"),
    ("cash", ("CashAndCashEquivalentsAtCarryingValue",), "USD"),
    ("long_term_debt", ("LongTermDebtNoncurrent", "LongTermDebt"), "USD"),
    ("capital_expenditures", ("PaymentsToAcquirePropertyPlantAndEquipment", "PaymentsToAcquireProductiveAssets"), "USD"),
    ("dividends_paid", ("PaymentsOfDividends", "PaymentsOfDividendsCommonStock"), "USD"),
)
#: Multipliers of the walk over peers: primes beyond any number of seats (the largest below 2^31).
WALK_PRIMES = (2147483647, 2147483629, 2147483587, 2147483579, 2147483563, 2147483549)
#: Peers a filing asks about in the first round.
FIRST_STEPS = 2
PHRASINGS = (
    "What was {company}'s {label} in fiscal {year}?",
    "How much {label} did {company} report for fiscal year {year}?",
    "Which amount of {label} does {company} state for fiscal {year}?",
    "State {company}'s {label} for its fiscal {year}.",
)


def default_concepts(spark) -> DataFrame:
    """The concepts with one set of phrasings; pass your own table for other wordings."""
    rows = [
        (key, list(tags), unit, [p.replace("{label}", key.replace("_", " ")) for p in PHRASINGS])
        for key, tags, unit in CONCEPTS
    ]
    return spark.createDataFrame(rows, "key STRING, tags ARRAY<STRING>, unit STRING, phrasings ARRAY<STRING>")


def _wanted(filings: DataFrame, concepts: DataFrame, years_back: tuple[int, ...]) -> DataFrame:
    """filings x concepts x years back; concepts are a handful of rows and years a literal."""
    return filings.crossJoin(F.broadcast(concepts)).withColumn(
        "years_before", F.explode(F.array(*[F.lit(y) for y in years_back]))
    )


def _filed_values(filings: DataFrame, concepts: DataFrame, facts: DataFrame, years_back: tuple[int, ...]) -> DataFrame:
    """(accession, key, years_before, concept, conflict, fact): first tag with a value."""
    wanted = _wanted(
        filings.select("accession", "report_date"), concepts.select("key", "tags", "unit"), years_back
    ).withColumn("taxonomy", F.lit(S.TAXONOMY))
    return FA.first_tag_reported(wanted, facts)


def _per_share() -> Column:
    return F.col("unit") == S.PER_SHARE_UNIT


def positives(filings: DataFrame, facts: DataFrame, printed: DataFrame, concepts: DataFrame) -> DataFrame:
    """Facts a filing reported for a year it covers, kept when its passages print them."""
    filed = _filed_values(filings, concepts, facts, S.COVERED_YEARS_BACK).select(
        "accession", "key", "unit", "years_before", "concept", "conflict", "fact",
        A.to_nano(F.col("fact.value")).alias("nano"), _per_share().alias("per_share"),
    )
    checked = PR.lookup(filed, printed)
    reason = (
        F.when(F.col("conflict"), F.lit("conflicting_values"))
        .when(F.col("fact").isNull(), F.lit("no_xbrl_fact"))
        .when(F.col("fact.value") == 0, F.lit("zero_value"))
        .when(~F.coalesce("prints", F.lit(False)), F.lit("not_in_indexed_text"))
    )
    return _labelled(checked.withColumn("drop_reason", reason), filings, "positive")


def wrong_years(filings: DataFrame, facts: DataFrame, printed: DataFrame, concepts: DataFrame) -> DataFrame:
    """Years four to seven back whose values, whichever were ever reported, the filing cannot print."""
    wanted = _wanted(
        filings.select("accession", "cik", "report_date"), concepts.select("key", "tags", "unit"), S.WRONG_YEARS_BACK
    )
    values = FA.values_for_period(wanted, facts).select(
        "accession", "key", "years_before", A.to_nano(F.col("value")).alias("nano"), _per_share().alias("per_share")
    )
    found = PR.lookup(materialize(values, "period-values"), printed).groupBy("accession", "key", "years_before").agg(
        F.bool_or("may_print").alias("_printed")
    )
    # One list for each filing, at most a row for each concept and year: the filings meet it before they
    # are multiplied by concepts and years.
    listed = found.groupBy("accession").agg(F.collect_list(F.struct("key", "years_before", "_printed")).alias("_found"))
    asked = _wanted(
        filings.select("accession").join(listed, "accession", "left"), concepts.select("key", "tags", "unit"), S.WRONG_YEARS_BACK
    )
    mine = F.filter("_found", lambda x: (x["key"] == F.col("key")) & (x["years_before"] == F.col("years_before")))
    joined = asked.select(
        "accession", "key", "unit", "years_before", F.get("tags", F.lit(0)).alias("concept"), F.get(mine, F.lit(0))["_printed"].alias("_printed")
    )
    reason = F.when(F.col("_printed").isNull(), F.lit("no_value_for_year")).when(
        F.col("_printed"), F.lit("value_in_text")
    )
    return _labelled(joined.withColumn("drop_reason", reason), filings, "wrong_year")


def peer_pairs(filings: DataFrame, companies: DataFrame, nearest: int | None = None) -> DataFrame:
    """(accession, asked_company, asked_accession): another company of the same peer group that
    filed for the same year.

    ``nearest`` takes that many peers after the company in a ring over its group, each company
    being asked about as often as any other; it is how a pool is sampled, and keeps its size
    linear. Without it every peer is asked about, so the pool grows with the square of a group:
    right for a roster of tens of companies, not for thousands.
    """
    group = filings.join(companies.select("ticker", "peer_group"), "ticker").select(
        "peer_group", "fiscal_year", "ticker", "accession"
    )
    if nearest is None:
        other = group.select(
            "peer_group", "fiscal_year", F.col("ticker").alias("asked_company"), F.col("accession").alias("asked_accession")
        )
        return group.join(other, ["peer_group", "fiscal_year"]).where(
            F.col("ticker") != F.col("asked_company")
        ).select("accession", "asked_company", "asked_accession")
    seats = running_totals(
        group.withColumn("_one", F.lit(1).cast("long")), "ticker", ["_one"], ["peer_group", "fiscal_year"]
    ).withColumnRenamed("_one_through", "seat")
    sizes = group.groupBy("peer_group", "fiscal_year").agg(F.count("*").alias("size"))
    reach = F.least(F.lit(nearest).cast("long"), F.col("size") - 1)
    asked = (
        seats.join(sizes, ["peer_group", "fiscal_year"])
        .where(F.col("size") > 1)
        .select("*", F.explode(F.sequence(F.lit(1).cast("long"), reach)).alias("_step"))
        .withColumn("seat", (F.col("seat") + F.col("_step") - 1) % F.col("size") + 1)
        .select("peer_group", "fiscal_year", "seat", "accession")
    )
    peers = seats.select(
        "peer_group", "fiscal_year", "seat", F.col("ticker").alias("asked_company"), F.col("accession").alias("asked_accession")
    )
    return asked.join(peers, ["peer_group", "fiscal_year", "seat"]).select(
        "accession", "asked_company", "asked_accession"
    )


def peer_seats(filings: DataFrame, companies: DataFrame) -> DataFrame:
    """peer_group, fiscal_year, ticker, accession, seat (from 0), size: the filing's place among those of
    its group and year. One filing per company and year."""
    group = filings.join(companies.select("ticker", "peer_group"), "ticker").select("peer_group", "fiscal_year", "ticker", "accession")
    by = ["peer_group", "fiscal_year"]
    numbered = running_totals(group.withColumn("_one", F.lit(1).cast("long")), "ticker", ["_one"], by)
    sizes = group.groupBy(*by).agg(F.count("*").alias("size"))
    return numbered.join(sizes, by).select(*by, "ticker", "accession", (F.col("_one_through") - 1).alias("seat"), "size")


def walked_peers(seats: DataFrame, walkers: DataFrame, first: int, width: int, seed: int) -> DataFrame:
    """(accession, asked_company, asked_accession): steps ``first`` to ``first + width`` of every walker's
    walk over its group. ``walkers`` are rows of ``seats``.

    Step t leads to the seat that lies 1 + (a * t + b) mod (size - 1) further. As a is a prime larger
    than any group, the first size - 1 steps meet every peer once, in an order that (a, b), drawn from
    the seed and the accession, decide; nothing is stored for it.
    """
    others = F.col("size") - 1
    drawn = F.xxhash64(F.lit(seed), "accession")
    factor = F.element_at(F.array(*[F.lit(p).cast("long") for p in WALK_PRIMES]), (F.pmod(drawn, F.lit(len(WALK_PRIMES))) + 1).cast("int"))
    begin = F.pmod(F.xxhash64(F.lit(seed + 1), "accession"), others)
    steps = F.sequence(F.lit(first).cast("long"), F.least(F.lit(first + width).cast("long"), others) - 1)
    asked = walkers.where(others > first).select("*", F.explode(steps).alias("_step"))
    asked = asked.withColumn("seat", (F.col("seat") + 1 + (factor * F.col("_step") + begin) % others) % F.col("size"))
    at = ["peer_group", "fiscal_year", "seat"]
    peers = seats.select(*at, F.col("ticker").alias("asked_company"), F.col("accession").alias("asked_accession"))
    return asked.select(*at, "accession").join(peers, at).select("accession", "asked_company", "asked_accession")


def _peer_values(filings: DataFrame, concepts: DataFrame, facts: DataFrame) -> DataFrame:
    filed = _filed_values(filings, concepts, facts, S.COVERED_YEARS_BACK)
    usable = F.col("fact").isNotNull() & ~F.col("conflict") & (F.col("fact.value") != 0)
    return filed.select(
        F.col("accession").alias("asked_accession"), "key", "unit", "years_before", "concept",
        F.when(usable, A.to_nano(F.col("fact.value"))).alias("nano"), _per_share().alias("per_share"),
    )


def _judged_peers(pairs: DataFrame, values: DataFrame, printed: DataFrame, filings: DataFrame) -> DataFrame:
    checked = PR.lookup(materialize(pairs.join(values, "asked_accession"), "peer-pairs"), printed)
    reason = F.when(F.col("nano").isNull(), F.lit("no_value_for_asked_company")).when(
        F.coalesce("may_print", F.lit(False)), F.lit("value_in_text")
    )
    return _labelled(checked.withColumn("drop_reason", reason), filings, "other_company")


def other_companies(
    filings: DataFrame,
    companies: DataFrame,
    facts: DataFrame,
    printed: DataFrame,
    concepts: DataFrame,
    nearest: int | None = None,
) -> DataFrame:
    """Figures of a peer for a year the filing covers, kept when the filing cannot print them."""
    values = _peer_values(filings, concepts, facts)
    return _judged_peers(peer_pairs(filings, companies, nearest), values, printed, filings)


def other_companies_until(
    filings: DataFrame,
    companies: DataFrame,
    facts: DataFrame,
    printed: DataFrame,
    concepts: DataFrame,
    enough: DataFrame,
    seed: int,
) -> DataFrame:
    """``other_companies`` for as many peers as are needed. ``enough``: split, ticker, wanted, total.

    Every filing walks over its group until its company has ``wanted`` kept candidates and its split
    ``total``, or no peer is left; so a company stays short only if all its peers were asked about.
    Rounds double, so there are at most as many as the largest group has binary digits, and what is
    looked at grows with what is wanted, not with the square of a group.
    """
    seats = materialize(peer_seats(filings, companies), "peer-seats")
    values = materialize(_peer_values(filings, concepts, facts), "peer-values")
    walkers, seen, first, width = seats, None, 0, FIRST_STEPS
    while True:
        found = materialize(_judged_peers(walked_peers(seats, walkers, first, width, seed), values, printed, filings), "peer-round")
        seen = found if seen is None else seen.unionByName(found)
        first, width = first + width, first + width
        kept = seen.where(F.col("drop_reason").isNull()).groupBy("split", "ticker").agg(F.count("*").alias("_kept"))
        of_split = kept.groupBy("split").agg(F.sum("_kept").alias("_of_split"))
        counted = enough.join(kept, ["split", "ticker"], "left").join(of_split, "split", "left")
        short = counted.where((F.coalesce("_kept", F.lit(0)) < F.col("wanted")) | (F.coalesce("_of_split", F.lit(0)) < F.col("total")))
        walkers = materialize(seats.where(F.col("size") - 1 > first).join(short, "ticker", "left_semi"), "peer-walkers")
        if walkers.isEmpty():
            return seen


def unreported_concepts(filings: DataFrame, facts: DataFrame, words: DataFrame, sector: DataFrame) -> DataFrame:
    """Concepts the company never reported and whose phrases the filing does not contain."""
    reported = FA.reported_concepts(facts).select("cik", F.col("concept").alias("tag"), F.lit(True).alias("_reported"))
    phrases = sector.select("key", F.explode("absent_phrases").alias("phrase"))
    said = PH.phrase_hits(words, phrases, "accession", "key").withColumn("_said", F.lit(True))
    # A handful of concepts per filing; the texts themselves are not repeated.
    asked = filings.select("accession", "cik").crossJoin(sector.select("key", "tag", "label"))
    joined = asked.join(reported, ["cik", "tag"], "left").join(said, ["accession", "key"], "left")
    reason = F.when(F.col("_reported"), F.lit("reported_by_company")).when(F.col("_said"), F.lit("phrase_in_text"))
    rows = joined.select(
        "accession", "key", "label", F.col("tag").alias("concept"), reason.alias("drop_reason"),
    )
    return _labelled(rows, filings, "unreported_concept")


def off_domain(filings: DataFrame, words: DataFrame, questions: DataFrame) -> DataFrame:
    """Questions about nothing a filing tells, kept when their marker phrase is not in it."""
    markers = questions.select("key", F.col("marker").alias("phrase"))
    said = PH.phrase_hits(words, markers, "accession", "key").withColumn("_said", F.lit(True))
    asked = filings.select("accession").crossJoin(questions.select("key", F.col("question").alias("phrasing")))
    joined = asked.join(said, ["accession", "key"], "left")
    rows = joined.select(
        "accession", "key", "phrasing", F.when(F.col("_said"), F.lit("marker_in_text")).alias("drop_reason")
    )
    return _labelled(rows, filings, "off_domain")


def _labelled(rows: DataFrame, filings: DataFrame, kind: str) -> DataFrame:
    known = filings.select("accession", "ticker", "cik", "fiscal_year", "split")
    joined = rows.join(known, "accession").withColumn("kind", F.lit(kind))
    if "years_before" in rows.columns:
        return joined.withColumn("period_year", F.col("fiscal_year") - F.col("years_before"))
    return joined.withColumn("period_year", F.lit(None).cast("int"))


def cases_of(candidates: DataFrame, companies: DataFrame, phrasings: DataFrame | None = None) -> DataFrame:
    """Kept candidates as questions, one per phrasing. ``phrasings``: key, phrasings."""
    kept = candidates.where(F.col("drop_reason").isNull())
    if "label" in kept.columns:
        # A concept is dropped once, and asked about for every year the filing covers.
        kept = kept.withColumn("years_before", F.explode(F.array(*[F.lit(y) for y in S.COVERED_YEARS_BACK])))
        kept = kept.withColumn("period_year", F.col("fiscal_year") - F.col("years_before"))
    if phrasings is not None:
        kept = kept.join(phrasings.select("key", F.posexplode("phrasings").alias("number", "phrasing")), "key")
    else:
        kept = kept.withColumn("number", F.lit(None).cast("int"))
    named = kept.join(companies.select("ticker", "name", "fold"), "ticker", "left")
    asked = F.col("asked_company") if "asked_company" in kept.columns else F.lit(None).cast("string")
    if "asked_company" in kept.columns:
        other = companies.select(F.col("ticker").alias("asked_company"), F.col("name").alias("_asked_name"))
        named = named.join(other, "asked_company", "left")
        name = F.col("_asked_name")
    else:
        name = F.col("name")
    label = F.col("label") if "label" in kept.columns else F.lit("")
    fact = "fact" in kept.columns
    positive = F.col("kind") == "positive"
    years = (
        F.concat(F.lit("y"), F.col("years_before").cast("string"))
        if "years_before" in kept.columns
        else F.lit(None).cast("string")
    )
    when = F.when(F.col("kind") == "wrong_year", F.col("period_year").cast("string")).otherwise(years)
    concept = F.col("concept") if "concept" in kept.columns else F.lit(None).cast("string")
    return named.select(
        X.case_id(
            F.when(positive, F.lit("pos")).otherwise(F.col("kind")), F.col("ticker"), F.col("fiscal_year"), asked,
            F.col("key"), when, F.concat(F.lit("p"), F.col("number").cast("string")),
        ).alias("id"),
        "split", "fold", F.lit(False).alias("e2e"), "ticker", "cik", "fiscal_year", "accession",
        X.fill(F.col("phrasing"), name, F.col("period_year"), label).alias("question"),
        F.concat_ws("/", "key", F.col("number").cast("string")).alias("template"),
        positive.alias("answerable"),
        F.when(~positive, F.col("kind")).alias("negative_kind"),
        F.concat(F.lit(f"{S.TAXONOMY}:"), concept).alias("concept"),
        "period_year",
        (F.when(positive, F.col("fact.end")) if fact else F.lit(None).cast("date")).alias("period_end"),
        (F.when(positive, F.col("fact.value")) if fact else F.lit(None)).cast(S.MONEY).alias("expected_value"),
        (F.when(positive, F.col("unit")) if "unit" in kept.columns else F.lit(None).cast("string")).alias("unit"),
        F.lit(S.RELATIVE_TOLERANCE).cast("decimal(10,6)").alias("tolerance"),
        asked.alias("asked_company"),
    )


def drops_of(candidates: DataFrame) -> DataFrame:
    """(kind, key, reason, n): dropped facts by kind, concept and reason, and by kind and reason
    (``key`` null), in one pass."""
    dropped = candidates.where(F.col("drop_reason").isNotNull())
    return dropped.groupingSets(
        [[F.col("kind"), F.col("key"), F.col("drop_reason")], [F.col("kind"), F.col("drop_reason")]],
        "kind", "key", "drop_reason",
    ).agg(F.count("*").alias("n")).select("kind", "key", F.col("drop_reason").alias("reason"), "n")


def leaks(cases: DataFrame, names: list[str], template: str, split: str = "eval") -> DataFrame:
    """Questions that carry a forbidden template, or in ``split`` a forbidden name."""
    known = [f" {' '.join(re.findall('[0-9a-z]+', n.lower()))} " for n in names]
    named = PH.says_any(X.normalize_words(F.col("question")), [n for n in known if n.strip()])
    return cases.where(
        F.contains(F.lower("question"), F.lit(template.lower())) | ((F.col("split") == split) & named)
    )


def statistics(cases: DataFrame) -> DataFrame:
    """(table, split, ticker, kind, fold, key, n): the count tables of a question set in one pass
    of grouping sets."""
    kind = F.when(F.col("answerable"), F.lit("positive")).otherwise(F.col("negative_kind"))
    rows = cases.select(
        "split", "ticker", "e2e", "fold", kind.alias("kind"), F.split_part("template", F.lit("/"), F.lit(1)).alias("key")
    )
    c = {n: F.col(n) for n in rows.columns}
    sets = [
        [c["split"], c["kind"]],
        [c["split"], c["kind"], c["e2e"]],
        [c["split"], c["ticker"], c["kind"], c["e2e"]],
        [c["ticker"], c["kind"]],
        [c["fold"], c["ticker"]],
        [c["kind"], c["key"]],
    ]
    return rows.groupingSets(sets, *rows.columns).agg(
        F.count("*").alias("n"), F.grouping_id().alias("grouping")
    )


def distinct_facts(cases: DataFrame) -> DataFrame:
    return cases.where("answerable").agg(
        F.count_distinct(F.struct("accession", "concept", "period_year")).alias("facts")
    )


def narrative_problems(narratives: DataFrame, filings: DataFrame, sections: DataFrame, words: DataFrame) -> DataFrame:
    """(id, problem): hand-written questions that do not hold against their filing.

    ``sections``: accession, item, text."""
    known = filings.select(
        "ticker", "fiscal_year", F.col("accession").alias("_accession"), F.col("cik").alias("_cik"), F.lit(True).alias("_locked")
    )
    placed = narratives.join(known, ["ticker", "fiscal_year"], "left")
    same = (F.col("_accession") == F.col("accession")) & (F.col("_cik") == F.col("cik"))
    # A section label can occur twice; its texts are one body of words, in the order of the filing
    # where ``sections`` names a position.
    place = "position" if "position" in sections.columns else "text"
    parts = F.array_sort(F.collect_list(F.struct(F.col(place).alias("place"), F.col("text").alias("text"))))
    bodies = sections.groupBy("accession", F.col("item").alias("expected_item")).agg(
        X.normalize_words(F.array_join(F.transform(parts, lambda p: p["text"]), "\n")).alias("_body")
    )
    checked = placed.join(bodies, ["accession", "expected_item"], "left").join(
        words.withColumnRenamed("words", "_words"), "accession", "left"
    )
    missing = F.transform(
        F.filter("evidence_terms", lambda t: ~X.contains_phrase(F.col("_body"), t)),
        lambda t: F.concat(F.lit("'"), t, F.lit("' is not in "), F.col("expected_item")),
    )
    found = F.transform(
        F.filter("absent_terms", lambda t: X.contains_phrase(F.col("_words"), t)),
        lambda t: F.concat(F.lit("'"), t, F.lit("' occurs in the filing")),
    )
    problems = (
        F.when(F.col("_locked").isNull(), F.array(F.lit("no pinned filing")))
        .when(~same, F.array(F.lit("accession or CIK differs from the lock")))
        .when(F.col("answerable") & F.col("_body").isNull(), F.array(F.concat(F.lit("no section "), F.col("expected_item"))))
        .when(F.col("answerable"), missing)
        .otherwise(found)
    )
    return checked.select("id", F.explode(problems).alias("problem"))
