"""Rules a row must meet. Each adds ``violations``, the names of the rules it breaks; a row with
none is sound. ``quarantine`` splits a table by them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofline import schemas as S
from proofline.functions import text as X
from proofline.functions import vectors as V

# --- fixed values: shapes of identifiers ----------------------------------------------------------
DOCUMENT_NAME = r"^(?!.*\.\.)[A-Za-z0-9_\-][A-Za-z0-9_.\-]*$"
PAGE_NAME = r"^CIK\d{10}-submissions-\d{3}\.json$"
LOOSE_ACCESSION = r"^(\d{10})-?(\d{2})-?(\d{6})$"
ARCHIVE_URL = "https://www.sec.gov/Archives/edgar/data/%d/%s/%s"
QUESTION_CHARS = (3, 500)
FISCAL_YEARS = (1993, 2100)
TOP_K = (1, 10)


def violations(**rules: Column) -> Column:
    """Names of the rules that do not hold; a rule that cannot be decided does not hold."""
    return F.array_compact(
        F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()])
    )


def quarantine(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sound rows without ``violations``, and the others with it."""
    return (
        rows.where(F.size("violations") == 0).drop("violations"),
        rows.where(F.size("violations") > 0),
    )


def valid_cik(cik: Column) -> Column:
    return cik.between(1, S.MAX_CIK)


def dashed_accession(accession: Column) -> Column:
    """Either notation as the dashed one; null for anything else."""
    dashes = F.length(accession) - F.length(F.replace(accession, F.lit("-"), F.lit("")))
    return F.when(
        accession.rlike(LOOSE_ACCESSION) & dashes.isin(0, 2),
        F.regexp_replace(accession, LOOSE_ACCESSION, "$1-$2-$3"),
    )


def document_url(cik: Column, accession: Column, document: Column) -> Column:
    return F.format_string(ARCHIVE_URL, cik, F.replace(accession, F.lit("-"), F.lit("")), document)


def valid_document(name: Column) -> Column:
    return name.rlike(DOCUMENT_NAME)


def valid_page(name: Column, cik: Column) -> Column:
    return name.rlike(PAGE_NAME) & F.startswith(name, F.format_string("CIK%010d-", cik))


def filing_rules(filings: DataFrame) -> DataFrame:
    """Rules of a listed filing (cik, accession, document, filing_date, report_date)."""
    return filings.withColumn(
        "violations",
        violations(
            cik=valid_cik(F.col("cik")),
            accession=F.col("accession").rlike(S.ACCESSION_PATTERN),
            document=valid_document(F.col("document")),
            filing_date=F.col("filing_date").isNotNull(),
            report_date=F.col("report_date").isNotNull(),
        ),
    )


def scope_rules(scopes: DataFrame) -> DataFrame:
    year = F.col("fiscal_year")
    return scopes.withColumn(
        "violations", violations(cik=valid_cik(F.col("cik")), fiscal_year=year.isNull() | (year > 0))
    )


def request_rules(requests: DataFrame) -> DataFrame:
    """Rules of an arriving question (question, cik, fiscal_year, top_k)."""
    length = F.length(F.regexp_replace("question", r"(?U)^\s+|\s+$", ""))
    year = F.col("fiscal_year")
    return requests.withColumn(
        "violations",
        violations(
            question=length.between(*QUESTION_CHARS),
            cik=valid_cik(F.col("cik")),
            fiscal_year=year.isNull() | year.between(*FISCAL_YEARS),
            top_k=F.col("top_k").between(*TOP_K),
        ),
    )


def golden_rules(cases: DataFrame) -> DataFrame:
    """The label of a generated case must agree with its other fields."""
    yes = F.col("answerable")
    has = lambda name: F.col(name).isNotNull()
    return cases.withColumn(
        "violations",
        violations(
            id=F.length("id") > 0,
            question=F.length("question") >= 3,
            cik=F.col("cik") > 0,
            split=F.col("split").isin(*S.SPLITS),
            kind_of_answerable=~yes | ~has("negative_kind"),
            value_of_answerable=~yes | (has("expected_value") & has("unit") & has("concept")),
            period_of_answerable=~yes | (has("period_end") & has("period_year")),
            kind_of_unanswerable=yes | F.coalesce(F.col("negative_kind").isin(*S.NEGATIVE_KINDS), F.lit(False)),
            value_of_unanswerable=yes | ~has("expected_value"),
            fold_of_split=(F.col("split") == "eval") == (has("fold") & F.coalesce(F.col("fold").isin(0, 1), F.lit(False))),
            asked_company=F.coalesce(F.col("negative_kind") == "other_company", F.lit(False)) == has("asked_company"),
        ),
    )


def narrative_rules(cases: DataFrame) -> DataFrame:
    yes = F.col("answerable")
    evidence = F.coalesce(F.size("evidence_terms") > 0, F.lit(False))
    absent = F.coalesce(F.size("absent_terms") > 0, F.lit(False))
    named = F.col("expected_item").isNotNull()
    return cases.withColumn(
        "violations",
        violations(
            id=F.length("id") > 0,
            question=F.length("question") >= 3,
            evidence_of_answerable=~yes | (named & evidence),
            terms_of_unanswerable=yes | (~named & absent),
        ),
    )


def vector_rules(chunks: DataFrame, dimensions: int) -> DataFrame:
    return chunks.withColumn(
        "violations",
        violations(
            accession=F.col("accession").rlike(S.ACCESSION_PATTERN),
            dimensions=F.size("vector") == dimensions,
            finite=V.all_finite(F.col("vector")),
        ),
    )


def indexed_filings(filings: DataFrame) -> DataFrame:
    """Filings as the index knows them: the fiscal year is the year of the report date, and a
    filing without one breaks a rule."""
    dated = filings.withColumn("fiscal_year", F.year("report_date"))
    return filing_rules(dated)


def unknown_tickers(wanted: DataFrame, filings: DataFrame) -> DataFrame:
    return wanted.join(filings.select("ticker").distinct(), "ticker", "left_anti")


def cik_disagreements(roster: DataFrame, tickers: DataFrame) -> DataFrame:
    """Listed companies whose CIK is not the one the ticker map gives, or that it lacks."""
    mapped = tickers.select("ticker", F.col("cik").alias("mapped_cik"))
    return roster.join(mapped, "ticker", "left").where(~F.col("cik").eqNullSafe(F.col("mapped_cik")))


def changed_bytes(pinned: DataFrame, fetched: DataFrame) -> DataFrame:
    """Filings whose document is not the one pinned before."""
    now = fetched.select("accession", F.col("document_sha256").alias("fetched_sha256"))
    return pinned.join(now, "accession").where(F.col("document_sha256") != F.col("fetched_sha256"))


def text_mismatches(texts: DataFrame, pinned: DataFrame) -> DataFrame:
    """Stored texts (accession, text) that are not what the lock recorded."""
    hashed = texts.select("accession", F.sha2("text", 256).alias("found_sha256"))
    return pinned.select("accession", "text_sha256").join(hashed, "accession", "left").where(
        ~F.col("text_sha256").eqNullSafe(F.col("found_sha256"))
    )


def pin_mismatches(files: DataFrame, pins: DataFrame) -> DataFrame:
    """Input files (path, content) whose SHA-256 is not the pinned one."""
    hashed = files.select("path", F.sha2("content", 256).alias("found_sha256"))
    return pins.join(hashed, "path", "left").where(~F.col("sha256").eqNullSafe(F.col("found_sha256")))


def differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of one build that the other lacks, with the side they are on."""
    columns = left.columns
    return (
        left.select(columns).exceptAll(right.select(columns)).withColumn("side", F.lit("left"))
        .unionByName(right.select(columns).exceptAll(left.select(columns)).withColumn("side", F.lit("right")))
    )


def unsupported_numbers(page: DataFrame, sources: DataFrame) -> DataFrame:
    """(page_id, line, number): numbers of a page (page_id, text) that no source (text) prints."""
    known = sources.select(F.explode(X.prose_numbers(F.col("text"))).alias("number")).distinct()
    lines = page.select("page_id", F.explode(X.prose_lines(F.col("text"))).alias("l"))
    stated = lines.select("page_id", "l.line", F.explode(X.prose_numbers(F.col("l.text"))).alias("number"))
    return stated.join(known, "number", "left_anti").select("page_id", "line", "number")
