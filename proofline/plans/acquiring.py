"""Pinning a roster from documents that are already landed: facts, listings and filings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofline import schemas as S
from proofline.functions import text as X
from proofline.operators import facts as FA
from proofline.operators import pinning as PIN
from proofline.operators import quality as Q
from proofline.session import materialize, spread
from proofline.sources import readers as RD


def acquire(
    roster: DataFrame,
    years: list[int],
    facts_documents: DataFrame,
    listings: DataFrame,
    older_pages: DataFrame,
    documents: DataFrame,
    tags: DataFrame,
) -> dict[str, DataFrame]:
    """The tables of a lock.

    roster: ticker, cik, name, split, position, reserve. facts_documents and listings: cik, text.
    older_pages: cik, name, text. documents: accession, content. tags: concept.
    """
    facts, refused_facts = RD.parse_company_facts(facts_documents)
    facts = materialize(facts, "facts")
    recent, pages, refused_listings = RD.parse_submissions(listings)
    older, refused_pages = RD.parse_submission_pages(older_pages)
    labels = FA.fiscal_labels(facts)
    # A filing the recent listing lacks is looked for on the pages nearest to its filing date.
    filed = labels.join(FA.first_filed(facts), "accession").select("cik", "accession", F.col("first_filed").alias("filed"))
    missing = filed.join(recent.select("accession"), "accession", "left_anti")
    placed = FA.nearest_listing(missing, pages, older.select("cik", "name", "accession"))
    found = older.join(placed.select("cik", "name", "accession"), ["cik", "name", "accession"], "left_semi")
    listed = recent.unionByName(found.drop("name"))

    wanted = roster.select("ticker", "cik", F.explode(F.array(*[F.lit(y) for y in years])).alias("fiscal_year"))
    pinned = materialize(PIN.pin_filings(wanted, FA.filings_per_year(labels), listed), "pinned")
    eligible = PIN.eligibility(pinned)
    excluded = PIN.fill_from_reserves(roster, eligible)
    # Listed companies that are eligible, and the reserves that took a place with its split.
    members = (
        roster.where(~F.col("reserve")).join(eligible.where("eligible"), "ticker", "left_semi").select("ticker", "cik", "name", "split")
        .unionByName(
            excluded.where(F.col("replaced_by").isNotNull()).select(F.col("replaced_by").alias("ticker"), "split")
            .join(roster.select("ticker", "cik", "name"), "ticker").select("ticker", "cik", "name", "split")
        )
    )
    texts = spread(documents).select(
        "accession",
        F.sha2("content", 256).alias("document_sha256"),
        F.length("content").cast("long").alias("document_bytes"),
        X.html_text(X.decode_document(F.col("content"))).alias("text"),
    )
    texts = materialize(texts, "texts")
    hashes = texts.select(
        "accession", "document_sha256", "document_bytes", F.sha2("text", 256).alias("text_sha256"),
        F.length("text").cast("long").alias("text_chars"),
    )
    filings = (
        pinned.where(F.col("accession").isNotNull()).join(members.select("ticker"), "ticker", "left_semi")
        .select("ticker", "cik", "fiscal_year", "accession")
        .join(listed.select("accession", "form", "filing_date", "report_date", F.col("document").alias("primary_document")), "accession")
        .join(hashes, "accession", "left")
        .withColumn("url", Q.document_url(F.col("cik"), F.col("accession"), F.col("primary_document")))
    )
    return {
        "companies": members,
        "filings": filings.select(*[c.split(" ")[0] for c in S.FILING_LOCK.split(", ")]),
        "excluded": excluded,
        "facts": FA.trimmed(facts, tags).join(members.select("cik"), "cik", "left_semi"),
        "concepts": FA.reported_concepts(facts).join(members.select("cik"), "cik", "left_semi"),
        "texts": texts.select("accession", "text"),
        "refused_facts": refused_facts,
        "refused_listings": refused_listings,
        "refused_pages": refused_pages,
    }


def changed_since(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Pinned filings whose bytes differ from the lock before; a lock with any is not written."""
    return Q.changed_bytes(previous, current)
