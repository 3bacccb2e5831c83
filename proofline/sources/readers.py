"""Readers with declared schemas. What does not fit is returned beside what does, never dropped.

Parsers take a table of raw texts (one document per row), so they work the same on files, on a
landed table, or on a stream.
"""

from __future__ import annotations

import tomllib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from proofline import schemas as S
from proofline.functions import text as X
from proofline.functions import vectors as V
from proofline.operators import quality as Q

DDL = str


# --- documents -----------------------------------------------------------------------------------
def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, content, html) of filing documents: UTF-8, else Windows-1252."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", "content", X.decode_document(F.col("content")).alias("html"))


def read_whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): one row per file; gzip is read as it is."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")
    )


# --- company facts -------------------------------------------------------------------------------
def _raw_values(document: Column) -> Column:
    """Every ``"val":`` of a document as it is written, to tell numbers from quoted ones."""
    return F.regexp_extract_all(document, F.lit(r'"val"\s*:\s*("(?:[^"\\]|\\.)*"|[^,}\]\s]+)'), F.lit(1))


def parse_company_facts(documents: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(facts, quarantined). A document is refused as a whole when it is not JSON, lacks a field,
    or states a value that is not a number; values stay exact decimals.

    ``ordinal`` is a fact's place in its document, the order in which the first match counts.
    """
    number = r"^-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?$"
    parsed = documents.withColumn("_doc", F.from_json(text, S.COMPANY_FACTS, {"mode": "PERMISSIVE"})).withColumn(
        "_numbers", F.forall(_raw_values(F.col(text)), lambda v: v.rlike(number))
    )
    flat = F.flatten(
        F.transform(
            F.map_entries("_doc.facts"),
            lambda t: F.flatten(
                F.transform(
                    F.map_entries(t["value"]),
                    lambda c: F.flatten(
                        F.transform(
                            F.map_entries(c["value"]["units"]),
                            lambda u: F.transform(
                                u["value"],
                                lambda f: F.struct(
                                    t["key"].alias("taxonomy"), c["key"].alias("concept"), u["key"].alias("unit"),
                                    f["val"].alias("value"), f["start"].alias("start"), f["end"].alias("end"),
                                    f["fy"].alias("fiscal_year"), f["fp"].alias("fiscal_period"), f["form"].alias("form"),
                                    f["accn"].alias("accession"), f["filed"].alias("filed"),
                                ),
                            ),
                        )
                    ),
                )
            ),
        )
    )
    listed = parsed.withColumn("_facts", F.coalesce(flat, F.array()))
    checked = listed.withColumn(
        "violations",
        Q.violations(
            shape=F.col("_doc.cik").isNotNull() & F.col("_doc.entityName").isNotNull(),
            numbers=F.col("_numbers"),
            fields=F.forall(
                "_facts",
                lambda f: f["value"].isNotNull() & f["end"].isNotNull() & f["form"].isNotNull()
                & f["accession"].isNotNull() & f["filed"].isNotNull(),
            ),
        ),
    )
    sound, bad = Q.quarantine(checked)
    facts = sound.select(
        F.col("_doc.cik").alias("cik"), F.col("_doc.entityName").alias("entity_name"), F.posexplode("_facts").alias("ordinal", "_f")
    ).select("cik", "entity_name", "ordinal", "_f.*")
    return facts, bad.select(*documents.columns, "violations")


# --- submissions ---------------------------------------------------------------------------------
def _listed(rows: Column) -> Column:
    """Five parallel arrays as one array of filings."""
    return F.transform(
        F.arrays_zip(
            rows["form"].alias("form"), rows["accessionNumber"].alias("accession"), rows["primaryDocument"].alias("document"),
            rows["filingDate"].alias("filing_date"), rows["reportDate"].alias("report_date"),
        ),
        lambda r: F.struct(
            r["form"].alias("form"),
            Q.dashed_accession(r["accession"]).alias("accession"),
            r["document"].alias("document"),
            r["filing_date"].try_cast("date").alias("filing_date"),
            F.nullif(r["report_date"], F.lit("")).try_cast("date").alias("report_date"),
        ),
    )


def _same_length(rows: Column) -> Column:
    first = F.size(rows["form"])
    others = ("accessionNumber", "primaryDocument", "filingDate", "reportDate")
    same = F.lit(True)
    for name in others:
        same = same & (F.size(rows[name]) == first)
    return same


def _is_date(text: Column) -> Column:
    return F.coalesce(text.try_cast("date").isNotNull(), F.lit(False))


def _dated(rows: Column) -> Column:
    """Whether every filing has a date that can be read; only a report date may be empty."""
    filed = F.forall(rows["filingDate"], _is_date)
    reported = F.forall(rows["reportDate"], lambda d: (F.coalesce(d, F.lit("")) == "") | _is_date(d))
    return F.coalesce(filed & reported, F.lit(False))


def parse_submissions(documents: DataFrame, cik: str = "cik", text: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(filings, older pages, quarantined) of companies' listings. ``position`` is a filing's place
    in its listing, newest first. A listing with a date that cannot be read is refused."""
    parsed = documents.withColumn("_doc", F.from_json(text, S.SUBMISSIONS)).withColumn("_rows", F.col("_doc.filings.recent"))
    checked = parsed.withColumn(
        "violations",
        Q.violations(
            shape=F.col("_rows").isNotNull(),
            lengths=_same_length(F.col("_rows")),
            dates=F.col("_rows").isNull()
            | _dated(F.col("_rows"))
            & F.coalesce(F.forall("_doc.filings.files", lambda p: _is_date(p["filingFrom"]) & _is_date(p["filingTo"])), F.lit(True)),
        ),
    )
    sound, bad = Q.quarantine(checked)
    filings = sound.select(F.col(cik).alias("cik"), F.posexplode(_listed(F.col("_rows"))).alias("position", "_f")).select(
        "cik", "position", "_f.*"
    )
    pages = sound.select(F.col(cik).alias("cik"), F.explode("_doc.filings.files").alias("_p")).select(
        "cik", "_p.name", F.col("_p.filingFrom").try_cast("date").alias("first_date"), F.col("_p.filingTo").try_cast("date").alias("last_date")
    )
    return filings, pages, bad.select(*documents.columns, "violations")


def parse_submission_pages(documents: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(filings, quarantined) of older pages: cik, name, text."""
    parsed = documents.withColumn("_rows", F.from_json(text, S.SUBMISSIONS_PAGE))
    checked = parsed.withColumn("violations", Q.violations(lengths=_same_length(F.col("_rows")), dates=_dated(F.col("_rows"))))
    sound, bad = Q.quarantine(checked)
    filings = sound.select("cik", "name", F.posexplode(_listed(F.col("_rows"))).alias("position", "_f")).select(
        "cik", "name", "position", "_f.*"
    )
    return filings, bad.select(*documents.columns, "violations")


def all_listed(recent: DataFrame, older: DataFrame) -> DataFrame:
    """The recent listing and the older pages as one table; ``name`` is null for recent rows."""
    return recent.withColumn("name", F.lit(None).cast("string")).unionByName(older)


def of_form(filings: DataFrame, form: str) -> DataFrame:
    return filings.where(F.col("form") == form)


def filing_with(filings: DataFrame, accession: Column) -> DataFrame:
    """The filing an accession names, in either notation."""
    return filings.where(F.col("accession") == Q.dashed_accession(accession))


def latest_of_form(filings: DataFrame, form: str = S.ANNUAL_FORM) -> DataFrame:
    """The newest filing of a form per company, the first listed where two share a date."""
    rest = [c for c in filings.columns if c != "cik"]
    return of_form(filings, form).groupBy("cik").agg(
        F.max_by(F.struct(*rest), F.struct(F.col("filing_date"), -F.col("position"))).alias("_f")
    ).select("cik", "_f.*")


# --- small inputs --------------------------------------------------------------------------------
def parse_tickers(documents: DataFrame, text: str = "text") -> DataFrame:
    """(ticker, cik, title) of a ticker map keyed by row number."""
    entries = documents.select(F.explode(F.map_values(F.from_json(text, S.TICKERS))).alias("_t"))
    return entries.select("_t.ticker", F.col("_t.cik_str").alias("cik"), "_t.title")


def read_roster(spark: SparkSession, toml: str) -> tuple[DataFrame, dict]:
    """(companies, settings) of a roster file, which people write by hand.

    companies: ticker, cik, name, split (null for a reserve), position, reserve. Repeated tickers
    and unknown splits are refused.
    """
    told = tomllib.loads(toml)
    rows, seen = [], set()
    for reserve, part in ((False, "companies"), (True, "reserves")):
        for position, entry in enumerate(told.get(part, [])):
            if entry["ticker"] in seen:
                raise ValueError(f"{entry['ticker']} is listed twice")
            seen.add(entry["ticker"])
            if not reserve and entry.get("split") not in S.SPLITS:
                raise ValueError(f"{entry['ticker']} has no known split")
            rows.append((entry["ticker"], entry["cik"], entry["name"], entry.get("split"), position, reserve))
    companies = spark.createDataFrame(
        rows, "ticker STRING, cik BIGINT, name STRING, split STRING, position INT, reserve BOOLEAN"
    )
    return companies, {k: v for k, v in told.items() if k not in ("companies", "reserves")}


# --- cases and runs ------------------------------------------------------------------------------
def read_json_lines(spark: SparkSession, path: str, schema: DDL, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows, bad lines) of JSON lines under a declared schema. ``strict`` stops at a bad line."""
    lines = spark.read.text(path).where(F.length(F.btrim("value")) > 0)
    options = {"mode": "FAILFAST" if strict else "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    read = F.from_json("value", f"{schema}, _bad STRING", options)
    located = lines.select("value", F.col("_metadata.file_path").alias("file"), read.alias("_r"))
    return (
        located.where(F.col("_r._bad").isNull()).select("_r.*").drop("_bad"),
        located.where(F.col("_r._bad").isNotNull()).select("file", F.col("value").alias("line")),
    )


def read_golden(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(cases, lines or cases refused, repeated ids). A line that is not JSON of the declared
    fields is refused with the rule ``line``."""
    rows, lines = read_json_lines(spark, path, S.GOLDEN_CASE)
    sound, bad = Q.quarantine(Q.golden_rules(rows))
    unread = lines.select(F.col("line"), F.array(F.lit("line")).alias("violations"))
    bad = bad.unionByName(unread, allowMissingColumns=True)
    return sound, bad, rows.groupBy("id").agg(F.count("*").alias("rows")).where(F.col("rows") > 1)


def read_run(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(case records, repeats, manifest, lines refused) of a run's folder. A broken line is no case,
    so a run that lost one does not pass as complete."""
    cases, bad = read_json_lines(spark, f"{folder}/cases.jsonl", S.CASE_RECORD)
    repeats, more = read_json_lines(spark, f"{folder}/determinism.jsonl", S.REPEAT_RECORD)
    manifest = spark.read.schema(S.RUN_MANIFEST).option("multiLine", True).json(f"{folder}/manifest.json")
    return cases, repeats, manifest, bad.union(more)


def incomplete_run(cases: DataFrame, manifest: DataFrame) -> DataFrame:
    """The manifest row when it names another number of cases than there are."""
    found = cases.agg(F.count("*").alias("found"))
    return manifest.crossJoin(F.broadcast(found)).where(F.col("cases") != F.col("found"))


def read_recording(spark: SparkSession, path: str, kind: str) -> tuple[DataFrame, DataFrame]:
    """(calls, lines refused): kind, key, request, response, position of recorded model calls, and
    the lines without a key. Requests and responses stay JSON texts; ``position`` follows the file,
    so the last row of a key can win."""
    lines = spark.read.text(path).select(
        "value",
        F.struct(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("row"),
        ).alias("position"),
    )
    fields = "key STRING, request STRING, response STRING"
    rows = lines.where(F.length(F.btrim("value")) > 0).withColumn("_r", F.from_json("value", fields))
    keyed = F.col("_r.key").isNotNull()
    calls = rows.where(keyed).select(F.lit(kind).alias("kind"), "_r.*", "position")
    return calls, rows.where(~keyed).select(F.col("position.file").alias("file"), F.col("value").alias("line"))


def generations(recording: DataFrame) -> DataFrame:
    """(prompt, text) of recorded generations."""
    return recording.select(
        F.get_json_object("request", "$.prompt").alias("prompt"), F.get_json_object("response", "$.text").alias("text")
    )


def recorded_vectors(recording: DataFrame) -> DataFrame:
    """(key, vector) of recorded embeddings."""
    return recording.select("key", V.decode_vector(F.get_json_object("response", "$.vector")).alias("vector"))


def read_request_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(S.REQUEST_LOG).json(path)


def stream_request_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(S.REQUEST_LOG).json(path)


def pinned_filings(lock: DataFrame, companies: DataFrame, split: str | None = None, tickers: DataFrame | None = None) -> DataFrame:
    """Pinned filings of a split and a list of tickers."""
    filings = lock.join(companies.select("ticker", "split"), "ticker")
    if split is not None:
        filings = filings.where(F.col("split") == split)
    return filings if tickers is None else filings.join(tickers, "ticker", "left_semi")
