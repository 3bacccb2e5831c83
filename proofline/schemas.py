"""Fixed values and declared schemas. Nothing here is inferred from data."""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values: sizes, limits and closed sets that decide results ---------------------------
DEFAULT_TOP_K = 4
WINDOW_CHARS = 1200
OVERLAP_CHARS = 150
MIN_SECTION_CHARS = 200
YEARS_REPORTED = 3
ANNUAL_MIN_DAYS = 350
ANNUAL_MAX_DAYS = 380
PERIOD_END_TOLERANCE_DAYS = 7
NEAREST_PAGE_DAYS = 7
RELATIVE_TOLERANCE = "0.005"
MAX_UNCITED_CONTENT_WORDS = 8
MAX_MARKER_DIGITS = 6
MIN_DIGITS_TO_RESCALE = 3
QUOTE_CHARS = 400
STRICT_BARE_DIGITS = 4
STRICT_SCALED_DIGITS = 3
LOOSE_DIGITS = 2
COVERED_YEARS_BACK = (0, 1)
WRONG_YEARS_BACK = (4, 5, 6, 7)
TARGET_RECALL = 0.90
CONFIDENCE = 0.95
RESAMPLES = 5000
MAX_UNDEFINED_SHARE = 0.01
REPORT_SEED = 20261001
TARGET_POWER = 0.80
CONFIRMATORY_CONFIDENCE = 0.99
H1_MARGIN = 0.05
RECALL_COST_CEILING = 0.12
NET_CHANGE_LIMIT = 3
DEFAULT_COSINE_THRESHOLD = 0.7329
MAX_SECTION_SHARE = 0.5
MIN_SECTIONS = 2
EMBED_BATCH = 32
SCORE_DIGITS = 4
FULL_FILING = "Full filing"
TAXONOMY = "us-gaap"
ANNUAL_FORM = "10-K"
PER_SHARE_UNIT = "USD/shares"
COVERAGE_POINTS = (0.25, 0.5, 0.75, 1.0)

NEGATIVE_KINDS = ("wrong_year", "other_company", "unreported_concept", "off_domain")
SPLITS = ("dev", "eval")
E2E_QUOTAS = {"dev": (25, 25), "eval": (9, 15)}
TEXT_OUTCOMES = ("answered", "no_valid_citation", "unsupported_claim")
WITHHELD_OUTCOMES = ("no_valid_citation", "unsupported_claim")
ABSTENTION_MESSAGES = {
    "gate_rejected": (
        "No passage in this filing is close enough to the question, so the model was not asked."
    ),
    "out_of_period": (
        "The question asks about a period this filing does not cover, "
        "so the model was not asked."
    ),
    "model_declined": "The model read the closest passages and found no answer in them.",
    "no_valid_citation": (
        "A sentence of the answer cites no retrieved passage, "
        "so it could not be checked and the answer is withheld."
    ),
    "unsupported_claim": (
        "The answer makes a claim its cited passage does not support, so it is withheld."
    ),
    "out_of_scope": (
        "No indexed filing matches the requested company and fiscal year, "
        "so the model was not asked."
    ),
}

# --- patterns that decide validity -------------------------------------------------------------
ACCESSION_PATTERN = r"^\d{10}-\d{2}-\d{6}$"
MAX_CIK = 9_999_999_999

# --- types (DDL strings where a reader takes them) -------------------------------------------------------------------------------------
MONEY = T.DecimalType(38, 9)
TICKS = T.DecimalType(38, 0)

AMOUNT = T.StructType(
    [
        T.StructField("nano", TICKS),
        T.StructField("step", TICKS),
        T.StructField("text", T.StringType()),
        T.StructField("is_percent", T.BooleanType()),
        T.StructField("is_readable", T.BooleanType()),
    ]
)

COMPANY_FACTS = (
    "cik BIGINT, entityName STRING, facts MAP<STRING, MAP<STRING, STRUCT<units: MAP<STRING, "
    "ARRAY<STRUCT<start: DATE, `end`: DATE, val: DECIMAL(38,9), accn: STRING, fy: INT, fp: STRING, "
    "form: STRING, filed: DATE>>>>>>"
)
SUBMISSIONS = (
    "cik STRING, name STRING, filings STRUCT<recent: STRUCT<form: ARRAY<STRING>, "
    "accessionNumber: ARRAY<STRING>, primaryDocument: ARRAY<STRING>, filingDate: ARRAY<STRING>, "
    "reportDate: ARRAY<STRING>>, files: ARRAY<STRUCT<name: STRING, filingFrom: STRING, filingTo: STRING>>>"
)
SUBMISSIONS_PAGE = (
    "form ARRAY<STRING>, accessionNumber ARRAY<STRING>, primaryDocument ARRAY<STRING>, "
    "filingDate ARRAY<STRING>, reportDate ARRAY<STRING>"
)
TICKERS = "MAP<STRING, STRUCT<cik_str: BIGINT, ticker: STRING, title: STRING>>"
GOLDEN_CASE = (
    "id STRING, split STRING, fold INT, e2e BOOLEAN, ticker STRING, cik BIGINT, fiscal_year INT, "
    "accession STRING, question STRING, template STRING, answerable BOOLEAN, negative_kind STRING, "
    "concept STRING, period_year INT, period_end DATE, expected_value DECIMAL(38,9), unit STRING, "
    "tolerance DECIMAL(10,6), asked_company STRING"
)
NARRATIVE_CASE = (
    "id STRING, ticker STRING, cik BIGINT, fiscal_year INT, accession STRING, question STRING, "
    "answerable BOOLEAN, expected_item STRING, evidence_terms ARRAY<STRING>, absent_terms ARRAY<STRING>"
)
CASE_RECORD = (
    "id STRING, kind STRING, split STRING, fold INT, ticker STRING, cik BIGINT, fiscal_year INT, "
    "answerable BOOLEAN, negative_kind STRING, e2e BOOLEAN, scores MAP<STRING, DOUBLE>, "
    "degraded BOOLEAN, retrieval_score DOUBLE, retrieved ARRAY<STRING>, generated BOOLEAN, "
    "outcome STRING, generation STRING, numeric_correct BOOLEAN, citation_supported BOOLEAN, "
    "gold_retrieved BOOLEAN, cited_items ARRAY<STRING>, expected_item STRING, item_split_sane BOOLEAN, "
    "stages MAP<STRING, DOUBLE>, prompt_tokens BIGINT, completion_tokens BIGINT, generator_seconds DOUBLE"
)
REPEAT_RECORD = (
    "id STRING, identical BOOLEAN, first_seconds DOUBLE, second_seconds DOUBLE"
)
RUN_MANIFEST = (
    "split STRING, tier STRING, mode STRING, cases BIGINT, wall_seconds DOUBLE, golden_sha256 STRING, "
    "index_digest STRING, top_k INT, date STRING"
)
REQUEST_LOG = (
    "event_id BIGINT, ts TIMESTAMP, method STRING, path STRING, status INT, seconds DOUBLE, "
    "stages MAP<STRING, DOUBLE>, top_k INT, accession STRING, abstained BOOLEAN, reason STRING, "
    "degraded BOOLEAN, retrieval_score DOUBLE, gate_score DOUBLE, gate_scores MAP<STRING, DOUBLE>, "
    "prompt_tokens BIGINT, completion_tokens BIGINT"
)
FILING_LOCK = (
    "ticker STRING, cik BIGINT, fiscal_year INT, accession STRING, form STRING, filing_date DATE, "
    "report_date DATE, primary_document STRING, url STRING, document_sha256 STRING, "
    "document_bytes BIGINT, text_sha256 STRING, text_chars BIGINT"
)
