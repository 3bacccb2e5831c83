"""Writers: canonical JSON lines, recordings and report pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofline.functions.canonical import canonical_json, canonical_row
from proofline.operators import retrieval as R


def canonical_lines(rows: DataFrame, *order: str) -> DataFrame:
    """One canonical JSON text per row, in order. Two builds of the same rows give the same lines."""
    keyed = rows.select(canonical_row(rows).alias("value"), *[F.col(c).alias(f"_{i}") for i, c in enumerate(order)])
    return keyed.orderBy(*[f"_{i}" for i in range(len(order))]).select("value")


def write_json_lines(rows: DataFrame, path: str, *order: str) -> None:
    """Canonical lines as text files, sorted across the files: a range sort, no single task."""
    canonical_lines(rows, *order).write.mode("overwrite").text(path)


def write_run(cases: DataFrame, repeats: DataFrame, manifest: DataFrame, folder: str) -> None:
    """A run's tables; the manifest is written last, so a folder with one is complete."""
    write_json_lines(cases, f"{folder}/cases.jsonl", "id")
    write_json_lines(repeats, f"{folder}/determinism.jsonl", "id")
    manifest.coalesce(1).write.mode("overwrite").json(f"{folder}/manifest.json")


def append_records(records: DataFrame, path: str) -> None:
    records.write.mode("append").parquet(path)


def compact_records(records: DataFrame, path: str, *order: str) -> None:
    """Appended rows rewritten sorted, into a folder of their own."""
    records.orderBy(*order).write.mode("errorifexists").parquet(path)


def compact_recording(recordings: DataFrame, path: str) -> None:
    """A recording with one row per key, the last written, sorted by key."""
    R.latest_recordings(recordings).orderBy("kind", "key").write.mode("errorifexists").parquet(path)


def write_trimmed_facts(facts: DataFrame, path: str) -> None:
    facts.repartition("cik").sortWithinPartitions("cik", "concept", "ordinal").write.mode("overwrite").parquet(path)


def request_log_lines(log: DataFrame) -> DataFrame:
    """Requests as log lines: declared fields only, no question text, nulls kept."""
    fields = [
        "method", "path", "status", "seconds", "stages", "top_k", "accession", "abstained", "reason", "degraded",
        "retrieval_score", "gate_score", "gate_scores", "prompt_tokens", "completion_tokens",
    ]
    return log.select(canonical_json(**{f: F.col(f) for f in fields}).alias("value"))


def answer_rows(answers: DataFrame) -> DataFrame:
    """Answers as they are returned, without their trace."""
    return answers.drop("generation", "prompt", "stages", "trace", "decision", "passages", "nonce")


def markdown_table(table: DataFrame, title: str) -> str:
    """One report table as Markdown. Report tables have a row per arm, gate, kind or stage."""
    rows = table.take(1001)
    if len(rows) > 1000:
        raise ValueError(f"{title} is not a report table")
    head = "| " + " | ".join(table.columns) + " |\n|" + "---|" * len(table.columns)
    cell = lambda v: "" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)
    lines = ["| " + " | ".join(cell(v) for v in row) + " |" for row in rows]
    return "\n".join([f"## {title}", "", head, *lines])
