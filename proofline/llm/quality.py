"""Document quality by a regularised quadratic discriminant.

Statistics of a text (character classes, word shapes, repetition) are transformed to be roughly
normal. Each class has a mean and a covariance, shrunk towards the covariance of both classes and
towards a multiple of the identity. The score is the probability of the good class, from the
difference of the two log densities; Mahalanobis distances come from Cholesky factors that are
computed once and kept with the model.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofline.llm.arrays import SPACE, text_slices, word_bounds
from proofline.llm.decontamination import word_hashes
from proofline.session import materialize

#: Each statistic is a share (or a mean) with what prose usually has. A text counts as if it also
#: had ``EVIDENCE`` observations of the usual kind, so a few words are not judged by chance.
USUAL = {
    "letters": 0.96, "upper": 0.02, "marks": 0.0, "bars": 0.0, "lines": 0.03,
    "repeats": 0.0, "stops": 0.15, "loud_words": 0.0, "word_bytes": 5.5,
}
FEATURES = list(USUAL)
EVIDENCE = {"letters": 200.0, "upper": 200.0, "marks": 200.0, "bars": 50.0}
WORD_EVIDENCE = 30.0
#: Added to a share before its logarithm: differences below this do not matter.
FLOOR = 0.02
#: Statistics and their products are summed in this unit; a long holds the sums of 5e11 rows.
UNIT = 1e-6
#: Shrinkage towards the covariance of both classes, and towards the identity.
TO_POOLED, TO_IDENTITY = 0.2, 0.05
THRESHOLD = 0.7
PRIOR_GOOD = 0.5
_KIND = np.zeros(256, dtype=np.uint8)
_KIND[97:123] = _KIND[128:] = 1
_KIND[65:91] = 2
#: Digits and what addresses and phone numbers are written with say nothing about quality.
_KIND[48:58] = _KIND[[40, 41, 43, 45, 47, 58, 64, 95]] = 3
_KIND[[9, 10, 11, 12, 13, 32]] = 4
_KIND[[44, 46]] = 5
_KIND[124] = 6
_KIND[10] = 7


def _sums(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
    return (total[offsets[1:]] - total[offsets[:-1]]).astype(np.float64)


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of transformed statistics per text of a slice; an empty text has a row too."""
    size = int(offsets[-1])
    kind = _KIND[data[:size]]
    length = np.diff(offsets).astype(np.float64)
    counts = [_sums(kind == k, offsets) for k in range(8)]
    starts, ends, words = word_bounds(data, offsets, SPACE)
    row = np.repeat(np.arange(len(words)), words)
    many = words.astype(np.float64)
    hashes = word_hashes(data, starts, ends)

    def per_text(flag: np.ndarray) -> np.ndarray:
        return np.bincount(row, weights=flag, minlength=len(words))[: len(words)]

    solid = np.maximum(length - counts[3] - counts[4] - counts[7], 0)
    letters = counts[1] + counts[2]
    repeated = np.zeros(len(hashes))
    repeated[1:] = (hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])
    last_byte = data[np.maximum(ends - 1, 0)]
    upper = np.concatenate([[0], np.cumsum(kind == 2)]).astype(np.int64)
    loud = (upper[ends] - upper[starts] >= 2) & (ends - starts >= 2)
    observed = {
        "letters": (letters, solid),
        "upper": (counts[2], letters),
        "marks": (counts[0], solid),
        "bars": (counts[6], solid),
        "lines": (np.minimum(counts[7], many), many),
        "repeats": (per_text(repeated), many),
        "stops": (per_text((last_byte == 46) | (last_byte == 44)), many),
        "loud_words": (per_text(loud), many),
        "word_bytes": (solid, many),
    }
    columns = []
    for name, (part, whole) in observed.items():
        more = EVIDENCE.get(name, WORD_EVIDENCE)
        columns.append(np.log((part + more * USUAL[name]) / (whole + more) + FLOOR))
    return np.column_stack(columns)


def _statistic_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [statistics(data, offsets) for _, _, data, offsets in text_slices(batch.column("text"))]
        table = np.concatenate(found) if found else np.zeros((0, len(FEATURES)))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id")] + [pa.array(np.ascontiguousarray(table[:, i])) for i in range(len(FEATURES))], ["doc_id", *FEATURES]
        )


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of the text, one row per row of ``docs``; a null text is empty."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(_statistic_batches, "doc_id long, " + ", ".join(f"{name} double" for name in FEATURES))


@dataclass(frozen=True)
class Model:
    """Means, Cholesky factors and log determinants of the classes bad (0) and good (1)."""

    means: np.ndarray
    factors: np.ndarray
    log_dets: np.ndarray
    prior_good: float

    def scores(self, rows: np.ndarray) -> np.ndarray:
        logs = []
        for mean, factor, log_det in zip(self.means, self.factors, self.log_dets, strict=True):
            away = np.linalg.solve(factor, (rows - mean).T)
            logs.append(-0.5 * ((away**2).sum(axis=0) + log_det))
        odds = logs[1] - logs[0] + np.log(self.prior_good / (1 - self.prior_good))
        return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))


def fit(labelled: DataFrame, prior_good: float = PRIOR_GOOD) -> Model:
    """The model of rows with a column ``quality`` (0 or 1). Only two rows of sums reach the driver.

    With a class missing, both share one distribution and every score is the prior. Sums are of
    whole numbers of ``UNIT``, so the model does not depend on the order in which rows arrive.
    """
    pairs = [(a, b) for i, a in enumerate(FEATURES) for b in FEATURES[i:]]

    def total(value: Column) -> Column:
        return F.sum(F.round(value / UNIT).cast("long")) * UNIT

    sums = labelled.groupBy("quality").agg(
        F.count(F.lit(1)).alias("n"),
        *[total(F.col(a)).alias(f"s_{a}") for a in FEATURES],
        *[total(F.col(a) * F.col(b)).alias(f"p_{a}__{b}") for a, b in pairs],
    )
    size = len(FEATURES)
    found: dict[int, tuple[float, np.ndarray, np.ndarray]] = {}
    for row in sums.where("quality in (0, 1)").orderBy("quality").collect():
        mean = np.array([row[f"s_{a}"] for a in FEATURES]) / row["n"]
        second = np.zeros((size, size))
        for a, b in pairs:
            i, j = FEATURES.index(a), FEATURES.index(b)
            second[i, j] = second[j, i] = row[f"p_{a}__{b}"] / row["n"]
        found[row["quality"]] = (row["n"], mean, second - np.outer(mean, mean))
    if not found:
        found = {0: (1.0, np.zeros(size), np.eye(size))}
    total = sum(n for n, _, _ in found.values())
    pooled = sum(n * cov for n, _, cov in found.values()) / total
    means, factors, log_dets = [], [], []
    for label in (0, 1):
        _, mean, own = found.get(label) or next(iter(found.values()))
        blend = (1 - TO_POOLED) * own + TO_POOLED * pooled
        level = max(np.trace(blend) / size, 1e-6)
        shrunk = (1 - TO_IDENTITY) * blend + TO_IDENTITY * level * np.eye(size)
        factor = np.linalg.cholesky(shrunk)
        means.append(mean)
        factors.append(factor)
        log_dets.append(2 * np.log(np.diag(factor)).sum())
    return Model(np.array(means), np.array(factors), np.array(log_dets), prior_good)


def _score_batches(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = np.column_stack([batch.column(name).to_numpy(zero_copy_only=False) for name in FEATURES])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.scores(rows))], ["doc_id", "score"])


def held_out(column: str = "doc_id"):
    """Whether crc32 of the id as text leaves 2 when divided by 4; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _known(labels: DataFrame) -> DataFrame:
    """The labels that may be learnt from."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    return known.where(~held_out() & F.col("quality").isin(0, 1)).distinct()


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted: one row per row of ``docs``.

    ``labels`` has doc_id and quality (0 or 1; other values and nulls are left aside, repeated rows
    count once). Labels of held-out ids are never used. Null and empty texts have statistics and
    so a score; repeated rows get equal scores; an empty table of labels gives every text the prior.
    """
    table = materialize(document_statistics(docs), "statistics")
    model = fit(table.join(_known(labels), "doc_id"))
    scored = table.mapInArrow(partial(_score_batches, model=model), "doc_id long, score double")
    return scored.select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def _good_batches(batches: Iterator[pa.RecordBatch], model: Model, threshold: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [statistics(data, offsets) for _, _, data, offsets in text_slices(batch.column("text"))]
        if found:
            yield batch.filter(pa.array(model.scores(np.concatenate(found)) >= threshold))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that ``classify`` would not reject, all columns as they are. Rows are
    judged where they are read, so no text moves."""
    known = _known(labels)
    model = fit(document_statistics(docs).join(known, "doc_id"))
    return docs.mapInArrow(partial(_good_batches, model=model, threshold=threshold), docs.schema)
