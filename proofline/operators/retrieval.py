"""Which filing a question is about, and the passages of that filing closest to it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from proofline import schemas as S
from proofline.session import materialize

BLOCK_ROWS = 512
MOST_BROADCAST = 64 << 20


def resolve_scope(questions: DataFrame, filings: DataFrame) -> DataFrame:
    """Questions (cik, fiscal_year or null) with the filing of their scope, or nulls when none is
    indexed. Without a year the company's latest filing is meant.

    Filings gain one extra row per company, its latest under no year, so both kinds of question
    meet their filing in the same equality join.
    """
    columns = [c for c in filings.columns if c not in ("cik", "fiscal_year")]
    row = F.struct("fiscal_year", *columns)
    latest = filings.groupBy("cik").agg(F.max_by(row, "fiscal_year").alias("_f")).select(
        "cik", F.lit(-1).alias("_year"), "_f"
    )
    every = filings.select("cik", F.col("fiscal_year").alias("_year"), row.alias("_f")).unionByName(latest)
    joined = questions.withColumn("_year", F.coalesce("fiscal_year", F.lit(-1))).join(
        every, ["cik", "_year"], "left"
    )
    return joined.select(
        *questions.columns,
        F.col("_f.fiscal_year").alias("filing_year"),
        *[F.col(f"_f.{c}").alias(c) for c in columns],
        F.col("_f").isNull().alias("out_of_scope"),
    )


def vector_blocks(
    rows: DataFrame, group: str, row_id: str, vector: str, order: str, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """(group, block, ids, orders, vectors): at most a few times ``block_rows`` rows of one group
    per row, so a group of any size becomes many rows of one size.

    Rows are dealt to blocks by hash; a group's number of blocks follows its count.
    """
    sizes = rows.groupBy(group).agg(F.ceil(F.count("*") / F.lit(block_rows)).cast("long").alias("_blocks"))
    dealt = rows.join(sizes, group).select(
        group,
        F.pmod(F.xxhash64(row_id), F.col("_blocks")).alias("block"),
        F.struct(F.col(row_id).alias("id"), F.col(order).alias("order"), F.col(vector).alias("vector")).alias("_r"),
    )
    # The join leaves rows dealt by group, which would do for the grouping too and gather a large
    # group in one task; dealing by block as well spreads it.
    return dealt.repartition(group, "block").groupBy(group, "block").agg(F.collect_list("_r").alias("rows")).select(
        group,
        "block",
        F.col("rows.id").alias("ids"),
        F.col("rows.order").alias("orders"),
        F.flatten(F.col("rows.vector")).alias("vectors"),
    )


def _unit_rows(flat: np.ndarray, rows: int) -> np.ndarray:
    matrix = flat.reshape(rows, -1).astype(np.float64)
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return matrix / np.where(norms == 0, 1.0, norms)


def _block_scores(k: int):
    """Per pair of blocks: the ``k`` best chunks of each question, ties by order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            questions, chunks, orders, scores = [], [], [], []
            columns = {name: batch.column(name) for name in batch.schema.names}
            for i in range(batch.num_rows):
                q_ids = columns["q_ids"][i].values.to_numpy(zero_copy_only=False)
                c_ids = columns["c_ids"][i].values.to_numpy(zero_copy_only=False)
                c_orders = columns["c_orders"][i].values.to_numpy(zero_copy_only=False)
                q = _unit_rows(columns["q_vectors"][i].values.to_numpy(zero_copy_only=False), len(q_ids))
                c = _unit_rows(columns["c_vectors"][i].values.to_numpy(zero_copy_only=False), len(c_ids))
                ranks = np.round(q @ c.T, 9)
                by_order = np.argsort(c_orders, kind="stable")
                best = np.argsort(-ranks[:, by_order], axis=1, kind="stable")[:, :k]
                picked = by_order[best]
                questions.append(np.repeat(q_ids, picked.shape[1]))
                chunks.append(c_ids[picked].ravel())
                orders.append(c_orders[picked].ravel())
                scores.append(np.take_along_axis(ranks, picked, axis=1).ravel())
            if questions:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate(questions)),
                        pa.array(np.concatenate(chunks)),
                        pa.array(np.concatenate(orders)),
                        pa.array(np.concatenate(scores)),
                    ],
                    names=["question_id", "chunk_id", "ordinal", "score"],
                )

    return run


def scoped_topk(
    questions: DataFrame, chunks: DataFrame, k: int = S.DEFAULT_TOP_K, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """(question_id, rank, chunk_id, ordinal, score): each question's ``k`` closest passages of its
    own filing by exact cosine, ties by ordinal.

    ``questions``: question_id, accession, vector. ``chunks``: accession, chunk_id, ordinal,
    vector. Both sides are cut into blocks; a pair of blocks is one matrix product that keeps
    ``k`` results per question. A filing asked about, or cut, a million times is many pairs spread
    over the cluster, and no table of question-passage pairs is ever formed.
    """
    q = vector_blocks(questions, "accession", "question_id", "vector", "question_id", block_rows)
    asked = questions.select("accession").distinct()
    c = vector_blocks(chunks.join(asked, "accession", "left_semi"), "accession", "chunk_id", "vector", "ordinal", block_rows)
    c_counts = c.groupBy("accession").agg(F.max("block").alias("_last"))
    # Each question block is sent to the blocks of its filing by (filing, block): a hot filing
    # spreads over its blocks instead of meeting in one task.
    sent = q.join(c_counts, "accession").select(
        "accession",
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("_last"))).alias("block"),
        F.col("ids").alias("q_ids"),
        F.col("vectors").alias("q_vectors"),
    )
    pairs = sent.join(
        c.select(
            "accession", "block", F.col("ids").alias("c_ids"), F.col("orders").alias("c_orders"), F.col("vectors").alias("c_vectors")
        ),
        ["accession", "block"],
    ).select("q_ids", "q_vectors", "c_ids", "c_orders", "c_vectors")
    return _best_of(pairs, questions, c, k)


def _best_of(pairs: DataFrame, questions: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of pairs of blocks, whose ids have the types of the questions and the blocks."""
    schema = T.StructType(
        [
            T.StructField("question_id", questions.schema["question_id"].dataType),
            T.StructField("chunk_id", blocks.schema["ids"].dataType.elementType),
            T.StructField("ordinal", blocks.schema["orders"].dataType.elementType),
            T.StructField("score", T.DoubleType()),
        ]
    )
    best = pairs.mapInArrow(_block_scores(k), schema)
    return top_k(best, k)


def passage_blocks(chunks: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Passages as the blocks that ``blocks_topk`` reads, to be stored once."""
    return vector_blocks(chunks, "accession", "chunk_id", "vector", "ordinal", block_rows)


def blocks_topk(
    questions: DataFrame, blocks: DataFrame, k: int = S.DEFAULT_TOP_K, most_bytes: int = MOST_BROADCAST
) -> DataFrame:
    """``scoped_topk`` over stored blocks (``passage_blocks``).

    Questions whose vectors take at most ``most_bytes`` go to where the blocks are read, and no block
    moves. More of them meet the blocks by (filing, block) in a shuffle; the result is the same.
    """
    q = materialize(
        vector_blocks(questions, "accession", "question_id", "vector", "question_id"), "question-blocks"
    ).select("accession", F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"))
    c = blocks.select(
        "accession", "block", F.col("ids").alias("c_ids"), F.col("orders").alias("c_orders"), F.col("vectors").alias("c_vectors")
    )
    size = q.agg(F.coalesce(F.sum(8 * (F.size("q_vectors") + F.size("q_ids"))), F.lit(0))).first()[0]
    if size <= most_bytes:
        pairs = c.join(F.broadcast(q), "accession")
    else:
        last = blocks.groupBy("accession").agg(F.max("block").alias("_last"))
        every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_last"))).alias("block")
        pairs = q.join(last, "accession").select("accession", every, "q_ids", "q_vectors").join(c, ["accession", "block"])
    return _best_of(pairs.select("q_ids", "q_vectors", "c_ids", "c_orders", "c_vectors"), questions, blocks, k)


def top_k(scored: DataFrame, k: int = S.DEFAULT_TOP_K) -> DataFrame:
    """The ``k`` best rows of each question, numbered from one. Ranks are cut before the shuffle."""
    order = Window.partitionBy("question_id").orderBy(F.desc("score"), "ordinal")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def passages_of(ranked: DataFrame, texts: DataFrame) -> DataFrame:
    """(question_id, passages, best_score): the ranked chunks with their texts, one row per
    question. ``texts``: chunk_id, item, title, text. A question has at most ``k`` passages."""
    joined = ranked.join(texts, "chunk_id")
    entry = F.struct("rank", "chunk_id", "item", "title", "text", "score")
    return joined.groupBy("question_id").agg(F.array_sort(F.collect_list(entry)).alias("_p")).select(
        "question_id",
        F.transform(
            "_p",
            lambda p: F.struct(
                p["item"].alias("item"), p["text"].alias("text"), p["title"].alias("title"),
                p["chunk_id"].alias("chunk_id"), p["score"].alias("score"),
            ),
        ).alias("passages"),
        F.round(F.coalesce(F.get("_p", F.lit(0))["score"], F.lit(0.0)), S.SCORE_DIGITS).alias("best_score"),
    )


# --- recordings ----------------------------------------------------------------------------------
def latest_recordings(recordings: DataFrame, keys: tuple[str, ...] = ("kind", "key")) -> DataFrame:
    """One row per key of a recording that was only ever appended to: the last written.

    ``position`` grows with the order of writing."""
    rest = [c for c in recordings.columns if c not in (*keys, "position")]
    return recordings.groupBy(*keys).agg(F.max_by(F.struct(*rest), "position").alias("_r")).select(
        *keys, *[F.col(f"_r.{c}").alias(c) for c in rest]
    )


def with_recorded(requests: DataFrame, recordings: DataFrame, key: Column, kind: str, field: str = "response") -> DataFrame:
    """``requests`` with the recorded response of their content key; null where none was made."""
    known = recordings.where(F.col("kind") == kind).select(F.col("key").alias("_key"), F.col(field))
    return requests.withColumn("_key", key).join(known, "_key", "left").withColumnRenamed("_key", "key")


def misses(answered: DataFrame, field: str = "response") -> DataFrame:
    """Requests a recording does not hold."""
    return answered.where(F.col(field).isNull())


def repeated_questions(cases: DataFrame) -> DataFrame:
    """Recorded questions that would name more than one case."""
    return cases.groupBy("question", "cik", "fiscal_year").agg(F.count("*").alias("cases")).where(F.col("cases") > 1)


def recorded_cases(requests: DataFrame, cases: DataFrame) -> DataFrame:
    """Requests with the id of the recorded case that asked the same of the same filing."""
    known = cases.select("question", "cik", "fiscal_year", F.col("id").alias("case_id"))
    return requests.join(known, ["question", "cik", "fiscal_year"], "left")


def rebuilt_models(recorded: DataFrame, current: DataFrame) -> DataFrame:
    """Models of the same name whose digest differs from the one that made the recording."""
    now = current.select("name", F.col("digest").alias("current_digest"))
    return recorded.join(now, "name").where(~F.col("digest").eqNullSafe(F.col("current_digest")))
