"""Token counts as an exact histogram of encoded lengths.

Documents are encoded once and counted by length. Sums over all longer lengths then answer every
context limit: how many documents reach it, how many tokens there are, and how many stay when texts
are cut at it. The histogram has a row for each length that occurs, whatever the number of texts.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache, partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from proofline.session import materialize

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How the byte-level vocabulary cuts a text before merging (fixed value of the public tokenizer).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: What the pattern's ``\\s`` stands for (Unicode White_Space; ``\\s`` of Python has four controls more).
WHITE = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
#: The encoder's pattern backtracks over white space and fails on a run of a million characters. Runs
#: from this length on are cut out first, at the places where the pattern cuts them.
LONG_RUN = 1024
#: Lengths in a block of the suffix sums.
BLOCK = 1024


@lru_cache(maxsize=2)
def _encoder(ranks: bytes, pattern: str):
    import tiktoken

    merges = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in ranks.splitlines() if line)}
    return tiktoken.Encoding("corpus", pat_str=pattern, mergeable_ranks=merges, special_tokens={})


def encoded_length(text: str, ranks: bytes, pattern: str, long_run: int = LONG_RUN) -> int:
    """Number of tokens. The pattern takes a run of white space but for its last character, and that one
    too at the end of the text; such a piece is merged as a whole, without the pattern."""
    encode = _encoder(ranks, pattern).encode_ordinary
    merge = _encoder(ranks, r"(?s).+").encode_ordinary
    total = begin = 0
    for run in re.finditer(f"{WHITE}{{{max(long_run, 2)},}}", text):
        end = run.end() if run.end() == len(text) else run.end() - 1
        total += len(encode(text[begin : run.start()])) + len(merge(text[run.start() : end]))
        begin = end
    return total + len(encode(text[begin:]))


def _length_batches(batches: Iterator[pa.RecordBatch], ranks, pattern: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lengths = [encoded_length(text.as_py() or "", ranks.value, pattern) for text in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lengths, pa.int64())], ["doc_id", "length"])


def encoded_lengths(docs: DataFrame, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """doc_id, length: one row per row of ``docs``; null and empty texts have length zero, and a text may be
    as long as a value can be. The vocabulary file (about a megabyte) is read once here and sent along.
    ``pattern`` must end like ``PATTERN``, with white space but for its last character, then white space."""
    with open(vocabulary, "rb") as file:
        ranks = docs.sparkSession.sparkContext.broadcast(file.read())
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(partial(_length_batches, ranks=ranks, pattern=pattern), "doc_id long, length long")


def length_sums(lengths: DataFrame) -> DataFrame:
    """length, n_docs, n_tokens, docs_at_least, tokens_at_least, docs_through, kept_at_limit, total_docs, total_tokens: one
    row per length that occurs. kept_at_limit is the number of tokens left when every text is cut
    at this length; docs_through / total_docs is the length's quantile. Null lengths are left aside,
    repeated rows count each, an empty table gives no rows."""
    # Written once: both the blocks and the lengths inside them are read from it, and texts are encoded once.
    counted = materialize(lengths.where("length is not null").groupBy("length").agg(F.count(F.lit(1)).alias("n_docs")), "histogram")
    counted = counted.withColumn("n_tokens", F.col("length") * F.col("n_docs")).withColumn("block", F.floor(F.col("length") / BLOCK))
    blocks = counted.groupBy("block").agg(F.sum("n_docs").alias("block_docs"), F.sum("n_tokens").alias("block_tokens"))
    # A block stands for 1,024 lengths, so this order has a row per 1,024 tokens of the longest text.
    later = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    blocks = blocks.select(
        "block",
        F.coalesce(F.sum("block_docs").over(later), F.lit(0)).alias("docs_after"),
        F.coalesce(F.sum("block_tokens").over(later), F.lit(0)).alias("tokens_after"),
        F.sum("block_docs").over(whole).alias("total_docs"),
        F.sum("block_tokens").over(whole).alias("total_tokens"),
    )
    inside = Window.partitionBy("block").orderBy(F.col("length").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = counted.join(blocks, "block").select(
        "length", "n_docs", "n_tokens", "total_docs", "total_tokens",
        (F.sum("n_docs").over(inside) + F.col("docs_after")).alias("docs_at_least"),
        (F.sum("n_tokens").over(inside) + F.col("tokens_after")).alias("tokens_at_least"),
    )
    return summed.select(
        "length", "n_docs", "n_tokens", "docs_at_least", "tokens_at_least",
        (F.col("total_docs") - F.col("docs_at_least") + F.col("n_docs")).alias("docs_through"),
        (F.col("total_tokens") - F.col("tokens_at_least") + F.col("length") * F.col("docs_at_least")).alias("kept_at_limit"),
        "total_docs", "total_tokens",
    )


def at_limits(sums: DataFrame, limits: list[int]) -> DataFrame:
    """context, docs_at_least, kept_at_limit for each asked limit, from the first length that
    reaches it; a limit beyond every length keeps all tokens. One pass, whatever the number asked."""
    found = sums.agg(
        F.max("total_tokens").alias("total"),
        *[F.min_by(F.struct("docs_at_least", "tokens_at_least"), F.when(F.col("length") >= c, F.col("length"))).alias(f"at_{c}") for c in limits],
    )
    rows = F.explode(F.array(*[F.struct(F.lit(c).cast("long").alias("context"), F.col(f"at_{c}").alias("at")) for c in limits]))
    return found.where("total is not null").select("total", rows.alias("r")).select(
        "r.context",
        F.coalesce("r.at.docs_at_least", F.lit(0)).alias("docs_at_least"),
        (F.col("total") - F.coalesce("r.at.tokens_at_least", F.lit(0)) + F.col("r.context") * F.coalesce("r.at.docs_at_least", F.lit(0))).alias("kept_at_limit"),
    )


def at_quantiles(sums: DataFrame, quantiles: list[float]) -> DataFrame:
    """quantile, length: the smallest length that at least this share of the texts does not exceed."""
    found = sums.agg(*[F.min(F.when(F.col("docs_through") >= q * F.col("total_docs"), F.col("length"))).alias(f"q{i}") for i, q in enumerate(quantiles)])
    return found.select(
        F.explode(F.array(*[F.struct(F.lit(q).alias("quantile"), F.col(f"q{i}").alias("length")) for i, q in enumerate(quantiles)])).alias("r")
    ).select("r.quantile", "r.length")
