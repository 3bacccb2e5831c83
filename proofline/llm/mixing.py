"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

A document's key is an exponential variate divided by its quality weight; taking documents in the
order of their keys is a weighted sample without replacement. A source whose target holds whole
epochs takes every document that often first; the rest of the target is a prefix of the order.

Orders are cut into buckets of keys before rows move: a source that holds a third of all rows is as
many buckets as its rows ask for, totals run inside a bucket, over the buckets of a block, and over
the blocks of a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from proofline.session import materialize

#: Weights of the sources in the order of their names, repeating.
SOURCE_WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = "mix"
#: Documents a bucket holds on average, and buckets in a block.
BUCKET_ROWS, BLOCK_BUCKETS = 256, 1024
WORDS = r"[^\x20\x09-\x0D]+"


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORDS)), F.lit(0)).cast("long")


def uniform(column: str, seed: str = SEED) -> Column:
    """A number between 0 and 1 drawn from the id alone, so every run draws the same. Thirteen
    hexadecimal digits of a hash are 52 bits, which a double holds exactly."""
    digest = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col(column).cast("string"), F.lit("null"))).cast("binary"))
    drawn = F.conv(F.substring(digest, 1, 13), 16, 10).cast("long")
    return (drawn.cast("double") + 0.5) / F.lit(float(1 << 52))


def quality_weight(text: str = "text") -> Column:
    """A weight between 0.1 and 1: the share of a text's bytes that are not symbols, which is cheap
    and never zero. Empty texts weigh 0.1."""
    symbols = F.octet_length(F.col(text)) - F.octet_length(F.translate(F.col(text), "#$%&*!|@<>{}[]\\^~=+_", ""))
    share = 1 - symbols / F.greatest(F.octet_length(F.col(text)), F.lit(1))
    return F.when(F.coalesce(F.octet_length(F.col(text)), F.lit(0)) == 0, F.lit(0.1)).otherwise(F.greatest(share, F.lit(0.1)))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = SOURCE_WEIGHTS, epochs: int = MAX_EPOCHS) -> DataFrame:
    """source, n_docs, source_size, target for a table of source and size (nulls are a source).

    The total of all sizes is shared by weight, no source getting more than ``epochs`` times its
    size. With the sources in the order of size per weight, the full ones come first; the level of
    the others follows from what is left. One row per source is ordered here, never documents.
    """
    each = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("size").cast("long").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    listed = F.array(*[F.lit(float(w)) for w in weights])
    named = each.withColumn("weight", F.get(listed, ((F.row_number().over(by_name) - 1) % len(weights)).cast("int")))
    limit = F.lit(epochs) * F.col("source_size")
    by_room = Window.orderBy(limit / F.col("weight"), F.col("source").asc_nulls_last())
    before, whole = by_room.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum(limit).over(before), F.lit(0))
    open_weight = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    levels = named.withColumn("level", left / open_weight).withColumn("room", limit / F.col("weight"))
    # The first source that its share does not fill sets the level of all that follow.
    fits = levels.withColumn("level", F.min(F.when(F.col("level") <= F.col("room"), F.struct("room", "source", "level"))).over(whole)["level"])
    return fits.select(
        "source", "n_docs", "source_size", F.least(limit.cast("double"), F.col("weight") * F.coalesce("level", F.lit(0.0))).alias("target")
    )


def mix(docs: DataFrame, weights: tuple[int, ...] = SOURCE_WEIGHTS, epochs: int = MAX_EPOCHS, keep_source: bool = False) -> DataFrame:
    """doc_id, size, source_size, target, taken: one row per row of ``docs``.

    Size is the number of words (a null text has none). ``taken`` counts words, repeats included:
    every document once for each whole epoch, once more while the rest of the budget lasts, and the
    document at its end for the words that are left, so a source meets its target to the word.
    Equal keys (repeated ids) are ordered by size; a null source is a source of its own and comes
    last; an empty table gives no rows.
    """
    sized = materialize(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.col("source").cast("string").alias("source"),
            word_count().alias("size"),
            (-F.log(uniform("doc_id")) / quality_weight()).alias("key"),
        ),
        "sizes",
    )
    targets = source_targets(sized, weights, epochs)
    budget = (
        targets.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
        .withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
        .withColumn("buckets", F.ceil(F.col("n_docs") / BUCKET_ROWS))
    )
    budget = materialize(budget, "targets")
    same = sized.source.eqNullSafe(budget.source)
    # 1 - exp(-key) spreads keys over 0 to 1; where the cuts fall decides the work, not the result.
    spread = F.least(F.floor((1 - F.exp(-F.col("key"))) * F.col("buckets")), F.col("buckets") - 1)
    placed = sized.join(budget, same).select(
        sized.source, "doc_id", "size", "key", "source_size", "target", "whole", "rest", spread.cast("long").alias("bucket")
    )
    placed = placed.withColumn("block", F.floor(F.col("bucket") / BLOCK_BUCKETS))
    placed = materialize(placed, "buckets")

    def before(part: list[str], order: str, value: str) -> Column:
        window = Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum(value).over(window), F.lit(0))

    buckets = placed.groupBy("source", "block", "bucket").agg(F.sum("size").alias("sum"))
    blocks = buckets.groupBy("source", "block").agg(F.sum("sum").alias("block_sum"))
    blocks = blocks.select("source", "block", before(["source"], "block", "block_sum").alias("of_blocks"))
    buckets = buckets.select("source", "block", "bucket", before(["source", "block"], "bucket", "sum").alias("of_buckets"))
    ahead = buckets.join(blocks, buckets.source.eqNullSafe(blocks.source) & (buckets.block == blocks.block)).select(
        buckets.source, buckets.bucket, (F.col("of_buckets") + F.col("of_blocks")).alias("ahead")
    )
    inside = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    ordered = placed.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    joined = ordered.join(ahead, ordered.source.eqNullSafe(ahead.source) & (ordered.bucket == ahead.bucket))
    start = F.col("ahead") + F.col("within")
    more = F.least(F.greatest(F.round("rest") - start, F.lit(0)), F.col("size"))
    return joined.select(
        "doc_id", "size", "source_size", "target", (F.col("whole") * F.col("size") + more).cast("long").alias("taken"),
        *([ordered.source] if keep_source else []),
    )


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The documents the mix takes words of, with ``size``, ``source_size``, ``target`` and
    ``taken``. A column of ``docs`` with one of these names gives way. Rows that share id, source
    and size take the largest share of them."""
    result = ["size", "source_size", "target", "taken"]
    drawn = mix(docs.select("doc_id", "source", "text"), keep_source=True)
    drawn = drawn.groupBy("doc_id", "source", "size").agg(F.max("source_size").alias("source_size"), F.max("target").alias("target"), F.max("taken").alias("taken"))
    drawn = drawn.where("taken > 0").withColumnsRenamed({"doc_id": "_id", "source": "_source"})
    named = docs.drop(*result).withColumn("_size", word_count())
    same = named.doc_id.eqNullSafe(drawn["_id"]) & named.source.eqNullSafe(drawn["_source"]) & (named["_size"] == drawn["size"])
    return named.join(drawn, same).select(*[c for c in docs.columns if c not in result], *result)
