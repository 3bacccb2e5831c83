"""Conversations in reply order, linked by what messages quote.

Each message is parsed into its own text and its quoted passages with their levels. A passage is
normalised to words (case, white space and punctuation around words go) and hashed. The messages
before it are hashed for every run of as many words, from each start of a line or a sentence on, so
any contiguous part that begins at one is found, whatever its line breaks. A passage links a message
to the earliest earlier message of the conversation that has it. Links come from an equality join on
(conversation, hash) against one row per hash, so a passage quoted everywhere meets one row.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from proofline.session import materialize

QUOTE = re.compile(r"^((?:[ \t]*>)+)[ \t]?")
#: "On ..., someone wrote:" in front of a quote (fixed pattern).
INTRODUCTION = re.compile(r"^(?:on\b.*|.*\b)wrote:\s*$", re.IGNORECASE)
#: Marks around words that normalising takes away, and ends of sentences (fixed values).
MARKS, STOPS = ".,;:!?…\"'“”‘’()", (".", "!", "?", "…", ":")
#: Modulus and base of the rolling hash over words: a prime of 127 bits.
PRIME, BASE = (1 << 127) - 1, 0x1F3D5B79A2C4E6081F3D5B79A2C4E609
LAST = (1 << 63) - 1
#: Parts into which a conversation's messages are dealt when its quotes are looked for; rows in a batch.
SALTS, ROWS = 32, 1 << 16
#: Turns in a block of the running positions.
BLOCK = 1024


def levels(text: str) -> list[tuple[int, str]]:
    """(quote level, line without its marks, with its end) of each line."""
    out = []
    for line in re.split(r"(?<=\n)|(?<=\r)(?!\n)", text):
        marks = QUOTE.match(line)
        out.append((marks.group(1).count(">"), line[marks.end() :]) if marks else (0, line))
    return out


@lru_cache(maxsize=1 << 16)
def _word_hash(word: str) -> int:
    return int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=16).digest(), "little") % PRIME


def words(text: str) -> tuple[list[str], list[int]]:
    """Normalised words, and the numbers of those that begin a line or a sentence."""
    found: list[str] = []
    starts: list[int] = []
    for line in re.split(r"[\r\n]+", text):
        begins = True
        for raw in line.lower().split():
            word = raw.strip(MARKS)
            if word:
                if begins:
                    starts.append(len(found))
                found.append(word)
                begins = False
            begins = begins or raw.rstrip("\"'”’)").endswith(STOPS)
    return found, starts


def prefix_hashes(found: list[str]) -> list[int]:
    out = [0]
    for word in found:
        out.append((out[-1] * BASE + _word_hash(word) + 1) % PRIME)
    return out


def run_key(prefixes: list[int], start: int, length: int) -> bytes:
    """The hash of ``length`` words from ``start`` on."""
    return ((prefixes[start + length] - prefixes[start] * pow(BASE, length, PRIME)) % PRIME).to_bytes(16, "little")


def parsed(text: str) -> tuple[str, list[tuple[int, list[str]]]]:
    """The message without quotes, and its quoted passages as (level, words). A passage is a run of
    lines of one level without an empty line; the line that introduces a quote goes. Own lines keep
    their ends, an empty line stands where a quote was between them, and only a text with quotes
    loses white space around it: one without is returned as it is."""
    lines = levels(text)
    if not any(level for level, _ in lines):
        return text, []
    own: list[str] = []
    quoted: list[tuple[int, list[str]]] = []
    previous = 0
    for level, line in lines:
        if level:
            if previous == 0:
                while own and not own[-1].strip():
                    own.pop()
                if own and INTRODUCTION.match(own[-1].strip()):
                    own.pop()
            if not line.strip():
                quoted.append((level, []))
            elif quoted and quoted[-1][0] == level and previous == level:
                quoted[-1][1].append(line)
            else:
                quoted.append((level, [line]))
        else:
            if previous and own and line.strip():
                own.append("\n")
            own.append(line)
        previous = level
    passages = [(level, words("".join(part))[0]) for level, part in quoted]
    return "".join(own).strip(), [(level, part) for level, part in passages if part]


def _parse_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    quote_type = pa.list_(pa.struct([("level", pa.int32()), ("n_words", pa.int32()), ("passage", pa.binary())]))
    for batch in batches:
        read = [parsed(text or "") for text in batch.column("text").to_pylist()]
        own = pa.array([own for own, _ in read], pa.string())
        rows = [[{"level": n, "n_words": len(p), "passage": run_key(prefix_hashes(p), 0, len(p))} for n, p in quotes] for _, quotes in read]
        rest = [c for n, c in zip(batch.schema.names, batch.columns, strict=True) if n != "text"]
        yield pa.RecordBatch.from_arrays([*rest, own, pa.array(rows, quote_type)], [*(n for n in batch.schema.names if n != "text"), "text", "quotes"])


def _run_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """conv_id, at, passage: the runs of ``lengths`` words of each message, a bounded batch at a time."""
    names = ["conv_id", "at", "passage"]
    kinds = [pa.int64(), pa.int64(), pa.binary()]
    for batch in batches:
        rows: list[tuple] = []
        for conv_id, at, text, lengths in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "at", "text", "lengths")), strict=True):
            found, starts = words(text)
            prefixes = prefix_hashes(found)
            for start in starts:
                rows += [(conv_id, at, run_key(prefixes, start, n)) for n in lengths if start + n <= len(found)]
                if len(rows) >= ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def _origins(read: DataFrame, quotes: DataFrame) -> DataFrame:
    """conv_id, passage, origin: the earliest turn of each run that may be quoted. Conversations
    without quotes and turns after the last quote give none. The lengths asked of a conversation are
    distinct numbers up to the words of its longest quote; its messages are dealt to ``SALTS`` parts."""
    salt = F.pmod(F.xxhash64("digest", "at"), F.lit(SALTS))
    asked = quotes.groupBy("conv_id").agg(F.collect_set("n_words").alias("lengths"), F.max("at").alias("last"))
    asked = asked.select(F.col("conv_id").alias("c"), "lengths", "last", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    messages = read.select("conv_id", "at", "text", salt.alias("dealt"))
    same = messages.conv_id.eqNullSafe(asked.c) & (messages.dealt == asked.salt) & (messages["at"] < asked["last"])
    runs = messages.join(asked, same).select("conv_id", "at", "text", "lengths").mapInArrow(_run_batches, "conv_id long, at long, passage binary")
    return runs.groupBy("conv_id", "passage").agg(F.min("at").alias("origin"))


def _running(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, at, ..) with ``position`` from one in each conversation. Turns are counted
    first, and counts run inside blocks of turns and over blocks, so a conversation that holds a
    large share of all messages is ordered by many tasks."""
    block = F.floor(F.col("at") / BLOCK)
    turns = rows.groupBy("conv_id", "at").agg(F.count(F.lit(1)).alias("n")).withColumn("block", block)
    blocks = turns.groupBy("conv_id", "block").agg(F.sum("n").alias("n"))
    over_blocks = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("conv_id", "block", F.coalesce(F.sum("n").over(over_blocks), F.lit(0)).alias("of_blocks"))
    inside = Window.partitionBy("conv_id", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    before = turns.select("conv_id", "at", "block", F.coalesce(F.sum("n").over(inside), F.lit(0)).alias("of_turns"))
    joined = before.join(blocks, before.conv_id.eqNullSafe(blocks.conv_id) & (before.block == blocks.block))
    before = joined.select(before.conv_id, "at", (F.col("of_turns") + F.col("of_blocks")).alias("before"))
    among = Window.partitionBy("conv_id", "at").orderBy("digest")
    numbered = rows.withColumn("among", F.row_number().over(among))
    same = numbered.conv_id.eqNullSafe(before.conv_id) & (numbered["at"] == before["at"])
    kept = [numbered[c] for c in rows.columns]
    return numbered.join(before, same).select(*kept, (F.col("before") + F.col("among")).alias("position"))


def _previous(turns: DataFrame) -> DataFrame:
    """conv_id, at, before_it: the turn before each turn of a conversation, block by block."""
    block = F.floor(F.col("at") / BLOCK)
    turns = turns.select("conv_id", "at").distinct().withColumn("block", block)
    blocks = turns.groupBy("conv_id", "block").agg(F.max("at").alias("last"))
    over_blocks = Window.partitionBy("conv_id").orderBy("block")
    blocks = blocks.select("conv_id", "block", F.lag("last").over(over_blocks).alias("earlier"))
    inside = Window.partitionBy("conv_id", "block").orderBy("at")
    near = turns.withColumn("near", F.lag("at").over(inside))
    joined = near.join(blocks, near.conv_id.eqNullSafe(blocks.conv_id) & (near.block == blocks.block))
    return joined.select(near.conv_id, "at", F.coalesce("near", "earlier").alias("before_it"))


def _turn(column: str) -> Column:
    return F.when(F.col(column) != LAST, F.col(column))


def reply_ordered(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, reply_to, linked, n_quotes, n_linked, position: one row per row
    of ``messages`` (conv_id, turn, role, text).

    ``text`` has no quotes, and is the given text where there are none. ``reply_to`` is the latest turn that a first-level quote links to
    (``linked``), or else the turn before, null for the first. Quotes of deeper levels are counted
    in n_quotes and n_linked. A message comes after the one it answers, since links go to earlier
    turns: ``position`` numbers a conversation in that order. A null turn comes last, rows without
    a conversation are one of their own, a null text is empty, repeated rows each keep a position;
    an empty table gives no rows.
    """
    base = messages.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.coalesce(F.col("turn").cast("long"), F.lit(LAST)).alias("at"),
        F.col("role").cast("string").alias("role"),
        F.col("text").cast("string").alias("text"),
        F.sha2(F.concat_ws("|", F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))), 256).alias("digest"),
    )
    schema = "conv_id long, at long, role string, digest string, text string, quotes array<struct<level: int, n_words: int, passage: binary>>"
    read = materialize(base.select("conv_id", "at", "role", "digest", "text").mapInArrow(_parse_batches, schema), "messages")
    quotes = read.where(F.size("quotes") > 0).select("conv_id", "at", "digest", F.explode("quotes").alias("q"))
    quotes = quotes.select("conv_id", "at", "digest", "q.level", "q.n_words", "q.passage")
    origins = _origins(read, quotes)
    met = quotes.conv_id.eqNullSafe(origins.conv_id) & (quotes.passage == origins.passage) & (origins.origin < quotes["at"])
    links = (
        quotes.join(origins, met, "left")
        .select(quotes.conv_id, "at", "digest", "level", "origin")
        .groupBy("conv_id", "at", "digest")
        .agg(
            F.max(F.when(F.col("level") == 1, F.col("origin"))).alias("answered"),
            F.count(F.lit(1)).alias("all_quotes"),
            F.count("origin").alias("all_linked"),
        )
    )
    # Repeated rows share a digest, and so their quotes are counted together; the number of rows divides them.
    rows = _running(read.drop("quotes"))
    sized = read.select("conv_id", "at", "digest", F.size("quotes").cast("long").alias("n_quotes")).distinct()
    links = links.join(
        sized.withColumnsRenamed({"conv_id": "c", "at": "a", "digest": "d"}),
        links.conv_id.eqNullSafe(F.col("c")) & (links["at"] == F.col("a")) & (links.digest == F.col("d")),
    ).select(
        F.col("c"), F.col("a"), F.col("d"), "answered", "n_quotes",
        F.when(F.col("all_quotes") > 0, F.col("all_linked") * F.col("n_quotes") / F.col("all_quotes")).cast("long").alias("n_linked"),
    )
    joined = rows.join(links, rows.conv_id.eqNullSafe(links.c) & (rows["at"] == links.a) & (rows.digest == links.d), "left")
    before = _previous(read).withColumnsRenamed({"conv_id": "c2", "at": "a2"})
    joined = joined.join(before, joined.conv_id.eqNullSafe(before.c2) & (joined["at"] == before.a2))
    reply = F.coalesce("answered", "before_it")
    return joined.select(
        "conv_id",
        _turn("at").alias("turn"),
        "role",
        "text",
        reply.alias("reply_to"),
        F.col("answered").isNotNull().alias("linked"),
        F.coalesce("n_quotes", F.lit(0)).cast("long").alias("n_quotes"),
        F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
        F.col("position").cast("long").alias("position"),
    )
