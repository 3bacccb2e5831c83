"""Scores of texts as sums over all the ways to cut their words into pieces.

The lattice of a word holds every piece of a fixed vocabulary that occurs in it, and the word as a
whole if the corpus has it. The word's probability is the sum over all ways through the lattice,
taken by a forward recursion over its bytes in log space; a text's is the product over its words
and its end, so it is marginal over every segmentation. Each distinct word goes through the recursion once.

The vocabulary's scores weight the segmentations first. From the training words they give expected
numbers of pieces (forward and backward), which are the weights of the model: of a piece that opens
a word among those that can, of any other among the rest and the word's end. Words taken as a whole
weigh their training count less a discount, and the discounts of all words are the weight of being cut.
Single bytes are pieces too, so every text has a probability, and those of all texts sum to one.

Texts are turned into codes of dictionaries that hold for a slice of a few megabytes. The slices'
dictionaries are counted and scored as one distributed table, and every slice gets the answers for
its own codes back. So no table of all words is held anywhere, and a group never exceeds a slice.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofline.llm.arrays import LOWER, SPACE, text_slices, word_bounds
from proofline.session import materialize

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: Texts whose crc32 of the id leaves this when divided by this are not learned from.
FOLDS, HELD_OUT = 5, 1
#: Rounds of re-estimation, and the pieces the vocabulary's own weights count as in each.
ROUNDS, PRIOR_PIECES = 2, 1000.0
#: Share of single bytes among the vocabulary's own weights, and the shift of ranks in them.
BYTE_SHARE, RANK_SHIFT = 1e-3, 3.0
#: Fractions of a piece in which expected numbers are summed, so that sums do not depend on their order.
PARTS = 1024
#: Bytes of words that are recursed together; longer words go one by one.
MOST_BYTES = 256
SLICE = 12 << 20


class Pieces(NamedTuple):
    """The vocabulary as a tree of bytes: node * 256 + byte leads to a node; a node may end a piece."""

    steps: np.ndarray
    nodes: np.ndarray
    ends: np.ndarray
    #: Whether each piece opens a word; the last entry is the end of a word.
    opening: np.ndarray
    #: Natural logarithms of the weights.
    weights: np.ndarray


class Model(NamedTuple):
    """The trained pieces, and how words and ends as a whole are weighed."""

    pieces: Pieces
    total: int
    distinct: int
    discount: float

    def whole(self, words: pa.Array, c: np.ndarray) -> np.ndarray:
        """Log weight of words (an empty one is the end of a text) taken as a whole."""
        end = pc.equal(words, "").to_numpy(zero_copy_only=False)
        kept = np.where(end, c + 1.0, np.maximum(c - self.discount, 0.0))
        with np.errstate(divide="ignore"):
            return np.log(kept / (self.total + 2.0))

    @property
    def cut(self) -> float:
        """Log weight of a word cut into pieces."""
        return math.log((self.discount * self.distinct + 1.0) / (self.total + 2.0))


def read_vocabulary(spark: SparkSession, path: str = VOCABULARY) -> dict[bytes, float]:
    """Pieces that lower-cased words can hold, as bytes with a space for the sign that opens a word,
    and their shares (one in all).

    Scores that are logarithms of probabilities are taken as they are. A file whose scores are
    ranks (of merges) gives a share that falls with the rank. The file is read by Spark.
    """
    import sentencepiece

    content = spark.read.format("binaryFile").load(path).select("content").head()[0]
    model = sentencepiece.SentencePieceProcessor(model_proto=bytes(content))
    scores: dict[bytes, float] = {}
    for i in range(model.vocab_size()):
        if model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i):
            continue
        piece = model.id_to_piece(i)
        if not re.search("[A-Z]", piece) and "▁" not in piece[1:] and not re.search(r"[\x20\x09-\x0D]", piece):
            scores[piece.replace("▁", " ").encode()] = model.get_score(i)
    return shares_of(scores)


def shares_of(scores: dict[bytes, float]) -> dict[bytes, float]:
    """Shares of pieces from scores; single bytes get a small share of their own."""
    logs = any(s != int(s) for s in scores.values())
    raw = {p: math.exp(s) if logs else 1.0 / (RANK_SHIFT - s) for p, s in scores.items()}
    total = math.fsum(raw.values())
    shares = {p: (1 - BYTE_SHARE) * x / total for p, x in raw.items()} if total else {}
    for byte in range(256):
        piece = bytes([byte])
        shares[piece] = shares.get(piece, 0.0) + BYTE_SHARE / 256
    return shares


def normalised(weights: np.ndarray, opening: np.ndarray) -> np.ndarray:
    """Logarithms of weights that sum to one over the pieces that open a word, and over the others."""
    return np.log(weights / np.where(opening, math.fsum(weights[opening]), math.fsum(weights[~opening])))


def tree_of(shares: dict[bytes, float]) -> Pieces:
    """The tree of the pieces in their order; until trained a word ends after one piece in two."""
    links: dict[int, int] = {}
    ends = [-1]
    for number, piece in enumerate(shares):
        node = 0
        for byte in piece:
            step = node << 8 | byte
            if step not in links:
                links[step] = len(ends)
                ends.append(-1)
            node = links[step]
        ends[node] = number
    steps = np.array(sorted(links), dtype=np.int64)
    opening = np.array([*(p.startswith(b" ") for p in shares), False])
    weights = np.array([*shares.values(), math.fsum(x for p, x in shares.items() if not p.startswith(b" "))])
    nodes = np.array([links[int(s)] for s in steps], dtype=np.int64)
    return Pieces(steps, nodes, np.array(ends, dtype=np.int64), opening, normalised(weights, opening))


class Edges(NamedTuple):
    """Pieces in words: piece, first and last place (a word has one place more than bytes)."""

    piece: np.ndarray
    start: np.ndarray
    end: np.ndarray
    #: First place of each word; the one after its last is the next word's first.
    base: np.ndarray


def edges_of(words: pa.Array, pieces: Pieces) -> Edges:
    """Every piece in every word of a batch, each word opened by a space."""
    texts = b"".join(b" " + w.as_py().encode() for w in words)
    data = np.frombuffer(texts, dtype=np.uint8)
    sizes = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64) + 1
    stops = np.repeat(np.cumsum(sizes), sizes)
    # A place is a byte's position plus the number of words before it.
    place = np.arange(len(data)) + np.repeat(np.arange(len(sizes)), sizes)
    live, node = np.arange(len(data)), np.zeros(len(data), dtype=np.int64)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    depth = 0
    while len(live):
        step = node << 8 | data[live + depth]
        at = np.minimum(np.searchsorted(pieces.steps, step), len(pieces.steps) - 1)
        known = pieces.steps[at] == step
        live, node = live[known], pieces.nodes[at[known]]
        depth += 1
        piece = pieces.ends[node]
        whole = piece >= 0
        found.append((piece[whole], place[live[whole]], place[live[whole]] + depth))
        more = live + depth < stops[live]
        live, node = live[more], node[more]
    piece, start, end = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in range(3))
    return Edges(piece, start, end, np.append(0, np.cumsum(sizes + 1)))


def _pass(edges: Edges, weights: np.ndarray, backward: bool) -> np.ndarray:
    """Log weight of all ways from a word's first place to each place, or from each place to its last."""
    source, target = (edges.end, edges.start) if backward else (edges.start, edges.end)
    first = edges.base[:-1]
    word = np.searchsorted(edges.base, edges.start, side="right") - 1
    level = edges.base[word + 1] - 1 - target if backward else target - first[word]
    order = np.lexsort((source, target, level))
    source, target, level = source[order], target[order], level[order]
    weight = weights[edges.piece[order]]
    out = np.full(int(edges.base[-1]), -np.inf)
    out[edges.base[1:] - 1 if backward else first] = 0.0
    if len(first) == 1 and len(out) > MOST_BYTES + 2:
        return _long_pass(out, source, target, weight)
    cuts = np.flatnonzero(np.append(True, level[1:] != level[:-1])) if len(level) else np.zeros(0, np.int64)
    for begin, stop in zip(cuts, np.append(cuts[1:], len(level)), strict=True):
        places = target[begin:stop]
        new = np.flatnonzero(np.append(True, places[1:] != places[:-1]))
        out[places[new]] = np.logaddexp.reduceat(out[source[begin:stop]] + weight[begin:stop], new)
    return out


def _long_pass(out: np.ndarray, source: np.ndarray, target: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The steps of one long word, a place at a time."""
    values = out.tolist()
    for a, b, w in zip(source.tolist(), target.tolist(), weight.tolist(), strict=True):
        one, two = values[b], values[a] + w
        low, high = (one, two) if one < two else (two, one)
        values[b] = high + math.log1p(math.exp(low - high)) if low > -math.inf else high
    return np.array(values)


def word_scores(words: pa.Array, pieces: Pieces) -> np.ndarray:
    """Natural logarithm of the probability of each word, summed over all cuts into pieces."""
    edges = edges_of(words, pieces)
    return _pass(edges, pieces.weights, False)[edges.base[1:] - 1] + pieces.weights[-1]


def expected_pieces(words: pa.Array, pieces: Pieces) -> np.ndarray:
    """Expected numbers of pieces in the words and of their ends, in parts of a piece."""
    edges = edges_of(words, pieces)
    before, after = _pass(edges, pieces.weights, False), _pass(edges, pieces.weights, True)
    word = np.searchsorted(edges.base, edges.start, side="right") - 1
    total = before[edges.base[1:] - 1]
    share = np.exp(before[edges.start] + pieces.weights[edges.piece] + after[edges.end] - total[word])
    out = np.zeros(len(pieces.weights), dtype=np.int64)
    np.add.at(out, edges.piece, np.rint(share * PARTS).astype(np.int64))
    out[-1] = len(words) * PARTS
    return out


def _groups(words: pa.Array) -> Iterator[np.ndarray]:
    """Places of words to take together: short ones at once, longer ones alone."""
    sizes = pc.binary_length(words).to_numpy(zero_copy_only=False)
    short = np.flatnonzero(sizes <= MOST_BYTES)
    for part in np.array_split(short, 1 + int(sizes[short].sum()) // (1 << 20)):
        if len(part):
            yield part
    for at in np.flatnonzero(sizes > MOST_BYTES):
        yield np.array([at])


def _slice_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a slice: its texts (id, words, whether learned from), codes, and the dictionary of the codes.

    The last entry of the dictionary is the end of a text, written as an empty word.
    """
    for batch in batches:
        ids, learned = batch.column("doc_id"), batch.column("learned").to_numpy(zero_copy_only=False)
        for first, last, data, offsets in text_slices(batch.column("text"), SLICE):
            low = LOWER[data]
            starts, ends, counts = word_bounds(low, offsets, SPACE)
            places = np.append(0, np.cumsum(ends - starts)).astype(np.int32)
            kept = low[: offsets[-1]][~SPACE[low[: offsets[-1]]]]
            words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(places), pa.py_buffer(kept)).dictionary_encode()
            # The commonest words get the smallest codes, which take the fewest bits.
            codes = words.indices.to_numpy()
            order = np.argsort(-np.bincount(codes, minlength=len(words.dictionary)), kind="stable")
            codes = np.argsort(order).astype(np.int32)[codes]
            mine = learned[first:last]
            times = np.bincount(codes[np.repeat(mine, counts)], minlength=len(order))
            row = [
                ids.slice(first, last - first), pa.array(counts, pa.int64()), pa.array(codes, pa.int32()),
                pa.concat_arrays([words.dictionary.take(pa.array(order)), pa.array([""])]), pa.array(np.append(times, mine.sum()), pa.int64()),
            ]
            lists = [pa.ListArray.from_arrays(pa.array([0, len(r)], pa.int32()), r) for r in row]
            yield pa.RecordBatch.from_arrays(lists, ["ids", "counts", "codes", "tokens", "times"])


def _expected_batches(batches: Iterator[pa.RecordBatch], pieces) -> Iterator[pa.RecordBatch]:
    tree: Pieces = pieces.value
    total = np.zeros(len(tree.weights), dtype=np.int64)
    for batch in batches:
        words = batch.column("token")
        for part in _groups(words):
            total += expected_pieces(words.take(pa.array(part)), tree)
    met = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(total[met])], ["piece", "parts"])


def trained(counts: DataFrame, shares: dict[bytes, float], rounds: int = ROUNDS) -> Model:
    """The model learned from ``counts`` (token, c; the empty token is the end of a text).

    A word cut into pieces carries the discount of one, so pieces are learned from distinct words. What
    reaches the driver is one number for each piece of the vocabulary, and five counts.
    """
    spark = counts.sparkSession
    word = (F.col("c") > 0) & (F.col("token") != "")
    total, distinct, once, twice = counts.agg(
        F.coalesce(F.sum("c"), F.lit(0)), F.count_if(word), F.count_if(word & (F.col("c") == 1)), F.count_if(word & (F.col("c") == 2))
    ).head()
    pieces = tree_of(shares)
    prior = np.append(list(shares.values()), 0.0)
    words = counts.where(word).select("token")
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(pieces)
        found = words.mapInArrow(partial(_expected_batches, pieces=sent), "piece long, parts long").groupBy("piece").agg(F.sum("parts").alias("parts"))
        table = found.toArrow()
        expected = PRIOR_PIECES * prior
        expected[-1] += PRIOR_PIECES
        expected[table.column("piece").to_numpy()] += table.column("parts").to_numpy() / PARTS
        pieces = pieces._replace(weights=normalised(expected, pieces.opening))
    # The discount of the words' leaving-one-out estimate; a half where no word is met once.
    return Model(pieces, total, distinct, once / (once + 2.0 * twice) if once and twice else 0.5)


def _score_batches(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    known: Model = model.value
    for batch in batches:
        words, c = batch.column("token"), batch.column("c")
        out = known.whole(words, c.to_numpy().astype(np.float64))
        full = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0
        for part in _groups(words):
            part = part[full[part]]
            if len(part):
                out[part] = np.logaddexp(out[part], known.cut + word_scores(words.take(pa.array(part)), known.pieces))
        yield pa.RecordBatch.from_arrays([words, c, pa.array(out)], ["token", "c", "ln"])


def _document_rows(answers: pa.Table, texts: pa.Table, total: int, distinct: int) -> pa.Table:
    """The texts of one slice from the answers for its codes."""
    code, c, ln = (answers.column(n).to_numpy() for n in ("code", "c", "ln"))
    known, base, model = np.zeros(len(code)), np.zeros(len(code)), np.zeros(len(code))
    known[code], model[code] = c > 0, ln
    base[code] = np.log10((c + 0.5) / (total + 0.5 * (distinct + 1)))
    ids, counts, codes = (texts.column(n).combine_chunks().flatten() for n in ("ids", "counts", "codes"))
    counts = counts.to_numpy()
    row, at = np.repeat(np.arange(len(counts)), counts), codes.to_numpy()
    sums = [np.bincount(row, x[at], len(counts)) + x[-1] for x in (known, base, model)]
    return pa.table(
        {
            "doc_id": ids,
            "n_tokens": pa.array(counts + 1, pa.int64()),
            "n_known": pa.array(np.rint(sums[0]), pa.float64()).cast(pa.int64()),
            "train_tokens": pa.array(np.full(len(counts), total), pa.int64()),
            "base_score": sums[1],
            "score": sums[2] / math.log(10),
        }
    )


def scores(docs: DataFrame, vocabulary: str = VOCABULARY, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row per row of ``docs``.

    Learned from are the rows whose crc32 of the id (as text) does not leave 1 when divided by 5, and
    those without an id; repeated rows count each. A null text is empty and has its end only. With
    no row to learn from all counts are zero and the vocabulary's own weights remain; an empty
    table gives no rows.
    """
    spark = docs.sparkSession
    out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))
    narrow = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), (~out).alias("learned")
    )
    schema = "ids array<long>, counts array<long>, codes array<int>, tokens array<string>, times array<long>"
    slices = narrow.mapInArrow(_slice_batches, schema)
    slices = materialize(slices.withColumn("slice", F.monotonically_increasing_id()), "coded")
    entries = slices.select("slice", F.posexplode(F.arrays_zip("tokens", "times")).alias("code", "entry"))
    entries = entries.select("slice", "code", F.col("entry.tokens").alias("token"), F.col("entry.times").alias("times"))
    counts = materialize(entries.groupBy("token").agg(F.sum("times").alias("c")), "token-counts")
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0)).head()
    model = spark.sparkContext.broadcast(trained(counts, read_vocabulary(spark, vocabulary), rounds))
    scored = materialize(counts.mapInArrow(partial(_score_batches, model=model), "token string, c long, ln double"), "token-scores")
    answers = entries.select("slice", "code", "token").join(scored, "token").select("slice", "code", "c", "ln")

    def rows(left: pa.Table, right: pa.Table) -> pa.Table:
        return _document_rows(left, right, total, distinct)

    texts = slices.select(F.col("slice").alias("own"), "ids", "counts", "codes")
    found = answers.groupBy("slice").cogroup(texts.groupBy("own")).applyInArrow(
        rows, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )
    return found.select("doc_id", out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
