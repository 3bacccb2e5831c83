"""From filing documents to an index of passages with vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from proofline import schemas as S
from proofline.functions import text as X
from proofline.operators import quality as Q
from proofline.session import spread
from proofline.sources import store as ST

Embed = Callable[[list[str]], np.ndarray]


def chunk_texts(texts: DataFrame, max_chars: int = S.WINDOW_CHARS, overlap: int = S.OVERLAP_CHARS) -> DataFrame:
    """(accession, ordinal, section_no, chunk_id, item, title, text) of filing texts.

    A document is one row until the end, so numbering its passages needs no shuffle: a passage
    counts on from the passages of earlier sections with its label.
    """
    sections = texts.withColumn("_s", X.sections_of(F.col("text")))
    cut = sections.withColumn("_w", X.windows_of(F.transform("_s", lambda s: s["text"]), max_chars, overlap))
    sized = F.zip_with("_s", "_w", lambda s, w: F.struct(s["item"].alias("item"), s["title"].alias("title"), w.alias("w"), F.size(w).alias("n")))
    placed = cut.withColumn("_p", sized)
    flat = F.flatten(
        F.transform(
            "_p",
            lambda p, i: F.transform(
                p["w"],
                lambda text, j: F.struct(
                    i.alias("section_no"),
                    F.concat(
                        p["item"],
                        F.lit("#"),
                        (
                            F.aggregate(
                                F.filter(F.slice("_p", 1, i), lambda q: q["item"] == p["item"]), F.lit(0), lambda a, q: a + q["n"]
                            )
                            + j
                        ).cast("string"),
                    ).alias("label"),
                    p["item"].alias("item"),
                    p["title"].alias("title"),
                    text.alias("text"),
                ),
            ),
        )
    )
    rows = placed.select("accession", F.posexplode(flat).alias("ordinal", "c"))
    return rows.select(
        "accession", "ordinal", "c.section_no",
        F.concat(F.col("accession").cast("string"), F.lit(":"), F.col("c.label")).alias("chunk_id"),
        "c.item", "c.title", "c.text",
    )


def indexed_texts(chunks: DataFrame) -> DataFrame:
    """(accession, text): passages of a filing in order, a blank line between them."""
    return chunks.groupBy("accession").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "text"))), lambda c: c["text"]), "\n\n"
        ).alias("text")
    )


def embedded(rows: DataFrame, embed: Embed, text: Column | None = None, lowercase: bool = False) -> DataFrame:
    """``rows`` with ``vector``. ``embed`` turns a list of at most ``EMBED_BATCH`` texts into one
    vector each; it runs inside tasks, on Arrow batches."""
    source = F.col("text") if text is None else text
    sent = F.lower(source) if lowercase else source
    batch = S.EMBED_BATCH

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def vectors(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in texts:
            values = series.tolist()
            made: list[np.ndarray] = []
            for start in range(0, len(values), batch):
                made.extend(np.asarray(embed(values[start : start + batch]), dtype=np.float32))
            yield pd.Series(made)

    return rows.withColumn("vector", vectors(sent))


def hashing_embedder(dimensions: int = 64) -> Embed:
    """Counts of hashed words: no model, for tests and for trying a job out."""
    import zlib

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dimensions), dtype=np.float32)
        for row, text in enumerate(texts):
            for word in text.split():
                out[row, zlib.crc32(word.encode()) % dimensions] += 1
        return out

    return embed


def index_filings(
    documents: DataFrame, embed: Embed, path: str, lowercase: bool = False, dimensions: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """Parse, cut, embed and write filings; returns (filings of the index, filings refused).

    ``documents``: accession, cik, form, company, filing_date, report_date, document, content.
    """
    sound, refused = Q.quarantine(Q.indexed_filings(documents))
    texts = spread(sound.select("accession", "content")).select(
        "accession", X.html_text(X.decode_document(F.col("content"))).alias("text")
    )
    chunks = embedded(chunk_texts(texts), embed, lowercase=lowercase)
    filings = sound.select("accession", "cik", "fiscal_year", "form", "company", "filing_date", "report_date")
    version = ST.write_filings(chunks, filings, path)
    written = ST.read_filings(documents.sparkSession, path, version)
    return written, refused
