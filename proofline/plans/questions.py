"""Building a labelled question set: pool, quotas, selection, checks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofline import schemas as S
from proofline.functions import text as X
from proofline.operators import printed as PR
from proofline.operators import questions as Q
from proofline.operators import selection as SEL
from proofline.operators.running import running_totals
from proofline.plans import indexing as IX
from proofline.session import materialize


@dataclass(frozen=True)
class Corpus:
    """The inputs of a build; see ``operators.questions`` for their columns. ``texts``: accession,
    text."""

    companies: DataFrame
    filings: DataFrame
    facts: DataFrame
    texts: DataFrame
    concepts: DataFrame
    sector: DataFrame
    sector_phrasings: list[str]
    off_domain: DataFrame


def _enough(positives: DataFrame, companies: DataFrame, quotas: dict[str, tuple[int, int]]) -> DataFrame:
    """split, ticker, wanted, total: how many negatives of one kind ``select`` may take of a company and
    of a split: the end-to-end quota, and twice an even share of as many as there are positives."""
    kinds = len(S.NEGATIVE_KINDS)
    quota = F.create_map(*[x for split, (_, n) in quotas.items() for x in (F.lit(split), F.lit(-(-n // kinds)))])
    mine = companies.where(F.col("split").isin(list(quotas))).select("split", "ticker")
    sizes = mine.groupBy("split").agg(F.count("*").alias("_companies"))
    totals = positives.groupBy("split").agg(F.ceil(F.count("*") / kinds).alias("total"))
    joined = mine.join(sizes, "split").join(totals, "split", "left").withColumn("total", F.coalesce("total", F.lit(0)))
    return joined.select("split", "ticker", F.greatest(quota[F.col("split")].cast("long"), F.ceil(2 * F.col("total") / F.col("_companies"))).alias("wanted"), "total")


def candidate_pool(corpus: Corpus, seed: int, quotas: dict[str, tuple[int, int]] = S.E2E_QUOTAS) -> tuple[DataFrame, DataFrame]:
    """(cases, drops). Each text is parsed once into printed numbers and words, which are written,
    because five kinds of question read them; candidates are written, because cases and drops do."""
    chunks = IX.chunk_texts(corpus.texts)
    indexed = materialize(PR.printed_numbers(chunks), "printed-indexed")
    full = materialize(PR.printed_numbers(corpus.texts), "printed-full")
    words = materialize(
        corpus.texts.select("accession", X.normalize_words(F.col("text")).alias("words")), "words"
    )
    c = corpus
    positives = materialize(Q.positives(c.filings, c.facts, indexed, c.concepts), "positives")
    enough = materialize(_enough(Q.cases_of(positives, c.companies, c.concepts), c.companies, quotas), "enough")
    kinds = [
        (positives, c.concepts),
        (materialize(Q.wrong_years(c.filings, c.facts, full, c.concepts), "wrong-years"), c.concepts),
        (Q.other_companies_until(c.filings, c.companies, c.facts, full, c.concepts, enough, seed), c.concepts),
        (
            materialize(Q.unreported_concepts(c.filings, c.facts, words, c.sector), "unreported"),
            c.sector.select("key", F.array(*[F.lit(p) for p in c.sector_phrasings]).alias("phrasings")),
        ),
        (materialize(Q.off_domain(c.filings, words, c.off_domain), "off-domain"), None),
    ]
    cases = drops = None
    for candidates, phrasings in kinds:
        made = Q.cases_of(candidates, c.companies, phrasings)
        counted = Q.drops_of(candidates)
        cases = made if cases is None else cases.unionByName(made)
        drops = counted if drops is None else drops.unionByName(counted)
    return cases, drops


def select(
    pool: DataFrame, companies: DataFrame, seed: int, quotas: dict[str, tuple[int, int]] = S.E2E_QUOTAS
) -> tuple[DataFrame, DataFrame]:
    """(golden cases, shortages): every positive, as many negatives spread evenly over kinds and
    companies, and the end-to-end tier marked.

    Shortages name the company and kind whose pool is below its quota; a set with any is not to be
    used.
    """
    rows = list(quotas.items())
    split_quota = F.create_map(*[x for s, (p, n) in rows for x in (F.lit(s), F.struct(F.lit(p).alias("p"), F.lit(n).alias("n")))])
    # A company's place in its split decides which kind gets its remainder.
    placed = running_totals(
        companies.where(F.col("split").isin(list(quotas))).select("split", "ticker", F.lit(1).cast("long").alias("_one")),
        "ticker", ["_one"], ["split"],
    )
    wanted = placed.withColumn("_q", split_quota[F.col("split")])
    per_kind = wanted.select(
        "split",
        "ticker",
        F.explode(
            F.concat(
                F.array(F.struct(F.lit("positive").alias("kind"), F.col("_q.p").cast("long").alias("quota"))),
                SEL.kind_quota(F.col("_q.n"), F.col("_one_through") - 1),
            )
        ).alias("k"),
    ).select("split", "ticker", "k.kind", "k.quota")
    kinded = pool.withColumn("kind", F.coalesce("negative_kind", F.lit("positive")))
    stratum = ["split", "ticker", "kind"]
    largest = max(max(q) for q in quotas.values())
    chosen = SEL.spread_sample(kinded.join(per_kind, stratum), stratum, "quota", largest, seed)
    e2e = chosen.select("id", F.lit(True).alias("_e2e"))
    short = SEL.shortages(per_kind, kinded, stratum, distinct_groups=True)

    # Gate tier: as many negatives as positives, evenly over kinds, then over companies.
    marked = kinded.join(e2e, "id", "left").withColumn("_e2e", F.coalesce("_e2e", F.lit(False)))
    negatives = marked.where(~F.col("answerable"))
    totals = (
        marked.where("answerable").groupBy("split").agg(F.count("*").alias("n"))
        .select("split", F.explode(SEL.kind_quota(F.col("n"), F.lit(0))).alias("k"))
        .select("split", "k.kind", F.col("k.quota").alias("total"))
    )
    capacity = negatives.groupBy("split", "kind", F.col("ticker").alias("name")).agg(
        F.count("*").alias("capacity")
    ).withColumn("position", F.col("name"))
    shares = SEL.even_allocation(capacity, totals, ["split", "kind"]).select(
        "split", "kind", F.col("name").alias("ticker"), F.col("allocation").alias("quota")
    )
    return _with_gate_tier(marked, negatives, shares, seed), short


def _with_gate_tier(marked: DataFrame, negatives: DataFrame, shares: DataFrame, seed: int) -> DataFrame:
    """Positives, and the negatives picked to their company's share, the end-to-end ones first."""
    # A share is a number per company and kind; the largest bounds every rank of the sampler.
    largest = shares.agg(F.max("quota")).first()[0] or 0
    picked = SEL.spread_sample(
        negatives.join(shares, ["split", "kind", "ticker"]), ["split", "kind", "ticker"], "quota", int(largest), seed, forced="_e2e"
    )
    kept = marked.where("answerable").select("id").unionByName(picked.select("id")).distinct()
    final = marked.join(kept, "id", "left_semi")
    return final.withColumn("e2e", F.col("_e2e")).drop("_e2e", "kind")


def build(corpus: Corpus, seed: int, quotas: dict[str, tuple[int, int]] = S.E2E_QUOTAS) -> dict[str, DataFrame]:
    """The tables of a build: cases in their final order, drops, statistics and shortages."""
    pool, drops = candidate_pool(corpus, seed, quotas)
    held = materialize(pool, "question-pool")
    cases, short = select(held, corpus.companies, seed, quotas)
    return {
        "cases": cases.orderBy("split", "ticker", "id"),
        "drops": drops,
        "statistics": Q.statistics(cases),
        "facts": Q.distinct_facts(cases),
        "pool": Q.statistics(held),
        "shortages": short,
    }
