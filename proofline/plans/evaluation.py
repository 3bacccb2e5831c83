"""Asking a set of questions, reporting a run, checking it against a baseline, judging it again."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofline import schemas as S
from proofline.functions import text as X
from proofline.functions.canonical import content_key
from proofline.operators import answering as AN
from proofline.operators import arms as A
from proofline.operators import gates as G
from proofline.operators import index as IX
from proofline.operators import ranking as RK
from proofline.operators import regression as RG
from proofline.operators import replay as RP
from proofline.operators import retrieval as R
from proofline.operators import selection as SEL
from proofline.session import materialize
from proofline.sources import writers as W

Generate = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Index:
    """filings: cik, fiscal_year, accession, ... ; chunks: accession, ordinal, chunk_id, item,
    title, text, vector."""

    filings: DataFrame
    chunks: DataFrame


def recorded_generator(recordings: DataFrame, model: str, options: str = "{}") -> Generate:
    """A generator that answers from a recording: prompts in, (text, tokens, seconds) out."""

    def generate(prompts: DataFrame) -> DataFrame:
        key = content_key(kind=F.lit("generate"), model=F.lit(model), options=F.lit(options), prompt=F.col("prompt"))
        found = R.with_recorded(prompts, recordings, key, "generate")
        reply = lambda f: F.get_json_object("response", f"$.{f}")
        return found.select(
            *prompts.columns,
            reply("text").alias("text"),
            reply("prompt_tokens").cast("long").alias("prompt_tokens"),
            reply("completion_tokens").cast("long").alias("completion_tokens"),
            reply("seconds").cast("double").alias("generator_seconds"),
            F.col("response").isNull().alias("not_recorded"),
        )

    return generate


def recorded_vectors(questions: DataFrame, vectors: DataFrame, model: str, lowercase: bool) -> DataFrame:
    """Questions with the vector recorded for their text. ``vectors``: key, vector."""
    sent = F.lower("question") if lowercase else F.col("question")
    key = content_key(kind=F.lit("embed"), model=F.lit(model), lowercase=F.lit(lowercase), input=sent)
    return questions.withColumn("_key", key).join(vectors.withColumnRenamed("key", "_key"), "_key", "left").drop("_key")


def gated(
    questions: DataFrame,
    index: Index,
    gate: Callable[[Column, Column, Column], Column],
    k: int = S.DEFAULT_TOP_K,
) -> DataFrame:
    """Questions (id, question, cik, fiscal_year, vector) with filing, passages and decision.

    What lies outside the index never reaches the search."""
    scoped = R.resolve_scope(questions, index.filings.select("cik", "fiscal_year", "accession"))
    inside = scoped.where(~F.col("out_of_scope")).select(F.col("id").alias("question_id"), "accession", "vector")
    top = R.scoped_topk(inside, index.chunks.select("accession", "chunk_id", "ordinal", "vector"), k)
    passages = R.passages_of(top, index.chunks.select("chunk_id", "item", "title", "text"))
    placed = scoped.drop("vector").join(passages.withColumnRenamed("question_id", "id"), "id", "left")
    best = F.coalesce("best_score", F.lit(0.0))
    decision = F.when(~F.col("out_of_scope"), gate(F.col("question"), F.col("filing_year"), best))
    return placed.withColumn("decision", decision).withColumn("nonce", X.case_nonce(F.col("id").cast("string")))


def answer(
    questions: DataFrame,
    index: Index,
    gate: Callable[[Column, Column, Column], Column],
    generate: Generate,
    k: int = S.DEFAULT_TOP_K,
) -> DataFrame:
    """Answered and withheld questions. Declined ones are set apart before the prompt is built, so
    the generator sees admitted questions only; the gated table is written between the two."""
    decided = materialize(gated(questions, index, gate, k), "gated")
    made = AN.verified(generate(AN.with_prompt(AN.admitted(decided)).where(F.col("prompt").isNotNull())))
    stopped = AN.declined(decided)
    return made.unionByName(stopped, allowMissingColumns=True)


def run_split(questions: DataFrame, index: Index, gates: Callable[[Column, Column, Column], Column], generate: Generate, k: int = S.DEFAULT_TOP_K) -> DataFrame:
    """Case records of a question set: every gate scored, the model asked about the end-to-end
    tier whatever the gates said, answers graded."""
    e2e = questions.select("id", F.col("e2e").alias("asked_model"))

    def scored(q: Column, y: Column, best: Column) -> Column:
        return G.score_every(gates(q, y, best), F.col("e2e"))

    answers = answer(questions, index, scored, generate, k).join(e2e, "id")
    sanity = IX.split_sanity(
        index.chunks.select("accession", "item", "text"),
        answers.where(F.col("kind") == "narrative").select("accession", "expected_item").where(F.col("accession").isNotNull()).distinct(),
    ).select("accession", "expected_item", F.col("split_is_sane").alias("item_split_sane"))
    narrated = answers.join(sanity, ["accession", "expected_item"], "left")
    stages = narrated if "stages" in narrated.columns else narrated.withColumn("stages", F.create_map().cast("map<string,double>"))
    return AN.case_records(AN.graded(stages))


def report(records: DataFrame, repeats: DataFrame | None = None, resamples: int = S.RESAMPLES) -> dict[str, DataFrame]:
    """Every table of the report of a run, by title. Nothing is computed until a table is used."""
    golden = records.where(F.col("kind") == "golden")
    e2e = A.end_to_end(records)
    thresholds = materialize(A.fit_thresholds(records), "thresholds")
    arms = A.with_arms(e2e, thresholds)
    table = A.arm_table(arms).join(A.clustered_rates(arms, "fold", resamples), "arm").join(
        A.gate_recall(A.with_arms(golden, thresholds)), "arm"
    )
    risk = [
        RK.risk_at_coverage(curve).withColumn("gate", F.lit(score))
        for score in (A.COSINE, A.RECORDED)
        for curve in [
            RK.risk_coverage_curve(
                e2e.withColumn("_score", A.score_of(score)).withColumn("_ok", A.decision_correct()), "_score", "_ok"
            )
        ]
    ]
    tables = {
        "Thresholds": thresholds,
        "Arms, end-to-end tier": table,
        "Confirmatory comparisons": A.confirmatory(A.with_masks(e2e, thresholds), resamples),
        "False answers by kind": A.false_answers_by_kind(arms),
        "Gate only": A.gate_only(records, thresholds),
        "Risk and coverage": risk[0].unionByName(risk[1]),
        "Narrative questions": A.narrative_table(records),
        "Stage latency": A.stage_latency(records),
        "Cost by outcome": A.cost_by_outcome(e2e),
        "Run": A.run_summary(records),
    }
    if repeats is not None:
        tables["Determinism"] = A.determinism(repeats)
    return tables


def report_markdown(tables: dict[str, DataFrame]) -> str:
    return "\n\n".join(W.markdown_table(t, title) for title, t in tables.items()) + "\n"


def repeat_set(records: DataFrame, count: int) -> DataFrame:
    """Generated cases to send to the model a second time, in an order free of their content."""
    return SEL.first_by_hash(records.where(F.col("generation").isNotNull()), count)


def repeat_records(first: DataFrame, second: DataFrame) -> DataFrame:
    """Whether the same prompt gave the same text. Both: id, generation, generator_seconds."""
    again = second.select("id", F.col("generation").alias("_again"), F.col("generator_seconds").alias("_seconds"))
    return first.join(again, "id").select(
        "id",
        F.col("generation").eqNullSafe(F.col("_again")).alias("identical"),
        F.coalesce("generator_seconds", F.lit(0.0)).alias("first_seconds"),
        F.round("_seconds", S.SCORE_DIGITS).alias("second_seconds"),
    )


def regression_check(
    records: DataFrame, baseline: DataFrame, baseline_threshold: float, threshold: float = S.DEFAULT_COSINE_THRESHOLD
) -> dict[str, DataFrame]:
    """The tables of a check against a stored baseline (the rows of ``regression.judge``)."""
    judged = materialize(RG.judge(records, threshold), "judged")
    pairs = RG.matched(baseline, judged)
    return {
        "Verdict": RG.verdict(pairs, baseline_threshold, threshold),
        "Changes": RG.changes(pairs),
        "Outcome changes": RG.transitions(pairs),
        "Half widths": RG.half_widths(judged),
    }


def citation_replay(records: DataFrame, recording: DataFrame) -> dict[str, DataFrame]:
    """Recorded answers judged under every rule set, with controls and counts by arm.

    ``recording``: prompt, text."""
    read = RP.reconstructed(RP.with_recorded_prompt(records, recording))
    sound = materialize(
        read.where(F.col("problem").isNull()).select("id", "kind", "outcome", "text", "passages"), "replayable"
    )
    results = materialize(RP.case_results(RP.replayed(sound)), "replayed")
    masks = A.with_arms(records, A.fit_thresholds(records)).select("id", "arm", "admitted")
    counts = RP.arm_counts(results, masks)
    return {
        "Not reconstructed": read.where(F.col("problem").isNotNull()).select("id", "problem"),
        "Not reproduced": results.where(F.col("first") != F.col("outcome")).select("id", "outcome", "first"),
        "Counts by arm": counts,
        "Arms alike": RP.arms_alike(counts, ["answered", "withheld", "m1", "m2", "lost", "gained"]),
        "Controls": RP.controls(results),
        "Flips": RP.flips(results, masks),
        "Rules switched off": RP.rule_deviations(results),
    }


def default_threshold(*runs: DataFrame, target: float = S.TARGET_RECALL) -> DataFrame:
    """One threshold fitted on the answerable golden cases of several runs together."""
    positives = None
    for run in runs:
        part = run.where((F.col("kind") == "golden") & F.col("answerable")).select(A.score_of(A.COSINE).alias("score"))
        positives = part if positives is None else positives.unionByName(part)
    return RK.threshold_at_recall(positives, "score", target)
