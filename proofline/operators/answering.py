"""From a question and its passages to an answer or a withheld one, and how an answer is graded."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofline import schemas as S
from proofline.functions import amounts as A
from proofline.functions import text as X
from proofline.operators import claims as C
from proofline.operators.arms import outcome_of
from proofline.operators.printed import prints_in


def abstention_message(reason: Column) -> Column:
    table = F.create_map(*[F.lit(v) for v in chain.from_iterable(S.ABSTENTION_MESSAGES.items())])
    return table[reason]


def with_prompt(admitted: DataFrame) -> DataFrame:
    """Admitted questions with their prompt. Needs question, passages and ``nonce``; a row whose
    nonce could not safely stand in a tag gets no prompt and is never sent."""
    safe = F.when(X.is_safe_nonce(F.col("nonce")), F.col("nonce"))
    return admitted.withColumn("prompt", X.build_prompt(F.col("question"), F.col("passages"), safe))


def citations(passages: Column, question: Column, cited: Column) -> Column:
    """array<struct<marker, item, title, quote, score>> of the passages an answer points at."""
    numbered = F.transform(passages, lambda p, i: F.struct((i + 1).alias("marker"), p.alias("p")))
    kept = F.filter(numbered, lambda n: F.array_contains(cited, n["marker"]))
    return F.transform(
        kept,
        lambda n: F.struct(
            n["marker"].alias("marker"),
            n["p"]["item"].alias("item"),
            n["p"]["title"].alias("title"),
            X.quote_for(n["p"]["text"], question).alias("quote"),
            F.round(n["p"]["score"], S.SCORE_DIGITS).alias("score"),
        ),
    )


def verified(generated: DataFrame) -> DataFrame:
    """Rows (question, passages, decision, nonce, text, ...) with what is done with the text.

    A reply that is exactly the refusal token declines; one without a valid marker, or with a
    sentence its passages do not back, is withheld; anything else is the answer.
    """
    figured = C.with_figures(generated.withColumn("text", F.coalesce("text", F.lit(""))))
    judgement = figured.withColumn("_j", C.judge())
    refused = X.strip(F.col("text")) == X.refusal_token(F.col("nonce"))
    reason = F.when(refused, F.lit("model_declined")).when(
        F.col("_j.outcome") != "answered", F.col("_j.outcome")
    )
    because = F.col("decision.reason")
    detail = F.when(reason.isNull(), because).otherwise(
        F.concat(
            abstention_message(reason),
            F.lit(" ("),
            F.when(~refused & F.col("_j.finding").isNotNull(), F.concat(F.col("_j.finding"), F.lit("; "))).otherwise(F.lit("")),
            because,
            F.lit(")"),
        )
    )
    cited = X.markers_in(F.col("text"), F.size("passages"))
    return judgement.select(
        *[c for c in generated.columns if c != "text"],
        F.when(reason.isNull(), F.col("text")).alias("answer"),
        F.col("text").alias("generation"),
        reason.isNotNull().alias("abstained"),
        reason.alias("reason"),
        detail.alias("detail"),
        F.when(reason.isNull(), citations(F.col("passages"), F.col("question"), cited)).alias("citations"),
    )


def declined(questions: DataFrame) -> DataFrame:
    """Rows stopped before generation: outside the index, or not admitted by the gate."""
    outside = F.col("out_of_scope")
    reason = F.when(outside, F.lit("out_of_scope")).otherwise(F.col("decision.rejection"))
    scope = F.concat_ws(" ", F.lit("CIK"), F.col("cik").cast("string"), F.lit("fiscal"), F.coalesce(F.col("fiscal_year").cast("string"), F.lit("latest")))
    because = F.when(outside, F.concat(F.lit("no filing indexed for "), scope)).otherwise(F.col("decision.reason"))
    return questions.where(outside | ~F.coalesce(F.col("decision.admitted"), F.lit(False))).select(
        *questions.columns,
        F.lit(None).cast("string").alias("answer"),
        F.lit(None).cast("string").alias("generation"),
        F.lit(True).alias("abstained"),
        reason.alias("reason"),
        F.concat(abstention_message(reason), F.lit(" ("), because, F.lit(")")).alias("detail"),
    )


def admitted(questions: DataFrame) -> DataFrame:
    return questions.where(~F.col("out_of_scope") & F.coalesce(F.col("decision.admitted"), F.lit(False)))


# --- grading -------------------------------------------------------------------------------------
def graded(answers: DataFrame) -> DataFrame:
    """Answers (answer, abstained, passages, citations, expected_value, tolerance, per_share) with
    numeric_correct, citation_supported, gold_retrieved and cited_items. The three checks are null
    unless an answer was given and a value was expected."""
    gold = A.to_nano(F.col("expected_value"))
    asked = ~F.col("abstained") & F.col("expected_value").isNotNull()
    cited = F.transform(F.coalesce("citations", F.array()), lambda c: c["marker"])
    # Each passage is read once, whether or not it is cited.
    read = F.when(
        asked, F.transform("passages", lambda p, i: F.struct((i + 1).alias("marker"), prints_in(p["text"], gold, F.col("per_share")).alias("prints")))
    )
    prints = F.col("_read")

    return C.once(answers, _read=read).select(
        *answers.columns,
        F.when(asked, A.states_value(F.col("answer"), gold, F.col("tolerance"))).alias("numeric_correct"),
        F.when(asked, F.exists(prints, lambda n: n["prints"] & F.coalesce(F.array_contains(cited, n["marker"]), F.lit(False)))).alias("citation_supported"),
        F.when(asked, F.exists(prints, lambda n: n["prints"])).alias("gold_retrieved"),
        F.transform(F.coalesce("citations", F.array()), lambda c: c["item"]).alias("cited_items"),
    )


def case_records(answers: DataFrame) -> DataFrame:
    """Graded answers as case records, the columns of ``schemas.CASE_RECORD``."""
    outcome = outcome_of(F.col("abstained"), F.col("reason"), F.col("asked_model"))
    return answers.select(
        "id", "kind", "split", "fold", "ticker", "cik", "fiscal_year", "answerable", "negative_kind", "e2e",
        F.transform_values("decision.scores", lambda _, v: F.round(v, S.SCORE_DIGITS)).alias("scores"),
        F.coalesce("decision.degraded", F.lit(False)).alias("degraded"),
        F.coalesce("best_score", F.lit(0.0)).alias("retrieval_score"),
        F.transform(F.coalesce("passages", F.array()), lambda p: p["chunk_id"]).alias("retrieved"),
        F.col("generation").isNotNull().alias("generated"),
        outcome.alias("outcome"),
        "generation", "numeric_correct", "citation_supported", "gold_retrieved", "cited_items",
        "expected_item", "item_split_sane", "stages", "prompt_tokens", "completion_tokens", "generator_seconds",
    )


def questions_of(golden: DataFrame, narratives: DataFrame | None = None, split: str | None = None) -> DataFrame:
    """Golden and narrative cases as one table of questions to ask."""
    wanted = golden if split is None else golden.where(F.col("split") == split)
    asked = wanted.select(
        "id", F.lit("golden").alias("kind"), "split", "fold", "ticker", "cik", "fiscal_year", "question", "answerable",
        "negative_kind", "e2e", "expected_value", "tolerance",
        F.coalesce(F.col("unit") == S.PER_SHARE_UNIT, F.lit(False)).alias("per_share"),
        F.lit(None).cast("string").alias("expected_item"),
    )
    if narratives is None:
        return asked
    folds = golden.select("ticker", "split", "fold").distinct()
    told = narratives.join(folds, "ticker", "left")
    told = told if split is None else told.where(F.col("split") == split)
    return asked.unionByName(
        told.select(
            "id", F.lit("narrative").alias("kind"), "split", "fold", "ticker", "cik", "fiscal_year", "question",
            "answerable", F.lit(None).cast("string").alias("negative_kind"), F.lit(True).alias("e2e"),
            F.lit(None).cast(S.MONEY).alias("expected_value"),
            F.lit(S.RELATIVE_TOLERANCE).cast("decimal(10,6)").alias("tolerance"), F.lit(False).alias("per_share"), "expected_item",
        )
    )
