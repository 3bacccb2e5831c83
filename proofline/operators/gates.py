"""Gates as struct columns, and how several are combined.

A decision is a struct<admitted, confidence, reason, degraded, rejection, scores>. A gate is a
function of columns that returns one, so a user's own gate needs no registration.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from proofline import schemas as S
from proofline.functions import periods as P

Gate = Callable[[], Column]


def decision(
    admitted: Column,
    confidence: Column,
    reason: Column,
    degraded: Column | None = None,
    rejection: str = "gate_rejected",
    scores: Column | None = None,
) -> Column:
    empty = F.create_map().cast("map<string,double>")
    return F.struct(
        admitted.alias("admitted"),
        confidence.cast("double").alias("confidence"),
        reason.alias("reason"),
        (F.lit(False) if degraded is None else degraded).alias("degraded"),
        F.lit(rejection).alias("rejection"),
        (empty if scores is None else scores.cast("map<string,double>")).alias("scores"),
    )


def no_gate() -> Column:
    return decision(F.lit(True), F.lit(1.0), F.lit("no gate configured"))


def cosine_gate(best: Column, threshold: float = S.DEFAULT_COSINE_THRESHOLD) -> Column:
    """Admit when the closest passage scores at least the threshold; no passage scores zero."""
    score = F.coalesce(best, F.lit(0.0))
    shown = F.format_string("best passage scored %.3f", score)
    short = F.concat(shown, F.lit(f", below the {threshold} threshold"))
    passes = score >= threshold
    rounded = F.round(score, S.SCORE_DIGITS)
    return decision(
        passes, rounded, F.when(passes, shown).otherwise(short), scores=F.create_map(F.lit("cosine"), rounded)
    )


def period_guard(question: Column, fiscal_year: Column, reported: int = S.YEARS_REPORTED) -> Column:
    """Decline a question that names a year its filing does not report; naming none passes."""
    if reported < 1:
        raise ValueError("a filing reports at least its own fiscal year")
    named = P.years_named(question, fiscal_year)
    outside = P.years_outside(named, fiscal_year, reported)
    span = F.concat(
        F.lit("this filing reports fiscal "),
        (fiscal_year - (reported - 1)).cast("string"),
        F.lit(" to "),
        fiscal_year.cast("string"),
    )
    passes = F.size(outside) == 0
    said = F.when(F.size(named) == 0, F.lit("no year named")).otherwise(
        F.concat(F.lit("the question names fiscal "), P.listed(F.when(passes, named).otherwise(outside)))
    )
    score = F.when(passes, F.lit(1.0)).otherwise(F.lit(0.0))
    return decision(
        passes,
        score,
        F.concat(said, F.lit("; "), span),
        rejection="out_of_period",
        scores=F.create_map(F.lit("period"), score),
    )


def recorded_gate(confidences: Column, passages: Column) -> Column:
    """Admit with the best recorded relevance. ``confidences`` has one entry per passage, null
    where the recorded reply was no answer; such a reply degrades the decision."""
    judged = F.array_compact(confidences)
    best = F.round(F.coalesce(F.array_max(judged), F.lit(0.0)), S.SCORE_DIGITS)
    return decision(
        passages > 0,
        best,
        F.when(passages > 0, F.format_string("recorded confidence %.3f", best)).otherwise(
            F.lit("retrieval returned nothing to judge")
        ),
        degraded=F.size(judged) < passages,
        scores=F.create_map(F.lit("recorded"), best),
    )


def all_of(*gates: Column) -> Column:
    """Every gate is asked. The first that declines gives the rejection, the last the confidence."""
    if not gates:
        raise ValueError("all_of needs at least one gate")
    asked = F.array(*gates)
    declined = F.filter(asked, lambda g: ~g["admitted"])
    admitted = F.size(declined) == 0
    reasons = F.transform(F.when(admitted, asked).otherwise(declined), lambda g: g["reason"])
    scores = gates[0]["scores"]
    if len(gates) > 1:
        entries = F.concat(*[F.map_entries(g["scores"]) for g in gates])
        # The last gate to report a name wins.
        last = F.filter(
            F.transform(entries, lambda e, i: F.struct(e.alias("e"), i.alias("i"))),
            lambda x: ~F.exists(
                F.transform(entries, lambda o, j: F.struct(o["key"].alias("key"), j.alias("j"))),
                lambda o: (o["key"] == x["e"]["key"]) & (o["j"] > x["i"]),
            ),
        )
        scores = F.map_from_entries(F.transform(last, lambda x: x["e"]))
    return F.struct(
        admitted.alias("admitted"),
        gates[-1]["confidence"].alias("confidence"),
        F.array_join(reasons, "; ").alias("reason"),
        F.exists(asked, lambda g: g["degraded"]).alias("degraded"),
        F.coalesce(F.get(declined, F.lit(0))["rejection"], F.lit("gate_rejected")).alias("rejection"),
        scores.alias("scores"),
    )


def score_every(gate: Column, admit: Column) -> Column:
    """A gate's scores with the decision replaced."""
    return gate.withField("admitted", admit).withField("rejection", F.lit("gate_rejected"))


def gate_named(
    name: str, question: Column, fiscal_year: Column, best: Column, threshold: float = S.DEFAULT_COSINE_THRESHOLD
) -> Column:
    """The gate a setting names: ``none``, ``cosine`` or ``period+cosine``."""
    if name == "none":
        return no_gate()
    if name == "cosine":
        return cosine_gate(best, threshold)
    if name == "period+cosine":
        return all_of(period_guard(question, fiscal_year), cosine_gate(best, threshold))
    raise ValueError(f"unknown gate {name!r}")
