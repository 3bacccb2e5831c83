"""URL filter: rules first, then the ratio of two character language models.

Urls that a rule decides train the models, allowed ones the accepted model and blocked ones the
rejected model. Both are Markov models of orders 0 to ``ORDER``; each order is mixed with the next
lower one by Witten-Bell smoothing, so a context counts as far as it was seen. A url's score is the
mean over its characters of the difference of the log probabilities. The threshold is the one that
best separates rule-decided urls that were held back from training.

Scores are computed once for each gram of ``ORDER + 1`` characters, not for each place it occurs,
and equal urls are one row with a count, so a host with a third of the pages weighs little. All of it
is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from proofline.session import materialize

#: (verdict, host, path prefix)
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)
ORDER = 4
#: Characters before the first and after the last of a url.
BEFORE, AFTER = "\u0002", "\u0003"
#: Every character has at least this probability below all orders.
ALPHABET = 65536.0
#: Log ratios are kept in millionths, so sums do not depend on their order; scores are cut in hundredths.
UNIT, STEP = 1_000_000, 100
#: First digits of the md5 of urls held back for the threshold.
HELD_BACK = "012"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host(url: str = "url") -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")), UPPER, LOWER)


def path(url: str = "url") -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def matched_rule(rules=RULES) -> tuple[Column, Column]:
    """The rule that decides a row with columns host and path, as text, and its verdict."""
    ordered = sorted(rules, key=lambda rule: -len(rule[1] + rule[2]))
    named = verdict = F.when(F.lit(False), F.lit(None).cast("string"))
    for decision, of, prefix in ordered:
        fits = ((F.col("host") == of) | F.col("host").endswith("." + of)) & F.col("path").startswith(prefix)
        named, verdict = named.when(fits, F.lit(of + prefix)), verdict.when(fits, F.lit(decision))
    return named, verdict


def _text(url: str = "url") -> Column:
    """What the models read: the url in lower case, without its scheme."""
    return F.regexp_replace(F.translate(F.coalesce(F.col(url), F.lit("")), UPPER, LOWER), r"(?s)^.*?://", "")


def _grams(texts: DataFrame) -> DataFrame:
    """A row for each gram of each text, with how often the text has it."""
    padded = F.concat(F.lit(BEFORE * ORDER), "text", F.lit(AFTER))
    places = F.sequence(F.lit(1), F.length("text") + 1)
    return texts.select("*", padded.alias("padded")).select(
        *texts.columns, F.explode(F.transform(places, lambda i: F.col("padded").substr(i, F.lit(ORDER + 1)))).alias("gram")
    )


def log_ratios(grams: DataFrame) -> DataFrame:
    """gram, ratio (in millionths) for a table of grams with weights accepted and rejected; a gram
    may have no weight. Tables shrink with the order, and each is joined by the gram or its tail."""
    counts = materialize(
        grams.groupBy("gram").agg(F.sum("accepted").alias("accepted"), F.sum("rejected").alias("rejected")), "grams"
    )
    lower: DataFrame | None = None
    for order in range(ORDER + 1):
        tail = counts.groupBy(F.substring("gram", ORDER + 1 - order, order + 1).alias("gram")) if order < ORDER else None
        each = tail.agg(F.sum("accepted").alias("accepted"), F.sum("rejected").alias("rejected")) if tail else counts
        each = each.withColumn("context", F.substring("gram", 1, order))
        seen = each.groupBy("context").agg(
            *[F.sum(k).alias(f"{k}_all") for k in ("accepted", "rejected")],
            *[F.sum((F.col(k) > 0).cast("long")).alias(f"{k}_kinds") for k in ("accepted", "rejected")],
        )
        joined = each.join(seen, "context")
        if lower is not None:
            below = lower.select(F.col("gram").alias("shorter"), "p_accepted", "p_rejected")
            joined = joined.withColumn("shorter", F.substring("gram", 2, order)).join(below, "shorter")
        chances = []
        for k in ("accepted", "rejected"):
            base = F.col(f"p_{k}") if lower is not None else F.lit(1 / ALPHABET)
            weight = F.col(f"{k}_all") + F.col(f"{k}_kinds")
            chances.append(F.when(weight > 0, (F.col(k) + F.col(f"{k}_kinds") * base) / weight).otherwise(base).alias(f"p_{k}"))
        lower = joined.select("gram", *chances)
    ratio = F.round((F.log("p_accepted") - F.log("p_rejected")) * UNIT).cast("long")
    return lower.select("gram", ratio.alias("ratio"))


def best_step(scored: DataFrame) -> int:
    """The score in hundredths from which urls are accepted: where the shares of accepted urls at or
    above and of rejected urls below are largest together, in the middle of the gap between the
    scores on both sides; nearest to zero if several are. Zero if a class has no url. ``scored`` has score_step, accepted and rejected; it is reduced to one row
    per step, and log ratios of characters have bounded size."""
    steps = scored.groupBy("step").agg(F.sum("accepted").alias("accepted"), F.sum("rejected").alias("rejected"))
    steps = steps.where("accepted + rejected > 0")
    whole, before = Window.partitionBy(), Window.orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    gain = F.coalesce(F.sum("rejected").over(before), F.lit(0)) * F.sum("accepted").over(whole).cast("decimal(38,0)") - F.coalesce(
        F.sum("accepted").over(before), F.lit(0)
    ) * F.sum("rejected").over(whole).cast("decimal(38,0)")
    middle = F.ceil((F.col("step") + F.coalesce(F.lag("step").over(Window.orderBy("step")), F.col("step"))) / 2).cast("long")
    best = steps.select(middle.alias("step"), gain.alias("gain"), F.sum("accepted").over(whole).alias("a"), F.sum("rejected").over(whole).alias("r"))
    best = best.where("a > 0 and r > 0").orderBy(F.desc("gain"), F.abs("step"), "step").first()
    return best["step"] if best else 0


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, score: one row per row of ``pages`` (page_id and url).

    A null url and one without ``://`` have neither host nor path and no rule; the models judge them
    like the rest (a null as the empty text). Repeated rows are judged alike. Without rule-decided
    urls both models are equal, and every other url is allowed.
    """
    named, verdict = matched_rule(rules)
    rows = pages.select("page_id", F.col("url").cast("string").alias("url")).select("page_id", host().alias("host"), path().alias("path"), _text().alias("text"))
    rows = materialize(rows.select("*", named.alias("rule"), verdict.alias("decided")), "urls")
    texts = rows.groupBy("text").agg(
        F.sum((F.col("decided") == "allow").cast("long")).alias("accepted"),
        F.sum((F.col("decided") == "block").cast("long")).alias("rejected"),
    )
    texts = texts.select("text", *[F.coalesce(k, F.lit(0)).alias(k) for k in ("accepted", "rejected")])
    back = F.substring(F.md5(F.col("text").cast("binary")), 1, 1).isin(*HELD_BACK)
    texts = texts.withColumn("back", back)
    grams = materialize(_grams(texts), "places")
    trained = grams.select("gram", *[F.when(F.col("back"), 0).otherwise(F.col(k)).alias(k) for k in ("accepted", "rejected")])
    ratios = log_ratios(trained)
    total = F.sum("ratio")
    scored = (
        grams.join(ratios, "gram")
        .groupBy("text")
        .agg(total.alias("total"), F.count(F.lit(1)).alias("length"), *[F.first(k).alias(k) for k in ("accepted", "rejected", "back")])
    )
    step = F.floor(F.col("total") * STEP / (F.col("length") * UNIT)).cast("long")
    scored = materialize(scored.withColumn("step", step), "scores")
    least = best_step(scored.where("back"))
    score = F.col("total") / (F.col("length") * UNIT)
    judged = scored.select("text", score.alias("score"), F.when(F.col("step") >= least, "allow").otherwise("block").alias("judged"))
    return rows.join(judged, "text").select("page_id", "host", "path", "rule", F.coalesce("decided", "judged").alias("verdict"), "score")
