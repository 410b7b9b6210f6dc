"""Whether a name is a Chinese one: markers of other languages, and evidence for it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import among
from ..lexicon import fixed
from .facts import DOMINANT

# Bounds of the scores.
KOREAN_LIMIT, KOREAN_SHARED_LIMIT, VIETNAMESE_LIMIT, CHINESE_LIMIT = 2.0, 2.5, 2.0, 0.5
JAPANESE_PROBABILITY = 0.8
TIERS = ("Western name detected", "Korean-only surname detected", "Japanese surname detected", "appears to be Vietnamese name")
BY_MODEL, KOREAN, VIETNAMESE, NONE = "Japanese name detected by ML classifier", "Korean structural patterns detected", "appears to be Vietnamese name", "no Chinese evidence found"


def tier1(facts: Column) -> Column:
    """Western, then Korean-only, Japanese and Vietnamese-only markers; null where there is none."""
    least = F.array_min(F.transform(facts, lambda t: t["tier"]))
    return F.get(F.array(*map(F.lit, TIERS)), least - 1)


def _count(facts: Column, flag: str) -> Column:
    return F.size(F.filter(facts, lambda t: t["mark"][flag]))


def korean_pairs(facts: Column) -> Column:
    """How many distinct neighbours among the given syllables are a known Korean pair, with the surname at the head or a shared one at the tail."""
    n = F.size(facts)
    head, tail = F.get(facts, F.lit(0))["mark"], F.get(facts, n - 1)["mark"]
    subs = lambda part: F.flatten(F.transform(part, lambda t: t["mark"]["sub"]))
    known = among([" ".join(p) for p in fixed.KOREAN_PAIRS])

    def hits(part: Column) -> Column:
        less = F.greatest(F.size(part) - 1, F.lit(0))
        return F.filter(F.zip_with(F.slice(part, F.lit(1), less), F.slice(part, F.lit(2), less), lambda a, b: F.concat_ws(" ", a, b)), lambda p: F.array_contains(known, p))

    none = F.array().cast("array<string>")
    after = F.when(head["surname"].isin("korean_only", "korean_overlapping", "none"), hits(subs(F.slice(facts, F.lit(2), F.greatest(n - 1, F.lit(0)))))).otherwise(none)
    before = F.when((n >= 2) & tail["korean_overlap"], hits(subs(F.slice(facts, F.lit(1), F.greatest(n - 1, F.lit(0)))))).otherwise(none)
    return F.size(F.array_union(after, before))


def korean_score(facts: Column, pairs: Column | None = None) -> Column:
    """Points for Korean given syllables and pairs; none under a surname that is Chinese alone."""
    n = F.size(facts)
    head = F.get(facts, F.lit(0))
    pairs = korean_pairs(facts) if pairs is None else pairs
    trailing = F.get(facts, n - 1)["mark"]["korean_overlap"] & (pairs > 0)
    blocked = (head["mark"]["surname"] == "chinese_only") & (~trailing | (head["ev_ppm"] >= DOMINANT))
    specific, ambiguous = _count(facts, "specific"), _count(facts, "ambiguous")
    points = (
        F.aggregate(facts, F.lit(0.0), lambda a, t: a + t["mark"]["hyphen"])
        + 3.0 * pairs
        + F.when(specific >= 2, 2.0).when(specific == 1, 1.0).otherwise(0.0)
        + F.when((head["mark"]["surname"] == "korean_overlapping") & (ambiguous >= 2), 1.0).otherwise(0.0)
    )
    return F.when(blocked, 0.0).when(head["mark"]["surname"] == "korean_only", 10.0).otherwise(points)


def korean_limit(facts: Column) -> Column:
    return F.when(F.exists(facts, lambda t: t["mark"]["shared"]), KOREAN_SHARED_LIMIT).otherwise(KOREAN_LIMIT)


def vietnamese_score(facts: Column) -> Column:
    n = _count(facts, "vietnamese")
    overlap = F.get(facts, F.lit(0))["mark"]["surname"] == "vietnamese_overlapping"
    return (
        F.when(F.exists(facts, lambda t: t["mark"]["thi"]), 3.0).otherwise(0.0)
        + F.when(overlap & (n >= 1) & ~F.exists(facts, lambda t: t["chinese_key"]), 2.0).otherwise(0.0)
        + F.when(n >= 2, 1.5).otherwise(0.0)
    )


def strength(facts: Column) -> Column:
    """Points of the distinct keys of a name: by a surname's share, for compound surnames and for fused given names."""
    every = F.array_distinct(F.flatten(F.transform(facts, lambda t: t["evidence"])))
    return F.aggregate(every, F.lit(0.0), lambda a, k: a + k["strength"])


def classified(rows: DataFrame, japanese: Column | None = None) -> DataFrame:
    """rows (facts) with foreign: the reason why a name isn't taken for a Chinese one, else null.

    japanese: probability of a name in Han alone to be Japanese.
    """
    facts = F.col("facts")
    model = F.lit(False) if japanese is None else F.coalesce(japanese >= JAPANESE_PROBABILITY, F.lit(False))
    rows = rows.withColumns({"_jp": model, "_t": tier1(facts), "_k": korean_pairs(facts), "_v": vietnamese_score(facts), "_s": F.round(strength(facts), 9)})
    rows = rows.withColumn("_k", korean_score(facts, F.col("_k")) >= korean_limit(facts))
    foreign = F.when(F.col("_jp"), BY_MODEL).when(F.col("_t").isNotNull(), F.col("_t")).when(F.col("_k"), KOREAN).when(F.col("_v") >= VIETNAMESE_LIMIT, VIETNAMESE).when(F.col("_s") < CHINESE_LIMIT, NONE)
    return rows.withColumn("foreign", foreign).drop("_jp", "_t", "_k", "_v", "_s")
