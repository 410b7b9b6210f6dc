"""Votes of a batch on its name order, and parses chosen anew under it.

All that a batch says is one aggregate per batch_id; sums are combined before
the shuffle, so a pool of any size costs one small row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .parse import best
from .render import NOT_PLAUSIBLE

UNPARSED = "no valid parse found"

# Thresholds of batch voting.
THRESHOLD = 0.55
MIN_BATCH = 2
MIN_SHARE = 0.5
PROMOTE_SHARE, SHAPE_LETTERS, SHAPE_SHARE, LOW_MEDIAN = 0.75, 6, 0.5, 130.0
HIGH_PPM, MEDIUM_PPM = 1000.0, 100.0


def entries(table: DataFrame) -> DataFrame:
    """Names with their own results as voters: best parse without (own) and with (alone) the guarded bonus, and the weight of the vote."""
    gap = F.sort_array(F.transform("cands", lambda c: c["plain"]), asc=False)
    cands = F.coalesce(F.size("cands"), F.lit(0))
    latin = F.col("failed").isNull() & (F.col("script") == "latin_only") & (cands > 0)
    return table.withColumns(
        {
            "own": F.when(latin, best(F.col("cands"), "plain")),
            "alone": F.when(latin, best(F.col("cands"), "score")),
            "weight": F.when(cands < 2, 1.0).otherwise(F.greatest(F.lit(0.1), 2 * (F.get(gap, F.lit(0)) - F.get(gap, F.lit(1))))),
            "votes": F.coalesce(latin & ~F.col("caps"), F.lit(False)),
            "n_cands": cands,
        }
    )


def promote(e: DataFrame) -> DataFrame:
    """Adds ``vote``: the own format, turned to given-first for two-token names
    whose guarded best is that, if the batch supports it widely enough."""
    turned = F.col("votes") & (F.col("own.form") == "surname_first") & (F.size("roman") == 2) & (F.col("alone.form") == "given_first")
    e = e.withColumn("turned", F.coalesce(turned, F.lit(False)))
    first = F.get("facts", F.lit(0))
    shape = F.length(F.regexp_replace(F.get("roman", F.lit(0)), "[-']", "")) >= SHAPE_LETTERS
    g = e.groupBy("batch_id").agg(
        F.sum(F.col("votes").cast("int")).alias("n"),
        F.sum(F.col("turned").cast("int")).alias("p"),
        F.sum((F.col("votes") & (F.col("own.form") == "given_first")).cast("int")).alias("gf"),
        F.sum((F.col("turned") & shape).cast("int")).alias("shaped"),
        F.percentile(F.when(F.col("turned"), first["ev_ppm"]), F.lit(0.5)).alias("med"),
    )
    enough = (F.col("p") > 0) & ((F.col("p") + F.col("gf")) >= PROMOTE_SHARE * F.col("n")) & ((F.col("shaped") >= SHAPE_SHARE * F.col("p")) | (F.col("med") < LOW_MEDIAN))
    e = e.join(g.select("batch_id", enough.alias("promote")), "batch_id")
    return e.withColumn("vote", F.when(F.col("votes"), F.when(F.col("promote") & F.col("turned"), "given_first").otherwise(F.col("own.form"))))


def ballots(e: DataFrame, *keys: str) -> DataFrame:
    """What each of ``entries`` adds to the sums of its batch: keys, and numbers that say nothing else of the name."""
    two = F.coalesce(F.col("votes") & (F.size("roman") == 2), F.lit(False))
    form = F.when(F.col("votes"), F.col("own.form"))
    turned = F.coalesce(two & (form == "surname_first") & (F.col("alone.form") == "given_first"), F.lit(False))
    shaped = F.length(F.regexp_replace(F.get("roman", F.lit(0)), "[-']", "")) >= SHAPE_LETTERS
    strength = lambda i: F.when(two, position_strength(F.get("facts", F.lit(i))["ppm"])).otherwise(0)
    return e.select(
        *keys, "votes", form.alias("form"), turned.alias("turned"), F.coalesce(turned & shaped, F.lit(False)).alias("shaped"),
        F.when(turned, F.get("facts", F.lit(0))["ev_ppm"]).alias("ev"), "weight", (F.col("n_cands") == 1).alias("sole"), strength(0).alias("s0"), strength(1).alias("s1"),
    )


def tally(b: DataFrame) -> DataFrame:
    """What ``votes`` gives of voters after ``promote``, of their ``ballots`` with batch_id, in one aggregate."""
    kinds = {"sf": (F.col("form") == "surname_first") & ~F.col("turned"), "gf": F.col("form") == "given_first", "tf": F.col("turned")}
    one = lambda c: F.sum(F.when(c, 1).otherwise(0))
    sums = {"size": F.count("*"), "total_count": one(F.col("votes")), "shaped": one(F.col("shaped")), "med": F.percentile("ev", F.lit(0.5)), "sf_strength": F.sum("s0"), "gf_strength": F.sum("s1")}
    for k, c in kinds.items():
        sums |= {f"{k}_n": one(c), f"{k}_w": F.coalesce(F.sum(F.when(c, F.col("weight"))), F.lit(0.0)), f"{k}_a": one(c & F.col("sole"))}
    g = b.where("batch_id IS NOT NULL").groupBy("batch_id").agg(*[c.alias(n) for n, c in sums.items()])
    n = F.col("tf_n")
    enough = (n > 0) & (n + F.col("gf_n") >= PROMOTE_SHARE * F.col("total_count")) & ((F.col("shaped") >= SHAPE_SHARE * n) | F.coalesce(F.col("med") < LOW_MEDIAN, F.lit(False)))
    g = g.withColumn("_up", enough)
    with_turned = lambda k, x: F.col(f"{k}_{x}") + F.when(F.col("_up") == F.lit(k == "gf"), F.col(f"tf_{x}")).otherwise(0)
    cells = {"surname_first_count": ("sf", "n"), "given_first_count": ("gf", "n"), "sf_weight": ("sf", "w"), "gf_weight": ("gf", "w"), "sf_alone": ("sf", "a"), "gf_alone": ("gf", "a")}
    return g.select("batch_id", "size", "total_count", *[with_turned(*x).alias(c) for c, x in cells.items()], "sf_strength", "gf_strength")


def position_strength(ppm: Column) -> Column:
    return F.when(ppm > HIGH_PPM, 2).when(ppm > MEDIUM_PPM, 1).otherwise(0)


def votes(e: DataFrame) -> DataFrame:
    """One row per batch: counts, weights, unopposed counts and tie-break strengths."""
    sf, gf = F.col("vote") == "surname_first", F.col("vote") == "given_first"
    one = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0))
    two = F.col("votes") & (F.size("roman") == 2)
    strength = lambda i: F.coalesce(F.sum(F.when(two, position_strength(F.get("facts", F.lit(i))["ppm"])).otherwise(0)), F.lit(0))
    return e.groupBy("batch_id").agg(
        F.count("*").alias("size"),
        one(F.col("votes")).alias("total_count"),
        one(sf).alias("surname_first_count"),
        one(gf).alias("given_first_count"),
        F.coalesce(F.sum(F.when(sf, F.col("weight"))), F.lit(0.0)).alias("sf_weight"),
        F.coalesce(F.sum(F.when(gf, F.col("weight"))), F.lit(0.0)).alias("gf_weight"),
        one(sf & (F.col("n_cands") == 1)).alias("sf_alone"),
        one(gf & (F.col("n_cands") == 1)).alias("gf_alone"),
        strength(0).alias("sf_strength"),
        strength(1).alias("gf_strength"),
    )


def pattern(v: DataFrame, threshold: float = THRESHOLD, minimum: int = MIN_BATCH) -> DataFrame:
    """Adds dominant_format, decision_confidence, confidence, vote_margin, threshold_met, would_meet and regime to votes.

    A batch of fewer names than ``minimum`` is read name by name (regime
    individual): its pattern is judged by the default threshold, which
    would_meet tells, but never counts as met.  A larger one is read by its
    pattern (batch), or name by name where that is too weak (weak).
    """
    sf, gf = F.col("surname_first_count"), F.col("given_first_count")
    sw, gw = F.round("sf_weight", 6), F.round("gf_weight", 6)
    voters, total = sf + gf, F.col("total_count")
    tie = F.when(F.col("sf_strength") + 0.5 >= F.col("gf_strength"), "surname_first").otherwise("given_first")
    fmt = F.when(total == 0, "mixed").when(sf > gf, "surname_first").when(gf > sf, "given_first").when(sw > gw, "surname_first").when(gw > sw, "given_first").otherwise(tie)
    sure = F.when(total == 0, 0.0).when(sf != gf, F.greatest(sf, gf) / voters).when(sw != gw, F.greatest(sw, gw) / (sw + gw)).otherwise(0.5)
    v = v.withColumns({"dominant_format": fmt, "decision_confidence": sure})
    first = F.col("dominant_format") == "surname_first"
    alone = F.when(first, F.col("sf_alone") > 0).otherwise(F.col("gf_alone") > 0)
    small = F.col("size") < minimum
    enough = (F.col("decision_confidence") >= F.when(small, THRESHOLD).otherwise(threshold)) & (F.col("decision_confidence") > 0.5) & ((sf != gf) | alone) & (voters >= MIN_BATCH) & (voters >= MIN_SHARE * total)
    return v.withColumns(
        {
            "confidence": F.when(total == 0, 0.0).otherwise(F.when(first, sf).otherwise(gf) / F.greatest(total, F.lit(1))),
            "vote_margin": F.when(voters == 0, 0.0).otherwise(F.abs(sf - gf) / F.greatest(voters, F.lit(1))),
            "would_meet": (total > 0) & enough,
            "threshold_met": (total > 0) & enough & ~small,
            "regime": F.when(small, "individual").when((total > 0) & enough, "batch").otherwise("weak"),
        }
    )


#: How a batch bears on a name: by no pattern, or by one that met its threshold, of either format.
STATES = ((False, None), (True, "surname_first"), (True, "given_first"))
#: What a row takes over from its batch's pattern.
OF_BATCH = ("dominant_format", "threshold_met", "decision_confidence", "vote_margin", "total_count")


def state() -> Column:
    """Of patterns: the number of the state in which they leave names."""
    return F.when(~F.col("threshold_met"), 0).when(F.col("dominant_format") == STATES[1][1], 1).otherwise(2)


def in_states(e: DataFrame) -> DataFrame:
    """``entries`` in each state (state), read as ``apply`` reads them in batches of such a pattern."""
    states = F.array(*[F.struct(F.lit(i).alias("state"), F.lit(met).alias("threshold_met"), F.lit(form).cast("string").alias("dominant_format")) for i, (met, form) in enumerate(STATES)])
    return read_under(e.withColumn("_s", F.explode(states)).select("*", "_s.*").drop("_s"))


def apply(e: DataFrame, patterns: DataFrame) -> DataFrame:
    """``entries`` (with batch_id) under their batch's pattern; see ``read_under``."""
    return read_under(under(e, patterns))


def under(rows: DataFrame, patterns: DataFrame) -> DataFrame:
    return rows.join(patterns.select("batch_id", *OF_BATCH), "batch_id")


def read_under(e: DataFrame) -> DataFrame:
    """``entries`` with dominant_format and threshold_met of their batch, with the parse that counts and its result.

    Under a pattern that met its threshold a voter takes its best candidate of
    that format, if there is one, else its own; other names keep the result
    that they have by themselves.  Under none, Latin names take their best
    candidate in the order as written.
    """
    fitting = best(F.col("cands"), "plain", F.col("dominant_format"))
    latin = F.col("failed").isNull() & (F.col("script") == "latin_only")
    cand = F.when(F.col("threshold_met"), F.when(F.col("votes"), F.coalesce(fitting, F.col("own")))).otherwise(F.when(latin, F.col("alone")))
    e = e.withColumns({"_c": cand, "_latin": latin})
    mine = F.col("_c").isNotNull()
    lost = ~F.col("threshold_met") & F.col("_latin") & ~mine
    error = F.when(mine, F.when(F.col("_c.r.result").isNull(), NOT_PLAUSIBLE)).when(lost, UNPARSED).otherwise(F.col("error"))
    r, form = F.when(mine, F.col("_c.r")).otherwise(F.col("r")), F.when(mine, F.col("_c.form")).otherwise(F.col("choice.form"))
    e = e.withColumns({"error": error, "_r": r, "chosen": F.struct(F.when(mine, F.col("_c.s")).otherwise(F.col("choice.s")).alias("s"), form.alias("form"))})
    ok = F.col("error").isNull()
    parts = {c: F.when(ok, F.col("_r")[c]).otherwise("") for c in ("result", "surname", "given", "middle")}
    lists = {c: F.when(ok, F.col("_r")[c]) for c in ("surname_tokens", "given_tokens", "middle_tokens")}
    e = e.withColumns({"success": ok, **parts, **lists, "components": F.when(ok, F.col("_r")["order"]), "order": F.when(ok, F.col("chosen.form")).otherwise("mixed")})
    changed = F.col("threshold_met") & F.col("votes") & ok & (F.col("alone.form") != F.col("order"))
    return e.withColumns({"changed": F.coalesce(changed, F.lit(False)), "confidence": F.when(F.col("alone").isNull(), F.when(ok, 1.0).otherwise(0.0)).otherwise(confidence(F.col("cands")))}).drop("_c", "_r", "_latin")


def lineage(applied: DataFrame) -> DataFrame:
    """(batch_id, pos, name, from, to, single, result): the names that their batch gave another format, with both readings.

    from and single are the format and text of the best parse by itself, to
    and result those under the batch.  Both come from one pass: the candidates
    of a name hold either reading.
    """
    return applied.where("changed").select("batch_id", "pos", "name", F.col("alone.form").alias("from"), F.col("order").alias("to"), F.col("alone.r.result").alias("single"), "result")


def improvements(applied: DataFrame) -> DataFrame:
    """(batch_id, positions): the rows of each batch whose format the batch changed, in order; batches without one have no row."""
    return applied.where("changed").groupBy("batch_id").agg(F.array_sort(F.collect_list("pos")).alias("positions"))


def confidence(cands: Column) -> Column:
    """Softmax share of the best candidate; 1 if it is alone."""
    top = F.array_max(F.transform(cands, lambda c: c["score"]))
    total = F.aggregate(cands, F.lit(0.0), lambda s, c: s + F.exp(c["score"] - top))
    return F.when(F.size(cands) == 1, 1.0).otherwise(1 / total)


def softmax_window(exploded: DataFrame) -> DataFrame:
    """The same over candidate rows (batch_id, pos, plain), as a window."""
    w = Window.partitionBy("batch_id", "pos")
    top = F.max("plain").over(w)
    return exploded.withColumn("share", F.exp(F.col("plain") - top) / F.sum(F.exp(F.col("plain") - top)).over(w))
