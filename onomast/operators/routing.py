"""Routing of a name between two contexts: its paper (pp) and its venue's pool (vys).

Each rule set is one chain of conditions over the columns of a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import among, route_tokens, strip_marks
from ..lexicon import fixed

SIDES = ("pp", "vys")
PER_SIDE = (
    "success", "result", "selected_format", "selected_surname_position", "selected_surname_frequency",
    "batch_dominant_format", "batch_threshold_met", "batch_total_count", "batch_confidence", "batch_vote_margin",
)
PP_VYS_COLUMNS = ("name", *(f"{s}_{c}" for s in SIDES for c in PER_SIDE), "pp_selected_surname_frequency_ratio")
PP_COLUMNS = (
    "pp_success", "pp_result_token_count", "selected_format", "selected_surname_position", "selected_surname_token_count",
    "batch_total_count", "selected_surname_frequency", "has_cjk", "has_latin", "cjk_has_space", "raw_tokens",
)

WEAK_OR_CONFLICTING = "weak_or_conflicting_evidence"
FAVORS_PP, FAVORS_VYS = "endpoint_frequency_strongly_favors_pp", "endpoint_frequency_strongly_favors_vys"
STRONG_PP, STRONG_VYS = "strong_pp_paper_context", "strong_vys_batch_context"


def require(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    lost = [c for c in columns if c not in df.columns]
    if lost:
        raise ValueError(f"missing columns: {', '.join(lost)}")
    return df


def align(pp: DataFrame, vys: DataFrame, on: tuple[str, ...] = ("batch_id", "pos")) -> DataFrame:
    """Joins the two contexts of each name; a row that only one side has, or whose names differ, is an error when it is read."""
    a = pp.select(*on, *[F.col(c).alias(f"pp_{c}") for c in pp.columns if c not in on])
    b = vys.select(*on, *[F.col(c).alias(f"vys_{c}") for c in vys.columns if c not in on])
    both = a.join(b, list(on), "full_outer")
    same = F.col("pp_name").eqNullSafe(F.col("vys_name"))
    return both.withColumn("name", F.when(same, F.col("pp_name")).otherwise(F.raise_error(F.lit("pp and vys must hold the same names")).cast("string"))).drop("pp_name", "vys_name")


def _reasons(*rules: tuple[Column, str, str]) -> Column:
    """struct(route, reason) of the first rule that holds; the last rule's condition isn't read."""
    out = F.struct(F.lit(rules[-1][1]).alias("route"), F.lit(rules[-1][2]).alias("reason"))
    for cond, route, reason in reversed(rules[:-1]):
        out = F.when(cond, F.struct(F.lit(route).alias("route"), F.lit(reason).alias("reason"))).otherwise(out)
    return out


def old_rule() -> Column:
    tokens = lambda c: F.size(route_tokens(F.coalesce(c, F.lit(""))))
    failed = ~F.col("pp_success") | ~F.col("vys_success") | (tokens("pp_result") > 4) | (tokens("vys_result") > 4)
    p, v = F.coalesce("pp_selected_surname_frequency", F.lit(0.0)), F.coalesce("vys_selected_surname_frequency", F.lit(0.0))
    ratio = F.when(p > 0, v / p).when(v > 0, float("inf")).otherwise(0.0)
    ends = [F.col(f"{s}_selected_surname_position") for s in SIDES]
    apart = ends[0].isin("first", "last") & ends[1].isin("first", "last") & (ends[0] != ends[1])
    margin = F.col("vys_batch_vote_margin")
    back = (
        (apart & (ratio >= 5.0) & (margin >= 0.55))
        | ((F.col("pp_batch_total_count") <= 3) & (F.col("vys_batch_dominant_format") == "given_first") & (margin >= 0.65))
        | ((F.col("pp_batch_vote_margin") <= 0.20) & (margin >= 0.35))
    )
    return _reasons(
        (failed, "not_person", "garbage_or_failed_parse"),
        (F.col("pp_result").eqNullSafe(F.col("vys_result")), "pp", "pp_vys_same"),
        (back, "vys", "vys_backoff_rule"),
        (F.lit(True), "pp", "default_pp"),
    )


def _strong(side: str, least: float) -> Column:
    c = lambda x: F.col(f"{side}_{x}")
    return c("batch_threshold_met") & (c("batch_dominant_format") == c("selected_format")) & (c("batch_total_count") >= 3) & (c("batch_confidence") >= least)


def clean_rule() -> Column:
    ratio = F.col("pp_selected_surname_frequency_ratio")
    return _reasons(
        (ratio <= 0.10, "vys", FAVORS_VYS),
        (ratio >= 20.0, "pp", FAVORS_PP),
        (_strong("pp", 0.70), "pp", STRONG_PP),
        (_strong("vys", 0.85), "vys", STRONG_VYS),
        (F.lit(True), "abstain", WEAK_OR_CONFLICTING),
    )


def input_order() -> Column:
    """The side whose format keeps the order as written, if just one does."""
    p, v = F.col("pp_selected_format") == "given_first", F.col("vys_selected_format") == "given_first"
    return F.when(p & ~v, "pp").when(v & ~p, "vys").otherwise("unknown")


def _changed(old: str, new: str) -> Column:
    return (F.col("old_prediction") == old) & (F.col("new_prediction") == new)


def base_rule() -> Column:
    """Of seven rules the last that holds counts, so they are tried from the last."""
    ratio, n, why, order = F.col("pp_selected_surname_frequency_ratio"), F.col("pp_batch_total_count"), F.col("new_reason"), F.col("input_order_candidate")
    unknown = ratio.isNull()
    weak = unknown | (ratio <= 5.0)
    abstain = (
        ((order == "pp") & _changed("pp", "pp"))
        | ((order == "vys") & (why == FAVORS_VYS) & (n <= 2))
        | ((order == "vys") & (why == WEAK_OR_CONFLICTING) & (n <= 1) & weak)
        | ((order == "vys") & (why == STRONG_VYS) & (n <= 2) & weak)
    )
    turned = _changed("vys", "pp")
    allowed = unknown | (ratio <= 1.0) | ((ratio > 5.0) & (ratio <= 20.0))
    return _reasons(
        (abstain, "abstain", "reliable_input_order_abstain"),
        (turned & (why == STRONG_PP) & allowed, "pp", "strong_pp_allowed_ratio"),
        (turned & (why == FAVORS_PP) & (n >= 3), "pp", "endpoint_pp_with_real_paper_votes"),
        (turned, "vys", "old_vys_new_pp_default_vys"),
        (_changed("vys", "abstain"), "vys", "old_vys_new_abstain"),
        (_changed("pp", "vys"), "vys", "old_pp_new_vys"),
        (_changed("vys", "vys"), "vys", "old_new_vys"),
        (F.lit(True), "pp", "default_pp"),
    )


def plus_rule() -> Column:
    """Later evidence for the paper; null reason where there is none."""
    n, why = F.col("pp_batch_total_count"), F.col("new_reason")
    return _reasons(
        (_changed("pp", "vys") & (why == STRONG_VYS) & (n >= 6), "pp", "larger_pp_paper_overrides_vys_batch"),
        (_changed("vys", "pp") & (why == FAVORS_PP) & (n == 2) & (F.col("pp_batch_confidence") >= 0.85), "pp", "endpoint_pp_high_conf_two_vote"),
        (F.lit(True), None, None),
    )


def prior_rule() -> Column:
    """Shapes of names whose order is known: the side that has it, if the sides differ."""
    tokens = F.transform(route_tokens(F.col("name")), lambda t: F.lower(strip_marks(t)))
    n = F.size(tokens)
    last = F.get(tokens, n - 1)
    syllables = F.filter(F.flatten(F.transform(F.slice(tokens, 1, F.greatest(n - 1, F.lit(0))), lambda t: F.split(t, "[-']"))), lambda x: x != "")
    known = lambda words, x: F.array_contains(among(words), x)
    repeated = (n >= 3) & (last == F.get(tokens, n - 2)) & known(fixed.PRIOR_CHINESE, F.get(tokens, F.lit(0)))
    enough = (F.size(syllables) + 1 >= 3) & ~repeated
    korean = enough & known(fixed.PRIOR_KOREAN, last) & F.forall(syllables, lambda x: (F.length(x) == 1) | known(fixed.PRIOR_KOREAN_GIVEN, x))
    cantonese = enough & known(fixed.PRIOR_CANTONESE, last) & F.forall(syllables, lambda x: known(fixed.PRIOR_CANTONESE_GIVEN, x))
    p, v = F.col("pp_selected_format"), F.col("vys_selected_format")
    pick = lambda form, side: (p == form) & (v != form) if side == "pp" else (v == form) & (p != form)
    rules = []
    for cond, form, reason in (
        (repeated, "surname_first", "name_prior_repeated_tail_given_surname_first"),
        (korean, "given_first", "name_prior_korean_given_first_three_token"),
        (cantonese, "given_first", "name_prior_cantonese_given_first"),
    ):
        rules += [(cond & pick(form, side), side, reason) for side in SIDES]
    return _reasons(*rules, (F.lit(True), None, None))


def route_pp_vys(rows: DataFrame) -> DataFrame:
    """Rows with PP_VYS_COLUMNS get the two earlier decisions, input_order_candidate, router_prediction and router_reason."""
    rows = require(rows, PP_VYS_COLUMNS).withColumns({"_old": old_rule(), "_new": clean_rule()})
    person = F.col("_old.route") != "not_person"
    rows = rows.withColumns(
        {
            "old_prediction": F.col("_old.route"),
            "old_reason": F.col("_old.reason"),
            "new_prediction": F.when(person, F.col("_new.route")).otherwise("not_person"),
            "new_reason": F.when(person, F.col("_new.reason")).otherwise(WEAK_OR_CONFLICTING),
            "input_order_candidate": F.when(person, input_order()).otherwise("unknown"),
        }
    )
    rows = rows.withColumns({"_base": base_rule(), "_plus": plus_rule(), "_prior": prior_rule()})
    pick = lambda f: F.when(~person, "not_person").otherwise(F.coalesce(f"_prior.{f}", f"_plus.{f}", f"_base.{f}"))
    rows = rows.withColumns({"router_prediction": pick("route"), "router_reason": pick("reason")})
    return rows.drop("_old", "_new", "_base", "_plus", "_prior")


def pp_rule() -> Column:
    """The paper alone: accepted, or abstained from, and why."""
    few = F.col("batch_total_count") < 2
    freq, raw = F.col("selected_surname_frequency"), F.col("raw_tokens")
    han, latin, pair = F.col("has_cjk"), F.col("has_latin"), F.col("pp_result_token_count") == 2
    start = (F.col("selected_format") == "surname_first") & (F.col("selected_surname_position") == "first")
    spaced = start & few & han & ~latin & F.col("cjk_has_space")
    mixed = few & han & latin & (raw >= 3)
    clean = pair & (F.col("selected_format") == "given_first") & han & latin & (raw == 2) & (freq >= 2500.0)
    return _reasons(
        (~F.col("pp_success"), "not_person", "not_person"),
        (clean, "pp", "clean_bilingual_given_first"),
        (start & pair & ~mixed & ~spaced, "pp", "surname_first_two_token"),
        (start & (F.col("selected_surname_token_count") > 1) & ~mixed & ~spaced, "pp", "compound_surname_first_input_start"),
        (spaced, "abstain", "spaced_cjk_zero_batch_surname_first"),
        (few & (freq < 500.0), "abstain", "weak_zero_batch"),
        (mixed, "abstain", "zero_batch_mixed_long"),
        (F.lit(True), "abstain", "default_abstain"),
    )


def route_pp(rows: DataFrame) -> DataFrame:
    rows = require(rows, PP_COLUMNS).withColumn("_r", pp_rule())
    return rows.withColumns({"router_prediction": F.col("_r.route"), "router_reason": F.col("_r.reason")}).drop("_r")


def route_final(rows: DataFrame) -> DataFrame:
    """The result of the side that was chosen; an abstention takes the side that keeps the order as written."""
    side = F.when(F.col("router_prediction") == "abstain", F.col("input_order_candidate")).otherwise(F.col("router_prediction"))
    out = F.when(side == "pp", F.col("pp_result")).when(side == "vys", F.col("vys_result"))
    lost = F.when((F.col("router_prediction") == "abstain") & (side == "unknown"), F.raise_error(F.lit("an abstention needs a side that keeps the order")).cast("string"))
    return rows.withColumn("final_result", F.coalesce(lost, out))
