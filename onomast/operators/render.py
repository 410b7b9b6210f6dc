"""Rendering of a chosen parse as ``Given-Name Middle Surname``, with its parts and their order as written.

Steps bind what they find as columns, so that no expression is stated twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import capitalize, letters

NOT_PLAUSIBLE = "given name tokens are not plausibly Chinese"
RESULT = ("result", "surname", "given", "middle", "surname_tokens", "given_tokens", "middle_tokens", "order")


def none() -> Column:
    return F.array().cast("array<string>")


def given_parts(given: Column, plain: bool = False) -> Column:
    """Syllables of the given tokens' facts, in regular case; a part that holds hyphens stays whole.  plain: don't cut tokens that look like surnames."""
    parts = F.flatten(F.transform(given, lambda t: t["parts_plain" if plain else "parts"]))
    bare = F.filter(F.transform(parts, lambda p: F.regexp_replace(p, "^-+|-+$", "")), lambda p: p != "")
    return F.transform(bare, lambda p: F.regexp_replace(capitalize(p), "-+", "-"))


def given_fits(given: Column) -> Column:
    """Every given token is one that a Chinese given name may hold."""
    return (F.size(given) > 0) & F.forall(given, lambda t: t["parts"].isNotNull())


def width(part: Column) -> Column:
    return F.length(F.replace(part, F.lit("-"), F.lit("")))


def run(single: Column) -> Column:
    """How many flags at the head of an array are true, where some are not."""
    return F.greatest(F.array_position(F.transform(single, lambda x: ~x), F.lit(True)) - 1, F.lit(0)).cast("int")


def joined(parts: Column) -> Column:
    """Hyphens between parts of one kind, spaces where single letters stand among longer ones."""
    mixed = F.exists(parts, lambda p: width(p) == 1) & F.exists(parts, lambda p: width(p) > 1)
    return F.array_join(F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.when(mixed, " ").otherwise("-"), p))), "")


def surname_shown(own: Column, paired: Column) -> Column:
    """A compound in two words keeps its space, one in one word its form; other pairs get a hyphen.  own: facts of the surname's tokens."""
    one = F.get(own, F.lit(0))
    caps = F.transform(own, lambda t: t["shown"])
    return F.when(F.size(own) == 1, F.coalesce(one["comp"]["shown"], one["shown"])).when(paired, F.array_join(caps, " ")).otherwise(F.array_join(caps, "-"))


def surname_tokens(own: Column, kind: Column) -> Column:
    return F.when(kind.isin("fused", "hyphen"), F.transform(F.get(own, F.lit(0))["comp"]["parts"], capitalize)).otherwise(F.transform(own, lambda t: t["shown"]))


def component_order(rows: DataFrame, given: str, middle: str, form: Column, out: str = "order") -> DataFrame:
    """Adds the roles in the order in which they were written: given, middle and surname; a role may come twice.

    given: facts of the given tokens; middle: the middle names that were found.
    """
    rows = rows.withColumn("_l", F.flatten(F.transform(given, lambda t: F.transform(F.filter(F.split(t["token"], "-"), lambda x: F.trim(x) != ""), lambda x: F.length(letters(x)) == 1))))
    ones = F.col("_l")
    rows = rows.withColumn("_wide", F.exists(ones, lambda x: ~x))
    rows = rows.withColumns({"_lead": F.when(F.col("_wide"), run(ones)).otherwise(0), "_trail": F.when(F.col("_wide"), run(F.reverse(ones))).otherwise(0)})
    edge = (F.col("_lead") > 0) | (F.col("_trail") > 0)
    m, g = F.array(F.lit("middle")), F.array(F.lit("given"))
    inner = F.when((F.col("_lead") > 0) & (F.col("_trail") > 0), F.concat(m, g, m)).when(F.col("_lead") > 0, F.concat(m, g)).otherwise(F.concat(g, m))
    source, mid = F.lower(letters(F.array_join(F.transform(given, lambda t: t["token"]), ""))), F.lower(letters(F.array_join(middle, "")))
    fused = (mid != "") & (F.length(source) > F.length(mid)) & source.startswith(mid)
    roles = F.when(F.size(middle) == 0, g).when(edge, inner).when(fused, F.concat(m, g)).otherwise(F.concat(g, m))
    rows = rows.withColumn("_roles", roles)
    s = F.array(F.lit("surname"))
    return rows.withColumn(out, F.when(form == "given_first", F.concat("_roles", s)).otherwise(F.concat(s, "_roles"))).drop("_l", "_wide", "_lead", "_trail", "_roles")


def render(rows: DataFrame, choice: str = "choice", plain: bool = False) -> DataFrame:
    """rows (facts, pairs and a choice) with result, surname, given, middle, surname_tokens, given_tokens, middle_tokens and order; null where there is no choice or its given name doesn't fit.

    Single letters before and after the given name's longer parts are middle names.
    """
    c = F.col(choice)
    at = lambda places: F.transform(places, lambda i: F.get(F.col("facts"), i))
    rows = rows.withColumns({"_g": at(c["g"]), "_s": at(c["s"])})
    rows = rows.withColumn("_p", F.when(given_fits(F.col("_g")), given_parts(F.col("_g"), plain)))
    rows = rows.withColumn("_1", F.transform("_p", lambda x: width(x) == 1))
    peel = (F.size("_1") > 1) & F.exists("_1", lambda x: ~x)
    rows = rows.withColumns({"_a": F.when(peel, run(F.col("_1"))).otherwise(0), "_b": F.when(peel, run(F.reverse("_1"))).otherwise(0), "_n": F.size("_1")})
    a, b, n = F.col("_a"), F.col("_b"), F.col("_n")
    paired = F.array_contains("pairs", F.array_min(c["s"]))
    rows = rows.withColumns(
        {
            "_i": F.slice("_p", a + 1, F.greatest(n - a - b, F.lit(0))),
            "middle_tokens": F.concat(F.slice("_p", F.lit(1), a), F.slice("_p", F.greatest(n - b + 1, F.lit(1)), b)),
            "surname": surname_shown(F.col("_s"), paired),
            "surname_tokens": surname_tokens(F.col("_s"), c["kind"]),
        }
    )
    rows = rows.withColumns({"given": joined(F.col("_i")), "middle": F.array_join("middle_tokens", " "), "given_tokens": F.flatten(F.transform("_i", lambda x: F.split(x, "-")))})
    rows = rows.withColumn("result", F.when(F.col("_p").isNotNull() & (n > 0), F.trim(F.concat_ws(" ", "given", F.when(F.col("middle") != "", F.col("middle")), "surname"))))
    return component_order(rows, "_g", "middle_tokens", c["form"]).drop("_g", "_s", "_p", "_1", "_a", "_b", "_n", "_i")
