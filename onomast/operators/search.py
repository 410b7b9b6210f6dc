"""The search for a name's parse in both orders of its tokens.

Candidates of either order are rows.  The best of an order is found by the
score that its own order gives, without a hint; both winners are then scored
on the tokens as they were written, with the hint, and compared.  What an order
does to a score is the only difference between the two: names without a
compound surname in two words mostly win as written, with a margin of zero.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lexicon.data import Lexicon
from .parse import CANDIDATE, POOR, WEIGHTS, as_list, base_score, bound, candidates, fallbacks, order_bonus, pair_compounds


def both_orders(named: DataFrame, lex: Lexicon) -> DataFrame:
    """(name, way, facts, pairs, hint, c): every candidate of the tokens as written (way 0) and backwards (1), in places of its own order."""
    facts, n = F.col("facts"), F.size("facts")
    rows = named.select("name", "facts", F.coalesce("hint", F.lit(False)).alias("hint")).where(F.coalesce(n, F.lit(0)) >= 2)
    rows = rows.withColumn("pairs", pair_compounds(facts, lex))
    fore = F.struct(F.lit(0).alias("way"), facts.alias("facts"), F.col("pairs").alias("pairs"))
    rear = F.struct(F.lit(1).alias("way"), F.reverse(facts).alias("facts"), F.transform("pairs", lambda p: (n - 2 - p).cast("int")).alias("pairs"))
    rows = rows.select("name", "hint", F.explode(F.array(fore, rear)).alias("o")).select("name", "hint", "o.way", "o.facts", "o.pairs")
    own = candidates(F.col("facts"), F.col("pairs"))
    every = F.when(F.size(own) > 0, F.concat(own, fallbacks(F.col("facts")))).otherwise(fallbacks(F.col("facts")))
    return rows.withColumn("c", F.explode(every))


def in_order(rows: DataFrame, lex: Lexicon, w: tuple[float, ...]) -> DataFrame:
    """Candidate rows (facts, c, hint) with score and fits, which is false for a Western initial."""
    rows = order_bonus(base_score(bound(rows), lex, w), w)
    facts, c = F.col("facts"), F.col("c")
    long = F.exists(facts, lambda t: F.length(t["token"]) > 3) & ~F.exists(facts, lambda t: (F.length(t["token"]) > 3) & t["is_surname"])
    initial = F.exists(c["g"], lambda i: F.length(F.get(facts, i)["token"]) == 1) & long & (c["k"] < 7)
    return rows.withColumns({"score": F.col("base") + F.col("b_guard"), "fits": ~F.coalesce(initial & (F.col("slogp") < POOR), F.lit(False))})


def two_order_search(named: DataFrame, lex: Lexicon, w: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """One row for each name that has a parse: name, surname, given, kind, used_original, score, margin.

    named: (name, facts, hint), a row for each distinct name.  score is that of
    the parse on the tokens as written; margin what it is better by than the
    winner of the other order, null where that order has none.  Of equal
    scores the order as written wins.  Within an order ties go to the parse
    that keeps a pair of tokens given-first, then to the greater list of
    tokens; a fallback counts only where there is no other parse, the last
    token's before the first's.  Names of fewer than two tokens, and those
    without a candidate, have no row.
    """
    rows = in_order(both_orders(named, lex).withColumnRenamed("hint", "asked").withColumn("hint", F.lit(False)), lex, w)
    c, n = F.col("c"), F.size("facts")
    align = F.when((n == 2) & (F.col("kind") == "single") & (F.col("at") == 1), 1).otherwise(0)
    tie = F.concat_ws("|", as_list(F.col("facts"), c["s"]), as_list(F.col("facts"), c["g"]))
    plain = c["k"] < 7
    # Any parse of its own before a fallback; of these the last token as surname comes first.
    rank = F.struct(plain.alias("plain"), F.when(plain, F.col("score")).otherwise(-c["k"].cast("double")).alias("v"), align.alias("align"), tie.alias("tie"))
    entry = F.struct(rank.alias("rank"), c.alias("c"), F.col("facts").alias("facts"), F.col("asked").alias("hint"))
    won = rows.where("fits").groupBy("name", "way").agg(F.max_by(entry, rank).alias("e")).select("name", "way", "e.c", "e.facts", "e.hint")
    # Back to the places and the order of the tokens as written.
    turn = lambda places: F.transform(places, lambda i: (n - 1 - i).cast("int"))
    back = F.col("way") == 1
    there = F.struct(c["k"].alias("k"), F.when(back, turn(c["s"])).otherwise(c["s"]).alias("s"), F.when(back, turn(c["g"])).otherwise(c["g"]).alias("g"), c["kind"].alias("kind")).cast(CANDIDATE)
    won = won.withColumn("c", there).withColumn("facts", F.when(back, F.reverse("facts")).otherwise(F.col("facts")))
    # Given tokens are summed in another order there, which shall not break a tie.
    won = in_order(won, lex, w).withColumn("score", F.round("score", 9))
    words = lambda places: F.transform(places, lambda i: F.get(F.col("facts"), i)["token"])
    got = won.select("name", "way", "score", words(c["s"]).alias("surname"), words(c["g"]).alias("given"), "kind")
    last = got.groupBy("name").agg(F.max_by(F.struct("way", "score", "surname", "given", "kind"), F.struct("score", -F.col("way"))).alias("x"), F.min("score").alias("least"), F.count("*").alias("orders"))
    return last.select("name", "x.surname", "x.given", "x.kind", (F.col("x.way") == 0).alias("used_original"), "x.score", F.when(F.col("orders") == 2, F.col("x.score") - F.col("least")).alias("margin"))
