"""Papers served: each against its venue's pool, or alone, with the reading that is returned."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..lexicon.data import Lexicon
from ..operators import batch, routing
from ..operators.evidence import OF_BATCH
from .names import FEW, analysed, in_state, patterns_of, pp_columns, weighed

ROLES = ("surname", "given", "middle")
PARSED = "struct<result:string,surname:string,given:string,middle:string>"


def displayed() -> Column:
    """(role, token) in the order as written: an earlier place of a role takes one of its tokens, its last place the rest."""
    order = F.col("components")

    def at(role: Column, i: Column) -> Column:
        before = F.size(F.filter(F.slice(order, F.lit(1), i), lambda r: r == role))
        later = F.exists(F.slice(order, i + 2, F.greatest(F.size(order) - i - 1, F.lit(0))), lambda r: r == role)
        tokens = F.when(role == "surname", F.col("surname_tokens")).when(role == "given", F.col("given_tokens")).otherwise(F.col("middle_tokens"))
        part = F.slice(tokens, before + 1, F.when(later, 1).otherwise(F.greatest(F.size(tokens) - before, F.lit(0))))
        return F.transform(part, lambda t: F.struct(role.alias("role"), t.alias("token")))

    return F.flatten(F.transform(order, at))


def as_typed(rows: DataFrame, out: str = "typed") -> DataFrame:
    """rows of results (with token lists and components) and the reading that keeps their order: the last token is the surname.

    Null for failures, single tokens and names that end in a middle name.
    """
    rows = rows.withColumn("_d", displayed())
    d, n = F.col("_d"), F.size("_d")
    own = F.size("surname_tokens")
    last = F.slice(d, F.greatest(n - own + 1, F.lit(1)), own)
    fits = (n >= 2) & (F.element_at(d, -1)["role"] != "middle")
    head = F.slice(d, F.lit(1), F.greatest(n - 1, F.lit(0)))
    rows = rows.withColumn("_g", F.transform(F.filter(head, lambda x: x["role"] != "middle"), lambda x: x["token"]))
    g = F.col("_g")
    # A compound surname in one word stays one where it now stands before.
    whole = (own > 1) & ~F.col("surname").contains(" ") & (F.slice(g, F.lit(1), own) == F.col("surname_tokens"))
    g = F.when(whole, F.concat(F.array("surname"), F.slice(g, own + 1, F.greatest(F.size(g) - own, F.lit(0))))).otherwise(g)
    middle = F.array_join(F.transform(F.filter(head, lambda x: x["role"] == "middle"), lambda x: x["token"]), " ")
    surname, given = F.element_at(d, -1)["token"], F.array_join(g, "-")
    moved = F.struct(F.concat_ws(" ", given, F.when(middle != "", middle), surname).alias("result"), surname.alias("surname"), given.alias("given"), middle.alias("middle"))
    same = F.struct("result", "surname", "given", "middle")
    kept = F.forall(last, lambda x: x["role"] == "surname")
    typed = F.when(F.col("success") & (own > 0) & fits, F.when(kept, same).when(F.size(g) > 0, moved)).cast(PARSED)
    return rows.withColumn(out, typed).drop("_d", "_g")


def side_of(rows: DataFrame, patterns: DataFrame, key: str, side: str) -> DataFrame:
    """rows with the state and the pattern of their batch, which key names, on one side of the router."""
    cells = [F.col(c).alias(f"{side}_{n}") for c, n in OF_BATCH.items()]
    return rows.join(patterns.select(F.col("batch_id").alias(key), batch.state().alias(f"{side}_state"), *cells), key)


def routed(rows: DataFrame, readings: DataFrame) -> DataFrame:
    """rows (paper_id, pos, name, and both sides) with their readings on both, and routed."""
    for s in routing.SIDES:
        own = [c for c in (*routing.PER_SIDE, "selected_surname_frequency_ratio") if c not in OF_BATCH.values()]
        rows = in_state(rows, readings, f"{s}_state", {c: f"{s}_{c}" for c in own})
    out = routing.route_final(routing.route_pp_vys(rows))
    return out.select(F.col("paper_id").cast("string").alias("paper_id"), "pos", "name", "pp_result", "vys_result", "router_prediction", "router_reason", "input_order_candidate", "final_result")


def papers_and_pools(names: DataFrame, pools: DataFrame, lex: Lexicon | None = None, threshold: float | None = None) -> DataFrame:
    """Names of papers routed between the paper and its pool.

    names: (paper_id, pos, name); pools: (paper_id, pos, pool_id, pool_pos,
    name), a row for each name's place in a pool, with the same names; a pool
    may hold the names of many papers.  Gives paper_id, pos, name,
    router_prediction, router_reason and final_result; abstentions take the
    side that keeps the order as written.
    """
    lex, limit = lex or Lexicon.builtin(names.sparkSession), batch.THRESHOLD if threshold is None else threshold
    venues = pools.select("pool_id", "pool_pos", "name").distinct()
    ballots, readings = weighed(names.select("name").unionByName(venues.select("name")), lex)
    pp = patterns_of(names.withColumnRenamed("paper_id", "batch_id"), ballots, limit)
    vys = patterns_of(venues.withColumnRenamed("pool_id", "batch_id"), ballots, limit)
    rows = pools.select("paper_id", "pos", "pool_id", "pool_pos").join(names.select("paper_id", "pos", "name"), ["paper_id", "pos"])
    rows = rows.join(venues.withColumnRenamed("name", "_name"), ["pool_id", "pool_pos"])
    same = F.col("name") == F.col("_name")
    rows = rows.withColumn("name", F.when(same, F.col("name")).otherwise(F.raise_error(F.lit("pp and vys must hold the same names")).cast("string"))).drop("_name")
    return routed(side_of(side_of(rows, pp, "paper_id", "pp"), vys, "pool_id", "vys"), readings)


def papers_in_pools(names: DataFrame, pool_of: DataFrame, lex: Lexicon | None = None, threshold: float | None = None, known: DataFrame | None = None) -> DataFrame:
    """As ``papers_and_pools``, where all names of a paper are in its pool.

    names: (paper_id, pos, name), a row for each place; pool_of: (paper_id,
    pool_id), of which repeated rows count once; papers without a pool are left
    out.  known: the names alone, where they are had at less cost.  A row stays
    where its paper is: pools meet it as patterns.
    """
    lex, limit = lex or Lexicon.builtin(names.sparkSession), batch.THRESHOLD if threshold is None else threshold
    few = pool_of.select("pool_id").distinct().limit(FEW + 1).count() <= FEW
    ballots, readings = weighed(names if known is None else known, lex)
    rows = names.join(pool_of.distinct(), "paper_id")
    pp = patterns_of(names.withColumnRenamed("paper_id", "batch_id"), ballots, limit)
    vys = patterns_of(rows.withColumnRenamed("pool_id", "batch_id"), ballots, limit)
    rows = side_of(rows, pp, "paper_id", "pp")
    return routed(side_of(rows, F.broadcast(vys) if few else vys, "pool_id", "vys"), readings)


def papers_alone(names: DataFrame, lex: Lexicon | None = None, known: DataFrame | None = None) -> DataFrame:
    """Names of papers (batch_id, pos, name) routed by the paper alone, with the reading that is returned.

    An abstention returns the order as typed, but for spaced Han names, whose
    own parse keeps it; null where there is no such reading.
    """
    rows, _ = analysed(names, lex or Lexicon.builtin(names.sparkSession), known=known, also=as_typed)
    rows = routing.route_pp(rows.withColumns(pp_columns()))
    own = F.struct("result", "surname", "given", "middle").cast(PARSED)
    spaced = F.col("router_reason") == "spaced_cjk_zero_batch_surname_first"
    final = F.when(~F.col("success") | (F.col("router_prediction") == "not_person"), None).when((F.col("router_prediction") == "pp") | spaced, own).otherwise(F.col("typed"))
    return rows.withColumn("final", final).select("batch_id", "pos", "name", "success", "result", "router_prediction", "router_reason", F.col("final.result").alias("final_result"), F.col("final.surname").alias("final_surname"))
