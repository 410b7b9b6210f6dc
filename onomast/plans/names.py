"""Whole plans: single names, batches of names, and papers with their pools.

All that a name says by itself is worked out once for each distinct name
(``name_table``), and what it says under each kind of pattern that its batch
may have (``weighed``).  Batches count a few numbers of each name; rows stay
narrow until readings join them by the name and the state of their batch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import CJK, all_caps, among, camel_pair, cjk_chunks, comma_swap, compact_han, norm, paren_hint, preprocess, route_tokens, tokenize, unsplit
from ..lexicon.data import Lexicon
from ..operators import batch, ethnicity, gates, routing, structural
from ..operators.evidence import TOLD, evidence, told
from ..operators.facts import name_facts, spaced_tables, strings, token_facts
from ..operators.japanese import builtin_model, probabilities
from ..operators.parse import scored
from ..operators.render import NOT_PLAUSIBLE, render
from ..operators.render import RESULT as PARTS
from .stage import keep

UNKNOWN = "name not recognised as Chinese"
UNPARSED = "no valid parse found"
RESULT = ["batch_id", "pos", "name", "success", "result", "surname", "given", "middle", "order", "error"]
R = "struct<result:string,surname:string,given:string,middle:string,surname_tokens:array<string>,given_tokens:array<string>,middle_tokens:array<string>,order:array<string>>"


def prepared(names: DataFrame) -> DataFrame:
    """Distinct names (name) cleaned and cut into tokens, with the gates that need no lexicon."""
    n = names.select("name").distinct()
    # A text too long for a name is no input of the patterns, some of which need stack for each repetition.
    text = F.when(gates.gate_length(F.col("name")), F.when(F.col("name").isNotNull(), "")).otherwise(F.col("name"))
    n = n.withColumns({"gate": F.when(gates.gate_length(F.col("name")), gates.LENGTH).otherwise(gates.failure(text)), "cleaned": preprocess(text), "camel": camel_pair(unsplit(text)), "hint": F.coalesce(paren_hint(text), F.lit(False))})
    n = n.withColumns({"tokens": tokenize(comma_swap(F.col("cleaned"))), "compact": compact_han(text)})
    spaced = F.trim(text).rlike(r"(?U)\s")
    return n.withColumns({"has_han": F.coalesce(structural.has_han(F.col("cleaned")), F.lit(False)), "all_han": F.coalesce((F.col("compact") != "") & ~spaced, F.lit(False)), "camel": F.coalesce("camel", F.lit(False))})


def han_gate(rows: DataFrame, lex: Lexicon) -> DataFrame:
    """Rows with Han whose gate also rejects initials before a transliteration."""
    dominant = among(sorted(k for k, v in _ev_dominant(lex).items()))
    pure = among(sorted(set(spaced_tables(lex)[0].values())))
    first = F.get(F.col("py"), F.lit(0))["p"]
    two = F.concat_ws(" ", norm(first), norm(F.get(F.col("py"), F.lit(1))["p"]))
    looks = (F.size("py") >= 2) & (F.array_contains(dominant, first) | F.array_contains(pure, two))
    bad = gates.gate_initial_translit(F.col("name"), F.coalesce(looks, F.lit(False)))
    return rows.withColumn("gate", F.coalesce("gate", F.when(bad, gates.PERSON)))


def _ev_dominant(lex: Lexicon) -> dict[str, float]:
    """Spellings that are dominant surnames: a few dozen."""
    if "dominant" not in lex.known:
        ppm = F.greatest("ppm", "written_ppm")
        lex.known["dominant"] = {r[0]: r[1] for r in lex.keys().where(ppm >= ethnicity.DOMINANT).select("key", ppm).collect()}
    return lex.known["dominant"]


def name_table(names: DataFrame, lex: Lexicon, japanese: DataFrame | None = None) -> DataFrame:
    """One row for each distinct name (name, of any frame): failed, script, tokens, facts, cands, choice and r.

    japanese: (name, probability) of names in Han alone, where a model is at hand; else the built-in one says.
    """
    p = keep(prepared(names), "prepared")
    lists = gates.author_lists(p.where("gate is null"), lex).withColumn("listed", F.lit(True))
    latin = p.where("not has_han").join(lists, "name", "left").withColumn("gate", F.coalesce("gate", F.when(F.col("listed"), gates.PERSON))).drop("listed")
    latin = latin.withColumn("roman", structural.roman_parts(F.col("tokens")))
    some = not p.where("has_han").isEmpty()
    rows, han = latin, None
    if some:
        han = han_gate(structural.readings(p.where("has_han"), lex), lex)
        fused = han.select(F.explode(structural.roman_parts(F.col("mix"))).alias("s"))
        han = keep(structural.with_roman(han, strings(fused, lex).select("s", "split")), "han")
        rows = latin.unionByName(han.select(*latin.columns))
    facts = keep(token_facts(rows.where("gate is null").select(F.explode("roman").alias("token")), lex, keep), "facts")
    named = keep(name_facts(rows, facts), "named")
    s = scored(named, lex, keep=keep)
    if some:
        mine = s.where("has_han").join(han.select("name", "mix", "py", "latin"), "name")
        mine = render(structural.structural(mine.drop("r"), lex, keep), "choice", plain=True).withColumn("r", F.struct(*PARTS)).drop(*PARTS, "mix", "py", "latin", "aligned")
        s = plain_names(s.where("not has_han"), lex).unionByName(mine)
    else:
        s = plain_names(s, lex)
    # A Chinese compound surname outweighs the model.
    model = F.lit(None).cast("double")
    if some and japanese is None:
        bare = han.where("compact <> ''").select("name", "compact")
        judged = probabilities(builtin_model(lex.spark), bare.select(F.col("compact").alias("name"))).withColumnRenamed("name", "compact")
        japanese = keep(bare.join(judged, "compact").select("name", "probability"), "japanese")
    if japanese is not None:
        s = s.join(japanese.select("name", F.col("probability").alias("_jp")), "name", "left")
        model = F.when(F.col("compact") != "", F.col("_jp"))
    head = F.concat_ws(" ", F.get("facts", F.lit(0))["norm"], F.get("facts", F.lit(1))["norm"])
    compound = (F.size("facts") >= 3) & F.array_contains(among(sorted(set(spaced_tables(lex)[0].values()))), head)
    chance = F.when(~F.coalesce(compound, F.lit(False)), model)
    s = ethnicity.classified(s, chance)
    s = s.withColumn("failed", F.coalesce("gate", F.when(F.coalesce(F.size("roman"), F.lit(0)) < 2, gates.SHORT), F.col("foreign"))).withColumn("caps", F.coalesce(all_caps(F.col("roman")), F.lit(False)))
    return s.select("name", "gate", "failed", "script", "hint", "has_han", "caps", "roman", "facts", "pairs", "cands", "choice", "r")


def plain_names(s: DataFrame, lex: Lexicon) -> DataFrame:
    """Latin names: a pair cut from one token at its capitals is read by the frequencies of its two parts."""
    by_case = F.when(F.col("camel"), structural.camel_pair_parse(F.col("facts"), lex))
    s = s.withColumns({"script": F.lit("latin_only"), "choice": F.col("choice").cast(structural.PARSE), "_cc": by_case})
    turned = F.get(F.filter("cands", lambda c: (c["s"] == F.col("_cc.s")) & (c["g"] == F.col("_cc.g")) & (c["kind"] == F.col("_cc.kind"))), F.lit(0))
    # What the pair's parse gives is among the candidates, if its surname can be one at all.
    s = s.withColumn("_tr", F.when(F.col("_cc").isNotNull(), turned))
    return s.withColumns({"r": F.coalesce(F.col("_tr.r"), F.col("r")), "choice": F.when(F.col("_tr").isNotNull(), F.col("_cc")).otherwise(F.col("choice"))}).drop("_cc", "_tr")


def single_result(t: DataFrame) -> DataFrame:
    """Adds success, the parts of the result and error of each name by itself; a failure has an empty result."""
    error = F.coalesce("failed", F.when(F.col("choice").isNull(), UNKNOWN), F.when(F.col("r.result").isNull(), NOT_PLAUSIBLE))
    return shown(t.withColumn("error", error), F.col("r"), F.col("choice.form"))


def shown(rows: DataFrame, r: Column, form: Column) -> DataFrame:
    """rows (error) with success, result, surname, given, middle and order of r, empty under an error."""
    ok = F.col("error").isNull()
    text = {c: F.when(ok, r[c]).otherwise("") for c in ("result", "surname", "given", "middle")}
    return rows.withColumns({"success": ok, **text, "order": F.when(ok, form).otherwise("mixed")})


def normalize_names(names: DataFrame, lex: Lexicon | None = None, japanese: DataFrame | None = None) -> DataFrame:
    """Each name by itself, null names too.  names: batch_id, pos, name."""
    lex = lex or Lexicon.builtin(names.sparkSession)
    table = single_result(name_table(names, lex, japanese)).select("name", "success", "result", "surname", "given", "middle", "order", "error")
    table = keep(table, "names")
    out = names.select("batch_id", "pos", "name").join(table, names["name"].eqNullSafe(table["name"]), "left").drop(table["name"])
    return out.select(*RESULT)


#: So many rows of distinct names are sent to every task of a join; more are dealt by name.
FEW = 1 << 17


def near(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if table.limit(FEW + 1).count() <= FEW else table


def weighed(names: DataFrame, lex: Lexicon, japanese: DataFrame | None = None, also=None) -> tuple[DataFrame, DataFrame]:
    """(ballots, readings) of the distinct names of a frame: what each adds to a batch's sums, and how it is read in each of ``batch.STATES``.

    also: adds columns (ALSO) to readings.
    """
    table = keep(batch.entries(single_result(name_table(names, lex, japanese))), "names")
    read = told(batch.in_states(table), lex)
    read = also(read) if also else read
    alone = F.struct(F.col("alone.form").alias("form"), F.struct(F.col("alone.r.result").alias("result")).alias("r"))
    extra = [c for c in ALSO if c in read.columns]
    readings = read.select("name", "state", *RESULT[3:], *PARSED, alone.alias("alone"), *TOLD, *extra)
    return near(keep(batch.ballots(table, "name"), "ballots")), near(keep(readings, "readings"))


PARSED = ("surname_tokens", "given_tokens", "middle_tokens", "components", "confidence", "changed")
ALSO = ("typed",)


def patterns_of(names: DataFrame, ballots: DataFrame, threshold: float = batch.THRESHOLD, minimum: int = batch.MIN_BATCH) -> DataFrame:
    """The pattern of each batch of names (batch_id, name)."""
    b = ballots.withColumnRenamed("name", "_name")
    rows = names.select("batch_id", "name").join(b, F.col("name").eqNullSafe(F.col("_name")), "left")
    return batch.pattern(batch.tally(rows), threshold, minimum)


def in_state(rows: DataFrame, readings: DataFrame, state: str = "state", columns: dict[str, str] | None = None) -> DataFrame:
    """rows (name, and a column of that state) with their readings: all columns of them, or those that are named, renamed."""
    cells = [F.col(c).alias(n) for c, n in columns.items()] if columns else [c for c in readings.columns if c not in ("name", "state")]
    r = readings.select(F.col("name").alias("_name"), F.col("state").alias("_state"), *cells)
    return rows.join(r, F.col("name").eqNullSafe(F.col("_name")) & (F.col(state) == F.col("_state")), "left").drop("_name", "_state")


def analysed(names: DataFrame, lex: Lexicon, threshold: float = batch.THRESHOLD, minimum: int = batch.MIN_BATCH, japanese: DataFrame | None = None, known: DataFrame | None = None, also=None) -> tuple[DataFrame, DataFrame]:
    """(rows with readings, evidence and their batch's pattern; patterns).  known: the same names (name), where they are had at less cost."""
    ballots, readings = weighed(names if known is None else known, lex, japanese, also)
    patterns = patterns_of(names, ballots, threshold, minimum)
    rows = batch.under(names.select("batch_id", "pos", "name"), patterns)
    return in_state(rows.withColumn("state", batch.state()), readings), patterns


def batch_improvements(names: DataFrame, lex: Lexicon | None = None, threshold: float = batch.THRESHOLD, minimum: int = batch.MIN_BATCH) -> DataFrame:
    """The names (batch_id, pos, name) that their batch reads otherwise than they read by themselves; see ``batch.lineage``."""
    return batch.lineage(analysed(names, lex or Lexicon.builtin(names.sparkSession), threshold, minimum)[0])


def analyze_batches(names: DataFrame, lex: Lexicon | None = None, threshold: float = batch.THRESHOLD, minimum: int = batch.MIN_BATCH, japanese: DataFrame | None = None, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(results, patterns, evidence) of names in batches; those of fewer names than ``minimum`` are read name by name in the same plan."""
    rows, patterns = analysed(names, lex or Lexicon.builtin(names.sparkSession), threshold, minimum, japanese, known)
    return rows.select(*RESULT, *PARSED), patterns, evidence(rows)


def pp_columns() -> dict[str, Column]:
    """Router columns of papers alone, of rows of ``analysed``."""
    script = F.col("script_representation")
    return {
        "pp_success": F.col("success"),
        "pp_result_token_count": F.when(F.col("success"), F.size(route_tokens(F.col("result")))).otherwise(1).cast("long"),
        "selected_format": F.col("selected_format"),
        "selected_surname_position": F.col("selected_surname_position"),
        "selected_surname_token_count": F.coalesce("selected_surname_token_count", F.lit(0)).cast("long"),
        "batch_total_count": F.col("total_count").cast("long"),
        "selected_surname_frequency": F.coalesce("selected_surname_frequency", F.lit(0.0)),
        "has_cjk": script.isin("han_only", "mixed_script", "bilingual_aligned"),
        "has_latin": script.isin("latin_only", "mixed_script", "bilingual_aligned"),
        "cjk_has_space": F.col("name").rlike(r"\p{IsHan}") & F.col("name").rlike(r"\p{IsHan}\s+\p{IsHan}"),
        "raw_tokens": F.size(F.split(F.trim("name"), r"\s+")).cast("long"),
    }


def pp_rows(rows: DataFrame) -> DataFrame:
    """Router rows of papers alone, of rows of ``analysed``."""
    return rows.select("batch_id", "pos", "name", *[c.alias(n) for n, c in pp_columns().items()])


# Names of the driver's tables, made from keys.
SUR = "Zhang Wang Li Liu Chen Yang Huang Zhao Wu Zhou Ouyang Leung Wong Cheung Chan Hsu Tsai Kim Park Nguyen Smith Tanaka Szeto Lin Ma Gao Lü Ng Hsieh Zheng".split()
GIV = "Wei Xiaoming Ka-Fai J. Min-jun John Ming Hua Jing Yu-Chen XiaoHong Mei Ts'ui Chih-Wei Brian Anh Lan Jun Soo-Jin Hong Hao Ying Yan Feng".split()
ORDER_BY = ("l_linenumber", "l_suppkey", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")


def derived_names(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    """(batch_id, pos, name) from lineitem: surnames and given names by key, in three orders and six decorations.

    dealt: by batch_id, in an exchange that all parts of a plan share.
    """
    from pyspark.sql import Window

    # Lines that the other columns of ORDER_BY would put in order have the same name, so their places may change.
    keys = ORDER_BY[:3]
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("batch_id"), *keys)
    li = li.repartition("batch_id") if dealt else li
    w = Window.partitionBy("batch_id").orderBy(*keys)
    sur = F.element_at(among(SUR), (F.col("l_suppkey") % len(SUR) + 1).cast("int"))
    giv = F.element_at(among(GIV), (F.col("l_partkey") % len(GIV) + 1).cast("int"))
    deco = F.col("l_linenumber") % 6
    s = F.when(deco == 1, F.upper(sur)).otherwise(sur)
    k = F.col("batch_id") % 3
    name = F.when(k == 0, F.concat_ws(" ", s, giv)).when(k == 1, F.concat_ws(" ", giv, s)).otherwise(F.concat(s, F.lit(", "), giv))
    name = (
        F.when(deco == 2, F.concat(name, F.lit(" (Peter)")))
        .when(deco == 3, F.replace(name, F.lit(" "), F.lit("　")))
        .when(deco == 4, F.replace(name, F.lit("i"), F.lit("í")))
        .when(deco == 5, F.replace(name, F.lit(" "), F.lit("·")))
        .otherwise(name)
    )
    return li.select("batch_id", (F.row_number().over(w) - 1).alias("pos"), name.alias("name"))
