"""Registered queries on the driver's tables, each with SQL that says the same on its own.

Names are made from keys of lineitem (plans.names.derived_names); the SQL
makes them again and holds its own copy of each rule.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import phonetics, text
from ..lexicon import data, fixed, tables
from ..operators import batch, ethnicity, facts, gates, routing
from ..operators.facts import prepare, token_facts
from . import golden
from . import names as plans
from . import serve
from .stage import keep

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def values(table: dict[str, str]) -> str:
    return ", ".join(f"({quoted(kv)})" for kv in table.items())


NAMES = f"""
li AS (SELECT l_orderkey AS batch_id, l_linenumber % 6 AS deco, l_orderkey % 3 AS k,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY {", ".join(plans.ORDER_BY)}) - 1 AS pos,
  [{quoted(plans.SUR)}][1 + l_suppkey % {len(plans.SUR)}] AS sur, [{quoted(plans.GIV)}][1 + l_partkey % {len(plans.GIV)}] AS giv FROM lineitem),
li2 AS (SELECT batch_id, pos, deco, k, giv, CASE WHEN deco = 1 THEN upper(sur) ELSE sur END AS s FROM li),
li3 AS (SELECT batch_id, pos, deco, CASE k WHEN 0 THEN s || ' ' || giv WHEN 1 THEN giv || ' ' || s ELSE s || ', ' || giv END AS n FROM li2),
names AS (SELECT batch_id, pos::INT AS pos, CASE deco WHEN 2 THEN n || ' (Peter)' WHEN 3 THEN replace(n, ' ', '　') WHEN 4 THEN replace(n, 'i', 'í') WHEN 5 THEN replace(n, ' ', '·') ELSE n END AS name FROM li3)"""
WORDS = r"""words AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[\p{L}''-]+')) AS w FROM documents)"""

# The lexeme rule of clean_punct, in a dialect without look-ahead.
CLEAN_SQL = r"""array_to_string(list_transform(regexp_extract_all(name, '(?s)[（(][^)（）]*[)）]|[A-Z]\.\s|[A-Z]\.-[A-Z]\.|[A-Z]\.-[A-Z]|[_|=]|.'), lambda x:
  CASE WHEN regexp_full_match(x, '(?s)[（(].*[)）]') THEN ' ' WHEN regexp_full_match(x, '[_|=]') THEN ' '
  WHEN regexp_full_match(x, '[A-Z]\.\s') THEN x[1] || ' ' || x[3] WHEN length(x) >= 4 AND regexp_matches(x, '^[A-Z]\.-') THEN x[1] || '-' || x[4] ELSE x END), '')"""
FULL = "".join(chr(c) for c in range(0xFF01, 0xFF5F)).replace("'", "''") + "　​﻿"
HALF = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)).replace("'", "''") + "   "


def ocr_sql(x: str) -> str:
    return f"translate(translate({x}, '{FULL}', '{HALF}'), '{text.CYRILLIC}', '{text.LATIN}')"


def ws_sql(x: str) -> str:
    return rf"trim(regexp_replace({x}, '[\s\x{{A0}}\x{{3000}}]+', ' ', 'g'))"




def case_sql(x: str) -> str:
    return rf"CASE WHEN regexp_matches({x}, '\p{{Lu}}') AND NOT regexp_matches({x}, '\p{{Ll}}') THEN 'upper' WHEN regexp_matches({x}, '\p{{Ll}}') AND NOT regexp_matches({x}, '\p{{Lu}}') THEN 'lower' WHEN regexp_full_match({x}, '[^\p{{L}}]*(\p{{Lu}}\p{{Ll}}*[^\p{{L}}]*)+') THEN 'title' ELSE 'mixed' END"


# Of the made names those of one token have a dot, so only a hyphen between two cases splits them.
CLEANED = (
    NAMES
    + f", flat AS (SELECT *, {ws_sql(ocr_sql(CLEAN_SQL))} AS f FROM names), cleaned AS (SELECT batch_id, pos, name, CASE WHEN NOT contains(f, ' ') AND length(f) - length(replace(f, '-', '')) = 1"
    + f" AND {case_sql("split_part(f, '-', 1)")} <> {case_sql("split_part(f, '-', 2)")} THEN replace(f, '-', ' ') ELSE f END AS c FROM flat)"
)
TOKENS = CLEANED + (
    r""", swapped AS (SELECT *, CASE WHEN length(c) - length(replace(c, ',', '')) = 1 AND trim(split_part(c, ',', 1)) <> '' AND trim(split_part(c, ',', 2)) <> ''
  THEN trim(split_part(c, ',', 2)) || ' ' || trim(split_part(c, ',', 1)) ELSE c END AS sw FROM cleaned),
toks AS (SELECT *, list_filter(regexp_split_to_array(regexp_replace(sw, '["""
    + text.SEPARATORS
    + r"""]+', ' ', 'g'), '\s+'), lambda x: NOT regexp_full_match(x, '[!-/:-@\[-`{-~]*')) AS tokens FROM swapped)"""
)
LIGHT = "translate(lower(strip_accents(%s)), '" + text.HYPHENS.replace("'", "''") + "', '')"


def query(key: str, sql: str | None = None):
    def add(f):
        QUERIES[key] = f
        if sql:
            ORACLES[key] = sql
        return f

    return add


def on_names(key: str, out: str, column: Callable[[Column], Column], sql: str) -> None:
    """A query of one expression over all names; sql: the same over ``name``."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return plans.derived_names(spark, sf_dir).select("batch_id", "pos", column(F.col("name")).alias(out))

    query(key, f"WITH {NAMES} SELECT batch_id, pos, {sql} AS {out} FROM names")(run)


#: Strings of every kind that a gate or a script class tells apart.
ODD = [
    "李伟", "李伟 Li Wei", "Li Wei", "김민수", "Kim Min Soo", "山田さくら", "Đặng Văn", "北京大学", "李 北京大学", "公司", "王公司", "国家重点实验室", "...", "--- !", "", "Wei (Peter) Zhang", "Wei（Peter）Zhang", "(Peter) Wei", "张伟·Zhang·Wei",
    "x" * 100, "x" * 101, "LiWei", "aUyEUNG", "G.霍弗", "李 小明 G.", "Zhang", "Zhang Wei Li", "A B", "欧阳明华", "McDonald",
]
ODD_NAMES = f"odd AS (SELECT l_orderkey AS k, l_linenumber::INT AS i, [{quoted(ODD)}][1 + (l_partkey * 7 + l_suppkey) % {len(ODD)}] AS name FROM lineitem)"


def odd_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    name = F.get(F.array(*map(F.lit, ODD)), ((F.col("l_partkey") * 7 + F.col("l_suppkey")) % len(ODD)).cast("int"))
    return li.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("i"), name.alias("name"))


def on_odd(key: str, out: str, column: Callable[[Column], Column], sql: str) -> None:
    """A query of one expression over strings of every kind."""
    query(key, f"WITH {ODD_NAMES} SELECT k, i, name, {sql} AS {out} FROM odd")(lambda spark, sf_dir: odd_names(spark, sf_dir).select("k", "i", "name", column(F.col("name")).alias(out)))


def words_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select(F.explode(F.regexp_extract_all("text", F.lit(r"[\p{L}'-]+"), F.lit(0))).alias("w")).distinct()


def on_words(key: str, out: str, column: Callable[[Column], Column], sql: str, ctes: str = "") -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return words_of(spark, sf_dir).select("w", column(F.col("w")).alias(out))

    query(key, f"WITH {WORDS}{ctes} SELECT w, {sql} AS {out} FROM words")(run)


# ---- text
on_names("clean_punct", "cleaned", text.clean_punct, CLEAN_SQL)
on_names("fullwidth", "half", text.fullwidth, f"translate(name, '{FULL}', '{HALF}')")
on_names("ocr_fix", "fixed", text.ocr_fix, ocr_sql("name"))
on_names("collapse_ws", "flat", lambda c: text.collapse_ws(text.fullwidth(c)), ws_sql(f"translate(name, '{FULL}', '{HALF}')"))
on_names("comma_swap", "swapped", text.comma_swap, "CASE WHEN contains(name, ',') THEN trim(split_part(name, ',', 2)) || ' ' || trim(split_part(name, ',', 1)) ELSE name END")
on_odd("script_class", "script", text.script_class, r"CASE WHEN regexp_matches(name, '[\x{4E00}-\x{9FFF}]') THEN CASE WHEN regexp_matches(name, '[A-Za-z]') THEN 'mixed_script' ELSE 'han_only' END ELSE 'latin_only' END")
on_odd("paren_hint", "hint", text.paren_hint, r"regexp_full_match(name, '\s*[A-Za-z][A-Za-z.''\-]*\s*[（(]\s*[A-Za-z][A-Za-z .''\-]*\s*[)）]\s*[A-Za-z][A-Za-z .''\-]*\s*')")
on_names("route_tokens", "tokens", lambda c: F.array_join(text.route_tokens(c), "|"), r"array_to_string(regexp_extract_all(name, '\p{L}+(?:[-'']\p{L}+)*'), '|')")
on_names("clean_roman", "roman", text.clean_roman, r"regexp_replace(name, '[^A-Za-z\x{C0}-\x{24F}\-'']', '', 'g')")
on_odd("cjk_chunks", "chunks", lambda c: F.size(text.cjk_chunks(c)).cast("long"), r"len(regexp_extract_all(name, '[\x{4E00}-\x{9FFF}]+'))")


@query("preprocess", f"WITH {CLEANED} SELECT batch_id, pos, c AS cleaned FROM cleaned")
def _(spark, sf_dir):
    return prepare(plans.derived_names(spark, sf_dir)).select("batch_id", "pos", "cleaned")


@query("tokenize", f"WITH {TOKENS} SELECT batch_id, pos, array_to_string(tokens, '|') AS tokens FROM toks")
def _(spark, sf_dir):
    return prepare(plans.derived_names(spark, sf_dir)).select("batch_id", "pos", F.array_join("tokens", "|").alias("tokens"))


@query("all_caps", f"WITH {TOKENS} SELECT batch_id, pos, len(list_filter(tokens, lambda t: length(regexp_replace(t, '[^\\p{{L}}]', '', 'g')) > 1 AND NOT regexp_matches(t, '\\p{{Ll}}'))) > 0 AS caps FROM toks")
def _(spark, sf_dir):
    return prepare(plans.derived_names(spark, sf_dir)).select("batch_id", "pos", text.all_caps(F.col("tokens")).alias("caps"))


on_words("norm_light", "light", text.norm_light, LIGHT % "w")
on_words(
    "capitalize",
    "cap",
    text.capitalize,
    "array_to_string(list_transform(string_split(strip_accents(w), '-'), lambda p: replace(replace(upper(p[1:1]), 'ẞ', 'SS'), 'ß', 'SS') || lower(p[2:])), '-')",
)
on_words("smart_split", "split", text.smart_split, r"CASE WHEN contains(w, '-') THEN w ELSE regexp_replace(regexp_replace(w, '(\p{Ll})(\p{Lu})', '\1 \2', 'g'), '(\p{Lu})(\p{Lu}\p{Ll})', '\1 \2', 'g') END")
on_words("is_camel", "camel", text.is_camel, r"regexp_matches(w, '^\p{Lu}.*\p{Lu}') AND regexp_matches(w, '\p{Ll}')")
on_words("malformed_camel", "bad", text.malformed_camel, r"length(w) > 2 AND length(regexp_replace(w, '[^\p{Lu}]', '', 'g')) >= 2 AND regexp_matches(w, '\p{Ll}')")

WADE_ROWS = ", ".join(f"({quoted(kv)})" for kv in text.WADE_MAP.items())
WADE_SQL = (
    f", wgs(k, v) AS (VALUES {values(fixed.WADE_GILES_SYLLABLES)}), wgm AS (SELECT map_from_entries(list((k, v))) AS m FROM (VALUES {WADE_ROWS}) t(k, v)),"
    f" lay(k, v) AS (VALUES {values(text.layered())}),"
    r""" low AS (SELECT w, lower(strip_accents(w)) AS l FROM words),
body AS (SELECT w, l, CASE WHEN l = 'j' THEN 'r' ELSE array_to_string(list_transform(regexp_extract_all(l, '(shih|ts''|tz''|ch''|szu|k''|t''|p''|hs|ts|tz|chi|ch|.)'), lambda x: coalesce(m[x], x)), '') END AS b FROM low, wgm),
wade AS (SELECT w, l, coalesce(v, CASE WHEN b LIKE '%ieh' OR b LIKE '%ueh' THEN b[:-2] WHEN b LIKE '%ung' THEN b[:-4] || 'ong' WHEN b LIKE '%ien' THEN b[:-4] || 'ian' WHEN b LIKE '%ih' THEN b[:-2] ELSE b END) AS g FROM body LEFT JOIN wgs ON wgs.k = l)"""
)
query("wade_giles", f"WITH {WORDS}{WADE_SQL} SELECT w, g AS pinyin FROM wade")(
    lambda spark, sf_dir: words_of(spark, sf_dir).select("w", text.wade_giles(F.lower(text.strip_marks(F.col("w")))).alias("pinyin"))
)
NORM_SQL = "coalesce(v, translate(CASE WHEN g = 'qen' THEN 'chen' ELSE g END, '" + text.HYPHENS.replace("'", "''") + "', ''))"
query("norm", f"WITH {WORDS}{WADE_SQL} SELECT w, {NORM_SQL} AS pinyin FROM wade LEFT JOIN lay ON lay.k = l")(
    lambda spark, sf_dir: words_of(spark, sf_dir).select("w", text.norm(F.col("w")).alias("pinyin"))
)

# ---- gates
on_odd("gate_length", "rejected", gates.gate_length, "length(name) = 0 OR length(name) > 100")
on_odd("gate_punct", "rejected", gates.gate_punct, r"regexp_full_match(name, '[!-/:-@\[-`{-~\s]*')")
on_odd("gate_script", "rejected", gates.gate_script, r"regexp_matches(name, '[\x{1100}-\x{11FF}\x{3130}-\x{318F}\x{AC00}-\x{D7AF}\x{3040}-\x{30FF}ĐđăâêôơưĂÂÊÔƠƯ]')")
MARKS = "大学|学院|研究所|实验室|编辑部|科学院|公司|有限公司|研究中心|重点实验室|国家实验室|物理系|学部"
on_odd("gate_org", "rejected", gates.gate_org, f"len(list_filter(regexp_extract_all(name, '[\\x{{4E00}}-\\x{{9FFF}}]+'), lambda c: regexp_full_match(c, '(?:{MARKS})') OR regexp_full_match(c, '.{{2,}}(?:{MARKS})'))) > 0")


# Odd strings have no comma and no mark that cleaning takes for more than a separator, but those in parentheses.
@query("gate_min_tokens", f"WITH {ODD_NAMES} SELECT k, i, name, len(list_filter(regexp_split_to_array(trim(regexp_replace(regexp_replace(regexp_replace(name, '[（(][^)）]*[)）]', ' ', 'g'), '[·.]+', ' ', 'g'), '^(Li|Mc)(Wei|Donald)$', '\\1 \\2')), '\\s+'), lambda t: NOT regexp_full_match(t, '[!-/:-@\\[-`{{-~]*'))) < 2 AS rejected FROM odd")
def _(spark, sf_dir):
    return prepare(odd_names(spark, sf_dir)).select("k", "i", "name", (F.size("tokens") < 2).alias("rejected"))


BYLINE = NAMES + ", bylines AS (SELECT batch_id, string_agg(name, ' ' ORDER BY pos) AS name FROM names GROUP BY batch_id)"
# Of the made names' words, in pinyin or as written, those that are surnames.
SURNAME_WORDS = golden.SURNAME_WORDS
AUTHOR_SQL = (
    r"WITH " + BYLINE + r""", w AS (SELECT batch_id, name, regexp_extract_all(name, '\p{L}+(?:[-'']\p{L}+)?') AS ws FROM bylines),
h AS (SELECT batch_id, list_transform(ws, lambda x: CASE WHEN length(x) > 1 AND list_contains([""" + quoted(SURNAME_WORDS) + r"""], lower(strip_accents(x))) THEN 1 ELSE 0 END) AS hs FROM w)
SELECT batch_id, len(hs) >= 6 AND list_sum(hs) >= 3 AND list_sum(hs[1:2]) > 0 AND list_sum(hs[3:len(hs)-2]) > 0 AND list_sum(hs[len(hs)-1:]) > 0 AS rejected FROM h"""
)


@query("gate_author_list", AUTHOR_SQL)
def _(spark, sf_dir):
    rows = plans.derived_names(spark, sf_dir).groupBy("batch_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "name"))), lambda x: x["name"]), " ").alias("name"))
    rows = keep(rows, "bylines")
    lists = gates.author_lists(rows.select("name").distinct(), lex(spark)).withColumn("rejected", F.lit(True))
    return rows.join(lists, "name", "left").select("batch_id", F.coalesce("rejected", F.lit(False)).alias("rejected"))


# ---- phonetics
ON, RI = "|".join(sorted(fixed.ONSETS, key=len, reverse=True)), "|".join(sorted(fixed.RIMES, key=len, reverse=True))
VALID = f"(length(w) BETWEEN 1 AND 7 AND NOT regexp_matches(w, '[0-9'']') AND NOT regexp_matches(lower(w), '{'|'.join(fixed.FORBIDDEN)}') AND (length(w) = 1 OR regexp_full_match(lower(w), '(?:{ON})?(?:{RI})')))"
on_words("valid_phonetics", "valid", phonetics.valid_phonetics, VALID)
on_words(
    "plausible_syllable",
    "plausible",
    phonetics.plausible_syllable,
    f"length(w) BETWEEN 1 AND 7 AND NOT regexp_matches(lower(w), '{'|'.join(fixed.FORBIDDEN)}') AND ({VALID} OR (regexp_full_match(lower(w), '\\p{{L}}+') AND regexp_matches(lower(w), '[aeiouü]') AND NOT regexp_matches(lower(w), '[^aeiouü]{{4}}')))",
)

# ---- lexicon


def lex(spark: SparkSession) -> data.Lexicon:
    return data.Lexicon.builtin(spark)


def rows_of(table: dict) -> str:
    return ", ".join(f"('{k}', {v!r}::DOUBLE)" for k, v in table.items())


def dealt_sql(words) -> str:
    return f"d AS (SELECT l_orderkey AS k, l_linenumber::INT AS i, [{quoted(words)}][1 + (l_partkey * 7 + l_suppkey) % {len(words)}] AS name FROM lineitem)"


def dealt(spark: SparkSession, sf_dir: str, words) -> DataFrame:
    """(k, i, name): the words dealt over lineitem by key."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    name = F.get(F.array(*map(F.lit, words)), ((F.col("l_partkey") * 7 + F.col("l_suppkey")) % len(words)).cast("int"))
    return li.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("i"), name.alias("name"))


def listed(key: str, out: str, table: dict, values_sql: str, found: Callable[[SparkSession, DataFrame], DataFrame]) -> None:
    """A query that looks words up which the keys of lineitem deal; found: (name, out) of distinct names; values_sql: what each word must give."""
    words = list(table)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = dealt(spark, sf_dir, words)
        return rows.join(found(spark, rows.select("name").distinct()), "name", "left").select("k", "i", "name", out)

    query(key, f"WITH {dealt_sql(words)}, v(name, {out}) AS (VALUES {values_sql}) SELECT k, i, name, {out} FROM d LEFT JOIN v USING (name)")(run)


def golden_values(rows: dict) -> str:
    cell = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'"
    return ", ".join(f"({cell(k)}, {cell(v)})" for k, v in rows.items())


def ppm_of(spark: SparkSession, names: DataFrame) -> DataFrame:
    return names.join(data.surname_freq(lex(spark)).withColumnRenamed("key", "name"), "name").select("name", F.round("ppm", 4).alias("ppm"))


listed("lex_surname_freq", "ppm", golden.SURNAME_PPM, rows_of(golden.SURNAME_PPM), ppm_of)
listed("lex_alias", "ppm", golden.ALIAS_PPM, rows_of(golden.ALIAS_PPM), ppm_of)


def made_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key rows from customers: every fourth is a compound, whose spelling c-n leads to it."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", (F.abs("c_acctbal") + 1).alias("ppm"))
    whole = F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit("k"), F.col("c_custkey")))
    return c.select(F.concat(F.lit("k"), F.col("c_custkey")).alias("key"), F.col("c_custkey").cast("int").alias("ordinal"), "ppm", (F.col("c_custkey") % 4 != 0).alias("base"), whole.alias("whole"), F.when(F.col("c_custkey") % 8 == 1, F.lit("k2")).alias("target"))


MADE_KEYS = "k AS (SELECT 'k' || c_custkey AS key, c_custkey AS ordinal, abs(c_acctbal) + 1 AS ppm, c_custkey % 4 <> 0 AS base, CASE WHEN c_custkey % 8 = 1 THEN 'k2' END AS target FROM customer)"
query("lex_surname_logp", f"WITH {MADE_KEYS}, t AS (SELECT sum(CASE WHEN base THEN ppm END) AS plain, sum(ppm) AS every FROM k), o AS (SELECT key, target, ln(ppm / CASE WHEN base THEN plain ELSE every END) AS own FROM k, t) SELECT o.key, round(coalesce(x.own, o.own), 6) AS logp FROM o LEFT JOIN o x ON x.key = o.target")(
    lambda spark, sf_dir: data.surname_logp(made_keys(spark, sf_dir)).select("key", F.round("logp", 6).alias("logp"))
)
query("lex_surname_rank", f"WITH {MADE_KEYS} SELECT key, round((row_number() OVER (ORDER BY ppm, ordinal) - 1) / (count(*) OVER () - 1), 6) AS rank FROM k")(
    lambda spark, sf_dir: data.surname_rank(made_keys(spark, sf_dir)).select("key", F.round("rank", 6).alias("rank"))
)
SYLLABLES = "wei ming hua lv nv lu xiao zhi li fo kung qing".split()
PLACES_SQL = f"g AS (SELECT [{quoted(SYLLABLES)}][1 + l_partkey % {len(SYLLABLES)}] AS s, sum(CASE WHEN l_linenumber % 3 = 0 THEN 1 ELSE 0 END)::BIGINT AS a, sum(CASE WHEN l_linenumber % 3 > 0 THEN 1 ELSE 0 END)::BIGINT AS b FROM lineitem GROUP BY 1)"


@query(
    "lex_position",
    f"""WITH {PLACES_SQL}, t AS (SELECT sum(a) AS ta, sum(b) AS tb, count(*) AS v FROM g),
p AS (SELECT s, ln((a + 0.5) / (ta + 0.5 * (v + 1))) AS i, ln((b + 0.5) / (tb + 0.5 * (v + 1))) AS f FROM g, t), l AS (SELECT regexp_replace(s, '^([ln])v', '\\1u') AS s, ln(max((a + b) / (ta + tb))) AS l FROM g, t WHERE s NOT IN ({quoted(tables.BYLINE_ONLY)}) GROUP BY 1)
  SELECT coalesce(p.s, l.s) AS syllable, round(l, 6) AS logp, round(i, 6) AS initial_logp, round(f, 6) AS final_logp FROM p FULL JOIN l ON p.s = l.s""",
)
def _(spark, sf_dir):
    """Log shares of given syllables from counts by key."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    first = F.col("l_linenumber") % 3 == 0
    counts = li.groupBy(F.element_at(text.among(SYLLABLES), (F.col("l_partkey") % len(SYLLABLES) + 1).cast("int")).alias("syllable")).agg(F.sum(first.cast("long")).alias("initial_count"), F.sum((~first).cast("long")).alias("final_count"))
    out = data.given_logp(data.Lexicon(lex(spark).surname, counts)).where("initial_logp is not null or logp is not null")
    return out.select("syllable", *[F.round(c, 6).alias(c) for c in ("logp", "initial_logp", "final_logp")])


HYPHENED = {v.replace(" ", "-"): v for v in fixed.COMPOUND_VARIANTS.values()} | {"li-ming": None, "ouyang": None}
listed("lex_hyphen_map", "spaced", HYPHENED, ", ".join(f"('{k}', '{v}')" for k, v in HYPHENED.items() if v), lambda spark, names: names.join(data.hyphen_map(lex(spark)).toDF("name", "spaced"), "name"))

# ---- facts on the names' tokens: the SQL looks them up by their spelling without marks
MADE = TOKENS + f", words AS (SELECT DISTINCT unnest(tokens) AS w FROM toks), lit AS (SELECT w, {LIGHT % 'w'} AS light FROM words)"
PPM = f", ppm(light, ppm) AS (VALUES {rows_of(golden.TOKEN_PPM)})"


def facts_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = plans.derived_names(spark, sf_dir).select("name").distinct()
    return token_facts(prepare(names).select(F.explode("tokens").alias("token")), lex(spark), keep)


query("parser_frequency", f"WITH {MADE}{PPM} SELECT w AS token, coalesce(ppm, 0) AS ppm FROM lit LEFT JOIN ppm USING (light)")(lambda spark, sf_dir: facts_of(spark, sf_dir).select("token", F.round("ppm", 4).alias("ppm")))
query("parser_is_surname", f"WITH {MADE} SELECT w AS token, light IN ({quoted(golden.TOKEN_SURNAMES)}) AS is_surname, light IN ({quoted(golden.TOKEN_GIVEN)}) AS is_given FROM lit")(
    lambda spark, sf_dir: facts_of(spark, sf_dir).select("token", "is_surname", "is_given")
)
query("dominant", f"WITH {MADE}{PPM} SELECT w AS token FROM lit JOIN ppm USING (light) WHERE ppm >= 10000")(lambda spark, sf_dir: facts_of(spark, sf_dir).where("ppm >= 10000").select("token"))
NO_PARTS = ("anh", "brian", "john", "kim", "nguyen", "park", "smith", "tanaka")
PARTS_SQL = ", ".join(f"('{k}', '{v}')" for k, v in golden.TOKEN_PARTS.items())
query("split_concat", f"WITH {MADE}, p(light, parts) AS (VALUES {PARTS_SQL}) SELECT w AS token, CASE WHEN light NOT IN ({quoted(NO_PARTS)}) THEN coalesce(parts, lower(strip_accents(w))) END AS parts FROM lit LEFT JOIN p USING (light)")(
    lambda spark, sf_dir: facts_of(spark, sf_dir).select("token", F.lower(text.strip_marks(F.array_join("parts", "|"))).alias("parts"))
)

on_words("compound_format", "form", facts.compound_format, r"CASE WHEN contains(w, '-') THEN 'hyphenated' WHEN (regexp_matches(w, '^\p{Lu}.*\p{Lu}') OR (length(w) > 2 AND length(regexp_replace(w, '[^\p{Lu}]', '', 'g')) >= 2)) AND regexp_matches(w, '\p{Ll}') THEN 'camelCase' ELSE 'compact' END")
# Compound surnames in one word, cut as they are written.
COMPOUND_CUTS = {"Ouyang": "Ou|yang", "AuYeung": "Au|Yeung", "aUyEUNG": "au|yeung", "Au-Yeung": "Ou|Yang", "Sima": "Si|ma", "SiMa": "Si|Ma", "Zhuge": "Zhu|ge", "ZHUGE": "ZHU|GE", "Duanmu": "Duan|mu", "Situ": "Si|tu", "Szeto": "Sze|to"}
COMPOUND_OF = {"Ouyang": "ou yang", "AuYeung": "ou yang", "aUyEUNG": "ou yang", "Au-Yeung": "ou yang", "Sima": "si ma", "SiMa": "si ma", "Zhuge": "zhu ge", "ZHUGE": "zhu ge", "Duanmu": "duan mu", "Situ": "si tu", "Szeto": "si tu"}
listed("compound_split", "parts", COMPOUND_CUTS, golden_values(COMPOUND_CUTS), lambda spark, names: names.select("name", F.array_join(facts.compound_split(F.col("name"), facts.compound_format(F.col("name")), text.lookup(COMPOUND_OF, F.col("name"))), "|").alias("parts")))

# ---- ethnicity
TIER = TOKENS + ", low AS (SELECT batch_id, pos, list_transform(tokens, lambda t: lower(t)) AS ts FROM toks)"
VN, KO = quoted(fixed.VIETNAMESE_GIVEN), quoted(fixed.KOREAN_OVERLAP)


@query("eth_markers", f"WITH {TIER} SELECT batch_id, pos, list_has_any(ts, [{quoted(fixed.WESTERN)}]) AS western, list_has_any(ts, [{quoted(fixed.KOREAN_ONLY)}]) AS korean, list_has_any(ts, [{quoted(fixed.JAPANESE)}]) AS japanese, list_has_any(ts, [{quoted(fixed.VIETNAMESE_ONLY)}]) AS vietnamese, list_has_any(ts, [{KO}]) AS overlap FROM low")
def _(spark, sf_dir):
    low = F.transform("tokens", lambda t: F.lower(t))
    has = lambda w, n: F.arrays_overlap(low, text.among(w)).alias(n)
    p = prepare(plans.derived_names(spark, sf_dir))
    return p.select("batch_id", "pos", has(fixed.WESTERN, "western"), has(fixed.KOREAN_ONLY, "korean"), has(fixed.JAPANESE, "japanese"), has(fixed.VIETNAMESE_ONLY, "vietnamese"), has(fixed.KOREAN_OVERLAP, "overlap"))


def parsed(spark: SparkSession, names: DataFrame) -> DataFrame:
    """Distinct names with their results."""
    return keep(plans.single_result(plans.name_table(names, lex(spark))), "parsed")


for _key, _rows in golden.NAMES.items():
    # Names with the text that each must give, or null where it must be rejected.
    listed(_key, "result", _rows, golden_values(_rows), lambda spark, names: parsed(spark, names).select("name", F.when(F.col("success"), F.col("result")).alias("result")))

listed("eth_classify", "error", golden.REASONS, golden_values(golden.REASONS), lambda spark, names: parsed(spark, names).select("name", "error"))
listed("component_order", "roles", golden.ROLES, golden_values(golden.ROLES), lambda spark, names: parsed(spark, names).select("name", F.array_join("r.order", " ").alias("roles")))


# ---- routing, over rows made from keys
ROUTE_CASES = """
r AS (SELECT l_orderkey AS k, l_linenumber::INT AS n, l_partkey AS p, l_suppkey AS s, l_quantity AS q,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS i FROM lineitem)"""
ROUTE_COLUMNS = """k, i, CASE p % 4 WHEN 0 THEN 'Ming Ming Chen' WHEN 1 THEN 'Min Jun Kim' WHEN 2 THEN 'Boon Kai Tan' ELSE 'Chen Ming Ming' END AS name,
  p % 17 <> 0 AS pp_success, s % 19 <> 0 AS vys_success, CASE WHEN p % 3 = 0 THEN 'Ming Chen' ELSE 'Chen Ming' END AS pp_result, CASE WHEN s % 2 = 0 THEN 'Ming Chen' WHEN s % 23 = 0 THEN 'A B C D E' ELSE 'Chen Ming' END AS vys_result,
  CASE WHEN p % 2 = 0 THEN 'surname_first' ELSE 'given_first' END AS pp_selected_format, CASE WHEN s % 3 = 0 THEN 'surname_first' ELSE 'given_first' END AS vys_selected_format,
  CASE p % 3 WHEN 0 THEN 'first' WHEN 1 THEN 'last' ELSE 'internal' END AS pp_selected_surname_position, CASE s % 3 WHEN 0 THEN 'last' WHEN 1 THEN 'first' ELSE 'unknown' END AS vys_selected_surname_position,
  CAST(p % 11 AS DOUBLE) AS pp_selected_surname_frequency, CAST(s % 29 AS DOUBLE) AS vys_selected_surname_frequency,
  CASE WHEN p % 5 = 0 THEN 'given_first' ELSE 'surname_first' END AS pp_batch_dominant_format, CASE WHEN s % 5 < 3 THEN 'given_first' ELSE 'surname_first' END AS vys_batch_dominant_format,
  p % 7 < 5 AS pp_batch_threshold_met, s % 7 < 5 AS vys_batch_threshold_met, CAST(n AS BIGINT) AS pp_batch_total_count, CAST(q AS BIGINT) AS vys_batch_total_count,
  CAST(p % 10 AS DOUBLE) / 10 AS pp_batch_confidence, CAST(s % 10 AS DOUBLE) / 10 AS vys_batch_confidence, CAST(p % 13 AS DOUBLE) / 13 AS pp_batch_vote_margin, CAST(s % 13 AS DOUBLE) / 13 AS vys_batch_vote_margin,
  CASE WHEN (p + s) % 9 = 0 THEN NULL ELSE CAST((p * 7 + s) % 600 AS DOUBLE) / 20 END AS pp_selected_surname_frequency_ratio"""
OLD_SQL = """CASE WHEN NOT pp_success OR NOT vys_success OR vys_result = 'A B C D E' THEN 'not_person' WHEN pp_result = vys_result THEN 'pp'
  WHEN (pp_selected_surname_position IN ('first', 'last') AND vys_selected_surname_position IN ('first', 'last') AND pp_selected_surname_position <> vys_selected_surname_position
    AND CASE WHEN pp_selected_surname_frequency > 0 THEN vys_selected_surname_frequency / pp_selected_surname_frequency WHEN vys_selected_surname_frequency > 0 THEN 1e300 ELSE 0 END >= 5 AND vys_batch_vote_margin >= 0.55)
  OR (pp_batch_total_count <= 3 AND vys_batch_dominant_format = 'given_first' AND vys_batch_vote_margin >= 0.65) OR (pp_batch_vote_margin <= 0.20 AND vys_batch_vote_margin >= 0.35) THEN 'vys' ELSE 'pp' END"""
NEW_SQL = """CASE WHEN pp_selected_surname_frequency_ratio <= 0.10 THEN 'endpoint_frequency_strongly_favors_vys' WHEN pp_selected_surname_frequency_ratio >= 20 THEN 'endpoint_frequency_strongly_favors_pp'
  WHEN pp_batch_threshold_met AND pp_batch_dominant_format = pp_selected_format AND pp_batch_total_count >= 3 AND pp_batch_confidence >= 0.70 THEN 'strong_pp_paper_context'
  WHEN vys_batch_threshold_met AND vys_batch_dominant_format = vys_selected_format AND vys_batch_total_count >= 3 AND vys_batch_confidence >= 0.85 THEN 'strong_vys_batch_context' ELSE 'weak_or_conflicting_evidence' END"""
ROUTED = f"""WITH {ROUTE_CASES}, c AS (SELECT {ROUTE_COLUMNS} FROM r), d AS (SELECT *, {OLD_SQL} AS old_p, {NEW_SQL} AS why FROM c),
e AS (SELECT *, CASE why WHEN 'endpoint_frequency_strongly_favors_vys' THEN 'vys' WHEN 'strong_vys_batch_context' THEN 'vys' WHEN 'weak_or_conflicting_evidence' THEN 'abstain' ELSE 'pp' END AS new_p,
  CASE WHEN pp_selected_format = vys_selected_format THEN 'unknown' WHEN pp_selected_format = 'given_first' THEN 'pp' ELSE 'vys' END AS io, pp_batch_total_count AS t, pp_selected_surname_frequency_ratio AS x,
  CASE WHEN name = 'Chen Ming Ming' THEN 'surname_first' WHEN name IN ('Min Jun Kim', 'Boon Kai Tan') THEN 'given_first' END AS want FROM d),
f AS (SELECT *, CASE WHEN (io = 'pp' AND old_p = 'pp' AND new_p = 'pp') OR (io = 'vys' AND why = 'endpoint_frequency_strongly_favors_vys' AND t <= 2) OR (io = 'vys' AND why = 'weak_or_conflicting_evidence' AND t <= 1 AND coalesce(x <= 5, true))
    OR (io = 'vys' AND why = 'strong_vys_batch_context' AND t <= 2 AND coalesce(x <= 5, true)) THEN 'reliable_input_order_abstain'
  WHEN old_p = 'vys' AND new_p = 'pp' AND why = 'strong_pp_paper_context' AND coalesce(x <= 1 OR (x > 5 AND x <= 20), true) THEN 'strong_pp_allowed_ratio'
  WHEN old_p = 'vys' AND new_p = 'pp' AND why = 'endpoint_frequency_strongly_favors_pp' AND t >= 3 THEN 'endpoint_pp_with_real_paper_votes'
  WHEN old_p = 'vys' AND new_p = 'pp' THEN 'old_vys_new_pp_default_vys' WHEN old_p = 'vys' AND new_p = 'abstain' THEN 'old_vys_new_abstain' WHEN old_p = 'pp' AND new_p = 'vys' THEN 'old_pp_new_vys'
  WHEN old_p = 'vys' AND new_p = 'vys' THEN 'old_new_vys' ELSE 'default_pp' END AS base,
  CASE WHEN old_p = 'pp' AND why = 'strong_vys_batch_context' AND t >= 6 THEN 'larger_pp_paper_overrides_vys_batch'
  WHEN old_p = 'vys' AND why = 'endpoint_frequency_strongly_favors_pp' AND t = 2 AND pp_batch_confidence >= 0.85 THEN 'endpoint_pp_high_conf_two_vote' END AS plus,
  CASE WHEN pp_selected_format <> vys_selected_format AND name = 'Chen Ming Ming' THEN 'name_prior_repeated_tail_given_surname_first' WHEN pp_selected_format <> vys_selected_format AND name = 'Min Jun Kim' THEN 'name_prior_korean_given_first_three_token' WHEN pp_selected_format <> vys_selected_format AND name = 'Boon Kai Tan' THEN 'name_prior_cantonese_given_first' END AS prior FROM e)"""


def route_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").createOrReplaceTempView("onomast_lineitem")
    return spark.sql(f"WITH {ROUTE_CASES.replace('FROM lineitem', 'FROM onomast_lineitem')} SELECT {ROUTE_COLUMNS} FROM r")


query("route_old", f"{ROUTED} SELECT k, i, old_p AS prediction FROM f")(lambda spark, sf_dir: route_rows(spark, sf_dir).select("k", "i", routing.old_rule()["route"].alias("prediction")))
query("route_clean", f"{ROUTED} SELECT k, i, new_p AS prediction, why AS reason FROM f")(lambda spark, sf_dir: route_rows(spark, sf_dir).select("k", "i", routing.clean_rule()["route"].alias("prediction"), routing.clean_rule()["reason"].alias("reason")))
query("route_input_order", f"{ROUTED} SELECT k, i, io AS candidate FROM f")(lambda spark, sf_dir: route_rows(spark, sf_dir).select("k", "i", routing.input_order().alias("candidate")))
query("route_ppvys", f"""{ROUTED} SELECT k, i, CASE WHEN old_p = 'not_person' THEN 'not_person' ELSE coalesce(prior, plus, base) END AS router_reason,
  CASE WHEN old_p = 'not_person' THEN 'not_person' WHEN prior IS NOT NULL THEN CASE WHEN pp_selected_format = want THEN 'pp' ELSE 'vys' END WHEN plus IS NOT NULL THEN 'pp' WHEN base = 'reliable_input_order_abstain' THEN 'abstain'
    WHEN base IN ('strong_pp_allowed_ratio', 'endpoint_pp_with_real_paper_votes', 'default_pp') THEN 'pp' ELSE 'vys' END AS router_prediction, CASE WHEN old_p = 'not_person' THEN 'unknown' ELSE io END AS input_order_candidate FROM f""")(
    lambda spark, sf_dir: routing.route_pp_vys(route_rows(spark, sf_dir)).select("k", "i", "router_prediction", "router_reason", "input_order_candidate")
)
query("route_final", f"""{ROUTED}, z AS (SELECT *, CASE WHEN old_p = 'not_person' THEN 'not_person' WHEN prior IS NOT NULL THEN CASE WHEN pp_selected_format = want THEN 'pp' ELSE 'vys' END WHEN plus IS NOT NULL THEN 'pp' WHEN base = 'reliable_input_order_abstain' THEN 'abstain'
    WHEN base IN ('strong_pp_allowed_ratio', 'endpoint_pp_with_real_paper_votes', 'default_pp') THEN 'pp' ELSE 'vys' END AS side FROM f)
  SELECT k, i, CASE CASE WHEN side = 'abstain' THEN io ELSE side END WHEN 'pp' THEN pp_result WHEN 'vys' THEN vys_result END AS final_result FROM z""")(
    lambda spark, sf_dir: routing.route_final(routing.route_pp_vys(route_rows(spark, sf_dir))).select("k", "i", "final_result")
)
PP_COLUMNS_SQL = """k, i, p % 17 <> 0 AS pp_success, CAST(1 + p % 3 AS BIGINT) AS pp_result_token_count, CASE WHEN s % 2 = 0 THEN 'surname_first' ELSE 'given_first' END AS selected_format,
  CASE WHEN s % 5 < 3 THEN 'first' ELSE 'last' END AS selected_surname_position, CAST(1 + p % 2 AS BIGINT) AS selected_surname_token_count, CAST(n % 4 AS BIGINT) AS batch_total_count,
  CAST(p * 31 % 5000 AS DOUBLE) AS selected_surname_frequency, p % 3 <> 0 AS has_cjk, s % 3 <> 0 AS has_latin, n % 2 = 0 AS cjk_has_space, CAST(1 + s % 4 AS BIGINT) AS raw_tokens"""
PP_SQL = f"""WITH {ROUTE_CASES}, c AS (SELECT {PP_COLUMNS_SQL} FROM r), d AS (SELECT *, batch_total_count < 2 AS few, selected_format = 'surname_first' AND selected_surname_position = 'first' AS st FROM c),
e AS (SELECT *, few AND has_cjk AND has_latin AND raw_tokens >= 3 AS mixed, st AND few AND has_cjk AND NOT has_latin AND cjk_has_space AS spaced FROM d)
SELECT k, i, CASE WHEN NOT pp_success THEN 'not_person' WHEN pp_result_token_count = 2 AND selected_format = 'given_first' AND has_cjk AND has_latin AND raw_tokens = 2 AND selected_surname_frequency >= 2500 THEN 'clean_bilingual_given_first'
  WHEN st AND pp_result_token_count = 2 AND NOT mixed AND NOT spaced THEN 'surname_first_two_token' WHEN st AND selected_surname_token_count > 1 AND NOT mixed AND NOT spaced THEN 'compound_surname_first_input_start'
  WHEN spaced THEN 'spaced_cjk_zero_batch_surname_first' WHEN few AND selected_surname_frequency < 500 THEN 'weak_zero_batch' WHEN mixed THEN 'zero_batch_mixed_long' ELSE 'default_abstain' END AS router_reason FROM e"""
PP_SQL = f"SELECT *, CASE WHEN router_reason = 'not_person' THEN 'not_person' WHEN router_reason IN ('clean_bilingual_given_first', 'surname_first_two_token', 'compound_surname_first_input_start') THEN 'pp' ELSE 'abstain' END AS router_prediction FROM ({PP_SQL})"


@query("route_pp", PP_SQL)
def _(spark, sf_dir):
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").createOrReplaceTempView("onomast_lineitem")
    rows = spark.sql(f"WITH {ROUTE_CASES.replace('FROM lineitem', 'FROM onomast_lineitem')} SELECT {PP_COLUMNS_SQL} FROM r")
    return routing.route_pp(rows).select("k", "i", "router_prediction", "router_reason")


# ---- batch votes, over votes made from keys
VOTE_SQL = """WITH v AS (SELECT l_orderkey AS batch_id, CASE WHEN l_partkey % 5 = 0 THEN NULL WHEN l_suppkey % 3 = 0 THEN 'surname_first' ELSE 'given_first' END AS vote, CAST(1 + l_quantity % 4 AS DOUBLE) AS weight, 1 + l_partkey % 2 AS nc FROM lineitem),
a AS (SELECT batch_id, count(*) AS size, count(vote) AS t, coalesce(sum(CASE WHEN vote = 'surname_first' THEN 1 ELSE 0 END), 0) AS sf, coalesce(sum(CASE WHEN vote = 'given_first' THEN 1 ELSE 0 END), 0) AS gf,
  coalesce(sum(CASE WHEN vote = 'surname_first' THEN weight END), 0) AS sw, coalesce(sum(CASE WHEN vote = 'given_first' THEN weight END), 0) AS gw,
  coalesce(sum(CASE WHEN vote = 'surname_first' AND nc = 1 THEN 1 ELSE 0 END), 0) AS sa, coalesce(sum(CASE WHEN vote = 'given_first' AND nc = 1 THEN 1 ELSE 0 END), 0) AS ga FROM v GROUP BY batch_id),
b AS (SELECT *, CASE WHEN t = 0 THEN 'mixed' WHEN sf > gf THEN 'surname_first' WHEN gf > sf THEN 'given_first' WHEN sw > gw THEN 'surname_first' WHEN gw > sw THEN 'given_first' ELSE 'surname_first' END AS fmt,
  CASE WHEN t = 0 THEN 0.0::DOUBLE WHEN sf <> gf THEN greatest(sf, gf) / (sf + gf) WHEN sw <> gw THEN greatest(sw, gw) / (sw + gw) ELSE 0.5 END AS dc FROM a)"""


def made_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    vote = F.when(F.col("l_partkey") % 5 == 0, None).when(F.col("l_suppkey") % 3 == 0, "surname_first").otherwise("given_first")
    rows = li.select(
        F.col("l_orderkey").alias("batch_id"),
        vote.alias("vote"),
        vote.isNotNull().alias("votes"),
        (1 + F.col("l_quantity") % 4).alias("weight"),
        (1 + F.col("l_partkey") % 2).alias("n_cands"),
        F.array(F.lit("a")).alias("roman"),
        F.array(F.struct(F.lit(0.0).alias("ppm"))).alias("facts"),
    )
    return batch.votes(rows)


query("batch_votes", f"{VOTE_SQL} SELECT batch_id, t::BIGINT AS total_count, sf::BIGINT AS surname_first_count, gf::BIGINT AS given_first_count, sw AS sf_weight, gw AS gf_weight, sa::BIGINT AS sf_alone, ga::BIGINT AS gf_alone FROM a")(
    lambda spark, sf_dir: made_votes(spark, sf_dir).select("batch_id", "total_count", "surname_first_count", "given_first_count", "sf_weight", "gf_weight", "sf_alone", "gf_alone")
)
query(
    "batch_pattern",
    f"""{VOTE_SQL} SELECT batch_id, fmt AS dominant_format, round(dc, 6) AS decision_confidence, round(CASE WHEN t = 0 THEN 0 WHEN fmt = 'surname_first' THEN sf / t ELSE gf / t END, 6)::DOUBLE AS confidence,
  round(CASE WHEN sf + gf = 0 THEN 0 ELSE abs(sf - gf) / (sf + gf) END, 6)::DOUBLE AS vote_margin,
  t > 0 AND dc >= 0.55 AND dc > 0.5 AND (sf <> gf OR CASE WHEN fmt = 'surname_first' THEN sa > 0 ELSE ga > 0 END) AND sf + gf >= 2 AND sf + gf >= 0.5 * t AND size >= 2 AS threshold_met FROM b""",
)(lambda spark, sf_dir: batch.pattern(made_votes(spark, sf_dir)).select("batch_id", "dominant_format", *[F.round(c, 6).alias(c) for c in ("decision_confidence", "confidence", "vote_margin")], "threshold_met"))


# ---- whole plans: no SQL, tested on golden names and on invariants
@query("normalize_names")
def _(spark, sf_dir):
    return plans.normalize_names(plans.derived_names(spark, sf_dir))


def papers(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Names in papers, and the names alone, which no exchange by paper precedes."""
    return {"names": plans.derived_names(spark, sf_dir, dealt=True), "known": plans.derived_names(spark, sf_dir).select("name")}


@query("paper_names")
def _(spark, sf_dir):
    return plans.analyze_batches(**papers(spark, sf_dir))[0]


@query("batch_patterns")
def _(spark, sf_dir):
    return plans.analyze_batches(**papers(spark, sf_dir))[1]


@query("evidence")
def _(spark, sf_dir):
    return plans.analyze_batches(**papers(spark, sf_dir))[2]


@query("route_papers")
def _(spark, sf_dir):
    return routing.route_pp(plans.pp_rows(plans.analysed(lex=lex(spark), **papers(spark, sf_dir))[0]))


@query("route_pool")
def _(spark, sf_dir):
    """Each order as a paper, against the pool of its customer's nation and its year."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("y"))
    nations = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_nationkey")
    pool = orders.join(nations, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("paper_id"), F.concat_ws("-", "c_nationkey", "y").alias("pool_id"))
    found = papers(spark, sf_dir)
    return serve.papers_in_pools(found["names"].withColumnRenamed("batch_id", "paper_id"), pool, lex(spark), known=found["known"])


@query("route_alone")
def _(spark, sf_dir):
    return serve.papers_alone(lex=lex(spark), **papers(spark, sf_dir))


# Queries of their own modules, which take their helpers from here.
from . import batches, builds, han, searches, served  # noqa: E402, F401
