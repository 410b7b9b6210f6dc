"""Registered queries of the search in both orders, over token facts that the driver's keys put together."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import search
from .catalogue import lex, query

# Made facts of tokens: token, share as surname and its log and rank, surname, given, log share as given name, fused pair, initial remapped, log shares of places, Korean given syllable.
TOKENS = [
    ("Wang", 68479.7, -2.7, 0.99, True, True, -7.1, False, False, -6.4, -6.0, False),
    ("Li", 63038.1, -2.8, 0.98, True, True, -3.9, False, False, -3.3, -3.7, False),
    ("Gong", 1600.5, -6.4, 0.80, True, True, -7.7, False, False, -7.9, -7.2, False),
    ("Lu", 3206.2, -5.7, 0.88, True, True, -5.8, False, False, -5.9, -5.8, False),
    ("Min", 80.4, -9.4, 0.35, True, True, -4.8, False, False, -5.5, -4.1, True),
    ("Xiaoming", 0.0, -15.0, 0.0, False, False, -7.4, True, False, -14.0, -14.0, False),
    ("Jae", 0.0, -15.0, 0.0, False, False, -15.0, False, False, -14.0, -14.0, True),
    ("Kao", 950.0, -7.0, 0.72, True, True, -8.0, False, True, -8.4, -8.8, False),
    ("Hua", 647.2, -7.3, 0.66, True, True, -4.3, False, False, -5.0, -3.4, False),
    ("Cha", 90.0, -9.0, 0.40, True, True, -11.0, False, False, -12.0, -12.0, False),
    ("J", 0.0, -26.0, 0.0, False, False, -15.0, False, False, -14.0, -14.0, False),
    ("Ka-Fai", 0.0, -15.0, 0.0, True, False, -9.0, True, False, -14.0, -14.0, False),
]
FIELDS = "token ppm slogp rank sur giv glogp pk wg ini fin kg".split()
SIZE = len(TOKENS)
COMP = "struct<form:string,target:string,parts:array<string>,shown:string,logp:double,rank:double>"


def made_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(name, facts, hint, n): two or three of the made tokens by key, each combination once, with the number of its rows."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    some = lambda c: (F.col(c) % SIZE).cast("int")
    three = F.col("l_quantity") % 2 == 0
    ids = F.when(three, F.array(some("l_suppkey"), some("l_partkey"), some("l_orderkey"))).otherwise(F.array(some("l_suppkey"), some("l_partkey")))
    rows = li.groupBy(ids.alias("ids"), (F.col("l_linenumber") % 5 == 0).alias("hint")).agg(F.count("*").alias("n"))
    one = lambda t: F.struct(
        F.lit(t[0]).alias("token"), F.lit(t[0].lower()).alias("low"), F.lit(t[0].lower()).alias("norm"), F.lit(t[1]).alias("ppm"), F.lit(t[2]).alias("slogp"), F.lit(t[3]).alias("rank"), F.lit(t[4]).alias("is_surname"), F.lit(False).alias("in_normal"),
        F.lit(t[5]).alias("is_given"), F.lit(t[5]).alias("is_given_written"), F.lit(t[6]).alias("glogp"), F.lit(t[7]).alias("pair_known"), F.lit(t[8]).alias("wg_initial"), F.lit(t[9]).alias("initial_logp"), F.lit(t[10]).alias("final_logp"),
        F.lit(None).cast(COMP).alias("comp"), F.struct(F.lit(t[11]).alias("korean_given")).alias("mark"),
    )
    table = F.array(*map(one, TOKENS))
    name = F.concat(F.array_join("ids", "-"), F.when(F.col("hint"), "!").otherwise(""))
    return rows.select(name.alias("name"), F.transform("ids", lambda i: F.get(table, i)).alias("facts"), "hint", "n")


def base_sql(s: str, g: str, t: str, n: str, ng: str, at: str) -> str:
    """Score without what hangs on order: s a surname token, g its given tokens, t the tokens in their order, at the surname's place from 1."""
    near = f"(({s}.ppm > 0 AND {g}[1].ppm > 0) OR greatest({s}.ppm, {g}[1].ppm) < 5000)"
    delta = f"({t}[2].ini + {t}[3].fin - {t}[1].ini - {t}[2].fin)"
    size = f"least(abs({delta}) - 1.5, 1.5)"
    place = f"CASE WHEN {n} = 3 AND {ng} = 2 AND {at} IN (1, 3) AND {size} > 0 THEN CASE WHEN {at} = 1 THEN 1 ELSE -1 END * sign({delta}) * {size} ELSE 0 END"
    pair = f"CASE WHEN ({ng} = 2 AND {g}[1].giv AND {g}[2].giv) OR ({ng} = 1 AND {g}[1].pk) THEN 1.348 ELSE 0 END"
    apart = f"CASE WHEN {ng} = 1 AND {near} THEN ln(greatest({s}.ppm, 0.001) / greatest({g}[1].ppm, 0.001)) * -0.042 + ({s}.rank - {g}[1].rank) * -0.573 ELSE 0 END"
    return f"({s}.slogp * 0.465 + list_sum(list_transform({g}, lambda x: x.glogp)) * 0.395 + {s}.rank * -0.888 + {pair} + {apart} + {place} * 0.06)"


def bonus_sql(s: str, g: str, t: str, n: str, at: str, forward: str, hint: str) -> str:
    """What keeping the order gives; forward: the given tokens are in the order of t."""
    free = f"({s}.sur AND {g}[1].sur AND {s}.giv AND {g}[1].giv AND CASE WHEN least({s}.ppm, {g}[1].ppm) = 0 THEN greatest({s}.ppm, {g}[1].ppm) < 5000 ELSE greatest({s}.ppm, {g}[1].ppm) < 5 * least({s}.ppm, {g}[1].ppm) END)"
    guard = f"({s}.sur AND {g}[1].sur AND {g}[1].ppm > 0 AND {g}[1].ppm < 500 AND {s}.ppm > 50 * {g}[1].ppm)"
    a, b, z = (f"{t}[{i}]" for i in (1, 2, 3))
    mild = f"{z}.giv AND {a}.ppm > 0 AND {a}.ppm < 3000 AND {z}.ppm > {a}.ppm AND {z}.ppm <= 3 * {a}.ppm"
    korean = f"{b}.giv AND {a}.ppm > {z}.ppm AND {z}.ppm > 0 AND {z}.ppm <= 100 AND {z}.over AND {b}.kg"
    return f"""1.102 * CASE WHEN {n} = 2 THEN CASE WHEN {hint} THEN CASE WHEN {at} = 1 AND {free} THEN 1 ELSE 0 END WHEN {at} = 2 OR {a}.token = {b}.token THEN CASE WHEN {free} OR {s}.wg THEN 1 WHEN {guard} THEN 4 ELSE 0 END ELSE 0 END
      WHEN {at} = 3 AND {forward} AND {a}.sur AND {z}.sur AND {a}.giv THEN CASE WHEN {mild} THEN 0.5 WHEN {korean} THEN 1 ELSE 0 END ELSE 0 END"""


def _cell(v) -> str:
    return f"'{v}'" if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else f"{v!r}::DOUBLE"


STRUCTS = "[" + ", ".join("{" + ", ".join(f"'{k}': {_cell(v)}" for k, v in zip([*FIELDS, "over"], [*t, t[0] == "Cha"])) + "}" for t in TOKENS) + "]"
SEARCH_SQL = f"""WITH tok AS (SELECT {STRUCTS} AS every),
r AS (SELECT CASE WHEN l_quantity::INT % 2 = 0 THEN [l_suppkey % {SIZE}, l_partkey % {SIZE}, l_orderkey % {SIZE}] ELSE [l_suppkey % {SIZE}, l_partkey % {SIZE}] END AS ids, l_linenumber % 5 = 0 AS hint, count(*)::BIGINT AS rows_ FROM lineitem GROUP BY ALL),
w AS (SELECT array_to_string(ids, '-') || CASE WHEN hint THEN '!' ELSE '' END AS name, hint, len(ids) AS n, list_transform(ids, lambda i: every[i + 1]) AS t FROM r, tok),
o AS (SELECT name, hint, n, t, 0 AS way, t AS o FROM w UNION ALL SELECT name, hint, n, t, 1, list_reverse(t) FROM w),
c AS (SELECT *, 1 AS pl, o[1] AS s, o[2:] AS g FROM o UNION ALL SELECT *, n, o[n], o[1:n - 1] FROM o),
f AS (SELECT *, {base_sql('s', 'g', 'o', 'n', 'len(g)', 'pl')} + {bonus_sql('s', 'g', 'o', 'n', 'pl', 'true', 'false')} AS v, '[''' || s.token || ''']|[' || array_to_string(list_transform(g, lambda x: '''' || x.token || ''''), ', ') || ']' AS tie FROM c
  WHERE s.sur AND length(s.token) > 1 AND NOT contains(s.token, '-')
  AND NOT (len(list_filter(g, lambda x: length(x.token) = 1)) > 0 AND len(list_filter(o, lambda x: length(x.token) > 3)) > 0 AND len(list_filter(o, lambda x: length(x.token) > 3 AND x.sur)) = 0 AND s.slogp < -25)),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY name, way ORDER BY v DESC, CASE WHEN n = 2 AND pl = 2 THEN 1 ELSE 0 END DESC, tie DESC) AS nth FROM f) WHERE nth = 1),
m AS (SELECT *, CASE WHEN way = 0 THEN pl ELSE n + 1 - pl END AS pl0 FROM b),
z AS (SELECT *, {base_sql('s', 'g', 't', 'n', 'len(g)', 'pl0')} + {bonus_sql('s', 'g', 't', 'n', 'pl0', '(way = 0)', 'hint')} AS score FROM m),
y AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY round(score, 9) DESC, way) AS place, min(score) OVER (PARTITION BY name) AS least_, count(*) OVER (PARTITION BY name) AS orders FROM z)
SELECT name, s.token AS surname, array_to_string(list_transform(g, lambda x: x.token), ' ') AS given, way = 0 AS used_original, round(score, 6) AS score, CASE WHEN orders = 2 THEN abs(round(score - least_, 6)) END AS margin FROM y WHERE place = 1"""


@query("two_order_search", SEARCH_SQL)
def _(spark, sf_dir):
    """The better of the best parses of both orders, and by how much."""
    got = search.two_order_search(made_facts(spark, sf_dir), lex(spark))
    return got.select("name", F.array_join("surname", " ").alias("surname"), F.array_join("given", " ").alias("given"), "used_original", F.round("score", 6).alias("score"), F.abs(F.round("margin", 6)).alias("margin"))
