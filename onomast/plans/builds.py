"""Registered queries of the lexicon's offline builds, over names made from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import among, norm_light
from ..lexicon import build, fixed
from . import names as plans
from .catalogue import LIGHT, NAMES, NORM_SQL, WADE_SQL, lex, query, quoted
from ..sources import resources
from .stage import fresh, keep

# Surnames and given characters of the made corpus; the last of either is no surname, or none that is read.
HAN_SUR = "王 李 张 刘 陈 欧阳 司马 诸葛 林 郭 吕 龘".split()
HAN_GIV = "明 华 伟 丽 芳 军 杰 娟 涛 静 敏 强 磊 洋 勇 艳 超 秀 霞 平 刚 桂 英 志 文 建 国 晓 小 红 玉 女".split()
# How they are read.
READ = "ming hua wei li fang jun jie juan tao jing min qiang lei yang yong yan chao xiu xia ping gang gui ying zhi wen jian guo xiao xiao hong yu nv".split()
BY_SUR = "Li Wang Chen Smith Ouyang Tsai Zhang Brown".split()
BY_GIV = "Wen-Gang Hao-Ran Au-Yeung Kung-Pao Xx-Gang Mei-Ling Zhi-Qiang Wengang".split()
CORPUS = f"""corpus AS (SELECT CASE l_linenumber % 7 WHEN 0 THEN s || g1 WHEN 1 THEN s || g1 || g2 || g1 WHEN 2 THEN ' ' || s || g1 || g2 || '\t' WHEN 3 THEN s || g1 || '1' WHEN 4 THEN NULL ELSE s || g1 || g2 END AS name FROM (
  SELECT l_linenumber, [{quoted(HAN_SUR)}][1 + l_suppkey % {len(HAN_SUR)}] AS s, [{quoted(HAN_GIV)}][1 + l_partkey % {len(HAN_GIV)}] AS g1, [{quoted(HAN_GIV)}][1 + l_orderkey % {len(HAN_GIV)}] AS g2 FROM lineitem)),
by0 AS (SELECT [{quoted(BY_SUR)}][1 + l_suppkey % {len(BY_SUR)}] AS s, [{quoted(BY_GIV)}][1 + l_partkey % {len(BY_GIV)}] AS g, l_linenumber % 3 AS k, l_orderkey % 40 AS o FROM lineitem),
bylines AS (SELECT CASE WHEN k = 0 THEN s || ' ' || g WHEN k = 1 THEN g || ' ' || s ELSE upper(s) || ' ' || g || repeat('x', (o % 2)::INT) END AS name FROM by0)"""


def made_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    at = lambda words, c: F.element_at(among(words), (F.col(c) % len(words) + 1).cast("int"))
    s, a, b, k = at(HAN_SUR, "l_suppkey"), at(HAN_GIV, "l_partkey"), at(HAN_GIV, "l_orderkey"), F.col("l_linenumber") % 7
    whole = F.concat(s, a, b)
    name = F.when(k == 0, F.concat(s, a)).when(k == 1, F.concat(whole, a)).when(k == 2, F.concat(F.lit(" "), whole, F.lit("\t"))).when(k == 3, F.concat(s, a, F.lit("1"))).when(k == 4, None).otherwise(whole)
    return li.select(name.alias("name"))


def made_bylines(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    at = lambda words, c: F.element_at(among(words), (F.col(c) % len(words) + 1).cast("int"))
    s, g, k = at(BY_SUR, "l_suppkey"), at(BY_GIV, "l_partkey"), F.col("l_linenumber") % 3
    tail = F.when(F.col("l_orderkey") % 2 == 1, "x").otherwise("")
    return li.select(F.when(k == 0, F.concat_ws(" ", s, g)).when(k == 1, F.concat_ws(" ", g, s)).otherwise(F.concat(F.upper(s), F.lit(" "), g, tail)).alias("name"))


POSITION_SQL = f"""WITH {CORPUS}, inv(s) AS (VALUES {", ".join(f"('{s}')" for s in HAN_SUR[:-1])}), rd(ch, p) AS (VALUES {", ".join(f"('{c}', '{p}')" for c, p in zip(HAN_GIV, READ))}),
n AS (SELECT regexp_replace(name, '^\\s+|\\s+$', '', 'g') AS name FROM corpus), f AS (SELECT name FROM n WHERE regexp_full_match(name, '\\p{{L}}{{2,4}}')),
cut AS (SELECT CASE WHEN length(name) >= 3 AND name[1:2] IN (SELECT s FROM inv) THEN name[3:] WHEN name[1] IN (SELECT s FROM inv) THEN name[2:] END AS g FROM f),
pair AS (SELECT g[1] AS a, g[2] AS b FROM cut WHERE length(g) = 2),
c AS (SELECT p AS syllable, sum(i)::BIGINT AS i, sum(z)::BIGINT AS f FROM (SELECT a AS ch, 1 AS i, 0 AS z FROM pair UNION ALL SELECT b, 0, 1 FROM pair) JOIN rd USING (ch) GROUP BY p),
d AS (SELECT DISTINCT name FROM bylines WHERE regexp_full_match(name, '[A-Za-z]+ [A-Za-z]+-[A-Za-z]+|[A-Za-z]+-[A-Za-z]+ [A-Za-z]+')),
e AS (SELECT lower(CASE WHEN contains(split_part(name, ' ', 1), '-') THEN split_part(name, ' ', 2) ELSE split_part(name, ' ', 1) END) AS s, lower(CASE WHEN contains(split_part(name, ' ', 1), '-') THEN split_part(name, ' ', 1) ELSE split_part(name, ' ', 2) END) AS g FROM d),
h AS (SELECT split_part(g, '-', 1) AS a, split_part(g, '-', 2) AS b FROM e WHERE s IN ('li', 'wang', 'chen', 'ouyang', 'tsai', 'zhang') AND g <> 'au-yeung'),
ok AS (SELECT a, b FROM h WHERE a IN ('wen', 'hao', 'mei', 'zhi') AND b IN ('gang', 'ran', 'ling', 'qiang')),
y AS (SELECT syllable, sum(i)::BIGINT AS i, sum(z)::BIGINT AS f FROM (SELECT a AS syllable, 1 AS i, 0 AS z FROM ok UNION ALL SELECT b, 0, 1 FROM ok) GROUP BY syllable),
k AS (SELECT (SELECT sum(i) FROM c)::DOUBLE / (SELECT sum(i) FROM y)::DOUBLE AS factor)
SELECT coalesce(c.syllable, y.syllable) AS syllable, (coalesce(c.i, 0) + CASE WHEN y.i > 0 THEN greatest(1, round_even(y.i * factor, 0)) ELSE 0 END)::BIGINT AS initial_count,
  (coalesce(c.f, 0) + CASE WHEN y.f > 0 THEN greatest(1, round_even(y.f * factor, 0)) ELSE 0 END)::BIGINT AS final_count,
  CASE WHEN c.syllable IS NULL THEN 'byline' WHEN y.syllable IS NULL THEN 'corpus' ELSE 'corpus+byline' END AS source
FROM c FULL JOIN y ON c.syllable = y.syllable, k WHERE c.syllable IS NOT NULL OR coalesce(y.i, 0) + coalesce(y.f, 0) >= 4"""


@query("lex_position_gen", POSITION_SQL)
def _(spark, sf_dir):
    """Places of given syllables in a corpus of Han names and in bylines, pooled."""
    x = lex(spark)
    bylines = made_bylines(spark, sf_dir)
    surnames = x.keys().where("as_written or normal").select(F.col("key").alias("s"))
    corpus = keep(build.corpus_places(made_corpus(spark, sf_dir), x.surname, x.readings()), "corpus-places")
    by = keep(build.byline_places(bylines, surnames, x.syllables().where("plausible")), "byline-places")
    return build.position_table(corpus, by, least=4)


def attested_mass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, ppm): the surnames of the made names, without marks, and their share per million names."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    key = norm_light(F.element_at(among(plans.SUR), (F.col("l_suppkey") % len(plans.SUR) + 1).cast("int")))
    counts = li.groupBy(key.alias("key")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("t"))
    return counts.crossJoin(F.broadcast(total)).select("key", (F.col("n") * 1e6 / F.col("t")).alias("ppm"))  # one row


GIVEN_WORDS = "wei ming hua jing mei lan hong hao ying yan feng chih kung tsao chou".split()
USED = ", ".join(f"('{s}', '{t}', {str(w).lower()})" for s, t, w in build.attested_spellings())
ROMAN_SQL = f"""WITH m0 AS (SELECT {LIGHT % ("[" + quoted(plans.SUR) + "][1 + l_suppkey % " + str(len(plans.SUR)) + "]")} AS key, count(*) AS n FROM lineitem GROUP BY 1), mass AS (SELECT key, n * 1e6::DOUBLE / (SELECT sum(n) FROM m0) AS ppm FROM m0),
used(spelling, target, whole) AS (VALUES {USED}), words(w) AS (VALUES {", ".join(f"('{w.replace(chr(39), chr(39) * 2)}')" for w in sorted({*build.candidate_spellings(), *GIVEN_WORDS}))}){WADE_SQL},
made AS (SELECT {LIGHT % 'w'} AS spelling, min({NORM_SQL}) AS target FROM wade LEFT JOIN lay ON lay.k = l GROUP BY 1)
SELECT spelling, target AS mandarin_target, round(coalesce(ppm, 0) * CASE WHEN whole THEN 1 ELSE exp(-4) END, 4) AS surname_ppm_as_written, CASE WHEN whole THEN 1.0 ELSE round(exp(-4), 10) END::DOUBLE AS target_share FROM used LEFT JOIN mass ON key = target
UNION ALL SELECT spelling, target, round(ppm * exp(-4), 4), round(exp(-4), 10)::DOUBLE FROM made JOIN mass ON key = target WHERE regexp_full_match(spelling, '[a-z]{{2,}}') AND spelling <> target AND spelling NOT IN (SELECT spelling FROM used) AND spelling NOT IN (SELECT key FROM mass)"""


@query("lex_romanization_gen", ROMAN_SQL)
def _(spark, sf_dir):
    """Spellings of surnames, by the masses of the surnames that the names have."""
    mass = keep(attested_mass(spark, sf_dir), "mass")
    return build.romanization_table(mass, mass.select("key"), spark.createDataFrame([(w,) for w in GIVEN_WORDS], "syllable string"))


@query("src_surname", f"WITH m0 AS (SELECT {LIGHT % ('[' + quoted(plans.SUR) + '][1 + l_suppkey % ' + str(len(plans.SUR)) + ']')} AS key, count(*) AS n FROM lineitem GROUP BY 1) SELECT key AS surname, round(n * 1e6::DOUBLE / (SELECT sum(n) FROM m0), 4) AS ppm FROM m0")
def _(spark, sf_dir):
    """A table of surnames written with its checksum, and read back."""
    folder = fresh("lexicon", spark)
    resources.write_tables({"surname": attested_mass(spark, sf_dir).select(F.col("key").alias("surname"), F.round("ppm", 4).alias("ppm"))}, folder)
    return resources.read_tables(spark, folder, {"surname": "surname string, ppm double"})["surname"]
