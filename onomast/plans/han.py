"""Registered queries on names in Han characters alone, made from keys: features, and the model that tells Chinese from Japanese ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import among
from ..operators import japanese
from .catalogue import query, quoted
from .stage import keep

#: Bound on the labelled names that jp_train and jp_prob fit on.
TRAIN_ROWS = 40_000
SUR = "王 李 张 欧阳 佐々木 山本 田中 辺 林 高橋 赵 浜田 曾 陈 龘 井".split()
GIV = "明 子 太郎 美咲 小红 伟 建国 浩一 雅 文雄 々 秀英 空 思雨 正義 桜 华华 静香 勇 之助".split()
MIXED = f"""n AS (SELECT l_orderkey AS k, l_linenumber::INT AS i, CASE WHEN l_linenumber % 7 = 6 THEN [{quoted(SUR)}][1 + l_suppkey % {len(SUR)}] ELSE [{quoted(SUR)}][1 + l_suppkey % {len(SUR)}] || [{quoted(GIV)}][1 + l_partkey % {len(GIV)}] END AS name FROM lineitem)"""


def _any(x: str, chars: str) -> str:
    return f"(CASE WHEN regexp_matches({x}, '[{chars}]') THEN 1.0 ELSE 0.0 END)::DOUBLE"


def flags_sql() -> str:
    j, n, first, two, last, rest = japanese, "length(name)", "name[1]", "name[1:2]", "name[length(name)]", "name[2:]"
    share = lambda chars: f"round(length(regexp_replace(name, '[^{chars}]', '', 'g')) / {n}, 6)::DOUBLE"
    cells = {
        "jp_iter_mark": _any("name", j.ITERATION), "jp_surname_chars": _any(two, j.JP_SURNAME), "cn_surname_chars": _any(two, j.CN_SURNAME), "jp_name_endings": _any(last, j.JP_ENDING), "cn_name_endings": _any(last, j.CN_ENDING),
        "jp_unique_chars": _any("name", j.JP_UNIQUE), "cn_simplified_chars": _any("name", j.CN_SIMPLIFIED), "len_eq2": f"({n} = 2)::INT::DOUBLE", "len_eq3": f"({n} = 3)::INT::DOUBLE", "len_ge4": f"({n} >= 4)::INT::DOUBLE",
        "jp_frequent_chars": _any("name", j.JP_FREQUENT), "cn_frequent_chars": _any("name", j.CN_FREQUENT), "surname_jp_pattern": _any(first, j.JP_SURNAME), "surname_cn_pattern": _any(first, j.CN_SURNAME),
        "given_jp_pattern": _any(rest, j.JP_ENDING), "given_cn_pattern": _any(rest, j.CN_ENDING), "jp_ending_ratio": share(j.JP_ENDING), "cn_ending_ratio": share(j.CN_ENDING),
        "char_diversity": f"round(len(list_distinct(string_split(name, ''))) / {n}, 6)::DOUBLE",
        "avg_char_strokes": f"round(coalesce(list_avg(list_transform(list_filter(string_split(name, ''), lambda c: ord(c) BETWEEN 19968 AND 40959), lambda c: (ord(c) - 19968) / 20991)), 0), 6)::DOUBLE",
    }
    return ", ".join(f"{v} AS {k}" for k, v in cells.items())


@query("jp_flags", f"WITH {MIXED} SELECT k, i, name, {flags_sql()} FROM n")
def _(spark, sf_dir):
    """The features of each name."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    of = lambda words, c: F.element_at(among(words), (F.col(c) % len(words) + 1).cast("int"))
    name = F.when(F.col("l_linenumber") % 7 == 6, of(SUR, "l_suppkey")).otherwise(F.concat(of(SUR, "l_suppkey"), of(GIV, "l_partkey")))
    rows = li.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("i"), name.alias("name"))
    return rows.select("k", "i", "name", *[F.round(v, 6).alias(c) for c, v in japanese.flags(F.col("name")).items()])


def made_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(name, label, held_out): distinct labelled names made from the keys of lineitem; a third of them is held out by its crc32."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    ids = li.select(F.xxhash64("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"))
    # A name that both kinds give counts as Chinese.
    names = japanese.labelled(ids).groupBy("name").agg(F.min("label").alias("label"))
    return keep(names.withColumn("held_out", F.crc32(F.col("name").cast("binary")) % 3 == 1), "han-names")


def fitted(names: DataFrame, rows: int = TRAIN_ROWS):
    """A model of at most ``rows`` of the names that aren't held out, by the order of their hashes."""
    some = names.where("not held_out").orderBy(F.xxhash64("name"), "name").limit(rows)
    some = keep(some, "han-train")
    return japanese.train(some.where("label = 0"), some.where("label = 1"), regularisation=japanese.BUILTIN_C)


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = made_names(spark, sf_dir)
    return names.join(japanese.probabilities(fitted(names), names), "name")


@query("jp_prob")
def _(spark, sf_dir):
    """The probability of each distinct name to be Japanese, by a model of names that aren't held out."""
    return judged(spark, sf_dir).select("name", "label", "held_out", F.round("probability", 3).alias("probability"), (F.col("probability") >= 0.8).alias("rejected"))


@query("jp_train")
def _(spark, sf_dir):
    """How that model does: names, right ones, and those that a gate of 0.8 rejects, of each kind, seen and held out."""
    right = (F.col("probability") >= 0.5) == (F.col("label") == 1)
    count = lambda c: F.sum(c.cast("long"))
    return judged(spark, sf_dir).groupBy("label", "held_out").agg(F.count("*").alias("names"), count(right).alias("right"), count(F.col("probability") >= 0.8).alias("rejected"))
