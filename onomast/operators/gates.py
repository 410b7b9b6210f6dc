"""Input gates: which strings can't be a personal name, and why."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import CJK, SEPARATORS, cjk_chunks, norm
from ..lexicon.data import Lexicon
from .facts import DOMINANT, _original_forms

# What an organisation's name is or ends with, and letters that other languages alone use.
ORG = ("大学", "学院", "研究所", "实验室", "编辑部", "科学院", "公司", "有限公司", "研究中心", "重点实验室", "国家实验室", "物理系", "学部")
FOREIGN = r"[\x{1100}-\x{11FF}\x{3130}-\x{318F}\x{AC00}-\x{D7AF}\x{3040}-\x{30FF}ĐđăâêôơưĂÂÊÔƠƯ]"
MAX_LENGTH = 100
LIST_WORDS, LIST_SURNAMES = 6, 3
WORD = r"\p{L}+(?:[-']\p{L}+)?"
LENGTH, PUNCT, SCRIPT, PERSON, SHORT = (
    "invalid input length",
    "name contains only punctuation/whitespace",
    "contains non-Chinese characters",
    "not a personal name",
    "needs at least 2 Roman tokens",
)


def gate_length(name: Column) -> Column:
    return name.isNull() | (F.length(name) == 0) | (F.length(name) > MAX_LENGTH)


def gate_punct(name: Column) -> Column:
    return name.rlike(r"^[!-/:-@\[-`{-~\s]*$")


def gate_script(name: Column) -> Column:
    return name.rlike(FOREIGN)


def gate_org(name: Column) -> Column:
    """A run of Han characters is a marker, or ends with one after two characters or more."""
    marks = "|".join(ORG)
    return F.exists(cjk_chunks(name), lambda x: x.rlike(f"^(?:{marks})$") | x.rlike(f"^.{{2,}}(?:{marks})$"))


def list_words(name: Column) -> Column:
    """Latin words of a name that may be a list of authors: six or more, and no Han."""
    words = F.regexp_extract_all(name, F.lit(WORD), F.lit(0))
    return F.when(~name.rlike(f"[{CJK}]") & (F.size(words) >= LIST_WORDS), words)


def surname_like(words: DataFrame, lex: Lexicon) -> DataFrame:
    """Those of the words (w) that are a surname's spelling, hyphens and apostrophes opened; no single letters."""
    parts = F.transform(F.filter(F.split("w", "[-']"), lambda p: p != ""), norm)
    t = words.select("w").distinct().where(F.length("w") > 1).withColumns({"low": F.lower("w"), "spaced": F.array_join(parts, " "), "fused": F.array_join(parts, "")})
    k = lex.keys()
    own = k.where("alias or as_written").select(F.col("key").alias("low"), F.lit(True).alias("a"), "alias")
    known = k.where("as_written or normal").select(F.col("key").alias("fused"), F.lit(True).alias("b"))
    pair = k.where("compound and key = whole").select(F.col("key").alias("spaced"), F.lit(True).alias("c"))
    t = t.join(F.broadcast(own), "low", "left").join(F.broadcast(known), "fused", "left").join(F.broadcast(pair), "spaced", "left")
    hit = (F.col("a") & (F.col("alias") | (F.col("w") == F.col("low")))) | F.col("b") | F.col("c") | F.col("fused").isin(*_original_forms())
    return t.where(hit).select("w")


def author_lists(names: DataFrame, lex: Lexicon) -> DataFrame:
    """Those of the distinct names (name) that list authors: three surnames or more, one at the head, one inside, one at the tail.

    Words are counted by 96 bits of hashes of their list, not by its text.
    """
    key = {"_a": F.xxhash64("name"), "_b": F.hash("name")}
    at = names.select(*[v.alias(k) for k, v in key.items()], list_words(F.col("name")).alias("ws")).where("ws is not null").select("_a", "_b", F.size("ws").alias("n"), F.posexplode("ws").alias("i", "w"))
    hits = at.join(surname_like(at, lex), "w")
    inside = (F.col("i") > 1) & (F.col("i") < F.col("n") - 2)
    g = hits.groupBy("_a", "_b").agg(F.count("*").alias("k"), F.min("i").alias("first"), F.bool_or(inside).alias("inside"), F.bool_or(F.col("i") >= F.col("n") - 2).alias("last"))
    g = g.where((F.col("k") >= LIST_SURNAMES) & (F.col("first") <= 1) & F.col("inside") & F.col("last")).select("_a", "_b")
    return names.withColumns(key).join(g, ["_a", "_b"], "left_semi").select("name")


def initial_bridge(name: Column) -> Column:
    """A run of separators right between a single Latin letter and Han; a last letter after Han is a middle initial."""
    sep = f"[{SEPARATORS}]+"
    return name.rlike(f"[A-Za-z]{sep}[{CJK}]") | name.rlike(f"[{CJK}]{sep}[A-Za-z](?=.*[A-Za-z])")


def initials_only(name: Column) -> Column:
    """Han in runs of two or more, and Latin in single letters alone."""
    return name.rlike("[A-Za-z]") & ~name.rlike("[A-Za-z]{2}") & name.rlike(f"[{CJK}]{{2}}")


def chinese_chunk(facts_of_first: Column, spaced: Column) -> Column:
    return (facts_of_first >= DOMINANT) | spaced


def gate_initial_translit(name: Column, looks_chinese: Column, aligned: Column | None = None) -> Column:
    """A foreign initial before its transliteration in Han (``G.霍弗``); not where a single letter stands by a Chinese name."""
    one = F.size(F.regexp_extract_all(name, F.lit("[A-Za-z]+"), F.lit(0))) == 1
    bilingual = F.lit(False) if aligned is None else aligned
    return initials_only(name) & ~(one & looks_chinese) & ~bilingual & initial_bridge(name)


def failure(name: Column) -> Column:
    """The first reason, of those that need no lexicon, to reject a name before it is parsed; else null."""
    return F.when(gate_length(name), LENGTH).when(gate_punct(name), PUNCT).when(gate_script(name), SCRIPT).when(gate_org(name), PERSON)
