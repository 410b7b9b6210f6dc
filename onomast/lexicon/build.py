"""Offline builds of the lexicon's tables: spellings of surnames, and places of given syllables.

Both are plans over tables of any size: names are counted by partial
aggregates, and only tables of the size of a lexicon are joined to them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import norm, norm_light
from . import fixed
from .data import PENALTY_SHARE, Lexicon

#: Letters beyond which a given syllable is no candidate spelling.
LONGEST = 7
#: Distinct bylines that a syllable needs which no corpus has.
LEAST_BYLINES = 10
BYLINE = r"^([A-Za-z]+) ([A-Za-z]+-[A-Za-z]+)$|^([A-Za-z]+-[A-Za-z]+) ([A-Za-z]+)$"


def attested_spellings() -> list[tuple[str, str, bool]]:
    """(spelling, target, full): surname spellings in use in one word, and whether they keep the whole of their target's mass; where lists share a spelling the Cantonese one counts."""
    cantonese = [(k, v, k not in fixed.KOREAN_DOMINANT) for k, v in fixed.CANTONESE_SURNAMES.items() if " " not in k]
    return cantonese + [(k, v, True) for k, v in fixed.TAIWANESE_SURNAMES.items() if k not in fixed.CANTONESE_SURNAMES]


def candidate_spellings() -> list[str]:
    """Spellings that some table of rules remaps."""
    rules = (fixed.EXCEPTIONS, fixed.GIVEN_TOKEN_RULES, fixed.CANTONESE_SURNAME_RULES, fixed.CANTONESE_PHONETIC_RULES, fixed.TAIWANESE_RULES, fixed.WADE_GILES_SYLLABLES)
    return sorted({k for table in rules for k in table})


def romanization_table(mass: DataFrame, attested: DataFrame, syllables: DataFrame) -> DataFrame:
    """(spelling, mandarin_target, surname_ppm_as_written, target_share): spellings that are surnames by way of their target.

    mass: (key, ppm) of surnames in pinyin; attested: (key), spellings that are
    surnames as they stand; syllables: (syllable) of given names.  A spelling
    in use has all of its target's mass, or ``PENALTY_SHARE`` of it if Koreans
    use it far more.  Every other candidate or syllable of at most
    ``LONGEST`` letters has that share too, if remapping alone leads from it
    to a target with mass: those that are attested keep their own mass, and
    those that remapping leaves alone have no row.  Keys of mass that repeat
    count with their greatest; a target without mass gives 0 to the spellings
    in use.  An empty table of masses leaves these alone.
    """
    spark = mass.sparkSession
    mass = mass.where("key is not null").groupBy(F.col("key").alias("target")).agg(F.max("ppm").alias("ppm"))
    used = spark.createDataFrame(attested_spellings(), "spelling string, target string, whole boolean")
    share = F.when(F.col("whole"), 1.0).otherwise(round(PENALTY_SHARE, 10))
    ppm = F.coalesce("ppm", F.lit(0.0))
    kept = used.join(mass, "target", "left").select("spelling", "target", F.round(F.when(F.col("whole"), ppm).otherwise(ppm * PENALTY_SHARE), 4).alias("ppm"), share.alias("share"))
    words = spark.createDataFrame([(w,) for w in candidate_spellings()], "w string")
    words = words.unionByName(syllables.where(F.length("syllable") <= LONGEST).select(F.col("syllable").alias("w")))
    made = words.select(norm_light(F.col("w")).alias("spelling"), norm(F.col("w")).alias("target"))
    made = made.where(F.col("spelling").rlike("^[a-z]{2,}$") & (F.col("spelling") != F.col("target"))).groupBy("spelling").agg(F.min("target").alias("target"))
    made = made.join(used, "spelling", "left_anti").join(attested.select(F.col("key").alias("spelling")), "spelling", "left_anti")
    made = made.join(mass.where("ppm > 0"), "target").select("spelling", "target", F.round(F.col("ppm") * PENALTY_SHARE, 4).alias("ppm"), F.lit(round(PENALTY_SHARE, 10)).alias("share"))
    return kept.unionByName(made).select("spelling", F.col("target").alias("mandarin_target"), F.col("ppm").alias("surname_ppm_as_written"), F.col("share").alias("target_share"))


def conserved(table: DataFrame, mass: DataFrame) -> DataFrame:
    """(mandarin_target, spellings, ppm, most): of each target its spellings' number, its own mass and the greatest that a spelling has; none may have more than its target."""
    mass = mass.groupBy(F.col("key").alias("mandarin_target")).agg(F.max("ppm").alias("ppm"))
    out = table.groupBy("mandarin_target").agg(F.count("*").alias("spellings"), F.max("surname_ppm_as_written").alias("most"))
    out = out.join(mass, "mandarin_target", "left")
    over = F.col("most") > F.coalesce("ppm", F.lit(0.0)) + 1e-4
    return out.select("mandarin_target", "spellings", "ppm", F.when(over, F.raise_error(F.concat(F.lit("more mass than its target has: "), "mandarin_target")).cast("double")).otherwise(F.col("most")).alias("most"))


def _placed(pairs: DataFrame, initial: Column, final: Column) -> DataFrame:
    """Rows of pairs as (syllable, initial_count, final_count)."""
    one, two = F.struct(initial.alias("syllable"), F.lit(1).alias("i"), F.lit(0).alias("f")), F.struct(final.alias("syllable"), F.lit(0).alias("i"), F.lit(1).alias("f"))
    return pairs.select(F.explode(F.array(one, two)).alias("x")).groupBy("x.syllable").agg(F.sum("x.i").alias("initial_count"), F.sum("x.f").alias("final_count"))


def corpus_places(names: DataFrame, surnames: DataFrame, readings: DataFrame) -> DataFrame:
    """(syllable, initial_count, final_count) of given names of two characters.

    names: (name) in Han characters, surname first; every row counts.  A name
    has two to four letters, and nothing else; its surname is the first two
    characters, if they are one and a character is left, else the first.
    Names without a known surname are left out, and null ones.  A character
    without a reading stands for itself.
    """
    known = surnames.select(F.col("surname").alias("s"), F.lit(True).alias("is")).distinct()
    n = names.select(F.regexp_replace("name", r"(?U)^\s+|\s+$", "").alias("name")).where(F.col("name").rlike(r"^\p{L}{2,4}$"))
    n = n.withColumns({"a": F.substring("name", 1, 1), "b": F.when(F.length("name") >= 3, F.substring("name", 1, 2))})
    n = n.join(known.toDF("a", "one"), "a", "left").join(known.toDF("b", "two"), "b", "left")
    cut = F.when(F.col("two"), 2).when(F.col("one"), 1)
    given = F.substring("name", cut + 1, F.length("name"))
    # Pairs first: a corpus has far fewer of them than names.
    pairs = n.select(given.alias("given")).where(F.length("given") == 2).groupBy("given").agg(F.count("*").alias("n"))
    at = pairs.select("n", F.posexplode(F.array(F.substring("given", 1, 1), F.substring("given", 2, 1))).alias("i", "ch"))
    read = at.join(readings.select("ch", "pinyin"), "ch", "left").withColumn("syllable", norm_light(F.coalesce("pinyin", "ch")))
    place = lambda i: F.sum(F.when(F.col("i") == i, F.col("n")).otherwise(0))
    return read.groupBy("syllable").agg(place(0).alias("initial_count"), place(1).alias("final_count"))


def byline_places(names: DataFrame, surnames: DataFrame, syllables: DataFrame) -> DataFrame:
    """(syllable, initial_count, final_count) of hyphenated given names in bylines of two tokens.

    names: (name); each distinct one counts once.  surnames: (s), the tokens,
    in lower case, that are surnames; syllables: (syllable), those that may be
    parts.  A given name that is a compound surname is left out.
    """
    part = lambda k: F.regexp_extract("name", BYLINE, k)
    n = names.where(F.col("name").rlike(BYLINE)).select("name").distinct()
    n = n.select(F.lower(F.concat(part(1), part(4))).alias("s"), F.lower(F.concat(part(2), part(3))).alias("given"))
    compounds = {k for k in fixed.COMPOUND_VARIANTS if "-" in k} | {v.replace(" ", "-") for v in fixed.COMPOUND_VARIANTS.values()}
    n = n.where(~F.col("given").isin(*sorted(compounds))).join(surnames.select("s").distinct(), "s", "left_semi")
    n = n.select(F.split("given", "-")[0].alias("a"), F.split("given", "-")[1].alias("b"))
    for c in ("a", "b"):
        n = n.join(syllables.select(F.col("syllable").alias(c)).distinct(), c, "left_semi")
    return _placed(n, norm_light(F.col("a")), norm_light(F.col("b")))


def position_table(corpus: DataFrame, bylines: DataFrame | None = None, least: int = LEAST_BYLINES) -> DataFrame:
    """(syllable, initial_count, final_count, source) of a corpus' counts, and of bylines' as heavy as they all in all.

    Bylines' counts are scaled by the ratio of both sums of first places,
    rounded half to even, and to 1 at least; a syllable that the corpus
    lacks needs ``least`` bylines.  Bylines without a count are an error.
    """
    if bylines is None:
        return corpus.select("syllable", "initial_count", "final_count", F.lit("corpus").alias("source"))
    sums = corpus.agg(F.sum("initial_count").alias("c")).crossJoin(bylines.agg(F.sum("initial_count").alias("b")))  # one row
    none = F.raise_error(F.lit("no byline has a surname and a hyphenated given name")).cast("double")
    factor = sums.select(F.when(F.coalesce("b", F.lit(0)) > 0, F.coalesce("c", F.lit(0)) / F.col("b")).otherwise(none).alias("factor"))
    b = bylines.select("syllable", F.col("initial_count").alias("bi"), F.col("final_count").alias("bf"), F.lit(True).alias("in_b"))
    both = corpus.withColumn("in_c", F.lit(True)).join(b, "syllable", "full").crossJoin(F.broadcast(factor))  # one row
    zero = lambda c: F.coalesce(c, F.lit(0))
    scaled = lambda c: F.when(zero(c) > 0, F.greatest(F.lit(1), F.bround(F.col(c) * F.col("factor")).cast("long"))).otherwise(0)
    both = both.where(F.col("in_c") | (zero("bi") + zero("bf") >= least))
    source = F.when(F.col("in_c").isNull(), "byline").when(F.col("in_b"), "corpus+byline").otherwise("corpus")
    return both.select("syllable", (zero("initial_count") + scaled("bi")).cast("long").alias("initial_count"), (zero("final_count") + scaled("bf")).cast("long").alias("final_count"), source.alias("source"))


def rebuilt(lex: Lexicon, corpus: DataFrame, bylines: DataFrame | None = None, surnames: DataFrame | None = None) -> Lexicon:
    """A lexicon with the places that a corpus of names (name) and bylines give; surnames: (s) for the bylines."""
    known = surnames if surnames is not None else lex.keys().where("as_written or normal").select(F.col("key").alias("s"))
    places = corpus_places(corpus, lex.surname, lex.readings())
    more = byline_places(bylines, known, lex.syllables().where("plausible")) if bylines is not None else None
    return Lexicon(lex.surname, position_table(places, more).select("syllable", "initial_count", "final_count"), lex.romanization)
