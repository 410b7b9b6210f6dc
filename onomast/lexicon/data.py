"""The lexicon: surnames, given syllables and spellings as small DataFrames.

Sources are three tables: surnames in Han characters, given syllables with
counts by place, and spellings of surnames.  What parsing looks up follows
from them and is worked out once for an application: a few thousand rows.
"""

from __future__ import annotations

import math
import unicodedata
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.phonetics import plausible_syllable
from ..functions.text import norm, norm_light
from ..sources import resources
from . import fixed, tables

DEFAULT_LOGP = -15.0
#: Share of its target's mass that a spelling keeps which is a surname by remapping alone.
PENALTY_SHARE = math.exp(-4.0)
COMPOUND_PENALTY, COMPOUND_FLOOR = 0.1, 0.1
#: Most frequent character's share of a syllable, and its share among all keys: the scale of given-name log shares.
GIVEN_SCALE = 1.0
SMOOTHING = 0.5

#: Settings of a session: a folder of saved tables instead of the built-in ones, and whether it has spellings.
FOLDER_KEY, ROMANIZATION_KEY = "spark.onomast.lexicon", "spark.onomast.lexicon.romanization"
_BUILTIN: dict[str | tuple[str, str], Lexicon] = {}
SURNAME = "surname string, ppm double"
GIVEN = "syllable string, initial_count long, final_count long"
ROMANIZATION = "spelling string, mandarin_target string, surname_ppm_as_written double, target_share double"
KEY = "key string, ordinal int, ppm double, base boolean, compound boolean, whole string, as_written boolean, normal boolean, alias boolean, target string, share double, written_ppm double, parts_normal boolean"


@dataclass
class Lexicon:
    """surname (surname, ppm), given (syllable, initial_count, final_count) and, if it isn't to be made by rule, romanization (spelling, mandarin_target, surname_ppm_as_written, target_share)."""

    surname: DataFrame
    given: DataFrame
    romanization: DataFrame | None = None
    unseen: int = 0
    known: dict = field(default_factory=dict)

    @property
    def spark(self) -> SparkSession:
        return self.surname.sparkSession

    @classmethod
    def builtin(cls, spark: SparkSession) -> Lexicon:
        """The built-in tables, or those that ``FOLDER_KEY`` names, made once for an application."""
        app, folder = spark.sparkContext.applicationId, spark.conf.get(FOLDER_KEY, None)
        if folder and (app, folder) not in _BUILTIN:
            _BUILTIN.clear()
            _BUILTIN[app, folder] = cls.load(spark, folder, spark.conf.get(ROMANIZATION_KEY, "false") == "true")
        if folder:
            return _BUILTIN[app, folder]
        if app not in _BUILTIN:
            _BUILTIN.clear()
            read = han_readings(spark)
            syllables = tables.given([r["pinyin"] for r in read.collect()])
            _BUILTIN[app] = cls(spark.createDataFrame(tables.surnames(), SURNAME), spark.createDataFrame(syllables, GIVEN), None, tables.UNSEEN, {"readings": read})
        return _BUILTIN[app]

    @classmethod
    def from_csv(cls, spark: SparkSession, folder: str, romanization: bool = True) -> Lexicon:
        """Reads surname.csv, given.csv and, if wanted, romanization.csv, with the columns named above, and checks them."""
        read = lambda name, schema: spark.read.csv(f"{folder}/{name}.csv", header=True, schema=schema)
        roman = None
        if romanization:
            roman = read("romanization", ROMANIZATION)
            fair = (F.col("target_share") > 0) & (F.col("target_share") <= 1) & (F.col("surname_ppm_as_written") >= 0) & ~F.isnan("surname_ppm_as_written")
            roman = roman.withColumn("target_share", F.when(fair, F.col("target_share")).otherwise(F.raise_error(F.lit("bad romanization row")).cast("double")))
        return cls(read("surname", SURNAME), read("given", GIVEN), roman)

    def save(self, folder: str) -> None:
        """Writes the tables that the lexicon starts from, with their checksums."""
        rows = {"surname": self.surname.select("surname", "ppm"), "given": self.given.select("syllable", "initial_count", "final_count")}
        if self.romanization is not None:
            rows["romanization"] = self.romanization.select("spelling", "mandarin_target", "surname_ppm_as_written", "target_share")
        resources.write_tables(rows, folder)

    @classmethod
    def load(cls, spark: SparkSession, folder: str, romanization: bool = False) -> Lexicon:
        """A lexicon that ``save`` wrote; tables of another schema or other rows are an error."""
        schemas = {"surname": SURNAME, "given": GIVEN} | ({"romanization": ROMANIZATION} if romanization else {})
        got = resources.read_tables(spark, folder, {k: v.replace(" long", " bigint") for k, v in schemas.items()})
        return cls(local(got["surname"]), local(got["given"]), local(got["romanization"]) if romanization else None)

    def readings(self) -> DataFrame:
        if "readings" not in self.known:
            self.known["readings"] = han_readings(self.spark)
        return self.known["readings"]

    def keys(self) -> DataFrame:
        """Surname keys with everything that a lookup by key gives; see ``KEY``, and logp and rank."""
        if "keys" not in self.known:
            rows = surname_keys(self)
            logp, rank = surname_logp(rows), surname_rank(rows.where("ppm is not null").unionByName(_unseen(self), allowMissingColumns=True))
            out = rows.join(logp.select("key", "logp"), "key", "left").join(rank.where("key <> ''"), "key", "left")
            self.known["keys"] = local(out)
        return self.known["keys"]

    def syllables(self) -> DataFrame:
        """(syllable, logp, initial_logp, final_logp, is_given, plausible, anchor)."""
        if "syllables" not in self.known:
            self.known["syllables"] = local(given_logp(self))
        return self.known["syllables"]

    def compounds(self) -> dict[str, dict]:
        """Compound surnames, a few hundred: whole spelling (lower case, spaced, hyphenated or fused) to its target and what the target's key gives."""
        if "compounds" not in self.known:
            self.known["compounds"] = {r["key"]: r.asDict() for r in self.keys().where("compound").collect()}
        return self.known["compounds"]

    def han_ppm(self) -> dict[str, float]:
        """Surnames in Han characters, a few hundred, and their shares."""
        if "han" not in self.known:
            self.known["han"] = dict(map(tuple, self.surname.groupBy("surname").agg(F.max("ppm")).collect()))
        return self.known["han"]

    def group_ppm(self) -> dict[str, float]:
        """Surnames of two syllables or more in pinyin, spaced and fused, and their shares."""
        if "groups" not in self.known:
            read = {"".join(p) for _, _, p in _read_surnames(self) if len(p) > 1}
            self.known["groups"] = {r[0]: r[1] for r in self.keys().where("ppm is not null").where(F.col("compound") | F.col("key").isin(*read)).select("key", "ppm").collect()}
        return self.known["groups"]

    def markers(self) -> DataFrame:
        """(key, tier): keys that no Chinese name has; 1 Western, 2 Korean-only, 3 Japanese, 4 Vietnamese-only."""
        if "markers" not in self.known:
            tier = {w: i for i, words in reversed(list(enumerate((fixed.WESTERN, fixed.KOREAN_ONLY, fixed.JAPANESE, fixed.VIETNAMESE_ONLY), 1))) for w in words}
            self.known["markers"] = self.spark.createDataFrame(list(tier.items()), "key string, tier int")
        return self.known["markers"]

    def place_defaults(self) -> tuple[float, float]:
        """Log shares of a syllable that was never seen in first and in last place."""
        if "defaults" not in self.known:
            t = self.given.agg(F.sum("initial_count"), F.sum("final_count"), F.count("*")).first()
            self.known["defaults"] = tuple(math.log(SMOOTHING / (t[i] + SMOOTHING * (t[2] + 1))) for i in (0, 1))
        return self.known["defaults"]


def local(df: DataFrame) -> DataFrame:
    """A small table worked out once."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


def han_readings(spark: SparkSession) -> DataFrame:
    """(ch, pinyin): the reading of each unified ideograph, without tones, ü as v; from the ICU library in Spark's own jars."""
    chars = [chr(c) for c in range(0x4E00, 0xA000)]
    icu = spark._jvm.com.ibm.icu.text.Transliterator.getInstance("Han-Latin")
    read = icu.transliterate("\n".join(chars)).split("\n")
    rows = []
    for ch, r in zip(chars, read):
        plain = "".join(c for c in unicodedata.normalize("NFD", unicodedata.normalize("NFC", r).translate({0xFC: "v", 0x1D6: "v", 0x1D8: "v", 0x1DA: "v", 0x1DC: "v"})) if not unicodedata.combining(c))
        if plain != ch:
            rows.append((ch, plain.strip()))
    return spark.createDataFrame(rows, "ch string, pinyin string")


def normalised(spark: SparkSession, words) -> dict[str, str]:
    """Each word's pinyin by the rules of ``norm``."""
    df = spark.createDataFrame([(w,) for w in sorted(set(words))], "w string")
    return dict(map(tuple, df.select("w", norm(F.col("w"))).collect()))


def _read_surnames(lex: Lexicon) -> list[tuple[str, float, list[str]]]:
    """(Han, ppm, readings of its characters) in the order of the table."""
    reading = dict(map(tuple, lex.readings().collect()))
    reading |= fixed.SURNAME_READINGS
    return [(s, p or 0.0, [reading.get(c, c) for c in s]) for s, p in lex.surname.select("surname", "ppm").collect() if s]


def romanizations(lex: Lexicon, mass: dict[str, float], attested: set[str], pinyin: dict[str, str], syllables: set[str]) -> dict[str, tuple[str, float, float]]:
    """spelling: (target, ppm as written, share of the target's mass), by rule where no table is given.

    Cantonese and Taiwanese surname spellings have the whole mass, except such
    as Koreans use far more; every other spelling that only remapping makes a
    surname keeps ``PENALTY_SHARE`` of it, where the target's own mass counts
    those Cantonese spellings that look like it.
    """
    if lex.romanization is not None:
        return {r[0]: (r[1], r[2], r[3]) for r in lex.romanization.collect()}
    part_of = {k: PENALTY_SHARE if k in fixed.KOREAN_DOMINANT else 1.0 for k in fixed.CANTONESE_SURNAMES if " " not in k}
    target_of = {k: fixed.CANTONESE_SURNAMES[k] for k in part_of} | fixed.TAIWANESE_SURNAMES
    grown = dict(mass)
    for k, target in target_of.items():
        grown[k] = max(grown.get(k, 0.0), grown.get(target, 0.0) * part_of.get(k, 1.0))
    out = {k: (target, grown.get(target, 0.0) * part_of.get(k, 1.0), part_of.get(k, 1.0)) for k, target in target_of.items()}
    spelled = {*fixed.EXCEPTIONS, *fixed.CANTONESE_SURNAME_RULES, *fixed.CANTONESE_PHONETIC_RULES, *fixed.TAIWANESE_RULES, *fixed.WADE_GILES_SYLLABLES, *fixed.GIVEN_TOKEN_RULES, *syllables}
    for s in sorted(spelled):
        target = pinyin.get(s, s)
        if len(s) > 1 and s.isascii() and s.isalpha() and s not in out and s not in attested and target != s and grown.get(target, 0.0) > 0:
            out[s] = (target, grown[target] * PENALTY_SHARE, PENALTY_SHARE)
    return out


def surname_keys(lex: Lexicon) -> DataFrame:
    """Rows of ``KEY``: every spelling that is, or leads to, a surname."""
    spark = lex.spark
    read = _read_surnames(lex)
    syllables = {r[0] for r in lex.given.select("syllable").collect()}
    tables_of_spellings = (fixed.EXCEPTIONS, fixed.CANTONESE_SURNAME_RULES, fixed.CANTONESE_PHONETIC_RULES, fixed.TAIWANESE_RULES, fixed.WADE_GILES_SYLLABLES, fixed.GIVEN_TOKEN_RULES, fixed.CANTONESE_SURNAMES, fixed.TAIWANESE_SURNAMES)
    words = {" ".join(p) for _, _, p in read} | {"".join(p) for _, _, p in read} | syllables | set(fixed.COMPOUND_VARIANTS) | set(fixed.COMPOUND_VARIANTS.values())
    for t in tables_of_spellings:
        words |= set(t)
    words |= {k.replace(" ", "") for k in words} | set(fixed.PINYIN_ALIASES.values())
    pinyin = normalised(spark, words)

    mass: dict[str, float] = {}
    spellings: set[str] = set()
    most = lambda key, ppm: mass.__setitem__(key, max(mass.get(key, 0.0), ppm))
    for han, ppm, parts in read:
        most(han, ppm)
        most("".join(parts), ppm)
        spellings |= {" ".join(parts), "".join(parts)}
    for usual, surname in fixed.PINYIN_ALIASES.items():
        if usual in mass:
            most(surname, mass[usual])
            spellings.add(surname)
    attested = {s.replace(" ", "") for s in spellings}
    roman = romanizations(lex, mass, attested, pinyin, syllables)
    aliases = set()
    for spelling, target in fixed.CANTONESE_SURNAMES.items():
        spellings.add(spelling)
        row = roman.get(spelling)
        own = row[1] if row and row[2] != 1.0 else mass.get(target, 0.0)
        if own > 0:
            most(spelling, own)
            aliases.add(spelling)
    full = {s for s, (_, _, part) in roman.items() if part == 1.0}
    spellings |= full
    aliases |= full

    base = set(mass)
    compounds = {s for s in spellings if " " in s} | set(fixed.COMPOUND_VARIANTS.values())
    for c in sorted(compounds):
        a, *b = c.split()
        if len(b) == 1 and mass.get(c, 0.0) <= 0:
            mass[c] = max(math.sqrt(mass.get(a, 1.0) * mass.get(b[0], 1.0)) * COMPOUND_PENALTY, COMPOUND_FLOOR)
    whole = {variant: target for variant, target in fixed.COMPOUND_VARIANTS.items()}
    for variant, target in whole.items():
        if target in mass:
            mass[variant] = mass[target]
    lifted = {s: t for s, (t, ppm, part) in roman.items() if part == 1.0 and ppm > mass.get(s, 0.0)}
    for s in lifted:
        mass[s] = roman[s][1]

    written = {s.replace(" ", "") for s in spellings}
    normal = {pinyin.get(s, s).replace(" ", "") for s in spellings}
    spaced = {pinyin.get(c, c) for c in compounds} | compounds
    hyphened = {c.replace(" ", "-"): c for c in compounds if len(c.split()) == 2}
    ends = {*hyphened.items(), *((c, c) for c in spaced), *whole.items()}
    target_of = {k: v for k, v in ends} | hyphened | {c: c for c in spaced} | whole
    place = {k: i for i, k in enumerate(mass)}
    rows = []
    for i, key in enumerate(sorted({*mass, *written, *normal, *target_of, *roman}, key=lambda k: (place.get(k, len(place)), k))):
        r = roman.get(key)
        rows.append((key, i, mass.get(key), key in base, key in target_of, target_of.get(key), key in written, key in normal, key in aliases, lifted.get(key), r[2] if r else None, r[1] if r else None, all(p in normal for p in target_of.get(key, "").split())))
    return spark.createDataFrame(rows, KEY)


def _unseen(lex: Lexicon) -> DataFrame:
    """Rows of no key below all shares."""
    return lex.spark.range(lex.unseen).select(F.lit("").alias("key"), F.lit(0.0).alias("ppm"), F.lit(0).alias("ordinal"))


def surname_freq(lex: Lexicon) -> DataFrame:
    """(key, ppm): the greatest share of each key; aliases, Cantonese and compound spellings have theirs from their target."""
    return lex.keys().where("ppm is not null").select("key", "ppm")


def surname_logp(rows: DataFrame) -> DataFrame:
    """(key, ppm, logp): log of a key's share of the base keys' mass, or for compounds of base and compounds; a compound as written has its target's, a lifted spelling its own target's."""
    total = rows.agg(F.sum(F.when(F.col("base"), F.col("ppm"))).alias("plain"), F.sum(F.when(F.col("base") | (F.col("whole") == F.col("key")), F.col("ppm"))).alias("all"))
    of = rows.where("ppm is not null").crossJoin(F.broadcast(total))  # one row
    own = of.select("key", "ppm", "whole", "target", F.log(F.col("ppm") / F.when(F.col("base"), F.col("plain")).otherwise(F.col("all"))).alias("own"))
    other = own.select(F.col("key").alias("other"), F.col("own").alias("theirs"))
    return own.join(F.broadcast(other), F.coalesce("target", "whole") == F.col("other"), "left").select("key", "ppm", F.coalesce("theirs", "own").alias("logp"))


def surname_rank(rows: DataFrame) -> DataFrame:
    """(key, rank): place by share, ascending, from 0 to 1; ties in the order of the lexicon."""
    w = Window.orderBy("ppm", "ordinal", "key")
    n = rows.agg(F.count("*").alias("n"))
    return rows.select("key", (F.row_number().over(w) - 1).alias("r")).crossJoin(F.broadcast(n)).select("key", (F.col("r") / F.greatest(F.col("n") - 1, F.lit(1))).alias("rank"))


def given_logp(lex: Lexicon) -> DataFrame:
    """(syllable, logp, initial_logp, final_logp, is_given, plausible, anchor): log shares of all places, and half-smoothed ones of first and of last places.

    Syllables written with v for ü also count under u.
    """
    t = lex.given.agg(F.sum("initial_count").alias("ti"), F.sum("final_count").alias("tf"), F.count("*").alias("v"))
    smooth = lambda c, total: F.log((F.col(c) + SMOOTHING) / (F.col(total) + SMOOTHING * (F.col("v") + 1)))
    counted = lex.given.crossJoin(F.broadcast(t))  # one row
    place = counted.select("syllable", smooth("initial_count", "ti").alias("initial_logp"), smooth("final_count", "tf").alias("final_logp"))
    folded = F.regexp_replace("syllable", "^([ln])v", "$1u")
    share = (
        counted.where(~F.col("syllable").isin(*tables.BYLINE_ONLY))
        .groupBy(folded.alias("syllable"))
        .agg(F.log(GIVEN_SCALE * F.max((F.col("initial_count") + F.col("final_count")) / (F.col("ti") + F.col("tf")))).alias("logp"))
        .withColumns({"is_given": F.lit(True), "plausible": plausible_syllable(F.col("syllable"))})
    )
    anchors = lex.spark.createDataFrame([(a, True) for a in fixed.ANCHORS], "syllable string, anchor boolean")
    no = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    return place.join(share, "syllable", "full").join(anchors, "syllable", "full").select("syllable", "logp", "initial_logp", "final_logp", no("is_given"), no("plausible"), no("anchor"))


def hyphen_map(lex: Lexicon) -> DataFrame:
    """(hyphenated, spaced) of compound surnames."""
    return lex.keys().where("compound and key like '%-%'").select(F.col("key").alias("hyphenated"), F.col("whole").alias("spaced"))
