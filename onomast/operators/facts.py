"""Facts on distinct tokens, by joins with the lexicon; names get them back as arrays.

A token is normalised, looked up and cut into syllables once, however often it
is written.  Lexicon tables have a few thousand rows and are broadcast; the
tokens of all names are not.  Every string that is looked at for a token (the
token, its lower case and pinyin, its hyphen parts) is a row of ``strings``;
``token_facts`` gathers what a token needs from them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.phonetics import valid_phonetics
from ..functions.text import HYPHENS, among, capitalize, comma_swap, is_camel, lookup, malformed_camel, norm, norm_light, preprocess, strip_marks, tokenize
from ..lexicon import fixed
from ..lexicon.data import DEFAULT_LOGP, Lexicon

# Bounds of lookups and cuts.
REMAPPED_LOG_SHARE = -4.0
DOMINANT = 10_000.0
RARE_LOGP = -12.0
UNBALANCED = 4
STRENGTH = ((10_000, 1.5), (1_000, 1.0), (100, 0.6))
CAMEL = r"[A-Z]+(?=[A-Z][a-z])|[A-Z][a-z]+|[A-Z]+(?=$)"


def prepare(names: DataFrame) -> DataFrame:
    """names with cleaned and tokens."""
    return names.withColumn("cleaned", preprocess(F.col("name"))).withColumn("tokens", tokenize(comma_swap(F.col("cleaned"))))


def _flag(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(False))


def hyphen_parts(token: Column) -> Column:
    return F.filter(F.split(token, "-"), lambda p: F.trim(p) != "")


def parts_of(strings: DataFrame, lex: Lexicon) -> tuple[DataFrame, DataFrame]:
    """(parts, cuts): facts of every head and tail of the strings (s, light), and the cuts (s, i, n, head, tail)."""
    g = F.broadcast(lex.syllables())
    cuts = strings.where(F.length("light") >= 2).select("s", F.col("light").alias("w"), F.explode(F.sequence(F.lit(1), F.length("light") - 1)).alias("i"))
    cuts = cuts.select("s", "i", F.length("w").alias("n"), F.substring("w", F.lit(1), F.col("i")).alias("head"), F.substring("w", F.col("i") + 1, F.length("w")).alias("tail"))
    p = cuts.select(F.col("head").alias("p")).union(cuts.select(F.col("tail").alias("p"))).distinct().withColumn("pn", norm(F.col("p")))
    by_norm = g.select(F.col("syllable").alias("pn"), F.col("logp").alias("nl"), F.col("is_given").alias("ng"), F.col("plausible").alias("np"), F.col("anchor").alias("na"))
    by_light = g.select(F.col("syllable").alias("p"), F.col("logp").alias("ll"), F.col("plausible").alias("lp"))
    p = p.join(by_norm, "pn", "left").join(by_light, "p", "left")
    return p.select("p", F.col("nl"), _flag("ng").alias("ng"), _flag("np").alias("np"), _flag("na").alias("na"), _flag("lp").alias("lp"), F.greatest("nl", "ll").alias("known")), cuts


def split_table(strings: DataFrame, lex: Lexicon) -> DataFrame:
    """strings (s, light) to (s, cut, gold, all_given, best_logp, best_known).

    cut: the first cut from the left into two plausible syllables, one of them
    given and not both rare, of which one is an anchor or the whole has four
    letters; gold: the first into two anchors; best: the two syllables of the
    greatest sum of log shares.
    """
    parts, cuts = parts_of(strings, lex)
    side = lambda k: parts.select(F.col("p").alias(k), *[F.col(c).alias(f"{k[0]}_{c}") for c in parts.columns if c != "p"])
    c = cuts.join(side("head"), "head").join(side("tail"), "tail")
    fair = ~((F.col("i") == 1) & (F.col("n") - 1 > UNBALANCED)) & ~((F.col("n") - F.col("i") == 1) & (F.col("i") > UNBALANCED))
    pair = (F.col("h_np") & F.col("t_np")) | (F.col("h_lp") & F.col("t_lp"))
    rare = lambda k: F.coalesce(F.col(f"{k}_nl"), F.lit(DEFAULT_LOGP)) < RARE_LOGP
    chinese = (F.col("h_ng") | F.col("t_ng")) & ~(rare("h") & rare("t"))
    fits = fair & pair & chinese
    total = F.coalesce("h_known", F.lit(DEFAULT_LOGP)) + F.coalesce("t_known", F.lit(DEFAULT_LOGP))
    both = F.col("h_known").isNotNull() & F.col("t_known").isNotNull()
    cut = F.struct("i", (F.col("h_ng") & F.col("t_ng")).alias("given"))
    g = c.groupBy("s").agg(
        F.min(F.when(fits & (F.col("h_na") | F.col("t_na") | (F.col("n") >= 4)), cut)).alias("cut"),
        F.min(F.when(fits & F.col("h_na") & F.col("t_na"), F.col("i"))).alias("gold"),
        F.max(F.when(F.col("h_lp") & F.col("t_lp"), F.struct(total.alias("logp"), (-F.col("i")).alias("at"), both.alias("both")))).alias("best"),
        F.max(F.when(F.col("i") * 2 == F.col("n"), F.struct(pair.alias("ok"), (F.col("h_np") | F.col("h_lp")).alias("one"), F.col("h_ng").alias("given"), (F.col("head") == F.col("tail")).alias("same")))).alias("half"),
        F.map_from_entries(F.collect_list(F.struct("i", F.struct(pair.alias("pair"), (F.col("h_ng") & F.col("t_ng")).alias("given"), total.alias("logp"), both.alias("both"))))).alias("at"),
    )
    return g


def strings(s: DataFrame, lex: Lexicon) -> DataFrame:
    """Facts of distinct strings (s)."""
    k, g = lex.keys(), F.broadcast(lex.syllables())
    t = s.select("s").distinct().withColumns({"low": F.lower("s"), "light": norm_light(F.col("s")), "norm": norm(F.col("s"))})
    by = lambda name, *cols: F.broadcast(k.select(F.col("key").alias(name), *cols))
    light = by("light", F.col("ppm").alias("l_ppm"), F.col("logp").alias("l_logp"), F.col("rank").alias("l_rank"), F.col("as_written").alias("l_written"), F.col("normal").alias("l_normal"), "share", "written_ppm")
    norm_ = by("norm", F.col("ppm").alias("n_ppm"), F.col("logp").alias("n_logp"), F.col("rank").alias("n_rank"), F.col("as_written").alias("n_written"), F.col("normal").alias("n_normal"))
    low = by("low", F.col("alias").alias("low_alias"), F.col("as_written").alias("low_written"), F.col("whole").alias("low_whole"), F.col("parts_normal").alias("low_parts"))
    t = t.join(light, "light", "left").join(norm_, "norm", "left").join(low, "low", "left")
    gl = g.select(F.col("syllable").alias("light"), F.col("logp").alias("gl"), F.col("is_given").alias("light_given"), "initial_logp", "final_logp")
    gn = g.select(F.col("syllable").alias("norm"), F.col("logp").alias("gn"), F.col("is_given").alias("norm_given"), F.col("anchor").alias("norm_anchor"))
    t = t.join(gl, "light", "left").join(gn, "norm", "left").join(g.select(F.col("syllable").alias("low"), F.col("is_given").alias("low_given")), "low", "left")
    t = t.join(F.broadcast(lex.markers().withColumnRenamed("key", "low")), "low", "left").join(split_table(t.select("s", "light"), lex), "s", "left")

    # Which key a lookup as surname takes: the spelling as written, or its pinyin.
    initial = (
        (F.col("light") != F.col("norm")) & F.substring("light", 1, 1).isin("k", "p", "t") & F.substring("norm", 1, 1).isin("g", "b", "d")
        & (F.coalesce("l_ppm", F.lit(0.0)) > 0) & (F.coalesce("n_ppm", F.lit(0.0)) == 0)
    )
    t = t.withColumn("wg_initial", initial)
    own = (F.col("share").isNotNull() & ((F.col("share") == 1.0) | F.col("l_ppm").isNotNull())) | F.col("wg_initial")
    t = t.withColumn("own", F.coalesce(own, F.lit(False)))
    pick = lambda a, b: F.when(F.col("own"), F.col(a)).otherwise(F.col(b))
    named = _flag("low_alias") | (_flag("low_written") & (F.col("s") == F.col("low")))
    t = t.withColumns(
        {
            "ppm": F.coalesce(pick("l_ppm", "n_ppm"), F.lit(0.0)),
            "raw_logp": F.coalesce(pick("l_logp", "n_logp"), F.lit(DEFAULT_LOGP)),
            "rank": F.coalesce(pick("l_rank", "n_rank"), F.lit(0.0)),
            "is_surname": named | F.coalesce(pick("l_written", "n_written"), F.lit(False)) | F.coalesce(pick("l_normal", "n_normal"), F.lit(False)),
            "in_normal": _flag("n_normal"),
        }
    )
    written = F.col("share").isNotNull() | (F.coalesce("l_ppm", F.lit(0.0)) > 0)
    part = F.when(_flag("l_written"), 0.0).when(F.col("share").isNotNull(), F.log("share")).otherwise(REMAPPED_LOG_SHARE)
    evidence = F.when(written, F.greatest(F.coalesce("l_ppm", F.lit(0.0)), F.coalesce("written_ppm", F.lit(0.0)))).otherwise(F.coalesce("n_ppm", F.lit(0.0)))
    t = t.withColumns(
        {
            "slogp": F.when((F.col("raw_logp") > DEFAULT_LOGP) & (part < 0), F.greatest(F.col("raw_logp") + part, F.lit(DEFAULT_LOGP))).otherwise(F.col("raw_logp")),
            "ev_key": F.when(written, F.col("light")).otherwise(F.col("norm")),
            "ev_ppm": evidence,
            "ev_surname": named | F.when(written, _flag("l_written") | _flag("l_normal")).otherwise(_flag("n_written") | _flag("n_normal")),
        }
    )
    return _given(t)


def _given(t: DataFrame) -> DataFrame:
    """Adds what a string is worth as a given name: its log share, its syllables, and its strength as evidence."""
    bare = F.translate(strip_marks(F.col("s")), HYPHENS, "")
    n = F.length(bare)
    cut = lambda at: F.array(F.substring(bare, F.lit(1), at), F.substring(bare, at + 1, n))
    hyphens = F.length("s") - F.length(F.replace("s", F.lit("-"), F.lit("")))
    stays = (F.length("s") < 3) | F.col("in_normal") | _flag("norm_anchor") | _flag("norm_given") | _flag("low_given")
    pieces = F.split("s", "-")
    bar = F.length(F.translate(strip_marks(F.get(pieces, F.lit(0))), HYPHENS, ""))
    camel = F.regexp_extract_all(bare, F.lit(CAMEL), F.lit(0))
    camel_at = F.when((F.size(camel) == 2), F.length(F.get(camel, F.lit(0))))
    at = lambda i: F.try_element_at(F.col("at"), i)
    no = F.lit(None).cast("array<string>")
    split = (
        F.when(stays, no)
        .when(hyphens == 1, F.when(F.coalesce(at(bar)["pair"], F.lit(False)), pieces))
        .when((n >= 4) & F.col("half.same") & F.col("half.one"), cut((n / 2).cast("int")))
        .when(F.coalesce(at(camel_at)["pair"], F.lit(False)) & (F.array_join(camel, "") == bare), camel)
        .when(F.col("cut").isNotNull(), cut(F.col("cut.i")))
    )
    given_halves = (
        F.when(hyphens == 1, at(bar)["given"]).when((n >= 4) & F.col("half.same") & F.col("half.one"), F.col("half.given")).when(F.coalesce(at(camel_at)["pair"], F.lit(False)), at(camel_at)["given"]).otherwise(F.col("cut.given"))
    )
    fused = F.array_contains(among(_original_forms()), F.col("low")) | F.array_contains(among(_original_forms()), F.col("norm"))
    gold = F.when((F.length("s") >= 3) & F.col("in_normal") & F.col("low_whole").isNull() & ~fused, cut(F.col("gold")))
    known = F.greatest("gl", "gn")
    dec = F.when(hyphens == 1, F.struct(at(bar)["logp"].alias("logp"), at(bar)["both"].alias("both"))).when(hyphens == 0, F.struct(F.col("best.logp").alias("logp"), F.col("best.both").alias("both")))
    dec = F.when(dec["logp"] > DEFAULT_LOGP, dec)
    t = t.withColumns({"split": split, "split_given": given_halves, "gold_split": gold, "known": known, "dec": dec, "phonetic": valid_phonetics(F.col("s"))})
    rung = F.when(F.col("ev_ppm") >= STRENGTH[0][0], STRENGTH[0][1]).when(F.col("ev_ppm") >= STRENGTH[1][0], STRENGTH[1][1]).when(F.col("ev_ppm") >= STRENGTH[2][0], STRENGTH[2][1]).when(F.col("ev_ppm") > 0, 0.3).otherwise(0.2)
    t = t.withColumns(
        {
            "strength": F.when(F.col("ev_surname"), rung).when(F.col("low_whole").isNotNull(), F.when(F.col("low_parts"), 1.0).otherwise(0.0)).when(F.col("split").isNotNull() & F.col("split_given"), 0.3).otherwise(0.0),
            "glogp": F.coalesce("known", "dec.logp", F.lit(DEFAULT_LOGP)),
            "pair_known": F.col("known").isNull() & F.coalesce("dec.both", F.lit(False)),
            "is_given": _flag("norm_given"),
            "is_given_written": _flag("norm_given") | _flag("light_given"),
            "valid": _flag("norm_given") | _flag("low_given") | F.col("split").isNotNull() | F.col("in_normal") | F.col("phonetic"),
        }
    )
    return t.select(
        "s", "low", "light", "norm", "ppm", "slogp", "rank", "is_surname", "in_normal", "wg_initial", "ev_key", "ev_ppm", "ev_surname",
        "initial_logp", "final_logp", "is_given", "is_given_written", "glogp", "pair_known", "phonetic", "split", "gold_split", "valid", "tier", "strength",
        F.col("low_whole").alias("whole"), (_flag("norm_given") | _flag("low_given")).alias("given_strict"), _flag("low_written").alias("written"),
    )


def _original_forms() -> list[str]:
    """Compound surnames in pinyin, spaced and fused, that have a spelling of their own."""
    spaced = set(fixed.COMPOUND_VARIANTS.values())
    fused = {v.replace(" ", "") for k, v in fixed.COMPOUND_VARIANTS.items() if " " not in k}
    return sorted(spaced | fused)


def keys_of(token: Column) -> Column:
    """What a token is looked up by as evidence: itself in lower case, its pinyin, and both of its hyphen parts."""
    part = F.flatten(F.transform(F.split(token, "-"), lambda p: F.array(F.lower(p), norm(p))))
    return F.array_distinct(F.concat(F.array(F.lower(token), norm(token)), F.when(token.contains("-"), part).otherwise(F.array().cast("array<string>"))))


def camel_cut(token: Column) -> Column:
    """A token cut where a capital follows another letter, if that gives two parts; else in its middle."""
    parts = F.split(F.regexp_replace(token, r"(?<=[^\p{Lu}])(?=\p{Lu})", " "), " ")
    half = F.floor(F.length(token) / 2).cast("int")
    return F.when(F.size(parts) == 2, parts).otherwise(F.array(F.substring(token, F.lit(1), half), F.substring(token, half + 1, F.length(token))))


def proper_camel(parts: Column) -> Column:
    """The second part starts with a capital, and neither changes its case more than once."""
    changes = lambda p: F.length(F.regexp_replace(F.regexp_replace(p, r"\p{Lu}+", "U"), r"[^U]+", "l")) - 1
    calm = lambda p: (F.length(p) <= 2) | (changes(p) <= 1)
    a, b = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    return b.rlike(r"^\p{Lu}") & calm(a) & calm(b)


def compact_cut(token: Column, target: Column) -> Column:
    """A fused compound surname cut in proportion to the two syllables of its pinyin."""
    a, b = F.length(F.get(F.split(target, " "), F.lit(0))), F.length(F.get(F.split(target, " "), F.lit(1)))
    n = F.length(token)
    at = F.when((a == b) & (n % 2 == 1), F.floor(n / 2) + 1).otherwise(F.bround(n * (a / (a + b))))
    at = F.greatest(F.lit(1), F.least(n - 1, at.cast("int")))
    return F.array(F.substring(token, F.lit(1), at), F.substring(token, at + 1, n))


def compound_format(token: Column) -> Column:
    """How a compound surname in one token is written: hyphenated, camelCase or compact."""
    return F.when(token.contains(" "), "spaced").when(token.contains("-"), "hyphenated").when(is_camel(token) | malformed_camel(token), "camelCase").otherwise("compact")


def compound_split(token: Column, form: Column, target: Column) -> Column:
    """Its two parts as they are written."""
    camel = F.when(proper_camel(camel_cut(token)), camel_cut(token)).otherwise(compact_cut(F.lower(token), target))
    return F.when(form == "hyphenated", F.transform(F.split(target, " "), capitalize)).when(form == "camelCase", camel).otherwise(compact_cut(token, target))


def compound_shown(token: Column, form: Column, parts: Column) -> Column:
    """How the surname is rendered: as it was written, in regular case."""
    joined = lambda mark: F.array_join(F.transform(parts, capitalize), mark)
    return F.when(form == "hyphenated", joined("-")).when(form == "camelCase", F.when(is_camel(token), token).otherwise(joined(""))).otherwise(capitalize(token))


def spaced_tables(lex: Lexicon) -> tuple[dict[str, str], dict[str, str], dict[str, str]]:
    """(target, log share, rank) of compound surnames in two words, a hundred or so."""
    c = {k: r for k, r in lex.compounds().items() if k.count(" ") == 1}
    return {k: r["whole"] for k, r in c.items()}, {k: repr(r["logp"]) for k, r in c.items() if r["logp"] is not None}, {k: repr(r["rank"]) for k, r in c.items() if r["rank"] is not None}


def token_facts(tokens: DataFrame, lex: Lexicon, keep=None) -> DataFrame:
    """tokens (token) with all that parsing needs of a token; ``keep`` cuts the plan where a table is read more than once.

    parts: its given-name syllables, null if it can't be a given name; parts_plain: without the cuts of surname-like tokens.
    """
    keep = keep or (lambda df, _name: df)
    t = tokens.select("token").distinct().withColumns({"keys": keys_of(F.col("token")), "hp": F.when(F.col("token").contains("-"), hyphen_parts(F.col("token"))).otherwise(F.array().cast("array<string>"))})
    t = keep(t, "tokens")
    every = t.select(F.explode(F.concat(F.array("token"), "keys", "hp")).alias("s"))
    s = keep(strings(every, lex), "strings")
    evidence = (
        t.select("token", F.explode("keys").alias("s")).join(s.select("s", "strength", "tier", "written"), "s").groupBy("token")
        .agg(F.collect_list(F.struct("s", "strength")).alias("evidence"), F.min("tier").alias("least_tier"), F.bool_or("written").alias("chinese_key"))
    )
    parts = (
        t.select("token", F.explode("hp").alias("s")).join(s.select("s", "valid", "given_strict"), "s").groupBy("token")
        .agg(F.bool_and("valid").alias("parts_valid"), F.bool_and("given_strict").alias("parts_given"))
    )
    f = t.join(s.withColumnRenamed("s", "token"), "token").join(evidence, "token", "left").join(parts, "token", "left")
    target, logps, ranks = spaced_tables(lex)
    form = F.when(F.col("whole").isNotNull(), compound_format(F.col("token")))
    f = f.withColumn("comp_format", form).withColumn("comp_parts", F.when(F.col("whole").isNotNull(), compound_split(F.col("token"), F.col("comp_format"), F.col("whole"))))
    key = F.array_join(F.transform("comp_parts", norm), " ")
    number = lambda table, k: lookup(table, k).cast("double")
    comp = F.struct(
        F.col("comp_format").alias("form"),
        F.col("whole").alias("target"),
        F.col("comp_parts").alias("parts"),
        compound_shown(F.col("token"), F.col("comp_format"), F.col("comp_parts")).alias("shown"),
        F.coalesce(number(logps, key), number(logps, F.col("whole")), F.lit(DEFAULT_LOGP)).alias("logp"),
        F.coalesce(number(ranks, key), F.lit(0.0)).alias("rank"),
    )
    fine = F.col("valid") | (F.col("token").contains("-") & F.coalesce(F.col("parts_valid"), F.lit(True)))
    whole = F.array("token")
    plain = F.when(F.col("is_given") | F.col("phonetic"), whole).when(F.col("split").isNotNull(), F.col("split"))
    first, last = lex.place_defaults()
    low = F.col("low")
    has = lambda words, x: F.array_contains(among(words), x)
    ab = F.split(low, "-")
    sign = lambda x: has(sorted({*fixed.KOREAN_GIVEN, *fixed.KOREAN_SPECIFIC}), x)
    a, b = F.get(ab, F.lit(0)), F.get(ab, F.lit(1))
    hyphen = F.when((F.size(ab) == 2) & ((has(fixed.KOREAN_GIVEN, a) & has(fixed.KOREAN_GIVEN, b)) | ((sign(a) | sign(b)) & ~F.coalesce("parts_given", F.lit(False)))), 3.0).otherwise(0.0)
    return f.select(
        "token", "low", "light", "norm", "ppm", "slogp", "rank", "is_surname", "in_normal", "wg_initial", "ev_key", "ev_ppm", "ev_surname",
        F.coalesce("initial_logp", F.lit(first)).alias("initial_logp"),
        F.coalesce("final_logp", F.lit(last)).alias("final_logp"),
        "is_given", "is_given_written", "glogp", "pair_known",
        F.when(fine, F.coalesce(plain, F.col("gold_split"), whole)).alias("parts"),
        F.when(fine, F.coalesce(plain, whole)).alias("parts_plain"),
        F.col("least_tier").alias("tier"), "evidence", "written", F.coalesce("chinese_key", F.lit(False)).alias("chinese_key"),
        F.when(F.col("whole").isNotNull(), comp).alias("comp"),
        capitalize(F.col("token")).alias("shown"),
        F.struct(
            F.when(has(fixed.KOREAN_ONLY, low), "korean_only").when(has(fixed.VIETNAMESE_ONLY, low), "vietnamese_only").when(has(fixed.KOREAN_OVERLAP, low), "korean_overlapping")
            .when(has(fixed.VIETNAMESE_OVERLAP, low), "vietnamese_overlapping").when(F.col("written"), "chinese_only").otherwise("none").alias("surname"),
            (F.col("written") & (has(fixed.KOREAN_OVERLAP, low) | has(fixed.VIETNAMESE_OVERLAP, low))).alias("shared"),
            has(fixed.KOREAN_OVERLAP, low).alias("korean_overlap"),
            hyphen.alias("hyphen"),
            has(fixed.KOREAN_SPECIFIC, low).alias("specific"),
            (has(fixed.KOREAN_AMBIGUOUS, low) & ~has(fixed.KOREAN_SPECIFIC, low)).alias("ambiguous"),
            has(fixed.VIETNAMESE_GIVEN, low).alias("vietnamese"),
            low.isin("thi", "thị").alias("thi"),
            has(fixed.KOREAN_GIVEN, low).alias("korean_given"),
            F.filter(ab, lambda p: p != "").alias("sub"),
        ).alias("mark"),
    )


def name_facts(names: DataFrame, facts: DataFrame) -> DataFrame:
    """names (name, roman, ...) with ``facts``: an array of structs, one per token of ``roman`` and in order."""
    at = names.select("name", F.posexplode("roman").alias("i", "token"))
    rows = at.join(facts, "token").groupBy("name").agg(F.array_sort(F.collect_list(F.struct("i", *facts.columns)), lambda a, b: a["i"] - b["i"]).alias("facts"))
    return names.join(rows, "name", "left")
