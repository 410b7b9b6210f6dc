"""Names with Han characters: their readings, and parses that their structure gives without a search.

Only rows that hold Han characters come here.  Readings are a broadcast join
on characters; parses are prioritised expressions on the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import CJK, HYPHENS, clean_roman, lookup, norm
from ..lexicon import fixed
from ..lexicon.data import Lexicon
from .facts import _original_forms, spaced_tables

# Ratios of surname shares.
IDENTITY_RATIO, SOURCE_ORDER_RATIO, PREFIX_RATIO, CAMEL_RATIO = 5.0, 12.0, 5.0, 5.0
PARSE = "struct<s:array<int>,g:array<int>,kind:string,form:string,k:int>"


def has_han(x: Column) -> Column:
    return x.rlike(f"[{CJK}]")


def is_han(x: Column) -> Column:
    return x.rlike(f"^[{CJK}]+$")


def is_latin(x: Column) -> Column:
    return x.rlike("[A-Za-z]") & ~has_han(x)


def unmixed(tokens: Column) -> Column:
    """Tokens of Han and Latin characters in two, the Han part first."""
    none = F.array().cast("array<string>")
    pick = lambda t, keep: F.filter(F.array(F.regexp_replace(t, keep, "")), lambda x: x != "")
    both = lambda t: has_han(t) & t.rlike("[A-Za-z]")
    return F.coalesce(F.flatten(F.transform(tokens, lambda t: F.when(both(t), F.concat(pick(t, f"[^{CJK}]"), pick(t, "[^A-Za-z]"))).otherwise(F.array(t)))), none)


def roman_parts(tokens: Column) -> Column:
    """Latin tokens without other characters than letters, hyphens and apostrophes."""
    return F.filter(F.transform(F.filter(tokens, lambda t: ~has_han(t)), clean_roman), lambda t: ~t.rlike(r"^[!-/:-@\[-`{-~]*$"))


def readings(rows: DataFrame, lex: Lexicon) -> DataFrame:
    """rows (name, tokens) with mix and py: the tokens unmixed, and (i, j, p) of the reading of character j of token i."""
    rows = rows.withColumn("mix", unmixed(F.col("tokens")))
    at = rows.select("name", F.posexplode("mix").alias("i", "t")).where(has_han(F.col("t")))
    chars = at.select("name", "i", F.posexplode(F.filter(F.split(F.translate("t", HYPHENS, ""), ""), lambda c: c != "")).alias("j", "ch"))
    read = chars.join(F.broadcast(lex.readings()), "ch", "left").select("name", F.struct("i", "j", F.coalesce("pinyin", "ch").alias("p")).alias("x"))
    return rows.join(read.groupBy("name").agg(F.array_sort(F.collect_list("x")).alias("py")), "name", "left")


def with_roman(rows: DataFrame, splits: DataFrame) -> DataFrame:
    """rows (name, mix, py) with roman: readings, Latin tokens, or both.

    splits: (s, split) of fused Latin tokens.  Where at least half of the
    readings and of the Latin syllables agree, the Latin tokens stand for both.
    """
    none = F.array().cast("array<string>")
    rows = rows.withColumns({"latin": roman_parts(F.col("mix")), "pinyin": F.coalesce(F.transform("py", lambda x: x["p"]), none)})
    at = rows.select("name", F.posexplode("latin").alias("i", "s"))
    cut = F.when(F.col("s").contains("-"), F.filter(F.split("s", "-"), lambda p: p != "")).otherwise(F.coalesce("split", F.array("s")))
    syllables = at.join(splits, "s", "left").groupBy("name").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("i", cut.alias("c")))), lambda x: x["c"])).alias("syllables"))
    rows = rows.join(syllables, "name", "left").withColumn("syllables", F.coalesce("syllables", none))
    a, b = F.array_distinct(F.transform("pinyin", norm)), F.array_distinct(F.transform("syllables", norm))
    agree = F.size(F.array_intersect(a, b)) >= 0.5 * F.greatest(F.size(a), F.size(b))
    roman = F.when(F.size("latin") == 0, F.col("pinyin")).when((F.size("pinyin") == 0) | agree, F.col("latin")).otherwise(F.concat("pinyin", "syllables"))
    return rows.withColumn("roman", roman)


def _read(i: Column) -> Column:
    """Readings of token i."""
    return F.transform(F.filter("py", lambda x: x["i"] == i), lambda x: x["p"])


def _joined(parts: Column) -> Column:
    return F.array_join(F.transform(parts, norm), "")


def _ppm(table: dict[str, float], key: Column) -> Column:
    return F.coalesce(lookup({k: repr(v) for k, v in table.items()}, key).cast("double"), F.lit(0.0))


def group_strength(han: Column, pinyin: Column, lex: Lexicon) -> Column:
    """Share of a group of Han characters as a surname; of two or more also of their readings, spaced and fused."""
    own = _ppm(lex.han_ppm(), han)
    spaced = F.array_join(F.transform(pinyin, norm), " ")
    return F.when(F.size(pinyin) > 1, F.greatest(own, _ppm(lex.group_ppm(), spaced), _ppm(lex.group_ppm(), F.array_join(pinyin, "")))).otherwise(own)


def compound_group(pinyin: Column, lex: Lexicon) -> Column:
    """Whether two or more readings are a compound surname."""
    target, _, _ = spaced_tables(lex)
    pure = {v: "1" for v in target.values()}
    fused = {v: "1" for v in _original_forms()}
    return (F.size(pinyin) > 1) & (lookup(pure, F.array_join(F.transform(pinyin, norm), " ")).isNotNull() | lookup(fused, _joined(pinyin)).isNotNull())


def curated_group(pinyin: Column) -> Column:
    known = {k: "1" for k in (*fixed.COMPOUND_VARIANTS, *fixed.COMPOUND_VARIANTS.values())}
    return (F.size(pinyin) > 1) & (lookup(known, F.array_join(F.transform(pinyin, norm), " ")).isNotNull() | lookup(known, _joined(pinyin)).isNotNull())


def aligned_pairs(rows: DataFrame, lex: Lexicon) -> DataFrame:
    """Adds ``aligned``: array of (latin_first, latin, han, pinyin, ppm) if the tokens are two or more pairs of a Latin token and its Han characters, else null."""
    t = F.col("tokens")
    first = lambda k: is_latin(F.get(t, 2 * k))
    one = lambda k: F.struct(
        first(k).alias("latin_first"),
        F.when(first(k), F.get(t, 2 * k)).otherwise(F.get(t, 2 * k + 1)).alias("latin"),
        F.when(first(k), F.get(t, 2 * k + 1)).otherwise(F.get(t, 2 * k)).alias("han"),
        F.when(first(k), _read(2 * k + 1)).otherwise(_read(2 * k)).alias("pinyin"),
    )
    even = (F.size(t) >= 4) & (F.size(t) % 2 == 0)
    rows = rows.withColumn("_pairs", F.when(even, F.transform(F.sequence(F.lit(0), (F.size(t) / 2).cast("int") - 1), one)))
    plain = lambda x: F.regexp_replace(x, "([ln])v", "$1u")
    spelled = lambda p: F.struct(p["latin"], p["han"], plain(norm(clean_roman(p["latin"]))).alias("whole"), plain(_joined(p["pinyin"])).alias("read"))
    rows = rows.withColumn("_spelled", F.transform("_pairs", spelled))
    hyphens = lambda p: F.transform(F.filter(F.split(clean_roman(p["latin"]), "-"), lambda x: x != ""), lambda x: plain(norm(x)))
    rows = rows.withColumn("_parts", F.transform("_pairs", lambda p: p["latin"].contains("-") & (hyphens(p) == F.transform(p["pinyin"], lambda x: plain(norm(x))))))
    good = F.forall(F.zip_with("_spelled", "_parts", lambda p, h: F.coalesce(is_latin(p["latin"]) & is_han(p["han"]) & ((p["whole"] == p["read"]) | h), F.lit(False))), lambda x: x)
    rows = rows.withColumn("_pairs", F.when(good, F.col("_pairs")))
    return rows.withColumn("aligned", F.transform("_pairs", lambda p: p.withField("ppm", group_strength(p["han"], p["pinyin"], lex)))).drop("_pairs", "_spelled", "_parts")


def parse(s: Column, g: Column, form) -> Column:
    form = F.lit(form) if isinstance(form, str) else form
    kind = F.when(F.size(s) > 1, "spaced").otherwise("single")
    return F.struct(s.alias("s"), g.alias("g"), kind.alias("kind"), form.alias("form"), F.lit(0).alias("k")).cast(PARSE)


def upto(a, b) -> Column:
    """a, a + 1, ... below b."""
    a, b = (F.lit(x) if isinstance(x, int) else x for x in (a, b))
    return F.when(a < b, F.sequence(a, b - 1)).otherwise(F.array().cast("array<int>"))


def bilingual_identity(pairs: Column, ratio: float = IDENTITY_RATIO) -> Column:
    """The pair whose Han characters are the commonest surname by far, if it stands at an end."""
    n = F.size(pairs)
    ppm = F.transform(pairs, lambda p: p["ppm"])
    top = F.array_max(ppm)
    at = (F.array_position(ppm, top) - 1).cast("int")
    rest = F.array_max(F.transform(pairs, lambda p, i: F.when(i != at, p["ppm"]).otherwise(0.0)))
    clear = (top > 0) & ((rest <= 0) | (top >= ratio * rest))
    return F.when(clear & (at == 0), parse(F.array(at), upto(1, n), "surname_first")).when(clear & (at == n - 1), parse(F.array(at), upto(0, n - 1), "given_first"))


def weak_pair(pairs: Column, ratio: float = SOURCE_ORDER_RATIO) -> Column:
    """Two pairs of one character each, Latin before Han: the order written counts unless the first is far commoner a surname."""
    first, last = F.get(pairs, F.lit(0)), F.get(pairs, F.lit(1))
    shape = (F.size(pairs) == 2) & F.forall(pairs, lambda p: p["latin_first"] & (F.size(p["pinyin"]) == 1))
    near = (last["ppm"] > 0) & ((last["ppm"] >= first["ppm"]) | (first["ppm"] < ratio * last["ppm"]))
    return F.when(shape & near, parse(F.array(F.lit(1)), F.array(F.lit(0)), "given_first"))


def compact_han_roman(rows: DataFrame, lex: Lexicon) -> DataFrame:
    """Adds ``compacted``: for one group of Han characters and Latin tokens of the same reading, the parse in which the group's surname, at its head or its tail, divides the Latin tokens."""
    t, latin = F.col("tokens"), F.col("latin")
    rows = rows.withColumn("_at", F.get(F.filter(F.transform(t, lambda x, i: F.when(is_han(x), i)), lambda i: i.isNotNull()), F.lit(0)))
    rows = rows.withColumns({"_han": F.get(t, F.col("_at")), "_py": _read(F.col("_at")), "_m": F.size(latin)})
    han, py, m = F.col("_han"), F.col("_py"), F.col("_m")
    rows = rows.withColumns({"_n": F.size(py), "_len": F.length(han)})
    n, size = F.col("_n"), F.col("_len")
    shape = (F.size(F.filter(t, is_han)) == 1) & (F.size(F.filter(t, is_latin)) == F.size(t) - 1) & (m >= 1) & (n >= 2) & (F.size("roman") == m) & (_joined(latin) == _joined(py))
    width = lambda two, two_py, one: F.when((_ppm(lex.han_ppm(), two) > 0) | compound_group(two_py, lex), 2).when(_ppm(lex.han_ppm(), one) > 0, 1).otherwise(0)
    rows = rows.withColumns(
        {
            "_shape": F.coalesce(shape, F.lit(False)),
            "_a": width(F.substring(han, 1, 2), F.slice(py, 1, 2), F.substring(han, 1, 1)),
            "_b": width(F.substring(han, size - 1, F.lit(2)), F.slice(py, F.greatest(n - 1, F.lit(1)), F.lit(2)), F.substring(han, size, F.lit(1))),
        }
    )
    a, b = F.col("_a"), F.col("_b")
    rows = rows.withColumns(
        {
            "_ha": F.slice(py, F.lit(1), a),
            "_hb": F.slice(py, F.greatest(n - b + 1, F.lit(1)), b),
            "_k": F.sequence(F.lit(1), F.greatest(m, F.lit(1))),
        }
    )
    rows = rows.withColumns({"_ja": _joined(F.col("_ha")), "_jb": _joined(F.col("_hb"))})
    rows = rows.withColumns(
        {
            "_front": F.get(F.filter("_k", lambda k: _joined(F.slice(latin, F.lit(1), k)) == F.col("_ja")), F.lit(0)),
            "_rear": F.get(F.filter("_k", lambda k: _joined(F.slice(latin, F.greatest(m - k + 1, F.lit(1)), k)) == F.col("_jb")), F.lit(0)),
            "_sa": group_strength(F.substring(han, F.lit(1), a), F.col("_ha"), lex),
            "_sb": group_strength(F.substring(han, size - b + 1, b), F.col("_hb"), lex),
            "_ca": curated_group(F.col("_ha")),
            "_cb": curated_group(F.col("_hb")),
        }
    )
    front, rear = F.col("_front"), F.col("_rear")
    head = F.when((a > 0) & (a < n) & (front < m), parse(upto(0, front), upto(front, m), "surname_first"))
    tail = F.when((b > 0) & (b < n) & (rear < m), parse(upto(m - rear, m), upto(0, m - rear), "given_first"))
    rows = rows.withColumns({"_head": head, "_tail": tail})
    both = F.when(F.col("_ca") & ~F.col("_cb"), F.col("_head")).when(F.col("_cb") & ~F.col("_ca"), F.col("_tail")).when(F.col("_sb") >= F.col("_sa") * IDENTITY_RATIO, F.col("_tail")).otherwise(F.col("_head"))
    out = F.when(F.col("_shape"), F.when(F.col("_head").isNotNull() & F.col("_tail").isNotNull(), both).otherwise(F.coalesce("_head", "_tail")))
    return rows.withColumn("compacted", out).drop(*[f"_{c}" for c in "at han py m n len shape a b ha hb k ja jb front rear sa sb ca cb head tail".split()])


def spaced_han(rows: DataFrame, lex: Lexicon) -> DataFrame:
    """Adds ``spaced``: of two groups of Han characters, which is the surname; a character at the border may belong to a compound surname."""
    t, facts = F.col("tokens"), F.col("facts")
    rows = rows.withColumns({"_a": _read(F.lit(0)), "_b": _read(F.lit(1)), "_n": F.size("roman")})
    a, b, n = F.col("_a"), F.col("_b"), F.col("_n")
    rows = rows.withColumn("_na", F.size(a))
    na = F.col("_na")
    shape = (F.size(t) == 2) & F.forall(t, is_han) & (n > 2) & (n == na + F.size(b))
    fact = lambda i: F.get(facts, i)
    surname = lambda py, i: F.when(F.size(py) == 1, fact(i)["is_surname"]).otherwise(compound_group(py, lex))
    rows = rows.withColumns(
        {
            "_shape": F.coalesce(shape, F.lit(False)),
            "_border": (na == 1) & (F.size(b) > 1) & compound_group(F.concat(a, F.slice(b, 1, 1)), lex),
            "_first": surname(a, F.lit(0)),
            "_last": surname(b, na),
            "_sa": group_strength(F.get(t, F.lit(0)), a, lex),
            "_sb": group_strength(F.get(t, F.lit(1)), b, lex),
            "_cb": compound_group(b, lex),
            "_ub": curated_group(b),
            "_fa": fact(F.lit(0))["ppm"],
            "_fb": fact(na)["ppm"],
        }
    )
    first, last = F.col("_first"), F.col("_last")
    wins = F.col("_cb") & (F.col("_ub") | ((F.col("_sb") > 0) & (F.col("_sb") >= F.col("_sa") * IDENTITY_RATIO)))
    prefix = F.when(F.col("_fb") <= 0, F.col("_fa") > 0).otherwise(F.col("_fa") >= PREFIX_RATIO * F.col("_fb"))
    none = last & ~first & (na > 1) & (F.size(b) == 1) & prefix
    choice = F.when(none, F.lit(None).cast(PARSE)).when(last & (~first | wins), parse(upto(na, n), upto(0, na), "given_first")).when(first, parse(upto(0, na), upto(na, n), "surname_first"))
    out = F.when(F.col("_shape"), F.when(F.col("_border"), parse(upto(0, 2), upto(2, n), "surname_first")).otherwise(choice))
    return rows.withColumn("spaced", out).drop(*[f"_{c}" for c in "a b n na shape border first last sa sb cb ub fa fb".split()])


def han2(facts: Column) -> Column:
    """Two characters: the first is the surname, or else the second."""
    is_surname = lambda i: F.get(facts, F.lit(i))["is_surname"]
    return F.when(F.size(facts) == 2, F.when(is_surname(0), parse(upto(0, 1), upto(1, 2), "surname_first")).when(is_surname(1), parse(upto(1, 2), upto(0, 1), "given_first")))


def han3(facts: Column, searched: Column) -> Column:
    """Three characters: a compound surname if the search finds one, else one and two."""
    compound = (F.size(searched["s"]) == 2) & (F.size(searched["g"]) == 1)
    return F.when(F.size(facts) == 3, F.when(F.coalesce(compound, F.lit(False)), parse(searched["s"], searched["g"], "surname_first")).otherwise(parse(upto(0, 1), upto(1, 3), "surname_first")))


def camel_pair_parse(facts: Column, lex: Lexicon) -> Column:
    """Two tokens cut from one at its capitals: the last is the surname if it alone is one, is in capitals, or is five times as common."""
    a, b = F.get(facts, F.lit(0)), F.get(facts, F.lit(1))
    pair = F.transform(facts, lambda t: t["token"])
    upper = b["token"].rlike(r"\p{Lu}") & ~b["token"].rlike(r"\p{Ll}")
    last = b["ev_surname"] & (~a["ev_surname"] | upper | ((a["ev_ppm"] == 0) & (b["ev_ppm"] > 0)) | ((a["ev_ppm"] > 0) & (b["ev_ppm"] >= CAMEL_RATIO * a["ev_ppm"])))
    fits = (F.size(facts) == 2) & ~compound_group(pair, lex) & (a["ev_surname"] | b["ev_surname"])
    return F.when(fits, F.when(last, parse(upto(1, 2), upto(0, 1), "given_first")).otherwise(parse(upto(0, 1), upto(1, 2), "surname_first")))


def structural(rows: DataFrame, lex: Lexicon, keep=None) -> DataFrame:
    """rows (tokens, mix, py, latin, roman, facts, choice, all_han) with the structural parse in place of the searched one where there is one, and script."""
    keep = keep or (lambda df, _name: df)
    rows = keep(spaced_han(compact_han_roman(aligned_pairs(rows, lex), lex), lex), "structures")
    facts, pairs = F.col("facts"), F.col("aligned")
    by_pairs = F.when(pairs.isNotNull() & (F.size("roman") == F.size(pairs)), F.coalesce(weak_pair(pairs), bilingual_identity(pairs)))
    whole = F.col("all_han") & F.size("roman").isin(2, 3)
    searched = F.when(whole, F.coalesce(han2(facts), han3(facts, F.col("choice")))).otherwise(F.col("choice").cast(PARSE))
    latin = F.exists("tokens", lambda t: t.rlike("[A-Za-z]"))
    script = F.when(~latin, "han_only").when(pairs.isNotNull(), "bilingual_aligned").otherwise("mixed_script")
    return rows.withColumns({"choice": F.coalesce(by_pairs, F.col("compacted"), F.col("spaced"), searched), "script": script}).drop("compacted", "spaced")
