"""Offline builds of the lexicon against plain Python over the same rows."""

import math
from collections import Counter

import pytest

from onomast.lexicon import build
from onomast.lexicon.data import PENALTY_SHARE, Lexicon

READ = {"明": "ming", "华": "hua", "女": "nv", "晓": "xiao", "小": "xiao"}
SURNAMES = ["王", "欧", "欧阳"]


def places(spark, names):
    df = spark.createDataFrame([(n,) for n in names], "name string")
    sur = spark.createDataFrame([(s, 1.0) for s in [*SURNAMES, "王"]], "surname string, ppm double")
    read = spark.createDataFrame(list(READ.items()), "ch string, pinyin string")
    return {r[0]: (r[1], r[2]) for r in build.corpus_places(df, sur, read).collect()}


def test_corpus_places(spark):
    names = ["王明华", "王明华", " 王小女\n", "欧阳明华", "欧阳明", "欧明华", "李明华", "王明", "王明华小", "欧阳明华小", "王明1", "", None, "王晓龘"]
    initial, final = Counter(), Counter()
    for n in names:
        n = (n or "").strip()
        if not 2 <= len(n) <= 4 or not n.isalpha():
            continue
        cut = 2 if n[:2] in SURNAMES and len(n) >= 3 else 1 if n[0] in SURNAMES else None
        if cut and len(n) - cut == 2:
            initial[READ.get(n[cut], n[cut])] += 1
            final[READ.get(n[cut + 1], n[cut + 1])] += 1
    assert places(spark, names) == {k: (initial[k], final[k]) for k in {*initial, *final}}
    assert places(spark, []) == {} and places(spark, [None, ""]) == {}


def test_bylines_and_pool(spark):
    names = ["Li Wen-Gang", "Li Wen-Gang", "Wen-Gang Li", "LI Hao-Ran", "Smith Hao-Ran", "Li Au-Yeung", "Li Xx-Gang", "Li Wengang", "Li Wen Gang", None, "Li  Wen-Gang"]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    sur = spark.createDataFrame([("li",), ("li",)], "s string")
    syl = spark.createDataFrame([(s,) for s in ("wen", "gang", "hao", "ran", "gang")], "syllable string")
    by = build.byline_places(df, sur, syl)
    assert {r[0]: (r[1], r[2]) for r in by.collect()} == {"wen": (2, 0), "gang": (0, 2), "hao": (1, 0), "ran": (0, 1)}
    corpus = spark.createDataFrame([("wen", 3, 1), ("ming", 0, 2), ("a", 0, 0)], "syllable string, initial_count long, final_count long")
    got = {r[0]: tuple(r)[1:] for r in build.position_table(corpus, by, least=2).collect()}
    # 3 first places against 3 bylines: the factor is 1.
    assert got == {"wen": (5, 1, "corpus+byline"), "ming": (0, 2, "corpus"), "a": (0, 0, "corpus"), "gang": (0, 2, "byline")}
    big = corpus.selectExpr("syllable", "initial_count * 5 AS initial_count", "final_count")
    got = {r[0]: tuple(r)[1:] for r in build.position_table(big, by, least=1).collect()}
    assert got["hao"] == (5, 0, "byline") and got["wen"] == (15 + 10, 1, "corpus+byline")
    assert {r["source"] for r in build.position_table(corpus).collect()} == {"corpus"}
    with pytest.raises(Exception, match="no byline"):
        build.position_table(corpus, by.where("1 = 0")).collect()


def test_romanization_table(spark):
    mass = spark.createDataFrame([("zhang", 60000.0), ("zhang", 50.0), ("zheng", 7000.0), ("zhou", 16000.0), ("chou", 3.0), (None, 1.0)], "key string, ppm double")
    attested = spark.createDataFrame([("chou",)], "key string")
    syl = spark.createDataFrame([("chang",), ("tsung",), ("zhang",)], "syllable string")
    table = build.romanization_table(mass, attested, syl)
    rows = table.collect()
    got = {r["spelling"]: (r["mandarin_target"], r["surname_ppm_as_written"], r["target_share"]) for r in rows}
    assert len(got) == len(rows) == table.select("spelling").distinct().count()
    assert got["cheung"] == ("zhang", 60000.0, 1.0)
    assert got["jung"] == ("zheng", round(7000 * math.exp(-4), 4), round(PENALTY_SHARE, 10))
    assert got["jeung"] == ("zhang", round(60000 * math.exp(-4), 4), round(PENALTY_SHARE, 10))
    # In use for a surname without mass; with a target of no mass by remapping alone; attested; left alone by remapping.
    assert got["leung"] == ("liang", 0.0, 1.0)
    assert "tsung" not in got and "zhang" not in got
    assert got["chou"][2] == 1.0  # in use, so its own attestation doesn't count
    build.conserved(table, mass).collect()
    with pytest.raises(Exception, match="more mass"):
        build.conserved(table.selectExpr("mandarin_target", "surname_ppm_as_written * 2 AS surname_ppm_as_written"), mass).collect()
    empty = build.romanization_table(mass.where("1 = 0"), attested, syl)
    assert {r["surname_ppm_as_written"] for r in empty.collect()} == {0.0}


def test_rebuilt_lexicon(spark):
    corpus = spark.createDataFrame([(n,) for n in ("王小明", "王小华", "李明华")], "name string")
    bylines = spark.createDataFrame([("Li Wen-Ming",), ("Wang Xiao-Ming",), ("Brown Xiao-Ming",)], "name string")
    lex = build.rebuilt(Lexicon.builtin(spark), corpus, bylines)
    got = {r["syllable"]: (r["initial_count"], r["final_count"]) for r in lex.given.collect()}
    assert got["xiao"] == (2 + 2, 0) and got["ming"] == (1, 1 + 3) and got["hua"] == (0, 2) and "wen" not in got
    assert lex.syllables().where("syllable = 'xiao'").first()["is_given"]
