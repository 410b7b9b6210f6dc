"""Golden names, batches and invariants of the whole plans."""

import pytest
from pyspark.sql import functions as F

from onomast.functions import phonetics, text
from onomast.lexicon.data import Lexicon, han_readings
from onomast.operators.facts import token_facts
from onomast.plans.names import analyze_batches, normalize_names
from onomast.plans.stage import keep
from onomast.sources.tables import names_from_lists, read_rows, write_rows
from onomast.streaming import names as streaming

GOLDEN = [
    ("Liu, Xiao-ming", "Xiao-Ming Liu"),
    ("LuWANG", "Lu Wang"),
    ("Leung Ka Fai", "Ka-Fai Leung"),
    ("Chi-Ying F. Huang", "Chi-Ying F Huang"),
    ("Wei Zhang", "Wei Zhang"),
    ("Zhang Wei", "Wei Zhang"),
    ("Ouyang Ming", "Ming Ouyang"),
]
REJECTED = {
    "": "invalid input length",
    "x" * 101: "invalid input length",
    "--- ...": "name contains only punctuation/whitespace",
    "김민수": "contains non-Chinese characters",
    "北京大学": "not a personal name",
    "G.霍弗": "not a personal name",
    "Zhang": "needs at least 2 Roman tokens",
    "Kwon Min Soo": "Korean-only surname detected",
    "Ryan Smith": "Western name detected",
    "Nguyen Van Anh": "appears to be Vietnamese name",
}


@pytest.fixture(scope="module")
def single(spark):
    names = [n for n, _ in GOLDEN] + list(REJECTED)
    df = spark.createDataFrame([(i, 0, n) for i, n in enumerate(names)], "batch_id long, pos int, name string")
    return {r["name"]: r for r in normalize_names(df).collect()}


def test_golden(single):
    assert {n: single[n]["result"] for n, _ in GOLDEN} == dict(GOLDEN)


def test_rejected(single):
    assert {n: single[n]["error"] for n in REJECTED} == REJECTED
    assert all(single[n]["result"] == "" and not single[n]["success"] for n in REJECTED)


def test_batch_votes_turn_a_name(spark):
    lists = [["Zhang Wei", "Wang Hao", "Li Ming", "Yan Li"], ["Wei Zhang", "Hao Wang", "Ming Liu"], []]
    df = names_from_lists(spark, lists)
    res, patterns, ev = analyze_batches(df)
    rows = {(r["batch_id"], r["pos"]): r for r in res.collect()}
    pat = {r["batch_id"]: r for r in patterns.collect()}
    assert pat[0]["dominant_format"] == "surname_first" and pat[1]["dominant_format"] == "given_first"
    assert rows[0, 3]["order"] == "surname_first" and rows[0, 3]["result"] == "Li Yan"
    assert len(rows) == 7 and ev.count() == 7


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x"))).first()[0]


@pytest.mark.parametrize(
    ("column", "value", "want"),
    [
        (text.clean_punct, "J. Li (Peter)", "J  Li  "),
        (text.clean_punct, "X.-Y. Li", "X-Y Li"),
        (text.norm, "Ts'ao", "cao"),
        (text.norm, "Hsieh", "xie"),
        (text.norm_light, "Lü-é", "lue"),
        (text.capitalize, "kA-fÀI", "Ka-Fai"),
        (text.smart_split, "XMLParser", "XML Parser"),
        (text.structural_split, "LU-Wang", "LU Wang"),
        (text.structural_split, "ka-fai", "ka-fai"),
        (text.compact_han, "李 · 伟", "李伟"),
        (text.comma_swap, "Li, Wei, X", "Li, Wei, X"),
        (text.ocr_fix, "Ｌｉ Мaо", "Li Мao"),
        (phonetics.valid_phonetics, "zhuang", True),
        (phonetics.valid_phonetics, "smith", False),
        (phonetics.plausible_syllable, "strk", False),
    ],
)
def test_functions(spark, column, value, want):
    assert one(spark, column, value) == want


def test_split(spark):
    words = ["xiaoming", "Ka-Fai", "mingming", "XiaoMing", "wei", "zz", "weiming", "Huang", "jianwei", "Chungming"]
    facts = token_facts(spark.createDataFrame([(w,) for w in words], "token string"), Lexicon.builtin(spark), keep)
    got = {r["token"]: r["parts"] for r in facts.collect()}
    want = [["xiao", "ming"], ["Ka", "Fai"], ["ming", "ming"], ["Xiao", "Ming"], ["wei"], None, ["wei", "ming"], ["Huang"], ["jian", "wei"], ["Chung", "ming"]]
    assert [got[w] for w in words] == want


def test_han_readings(spark):
    got = {r["ch"]: r["pinyin"] for r in han_readings(spark).where(F.col("ch").isin("李", "曾", "吕", "欧")).collect()}
    assert got == {"李": "li", "曾": "ceng", "吕": "lv", "欧": "ou"}


def test_row_files(spark, tmp_path):
    df = spark.createDataFrame([("a", None), ("b", "x")], "k string, v string")
    for ending in ("parquet", "jsonl", "csv"):
        write_rows(df, f"{tmp_path}/t.{ending}")
        back = read_rows(spark, f"{tmp_path}/t.{ending}")
        assert sorted(map(str, back.select("k", "v").collect())) == sorted(map(str, df.collect()))


def test_stream_of_names(spark, tmp_path):
    df = spark.createDataFrame([(1, 0, "Zhang Wei"), (1, 1, "北京大学")], "batch_id long, pos int, name string")
    df.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    q = streaming.gate_stream(stream).writeStream.format("memory").queryName("gated").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/cp").start()
    q.awaitTermination(120)
    assert {r["name"]: r["gate"] for r in spark.table("gated").collect()} == {"Zhang Wei": None, "北京大学": "not a personal name"}
