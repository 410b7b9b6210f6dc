import re
import time

from pyspark.sql import functions as F

from onomast.llm import decontaminate as module
from onomast.llm.common import ascii_lower
from onomast.llm.decontaminate import decontaminate, proximity_matches

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute(text, items):
    w, hit, who = words(text), set(), set()
    for i, t in items:
        x = words(t)
        n = min(10, len(x))
        for k in range(len(x) - n + 1 if n else 0):
            for a in range(len(w) - n + 1):
                if w[a : a + n] == x[k : k + n]:
                    hit.update(range(a, a + n))
                    who.add(str(i))
    return len(w), len(hit), sorted(who)


PASSAGE = "alpha beta Gamma, delta epsilon zeta eta theta iota kappa lambda mu"
ITEMS = [(1, PASSAGE), (2, "short ONE"), (3, None), (4, ""), (5, "..."), (10, PASSAGE), (6, "été ÉTÉ 中文 a1 b2 c3 d4 e5 f6 g7 h8"), (7, "never seen words at all in any of these documents here now")]
DOCS = [
    None,
    "",
    "nothing to see",
    "x " + PASSAGE + " y",
    "alpha beta gamma delta epsilon zeta eta theta iota KAPPA!",
    "alpha beta gamma delta epsilon zeta eta theta iota",
    "a short one, and short-one again: shortone",
    "été ÉTÉ 中文 a1 b2 c3 d4 e5 f6 g7 h8",
    "éTÉ ÉTÉ 中文 a1 b2 c3 d4 e5 f6 g7 h8",
    (PASSAGE + " ") * 40,
    "the word alpha alpha alpha " * 2000 + PASSAGE,
]


def test_matches_brute_force(spark):
    rows = [(i, t, "clash", 0) for i, t in enumerate(DOCS)] + [(3, "same id, other text", "clash", 0), (None, PASSAGE, "clash", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, hits string, n_words int")
    items = spark.createDataFrame([(i, t, 1) for i, t in ITEMS], "item_id long, text string, freq int")
    got = decontaminate(docs, items).collect()
    assert len(got) == len(rows)
    want = sorted((str(r[0]), *map(str, brute(r[1], ITEMS))) for r in rows)
    assert sorted((str(r["doc_id"]), str(r["n_words"]), str(r["n_hit"]), str(r["hit_items"])) for r in got) == want
    assert all(r["contaminated"] == (r["n_hit"] > 0) and r["n_items"] == len(r["hit_items"]) for r in got)


def test_empty_sides(spark):
    docs = spark.createDataFrame([(1, PASSAGE)], "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert decontaminate(docs.where("1 = 0"), items).count() == 0
    r = decontaminate(docs, items.where("1 = 0")).first()
    assert (r["n_words"], r["n_hit"], r["hit_items"]) == (12, 0, [])


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "rarea x x rareb"), (2, "rarea x x x rareb"), (3, "rarea " + "x " * 20 + "rareb"), (4, "x x x")], "doc_id long, text string")
    items = spark.createDataFrame([(9, "rarea x x rareb")], "item_id long, text string")
    got = {r["doc_id"]: r["gap"] for r in proximity_matches(docs, items, slop=2).collect()}
    assert got == {1: 0, 2: 1}


def test_long_text_of_hits(spark):
    n = 100_000
    docs = spark.createDataFrame([(1, (PASSAGE + " ") * n), (2, "clean")], "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    start = time.time()
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"]) for r in decontaminate(docs, items).select("doc_id", "n_words", "n_hit", "n_items").collect()}
    assert got == {1: (12 * n, 12 * n, 2), 2: (1, 0, 0)}
    assert time.time() - start < 60


def test_rows_without_an_id_stay_apart(spark):
    """Hundreds of unlike texts without an id, or under one, each with the same passage: no row meets the others' candidates."""
    passage = " ".join(f"p{i}" for i in range(40))
    rows = [(None if i % 2 else 7, f"x{i} y{i} {passage} z{i}", i) for i in range(400)] + [(None, f"x1 y1 {passage} z1", 1)] * 50 + [(None, None, 0), (7, "", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, extra int").repartition(8)
    items = spark.createDataFrame([(1, passage)], "item_id long, text string")
    got = decontaminate(docs, items).select("doc_id", "extra", "text", "n_words", "n_hit", "contaminated").collect()
    assert len(got) == len(rows)
    assert all((r["n_words"], r["n_hit"], r["contaminated"]) == ((43, 40, True) if r["text"] else (0, 0, False)) for r in got)


def test_words_are_cut_as_the_pattern_says(spark):
    texts = [None, "", " ", "...", "a", " a", "a ", "A--b\x00c", "\x00", "été ÉTÉ", "中文,中", "\u00a0x\u2003y\u0085", "\U0001f600 \U0001f600a", "\n\ta1_b2\r\n", "İI ſs K", "x" * 5000, " ," * 5000 + "end"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r[0]: r[1] for r in docs.select("doc_id", module.words(F.col("text"))).collect()}
    assert [got[i] for i in range(len(texts))] == [words(t) for t in texts]


def test_words_cost_far_less_than_matches(spark):
    """Each text is cut three times, so this is most of the work; extracting each word as a match took as long as that."""
    docs = spark.range(0, 4000, 1, 4).select(F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(1000)), lambda x: F.concat(F.lit("w"), (x * 7919 + F.col("id")) % 9973))).alias("text"))
    docs = docs.persist()
    matches = F.regexp_extract_all(ascii_lower(F.col("text")), F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0))

    def seconds(made):
        start = time.time()
        assert docs.select(F.sum(F.size(made))).first()[0] == 4_000_000
        return time.time() - start

    seconds(matches), seconds(module.words(F.col("text")))
    assert min(seconds(module.words(F.col("text"))) for _ in range(2)) < 0.6 * min(seconds(matches) for _ in range(2))
    docs.unpersist()
