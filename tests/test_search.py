"""The search in both orders gives what the plan of single names chooses, and says by how much."""

from pyspark.sql import functions as F

from onomast.functions.text import paren_hint
from onomast.lexicon.data import Lexicon
from onomast.operators.facts import name_facts, prepare, token_facts
from onomast.operators.parse import scored
from onomast.operators.search import two_order_search
from onomast.plans import golden
from onomast.plans.stage import keep


def test_agrees_with_the_choice(spark):
    lex = Lexicon.builtin(spark)
    names = [n for k in ("golden_names", "golden_compound") for n in golden.NAMES[k]]
    names += ["Wei (Peter) Zhang", "Li (Bob) Wang", "Yang Ou Ming", "Ming Ou Yang", "Zhang Wei Ming", "Wei Ming Zhang", "Li Li", "Si Ma", "Xyz Qrs", "J Wang", "A"]
    df = spark.createDataFrame([(n,) for n in names], "name string").distinct()
    p = prepare(df).withColumn("hint", F.coalesce(paren_hint(F.col("name")), F.lit(False))).withColumn("roman", F.col("tokens"))
    facts = keep(token_facts(p.select(F.explode("roman").alias("token")), lex, keep), "facts")
    named = keep(name_facts(p, facts), "named")
    words = lambda c: F.transform(c, lambda i: F.get("facts", i)["token"])
    want = {r["name"]: (r["s"], r["g"]) for r in scored(named, lex, keep=keep).where("choice is not null").select("name", words(F.col("choice.s")).alias("s"), words(F.col("choice.g")).alias("g")).collect()}
    rows = {r["name"]: r for r in two_order_search(named, lex).collect()}
    assert set(rows) == set(want) and len(want) > 100
    # Two equal tokens have one reading, whichever is the surname.
    assert {n for n in want if (rows[n]["surname"], rows[n]["given"]) != want[n]} == set()
    assert all(r["margin"] is None or r["margin"] >= 0 for r in rows.values())
    assert rows["Zhang Wei Ming"]["used_original"] and rows["Zhang Wei Ming"]["margin"] == 0
    assert rows["Ming Ou Yang"]["surname"] == ["Ou", "Yang"]


def test_no_names(spark):
    lex = Lexicon.builtin(spark)
    df = spark.createDataFrame([], "name string")
    facts = token_facts(prepare(df).select(F.explode("tokens").alias("token")), lex)
    named = name_facts(prepare(df).withColumn("hint", F.lit(False)).withColumn("roman", F.col("tokens")), facts)
    assert two_order_search(named, lex).count() == 0
