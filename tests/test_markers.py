from pyspark.sql import functions as F

from onomast.lexicon import fixed
from onomast.lexicon.data import Lexicon


def test_all_japanese_surnames_are_markers(spark):
    assert len(fixed.JAPANESE) == 213
    names = ["fujimoto", "fujimori", "honda", "kawasaki", "kikuchi", "matsui", "nishida", "takeda", "yoshimura", "sato"]
    rows = Lexicon.builtin(spark).markers().where(F.col("key").isin(*names)).collect()
    assert {r["key"]: r["tier"] for r in rows} == dict.fromkeys(names, 3)
