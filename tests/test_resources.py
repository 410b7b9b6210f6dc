"""Files for all workers, and tables that are checked when they are read."""

import pytest

from onomast.lexicon import data
from onomast.lexicon.data import FOLDER_KEY, Lexicon
from onomast.plans.names import normalize_names
from onomast.sources import resources


def test_files(spark, tmp_path):
    (tmp_path / "x.json").write_bytes("﻿{\"a\": \"é\"}".encode())
    path = f"file://{tmp_path}/x.json"
    assert resources.read_json(spark, path) == {"a": "é"} and resources.read_text(spark, path).startswith("{")
    assert resources.read_bytes(spark, path)[:3] == b"\xef\xbb\xbf"
    (tmp_path / "two").mkdir()
    for n in "ab":
        (tmp_path / "two" / n).write_text(n)
    with pytest.raises(ValueError, match="one file"):
        resources.read_bytes(spark, f"file://{tmp_path}/two")
    name = resources.ship(spark, path)
    assert open(resources.local_path(name), encoding="utf-8-sig").read() == '{"a": "é"}'


def test_checked_tables(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.5), ("b", None), ("b", None), (None, 2.0)], "k string, v double").repartition(3)
    folder, schema = f"file://{tmp_path}/t", {"t": "k string, v double"}
    resources.write_tables({"t": df, "empty": df.where("1 = 0")}, folder)
    got = resources.read_tables(spark, folder, schema | {"empty": "k string, v double"})
    assert sorted(map(str, got["t"].collect())) == sorted(map(str, df.collect())) and got["empty"].count() == 0
    with pytest.raises(ValueError, match="no table other"):
        resources.read_tables(spark, folder, {"other": "k string"})
    with pytest.raises(ValueError, match="table t: schema"):
        resources.read_tables(spark, folder, {"t": "k string, v int"})
    part = next(p for p in sorted((tmp_path / "t" / "t.csv").glob("part-*")) if "a," in p.read_text())
    good = part.read_text()
    for crc in (tmp_path / "t" / "t.csv").glob(".*.crc"):
        crc.unlink()
    part.write_text(good.replace("a,1.5", "a,1.6"))
    with pytest.raises(ValueError, match="table t: hash"):
        resources.read_tables(spark, folder, schema)
    part.write_text(good + "c,9.0\n")
    with pytest.raises(ValueError, match="table t: rows"):
        resources.read_tables(spark, folder, schema)
    part.write_text(good)
    assert resources.read_tables(spark, folder, schema)["t"].count() == 4
    with pytest.raises(ValueError, match="no tables"):
        resources.write_tables({}, folder)


def test_lexicon_by_setting(spark, tmp_path, monkeypatch):
    """A session may name a folder of its own tables; a name whose surname they lack is no Chinese one there."""
    monkeypatch.setattr(data, "_BUILTIN", {})
    whole = Lexicon.builtin(spark)
    folder = f"file://{tmp_path}/lex"
    Lexicon(whole.surname.where("surname <> '翟'"), whole.given).save(folder)
    names = spark.createDataFrame([(0, 0, "翟明"), (0, 1, "李明")], "batch_id long, pos int, name string")
    assert [r["success"] for r in normalize_names(names).orderBy("pos").collect()] == [True, True]
    spark.conf.set(FOLDER_KEY, folder)
    try:
        assert Lexicon.builtin(spark).surname.count() == whole.surname.count() - 1
        assert [r["result"] for r in normalize_names(names).orderBy("pos").collect()] != ["Ming Di", "Ming Li"]
    finally:
        spark.conf.unset(FOLDER_KEY)
    assert Lexicon.builtin(spark).surname.count() == whole.surname.count()
