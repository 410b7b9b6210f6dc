import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from onomast.llm.sstable import Shard, Writer, key_of, read_shards, write_shards

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_round_trip(spark):
    tok = Tokenizer.from_file(PATH)
    texts = [None, "", "some text, and more", "x  y ", "word " * 5000] + ["again and again"] * 30
    docs = spark.createDataFrame([(i * 7 - 20, t, 1) for i, t in enumerate(texts)] + [(None, "lost", 2), (1, "a", 3), (1, "a", 3), (1, "b", 3)], "doc_id long, text string, start int").repartition(4)
    manifest = write_shards(docs, PATH, shard_bytes=2000)
    rows = sorted(read_shards(manifest).collect(), key=lambda r: r["start"])
    want = sorted(((r["doc_id"], r["text"] or "") for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r["doc_id"] for r in rows] == [d for d, _ in want]
    at = 0
    for r in rows:
        assert r["start"] == at
        at += r["n_tokens"]
    got = sorted((str(r["doc_id"]), np.frombuffer(r["ids"], "<u4").tolist()) for r in rows)
    assert got == sorted((str(d), tok.encode(t, add_special_tokens=False).ids + [2]) for d, t in want)
    shards = [Shard(r["path"]) for r in manifest.orderBy("part", "nth").collect()]
    assert len(shards) > 1
    assert sum(s.docs for s in shards) == len(rows)
    found = [s.get(-13) for s in shards]
    assert [f.tolist() for f in found if f is not None] == [[2]]
    assert all(s.get(-14) is None for s in shards)
    assert read_shards(write_shards(docs.where("1 = 0"), PATH)).count() == 0


def test_rows_of_one_id_have_keys_of_their_own(spark):
    rows = [(5, f"text {i % 40}", "x") for i in range(400)] + [(5, None, "y")] * 30 + [(None, "lost", "z")] * 30 + [(i, "a b", "z") for i in range(6, 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _h string").repartition(6)
    manifest = write_shards(docs, PATH, shard_docs=50)
    shards = [(Shard(r["path"]), r) for r in manifest.orderBy("part", "nth").collect()]
    keys = [k for s, _ in shards for k, _ in s.scan()]
    assert len(shards) > 9 and len(keys) == len(rows) and keys == sorted(set(keys))
    assert [(r["first_key"], r["last_key"]) for _, r in shards] == [(k[0], k[-1]) for k in ([k for k, _ in s.scan()] for s, _ in shards)]
    count = lambda d: sum(1 for s, _ in shards for _ in s.find(d))
    assert (count(5), count(None), count(20), count(4)) == (430, 30, 1, 0)
    got = sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["n_tokens"]) for r in read_shards(manifest).collect())
    tok = Tokenizer.from_file(PATH)
    assert got == sorted((d is not None, d or 0, len(tok.encode(t or "", add_special_tokens=False).ids) + 1) for d, t, _ in rows)


def test_blocks_index_and_bloom(tmp_path):
    w = Writer()
    rng = np.random.default_rng(0)
    values = {i * 3: rng.integers(0, 50_000, rng.integers(1, 300)).astype("<u2") for i in range(3000)}
    for i, v in values.items():
        w.add(key_of(i), v.tobytes())
    p = tmp_path / "a.sst"
    p.write_bytes(w.close())
    s = Shard(f"file://{p}")
    assert len(s.blocks) > 5
    assert all(s.get(i).tolist() == v.tolist() for i, v in values.items())
    assert sum(s.may_hold(key_of(i * 3 + 1)) for i in range(3000)) < 90
    assert [k for k, _ in s.scan()] == [key_of(i) for i in values]
    with pytest.raises(ValueError):
        w = Writer()
        w.add(key_of(2), b"")
        w.add(key_of(1), b"")
    damaged = bytearray(p.read_bytes())
    damaged[-60] ^= 1
    p.write_bytes(damaged)
    with pytest.raises(ValueError):
        Shard(f"file://{p}")
    assert zlib.crc32(b"") == 0
