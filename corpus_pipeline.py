"""The corpus pipeline: five operators of onomast.llm, one after the other.

Each stage takes (spark, docs, sf_dir) and works on all rows that its
predecessor kept.  run() writes each stage's rows as Parquet in the shared
folder and reads them back for the next.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from onomast.llm.common import materialize
from onomast.llm.decontaminate import decontaminate
from onomast.llm.jaccard import add_component, near_roots
from onomast.llm.packing import encode_pieces, pack
from onomast.llm.quality import score_quality, train_quality
from onomast.llm.secrets import redact, scan_secrets

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that score 0.5 or more; the model is learned as in op1, from labels off the held-out third.

    A null text counts as empty and is scored like one; a null id plays no part
    but in the labels; whole texts are read; repeated rows are judged alike;
    an empty table gives an empty one; other columns than ``COLUMNS`` go.
    """
    model = train_quality(docs, _table(spark, sf_dir, "labels"))
    return score_quality(docs, model, COLUMNS).where("quality_score >= 0.5").select(*COLUMNS)


def simhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near-duplicates: that of the least doc_id, a null one last, and of these the least by the hash of the row.

    Near-duplicates have a Jaccard similarity of 0.8 or more between their
    five-word shingles, or are joined by a chain of such texts.  op7's
    fingerprints, of five words and of distinct shingles, are joined as tries
    with an error budget of 24 bits among texts that share a rare shingle; an
    exact comparison follows.  Ids play no part in the groups: of unlike texts under one id, or
    without any, each stays.  Null and empty texts are copies of each other;
    an empty table gives an empty one.
    """
    rows, roots = near_roots(docs.select(*COLUMNS), size=5, least=0.8)
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", F.xxhash64(*COLUMNS[1:]).alias("hash"), "row")
    # Texts aren't sent: they meet the numbers of those that go, a table of their own, so that Spark sees its size.
    groups = add_component(rows.select("row", "set", order.alias("order")), roots)
    kept = groups.groupBy("component").agg(F.min("order").alias("least"), F.count("*").alias("k")).where("k > 1")
    kept = materialize(kept.select("component", F.col("least.row").alias("kept")), "near-kept")
    lost = materialize(groups.join(kept, "component").where("row <> kept").select("row"), "near-lost")
    return rows.join(lost, "row", "left_anti").select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of the benchmark.

    Each row is judged by its own text, also where ids are null or repeat; null
    and empty texts hold none and stay; whole texts are searched; empty tables
    on either side drop nothing; other columns than ``COLUMNS`` go.
    """
    out = decontaminate(docs.select(*COLUMNS), _table(spark, sf_dir, "benchmark"))
    return out.where(~F.col("contaminated")).select(*COLUMNS)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks secrets in the texts; every document stays.

    A null text stays null; n_chars counts anew where something was masked;
    copies are masked alike, and each counts in the false-discovery rule; an
    empty table gives an empty one; other columns than ``COLUMNS`` go.
    """
    text = redact(F.col("text"), F.col("spans"))
    masked = F.size("spans") > 0
    out = scan_secrets(docs, COLUMNS).withColumns({"text": text, "n_chars": F.when(masked, F.length(text).cast("long")).otherwise(F.col("n_chars"))})
    return out.select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into sequences of 4096 tokens: a row per piece.

    A null text is empty and has its end id alone; only longer documents are
    cut; copies take any places for their length; null ids stay; an empty
    table gives an empty one; other columns than ``COLUMNS`` aren't read.
    """
    pieces = encode_pieces(docs, public_tokenizers.path("word_bpe_49k.json"))
    placed = pack(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("quality", quality),
    ("simhash", simhash),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("packing", packing),
]

#: No stage but the scans can be put in SQL: a trained model, tries, tokenizers.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select(*COLUMNS)
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
