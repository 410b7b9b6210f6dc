"""Benchmark decontamination by a distributed positional inverted index.

The test side gives windows of ``size`` consecutive words.  Of the training
side, the postings (document, position) of the words that anchor a window are
stored: the window's two rarest words by collection frequency.  The list of
the rarest, moved back by its offset in the window, is intersected with that
of the second; what remains is compared with the document's own words.
Everything is DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, materialize

#: What stands between words; a word is a run of anything else.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Up to so many rows the test side's tables are broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 1_000_000


def words(text: Column) -> Column:
    """The words of a text, A-Z lower-cased; none for null."""
    # Cut at the gaps, which costs a fifth of extracting each word as a match.
    return F.coalesce(F.array_remove(F.split(ascii_lower(text), GAP), ""), F.array().cast("array<string>"))


def test_windows(items: DataFrame, size: int = 10) -> DataFrame:
    """(wid, ws, items): the distinct windows of the test items, and who has them."""
    w = items.where("item_id is not null").select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0)
    at = F.sequence(F.lit(1), F.greatest(F.size("w") - (size - 1), F.lit(1)))
    w = w.select("item_id", "w", F.explode(at).alias("at")).select("item_id", F.slice("w", F.col("at"), size).alias("ws"))
    w = w.groupBy("ws").agg(F.collect_set(F.col("item_id").cast("string")).alias("items"))
    return w.select(F.xxhash64("ws").alias("wid"), "ws", "items")


def _sized(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast, if its counted rows are few enough."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def anchors(docs: DataFrame, windows: DataFrame, keep: int = 2) -> DataFrame:
    """(ws, items, anchors): each window that can occur, with its ``keep`` rarest words and their offsets.

    A window with a word that no document has can't occur and is left out.
    """
    vocab = windows.select(F.explode("ws").alias("term")).distinct()
    vocab = materialize(vocab, "vocab")
    tokens = docs.select(F.explode(words(F.col("text"))).alias("term"))
    freq = tokens.join(_sized(vocab, vocab.count()), "term").groupBy("term").agg(F.count("*").alias("freq"))
    freq = materialize(freq, "freq")
    terms = windows.select("ws", "items", F.posexplode("ws").alias("off", "term")).join(_sized(freq, freq.count()), "term")
    first = terms.groupBy("ws", "items").agg(
        F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("freq", "term", "off"))).alias("by_freq")
    )
    return first.where(F.col("n") == F.size("ws")).select("ws", "items", F.slice("by_freq", 1, keep).alias("anchors"))


def postings(docs: DataFrame, terms: DataFrame, n_terms: int) -> DataFrame:
    """The index: (doc_id, term, pos) of every occurrence of the given terms."""
    rows = docs.select("doc_id", F.posexplode(words(F.col("text"))).alias("pos", "term"))
    return rows.join(_sized(terms, n_terms), "term").select("doc_id", "term", "pos")


def _anchored(index: DataFrame, wins: DataFrame, n: int, k: int) -> DataFrame:
    """Postings of the k-th anchor, moved to where the window would start."""
    w = wins.where(F.size("anchors") > k).select("ws", "items", F.col("anchors")[k]["term"].alias("term"), F.col("anchors")[k]["off"].alias("off"), "anchors")
    return index.join(_sized(w, n), "term").withColumn("start", F.col("pos") - F.col("off"))


def candidates(docs: DataFrame, items: DataFrame, size: int = 10) -> tuple[DataFrame, DataFrame, int, DataFrame]:
    """(candidate starts, windows with anchors, their number, index)."""
    wins = materialize(anchors(docs, materialize(test_windows(items, size), "windows")), "anchors")
    n = wins.count()
    terms = materialize(wins.select(F.explode("anchors").alias("a")).select("a.term").distinct(), "terms")
    # Repeated rows have the same postings.
    index = materialize(postings(docs, terms, terms.count()).distinct(), "index")
    one = _anchored(index, wins, n, 0).where("start >= 0")
    second = F.col("anchors")[1]
    pair = one.where(F.size("anchors") > 1).withColumns({"term2": second["term"], "pos2": F.col("start") + second["off"]})
    other = index.select(F.col("doc_id").alias("d"), F.col("term").alias("term2"), F.col("pos").alias("pos2"))
    same = pair["doc_id"].eqNullSafe(other["d"]) & (pair["term2"] == other["term2"]) & (pair["pos2"] == other["pos2"])
    met = pair.join(other, same, "left_semi").select("doc_id", "start", "ws", "items")
    alone = one.where(F.size("anchors") == 1).select("doc_id", "start", "ws", "items")
    return met.unionByName(alone), wins, n, index


def decontaminate(docs: DataFrame, items: DataFrame, size: int = 10) -> DataFrame:
    """Every row of docs with n_words, n_hit, n_items, hit_items (item ids as
    sorted strings), hits (spans in words: start, end) and contaminated.

    A window is ``size`` consecutive words of an item; an item of fewer words,
    but not none, is one window.  A word of a document inside an occurrence of
    any window is hit.  Null texts and texts without words have no words and
    no hits; repeated rows are judged alike, each by its own text, also where
    they share a doc_id or it is null; items without words or id are left out.
    An empty table on either side gives no hits.  Columns of docs stay, but
    for the names above, which are replaced.
    """
    made = ["n_words", "n_hit", "n_items", "hit_items", "hits", "contaminated"]
    docs = docs.drop(*made)
    # Candidates belong to an id with its text, so rows under one id, or without any, don't share them; each row's own words decide.
    key = F.xxhash64("doc_id", "text")
    found, *_ = candidates(docs.select(key.alias("doc_id"), "text"), items.select("item_id", "text"), size)
    found = found.distinct().groupBy(F.col("doc_id").alias("_doc")).agg(F.collect_list(F.struct("start", "ws", "items")).alias("_found"))
    out = docs.join(found, key == F.col("_doc"), "left").drop("_doc").withColumn("_w", words(F.col("text")))
    none = F.array().cast("array<struct<start:int,ws:array<string>,items:array<string>>>")
    fits = F.filter(F.coalesce("_found", none), lambda c: F.slice(F.col("_w"), c["start"] + 1, F.size(c["ws"])) == c["ws"])
    out = out.withColumn("_ok", fits)
    # A span as one number, by which repeats go in linear time; numbers sort as (start, end) do.
    packed = F.array_sort(F.array_distinct(F.transform("_ok", lambda c: F.shiftleft(c["start"].cast("long"), 32) + F.size(c["ws"]))))
    start = lambda x: F.shiftright(x, 32).cast("int")
    spans = F.transform(packed, lambda x: F.struct(start(x).alias("start"), (start(x) + x.bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")).alias("end")))
    out = out.select(
        *docs.columns,
        F.size("_w").cast("long").alias("n_words"),
        spans.alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.transform("_ok", lambda c: c["items"])))).alias("hit_items"),
    )
    covered = F.aggregate(
        "hits",
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda s, h: F.struct(
            F.greatest(s["end"], h["end"]).alias("end"),
            (s["n"] + F.greatest(F.lit(0), h["end"] - F.greatest(h["start"], s["end"]))).cast("long").alias("n"),
        ),
        lambda s: s["n"],
    )
    return out.withColumns(
        {"n_hit": covered, "n_items": F.size("hit_items").cast("long"), "contaminated": F.size("hits") > 0}
    )


def proximity_matches(docs: DataFrame, items: DataFrame, slop: int = 3, size: int = 10) -> DataFrame:
    """(doc_id, item_id, start, gap): places where the two rarest words of a window
    stand at most ``slop`` positions nearer or farther than in the window.  gap 0
    includes every exact phrase; windows of one word match wherever it stands."""
    _, wins, n, index = candidates(docs.select("doc_id", "text"), items.select("item_id", "text"), size)
    one = _anchored(index, wins, n, 0)
    alone = one.where(F.size("anchors") == 1).select("doc_id", "items", "start", F.lit(0).alias("gap"))
    second = F.col("anchors")[1]
    pair = one.where(F.size("anchors") > 1).withColumns({"term2": second["term"], "pos2": F.col("start") + second["off"]})
    # A band join on blocks of slop + 1 positions: each place meets three blocks.
    wide = slop + 1
    pair = pair.withColumn("b", F.explode(F.sequence(F.floor(F.col("pos2") / wide) - 1, F.floor(F.col("pos2") / wide) + 1)))
    other = index.select("doc_id", F.col("term").alias("term2"), F.col("pos").alias("p"), F.floor(F.col("pos") / wide).alias("b"))
    near = pair.join(other, ["doc_id", "term2", "b"]).where(F.abs(F.col("p") - F.col("pos2")) <= slop).where("p <> pos")
    near = near.select("doc_id", "items", "start", F.abs(F.col("p") - F.col("pos2")).alias("gap")).unionByName(alone)
    near = near.select("doc_id", F.explode("items").alias("item_id"), "start", "gap")
    return near.groupBy("doc_id", "item_id", "start").agg(F.min("gap").alias("gap"))
