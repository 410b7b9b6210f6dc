"""The registered queries opN_<name> of this subpackage, and their SQL where there is any."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import simhash_components

    out = simhash_components(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import decontaminate

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontaminate(docs, table(spark, sf_dir, "benchmark"))
    ids = F.sha2(F.concat_ws(",", "hit_items"), 256).alias("items_sha256")
    return out.select("doc_id", "n_words", "n_hit", "n_items", ids, "contaminated")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import KINDS, digest, scan_secrets

    out = scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["kind"] < 3)
    of_kind = lambda k: F.filter("spans", lambda s: s["kind"] == k)
    counts = [F.size(of_kind(k)).cast("long").alias(f"n_{KINDS[k]}") for k in range(3)]
    return out.select("doc_id", *counts, F.sha2(digest(base), 256).alias("base_sha256"), digest(F.col("spans")).alias("spans"))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import crc_mod
    from .quality import score_quality, train_quality

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score_quality(docs, train_quality(docs, table(spark, sf_dir, "labels")))
    return out.select(
        "doc_id",
        (crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"),
        F.col("quality_score").alias("score"),
        (F.col("quality_score") >= 0.5).cast("int").alias("predicted"),
    )


def op2_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .sstable import read_shards, write_shards

    manifest = write_shards(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return read_shards(manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import encode_pieces, pack

    pieces = encode_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    placed = pack(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import crc_mod
    from .langid import identify, train_langid

    docs = table(spark, sf_dir, "documents")
    out = identify(docs, train_langid(docs.select("doc_id", "text", "lang")))
    return out.select("doc_id", (crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import crc_mod
    from .toxicity import score_toxicity, train_toxicity

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score_toxicity(docs, train_toxicity(docs, table(spark, sf_dir, "labels")))
    return out.select(
        "doc_id",
        (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"),
        F.col("toxicity").alias("score"),
        (F.col("toxicity") >= 0.3).cast("int").alias("predicted"),
    )


def op4_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embeddings import near_embeddings

    return near_embeddings(table(spark, sf_dir, "embeddings"))


def op3_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .urls import judge_urls

    return judge_urls(table(spark, sf_dir, "pages"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lexical import build_index, search

    index = build_index(table(spark, sf_dir, "documents"))
    return search(index, table(spark, sf_dir, "benchmark"), k=20)


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substrings import remove_substrings

    out = remove_substrings(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .veccodes import vector_codes

    return vector_codes(table(spark, sf_dir, "embeddings"))


QUERIES = {"op3_urls": op3_urls, "op4_embeddings": op4_embeddings, "op5_toxicity": op5_toxicity, "op8_langid": op8_langid, "op2_token_shards": op2_token_shards, "op6_packing": op6_packing, "op1_quality": op1_quality, "op9_secrets": op9_secrets, "op7_simhash": op7_simhash, "op10_decontaminate": op10_decontaminate, "op11_lexical_search": op11_lexical_search, "op12_substring_dedup": op12_substring_dedup, "op13_vector_codes": op13_vector_codes}
#: Words and their places, windows, and their occurrences, one length of windows after the other.
OP10_SQL = r"""WITH dw AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
bw AS (SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
win AS (SELECT DISTINCT item, array_to_string(w[a : a + 9], ' ') AS s, least(len(w), 10) AS n FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS a FROM bw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
places AS (SELECT doc_id, n, a, array_to_string(w[a : a + n - 1], ' ') AS s FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS a FROM dw, sizes WHERE len(w) >= n)),
found AS (SELECT doc_id, a, places.n, item FROM places JOIN win ON win.s = places.s AND win.n = places.n),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(a, a + n)) AS p FROM found) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS line FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id)
SELECT dw.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(line, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)"""
#: All pairs of a label by cosine, then what is reachable.
OP4_SQL = """WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
u AS (SELECT vec_id, label, e FROM v WHERE len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
lowest AS (SELECT a, min(b) AS b FROM reach GROUP BY a), n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, coalesce(least(vec_id, lowest.b), vec_id)::BIGINT AS component_id, vec_id = coalesce(least(vec_id, lowest.b), vec_id) AS kept FROM embeddings LEFT JOIN lowest ON lowest.a = vec_id LEFT JOIN n ON n.a = vec_id"""
#: Terms of each document and item, weights from their frequencies, and the scores of all documents that share one.
OP11_SQL = r"""WITH t AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents WHERE text IS NOT NULL),
d AS (SELECT r, doc_id, w, len(w) AS n FROM t WHERE len(w) > 0),
g AS (SELECT count(*)::BIGINT AS big_n, sum(n)::BIGINT AS big_l FROM d),
p AS (SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(w) AS term FROM d) GROUP BY r, term),
wt AS (SELECT term, floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS weight FROM p, g GROUP BY term, big_n),
q AS (SELECT q, item_id, term, count(*)::BIGINT AS times FROM (SELECT row_number() OVER () AS q, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark WHERE text IS NOT NULL) GROUP BY q, item_id, term),
s AS (SELECT q, item_id, r, doc_id, sum(times * weight * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * big_n) // big_l))))::BIGINT AS score FROM q JOIN wt USING (term) JOIN p USING (term) JOIN d USING (r), g GROUP BY q, item_id, r, doc_id)
SELECT item_id, rank, doc_id, score FROM (SELECT item_id, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank, doc_id, score FROM s WHERE score > 0) WHERE rank <= 20"""


#: Windows of 50 words, the least document of each, and the words that an older one covers.
OP12_SQL = r"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
win AS MATERIALIZED (SELECT r, doc_id, a, md5(array_to_string(w[a : a + 49], ' ')) AS s FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 48)) AS a FROM d WHERE len(w) >= 50)),
old AS (SELECT s, min(doc_id) AS m FROM win GROUP BY s),
gone AS (SELECT DISTINCT r, unnest(range(a, a + 50)) AS i FROM win JOIN old USING (s) WHERE doc_id > m),
one AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
kept AS (SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS line FROM one ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(line, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r)"""


def _op13_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """Plain Lloyd rounds, one after the other; every part meets every entry."""
    near = "SELECT r, part, min_by(entry, (far, entry)) AS entry, min(far) AS far FROM (SELECT r, x.part, entry, sum((x.v - b.v) * (x.v - b.v))::BIGINT AS far FROM x JOIN {b} b USING (part, pos) GROUP BY r, x.part, entry) GROUP BY r, part"
    steps = [
        "k AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label, embedding FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0)",
        f"x AS MATERIALIZED (SELECT r, (p - 1) // (len(embedding) // {parts}) AS part, (p - 1) % (len(embedding) // {parts}) AS pos, floor(4096 * embedding[p]::DOUBLE)::BIGINT AS v FROM (SELECT r, embedding, unnest(range(1, len(embedding) + 1)) AS p FROM k))",
        f"b0 AS MATERIALIZED (SELECT part, r - 1 AS entry, pos, v FROM x WHERE r <= {entries})",
    ]
    for i in range(rounds):
        mean = f"SELECT part, entry, pos, (s - ((s % n) + n) % n) // n AS v FROM (SELECT x.part, n{i}.entry, pos, sum(v)::BIGINT AS s, count(*)::BIGINT AS n FROM x JOIN n{i} USING (r, part) GROUP BY x.part, n{i}.entry, pos)"
        steps += [f"n{i} AS MATERIALIZED ({near.format(b=f'b{i}')})", f"m{i} AS MATERIALIZED ({mean})"]
        steps.append(f"b{i + 1} AS MATERIALIZED (SELECT part, entry, pos, coalesce(m{i}.v, b{i}.v) AS v FROM b{i} LEFT JOIN m{i} USING (part, entry, pos))")
    steps += [
        f"n{rounds} AS MATERIALIZED ({near.format(b=f'b{rounds}')})",
        f"c AS (SELECT r, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(far)::BIGINT AS error FROM n{rounds} GROUP BY r)",
        f"h AS (SELECT sha256(string_agg(v::VARCHAR, ',' ORDER BY part, entry, pos)) AS codebooks_sha256 FROM b{rounds})",
    ]
    return f"WITH {', '.join(steps)} SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM k JOIN c USING (r), h"


ORACLES: dict[str, str] = {"op4_embeddings": OP4_SQL, "op10_decontaminate": OP10_SQL, "op11_lexical_search": OP11_SQL, "op12_substring_dedup": OP12_SQL, "op13_vector_codes": _op13_sql()}
