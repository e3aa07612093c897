"""Registered queries of this folder, and DuckDB SQL where it can say the same.

Every query applies its operator with production parameters to its whole table
and derives the digest columns from the operator's real outputs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.llm import byte_fold, chat_hmm, chat_repair, cosine_cells, language_crf, piece_codec, pivot_simhash, prefix_tour, rotated_codes, secret_automata, span_compaction, token_mix, vector_packing
from tagloom.llm.common import read_table


def op1_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = language_crf.learn(docs, ~language_crf.held_out())
    out = language_crf.predict(docs, model, keep=["doc_id"])
    return out.select("doc_id", language_crf.held_out().alias("held_out"), "lang_pred", "score", "n_words")


def op2_secret_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return secret_automata.report(secret_automata.find_spans(docs, secret_automata.learn(docs)))


def op3_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    out = piece_codec.encode(docs, ids_col="ids", decoded_col="decoded")
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids.cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op4_chat_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = read_table(spark, sf_dir, "conversations")
    out = chat_hmm.format_chats(chats, trusted=~language_crf.held_out("conv_id"))
    return out.select("conv_id", "turn", language_crf.held_out("conv_id").alias("held_out"), "role_pred", F.size("roles").cast("long").alias("n_turns"), "rendered")


def op5_span_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = span_compaction.remove_repeats(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op6_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = vector_packing.pack(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_cosine_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cosine_cells.near_duplicates(read_table(spark, sf_dir, "embeddings"))


def op8_rotated_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotated_codes.search(read_table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


def op9_pivot_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pivot_simhash.near_duplicates(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", pivot_simhash.hex_of(F.col("fingerprint")).alias("fingerprint"), "component_id")


#: Quality weights of labelled documents; documents without a label weigh 1.
QUALITY_WEIGHTS = {1: 2.0, 0: 0.5}


def quality_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    weight = F.when(F.col("quality") == 1, QUALITY_WEIGHTS[1]).when(F.col("quality") == 0, QUALITY_WEIGHTS[0])
    return read_table(spark, sf_dir, "labels").select("doc_id", weight.alias("weight"))


def op10_token_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = token_mix.mix(read_table(spark, sf_dir, "documents"), weights=quality_weights(spark, sf_dir))
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op11_chat_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = read_table(spark, sf_dir, "conversations")
    out = chat_repair.report(chats, chat_repair.repair(chat_repair.damage(chats)))
    return out.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def op12_prefix_tour(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = prefix_tour.trie(read_table(spark, sf_dir, "conversations"))
    long = lambda c: F.col(c).cast("long").alias(c)
    return out.select(
        F.col("owner").alias("conv_id"), "depth", F.when(F.col("depth") > 0, F.col("parent")).alias("parent_conv_id"), *[long(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")], "ends_sha256",
    )


def op13_byte_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = byte_fold.encode(read_table(spark, sf_dir, "documents"))
    n_ids = 1 + max(byte_fold.load_ranks(byte_fold.default_ranks()).values())
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(byte_fold.little_endian(F.col("ids"), n_ids), 256).alias("ids_sha256"),
        F.sha2(byte_fold.decode(F.col("ids")), 256).alias("decoded_sha256"),
    )


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_language_crf, op2_secret_automata, op3_piece_codec, op4_chat_hmm, op5_span_compaction, op6_vector_packing, op7_cosine_cells, op8_rotated_codes, op9_pivot_simhash, op10_token_mix, op11_chat_repair, op12_prefix_tour, op13_byte_fold, pipeline)
}

ORACLE: dict[str, str] = {}

ORACLE["op5_span_compaction"] = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
n AS (SELECT doc_id, ws, len(ws) AS n_words FROM w),
starts AS (SELECT doc_id, unnest(range(1, n_words - 48)) AS i, ws FROM n WHERE n_words >= 50),
windows AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS k FROM starts),
firsts AS (SELECT k, min(doc_id) AS lo FROM windows GROUP BY k),
hits AS (SELECT doc_id, list(DISTINCT i) AS hit FROM windows JOIN firsts USING (k) WHERE lo < doc_id GROUP BY doc_id),
covered AS (SELECT DISTINCT doc_id, unnest(range(h, h + 50)) AS i FROM (SELECT doc_id, unnest(hit) AS h FROM hits)),
words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, n_words + 1)) AS i FROM n),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept, count(*) AS c FROM words ANTI JOIN covered USING (doc_id, i) GROUP BY doc_id)
SELECT n.doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(n_words - coalesce(c, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM n LEFT JOIN kept USING (doc_id)"""

ORACLE["op7_cosine_cells"] = """
WITH RECURSIVE ok AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.9),
reach AS (
  SELECT vec_id AS a, vec_id AS c FROM embeddings
  UNION
  SELECT l.b AS a, r.c FROM reach r JOIN links l ON l.a = r.a),
component AS (SELECT a AS vec_id, min(c) AS component_id FROM reach GROUP BY a),
counted AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN component USING (vec_id) LEFT JOIN counted USING (vec_id)"""

ORACLE["op8_rotated_codes"] = """
WITH ok AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v) AS score
  FROM ok q JOIN ok c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0),
ranked AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20"""

ORACLE["op10_token_mix"] = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
q AS (SELECT doc_id, max(CASE quality WHEN 1 THEN 2.0 WHEN 0 THEN 0.5 END) AS w FROM labels GROUP BY doc_id),
k AS (
  SELECT d.*, -ln((CAST('0x' || substr(md5('mix:' || CAST(d.doc_id AS VARCHAR)), 1, 13) AS BIGINT) + 0.5) / CAST(4503599627370496 AS DOUBLE)) / CAST(coalesce(w, 1.0) AS DOUBLE) AS key
  FROM d LEFT JOIN q USING (doc_id)),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS r FROM d GROUP BY source),
shares AS (SELECT *, CASE r % 3 WHEN 0 THEN 3.0 WHEN 1 THEN 1.0 ELSE 2.0 END::DOUBLE AS share, 2.0::DOUBLE * source_size AS full_size FROM s),
levels AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(full_size) OVER (ORDER BY full_size / share, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(share) OVER (ORDER BY full_size / share, r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lvl FROM shares),
goals AS (SELECT source, source_size, least(full_size, max(lvl) OVER () * share) AS target FROM levels),
parts AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM goals),
pre AS (
  SELECT k.doc_id, k.size, p.source_size, p.target, p.epochs, p.target - p.epochs * p.source_size AS rest,
    sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id ROWS UNBOUNDED PRECEDING) AS upto
  FROM k JOIN parts p ON k.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target, CAST(size * (epochs + CASE WHEN rest > 0 AND upto - size / 2.0 < rest THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM pre"""
