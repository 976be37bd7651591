"""The corpus operators as queries over the documents and embeddings tables, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import embedding_dedup, exact_dedup, language_id, lm_scoring, merkle, mixing, ngram_join, packing, permutation_index, pii, resampling, substring_dedup, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(n: int) -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(n))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.drop_repeats(table(spark, sf_dir, "documents"), window=20)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = pii.found(docs, pii.learn(docs))
    base = F.filter("spans", lambda s: s["base"])
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [count(kind) for kind in pii.KINDS]
    return out.select("doc_id", *counts, F.sha2(line(base), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score_texts(table(spark, sf_dir, "documents"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_groups(table(spark, sf_dir, "documents"), n=4, num=85, den=100).select("doc_id", "n_shingles", "component_id")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"), fold(5) != 0)
    out = toxicity.scored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), model)
    return out.select("doc_id", (fold(5) == 0).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(), capacity=2048, end_id=1)
    return out.select("doc_id", "start", F.col("length").cast("long").alias("length"), F.col("checksum").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = language_id.identified(docs, language_id.learn(docs.where(fold(3) != 1)))
    return out.select("doc_id", (fold(3) == 1).alias("held_out"), "lang_pred", "score")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.draws(table(spark, sf_dir, "documents"), weights=(3, 1, 2), share=1.5, most=2.0)
    shards = F.array_join(F.transform("draws", lambda x: x["shard"].cast("string")), ",")
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("draws")).alias("taken"), shards.alias("shards"))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(table(spark, sf_dir, "embeddings"), floor=0.95)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup.exact_groups(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resampling.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), buckets=10_000, percent=25, least_words=20, seed=7)
    return out.select("doc_id", "n_features", "weight", "score", "rank")


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tampered = F.when(fold(7) == 0, merkle.leaf(n_chars=F.col("n_chars") + 1))
    out = merkle.manifest(docs, tampered).withColumn("folded_root", merkle.fold(F.col("other"), F.col("proof")))
    proof = F.sha2(F.array_join(merkle.siblings(F.col("proof")), ""), 256)
    return out.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op13_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return permutation_index.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_substring_dedup, op2_pii, op3_lm_scoring, op4_ngram_join, op5_toxicity, op6_packing, op7_language_id, op8_mixing, op9_embedding_dedup, op10_exact_dedup, op11_resampling, op12_manifest, op13_nearest, pipeline)}

#: SQL of CRC-32: a row ``crc_table``, and the checksum of a string's bytes by it.
_CRC_TABLE = "tab AS MATERIALIZED (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS crc_table FROM range(256) r(i))"


def _crc(s: str) -> str:
    byte = f"list_transform(range(1, strlen({s}) + 1), lambda i: ('0x' || substr(hex({s}), 2 * i - 1, 2))::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295, {byte}), lambda c, b: xor(crc_table[(xor(c, b) & 255) + 1], c >> 8)), 4294967295)"


def _leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(f"coalesce(strlen({c}) || ':' || {c}, '-')" for c in ("doc_id::VARCHAR", "source", "lang", f"({n_chars})::VARCHAR", "text")) + ")"


def _levels(name: str, start: str) -> str:
    """SQL of a tree's nodes (g, lvl, idx, h, n) over the nodes (g, idx, h) of a table."""
    return f"{name} AS (SELECT g, 0 AS lvl, idx, h, count(*) OVER (PARTITION BY g) AS n FROM {start} UNION ALL SELECT g, lvl + 1, idx // 2, sha256(string_agg(h, '' ORDER BY idx)), (n + 1) // 2 FROM {name} WHERE n > 1 GROUP BY g, lvl, n, idx // 2)"


def _steps(tree: str, nodes: str, item: str) -> str:
    """SQL of the steps (item, lvl, side, sibling) of a tree's lowest nodes; no sibling is null."""
    return f"SELECT x.{item}, v.lvl, CASE WHEN (x.idx >> v.lvl) & 1 = 1 THEN 'L' ELSE 'R' END AS side, u.h AS sibling FROM {nodes} x JOIN (SELECT DISTINCT g, lvl FROM {tree} WHERE n > 1) v ON v.g = x.g LEFT JOIN {tree} u ON u.g = x.g AND u.lvl = v.lvl AND u.idx = xor(x.idx >> v.lvl, 1)"


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: The others' rows need a model, a tokenizer or a draw, or are too slow in SQL on whole tables; tests hold them against brute force.
ORACLES = {
    "op10_exact_dedup": r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM d WINDOW g AS (PARTITION BY t)""",
    "op1_substring_dedup": r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
each_word AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
s AS (SELECT doc_id, i, md5(concat_ws(' ', word, """ + ", ".join(f"lead(word, {k}) OVER p" for k in range(1, 20)) + r""")) AS words, lead(i, 19) OVER p IS NOT NULL AS whole
      FROM each_word WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
h AS (SELECT doc_id, i, row_number() OVER (PARTITION BY words ORDER BY doc_id, i) > 1 AS later FROM s WHERE whole),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM h WHERE later),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS words, count(*) AS n FROM each_word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(words, '')) AS kept_sha256
FROM d LEFT JOIN kept ON d.doc_id IS NOT DISTINCT FROM kept.doc_id""",
    "op11_resampling": rf"""
WITH {_CRC_TABLE},
d AS (SELECT 0 AS which, doc_id, row_number() OVER () AS r, text FROM documents UNION ALL SELECT 1, NULL, row_number() OVER (), text FROM benchmark),
w AS (SELECT which, doc_id, r, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM d),
each_word AS (SELECT which, r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM w),
feature AS (SELECT which, r, word AS f FROM each_word
  UNION ALL SELECT which, r, word || ' ' || later FROM (SELECT *, lead(word) OVER (PARTITION BY which, r ORDER BY i) AS later FROM each_word) WHERE later IS NOT NULL),
bucket AS (SELECT f, {_crc("f")} % 10000 AS bucket FROM (SELECT DISTINCT f FROM feature), tab),
b AS (SELECT which, r, bucket FROM feature JOIN bucket USING (f)),
c AS (SELECT bucket, (count(*) FILTER (WHERE which = 0))::DOUBLE AS s, (count(*) FILTER (WHERE which = 1))::DOUBLE AS t FROM b GROUP BY 1),
gain AS (SELECT bucket, floor(1000 * ln((t + 1) * (ss + 10000) / ((s + 1) * (tt + 10000)))) AS gain FROM c, (SELECT sum(s) AS ss, sum(t) AS tt FROM c)),
mean AS (SELECT r, count(*) AS n_features, floor(sum(gain) / count(*))::BIGINT AS weight FROM b JOIN gain USING (bucket) WHERE which = 0 GROUP BY 1),
scored AS (SELECT doc_id, len(w) >= 20 AS long, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM w LEFT JOIN mean USING (r) WHERE which = 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY long ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY long) AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN long AND place <= 25 * n // 100 THEN place END AS rank FROM placed""",
    "op12_manifest": f"""
WITH RECURSIVE {_CRC_TABLE},
d AS (SELECT *, {_leaf("n_chars")} AS h, {_leaf("n_chars + 1")} AS changed, {_crc("doc_id::VARCHAR")} % 7 = 0 AS tampered FROM documents, tab),
leaf AS (SELECT row_number() OVER () AS r, doc_id, coalesce('=' || lang, '') AS g, h, CASE WHEN tampered THEN changed ELSE h END AS other,
  row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS LAST, h) - 1 AS idx FROM d),
{_levels("tree", "leaf")},
sub AS (SELECT '' AS g, g AS own, h, row_number() OVER (ORDER BY g) - 1 AS idx FROM tree WHERE n = 1),
{_levels("over_all", "sub")},
step AS ({_steps("tree", "leaf", "r")} UNION ALL SELECT r, lvl + 1000, side, sibling FROM ({_steps("over_all", "sub", "own")}) t JOIN leaf ON leaf.g = t.own),
proof AS (SELECT r, coalesce(string_agg(sibling, '' ORDER BY lvl), '') AS siblings, list(coalesce(side || sibling, '') ORDER BY lvl) AS steps FROM step GROUP BY r),
folded AS (SELECT doc_id, leaf.h AS leaf, sub.h AS subroot, (SELECT h FROM over_all WHERE n = 1) AS root, sha256(coalesce(siblings, '')) AS proof_sha256,
  list_reduce(list_prepend(other, coalesce(steps, [])), lambda x, s: sha256(CASE WHEN s[1] = 'L' THEN s[2:] ELSE '' END || x || CASE WHEN s[1] = 'R' THEN s[2:] ELSE '' END)) AS folded_root
  FROM leaf JOIN sub ON sub.own = leaf.g LEFT JOIN proof USING (r))
SELECT *, folded_root = root AS verified FROM folded""",
}
