"""The operators over whole tables, and SQL twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.llm import (
    jaccard,
    langid,
    merkle,
    minhash,
    mixing,
    negatives,
    packing,
    pii,
    quality,
    simhash,
    topk,
    toxicity,
    warc,
)
from pageloom.llm.common import id_fold, table

QUALITY_FOLDS, QUALITY_HELD, QUALITY_AT = 5, 0, 0.3
LANG_FOLDS, LANG_HELD = 4, 2
TOXIC_FOLDS, TOXIC_HELD, TOXIC_AT = 3, 1, 0.7


def packed_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = id_fold(F.col("doc_id"), QUALITY_FOLDS)
    net = quality.fit(docs, table(spark, sf_dir, "labels"), fold != QUALITY_HELD)
    scored = docs.select(
        "doc_id", (fold == QUALITY_HELD).alias("held_out"), quality.score(net, F.col("text")).alias("score")
    )
    return scored.withColumn("predicted", (F.col("score") >= QUALITY_AT).cast("int"))


def archived_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.round_trip(table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.pseudonymise(docs)


def simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.cluster(table(spark, sf_dir, "documents"))
    digits = F.lower(F.lpad(F.hex("fingerprint"), 16, "0"))
    return found.withColumn("fingerprint", digits)


def languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = id_fold(F.col("doc_id"), LANG_FOLDS)
    model = langid.fit(docs, fold != LANG_HELD)
    judged = docs.select(
        "doc_id", (fold == LANG_HELD).alias("held_out"), langid.identify(model, F.col("text")).alias("l")
    )
    return judged.select("doc_id", "held_out", "l.lang_pred", "l.score", "l.languages")


def toxicity_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> toxicity.Model:
    usable = id_fold(F.col("doc_id"), TOXIC_FOLDS) != TOXIC_HELD
    return toxicity.fit(docs, table(spark, sf_dir, "labels"), usable)


def toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity_model(spark, docs, sf_dir)
    held = id_fold(F.col("doc_id"), TOXIC_FOLDS) == TOXIC_HELD
    scored = docs.select(
        "doc_id", held.alias("held_out"), toxicity.score(model, F.col("text")).alias("s")
    )
    return scored.select(
        "doc_id",
        "held_out",
        "s.score",
        (F.col("s.score") >= TOXIC_AT).cast("int").alias("predicted"),
        "s.evidence",
        "s.terms",
    )


def nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def mixed_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs)


def minhash_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.probe_next(table(spark, sf_dir, "documents"))
    text = ("edited_sha256", "fingerprint", "edited_fingerprint")
    return found.withColumns({c: F.lower(F.hex(c)) for c in text})


def hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, sf_dir, "embeddings").withColumn("label", shifted)
    return negatives.mine(vectors, F.col("vec_id") % 50 == 0)


def merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("_leaf", merkle.leaf(*map(F.col, merkle.FIELDS)))
    hit = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    fields = {c: F.col(c) for c in merkle.FIELDS} | {"text": F.translate("text", "\n", "")}
    # Tampering changes nothing where the text holds no line feed.
    tampered = F.when(hit & F.contains(F.col("text"), F.lit("\n")), merkle.leaf(*fields.values())).otherwise(F.col("_leaf"))
    found = merkle.manifest(docs, changed=tampered)
    folded = merkle.fold(F.col("changed"), F.col("proof"))
    return found.select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        merkle.path_digest(F.col("proof")).alias("proof_sha256"),
        folded.alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def ngram_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.cluster(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": packed_sequences,
    "op2_quality": quality_scores,
    "op3_warc": archived_pages,
    "op4_pii": pii_pseudonyms,
    "op5_simhash": simhash_components,
    "op6_langid": languages,
    "op7_toxicity": toxicity_scores,
    "op8_topk": nearest_vectors,
    "op9_mixing": mixed_sources,
    "op10_minhash": minhash_probe,
    "op11_negatives": hard_negatives,
    "op12_merkle": merkle_manifest,
    "op13_jaccard": ngram_components,
}

# Mean repetition per source; cumulative Poisson probabilities for counts 0 to 80 as a
# table; a document's count is the number of those at or below its draw.
MIXING_SQL = """
WITH docs AS (
  SELECT doc_id, text, source, md5(coalesce(text, '')) AS digest FROM documents
), sizes AS (
  SELECT source, CAST(sum(length(coalesce(text, '')) + 1) AS DOUBLE) AS size FROM documents GROUP BY source
), rated AS (
  SELECT source, pow(size, 0.5) / size * (SELECT sum(size) / sum(pow(size, 0.5)) FROM sizes) AS rate FROM sizes
), parted AS (
  SELECT source, rate, greatest(1, CAST(ceil(rate / 16) AS INT)) AS parts FROM rated
), terms AS (
  SELECT source, n, exp(-rate / parts + coalesce(sum(CASE WHEN n > 0 THEN ln(rate / parts / n) ELSE 0 END)
    OVER (PARTITION BY source ORDER BY n), 0)) AS term
  FROM parted, (SELECT unnest(range(0, 80)) AS n)
), below AS (
  SELECT source, n, sum(term) OVER (PARTITION BY source ORDER BY n) AS cum FROM terms
), draws AS (
  SELECT d.doc_id, d.text, d.source, d.digest, p.part,
    CAST('0x' || substr(md5('mix|' || coalesce(CAST(d.doc_id AS VARCHAR), 'null') || '|' || d.digest || '|' || p.part), 1, 13) AS BIGINT)
      / 4503599627370496.0 AS u
  FROM docs d JOIN (SELECT source, unnest(range(1, parts + 1)) AS part FROM parted) p
    ON d.source IS NOT DISTINCT FROM p.source
), counted AS (
  SELECT r.doc_id, r.text, r.source, r.digest,
    sum((SELECT count(*) FROM below b WHERE b.source IS NOT DISTINCT FROM r.source AND b.cum <= r.u)) AS n
  FROM draws r GROUP BY ALL
), copies AS (
  SELECT doc_id, text, source, digest, CAST(unnest(range(0, CAST(n AS BIGINT))) AS INT) AS copy FROM counted
)
SELECT doc_id, text, source, copy,
  md5('mix|order|' || coalesce(CAST(doc_id AS VARCHAR), 'null') || '|' || copy || '|' || digest) AS position_key
FROM copies
"""

# Base32 of the SHA-1: 40 hex digits are 8 groups of 20 bits, 4 signs each.
WARC_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS hex FROM pages
), firsts AS (
  SELECT body, min(page_id) AS first FROM p GROUP BY body
)
SELECT page_id, CAST(strlen(p.body) AS BIGINT) AS payload_bytes,
  array_to_string([
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      CAST((CAST('0x' || substr(hex, 1 + 5 * (i // 4), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS INT) + 1, 1)
    FOR i IN range(32)], '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM p JOIN firsts f ON p.body = f.body
"""

TOPK_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

NEGATIVES_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND label IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS alike,
    CAST(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * c.v[i])) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % 50 = 0
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
), ranked AS (
  SELECT p.*, n.vec_id AS negative_id, n.score AS negative_score, CAST(row_number() OVER (
      PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.vec_id) AS INT) AS rank
  FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.alike
    AND 50 * p.positive_score <= 100 * n.score AND 100 * n.score <= 95 * p.positive_score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 3
"""

# The CRC-32 is worked out bit by bit over the digits of doc_id.
MERKLE_SQL = """
WITH RECURSIVE docs AS (
  SELECT row_number() OVER () AS id, doc_id, source, lang, n_chars, text,
    xor(list_reduce(
      list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1), lambda i: CAST(ascii(substr(CAST(doc_id AS VARCHAR), i, 1)) AS BIGINT)),
      lambda c, b: list_reduce(range(8), lambda r, k: xor(r >> 1, (r & 1) * 3988292384), xor(c, b)),
      CAST(4294967295 AS BIGINT)), 4294967295) % 2 = 0 AS hit
  FROM documents
), hashed AS (
  SELECT id, doc_id, source,
    sha256(concat(coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'),
      coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-'),
      coalesce(strlen(text) || ':' || text, '-'))) AS leaf,
    sha256(concat(coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'),
      coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-'),
      coalesce(strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), ''), '-'))) AS changed, hit
  FROM docs
), leaves AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM hashed
), tree AS (
  SELECT source, 0 AS lvl, pos, leaf AS digest, count(*) OVER (PARTITION BY source) AS n FROM leaves
  UNION ALL
  SELECT source, lvl + 1, pos // 3, sha256(string_agg(digest, '' ORDER BY pos)), (max(n) + 2) // 3
  FROM tree WHERE n > 1 GROUP BY source, lvl, pos // 3
), subs AS (
  SELECT source, digest AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos FROM tree WHERE n = 1
), top AS (
  SELECT 0 AS lvl, pos, subroot AS digest, count(*) OVER () AS n FROM subs
  UNION ALL
  SELECT lvl + 1, pos // 3, sha256(string_agg(digest, '' ORDER BY pos)), (max(n) + 2) // 3
  FROM top WHERE n > 1 GROUP BY lvl, pos // 3
), own AS (
  SELECT l.id, t.lvl AS step, t.pos // 3 AS run, t.pos, t.source, 0 AS part
  FROM leaves l JOIN tree t ON t.source IS NOT DISTINCT FROM l.source AND t.n > 1
    AND t.pos = l.pos // CAST(pow(3, t.lvl) AS BIGINT)
  UNION ALL
  SELECT l.id, 100 + t.lvl, t.pos // 3, t.pos, NULL, 1
  FROM leaves l JOIN subs s ON s.source IS NOT DISTINCT FROM l.source
    JOIN top t ON t.n > 1 AND t.pos = s.pos // CAST(pow(3, t.lvl) AS BIGINT)
), nodes AS (
  SELECT lvl AS step, pos // 3 AS run, pos, source, 0 AS part, digest FROM tree
  UNION ALL SELECT 100 + lvl, pos // 3, pos, NULL, 1, digest FROM top
), steps AS (
  SELECT o.id, o.step, row_number() OVER (PARTITION BY o.id ORDER BY o.step) AS k,
    coalesce(string_agg(s.digest, '' ORDER BY s.pos) FILTER (s.pos < o.pos), '') AS prev,
    coalesce(string_agg(s.digest, '' ORDER BY s.pos) FILTER (s.pos > o.pos), '') AS next
  FROM own o JOIN nodes s ON s.part = o.part AND s.step = o.step AND s.run = o.run AND s.source IS NOT DISTINCT FROM o.source
  GROUP BY o.id, o.step
), folded AS (
  SELECT id, CAST(0 AS BIGINT) AS k, CASE WHEN hit THEN changed ELSE leaf END AS digest FROM leaves
  UNION ALL
  SELECT f.id, s.k, sha256(s.prev || f.digest || s.next) FROM folded f JOIN steps s ON s.id = f.id AND s.k = f.k + 1
), ends AS (
  SELECT id, arg_max(digest, k) AS folded_root FROM folded GROUP BY id
), proofs AS (
  SELECT id, sha256(string_agg(prev || next, '' ORDER BY k)) AS proof FROM steps GROUP BY id
)
SELECT l.doc_id, l.leaf, s.subroot, r.digest AS root, coalesce(p.proof, sha256('')) AS proof_sha256,
  e.folded_root, e.folded_root = r.digest AS verified
FROM leaves l JOIN subs s ON s.source IS NOT DISTINCT FROM l.source
  JOIN (SELECT digest FROM top WHERE n = 1) r ON true
  JOIN ends e ON e.id = l.id LEFT JOIN proofs p ON p.id = l.id
"""

ORACLES: dict[str, str] = {
    "op3_warc": WARC_SQL,
    "op8_topk": TOPK_SQL,
    "op9_mixing": MIXING_SQL,
    "op11_negatives": NEGATIVES_SQL,
    "op12_merkle": MERKLE_SQL,
}
