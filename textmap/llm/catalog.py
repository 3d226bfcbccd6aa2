"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmap.llm import (
    annsearch, brown, divergence, langid, mixing, neardup, neargraph, pieces, quality, sharding, spelling, tokenbin, tokencount,
)
from textmap.llm.folds import fold
from textmap.session import stage

TOKENIZER = "byte_bpe_50k.json"
PIECE_MODEL = "piece_bpe_32k.model"


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_brown_classes(spark: SparkSession, folder: str) -> DataFrame:
    scored = brown.score_texts(_table(spark, folder, "documents"), fold() != 1)
    return scored.withColumn("held_out", ~F.col("learnt")).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


def op2_pfor_tokens(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    files = tokenbin.write_token_files(_table(spark, folder, "documents"), public_tokenizers.path(TOKENIZER))
    return tokenbin.read_token_files(files)


def op3_multiprobe_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return annsearch.nearest(_table(spark, folder, "embeddings"), every=50, k=5)


def op4_entropy_balancing(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, folder, "documents"))
    return mixed.select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "rate"
    )


def op5_byte_shards(spark: SparkSession, folder: str) -> DataFrame:
    placed = sharding.shard_by_bytes(_table(spark, folder, "documents"), 40)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op9_fast_sketch_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, folder, "documents"), 85)


def op10_nn_descent_near_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return neargraph.near_vectors(_table(spark, folder, "embeddings"), 0.95)


def language_net(documents: DataFrame):
    """The network learnt from documents outside fold 0."""
    return langid.train(documents.where(fold() != 0), F.col("doc_id"))


def op6_byte_network_language(spark: SparkSession, folder: str) -> DataFrame:
    documents = _table(spark, folder, "documents")
    told = langid.identify(documents, language_net(documents))
    return told.select("doc_id", (fold() == 0).alias("held_out"), "lang_pred", "score")


def quality_model(measured: DataFrame, labels: DataFrame):
    """The model learnt from labels outside fold 0."""
    return quality.train(measured.where(fold() != 0), labels, F.col("doc_id"))


def op8_additive_quality(spark: SparkSession, folder: str) -> DataFrame:
    measured = stage(quality.measure(_table(spark, folder, "documents")), "quality-features")
    model = quality_model(measured, _table(spark, folder, "labels"))
    scored = quality.score(measured, model)
    return scored.select(
        "doc_id", (fold() == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


def op7_lattice_pieces(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    documents = _table(spark, folder, "documents")
    return pieces.encode(documents, public_tokenizers.path(PIECE_MODEL), then=(pieces.digested, pieces.DIGEST))


def op11_quadtree_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.audit(_table(spark, folder, "documents"))


def op12_whole_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    return tokencount.count_tokens(_table(spark, folder, "documents"), public_tokenizers.path(TOKENIZER))


def op13_gram_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.variants(_table(spark, folder, "documents"))


# CRC-32 by half bytes: the table of the reflected polynomial follows from four shift steps.
_CRC = """
list_reduce(
  list_concat([4294967295::BIGINT], list_transform(range(1, length(h) + 1),
    lambda i: ('0x' || h[(CASE WHEN i % 2 = 1 THEN i + 1 ELSE i - 1 END)::INT])::BIGINT)),
  lambda c, d: xor(c >> 4, t[(xor(c, d) & 15) + 1]))
"""

OP5_SQL = f"""
WITH steps AS (
  SELECT i, list_reduce([i, 0, 0, 0, 0]::BIGINT[],
    lambda c, s: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END) AS v
  FROM range(16) r(i)
), lookup AS (SELECT list(v ORDER BY i) AS t FROM steps),
texts AS (SELECT DISTINCT coalesce(text, '') AS body FROM documents),
hexed AS (SELECT body, lower(hex(encode(body))) AS h, t FROM texts, lookup),
sums AS (SELECT body, CASE WHEN h = '' THEN 0 ELSE xor({_CRC}, 4294967295::BIGINT) END AS crc FROM hexed),
sized AS (
  SELECT doc_id, strlen(coalesce(text, '')) + 16 AS size, crc AS text_crc32
  FROM documents JOIN sums ON coalesce(text, '') = body
), placed AS (
  SELECT *, coalesce(sum(size) OVER (ORDER BY doc_id, text_crc32 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
    sum(size) OVER () AS total
  FROM sized
), cut AS (
  SELECT *, (((2 * before + size) * 40) // (2 * total))::INTEGER AS shard FROM placed
)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY doc_id, text_crc32) - 1 AS slot, NULL::INTEGER AS grown_shard
FROM cut
"""

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP11_SQL = f"""
WITH docs AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    {_LOWER.format("coalesce(text, '')")} AS body
  FROM documents
), uses AS (
  SELECT id, lang, source, unnest(regexp_extract_all(body, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM docs
), kept AS (
  SELECT lang, term, count(*) AS n FROM uses GROUP BY ALL HAVING count(DISTINCT id) >= 30
), langs AS (SELECT lang, count(*) AS v, sum(n) AS size FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM docs),
counts AS (SELECT lang, source, term, count(*) AS c FROM uses JOIN kept USING (lang, term) GROUP BY ALL),
cells AS (
  SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c,
    sum(coalesce(c.c, 0)) OVER (PARTITION BY g.lang, g.source) + 5 * l.v AS total,
    1 + (1000000000::HUGEINT * (k.n + 5)) // (l.size + 5 * l.v) AS q
  FROM groups g JOIN kept k USING (lang) JOIN langs l USING (lang)
    LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), priced AS (SELECT *, 1 + (1000000000::HUGEINT * (c + 5)) // total AS p FROM cells),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(sum(abs(x.p - y.p)), 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN priced x ON x.lang = a.lang AND x.source = a.source
    LEFT JOIN priced y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
  GROUP BY ALL
), terms AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM priced WHERE c > 0 AND p > q),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""

OP13_SQL = f"""
WITH RECURSIVE steps AS (
  SELECT i, list_reduce([i, 0, 0, 0, 0]::BIGINT[],
    lambda c, s: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END) AS v
  FROM range(16) r(i)
), lookup AS (SELECT list(v ORDER BY i) AS t FROM steps),
found AS (
  SELECT doc_id, unnest(regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[a-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents
), runs AS (SELECT doc_id, run, count(*) AS n FROM found GROUP BY ALL),
hexed AS (
  SELECT run, n, lower(hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run))) AS h, t FROM runs, lookup
), hashed AS (SELECT run, n, xor({_CRC}, 4294967295::BIGINT) AS crc FROM hexed),
spelt AS (
  SELECT CASE WHEN crc % 97 = 0
    THEN substr(run, 1, (crc % length(run))::BIGINT) || substr(run, (crc % length(run))::BIGINT + 2) ELSE run END AS word, n
  FROM hashed
), words AS (SELECT word, sum(n)::BIGINT AS n FROM spelt WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
cuts AS (
  SELECT word, n, i, substr(word, 1, i - 1) AS head, substr(word, i + 1) AS tail
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)
), shorter AS (
  SELECT DISTINCT c.word AS longer, c.n AS n_longer, w.word, w.n FROM cuts c JOIN words w ON w.word = c.head || c.tail
), near AS (
  SELECT a.word, a.n, b.word AS other, b.n AS n_other
  FROM cuts a JOIN cuts b ON a.i = b.i AND a.head = b.head AND a.tail = b.tail AND a.word <> b.word
  UNION ALL SELECT longer, n_longer, word, n FROM shorter
  UNION ALL SELECT word, n, longer, n_longer FROM shorter
), best AS (
  SELECT word, n, other, n_other, count(*) OVER (PARTITION BY word) AS n_near,
    row_number() OVER (PARTITION BY word ORDER BY n_other DESC, other) AS place
  FROM near
), told AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near,
    CASE WHEN b.n_other >= 2 * w.n THEN b.other END AS form, CASE WHEN b.n_other >= 2 * w.n THEN b.n_other END AS form_n
  FROM words w LEFT JOIN best b ON b.word = w.word AND b.place = 1
), ways AS (
  SELECT word, word AS at, form AS next FROM told
  UNION ALL SELECT y.word, t.word, t.form FROM ways y JOIN told t ON t.word = y.next
)
SELECT t.word, t.form, y.at AS root, t.n, t.n_near, t.form_n
FROM told t JOIN ways y ON y.word = t.word AND y.next IS NULL
"""


def queries() -> dict:
    return {
        "op1_brown_classes": op1_brown_classes,
        "op2_pfor_tokens": op2_pfor_tokens,
        "op3_multiprobe_neighbours": op3_multiprobe_neighbours,
        "op4_entropy_balancing": op4_entropy_balancing,
        "op5_byte_shards": op5_byte_shards,
        "op6_byte_network_language": op6_byte_network_language,
        "op7_lattice_pieces": op7_lattice_pieces,
        "op8_additive_quality": op8_additive_quality,
        "op9_fast_sketch_near_duplicates": op9_fast_sketch_near_duplicates,
        "op10_nn_descent_near_vectors": op10_nn_descent_near_vectors,
        "op11_quadtree_divergence": op11_quadtree_divergence,
        "op12_whole_token_counts": op12_whole_token_counts,
        "op13_gram_spelling_variants": op13_gram_spelling_variants,
    }


def oracles() -> dict[str, str]:
    return {"op5_byte_shards": OP5_SQL, "op11_quadtree_divergence": OP11_SQL, "op13_gram_spelling_variants": OP13_SQL}
