"""The queries of this folder's operators over the whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwright.llm import bm25, chat, jaccard, lines, masked_lm, mixing, packing, quality, telephony, toxicity
from inkwright.llm.labelled import fold
from inkwright.llm.shared import spread


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name == "documents" else df


def op1_line_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without later repeats of runs of 30 words or more."""
    out = lines.dedup_lines(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("_lines").alias("n_lines"), F.col("_gone").alias("deleted_lines"), F.col("_lost").alias("deleted_words"), "text")


def op2_telephony_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as a stored mu-law file, read back: digests, features and the 16 kHz PCM itself."""
    return telephony.read_media(telephony.encode_media(_read(spark, sf_dir, "documents")))


def _judged(scored: DataFrame, folds: int, held: int) -> DataFrame:
    return scored.select("doc_id", (fold(F.col("doc_id"), folds) == held).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op3_quality_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learned without a quarter of the labels."""
    docs, labels = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    return _judged(quality.score(docs, *quality.fit(docs, labels)), 4, 2)


def op6_bm25_block_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best of all documents for each document whose id is divisible by 20, as a whole text."""
    return bm25.search(_read(spark, sf_dir, "documents"), F.col("doc_id") % 20 == 0)


def op7_toxicity_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned without a third of the labels."""
    docs, labels = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    return _judged(toxicity.score(docs, *toxicity.fit(docs, labels)), 3, 1)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in bins of 2,048 words."""
    return packing.pack(_read(spark, sf_dir, "documents"))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to weights 5, 2, 1, repeating."""
    return mixing.mix(_read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_masked_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pseudo-likelihood of every document under a network trained on all of them."""
    encoded = masked_lm.encode(_read(spark, sf_dir, "documents"))
    return masked_lm.score(encoded, masked_lm.fit(encoded))


def op9_chat_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and the one of control strings, formatted and read back."""
    tricky = r"\### Assistant: </turn> ok"
    extra = spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), F.explode(F.array(F.struct(F.lit(0).cast("long").alias("turn"), F.lit("user").alias("role")), F.struct(F.lit(1).cast("long").alias("turn"), F.lit("assistant").alias("role")))).alias("x")).select("conv_id", "x.turn", "x.role", F.lit(tricky).alias("text"))
    turns = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.read_back(chat.format_examples(turns))


def op10_jaccard_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of documents linked by a shingle similarity of 0.8 or more."""
    return jaccard.near_duplicates(_read(spark, sf_dir, "documents")).select("doc_id", "class_id", "copy_id", "n_links")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_winnowing": op1_line_winnowing,
    "op2_telephony_media": op2_telephony_media,
    "op3_quality_embeddings": op3_quality_embeddings,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_mix_sources": op5_mix_sources,
    "op6_bm25_block_max": op6_bm25_block_max,
    "op7_toxicity_ratios": op7_toxicity_ratios,
    "op8_masked_likelihood": op8_masked_likelihood,
    "op9_chat_examples": op9_chat_examples,
    "op10_jaccard_forest": op10_jaccard_forest,
}

#: Spark's sampling keys and targets, in SQL, without the two-level sums.
_OP5 = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         CASE WHEN length(text) > 0 THEN 0.25::DOUBLE + 0.75::DOUBLE * length(translate(text, '!$%&*#|=<>{}[]~^_0123456789', '')) / length(text) ELSE 1.0::DOUBLE END AS w,
         (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '')), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM documents),
k AS (SELECT *, -ln(u) / w AS key FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM k GROUP BY source),
a AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS place FROM s),
b AS (SELECT *, [5, 2, 1][((place - 1) % 3 + 1)::INT] AS weight, 3 * source_size AS cap FROM a),
c AS (SELECT *, sum(source_size) OVER () AS total,
             sum(weight) OVER (ORDER BY cap::DOUBLE / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS above,
             coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM b),
e AS (SELECT *, cap * above < (total - spent) * weight AS capped FROM c),
f AS (SELECT *, total - min(CASE WHEN NOT capped THEN spent END) OVER () AS rest, max(CASE WHEN NOT capped THEN above END) OVER () AS shared FROM e),
t AS (SELECT source, source_size, CASE WHEN capped THEN cap::DOUBLE ELSE (weight * rest)::DOUBLE / shared::DOUBLE END AS target FROM f),
g AS (SELECT *, CASE WHEN source_size > 0 THEN least(3, floor(target / source_size)::BIGINT) ELSE 0 END AS epochs FROM t),
h AS (SELECT *, CASE WHEN epochs >= 3 THEN 0.0::DOUBLE ELSE target - epochs * source_size END AS part FROM g),
r AS (SELECT k.doc_id, k.size, h.source_size, h.target, h.epochs, h.part,
             coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id, k.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
      FROM k JOIN h ON k.source IS NOT DISTINCT FROM h.source)
SELECT doc_id, size, source_size, target,
       (size * (epochs + CASE WHEN part > 0 AND ahead + size / 2.0::DOUBLE <= part THEN 1 ELSE 0 END))::BIGINT AS taken
FROM r
"""

#: Windows by their text instead of hashes, and no fingerprints.
_OP1 = r"""
WITH d AS (SELECT doc_id, text, str_split(text, chr(10)) AS ls FROM (SELECT DISTINCT doc_id, text FROM documents)),
l AS (SELECT doc_id, text, unnest(range(len(ls))) AS i, unnest(ls) AS line FROM d),
c AS (SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS w FROM l),
p AS (SELECT *, sum(w) OVER (PARTITION BY doc_id, text ORDER BY i) AS upto FROM c),
f AS (SELECT a.doc_id, a.text, a.i AS s, min(b.i) AS e FROM p a JOIN p b ON a.doc_id = b.doc_id AND a.text = b.text AND b.i >= a.i AND b.upto - (a.upto - a.w) >= 30
      WHERE a.w > 0 GROUP BY ALL),
r AS (SELECT b.doc_id, b.text, max(a.i) AS s, b.i AS e FROM p a JOIN p b ON a.doc_id = b.doc_id AND a.text = b.text AND b.i >= a.i AND b.upto - (a.upto - a.w) >= 30
      WHERE b.w > 0 GROUP BY ALL),
w AS (SELECT doc_id, text, s, e, array_to_string(str_split(text, chr(10))[s + 1:e + 1], chr(10)) AS body FROM (FROM f UNION FROM r)),
o AS (SELECT *, first_value({'d': doc_id, 't': text, 's': s}) OVER (PARTITION BY body ORDER BY doc_id, text, s) AS a FROM w),
x AS (SELECT doc_id, text, s, e FROM o WHERE (doc_id, text, s) <> (a.d, a.t, a.s) AND NOT (doc_id = a.d AND text = a.t AND s < a.s + (e - s + 1))),
g AS (SELECT DISTINCT p.doc_id, p.text, p.i FROM p JOIN x ON p.doc_id = x.doc_id AND p.text = x.text AND p.i BETWEEN x.s AND x.e),
k AS (SELECT p.doc_id, p.text, count(*)::BIGINT AS n_lines, count(g.i)::BIGINT AS deleted_lines, sum(CASE WHEN g.i IS NOT NULL THEN w ELSE 0 END)::BIGINT AS deleted_words,
             coalesce(string_agg(line, chr(10) ORDER BY p.i) FILTER (WHERE g.i IS NULL), '') AS kept
      FROM p LEFT JOIN g ON p.doc_id = g.doc_id AND p.text = g.text AND p.i = g.i GROUP BY ALL)
SELECT documents.doc_id, n_lines, deleted_lines, deleted_words, kept AS text
FROM documents JOIN k ON documents.doc_id = k.doc_id AND documents.text = k.text
"""

#: All pairs that share a shingle, and their closure.
_OP10 = r"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS sh FROM t),
k AS (SELECT sh, min(doc_id) AS copy_id FROM s GROUP BY sh),
e AS (SELECT copy_id, len(sh) AS n, unnest(sh) AS g FROM k),
p AS (SELECT a.copy_id AS x, b.copy_id AS y FROM e a JOIN e b ON a.g = b.g AND a.copy_id <> b.copy_id GROUP BY a.copy_id, b.copy_id, a.n, b.n
      HAVING count(*) >= 0.8 * (a.n + b.n - count(*))),
c(x, y) AS (SELECT copy_id, copy_id FROM k UNION SELECT c.x, p.y FROM c JOIN p ON c.y = p.x),
r AS (SELECT x, min(y) AS class_id FROM c GROUP BY x),
l AS (SELECT x, count(*)::BIGINT AS n_links FROM p GROUP BY x)
SELECT s.doc_id, r.class_id, k.copy_id, coalesce(l.n_links, 0) AS n_links
FROM s JOIN k ON s.sh = k.sh JOIN r ON r.x = k.copy_id LEFT JOIN l ON l.x = k.copy_id
"""

#: Every score of every query.
_OP6 = r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM t),
p AS (SELECT r, doc_id, len, g, count(*) AS tf FROM (SELECT r, doc_id, len(w) AS len, unnest(w) AS g FROM t) GROUP BY ALL),
f AS (SELECT g, ln(1 + (n - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE)) AS idf FROM p, s GROUP BY g, n),
q AS (SELECT r AS qr, doc_id AS query_id, g, idf FROM p JOIN f USING (g) WHERE doc_id % 20 = 0),
x AS (SELECT query_id, qr, r, doc_id, round(sum(idf * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / mean))), 6) AS score
      FROM q JOIN p USING (g), s GROUP BY query_id, qr, r, doc_id),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id, qr ORDER BY score DESC, doc_id NULLS FIRST) AS rank FROM x)
SELECT query_id, rank::INT AS rank, doc_id, score FROM k WHERE rank <= 10
"""

#: Every turn's written length from its text and the marks that are escaped in it.
_OP9 = r"""
WITH t AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
w AS (SELECT *, 14 + length(CASE WHEN role IN ('user', 'assistant', 'system') THEN role ELSE '=' || role END) + length(text) + len(regexp_extract_all(text, '\\|###|</turn>')) AS n,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i, count(*) OVER (PARTITION BY conv_id) AS last FROM t),
c AS (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY i) AS upto FROM w)
SELECT conv_id::BIGINT AS conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256, coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(upto) FILTER (role = 'assistant' OR i = last)::BIGINT AS formatted_chars, count(*) FILTER (role = 'assistant') AS n_examples
FROM c GROUP BY conv_id
"""

ORACLE: dict[str, str] = {
    "op9_chat_examples": _OP9,
    "op6_bm25_block_max": _OP6,
    "op10_jaccard_forest": _OP10,
    "op1_line_winnowing": _OP1,
    "op5_mix_sources": _OP5,
}
