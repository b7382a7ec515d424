"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op5_token_counts(spark: SparkSession, sf_dir: str, tokenizer: str = "byte_bpe_50k.json") -> DataFrame:
    from .token_counts import token_counts

    return token_counts(_documents(spark, sf_dir), _tokenizer(tokenizer))


def op8_byte_bpe(spark: SparkSession, sf_dir: str, ranks: str = "byte_bpe_multi_50k.tiktoken") -> DataFrame:
    from .byte_bpe import decode, encode

    path = _tokenizer(ranks)
    return decode(encode(_documents(spark, sf_dir), path), path).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_dedup

    return exact_dedup(_documents(spark, sf_dir)).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality_rules

    q = "quality."
    return quality_rules(_documents(spark, sf_dir), with_text=False).select(
        "doc_id", q + "n_words", q + "word_chars", q + "n_symbols", q + "n_dup_lines", q + "n_repeat_words", q + "base_failed", q + "kept", q + "n_removed_lines", q + "n_removed_words"
    )


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import packed

    return packed(_documents(spark, sf_dir))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license_scan import TEMPLATES, license_scan, strength

    strengths = F.create_map(*(F.lit(x) for label in TEMPLATES for x in (label, strength(label))))
    base, found = F.col("base"), F.col("matches")
    joined = lambda x: F.array_join(F.sort_array(F.array_distinct(x)), ",")
    return license_scan(_documents(spark, sf_dir)).select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(base["first_word"]).alias("first_word"),
        F.array_max(base["first_word"]).alias("last_word"),
        joined(base["label"]).alias("base_labels"),
        joined(F.concat(base["label"], found["label"])).alias("labels"),
        F.greatest(F.coalesce(F.array_max(F.transform(found["label"], lambda x: strengths[x])), F.lit(0.0)), F.when(F.size(base) > 0, 0.5).otherwise(0.0)).alias("score"),
    )


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import held_out, identify, train

    docs = _documents(spark, sf_dir)
    model = train(docs.filter(~held_out(F.col("doc_id"))))
    return identify(docs, model, spans=False).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import ngram_jaccard_join

    return ngram_jaccard_join(_documents(spark, sf_dir))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import substring_dedup

    return substring_dedup(_documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import suffix_dedup

    length = F.aggregate("removed", F.lit(0).cast("long"), lambda n, r: n + r["last"] - r["first"] + 1)
    return suffix_dedup(_documents(spark, sf_dir)).select("doc_id", "n_bytes", length.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op11_token_alignment(spark: SparkSession, sf_dir: str, a: str = "byte_bpe_50k.json", b: str = "piece_bpe_32k.model") -> DataFrame:
    from .token_alignment import token_alignment

    return token_alignment(_documents(spark, sf_dir), _tokenizer(a), _tokenizer(b))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .whitening import whitened_components

    return whitened_components(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import decontaminate

    return decontaminate(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def queries() -> dict:
    return {k: v for k, v in globals().items() if k[:2] == "op" and k[2:3].isdigit()}


_ASCII_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP6_SQL = f"""
WITH t AS (SELECT doc_id, {_ASCII_LOWER} AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
FROM t
"""

OP7_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text, ('0x' || substr(sha256(coalesce(text, '')), 1, 15))::BIGINT AS digest,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
lines AS (
  SELECT doc_id, digest, host, pos, line,
         trim(regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g')) AS norm
  FROM (SELECT doc_id, digest, host, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM t)),
over_limit AS (SELECT host, norm, min(digest) AS first FROM lines GROUP BY host, norm HAVING count(DISTINCT digest) > 100),
removed AS (
  SELECT doc_id, digest, count(*) AS n_lines, sum(n) AS n_words
  FROM (SELECT DISTINCT l.doc_id, l.digest, l.pos, len(regexp_extract_all(l.line, '[^\x20\x09-\x0D]+')) AS n
        FROM lines l JOIN over_limit o ON l.host = o.host AND l.norm = o.norm
        WHERE l.digest <> o.first AND regexp_matches(l.line, '[^\x20\x09-\x0D]'))
  GROUP BY doc_id, digest),
dup_lines AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
grams AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 1))) AS i FROM t)),
covered AS (
  SELECT doc_id, sum(least(3, coalesce(i - before, 3))) AS n_repeat_words
  FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before
        FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM grams) WHERE c > 1)
  GROUP BY doc_id),
s AS (
  SELECT t.doc_id, len(t.w)::BIGINT AS n_words, length(array_to_string(t.w, ''))::BIGINT AS word_chars,
         (length(t.text) - length(translate(t.text, '#*$%&|<>', '')))::BIGINT AS n_symbols, coalesce(d.n_dup_lines, 0)::BIGINT AS n_dup_lines,
         coalesce(c.n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(r.n_lines, 0)::BIGINT AS n_removed_lines, coalesce(r.n_words, 0)::BIGINT AS n_removed_words
  FROM t LEFT JOIN dup_lines d USING (doc_id) LEFT JOIN covered c USING (doc_id) LEFT JOIN removed r ON r.doc_id = t.doc_id AND r.digest = t.digest)
SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       (NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * (n_words - n_removed_words) >= 30 * n_words) AS kept
FROM s
"""

OP13_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_ASCII_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_ASCII_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
places AS (
  SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d JOIN (SELECT DISTINCT n FROM windows) ON n <= len(w))),
found AS (SELECT doc_id, i, n, item_id FROM places JOIN windows USING (n, g)),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM found)) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM found WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN named USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op6_exact_dedup": OP6_SQL, "op7_quality_rules": OP7_SQL, "op13_decontaminate": OP13_SQL}
