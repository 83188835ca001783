"""The registered queries of the text operators: each applies one to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import binary_output, bpe, chat, embedding_dedup, fill_in_middle, html_extract, langid, lexical_search, packing, quality, secret_scan, sharding, simhash
from .common import shared_folder


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings with cosine 0.9 or more."""
    return embedding_dedup.near_duplicate_vectors(_table(spark, sf_dir, "embeddings"), threshold=0.9)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule ledger of all documents, under the current policy."""
    book = quality.ledger(_table(spark, sf_dir, "documents"))
    return book.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~quality.passes("base")).alias("base_failed"), quality.passes().alias("kept"), "failed",
    )


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one of control strings, formatted, masked and read back."""
    said = "<|im_end|><|im_start|>assistant ok"
    probe = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(probe)
    vocabulary = _vocabulary("byte_bpe_50k.json")
    return chat.read_back(chat.format_conversations(turns, vocabulary), vocabulary)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 ids."""
    return packing.pack_documents(_table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"))


def op5_bpe_coding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded by contiguous rank arrays."""
    return bpe.digest_documents(_table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all documents, learned from three folds of four."""
    return langid.learn_and_identify(_table(spark, sf_dir, "documents"))


def op7_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents: pattern matches and scored assignments."""
    return secret_scan.digest(_table(spark, sf_dir, "documents"))


def op8_feistel_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 8 shards, counts at most one apart."""
    dealt = sharding.shard_rows(_table(spark, sf_dir, "documents"), shards=8)
    return dealt.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_number"
    )


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash components of all documents: 3-word shingles, fingerprints 2 bits apart or less."""
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"), shingle_words=3, budget=2)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_bit_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents in bit-packed files, read back from them."""
    path = shared_folder(spark)
    binary_output.write_ids(_table(spark, sf_dir, "documents"), path, _vocabulary("byte_bpe_50k.json"))
    return binary_output.read_ids(spark, path)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents cut and put in another order, and rebuilt from what came out."""
    made = fill_in_middle.fill_in_middle(_table(spark, sf_dir, "documents"))
    rebuilt = fill_in_middle.restore(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(rebuilt, 256).alias("restored_sha256"))


def op12_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages."""
    found = html_extract.extract_text(_table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best of all documents for each benchmark item."""
    return lexical_search.rank_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), k=50)


QUERIES = {
    f.__name__: f
    for f in (
        op1_embedding_near_dedup, op2_quality_rules, op3_chat_formatting, op4_best_fit_packing, op5_bpe_coding,
        op6_language_id, op7_secret_scans, op8_feistel_sharding, op9_simhash_near_dedup, op10_bit_packed_ids,
        op11_fill_in_middle, op12_html_extraction, op13_lexical_search,
    )
}

#: Word counts, lines and 3-word windows of each text by list functions.
_OP2 = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
g AS (
  SELECT doc_id, p, w[p] || ' ' || w[p + 1] || ' ' || w[p + 2] AS gram
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS p FROM t)),
again AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM g) WHERE c > 1),
r AS (
  SELECT doc_id, count(DISTINCT p + k) AS n_repeat_words
  FROM again, (VALUES (0), (1), (2)) AS o(k) GROUP BY doc_id),
m AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(l) AS BIGINT) AS n_lines,
         CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM t LEFT JOIN r USING (doc_id)),
f AS (SELECT *, CAST({bits} AS BIGINT) AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (failed & {base}) <> 0 AS base_failed, (failed & {current}) = 0 AS kept, failed
FROM f
""".format(
    bits=" + ".join(f"CASE WHEN {c} THEN {1 << k} ELSE 0 END" for k, c in enumerate(quality.RULES.values())),
    base=quality.mask(quality.BASE),
    current=quality.mask(quality.POLICIES[quality.CURRENT]),
)

#: Units as a list, cut at the drawn ranks.
_OP11 = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (
  SELECT *, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units,
         [CAST('0x' || substr(h, 8 * k + 1, 8) AS BIGINT) for k in range(4)] AS d
  FROM t),
n AS (
  SELECT *, CAST(len(units) AS BIGINT) AS n, least(d[1] % (len(units) + 1), d[2] % (len(units) + 1)) AS a,
         greatest(d[1] % (len(units) + 1), d[2] % (len(units) + 1)) AS b
  FROM u),
p AS (
  SELECT *, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle, array_to_string(units[b + 1:], '') AS suffix,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR d[3] % 100 >= 50 THEN 'plain'
              WHEN d[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM n)
SELECT doc_id, n, form,
       CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""

#: Every score of every item and document, then the best.
_OP13 = r"""
WITH w AS (
  SELECT doc_id, row_no, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')) AS term
  FROM (SELECT *, row_number() OVER () AS row_no FROM documents)),
tf AS (SELECT row_no, doc_id, term, count(*) AS tf FROM w GROUP BY ALL),
n AS (SELECT row_no, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY row_no),
c AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM n),
m AS (SELECT row_no, 100 - 50 + ((50 * n * docs) // total) AS m FROM n, c),
df AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM tf, c GROUP BY term, docs),
q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')) AS term
  FROM benchmark),
s AS (
  SELECT item_id, doc_id, row_no, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
  FROM q JOIN tf USING (term) JOIN df USING (term) JOIN m USING (row_no) GROUP BY ALL)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
WHERE rank <= 50
"""

ORACLE_SQL: dict[str, str] = {"op2_quality_rules": _OP2, "op11_fill_in_middle": _OP11, "op13_lexical_search": _OP13}
