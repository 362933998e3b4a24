"""One query per operator, over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession

from pyspark.sql import functions as F

from . import (
    bpe, chat, exact_dedup, fingerprints, html_extract, langid, lexical_search, line_dedup, mixing, ngram_join, quality, token_align, url_filter)
from .registry import QUERIES, SQL, query, table  # noqa: F401

LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query(f"""
WITH d AS (SELECT doc_id, sha256({LOWERED}) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
""")
def op1_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return exact_dedup.resolve(table(spark, sf, "documents"))


@query()
def op2_document_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    return fingerprints.compare_edited(table(spark, sf, "documents")).select(
        "doc_id", "n_chars", "edited_sha256", fingerprints.encoded(F.col("sketch")).alias("fingerprint"),
        fingerprints.encoded(F.col("edited_sketch")).alias("edited_fingerprint"), "near_edited", "near_next", "jaccard_edited")


@query()
def op4_mixing_sources(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mixture(table(spark, sf, "documents"))


def escaped(text: str) -> str:
    return rf"regexp_replace({text}, '<(\\*)\|', '<\\\1|', 'g')"


@query(rf"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(24 + length(role) + length({escaped('text')}))::BIGINT AS formatted_chars
FROM turns GROUP BY conv_id
""")
def op5_chat_formatting(spark: SparkSession, sf: str) -> DataFrame:
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    control = f"{chat.END}{chat.START}assistant ok"
    extra = spark.createDataFrame([(-1, 0, "user", control), (-1, 1, "assistant", control)], turns.schema)
    return chat.read_back(chat.format_conversations(chat.chained(turns.unionByName(extra))))


@query(f"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                  generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT *, length(key) >= 10 AND doc_id > min(doc_id) OVER (PARTITION BY key) AS gone FROM k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM f GROUP BY doc_id
""")
def op8_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return line_dedup.drop_repeated(table(spark, sf, "documents")).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def remainder(n: int) -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(n))


@query()
def op6_language_id(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "lang", "text", F.coalesce(remainder(5) == 0, F.lit(False)).alias("held_out"))
    prototypes = langid.learn(docs.where(remainder(5) != 0))
    return langid.predict(docs.select("doc_id", "held_out", "text"), prototypes)


def quality_trees(spark: SparkSession, docs: DataFrame, sf: str) -> quality.Trees:
    """Trees fitted to the labels outside the held-out fold, on texts of ``docs``."""
    labels = table(spark, sf, "labels").where(remainder(4) != 2).select("doc_id", F.col("quality").alias("label"))
    return quality.teach(docs, labels)


@query()
def op7_quality_classifier(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text", F.coalesce(remainder(4) == 2, F.lit(False)).alias("held_out"))
    scored = quality.score(docs, quality_trees(spark, docs, sf))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@query()
def op9_byte_bpe(spark: SparkSession, sf: str, vocabulary: str = VOCABULARY) -> DataFrame:
    ranks = bpe.load_ranks(vocabulary)
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return bpe.encode(docs, ranks, public_tokenizers.PATTERN, reader=bpe.digester(spark, ranks))


@query()
def op10_html_extraction(spark: SparkSession, sf: str) -> DataFrame:
    return html_extract.extract(table(spark, sf, "pages"))


@query()
def op3_ngram_jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    return ngram_join.resolve(table(spark, sf, "documents"))


A_VOCABULARY, B_VOCABULARY = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@query()
def op11_token_alignment(spark: SparkSession, sf: str, a_path: str = A_VOCABULARY, b_path: str = B_VOCABULARY) -> DataFrame:
    models = token_align.Tokenizers.load(a_path, b_path)
    return token_align.score(token_align.align(table(spark, sf, "documents"), models), token_align.Sizes.of(models))


RUNS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def run_terms(text: str) -> str:
    return f"regexp_extract_all(translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{RUNS}')"


@query(f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {run_terms('text')} AS terms FROM documents),
s AS (SELECT count(*) AS n_docs, sum(len(terms))::BIGINT AS n_terms FROM d WHERE len(terms) > 0),
i AS (SELECT k, item_id, unnest(list_distinct({run_terms('text')})) AS term FROM (SELECT row_number() OVER () AS k, * FROM benchmark)),
t AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(terms) AS n, unnest(terms) AS term FROM d)
      WHERE term IN (SELECT term FROM i) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
      FROM t, s GROUP BY term, n_docs),
p AS (SELECT r, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms))) AS points
      FROM t JOIN w USING (term), s),
f AS (SELECT k, item_id, doc_id, sum(points)::BIGINT AS score FROM i JOIN p USING (term) GROUP BY k, item_id, r, doc_id)
SELECT item_id, rank::INTEGER AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY score DESC, doc_id) AS rank FROM f WHERE score > 0) WHERE rank <= 10
""")
def op12_lexical_search(spark: SparkSession, sf: str) -> DataFrame:
    return lexical_search.rank(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


# The rules that the query is given.
URL_RULES = [
    url_filter.Rule("allow", "com"),
    url_filter.Rule("block", "example.com", "/en/"),
    url_filter.Rule("allow", "www.example.com", "/en/"),
    url_filter.Rule("block", "net", "/es/"),
    url_filter.Rule("block", "net", "/fr/"),
]


@query()
def op13_url_filters(spark: SparkSession, sf: str) -> DataFrame:
    """The last number in a page's path is the doc_id of its article, by which ``labels`` tells what is known of a URL: block if its
    quality is 0 or it is toxic, else allow."""
    pages = table(spark, sf, "pages").select("page_id", "url")
    number = F.regexp_extract(url_filter.path_of(F.col("url")), r"([0-9]{1,18})[^0-9/]*/?$", 1).try_cast("long")
    bad = (F.col("quality") == 0) | (F.coalesce("toxic", F.lit(0)) == 1)
    labels = table(spark, sf, "labels").select("doc_id", F.when(bad, url_filter.BLOCK).when(F.col("quality") == 1, url_filter.ALLOW).alias("label"))
    labelled = pages.select("url", number.alias("doc_id")).where(F.col("doc_id").isNotNull()).join(labels, "doc_id")
    return url_filter.judge(pages, URL_RULES, url_filter.mine(labelled)).select("page_id", "host", "path", "rule", "verdict", "mined")
