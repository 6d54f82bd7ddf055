"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oligoloom.llm.audit import audit_filters
from oligoloom.llm.automaton import score_texts
from oligoloom.llm.cotrain import fit_model, score_documents
from oligoloom.llm.decontaminate import contamination
from oligoloom.llm.forest import near_duplicates
from oligoloom.llm.huffman import read_token_file, write_token_file
from oligoloom.llm.packing import pack
from oligoloom.llm.ring import shard_documents
from oligoloom.llm.surrogates import replace_entities
from oligoloom.llm.tables import scratch_path, stored
from oligoloom.llm.topk import top_k
from oligoloom.llm.urlrules import judge_urls
from oligoloom.llm.variants import spelling_variants
from oligoloom.llm.warc import assemble, page_records, read_archive, write_archive

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


@query
def op1_huffman_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents, written to a Huffman-coded file and read back from it."""
    path = scratch_path(spark, "token-file")
    write_token_file(table(spark, sf_dir, "documents"), path, tokenizer_path(), end_id=2)
    return read_token_file(spark, path).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32")
    )


@query
def op6_swap_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens."""
    return pack(table(spark, sf_dir, "documents"), tokenizer_path(), end_id=0, capacity=2048)


@query
def op4_window_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words inside ten-word windows of the benchmark."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = contamination(docs, table(spark, sf_dir, "benchmark"), length=10)
    return found.select(
        "doc_id",
        "contamination.n_words",
        "contamination.n_hit",
        F.size("contamination.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("contamination.items", ","), 256).alias("items_sha256"),
        (F.col("contamination.n_hit") > 0).alias("contaminated"),
    )


_WORDS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),"
    r" '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)

ORACLE_SQL["op4_window_decontamination"] = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
item_windows AS (
    SELECT DISTINCT item_id, n, window_text FROM (
        SELECT item_id, least(len(w), 10) AS n,
               unnest(list_transform(range(1, len(w) - least(len(w), 10) + 2),
                                     lambda i: array_to_string(w[i:i + least(len(w), 10) - 1], ' '))) AS window_text
        FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM item_windows),
doc_windows AS (
    SELECT doc_id, n, pos, array_to_string(w[pos:pos + n - 1], ' ') AS window_text
    FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS pos FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT doc_id, item_id, n, pos FROM doc_windows JOIN item_windows USING (n, window_text)),
hit_words AS (
    SELECT doc_id, count(DISTINCT word) AS n_hit
    FROM (SELECT doc_id, unnest(range(pos, pos + n)) AS word FROM hits) GROUP BY doc_id),
hit_items AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed
    FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
       coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(listed, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""


@query
def op9_backoff_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probabilities of all documents under a model of four fifths of them."""
    return score_texts(table(spark, sf_dir, "documents"))


@query
def op8_lsh_forest_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class and number of links of every document."""
    return near_duplicates(table(spark, sf_dir, "documents"))


@query
def op2_bounded_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards whose row counts are at most one apart."""
    return shard_documents(table(spark, sf_dir, "documents"), shards=24).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query
def op3_sorted_list_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest embeddings by inner product for every twentieth one."""
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20, scale=64.0)


ORACLE_SQL["op3_sorted_list_topk"] = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
    SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
    FROM v q JOIN v c ON len(q.v) = len(c.v) AND q.vec_id <> c.vec_id
    WHERE q.vec_id % 20 = 0),
ranked AS (
    SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank,
           vec_id, score
    FROM scores)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""

URL_RULES = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]


@query
def op10_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url judged by the longest rule that fits it."""
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return judge_urls(table(spark, sf_dir, "pages"), rules)


ORACLE_SQL["op10_url_rules"] = r"""
WITH rules(rule_host, rule_path, verdict) AS (
    VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'),
           ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
urls AS (
    SELECT page_id,
           translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''),
                     'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
    FROM pages),
fitting AS (
    SELECT page_id, rule_host || rule_path AS rule, verdict,
           row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host) DESC, length(rule_path) DESC) AS n
    FROM urls JOIN rules
      ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM urls LEFT JOIN (SELECT * FROM fitting WHERE n = 1) USING (page_id)
"""


# The key of the surrogates; a deployment passes its own secret.
SURROGATE_SECRET = "demonstration key"


@query
def op5_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with personal data replaced by surrogates."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return replace_entities(docs, SURROGATE_SECRET)


@query
def op7_cotrained_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores and decisions for all documents."""
    docs = table(spark, sf_dir, "documents")
    model = fit_model(docs, table(spark, sf_dir, "labels"))
    return score_documents(docs, model).select("doc_id", "quality.text", "quality.page", "quality.score", "quality.keep")


@query
def op11_permuterm_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vocabulary of all documents with the form that each word is a misprint of."""
    return spelling_variants(table(spark, sf_dir, "documents"))


ORACLE_SQL["op11_permuterm_variants"] = r"""
WITH RECURSIVE crc_table AS (
    SELECT list(list_reduce(range(0, 8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END,
                            i) ORDER BY i) AS t
    FROM range(256) r(i)),
runs AS (
    SELECT doc_id, run, count(*) AS n FROM (
        SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                                           'abcdefghijklmnopqrstuvwxyz'),
                                                 '[a-z\x{C0}-\x{FF}]+')) AS run
        FROM documents)
    GROUP BY doc_id, run),
hashed AS (
    SELECT run, n,
           xor(list_reduce(
               list_transform(range(1, 2 * octet_length(key) + 1, 2),
                              lambda i: ('0x' || substr(hex(key), i, 2))::BIGINT),
               lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) AS h
    FROM (SELECT run, n, encode(coalesce(doc_id::VARCHAR, '') || ':' || run) AS key FROM runs), crc_table),
words AS (
    SELECT word, sum(n)::BIGINT AS n FROM (
        SELECT CASE WHEN h % 97 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2)
                    ELSE run END AS word, n
        FROM hashed)
    WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
shortened AS (
    SELECT word, n, pos, left(word, pos - 1) || substr(word, pos + 1) AS rest
    FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS pos FROM words)),
near AS (
    SELECT a.word, b.word AS other, b.n AS other_n FROM shortened a JOIN shortened b USING (pos, rest)
    WHERE a.word <> b.word
    UNION
    SELECT a.word, b.word, b.n FROM shortened a JOIN words b ON a.rest = b.word
    UNION
    SELECT b.word, a.word, a.n FROM shortened a JOIN words b ON a.rest = b.word),
best AS (
    SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, encode(other)) AS other, max(other_n) AS other_n
    FROM near GROUP BY word),
forms AS (
    SELECT word, n, coalesce(n_near, 0)::BIGINT AS n_near,
           CASE WHEN other_n >= 2 * n THEN other END AS form, CASE WHEN other_n >= 2 * n THEN other_n END AS form_n
    FROM words LEFT JOIN best USING (word)),
chains AS (
    SELECT word, word AS root, 0 AS steps FROM forms
    UNION ALL
    SELECT c.word, f.form, steps + 1 FROM chains c JOIN forms f ON c.root = f.word WHERE f.form IS NOT NULL)
SELECT word, form, arg_max(chains.root, steps) AS root, n, n_near, form_n
FROM forms JOIN chains USING (word) GROUP BY word, form, n, n_near, form_n
"""


@query
def op12_filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove from each source, in every order."""
    return audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLE_SQL["op12_filter_interactions"] = r"""
WITH RECURSIVE d AS (
    SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
           regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
    FROM documents),
originals AS (SELECT text, min(doc_id) AS first_id FROM d GROUP BY text),
marks AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id),
masks AS (
    SELECT part,
           (len(w) < 50)::INT + 2 * (100 * len(list_distinct(w)) < 65 * len(w))::INT
           + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text))::INT
           + 8 * (regexp_matches(text, '[#$%&*|]'))::INT + 16 * coalesce(doc_id > first_id, false)::INT AS mask,
           coalesce(quality, 0) = 1 AS good, coalesce(toxic, 0) = 1 AS bad
    FROM d JOIN originals USING (text) LEFT JOIN marks USING (doc_id)),
cells AS (
    SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (bad) AS toxic
    FROM masks GROUP BY part, mask),
letters(letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
orders(filter_order) AS (
    SELECT '' UNION ALL
    SELECT filter_order || letter FROM orders JOIN letters ON NOT contains(filter_order, letter)),
places AS (
    SELECT filter_order, step, l.bit,
           coalesce((SELECT sum(e.bit) FROM letters e WHERE contains(left(filter_order, step - 1), e.letter)), 0)::INT
               AS before
    FROM (SELECT filter_order, unnest(range(1, 6)) AS step FROM orders WHERE length(filter_order) = 5) o
    JOIN letters l ON l.letter = substr(filter_order, step, 1)),
metrics AS (
    SELECT part, filter_order, step, bit,
           coalesce(sum(n) FILTER (mask & (before | bit) = 0), 0) AS kept,
           coalesce(sum(n) FILTER (mask & before = 0 AND mask & bit <> 0), 0) AS removed,
           coalesce(sum(n) FILTER (mask & before <> 0 AND mask & bit <> 0), 0) AS redundant,
           coalesce(sum(n) FILTER (mask = bit), 0) AS unique_fails,
           coalesce(sum(good) FILTER (mask & before = 0 AND mask & bit <> 0), 0) AS good_lost,
           coalesce(sum(toxic) FILTER (mask & before = 0 AND mask & bit <> 0), 0) AS toxic_lost
    FROM cells CROSS JOIN places GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed,
       redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost,
       toxic_lost::BIGINT AS toxic_lost, sum(removed) OVER (PARTITION BY part, bit)::BIGINT AS shapley,
       substr(filter_order, step, 1) AS filter
FROM metrics
"""


@query
def op13_warc_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to WARC archives, read back and put together by capture."""
    path = scratch_path(spark, "warc")
    write_archive(table(spark, sf_dir, "pages"), path)
    records = stored(read_archive(spark, path, payloads=False), "warc-records")
    return page_records(assemble(records))


ORACLE_SQL["op13_warc_captures"] = """
WITH p AS (
    SELECT page_id, url, sha1(coalesce(html, '')) AS h, strlen(coalesce(html, ''))::BIGINT AS payload_bytes FROM pages),
d AS (
    SELECT page_id, url, payload_bytes, min(page_id) OVER (PARTITION BY h) AS first_id,
           translate(to_base(('0x' || h[1:10])::BIGINT, 32, 8) || to_base(('0x' || h[11:20])::BIGINT, 32, 8)
                     || to_base(('0x' || h[21:30])::BIGINT, 32, 8) || to_base(('0x' || h[31:40])::BIGINT, 32, 8),
                     '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest
    FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to, url
FROM d
"""
