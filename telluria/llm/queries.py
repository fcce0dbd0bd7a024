"""The numbered queries on the given tables, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telluria.llm.chat import conversation_digests, prefix_examples
from telluria.llm.decontaminate import decontaminate
from telluria.llm.hard_negatives import hard_negatives
from telluria.llm.html_text import visible_text
from telluria.llm.licenses import scan_licenses
from telluria.llm.ngram_join import jaccard_components
from telluria.llm.ngram_links import jaccard_links
from telluria.llm.packing import pack_documents
from telluria.llm.quality import quality
from telluria.llm.reversed_search import ranked_search
from telluria.llm.suffix_dedup import remove_earlier_text
from telluria.llm.superkmer import remove_repeated_windows
from telluria.llm.token_counts import count_tokens
from telluria.llm.warc import archive_and_index, find_captures, keys_of, read_records
from telluria.session import scratch_path


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_components(table(spark, folder, "documents"))


def op1_jaccard_links(spark: SparkSession, folder: str) -> DataFrame:
    """The whole join; ``op1_ngram_jaccard`` has the columns of its contract."""
    return jaccard_links(table(spark, folder, "documents"))[1].drop("node")


def op2_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.withColumn("items_sha256", F.sha2(F.concat_ws(",", "items"), 256)).select(
        "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op3_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return scan_licenses(table(spark, folder, "documents")).drop("spans")


def op4_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality(table(spark, folder, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "log_perplexity")


def op5_html_text(spark: SparkSession, folder: str) -> DataFrame:
    return visible_text(table(spark, folder, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op6_warc_index(spark: SparkSession, folder: str) -> DataFrame:
    """Every page is looked up by its url in the index, and its record read."""
    pages = table(spark, folder, "pages")
    archives, index = archive_and_index(pages, scratch_path(spark, "warc"))
    return read_records(spark, archives, find_captures(spark, index, keys_of(pages))).drop("payload", "url")


def tokenizer_path() -> str:
    """The public byte-level vocabulary of the contract."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op7_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack_documents(table(spark, folder, "documents"), tokenizer_path(), keep_ids=False).drop("ids")


def op8_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.createDataFrame(
        [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")],
        "conv_id long, turn long, role string, text string")
    return conversation_digests(prefix_examples(turns.unionByName(planted)))


def op9_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    out = remove_earlier_text(table(spark, folder, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op10_superkmer_dedup(spark: SparkSession, folder: str) -> DataFrame:
    out = remove_repeated_windows(table(spark, folder, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept_text", "utf-8"), 256).alias("kept_sha256"))


def op11_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    return hard_negatives(table(spark, folder, "embeddings"))


def op12_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return count_tokens(table(spark, folder, "documents"), tokenizer_path()).select(
        "doc_id", "n_bytes", "n_tokens", "over_limit")


def op13_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    return ranked_search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


QUERIES = {
    "op1_ngram_jaccard": op1_ngram_jaccard,
    "op2_decontamination": op2_decontamination,
    "op3_license_scan": op3_license_scan,
    "op4_quality_rules": op4_quality_rules,
    "op5_html_text": op5_html_text,
    "op6_warc_index": op6_warc_index,
    "op7_packing": op7_packing,
    "op8_chat_format": op8_chat_format,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_superkmer_dedup": op10_superkmer_dedup,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_token_counts": op12_token_counts,
    "op13_ranked_search": op13_ranked_search,
    "op1_jaccard_links": op1_jaccard_links,
}

_LOWER = "translate({t}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "regexp_extract_all(" + _LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

SQL = {
    "op2_decontamination": f"""
WITH d AS (SELECT doc_id, {_WORDS.format(t="coalesce(text, '')")} AS w FROM documents),
b AS (SELECT item_id, {_WORDS.format(t="coalesce(text, '')")} AS w FROM benchmark),
grams AS (SELECT item_id, least(len(w), 13) AS size, unnest(range(0, greatest(len(w) - 12, 1))) AS pos, w FROM b WHERE len(w) > 0),
phrases AS (SELECT DISTINCT item_id, size, array_to_string(w[pos + 1 : pos + size], ' ') AS phrase FROM grams),
sizes AS (SELECT DISTINCT size FROM phrases),
places AS (SELECT doc_id, size, unnest(range(0, len(w) - size + 1)) AS pos, w FROM d, sizes WHERE len(w) >= size),
found AS (SELECT p.doc_id, p.pos, p.size, h.item_id FROM
  (SELECT doc_id, size, pos, array_to_string(w[pos + 1 : pos + size], ' ') AS phrase FROM places) p
  JOIN phrases h ON h.phrase = p.phrase AND h.size = p.size),
hits AS (SELECT doc_id, count(*) AS n_hit FROM
  (SELECT DISTINCT doc_id, unnest(range(pos, pos + size)) AS word FROM found) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM
  (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hits ON hits.doc_id = d.doc_id LEFT JOIN items ON items.doc_id = d.doc_id""",
    "op8_chat_format": r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, length(replace(replace(replace(text, '\', '\0'), '</s>', '\1'), '<s>', '\2')) + length(role) + 8 AS chars,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS no, count(*) OVER (PARTITION BY conv_id) AS n FROM t),
p AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY no) AS upto FROM e)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY no)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY no) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(upto) FILTER (role = 'assistant' OR no = n) AS BIGINT) AS formatted_chars
FROM p GROUP BY conv_id""",
    "op10_superkmer_dedup": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, unnest(range(0, len(w) - 19)) AS pos, w FROM d WHERE len(w) >= 20),
h AS (SELECT doc_id, pos, array_to_string(w[pos + 1 : pos + 20], ' ') AS gram FROM g),
r AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY gram ORDER BY doc_id, pos) AS no FROM h),
gone AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + 20)) AS pos FROM r WHERE no > 1),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(0, len(w))) AS pos FROM d),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY pos) AS text FROM words ANTI JOIN gone
  USING (doc_id, pos) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id""",
    "op1_ngram_jaccard": r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, unnest(range(0, greatest(len(w) - 3, 1))) AS pos, w FROM d WHERE len(w) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(w[pos + 1 : pos + 4], ' ') AS gram FROM g),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS met FROM s x JOIN s y ON x.gram = y.gram AND x.doc_id <> y.doc_id
  GROUP BY 1, 2),
links AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * met >= 85 * (x.n + y.n - met)),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(m.b, d.doc_id)) AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN (SELECT a, min(b) AS b FROM reach GROUP BY a) m ON m.a = d.doc_id""",
    "op6_warc_index": r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT page_id, h, CAST(strlen(html) AS BIGINT) AS payload_bytes, max(page_id) OVER (PARTITION BY html) AS leader FROM p)
SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(((CAST('0x' || substr(h, CAST(5 * (i // 4) + 1 AS BIGINT), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31) + 1 AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN leader = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN leader <> page_id THEN leader END AS refers_to
FROM d""",
    "op11_hard_negatives": """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
a AS (SELECT * FROM v WHERE vec_id % 50 = 0),
s AS (SELECT a.vec_id AS anchor_id, v.vec_id, a.label = v.label AS same, CAST(list_dot_product(a.x, v.x) AS BIGINT) AS score
  FROM a JOIN v ON a.vec_id <> v.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id,
  CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank,
  s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score QUALIFY rank <= 3""",
    "op13_ranked_search": f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS row_no, {_WORDS.format(t="coalesce(text, '')")} AS w FROM documents),
t AS (SELECT doc_id, row_no, len(w) AS n FROM d WHERE len(w) > 0),
total AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM t),
i AS (SELECT DISTINCT item_id, text FROM benchmark),
q AS (SELECT item_id, text, unnest(list_distinct({_WORDS.format(t="coalesce(text, '')")})) AS term FROM i),
c AS (SELECT row_no, term, count(*) AS tf FROM (SELECT row_no, unnest(w) AS term FROM d) JOIN (SELECT DISTINCT term FROM q)
  USING (term) GROUP BY row_no, term),
f AS (SELECT term, count(*) AS df FROM c GROUP BY term),
s AS (SELECT q.item_id, q.text, t.doc_id, t.row_no, CAST(sum(CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) AS BIGINT)
    * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * t.n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM q JOIN f USING (term) JOIN c USING (term) JOIN t USING (row_no), total GROUP BY 1, 2, 3, 4)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id, row_no) AS INTEGER) AS rank,
  doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= 10""",
}
