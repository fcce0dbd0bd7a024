"""Benchmark decontamination over a distributed positional index, with DataFrame
functions only.

Benchmark texts become phrases: all windows of ``window`` consecutive words, or
the whole text where it is shorter.  The training side is indexed by position:
one posting for each place of an indexed term, with the words around it.  Terms
are indexed by need: of each phrase the ``lists`` rarest ones, rarity being the
term's count over all documents, since a phrase can stand only where its rarest
term stands.  Posting lists are shifted by the term's place in the phrase and
intersected on (document, start); what is left is compared word by word.

* Null or empty texts have no words: such documents are never hit, such items
  give no phrases.  A phrase of one repeated term is looked up by that term.
* Each row of documents has a row number of its own, fixed when the index is
  written, so repeated ids give one row each, and null ids are kept.
* Tables made from the benchmark are broadcast up to ``BROADCAST_ROWS`` rows;
  beyond that Spark joins by shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from telluria.llm.text import alnum_words, documents
from telluria.session import BROADCAST_ROWS, materialize


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def benchmark_phrases(benchmark: DataFrame, window: int, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``item, phrase, size``: each window of each item; words are parted by one blank."""
    w, n = F.col("w"), F.size("w")
    return (benchmark.select(F.col(f"`{id_col}`").cast("string").alias("item"), alnum_words(F.col(f"`{text_col}`")).alias("w"))
            .where(n > 0)
            .select("item", "w", F.explode(F.sequence(F.lit(0), F.greatest(n - window, F.lit(0)))).alias("at"))
            .select("item", F.slice(w, F.col("at") + 1, F.lit(window)).alias("w"))
            .select("item", F.concat_ws(" ", "w").alias("phrase"), n.alias("size")).distinct())


def _tokens(words: DataFrame) -> DataFrame:
    """One row a word, with the key by which terms are looked up; word 0 of an
    empty document has a null key."""
    return (words.withColumn("at", F.explode(F.sequence(F.lit(0), F.greatest(F.size("w") - 1, F.lit(0)))))
            .withColumn("word", F.get("w", F.col("at")))
            .withColumn("key", F.when(F.col("word").isNotNull(), F.xxhash64("word"))))


def rarest_terms(words: DataFrame, phrases: DataFrame, lists: int) -> DataFrame:
    """``key, phrase, size, offset, need``: the ``lists`` rarest terms of each
    phrase that can occur, ``need`` of them.  A term counts at its first place."""
    each = (phrases.select("phrase", "size").distinct()
            .select("phrase", "size", F.posexplode(F.split("phrase", " ")).alias("offset", "word"))
            .groupBy("phrase", "size", F.xxhash64("word").alias("key")).agg(F.min("offset").alias("offset")))
    each = materialize(each)
    keys = each.select("key").distinct()
    seen = _tokens(words).select("key").join(_small(keys), "key").groupBy("key").agg(F.count(F.lit(1)).alias("seen"))
    order = Window.partitionBy("phrase").orderBy("seen", "offset")
    counted = each.join(seen, "key", "left").fillna(0, ["seen"])
    return (counted.withColumn("rank", F.row_number().over(order))
            .withColumn("least", F.min("seen").over(Window.partitionBy("phrase")))
            .where((F.col("rank") <= lists) & (F.col("least") > 0))
            .withColumn("need", F.count(F.lit(1)).over(Window.partitionBy("phrase")))
            .select("key", "phrase", "size", "offset", "rank", "need"))


def positional_index(words: DataFrame, terms: DataFrame, window: int) -> DataFrame:
    """Postings ``row_no, doc_id, n_words, key, at, before, around``, written to
    the shared folder.  ``around`` holds up to ``window - 1`` words on each side,
    ``before`` of them in front.  Each document also has a row without key."""
    keys = _small(terms.select("key").distinct().withColumn("wanted", F.lit(True)))
    found = (_tokens(words).join(keys, "key", "left").where("wanted or at = 0")
             .withColumn("before", F.least(F.col("at"), F.lit(window - 1)))
             .select("row_no", "doc_id", F.size("w").alias("n_words"), F.when(F.col("wanted"), F.col("key")).alias("key"),
                     "at", "before", F.when(F.col("wanted"), F.concat_ws(" ", F.slice(
                         "w", F.col("at") - F.col("before") + 1, F.col("before") + window))).alias("around")))
    return materialize(found)


def _stands(offset: Column) -> Column:
    """The words that would be the phrase, were it there."""
    return F.concat_ws(" ", F.slice(F.split("around", " "), F.col("before") - offset + 1, F.col("size")))


def phrase_matches(index: DataFrame, terms: DataFrame) -> DataFrame:
    """Exact occurrences ``row_no, phrase, size, start``."""
    places = (index.where("key is not null").join(_small(terms), "key")
              .withColumn("start", F.col("at") - F.col("offset"))
              .where((F.col("start") >= 0) & (F.col("start") + F.col("size") <= F.col("n_words"))))
    return (places.groupBy("row_no", "phrase", "size", "start")
            .agg(F.count(F.lit(1)).alias("met"), F.max("need").alias("need"),
                 F.min_by(F.struct("before", "offset", "around"), "rank").alias("first"))
            .where("met = need").select("row_no", "phrase", "size", "start", "first.*")
            .where(_stands(F.col("offset")) == F.col("phrase")).select("row_no", "phrase", "size", "start"))


def proximity_matches(index: DataFrame, terms: DataFrame, slop: int) -> DataFrame:
    """Places ``row_no, phrase, start, words_met`` of a phrase's rarest term
    around which its other listed terms stand at most ``slop`` words off their
    place, and all its words stand within a window of it, in any order."""
    t = _small(terms)
    rare = (index.where("key is not null").join(t, "key").where("rank = 1")
            .select("row_no", "phrase", "need", "around", (F.col("at") - F.col("offset")).alias("start")))
    # Shift each list by its offset; bins of slop + 1 starts, met in the same or the next one.
    other = (index.where("key is not null").join(t, "key").where("rank > 1")
             .select("row_no", "phrase", "rank", (F.col("at") - F.col("offset")).alias("there"))
             .withColumn("bin", F.explode(F.array(*[F.floor(F.col("there") / (slop + 1)) + d for d in (-1, 0, 1)]))))
    met = (rare.withColumn("bin", F.floor(F.col("start") / (slop + 1)))
           .join(other, ["row_no", "phrase", "bin"], "left")
           .withColumn("ok", F.abs(F.col("there") - F.col("start")) <= slop)
           .groupBy("row_no", "phrase", "start", "need", "around")
           .agg(F.count_distinct(F.when(F.col("ok"), F.col("rank"))).alias("met")).where("met >= need - 1"))
    asked = F.array_distinct(F.split("phrase", " "))
    return met.where(F.size(F.array_except(asked, F.split("around", " "))) == 0).select(
        "row_no", "phrase", "start", F.size(asked).alias("words_met"))


def decontaminate(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  window: int = 13, lists: int = 2, share: int = 20) -> DataFrame:
    """Per document ``doc_id, n_words, n_hit, n_items, items, contaminated``.

    ``n_hit`` words lie in an occurrence of a phrase; a document is contaminated
    if some do, and at least one in ``share``.
    """
    words = documents(df, id_col, text_col).select(
        "doc_id", F.monotonically_increasing_id().alias("row_no"), alnum_words(F.col("text")).alias("w"))
    phrases = materialize(benchmark_phrases(benchmark, window))
    terms = materialize(rarest_terms(words, phrases, lists))
    index = positional_index(words, terms, window)
    found = materialize(phrase_matches(index, terms))
    order = Window.partitionBy("row_no").orderBy("start", "size")
    reach = F.max(F.col("start") + F.col("size")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.col("start") + F.col("size") - F.greatest("start", F.coalesce("reach", F.lit(0)))
    hit = (found.select("row_no", "start", "size").distinct().withColumn("reach", reach)
           .groupBy("row_no").agg(F.sum(F.greatest(fresh, F.lit(0))).alias("n_hit")))
    items = (found.select("row_no", "phrase").distinct().join(_small(phrases.select("item", "phrase")), "phrase")
             .groupBy("row_no").agg(F.array_sort(F.collect_set("item")).alias("items")))
    rows = index.where("at = 0").groupBy("row_no").agg(F.first("doc_id").alias("doc_id"),
                                                       F.first("n_words").cast("long").alias("n_words"))
    none = F.array().cast("array<string>")
    out = rows.join(hit, "row_no", "left").join(items, "row_no", "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", none).alias("items"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items",
                      ((F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))
