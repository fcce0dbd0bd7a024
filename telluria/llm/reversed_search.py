"""Ranked lexical search, turned round: documents stream past the queries.

The items' terms make an inverted index, a list of items for each term, which is
broadcast in parts of a bounded number of postings.  One pass over the documents
counts terms (how many documents there are, how long, how many hold each term of
the index); a second sends each document's term counts through the index, adds
up its scores, and offers them to bounded heaps, one for each item.  Each task
ends with at most ``top`` rows an item, and the heaps of all tasks are merged.

* A term is a maximal run of ASCII letters, digits and characters beyond ASCII,
  with A-Z lower-cased.  An item's terms count once each.
* Weights and scores are whole numbers: see ``weight`` and ``scores``.
* Null and empty texts have no terms; as documents they count for nothing, as
  items they have no rows.  Items equal in id and text count once; items that
  share an id only are ranked on their own.  Each row of the documents is a
  document, so repeated rows take ranks of their own.
* Equal scores go by the smaller document id; documents without an id come last.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from telluria.llm.text import alnum_words, documents
from telluria.session import materialize

POSTINGS = 1_000_000  # most pairs of item and term broadcast at once
LAST = np.iinfo(np.int64).max  # a missing document id, in order
_LETTERS = bytes(range(97, 123))
# Bytes of UTF-8: A-Z to a-z, other ASCII but digits and a-z to blanks.
TERM_BYTES = bytes(b if b > 127 or 48 <= b <= 57 or b in _LETTERS else b + 32 if 65 <= b <= 90 else 32
                   for b in range(256))


def weight(n: int, df: int) -> int:
    """Of a term that ``df`` of ``n`` documents hold."""
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def terms_of(text: bytes | None) -> list[bytes]:
    return text.translate(TERM_BYTES).split() if text else []


def deal(items: DataFrame, id_col: str, text_col: str, postings: int) -> tuple[DataFrame, int]:
    """Distinct items with ``item_key, terms, part``, and the number of parts;
    a part has more than ``postings`` pairs only if one item alone has."""
    rows = items.select(F.col(f"`{id_col}`").alias("item_key"), F.col(f"`{text_col}`").cast("string").alias("text"))
    rows = rows.distinct().select("item_key", F.array_distinct(alnum_words(F.col("text"))).alias("terms"),
                                  F.xxhash64("item_key", "text").alias("mark")).where(F.size("terms") > 0)
    rows = materialize(rows)
    total = rows.agg(F.sum(F.size("terms"))).first()[0] or 0
    parts = -(-total // postings)
    while parts:
        dealt = rows.withColumn("part", F.pmod("mark", F.lit(parts)))
        crowded = dealt.groupBy("part").agg(F.sum(F.size("terms")).alias("n"), F.count(F.lit(1)).alias("of")).where(
            (F.col("n") > postings) & (F.col("of") > 1))
        if crowded.isEmpty():
            return dealt.drop("mark"), parts
        parts *= 2
    return rows.withColumn("part", F.lit(0)).drop("mark"), 0


class Index:
    """Items of each term."""

    def __init__(self, rows: list[Row]):
        held: dict[bytes, list[int]] = {}
        for no, row in enumerate(rows):
            for term in row["terms"]:
                held.setdefault(term.encode(), []).append(no)
        self.items = len(rows)
        self.numbers = {term: i for i, term in enumerate(sorted(held))}
        self.lists = [np.array(held[term], np.int64) for term in self.numbers]


def count_terms(docs: DataFrame, shared) -> DataFrame:
    """``term, n``: documents that hold each term of the index; under -1 the
    documents with any term, under -2 the terms of all documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = shared.value.numbers
        held = np.zeros(len(numbers) + 2, np.int64)  # the last two are -2 and -1
        for batch in batches:
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                terms = terms_of(text)
                if terms:
                    held[-1] += 1
                    held[-2] += len(terms)
                    held[[numbers[t] for t in set(terms) & numbers.keys()]] += 1
        known = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.where(known < len(numbers), known, known - len(held))), pa.array(held[known])],
            names=["term", "n"])

    return docs.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))


class Heaps:
    """The ``top`` best documents of each item."""

    def __init__(self, items: int, top: int):
        self.top = top
        self.held: list[list[tuple[int, int]]] = [[] for _ in range(items)]
        self.least = np.ones(items, np.int64)  # what a score must reach

    def offer(self, item: int, score: int, doc: int) -> None:
        heap = self.held[item]
        if len(heap) < self.top:
            heapq.heappush(heap, (score, -doc))
        else:
            heapq.heappushpop(heap, (score, -doc))
        if len(heap) == self.top:
            self.least[item] = heap[0][0]


def best_of_tasks(docs: DataFrame, shared, n: int, length: int, df: list[int], top: int) -> DataFrame:
    """Rows ``item, doc, score``, at most ``top`` of each task and item."""
    weights = [weight(n, d) for d in df]

    def scores(terms: list[bytes], index: Index) -> tuple[np.ndarray, np.ndarray]:
        """Items that share a term with the document, and their scores."""
        m = 100 - 90 + (90 * len(terms) * n) // length
        found = [(index.numbers[t], tf) for t, tf in Counter(terms).items() if t in index.numbers]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        worth = [weights[t] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m)) for t, tf in found]
        lists = [index.lists[t] for t, _ in found]
        hit, to = np.unique(np.concatenate(lists), return_inverse=True)
        total = np.zeros(len(hit), np.int64)
        np.add.at(total, to, np.repeat(np.array(worth, np.int64), [len(x) for x in lists]))
        return hit, total

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        heaps = Heaps(index.items, top)
        for batch in batches:
            ids = batch.column("doc_id").fill_null(int(LAST)).to_pylist()
            for doc, text in zip(ids, batch.column("text").cast(pa.binary()).to_pylist()):
                terms = terms_of(text)
                if not terms:
                    continue
                hit, total = scores(terms, index)
                good = total >= heaps.least[hit]
                for item, score in zip(hit[good].tolist(), total[good].tolist()):
                    heaps.offer(item, score, doc)
        rows = [(item, -doc, score) for item, heap in enumerate(heaps.held) for score, doc in heap]
        item, doc, score = zip(*rows) if rows else ((),) * 3
        yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array(doc, pa.int64()), pa.array(score, pa.int64())],
                                         names=["item", "doc", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "item long, doc long, score long")


def ranked_search(df: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text", top: int = 10,
                  postings: int = POSTINGS) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``top`` best documents of each item
    with a score above 0, all if there are fewer."""
    spark, docs = df.sparkSession, documents(df, id_col, text_col)
    dealt, parts = deal(items, item_col, item_text_col, postings)
    key_type = dealt.schema["item_key"].dataType.simpleString()
    found = []
    for part in range(parts):
        rows = dealt.where(F.col("part") == part).orderBy("item_key", "terms").collect()  # at most ``postings`` pairs
        shared = spark.sparkContext.broadcast(Index(rows))
        counts = {r["term"]: r["n"] for r in count_terms(docs, shared).collect()}  # a row a term of the part
        if not counts:
            break
        df_of = [counts.get(t, 0) for t in range(len(shared.value.numbers))]
        heaps = best_of_tasks(docs, shared, counts[-1], counts[-2], df_of, top)
        order = Window.partitionBy("item").orderBy(F.desc("score"), "doc")
        best = heaps.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
        names = spark.createDataFrame([(no, row["item_key"]) for no, row in enumerate(rows)],
                                      f"item long, item_id {key_type}")
        found.append(best.join(F.broadcast(names), "item").select(
            "item_id", "rank", F.when(F.col("doc") != int(LAST), F.col("doc")).alias("doc_id"), "score"))
    if not found:
        return spark.createDataFrame([], f"item_id {key_type}, rank int, doc_id long, score long")
    return reduce(DataFrame.unionByName, found)
