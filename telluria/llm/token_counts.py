"""Token counts with overlap resynchronisation.

Texts of up to ``chunk`` characters are encoded as they are.  A longer one is
written to the shared folder, cut into chunks that overlap, and its chunks are
dealt over the cluster, so that no task holds more than ``chunk`` characters of
it.  Each chunk is encoded by itself, with offsets.  Two neighbours are spliced
at a boundary that both have at the same place inside their overlap and that is
proven stable (below): tokens of the left chunk after it and tokens of the right
chunk before it are not counted.  Texts with an overlap that holds no such
boundary, for example a run of letters without blanks, are cut again with chunks
and overlaps four times as wide, until it does or one chunk holds the text.

What makes a boundary stable:

* Byte-level BPE (.json): the pattern that parts words looks ahead but never
  back, so what follows the start of a word depends on nothing before it.  The
  first chunk starts words where the whole text does.  A later one that starts a
  word at the same place goes on as the whole text does.  Places too near to the
  end of the left chunk, where a cut special string or lookahead might matter, do
  not count.
* Sentencepiece (.model): a blank after another character, where the vocabulary
  holds no piece with a blank after another character, so no merge crosses it.
* Other files prove nothing, and their long texts are encoded whole.

Null texts are empty, and have no tokens.  Special strings inside texts are
handled as the library does by default.  Every row has its own row in the
result, repeated rows and rows without an id too.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telluria.llm.text import documents
from telluria.session import materialize, scratch_path, stored

CHUNK = 1 << 15  # characters; longer texts are cut
OVERLAP = 256
WIDER = 4
TASK_CHARS = 1 << 21  # characters of chunks in one task
LOOKAHEAD = 4  # characters after a word that may decide where it ends
COUNTED = "doc_id long, n_bytes long, n_tokens long, n_chunks long"
# Texts of these characters may be counted by blank-separated parts: no word of
# the pattern crosses such a blank, and single blanks belong to what follows.
ODD = re.compile("[^\t\n\r -~¡-ɏ]|  ")


class BpeCounter:
    """Counts and word starts by a file of the ``tokenizers`` library."""

    def __init__(self, path: str, most: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallel unit
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        before = spec.get("pre_tokenizer") or {}
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.provable = (spec["model"]["type"] == "BPE" and before.get("type") == "ByteLevel"
                         and before.get("use_regex", True) and not before.get("add_prefix_space")
                         and not spec.get("normalizer")
                         and not any(t.lstrip or t.rstrip or t.single_word
                                     for t in self.library.get_added_tokens_decoder().values()))
        self.margin = LOOKAHEAD + max(map(len, self.special), default=0)
        self.known: dict[str, int] = {}
        self.most = most

    def _sizes(self, texts: list[str]) -> list[int]:
        return [len(e) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _parted(self, text: str) -> bool:
        return self.provable and not ODD.search(text) and not any(s in text for s in self.special)

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text.  Words are counted once and remembered."""
        out, whole = [0] * len(texts), []
        for i, text in enumerate(texts):
            if not text:
                continue
            if not self._parted(text):
                whole.append(i)
                continue
            first, *rest = text.split(" ")
            parts = [first] if first else []
            parts += [" " + p for p in rest]
            try:
                out[i] = sum(map(self.known.__getitem__, parts))
            except KeyError:
                if len(self.known) > self.most:
                    self.known.clear()
                new = [p for p in set(parts) if p not in self.known]
                self.known.update(zip(new, self._sizes(new)))
                out[i] = sum(map(self.known.__getitem__, parts))
        for i, n in zip(whole, self._sizes([texts[i] for i in whole])):
            out[i] = n
        return out

    def starts(self, text: str) -> tuple[int, np.ndarray, np.ndarray]:
        """Tokens of a chunk; places where words start; tokens before each."""
        found = self.library.encode(text, add_special_tokens=False)
        words = np.array(found.word_ids, np.int64)
        index = np.flatnonzero(np.diff(words, prepend=-1) != 0)
        at = np.array([a for a, _ in found.offsets], np.int64)[index] if len(index) else index
        return len(words), at, index


class PieceCounter:
    """Counts and blank starts by a file of the ``sentencepiece`` library."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        crossing = re.compile("[^▁]▁")
        self.provable = not any(crossing.search(self.library.id_to_piece(i)) for i in range(self.library.vocab_size()))
        self.margin = LOOKAHEAD

    def count(self, texts: list[str]) -> list[int]:
        return [len(ids) for ids in self.library.encode(texts, num_threads=1)] if texts else []

    def starts(self, text: str) -> tuple[int, np.ndarray, np.ndarray]:
        offsets = self.library.encode(text, return_type="offset_mapping")["offsets"]
        begins = np.array([begin for begin, _ in offsets], np.int64)
        at = np.array([m.start() + 1 for m in re.finditer(r"[^\s▁] (?! )", text)], np.int64)
        index = np.searchsorted(begins, at, side="left")
        right = index < len(begins)
        right[right] = begins[index[right]] == at[right]
        return len(begins), at[right], index[right]


_COUNTERS: dict[str, BpeCounter | PieceCounter] = {}


def counter(path: str) -> BpeCounter | PieceCounter:
    """One counter for each Python worker."""
    if path not in _COUNTERS:
        _COUNTERS[path] = PieceCounter(path) if path.endswith(".model") else BpeCounter(path)
    return _COUNTERS[path]


def count_whole(docs: DataFrame, path: str) -> DataFrame:
    """Texts that are encoded at once; ``docs``: doc_id, text (not null), n_bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = counter(path)
        for batch in batches:
            sizes = tokens.count(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"), pa.array(sizes, pa.int64()),
                 pa.array([1] * len(sizes), pa.int64())], names=["doc_id", "n_bytes", "n_tokens", "n_chunks"])

    return docs.select("doc_id", "text", "n_bytes").mapInArrow(run, COUNTED)


def cut(held: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """Overlapping chunks of each text: ``row, no, start, piece``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, text in zip(batch.column("row").to_pylist(), batch.column("text")):
                text = text.as_py()
                starts = range(0, max(1, len(text) - overlap), chunk - overlap)
                for a in range(0, len(starts), 64):
                    part = starts[a:a + 64]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([row] * len(part), pa.int64()), pa.array(range(a, a + len(part)), pa.int64()),
                         pa.array(part, pa.int64()), pa.array([text[s:s + chunk] for s in part], pa.string())],
                        names=["row", "no", "start", "piece"])

    return held.select("row", "text").mapInArrow(run, "row long, no long, start long, piece string")


def encode_chunks(pieces: DataFrame, path: str, chunk: int, overlap: int) -> DataFrame:
    """Tokens of each chunk, and the stable starts in its two overlaps as places
    in the text with the tokens before them in the chunk."""
    schema = "row long, no long, total long, head array<struct<at: long, before: long>>, " \
             "tail array<struct<at: long, before: long>>"
    struct = pa.list_(pa.struct([("at", pa.int64()), ("before", pa.int64())]))

    def listed(at: np.ndarray, before: np.ndarray) -> list[dict]:
        return [{"at": int(a), "before": int(b)} for a, b in zip(at, before)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = counter(path)
        for batch in batches:
            totals, heads, tails = [], [], []
            for start, piece in zip(batch.column("start").to_pylist(), batch.column("piece").to_pylist()):
                total, at, before = tokens.starts(piece)
                head = at < overlap
                tail = (at >= chunk - overlap) & (at <= chunk - tokens.margin)
                totals.append(total)
                heads.append(listed(at[head] + start, before[head]))
                tails.append(listed(at[tail] + start, before[tail]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("no"), pa.array(totals, pa.int64()), pa.array(heads, struct),
                 pa.array(tails, struct)], names=["row", "no", "total", "head", "tail"])

    return pieces.mapInArrow(run, schema)


def splice(encoded: DataFrame) -> DataFrame:
    """Per text its tokens, its chunks, and how many neighbours share no stable start."""
    right = encoded.select("row", (F.col("no") - 1).alias("no"), F.col("head").alias("next"))
    joined = encoded.join(right, ["row", "no"], "left")
    place = F.array_min(F.array_intersect("tail.at", "next.at"))
    lost = F.filter("tail", lambda s: s["at"] == F.col("place"))[0]["before"]
    early = F.filter("next", lambda s: s["at"] == F.col("place"))[0]["before"]
    each = joined.withColumn("place", place).select(
        "row", F.when(F.col("place").isNull(), F.col("total")).otherwise(lost - early).alias("tokens"),
        (F.col("next").isNotNull() & F.col("place").isNull()).alias("apart"))
    return each.groupBy("row").agg(F.sum("tokens").alias("n_tokens"), F.count(F.lit(1)).alias("n_chunks"),
                                   F.count_if("apart").alias("apart"))


def count_tokens(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512,
                 chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit, n_chunks`` of every row;
    ``n_chunks`` is how many pieces the text was encoded in."""
    if chunk < 2 * overlap:
        raise ValueError("the two overlaps of a chunk must not meet")
    spark = df.sparkSession
    docs = documents(df, id_col, text_col).withColumn("text", F.coalesce("text", F.lit(""))).withColumn(
        "n_bytes", F.octet_length("text").cast("long"))
    if not counter(path).provable:
        return count_whole(docs, path).withColumn("over_limit", F.col("n_tokens") > limit)
    long = F.length("text") > chunk
    done = [count_whole(docs.where(~long), path)]
    store = scratch_path(spark, "long-texts")
    docs.where(long).withColumn("row", F.monotonically_increasing_id()).write.parquet(store)
    texts = spark.read.parquet(store)
    open_rows = None
    while True:
        held = texts if open_rows is None else texts.join(open_rows, "row", "left_semi")
        chars = held.agg(F.sum(F.length("text"))).first()[0]
        if not chars:
            break
        pieces = cut(held, chunk, overlap).repartition(1 + chars // max(TASK_CHARS, chunk), "row", "no")
        # Splicing reads both neighbours of a boundary; the chunks are encoded once for both.
        spliced = materialize(splice(stored(encode_chunks(pieces, path, chunk, overlap))))
        done.append(texts.select("row", "doc_id", "n_bytes").join(spliced.where("apart = 0"), "row")
                    .select("doc_id", "n_bytes", "n_tokens", "n_chunks"))
        open_rows = spliced.where("apart > 0").select("row")
        chunk, overlap = chunk * WIDER, overlap * WIDER
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
