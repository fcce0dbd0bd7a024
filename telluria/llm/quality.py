"""Quality rules: counts of words, symbols and repeats, and n-gram perplexity.

The language model is modified Kneser-Ney over folded characters, one model a
language, counted by Spark over all documents.  Tasks count their n-grams, the
counts are added up by ranges of n-grams, and the smoothing (discounts from
counts of counts, continuation counts for lower orders) is joins and windows.
Every n-gram of the documents is in the model, so each has its own probability
and scoring needs no back-off.  The model is stored as sorted arrays of n-gram
keys with their log-probabilities, searched by bisection.

A document's log-perplexity is its mean negative log-probability a character.
Each language has a lower and an upper limit: median minus and plus ``spread``
times the median absolute deviation of its documents that pass the other rules,
but never closer than ``least_width`` of the median, for languages of few
documents.  Repeated boilerplate is too predictable, garbled text too surprising.

* Null text has no words; documents without characters have no perplexity and
  are not judged by it (they fail for their length).  Null languages are one of
  their own.  Rows are judged one by one, so repeated ids or rows do no harm.
* A model of up to ``MODEL_BYTES`` is broadcast.  A larger one is joined to the
  n-grams of each document; both ways give the same sums.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from telluria.llm import spans as S
from telluria.llm.superkmer import WordHashes, gram_hashes
from telluria.session import attach, materialize

BITS = 6  # of a folded character
CHUNK = 1 << 20  # text bytes at once; their n-grams take some 60 times that
MODEL_BYTES = 64 << 20
BLANKS, SYMBOLS = b" \t\n\x0b\x0c\r", b"#*$%&|<>"


def fold_table() -> np.ndarray:
    """Class of each code point below 2**16: blank, letter, digit, three kinds of
    marks, and 32 classes for what is beyond ASCII (by its lower case)."""
    table = np.empty(1 << 16, np.uint8)
    for c in range(1 << 16):
        ch = chr(c)
        if c >= 128:
            low = ch.lower()
            table[c] = 32 + (ord(low) if len(low) == 1 else c) % 32
        elif ch.isalpha():
            table[c] = 1 + ord(ch.lower()) - 97
        elif ch.isdigit():
            table[c] = 27
        elif ch in " \t\n\x0b\x0c\r":
            table[c] = 0
        else:
            table[c] = 28 if ch in ".,;:!?'\"()-" else 29 if ch.encode() in SYMBOLS else 30
    return table


def folded(texts: list[str], order: int, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the n-grams that end at each character, text by text, and how many
    each text has.  Texts are parted by ``order - 1`` blanks, their first context."""
    gap = " " * (order - 1)
    points = np.frombuffer((gap + gap.join(texts)).encode("utf-32-le", "replace"), np.uint32)
    codes = table[np.where(points < 1 << 16, points, 128 + points % 128)].astype(np.uint32)
    keys = codes[order - 1:].copy()
    for j in range(1, order):
        keys |= codes[order - 1 - j:len(codes) - j] << np.uint32(BITS * j)
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    begin = np.cumsum(size + order - 1) - (size + order - 1)
    pick = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    return keys[pick], size


def _languages(part: pa.RecordBatch) -> tuple[list[str], np.ndarray]:
    names = part.column("lang").fill_null("").to_pylist()
    known = {x: n for n, x in enumerate(dict.fromkeys(names))}
    return list(known), np.fromiter((known[x] for x in names), np.int64, len(names))


def count_grams(docs: DataFrame, order: int, shares: int) -> DataFrame:
    """``lang, gram, n`` over all documents; each task adds its own counts first."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, have = fold_table(), {}
        for batch in batches:
            for part in S.slices(batch, CHUNK):
                names, lang = _languages(part)
                keys, size = folded(part.column("text").to_pylist(), order, table)
                owner = np.repeat(lang, size)
                for n, name in enumerate(names):
                    grams, times = np.unique(keys[owner == n], return_counts=True)
                    have.setdefault(name, []).append((grams, times.astype(np.int64)))
                    if len(have[name]) > 8:
                        have[name] = [_added(have[name])]
        rows = []
        for name, parts in have.items():
            grams, times = _added(parts)
            to = grams.astype(np.int64) % shares
            by = np.argsort(to, kind="stable")
            for i in np.split(by, np.flatnonzero(np.diff(to[by])) + 1):
                if len(i):
                    rows.append((name, int(to[i[0]]), S.pack(grams[i].tobytes()), S.pack(times[i].tobytes())))
        yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(
            zip(*rows) if rows else ((),) * 4, (pa.string(), pa.int32(), pa.binary(), pa.binary()))],
            names=["lang", "share", "grams", "times"])

    def add(table: pa.Table) -> pa.Table:
        parts = [(np.frombuffer(S.unpack(g), np.uint32), np.frombuffer(S.unpack(t), np.int64))
                 for g, t in zip(table.column("grams").to_pylist(), table.column("times").to_pylist())]
        grams, times = _added(parts)
        lang = table.column("lang")[0].as_py()
        return pa.table({"lang": pa.array([lang] * len(grams), pa.string()), "gram": pa.array(grams.astype(np.int64)),
                         "n": pa.array(times)})

    each = docs.mapInArrow(count, "lang string, share int, grams binary, times binary")
    return each.groupBy("lang", "share").applyInArrow(add, "lang string, gram long, n long")


def _added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    grams, times = (np.concatenate(x) for x in zip(*parts))
    by = np.argsort(grams, kind="stable")
    grams, times = grams[by], times[by]
    first = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]])) if len(grams) else np.zeros(0, np.int64)
    return grams[first], np.add.reduceat(times, first) if len(first) else times


def discounts(counts: DataFrame) -> DataFrame:
    """Modified Kneser-Ney discounts ``d1, d2, d3`` of each language, from its
    counts of counts; 0.5, 1, 1.5 where a count of counts is missing."""
    n = [F.sum(F.when(F.col("n") == i, 1).otherwise(0)).cast("double") for i in (1, 2, 3, 4)]
    of = counts.groupBy("lang").agg(*[x.alias(f"n{i}") for i, x in enumerate(n, 1)])
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
    have = (F.col("n1") > 0) & (F.col("n2") > 0) & (F.col("n3") > 0)

    def d(i: int, low: str, high: str) -> Column:
        raw = i - (i + 1) * y * F.col(high) / F.nullif(F.col(low), F.lit(0))
        return F.when(have, F.least(F.lit(float(i)), F.greatest(F.lit(0.0), raw))).otherwise(i / 2).alias(f"d{i}")

    return of.select("lang", d(1, "n1", "n2"), d(2, "n2", "n3"), d(3, "n3", "n4"))


def kneser_ney(counts: DataFrame, order: int) -> DataFrame:
    """``lang, gram, p``: interpolated probability of each n-gram's last character."""
    levels = {order: counts}
    for size in range(order - 1, 0, -1):  # how many different characters come before
        tail = F.col("gram").bitwiseAND((1 << (BITS * size)) - 1)
        levels[size] = materialize(levels[size + 1].groupBy("lang", tail.alias("gram")).agg(F.count(F.lit(1)).alias("n")))
    p = None
    for size in range(1, order + 1):
        same = Window.partitionBy("lang", "before")
        off = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        table = (levels[size].join(discounts(levels[size]), "lang")
                 .withColumn("before", F.shiftright("gram", BITS)).withColumn("off", off)
                 .withColumn("all", F.sum("n").over(same)).withColumn("saved", F.sum("off").over(same))
                 .withColumn("tail", F.col("gram").bitwiseAND((1 << (BITS * (size - 1))) - 1)))
        if p is None:
            lower = F.lit(1.0 / (1 << BITS))
        else:
            table = table.join(p.select("lang", F.col("gram").alias("tail"), F.col("p").alias("lower")), ["lang", "tail"])
            lower = F.col("lower")
        p = materialize(table.select("lang", "gram", (
            (F.col("n") - F.col("off")) / F.col("all") + F.col("saved") / F.col("all") * lower).alias("p")))
    return p


def base_counts(text: str, hashes: WordHashes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    raw = text.encode()
    words = raw.split()
    blanks = len(raw) - len(raw.translate(None, BLANKS))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    repeats = 0
    if len(words) > 3:
        grams = gram_hashes(np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words)), 3)
        by = np.argsort(grams)
        same = np.diff(grams[by]) == 0
        if same.any():
            twice = np.concatenate([[False], same]) | np.concatenate([same, [False]])
            hit = np.zeros(len(words), bool)
            for j in range(3):
                hit[by[twice] + j] = True
            repeats = int(hit.sum())
    return len(words), len(text) - blanks, symbols, len(lines) - len(set(lines)), repeats


COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
NAMES = [c.split()[0] for c in COUNTS.split(", ")]


def stored_model(p: DataFrame, shares: int) -> DataFrame:
    """Sorted arrays ``lang, share, grams, logs``."""
    def store(table: pa.Table) -> pa.Table:
        by = table.sort_by("gram")
        return pa.table({"lang": by.column("lang")[:1], "share": by.column("share")[:1],
                         "grams": pa.array([by.column("gram").to_numpy().astype(np.uint32).tobytes()], pa.binary()),
                         "logs": pa.array([np.log(by.column("p").to_numpy()).astype(np.float32).tobytes()], pa.binary())})

    keyed = p.withColumn("share", (F.shiftright("gram", 12) % shares).cast("int"))
    return keyed.groupBy("lang", "share").applyInArrow(store, "lang string, share int, grams binary, logs binary")


def collected(model: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    parts: dict[str, list] = {}
    for r in model.collect():
        parts.setdefault(r["lang"], []).append((np.frombuffer(r["grams"], np.uint32), np.frombuffer(r["logs"], np.float32)))
    out = {}
    for lang, pieces in parts.items():
        grams, logs = (np.concatenate(x) for x in zip(*pieces))
        by = np.argsort(grams)
        out[lang] = grams[by], logs[by]
    return out


def score(docs: DataFrame, order: int, model) -> DataFrame:
    """``doc_id, lang``, the counts, ``n_grams`` and ``log_sum``.  With no model,
    also ``row_no, grams, times`` to join one."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, hashes = fold_table(), WordHashes()
        nothing = np.zeros(0, np.uint32), np.zeros(0, np.float32)  # of a language without characters
        for batch in batches:
            for part in S.slices(batch, CHUNK):
                texts = part.column("text").to_pylist()
                names, lang = _languages(part)
                keys, size = folded(texts, order, table)
                counts = list(zip(*[base_counts(x, hashes) for x in texts]))
                logs = np.zeros(len(keys), np.float64)
                owner = np.repeat(lang, size)
                ends = np.cumsum(size)
                columns = [part.column("doc_id"), part.column("lang").fill_null(""),
                           *[pa.array(c, pa.int64()) for c in counts], pa.array(size)]
                if model is not None:
                    for n, name in enumerate(names):
                        grams, values = model.value.get(name, nothing)
                        own = owner == n
                        logs[own] = values[np.searchsorted(grams, keys[own])]
                    total = np.concatenate([[0.0], np.cumsum(logs)])
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(total[ends] - total[ends - size])],
                                                     names=["doc_id", "lang", *NAMES, "n_grams", "log_sum"])
                else:
                    each = [np.unique(keys[e - s:e], return_counts=True) for e, s in zip(ends, size)]
                    lists = [pa.array([x[i].astype(np.int64) for x in each], pa.list_(pa.int64())) for i in (0, 1)]
                    yield pa.RecordBatch.from_arrays([*columns, *lists],
                                                     names=["doc_id", "lang", *NAMES, "n_grams", "grams", "times"])

    last = "log_sum double" if model is not None else "grams array<bigint>, times array<bigint>"
    return docs.mapInArrow(run, f"doc_id long, lang string, {COUNTS}, n_grams long, {last}")


def score_by_join(docs: DataFrame, order: int, p: DataFrame) -> DataFrame:
    rows = materialize(score(docs, order, None).withColumn("row_no", F.monotonically_increasing_id()))
    each = (rows.select("row_no", "lang", F.explode(F.arrays_zip("grams", "times")).alias("g"))
            .select("row_no", "lang", F.col("g.grams").alias("gram"), F.col("g.times").alias("times")))
    sums = (each.join(p, ["lang", "gram"]).groupBy("row_no")
            .agg(F.sum(F.log("p") * F.col("times")).alias("log_sum")))
    return rows.drop("grams", "times").join(sums, "row_no", "left").drop("row_no").fillna(0.0, ["log_sum"])


def quality(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", order: int = 5,
            spread: float = 10.0, least_width: float = 0.1, least_words: int = 50, most_repeats: int = 50,
            model_bytes: int = MODEL_BYTES) -> DataFrame:
    """Per row ``doc_id, lang``, the counts, ``log_perplexity, lower, upper,
    base_failed, kept``.  ``most_repeats`` is a percentage of the words."""
    spark = df.sparkSession
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    docs = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.alias("text"),
                     F.col(f"`{lang_col}`").cast("string").alias("lang"))
    shares = 64
    counts = materialize(count_grams(docs, order, shares))
    p = kneser_ney(counts, order)
    if p.count() * 8 <= model_bytes:
        model = spark.sparkContext.broadcast(collected(stored_model(p, shares)))
        scored = materialize(score(docs, order, model))
    else:
        scored = materialize(score_by_join(docs, order, p))
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeats * F.col("n_words"))
    scored = scored.withColumn("base_failed", failed).withColumn(
        "log_perplexity", F.when(F.col("n_grams") > 0, -F.col("log_sum") / F.col("n_grams")))
    sound = scored.where(~F.col("base_failed"))
    middle = sound.groupBy("lang").agg(F.percentile_approx("log_perplexity", 0.5, 10000).alias("middle"))
    middle = materialize(middle)
    languages = middle.count()
    off = (attach(sound, middle, ["lang"], groups=languages, how="inner").groupBy("lang", "middle")
           .agg(F.percentile_approx(F.abs(F.col("log_perplexity") - F.col("middle")), 0.5, 10000).alias("off")))
    width = F.greatest(spread * F.col("off"), least_width * F.col("middle"))
    bands = off.select("lang", (F.col("middle") - width).alias("lower"), (F.col("middle") + width).alias("upper"))
    inside = F.coalesce(F.col("log_perplexity").between(F.col("lower"), F.col("upper")), F.lit(True))
    return attach(scored, bands, ["lang"], groups=languages).select(
        "doc_id", "lang", *NAMES, "log_perplexity", "lower", "upper", "base_failed",
        (~F.col("base_failed") & inside).alias("kept"))
