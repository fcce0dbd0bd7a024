"""Exact Jaccard join of shingle sets in metric space, for components.

Jaccard distance is a metric, and so is the count of differing shingles.  Equal
sets are collapsed first.  The join then runs on regions around pivots:

1. Pivots are single shingles, in one global order (rare first).  A set lies in
   the region of its first shingle; but one that may be linked to it can differ
   by up to (1 - t) of its shingles, so by the triangle inequality the set is
   replicated into the regions of its first ``n - ceil(t n) + 1`` shingles.  Two
   linked sets share a region: they would differ by too much otherwise.  The same
   inequality, applied to the shingles in front of the shared one, drops pairs
   that cannot overlap enough from there on, and pairs that share too few regions.
2. Inside a region the set with the fewest rarer shingles is the pivot, and all
   sets are compared with it.  Regions whose sets already are in one component
   are done: near copies of one text need no more than a star.
3. Large regions that are open are cut into rings of width ``1 - t`` by distance
   from the pivot.  Linked sets lie in the same or in neighbouring rings, so each
   is replicated into the next ring, and each ring is a region again.
4. In what is open then, sets of different components are compared if they can
   overlap enough; one of the two is outside the region's commonest component.
   Both are dealt into blocks of bounded size, and a task joins two blocks.

Before two sets are compared, their bitmaps are: each shingle turns over one bit of
its set's map, so maps differ in at most as many bits as the sets have shingles not
in common, and pairs beyond what linked sets may differ by go unread.

No link between components is lost, and none is asked for inside one.  Distances
are exact: whole sets are compared, shingles by 64-bit hashes.

* Words are lower-cased (A-Z) runs of anything but blanks and ``\\t\\n\\v\\f\\r``.
  With fewer than ``k`` words the whole sequence is the one shingle; texts that
  are null or without words have empty sets and link with nothing.
* Rows are kept one by one; those with equal ids or texts share what equal sets
  share.  ``component_id`` is the least id reachable, null if none has an id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telluria.llm import spans as S
from telluria.llm.components import components
from telluria.llm.superkmer import WordHashes, gram_hashes
from telluria.session import BROADCAST_ROWS, materialize

CHUNK = 1 << 20  # text bytes cut into shingles at once
COUNTERS = 20  # bits of a shingle that choose its counter
FEW = 4  # sets of a region that are compared pair by pair at once
SMALL = 256  # sets of a block; larger open regions are cut into rings
ENTRIES = 1 << 19  # entries that one task of regions should get
Threshold = tuple[int, int]  # similarity as a fraction


def shingle_sets(texts: list[bytes], k: int, hashes: WordHashes) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    lists = [x.lower().split() for x in texts]
    count = [len(x) for x in lists]
    value = np.fromiter(map(hashes.__getitem__, (w for x in lists for w in x)), np.uint64, sum(count))
    grams = gram_hashes(value, k)
    out, at = [], 0
    for words, n in zip(lists, count):
        if n >= k:
            s = np.sort(grams[at:at + n - k + 1])
            s = s[np.concatenate([[True], s[1:] != s[:-1]])]
        else:
            s = np.array([xxhash.xxh3_64_intdigest(b" ".join(words), n)] if n else [], np.uint64)
        out.append(s)
        at += n
    return out


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    for batch in batches:
        for part in S.slices(batch, CHUNK):
            yield part, part.column("text").cast(pa.binary()).to_pylist()


def name_of(shingles: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(shingles.tobytes()) if len(shingles) else None


def parity(shingles: np.ndarray) -> np.ndarray | None:
    """A bitmap of two to four bits a shingle; each shingle turns one of them over.
    Two bitmaps differ in no more bits than the sets have differing shingles."""
    if not len(shingles):
        return None
    bits = max(64, 1 << (2 * len(shingles)).bit_length())
    odd = np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view(np.int64)


def survey(docs: DataFrame, k: int) -> DataFrame:
    """``doc_id, n, node, bits`` of each row; and each task's shingle counts, in
    stretches ``slot``, ``counts``."""
    stretch, longs = 1 << (COUNTERS - 6), pa.list_(pa.int64())
    columns = ["doc_id", "n", "node", "bits", "slot", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, counts = WordHashes(), np.zeros(1 << COUNTERS, np.int64)
        for part, texts in _parts(batches):
            sets = shingle_sets(texts, k, hashes)
            whole = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
            counts += np.bincount((whole >> np.uint64(64 - COUNTERS)).astype(np.int64), minlength=1 << COUNTERS)
            rows = part.num_rows
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([name_of(s) for s in sets], pa.binary()), pa.array([parity(s) for s in sets], longs),
                 pa.nulls(rows, pa.int64()), pa.nulls(rows, pa.binary())], names=columns)
        none = pa.nulls(64, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [none, none, pa.nulls(64, pa.binary()), pa.nulls(64, longs), pa.array(range(64), pa.int64()),
             pa.array([S.pack(counts[i * stretch:(i + 1) * stretch].tobytes()) for i in range(64)], pa.binary())],
            names=columns)

    return docs.mapInArrow(run, "doc_id long, n long, node binary, bits array<bigint>, slot long, counts binary")


def counters(surveyed: DataFrame) -> np.ndarray:
    """The counts of all tasks: always ``2 ** COUNTERS`` numbers."""
    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(S.unpack(x), np.int64) for x in table.column("counts").to_pylist())
        return pa.table({"slot": table.column("slot")[:1], "counts": pa.array([total.tobytes()], pa.binary())})

    rows = (surveyed.where("slot is not null").select("slot", "counts").groupBy("slot")
            .applyInArrow(add, "slot long, counts binary").collect())
    return np.concatenate([np.frombuffer(r["counts"], np.int64) for r in sorted(rows, key=lambda r: r["slot"])]
                          or [np.zeros(1 << COUNTERS, np.int64)])


def window_parcels(docs: DataFrame, k: int, t: Threshold, rarity, slots: list[int]) -> DataFrame:
    """Each set's entries in the regions of its first shingles, packed by task
    and bucket of regions; a task sends equal sets once."""
    num, den = t

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, count, seen = WordHashes(), rarity.value, set()
        for _, texts in _parts(batches):
            names, sizes, regions, lengths = [], [], [], []
            for s in shingle_sets(texts, k, hashes):
                name = name_of(s)
                if name is None or name in seen:
                    continue
                seen.add(name)
                n = len(s)
                first = n - -(-num * n // den) + 1
                order = np.argsort(count[(s >> np.uint64(64 - COUNTERS)).astype(np.int64)], kind="stable")[:first]
                names.append(name)
                sizes.append(n)
                regions.append(s[order])
                lengths.append(first)
            if not names:
                continue
            region, lengths = np.concatenate(regions), np.array(lengths, np.int64)
            owner = np.repeat(np.arange(len(names)), lengths)
            place = np.arange(len(region)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            table = np.frombuffer(b"".join(names), np.uint64).reshape(-1, 2)
            sizes = np.array(sizes, np.int64)
            to = (S.mix(region) % np.uint64(len(slots))).astype(np.int64)
            by = np.argsort(to, kind="stable")
            rows = []
            for i in np.split(by, np.flatnonzero(np.diff(to[by])) + 1):
                here, local = np.unique(owner[i], return_inverse=True)
                head = np.concatenate([np.array([len(here), len(i)], np.uint64), table[here].ravel(),
                                       sizes[here].astype(np.uint64), region[i]]).tobytes()
                rows.append((slots[to[i[0]]], 2, head, S.pack(np.concatenate([local, place[i]]).astype(np.int32).tobytes())))
            yield S.parcels(rows)

    return docs.mapInArrow(run, S.PARCEL)


ENTRY = "region long, a binary, b binary, na long, nb long, place long, near long"


def overlap_possible(na, nb, pa_, pb, t: Threshold):
    """Can two sets that first meet at these places overlap enough?"""
    num, den = t
    left = np.minimum(na - pa_, nb - pb)
    return (den + num) * left >= num * (na + nb)


def meet_in_regions(parcels: DataFrame, n: int, t: Threshold) -> DataFrame:
    """Pairs to compare (``region`` null; ``place`` is how often they met in
    regions of few sets), and the members of regions that need more than that:
    ``a`` the member, ``b`` the region's pivot."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: list[list[np.ndarray]] = [[] for _ in range(5)]
        for batch in batches:
            for head, body in zip(batch.column("head").to_pylist(), batch.column("body").to_pylist()):
                h = np.frombuffer(head, np.uint64)
                d, e = int(h[0]), int(h[1])
                refs = np.frombuffer(S.unpack(body), np.int32)
                local = refs[:e]
                names = h[2:2 + 2 * d].reshape(-1, 2)[local]
                for box, x in zip(got, (h[2 + 3 * d:], names[:, 0], names[:, 1],
                                        h[2 + 2 * d:2 + 3 * d].astype(np.int32)[local], refs[e:])):
                    box.append(x)
        if not got[0]:
            return
        region, x, y, size, place = map(np.concatenate, got)
        got.clear()
        by = np.argsort(region, kind="stable")
        r = region[by]
        alone = np.ones(len(r), bool)
        alone[1:] &= r[1:] != r[:-1]
        alone[:-1] &= r[1:] != r[:-1]
        by = by[~alone]
        # Within a region: fewest rarer shingles first; the same set once.
        by = by[np.lexsort((y[by], x[by], place[by], region[by]))]
        region, x, y, size, place = (v[by] for v in (region, x, y, size, place))
        twice = np.zeros(len(region), bool)
        twice[1:] = (region[1:] == region[:-1]) & (x[1:] == x[:-1]) & (y[1:] == y[:-1])
        region, x, y, size, place = (v[~twice] for v in (region, x, y, size.astype(np.int64), place.astype(np.int64)))
        if not len(region):
            return
        first = np.flatnonzero(np.concatenate([[True], region[1:] != region[:-1]]))
        count = np.diff(np.append(first, len(region)))
        group = np.repeat(np.arange(len(first)), count)
        lead = first[group]
        few = count[group] <= FEW
        pairs_a, pairs_b = [], []
        for step in range(1, FEW):
            i = np.arange(len(region) - step)
            ok = few[i] & (group[i] == group[i + step])
            pairs_a.append(i[ok] + step)
            pairs_b.append(i[ok])
        a, b = np.concatenate(pairs_a), np.concatenate(pairs_b)
        ok = overlap_possible(size[a], size[b], place[a], place[b], t)
        star = np.flatnonzero(~few & (np.arange(len(region)) != lead))
        names = np.ascontiguousarray(np.stack([x, y], axis=1))
        text = pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(names), [None, pa.py_buffer(names)]).cast(pa.binary())
        flip = np.concatenate([a, star])
        over = np.concatenate([b, lead[star]])
        # A pair is named in one order, wherever it is met.
        swap = (x[flip] > x[over]) | ((x[flip] == x[over]) & (y[flip] > y[over]))
        lo, hi = np.where(swap, over, flip), np.where(swap, flip, over)
        times = np.repeat([1, 0], [len(a), len(star)])  # meetings in regions all of whose pairs are named
        near = np.concatenate([ok, np.ones(len(star), bool)])  # at their first meeting, linked sets are
        if len(lo):
            _, ends, same = np.unique(np.stack([x[lo], y[lo], x[hi], y[hi]], axis=1), axis=0, return_index=True,
                                      return_inverse=True)
            times, near = (np.bincount(same.ravel(), weights=v).astype(np.int64) for v in (times, near))
            lo, hi = lo[ends], hi[ends]
        member = np.flatnonzero(~few)
        nulls = pa.nulls(len(lo), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [nulls, text.take(pa.array(lo)), text.take(pa.array(hi)), pa.array(size[lo]), pa.array(size[hi]),
             pa.array(times, pa.int64()), pa.array(near.astype(np.int64))],
            names=["region", "a", "b", "na", "nb", "place", "near"])
        yield pa.RecordBatch.from_arrays(
            [pa.array(region[member].view(np.int64)), text.take(pa.array(member)), text.take(pa.array(lead[member])),
             pa.array(size[member]), pa.array(size[lead[member]]), pa.array(place[member]),
             pa.nulls(len(member), pa.int64())], names=["region", "a", "b", "na", "nb", "place", "near"])

    return parcels.repartition(n, "slot").mapInArrow(run, ENTRY)


def pairs_to_compare(entries: DataFrame, t: Threshold) -> DataFrame:
    """Pairs that may have met often enough.

    Linked sets share so many shingles that the first of them, in order, lie in
    the windows of both: the least overlap, less the larger of ``ceil(t n)``, plus
    1.  Regions of few sets name all their pairs; in larger ones a pair can have
    met as often as the set that is in fewer of them.
    """
    num, den = t
    met = (entries.where("region is null").groupBy("a", "b", "na", "nb").agg(F.sum("place").alias("times"), F.sum("near").alias("near"))
           .where("near > 0"))
    large = entries.where("region is not null").groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    own = large.select("a", F.col("n").alias("la"))
    other = large.select(F.col("a").alias("b"), F.col("n").alias("lb"))
    joined = met.join(own, "a", "left").join(other, "b", "left").fillna(0, ["la", "lb"])
    whole = lambda c: F.ceil(num * F.col(c) / den)
    least = F.ceil(num * (F.col("na") + F.col("nb")) / (num + den))
    need = least - F.greatest(whole("na"), whole("nb")) + 1
    return joined.where(F.col("times") + F.least("la", "lb") >= need).select("a", "b", "na", "nb")


def near_enough(pairs: DataFrame, names: DataFrame, t: Threshold) -> DataFrame:
    """Pairs of fitting sizes whose bitmaps differ in no more bits than linked sets have differing
    shingles.  Of two bitmaps the longer is folded to half its length; pairs with
    bitmaps further apart than that are kept."""
    num, den = t
    bits = names.select("node", "bits")
    both = (pairs.join(bits.select(F.col("node").alias("a"), F.col("bits").alias("x")), "a")
            .join(bits.select(F.col("node").alias("b"), F.col("bits").alias("y")), "b"))
    xor = lambda p, q: F.zip_with(p, q, lambda u, v: u.bitwiseXOR(v))
    low = F.least(F.size("x"), F.size("y"))
    cut = lambda c: F.when(F.size(c) == 2 * low, xor(F.slice(c, 1, low), F.slice(c, low + 1, low))).otherwise(F.col(c))
    differ = F.aggregate(xor(cut("x"), cut("y")), F.lit(0), lambda total, v: total + F.bit_count(v))
    alike = F.greatest(F.size("x"), F.size("y")) <= 2 * low
    fits = differ * (num + den) <= (den - num) * (F.col("na") + F.col("nb"))
    size = den * F.least("na", "nb") >= num * F.greatest("na", "nb")
    return both.where(size & F.when(alike, fits).otherwise(True)).select("a", "b", "na", "nb")


def sets_of(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """``node, shingles``: the sets of the documents ``order_id`` of ``wanted``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for _, texts in _parts(batches):
            sets = [s for s in shingle_sets(texts, k, hashes) if len(s)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([name_of(s) for s in sets], pa.binary()),
                 pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["node", "shingles"])

    few = wanted.select("order_id").distinct()
    if few.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        few = F.broadcast(few)
    some = docs.join(few, "order_id", "left_semi").select("text")
    return some.mapInArrow(run, "node binary, shingles array<bigint>").groupBy("node").agg(F.first("shingles").alias("shingles"))


def compare(pairs: DataFrame, docs: DataFrame, names: DataFrame, k: int) -> DataFrame:
    """``a, b, na, nb, met``: how many shingles the sets of each pair share.
    ``names`` has a document for each set; its text gives the set again, which
    takes less room than keeping all sets."""
    pairs = materialize(pairs)
    ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    sets = sets_of(docs, materialize(names.join(ends, "node", "left_semi").select("order_id")), k)
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    return materialize(pairs.join(left, "a").join(right, "b").select(
        "a", "b", "na", "nb", F.size(F.array_intersect("sa", "sb")).cast("long").alias("met")))


def linked(t: Threshold) -> Column:
    num, den = t
    return F.col("met") * (num + den) >= num * (F.col("na") + F.col("nb"))


def _named(df: DataFrame, one: str, two: str, n_one: str, n_two: str) -> DataFrame:
    """Pairs in one order."""
    turn = F.col(one) > F.col(two)
    pick = lambda x, y: F.when(turn, F.col(y)).otherwise(F.col(x))
    return df.select(pick(one, two).alias("a"), pick(two, one).alias("b"), pick(n_one, n_two).alias("na"),
                     pick(n_two, n_one).alias("nb")).distinct()


def _open_regions(members: DataFrame, roots: DataFrame) -> DataFrame:
    """Members of regions with sets of several components: ``root``, ``size`` of
    the region, its commonest root ``main`` and how many are not of it."""
    rooted = materialize(members.join(roots.withColumnRenamed("node", "a"), "a", "left")
                         .withColumn("root", F.coalesce("root", "a")))
    return _several(rooted)


def _several(rooted: DataFrame) -> DataFrame:
    several = (rooted.groupBy("region", "root").agg(F.count(F.lit(1)).alias("n"))
               .groupBy("region").agg(F.sum("n").alias("size"), F.max("n").alias("most"),
                                      F.max_by("root", F.struct("n", "root")).alias("main"))
               .where("size > most").select("region", "size", "main", (F.col("size") - F.col("most")).alias("rest")))
    return rooted.join(several, "region")


def rings(large: DataFrame, compared: DataFrame, t: Threshold) -> DataFrame:
    """Cut open regions into rings around their pivots, each set in its own ring
    and in the next one: linked sets are in equal or neighbouring rings.
    ``compared`` has every member of the regions with its pivot."""
    num, den = t
    far = compared.select("a", "b", "met")
    both = far.unionByName(far.select(F.col("b").alias("a"), F.col("a").alias("b"), "met")).dropDuplicates(["a", "b"])
    union = F.col("na") + F.col("nb") - F.col("met")
    ring = F.floor((union - F.col("met")) * den / (union * (den - num))).cast("long")
    each = (large.where("a <> b").join(both, ["a", "b"])
            .select("a", "na", "place", "root", "b", "region", F.explode(F.array(ring, ring + 1)).alias("ring"))
            .select("a", "na", "place", "root", F.xxhash64("region", "b", "ring").alias("region")))
    return _several(each)


def pairs_between(still: DataFrame, t: Threshold) -> DataFrame:
    """Pairs of sets of different components in one region that may overlap enough.

    One of each pair is not of the region's commonest component.  Those, and all
    members, are dealt into blocks of about ``SMALL``; a task joins two blocks.
    """
    num, den = t
    wide = F.ceil(F.col("size") / SMALL).cast("int")
    narrow = F.ceil(F.col("rest") / SMALL).cast("int")
    own = F.abs(F.hash("a"))
    every = (still.withColumn("i", own % wide).withColumn("j", F.explode(F.sequence(F.lit(0), narrow - 1)))
             .select("region", "i", "j", "a", "na", "root", "place"))
    rest = (still.where("root <> main").withColumn("j", own % narrow)
            .withColumn("i", F.explode(F.sequence(F.lit(0), wide - 1)))
            .select("region", "i", "j", F.col("a").alias("b"), F.col("na").alias("nb"), F.col("root").alias("other"),
                    F.col("place").alias("over")))
    room = F.least(F.col("na") - F.col("place"), F.col("nb") - F.col("over"))
    found = every.join(rest, ["region", "i", "j"]).where(
        (F.col("root") != F.col("other")) & ((den + num) * room >= num * (F.col("na") + F.col("nb"))))
    return _named(found, "a", "b", "na", "nb")


def find_components(members: DataFrame, pairs: DataFrame, docs: DataFrame, names: DataFrame, k: int,
                    t: Threshold) -> DataFrame:
    """``node, root``, from the pairs to compare first and the members of regions
    ``region, a, na, place`` with their pivots ``b, nb``."""
    compared = compare(near_enough(pairs, names, t), docs, names, k)
    links = compared.where(linked(t))
    roots = components(links)
    still = materialize(_open_regions(members, roots))
    if still.isEmpty():
        return roots
    kept = ("region", "a", "na", "place", "root", "size", "main", "rest")
    large = still.where(F.col("size") > SMALL).drop("size", "main", "rest")
    # Members that cannot be linked to the pivot may be linked to each other, so their rings are needed as well.
    known = compared.select("a", "b").unionByName(compared.select(F.col("b").alias("a"), F.col("a").alias("b")))
    unmet = large.where("a <> b").select("a", "b", "na", "nb").distinct().join(known, ["a", "b"], "left_anti")
    compared = compared.unionByName(compare(unmet, docs, names, k))
    parts = still.where(F.col("size") <= SMALL).select(*kept).unionByName(rings(large, compared, t).select(*kept))
    more = pairs_between(parts, t).join(compared.select("a", "b"), ["a", "b"], "left_anti")
    return components(links.unionByName(compare(near_enough(more, names, t), docs, names, k).where(linked(t))))


def prepare(df: DataFrame, id_col: str, text_col: str, k: int, t: Threshold) -> tuple[DataFrame, ...]:
    """Documents, their rows ``doc_id, n, node, order_id``, the distinct sets
    ``node, order_id, n, bits`` and what they meet in."""
    spark = df.sparkSession
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    docs = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.alias("text")).withColumn(
        "order_id", F.coalesce("doc_id", F.lit(int(S.LAST))))
    surveyed = materialize(survey(docs.select("doc_id", "text"), k))
    whole = surveyed.where("slot is null").select("doc_id", "n", "node", "bits").withColumn(
        "order_id", F.coalesce("doc_id", F.lit(int(S.LAST))))
    rows = whole.drop("bits")
    names = materialize(whole.where("n > 0").groupBy("node").agg(
        F.min("order_id").alias("order_id"), F.sum("n").alias("n"), F.first("bits").alias("bits")))
    rarity = spark.sparkContext.broadcast(counters(surveyed))
    total = int(names.agg(F.sum("n")).first()[0] or 0)
    slots = S.slots(spark, total * (t[1] - t[0]) // t[1] // ENTRIES + 1)
    entries = materialize(meet_in_regions(window_parcels(docs.select("text"), k, t, rarity, slots), len(slots), t))
    return docs, rows, names, entries


def labelled_rows(rows: DataFrame, names: DataFrame, roots: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id, node`` of each row."""
    labelled = names.select("node", "order_id").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = labelled.groupBy("root").agg(F.min("order_id").alias("component"))
    final = labelled.join(least, "root").select("node", "component")
    component = F.coalesce("component", "order_id")
    return rows.join(final, "node", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(component < int(S.LAST), component).alias("component_id"), "node")


def jaccard_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4,
                       t: Threshold = (17, 20)) -> DataFrame:
    """Per row ``doc_id, n_shingles, component_id``."""
    docs, rows, names, entries = prepare(df, id_col, text_col, k, t)
    roots = find_components(entries.where("region is not null"), pairs_to_compare(entries, t), docs, names, k, t)
    return labelled_rows(rows, names, roots).drop("node")
