"""All links of the Jaccard join: each verified pair of different sets.

Linked sets meet in regions (see ``ngram_join``).  Here every region names all its
pairs: small ones at once, large ones in blocks of about ``SMALL`` sets, and a
task joins two blocks.  How often a pair met in all regions is then exact, pairs
that met too seldom go, and the rest are compared whole.  Equal sets are one node;
their rows are the membership.  Links grow with the square of a group of near
copies: that is the size of the answer, and nothing is left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telluria.llm import ngram_join as J
from telluria.llm.components import components
from telluria.session import materialize


def _ordered(pairs: DataFrame) -> DataFrame:
    """``a`` before ``b``, whichever order the pair was named in."""
    one, two = F.struct("a", "na"), F.struct(F.col("b").alias("a"), F.col("nb").alias("na"))
    ends = pairs.select(F.least(one, two).alias("x"), F.greatest(one, two).alias("y"), "times", "near")
    return ends.select(F.col("x.a").alias("a"), F.col("y.a").alias("b"), F.col("x.na").alias("na"),
                       F.col("y.na").alias("nb"), "times", "near")


def pairs_in_large_regions(members: DataFrame, t: J.Threshold) -> DataFrame:
    """``a, b, na, nb, times, near`` for every region that a pair shares."""
    num, den = t
    sizes = members.groupBy("region").agg(F.ceil(F.count(F.lit(1)) / J.SMALL).cast("int").alias("wide"))
    each = members.select("region", "a", "na", "place").join(sizes, "region").withColumn(
        "own", F.abs(F.hash("a") % F.col("wide")))
    left = each.select("region", F.col("own").alias("i"), F.explode(F.sequence("own", F.col("wide") - 1)).alias("j"),
                       "a", "na", "place")
    right = each.select("region", F.explode(F.sequence(F.lit(0), F.col("own"))).alias("i"), F.col("own").alias("j"),
                        F.col("a").alias("b"), F.col("na").alias("nb"), F.col("place").alias("over"))
    room = F.least(F.col("na") - F.col("place"), F.col("nb") - F.col("over"))
    near = ((den + num) * room >= num * (F.col("na") + F.col("nb"))).cast("long")
    return left.join(right, ["region", "i", "j"]).where("i < j or a < b").select(
        "a", "b", "na", "nb", F.lit(1).cast("long").alias("times"), near.alias("near"))


def links_of(entries: DataFrame, docs: DataFrame, names: DataFrame, k: int, t: J.Threshold) -> DataFrame:
    """``a, b, na, nb, met``: every linked pair of different sets, once."""
    num, den = t
    named = entries.where("region is null and place > 0").select("a", "b", "na", "nb", F.col("place").alias("times"), "near")
    met = _ordered(named.unionByName(pairs_in_large_regions(entries.where("region is not null"), t)))
    whole = lambda c: F.ceil(num * F.col(c) / den)
    need = F.ceil(num * (F.col("na") + F.col("nb")) / (num + den)) - F.greatest(whole("na"), whole("nb")) + 1
    pairs = (met.groupBy("a", "b", "na", "nb").agg(F.sum("times").alias("times"), F.sum("near").alias("near"))
             .where((F.col("near") > 0) & (F.col("times") >= need)).select("a", "b", "na", "nb"))
    return J.compare(J.near_enough(pairs, names, t), docs, names, k).where(J.linked(t))


def jaccard_links(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4,
                  t: J.Threshold = (17, 20)) -> tuple[DataFrame, DataFrame]:
    """Links ``a, b, na, nb, met`` between different sets, and the membership
    ``doc_id, n_shingles, component_id, node, n_links`` of the rows.

    ``n_links`` counts the other rows that a row is linked with, those of equal
    sets among them; rows without words have none.
    """
    docs, rows, names, entries = J.prepare(df, id_col, text_col, k, t)
    links = materialize(links_of(entries, docs, names, k, t))
    copies = rows.where("n > 0").groupBy("node").agg(F.count(F.lit(1)).alias("copies"))
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    others = (both.join(copies.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node"))
              .agg(F.sum("copies").alias("others")))
    counts = copies.join(others, "node", "left").select(
        "node", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    out = J.labelled_rows(rows, names, components(links)).join(counts, "node", "left").fillna(0, ["n_links"])
    return links, out.select("doc_id", "n_shingles", "component_id", "node", "n_links")
