"""TF-IDF cosine similarity in relational terms.

Terms are runs of two or more word characters, lower-cased; weights are raw
counts times ln((1 + n) / (1 + df)) + 1, with n the texts of the group. Texts that
share no term have similarity 0 and make no row, so the join on terms is exact.
With a bound only the rarest terms of each text are joined, so that pairs which
cannot reach the bound meet only if they share one of those.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TERM = r"(?U)\b\w\w+\b"
#: The weight, among two texts, of a term that only one of them has.
ALONE = math.log(1.5) + 1


def _terms(column: str):
    return F.regexp_extract_all(F.lower(column), F.lit(TERM), F.lit(0))


def group_pairs(texts: DataFrame, group: list[str], order: str, column: str, above: float | None = None) -> DataFrame:
    """(group, a, b, similarity) of the pairs a < b by `order` within a group that share a term, above the bound if given."""
    sizes = texts.groupBy(*group).agg(F.count("*").alias("n")).filter("n > 1")
    tf = texts.select(*group, order, F.explode(_terms(column)).alias("term")).groupBy(*group, order, "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy(*group, "term").agg(F.count("*").alias("df"))
    weighed = tf.join(df, [*group, "term"]).join(sizes, group).select(*group, order, "term", "df", (F.col("tf") * (F.log((1.0 + F.col("n")) / (1.0 + F.col("df"))) + 1.0)).alias("w"))
    if above is not None and above > 0:
        return _pairs_above(weighed, group, order, above)
    norms = weighed.groupBy(*group, order).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    a = weighed.select(*group, "term", F.col(order).alias("a"), F.col("w").alias("wa"))
    b = weighed.select(*group, "term", F.col(order).alias("b"), F.col("w").alias("wb"))
    dots = a.join(b, [*group, "term"]).filter("a < b").groupBy(*group, "a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("dot"))
    dots = dots.join(norms.select(*group, F.col(order).alias("a"), F.col("norm").alias("na")), [*group, "a"])
    dots = dots.join(norms.select(*group, F.col(order).alias("b"), F.col("norm").alias("nb")), [*group, "b"])
    out = dots.select(*group, "a", "b", (F.col("dot") / (F.col("na") * F.col("nb"))).alias("similarity"))
    return out if above is None else out.filter(F.col("similarity") > above)


def _pairs_above(weighed: DataFrame, group: list[str], order: str, above: float) -> DataFrame:
    """The pairs above a positive bound. In the order of terms by df, a text's terms from some place on have a norm below the bound (of
    the whole text's 1): what two texts share there alone is not enough, so similar ones share a term before that place in both."""
    own = Window.partitionBy(*group, order)
    common_first = own.orderBy(F.col("df").desc(), F.col("term").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    square = F.col("w") * F.col("w")
    unit = weighed.withColumns({"norm": F.sqrt(F.sum(square).over(own)), "after": F.sum(square).over(common_first)})
    first = unit.filter(F.col("after") >= (above * above - 1e-9) * F.col("norm") * F.col("norm"))
    side = lambda t, c, *more: t.select(*group, "term", F.col(order).alias(c), *(F.col(x).alias(f"{x}_{c}") for x in more))
    met = side(first, "a").join(side(first, "b"), [*group, "term"]).filter("a < b").select(*group, "a", "b").distinct()
    both = met.join(side(unit, "a", "w", "norm"), [*group, "a"]).join(side(unit, "b", "w", "norm"), [*group, "b", "term"])
    dots = both.groupBy(*group, "a", "b").agg(F.sum(F.col("w_a") * F.col("w_b")).alias("dot"), F.first("norm_a").alias("na"), F.first("norm_b").alias("nb"))
    return dots.select(*group, "a", "b", (F.col("dot") / (F.col("na") * F.col("nb"))).alias("similarity")).filter(F.col("similarity") > above)


def pair_cosine(pairs: DataFrame, keys: list[str], left: str, right: str) -> DataFrame:
    """(keys, cosine) of the two texts of each row, fitted on those two alone; pairs without a common term have no row (cosine 0).
    A term of both weighs its count, a term of one ALONE times it, so no fit and no join are needed."""
    side = lambda c, mark: F.transform(_terms(c), lambda t: F.struct(t.alias("term"), F.lit(mark).alias("side")))
    terms = pairs.select(*keys, F.explode(F.concat(side(left, 0), side(right, 1))).alias("t"))
    count = lambda mark: F.sum((F.col("t.side") == mark).cast("long"))
    both = terms.groupBy(*keys, "t.term").agg(count(0).alias("x"), count(1).alias("y"))
    shared = (F.col("x") > 0) & (F.col("y") > 0)
    weight = lambda c: F.when(shared, F.col(c)).otherwise(F.col(c) * ALONE)
    sums = both.groupBy(*keys).agg(F.sum(weight("x") * weight("y")).alias("dot"), F.sqrt(F.sum(weight("x") * weight("x"))).alias("nx"), F.sqrt(F.sum(weight("y") * weight("y"))).alias("ny"))
    return sums.filter("dot > 0").select(*keys, (F.col("dot") / (F.col("nx") * F.col("ny"))).alias("cosine"))
