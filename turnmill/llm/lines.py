r"""Quality rules and cross-document line frequency, with SQL functions only.

Lines (split at \n) are normalised (A-Z lower-cased, white space squeezed) and
hashed; for each host the distinct documents of a line are counted, by the hash
of their text, so copies of one document count once. Lines that stand in more
than `limit` documents of a host, and in more than `share` of them, are taken
out, and a document that keeps less than `least` of its words is rejected.

Counts are summed where the rows are first, so a line in a third of all
documents costs each task one row. Cases: a null text has no words and fails
the base rules; a null host is a host of its own; equal rows are judged alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import blocks

SPACE = r"[\x20\x09-\x0D]"
LIMIT, SHARE, LEAST = 20, 0.001, 0.3


def words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE + "+"), lambda w: w != "")


def _window(i: Column, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), *(F.get(F.col("_words"), i + k) for k in range(3)))


def _beside(column: str, equal) -> Column:
    """For each place of a sorted array, whether the element before or after is equal to it."""
    here = lambda x, i: F.coalesce(F.when(i > 0, equal(x, F.get(F.col(column), i - 1))), F.lit(False)) | F.coalesce(equal(x, F.get(F.col(column), i + 1)), F.lit(False))
    return here


@blocks.helpers("_text", "_words", "_low", "_keys", "_near", "_exact", "_sure")
def with_base(frame: DataFrame, column: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    text = F.coalesce(F.col(column), F.lit(""))
    out = frame.withColumn("_text", text).withColumn("_words", words(F.col("_text")))
    low = F.expr("shiftleft(1L, length(bin(cast(size(_words) as bigint)))) - 1")
    places = F.when(F.size("_words") >= 3, F.sequence(F.lit(0), F.size("_words") - 3)).otherwise(F.array().cast("array<int>"))
    # A window as one long: the high bits of its hash, the low bits its place; sorting brings equal windows together.
    out = out.withColumn("_low", low).withColumn("_keys", F.sort_array(F.transform(places, lambda i: _window(i, 1).bitwiseAND(F.bitwise_not(F.col("_low"))).bitwiseOR(i.cast("long")))))
    like = _beside("_keys", lambda a, b: F.bitwise_not(F.col("_low")).bitwiseAND(a.bitwiseXOR(b)) == 0)
    out = out.withColumn("_near", F.filter(F.transform("_keys", lambda k, i: F.when(like(k, i), k.bitwiseAND(F.col("_low")).cast("int"))), lambda i: i.isNotNull()))
    # Those that look equal are compared again by two whole hashes.
    out = out.withColumn("_exact", F.array_sort(F.transform("_near", lambda i: F.struct(_window(i, 1).alias("h"), _window(i, 2).alias("g"), i.alias("i")))))
    equal = _beside("_exact", lambda a, b: (a["h"] == b["h"]) & (a["g"] == b["g"]))
    out = out.withColumn("_sure", F.sort_array(F.filter(F.transform("_exact", lambda x, i: F.when(equal(x, i), x["i"])), lambda i: i.isNotNull())))
    repeat = F.aggregate(F.transform("_sure", lambda p, i: F.least(F.lit(3), F.coalesce(F.get("_sure", i + 1) - p, F.lit(3))).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    lines = F.filter(F.split("_text", "\n"), lambda x: F.length(F.regexp_replace(x, SPACE + "+", "")) > 0)
    out = out.withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.length(F.regexp_replace("_text", SPACE + "+", "")).cast("long"),
        "n_symbols": F.length(F.regexp_replace("_text", r"[^#*$%&|<>]+", "")).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_repeat_words": repeat,
    })
    out = out.withColumn("base_failed", F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words"))
    return out.drop("_text", "_words", "_low", "_keys", "_near", "_exact", "_sure")


def _lines(frame: DataFrame, column: str, host: str) -> DataFrame:
    """(host, document, line, words) of each line with a word: hashes of the text and of the normalised line."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    squeezed = F.transform(F.split(F.coalesce(F.col(column), F.lit("")), "\n"), lambda x: F.trim(F.regexp_replace(F.translate(x, upper, lower), SPACE + "+", " ")))
    each = F.transform(F.filter(squeezed, lambda x: x != ""), lambda x: F.struct(F.xxhash64(x).alias("line"), F.regexp_count(x, F.lit("[^ ]+")).alias("n")))
    return frame.select(F.col(host).alias("host"), F.xxhash64(column).alias("document"), F.explode(each).alias("x")).select("host", "document", "x.line", "x.n")


def frequent_lines(frame: DataFrame, column: str = "text", host: str = "source", limit: int = LIMIT, share: float = SHARE) -> DataFrame:
    """(host, line, documents) of the lines above both limits."""
    once = _lines(frame, column, host).select("host", "document", "line").distinct()
    counts = once.groupBy("host", "line").agg(F.count("*").alias("documents")).filter(F.col("documents") > limit)
    totals = frame.select(F.col(host).alias("host"), F.xxhash64(column).alias("document")).distinct().groupBy("host").agg(F.count("*").alias("total"))
    return counts.join(totals, counts["host"].eqNullSafe(totals["host"])).filter(F.col("documents") > share * F.col("total")).select(counts["host"], "line", "documents")


def _flagged(frame: DataFrame, column: str, host: str, limit: int, share: float) -> DataFrame:
    """(host, document, line, n, frequent): each document's lines once, with the words they have."""
    lines = _lines(frame, column, host).groupBy("host", "document", "line").agg(F.sum("n").alias("n"))
    often = frequent_lines(frame, column, host, limit, share).select(F.col("host").alias("_host"), F.col("line").alias("_line"))
    return lines.join(often, lines["host"].eqNullSafe(often["_host"]) & (lines["line"] == often["_line"]), "left").withColumn("frequent", F.col("_line").isNotNull()).drop("_host", "_line")


@blocks.helpers("document", "_host", "_document")
def judge(frame: DataFrame, column: str = "text", host: str = "source", limit: int = LIMIT, share: float = SHARE, least: float = LEAST) -> DataFrame:
    """The base columns, and kept: false if base_failed or the document's frequent lines leave it less than `least` of its words."""
    lines = _flagged(frame, column, host, limit, share)
    depleted = lines.groupBy("host", "document").agg(F.sum(F.when(F.col("frequent"), F.col("n")).otherwise(0)).alias("gone"), F.sum("n").alias("all")).filter(F.col("all") - F.col("gone") < least * F.col("all")).select(F.col("host").alias("_host"), F.col("document").alias("_document"))
    base = with_base(frame, column).withColumn("document", F.xxhash64(column)).drop(column)
    out = base.join(depleted, base[host].eqNullSafe(depleted["_host"]) & (base["document"] == depleted["_document"]), "left")
    return out.withColumn("kept", ~F.col("base_failed") & F.col("_document").isNull()).drop("_host", "_document", "document")


@blocks.helpers("_hash", "_host", "_document", "_gone")
def clean(frame: DataFrame, column: str = "text", host: str = "source", limit: int = LIMIT, share: float = SHARE) -> DataFrame:
    """The frame with its frequent lines taken out of the text (a null text stays null)."""
    lines = _flagged(frame, column, host, limit, share).filter("frequent").groupBy("host", "document").agg(F.collect_set("line").alias("_gone")).withColumnsRenamed({"host": "_host", "document": "_document"})
    out = frame.withColumn("_hash", F.xxhash64(column)).join(lines, F.col(host).eqNullSafe(F.col("_host")) & (F.col("_hash") == F.col("_document")), "left")
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    keeps = lambda x: ~F.array_contains(F.col("_gone"), F.xxhash64(F.trim(F.regexp_replace(F.translate(x, upper, lower), SPACE + "+", " "))))
    text = F.when(F.col("_gone").isNull(), F.col(column)).otherwise(F.array_join(F.filter(F.split(column, "\n"), keeps), "\n"))
    return out.withColumn(column, text).drop("_hash", "_host", "_document", "_gone")
