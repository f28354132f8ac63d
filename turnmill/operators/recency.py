"""Recency: old turns, or a document's irrelevant chunks, are cut to a few sentences."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..schema import is_system
from . import similarity, tools

PROTECTED = 3
RELEVANT = 0.3


def threshold(aggressiveness: float) -> float:
    return 0.1 + 0.6 * aggressiveness


def scores(turns: DataFrame) -> DataFrame:
    """The turns but system ones, with `score` (place / (n - 1), 1 for one turn) and `from_end` (1: last)."""
    by = Window.partitionBy("conv_id")
    rows = turns.filter(~is_system()).withColumn("_n", F.count("*").over(by)).withColumn("_at", F.row_number().over(by.orderBy("pos")) - 1)
    return rows.withColumn("score", F.when(F.col("_n") == 1, 1.0).otherwise(F.col("_at") / (F.col("_n") - 1))).withColumn("from_end", F.col("_n") - F.col("_at")).drop("_n", "_at")


def queries(turns: DataFrame) -> DataFrame:
    """(conv_id, query): the last user turn's text, or all turns' texts joined by spaces if there is none or it is empty."""
    rows = turns.filter(~is_system()).select("conv_id", "pos", "role", text.of_turn().alias("_own"))
    found = rows.groupBy("conv_id").agg(F.max_by(F.when(F.col("role") == "user", F.col("_own")), F.when(F.col("role") == "user", F.col("pos"))).alias("last"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "_own"))), lambda x: x["_own"]), " ").alias("all"))
    return found.select("conv_id", F.when(F.coalesce("last", F.lit("")) != "", F.col("last")).otherwise(F.col("all")).alias("query"))


def relevance(turns: DataFrame) -> DataFrame:
    """(conv_id, pos, cosine) of turns with the conversation's query; 0 without a common term."""
    rows = turns.filter(~is_system()).select("conv_id", "pos", text.of_turn().alias("_own")).join(queries(turns), "conv_id")
    found = similarity.pair_cosine(rows.filter(~text.blank(F.col("_own")) & ~text.blank(F.col("query"))), ["conv_id", "pos"], "_own", "query")
    return rows.select("conv_id", "pos").join(found, ["conv_id", "pos"], "left").withColumn("cosine", F.coalesce("cosine", F.lit(0.0)))


def target(count: Column) -> Column:
    """Sentences to keep: none up to 3 (no cut), 2 up to 8, else 3."""
    return F.when(count <= 3, None).when(count <= 8, 2).otherwise(3)


def tail(own: Column, keep: Column) -> Column:
    """The last sentences, joined by spaces."""
    parts = text.sentences(own)
    return F.when(F.size(parts) <= keep, own).otherwise(F.array_join(F.slice(parts, F.size(parts) - keep + 1, keep), " "))


def lsa_sentences(parts: list[str], keep: int) -> list[str]:
    """The sentences that score highest by latent semantic analysis (Steinberger and Jezek 2004), in their order: the length of each
    one's vector in the space of the leading topics, weighed by the topics' strengths."""
    import re

    bags = [re.findall(r"\w+", p.lower()) for p in parts]
    vocabulary = {t: k for k, t in enumerate(dict.fromkeys(t for b in bags for t in b))}
    if not vocabulary:
        return parts[:keep]
    matrix = np.zeros((len(vocabulary), len(parts)))
    for j, bag in enumerate(bags):
        for t in bag:
            matrix[vocabulary[t], j] += 1
    top = matrix.max(0)
    matrix = np.where(matrix > 0, 0.4 + 0.6 * matrix / np.where(top > 0, top, 1), 0)
    _, strength, topics = np.linalg.svd(matrix, full_matrices=False)
    topics, strength = topics[: max(3, len(strength))], strength[: max(3, len(strength))]
    score = np.sqrt((topics**2 * (strength**2)[:, None]).sum(0))
    best = sorted(sorted(range(len(parts)), key=lambda k: (-round(score[k], 9), k))[:keep])
    return [parts[k] for k in best]


def lsa(own: Column, keep: Column) -> Column:
    """As `tail`, by latent semantic analysis of each text."""

    def run(parts: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or k is None or k != k else " ".join(lsa_sentences(list(p), int(k))) for p, k in zip(parts, n, strict=True)], dtype=object)

    return F.coalesce(F.pandas_udf(run, "string")(F.when(keep.isNotNull(), text.sentences(own)), keep), own)


def recency(turns: DataFrame, conv_type: str = "chat", aggressiveness: float = 0.5, summarizer: str = "lsa") -> DataFrame:
    """Cuts turns whose score is below the threshold (rag_doc: whose relevance is below RELEVANT); the last PROTECTED turns, structured
    and system turns stay. summarizer: `lsa` or `tail`."""
    rows = scores(turns)
    if conv_type == "rag_doc":
        rows = rows.join(relevance(turns), ["conv_id", "pos"])
        cut = F.col("cosine") < RELEVANT
    else:
        cut = F.col("score") < threshold(aggressiveness)
    chosen = tools.preserved(rows.filter(cut & (F.col("from_end") > PROTECTED)), "_preserved").filter(~F.col("_preserved"))
    chosen = chosen.withColumn("_own", text.of_turn()).withColumn("_keep", target(F.size(text.sentences(F.col("_own"))))).filter("_keep is not null")
    short = {"lsa": lsa, "tail": tail}[summarizer](F.col("_own"), F.col("_keep"))
    made = chosen.select("conv_id", "pos", text.strip(short).alias("_new"))
    out = turns.join(made, ["conv_id", "pos"], "left")
    changed = F.coalesce(F.col("_new") != text.strip(text.of_turn()), F.lit(False))
    return out.withColumns(text.written_back(F.col("_new"), changed)).select(*turns.columns)
