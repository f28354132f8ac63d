"""Budget: oldest turns go until the tokens fit.

The greedy loop has a closed form: with the tool groups that do not touch the
last two turns in order of their first turn, a group goes exactly if what is left
without the groups before it is still above the budget. So prefix sums over one
window decide every turn.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import jsonops, text
from ..functions.tokens import Counter
from ..schema import is_system
from . import tools

PROTECTED = 2


def counted(turns: DataFrame, counter: Counter | None = None) -> DataFrame:
    """Adds `tokens` of role, line end, text and tool calls."""
    counter = counter or Counter()
    rows = turns.withColumn("_calls", F.coalesce(jsonops.call_payload()(F.col("tool_calls_json")), F.lit("")))
    own = F.when(F.col("blocks").isNull(), F.coalesce("content", F.lit(""))).otherwise(text.of_turn())
    body = F.when(F.col("_calls") == "", own).when(own == "", F.col("_calls")).otherwise(F.concat_ws("\n", own, "_calls"))
    return rows.withColumn("tokens", counter.count(F.concat(F.coalesce("role", F.lit("")), F.lit("\n"), body))).drop("_calls")


def evictions(turns: DataFrame, limit: int) -> DataFrame:
    """Turns with tokens, with `evicted`, and `over`: whether what stays is still above the limit."""
    by = Window.partitionBy("conv_id")
    rows = tools.with_groups(turns)
    place = F.row_number().over(by.orderBy(is_system().cast("int"), F.col("pos").desc()))
    rows = rows.withColumn("_last", (place <= PROTECTED) & ~is_system())
    rows = rows.withColumn("_fixed", F.max((F.col("_last") | is_system()).cast("int")).over(Window.partitionBy("conv_id", "tool_group")))
    rows = rows.withColumn("_total", F.sum("tokens").over(by))
    free = F.when(F.col("_fixed") == 0, F.col("tokens")).otherwise(0)
    before = Window.partitionBy("conv_id").orderBy("tool_group").rangeBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_before", F.coalesce(F.sum(free).over(before), F.lit(0)))
    rows = rows.withColumn("evicted", (F.col("_fixed") == 0) & (F.col("_total") - F.col("_before") > limit))
    left = F.sum(F.when(~F.col("evicted"), F.col("tokens"))).over(by)
    return rows.withColumn("over", left > limit).withColumn("left", left).drop("_last", "_fixed", "_total", "_before", "tool_group", "tool_group_size")


def budget(turns: DataFrame, limit: int, counter: Counter | None = None) -> DataFrame:
    """Without the evicted turns; where nothing more can go, system turns are cut to the room that is left, at least one token each."""
    counter = counter or Counter()
    rows = evictions(counted(turns, counter), limit).filter(~F.col("evicted"))
    fits = rows.filter(~F.col("over") | ~is_system())
    cut = rows.filter(F.col("over") & is_system())
    path = counter.path
    schema = cut.schema

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        from ..functions import tokens

        pdf = pdf.sort_values("pos").reset_index(drop=True)
        left = int(pdf["left"].iloc[0])
        count = (lambda t: -(-len(t) // 4)) if path is None else (lambda t: len(tokens.encoding(path).encode_ordinary(t)))
        first = (lambda t, n: t[: 4 * n]) if path is None else (lambda t, n: tokens.encoding(path).decode(tokens.encoding(path).encode_ordinary(t)[:n]))
        for i in pdf.index:
            own, body = int(pdf.at[i, "tokens"]), pdf.at[i, "content"] or ""
            room = max(1, limit - (left - own))
            if count(body) > room:
                pdf.at[i, "original_content"] = pdf.at[i, "original_content"] or body
                pdf.at[i, "content"], pdf.at[i, "compressed"] = first(body, room), True
                left += count(f"system\n{pdf.at[i, 'content']}") - own
        return pdf

    # Only system turns of conversations that cannot fit come here, a few for each.
    return fits.unionByName(cut.groupBy("conv_id").applyInPandas(run, schema)).select(*turns.columns)


def warnings(before: Column, after: Column, limit: int) -> Column:
    """The removal warning, or null."""
    gone = before - after
    return F.when(gone > 0, F.format_string("token budget enforced - %d turns removed to fit %d tokens", gone, F.lit(limit)))
