"""Tool groups: an assistant turn with calls and the results that follow it, as islands of a window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import jsonops
from ..schema import is_result


def with_groups(turns: DataFrame) -> DataFrame:
    """Adds `tool_group`, the pos of the group's first turn, and `tool_group_size`. A result joins the last turn that is no result if
    that is an assistant turn with call ids and no result in between, itself included, names another id."""
    by = Window.partitionBy("conv_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    out = turns.withColumn("_ids", F.when(F.col("role").eqNullSafe("assistant"), jsonops.call_ids()(F.col("tool_calls_json"))))
    out = out.withColumn("_head", F.max(F.when(~F.coalesce(is_result(), F.lit(False)), F.struct("pos", "_ids"))).over(by))
    run = Window.partitionBy("conv_id", F.col("_head.pos")).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    strange = F.coalesce(is_result(), F.lit(False)) & F.col("tool_call_id").isNotNull() & ~F.coalesce(F.array_contains("_head._ids", F.col("tool_call_id")), F.lit(False))
    out = out.withColumn("_broken", F.max(strange.cast("int")).over(run))
    joins = F.coalesce(is_result(), F.lit(False)) & (F.coalesce(F.size("_head._ids"), F.lit(0)) > 0) & (F.col("_broken") == 0)
    out = out.withColumn("tool_group", F.when(joins, F.col("_head.pos")).otherwise(F.col("pos")))
    return out.withColumn("tool_group_size", F.count("*").over(Window.partitionBy("conv_id", "tool_group"))).drop("_ids", "_head", "_broken")


def preserved(turns: DataFrame, name: str = "preserved") -> DataFrame:
    """Adds whether a turn's text must not be summarised or dropped: it is a tool's, or holds JSON."""
    from ..functions import text

    own = text.of_turn()
    return turns.withColumn(f"_json_{name}", jsonops.is_json()(own)).withColumn(name, text.tool_marked() | text.structured(own, F.coalesce(f"_json_{name}", F.lit(False)))).drop(f"_json_{name}")
