"""The augmentation join with a streaming base table.

The right table is static: it is reduced to one row per key once, written to
the checkpoint folder, and joined stream-static (left outer with the stream on the
left is supported without state or watermarks), so every arriving base row
leaves the join exactly once, widened. This is the same operator as J3.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from widen.functions.columns import as_list, col
from widen.functions.ranking import materialised
from widen.operators.join import in_key_type, left_join_m1, plan_features, reduce_by_key
from widen.sources.tables import TableRef


def augment_stream(stream: DataFrame, table: TableRef | DataFrame, features=None, left_keys=None, right_keys=None,
                   null_keys: str = "never") -> DataFrame:
    """J3 on a streaming ``stream``; ``table`` must be a batch DataFrame."""
    if not stream.isStreaming:
        raise ValueError("augment_stream expects a streaming DataFrame; use augment() for batch")
    right = table.df if isinstance(table, TableRef) else table
    if right.isStreaming:
        raise ValueError("the table to reduce must be static")
    if isinstance(table, TableRef):
        left_keys, right_keys = left_keys or table.left_keys, right_keys or table.right_keys
    lk, rk = as_list(left_keys), as_list(right_keys or left_keys)
    plan = plan_features(stream.columns, right.columns, rk, features)
    if not plan.kept:
        return stream
    typed = in_key_type(stream, right.select(*[col(c) for c in [*rk, *plan.kept]]), lk, rk)
    # every micro-batch joins the reduced rows and never sees the right table
    reduced = materialised(reduce_by_key(typed, rk, plan.kept, keep_null_keys=(null_keys == "match")))
    return left_join_m1(stream, reduced, lk, rk, null_keys=null_keys)
