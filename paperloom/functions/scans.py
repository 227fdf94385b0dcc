"""Running values over an ordered group that may be far too big for one task.

A plain window sorts a whole group inside one task. Here a group is cut into blocks of
its order column: each (group, block) is scanned on its own, one summary row per block
is scanned per group, and the two are added up. A group that holds a third of a table
is therefore spread over as many tasks as it has blocks.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from .staging import staged


@dataclass(frozen=True)
class Running:
    """One running value.

    ``kind``: ``sum``, ``max`` or ``last`` (last non-null). ``inclusive=False`` leaves out
    the current row. For ``last`` the value may be a struct, so several columns can be
    carried at once.
    """

    kind: str
    value: Column
    inclusive: bool = True


def running(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    block: Column,
    specs: dict[str, Running],
    reverse: bool = False,
) -> DataFrame:
    """Add one column per entry of ``specs``.

    ``block`` must not decrease along ``order`` (for example ``floor(line_no / 1000)``).
    ``reverse=True`` scans from the end, so ``last`` becomes "next".
    """
    values = {name: f"__v_{name}" for name in specs}
    # Rows and summaries are two readers: the input is written once, so chained scans don't multiply it.
    rows = staged(df.withColumns({"__block": block, **{values[name]: spec.value for name, spec in specs.items()}}), "scan")

    def direction(name: str) -> Column:
        return F.col(name).desc() if reverse else F.col(name).asc()

    local = Window.partitionBy(*keys, "__block").orderBy(*[direction(c) for c in order])
    blocks = Window.partitionBy(*keys).orderBy(direction("__block"))
    before = (Window.unboundedPreceding, -1)
    upto = (Window.unboundedPreceding, Window.currentRow)
    position = F.struct(*[F.col(c) for c in order])

    summaries, carried = [], []
    out = rows
    for name, spec in specs.items():
        v = F.col(values[name])
        scope = local.rowsBetween(*(upto if spec.inclusive else before))
        edge = F.min_by if reverse else F.max_by
        if spec.kind == "sum":
            summaries.append(F.sum(v).alias(f"__s_{name}"))
            over = F.sum
            out = out.withColumn(name, F.sum(v).over(scope))
        elif spec.kind == "max":
            summaries.append(F.max(v).alias(f"__s_{name}"))
            over = F.max
            out = out.withColumn(name, F.max(v).over(scope))
        elif spec.kind == "last":
            summaries.append(edge(v, F.when(v.isNotNull(), position)).alias(f"__s_{name}"))

            def over(c: Column) -> Column:
                return F.last(c, ignorenulls=True)

            out = out.withColumn(name, F.last(v, ignorenulls=True).over(scope))
        else:
            raise ValueError(f"unknown running kind: {spec.kind}")
        carried.append(over(F.col(f"__s_{name}")).over(blocks.rowsBetween(*before)).alias(f"__c_{name}"))

    earlier = rows.groupBy(*keys, "__block").agg(*summaries).select(*keys, "__block", *carried)
    # Null keys are groups too.
    renamed = earlier.withColumnsRenamed({k: f"__k_{k}" for k in [*keys, "__block"]})
    same = [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in [*keys, "__block"]]
    out = out.join(renamed, reduce(lambda a, b: a & b, same), "left")
    for name, spec in specs.items():
        here, prior = F.col(name), F.col(f"__c_{name}")
        if spec.kind == "sum":
            merged = F.coalesce(here, F.lit(0)) + F.coalesce(prior, F.lit(0))
        elif spec.kind == "max":
            merged = F.greatest(here, prior)
        else:
            merged = F.coalesce(here, prior)
        out = out.withColumn(name, merged)
    return out.select(*df.columns, *specs)
