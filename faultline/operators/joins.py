"""Key merge of two tables with the rules of a data-frame merge."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.errors import DataError


def merge_tables(left: DataFrame, right: DataFrame, key: str, how: str = "left") -> DataFrame:
    """left / right / inner / outer merge; NULL keys match, shared columns get _x and _y.

    Built from an inner join, which adaptive execution can split on a hot key of either side,
    plus anti joins for the rows without a partner. Those look only at the distinct keys of the
    other side, so no hot key ends up in one task, which a full outer join could not avoid. Each of
    these joins reads its sides anew; store a side that is costly to make.
    """
    for side, name in ((left, "primary"), (right, "secondary")):
        if key not in side.columns:
            raise DataError(f"join key '{key}' is missing from the {name} table")
    if how not in ("left", "right", "inner", "outer"):
        raise DataError(f"unknown merge '{how}'")
    shared = (set(left.columns) & set(right.columns)) - {key}
    l = left.select(*[F.col(c).alias(f"{c}_x" if c in shared else c) for c in left.columns])
    r = right.select(F.col(key).alias("_key"),
                     *[F.col(c).alias(f"{c}_y" if c in shared else c) for c in right.columns if c != key])
    columns = [*l.columns, *[c for c in r.columns if c != "_key"]]
    on = F.col(key).eqNullSafe(F.col("_key"))
    parts = [l.join(r, on, "inner").select(*columns)]
    if how in ("left", "outer"):
        parts.append(l.join(r.select("_key").distinct(), on, "left_anti"))
    if how in ("right", "outer"):
        parts.append(r.join(l.select(key).distinct(), on, "left_anti").withColumnRenamed("_key", key))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).select(*columns)
