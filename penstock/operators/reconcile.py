"""Line totals that meet the printed total: all ways are counted exactly, by meeting in the middle."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

# Tolerance in money and as a share, and the bounds of the search.
ABS_TOL, PCT_TOL, MAX_FREE, MAX_COMBINATIONS = "0.05", "0.006", 16, 100_000
_FOUND = StructType([StructField("ways", IntegerType()), StructField("off", LongType()), StructField("choice", ArrayType(IntegerType()))])


def cents(x: Column) -> Column:
    """An amount in cents, halves to the even one."""
    return (F.bround(x.cast("decimal(24,8)"), 2) * 100).cast("bigint")


def _divided(total: Column, quantity: Column) -> Column:
    """Cents of total / quantity (in hundredths), halves to the even one."""
    n = total * 100
    rest = F.pmod(n, quantity)
    low = F.call_function("div", n - rest, quantity)
    return low + F.when((2 * rest > quantity) | ((2 * rest == quantity) & (F.pmod(low, F.lit(2)) == 1)), 1).otherwise(0)


def adjustable(lines: DataFrame) -> DataFrame:
    """lines: fact_id, line, quantity, unit_price, total_price. total, q (hundredths) and options in cents: the total, the unit price, and the total divided by the quantity, each once. Lines without a total are left out; a quantity of zero or less, or none, is one."""
    q = cents(F.col("quantity"))
    x = lines.select("fact_id", "line", cents(F.col("total_price")).alias("total"), cents(F.col("unit_price")).alias("unit"), F.when(q > 0, q).otherwise(100).alias("q")).where("total is not null")
    undo = F.when(F.col("q") != 100, _divided(F.col("total"), F.col("q")))
    return x.select("fact_id", "line", "total", "q", F.array_distinct(F.array_compact(F.array("total", "unit", undo))).alias("options"))


def _sums(options: list[list[int]]):
    """All sums of one option each; the first line's option changes slowest."""
    import numpy as np

    s = np.zeros(1, np.int64)
    for o in options:
        s = (s[:, None] + np.array(o, np.int64)[None, :]).ravel()
    return s


def _choice(at: int, options: list[list[int]]) -> list[int]:
    out = []
    for o in reversed(options):
        at, k = divmod(at, len(o))
        out.append(k)
    return out[::-1]


def ways(options: list[list[int]], target: int, tol: int) -> tuple[int, int, list[int] | None]:
    """How many choices come within tol of the target (2: several), how far off the best is, and the choice if there is one."""
    import numpy as np

    half = len(options) // 2
    a, b = _sums(options[:half]), _sums(options[half:])
    order = np.argsort(b, kind="stable")
    b = b[order]
    want = target - a
    lo, hi = np.searchsorted(b, want - tol, "left"), np.searchsorted(b, want + tol, "right")
    near = np.searchsorted(b, want)
    off = np.minimum(np.abs(want - b[np.minimum(near, len(b) - 1)]), np.abs(want - b[np.maximum(near - 1, 0)])).min()
    n = int((hi - lo).sum())
    if n != 1:
        return min(n, 2), int(off), None
    i = int(np.flatnonzero(hi > lo)[0])
    return 1, int(off), _choice(i, options[:half]) + _choice(int(order[lo[i]]), options[half:])


def _search(options: pa.Array, target: pa.Array, tol: pa.Array) -> pa.Array:
    found = [ways(o, t, m) for o, t, m in zip(options.to_pylist(), target.to_pylist(), tol.to_pylist(), strict=True)]
    return pa.StructArray.from_arrays([pa.array([f[0] for f in found], pa.int32()), pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.list_(pa.int32()))], names=["ways", "off", "choice"])


_search.__annotations__ = {"options": pa.Array, "target": pa.Array, "tol": pa.Array, "return": pa.Array}
search = F.arrow_udf(_search, _FOUND)


def plans(lines: DataFrame, printed: DataFrame, max_free: int = MAX_FREE, max_combinations: int = MAX_COMBINATIONS) -> DataFrame:
    """lines: see adjustable(); printed: fact_id, printed_total. Per fact with a printed total and a line: reason, reconciles, old_sum, new_sum and the new totals of its free lines (line, total, new; in cents).

    Only a single way to meet the total within the tolerance is taken; several, none, or too many lines to choose from are told as the reason. Lines are counted before they are gathered, so a fact gathers max_free lines at most."""
    x = adjustable(lines)
    n = F.size("options")
    counts = x.groupBy("fact_id").agg(
        F.count(F.when(n > 1, 1)).alias("free"),
        F.coalesce(F.sum(F.when(n > 1, F.log(n.cast("double")))), F.lit(0.0)).alias("combinations"),
        F.coalesce(F.sum(F.when(n == 1, F.col("total"))), F.lit(0)).alias("fixed"),
        F.sum("total").alias("old_sum"),
    )
    target = printed.where("printed_total is not null").select("fact_id", cents(F.col("printed_total")).alias("printed"), cents(F.bround(F.bround(F.col("printed_total").cast("decimal(24,8)"), 2) * F.lit(PCT_TOL).cast("decimal(9,6)"), 2)).alias("share"))
    f = counts.join(target, "fact_id")
    too_many = F.col("combinations") > F.log(F.lit(max_combinations + 0.5))
    reason = F.when(F.col("free") == 0, "no adjustable lines").when(F.col("free") > max_free, "too ambiguous").when(too_many, "too many combinations")
    f = f.withColumn("reason", reason).withColumn("tol", F.greatest(F.col("share"), cents(F.lit(ABS_TOL))))
    open_facts = f.where("reason is null").select("fact_id", "printed", "fixed", "tol")
    free = x.where(n > 1).join(open_facts, "fact_id").groupBy("fact_id", "printed", "fixed", "tol").agg(F.sort_array(F.collect_list(F.struct("line", "total", "options"))).alias("free_lines"))
    solved = free.withColumn("found", search(F.transform("free_lines", lambda r: r["options"]), F.col("printed") - F.col("fixed"), F.col("tol")))
    fresh = F.transform("free_lines", lambda r, i: F.struct(r["line"].alias("line"), r["total"].alias("total"), F.get(r["options"], F.get(F.col("found.choice"), i)).alias("new")))
    solved = solved.select("fact_id", "found.ways", F.when(F.col("found.ways") == 1, fresh).alias("chosen"))
    out = f.join(solved, "fact_id", "left")
    changed = F.exists("chosen", lambda r: r["new"] != r["total"])
    told = F.coalesce("reason", F.when(F.col("ways") == 0, "none fits").when(F.col("ways") > 1, "ambiguous").when(changed, "reconciled").otherwise("already reconciled"))
    moved = F.aggregate("chosen", F.lit(0).cast("bigint"), lambda a, r: a + r["new"] - r["total"])
    out = out.withColumn("reason", told).withColumn("reconciles", F.col("reason") == "reconciled")
    new_sum = F.col("old_sum") + F.when(F.col("reconciles"), moved).otherwise(0)
    return out.select("fact_id", "reconciles", "reason", (F.col("printed") / 100).alias("printed_total"), (F.col("old_sum") / 100).alias("old_sum"), (new_sum / 100).alias("new_sum"), F.when(F.col("reconciles"), F.col("chosen")).alias("chosen"))


def fixes(lines: DataFrame, planned: DataFrame) -> DataFrame:
    """fact_id, line, old_total, new_total and new_unit of every line that a plan changes."""
    new = planned.where("reconciles").select("fact_id", F.explode("chosen").alias("c")).select("fact_id", "c.*").where("new <> total")
    x = adjustable(lines).select("fact_id", "line", "q")
    return new.join(x, ["fact_id", "line"]).select("fact_id", "line", (F.col("total") / 100).alias("old_total"), (F.col("new") / 100).alias("new_total"), (_divided(F.col("new"), F.col("q")) / 100).alias("new_unit"))


def apply_fixes(lines: DataFrame, fixed: DataFrame) -> DataFrame:
    """lines with the new totals and unit prices."""
    new = fixed.select("fact_id", "line", "new_total", "new_unit")
    pick = lambda a, b: F.coalesce(F.col(a), F.col(b)).alias(b)
    return lines.join(new, ["fact_id", "line"], "left").select(*[pick("new_total", c) if c == "total_price" else pick("new_unit", c) if c == "unit_price" else F.col(c) for c in lines.columns])
