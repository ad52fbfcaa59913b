"""Running values over an order, without one task per key.

A window partitioned by key alone puts a key that holds a third of the rows in
one task. Here each key is cut into buckets along the order (a day, a year, an
id range: any column that never decreases along the order). Values inside a
bucket come from a window over (key, bucket); what earlier or later buckets
contribute comes from a small table with one row per (key, bucket). Both sides
are partitioned by (key, bucket), so the carry join shuffles only that table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window

_B = "_bucket"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bucket_width(rows: DataFrame, at: str, task_rows: int = 1_000_000, most: int = 86400) -> int:
    """Seconds of a bucket that holds ``task_rows`` rows on average, a day at most: for orders over a whole table, where a bucket is a task."""
    n, low, high = rows.agg(F.count("*"), F.unix_seconds(F.min(at)), F.unix_seconds(F.max(at))).first()
    return most if not n or low is None else max(1, min(most, int((high - low + 1) * task_rows / n)))


def _with_carry(df: DataFrame, carry: DataFrame, keys: list[str]) -> DataFrame:
    cond = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in [*keys, _B]]
    on = cond[0]
    for c in cond[1:]:
        on = on & c
    drop = [F.col(f"r.{k}") for k in [*keys, _B]]
    return df.alias("l").join(carry.alias("r"), on, "left").drop(*drop)


def running(df: DataFrame, keys: list[str], order: list, bucket, sums: dict | None = None,
            count: str | None = None, maxs: dict | None = None) -> DataFrame:
    """Add inclusive running sums / maxima and a 1-based position (``count``).

    ``sums``/``maxs`` map a new column to the summed column. ``order`` must be a total order.
    """
    sums, maxs = dict(sums or {}), dict(maxs or {})
    df = df.withColumn(_B, _col(bucket))
    if count:
        df = df.withColumn("_one", F.lit(1).cast("bigint"))
        sums[count] = "_one"
    by = [*keys, _B]
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*keys).orderBy(_B).rowsBetween(Window.unboundedPreceding, -1)
    carry = df.groupBy(*by).agg(*[F.sum(_col(c)).alias(f"_c_{n}") for n, c in sums.items()],
                                *[F.max(_col(c)).alias(f"_c_{n}") for n, c in maxs.items()])
    carry = carry.select(*by, *[F.sum(f"_c_{n}").over(earlier).alias(f"_b_{n}") for n in sums],
                         *[F.max(f"_c_{n}").over(earlier).alias(f"_b_{n}") for n in maxs])
    local = df.select("*", *[F.sum(_col(c)).over(w).alias(f"_l_{n}") for n, c in sums.items()],
                      *[F.max(_col(c)).over(w).alias(f"_l_{n}") for n, c in maxs.items()])
    out = _with_carry(local, carry, keys)
    out = out.withColumns({n: F.coalesce(F.col(f"_l_{n}"), F.col(f"_l_{n}") * 0) + F.coalesce(F.col(f"_b_{n}"), F.col(f"_l_{n}") * 0)
                           for n in sums})
    out = out.withColumns({n: F.greatest(F.col(f"_l_{n}"), F.col(f"_b_{n}")) for n in maxs}) if maxs else out
    names = [*sums, *maxs]
    return out.drop(_B, "_one", *[f"_l_{n}" for n in names], *[f"_b_{n}" for n in names])


def neighbours(df: DataFrame, keys: list[str], order: list, bucket, before: dict | None = None,
               after: dict | None = None, where=None) -> DataFrame:
    """Values of the nearest earlier (``before``) / later (``after``) row of the key.

    With ``where`` only rows meeting it count as neighbours (the row itself
    never does); without it this is lag(1) / lead(1).
    """
    before, after = before or {}, after or {}
    src = {**before, **after}
    pack = F.struct(*[_col(c).alias(n) for n, c in src.items()])
    ok = F.lit(True) if where is None else _col(where)
    df = df.withColumns({_B: _col(bucket), "_v": F.when(ok, pack)})
    by = [*keys, _B]
    o = Window.partitionBy(*by).orderBy(*order)
    names = []
    local, ends = {}, {}
    key = F.struct(*[_col(c).alias(f"o{i}") for i, c in enumerate(order)])
    over_buckets = Window.partitionBy(*keys).orderBy(_B)
    if before:
        local["_lb"] = F.last("_v", ignorenulls=True).over(o.rowsBetween(Window.unboundedPreceding, -1))
        ends["_eb"] = F.max_by("_v", F.when(F.col("_v").isNotNull(), key))
        names.append(("_lb", "_eb", F.last("_eb", ignorenulls=True).over(
            over_buckets.rowsBetween(Window.unboundedPreceding, -1)), before))
    if after:
        local["_la"] = F.first("_v", ignorenulls=True).over(o.rowsBetween(1, Window.unboundedFollowing))
        ends["_ea"] = F.min_by("_v", F.when(F.col("_v").isNotNull(), key))
        names.append(("_la", "_ea", F.first("_ea", ignorenulls=True).over(
            over_buckets.rowsBetween(1, Window.unboundedFollowing)), after))
    carry = df.groupBy(*by).agg(*[c.alias(n) for n, c in ends.items()])
    carry = carry.select(*by, *[c.alias(f"{e}x") for _, e, c, _ in names])
    out = _with_carry(df.select("*", *[c.alias(n) for n, c in local.items()]), carry, keys)
    for loc, end, _, cols in names:
        got = F.coalesce(F.col(loc), F.col(f"{end}x"))
        out = out.withColumns({n: got[n] for n in cols})
    return out.drop(_B, "_v", *local, *[f"{e}x" for _, e, _, _ in names])
