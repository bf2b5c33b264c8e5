"""Exact k-th smallest values by repeated histogram refinement.

No sort and no shuffle of rows: a pass counts, for every column at once, how
many values fall in each of 1,024 cells of the interval that is known to hold
the wanted rank, with the least and greatest value of each cell. The cell that
holds the rank is the next interval. Tasks sum their cells before the shuffle,
so a pass moves at most cells x columns rows per task, and a value that a third
of the rows hold is one cell. Rows outside the interval are only passed over.

Cells are of equal width where the ends of an interval are alike, and of equal
width in the logarithm where they are not, so that outliers cost one pass and
not one per factor of 1,024; a value needs seven passes at most, and two to four
on columns of usual data.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CELLS = 1024
_GREATEST = 1.7976931348623157e308


@dataclass
class _Search:
    """One wanted rank: the value is in [low, high], behind ``below`` smaller ones."""

    column: str
    rank: int
    low: float
    high: float
    below: int = 0

    @property
    def found(self) -> bool:
        return self.low == self.high

    @property
    def mode(self) -> str:
        low, high = max(self.low, -_GREATEST), min(self.high, _GREATEST)
        if high - low <= CELLS * math.ulp(max(abs(low), abs(high))) or low == high:
            return "value"  # few doubles are left: each is a cell
        if low < 0 < high or low * high == 0 or not 0.25 <= low / high <= 4 or math.isinf(high - low):
            return "log"
        return "linear"


def _log(x: Column) -> Column:
    """Increases with x over all doubles, with steps of about a power of two."""
    return F.signum(x) * F.log2(F.lit(1.0) + F.abs(x) * F.lit(2.0**60))


def _log_of(x: float) -> float:
    return math.copysign(math.log2(1.0 + abs(x) * 2.0**60), x) if abs(x) < 2.0**960 else math.copysign(
        math.log2(abs(x)) + 60, x)


def _cell(s: _Search, x: Column) -> Column:
    """Number of the cell of x; never decreases with x."""
    if s.mode == "value":
        return F.lit(None).cast("int")
    low, high = max(s.low, -_GREATEST), min(s.high, _GREATEST)
    x = F.greatest(F.least(x, F.lit(_GREATEST)), F.lit(-_GREATEST))
    if s.mode == "log":
        # halves of the exponent range, so that nothing overflows
        a, b = _log_of(low), _log_of(high)
        big = F.abs(x) >= F.lit(2.0**960)
        g = F.when(big, F.signum(x) * (F.log2(F.abs(x)) + F.lit(60.0))).otherwise(_log(x))
        share = (g - F.lit(a)) / F.lit(b - a)
    else:
        share = (x - F.lit(low)) / F.lit(high - low)
    return F.greatest(F.lit(0), F.least(F.lit(CELLS - 1), F.floor(share * CELLS))).cast("int")


def kth_smallest(df: DataFrame, columns: dict[str, Column], ranks) -> dict[str, list[float | None]]:
    """Values at the ranks that ``ranks(count)`` gives (from 1) of each column.

    ``columns`` maps names to numeric expressions; nulls and NaN do not count;
    a column without values, and a rank beyond its count, give None. Runs jobs
    at call time; what reaches the driver is columns x ranks x cells rows.
    """
    names = list(columns)
    if not names:
        return {}
    values = df.select(*[F.when(~F.isnan(e := columns[c].cast("double")), e).alias(f"c{i}") for i, c in enumerate(names)])
    one = values.agg(*[f(f"c{i}").alias(f"{n}{i}") for i in range(len(names))
                       for n, f in (("n", F.count), ("l", F.min), ("h", F.max))]).first()
    wanted, searches = {}, []
    for i, c in enumerate(names):
        wanted[c] = list(ranks(one[f"n{i}"]))
        for r in sorted({r for r in wanted[c] if 1 <= r <= one[f"n{i}"]}):
            searches.append(_Search(c, r, one[f"l{i}"], one[f"h{i}"]))
    while True:
        # searches of one column in the same interval share its cells
        todo = list({(s.column, s.low, s.high): s for s in searches if not s.found}.values())
        if not todo:
            break
        rows = []
        for t, s in enumerate(todo):
            x = F.col(f"c{names.index(s.column)}")
            inside = x.between(F.lit(s.low), F.lit(s.high))
            # -0.0 and 0.0 are one value
            rows.append(F.when(inside, F.struct(F.lit(t).alias("t"), _cell(s, x).alias("cell"), (x + F.lit(0.0)).alias("x"))))
        long = values.select(F.explode(F.filter(F.array(*rows), lambda r: r.isNotNull())).alias("r")).select("r.*")
        by_value = F.when(F.col("cell").isNull(), F.col("x"))
        cells = (long.groupBy("t", "cell", by_value.alias("value"))
                 .agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("low"), F.max("x").alias("high")).collect())
        of = {}
        for r in sorted(cells, key=lambda r: (r.t, r.low)):
            of.setdefault(r.t, []).append(r)
        at = {(s.column, s.low, s.high): of[t] for t, s in enumerate(todo)}
        for s in searches:
            if s.found:
                continue
            for r in at[s.column, s.low, s.high]:
                if s.below + r.n >= s.rank:
                    s.low, s.high = r.low, r.high
                    break
                s.below += r.n
    got = {(s.column, s.rank): s.low for s in searches}
    return {c: [got.get((c, r)) for r in wanted[c]] for c in names}


def medians(df: DataFrame, columns: dict[str, Column]) -> dict[str, float | None]:
    """Exact interpolated medians, None for columns without values."""
    both = kth_smallest(df, columns, lambda n: ((n + 1) // 2, n // 2 + 1))
    return {c: None if low is None else low + (high - low) * 0.5 if math.isfinite(high - low) else (low + high) * 0.5
            for c, (low, high) in both.items()}


# Digits of an md5 in hex that a double holds exactly, from the first on.
_HEX_PARTS = ((1, 13), (14, 13), (27, 6))


def smallest_by_hash(df: DataFrame, digest: Column, n: int) -> DataFrame:
    """The ``n`` rows with the smallest md5 ``digest`` (hex), found by the n-th
    digest, without a sort. Of rows with that very digest, as many as are wanted
    are taken in the order in which tasks hold them."""
    parts = [F.conv(F.substring(digest, a, k), 16, 10).cast("double") for a, k in _HEX_PARTS]
    if n <= 0:
        return df.limit(0)
    keep, tied, left = F.lit(False), F.lit(True), n
    for p in parts:
        own = df.filter(tied)
        cut = kth_smallest(own, {"p": p}, lambda count, k=left: (k,))["p"][0]
        if cut is None:  # fewer rows than wanted
            return df.filter(keep | tied)
        keep, tied = keep | (tied & (p < cut)), tied & (p == cut)
        sizes = own.agg(F.count_if(p < cut).alias("below"), F.count_if(p == cut).alias("at")).first()
        left -= sizes["below"]
        if sizes["at"] <= left:
            return df.filter(keep | tied)
    return df.filter(keep).unionByName(_first_rows(df.filter(tied), left))


def _first_rows(df: DataFrame, n: int) -> DataFrame:
    """Any ``n`` rows: whole partitions first, then a part of one."""
    from widen.functions.ranking import materialised

    numbered = materialised(df).withColumn("__m", F.monotonically_increasing_id())
    part, place = F.shiftright("__m", 33), F.col("__m").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = sorted(numbered.groupBy(part.alias("p")).count().collect())  # a row a partition
    quota, left = {}, n
    for p, count in sizes:
        quota[p] = min(count, left)
        left -= quota[p]
    allowed = F.create_map(*[F.lit(v) for p, k in quota.items() if k for v in (p, k)])
    return numbered.filter(place < F.coalesce(F.try_element_at(allowed, part), F.lit(0))).drop("__m")
