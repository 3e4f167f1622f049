"""Running sums and carried values per key, safe when one key holds most rows.

A plain window sends every row of a key through one task. Here keys with more
than ``max_rows`` rows are cut into consecutive blocks of the ordering column
first: the rows are windowed per (key, block), and what a block inherits from
the blocks before it comes from a small per-block table. A block that is still
too full, as in a burst, is cut again in the same way. Rows of one ordering value
that are too many are cut by range of the ties, and then of their place in the table.

The rows are shuffled once, by (key, block). The side tables are small: a key or
block is listed only if it has more than ``max_rows`` rows, so there are at most
rows / max_rows of them. They are counted before they are broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetscope.session import broadcast_if_small, materialize

MAX_ROWS = 4_000_000


def _null_safe_join(left: DataFrame, right: DataFrame, names: Sequence[str]) -> DataFrame:
    """Left join on ``names``, where NULL equals NULL; the right side's copies are dropped."""
    side = right.withColumnsRenamed({name: f"_r_{name}" for name in names})
    match = F.lit(True)
    for name in names:
        match = match & left[name].eqNullSafe(side[f"_r_{name}"])
    return left.join(side, match, "left").drop(*[f"_r_{name}" for name in names])


class OrderedScan:
    """Rows of ``df`` grouped by ``keys`` and ordered by ``order`` then ``ties``.

    ``order`` is one numeric or timestamp column. ``position`` is a number that never falls as ``order`` rises,
    by which blocks are cut; by default ``order`` itself. Methods return a new
    scan; ``frame`` is the result.
    """

    def __init__(
        self,
        df: DataFrame,
        keys: Sequence[str],
        order: str,
        ties: Sequence[str] = (),
        descending: bool = False,
        position: Column | None = None,
        max_rows: int = MAX_ROWS,
    ):
        self._df = df
        self._keys = list(keys)
        self._blocks: list[str] = []
        self._descending = descending
        self._order = [F.col(c).desc() if descending else F.col(c).asc() for c in (order, *ties)]
        self._place = F.struct(*[F.col(c) for c in (order, *ties)])
        if position is None:
            position = F.unix_micros(order) if dict(df.dtypes)[order] == "timestamp" else F.col(order)
        # NULL sorts lowest and NaN highest; infinities are pulled in so that every cut makes progress
        number = F.greatest(F.least(position.cast("double"), F.lit(1e300)), F.lit(-1e300))
        self._position = F.when(position.isNull(), F.lit(-1e300)).otherwise(number)
        while self._cut(max_rows):
            pass
        self._cut_ties(max_rows)

    def _cut(self, max_rows: int) -> bool:
        """Cut the keys, or the last blocks, that hold more than ``max_rows`` rows."""
        by = self._keys + self._blocks
        rows = self._df.where(F.col(self._blocks[-1]).isNotNull()) if self._blocks else self._df
        full = (
            rows.groupBy(*by)
            .agg(F.count(F.lit(1)).alias("_n"), F.min(self._position).alias("_lo"), F.max(self._position).alias("_hi"))
            .where((F.col("_n") > max_rows) & (F.col("_lo") < F.col("_hi")))
            .withColumn("_parts", F.ceil(F.col("_n") / max_rows))
            .select(*by, "_lo", "_parts", ((F.col("_hi") - F.col("_lo")) / F.col("_parts")).alias("_width"))
        )
        full = materialize(full, "full-keys")
        if full.isEmpty():
            return False
        block = f"_block{len(self._blocks)}"
        number = F.least(F.floor((self._position - F.col("_lo")) / F.col("_width")), F.col("_parts") - 1)
        cut = _null_safe_join(self._df, broadcast_if_small(full), by).withColumn(block, number.cast("bigint"))
        self._df = cut.drop("_lo", "_parts", "_width")
        self._blocks.append(block)
        return True

    def _cut_ties(self, max_rows: int) -> None:
        """Cut what is still too full, rows of one value of ``order``: range partitions become blocks.

        Only these rows are sorted and written again; a partition holds about half of ``max_rows``.
        """
        by = self._keys + self._blocks
        rows = self._df.where(F.col(self._blocks[-1]).isNotNull()) if self._blocks else self._df
        full = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > max_rows)
        full = materialize(full, "full-ties")
        total = full.agg(F.sum("_n")).first()[0]
        if not total:
            return
        block = f"_block{len(self._blocks)}"
        marked = _null_safe_join(self._df, broadcast_if_small(full), by)
        tied = marked.where(F.col("_n").isNotNull()).withColumn("_seq", F.monotonically_increasing_id())
        tied = tied.repartitionByRange(-(-2 * total // max_rows), *by, *self._order, "_seq")
        number = F.spark_partition_id() * (-1 if self._descending else 1)
        tied = materialize(tied.withColumn(block, number.cast("bigint")).drop("_n", "_seq"), "cut-ties")
        rest = marked.where(F.col("_n").isNull()).withColumn(block, F.lit(None).cast("bigint")).drop("_n")
        self._df = rest.unionByName(tied)
        self._blocks.append(block)

    def _window(self):
        by = Window.partitionBy(*self._keys, *self._blocks)
        return by.orderBy(*self._order).rowsBetween(Window.unboundedPreceding, 0)

    def _inherited(self, per_block: dict[str, Column], combine) -> DataFrame:
        """The rows plus one column per entry: its combination over the earlier blocks of the key."""
        by = self._keys + self._blocks
        forward = [F.col(b).desc() if self._descending else F.col(b).asc() for b in self._blocks]
        before = Window.partitionBy(*self._keys).orderBy(*forward).rowsBetween(Window.unboundedPreceding, -1)
        blocks = (
            self._df.where(F.col(self._blocks[0]).isNotNull())
            .groupBy(*by)
            .agg(*[value.alias(name) for name, value in per_block.items()])
            .select(*by, *[combine(name).over(before).alias(name) for name in per_block])
        )
        return _null_safe_join(self._df, broadcast_if_small(materialize(blocks, "block-table")), by)

    def _next(self, df: DataFrame) -> OrderedScan:
        scan = object.__new__(OrderedScan)
        scan.__dict__.update(self.__dict__)
        scan._df = df
        return scan

    def running_sum(self, value: Column, out: str) -> OrderedScan:
        """Sum of ``value`` over all rows of the key up to and including this one."""
        local = F.sum(value).over(self._window())
        if not self._blocks:
            return self._next(self._df.withColumn(out, local))
        df = self._inherited({"_carry": F.sum(value)}, F.sum)
        return self._next(df.withColumn(out, F.coalesce("_carry", F.lit(0)) + local).drop("_carry"))

    def total(self, value: Column, out: str) -> OrderedScan:
        """Sum of ``value`` over all rows of the key."""
        local = F.sum(value).over(Window.partitionBy(*self._keys, *self._blocks))
        if not self._blocks:
            return self._next(self._df.withColumn(out, local))
        cut = self._df.where(F.col(self._blocks[0]).isNotNull())
        whole = materialize(cut.groupBy(*self._keys).agg(F.sum(value).alias("_whole")), "totals")
        df = _null_safe_join(self._df, broadcast_if_small(whole), self._keys)
        return self._next(df.withColumn(out, F.coalesce("_whole", local)).drop("_whole"))

    def carry_last(self, **values: Column) -> OrderedScan:
        """Per named value, its latest non-null at or before this row; NULL if none."""
        local = {out: F.last(value, ignorenulls=True).over(self._window()) for out, value in values.items()}
        if not self._blocks:
            return self._next(self._df.withColumns(local))
        latest = F.min_by if self._descending else F.max_by
        per_block = {
            f"_carry_{out}": latest(value, F.when(value.isNotNull(), self._place)) for out, value in values.items()
        }
        df = self._inherited(per_block, lambda name: F.last(name, ignorenulls=True))
        df = df.withColumns({out: F.coalesce(col, F.col(f"_carry_{out}")) for out, col in local.items()})
        return self._next(df.drop(*per_block))

    @property
    def frame(self) -> DataFrame:
        return self._df.drop(*self._blocks)


def exact_percentile(
    df: DataFrame, keys: Sequence[str], value: str, q: float, out: str, max_rows: int = MAX_ROWS
) -> DataFrame:
    """Continuous percentile per key, without holding a key's values in one buffer.

    Equal values are counted on the map side; the two neighbours of the wanted
    position are then found by a running count over the distinct values.
    """
    counts = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).cast("double").alias("_value"))
        .agg(F.count(F.lit(1)).alias("_count"))
    )
    counts = materialize(counts, "value-counts")
    # values are often long-tailed, so blocks are cut on a logarithmic scale
    scale = F.signum("_value") * F.log1p(F.abs("_value"))
    scan = OrderedScan(counts, keys, "_value", position=scale, max_rows=max_rows)
    count = F.col("_count")
    ranked = scan.running_sum(count, "_upto").total(count, "_n").frame.withColumn("_at", (F.col("_n") - 1) * F.lit(q))
    holds = lambda place: (F.col("_upto") - count <= place) & (place < F.col("_upto"))
    low, high = holds(F.floor("_at")), holds(F.ceil("_at"))
    # at most two rows per key go on
    ends = (
        ranked.where(low | high)
        .groupBy(*keys)
        .agg(
            F.max("_at").alias("_at"),
            F.max(F.when(low, F.col("_value"))).alias("_lo"),
            F.max(F.when(high, F.col("_value"))).alias("_hi"),
        )
    )
    share = F.col("_at") - F.floor("_at")
    return ends.select(*keys, (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * share).alias(out))
