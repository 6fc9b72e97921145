"""Windows over long series that never put a whole series into one task.

A series is cut into time chunks. Row-framed windows run per (series, chunk): each chunk also
receives the rows just before (and after) it that its frames reach, and those borrowed rows are
dropped at the end. Which rows to lend is worked out from row counts per small time block, so
gaps in a series are handled exactly. Running values (sums, maxima, forward fills) are computed
per chunk and carried over from a table with one row per chunk.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from barline.ranks import ranged

CHUNK = "_chunk"
HOME = "_home"
BLOCK = "_block"
ROW = "_row_in_chunk"

DAY = 86_400
HOUR = 3_600
#: Chunks that a fitted grid has at most; its cut points are kept in the plan.
MOST_CHUNKS = 1_024


@dataclass(frozen=True)
class Grid:
    """How a table is laid out: series key, time column and usual seconds between rows.

    ``step`` only sizes the chunks; series with gaps or bursts still give exact results.
    ``tie`` lists extra ordering columns where ``time`` alone is not unique in a series.
    """

    key: tuple[str, ...] = ("series_id",)
    time: str = "ts"
    step: int = DAY
    tie: tuple[str, ...] = ()
    chunk_rows: int = 65_536
    block_rows: int = 4_096
    cuts: tuple[float, ...] = ()

    def fit(self, df: DataFrame, target_rows: int = 2_000_000) -> "Grid":
        """A grid whose chunks hold about ``target_rows`` rows of all long series together.

        For tables whose rows are not on a regular grid (ticks, events). The time quantiles of the
        series longer than one chunk become the chunk borders, however bursty they are and
        wherever in time each of them lies. Only the cut points reach the driver.
        """
        per_key = df.groupBy(*self.key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > target_rows)
        rows = per_key.agg(F.sum("_n").alias("n")).first().n
        if not rows:
            return replace(self, cuts=(float("inf"),))
        fine = 16 * min(-(-rows // target_rows), MOST_CHUNKS)
        keys = per_key.select(*[F.col(c).alias(f"_k_{c}") for c in self.key])
        long = df.join(keys, _all(F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in self.key), "left_semi")
        at = F.unix_micros(F.col(self.time).cast("timestamp")).cast("double")
        probs = [i / fine for i in range(1, fine)]
        row = long.select(F.percentile_approx(at, probs, 100_000).alias("b")).first()
        return replace(
            self, cuts=tuple(sorted(set(row.b))), chunk_rows=target_rows, block_rows=max(1, target_rows // 16)
        )

    def by(self, *extra: str) -> "Grid":
        """The same grid with further key columns."""
        return replace(self, key=self.key + extra)

    def with_block(self, df: DataFrame) -> DataFrame:
        """Add the time block of each row."""
        at = F.col(self.time).cast("timestamp")
        if self.cuts:
            return ranged(df, F.unix_micros(at), list(self.cuts), BLOCK)
        return df.withColumn(BLOCK, F.floor(F.unix_seconds(at) / F.lit(self.step * self.block_rows)).cast("long"))

    def chunk_of_block(self, block: Column) -> Column:
        return F.floor(block / F.lit(max(1, self.chunk_rows // self.block_rows))).cast("long")

    def with_chunk(self, df: DataFrame) -> DataFrame:
        """Add the chunk of each row."""
        return self.with_block(df).withColumn(CHUNK, self.chunk_of_block(F.col(BLOCK))).drop(BLOCK)

    @property
    def order(self) -> list[str]:
        return [self.time, *self.tie]


@dataclass(frozen=True)
class SeriesWindow:
    """Frame factory handed to window functions.

    Aggregates asked for through ``agg`` and ``lag`` become helper columns of the stage, so one
    that several functions share (a count, a mean) is computed once.
    """

    keys: tuple[str, ...]
    order: tuple[str, ...]
    shared: dict = field(default_factory=dict)

    def _share(self, c: Column, frame: tuple, spec: WindowSpec) -> Column:
        name, _ = self.shared.setdefault((str(c), frame), (f"_w{len(self.shared)}", c.over(spec)))
        return F.col(name)

    def agg(self, c: Column, lo: int, hi: int = 0) -> Column:
        """An aggregate over the rows from ``lo`` to ``hi`` (0 is the current row)."""
        return self._share(c, (lo, hi), self.between(lo, hi))

    def lag(self, c: Column, k: int) -> Column:
        return self._share(F.lag(c, k), (), self.spec)

    @property
    def spec(self) -> WindowSpec:
        return Window.partitionBy(*self.keys).orderBy(*self.order)

    def last(self, n: int) -> WindowSpec:
        """The current row and the n-1 rows before it."""
        return self.spec.rowsBetween(-(n - 1), 0)

    def between(self, lo: int, hi: int) -> WindowSpec:
        return self.spec.rowsBetween(lo, hi)


@dataclass(frozen=True)
class Roll:
    """A window function together with the number of rows it reaches back and ahead.

    With ``needs_row`` it finds the row's number within its chunk in the column ``ROW``.
    """

    build: Callable[[SeriesWindow], Column]
    back: int = 0
    ahead: int = 0
    needs_row: bool = False


def _all(conditions) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def with_halo(df: DataFrame, grid: Grid, back: int, ahead: int, counted: DataFrame | None = None) -> DataFrame:
    """Tag rows with their chunk and lend the ``back`` / ``ahead`` neighbouring rows to other chunks.

    A chunk is a run of time blocks with about ``chunk_rows`` rows, so short series stay whole. The
    rows per block are counted on ``counted`` if it is given: a table with the same series and times
    that is cheaper to read, such as the one that ``df`` adds columns to.
    """
    keys = list(grid.key)
    df = grid.with_block(df)
    if back == 0 and ahead == 0:
        return df.withColumn(CHUNK, grid.chunk_of_block(F.col(BLOCK))).withColumn(HOME, F.col(CHUNK)).drop(BLOCK)

    source = df if counted is None else grid.with_block(counted)
    counts = source.groupBy(*keys, BLOCK).agg(F.count(F.lit(1)).alias("_n"))
    by_block = Window.partitionBy(*keys).orderBy(BLOCK)
    blocks = (
        counts.withColumn("_end", F.sum("_n").over(by_block.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("_start", F.col("_end") - F.col("_n"))
        .withColumn(HOME, F.floor(F.col("_start") / F.lit(grid.chunk_rows)).cast("long"))
        .withColumn("_next", F.lead(HOME).over(by_block))
        .withColumn("_prev", F.lag(HOME).over(by_block))
    )
    targets = [F.array(F.col(HOME))]
    if back:
        starts = F.when(F.col("_next") != F.col(HOME), F.col("_next"))
        frame = Window.partitionBy(*keys).orderBy("_end").rangeBetween(0, back - 1)
        blocks = blocks.withColumn("_later", F.collect_list(starts).over(frame))
        targets.append(F.col("_later"))
    if ahead:
        ends = F.when(F.col("_prev") != F.col(HOME), F.col("_prev"))
        frame = Window.partitionBy(*keys).orderBy("_start").rangeBetween(-(ahead - 1), 0)
        blocks = blocks.withColumn("_earlier", F.collect_list(ends).over(frame))
        targets.append(F.col("_earlier"))
    lending = blocks.select(*keys, BLOCK, HOME, F.concat(*targets).alias("_targets"))
    return (
        df.join(lending, [*keys, BLOCK])
        .withColumn(CHUNK, F.explode("_targets"))
        .drop("_targets", BLOCK)
    )


def over_series(
    df: DataFrame,
    grid: Grid,
    *stages: dict[str, Roll | Column],
    keep_chunk: bool = False,
    counted: DataFrame | None = None,
) -> DataFrame:
    """Add window columns stage by stage; a later stage may use the columns of an earlier one.

    All stages share one shuffle and one sort. Plain columns are allowed next to window functions.
    ``counted`` is handed to ``with_halo``.
    """
    back = sum(max((f.back for f in st.values() if isinstance(f, Roll)), default=0) for st in stages)
    ahead = sum(max((f.ahead for f in st.values() if isinstance(f, Roll)), default=0) for st in stages)
    out = with_halo(df, grid, back, ahead, counted)
    numbered_rows = any(f.needs_row for st in stages for f in st.values() if isinstance(f, Roll))
    if numbered_rows:
        spec = SeriesWindow((*grid.key, CHUNK), tuple(grid.order)).spec
        out = out.withColumn(ROW, F.row_number().over(spec).cast("double"))
    for stage in stages:
        w = SeriesWindow((*grid.key, CHUNK), tuple(grid.order))
        built = {name: f.build(w) if isinstance(f, Roll) else f for name, f in stage.items()}
        helpers = dict(w.shared.values())
        out = out.withColumns(helpers).withColumns(built).drop(*helpers)
    if back or ahead:
        out = out.filter(F.col(CHUNK) == F.col(HOME))
    out = out.drop(HOME, ROW)
    return out if keep_chunk else out.drop(CHUNK)


@dataclass(frozen=True)
class Running:
    """A value carried along the whole series: sum, max, min, count, first or last (non-null)."""

    kind: str
    column: Column
    extra: dict = field(default_factory=dict)


def sum_of(c) -> Running:
    return Running("sum", _col(c))


def max_of(c) -> Running:
    return Running("max", _col(c))


def min_of(c) -> Running:
    return Running("min", _col(c))


def last_of(c) -> Running:
    return Running("last", _col(c))


def first_of(c) -> Running:
    return Running("first", _col(c))


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def running(
    df: DataFrame,
    grid: Grid,
    values: dict[str, Running],
    reverse: bool = False,
    keep_chunk: bool = False,
    exclusive: bool = False,
) -> DataFrame:
    """Running values per series, null-skipping, from the start (or from the end with ``reverse``).

    ``exclusive`` leaves the current row out of its own value.
    """
    keys = list(grid.key)
    if CHUNK not in df.columns:
        df = grid.with_chunk(df)
    inputs = {f"_in_{name}": r.column for name, r in values.items()}
    df = df.withColumns(inputs)
    position = F.struct(*grid.order) if grid.tie else F.col(grid.time)

    def pick(name: str, kind: str) -> Column:
        x = F.col(f"_in_{name}")
        at = F.when(x.isNotNull(), position)
        latest = (kind == "last") != reverse
        return F.max_by(x, at) if latest else F.min_by(x, at)

    fold = {"sum": F.sum, "max": F.max, "min": F.min}
    aggs = [
        (fold[r.kind](f"_in_{n}") if r.kind in fold else pick(n, r.kind)).alias(f"_part_{n}")
        for n, r in values.items()
    ]
    parts = df.groupBy(*keys, CHUNK).agg(*aggs)
    by_chunk = Window.partitionBy(*keys).orderBy(F.col(CHUNK).desc() if reverse else F.col(CHUNK))
    before = by_chunk.rowsBetween(Window.unboundedPreceding, -1)

    def fold_over(kind: str, x: str, w: WindowSpec) -> Column:
        if kind in fold:
            return fold[kind](x).over(w)
        return (F.last if kind == "last" else F.first)(F.col(x), ignorenulls=True).over(w)

    carried = parts.select(
        *keys, CHUNK, *[fold_over(r.kind, f"_part_{n}", before).alias(f"_carry_{n}") for n, r in values.items()]
    )
    order = [F.col(c).desc() if reverse else F.col(c) for c in grid.order]
    local = Window.partitionBy(*keys, CHUNK).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, -1 if exclusive else 0
    )
    combine = {
        "sum": lambda a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b),
        "max": lambda a, b: F.greatest(a, b),
        "min": lambda a, b: F.least(a, b),
        "last": lambda a, b: F.coalesce(b, a),
        "first": lambda a, b: F.coalesce(a, b),
    }
    out = df.join(carried, [*keys, CHUNK])
    out = out.withColumns(
        {
            n: combine[r.kind](F.col(f"_carry_{n}"), fold_over(r.kind, f"_in_{n}", local))
            for n, r in values.items()
        }
    )
    out = out.drop(*inputs, *[f"_carry_{n}" for n in values])
    return out if keep_chunk else out.drop(CHUNK)


def numbered(df: DataFrame, grid: Grid, name: str = "row_no", descending: bool = False) -> DataFrame:
    """Number the rows of each series from 1."""
    return running(df, grid, {name: sum_of(F.lit(1).cast("long"))}, reverse=descending)
