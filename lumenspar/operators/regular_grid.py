"""Irregular readings onto a regular grid.

Each pair of consecutive readings of a key is one interval. A cumulative counter's increment over the interval (the
reading itself after a reset) is spread over the grid cells in proportion to their overlap with the interval; a gauge is
averaged per cell and interpolated or carried into cells without a reading. Cells without a reading are marked.

Readings are shuffled once, by key and segment of time, so a hot key is split before anything meets it. What a segment
needs from outside comes on one row per key and segment: its source's step and kind, and the first reading of the next
segment, which ends the interval of its last reading.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _floor_div(a: Column, b: Column) -> Column:
    return ((a - F.pmod(a, b)) / b).cast("bigint")


def _slots(first: Column, last: Column, chunk: int = 4096) -> tuple[Column, Column]:
    """Starts of the chunks of first..last and the width of a chunk less one: a long hole never becomes one long array."""
    return F.sequence(first, last, F.lit(chunk).cast("bigint")), F.lit(chunk - 1)


def interval_pairs(readings: DataFrame, sources: DataFrame, key: str, t: str, v: str, step_ms: str, kind: str, first_by: tuple[str, ...] = (), segment_ms: int = 21_600_000) -> DataFrame:
    """(k, step, kind, t, v, slot, nt, nv, nslot): each reading with the next one of its key, null for the last."""
    of = readings.schema[key].dataType.simpleString()
    none = F.lit("" if of == "string" else 0).cast(of)
    by = ["k", "no_key", "seg"]  # a null key is a key of its own, and equal to itself in joins
    keyed = [F.coalesce(F.col(key), none).alias("k"), F.col(key).isNull().alias("no_key")]
    base = readings.select(*keyed, F.col(t).cast("bigint").alias("t"), F.nanvl(F.col(v).cast("double"), F.lit(None)).alias("v"), *(F.col(c).alias(f"by_{i}") for i, c in enumerate(first_by))).where("t is not null and v is not null")
    base = base.withColumn("seg", _floor_div(F.col("t"), F.lit(segment_ms).cast("bigint"))).repartition(*by)
    if first_by:
        base = base.groupBy(*by, "t").agg(F.min_by("v", F.struct(*(f"by_{i}" for i in range(len(first_by))), "v")).alias("v"))
    w = Window.partitionBy(*by).orderBy("t", "v")
    inner = base.select(*by, "t", "v", F.lead("t").over(w).alias("nt"), F.lead("v").over(w).alias("nv"))
    src = sources.select(*keyed, F.col(step_ms).cast("bigint").alias("step"), F.col(kind).alias("kind")).where("step > 0").dropDuplicates(["k", "no_key"])
    heads = base.groupBy(*by).agg(F.min(F.struct("t", "v")).alias("h")).join(src, ["k", "no_key"])
    heads = heads.select(*by, "step", "kind", F.lead("h").over(Window.partitionBy("k", "no_key").orderBy("seg")).alias("h"))
    pairs = inner.join(heads, by).withColumns({"nv": F.when(F.col("nt").isNull(), F.col("h.v")).otherwise(F.col("nv")), "nt": F.coalesce("nt", "h.t")})
    slot = lambda c: _floor_div(F.col(c), F.col("step"))
    return pairs.select(F.when(~F.col("no_key"), F.col("k")).alias("k"), "step", "kind", "t", "v", slot("t").alias("slot"), "nt", "nv", slot("nt").alias("nslot"))


def regular_grid(readings: DataFrame, sources: DataFrame, key: str, t: str = "t", v: str = "v", step_ms: str = "step_ms", kind: str = "kind", fill: str = "linear", first_by: tuple[str, ...] = (), segment_ms: int = 21_600_000) -> DataFrame:
    """One row per key and grid cell between the cells of its first and last reading.

    kind 'counter' is cumulative; anything else (null too) is a gauge. Columns: <key>, slot_start, status ('observed' or
    'missing'), n (readings in the cell), value (gauge: mean of the cell's readings; missing cells by `fill`: 'linear'
    between the readings around the hole, 'last' or 'null'), increment (counter: share of the increments that overlap
    the cell; a fall is a reset and the reading after it counts from zero).

    readings: key, t, v. sources: step and kind, one row per key (of repeated ones any counts; keys without a source or
    with a step that isn't positive have no grid). Rows with a null or NaN value or a null t are ignored. Of rows with the
    same (key, t) the smallest by the columns `first_by`, then by v, is the reading; without first_by all are readings of
    the cell, with intervals of no length between them, whose increments fall into that cell. A null key is a key of its
    own. A key with one reading has one observed cell with a null increment. Empty in, empty out; further columns are
    ignored.
    """
    pairs = interval_pairs(readings, sources, key, t, v, step_ms, kind, first_by, segment_ms).withColumn("counter", F.coalesce(F.col("kind") == "counter", F.lit(False)))
    # the cells an interval reaches, in chunks: of a gauge's, the cell of the reading that ends it is that reading's own
    end = F.coalesce("nslot", "slot")
    last = F.when(F.col("counter"), end).otherwise(F.greatest(F.col("slot"), end - 1))
    begins, width = _slots(F.col("slot"), F.col("last"))
    cells = pairs.withColumn("last", last).withColumn("c0", F.explode(begins)).withColumn("cell", F.explode(F.sequence(F.col("c0"), F.least(F.col("c0") + width, F.col("last")))))
    own, cell, step = F.col("cell") == F.col("slot"), F.col("cell"), F.col("step")
    length = F.col("nt") - F.col("t")
    rise = F.when(F.col("nv") < F.col("v"), F.col("nv")).otherwise(F.col("nv") - F.col("v"))  # after a reset a counter begins at zero
    lap = F.least(F.col("nt"), (cell + 1) * step) - F.greatest(F.col("t"), cell * step)
    line = F.col("v") + (F.col("nv") - F.col("v")) * (cell * step + step / 2 - F.col("t")) / length
    hole = ~F.col("counter") & ~own
    parts = cells.groupBy("k", "step", "counter", "cell").agg(
        F.count_if(own).alias("n"),
        F.avg(F.when(~F.col("counter") & own, F.col("v"))).alias("mean"),
        F.max(F.when(hole, line)).alias("line"),
        F.max(F.when(hole, F.col("v"))).alias("before"),
        F.sum(F.when(F.col("counter"), F.when(length > 0, rise * lap / length).otherwise(rise))).alias("increment"),
    )
    # a cell without a reading is there because an interval put a value or a share into it
    status = F.when(F.col("n") > 0, "observed").when(F.coalesce("line", "increment").isNotNull(), "missing")
    filled = {"linear": F.col("line"), "last": F.col("before"), "null": F.lit(None).cast("double")}[fill]
    return parts.select(F.col("k").alias(key), (cell * step).alias("slot_start"), status.alias("status"), "n", F.when(F.col("n") > 0, F.col("mean")).otherwise(filled).alias("value"), "increment")
