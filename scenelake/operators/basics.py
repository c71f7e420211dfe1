"""Small relational operators over tracks, polylines and modes: selections, sets, order, samples."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scenelake.functions.geometry import dist
from scenelake.operators.kinematics import AGENT, steps

STEP = [*AGENT, "t"]


def remap(df: DataFrame, kept: Column, keys: list[str], order: str) -> DataFrame:
    """Kept rows with ``old`` and ``new`` places: the new one counts the kept rows before."""
    w = Window.partitionBy(*keys).orderBy(order)
    both = df.withColumns({"old": F.row_number().over(w) - 1, "_k": kept})
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    new = F.sum(F.col("_k").cast("int")).over(so_far) - 1
    return both.withColumn("new", new.cast("int")).where("_k").drop("_k")


def previous_point(points: DataFrame, keys: list[str], order: str) -> DataFrame:
    """pre_x and pre_y: the point before; the first has the second's, which is itself."""
    w = Window.partitionBy(*keys).orderBy(order)
    return points.withColumns({f"pre_{c}": F.coalesce(F.lag(c).over(w), F.col(c)) for c in "xy"})


def displacement(points: DataFrame, keys: list[str], order: str) -> DataFrame:
    """dx and dy since the row before; 0 at the first."""
    w = Window.partitionBy(*keys).orderBy(order)
    return points.withColumns({f"d{c}": F.coalesce(F.col(c) - F.lag(c).over(w), F.lit(0.0)) for c in "xy"})


def normalised_history(tracks: DataFrame, now: int, least: float = 0.01) -> DataFrame:
    """Histories moved to start at the origin and divided by their path length; those shorter than
    ``least`` metres are skipped."""
    past = tracks.where((F.col("t") <= now) & F.col("valid"))
    before = steps()
    step = F.coalesce(dist(F.col("x"), F.col("y"), F.lag("x").over(before), F.lag("y").over(before)), F.lit(0.0))
    whole = Window.partitionBy(*AGENT)
    moved = past.withColumns({"step": step, **{f"{c}0": F.first(c).over(before) for c in "xy"}})
    length = moved.withColumn("length", F.sum("step").over(whole)).where(F.col("length") >= least)
    return length.select(*STEP, *(((F.col(c) - F.col(f"{c}0")) / F.col("length")).alias(f"n{c}") for c in "xy"), "length")


def downsample(tracks: DataFrame, first: int = 4, every: int = 5, horizon: int | None = None) -> DataFrame:
    """Every ``every``-th step from ``first``, up to ``horizon`` samples."""
    kept = tracks.where(F.pmod(F.col("t") - first, F.lit(every)) == 0).withColumn("sample", ((F.col("t") - first) / every).cast("int"))
    return kept if horizon is None else kept.where(F.col("sample") < horizon)


def upsample(samples: DataFrame, keys: list[str], order: str, factor: int) -> DataFrame:
    """Each sample as ``factor`` steps on the line from the sample before, the origin before the first."""
    w = Window.partitionBy(*keys).orderBy(order)
    both = samples.withColumns({f"_{c}": F.coalesce(F.lag(c).over(w), F.lit(0.0)) for c in "xy"})
    rows = both.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(factor))))
    share = F.col("k") / F.lit(float(factor))
    place = {c: F.col(f"_{c}") + (F.col(c) - F.col(f"_{c}")) * share for c in "xy"}
    return rows.select(*keys, (F.col(order) * factor + F.col("k") - 1).alias("step"), *(v.alias(c) for c, v in place.items()))


def split_on_change(points: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """``part`` counts the changes of ``value`` up to each row."""
    w = Window.partitionBy(*keys).orderBy(order)
    change = (F.col(value) != F.lag(value).over(w)).cast("int")
    return points.withColumn("part", F.sum(F.coalesce(change, F.lit(0))).over(w).cast("int"))


def distilled_segments(points: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Points at even places, each paired with the next one kept."""
    w = Window.partitionBy(*keys).orderBy(order)
    even = points.withColumn("_p", F.row_number().over(w) - 1).where(F.col("_p") % 2 == 0)
    both = even.withColumns({f"{c}2": F.lead(c).over(w) for c in "xy"}).where("x2 is not null")
    return both.drop("_p")


def changes_only(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """``value`` where it differs from the row before, else -1."""
    w = Window.partitionBy(*keys).orderBy(order)
    same = F.col(value) == F.lag(value).over(w)
    return df.withColumn("marked", F.when(F.coalesce(same, F.lit(False)), F.lit(-1)).otherwise(F.col(value)))


def valid_sequences(tracks: DataFrame) -> DataFrame:
    """Steps of each agent's valid span, first to last valid step, numbered from 0."""
    span = tracks.groupBy(*AGENT).agg(
        F.min(F.when(F.col("valid"), F.col("t"))).alias("a"), F.max(F.when(F.col("valid"), F.col("t"))).alias("b")
    )
    inside = tracks.join(span, AGENT).where(F.col("t").between(F.col("a"), F.col("b")))
    return inside.withColumn("place", (F.col("t") - F.col("a")).cast("int")).drop("a", "b")


def natural_key(name: Column, width: int = 12) -> Column:
    """A sort key under which numbers in names come in order of value: their digits, padded."""
    parts = F.regexp_extract_all(name, F.lit("([0-9]+|[^0-9]+)"), 1)
    padded = F.transform(parts, lambda p: F.when(F.regexp_like(p, F.lit("^[0-9]")), F.lpad(p, width, "0")).otherwise(p))
    return F.array_join(padded, "")


def newest(df: DataFrame, keys: list[str], time: str, tie: str, keep: int) -> DataFrame:
    """The ``keep`` newest rows of each group, newest first."""
    w = Window.partitionBy(*keys).orderBy(F.desc(time), F.desc(tie))
    return df.withColumn("age", F.row_number().over(w)).where(F.col("age") <= keep)


def first_by(df: DataFrame, keys: list[str], order: list[str], *columns: str) -> DataFrame:
    """The first row of each key in ``order``, as a minimum: no window, combined before the shuffle."""
    return df.groupBy(*keys).agg(F.min(F.struct(*order, *columns)).alias("_f")).select(*keys, "_f.*")


def interleaved(df: DataFrame, ranks: int, size: int) -> DataFrame:
    """Rows of (rank, idx) in the order in which ranks take turns, cut to ``size``: the place is
    idx * ranks + rank, so nothing has to be ordered."""
    return df.withColumn("place", F.col("idx") * ranks + F.col("rank")).where(F.col("place") < size)


def config_hash(config: dict) -> Column:
    """The hash that names a cache: of the configuration as JSON with sorted keys."""
    return F.sha2(F.lit(json.dumps(config, sort_keys=True)), 256)


def padded(df: DataFrame, keys: list[str], order: str, value: str, length: int) -> DataFrame:
    """Each group's values as one array of ``length``, zeros behind, with a mask; groups hold no more
    than a track or a set of modes does.  Longer groups keep all values and get no zeros."""
    rows = F.sort_array(F.collect_list(F.struct(order, value)))
    own = df.groupBy(*keys).agg(F.transform(rows, lambda r: r[value]).alias("_v"))
    rest = F.greatest(F.lit(length) - F.size("_v"), F.lit(0))
    values = F.concat("_v", F.array_repeat(F.lit(0.0), rest))
    mask = F.concat(F.array_repeat(F.lit(True), F.size("_v")), F.array_repeat(F.lit(False), rest))
    return own.select(*keys, values.alias("values"), mask.alias("mask"))
