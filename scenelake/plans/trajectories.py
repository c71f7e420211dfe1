"""Registered queries: metrics of whole predicted trajectories."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scenelake.functions.geometry import round_
from scenelake.operators import trajectories as tr
from scenelake.plans.helpers import r4, rounded, sql_norm, sql_r4
from scenelake.sources import world
from scenelake.sources.world import SQL_MODES, SQL_PATHS, SQL_TRUTHS

ADES = ("ade3", "ade5", "ade8", "ade")


def _ends(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Modes and truths by their endpoints; ``world`` makes the samples of a batch."""
    return world.modes(spark, d).select("object_id", "mode", "score", "x", "y"), world.truths(spark, d)


def _errors(spark: SparkSession, d: str) -> DataFrame:
    return tr.errors(*_ends(spark, d), world.mode_samples, world.true_samples)


def _judged(spark: SparkSession, d: str) -> DataFrame:
    return tr.misses(_errors(spark, d))


def ade_at_steps(spark: SparkSession, d: str) -> DataFrame:
    """Mean over objects of the least ADE up to 3, 5 and 8 seconds, and the mean of the three."""
    return tr.least_errors(_errors(spark, d)).agg(F.count("*").alias("n"), *(r4(c, F.avg(c)) for c in ADES))


def ade_by_type(spark: SparkSession, d: str) -> DataFrame:
    """The same by object type; types without objects have 0."""
    found = tr.least_errors(_errors(spark, d)).groupBy("object_type").agg(F.count("*").alias("n"), *(F.avg(c).alias(c) for c in ADES))
    names = F.explode(F.array(*(F.lit(f"TYPE_{n}") for n in ("VEHICLE", "PEDESTRIAN", "CYCLIST", "OTHER")))).alias("object_type")
    every = spark.range(1).select(names).join(found, "object_type", "left")
    return every.select("object_type", F.coalesce("n", F.lit(0)).alias("n"), *(r4(c, F.coalesce(c, F.lit(0.0))) for c in ADES))


def _placed(paths: DataFrame) -> DataFrame:
    """Paths of a block's objects put 20 m apart, as scenes have them."""
    moved = F.transform("path", lambda p: p.withField("x", p["x"] + (F.col("object_id") % 32) * 20))
    return paths.withColumn("path", moved)


def _metrics(spark: SparkSession, d: str) -> DataFrame:
    judged, keys = _judged(spark, d), ["object_type", "seconds"]

    def placed(samples: tr.Samples) -> tr.Samples:
        """As :func:`_placed`."""
        def moved(rows):
            x, *rest = samples(rows)
            return x + np.fmod(rows.column("object_id").to_numpy(), 32)[:, None] * 20, *rest

        return moved

    over = tr.overlaps(*_ends(spark, d), F.floor(F.col("object_id") / 32), modes=placed(world.mode_samples), trues=placed(world.true_samples))
    over = over.join(world.truths(spark, d).select("object_id", "object_type").hint("merge"), "object_id")
    over = over.groupBy("object_type").agg(F.avg(F.col("overlap").cast("double")).alias("overlap_rate"))
    return tr.metrics(judged, keys).join(over, "object_type").select(*keys, "n", *METRICS)


METRICS = ("min_ade", "min_fde", "miss_rate", "overlap_rate", "map")


def benchmark_metrics(spark: SparkSession, d: str) -> DataFrame:
    """minADE, minFDE, miss rate, overlap rate and mAP of each object type and horizon."""
    return rounded(_metrics(spark, d), *METRICS)


def benchmark_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Metrics averaged over horizons for each type, for both that aren't vehicles, and for all three."""
    by_type = _metrics(spark, d).groupBy("object_type").agg(*(F.avg(m).alias(m) for m in METRICS))
    vehicle = F.col("object_type") == "TYPE_VEHICLE"
    groups = F.array(F.col("object_type"), F.when(vehicle, "Vehicle").otherwise("NonVehicle"), F.lit("All"))
    rows = by_type.select(F.explode(groups).alias("group"), *METRICS)
    return rows.groupBy("group").agg(*(r4(m, F.avg(m)) for m in METRICS))


def min_ade_fde_miss(spark: SparkSession, d: str) -> DataFrame:
    """Least errors and misses of each object at 8 seconds, in the frame of the true heading."""
    j = _judged(spark, d).where("seconds = 8")
    return j.groupBy("object_id", "object_type").agg(r4("min_ade", F.min("ade")), r4("min_fde", F.min("fde")), F.min(F.col("miss").cast("int")).alias("missed"))


def miss_thresholds(spark: SparkSession, d: str) -> DataFrame:
    """The thresholds of a miss at each horizon for some speeds."""
    speeds = F.explode(F.array(*(F.lit(float(v)) for v in (0, 1.4, 6.2, 11, 20)))).alias("speed")
    rows = F.explode(F.array(*(F.struct(F.lit(s).alias("seconds"), F.lit(a).alias("lat"), F.lit(b).alias("lon")) for s, (_, a, b) in tr.HORIZONS.items()))).alias("h")
    t = spark.range(1).select(speeds).select("speed", rows)
    return t.select("speed", "h.seconds", *(r4(n, F.col(f"h.{n}") * tr.scale(F.col("speed"))) for n in ("lat", "lon")))


def world_predictions(spark: SparkSession, d: str) -> DataFrame:
    """Best modes put into the world frame: rotated by the object's heading, moved to its place."""
    best = world.mode_paths(world.modes(spark, d)).where("mode = 0")
    heading, cx = (F.col("object_id") % 7) * 0.5, F.col("object_id") % 100
    point = F.posexplode("path").alias("k", "p")
    rows = best.withColumns({"h": heading, "cx": cx}).select("object_id", "h", "cx", point)
    x = F.col("cx") + F.col("p.x") * F.cos("h") - F.col("p.y") * F.sin("h")
    y = F.col("p.x") * F.sin("h") + F.col("p.y") * F.cos("h")
    return rows.where("k % 5 = 4").select("object_id", "k", r4("x", x), r4("y", y))


def padded_predictions(spark: SparkSession, d: str) -> DataFrame:
    """The six best modes of each object with normalised scores, zeros for objects with fewer."""
    m = world.modes(spark, d)
    total = m.groupBy("object_id").agg(F.sum("score").alias("total"))
    slots = world.truths(spark, d).select("object_id", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("slot"))
    own = m.where("mode < 6").join(total, "object_id").select("object_id", F.col("mode").alias("slot"), round_(F.col("score") / F.col("total"), 6).alias("p"), "x", "y")
    every = slots.join(own, ["object_id", "slot"], "left")
    return every.select("object_id", "slot", *(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("p", "x", "y")), F.col("p").isNotNull().alias("real"))


_E = f"""WITH {SQL_MODES},{SQL_TRUTHS},{SQL_PATHS},
err AS (SELECT m.object_id, object_type, mode, score, k, {sql_norm('m.x-t.x','m.y-t.y')} AS e, m.x, m.y, t.x AS tx, t.y AS ty, valid FROM mpaths m JOIN tpaths t USING (object_id, k))"""
_cut = lambda k: f"round(coalesce(sum(e) FILTER (valid AND k <= {k}), 0)/greatest(count(*) FILTER (valid AND k <= {k}), 1), 6)"
_L = f"""{_E}, md AS (SELECT object_id, object_type, mode, any_value(score) AS score, {_cut(5)} AS ade3, {_cut(9)} AS ade5, {_cut(15)} AS ade8 FROM err GROUP BY 1, 2, 3),
least_ AS (SELECT object_id, object_type, min(ade3) AS ade3, min(ade5) AS ade5, min(ade8) AS ade8, (min(ade3) + min(ade5) + min(ade8))/3 AS ade FROM md GROUP BY 1, 2)"""
_scale = "least(1.0::double, greatest(0.5::double, 0.5::double + 0.5::double*({0} - 1.4::double)/9.6::double))"
_J = f"""{_L}, hz AS (SELECT * FROM (VALUES (3, 5, 1.0::double, 2.0::double), (5, 9, 1.8::double, 3.6::double), (8, 15, 3.0::double, 6.0::double)) v(seconds, k, lat, lon)),
shape AS (SELECT a.object_id, sqrt((b.x-a.x)*(b.x-a.x) + (b.y-a.y)*(b.y-a.y))*2 AS speed, {sql_norm('z.x-a.x','z.y-a.y')} AS moved,
   atan2(z.y-w.y, z.x-w.x) - atan2(b.y-a.y, b.x-a.x) AS turned FROM tpaths a JOIN tpaths b ON b.object_id=a.object_id AND a.k=0 AND b.k=1 JOIN tpaths w ON w.object_id=a.object_id AND w.k=14 JOIN tpaths z ON z.object_id=a.object_id AND z.k=15),
fold AS (SELECT *, round(turned + pi() - 2*pi()*floor((turned + pi())/(2*pi())) - pi(), 6) AS f FROM shape),
sh AS (SELECT object_id, speed, CASE WHEN moved < 2 THEN 0 WHEN abs(f) < 0.2::double THEN 1 WHEN f > 0 THEN 2 ELSE 3 END AS shape FROM fold),
loc AS (SELECT e.object_id, e.object_type, e.mode, e.score, seconds, shape, round(e.e, 6) AS fde, CASE seconds WHEN 3 THEN ade3 WHEN 5 THEN ade5 ELSE ade8 END AS ade,
   atan2(e.ty-p.y, e.tx-p.x) AS h, e.x-e.tx AS dx, e.y-e.ty AS dy, lat*{_scale.format('speed')} AS lat, lon*{_scale.format('speed')} AS lon
   FROM err e JOIN hz USING (k) JOIN sh USING (object_id) JOIN tpaths p ON p.object_id=e.object_id AND p.k=e.k-1 JOIN md ON md.object_id=e.object_id AND md.mode=e.mode WHERE e.valid),
judged AS (SELECT *, abs(round(dx*cos(h) + dy*sin(h), 6)) > lon OR abs(round(dy*cos(h) - dx*sin(h), 6)) > lat AS miss FROM loc)"""
_ov = "abs(round({0}, 6))"
_dx = "(b.x + (b.object_id % 32)*20 - (a.x + (a.object_id % 32)*20))"
_M = f"""{_J}, po AS (SELECT object_id, object_type, seconds, min(ade) AS ade, min(fde) AS fde, min(miss::int) AS miss FROM judged GROUP BY 1, 2, 3),
ra AS (SELECT object_type, seconds, count(*) AS n, avg(ade) AS min_ade, avg(fde) AS min_fde, avg(miss::double) AS miss_rate FROM po GROUP BY 1, 2),
hi AS (SELECT *, round(score/sum(score) OVER o, 3) AS share, coalesce(mode = first(mode) OVER (PARTITION BY object_id, seconds ORDER BY miss, score DESC, mode) AND NOT miss, false) AS hit FROM judged WINDOW o AS (PARTITION BY object_id, seconds)),
cu AS (SELECT object_type, seconds, shape, share, count(*) AS m, count(*) FILTER (hit) AS h FROM hi GROUP BY 1, 2, 3, 4), ob AS (SELECT object_type, seconds, shape, count(DISTINCT object_id) AS n FROM hi GROUP BY 1, 2, 3),
cs AS (SELECT *, sum(h) OVER w AS hh, sum(m) OVER w AS mm FROM cu JOIN ob USING (object_type, seconds, shape) WINDOW w AS (PARTITION BY object_type, seconds, shape ORDER BY share DESC)),
ap AS (SELECT object_type, seconds, shape, sum(h/n*(hh/mm)) AS ap FROM cs GROUP BY 1, 2, 3), mp AS (SELECT object_type, seconds, avg(ap) AS map FROM ap GROUP BY 1, 2),
tp AS (SELECT object_id, k, x, y, coalesce(atan2(y - lag(y) OVER w, x - lag(x) OVER w), 0) AS h FROM mpaths WHERE mode = 0 WINDOW w AS (PARTITION BY object_id ORDER BY k)),
ov AS (SELECT DISTINCT a.object_id FROM tp a JOIN tpaths b ON a.object_id//32 = b.object_id//32 AND a.object_id <> b.object_id AND a.k = b.k AND b.valid
   AND {_ov.format(_dx + '*cos(a.h) + (b.y-a.y)*sin(a.h)')} < 4.5 AND {_ov.format('(b.y-a.y)*cos(a.h) - ' + _dx + '*sin(a.h)')} < 2),
orate AS (SELECT object_type, avg((ov.object_id IS NOT NULL)::int::double) AS overlap_rate FROM truths JOIN (SELECT DISTINCT object_id FROM modes) USING (object_id) LEFT JOIN ov USING (object_id) GROUP BY 1),
met AS (SELECT object_type, seconds, n, min_ade, min_fde, miss_rate, overlap_rate, map FROM ra JOIN mp USING (object_type, seconds) JOIN orate USING (object_type))"""
_avg = ", ".join(f"avg({m}) AS {m}" for m in METRICS)

QUERIES = {
    "ade_at_steps": (ade_at_steps, f"{_L} SELECT count(*) AS n, " + ", ".join(sql_r4(f"avg({c})", c) for c in ADES) + " FROM least_"),
    "ade_by_type": (ade_by_type, f"{_L}, g AS (SELECT object_type, count(*) AS n, {', '.join(f'avg({c}) AS {c}' for c in ADES)} FROM least_ GROUP BY 1) SELECT t AS object_type, coalesce(n, 0) AS n, " + ", ".join(sql_r4(f"coalesce({c}, 0)", c) for c in ADES) + " FROM (VALUES ('TYPE_VEHICLE'), ('TYPE_PEDESTRIAN'), ('TYPE_CYCLIST'), ('TYPE_OTHER')) v(t) LEFT JOIN g ON g.object_type = t"),
    "min_ade_fde_miss": (min_ade_fde_miss, f"{_J} SELECT object_id, object_type, {sql_r4('min(ade)', 'min_ade')}, {sql_r4('min(fde)', 'min_fde')}, min(miss::int) AS missed FROM judged WHERE seconds = 8 GROUP BY 1, 2"),
    "benchmark_metrics": (benchmark_metrics, f"{_M} SELECT object_type, seconds, n, " + ", ".join(sql_r4(m, m) for m in METRICS) + " FROM met"),
    "benchmark_rollup": (benchmark_rollup, f"""{_M}, ty AS (SELECT object_type, {_avg} FROM met GROUP BY 1), gr AS (SELECT object_type AS "group", * EXCLUDE (object_type) FROM ty UNION ALL SELECT 'All', * EXCLUDE (object_type) FROM ty
        UNION ALL SELECT CASE WHEN object_type = 'TYPE_VEHICLE' THEN 'Vehicle' ELSE 'NonVehicle' END, * EXCLUDE (object_type) FROM ty) SELECT "group", """ + ", ".join(sql_r4(f"avg({m})", m) for m in METRICS) + " FROM gr GROUP BY 1"),
    "miss_thresholds": (miss_thresholds, f"SELECT speed, seconds, {sql_r4('lat*' + _scale.format('speed'), 'lat')}, {sql_r4('lon*' + _scale.format('speed'), 'lon')} FROM (VALUES (0.0::double), (1.4::double), (6.2::double), (11.0::double), (20.0::double)) s(speed), (VALUES (3, 1.0::double, 2.0::double), (5, 1.8::double, 3.6::double), (8, 3.0::double, 6.0::double)) h(seconds, lat, lon)"),
    "world_predictions": (world_predictions, f"WITH {SQL_MODES},{SQL_TRUTHS},{SQL_PATHS}, w AS (SELECT object_id, CAST(k AS INT) AS k, x AS px, y AS py, (object_id % 7)*0.5::double AS h, object_id % 100 AS cx FROM mpaths WHERE mode = 0 AND k % 5 = 4) SELECT object_id, k, {sql_r4('cx + px*cos(h) - py*sin(h)', 'x')}, {sql_r4('px*sin(h) + py*cos(h)', 'y')} FROM w"),
    "padded_predictions": (padded_predictions, f"WITH {SQL_MODES},{SQL_TRUTHS}, q AS (SELECT object_id, mode AS slot, round(score/sum(score) OVER (PARTITION BY object_id), 6) AS p, x, y FROM modes) SELECT t.object_id, CAST(s AS INT) AS slot, coalesce(p, 0) AS p, coalesce(x, 0) AS x, coalesce(y, 0) AS y, p IS NOT NULL AS real FROM truths t, range(6) r(s) LEFT JOIN q ON q.object_id = t.object_id AND q.slot = s"),
}
