"""Registered queries: shapes, their distances and clusterings."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scenelake.functions.geometry import dist, round_
from scenelake.operators import curves as cv
from scenelake.operators import kinematics as k
from scenelake.operators import pairs as pr
from scenelake.operators import partitions as pt
from scenelake.operators import shapes as sh
from scenelake.plans.helpers import r4, rounded, sql_norm, sql_r4
from scenelake.plans.pairs import SQL_ALIGNED
from scenelake.plans.primitives import _ends, medoid
from scenelake.sources import world
from scenelake.sources.shared import handed_on
from scenelake.sources.world import SQL_TRACKS

A = k.AGENT
P = pr.PAIR


def bearing_angle(spark: SparkSession, d: str) -> DataFrame:
    """Angle of each agent's place now, put into its quadrant."""
    now = world.tracks(spark, d).where(F.col("t") == world.NOW)
    return now.select(*A, r4("angle", F.pmod(F.atan2("y", "x"), F.lit(2 * np.pi))))


def max_abs_distances(spark: SparkSession, d: str) -> DataFrame:
    """The greatest difference of two agents in either coordinate over common steps."""
    both = pr.aligned(world.tracks(spark, d))
    most = F.max(F.greatest(F.abs(F.col("x_i") - F.col("x_j")), F.abs(F.col("y_i") - F.col("y_j"))))
    return both.groupBy(*P).agg(r4("d", most))


def procrustes_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Distances of tracks by shape, turned and reflected, and with a speed term."""
    m = sh.procrustes_distances(sh.shape_sums(world.tracks(spark, d))).where("n >= 3 and rotated is not null")
    return m.select(*P, *(r4(c, round_(c, 6)) for c in ("rotated", "reflected")), r4("with_speed", round_(F.col("rotated"), 6) + 0.1 * F.col("speed")))


def center_distances(spark: SparkSession, d: str) -> DataFrame:
    """Shape distance of each agent of a scene to its first one."""
    m = sh.procrustes_distances(sh.shape_sums(world.tracks(spark, d))).where("n >= 3 and rotated is not null")
    first = Window.partitionBy("scenario_id")
    return m.withColumn("c", F.min("i").over(first)).where("i = c").select("scenario_id", F.col("j").alias("agent_id"), r4("d", round_("rotated", 6)))


def relative_encounters(spark: SparkSession, d: str) -> DataFrame:
    m = sh.relative_motion(pr.aligned(world.tracks(spark, d)))
    n, first, span = F.count("*"), F.min("t"), F.max("t") - F.min("t")
    # by integer sums: the same in every order
    share = F.coalesce(F.try_divide((F.sum("t") - n * first).cast("double"), (n * span).cast("double")), F.lit(0.0))
    return m.groupBy(*P).agg(n.alias("n"), r4("min_rx", F.min("rx")), r4("max_ry", F.max("ry")), r4("mean_share", share))


def graph_laplacian(spark: SparkSession, d: str) -> DataFrame:
    """Laplacian of each scene's similarity graph, plain and normalised."""
    near = pr.aligned(world.tracks(spark, d)).groupBy(*P).agg(round_(F.exp(-F.min("d") / 10), 6).alias("w"))
    both = pr.both_sides(near, "w").select("scenario_id", F.col("agent_id").alias("i"), F.col("other").alias("j"), "w")
    degree = both.groupBy("scenario_id", F.col("i").alias("a")).agg(F.sum("w").alias("g"))
    gi, gj = (degree.select("scenario_id", F.col("a").alias(n), F.col("g").alias(f"g{n}")) for n in "ij")
    off = both.join(gi, ["scenario_id", "i"]).join(gj, ["scenario_id", "j"])
    off = off.select(*P, r4("plain", -F.col("w")), r4("normal", -F.col("w") / F.sqrt(F.col("gi") * F.col("gj"))))
    own = degree.select("scenario_id", F.col("a").alias("i"), F.col("a").alias("j"), r4("plain", F.col("g")), F.lit(1.0).alias("normal"))
    return off.unionByName(own)


def _ends_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Distances of agents' endpoint motions within a scene, and whether their types agree."""
    e = world.with_type(_ends(spark, d))
    a, b = (e.select("scenario_id", F.col("agent_id").alias(n), *(F.col(c).alias(f"{c}_{n}") for c in ("x", "y", "object_type"))) for n in "ij")
    both = a.join(b, "scenario_id").where("i < j")
    gap = round_(dist(F.col("x_i"), F.col("y_i"), F.col("x_j"), F.col("y_j")), 6)
    return both.select(*P, gap.alias("d"), (F.col("object_type_i") == F.col("object_type_j")).alias("same"))


def min_max_ratio(spark: SparkSession, d: str) -> DataFrame:
    """Least distance between types over the greatest within one, by scene."""
    m = _ends_pairs(spark, d).groupBy("scenario_id").agg(F.min(F.when(~F.col("same"), F.col("d"))).alias("b"), F.max(F.when(F.col("same"), F.col("d"))).alias("w"))
    return m.select("scenario_id", r4("ratio", F.try_divide(F.col("b"), F.col("w"))))


def cluster_square_stats(spark: SparkSession, d: str) -> DataFrame:
    """Mean and variance of squared distances inside types and between them, by scene."""
    s = _ends_pairs(spark, d).withColumn("s", F.col("d") * F.col("d"))
    return s.groupBy("scenario_id", "same").agg(F.count("*").alias("n"), r4("mean", F.avg("s")), r4("var", F.var_samp("s")))


def _to_medoid(spark: SparkSession, d: str) -> DataFrame:
    e = _ends(spark, d)
    m = medoid(spark, d).select("scenario_id", F.col("agent_id").alias("medoid"))
    at = e.select("scenario_id", F.col("agent_id").alias("medoid"), F.col("x").alias("mx"), F.col("y").alias("my"))
    return e.join(m.join(at, ["scenario_id", "medoid"]), "scenario_id").withColumn("d", round_(dist(F.col("x"), F.col("y"), F.col("mx"), F.col("my")), 6))


def within_cluster_distance(spark: SparkSession, d: str) -> DataFrame:
    """Sum of squared distances to the scene's medoid."""
    return _to_medoid(spark, d).groupBy("scenario_id", "medoid").agg(r4("total", F.sum(F.col("d") * F.col("d"))))


def ordered_members(spark: SparkSession, d: str) -> DataFrame:
    """Members of each scene by distance to its medoid."""
    w = Window.partitionBy("scenario_id").orderBy("d", "agent_id")
    return _to_medoid(spark, d).withColumn("rank", F.row_number().over(w)).select(*A, "rank", r4("d"))


def medoid_curves(spark: SparkSession, d: str) -> DataFrame:
    """Tracks of the medoids: centre curves by lookup."""
    m = medoid(spark, d).select(*A)
    return world.tracks(spark, d).join(m, A, "left_semi").select(*A, "t", r4("x"), r4("y"))


def curve_extents(spark: SparkSession, d: str) -> DataFrame:
    """Extents of all centre curves."""
    c = medoid_curves(spark, d)
    return c.agg(*(f(n).alias(f"{m}_{n}") for n in "xy" for m, f in (("min", F.min), ("max", F.max))))


def clusters_by_size(spark: SparkSession, d: str) -> DataFrame:
    """Embedding labels renumbered by falling size."""
    n = world.table(spark, d, "embeddings").groupBy("label").agg(F.count("*").alias("n"))
    return sh.relabelled(n, "label", "n").select("label", "n", F.col("rank").cast("long").alias("rank"))


def _labels(spark: SparkSession, d: str) -> DataFrame:
    return world.table(spark, d, "embeddings").select(F.col("label").cast("long").alias("a"), (F.col("vec_id") % 7).alias("b"))


def mismatch_costs(spark: SparkSession, d: str) -> DataFrame:
    return sh.mismatches(_labels(spark, d), "a", "b")


def matched_clusters(spark: SparkSession, d: str) -> DataFrame:
    """The cheapest assignment of two labellings' clusters, and the best greedy one: a matrix of clusters."""
    rows = mismatch_costs(spark, d).collect()  # clusters by clusters
    a, b = sorted({r.a for r in rows}), sorted({r.b for r in rows})
    cost = np.zeros((len(a), len(b)), int)
    for r in rows:
        cost[a.index(r.a), b.index(r.b)] = r.cost
    found = [("optimal", i, j) for i, j in pt.optimal_match(cost)] + [("greedy", i, j) for i, j in pt.best_greedy_match(cost)]
    return spark.createDataFrame([(m, int(a[i]), int(b[j]), int(cost[i, j])) for m, i, j in found], "method string, a long, b long, cost long")


def _stability(spark: SparkSession, d: str) -> DataFrame:
    e = world.table(spark, d, "embeddings")
    x = [round_(F.col("embedding")[i].cast("double"), 4).alias(f"x{i}") for i in range(4)]
    grid = F.explode(F.array(*(F.struct(F.lit(a).alias("k"), F.lit(b).alias("dims")) for a in (2, 3, 4, 5) for b in (1, 2, 3, 4)))).alias("g")
    rows = e.select("vec_id", *x, grid)
    rows = rows.select("g.k", "g.dims", F.pmod("vec_id", F.col("g.k")).alias("c"), *(F.when(F.col("g.dims") > i, F.col(f"x{i}")).otherwise(0.0).alias(f"x{i}") for i in range(4)))
    per = rows.groupBy("k", "dims", "c").agg(sh.scatter(rows, [], [f"x{i}" for i in range(4)]).alias("s"), F.count("*").alias("n"))
    return per.groupBy("k", "dims").agg((F.sum("s") / (2 * F.sum("n"))).alias("stat"))


def stability_stat(spark: SparkSession, d: str) -> DataFrame:
    """Squared distance within clusters over twice the number of rows, by clusters and dimensions."""
    return rounded(_stability(spark, d), "stat")


def stability_change(spark: SparkSession, d: str) -> DataFrame:
    """Mean absolute change of the statistic to its neighbours on the grid."""
    s = _stability(spark, d)
    o = s.select(F.col("k").alias("k2"), F.col("dims").alias("d2"), F.col("stat").alias("other"))
    near = F.abs(F.col("k") - F.col("k2")) + F.abs(F.col("dims") - F.col("d2")) == 1
    return s.crossJoin(F.broadcast(o)).where(near).groupBy("k", "dims").agg(r4("change", F.avg(F.abs(F.col("stat") - F.col("other")))))  # sixteen rows


def cell_text(spark: SparkSession, d: str) -> DataFrame:
    """Cells of a table: mean and deviation of endpoint motion by type."""
    e = world.with_type(_ends(spark, d)).withColumn("m", F.sqrt(F.col("x") ** 2 + F.col("y") ** 2))
    return e.groupBy("object_type").agg(F.format_string("$%.2f \\pm %.2f$", round_(F.avg("m"), 6), round_(F.stddev_pop("m"), 6)).alias("cell"))


def orientation_table(spark: SparkSession, d: str) -> DataFrame:
    """The four orientations of a plane figure: signs of both axes."""
    return spark.range(4).select("id", (1 - 2 * (F.col("id") % 2)).alias("sx"), (1 - 2 * F.floor(F.col("id") / 2)).alias("sy"))


# Grouped by scene, on numpy arrays; the functions are tested by themselves.


def _scenes(spark: SparkSession, d: str, rows, schema: str) -> DataFrame:
    return sh.per_scene(world.tracks(spark, d), rows, schema)


def _even(curves: sh.Curves) -> tuple[list[int], list[np.ndarray]]:
    """Agents and their curves at equal lengths."""
    return list(curves), [cv.resampled(t, xy, 33) for t, xy in curves.values()]


def joint_procrustes_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Distances of a scene's encounters, each of an agent and the next: both turned together, in either order."""

    def rows(_, curves):
        ids, even = _even(curves)
        pairs = list(zip(range(len(ids)), range(1, len(ids))))
        for n, (a, b) in enumerate(pairs):
            for c, e in pairs[n + 1 :]:
                yield ids[a], ids[c], round(cv.joint_procrustes([even[a], even[b]], [even[c], even[e]]), 6)

    return _scenes(spark, d, rows, "a long, b long, d double")


def polynomials(spark: SparkSession, d: str) -> DataFrame:
    """The sixteen cubic coefficients of each encounter of an agent and the next, over common steps."""

    def rows(_, curves):
        ids = list(curves)
        for a, b in zip(ids, ids[1:]):
            (ta, xa), (tb, xb) = curves[a], curves[b]
            t, ia, ib = np.intersect1d(ta, tb, return_indices=True)
            if len(t) >= 6:
                own = cv.cubic((t - t[0]) / (t[-1] - t[0]), np.hstack((xa[ia], xb[ib])))
                yield a, b, own.T.ravel().round(6).tolist()

    return _scenes(spark, d, rows, "i long, j long, coefficients array<double>")


def center_polynomials(spark: SparkSession, d: str) -> DataFrame:
    """Each scene's mean polynomial, evaluated at 101 places."""

    def rows(_, curves):
        own = [cv.cubic((t - t[0]) / (t[-1] - t[0]), xy) for t, xy in curves.values()]
        if own:
            at = np.linspace(0, 1, cv.POINTS)
            for n, (x, y) in enumerate(cv.evaluated(np.mean(own, 0), at).round(6).tolist()):
                yield n, x, y

    return _scenes(spark, d, rows, "place int, x double, y double")


def recursive_splits(spark: SparkSession, d: str) -> DataFrame:
    """Boundaries of each track by halving."""

    def rows(_, curves):
        for agent, (t, xy) in curves.items():
            for b in cv.bisected(t, xy, 4.0):
                yield agent, int(t[b])

    return _scenes(spark, d, rows, "agent_id long, t int")


def joint_change_points(spark: SparkSession, d: str) -> DataFrame:
    """Boundaries of each encounter, both agents judged jointly, under the best tolerance, merged."""

    def rows(_, curves):
        ids = list(curves)
        for a, b in zip(ids, ids[1:]):
            (ta, xa), (tb, xb) = curves[a], curves[b]
            t, ia, ib = np.intersect1d(ta, tb, return_indices=True)
            if len(t) >= 6:
                xy = np.hstack((xa[ia], xb[ib]))
                bounds = cv.merged(cv.best_bounds(t, xy))
                yield a, b, [int(t[c]) for c in bounds], round(cv.pieces_error(t, xy, bounds), 4)

    return _scenes(spark, d, rows, "i long, j long, bounds array<int>, error double")


def primitive_curves(spark: SparkSession, d: str) -> DataFrame:
    """Pieces of each track, resampled from their cubics and turned onto the scene's first one."""

    def rows(_, curves):
        first = None
        for agent, (t, xy) in curves.items():
            bounds = cv.merged(cv.bisected(t, xy, 4.0))
            for n, (a, b) in enumerate(zip(bounds, bounds[1:])):
                piece = cv.resampled_fit(t[a : b + 1], xy[a : b + 1], [0, b - a])
                first = piece if first is None else first
                own = cv.oriented(piece, first)
                yield agent, n, int(t[a]), int(t[b]), *own.min(0).round(4).tolist(), *own.max(0).round(4).tolist()

    return _scenes(spark, d, rows, "agent_id long, prim_id int, start int, end int, min_x double, min_y double, max_x double, max_y double")


def piecewise_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Distances of tracks by pieces between the merged boundaries of both: summed and averaged."""

    def rows(_, curves):
        ids, even = _even(curves)
        t = np.arange(33.0)
        cuts = [cv.bisected(t, c, 4.0) for c in even]
        for a in range(len(ids)):
            for b in range(a + 1, len(ids)):
                bounds = cv.merged(sorted({*cuts[a], *cuts[b]}))
                yield ids[a], ids[b], *(round(cv.piecewise_procrustes(t, even[a], even[b], bounds, m), 6) for m in (False, True))

    return _scenes(spark, d, rows, "i long, j long, total double, mean double")


def window_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Distances of tracks of different length by a window of the longer, drawn by a seed of the pair."""

    def rows(scene, curves):
        ids = list(curves)
        for n, a in enumerate(ids):
            for b in ids[n + 1 :]:
                x, y = cv.to_shorter(curves[a][1], curves[b][1], scene * 1_000_003 + a * 1009 + b)
                yield a, b, len(x), round(cv.procrustes(x, y), 6)

    return _scenes(spark, d, rows, "i long, j long, n int, d double")


def warping_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Clusters of a scene's tracks by warping cost with speeds, and the cost to the own medoid."""

    def rows(_, curves):
        ids, even = _even(curves)
        if ids:
            m = sh.distance_matrix(even, lambda a, b: cv.warping(a, b, 0.5))
            labels, medoids = pt.kmedoids(m, 3)
            for n, (agent, label) in enumerate(zip(ids, pt.by_size(labels).tolist())):
                yield agent, label, round(float(m[n, medoids[labels[n]]]), 4)

    return _scenes(spark, d, rows, "agent_id long, k int, cost double")


def shape_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Clusters of a scene's tracks by k-means with turning, and the extents of each turned member."""

    def rows(_, curves):
        ids, even = _even(curves)
        if ids:
            labels, centres = pt.procrustes_kmeans(even, 3)
            for agent, label, size, own in zip(ids, labels.tolist(), pt.by_size(labels).tolist(), even):
                turned = cv.oriented(cv.unit(own), centres[label])
                yield agent, size, *turned.min(0).round(4).tolist(), *turned.max(0).round(4).tolist()

    return _scenes(spark, d, rows, "agent_id long, k int, min_x double, min_y double, max_x double, max_y double")


def _matrix(curves: sh.Curves) -> tuple[list[int], np.ndarray]:
    ids, even = _even(curves)
    return ids, sh.distance_matrix(even, cv.procrustes)


def consensus_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Clusters by how often tracks fall together in sampled clusterings, cut from a tree."""

    def rows(scene, curves):
        ids, m = _matrix(curves)
        if len(ids) > 2:
            for agent, label in zip(ids, pt.cut_tree(pt.consensus(m, 3, seed=scene % (1 << 31)), 3).tolist()):
                yield agent, label

    return _scenes(spark, d, rows, "agent_id long, k int")


def spectral_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Clusters by the eigenvectors of a scene's normalised Laplacian."""

    def rows(_, curves):
        ids, m = _matrix(curves)
        if ids:
            for agent, label in zip(ids, pt.spectral(np.exp(-m), min(3, len(ids))).tolist()):
                yield agent, label

    return _scenes(spark, d, rows, "agent_id long, k int")


def polynomial_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Clusters of a scene's tracks by their cubic coefficients."""

    def rows(_, curves):
        own = [cv.cubic((t - t[0]) / (t[-1] - t[0]), xy).ravel() for t, xy in curves.values()]
        if own:
            m = np.sqrt(((np.array(own)[:, None] - np.array(own)[None]) ** 2).sum(2)).round(9)
            for agent, label in zip(curves, pt.by_size(pt.kmedoids(m, 3)[0]).tolist()):
                yield agent, label

    return _scenes(spark, d, rows, "agent_id long, k int")


def silhouette_sweep(spark: SparkSession, d: str) -> DataFrame:
    """Mean silhouette, distance within clusters and a permutation test for each number of clusters."""

    def rows(scene, curves):
        ids, m = _matrix(curves)
        for n, s, w in pt.sweep(m, range(2, 6)):
            labels, _ = pt.kmedoids(m, n)
            yield n, round(s, 6), round(w, 6), round(pt.permutation_p(m, labels, 50, scene % (1 << 31)), 6), round(pt.min_max_ratio(m, labels), 6)

    return _scenes(spark, d, rows, "k int, silhouette double, within double, p double, ratio double")


def held_out_error(spark: SparkSession, d: str) -> DataFrame:
    """Error of held-out tracks for each number of clusters, in two dimensions scaled from distances."""

    def rows(_, curves):
        ids, m = _matrix(curves)
        if len(ids) > 2:
            flat = pt.scaled(m, 2)
            for n in (1, 2, 3):
                yield n, round(pt.folds_error(flat, n), 6)

    return _scenes(spark, d, rows, "k int, error double")


def prepared_curves(spark: SparkSession, d: str) -> DataFrame:
    """Tracks fitted by pieces, resampled and written once for all that follows."""

    def rows(_, curves):
        for agent, (t, xy) in curves.items():
            fit = cv.resampled_fit(t, xy, cv.merged(cv.bisected(t, xy, 4.0)), 11)
            yield agent, fit[:, 0].round(4).tolist(), fit[:, 1].round(4).tolist()

    return handed_on(_scenes(spark, d, rows, "agent_id long, xs array<double>, ys array<double>"), "curves")


def synthetic_encounters(spark: SparkSession, d: str) -> DataFrame:
    """Drawn encounters of a fixed seed, one partition to each block of numbers."""
    schema = "encounter long, side int, place int, x double, y double"

    def draw(it):
        import pandas as pd

        for pdf in it:
            for i in pdf["id"].tolist():
                own = cv.synthetic_encounters(1, 42 + i)[0].round(6)
                yield pd.DataFrame([(i, s, n, *p) for s in (0, 1) for n, p in enumerate(own[s].tolist())], columns=["encounter", "side", "place", "x", "y"])

    return spark.range(8).mapInPandas(draw, schema)


_T = f"WITH {SQL_TRACKS}"
_TY = "CASE WHEN {0}%10<=5 THEN 0 WHEN {0}%10<=7 THEN 1 ELSE 2 END"
_SUMS = f"""{_T}, sv AS (SELECT *, {sql_norm('x - lag(x) OVER w', 'y - lag(y) OVER w')} AS st FROM tracks WHERE valid WINDOW w AS (PARTITION BY scenario_id, agent_id ORDER BY t)),
su AS (SELECT a.scenario_id, a.agent_id AS i, b.agent_id AS j, count(*) AS n, sum(a.x) AS mxi, sum(a.y) AS myi, sum(b.x) AS mxj, sum(b.y) AS myj, sum(a.x*b.x) AS xx, sum(a.y*b.y) AS yy, sum(a.x*b.y) AS xy, sum(a.y*b.x) AS yx,
   sum(a.x*a.x+a.y*a.y) AS qi, sum(b.x*b.x+b.y*b.y) AS qj, avg(abs(a.st-b.st)) AS speed FROM sv a JOIN sv b ON a.scenario_id=b.scenario_id AND a.t=b.t AND a.agent_id<b.agent_id GROUP BY 1,2,3),
sc AS (SELECT *, xx-mxi*mxj/n AS cxx, yy-myi*myj/n AS cyy, xy-mxi*myj/n AS cxy, yx-myi*mxj/n AS cyx, sqrt((qi-(mxi*mxi+myi*myi)/n)*(qj-(mxj*mxj+myj*myj)/n)) AS size FROM su),
sd AS (SELECT *, sqrt((cxx+cyy)*(cxx+cyy)+(cxy-cyx)*(cxy-cyx)) AS tu, sqrt((cxx-cyy)*(cxx-cyy)+(cxy+cyx)*(cxy+cyx)) AS mi FROM sc WHERE size > 1e-6),
pd AS (SELECT scenario_id, i, j, n, round(sqrt(greatest(0, 2-2*tu/size)), 6) AS rotated, round(sqrt(greatest(0, 2-2*greatest(tu, mi)/size)), 6) AS reflected, speed FROM sd WHERE n >= 3)"""
_ENDS = f"""{_T}, ends AS (SELECT scenario_id, agent_id, round(arg_max(x,t)-arg_min(x,t),2) AS x, round(arg_max(y,t)-arg_min(y,t),2) AS y FROM tracks WHERE valid GROUP BY 1,2),
ep AS (SELECT a.scenario_id, a.agent_id AS i, b.agent_id AS j, round({sql_norm('a.x-b.x', 'a.y-b.y')}, 6) AS d, {_TY.format('a.agent_id')} = {_TY.format('b.agent_id')} AS same FROM ends a JOIN ends b ON a.scenario_id=b.scenario_id AND a.agent_id<b.agent_id)"""
_MED = f"""{_ENDS}, mm AS (SELECT a.scenario_id, a.agent_id, round(avg({sql_norm('a.x-b.x', 'a.y-b.y')}), 6) AS m FROM ends a JOIN ends b ON a.scenario_id=b.scenario_id AND a.agent_id<>b.agent_id GROUP BY 1,2),
md AS (SELECT scenario_id, agent_id AS medoid FROM mm QUALIFY row_number() OVER (PARTITION BY scenario_id ORDER BY m, agent_id)=1),
tm AS (SELECT e.scenario_id, e.agent_id, medoid, round({sql_norm('e.x-c.x', 'e.y-c.y')}, 6) AS d FROM ends e JOIN md USING (scenario_id) JOIN ends c ON c.scenario_id=e.scenario_id AND c.agent_id=medoid)"""
_STAB = """WITH e AS (SELECT vec_id, """ + ", ".join(f"round(embedding[{i + 1}]::double, 4) AS x{i}" for i in range(4)) + """ FROM embeddings),
g AS (SELECT CAST(k AS INT) AS k, CAST(d AS INT) AS dims, vec_id % k AS c, """ + ", ".join(f"CASE WHEN d > {i} THEN x{i} ELSE 0 END AS x{i}" for i in range(4)) + """ FROM e, range(2, 6) a(k), range(1, 5) b(d)),
p AS (SELECT k, dims, c, count(*) AS n, """ + " + ".join(f"sum(x{i}*x{i}) - sum(x{i})*sum(x{i})/count(*)" for i in range(4)) + """ AS s FROM g GROUP BY 1,2,3),
stab AS (SELECT k, dims, sum(s)/(2*sum(n)) AS stat FROM p GROUP BY 1,2)"""

QUERIES = {
    "bearing_angle": (bearing_angle, f"{_T} SELECT scenario_id, agent_id, {sql_r4('atan2(y,x) - 2*pi()*floor(atan2(y,x)/(2*pi()))', 'angle')} FROM tracks WHERE t=10"),
    "max_abs_distances": (max_abs_distances, f"{_T},{SQL_ALIGNED} SELECT scenario_id, i, j, {sql_r4('max(greatest(abs(xi-xj), abs(yi-yj)))', 'd')} FROM aligned GROUP BY 1,2,3"),
    "procrustes_matrix": (procrustes_matrix, f"{_SUMS} SELECT scenario_id, i, j, {sql_r4('rotated', 'rotated')}, {sql_r4('reflected', 'reflected')}, {sql_r4('rotated + 0.1::double*speed', 'with_speed')} FROM pd"),
    "center_distances": (center_distances, f"{_SUMS} SELECT scenario_id, j AS agent_id, {sql_r4('rotated', 'd')} FROM pd QUALIFY i = min(i) OVER (PARTITION BY scenario_id)"),
    "relative_encounters": (relative_encounters, f"""{_T},{SQL_ALIGNED}, f AS (SELECT *, xj-xi AS dx, yj-yi AS dy, atan2(first(yj-yi) OVER w, first(xj-xi) OVER w) AS h, min(t) OVER p AS a, max(t) OVER p AS b FROM aligned WHERE d < 100 WINDOW w AS (PARTITION BY scenario_id, i, j ORDER BY t), p AS (PARTITION BY scenario_id, i, j))
        SELECT scenario_id, i, j, count(*) AS n, {sql_r4('min(dx*cos(h) + dy*sin(h))', 'min_rx')}, {sql_r4('max(dy*cos(h) - dx*sin(h))', 'max_ry')}, {sql_r4('avg(coalesce((t-a)::double/nullif(b-a, 0)::double, 0))', 'mean_share')} FROM f GROUP BY 1,2,3"""),
    "graph_laplacian": (graph_laplacian, f"""{_T},{SQL_ALIGNED}, w AS (SELECT scenario_id, i, j, round(exp(-min(d)/10), 6) AS w FROM aligned GROUP BY 1,2,3), b AS (SELECT * FROM w UNION ALL SELECT scenario_id, j, i, w FROM w),
        g AS (SELECT scenario_id, i AS a, sum(w) AS g FROM b GROUP BY 1,2) SELECT b.scenario_id, b.i, b.j, {sql_r4('-w', 'plain')}, {sql_r4('-w/sqrt(x.g*y.g)', 'normal')} FROM b JOIN g x ON x.scenario_id=b.scenario_id AND x.a=b.i JOIN g y ON y.scenario_id=b.scenario_id AND y.a=b.j
        UNION ALL SELECT scenario_id, a, a, {sql_r4('g', 'plain')}, 1.0::double FROM g"""),
    "min_max_ratio": (min_max_ratio, f"{_ENDS} SELECT scenario_id, {sql_r4('min(d) FILTER (NOT same)/nullif(max(d) FILTER (same), 0)', 'ratio')} FROM ep GROUP BY 1"),
    "cluster_square_stats": (cluster_square_stats, f"{_ENDS} SELECT scenario_id, same, count(*) AS n, {sql_r4('avg(d*d)', 'mean')}, {sql_r4('var_samp(d*d)', 'var')} FROM ep GROUP BY 1,2"),
    "within_cluster_distance": (within_cluster_distance, f"{_MED} SELECT scenario_id, medoid, {sql_r4('sum(d*d)', 'total')} FROM tm GROUP BY 1,2"),
    "ordered_members": (ordered_members, f"{_MED} SELECT scenario_id, agent_id, CAST(row_number() OVER (PARTITION BY scenario_id ORDER BY d, agent_id) AS INT) AS rank, {sql_r4('d', 'd')} FROM tm"),
    "medoid_curves": (medoid_curves, f"{_MED} SELECT scenario_id, agent_id, t, {sql_r4('x', 'x')}, {sql_r4('y', 'y')} FROM tracks JOIN md USING (scenario_id) WHERE agent_id = medoid"),
    "curve_extents": (curve_extents, f"{_MED}, c AS (SELECT {sql_r4('x', 'x')}, {sql_r4('y', 'y')} FROM tracks JOIN md USING (scenario_id) WHERE agent_id = medoid) SELECT min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y FROM c"),
    "clusters_by_size": (clusters_by_size, "WITH n AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1) SELECT label, n, row_number() OVER (ORDER BY n DESC, label) - 1 AS rank FROM n"),
    "mismatch_costs": (mismatch_costs, """WITH l AS (SELECT CAST(label AS BIGINT) AS a, vec_id % 7 AS b FROM embeddings), x AS (SELECT a, count(*) AS na FROM l GROUP BY 1), y AS (SELECT b, count(*) AS nb FROM l GROUP BY 1), z AS (SELECT a, b, count(*) AS n FROM l GROUP BY 1,2)
        SELECT x.a, y.b, na + nb - 2*coalesce(n, 0) AS cost FROM x CROSS JOIN y LEFT JOIN z ON z.a=x.a AND z.b=y.b"""),
    "stability_stat": (stability_stat, f"{_STAB} SELECT k, dims, {sql_r4('stat', 'stat')} FROM stab"),
    "stability_change": (stability_change, f"{_STAB} SELECT a.k, a.dims, {sql_r4('avg(abs(a.stat-b.stat))', 'change')} FROM stab a JOIN stab b ON abs(a.k-b.k) + abs(a.dims-b.dims) = 1 GROUP BY 1,2"),
    "cell_text": (cell_text, f"""{_ENDS}, m AS (SELECT CASE WHEN agent_id%10<=5 THEN 'TYPE_VEHICLE' WHEN agent_id%10<=7 THEN 'TYPE_PEDESTRIAN' ELSE 'TYPE_CYCLIST' END AS object_type, sqrt(x*x+y*y) AS m FROM ends)
        SELECT object_type, printf('$%.2f \\pm %.2f$', round(avg(m), 6), round(stddev_pop(m), 6)) AS cell FROM m GROUP BY 1"""),
    "orientation_table": (orientation_table, "SELECT id, 1 - 2*(id % 2) AS sx, 1 - 2*(id // 2) AS sy FROM range(4) r(id)"),
    "joint_procrustes_matrix": (joint_procrustes_matrix, None),
    "polynomials": (polynomials, None),
    "center_polynomials": (center_polynomials, None),
    "recursive_splits": (recursive_splits, None),
    "joint_change_points": (joint_change_points, None),
    "primitive_curves": (primitive_curves, None),
    "piecewise_matrix": (piecewise_matrix, None),
    "window_matrix": (window_matrix, None),
    "warping_clusters": (warping_clusters, None),
    "shape_clusters": (shape_clusters, None),
    "consensus_clusters": (consensus_clusters, None),
    "spectral_clusters": (spectral_clusters, None),
    "polynomial_clusters": (polynomial_clusters, None),
    "silhouette_sweep": (silhouette_sweep, None),
    "held_out_error": (held_out_error, None),
    "matched_clusters": (matched_clusters, None),
    "prepared_curves": (prepared_curves, None),
    "synthetic_encounters": (synthetic_encounters, None),
}
