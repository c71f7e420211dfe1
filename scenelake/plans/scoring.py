"""Registered queries: features, scores and splits of scenes."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scenelake.functions.geometry import miles_per_hour, round_
from scenelake.operators import kinematics as k
from scenelake.operators import lanes as ln
from scenelake.operators import pairs as p
from scenelake.operators import scoring as sc
from scenelake.plans.helpers import r4, rounded, sql_norm, sql_r4
from scenelake.plans.kinematics import SQL_KIN, SQL_MOVING
from scenelake.plans.lanes import SQL_NEAR
from scenelake.plans.pairs import SQL_CP, conflict_points, sql_features
from scenelake.plans.primitives import SQL_ANOMALY, anomaly_weighted, pair_anomaly
from scenelake.sources import world
from scenelake.sources.shared import handed_on
from scenelake.sources.world import SQL_LANES, SQL_POINTS, SQL_TRACKS

A = k.AGENT


def _completed(tracks: DataFrame) -> DataFrame:
    """Tracks with every step: gaps interpolated, ends extrapolated."""
    t = k.interpolate(tracks)
    return t.select(*A, "t", round_("fx", 4).alias("x"), round_("fy", 4).alias("y"), F.lit(True).alias("valid")).where("x is not null")


def _both_tracks(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """Reported (gt) and completed (fe) tracks, handed on: every use in a plan would order all steps anew."""
    gt = handed_on(world.tracks(spark, d), "reported-tracks")
    return {"gt": gt, "fe": handed_on(_completed(gt), "completed-tracks")}


def _lane_terms(spark: SparkSession, d: str, moving: DataFrame) -> DataFrame:
    """Greatest excess over the limit of the nearest lane within 5 m, and the share of valid steps with one."""
    lanes = world.lanes(spark, d)
    near = ln.near(moving, world.scene_maps(moving), lanes, world.lane_points(spark, d), k=1)
    limits = lanes.select("lane_id", miles_per_hour(F.col("limit_mph")).alias("limit"))
    speeds = near.join(limits, "lane_id").join(moving.select(*A, "t", "speed"), [*A, "t"])
    inside = speeds.groupBy(*A).agg(F.max(F.col("speed") - F.col("limit")).alias("over_limit"), F.count("*").alias("n_in"))
    every = moving.groupBy(*A).agg(F.count_if("valid").alias("n_valid")).join(inside, A, "left")
    share = F.coalesce(F.try_divide(F.col("n_in").cast("double"), F.col("n_valid").cast("double")), F.lit(0.0))
    return every.select(*A, F.coalesce("over_limit", F.lit(0.0)).alias("over_limit"), share.alias("in_lane"))


def _individual(spark: SparkSession, d: str, tracks: DataFrame | None = None) -> DataFrame:
    """Features of each agent: motion, seconds of waiting, lanes and the anomaly of its primitives."""
    t = world.tracks(spark, d) if tracks is None else tracks
    wait = k.waiting_periods(t).groupBy(*A).agg(F.sum("n").alias("waits"))
    moving = k.kinematics(t)
    f = sc.individual_features(moving).join(wait, A, "left").join(_lane_terms(spark, d, moving), A)
    f = f.join(anomaly_weighted(spark, d), A, "left")
    return f.select("*", F.coalesce(F.col("waits") * k.H, F.lit(0.0)).alias("wait")).drop("waits")


INDIVIDUAL = ("speed", "acc_x", "acc_y", "jerk_x", "jerk_y", "wait", "over_limit", "in_lane", "anomaly")


def _own_score(f: DataFrame) -> DataFrame:
    return f.select(*A, round_(sc.individual_score({c: F.col(c) for c in INDIVIDUAL}), 6).alias("own"))


def _features(spark: SparkSession, d: str, tracks: DataFrame | None = None, reported: DataFrame | None = None) -> DataFrame:
    """Features of pairs; with ``reported``, of ordered pairs, i of ``tracks`` and j of these."""
    moving = world.with_type(k.with_motion(world.tracks(spark, d) if tracks is None else tracks))
    other = None if reported is None else world.with_type(k.with_motion(reported))
    return p.interaction_features(moving, world.scene_maps(moving), conflict_points(spark, d), other)


def _scored(pairs: DataFrame, anomalies: DataFrame, name: str = "score") -> DataFrame:
    """Pairs in either order with their score; ``anomalies`` are of unordered pairs."""
    key = {"i": F.least("i", "j"), "j": F.greatest("i", "j")}
    keyed = pairs.select("*", F.struct("scenario_id", *(c.alias(n) for n, c in key.items())).alias("_k"))
    both = keyed.join(anomalies.select(F.struct(*p.PAIR).alias("_k"), "anomaly"), "_k", "left")
    cols = {c: F.col(c) for c in p.FEATURES} | {"anomaly": F.coalesce("anomaly", F.lit(0.0))}
    return both.select(*p.PAIR, round_(sc.interaction_score(cols), 6).alias(name), "min_d", *p.FEATURES)


def _pair_score(spark: SparkSession, d: str) -> DataFrame:
    return _scored(_features(spark, d), pair_anomaly(spark, d)).select(*p.PAIR, "score", "min_d")


def individual_summary(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_individual(spark, d), *INDIVIDUAL).select(*A, *INDIVIDUAL)


def individual_score(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_own_score(_individual(spark, d)), "own")


def interaction_score(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_pair_score(spark, d).drop("min_d"), "score")


def _agent_scores(spark: SparkSession, d: str) -> DataFrame:
    """Own and total score of each agent, and its least distance to a target, from one pass over pairs."""
    sides = p.both_sides(_pair_score(spark, d), "score", "min_d")
    target = F.when(F.col("other") % 10 <= 2, F.col("min_d"))
    near = sides.groupBy(*A).agg(sc.exact_sum("score").alias("score"), F.min(target).alias("d"))
    own = _own_score(_individual(spark, d)).join(near, A, "left")
    return own.select(*A, "own", round_(F.col("own") + F.coalesce("score", F.lit(0.0)), 6).alias("total"), "d")


def agent_scores(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_agent_scores(spark, d).drop("d"), "own", "total")


def _scene_scores(spark: SparkSession, d: str) -> DataFrame:
    s = _agent_scores(spark, d)
    return sc.scene_score(s.select("scenario_id", F.col("total").alias("score"), "d", (F.col("agent_id") % 10 <= 2).alias("is_target")))


def scene_scores(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_scene_scores(spark, d), "score")


def score_percentile_split(spark: SparkSession, d: str) -> DataFrame:
    return rounded(sc.score_split(_scene_scores(spark, d)).drop("limit"), "score")


def _variant_pairs(spark: SparkSession, d: str, tracks: dict[str, DataFrame] | None = None) -> DataFrame:
    """Unordered pairs with gt, fe, lim and one-sided scores, and both least distances."""
    t = tracks or _both_tracks(spark, d)
    # each handed on, as the driver would hold one plan of all
    a = handed_on(pair_anomaly(spark, d), "anomalies")
    fe = handed_on(_scored(_features(spark, d, t["fe"]), a, "fe"), "completed")
    gt = handed_on(_scored(_features(spark, d, t["gt"]), a, "gt"), "reported")
    sides = handed_on(sc.rekeyed(_scored(_features(spark, d, t["fe"], t["gt"]), a), "score"), "one-sided")
    of = lambda df, n: [F.col(c).alias(f"{c}_{n}") for c in p.FEATURES] + [F.col("min_d").alias(f"d_{n}")]
    both = fe.select(*p.PAIR, "fe", *of(fe, "fe")).join(gt.select(*p.PAIR, "gt", *of(gt, "gt")), p.PAIR, "left")
    both = both.join(a, p.PAIR, "left").join(sides, p.PAIR, "left")
    most = {c: F.greatest(F.col(f"{c}_fe"), F.coalesce(f"{c}_gt", F.lit(0.0))) for c in p.FEATURES}
    lim = round_(sc.interaction_score(most | {"anomaly": F.coalesce("anomaly", F.lit(0.0))}), 6)
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    # a pair without a common reported step still has its anomaly
    gt_score = F.coalesce("gt", round_(F.least(F.lit(5.0), 0.1 * F.coalesce("anomaly", F.lit(0.0))), 6)).alias("gt")
    return both.select(*p.PAIR, "fe", gt_score, lim.alias("lim"), zero("side0"), zero("side1"), "d_fe", "d_gt")


def _agent_variants(spark: SparkSession, d: str) -> DataFrame:
    t = _both_tracks(spark, d)
    own = [handed_on(_own_score(_individual(spark, d, t[n])).select(*A, F.col("own").alias(f"own_{n}")), "own") for n in ("gt", "fe")]
    sides = sc.pair_variants(_variant_pairs(spark, d, t))
    near = F.col("other") % 10 <= 2
    sums = sides.groupBy(*A).agg(
        *(sc.exact_sum(v).alias(f"_{v}") for v in sc.VARIANTS), *(F.min(F.when(near, F.col(f"d_{n}"))).alias(f"d_{n}") for n in ("gt", "fe"))
    )
    every = own[0].join(own[1], A).join(sums, A, "left")
    mine = sc.own_variants(F.col("own_gt"), F.col("own_fe"))
    return every.select(*A, "d_gt", "d_fe", *(round_(mine[v] + F.coalesce(f"_{v}", F.lit(0.0)), 6).alias(v) for v in sc.VARIANTS))


def agent_score_variants(spark: SparkSession, d: str) -> DataFrame:
    """Each agent's score in the six variants."""
    # totals have six decimals, so a tie is one in decimal form
    return _agent_variants(spark, d).select(*A, *((F.round(v, 4) + 0.0).alias(v) for v in sc.VARIANTS))


def _scene_variants(spark: SparkSession, d: str) -> DataFrame:
    s = _agent_variants(spark, d)
    near = {"gt": F.col("d_gt"), "fe": F.col("d_fe")}
    rows = s.select(
        "scenario_id",
        (F.col("agent_id") % 10 <= 2).alias("is_target"),
        F.explode(
            F.array(*(F.struct(F.lit(v).alias("v"), F.col(v).alias("score"), near.get(v, F.least("d_gt", "d_fe")).alias("d")) for v in sc.VARIANTS))
        ).alias("r"),
    ).select("scenario_id", "is_target", "r.*")
    scored = sc.scene_score(rows.withColumn("scenario_id", F.struct("scenario_id", "v")))
    return scored.select("scenario_id.scenario_id", F.col("scenario_id.v").alias("variant"), "score")


def scene_score_variants(spark: SparkSession, d: str) -> DataFrame:
    """Each scene's score in the six variants; weights by the distances that the variant knows."""
    return rounded(_scene_variants(spark, d), "score")


def score_variants(spark: SparkSession, d: str) -> DataFrame:
    """plus = gt + sqrt(fe) and plus_cond = gt + sqrt(max(gt, fe)) of each scene."""
    s = _scene_variants(spark, d).where("variant in ('gt', 'fe')").groupBy("scenario_id").pivot("variant", ["gt", "fe"]).agg(F.max("score"))
    return s.select("scenario_id", r4("plus", F.col("gt") + F.sqrt("fe")), r4("plus_cond", F.col("gt") + F.sqrt(F.greatest("gt", "fe"))))


def asym_pair_rekey(spark: SparkSession, d: str) -> DataFrame:
    """One-sided scores of ordered pairs put on unordered ones, beside the score of the reported tracks."""
    s = _variant_pairs(spark, d)
    most = [F.greatest("gt", f"side{n}").alias(f"asym{n}") for n in (0, 1)]
    return rounded(s.select(*p.PAIR, "gt", "side0", "side1", *most), "gt", "side0", "side1", "asym0", "asym1")


def asym_ratio(spark: SparkSession, d: str) -> DataFrame:
    """Each agent's one-sided over its symmetric score."""
    return _agent_variants(spark, d).select(*A, r4("ratio", F.try_divide(F.col("asym_combined"), F.col("gt"))))


def cluster_split(spark: SparkSession, d: str) -> DataFrame:
    """Scenes of clusters 0 and 3 (of 5) go to test, others to train and val."""
    s = world.tracks(spark, d).select("scenario_id").distinct().withColumn("cluster", F.col("scenario_id") % 5)
    split = F.when(F.col("cluster").isin(0, 3), "test").when(sc.hash_bucket(F.col("scenario_id")) < 80, "train").otherwise("val")
    return s.withColumn("split", split)


def uniform_split(spark: SparkSession, d: str) -> DataFrame:
    """All splits united, then 85 : 7.5 : 7.5 by hash."""
    o = world.table(spark, d, "orders").select(F.col("o_orderkey").alias("scenario_id"))
    parts = [o.where(F.col("scenario_id") % 3 == i) for i in range(3)]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    b = sc.hash_bucket(F.col("scenario_id"), 1000)
    return every.withColumn("split", F.when(b < 850, "train").when(b < 925, "val").otherwise("test"))


def _numbered(spark: SparkSession, d: str) -> DataFrame:
    """Scenario index with global row numbers: blocks are summed, and blocks of blocks, so that no
    task orders more than one of them but the outermost, a row for each 16 million ids."""
    o = world.table(spark, d, "orders").select(F.col("o_orderkey").alias("id")).distinct()
    b = o.withColumn("block", F.floor(F.col("id") / 4096)).withColumn("outer", F.floor(F.col("block") / 4096))
    n = b.groupBy("outer", "block").agg(F.count("*").alias("n"))
    before = Window.partitionBy("outer").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    inner = n.select("outer", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("inner"))
    outer = n.groupBy("outer").agg(F.sum("n").alias("n"))
    far = Window.orderBy("outer").rowsBetween(Window.unboundedPreceding, -1)
    base = outer.select("outer", F.coalesce(F.sum("n").over(far), F.lit(0)).alias("base"))
    total = n.agg(F.sum("n").alias("total"))
    own = F.row_number().over(Window.partitionBy("outer", "block").orderBy("id"))
    placed = b.join(inner, ["outer", "block"]).join(base, "outer").crossJoin(F.broadcast(total))  # one row
    return placed.select("id", (F.col("base") + F.col("inner") + own - 1).alias("rn"), "total")


def stride_sample(spark: SparkSession, d: str) -> DataFrame:
    return _numbered(spark, d).where(F.col("rn") % 7 == 0).select("id", "rn")


def shard_slice(spark: SparkSession, d: str) -> DataFrame:
    """Contiguous shard 2 of 10."""
    return _numbered(spark, d).where(F.floor(F.col("rn") / F.ceil(F.col("total") / 10)) == 2).select("id", "rn")


def bootstrap_sample(spark: SparkSession, d: str) -> DataFrame:
    """Resampling with replacement by a hash of the row number: (id, times drawn)."""
    n = _numbered(spark, d)
    draw = n.select((sc.hash_bucket(F.col("rn"), 1 << 30) % F.col("total")).alias("rn"))
    return draw.groupBy("rn").agg(F.count("*").alias("times")).join(n.select("id", "rn"), "rn").select("id", "times")


def endpoint_motion(spark: SparkSession, d: str) -> DataFrame:
    """Motion from now to step 60 of agents valid at both."""
    at = lambda n: F.max(F.when(F.col("valid") & (F.col("t") == n), F.struct("x", "y")))
    e = world.tracks(spark, d).groupBy(*A).agg(at(world.NOW).alias("a"), at(60).alias("b")).where("a is not null and b is not null")
    return e.select(*A, r4("dx", F.col("b.x") - F.col("a.x")), r4("dy", F.col("b.y") - F.col("a.y")))


def type_counts(spark: SparkSession, d: str) -> DataFrame:
    """Agents of each object type, types without any included."""
    names = F.explode(F.array(*(F.lit(f"TYPE_{n}") for n in ("UNSET", "VEHICLE", "PEDESTRIAN", "CYCLIST", "OTHER")))).alias("object_type")
    n = world.with_type(world.tracks(spark, d)).groupBy("object_type").agg(F.countDistinct("agent_id").alias("n"))
    return spark.range(1).select(names).join(n, "object_type", "left").select("object_type", F.coalesce("n", F.lit(0)).alias("n"))


def score_distribution(spark: SparkSession, d: str) -> DataFrame:
    s = _agent_scores(spark, d).select("total")
    q = sc.percentiles(s, "total", {f"p{i}": x for i, x in enumerate((0.005, 0.5, 0.8, 0.995))})
    n = s.agg(F.count("*").alias("n"), F.avg("total").alias("mean"))
    return rounded(n.crossJoin(F.broadcast(q)), "mean", "p0", "p1", "p2", "p3")  # one row each


def sql_own(tag: str, tracks: str) -> str:
    """CTEs ending in ``{tag}`` (scenario_id, agent_id, the features) and ``own_{tag}`` with the score, of tracks
    named ``tracks``."""
    kin = f"{SQL_MOVING},{SQL_KIN},{SQL_NEAR}"
    for name in ("moving", "_acc", "kin", "_ap", "_v", "_u", "_o", "_d", "near"):
        kin = re.sub(rf"(?<![\w.]){name}(?= AS \()|(?<=FROM ){name}(?!\w)", f"{name}_{tag}", kin)
    kin = re.sub(r"(?<=FROM )tracks(?!\w)", tracks, kin).replace("JOIN _ap p", f"JOIN _ap_{tag} p")
    a, j = norm("acc"), norm("jerk")
    return f"""{kin},
_st_{tag} AS (SELECT *, {sql_norm('x - lead(x) OVER w','y - lead(y) OVER w')} AS step FROM {tracks} WINDOW w AS (PARTITION BY scenario_id, agent_id ORDER BY t)),
_wt_{tag} AS (SELECT scenario_id, agent_id, count(*) FILTER (step < 0.5) AS waits FROM _st_{tag} GROUP BY 1,2),
_lt_{tag} AS (SELECT m.scenario_id, m.agent_id, coalesce(max(speed - limit_mph*(1.609344::double*1000/3600)), 0) AS over_limit, coalesce(count(n.lane_id)/nullif(count(*) FILTER (valid), 0)::double, 0) AS in_lane
   FROM moving_{tag} m LEFT JOIN near_{tag} n ON n.scenario_id=m.scenario_id AND n.agent_id=m.agent_id AND n.t=m.t AND n.rank=1 AND n.d<=5 LEFT JOIN lanes l ON l.lane_id=n.lane_id GROUP BY 1,2),
{tag} AS (SELECT k.scenario_id, k.agent_id, max(speed) AS speed, max(abs(acc_x)) AS acc_x, max(abs(acc_y)) AS acc_y, max(abs(jerk_x)) AS jerk_x, max(abs(jerk_y)) AS jerk_y,
   any_value(waits)*0.1::double AS wait, any_value(over_limit) AS over_limit, any_value(in_lane) AS in_lane, any_value(anomaly) AS anomaly
   FROM kin_{tag} k JOIN _wt_{tag} USING (scenario_id, agent_id) JOIN _lt_{tag} USING (scenario_id, agent_id) JOIN anomalies USING (scenario_id, agent_id) GROUP BY 1,2),
own_{tag} AS (SELECT scenario_id, agent_id, round(least(10, greatest(0, over_limit)) + least(10, 0.1::double*{a}) + least(10, 0.01::double*{j}) + least(10, 0.1::double*speed) + least(5, anomaly) + least(7.75::double, sqrt(wait)) + 1 - in_lane, 6) AS own FROM {tag})"""


def norm(c: str) -> str:
    return f"sqrt({c}_x*{c}_x+{c}_y*{c}_y)"


def sql_score(c: str = "") -> str:
    f = {x: c.format(x) if c else x for x in p.FEATURES}
    return f"round(least(2,{f['drac']}/5) + {f['collisions']} + least(5, 0.1::double*coalesce(anomaly, 0)) + least(2,{f['thw']}) + least(4,{f['scene_mttcp']}) + least(4,{f['mttcp']}) + least(2,{f['ttc']}), 6)"


SQL_PA = f"{SQL_ANOMALY}, panom AS (SELECT x.scenario_id, x.agent_id AS i, y.agent_id AS j, greatest(x.anomaly, y.anomaly) AS anomaly FROM anomalies x JOIN anomalies y ON x.scenario_id=y.scenario_id AND x.agent_id<y.agent_id)"
_BASE = f"WITH {SQL_TRACKS},{SQL_MOVING},{SQL_PA},{SQL_LANES},{SQL_POINTS},{SQL_CP}"
_SO = f"{_BASE},{sql_own('indiv', 'tracks')}"
SQL_PAIR = f"{sql_features('features')}, pscore AS (SELECT scenario_id, i, j, {sql_score()} AS score, min_d FROM features LEFT JOIN panom USING (scenario_id, i, j))"
SQL_AGENT = """
_sp AS (SELECT scenario_id, a AS agent_id, sum(score) AS score, min(min_d) FILTER (b%10<=2) AS d FROM (SELECT scenario_id, i AS a, j AS b, score, min_d FROM pscore UNION ALL SELECT scenario_id, j, i, score, min_d FROM pscore) GROUP BY 1,2),
ascore AS (SELECT scenario_id, agent_id, own, own + coalesce(score, 0) AS total, d FROM own_indiv LEFT JOIN _sp USING (scenario_id, agent_id))"""


def sql_scene(tag: str, agents: str, score: str, d: str, by: str = "scenario_id") -> str:
    w = f"CASE WHEN agent_id%10<=2 THEN 1.0::double ELSE coalesce(1/(1+{d}),0) END"
    n = "count(*) FILTER (agent_id%10<=2)"
    return f"{tag} AS (SELECT {by}, sum({w}*{score})/({n} + sqrt(greatest(0, count(*) - {n})::double)) AS score FROM {agents} GROUP BY ALL)"


SQL_SCENE = sql_scene("scene", "ascore", "total", "d")
_ALL = f"{_SO},{SQL_PAIR},{SQL_AGENT}"
_SC = f"{_ALL},{SQL_SCENE}"
# completed tracks, their motion, and the three sets of pair features
_FILLED = """
_q AS (SELECT *, max(CASE WHEN valid THEN t END) OVER (PARTITION BY scenario_id, agent_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS pt,
   min(CASE WHEN valid THEN t END) OVER (PARTITION BY scenario_id, agent_id ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nt FROM moving),
_j AS (SELECT q.*, p.x AS px, p.y AS py, p.vx AS pvx, p.vy AS pvy, n.x AS nx, n.y AS ny FROM _q q
   LEFT JOIN moving p ON p.scenario_id=q.scenario_id AND p.agent_id=q.agent_id AND p.t=q.pt LEFT JOIN moving n ON n.scenario_id=q.scenario_id AND n.agent_id=q.agent_id AND n.t=q.nt),
filled AS (SELECT scenario_id, agent_id, t, """ + ", ".join(
    f"round(CASE WHEN valid THEN {a} WHEN pt IS NULL THEN n{a} WHEN nt IS NULL THEN p{a} + pv{a}*0.1::double*(t-pt) ELSE p{a} + (n{a}-p{a})*((t-pt)::double/(nt-pt)::double) END, 4) AS {a}" for a in "xy"
) + ", true AS valid FROM _j WHERE pt IS NOT NULL OR nt IS NOT NULL)"
_MOVED = re.sub(r"(?<=FROM )tracks(?!\w)", "filled", SQL_MOVING).replace("moving AS", "moved AS")
_VARIANT = f"""{_SO},{_FILLED},{_MOVED},{sql_own('compl', 'filled')},{sql_features('fgt')},{sql_features('ffe', 'moved', 'moved')},{sql_features('fas', 'moved', 'moving', '<>')},
_gt AS (SELECT *, {sql_score()} AS gt FROM fgt LEFT JOIN panom USING (scenario_id, i, j)), _fe AS (SELECT *, {sql_score()} AS fe FROM ffe LEFT JOIN panom USING (scenario_id, i, j)),
_as AS (SELECT f.scenario_id, least(f.i, f.j) AS i, greatest(f.i, f.j) AS j, f.i > f.j AS later, {sql_score()} AS score FROM fas f LEFT JOIN panom a ON a.scenario_id=f.scenario_id AND a.i=least(f.i, f.j) AND a.j=greatest(f.i, f.j)),
_si AS (SELECT scenario_id, i, j, coalesce(max(score) FILTER (NOT later), 0) AS side0, coalesce(max(score) FILTER (later), 0) AS side1 FROM _as GROUP BY 1,2,3),
pv AS (SELECT f.scenario_id, f.i, f.j, f.fe, coalesce(g.gt, round(least(5, 0.1::double*coalesce(f.anomaly, 0)), 6)) AS gt, {sql_score('greatest(f.{0}, coalesce(g.{0}, 0))').replace('coalesce(anomaly, 0)', 'coalesce(f.anomaly, 0)')} AS lim,
   coalesce(side0, 0) AS side0, coalesce(side1, 0) AS side1, f.min_d AS d_fe, g.min_d AS d_gt
   FROM _fe f LEFT JOIN _gt g ON g.scenario_id=f.scenario_id AND g.i=f.i AND g.j=f.j LEFT JOIN _si s ON s.scenario_id=f.scenario_id AND s.i=f.i AND s.j=f.j),
_bs AS (SELECT scenario_id, i AS agent_id, j AS other, gt, fe, lim, side0 AS own, d_gt, d_fe FROM pv UNION ALL SELECT scenario_id, j, i, gt, fe, lim, side1, d_gt, d_fe FROM pv),
_su AS (SELECT scenario_id, agent_id, sum(gt) AS gt, sum(fe) AS fe, sum(own) AS asym, sum(greatest(gt, fe)) AS combined, sum(greatest(gt, own)) AS asym_combined, sum(lim) AS fe_lim,
   min(d_gt) FILTER (other%10<=2) AS d_gt, min(d_fe) FILTER (other%10<=2) AS d_fe FROM _bs GROUP BY 1,2),
av AS (SELECT g.scenario_id, g.agent_id, d_gt, d_fe, """ + ", ".join(
    f"{own} + coalesce(s.{v}, 0) AS {v}"
    for v, own in {"gt": "g.own", "fe": "f.own", "asym": "f.own", "combined": "greatest(g.own, f.own)", "asym_combined": "greatest(g.own, f.own)", "fe_lim": "g.own"}.items()
) + " FROM own_indiv g JOIN own_compl f USING (scenario_id, agent_id) LEFT JOIN _su s USING (scenario_id, agent_id))"
_SV = _VARIANT + ", ul AS (" + " UNION ALL ".join(
    f"SELECT scenario_id, agent_id, '{v}' AS variant, {v} AS score, {({'gt': 'd_gt', 'fe': 'd_fe'}).get(v, 'least(d_gt, d_fe)')} AS d FROM av" for v in sc.VARIANTS
) + "), " + sql_scene("sv", "ul", "score", "d", "scenario_id, variant")


def _hb(x: str, n: str = "100") -> str:
    return f"((({x})::BIGINT*2654435761 + 40503) % 2147483648) % {n}"


_NUM = "WITH o AS (SELECT DISTINCT o_orderkey AS id FROM orders), n AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS rn, (SELECT count(*) FROM o) AS total FROM o)"

QUERIES = {
    "individual_summary": (individual_summary, f"{_SO} SELECT scenario_id, agent_id, " + ", ".join(sql_r4(c, c) for c in INDIVIDUAL) + " FROM indiv"),
    "individual_score": (individual_score, f"{_SO} SELECT scenario_id, agent_id, {sql_r4('own','own')} FROM own_indiv"),
    "interaction_score": (interaction_score, f"{_BASE},{SQL_PAIR} SELECT scenario_id, i, j, {sql_r4('score','score')} FROM pscore"),
    "agent_scores": (agent_scores, f"{_ALL} SELECT scenario_id, agent_id, {sql_r4('own','own')}, {sql_r4('total','total')} FROM ascore"),
    "scene_scores": (scene_scores, f"{_SC} SELECT scenario_id, {sql_r4('score','score')} FROM scene"),
    "score_percentile_split": (score_percentile_split, f"{_SC} SELECT scenario_id, {sql_r4('score','score')}, CASE WHEN score > (SELECT quantile_cont(score, 0.8) FROM scene) THEN 'test' WHEN {_hb('scenario_id')} < 80 THEN 'train' ELSE 'val' END AS split FROM scene"),
    "agent_score_variants": (agent_score_variants, f"{_VARIANT} SELECT scenario_id, agent_id, " + ", ".join(sql_r4(v, v) for v in sc.VARIANTS) + " FROM av"),
    "scene_score_variants": (scene_score_variants, f"{_SV} SELECT scenario_id, variant, {sql_r4('score','score')} FROM sv"),
    "score_variants": (score_variants, f"{_SV} SELECT g.scenario_id, {sql_r4('g.score + sqrt(f.score)','plus')}, {sql_r4('g.score + sqrt(greatest(g.score, f.score))','plus_cond')} FROM sv g JOIN sv f USING (scenario_id) WHERE g.variant='gt' AND f.variant='fe'"),
    "asym_pair_rekey": (asym_pair_rekey, f"{_VARIANT} SELECT scenario_id, i, j, " + ", ".join(sql_r4(e, n) for n, e in (("gt", "gt"), ("side0", "side0"), ("side1", "side1"), ("asym0", "greatest(gt, side0)"), ("asym1", "greatest(gt, side1)"))) + " FROM pv"),
    "asym_ratio": (asym_ratio, f"{_VARIANT} SELECT scenario_id, agent_id, {sql_r4('asym_combined/nullif(gt, 0)','ratio')} FROM av"),
    "cluster_split": (cluster_split, f"WITH {SQL_TRACKS}, s AS (SELECT DISTINCT scenario_id, scenario_id%5 AS cluster FROM tracks) SELECT *, CASE WHEN cluster IN (0,3) THEN 'test' WHEN {_hb('scenario_id')} < 80 THEN 'train' ELSE 'val' END AS split FROM s"),
    "uniform_split": (uniform_split, f"SELECT o_orderkey AS scenario_id, CASE WHEN {_hb('o_orderkey','1000')} < 850 THEN 'train' WHEN {_hb('o_orderkey','1000')} < 925 THEN 'val' ELSE 'test' END AS split FROM orders"),
    "stride_sample": (stride_sample, f"{_NUM} SELECT id, rn FROM n WHERE rn % 7 = 0"),
    "shard_slice": (shard_slice, f"{_NUM} SELECT id, rn FROM n WHERE floor(rn/CAST(ceil(total/10) AS BIGINT)) = 2"),
    "bootstrap_sample": (bootstrap_sample, f"{_NUM}, d AS (SELECT {_hb('rn','1073741824')} % total AS rn FROM n) SELECT id, count(*) AS times FROM d JOIN n USING (rn) GROUP BY 1"),
    "endpoint_motion": (endpoint_motion, f"WITH {SQL_TRACKS} SELECT a.scenario_id, a.agent_id, {sql_r4('b.x-a.x','dx')}, {sql_r4('b.y-a.y','dy')} FROM tracks a JOIN tracks b ON a.scenario_id=b.scenario_id AND a.agent_id=b.agent_id AND a.t=10 AND b.t=60 AND a.valid AND b.valid"),
    "type_counts": (type_counts, """WITH a AS (SELECT DISTINCT user_id FROM events) SELECT n AS object_type, count(user_id) AS n FROM (VALUES ('TYPE_UNSET'),('TYPE_VEHICLE'),('TYPE_PEDESTRIAN'),('TYPE_CYCLIST'),('TYPE_OTHER')) v(n)
        LEFT JOIN a ON n = CASE WHEN user_id%10<=5 THEN 'TYPE_VEHICLE' WHEN user_id%10<=7 THEN 'TYPE_PEDESTRIAN' ELSE 'TYPE_CYCLIST' END GROUP BY 1"""),
    "score_distribution": (score_distribution, f"{_ALL} SELECT count(*) AS n, {sql_r4('avg(total)','mean')}, " + ", ".join(sql_r4(f"quantile_cont(total, {x})", f"p{i}") for i, x in enumerate((0.005, 0.5, 0.8, 0.995))) + " FROM ascore"),
}
