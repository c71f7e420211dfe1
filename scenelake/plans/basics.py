"""Registered queries: scans, sinks, selections, sets and small window operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scenelake.functions.geometry import round_
from scenelake.operators import basics as bs
from scenelake.operators import kinematics as k
from scenelake.operators import pairs as p
from scenelake.operators import primitives as pm
from scenelake.operators.scoring import hash_bucket
from scenelake.plans.helpers import r4, sql_norm, sql_r4
from scenelake.plans.kinematics import SQL_MOVING
from scenelake.plans.scoring import _NUM, _hb, _numbered
from scenelake.sources import world
from scenelake.sources.shared import handed_on
from scenelake.sources.world import SQL_MODES, SQL_POINTS, SQL_TRACKS, SQL_TRUTHS

A = k.AGENT
#: The configuration whose hash names the label cache.
CONFIG = {"k": 6, "metric": "min_fde", "models": 5}


def scenario_lookup(spark: SparkSession, d: str) -> DataFrame:
    """One scenario by id: the filter on its agents' ids reaches the Parquet scan."""
    return world.tracks(spark, d).where(F.col("agent_id").between(30, 39) & (F.col("scenario_id") == 3)).select(*A, "t", "x", "y", "valid")


def _features(spark: SparkSession, d: str) -> DataFrame:
    """A small feature table with its split and shard."""
    f = world.tracks(spark, d).groupBy(*A).agg(F.count_if("valid").alias("n_valid"), r4("max_x", F.max("x")))
    shard = F.pmod(F.col("scenario_id"), F.lit(4)).cast("int")
    split = F.when(hash_bucket(F.col("scenario_id")) < 80, "train").otherwise("val")
    return f.withColumns({"shard": shard, "split": split})


def feature_shards(spark: SparkSession, d: str) -> DataFrame:
    """Features written by shard, read back and put together."""
    return handed_on(_features(spark, d), "features", "shard").select(*A, "n_valid", "max_x", "shard")


def load_slice(spark: SparkSession, d: str) -> DataFrame:
    """Shard 1 of the train split: partitions are pruned, and tables are joined by key, not by place."""
    kept = handed_on(_features(spark, d), "slices", "split", "shard").where("split = 'train' and shard = 1")
    meta = world.with_type(world.tracks(spark, d)).select(*A, "object_type").distinct()
    return kept.join(meta, A).select(*A, "object_type", "n_valid", "max_x")


def _runs(spark: SparkSession, d: str) -> DataFrame:
    m = k.with_motion(world.tracks(spark, d)).where("valid")
    state = F.least(F.floor((F.col("heading") + 3.141592653589793) / 1.5707963267948966), F.lit(3))
    return pm.state_runs(m.select(*A, "t", state.alias("state")), "state")


def tracks_with_primitives(spark: SparkSession, d: str) -> DataFrame:
    """Each step with the primitive that it lies in."""
    t = world.tracks(spark, d).where("valid").select(*A, "t", "x")
    return t.join(_runs(spark, d), A).where((F.col("t") >= F.col("start")) & (F.col("t") < F.col("end"))).select(*A, "t", "state", "start", r4("x"))


def primitives_with_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Three tables by key: agents, their primitives, and the cluster of each state."""
    clusters = spark.range(4).select(F.col("id").alias("state"), (F.col("id") % 2).alias("cluster"))
    types = world.with_type(world.tracks(spark, d)).select(*A, "object_type").distinct()
    joined = _runs(spark, d).join(types, A).join(F.broadcast(clusters), "state")  # four rows
    return joined.groupBy("object_type", "cluster").agg(F.count("*").alias("n"), F.sum(F.col("end") - F.col("start")).cast("long").alias("steps"))


def prediction_rows(spark: SparkSession, d: str) -> DataFrame:
    """Predictions written and read again, grouped by scene."""
    m = world.modes(spark, d).withColumn("scene", F.floor(F.col("object_id") / 32))
    kept = handed_on(m, "predictions")
    return kept.groupBy("scene").agg(F.countDistinct("object_id").alias("n_objects"), F.count("*").alias("n_modes"), r4("best", F.max("score")))


def label_cache(spark: SparkSession, d: str) -> DataFrame:
    """Best-member labels under the name of their configuration, joined to objects by key."""
    m = world.modes(spark, d).join(world.truths(spark, d), "object_id")
    e = round_(F.sqrt((F.col("x") - F.col("tx")) ** 2 + (F.col("y") - F.col("ty")) ** 2), 6)
    best = m.groupBy("object_id").agg(F.min(F.struct(e.alias("e"), "model_id")).alias("b"))
    labels = handed_on(best.select("object_id", F.col("b.model_id").alias("label"), bs.config_hash(CONFIG).alias("config")), "labels")
    return world.truths(spark, d).join(labels, "object_id").select("object_id", "object_type", "label", "config")


def shuffled_batches(spark: SparkSession, d: str) -> DataFrame:
    """Batches of 16 per rank of 4 after a shuffle by hash, the last short batch of a rank dropped.

    Places come from counts by blocks of the hash, so no task orders the whole table.
    """
    key = hash_bucket(F.col("id"), 1 << 30)
    own = _numbered(spark, d).select("id", F.pmod("rn", F.lit(4)).cast("int").alias("rank"), key.alias("key"))
    own = own.withColumn("block", F.floor(F.col("key") / (1 << 22)))
    n = own.groupBy("rank", "block").agg(F.count("*").alias("n"))
    before = Window.partitionBy("rank").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = n.select("rank", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    total = n.groupBy("rank").agg(F.sum("n").alias("total"))
    place = F.col("base") + F.row_number().over(Window.partitionBy("rank", "block").orderBy("key", "id")) - 1
    placed = own.join(base, ["rank", "block"]).join(F.broadcast(total), "rank").withColumn("place", place)  # four rows
    return placed.where(F.col("place") < F.floor(F.col("total") / 16) * 16).select("id", "rank", F.floor(F.col("place") / 16).alias("batch"))


def rank_interleave(spark: SparkSession, d: str) -> DataFrame:
    """Results of three ranks in the order of the samples that they stem from, cut to the table's size."""
    n = _numbered(spark, d)
    parts = n.select("id", F.pmod("rn", F.lit(3)).alias("rank"), F.floor(F.col("rn") / 3).alias("idx"))
    return bs.interleaved(parts, 3, 1000).select("place", "id")


def column_mask(spark: SparkSession, d: str) -> DataFrame:
    """Columns by a mask: a projection, so the scan reads no others."""
    mask = {"scenario_id": True, "agent_id": True, "t": True, "x": True, "y": False, "valid": True}
    return world.tracks(spark, d).select(*(c for c, kept in mask.items() if kept))


def index_remap(spark: SparkSession, d: str) -> DataFrame:
    """Old and new place of each agent of a scene that is valid now."""
    now = world.tracks(spark, d).where(F.col("t") == world.NOW)
    return bs.remap(now, F.col("valid"), ["scenario_id"], "agent_id").select(*A, "old", "new")


def whitelist(spark: SparkSession, d: str) -> DataFrame:
    """Agents of the scenes on a list."""
    listed = world.table(spark, d, "nation").select(F.col("n_nationkey").alias("scenario_id")).where("scenario_id % 2 = 0")
    return p.agents(world.tracks(spark, d)).join(listed, "scenario_id", "left_semi")


def others_only(spark: SparkSession, d: str) -> DataFrame:
    """Neighbours of each target within its scene, itself left out."""
    a = p.agents(world.tracks(spark, d))
    ego = a.where(F.col("agent_id") % 10 <= 2).select("scenario_id", F.col("agent_id").alias("ego"))
    return ego.join(a, "scenario_id").where("agent_id <> ego").groupBy("scenario_id", "ego").agg(F.count("*").alias("n_others"))


def long_primitives(spark: SparkSession, d: str) -> DataFrame:
    """Primitives of five steps or more."""
    return _runs(spark, d).where(F.col("end") - F.col("start") >= 5).select(*A, "start", "end", "state")


def capped_rows(spark: SparkSession, d: str) -> DataFrame:
    """The first 25 scenarios in order of id."""
    return p.agents(world.tracks(spark, d)).select("scenario_id").distinct().orderBy("scenario_id").limit(25)


def previous_point(spark: SparkSession, d: str) -> DataFrame:
    return bs.previous_point(world.lane_points(spark, d), ["lane_id"], "pt").select("lane_id", "pt", r4("pre_x"), r4("pre_y"))


def displacement(spark: SparkSession, d: str) -> DataFrame:
    return bs.displacement(world.tracks(spark, d), A, "t").select(*A, "t", r4("dx"), r4("dy"))


def history_path_normalised(spark: SparkSession, d: str) -> DataFrame:
    return bs.normalised_history(world.tracks(spark, d), world.NOW).select(*A, "t", r4("nx"), r4("ny"), r4("length"))


def downsample_2hz(spark: SparkSession, d: str) -> DataFrame:
    return bs.downsample(world.tracks(spark, d), horizon=16).select(*A, "sample", r4("x"), r4("y"))


def upsample_to_10hz(spark: SparkSession, d: str) -> DataFrame:
    low = bs.downsample(world.tracks(spark, d), horizon=16)
    return bs.upsample(low, A, "sample", 5).select(*A, "step", r4("x"), r4("y"))


def split_on_id_change(spark: SparkSession, d: str) -> DataFrame:
    """Parts of each user's events, cut where the type changes."""
    e = world.table(spark, d, "events").withColumn("at", F.struct("ts", "event_id"))
    return bs.split_on_change(e, ["user_id"], "at", "event_type").groupBy("user_id", "part").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


def even_index_segments(spark: SparkSession, d: str) -> DataFrame:
    s = bs.distilled_segments(world.lane_points(spark, d), ["lane_id"], "pt")
    return s.select("lane_id", "pt", r4("x"), r4("y"), r4("x2"), r4("y2"))


def adjacent_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Models of an object's modes in order, -1 where the one before is the same."""
    return bs.changes_only(world.modes(spark, d), ["object_id"], "mode", "model_id").select("object_id", "mode", F.col("marked").cast("long").alias("marked"))


def single_agent_sequences(spark: SparkSession, d: str) -> DataFrame:
    return bs.valid_sequences(k.with_motion(world.tracks(spark, d))).select(*A, "place", r4("x"), r4("y"), r4("speed"))


def natural_sort(spark: SparkSession, d: str) -> DataFrame:
    """File names of a shard in the order in which people number them."""
    name = F.concat(F.lit("part"), F.col("c_custkey").cast("string"), F.lit("_v"), (F.col("c_custkey") % 12).cast("string"))
    f = world.table(spark, d, "customer").select((F.col("c_custkey") % 16).alias("shard"), name.alias("name"))
    w = Window.partitionBy("shard").orderBy(bs.natural_key(F.col("name")))
    return f.withColumn("place", F.row_number().over(w)).select("shard", "name", "place")


def newest_kept(spark: SparkSession, d: str) -> DataFrame:
    """The three newest orders of each customer: what a bounded retention keeps."""
    o = world.table(spark, d, "orders")
    return bs.newest(o, ["o_custkey"], "o_orderdate", "o_orderkey", 3).select("o_custkey", "o_orderkey", "age")


def common_agents(spark: SparkSession, d: str) -> DataFrame:
    """Agents that are valid both now and at step 60."""
    t = world.tracks(spark, d).where("valid")
    return t.where(F.col("t") == world.NOW).select(*A).intersect(t.where("t = 60").select(*A))


def common_steps(spark: SparkSession, d: str) -> DataFrame:
    """Steps that a pair has in common, as sets."""
    v = world.tracks(spark, d).where("valid").groupBy(*A).agg(F.collect_set("t").alias("ts"))  # 91 at most
    a, b = (v.select("scenario_id", F.col("agent_id").alias(n), F.col("ts").alias(f"t{n}")) for n in "ij")
    both = a.join(b, "scenario_id").where("i < j").withColumn("n", F.size(F.array_intersect("ti", "tj")).cast("long"))
    return both.where("n > 0").select(*p.PAIR, "n")


def scenario_union(spark: SparkSession, d: str) -> DataFrame:
    """Scenarios of either of two lists, once each."""
    s = p.agents(world.tracks(spark, d)).select("scenario_id").distinct()
    return s.where("scenario_id % 3 = 0").union(s.where("scenario_id % 5 = 0")).distinct()


def distinct_paths(spark: SparkSession, d: str) -> DataFrame:
    """Different sequences of states, with how many agents take them."""
    seq = F.transform(F.sort_array(F.collect_list(F.struct("start", "state"))), lambda r: r["state"])  # 91 at most
    return _runs(spark, d).groupBy(*A).agg(F.array_join(seq, ">").alias("path")).groupBy("path").agg(F.count("*").alias("n"))


def first_occurrence(spark: SparkSession, d: str) -> DataFrame:
    """The first event of each user and type."""
    return bs.first_by(world.table(spark, d, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id")


def class_suffix(spark: SparkSession, d: str) -> DataFrame:
    """The last part of each object type's name."""
    t = world.truths(spark, d)
    return t.groupBy(F.element_at(F.split("object_type", "_"), -1).alias("class")).agg(F.count("*").alias("n"))


def path_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Numbers in file paths."""
    path = F.concat(F.lit("run_"), "c_custkey", F.lit("/epoch-"), F.col("c_nationkey"), F.lit(".ckpt"))
    found = F.regexp_extract_all(path, F.lit("([0-9]+)"), 1)
    return world.table(spark, d, "customer").select("c_custkey", found[0].cast("long").alias("run"), found[1].cast("long").alias("epoch"))


def segments_json(spark: SparkSession, d: str) -> DataFrame:
    """The first three points of each lane as JSON with one decimal."""
    c = lambda n: F.format_string("%.1f", F.round(n, 1) + 0.0)
    point = F.concat(F.lit("["), c("x"), F.lit(","), c("y"), F.lit("]"))
    rows = F.sort_array(F.collect_list(F.struct("pt", point.alias("p"))))
    own = world.lane_points(spark, d).where("pt < 3").groupBy("lane_id").agg(F.transform(rows, lambda r: r["p"]).alias("ps"))
    return own.select("lane_id", F.concat(F.lit("["), F.array_join("ps", ","), F.lit("]")).alias("json"))


def config_hash(spark: SparkSession, d: str) -> DataFrame:
    return spark.range(1).select(bs.config_hash(CONFIG).alias("config"))


def padded_modes(spark: SparkSession, d: str) -> DataFrame:
    """Scores of each object's modes, padded to eight, with the mask."""
    m = bs.padded(world.modes(spark, d), ["object_id"], "mode", "score", 8)
    return m.select("object_id", F.size("values").cast("long").alias("n"), F.size(F.filter("mask", lambda x: x)).cast("long").alias("n_real"), r4("total", F.aggregate("values", F.lit(0.0), lambda a, b: a + b)), F.get("values", F.lit(7)).alias("last"))


def collated_scenes(spark: SparkSession, d: str) -> DataFrame:
    """Scenes in batches of eight: each batch's scenes and agents, and the offset of each scene's agents."""
    n = p.agents(world.tracks(spark, d)).groupBy("scenario_id").agg(F.count("*").alias("n")).withColumn("batch", F.floor(F.col("scenario_id") / 8))
    before = Window.partitionBy("batch").orderBy("scenario_id").rowsBetween(Window.unboundedPreceding, -1)
    return n.select("batch", "scenario_id", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))


_S = f"WITH {SQL_TRACKS}"
_FEAT = f"""f AS (SELECT scenario_id, agent_id, count(*) FILTER (valid) AS n_valid, {sql_r4('max(x)', 'max_x')}, CAST(scenario_id % 4 AS INT) AS shard,
    CASE WHEN {_hb('scenario_id')} < 80 THEN 'train' ELSE 'val' END AS split FROM tracks GROUP BY 1, 2)"""
_TYPE = "CASE WHEN agent_id%10<=5 THEN 'TYPE_VEHICLE' WHEN agent_id%10<=7 THEN 'TYPE_PEDESTRIAN' ELSE 'TYPE_CYCLIST' END"
_RUNS = f"""{SQL_MOVING}, _st AS (SELECT scenario_id, agent_id, t, least(CAST(floor((heading + 3.141592653589793::double)/1.5707963267948966::double) AS BIGINT), 3) AS state FROM moving WHERE valid),
  _g AS (SELECT *, row_number() OVER (PARTITION BY scenario_id, agent_id ORDER BY t) - row_number() OVER (PARTITION BY scenario_id, agent_id, state ORDER BY t) AS g FROM _st),
  runs AS (SELECT scenario_id, agent_id, state, min(t) AS start, max(t) + 1 AS "end" FROM _g GROUP BY scenario_id, agent_id, state, g)"""
_LOW = "low AS (SELECT scenario_id, agent_id, CAST((t-4)/5 AS INT) AS sample, x, y FROM tracks WHERE t >= 4 AND (t-4) % 5 = 0 AND (t-4)/5 < 16)"

QUERIES = {
    "scenario_lookup": (scenario_lookup, f"{_S} SELECT * FROM tracks WHERE scenario_id = 3"),
    "feature_shards": (feature_shards, f"{_S}, {_FEAT} SELECT * EXCLUDE (split) FROM f"),
    "load_slice": (load_slice, f"{_S}, {_FEAT} SELECT scenario_id, agent_id, {_TYPE} AS object_type, n_valid, max_x FROM f WHERE split = 'train' AND shard = 1"),
    "tracks_with_primitives": (tracks_with_primitives, f'{_S}, {_RUNS} SELECT t.scenario_id, t.agent_id, t.t, state, start, {sql_r4("x", "x")} FROM tracks t JOIN runs r ON r.scenario_id=t.scenario_id AND r.agent_id=t.agent_id AND t.t >= start AND t.t < "end" WHERE valid'),
    "primitives_with_clusters": (primitives_with_clusters, f'{_S}, {_RUNS} SELECT {_TYPE} AS object_type, state % 2 AS cluster, count(*) AS n, CAST(sum("end" - start) AS BIGINT) AS steps FROM runs GROUP BY 1, 2'),
    "prediction_rows": (prediction_rows, f"WITH {SQL_MODES} SELECT object_id // 32 AS scene, count(DISTINCT object_id) AS n_objects, count(*) AS n_modes, {sql_r4('max(score)', 'best')} FROM modes GROUP BY 1"),
    "label_cache": (label_cache, f"""WITH {SQL_MODES},{SQL_TRUTHS}, e AS (SELECT object_id, object_type, model_id, round({sql_norm('x-tx', 'y-ty')}, 6) AS e FROM modes JOIN truths USING (object_id))
        SELECT object_id, object_type, model_id AS label, sha256('{{"k": 6, "metric": "min_fde", "models": 5}}') AS config FROM e QUALIFY row_number() OVER (PARTITION BY object_id ORDER BY e, model_id) = 1"""),
    "shuffled_batches": (shuffled_batches, f"""{_NUM}, s AS (SELECT id, CAST(rn % 4 AS INT) AS rank, {_hb('id', '1073741824')} AS key FROM n), r AS (SELECT *, row_number() OVER (PARTITION BY rank ORDER BY key, id) - 1 AS place, count(*) OVER (PARTITION BY rank) AS total FROM s)
        SELECT id, rank, place // 16 AS batch FROM r WHERE place < total // 16 * 16"""),
    "rank_interleave": (rank_interleave, f"{_NUM} SELECT rn AS place, id FROM n WHERE rn < 1000"),
    "column_mask": (column_mask, f"{_S} SELECT * EXCLUDE (y) FROM tracks"),
    "index_remap": (index_remap, f"{_S}, q AS (SELECT *, CAST(row_number() OVER w - 1 AS INT) AS old, CAST(sum(valid::int) OVER (w ROWS UNBOUNDED PRECEDING) - 1 AS INT) AS new FROM tracks WHERE t = 10 WINDOW w AS (PARTITION BY scenario_id ORDER BY agent_id)) SELECT scenario_id, agent_id, old, new FROM q WHERE valid"),
    "whitelist": (whitelist, f"{_S} SELECT DISTINCT scenario_id, agent_id FROM tracks WHERE scenario_id IN (SELECT n_nationkey FROM nation WHERE n_nationkey % 2 = 0)"),
    "others_only": (others_only, f"{_S}, a AS (SELECT DISTINCT scenario_id, agent_id FROM tracks) SELECT e.scenario_id, e.agent_id AS ego, count(*) AS n_others FROM a e JOIN a o ON e.scenario_id = o.scenario_id AND e.agent_id <> o.agent_id WHERE e.agent_id % 10 <= 2 GROUP BY 1, 2"),
    "long_primitives": (long_primitives, f'{_S}, {_RUNS} SELECT scenario_id, agent_id, start, "end", state FROM runs WHERE "end" - start >= 5'),
    "capped_rows": (capped_rows, f"{_S} SELECT DISTINCT scenario_id FROM tracks ORDER BY 1 LIMIT 25"),
    "previous_point": (previous_point, f"WITH {SQL_POINTS} SELECT lane_id, pt, {sql_r4('coalesce(lag(x) OVER w, x)', 'pre_x')}, {sql_r4('coalesce(lag(y) OVER w, y)', 'pre_y')} FROM points WINDOW w AS (PARTITION BY lane_id ORDER BY pt)"),
    "displacement": (displacement, f"{_S} SELECT scenario_id, agent_id, t, {sql_r4('coalesce(x - lag(x) OVER w, 0)', 'dx')}, {sql_r4('coalesce(y - lag(y) OVER w, 0)', 'dy')} FROM tracks WINDOW w AS (PARTITION BY scenario_id, agent_id ORDER BY t)"),
    "history_path_normalised": (history_path_normalised, f"""{_S}, h AS (SELECT *, coalesce({sql_norm('x - lag(x) OVER w', 'y - lag(y) OVER w')}, 0) AS step, first(x) OVER w AS x0, first(y) OVER w AS y0 FROM tracks WHERE valid AND t <= 10 WINDOW w AS (PARTITION BY scenario_id, agent_id ORDER BY t)),
        l AS (SELECT *, sum(step) OVER (PARTITION BY scenario_id, agent_id) AS length FROM h) SELECT scenario_id, agent_id, t, {sql_r4('(x-x0)/length', 'nx')}, {sql_r4('(y-y0)/length', 'ny')}, {sql_r4('length', 'length')} FROM l WHERE length >= 0.01::double"""),
    "downsample_2hz": (downsample_2hz, f"{_S}, {_LOW} SELECT scenario_id, agent_id, sample, {sql_r4('x', 'x')}, {sql_r4('y', 'y')} FROM low"),
    "upsample_to_10hz": (upsample_to_10hz, f"""{_S}, {_LOW}, p AS (SELECT *, coalesce(lag(x) OVER w, 0) AS px, coalesce(lag(y) OVER w, 0) AS py, CAST(unnest(range(1, 6)) AS INT) AS k FROM low WINDOW w AS (PARTITION BY scenario_id, agent_id ORDER BY sample))
        SELECT scenario_id, agent_id, sample*5 + k - 1 AS step, {sql_r4('px + (x-px)*(k/5.0::double)', 'x')}, {sql_r4('py + (y-py)*(k/5.0::double)', 'y')} FROM p"""),
    "split_on_id_change": (split_on_id_change, """WITH c AS (SELECT *, coalesce((event_type <> lag(event_type) OVER w)::int, 0) AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
        q AS (SELECT *, CAST(sum(c) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT) AS part FROM c) SELECT user_id, part, count(*) AS n, min(event_id) AS first_id FROM q GROUP BY 1, 2"""),
    "even_index_segments": (even_index_segments, f"WITH {SQL_POINTS}, e AS (SELECT *, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM points WHERE pt % 2 = 0 WINDOW w AS (PARTITION BY lane_id ORDER BY pt)) SELECT lane_id, pt, " + ", ".join(sql_r4(c, c) for c in ("x", "y", "x2", "y2")) + " FROM e WHERE x2 IS NOT NULL"),
    "adjacent_dedup": (adjacent_dedup, f"WITH {SQL_MODES} SELECT object_id, mode, CAST(CASE WHEN coalesce(model_id = lag(model_id) OVER (PARTITION BY object_id ORDER BY mode), false) THEN -1 ELSE model_id END AS BIGINT) AS marked FROM modes"),
    "single_agent_sequences": (single_agent_sequences, f"""{_S},{SQL_MOVING}, s AS (SELECT *, min(CASE WHEN valid THEN t END) OVER w AS a, max(CASE WHEN valid THEN t END) OVER w AS b FROM moving WINDOW w AS (PARTITION BY scenario_id, agent_id))
        SELECT scenario_id, agent_id, t - a AS place, {sql_r4('x', 'x')}, {sql_r4('y', 'y')}, {sql_r4('speed', 'speed')} FROM s WHERE t BETWEEN a AND b"""),
    "natural_sort": (natural_sort, "SELECT c_custkey % 16 AS shard, 'part' || c_custkey || '_v' || c_custkey % 12 AS name, CAST(row_number() OVER (PARTITION BY c_custkey % 16 ORDER BY c_custkey) AS INT) AS place FROM customer"),
    "newest_kept": (newest_kept, "SELECT o_custkey, o_orderkey, CAST(row_number() OVER w AS INT) AS age FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) QUALIFY row_number() OVER w <= 3"),
    "common_agents": (common_agents, f"{_S} SELECT scenario_id, agent_id FROM tracks WHERE valid AND t = 10 INTERSECT SELECT scenario_id, agent_id FROM tracks WHERE valid AND t = 60"),
    "common_steps": (common_steps, f"{_S} SELECT a.scenario_id, a.agent_id AS i, b.agent_id AS j, count(*) AS n FROM tracks a JOIN tracks b ON a.scenario_id=b.scenario_id AND a.t=b.t AND a.agent_id<b.agent_id AND a.valid AND b.valid GROUP BY 1, 2, 3"),
    "scenario_union": (scenario_union, f"{_S} SELECT scenario_id FROM tracks WHERE scenario_id % 3 = 0 UNION SELECT scenario_id FROM tracks WHERE scenario_id % 5 = 0"),
    "distinct_paths": (distinct_paths, f"{_S}, {_RUNS}, p AS (SELECT string_agg(state::varchar, '>' ORDER BY start) AS path FROM runs GROUP BY scenario_id, agent_id) SELECT path, count(*) AS n FROM p GROUP BY 1"),
    "first_occurrence": (first_occurrence, "SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1"),
    "class_suffix": (class_suffix, f"WITH {SQL_TRUTHS} SELECT split_part(object_type, '_', -1) AS class, count(*) AS n FROM truths GROUP BY 1"),
    "path_numbers": (path_numbers, "SELECT c_custkey, c_custkey AS run, CAST(c_nationkey AS BIGINT) AS epoch FROM customer"),
    "segments_json": (segments_json, f"WITH {SQL_POINTS} SELECT lane_id, '[' || string_agg(format('[{{:.1f}},{{:.1f}}]', round(x, 1) + 0.0::double, round(y, 1) + 0.0::double), ',' ORDER BY pt) || ']' AS json FROM points WHERE pt < 3 GROUP BY 1"),
    "config_hash": (config_hash, """SELECT sha256('{"k": 6, "metric": "min_fde", "models": 5}') AS config"""),
    "padded_modes": (padded_modes, f"WITH {SQL_MODES} SELECT object_id, greatest(count(*), 8) AS n, count(*) AS n_real, {sql_r4('sum(score)', 'total')}, coalesce(max(score) FILTER (mode = 7), 0) AS last FROM modes GROUP BY 1"),
    "collated_scenes": (collated_scenes, f"{_S}, n AS (SELECT scenario_id, count(DISTINCT agent_id) AS n FROM tracks GROUP BY 1) SELECT scenario_id // 8 AS batch, scenario_id, n, CAST(coalesce(sum(n) OVER (PARTITION BY scenario_id // 8 ORDER BY scenario_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS offset FROM n"),
}
