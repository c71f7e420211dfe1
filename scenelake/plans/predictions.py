"""Registered queries over predicted modes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scenelake.functions.geometry import dist, gaussian_nll, round_, sine_embedding
from scenelake.operators import predictions as pr
from scenelake.plans.helpers import r4, rounded, sql_norm, sql_r4
from scenelake.sources import world
from scenelake.sources.world import SQL_MODES, SQL_TRUTHS


def _errors(spark: SparkSession, d: str) -> DataFrame:
    return pr.errors(world.modes(spark, d), world.truths(spark, d))


def mode_topk_normalised(spark: SparkSession, d: str) -> DataFrame:
    return pr.top_modes(world.modes(spark, d), 6).select("object_id", "mode", "rank", (round_("score", 6)).alias("score"))


def joint_ensemble(spark: SparkSession, d: str) -> DataFrame:
    """Modes of all models pooled, each model's scores normalised before, ranked anew."""
    m = world.modes(spark, d)
    pooled = m.withColumn("share", F.col("score") / F.sum("score").over(Window.partitionBy("object_id", "model_id")))
    w = Window.partitionBy("object_id").orderBy(F.desc(round_("share", 6)), "mode")
    return pooled.withColumn("rank", F.row_number().over(w)).select("object_id", "mode", "model_id", "rank", round_("share", 6).alias("share"))


def confident_model(spark: SparkSession, d: str) -> DataFrame:
    """The model with the most confident mode of each object."""
    m = world.modes(spark, d).withColumn("c", -F.col("score"))
    return pr.best_by(m, "c", "model_id").select("object_id", "model_id", (-F.col("c")).alias("score"))


def softmax_modes(spark: SparkSession, d: str) -> DataFrame:
    return pr.softmax(world.modes(spark, d), 10000.0).select("object_id", "mode", round_("p", 6).alias("p"))


def nms_endpoints(spark: SparkSession, d: str) -> DataFrame:
    return pr.nms(world.modes(spark, d), 2.5, 6)


def best_member_label(spark: SparkSession, d: str) -> DataFrame:
    """The model whose best mode is nearest to the truth, and by how much it beats the next model."""
    e = _errors(spark, d).groupBy("object_id", "model_id").agg(round_(F.min("fde"), 6).alias("fde"))
    w = Window.partitionBy("object_id").orderBy("fde", "model_id")
    r = e.withColumns({"rank": F.row_number().over(w), "next": F.lead("fde").over(w)}).where("rank = 1")
    return r.select("object_id", "model_id", r4("fde"), r4("lead", F.col("next") - F.col("fde")))


def collision_rate(spark: SparkSession, d: str) -> DataFrame:
    """Modes of different objects of a block of 32 whose endpoints come within 0.25, 0.5 and 1, by type."""
    m = world.modes(spark, d).join(world.truths(spark, d).select("object_id", "object_type"), "object_id")
    m = m.withColumn("block", F.floor(F.col("object_id") / 32))
    t = world.truths(spark, d).select(F.col("object_id").alias("other"), "tx", "ty", F.floor(F.col("object_id") / 32).alias("block"))
    hit = m.join(t, "block").where("object_id <> other").withColumn("d", dist(F.col("x"), F.col("y"), F.col("tx"), F.col("ty")))
    per = hit.groupBy("object_type", "object_id", "mode").agg(*(F.count_if(F.col("d") < c).alias(f"c{int(c * 100)}") for c in (0.25, 0.5, 1.0)))
    n = m.groupBy("object_type").agg(F.count("*").alias("n_modes"))
    s = per.groupBy("object_type").agg(*(F.sum(f"c{c}").alias(f"c{c}") for c in (25, 50, 100)))
    return n.join(s, "object_type").select("object_type", "n_modes", *(r4(f"rate{c}", F.col(f"c{c}") / F.col("n_modes")) for c in (25, 50, 100)))


def metric_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Vehicle, NonVehicle (mean of two) and All (mean of three) least errors."""
    e = _errors(spark, d).groupBy("object_id", "object_type").agg(F.min("fde").alias("m")).groupBy("object_type").agg(F.avg("m").alias("m"))
    groups = F.explode(F.when(F.col("object_type") == "TYPE_VEHICLE", F.array(F.lit("Vehicle"), F.lit("All"))).otherwise(F.array(F.lit("NonVehicle"), F.lit("All")))).alias("group")
    return e.select("m", groups).groupBy("group").agg(r4("min_fde", F.avg("m")))


def val_test_delta(spark: SparkSession, d: str) -> DataFrame:
    """Relative change of the least error from val to test objects, by type."""
    s = F.when(F.col("object_id") % 10 < 3, "val").otherwise("test")
    e = _errors(spark, d).groupBy("object_id", "object_type").agg(F.min("fde").alias("m")).withColumn("split", s)
    p = e.groupBy("object_type").pivot("split", ["val", "test"]).agg(F.avg("m"))
    return p.select("object_type", r4("val"), r4("test"), r4("change", (F.col("test") - F.col("val")) / F.col("val")))


def soft_collision_cost(spark: SparkSession, d: str) -> DataFrame:
    """The mode of each object with the least 100 * sum of exp(-d) to other truths of its block plus its error."""
    m = _errors(spark, d).withColumn("block", F.floor(F.col("object_id") / 32))
    t = world.truths(spark, d).select(F.col("object_id").alias("other"), F.col("tx").alias("ox"), F.col("ty").alias("oy"), F.floor(F.col("object_id") / 32).alias("block"))
    c = m.join(t, "block").where("object_id <> other").groupBy("object_id", "mode", "fde").agg(F.sum(F.exp(-dist(F.col("x"), F.col("y"), F.col("ox"), F.col("oy")))).alias("s"))
    c = c.withColumn("cost", round_(100 * F.col("s") + F.col("fde"), 6))
    return pr.best_by(c, "cost", "mode")


def model_correlation(spark: SparkSession, d: str) -> DataFrame:
    """Pearson correlation of two models' least errors over the objects that both predict."""
    e = _errors(spark, d).groupBy("object_id", "model_id").agg(F.min("fde").alias("e"))
    b = e.select("object_id", F.col("model_id").alias("model_b"), F.col("e").alias("eb"))
    return e.join(b, "object_id").where("model_id < model_b").groupBy("model_id", "model_b").agg(r4("r", F.corr("e", "eb")), F.count("*").alias("n"))


def confidence_error_corr(spark: SparkSession, d: str) -> DataFrame:
    return _errors(spark, d).agg(r4("r", F.corr("score", "fde")), F.count("*").alias("n"))


def model_cluster_choice(spark: SparkSession, d: str) -> DataFrame:
    """Mean error of each model in each cluster of objects, and the best model of the cluster."""
    e = _errors(spark, d).withColumn("cluster", F.col("object_id") % 7)
    a = e.groupBy("cluster", "model_id").agg(round_(F.avg("fde"), 6).alias("m"))
    return a.groupBy("cluster").agg(F.min(F.struct("m", "model_id")).alias("b")).select("cluster", F.col("b.model_id").alias("model_id"), r4("mean_fde", F.col("b.m")))


def sine_embedding_q(spark: SparkSession, d: str) -> DataFrame:
    e = sine_embedding(F.col("tx") / 51, 8)
    return world.truths(spark, d).select("object_id", *(r4(f"e{i}", e[i]) for i in range(8)))


def gmm_nll(spark: SparkSession, d: str) -> DataFrame:
    """Gaussian loss of each object's best mode."""
    e = _errors(spark, d).where("mode = 0")
    nll = gaussian_nll(F.col("tx") - F.col("x"), F.col("ty") - F.col("y"), F.log(1 + F.col("x")), F.lit(0.5), F.col("y") / 20)
    return e.select("object_id", r4("nll", nll))


def sparse_attention_demo(spark: SparkSession, d: str) -> DataFrame:
    """Attention of each object's modes over modes of the same object: softmax of products, then sums."""
    m = world.modes(spark, d).select("object_id", "mode", (F.col("x") / 50).alias("a"), (F.col("y") / 10).alias("b"))
    k = m.select("object_id", F.col("mode").alias("key"), F.col("a").alias("ka"), F.col("b").alias("kb"))
    w = m.join(k, "object_id").withColumn("e", F.exp(F.col("a") * F.col("ka") + F.col("b") * F.col("kb")))
    s = w.groupBy("object_id", "mode").agg((F.sum(F.col("e") * F.col("ka")) / F.sum("e")).alias("va"), (F.sum(F.col("e") * F.col("kb")) / F.sum("e")).alias("vb"))
    return rounded(s, "va", "vb")


_M = f"WITH {SQL_MODES}"
_E = f"WITH {SQL_MODES},{SQL_TRUTHS}, err AS (SELECT m.*, object_type, tx, ty, {sql_norm('x-tx','y-ty')} AS fde FROM modes m JOIN truths USING (object_id))"
_B = f"{_E}, best AS (SELECT object_id, object_type, min(fde) AS m FROM err GROUP BY 1,2)"
_ls = "least(greatest(ln(1+x),-1.609::double),5)"
_rho = "least(greatest(y/20,-0.5::double),0.5::double)"
_zx, _zy = f"((tx-x)/exp({_ls}))", "((ty-y)/exp(0.5::double))"

QUERIES = {
    "mode_topk_normalised": (mode_topk_normalised, f"{_M}, q AS (SELECT *, score/sum(score) OVER (PARTITION BY object_id) AS p, CAST(row_number() OVER (PARTITION BY object_id ORDER BY score DESC, mode) AS INT) AS rank FROM modes) SELECT object_id, mode, rank, round(p,6) AS score FROM q WHERE rank<=6"),
    "joint_ensemble": (joint_ensemble, f"{_M}, q AS (SELECT *, round(score/sum(score) OVER (PARTITION BY object_id, model_id),6) AS share FROM modes) SELECT object_id, mode, model_id, CAST(row_number() OVER (PARTITION BY object_id ORDER BY share DESC, mode) AS INT) AS rank, share FROM q"),
    "confident_model": (confident_model, f"{_M} SELECT object_id, model_id, score FROM modes QUALIFY row_number() OVER (PARTITION BY object_id ORDER BY score DESC, model_id)=1"),
    "softmax_modes": (softmax_modes, f"{_M}, q AS (SELECT *, exp((score - max(score) OVER (PARTITION BY object_id))/10000) AS e FROM modes) SELECT object_id, mode, round(e/sum(e) OVER (PARTITION BY object_id),6) AS p FROM q"),
    "nms_endpoints": (nms_endpoints, f"""WITH RECURSIVE {SQL_MODES}, a AS (SELECT object_id, list({{'s': -score, 'mode': mode, 'x': x, 'y': y}} ORDER BY -score, mode) AS m, list(score ORDER BY -score, mode) AS v FROM modes GROUP BY 1),
        r AS (SELECT object_id, m, v, 0 AS n, CAST(NULL AS BIGINT) AS pick FROM a UNION ALL
          SELECT object_id, m, list_transform(v, lambda z, i: CASE WHEN i = p THEN -1.0::double WHEN z > 0 AND sqrt((m[i].x-m[p].x)*(m[i].x-m[p].x) + (m[i].y-m[p].y)*(m[i].y-m[p].y)) < 2.5 THEN 0.0::double ELSE z END), n+1, p
          FROM (SELECT *, list_position(v, list_max(v)) AS p FROM r WHERE n < least(6, len(m))))
        SELECT object_id, n-1 AS rank, m[pick].mode AS mode FROM r WHERE n > 0"""),
    "best_member_label": (best_member_label, f"{_E}, e AS (SELECT object_id, model_id, round(min(fde),6) AS fde FROM err GROUP BY 1,2) SELECT object_id, model_id, {sql_r4('fde','fde')}, {sql_r4('lead(fde) OVER w - fde','lead')} FROM e WINDOW w AS (PARTITION BY object_id ORDER BY fde, model_id) QUALIFY row_number() OVER w = 1"),
    "collision_rate": (collision_rate, f"""{_E}, h AS (SELECT e.object_type, e.object_id, e.mode, {sql_norm('e.x-t.tx','e.y-t.ty')} AS d FROM err e JOIN truths t ON e.object_id//32=t.object_id//32 AND e.object_id<>t.object_id),
        n AS (SELECT object_type, count(*) AS n_modes FROM err GROUP BY 1), s AS (SELECT object_type, count(*) FILTER (d<0.25) AS a, count(*) FILTER (d<0.5) AS b, count(*) FILTER (d<1) AS c FROM h GROUP BY 1)
        SELECT object_type, n_modes, {sql_r4('a/n_modes','rate25')}, {sql_r4('b/n_modes','rate50')}, {sql_r4('c/n_modes','rate100')} FROM n JOIN s USING (object_type)"""),
    "metric_rollup": (metric_rollup, f"""{_B}, t AS (SELECT object_type, avg(m) AS m FROM best GROUP BY 1) SELECT 'All' AS "group", {sql_r4('avg(m)','min_fde')} FROM t UNION ALL SELECT CASE WHEN object_type='TYPE_VEHICLE' THEN 'Vehicle' ELSE 'NonVehicle' END, {sql_r4('avg(m)','min_fde')} FROM t GROUP BY 1"""),
    "val_test_delta": (val_test_delta, f"{_B}, p AS (SELECT object_type, avg(m) FILTER (object_id%10<3) AS val, avg(m) FILTER (object_id%10>=3) AS test FROM best GROUP BY 1) SELECT object_type, {sql_r4('val','val')}, {sql_r4('test','test')}, {sql_r4('(test-val)/val','change')} FROM p"),
    "soft_collision_cost": (soft_collision_cost, f"""{_E}, c AS (SELECT e.object_id, e.mode, round(100*sum(exp(-{sql_norm('e.x-t.tx','e.y-t.ty')})) + e.fde, 6) AS cost FROM err e JOIN truths t ON e.object_id//32=t.object_id//32 AND e.object_id<>t.object_id GROUP BY e.object_id, e.mode, e.fde)
        SELECT object_id, cost, mode FROM c QUALIFY row_number() OVER (PARTITION BY object_id ORDER BY cost, mode)=1"""),
    "model_correlation": (model_correlation, f"{_E}, e AS (SELECT object_id, model_id, min(fde) AS e FROM err GROUP BY 1,2) SELECT a.model_id, b.model_id AS model_b, {sql_r4('corr(a.e,b.e)','r')}, count(*) AS n FROM e a JOIN e b ON a.object_id=b.object_id AND a.model_id<b.model_id GROUP BY 1,2"),
    "confidence_error_corr": (confidence_error_corr, f"{_E} SELECT {sql_r4('corr(score,fde)','r')}, count(*) AS n FROM err"),
    "model_cluster_choice": (model_cluster_choice, f"{_E}, a AS (SELECT object_id%7 AS cluster, model_id, round(avg(fde),6) AS m FROM err GROUP BY 1,2) SELECT cluster, model_id, {sql_r4('m','mean_fde')} FROM a QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY m, model_id)=1"),
    "sine_embedding": (sine_embedding_q, f"WITH {SQL_TRUTHS} SELECT object_id, " + ", ".join(sql_r4(f"{'sin' if i % 2 == 0 else 'cos'}(tx/51*(2*pi())/pow(10000.0::double, {2 * (i // 2)}/8.0::double))", f"e{i}") for i in range(8)) + " FROM truths"),
    "gmm_nll": (gmm_nll, f"{_E} SELECT object_id, {sql_r4(f'{_ls} + 0.5::double + ln(1-{_rho}*{_rho})/2 + ({_zx}*{_zx} + {_zy}*{_zy} - 2*{_rho}*{_zx}*{_zy})/(2*(1-{_rho}*{_rho}))','nll')} FROM err WHERE mode=0"),
    "sparse_attention_demo": (sparse_attention_demo, f"""{_M}, m AS (SELECT object_id, mode, x/50 AS a, y/10 AS b FROM modes), w AS (SELECT q.object_id, q.mode, k.a AS ka, k.b AS kb, exp(q.a*k.a+q.b*k.b) AS e FROM m q JOIN m k ON q.object_id=k.object_id)
        SELECT object_id, mode, {sql_r4('sum(e*ka)/sum(e)','va')}, {sql_r4('sum(e*kb)/sum(e)','vb')} FROM w GROUP BY 1,2"""),
}
