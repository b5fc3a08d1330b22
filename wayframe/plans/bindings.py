"""Queries of the sample operators over the shipped tables, and the SQL that gives the same rows.

The tables hold no trajectories, so events give them: a user's events in order are the frames of a vehicle, event types are roles, and
embeddings of 64 numbers are paths of 32 points or retrieval vectors. Results that are sums of floating point numbers are rounded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import answers as A
from ..functions import kinematics as K
from ..functions import prompts as P
from ..functions import text as X
from ..operators import evaluate as E
from ..operators import frames as R
from ..operators import joins as J
from ..operators import models
from ..operators import retrieval as N
from ..operators import runner
from ..operators import samples as S

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of a vehicle per user: t from 0, x the running sum of value / 100, y by event type, v, lat_v, acc, yaw, lane_u."""
    e = read(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = e.withColumn("t", (F.row_number().over(w) - 1).cast("long")).withColumn("x", F.round(F.sum("value").over(w.rowsBetween(Window.unboundedPreceding, 0)) / 100, 4))
    return e.select(
        "user_id", "event_type", "t", "x", (F.col("value") / 100).alias("y"), (F.col("value") / 20).alias("v"),
        ((F.col("value") - 100) / 200).alias("lat_v"), ((F.col("value") - 100) / 50).alias("acc"), (F.col("value") / 40).alias("yaw"), (F.col("value") / 200).alias("lane_u"),
    )


FRAMES = """
f AS (SELECT user_id, event_type, row_number() OVER w - 1 AS t, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) / 100, 4) AS x,
        value / 100 AS y, value / 20 AS v, (value - 100) / 200 AS lat_v, (value - 100) / 50 AS acc, value / 40 AS yaw, value / 200 AS lane_u
      FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"""
#: First and last frame per user and role.
ENDS = FRAMES + """,
g AS (SELECT user_id, event_type, arg_min(x, t) AS x0, arg_max(x, t) AS x, arg_max(y, t) AS y, arg_min(v, t) AS v0, arg_max(v, t) AS v, arg_max(lat_v, t) AS lat_v,
        arg_min(acc, t) AS acc0, arg_max(acc, t) AS acc, arg_max(yaw, t) AS yaw, arg_max(lane_u, t) AS lane_u, count(*) AS n FROM f GROUP BY ALL)"""


def ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.ends(frames(spark, sf_dir), ("user_id", "event_type"), "t", ("x", "y", "v", "lat_v", "acc", "yaw", "lane_u"))


def points(v: str, n: int = 32):
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct(F.get(v, 2 * i).cast("double").alias("x"), F.get(v, 2 * i + 1).cast("double").alias("y")))


def places(c, n: int = 6):
    """A double of n places by the rule of the SQL's round: c * 10 ** n to a whole number, halves away from zero, and a negative zero stays. F.round takes the
    decimal text of c and has no negative zero."""
    y = (F.col(c) if isinstance(c, str) else c) * 10.0**n
    whole = F.rint(y)
    return F.when(F.abs(y - whole) == 0.5, y + F.signum(y) * 0.5).otherwise(whole) / 10.0**n


def r6(c):
    return F.round(c, 6)


@query("""
WITH p AS (SELECT vec_id, label, unnest(range(1, 65)) AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings),
s AS (SELECT pos, avg(x) AS m, CASE WHEN stddev_pop(x) < 1e-6 THEN 1.0 ELSE stddev_pop(x) END AS sd FROM p GROUP BY pos),
z AS (SELECT vec_id, label, list((x - m) / sd ORDER BY pos) AS v FROM p JOIN s USING (pos) GROUP BY ALL),
d AS (SELECT q.vec_id AS query_id, i.vec_id AS neighbor_id, list_distance(q.v, i.v) AS distance FROM z q, z i WHERE q.vec_id <> i.vec_id AND q.label <> i.label),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) AS rank FROM d) WHERE rank <= 4),
c AS (SELECT query_id, p.pos - 1 AS pos, sum(x / greatest(distance, 1e-6)) / sum(1 / greatest(distance, 1e-6)) AS value FROM k JOIN p ON p.vec_id = neighbor_id WHERE p.pos <= 17 GROUP BY ALL)
SELECT query_id, pos::INTEGER AS pos, round(value, 6) AS value FROM c""")
def knn_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Standardise, four nearest of other labels, and their context weighted by inverse distance."""
    e = read(spark, sf_dir, "embeddings")
    z = N.scaled(e, "embedding", N.moments(e, "embedding")).select(F.col("vec_id").alias("id"), F.col("label").alias("grp"), F.col("embedding").alias("v"))
    contexts = e.select(F.col("vec_id").alias("id"), F.slice("embedding", 1, 17).alias("context"))
    return N.mean_context(N.knn(z, z), contexts).select("query_id", "pos", r6("value").alias("value"))


@query("""
WITH e AS (SELECT 'v' || vec_id AS vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
d AS (SELECT q.vec_id AS query_id, i.vec_id AS neighbor_id, 1 - list_cosine_similarity(q.v, i.v) AS distance FROM e q, e i WHERE q.vec_id <> i.vec_id)
SELECT query_id, rank::INTEGER AS rank, neighbor_id, round(distance, 6) AS distance
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) AS rank FROM d) WHERE rank <= 3""")
def knn_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three nearest by cosine; ids are texts."""
    e = read(spark, sf_dir, "embeddings").select(F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("id"), F.col("label").alias("grp"), F.col("embedding").alias("v"))
    return N.knn(e, e, 3, "cosine", exclude_group=False).withColumn("distance", r6("distance"))


@query("""
WITH p AS (SELECT unnest(range(0, 64)) AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings),
m AS (SELECT pos, avg(x)::FLOAT::DOUBLE AS mean, avg(x * x) AS sq FROM p GROUP BY pos)
SELECT pos::INTEGER AS pos, round(mean, 6) AS mean, round(greatest(sqrt(greatest(sq - mean * mean, 1e-6)), 1e-6), 6) AS std FROM m""")
def scaler_two_moment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.moments(read(spark, sf_dir, "embeddings"), "embedding", two_moment=True).select("pos", r6("mean").alias("mean"), r6("std").alias("std"))


@query("""
WITH t AS (SELECT a.vec_id, unnest(range(1, 33)) AS t, unnest(a.embedding[1:64:2])::DOUBLE AS ax, unnest(a.embedding[2:64:2])::DOUBLE AS ay, unnest(b.embedding[1:64:2])::DOUBLE AS bx, unnest(b.embedding[2:64:2])::DOUBLE AS by_
  FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1),
d AS (SELECT t, sqrt((ax - bx) * (ax - bx) + (ay - by_) * (ay - by_)) AS dist FROM t)
SELECT h || 's' AS horizon, (h * 10)::INTEGER AS steps, round(avg(dist) FILTER (WHERE t <= h * 10), 6) AS ade, round(avg(dist) FILTER (WHERE t = h * 10), 6) AS fde, count(*) FILTER (WHERE t = h * 10) AS samples
FROM d, (VALUES (1), (2), (3)) v(h) GROUP BY h""")
def ade_fde_by_horizon(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings")
    pairs = e.select("vec_id", points("embedding").alias("a")).join(e.select((F.col("vec_id") - 1).alias("vec_id"), points("embedding").alias("b")), "vec_id")
    d = E.displacement(E.distances(pairs, "a", "b", ("vec_id",)), (1.0, 2.0, 3.0), 10)
    return d.select("horizon", "steps", r6("ade").alias("ade"), r6("fde").alias("fde"), "samples")


def _coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id")
    return E.coverage(docs, read(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("ok")), "doc_id", "ok")


COVERAGE = """
WITH k AS (SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN d.doc_id IS NULL THEN 'extra' WHEN l.doc_id IS NULL THEN 'missing' WHEN quality = 1 THEN 'valid' ELSE 'invalid' END AS kind
  FROM (SELECT doc_id FROM documents) d FULL JOIN labels l ON d.doc_id = l.doc_id)"""


@query(COVERAGE + " SELECT doc_id, kind FROM k")
def coverage_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _coverage(spark, sf_dir)


@query(COVERAGE + """
SELECT count(*) FILTER (WHERE kind <> 'extra') AS expected, count(*) FILTER (WHERE kind = 'valid') AS valid, count(*) FILTER (WHERE kind = 'invalid') AS invalid,
  count(*) FILTER (WHERE kind = 'missing') AS missing, count(*) FILTER (WHERE kind = 'extra') AS extra, count(*) FILTER (WHERE kind = 'valid') / count(*) FILTER (WHERE kind <> 'extra') AS valid_fraction,
  count(*) FILTER (WHERE kind IN ('valid', 'invalid')) / count(*) FILTER (WHERE kind <> 'extra') AS attempted_fraction, count(*) FILTER (WHERE kind <> 'valid') = 0 AS exact FROM k""")
def coverage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.coverage_report(_coverage(spark, sf_dir))


@query("""
WITH p AS (SELECT CASE quality WHEN 1 THEN 'keep' ELSE 'left' END AS t, CASE toxic WHEN 1 THEN 'left' ELSE 'keep' END AS p FROM labels),
l AS (SELECT label, count(*) FILTER (WHERE t = label AND p = label)::DOUBLE AS tp, count(*) FILTER (WHERE t = label) AS support, count(*) FILTER (WHERE p = label) AS predicted
  FROM p, (SELECT t AS label FROM p UNION SELECT p FROM p) GROUP BY label),
r AS (SELECT label, tp, support, coalesce(tp / nullif(predicted, 0), 0) AS precision, coalesce(tp / nullif(support, 0), 0) AS recall, coalesce(2 * tp / nullif(support + predicted, 0), 0) AS f1 FROM l)
SELECT label, support, precision, recall, f1, (SELECT sum(tp) / sum(support) FROM l)::DOUBLE AS accuracy, (SELECT avg(f1) FROM r) AS macro_f1 FROM r""")
def classification_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = read(spark, sf_dir, "labels").select(F.when(F.col("quality") == 1, "keep").otherwise("left").alias("t"), F.when(F.col("toxic") == 1, "left").otherwise("keep").alias("p"))
    return E.classification(pairs, "t", "p")


@query("WITH " + ENDS + """,
p AS (SELECT o.user_id, o.event_type AS role, o.x > e.x AS ahead, CASE WHEN o.x > e.x THEN o.x - e.x - 4.8::DOUBLE ELSE e.x - o.x - 4.8::DOUBLE END AS gap, abs(o.y - e.y) AS dy, o.v - e.v AS dv
  FROM g e JOIN g o ON e.user_id = o.user_id AND e.event_type = 'view' AND o.event_type <> 'view'),
q AS (SELECT *, CASE WHEN NOT ahead AND dv > 0.01 THEN (gap + 4.8::DOUBLE) / dv WHEN ahead AND dv < -0.01 THEN (gap + 4.8::DOUBLE) / abs(dv) ELSE 99.0 END AS ttc FROM p)
SELECT user_id, role, round(gap, 6) AS gap, CASE WHEN ahead THEN 'ahead' ELSE 'behind' END AS position, round(dy, 6) AS dy, round(dv, 6) AS dv, round(ttc, 6) AS ttc, gap < 0 AS side_by_side,
  CASE WHEN ahead AND role = 'click' AND gap < -2.4::DOUBLE THEN 'leader_overlap' WHEN gap < 0 AND dy < 2.4::DOUBLE THEN 'critical' WHEN ttc < 2 OR dy < 1.9::DOUBLE THEN 'high' WHEN ttc < 4 OR dy < 2.7::DOUBLE THEN 'medium' ELSE 'low' END AS risk FROM q""")
def ego_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ego (role view) with each other role: gap, closing time and risk, by one aggregate per user and a broadcast-free join."""
    g = ends(spark, sf_dir)
    ego = g.where("event_type = 'view'").select("user_id", F.col("last").alias("ego"))
    j = ego.join(g.where("event_type <> 'view'").select("user_id", F.col("event_type").alias("role"), F.col("last").alias("other")), "user_id")
    m = j.select("user_id", "role", K.interaction(F.col("ego"), F.col("other"), F.col("role"), leader="click").alias("m"))
    return m.select("user_id", "role", *[r6(f"m.{c}").alias(c) if c in ("gap", "dy", "dv", "ttc") else f"m.{c}" for c in ("gap", "position", "dy", "dv", "ttc", "side_by_side", "risk")])


@query("WITH " + ENDS + """,
p AS (SELECT a.user_id, a.event_type, greatest(a.x, b.x) - least(a.x, b.x) - 4.8::DOUBLE AS gap, CASE WHEN b.x > a.x THEN a.v - b.v ELSE b.v - a.v END AS dv FROM g a JOIN g b ON b.user_id = a.user_id + 1 AND a.event_type = b.event_type)
SELECT user_id, event_type, round(gap, 6) AS gap, round(CASE WHEN dv > 0.01 AND gap > 0 THEN gap / dv ELSE 99.0 END, 6) AS ttc, CASE WHEN dv > 0.3 THEN 'closing' WHEN dv < -0.3 THEN 'opening' ELSE 'steady' END AS trend FROM p""")
def neighbor_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = ends(spark, sf_dir)
    b = g.select((F.col("user_id") - 1).alias("user_id"), "event_type", F.col("last").alias("b"))
    p = g.join(b, ["user_id", "event_type"]).select("user_id", "event_type", K.pair(F.col("last"), F.col("b")).alias("m"))
    return p.select("user_id", "event_type", r6("m.gap").alias("gap"), r6("m.ttc").alias("ttc"), "m.trend")


@query("WITH " + ENDS + """,
p AS (SELECT a.user_id, a.event_type, abs(b.x0 - a.x0) - 4.8::DOUBLE AS g0, abs(b.x - a.x) - 4.8::DOUBLE AS g1, a.acc - a.acc0 AS da, a.v AS v, a.v0 AS v0 FROM g a JOIN g b ON b.user_id = a.user_id + 1 AND a.event_type = b.event_type)
SELECT user_id, event_type, round(g1 - g0, 6) AS change, CASE WHEN round(g1 - g0, 6) > 0.3 THEN 'opening' WHEN round(g1 - g0, 6) < -0.3 THEN 'closing' ELSE 'stable' END AS gap_trend,
  CASE WHEN round(da, 6) > 0.3 THEN 'up' WHEN round(da, 6) < -0.3 THEN 'down' ELSE 'flat' END AS acc_trend, CASE WHEN v > v0 THEN 'increasing' WHEN v < v0 THEN 'decreasing' ELSE 'stable' END AS speed_trend FROM p""")
def gap_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = ends(spark, sf_dir)
    b = g.select((F.col("user_id") - 1).alias("user_id"), "event_type", F.col("first").alias("b0"), F.col("last").alias("b1"))
    gap = lambda p, q: F.abs(F.col(f"{q}.x") - F.col(f"{p}.x")) - 4.8
    change = F.round(gap("last", "b1") - gap("first", "b0"), 6)
    speed = F.col("last.v") - F.col("first.v")
    return g.join(b, ["user_id", "event_type"]).select(
        "user_id", "event_type", change.alias("change"), K.banded(change, K.GAP_BAND, "opening", "closing", "stable").alias("gap_trend"),
        K.banded(F.round(F.col("last.acc") - F.col("first.acc"), 6), K.ACC_BAND, "up", "down", "flat").alias("acc_trend"), K.banded(speed, 0.0, "increasing", "decreasing", "stable").alias("speed_trend"),
    )


@query("WITH " + ENDS + """
SELECT user_id, event_type, CASE WHEN acc > 0.5 THEN 'assertive' WHEN acc < -0.5 THEN 'cautious' WHEN v > 12 THEN 'fast' ELSE 'steady' END AS style,
  CASE WHEN lane_u <= 0.3 THEN 0.9 WHEN lane_u <= 0.5 THEN 0.7 WHEN lane_u <= 0.8 THEN 0.4 WHEN lane_u <= 1.2 THEN 0.2 ELSE 0.1 END::DOUBLE AS progress,
  CASE WHEN x - x0 > 1.5 * v THEN 'safe' WHEN x - x0 > 0.5 * (1.5 * v) THEN 'short' ELSE 'too_close' END AS following,
  CASE WHEN y - 1 > 1.5 THEN 'left' WHEN y - 1 < -1.5 THEN 'right' ELSE 'keep' END AS intention,
  CASE WHEN x - x0 < 5 THEN 'position_change' ELSE 'direct' END AS reach, round(v * 3.6, 6) AS kmh, round(sqrt(v * v + lat_v * lat_v), 6) AS speed FROM g""")
def behavior_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = ends(spark, sf_dir).select("user_id", "event_type", "last.*", F.col("first.x").alias("x0"))
    moved, v = F.col("x") - F.col("x0"), F.col("v")
    return g.select(
        "user_id", "event_type", K.style(F.col("acc"), v).alias("style"), K.progress(F.lit(0), F.col("lane_u"), F.col("lat_v")).alias("progress"), K.following(moved, v).alias("following"),
        K.lateral_intention(F.col("y") - 1).alias("intention"), K.reach(moved - 5, F.lit(True)).alias("reach"), r6(v * K.KMH).alias("kmh"), r6(F.hypot(v, F.col("lat_v"))).alias("speed"),
    )


@query("WITH " + ENDS + """,
p AS (SELECT o.user_id, o.event_type, round(sqrt((o.x - e.x) * (o.x - e.x) + (o.y - e.y) * (o.y - e.y)), 6) AS dist FROM g e JOIN g o ON e.user_id = o.user_id AND e.event_type = 'view' AND o.event_type <> 'view')
SELECT user_id, event_type, dist, CASE WHEN rn < 3 THEN rn END::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY dist, event_type) - 1 AS rn FROM p)""")
def nearest_three(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = ends(spark, sf_dir)
    j = g.where("event_type = 'view'").select("user_id", F.col("last").alias("e")).join(g.where("event_type <> 'view'").select("user_id", "event_type", F.col("last").alias("o")), "user_id")
    d = j.select("user_id", "event_type", r6(F.sqrt((F.col("o.x") - F.col("e.x")) ** 2 + (F.col("o.y") - F.col("e.y")) ** 2)).alias("dist"))
    return R.nearest_neighbors(d, "user_id", F.col("dist"), ("event_type",))


@query("WITH " + ENDS + """,
p AS (SELECT o.user_id, o.event_type, o.x - e.x AS fwd, o.y - e.y AS lft FROM g e JOIN g o ON e.user_id = o.user_id AND e.event_type = 'view' AND o.event_type <> 'view')
SELECT user_id, event_type, chr((64 + rn)::INTEGER) AS letter FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(sqrt(fwd * fwd + lft * lft), 6), round(fwd, 6), round(lft, 6), event_type) AS rn FROM p) WHERE rn <= 2""")
def lettered_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = ends(spark, sf_dir)
    j = g.where("event_type = 'view'").select("user_id", F.col("last").alias("e")).join(g.where("event_type <> 'view'").select("user_id", "event_type", F.col("last").alias("o")), "user_id")
    d = j.select("user_id", "event_type", (F.col("o.x") - F.col("e.x")).alias("fwd"), (F.col("o.y") - F.col("e.y")).alias("lft"))
    return R.lettered_neighbors(d, "user_id", "fwd", "lft", "event_type", 2).select("user_id", "event_type", "letter")


@query("WITH " + FRAMES + """
SELECT user_id, round(coalesce(median(y + lane_u) FILTER (WHERE y + lane_u > 1.5 AND y + lane_u < 8), 3.9), 6) AS width,
  round(arg_max(y, t) - 2 * coalesce(median(y + lane_u) FILTER (WHERE y + lane_u > 1.5 AND y + lane_u < 8), 3.9), 6) AS lowest FROM f GROUP BY user_id""")
def lane_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = R.lane_width(frames(spark, sf_dir), "user_id", "y", "lane_u")
    return g.select("user_id", r6("width").alias("width"), r6(F.get("boundaries", F.lit(0))).alias("lowest"))


@query("""
WITH c AS (SELECT doc_id, unnest(range(0, 5)) AS p, unnest([doc_id, doc_id - 1, doc_id + 1, doc_id // 2, doc_id // 2 + 1]) AS k FROM documents),
b AS (SELECT c.doc_id, arg_min(l.quality, p) AS quality, min(p) AS p FROM c JOIN labels l ON l.doc_id = c.k GROUP BY c.doc_id)
SELECT d.doc_id, b.quality, b.p::INTEGER AS candidate FROM documents d LEFT JOIN b USING (doc_id)""")
def ordered_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, i = read(spark, sf_dir, "documents").select("doc_id"), F.col("doc_id")
    half = F.floor(i / 2).cast("long")
    return J.first_hit(d, "doc_id", [i, i - 1, i + 1, half, half + 1], read(spark, sf_dir, "labels"), "doc_id", "quality")


@query("SELECT doc_id, coalesce(quality, -1)::INTEGER AS quality, quality IS NOT NULL AS found FROM documents LEFT JOIN labels USING (doc_id)")
def default_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = J.with_default(read(spark, sf_dir, "documents").select("doc_id"), read(spark, sf_dir, "labels"), "doc_id", "quality", F.lit(-1))
    return j.select("doc_id", F.col("quality").cast("int").alias("quality"), "found")


@query("SELECT c_mktsegment, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL")
def checked_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order must have its customer, or the query fails."""
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), "c_mktsegment")
    j = J.checked(read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), "o_totalprice"), c, "k")
    return j.groupBy("c_mktsegment").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT o_orderkey, o_orderpriority FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def pending_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return J.pending(read(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), done, "o_orderkey")


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def repeated_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.repeated_keys(read(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber")


@query("""
WITH p AS (SELECT vec_id AS id, embedding[63]::DOUBLE AS x, embedding[64]::DOUBLE AS y FROM embeddings), c AS (SELECT id AS cluster, x, y FROM p WHERE id < 8)
SELECT id, arg_min(cluster, (d2, cluster))::INTEGER AS cluster, round(min(d2), 9) AS d2
FROM (SELECT p.id, c.cluster, (p.x - c.x) * (p.x - c.x) + (p.y - c.y) * (p.y - c.y) AS d2 FROM p, c) GROUP BY id""")
def anchor_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _endpoints(spark, sf_dir)
    a = N.nearest_centroid(p, p.where("id < 8").select(F.col("id").cast("int").alias("cluster"), "x", "y"))
    return a.select("id", "cluster", F.round("d2", 9).alias("d2"))


def _endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), N.endpoint(points("embedding"), F.array_repeat(F.lit(True), 32)).alias("p"))
    return e.select("id", "p.x", "p.y")


@query("""
WITH t AS (SELECT vec_id AS id, embedding[63]::DOUBLE AS x, embedding[64]::DOUBLE AS y FROM embeddings),
c AS (SELECT id AS cluster, x AS cx, y AS cy FROM t WHERE id < 64),
d AS (SELECT id, x, y, cluster, (x - cx) ** 2 + (y - cy) ** 2 AS d2 FROM t, c),
n AS (SELECT id, any_value(x) AS x, any_value(y) AS y, arg_min(cluster, (d2, cluster)) AS cluster, min(d2) AS d2 FROM d GROUP BY id)
SELECT cluster::INTEGER AS cluster, count(*) AS n, round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(sum(d2), 6) AS cost FROM n GROUP BY cluster""")
def lloyd_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One step from 64 stated centroids: the ends of the first 64 paths."""
    p = _endpoints(spark, sf_dir)
    return N.lloyd_step(p, p.where("id < 64").select(F.col("id").cast("int").alias("cluster"), "x", "y")).select("cluster", "n", r6("x").alias("x"), r6("y").alias("y"), r6("cost").alias("cost"))


@query()
def anchors_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """64 anchors of path endpoints: the best of 10 starts, 300 Lloyd rounds at most; with their number of points and cost."""
    p = _endpoints(spark, sf_dir)
    found, _ = N.anchors(p)
    return found.join(N.lloyd_step(p, found).select("cluster", "n", "cost"), "cluster", "left").select("cluster", "x", "y", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("cost", F.lit(0.0)).alias("cost"))


@query("WITH " + FRAMES + """
SELECT user_id, t, v, min(v) OVER (PARTITION BY user_id ORDER BY t) AS best, coalesce(v < min(v) OVER (PARTITION BY user_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS is_best FROM f""")
def running_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.running_best(frames(spark, sf_dir).select("user_id", "t", "v"), "user_id", ("t",), "v")


@query("""
WITH e AS (SELECT a.vec_id, a.embedding::DOUBLE[] AS p, b.embedding::DOUBLE[] AS q FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1),
s AS (SELECT list_sum(list_transform(range(1, 65), lambda i: (p[i] - q[i]) * (p[i] - q[i]))) / 64 AS mse, list_cosine_similarity(p, q) AS c FROM e)
SELECT round(avg(mse), 6) AS mse, round(avg(c), 6) AS cosine, round(avg(mse) + 0.4 * (1 - avg(c)), 6) AS combined FROM s""")
def vector_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("p"))
    j = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("p").alias("q")), "vec_id")
    m = E.vector_metric(j, "p", "q")
    return m.select(*[r6(c).alias(c) for c in m.columns])


@query("""
WITH t AS (SELECT a.vec_id, unnest(range(1, 33)) AS t, unnest(a.embedding[1:64:2])::DOUBLE AS ax, unnest(a.embedding[2:64:2])::DOUBLE AS ay, unnest(b.embedding[1:64:2])::DOUBLE AS bx, unnest(b.embedding[2:64:2])::DOUBLE AS by_
  FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)
SELECT vec_id, round(coalesce(sum(sqrt((ax - bx) * (ax - bx) + (ay - by_) * (ay - by_))) FILTER (WHERE ax > 0), 0) / greatest(count(*) FILTER (WHERE ax > 0), 1), 6) AS ade FROM t GROUP BY vec_id""")
def masked_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings").select("vec_id", points("embedding").alias("p"))
    j = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("p").alias("q")), "vec_id")
    return j.select("vec_id", r6(E.masked_ade(F.col("p"), F.col("q"), F.transform("p", lambda x: x["x"] > 0))).alias("ade"))


@query("""
SELECT vec_id, list_transform(range(0, 5), lambda i: CASE WHEN len(w) = 0 THEN -1 ELSE w[i % greatest(len(w), 1) + 1] END)::INTEGER[] AS taken,
  list_sort(list_transform(range(1, 5), lambda i: {'s': -embedding[i]::DOUBLE, 'i': i - 1}))[1:2][1].i::INTEGER AS top1, list_sort(list_transform(range(1, 5), lambda i: {'s': -embedding[i]::DOUBLE, 'i': i - 1}))[2].i::INTEGER AS top2
FROM (SELECT *, list_filter(range(0, 3), lambda i: embedding[i + 1] > 0) AS w FROM embeddings)""")
def cyclic_and_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings")
    valid = F.transform(F.slice("embedding", 1, 3), lambda x: x > 0)
    top = R.top_modes(F.transform(F.slice("embedding", 1, 4), lambda x: x.cast("double")), 2)
    return e.select("vec_id", R.cyclic(valid, 5).alias("taken"), F.get(top, F.lit(0)).alias("top1"), F.get(top, F.lit(1)).alias("top2"))


PHRASE = "(['  Anticipating', 'crossing now', 'Stabilised', 'none'])[1 + (event_id % 4)::INTEGER]"


@query("""
SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'anticipation' WHEN 1 THEN 'crossing' WHEN 2 THEN 'relaxation' ELSE 'anticipation' END AS phase,
  CASE event_type WHEN 'click' THEN 'ACCELERATE_PASS' WHEN 'view' THEN 'YIELD_FOR_GAP2' ELSE upper(event_type) END AS strategy, CASE event_id % 3 WHEN 0 THEN 'DECEL' WHEN 1 THEN 'ACCEL' ELSE 'KEEP' END AS speed,
  CASE event_id % 3 WHEN 0 THEN 'TFF' WHEN 1 THEN 'OL' ELSE 'NONE' END AS interaction, CASE WHEN event_id % 2 = 0 THEN 'LEFT_TURN' END AS label,
  CASE event_id % 3 WHEN 0 THEN 'left_lane_change' WHEN 1 THEN 'right_lane_change' END AS intention, (props::JSON ->> 'k')::DOUBLE AS number FROM events""")
def normalized_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    word = lambda *w: F.get(F.array(*map(F.lit, w)), (F.col("event_id") % len(w)).cast("int"))
    raw = F.when(F.col("event_type") == "click", "--accelerate!").when(F.col("event_type") == "view", " yield ").otherwise(F.concat(F.lit("  "), "event_type"))
    return e.select(
        "event_id", X.phase(word("  Anticipating", "crossing now", "Stabilised", "none")).alias("phase"), X.strategy(raw).alias("strategy"), X.speed_change(word("brake, then speed up", "Catch up", "hold")).alias("speed"),
        X.interaction(word(" tff", "OL ", "ahead")).alias("interaction"), X.label(word(" left-turn", "keep right"), A.ACTIONS).alias("label"),
        A.intention(word("LLC", "Change_Right", "back")).alias("intention"), X.safe_float(F.col("props")).alias("number"),
    )


@query("""SELECT page_id, regexp_replace(url, '[^A-Za-z0-9._-]', '_', 'g')[1:48] || '-' || sha256(url)[1:12] AS stem,
  ('0x' || sha256('7|' || length(url) || ':' || url || length(page_id::VARCHAR) || ':' || page_id)[1:8])::BIGINT AS seed, (page_id // 2)::VARCHAR || CASE WHEN page_id % 2 = 1 THEN '.5' ELSE '' END AS name FROM pages""")
def artifact_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = F.array("url", F.col("page_id").cast("string"))
    return read(spark, sf_dir, "pages").select("page_id", X.stem(F.col("url")).alias("stem"), X.batch_seed(F.lit(7), ids).alias("seed"), X.identifier(F.col("page_id") / 2).alias("name"))


@query("""
WITH v AS (SELECT event_id, event_type, value, event_id % 3 AS p, event_id % 2 = 0 AS even FROM events)
SELECT event_id, CASE p WHEN 0 THEN 'anticipation' WHEN 1 THEN 'crossing' ELSE 'relaxation' END AS phase, CASE WHEN even THEN 'TL' ELSE 'NONE' END AS key_interaction,
  CASE WHEN event_type = 'click' THEN ['wait here'] ELSE [] END AS ignored, NULL::VARCHAR AS error, list_transform([p = 0, p = 1, p = 2]::INTEGER[] || [
    0, 0, 0, 0, CASE WHEN even THEN 1 ELSE 0.5 END, round(least(greatest(value / 100, 0), 1), 4), 0, 0, 0, 0, CASE WHEN event_type = 'click' THEN 0 ELSE 0.25 END, 0]
    || (CASE WHEN event_type = 'view' THEN [1, 0, 0] ELSE [0, 0, 1] END) || [round(value, 4), CASE WHEN even THEN 0.5 ELSE 0 END, -2, 0, 0, 1] || [1, CASE WHEN even THEN 1 ELSE 0 END, 1, 0, 1, 1], lambda x: round(x::DOUBLE, 4)) AS vector FROM v""")
def strategy_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers in free text with one JSON object, to the vector of 30 numbers."""
    e = read(spark, sf_dir, "events")
    even = F.col("event_id") % 2 == 0
    phase = F.get(F.array(F.lit("Anticipation"), F.lit("lane crossing"), F.lit("stabilising")), (F.col("event_id") % 3).cast("int"))
    scores = F.concat(F.lit('{"maintain": 0.5, "yield": '), F.round(F.col("value") / 100, 4).cast("string"), F.when(even, ', "Maintain and observe": true').otherwise(""), F.lit(', "'), F.when(F.col("event_type") == "click", "wait here").otherwise("hold-and-wait"), F.lit('": "about 0.25"}'))
    decision = F.concat(F.lit('{"strategy_scores": '), scores, F.lit(', "aggressiveness": '), F.round("value", 4).cast("string"), F.when(even, ', "risk_tolerance": "0.5"').otherwise(', "risk_tolerance": null'), F.lit(', "lateral_intent": -2, "confidence": "none", "stability_level": true}'))
    guidance = F.concat(F.lit('{"expected_speed_change": "'), F.when(F.col("event_type") == "view", "speed up").otherwise("slow, then catch up"), F.lit('"'), F.when(even, ', "key_interaction": " tl"').otherwise(""), F.lit("}"))
    text = F.concat(F.lit('So: {"phase": "'), phase, F.lit('", "decision": '), decision, F.lit(', "prediction_guidance": '), guidance, F.lit(', "note": "a } in a string"} {that is all'))
    v = e.select("event_id", A.strategy_answer(text).alias("v")).select("event_id", "v.*")
    return v.select("event_id", "phase", "key_interaction", F.map_keys("ignored").alias("ignored"), "error", F.transform("vector", lambda x: F.round(x.cast("double"), 4)).alias("vector"))


@query("""
SELECT event_id, CASE event_id % 8 WHEN 1 THEN 'count' WHEN 2 THEN 'keys' WHEN 3 THEN 'not json' WHEN 4 THEN 'not finite' WHEN 5 THEN 'repeated key' WHEN 6 THEN 'point' WHEN 7 THEN 'not json' END AS error,
  CASE WHEN event_id % 8 = 0 THEN (event_id + 3.5)::DOUBLE END AS total FROM events""")
def strict_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id").cast("string")
    forms = [("[[", "1],[2,0.5]]"), ("[[", "1]]"), None, ("[[", "1],[2,1]] tail"), ("[[", "NaN],[1,2]]"), None, ("[[", "true],[1,2]]"), None]
    made = [F.concat(F.lit('{"future_trajectory": ' + f[0]), i, F.lit("," + f[1] + "}")) if f else None for f in forms]
    made[2], made[5], made[7] = F.lit('{"other": 1}'), F.lit('{"future_trajectory": [], "future_trajectory": []}'), F.lit("```json\n{}\n```")
    e = read(spark, sf_dir, "events").select("event_id", F.get(F.array(*made), (F.col("event_id") % 8).cast("int")).alias("text"))
    r = e.select("event_id", X.strict_points(F.col("text"), 2).alias("r"))
    return r.select("event_id", "r.error", F.aggregate(F.flatten("r.points"), F.lit(0.0), lambda s, x: s + x).alias("total"))


@query("""
WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \\n]+'), lambda x: x <> '') AS w FROM documents)
SELECT doc_id, CASE WHEN len(w) <= 9 THEN w ELSE list_concat(w[1:5], w[len(w) - 3:len(w)]) END AS kept, (ceil(least(len(w), 9) / 8) * 8)::INTEGER AS padded FROM t""")
def truncated_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = read(spark, sf_dir, "documents").select("doc_id", F.array_remove(F.split("text", "[ \\n]+"), "").alias("w"))
    k = w.select("doc_id", X.head_and_tail(F.col("w"), 9).alias("kept"))
    return k.select("doc_id", "kept", F.size(X.padded(F.col("kept"), F.lit(""), 8)).alias("padded"))


@query("""
SELECT conv_id || ':' || turn AS sample_id, conv_id::VARCHAR AS event_id, CASE WHEN conv_id % 4 = 0 THEN 'test' ELSE 'train' END AS source_split, 'Answer as ' || role || '.' AS system_prompt, text AS user_prompt,
  '<s>Answer as ' || role || '.' || chr(10) || text || '</s>' AS prompt_text FROM conversations""")
def prompt_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of both splits, each row once."""
    system = F.concat(F.lit("Answer as "), "role", F.lit("."))
    p = read(spark, sf_dir, "conversations").select(
        F.concat_ws(":", "conv_id", "turn").alias("sample_id"), F.col("conv_id").cast("string").alias("event_id"), F.when(F.col("conv_id") % 4 == 0, "test").otherwise("train").alias("split"),
        system.alias("system_prompt"), F.col("text").alias("user_prompt"), F.concat(F.lit("<s>"), system, F.lit("\n"), "text", F.lit("</s>")).alias("prompt_text"),
    )
    return J.assert_no_future(J.only_split(p, "train").unionByName(J.only_split(p, "test")).withColumnRenamed("split", "source_split"))


@query("""
SELECT status, count(*) AS n, sum(attempts)::BIGINT AS attempts FROM (SELECT CASE WHEN length(text) % 5 = 0 THEN 'parse_error' ELSE 'ok' END AS status, CASE WHEN length(text) % 5 = 0 THEN 2 ELSE 1 END AS attempts FROM conversations) GROUP BY status""")
def batch_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stub predictor over prompts; outputs that the parser refuses are asked for once more."""
    c = read(spark, sf_dir, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("sample_id"), F.col("text").alias("prompt_text"))

    def parse(raw: str) -> int:
        if int(raw) % 5 == 0:
            raise ValueError("a multiple of five")
        return int(raw)

    done = runner.predictions(c, lambda prompts: [str(len(p)) for p in prompts], parse, format_retries=1)
    return done.groupBy("status").agg(F.count("*").alias("n"), F.sum("attempts").alias("attempts"))


@query("""
SELECT event_id, CASE WHEN event_id % 5 < 2 THEN list_concat(CASE event_id % 2 WHEN 0 THEN [0.0, 1, 0, 0, 2, 0, 0, 0] ELSE [1.0, 0, 0, 0, 0, 0, 0, 0] END,
  CASE event_id % 2 WHEN 0 THEN [1.0, 0, 1, 0] ELSE [0.0, 0, 0, 0] END, [CASE WHEN event_type = 'view' THEN 1.0 ELSE 0 END, 0, CASE WHEN event_type = 'view' THEN 0 ELSE 1.0 END, 0, 0])::DOUBLE[] END AS vector FROM events""")
def context_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Context answers to 17 numbers; three of five forms break a rule: a repeat, an unknown label, another key."""
    scenario = F.when(F.col("event_type") == "view", "intersection").otherwise("Parking-lot")
    even = F.col("event_id") % 2 == 0
    lists = lambda a, b: F.when(even, F.array(*map(F.lit, a))).otherwise(F.array(*map(F.lit, b)).cast("array<string>"))
    form = F.col("event_id") % 5
    actions = F.when(form == 2, F.array(F.lit("stationary"), F.lit(" STATIONARY"))).when(form == 3, F.array(F.lit("fly"))).otherwise(lists(("left-turn", "straight"), ("stationary",)))
    values = (F.lit("s"), F.lit("r"), actions, lists(("slow allow", "LEFT_ALLOW"), ()), scenario)
    whole = F.to_json(F.struct(*[v.alias(k) for k, v in zip(A.KEYS, values)]))
    text = F.when(form == 4, F.regexp_replace(whole, "Reasoning", "Reasons")).when(form == 1, F.concat(F.lit("```json\n"), whole, F.lit("\n```"))).otherwise(whole)
    return read(spark, sf_dir, "events").select("event_id", A.context_vector(A.context(text)).alias("vector"))


@query("""SELECT event_id, CASE WHEN event_id % 4 < 2 THEN (event_id % 3)::INTEGER END AS intention, CASE WHEN event_id % 4 < 2 THEN [['slow', 'near'], ['waits']] END AS said,
  CASE WHEN event_id % 4 < 2 THEN round(round(value, 2) + 1.5, 2) END AS total FROM events""")
def joint_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of a thought and a final block; two of four forms break a rule: a name of another number, a further line."""
    form, i = F.col("event_id") % 4, (F.col("event_id") % 3).cast("int")
    text = A.formatted_joint(F.array(F.lit(" slow"), F.lit("near")), F.array(F.lit("waits")), i, F.array(F.array(F.round("value", 2), F.lit(0.0)), F.array(F.lit(1.0), F.lit(0.5))))
    name = lambda k: F.get(F.array(*map(F.lit, A.INTENTIONS)), k)
    text = F.when(form == 1, F.regexp_replace(F.lower(text), ": [a-z ]+\"\n", "\n")).when(form == 2, F.replace(text, name(i), name((i + 1) % 3))).when(form == 3, F.concat(text, F.lit("\nmore"))).otherwise(text)
    r = read(spark, sf_dir, "events").select("event_id", A.joint_answer(text, 2).alias("r"))
    total = F.aggregate(F.transform(F.flatten("r.points"), lambda x: x.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return r.select("event_id", "r.intention", F.when(F.col("r").isNotNull(), F.array("r.features", "r.behaviors")).alias("said"), F.round(total, 2).alias("total"))


@query("WITH s AS (SELECT user_id, event_type, avg(value) AS m FROM events GROUP BY ALL) SELECT round(avg(m), 6) AS mean, count(*) AS samples FROM s")
def repeat_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select(F.struct("user_id", "event_type").alias("sample"), "value")
    return models.repeat_average(e, "sample", "value").select(r6("mean").alias("mean"), "samples")


@query("""
WITH t AS (SELECT doc_id, len(regexp_extract_all(text, '[^ \\n]+')) AS n FROM documents)
SELECT doc_id, (least(n, 24) + 8)::INTEGER AS tokens, (least(n, 24) * -100)::BIGINT AS masked FROM t""")
def training_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts of word lengths with an answer of seven tokens and an end token, 32 at most; labels of the prompt are masked."""
    w = F.transform(F.array_remove(F.split("text", "[ \\n]+"), ""), lambda x: F.length(x))
    p = read(spark, sf_dir, "documents").select("doc_id", A.training_pair(w, F.array(*[F.lit(1)] * 7), 2, 32).alias("p"))
    return p.select("doc_id", F.size("p.input_ids").alias("tokens"), F.aggregate(F.filter("p.labels", lambda x: x < 0), F.lit(0).cast("long"), lambda s, x: s + x).alias("masked"))


@query("WITH " + FRAMES + """ SELECT user_id, round(min(x) - 5, 6) AS x0, round(max(x) + 5, 6) AS x1, round(min(least(y, -lane_u)) - 5, 6) AS y0, round(max(greatest(y, lane_u)) + 5, 6) AS y1 FROM f GROUP BY user_id""")
def scene_extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Smallest and largest places of a scene's points and lanes, with a margin."""
    low, high = F.min(F.least("y", -F.col("lane_u"))), F.max(F.greatest("y", "lane_u"))
    return frames(spark, sf_dir).groupBy("user_id").agg(r6(F.min("x") - 5).alias("x0"), r6(F.max("x") + 5).alias("x1"), r6(low - 5).alias("y0"), r6(high + 5).alias("y1"))


@query("WITH " + FRAMES + """,
h AS (SELECT user_id, list(x ORDER BY t) AS xs FROM f GROUP BY user_id),
p AS (SELECT *, range(0, greatest(10 - len(xs), 0)) AS gap FROM h)
SELECT user_id, list_concat(xs[1:10], list_transform(gap, lambda i: 0.0::DOUBLE)) AS head, list_concat(list_transform(gap, lambda i: NULL::DOUBLE), xs[-10:]) AS tail, list_filter(xs, lambda x, i: (i - 1) % 3 = 0 OR i = len(xs)) AS strided FROM p""")
def history_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Head, tail and stride of every user's whole history."""
    h = frames(spark, sf_dir).groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("t", "x"))).alias("a")).select("user_id", F.transform("a", lambda p: p["x"]).alias("xs"))
    return h.select("user_id", R.head_window(F.col("xs"), 10, F.lit(0.0)).alias("head"), R.tail_window(F.col("xs"), 10).alias("tail"), R.strided(F.col("xs"), 3).alias("strided"))


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames with the sample of ten, by t, that they belong to; a user's last sample may be shorter."""
    return frames(spark, sf_dir).withColumn("sample", F.expr("t div 10"))


@query("WITH " + FRAMES + """,
h AS (SELECT user_id, t // 10 AS sample, t, x - first_value(x) OVER w AS dx, y - first_value(y) OVER w AS dy, last_value(CASE WHEN abs(yaw) > 2 * pi() + 1e-3 THEN radians(yaw) ELSE yaw END) OVER w AS h, yaw FROM f
  WINDOW w AS (PARTITION BY user_id, t // 10 ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT user_id, sample, t, round(cos(h) * dx + sin(h) * dy, 6) + 0.0::DOUBLE AS fwd, round(cos(h) * dy - sin(h) * dx, 6) + 0.0::DOUBLE AS lft,
  0.0::DOUBLE + round(yaw - h + pi() - 2 * pi() * floor((yaw - h + pi()) / (2 * pi())) - pi(), 6) AS turn FROM h""")
def target_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id", "sample").orderBy("t").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    h = K.heading(F.col("yaw"))
    f = _samples(spark, sf_dir).withColumns({"dx": F.col("x") - F.first("x").over(w), "dy": F.col("y") - F.first("y").over(w), "h": F.last(h).over(w)})
    fwd, left = K.rotated(F.col("dx"), F.col("dy"), F.col("h"))
    return f.select("user_id", "sample", "t", (r6(fwd) + 0.0).alias("fwd"), (r6(left) + 0.0).alias("lft"), (r6(K.wrapped(F.col("yaw") - F.col("h"))) + 0.0).alias("turn"))


#: Samples of up to ten frames as lists: x, y, v, lateral speed, acceleration, yaw and lane_u.
HISTORIES = "WITH " + FRAMES + """,
h AS (SELECT user_id, t // 10 AS sample, count(*) AS n, list(x ORDER BY t) AS xs, list(y ORDER BY t) AS ys, list(v ORDER BY t) AS vs, list(lat_v ORDER BY t) AS ls, list(acc ORDER BY t) AS cs, list(yaw ORDER BY t) AS hs,
        list(lane_u ORDER BY t) AS us FROM f GROUP BY ALL)"""


def raw_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples in the columns of S.RAW, with user_id and sample: the six users that follow are the neighbours, a user's next sample the future.

    Users are dealt by blocks of 64 that follow each other, and the first six of a block also go to the block before, so a group holds 70 samples at most.
    """
    user, most = F.col("user_id"), len(S.ROLES)
    block = lambda u: F.shiftright(u, 6)
    row = F.struct("t", "x", "y", "v", "lat_v", "acc", "yaw", "lane_u")
    h = _samples(spark, sf_dir).groupBy("user_id", "sample").agg(F.sort_array(F.collect_list(row)).alias("a"))
    h = h.withColumn("next", F.lead("a").over(Window.partitionBy("user_id").orderBy("sample")))
    sent = h.withColumn("block", F.explode(F.array_distinct(F.array(block(user), block(user - most)))))
    follow = Window.partitionBy("sample", "block").orderBy("user_id").rangeBetween(1, most)
    met = sent.withColumn("near", F.collect_list(F.when(user.isNotNull(), F.struct("user_id", "a"))).over(follow)).where(F.col("block").eqNullSafe(block(user)))
    met = met.withColumn("near", F.map_from_entries("near"))
    zero, uid = F.lit(0.0), F.col("user_id").cast("double")
    near = lambda k: F.transform(F.try_element_at("near", user + k), lambda r: F.array(uid + k, F.lit(1.0), r["x"], r["y"], r["v"], r["lat_v"], r["acc"], r["yaw"]))
    ego = F.transform("a", lambda r: F.array(uid, F.lit(1.0), r["t"].cast("double"), r["x"], r["y"], r["y"], r["lane_u"], *[zero] * 8, r["lat_v"], r["v"], r["acc"], r["yaw"]))
    return met.select(
        "user_id", "sample", uid.alias("scenario_id"), F.col("sample").cast("double").alias("traj_id"), (uid % 4).alias("lane_status"), F.col("sample").cast("double").alias("time_since_crossing"),
        F.transform("a", lambda r: F.array(r["x"], r["y"], r["v"], r["lat_v"], r["acc"], r["yaw"])).alias("x_hist"), F.struct(ego.alias("ego"), *[near(k).alias(r) for k, r in enumerate(S.ROLES, 1)]).alias("ctx"),
        F.transform("next", lambda r: F.array(r["x"], r["y"])).alias("y_future"),
    )


def rounded(a):
    """Numbers of six places, without a negative zero."""
    return F.transform(a, lambda x: places(x) + 0.0)


@query(HISTORIES + """,
m AS (SELECT user_id, sample, n, (user_id % 4)::INTEGER AS status, i, a, CASE WHEN a = 0 THEN NULL ELSE a + CASE WHEN user_id % 4 = 2 THEN 3 ELSE 0 END END AS off,
        xs, ys, vs, ls FROM h, (SELECT unnest(range(1, 11)) AS i) r, (SELECT unnest(range(0, 4)) AS a) k WHERE i <= n),
j AS (SELECT m.*, o.n AS o_n, o.xs AS ox, o.ys AS oy, o.vs AS ov, o.ls AS ol,
        coalesce(len(list_filter(list_concat(o.xs[1:m.n], o.ys[1:m.n]), lambda x: abs(x) > 1e-6)) > 0, false) AS present FROM m LEFT JOIN h o ON o.user_id = m.user_id + m.off AND o.sample = m.sample),
w AS (SELECT user_id, sample, i, a, CASE WHEN a = 0 THEN [xs[i] - xs[1], ys[i] - ys[1], vs[i], ls[i]] WHEN NOT present THEN [0.0::DOUBLE, 0, 0, 0]
        ELSE [coalesce(ox[i], 0) - xs[i], coalesce(oy[i], 0) - ys[i], coalesce(ov[i], 0), coalesce(ol[i], 0)] END AS v FROM j)
SELECT user_id, sample, list_transform(flatten(list(v ORDER BY i, a)), lambda x: round(x, 6) + 0.0::DOUBLE) AS vector FROM w GROUP BY ALL""")
def history_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat vector of a sample's ego and the three neighbours that its phase chooses, 160 numbers where it has ten frames."""
    ego = S.named(F.col("ctx.ego"), S.EGO)
    others = F.array(*[S.named(F.coalesce(F.col(f"ctx.{r}"), F.array().cast(S.MATRIX)), S.NEIGHBOR) for r in S.ROLES])
    d = raw_samples(spark, sf_dir).select("user_id", "sample", ego.alias("ego"), S.by_phase(F.col("lane_status"), others).alias("others"))
    return d.select("user_id", "sample", rounded(S.history_vector(F.col("ego"), F.col("others"))).alias("vector"))


@query(HISTORIES + """,
c AS (SELECT h.user_id, h.sample, list(coalesce(o.n, 0)::INTEGER ORDER BY a) AS valid FROM h CROSS JOIN (SELECT unnest(range(1, 7)) AS a) k LEFT JOIN h o ON o.user_id = h.user_id + a AND o.sample = h.sample GROUP BY ALL)
SELECT h.user_id, h.sample, h.user_id || ':' || h.sample || ':' || CASE WHEN h.n < 10 THEN '' ELSE (h.sample * 10 + 9)::VARCHAR END AS sample_id, h.user_id::VARCHAR AS event_id, valid,
  CASE WHEN h.n < 10 THEN 'x_hist has too few rows' WHEN h.user_id % 4 = 3 THEN 'lane_status is not allowed' WHEN f.n <> 10 THEN 'y_future has another number of rows' END AS error
FROM h JOIN c USING (user_id, sample) LEFT JOIN h f ON f.user_id = h.user_id AND f.sample = h.sample + 1""")
def adapted_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sample with its key, the frames in which each neighbour is valid, and the first rule that it breaks."""
    a = S.adapted(raw_samples(spark, sf_dir), statuses=(0, 1, 2), future_rows=10)
    return a.select("user_id", "sample", "sample_id", "event_id", F.transform("neighbors", lambda n: F.size(F.filter(n, lambda r: r["valid"]))).alias("valid"), "error")


def good_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.split_by_error(S.adapted(raw_samples(spark, sf_dir)))[0]


@query(HISTORIES + """,
e AS (SELECT * FROM h WHERE n = 10),
p AS (SELECT e.user_id, e.sample, a, i, e.xs[10] AS x0, e.ys[10] AS y0, e.hs[10] AS w, o.n IS NOT NULL AND i > 10 - o.n AS ok, o.xs[i - 10 + o.n] AS x, o.ys[i - 10 + o.n] AS y, o.vs[i - 10 + o.n] AS v,
        o.ls[i - 10 + o.n] AS l, o.cs[i - 10 + o.n] AS c, o.hs[i - 10 + o.n] - e.hs[10] AS d
      FROM e CROSS JOIN (SELECT unnest(range(0, 7)) AS a) k CROSS JOIN (SELECT unnest(range(1, 11)) AS i) r LEFT JOIN h o ON o.user_id = e.user_id + a AND o.sample = e.sample),
g AS (SELECT user_id, sample, flatten(list(CASE WHEN ok THEN [cos(w) * (x - x0) + sin(w) * (y - y0), cos(w) * (y - y0) - sin(w) * (x - x0), cos(w) * v + sin(w) * l, cos(w) * l - sin(w) * v, c, sin(d), cos(d)]
        ELSE [0.0::DOUBLE, 0, 0, 0, 0, 0, 0] END ORDER BY a, i)) AS agents, list(CASE WHEN ok THEN 1.0::DOUBLE ELSE 0 END ORDER BY a, i) AS mask FROM p GROUP BY ALL),
b AS (SELECT user_id, sample, coalesce(list_median(list_filter(list_transform(range(1, 11), lambda i: ys[i] + us[i]), lambda x: x > 1.5 AND x < 8)), 3.9::DOUBLE) AS wide, ys[10] AS up, us[10] AS low FROM e),
q AS (SELECT user_id, sample, wide, CASE WHEN up > 0 THEN up ELSE wide / 2 END AS up, CASE WHEN low > 0 THEN low ELSE wide / 2 END AS low FROM b),
l AS (SELECT user_id, sample, flatten(list_transform(list_sort([-up, low, -up - wide, low + wide]), lambda y: flatten(list_transform(range(0, 20), lambda i: [-35 + i * 90.0::DOUBLE / 19, y])))) AS lines FROM q)
SELECT user_id, sample, list_transform(list_concat(list_concat(agents, mask), list_concat(lines, list_transform(range(0, 80), lambda i: 1.0::DOUBLE))), lambda x: round(x, 6) + 0.0::DOUBLE) AS vector FROM g JOIN l USING (user_id, sample)""")
def retrieval_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 800 numbers of every sample with ten frames: agents, their mask, lane lines and the mask of these."""
    return good_samples(spark, sf_dir).select("user_id", "sample", rounded(S.retrieval_vector(F.col("history"), F.col("ego"), F.col("neighbors"))).alias("vector"))


@query(HISTORIES + """,
e AS (SELECT h.user_id, h.sample, h.xs[1] AS x1, h.ys[1] AS y1, h.xs[10] AS x0, h.ys[10] AS y0, h.hs[10] AS w, f.n, f.xs, f.ys FROM h JOIN h f ON f.user_id = h.user_id AND f.sample = h.sample + 1 WHERE h.n = 10)
SELECT user_id, sample, CASE WHEN n = 10 THEN flatten(list_transform(range(1, 11), lambda i: [round(xs[i] - x1, 6) + 0.0::DOUBLE, round(ys[i] - y1, 6) + 0.0::DOUBLE])) END AS target,
  flatten(list_transform(range(1, 13), lambda i: CASE WHEN i <= n THEN [round(cos(w) * (xs[i] - x0) + sin(w) * (ys[i] - y0), 6) + 0.0::DOUBLE, round(cos(w) * (ys[i] - y0) - sin(w) * (xs[i] - x0), 6) + 0.0::DOUBLE] ELSE [0.0::DOUBLE, 0] END)) AS local, n::INTEGER AS valid FROM e""")
def future_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Futures of samples: from the first place of the history, and twelve points in the frame of the last one."""
    g = good_samples(spark, sf_dir).where("future is not null")
    d = g.select("user_id", "sample", S.target_vector(F.col("future"), F.col("ego"), 10).alias("t"), S.local_future(F.col("future"), F.col("history"), 12).alias("l"))
    return d.select(
        "user_id", "sample", rounded(F.col("t")).alias("target"), rounded(F.flatten(F.transform("l", lambda p: F.array(p["fwd"], p["left"])))).alias("local"), F.size(F.filter("l", lambda p: p["valid"])).alias("valid"),
    )


@query(HISTORIES + """,
e AS (SELECT user_id, sample, xs[10] AS x0, ys[10] AS y0, vs[10] AS v0, ls[10] AS l0, cs[10] AS c0, CASE WHEN abs(hs[10]) > 2 * pi() + 1e-3 THEN radians(hs[10]) ELSE hs[10] END AS w FROM h WHERE n = 10),
z AS (SELECT *, cos(w) * v0 + sin(w) * l0 AS fwd, (cos(w) * l0 - sin(w) * v0) * 3.6 AS side FROM e),
o AS (SELECT z.user_id, z.sample, a AS agent, cos(w) * (xs[n] - x0) + sin(w) * (ys[n] - y0) AS away, (cos(w) * vs[n] + sin(w) * ls[n] - fwd) * 3.6 AS slower FROM z CROSS JOIN (SELECT unnest(range(1, 7)) AS a) k JOIN h ON h.user_id = z.user_id + a AND h.sample = z.sample),
s AS (SELECT user_id, sample, 0 AS agent, 0 AS part, CASE WHEN side > 0 THEN 'moves_left' ELSE 'moves_right' END AS what, abs(side) AS value FROM z WHERE abs(side) > 1.5
  UNION ALL SELECT user_id, sample, 0, 1, CASE WHEN c0 > 0 THEN 'accelerates' ELSE 'brakes' END, c0 FROM z WHERE abs(c0) > 0.5
  UNION ALL SELECT user_id, sample, agent, 2, CASE WHEN away >= 0 AND slower < -2 THEN 'slower_ahead' WHEN away >= 0 THEN 'ahead' ELSE 'behind' END, CASE WHEN away >= 0 AND slower < -2 THEN abs(slower) ELSE abs(away) END
    FROM o WHERE abs(away) <= 100 AND (abs(away) < 40 OR (away >= 0 AND slower < -2))),
l AS (SELECT user_id, sample, list({'what': what, 'agent': agent::INTEGER, 'value': value} ORDER BY agent, part)[1:4] AS found FROM s GROUP BY ALL)
SELECT user_id, sample, coalesce(list_transform(found, lambda s: s.what), ['steady']) AS what, coalesce(list_transform(found, lambda s: s.agent), [0::INTEGER]) AS agent, coalesce(list_transform(found, lambda s: round(s.value, 4)), [0.0::DOUBLE]) AS value
FROM z LEFT JOIN l USING (user_id, sample)""")
def notable_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = good_samples(spark, sf_dir).select("user_id", "sample", S.notable(F.col("history"), F.col("neighbors")).alias("s"))
    part = lambda k: F.transform("s", lambda s: s[k])
    return d.select("user_id", "sample", part("what").alias("what"), part("agent").alias("agent"), F.transform("s", lambda s: F.round(s["value"], 4)).alias("value"))


@query("WITH " + ENDS + """
SELECT user_id, event_type, CASE WHEN lane_u < 0.5 THEN 'at_boundary' WHEN lane_u < 1 THEN 'nearing' ELSE 'centered' END AS drift, CASE WHEN lat_v > 0.2 THEN 'toward' WHEN lat_v < -0.2 THEN 'away' ELSE 'steady' END AS other_drift,
  CASE WHEN yaw - 2.5 > 0.03 THEN 'toward' WHEN yaw - 2.5 < -0.03 THEN 'away' ELSE 'aligned' END AS pointing, CASE WHEN y - 1 < -1 THEN 'side_by_side' WHEN acc > 0 THEN 'ahead' ELSE 'behind' END AS position, y - 1 < -1 OR acc <= 0 AS advantage FROM g""")
def place_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = ends(spark, sf_dir).select("user_id", "event_type", "last.*")
    side = K.side_flags(F.col("y") - 1, F.col("acc") > 0)
    nowhere = F.lit(None).cast("double")
    return g.select(
        "user_id", "event_type", K.drift(F.col("lane_u"), F.col("lat_v")).alias("drift"), K.drift(nowhere, F.col("lat_v")).alias("other_drift"), K.pointing(F.col("yaw") - 2.5).alias("pointing"),
        side["position"].alias("position"), side["advantage"].alias("advantage"),
    )


@query("""
WITH v AS (SELECT event_id, event_type, round(value, 4) AS x, event_id % 3 = 0 AS settled, event_id % 5 = 0 AS bare FROM events)
SELECT event_id, CASE WHEN settled THEN 'RELAXATION' ELSE 'ANTICIPATION' END AS phase, CASE WHEN bare THEN CASE WHEN settled THEN 'MAINTAIN_STABLE' ELSE 'MAINTAIN_AND_OBSERVE' END WHEN event_type = 'click' THEN 'SPEED_MATCH' ELSE 'PROBING_APPROACH' END AS strategy,
  CASE WHEN bare THEN CASE WHEN settled THEN 3 ELSE 4 END WHEN event_type = 'click' THEN CASE WHEN settled THEN 2 ELSE 4 END WHEN settled THEN 3 ELSE 1 END::INTEGER AS strategy_id,
  CASE WHEN settled THEN -1 WHEN bare THEN 2 ELSE 1 END::INTEGER AS gap_id, CASE WHEN bare THEN 0.5 ELSE x END AS confidence, CASE WHEN settled THEN NULL WHEN bare THEN 0.5 ELSE x END AS aggressiveness, CASE WHEN bare THEN 'KEEP' ELSE 'ACCEL' END AS speed_change FROM v""")
def decision_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of decisions in JSON; every fifth has a phase only, so its labels are defaults."""
    bare, settled = F.col("event_id") % 5 == 0, F.col("event_id") % 3 == 0
    full = F.when(~bare, F.struct(F.when(F.col("event_type") == "click", "speed_match").otherwise("Probing_Approach").alias("primary_strategy"), F.lit("gap2").alias("target_gap"), F.round("value", 4).alias("confidence"), F.round("value", 4).alias("aggressiveness")))
    text = F.to_json(F.struct(F.when(settled, "relaxation").alias("phase"), full.alias("decision"), F.when(~bare, F.struct(F.lit("speed up").alias("expected_speed_change"))).alias("prediction_guidance")))
    d = read(spark, sf_dir, "events").select("event_id", A.decision_labels(text).alias("d")).select("event_id", "d.*")
    return d.select("event_id", "phase", "strategy", "strategy_id", "gap_id", "confidence", "aggressiveness", "speed_change")


@query("SELECT doc_id FROM documents ORDER BY sha256('3:' || doc_id), doc_id LIMIT 50")
def seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty random documents; the same ones however the table is partitioned."""
    return S.sampled(read(spark, sf_dir, "documents").select("doc_id"), 50, "doc_id", 3)


@query("""
WITH t AS (SELECT a.vec_id, list_transform(range(1, 33), lambda i: sqrt((a.embedding[2 * i - 1]::DOUBLE - b.embedding[2 * i - 1]::DOUBLE) ** 2 + (a.embedding[2 * i]::DOUBLE - b.embedding[2 * i]::DOUBLE) ** 2)) AS d,
  len(list_filter(a.embedding[1:64:2], lambda x: x > 0)) AS n FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)
SELECT vec_id, CASE WHEN n > 0 THEN round(d[n], 6) END AS fde FROM t""")
def masked_last_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings").select("vec_id", points("embedding").alias("p"))
    j = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("p").alias("q")), "vec_id")
    return j.select("vec_id", r6(E.masked_last(F.col("p"), F.col("q"), F.transform("p", lambda x: x["x"] > 0))).alias("fde"))


def number_sql(x: str) -> str:
    return f"(CASE WHEN ({x}) = 0 THEN '0.00' ELSE printf('%.2f', {x}) END)"


def turned_sql(x: str, y: str) -> tuple[str, str]:
    return f"cos(w) * ({x}) + sin(w) * ({y})", f"cos(w) * ({y}) - sin(w) * ({x})"


def scene_sql() -> str:
    fwd, left = turned_sql("r.x - x0", "r.y - y0")
    own, other, step = turned_sql("v0", "l0"), turned_sql("r.v", "r.l"), turned_sql("xs[i] - x0", "ys[i] - y0")
    n = number_sql
    names = ", ".join(f"'{name}'" for name in P.NAMES)
    return HISTORIES + f""",
e AS (SELECT user_id, sample, xs, ys, xs[10] AS x0, ys[10] AS y0, vs[10] AS v0, ls[10] AS l0, cs[10] AS c0, CASE WHEN abs(hs[10]) > 2 * pi() + 1e-3 THEN radians(hs[10]) ELSE hs[10] END AS w FROM h WHERE n = 10),
r AS (SELECT user_id, sample, xs[n] AS x, ys[n] AS y, vs[n] AS v, ls[n] AS l FROM h),
p AS (SELECT e.*, a, r.x AS rx, {fwd} AS fwd, {left} AS lft, {other[0]} AS vx, {other[1]} AS vy FROM e CROSS JOIN (SELECT unnest(range(1, 7)) AS a) k LEFT JOIN r ON r.user_id = e.user_id + a AND r.sample = e.sample),
l AS (SELECT user_id, sample, string_agg([{names}][a] || ': ' || CASE WHEN rx IS NULL THEN 'not seen' WHEN sqrt(fwd * fwd + lft * lft) > 200 THEN 'none within 200 m' ELSE
    {n('abs(fwd)')} || CASE WHEN fwd >= 0 THEN ' m ahead, ' ELSE ' m behind, ' END || {n('abs(lft)')} || CASE WHEN lft >= 0 THEN ' m left, ' ELSE ' m right, ' END || 'moving (' || {n('vx * 3.6::DOUBLE')} || ', ' || {n('vy * 3.6::DOUBLE')} || ') km/h' END,
    chr(10) ORDER BY a) AS lines FROM p GROUP BY ALL)
SELECT user_id, sample, 'The target is on a highway of several lanes, in the lane numbered 1; on which side that lane lies is not known.' || chr(10) || 'target: moving (' || {n(f'({own[0]}) * 3.6::DOUBLE')} || ', ' || {n(f'({own[1]}) * 3.6::DOUBLE')}
  || ') km/h, acceleration ' || {n('c0')} || ' m/s^2' || chr(10) || 'path: ' || array_to_string(list_transform([1, 4, 7, 10], lambda i: '(' || {n(step[0])} || ', ' || {n(step[1])} || ')'), ' ') || chr(10) || lines AS scene
FROM e JOIN l USING (user_id, sample)"""


@query(scene_sql())
def scene_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The description of every sample with ten frames, numbers exact to the last digit."""
    return P.with_scene(good_samples(spark, sf_dir)).select("user_id", "sample", "scene")


@query("""
SELECT conv_id, turn, CASE WHEN trim(text) = '' THEN 'no user text' END AS error,
  CASE WHEN trim(text) <> '' THEN '<s>[INST] <<SYS>>' || chr(10) || 'Speak as ' || role || '.' || chr(10) || '<</SYS>>' || chr(10) || chr(10) || regexp_replace(text, '^\\s+|\\s+$', '', 'g') || ' [/INST]' END AS prompt_text FROM conversations""")
def chat_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = P.chat(F.concat(F.lit("Speak as "), "role", F.lit(".")), F.col("text"))
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", made.alias("c")).select("conv_id", "turn", "c.*")


@query("""
SELECT status, error, count(*) AS n, sum(answers)::BIGINT AS answers, sum(requests)::BIGINT AS requests FROM (
  SELECT CASE WHEN n % 7 = 0 THEN 'api_error' WHEN n % 5 = 0 THEN 'parse_error' ELSE 'ok' END AS status,
    CASE WHEN n % 7 = 0 THEN 'given up after 1 requests: PermissionError' WHEN n % 5 = 0 THEN 'ValueError: a multiple of five' END AS error,
    CASE WHEN n % 7 <> 0 AND n % 5 = 0 THEN 2 ELSE 1 END AS answers, CASE WHEN n % 7 = 0 THEN 1 WHEN n % 5 = 0 THEN 2 ELSE 1 END AS requests FROM (SELECT length(text) AS n FROM conversations)) GROUP BY ALL""")
def audited_completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stub service asked record by record: some lengths of a prompt are refused, others parse only with the reminder, which never helps."""
    c = read(spark, sf_dir, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("sample_id"), F.col("text").alias("prompt_text"))
    reminder = P.reminder_text()

    def request(prompt: str) -> str:
        n = len(prompt.removesuffix(f"\n\n{reminder}"))
        if n % 7 == 0:
            raise PermissionError(n)
        return str(n)

    def parse(raw: str) -> None:
        if int(raw) % 5 == 0:
            raise ValueError("a multiple of five")

    done = runner.completions(c, request, parse, reminder, format_retries=1, api_retries=0)
    requests = F.aggregate("attempts", F.lit(0), lambda s, a: s + a["api_attempts"])
    return done.groupBy("status", "error").agg(F.count("*").alias("n"), F.sum(F.size("attempts")).alias("answers"), F.sum(requests).alias("requests"))


@query("""
WITH e AS (SELECT a.vec_id, a.embedding::DOUBLE[] AS p, b.embedding::DOUBLE[] AS q FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1),
m AS (SELECT vec_id, p, q, list_transform(range(0, 2), lambda k: sqrt((p[32 * k + 31] - q[31]) ** 2 + (p[32 * k + 32] - q[32]) ** 2)) AS d FROM e),
w AS (SELECT *, CASE WHEN d[1] <= d[2] THEN 0 ELSE 1 END AS k FROM m)
SELECT vec_id, k::INTEGER AS assigned, round(list_sum(list_transform(range(1, 33), lambda i: CASE WHEN abs(p[32 * k + i] - q[i]) < 1 THEN 0.5::DOUBLE * (p[32 * k + i] - q[i]) ** 2 ELSE abs(p[32 * k + i] - q[i]) - 0.5::DOUBLE END)), 6) AS regression,
  round(ln(exp(p[1]) + exp(p[2])) - p[k + 1], 6) AS classification, round(-0.5::DOUBLE * list_sum(list_transform(range(1, 33), lambda i: 1 + p[i + 32] - p[i] ** 2 - exp(p[i + 32]))) / 32, 6) AS kl FROM w""")
def loss_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two paths of 16 points in each vector against the first of the next vector."""
    e = read(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("p"))
    j = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), points("p", 16).alias("q")), "vec_id")
    modes = F.array(points("p", 16), points(F.slice("p", 33, 32), 16))
    loss = E.winner_loss(modes, F.slice("p", 1, 2), F.col("q"), F.transform("q", lambda x: F.lit(True)))
    kl = E.kl_loss(F.slice("p", 1, 32), F.slice("p", 33, 32))
    return j.select("vec_id", loss.alias("l"), r6(kl).alias("kl")).select("vec_id", "l.assigned", r6(F.col("l.regression")).alias("regression"), r6(F.col("l.classification")).alias("classification"), "kl")


@query("""
SELECT event_id, CASE event_id % 4 WHEN 0 THEN user_id % 3 WHEN 1 THEN user_id % 3 ELSE 0 END::INTEGER AS status, CASE WHEN event_id % 4 < 2 THEN [[value, 1.0::DOUBLE]] END AS ego,
  CASE WHEN event_id % 4 = 0 THEN ['phys_tl'] ELSE []::VARCHAR[] END AS roles FROM events""")
def lenient_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples in JSON of four makes: plain, wrapped in arrays of one element, with a status that is none, and no JSON at all."""
    v, u = F.col("value").cast("string"), (F.col("user_id") % 3).cast("string")
    plain = F.concat(F.lit('{"lane_status":'), u, F.lit(',"ctx":{"ego":[['), v, F.lit(',1]],"phys_tl":[[1,2]],"phys_tf":[]}}'))
    wrapped = F.concat(F.lit('{"lane_status":[['), u, F.lit(']],"ctx":[{"ego":[[['), v, F.lit(',1]]],"phys_of":"x"}]}'))
    k = F.col("event_id") % 4
    text = F.when(k == 0, plain).when(k == 1, wrapped).when(k == 2, '{"lane_status":"soon","ctx":7}').otherwise("{")
    s = read(spark, sf_dir, "events").select("event_id", S.lenient(text).alias("s"))
    return s.select("event_id", F.coalesce("s.status", F.lit(0)).alias("status"), "s.ego", F.coalesce(F.map_keys("s.neighbors"), F.array().cast("array<string>")).alias("roles"))
