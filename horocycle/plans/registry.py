"""All registered queries of the library and their DuckDB equivalents.

Doubles are rounded to six digits on both sides, and every ranking breaks ties by id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from horocycle.functions import geometry as G
from horocycle.functions import sequences as S
from horocycle.operators import calibration as C
from horocycle.operators import chimera, hplg, knn, novelty, placement, projection, reference, tree
from horocycle.plans import fixtures as X

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def r6(c, name: str | None = None):
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, 6).alias(name) if name else F.round(c, 6)


def _zone_sql(score: str, a: str, f: str) -> str:
    return f"CASE WHEN {score} <= {a} THEN 'accept' WHEN {score} <= {f} THEN 'escalate' ELSE 'fallback' END"


# ---- neighbours and placement


@query(f"WITH {X.KNN} SELECT qid, rk, id, round(dist, 6) AS dist FROM knn")
def knn_top5(spark, sf_dir):
    p = X.points(spark, sf_dir)
    return knn.geodesic_knn(X.queries_of(p), X.prototypes_of(p)).select("qid", "rk", "id", r6("dist", "dist"))


@query(f"WITH {X.KNN} SELECT qid, rk, id, round(dist, 6) AS dist FROM knn WHERE rk <= 2")
def knn_native_top2(spark, sf_dir):
    p = X.points(spark, sf_dir)
    return knn.geodesic_knn_sql(X.queries_of(p), X.prototypes_of(p), k=2).select("qid", "rk", "id", r6("dist", "dist"))


@query(f"WITH {X.KNN} SELECT a.qid, a.id, round(a.dist, 6) AS dist, round(b.dist - a.dist, 6) AS margin FROM knn a JOIN knn b USING (qid) WHERE a.rk = 1 AND b.rk = 2")
def knn_margin(spark, sf_dir):
    p = X.points(spark, sf_dir)
    return knn.margins(knn.geodesic_knn(X.queries_of(p), X.prototypes_of(p), 2)).select("qid", "id", r6("dist", "dist"), r6("margin", "margin"))


@query(f"WITH {X.KNN} SELECT qid, id AS nearest_id, round(dist, 6) AS nearest_distance FROM knn WHERE rk = 1")
def nearest_proto(spark, sf_dir):
    p = X.points(spark, sf_dir)
    return knn.geodesic_knn(X.queries_of(p), X.prototypes_of(p), 1).select("qid", F.col("id").alias("nearest_id"), r6("dist", "nearest_distance"))


def _leaf_prototypes(p: DataFrame) -> DataFrame:
    return X.prototypes_of(p).select("id", F.lit(6).alias("rank"), "embedding", X.lineage().alias("lineage"))


def _placed(spark, sf_dir) -> DataFrame:
    p = X.points(spark, sf_dir)
    return placement.place_flat(X.queries_of(p), _leaf_prototypes(p))


_PLACED = X.KNN + f""", {X.LIMITS}, placed AS (
  SELECT a.qid, a.id AS taxon_id, a.dist AS best_distance, b.dist - a.dist AS margin, {X.radius('q.z')} AS atlas_r, CASE WHEN atan2(q.z[2], q.z[1]) < 0 THEN atan2(q.z[2], q.z[1]) + 2 * pi() ELSE atan2(q.z[2], q.z[1]) END AS atlas_theta
  FROM knn a JOIN knn b ON a.qid = b.qid AND a.rk = 1 AND b.rk = 2 JOIN p q ON q.id = a.qid
), scored AS (SELECT placed.*, best_distance - least(margin, 20) + rho * atlas_r AS score, qa, qf FROM placed JOIN limits ON rank = 6
), zoned AS (SELECT *, {_zone_sql('score', 'qa', 'qf')} AS zone FROM scored)"""


@query(f"WITH {_PLACED} SELECT qid, taxon_id, round(best_distance, 6) AS best_distance, round(margin, 6) AS margin, round(atlas_r, 6) AS atlas_r, round(atlas_theta, 6) AS atlas_theta, round(score, 6) AS score, zone, CASE WHEN score <= qa THEN 1 WHEN score > qf THEN -1 ELSE 3 END AS prediction_set_size FROM zoned")
def placement_flat_zones(spark, sf_dir):
    placed = placement.scored(_placed(spark, sf_dir))
    none = C.no_scores(spark)
    out = C.annotate(placed, C.thresholds_with_defaults(none))
    return out.select("qid", "taxon_id", r6("best_distance", "best_distance"), r6("margin", "margin"), r6("atlas_r", "atlas_r"), r6("atlas_theta", "atlas_theta"), r6("score", "score"), "zone", "prediction_set_size")


@query(
    f"WITH {_PLACED} SELECT count(*) AS total, count(*) FILTER (zone = 'accept') AS n_accept, count(*) FILTER (zone = 'escalate') AS n_escalate, count(*) FILTER (zone = 'fallback') AS n_fallback, "
    "round(avg((zone = 'accept')::INTEGER), 6) AS accept_rate, round(avg(best_distance), 6) AS mean_distance, round(quantile_cont(best_distance, 0.5), 6) AS median_distance, round(avg(margin), 6) AS mean_margin, round(quantile_cont(margin, 0.5), 6) AS median_margin FROM zoned"
)
def placement_summary(spark, sf_dir):
    none = C.no_scores(spark)
    return placement.summary(C.annotate(placement.scored(_placed(spark, sf_dir)), C.thresholds_with_defaults(none)))


def _descent_sql() -> str:
    parts = []
    for r in range(7):
        source = f"(SELECT id AS qid, z FROM p WHERE id % 5 = 0) q JOIN cen c ON c.rank = {r}" if r == 0 else f"b{r - 1} b JOIN p q ON q.id = b.qid JOIN cen c ON c.rank = {r} AND list_contains(c.lineage, b.id)"
        qid = "q.qid" if r == 0 else "b.qid"
        parts.append(f"l{r} AS (SELECT * FROM (SELECT {qid} AS qid, c.id AS id, {X.dist('q.z', 'c.z')} AS dist, row_number() OVER (PARTITION BY {qid} ORDER BY {X.dist('q.z', 'c.z')}, c.id) AS rk FROM {source}) WHERE rk <= 5), b{r} AS (SELECT qid, id FROM l{r} WHERE rk = 1)")
    return X.CENTROIDS + ", " + ", ".join(parts) + ", merged AS (SELECT qid, id, dist, row_number() OVER (PARTITION BY qid ORDER BY dist, id)::INTEGER AS rk FROM (" + " UNION ALL ".join(f"SELECT qid, id, dist FROM l{r}" for r in range(7)) + "))"


@query(f"WITH {_descent_sql()} SELECT qid, rk, id AS taxon_id, round(dist, 6) AS distance FROM merged WHERE rk <= 5")
def placement_hierarchical(spark, sf_dir):
    p = X.points(spark, sf_dir)
    placed = placement.place_hierarchical(X.queries_of(p), X.centroids(p))
    return placed.select("qid", F.explode("candidates").alias("c")).select("qid", "c.rk", "c.taxon_id", r6("c.distance", "distance"))


# ---- geometry


@query(f"WITH {X.P} SELECT id, round({X.radius('z')}, 6) AS r, round(CASE WHEN atan2(z[2], z[1]) < 0 THEN atan2(z[2], z[1]) + 2 * pi() ELSE atan2(z[2], z[1]) END, 6) AS theta, round(sqrt(nz), 6) AS r_euclidean FROM p")
def origin_coordinates(spark, sf_dir):
    c = X.points(spark, sf_dir).select("id", G.coordinate(F.col("embedding")).alias("c"))
    return c.select("id", r6("c.r", "r"), r6("c.theta", "theta"), r6("c.r_euclidean", "r_euclidean"))


@query("SELECT vec_id AS id, round(list_aggregate(list_transform(embedding, lambda x: pow(x::DOUBLE * least(1, (1 / sqrt(1.25::DOUBLE) - 1e-5::DOUBLE) / greatest(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 1e-15::DOUBLE)), 2)), 'sum'), 6) AS norm2, round(embedding[1]::DOUBLE * least(1, (1 / sqrt(1.25::DOUBLE) - 1e-5::DOUBLE) / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]))), 6) AS first FROM embeddings")
def clamp_to_ball(spark, sf_dir):
    z = G.clamp_to_ball(F.col("embedding").cast("array<double>"))
    return X.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), z.alias("z")).select("id", r6(G.norm2(F.col("z")), "norm2"), r6(F.get("z", F.lit(0)), "first"))


def _pair(spark, sf_dir) -> DataFrame:
    p = X.points(spark, sf_dir)
    return p.select("id", F.col("embedding").alias("x")).join(p.select((F.col("id") - 1).alias("id"), F.col("embedding").alias("y")), "id")


_ADD = """pair AS (SELECT a.id, a.z AS u, b.z AS v FROM p a JOIN p b ON b.id = a.id + 1), s AS (
  SELECT *, list_inner_product(u, v) AS uv, list_inner_product(u, u) AS uu, list_inner_product(v, v) AS vv FROM pair), c AS (
  SELECT *, greatest(1 + 2 * 1.25::DOUBLE * uv + 1.5625::DOUBLE * uu * vv, 1e-15::DOUBLE) AS den FROM s), m AS (
  SELECT id, list_transform(list_zip(u, v), lambda t: ((1 + 2 * 1.25::DOUBLE * uv + 1.25::DOUBLE * vv) * t[1] + (1 - 1.25::DOUBLE * uu) * t[2]) / den) AS w FROM c)"""


@query(f"WITH {X.P}, {_ADD} SELECT id, round(w[1], 6) AS first, round(w[64], 6) AS last, round(sqrt(list_inner_product(w, w)), 6) AS norm FROM m")
def mobius_add(spark, sf_dir):
    w = _pair(spark, sf_dir).select("id", G.mobius_addition(F.col("x"), F.col("y")).alias("w"))
    return w.select("id", r6(F.get("w", F.lit(0)), "first"), r6(F.get("w", F.lit(63)), "last"), r6(G.norm(F.col("w")), "norm"))


@query(f"WITH {X.P} SELECT id, round(z[1], 6) AS first, round(sqrt(nz), 6) AS norm, round({X.radius('z')} / 2, 6) AS tangent FROM p")
def log_exp_roundtrip(spark, sf_dir):
    v = X.points(spark, sf_dir).select("id", G.log_map_0(F.col("embedding")).alias("v"))
    back = v.select("id", "v", G.exp_map_0(F.col("v")).alias("z"))
    return back.select("id", r6(F.get("z", F.lit(0)), "first"), r6(G.norm(F.col("z")), "norm"), r6(G.norm(F.col("v")), "tangent"))


@query(f"WITH {X.P} SELECT a.id, round({X.dist('a.z', 'b.z')} / 2, 5) AS to_x, round({X.dist('a.z', 'b.z')} / 2, 5) AS to_y FROM p a JOIN p b ON b.id = a.id + 1")
def geodesic_midpoint(spark, sf_dir):
    m = _pair(spark, sf_dir).withColumn("m", G.geodesic_interpolation(F.col("x"), F.col("y"), F.lit(0.5)))
    return m.select("id", F.round(G.poincare_distance(F.col("x"), F.col("m")), 5).alias("to_x"), F.round(G.poincare_distance(F.col("y"), F.col("m")), 5).alias("to_y"))


_PLANE = [[1.0 if i == k else 0.0 for i in range(64)] for k in (0, 1)]
_CENTROIDS = [(0.5, 30.0), (0.8, 150.0), (1.1, 300.0)]


def _v1_sql() -> str:
    theta = "(atan2(z[2], z[1]) * 180 / pi() - 44.83608873::DOUBLE)"
    wrapped = f"({theta} - 360 * floor({theta} / 360))"
    arc = lambda c: f"least(abs(theta - {c}), 360 - abs(theta - {c}))"
    dr = "least(" + ", ".join(f"abs(r - {c[0]}::DOUBLE)" for c in _CENTROIDS) + ")"
    dt = "least(" + ", ".join(arc(f"{c[1]}::DOUBLE") for c in _CENTROIDS) + ")"
    return f"WITH {X.P}, c AS (SELECT id, 2 / sqrt(1.25::DOUBLE) * atanh(sqrt(1.25::DOUBLE) * sqrt(nz)) AS r, {wrapped} AS theta FROM p) SELECT id, round(r, 6) AS r, round(theta, 6) AS theta, round(greatest(0.01::DOUBLE, 0.1::DOUBLE * {dr} + 0.02::DOUBLE), 6) AS sigma_r, round(greatest(1, 0.5::DOUBLE * {dt} + 2), 6) AS sigma_theta FROM c"


@query(_v1_sql())
def coordinate_v1(spark, sf_dir):
    z = F.col("embedding")
    p = X.points(spark, sf_dir).where(G.valid_v1(z, 64)).select("id", G.radial_v1(z).alias("r"), G.angular_v1(z, _PLANE, [0.0] * 64, 44.83608873).alias("theta"))
    u = p.withColumn("u", G.uncertainty_v1(F.col("r"), F.col("theta"), _CENTROIDS))
    return u.select("id", r6("r", "r"), r6("theta", "theta"), r6("u.sigma_r", "sigma_r"), r6("u.sigma_theta", "sigma_theta"))


@query(f"WITH {X.P} SELECT id, 0.0::DOUBLE AS x, 0.0::DOUBLE AS y, round(1 / sqrt(1 - 1.25::DOUBLE * (z[1] * z[1] + z[2] * z[2])), 6) AS a_re FROM p")
def mobius_translate(spark, sf_dir):
    p = X.points(spark, sf_dir).select("id", F.get("embedding", F.lit(0)).alias("x"), F.get("embedding", F.lit(1)).alias("y"))
    m = p.withColumn("m", G.mobius_translate_to_origin(F.col("x"), F.col("y")))
    m = m.withColumn("m", G.mobius_compose(G.mobius_inverse(G.mobius_rotation(F.lit(0.7))), G.mobius_compose(G.mobius_rotation(F.lit(0.7)), F.col("m"))))
    m = m.withColumn("o", G.mobius_apply(F.col("m"), F.col("x"), F.col("y")))
    return m.select("id", (F.round(F.col("o.x"), 6) + 0.0).alias("x"), (F.round(F.col("o.y"), 6) + 0.0).alias("y"), r6("m.a_re", "a_re"))


# ---- novelty, uncertainty, triage


@query(f"WITH {X.LOO} SELECT round(quantile_cont(dist, 0.99), 6) AS threshold FROM loo WHERE rk = 1")
def loo_nn_threshold(spark, sf_dir):
    return novelty.novelty_threshold(X.points(spark, sf_dir)).select(r6("threshold", "threshold"))


@query(f"WITH {X.LOO_SPLIT}, t AS (SELECT quantile_cont(dist, 0.99) AS threshold FROM loo WHERE rk = 1), q AS (SELECT a.id AS qid, {X.dist('a.z', 'b.z', 'a.nz', 'b.nz')} AS d, b.id FROM p a JOIN p b ON a.id % 5 = 0 AND b.id % 5 <> 0) SELECT qid, arg_min(id, (d, id)) AS nearest_id, round(min(d), 6) AS nearest_distance, min(d) > any_value(threshold) AS is_novel FROM q CROSS JOIN t GROUP BY qid")
def novelty_flags(spark, sf_dir):
    p = X.points(spark, sf_dir)
    protos = X.prototypes_of(p)
    found = novelty.novelty(X.queries_of(p), protos, novelty.novelty_threshold(protos))
    return found.select("qid", "nearest_id", r6("nearest_distance", "nearest_distance"), "is_novel")


@query(f"WITH {X.LOO} SELECT id, round(sigma, 6) AS sigma FROM field")
def sigma_field(spark, sf_dir):
    return novelty.sigma_field(X.points(spark, sf_dir)).select("id", r6("sigma", "sigma"))


@query(f"WITH {X.LOO} SELECT round(avg(sigma), 6) AS mean, round(quantile_disc(sigma, 0.5), 6) AS median, round(stddev_samp(sigma), 6) AS std, round(quantile_cont(sigma, 0.95), 6) AS q95, round(quantile_cont(sigma, 0.99), 6) AS q99, count(*) AS n FROM field")
def field_stats(spark, sf_dir):
    return novelty.field_stats(novelty.sigma_field(X.points(spark, sf_dir)))


_DARK = X.LOO + ", dark AS (SELECT id, sigma, sigma > (SELECT quantile_cont(sigma, 0.95) FROM field) AS is_dark FROM field)"


@query(f"WITH {_DARK} SELECT id, round(sigma, 6) AS sigma, is_dark FROM dark")
def dark_map(spark, sf_dir):
    return novelty.dark_map(novelty.sigma_field(X.points(spark, sf_dir))).select("id", r6("sigma", "sigma"), "is_dark")


@query(f"WITH {_DARK} SELECT count(*) FILTER (is_dark) AS n_dark, count(*) FILTER (NOT is_dark) AS n_charted, round(100.0 * avg(is_dark::INTEGER), 6) AS pct_dark, round(avg(sigma) FILTER (is_dark), 6) AS mean_sigma_dark, round(avg(sigma) FILTER (NOT is_dark), 6) AS mean_sigma_charted, round(max(sigma) FILTER (is_dark), 6) AS max_sigma_dark, round(max(sigma) FILTER (NOT is_dark), 6) AS max_sigma_charted FROM dark")
def dark_summary(spark, sf_dir):
    return novelty.dark_summary(novelty.dark_map(novelty.sigma_field(X.points(spark, sf_dir))))


@query(
    f"WITH {X.LOO_SPLIT}, l AS (SELECT quantile_disc(sigma, 0.5) AS e, quantile_cont(sigma, 0.95) AS t FROM field), q AS (SELECT * FROM (SELECT a.id AS qid, {X.dist('a.z', 'b.z', 'a.nz', 'b.nz')} AS d, row_number() OVER (PARTITION BY a.id ORDER BY {X.dist('a.z', 'b.z', 'a.nz', 'b.nz')}, b.id) AS rk FROM p a JOIN p b ON a.id % 5 = 0 AND b.id % 5 <> 0) WHERE rk <= 5), "
    "s AS (SELECT qid, min(d) AS d, count(*) / sum(1 / greatest(d, 1e-15::DOUBLE)) AS sigma FROM q GROUP BY qid) SELECT CASE WHEN d < e THEN 'redundant' WHEN sigma <= t THEN 'novel_certain' ELSE 'novel_uncertain' END AS category, count(*) AS n FROM s CROSS JOIN l GROUP BY 1"
)
def triage_counts(spark, sf_dir):
    p = X.points(spark, sf_dir)
    protos = X.prototypes_of(p)
    return novelty.triage_counts(novelty.triage(X.queries_of(p), protos, novelty.sigma_field(protos)))


# ---- conformal calibration over events


def _scores(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    e = X.table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("rank"), F.col("value").alias("score"))
    return e.where("event_id % 2 = 1"), e.where("event_id % 2 = 0").select("rank", "score")


_CAL = """cal AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE event_id % 2 = 0), thr AS (
  SELECT event_type, any_value(n) AS n, max(value) FILTER (i = least(ceil((n + 1) * (1 - 0.1::DOUBLE)), n)) AS q_accept, max(value) FILTER (i = least(ceil((n + 1) * (1 - 0.01::DOUBLE)), n)) AS q_fallback FROM cal GROUP BY event_type)"""


@query(f"WITH {_CAL} SELECT event_type, n, round(q_accept, 6) AS q_accept, round(q_fallback, 6) AS q_fallback FROM thr")
def conformal_thresholds_by_type(spark, sf_dir):
    t = C.thresholds(_scores(spark, sf_dir)[1])
    return t.select(F.col("rank").alias("event_type"), "n", r6("q_accept", "q_accept"), r6("q_fallback", "q_fallback"))


@query("SELECT q.event_id, round((SELECT count(*) FROM events c WHERE c.event_id % 2 = 0 AND c.event_type = q.event_type AND c.value >= q.value) / ((SELECT count(*) FROM events c WHERE c.event_id % 2 = 0 AND c.event_type = q.event_type) + 1), 6) AS p_value FROM events q WHERE q.event_id % 2 = 1")
def conformal_pvalues(spark, sf_dir):
    q, cal = _scores(spark, sf_dir)
    return C.p_values(q, cal).select("event_id", r6("confidence", "p_value"))


@query(f"WITH {_CAL} SELECT event_id, {_zone_sql('value', 'q_accept', 'q_fallback')} AS zone, (CASE WHEN value <= q_accept THEN 1 WHEN value > q_fallback THEN -1 WHEN q_fallback - q_accept <= 0 THEN 2 ELSE greatest(2, floor(2 + 8 * (value - q_accept) / (q_fallback - q_accept))) END)::INTEGER AS set_size FROM events JOIN thr USING (event_type) WHERE event_id % 2 = 1")
def prediction_set_size(spark, sf_dir):
    q, cal = _scores(spark, sf_dir)
    out = C.annotate(q, C.thresholds(cal))
    return out.select("event_id", "zone", F.col("prediction_set_size").alias("set_size"))


@query("SELECT l_linenumber AS rank, count(*) AS n, round(quantile_disc(l_extendedprice, 0.5), 6) AS radius FROM lineitem GROUP BY 1")
def rank_radii(spark, sf_dir):
    rows = X.table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("rank"), F.col("l_extendedprice").alias("r"))
    return projection.rank_radii(rows).select("rank", "n", r6("radius", "radius"))


# ---- references, taxonomy, hierarchical classification


@query(f"WITH {X.CENTROIDS} SELECT rank, count(*) AS n FROM cen GROUP BY rank")
def reference_summary(spark, sf_dir):
    return reference.rank_counts(X.centroids(X.points(spark, sf_dir)))


@query(f"WITH {X.CENTROIDS} SELECT id, rank, round(sqrt(list_inner_product(z, z)), 6) AS norm FROM cen WHERE rank = 4 AND list_contains(lineage, 'd__D1')")
def reference_children(spark, sf_dir):
    return reference.children(X.centroids(X.points(spark, sf_dir)), "d__D1", 4).select("id", "rank", r6(G.norm(F.col("embedding")), "norm"))


@query(f"WITH {X.TAXA} SELECT r.rank::INTEGER AS rank, count(taxon_id) AS n FROM (SELECT unnest(range(0, 7)) AS rank) r LEFT JOIN taxa USING (rank) GROUP BY 1")
def taxonomy_rank_sizes(spark, sf_dir):
    return hplg.rank_sizes(X.taxa(X.points(spark, sf_dir)))


_CLOSURE = "clo AS (SELECT DISTINCT l[a] AS ancestor_id, l[b] AS taxon_id, (b - 1)::INTEGER AS rank FROM (SELECT " + X.LINEAGE + " AS l FROM p) CROSS JOIN (SELECT unnest(range(1, 8)) AS a) CROSS JOIN (SELECT unnest(range(1, 8)) AS b) WHERE a < b)"


@query(f"WITH {X.P}, {_CLOSURE} SELECT * FROM clo")
def taxonomy_descendants(spark, sf_dir):
    return hplg.descendants(X.taxa(X.points(spark, sf_dir)))


@query(f"WITH {X.P} SELECT DISTINCT l[r] AS taxon_id, array_to_string(list_slice(l, 1, r), ';') AS lineage FROM (SELECT {X.LINEAGE} AS l FROM p) CROSS JOIN (SELECT unnest(range(1, 8)) AS r)")
def taxonomy_lineages(spark, sf_dir):
    return hplg.lineage_of(X.taxa(X.points(spark, sf_dir))).select("taxon_id", F.array_join("lineage", ";").alias("lineage"))


def _hplg_sql() -> str:
    parts = []
    for r in range(7):
        source = "(SELECT id AS qid, z FROM p WHERE id % 5 = 0) q JOIN cen c ON c.rank = 0" if r == 0 else f"(SELECT qid, taxon_id FROM d{r - 1} WHERE zone = 'accept') b JOIN p ON p.id = b.qid JOIN cen c ON c.rank = {r} AND list_contains(c.lineage, b.taxon_id)"
        qid, z = ("q.qid", "q.z") if r == 0 else ("b.qid", "p.z")
        parts.append(
            f"s{r} AS (SELECT {qid} AS qid, {z} AS z, c.id AS taxon_id, {X.dist(z, 'c.z')} AS d, row_number() OVER (PARTITION BY {qid} ORDER BY {X.dist(z, 'c.z')}, c.id) AS i FROM {source}), "
            f"t{r} AS (SELECT a.qid, a.taxon_id, a.d, coalesce(b.d - a.d, 1.0::DOUBLE) AS m, a.d - coalesce(b.d - a.d, 1.0::DOUBLE) + hrho * {X.radius('a.z')} AS s, ha, hf FROM s{r} a LEFT JOIN s{r} b ON a.qid = b.qid AND b.i = 2 JOIN limits ON limits.rank = {r} WHERE a.i = 1), "
            f"d{r} AS (SELECT qid, {r} AS rank, taxon_id, d, m, s, CASE WHEN s <= ha THEN 'accept' ELSE 'fallback' END AS zone, greatest(0, 1 - s / hf) AS c FROM t{r})"
        )
    return X.CENTROIDS + ", " + X.LIMITS + ", " + ", ".join(parts) + ", dec AS (" + " UNION ALL ".join(f"SELECT * FROM d{r}" for r in range(7)) + ")"


def _decisions(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    p = X.points(spark, sf_dir)
    return X.queries_of(p), hplg.classify(X.queries_of(p), X.centroids(p), X.taxa(p))


@query(f"WITH {_hplg_sql()} SELECT qid, rank, taxon_id, round(d, 6) AS distance, round(m, 6) AS margin, round(s, 6) AS score, zone, round(c, 6) AS confidence FROM dec")
def hplg_frozen(spark, sf_dir):
    return _decisions(spark, sf_dir)[1].select("qid", "rank", "taxon_id", r6("distance", "distance"), r6("margin", "margin"), r6("score", "score"), "zone", r6("confidence", "confidence"))


@query(f"WITH {_hplg_sql()} SELECT rank, count(*) AS n, round(avg((zone = 'accept')::INTEGER), 6) AS accept_rate, round(avg((zone = 'fallback')::INTEGER), 6) AS fallback_rate, 0::BIGINT AS n_llr, round(avg(c), 6) AS mean_confidence FROM dec GROUP BY rank")
def hplg_stats(spark, sf_dir):
    return hplg.stats(_decisions(spark, sf_dir)[1])


@query(f"WITH {_hplg_sql()} SELECT qid, max(rank) FILTER (zone = 'accept') AS final_rank, arg_max(taxon_id, rank) FILTER (zone = 'accept') AS final_taxon, coalesce(string_agg(taxon_id, ';' ORDER BY rank) FILTER (zone = 'accept'), '') AS lineage, count(*) AS n_decisions FROM dec GROUP BY qid")
def hplg_results(spark, sf_dir):
    return hplg.results(*_decisions(spark, sf_dir))


# ---- sequences


@query(f"WITH {X.DNA} SELECT sequence_id, kmer, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY sequence_id), 6) AS freq FROM (SELECT sequence_id, substr(seq, unnest(range(1, length(seq) - 2)), 4) AS kmer FROM dna) GROUP BY sequence_id, kmer")
def kmer_histogram(spark, sf_dir):
    return S.kmer_histogram(X.dna(spark, sf_dir)).select("sequence_id", "kmer", "n", r6("freq", "freq"))


@query(f"WITH {X.DNA}, k AS (SELECT substr(seq, unnest(range(1, length(seq) - 2)), 4) AS kmer FROM dna) SELECT kmer, (64 * (strpos('ACGT', kmer[1]) - 1) + 16 * (strpos('ACGT', kmer[2]) - 1) + 4 * (strpos('ACGT', kmer[3]) - 1) + strpos('ACGT', kmer[4]) - 1)::INTEGER AS idx, count(*) AS n FROM k GROUP BY kmer ORDER BY n DESC, kmer LIMIT 20")
def kmer_topk(spark, sf_dir):
    rows = X.dna(spark, sf_dir).select(F.explode(S.kmers(F.col("sequence"))).alias("kmer")).groupBy("kmer").agg(F.count("*").alias("n"))
    return rows.select("kmer", S.kmer_index(F.col("kmer")).cast("int").alias("idx"), "n").orderBy(F.desc("n"), "kmer").limit(20)


@query(
    f"WITH {X.DNA}, w AS (SELECT sequence_id, seq, CASE WHEN length(seq) >= 1000 THEN list_distinct(list_concat(range(1, length(seq) - 998, 500), [length(seq) - 999])) WHEN length(seq) >= 200 THEN [1::BIGINT] ELSE [] END AS s FROM dna) "
    "SELECT sequence_id, len(s)::INTEGER AS n_windows, list_sum(list_transform(s, lambda i: least(1000, length(seq) - i + 1)))::BIGINT AS n_bases, md5(array_to_string(list_transform(list_sort(s), lambda i: substr(seq, i, 1000)), ',')) AS digest FROM w WHERE len(s) > 0"
)
def sequence_windows(spark, sf_dir):
    w = X.dna(spark, sf_dir).select("sequence_id", S.windows(F.col("sequence")).alias("w")).where("size(w) > 0")
    total = F.aggregate("w", F.lit(0).cast("long"), lambda s, x: s + F.length(x))
    return w.select("sequence_id", F.size("w").alias("n_windows"), total.alias("n_bases"), F.md5(F.array_join("w", ",")).alias("digest"))


@query("SELECT p_partkey, replace(trim(coalesce(nullif(p_name, ''), 'UNK')), ' ', '_') AS label FROM part")
def label_clean(spark, sf_dir):
    return X.table(spark, sf_dir, "part").select("p_partkey", S.clean_label(F.col("p_name")).alias("label"))


@query("SELECT DISTINCT r_name AS domain, 'd__' || replace(trim(r_name), ' ', '_') || ';p__' || replace(trim(r_name), ' ', '_') || '|' || replace(trim(n_name), ' ', '_') AS lineage, 1 AS rank FROM nation JOIN region ON n_regionkey = r_regionkey")
def lineage_from_labels(spark, sf_dir):
    n = X.table(spark, sf_dir, "nation").join(X.table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    text = F.array_join(F.slice(S.lineage([F.col("r_name"), F.col("n_name"), *([F.lit("x")] * 5)]), 1, 2), ";")
    return n.select(F.col("r_name").alias("domain"), text.alias("lineage")).distinct().withColumn("rank", S.rank_from_lineage(F.col("lineage")))


# ---- curvature


_HIST = "h AS (SELECT i::INTEGER AS step, 1 + 0.2475::DOUBLE * least(1, i / 80.0::DOUBLE) AS kappa FROM range(0, 200) t(i)), g AS (SELECT *, least(1, greatest(0, (kappa - 1) / (1.2475::DOUBLE - 1))) AS progress FROM h), ph AS (SELECT *, CASE WHEN progress < 0.05::DOUBLE THEN 'functional' WHEN progress > 0.95::DOUBLE THEN 'phylogenetic' ELSE 'transition' END AS phase FROM g)"


@query(f"WITH {_HIST}, c AS (SELECT *, sum((phase <> coalesce(lag(phase) OVER (ORDER BY step), 'functional'))::INTEGER) OVER (ORDER BY step) AS island FROM (SELECT * FROM ph)) SELECT step, phase, (row_number() OVER (PARTITION BY island ORDER BY step) - CASE WHEN island = 0 THEN 0 ELSE 1 END)::INTEGER AS steps_in_phase FROM (SELECT step, phase, sum(ch) OVER (ORDER BY step) AS island FROM (SELECT step, phase, (phase <> coalesce(lag(phase) OVER (ORDER BY step), 'functional'))::INTEGER AS ch FROM ph))")
def kappa_phase_islands(spark, sf_dir):
    return hplg.curvature_states(X.history(spark)).select("step", "phase", F.col("steps_in_phase").cast("int").alias("steps_in_phase"))


_SQL["kappa_phase_islands"] = f"WITH {_HIST} SELECT step, phase, (row_number() OVER (PARTITION BY island ORDER BY step) - CASE WHEN island = 0 THEN 0 ELSE 1 END)::INTEGER AS steps_in_phase FROM (SELECT step, phase, sum(ch) OVER (ORDER BY step) AS island FROM (SELECT step, phase, (phase <> coalesce(lag(phase) OVER (ORDER BY step), 'functional'))::INTEGER AS ch FROM ph))"


@query(f"WITH {_HIST}, w AS (SELECT step, stddev_pop(kappa) OVER (ORDER BY step ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS s, progress, phase FROM ph), v AS (SELECT *, CASE WHEN step < 49 THEN step < 9 ELSE s < 0.005::DOUBLE END AS is_stable FROM w) SELECT step, is_stable, round(1 + 0.5::DOUBLE * (1 - abs(2 * progress - 1)), 6) AS threshold_scale, CASE WHEN phase = 'transition' AND NOT is_stable THEN 0.5 ELSE 1.0 END::DOUBLE AS momentum_scale FROM v")
def kappa_rolling_std(spark, sf_dir):
    return hplg.curvature_states(X.history(spark)).select("step", "is_stable", r6("threshold_scale", "threshold_scale"), "momentum_scale")


# ---- trees and projection


def _ids_and_points(spark, sf_dir) -> DataFrame:
    return X.points(spark, sf_dir).select("id", "embedding")


_DM = f"dm AS (SELECT {X.dist('a.z', 'b.z', 'a.nz', 'b.nz')} AS dist FROM p a JOIN p b ON a.id < b.id)"
_SIX = ", ".join(f"{X.dist(f'{x}.z', f'{y}.z', f'{x}.nz', f'{y}.nz')} AS {x}{y}" for x, y in ("ab", "ac", "ad", "bc", "bd", "cd"))
_QUARTET = X.P + f""", {X.QUARTETS}, six AS (
  SELECT a.id AS a, b.id AS b, c.id AS c, d.id AS d, {_SIX} FROM quartets q JOIN p a ON a.id = q.a JOIN p b ON b.id = q.b JOIN p c ON c.id = q.c JOIN p d ON d.id = q.d
), q3 AS (SELECT a, b, c, d, ab + cd AS s0, ac + bd AS s1, ad + bc AS s2 FROM six
), qt AS (SELECT a, b, c, d, CASE WHEN s0 <= s1 AND s0 <= s2 THEN 0 WHEN s1 <= s2 THEN 1 ELSE 2 END AS topology, (list_sort([s0, s1, s2])[3] - list_sort([s0, s1, s2])[2]) / 2 AS delta FROM q3)"""


@query(f"WITH {X.P}, {_DM} SELECT count(*) AS n_pairs, round(avg(dist), 6) AS mean_distance, round(stddev_samp(dist), 6) AS std_distance FROM dm")
def distance_matrix_stats(spark, sf_dir):
    d = knn.distance_stats(_ids_and_points(spark, sf_dir))
    return d.select("n_pairs", r6("mean_distance", "mean_distance"), r6("std_distance", "std_distance"))


def _drawn_quartets(spark, sf_dir) -> DataFrame:
    p = _ids_and_points(spark, sf_dir)
    return tree.quartets_of(tree.hashed_quartets(p.select("id"), tree.QUARTETS), p)


@query(f"WITH {_QUARTET} SELECT a, b, c, d, topology, round(delta, 6) AS delta FROM qt")
def quartet_delta_all(spark, sf_dir):
    """Quartets drawn from all points."""
    return _drawn_quartets(spark, sf_dir).select("a", "b", "c", "d", F.col("quartet.topology").alias("topology"), r6("quartet.delta", "delta"))


@query(f"WITH {_QUARTET} SELECT topology, count(*) AS n, round(avg(delta), 6) AS mean_delta, round(max(delta), 6) AS max_delta FROM qt GROUP BY topology")
def quartet_topology_counts(spark, sf_dir):
    q = _drawn_quartets(spark, sf_dir).select("quartet.*")
    return q.groupBy("topology").agg(F.count("*").alias("n"), r6(F.avg("delta"), "mean_delta"), r6(F.max("delta"), "max_delta"))


@query(f"WITH {_QUARTET} SELECT count(*) AS n_quartets, round(avg(delta), 6) AS mean_delta, round(max(delta), 6) AS max_delta FROM qt")
def delta_hyperbolicity(spark, sf_dir):
    d = tree.delta(_ids_and_points(spark, sf_dir))
    return d.select("n_quartets", r6("mean_delta", "mean_delta"), r6("max_delta", "max_delta"))


def _forest(spark, sf_dir) -> DataFrame:
    """One tree per label, of all its points."""
    order = Window.partitionBy("label").orderBy("id")
    p = X.points(spark, sf_dir).withColumn("ordinal", F.row_number().over(order))
    return p.select(F.col("label").alias("tree_id"), "ordinal", F.concat(F.lit("t"), F.col("id")).alias("taxon_id"), "embedding")


@query(f"WITH {X.P}, n AS (SELECT label, count(*) AS n FROM p GROUP BY label) SELECT label AS tree_id, n AS n_leaves, n - 2 AS n_internal, 2 * n - 3 AS n_edges FROM n")
def nj_tree_statistics(spark, sf_dir):
    pts = _forest(spark, sf_dir)
    return tree.branch_statistics(tree.branches(pts)).select("tree_id", "n_leaves", "n_internal", "n_edges")


@query()
def nj_edges(spark, sf_dir):
    return tree.edges(_forest(spark, sf_dir)).withColumn("length", r6("length"))


@query()
def nj_quartet_consistency(spark, sf_dir):
    """One tree of all points, held against quartets drawn from all of them."""
    p = _ids_and_points(spark, sf_dir).select(F.format_string("t%09d", "id").alias("id"), "embedding")
    pts = p.select(F.lit(0).alias("tree_id"), F.col("id").alias("ordinal"), F.col("id").alias("taxon_id"), "embedding")
    quartets = tree.hashed_quartets(p.select("id"), tree.QUARTETS)
    on_tree = tree.quartets_on(tree.branches(pts), quartets.withColumn("tree_id", F.lit(0)))
    return tree.agreement(tree.quartets_of(quartets, p), on_tree)


@query(
    "WITH RECURSIVE e(s, t, w) AS (VALUES (0, 3, 1.0::DOUBLE), (1, 3, 2.0::DOUBLE), (2, 3, 3.0::DOUBLE)), u AS (SELECT s, t, w FROM e UNION ALL SELECT t, s, w FROM e), "
    "walk(a, x, prev, d) AS (SELECT s, t, s, w FROM u UNION ALL SELECT walk.a, u.t, walk.x, walk.d + u.w FROM walk JOIN u ON u.s = walk.x AND u.t <> walk.prev) "
    "SELECT chr(65 + a) AS a, chr(65 + x) AS b, d AS dist FROM walk WHERE a < x AND x < 3"
)
def patristic_star(spark, sf_dir):
    n = spark.createDataFrame([(0, 0, "A"), (0, 1, "B"), (0, 2, "C"), (0, 3, None)], "tree_id int, node_id int, taxon_id string")
    e = spark.createDataFrame([(0, 0, 3, 1.0), (0, 1, 3, 2.0), (0, 2, 3, 3.0)], "tree_id int, source int, target int, length double")
    return tree.patristic(n, e).select("a", "b", "dist")


@query(f"WITH {X.P}, c AS (SELECT id, label, nz AS r0, sqrt(z[1] * z[1] + z[2] * z[2]) AS r2 FROM p), m AS (SELECT *, max(r2) OVER (PARTITION BY label ORDER BY r0, id) AS top FROM c) SELECT id, round(CASE WHEN r2 <= 1e-10::DOUBLE THEN r2 ELSE r2 * least(2, greatest(0.5::DOUBLE, top / r2)) END, 6) AS radius FROM m")
def radial_cummax(spark, sf_dir):
    p = X.points(spark, sf_dir).select("id", F.col("label").alias("tree_id"), G.norm2(F.col("embedding")).alias("r0"), F.slice("embedding", 1, 2).alias("coords"))
    return projection.monotone_radii(p).select("id", r6(G.norm(F.col("coords")), "radius"))


@query(f"WITH {X.P}, v AS (SELECT id, (label % 7)::INTEGER AS rank, {X.radius('z')} AS dist FROM p) SELECT id, rank, round(dist, 6) AS dist FROM v ORDER BY (6 - rank) * 10 - dist DESC, id LIMIT 50")
def visible_topn(spark, sf_dir):
    p = X.points(spark, sf_dir).select("id", (F.col("label") % 7).cast("int").alias("rank"), G.dist_from_origin(F.col("embedding")).alias("dist"), F.col("id").alias("ordinal"))
    return projection.visible(p, 50).select("id", "rank", r6("dist", "dist"))


@query()
def tangent_pca(spark, sf_dir):
    p = X.points(spark, sf_dir)
    return projection.project(p, projection.fit_pca(p, 2)).select("id", r6(F.get("coords", F.lit(0)), "pc1"), r6(F.get("coords", F.lit(1)), "pc2"))


@query()
def karcher_by_family(spark, sf_dir):
    p = X.points(spark, sf_dir).select(F.concat(F.lit("f__F"), F.col("label")).alias("taxon_id"), "embedding")
    m = reference.karcher_means(p, "taxon_id")
    return m.select("taxon_id", "n", r6("variance", "variance"), r6(G.norm(F.col("embedding")), "norm"))


@query()
def reference_rollup(spark, sf_dir):
    p = X.points(spark, sf_dir)
    leaves = p.select(F.get(X.lineage(), F.lit(6)).alias("taxon_id"), "embedding", X.lineage().alias("lineage"), F.col("id").alias("ordinal"))
    return reference.from_lineages(leaves).select("taxon_id", "rank", "observation_count", r6(G.norm(F.col("embedding")), "norm"))


@query()
def chimera_scores(spark, sf_dir):
    p = X.points(spark, sf_dir).select(F.floor(F.col("id") / 10).alias("sequence_id"), (F.col("id") % 10).alias("window_idx"), "embedding")
    s = chimera.chimera_scores(p)
    return s.select("sequence_id", "n_windows", r6("score", "score"), r6("variance", "variance"), r6("separation", "separation"), r6("balance", "balance"), "is_chimera", "breakpoint_idx")


@query()
def chimera_pipeline(spark, sf_dir):
    """Windows of sequences, encoded by k-mers and scored."""
    w = X.dna(spark, sf_dir).select("sequence_id", F.posexplode(S.windows(F.col("sequence"))).alias("window_idx", "sequence"))
    return chimera.chimera_scores(S.encoded(w, keep=False)).select("sequence_id", "n_windows", r6("score", "score"), "is_chimera")


@query()
def kmer_embeddings(spark, sf_dir):
    e = S.encoded(X.dna(spark, sf_dir))
    return e.select("sequence_id", r6(G.norm(F.col("embedding")), "norm"), r6(F.get("embedding", F.lit(0)), "first"))


@query()
def greedy_tokens(spark, sf_dir):
    v = S.Vocabulary(["[PAD]", "[UNK]", "A", "C", "G", "T", "AC", "GT", "ACG", "TTT", "ACGT"])
    t = S.tokens(X.dna(spark, sf_dir), v)
    return t.select("sequence_id", F.array_join("tokens", " ").alias("tokens"))


@query()
def proto_ema(spark, sf_dir):
    p = X.points(spark, sf_dir).select(F.concat(F.lit("f__F"), F.col("label")).alias("taxon_id"), F.lit(4).alias("rank"), "embedding", F.col("id").alias("ordinal"))
    bank = hplg.freeze(hplg.bank_from(p.where("ordinal % 2 = 0")))
    out = hplg.reanchor(hplg.ema_update(bank, p.where("ordinal % 2 = 1")))
    return hplg.reliable(out).select("taxon_id", "observation_count", r6(G.norm(F.col("student")), "norm"), "reliable")


@query()
def hplg_online(spark, sf_dir):
    p = X.points(spark, sf_dir)
    q = X.queries_of(p).withColumn("stream", F.lit(0)).withColumn("ordinal", F.col("qid"))
    return hplg.classify_online(q, X.centroids(p), X.taxa(p)).select("qid", "rank", "taxon_id", r6("score", "score"), "zone")


@query()
def geodesic_arcs(spark, sf_dir):
    return projection.arcs(_pair(spark, sf_dir), 10).select("id", "step", r6(G.norm(F.col("point")), "norm"))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


