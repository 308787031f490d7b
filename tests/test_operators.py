"""Operators on small cases with known answers."""

import json
import math
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from horocycle.functions import numeric as N
from horocycle.functions import sequences as S
from horocycle.functions.constants import RANKS, rank_of, ranks_table
from horocycle.operators import calibration as C
from horocycle.operators import chimera, hplg, knn, novelty, placement, projection, reference, tree


def ball(n, dim=8, seed=1, scale=0.5):
    rng = np.random.default_rng(seed)
    return N.clamp(rng.standard_normal((n, dim)) * scale / math.sqrt(dim))


@pytest.fixture(scope="module")
def prototypes(spark):
    return spark.createDataFrame([(i, z.tolist()) for i, z in enumerate(ball(30))], "id long, embedding array<double>")


def pairs(df):
    return sorted((r.qid, r.rk, r.id, round(r.dist, 9)) for r in df.collect())


def test_neighbours_equal_the_native_join(prototypes, monkeypatch):
    q = prototypes.select((F.col("id")).alias("qid"), "embedding")
    for others in (False, True):
        want = pairs(knn.geodesic_knn_sql(q, prototypes, 5, others=others))
        assert pairs(knn.geodesic_knn(q, prototypes, 5, others=others)) == want
    monkeypatch.setattr(knn, "BLOCK_VALUES", 40)  # several blocks
    assert pairs(knn.geodesic_knn(q, prototypes, 5, others=True)) == want


@pytest.mark.parametrize("rows, columns", [(1, 1), (3, 5), (7, 11), (16, 64), (5, 13)])
def test_places_of_bounds_within_their_limits(rows, columns):
    rng = np.random.default_rng(rows)
    hits = knn._Hits(16 * 64)
    for share in (0.0, 0.02, 0.5, 1.0):  # the room is used again: nothing of a fuller block may stay
        left, right = rng.normal(size=(rows, 4)).astype(np.float32), rng.normal(size=(4, columns)).astype(np.float32)
        low = hits.bounds(left, right)
        assert np.allclose(low, left @ right, atol=1e-5)
        limit = np.quantile(low, share, axis=1).astype(np.float32)
        assert hits.places(low, limit).tolist() == np.flatnonzero(low <= limit[:, None]).tolist()
        assert len(hits.places(low, np.full(rows, np.inf, np.float32))) == low.size and not len(hits.places(low, np.full(rows, -np.inf, np.float32)))


@pytest.mark.parametrize("k", [1, 5, 40])
def test_screened_neighbours_equal_brute_force(k):
    """Copies, points next to the rim and rows that are their own neighbours, over more columns than are held at once."""
    p = ball(3000, seed=4)
    p[500:900] = p[3]
    p[7] *= 0.89442 / np.linalg.norm(p[7])
    q = np.concatenate([p[:20], p[850:860], ball(70, seed=5), p[7:8] * 0.99999])
    own = np.concatenate([np.arange(20), np.arange(850, 860), np.full(71, -1)])
    for mine in (None, own):
        want, got = knn._every(q, p, k, 1.25, mine), knn.nearest(q, p, k, 1.25, mine)
        assert (want[0] == got[0]).all() and (want[1] == got[1]).all()


def test_neighbours_over_many_columns_and_tasks(spark, monkeypatch):
    monkeypatch.setattr(knn, "_COLUMNS", 64)
    monkeypatch.setattr(knn, "_FEW", 10)
    z = ball(700, seed=7)
    p = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(z)], "id long, embedding array<double>").coalesce(1)
    q = p.select(F.col("id").alias("qid"), "embedding")
    place, dist = knn._every(z, z, 3, 1.25, np.arange(700))
    want = sorted((i, k + 1, int(place[i, k]), round(dist[i, k], 9)) for i in range(700) for k in range(3))
    assert pairs(knn.geodesic_knn(q, p, 3, others=True)) == want
    monkeypatch.setattr(knn, "TASK_PAIRS", 10_000)
    found = knn.geodesic_knn(q, p, 3, others=True)
    assert pairs(found) == want and found.rdd.getNumPartitions() >= 49  # one task for each input file before


@pytest.mark.parametrize("rim", [False, True])
def test_blocks_that_meet_once_find_the_neighbours_of_both_sides(rim):
    """Within first limits; with copies on both sides, and next to the rim, where the bounds do not hold."""
    z = ball(4000, seed=11)
    z[100:400], z[2500:2800] = z[3], z[3]
    if rim:
        z[[7, 2007]] *= 0.8944271 / np.linalg.norm(z[[7, 2007]], axis=1, keepdims=True)
    a, b = (knn.Block(pa.array(np.arange(lo, lo + n)), pa.array(z[lo : lo + n].tolist())) for lo, n in ((0, 1300), (1300, 2700)))
    for k in (1, 4):
        want = knn._every(a.points, b.points, k, 1.25), knn._every(b.points, a.points, k, 1.25)
        for wide in (1.0, 1.3, np.inf):
            most = [np.maximum(d[:, -1] * wide, d[:, -1]) for _, d in want]
            most[0][5] = want[0][1][5, 0] / 2  # none within
            got = knn.mutual(a, b, k, 1.25, *most)
            for (place, dist), (p, d), limit in zip(want, got, most, strict=True):
                kept = dist <= limit[:, None]
                assert (p[kept] == place[kept]).all() and (d[kept] == dist[kept]).all() and kept.mean() > 0.99
                assert (d[~kept] >= dist[~kept]).all()


@pytest.mark.parametrize("kind", ["int", "string"])
def test_points_among_each_other_meet_once(spark, monkeypatch, kind):
    z = ball(6000, dim=4, seed=12)
    z[50:250] = z[1]
    name = str if kind == "string" else int
    names = np.array(sorted(map(name, range(6000))))
    p = spark.createDataFrame([(name(x), v.tolist()) for x, v in zip(names, z, strict=True)] + [(name(9999), None)], f"id {kind}, embedding array<double>")
    monkeypatch.setattr(knn, "BLOCK_VALUES", 20_000)
    found = knn.geodesic_others(p, 3)
    place, dist = (np.concatenate(x) for x in zip(*(knn._every(z[lo : lo + 500], z, 3, 1.25, np.arange(lo, lo + 500)) for lo in range(0, 6000, 500)), strict=True))
    want = sorted((name(names[i]), k + 1, name(names[place[i, k]]), round(dist[i, k], 9)) for i in range(6000) for k in range(3))
    assert pairs(found) == want and dict(found.dtypes)["qid"] == kind
    limits = knn._limited(p.withColumnRenamed("id", "qid"), p, 6000, 24_000, 3, 1.25, True).collect()
    most = {r.qid: r.most for r in limits}
    assert len(most) == 6000 and all(dist[i, 2] <= most[name(names[i])] < math.inf for i in range(6000))
    q = p.withColumnRenamed("id", "qid").where("qid < 200")
    assert pairs(knn.geodesic_knn(q, p, 3, others=True)) == [x for x in want if int(x[0]) < 200]


def test_blocks_of_queries_and_prototypes_are_bounded(spark, monkeypatch):
    """Each call holds a part of the queries and less than a block of prototypes; every query meets every prototype once."""
    p = spark.createDataFrame([(i, z.tolist()) for i, z in enumerate(ball(3000, dim=4))], "id long, embedding array<double>")
    q = p.withColumnRenamed("id", "qid")
    monkeypatch.setattr(knn, "BLOCK_VALUES", 6000)
    monkeypatch.setattr(knn, "_ROWS", 500)
    found = knn.by_blocks(q, p, lambda block, qid, z: [pa.RecordBatch.from_arrays([pa.array([len(qid)]), pa.array([len(block.keys)])], names=["q", "p"])], {"q": "bigint", "p": "bigint"})
    calls = found[0].collect()
    assert found[1] and len(calls) == 24 and max(r.q for r in calls) < 1000 and max(r.p for r in calls) * 4 < 6000
    assert sum(r.q * r.p for r in calls) == 9_000_000


def test_threshold_over_several_blocks(spark, monkeypatch):
    z = ball(5000, dim=4, seed=13)
    p = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(z)], "id long, embedding array<double>")
    monkeypatch.setattr(knn, "BLOCK_VALUES", 16_000)
    asked = []
    monkeypatch.setattr(novelty, "geodesic_others", lambda *x, of=novelty.geodesic_others: asked.append(x[1]) or of(*x))
    nearest = np.concatenate([knn._every(z[lo : lo + 500], z, 1, 1.25, np.arange(lo, lo + 500))[1][:, 0] for lo in range(0, 5000, 500)])
    assert novelty.novelty_threshold(p).first().threshold == pytest.approx(np.quantile(nearest, 0.99), abs=1e-9) and asked == [1]


def test_first_limits_are_found_once(spark, monkeypatch):
    """Sizes are those of the rows as given: counting rows with limits would search for these a second time."""
    p = spark.createDataFrame([(i, z.tolist()) for i, z in enumerate(ball(2000, dim=4, seed=14))] + [(2000, None)], "id long, embedding array<double>")
    q = p.withColumnRenamed("id", "qid").where("qid % 5 = 0")
    monkeypatch.setattr(knn, "BLOCK_VALUES", 4000)
    counted = []
    monkeypatch.setattr(type(p), "count", lambda self, of=type(p).count: counted.append(self.columns) or of(self))
    monkeypatch.setattr(type(p), "agg", lambda self, *x, of=type(p).agg: counted.append(self.columns) or of(self, *x))
    found = knn.geodesic_knn(q, p, 2, others=True)
    assert counted and not any("most" in x for x in counted)
    monkeypatch.undo()
    assert pairs(found) == pairs(knn.geodesic_knn(q, p, 2, others=True))


def test_blocks_of_wide_queries_are_bounded(spark, monkeypatch):
    """A block of queries is bounded by its doubles, as one of prototypes is, not by its rows."""
    p = spark.createDataFrame([(i, z.tolist()) for i, z in enumerate(ball(2000, dim=16))], "id long, embedding array<double>")
    q = p.withColumnRenamed("id", "qid")
    monkeypatch.setattr(knn, "BLOCK_VALUES", 6000)
    monkeypatch.setattr(knn, "CORE_TASKS", 1)
    found = knn.by_blocks(q, p, lambda block, qid, z: [pa.RecordBatch.from_arrays([pa.array([len(qid)]), pa.array([len(block.keys)])], names=["q", "p"])], {"q": "bigint", "p": "bigint"})
    calls = found[0].collect()
    assert max(r.q for r in calls) * 16 < 1.5 * 6000 and max(r.p for r in calls) * 16 < 6000 and sum(r.q * r.p for r in calls) == 4_000_000


def test_ranks_and_no_scores_start_no_python(spark):
    t = C.thresholds_with_defaults(C.no_scores(spark))
    plan = t._jdf.queryExecution().executedPlan().toString()
    assert "ExistingRDD" not in plan and "Exchange" not in plan
    assert [tuple(r) for r in ranks_table(spark).orderBy("rank").collect()] == [tuple(r) for r in RANKS]
    assert dict(ranks_table(spark).dtypes) == {x: {int: "int", float: "double", str: "string"}[type(v)] for x, v in RANKS[0]._asdict().items()}
    assert C.no_scores(spark).dtypes == [("rank", "int"), ("score", "double")] and {r.n for r in t.collect()} == {0}


def test_points_are_dealt_to_no_more_blocks_than_tasks_ask_for(spark, monkeypatch):
    """Each block is a copy of every point: tasks that are even and of bounded blocks, but no more."""
    p = spark.createDataFrame([(i, z.tolist()) for i, z in enumerate(ball(5000, dim=4, seed=13))], "id long, embedding array<double>")
    monkeypatch.setattr(knn, "BLOCK_VALUES", 16_000)
    want = pairs(knn.geodesic_others(p, 1))
    for part, blocks in ((1, 4), (20, 6)):
        monkeypatch.setattr(knn, "TASK_PAIRS", 5000 * 5000 // 2 // part)
        found = knn.geodesic_others(p, 1)
        assert f"pmod(xxhash64(qid, 42), {blocks})" in re.sub(r"#\d+L?|cast\((\w+) as bigint\)", r"\1", found._jdf.queryExecution().analyzed().toString()) and pairs(found) == want


def test_exact_distances_hold_few_doubles_at_once():
    z = ball(2000, dim=256, seed=15)
    q, screen = z[:1000], knn.Screen(z, 1.25)
    row, place = np.repeat(np.arange(1000), 40), np.tile(np.arange(2000), 20)
    tracemalloc.start()
    d, _ = knn._exactly(q, (q * q).sum(1), z, screen, row, place, 1.25)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16e6 and d[::997] == pytest.approx([knn._every(q[i : i + 1], z[j : j + 1], 1, 1.25)[1][0, 0] for i, j in zip(row[::997], place[::997], strict=True)], abs=1e-9)


def test_many_pairs_leave_the_join(spark, prototypes, monkeypatch):
    q = prototypes.select(F.col("id").alias("qid"), "embedding")
    want = pairs(knn.geodesic_knn_sql(q, prototypes, 2))
    monkeypatch.setattr(knn, "SQL_PAIRS", 100)
    found = knn.geodesic_knn_sql(q, prototypes, 2)
    assert pairs(found) == want and "Cartesian" not in found._jdf.queryExecution().toString() and "NestedLoop" not in found._jdf.queryExecution().toString()


def test_distances_of_all_pairs_by_blocks(spark, prototypes, monkeypatch):
    z = ball(30)
    want = {(i, j): float(N.distance(z[i], z[j])) for i in range(30) for j in range(i + 1, 30)}
    x = np.array(list(want.values()))
    for values in (knn.BLOCK_VALUES, 40):
        monkeypatch.setattr(knn, "BLOCK_VALUES", values)
        got = {(r.i, r.j): r.dist for r in knn.distance_matrix(prototypes).collect()}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
        stats = knn.distance_stats(prototypes)
        s = stats.first()
        assert s.n_pairs == 435 and s.mean_distance == pytest.approx(x.mean()) and s.std_distance == pytest.approx(x.std(ddof=1))
        assert "NestedLoop" not in stats._jdf.queryExecution().toString()
    few = [knn.distance_stats(prototypes.limit(n)).first() for n in (0, 1, 2)]
    assert [s.n_pairs for s in few] == [0, 0, 1] and few[1].mean_distance is None and few[2].std_distance is None


def test_own_nearest_many_k_and_empty(prototypes):
    q = prototypes.select(F.col("id").alias("qid"), "embedding")
    found = knn.geodesic_knn(q, prototypes, 100).collect()
    assert len(found) == 900 and all(r.dist < 0.01 for r in found if r.rk == 1 and r.qid == r.id)
    assert knn.geodesic_knn(q, prototypes.limit(0), 3).count() == 0
    lone = knn.margins(knn.geodesic_knn(q, prototypes.limit(1), 2)).collect()
    assert all(r.margin == math.inf for r in lone)


def test_ties_go_to_the_smaller_id(spark):
    p = spark.createDataFrame([(i, [0.1, 0.0]) for i in range(50)], "id long, embedding array<double>")
    q = spark.createDataFrame([(0, [0.2, 0.0])], "qid long, embedding array<double>")
    assert [r.id for r in knn.geodesic_knn(q, p, 3).orderBy("rk").collect()] == [0, 1, 2]


@pytest.mark.parametrize("k", [1, 3, 40])
def test_descent_equals_the_joins(spark, k):
    rng = np.random.default_rng(6)
    z, rows = ball(60, seed=9), []
    for i in range(60):
        lineage = [f"d{i % 2}", f"p{i % 6}", f"s{i}"]
        rank = 0 if i < 2 else 1 if i < 8 else 2
        rows.append((lineage[rank] if rank else f"d{i}", rank, z[i].tolist(), lineage[: rank + 1] if i % 7 else [f"d{i % 2}", "p9", f"s{i}"][: rank + 1]))
    protos = spark.createDataFrame(rows, "id string, rank int, embedding array<double>, lineage array<string>")
    q = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rng.normal(0, 0.2, (25, 8)))], "qid long, embedding array<double>")
    flat = lambda df: sorted((r.qid, c.rk, c.taxon_id, c.distance) for r in df.collect() for c in r.candidates)
    assert flat(placement.place_hierarchical(q, protos, k)) == flat(placement._by_joins(q, protos, k, 1.25))


def test_placement_without_prototypes(spark, prototypes):
    q = prototypes.select(F.col("id").alias("qid"), "embedding").limit(3)
    none = spark.createDataFrame([], "id string, rank int, embedding array<double>, lineage array<string>")
    rows = placement.place_flat(q, none).collect()
    assert len(rows) == 3 and all(r.best_distance == math.inf and r.candidates is None for r in rows)
    scores = spark.createDataFrame([], "rank int, score double")
    assert {(r.zone, r.confidence, r.prediction_set_size) for r in placement.calibrated(placement.place_flat(q, none), scores).collect()} == {("fallback", 0.0, -1)}


def test_nonconformity_signs(spark):
    df = spark.createDataFrame([(0.1, 2.0, 1.0), (5.0, 0.01, 3.0)], "d double, m double, r double")
    low, high = [x[0] for x in df.select(C.nonconformity(df.d, df.m, df.r, F.lit(0.1))).collect()]
    assert low < 0 and high > 4


def test_thresholds_and_defaults(spark):
    rng = np.random.default_rng(42)
    scores = spark.createDataFrame([(4, float(x)) for x in rng.random(100)] + [(2, 1.0)] * 3, "rank int, score double")
    t = {r["rank"]: r for r in C.thresholds_with_defaults(scores).collect()}
    assert 0.7 < t[4].q_accept < 1 and t[4].calibrated and t[2].q_accept == 1.2 and t[0].n == 0 and len(t) == 7
    s = sorted(r.score for r in scores.where("rank = 4").collect())
    assert t[4].q_accept == s[math.ceil(101 * 0.9) - 1]
    assert C.bounded_scores(scores.withColumn("id", F.monotonically_increasing_id()), "id", 10).count() == 13


def test_zones_of_inverted_pairs(spark):
    df = spark.createDataFrame([(0.5,), (1.5,), (2.5,)], "s double")
    zones = lambda hplg: [r[0] for r in df.select(C.zone(df.s, F.lit(2.0), F.lit(1.0), hplg)).collect()]
    assert zones(False) == ["accept", "escalate", "fallback"] and zones(True) == ["accept", "accept", "fallback"]


def test_novelty_of_few_prototypes(spark):
    one = spark.createDataFrame([(0, [0.1, 0.0])], "id long, embedding array<double>")
    assert novelty.novelty_threshold(one).first()[0] == 0.0 and novelty.sigma_field(one).first()["sigma"] == 0.0


def test_upsert_folds_in_order(spark):
    a, b = ball(2, seed=3)
    rows = [("t", 4, b.tolist(), ["z"], 1, 1), ("t", 4, a.tolist(), ["x"], 3, 0)]
    r = reference.upsert(spark.createDataFrame(rows, "taxon_id string, rank int, embedding array<double>, lineage array<string>, observation_count long, ordinal int")).first()
    np.testing.assert_allclose(r.embedding, N.interpolate(a, b, 0.25), atol=1e-9)
    assert r.observation_count == 4 and r.lineage == ["x"]


def test_reference_round_trip(spark, tmp_path):
    z = ball(6, seed=5)
    rows = [(f"s{i}", z[i].tolist(), ["d", f"p{i % 2}", f"s{i}"], i) for i in range(6)]
    made = reference.from_lineages(spark.createDataFrame(rows, "taxon_id string, embedding array<double>, lineage array<string>, ordinal int"))
    reference.save(made, str(tmp_path / "ref"))
    back = {r.taxon_id: r for r in reference.load(spark, str(tmp_path / "ref")).collect()}
    assert len(back) == 9 and back["d"].observation_count == 6 and back["p1"].lineage == ["d", "p1"]
    np.testing.assert_allclose(back["d"].embedding, N.karcher_mean(z)[0], atol=1e-7)


def test_taxonomy(spark):
    ranks = ["domain", "phylum", "class", "genus"]
    rows = [([{"rank": r, "name": n} for r, n in zip(ranks, names, strict=True)],) for names in (["B", "P", "C", "G"], ["B", "P", "C2", "H"], ["A", "Q", "D", "I"])]
    taxa = hplg.taxonomy_from_lineages(spark.createDataFrame(rows, "lineage array<struct<rank: string, name: string>>"))
    by = {r.taxon_id: r for r in taxa.collect()}
    assert by["c__C2"].parent_id == "p__P" and by["d__B"].parent_id is None and by["g__H"].rank == 5
    assert {r.taxon_id for r in hplg.descendants(taxa).where("ancestor_id = 'd__B'").collect()} == {"p__P", "c__C", "c__C2", "g__G", "g__H"}
    assert {r["rank"]: r["n"] for r in hplg.rank_sizes(taxa).collect()} == {0: 2, 1: 2, 2: 3, 3: 0, 4: 0, 5: 3, 6: 0}


def test_curvature_ramp_sees_three_phases(spark):
    rows = [("a", i, 1 + 0.2475 * i / 99) for i in range(100)]
    got = hplg.curvature_states(spark.createDataFrame(rows, "run string, step int, kappa double")).orderBy("step").collect()
    assert [k for k in dict.fromkeys(r.phase for r in got)] == ["functional", "transition", "phylogenetic"] and got[0].steps_in_phase == 1


def test_ema_gate():
    z = np.zeros(4)
    far = np.array([0.8, 0, 0, 0])
    assert hplg.ema_step(z, z, 0, far, 0.9)[1] and not hplg.ema_step(z, z, 5, far, 0.9)[1]


def test_chimeras():
    tight = np.full((10, 4), 0.1) + 1e-4 * np.arange(40).reshape(10, 4)
    assert not chimera.score(tight)["is_chimera"]
    split = np.zeros((10, 4))
    split[:5, 0], split[5:, 1] = 0.5, 0.5
    s = chimera.score(split)
    assert s["is_chimera"] and s["breakpoint_idx"] == 4 and s["balance"] == 1.0
    uneven = np.zeros((10, 4)) + 1e-2 * np.random.default_rng(3).standard_normal((10, 4))
    uneven[:8, 0] += 0.5
    uneven[8:, 1] += 0.5
    a, b = uneven[:8], uneven[8:]
    within = (((a - a.mean(0)) ** 2).sum(1).mean() + ((b - b.mean(0)) ** 2).sum(1).mean()) / 2
    gap = np.linalg.norm(a.mean(0) - b.mean(0))
    got = chimera.two_means(uneven)
    assert got[0] == pytest.approx(gap**2 / 4 / (within + gap**2 / 4)) and got[1:] == (pytest.approx(gap), 0.25, 7)
    assert chimera.score(split[:1])["confidence"] == 1.0 and chimera.two_means(split[:3]) == (0.0, 0.0, 0.0, None)


def test_chimera_scores_of_many_sequences_at_once(spark):
    rng, rows, want = np.random.default_rng(8), [], {}
    for name, n in (("a", 1), ("b", 2), (None, 3), ("d", 9), ("e", 40), ("f", 4)):
        z = N.clamp(rng.normal(0, 0.15, (n, 6)) + (np.arange(n) < n // 2)[:, None] * 0.2)
        rows += [(name, i, x.tolist()) for i, x in enumerate(z)]
        want[name] = chimera.score(z)
    df = spark.createDataFrame(rows, "sequence_id string, window_idx int, embedding array<double>").repartition(5).cache()
    limit = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        scored = chimera.chimera_scores(df)
        got = {r.sequence_id: r for r in scored.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", limit)
    assert got.keys() == want.keys() and "InPandas" not in scored._jdf.queryExecution().toString()  # a call of pandas for each sequence before
    for name, w in want.items():
        assert all(got[name][k] == pytest.approx(w[k], abs=1e-9) for k in ("score", "variance", "bimodality", "separation", "balance", "confidence", "atlas_r") if k in w)
        assert (got[name].is_chimera, got[name].breakpoint_idx) == (w["is_chimera"], w["breakpoint_idx"])


def test_histograms_are_counted_where_rows_are(spark):
    rows = [(0, "ACGTNacgt"), (1, "AC"), (2, "ACXGTACG"), (None, "GGGGG"), (0, "ACGT"), (3, None), (None, "GGGGAé"), (4, "")]
    df = spark.createDataFrame(rows, "sequence_id int, sequence string").repartition(3)
    for k in (2, 4, 7):
        want = {}
        for i, s in rows:
            t = (s or "").upper().replace("N", "A")
            for j in range(len(t) - k + 1):
                if set(t[j : j + k]) <= set("ACGT"):
                    want[i, t[j : j + k]] = want.get((i, t[j : j + k]), 0) + 1
        total = {i: sum(n for (x, _), n in want.items() if x == i) for i, _ in rows}
        found = S.kmer_histogram(df, k)
        got = {(r.sequence_id, r.kmer): (r.n, r.freq) for r in found.collect()}
        if k <= S.DENSE:
            assert got == {(i, m): (n, n / total[i]) for (i, m), n in want.items()} and "Generate" not in found._jdf.queryExecution().toString()
    seqs = ["ACGTACGTN", "", "NNNNN", "ACXGT" * 50]
    assert (S.kmer_counts(seqs, 3)[3] > 0).sum() == 0 + len({s[i : i + 3] for s in ["ACXGT" * 50] for i in range(248) if "X" not in s[i : i + 3]})


@pytest.mark.parametrize("n", [1, 2, 3, 4, 6, 10])
def test_neighbour_joining(n):
    z, edges = tree.join_neighbours(ball(n, seed=42))
    assert len(edges) == max(0, 2 * n - 3 if n > 2 else n - 1) and all(w >= 0 for *_, w in edges)
    assert all(np.linalg.norm(p) < 0.895 for p in z)
    if n > 1:
        parent, depth = tree.walk(tree.adjacency(len(z), edges), len(z) - 1)
        assert all(map(math.isfinite, depth)) and sum(p == -1 for p in parent) == 1
        for how in ("leaf", "midpoint"):
            assert 0 <= tree.root_of(n, len(z), edges, how) < len(z)


def plain_joins(points):
    """Every pair looked at for each join, over a whole matrix."""
    d, active, out, new = N.pairwise(points, points), list(range(len(points))), [], len(points)
    d[np.arange(len(d)), np.arange(len(d))] = 0
    while (m := len(active)) > 2:
        total = d.sum(1)
        q = (m - 2) * d - total[:, None] - total[None, :]
        q[np.tril_indices(m)] = np.inf
        i, j = np.unravel_index(int(q.argmin()), q.shape)
        li = max(0.5 * (d[i, j] + (total[i] - total[j]) / (m - 2)), 0.0)
        out += [(active[i], new, li), (active[j], new, max(d[i, j] - li, 0.0))]
        rest = [x for x in range(m) if x not in (i, j)]
        row = np.maximum(0.5 * (d[i, rest] + d[j, rest] - d[i, j]), 0)
        d, active, new = np.block([[d[np.ix_(rest, rest)], row[:, None]], [row[None, :], np.zeros((1, 1))]]), [*(active[x] for x in rest), new], new + 1
    return out


@pytest.mark.parametrize("n", [70, 150, 260])
def test_bounded_joins_equal_looking_at_all_pairs(n, monkeypatch):
    points = ball(n, dim=16, seed=n)
    want = plain_joins(points)
    got = tree.join_neighbours(points, places=False)[1]
    most = 2 * (n - 4)  # of four nodes two pairs are equal
    assert [e[:2] for e in got[:most]] == [e[:2] for e in want[:most]] and np.allclose([e[2] for e in got[:most]], [e[2] for e in want[:most]], atol=1e-12)
    assert len(got) == 2 * n - 3
    assert tree._Joining(points, 1.25).packed.nbytes == 4 * n * (n - 1)  # half a matrix; a matrix of twice as many nodes before
    looked = []
    row = tree._Joining.row
    monkeypatch.setattr(tree._Joining, "row", lambda self, s: looked.append(s) or row(self, s))
    tree.join_neighbours(points, places=False)
    assert len(looked) < n * n / 6


def test_branches_are_nodes_and_edges(spark):
    z = ball(9, seed=3)
    pts = spark.createDataFrame([(t, i, f"t{i}", z[i].tolist()) for t, n in ((0, 9), (1, 1), (2, 2), (3, 3)) for i in range(n)], "tree_id int, ordinal int, taxon_id string, embedding array<double>")
    pts = pts.coalesce(1).cache()
    n, e, both = tree.nodes(pts).cache(), tree.edges(pts).cache(), tree.branches(pts).cache()
    assert sorted(map(str, both.select("tree_id", "node_id", "taxon_id", "parent").collect())) == sorted(map(str, n.drop("embedding").collect()))
    assert sorted(both.where("parent is not null").select("tree_id", "node_id", "parent", "length").collect()) == sorted(e.drop("support").collect())
    rounded = lambda df: sorted((*r[:4], round(r.total_length, 9)) for r in df.collect())
    assert rounded(tree.branch_statistics(both)) == rounded(tree.statistics(n, e))
    paths = tree.patristic(n, e).where("tree_id = 0").select(F.col("a").alias("i"), F.col("b").alias("j"), "dist").cache()
    quartets = tree.all_quartets(spark.createDataFrame([(f"t{i}",) for i in range(9)], "id string").coalesce(1)).cache()
    on = tree.quartets_on(both, quartets.withColumn("tree_id", F.lit(0)))
    shown = lambda df: {(r.a, r.b, r.c, r.d): (r.quartet.topology, round(r.quartet.delta, 9)) for r in df.collect()}
    want, got = shown(tree.with_distances(quartets, paths)), shown(on)
    assert len(got) == 126 and got.keys() == want.keys() and all(got[k] == want[k] for k in want if want[k][1] > 1e-6 or got[k][0] == want[k][0])


@pytest.mark.parametrize("n", [1, 2, 7, 40])
def test_lifted_paths_equal_walks(n):
    rng = np.random.default_rng(n)
    parent = np.array([-1] + [int(rng.integers(0, i)) for i in range(1, n)] + [-1])  # the last node stands alone
    length = rng.random(n + 1)
    near = tree.adjacency(n + 1, [(i, int(parent[i]), float(length[i])) for i in range(1, n)])
    a, b = map(np.ravel, np.meshgrid(np.arange(n + 1), np.arange(n + 1)))
    want = [tree.walk(near, int(x))[1][int(y)] for x, y in zip(a, b, strict=True)]
    np.testing.assert_allclose(tree.lifted(parent, np.where(parent < 0, 0, length), a, b), want, atol=1e-12)


def test_topologies(spark):
    rows = [(1, 5, 5, 5, 5, 1), (5, 1, 5, 5, 1, 5), (5, 5, 1, 1, 5, 5), (2, 3, 3, 3, 3, 2)]
    df = spark.createDataFrame([tuple(map(float, r)) for r in rows], "ab double, ac double, ad double, bc double, bd double, cd double")
    got = [r[0] for r in df.select(tree.topology(*(F.col(c) for c in df.columns))).collect()]
    assert [g.topology for g in got] == [0, 1, 2, 0] and got[3].delta == 0.0


def test_quartets_are_unranked_in_order(spark):
    import itertools

    assert [tree.unrank(k, 8) for k in range(70)] == list(itertools.combinations(range(8), 4))
    assert tree.sampled_quartets(spark, 400, 50).count() == 50 and tree.sampled_quartets(spark, 3, 50).count() == 0


def test_projection(spark, prototypes):
    fit = projection.fit_pca(prototypes, 3)
    z = np.array([r.embedding for r in prototypes.collect()])
    v = N.log0(z) - N.log0(z).mean(0)
    s = np.linalg.svd(v, compute_uv=False)
    np.testing.assert_allclose(fit["explained"], (s**2 / (s**2).sum())[:3], atol=1e-9)
    got = np.array([r.coords for r in projection.project(prototypes, fit).orderBy("id").collect()])
    np.testing.assert_allclose(got, N.exp0(v @ fit["components"].T), atol=1e-9)
    one = projection.project(prototypes.limit(1), projection.fit_pca(prototypes.limit(1), 2)).first().coords
    assert one == [0.0, 0.0] and projection.place_labels([("a", 0, 0, 2), ("b", 0.01, 0, 3), ("c", 1, 0, 1)]) == ["b", "c"]


def test_sequences(spark):
    df = spark.createDataFrame([(0, "ACGTNacgt"), (1, "AC"), (2, "ACXGTACG"), (3, "A" * 1700)], "sequence_id int, sequence string")
    got = {r.sequence_id: r.k for r in df.select("sequence_id", S.kmers(df.sequence).alias("k")).collect()}
    assert got[0] == ["ACGT", "CGTA", "GTAA", "TAAC", "AACG", "ACGT"] and got[1] == [] and got[2] == ["GTAC", "TACG"]
    w = {r.sequence_id: [len(x) for x in r.w] for r in df.select("sequence_id", S.windows(df.sequence).alias("w")).collect()}
    assert w[3] == [1000, 1000, 1000] and w[0] == []
    encoder = S.KmerEncoder()
    z = encoder.encode_batch(["ACGTNacgt", ""])
    assert np.isclose(np.linalg.norm(z[0]), 0.7 / math.sqrt(1.25)) and not z[1].any() and encoder.counts("ACGTNacgt").sum() == 6
    v = S.Vocabulary({"vocab": ["<PAD>", "<UNK>", "A", "AC", "ACG"]})
    assert v.encode("ACGTAN", 6) == [4, 1, 2, 2, 0, 0] and v.encode("ACAC", 1) == [3]
    lab = spark.createDataFrame([(" Escherichia coli ",), ("",), (None,)], "x string")
    assert [r[0] for r in lab.select(S.clean_label(lab.x)).collect()] == ["Escherichia_coli", "UNK", "UNK"]
    assert rank_of("Family") == 4 and json.loads(S.row_json(df).first()[0])["sequence_id"] == 0
    with pytest.raises(ValueError):
        rank_of("clade")


def test_centroids_do_not_depend_on_the_order(spark):
    from horocycle.plans import fixtures

    z = ball(400, dim=3, seed=12)
    p = spark.createDataFrame([(i, (i * 7) % 5, x.tolist()) for i, x in enumerate(z)], "id long, label int, embedding array<double>")
    found = [{(r["rank"], r.id): r for r in fixtures.centroids(q).collect()} for q in (p.coalesce(1), p.orderBy(F.desc("id")).coalesce(1), p.repartition(7, "id"))]
    assert all({k: r.embedding for k, r in x.items()} == {k: r.embedding for k, r in found[0].items()} for x in found)
    assert found[0][1, "p__P2"].embedding == found[0][2, "c__C2"].embedding and found[0][6, "s__S3_4"].lineage == ["d__D1", "p__P3", "c__C3", "o__O3", "f__F3", "g__G3_1", "s__S3_4"]
    mine = z[[i for i in range(400) if (i * 7) % 5 % 2 == 1]]
    assert found[0][0, "d__D1"].embedding == pytest.approx([math.fsum(x) / len(mine) for x in mine.T], abs=1e-16)


def test_arcs_and_trees_take_all_points(spark):
    import os

    import pytest

    from horocycle.plans import fixtures, registry

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    labels = {}
    for r in fixtures.points(spark, sf).select("id", "label").collect():
        labels.setdefault(r.label, set()).add(r.id)
    ids = set().union(*labels.values())
    arcs = registry.geodesic_arcs(spark, sf).collect()
    assert {r.id for r in arcs} == {i for i in ids if i + 1 in ids} and len(arcs) == 10 * len({r.id for r in arcs})
    edges = {r.tree_id: r["count"] for r in registry.nj_edges(spark, sf).groupBy("tree_id").count().collect()}
    assert edges == {k: 2 * len(x) - 3 for k, x in labels.items()}
