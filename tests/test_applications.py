"""Files in, reports out, on small cases against the operators done by hand in numpy."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from horocycle import applications as A
from horocycle.functions import numeric as N
from horocycle.functions import sequences as S
from horocycle.operators import tree
from horocycle.sources import readers, writers
from horocycle.streaming import streams


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    """(FASTA path, its sequences, a reference of two families built from them)."""
    rng = random.Random(4)
    base = {f: "".join(rng.choices("ACGT", weights=w, k=1500)) for f, w in (("f__a", (5, 1, 1, 1)), ("f__b", (1, 1, 1, 5)))}
    seqs = {}
    for i in range(8):
        s = list(base["f__a" if i % 2 else "f__b"])
        for _ in range(60):
            s[rng.randrange(len(s))] = rng.choice("ACGT")
        seqs[f"s{i}"] = "".join(s)
    seqs["mixed"] = base["f__a"] + base["f__b"]
    folder = tmp_path_factory.mktemp("world")
    (folder / "in.fasta").write_text("".join(f">{k} some words\n{v[:700]}\n{v[700:]}\n" for k, v in seqs.items()))
    rows = [(k, v, ["d__x", "p__x", "c__x", "o__x", "f__a" if int(k[1:]) % 2 else "f__b", "g__x"]) for k, v in seqs.items() if k != "mixed"]
    protos = A.build_reference(spark.createDataFrame([*rows, ("short", "ACGT", ["d__x"])], "sequence_id string, sequence string, lineage array<string>"), str(folder / "ref"))
    return str(folder / "in.fasta"), seqs, protos.withColumnRenamed("taxon_id", "id")


def test_reference_from_sequences(world):
    _, seqs, protos = world
    rows = {r.id: r for r in protos.collect()}
    assert {k: r["rank"] for k, r in rows.items()} == {"d__x": 0, "p__x": 1, "c__x": 2, "o__x": 3, "f__a": 4, "f__b": 4}
    z = S.KmerEncoder().encode_batch([seqs[f"s{i}"] for i in range(8)])
    np.testing.assert_allclose(rows["d__x"].embedding, N.karcher_mean(z)[0], atol=1e-6)
    assert rows["f__a"].observation_count == 4 and list(rows["f__a"].lineage)[-1] == "f__a"


@pytest.mark.parametrize("mode", ["flat", "hierarchical"])
def test_placements_of_a_fasta(spark, world, mode, tmp_path):
    path, seqs, protos = world
    placed = {r.qid: r for r in A.place_fasta(spark, path, protos, mode=mode, least=1000).collect()}
    assert set(placed) == set(seqs) and all(r.zone in ("accept", "escalate", "fallback") and 0 <= r.confidence <= 1 for r in placed.values())
    z = {r.id: np.array(r.embedding) for r in protos.collect()}
    for k in ("s0", "s1", "s2"):
        own = S.KmerEncoder().encode_batch([seqs[k]])[0]
        near = sorted((float(N.distance(own, v)), i) for i, v in z.items())
        assert placed[k].best_distance == pytest.approx(near[0][0], abs=1e-6)
    assert A.place_fasta(spark, path, protos, mode=mode, least=2000).count() == 1
    with pytest.raises(ValueError, match="mode"):
        A.place_fasta(spark, path, protos, mode="odd")
    A.place_fasta_to(spark, path, protos, str(tmp_path / "out"), "tsv", mode=mode)
    back = spark.read.option("header", True).option("sep", "\t").csv(str(tmp_path / "out"))
    assert back.count() == len(seqs) and back.columns[:3] == ["sequence_id", "taxon_id", "rank"]
    A.place_fasta_to(spark, path, protos, str(tmp_path / "out.jplace"), "jplace", mode=mode)
    assert len(json.loads((tmp_path / "out.jplace").read_text())["placements"]) == len(seqs)


def test_reports_of_a_fasta(spark, world):
    path, seqs, protos = world
    found = {r.sequence_id: r for r in A.detect_chimeras(spark, path).collect()}
    assert found["mixed"].chimera_score > max(r.chimera_score for k, r in found.items() if k != "mixed") and found["mixed"].length == 3000
    assert found["mixed"].breakpoint in (1, 2, 3)
    triaged = A.triage_fasta(spark, path, protos)
    assert triaged.columns == ["sequence_id", "category", "d_geo", "sigma_local", "nearest_taxon_id", "epsilon", "sigma_threshold"]
    assert {r.nearest_taxon_id for r in triaged.collect() if r.sequence_id in ("s1", "s3")} == {"f__a"}
    novel = A.novelty_fasta(spark, path, protos).collect()
    assert len(novel) == len(seqs) and not any(r.is_novel for r in novel if r.sequence_id != "mixed")


def test_calibration_goes_out_and_in(spark, world, tmp_path):
    path, _, protos = world
    placed = A.place_fasta(spark, path, protos)
    truth = spark.createDataFrame([(f"s{i}", "f__a" if i % 2 else "f__b") for i in range(8)], "qid string, taxon string")
    scores = A.calibration_scores(placed, truth)
    A.save_calibration(scores, str(tmp_path / "cal"), (0.2, 0.05))
    back, limits = A.load_calibration(spark, str(tmp_path / "cal"))
    assert sorted(r.score for r in back.collect()) == sorted(r.score for r in scores.collect()) and limits.count() <= 1


def test_placement_stream_writes_zones(spark, world, tmp_path):
    path, seqs, protos = world
    A.encoded_fasta(spark, path).select("qid", "embedding").write.parquet(str(tmp_path / "q"))
    live = spark.readStream.schema("qid string, embedding array<double>").parquet(str(tmp_path / "q"))
    none = spark.createDataFrame([], "rank int, score double")
    q = live.writeStream.foreachBatch(streams.placement_sink(str(tmp_path / "out"), protos, none)).option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    got = {r.sequence_id: r.zone for r in spark.read.option("header", True).option("sep", "\t").csv(str(tmp_path / "out")).collect()}
    assert got == {r.qid: r.zone for r in A.place_fasta(spark, path, protos).collect()}


def test_datum(spark, tmp_path):
    data = {
        "kappa": 1.25, "projection_matrix_P": [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0]], "tangent_space_grand_centroid": [0.0, 0.0, 0.0],
        "reference_anchors": {readers.ANCHOR: {"theta_raw": 30.0}}, "domain_centroids": {"x": {"r": 0.5, "theta": 60.0, "embedding": [0.0, 0.0, 0.0]}},
    }
    (tmp_path / "datum.json").write_text(json.dumps(data, indent=1))
    datum = readers.read_datum(spark, str(tmp_path / "datum.json"))
    points = spark.createDataFrame([(0, [0.3, 0.3, 0.1]), (1, [0.3, 0.3]), (2, [0.9, 0.9, 0.9])], "id long, embedding array<double>")
    (row,) = datum.coordinates(points).collect()
    r = float(N.origin_distance(np.array([0.3, 0.3, 0.1])))
    assert row.theta == pytest.approx(15.0) and row.r == pytest.approx(r) and row.sigma_theta == pytest.approx(24.5) and row.sigma_r == pytest.approx(0.1 * abs(r - 0.5) + 0.02)
    for name, value in (("kappa", 1.0), ("projection_matrix_P", [[1.0, 0.0, 0.0]]), ("reference_anchors", {})):
        (tmp_path / "bad.json").write_text(json.dumps(data | {name: value}))
        with pytest.raises(ValueError):
            readers.read_datum(spark, str(tmp_path / "bad.json"))


def test_drawn_quartets(spark):
    ids = spark.range(40).select((F.col("id") * 3).alias("id"))
    drawn = [tuple(r) for r in tree.hashed_quartets(ids, 200).collect()]
    assert 150 < len(drawn) <= 200 and len(set(drawn)) == len(drawn) and all(a < b < c < d and not a % 3 for a, b, c, d in drawn)
    assert tree.hashed_quartets(ids.limit(6), 200).count() == 15 and tree.hashed_quartets(ids.limit(3), 200).count() == 0
    rng = np.random.default_rng(1)
    z = rng.normal(0, 0.1, (40, 5))
    points = spark.createDataFrame([(3 * i, x.tolist()) for i, x in enumerate(z)], "id long, embedding array<double>")
    for r in tree.quartets_of(tree.hashed_quartets(ids, 200), points).collect():
        d = lambda x, y: float(N.distance(z[x // 3], z[y // 3]))
        s = [d(r.a, r.b) + d(r.c, r.d), d(r.a, r.c) + d(r.b, r.d), d(r.a, r.d) + d(r.b, r.c)]
        assert r.quartet.topology == int(np.argmin(s)) and r.quartet.delta == pytest.approx((sorted(s)[2] - sorted(s)[1]) / 2)


def test_dark_map_is_written(spark, tmp_path):
    dark = spark.createDataFrame([("a", 1.0, True), ("b", 0.5, False)], "id string, sigma double, is_dark boolean")
    writers.write_dark_map(dark, dark.agg(F.count("*").alias("n_total")), str(tmp_path / "dark"))
    assert spark.read.json(str(tmp_path / "dark/taxa")).count() == 2 and spark.read.json(str(tmp_path / "dark/summary")).first().n_total == 2
