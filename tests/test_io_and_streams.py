"""Readers, writers and streams."""

import gzip
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from horocycle.functions import sequences as S
from horocycle.operators import chimera, hplg, placement, tree
from horocycle.sources import readers, writers
from horocycle.streaming import streams


def test_fasta(spark, tmp_path):
    text = "stray\n>one first\nacg\n\nTTN\n>two\n>three x\nAC GT\r\n"
    (tmp_path / "a.fa").write_text(text)
    with gzip.open(tmp_path / "b.fa.gz", "wt") as f:
        f.write(">z\nac\n")
    got = {(r.sequence_id, r.sequence) for r in readers.read_fasta(spark, str(tmp_path)).collect()}
    assert got == {("one first", "ACGTTN"), ("two", ""), ("three x", "ACGT"), ("z", "AC")}
    plain = {(r.sequence_id, r.sequence) for r in readers.read_fasta(spark, str(tmp_path / "a.fa"), first_token=True, upper=False).collect()}
    assert plain == {("one", "acgTTN"), ("two", ""), ("three", "ACGT")}


def test_manifest_arrays_and_taxa(spark, tmp_path):
    head = "domain,phylum,class,order,family,genus,species,split,tokenized_path\n"
    (tmp_path / "m.csv").write_text(head + "Bacteria,P,C,O,F,G,S,train,a.npy\nViruses,P,C,O,F,G,S,train,b.npy\nBacteria,P,C,O,,G,S,train,c.npy\nBacteria,P,C,O,F,G,S,test,d.npy\n")
    rows = readers.read_manifest(spark, str(tmp_path / "m.csv"), most=5).collect()
    assert [r.lineage[1] for r in rows] == ["p__Bacteria|P"]
    np.save(tmp_path / "t.npy", np.arange(3))
    assert readers.read_tokens(spark, str(tmp_path / "t.npy"), 5).first()["values"] == [0, 1, 2, 0, 0]
    np.save(tmp_path / "e.npy", np.eye(3))
    (tmp_path / "taxa.txt").write_text("a\n\n b \nc\n")
    taxa = readers.read_lines(spark, str(tmp_path / "taxa.txt"))
    both = readers.with_taxa(readers.read_npy(spark, str(tmp_path / "e.npy")), taxa).orderBy("row").collect()
    assert [(r.taxon_id, r.embedding.index(1.0)) for r in both] == [("a", 0), ("b", 1), ("c", 2)]
    with pytest.raises(ValueError):
        readers.with_taxa(readers.read_npy(spark, str(tmp_path / "e.npy")), taxa.limit(2))


def test_placement_files(spark, tmp_path):
    p = spark.createDataFrame([("x", 6, [0.1, 0.1], ["d", "x"])], "id string, rank int, embedding array<double>, lineage array<string>")
    q = spark.createDataFrame([(1, [0.1, 0.2])], "qid long, embedding array<double>")
    placed = placement.calibrated(placement.place_flat(q, p), spark.createDataFrame([], "rank int, score double"))
    writers.write_tsv(writers.placement_rows(placed), str(tmp_path / "t"))
    back = spark.read.option("header", True).option("sep", "\t").csv(str(tmp_path / "t")).first()
    assert len(back) == 12 and back.lineage == "d;x" and back.margin is None
    writers.write_jsonl(placed, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).first().taxon_id == "x"
    writers.write_jplace(placed, str(tmp_path / "p.jplace"))
    data = json.loads((tmp_path / "p.jplace").read_text())
    assert data["version"] == 3 and len(data["placements"][0]["p"][0]) == 5


def test_tree_files(spark, tmp_path):
    edges = [(0, 3, 1.0), (1, 3, 2.0), (2, 3, 3.0)]
    assert writers.newick(["A", "B", "C", None], edges, 3) == "(A:1.000000,B:2.000000,C:3.000000);"
    assert writers.newick([], [], 0) == "();" and writers.newick(["A"], [], 0) == "A;"
    deep = [(i, i + 1, 1.0) for i in range(5000)]
    assert writers.newick([f"n{i}" for i in range(5001)], deep, 0).count("(") == 5000
    svg = writers.radial_svg(["A", "B", "C", None], edges, 3)
    assert svg.count("<line") == 3 and "Empty tree" in writers.radial_svg([], [], 0)
    pts = spark.createDataFrame([(0, i, f"t{i}", [0.1 * i, 0.05 * (i % 2)]) for i in range(5)], "tree_id int, ordinal int, taxon_id string, embedding array<double>")
    nodes, made = tree.nodes(pts, root="leaf"), tree.edges(pts)
    (tmp_path / "tree.json").write_text(writers.tree_json(nodes, made))
    n, e = readers.read_tree(spark, str(tmp_path / "tree.json"))
    assert n.count() == 8 and e.count() == 7
    payload = writers.viewer_payload(pts.select("ordinal", "taxon_id", F.lit(6).alias("rank"), F.col("embedding").alias("coords")), [(0, 1)], 1.25, [])
    assert "t4" in writers.viewer_html(payload)
    with pytest.raises(ValueError):
        writers.viewer_payload(pts.select("ordinal", "taxon_id", F.lit(6).alias("rank"), F.col("embedding").alias("coords")), [], 1.25, [], three_d=True)


def run_stream(df, mode, name):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
    q.processAllAvailable()
    q.stop()
    return df.sparkSession.table(name)


def test_streams_equal_batches(spark, tmp_path):
    rng = np.random.default_rng(0)
    pts = spark.createDataFrame([(i, (rng.random(4) * 0.3).tolist()) for i in range(40)], "qid long, embedding array<double>")
    pts.write.parquet(str(tmp_path / "q"))
    live = spark.readStream.schema(pts.schema).parquet(str(tmp_path / "q"))
    protos = pts.where("qid < 10").select(F.col("qid").alias("id"), "embedding")
    want = {tuple(r) for r in streams.place_stream(pts, protos, 3).collect()}
    assert {tuple(r) for r in run_stream(streams.place_stream(live, protos, 3), "append", "placed").collect()} == want

    scores = spark.createDataFrame([(i % 2, float(i)) for i in range(100)], "rank int, score double")
    scores.write.parquet(str(tmp_path / "s"))
    got = {r["rank"]: r for r in run_stream(streams.online_thresholds(spark.readStream.schema(scores.schema).parquet(str(tmp_path / "s"))), "update", "thresholds").collect()}
    assert got[0].n == 50 and got[0].q_accept == 2.0 * (int(np.ceil(51 * 0.9)) - 1)

    hist = spark.createDataFrame([("a", i, 1 + 0.2475 * min(1, i / 80)) for i in range(120)], "run string, step int, kappa double")
    hist.coalesce(1).write.parquet(str(tmp_path / "h"))
    live = run_stream(streams.curvature_monitor(spark.readStream.schema(hist.schema).parquet(str(tmp_path / "h"))), "append", "curvature")
    cols = ["step", "phase", "is_stable", "steps_in_phase"]
    assert [tuple(r) for r in live.orderBy("step").select(cols).collect()] == [tuple(r) for r in hplg.curvature_states(hist).orderBy("step").select(cols).collect()]


def test_encoded_windows_make_chimera_scores(spark):
    df = spark.createDataFrame([(0, "ACGT" * 300 + "AAAT" * 300)], "sequence_id int, sequence string")
    w = df.select("sequence_id", F.posexplode(S.windows(df.sequence)).alias("window_idx", "sequence"))
    assert chimera.chimera_scores(S.encoded(w)).first().n_windows == 4
