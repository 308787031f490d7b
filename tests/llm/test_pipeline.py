"""The pipeline against its stages done by hand, and the registered queries on the smallest tables."""

import os

import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_pipeline_equals_brute_force(spark):
    from tokenizers import Tokenizer

    import corpus_pipeline
    from horocycle.llm import packing, quality
    from horocycle.llm.queries import tokenizer_path
    from tests.llm.test_operators import brute_components, brute_lines, shingles

    rows = corpus_pipeline.run(spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first = [(r.doc_id, r.text) for r in quality.apply_rules(docs).collect()]
    verdicts = {r.doc_id: r.kept for r in quality.quality_rules(docs).collect()}
    assert {d for d, _ in first} == {d for d, k in verdicts.items() if k}
    gone = brute_lines(first, 2, 40)
    second = [(d, "\n".join(x for p, x in enumerate(t.split("\n")) if p not in gone.get(d, ()))) for d, t in first]
    had = {d: len(t.split()) for d, t in first}
    second = [(d, t) for d, t in second if d not in gone or (t.strip() and 100 * (had[d] - len(t.split())) <= 80 * had[d])]
    component = {x: c for x, _, c in brute_components(second, 5, 80)}
    third = [(d, t) for d, t in second if component[d] == d]
    items = [shingles(r.text, 5) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    fourth = {d: t for d, t in third if not any(a and 100 * len(a & shingles(t, 5)) >= 80 * len(a) for a in items)}
    library = Tokenizer.from_file(tokenizer_path())
    want = sorted((d, k, s, n) for d, t in fourth.items() for k, (s, n) in enumerate(packing.cut(1 + len(library.encode(t, add_special_tokens=False).ids), 1024)))
    assert sorted((r.doc_id, r.piece, r.start, r.length) for r in rows) == want


def test_every_query_is_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names
