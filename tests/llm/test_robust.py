"""Words made to collide, rows that share ids, column names of any kind, both ways of joining, and hot keys, against brute force."""

import itertools
import random
import types

import numpy as np
import pyarrow as pa
import pytest

from horocycle.llm import bpe, decontam, jaccard, licenses, linededup, quality, sharding, shared, textkit
from tests.llm.test_operators import SCHEMA, brute_components, brute_lines, rows_of

NAMES = ["removed", "new_text", "n_lines", "_gone", "_keep", "_doc", "own", "t", "k", "h", "n", "first", "lines", "source2", "stays"]


def twins(n, a="t", b="h"):
    """Two words of ``n`` letters in the order of the Thue-Morse sequence and the other way round: sums of letter times power agree modulo 2**64."""
    bits = [bin(i).count("1") & 1 for i in range(n)]
    return "".join(a if x else b for x in bits), "".join(b if x else a for x in bits)


def test_words_that_collide_in_sums_of_powers_differ():
    words = [w for n in (9, 64, 65, 1024, 2048, 4096) for w in twins(n)] + ["a", "a\0", "", "ab"]
    hashed = [textkit.words(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w)]))[0].tolist() for w in words if w]
    assert len({x[0] for x in hashed}) == len(hashed)


def test_operators_tell_colliding_words_apart(spark):
    from tokenizers import Tokenizer

    from horocycle.llm.queries import tokenizer_path

    x, y = twins(1024)
    docs = spark.createDataFrame([(0, x), (1, y), (2, f"a b {x} c d"), (3, f"a b {y} c d")], "doc_id long, text string")
    got = rows_of(jaccard.jaccard_components(docs).select("doc_id", "component_id", "n_copies"))
    assert sorted(got) == [(i, i, 1) for i in range(4)]
    found = rows_of(decontam.find_items(docs, spark.createDataFrame([(7, f"a b {x} c d"), (8, x)], "item_id long, text string")).select("doc_id", "item_id"))
    assert sorted(found) == [(0, 8), (2, 7)]
    library = Tokenizer.from_file(tokenizer_path())
    texts = [w for n in (9, 1024, 4096) for pair in ("th", "ab", "xy") for w in twins(n, *pair)]
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [list(ids) for _, ids in bpe.Encoder(tokenizer_path()).encode(pa.array(texts, pa.string()))] == want
    scanner = licenses.Scanner({"one": f"{x} p q r"}, 100)
    words = lambda text: next(licenses._words(pa.array([text], pa.string())))
    assert scanner.scan(words(f"{x} p q r")) and not scanner.scan(words(f"{y} p q r"))


def test_pre_tokens_are_compared_where_hashes_agree(monkeypatch):
    from tokenizers import Tokenizer

    from horocycle.llm.queries import tokenizer_path

    whole = textkit.span_hashes
    monkeypatch.setattr(textkit, "span_hashes", lambda *a: (whole(*a)[0] & np.uint64(63), whole(*a)[1]))
    rng = random.Random(8)
    texts = ["".join(rng.choices("abc defghij klmno\n'12", k=400)) + " a" + "b" * 30 + " a" + "b" * 29 + "c" for _ in range(40)]
    want = [len(e.ids) for e in Tokenizer.from_file(tokenizer_path()).encode_batch(texts, add_special_tokens=False)]
    assert bpe.Encoder(tokenizer_path()).counts(pa.array(texts, pa.string())).tolist() == want


def test_sets_that_share_64_bits_get_other_names():
    a, b = (np.unique(np.arange(n, dtype=np.uint64)) for n in (5, 6))
    first, second = jaccard._digests(a)
    assert jaccard._name(a, frozenset()) == first and jaccard._name(a, frozenset([first])) == second != first
    assert jaccard._name(b, frozenset([first])) == jaccard._digests(b)[0]


def test_the_most_shared_tokens_are_bounded(spark, monkeypatch):
    counted = spark.range(1000).selectExpr("id as token", "id + 1 as df")
    monkeypatch.setattr(jaccard, "HOT_TOKENS", 100)
    hot = jaccard._most_shared(counted).view(np.int64).tolist()
    assert 50 < len(hot) <= 100 and min(hot) == 1000 - len(hot)
    assert len(jaccard._most_shared(counted.where("false"))) == 0


@pytest.fixture(scope="module")
def mixed(spark):
    """Null and repeated ids with different texts, near copies, template lines, and columns of clashing names."""
    from pyspark.sql import functions as F

    rng = random.Random(12)
    vocabulary = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(300)]
    line = lambda n=9: " ".join(rng.choices(vocabulary, k=n))
    base = [line() for _ in range(6)]
    rows = []
    for i in range(45):
        own = [base[k] if rng.random() < 0.7 else line() for k in range(6)] if i % 3 else [line() for _ in range(4)]
        own.append(f"this page number {rng.randrange(10**9)} was printed from the archive of the town in its first year")
        rows.append((None if i % 5 == 0 else i // 2, "\n".join(own), "en", f"h{i % 2}", 1))
    rows += [rows[1], rows[5], (None, None, None, None, None), (3, "", "en", None, 0), (4, " \n", "en", "h0", 0)]
    return spark.createDataFrame(rows, SCHEMA).select("*", *(F.lit(c).alias(c) for c in NAMES))


def lines_removed(docs, **settings):
    return sorted(((r.doc_id, r.text, r.removed) for r in linededup.line_dedup(docs.select("doc_id", "text"), **settings).collect()), key=str)


def test_both_ways_of_joining_give_the_same_rows(mixed, monkeypatch):
    def results():
        return [
            lines_removed(mixed), sorted(rows_of(jaccard.jaccard_components(mixed)), key=str), sorted(rows_of(jaccard.one_per_component(mixed).select("doc_id", "text")), key=str),
            sorted(rows_of(quality.quality_rules(mixed, 2, 5, 10)), key=str), sorted(rows_of(sharding.shard(mixed, 900)), key=str), sorted(rows_of(linededup.deduped(mixed)), key=str),
        ]

    small = results()
    monkeypatch.setattr(shared, "BROADCAST_BYTES", -1)
    assert results() == small and any(r[2] for r in small[0]) and any(r[8] for r in small[3])


def test_columns_of_any_name_pass(mixed):
    for out in (linededup.deduped(mixed), jaccard.one_per_component(mixed), quality.apply_rules(mixed)):
        rows = out.collect()
        assert out.columns == mixed.columns and rows and all(r[c] == c for r in rows for c in NAMES)
    out = linededup.line_dedup(mixed)
    assert out.count() == mixed.count() and set(out.columns) == {*mixed.columns, "n_removed"}


def test_template_lines_under_hot_keys(spark, monkeypatch):
    rng = random.Random(21)
    rows = []
    for i in range(70):
        number = "".join(rng.choices("0123456789", k=rng.choice((3, 9, 9))))
        rows.append((i, f"a header line that is too short\nthe record {number} was entered in the book of the house"))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_lines(rows, 2, 40)
    for hot, sample in ((2, 128), (64, 1)):
        monkeypatch.setattr(linededup, "HOT_LINES", hot)
        monkeypatch.setattr(linededup, "SAMPLE", sample)
        got = {r.doc_id: [int(x) for x in r.removed.split(",")] for r in linededup.line_dedup(df).collect() if r.n_removed}
        assert got == want and 5 < len(got) < 60


def test_a_cluster_of_near_copies_is_opened_in_few_units(spark, monkeypatch):
    rng = random.Random(2)
    base = [f"w{i}" for i in range(130)]
    rows = []
    for i in range(120):
        w = list(base[: rng.choice((130, 128, 126))])
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    rows += [(500 + i, " ".join([*base[:20], *(f"y{i}x{k}" for k in range(60))])) for i in range(20)]
    monkeypatch.setattr(jaccard, "GROUP_TOKENS", 1200)
    units, write = [], shared._write
    monkeypatch.setattr(shared, "_write", lambda df, name, register: [out := write(df, name, register), units.append(out.count()) if name == "units" else None][0])
    got = rows_of(jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_shingles", "component_id"))
    assert sorted(got, key=str) == brute_components(rows, 4, 85)
    assert sum(units) < 150


def test_a_cluster_has_no_local_scratch():
    class Session:
        conf = types.SimpleNamespace(get=lambda *_: None)
        sparkContext = types.SimpleNamespace(master="spark://host:7077", _jsc=types.SimpleNamespace(sc=lambda: types.SimpleNamespace(getCheckpointDir=lambda: types.SimpleNamespace(isDefined=lambda: False))))

    with pytest.raises(RuntimeError, match="checkpoint"):
        shared.shared_dir(Session())


def test_scratch_deletes_all_but_the_result(spark):
    import os

    with shared.scratch(spark) as held:
        shared.written(spark.range(3), "gone")
        paths = list(shared._OPEN.paths)
        out = held.kept(spark.range(5), "kept")
    assert out.count() == 5 and not any(os.path.exists(p.removeprefix("file:")) for p in paths) and not getattr(shared._OPEN, "paths", None)


def test_licences_equal_whole_alignment(spark):
    rng = random.Random(17)
    texts = []
    for _ in range(6):
        for template in licenses.TEMPLATES.values():
            w = template.split()
            for _ in range(rng.randint(0, len(w) // 3)):
                at = rng.randrange(len(w))
                w[at : at + rng.randint(0, 1)] = [f"odd{rng.randrange(10**6)}"] * rng.randint(0, 2)
            texts.append(" ".join([*(f"pre{k}" for k in range(rng.randrange(50))), *w, *(f"post{k}" for k in range(rng.randrange(50)))]))
    want = set()
    names, words = list(licenses.TEMPLATES), [x.tolist() for x in licenses._words(pa.array(list(licenses.TEMPLATES.values()), pa.string()))]
    for i, own in enumerate(licenses._words(pa.array(texts, pa.string()))):
        want |= {(i, n) for n, t in zip(names, words, strict=True) if 100 * len(licenses.align(t, own.tolist())) >= 80 * len(t)}
    got = {(r.doc_id, r.license) for r in licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert want <= got and len(want) > 20 and len(set(itertools.chain(want, got))) < len(texts) * 2
