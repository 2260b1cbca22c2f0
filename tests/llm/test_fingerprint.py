import hashlib

import pytest
from pyspark.sql import functions as F

from spliceloom.llm.fingerprint import alike_documents, edited_fingerprints, fingerprints

SCHEMA = "doc_id long, text string, block int, guard string"


def _edited(texts):
    return [t[: len(t) - len(t) // 2] + texts[(k + 1) % len(texts)][: len(t) // 2] for k, t in enumerate(texts)]


def _shingles(text):
    w = text.encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}


def test_edited_texts_and_likeness_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(5)
    texts = [r.text or "" for r in docs.orderBy("doc_id").collect()]
    rows = edited_fingerprints(docs).orderBy("doc_id").collect()
    for r, text, edit, after in zip(rows, texts, _edited(texts), [*texts[1:], texts[0]], strict=True):
        assert r.n_chars == len(text)
        assert r.edited_sha256 == hashlib.sha256(edit.encode()).hexdigest()
        a, b, c = _shingles(text), _shingles(edit), _shingles(after)
        assert r.near_edited == pytest.approx(len(a & b) / len(a | b), abs=0.2)
        assert r.near_next == pytest.approx(len(a & c) / len(a | c), abs=0.2)
    plain = {r.doc_id: r.fingerprint for r in fingerprints(docs).collect()}
    assert plain == {r.doc_id: r.fingerprint for r in rows}


def test_nulls_empty_ties_and_clashing_columns(spark):
    docs = spark.createDataFrame([(5, None, 1, "x"), (1, "", 1, "x"), (2, "ab", 2, "y"), (2, "ab", 2, "y"), (None, "abcd", 3, "z")], SCHEMA)
    rows = edited_fingerprints(docs).collect()
    assert len(rows) == 5
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    by = {(r.doc_id, r.edited_sha256) for r in rows}
    assert by == {(1, sha("")), (2, sha("aa")), (2, sha("a")), (5, sha("")), (None, sha("ab"))}
    assert {r.near_edited for r in rows if r.doc_id in (1, 5)} == {1.0}
    assert edited_fingerprints(docs.limit(0)).count() == 0
    assert edited_fingerprints(docs.where("doc_id = 5")).count() == 1


def test_alike_documents(spark):
    words = " ".join(f"w{k}" for k in range(200))
    docs = spark.createDataFrame([(1, words), (2, words + " more"), (3, "something else"), (4, words)], "doc_id long, text string")
    assert {(r.doc_id, r.class_id) for r in alike_documents(docs).collect()} == {(1, 1), (2, 1), (3, 3), (4, 1)}


def test_blocks_are_looked_up_and_of_like_size(spark):
    from spliceloom.llm.fingerprint import _block_of, _blocks

    ids = spark.range(-5, 120).withColumnRenamed("id", "doc_id")
    for cuts in ([], [3.0], [0.0, 10.0], [float(7 * k) for k in range(15)], [float(k) for k in range(100)]):
        got = {r.doc_id: r.b for r in ids.select("doc_id", _block_of(cuts).alias("b")).collect()}
        assert got == {i: sum(c <= i for c in cuts) for i in got}
    # the first tenth of the documents has nearly all bytes
    docs = spark.createDataFrame([(k, "x" * (100_000 if k < 40 else 10)) for k in range(400)], "doc_id long, text string")
    sizes = [r.n for r in _blocks(docs, 8).where("guard = 0").groupBy("block").agg(F.sum(F.length("text")).alias("n")).collect()]
    assert len(sizes) == 8 and max(sizes) <= 0.2 * sum(sizes)
