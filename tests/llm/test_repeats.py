import hashlib
import random

from spliceloom.llm.repeats import deduplicated


def brute(rows, length=100):
    """rows: (doc_id, text) in any order; removed places by a dict of every window's first place."""
    first, out = {}, {}
    for doc, text in sorted(rows):
        b = (text or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            w = b[s : s + length]
            if first.setdefault(w, (doc, s)) != (doc, s):
                gone[s : s + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        runs = sum(1 for k, g in enumerate(gone) if g and (not k or not gone[k - 1]))
        out[doc] = (len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out


def _check(spark, rows, parts=5):
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, mark string").repartition(parts)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in deduplicated(docs).collect()}
    assert got == brute(rows)


def test_shared_passages_edits_and_runs(spark):
    rng = random.Random(8)
    text = lambda n: "".join(rng.choice("abcdefghij é\n") for _ in range(n))
    shared = [text(rng.randrange(90, 400)) for _ in range(6)]
    rows = []
    for doc in range(60):
        parts = [text(rng.randrange(0, 300)) for _ in range(3)]
        for _ in range(rng.randrange(4)):
            x = list(rng.choice(shared))
            if rng.random() < 0.5:
                x[rng.randrange(len(x))] = "X"
            parts.insert(rng.randrange(4), "".join(x)[rng.randrange(30) :])
        rows.append((doc * 3 - 20, "".join(parts)))
    rows += [(1000 + k, rows[k][1]) for k in range(5)] + [(2000, "a" * 5000), (2001, "a" * 99), (2002, "ab" * 800), (2003, None), (2004, "")]
    _check(spark, rows)


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    _check(spark, [(r.doc_id, r.text) for r in docs.collect()])


def test_repeated_rows_null_ids_and_empty_table(spark):
    long = "".join(chr(97 + k * k % 23) for k in range(300))
    docs = spark.createDataFrame([(1, long), (1, long), (None, long), (2, long)], "doc_id long, text string")
    rows = sorted((r.doc_id or 0, r.n_removed) for r in deduplicated(docs).collect())
    assert [r for r in rows if r[0] != 2] == [(0, 0), (1, rows[1][1]), (1, rows[1][1])] and rows[-1] == (2, 300)
    assert deduplicated(docs.limit(0)).count() == 0


def test_a_long_text_is_parsed_in_stretches(spark):
    import numpy as np

    from spliceloom.llm.repeats import STRETCH, long_phrases, phrases

    rng = np.random.default_rng(3)
    text = bytearray(rng.integers(97, 123, 2 * STRETCH + 50_000, dtype=np.uint8).tobytes())
    for at in (10, STRETCH - 60, STRETCH + 40_000, 2 * STRETCH - 300, len(text) - 400):
        text[at : at + 300] = text[5_000:5_300]
    _check(spark, [(1, text.decode()), (2, text[STRETCH - 500 : STRETCH + 700].decode()), (3, "x" + text[-450:].decode())])
    data = np.frombuffer(bytes(text), np.uint8)
    whole, cut = phrases(data, np.array([0, len(data)])), long_phrases(data, np.array([0, len(data)]))
    assert whole["count"].sum() == cut["count"].sum() == len(text) - 99 and len(cut["count"]) - len(whole["count"]) in (1, 2)
