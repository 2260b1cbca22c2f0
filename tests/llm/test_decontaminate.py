import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from spliceloom.llm import common, decontaminate
from spliceloom.llm.decontaminate import EDITS, decontaminated, leaks, nearest, word_hashes

RNG = random.Random(5)
VOCABULARY = [f"w{k}" for k in range(3000)]


def edited(words, edits):
    out = list(words)
    for _ in range(edits):
        k = RNG.randrange(len(out))
        kind = RNG.randrange(3)
        if kind == 0:
            out[k] = "new" + str(RNG.randrange(10**6))
        elif kind == 1:
            out.insert(k, RNG.choice(VOCABULARY))
        elif len(out) > 1:
            del out[k]
    return out


def test_recall_at_the_limit_and_no_false_leaks(spark):
    items = [(k, " ".join(RNG.choices(VOCABULARY, k=RNG.randrange(8, 60)))) for k in range(60)] + [(100, " ".join(RNG.choices(VOCABULARY, k=150)))]
    docs, planted = [], set()
    for k, text in items:
        words = text.split()
        for _ in range(8):
            noise = [" ".join(RNG.choices(VOCABULARY, k=RNG.randrange(200))) for _ in range(2)]
            planted.add((len(docs), k))
            docs.append(f"{noise[0]} {' '.join(edited(words, int(EDITS * len(words))))} {noise[1]}")
    docs += [" ".join(RNG.choices(VOCABULARY, k=400)) for _ in range(50)]
    docs, bench = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in leaks(docs, bench).collect()}
    assert len(found & planted) >= 0.95 * len(planted)
    assert found <= planted


def test_long_items_with_all_edits_in_the_head(spark):
    items = [(k, RNG.choices(VOCABULARY, k=300)) for k in range(10)]
    docs = []
    for k, words in items:
        head = list(words)
        for at in RNG.sample(range(100), 55):
            head[at] = f"new{at}"
        tail = list(words)
        for at in RNG.sample(range(200, 300), 55):
            tail[at] = f"new{at}"
        docs += [(k, f"{' '.join(RNG.choices(VOCABULARY, k=90))} {' '.join(head)} end"), (100 + k, " ".join(tail)), (200 + k, " ".join(head[:100] + [f"x{j}" for j in range(6)] + head[106:]))]
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in items], "item_id long, text string")
    found = {(r.doc_id, r.item_id): r.distance for r in leaks(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    assert found == {(d + k, k): 55 for k in range(10) for d in (0, 100)}


def test_recall_of_long_items_at_the_limit(spark):
    items = [(n * 100 + k, RNG.choices(VOCABULARY, k=n)) for n in (65, 70, 127, 300, 1000) for k in range(8)]
    docs, planted = [], set()
    for k, words in items:
        for _ in range(3):
            planted.add((len(docs), k))
            docs.append(f"{' '.join(RNG.choices(VOCABULARY, k=70))} {' '.join(edited(words, int(EDITS * len(words))))} {' '.join(RNG.choices(VOCABULARY, k=30))}")
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in items], "item_id long, text string")
    rows = leaks(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), bench).collect()
    found = {(r.doc_id, r.item_id) for r in rows}
    assert found <= planted and len(found) >= 0.95 * len(planted)
    for r in rows[:20]:
        text, item = (word_hashes(pa.array([t]))[0] for t in (docs[r.doc_id], " ".join(dict(items)[r.item_id])))
        assert (r.distance, r.first_word, r.end_word) == tuple(int(x[0]) for x in nearest(item, [text]))


def test_candidates_come_from_the_walks(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "x y " + " ".join(VOCABULARY[:20]) + " z")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, " ".join(VOCABULARY[:20]))], "item_id long, text string")
    assert leaks(docs, bench).count() == 1
    monkeypatch.setattr(decontaminate, "_keyed", lambda rows, name: rows.select(name, F.lit(None).cast("long").alias("key")))
    assert leaks(docs, bench).count() == 0


def test_nearest_is_the_edit_distance_to_a_stretch():
    rng = random.Random(2)
    for _ in range(300):
        item, *regions = (np.array([rng.randrange(1, 5) for _ in range(rng.randrange(low, 9))], np.uint64) for low in (1, 0, 1, 1))
        got = list(zip(*(x.tolist() for x in nearest(item, regions))))
        assert got == [within(item, r) for r in regions]


def within(item, region):
    """Least edit distance to a stretch, with the stretch, cell by cell."""
    row = [(0, j) for j in range(len(region) + 1)]
    for i, word in enumerate(item.tolist()):
        new = [(i + 1, 0)]
        for j, other in enumerate(region.tolist()):
            new.append(min((row[j][0] + (word != other), row[j][1]), (row[j + 1][0] + 1, row[j + 1][1]), (new[j][0] + 1, new[j][1])))
        row = new
    (distance, start), stop = min((x, j) for j, x in enumerate(row))
    return distance, start, stop


def test_against_brute_force_on_the_small_tables(spark):
    sf = "/root/testdata/sf0.001"
    docs, bench = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    items = {r.item_id: word_hashes(pa.array([r.text]))[0] for r in bench.collect()}
    expected = set()
    for r in docs.collect():
        own = word_hashes(pa.array([r.text or ""]))[0]
        present = set(own.tolist())
        for k, w in items.items():
            limit = int(EDITS * len(w))
            if len(w) and sum(x in present for x in w.tolist()) >= len(w) - limit and within(w, own)[0] <= limit:
                expected.add((r.doc_id, k))
    got = {(r.doc_id, r.item_id) for r in leaks(docs, bench).collect()}
    assert got == expected and expected
    clean = decontaminated(docs, bench)
    assert clean.columns == docs.columns
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in docs.collect()} - {d for d, _ in expected}


def test_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 2), (3, "a b c d e f g h i j " * 3000, 3), (3, "a b c d e f g h i j", 3), (None, "A, b! c d e f g h i j", 4)], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(7, "a b c d e f g h i j"), (7, "a b c d e f g h i j"), (8, None), (9, "")], "item_id long, text string")
    assert sorted((r.doc_id or 0, r.item_id, r.distance) for r in leaks(docs, bench).collect()) == [(0, 7, 0), (3, 7, 0), (3, 7, 0)]
    assert leaks(docs.limit(0), bench).count() == 0 and leaks(docs, bench.limit(0)).count() == 0


def test_hot_passages_clashing_columns_and_types(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT", 3)
    monkeypatch.setattr(decontaminate, "SALTED", 4)
    item = " ".join(VOCABULARY[:12])
    rows = [(k, f"lead {k} {item} tail {k}", k, "m") for k in range(30)] + [(100 + k, item, k, "m") for k in range(20)] + [(200 + k, f"nothing {k}", k, "m") for k in range(5)] + [(300, None, 1, "m"), (301, "", 1, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row int, mark string")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert sorted((r.doc_id, r.distance) for r in leaks(docs, bench).collect()) == [(k, 0) for k in range(30)] + [(100 + k, 0) for k in range(20)]
    out = decontaminated(docs, bench)
    assert out.schema == docs.schema and sorted(tuple(r) for r in out.collect() if r.doc_id < 300) == rows[50:55] and out.count() == 7
    assert decontaminated(docs, bench.limit(0)).count() == len(rows)
