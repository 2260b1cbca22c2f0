import random

from spliceloom.llm.components import components
from spliceloom.llm import common, near_dedup
from spliceloom.llm.near_dedup import near_duplicates, one_of_each


def brute(texts, width, percent):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [(i, len(s), find(i)) for i, s in enumerate(sets)]


def test_against_brute_force_with_chains(spark):
    rng = random.Random(3)
    texts = []
    for _ in range(12):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(30, 90))]
        for _ in range(rng.randrange(1, 14)):
            texts.append(" ".join(base))
            if rng.random() < 0.8:  # each copy is edited from the one before: chains, not stars
                for _ in range(rng.randrange(1, 5)):
                    base[rng.randrange(len(base))] = f"e{rng.randrange(10**6)}"
    texts += ["", None, "  \t ", "One", "one", " x y", "a b", "A  b\n"]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, digest string").repartition(7)
    for width, percent in ((2, 80), (5, 80)):
        got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(docs, width, percent).collect())
        assert got == brute(texts, width, percent)


def test_repeated_rows_null_ids_and_empty_table(spark):
    docs = spark.createDataFrame([(3, "a b c d e f"), (3, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f")], "doc_id long, text string")
    rows = near_duplicates(docs).collect()
    assert sorted((r.doc_id or 0, r.component_id, r.kept) for r in rows if r.doc_id) == [(2, 2, True), (3, 2, False), (3, 2, False)]
    assert [(r.component_id, r.kept) for r in rows if r.doc_id is None] == [(None, True)]
    assert near_duplicates(docs.limit(0)).count() == 0


def test_components_of_a_long_path_and_a_hub(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, 101 + i) for i in range(40)] + [(7, 7), (None, 3)]
    found = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    assert found == {**dict.fromkeys(range(61), 0), **dict.fromkeys(range(100, 141), 100)}


def test_words_that_collide_under_polynomial_hashes_stay_apart(spark):
    one = "a"
    while len(one) < 1024:
        one += one.translate(str.maketrans("ab", "ba"))
    docs = spark.createDataFrame([(1, one), (2, one.translate(str.maketrans("ab", "ba"))), (3, one.upper()), (4, " ".join([one] * 9)), (5, " ".join([one] * 7))], "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id) for r in near_duplicates(docs, 2).collect()) == [(1, 1), (2, 2), (3, 1), (4, 4), (5, 4)]


def test_hot_shingles_and_copies_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT", 20)
    monkeypatch.setattr(near_dedup, "SALTED", 5)
    rng = random.Random(4)
    passage = " ".join(f"p{k}" for k in range(40))
    texts = [passage + " " + " ".join(f"w{rng.randrange(900)}" for _ in range(rng.randrange(1, 14))) for _ in range(60)] + [passage] * 30
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(docs, 2, 80).collect())
    assert got == brute(texts, 2, 80)


def test_one_of_each_keeps_the_same_row_of_a_repeated_id(spark):
    rows = [(1, "b c", "x"), (1, "a b", "z"), (1, "a b", "y"), (2, None, "n"), (2, "q", "m"), (None, "a b", "k"), (None, "a b", "k"), (3, "A  b", "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, digest string").repartition(3)
    got = [tuple(r) for r in one_of_each(docs).collect()]
    assert sorted(got, key=str) == sorted([(1, "a b", "y"), (2, None, "n"), (None, "a b", "k"), (None, "a b", "k")], key=str)
    assert one_of_each(docs.limit(0)).count() == 0


def test_one_band_key_and_one_hub_in_all_rows(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT", 20)
    monkeypatch.setattr(common, "DEALT", 5)
    rng = random.Random(6)
    base = [f"w{k}" for k in range(120)]
    texts = [" ".join(base)]
    for k in range(150):  # all near the first, so that all share its bands and it is a hub
        words = list(base)
        words[rng.randrange(120)] = f"e{k}"
        texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(docs, 2).collect())
    assert got == brute(texts, 2, 80) and {c for _, _, c in got} == {0}


def test_dealt_joins_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT", 10)
    monkeypatch.setattr(common, "DEALT", 1)
    rows = spark.createDataFrame([(k % 3 if k % 2 else 0, k) for k in range(200)] + [(None, 999)], "key int, x int")
    single = spark.createDataFrame([(0, "a"), (1, "b"), (1, "c"), (5, "d")], "key int, y string")
    counts = rows.groupBy("key").count().withColumnRenamed("count", "times")
    dealt = sorted(map(tuple, common.join_dealt(rows, single, "key", counts).collect()))
    assert dealt == sorted(map(tuple, rows.join(single, "key").collect()))
