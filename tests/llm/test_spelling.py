import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from spliceloom.llm import spelling as s

SCHEMA = "doc_id long, text string"


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute(rows, least=5, times=3, every=97):
    count = Counter()
    for i, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w)
            h = zlib.crc32(f"{i}:{w}".encode())
            if every and i is not None and h % every == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            count[w] += 1
    count = {w: n for w, n in count.items() if len(w) >= least and n >= times}
    near = {w: [x for x in count if one_edit(w, x)] for w in count}
    form = {}
    for w, n in count.items():
        best = min(near[w], key=lambda x: (-count[x], x), default=None)
        form[w] = best if best is not None and count[best] >= 2 * n else None
    out = []
    for w in count:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, count[w], len(near[w]), count[form[w]] if form[w] else None))
    return sorted(out)


def result(df):
    return sorted(map(tuple, df.collect()))


def _corpus(seed, n):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abé") for _ in range(rng.randint(4, 9))) for _ in range(120)]
    base += ["".join(rng.choice("lmnopqrst×ÿ") for _ in range(rng.randint(5, 30))) for _ in range(60)]
    for w in base[:]:
        k = rng.randrange(len(w))
        base += [w[:k] + w[k + 1 :], w[:k] + rng.choice("abz") + w[k:], w[:k] + "x" + w[k + 1 :]]
    return [(k, " ".join(rng.choice(base).upper() if rng.random() < 0.2 else base[int(len(base) * rng.random() ** 3)] for _ in range(120))) for k in range(n)]


@pytest.mark.parametrize("most", [s.LIST, 6])
def test_same_words_as_brute_force(spark, most):
    rows = _corpus(1, 60) + [(900, None), (901, ""), (902, "12 ;; 3"), (None, "abaab abaab abaab ABAAB"), (903, "house House HOUSE houses houses houses hous hous hous house house house house")]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert result(s.spelling_variants(docs, every=97, most=most)) == brute(rows)


def test_misspellings_without_a_hash_chains_and_ties(spark):
    words = ["aaaaa"] * 24 + ["aaaab"] * 12 + ["aaabb"] * 6 + ["aabbb"] * 3 + ["zzzzz"] * 3 + ["zzzzy"] * 6 + ["zzzzx"] * 6 + ["É" + "tudes"] * 3 + ["é" + "tudes"] * 9 + ["q" * 3000] * 7 + ["q" * 2999] * 3
    rows = [(k, w) for k, w in enumerate(words)]
    out = {r.word: r for r in s.spelling_variants(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [tuple(r) for r in sorted(out.values())] == brute(rows, every=None)
    assert out["aabbb"].root == "aaaaa" and out["zzzzz"].form == "zzzzx" and out["Études"].form == "études" and out["q" * 2999].root == "q" * 3000


def test_hot_lists_are_dealt_out_again_and_lose_nothing(spark):
    rng = random.Random(4)
    words = sorted({"prefixprefix" + "".join(rng.choice("abcd") for _ in range(rng.randint(4, 6))) + "suffix" for _ in range(900)})
    table = spark.createDataFrame([(w, 3) for w in words], "word string, n long")
    tables = list(s.lists(table, 40))
    assert len(tables) > 2
    assert all(r["count"] <= 40 or r.list.split(":")[0] == "1" for t in tables[:-1] for r in t.groupBy("list").count().collect())
    assert {(r.word, r.near) for r in s.near_pairs(table, 40).collect()} == {(a, b) for a in words for b in words if one_edit(a, b)}


def test_one_list_equals_plain_comparison():
    rng = random.Random(7)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(0, 6))) for _ in range(90)})
    sizes = np.array([len(w) for w in words])
    letters = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    for block in (3, 1000):
        i, j = s.near_words(letters, np.cumsum(sizes) - sizes, sizes, np.zeros(len(words), np.int64), block)
        assert {(words[a], words[b]) for a, b in zip(i, j)} == {(a, b) for a in words for b in words if one_edit(a, b)}


def test_empty_table_and_other_columns(spark):
    assert result(s.spelling_variants(spark.createDataFrame([], SCHEMA))) == []
    docs = spark.createDataFrame([(1, "words words words", 1, "x", 2)], "doc_id int, text string, n int, word string, form int")
    assert result(s.spelling_variants(docs)) == [("words", None, "words", 3, 0, None)]
