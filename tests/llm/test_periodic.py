import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from spliceloom.llm import periodic as p

SCHEMA = "doc_id long, text string"


def brute_runs(words):
    """Every stretch, by each period in turn, that no neighbour extends and no smaller period fits."""
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(6, 4 * q):
                found.setdefault((i, length), q)
            i = j + 1
    return sorted((s, m, q) for (s, m), q in found.items())


def brute(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        q = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % q] for i, w in enumerate(words)]
    runs = brute_runs(words)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    dropped = {i for s, m, q in runs for i in range(s + q, s + m)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    four = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, n, len(runs), *four, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in dropped)))


def check(spark, rows):
    got = sorted(tuple(r)[:9] for r in p.periodic_runs(spark.createDataFrame(rows, SCHEMA), repeat=True).collect())
    assert got == sorted(brute(*r) for r in rows)


def test_same_runs_as_brute_force_on_small_alphabets(spark):
    rng = random.Random(3)
    rows = []
    for k in range(300):
        words = [rng.choice("abc"[: rng.randint(1, 3)]) for _ in range(rng.randint(0, 120))]
        for _ in range(rng.randint(0, 3)):
            at, part = rng.randint(0, len(words)), [rng.choice("abcdef") for _ in range(rng.randint(1, 12))]
            words[at:at] = (part * 9)[: rng.randint(len(part), 9 * len(part))]
        rows.append((k, " ".join(words)))
    check(spark, rows)


def test_runs_of_long_periods_and_copies(spark):
    rng = random.Random(5)
    part = [f"w{rng.randint(0, 400)}" for _ in range(150)]
    long = part * 5 + [f"x{k}" for k in range(300)] + part[:70] * 4 + part[:70][:31]
    rows = [(k, " ".join(long)) for k in range(12)] + [(20, "a " * 3000), (21, "a b " * 2000 + "c"), (22, " ".join(f"u{k}" for k in range(4000)))]
    check(spark, rows)


def test_white_space_nulls_and_ties(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "a a a a a"), (5, "a a a a a a"), (6, "A a A a A a"), (7, "x y " * 7), (8, "b\x0bb\x0cb\rb\nb\tb"), (9, "a b a b a b a b q c d c d c d c d"), (9, "é é é é é é é")]
    check(spark, rows)


def test_null_ids_empty_table_and_other_columns(spark):
    assert p.periodic_runs(spark.createDataFrame([], SCHEMA)).count() == 0
    docs = spark.createDataFrame([(None, "a a a a a a", "x", 1)], "doc_id long, text string, runs string, period int")
    row = p.periodic_runs(docs).first()
    assert (row.doc_id, row.n_runs, row.start, row.length, row.period, row.exponent_milli) == (None, 1, 0, 6, 1, 6000)


def test_every_distance_has_its_pair_in_the_cover():
    assert sorted((a - b) % p.MODULUS for a in p.COVER for b in p.COVER if a != b) == list(range(1, p.MODULUS))
    assert p._shift().max() < p.MODULUS


@pytest.mark.parametrize("n", [1, 5, 31, 32, 400])
def test_extensions_equal_plain_ones(n):
    rng = np.random.default_rng(n)
    words = np.append(np.resize(rng.integers(1, 4, max(1, n // 3)), n), 0)
    lce = p.LCE(words)
    i, j = (x.ravel() for x in np.meshgrid(np.arange(n + 1), np.arange(n + 1)))
    i, j = i[i != j], j[i != j]
    plain = [next((k for k in range(n + 1) if max(a, b) + k > n or words[a + k] != words[b + k])) for a, b in zip(i.tolist(), j.tolist())]
    assert lce(i, j).tolist() == plain
