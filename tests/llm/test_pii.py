import hashlib
import math
import random
import re
import time
from collections import Counter

import pyarrow as pa

from spliceloom.llm import pii


def brute(text):
    """The contract's base spans, a plain pass per kind."""
    text, out = text or "", []
    rules = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda d, s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda d, s: all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda d, s: 14 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda d, s: 10 <= len(d) <= 15),
    ]
    for order, (kind, pattern, good) in enumerate(rules):
        out += [(m.start(), order, m.end(), kind) for m in re.finditer(pattern, text) if good(re.sub("[^0-9]", "", m[0]), m[0])]
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(out))


def test_base_spans_of_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    extra = spark.createDataFrame([(-1, None), (-2, ""), (-3, "a@b.c 1.2.3.4.5 999.1.1.1 4111 1111 1111 1111 +1 (017) 555-7713 +12 é@x.y" + " z" * 9000)], "doc_id long, text string")
    rows = {r.doc_id: r for r in pii.scanned(docs.select("doc_id", "text").union(extra)).collect()}
    for r in docs.select("doc_id", "text").union(extra).collect():
        expected, got = brute(r.text), rows[r.doc_id]
        assert got.base_sha256 == hashlib.sha256(expected.encode()).hexdigest()
        assert [got.n_email, got.n_ip, got.n_card, got.n_phone] == [sum(x.startswith(k) for x in expected.split(",")) for k in ("email", "ip", "card", "phone")]
        assert [x for x in got.spans.split(",") if x and not x.startswith("term")] == [x for x in expected.split(",") if x]


def _corpus(spark):
    rows = [(i, f"number {i} said agent nightjar{i % 2} wrote to bob{i % 2}@mail.example on day {i * 7}") for i in range(8)]
    rows += [(100 + i, f"number {i} said something plain on day {i} to agent smith") for i in range(200)]
    rows += [(400 + i, "one copied text names lonely at solo@mail.example here") for i in range(50)]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_terms_that_reveal_an_entity(spark):
    docs = _corpus(spark)
    found = pii.scanned(docs).collect()
    marked = {r.doc_id for r in found if r.n_term}
    assert marked == set(range(8))  # copies and common words disclose nothing
    clean = {r.doc_id: r.text for r in pii.sanitised(docs).collect()}
    assert "nightjar" not in clean[0] and "[TERM]" in clean[0] and "[EMAIL]" in clean[0] and "agent" in clean[0]
    assert clean[150] == "number 50 said something plain on day 50 to agent smith"


def test_many_terms_are_joined_instead_of_sent(spark, monkeypatch):
    docs = _corpus(spark)
    expected = sorted(map(tuple, pii.scanned(docs).collect()))
    monkeypatch.setattr(pii, "SENT", 0)
    assert sorted(map(tuple, pii.scanned(docs).collect())) == expected


def test_empty_table_repeats_and_columns(spark):
    docs = spark.createDataFrame([(1, "a@b.cd", 6, "s"), (1, "a@b.cd", 6, "s"), (None, None, None, None)], "doc_id long, text string, n_chars long, spans string")
    assert pii.scanned(docs).count() == 3 and pii.scanned(docs.limit(0)).count() == 0
    rows = pii.sanitised(docs).collect()
    assert sorted((r.text or "", r.n_chars or 0) for r in rows) == [("", 0), ("[EMAIL]", 7), ("[EMAIL]", 7)]


def test_copies_and_distance_leave_a_term_revealing(spark):
    far = "filler " * 20
    rows = [(i, f"note {i} that quillfeather has left for eve@mail.example here") for i in range(6)]
    rows += [(100 + i, rows[0][1]) for i in range(20)]  # copies of one of the six
    rows += [(200 + i, f"memo {i} by marshwiggle {far} is kept for {far} ann@mail.example") for i in range(4)]
    rows += [(300 + i, f"report {i} on nothing much at all {far}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    clean = {r.doc_id: r.text for r in pii.sanitised(docs).collect()}
    assert not [i for i, t in clean.items() if "quillfeather" in t or "marshwiggle" in t]
    assert all("filler" in clean[i] for i in clean if i >= 200)
    found = {(r.entity, r.met, r.n) for r in pii.revealing_terms(docs).collect()}
    assert ("email:eve@mail.example", 6, 6) in found and ("email:ann@mail.example", 4, 4) in found


def test_base_spans_of_random_texts():
    rng = random.Random(8)
    for alphabet in ("1.", "1. 2", "a@.", "a@.-1 ", "+1 ()-.", "ab@1.+%é_ -\n"):
        for _ in range(1500):
            text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(40)))
            assert pii._joined(pii.base_spans(text)) == brute(text), text


def test_long_runs_take_linear_time(spark):
    texts = ["1" * 5000 + ".1.1.1", "7" * 10**6, "a" * 10**6 + " b@c.de", ("a" * 999 + "@") * 1000, "1." * 500_000, "a@b.cd " * 100_000, "+" + "1 " * 500_000, "+1(" * 300_000]
    begun = time.time()
    rows = {r.doc_id: r for r in pii.scanned(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert time.time() - begun < 60
    assert [rows[i].n_email for i in range(8)] == [0, 0, 1, 0, 0, 100_000, 0, 0] and rows[0].n_ip == 0 and rows[4].n_ip == 125_000


def test_sanitised_keeps_types_and_clashing_columns(spark, monkeypatch):
    for kind, value, new in (("int", 6, 7), ("smallint", 6, 7), ("string", "six", "six"), ("double", 6.0, 6.0)):
        docs = spark.createDataFrame([(1, "a@b.cd", value, 1, "t")], f"doc_id long, text string, n_chars {kind}, id int, terms string")
        for sent in (100_000, 0):
            monkeypatch.setattr(pii, "SENT", sent)
            out = pii.sanitised(docs)
            assert out.schema == docs.schema and [tuple(r) for r in out.collect()] == [(1, "[EMAIL]", new, 1, "t")]


def test_revealing_terms_equal_those_of_plain_counts(spark):
    rng = random.Random(12)
    people = [(f"name{k}", f"p{k}@mail.org") for k in range(6)]
    texts = []
    for k in range(260):
        words = [f"w{int(40 * rng.random() ** 2)}" for _ in range(rng.randrange(1, 14))]
        name, address = people[k % 6] if k % 9 == 0 else rng.choice(people)
        if k % 9 == 0:
            words += [name.upper(), address, "shared"]
        elif rng.random() < 0.15:
            words += [rng.choice([name, address, "10.0.0.7"])]
        rng.shuffle(words)
        texts.append(", ".join(words))
    texts += texts[:40] + [texts[9]] * 30 + [None, "", " "]
    distinct = {t or "" for t in texts}
    named = {t: {f"{kind}:{t[a:b].lower()}" for a, b, kind in pii.base_spans(t)} for t in distinct}
    held = {t: {w.lower() for w in pii._WORD.findall(pii._without_entities(t))} for t in distinct}
    of = lambda kept: Counter(x for t in distinct for x in kept[t])
    n, m, total = of(held), of(named), len(distinct)
    met = Counter((w, e) for t in distinct for w in held[t] for e in named[t])
    hashed = {int(pii._hashes(pa.array([w], pa.large_string()))[0].view("int64")[0]): w for w in n}
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    for support, share, bits in ((3, 0.5, 2.0), (2, 0.2, 1.0), (3, 0.5, 4.0)):
        expected = {(w, e, c, n[w]) for (w, e), c in met.items() if c >= support and c >= share * n[w] and math.log2(c * total / (n[w] * m[e])) >= bits}
        got = {(hashed[r.term], r.entity, r.met, r.n) for r in pii.revealing_terms(docs, support, share, bits).collect()}
        assert got == expected
        assert expected or bits == 4.0
