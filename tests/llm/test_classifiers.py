import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa

from spliceloom.llm import quality, toxicity

SF = "/root/testdata/sf0.1"  # enough toxic texts to learn from and to hold out


def _held_out(spark, scored, label, folds, out):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    truth = {r.doc_id: r[label] for r in labels.collect()}
    rows = scored(docs, labels).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == out) and 0 <= r.score <= 1
    return [(r.predicted, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]


def test_quality_on_held_out_rows(spark):
    pairs = _held_out(spark, quality.scored, "quality", 3, 1)
    assert np.mean([p == y for p, y in pairs]) > 0.97


def test_toxicity_on_held_out_rows(spark):
    pairs = _held_out(spark, toxicity.scored, "toxic", 4, 2)
    both = sum(p and y for p, y in pairs)
    assert both / sum(y for _, y in pairs) > 0.8 and both / sum(p for p, _ in pairs) > 0.85


def test_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, "a"), (1, None, "a"), (2, "", "b"), (None, "x " * 50_000, "c")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, None, None), (2, 1, 0), (None, 0, 1)], "doc_id long, quality int, toxic int")
    for scored, default in ((quality.scored, 0.5), (toxicity.scored, 0.0)):
        rows = scored(docs, labels).collect()
        assert len(rows) == 4 and {r.score for r in rows} == {default}
        assert scored(docs.limit(0), labels.limit(0)).count() == 0
    assert quality.filtered(docs, labels).columns == docs.columns


def test_gradients_by_finite_differences():
    net = toxicity.BiGRU()
    words = toxicity.Words(pa.array(["one two three four", "five", "", "two five six"]))
    owner, first, sizes = words.windows()
    index = toxicity.Toxicity._index(words, first, sizes)
    wanted, weight = np.array([1, 0, 0, 1]), np.ones(4, np.float32)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}

    def loss():
        p = 1 / (1 + np.exp(-net.logits(net.gates(net.inputs(words)), index, sizes)))
        return -np.mean(wanted * np.log(p) + (1 - wanted) * np.log(1 - p))

    g = net.gradients(words, net.inputs(words), index, sizes, wanted, weight)
    for name in ("xf", "ub", "gf", "v", "o", "c"):
        flat, base = net.w[name].reshape(-1), g[name].reshape(-1)
        for k in (0, len(flat) // 2, len(flat) - 1):
            old = flat[k]
            flat[k] = old + 1e-3
            up = loss()
            flat[k] = old - 1e-3
            down = loss()
            flat[k] = old
            assert abs((up - down) / 2e-3 - base[k]) < 2e-3, name


def test_every_byte_of_a_long_run_is_read():
    import pyarrow as pa

    from spliceloom.llm.toxicity import LONGEST, Words

    texts = ["short words", None, "x" * 200 + "end", "\u6587" * 50 + "\u5b57"]
    words, same = (Words(pa.array([*texts[:3], t], pa.large_string())) for t in (texts[3], texts[3][:-1] + "\u6587"))
    assert list(words.bounds) == [0, 2, 2, 6, 9]
    assert words.pairs.max() <= LONGEST + 3 and sorted(words.bucket.tolist()) != sorted(same.bucket.tolist())
    assert list(np.bincount(words.own)) == words.pairs.tolist()


def test_stretches_of_a_long_text_have_its_windows(monkeypatch):
    rng = random.Random(8)
    words = ["w%d" % rng.randrange(50) if rng.random() < 0.8 else rng.choice(["é", "文字", "x" * 150, "-", " "]) for _ in range(4000)]
    text = "".join(w + rng.choice([" ", "  ", ",\n"]) for w in words) + " " * 3000 + "tail end"

    def windows(t):
        own = toxicity.Words(pa.array([t], pa.large_string()))
        _, first, sizes = own.windows()
        kinds = own.bucket[own.kind].tolist()
        return [tuple(kinds[a : a + n]) for a, n in zip(first.tolist(), sizes.tolist())]

    parts = list(toxicity.stretches(text, 700))
    assert len(parts) > 10 and [w for p in parts for w in windows(p)] == windows(text)
    model = toxicity.Toxicity(["vile words here", "plain words here"] * 20, np.array([1, 0] * 20))
    whole = model.score(pa.array([text], pa.large_string()))
    monkeypatch.setattr(toxicity, "STRETCH", 900)
    assert abs(model.score(pa.array([text], pa.large_string())) - whole).max() < 1e-6


def test_training_takes_as_many_steps_whatever_the_sample(monkeypatch):
    steps = []
    adam = toxicity.Toxicity._adam
    monkeypatch.setattr(toxicity.Toxicity, "_adam", lambda self, g, moments, step: (steps.append(step), adam(self, g, moments, step)))
    for n in (10, 700):
        steps.clear()
        toxicity.Toxicity([f"w{k} vile" if k % 4 == 0 else f"w{k} plain" for k in range(n)], np.array([int(k % 4 == 0) for k in range(n)]))
        assert len(steps) == toxicity.STEPS


def _forward(net, text):
    """The logit of a text word by word, window by window, in plain loops."""
    spans = [m.span() for m in re.finditer(rb"[0-9a-z\x80-\xff]+", text.encode().lower())]
    words = [text.encode().lower()[s:e] for s, e in spans]
    if not words:
        return -30.0
    sig = lambda x: 1 / (1 + math.exp(-x))
    n, w = toxicity.HIDDEN, {k: v.astype(float) for k, v in net.w.items()}

    def inputs(word):
        bucket = int(toxicity.Words(pa.array([word.decode()], pa.large_string())).bucket[0])
        padded = [0, *word, 0]
        chars = [w["char"][(a * 31 + b * 257) % toxicity.PAIRS] for a, b in zip(padded, padded[1:])]
        return [*net.odds[bucket], *w["word"][bucket], *(sum(c) / len(chars) for c in zip(*chars))]

    def direction(xs, d):
        h, out = [0.0] * n, []
        for x in xs:
            g = [sum(x[i] * w[f"x{d}"][i][j] for i in range(len(x))) + w[f"g{d}"][j] for j in range(3 * n)]
            u = [sum(h[i] * w[f"u{d}"][i][j] for i in range(n)) for j in range(3 * n)]
            z, r = ([sig(g[k * n + j] + u[k * n + j]) for j in range(n)] for k in (0, 1))
            c = [math.tanh(g[2 * n + j] + r[j] * u[2 * n + j]) for j in range(n)]
            h = [z[j] * h[j] + (1 - z[j]) * c[j] for j in range(n)]
            out.append(h)
        return out

    best = -math.inf
    for start in range(0, max(1, len(words) - (toxicity.WINDOW - toxicity.STRIDE)), toxicity.STRIDE):
        xs = [inputs(x) for x in words[start : start + toxicity.WINDOW]]
        states = [a + b for a, b in zip(direction(xs, "f"), direction(xs[::-1], "b")[::-1])]
        marks = [math.exp(sum(a * b for a, b in zip(s, w["v"]))) for s in states]
        pooled = [sum(m * s[j] for m, s in zip(marks, states)) / sum(marks) for j in range(2 * n)]
        best = max(best, sum(a * b for a, b in zip(pooled, w["o"])) + w["c"][0])
    return best


def _tainted(rng, k):
    words = [f"w{rng.randrange(60)}" for _ in range(rng.randrange(70))]
    if k % 4 == 0:
        words[rng.randrange(len(words) + 1) :] = ["vile", f"scum{k % 3}"]
    return " ".join(words)


def test_toxicity_scores_by_a_plain_forward_pass(spark):
    rng = random.Random(1)
    rows = [(k, _tainted(rng, k), int(k % 4 == 0)) for k in range(400)]
    extra = [(900, None, None), (901, "", None), (902, " \t", None), (903, "w1 " * 40 + "vile scum1", None), (None, "vile scum2", None), (4, rows[4][1], None), (4, rows[4][1], None)]
    docs = spark.createDataFrame([(i, t, 0.5, "x") for i, t, _ in rows + extra], "doc_id long, text string, score double, held_out string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(0, 1), (0, 0), (None, 1), (7, None)], "doc_id long, toxic int")
    model = toxicity.learned(docs, labels)
    found = toxicity.scored(docs, labels).collect()
    assert len(found) == len(rows) + len(extra) and {r.held_out for r in found if r.doc_id is None} == {None}
    by_id = {r.doc_id: r for r in found}
    for i, t, _ in rows[:25] + extra:
        plain = _forward(model.net, t or "")
        assert abs(by_id[i].score - 1 / (1 + math.exp(-plain - model.shift))) < 1e-3
    assert by_id[903].predicted == by_id[None].predicted == 1 and by_id[900].predicted == by_id[901].predicted == 0
    held = [(by_id[i].predicted, y) for i, _, y in rows if by_id[i].held_out]
    assert sum(p == y for p, y in held) / len(held) > 0.9


def _plain_features(text):
    data = (text or "").encode()
    n, words = max(len(data), 1), data.lower().split()
    share = lambda members: sum(b in members for b in data) / n
    out = [share(c) for c in quality._CLASSES]
    out.append(out[4] / max(out[4] + out[8], 1 / n))
    many = max(len(words), 1)
    out.append(sum(a == b for a, b in zip(words, words[1:])) / many)
    out.append((len(words) - len(set(words))) / many / math.log(many + 2))
    sizes = [len(x) for x in words]
    out += [sum(sizes) / many / 10, *(sum(map(test, sizes)) / many for test in (lambda x: x <= 3, lambda x: x == 1, lambda x: x > 20))]
    return out + [math.log1p(len(words)) / 10, float(not words)]


def test_quality_scores_by_a_plain_pair_fit(spark):
    rng = random.Random(6)
    good = lambda: " ".join(rng.choice(["some", "plain", "words", "stand", "here", "today."]) for _ in range(rng.randrange(5, 40)))
    bad = lambda: " ".join(rng.choice(["BUY!!!", "$$$", "click|here", "win 1000"]) for _ in range(rng.randrange(1, 40)))
    rows = [(k, bad() if k % 3 == 0 else good(), int(k % 3 > 0)) for k in range(200)]
    extra = [(900, None, None), (901, "", None), (902, "long words " * 5000, None), (5, rows[5][1], None), (None, rows[0][1], None)]
    docs = spark.createDataFrame([(i, t, "s", 9) for i, t, _ in rows + extra], "doc_id long, text string, score string, label int")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (3, None)], "doc_id long, quality int")
    model = quality.learned(docs, labels)
    used = [(t, y) for i, t, y in rows if zlib.crc32(str(i).encode()) % 3 != 1]
    standard = lambda t: [min(max((x - m) / s, -6), 6) for x, m, s in zip(_plain_features(t), model.mean, model.scale)]
    strong = lambda w, z: sum(a * b for a, b in zip(w, z))
    pairs = [([a - b for a, b in zip(standard(t), standard(u))]) for t, y in used if y for u, v in used if not v][:4000]

    def loss(w):  # of preferring the good text of each pair, with the ridge
        return sum(math.log1p(math.exp(-strong(w, d))) for d in pairs) / len(pairs) + 5e-4 * strong(w, w)

    own = loss(model.weights)
    assert own < 0.2 and own < loss(model.weights * 0.9) + 1e-3 and own < loss(-model.weights)
    by_id = {r.doc_id: r for r in quality.scored(docs, labels).collect()}
    for i, t, _ in rows + extra:
        plain = 1 / (1 + math.exp(-min(max(model.slope * (strong(model.weights, standard(t)) - model.cut), -30), 30)))
        assert abs(by_id[i].score - plain) < 1e-6 and by_id[i].predicted == (plain >= 0.5)
    held = [(by_id[i].predicted, y) for i, _, y in rows if by_id[i].held_out]
    assert held and all(p == y for p, y in held)
    kept = quality.filtered(docs, labels)
    assert kept.schema == docs.schema
    assert sorted((r.doc_id or -1, r.text or "") for r in kept.collect()) == sorted((i or -1, t or "") for i, t, _ in rows + extra if by_id[i].score >= 0.5)
