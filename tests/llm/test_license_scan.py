import re
import time

from spliceloom.llm.license_scan import BASE, FAMILIES, HEADERS, NAMES, NOTICES, REACH, SENTENCES, SHORT, rules, scanned

TEXTS = [
    None, "", "  ", "no licence at all here",
    "Licensed under the Apache License, Version 2.0.", "This work is licensed under the GNU General Public License, version 3 or any later version",
    "CC BY-NC 4.0, cc-by 2; and MIT license MIT LICENSE!", "Permission is hereby granted, free of charge. See the MIT License. Copyright (c) 2020",
    "été MIT License 文字 GNU  General\nPublic-License", "SPDX-License-Identifier: Apache-2.0", "3-clause BSD License",
    "the mit licensed", "cc by cc by cc by", "word " * 5000 + "apache license " + "end " * 500 + "cc by",
]


RULES = [r | {"match": re.compile(f"({r['pattern']})(?= )").match} for r in rules()]


def brute(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places = [(i, label) for i in range(len(words)) for p, label in BASE.items() if words[i : i + len(p.split())] == p.split()]
    hits = []
    for i in range(len(words)):
        ahead = " ".join(words[i : i + REACH]) + " "
        best = max(((len(m[1].split()), -r["priority"]) for r in RULES if (m := r["match"](ahead))), default=None)
        if best:
            hits.append((i, i + best[0], -best[1]))
    kept = [h for k, h in enumerate(hits) if not any(e[1] >= h[1] for e in hits[:k])]
    labels = {RULES[r]["label"] for _, _, r in kept} | {x for _, x in places}
    return len(words), len(places), min(places)[0] if places else None, max(places)[0] if places else None, ",".join(sorted({x for _, x in places})), ",".join(sorted(labels)), len(kept)


def test_against_brute_force(spark):
    docs = spark.createDataFrame([(i, t, 9) for i, t in enumerate(TEXTS)], "doc_id long, text string, words int")
    out = {r.doc_id: r for r in scanned(docs).collect()}
    for i, text in enumerate(TEXTS):
        r = out[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.n_detections) == brute(text), text
        assert 0 <= r.score <= 1 and (r.score > 0) == bool(r.labels)


def test_repeats_and_empty_table(spark):
    docs = spark.createDataFrame([(None, "MIT license"), (1, "x"), (1, "x")], "doc_id long, text string")
    assert scanned(docs).count() == 3
    assert scanned(docs.limit(0)).count() == 0


def test_hundreds_of_rules_with_reachable_anchors():
    written_out = len(FAMILIES) + sum((x is not None) + (y is not None) for _, x, y in SHORT) + len(HEADERS) + len(NOTICES) + len(NAMES) + len(SENTENCES)
    assert written_out > 250 and len(rules()) > 800
    assert all(r["anchors"] and len(r["pattern"].split()) < 2 * REACH for r in rules())


SHORT_NAMES = [
    ("GPLv3", "gpl"), ("GNU GPL version 2", "gpl"), ("GPL-3.0-or-later", "gpl"), ("LGPL-2.1", "lgpl"), ("AGPLv3", "agpl"), ("BSD-3-Clause", "bsd"), ("MPL 2.0", "mpl"),
    ("Apache-2.0", "apache"), ("License: MIT", "mit"), ("license = ISC", "isc"), ("SPDX-License-Identifier: Apache-2.0", "apache"), ("SPDX-License-Identifier: MIT", "mit"),
    ("SPDX-License-Identifier: BSD-2-Clause", "bsd"), ("SPDX-License-Identifier: CC-BY-SA-4.0", "cc-by,cc-by-sa"), ("SPDX-License-Identifier: LGPL-2.1-only", "lgpl"),
    ("Neither the name of the owner", "bsd"), ("ein Wort mit vielen", ""), ("Apache 2.4 server", ""), ("SPDX-License-Identifier: Foo-1.0", "spdx"),
]


def test_every_written_rule_is_reached(spark):
    shown = [(label, p) for label, p in NAMES] + [(label, p) for p, label, _ in HEADERS + NOTICES + SENTENCES]
    plain = lambda p: re.sub(r"\(([^()|]*)[^()]*\)", r"\1", re.sub(r"\([^()]*\)\?", "", re.sub(r"\(( [^()]*)\([^()]*\)\?\)\?", "", p))).replace("[sc]", "s").replace(" ?", " ").replace("?", "").replace("{2}", "21").replace("[0-9]21", "21").replace("+", "")
    texts = [(k, f"word {plain(p)} here", label) for k, (label, p) in enumerate(shown) if not re.search(r"[\[\](|){}]", plain(p))]
    assert len(texts) > 0.95 * len(shown)
    out = {r.doc_id: r for r in scanned(spark.createDataFrame([t[:2] for t in texts], "doc_id long, text string")).collect()}
    for k, text, label in texts:
        assert out[k].labels == brute(text)[5] and out[k].n_detections > 0, text


def test_long_text_of_anchors_takes_seconds(spark):
    begun = time.time()
    docs = spark.createDataFrame([(1, "see the license " * 20_000), (2, "mit license here " * 5_000)], "doc_id long, text string")
    assert {r.doc_id: (r.n_detections, r.n_base) for r in scanned(docs).collect()} == {1: (0, 0), 2: (5000, 5000)}
    assert time.time() - begun < 60


def test_short_names_ids_and_headers(spark):
    docs = spark.createDataFrame([(i, f"word {t} here") for i, (t, _) in enumerate(SHORT_NAMES)], "doc_id long, text string")
    out = {r.doc_id: r for r in scanned(docs).collect()}
    for i, (text, labels) in enumerate(SHORT_NAMES):
        assert out[i].labels == labels == brute(f"word {text} here")[5], text
