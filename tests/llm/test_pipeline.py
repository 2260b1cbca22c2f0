import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

import corpus_pipeline
from spliceloom.llm import pii, quality
from spliceloom.llm.decontaminate import EDITS, word_hashes
from tests.llm.test_decontaminate import within
from tests.llm.test_near_dedup import brute

SF = "/root/testdata/sf0.001"


def test_against_a_brute_force_version(spark):
    read = lambda t: spark.read.parquet(f"{SF}/{t}.parquet")
    rows = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    model = quality.learned(read("documents"), read("labels"))
    docs = sorted((r.doc_id, r.text) for r in read("documents").collect())
    docs = [d for d, s in zip(docs, model.score(quality.features(pa.array([t for _, t in docs])))) if s >= 0.5]
    docs = [docs[i] for i, _, root in brute([t for _, t in docs], 5, 80) if i == root]
    items = [word_hashes(pa.array([r.text]))[0] for r in read("benchmark").collect()]
    limits = [int(EDITS * len(w)) for w in items]

    def leaks(text):
        own = word_hashes(pa.array([text]))[0]
        held = set(own.tolist())
        return any(sum(x in held for x in w.tolist()) >= len(w) - k and within(w, own)[0] <= k for w, k in zip(items, limits))

    docs = [(d, t) for d, t in docs if not leaks(t)]
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert set(rows) == {d for d, _ in docs}
    for d, t in docs:
        for start, end, kind in reversed(pii.base_spans(t)):
            t = t[:start] + f"[{kind.upper()}]" + t[end:]
        ids = library.encode(t, add_special_tokens=False).ids
        assert rows[d].ids == ids and rows[d].decoded == library.decode(ids, skip_special_tokens=False)


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).dtypes == docs.dtypes


def test_stages_on_nulls_repeats_empty_and_clashing_columns(spark, tmp_path):
    read = lambda t: spark.read.parquet(f"{SF}/{t}.parquet")
    item = read("benchmark").where("length(text) > 60").first().text
    rows = [(1, "a plain text of some words that stands here", "x"), (1, "a plain text of some words that stands here", "x"), (2, "a plain text of some words that stands here", "y"), (3, None, "z"), (4, "", None)]
    rows += [(5, f"before {item} after", "b"), (6, "write to bob@mail.example or 10.0.0.1 at once please", "e"), (None, "without a number", "n"), (None, None, None), (7, "long " * 30_000, "l")]
    schema = "doc_id long, text string, mark string"
    fields = [f"cast({v} as {t}) as {n}" for n, t, v in (("lang", "string", "'en'"), ("source", "string", "mark"), ("n_chars", "int", "length(text)"), ("id", "string", "mark"), ("root", "int", "1"), ("times", "int", "2"), ("kept", "boolean", "false"), ("label", "int", "3"))]
    docs = spark.createDataFrame(rows, schema).selectExpr("*", *fields)
    for name, stage in corpus_pipeline.STAGES[1:]:
        out = stage(spark, docs, SF)
        found = sorted((r.doc_id or 0, (r.asDict().get("text") or "")[:20]) for r in out.collect())
        if name == "bpe":
            assert len(found) == len(rows)
            continue
        assert out.dtypes == docs.dtypes, name
        expected = {"near_dedup": [0, 0, 1, 3, 4, 5, 6, 7], "decontamination": [0, 0, 1, 1, 2, 3, 4, 6, 7], "pii": [0, 0, 1, 1, 2, 3, 4, 5, 6, 7]}[name]
        assert [d for d, _ in found] == expected, name
        if name == "pii":
            sample = next(r for r in out.collect() if r.doc_id == 6)
            assert sample.text == "write to [EMAIL] or [IP] at once please" and sample.n_chars == len(sample.text)
        assert stage(spark, docs.limit(0), SF).count() == 0
    for table in ("documents", "labels", "benchmark"):
        (docs if table == "documents" else read(table).limit(0)).write.parquet(str(tmp_path / f"{table}.parquet"))
    assert sorted(r.doc_id or 0 for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == [0, 0, 1, 3, 4, 5, 6, 7]
