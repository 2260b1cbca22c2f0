import hashlib
import random
import time

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from spliceloom.llm.bpe import SegmentTreeBPE, decoded, encoded

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    "", "Hello, WORLD!!  it's 2024 we'll", "a" * 3000, "naïve Éléphant ΟΔΥΣΣΕΥΣ Straße İstanbul", "x<|endoftext|>y <|startoftext|>",
    "é́ é ½ ² ٣ 中文字 emoji 😀😀     z", "tab\tnew\nline\x1cfs\x85nel", "''s 't 'RE 'd", "&&&%%% $$$### \x00 nul",
]


@pytest.fixture(scope="module")
def own():
    return SegmentTreeBPE(PATH)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_same_ids_as_the_library(own, library):
    ids, texts = own.encode(TEXTS)
    for text, x, back in zip(TEXTS, ids, texts):
        expected = library.encode(text, add_special_tokens=False).ids
        assert x.tolist() == expected, text
        assert back == library.decode(expected, skip_special_tokens=False)
        assert own.decode(expected) == back


def test_cache_is_dropped_without_changing_results(library):
    small = SegmentTreeBPE(PATH)
    small.KEEP = 1
    for text in TEXTS * 2:
        assert small.encode([text])[0][0].tolist() == library.encode(text, add_special_tokens=False).ids


def test_documents_against_the_library(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = {r.doc_id: r for r in encoded(docs, PATH, digests=True).collect()}
    for r in docs.collect():
        ids = library.encode(r.text, add_special_tokens=False).ids
        got = rows[r.doc_id]
        assert got.n_tokens == len(ids)
        assert got.ids_sha256 == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
        assert got.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_nulls_repeats_and_other_columns(spark):
    docs = spark.createDataFrame([(1, None, 5), (1, None, 5), (2, "", 6), (None, "Word word", 7)], "doc_id long, text string, ids int")
    rows = sorted(encoded(docs, PATH).collect(), key=lambda r: (r.doc_id is None, r.doc_id))
    assert [(r.doc_id, len(r.ids), r.decoded) for r in rows] == [(1, 0, ""), (1, 0, ""), (2, 0, ""), (None, 2, "word</w> word</w>")]
    assert decoded(encoded(docs, PATH), PATH).where("decoded like 'word%'").count() == 1
    assert encoded(docs.limit(0), PATH).count() == 0


def test_long_words_take_seconds(own, library):
    rng = random.Random(3)
    begun = time.time()
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(n)) for n in (60, 64, 65, 1000, 4097, 200_000)] + ["ab" * 50_000, "é" * 3000]
    ids, _ = own.encode(words)
    assert time.time() - begun < 60
    for text, x in zip(words, ids):
        assert x.tolist() == library.encode(text, add_special_tokens=False).ids
