"""PII: personal data by pattern, and terms that corpus statistics show to reveal it.

Protected entities are the e-mail addresses, network addresses, card and phone numbers found by pattern. Terms
in a document that names an entity co-occur with it; over all distinct texts, the pointwise mutual information of
term and entity and the share of a term's texts that name the entity say how strongly the term discloses it. Terms beyond both
thresholds are spans of their own wherever they stand, and sanitising generalises them like the entities.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from spliceloom.llm.common import small_batches, text_bytes, unused
from spliceloom.llm.wordhash import words
from spliceloom.staging import written

KINDS = ("email", "ip", "card", "phone", "term")
#: Fixed patterns of the contract: email `[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+`, ip
#: `[0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)`, card and phone as they stand. The first two are found piecewise, as a search
#: for the whole pattern takes the square of a long run's length.
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WORD = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")
_GAP = np.ones(256, bool)
_GAP[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False

#: Distinct texts in which term and entity must meet, share of the term's texts that must name the entity, and
#: bits of mutual information, from which a term is held to disclose it.
SUPPORT, SHARE, BITS = 3, 0.5, 4.0
#: Terms or texts that are sent to every task at most; beyond that they are joined.
SENT = 100_000
#: One of so many shards of the texts tells which terms are common.
SHARDS = 8


def _luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: of each @, the run before it back to the last match, if a domain follows."""
    free = 0  # the end of the last match
    seen = 0  # after the last @
    while (at := text.find("@", seen)) >= 0:
        low = max(free, seen)
        before = _LOCAL.match(text[low:at][::-1])
        after = _DOMAIN.match(text, at + 1) if before else None
        if after:
            yield at - before.end(), after.end()
            free = after.end()
        seen = at + 1


def _addresses(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: each four parts of a run of numbers with single dots between."""
    for run in _DOTTED.finditer(text):
        parts, start = run[0].split("."), run.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = start + sum(map(len, four)) + 3
            if all(len(x := p.lstrip("0")) < 4 and int(x or 0) <= 255 for p in four):
                yield start, end
            start = end + 1


def _digits(found: str) -> str:
    return re.sub("[^0-9]+", "", found)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Start, end and kind of each pattern's valid matches, by start and then kind, in time linear in the text."""
    out = [(s, e, "email") for s, e in _emails(text)] + [(s, e, "ip") for s, e in _addresses(text)]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := _digits(m[0])) <= 19 and _luhn(d):
            out.append((m.start(), m.end(), "card"))
    if "+" in text:
        out += [(m.start(), m.end(), "phone") for m in _PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
    return sorted(out, key=_order)


def _order(span: tuple[int, int, str]) -> tuple[int, int, int]:
    return span[0], KINDS.index(span[2]), span[1]


def _hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the terms of texts, lower-cased, and each text's first term."""
    return words(*text_bytes(texts), _GAP)


def _without_entities(text: str) -> str:
    out, at = [], 0
    for start, end, _ in base_spans(text):
        if end > at:
            out += [text[at:start], " "]
            at = end
    return "".join(out) + text[at:] if out else text


def _member(values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Which of values are among wanted, which ascends."""
    return wanted[np.minimum(np.searchsorted(wanted, values), len(wanted) - 1)] == values if len(wanted) else np.zeros(len(values), bool)


def _distinct_pairs(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((second, first))
    first, second = first[order], second[order]
    new = np.ones(len(first), bool)
    new[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
    return first[new], second[new]


def _naming(texts: DataFrame) -> DataFrame:
    """entity, id: which texts name each entity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            rows = [(f"{kind}:{t[s:e].lower()}", i) for t, i in zip(batch.column("text").to_pylist(), batch.column("id").to_pylist()) for s, e, kind in base_spans(t)]
            rows = sorted(set(rows))
            yield pa.record_batch({"entity": pa.array([e for e, _ in rows], pa.string()), "id": pa.array([i for _, i in rows], pa.int64())})

    return texts.mapInArrow(run, "entity string, id long").distinct()


def _holding(texts: DataFrame, ids: list[int] | None = None, terms: list[int] | None = None, without: list[int] = ()) -> DataFrame:
    """term, id: which texts hold each term outside of entities; ids and terms narrow it, without leaves terms out."""
    ids, terms, without = (None if x is None else np.sort(np.array(x, np.int64)) for x in (ids, terms, without))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            keep = np.ones(batch.num_rows, bool)
            if ids is not None:
                keep = _member(batch.column("id").to_numpy(), ids)
            if terms is not None:
                found, bounds = _hashes(batch.column("text"))
                hits = np.concatenate(([0], np.cumsum(_member(found.view(np.int64), terms))))
                keep &= hits[bounds[1:]] > hits[bounds[:-1]]
            if not keep.any():
                continue
            batch = batch.filter(pa.array(keep))
            found, bounds = _hashes(pa.array([_without_entities(t) for t in batch.column("text").to_pylist()], pa.large_string()))
            found, own = found.view(np.int64), np.repeat(batch.column("id").to_numpy(), np.diff(bounds))
            keep = ~_member(found, without)
            if terms is not None:
                keep &= _member(found, terms)
            found, own = _distinct_pairs(found[keep], own[keep])
            yield pa.record_batch({"term": found, "id": own})

    return texts.mapInArrow(run, "term long, id long").distinct()


def _sent(column: DataFrame) -> list[int] | None:
    """The values of a column, or None where they are too many to send to all tasks."""
    few = [r[0] for r in column.limit(SENT + 1).collect()]
    return few if len(few) <= SENT else None


def revealing_terms(docs: DataFrame, support: int = SUPPORT, share: float = SHARE, bits: float = BITS) -> DataFrame:
    """term (hash of the lower-cased word) and entity for each term that discloses an entity, with met, n and pmi.

    All counts are of distinct whole texts, so that copies of a document count once: met of those that hold both, n of
    those that hold the term outside of entities, m of those that name the entity and N of all. pmi = log2(met * N / (n * m)).

    What is left out early cannot pass: met <= m and met <= n, so an entity needs support <= m <= N / 2**bits, and the
    texts of one shard of ids are a lower bound of n, by which the common terms go.
    """
    texts = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("id", F.xxhash64("text"))
    naming = written(_naming(texts), "naming")
    total = texts.select("id").distinct().count()
    whole = written(naming.groupBy("entity").agg(F.count("*").alias("m")).where((F.col("m") >= support) & (F.col("m") <= total / 2**bits)), "entities")
    most = whole.agg(F.max("m")).first()[0] or 0

    naming = naming.join(whole, "entity")
    ids = _sent(naming.select("id").distinct())
    without: list[int] = []
    if ids is None or ids:
        shard = _holding(texts.where(F.pmod("id", F.lit(SHARDS)) == 0)).groupBy("term").agg(F.count("*").alias("least"))
        least = written(shard.where(share * F.col("least") > support), "common")
        without = [r.term for r in least.where(share * F.col("least") > most).orderBy(F.desc("least"), "term").limit(SENT).collect()]
    else:
        least = texts.sparkSession.createDataFrame([], "term long, least long")
    pairs = _holding(texts, ids, without=without).join(naming, "id").groupBy("entity", "term").agg(F.count("*").alias("met"), F.first("m").alias("m"))
    pairs = pairs.where(F.col("met") >= support).join(least, "term", "left").where(F.col("met") >= share * F.coalesce("least", F.lit(0)))
    pairs = written(pairs.drop("least"), "pairs")

    terms = pairs.select("term").distinct()
    few = _sent(terms)
    held = _holding(texts, terms=few)
    if few is None:
        held = held.join(terms, "term", "left_semi")
    counts = held.groupBy("term").agg(F.count("*").alias("n"))
    pmi = F.log2(F.col("met") * F.lit(float(total)) / (F.col("n") * F.col("m")))
    found = pairs.join(counts, "term").withColumn("pmi", pmi)
    return found.where((F.col("met") >= share * F.col("n")) & (F.col("pmi") >= bits)).select("term", "entity", "met", "n", "pmi")


def spans_of(text: str, terms: set[int] | frozenset[int]) -> list[tuple[int, int, str]]:
    """Base spans and, outside of them, the words among terms."""
    base = base_spans(text)
    if not terms:
        return base
    places = [(m.start(), m.end(), m[0]) for m in _WORD.finditer(text)]
    found = _hashes(pa.array([w for _, _, w in places], pa.large_string()))[0].view(np.int64)
    taken = bytearray(len(text))
    for x, y, _ in base:
        taken[x:y] = b"\1" * (y - x)
    extra = [(s, e, "term") for (s, e, _), h in zip(places, found.tolist()) if h in terms and not any(taken[s:e])]
    return sorted(base + extra, key=_order)


def _with_spans(docs: DataFrame, act, schema) -> DataFrame:
    """Apply act(batch, spans of each text) to docs, with the terms sent to all tasks, or joined where there are many."""
    terms = written(revealing_terms(docs).select("term").distinct(), "terms")
    few = [r.term for r in terms.limit(SENT + 1).collect()]
    sent = np.sort(np.array(few, np.int64)) if len(few) <= SENT else None
    rows = docs.withColumn("text", F.col("text").cast("string"))
    key, own_terms = unused(rows, "id"), unused(rows, "terms")
    if sent is None:
        def each_term(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in small_batches(batches):
                found, bounds = _hashes(batch.column("text"))
                own = np.repeat(np.array(batch.column("id").to_pylist(), object), np.diff(bounds))
                yield pa.record_batch({"id": pa.array(own, pa.int64()), "term": found.view(np.int64)})

        held = rows.select(F.xxhash64("text").alias("id"), "text").mapInArrow(each_term, "id long, term long").distinct().join(terms, "term", "left_semi")
        held = held.groupBy(F.col("id").alias(key)).agg(F.collect_set("term").alias(own_terms))
        rows = rows.withColumn(key, F.xxhash64("text")).join(held, key, "left").drop(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            if sent is None:
                own = [frozenset(t or ()) for t in batch.column(own_terms).to_pylist()]
                batch = batch.drop_columns([own_terms])
            elif len(sent):
                found, bounds = _hashes(batch.column("text"))
                found = found.view(np.int64)
                hit = sent[np.minimum(np.searchsorted(sent, found), len(sent) - 1)] == found
                own = [frozenset(found[s:e][hit[s:e]].tolist()) for s, e in zip(bounds, bounds[1:])]
            else:
                own = [frozenset()] * len(texts)
            yield act(batch, texts, [spans_of(t, o) for t, o in zip(texts, own)])

    return rows.mapInArrow(run, schema)


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def scanned(docs: DataFrame) -> DataFrame:
    """Personal data in every row of docs (doc_id, text), one row per row.

    Columns: doc_id, n_email, n_ip, n_card, n_phone (base spans of each kind), base_sha256 (of kind:start:end of
    the base spans by start, then kind, comma-joined), spans (all spans, joined likewise, with kind term for
    revealing terms), n_term. Places are code points, the end is exclusive. A null text counts as empty and has no
    spans; repeated rows are scanned each, an empty table gives no rows, other columns are ignored.
    """

    def act(batch: pa.RecordBatch, texts: list[str], spans: list) -> pa.RecordBatch:
        counts = [Counter(k for _, _, k in s) for s in spans]
        out: dict = {"doc_id": batch.column("doc_id")}
        out |= {f"n_{k}": pa.array([c[k] for c in counts], pa.int64()) for k in KINDS[:4]}
        out["base_sha256"] = [hashlib.sha256(_joined([x for x in s if x[2] != "term"]).encode()).hexdigest() for s in spans]
        out["spans"] = pa.array([_joined(s) for s in spans], pa.string())
        out["n_term"] = pa.array([c["term"] for c in counts], pa.int64())
        return pa.record_batch(out)

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_term long"
    return _with_spans(docs.select(F.col("doc_id").cast("long"), "text"), act, schema)


def sanitised(docs: DataFrame) -> DataFrame:
    """docs with every span of text replaced by its kind in brackets, and n_chars, if it is a whole number, counted anew.

    Null and empty texts stay as they are, repeated rows are treated alike and an empty table gives no rows. All other
    columns are kept as they are, n_chars of another type among them; a text of another type becomes a string.
    """
    counted = docs.schema["n_chars"].dataType if "n_chars" in docs.columns and isinstance(docs.schema["n_chars"].dataType, IntegralType) else None
    docs = docs.withColumn("text", F.col("text").cast("string"))
    if counted is not None:
        docs = docs.withColumn("n_chars", F.col("n_chars").cast("long"))

    def clean(text: str, spans: list) -> str:
        out, at = [], 0
        for start, end, kind in spans:
            if end > at:
                out += [text[at : max(start, at)]] + ([f"[{kind.upper()}]"] if start >= at else [])
                at = end
        return "".join(out) + text[at:]

    def act(batch: pa.RecordBatch, texts: list[str], spans: list) -> pa.RecordBatch:
        new = [None if old is None else clean(t, s) for old, t, s in zip(batch.column("text").to_pylist(), texts, spans)]
        out = {name: batch.column(name) for name in batch.schema.names} | {"text": pa.array(new, pa.string())}
        if counted is not None:
            out["n_chars"] = pa.array([None if n is None else len(n) for n in new], pa.int64())
        return pa.record_batch(out)

    out = _with_spans(docs, act, docs.schema)
    return out if counted is None else out.withColumn("n_chars", F.col("n_chars").cast(counted))

