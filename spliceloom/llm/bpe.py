"""BPE encoding and decoding with a segment tree over the ranks of adjacent pairs.

Each distinct word of a batch has a segment tree whose leaves are the merge ranks of its adjacent symbols;
the root is the leftmost lowest-ranked pair. A merge changes three leaves, which is carried up the tree, until
no pair can be merged. The trees of words of like length are rows of one numpy array and advance together.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spliceloom.llm.common import small_batches

#: A lone surrogate, which no UTF-8 text holds.
_MARK = "\ud800"
_NONE = np.iinfo(np.int64).max
#: Letters, single digits and runs of anything else; what the vocabulary's own pattern says, in Python's syntax.
_SUFFIXES = r"'s|'t|'re|'ve|'m|'ll|'d"
_PLAIN = re.compile(_SUFFIXES + r"|[a-zß-öø-ɏ]+|[0-9]|[^\s0-9a-zß-öø-ɏ]+")
_OTHER = re.compile(r"[^\x00-\x1b\x20-\x7fß-öø-ɏ]")


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class SegmentTreeBPE:
    """A word-end BPE vocabulary read from a tokenizer file."""

    #: Symbols of trees that advance together, and words that are kept for later batches.
    ROOM, KEEP = 1 << 19, 400_000
    #: Symbols from which few words of one width are merged one by one.
    LONG = 64

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab = spec["model"]["vocab"]
        self.end = spec["model"]["end_of_word_suffix"]
        self.token = {i: t for t, i in vocab.items()}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.token |= {i: t for t, i in self.special.items()}
        letters = _byte_letters()
        self.inner = np.array([vocab[x] for x in letters], np.int64)
        self.last = np.array([vocab[x + self.end] for x in letters], np.int64)
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] << 20 | vocab[b] for a, b in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order
        self.pairs: dict[int, int] = {}
        self.made = np.array([vocab[a + b] for a, b in merges], np.int64)
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.pattern = regex.compile(_SUFFIXES + r"|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+")
        self._forget()

    def _forget(self) -> None:
        self.index: dict[str, int] = {}
        self.shown: list[str] = []
        self.flat, self.starts, self.sizes = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def words(self, text: str) -> list[str]:
        """The words of a text; special tokens stand as they are, behind a mark no text has."""
        out: list[str] = []
        special = self.split_special
        parts = special.split(text) if special and any(s in text for s in self.special) else [text]
        for part in parts:
            if part in self.special:
                out.append(_MARK + part)
                continue
            if not part.isascii():
                part = unicodedata.normalize("NFC", part).replace("Σ", "σ")
            part = part.lower()
            out += (self.pattern if _OTHER.search(part) else _PLAIN).findall(part)
        return out

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge ranks of pairs of symbols; _NONE where they don't merge."""
        key = left << 20 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NONE)

    def _merge(self, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge all words, a row of symbols each; returns the rows' symbols and which of them remain."""
        n, width = symbols.shape
        span = np.arange(width)
        tree = np.full((n, 2 * width), _NONE, np.int64)
        inside = span[None, :-1] + 1 < sizes[:, None]
        rank = self._rank(symbols[:, :-1], symbols[:, 1:])
        tree[:, width : 2 * width - 1] = np.where(inside & (rank < _NONE), rank * width + span[:-1], _NONE)
        for k in range(width - 1, 0, -1):
            np.minimum(tree[:, 2 * k], tree[:, 2 * k + 1], out=tree[:, k])
        following = np.broadcast_to(span + 1, (n, width)).copy()
        previous = np.broadcast_to(span - 1, (n, width)).copy()
        stays = span[None, :] < sizes[:, None]
        row = np.arange(n)
        while True:
            row = row[tree[row, 1] < _NONE]
            if not len(row):
                return symbols, stays
            root = tree[row, 1]
            i = root % width
            gone = following[row, i]
            after = following[row, gone]
            symbols[row, i] = self.made[root // width]
            stays[row, gone] = False
            following[row, i] = after
            has = after < sizes[row]
            previous[row[has], after[has]] = i[has]
            before = previous[row, i]
            lead = before >= 0
            new = np.full(len(row), _NONE, np.int64)
            rank = self._rank(symbols[row[has], i[has]], symbols[row[has], after[has]])
            new[has] = np.where(rank < _NONE, rank * width + i[has], _NONE)
            self._update(tree, row, i, new, width)
            self._update(tree, row, gone, np.full(len(row), _NONE, np.int64), width)
            if lead.any():
                own, b = row[lead], before[lead]
                rank = self._rank(symbols[own, b], symbols[own, i[lead]])
                self._update(tree, own, b, np.where(rank < _NONE, rank * width + b, _NONE), width)

    def _merge_long(self, symbols: np.ndarray) -> np.ndarray:
        """Merge one long word, with a tree in lists; an update stops where a node keeps its value."""
        n, width = len(symbols), 1 << max(len(symbols) - 1, 1).bit_length()
        rank = self._rank(symbols[:-1], symbols[1:])
        level = np.full(width, _NONE, np.int64)
        level[: n - 1] = np.where(rank < _NONE, rank * width + np.arange(n - 1), _NONE)
        levels = [level]
        while len(levels[-1]) > 1:
            levels.append(np.minimum(levels[-1][::2], levels[-1][1::2]))
        tree = [_NONE, *np.concatenate(levels[::-1]).tolist()]
        if not self.pairs:
            self.pairs = dict(zip(self.keys.tolist(), self.ranks.tolist()))
        pairs, made, own = self.pairs, self.made, symbols.tolist()
        following, previous = list(range(1, n + 1)), list(range(-1, n - 1))

        def update(leaf: int, value: int) -> None:
            node = leaf + width
            tree[node] = value
            while node > 1:
                node >>= 1
                left, right = tree[2 * node], tree[2 * node + 1]
                least = left if left < right else right
                if tree[node] == least:
                    break
                tree[node] = least

        def leaf_value(i: int, j: int) -> int:
            found = pairs.get(own[i] << 20 | own[j])
            return _NONE if found is None else found * width + i

        while (root := tree[1]) < _NONE:
            i = root % width
            gone = following[i]
            after = following[gone]
            own[i], own[gone] = int(made[root // width]), -1
            following[i] = after
            if after < n:
                previous[after] = i
                update(i, leaf_value(i, after))
            else:
                update(i, _NONE)
            update(gone, _NONE)
            if (before := previous[i]) >= 0:
                update(before, leaf_value(before, i))
        return np.array([x for x in own if x >= 0], np.int64)

    @staticmethod
    def _update(tree: np.ndarray, row: np.ndarray, leaf: np.ndarray, value: np.ndarray, width: int) -> None:
        node = leaf + width
        tree[row, node] = value
        while width > 1:
            node = node >> 1
            tree[row, node] = np.minimum(tree[row, 2 * node], tree[row, 2 * node + 1])
            width >>= 1

    def _learn(self, words: list[str]) -> None:
        """Encode words that were not met before."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        lengths = np.array([0 if w[0] == _MARK else len(r) for w, r in zip(words, raw)])
        ids: list = [None] * len(words)
        for k in np.flatnonzero(lengths == 0):
            ids[k] = np.array([self.special[words[k][1:]]], np.int64)
        widths = 1 << np.ceil(np.log2(np.maximum(lengths, 2))).astype(int)
        for width in np.unique(widths):
            same = np.flatnonzero((widths == width) & (lengths > 0))
            if width >= self.LONG and len(same) * self.LONG < width:
                for k in same:
                    symbols = self.inner[np.frombuffer(raw[k], np.uint8)]
                    symbols[-1] = self.last[raw[k][-1]]
                    ids[k] = self._merge_long(symbols)
                continue
            step = max(1, self.ROOM // int(width))
            for start in range(0, len(same), step):
                some = same[start : start + step]
                size = lengths[some]
                data = np.frombuffer(b"".join(raw[k].ljust(width, b"\0") for k in some), np.uint8).reshape(-1, width)
                symbols = self.inner[data]
                symbols[np.arange(len(some)), size - 1] = self.last[data[np.arange(len(some)), size - 1]]
                symbols, stays = self._merge(symbols, size)
                cut = np.split(symbols[stays], np.cumsum(stays.sum(axis=1))[:-1])
                for k, x in zip(some, cut):
                    ids[k] = x
        sizes = np.array([len(x) for x in ids], np.int64)
        flat = np.concatenate(ids) if ids else np.zeros(0, np.int64)
        token = self.token
        names = [token[i] for i in flat.tolist()]
        ends = np.cumsum(sizes)
        self.shown += [" ".join(names[e - s : e]) for s, e in zip(sizes.tolist(), ends.tolist())]
        self.starts = np.concatenate((self.starts, len(self.flat) + ends - sizes))
        self.sizes = np.concatenate((self.sizes, sizes))
        self.flat = np.concatenate((self.flat, flat))

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[str]]:
        """Ids of each text, and the text decoded from them: the tokens in order with one space between."""
        if len(self.index) > self.KEEP:
            self._forget()
        found = [self.words(t) for t in texts]
        index = self.index
        new = []
        for words in found:
            for w in words:
                if w not in index:
                    index[w] = len(index)
                    new.append(w)
        if new:
            self._learn(new)
        ids, decoded = [], []
        for words in found:
            at = [index[w] for w in words]
            decoded.append(" ".join([self.shown[k] for k in at]))
            at = np.array(at, np.int64)
            size = self.sizes[at]
            place = np.repeat(self.starts[at] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            ids.append(self.flat[place])
        return ids, decoded

    def decode(self, ids: list[int]) -> str:
        """The tokens of ids with one space between; unknown ids are left out."""
        return " ".join(self.token[i] for i in ids if i in self.token)


def encoded(docs: DataFrame, path: str, digests: bool = False) -> DataFrame:
    """Token ids and decoded text of every row of docs (doc_id, text), with the tokenizer file at path.

    Columns doc_id, ids (array of int), decoded; with digests: doc_id, n_tokens, ids_sha256 (ids as
    little-endian unsigned 32-bit integers), decoded_sha256, which spares moving the ids themselves. Null
    and empty texts have no ids and decode to the empty text. Repeated rows are encoded each, an empty table
    gives no rows, other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = SegmentTreeBPE(path)
        for batch in small_batches(batches):
            ids, decoded = bpe.encode([t or "" for t in batch.column("text").to_pylist()])
            out: dict = {"doc_id": batch.column("doc_id")}
            if digests:
                out["n_tokens"] = pa.array([len(x) for x in ids], pa.int64())
                out["ids_sha256"] = [hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids]
                out["decoded_sha256"] = [hashlib.sha256(x.encode()).hexdigest() for x in decoded]
            else:
                out["ids"] = pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32()))
                out["decoded"] = decoded
            yield pa.record_batch(out)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "doc_id long, ids array<int>, decoded string"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def decoded(tokens: DataFrame, path: str) -> DataFrame:
    """doc_id and the text that each row's ids decode to; null ids give null, unknown ids are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = SegmentTreeBPE(path)
        for batch in batches:
            texts = [None if x is None else bpe.decode(x) for x in batch.column("ids").to_pylist()]
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "decoded": pa.array(texts, pa.string())})

    return tokens.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>")).mapInArrow(run, "doc_id long, decoded string")
