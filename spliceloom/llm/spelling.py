"""Spelling variants: words one edit apart, found by dynamic programming over sorted vocabulary lists.

The vocabulary is dealt out so that any two near words share a list: of words of S or S + 1 code points that are one edit apart, either
the first S div 2 code points agree or the last S div 2 do. A list that is too long for one task is dealt out again by half of what its
words don't share yet; in the end they differ in two code points at most, which bounds a list by the alphabet, not by the data.

Within a list, sorted by the part that its words don't share, each word is held against all others at once: a row of the edit matrix, three
cells wide, is carried down the list one code point at a time. A row holds for a whole range of neighbours with that prefix in common
(where their LCP reaches), so it is made once for them; a range whose row has no cell of one edit or less is skipped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spliceloom.llm.common import hot_keys, left_join_hot
from spliceloom.staging import written

#: Least code points and least occurrences of a word of the vocabulary; its count against a variant's.
LENGTH, TIMES, RATIO = 5, 3, 2
#: Words of a list that one task handles; a longer list is dealt out again. Lists of few code points have fewer words than that.
LIST = 10_000
#: Words that are held against their lists at once.
BLOCK = 2_000

_LETTERS = "[A-Za-z\\u00C0-\\u00FF]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def misspelt(doc_id: Column, word: Column, every: int) -> Column:
    """word, without one code point where every divides a hash of doc_id and word: misspellings for an evaluation."""
    h = F.crc32(F.concat_ws(":", doc_id.cast("string"), word).cast("binary"))
    k = (h % F.length(word)).cast("int")
    spoilt = F.concat(F.substring(word, F.lit(1), k), F.substring(word, k + 2, F.length(word)))
    return F.when(doc_id.isNotNull() & (h % every == 0), spoilt).otherwise(word)


def vocabulary(docs: DataFrame, least: int = LENGTH, times: int = TIMES, every: int | None = None) -> DataFrame:
    """word and n: runs of letters of all texts (A-Z lower-cased) of least code points or more that occur times or more.

    With every, words are misspelt by a hash first (`misspelt`). Only counts are shuffled.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.explode(F.regexp_extract_all(F.col("text").cast("string"), F.lit(_LETTERS), F.lit(0))).alias("word"))
    word = F.translate("word", _UPPER, _LOWER)
    rows = rows.select((word if every is None else misspelt(F.col("doc_id"), word, every)).alias("word"))
    return rows.where(F.length("word") >= least).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= times)


def _listed(rows: DataFrame) -> DataFrame:
    """rows (word, n, s, a, b) with their list's name: s, and the first a and last b code points, which its words share."""
    return rows.withColumn("list", F.concat_ws(":", "s", "a", "b", F.expr("substring(word, 1, a)"), F.expr("right(word, b)")))


def _halved(rows: DataFrame) -> DataFrame:
    """rows in two lists each: half of the code points that a list doesn't share yet join its first ones, or its last."""
    half = F.expr("(s - a - b) div 2").cast("int")
    sides = F.explode(F.array(F.struct((F.col("a") + half).alias("a"), F.col("b").alias("b")), F.struct(F.col("a").alias("a"), (F.col("b") + half).alias("b"))))
    return rows.select("word", "n", "s", sides.alias("x")).select("word", "n", "s", "x.a", "x.b")


def lists(words: DataFrame, most: int = LIST) -> Iterator[DataFrame]:
    """Tables (list, s, a, b, word, n) of lists of two words or more, in which any two near words meet at least once."""
    sizes = F.array(F.length("word"), F.length("word") - 1)
    rows = words.select("word", "n", F.explode(sizes).alias("s")).where("s > 0").withColumns({"a": F.lit(0), "b": F.lit(0)})
    rows = _halved(rows)
    while True:
        rows = written(_listed(rows), "listed")
        counts = written(rows.groupBy("list").agg(F.count("*").alias("times")).where("times > 1"), "lists")
        rows = left_join_hot(rows, counts.select("list", "times"), "list", hot_keys(counts, "list")).where("times is not null")
        # a list that shares all code points but one, or two, is never long
        long = (F.col("times") > most) & (F.col("s") - F.col("a") - F.col("b") > 1)
        rows = written(rows.withColumn("long", long), "met")
        yield rows.where("not long").drop("times", "long")
        rows = rows.where("long").drop("list", "times", "long")
        if rows.isEmpty():
            return
        rows = _halved(rows)


def _common(letters: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Code points that each word has in common with the one before it."""
    out = np.zeros(len(starts), np.int64)
    live = np.arange(1, len(starts))
    k = 0
    while len(live):
        live = live[(sizes[live] > k) & (sizes[live - 1] > k)]
        live = live[letters[starts[live] + k] == letters[starts[live - 1] + k]]
        out[live] += 1
        k += 1
    return out


def near_words(letters: np.ndarray, starts: np.ndarray, sizes: np.ndarray, groups: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of words of one group, which stand together and sorted, exactly one edit apart; both ways round.

    Word i is letters[starts[i]:starts[i] + sizes[i]]; groups rises.
    """
    n = len(starts)
    lcp = _common(letters, starts, sizes)
    lcp[np.flatnonzero(np.diff(groups, prepend=-1))] = -1
    first, last = np.searchsorted(groups, groups), np.searchsorted(groups, groups, side="right")
    found = []
    for begin in range(0, n, block):
        query = np.arange(begin, min(begin + block, n))
        low, high = first[query], last[query]
        # cells for one code point less, as many and one more of the query than of the prefix: 2 stands for more than one edit
        row = np.tile(np.array([2, 0, 1], np.int8), (len(query), 1))
        depth = 0
        while len(query):
            # words that end here stand first in their range
            done = np.flatnonzero(sizes[low] == depth)
            over = sizes[query[done]] - depth + 1
            fit = (over >= 0) & (over <= 2)
            hit = done[fit][row[done[fit], over[fit]] == 1]
            found.append(np.stack((query[hit], low[hit])))
            low = low + (sizes[low] == depth)
            some = low < high
            query, low, high, row = query[some], low[some], high[some], row[some]
            if not len(query):
                break
            # ranges part where neighbours differ at this code point
            edges = np.append(np.flatnonzero(lcp <= depth), n)
            a, b = np.searchsorted(edges, low, side="right") - 1, np.searchsorted(edges, high)
            count = b - a
            parent = np.repeat(np.arange(len(query)), count)
            at = np.repeat(a, count) + np.arange(len(parent)) - np.repeat(np.cumsum(count) - count, count)
            low, high = np.maximum(edges[at], low[parent]), edges[at + 1]
            query, old = query[parent], row[parent]
            letter = letters[starts[low] + depth]
            new = np.full((len(query), 3), 2, np.int8)
            for k in range(3):
                j = depth + k  # code points of the query that this cell takes
                inside = (j <= sizes[query]) & (j >= 0)
                cell = np.full(len(query), 2, np.int8)
                if j:
                    own = letters[np.minimum(starts[query] + j - 1, len(letters) - 1)]
                    cell = old[:, k] + (own != letter)
                if k < 2:
                    cell = np.minimum(cell, old[:, k + 1] + 1)
                if k:
                    cell = np.minimum(cell, new[:, k - 1] + 1)
                new[:, k] = np.where(inside, np.minimum(cell, 2), 2)
            some = (new <= 1).any(axis=1)
            query, low, high, row = query[some], low[some], high[some], new[some]
            depth += 1
    pairs = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
    return pairs[0], pairs[1]


def _scanned(part: pd.DataFrame) -> pd.DataFrame:
    """Near words of the lists in part (list, s, a, b, word, n), sorted by list and by what its words don't share."""
    middle = [w[a : len(w) - b] for w, a, b in zip(part["word"], part["a"].tolist(), part["b"].tolist())]
    sizes = np.fromiter(map(len, middle), np.int64, len(middle))
    letters = np.frombuffer("".join(middle).encode("utf-32-le"), np.uint32)
    names = part["list"].to_numpy()
    groups = np.concatenate(([0], np.cumsum(names[1:] != names[:-1]))) if len(names) else np.zeros(0, np.int64)
    i, j = near_words(letters, np.cumsum(sizes) - sizes, sizes, groups)
    # pairs of two longer words belong to the lists of their own length
    whole = part["word"].str.len().to_numpy()
    s = part["s"].to_numpy()
    own = (whole[i] == s[i]) | (whole[j] == s[j])
    i, j = i[own], j[own]
    word, n = part["word"].to_numpy(), part["n"].to_numpy()
    return pd.DataFrame({"word": word[i], "n": n[i], "near": word[j], "near_n": n[j]})


def _whole_lists(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pd.DataFrame]:
    """Rows sorted by list, as frames of whole lists and some most rows."""
    held: list[pd.DataFrame] = []
    size = 0
    for batch in batches:
        held.append(batch.to_pandas())
        size += batch.num_rows
        if size < most:
            continue
        rows = pd.concat(held, ignore_index=True)
        names = rows["list"].to_numpy()
        cut = int(np.argmax(names == names[-1]))
        if cut:
            yield rows[:cut]
        held, size = [rows[cut:].reset_index(drop=True)], len(rows) - cut
    if held:
        yield pd.concat(held, ignore_index=True)


def near_pairs(words: DataFrame, most: int = LIST) -> DataFrame:
    """word, n, near, near_n: each word of the vocabulary (word, n) with each that is one edit away, once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _whole_lists(batches, most):
            yield pa.RecordBatch.from_pandas(_scanned(part), schema=kinds, preserve_index=False)

    kinds = pa.schema([("word", pa.string()), ("n", pa.int64()), ("near", pa.string()), ("near_n", pa.int64())])
    found = None
    for table in lists(words, most):
        middle = F.expr("substring(word, a + 1, length(word) - a - b)")
        dealt = table.repartition("list").sortWithinPartitions("list", middle).select("list", "s", "a", "b", "word", "n")
        pairs = dealt.mapInArrow(run, "word string, n long, near string, near_n long")
        found = pairs if found is None else found.unionByName(pairs)
    return found.distinct()


def rooted(forms: DataFrame) -> DataFrame:
    """forms (word, form, ...) with root: the last of word, its form, the form's form and so on.

    Counts at least double from word to form, so there is no cycle, and a chain is no longer than the count's bits; each round
    halves what is left of all chains.
    """
    heads = written(forms.select("word", F.coalesce("form", "word").alias("root"), F.col("form").isNull().alias("done")), "roots")
    while not heads.where("not done").isEmpty():
        ahead = heads.select(F.col("word").alias("root"), F.col("root").alias("next"), F.col("done").alias("last"))
        heads = written(heads.join(ahead, "root").select("word", F.col("next").alias("root"), "last").withColumnRenamed("last", "done"), "roots")
    return forms.join(heads.select("word", "root"), "word")


def spelling_variants(docs: DataFrame, least: int = LENGTH, times: int = TIMES, ratio: int = RATIO, every: int | None = None, most: int = LIST) -> DataFrame:
    """The words of all texts grouped with the spelling they are variants of: word, form, root, n, n_near, form_n.

    docs needs doc_id and text; other columns are ignored. Words are runs of letters (A-Z, a-z, U+00C0 to U+00FF; only A-Z are lower-cased) of
    least code points or more that occur times or more. Two are near if one inserted, deleted or replaced code point makes
    them equal. form is the near word of greatest n (ties: the first in code-point order) if that is ratio times n or more, else
    null; root is the last form of the chain, the word itself without one. n_near counts near words, form_n is the form's
    n. Null and empty texts have no words, repeated rows count each time, rows without doc_id count, an empty
    table gives no rows. Texts and words may be of any length; a word is held in one task.
    """
    words = written(vocabulary(docs, least, times, every), "words")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")
    met = near_pairs(words, most).groupBy("word").agg(F.count("*").alias("n_near"), best)
    rows = words.join(met, "word", "left").withColumn("form_n", -F.col("best.less"))
    held = F.col("form_n") >= F.col("n") * ratio
    rows = rows.select("word", F.when(held, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(held, F.col("form_n")).alias("form_n"))
    rows = written(rows, "forms")
    return rooted(rows).select("word", "form", "root", "n", "n_near", "form_n")
