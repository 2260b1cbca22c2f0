"""Column expressions on DNA, peptides and k-mers; letters of whole sequences are looked up in numpy, by Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, MapType, StringType, StructField, StructType

#: The standard genetic code over T, C, A, G in that order, _ for stop.
BASES = "TCAG"
CODE = "FFLLSSSSYY__CC_WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
STOPS = [a + b + c for k, (a, b, c) in enumerate((a, b, c) for a in BASES for b in BASES for c in BASES) if CODE[k] == "_"]
#: Bits of a digit of the masks that choose combinations.
MASK_BITS = 10
#: K-mers of a batch that `with_kmers` makes.
CUT = 100_000


def complement(dna: Column) -> Column:
    """Complement of A, C, G and T; other letters, small ones too, stay."""
    return F.translate(dna, "ACGT", "TGCA")


def reverse_complement(dna: Column) -> Column:
    return complement(F.reverse(dna))


def residue(codon: Column) -> Column:
    """The residue of a codon in capitals, _ for a stop and X for other letters."""
    names = [a + b + c for a in BASES for b in BASES for c in BASES]
    table = F.create_map(*[F.lit(x) for pair in zip(names, CODE) for x in pair])
    return F.coalesce(table[codon], F.lit("X"))


def _table(pairs: dict[str, int], other: int) -> np.ndarray:
    """A number per byte, small letters as capitals."""
    return np.array([pairs.get(chr(b).upper(), other) for b in range(256)], np.uint8)


#: Digits of bases, 4 for other letters, and residues by three such digits.
_DIGITS = _table({x: k for k, x in enumerate(BASES)}, 4)
#: The same of the base that `complement` gives.
_OTHERS = _DIGITS[np.frombuffer(bytes(range(256)).translate(bytes.maketrans(b"ACGT", b"TGCA")), np.uint8)]
_LETTERS = np.array([ord("X") if 4 in (a, b, c) else ord(CODE[16 * a + 4 * b + c]) for a in range(5) for b in range(5) for c in range(5)], np.uint8)


def _bytes(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """An array of texts that starts at its buffers' start, with their ends as numbers and their bytes."""
    texts = pa.concat_arrays([texts.cast(pa.string())])
    _, ends, data = texts.buffers()
    return texts, np.frombuffer(ends, np.int32, len(texts) + 1).astype(np.int64), np.frombuffer(data or b"", np.uint8)


def _translated(dna: pa.Array) -> pa.Array:
    """Residues of an array of sequences."""
    return _codons(dna, None)


def _translated_back(dna: pa.Array, back: pa.Array) -> pa.Array:
    """Residues of an array of sequences, or of their reverse complements where back is true."""
    return _codons(dna, back)


def _codons(dna: pa.Array, back: pa.Array | None) -> pa.Array:
    if not len(dna):
        return dna
    dna, ends, data = _bytes(dna)
    if data.size and data.max() > 127:  # letters of several bytes
        names = {a + b + c: CODE[k] for k, (a, b, c) in enumerate((a, b, c) for a in BASES for b in BASES for c in BASES)}
        turned = [False] * len(dna) if back is None else back.to_pylist()
        swap = str.maketrans("ACGT", "TGCA")
        whole = [x and (x[::-1].translate(swap) if b else x).upper() for x, b in zip(dna.to_pylist(), turned)]
        return pa.array([x and "".join(names.get(x[i : i + 3], "X") for i in range(0, len(x) - 2, 3)) for x in whole], pa.string())
    sizes = np.diff(ends) // 3
    made = np.concatenate([[0], np.cumsum(sizes)])
    at = 3 * np.arange(made[-1]) + np.repeat(ends[:-1] - 3 * made[:-1], sizes)
    digits = _DIGITS[data]
    first, second, third = digits[at], digits[at + 1], digits[at + 2]
    if back is not None:
        turned = np.repeat(back.to_numpy(zero_copy_only=False).astype(bool), sizes)
        at = np.repeat(ends[1:] - 1 + 3 * made[:-1], sizes)[turned] - 3 * np.flatnonzero(turned)
        digits = _OTHERS[data]
        first[turned], second[turned], third[turned] = digits[at], digits[at - 1], digits[at - 2]
    found = _LETTERS[25 * first + 5 * second + third]
    return pa.Array.from_buffers(pa.string(), len(dna), [dna.buffers()[0], pa.py_buffer(made.astype(np.int32)), pa.py_buffer(found)])


def residues(dna: Column, back: Column | None = None) -> Column:
    """All codons of dna as one string with _ for stops and X for codons of other letters; 1 or 2 last bases drop.

    Where back is true the reverse complement is read; it is not made before, which would take longer than all else.
    """
    return F.arrow_udf(_translated, StringType())(dna) if back is None else F.arrow_udf(_translated_back, StringType())(dna, back)


def with_residues(rows: DataFrame, name: str, dna: Column, back: Column | None = None) -> DataFrame:
    """rows with the residues of dna in column name. A filter on what is made of them can't pass an explode, below which all would be
    cut and translated a second time."""
    rows = rows.withColumn("__dna", F.explode(F.array(dna))).withColumn("__residues", residues(F.col("__dna"), back))
    return rows.withColumn(name, F.explode(F.array("__residues"))).drop("__dna", "__residues")


def minus(strand: Column) -> Column:
    """Whether bases are read backwards: on all strands but +."""
    return ~strand.eqNullSafe(F.lit("+"))


def peptides(dna: Column) -> Column:
    """Every stop-delimited piece of the translation, empty ones included."""
    return F.split(residues(dna), "_", -1)


def peptide(dna: Column) -> Column:
    """The translation up to the first stop."""
    return F.substring_index(residues(dna), "_", 1)


def has_stop(dna: Column) -> Column:
    """Whether any whole codon is a stop."""
    return F.contains(residues(dna), F.lit("_"))


def kmers(text: Column, k: int) -> Column:
    """All substrings of length k in order; empty for shorter texts."""
    span = F.sequence(F.lit(1), F.greatest(F.length(text) - (k - 1), F.lit(1)))
    tiles = F.transform(span, lambda i: F.substring(text, i, F.lit(k)))
    return F.when(F.length(text) >= k, tiles).when(text.isNotNull(), F.array().cast("array<string>"))


def isoleucine_as_leucine(kmer: Column) -> Column:
    """I and L weigh the same, so a spectrum can't tell them apart."""
    return F.translate(kmer, "I", "L")


def with_variants(seq: Column, start: Column, variants: Column) -> Column:
    """seq, which begins at position start, with single-base variants (array of struct pos, base); * keeps the base."""
    inside = F.filter(variants, lambda v: (v.pos >= start) & (v.pos < start + F.length(seq)) & (v.base != "*"))
    return F.aggregate(F.array_sort(inside), seq, lambda s, v: F.overlay(s, v.base, (v.pos - start + 1).cast("int"), F.lit(1)))


def combinations(items: Column) -> Column:
    """Every subset of an array, the empty one first; the caller bounds the array's size."""
    masks = F.sequence(F.lit(0).cast("long"), F.pow(F.lit(2), F.size(items)).cast("long") - 1)
    return F.transform(masks, lambda m: F.filter(items, lambda _, i: F.call_function("getbit", m, i) == 1))


def with_combinations(rows: DataFrame, items: str, into: str) -> DataFrame:
    """rows once for each subset of the array column items, which stands in column into: 2**n rows of n items.

    Sets of up to MASK_BITS items are combined where they are. Masks of larger ones are made a digit of MASK_BITS bits at a time, so
    that no row holds many of them, and the rows of the higher digits are dealt out to all tasks. A set of more than 62 items, which
    no table could hold the subsets of, is an error; what its combinations give is told without them in `operators.variants`.
    """
    n = F.size(items)
    # sliced, as constants are combined before rows are left out
    few = rows.where(n <= MASK_BITS).withColumn(into, F.explode(combinations(F.slice(items, 1, MASK_BITS))))
    known = F.when(n > 62, F.raise_error(F.format_string("%d items have too many combinations", n)).cast("boolean")).otherwise(True)
    many = rows.where(n > MASK_BITS).where(known).withColumn("__mask", F.lit(0).cast("long"))
    for k in range(62 // MASK_BITS, -1, -1):
        bits = F.greatest(F.least(n - k * MASK_BITS, F.lit(MASK_BITS)), F.lit(0))
        digit = F.explode(F.sequence(F.lit(0).cast("long"), F.pow(F.lit(2), bits).cast("long") - 1))
        many = many.withColumn("__digit", digit).withColumn("__mask", F.col("__mask") * (1 << MASK_BITS) + F.col("__digit")).drop("__digit")
        if k == 1:
            many = many.repartition("__mask", *[c for c in many.columns if c != "__mask" and not isinstance(many.schema[c].dataType, MapType)])
    return few.unionByName(many.withColumn(into, F.filter(items, lambda _, i: F.call_function("getbit", F.col("__mask"), i) == 1)).drop("__mask"))


def spans_junction(pos: Column, k: int, cut: Column) -> Column:
    """Whether the k-mer at residue pos takes bases on both sides of base cut of the coding sequence."""
    return (3 * pos < cut) & (3 * (pos + k) > cut)


def genomic_parts(pos: Column, k: int, parts: Column, strand: Column) -> Column:
    """Genomic pieces of the k-mer at residue pos of a sequence made of parts (array of struct start, stop).

    parts come in reading order; on the minus strand each is read from its stop down to its start.
    """
    low, high = 3 * pos, 3 * (pos + k)
    sizes = F.transform(parts, lambda p: p.stop - p.start)
    begins = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.aggregate(F.slice(sizes, 1, i - 1), F.lit(0), lambda a, x: a + x))
    placed = F.zip_with(parts, begins, lambda p, b: F.struct(p.start.alias("start"), p.stop.alias("stop"), F.greatest(low - b, F.lit(0)).alias("a"), F.least(high - b, p.stop - p.start).alias("b")))
    kept = F.filter(placed, lambda p: p.a < p.b)
    forward = F.transform(kept, lambda p: F.struct((p.start + p.a).alias("start"), (p.start + p.b).alias("stop")))
    backward = F.transform(kept, lambda p: F.struct((p.stop - p.b).alias("start"), (p.stop - p.a).alias("stop")))
    return F.when(strand == "+", forward).otherwise(backward)


def with_kmers(rows: DataFrame, k: int, count: str | None = None) -> DataFrame:
    """rows once for each k-mer of column peptide: with pos, kmer and as parts its `genomic_parts`, in place of peptide and parts.

    With count, a column with the number of k-mers, there is no peptide and no kmer. Places are worked out in numpy, for CUT k-mers at a
    time, however long a peptide is; strand and parts are columns of rows.
    """
    kept = [f for f in rows.schema if f.name not in ("peptide", "parts", count)]
    made = [StructField("pos", IntegerType()), *([] if count else [StructField("kmer", StringType())]), rows.schema["parts"]]

    def cut(batches):
        for batch in batches:
            yield from _cut(batch, k, [f.name for f in kept], count)

    return rows.mapInArrow(cut, StructType([*kept, *made]))


def distinct_kmers(rows: DataFrame, k: int, keys: list[str]) -> DataFrame:
    """`with_kmers` without pos, each k-mer once: of those that are equal in keys, kmer and parts the first, with its other columns.

    rows are dealt out to tasks by the first of keys and sorted by it there, so that k-mers are told apart where they are cut: they
    are not shuffled, and no more is held than those of one value of it. A row out of this order is an error.

    Columns segments (start, stop, counts) and junctions (left_stop, right_start, counts, annotated), arrays of what rows have in reach,
    give way to what lies on each k-mer: of a k-mer of one piece held, an array of n, the bases on a segment, and its counts; of others
    crossed, an array of the counts of junctions between its pieces by place, and annotated, whether any of these is.
    """
    counted = [c for c in ("segments", "junctions") if c in rows.columns]
    kept = [f for f in rows.schema if f.name not in ("peptide", "parts")]
    out = [*(f for f in kept if f.name not in counted), StructField("kmer", StringType()), rows.schema["parts"]]
    if counted:
        kinds = [rows.schema[c].dataType.elementType["counts"].dataType for c in ("segments", "junctions")]
        out += [StructField("held", ArrayType(StructType([StructField("n", DoubleType()), StructField("counts", kinds[0])]))), StructField("crossed", ArrayType(kinds[1])), StructField("annotated", BooleanType())]

    def cut(batches):
        cuts = (x.drop_columns("pos") for batch in _in_order(batches, keys[0]) for x in _cut(batch, k, [f.name for f in kept], None))
        for table in _once(cuts, keys):
            yield from (_reached(table) if counted else table).to_batches()

    return rows.mapInArrow(cut, StructType(out))


def _in_order(batches, key: str):
    """The batches that have rows, as long as key doesn't go down."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = batch.column(key)
        now = now if last is None else pa.concat_arrays([last, now])
        if pc.any(pc.less(now[1:], now[:-1])).as_py():
            raise ValueError(f"rows are not in order of {key}")
        last = now[-1:]
        yield batch


def _once(batches, keys: list[str]):
    """Tables of the rows of batches, which are in order of the first of keys, without repeats."""
    held, most = None, CUT
    for batch in batches:
        rows = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        by = rows.column(keys[0])
        same = pc.is_null(by) if not by[-1].is_valid else pc.fill_null(pc.equal(by, by[-1]), False)
        other = np.flatnonzero(~same.to_numpy())
        n = int(other[-1]) + 1 if len(other) else 0  # before it values are whole
        if n:
            yield _first_of_each(rows.slice(0, n), keys)
        held = rows.slice(n)
        if held.num_rows > most:
            held = _first_of_each(held, keys)
            most = max(CUT, 2 * held.num_rows)
        elif n:
            most = CUT
    if held is not None:
        yield _first_of_each(held, keys)


def _listed(rows: pa.Table, name: str, *fields: str) -> tuple:
    """Of a column of arrays of structs their ends and sizes, and fields of all structs as numbers, or as they are."""
    lists = pa.concat_arrays(rows.column(name).chunks)
    values = pa.concat_arrays([lists.values])
    found = [values.field(f) for f in fields]
    ends = lists.offsets.to_numpy()
    return ends, np.diff(ends), [x if pa.types.is_list(x.type) else x.to_numpy(zero_copy_only=False) for x in found]


def _lists(of: np.ndarray, n: int, values: pa.Array) -> pa.ListArray:
    """values as the lists of n rows; of: the row of each, in order."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(of, minlength=n))]).astype(np.int32)), values)


def _reached(rows: pa.Table) -> pa.Table:
    """rows with held, crossed and annotated in place of segments and junctions."""
    n = rows.num_rows
    begins, sizes, numbers = _listed(rows, "parts", "start", "stop")
    start, stop = (x.astype(np.int64) for x in numbers)
    at, most = begins[:-1], int(sizes.max(initial=0))
    ends, size, (a, b, counts) = _listed(rows, "segments", "start", "stop", "counts")
    of = np.repeat(np.arange(n), size)
    a, b = (x[ends[0] : ends[-1]] for x in (a, b))
    low, high = np.maximum(a, start[at[of]]), np.minimum(b, stop[at[of]])
    some = np.flatnonzero((sizes[of] == 1) & (a < b) & (low < high))
    held = pa.StructArray.from_arrays([pa.array((high - low)[some].astype(np.float64)), counts.take(pa.array(some + ends[0]))], ["n", "counts"])
    held = _lists(of[some], n, held)

    ends, size, (a, b, counts, annotated) = _listed(rows, "junctions", "left_stop", "right_start", "counts", "annotated")
    of = np.repeat(np.arange(n), size)
    a, b, annotated = (x[ends[0] : ends[-1]] for x in (a, b, annotated))
    none = np.iinfo(np.int64).max
    left, right = (np.stack([np.where(p < sizes, x[np.where(p < sizes, at + p, 0)], none) for p in range(most)], 1) if n else np.zeros((0, 0), np.int64) for x in (start, stop))
    order = np.lexsort((right, left), axis=-1)
    left, right = (np.take_along_axis(x, order, 1) for x in (left, right))
    met = np.zeros(len(of), bool)
    for p in range(most - 1):
        met |= (p + 1 < sizes[of]) & (right[of, p] == a) & (left[of, p + 1] == b)
    known = np.bincount(of[met & (annotated == True)], minlength=n) > 0  # noqa: E712, it may be null
    some = np.flatnonzero(met & counts.is_valid().to_numpy(zero_copy_only=False)[ends[0] : ends[-1]])
    crossed = _lists(of[some], n, counts.take(pa.array(some + ends[0])))
    return rows.drop_columns(["segments", "junctions"]).append_column("held", held).append_column("crossed", crossed).append_column("annotated", pa.array(known))


def _first_of_each(rows: pa.Table, keys: list[str]) -> pa.Table:
    """The first of rows that are equal in keys, kmer and parts."""
    rows = rows.combine_chunks()
    ends, sizes, numbers = _listed(rows, "parts", "start", "stop")
    told = {f"k{i}": rows.column(c) for i, c in enumerate([*keys, "kmer"])} | {"n": sizes}
    for p in range(int(sizes.max(initial=0))):
        some = p < sizes
        at = np.where(some, ends[:-1] + p, 0)
        told |= {f"{side}{p}": np.where(some, x[at], 0) for side, x in zip("ab", numbers)}
    found = pa.table(told | {"row": np.arange(rows.num_rows)}).group_by([*told], use_threads=False).aggregate([("row", "min")])
    return rows.take(np.sort(found.column("row_min").to_numpy()))


def _cut(batch: pa.RecordBatch, k: int, kept: list[str], count: str | None):
    """The batches of `with_kmers` that a batch gives."""
    text = at = data = None
    if count:
        n = batch.column(count).to_numpy(zero_copy_only=False).astype(np.int64)
    else:
        text, at, data = _bytes(batch.column("peptide"))
        if data.size and data.max() > 127:  # letters of several bytes
            text = text.to_pylist()
            n = np.array([len(x or "") for x in text], np.int64) - (k - 1)
        else:
            text, n = None, np.diff(at) - (k - 1)
    ends = np.cumsum(np.maximum(n, 0))
    plus = np.array([x == "+" for x in batch.column("strand").to_pylist()])
    parts = pa.concat_arrays([batch.column("parts")])
    kind, offsets = parts.type, parts.offsets.to_numpy().astype(np.int64)
    begin, end = (pa.concat_arrays([parts.values]).field(f) for f in ("start", "stop"))
    number = begin.type
    begin, end = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in (begin, end))
    sizes = np.diff(offsets)
    for low in range(0, int(ends[-1]) if len(ends) else 0, CUT):
        of = np.arange(low, min(low + CUT, int(ends[-1])))
        row = np.searchsorted(ends, of, "right")
        pos = of - (ends[row] - np.maximum(n[row], 0))
        most = int(sizes[row].max())
        held, left, right = np.zeros((len(of), most), bool), np.zeros((len(of), most), np.int64), np.zeros((len(of), most), np.int64)
        done = np.zeros(len(of), np.int64)
        for p in range(most):
            some = p < sizes[row]
            x = np.where(some, offsets[row] + p, 0)
            a, b = np.maximum(3 * pos - done, 0), np.minimum(3 * (pos + k) - done, end[x] - begin[x])
            held[:, p] = some & (a < b)
            left[:, p] = np.where(plus[row], begin[x] + a, end[x] - b)
            right[:, p] = np.where(plus[row], begin[x] + b, end[x] - a)
            done += end[x] - begin[x]
        pieces = pa.StructArray.from_arrays([pa.array(left[held]).cast(number), pa.array(right[held]).cast(number)], fields=list(kind.value_type))
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(held.sum(1))]).astype(np.int32)), pieces)
        columns = [batch.column(name).take(pa.array(row)) for name in kept] + [pa.array(pos.astype(np.int32))]
        if text is not None:
            columns.append(pa.array([text[r][p : p + k] for r, p in zip(row.tolist(), pos.tolist())], pa.string()))
        elif not count:
            letters = data[(at[row] + pos)[:, None] + np.arange(k)]
            columns.append(pa.Array.from_buffers(pa.string(), len(of), [None, pa.py_buffer((k * np.arange(len(of) + 1)).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(letters))]))
        yield pa.RecordBatch.from_arrays([*columns, lists], [*kept, "pos", *([] if count else ["kmer"]), "parts"])


def coordinate_text(parts: Column) -> Column:
    """Pieces as a:b:c:d:e:f, with nan for a missing second piece and None for a missing third."""
    at = lambda k, f: F.get(parts, F.lit(k))[f].cast("string")
    second = lambda f: F.coalesce(at(1, f), F.lit("nan"))
    third = lambda f: F.coalesce(at(2, f), F.lit("None"))
    return F.concat_ws(":", at(0, "start"), at(0, "stop"), second("start"), second("stop"), third("start"), third("stop"))


def coordinate_numbers(text: Column) -> Column:
    """The numbers of a coordinate text; nan and None become null."""
    return F.transform(F.split(text, ":"), lambda x: x.try_cast("int"))


def junction_keys(numbers: Column | list[Column]) -> Column:
    """Strand and the keys of the first and second junction of coordinate numbers, an array or a column each, compared as numbers."""
    c = numbers if isinstance(numbers, list) else [F.get(numbers, F.lit(k)) for k in range(6)]
    plus = c[1] < c[2]
    key = lambda a, b: F.when(a.isNotNull() & b.isNotNull(), F.concat_ws(":", a, b))
    return F.struct(
        F.when(c[2].isNotNull(), F.when(plus, "+").otherwise("-")).alias("strand"),
        F.when(plus, key(c[1], c[2])).otherwise(key(c[3], c[0])).alias("jct1"),
        F.when(plus, key(c[3], c[4])).otherwise(key(c[5], c[2])).alias("jct2"),
    )


def overlap_joined(front: Column, back: Column, front_start: Column | None = None, back_start: Column | None = None) -> Column:
    """front and back joined at the longest suffix of front that begins back; null without one.

    With the bases at which both start, only an overlap that puts them into one frame counts: where back starts
    a multiple of three bases after (or before) front.
    """
    sizes = F.sequence(F.lit(1), F.greatest(F.least(F.length(front), F.length(back)), F.lit(1)))
    size = F.array_max(F.filter(sizes, lambda n: F.right(front, n) == F.left(back, n)))
    joined = F.concat(front, F.substring(back, size + 1, F.length(back)))
    return joined if front_start is None else F.when((back_start - front_start) % 3 == 0, joined)


def inside_open(pos: Column, a: Column, b: Column) -> Column:
    """Whether a variant stands strictly between a and b."""
    return (a < pos) & (pos < b)


def mutation_mode(germline: bool, somatic: bool) -> str:
    """The name of a run's mutation mode."""
    return {(False, False): "ref", (True, False): "germline", (False, True): "somatic", (True, True): "somatic_and_germline"}[bool(germline), bool(somatic)]


def strand_leq(strand: Column, a: Column, b: Column) -> Column:
    return F.when(strand == "+", a <= b).otherwise(a >= b)


def chromosome_name(code: Column) -> Column:
    """23, 24 and 25 stand for X, Y and MT."""
    return F.when(code == 23, "X").when(code == 24, "Y").when(code == 25, "MT").otherwise(code.cast("string"))


def attributes(text: Column) -> Column:
    """Attribute column of an annotation line as a map, for key "value"; and for key=value; the first of a key stays."""
    pairs = F.filter(F.transform(F.split(text, ";"), lambda x: F.trim(x)), lambda x: x != "")
    key = lambda x: F.regexp_extract(x, r"^([^\s=]+)", 1)
    value = lambda x: F.regexp_replace(F.regexp_replace(x, r"^[^\s=]+[\s=]+", ""), '"', "")
    keys = F.transform(pairs, key)
    first = F.filter(pairs, lambda x, i: F.array_position(keys, key(x)) == i + 1)
    return F.map_from_arrays(F.transform(first, key), F.transform(first, value))
