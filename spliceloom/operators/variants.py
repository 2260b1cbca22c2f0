"""Variants on intervals, segments, frames and k-mers, without a table of their combinations.

variants: gene, sample, pos, base on the plus strand, one base for each place of a sample; * keeps the base. The exons of an edge,
a pair or a triple don't overlap, so that each variant stands in one codon of it: whether some combination of variants has no stop, and
which k-mers combinations give, is then told codon by codon.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spliceloom.functions.seq import STOPS, combinations, complement, coordinate_text, genomic_parts, residue, residues
from spliceloom.staging import written

#: Positions of a bin in which intervals and points meet, and points of a bin that one task takes.
BIN, DENSE = 1024, 100_000


def within(intervals: DataFrame, points: DataFrame, keys: list[str], size: int = BIN, dense: int = DENSE) -> DataFrame:
    """Rows of intervals (keys, start, stop, ...) with those of points (keys, pos, ...) in them: start <= pos < stop.

    An interval stands in every bin that it touches and a point in one, so they meet by equality of keys and bin. Points of a bin
    with more than dense of them are dealt out by salts, and its intervals repeated for each.
    """
    at = lambda c: F.floor(c / size)
    left = intervals.where("start < stop").withColumn("__bin", F.explode(F.sequence(at(F.col("start")), at(F.col("stop") - 1))))
    right = points.withColumn("__bin", at(F.col("pos")))
    on = [*keys, "__bin"]
    salts = F.ceil(F.count("*") / dense).cast("int").alias("__salts")
    crowded = written(right.groupBy(*on).agg(salts).where("__salts > 1"), "crowded")
    if not crowded.isEmpty():
        some = F.coalesce("__salts", F.lit(1))
        left = left.join(crowded, on, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), some - 1))).drop("__salts")
        dealt = F.pmod(F.xxhash64(*[F.col(c) for c in points.columns]), some).cast("int")
        right = right.join(crowded, on, "left").withColumn("__salt", dealt).drop("__salts")
        on = [*on, "__salt"]
    return left.join(right, on).where("start <= pos and pos < stop").drop("__bin", "__salt")


def overlapping(left: DataFrame, right: DataFrame, keys: list[str], a: tuple[str, str], b: tuple[str, str], size: int = BIN) -> DataFrame:
    """Rows of left and right whose intervals, in the columns a and b, overlap, by bins as in `within`; each pair once.

    A pair that shares several bins is taken in the one where the later of the two begins.
    """
    at = lambda c: F.floor(c / size)
    sides = [rows.where(F.col(x[0]) < F.col(x[1])).withColumn("__bin", F.explode(F.sequence(at(F.col(x[0])), at(F.col(x[1]) - 1)))) for rows, x in ((left, a), (right, b))]
    met = sides[0].join(sides[1], [*keys, "__bin"]).where((F.col(a[0]) < F.col(b[1])) & (F.col(b[0]) < F.col(a[1])))
    return met.where(F.col("__bin") == at(F.greatest(a[0], b[0]))).drop("__bin")


def last_segment(points: DataFrame, segments: DataFrame) -> DataFrame:
    """points (gene, pos, ...) with segment: the last of segments (gene, seg_start, seg_stop, ...) that starts at or before pos.

    Of segments with one start the one that ends last counts, then the greatest by the other columns' order; before all of them it is
    null. Both tables are sorted together once, by gene and place, and a window carries the last segment on.
    """
    names = [c for c in segments.columns if c != "gene"]
    rows = segments.select("gene", F.col("seg_start").cast("long").alias("__at"), F.struct(*names).alias("segment"), F.lit(None).cast(points.drop("gene").select(F.struct("*").alias("p")).schema["p"].dataType).alias("__point"))
    other = points.select("gene", F.col("pos").cast("long").alias("__at"), F.lit(None).cast(rows.schema["segment"].dataType).alias("segment"), F.struct(*[c for c in points.columns if c != "gene"]).alias("__point"))
    order = Window.partitionBy("gene").orderBy("__at", F.col("__point").isNotNull(), "segment").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = rows.unionByName(other).withColumn("segment", F.last("segment", ignorenulls=True).over(order))
    return carried.where("__point is not null").select("gene", "__point.*", "segment")


def _read(base: Column, strand: Column) -> Column:
    """A base of the plus strand as it is read."""
    return F.when(strand == "+", base).otherwise(complement(base))


def _changed(codon: Column, chosen: Column) -> Column:
    """A codon with the chosen variants (k, the place in the codon, and base) put in."""
    return F.aggregate(chosen, codon, lambda s, v: F.overlay(s, v.base, v.k + 1, F.lit(1)))


def opened_steps(steps: DataFrame, exons: DataFrame, variants: DataFrame) -> DataFrame:
    """Steps that a sample's variants open: gene, sample, v, w, phase, next_phase of those with a stop in the reference for which some
    combination of the sample's variants has none.

    steps are the transitions of the reference, exons (gene, v, start, stop, strand, seq) its sequences. A combination without a
    stop exists if and only if each stop codon has a choice of the variants in it that is no stop, so only bases of stop codons
    are held against variants, by place, and a pair with n variants costs n, not 2**n.
    """
    variants = variants.where("base != '*'").select("gene", "sample", F.col("pos").cast("long").alias("pos"), "base").distinct()
    closed = steps.where("has_stop").select("gene", "v", "w", "phase", "next_phase").join(variants.select("gene").distinct(), "gene", "left_semi")
    end = lambda v, k: exons.select("gene", F.col("v").alias(v), *[F.col(c).alias(f"{c}{k}") for c in ("start", "stop", "seq")], *(["strand"] if k == 1 else []))
    rows = closed.join(end("v", 1), ["gene", "v"]).join(end("w", 2), ["gene", "w"])
    coding = F.concat(F.substring(F.col("seq1"), F.col("phase") + 1, F.length("seq1")), F.col("seq2"))
    codons = F.transform(F.regexp_extract_all(F.upper(coding), F.lit("(?s).{3}"), F.lit(0)), lambda c, i: F.struct(i.alias("i"), c.alias("codon")))
    rows = rows.withColumns({"stops": F.filter(codons, lambda c: c.codon.isin(*STOPS)), "lead": F.length("seq1") - F.col("phase")}).drop("seq1", "seq2")
    rows = rows.select("*", F.size("stops").alias("n_stops"), F.explode("stops").alias("x")).drop("stops").select("*", "x.i", "x.codon", F.explode(F.array(*[F.lit(k) for k in range(3)])).alias("k")).drop("x")
    at = 3 * F.col("i") + F.col("k")
    plus = F.when(at < F.col("lead"), F.col("start1") + F.col("phase") + at).otherwise(F.col("start2") + at - F.col("lead"))
    minus = F.when(at < F.col("lead"), F.col("stop1") - 1 - F.col("phase") - at).otherwise(F.col("stop2") - 1 - (at - F.col("lead")))
    rows = rows.withColumn("pos", F.when(F.col("strand") == "+", plus).otherwise(minus).cast("long"))
    step = ["gene", "sample", "v", "w", "phase", "next_phase", "n_stops"]
    met = rows.select(*[c for c in step if c != "sample"], "strand", "i", "codon", "k", "pos").join(variants, ["gene", "pos"])
    held = met.groupBy(*step, "i", "codon").agg(F.collect_set(F.struct("k", _read(F.col("base"), F.col("strand")).alias("base"))).alias("held"))
    saved = held.where(F.exists(combinations(F.col("held")), lambda chosen: ~_changed(F.col("codon"), chosen).isin(*STOPS)))
    return saved.groupBy(*step).agg(F.count("*").alias("n")).where("n = n_stops").select(step[:-1])


def sample_steps(steps: DataFrame, opened: DataFrame) -> DataFrame:
    """steps of each sample that opens any in a gene, as gene, sample, ..., has_stop: whether all its combinations have a stop."""
    rows = steps.join(opened.select("gene", "sample").distinct(), "gene")
    held = opened.select("gene", "sample", "v", "w", "phase", F.lit(True).alias("opened"))
    rows = rows.join(held, ["gene", "sample", "v", "w", "phase"], "left")
    return rows.withColumn("has_stop", F.col("has_stop") & F.col("opened").isNull()).drop("opened")


def _held(pairs: DataFrame, variants: DataFrame, keys: list[str]) -> DataFrame:
    """Per row of pairs and sample, the variants in its parts: held, an array of codon, k (the place in it), pos and base as read."""
    sizes = F.transform("parts", lambda p: p.stop - p.start)
    begins = F.transform("parts", lambda _, n: F.aggregate(F.slice(sizes, F.lit(1), n), F.lit(0), lambda a, x: a + x))
    spans = pairs.select(*keys, "strand", begins.alias("begins"), F.posexplode("parts").alias("n", "part"))
    spans = spans.select(*keys, "strand", F.get("begins", F.col("n")).alias("begin"), "part.start", "part.stop")
    near = within(spans, variants.where("base != '*'").select("gene", "sample", "pos", "base"), ["gene"])
    at = F.col("begin") + F.when(F.col("strand") == "+", F.col("pos") - F.col("start")).otherwise(F.col("stop") - 1 - F.col("pos"))
    near = near.withColumn("at", at.cast("int"))
    one = F.struct(F.floor(F.col("at") / 3).cast("int").alias("codon"), (F.col("at") % 3).alias("k"), F.col("pos").cast("int").alias("pos"), _read(F.col("base"), F.col("strand")).alias("base"))
    return near.groupBy(*keys, "sample").agg(F.array_sort(F.collect_set(one)).alias("held"))


def mutated_kmers(pairs: DataFrame, sequences: DataFrame | None, variants: DataFrame, k: int) -> DataFrame:
    """K-mers that combinations of a sample's variants give and the reference, at the same place of the pair, does not.

    pairs are modified ones (also triples and single exons). Columns: gene, sample, the exons, phase, annotated, strand, pos (residue), kmer, variants (pos and
    base of those in the k-mer's own bases, in order), pieces and coord in the genome, isCrossJunction. Each is a row of its own: a k-mer stands
    once for each choice of the variants in its 3k bases that gives it, however the others are chosen, if some choice of those
    before it leaves no stop. A k-mer behind the reference's first stop counts as new, also without variants of its own. So what is combined
    is bounded by the k-mer, not by the pair; a row of pairs with n variants in it costs n windows of k residues.
    sequences may be those of samples, with a column sample; pairs with bases of their own need none.
    """
    ends = [c for c in ("v", "w", "u") if c in pairs.columns]
    keys = ["gene", *ends, "phase"]
    some = pairs.join(variants.select("gene").distinct(), "gene", "left_semi")
    held = _held(some, variants, keys)
    own = ["gene", "sample"] if sequences is not None and "sample" in sequences.columns else ["gene"]
    from spliceloom.operators.peptides import coding_bases, coding_of

    # bases of the parts only go on from here
    read = some if sequences is None else some.drop("bases").join(sequences.hint("merge"), "gene")
    read = read.select(*dict.fromkeys([*own, *keys]), "annotated", "strand", "parts", (coding_of(F.col("bases")) if sequences is None else coding_bases()).alias("coding"))
    rows = held.join(read, [*keys, *own[1:]]).withColumn("ref", residues(F.col("coding")))

    def choices(c: Column) -> Column:
        inside = F.filter("held", lambda h: h.codon == c)
        codon = F.upper(F.substring(F.col("coding"), 3 * c + 1, F.lit(3)))
        made = F.transform(combinations(inside), lambda chosen: F.struct(F.transform(chosen, lambda v: F.struct(v.pos.alias("pos"), _read(v.base, F.col("strand")).alias("base"))).alias("variants"), residue(_changed(codon, chosen)).alias("residue")))
        return F.struct(c.alias("codon"), F.filter(made, lambda m: m.residue != "_").alias("made"))

    n = F.length("ref")
    whole = F.filter(F.array_distinct(F.transform("held", lambda h: h.codon)), lambda c: c < n)  # 1 or 2 last bases are in no codon
    rows = rows.withColumn("touched", F.transform(whole, choices))
    shown = F.aggregate("touched", F.col("ref"), lambda s, t: F.overlay(s, F.when(F.size(t.made) > 0, "X").otherwise("_"), t.codon + 1, F.lit(1)))
    before = lambda text: F.coalesce(F.nullif(F.instr(text, F.lit("_")), F.lit(0)) - 1, F.length(text))
    rows = rows.withColumns({"reach": before(shown), "first_stop": before(F.col("ref"))})

    def window(i: Column) -> Column:
        near = F.filter("touched", lambda t: (t.codon >= i) & (t.codon < i + k))
        return F.struct(i.alias("pos"), F.substring(F.col("ref"), i + 1, F.lit(k)).alias("plain"), near.alias("near"), (i + k > F.col("first_stop")).alias("behind"))

    spans = F.transform(F.sequence(F.lit(0), F.greatest(F.col("reach") - k, F.lit(0))), window)
    spans = F.filter(spans, lambda x: x.behind | (F.size(x.near) > 0))
    rows = rows.where(F.col("reach") >= k).select("sample", *keys, "annotated", "strand", "parts", F.explode(spans).alias("x")).select("*", "x.*").drop("x")
    nothing = F.struct(F.array().cast("array<struct<pos:int,base:string>>").alias("variants"), F.col("plain").alias("kmer"))
    put = lambda a, t: F.transform(t.made, lambda m: F.struct(F.concat(a.variants, m.variants).alias("variants"), F.overlay(a.kmer, m.residue, t.codon - F.col("pos") + 1, F.lit(1)).alias("kmer")))
    made = F.aggregate("near", F.array(nothing), lambda acc, t: F.flatten(F.transform(acc, lambda a: put(a, t))))
    rows = rows.withColumn("y", F.explode(made)).where(F.col("behind") | (F.col("y.kmer") != F.col("plain")))
    pieces = genomic_parts(F.col("pos"), k, F.col("parts"), F.col("strand"))
    rows = rows.select("gene", "sample", *ends, "phase", "annotated", "strand", "pos", "y.kmer", F.array_sort("y.variants").alias("variants"), pieces.alias("pieces"))
    return rows.withColumns({"coord": coordinate_text(F.col("pieces")), "isCrossJunction": F.size("pieces") > 1})
