"""Variants without a table of combinations, held against enumeration in plain Python."""

import random
from itertools import combinations, product

import pytest
from pyspark.sql import functions as F

from spliceloom.functions import seq as s
from spliceloom.operators import expression as e
from spliceloom.operators import graph as g
from spliceloom.operators import peptides as p
from spliceloom.operators import variants as va

CODE = dict(zip(("".join(c) for c in product(s.BASES, repeat=3)), s.CODE))
TURN = str.maketrans("ACGT", "TGCA")


def read(dna, parts, strand, chosen=()):
    bases = list(dna)
    for pos, base in chosen:
        bases[pos] = base
    cut = ["".join(bases[a:b]) for a, b in parts]
    return "".join(cut) if strand == "+" else "".join(x[::-1].translate(TURN) for x in cut)


def translated(dna):
    return "".join(CODE.get(dna[i : i + 3], "X") for i in range(0, len(dna) - 2, 3))


def subsets(held):
    return [c for n in range(len(held) + 1) for c in combinations(held, n)]


def _rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def _case(seed, genes=8, density=0.05, length=400):
    """Genes of three exons on either strand, with some variants of two samples."""
    rng = random.Random(seed)
    vertices, edges, dna, variants = [], [], {}, []
    for k in range(genes):
        gene, strand = f"g{k}", "+-"[k % 2]
        dna[gene] = "".join(rng.choice("ACGT") for _ in range(length))
        cuts = sorted(rng.sample(range(5, length - 5), 6))
        ends = list(zip(cuts[::2], cuts[1::2]))
        if strand == "-":
            ends.reverse()
        vertices += [(gene, v, a, b, strand) for v, (a, b) in enumerate(ends)]
        edges += [(gene, 0, 1), (gene, 1, 2), (gene, 0, 2)]
        for sample in ("s", "t"):
            variants += [(gene, sample, pos, rng.choice("ACGT*")) for pos in range(length) if rng.random() < density]
    return vertices, edges, dna, variants


def _frames(spark, vertices, edges, dna, variants):
    table = lambda rows, schema: spark.createDataFrame(rows, schema)
    return (
        table(vertices, "gene string, v int, start int, stop int, strand string"),
        table(edges, "gene string, src int, dst int"),
        table([(k, d, 0) for k, d in dna.items()], "gene string, dna string, offset int"),
        table(variants, "gene string, sample string, pos int, base string"),
    )


def _held(variants, gene, sample, parts):
    return [(pos, b) for g_, s_, pos, b in variants if (g_, s_) == (gene, sample) and b != "*" and any(a <= pos < z for a, z in parts)]


def test_steps_that_variants_open_and_their_frames(spark):
    vertices, edges, dna, variants = _case(1, genes=12, density=0.02)
    v, links, sequences, held = _frames(spark, vertices, edges, dna, variants)
    at = {(gene, k): (a, b, strand) for gene, k, a, b, strand in vertices}
    seeds = spark.createDataFrame([(gene, 0, 0, True) for gene in dna] + [("g0", 0, 4, True)], "gene string, v int, phase int, annotated boolean")
    exons = g.exon_sequences(v, sequences)
    steps = g.transitions(exons, links, seeds)
    opened = va.opened_steps(steps, exons, held)

    def stop(gene, a, b, phase, chosen):
        x, y = at[gene, a], at[gene, b]
        first = read(dna[gene], [x[:2]], x[2], chosen)[phase:]
        return "_" in translated(first + read(dna[gene], [y[:2]], y[2], chosen))

    expected, frames = set(), set()
    for gene in dna:
        for sample in ("s", "t"):
            open_ = {}
            for _, a, b in [x for x in edges if x[0] == gene]:
                for phase in {0, 1, 2, *([4] if (gene, a) == ("g0", 0) else [])}:
                    own = _held(variants, gene, sample, [at[gene, a][:2], at[gene, b][:2]])
                    n = at[gene, a][1] - at[gene, a][0]
                    here = stop(gene, a, b, phase, ())
                    some = any(not stop(gene, a, b, phase, c) for c in subsets(own))
                    if here and some:
                        expected.add((gene, sample, a, b, phase))
                    if some:
                        open_.setdefault((a, phase), []).append((b, -(n - phase) % 3))
            reached = {(0, 0), *([(0, 4)] if gene == "g0" else [])}
            todo = list(reached)
            while todo:
                for nxt in open_.get(todo.pop(), []):
                    if nxt not in reached:
                        reached.add(nxt)
                        todo.append(nxt)
            frames |= {(gene, sample, *f) for f in reached}
    assert {tuple(r)[:5] for r in opened.collect()} == expected and expected
    owners = {x[:2] for x in expected}
    for order in (None, g.vertex_order(v)):
        got = {tuple(r)[:4] for r in g.variant_frames(steps, opened, seeds, order).collect()}
        assert got == {x for x in frames if x[:2] in owners}
    flags = {(r.gene, r.sample, r.v, r.w, r.phase) for r in va.sample_steps(steps, opened).where("not has_stop").collect()}
    assert expected <= flags


@pytest.mark.parametrize(("density", "k"), [(0.04, 4), (0.01, 9)])
def test_mutated_kmers_equal_those_of_all_combinations(spark, density, k):
    vertices, edges, dna, variants = _case(int(density * 100), genes=6, density=density, length=260)
    v, links, sequences, held = _frames(spark, vertices, edges, dna, variants)
    frames = g.all_frames(v)
    pairs = p.modified_pairs(links.withColumnsRenamed({"src": "v", "dst": "w"}).join(frames, ["gene", "v"]), v).cache()
    got = _rows(va.mutated_kmers(pairs, sequences, held, k).select("gene", "sample", "v", "w", "phase", "pos", "kmer", F.concat_ws(";", F.col("variants.pos").cast("array<string>"))))
    expected = set()
    for r in pairs.collect():
        parts = [tuple(x) for x in r.parts]
        spots = [list(range(a, b)) if r.strand == "+" else list(range(b - 1, a - 1, -1)) for a, b in parts]
        spots = [x for y in spots for x in y]
        ref = translated(read(dna[r.gene], parts, r.strand)).split("_")[0]
        for sample in ("s", "t"):
            for chosen in subsets(_held(variants, r.gene, sample, parts)):
                peptide = translated(read(dna[r.gene], parts, r.strand, chosen)).split("_")[0]
                for i in range(len(peptide) - k + 1):
                    if peptide[i : i + k] != ref[i : i + k]:
                        own = sorted(pos for pos, _ in chosen if pos in spots[3 * i : 3 * (i + k)])
                        expected.add((r.gene, sample, r.v, r.w, r.phase, i, peptide[i : i + k], ";".join(map(str, own))))
    assert got == sorted(expected, key=str) and expected


def test_a_hundred_variants_in_a_pair(spark):
    dna = {"g": ("GCA" * 2000)}
    v, links, sequences, held = _frames(spark, [("g", 0, 0, 3000, "+"), ("g", 1, 3003, 6000, "+")], [("g", 0, 1)], dna, [("g", "s", 60 * k + 1, "A") for k in range(100)])
    pairs = p.modified_pairs(spark.createDataFrame([("g", 0, 1, 0, True)], "gene string, v int, w int, phase int, annotated boolean"), v)
    rows = va.mutated_kmers(pairs, sequences, held, 9)
    # one variant stands in the intron, and the first one's codon begins the pair
    assert rows.count() == 99 * 9 - 8 and rows.select("variants").distinct().count() == 99


def test_triples_and_single_exons_have_mutated_kmers(spark):
    vertices = [("g", 0, 0, 9, "+"), ("g", 1, 12, 15, "+"), ("g", 2, 20, 29, "+")]
    v, links, sequences, held = _frames(spark, vertices, [("g", 0, 1)], {"g": "GCAGCAGCATTTGCATTTTTGCAGCAGCATT"}, [("g", "s", 13, "A"), ("g", "s", 1, "A")])
    triple = p.modified_pairs(spark.createDataFrame([("g", 0, 1, 2, 0, False)], "gene string, v int, w int, u int, phase int, annotated boolean"), v)
    rows = va.mutated_kmers(triple, sequences, held, 5)
    assert {(r.pos, r.kmer, r.coord) for r in rows.where("size(variants) = 1 and variants[0].pos = 13").collect()} == {
        (0, "AAAEA", "0:9:12:15:20:23"), (1, "AAEAA", "3:9:12:15:20:26"), (2, "AEAAA", "6:9:12:15:20:29")}
    single = p.modified_pairs(spark.createDataFrame([("g", 0, 0, False)], "gene string, v int, phase int, annotated boolean"), v)
    assert _rows(va.mutated_kmers(single, sequences, held, 3).select("kmer", "coord")) == [("EAA", "0:9:nan:nan:None:None")]


def test_interval_join_with_dense_bins(spark):
    rng = random.Random(2)
    spans = [(f"c{rng.randrange(3)}", a, a + rng.randrange(0, 4000), k) for k, a in enumerate(rng.sample(range(9000), 80))]
    points = [(f"c{rng.randrange(4)}", rng.randrange(9000), k) for k in range(400)] + [("c0", 5000, 1000 + k) for k in range(60)]
    left, right = spark.createDataFrame(spans, "chrom string, start int, stop int, id int"), spark.createDataFrame(points, "chrom string, pos int, line int")
    expected = sorted((i, n) for c, a, b, i in spans for d, x, n in points if c == d and a <= x < b)
    for size, dense in ((1024, 100_000), (64, 7)):
        assert sorted((r.id, r.line) for r in va.within(left, right, ["chrom"], size, dense).collect()) == expected
    plan = va.within(left, right, ["chrom"])._jdf.queryExecution().executedPlan().toString()
    assert "__bin" in plan and "Cartesian" not in plan


def test_last_segment_takes_the_later_of_equal_starts(spark):
    segments = spark.createDataFrame([("g", 0, 5, 1), ("g", 10, 20, 2), ("g", 10, 30, 3), ("h", 0, 9, 4)], "gene string, seg_start int, seg_stop int, seg_id int")
    points = spark.createDataFrame([("g", "s", x) for x in (0, 5, 7, 10, 30, 31)] + [("h", "s", 0), ("z", "s", 1)], "gene string, sample string, pos int")
    assert _rows(e.variant_segment(points, segments)) == [("g", "s", 0, 1), ("g", "s", 10, 3), ("g", "s", 30, 3), ("g", "s", 5, 1), ("h", "s", 0, 4)]
    assert va.last_segment(points, segments).count() == 8


def test_folded_and_spread_frames_agree_on_walks_of_many_steps(spark):
    n = 300
    vertices = spark.createDataFrame([("g", k, 10 * k, 10 * k + 7 + k % 3, "+") for k in range(n)] + [("h", 0, 0, 9, "-")], "gene string, v int, start int, stop int, strand string")
    dna = spark.createDataFrame([("g", "GCA" * 1100, 0), ("h", "GCA" * 4, 0)], "gene string, dna string, offset int")
    edges = spark.createDataFrame([("g", k, k + d) for k in range(n) for d in (1, 2) if k + d < n], "gene string, src int, dst int")
    seeds = spark.createDataFrame([("g", 0, 1, True), ("g", 50, 8, True), ("h", 0, 0, True)], "gene string, v int, phase int, annotated boolean")
    steps = g.transitions(g.exon_sequences(vertices, dna), edges, seeds)
    folded = _rows(g.propagated_frames(steps, seeds, g.vertex_order(vertices)))
    assert len(folded) > n
    short = steps.where("v < 10")
    for most in (0, 40_000):
        assert _rows(g.propagated_frames(short, seeds, g.vertex_order(vertices), most)) == _rows(g.propagated_frames(short, seeds))


