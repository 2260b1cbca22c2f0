"""Splice graphs: reading frames, their spread over edges, exon pairs and triples.

vertices: gene, v, start, stop, strand. edges: gene, src, dst in reading order. frames: gene, v, phase, annotated,
where phase bases of the vertex, in reading order, come before its first codon.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spliceloom.functions.seq import has_stop, reverse_complement
from spliceloom.staging import append, opened, written


#: Open steps of a gene that are folded over in one row: some 4,000 vertices.
WIDE = 40_000


def exon_sequences(vertices: DataFrame, sequences: DataFrame | None = None) -> DataFrame:
    """vertices with their bases in reading order, from sequences (gene, dna, offset) or from their own bases of the plus strand."""
    if sequences is None:
        return vertices.withColumn("seq", F.when(F.col("strand") == "+", F.col("bases")).otherwise(reverse_complement(F.col("bases")))).drop("bases")
    bases = F.substring(F.col("dna"), (F.col("start") - F.col("offset") + 1).cast("int"), (F.col("stop") - F.col("start")).cast("int"))
    read = F.when(F.col("strand") == "+", bases).otherwise(reverse_complement(bases))
    return vertices.join(sequences.hint("merge"), "gene").withColumn("seq", read).drop("dna", "offset")


def seed_frames(vertices: DataFrame, first: DataFrame) -> DataFrame:
    """Frames of the vertices in which a transcript's first piece (gene, left, right, phase) starts."""
    inside = F.when(F.col("strand") == "+", (F.col("start") <= F.col("left")) & (F.col("left") < F.col("stop"))).otherwise((F.col("start") < F.col("right")) & (F.col("right") <= F.col("stop")))
    lead = F.when(F.col("strand") == "+", F.least(F.col("left") + F.col("shift"), F.col("stop")) - F.col("start")).otherwise(F.col("stop") - F.greatest(F.col("right") - F.col("shift"), F.col("start")))
    joined = vertices.select("gene", "v", "start", "stop", "strand").join(first.select("gene", "left", "right", F.col("phase").alias("shift")), "gene").where(inside)
    return joined.select("gene", "v", lead.cast("int").alias("phase"), F.lit(True).alias("annotated")).distinct()


def all_frames(vertices: DataFrame) -> DataFrame:
    """Every vertex in the three frames."""
    return vertices.select("gene", "v", F.explode(F.array(*[F.lit(p) for p in range(3)])).alias("phase"), F.lit(False).alias("annotated"))


def next_phase(length: Column, phase: Column) -> Column:
    """Bases of the next exon that finish the codon which this exon leaves open."""
    return F.pmod(-(length - phase), F.lit(3)).cast("int")


def frame_steps(exons: DataFrame, edges: DataFrame, frames: DataFrame) -> DataFrame:
    """frames (gene, v, phase) carried over each edge: w, next phase, and whether the pair's translation has a stop."""
    src = exons.select("gene", F.col("v").alias("src"), F.col("seq").alias("s1"))
    dst = exons.select("gene", F.col("v").alias("dst"), F.col("seq").alias("s2"))
    rows = frames.withColumnRenamed("v", "src").join(edges, ["gene", "src"]).join(src, ["gene", "src"]).join(dst, ["gene", "dst"])
    coding = F.concat(F.substring(F.col("s1"), F.col("phase") + 1, F.length("s1")), F.col("s2"))
    return rows.select("gene", F.col("src").alias("v"), F.col("dst").alias("w"), "phase", next_phase(F.length("s1"), F.col("phase")).alias("next_phase"), has_stop(coding).alias("has_stop"))


def transitions(exons: DataFrame, edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """frame_steps of every phase that can reach a vertex, its seeds' and 0 to 2, as a table of numbers made once.

    Sequences meet once for an edge and are read in all its phases there.
    """
    src = exons.select("gene", F.col("v").alias("src"), F.col("seq").alias("s1"))
    dst = exons.select("gene", F.col("v").alias("dst"), F.col("seq").alias("s2"))
    late = seeds.where("phase > 2").groupBy("gene", F.col("v").alias("src")).agg(F.collect_set("phase").alias("late"))
    rows = edges.join(src, ["gene", "src"]).join(late, ["gene", "src"], "left").join(dst, ["gene", "dst"])
    phases = F.concat(F.array(*[F.lit(p) for p in range(3)]), F.coalesce("late", F.array().cast("array<int>")))
    rows = rows.select("gene", F.col("src").alias("v"), F.col("dst").alias("w"), F.length("s1").alias("n"), F.concat("s1", "s2").alias("coding"), F.explode(phases).alias("phase"))
    # of a seed past the end of its vertex nothing of the vertex is left
    rest = F.when(F.col("phase") < F.col("n"), F.substring("coding", F.col("phase") + 1, F.length("coding"))).otherwise(F.substring("coding", F.col("n") + 1, F.length("coding")))
    return written(rows.select("gene", "v", "w", "phase", next_phase(F.col("n"), F.col("phase")).alias("next_phase"), has_stop(rest).alias("has_stop")), "steps")


def propagated_frames(steps: DataFrame, seeds: DataFrame, order: DataFrame | None = None, most: int = WIDE) -> DataFrame:
    """All frames that reach a vertex: seeds, and frames of pairs without a stop, until nothing is new.

    steps are the transitions. A frame that is annotated stays so and isn't repeated as carried. With order (gene, v, place), the
    vertices' reading order, a gene's open steps are folded over in that order within one row, and no frame needs a second look.
    Genes with more than most open steps, or with a step against the order, go the way of all genes without order: a round
    carries all new frames over one edge, so rounds are as many as the longest walk, and each moves numbers only.
    """
    seeds = seeds.select("gene", "v", "phase", "annotated").distinct()
    open_steps = steps.where("not has_stop").select("gene", "v", "w", "phase", "next_phase")
    if order is None:
        return _spread(open_steps, seeds)
    place = lambda v, at: order.select("gene", F.col("v").alias(v), F.col("place").alias(at))
    placed = written(open_steps.join(place("v", "from"), ["gene", "v"]).join(place("w", "to"), ["gene", "w"]), "placed")
    wide = placed.groupBy("gene").agg(F.count("*").alias("n"), F.max(F.col("to") <= F.col("from")).alias("back")).where((F.col("n") > most) | F.col("back")).select("gene")
    wide = written(wide, "wide")
    if wide.isEmpty():
        return _folded(placed, seeds)
    few = _folded(placed.join(wide, "gene", "left_anti"), seeds.join(wide, "gene", "left_anti"))
    return few.unionByName(_spread(open_steps.join(wide, "gene", "left_semi"), seeds.join(wide, "gene", "left_semi")))


def _folded(placed: DataFrame, seeds: DataFrame) -> DataFrame:
    """Frames of genes whose open steps (with from, the place of v) are folded over in reading order."""
    frame = lambda v, phase: F.struct(F.col(v).cast("long").alias("v"), F.col(phase).cast("int").alias("phase"))
    path = F.array_sort(F.collect_list(F.struct("from", frame("v", "phase").alias("a"), frame("w", "next_phase").alias("b")))).alias("path")
    begun = seeds.groupBy("gene").agg(F.collect_set(frame("v", "phase")).alias("begun"))
    rows = placed.groupBy("gene").agg(path).join(begun, "gene")

    def carry(reached: Column, s: Column) -> Column:
        new = F.array_contains(reached, s.a) & ~F.array_contains(reached, s.b)
        return F.when(new, F.concat(reached, F.array(s.b))).otherwise(reached)

    reached = F.aggregate("path", F.col("begun"), carry)
    found = rows.select("gene", F.explode(F.array_except(reached, F.col("begun"))).alias("f"))
    kind = seeds.schema["v"].dataType
    return seeds.unionByName(found.select("gene", F.col("f.v").cast(kind).alias("v"), F.col("f.phase").cast(seeds.schema["phase"].dataType).alias("phase"), F.lit(False).alias("annotated")))


def _spread(open_steps: DataFrame, seeds: DataFrame) -> DataFrame:
    """Frames by rounds over all genes, each a table in the shared folder."""
    spark = open_steps.sparkSession
    paths = [append(seeds, "frames")]
    fresh = opened(spark, paths, seeds.schema)
    while not fresh.isEmpty():
        seen = opened(spark, paths, seeds.schema)
        carried = fresh.join(open_steps, ["gene", "v", "phase"]).select("gene", F.col("w").alias("v"), F.col("next_phase").alias("phase")).distinct()
        new = carried.join(seen, ["gene", "v", "phase"], "left_anti").withColumn("annotated", F.lit(False))
        paths.append(append(new, "frames"))
        fresh = opened(spark, paths[-1:], seeds.schema)
    return opened(spark, paths, seeds.schema)


def variant_frames(steps: DataFrame, opened_steps: DataFrame, seeds: DataFrame, order: DataFrame | None = None) -> DataFrame:
    """Frames (gene, sample, v, phase, annotated) of the samples whose variants open steps of a gene; others have the reference's.

    opened_steps: gene, sample and a step of steps that has no stop in some combination of the sample's variants. A frame goes on
    over a pair if any combination has no stop, so a sample only ever has more frames than the reference.
    """
    both = F.struct("gene", "sample").alias("gene")
    owners = written(opened_steps.select("gene", "sample").distinct(), "owners")
    base = steps.where("not has_stop").join(owners, "gene").select(both, "v", "w", "phase", "next_phase", "has_stop")
    more = opened_steps.select(both, "v", "w", "phase", "next_phase", F.lit(False).alias("has_stop"))
    begun = seeds.join(owners, "gene").select(both, "v", "phase", "annotated")
    place = None if order is None else order.join(owners, "gene").select(both, "v", "place")
    return propagated_frames(base.unionByName(more).distinct(), begun, place).select("gene.gene", "gene.sample", "v", "phase", "annotated")


def exon_pairs(steps: DataFrame, frames: DataFrame) -> DataFrame:
    """Pairs of the graph with frame, stop flag and weight, one over the number of frames of the first vertex."""
    weight = F.round(1 / F.count("*").over(Window.partitionBy("gene", "v")), 3)
    known = frames.select("gene", "v", "phase", "annotated", weight.alias("weight"))
    return steps.join(known, ["gene", "v", "phase"])


def without_redundant(pairs: DataFrame, vertices: DataFrame) -> DataFrame:
    """Pairs of the graph that maximal_junctions keeps, by the places of their exons; of equal ones the later by v and w."""
    first, second = (vertices.select("gene", F.col("v").alias(v), F.col("start").alias(f"s_{v}"), F.col("stop").alias(f"e_{v}")) for v in "vw")
    rows = pairs.join(first, ["gene", "v"]).join(second, ["gene", "w"])
    ahead = F.col("s_v") <= F.col("s_w")
    bound = {"i1": ("e_v", "e_w"), "i2": ("s_w", "s_v"), "o1": ("s_v", "s_w"), "o2": ("e_w", "e_v")}
    rows = rows.withColumns({k: F.when(ahead, F.col(x)).otherwise(F.col(y)) for k, (x, y) in bound.items()})
    return maximal_junctions(rows.withColumn("seq_no", F.struct("v", "w"))).select(pairs.columns)


def successors(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """gene, v and each vertex that follows v in reading order over an edge of either direction; null where none does.

    On plus a vertex follows that starts no earlier, on minus one that stops no later, so that equal ends follow each other.
    """
    both = edges.select("gene", F.col("src").alias("v"), F.col("dst").alias("w")).unionByName(edges.select("gene", F.col("dst").alias("v"), F.col("src").alias("w"))).distinct()
    ends = vertices.select("gene", "v", "strand", "start", "stop")
    other = ends.select("gene", F.col("v").alias("w"), F.col("start").alias("w_start"), F.col("stop").alias("w_stop"))
    behind = F.when(F.col("strand") == "+", F.col("w_start") >= F.col("start")).otherwise(F.col("w_stop") <= F.col("stop"))
    found = both.join(ends, ["gene", "v"]).join(other, ["gene", "w"]).where(behind).select("gene", "v", F.col("w").alias("follows"))
    return vertices.select("gene", "v").join(found, ["gene", "v"], "left")


def vertex_order(vertices: DataFrame) -> DataFrame:
    """vertices with place, from 0: by start on plus, by falling stop on minus, and by v on ties."""
    key = F.when(F.col("strand") == "+", F.col("start")).otherwise(-F.col("stop"))
    return vertices.withColumn("place", F.row_number().over(Window.partitionBy("gene").orderBy(key, "v")) - 1)


def stop_in_all(variant_steps: DataFrame) -> DataFrame:
    """Pairs (gene, v, w, phase) with has_stop: whether every combination of variants (a row each) brings a stop."""
    return variant_steps.groupBy("gene", "v", "w", "phase").agg(F.bool_and("has_stop").alias("has_stop"))


def exon_triples(pairs: DataFrame, lengths: DataFrame, k: int) -> DataFrame:
    """Two pairs that meet in a vertex shorter than a k-mer and one codon, in one frame, the front without a stop."""
    short = lengths.where(F.col("length") < 3 * (k + 1)).select("gene", F.col("v").alias("m"))
    front = pairs.where("not has_stop").select("gene", F.col("v").alias("v1"), F.col("w").alias("m"), "phase", F.col("next_phase").alias("middle"))
    back = pairs.select("gene", F.col("v").alias("m"), F.col("w").alias("v3"), F.col("phase").alias("middle")).distinct()
    return front.join(short, ["gene", "m"], "left_semi").join(back, ["gene", "m", "middle"]).select("gene", "v1", F.col("m").alias("v2"), "v3", "phase").distinct()


def maximal_junctions(pairs: DataFrame) -> DataFrame:
    """Pairs (gene, phase, i1, i2, o1, o2, seq_no) not contained in another with the same intron and phase; the later of equals stays.

    i1 and i2 bound the intron, o1 and o2 the two exons' outer ends. Isolated exons, without an intron, all stay.
    """
    keys = ["gene", "phase", "i1", "i2"]
    order = Window.partitionBy(*keys).orderBy("o1", F.desc("o2"), F.desc("seq_no"))
    reach = F.max("o2").over(order.rowsBetween(Window.unboundedPreceding, -1))
    joined = pairs.where("i2 is not null").withColumn("__reach", reach)
    kept = joined.where("__reach is null or __reach < o2").drop("__reach")
    return kept.unionByName(pairs.where("i2 is null"))


def unconnected(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Vertices without an edge on either side."""
    out = vertices.join(edges.select("gene", F.col("src").alias("v")), ["gene", "v"], "left_anti")
    return out.join(edges.select("gene", F.col("dst").alias("v")), ["gene", "v"], "left_anti")


def edge_list(matrix: DataFrame) -> DataFrame:
    """Edges of adjacency rows (gene, src, row array<int>), the upper triangle."""
    return matrix.select("gene", "src", F.posexplode("row").alias("dst", "on")).where("on = 1 and dst > src").select("gene", "src", "dst")
