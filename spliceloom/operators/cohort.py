"""Cohort filters over k-mer matrices in array form: kmer, flags, and expr, a value per sample position."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spliceloom.functions.seq import isoleucine_as_leucine


def clean(expr: Column) -> Column:
    """Missing values and NaN count as no expression."""
    return F.transform(expr, lambda x: F.coalesce(F.nanvl(x.cast("double"), F.lit(0.0)), F.lit(0.0)))


def normalised(matrix: DataFrame, divisors: DataFrame) -> DataFrame:
    """Divide each sample by its divisor (pos, divisor; one row per sample), rounded to two decimals."""
    held = divisors.agg(F.array_sort(F.collect_list(F.struct("pos", "divisor"))).alias("held"))
    div = F.transform(F.col("held"), lambda d: d.divisor)
    scaled = F.zip_with("expr", div, lambda x, d: F.round(x / d, 2))
    # one row with a number per sample, whatever the number of k-mers
    return matrix.join(F.broadcast(held)).withColumn("expr", scaled).drop("held")


def support(expr: Column, threshold: float, positions: Iterable[int], without: int | None = None) -> Column:
    """How many of the samples reach threshold, or are above 0 for threshold 0; without: a position left out."""
    kept = [p for p in positions if p != without]
    values = F.transform(F.array(*[F.lit(p) for p in kept]), lambda p: F.get(expr, p))
    return F.size(F.filter(values, (lambda x: x > 0) if threshold == 0 else (lambda x: x >= threshold)))


def annotation_only(expr: Column) -> Column:
    """True where no sample expresses the k-mer."""
    return ~F.exists(expr, lambda x: x != 0)


def neo_junctions(matrix: DataFrame) -> DataFrame:
    return matrix.where(~F.col("junctionAnnotated"))


def annotated_frames(matrix: DataFrame) -> DataFrame:
    return matrix.where(F.col("readFrameAnnotated"))


def hash_slice(matrix: DataFrame, slices: int, number: int) -> DataFrame:
    """One of slices parts of the k-mers, by the first 32 bits of their MD5."""
    return matrix.where(F.conv(F.substring(F.md5(F.col("kmer").cast("binary")), 1, 8), 16, 10).cast("long") % slices == number)


def normal_background(normal: DataFrame, positions: Iterable[int], at_least: float | None, recurrence: int | None) -> DataFrame:
    """K-mers of normals: at_least in some sample, or above 0 in recurrence samples; None or 0 switches a rule off."""
    positions, rule = list(positions), F.lit(False)
    if at_least:
        rule = rule | (support(F.col("expr"), at_least, positions) >= 1)
    if recurrence:
        rule = rule | (support(F.col("expr"), 0, positions) >= recurrence)
    return normal.where(rule).select("kmer").distinct()


def sample_support(matrix: DataFrame, position: int, threshold: float) -> DataFrame:
    """Rows that the sample at position expresses: above 0 for threshold 0, else at least threshold."""
    x = F.get(F.col("expr"), F.lit(position))
    return matrix.where(x > 0 if threshold == 0 else x >= threshold)


def cohort_support(matrix: DataFrame, positions: Iterable[int], threshold: float, recurrence: int, target: int | None = None) -> DataFrame:
    """K-mers, each once, with a row that enough samples of the cohort besides target support."""
    return matrix.where(support(F.col("expr"), threshold, positions, target) >= recurrence).select("kmer").distinct()


def support_counts(matrix: DataFrame, positions: Iterable[int], threshold: float, target: int | None = None) -> DataFrame:
    """kmer and n_samples, the most samples besides target that one of its rows has at threshold: a stage to keep and reuse
    under any recurrence."""
    return matrix.groupBy("kmer").agg(F.max(support(F.col("expr"), threshold, positions, target)).alias("n_samples")).where("n_samples > 0")


def recurrent(counts: DataFrame, recurrence: int) -> DataFrame:
    """The k-mers of support_counts that recurrence samples have."""
    return counts.where(F.col("n_samples") >= recurrence).select("kmer")


def failing(result: DataFrame, matrix: DataFrame, normal: DataFrame, cancer_positions: list[int], normal_positions: list[int], target: int, sample_at_least: float, cohort_at_least: float, cohort_recurrence: int, normal_at_least: float | None, normal_recurrence: int | None) -> DataFrame:
    """k-mers of a filter's result that the raw matrices, summed anew, don't bear out, with the rule they break.

    Counts are by k-mer over all its rows, so a k-mer with several rows may pass here that no single row would. Rows of both
    matrices are added up together, a greatest value for each sample, and the result's k-mers with them: one shuffle, no join.
    """
    at = lambda x, v: x > 0 if v == 0 else x >= v
    others = [p for p in cancer_positions if p != target]
    taken = lambda held: [F.get("expr", F.lit(p)).cast("double").alias(f"{n}{p}") if n == held else F.lit(None).cast("double").alias(f"{n}{p}") for n, ps in (("c", [target, *others]), ("n", normal_positions)) for p in ps]
    wanted = lambda on: F.lit(on).alias("wanted")
    rows = matrix.select("kmer", wanted(False), *taken("c")).unionByName(normal.select("kmer", wanted(False), *taken("n"))).where("kmer is not null").unionByName(result.select("kmer", wanted(True), *taken("")))
    most = rows.groupBy("kmer").agg(*[F.max(c).alias(c) for c in rows.columns[1:]]).where("wanted")
    n_of = lambda names, test: sum((F.coalesce(test(F.col(x)), F.lit(False)).cast("int") for x in names), F.lit(0))
    normals = [f"n{p}" for p in normal_positions]
    background = F.lit(False)
    if normal_at_least:
        background = background | (n_of(normals, lambda x: x >= normal_at_least) > 0)
    if normal_recurrence:
        background = background | (n_of(normals, lambda x: x > 0) >= normal_recurrence)
    own, cohort = n_of([f"c{target}"], lambda x: at(x, sample_at_least)), n_of([f"c{p}" for p in others], lambda x: at(x, cohort_at_least))
    rule = F.when(own == 0, "sample").when(cohort < cohort_recurrence, "cohort").when(background, "normal")
    return most.select("kmer", rule.alias("rule")).where("rule is not null")


def supported(own: DataFrame, cohort: DataFrame, matrix: DataFrame, union: bool = False) -> DataFrame:
    """Rows supported by the sample and (or, for union) by the cohort; membership is by k-mer."""
    if union:
        return own.unionByName(matrix.join(cohort, "kmer", "left_semi")).distinct()
    return own.join(cohort, "kmer", "left_semi")


def prefer_junction(segment: DataFrame, junction: DataFrame) -> DataFrame:
    """All junction rows, and the segment rows of other k-mers."""
    return junction.unionByName(segment.join(junction.select("kmer"), "kmer", "left_anti"))


def combined_normals(segment: DataFrame | None, junction: DataFrame | None) -> DataFrame | None:
    """All rows of the two normal matrices, of the one that is there, or None; a k-mer of both keeps its rows."""
    if segment is None or junction is None:
        return segment if junction is None else junction
    return segment.unionByName(junction)


def differential(rows: DataFrame, background: DataFrame) -> DataFrame:
    """Rows whose k-mer the background lacks. The side is left to the optimiser, which knows the sizes."""
    return rows.join(background.select("kmer"), "kmer", "left_anti")


def without_known(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Rows whose k-mer, with I as L, is no known k-mer."""
    rows = rows.withColumn("__il", isoleucine_as_leucine(F.col("kmer")))
    known = known.select(isoleucine_as_leucine(F.col("kmer")).alias("__il")).distinct()
    return rows.join(known, "__il", "left_anti").drop("__il")


def cohort_filter(cancer: DataFrame, normal: DataFrame | None, cancer_positions: list[int], normal_positions: list[int], target: int, sample_at_least: float, cohort_at_least: float, cohort_recurrence: int, normal_at_least: float | None, normal_recurrence: int | None, external: DataFrame | None = None, known: DataFrame | None = None, union: bool = False) -> DataFrame:
    """K-mers supported in cancer samples and absent from normals; known k-mers go last.

    cancer is the matrix of junction k-mers, or that of segment k-mers with it by prefer_junction; normal the two normal ones
    by combined_normals. K-mers that the normal matrix has, but no normal sample expresses, are of the annotation and count
    as background. Only rows that support or rule out their k-mer are shuffled, as flags, and added up before that.
    """
    marks = kmer_marks(cancer, normal, cancer_positions, normal_positions, target, sample_at_least, cohort_at_least, cohort_recurrence, normal_at_least, normal_recurrence, external)
    if union:
        rows = cancer.join(marks.where("(own or cohort) and not background").select("kmer"), "kmer", "left_semi").distinct()
        held = marks.where("cohort").select("kmer", F.lit(True).alias("__cohort"))
        # of a k-mer that only its sample supports the rows that do
        x = F.get(F.col("expr"), F.lit(target))
        own = x > 0 if sample_at_least == 0 else x >= sample_at_least
        rows = rows.join(held, "kmer", "left").where(own | F.col("__cohort")).drop("__cohort")
    else:
        rows = sample_support(cancer, target, sample_at_least).join(marks.where("cohort and not background").select("kmer"), "kmer", "left_semi")
    return without_known(rows, known) if known is not None else rows


def kmer_marks(cancer: DataFrame, normal: DataFrame | None, cancer_positions: list[int], normal_positions: list[int], target: int, sample_at_least: float, cohort_at_least: float, cohort_recurrence: int, normal_at_least: float | None, normal_recurrence: int | None, external: DataFrame | None = None) -> DataFrame:
    """kmer, own, cohort and background: whether any row of it has the sample's or the cohort's support or makes it background.

    K-mers without any mark are left out; each table is read once, for its flags.
    """
    x = F.get(F.col("expr"), F.lit(target))
    flags = lambda own, cohort, background: [own.alias("own"), cohort.alias("cohort"), background.alias("background")]
    no = F.lit(False)
    enough = support(F.col("expr"), cohort_at_least, cancer_positions, target) >= cohort_recurrence
    rows = cancer.select("kmer", *flags(F.coalesce(x > 0 if sample_at_least == 0 else x >= sample_at_least, no), enough, no)).where("own or cohort")
    if normal is not None:
        rule = support(F.col("expr"), 0, normal_positions) == 0
        if normal_at_least:
            rule = rule | (support(F.col("expr"), normal_at_least, normal_positions) >= 1)
        if normal_recurrence:
            rule = rule | (support(F.col("expr"), 0, normal_positions) >= normal_recurrence)
        rows = rows.unionByName(normal.where(rule).select("kmer", *flags(no, no, F.lit(True))))
        if external is not None:
            rows = rows.unionByName(external.select("kmer", *flags(no, no, F.lit(True))))
    return rows.groupBy("kmer").agg(*[F.max(c).alias(c) for c in ("own", "cohort", "background")])


def filter_counts(cancer: DataFrame, normal: DataFrame | None, cancer_positions: list[int], normal_positions: list[int], target: int, sample_at_least: float, cohort_at_least: float, cohort_recurrence: int, normal_at_least: float | None, normal_recurrence: int | None, external: DataFrame | None = None) -> DataFrame:
    """step, name and n: how many rows of cancer there are and how many each step of `cohort_filter` leaves, in one aggregate."""
    marks = kmer_marks(cancer, normal, cancer_positions, normal_positions, target, sample_at_least, cohort_at_least, cohort_recurrence, normal_at_least, normal_recurrence, external)
    x = F.get(F.col("expr"), F.lit(target))
    rows = cancer.select("kmer", F.coalesce(x > 0 if sample_at_least == 0 else x >= sample_at_least, F.lit(False)).alias("row"))
    rows = rows.join(marks.where("cohort").select("kmer", "cohort", "background"), "kmer", "left")
    steps = {"all": F.lit(True), "sample": F.col("row"), "cohort": F.col("row") & F.coalesce("cohort", F.lit(False)), "differential": F.col("row") & F.coalesce(F.col("cohort") & ~F.col("background"), F.lit(False))}
    one = rows.agg(*[F.count_if(c).alias(n) for n, c in steps.items()])
    return one.select(F.posexplode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("n")) for n in steps])).alias("step", "x")).select("step", "x.name", "x.n")


def threshold_grid(cancer: DataFrame, normal: DataFrame, targets: list[int], positions: list[int], normal_positions: list[int], sample_levels: list[float], cohort_levels: list[float], normal_levels: list[float]) -> DataFrame:
    """How many k-mers pass for every target and setting: target, sample_at_least, cohort_at_least, recurrence, normal_at_least, n_kmers.

    A k-mer passes a setting if the target's expression reaches sample_at_least in some row of it, in some row recurrence samples of
    positions besides the target reach cohort_at_least, and no normal sample reaches normal_at_least; the normal matrix's k-mers that no
    normal sample expresses never pass. Levels rise. The matrices are read once: each k-mer is one of few kinds, by the levels
    that it reaches, and kinds are counted before settings are looked at. The rows of a k-mer meet in one task.
    """
    level = lambda x, levels: F.size(F.filter(F.array(*[F.lit(float(v)) for v in levels]), lambda v: x >= v))
    top = F.array_max(F.transform(F.array(*[F.lit(p) for p in normal_positions]), lambda p: F.get("expr", p)))
    none = F.lit(None).cast("array<double>")
    rows = cancer.select("kmer", F.col("expr").alias("row"), F.lit(None).cast("double").alias("top")).unionByName(normal.select("kmer", none.alias("row"), F.coalesce(top, F.lit(0.0)).alias("top")))
    held = rows.groupBy("kmer").agg(F.collect_list("row").alias("rows"), F.max("top").alias("top")).where("size(rows) > 0 and (top is null or top > 0)")
    at = F.explode(F.array(*[F.struct(F.lit(t).alias("target"), F.lit(float(b)).alias("cohort_at_least")) for t in targets for b in cohort_levels]))
    held = held.select("rows", level(F.coalesce("top", F.lit(float("-inf"))), normal_levels).alias("normal"), at.alias("x")).select("rows", "normal", "x.*")
    others = F.filter(F.array(*[F.lit(p) for p in positions]), lambda p: p != F.col("target"))
    most = F.array_max(F.transform("rows", lambda r: F.size(F.filter(others, lambda p: F.get(r, p) >= F.col("cohort_at_least")))))
    own = F.array_max(F.transform("rows", lambda r: F.get(r, F.col("target"))))
    kinds = held.select("target", "cohort_at_least", "normal", most.alias("most"), level(own, sample_levels).alias("own")).groupBy("target", "cohort_at_least", "normal", "most", "own").agg(F.count("*").alias("n"))
    # a kind passes every setting at or below its levels
    kinds = kinds.where("own > 0 and most > 0").select("*", F.explode(F.sequence(F.lit(1), F.col("own"))).alias("i"))
    kinds = kinds.select("*", F.explode(F.sequence(F.lit(1), F.col("most"))).alias("recurrence"))
    kinds = kinds.where(F.col("normal") < len(normal_levels)).select("*", F.explode(F.sequence(F.col("normal") + 1, F.lit(len(normal_levels)))).alias("j"))
    named = lambda k, levels: F.get(F.array(*[F.lit(float(v)) for v in levels]), F.col(k) - 1)
    rows = kinds.select("target", named("i", sample_levels).alias("sample_at_least"), "cohort_at_least", "recurrence", named("j", normal_levels).alias("normal_at_least"), "n")
    return rows.groupBy("target", "sample_at_least", "cohort_at_least", "recurrence", "normal_at_least").agg(F.sum("n").alias("n_kmers"))


def targets_filter(cancer: DataFrame, targets: list[int], positions: list[int], background: DataFrame, sample_at_least: float, cohort_at_least: float, cohort_recurrence: int) -> DataFrame:
    """The filter for many target samples in one job: a row per (target, k-mer row) that passes."""
    reach = F.transform(F.col("expr"), lambda x: x >= cohort_at_least if cohort_at_least else x > 0)
    total = F.size(F.filter(F.array(*[F.lit(p) for p in positions]), lambda p: F.get(reach, p)))
    rows = cancer.withColumns({"__all": total, "__reach": reach}).withColumn("target", F.explode(F.array(*[F.lit(t) for t in targets])))
    own = F.get(F.col("expr"), F.col("target"))
    # support of a k-mer counts over its rows: a k-mer passes where any of its rows has enough samples
    enough = (F.col("__all") - F.get(F.col("__reach"), F.col("target")).cast("int")) >= cohort_recurrence
    passing = rows.where(enough).select("target", "kmer").distinct()
    rows = rows.where(own > 0 if sample_at_least == 0 else own >= sample_at_least).drop("__all", "__reach")
    return differential(rows.join(passing, ["target", "kmer"], "left_semi"), background)


def step_counts(steps: dict[str, DataFrame]) -> DataFrame:
    """A row per step with its number of rows."""
    out = None
    for k, (name, df) in enumerate(steps.items()):
        row = df.agg(F.count("*").alias("n")).select(F.lit(k).alias("step"), F.lit(name).alias("name"), "n")
        out = row if out is None else out.unionByName(row)
    return out
