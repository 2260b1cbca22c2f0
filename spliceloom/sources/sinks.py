"""Writing results."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from spliceloom.operators.expression import updated_sizes


def write_table(df: DataFrame, path: str, kind: str = "tsv", partitions: int | None = None) -> None:
    """Overwrite path with df as gzipped tsv with a header, or as parquet; partitions: number of files."""
    if partitions:
        df = df.repartition(partitions)
    out = df.write.mode("overwrite")
    if kind == "parquet":
        out.parquet(path)
    else:
        out.option("sep", "\t").option("header", True).option("compression", "gzip").csv(path)


def wide(matrix: DataFrame, samples: list[str]) -> DataFrame:
    """expr as a column per sample; the other columns stay."""
    return matrix.select(*[c for c in matrix.columns if c != "expr"], *[F.get("expr", F.lit(k)).alias(n) for k, n in enumerate(samples)])


def fasta_lines(df: DataFrame, name: str, sequence: str, keep: list[str] | None = None) -> DataFrame:
    """A column fasta of two-line entries."""
    return df.select(*(keep or []), F.concat(F.lit(">"), F.col(name).cast("string"), F.lit("\n"), F.col(sequence)).alias("fasta"))


def write_fasta(df: DataFrame, name: str, sequence: str, path: str) -> None:
    fasta_lines(df, name, sequence).write.mode("overwrite").option("compression", "gzip").text(path)


def list_text(df: DataFrame) -> DataFrame:
    """Array columns as texts joined by semicolons, without their nulls."""
    kinds = dict(df.dtypes)
    return df.select(*[F.concat_ws(";", F.col(c).cast("array<string>")).alias(c) if kinds[c].startswith("array") else c for c in df.columns])


def expression_table(long: DataFrame, samples: list[str]) -> DataFrame:
    """gene and a column per sample from gene expression (gene, pos, expr); a missing value is 0."""
    rows = long.groupBy("gene").agg(F.map_from_entries(F.collect_list(F.struct("pos", "expr"))).alias("held"))
    return rows.select("gene", *[F.coalesce(F.col("held")[k], F.lit(0.0)).alias(n) for k, n in enumerate(samples)])


def parameter_name(name: str, **parameters) -> str:
    """name with its parameters in order of their names, as a file name: two runs share it only if all are equal."""
    shown = [f"{k}-{'none' if v is None else v}" for k, v in sorted(parameters.items())]
    return re.sub(r"[^A-Za-z0-9._=-]+", "-", "_".join([name, *shown]))


def output_path(folder: str, name: str, kind: str = "tsv.gz", **parameters) -> str:
    """The path of a result in a folder, named after what it was made with."""
    return f"{folder.rstrip('/')}/{parameter_name(name, **parameters)}.{kind}"


def append_counts(counts: DataFrame, path: str, **parameters) -> None:
    """Append a report of steps (step, name, n) as one row: a column per parameter, then one per step in order."""
    row = counts.groupBy().agg(F.array_sort(F.collect_list(F.struct("step", "name", "n"))).alias("x"))
    fixed = [F.lit(None if v is None else str(v)).cast("string").alias(k) for k, v in sorted(parameters.items())]
    row.select(*fixed, F.transform("x", lambda s: F.struct(s["name"].alias("name"), s["n"].alias("n"))).alias("steps")).write.mode("append").parquet(path)


def counts_report(spark, path: str) -> DataFrame:
    """All rows of a report of steps, a column for each step's count."""
    df = spark.read.parquet(path)
    names = [r.name for r in df.select(F.posexplode(F.transform("steps", lambda s: s["name"])).alias("k", "name")).groupBy("name").agg(F.min("k").alias("k")).orderBy("k", "name").collect()]
    held = F.map_from_entries(F.transform("steps", lambda s: F.struct(s["name"], s["n"])))
    return df.select(*[c for c in df.columns if c != "steps"], *[held[n].alias(n) for n in names])


def stage_table(df_of, folder: str, spark, name: str = "stage", **parameters) -> DataFrame:
    """The table of a stage with these parameters in folder, made by df_of() first where it isn't complete."""
    path = output_path(folder, name, "parquet", **parameters)
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        df_of().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def _folder(spark, path: str):
    """The file system of a path, and the path there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def finished_batches(spark, folder: str) -> list[str]:
    """Names of the batches of `write_batches` that are complete."""
    fs, at = _folder(spark, f"{folder}/finished")
    return sorted(r.batch for r in spark.read.schema("batch string").parquet(f"{folder}/finished").collect()) if fs.exists(at) else []


def write_batches(spark, folder: str, batches: dict[str, Callable[[], DataFrame]], by: list[str] | None = None, rows_per_file: int = 5_000_000) -> list[str]:
    """Write tables, one per batch, under folder/rows as parquet partitioned by batch and by, and tell which were written.

    A batch is a function, so that those that are complete already are not made again: after a failure a second run makes and writes only
    the rest. A batch's rows take the place of those that an unfinished run left, and of no other batch's. No file has more than rows_per_file rows.
    """
    done, made = set(finished_batches(spark, folder)), []
    for name, make in batches.items():
        if name in done:
            continue
        rows = make().withColumn("batch", F.lit(name))
        out = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", rows_per_file)
        out.partitionBy("batch", *(by or [])).parquet(f"{folder}/rows")
        spark.createDataFrame([(name, rows.schema.json())], "batch string, schema string").coalesce(1).write.mode("append").parquet(f"{folder}/finished")
        made.append(name)
    return made


def read_batches(spark, folder: str) -> DataFrame:
    """The rows of all complete batches, with the columns of the first."""
    kind = spark.read.schema("batch string, schema string").parquet(f"{folder}/finished").agg(F.min_by("schema", "batch")).first()[0]
    rows = spark.read.schema(StructType.fromJson(json.loads(kind))).parquet(f"{folder}/rows")
    return rows.where(F.col("batch").isin(finished_batches(spark, folder)))


def gene_batches(genes: DataFrame, rows_of: Callable[[DataFrame], DataFrame], size: int) -> dict[str, Callable[[], DataFrame]]:
    """Batches for `write_batches` of size genes each, by running number: rows_of makes a batch's rows from its genes (gene_idx, ...)."""
    last = genes.agg(F.max("gene_idx")).first()[0]
    if last is None:
        return {}
    return {f"{k:06d}": lambda k=k: rows_of(genes.where(F.col("gene_idx").between(k * size, (k + 1) * size - 1))) for k in range(last // size + 1)}


def replace_table(df: DataFrame, folder: str) -> str:
    """Write df as a new version under folder and let the folder's pointer name it: readers see the old table or the new one.

    The pointer is a small file that is replaced by rename, so that a failure at any time leaves the old table; df may be made from
    it. Old versions stay until `drop_versions`.
    """
    spark = df.sparkSession
    version = f"v-{uuid.uuid4().hex}"
    df.write.parquet(f"{folder}/{version}")
    fs, fresh = _folder(spark, f"{folder}/{version}.pointer")
    out = fs.create(fresh, True)
    out.writeBytes(version)
    out.close()
    hadoop = spark._jvm.org.apache.hadoop.fs
    how = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
    how[0] = hadoop.Options.Rename.OVERWRITE
    files = hadoop.FileContext.getFileContext(fresh.toUri(), spark._jsc.hadoopConfiguration())
    files.rename(fs.makeQualified(fresh), fs.makeQualified(hadoop.Path(f"{folder}/current")), how)
    return version


def current_version(spark, folder: str) -> str | None:
    """The version that the folder's pointer names, None before the first."""
    fs, at = _folder(spark, f"{folder}/current")
    if not fs.exists(at):
        return None
    return spark.read.text(f"{folder}/current").first().value


def current_table(spark, folder: str) -> DataFrame:
    """The table that the folder's pointer names."""
    return spark.read.parquet(f"{folder}/{current_version(spark, folder)}")


def drop_versions(spark, folder: str) -> None:
    """Delete all versions of a table but the current one, when nobody reads them any more."""
    fs, at = _folder(spark, folder)
    kept = current_version(spark, folder)
    for found in fs.listStatus(at):
        name = found.getPath().getName()
        if name.startswith("v-") and name != kept:
            fs.delete(found.getPath(), True)


def upsert_sizes(new: DataFrame, folder: str) -> DataFrame:
    """Library sizes under folder with those of new samples (pos, ...) added, or in place of their old ones."""
    spark = new.sparkSession
    rows = new if current_version(spark, folder) is None else updated_sizes(current_table(spark, folder), new)
    replace_table(rows, folder)
    return current_table(spark, folder)
