"""Batches that resume, tables that are swapped, and genomes read in pieces."""

import random

import pytest
from pyspark.sql import functions as F

from spliceloom.sources import readers as r
from spliceloom.sources import sinks
from spliceloom.staging import drop_tables, written


def _rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_batches_resume_where_a_run_broke_off(spark, tmp_path):
    genes = spark.createDataFrame([(k, f"g{k}") for k in range(10)], "gene_idx int, gene string")
    made, fail = [], {"on": True}

    def rows_of(some):
        names = sorted(x.gene for x in some.collect())
        if "g4" in names and fail["on"]:
            raise RuntimeError("lost")
        made.append(names[0])
        return some.select("gene", (F.col("gene_idx") % 2 == 0).alias("isCrossJunction"))

    folder = str(tmp_path / "matrix")
    batches = sinks.gene_batches(genes, rows_of, 4)
    assert list(batches) == ["000000", "000001", "000002"]
    with pytest.raises(RuntimeError):
        sinks.write_batches(spark, folder, batches, ["isCrossJunction"], 1)
    assert sinks.finished_batches(spark, folder) == ["000000"] and sinks.read_batches(spark, folder).count() == 4
    fail["on"] = False
    assert sinks.write_batches(spark, folder, batches, ["isCrossJunction"], 1) == ["000001", "000002"]
    assert made == ["g0", "g4", "g8"]
    out = sinks.read_batches(spark, folder)
    assert _rows(out.select("gene")) == [(f"g{k}",) for k in range(10)]
    assert len(list((tmp_path / "matrix/rows/batch=000000/isCrossJunction=true").glob("*.parquet"))) == 2  # a row a file
    assert sinks.write_batches(spark, folder, batches) == [] and sinks.gene_batches(genes.limit(0), rows_of, 4) == {}


def test_rows_of_an_unfinished_batch_do_not_count_and_are_replaced(spark, tmp_path):
    folder = str(tmp_path / "m")
    spark.createDataFrame([(1, "b")], "x int, batch string").write.partitionBy("batch").parquet(f"{folder}/rows")
    sinks.write_batches(spark, folder, {"a": lambda: spark.range(2).select(F.col("id").cast("int").alias("x"))})
    assert _rows(sinks.read_batches(spark, folder)) == [(0, "a"), (1, "a")]
    sinks.write_batches(spark, folder, {"b": lambda: spark.createDataFrame([(7,)], "x int")})
    assert _rows(sinks.read_batches(spark, folder)) == [(0, "a"), (1, "a"), (7, "b")]


def test_sizes_are_swapped_as_a_whole(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "sizes")
    table = lambda *rows: spark.createDataFrame(rows, "pos int, libsize_75percent double, libsize_total_count double")
    assert sinks.current_version(spark, folder) is None
    sinks.upsert_sizes(table((0, 1.0, 2.0), (1, 3.0, 4.0)), folder)
    assert _rows(sinks.upsert_sizes(table((1, 5.0, 6.0), (2, 7.0, 8.0)), folder)) == [(0, 1.0, 2.0), (1, 5.0, 6.0), (2, 7.0, 8.0)]
    before = sinks.current_version(spark, folder)
    monkeypatch.setattr(sinks, "_folder", lambda *_: (_ for _ in ()).throw(RuntimeError("lost before the swap")))
    with pytest.raises(RuntimeError):
        sinks.replace_table(table((9, 9.0, 9.0)), folder)
    monkeypatch.undo()
    assert sinks.current_version(spark, folder) == before and sinks.current_table(spark, folder).count() == 3
    sinks.drop_versions(spark, folder)
    assert [x.name for x in (tmp_path / "sizes").iterdir() if x.name.startswith("v-") and x.is_dir()] == [before]
    assert sinks.current_table(spark, folder).count() == 3


def test_genomes_read_by_line_equal_whole_ones(spark, tmp_path):
    rng = random.Random(1)
    text = "ACGT\n"
    for k in range(6):
        seq = "".join(rng.choice("ACGTacgtN") for _ in range((0, 1, 59, 60, 5000, 23_457)[k]))
        text += f"> chr{k} some words\n" + "".join(seq[i : i + 60] + rng.choice(("\n", "\r\n", " \n")) for i in range(0, len(seq), 60))
    text += ">long\n" + "ACGTTGCA" * 4000
    path = tmp_path / "g.fa"
    path.write_text(text)
    whole = r.genome(spark, str(path)).where("chrom != 'ACGT'")
    expected = _rows(r.genome_chunks(whole, 1000))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        for size in ("700", "9000", "128m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "0")
            found = r.fasta_chunks(spark, str(path), 1000)
            assert _rows(found) == expected
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    genes = spark.createDataFrame([("a", "chr5", 990, 2010), ("b", "long", 31_990, 32_000)], "gene string, chrom string, start int, stop int")
    cut = {x.gene: x.dna for x in r.gene_sequences(genes, r.fasta_chunks(spark, str(path), 1000), 1000).collect()}
    seqs = {x.chrom: x.seq for x in whole.collect()}
    assert cut == {"a": seqs["chr5"][990:2010], "b": seqs["long"][31_990:32_000]}


def test_stage_tables_are_dropped_on_demand(spark):
    drop_tables(spark)
    df = written(spark.range(3), "x")
    assert df.count() == 3 and drop_tables(spark) == 1 and drop_tables(spark) == 0
