"""Row-local filters on streams of k-mer rows, against backgrounds that don't change."""

from __future__ import annotations

from pyspark.sql import DataFrame

from spliceloom.operators.cohort import differential, neo_junctions, sample_support, without_known


def stream_filter(rows: DataFrame, background: DataFrame, position: int, threshold: float, known: DataFrame | None = None) -> DataFrame:
    """A stream of matrix rows cut down to neo-junction k-mers that a sample expresses and the background lacks."""
    out = differential(sample_support(neo_junctions(rows), position, threshold), background)
    return without_known(out, known) if known is not None else out
