"""Every query with a SQL twin gives the same rows on the smallest tables."""

import duckdb
import pytest

from spliceloom import plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _text(v):
    return f"{v:.6g}" if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_same_rows_as_duckdb(spark, duck, name):
    df = plans.queries()[name](spark, SF)
    cursor = duck.execute(plans.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    expected = sorted(tuple(_text(r[columns.index(c)]) for c in sorted(columns)) for r in cursor.fetchall())
    assert sorted(tuple(_text(r[c]) for c in sorted(columns)) for r in df.collect()) == expected


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_a_missing_library_is_not_taken_for_a_missing_subpackage(monkeypatch):
    import builtins
    import importlib

    import __spark_entry__

    real = builtins.__import__

    def lost(name):
        def find(wanted, *args, **kwargs):
            if wanted == "corpus_pipeline":
                raise ModuleNotFoundError(name, name=name)
            return real(wanted, *args, **kwargs)

        return find

    monkeypatch.setattr(builtins, "__import__", lost("zstandard"))
    with pytest.raises(ModuleNotFoundError):
        importlib.reload(__spark_entry__)
    monkeypatch.setattr(builtins, "__import__", lost("corpus_pipeline"))
    assert not any(k.startswith("op") for k in importlib.reload(__spark_entry__).queries())
    monkeypatch.setattr(builtins, "__import__", real)
    importlib.reload(__spark_entry__)
