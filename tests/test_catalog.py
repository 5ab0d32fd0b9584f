"""Every query with SQL agrees with DuckDB over the smallest tables, and holds under other partition counts."""

import os

import pytest

import __spark_entry__ as entry
from glossmill import catalog

DIR = "/root/testdata/sf0.001"
TABLES = ("documents", "labels", "conversations", "benchmark", "pages", "events")

pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="needs the test tables")


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def plain(v):
        return f"{v:.5f}" if isinstance(v, float) else str(v)

    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_oracle(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    found = con.execute(catalog.oracle_sql()[name])
    df = catalog.queries()[name](spark, DIR)
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(names, found.fetchall())


@pytest.mark.parametrize("name", ["noise_augmentation", "augmentation", "balance_sqrt", "running_normalization"])
def test_partition_counts_do_not_matter(spark, name):
    results = []
    for n in (1, 32):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        df = catalog.queries()[name](spark, DIR)
        results.append(rows_of(df.columns, df.collect()))
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert results[0] == results[1]


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "lang" in df.columns


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["comparison_report", "jsonl_round_trip", "prepared_tables"])
def test_stored_samples_take_little_room(spark, name, tmp_path, monkeypatch):
    """Samples as plain lines alone are 14 times as large as the documents' file."""
    monkeypatch.setattr(catalog, "scratch_path", lambda spark, own: str(tmp_path / own))
    assert catalog.queries()[name](spark, DIR).count() > 0
    stored = sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(tmp_path) for f in names)
    assert 0 < stored < 6 * os.path.getsize(f"{DIR}/documents.parquet")
