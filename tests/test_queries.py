"""Every registered query of the engine against its SQL twin on the smallest driver tables."""

import os
import shutil
import subprocess
import sys

import duckdb
import pandas as pd
import pytest

from quillspark.plans import core  # noqa: F401  registers the queries
from quillspark.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def cell(v):
    if pd.isna(v):
        return "null"
    return format(float(v), ".9g") if isinstance(v, (int, float)) and not isinstance(v, bool) or getattr(getattr(v, "dtype", None), "kind", "") in "iuf" and hasattr(v, "dtype") else str(v)


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(map(cell, r)) for r in frame.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    got = registry.queries()[name](spark, SF).toPandas()
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert len(got.columns)
        return
    expected = duck.execute(sql).df()
    assert sorted(got.columns) == sorted(expected.columns)
    assert rows(got) == rows(expected)


def test_word_error_rate_of_every_item(spark):
    benchmark = pd.read_parquet(f"{SF}/benchmark.parquet")
    got = registry.queries()["wer_by_doc"](spark, SF).toPandas().set_index("item_id")["wer"]
    assert not all(map(str.isascii, benchmark.text)) and sorted(got.index) == sorted(benchmark.item_id)
    for item, text in zip(benchmark.item_id, benchmark.text, strict=True):
        wrong = text.translate(str.maketrans("ae", "eo", "T")).replace("on ", "in  ") + (" the end" if item % 3 == 0 else "")
        a, b = wrong.split(), text.split()
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            before, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
        assert abs(got[item] - row[-1] / len(b)) < 1e-6


def test_filters_reach_the_scan(spark, capsys):
    registry.queries()["date_range_narrow"](spark, SF).explain("formatted")
    plan = capsys.readouterr().out
    assert "l_extendedprice" not in plan
    assert any("PushedFilters" in line and "GreaterThanOrEqual(l_shipdate" in line and "LessThan(l_shipdate" in line for line in plan.splitlines()), plan


def test_entry_and_optional_parts():
    import __spark_entry__ as entry

    assert set(registry.queries()) <= set(entry.queries()) and set(registry.oracle_sql()) <= set(entry.oracle_sql())
    assert entry._optional("quillspark.no_such_part") is None


def test_entry_works_without_the_training_data_operators(tmp_path):
    """In a copy of the repository without that subpackage and its tests."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(root, tmp_path / "copy", ignore=lambda folder, names: [n for n in names if n in ("llm", ".git", "__pycache__")])
    code = """
import __spark_entry__ as entry
from pyspark.sql import SparkSession
names = set(entry.queries())
assert "date_range_narrow" in names and not any(n.startswith("op") and n[2:3].isdigit() or n == "pipeline" for n in names), names
assert set(entry.oracle_sql()) <= names
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
print("rows", entry.entry(spark).count())
"""
    environment = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "copy", env=environment, capture_output=True, text=True, timeout=300)
    assert out.returncode == 0 and "rows 100" in out.stdout, out.stderr[-2000:]


def test_numbers_do_not_depend_on_partitions(spark):
    from quillspark.operators import control

    keys = [(k * 37) % 1009 for k in range(1000)]
    frame = spark.createDataFrame([(k,) for k in keys], "k long")
    for parts in (1, 7, 64):
        got = control.numbered(frame.repartition(13), "k", parts).orderBy("number").collect()
        assert [(r.k, r.number) for r in got] == [(k, i) for i, k in enumerate(sorted(keys), 1)]
    assert control.numbered(frame.where("false"), "k").count() == 0
