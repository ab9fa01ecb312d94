from __future__ import annotations

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__
from tallymark.plans import catalogue

ROOT = Path(__file__).resolve().parents[1]
SF = "/root/testdata/sf0.001"


def test_every_query_of_the_library_has_sql():
    assert set(catalogue.queries()) == set(catalogue.oracle_sql())


def test_entry_works_without_optional_parts(tmp_path):
    shutil.copytree(ROOT / "tallymark", tmp_path / "tallymark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert set(e.queries()) == set(e.oracle_sql()); assert 'decision_rows' in e.queries(); print('fine')"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert done.stdout.strip() == "fine", done.stderr


def test_library_does_not_import_the_subpackage():
    for path in (ROOT / "tallymark").rglob("*.py"):
        if "llm" not in path.parts:
            assert "tallymark.llm" not in path.read_text()


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the provided tables")
@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query_equals_its_sql(spark, name):
    import duckdb
    import pandas as pd

    db = duckdb.connect()
    for file in Path(SF).glob("*.parquet"):
        db.sql(f"create view {file.stem} as select * from '{file}'")

    def rows(frame):
        def plain(v):
            if v is None or v is pd.NA or v != v:
                return ""
            return repr(round(float(v), 6)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

        columns = sorted(frame.columns)
        return columns, sorted(tuple(plain(v) for v in row) for row in frame[columns].astype(object).itertuples(index=False))

    assert rows(__spark_entry__.queries()[name](spark, SF).toPandas()) == rows(db.sql(__spark_entry__.oracle_sql()[name]).df())
