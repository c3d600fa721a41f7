"""The entry points work, with or without the optional parts."""

import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent


def test_flagship(spark):
    rows = entry.entry(spark).collect()
    assert 0 < len(rows) <= 10 and rows == sorted(rows, key=lambda r: -r.rate_per_year)


def test_sql_names_are_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_imports_without_the_corpus_parts(tmp_path):
    (tmp_path / "__spark_entry__.py").symlink_to(ROOT / "__spark_entry__.py")
    (tmp_path / "stormgrid").mkdir()
    for part in (ROOT / "stormgrid").iterdir():
        if part.name not in ("llm", "__pycache__"):
            (tmp_path / "stormgrid" / part.name).symlink_to(part)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'a01_county_rate' in q and not any(k.startswith('op') for k in q)"
    done = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120, check=False)
    assert done.returncode == 0, done.stderr
