"""The driver's contract, also without the optional package."""

import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

HERE = Path(entry.__file__).parent


def test_entry_has_rows(spark):
    df = entry.entry(spark)
    assert df.columns == ["tag", "state", "assets", "increase"] and df.count() > 0


def test_every_sql_form_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_works_without_the_optional_package(tmp_path):
    for name in ("__spark_entry__.py", "corpus_pipeline.py", "quillspark"):
        source = HERE / name
        if not source.exists():
            continue  # the pipeline goes with the optional package
        (shutil.copytree if source.is_dir() else shutil.copy)(source, tmp_path / name, **({"ignore": shutil.ignore_patterns("llm", "__pycache__")} if source.is_dir() else {}))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'counter_totals' in q and not any(n.startswith('op') or n == 'pipeline' for n in q), q; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin"})
