"""The driver's entry: names, and that SQL exists only for queries."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_names():
    import __spark_entry__ as e

    q, o = e.queries(), e.oracle_sql()
    assert set(o) <= set(q) and len(q) > 60


def test_import_without_the_text_operators(tmp_path):
    import shutil

    shutil.copytree(ROOT / "lodeweave", tmp_path / "lodeweave", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert not any(k.startswith('op') or k == 'pipeline' for k in e.queries()); assert len(e.queries()) > 60"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, check=True)
