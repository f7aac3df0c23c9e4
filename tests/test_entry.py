"""The catalogue can be read without a session, and names match between queries and SQL."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_catalogue_without_session():
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q) and len(q) > 60; print('ok')"
    assert subprocess.run([sys.executable, "-B", "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120).stdout.strip() == "ok"


def test_core_does_not_import_training_data_operators():
    for path in (ROOT / "plotgraph").rglob("*.py"):
        if "llm" not in path.parts:
            assert "llm" not in path.read_text(), path
