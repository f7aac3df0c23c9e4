import subprocess
import sys


def test_catalogue_needs_no_session():
    """The queries and their SQL can be listed before a session is there."""
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q) and len(q) > 90"
    subprocess.run([sys.executable, "-c", code], check=True, timeout=120, cwd=__file__.rsplit("/tests/", 1)[0])
