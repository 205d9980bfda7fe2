"""Every SQL has a query, names and columns fit, and the core stands without the llm subpackage."""

import subprocess
import sys
from pathlib import Path

REPO = str(Path(__file__).resolve().parents[1])


def test_sql_belongs_to_queries():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert {"p2_found", "p3_found", "p4_found"} <= set(e.queries())


def test_core_stands_alone():
    code = "import sys; sys.modules['ctmcflow.llm'] = None; import __spark_entry__ as e; assert 'p2_found' in e.queries() and 'p5_found' not in e.queries()"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=REPO)
