import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as contract

ROOT = Path(__file__).resolve().parents[1]


def test_entry_has_rows_and_a_stable_schema(spark):
    df = contract.entry(spark)
    assert df.count() > 0
    assert df.columns == ["query_id", "node_id", "score", "rank_position"]


def test_every_oracle_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_rest_works_without_the_optional_parts(tmp_path):
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    shutil.copytree(ROOT / "engramix", tmp_path / "engramix", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op') or k == 'pipeline' for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)
