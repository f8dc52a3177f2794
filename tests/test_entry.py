"""The driver contract, with and without the optional subpackage."""

import os
import shutil
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_names_match():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and "resolve" in e.queries()


def test_imports_without_subpackage(tmp_path):
    shutil.copytree(REPO, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e, linkloom.cli; assert 'resolve' in e.queries() and not [n for n in e.queries() if n.startswith('op') or n == 'pipeline']"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", env=os.environ | {"PYTHONPATH": str(tmp_path / "r")}, check=True)


def test_matching_table_has_a_row_for_each_record(spark):
    import __spark_entry__ as e

    got = e.entry(spark)
    assert got.columns == ["source1_entity_id", "matched_entity_ids"] and got.count() == 67
