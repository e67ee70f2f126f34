import os
import pathlib
import shutil
import subprocess
import sys

import pytest

import __spark_entry__


def test_names_and_sql_agree():
    found = __spark_entry__.queries()
    assert "bm25_top5" in found and set(__spark_entry__.oracle_sql()) <= set(found)


@pytest.mark.parametrize("gone", [["docquarry/llm"], ["docquarry/llm", "corpus_pipeline.py"], ["corpus_pipeline.py"]])
def test_it_works_without_the_optional_parts(tmp_path, gone):
    """In a copy of the tree from which they are really deleted."""
    root = pathlib.Path(__spark_entry__.__file__).parent
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    shutil.copytree(root / "docquarry", tmp_path / "docquarry", ignore=shutil.ignore_patterns("__pycache__"))
    if (root / "corpus_pipeline.py").exists():
        shutil.copy(root / "corpus_pipeline.py", tmp_path)
    for name in gone:
        path = tmp_path / name
        shutil.rmtree(path, ignore_errors=True) if path.is_dir() else path.unlink(missing_ok=True)
    has_llm = (tmp_path / "docquarry/llm/queries.py").exists()
    code = (
        "import __spark_entry__ as e\n"
        "q = e.queries()\n"
        f"assert 'bm25_top5' in q and any(n.startswith('op1_') for n in q) is {has_llm} and 'pipeline' not in q, q\n"
        "assert set(e.oracle_sql()) <= set(q)\n"
    )
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)})
    assert done.returncode == 0, done.stderr


def test_entry(spark):
    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no driver tables")
    assert __spark_entry__.entry(spark).count() > 0
