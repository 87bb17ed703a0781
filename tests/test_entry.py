"""The driver's entry points, with and without the pipeline package."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_names_match():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) >= len(entry.oracle_sql()) > 40


def test_import_without_the_pipeline_package(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    run = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); assert len(q) > 40 and not any(n.startswith('op') or n == 'pipeline' for n in q)"], cwd=copy, env=os.environ | {"PYTHONPATH": str(copy)}, capture_output=True, text=True)
    assert run.returncode == 0, run.stderr


def test_a_broken_dependency_is_not_swallowed(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__"))
    (copy / "sparkshards" / "llm").mkdir()
    (copy / "sparkshards" / "llm" / "__init__.py").write_text("")
    (copy / "sparkshards" / "llm" / "queries.py").write_text("import no_such_dependency\n")
    run = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=copy, env=os.environ | {"PYTHONPATH": str(copy)}, capture_output=True, text=True)
    assert run.returncode != 0 and "no_such_dependency" in run.stderr
