"""The library without its text operators."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).resolve().parent.parent
CODE = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q), set(s) - set(q); assert 'split_counts' in q; print(*sorted(q))"


def _run(folder: Path, *args: str) -> str:
    done = subprocess.run([sys.executable, *args], cwd=folder, capture_output=True, text=True)
    assert done.returncode == 0, done.stdout + done.stderr
    return done.stdout


@pytest.mark.parametrize("pipeline_stays", [True, False])
def test_queries_without_the_text_operators(tmp_path, pipeline_stays):
    """With both folders deleted the entry points and the collection of tests work, whether the pipeline file is there or not."""
    copy = tmp_path / "repo"
    shutil.copytree(REPO, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "spark-warehouse", ".pytest_cache"))
    for folder in ("lociflow/llm", "tests/llm"):
        shutil.rmtree(copy / folder, ignore_errors=True)
    if not pipeline_stays:
        (copy / "corpus_pipeline.py").unlink(missing_ok=True)
    names = _run(copy, "-c", CODE).split()
    assert not [n for n in names if n.startswith("op") and n[2:3].isdigit()] and "pipeline" not in names
    _run(copy, "-m", "pytest", "tests", "-q", "--collect-only", "-p", "no:cacheprovider")


def test_a_missing_dependency_leaves_the_rest(tmp_path):
    """A text operator whose library is missing takes no other query with it."""
    (tmp_path / "ahocorasick.py").write_text("raise ImportError('not here')\n")
    code = f"import sys; sys.path[:0] = [{str(tmp_path)!r}, {str(REPO)!r}]; " + CODE
    assert "split_counts" in _run(tmp_path, "-c", code).split()


def test_nothing_else_imports_them():
    held = [p for p in REPO.glob("lociflow/**/*.py") if "llm" not in p.parts and "lociflow.llm" in p.read_text()]
    assert not held
