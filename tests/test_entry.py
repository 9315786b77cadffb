"""The entry module, with and without the parts that may be removed."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent


def test_flagship(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def _names(folder: Path) -> subprocess.CompletedProcess:
    return subprocess.run([sys.executable, "-B", "-c", "import __spark_entry__ as e; print(*e.queries())"], cwd=folder, capture_output=True, text=True)


@pytest.mark.parametrize("pipeline", [False, True])
def test_without_the_removable_parts(tmp_path, pipeline):
    """The operators removed, with the pipeline's file or without it."""
    if pipeline and (ROOT / "corpus_pipeline.py").exists():
        shutil.copy(ROOT / "corpus_pipeline.py", tmp_path)
    shutil.copytree(ROOT / "larkspur", tmp_path / "larkspur", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    done = _names(tmp_path)
    assert done.returncode == 0, done.stderr
    assert "q07_rules_score" in done.stdout and "op1_" not in done.stdout and "pipeline" not in done.stdout


def test_other_import_errors_are_not_hidden(tmp_path):
    shutil.copytree(ROOT / "larkspur", tmp_path / "larkspur", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    (tmp_path / "larkspur" / "llm").mkdir()
    (tmp_path / "larkspur" / "llm" / "__init__.py").write_text("")
    (tmp_path / "larkspur" / "llm" / "queries.py").write_text("import no_such_module_here\n")
    assert _names(tmp_path).returncode != 0
