"""The entry module works whether or not the training-data subpackage is there."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).resolve().parent.parent
SHOWN = "import __spark_entry__ as e; print(len(e.queries()), len([q for q in e.queries() if q.startswith('op') or q == 'pipeline']), set(e.oracle_sql()) <= set(e.queries()))"


@pytest.mark.parametrize("pipeline_stays", [True, False])
def test_import_without_the_subpackage(tmp_path, pipeline_stays):
    without = shutil.ignore_patterns("llm", "__pycache__", ".git", *([] if pipeline_stays else ["corpus_pipeline.py"]))
    shutil.copytree(REPO, tmp_path / "copy", ignore=without)
    found = subprocess.run([sys.executable, "-c", SHOWN], cwd=tmp_path / "copy", capture_output=True, text=True, timeout=120)
    assert found.returncode == 0, found.stderr
    total, of_llm, known = found.stdout.split()
    assert int(total) > 70 and of_llm == "0" and known == "True"
