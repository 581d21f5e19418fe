"""The library and the driver's entry without the training-data part."""

import pathlib
import shutil
import subprocess
import sys

ROOT = pathlib.Path(__file__).parent.parent


def names(place, code="import __spark_entry__ as e; print(*e.queries()); print(*e.oracle_sql())"):
    done = subprocess.run([sys.executable, "-B", "-c", code], cwd=place, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr[-2000:]
    return done.stdout


def test_entry_without_the_training_data_folders(tmp_path):
    for name in ("__spark_entry__.py", "strandwise"):
        (shutil.copytree if (ROOT / name).is_dir() else shutil.copy)(ROOT / name, tmp_path / name)
    shutil.rmtree(tmp_path / "strandwise" / "llm", ignore_errors=True)
    alone = names(tmp_path)
    if (ROOT / "corpus_pipeline.py").exists():
        # the pipeline's file without the operators is left out as well, not an error
        shutil.copy(ROOT / "corpus_pipeline.py", tmp_path)
        assert names(tmp_path) == alone
    assert "site_counts" in alone and "op1_" not in alone and "pipeline" not in alone.split()
