"""The entry without the training-data folders, on a copy."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SAY = "import __spark_entry__ as e; q = e.queries(); s = e.oracle_sql(); print(len(q), any(k.startswith('op') and k[2].isdigit() for k in q), 'pipeline' in q, set(s) <= set(q), 'rank_sources' in q)"


@pytest.mark.parametrize("with_pipeline", [True, False])
def test_the_rest_loads_without_the_training_folders(tmp_path, with_pipeline):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__"))
    for folder in ("lodestone/llm", "tests/llm"):
        shutil.rmtree(copy / folder, ignore_errors=True)
    if not with_pipeline and (copy / "corpus_pipeline.py").exists():
        os.remove(copy / "corpus_pipeline.py")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", SAY], cwd=copy, env=env, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    n, *said = out.stdout.split()
    assert int(n) > 60 and said == ["False", "False", "True", "True"]
