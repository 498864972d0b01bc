"""The entry point without the optional training-data operators."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
ASK = "import __spark_entry__ as e; q = e.queries(); print(len(q), any(k[:2] == 'op' and k[2].isdigit() for k in q), 'pipeline' in q, set(e.oracle_sql()) <= set(q))"


def _asked(folder) -> list[str]:
    return subprocess.run([sys.executable, "-c", ASK], cwd=folder, capture_output=True, text=True, check=True).stdout.split()


@pytest.mark.parametrize("pipeline", [True, False])
def test_queries_without_the_operators(tmp_path, pipeline):
    for name in ("agorascope", "__spark_entry__.py", "corpus_pipeline.py"):
        source = os.path.join(ROOT, name)
        if not os.path.exists(source) or name == "corpus_pipeline.py" and not pipeline:
            continue
        if os.path.isdir(source):
            shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        else:
            shutil.copy(source, tmp_path / name)
    n, operators, whole, subset = _asked(tmp_path)
    assert int(n) >= 176 and (operators, whole, subset) == ("False", "False", "True")
