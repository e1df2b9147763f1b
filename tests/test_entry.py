"""The entry points without the packages that only the training-data operators need."""

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent


@pytest.mark.parametrize("missing,pipeline,operators", [("zstandard", "True", "False"), ("public_tokenizers", "False", "False"),
                                                       ("disclosight.llm", "False", "False"), ("corpus_pipeline", "False", "True")])
def test_other_queries_stay(missing, pipeline, operators):
    code = (f"import sys; sys.modules[{missing!r}] = None; import __spark_entry__ as e; names = set(e.queries()); "
            "assert 'a5_cluster_aggregate' in names and set(e.oracle_sql()) <= names; print('pipeline' in names, any(n.startswith('op1') for n in names))")
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    assert done.stdout.split() == [pipeline, operators]
