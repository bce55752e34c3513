"""The entry points, with and without the llm subpackage."""

import os
import shutil
import subprocess
import sys

import pytest

from tests.conftest import ROOT


def test_every_oracle_has_a_query():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_flagship(spark):
    import __spark_entry__ as e

    asked = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").where("vec_id % 100 = 0").count()
    assert e.entry(spark).count() == 10 * asked > 0


@pytest.mark.parametrize("pipeline", [False, True])
def test_works_without_the_subpackage(tmp_path, pipeline):
    """The llm folders are gone; the pipeline's file is gone too, or left behind."""
    shutil.copytree(ROOT / "brindle", tmp_path / "brindle", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    if pipeline:
        shutil.copy(ROOT / "corpus_pipeline.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'rerank_topk' in q and not any(n.startswith('op') for n in q) and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
