"""Native operators run no Python, and the guard around the optional folder holds."""

import os
import subprocess
import sys

import pytest

from plumbline.llm import fingerprints, mixing, privacy, quality

SF_DIR = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.mark.parametrize("make", [
    fingerprints.compared_with_next, privacy.findings, lambda d: quality.judge(quality.measured(d)),
    mixing.sizes, mixing.mix, privacy.sanitise, quality.quality_filter,
])
def test_no_python_in_native_plans(spark, make):
    documents = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    plan = make(documents)._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "ArrowEval", "CartesianProduct"))


def test_texts_are_shuffled_once_for_fingerprints(spark):
    plan = fingerprints.compared_with_next(spark.read.parquet(f"{SF_DIR}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    initial = plan.split("Initial Plan")[-1]
    assert initial.count("Exchange hashpartitioning(part") == 2  # the texts, and the first id of each range


def test_import_without_the_folder(tmp_path):
    for name in os.listdir(ROOT):
        if name not in (".git", "plumbline", "corpus_pipeline.py", "tests"):
            os.symlink(f"{ROOT}/{name}", tmp_path / name)
    os.mkdir(tmp_path / "plumbline")
    for name in os.listdir(f"{ROOT}/plumbline"):
        if name not in ("llm", "__pycache__"):
            os.symlink(f"{ROOT}/plumbline/{name}", tmp_path / "plumbline" / name)
    entry = tmp_path / "__spark_entry__.py"
    entry.unlink()
    entry.write_text(open(f"{ROOT}/__spark_entry__.py").read())
    code = "import __spark_entry__ as e; q = e.queries(); assert 'null_check' in q and not any(n.startswith('op') for n in q)"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": ""})
    assert done.returncode == 0, done.stderr
