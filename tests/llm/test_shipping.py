"""Operators leave the session alone and run where executors have no copy of the package."""

import os
import subprocess
import sys
import textwrap

import pyarrow as pa
import pytest
from brute import documents

from quoteflow.llm.common import cut, shipped

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def test_the_package_is_sent_once_and_settings_stay(spark):
    before = dict(spark.conf.getAll)
    docs = documents(spark, [(1, "a b c")])
    assert shipped(shipped(docs)) is docs
    assert dict(spark.conf.getAll) == before


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data here")
def test_in_a_process_started_elsewhere_without_the_package(tmp_path):
    job = tmp_path / "job.py"
    job.write_text(
        textwrap.dedent(
            f"""
            import sys
            sys.path.insert(0, {ROOT!r})
            from pyspark.sql import SparkSession
            spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
                     .config("spark.sql.shuffle.partitions", "2")
                     .config("spark.checkpoint.dir", {str(tmp_path / "shared")!r}).getOrCreate())
            import __spark_entry__
            queries = __spark_entry__.queries()
            before = dict(spark.conf.getAll)
            for name in sys.argv[1:]:
                print(name, queries[name](spark, {SF!r}).count())
                assert dict(spark.conf.getAll) == before, name
            """
        )
    )
    import __spark_entry__

    names = [n for n in __spark_entry__.queries() if n == "pipeline" or n.startswith("op")]
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYSPARK_PYTHON": sys.executable}
    # the vocabulary files are a package of their own, which is installed
    if path := [p for p in os.environ.get("PYTHONPATH", "").split(":") if p and not p.startswith(ROOT)]:
        env["PYTHONPATH"] = ":".join(path)
    done = subprocess.run([sys.executable, str(job), *names], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    assert done.returncode == 0, done.stderr[-3000:]
    assert [line.split()[0] for line in done.stdout.splitlines()] == names


@pytest.mark.parametrize("rows", [None, "10000", "300", "0"])
def test_a_write_puts_the_size_of_batches_back(spark, rows):
    name, before = "spark.sql.execution.arrow.maxRecordsPerBatch", dict(spark.conf.getAll)
    if rows is not None:
        spark.conf.set(name, rows)
    try:
        kept = dict(spark.conf.getAll)
        sizes = lambda batches: (b.slice(0, 1).set_column(0, "n", pa.array([b.num_rows])) for b in batches)
        found = cut(spark.range(0, 5000, 1, 1).select("id").mapInArrow(sizes, "n long"), "batches")
        assert max(r.n for r in found.collect()) == (300 if rows == "300" else 1000)
        assert dict(spark.conf.getAll) == kept
    finally:
        spark.conf.unset(name)
    assert dict(spark.conf.getAll) == before
