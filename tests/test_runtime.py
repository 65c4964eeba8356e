"""Session helpers."""

from pathlib import Path

from inkstone import runtime


def test_materialize_and_purge(spark):
    df = runtime.materialize(spark.range(10).toDF("x"), "t")
    folder = Path(runtime.shared_dir(spark)) / f"inkstone-{spark.sparkContext.applicationId}"
    assert df.count() == 10 and list(folder.glob("t-*"))
    runtime.purge(spark)
    assert not folder.exists()


def test_the_package_reaches_workers(spark):
    df = runtime.table(spark, "/root/testdata/sf0.001", "region")
    assert df.count() == 5 and runtime.fit_parallelism(df, 3).rdd.getNumPartitions() == 3
    assert Path(runtime.staging()).exists()


def test_nothing_outside_imports_the_subpackage():
    root = Path(runtime.__file__).parent
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "inkstone.llm" not in p.read_text()
