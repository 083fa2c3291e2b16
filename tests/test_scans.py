"""How often the source is read."""

import pytest

import scour
from scour.operators import profile


@pytest.fixture
def source(make, tmp_path):
    # Longer than what a plan shows of a folder name.
    path = str(tmp_path / ("long" * 30) / "source")
    make("a string, b string, n double", [("x", "5 kg", 1.0), ("X", "7", None)]).write.parquet(path)
    return path


def scans(df, path):
    """File scans of the source that the plan still has to make, told by the files they list."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    found = 0
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        if leaf.getClass().getSimpleName() == "LogicalRelation":
            roots = leaf.relation().location().rootPaths()
            found += any(roots.apply(j).toUri().getPath() == path for j in range(roots.size()))
    return found


def test_scans_are_seen(spark, source):
    df = spark.read.parquet(source)
    assert scans(df, source) == 1
    assert scans(df.join(df.groupBy("a").count(), "a").unionByName(df.withColumn("count", df.n)), source) == 3


@pytest.mark.parametrize("report", [scour.analyze_quality, profile.display_issues, scour.suggest])
def test_no_second_count_of_values(spark, source, report):
    """One scan for the missing cells and one for the duplicates; values were counted before."""
    assert scans(report(spark.read.parquet(source)), source) == 2


def test_variants(spark, source):
    assert scans(profile.text_variants(spark.read.parquet(source)), source) == 0
