"""What CSV sources refuse instead of losing."""

import pytest
from pyspark.sql import types as T

import scour


@pytest.fixture
def folder(tmp_path):
    def build(*contents):
        for i, content in enumerate(contents):
            data = content if isinstance(content, bytes) else content.encode()
            (tmp_path / f"{i}.csv").write_bytes(data)
        return str(tmp_path)

    return build


def schema(**kinds):
    return T.StructType([T.StructField(name, kind) for name, kind in kinds.items()])


def test_other_headers(spark, folder):
    path = folder("a,b\n1,2\n", "b,a\n3,4\n")
    with pytest.raises(ValueError, match="header"):
        scour.load_csv(spark, path)
    for multi_line in (False, True):
        assert scour.ingest_csv(spark, path, multi_line=multi_line).status == "fatal_error"


@pytest.mark.parametrize("multi_line", [False, True])
def test_broken_encoding(spark, folder, multi_line):
    result = scour.ingest_csv(spark, folder(b"a,b\n1,\xff\xfe\n"), multi_line=multi_line)
    assert result.status == "fatal_error" and result.data is None


def test_schema_is_by_name(spark, folder):
    path = folder("a,b\n1,x\n2,y\n")
    loaded = scour.load_csv(spark, path, schema=schema(b=T.StringType(), a=T.IntegerType()))
    assert sorted(map(tuple, loaded.collect())) == [("x", 1), ("y", 2)]
    for other in (
        schema(a=T.IntegerType()),
        schema(a=T.IntegerType(), b=T.StringType(), c=T.StringType()),
        schema(a=T.IntegerType(), b=T.IntegerType()),
    ):
        with pytest.raises(ValueError):
            scour.load_csv(spark, path, schema=other)


def test_schema_and_long_records(spark, folder):
    with pytest.raises(ValueError, match="more fields"):
        scour.load_csv(
            spark, folder("a,b\n1,x\n2,y,z\n"), schema=schema(a=T.IntegerType(), b=T.StringType())
        )
