import datetime as dt

import pytest
from conftest import column, rows

import scour
from checks import cases
from scour.sources import csv_files
from scour.sources.staging import stage


@pytest.fixture
def write(tmp_path):
    def build(content, name="t.csv"):
        path = tmp_path / name
        path.write_bytes(content if isinstance(content, bytes) else content.encode())
        return str(path)

    return build


def errors(result):
    return [
        (r.row_index, r.expected_fields, r.found_fields, r.issue_type)
        for r in result.errors.orderBy("row_index").collect()
    ]


def test_valid_file(spark, write):
    result = scour.ingest_csv(spark, write("A,B,C\n1,2,3\n4,5,6"))
    assert result.status == "success" and errors(result) == []
    assert rows(result.data) == [(1, 2, 3), (4, 5, 6)]


@pytest.mark.parametrize(
    "content, expected",
    [
        ("A,B,C\n1,2\n4,5,6", [(2, 3, 2, "missing_fields")]),
        ("A,B\n1,2,3\n4,5", [(2, 2, 3, "extra_fields")]),
        ('A,B\n1,"2\n', [(2, None, None, "malformed_quotes")]),
        ('A,B\n1,"x"y\n2,3\n', [(2, None, None, "malformed_quotes")]),
        ("A,B\n1,2\n\n3,4\n", [(3, 2, 0, "missing_fields")]),
        ("A,B\n1,2\n3\n4,5\n6,7,8\n", [(3, 2, 1, "missing_fields"), (5, 2, 3, "extra_fields")]),
    ],
)
def test_structural_errors(spark, write, content, expected):
    result = scour.ingest_csv(spark, write(content))
    assert result.status == "needs_clarification" and result.data is None
    assert errors(result) == expected


@pytest.mark.parametrize(
    "content, issue",
    [
        (b"A,B\n\xff\xfe,2", "encoding_error"),
        (b"\xff\xfe,B\n1,2", "encoding_error"),
        (b"", "empty_file"),
        (b" \n  \n", "empty_file"),
        (b'"A,B\n1,2', "malformed_quotes"),
    ],
)
def test_fatal_errors(spark, write, content, issue):
    result = scour.ingest_csv(spark, write(content))
    assert result.status == "fatal_error" and result.data is None
    assert [e[3] for e in errors(result)] == [issue]


def test_quoting(spark, write):
    content = 'A,B,C\n1,"2,3",x\n4,"say ""hi""",y\n5,ab"c,\n"","",z\n'
    result = scour.ingest_csv(spark, write(content))
    assert result.status == "success"
    assert column(result.data, "B", "C") == ['ab"c', "2,3", 'say "hi"', ""]
    assert column(result.data, "C", "C") == ["", "x", "y", "z"]


def test_other_delimiter_and_many_quotes(spark, write):
    long = '"' + '""' * 20000 + '"'
    result = scour.ingest_csv(spark, write(f"A;B\n1,5;{long}\n2;x\n"), delimiter=";")
    assert result.status == "success"
    assert max(len(v) for v in column(result.data, "B", "A")) == 20000


def test_header_only_and_repeated_header_line(spark, write):
    assert scour.ingest_csv(spark, write("A,B\n")).data.count() == 0
    result = scour.ingest_csv(spark, write("A,B\nA,B\n1,2\n", "again.csv"))
    assert result.data.count() == 2
    assert scour.ingest_csv(spark, write("A,A\n1,2\n", "twice.csv")).status == "fatal_error"


def test_folder_of_files(spark, write, tmp_path):
    write("A,B\n1,2\n", "one.csv")
    write("A,B\n3,4\nA,B\n", "two.csv")
    result = scour.ingest_csv(spark, str(tmp_path))
    assert result.status == "success" and result.data.count() == 3
    write("B,A\n5,6\n", "three.csv")
    assert scour.ingest_csv(spark, str(tmp_path)).status == "fatal_error"


def test_quoted_line_breaks_need_multi_line(spark, write):
    path = write('A,B\n1,"x\ny"\n2,z\n')
    assert scour.ingest_csv(spark, path).status == "needs_clarification"
    result = scour.ingest_csv(spark, path, multi_line=True)
    assert result.status == "success" and column(result.data, "B", "A") == ["x\ny", "z"]
    short = scour.ingest_csv(spark, write('A,B\n1,"x\ny"\n2\n', "short.csv"), multi_line=True)
    assert short.status == "needs_clarification"
    assert [(e[2], e[3]) for e in errors(short)] == [(1, "missing_fields")]


def test_record_numbers_across_splits(spark, write):
    """Small splits: the numbers still count from the top of the file."""
    lines = ["A,B"] + [f"{i},{'x' * (i % 50)}" if i % 97 else str(i) for i in range(2, 5001)]
    path = write("\n".join(lines))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        result = scour.ingest_csv(spark, path)
        assert csv_files._lines(spark, path).rdd.getNumPartitions() > 8
        assert [e[0] for e in errors(result)] == [i for i in range(2, 5001) if i % 97 == 0]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_safe_type_inference(spark, write):
    content = (
        "Age,Revenue,ID,Mixed,Date,Gap,Blank,HoledDate\n"
        "25,1000.5,00123,100,2023-01-01,1,,2023-01-01\n"
        "17,500,00124,unknown,2023-01-02,,,\n"
    )
    data = scour.ingest_csv(spark, write(content)).data
    assert dict(data.dtypes) == {
        "Age": "bigint", "Revenue": "double", "ID": "string", "Mixed": "string",
        "Date": "timestamp_ntz", "Gap": "double", "Blank": "double", "HoledDate": "string",
    }
    assert column(data, "Date", "Date")[0] == dt.datetime(2023, 1, 1)
    assert sorted(column(data, "HoledDate", "Age")) == ["", "2023-01-01"]
    assert column(data, "Gap", "Age") == [None, 1.0]


def test_tokens_stay_text_in_text_columns(spark, write):
    data = scour.ingest_csv(spark, write("N,T\n1,nan\nnull,None\nnan,x\n")).data
    assert sorted(column(data, "N", "T"), key=str) == [1.0, None, None]
    assert column(data, "T", "T") == ["None", "nan", "x"]


def test_lenient_scan(spark, write):
    content = "id,age,ok,name,gone\n1,48 years,True,NA,\n2,,False, x ,null\n3,5,True,None,\n"
    df = scour.load_csv(spark, write(content))
    assert dict(df.dtypes) == {
        "id": "bigint", "age": "string", "ok": "boolean", "name": "string", "gone": "double",
    }
    assert column(df, "name", "id") == [None, " x ", None]
    assert column(df, "age", "id") == ["48 years", None, "5"]
    short = scour.load_csv(spark, write("a,b\n1\n2,3\n", "short.csv"))
    assert column(short, "b", "a") == [None, 3.0]
    for bad in (write("", "empty.csv"), write("a,b\n1,2,3\n", "long.csv")):
        with pytest.raises(ValueError):
            scour.load_csv(spark, bad)
    with pytest.raises(FileNotFoundError):
        scour.load_csv(spark, "/no/such/file.csv")


def test_save(spark, make, tmp_path):
    df = make("s string, x double", [(' say "hi", ', 1.5), (None, None), ("plain", 2.0)])
    target = str(tmp_path / "out")
    scour.save_table(df, target)
    back = scour.load_csv(spark, target)
    assert column(back, "s") == [' say "hi", ', None, "plain"]
    assert column(back, "x") == [1.5, None, 2.0]
    with pytest.raises(Exception, match="already exists"):
        scour.save_table(df, target)
    with pytest.raises(Exception, match="already exists"):
        scour.save_table(back, target)
    with pytest.raises(ValueError):
        scour.save_table(df, target, inputs=[target])
    with pytest.raises(ValueError):
        scour.save_table(df, str(tmp_path / "no" / "such" / "out"))
    scour.save_table(df, str(tmp_path / "p"), format="parquet")
    assert rows(spark.read.parquet(str(tmp_path / "p"))) == rows(df)


def test_row_ids_are_unique_and_follow_the_scan(spark, make):
    df = scour.with_row_id(make("a bigint", range(100)).drop("row_id"), "n")
    got = df.orderBy("n").collect()
    assert [r.a for r in got] == list(range(100)) and len({r.n for r in got}) == 100
    with pytest.raises(ValueError):
        scour.with_row_id(df, "n")


def test_one_file_is_sorted_in_ranges(spark, monkeypatch):
    """The file that the ingest queries read: no task sorts all of its lines."""
    staged = []

    def kept(df, label):
        staged.append(stage(df, label))
        return staged[-1]

    monkeypatch.setattr(cases, "SORTED_AT_ONCE", 10, raising=False)
    monkeypatch.setattr(cases, "stage", kept, raising=False)
    lines = spark.range(100).selectExpr("id * 37 % 100 AS key", "'line ' || id * 37 % 100 AS line")
    path = cases._write_one_file(lines.repartition(4), "header", "one")
    assert len(spark.read.text(path).inputFiles()) == 1
    found = [row.value for row in spark.read.text(path).collect()]
    assert found == ["header", *[f"line {i}" for i in range(100)]]
    assert staged and len(staged[0].inputFiles()) > 5
