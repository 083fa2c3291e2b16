"""Records with quoted line breaks on files that are split anywhere, against the csv module."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

import scour
from scour.sources import quoted_records as module
from scour.sources.quoted_records import quoted_records


def plain(text, delimiter=","):
    """Numbers of the records and their fields, None where the quotes are broken."""
    reader = csv.reader(io.StringIO(text, newline="\n"), delimiter=delimiter, strict=True)
    rows = []
    while True:
        try:
            rows.append(next(reader))
        except StopIteration:
            return rows
        except csv.Error:
            rows.append(None)


@pytest.fixture
def write(tmp_path):
    def build(text, name="a.csv"):
        (tmp_path / name).write_bytes(text.encode())
        return str(tmp_path)

    return build


@pytest.fixture
def small_splits(spark):
    """A split a few bytes long, so that records span several."""
    keys = {"spark.sql.files.maxPartitionBytes": "37", "spark.sql.files.openCostInBytes": "0"}
    before = {key: spark.conf.get(key) for key in keys}
    for key, value in keys.items():
        spark.conf.set(key, value)
    yield
    for key, value in before.items():
        spark.conf.set(key, value)


def invented(rng, size, broken):
    cells = ["x", "", "a b", '"x"', '"a\nb"', '"say ""hi"""', '"\n"', '"""\n"""', '"a,b"', '"\r\n\n,"', 'in"ner', '""']
    cells += ['"x"y', '"a\n"z'] if broken else []
    lines = [",".join(rng.choice(cells) for _ in range(rng.choice([2, 2, 2, 3, 1]))) for _ in range(size)]
    return "A,B\n" + "\n".join(lines) + "\n"


@pytest.mark.parametrize("broken", [False, True])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_records_are_those_of_the_csv_module(spark, write, small_splits, broken, end):
    text = invented(random.Random(len(end)), 150, broken)
    if end == "\r\n":
        text = text.replace("\r\n", "\n").replace("\n", end)
    wanted = plain(text)
    path = write(text)
    assert spark.read.text(path).rdd.getNumPartitions() > 20
    found = quoted_records(spark, path).orderBy("number").collect()
    assert [r.number for r in found] == list(range(1, len(wanted) + 1))
    for row, fields in zip(found, wanted):
        if fields is not None:
            assert plain(row.value) in ([fields], [[]] if not fields else [fields], []), row
    result = scour.ingest_csv(spark, path, multi_line=True)
    errors = {r.row_index: r for r in result.errors.collect()}
    for number, fields in enumerate(wanted[1:], 2):
        if fields is None:
            assert errors.pop(number).issue_type == "malformed_quotes"
        elif len(fields) != 2:
            error = errors.pop(number)
            assert error.issue_type == ("extra_fields" if len(fields) > 2 else "missing_fields")
            assert (error.expected_fields, error.found_fields) == (2, len(fields))
            assert error.message == f"The record has {len(fields)} fields, the header 2."
    assert not errors and result.status == "needs_clarification"


def test_values_keep_their_line_breaks(spark, write, small_splits):
    rows = [["A", "B"], ["a\nb", 'say "x",\n\n"y"'], ["", "\r\n"], ["plain", "é\n"], ["long " * 40 + "\n" * 9, "z"]] * 3
    rows = [rows[0]] + [r for r in rows if r[0] != "A"]
    text = io.StringIO(newline="\n")
    csv.writer(text, lineterminator="\n").writerows(rows)
    path = write(text.getvalue())
    result = scour.ingest_csv(spark, path, multi_line=True, infer=False)
    assert result.status == "success"
    assert sorted(map(list, result.data.collect())) == sorted(rows[1:])
    # Many files, each with records of its own.
    write(text.getvalue(), "b.csv")
    result = scour.ingest_csv(spark, path, multi_line=True, infer=False)
    assert sorted(map(list, result.data.collect())) == sorted(rows[1:] * 2)


@pytest.mark.parametrize("bound", [module.BROADCAST, 0])
def test_unclosed_quotes(spark, write, small_splits, bound, monkeypatch):
    monkeypatch.setattr(module, "BROADCAST", bound)
    path = write('A,B\n1,"x\n' + "2,y\n" * 60)
    errors = scour.ingest_csv(spark, path, multi_line=True).errors.collect()
    assert [(e.row_index, e.issue_type) for e in errors] == [(2, "malformed_quotes")]
    cut = quoted_records(spark, path, longest=50).orderBy("number").collect()
    assert [(r.value, r.too_long) for r in cut] == [("A,B", False), ('1,"x', True)]


def test_headers(spark, write):
    path = write('"A\n1",B\nx,y\n')
    data = scour.ingest_csv(spark, path, multi_line=True).data
    assert data.columns == ["A\n1", "B"] and data.count() == 1
    write('"A\n2",B\nx,y\n', "b.csv")
    assert scour.ingest_csv(spark, path, multi_line=True).status == "fatal_error"


def test_other_header_with_the_wanted_line_later(spark, write):
    write("a,b\n1,2\n", "1.csv")
    path = write("b,a\n3,4\na,b\n5,6\n", "2.csv")
    for multi_line in (False, True):
        assert scour.ingest_csv(spark, path, multi_line=multi_line).status == "fatal_error"
    with pytest.raises(ValueError, match="another header"):
        scour.load_csv(spark, path)


def test_repeated_names(spark, write):
    loaded = scour.load_csv(spark, write("a,a,a.1,b\n1,x,2,y\n"))
    assert loaded.columns == ["a", "a.2", "a.1", "b"]
    assert [tuple(r) for r in loaded.collect()] == [(1, "x", 2, "y")]


def test_no_task_reads_a_whole_file(spark, write, small_splits):
    path = write(invented(random.Random(1), 400, False))
    lines = module._lines(spark, path, ",")
    per_split = lines.groupBy("file", "split").count().agg(F.max("count"), F.count("*")).first()
    assert per_split[0] < 40 and per_split[1] > 50


def test_larger_files_make_more_tasks(spark, write, monkeypatch):
    """Runs end within a split, and each task gets its share of them."""
    monkeypatch.setattr(module, "RUN_BITS", 3)
    monkeypatch.setattr(module, "PIECE", 500)
    text = invented(random.Random(5), 400, False)
    path = write(text)
    lines = module._lines(spark, path, ",")
    assert len(lines.inputFiles()) > 3
    assert lines.groupBy("file", "split", "run").count().agg(F.max("count")).first()[0] == 8
    found = quoted_records(spark, path).orderBy("number").collect()
    assert [r.number for r in found] == list(range(1, len(plain(text)) + 1))
    assert [next(csv.reader(io.StringIO(r.value, newline="\n"))) for r in found if r.value] == [
        fields for fields in plain(text) if fields
    ]


def test_errors_keep_their_numbers_in_small_runs(spark, write, monkeypatch):
    """Numbers run through all runs and tasks, whose borders cut records."""
    monkeypatch.setattr(module, "RUN_BITS", 2)
    monkeypatch.setattr(module, "PIECE", 500)
    text = invented(random.Random(6), 200, True)
    errors = scour.ingest_csv(spark, write(text), multi_line=True).errors.collect()
    wanted = [i for i, fields in enumerate(plain(text), 1) if fields is not None and len(fields) != 2]
    found = sorted(e.row_index for e in errors if e.issue_type != "malformed_quotes")
    assert len(wanted) > 20 and set(found) <= set(wanted)
    quotes = {e.row_index for e in errors if e.issue_type == "malformed_quotes"}
    assert set(wanted) <= set(found) | quotes
    assert {i for i, fields in enumerate(plain(text), 1) if fields is None} <= quotes


def test_rows_do_not_hold_the_name_of_their_file(spark, write):
    """It is longer than most lines, and each task sorts the rows of millions."""
    text = "a,b\n1,x\n2,\"y\nz\"\n"
    path = write(text)
    kinds = dict(module._lines(spark, path, ",").dtypes)
    assert [name for name, kind in kinds.items() if kind == "string"] == ["value"]
    found = quoted_records(spark, path)
    names = spark.read.text(path).select("_metadata.file_path").distinct().collect()
    assert {r.file for r in found.collect()} == {r.file_path for r in names}
    assert found.count() == 3
