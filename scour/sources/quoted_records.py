"""Records of CSV files whose quoted fields hold line breaks, on files that are split anywhere.

Whether a line begins a record depends on all lines before it, but little of it travels: a line maps
the state before it (outside or within quotes) to the state after it, so it is one of four maps. A
line that gives the same state either way settles what came before; others keep or flip it. So the
state before a line is the last settled one, flipped as often as lines since then flip it: running
sums within a run of lines of one split of the file. A run as a whole is such a map again; the running
sums over one row a run say in which state each run begins and how many records there are before it.
Records are then numbered, and those that span lines are put together, also across the borders of runs
and splits. Runs and records are dealt over as many tasks as the files have pieces of `PIECE` bytes, so
larger files make more tasks and not larger ones. Their rows hold a digest of 128 bits for the file's name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from scour.sources import records
from scour.sources.staging import stage

#: Characters of the longest record that is put together.
LONGEST = 1 << 24
#: Runs whose states are broadcast; more are joined.
BROADCAST = 1_000_000
#: Lines of a run are at most two to this power.
RUN_BITS = 12
#: Bytes of the files for which there is a task.
PIECE = 16 << 20
RUN = ["file", "split", "run"]


def _tasks(spark: SparkSession, path) -> int:
    """Pieces that the files have; only their sizes are read."""
    files = spark.read.format("binaryFile").load(path)
    return (files.agg(F.sum("length")).first()[0] or 0) // PIECE + 1


def _digest(name: Column) -> Column:
    """Stands for the name of a file, which is longer than most lines, in the rows that are sorted."""
    return F.struct(F.xxhash64(name), F.xxhash64(F.lit(1), name))


def _file_names(spark: SparkSession, path) -> DataFrame:
    """file (its digest) and name, one row a file; what is in them is not read."""
    name = F.col("_metadata.file_path")
    files = spark.read.format("binaryFile").load(path)
    return stage(files.select(_digest(name).alias("file"), name.alias("name")), "files")


def _with_states(rows: DataFrame, before: WindowSpec) -> DataFrame:
    """Add `flips` and `settled`: how often the rows before flip the state, and the last state that
    they settle, as it would be without flips; null if they settle none.

    `outside` and `within` are the state after a row if the state before it is 0 or 1.
    """
    outside, within = F.col("outside"), F.col("within")
    flips = F.coalesce(F.sum(outside * (1 - within)).over(before), F.lit(0))
    settled = F.last(F.when(outside == within, (outside + F.col("flips")) % 2), ignorenulls=True)
    return rows.withColumn("flips", flips).withColumn("settled", settled.over(before))


def _state(start: int) -> Column:
    return (F.coalesce("settled", F.lit(start)) + F.col("flips")) % 2


def _lines(spark: SparkSession, path, delimiter: str, tasks: int | None = None) -> DataFrame:
    """Lines with both of their possible states and numbers, for a run that begins outside quotes
    (0) and one that begins within (1). Written once: splits are not made twice alike."""
    # A quote in front of the line puts it within quotes.
    bare = "rtrim('\r', value)"
    read = (
        spark.read.option("lineSep", "\n")
        .text(path)
        .select(
            "value",
            _digest(F.col("_metadata.file_path")).alias("file"),
            F.col("_metadata.file_block_start").alias("split"),
            F.monotonically_increasing_id().alias("id"),
            F.expr(f"int({records.opens(bare, delimiter)})").alias("outside"),
            F.expr("int({})".format(records.opens(f"concat('\"', {bare})", delimiter))).alias("within"),
        )
        .withColumn("run", F.shiftright("id", RUN_BITS))
        .repartition(tasks or _tasks(spark, path), *RUN)
    )
    order = Window.partitionBy(*RUN).orderBy("id")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    known = _with_states(read, before)
    for start in (0, 1):
        known = known.withColumn(f"state{start}", _state(start))
        known = known.withColumn(f"number{start}", F.sum(1 - F.col(f"state{start}")).over(so_far))
    return stage(known.drop("flips", "settled"), "lines")


def _after(state: Column) -> Column:
    return F.when(state == 1, F.col("within")).otherwise(F.col("outside"))


def _starts(lines: DataFrame) -> DataFrame:
    """file, split, run, start (its state) and records (how many begin before it). One row a run."""
    ends = lines.groupBy(*RUN).agg(
        # Of numbers only, so that nothing is sorted: the last line's states, and how many records began.
        *[
            F.max(F.col("id") * 2 + value).alias(name)
            for name, value in (("outside", _after(F.col("state0"))), ("within", _after(F.col("state1"))))
        ],
        F.max("number0").alias("number0"),
        F.max("number1").alias("number1"),
    )
    before = (
        Window.partitionBy("file").orderBy("split", "run").rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        _with_states(
            ends.withColumn("outside", F.col("outside") % 2).withColumn("within", F.col("within") % 2),
            before,
        )
        .withColumn("start", _state(0))
        .withColumn("own", F.when(F.col("start") == 1, F.col("number1")).otherwise(F.col("number0")))
        .select(
            *RUN,
            "start",
            F.coalesce(F.sum("own").over(before), F.lit(0)).alias("records"),
        )
    )


def quoted_records(
    spark: SparkSession, path, delimiter: str = ",", longest: int = LONGEST
) -> DataFrame:
    """file, number (the first record of each file is 1), value and too_long of each record.

    Lines end at a line feed, with or without a carriage return; within quotes both are kept. A
    record of more than `longest` characters, as an unclosed quote makes, is not put together: its
    value is its first line. Files are split freely, and no task holds more than its share of runs or
    records.
    """
    tasks = _tasks(spark, path)
    lines = _lines(spark, path, delimiter, tasks)
    starts = stage(_starts(lines), "starts")
    if starts.count() <= BROADCAST:
        starts = F.broadcast(starts)
    inside = F.col("start") == 1
    state = F.when(inside, F.col("state1")).otherwise(F.col("state0"))
    number = F.when(inside, F.col("number1")).otherwise(F.col("number0"))
    placed = lines.join(starts, RUN).select(
        "file",
        (F.col("records") + number).alias("number"),
        F.struct("split", "id", "value").alias("line"),
        ((state == 0) & (_after(state) == 0)).alias("whole"),
    )
    alone = placed.where("whole").select(
        "file", "number", F.col("line.value").alias("value"), F.lit(False).alias("too_long")
    )
    keys = ["file", "number"]
    several = placed.where("NOT whole").repartition(tasks, *keys)
    sizes = several.groupBy(*keys).agg(
        F.sum(F.length("line.value") + 1).alias("size"), F.min("line").alias("line")
    )
    long = stage(sizes.where(F.col("size") > longest), "long")
    cut = long.select(*keys, F.col("line.value").alias("value"), F.lit(True).alias("too_long"))
    joined = (
        several.join(long.select(*keys), keys, "left_anti")
        .groupBy(*keys)
        .agg(F.sort_array(F.collect_list("line")).alias("lines"))
        .select(*keys, F.array_join("lines.value", "\n").alias("value"), F.lit(False).alias("too_long"))
    )
    found = (
        alone.unionByName(joined)
        .unionByName(cut)
        .join(_file_names(spark, path), "file")
        .select(F.col("name").alias("file"), "number", "value", "too_long")
    )
    # Not by a pattern, which would decode broken bytes.
    return found.withColumn(
        "value",
        F.when(F.col("value").endswith("\r"), F.expr("left(value, length(value) - 1)")).otherwise(
            F.col("value")
        ),
    )
