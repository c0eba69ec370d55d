"""CSV with quoted line ends, read by many tasks a file.

Spark's ``multiLine`` reads a CSV file in one task, because a line end may lie within quotes, which is only known from
the file's start. Here a file is read in Spark's own blocks of lines:

1. every block tells, for both states in which its first line may begin (outside or inside a quoted field), the state after
   its last line;
2. these two-way maps are composed along each file (one row a block), which gives the state at each block's start;
3. every block is cut into records from there. A record that crosses blocks is in pieces, which are joined by the block that it begins
   in.

Quotes follow RFC 4180: a field that begins with a quote ends at the next single one, a doubled quote is a quote; a quote
within an unquoted field is a character like any other. Lines end at U+000A, a U+000D before it belongs to the line end.

Records of another number of fields than the header are rejects ("fields"), and so is a record whose quotes are still open at
the file's end ("quote"). Blank lines are left out. Every file has a header, its columns are found by name.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_table

#: Most bytes of the blocks' states that are broadcast.
BROADCAST_BYTES = 64 << 20


def after_line(line: str, quoted: bool) -> bool:
    """Whether the next line begins inside a quoted field, if ``line`` does (``quoted``) or begins a record."""
    if '"' not in line:
        return quoted
    at, n = 0, len(line)
    while True:
        if quoted:
            at = line.find('"', at)
            if at < 0:
                return True
            at += 1
            if line[at:at + 1] == '"':
                at += 1
                continue
            quoted = False
        elif line[at:at + 1] == '"':
            at, quoted = at + 1, True
            continue
        at = line.find(",", at) + 1
        if not at or at > n:
            return False


def fields_of(record: str) -> list[str] | None:
    """The fields of a whole record, None if its quotes don't close. Empty unquoted fields are empty texts."""
    out, at, n = [], 0, len(record)
    while True:
        if record[at:at + 1] == '"':
            value, at = [], at + 1
            while True:
                end = record.find('"', at)
                if end < 0:
                    return None
                value.append(record[at:end])
                at = end + 1
                if record[at:at + 1] != '"':
                    break
                value.append('"')
                at += 1
            end = record.find(",", at)
            value.append(record[at:] if end < 0 else record[at:end])  # what stands between the quote and the comma
            out.append("".join(value))
        else:
            end = record.find(",", at)
            out.append(record[at:] if end < 0 else record[at:end])
        if end < 0:
            return out
        at = end + 1
        if at == n:
            return [*out, ""]


def _blocks(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[tuple[tuple, list[str]]]:
    """(values of ``keys``, lines) of runs of lines of one block, in order."""
    for batch in batches:
        c = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
        values = list(zip(*(c[k].to_pylist() for k in keys)))
        lines = c["line"].to_pylist()
        at = 0
        for i in range(1, len(lines) + 1):
            if i == len(lines) or values[i] != values[at]:
                yield values[at], lines[at:i]
                at = i


def _end_states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, block, after): two bits, the state after the block if it begins outside (1) and inside (2) quotes."""
    now, states = None, [False, True]
    for key, lines in _blocks(batches, "file", "block"):
        if key != now:
            if now is not None:
                yield _row(now, states)
            now, states = key, [False, True]
        for line in lines:
            if '"' in line:
                states = [after_line(line, s) for s in states]
    if now is not None:
        yield _row(now, states)


def _row(key: tuple, states: list[bool]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.string()), pa.array([key[1]], pa.int64()), pa.array([states[0] + 2 * states[1]], pa.int32())],
                                      names=["file", "block", "after"])


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    no = 0
    for batch in batches:
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(range(no, no + batch.num_rows), pa.int64())], names=["file", "block", "line", "no"])
        no += batch.num_rows


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, block, begins, place, text, open): records that lie in one block, and the pieces of others.

    begins: the block, or -1 for the rest of a record that is open at the block's start; open: whether this piece doesn't end the record.
    """
    now, quoted, held, owner, place = None, False, [], None, 0
    out: list[list] = [[], [], [], [], [], []]

    def emit(ends: bool) -> None:
        nonlocal held, owner, place
        for col, v in zip(out, (now[0], now[1], owner, place, "\n".join(held), not ends)):
            col.append(v)
        held, owner, place = [], now[1], place + 1

    def batch() -> pa.RecordBatch:
        nonlocal out
        cols, out = out, [[], [], [], [], [], []]
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_())
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(cols, kinds)], names=["file", "block", "begins", "place", "text", "open"])

    for (file, block, inside), lines in _blocks(batches, "file", "block", "inside"):
        if now != (file, block):
            if held:
                emit(False)
            now, quoted, held, place = (file, block), inside, [], 0
            owner = -1 if inside else block
        for line in lines:
            held.append(line)
            quoted = after_line(line, quoted)
            if not quoted:
                emit(True)
        if len(out[0]) > 5000:
            yield batch()
    if held:
        emit(False)
    if out[0]:
        yield batch()


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """``file, begins, place, text, fields ARRAY<STRING>, reason``: every record of the CSV files of ``path`` with its place.

    ``(file, begins, place)`` orders the records of a file. fields is NULL and reason "quote" where quotes don't close.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("line"))
    # a block is read by one task, so it is one row, whatever the number of its Arrow batches
    ends = scratch_table(spark, lines.mapInArrow(_end_states, "file string, block long, after int"), "csv-blocks")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # a map is the identity (2), a swap (1), or constant (0: outside, 3: inside): the state is that of the last constant block,
    # turned by the swaps since
    turn = ends.withColumn("swaps", F.coalesce(F.sum((F.col("after") == 1).cast("int")).over(before), F.lit(0)))
    turn = turn.withColumn("own", F.when(F.col("after").isin(0, 3), F.struct((F.col("after") == 3).cast("int").alias("state"), "swaps")))
    last = turn.withColumn("last", F.last("own", True).over(before))
    inside = (F.coalesce("last.state", F.lit(0)) + F.col("swaps") - F.coalesce("last.swaps", F.lit(0))) % 2 == 1
    states = scratch_table(spark, last.select("file", "block", inside.alias("inside")), "csv-states")
    size = states.agg(F.coalesce(F.sum(F.length("file") + 16), F.lit(0)).alias("n")).first().n
    if size <= BROADCAST_BYTES:
        placed = lines.join(F.broadcast(states), ["file", "block"])
    else:  # lines are numbered, so that their order outlives the shuffle
        numbered = lines.mapInArrow(_numbered, "file string, block long, line string, no long")
        placed = numbered.join(states, ["file", "block"]).repartition("file", "block").sortWithinPartitions("file", "block", "no")
    pieces = placed.select("file", "block", "inside", "line").mapInArrow(
        _cut, "file string, block long, begins long, place long, text string, open boolean")
    pieces = scratch_table(spark, pieces, "csv-pieces")
    whole = pieces.where("NOT open AND begins >= 0").select("file", F.col("block").alias("begins"), "place", "text", F.lit(False).alias("open"))
    # a piece that begins a record is the last of its block; those that go on are the first: two a block at most
    parts = pieces.where("open OR begins < 0")
    starts = F.last(F.when(F.col("begins") >= 0, F.struct("block", "place")), True).over(
        Window.partitionBy("file").orderBy("block", "place").rowsBetween(Window.unboundedPreceding, 0))
    keyed = parts.withColumn("own", starts)
    crossing = keyed.groupBy("file", F.col("own.block").alias("begins"), F.col("own.place").alias("place")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "text"))), lambda p: p["text"]), "\n").alias("text"),
        F.min("open").alias("open"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t[:-1] if t.endswith("\r") else t for t in batch.column(3).to_pylist()]
            found = [None if o else fields_of(t) for t, o in zip(texts, batch.column(4).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(texts, pa.string()), pa.array(found, pa.list_(pa.string()))],
                                             names=["file", "begins", "place", "text", "fields"])

    both = whole.unionByName(crossing.select("file", "begins", "place", "text", "open"))
    out = both.select("file", "begins", "place", "text", "open").mapInArrow(split, "file string, begins long, place long, text string, fields array<string>")
    return out.where("text <> ''").withColumn("reason", F.when(F.col("fields").isNull(), F.lit("quote")))


def read_csv(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of CSV files with a header each: all columns that any file names, as strings (empty fields are NULL), and
    ``_file, _begins, _place``; rejects are ``_file, text, reason``."""
    records = scratch_table(spark, csv_records(spark, path), "csv-records")
    # the header is the first record of a file
    heads = records.groupBy("file").agg(F.min_by("fields", F.struct("begins", "place")).alias("head"), F.min(F.struct("begins", "place")).alias("at"))
    heads = heads.where("head IS NOT NULL").withColumn("head", F.transform("head", lambda x: F.ltrim(x, F.lit("\ufeff"))))
    heads = scratch_table(spark, heads, "csv-heads")
    names = [r.name for r in heads.select(F.explode("head").alias("name")).distinct().orderBy("name").collect()]  # column names
    names = [n for n in names if n]
    body = records.join(heads, "file").where(F.struct("begins", "place") > F.col("at"))
    reason = F.coalesce("reason", F.when(F.size("fields") != F.size("head"), F.lit("fields")))
    body = body.withColumn("reason", reason)
    good = body.where("reason IS NULL")

    def named(name: str):
        at = F.array_position("head", F.lit(name)).cast("int")
        value = F.when(at > 0, F.element_at("fields", F.greatest(at, F.lit(1))))
        return F.when(value != "", value).alias(name)

    rows = good.select(*[named(n) for n in names], F.col("file").alias("_file"), F.col("begins").alias("_begins"), F.col("place").alias("_place"))
    return rows, body.where("reason IS NOT NULL").select(F.col("file").alias("_file"), "text", "reason")


def with_place_ordinal(rows: DataFrame, name: str) -> DataFrame:
    """Add the 0-based place of each row of :func:`read_csv` among all rows, files in name order.

    A row's place is its number within its block plus the rows of the blocks before (one row a block), so that no file is
    numbered by one task.
    """
    counts = rows.groupBy("_file", "_begins").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_file", "_begins").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("_file", "_begins", F.coalesce(before, F.lit(0)).alias("_off"))
    own = F.row_number().over(Window.partitionBy("_file", "_begins").orderBy("_place"))
    out = rows.withColumn("_no", own).join(offsets, ["_file", "_begins"])
    return out.withColumn(name, (F.col("_off") + F.col("_no") - 1).cast("long")).drop("_off", "_no")
