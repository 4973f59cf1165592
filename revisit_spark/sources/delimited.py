"""Delimited files in, issue reports and exports out."""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import normalize as n
from ..operators.validate import shape_issues
from .tables import staged

#: The columns of an issue report.
REPORT = ("row_number", "status", "error_code", "field", "message", "raw_value")


def cells_of(line: Column, separator: str = ",") -> Column:
    """The cells of a row; quoted ones may hold separators, line ends and doubled quotes. A blank line has none.

    What stands behind a closing quote belongs to the cell, and a quote that is never closed goes to the row's end.
    """
    s, quoted = re.escape(separator), r'"[^"]*+(?:""[^"]*+)*+'
    found = F.regexp_extract_all(F.concat(F.lit(separator), line), F.lit(rf'(?s){s}({quoted}"[^{s}]*+|{quoted}$|[^{s}]*+)'), F.lit(1))
    parts = r'(?s)^"([^"]*+(?:""[^"]*+)*+)(?:"(.*))?$'
    plain = lambda c: F.concat(F.replace(F.regexp_extract(c, parts, 1), F.lit('""'), F.lit('"')), F.regexp_extract(c, parts, 2))
    return F.when(line == "", F.array().cast("array<string>")).otherwise(F.transform(found, lambda c: F.when(c.startswith('"'), plain(c)).otherwise(c)))


def _from_lines(spark: SparkSession, path: str, separator: str) -> DataFrame:
    """(file, at, cells): a row for each line, numbered from 0 within its file.

    A line's number is its place within its block of the file plus the lines of the blocks before, so a
    file of any size is read by many tasks. Lines are written once: numbers and lines are of one reading. They don't
    move to be numbered: all tasks get the blocks, of which there is a row each.
    """
    value = F.regexp_replace(F.make_valid_utf8("value"), "^\ufeff", "")
    lines = staged(spark.read.text(path).select(value.alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id")))
    blocks = lines.groupBy("file", "block").agg(F.min("id").alias("low"), F.count("*").alias("lines"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select("file", "block", (F.coalesce(F.sum("lines").over(earlier), F.lit(0)) - F.col("low")).alias("shift"))
    return lines.join(F.broadcast(starts), ["file", "block"]).select("file", (F.col("id") + F.col("shift")).alias("at"), cells_of(F.col("line"), separator).alias("cells"))


def _ends_open(line: Column, separator: str) -> Column:
    """Whether a line that begins outside of a cell ends within a quoted one."""
    s = re.escape(separator)
    cell = rf'(?:"[^"]*+(?:""[^"]*+)*+"[^{s}]*+|[^"{s}][^{s}]*+)?+'
    return line.rlike(rf'(?s)^(?:{cell}{s})*+"[^"]*+(?:""[^"]*+)*+$')


def _line_states(lines: DataFrame) -> DataFrame:
    """Lines with, for a block that begins outside (0) or within (1) a quoted cell, what holds before each: ``open0``,
    ``open1``, and the rows begun in the block, ``rows0``, ``rows1``.

    A line either sets the state (it ends alike in both cases), keeps it or turns it. So the state is that of the last
    line that sets it, turned as often as lines turned since. One pass in order over each block.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state, begun = None, [False, True], [0, 0]
        for batch in batches:
            names = [f"{f}#{b}" for f, b in zip(batch.column("file").to_pylist(), batch.column("block").to_pylist(), strict=True)]
            out0, out1 = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("out0", "out1"))
            n, i = batch.num_rows, 0
            opened, rows = np.zeros((2, n), bool), np.zeros((2, n), np.int64)
            while i < n:
                j = i + 1
                while j < n and names[j] == names[i]:
                    j += 1
                if names[i] != at:
                    at, state, begun = names[i], [False, True], [0, 0]
                sets, turns = out0[i:j] == out1[i:j], np.cumsum(out0[i:j] & ~out1[i:j])
                place = np.maximum.accumulate(np.where(sets, np.arange(j - i), -1))
                since = turns - np.where(place >= 0, turns[place], 0)
                for h in (0, 1):
                    after = np.where(place >= 0, out0[i:j][place], state[h]) ^ (since % 2 == 1)
                    opened[h, i:j] = np.concatenate([[state[h]], after[:-1]])
                    rows[h, i:j] = begun[h] + np.cumsum(~opened[h, i:j])
                    state[h], begun[h] = bool(after[-1]), int(rows[h, j - 1])
                i = j
            kept = [batch.column(c) for c in ("file", "block", "id", "line")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(opened[0]), pa.array(opened[1]), pa.array(rows[0]), pa.array(rows[1]), batch.column("out0"), batch.column("out1")], names=["file", "block", "id", "line", "open0", "open1", "rows0", "rows1", "out0", "out1"])

    return lines.mapInArrow(run, "file string, block long, id long, line string, open0 boolean, open1 boolean, rows0 long, rows1 long, out0 boolean, out1 boolean")


def _from_quoted_lines(spark: SparkSession, path: str, separator: str) -> DataFrame:
    """(file, at, cells) of UTF-8 files whose quoted cells may hold line ends, a file of any size by many tasks.

    Where a line stands, within a quoted cell or not, depends on all before it; each block of a file works out both
    cases, a prefix over the blocks (one row each) tells which one holds, and only rows of several lines are gathered.
    A row of all lines behind a quote that is never closed is one row, as it is to any reader.
    """
    value = F.make_valid_utf8("value")
    read = spark.read.option("lineSep", "\n").text(path).select(value.alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    read = read.withColumn("line", F.when(F.col("block") == 0, F.regexp_replace("line", "^\ufeff", "")).otherwise(F.col("line")))
    bare = F.regexp_replace("line", "\r$", "")
    lines = staged(_line_states(read.select("file", "block", "id", "line", _ends_open(bare, separator).alias("out0"), _ends_open(F.concat(F.lit('"'), bare), separator).alias("out1"))))
    after = lambda h: F.when(F.col(f"open{h}"), F.col("out1")).otherwise(F.col("out0")).alias(f"end{h}")
    blocks = lines.groupBy("file", "block").agg(F.max_by(F.struct(after(0), after(1), "rows0", "rows1"), "id").alias("x")).select("file", "block", "x.*")
    order = Window.partitionBy("file").orderBy("block")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    turned = F.sum((F.col("end0") & ~F.col("end1")).cast("int"))
    told = blocks.withColumn("turns", turned.over(order))
    told = told.withColumns({"set": F.last(F.when(F.col("end0") == F.col("end1"), F.struct("end0", "turns")), ignorenulls=True).over(earlier), "so_far": F.coalesce(turned.over(earlier), F.lit(0))})
    told = told.withColumn("within", F.coalesce("set.end0", F.lit(False)) != ((F.col("so_far") - F.coalesce("set.turns", F.lit(0))) % 2 == 1))
    begun = F.when(F.col("within"), F.col("rows1")).otherwise(F.col("rows0"))
    told = told.select("file", "block", "within", F.coalesce(F.sum(begun).over(earlier), F.lit(0)).alias("before"))
    pick = lambda c: F.when(F.col("within"), F.col(f"{c}1")).otherwise(F.col(f"{c}0"))
    placed = lines.join(F.broadcast(told), ["file", "block"]).withColumns({"open": pick("open"), "at": F.col("before") + pick("rows") - 1})
    placed = placed.select("file", "block", "id", "line", "at", "open", F.when(F.col("open"), F.col("out1")).otherwise(F.col("out0")).alias("goes_on"))
    alone = placed.where(~F.col("open") & ~F.col("goes_on")).select("file", "at", "line")
    parts = F.array_sort(F.collect_list(F.struct("block", "id", "line")))
    gathered = placed.where(F.col("open") | F.col("goes_on")).groupBy("file", "at").agg(F.array_join(F.transform(parts, lambda x: x["line"]), "\n").alias("line"))
    every = alone.union(gathered)
    return every.select("file", "at", cells_of(F.regexp_replace("line", "\r$", ""), separator).alias("cells"))


def _from_files(spark: SparkSession, path: str, separator: str, encoding: str) -> DataFrame:
    """The same for files that aren't UTF-8: a file is one task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                text = io.TextIOWrapper(io.BytesIO(content), encoding, errors="replace", newline="")
                part: list[tuple] = []
                for at, row in enumerate(csv.reader(text, delimiter=separator)):
                    part.append((name, at, [c.removeprefix("\ufeff") for c in row] if at == 0 else row))
                    if len(part) == 5000:
                        yield pd.DataFrame(part, columns=["file", "at", "cells"])
                        part = []
                yield pd.DataFrame(part, columns=["file", "at", "cells"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "file string, at long, cells array<string>")


def read_rows(spark: SparkSession, path: str, columns: list[str], separator: str = ",", encoding: str = "UTF-8", header: bool = True, multi_line: bool = False) -> DataFrame:
    """(file, row_number, raw map, issues) of the rows of files; numbers start behind each file's header.

    Short rows are filled with empty cells, all further cells are kept as ``__extra_n``; either is an issue.
    Files are read in parts, also where quoted cells may hold line ends (``multi_line``); only of another
    encoding each file is a task. Bytes that can't be read become U+FFFD.
    """
    if encoding.upper().replace("_", "-") not in ("UTF-8", "UTF8"):
        rows = _from_files(spark, path, separator, encoding)
    else:
        rows = _from_quoted_lines(spark, path, separator) if multi_line else _from_lines(spark, path, separator)
    if header:
        rows = rows.where("at > 0")
    k = len(columns)
    own = F.array(*(F.coalesce(F.get("cells", F.lit(i)), F.lit("")) for i in range(k)))
    beyond = F.slice("cells", k + 1, F.greatest(F.size("cells") - k, F.lit(0)))
    names = F.concat(F.array(*map(F.lit, columns)), F.transform(beyond, lambda c, i: F.concat(F.lit("__extra_"), (i + 1).cast("string"))))
    raw = F.map_from_arrays(names, F.concat(own, beyond))
    return rows.select("file", (F.col("at") + 1).alias("row_number"), raw.alias("raw"), shape_issues(F.col("cells"), k).alias("issues"))


def report_lines(report: DataFrame) -> DataFrame:
    """(batch_id, row_number, at, value): a report's lines, headed by one with the names of its columns.

    Each line's last cell ends with a CR, which makes CRLF with the line end that is written.
    """
    quoted = [F.concat(F.lit('"'), F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"')) for c in REPORT]
    lines = report.select("batch_id", "row_number", "at", F.concat(F.concat_ws(",", *quoted), F.lit("\r")).alias("value"))
    head = report.sparkSession.range(1).select(F.lit(None).cast(report.schema["batch_id"].dataType).alias("batch_id"), F.lit(None).cast(report.schema["row_number"].dataType).alias("row_number"), F.lit(-1).alias("at"), F.lit(",".join(REPORT) + "\r").alias("value"))
    return head.union(lines)


def write_report(report: DataFrame, path: str) -> None:
    """An issue report: its header, then lines in order of rows."""
    report_lines(report).orderBy(F.col("batch_id").asc_nulls_first(), F.col("row_number").asc_nulls_first(), "at").select("value").write.mode("overwrite").text(path)


def export_cells(rows: DataFrame) -> DataFrame:
    """Any table as text cells that are safe for spreadsheets; maps, lists and structs as JSON."""
    cells = []
    for f in rows.schema.fields:
        c = F.col(f"`{f.name}`")
        if f.dataType.typeName() == "map":
            c = F.to_json(F.map_from_entries(F.array_sort(F.map_entries(c))))
        else:
            c = F.to_json(c) if f.dataType.typeName() in ("struct", "array") else c.cast("string")
        cells.append(n.csv_safe(c).alias(f.name))
    return rows.select(*cells)


def write_export(rows: DataFrame, path: str) -> None:
    """The cells as delimited files with headers; quotes within a cell are doubled, as spreadsheets have them."""
    export_cells(rows).write.mode("overwrite").csv(path, header=True, escape='"')
