"""One pass that writes good rows and, apart from them, what could not be read and why (S3, T5)."""

from __future__ import annotations

import codecs
import csv
import io
import warnings
import zlib

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorelab.schemas import SUMMARY_SCHEMA
from scorelab.session import open_writers, scratch_path

#: Files up to so many bytes are parsed whole in one task; larger ones are split by the CSV reader.
WHOLE_FILE = 64 << 20


def split_rows(df: DataFrame, reason: Column, path: str) -> tuple[DataFrame, DataFrame]:
    """Write ``df`` once to ``path``, its rows with a reason apart from the others; returns (good rows, bad
    rows with ``reason``). Both read what was written: the input is computed once."""
    if "bad" in df.columns:
        raise ValueError("the column 'bad' names the folders of the two parts")
    rows = df.withColumn("reason", reason)
    with open_writers(df.sparkSession):
        rows.withColumn("bad", F.col("reason").isNotNull()).write.partitionBy("bad").parquet(path)
    back = df.sparkSession.read.schema(T.StructType([*rows.schema.fields, T.StructField("bad", T.BooleanType())])).parquet(path)
    return back.where("not bad").drop("bad", "reason"), back.where("bad").drop("bad")


_COLUMNS = SUMMARY_SCHEMA.fieldNames()
_SCANNED = T.StructType([T.StructField(c, T.StringType()) for c in [*_COLUMNS, "path"]] + [
    T.StructField("line", T.LongType()), T.StructField("reason", T.StringType()), T.StructField("raw", T.StringType())])


#: Bytes of a file that are decompressed, decoded and parsed at a time.
PIECE = 1 << 20


def _pieces(content):
    """A file's bytes in pieces; every member of a gzip file. Damaged or cut data raise."""
    view, at = memoryview(content), 0
    if bytes(view[:2]) != b"\x1f\x8b":
        for at in range(0, len(view), PIECE):
            yield bytes(view[at:at + PIECE])
        return
    while at < len(view):
        member = zlib.decompressobj(31)
        while not member.eof:
            data = bytes(view[at:at + PIECE])
            if not data:
                raise ValueError("the compressed data end too soon")
            at += len(data)
            full = True
            while full and not member.eof:
                out = member.decompress(data, PIECE)
                data, full = member.unconsumed_tail, len(out) == PIECE
                if out:
                    yield out
        at -= len(member.unused_data)
        while at < len(view) and view[at] == 0:
            at += 1


class _Stream(io.RawIOBase):
    """The pieces as a file."""

    def __init__(self, pieces):
        self.pieces, self.rest = pieces, b""

    def readable(self):
        return True

    def readinto(self, buffer):
        if not len(self.rest):
            self.rest = memoryview(next(self.pieces, b""))     # no piece is empty
        n = min(len(buffer), len(self.rest))
        buffer[:n], self.rest = self.rest[:n], self.rest[n:]
        return n


def _blank(content) -> bool:
    """Whether a file's text has no character but spaces; data that are damaged or not UTF-8 raise."""
    decoder, blank = codecs.getincrementaldecoder("utf-8-sig")(), True
    for piece in _pieces(content):
        blank = not decoder.decode(piece).strip() and blank
    return not decoder.decode(b"", True).strip() and blank


def _parse(path: str, content):
    """(nine cells, path, line, reason, raw) of every row of a summary file; one row with a reason for a bad file. The
    text is read twice in pieces (is it whole? what does it say?) and never held."""
    nothing = [None] * len(_COLUMNS)
    try:
        if _blank(content):
            return
    except (ValueError, zlib.error) as e:
        yield *nothing, path, None, f"unreadable file: {e}", None
        return
    lines = io.TextIOWrapper(io.BufferedReader(_Stream(_pieces(content))), encoding="utf-8-sig", newline="")
    rows = csv.reader(line.replace('\\"', '""') for line in lines)
    try:
        head = [c.strip() for c in next(rows)]
        if "task_id" not in head:
            yield *nothing, path, 1, "no summary header in line 1", ",".join(head)
            return
        at = [head.index(c) if c in head else None for c in _COLUMNS]
        for cells in rows:
            if not cells:
                continue
            if len(cells) > len(head):
                yield *nothing, path, rows.line_num, f"{len(cells)} cells under {len(head)} names", ",".join(cells)
            else:
                yield *[cells[i] if i is not None and i < len(cells) and cells[i] != "" else None for i in at], path, rows.line_num, None, None
    except csv.Error as e:
        yield *nothing, path, rows.line_num, f"unreadable line: {e}", None


def _scan_small(files: DataFrame) -> DataFrame:
    def run(batches):
        names = _SCANNED.fieldNames()
        schema = pa.schema([(c, pa.int64() if c == "line" else pa.string()) for c in names])

        def flush(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)] if rows else
                                              [pa.array([], f.type) for f in schema], schema=schema)

        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content")):
                rows = []
                for row in _parse(path.as_py(), content.as_buffer()):
                    rows.append(row)
                    if len(rows) >= 10_000:
                        yield flush(rows)
                        rows = []
                yield flush(rows)

    return files.select("path", "content").mapInArrow(run, _SCANNED)


def _scan_large(spark: SparkSession, paths: list[str]) -> DataFrame | None:
    """Large files by Spark's CSV reader, those with the same first line together."""
    by_head: dict[tuple, list[str]] = {}
    for path in paths:      # planning: one line of each large file
        by_head.setdefault(tuple(c.strip() for c in spark.read.option("header", True).csv(path).columns), []).append(path)
    none = [(*[None] * len(_COLUMNS), path, 1, "no summary header in line 1", ",".join(head))
            for head in sorted(by_head) if "task_id" not in head for path in by_head[head]]
    out = spark.createDataFrame(none, _SCANNED) if none else None
    for head, files in sorted(x for x in by_head.items() if "task_id" in x[0]):
        schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(head))] + [T.StructField("_bad", T.StringType())])
        raw = spark.read.schema(schema).option("header", True).option("enforceSchema", True).option("columnNameOfCorruptRecord", "_bad").csv(files)
        more = F.regexp_count(F.coalesce("_bad", F.lit("")), F.lit(r',(?=(?:[^"]*"[^"]*")*[^"]*$)')) >= len(head)
        reason = F.when(more, F.concat(F.lit("more cells than the "), F.lit(str(len(head))), F.lit(" names")))
        cells = [F.when(reason.isNull(), F.col(f"c{head.index(c)}")) if c in head else F.lit(None).cast("string") for c in _COLUMNS]
        part = raw.select(*[x.alias(c) for x, c in zip(cells, _COLUMNS)], F.col("_metadata.file_path").alias("path"), F.lit(None).cast("bigint").alias("line"),
                          reason.alias("reason"), F.when(reason.isNotNull(), F.coalesce("_bad", F.lit(""))).alias("raw"))
        out = part if out is None else out.unionByName(part)
    return out


def load_summaries(spark: SparkSession, pattern: str, model_from: str = "file", whole_file: int = WHOLE_FILE) -> tuple[DataFrame, DataFrame]:
    """S3 + U1: (rows, quarantine) of all summary CSVs of a glob or folder, in one scan of the files.

    The first line of a file, read as CSV, says what its cells are: a summary column that it
    lacks is NULL, other columns are left out, short rows are filled with NULL, cells that are
    no number or boolean become NULL. ``model`` is the file's name without ``_summary`` (or the value of its
    ``model=`` folder with ``model_from="partition"``). The quarantine has ``path``, ``line``, ``reason`` and ``raw``:
    one row for a file that is damaged, not UTF-8 or without a ``task_id`` in its first line, and one
    for a row with more cells than its header; everything else loads. Files over ``whole_file`` bytes are
    split by Spark's CSV reader (their quarantined rows have no line number, and a damaged compressed one fails)."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    try:
        files = found.load(pattern)
        large = [r["path"] for r in files.where(F.col("length") > whole_file).select("path").collect()]
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        none = spark.createDataFrame([], T.StructType([*SUMMARY_SCHEMA.fields, T.StructField("model", T.StringType())]))
        return none, spark.createDataFrame([], "path string, line bigint, reason string, raw string")
    scanned = _scan_small(files.where(F.col("length") <= whole_file))
    if large:
        scanned = scanned.unionByName(_scan_large(spark, large))
    name = F.regexp_replace(F.regexp_extract("path", r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")
    model = F.replace(F.url_decode(name), F.lit("_summary"), F.lit("")) if model_from == "file" else F.url_decode(F.regexp_extract("path", r"/model=([^/]*)/", 1))
    typed = scanned.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in SUMMARY_SCHEMA.fields], model.alias("model"), F.when(F.col("reason").isNotNull(), F.col("path")).alias("path"),
                           "line", "raw", F.col("reason").alias("why"))
    good, bad = split_rows(typed, F.col("why"), scratch_path(spark, "summaries"))
    return good.select(*SUMMARY_SCHEMA.fieldNames(), "model"), bad.select("path", "line", "reason", "raw")


def read_summaries(spark: SparkSession, pattern: str, model_from: str = "file", ignore_corrupt: bool = False) -> DataFrame:
    """The rows of ``load_summaries``. A bad file fails, or with ``ignore_corrupt`` is named in a warning while the others load;
    a row with too many cells is named in a warning."""
    good, bad = load_summaries(spark, pattern, model_from)
    files = F.col("reason").rlike("^(unreadable|no summary)")
    for r in bad.where(files).orderBy("path").collect():     # bad files
        if not ignore_corrupt:
            raise ValueError(f"{r['reason']}: {r['path']}")
        warnings.warn(f"skipped {r['path']}: {r['reason']}", stacklevel=2)
    rows = bad.where(~files).agg(F.count("*"), F.min("path")).first()
    if rows[0]:
        warnings.warn(f"left out {rows[0]} rows with more cells than names, first in {rows[1]}", stacklevel=2)
    return good
