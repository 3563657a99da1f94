"""Files that hold one JSON array each, however large: a data source that splits them, and a sink.

Collectors write every result file as one array.  Spark's own JSON reader takes such a file whole in
one task.  Here a file is cut into byte ranges, and each range yields the elements that begin in it.
Whether a byte lies inside a string, and how deep it is nested, depends on all bytes before it; both
are found exactly in two passes:

1. every range counts its unescaped quotes and the change of depth, for a range that begins outside a
   string and for one that begins inside.  The parity of the quotes before a range tells which holds;
   the depth follows from running sums over the ranges of a file (a row per range, not per byte).
2. every range, now told its state, cuts out its elements at commas of depth 1 and reads on past its
   end to finish the last one.

Elements leave as text and are parsed by ``from_json`` on the JVM, with a corrupt-record column.
Files are opened through pyarrow's file systems (local, and the schemes it knows), on the executors.

Defined cases: an empty file and an empty array have no rows; white space, byte-order mark and any
layout are allowed; a file that isn't an array gives one row with its first ``HEAD`` bytes as corrupt
record, an array that breaks off gives its last element as it is; names that begin with . or _ are
skipped.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from postlens.session import scratch_path, ship

FORMAT = "json_arrays"
RANGE = 64 << 20
CHUNK = 4 << 20
HEAD = 1024
ROWS = 2000
CORRUPT = "_corrupt_record"

SUMMARY = "file string, start long, quotes long, outside long, inside long"
ELEMENTS = "file string, position long, element string, is_array boolean"

_QUOTE, _SLASH, _COMMA = ord('"'), ord("\\"), ord(",")
_STEP = np.zeros(256, np.int8)                    # change of depth
_STEP[[ord("["), ord("{")]] = 1
_STEP[[ord("]"), ord("}")]] = -1
_MARK = _STEP != 0
_MARK[_COMMA] = True
_BLANK = b" \t\n\r"


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """pyarrow's file system for a path or URI, and the path in it."""
    local = re.match(r"^file:/*(/.*)$", path)
    if local or "://" not in path:
        return pafs.LocalFileSystem(), local[1] if local else path
    return pafs.FileSystem.from_uri(path)


def array_files(path: str) -> list[tuple[str, int]]:
    """(path, size) of the ``.json`` files at or below ``path``, by name."""
    fs, root = file_system(path)
    top = fs.get_file_info(root)
    if top.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    infos = [top] if top.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(root, recursive=True))
    skip = re.compile(r"(^|/)[._]")
    return sorted((i.path, i.size) for i in infos if i.type == pafs.FileType.File and (
        i is top or i.path.endswith(".json") and not skip.search(i.path[len(root):].lstrip("/"))))


@dataclass
class Bytes:
    """Where quotes, brackets and commas of a stretch of JSON are."""

    quotes: np.ndarray            # unescaped ones
    marks: np.ndarray             # brackets and commas, in strings too
    steps: np.ndarray             # their change of depth
    slashes: int                  # backslashes at the end

    @classmethod
    def of(cls, data: np.ndarray, slashes: int) -> Bytes:
        """``slashes``: backslashes right before ``data``."""
        quotes = np.flatnonzero(data == _QUOTE)
        tail = 0
        back = data == _SLASH
        if slashes or back.any():
            # the run of backslashes before each quote
            last = np.maximum.accumulate(np.where(back, -1, np.arange(len(data))))
            before = np.where(quotes > 0, last[quotes - 1], -1)
            run = quotes - 1 - before + np.where(before < 0, slashes, 0)
            quotes = quotes[run % 2 == 0]
            tail = len(data) - 1 - int(last[-1]) + (slashes if last[-1] < 0 else 0) if len(data) else slashes
        marks = np.flatnonzero(_MARK[data])
        return cls(quotes, marks, _STEP[data[marks]], tail)

    def in_string(self, inside: int) -> np.ndarray:
        """Of each mark; ``inside``: whether the stretch begins in a string."""
        return (np.searchsorted(self.quotes, self.marks) + inside) % 2 == 1


def _slashes_before(f, at: int) -> int:
    n, step = 0, 64
    while at - n > 0:
        size = min(step, at - n)
        f.seek(at - n - size)
        raw = f.read(size)
        own = len(raw) - len(raw.rstrip(b"\\"))
        n += own
        if own < size:
            break
    return n


def summarise(f, start: int, end: int) -> tuple[int, int, int]:
    """(unescaped quotes, change of depth from outside, from inside a string) of bytes start:end."""
    slashes = _slashes_before(f, start)
    f.seek(start)
    total, depth = 0, [0, 0]
    while start < end:
        data = np.frombuffer(f.read(min(CHUNK, end - start)), np.uint8)
        if not len(data):
            break
        b = Bytes.of(data, slashes)
        slashes, start = b.slashes, start + len(data)
        in_string = b.in_string(total % 2)
        depth[0] += int(b.steps[~in_string].sum())
        depth[1] += int(b.steps[in_string].sum())
        total += len(b.quotes)
    return total, depth[0], depth[1]


def elements(f, size: int, start: int, end: int, inside: int, depth: int) -> Iterator[tuple[int, bytes]]:
    """(position, bytes) of the elements that begin in bytes start:end of an array file."""
    slashes = _slashes_before(f, start)
    f.seek(start)
    at, held, begin = start, b"", None            # begin: where the open element's text starts
    while at < size:
        raw = f.read(min(CHUNK, size - at))
        if not raw:
            break
        b = Bytes.of(np.frombuffer(raw, np.uint8), slashes)
        slashes = b.slashes
        out = ~b.in_string(inside)
        marks, steps = b.marks[out], b.steps[out]
        level = depth + np.cumsum(steps)          # after the mark
        first = steps == 1
        border = np.where(first, level == 1, np.where(steps == -1, level == 0, level == 1))
        inside = (inside + len(b.quotes)) % 2
        depth = int(level[-1]) if len(level) else depth
        text, base = held + raw, at - len(held)
        for m, step in zip(marks[border].tolist(), steps[border].tolist(), strict=True):
            m += at
            if begin is not None:
                cut = text[begin - base:m - base]
                if step == 0 or cut.strip(_BLANK):
                    yield begin, cut
            begin = m + 1 if step != -1 and m < end else None
            if m >= end:
                return
        held = text[begin - base:] if begin is not None else b""
        at += len(raw)
        if begin is None and at >= end:
            return
    if begin is not None and held.strip(_BLANK):
        yield begin, held


@dataclass
class Range(InputPartition):
    path: str
    size: int
    start: int
    end: int
    inside: int = 0
    depth: int = 0


class ArrayReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.range = int(options.get("range_bytes", RANGE))
        self.states = options.get("states")

    def partitions(self) -> list[Range]:
        """Byte ranges of all files, with their states once those are known."""
        states = {}
        if self.states:
            fs, root = file_system(self.states)
            t = pq.read_table(root, filesystem=fs)
            states = {(f, s): (i, d) for f, s, i, d in zip(*(t.column(c).to_pylist() for c in ("file", "start", "inside", "depth")), strict=True)}
        out = []
        for path, size in array_files(self.path):
            for start in range(0, size, self.range):
                inside, depth = states.get((path, start), (0, 0))
                out.append(Range(path, size, start, min(start + self.range, size), inside, depth))
        return out or [Range("", 0, 0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if not part.path:
            return
        fs, _ = file_system(self.path)
        with fs.open_input_file(part.path) as f:
            if not self.states:
                yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (part.path, part.start, *summarise(f, part.start, part.end))],
                                                 schema=_arrow(SUMMARY))
                return
            head = f.read(HEAD).removeprefix(b"\xef\xbb\xbf").lstrip(_BLANK) if part.start == 0 else b"["
            if head[:1] != b"[":
                if head:
                    yield self._batch(part, [(0, head)], False)
                return
            rows, size = [], 0
            for position, raw in elements(f, part.size, part.start, part.end, part.inside, part.depth):
                rows.append((position, raw))
                size += len(raw)
                if len(rows) >= ROWS or size >= CHUNK:
                    yield self._batch(part, rows, True)
                    rows, size = [], 0
            if rows:
                yield self._batch(part, rows, True)

    @staticmethod
    def _batch(part: Range, rows: list[tuple[int, bytes]], is_array: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([part.path] * len(rows)), pa.array([p for p, _ in rows], pa.int64()),
             pa.array([r.decode("utf-8", "replace") for _, r in rows]), pa.array([is_array] * len(rows))], schema=_arrow(ELEMENTS))


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}
    return pa.schema([(n, kinds[k]) for n, k in (c.split() for c in ddl.split(", "))])


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class ArrayWriter(DataSourceArrowWriter):
    """Rows (name, element): each task writes one array file per name.  Files take their place when
    all tasks have ended; a task that is lost or repeated leaves nothing under a final name."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite, self.run = options["path"], overwrite, uuid.uuid4().hex[:12]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext
        task = TaskContext.get()
        fs, root = file_system(self.path)
        fs.create_dir(f"{root}/_open-{self.run}")
        done, f, now = [], None, None
        for batch in iterator:
            for name, element in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if f is None or name != now:
                    if f is not None:
                        f.write(b"\n]\n")
                        f.close()
                    own = f"{name}-{task.partitionId():05d}" + f"-{len(done)}" * any(d[2] == name for d in done)
                    temp = f"{root}/_open-{self.run}/{task.taskAttemptId()}-{len(done)}"
                    done.append((temp, f"{root}/{own}.json", name))
                    f, now = fs.open_output_stream(temp), name
                    f.write(b"[\n")
                else:
                    f.write(b",\n")
                f.write(element.encode())
        if f is not None:
            f.write(b"\n]\n")
            f.close()
        return Written([d[:2] for d in done])

    def _clean(self) -> tuple[pafs.FileSystem, str]:
        fs, root = file_system(self.path)
        return fs, f"{root}/_open-{self.run}"

    def commit(self, messages: list[Written | None]) -> None:
        fs, open_ = self._clean()
        if self.overwrite:
            fs_, root = file_system(self.path)
            if fs_.get_file_info(root).type != pafs.FileType.NotFound:
                for path, _ in array_files(self.path):
                    fs_.delete_file(path)
        for m in messages:
            for temp, final in m.files if m else ():
                fs.move(temp, final)
        if fs.get_file_info(open_).type != pafs.FileType.NotFound:
            fs.delete_dir(open_)

    def abort(self, messages: list[Written | None]) -> None:
        fs, open_ = self._clean()
        if fs.get_file_info(open_).type != pafs.FileType.NotFound:
            fs.delete_dir(open_)


class JsonArrays(DataSource):
    """``spark.read.format("json_arrays")``: elements with file and position, or (without the option
    ``states``) the summaries they are found from."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return ELEMENTS if "states" in self.options else SUMMARY

    def reader(self, schema) -> ArrayReader:
        return ArrayReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> ArrayWriter:
        return ArrayWriter(dict(self.options), overwrite)


def _register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(JsonArrays)


def read_elements(spark: SparkSession, path: str, range_bytes: int = RANGE) -> DataFrame:
    """file, position, element (text), is_array of the array files at or below ``path``."""
    _register(spark)
    source = spark.read.format(FORMAT).option("path", path).option("range_bytes", range_bytes)
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    parity = source.load().withColumn("inside_", (F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2).cast("int"))
    own = F.when(F.col("inside_") == 1, F.col("inside")).otherwise(F.col("outside"))
    states = parity.withColumn("own", own).select(
        "file", "start", F.col("inside_").alias("inside"), F.coalesce(F.sum("own").over(before), F.lit(0)).cast("int").alias("depth"))
    kept = scratch_path(spark, "array-states")
    states.write.parquet(kept)                    # a row for each range
    return source.option("states", kept).load()


def read_arrays(spark: SparkSession, path: str, schema: T.StructType | str, range_bytes: int = RANGE) -> DataFrame:
    """The records of the array files, with ``_corrupt_record``, ``file_name`` and ``file_platform``
    (the name up to the first ``_``).  An element that isn't an object of the schema, or a file that
    isn't an array, keeps its text in ``_corrupt_record``."""
    schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    kind = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    e = read_elements(spark, path, range_bytes)
    record = F.when(F.col("is_array"), F.from_json("element", kind, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}))
    bad = F.when(~F.col("is_array") | F.col("r").isNull(), F.col("element")).otherwise(F.col(f"r.{CORRUPT}"))
    name = F.element_at(F.split("file", "/"), -1)
    return e.withColumn("r", record).select(
        *[F.col("r")[f.name].alias(f.name) for f in schema.fields], bad.alias(CORRUPT), name.alias("file_name"),
        F.substring_index(name, "_", 1).alias("file_platform"))


def write_arrays(df: DataFrame, path: str, name: str, mode: str = "append", gather: bool = False) -> None:
    """Array files below ``path``: the rows of a value of column ``name`` go to files named after it,
    one for each task that holds some.  ``gather`` first moves the rows of a name together (one with
    much data is still dealt to several tasks): fewer, longer files for a shuffle of all texts."""
    _register(df.sparkSession)
    fields = [c for c in df.columns if c != name]
    rows = df.select(F.col(name).alias("name"), F.to_json(F.struct(*fields)).alias("element"))
    rows = rows.hint("rebalance", F.col("name")) if gather else rows
    (rows.sortWithinPartitions("name").write.format(FORMAT).mode(mode).option("path", path).save())
