"""A data source of box files cut by frame range, which opens only the ranges that a query asks for.

Files are MOT lines (frame,id,x,y,w,h,conf) named ``clip=<clip>/<first>-<last>.txt``. Every file is a partition. Conditions
on clip_id and frame that Spark hands down, the window and stride given as options, and a limit of frames
decide from the names alone which files are opened; within a file rows are filtered as they are parsed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.csv as csv
import pyarrow.fs as fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

SCHEMA = "clip_id string, frame int, id int, x double, y double, w double, h double, conf double"
NAME = re.compile(r"clip=([^/]*)/(\d+)-(\d+)\.txt$")
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


@dataclass
class FrameRange(InputPartition):
    """A file and what of it is asked for: frames from ``low`` to ``high``, every ``stride``-th from ``origin``."""

    path: str
    clip: str
    low: int
    high: int
    stride: int
    origin: int

    def __post_init__(self) -> None:
        super().__init__(self.path)

    def first(self) -> int:
        """The first frame asked for."""
        return self.low + (self.origin - self.low) % self.stride


def frame_range(lines: DataFrame, span: int, base: int = 1) -> Column:
    """The name of the file that a frame of lines(frame) belongs to, for files of ``span`` frames."""
    first = (F.floor((F.col("frame") - base) / span) * span + base).cast("long")
    return F.concat_ws("-", first.cast("string"), (first + span - 1).cast("string"))


class FrameReader(DataSourceReader):
    """Reads the partitions that are left after the conditions handed down."""

    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.low, self.high = int(options.get("start", 0)), int(options.get("stop", 2**31 - 1)) - 1
        self.origin, self.stride = self.low, int(options.get("stride", 1))
        self.clips: set[str] | None = None
        if most := options.get("max_frames"):
            # frames are numbered without gaps, so the last of the first n is known beforehand
            self.high = min(self.high, self.origin + (int(most) - 1) * self.stride) if int(most) else -1

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            name = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            if name == "frame" and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and isinstance(f.value, int):
                if isinstance(f, (EqualTo, GreaterThanOrEqual, GreaterThan)):
                    self.low = max(self.low, f.value + isinstance(f, GreaterThan))
                if isinstance(f, (EqualTo, LessThanOrEqual, LessThan)):
                    self.high = min(self.high, f.value - isinstance(f, LessThan))
            elif name == "clip_id" and isinstance(f, (EqualTo, In)):
                asked = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.clips = asked if self.clips is None else self.clips & asked
            else:
                yield f  # Spark's own work

    def partitions(self) -> list[FrameRange]:
        system, root = fs.FileSystem.from_uri(self.path)
        found = []
        for info in system.get_file_info(fs.FileSelector(root, recursive=True)):
            m = NAME.search(info.path) if info.type == fs.FileType.File else None
            if m and (self.clips is None or m[1] in self.clips):
                low, high = max(self.low, int(m[2])), min(self.high, int(m[3]))
                part = FrameRange(info.path, m[1], low, high, self.stride, self.origin)
                if part.first() <= high:
                    found.append(part)
        return sorted(found, key=lambda p: (p.clip, p.low)) or [FrameRange("", "", 0, -1, 1, 0)]

    def read(self, part: FrameRange) -> Iterator[pa.RecordBatch]:
        if not part.path:
            return
        system, _ = fs.FileSystem.from_uri(self.path)
        names = ["frame", "id", "x", "y", "w", "h", "conf"]
        types = dict(zip(names, [pa.int32(), pa.int32(), *[pa.float64()] * 5], strict=True))
        with system.open_input_stream(part.path) as stream:
            reader = csv.open_csv(stream, read_options=csv.ReadOptions(column_names=names), convert_options=csv.ConvertOptions(column_types=types))
            for batch in reader:
                frame = batch.column("frame").to_numpy()
                keep = (frame >= part.low) & (frame <= part.high) & ((frame - part.origin) % part.stride == 0)
                kept = batch.filter(pa.array(keep))
                yield pa.RecordBatch.from_arrays([pa.array([part.clip] * kept.num_rows, pa.string()), *kept.columns], names=["clip_id", *names])


class FrameSource(DataSource):
    """``spark.read.format("frame_ranges")`` with options path, start, stop, stride and max_frames."""

    @classmethod
    def name(cls) -> str:
        return "frame_ranges"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> FrameReader:
        return FrameReader({k.lower(): v for k, v in self.options.items()})


def write_frames(boxes: DataFrame, path: str, span: int = 1000) -> None:
    """boxes(clip_id, frame, id, x, y, w, h, conf) as files of ``span`` frames each, frames from 1.

    A range is written whole by one task, as one file with its name, whatever attempt wins: the file is
    replaced as a whole. Ranges of all clips are dealt to tasks by their key.
    """
    rows = boxes.select("clip_id", F.col("frame").cast("int").alias("frame"), "id", *[F.col(c).cast("double").alias(c) for c in ("x", "y", "w", "h", "conf")])
    rows = rows.select(F.col("clip_id").cast("string").alias("clip"), frame_range(rows, span).alias("part"), F.col("frame"), F.concat_ws(",", *[F.col(c).cast("string") for c in ("frame", "id", "x", "y", "w", "h", "conf")]).alias("line"))

    def put(table: pa.Table) -> pa.Table:
        table = table.sort_by("frame")
        clip, part = table.column("clip")[0].as_py(), table.column("part")[0].as_py()
        system, root = fs.FileSystem.from_uri(path)
        system.create_dir(f"{root}/clip={clip}", recursive=True)
        with system.open_output_stream(f"{root}/clip={clip}/{part}.txt") as out:
            out.write("".join(f"{x}\n" for x in table.column("line").to_pylist()).encode())
        return pa.table({"clip": [clip], "rows": [table.num_rows]})

    rows.groupBy("clip", "part").applyInArrow(put, "clip string, rows long").agg(F.sum("rows")).collect()


def read_frames(spark: SparkSession, path: str, **options) -> DataFrame:
    """The rows of frame-range files; start, stop, stride and max_frames choose frames of every clip."""
    spark.dataSource.register(FrameSource)
    spark.conf.set(PUSHDOWN, "true")
    return spark.read.format("frame_ranges").options(path=path, **options).load()
