"""Raw frames in files: a data source that reads them by absolute index, and a writer of chunks."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, frame long, image binary"
#: Bytes of images, and frames, of a batch that a task hands over.
BATCH_BYTES, BATCH_ROWS = 1 << 22, 4096


def opened(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if "://" not in path and path.startswith("file:"):
        path = "file://" + path.removeprefix("file:")
    return pyarrow.fs.FileSystem.from_uri(path) if "://" in path else (pyarrow.fs.LocalFileSystem(), path)


@dataclass
class Chunks(InputPartition):
    """Frames that a task reads: of each file (its name under the root), the first and how many."""

    parts: list[tuple[str, int, int]]


class FrameReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.bytes = int(options["width"]) * int(options["height"]) * int(options.get("channels", 3))
        self.chunk, self.first = int(options.get("chunk", 64)), int(options.get("first", 0))
        self.count = int(options["count"]) if "count" in options else None
        self.together, self.opening = int(options.get("together", 0)), int(options.get("opening", 1 << 16))

    def partitions(self) -> list[Chunks]:
        """Chunks of all files, dealt over tasks; a file of no whole number of frames, or of too few, is an error."""
        files, at = opened(self.path)
        info = files.get_file_info(at)
        found = [info] if info.is_file else files.get_file_info(pyarrow.fs.FileSelector(at, recursive=True))
        out, room = [], 0
        for f in sorted((f for f in found if f.is_file and not f.base_name.startswith((".", "_"))), key=lambda f: f.path):
            whole, rest = divmod(f.size, self.bytes)
            if rest:
                raise ValueError(f"{f.path}: {f.size} bytes are no whole number of frames of {self.bytes}")
            end = whole if self.count is None else self.first + self.count
            if end > whole:
                raise ValueError(f"{f.path}: {whole} frames, and {end} asked for")
            for k in range(self.first, end, self.chunk):
                n = min(self.chunk, end - k)
                cost = n * self.bytes + self.opening
                if cost > room:
                    out.append(Chunks([]))
                    room = max(self.together, cost)
                out[-1].parts.append((f.path.removeprefix(at), k, n))
                room -= cost
        return out

    def read(self, partition: Chunks | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no file
            return
        files, at = opened(self.path)
        paths, frames, images, size = [], [], [], 0
        batch = lambda: pa.RecordBatch.from_pydict({"path": paths, "frame": pa.array(frames, pa.int64()), "image": pa.array(images, pa.binary())})
        for name, first, count in partition.parts:
            with files.open_input_file(at + name) as file:
                file.seek(first * self.bytes)
                for k in range(first, first + count):
                    image = file.read(self.bytes)
                    if len(image) != self.bytes:
                        raise ValueError(f"{at + name}: frame {k} has {len(image)} bytes of {self.bytes}")
                    paths.append(at + name)
                    frames.append(k)
                    images.append(image)
                    size += self.bytes
                    if size >= BATCH_BYTES or len(frames) == BATCH_ROWS:
                        yield batch()
                        paths, frames, images, size = [], [], [], 0
        if frames:
            yield batch()


class RawFrames(DataSource):
    """Files of frames without any header, one behind the other.

    Options: path (a file or a folder), width, height, channels (3), chunk (frames
    of a file that a task reads, 64), and, to read a part of every file, first and
    count. A task reads one chunk, or, with ``together``, as many as cost that many
    bytes, opening (64 KiB) counted for each, so that small files share a task. A
    file gives exactly the bytes asked for, or the read fails.
    """

    @classmethod
    def name(cls) -> str:
        return "rawframes"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FrameReader:
        return FrameReader(self.options)


def read_frames(spark: SparkSession, path: str, width: int, height: int, **options: int) -> DataFrame:
    """Frames of raw files: path, frame (its number in the file), image."""
    spark.dataSource.register(RawFrames)
    given = {"path": path, "width": width, "height": height, **options}
    return spark.read.format("rawframes").options(**{k: str(v) for k, v in given.items()}).load()


def write_frames(frames: DataFrame, path: str, chunk: int) -> DataFrame:
    """Write frames (video_id, frame, image) as a file for each ``chunk`` frame numbers of a video; returns what was written.

    A file is moved to its name when it is whole, so a task that runs again
    leaves none broken. Frames of a chunk must have no hole before them, since a
    file has no frame numbers.
    """

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = opened(path)
        files.create_dir(root, recursive=True)
        at, out, told = None, None, []

        def close() -> None:
            nonlocal out
            out.close()
            out = None
            files.move(draft, f"{root}/{name}")
            told.append((*at, count))

        try:
            for batch in batches:  # a file may go over several batches
                videos, chunks, numbers = (batch.column(c).to_pylist() for c in ("video_id", "chunk", "frame"))
                for video, number, frame, image in zip(videos, chunks, numbers, batch.column("image"), strict=True):
                    if (video, number) != at:
                        if out:
                            close()
                        at, count = (video, number), 0
                        name = f"video-{video}-chunk-{number:08d}.raw"
                        draft = f"{root}/.{name}-{uuid.uuid4().hex}"
                        out = files.open_output_stream(draft)
                    if frame != number * chunk + count:
                        raise ValueError(f"video {video}: frames are missing in chunk {number}")
                    out.write(image.as_buffer())
                    count += 1
                yield from tell(told)
                told.clear()
            if out:
                close()
                yield from tell(told)
        finally:
            if out:
                out.close()

    def tell(told: list[tuple[int, int, int]]) -> Iterator[pa.RecordBatch]:
        if told:
            yield pa.RecordBatch.from_pydict(dict(zip(("video_id", "chunk", "frames"), (pa.array(c, pa.int64()) for c in zip(*told, strict=True)), strict=True)))

    cut = frames.select("video_id", "frame", "image", F.floor(F.col("frame") / chunk).alias("chunk"))
    sorted_ = cut.repartition("video_id", "chunk").sortWithinPartitions("video_id", "chunk", "frame")
    return sorted_.mapInArrow(put, "video_id long, chunk long, frames long")


def place_of(path: Column, frame: Column, chunk: int) -> tuple[Column, Column]:
    """Video and frame number of a frame that write_frames wrote."""
    return F.regexp_extract(path, r"video-(-?\d+)-chunk-(\d+)\.raw$", 1).cast("long"), F.regexp_extract(path, r"video-(-?\d+)-chunk-(\d+)\.raw$", 2).cast("long") * chunk + frame
