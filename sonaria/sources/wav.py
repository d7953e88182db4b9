"""Sound files: a reader over Spark's binary files, a Python data source, and a writer."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from sonaria import schemas
from sonaria.functions import kernels

RATE = 4000


def decode(content: bytes, target: int | None = RATE) -> tuple[int, np.ndarray] | None:
    """(rate, mono samples from -1 to 1), resampled to the target; None if it is no PCM sound."""
    try:
        with wave.open(io.BytesIO(content)) as w:
            rate, width, channels, raw = w.getframerate(), w.getsampwidth(), w.getnchannels(), w.readframes(w.getnframes())
    except (wave.Error, EOFError):
        return None
    if width == 1:
        x = (np.frombuffer(raw, np.uint8).astype(float) - 128) / 128
    elif width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16) << 8 >> 8) / float(1 << 23)
    else:
        x = np.frombuffer(raw, f"<i{width}").astype(float) / float(1 << (8 * width - 1))
    x = x.reshape(-1, channels).mean(1)
    if target and rate != target:
        x, rate = kernels.resample(x, rate, target), target
    return rate, x.astype(np.float32)


def encode(samples: np.ndarray, rate: int) -> bytes:
    """16-bit mono PCM."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes((np.clip(np.asarray(samples, float), -1, 1) * 32767).astype("<i2").tobytes())
    return out.getvalue()


def header(content: bytes) -> tuple[int, float] | None:
    """(rate, seconds) from the header."""
    try:
        with wave.open(io.BytesIO(content)) as w:
            return w.getframerate(), w.getnframes() / w.getframerate()
    except (wave.Error, EOFError, ZeroDivisionError):
        return None


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.[wW][aA][vV]").load(path).select(F.substring_index("path", "/", -1).alias("file"), "content")


def read_audio(spark: SparkSession, path: str, target: int | None = RATE) -> DataFrame:
    """file, sr, samples of every sound file of a folder. What can't be decoded has null samples and so drops out of
    what follows; it doesn't end the job."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                got = decode(content, target)
                yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([got[0] if got else None], pa.int32()), pa.array([got[1] if got else None], pa.list_(pa.float32()))], ["file", "sr", "samples"])

    return _files(spark, path).mapInArrow(run, schemas.AUDIO)


def durations(spark: SparkSession, path: str) -> DataFrame:
    """file, duration; samples are never decoded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [header(c) for c in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([g[1] if g else None for g in got], pa.float64())], ["file", "duration"])

    return _files(spark, path).mapInArrow(run, "file string, duration double").filter("duration is not null")


def uploads(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the sound files that land in a folder: path, modificationTime, length, content."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "*.[wW][aA][vV]").load(path)


def write_audio(tracks: DataFrame, path: str) -> DataFrame:
    """Write rows (name, sr, samples) as sound files below path and return (name, path, n_samples). Writing happens
    when the result is acted on; a repeated task writes the same bytes to the same place. path must be a folder that
    all executors see."""
    folder = path.removeprefix("file://").rstrip("/")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.makedirs(folder, exist_ok=True)
        for b in batches:
            names, rates = b.column(0).to_pylist(), b.column(1).to_pylist()
            size = []
            for name, rate, s in zip(names, rates, b.column(2), strict=True):
                y = s.values.to_numpy(zero_copy_only=False) if s.is_valid else np.zeros(0)
                part = f"{folder}/.{name}.{os.getpid()}"
                with open(part, "wb") as f:
                    f.write(encode(y, rate))
                os.replace(part, f"{folder}/{name}")
                size.append(len(y))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([f"{folder}/{n}" for n in names]), pa.array(size, pa.int64())], ["name", "path", "n_samples"])

    return tracks.select("name", "sr", "samples").mapInArrow(run, "name string, path string, n_samples long")


class _File(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


class WavReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.folder, self.rate = options["path"], int(options.get("rate", RATE))

    def partitions(self) -> list[InputPartition]:
        import glob

        return [_File(p) for p in sorted(glob.glob(f"{self.folder.removeprefix('file://')}/*.[wW][aA][vV]"))] or [_File("")]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition.path:
            with open(partition.path, "rb") as f:
                got = decode(f.read(), self.rate)
            if got:
                yield partition.path.rpartition("/")[2], got[0], got[1].tolist()


class WavDataSource(DataSource):
    """spark.read.format("wav").load(folder), for folders that all executors mount; a file is a partition."""

    @classmethod
    def name(cls) -> str:
        return "wav"

    def schema(self) -> str:
        return schemas.AUDIO

    def reader(self, schema) -> WavReader:
        return WavReader(self.options)
