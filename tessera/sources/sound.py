"""Sound files as a data source: 16-bit PCM in WAV, one track a row, read and written by the tasks themselves.

Files are reached through a file system URI, so a folder may be local, shared or remote. A write is one folder of files that appear when the
task is done, and a marker when the whole is; a failed write takes its files away.
"""

from __future__ import annotations

import io
import uuid
import wave
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

TRACK = "song_id string, sr int, samples array<double>"
PEAK = 0.89
DONE = "_SUCCESS"
PART_BYTES = 64 << 20  # of files that one task reads, about


def encoded(samples: np.ndarray, sr: int, peak: float = PEAK) -> bytes:
    """A WAV file of the samples at the peak (silence stays)."""
    top = np.abs(samples).max(initial=0.0) or 1.0
    y = np.clip(samples / top * peak, -1, 1)
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(sr)
        w.writeframes(np.rint(y * 32767).astype("<i2").tobytes())
    return out.getvalue()


def decoded(data: bytes) -> tuple[int, np.ndarray]:
    """(rate, samples in -1 to 1, several channels as their mean) of a 16-bit WAV file."""
    with wave.open(io.BytesIO(data), "rb") as w:
        if w.getsampwidth() != 2:
            raise ValueError("only 16-bit PCM is read")
        y = np.frombuffer(w.readframes(w.getnframes()), "<i2").reshape(-1, w.getnchannels())
        return w.getframerate(), y.mean(1) / 32768


def _opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else f"file:///{uri}")


@dataclass
class Files(InputPartition):
    paths: list[str]


@dataclass
class Written(WriterCommitMessage):
    paths: list[str]


class PcmReader(DataSourceReader):
    def __init__(self, uri: str):
        self.uri = uri

    def partitions(self) -> list[Files]:
        files, folder = _opened(self.uri)
        found = sorted((f for f in files.get_file_info(fs.FileSelector(folder)) if f.is_file and f.base_name.endswith(".wav")), key=lambda f: f.path)
        parts, size = [], 0
        for f in found:
            if not parts or size + f.size > PART_BYTES:
                parts.append(Files([]))
                size = 0
            parts[-1].paths.append(f.path)
            size += f.size
        return parts or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        files, _ = _opened(self.uri)
        for path in partition.paths:
            with files.open_input_file(path) as f:
                sr, y = decoded(f.read())
            yield path.rsplit("/", 1)[-1].removesuffix(".wav"), sr, y.tolist()


class PcmWriter(DataSourceWriter):
    def __init__(self, uri: str, overwrite: bool):
        self.uri = uri
        files, folder = _opened(uri)
        held = files.get_file_info(folder).type != fs.FileType.NotFound
        if held and files.get_file_info(fs.FileSelector(folder)):
            if not overwrite:
                raise FileExistsError(f"{uri} holds files")
            files.delete_dir_contents(folder)
        files.create_dir(folder, recursive=True)

    def write(self, iterator: Iterator) -> Written:
        files, folder = _opened(self.uri)
        paths = []
        for row in iterator:
            path = f"{folder}/{row.song_id}.wav"
            hidden = f"{folder}/.{row.song_id}-{uuid.uuid4().hex}"
            with files.open_output_stream(hidden) as out:
                out.write(encoded(np.asarray(row.samples or [], float), row.sr))
            files.move(hidden, path)  # a task that runs again puts the same file in its place
            paths.append(path)
        return Written(paths)

    def commit(self, messages: list[Written | None]) -> None:
        files, folder = _opened(self.uri)
        with files.open_output_stream(f"{folder}/{DONE}") as out:
            out.write(b"")

    def abort(self, messages: list[Written | None]) -> None:
        files, _ = _opened(self.uri)
        for path in [p for m in messages if m for p in m.paths]:
            if files.get_file_info(path).is_file:
                files.delete_file(path)


class PcmSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pcm_wav"

    def schema(self) -> str:
        return TRACK

    def reader(self, schema: StructType) -> PcmReader:
        return PcmReader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> PcmWriter:
        return PcmWriter(self.options["path"], overwrite)


def write_tracks(tracks: DataFrame, uri: str, overwrite: bool = False) -> None:
    """One file a track, named by song_id (a key)."""
    spark = tracks.sparkSession
    spark.dataSource.register(PcmSource)
    rows = tracks.selectExpr("cast(song_id as string) song_id", "cast(sr as int) sr", "cast(samples as array<double>) samples")
    rows.write.format("pcm_wav").mode("overwrite" if overwrite else "append").save(uri)


def read_tracks(spark: SparkSession, uri: str, low_s: float | None = None, high_s: float | None = None) -> DataFrame:
    """(song_id, sr, samples) of a folder's files, of an allowed length."""
    spark.dataSource.register(PcmSource)
    rows = spark.read.format("pcm_wav").load(uri)
    for bound, how in ((low_s, ">="), (high_s, "<=")):
        if bound is not None:
            rows = rows.where(f"size(samples) / sr {how} {bound}")
    return rows
