"""WAV and office files as formats of spark.read: register(spark), then spark.read.format("corvane_wav").load(folder).

Files are read where Spark runs, dealt into partitions by size; the driver lists names and sizes only. A folder may be a
local path or an address that pyarrow's file systems know (hdfs, s3, gs). With a schema of some columns
(.schema("path string, sample_rate int")) only those are made: without samples a WAV file's head is all that is read. The
option "pattern" (*.wav) picks files by name before any is opened. A file that can't be read is a row with a problem, and
its other columns are null; an empty folder has no rows, one that isn't there is an error.
"""

from __future__ import annotations

import fnmatch
import posixpath
import wave
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from .documents import Refused, office_units, wav_samples

#: A partition's files come to about so many bytes, and are at most so many; a larger file is one by itself.
PART_BYTES, PART_FILES = 64 << 20, 1000


@dataclass
class Files(InputPartition):
    files: list[tuple[str, int]]


def dealt(files: list[tuple[str, int]], most_bytes: int = PART_BYTES, most_files: int = PART_FILES) -> list[Files]:
    """Files (path, bytes) in order, cut where the next would be too much."""
    out: list[Files] = []
    held = 0
    for path, size in sorted(files):
        if not out or held + size > most_bytes or len(out[-1].files) >= most_files:
            out.append(Files([]))
            held = 0
        out[-1].files.append((path, size))
        held += size
    return out


class FileReader(DataSourceReader):
    """Lists a folder's files, and reads a partition's one after the other; rows(file, path, size) gives dicts of columns."""

    def __init__(self, schema: StructType, options: dict) -> None:
        self.names, self.root, self.pattern = schema.fieldNames(), options.get("path", ""), options.get("pattern", "*")
        self.most = int(options.get("partbytes", PART_BYTES))
        if not self.root:
            raise ValueError("load() needs a folder")

    def _place(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.root) if "://" in self.root else (fs.LocalFileSystem(), posixpath.abspath(self.root.removeprefix("file:")))

    def partitions(self) -> list[Files]:
        from pyarrow import fs

        system, root = self._place()
        info = system.get_file_info(root)
        listed = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root, recursive=True))
        return dealt([(f.path, f.size) for f in listed if f.type == fs.FileType.File and fnmatch.fnmatchcase(f.base_name, self.pattern)], self.most) or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        system, _ = self._place()
        for path, size in partition.files:
            known = {"path": path, "bytes": size}
            if set(self.names) <= set(known):  # nothing of the file itself is asked for
                yield tuple(known[n] for n in self.names)
                continue
            try:
                with system.open_input_file(path) as f:
                    for row in self.rows(f, path, size):
                        yield tuple({**known, **row}.get(n) for n in self.names)
            except (Refused, OSError) as e:
                yield tuple({**known, "problem": str(e)}.get(n) for n in self.names)

    def rows(self, file, path: str, size: int) -> Iterator[dict]:
        raise NotImplementedError


class WavReader(FileReader):
    def rows(self, file, path: str, size: int) -> Iterator[dict]:
        if "samples" in self.names:
            x, rate, bits = wav_samples(file.read())
            yield {"sample_rate": rate, "channels": x.shape[1], "bits": bits, "frames": x.shape[0], "samples": [list(map(float, ch)) for ch in x.T]}
            return
        try:
            with wave.open(file) as w:
                n, width, rate, channels = w.getnframes(), w.getsampwidth(), w.getframerate(), w.getnchannels()
                begin = file.tell()
        except (wave.Error, EOFError) as e:
            raise Refused(f"no plain WAV: {e}") from e
        if not n or begin + n * width * channels > size:
            raise Refused("empty or truncated")
        if width not in (1, 2, 4):
            raise Refused(f"{8 * width} bits")
        yield {"sample_rate": rate, "channels": channels, "bits": 8 * width, "frames": n}


class OfficeReader(FileReader):
    def rows(self, file, path: str, size: int) -> Iterator[dict]:
        units, warnings = office_units(file.read(), posixpath.splitext(path)[1].lower())
        for i, (where, text) in enumerate(units, 1):
            yield {"unit": i, "locator": where, "text": text}
        for w in warnings:
            yield {"problem": w}


class Wav(DataSource):
    """A row for each file: path, bytes, sample_rate, channels, bits, frames, samples (an array for each channel), problem."""

    @classmethod
    def name(cls) -> str:
        return "corvane_wav"

    def schema(self) -> str:
        return "path string, bytes long, sample_rate int, channels int, bits int, frames long, samples array<array<float>>, problem string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return WavReader(schema, dict(self.options))


class Office(DataSource):
    """A row for each unit of text of .pptx, .docx and .pdf files, and for each warning: path, bytes, unit, locator, text, problem."""

    @classmethod
    def name(cls) -> str:
        return "corvane_office"

    def schema(self) -> str:
        return "path string, bytes long, unit int, locator string, text string, problem string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return OfficeReader(schema, dict(self.options))


def register(spark: SparkSession) -> None:
    for kind in (Wav, Office):
        spark.dataSource.register(kind)
