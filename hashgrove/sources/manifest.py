"""A text sink whose commit is a manifest, and a reader of manifests that opens only those asked for.

Files lie in ``<root>/<shard>/<yyyyMMdd>/``. Tasks write files of names that no other attempt uses and report them; the driver writes
one JSON marker for each folder once all tasks are done. What no marker lists does not count, so a lost executor, a repeated task or a
failed job leaves nothing that a reader takes for data.
"""

from __future__ import annotations

import json
import random
import socket
from collections import defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from datetime import datetime, timezone

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThanOrEqual, In, InputPartition, LessThanOrEqual, WriterCommitMessage

from hashgrove.operators.keyed import place_of
from hashgrove.sources.markers import MARKER_SCHEMA, readable_uri
from hashgrove.sources.sharded import FILES_PER_SHARD
from hashgrove.sources.text import text_lines

MARKER = "_SUCCESS"
FORMAT = "SuccessData/1"
NO_DAY = "00000000"
CODECS = {"gz": "gzip", "zst": "zstd", "txt": None}
MARKERS_PER_TASK = 32
LINES_AT_ONCE = 8_192
PLACED_SCHEMA = T.StructType([T.StructField("shard", T.StringType()), T.StructField("day", T.StringType()), T.StructField("path", T.StringType()), *MARKER_SCHEMA.fields])


def _system(path: str) -> tuple[fs.FileSystem, str]:
    system, name = fs.FileSystem.from_uri(readable_uri(path))
    return system, name.rstrip("/")


# --- writing -------------------------------------------------------------------------------------


@dataclass
class _File:
    shard: str
    day: str
    name: str
    rows: int = 0
    raw: int = 0
    bytes: int = 0


@dataclass
class Written(WriterCommitMessage):
    """What one task has written."""

    files: list[_File] = field(default_factory=list)


class ManifestWriter(DataSourceArrowWriter):
    """Writes lines (shard, day, part, value), sorted by the first three, and commits them by markers."""

    def __init__(self, root: str, codec: str, replace: bool):
        if codec not in CODECS:
            raise ValueError(f"codec {codec}: use one of {', '.join(CODECS)}")
        started = datetime.now(timezone.utc).strftime("%Y%m%d%H%M%S")
        # jobs that start in the same second must not share a name
        self.job = f"{started}_{random.SystemRandom().randrange(10**12):012d}"
        self.root, self.codec, self.replace = root, codec, replace

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = _system(self.root)
        task = TaskContext.get()
        # an attempt's files have their own names; the number counts attempts of all tasks
        attempt = task.taskAttemptId() if task else 0
        done, current, stream = Written(), None, None
        try:
            for batch in iterator:
                columns = [batch.column(k).to_pylist() for k in range(4)]
                first = 0
                for i in range(1, batch.num_rows + 1):
                    if i < batch.num_rows and all(c[i] == c[first] for c in columns[:3]):
                        continue
                    place = tuple(c[first] for c in columns[:3])
                    if place != current:
                        if stream:
                            self._close(system, stream, done.files[-1])
                        current, stream = place, self._open(system, root, place, attempt, done)
                    lines = "".join(f"{'' if v is None else v}\n" for v in columns[3][first:i]).encode()
                    stream.write(lines)
                    done.files[-1].rows += i - first
                    done.files[-1].raw += len(lines)
                    first = i
            if stream:
                self._close(system, stream, done.files[-1])
        except BaseException:
            self._delete(system, [f.name for f in done.files])
            raise
        return done

    def _open(self, system: fs.FileSystem, root: str, place: tuple[str, str, int], attempt: int, done: Written):
        shard, day, part = place
        system.create_dir(f"{root}/{shard}/{day}", recursive=True)
        done.files.append(_File(shard, day, f"{root}/{shard}/{day}/part-r-{part:05d}-job_{self.job}-{attempt}.{self.codec}"))
        return system.open_output_stream(done.files[-1].name, compression=CODECS[self.codec])

    @staticmethod
    def _close(system: fs.FileSystem, stream, file: _File) -> None:
        stream.close()
        file.bytes = system.get_file_info(file.name).size

    @staticmethod
    def _delete(system: fs.FileSystem, names: Sequence[str]) -> None:
        for name in names:
            if system.get_file_info(name).type == fs.FileType.File:
                system.delete_file(name)

    def commit(self, messages: list[Written | None]) -> None:
        """Write the marker of each folder. A folder that has one already is refused before any is written, or replaced whole."""
        system, root = _system(self.root)
        folders = defaultdict(list)
        for message in messages:
            for file in message.files if message else ():
                folders[file.shard, file.day].append(file)
        names = {place: f"{root}/{place[0]}/{place[1]}/{MARKER}" for place in folders}
        there = {place for place, name in names.items() if system.get_file_info(name).type == fs.FileType.File}
        if there and not self.replace:
            raise FileExistsError(f"{len(there)} folders are committed already, {names[min(there)]} among them")
        for place, files in sorted(folders.items()):
            before = self._listed(system, names[place]) if place in there else []
            draft = f"{names[place]}.{self.job}"
            with system.open_output_stream(draft) as stream:
                stream.write(json.dumps(self._document(files), indent=2).encode())
            system.move(draft, names[place])
            self._delete(system, before)

    @staticmethod
    def _listed(system: fs.FileSystem, marker: str) -> list[str]:
        with system.open_input_stream(marker) as stream:
            return json.loads(stream.read())["filenames"]

    def _document(self, files: list[_File]) -> dict:
        now = datetime.now(timezone.utc)
        return {
            "name": FORMAT,
            "timestamp": int(now.timestamp() * 1000),
            "date": now.strftime("%a %b %d %H:%M:%S UTC %Y"),
            "hostname": socket.gethostname(),
            "committer": "manifest",
            "description": f"Task committer attempt_{self.job}_m_000000_0",
            "metrics": {
                "committer_commits_completed": len(files),
                "committer_bytes_committed": sum(f.bytes for f in files),
                "committer_jobs_completed": 1,
                "files_created": len(files),
                "records_written": sum(f.rows for f in files),
                "stream_write_total_data": sum(f.raw for f in files),
            },
            "diagnostics": {"codec": self.codec, "replace": str(self.replace).lower()},
            "filenames": sorted(f.name for f in files),
        }

    def abort(self, messages: list[Written | None]) -> None:
        """Delete what finished tasks have written; no marker names it."""
        system, _ = _system(self.root)
        self._delete(system, [file.name for message in messages if message for file in message.files])


class ManifestSink(DataSource):
    """``df.write.format("manifest")``; the option ``path`` is the root, ``codec`` one of ``CODECS``."""

    @classmethod
    def name(cls) -> str:
        return "manifest"

    def writer(self, schema: T.StructType, overwrite: bool) -> ManifestWriter:
        return ManifestWriter(self.options["path"], self.options.get("codec", "gz"), overwrite)


def write_committed(
    df: DataFrame,
    root: str,
    shard: str,
    day: str,
    files_per_folder: int = FILES_PER_SHARD,
    part: Column | None = None,
    separator: str | None = None,
    codec: str = "gz",
    replace: bool = False,
) -> None:
    """Write one line per row to ``root/<shard>/<yyyyMMdd>/``, and a marker with the list of its files to each folder.

    A line is JSON, or the other fields joined by ``separator``. Rows are dealt to at most ``files_per_folder`` files by a hash of the whole row, or
    by ``part``, whole numbers from 0; each file is written by one task. A row without a day goes to the day ``00000000``, one without a
    shard to the shard ``s``. A folder that has a marker is refused (nothing of the write is committed then), or with ``replace`` gets the new files
    in the place of those that its marker lists.
    """
    df.sparkSession.dataSource.register(ManifestSink)
    fields = df.drop(shard, day)
    place = place_of(df, files_per_folder) if part is None else part
    lines = df.select(
        F.coalesce(F.col(shard).cast("string"), F.lit("s")).alias("shard"),
        F.coalesce(F.date_format(F.col(day), "yyyyMMdd"), F.lit(NO_DAY)).alias("day"),
        place.cast("int").alias("part"),
        text_lines(fields, separator),
    )
    placed = lines.repartition("shard", "day", "part").sortWithinPartitions("shard", "day", "part")
    placed.write.format("manifest").option("path", root).option("codec", codec).mode("overwrite" if replace else "append").save()


# --- reading -------------------------------------------------------------------------------------


@dataclass
class _Folders(InputPartition):
    places: list[tuple[str, str]]


class MarkerReader(DataSourceReader):
    """Plans one partition for every ``MARKERS_PER_TASK`` folders; only markers of folders that the filters leave are opened."""

    def __init__(self, root: str):
        self.root = root
        self.wanted: dict[str, set[str] | None] = {"shard": None, "day": None}
        self.least, self.most = "", None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for one in filters:
            name = getattr(one, "attribute", (None,))
            if len(name) != 1 or name[0] not in self.wanted:
                yield one
                continue
            column = name[0]
            if isinstance(one, (EqualTo, EqualNullSafe)) and isinstance(one.value, str):
                self._only(column, {one.value})
            elif isinstance(one, In):
                self._only(column, {v for v in one.value if isinstance(v, str)})
            elif column == "day" and isinstance(one, GreaterThanOrEqual) and isinstance(one.value, str):
                self.least = max(self.least, one.value)
            elif column == "day" and isinstance(one, LessThanOrEqual) and isinstance(one.value, str):
                self.most = one.value if self.most is None else min(self.most, one.value)
            else:
                yield one

    def _only(self, column: str, values: set[str]) -> None:
        known = self.wanted[column]
        self.wanted[column] = values if known is None else known & values

    def _within(self, day: str) -> bool:
        return self.least <= day and (self.most is None or day <= self.most)

    def places(self) -> list[tuple[str, str]]:
        """Folders that may hold an asked-for marker. Shards and days are listed only where no filter names them, files never."""
        system, root = _system(self.root)

        def below(folder: str) -> list[str]:
            found = system.get_file_info(fs.FileSelector(folder, allow_not_found=True))
            return sorted(f.base_name for f in found if f.type == fs.FileType.Directory)

        shards, days = self.wanted["shard"], self.wanted["day"]
        shards = below(root) if shards is None else sorted(shards)
        return [(shard, day) for shard in shards for day in (below(f"{root}/{shard}") if days is None else sorted(days)) if self._within(day)]

    def partitions(self) -> Sequence[_Folders]:
        places = self.places()
        return [_Folders(places[i : i + MARKERS_PER_TASK]) for i in range(0, len(places), MARKERS_PER_TASK)] or [_Folders([])]

    def read(self, partition: _Folders) -> Iterator[tuple]:
        system, root = _system(self.root)
        for shard, day in partition.places:
            path = f"{root}/{shard}/{day}/{MARKER}"
            if system.get_file_info(path).type != fs.FileType.File:
                continue
            with system.open_input_stream(path) as stream:
                text = stream.read()
            try:
                # a marker of a folder that only says that it is there
                document = json.loads(text) if text.strip() else {}
            except ValueError as error:
                raise ValueError(f"{path} is not a marker document") from error
            yield (shard, day, path, *[document.get(f.name) for f in MARKER_SCHEMA.fields])


class ManifestMarkers(DataSource):
    """``spark.read.format("manifest_markers").load(root)``: a row for each marker, with the shard and day of its folder."""

    @classmethod
    def name(cls) -> str:
        return "manifest_markers"

    def schema(self) -> T.StructType:
        return PLACED_SCHEMA

    def reader(self, schema: T.StructType) -> MarkerReader:
        return MarkerReader(self.options["path"])


def read_manifests(spark: SparkSession, root: str) -> DataFrame:
    """Marker documents below ``root`` with their shard, day and path; an empty marker has nulls.

    Equality, ``in`` and bounds on ``day`` and equality and ``in`` on ``shard`` in a later ``where`` decide which folders are looked at. Sets
    ``spark.sql.python.filterPushdown.enabled`` for the session, which this needs.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ManifestMarkers)
    return spark.read.format("manifest_markers").load(root)


def read_committed(manifests: DataFrame) -> DataFrame:
    """Lines (shard, day, value) of the files that the manifests list, and of no others. A missing file is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, day, name in zip(*[batch.column(k).to_pylist() for k in range(3)], strict=True):
                system, path = _system(name)
                with system.open_input_stream(path, compression=CODECS[name.rpartition(".")[2]]) as stream:
                    held, lines = b"", []
                    while chunk := stream.read(1 << 20):
                        *more, held = (held + chunk).split(b"\n")
                        lines += more
                        while len(lines) >= LINES_AT_ONCE:
                            yield out(shard, day, lines[:LINES_AT_ONCE])
                            lines = lines[LINES_AT_ONCE:]
                    if held:
                        raise ValueError(f"{name} ends within a line")
                    yield out(shard, day, lines)

    def out(shard: str, day: str, lines: list[bytes]) -> pa.RecordBatch:
        n = len(lines)
        return pa.RecordBatch.from_arrays([pa.array([shard] * n, pa.string()), pa.array([day] * n, pa.string()), pa.array(lines, pa.binary()).cast(pa.string())], names=["shard", "day", "value"])

    files = manifests.select("shard", "day", F.explode("filenames").alias("name"))
    return files.repartition("name").mapInArrow(run, "shard string, day string, value string")


