"""Appending records as JSON lines so that a job that dies keeps what it flushed, and the next one goes on from there.

A folder holds data/<job>/<partition>-<attempt>.jsonl, to which each attempt of a task appends and flushes, and log/<job>.json, which names
the files that count and how many bytes of each. An attempt first looks for earlier ones of its partition: it takes over the whole lines
of the last of them up to where they end just then, notes that beside its file, and leaves out the keys they hold. So a task that an
executor's loss interrupted goes on as well, and what a lost attempt still writes after that lies behind its mark and counts nowhere.

A job's log is written at its commit. A job without one has died: the next job writes its log from what it left, one last attempt a
partition, and works on the keys that no log has.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from siftwell.sources.storage import locate, open_file

Marks = list[tuple[str, int]]  # files, relative to the folder, and the bytes of them that count


@dataclass
class _Done(WriterCommitMessage):
    marks: Marks


def _names(store: fs.FileSystem, folder: str) -> list[str]:
    return sorted(f.base_name for f in store.get_file_info(fs.FileSelector(folder, allow_not_found=True)) if not f.base_name.startswith("."))


def _put(store: fs.FileSystem, path: str, value) -> None:
    """A small JSON file, whole or not at all."""
    aside = f"{path.rpartition('/')[0]}/.{uuid.uuid4().hex}"
    with store.open_output_stream(aside) as out:
        out.write(json.dumps(value).encode())
    store.move(aside, path)


def whole_lines(file, size: int, step: int = 1 << 16) -> int:
    """Where the last line break of a file ends; 0 without one."""
    end = size
    while end > 0:
        start = max(0, end - step)
        file.seek(start)
        at = file.read(end - start).rfind(b"\n")
        if at >= 0:
            return start + at + 1
        end = start
    return 0


def lines_of(file, size: int, step: int = 1 << 20) -> Iterator[bytes]:
    """The lines that end within so many bytes."""
    file.seek(0)
    left, rest = size, b""
    while left > 0:
        data = file.read(min(step, left))
        if not data:
            break
        left -= len(data)
        *whole, rest = (rest + data).split(b"\n")
        yield from whole


def _last_attempt(store: fs.FileSystem, base: str, job: str, partition: str) -> Marks:
    """What an earlier attempt of a partition holds by now, with what it took over itself."""
    folder = f"data/{job}"
    names = [n for n in _names(store, f"{base}/{folder}") if n.startswith(f"{partition}-")]
    # an attempt notes what it takes over before it writes, so one without a note has nothing
    noted = [n.removesuffix(".from") for n in names if n.endswith(".from")]
    if not noted:
        return []
    last = max(noted, key=lambda n: int(n.split("-")[1]))
    with store.open_input_file(f"{base}/{folder}/{last}.from") as f:
        marks = [tuple(m) for m in json.loads(f.read())]
    if f"{last}.jsonl" in names:
        with store.open_input_file(f"{base}/{folder}/{last}.jsonl") as f:
            marks.append((f"{folder}/{last}.jsonl", whole_lines(f, f.size())))
    return [m for m in marks if m[1]]


class _Appender(DataSourceWriter):
    def __init__(self, path: str, job: str, key: str, fn: Callable[[dict], str], flush: int):
        self.path, self.job, self.key, self.fn, self.flush = path, job, key, fn, flush

    def write(self, iterator) -> _Done:
        store, base = locate(self.path)
        task = TaskContext.get()
        partition = f"{task.partitionId():05d}"
        marks = _last_attempt(store, base, self.job, partition)
        done = set()
        for name, size in marks:
            with store.open_input_file(f"{base}/{name}") as f:
                done.update(str(json.loads(line)[self.key]) for line in lines_of(f, size))
        stem = f"data/{self.job}/{partition}-{task.taskAttemptId()}"
        _put(store, f"{base}/{stem}.from", marks)
        size = n = 0
        with store.open_output_stream(f"{base}/{stem}.jsonl", buffer_size=1 << 20) as out:
            for row in iterator:
                sample = row.asDict(recursive=True)
                if str(sample[self.key]) in done:
                    continue
                line = self.fn(sample).encode() + b"\n"
                out.write(line)
                size, n = size + len(line), n + 1
                if n % self.flush == 0:
                    out.flush()
        return _Done([*marks, (f"{stem}.jsonl", size)] if size else marks)

    def commit(self, messages) -> None:
        store, base = locate(self.path)
        if f"{self.job}.json" in _names(store, f"{base}/log"):
            raise RuntimeError(f"job {self.job} was taken for dead by another one; what it wrote after that doesn't count")
        _put(store, f"{base}/log/{self.job}.json", [m for x in messages if x for m in x.marks])

    def abort(self, messages) -> None:
        """What was flushed stays, for the next job to take over."""


def _source(fn: Callable[[dict], str]) -> type[DataSource]:
    class Append(DataSource):
        @classmethod
        def name(cls) -> str:
            return "jsonl_append"

        def writer(self, schema, overwrite: bool) -> _Appender:
            return _Appender(self.options["path"], self.options["job"], self.options["key"], fn, int(self.options["flushrows"]))

    return Append


def _logged(store: fs.FileSystem, base: str) -> dict[str, Marks]:
    out = {}
    for name in _names(store, f"{base}/log"):
        with store.open_input_file(f"{base}/log/{name}") as f:
            out[name.removesuffix(".json")] = [tuple(m) for m in json.loads(f.read())]
    return out


def recover(spark: SparkSession, path: str) -> int:
    """Write the logs of jobs that died; their number. No job may be appending just then."""
    store, base = locate(path)
    dead = sorted(set(_names(store, f"{base}/data")) - set(_logged(store, base)))
    if dead:
        store.create_dir(f"{base}/log", recursive=True)
    for job in dead:
        partitions = sorted({n.split("-")[0] for n in _names(store, f"{base}/data/{job}")})

        def run(batches, job=job):
            own, root = locate(path)
            for b in batches:
                marks = [m for p in b.column(0).to_pylist() for m in _last_attempt(own, root, job, p)]
                yield pa.RecordBatch.from_pydict({"file": pa.array([m[0] for m in marks], pa.string()), "bytes": pa.array([m[1] for m in marks], pa.int64())})

        found = spark.createDataFrame([(p,) for p in partitions], "partition string").mapInArrow(run, "file string, bytes long").collect() if partitions else []
        _put(store, f"{base}/log/{job}.json", [tuple(r) for r in found])
    return len(dead)


def read_appended(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The records of all jobs with a log. Files that count whole are read by Spark; those with a mark within them up to it."""
    store, base = locate(path)
    marks = [m for job in _logged(store, base).values() for m in job]
    sizes = {f.path: f.size for f in store.get_file_info([f"{base}/{name}" for name, _ in marks])} if marks else {}
    front = path[: path.index(base)] if base in path else ""
    whole = [f"{front}{base}/{name}" for name, size in marks if sizes[f"{base}/{name}"] == size]
    cut = [(f"{front}{base}/{name}", size) for name, size in marks if sizes[f"{base}/{name}"] != size]
    rows = spark.read.schema(schema).json(whole) if whole else spark.createDataFrame([], schema)
    if not cut:
        return rows

    def run(batches):
        for b in batches:
            for name, size in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                with open_file(name) as file:
                    found = []
                    for line in lines_of(file, size):
                        found.append(line.decode())
                        if len(found) == 1000:
                            yield pa.RecordBatch.from_pydict({"line": found})
                            found = []
                    yield pa.RecordBatch.from_pydict({"line": pa.array(found, pa.string())})

    lines = spark.createDataFrame(cut, "file string, bytes long").repartition(len(cut), "file").mapInArrow(run, "line string")
    return rows.unionByName(lines.select(F.from_json("line", rows.schema).alias("r")).select("r.*"))


def append_jsonl(rows: DataFrame, path: str, key: str, fn: Callable[[dict], dict] | None = None, flush: int = 50, tasks: int | None = None) -> int:
    """Append the records of rows whose keys no record at path has yet; the number of jobs that had died before.

    fn makes a record, which has the key too, of a row; without it rows are records. Lines are flushed every so many rows. One job at a
    time may append to a path. Rows that are few but slow to make should be dealt to so many tasks. Keys are compared as text and have to be unique in rows; a row without a key raises, as it couldn't be
    told from one that is finished.
    """
    spark = rows.sparkSession
    died = recover(spark, path)
    done = read_appended(spark, path, f"`{key}` string").select(F.col(key).alias("_done"))
    left = rows.withColumn(key, F.coalesce(key, F.raise_error(F.lit(f"a row without {key}")).cast(rows.schema[key].dataType)))
    left = left.join(done, F.col(key).cast("string") == F.col("_done"), "left_anti")
    if tasks:
        left = left.repartition(tasks, key)
    if fn is None:
        left = left.select(key, F.to_json(F.struct("*")).alias("line"))
        make = lambda r: r["line"]
    else:
        make = lambda r: json.dumps(fn(r), ensure_ascii=False, default=str)
    job = f"{len(_logged(*locate(path))):06d}-{uuid.uuid4().hex[:12]}"
    store, base = locate(path)
    for folder in (f"data/{job}", "log"):
        store.create_dir(f"{base}/{folder}", recursive=True)
    spark.dataSource.register(_source(make))
    left.write.format("jsonl_append").mode("append").option("path", path).option("job", job).option("key", key).option("flushrows", flush).save()
    return died
