"""Complete scans of a folder tree by tasks: every regular file by its name, hidden ones included.

Spark's file sources leave out names that start with `_` or `.`. Here tasks list folders and open
files by name: on a mounted path with the standard library, elsewhere with the Arrow file systems.
A listing goes in rounds; each task walks a bounded number of folders and returns the rest, which the
next round deals over all tasks, so neither files nor folders pass through the driver.
"""

import os
import sys
import time
from collections import deque
from urllib.parse import unquote, urlsplit

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from unitloom.session import cut_lineage

# Executors then need no copy of this package on their import path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Folders that a task walks before it returns the rest, rows of a batch, bytes of a batch and of a task.
FOLDERS_PER_TASK = 256
LISTED_ROWS = 10_000
BATCH_BYTES = 8 << 20
TASK_BYTES = 128 << 20
FILES_PER_TASK = 4_096
FOUND = "path string, size long, changed long, is_folder boolean"


class Store:
    """One folder tree, by paths relative to its root with `/` between the parts."""

    def __init__(self, root: str):
        parts = urlsplit(root)
        self.local = parts.scheme in ("", "file")
        if self.local:
            self.base = unquote(parts.path) if parts.scheme else root
        else:
            from pyarrow.fs import FileSystem

            self.system, self.base = FileSystem.from_uri(root)
        self.base = self.base.rstrip("/")

    def entries(self, folder: str):
        """(relative path, size, time of the last change in ms, is folder); links to folders are not followed.

        A folder that is gone has no entries.
        """
        place = f"{self.base}/{folder}" if folder else self.base or "/"
        prefix = f"{folder}/" if folder else ""
        try:
            if self.local:
                with os.scandir(place) as found:
                    for e in found:
                        if e.is_dir(follow_symlinks=False):
                            yield prefix + e.name, 0, 0, True
                        elif e.is_file():
                            s = e.stat()
                            yield prefix + e.name, s.st_size, max(s.st_mtime_ns, s.st_ctime_ns) // 1_000_000, False
                return
            from pyarrow.fs import FileSelector, FileType

            for e in self.system.get_file_info(FileSelector(place)):
                if e.type in (FileType.File, FileType.Directory):
                    yield prefix + e.base_name, e.size or 0, (e.mtime_ns or 0) // 1_000_000, e.type == FileType.Directory
        except FileNotFoundError:
            return

    def content(self, path: str) -> bytes | None:
        """The bytes of a file, None if it is gone."""
        try:
            if self.local:
                with open(f"{self.base}/{path}", "rb") as f:
                    return f.read()
            with self.system.open_input_stream(f"{self.base}/{path}") as f:
                return f.read()
        except FileNotFoundError:
            return None


def wanted(path: str, extensions) -> bool:
    """By the suffix of the name in either case; a leading or trailing dot makes none."""
    name = path.rpartition("/")[2]
    dot = name.rfind(".")
    return dot > 0 and name[dot:].lower() in extensions


def _walk(root, extensions, skipped, budget):
    def run(batches):
        store, rows = Store(root), []
        todo = deque(f for batch in batches for f in batch.column("path").to_pylist())
        for _ in range(budget):
            if not todo:
                break
            for row in store.entries(todo.popleft()):
                path, is_folder = row[0], row[3]
                if is_folder:
                    if path.rpartition("/")[2] not in skipped:
                        todo.append(path)
                elif wanted(path, extensions):
                    rows.append(row)
                if len(rows) >= LISTED_ROWS:
                    yield _listed(rows)
                    rows = []
        yield _listed(rows + [(f, 0, 0, True) for f in todo])

    return run


def _listed(rows):
    columns = zip(*rows) if rows else [()] * 4
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.bool_())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["path", "size", "changed", "is_folder"])


def list_files(
    spark: SparkSession, root: str, extensions: list, skipped: list = (), budget: int = FOLDERS_PER_TASK
) -> DataFrame:
    """(path, size, changed) of every regular file below `root` with one of `extensions`; changed in ms.

    Paths are relative to `root`. Folders named in `skipped` are not entered, links to folders not
    followed. A missing or empty root has no files.
    """
    tasks = spark.sparkContext.defaultParallelism
    frontier, found = spark.createDataFrame([("",)], "path string"), None
    walk = _walk(root, frozenset(extensions), frozenset(skipped), budget)
    n = 1
    while n:
        seen = cut_lineage(frontier.repartition(min(n, 4 * tasks)).mapInArrow(walk, FOUND))
        files = seen.filter("NOT is_folder").drop("is_folder")
        found = files if found is None else found.unionByName(files)
        frontier = seen.filter("is_folder").select("path")
        n = frontier.count()
    return found


def _contents(root):
    def run(batches):
        store = Store(root)
        for batch in batches:
            paths, contents, held = [], [], 0
            for path in batch.column("path").to_pylist():
                content = store.content(path)
                if content is None:
                    continue
                paths.append(path)
                contents.append(content)
                held += len(content)
                if held > BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(contents, pa.binary())], ["path", "source"])
                    paths, contents, held = [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(contents, pa.binary())], ["path", "source"])

    return run


def read_files(files: DataFrame, root: str) -> DataFrame:
    """(path, source) of listed `files` (path, size) below `root`; files that are gone meanwhile are left out.

    The rows are dealt over tasks by number and bytes of the files, before any is opened.
    """
    n, size = files.agg(F.count("*"), F.sum("size")).first()
    cores = files.sparkSession.sparkContext.defaultParallelism
    tasks = max(1, min(n, cores), -(-n // FILES_PER_TASK), -(-(size or 0) // TASK_BYTES))
    return files.select("path").repartition(tasks).mapInArrow(_contents(root), "path string, source binary")


class Folders(InputPartition):
    def __init__(self, folders, start, end):
        self.folders, self.start, self.end = folders, start, end


class ChangedFiles(DataSourceStreamReader):
    """Files by the time of their last change; an offset is the time up to which changes were taken.

    A batch holds the files that changed in [start, end). The driver holds folder names, the tasks list
    the folders and open the files. On a mounted path a moved or copied file counts as changed now; in
    other stores its modification time counts. The clocks of driver and store must agree.
    """

    def __init__(self, options):
        self.root = options["root"]
        self.extensions = frozenset(options["extensions"].split(","))
        self.skipped = frozenset(options.get("skipped", "").split(","))

    def initialOffset(self):
        return {"until": 0}

    def latestOffset(self):
        return {"until": time.time_ns() // 1_000_000}

    def partitions(self, start, end):
        store, folders, todo = Store(self.root), [], [""]
        while todo:
            folder = todo.pop()
            folders.append(folder)
            todo += [path for path, _, _, is_folder in store.entries(folder) if is_folder and path.rpartition("/")[2] not in self.skipped]
        return [Folders(folders[i : i + FOLDERS_PER_TASK], start["until"], end["until"]) for i in range(0, len(folders), FOLDERS_PER_TASK)]

    def read(self, partition):
        store = Store(self.root)
        for folder in partition.folders:
            for path, _, changed, is_folder in store.entries(folder):
                if not is_folder and partition.start <= changed < partition.end and wanted(path, self.extensions):
                    content = store.content(path)
                    if content is not None:
                        yield path, content

    def commit(self, end):
        pass


class RepositoryStream(DataSource):
    """Stream source `unitloom_files`: path (relative to the option root) and source bytes of changed files."""

    @classmethod
    def name(cls):
        return "unitloom_files"

    def schema(self):
        return "path string, source binary"

    def streamReader(self, schema):
        return ChangedFiles(self.options)


def stream_files(spark: SparkSession, root: str, extensions: list, skipped: list = ()) -> DataFrame:
    """A stream of (path, source) of the files below `root`, each time they change."""
    spark.dataSource.register(RepositoryStream)
    reader = spark.readStream.format("unitloom_files").option("root", root)
    return reader.option("extensions", ",".join(extensions)).option("skipped", ",".join(skipped)).load()
