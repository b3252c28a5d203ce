"""Folder inventory by rounds over a frontier. Spark's own file sources drop names that start with ``_``, as cameras write.

The frontier is a table of folders that nobody has listed and of names that nobody has looked at. A round's tasks list
their folders and look at their names, go on below while they have entries left to spend, and hand back what is left as
the next frontier. So a folder is listed once, by one task that keeps a block of its names at a time; a chain of folders
takes no round for each; and the driver learns only how many rows a frontier has.
"""

from __future__ import annotations

import datetime
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from photoflow.functions import paths as P
from photoflow.sources.shared import written

#: Entries that a row of the frontier may lead a task to look at; names that are handed on together.
ENTRIES, NAMES = 20_000, 2_000

FRONTIER = "folder string, names array<string>"
FOUND = f"{FRONTIER}, path string, file_size bigint, modified_at timestamp, failure string"
_ARROW = pa.schema([("folder", pa.string()), ("names", pa.list_(pa.string())), ("path", pa.string()), ("file_size", pa.int64()), ("modified_at", pa.timestamp("us", "UTC")), ("failure", pa.string())])


def _hidden(name: str) -> bool:
    return name.startswith(".")


def _file(path: str) -> dict | None:
    """A regular file's row, also through a link; a name that can't be read is a failure."""
    try:
        s = os.stat(path)
    except OSError as e:
        return {"path": path, "failure": str(e)} if not os.path.islink(path) else None
    if not os.path.isfile(path):
        return None
    return {"path": path, "file_size": s.st_size, "modified_at": datetime.datetime.fromtimestamp(s.st_mtime, datetime.timezone.utc)}


def _walk(recursive: bool, entries: int, names_each: int):
    def rows(folder: str, names: list[str] | None) -> Iterator[dict]:
        if names is not None:
            yield from filter(None, (_file(os.path.join(folder, n)) for n in names))
            return
        left, spent = [folder], 0
        while left:
            here = left.pop()
            if spent >= entries:
                yield {"folder": here}
                continue
            block: list[str] = []
            try:
                with os.scandir(here) as listed:
                    for e in listed:
                        spent += 1
                        try:
                            e.name.encode()
                        except UnicodeEncodeError:
                            yield {"path": os.fsencode(e.path).decode("utf-8", "replace"), "failure": "the name isn't UTF-8"}
                            continue
                        if e.is_dir(follow_symlinks=False):
                            if recursive and not _hidden(e.name):  # a hidden folder isn't entered
                                if len(left) < names_each:
                                    left.append(e.path)
                                else:
                                    yield {"folder": e.path}
                        elif spent <= entries:
                            yield from filter(None, [_file(e.path)])
                        else:
                            block.append(e.name)
                            if len(block) == names_each:
                                yield {"folder": here, "names": block}
                                block = []
            except OSError as e:
                yield {"path": here, "failure": str(e)}
            if block:
                yield {"folder": here, "names": block}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        for batch in batches:
            for x in batch.to_pylist():
                for row in rows(x["folder"], x["names"]):
                    out.append(row)
                    if len(out) >= 5_000 or row.get("names"):
                        yield pa.RecordBatch.from_pylist(out, _ARROW)
                        out = []
        yield pa.RecordBatch.from_pylist(out, _ARROW)

    return run


def walked(spark: SparkSession, root: str, recursive: bool, entries: int = ENTRIES, names: int = NAMES, parts: int | None = None) -> tuple[DataFrame, int]:
    """Rows of FOUND for files and failures below ``root``, a table for each round, and the number of rounds.

    ``parts`` is how many tasks a round has at most, by default twice the partitions of a shuffle.
    """
    parts = parts or 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    single = os.path.isfile(root)
    frontier = spark.createDataFrame([(os.path.dirname(root) if single else root, [os.path.basename(root)] if single else None)], FRONTIER)
    found, rounds, n = None, 0, 1
    while n:
        out = written(frontier.repartition(min(n, parts)).mapInArrow(_walk(recursive, entries, names), FOUND), "inventory")
        frontier = out.where("folder is not null").select("folder", "names")
        own = out.where("folder is null")
        found = own if found is None else found.union(own)
        rounds, n = rounds + 1, frontier.count()
    return found, rounds


def scan_inventory(spark: SparkSession, root: str, recursive: bool = False) -> tuple[DataFrame, DataFrame]:
    """``(files, errors)`` of a folder, one level or all, or of one file; ignored names are left out (SRC1, SRC2, SRC4).

    The tree is walked when this is called, on a folder that all executors mount, and the rows are read from tables. A
    missing root raises FileNotFoundError before anything runs (SRC3). Folders that can't be listed are error rows; links
    to folders aren't followed, links to files are, and those that lead nowhere are left out. A folder without files
    gives none.
    """
    if not os.path.exists(root):
        raise FileNotFoundError(f"scan root does not exist: {root}")
    root = os.path.abspath(root)
    base = os.path.dirname(root) if os.path.isfile(root) else root
    start = len(base.rstrip("/")) + 2
    raw = walked(spark, root, recursive)[0].withColumn("relative_path", F.when(F.col("path") == base, "").otherwise(F.substr("path", F.lit(start)))).where(~P.is_ignored(F.col("relative_path")))
    files = raw.where("failure is null").select("path", "relative_path", P.file_name(F.col("path")).alias("file_name"), P.extension(F.col("path")).alias("file_extension"), "file_size", "modified_at")
    return files, raw.where("failure is not null").select("path", "relative_path", P.error("E_FILE_READ", "scan", F.col("failure")).alias("error"))
