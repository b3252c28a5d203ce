"""A file per row in a mirrored tree, exactly once (SNK1).

Three jobs, each a table in the shared folder. *Stage*: tasks write each row's file under a name of its own beside the
tree, and the table says which. *Publish*: tasks put each staged file in its place by a hard link, which fails where a file
is; the table has the outcomes. *Clear*: staged files are unlinked. A table holds one attempt of each task, so files of
attempts that were lost are never published; and a link that is there already from an attempt before is told from another
file by its inode, so a task that runs again says what the first one said. Outcomes are read from the table, not worked
out again. The driver sees neither files nor names.
"""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photoflow.sources.shared import drop, written

#: Files of a folder of staged files.
FANOUT = 1000
STAGED = "path string, target string, staged string, problem string"
OUTCOME = "path string, outcome string, error_code string"


@dataclass
class Staged:
    """Rows of STAGED, the files' folder and what their column of paths is named."""

    rows: DataFrame
    folder: str
    column: str


def _place(root: str, path: str | None) -> str | None:
    """Where below ``root`` a relative path leads; None if it is null, empty or leads out of it."""
    if not path or "\0" in path or os.path.isabs(path):
        return None
    out = os.path.normpath(os.path.join(root, path))
    return out if out.startswith(root.rstrip("/") + "/") else None


def _spread(df: DataFrame) -> DataFrame:
    """Rows dealt by path to twice as many tasks as cores: files cost far more than the few bytes by which Spark cuts a table."""
    return df.repartition(2 * df.sparkSession.sparkContext.defaultParallelism, "path")


def stage(df: DataFrame, root: str, path: str = "sidecar_path", text: str = "json") -> Staged:
    """Write each row's text beside the tree, on its file system. Rows without a text or a place below ``root`` have a ``problem``."""
    root = os.path.abspath(root)
    folder = f"{root}/.staged-{uuid.uuid4().hex}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        attempt, n = uuid.uuid4().hex, 0
        for pdf in batches:
            rows = []
            for p, t in zip(pdf["path"], pdf["text"], strict=True):
                target, staged, problem = _place(root, p), None, None
                if target is None or t is None:
                    problem = "no place below the root" if target is None else "no text"
                else:
                    staged = f"{folder}/{attempt}-{n // FANOUT}/{n % FANOUT}"
                    n += 1
                    try:
                        os.makedirs(os.path.dirname(staged), exist_ok=True)
                        with open(staged, "w", encoding="utf-8", newline="") as f:
                            f.write(t)
                            f.flush()
                            os.fsync(f.fileno())
                    except OSError as e:
                        problem = str(e)
                rows.append((p, target, staged, problem))
            yield pd.DataFrame(rows, columns=["path", "target", "staged", "problem"])

    src = df.select(F.col(path).cast("string").alias("path"), F.col(text).cast("string").alias("text"))
    return Staged(written(_spread(src).mapInPandas(run, STAGED), "staged"), folder, path)


def _linked(staged: str, target: str, policy: str) -> tuple[str, str | None]:
    try:
        os.makedirs(os.path.dirname(target), exist_ok=True)
        try:
            os.link(staged, target)
            return "written", None
        except FileExistsError:
            if os.path.samefile(staged, target):  # an attempt before this one did it
                return "written", None
            if policy == "skip":
                return "skipped_existing", None
            if policy == "fail":
                return "failed", "E_SIDECAR_EXISTS"
            new = f"{staged}.{uuid.uuid4().hex}"
            os.link(staged, new)
            os.replace(new, target)
            return "written", None
    except OSError:
        return "failed", "E_WRITE_FAILED"


def publish(staged: Staged, policy: str) -> DataFrame:
    """Put staged files in their places by the policy for files that exist: skip, fail or overwrite.

    Returns OUTCOME as a table: written, skipped_existing or failed, with E_SIDECAR_EXISTS or E_WRITE_FAILED. What exists
    fails under ``fail`` whatever it holds. Run again on the same staged rows, it changes nothing and says the same.
    """
    if policy not in ("skip", "fail", "overwrite"):
        raise ValueError(f"unknown policy: {policy}")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            done = [("failed", "E_WRITE_FAILED") if bad is not None else _linked(s, t, policy) for s, t, bad in zip(pdf["staged"], pdf["target"], pdf["problem"], strict=True)]
            yield pd.DataFrame({"path": pdf["path"], "outcome": [x[0] for x in done], "error_code": [x[1] for x in done]})

    return written(_spread(staged.rows).mapInPandas(run, OUTCOME), "outcomes")


def clear(staged: Staged) -> None:
    """Unlink staged files, in tasks; what attempts that were lost left goes with the folder."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for s in pdf["staged"].dropna():
                if os.path.exists(s):
                    os.unlink(s)
            yield pd.DataFrame({"n": [len(pdf)]})

    _spread(staged.rows).mapInPandas(run, "n long").agg(F.sum("n")).collect()
    shutil.rmtree(staged.folder, ignore_errors=True)
    drop(staged.rows)


def write_documents(df: DataFrame, root: str, policy: str = "skip", path: str = "sidecar_path", text: str = "json") -> DataFrame:
    """Write a file per row below ``root``, a folder that executors share and whose file system has hard links.

    It runs when it is called, and returns ``path, outcome, error_code`` of each row from a table, so any number of
    actions see one outcome. Of rows with one path, the first to be published is the file that the others meet. A null
    text, and a path that is null, absolute or leads out of ``root``, fail; so does one whose place is a folder. Nothing
    is published unless all rows were staged. A table without rows gives none.
    """
    staged = stage(df, root, path, text)
    out = publish(staged, policy)
    clear(staged)
    return out.withColumnRenamed("path", path)
