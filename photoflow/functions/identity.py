"""Content identity and artifact keys."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 4 << 20
CHUNK = 1 << 20
#: First line of the text that a fast identity is the hash of. Sizes and times follow it, so policies never collide.
FAST_HEADER = "photoflow-identity-fast-us-v1"


def content_sha256(content: Column) -> Column:
    """Hash of a whole text or binary (IDN1)."""
    return F.sha2(content, 256)


def fast_identity(content: Column, size: Column, modified: Column, window: int = WINDOW, header: str = FAST_HEADER) -> Column:
    """Hash of a text of size, time and the hashes of the first and last ``window`` bytes or characters (IDN2).

    ``modified`` is a timestamp; its microseconds are written as nanoseconds.
    """
    first, last = F.sha2(F.substr(content, F.lit(1), F.lit(window)), 256), F.sha2(F.right(content, F.lit(window)), 256)
    text = F.concat(
        F.lit(f"{header}\nsize:"), size.cast("string"), F.lit("\nmodified_at_ns:"), (F.unix_micros(modified) * 1000).cast("string"),
        F.lit("\nfirst_4m_sha256:"), first, F.lit("\nlast_4m_sha256:"), last, F.lit("\n"),
    )
    return F.sha2(text, 256)


def text_identity(text: Column) -> Column:
    """Hash after all line breaks are LF and the text ends in exactly one (IDN3)."""
    return F.sha2(F.concat(F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), r"\n+\z", ""), F.lit("\n")), 256)


def header_version(text: Column) -> Column:
    """The version named in a first line ``PROMPT_VERSION: x``; null without one (IDN4)."""
    found = F.regexp_extract(text, r"\APROMPT_VERSION:[ \t]*([^\r\n]*?)[ \t]*(?:\r|\n|\z)", 1)
    return F.when(found != "", found)


def artifact_key(sha: Column, recipe: Column, role: Column, ext: Column) -> Column:
    return F.concat(F.concat_ws("-", sha, recipe, role), F.lit("."), ext)  # IDN5


def distinct_artifacts(df: DataFrame, key: str = "artifact_key", path: str = "relative_path") -> DataFrame:
    """One row per key: the least path that has it, and how many do (IDN6)."""
    return df.groupBy(key).agg(F.min(path).alias("first_path"), F.count("*").alias("n_sources"))


def recipe_version(profile: Column) -> Column:
    return F.concat(F.lit("render-v2-"), profile)


def subject_recipe_version(render: Column, margin: Column, merge: Column, matte: Column) -> Column:
    """The render version with crop margin, merge threshold (6 decimals) and matte (IDN7)."""
    six = lambda c: F.format_string("%.6f", c)
    return F.concat_ws("-", render, F.lit("subject-v2"), F.concat(F.lit("margin-"), six(margin)), F.concat(F.lit("merge-"), six(merge)), F.concat(F.lit("matte-"), F.array_join(F.transform(matte, lambda x: x.cast("string")), "-")))


def _hash_files(fast: bool):
    def digest(path: str, size: int, modified_us: int) -> str:
        with open(path, "rb") as f:
            if not fast:
                h = hashlib.sha256()
                while block := f.read(CHUNK):
                    h.update(block)
                return h.hexdigest()
            n = min(WINDOW, size)
            first = hashlib.sha256(f.read(n)).hexdigest()
            f.seek(max(0, size - WINDOW))
            last = hashlib.sha256(f.read(n)).hexdigest()
        return hashlib.sha256(f"{FAST_HEADER}\nsize:{size}\nmodified_at_ns:{modified_us * 1000}\nfirst_4m_sha256:{first}\nlast_4m_sha256:{last}\n".encode()).hexdigest()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, size, us in zip(pdf["path"], pdf["file_size"], pdf["us"], strict=True):
                try:
                    rows.append((path, digest(path, size, us), None))
                except OSError as e:
                    rows.append((path, None, str(e)))
            yield pd.DataFrame(rows, columns=["path", "sha256", "failure"])

    return run


def file_identity(files: DataFrame, policy: str = "sha256") -> DataFrame:
    """``files(path, file_size, modified_at)`` with ``identity`` and ``error``, reading in chunks of CHUNK bytes, or two windows.

    For folders that executors mount. An unreadable file is a recoverable error row; the batch goes on (SRC4).
    """
    src = files.select("path", "file_size", F.unix_micros("modified_at").alias("us"))
    got = src.mapInPandas(_hash_files(policy == "fast"), "path string, sha256 string, failure string")
    fail = F.when(F.col("failure").isNotNull(), F.struct(F.lit("E_FILE_READ").alias("code"), F.lit("scan").alias("stage"), F.col("failure").alias("message"), F.lit(True).alias("recoverable")))
    ident = F.when(F.col("sha256").isNotNull(), F.struct(F.lit(policy).alias("policy"), F.col("sha256").alias("sha256")))
    return files.join(got.select("path", ident.alias("identity"), fail.alias("error")), "path")
