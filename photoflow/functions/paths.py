"""Columns over relative paths of an image tree: ignore rules, types, output names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# File types that are read, and which of them are camera RAW.
RAW_TYPES = ["nef", "nrw", "cr3", "cr2", "arw", "raf", "orf", "rw2", "dng"]
IMAGE_TYPES = [*RAW_TYPES, "jpg", "jpeg", "tif", "tiff", "heic", "png"]
DOCUMENT_SUFFIX = ".ai.json"


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def folder(path: Column) -> Column:
    """Without the last component; empty at the root."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def extension(path: Column) -> Column:
    """Behind the last dot of the file name, as spelt; empty without one."""
    return F.regexp_extract(file_name(path), r"\.([^.]*)$", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"\.[^.]*$", "")


def is_ignored(path: Column) -> Column:
    """A component that starts with a dot, or a system, resource-fork, metadata or document file, in any case (FLT1, FLT2)."""
    name = F.lower(file_name(path))
    return F.exists(F.split(path, "/"), lambda p: p.startswith(".")) | (name == ".ds_store") | name.startswith("._") | name.endswith(DOCUMENT_SUFFIX) | name.endswith(".xmp")


def detected_type(ext: Column) -> Column:
    """The type of an extension in any case, or null (FLT3)."""
    return F.when(F.lower(ext).isin(IMAGE_TYPES), F.lower(ext))


def is_raw(kind: Column) -> Column:
    return kind.isin(RAW_TYPES)  # FLT5


def relative_path(path: Column, root: Column | str) -> Column:
    """Below ``root``, or the file name where the path is outside of it (FLT6)."""
    root = F.lit(root) if isinstance(root, str) else root
    base = F.concat(F.rtrim(root, F.lit("/")), F.lit("/"))
    return F.when(F.startswith(path, base), F.substr(path, F.length(base) + 1)).otherwise(file_name(path))


def document_path(path: Column, output_root: str | None = None) -> Column:
    """``<file>.ai.json`` beside the source, or mirrored below ``output_root`` (FLT8)."""
    out = F.concat(path, F.lit(DOCUMENT_SUFFIX))
    return out if output_root is None else F.concat(F.lit(output_root.rstrip("/") + "/"), out)


def export_path(path: Column, role: Column, ext: Column | str, infix: str, output_root: str | None = None) -> Column:
    """``<file>.<infix>.<role>.<ext>``, mirrored below ``output_root`` (FLT9); ``infix`` is what the exchanging tool expects."""
    out = F.concat(path, F.lit(f".{infix}."), role, F.lit("."), F.lit(ext) if isinstance(ext, str) else ext)
    return out if output_root is None else F.concat(F.lit(output_root.rstrip("/") + "/"), out)


def path_order(path: Column) -> list[Column]:
    """Case-folded order, exact spelling breaking ties (FLT7)."""
    return [F.lower(path), path]


def error(code: Column | str, stage: str, message: Column | str, recoverable: bool = True) -> Column:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(lit(code).alias("code"), F.lit(stage).alias("stage"), lit(message).alias("message"), F.lit(recoverable).alias("recoverable"))


def rank_of(c: Column, values: list[str], default: int | None = None) -> Column:
    """Place in an ordered list of strings, from 0."""
    first, *rest = enumerate(values)
    return reduce(lambda w, kv: w.when(c == kv[1], kv[0]), rest, F.when(c == first[1], first[0])).otherwise(F.lit(default))
