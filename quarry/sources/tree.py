"""Source trees as tables.

Spark's own file sources hide names that start with `_` or `.`, so the walk is ours: the driver lists paths, and
executors read and hash the files, in parallel.
"""

from __future__ import annotations

import hashlib
import os
import posixpath
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.paths import ignore_lines, ignored, skipped_dir
from quarry.functions.text import LANGUAGES
from quarry.schema import MANIFEST

IGNORE_FILE = ".gitignore"


def project_root(path: str | None) -> str:
    """Absolute, cleaned; blank stands for the working folder."""
    return os.path.abspath((path or "").strip() or ".")


def project_id(path: str | None) -> str:
    return hashlib.sha256(project_root(path).encode()).hexdigest()


def normal_path(path: str) -> str:
    """Absolute and cleaned, with slashes; blank stays blank."""
    path = path.strip()
    return posixpath.normpath(os.path.abspath(path).replace(os.sep, "/")) if path else ""


def canonical_keys(hashes: dict[str, str], root: str) -> dict[str, str]:
    """A snapshot keyed by absolute paths, without blank keys; the last of equals wins."""
    found = ((k.strip(), v) for k, v in hashes.items())
    return {normal_path(k if os.path.isabs(k) else os.path.join(root, k)): v for k, v in found if k}


def ignore_patterns(root: str) -> list[str]:
    try:
        with open(os.path.join(root, IGNORE_FILE), encoding="utf-8", errors="replace") as f:
            return ignore_lines(f.read())
    except FileNotFoundError:
        return []


def source_paths(root: str) -> list[str]:
    """Source files below root in lexical order; an unreadable folder raises."""
    patterns, found = ignore_patterns(root), []

    def fail(error: OSError) -> None:
        raise error

    for folder, dirs, files in os.walk(root, onerror=fail):
        below = os.path.relpath(folder, root).replace(os.sep, "/")
        inner = lambda name: name if below == "." else f"{below}/{name}"  # noqa: B023, E731
        dirs[:] = sorted(d for d in dirs if not skipped_dir(inner(d), patterns))
        found += [os.path.join(folder, f) for f in files if os.path.splitext(f)[1] in LANGUAGES and not ignored(inner(f), patterns)]
    return sorted(found)


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """file_path, rel_path, language, file_hash, content, error of every source file; an unreadable one has its error."""
    base = project_root(root)
    rows = [(p.replace(os.sep, "/"), os.path.relpath(p, base).replace(os.sep, "/"), LANGUAGES[os.path.splitext(p)[1]]) for p in source_paths(base)]
    listed = spark.createDataFrame(rows, "file_path string, rel_path string, language string")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            codes, errors = [], []
            for path in batch["file_path"]:
                try:
                    with open(path, "rb") as f:
                        codes.append(f.read())
                    errors.append(None)
                except OSError as error:
                    codes.append(None)
                    errors.append(str(error))
            hashes = [None if c is None else hashlib.sha256(c).hexdigest() for c in codes]
            yield batch.assign(file_hash=hashes, content=codes, error=errors)

    return listed.repartition(max(1, len(rows) // 64)).mapInPandas(read, MANIFEST)


def from_binary_files(files: DataFrame, root: str) -> DataFrame:
    """The manifest of files on a distributed store, from Spark's binaryFile columns path and content."""
    path = F.regexp_replace("path", "^file:/+", "/")
    base = root.rstrip("/") + "/"
    ending = F.regexp_extract("path", r"(\.[^./]*)$", 1)
    language = F.coalesce(*[F.when(ending == e, F.lit(x)) for e, x in LANGUAGES.items()])
    out = files.select(
        path.alias("file_path"), F.regexp_replace(path, f"^{base}", "").alias("rel_path"), language.alias("language"), F.sha2("content", 256).alias("file_hash"), "content", F.lit(None).cast("string").alias("error")
    )
    return out.where("language is not null")
