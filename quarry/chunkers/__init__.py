"""Source files to function-level rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from quarry.chunkers import ecmascript, golang, python
from quarry.schema import PARSED

#: Language to a function from (path, code bytes) to rows.
CHUNKERS: dict[str, Callable[[str, bytes], list[dict]]] = {
    "go": golang.chunks,
    "python": python.chunks,
    "javascript": lambda path, code: ecmascript.chunks(path, code, typed=False),
    "typescript": lambda path, code: ecmascript.chunks(path, code, typed=True),
}
ENDINGS = {".go": "go", ".py": "python", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".ts": "typescript", ".tsx": "typescript"}


def detect(path: str) -> str:
    """Language by extension in any case, or empty."""
    dot = path.rfind(".")
    return ENDINGS.get(path[dot:].lower(), "") if dot > path.rfind("/") else ""


def chunker(language: str) -> Callable[[str, bytes], list[dict]]:
    """The chunker of a language; a ValueError names an unknown one."""
    if language not in CHUNKERS:
        raise ValueError(f"no chunker for {language!r}")
    return CHUNKERS[language]


def register(language: str, function: Callable[[str, bytes], list[dict]]) -> None:
    CHUNKERS[language] = function


def chunked(files: DataFrame) -> DataFrame:
    """Chunks of files (file_path, language, content); a file that cannot be parsed is one row with its error."""
    known = dict(CHUNKERS)
    names = PARSED.fieldNames()
    kinds = {"start_line": "Int32", "end_line": "Int32", "has_error_return": "boolean"}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, language, code in zip(batch["file_path"], batch["language"], batch["content"], strict=True):
                if language not in known or code is None:
                    continue
                try:
                    rows += [{"file_path": path, "language": language, "error": None} | r for r in known[language](path, bytes(code))]
                except Exception as error:  # one bad file must not stop the others
                    rows.append({"file_path": path, "language": language, "error": f"{type(error).__name__}: {error}"})
            columns = {c: pd.Series([r.get(c) for r in rows], dtype=kinds.get(c, "object")) for c in names}
            yield pd.DataFrame(columns)

    return files.select("file_path", "language", "content").mapInPandas(run, PARSED)
