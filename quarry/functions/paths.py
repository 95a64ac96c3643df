"""Which paths belong to a project."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

SKIPPED = ("node_modules", ".git", "__pycache__", ".venv", "vendor", "build", "dist", ".next")


def ignore_lines(text: str) -> list[str]:
    """Patterns of an ignore file: trimmed lines, without blank ones and comments."""
    return [line for line in map(str.strip, text.splitlines()) if line and not line.startswith("#")]


def glob_regex(pattern: str) -> str:
    """A shell pattern as an anchored regular expression; stars and question marks stop at slashes."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        i += 1
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "\\" and i < len(pattern):
            out += re.escape(pattern[i])
            i += 1
        elif c == "[" and "]" in pattern[i + 1 :]:
            end = pattern.index("]", i + 1)
            body = pattern[i:end]
            flag = "^" if body[:1] == "^" else ""
            body = body[len(flag) :].replace("\\", "\\\\").replace("[", "\\[")
            out += f"[{flag}{body}]"
            i = end + 1
        else:
            out += re.escape(c)
    return f"^{out}$"


def ignore_regex(pattern: str) -> str:
    """What a pattern ignores, of paths relative to the root: a folder, a shell pattern, or a bare word anywhere."""
    if pattern.endswith("/"):
        return f"^{re.escape(pattern.rstrip('/'))}(/.*)?$"
    if not re.search(r"[/*?\[]", pattern):
        return f"(^|/){re.escape(pattern)}(/|$)"
    return glob_regex(pattern)


def ignored(path: str, patterns: Sequence[str]) -> bool:
    return any(re.search(ignore_regex(p), path) for p in patterns)


def skipped_dir(path: str, patterns: Sequence[str]) -> bool:
    """Whether a folder, by its path below the root, is left out; the root itself never is."""
    return path not in ("", ".") and (path.rsplit("/", 1)[-1] in SKIPPED or ignored(path, patterns))


def is_ignored(path: Column, patterns: Sequence[str]) -> Column:
    """ignored(), as an expression."""
    hit = F.lit(False)
    for p in patterns:
        hit = hit | path.rlike(ignore_regex(p))
    return hit


def in_skipped_dir(path: Column) -> Column:
    """Whether a folder above the file is one of the skipped names."""
    parts = F.split(path, "/")
    return F.arrays_overlap(F.slice(parts, F.lit(1), F.size(parts) - 1), F.array(*map(F.lit, SKIPPED)))
