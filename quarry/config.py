"""Settings from the environment and a JSON file; the file wins where it says something."""

from __future__ import annotations

import json
import os


def first_set(*keys: str) -> str:
    """The first non-empty variable of those named."""
    return next((os.environ[k] for k in keys if k and os.environ.get(k)), "")


def load_file(path: str) -> dict[str, str]:
    """Apply a flat file of settings to the environment; a missing or empty file is none."""
    try:
        with open(path, encoding="utf-8") as f:
            text = f.read()
    except FileNotFoundError:
        return {}
    found = {k: str(v) for k, v in (json.loads(text) if text.strip() else {}).items() if v not in (None, "")}
    os.environ.update(found)
    return found


def state_dir() -> str:
    path = os.path.join(os.path.expanduser("~"), ".quarry")
    os.makedirs(path, exist_ok=True)
    return path
