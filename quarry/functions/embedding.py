"""Text to vectors by a pluggable provider."""

from __future__ import annotations

import hashlib
import json
import re
import urllib.request
from collections.abc import Callable, Iterator, Sequence
from functools import partial
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.config import first_set


class Provider(Protocol):
    def embed(self, texts: Sequence[str]) -> list[list[float]]: ...


class HashingProvider:
    """Unit vectors of hashed word counts: deterministic, offline."""

    def __init__(self, width: int = 64):
        self.width = width

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = np.zeros(self.width)
            for word in re.findall(r"\w+", text.lower()):
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "big")
                v[h % self.width] += 1.0 if h >> 63 else -1.0
            norm = float(np.linalg.norm(v))
            out.append((v / norm if norm else v).astype(np.float32).tolist())
        return out


class HttpProvider:
    """Vectors from a server with the public embeddings interface: POST {base}/embeddings."""

    def __init__(self, base: str, key: str, model: str, timeout: float = 60.0):
        self.base, self.key, self.model, self.timeout = base.rstrip("/"), key, model, timeout

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        if not texts:
            return []
        body = json.dumps({"model": self.model, "input": list(texts)}).encode()
        request = urllib.request.Request(f"{self.base}/embeddings", body, {"Content-Type": "application/json", "Authorization": f"Bearer {self.key}"})
        with urllib.request.urlopen(request, timeout=self.timeout) as reply:
            found = {d["index"]: d["embedding"] for d in json.load(reply)["data"]}
        if sorted(found) != list(range(len(texts))):
            raise ValueError("the server gave other vectors than were asked for")
        return [found[i] for i in range(len(texts))]


# fixed values: settings, service address and model that the interface's users expect
KEY_SETTINGS = ("OPENAI_API_KEY", "openai_key")
BASE_SETTINGS = ("OPENAI_BASE_URL", "openai_base_url")
MODEL_SETTINGS = ("OPENAI_EMBEDDING_MODEL", "openai_embedding_model")
DEFAULT_BASE = "https://api.openai.com/v1"
DEFAULT_MODEL = "text-embedding-3-small"


def selected() -> tuple[Callable[[], Provider], str]:
    """The provider that the settings ask for, and its model's name; the hashing one if they give no key and no address."""
    key, base, model = first_set(*KEY_SETTINGS), first_set(*BASE_SETTINGS), first_set(*MODEL_SETTINGS) or DEFAULT_MODEL
    if not key and not base:
        return HashingProvider, "hashing-64"
    return partial(HttpProvider, base or DEFAULT_BASE, key, model), model


def embedder(make: Callable[[], Provider] = HashingProvider, batch_size: int = 128) -> Callable[[Column], Column]:
    """A function from a text column to a vector column; the provider is made once per task."""

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        provider = make()
        for part in parts:
            texts = part.fillna("").tolist()
            vectors: list[list[float]] = []
            for i in range(0, len(texts), batch_size):
                got = provider.embed(texts[i : i + batch_size])
                if len(got) != len(texts[i : i + batch_size]):
                    raise ValueError("the provider gave another number of vectors than texts")
                vectors += got
            yield pd.Series(vectors)

    return run


def embed_query(text: str, provider: Provider) -> list[float]:
    got = provider.embed([text])
    if not got:
        raise ValueError("the provider gave no vector")
    return got[0]
