"""What users plug in: embedders, scorers, extractors, health checks, adapters of agent frameworks."""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import Any, Protocol

import numpy as np


class Embedder(Protocol):
    """What turns texts into vectors of ``dim`` numbers; models plug in here."""

    dim: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


class Scorer(Protocol):
    """What scores how well texts answer a question, each between 0 and 1."""

    def score(self, question: str, texts: list[str]) -> list[float]: ...


class HashingEmbedder:
    """Signed hashed bag of tokens, unit length: deterministic and without a model."""

    def __init__(self, dim: int = 256):
        self.dim = dim

    def embed(self, texts: list[str]) -> np.ndarray:
        import xxhash

        out = np.zeros((len(texts), self.dim))
        for row, t in enumerate(texts):
            for token in re.findall(r"[一-鿿]|[^\W_一-鿿]+", (t or "").lower()):
                h = xxhash.xxh64_intdigest(token)
                out[row, h % self.dim] += 1 if h >> 63 else -1
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norms > 0, norms, 1)


class Registry:
    """Named makers of one kind of part; a part is made once and kept."""

    def __init__(self, kind: str):
        self.kind, self._makers, self._made = kind, {}, {}

    def register(self, name: str, maker: Callable[..., Any]) -> None:
        self._makers[name] = maker
        self._made = {k: v for k, v in self._made.items() if k[0] != name}

    def names(self) -> list[str]:
        return sorted(self._makers)

    def create(self, name: str, **options: Any) -> Any:
        """The part ``name`` with ``options``; ValueError if nothing of that name is registered."""
        if name not in self._makers:
            raise ValueError(f"no {self.kind} named {name!r}; there are {', '.join(self.names())}")
        key = (name, tuple(sorted(options.items())))
        if key not in self._made:
            self._made[key] = self._makers[name](**options)
        return self._made[key]


embedders, scorers, adapters = Registry("embedder"), Registry("scorer"), Registry("adapter")
embedders.register("hashing", HashingEmbedder)


class Overlap:
    """Share of a question's words that a text holds: a scorer without a model."""

    def score(self, question: str, texts: list[str]) -> list[float]:
        split = lambda t: set(re.findall(r"[一-鿿]|[^\W_一-鿿]+", t.lower()))
        asked = split(question)
        return [len(asked & split(t)) / len(asked) if asked else 0.0 for t in texts]


scorers.register("overlap", Overlap)


class HealthChecks:
    """Named checks; each returns whether its part works, and one that raises does not."""

    def __init__(self) -> None:
        self._checks: dict[str, Callable[[], bool]] = {}

    def register(self, name: str, check: Callable[[], bool]) -> None:
        self._checks[name] = check

    def run(self) -> dict[str, str]:
        out = {}
        for name, check in self._checks.items():
            try:
                out[name] = "ok" if check() else "failed"
            except Exception as error:  # noqa: BLE001
                out[name] = f"failed: {error}"
        return out


class Adapter:
    """What agent frameworks call: keep a turn, and read what helps with a question.  ``write`` takes
    a list of (text, domain) rows, ``search`` a question and returns texts."""

    def __init__(self, write: Callable[[list[tuple[str, str]]], None], search: Callable[[str], list[str]]):
        self.write, self.search = write, search

    def save_context(self, said: str, answered: str) -> None:
        self.write([(f"user: {said}", "raw_fact"), (f"assistant: {answered}", "raw_fact")])

    def load(self, question: str) -> str:
        return "\n".join(self.search(question))

    def remember(self, fact: str, domain: str = "raw_fact") -> None:
        self.write([(fact, domain)])

    def recall(self, question: str, limit: int = 5) -> list[str]:
        return self.search(question)[:limit]


adapters.register("plain", Adapter)
