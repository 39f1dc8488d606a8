"""Components by category and name: registering, finding, making and configuring them."""

from __future__ import annotations

import importlib
import importlib.metadata
import json
import random
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any, Protocol, runtime_checkable

from pyspark.sql import DataFrame

CATEGORIES = ("loader", "chunker", "embedder", "retriever", "reranker", "generator", "expander", "evaluator", "guardrail")


@runtime_checkable
class Chunker(Protocol):
    """Documents (doc_id, text) to chunks (doc_id, chunk_index, text)."""

    def __call__(self, docs: DataFrame) -> DataFrame: ...


@runtime_checkable
class Embedder(Protocol):
    """Rows with a text to the same rows with an embedding."""

    def __call__(self, texts: DataFrame) -> DataFrame: ...


@runtime_checkable
class Retriever(Protocol):
    """An index that grows, is searched and counted."""

    def add(self, chunks: DataFrame, embed: Callable | None = None) -> Any: ...

    def search(self, queries: DataFrame, k: int = 5) -> DataFrame: ...

    def count(self) -> int: ...


@runtime_checkable
class Expander(Protocol):
    """Queries (qid, text) to variants (qid, variant, text)."""

    def __call__(self, queries: DataFrame) -> DataFrame: ...


@dataclass
class Registry:
    """Factories by category and name. Names are unique in a category; a name is replaced only if asked."""

    factories: dict[str, dict[str, Callable]] = field(default_factory=lambda: {c: {} for c in CATEGORIES})

    def register(self, category: str, name: str, factory: Callable | None = None, replace: bool = False):
        """Registers a factory, or as a decorator the function below it."""
        own = self._of(category)
        if factory is None:
            return lambda f: self.register(category, name, f, replace) or f
        if name in own and not replace:
            raise ValueError(f"{category} {name} is registered already")
        own[name] = factory
        return None

    def remove(self, category: str, name: str) -> bool:
        return self._of(category).pop(name, None) is not None

    def names(self, category: str) -> list[str]:
        return sorted(self._of(category))

    def create(self, category: str, name: str, **options):
        own = self._of(category)
        if name not in own:
            raise KeyError(f"there is no {category} {name}; known: {', '.join(sorted(own)) or 'none'}")
        return own[name](**options)

    def discover(self, group: str) -> int:
        """Registers the entry points of a group, whose names are category.name; the number found."""
        n = 0
        for point in importlib.metadata.entry_points(group=group):
            category, _, name = point.name.partition(".")
            if category in self.factories and name:
                self.register(category, name, point.load(), replace=True)
                n += 1
        return n

    def load_module(self, module: str) -> int:
        """Imports a module and lets its `register(registry)` add to this registry; the number added."""
        before = sum(map(len, self.factories.values()))
        importlib.import_module(module).register(self)
        return sum(map(len, self.factories.values())) - before

    def _of(self, category: str) -> dict[str, Callable]:
        if category not in self.factories:
            raise ValueError(f"there is no category {category}; known: {', '.join(self.factories)}")
        return self.factories[category]


@dataclass
class PipelineConfig:
    """A component tree {category: {name, options}} that builds itself from a registry."""

    components: dict[str, dict[str, Any]]

    @classmethod
    def from_dict(cls, data: dict[str, Any]) -> PipelineConfig:
        out = {}
        for category, value in data.items():
            if category not in CATEGORIES:
                raise ValueError(f"there is no category {category}")
            out[category] = {"name": value, "options": {}} if isinstance(value, str) else {"name": value["name"], "options": dict(value.get("options") or {})}
        return cls(out)

    @classmethod
    def from_yaml(cls, text: str) -> PipelineConfig:
        import yaml

        return cls.from_dict(yaml.safe_load(text) or {})

    @classmethod
    def from_json(cls, text: str) -> PipelineConfig:
        return cls.from_dict(json.loads(text))

    def to_dict(self) -> dict[str, Any]:
        return {c: {"name": v["name"], "options": dict(v["options"])} for c, v in self.components.items()}

    def to_yaml(self) -> str:
        import yaml

        return yaml.safe_dump(self.to_dict(), sort_keys=True)

    def build(self, registry: Registry) -> dict[str, Any]:
        return {c: registry.create(c, v["name"], **v["options"]) for c, v in self.components.items()}


class Retryable(Exception):
    """A failure that may pass, with the status of the reply if there was one."""

    def __init__(self, status: int | None = None, message: str = ""):
        super().__init__(message or f"status {status}")
        self.status = status


def delays(n: int, base: float = 1.0, most: float = 60.0, seed: int | None = None) -> list[float]:
    """Waiting times before the tries after the first: doubled each time, at most `most`, and a quarter more or less."""
    rnd = random.Random(seed)
    return [min(base * 2**k, most) * (0.75 + rnd.random() / 2) for k in range(n)]


def with_retry(call: Callable[[], Any], tries: int = 3, base: float = 1.0, most: float = 60.0, sleep: Callable[[float], None] = time.sleep, seed: int | None = None):
    """What `call` gives; failures with status 429 or 500 and above, or without a status, are tried again."""
    waits = delays(tries - 1, base, most, seed)
    for wait in [*waits, None]:
        try:
            return call()
        except Retryable as e:
            if wait is None or (e.status is not None and e.status != 429 and e.status < 500):
                raise
            sleep(wait)


@dataclass
class Span:
    name: str
    start: float
    end: float = 0.0
    status: str = "ok"
    metadata: dict[str, str] = field(default_factory=dict)

    @property
    def duration_ms(self) -> float:
        return (self.end - self.start) * 1000


class Tracer:
    """Spans around steps on the driver; callbacks get each span when it begins and ends."""

    def __init__(self, callbacks: list | None = None, clock: Callable[[], float] = time.time):
        self.spans: list[Span] = []
        self.callbacks, self.clock = callbacks or [], clock

    def span(self, name: str, **metadata):
        return _Open(self, Span(name, 0.0, metadata={k: str(v) for k, v in metadata.items()}))

    def tell(self, event: str, span: Span) -> None:
        for c in self.callbacks:
            handler = getattr(c, event, None)
            if handler is not None:
                handler(span)

    def table(self, spark) -> DataFrame:
        """(name, start, end, status, metadata) of the spans that have ended."""
        return spark.createDataFrame([(s.name, s.start, s.end, s.status, s.metadata) for s in self.spans], "name string, start double, end double, status string, metadata map<string,string>")


class _Open:
    def __init__(self, tracer: Tracer, span: Span):
        self.tracer, self.span = tracer, span

    def __enter__(self) -> Span:
        self.span.start = self.tracer.clock()
        self.tracer.tell("on_start", self.span)
        return self.span

    def __exit__(self, kind, error, _) -> bool:
        self.span.end = self.tracer.clock()
        if error is not None:
            self.span.status = "error"
            self.span.metadata["error"] = str(error)
        self.tracer.spans.append(self.span)
        self.tracer.tell("on_end", self.span)
        return False
