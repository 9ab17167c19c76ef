"""Mappers and reducers by name."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any


class Registry:
    """Names to classes. Names match exactly; each registry has its own; the last registration of a name wins."""

    def __init__(self, kind: str, default: Callable[[], Any] | None = None):
        self.kind, self.default = kind, default
        self.classes: dict[str, Callable[[], Any]] = {}

    def __call__(self, name: str) -> Callable[[type], type]:
        """A class decorator that registers under ``name``."""

        def register(cls: type) -> type:
            self.classes[name] = cls
            return cls

        return register

    def find(self, name: str) -> Callable[[], Any]:
        """The class of a name, else the default; KeyError if there is neither."""
        found = self.classes.get(name, self.default)
        if found is None:
            raise KeyError(f"no {self.kind} is registered as {name!r}")
        return found

    def create(self, name: str) -> Any:
        return self.find(name)()

    def __contains__(self, name: str) -> bool:
        return name in self.classes


mapper = Registry("mapper")
batch_reducer = Registry("batch reducer")
incremental_reducer = Registry("incremental reducer")


def reducer_class(name: str, incremental: bool) -> Callable[[], Any]:
    return (incremental_reducer if incremental else batch_reducer).find(name)
