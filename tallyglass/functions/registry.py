"""Named parts that queries look up, so that a user's own stand beside the built-in ones."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Generic, TypeVar

T = TypeVar("T")


class Registry(Generic[T]):
    """What is registered under a name, in the order of registration. A name stands for one thing; another can't take its place unnoticed."""

    def __init__(self, kind: str):
        self.kind = kind
        self._held: dict[str, T] = {}

    def register(self, name: str, part: T) -> T:
        if name in self._held:
            raise ValueError(f"{self.kind} {name!r} is registered already")
        self._held[name] = part
        return part

    def remove(self, name: str) -> T:
        self[name]
        return self._held.pop(name)

    def __getitem__(self, name: str) -> T:
        if name not in self._held:
            raise KeyError(f"unknown {self.kind} {name!r}; known: {', '.join(self._held)}")
        return self._held[name]

    def __iter__(self) -> Iterator[str]:
        return iter(tuple(self._held))

    def __contains__(self, name: object) -> bool:
        return name in self._held

    def items(self) -> list[tuple[str, T]]:
        return list(self._held.items())
