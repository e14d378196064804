"""Named builders, chosen by type name."""

from __future__ import annotations

from collections.abc import Callable


class Registry:
    """Maps a name to a builder; ``identity`` is always present."""

    def __init__(self, kind: str) -> None:
        self.kind = kind
        self._builders: dict[str, Callable] = {"identity": lambda column: column}

    def register(self, name: str, builder: Callable) -> Callable:
        self._builders[name] = builder
        return builder

    def get(self, name: str) -> Callable:
        if name not in self._builders:
            raise ValueError(f"unknown {self.kind}: {name!r} (known: {', '.join(sorted(self._builders))})")
        return self._builders[name]

    def names(self) -> list[str]:
        return sorted(self._builders)
