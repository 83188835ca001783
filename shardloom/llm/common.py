"""Helpers shared by the text operators: Arrow batches and bounded caches; shared storage and bounds of batches are those of the tables."""

from __future__ import annotations

import pyarrow as pa

from ..shared import ARROW_BYTES, bound_batches, marked, materialize, release, release_since, shared_folder  # noqa: F401


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The column's strings, null as the empty string."""
    return [t or "" for t in batch.column(column).to_pylist()]


class TwoGenerationCache:
    """A mapping with bounded memory: when the new generation is full it becomes the old one, and what
    is not looked up again before the next turn goes.

    Both are plain dicts, as set operations with these cost by the set's size and not by the dict's.
    """

    def __init__(self, entries: int = 300_000, key_bytes: int = 32_000_000) -> None:
        self.new: dict = {}
        self.old: dict = {}
        self.entries, self.key_bytes, self.held = entries, key_bytes, 0

    def absent(self, keys: set) -> list:
        """The keys held in neither generation; those in the old one are moved to the new."""
        fresh = keys.difference(self.new)
        out = fresh.difference(self.old)
        again = fresh.difference(out)
        self.new.update(zip(again, map(self.old.__getitem__, again)))
        return list(out)

    @property
    def get(self):
        """Look up a key that is held: valid until the next turn."""
        return self.new.__getitem__

    def put_all(self, keys: list, values: list) -> None:
        self.new.update(zip(keys, values))
        self.held += sum(map(len, keys))

    def put(self, key, value) -> None:
        self.new[key] = value
        self.held += len(key)

    def turn(self) -> None:
        """Call between batches: drop the old generation if the new one is full."""
        if len(self.new) > self.entries or self.held > self.key_bytes:
            self.old, self.new, self.held = self.new, {}, 0
