"""What a Python worker remembers of earlier texts, bounded by bytes."""

from __future__ import annotations

#: Bytes of an entry besides the characters of its key and the bytes of its value: the heads of both
#: objects and the place in the table.
ENTRY = 204
#: Longer keys are not remembered.
LONGEST = 256


class Remembered(dict):
    """The latest values by key, and as many from before: of `limit` bytes each at most."""

    def __init__(self, limit: int):
        super().__init__()
        self.limit, self.held = limit, 0
        self.before: dict[str, bytes] = {}

    def keep(self, key: str, value: bytes) -> None:
        length = len(key)
        if length > LONGEST:
            return
        size = (length if key.isascii() else 4 * length) + len(value) + ENTRY
        if self.held + size > self.limit:
            self.before, self.held = dict(self), 0
            self.clear()
        self.held += size
        self[key] = value

    def forget(self) -> None:
        self.clear()
        self.before, self.held = {}, 0
