"""When a pull consumer's place is written: after so many reads or so long since the last write, looked at on each read."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field


@dataclass
class HeldCursor:
    """A place in memory, and the policy by which it reaches its file."""

    write: Callable[[int, int, int], None]
    records: int
    seconds: float
    clock: Callable[[], float] = time.monotonic
    place: tuple[int, int, int] | None = None
    unwritten: int = 0
    written_at: float = field(default=0.0)

    def __post_init__(self):
        self.written_at = self.clock()

    def advance(self, segment: int, offset: int, seq_no: int, reads: int = 1) -> bool:
        """Moves on by some reads; whether that wrote the file."""
        self.place = (segment, offset, seq_no)
        self.unwritten += reads
        if self.unwritten >= self.records or self.clock() - self.written_at >= self.seconds:
            return self.flush()
        return False

    def flush(self) -> bool:
        """Writes the place if it has moved since it was written."""
        if not self.unwritten or self.place is None:
            return False
        self.write(*self.place)
        self.unwritten, self.written_at = 0, self.clock()
        return True
