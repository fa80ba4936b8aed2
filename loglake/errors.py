"""What can go wrong, as exceptions; bad frames are rows with an error_code instead."""

from __future__ import annotations


class LogError(Exception):
    """Of this engine."""


class InvalidState(LogError):
    """The call is not allowed in the log's present state."""


class SeekBelowFloor(LogError):
    """The sequence number sought was removed by retention."""

    def __init__(self, wanted: int, earliest: int):
        super().__init__(f"sequence number {wanted} is gone; the earliest left is {earliest}")
        self.wanted, self.earliest = wanted, earliest


class DrainFailed(LogError):
    """A consumer's sink failed while the log stopped."""

    def __init__(self, consumer: str, cause: BaseException | None = None):
        super().__init__(f"consumer {consumer} did not drain: {cause}")
        self.consumer, self.cause = consumer, cause


class DrainTimeout(DrainFailed):
    """A consumer did not drain in time."""

    def __init__(self, consumer: str, timeout_ms: int):
        super().__init__(consumer)
        self.timeout_ms = timeout_ms
