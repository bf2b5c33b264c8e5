"""Streaming entry points (the reference has no streaming; J3 applies to a stream unchanged)."""

from widen.streaming.augment import augment_stream  # noqa: F401
