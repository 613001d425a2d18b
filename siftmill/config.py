"""Limits of the engine.  An instance is passed to the operators that need one; nothing is read from the environment."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class EngineConfig:
    max_archive_bytes: int = 20 << 20
    max_file_bytes: int = 2 << 20
    max_members: int = 5000
    max_unpacked_bytes: int = 200 << 20
    chunk_lines: int = 200
    overlap_lines: int = 20

    def __post_init__(self):
        if self.chunk_lines <= 0 or not 0 <= self.overlap_lines < self.chunk_lines:
            raise ValueError("chunks need at least one line and an overlap shorter than themselves")


DEFAULT = EngineConfig()
