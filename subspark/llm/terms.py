"""Terms of texts: maximal runs of some bytes, in lower case (A-Z alone)."""

from __future__ import annotations

from collections.abc import Iterator

from subspark.llm.common import lowered

#: Bytes of a text that are split at a time.
PIECE = 1 << 20


def byte_table(ascii_kept: str) -> bytes:
    """For bytes.translate: bytes that stand in terms, lowered, and space for all others. Bytes beyond ASCII stand in terms."""
    kept = set(ascii_kept.encode()) | set(range(128, 256))
    return lowered(bytes(b if b in kept else 32 for b in range(256)))


def split(raw: bytes, table: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in order, those of about `PIECE` bytes at a time."""
    clean = raw.translate(table)
    at = 0
    while at < len(clean):
        end = len(clean) if len(clean) - at <= PIECE else clean.find(b" ", at + PIECE)
        end = len(clean) if end < 0 else end
        yield clean[at:end].split()
        at = end
