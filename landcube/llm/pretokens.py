"""Vocabulary files and the split into pre-tokens, shared by the token operators."""

from __future__ import annotations

import base64
import functools

import numpy as np
import regex


@functools.lru_cache(maxsize=None)
def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


@functools.lru_cache(maxsize=None)
def splitter(pattern: str):
    return regex.compile(pattern).findall


def byte_letters() -> dict[str, int]:
    """The printable letter that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def parts(batch, chars: int = 4 << 20):
    """Slices of a batch of about so many bytes of text, one row at least."""
    size = np.array([len(x.as_py() or "") for x in batch.column(1)], np.int64)
    lo, total = 0, 0
    for i, n in enumerate(size):
        if total and total + n > chars:
            yield batch.slice(lo, i - lo)
            lo, total = i, 0
        total += n
    if lo < batch.num_rows:
        yield batch.slice(lo)
