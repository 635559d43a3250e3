"""Fill-in-the-middle transformation by bit-parallel big integers.

A text is cut into tokens: a run of blanks with the word behind it, or blanks with
no word behind them. Where its tokens end is one big integer with a bit for each
code point: ``bytes.translate`` writes 1 for a blank and 0 for anything else, the
integer of that is the mask of blanks, and a shift and two boolean operations
leave the bits at which a word is followed by a blank or by nothing. ``bit_count``
says how many tokens there are; the place of the k-th end is found by halving the
integer and going on in the half that holds it.

Null text counts as empty. An empty text, or one that holds a marker, is left
plain, so that a marker in an output is always one of ours. The draws depend on
the seed and the id alone, and repeated rows are answered alike; a null id draws
as the empty string. Further columns are dropped.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from .pretokens import parts

BLANKS = b"\x20\x09\x0a\x0b\x0c\x0d"
#: One digit a code point: 1 for a blank.
_DIGIT = bytes(ord("1") if b in BLANKS else ord("0") for b in range(256))


@dataclass(frozen=True)
class Params:
    seed: int = 42
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    rate: int = 50  #: percent of texts that are cut
    spm: int = 80  #: percent of those that begin with the suffix


def blank_mask(text: str) -> int:
    """Bit i is set if code point i is a blank."""
    # every code point is one byte here: those beyond 255, none of them blank, become "?"
    return int(text.encode("latin-1", "replace").translate(_DIGIT)[::-1] or b"0", 2)


def token_ends(text: str) -> int:
    """Bit i is set if a token ends with code point i."""
    n = len(text)
    if not n:
        return 0
    blank, last = blank_mask(text), 1 << (n - 1)
    return (~blank & (blank >> 1 | last)) & ((1 << n) - 1) | blank & last


def select(bits: int, k: int) -> int:
    """The place of the k-th set bit, counted from 1."""
    at = 0
    width = bits.bit_length()
    while width > 1:
        half = width >> 1
        low = bits & ((1 << half) - 1)
        count = low.bit_count()
        if k <= count:
            bits, width = low, half
        else:
            bits, k, at, width = bits >> half, k - count, at + half, width - half
    return at


def draws(seed: int, doc_id) -> tuple[int, int, int, int]:
    """The first four 32-bit numbers of the SHA-256 of ``seed:id``."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[i : i + 4], "big") for i in range(0, 16, 4))


def cut(text: str, doc_id, p: Params = Params()) -> tuple[int, str, int | None, int | None, str]:
    """(tokens, form, prefix length, middle length, output) of one text; lengths in
    code points."""
    ends = token_ends(text)
    n = ends.bit_count()
    h1, h2, h3, h4 = draws(p.seed, doc_id)
    if not text or h3 % 100 >= p.rate or any(m in text for m in (p.prefix, p.suffix, p.middle)):
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    i, j = (select(ends, k) + 1 if k else 0 for k in (a, b))
    if h4 % 100 < p.spm:
        return n, "spm", i, j - i, "".join((p.suffix, text[j:], p.prefix, text[:i], p.middle, text[i:j]))
    return n, "psm", i, j - i, "".join((p.prefix, text[:i], p.suffix, text[j:], p.middle, text[i:j]))


def restore(output: str, form: str, p: Params = Params()) -> str:
    """The text of an output. No marker ends with what another begins with, so the
    first place of each marker is the one that was put there."""
    if form == "plain":
        return output
    first, second = (p.suffix, p.prefix) if form == "spm" else (p.prefix, p.suffix)
    one, _, rest = output[len(first) :].partition(second)
    two, _, middle = rest.partition(p.middle)
    prefix, suffix = (two, one) if form == "spm" else (one, two)
    return prefix + middle + suffix


def _map(docs: DataFrame, id_col: str, text_col: str, p: Params, more: str, finish) -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars) and what ``finish(output, form)`` gives."""

    def run(batches):
        for b in batches:
            for part in parts(b):
                rows = [cut(t or "", i, p) for i, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist())]
                n, form, prefix, middle, out = zip(*rows)
                last = zip(*(finish(o, f) for o, f in zip(out, form)))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), *(pa.array(x, pa.string()) for x in last)],
                    names=[id_col, "n", "form", "prefix_chars", "middle_chars", *more.split()])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, text_col).mapInArrow(
        run, f"`{id_col}` {kind}, n long, form string, prefix_chars long, middle_chars long, " + ", ".join(f"{c} string" for c in more.split()))


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", p: Params = Params()) -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output) for each row; map side only."""
    return _map(docs, id_col, text_col, p, "output", lambda output, form: (output,))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", p: Params = Params()) -> DataFrame:
    """As ``transform``, with the SHA-256 of the output and of the text that is
    rebuilt from it, in place of the output."""
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return _map(docs, id_col, text_col, p, "output_sha256 restored_sha256", lambda output, form: (sha(output), sha(restore(output, form, p))))
