"""Words of whole Arrow batches as numpy arrays: positions and rolling hashes.

Words are runs of bytes other than space and 0x09-0x0D. A hash of bytes s..e is a
polynomial modulo 2^64 over a fixed random value per byte, taken from prefix sums, so that
any span of a batch is hashed in constant time.
"""

import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa

SPACES = b" \t\n\x0b\x0c\r"
# Batches are worked on in pieces of about so many bytes (a longer text is a piece of its own).
PIECE_BYTES = 2_000_000
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACES)] = True
BYTE_VALUE = np.random.Generator(np.random.PCG64(20240229)).integers(
    1, 2**64, 256, dtype=np.uint64, endpoint=False
)
LOWERED_VALUE = BYTE_VALUE.copy()
LOWERED_VALUE[ord("A") : ord("Z") + 1] = BYTE_VALUE[ord("a") : ord("z") + 1]


def give_back() -> None:
    """Returns freed memory to the system. A worker stays for later stages, beside the
    JVM, and would hold what its largest group took."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def tidy(function: Callable[..., pa.Table]) -> Callable[..., pa.Table]:
    """``function`` of one or two tables, after which freed memory is given back."""

    def of_one(rows: pa.Table) -> pa.Table:
        found = function(rows)
        give_back()
        return found

    def of_two(left: pa.Table, right: pa.Table) -> pa.Table:
        found = function(left, right)
        give_back()
        return found

    return of_one if function.__code__.co_argcount == 1 else of_two


def tidy_batches(function: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """The same for a function of batches, after each batch it gives."""

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in function(batches):
            give_back()
            yield batch
        give_back()

    return of_batches


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts, nulls as empty, and the n + 1 offsets."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("").cast(pa.large_string())
    n = len(texts)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, starts, data = texts.buffers()
    offsets = np.frombuffer(starts, np.int64)[texts.offset : texts.offset + n + 1]
    if data is None:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(
    batches: Iterable[pa.RecordBatch], text: str = "text", size: int | None = None
) -> Iterator[pa.RecordBatch]:
    """The batches cut between rows so that a piece holds about ``size`` bytes of text, by
    default PIECE_BYTES."""
    size = size or PIECE_BYTES
    for batch in batches:
        ends = bytes_of(batch.column(text))[1][1:]
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(ends, before + size, "right")))
            yield batch.slice(start, end - start)
            start = end


def _powers(length: int) -> tuple[np.ndarray, np.ndarray]:
    def run(base):
        factors = np.full(length, base, np.uint64)
        factors[0] = 1
        return np.cumprod(factors)

    return run(BASE), run(INVERSE)


# The longest powers so far.
_kept: list[np.ndarray] = []


def powers(length: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse, at least ``length`` of each."""
    if not _kept or length > len(_kept[0]):
        found = _powers(max(1 << 19, 1 << max(0, length - 1).bit_length()))
        if len(found[0]) > 1 << 21:  # for one very long text only: not kept
            return found
        _kept[:] = found
    return _kept[0], _kept[1]


class Spans:
    """Hashes spans [start, end) of ``data``."""

    def __init__(self, data: np.ndarray, values: np.ndarray):
        up, self.down = powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(values[data] * up[: len(data)], out=self.sums[1:])

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self.sums[ends] - self.sums[starts]) * self.down[starts])


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of every word; words never span texts."""
    n = len(data)
    if n == 0:
        return (np.zeros(0, np.int64),) * 3
    inside = ~IS_SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | edge[1:n]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:n]
    starts = np.flatnonzero(starts)
    owner = np.searchsorted(offsets, starts, "right") - 1
    return starts, np.flatnonzero(ends) + 1, owner


def repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys occur more than once, and which are not the first of their kind."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    same = np.zeros(len(keys), bool)
    same[1:] = ordered[1:] == ordered[:-1]
    again = np.zeros(len(keys), bool)
    again[order] = same
    same[:-1] |= same[1:]
    many = np.zeros(len(keys), bool)
    many[order] = same
    return many, again
