"""Words of many texts at once over their UTF-8 bytes: spans and 64-bit hashes with numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
FOLD_TABLE = FOLD.tobytes()
#: Bytes of words: digits, letters, and all of any character beyond ASCII.
TERM = np.zeros(256, bool)
TERM[48:58] = TERM[65:91] = TERM[97:123] = True
TERM[128:] = True
#: Bytes of tokens: everything but ASCII white space.
NONSPACE = np.ones(256, bool)
NONSPACE[[9, 10, 11, 12, 13, 32]] = False

PIECE = 1 << 20
_MULT = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_MULT, -1, 1 << 64)
_VALUES = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """A fixed bijective scrambling of 64-bit values."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h ^= h >> np.uint64(27)
    h = h * np.uint64(0x81DADEF4BC2DD44D)
    h ^= h >> np.uint64(33)
    return h


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, int(n).bit_length())
    if size not in _powers:
        _powers.clear()
        both = []
        for base in (_MULT, _INVERSE):
            table = np.ones(1, np.uint64)
            step = base
            while len(table) < size:
                table = np.concatenate([table, table * np.uint64(step)])
                step = step * step % (1 << 64)
            both.append(table)
        _powers[size] = (both[0], both[1])
    return _powers[size]


def spans(buf: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the longest runs of bytes of a kind."""
    inside = np.zeros(len(buf) + 2, np.int8)
    inside[1:-1] = kind[buf]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def hash_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of byte ranges that depend on their bytes alone, not on their place."""
    up, down = _power_tables(len(buf) + 1)
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_VALUES[buf] * up[: len(buf)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def words(data: bytes, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, starts and ends of all words of one buffer, a piece at a time so that memory follows the pieces."""
    if len(data) <= PIECE:
        buf = np.frombuffer(data, np.uint8)
        s, e = spans(buf, kind)
        return hash_spans(buf, s, e), s, e
    whole = np.frombuffer(data, np.uint8)
    outs, at = [], 0
    while at < len(whole):
        end = min(len(whole), at + PIECE)
        if end < len(whole):
            gaps = np.flatnonzero(~kind[whole[at:end]])
            while not len(gaps) and end < len(whole):  # one word as long as the piece
                end = min(len(whole), end + PIECE)
                gaps = np.flatnonzero(~kind[whole[at:end]])
            if end < len(whole):
                end = at + int(gaps[-1]) + 1
        part = whole[at:end]
        s, e = spans(part, kind)
        outs.append((hash_spans(part, s, e), s + at, e + at))
        at = end
    return tuple(np.concatenate(x) for x in zip(*outs, strict=True))


def fold_texts(texts: list[str | None]) -> list[bytes]:
    """UTF-8 bytes with A-Z lower-cased; null is empty."""
    return [b"" if t is None else t.encode("utf-8", "surrogatepass").translate(FOLD_TABLE) for t in texts]


def folded_slices(column: pa.Array, limit: int) -> Iterator[tuple[int, int, list[bytes]]]:
    """(first, last + 1, folded texts) of a string column, about ``limit`` bytes at a time, so that memory holds no more
    than the batch and one slice. Bytes pass as they are, whether they are UTF-8 or not."""
    raw = column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())
    for lo, hi in groups_by_bytes(pc.fill_null(pc.binary_length(raw), 0).to_pylist(), limit):
        yield lo, hi, [b"" if t is None else t.translate(FOLD_TABLE) for t in raw.slice(lo, hi - lo).to_pylist()]


def words_of(texts: list[bytes], kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]:
    """Words of many texts: hashes, starts, ends, pointers (words of text i: pointers[i] to pointers[i + 1]) and the
    buffer in which the starts and ends lie."""
    data = b"\n".join(texts) + b"\n"
    h, s, e = words(data, kind)
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    return h, s, e, np.searchsorted(s, bounds), data


def groups_by_bytes(sizes: list[int], limit: int = PIECE):
    """Index ranges whose sizes add up to about the limit; a larger one stands alone."""
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)
