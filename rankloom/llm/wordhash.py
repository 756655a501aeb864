"""Words of UTF-8 text and their 64-bit hashes as numpy arrays, without a Python object per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_ONE, _TWO = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_SHIFT, _EIGHT = np.uint64(33), np.uint64(8)
#: White space of the text contracts, by byte.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, *range(9, 14)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (the finaliser of MurmurHash3), in place."""
    x ^= x >> _SHIFT
    x *= _ONE
    x ^= x >> _SHIFT
    x *= _TWO
    x ^= x >> _SHIFT
    return x


def spans(is_gap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs between gaps."""
    edge = np.diff(np.concatenate([[True], is_gap, [True]]).view(np.int8))
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hash of each span of bytes; eight bytes are folded in at a time."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eights = np.lib.stride_tricks.as_strided(padded[:8].view(np.uint64), (len(data) + 1,), (1,))
    left = ends - starts
    result = mix(left.astype(np.uint64) + np.uint64(seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
    at, active, rest = starts, None, left
    while len(at):
        block = eights[at]
        short = rest < 8
        drop = np.where(short, (8 - rest) * 8, 0).astype(np.uint64)
        block = np.where(rest > 0, (block << drop) >> drop, np.uint64(0))
        if active is None:
            result = mix(result ^ mix(block))
            active = np.flatnonzero(rest > 8)
            at, rest = starts[active] + 8, rest[active] - 8
        else:
            result[active] = mix(result[active] ^ mix(block))
            more = rest > 8
            active, at, rest = active[more], at[more] + 8, rest[more] - 8
    return result


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The texts, each followed by a line feed, as one array, and where each begins (and the end)."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    return data, np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]).astype(np.int64)


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends, words before each text and after the last) of all words of the texts."""
    data, begins = joined(texts)
    starts, ends = spans(IS_SPACE[data])
    return data, starts, ends, np.searchsorted(starts, begins)


def chunks(column: pa.Array, limit: int = 4 << 20) -> Iterator[tuple[int, int, list[bytes]]]:
    """(first row, row after the last, texts) of consecutive texts of about ``limit`` bytes.

    Only one chunk at a time exists as Python objects; a longer text is a chunk of its own.
    """
    column = column.cast(pa.binary())
    size = pc.binary_length(column).to_numpy(zero_copy_only=False)
    begin, held = 0, 0
    for i, n in enumerate(size.tolist()):
        if held and held + n > limit:
            yield begin, i, column.slice(begin, i - begin).to_pylist()
            begin, held = i, 0
        held += n
    if begin < len(size):
        yield begin, len(size), column.slice(begin).to_pylist()
