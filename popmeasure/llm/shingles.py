"""Hashes of word windows, many texts at a time.

Words lie between ASCII white space, with A-Z in lower case. A word's hash is a polynomial of its bytes, a window's a
sum of its words' hashes with a factor for each place, both mixed to 64 bits. All of it is array work: no loop over words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .repeats import BASE, _inverse_powers, _mixed, _powers

#: Bytes of text that are handled at a time; a longer text is handled alone, its words in blocks of so many bytes.
LOT = 1 << 20
_RANDOM = np.random.default_rng(7).integers(1, 2**63, 256).astype(np.uint64)
#: A code for each byte, alike for capital and small letters; which bytes part words; a factor for each place in a window.
CODE = _RANDOM[[b + 32 if 65 <= b <= 90 else b for b in range(256)]]
SPACE = np.array([b == 32 or 9 <= b <= 13 for b in range(256)])
PLACE = np.random.default_rng(8).integers(1, 2**62, 64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each word of data (which ends with white space) starts, and its hash."""
    space = np.r_[True, SPACE[data]]
    edges = np.flatnonzero(space[1:] != space[:-1])
    starts, ends = edges[::2], edges[1::2]
    out, first = np.zeros(len(starts), np.uint64), 0
    while first < len(starts):
        last = max(first + 1, int(np.searchsorted(ends, starts[first] + LOT, "right")))
        low, high = int(starts[first]), int(ends[last - 1])
        sums = np.r_[np.uint64(0), np.cumsum(CODE[data[low:high]] * _powers(high - low))]
        a, b = starts[first:last] - low, ends[first:last] - low
        out[first:last] = _mixed((sums[b] - sums[a]) * _inverse_powers(high - low)[a] + (b - a).astype(np.uint64) * np.uint64(BASE))
        first = last
    return starts, out


def window_hashes(texts: list[bytes], size: int) -> list[np.ndarray]:
    """For each text the hashes of its windows of `size` words, repeats included; of all its words if there are fewer."""
    data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    text_ends = np.cumsum([len(t) + 1 for t in texts])
    starts, words = word_hashes(data)
    counts = np.diff(np.r_[0, np.searchsorted(starts, text_ends)])
    windows = np.zeros(max(0, len(words) - size + 1), np.uint64)
    for k in range(size if len(windows) else 0):
        windows += words[k : k + len(windows)] * PLACE[k]
    windows, out, at = _mixed(windows), [], 0
    for n in counts.tolist():
        if n >= size:
            out.append(windows[at : at + n - size + 1])
        else:
            own = words[at : at + n] * PLACE[:n]
            out.append(_mixed(own.sum(dtype=np.uint64, keepdims=True) + np.uint64(n)) if n else own)
        at += n
    return out


def lots(texts: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """Consecutive texts with about LOT bytes, and where they begin. Null counts as empty."""
    begin, own, size = 0, [], 0
    for k, t in enumerate(texts):
        own.append(t.as_buffer().to_pybytes() if t.is_valid else b"")
        size += len(own[-1])
        if size >= LOT:
            yield begin, own
            begin, own, size = k + 1, [], 0
    if own:
        yield begin, own
