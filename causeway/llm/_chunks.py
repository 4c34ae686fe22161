"""Content-defined chunking with a gear rolling hash, over whole byte arrays at once.

The gear hash of a place is the sum of table[byte] << age over the last 32 bytes, older ones
having been shifted out, so that a boundary depends on 32 bytes of content and on nothing else.
"""

from __future__ import annotations

import numpy as np

#: Bytes that the hash of a place depends on.
WINDOW = 32

_GEAR = np.random.default_rng(7).integers(0, 2**32, 256, dtype=np.uint32)


def gear(data: np.ndarray) -> np.ndarray:
    """The rolling hash at each byte, by doubling the window."""
    h = _GEAR[data]
    for shift in (1, 2, 4, 8, 16):
        older = h[:-shift] << np.uint32(shift)
        h = h.copy()
        h[shift:] += older
    return h


def mask_cuts(data: np.ndarray, offsets: np.ndarray, mean: int, least: int, most: int) -> np.ndarray:
    """Ends of chunks of about `mean` bytes, from `least` to `most` unless a row ends sooner.

    A boundary is a place whose hash lies below 2**32 / mean, after its row's first WINDOW bytes.
    Each row is cut by its own bytes alone, so that equal texts are cut alike.
    """
    hit = np.flatnonzero(gear(data) < np.uint32(2**32 // mean)) + 1
    cuts = []
    lo = np.searchsorted(hit, offsets[:-1] + WINDOW)
    hi = np.searchsorted(hit, offsets[1:])
    for row in range(len(offsets) - 1):
        at, end = int(offsets[row]), int(offsets[row + 1])
        for cut in hit[lo[row] : hi[row]].tolist():
            while cut - at > most:
                at += most
                cuts.append(at)
            if cut - at >= least:
                at = cut
                cuts.append(at)
        while end - at > most:
            at += most
            cuts.append(at)
        if end > at:
            cuts.append(end)
    return np.array(cuts, np.int64)


def peak_cuts(data: np.ndarray, offsets: np.ndarray, reach: int) -> np.ndarray:
    """Ends of chunks at the places whose hash exceeds that of `reach` places on either side.

    Chunks are longer than `reach` and about 2 * reach + 1 bytes on average. Whether a place is
    a boundary depends on the WINDOW + reach bytes before and the reach bytes after it only, so
    that a passage is cut alike wherever it stands. Rows are cut at their ends too.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    h = gear(data).astype(np.int64)
    row_start = np.repeat(offsets[:-1], np.diff(offsets))
    row_end = np.repeat(offsets[1:], np.diff(offsets))
    place = np.arange(n)
    h[place - row_start < WINDOW - 1] = -1

    def running_max(x: np.ndarray, width: int) -> np.ndarray:
        """The largest of x[i : i + width], with -1 beyond the end."""
        out, have = x, 1
        while have < width:
            step = min(have, width - have)
            ahead = np.full(n, -1)
            ahead[: max(0, n - step)] = out[step:]
            out = np.maximum(out, ahead)
            have += step
        return out

    after = np.concatenate([running_max(h, reach)[1:], [-1]])
    before = running_max(h[::-1], reach)[::-1]
    before = np.concatenate([[-1], before[:-1]])
    inner = (place - row_start >= WINDOW - 1 + reach) & (row_end - place > reach)
    peak = np.flatnonzero(inner & (h > after) & (h >= before)) + 1
    return np.union1d(peak, offsets[1:][np.diff(offsets) > 0])
