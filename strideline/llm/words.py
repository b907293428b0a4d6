"""Hashes of words, word windows and stretches of bytes, of many texts at once.

Words are runs of bytes other than ASCII space, in A-Z lower-cased.  Words of up to 16 bytes are hashed by
mixing their bytes in two steps of eight, which tells all words of up to eight bytes and one length apart; longer ones by
64 bits of a BLAKE2 digest.  Long texts are cut into parts at spaces, so that memory beyond the
hashes doesn't grow with the text.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE, _BACK = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_PLACE = np.random.default_rng(7).integers(1, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: list[np.ndarray] = []
#: Bytes that are cut into words at once.
PART = 1 << 20
_ALL = np.uint64(2**64 - 1)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit hashes."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 20)
        _POWERS[:] = [np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(size - 1, b)))) for b in (_BASE, _BACK)]
    return _POWERS[0], _POWERS[1]


def running(data: np.ndarray) -> np.ndarray:
    """Running sums from which :func:`spans` takes the hash of any stretch of bytes."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * _powers(len(data) + 1)[1][: len(data)], out=out[1:])
    return out


def spans(sums: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hashes of ``data[start:stop]``, the same wherever the bytes stand."""
    return mixed((sums[stop] - sums[start]) * _powers(len(sums))[0][start] + (stop - start).astype(np.uint64))


def _hashes(data: bytes, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hashes of the words ``data[start:stop]``; eight bytes follow the last one."""
    size = stop - start
    lanes = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    short = np.minimum(size, 16).astype(np.uint64)
    kept = lambda n: np.where(n >= 8, _ALL, (np.uint64(1) << (np.minimum(n, 7) * np.uint64(8))) - np.uint64(1))
    second = np.where(short > 8, short - np.uint64(8), np.uint64(0))
    tail = lanes[np.minimum(start + 8, len(lanes) - 1)] & kept(second)
    h = mixed(tail * _PLACE[0] + size.astype(np.uint64))
    h = mixed((h ^ (lanes[start] & kept(short))) * _PLACE[1])
    for i in np.flatnonzero(size > 16):
        h[i] = int.from_bytes(hashlib.blake2b(data[start[i] : stop[i]], digest_size=8).digest(), "little")
    return h


def hashed_words(texts: list[str | None], between: np.ndarray = _SPACE, stem: int | None = None):
    """Word hashes in order, and for each text its bounds in them (one more than texts).

    ``between`` marks the bytes that separate words; an ASCII space is one of them.  With ``stem`` come
    also the hashes of the first so many bytes of each longer word, and the places of these words.
    """
    stems, longer, n_words = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
    parts = [(t or "").encode().lower() for t in texts]
    firsts = np.cumsum([0, *(len(p) + 1 for p in parts)])
    data = b" ".join(parts) if len(parts) != 1 else parts[0]
    del parts
    border = re.compile(b"[" + re.escape(bytes(np.flatnonzero(between).astype(np.uint8))) + b"]")
    hashes, starts, at = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
    while at < len(data):
        cut = border.search(data, at + PART)
        end = len(data) if cut is None else cut.end()
        part = data[at:end] + b"        "
        edge = np.diff(np.concatenate(([True], between[np.frombuffer(part, np.uint8)])).astype(np.int8))
        start, stop = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        hashes.append(_hashes(part, start, stop))
        if stem is not None:
            cut_short = np.flatnonzero(stop - start > stem)
            stems.append(_hashes(part, start[cut_short], start[cut_short] + stem))
            longer.append(cut_short + n_words)
            n_words += len(start)
        starts.append(start + at)
        at = end
    bounds = np.searchsorted(np.concatenate(starts), firsts)
    return (np.concatenate(hashes), bounds) if stem is None else (np.concatenate(hashes), bounds, np.concatenate(stems), np.concatenate(longer))


def windows(words: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``size``-word windows and the number of the text of each.

    A text with fewer words gives one window of all its words, one without words none.
    """
    n = np.diff(bounds)
    text = np.repeat(np.arange(len(n)), n)
    if len(words) >= size:
        last = len(words) - size + 1
        h = sum(words[i : last + i] * _PLACE[i] for i in range(size))
        whole = text[:last] == text[size - 1 :]
        h, text = mixed(h)[whole], text[:last][whole]
    else:
        h, text = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    few = np.flatnonzero((n > 0) & (n < size))
    if len(few):
        tail = [mixed(np.sum(words[bounds[i] : bounds[i + 1]] * _PLACE[: n[i]], keepdims=True) + _PLACE[15 - n[i]]) for i in few]
        h, text = np.concatenate([h, *tail]), np.concatenate([text, few])
        order = np.argsort(text, kind="stable")
        h, text = h[order], text[order]
    return h, text


def slices(texts: list, most_bytes: int = 2_000_000):
    """Ranges of texts with about so many characters each."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "") + 1
        if size >= most_bytes:
            yield first, i + 1
            first, size = i + 1, 0
    if first < len(texts):
        yield first, len(texts)
