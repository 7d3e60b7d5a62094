"""Sets of hashed words and shingles, for many texts at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_random = np.random.default_rng(20240)
#: Each byte has a random 64-bit value, a word is a polynomial of them.
_BYTES = _random.integers(1, 2**63, 256, dtype=np.int64).astype(np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
#: Texts are hashed in groups of about so many bytes.
GROUP = 1 << 18


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, GROUP + 4096)
            cls.up = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, _BASE)], dtype=np.uint64)
            cls.down = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, _INVERSE)], dtype=np.uint64)
        return cls.up[:n], cls.down[:n]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts (A-Z as a-z), and where the words of each text end."""
    buffer = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    if not len(buffer):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    space = _SPACE[buffer]
    starts = np.flatnonzero(~space & np.r_[True, space[:-1]])
    ends = np.flatnonzero(space & np.r_[False, ~space[:-1]])
    up, down = _Powers.of(len(buffer))
    sums = np.r_[np.uint64(0), np.cumsum(_BYTES[_LOWER[buffer]] * up, dtype=np.uint64)]
    hashes = mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    limits = np.cumsum([len(t) + 1 for t in texts])
    return hashes, np.searchsorted(starts, limits)


def grouped(texts: list[bytes | None]) -> Iterator[list[bytes]]:
    """Runs of texts of about GROUP bytes; null is empty."""
    run, size = [], 0
    for text in texts:
        run.append(text or b"")
        size += len(run[-1])
        if size >= GROUP:
            yield run
            run, size = [], 0
    if run:
        yield run


def shingle_tables(texts: list[bytes | None], width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For runs of texts: the sorted distinct shingles of each text after the other, and where each text's end.

    A shingle is ``width`` words in a row; a text with fewer words has the whole sequence as its one
    shingle, and without words it has none.
    """
    factors = mixed(np.arange(1, width + 1, dtype=np.uint64)) | np.uint64(1)
    for run in grouped(texts):
        words, ends = word_hashes(run)
        counts = np.diff(ends, prepend=0)
        owner = np.repeat(np.arange(len(run)), counts)
        whole = np.zeros(max(0, len(words) - width + 1), np.uint64)
        for i in range(width):
            whole += words[i : i + len(whole)] * factors[i]
        inside = np.flatnonzero(owner[: len(whole)] == owner[width - 1 :]) if len(whole) else np.zeros(0, np.int64)
        values, owners = [mixed(whole[inside])], [owner[inside]]
        for n in range(1, width):
            short = np.flatnonzero(counts == n)
            first = ends[short] - n
            total = np.full(len(short), n, np.uint64)
            for i in range(n):
                total += words[first + i] * factors[i]
            values.append(mixed(total))
            owners.append(short)
        value, owner = np.concatenate(values), np.concatenate(owners)
        order = np.lexsort((value, owner))
        value, owner = value[order], owner[order]
        new = np.r_[True, (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])] if len(value) else np.zeros(0, bool)
        yield value[new], np.searchsorted(owner[new], np.arange(len(run)), side="right")


def shingle_sets(texts: list[bytes | None], width: int) -> Iterator[np.ndarray]:
    """For each text the sorted hashes of its distinct shingles, see :func:`shingle_tables`."""
    for values, ends in shingle_tables(texts, width):
        start = 0
        for end in ends.tolist():
            yield values[start:end]
            start = end


def set_nodes(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One 64-bit number for each set of a table, equal for equal sets; that of an empty set means nothing."""
    sums = np.r_[np.uint64(0), np.cumsum(mixed(values), dtype=np.uint64)]
    starts = np.r_[0, ends[:-1]]
    return mixed(sums[ends] - sums[starts] + (ends - starts).astype(np.uint64)).view(np.int64)
