"""SHA-256 of many short keys side by side, a numpy operation for each step.

A key is a head and a tail. What hashing the last block takes from its text
alone is made once for all heads that end alike, as those of a name's days do.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np

#: Columns of a chunk: so many that numpy's calls cost little. Under the least, hashing key by key is faster.
COLUMNS, LEAST = 16_384, 4096
#: The longest text that fits a block with its end and length.
ROOM = 55

_MASK = 0xFFFFFFFF
_PRIMES = [p for p in range(2, 312) if all(p % q for q in range(2, p))]


def _cube_root(n: int) -> int:
    x = round(n ** (1 / 3)) + 1
    while x**3 > n:
        x -= 1
    return x


# Fixed values of the standard: the first 32 fractional bits of square and cube roots of primes.
_START = [math.isqrt(p << 64) & _MASK for p in _PRIMES[:8]]
_ROUND = [_cube_root(p << 96) & _MASK for p in _PRIMES]
#: Arrays of no dimension: numpy takes them faster than its scalars.
_BY = [np.array(n, np.uint32) for n in range(32)]
_right, _left, _xor, _and, _add = np.right_shift, np.left_shift, np.bitwise_xor, np.bitwise_and, np.add

Word = int | np.ndarray


def _rotations(x: np.ndarray, a: int, b: int, c: int, out: np.ndarray, t: np.ndarray) -> None:
    """``x`` turned right by a, b and c (ascending), the three xored: shifts to
    the right one on top of the other, then those to the left."""
    _right(x, _BY[c - b], out)
    _xor(out, x, out)
    _right(out, _BY[b - a], out)
    _xor(out, x, out)
    _right(out, _BY[a], out)
    _left(x, _BY[b - a], t)
    _xor(t, x, t)
    _left(t, _BY[c - b], t)
    _xor(t, x, t)
    _left(t, _BY[32 - c], t)
    _xor(out, t, out)


def _spread(x: Word, a: int, b: int, s: int) -> Word:
    """``x`` turned right by a and b and shifted by s (s < a < b), xored."""
    if isinstance(x, int):
        return (x >> a ^ x << 32 - a ^ x >> b ^ x << 32 - b ^ x >> s) & _MASK
    out, t = _right(x, _BY[b - a]), _left(x, _BY[b - a])
    _xor(out, x, out)
    _right(out, _BY[a - s], out)
    _xor(out, x, out)
    _right(out, _BY[s], out)
    _xor(t, x, t)
    _left(t, _BY[32 - b], t)
    _xor(out, t, out)
    return out


def _sum(*words: Word) -> Word:
    """The sum of some words; numbers are added up first."""
    number, out = sum(x for x in words if isinstance(x, int)) & _MASK, None
    for x in (*(x for x in words if not isinstance(x, int)), *([np.array(number, np.uint32)] if number else [])):
        out = x if out is None else out + x
    return number if out is None or out.ndim == 0 else out


def _schedule(words: Sequence[Word]) -> list[np.ndarray]:
    """What each round adds, from a block's words."""
    w = list(words)
    for i in range(16, 64):
        w.append(_sum(w[i - 16], _spread(w[i - 15], 7, 18, 3), w[i - 7], _spread(w[i - 2], 17, 19, 10)))
    return [np.asarray(_sum(x, k), np.uint32) for x, k in zip(w, _ROUND, strict=True)]


def _rounds(state: np.ndarray, added: Sequence[np.ndarray]) -> list[np.ndarray]:
    """The state after a block, a row for each of the eight words."""
    a, b, c, d, e, f, g, h = state.copy()
    u, t, ab, bc = np.empty_like(a), np.empty_like(a), np.empty_like(a), b ^ c
    for w in added:
        _add(h, w, h)
        _rotations(e, 6, 11, 25, u, t)
        _add(h, u, h)
        _xor(f, g, u)
        _and(u, e, u)
        _xor(u, g, u)
        _add(h, u, h)
        _add(d, h, d)
        _rotations(a, 2, 13, 22, u, t)
        _add(h, u, h)
        # The majority of a, b and c; what a and b differ in is what b and c do in the next round.
        _xor(a, b, ab)
        _and(bc, ab, bc)
        _xor(bc, b, bc)
        _add(h, bc, h)
        ab, bc = bc, ab
        a, b, c, d, e, f, g, h = h, a, b, c, d, e, f, g
    return [x + y for x, y in zip(state, (a, b, c, d, e, f, g, h), strict=True)]


def _words(blocks: bytes) -> np.ndarray:
    """A row for each of the sixteen words of blocks."""
    return np.ascontiguousarray(np.frombuffer(blocks, ">u4").reshape(-1, 16).T.astype(np.uint32))


def _after(heads: Sequence[bytes], full: int) -> np.ndarray:
    """The states after the first ``full`` blocks of each head."""
    state = np.repeat(np.array(_START, np.uint32)[:, None], len(heads), axis=1)
    for k in range(full):
        for lo in range(0, len(heads), COLUMNS):
            some = slice(lo, lo + COLUMNS)
            state[:, some] = _rounds(state[:, some], _schedule(_words(b"".join(x[64 * k : 64 * k + 64] for x in heads[some]))))
    return state


def first_words(heads: Sequence[bytes], tails: Sequence[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers of heads, and the first word of the digest of each with each tail,
    a row a head. Heads that would be slower here than one by one are left out."""
    ends, longest = [x + b"\x80" for x in tails], max(map(len, tails), default=0)
    by_blocks: dict[int, list[int]] = {}
    for i, x in enumerate(heads):
        if len(x) % 64 + longest <= ROOM:
            by_blocks.setdefault(len(x) // 64, []).append(i)
    for full, numbers in by_blocks.items():
        if len(numbers) * len(tails) < LEAST:
            continue
        states = np.empty((8, len(heads)), np.uint32)
        states[:, numbers] = _after([heads[i] for i in numbers], full)
        alike: dict[bytes, list[int]] = {}
        for i in numbers:
            alike.setdefault(heads[i][64 * full :], []).append(i)
        # As many heads to a column as all endings have, some of them several times over.
        deep = math.gcd(*map(len, alike.values()))
        deep = deep if len(numbers) // deep * len(tails) >= LEAST else 1
        layers = np.array([x[lo : lo + deep] for x in alike.values() for lo in range(0, len(x), deep)]).T
        rests = [heads[i][64 * full :] for i in layers[0].tolist()]
        at_once = -(-len(rests) // -(-len(rests) * len(tails) // COLUMNS))
        for lo in range(0, len(rests), at_once):
            some = rests[lo : lo + at_once]
            block = _words(b"".join([(x + end).ljust(64, b"\0") for x in some for end in ends]))
            block[15] = (8 * (64 * full + np.array([len(x) for x in some])[:, None] + np.array([len(x) for x in tails])[None])).ravel()
            added = _schedule([int(w[0]) if (w == w[0]).all() else w for w in block])
            for layer in layers[:, lo : lo + at_once]:
                state = np.repeat(states[:, layer], len(tails), axis=1)
                yield layer, _rounds(state, added)[0].reshape(len(some), len(tails))
