"""The draws of ``portable`` for many messages at once: first 32 bits of MD5 in numpy, equal to hashlib's bit by bit."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

# The sines and rotations of MD5, and its starting state.
K = [int(abs(np.sin(i + 1.0)) * 2**32) for i in range(64)]
TURNS = [t for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for t in four * 4]
PLACES = [*range(16), *((5 * i + 1) % 16 for i in range(16)), *((3 * i + 5) % 16 for i in range(16)), *((7 * i) % 16 for i in range(16))]
START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
#: Messages hashed together: enough that a step costs more than its call, few enough to stay near a core.
TILE = 65_536
FULL = 0xFFFFFFFF


def _block(state: list[np.ndarray], words: list) -> list[np.ndarray]:
    """The state after a block of 16 words, each a number or an array."""
    a, b, c, d = (s.copy() for s in state)
    f, g = np.empty_like(a), np.empty_like(a)
    for i in range(64):
        if i < 16:
            np.bitwise_xor(c, d, out=f)
            np.bitwise_and(f, b, out=f)
            np.bitwise_xor(f, d, out=f)
        elif i < 32:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_and(f, d, out=f)
            np.bitwise_xor(f, c, out=f)
        elif i < 48:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_xor(f, d, out=f)
        else:
            np.invert(d, out=f)
            np.bitwise_or(f, b, out=f)
            np.bitwise_xor(f, c, out=f)
        word = words[PLACES[i]]
        np.add(f, a, out=f)
        if isinstance(word, int):
            np.add(f, np.uint32((K[i] + word) & FULL), out=f)
        else:
            np.add(f, word, out=f)
            np.add(f, np.uint32(K[i]), out=f)
        np.left_shift(f, np.uint32(TURNS[i]), out=g)
        np.right_shift(f, np.uint32(32 - TURNS[i]), out=f)
        np.bitwise_or(f, g, out=f)
        np.add(f, b, out=f)
        a, b, c, d, f = d, f, b, c, a
    return [s + x for s, x in zip(state, (a, b, c, d), strict=True)]


def _digits(numbers: np.ndarray, width: int) -> list[np.ndarray]:
    """The decimal digits of numbers of that width, the highest first, as character codes."""
    return [(numbers // 10**p % 10 + 48).astype(np.uint32) for p in range(width - 1, -1, -1)]


def _by_width(numbers: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(width in digits, places) of numbers from 0."""
    widths = np.ones(len(numbers), dtype=np.int64)
    for p in range(1, 19):
        widths += numbers >= 10**p
    for w in np.unique(widths):
        yield int(w), np.flatnonzero(widths == w)


def hashed(seed: int, keys: list[bytes], of: np.ndarray, boots: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """First 32 bits of the MD5 of ``seed:key:boot:slot``, by boot and cell. of: each cell's place in keys; boots, slots: numbers from 0."""
    out = np.empty((len(boots), len(slots)), dtype=np.uint32)
    lengths = np.array([len(k) for k in keys])[of]
    head = f"{seed}:".encode()
    for size in np.unique(lengths):
        same = np.flatnonzero(lengths == size)
        letters = np.frombuffer(b"".join(k.ljust(size)[:size] for k in keys), dtype=np.uint8).reshape(len(keys), size)
        for wide, places in _by_width(slots[same]):
            cells = same[places]
            for high, rows in _by_width(boots):
                _fill(out, rows, cells, head, letters[of[cells]], _digits(boots[rows], high), _digits(slots[cells], wide))
    return out


def _fill(out: np.ndarray, rows: np.ndarray, cells: np.ndarray, head: bytes, letters: np.ndarray, boot: list[np.ndarray], slot: list[np.ndarray]) -> None:
    """Messages of one length: constant bytes, bytes by cell and bytes by boot are put into words, then hashed by tiles."""
    plan = [*head, *((0, k) for k in range(letters.shape[1])), 58, *((1, x) for x in boot), 58, *((2, x) for x in slot)]
    length = len(plan)
    blocks = (length + 8) // 64 + 1
    plan += [0x80, *[0] * (64 * blocks - length - 9), *(length * 8).to_bytes(8, "little")]
    fixed, by_cell, by_boot = [0] * (16 * blocks), {}, {}
    for at, part in enumerate(plan):
        word, shift = at // 4, 8 * (at % 4)
        if isinstance(part, int):
            fixed[word] |= part << shift
        elif part[0] == 1:
            by_boot[word] = by_boot.get(word, 0) | part[1] << np.uint32(shift)
        else:
            by_cell[word] = by_cell.get(word, 0) | (letters[:, part[1]].astype(np.uint32) if part[0] == 0 else part[1]) << np.uint32(shift)
    across = min(len(cells), TILE)
    down = max(1, TILE // across)
    for r in range(0, len(rows), down):
        for c in range(0, len(cells), across):
            shape = (min(down, len(rows) - r), min(across, len(cells) - c))
            state = [np.full(shape[0] * shape[1], s, dtype=np.uint32) for s in START]
            for block in range(blocks):
                words = []
                for k in range(16 * block, 16 * block + 16):
                    if k not in by_cell and k not in by_boot:
                        words.append(fixed[k])
                        continue
                    word = np.full(shape, fixed[k], dtype=np.uint32)
                    if k in by_cell:
                        word |= by_cell[k][c : c + across]
                    if k in by_boot:
                        word |= by_boot[k][r : r + down, None]
                    words.append(word.ravel())
                state = _block(state, words)
            # MD5 writes its words with the lowest byte first.
            out[np.ix_(rows[r : r + down], cells[c : c + across])] = state[0].byteswap().reshape(shape)


def draws(seed: int, keys: list[bytes], of: np.ndarray, boots: np.ndarray, slots: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The 0-based position that each cell's slot takes in each resample; sizes: cells of each cell's range."""
    return (hashed(seed, keys, of, boots, slots) % sizes.astype(np.uint32)).astype(np.int64)
