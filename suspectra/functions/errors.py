"""Generator of human-like typing errors from counts of typos and transpositions. Seeded, with bounded retries."""

from __future__ import annotations

import hashlib
import math
import random
import re
from bisect import bisect_right
from dataclasses import dataclass
from itertools import accumulate

from .numbers import NUMBER

RETRIES = 1_000
#: Texts and places whose tables a model keeps.
KEPT = 100_000


def rng_for(*parts) -> random.Random:
    return random.Random(hashlib.md5(":".join(map(str, parts)).encode()).digest())


@dataclass
class ErrorModel:
    """typos: (intended character or None for the ends, typed string) -> count; moves: delta -> count."""

    typos: dict[tuple[str | None, str], int]
    moves: dict[int, int]

    def __post_init__(self):
        self.by_char: dict[str | None, dict[str, int]] = {}
        for (c, s), n in sorted(self.typos.items(), key=lambda kv: (kv[0][0] or "", kv[0][1])):
            self.by_char.setdefault(c, {})[s] = n
        # Tables to pick from, by character or place and by whether the right choice is left out.
        self.typing = {(c, sure): Choices({s: n for s, n in seen.items() if not (sure and s == (c or ""))}) for c, seen in self.by_char.items() for sure in (False, True)}
        self.moving: dict[tuple[int, int, bool], Choices] = {}
        self.plans: dict[str, tuple] = {}

    def p_typed_right(self, c: str | None) -> float:
        seen = self.by_char.get(c, {})
        total = sum(seen.values())
        return seen.get(c or "", 0) / total if total else 1.0

    def p_stays(self, at: int, length: int) -> float:
        fits = {d: n for d, n in self.moves.items() if -at <= d < length - at}
        total = sum(fits.values())
        return self.moves.get(0, 0) / total if total else 1.0

    def transposed(self, chars: list, sure: int, rng: random.Random) -> list:
        """Each position swaps with one at a sampled distance; ``sure`` must move, if it can."""
        out, n = list(chars), len(chars)
        for i in range(n):
            fits = self.moving.get((i, n, i == sure))
            if fits is None:
                if len(self.moving) >= KEPT:
                    self.moving.clear()
                fits = self.moving[i, n, i == sure] = Choices({d: m for d, m in sorted(self.moves.items()) if -i <= d < n - i and not (i == sure and d == 0)})
            if fits.total:
                j = i + fits.pick(rng)
                out[i], out[j] = out[j], out[i]
        return out

    def typed(self, chars: list, sure: int, rng: random.Random) -> str:
        """What is typed for each character (None: the ends); ``sure`` is mistyped, if it can be."""
        out = []
        for i, c in enumerate(chars):
            seen = self.typing.get((c, i == sure))
            out.append(seen.pick(rng) if seen is not None and seen.total else c or "")
        return "".join(out)

    def _plan(self, text: str) -> tuple:
        """(share of typos, places to mistype, places to move, whether some try can change it) of a text."""
        found = self.plans.get(text)
        if found is None:
            framed = [None, *text, None]
            wrong = {i: 1 - self.p_typed_right(c) for i, c in enumerate(framed)}
            moved = {i: 1 - self.p_stays(i, len(text)) for i in range(len(text))} if len(text) > 1 else {}
            p_typo, p_move = 1 - math.prod(1 - p for p in wrong.values()), 1 - math.prod(1 - p for p in moved.values())
            # Equal characters change places unseen.
            able = any(wrong.values()) or (p_move > 0 and len(set(text)) > 1)
            found = (p_typo / (p_typo + p_move) if p_typo + p_move > 0 else 0.0, Choices(wrong), Choices(moved), able and p_typo + p_move > 0)
            if len(self.plans) >= KEPT:
                self.plans.clear()
            self.plans[text] = found
        return found

    def error(self, text: str, rng: random.Random, retries: int = RETRIES) -> str:
        """A changed string, unless the model can't change it: one sure typo or transposition, the rest as they come."""
        share, wrong, moved, able = self._plan(text)
        if not able:
            return text
        for _ in range(retries):
            typo = rng.random() < share
            where = (wrong if typo else moved).pick(rng)
            out = self.typed([None, *self.transposed(list(text), -1 if typo else where, rng), None], where if typo else -1, rng)
            if out != text:
                return out
        return text

    def subtle_error(self, text: str, rng: random.Random, retries: int = RETRIES) -> str:
        """A changed number whose relative error is below 1; the text itself if none turns up."""
        if not re.match(NUMBER, text.strip()):
            return text
        value = float(text)
        for _ in range(retries):
            out = self.error(text, rng, 1)
            if out != text and re.match(NUMBER, out.strip()) and float(out) != value and math.log10(abs(float(out) - value) / abs(value + 1e-12)) < 0:
                return out
        return text


class Choices:
    """Keys to pick from with probability in proportion to their weights, by the inverse distribution function."""

    __slots__ = ("keys", "last", "total", "upto")

    def __init__(self, weights: dict):
        self.keys, self.total = list(weights), sum(weights.values())
        self.upto = list(accumulate(weights.values(), initial=0.0))[1:]
        self.last = max((k for k, w in weights.items() if w > 0), default=None)

    def pick(self, rng: random.Random):
        at = bisect_right(self.upto, rng.random() * self.total)
        return self.keys[at] if at < len(self.keys) else self.last


def pick(weights: dict, rng: random.Random):
    """A key with probability in proportion to its weight."""
    return Choices(weights).pick(rng)
