"""Hashed features of lines, shared by the classifiers of pages."""

from __future__ import annotations

import re

import numpy as np
import xxhash

BITS = 18
SIZE = 1 << BITS

_token = re.compile(r"\w+|[^\w\s]+")
_path = re.compile(r"/[^\s/]+/\S*|/\S{4,}")
_digit = re.compile(r"\d")


def tokens_of(line: str) -> list[str]:
    """Lower-cased words and runs of marks; whatever holds a digit becomes 0, a path becomes /p."""
    if "/" in line:
        line = _path.sub("/p", line)
    return ["0" if _digit.search(t) else t for t in _token.findall(line.lower())]


class LineHasher:
    """Turns lines into feature numbers: words, pairs of words, first and last token, the whole line and its shape."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def _number(self, token: str) -> int:
        h = self.known.get(token)
        if h is None:
            if len(self.known) > 500_000:
                self.known.clear()
            masked = "0" if _digit.search(token) else token
            h = self.known[token] = xxhash.xxh3_64_intdigest(masked.encode("utf-8", "surrogatepass")) >> 1
        return h

    def __call__(self, lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(features, owner): all features of all lines and the line each belongs to."""
        flat: list[int] = []
        sizes = np.empty(len(lines), np.int64)
        shapes = np.empty((len(lines), 3), np.int64)
        known, number, find = self.known, self._number, _token.findall
        for k, line in enumerate(lines):
            if "/" in line:
                line = _path.sub("/p", line)
            own = find(line.lower())
            for t in own:
                h = known.get(t)
                flat.append(number(t) if h is None else h)
            sizes[k] = len(own)
            stripped = line.strip()
            last = stripped[-1:]
            end = 1 if last in ".!?…”»“" and last else 2 if last in ")" and last else 3 if last == ":" else 0
            seps = sum(stripped.count(c) for c in "|·/>")
            shapes[k] = (min(len(stripped).bit_length(), 9) * 16 + end * 2 + (seps > 0), 1000 + min(seps, 4) * 8 + min(len(own) // 4, 7), 2000 + (stripped[:1] in "-»*•–›>") * 4 + stripped.isupper() * 2)
        h = np.array(flat, np.int64)
        owner = np.repeat(np.arange(len(lines)), sizes)
        if not len(h):
            n = np.arange(len(lines))
            return (shapes.ravel() * 7919 % SIZE).astype(np.int64), np.repeat(n, 3)
        starts = np.cumsum(sizes) - sizes
        mixed = _mix(h)
        pair = _mix(h[:-1] * 31 + h[1:] * 1_000_003)[owner[:-1] == owner[1:]]
        filled = sizes > 0
        first = _mix(h[starts[filled]] + 77)
        last = _mix(h[(starts + sizes - 1)[filled]] + 99)
        place = np.arange(len(h)) - np.repeat(starts, sizes)
        whole = _mix(np.add.reduceat(mixed * (place * 2 + 1), starts[filled]))
        n = np.arange(len(lines))
        features = np.concatenate([mixed, pair, first, last, whole, _mix(whole), _mix(shapes.ravel() + (1 << 40))]) & (SIZE - 1)
        owners = np.concatenate([owner, owner[:-1][owner[:-1] == owner[1:]], n[filled], n[filled], n[filled], n[filled], np.repeat(n, 3)])
        return features, owners


def _mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.int64)
    x = (x ^ (x >> 29)) * np.int64(-4658895280553007687)
    x = (x ^ (x >> 32)) * np.int64(-7723592293110705685)
    return (x ^ (x >> 30)) & np.int64(0x7FFFFFFFFFFFFFFF)


def score(weights: np.ndarray, features: np.ndarray, owner: np.ndarray, lines: int) -> tuple[np.ndarray, np.ndarray]:
    """(sum, number of features) by line."""
    return np.bincount(owner, weights[features], lines), np.bincount(owner, minlength=lines)
