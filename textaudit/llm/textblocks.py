"""Shingle hashing over blocks of texts with numpy: whole UTF-8 texts in, 64-bit hashes out.

Words are maximal runs of ASCII letters and digits or of any other non-ASCII characters, lower-cased. The hash of a word
or of k bytes or characters is a polynomial in them modulo 2**64, mixed afterwards; equal content always has equal
hashes, and different content collides with a chance of about 2**-64.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
BASE = U(0x9E3779B97F4A7C15)
BASE_INVERSE = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: A block ends when it holds so many bytes, so memory is bounded by this or by one text.
BLOCK_BYTES = 1 << 20
SHINGLE = 5

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_powers: dict[str, np.ndarray] = {"up": np.ones(1, U), "down": np.ones(1, U)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i < n at least."""
    if len(_powers["up"]) < n:
        size = 1 << (n - 1).bit_length()
        for name, base in (("up", BASE), ("down", BASE_INVERSE)):
            table = np.full(size, base, U)
            table[0] = 1
            _powers[name] = np.multiply.accumulate(table)
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose bits all depend on all bits of x (the splitmix64 finaliser)."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def blocks(texts: list[str], most: int = BLOCK_BYTES, lower: bool = True):
    """Slices of texts (encoded, lower-cased unless told not to; None is empty) of about `most` bytes: (first index, list of bytes)."""
    first, got, size = 0, [], 0
    for i, t in enumerate(texts):
        b = b"" if t is None else (t.lower() if lower else t).encode("utf-8", "replace")
        got.append(b)
        size += len(b) + 1
        if size >= most:
            yield first, got
            first, got, size = i + 1, [], 0
    if got:
        yield first, got


def slices(texts: list[str], most: int = BLOCK_BYTES // 4):
    """Slices of texts of about `most` characters: (first index, texts)."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t) + 1
        if size >= most:
            yield first, texts[first : i + 1]
            first, size = i + 1, 0
    if first < len(texts):
        yield first, texts[first:]


def spans(block: list[bytes], kind: np.ndarray = _WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of the block, starts and ends of the maximal runs of bytes of a kind, number of runs of each text)."""
    data = np.frombuffer(b" ".join(block) + b" ", np.uint8)
    word = kind[data]
    edge = np.flatnonzero(word[1:] != word[:-1]) + 1
    if len(word) and word[0]:
        edge = np.concatenate(([0], edge))
    starts, ends = edge[0::2], edge[1::2]  # the block ends with a space
    limits = np.cumsum([len(b) + 1 for b in block])
    return data, starts, ends, np.diff(np.searchsorted(starts, limits), prepend=0)


def word_hashes(block: list[bytes], kind: np.ndarray = _WORD) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word of the block in order, number of words of each text)."""
    data, starts, ends, counts = spans(block, kind)
    up, down = powers(len(data) + 1)
    total = np.empty(len(data) + 1, U)
    total[0] = 0
    np.cumsum((data.astype(U) + U(1)) * up[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U)), counts


def shingle_hashes(words: np.ndarray, counts: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every run of k words within one text, number of runs of each text); shorter texts: one run of all words."""
    runs = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    text_first = np.cumsum(counts) - counts
    run_first = np.cumsum(runs) - runs
    at = np.arange(runs.sum()) - np.repeat(run_first - text_first, runs)
    length = np.repeat(np.minimum(counts, k), runs)
    out = np.zeros(len(at), U)
    padded = np.concatenate((words, np.zeros(k, U)))
    for j in range(k):
        here = j < length
        out = np.where(here, (out + padded[at + j]) * BASE, out)
    return mix(out + length.astype(U)), runs


def byte_grams(block: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every k bytes within one text, their number by text); shorter texts that aren't empty: one of all bytes."""
    return _grams(np.frombuffer(b"".join(block) + b"\0" * k, np.uint8), np.array([len(b) for b in block], np.int64), k)


def char_grams(block: list[str], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Like byte_grams, of code points."""
    return _grams(np.frombuffer(("".join(block) + "\0" * k).encode("utf-32-le", "replace"), "<u4"), np.array([len(t) for t in block], np.int64), k)


def _rolled(data: np.ndarray, k: int) -> np.ndarray:
    """The polynomial of every k numbers in a row; halves are shared."""
    if k == 1:
        return data
    half = k // 2
    front, power = _rolled(data, half), U(pow(int(BASE), half, 1 << 64))
    out = front[: len(front) - half] * power
    out += front[half:]
    if k % 2:
        out = out[:-1] * BASE
        out += data[k - 1 :]
    return out


def _grams(data: np.ndarray, sizes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    data = data.astype(U) + U(1)
    grams = np.where(sizes >= k, sizes - k + 1, np.minimum(sizes, 1))
    rolled = _rolled(data, k)
    # the last k - 1 numbers of a text start nothing, unless it is shorter: then its first stands for all
    ends = np.cumsum(sizes)
    starts = np.ones(len(rolled), bool)
    starts[ends[-1] if len(ends) else 0 :] = False
    for back in range(1, k):
        starts[ends[sizes >= back] - back] = False
    short = np.flatnonzero((sizes < k) & (sizes > 0))
    first = ends[short] - sizes[short]
    starts[first] = True
    for at, n in zip(first.tolist(), sizes[short].tolist(), strict=True):
        h = 0
        for x in data[at : at + n].tolist():
            h = (h * int(BASE) + x) & 0xFFFFFFFFFFFFFFFF
        rolled[at] = U(h)
    out = rolled[starts]
    if len(short):
        lengths = np.full(len(out), U(k))
        lengths[(np.cumsum(grams) - grams)[short]] = sizes[short]
        return mix(out + lengths), grams
    out += U(k)
    return mix(out), grams


def unique_by_text(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct values of each text, sorted within it; how often each occurs; number of distinct values by text)."""
    text = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((values, text))
    v, t = values[order], text[order]
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (t[1:] != t[:-1])
    at = np.flatnonzero(new)
    often = np.diff(np.append(at, len(v)))
    return v[at], often, np.bincount(t[at], minlength=len(counts))
