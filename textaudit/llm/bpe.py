"""Byte-level BPE by corpus-level merge replay.

Each task takes the distinct words (matches of the splitting pattern) of its share of the corpus that it has not met yet,
lays them out as one array of symbols with links to the neighbours, and keeps an inverted index from mergeable pair to the
positions where it occurs. The merges are replayed in rank order: all positions of the lowest pending rank are merged at
once, and only the pairs with the touched neighbours are looked up anew. Words don't interact, so any division of the
corpus gives the same ids as one replay over all of it.

A merge can create a pair whose rank is not above its own (two tokens can be cut in several ways); a word in which that
happens is encoded again by itself, leftmost lowest rank first, so that the result is always that of the greedy rule.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean

#: Words that a task remembers; beyond it the memory starts anew.
CACHE_WORDS = 1_000_000
#: Bytes of text that are split and replayed together.
SLICE_BYTES = 8 << 20
NONE = np.int64(1) << np.int64(40)


class Vocabulary:
    """The ranks of a vocabulary file and, for every way to cut a token into two tokens, the token that they make."""

    def __init__(self, lines: bytes):
        self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines.splitlines() if x)}
        self.tokens = {v: k for k, v in self.ranks.items()}
        pairs = {}
        for token, rank in self.ranks.items():
            for i in range(1, len(token)):
                left, right = self.ranks.get(token[:i]), self.ranks.get(token[i:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        self.pairs = pairs
        self.slots = max(20, (4 * len(pairs)).bit_length())
        self.keys, self.made = np.full(1 << self.slots, -1, np.int64), np.full(1 << self.slots, NONE, np.int64)
        self.probes = 1
        for key, at in zip(pairs, self._slot(np.fromiter(pairs, np.int64, len(pairs))).tolist(), strict=True):
            first = at
            while self.keys[at] >= 0:
                at = (at + 1) & ((1 << self.slots) - 1)
            self.keys[at], self.made[at] = key, pairs[key]
            self.probes = max(self.probes, (at - first) % (1 << self.slots) + 1)
        self.bytes_rank = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of the token that each pair makes, or NONE."""
        key = np.where((left < 0) | (right < 0), np.int64(-2), left << 32 | right)
        at = self._slot(key)
        there = self.keys[at]
        out = np.where(there == key, self.made[at], NONE)
        open_ = np.flatnonzero((there != key) & (there >= 0))  # the slot holds another pair: look at the next ones
        for i in range(1, self.probes):
            if not len(open_):
                break
            near = (at[open_] + i) & ((1 << self.slots) - 1)
            there = self.keys[near]
            hit = there == key[open_]
            out[open_[hit]] = self.made[near[hit]]
            open_ = open_[~hit & (there >= 0)]
        return out

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.slots)).astype(np.int64)

    def encode_alone(self, word: bytes) -> list[int]:
        """Greedy: the lowest rank first, the leftmost of equals."""
        if word in self.ranks:
            return [self.ranks[word]]
        n = len(word)
        tok, nxt, prv = [self.ranks[word[i : i + 1]] for i in range(n)], [*range(1, n), -1], [*range(-1, n - 1)]
        get = self.pairs.get
        heap = [(r, i, tok[i], tok[i + 1]) for i in range(n - 1) if (r := get(tok[i] << 32 | tok[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = nxt[i]
            if j < 0 or tok[i] != a or tok[j] != b:
                continue
            tok[i], tok[j], nxt[i] = rank, -1, nxt[j]
            if nxt[j] >= 0:
                prv[nxt[j]] = i
            nxt[j] = -1
            for x, y in ((prv[i], i), (i, nxt[i])):
                if x >= 0 and y >= 0 and (r := get(tok[x] << 32 | tok[y])) is not None:
                    heapq.heappush(heap, (r, x, tok[x], tok[y]))
        return [t for t in tok if t >= 0]

    def replay(self, words: list[bytes]) -> list[list[int]]:
        """The ids of every word."""
        todo = [i for i, w in enumerate(words) if w not in self.ranks]
        out: list = [[self.ranks[w]] if w in self.ranks else None for w in words]
        if not todo:
            return out
        sizes = np.array([len(words[i]) for i in todo], np.int64)
        ends = np.cumsum(sizes)
        first = ends - sizes
        n = int(ends[-1])
        # position n stands for no neighbour
        tok = np.append(self.bytes_rank[np.frombuffer(b"".join(words[i] for i in todo), np.uint8)], -1)
        nxt, prv = np.arange(1, n + 2), np.arange(-1, n)
        nxt[ends - 1], prv[first], nxt[n], prv[n] = n, n, n, n
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def post(at: np.ndarray, ranks: np.ndarray) -> None:
            order = np.argsort(ranks, kind="stable")
            at, ranks = at[order], ranks[order]
            cut = np.flatnonzero(np.diff(ranks)) + 1
            for r, part in zip(ranks[np.append(0, cut)].tolist(), np.split(at, cut), strict=True):
                if r in index:
                    index[r].append(part)
                else:
                    index[r] = [part]
                    heapq.heappush(heap, r)

        def look(at: np.ndarray, below: int) -> None:
            """Posts the mergeable pairs that start at these positions; notes words with a pair not above `below`."""
            ranks = self.rank_of(tok[at], tok[nxt[at]])
            found = ranks != NONE
            if found.any():
                at, ranks = at[found], ranks[found]
                if (low := ranks <= below).any():
                    again.update(np.searchsorted(ends, at[low], side="right").tolist())
                post(at, ranks)

        again: set[int] = set()
        look(np.arange(n), -1)
        while heap:
            rank = heapq.heappop(heap)
            parts = index.pop(rank)
            at = np.unique(np.concatenate(parts)) if len(parts) > 1 else parts[0]
            at = at[tok[at] >= 0]
            at = at[self.rank_of(tok[at], tok[nxt[at]]) == rank]
            if len(at) > 1:  # of pairs that overlap in a row every other one, from the left
                joined = nxt[at[:-1]] == at[1:]
                if joined.any():
                    start = np.ones(len(at), bool)
                    start[1:] = ~joined
                    place = np.arange(len(at)) - np.maximum.accumulate(np.where(start, np.arange(len(at)), 0))
                    at = at[place % 2 == 0]
            if not len(at):
                continue
            gone = nxt[at]
            after = nxt[gone]
            tok[at], tok[gone], nxt[at] = rank, -1, after
            prv[after] = at
            prv[n] = n
            before = prv[at]
            look(np.unique(np.concatenate((before[before < n], at[after < n]))), rank)
        alive = np.flatnonzero(tok[:n] >= 0)
        ids = tok[alive].tolist()
        cut = np.searchsorted(alive, ends)
        for k, (i, a, b) in enumerate(zip(todo, np.append(0, cut[:-1]).tolist(), cut.tolist(), strict=True)):
            out[i] = self.encode_alone(words[i]) if k in again else ids[a:b]
        return out


#: What the narrow pattern doesn't cover: later scripts, and four controls that re counts as white space.
NEAR = 0x250
FAR = re.compile(f"[^\\x00-\\x1b\\x20-{chr(NEAR - 1)}]").search


def narrow(pattern: str):
    """findall of the same pattern for texts of Latin letters, with \\p{L} and \\p{N} written out for the faster re module."""
    if re.sub(r"\\p\{[LN]\}", "", pattern).count("\\p"):
        return None
    names = {k: "".join(re.escape(chr(c)) for c in range(NEAR) if unicodedata.category(chr(c))[0] == k) for k in "LN"}
    out, inside = [], False
    for part in re.split(r"(\\p\{[LN]\}|\\.|[\[\]])", pattern):
        if part in ("[", "]"):
            inside = part == "["
        if part[:2] == "\\p":
            part = names[part[3]] if inside else f"[{names[part[3]]}]"
        out.append(part)
    return re.compile("".join(out)).findall


@lru_cache(maxsize=4)
def _vocabulary(lines: bytes) -> Vocabulary:
    return Vocabulary(lines)


class Encoder:
    """Encodes texts; remembers the words it has met."""

    def __init__(self, lines: bytes, pattern: str):
        import regex

        self.vocabulary, self.words = _vocabulary(lines), {}
        self.any_split, self.near_split = regex.compile(pattern).findall, narrow(pattern)

    def split(self, text: str) -> list[str]:
        return (self.any_split if self.near_split is None or FAR(text) else self.near_split)(text)

    def encode(self, texts: list[str]) -> list[list[list[int]]]:
        """For every text the ids of each of its words."""
        if len(self.words) > CACHE_WORDS:
            self.words = {}
        words = self.words
        cut = [self.split(t) for t in texts]
        new = list(set().union(*cut) - words.keys())
        for w, ids in zip(new, self.vocabulary.replay([w.encode("utf-8") for w in new]), strict=True):
            words[w] = ids
        get = words.__getitem__
        return [list(map(get, ws)) for ws in cut]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.vocabulary.tokens.__getitem__, ids))


def _slices(texts: list[str], most: int = SLICE_BYTES) -> Iterator[list[str]]:
    got, size = [], 0
    for t in texts:
        got.append(t)
        size += len(t)
        if size >= most:
            yield got
            got, size = [], 0
    if got:
        yield got


def _clean(t: str | None) -> str:
    return "" if t is None else t


def encode_documents(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256), with keep_ids also ids array<int>; one row per row of docs.

    vocabulary is the path of a rank file on the driver; its content (under a megabyte) travels with the tasks. Null and
    empty texts have no tokens. Every text is encoded whole; ids are decoded again by the vocabulary. Repeated rows stay,
    an empty table gives no rows, other columns are not read. Nothing is shuffled.
    """
    lines = open(vocabulary, "rb").read()
    shared = docs.sparkSession.sparkContext.broadcast((lines, pattern))
    typ = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        encoder = Encoder(*shared.value)
        token_bytes = encoder.vocabulary.tokens
        decimal = {}
        for batch in batches:
            texts = [_clean(t) for t in batch.column(1).to_pylist()]
            n, ids_hex, text_hex, kept = [], [], [], []
            for part in _slices(texts):
                for words in encoder.encode(part):
                    ids = [i for w in words for i in w]
                    n.append(len(ids))
                    try:
                        said = ",".join([decimal[i] for i in ids])
                    except KeyError:
                        decimal.update((i, str(i)) for i in token_bytes)
                        said = ",".join([decimal[i] for i in ids])
                    ids_hex.append(hashlib.sha256(said.encode()).hexdigest())
                    text_hex.append(hashlib.sha256(encoder.decode(ids)).hexdigest())
                    if keep_ids:
                        kept.append(ids)
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(ids_hex, pa.string()), pa.array(text_hex, pa.string())]
            names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                columns.append(pa.array(kept, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"id {typ}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(lean(run), schema)
    return out.withColumnRenamed("id", id_col)


def op9_bpe(spark, sf_dir):
    import public_tokenizers

    from .common import table

    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
