"""Byte-level BPE: encoding by a lazily determinised transducer, decoding by an incremental UTF-8 machine.

The merges leave a sequence of tokens alone exactly if they leave each token and each two neighbours alone, so every prefix of a
piece of text has just one last token. A vocabulary with a token that merges in the order of ranks don't make is refused. The nondeterministic transducer guesses where tokens end; its states, taken together
for all guesses that are still open, are determinised when a text first needs them. Such a state holds, for each place from which
a token may still be open, the node of the vocabulary's trie reached since, the token that ends at that place, and the tokens
that are waiting to be emitted up to there. A transition reads a byte and emits what all open guesses agree on; the end of a piece emits
the rest. A guess stays open for as long as its node has longer tokens that the merges would leave beside the one before, so the
look-ahead is bounded by the longest token. A state with few guesses doesn't remember the text before them, so many words share it.

States are rows of a table with a column for each of the COLUMNS commonest bytes; when STATES rows are full, it starts anew with the
states in use. All pieces of a block of texts are read side by side, a byte a step.

Decoding goes on from block to block of ids: bytes of a character that a block leaves open wait for the next one. Its machine gives a
replacement character for each longest part that no character can begin with.

Null text: empty, no ids. Repeated rows, and ties: a row each. Empty table: no rows. Columns of other names never reach the operator.
Texts of any length are encoded whole, BLOCK characters at a time.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, id_and_text, small

STATES, COLUMNS = 1 << 17, 128
#: Pieces of text that are read together, at most; and bytes of texts in a block.
BLOCK, BATCH = 1 << 18, 1 << 20
#: Fewer pieces than this are read one by one.
FEW = 24
#: A node with more tokens below it than this is not asked whether one of them fits.
BELOW = 48


def ranks_of(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Transducer:
    def __init__(self, ranks: dict[bytes, int], states: int = STATES):
        if lost := [b for b in range(256) if bytes([b]) not in ranks]:
            raise ValueError(f"bytes without a token: {lost}")
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.child: list[dict[int, int]] = [{}]
        self.token: list[int] = [-1]
        self.below: list[list[int]] = [[]]
        for b, i in sorted(ranks.items(), key=lambda x: x[1]):
            node = 0
            for k, c in enumerate(b):
                if c not in self.child[node]:
                    self.child[node][c] = len(self.child)
                    self.child.append({})
                    self.token.append(-1)
                    self.below.append([])
                node = self.child[node][c]
                if k < len(b) - 1:
                    self.below[node].append(i)
            self.token[node] = i
        self.halves: dict[bytes, list[bytes]] = {}
        for b, i in ranks.items():
            if len(b) > 1:
                self.halves[b] = [self.bytes_of[x] for x in self.merged(b, 2)]
                if len(self.halves[b]) > 2 or any(len(x) > 1 and ranks[x] > i for x in self.halves[b]):
                    raise ValueError(f"merges in the order of ranks don't make the token {b}")
        # the ends of each token as they were before its merges, the last merge first: (bytes, rank that it was merged at)
        self.ends = {i: (self.spine(b, 1), self.spine(b, 0)) for b, i in ranks.items()}
        self.fits: dict[tuple[int, int], bool] = {}
        self.hope: dict[tuple[int, int], bool] = {}
        self.most = states
        self.column = np.zeros(256, np.uint8)
        self.columns = 1  # column 0 is for all other bytes
        self.forget()

    def forget(self) -> None:
        self.number: dict[tuple, int] = {}
        self.state: list[tuple] = []
        self.to, self.out, self.last = np.full((1024, COLUMNS), -1, np.int32), np.zeros((1024, COLUMNS), np.int32), np.zeros(1024, np.int32)
        self.rare: dict[tuple[int, int], tuple[int, int]] = {}
        self.said: dict[tuple, int] = {(): 0}
        self.ids, self.end = [], [0]
        self.arrays = None
        self.intern(((0, -1, ()),))  # a piece's beginning: state 0

    def merged(self, b: bytes, upto: int = 1) -> list[int]:
        """Ids of b: of the neighbours that make a token, those of the lowest rank merge first, the left ones of equals. It ends
        with `upto` parts."""
        parts, rank = [bytes([c]) for c in b], self.ranks.get
        pair = [rank(x + y) for x, y in zip(parts, parts[1:], strict=False)]
        while len(parts) > upto and (found := [(r, i) for i, r in enumerate(pair) if r is not None]):
            i = min(found)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pair[i]
            if i:
                pair[i - 1] = rank(parts[i - 1] + parts[i])
            if i < len(pair):
                pair[i] = rank(parts[i] + parts[i + 1])
        return [self.ranks[x] for x in parts]

    def spine(self, b: bytes, right: int) -> list[tuple[bytes, int]]:
        """What stands at the right (or left) end of a token: itself at last, before that one of the two parts that made it, ..."""
        out, until = [], len(self.ranks)
        while True:
            out.append((b, until))
            if len(b) == 1:
                return out
            until = self.ranks[b]
            b = self.halves[b][right]

    def stay(self, a: int, b: int) -> bool:
        """Whether the merges leave these neighbours alone: no two ends that stand side by side at some time make a token
        that would be merged before either goes into its own."""
        if (out := self.fits.get((a, b))) is None:
            if len(self.fits) > 1_000_000:
                self.fits.clear()
            left, right, rank, i, j, out = self.ends[a][0], self.ends[b][1], self.ranks, 0, 0, True
            while out:
                (x, x_until), (y, y_until) = left[i], right[j]
                r = rank.get(x + y)
                out = r is None or r >= x_until or r > y_until
                if len(x) == 1 and len(y) == 1:
                    break
                if len(y) == 1 or len(x) > 1 and rank[x] > rank[y]:
                    i += 1
                else:
                    j += 1
            self.fits[a, b] = out
        return out

    def open(self, before: int, node: int) -> bool:
        """Whether a token that the merges leave beside `before` can still end below the node."""
        if before < 0 or len(self.below[node]) > BELOW:
            return bool(self.below[node])
        if (out := self.hope.get((before, node))) is None:
            if len(self.hope) > 1_000_000:
                self.hope.clear()
            out = self.hope[before, node] = any(self.stay(before, t) for t in self.below[node])
        return out

    def say(self, ids: tuple) -> int:
        if (i := self.said.get(ids)) is None:
            i = self.said[ids] = len(self.said)
            self.ids += ids
            self.end.append(len(self.ids))
            self.arrays = None
        return i

    def intern(self, state: tuple) -> int:
        if (i := self.number.get(state)) is None:
            i = self.number[state] = len(self.state)
            self.state.append(state)
            if i >= len(self.to):
                self.to = np.concatenate([self.to, np.full_like(self.to, -1)])
                self.out = np.concatenate([self.out, np.zeros_like(self.out)])
                self.last = np.concatenate([self.last, np.zeros_like(self.last)])
            self.last[i] = self.say(state[-1][2])
        return i

    def step(self, state: int, byte: int) -> tuple[int, int]:
        """The next state and what is emitted; kept in the tables."""
        alive, ended = [], None
        for node, before, waiting in self.state[state]:
            if (to := self.child[node].get(byte)) is None:
                continue
            if self.open(before, to):
                alive.append((to, before, waiting))
            t = self.token[to]
            if t >= 0 and (before < 0 or self.stay(before, t)):
                ended = (0, t, (*waiting, t))
        if ended is None:
            raise ValueError(f"no token ends after {byte} in {self.state[state]}")
        alive.append(ended)
        n, first = 0, alive[0][2]
        while n < len(first) and all(len(w) > n and w[n] == first[n] for _, _, w in alive):
            n += 1
        after = self.intern(tuple((to, before, w[n:]) for to, before, w in alive))
        said = self.say(first[:n])
        if k := int(self.column[byte]):
            self.to[state, k], self.out[state, k] = after, said
        else:
            if len(self.rare) > 4 * self.most:
                self.rare.clear()
            self.rare[state, byte] = after, said
        return after, said

    def keep(self, held: np.ndarray, *spoken: np.ndarray) -> None:
        """Starts the tables anew with the states in held and the emitted sequences in spoken, both numbered anew in place."""
        old, ids, end = self.state, self.ids, self.end
        self.forget()
        used, place = np.unique(held, return_inverse=True)
        held[:] = np.array([self.intern(old[i]) for i in used.tolist()], held.dtype)[place]
        for a in spoken:
            used, place = np.unique(a, return_inverse=True)
            a[:] = np.array([self.say(tuple(ids[end[i - 1] : end[i]]) if i else ()) for i in used.tolist()], a.dtype)[place]

    def encode(self, flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces flat[start : start + size], which follow one another and leave nothing out; and the place in flat
        of the byte with which each id was emitted."""
        said, rest = np.zeros(len(flat), np.int32), np.zeros(len(flat), np.int32)
        if self.columns < COLUMNS:
            new = np.bincount(flat, minlength=256) * (self.column == 0)
            for b in np.argsort(-new, kind="stable")[: COLUMNS - self.columns].tolist():
                if new[b]:
                    self.column[b], self.columns = self.columns, self.columns + 1
                    self.rare = {k: v for k, v in self.rare.items() if k[1] != b}
        order = np.argsort(-size, kind="stable")
        at, length, now = start[order], size[order], np.zeros(len(size), np.int64)
        j, n = 0, len(size)
        while n >= FEW:
            byte = flat[at[:n] + j]
            k, s = self.column[byte], now[:n]
            to, out = self.to[s, k], self.out[s, k]
            if len(missing := np.flatnonzero(to < 0)):
                pair, place = np.unique(s[missing] << 8 | byte[missing], return_inverse=True)
                made = np.array([self.rare.get((p >> 8, p & 255)) or self.step(p >> 8, p & 255) for p in pair.tolist()], np.int64)
                to[missing], out[missing] = made[place, 0], made[place, 1]
            said[at[:n] + j] = out
            now[:n] = to
            j += 1
            more = int(np.searchsorted(-length, -j, "left"))
            rest[at[more:n] + j - 1] = self.last[now[more:n]]
            n = more
            if len(self.state) >= self.most:
                self.keep(now, said, rest)
        for i in range(n):  # few and long
            s, column, rare = int(now[i]), self.column.tolist(), self.rare
            for p in range(int(at[i]) + j, int(at[i] + length[i])):
                byte = int(flat[p])
                k = column[byte]
                if k and (to := int(self.to[s, k])) >= 0:
                    said[p], s = self.out[s, k], to
                else:
                    s, said[p] = rare.get((s, byte)) or self.step(s, byte)
                if len(self.state) >= self.most:
                    now[i] = s
                    self.keep(now, said, rest)
                    s, rare = int(now[i]), self.rare
            rest[int(at[i] + length[i]) - 1] = self.last[s]
            now[i] = 0
        if self.arrays is None:
            self.arrays = np.array(self.ids, np.uint32), np.array(self.end, np.int64)
        ids, end = self.arrays
        both = np.stack([said, rest], 1).ravel()
        used = np.flatnonzero(both)
        which = both[used]
        many = end[which] - end[which - 1]
        total = np.cumsum(many)
        within = np.arange(int(total[-1]) if len(total) else 0) - np.repeat(total - many, many)
        return ids[np.repeat(end[which - 1], many) + within], np.repeat(used >> 1, many)


@lru_cache(maxsize=2)
def compiled(path: str) -> Transducer:
    """A worker's own; its next tasks use it again."""
    return Transducer(ranks_of(path))


#: Texts of characters before this one are cut by the standard library, with classes spelled out, which takes half the time.
COMMON = 0x180


@lru_cache(maxsize=4)
def cutter(pattern: str):
    """A function of a text that gives the pieces."""
    every = regex.compile(pattern)
    if pattern != public_tokenizers.PATTERN:
        return every
    letter, number, space = ("".join(re.escape(c) for c in map(chr, range(COMMON)) if regex.match(k, c)) for k in (r"\p{L}", r"\p{N}", r"\s"))
    plain = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{space}{letter}{number}]").replace(r"\p{L}", f"[{letter}]").replace(r"\p{N}", f"[{number}]").replace(r"\S", f"[^{space}]").replace(r"\s", f"[{space}]")
    return Cutter(every, re.compile(plain), re.compile(f"[^\0-{chr(COMMON - 1)}]"))


class Cutter:
    def __init__(self, every, plain: re.Pattern, other: re.Pattern):
        self.every, self.plain, self.other = every, plain, other

    def findall(self, text: str) -> list[str]:
        return (self.every if self.other.search(text) else self.plain).findall(text)

    def finditer(self, text: str):
        return self.every.finditer(text)


def blocks(texts: list[str], pattern: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts cut to pieces, in blocks: bytes, start and size of pieces, and the bytes of each text in this block."""
    cut = cutter(pattern)
    if len(texts) == 1 and len(texts[0]) > BLOCK:
        found, at = cut.finditer(texts[0]), 0
        while some := [m.end() for m in islice(found, BLOCK)]:
            yield _block([texts[0][at : some[-1]]], np.diff([at, *some]))
            at = some[-1]
        return
    yield _block(texts, np.fromiter((len(p) for t in texts for p in cut.findall(t)), np.int64))


def _block(texts: list[str], characters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    raw = [t.encode() for t in texts]
    flat = np.frombuffer(b"".join(raw), np.uint8)
    first = np.append(np.flatnonzero((flat & 0xC0) != 0x80), len(flat))  # of each character
    if int(characters.sum()) != len(first) - 1:
        raise ValueError("the pattern leaves characters out")
    edge = first[np.concatenate([[0], np.cumsum(characters)])]
    return flat, edge[:-1], np.diff(edge), np.fromiter(map(len, raw), np.int64, len(raw))


def ids_of(t: Transducer, texts: list[str], pattern: str) -> list[np.ndarray]:
    """The ids of each text."""
    parts: list[list[np.ndarray]] = [[] for _ in texts]
    for flat, start, size, length in blocks(texts, pattern):
        ids, place = t.encode(flat, start, size)
        edge = np.searchsorted(place, np.concatenate([[0], np.cumsum(length)]))
        for i in range(len(texts)):
            parts[i].append(ids[edge[i] : edge[i + 1]])
    return [np.concatenate(p) if p else np.zeros(0, np.uint32) for p in parts]


class TokenBytes:
    """The bytes of ids."""

    def __init__(self, ranks: dict[bytes, int]):
        self.size = np.zeros(max(ranks.values()) + 1, np.int64)
        for b, i in ranks.items():
            self.size[i] = len(b)
        self.flat = np.frombuffer(b"".join(b for b, _ in sorted(ranks.items(), key=lambda x: x[1])), np.uint8)
        self.start = np.cumsum(self.size) - self.size

    def of(self, ids: np.ndarray) -> np.ndarray:
        size = self.size[ids]
        total = np.cumsum(size)
        return self.flat[np.repeat(self.start[ids] - (total - size), size) + np.arange(int(total[-1]) if len(total) else 0)]


def _machine() -> tuple[np.ndarray, np.ndarray]:
    """The next state for (state, byte), and the value bits of a first byte. States: 0 between characters, 1 to 3 that many
    bytes to come, 4 to 7 after E0, ED, F0, F4, which narrow the next byte; 8: no character begins so."""
    to = np.full((9, 256), 8, np.uint8)
    value = np.zeros(256, np.uint32)
    for first, behind, state, bits in ((0x00, 0x80, 0, 0x7F), (0xC2, 0xE0, 1, 0x1F), (0xE0, 0xE1, 4, 0x0F), (0xE1, 0xED, 2, 0x0F), (0xED, 0xEE, 5, 0x0F), (0xEE, 0xF0, 2, 0x0F), (0xF0, 0xF1, 6, 0x07), (0xF1, 0xF4, 3, 0x07), (0xF4, 0xF5, 7, 0x07)):
        to[0, first:behind] = state
        value[first:behind] = np.arange(first, behind) & bits
    for state, first, behind, after in ((1, 0x80, 0xC0, 0), (2, 0x80, 0xC0, 1), (3, 0x80, 0xC0, 2), (4, 0xA0, 0xC0, 1), (5, 0x80, 0xA0, 1), (6, 0x90, 0xC0, 2), (7, 0x80, 0x90, 2)):
        to[state, first:behind] = after
    return to, value


NEXT, VALUE = _machine()
REPLACEMENT = 0xFFFD


class Utf8Stream:
    """Bytes in blocks, cut anywhere, to code points. All characters of a block are read side by side, a byte a step."""

    def __init__(self):
        self.held = np.zeros(0, np.uint8)

    def feed(self, block: np.ndarray) -> np.ndarray:
        """The code points that are complete by now."""
        data = np.concatenate([self.held, block]) if len(self.held) else block
        self.held = np.zeros(0, np.uint8)
        if not (data & 0x80).any():
            return data.astype(np.uint32)
        found, taken = np.full(len(data), -1, np.int64), (data & 0xC0) != 0x80
        first = np.flatnonzero(taken)
        at, state, value = first, NEXT[0, data[first]], VALUE[data[first]]
        while len(at):
            bad = state == 8
            found[first[bad]] = REPLACEMENT
            done = state == 0
            found[first[done]] = value[done]
            go = ~(bad | done)
            first, at, state, value = first[go], at[go] + 1, state[go], value[go]
            if len(at) and at[-1] >= len(data):  # the last one is open at the block's end
                self.held = data[first[-1] :]
                first, at, state, value = first[:-1], at[:-1], state[:-1], value[:-1]
            state = NEXT[state, data[at]]
            fits = state != 8
            taken[at[fits]] = True
            value = np.where(fits, value << np.uint32(6) | data[at] & np.uint8(0x3F), value)
        found[~taken] = REPLACEMENT  # bytes that continue nothing
        return found[found >= 0].astype(np.uint32)

    def finish(self) -> np.ndarray:
        left, self.held = len(self.held), np.zeros(0, np.uint8)
        return np.full(min(left, 1), REPLACEMENT, np.uint32)


def text_of(points: np.ndarray) -> str:
    return points.astype("<u4").tobytes().decode("utf-32-le")


@lru_cache(maxsize=2)
def token_bytes(path: str) -> TokenBytes:
    return TokenBytes(ranks_of(path))


def _paths(ranks: str | None, pattern: str | None) -> tuple[str, str]:
    return ranks or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN


def encoded(docs: DataFrame, ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id and ids of every row, without a shuffle."""
    path, cut = _paths(ranks, pattern)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        ids = [pa.array(x.astype(np.int32)) for x in ids_of(compiled(path), b.column(1).to_pylist(), cut)]
        return pa.RecordBatch.from_arrays([b.column(0), pa.array([x.to_numpy() for x in ids], pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return id_and_text(docs).mapInArrow(_sliced(run), "doc_id long, ids array<int>")


def decoded(rows: DataFrame, ranks: str | None = None, block: int = 1 << 16) -> DataFrame:
    """doc_id and text of rows with doc_id and ids, `block` ids at a time. A null list of ids is an empty one."""
    path, _ = _paths(ranks, None)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        texts = []
        for ids in b.column(1):
            ids, stream, parts = ids.values.to_numpy(zero_copy_only=False), Utf8Stream(), []
            for i in range(0, len(ids), block):
                parts.append(text_of(stream.feed(token_bytes(path).of(ids[i : i + block]))))
            texts.append("".join([*parts, text_of(stream.finish())]))
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return rows.select(rows["doc_id"].cast("long").alias("doc_id"), F.coalesce(rows["ids"], F.array().cast("array<int>")).alias("ids")).mapInArrow(batches(run), "doc_id long, text string")


def round_trip(docs: DataFrame, ranks: str | None = None, pattern: str | None = None, block: int = 1 << 16) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and n_chars, the decoded characters, of every row."""
    path, cut = _paths(ranks, pattern)

    def digest(ids: np.ndarray) -> tuple[int, str, str, int]:
        stream, decoded_, n = Utf8Stream(), hashlib.sha256(), 0
        for i in range(0, len(ids), block):
            part = token_bytes(path).of(ids[i : i + block])
            decoded_.update(part)
            n += len(stream.feed(part))
        return len(ids), hashlib.sha256(ids.astype("<u4")).hexdigest(), decoded_.hexdigest(), n + len(stream.finish())

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        n, ids, back, chars = zip(*map(digest, ids_of(compiled(path), b.column(1).to_pylist(), cut)), strict=True)
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids), pa.array(back), pa.array(chars, pa.int64())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_chars"])

    return id_and_text(docs).mapInArrow(_sliced(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_chars long")


def _sliced(fn):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return (fn(b) for whole in it for b in small(whole, BATCH) if b.num_rows)

    return run
