"""Token counts by a compiled finite-state tokenizer.

The vocabulary is compiled to a deterministic transducer over characters. A sequence of pieces is what the merges make of a text
exactly if each piece and each two neighbours are left alone by the merges, so the last piece of every prefix of a text is
unique. A state holds what later pieces can depend on: each place behind it from which a piece may still be open, as the node
of the vocabulary's trie that has been reached since, the piece that ends at that place, and the tokens counted since then. A
transition reads a character and is annotated with the tokens that it emits, net: a longer piece takes back the tokens of its
parts. The trie, the merges and the pairs of characters that pieces have side by side are compiled once; states and
transitions are made when a text first needs them, and are kept in tables of STATES rows, one column for each of the COLUMNS
commonest characters. When the tables are full, they start anew with the states that are in use.

Texts are cut into chunks of CHUNK characters, and all chunks of a batch are read side by side, a column of characters a step. A
chunk's map, state -> (state, tokens), is made for the state that the WARM characters before it lead to. Maps compose
associatively: a scan over neighbours finds those whose entry was made for another state than the one before ends in, makes
that entry, and goes on until all fit; then a segmented sum gives each text's count. A worker's tables take STATES * COLUMNS * 5
bytes at most (170 MB), and as much again for what the states hold.

Null text: empty, no tokens. Repeated rows, and ties: a row each. Empty table: no rows. Columns of other names never reach the
operator. Texts of any length are counted whole: memory is a group of chunks.
"""

from __future__ import annotations

import heapq
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import batches, id_and_text

MARK = "▁"
CHUNK, WARM = 512, 32
#: Chunks that are read side by side.
LANES = 8192
STATES, COLUMNS = 1 << 18, 128
#: Fewer chunks than this are read one by one.
FEW = 24


class Transducer:
    def __init__(self, path: str, states: int = STATES):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ordinary = (i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)))
        self.score = {model.id_to_piece(i): model.get_score(i) for i in ordinary}
        self.beside = {p[i : i + 2] for p in self.score for i in range(len(p) - 1)}
        if lost := {c for p in self.score for c in p} - self.score.keys():
            raise ValueError(f"characters of pieces are no pieces: {sorted(lost)[:9]}")
        self.child: list[dict[str, int]] = [{}]
        self.piece: list[str | None] = [None]
        for p in self.score:
            node = 0
            for c in p:
                if c not in self.child[node]:
                    self.child[node][c] = len(self.child)
                    self.child.append({})
                    self.piece.append(None)
                node = self.child[node][c]
            if self.merged(p) == [p]:
                self.piece[node] = p
        self.agree: dict[tuple, bool] = {}
        self.most = states
        self.column = np.zeros(0x110000, np.uint8)
        self.columns = 1  # column 0 is for all other characters
        self.forget()

    def forget(self) -> None:
        self.number: dict[tuple, int] = {}
        self.state: list[tuple] = []
        self.to, self.emit = np.full((1024, COLUMNS), -1, np.int32), np.zeros((1024, COLUMNS), np.int8)
        self.rare: dict[tuple[int, int], tuple[int, int]] = {}
        self.intern(((0, None, 0),))  # a text's beginning: state 0

    def merged(self, s: str) -> list[str]:
        """Pieces of s: the best neighbours merge first, the left ones of equals."""
        score, piece, left, right = self.score, list(s), list(range(-1, len(s) - 1)), list(range(1, len(s) + 1))
        heap = [(-score[p], i, p) for i in range(len(s) - 1) if (p := s[i : i + 2]) in score]
        heapq.heapify(heap)
        while heap:
            _, i, p = heapq.heappop(heap)
            j = right[i]
            if not piece[i] or j >= len(s) or piece[i] + piece[j] != p:
                continue
            piece[i], piece[j], right[i] = p, "", right[j]
            if right[j] < len(s):
                left[right[j]] = i
            for a, b in ((left[i], i), (i, right[i])):
                if 0 <= a and b < len(s) and (q := piece[a] + piece[b]) in score:
                    heapq.heappush(heap, (-score[q], a, q))
        return [p for p in piece if p]

    def stay(self, a: str, b: str) -> bool:
        """Whether the merges leave these neighbours alone."""
        if (out := self.agree.get((a, b))) is None:
            if len(self.agree) > 1_000_000:
                self.agree.clear()
            out = self.agree[a, b] = self.merged(a + b) == [a, b]
        return out

    def intern(self, state: tuple) -> int:
        if (i := self.number.get(state)) is None:
            i = self.number[state] = len(self.state)
            self.state.append(state)
            if i >= len(self.to):
                self.to = np.concatenate([self.to, np.full_like(self.to, -1)])
                self.emit = np.concatenate([self.emit, np.zeros_like(self.emit)])
        return i

    def step(self, state: int, code: int) -> tuple[int, int]:
        """The next state and the tokens emitted; kept in the tables."""
        c, alive, last, n = chr(code), [], None, 0
        for node, before, since in self.state[state]:
            if not node and before is not None and before[-1] + c not in self.beside:
                before = None  # no piece spans this place
            if (to := self.child[node].get(c)) is None:
                continue
            alive.append((to, before, since))
            p = self.piece[to]
            if p is not None and (before is None or self.stay(before, p)):
                last, n = p, 1 - since
        if c not in self.score:  # its bytes
            last, n = None, len(c.encode())
        elif last is None:
            raise ValueError(f"no piece ends after {c!r} in {self.state[state]}")
        after = self.intern((*((to, before, since + n) for to, before, since in alive if self.child[to]), (0, last, 0)))
        if k := int(self.column[code]):
            self.to[state, k], self.emit[state, k] = after, n
        else:
            if len(self.rare) > 4 * self.most:
                self.rare.clear()
            self.rare[state, code] = after, n
        return after, n

    def keep(self, *held: np.ndarray) -> None:
        """Starts the tables anew with the states in these arrays, which are numbered anew in place."""
        old = self.state
        self.forget()
        for a in held:
            used, place = np.unique(a, return_inverse=True)
            a[:] = np.array([self.intern(old[i]) for i in used.tolist()], a.dtype)[place]

    def read(self, flat: np.ndarray, start: np.ndarray, size: np.ndarray, states: np.ndarray, *held: np.ndarray) -> np.ndarray:
        """Reads flat[start : start + size] for each chunk, from its state, which becomes the last one; gives tokens. held: more
        arrays of states that the caller still needs."""
        tokens = np.zeros(len(size), np.int64)
        if len(size) < FEW:
            for i, (a, n) in enumerate(zip(start.tolist(), size.tolist(), strict=True)):
                s, total = int(states[i]), 0
                for code in flat[a : a + n].tolist():
                    k = self.column[code]
                    if k and (to := int(self.to[s, k])) >= 0:
                        total += int(self.emit[s, k])
                        s = to
                    else:
                        s, more = self.rare.get((s, code)) or self.step(s, code)
                        total += more
                    if len(self.state) >= self.most:
                        states[i] = s
                        self.keep(states, *held)
                        s = int(states[i])
                states[i], tokens[i] = s, total
            return tokens
        order = np.argsort(-size, kind="stable")
        now, at, ends, tokens_now = states[order], start[order], size[order], tokens
        for j in range(int(ends[0])):
            n = int(np.searchsorted(-ends, -j, "left"))  # chunks that have a character here
            code = flat[at[:n] + j]
            k, s = self.column[code], now[:n]
            to, more = self.to[s, k], self.emit[s, k].astype(np.int64)
            missing = np.flatnonzero(to < 0)
            if len(missing):
                pair, place = np.unique(s[missing].astype(np.int64) << 21 | code[missing], return_inverse=True)
                made = np.array([self.rare.get((p >> 21, p & 0x1FFFFF)) or self.step(p >> 21, p & 0x1FFFFF) for p in pair.tolist()], np.int64)
                to[missing], more[missing] = made[place, 0], made[place, 1]
            tokens_now[:n] += more
            now[:n] = to
            if len(self.state) >= self.most:
                self.keep(now, *held)
        states[order] = now
        out = np.empty_like(tokens)
        out[order] = tokens_now
        return out

    def group(self, flat: np.ndarray, start: np.ndarray, size: np.ndarray, first: np.ndarray, carry: tuple) -> tuple[np.ndarray, tuple]:
        """Tokens of neighbouring chunks; first: chunks that begin a text. carry: the state (as it is, not its number) that the
        group before has ended in."""
        entry, warm = np.zeros(len(size), np.int64), np.flatnonzero(~first)
        if len(warm) and warm[0] == 0:
            entry[0], warm = self.intern(carry), warm[1:]
        guess = np.zeros(len(warm), np.int64)
        before = np.minimum(WARM, size[warm - 1])
        self.read(flat, start[warm] - before, before, guess, entry)
        entry[warm] = guess
        end = entry.copy()
        tokens = self.read(flat, start, size, end, entry)
        while len(wrong := 1 + np.flatnonzero((end[:-1] != entry[1:]) & ~first[1:])):
            entry[wrong] = end[wrong - 1]
            some = entry[wrong]
            tokens[wrong] = self.read(flat, start[wrong], size[wrong], some, entry, end)
            end[wrong] = some
        return tokens, self.state[int(end[-1])]

    def count_all(self, texts: list[str], chunk: int = CHUNK) -> list[int]:
        flat = np.frombuffer("".join(MARK + t for t in texts if t).encode("utf-32-le"), np.uint32).copy()
        flat[flat == 0x20] = ord(MARK)
        self.name(flat)
        length = np.array([len(t) + 1 if t else 0 for t in texts], np.int64)
        chunks = -(-length // chunk)
        text = np.repeat(np.arange(len(texts)), chunks)
        place = np.arange(len(text)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
        start = (np.cumsum(length) - length)[text] + place * chunk
        size = np.minimum(chunk, length[text] - place * chunk)
        tokens, carry = np.zeros(len(text), np.int64), ((0, None, 0),)
        for i in range(0, len(text), LANES):
            g = slice(i, i + LANES)
            tokens[g], carry = self.group(flat, start[g], size[g], place[g] == 0, carry)
        return np.bincount(text, tokens, len(texts)).astype(np.int64).tolist()

    def name(self, flat: np.ndarray) -> None:
        """Gives columns to the commonest characters of the first texts, as long as there are some left."""
        if self.columns < COLUMNS:
            new, n = np.unique(flat[self.column[flat] == 0], return_counts=True)
            for code in new[np.argsort(-n, kind="stable")][: COLUMNS - self.columns].tolist():
                self.column[code] = self.columns
                self.columns += 1
                self.rare = {k: v for k, v in self.rare.items() if k[1] != code}


@lru_cache(maxsize=2)
def compiled(path: str) -> Transducer:
    """A worker's own; its next tasks use it again."""
    return Transducer(path)


def token_counts(docs: DataFrame, model: str | None = None, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit for every row of docs, without a shuffle."""
    model = model or public_tokenizers.path("piece_bpe_32k.model")

    def count(b: pa.RecordBatch) -> pa.RecordBatch:
        n = pa.array(compiled(model).count_all(b.column(1).to_pylist()), pa.int64())
        return pa.RecordBatch.from_arrays([b.column(0), pc.binary_length(b.column(1)).cast(pa.int64()), n, pc.greater(n, limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return id_and_text(docs).mapInArrow(batches(count), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
