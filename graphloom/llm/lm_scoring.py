"""Language-model scores: a hashed maximum-entropy model with a class-factored softmax.

Words are counted over all training rows. The most frequent ones form the vocabulary, dealt by frequency to `classes` classes of
`inside` words; all other words are one class more. P(word | context) = P(class | context) * P(word | class, context), and both factors
are softmaxes over the same kinds of hashed features: the word before, the two words before, and the word before that alone (a skip).
Contexts are hashed from ids of frequent words and from the text of all others. A feature has a weight for each class, and,
in smaller tables, one for each word of each class. Words outside the vocabulary share their class by (c + 1) / (rare tokens + rare
words + 1), the softmax whose only feature is the word itself; the model sums to one over all words and the unknown one.

Weights are trained by distributed gradient updates. In the first, all weights are zero, so every probability is the
unigram one, and the gradient over all training rows comes from counts of features with classes and words. Each further update takes a
disjoint share of the training rows (one in `share`; there are as many updates as shares, so that all rows are used): its tasks sum the gradient in numpy over
sparse batches. The curvature of a weight, by which its step is divided, follows from the counts. A task gives its sums in
blocks of BLOCK numbers; blocks are added in two levels, first those of tasks with the same remainder, so that no group grows with the
number of tasks but by a 256th of it.

Only the most frequent words, at most `hot`, are sent to tasks; the counts of others meet their documents by a join on the word,
and since frequent words are not among them, no key is hot.

Null texts are empty: one token, the end. Null ids count as an empty text in the fold. Repeated rows: a row each. Ties in frequency go
by the word. Columns of other names never reach the operator. Empty table: no rows; no training rows: every word is unknown. Texts of
any length are scored whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, id_crc_mod, row_key, small

BLOCK = 8192
#: Bytes of text whose words a task counts before it hands them on, and that are learnt from or scored together.
COUNTED, SLICE = 8 << 20, 2 << 20
KINDS = 3


@dataclass
class Model:
    words: list[str]
    counts: np.ndarray
    tokens: int
    distinct: int
    classes: int
    inside: int
    buckets: int
    fine: int

    def __post_init__(self) -> None:
        self.index = {w.encode(): i for i, w in enumerate(self.words)}
        self.vocabulary = v = min(self.classes * self.inside, len(self.words))
        own = np.zeros(self.classes * self.inside)
        own[:v] = self.counts[:v]
        self.rare, self.rare_words = self.tokens - own.sum(), self.distinct - v
        own = own.reshape(self.classes, self.inside)
        mass = np.append(own.sum(1), self.rare + 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            self.class_share = mass / mass.sum()
            self.word_share = np.nan_to_num(own / own.sum(1, keepdims=True))
        self.of_class = np.zeros((KINDS * self.buckets, self.classes + 1), np.float32)
        self.of_word = np.zeros((KINDS * self.fine * self.classes, self.inside), np.float32)

    @property
    def size(self) -> int:
        return self.of_class.size + self.of_word.size

    def read(self, texts: pa.Array | list[str]) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, pa.Array], np.ndarray]:
        """Word numbers of all texts, each with its end (unknown: the number after the last), their sizes, the tokens as places in a
        list of the words that occur, and the numbers that contexts are hashed from. Each of these words is looked up once."""
        words, size = tokens(texts)
        coded, unknown = words.dictionary_encode(), len(self.words)
        each, at = coded.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
        ids = np.fromiter(map(self.index.get, each, repeat(unknown)), np.int64, len(each))
        context, cold = ids.copy(), np.flatnonzero(ids == unknown)
        context[cold] = np.fromiter((zlib.crc32(each[i]) for i in cold.tolist()), np.int64, len(cold)) + unknown
        return ids[at], size, (at, coded.dictionary), context[at]

    def features(self, context: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows of each token's features, in the table of classes and (but for the class) in that of words; before a text stands
        the end."""
        end, first = self.index.get(b"", len(self.words)), np.cumsum(size) - size
        one = np.concatenate([[end], context[:-1]])
        one[first] = end
        two = np.concatenate([[end], one[:-1]])
        two[first] = end
        hashes = [(x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20) for x in (one + 1, one * 31337 + two + 7, two * 3 + 2)]
        rest = lambda h, n: h % np.uint64(n) if n & (n - 1) else h & np.uint64(n - 1)
        rows = lambda n: np.stack([k * n + rest(h, n).astype(np.int64) for k, h in enumerate(hashes)])
        return rows(self.buckets), rows(self.fine)

    def powers(self) -> tuple[np.ndarray, np.ndarray]:
        """exp of both tables' weights, the first kind's times the unigram shares, so that a softmax is a product of rows, divided by its
        sum. An odd number of columns gets one of zeros. Steps are clipped, so single precision has room but for very many of them."""
        out = []
        for table, share in ((self.of_class, self.class_share), (self.of_word, self.word_share)):
            kind = np.float32 if KINDS * max(table.max(initial=0), -table.min(initial=0)) < 60 else np.float64
            e = np.zeros((len(table), table.shape[1] + table.shape[1] % 2), kind)
            e[:, : table.shape[1]] = np.exp(table, dtype=kind)
            first = e[: len(e) // KINDS, : table.shape[1]]
            first *= np.tile(share, (len(first) // max(1, share.size // table.shape[1]), 1))
            out.append(e)
        return out[0], out[1]

    def class_logs(self, rows: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore"):
            return np.log(softmax(self.powers()[0], rows))[:, : self.classes + 1]

    def word_logs(self, rows: np.ndarray, k: np.ndarray) -> np.ndarray:
        """log P(word | class k, context) for the words of that class."""
        with np.errstate(divide="ignore"):
            return np.log(softmax(self.powers()[1], rows * self.classes + k))[:, : self.inside]

    def targets(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Class, and place in it, of each token."""
        k = np.where(ids < self.vocabulary, ids // self.inside, self.classes)
        return k, np.where(ids < self.vocabulary, ids % self.inside, 0)

    def count(self, texts: pa.Array | list[str], total: np.ndarray) -> None:
        """Adds how often each feature stands with each class and word."""
        ids, size, _, context = self.read(texts)
        rows, fine = self.features(context, size)
        k, j = self.targets(ids)
        known = k < self.classes
        a, b = total[: self.of_class.size], total[self.of_class.size :]
        for r, f in zip(rows, fine, strict=True):
            a += np.bincount(r * (self.classes + 1) + k, minlength=a.size)
            b += np.bincount((f[known] * self.classes + k[known]) * self.inside + j[known], minlength=b.size)

    def gradient(self, texts: pa.Array | list[str], total: np.ndarray, block: int = 8192) -> None:
        """Adds these texts' gradient."""
        ids, size, _, context = self.read(texts)
        rows, fine = self.features(context, size)
        k, j = self.targets(ids)
        of_class, of_word = self.powers()

        def less(powers: np.ndarray, rows: Callable[[slice], np.ndarray], target: np.ndarray) -> np.ndarray:
            """The sums of the probabilities less the targets. Two neighbouring columns are added as one complex number."""
            pair = np.complex64 if powers.dtype == np.float32 else np.complex128
            out, half = np.zeros(powers.size // 2, pair), np.arange(powers.shape[1] // 2)
            for i in range(0, len(target), block):
                s = slice(i, i + block)
                at = rows(s)
                p = softmax(powers, at)
                p[np.arange(len(p)), target[s]] -= 1
                for r in at:
                    np.add.at(out, ((r * len(half))[:, None] + half).ravel(), p.view(pair).ravel())
            return out.view(powers.dtype).reshape(powers.shape)

        a, b = total[: self.of_class.size].reshape(self.of_class.shape), total[self.of_class.size :].reshape(self.of_word.shape)
        a -= less(of_class, lambda s: rows[:, s], k)[:, : a.shape[1]]
        known = np.flatnonzero(k < self.classes)
        b -= less(of_word, lambda s: fine[:, known[s]] * self.classes + k[known[s]], j[known])[:, : b.shape[1]]

    def first(self, counts: np.ndarray) -> None:
        """The update from zero, whose gradient the counts give."""
        a, b = counts[: self.of_class.size].reshape(self.of_class.shape), counts[self.of_class.size :].reshape(self.of_word.shape)
        shares = np.tile(self.word_share, (KINDS * self.fine, 1))
        self.seen = a.sum(1, keepdims=True), b.sum(1, keepdims=True)
        self.curved = self.class_share * (1 - self.class_share), shares * (1 - shares)
        self.step(np.concatenate([(a - self.seen[0] * self.class_share).ravel(), (b - self.seen[1] * shares).ravel()]), 1.0)

    def step(self, gradient: np.ndarray, share: float, damping: tuple[float, float] = (20.0, 10.0)) -> None:
        """A step by the curvature of each weight; the features of a token share it."""
        parts = np.split(gradient, [self.of_class.size])
        for table, g, n, c, d in zip((self.of_class, self.of_word), parts, self.seen, self.curved, damping, strict=True):
            table += np.clip(g.reshape(table.shape) / (KINDS * n * c * share + d * share), -3, 3).astype(np.float32)

    def trained(self) -> Model:
        self.seen = self.curved = None
        return self

    def score(self, texts: pa.Array | list[str], block: int = 8192) -> tuple:
        """For each text: tokens, hot tokens, base score of these, model's score but for the share of rare words in their class;
        and of the words that are not hot (text, word, how often)."""
        ids, size, (at, each), context = self.read(texts)
        of_text = np.repeat(np.arange(len(size)), size)
        rows, fine = self.features(context, size)
        k, j = self.targets(ids)
        of_class, of_word = self.powers()
        s = np.empty(len(ids))
        for i in range(0, len(ids), block):
            p = softmax(of_class, rows[:, i : i + block])
            s[i : i + block] = np.log10(p[np.arange(len(p)), k[i : i + block]])
            here = np.flatnonzero(k[i : i + block] < self.classes) + i
            p = softmax(of_word, fine[:, here] * self.classes + k[here])
            s[here] += np.log10(p[np.arange(len(p)), j[here]])
        known, hot = ids < self.vocabulary, ids < len(self.words)
        middle = hot & ~known
        s[middle] += np.log10((self.counts[ids[middle]] + 1) / (self.rare + self.rare_words + 1))
        base = np.zeros(len(ids))
        base[hot] = np.log10((self.counts[ids[hot]] + 1) / (self.tokens + self.distinct + 1))
        add = lambda x: np.bincount(of_text, x, len(size))
        pairs, times = np.unique(of_text[~hot] * len(each) + at[~hot], return_counts=True)
        return size, add(hot).astype(np.int64), add(base), add(s), (pairs // len(each), each.take(pa.array(pairs % len(each))), times)


def softmax(powers: np.ndarray, at: np.ndarray) -> np.ndarray:
    p = np.take(powers, at[0], axis=0)
    for r in at[1:]:
        p *= np.take(powers, r, axis=0)
    p /= np.einsum("ij->i", p)[:, None]
    return p


def tokens(texts: pa.Array | list[str]) -> tuple[pa.Array, np.ndarray]:
    """The lower-cased words of all texts, each text's followed by an end, and their numbers."""
    texts = pa.array(texts, pa.string()) if isinstance(texts, list) else texts
    # the blank after each text leaves an empty last part, the end; other empty parts go
    parts = pc.ascii_split_whitespace(pc.ascii_lower(pc.binary_join_element_wise(texts, " ", "")))
    words, stop = parts.flatten(), parts.offsets.to_numpy()
    stop = stop - stop[0]
    kept = pc.binary_length(words).to_numpy() > 0
    kept[stop[1:] - 1] = True
    return words.filter(pa.array(kept)), np.diff(np.concatenate([[0], np.cumsum(kept)])[stop])


def word_counts(rows: DataFrame) -> DataFrame:
    """(word, c): how often each word, or the end, stands in the texts. A task adds up before the shuffle, COUNTED bytes at a time."""

    def count(b: pa.RecordBatch) -> pa.RecordBatch:
        own = pc.value_counts(tokens(b.column(0))[0])
        return pa.RecordBatch.from_arrays([own.field("values"), own.field("counts")], names=["word", "c"])

    return rows.select("text").mapInArrow(lambda it: (count(x) for whole in it for x in small(whole, COUNTED) if x.num_rows), "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def summed(rows: DataFrame) -> DataFrame:
    """(block, v): sums of v over rows (block, turn, v), in two levels."""

    def add(key: tuple, t: pa.Table) -> pa.Table:
        total = np.zeros(BLOCK)
        for c in t.column("v").chunks:
            for x in c:
                total += x.values.to_numpy()
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "v": pa.array([total], pa.list_(pa.float64()))})

    return rows.groupBy("block", "turn").applyInArrow(add, "block int, v array<double>").groupBy("block").applyInArrow(add, "block int, v array<double>")


def train(rows: DataFrame, counts: DataFrame, hot: int, classes: int, inside: int, buckets: int, fine: int, rounds: int, share: int) -> Model:
    tokens, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    top = counts.where(F.length("word") <= 100).orderBy(F.desc("c"), "word").limit(hot).toArrow()
    model = Model(top.column("word").to_pylist(), top.column("c").to_numpy(), tokens, distinct, classes, inside, buckets, fine)
    sc = rows.sparkSession.sparkContext

    def total(texts: DataFrame, how: str) -> np.ndarray:
        shared = sc.broadcast(model)  # `hot` words and tables of fixed size

        def gathered(it):
            m = shared.value
            own = np.zeros(-(-m.size // BLOCK) * BLOCK, np.float64)
            for b in it:
                for x in small(b, SLICE):
                    if x.num_rows:
                        getattr(m, how)(x.column(0), own[: m.size])
            own = own.reshape(-1, BLOCK)
            used, turn = np.flatnonzero(own.any(1)), TaskContext.get().partitionId() % 256
            if len(used):
                values = pa.ListArray.from_arrays(pa.array(np.arange(len(used) + 1) * BLOCK, pa.int32()), pa.array(own[used].astype(np.float32).ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(np.full(len(used), turn), pa.int32()), values], names=["block", "turn", "v"])

        got = summed(texts.select("text").mapInArrow(gathered, "block int, turn int, v array<float>")).toArrow()  # the tables' blocks
        out = np.zeros(-(-model.size // BLOCK) * BLOCK).reshape(-1, BLOCK)
        for block, v in zip(got.column("block").to_pylist(), got.column("v"), strict=True):
            out[block] = v.values.to_numpy()
        shared.unpersist()
        return out.ravel()[: model.size]

    if tokens:
        model.first(total(rows, "count"))
        for r in range(rounds):
            model.step(total(rows.where(F.pmod(F.xxhash64("k_id", F.lit(5)), F.lit(share)) == r), "gradient"), 1 / share)
    return model.trained()


def lm_scores(docs: DataFrame, folds: int = 7, held_out: int = 2, hot: int = 65_536, classes: int = 32, inside: int = 32, buckets: int = 2048, fine: int = 256, rounds: int = 2, share: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of docs."""
    rows = row_key(docs).withColumn("held_out", id_crc_mod(folds) == held_out)
    training = rows.where("not held_out")
    counts = cut(word_counts(training))
    model = train(training, counts, hot, classes, inside, buckets, fine, rounds, share)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # `hot` words and fixed tables

    def score(b: pa.RecordBatch) -> pa.RecordBatch:
        size, known, base, s, (of, cold, often) = shared.value.score(b.column("text"))
        n, rest = len(size), len(of)
        at = pa.array(np.concatenate([np.arange(n), of]))
        keys = [b.column(c).take(at) for c in ("k_id", "k_text", "doc_id", "held_out")]
        # a document's own row meets no word: its key is spread by its text
        words = pa.concat_arrays([pa.array([f" {x}" for x in b.column("k_text").to_pylist()], pa.string()), cold])
        times = pa.array(np.concatenate([np.zeros(n, np.int64), often]))
        facts = [pa.array(np.concatenate([x, np.zeros(rest, x.dtype)])) for x in (size, known, base, s)]
        return pa.RecordBatch.from_arrays([*keys, words, times, *facts, pa.array(np.arange(n + rest) < n).cast(pa.int64())], names=names)

    schema = "k_id long, k_text long, doc_id long, held_out boolean, word string, times long, n long, known long, base double, s double, itself long"
    names = [x.split()[0] for x in schema.split(", ")]
    each = rows.select("k_id", "k_text", "doc_id", "held_out", "text").mapInArrow(lambda it: (score(x) for whole in it for x in small(whole, SLICE) if x.num_rows), schema)
    c, times = F.coalesce("c", F.lit(0)), F.col("times")
    all_ = float(model.tokens + model.distinct + 1)
    rare = float(model.rare + model.rare_words + 1)
    joined = each.join(counts, "word", "left").groupBy("k_id", "k_text", "doc_id", "held_out").agg(
        F.sum("n").alias("n"),
        F.sum(F.col("known") + F.when(c > 0, times).otherwise(0)).alias("k"),
        F.sum(F.col("base") + times * F.log10((c + 1) / all_)).alias("base"),
        F.sum(F.col("s") + times * F.log10((c + 1) / rare)).alias("s"),
        F.sum("itself").alias("rows"),
    )
    # repeated rows were summed together: each of them takes its share
    share = joined.select("doc_id", "held_out", "n", "k", "base", "s", "rows", F.explode(F.array_repeat(F.lit(1), F.col("rows").cast("int"))))
    whole = lambda x: F.expr(f"{x} div rows")
    return share.select("doc_id", "held_out", whole("n").alias("n_tokens"), whole("k").alias("n_known"), F.lit(int(model.tokens)).cast("long").alias("train_tokens"), (F.col("base") / F.col("rows")).alias("base_score"), (F.col("s") / F.col("rows")).alias("score"))
