"""A convolutional text classifier for toxicity, trained in numpy and scored on whole texts.

Words are hashed twice into two embedding tables, which are set side by side; filters of several widths run over the words, and
each filter's maximum over the text goes to a logistic layer. Only the text is an input. Training takes all labelled ids outside the
held-out fold, one text of each; a fifth of them is kept apart to calibrate. They are dealt to shards of about `words` words, whose
tasks go through their rows once a round, all from the same weights; a weight is then the mean over the shards that moved it, so
that words which few shards have are learnt as fast. A single shard does all its rounds in one task. For the calibration, all
of its rows are counted by language, label and score, in steps of 1/STEPS of the logistic scale. There the
scale is shifted so that the best cut of all languages is at `at`, and each language with enough positives gets its own cut
(column cut; rejected: score >= cut).

Null texts are empty, and are scored as such. Rows with null ids are never learnt from unless labelled. Repeated rows: a row
each. No labels of both classes: every score is 0. Empty table: no rows. Texts of any length are scored whole, in blocks.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import bytes_of
from .common import batches, cut, drop, id_crc_mod, small

WORD = re.compile(r"\w+").findall
BUCKETS = 1 << 18
PAD = BUCKETS
WIDTHS = (1, 2, 3)
#: Labels of up to so many bytes are sent to the tasks that read the texts.
LABEL_BYTES = 16 << 20
#: Scores are counted in this many steps to 1 of the logistic scale, within LIMIT of 0.
STEPS, LIMIT = 512, 40
#: Weights that a task hands on together; shards at most (each hands on all weights that it has moved).
BLOCK, MOST_SHARDS = 4096, 256
#: Words that a worker remembers the hashes of.
KEPT = 500_000


class Hashes(dict):
    """Word in lower case -> its two buckets in one number."""

    def __missing__(self, word: str) -> int:
        raw = word.encode()
        if len(self) >= KEPT:
            self.clear()
        out = self[word] = (zlib.crc32(raw) % BUCKETS << 20) | zlib.adler32(raw[::-1], zlib.crc32(raw, 77)) * 2654435761 % BUCKETS
        return out

    def of(self, text: str) -> np.ndarray:
        words = WORD(text.lower())
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


@dataclass
class Model:
    """dim: of each of the two embeddings; filters: of each width."""

    dim: int = 4
    filters: int = 8
    seed: int = 7
    shift: float = 0.0
    cuts: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        r = np.random.default_rng(self.seed)
        self.embed = [r.normal(0, 0.1, (BUCKETS + 1, self.dim)).astype(np.float32) for _ in range(2)]
        for e in self.embed:
            e[PAD] = 0
        self.filter = [r.normal(0, 0.5, (w * 2 * self.dim, self.filters)).astype(np.float32) for w in WIDTHS]
        self.out = np.concatenate([r.normal(0, 0.3, len(WIDTHS) * self.filters), [0.0]]).astype(np.float32)
        self.seen = [np.full(p.shape, 1e-6, np.float32) for p in self.parts()]

    def parts(self) -> list[np.ndarray]:
        return [*self.embed, *self.filter, self.out]

    def flat(self) -> np.ndarray:
        """All weights, then the sums of squares of their gradients."""
        return np.concatenate([p.ravel() for p in (*self.parts(), *self.seen)])

    def load(self, flat: np.ndarray) -> None:
        at = 0
        for p in (*self.parts(), *self.seen):
            p[...] = flat[at : at + p.size].reshape(p.shape)
            at += p.size

    def pooled(self, hashes: list[np.ndarray], at: bool = False) -> tuple:
        """The maxima of all filters for each text, not below 0; with at, also the words and where each maximum is."""
        pad = np.full(max(WIDTHS) - 1, PAD << 20 | PAD, np.int64)
        words = np.concatenate([x for h in hashes for x in (h, pad)])
        start = np.cumsum([0] + [len(h) + len(pad) for h in hashes[:-1]])
        x = np.concatenate([self.embed[0][words >> 20], self.embed[1][words & 0xFFFFF]], 1)
        best, where = [], []
        for w, f in zip(WIDTHS, self.filter, strict=True):
            d = 2 * self.dim
            y = x @ f[:d]
            for j in range(1, w):
                y[:-j] += x[j:] @ f[j * d : (j + 1) * d]
                y[np.append(start[1:], len(y)) - j] = -np.inf  # these windows would reach into the next text
            top = np.maximum.reduceat(y, start)
            best.append(np.maximum(top, 0))
            if at:
                where.append(np.array([y[a:b].argmax(0) + a for a, b in zip(start, [*start[1:], len(y)], strict=True)]))
        return (np.concatenate(best, 1), words, x, where) if at else (np.concatenate(best, 1),)

    def logits(self, hashes: list[np.ndarray], block: int = 20_000) -> np.ndarray:
        """Long texts go block by block, with an overlap: the maximum of the blocks' maxima is the text's."""
        cut = [(i, h[a : a + block + max(WIDTHS) - 1]) for i, h in enumerate(hashes) for a in range(0, max(1, len(h)), block)]
        best = np.zeros((len(hashes), len(WIDTHS) * self.filters), np.float32)
        while cut:
            n, size = 1, len(cut[0][1])
            while n < len(cut) and size + len(cut[n][1]) <= block:
                size += len(cut[n][1])
                n += 1
            np.maximum.at(best, [i for i, _ in cut[:n]], self.pooled([h for _, h in cut[:n]])[0])
            cut = cut[n:]
        return best @ self.out[:-1] + self.out[-1] + self.shift

    def forget(self, texts_with: list[np.ndarray], rare: int = 5) -> None:
        """Words in fewer than `rare` texts stay without an embedding: they can only be learnt by heart."""
        for e, n in zip(self.embed, texts_with, strict=True):
            e[n < rare] = 0

    def fit(self, batches: Iterator[tuple[list[np.ndarray], np.ndarray]], share: float, rate: float = 0.05) -> None:
        """Adagrad on the logistic loss over batches of texts and labels, the rarer class weighted up (share: that of label 1); gradients
        reach only the words at the maxima."""
        seen, high, low = self.seen, 0.5 / max(share, 1e-6), 0.5 / max(1 - share, 1e-6)

        def step(k: int, p: np.ndarray, at, g: np.ndarray) -> None:
            seen[k][at] += g * g
            p[at] -= rate * g / np.sqrt(seen[k][at])

        for hashes, y in batches:
            if len(hashes):
                top, words, x, where = self.pooled(hashes, at=True)
                error = ((1 / (1 + np.exp(-(top @ self.out[:-1] + self.out[-1]))) - y) * np.where(y == 1, high, low) / len(y)).astype(np.float32)
                back = (error[:, None] * self.out[:-1]) * (top > 0)
                ends, rows, grads = np.concatenate([error @ top, [error.sum()]]), [], []
                for k, (w, f) in enumerate(zip(WIDTHS, self.filter, strict=True)):
                    g, at, d = back[:, k * self.filters : (k + 1) * self.filters], where[k], 2 * self.dim
                    grad = np.zeros_like(f)
                    for j in range(w):
                        near = np.minimum(at + j, len(words) - 1)
                        grad[j * d : (j + 1) * d] = np.einsum("ifd,if->df", x[near], g)
                        rows.append(words[near].ravel())
                        grads.append((g[:, :, None] * f[j * d : (j + 1) * d].T[None]).reshape(-1, d))
                    step(2 + k, f, ..., grad)
                rows, grads = np.concatenate(rows), np.concatenate(grads)
                for k, bucket in enumerate((rows >> 20, rows & 0xFFFFF)):
                    at, inverse = np.unique(bucket, return_inverse=True)
                    g = np.zeros((len(at), self.dim), np.float32)
                    np.add.at(g, inverse, grads[:, k * self.dim : (k + 1) * self.dim])
                    keep = (at != PAD) & self.embed[k][at].any(1)
                    step(k, self.embed[k], at[keep], g[keep])
                step(len(seen) - 1, self.out, ..., ends.astype(np.float32))


def best_cut(step: np.ndarray, clean_rows: np.ndarray, toxic_rows: np.ndarray, clean: float = 4.0) -> float:
    """Rows of both labels at ascending steps of the scores. The middle of the gap in the scores at which the shares of both classes that
    fall right are best; a share of clean texts weighs `clean` times as much, so that few calibration rows don't put the cut among them."""
    gain = clean * (np.cumsum(clean_rows) / max(1, clean_rows.sum())) - (np.cumsum(toxic_rows) / max(1, toxic_rows.sum()))
    i = int(np.argmax(gain))
    return float((step[i] + step[min(i + 1, len(step) - 1)]) / 2)


def labelled(docs: DataFrame, labels: DataFrame, folds: int, held_out: int) -> DataFrame:
    """(doc_id, h, lang, toxic, n): one text, as hashes of its n words, of each labelled id outside the held-out fold; written."""
    ours = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["toxic"].cast("int").alias("toxic")).where(id_crc_mod(folds) != held_out).where("doc_id is not null and toxic in (0, 1)").distinct()
    lang = docs["lang"] if "lang" in docs.columns else F.lit(None).cast("string")
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text"), lang.alias("lang")).join(F.broadcast(ours) if bytes_of(ours) <= LABEL_BYTES else ours, "doc_id")
    # an id with several rows or labels gives one
    texts = texts.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text"), "text", "lang", "toxic")).alias("m")).select("doc_id", "m.text", "m.lang", "m.toxic")

    def hashed(b: pa.RecordBatch) -> pa.RecordBatch:
        h = Hashes()
        each = [h.of(t) for t in b.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(each, pa.list_(pa.int64())), b.column(2), b.column(3), pa.array([*map(len, each)], pa.int64())], names=["doc_id", "h", "lang", "toxic", "n"])

    return cut(texts.select("doc_id", "text", "lang", "toxic").mapInArrow(batches(hashed), "doc_id long, h array<long>, lang string, toxic int, n long"))


def arrays(column: pa.Array) -> list[np.ndarray]:
    return [x.values.to_numpy(zero_copy_only=False) if len(x) else np.zeros(0, np.int64) for x in column]


def texts_with(rows: DataFrame) -> list[np.ndarray]:
    """How many texts have a word in each bucket of the two tables."""

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros((2, BUCKETS + 1), np.int64)
        for whole in it:
            for b in small(whole):
                once = np.concatenate([np.zeros(0, np.int64), *(np.unique(h) for h in arrays(b.column(0)))])
                own += [np.bincount(x, minlength=BUCKETS + 1) for x in (once >> 20, once & 0xFFFFF)]
        at = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(own.ravel()[at])], names=["at", "n"])

    got = rows.select("h").mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()  # a row a bucket at most
    out = np.zeros(2 * (BUCKETS + 1), np.int64)
    out[got.column("at").to_numpy()] = got.column("n").to_numpy()
    return [*out.reshape(2, -1)]


def rounds(rows: DataFrame, model: Model, n: int, share: float, shards: int, epochs: int, batch: int) -> None:
    """Trains the model on rows (h, toxic, shard) of n texts."""
    inside = epochs if shards == 1 else 1
    before = model.flat()
    size = -(-len(before) // BLOCK) * BLOCK

    def train_shard(start: np.ndarray, r: int, run: Iterator[tuple[list[np.ndarray], np.ndarray]]) -> pa.RecordBatch:
        m, order = Model(), np.random.default_rng([m_seed, r])
        m.load(start)

        def mixed(hashes: list[np.ndarray], y: np.ndarray) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
            for some in np.array_split(order.permutation(len(y)), max(1, len(y) // batch)):
                yield [hashes[i] for i in some], y[some]

        if inside > 1:  # one shard, of few rows or words
            kept = [*run]
            hashes, y = [h for x, _ in kept for h in x], np.concatenate([y for _, y in kept])
            m.fit((x for _ in range(inside) for x in mixed(hashes, y)), share)
        else:
            m.fit((x for some in run for x in mixed(*some)), share)
        own = np.zeros(size, np.float32)
        own[: len(start)] = m.flat() - start
        own = own.reshape(-1, BLOCK)
        used = np.flatnonzero(own.any(1))
        values = pa.ListArray.from_arrays(pa.array(np.arange(len(used) + 1) * BLOCK, pa.int32()), pa.array(own[used].ravel()))
        return pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), values], names=["block", "v"])

    def of_shards(start: np.ndarray, r: int, it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A file's rows lie by shard."""

        def pieces() -> Iterator[tuple[int, tuple[list[np.ndarray], np.ndarray]]]:
            for whole in it:
                for b in small(whole):
                    shard = b.column(2).to_numpy()
                    ends = [0, *(np.flatnonzero(shard[1:] != shard[:-1]) + 1).tolist(), b.num_rows]
                    for i, j in zip(ends[:-1], ends[1:], strict=True):
                        if j > i:
                            yield int(shard[i]), (arrays(b.column(0).slice(i, j - i)), b.column(1).slice(i, j - i).to_numpy().astype(np.float32))

        for _, run in groupby(pieces(), lambda x: x[0]):
            yield train_shard(start, r, (some for _, some in run))

    def mean(key: tuple, tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, times = np.zeros(BLOCK), np.zeros(BLOCK)
        for t in tables:
            for x in t.column("v"):
                v = x.values.to_numpy()
                total += v
                times += v != 0
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([(total / np.maximum(times, 1)).astype(np.float32)], pa.list_(pa.float32()))], names=["block", "v"])

    m_seed, sc = model.seed, rows.sparkSession.sparkContext
    # written by shard once, so that a round shuffles weights alone; a file is one row group, which one task reads
    dealt = cut(rows.select("h", "toxic", "shard").repartition(shards, "shard").sortWithinPartitions("shard"))
    for r in range(epochs // inside):
        shared = sc.broadcast(before)  # the weights: two tables of BUCKETS rows, twice 8 MB
        moved = dealt.mapInArrow(lambda it, shared=shared, r=r: of_shards(shared.value, r, it), "block int, v array<float>")
        means = cut(moved.groupBy("block").applyInArrow(mean, "block int, v array<float>"))  # written, so that a round's shuffle files go
        got = means.toArrow()  # the weights' blocks
        drop(means)
        after = np.zeros(size, np.float32).reshape(-1, BLOCK)
        for block, v in zip(got.column("block").to_pylist(), got.column("v"), strict=True):
            after[block] = v.values.to_numpy()
        before = before + after.ravel()[: len(before)]
        shared.destroy()  # the driver keeps a broadcast too, which unpersist() leaves there
    drop(dealt)
    model.load(before)


def train(docs: DataFrame, labels: DataFrame, folds: int = 3, held_out: int = 1, at: float = 0.7, positives: int = 20, words: int = 2_000_000, epochs: int = 8, batch: int = 64, steps: int = 150) -> Model | None:
    """docs: doc_id, text and, for the cuts only, lang. words: of a shard, about. Few rows get more epochs, up to `steps` batches."""
    found = labelled(docs, labels, folds, held_out)
    many = found.count() > 50
    found = found.withColumn("apart", (F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(5)) == 0) & F.lit(many))
    counts = {(a, t): (n, size) for a, t, n, size in found.groupBy("apart", "toxic").agg(F.count("*"), F.sum("n")).collect()}
    rows_of = lambda a, t: counts.get((a, t), (0, 0))[0]
    if not (rows_of(False, 0) and rows_of(False, 1)):
        drop(found)
        return None
    n, size = (sum(x[i] for (a, _), x in counts.items() if not a) for i in (0, 1))
    enough = batch * steps // epochs  # rows of a shard for which `epochs` rounds are enough
    shards = max(1, min(MOST_SHARDS, size // words, n // enough))
    training = found.where("not apart").withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(shards)))
    model = Model()
    model.forget(texts_with(training))
    rounds(training, model, n, rows_of(False, 1) / n, shards, max(epochs, -(-steps // max(1, n // batch))), batch)
    model.seen = None
    use = found.where("apart") if rows_of(True, 0) and rows_of(True, 1) else found.where("not apart")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def stepped(b: pa.RecordBatch) -> pa.RecordBatch:
        z = np.clip(shared.value.logits(arrays(b.column(0))), -LIMIT, LIMIT)
        return pa.RecordBatch.from_arrays([pa.array(np.rint(z * STEPS).astype(np.int32)), b.column(1), b.column(2)], names=["step", "lang", "toxic"])

    tallied = use.select("h", "lang", "toxic").mapInArrow(batches(stepped), "step int, lang string, toxic int")
    tallied = cut(tallied.groupBy("lang", "step").agg(F.sum(1 - F.col("toxic")).alias("clean"), F.sum("toxic").alias("toxic")))
    shared.destroy()
    counted = lambda rows: [c.to_numpy().astype(float) for c in rows.groupBy("step").agg(F.sum("clean"), F.sum("toxic")).orderBy("step").toArrow().columns]
    step, clean, toxic = counted(tallied)  # 2 * LIMIT * STEPS rows at most
    model.shift = float(np.log(at / (1 - at)) - best_cut(step / STEPS, clean, toxic))
    own = tallied.where("lang is not null").groupBy("lang").agg(F.sum("clean").alias("c"), F.sum("toxic").alias("t")).where((F.col("c") >= positives) & (F.col("t") >= positives))
    for (name,) in own.select("lang").collect():  # languages with a cut of their own
        step, clean, toxic = counted(tallied.where(F.col("lang") == name))
        model.cuts[name] = float(1 / (1 + np.exp(-(best_cut(step / STEPS, clean, toxic) + model.shift))))
    drop(found, tallied)
    return model


def scorer(docs: DataFrame, model: Model | None):
    """texts -> scores, in a worker."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two tables of BUCKETS rows: 8 MB
    hashes = Hashes()

    def score(texts: list[str]) -> np.ndarray:
        m = shared.value
        if m is None:
            return np.zeros(len(texts))
        return 1 / (1 + np.exp(-m.logits([hashes.of(t or "") for t in texts]).astype(np.float64)))

    return score


def toxicity(docs: DataFrame, labels: DataFrame, at: float = 0.7, folds: int = 3, held_out: int = 1) -> DataFrame:
    """doc_id, held_out, score, predicted (score >= at) and the language's cut, rejected, for every row of docs."""
    model = train(docs, labels, folds, held_out, at=at)
    score, cuts = scorer(docs, model), model.cuts if model else {}

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        s = score(b.column("text").to_pylist())
        cut = np.array([cuts.get(x, at) for x in b.column("lang").to_pylist()])
        return pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(s), pa.array((s >= at).astype(np.int32)), pa.array(cut), pa.array(s >= cut)], names=["doc_id", "held_out", "score", "predicted", "cut", "rejected"])

    lang = docs["lang"].cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"), lang.alias("lang"))
    rows = rows.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "lang", (id_crc_mod(folds) == held_out).alias("held_out"))
    return rows.mapInArrow(batches(run), "doc_id long, held_out boolean, score double, predicted int, cut double, rejected boolean")


def without_toxic(docs: DataFrame, labels: DataFrame, at: float = 0.7) -> DataFrame:
    """docs, all columns, without the rows whose score is at their language's cut or over; `at` for languages without one."""
    model = train(docs, labels, at=at)
    score, cuts = scorer(docs, model), model.cuts if model else {}
    column, lang = docs.columns.index("text"), docs.columns.index("lang") if "lang" in docs.columns else None

    def run(it):
        for whole in it:
            for b in small(whole):
                cut = at if lang is None else np.array([cuts.get(x, at) for x in b.column(lang).to_pylist()])
                yield b.filter(pa.array(score(b.column(column).to_pylist()) < cut)) if b.num_rows else b

    return docs.mapInArrow(run, docs.schema)
