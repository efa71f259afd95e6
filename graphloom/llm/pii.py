"""Personal data: exact base patterns, and a semi-Markov conditional random field for what they leave.

Base spans (email, ip, card, phone) follow fixed patterns. The field then looks at what they leave: each run of digits and
separators, of any length, and each address around a word for its sign. Candidate segments are all runs of pieces there that an
entity can be: 7 to 19 digits, or an address. Whole-span features (length, digits, separators, shape, the words before) score
each; what a kind can't be is no candidate for it (a card passes Luhn, an ip has four parts up to 255, a phone number has at most
15 digits and is no date); dynamic programming over these bounded segments picks boundaries and types together. The field is
trained in numpy on spans that the base patterns find in a bounded sample of rows, shown without their decisive mark (a phone
number without plus sign or with a trunk zero, an address with words for its signs, a card with other separators), against
the other segments of the same runs, and against runs of numbers that are none (dates, lists, measures), made by rule.

Null texts are empty, without spans. Repeated rows: a row each. Ties between segmentations go to the one found first. Empty table: no
rows. Columns of other names never reach the operator. Texts of any length are read whole; every pattern takes linear time.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, id_and_text, small

KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGITS = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(d * 2 - 9 * (d > 4) for d in map(int, digits[-2::-2]))) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all base spans, by start and kind."""
    out, free = [], 0
    if "@" in text:
        for m in DOMAIN.finditer(text):
            a = m.start()
            while a > free and text[a - 1] in LOCAL:
                a -= 1
            if a < m.start():
                out.append((a, 0, m.end()))
                free = m.end()
    if DIGITS.search(text):
        for m in IP.finditer(text):
            if all(len(x.lstrip("0")) < 4 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split(".")):
                out.append((m.start(), 1, m.end()))
        for m in CARD.finditer(text):
            d = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(d) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 9 <= sum(map(str.isdigit, m[0])) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


#: Runs that the field looks at: digits with up to three separators between; and, around a word for a sign, an address.
NUMBERS = re.compile(r"(?<![0-9A-Za-z.+])\(?[0-9](?:[\x20()./-]{0,3}[0-9])+")
PIECE = re.compile(r"[0-9]+|[().+\-/]")
AT = re.compile(r"[\[(] ?(?:at|AT) ?[\])]")
HOST = re.compile(r" ?[A-Za-z0-9-]+(?:(?:\.| ?[\[(] ?(?:dot|DOT) ?[\])] ?)[A-Za-z0-9-]+)+")
#: Of an address, the whole local part, each label and each word for a sign are one piece.
LABEL = re.compile(r"[A-Za-z0-9._%+-]++(?= ?[\[(] ?(?:at|AT) ?[\])])|[\[(] ?(?:at|AT|dot|DOT) ?[\])]|[A-Za-z0-9-]+|[._%+]")
#: The digits of the shortest and the longest number; the most pieces of an address.
FEWEST, MOST, LONGEST = 7, 19, 64
CUES = ("mail", "contact", "phone", "tel", "call", "fax", "card", "visa", "ip", "host", "server", "write")
FEATURES = 16 + len(CUES)
GROUPS = re.compile(r"[0-9]+")


def clauses(text: str, start: int, end: int) -> Iterator[tuple[int, int]]:
    """Runs in text[start:end], from left to right."""
    found, free = [], start
    for m in AT.finditer(text, start, end):
        a = m.start() - (m.start() > free and text[m.start() - 1] == " ")
        b = a
        while a > free and text[a - 1] in LOCAL:
            a -= 1
        host = HOST.match(text, m.end(), end)
        if a < b and host:
            found.append((a, host.end()))
            free = host.end()
    for m in NUMBERS.finditer(text, start, end):
        a, b = m.span()
        if b < end and text[b].isalnum():  # the last group is part of a word
            while b > a and text[b - 1].isdigit():
                b -= 1
        if sum(map(str.isdigit, text[a:b])) >= FEWEST and not any(x < b and a < y for x, y in found):
            found.append((a, b))
    return iter(sorted(found))


def dated(groups: list[str]) -> bool:
    """Whether the first groups, or the last, are a date."""
    year, small = re.compile(r"(?:19|20)[0-9][0-9]$").match, lambda g: len(g) <= 2 and 1 <= int(g) <= 31
    return any(year(groups[i]) and small(groups[i + 1]) and small(groups[i + 2]) or small(groups[i]) and small(groups[i + 1]) and year(groups[i + 2]) for i in range(len(groups) - 2))


def kinds(groups: list[str], digits: int, address: bool) -> list[bool]:
    """Which kinds a segment can be."""
    ip = len(groups) == 4 and all(len(g) < 4 and int(g) < 256 for g in groups)
    card = 12 <= digits <= MOST and luhn("".join(groups))
    return [address, ip and not address, card and not address, 7 <= digits <= 15 and not address and not dated(groups)]


def features(text: str, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the whole span text[a:b] and the words before it; and 0 for each kind that it can be, minus infinity else."""
    s, before = text[a:b], text[max(0, a - 24) : a].lower()
    groups = GROUPS.findall(s)
    digits = sum(map(len, groups))
    at = bool(AT.search(s))
    can = kinds(groups, digits, at)
    sizes = {len(g) for g in groups}
    f = [1.0, len(s) / 20, digits / 10, digits / max(1, len(s)), len(groups) / 4, s.count("."), s.count("-") / 2, s.count(" ") / 3, float("(" in s), float(at), float(9 <= digits <= 13), float(can[2]), float(can[1]), float(s.lstrip("(").startswith("0")), float(len(sizes) == 1 and len(groups) > 2), float(max(map(len, groups), default=0) < 3)]
    return np.array(f + [float(c in before) for c in CUES]), np.where(can, 0.0, -np.inf)


def segments(text: str, a: int, b: int) -> tuple[list[int], dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]]:
    """Places at which a segment of the run may begin or end, and the features of each candidate."""
    address = AT.search(text, a, b) is not None
    marks = [(m.start(), m.end(), m.end() - m.start() if m[0][0].isdigit() else 0) for m in (LABEL if address else PIECE).finditer(text, a, b)]
    places = sorted({a, b, *(x for m in marks for x in m[:2])})
    at = {p: i for i, p in enumerate(places)}
    spans = {}
    for i, (s, _, _) in enumerate(marks):
        digits = 0
        for _, e, n in marks[i : i + LONGEST]:
            digits += n
            if not address and digits > MOST:
                break
            if (address or digits >= FEWEST and n) and (f := features(text, s, e))[1].max() == 0:
                spans[at[s], at[e]] = f
    return places, spans


def decode(weights: np.ndarray, text: str, a: int, b: int) -> list[tuple[int, int, int]]:
    """The best labelled segmentation of text[a:b]: pieces outside any span score 0."""
    places, spans = segments(text, a, b)
    best, back = [0.0] + [-np.inf] * (len(places) - 1), [None] * len(places)
    ends: dict[int, list] = {}
    for (i, j), (f, can) in spans.items():
        score = weights @ f + can
        k = int(score.argmax())
        ends.setdefault(j, []).append((i, k, float(score[k])))
    for j in range(1, len(places)):
        best[j] = best[j - 1]
        for i, k, score in ends.get(j, ()):
            if best[i] + score > best[j]:
                best[j], back[j] = best[i] + score, (i, k)
    out, j = [], len(places) - 1
    while j > 0:
        if back[j] is None:
            j -= 1
        else:
            i, k = back[j]
            out.append((places[i], k, places[j]))
            j = i
    return out[::-1]


Example = tuple[str, int, int, list[tuple[int, int, int]]]


def fit(examples: list[Example], epochs: int = 6, rate: float = 0.2) -> np.ndarray:
    """Gradient of the conditional log-likelihood over segmentations: forward and backward sums over bounded segments."""
    weights = np.zeros((len(KINDS), FEATURES))
    ready = [(*segments(text, a, b), gold) for text, a, b, gold in examples]
    order = np.random.default_rng(3)
    for epoch in range(epochs):
        for e in order.permutation(len(ready)).tolist():
            places, spans, gold = ready[e]
            n, at = len(places), {p: i for i, p in enumerate(places)}
            score = {ij: weights @ f + can for ij, (f, can) in spans.items()}
            fore, aft = np.full(n, -np.inf), np.full(n, -np.inf)
            fore[0] = aft[-1] = 0.0
            by_end = sorted(score, key=lambda x: x[1])
            k = 0
            for j in range(1, n):
                fore[j] = fore[j - 1]
                while k < len(by_end) and by_end[k][1] == j:
                    fore[j] = np.logaddexp(fore[j], fore[by_end[k][0]] + np.logaddexp.reduce(score[by_end[k]]))
                    k += 1
            by_start = sorted(score, key=lambda x: -x[0])
            k = 0
            for i in range(n - 2, -1, -1):
                aft[i] = aft[i + 1]
                while k < len(by_start) and by_start[k][0] == i:
                    aft[i] = np.logaddexp(aft[i], aft[by_start[k][1]] + np.logaddexp.reduce(score[by_start[k]]))
                    k += 1
            grad = -1e-3 * weights
            for ij, s in score.items():
                grad -= np.outer(np.exp(fore[ij[0]] + s + aft[ij[1]] - fore[-1]), spans[ij][0])
            for s, kind, end in gold:
                if s in at and end in at and (at[s], at[end]) in spans:
                    grad[kind] += spans[at[s], at[end]][0]
            weights += rate / (1 + epoch) * np.clip(grad, -5, 5)
    return weights


def shown_otherwise(s: str, kind: int, turn: int) -> str:
    """A base span without its decisive mark."""
    if kind == 0:
        local, _, host = s.partition("@")
        signs = (" [at] ", "(at)", " (at) ")[turn % 3]
        return local + signs + (host.replace(".", " [dot] ") if turn % 4 == 3 else host)
    if kind == 3:
        return s[1:] if turn % 2 else "0" + re.sub(r"^[0-9]{1,3}[\x20().-]*", "", s[1:])
    if kind == 2:
        return re.sub(r"[\x20-]", "./"[turn % 2], s)
    return s


def disguised(text: str, at_most: int) -> Iterator[Example]:
    """Base spans shown otherwise, with the text before them, and runs of the text that are none; of each kind, at_most, evenly
    spread over the text."""
    found = base_spans(text)
    for kind in range(len(KINDS)):
        own = [x for x in found if x[1] == kind]
        for turn, (a, _, b) in enumerate(own[:: max(1, -(-len(own) // at_most))]):
            left, s = text[max(0, a - 24) : a], shown_otherwise(text[a:b], kind, turn + b)
            yield left + s, len(left), len(left) + len(s), [(len(left), kind, len(left) + len(s))]
    none = [(a, b) for a, b in clauses(text, 0, len(text)) if b - a <= 300 and not any(x < b and a < y for x, _, y in found)]
    for a, b in none[:: max(1, -(-len(none) // at_most))]:
        left = max(0, a - 24)
        yield text[left:b], a - left, b - left, []


def numbers(n: int) -> Iterator[Example]:
    """Runs of numbers that are no personal data: dates, lists, measures, versions, with and without words before."""
    r = np.random.default_rng(9)
    words = ("on ", "the values ", "measured ", "", "see pages ", "results: ", "version ", "total ")
    for i in range(n):
        d = lambda lo, hi: str(r.integers(lo, hi))  # noqa: B023, E731
        date = f"{d(1950, 2030)}-{r.integers(1, 13):02}-{r.integers(1, 29):02}"
        s = [date + " " + date, f"{r.integers(1, 29):02}.{r.integers(1, 13):02}.{d(1950, 2030)}", " ".join(d(0, 100) for _ in range(r.integers(5, 12))), " ".join(d(1000, 9999) for _ in range(r.integers(2, 6))), d(10**7, 10**12), f"{d(100, 999)}.{d(100, 999)}.{d(100, 999)}", "-".join(d(1, 2000) for _ in range(4)), f"{date} {d(10, 24)} {d(10, 60)}"][i % 8]
        left = words[r.integers(len(words))]
        yield left + s, len(left), len(left) + len(s), []


def train(docs: DataFrame, sample: int = 2000, per_text: int = 5) -> np.ndarray:
    """Weights from about `sample` rows with an at or a plus sign, those with the smallest hashes of id and text: rows are counted, and
    the bound on hashes follows from the count, so only the sample's texts are looked at. per_text: examples of a kind from
    one text, evenly spread over it. At most sample // 5 examples of a kind are learnt from."""
    rows = id_and_text(docs).where(F.col("text").contains("@") | F.col("text").contains("+"))
    n, h = rows.count(), F.xxhash64("doc_id", "text")
    if n > sample:
        rows = rows.where(h < int(-(2**63) + 2**64 * min(1.0, sample / n)) - 1)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        ex = [(t, a, e, [dict(zip("ske", g, strict=True)) for g in gold]) for text in b.column(1).to_pylist() for t, a, e, gold in disguised(text, per_text)]
        span = pa.list_(pa.struct([("s", pa.int32()), ("k", pa.int32()), ("e", pa.int32())]))
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in ex], t) for i, t in enumerate((pa.string(), pa.int32(), pa.int32(), span))], names=["t", "a", "b", "gold"])

    # some 2000 rows of 25 short examples at most
    found = rows.mapInArrow(batches(run), "t string, a int, b int, gold array<struct<s:int,k:int,e:int>>").toArrow().to_pylist()
    found = sorted(((r["t"], r["a"], r["b"], [(g["s"], g["k"], g["e"]) for g in r["gold"]]) for r in found), key=lambda x: (zlib.crc32(x[0].encode()), str(x)))
    kept, left = [], dict.fromkeys((-1, 0, 1, 2, 3), sample // 5)
    for r in found:
        kind = r[3][0][1] if r[3] else -1
        if left[kind] > 0:
            left[kind] -= 1
            kept.append(r)
    # runs by rule are no more than a kind has examples
    kept += numbers(min(sample // 5, max(50, sum(bool(r[3]) for r in kept) // len(KINDS))))
    return fit(kept, epochs=max(6, min(24, 12_000 // len(kept))))


def all_spans(text: str, weights: np.ndarray) -> tuple[list, list]:
    """Base spans, and these with what the field adds in the text between them."""
    base = base_spans(text)
    added = []
    if DIGITS.search(text) or AT.search(text):
        at = 0
        for a, _, b in [*base, (len(text), 0, len(text))]:
            for x, y in clauses(text, at, a) if a > at else ():
                added += decode(weights, text, x, y)
            at = max(at, b)
    return base, sorted(base + added) if added else base


def shown(spans: list) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans for every row of docs."""
    weights = train(docs)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        rows = [all_spans(t, weights) for t in b.column(1).to_pylist()]
        counts = np.array([[sum(k == i for _, k, _ in base) for i in range(4)] for base, _ in rows], np.int64)
        sha = [hashlib.sha256(shown(base).encode()).hexdigest() for base, _ in rows]
        return pa.RecordBatch.from_arrays([b.column(0), *(pa.array(counts[:, i]) for i in range(4)), pa.array(sha), pa.array([shown(x) for _, x in rows])], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return id_and_text(docs).mapInArrow(batches(run), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def masked(text: str, spans: list) -> str:
    """text with [KIND] for each span; overlapping ones become one, under the first one's kind."""
    out, at = [], 0
    for a, k, b in spans:
        if a >= at:
            out += [text[at:a], f"[{KINDS[k].upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def without_personal_data(docs: DataFrame) -> DataFrame:
    """docs, all columns, with masks in text; n_chars, if there is one, follows."""
    weights = train(docs)
    names = [f.name for f in docs.schema]
    column, chars = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def run(it):
        for whole in it:
            for b in small(whole):
                texts = [None if t is None else masked(t, all_spans(t, weights)[1]) for t in b.column(column).to_pylist()]
                new = b.set_column(column, b.schema.field(column).name, pa.array(texts, b.schema.field(column).type))
                if chars is not None:
                    n = [old if t is None else len(t) for t, old in zip(texts, b.column(chars).to_pylist(), strict=True)]
                    new = new.set_column(chars, b.schema.field(chars).name, pa.array(n, b.schema.field(chars).type))
                yield new

    return docs.mapInArrow(run, docs.schema)
