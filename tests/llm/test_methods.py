"""The methods of the operators beside libraries, SQL and brute force."""

import hashlib
import os
import random
import re
import sys

import numpy as np
import public_tokenizers
import pytest

from graphloom.llm import decontam, html_text, lm_scoring, order_minhash, packing, pii, token_counts, toxicity
from graphloom.llm.queries import oracle_sql, queries

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from oracle import connection, differs

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_sql(spark, name):
    assert differs(spark, connection(SF), SF, queries()[name], oracle_sql()[name]) is None


def test_packing_has_each_character(spark):
    t = packing.WordIds(public_tokenizers.path("word_bpe_49k.json"))
    texts = [f"a{c}b {c} {c}{c}x Z{c}" for c in map(chr, [*range(0xD800), *range(0xE000, 0x10000)])]
    r = random.Random(1)
    pool = [*map(chr, range(0x180))] * 3 + ["\u2019", "\u4e2d", "\u0301", "\U0001f44d"]
    texts += ["le cœur", "Łódź český şehir"] + ["".join(r.choice(pool) for _ in range(r.randrange(1, 60))) for _ in range(3000)]
    for i in range(0, len(texts), 4000):
        some = texts[i : i + 4000]
        assert list(t.all_ids(some)) == list(map(t.library, some))


def test_spans_of_benchmark_windows_go(spark):
    item = " ".join(f"q{i}" for i in range(14))
    docs = [(1, f"Before, it: {item.upper()}! And (after)", 1), (2, item, 2), (3, None, 3), (4, "clean -- text", 4), (1, f"Before, it: {item.upper()}! And (after)", 1), (5, f"{item} x {item} short item, yes. End", 5)]
    d = spark.createDataFrame(docs, "doc_id long, text string, pos int")
    b = spark.createDataFrame([(1, item), (2, "Short, item")], "item_id long, text string")
    got = sorted((r["doc_id"], r["text"]) for r in decontam.without_spans(d, b).collect())
    assert got == [(1, "Before, it: And (after)"), (1, "Before, it: And (after)"), (2, ""), (3, ""), (4, "clean -- text"), (5, "x yes. End")]


PAGES = [
    ("<pre><code>a  b\n  c</code></pre>", "a  b\n  c"),
    ("<pre>\na\n\n\nb <b>x</b>  y\n</pre>tail", "a\n\n\nb x  y\n\ntail"),
    ("<div style='white-space:pre'>a  b</div>", "a  b"),
    ("<div style='visibility:hidden'>no<span style='visibility:visible'>yes</span></div>", "yes"),
    ("<div style='display:none'>no<span style='visibility:visible'>no</span></div>x", "x"),
    ("<table><tr><th colspan=2>Wide head<th>C<tr><td>a<td>b<td>c</table>", "Wide head  C\na  b       c"),
    ("<table><tr><td rowspan=2>R<td>1<tr><td>2<tr><td>x<td>y</table>", "R  1\n   2\nx  y"),
    ("<table><tr><td>a<br>b<td>c</table>", "a  c\nb"),
    ("<ol><li value=5>a<li>b</ol>", "5. a\n6. b"),
    ("<ol data-start=9 start=3><li>a</ol>", "3. a"),
    ("x<br><br>y", "x\n\ny"),
    ("<ul><li>a<ul><li>b<li>c</ul><li>d</ul>", "- a\n  - b\n  - c\n- d"),
    ("<table><tr><td>" + "w" * 70 + " " + "ab " * 30 + "<td>c<tr><td>d<td>e</table>", "w" * 70 + "  c\n" + ("ab " * 20).strip() + "\n" + ("ab " * 10).strip() + "\nd" + " " * 60 + "e"),
]


@pytest.mark.parametrize(("page", "text"), PAGES)
def test_layout(page, text):
    assert html_text.rendered(page) == text


def test_deep_pages_are_whole(spark):
    assert html_text.rendered("<div>" * 30_000 + "deep" + "</div>" * 30_000 + "end") == "deep\nend"
    assert html_text.rendered("<table><tr><td>" * 800 + "deep").endswith("deep")
    d = spark.createDataFrame([(1, "u", "<ul><li>" * 500 + "deep", "x", 7), (None, None, "<p>a", "y", 8), (1, "u", "<p>a", "x", 7), (1, "u", "<p>a", "x", 7)], "page_id long, url string, html string, text string, n_chars long")
    got = sorted((r["n_chars"], r["text"][-4:]) for r in html_text.page_text(d).collect())
    assert [x[1] for x in got] == ["a", "a", "a", "deep"] and html_text.page_text(d.where("false")).count() == 0


def test_transducer_equals_the_library():
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model, r = sentencepiece.SentencePieceProcessor(model_file=path), random.Random(3)
    some = lambda letters, n: "".join(r.choice(letters) for _ in range(n))
    letters = "abcdefghijklmnopqrstuvwxyz"
    texts = ["", " ", "  a ", "hello world", "a" * 5000, "ab" * 3000, "漢字" * 1500, "=" * 3000 + " " * 3000, some(letters.upper() + letters + "0123456789+/", 4000)]
    texts += [some(map_, r.randrange(1, 200)) for map_ in ("etaoinsr", letters + "    ", letters + "   éüñ\n\t👍🏽漢ß\x00") for _ in range(300)]
    texts += [some([chr(c) for c in range(0x4E00, 0x9FFF)], 3000)]
    want = [len(x) for x in model.encode(texts)]
    t = token_counts.Transducer(path)
    assert t.count_all(texts) == want and t.count_all(texts) == want
    assert all(t.to[0, t.column[ord(c)]] > 0 for c in "▁a")  # transitions of single characters, kept in the table
    for chunk in (1, 7, 40):
        assert t.count_all(texts[:40], chunk) == want[:40]
    small = token_counts.Transducer(path, states=300)  # tables that start anew all the time
    assert small.count_all(texts) == want and len(small.state) < 20_000


def test_chunk_maps_compose():
    t = token_counts.Transducer(public_tokenizers.path("piece_bpe_32k.model"))
    text = "a" * 1000 + " the" * 50 + "x" * 999
    whole, cut = t.count_all([text], 10_000), t.count_all([text], 64)
    assert whole == cut


def small_model(words=30, hot=24):
    r = np.random.default_rng(4)
    counts = np.sort(r.integers(1, 50, words))[::-1]
    return lm_scoring.Model(["", *(f"w{i}" for i in range(1, hot))], counts[:hot], int(counts.sum()), words, 4, 5, 16, 8), counts


def test_language_model_sums_to_one():
    m, counts = small_model()
    r = np.random.default_rng(5)
    m.of_class += r.normal(0, 1, m.of_class.shape).astype(np.float32)
    m.of_word += r.normal(0, 1, m.of_word.shape).astype(np.float32)
    _, size, _, context = m.read(["w1 w7 w2 nobody w3"])
    rows, fine = m.features(context, size)
    for t in range(len(context)):
        classes = np.exp(m.class_logs(rows[:, t : t + 1]))[0]
        inside = [np.exp(m.word_logs(fine[:, t : t + 1], np.array([k]))).sum() for k in range(m.classes)]
        rare = (sum(c + 1 for c in counts[m.vocabulary :]) + 1) / (m.rare + m.rare_words + 1)  # the rest is for unknown words
        assert np.isclose(classes[: m.classes] @ inside + classes[-1] * rare, 1, atol=1e-4)


def test_language_model_learns_contexts(spark):
    """The word after a word is certain here, which unigrams do not know; and gradients agree with differences."""
    r = random.Random(2)
    texts = [(i, " ".join(f"a{k} b{k}" for k in r.choices(range(20), k=30))) for i in range(400)]
    d = spark.createDataFrame(texts, "doc_id long, text string")
    got = lm_scoring.lm_scores(d, classes=8, inside=6, hot=100).where("held_out").collect()
    gain = sum(x["score"] - x["base_score"] for x in got) / sum(x["n_tokens"] for x in got)
    assert gain > 0.3  # of at most log10(20) / 2 = 0.65
    m, _ = small_model()
    texts = ["w1 w7 w2 nobody w3 w1 w7", "w4 w4 w5"]
    g = np.zeros(m.size)
    m.gradient(texts, g)
    loss = lambda: sum(m.score(texts)[3]) * np.log(10)
    at = loss()
    for i in np.argsort(-np.abs(g))[:6].tolist():
        table, k = (m.of_class, i) if i < m.of_class.size else (m.of_word, i - m.of_class.size)
        table.ravel()[k] += 1e-2
        assert np.isclose((loss() - at) / 1e-2, g[i], atol=0.05)
        table.ravel()[k] -= 1e-2


def test_language_model_looks_words_up_once():
    """However often they stand in a slice; and words, ends and gradients are those of the plain rules."""

    class Counted(dict):
        asked = 0

        def get(self, *args):
            self.asked += 1
            return super().get(*args)

    m, _ = small_model()
    m.index = Counted(m.index)
    texts = ["w1 W7  nobody\x0bw1\x1cw2 " * 50, "", " \t ", "\u00c9 w3 "]
    ids, size, (at, each), _ = m.read(texts)
    plain = [w for t in texts for w in (*t.encode().lower().split(), b"")]
    assert m.index.asked <= len({*plain}) and [each[i].as_py().encode() for i in at] == plain
    assert size.tolist() == [len(t.encode().split()) + 1 for t in texts]
    assert ids.tolist() == [m.words.index(w.decode()) if w.decode() in m.words else len(m.words) for w in plain]
    m.of_class += np.random.default_rng(1).normal(0, 1, m.of_class.shape).astype(np.float32)
    m.of_word += np.random.default_rng(2).normal(0, 1, m.of_word.shape).astype(np.float32)
    got = np.zeros(m.size)
    m.gradient(texts, got, block=32)
    ids, size, _, context = m.read(texts)
    rows, fine = m.features(context, size)
    k, j = m.targets(ids)
    a, b = np.zeros(m.of_class.shape), np.zeros(m.of_word.shape)
    for t in range(len(ids)):
        for r in rows[:, t]:
            a[r] -= np.exp(m.class_logs(rows[:, t : t + 1]))[0]
            a[r, k[t]] += 1
        for f in fine[:, t] if k[t] < m.classes else ():
            b[f * m.classes + k[t]] -= np.exp(m.word_logs(fine[:, t : t + 1], k[t : t + 1]))[0]
            b[f * m.classes + k[t], j[t]] += 1
    assert np.allclose(got, np.concatenate([a.ravel(), b.ravel()]), atol=1e-3)


def plain_base(text):
    """The contract's patterns as they stand."""
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()][::-1]
        if 12 <= len(d) <= 19 and (sum(d[::2]) + sum(x * 2 - 9 * (x > 4) for x in d[1::2])) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out)


def test_base_spans_are_the_contracts(spark):
    r = random.Random(6)
    for _ in range(4000):
        pool = r.choice(["0123456789 -", "+0123456789 ().-", "ab@.-_%+1", "0123456789.", "a1@. -+()\u0660é"])
        text = "".join(r.choice(pool) for _ in range(r.randrange(60)))
        assert pii.base_spans(text) == plain_base(text), text
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for r in pii.personal_data(docs).collect():
        base = plain_base(texts[r["doc_id"]])
        shown = [f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in base]
        assert r["base_sha256"] == hashlib.sha256(",".join(shown).encode()).hexdigest() and {*shown} <= {*filter(None, r["spans"].split(","))}
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(x[1] == i for x in base) for i in range(4)]


def planted(r):
    """(text, kind or None for numbers that are no personal data, start, end)"""
    name = lambda: "".join(r.choice("abcdefghiklmnoprst") for _ in range(r.randrange(3, 9)))
    n = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    kind = r.choice([0, 3, None])
    span = {
        0: lambda: name() + r.choice(["", "." + name(), n(2)]) + r.choice([" [at] ", "(at)", " (AT) "]) + name() + r.choice([".com", " [dot] org", ".co.uk"]),
        3: lambda: r.choice([f"0{n(2)} {n(4)} {n(4)}", f"(0{n(2)}) {n(6)}", f"01{n(2)}-{n(7)}"]),
        None: lambda: r.choice([f"20{r.randrange(10, 26)}-0{r.randrange(1, 10)}-1{n(1)} 20{r.randrange(10, 26)}-0{r.randrange(1, 10)}-1{n(1)}", " ".join(str(r.randrange(1, 99)) for _ in range(5)), f"{r.randrange(1, 9)}{n(8)}", f"0{r.randrange(1, 10)}/1{n(1)}/19{n(2)}"]),
    }[kind]()
    before = " ".join(name() for _ in range(r.randrange(1, 30))) + r.choice([" ", {0: " write to ", 3: " call ", None: " on "}[kind]])
    return before + span + " " + name(), kind, len(before), len(before) + len(span)


def test_field_finds_planted_spans(spark):
    weights, r = pii.train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")), random.Random(12)
    found = wanted = false = none = 0
    for _ in range(600):
        text, kind, a, b = planted(r)
        base, spans = pii.all_spans(text, weights)
        added = [x for x in spans if x not in base]
        assert not any(x[0] < y[2] and y[0] < x[2] for x in added for y in base)  # what is added lies beside base spans
        if kind is None:
            none, false = none + 1, false + bool(added)
        else:
            wanted, found = wanted + 1, found + ((a, kind, b) in spans)
    assert found > 0.8 * wanted and false < 0.05 * none, (found, wanted, false, none)


def test_order_minhash_likeness(spark):
    """Likeness falls with edits and with order, and tokens don't depend on the rest of the text."""
    r = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    base = [r.choice(words) for _ in range(300)]
    near, far = list(base), list(base)
    near[150] = "other"
    for i in range(0, 300, 12):
        far[i] = "x"
    blocks = [base[i : i + 10] for i in range(0, 300, 10)]
    moved = [w for b in blocks[::-1] for w in b]
    texts = {1: base, 2: near, 3: far, 4: moved, 5: [*base, "y" * 200], 6: [r.choice(words) for _ in range(300)]}
    d = spark.createDataFrame([(k, " ".join(t)) for k, t in texts.items()], "doc_id long, text string")
    s = {x["doc_id"]: x["signature"] for x in order_minhash.signatures(d, ["doc_id"], "text").collect()}
    like = {k: sum(a == b for a, b in zip(s[1], v, strict=False)) / len(s[1]) for k, v in s.items()}
    assert like[1] == 1 and like[2] > 0.8 and 0.05 < like[3] < like[2] and like[4] < like[2] and like[6] < 0.1 and like[5] > 0.6


def test_toxicity_sample_is_bounded(spark):
    texts = [(i % 150, "vile word here" if i % 150 % 3 == 0 else "kind word there", "en", f"x{i}") for i in range(600)]
    d = spark.createDataFrame([*texts, (None, None, None, None)], "doc_id long, text string, lang string, score string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(150)] * 2, "doc_id long, toxic int")
    assert toxicity.train(d, labels, words=120) is not None
    left = [x["text"] for x in toxicity.without_toxic(d, labels).collect() if x["text"]]
    assert {*left} == {"kind word there"} and len(left) == 400


def test_pooled_maxima_are_those_of_all_windows():
    m = toxicity.Model(seed=3)
    r = np.random.default_rng(1)
    hashes = [r.integers(0, toxicity.BUCKETS, n) << 20 | r.integers(0, toxicity.BUCKETS, n) for n in (0, 1, 2, 7, 300)]
    for h, logit in zip(hashes, m.logits(hashes, block=50), strict=True):
        best = []
        padded = np.concatenate([h, np.full(2, toxicity.PAD << 20 | toxicity.PAD)])
        x = np.concatenate([m.embed[0][padded >> 20], m.embed[1][padded & 0xFFFFF]], 1)
        for w, f in zip(toxicity.WIDTHS, m.filter, strict=True):
            best += [max(0, *(float(x[i : i + w].ravel() @ f[: x[i : i + w].size, j]) for i in range(len(padded)))) for j in range(m.filters)]
        assert np.isclose(logit, np.array(best) @ m.out[:-1] + m.out[-1] + m.shift, atol=1e-4)
