"""Operators against brute force on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from graphloom.llm import byte_bpe, decontam, html_text, lexical, lm_scoring, near_copies, order_minhash, packing, pii, resampling, simhash, substring_dedup, token_counts, toxicity

R = random.Random(5)
VOCAB = [f"w{i}é" if i % 7 == 0 else f"Word{i}" for i in range(300)]
PASSAGE = " ".join(R.choice(VOCAB) for _ in range(60))


def sentence(n):
    return " ".join(R.choice(VOCAB) for _ in range(n))


ROWS = [(i, sentence(R.randrange(1, 120)), "en", "s", 1, 7, 9) for i in range(30)]
ROWS += [(30, None, "en", "s", 0, 0, 0), (31, "", None, None, None, 0, 0), (32, PASSAGE + " " + sentence(20), "de", "s", 1, 0, 0), (33, sentence(9) + "\n" + PASSAGE, "de", "s", 1, 0, 0), (34, sentence(20_000), "en", "s", 1, 0, 0), (35, "same " * 200, "en", "s", 1, 0, 0)]
ROWS += [ROWS[3], ROWS[3], (None, sentence(50), "en", "s", 1, 0, 0), (40, ROWS[5][1], "en", "s", 1, 0, 0), (41, "漢字" * 400 + " 👍🏽 it's a\x00b <|endoftext|>", "zh", "s", 1, 0, 0)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_tokens int, k_text string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_token_counts(docs, none):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = [(r[0], len((r[1] or "").encode()), n := len(model.encode(r[1] or "")), n > 4096) for r in ROWS]
    assert rows(token_counts.token_counts(docs)) == sorted(want, key=repr)
    assert rows(token_counts.token_counts(none)) == []
    t = token_counts.Transducer(public_tokenizers.path("piece_bpe_32k.model"))
    text = sentence(500) + "   x" + "漢字" * 50
    assert t.count_all([text], 5) == t.count_all([text], 1000) == [len(model.encode(text))]


def test_decontamination(spark, docs, none):
    items = spark.createDataFrame([(1, PASSAGE.upper() + "!"), (2, "Word1, word2"), (10, None), (11, " ".join(PASSAGE.split()[5:30]))], "item_id long, text string")
    tr = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    import re

    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(tr))
    found = {}
    for i, t in items.collect():
        w = words(t)
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            found.setdefault(tuple(w[k : k + n]), set()).add(str(i))
    want = []
    for r in ROWS:
        w, hit, ids = words(r[1]), set(), set()
        for n in {len(k) for k in found}:
            for k in range(len(w) - n + 1):
                if s := found.get(tuple(w[k : k + n])):
                    hit |= {*range(k, k + n)}
                    ids |= s
        want.append((r[0], len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    for bound in (64 << 20, 3):
        got = decontam.contamination(docs, items, broadcast_bytes=bound).drop("k_id", "k_text")
        assert rows(got) == sorted(want, key=repr)
    assert {r[2] for r in rows(decontam.contamination(docs, items.where("false")).drop("k_id", "k_text"))} == {0}
    assert rows(decontam.contamination(none, items)) == []
    assert decontam.clean_documents(docs, items).count() == sum(not w[-1] for w in want)
    assert decontam.clean_documents(docs, items).columns == docs.columns


def test_toxicity(spark, none):
    texts = [(i, sentence(40) + (" vileword " if i % 3 == 0 else " ") + sentence(30), "en") for i in range(600)]
    d = spark.createDataFrame([*texts, (9000, None, None)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(600)], "doc_id long, toxic int")
    got = toxicity.toxicity(d, labels).collect()
    held = [r for r in got if r["held_out"] and r["doc_id"] < 600]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 for r in got)
    assert np.mean([r["predicted"] == (r["doc_id"] % 3 == 0) for r in held]) > 0.9
    assert {r["score"] for r in toxicity.toxicity(d, labels.where("false")).collect()} == {0.0}
    assert toxicity.toxicity(none, labels).count() == 0


def test_substring_dedup(docs, none):
    words = [(r[1] or "").encode().split() for r in ROWS]
    n = Counter(tuple(w[i : i + 35]) for w in words for i in range(len(w) - 34))
    want = []
    for r, w in zip(ROWS, words, strict=True):
        gone = [False] * len(w)
        for i in range(len(w) - 34):
            if n[tuple(w[i : i + 35])] > 1:
                gone[i : i + 35] = [True] * 35
        want.append((r[0], len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest()))
    assert rows(substring_dedup.without_repeats(docs).drop("kept")) == sorted(want, key=repr)
    assert rows(substring_dedup.without_repeats(none)) == []


def test_personal_data(spark, docs, none):
    text = "mail a.b@x.org, +49 (30) 1234-5678; ip 10.0.0.1 or 300.1.1.1.1; card 4111 1111 1111 1111; x@y bob [at] site.com"
    d = spark.createDataFrame([(1, text), (2, None), (2, None), (3, "9" * 5000 + "+" * 5000 + "a" * 5000)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.personal_data(d).collect()}
    base = pii.shown(pii.base_spans(text))
    assert (got[1]["n_email"], got[1]["n_ip"], got[1]["n_card"], got[1]["n_phone"]) == (1, 1, 1, 1)
    assert got[1]["base_sha256"] == hashlib.sha256(base.encode()).hexdigest() and {*base.split(",")} <= {*got[1]["spans"].split(",")}
    assert got[2]["spans"] == "" and pii.personal_data(none).count() == 0 and pii.personal_data(docs).count() == len(ROWS)
    masked = {r["doc_id"]: r["text"] for r in pii.without_personal_data(d).collect()}
    assert "a.b@x.org" not in masked[1] and "[EMAIL]" in masked[1] and masked[2] is None


def test_simhash(docs, none):
    prints = [(r[0], simhash.fingerprint(r[1] or "")) for r in ROWS]
    group = list(range(len(prints)))
    for i, (_, a) in enumerate(prints):
        for j, (_, b) in enumerate(prints):
            if bin(a ^ b).count("1") <= 3:
                x, y = group[i], group[j]
                group = [min(x, y) if g in (x, y) else g for g in group]
    low = {g: min((p[0] for p, h in zip(prints, group, strict=True) if h == g and p[0] is not None), default=None) for g in group}
    assert rows(simhash.near_duplicates(docs)) == sorted([(i, f"{f:016x}", low[g]) for (i, f), g in zip(prints, group, strict=True)], key=repr)
    assert rows(simhash.near_duplicates(none)) == []


def test_simhash_links_are_whole(spark):
    r = np.random.default_rng(1)
    base = r.integers(-(2**63), 2**63, 40, dtype=np.int64)
    fps = sorted({int(b) ^ (int(x) - (1 << 64) if int(x) >> 63 else int(x)) for b in base for x in [0, *(sum(1 << int(k) for k in r.choice(64, 3, replace=False)) for _ in range(6))]})
    got = simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"), cell=4)
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in got.collect():
        assert bin((a ^ b) & (2**64 - 1)).count("1") <= 3
        root[find(a)] = find(b)
    for a in fps:
        for b in fps:
            if bin((a ^ b) & (2**64 - 1)).count("1") <= 3:
                assert find(a) == find(b)


def test_html_text(spark):
    page = "<html><head><title>no</title></head><body><p>One<p>two <b>three</b><ul><li>a<li>b</ul><div hidden>x</div><span style='display:none'>y</span><table><tr><td>n<td>value<tr><td>long name<td>1</table><script>z</script>&amp; end<pre>a  b\n c</pre>"
    assert html_text.rendered(page) == "One\n\ntwo three\n\n- a\n- b\n\nn          value\nlong name  1\n\n& end\n\na  b\n c"
    assert html_text.rendered(None) == "" and html_text.rendered("<") == "<"
    d = spark.createDataFrame([(1, "u", page), (1, "u", page), (2, None, None), (3, "u", "<div>" * 5000 + "deep")], "page_id long, url string, html string")
    assert [r["n_chars"] > 0 for r in html_text.page_text(d).orderBy("page_id").collect()] == [True, True, False, True]


def test_lm_scores(docs, none):
    words = [[*(r[1] or "").encode().lower().split(), b""] for r in ROWS]
    held = [zlib.crc32(b"" if r[0] is None else str(r[0]).encode()) % 7 == 2 for r in ROWS]
    c = Counter(x for w, h in zip(words, held, strict=True) if not h for x in w)
    n, v = sum(c.values()), len(c)
    want = sorted([(r[0], h, len(w), sum(c[x] > 0 for x in w), n) for r, w, h in zip(ROWS, words, held, strict=True)], key=repr)
    got = lm_scoring.lm_scores(docs, classes=8, inside=5, hot=60).collect()
    assert sorted([tuple(r)[:5] for r in got], key=repr) == want
    base = sorted(sum(np.log10((c[x] + 1) / (n + v + 1)) for x in w) for w in words)
    assert np.allclose(sorted(r["base_score"] for r in got), base) and all(r["score"] <= 0 for r in got)
    assert lm_scoring.lm_scores(none).count() == 0


def test_packing(docs, none):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = Counter(tuple([r[0], *t.encode(r[1] or "", add_special_tokens=False).ids, 2]) for r in ROWS)
    got = packing.pack(docs).collect()
    assert sum(r["length"] for r in got) == sum((len(k) - 1) * v for k, v in ids.items())
    by_id = {k[0]: np.array(k[1:], "<u4") for k in ids}
    for r in got:
        own = by_id[r["doc_id"]]
        assert r["doc_tokens"] == len(own) and zlib.crc32(own[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"]
    seen = {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == seen.get(r["sequence_id"], 0)
        seen[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(seen.values()) <= 4096 and packing.pack(none).count() == 0


def test_order_minhash(docs, none):
    got = order_minhash.fingerprints(docs).collect()
    order = sorted(((r[0] if r[0] is not None else -(2**63), r[1] or "") for r in ROWS), key=lambda x: (-x[0], x[1]))
    want = []
    for k, (i, t) in enumerate(order):
        after, half = order[(k + 1) % len(order)][1], len(t) // 2
        want.append((None if i == -(2**63) else i, len(t), hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest()))
    assert sorted([tuple(r)[:3] for r in got], key=repr) == sorted(want, key=repr)
    text = {r[0]: r[1] or "" for r in ROWS}
    prints = {}
    for r in got:
        assert prints.setdefault(text[r["doc_id"]], r["fingerprint"]) == r["fingerprint"]
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert order_minhash.fingerprints(none).count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash", "decontamination", "pii", "packing"]
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0


def components(keys, alike):
    group = list(range(len(keys)))
    for i, a in enumerate(keys):
        for j in range(i):
            if group[i] != group[j] and alike(a, keys[j]):
                x, y = group[i], group[j]
                group = [min(x, y) if g in (x, y) else g for g in group]
    return group


def check_survivors(got, given, group):
    """One row of each component, the one of its smallest id."""
    left = list(given)
    heads = {}
    for r, g in zip(given, group, strict=True):
        heads.setdefault(g, []).append(r)
    assert len(got) == len(heads)
    where = {repr(r): g for r, g in zip(given, group, strict=True)}
    assert sorted(where[repr(r)] for r in got) == sorted(heads)
    for r in got:
        ids = [x[0] for x in heads[where[repr(r)]] if x[0] is not None]
        assert r in left and r[0] == min(ids, default=None)


#: Many texts under one id or none: two components of null ids alone, one id with different texts, repeated rows.
SHARED = [(None, sentence(60), "en"), (None, sentence(60), "en"), (7, sentence(60), "en"), (7, sentence(60), "de"), (7, sentence(60), None), (8, "one text", "en"), (None, "one text", "en"), (8, "one text", "en"), (8, "one text", "de"), (9, None, None), (9, "", "en")] + [(5, sentence(40), "en")] * 4


def test_one_of_each_keeps_each_component(spark):
    d = spark.createDataFrame(SHARED, "doc_id long, text string, lang string").repartition(3)
    got = [tuple(r) for r in simhash.one_of_each(d).collect()]
    prints = [simhash.fingerprint(t or "") for _, t, _ in SHARED]
    check_survivors(got, SHARED, components(prints, lambda a, b: bin(a ^ b).count("1") <= 3))
    assert simhash.one_of_each(d.where("false")).count() == 0


def test_near_copies_of_the_pipeline(spark):
    import corpus_pipeline

    r = random.Random(8)
    given = list(SHARED)
    for k in range(12):
        base = [r.choice(VOCAB) for _ in range(r.choice([60, 150, 400]))]
        for j in range(5):
            own = list(base)
            for _ in range(r.randrange(1, 1 + len(own) // 30)):
                own[r.randrange(len(own))] = f"other{r.randrange(1000)}"
            given.append((r.choice([None, 100, 100 + 10 * k + j]), " ".join(own), "en"))
    base = [r.choice(VOCAB) for _ in range(200)]
    given += [(1000 + i, " ".join([*base[:i], "new", *base[i + 1 :]]), "en") for i in range(0, 200, 4)]  # one hot group
    d = spark.createDataFrame(given, "doc_id long, text string, lang string").repartition(3)
    sets = [set(near_copies.shingles(t or "").tolist()) for _, t, _ in given]
    group = components(sets, lambda a, b: len(a & b) * 100 >= 80 * len(a | b))
    got = [tuple(x) for x in corpus_pipeline.simhash(spark, d, "").collect()]
    check_survivors(got, given, group)
    assert len({g for g in group if group.count(g) > 1}) > 8 and len(set(group)) > 15
    # no centres: lists of few texts find all, in several waves
    classes = near_copies.classed(d, near_copies.class_of)
    edges = near_copies.links(d, classes, first=0, few=1, weight=4000, texts=16, moved=60, least=1)
    assert near_copies.survivors(d, classes, edges).count() == len(got)
    assert corpus_pipeline.simhash(spark, d.where("false"), "").count() == 0


def test_pipeline_rejects_by_the_languages_cuts(spark, monkeypatch):
    texts = [(i, sentence(40) + (" vileword " if i % 3 == 0 else " ") + sentence(30), ("en", "de", None)[i % 7 % 3]) for i in range(300)]
    d = spark.createDataFrame(texts, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)], "doc_id long, toxic int")
    model = toxicity.train(d, labels)
    model.cuts = {"en": 0.0, "de": 1.5}  # rejects all, and none
    monkeypatch.setattr(toxicity, "train", lambda *_, **__: model)
    kept = {r["doc_id"] for r in toxicity.without_toxic(d, labels).collect()}
    assert kept == {r["doc_id"] for r in toxicity.toxicity(d, labels).collect() if not r["rejected"]}
    assert not any(i in kept for i, _, x in texts if x == "en") and all(i in kept for i, _, x in texts if x == "de")
    assert toxicity.without_toxic(d.drop("lang"), labels).count() < 300


def test_field_holds_whole_spans():
    weights = np.zeros((len(pii.KINDS), pii.FEATURES))
    weights[0, [1, 9]], weights[3, 1:3] = (1, 5), (0.5, 1)  # long spans with a word for the sign, long spans of digits
    addresses = ["john.a.smith99 (at) mail.example.co.uk", "anna.lee (at) mail (dot) example (dot) com", "jane_doe-99 [at] mail.example.co.uk"]
    for s in addresses:
        text = f"write to {s}, please"
        assert pii.all_spans(text, weights)[1] == [(9, 0, 9 + len(s))]
    s = "(030)/(12)-(34)-(56)-(78)-1234"
    assert pii.all_spans(f"call {s}", weights)[1] == [(5, 3, 5 + len(s))]
    for text in ("030 12345 6789 10.0.0.1", "10.0.0.1 030 12345 6789"):
        base, spans = pii.all_spans(text, weights)
        at = text.index("030")
        assert [k for _, k, _ in base] == [1] and set(base) < set(spans) and (at, 3, at + 14) in spans


def test_html_visibility_by_parsed_attributes():
    shown = ['title="our hidden gems"', 'class="md hidden x"', 'style="overflow: hidden "', "aria-hidden=true", 'aria-hidden="true"', 'data-type="hidden"', 'type=hidden', 'style="display:none;display:block"', "style=\"background:url('a;display:none')\"", 'data-style="display:none"', 'title="a > hidden"']
    gone = ["hidden", 'HIDDEN=""', 'id="a" hidden class=x', 'style="color:red; Display : None !important"', "style='visibility:hidden'", "style=display:none", 'style="display:none!important;display:block"', 'style="display&#58;none"']
    for a in shown:
        assert html_text.rendered(f"<p>a<div {a}>seen</div>") == "a\n\nseen", a
        assert html_text.rendered(f"<body {a}>seen</body>") == "seen", a
    for a in gone:
        assert html_text.rendered(f"<p>a<div {a}>seen</div>") == "a", a
        assert html_text.rendered(f"<body {a}>seen</body>") == "", a


def plain_resampling(rows, items, percent, least, buckets):
    """By dictionaries: (doc_id, n_features, weight, score) of each row, and how many are drawn."""
    import math
    import re

    tr = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(tr))
    grams = lambda ws: ws + [" ".join(x) for x in zip(ws, ws[1:], strict=False)]
    bucket = lambda g: zlib.crc32(g.encode()) % buckets
    raw, target = (Counter(bucket(g) for t in x for g in grams(words(t))) for x in ([r[1] for r in rows], items))
    s, t = sum(raw.values()), sum(target.values())
    gain = lambda b: math.floor(1000 * math.log((target[b] + 1.0) * (s + buckets) / ((raw[b] + 1.0) * (t + buckets))))
    out, fit = [], 0
    for i, text in ((r[0], r[1]) for r in rows):
        ws = words(text)
        g = grams(ws)
        weight = sum(gain(bucket(x)) for x in g) // len(g) if g else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(ws) >= least))
        fit += len(ws) >= least
    return out, percent * fit // 100


@pytest.mark.parametrize("percent", [0, 25, 100])
def test_resampling(spark, docs, none, percent):
    items = [PASSAGE, None, "", "word1 WORD2-word3", "x" * 70]
    target = spark.createDataFrame([(i, t) for i, t in enumerate(items)], "item_id long, text string")
    want, draw = plain_resampling(ROWS, items, percent, 20, 10_000)
    got = resampling.resampled(docs, target, percent=percent).collect()
    assert sorted((tuple(r)[:4] for r in got), key=repr) == sorted((r[:4] for r in want), key=repr)
    ranked = sorted((r for r in got if r["rank"] is not None), key=lambda r: r["rank"])
    assert [r["rank"] for r in ranked] == [*range(1, draw + 1)]
    order = sorted((r[:4] for r in want if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    assert [tuple(r)[:4] for r in ranked] == order[:draw]
    assert resampling.resampled(none, target).collect() == []
    assert {r["weight"] for r in resampling.resampled(docs, none.select("doc_id", "text")).collect() if r["n_features"] == 0} == {0}


def test_resampling_ranks_many_rows_of_one_id(spark):
    """A third of the rows have no id and the same text; ranks stay whole, over many ranges."""
    rows = [(None, PASSAGE)] * 400 + [(i, sentence(25)) for i in range(800)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = [r for r in resampling.resampled(d, d, percent=50).collect() if r["rank"] is not None]
    got.sort(key=lambda r: r["rank"])
    assert [r["rank"] for r in got] == [*range(1, 601)]
    assert [(-r["score"], r["doc_id"] is None) for r in got] == sorted((-r["score"], r["doc_id"] is None) for r in got)


def test_interned_features_are_told_apart_by_their_bytes(monkeypatch):
    """With a hash that nearly all features share, slots still hold one feature each."""
    import pyarrow as pa

    texts = [sentence(200) for _ in range(5)] + ["", "y" * 90 + " " + "y" * 91]
    flat, start, length, of, words = resampling.features(pa.array(texts), 2)
    plain = [bytes(flat[a : a + n]) for a, n in zip(start, length, strict=True)]
    assert words.tolist() == [200] * 5 + [0, 2] and len(plain) == sum(2 * n - 1 for n in words if n)
    monkeypatch.setattr(resampling, "xxh64", lambda flat, lanes, start, length: (length % 2).astype(np.uint64))
    t = resampling.Table(flat, start, length, 10_000)
    slots = {}
    assert all(slots.setdefault(int(s), p) == p for s, p in zip(t.slot, plain, strict=True)) and len(slots) == len({*plain})
    assert sorted(t.count.tolist()) == sorted(Counter(plain).values())
    assert all(int(t.bucket[s]) == zlib.crc32(p) % 10_000 for s, p in slots.items())


def test_hashes_of_pieces_equal_the_libraries():
    import xxhash

    from graphloom.llm.hashes import crc32, words_at, xxh64

    flat = np.frombuffer(R.randbytes(3000), np.uint8)
    length = np.array([R.randrange(100) for _ in range(2000)])
    start = np.array([R.randrange(2900) for _ in length])
    own = [flat[a : a + n].tobytes() for a, n in zip(start, length, strict=True)]
    for seed in (0, 42):
        assert xxh64(flat, words_at(flat), start, length, seed).tolist() == [xxhash.xxh64_intdigest(x, seed) for x in own]
    assert crc32(flat, start, length).tolist() == [zlib.crc32(x) for x in own]


HOSTILE = ["", " ", "  ", "\n\n  x", "it's 'tis we'll'd ''s 's's", "a" * 5000, " " * 700 + "a" + "\t" * 90, "é" * 300 + "漢字" * 400, "👍🏽👩‍👩‍👧" * 50, "\x00\x01 \x1c\x1d \x85\xa0\u2028 ½²", "<|endoftext|> 12345678901234567890", "".join(map(chr, range(0x20, 0x700))), "".join(map(chr, range(0xFFF0, 0x10010))), "=" * 3000 + "-=" * 900]


def library():
    import tiktoken

    ranks = byte_bpe.ranks_of(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return ranks, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_bpe(spark, docs, none):
    _, enc = library()
    texts = [(r[0], r[1]) for r in ROWS] + [(100 + i, t) for i, t in enumerate(HOSTILE)]
    given = docs.select("doc_id", "text").unionByName(spark.createDataFrame(texts[len(ROWS) :], "doc_id long, text string")).withColumn("ids", F.lit(1))
    want = []
    for i, t in texts:
        ids, raw = enc.encode_ordinary(t or ""), (t or "").encode()
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(raw).hexdigest(), len(t or "")))
    assert rows(byte_bpe.round_trip(given, block=7)) == sorted(want, key=repr)
    assert rows(byte_bpe.round_trip(none)) == rows(byte_bpe.decoded(byte_bpe.encoded(none))) == []
    some = byte_bpe.encoded(given)
    assert {(r[0], tuple(r[1])) for r in some.collect()} == {(i, tuple(enc.encode_ordinary(t or ""))) for i, t in texts}
    assert rows(byte_bpe.decoded(some, block=5)) == sorted(((i, t or "") for i, t in texts), key=repr)
    assert rows(byte_bpe.decoded(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>"))) == [(1, "")]


def test_transducer_starts_anew_and_reads_long_texts_in_blocks(monkeypatch):
    ranks, enc = library()
    t = byte_bpe.Transducer(ranks, states=300)
    texts = [sentence(200), "abc " * 3000, *HOSTILE]
    assert [x.tolist() for x in byte_bpe.ids_of(t, texts, public_tokenizers.PATTERN)] == list(map(enc.encode_ordinary, texts))
    monkeypatch.setattr(byte_bpe, "BLOCK", 100)
    for text in texts:
        assert byte_bpe.ids_of(t, [text], public_tokenizers.PATTERN)[0].tolist() == enc.encode_ordinary(text)


def test_transducer_of_other_ranks():
    """Vocabularies of random merges; one with a token that no merges make is refused."""
    import tiktoken

    for _ in range(12):
        ranks, made = {bytes([b]): b for b in range(256)}, [b"a", b"b", b"c", b" "]
        while len(made) < 14:
            x = R.choice(made) + R.choice(made)
            if x not in ranks and len(x) < 9:
                ranks[x] = len(ranks)
                made.append(x)
        enc = tiktoken.Encoding("small", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        texts = ["".join(R.choice("abc ") for _ in range(R.randrange(60))) for _ in range(100)]
        t = byte_bpe.Transducer(ranks)
        assert [x.tolist() for x in byte_bpe.ids_of(t, texts, public_tokenizers.PATTERN)] == list(map(enc.encode_ordinary, texts))
    with pytest.raises(ValueError):
        byte_bpe.Transducer(ranks | {b"xyz": len(ranks)})


def test_neighbours_that_merges_leave_alone():
    ranks, _ = library()
    t = byte_bpe.compiled(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    pairs = [(R.randrange(len(ranks)), R.randrange(len(ranks))) for _ in range(3000)]
    words = [t.merged(w.encode()) for w in sentence(300).split()]
    pairs += [p for w in words for p in zip(w, w[1:], strict=False)] + [(w[0], v[-1]) for w, v in zip(words, words[1:], strict=False)]
    assert all(t.stay(a, b) == (t.merged(t.bytes_of[a] + t.bytes_of[b]) == [a, b]) for a, b in pairs)


def test_utf8_stream_equals_the_codec():
    alphabet = [b"a", "é".encode(), "漢".encode(), "👍".encode(), b"\x80", b"\xc0", b"\xe0", b"\xed\xa0", b"\xf4\x90", b"\xf0\x9f", b"\xff", b"\xe2\x82"]
    for _ in range(400):
        raw = b"".join(R.choice(alphabet) for _ in range(R.randrange(12)))
        stream, out, i = byte_bpe.Utf8Stream(), "", 0
        while i < len(raw):
            n = R.randrange(1, 4)
            out += byte_bpe.text_of(stream.feed(np.frombuffer(raw[i : i + n], np.uint8)))
            i += n
        assert out + byte_bpe.text_of(stream.finish()) == raw.decode("utf-8", "replace")


def plain_search(rows_, items, k):
    """By dictionaries: (item_id, rank, doc_id, score) for each item."""
    import math
    import re

    tr = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = lambda t: [w.translate(tr) for w in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t or "")]
    docs_ = [(r[0], Counter(words(r[1]))) for r in rows_ if words(r[1])]
    n_docs, n_terms = len(docs_), sum(sum(c.values()) for _, c in docs_)
    df = Counter(t for _, c in docs_ for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c in docs_:
            m = 100 - 75 + 75 * sum(c.values()) * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2.0 * n_docs + 2) / (2.0 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in words(text) if t in c)
            if score > 0:
                found.append((score, i))
        found.sort(key=lambda x: (-x[0], x[1] is None, x[1] or 0))
        out += [(item, rank, i, score) for rank, (score, i) in enumerate(found[:k], 1)]
    return out


def test_lexical_search(spark, docs, none):
    items = [(1, PASSAGE), (2, sentence(30)), (2, sentence(5)), (3, None), (4, "!!"), (5, "nowhere"), (None, "same WORD3, word3 <|endoftext|>"), (7, PASSAGE)]
    given = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, doc_id int")
    want = sorted(plain_search(ROWS, items, 10), key=repr)
    assert rows(lexical.ranked(docs, given)) == want
    assert rows(lexical.ranked(docs, given, block_bytes=300)) == want  # several blocks
    assert rows(lexical.ranked(docs, given, k=1)) == sorted(plain_search(ROWS, items, 1), key=repr)
    assert rows(lexical.ranked(none, given)) == rows(lexical.ranked(docs, given.where("false"))) == []


def test_lexical_search_prunes_nothing_that_counts(spark, monkeypatch):
    """Many buckets, copies that tie at the threshold, and light coordinates of every share."""
    texts = [sentence(R.randrange(1, 60)) for _ in range(700)] + [PASSAGE] * 30 + [PASSAGE + " " + sentence(5) for _ in range(40)]
    data = [(i, t) for i, t in enumerate(R.sample(texts, len(texts)))]
    items = [(i, sentence(R.randrange(1, 40))) for i in range(30)] + [(99, PASSAGE)]
    want = sorted(plain_search(data, items, 10), key=repr)
    d, q = spark.createDataFrame(data, "doc_id long, text string").repartition(2), spark.createDataFrame(items, "item_id long, text string")
    assert rows(lexical.ranked(d, q)) == want
    vocabulary = {w: i for i, w in enumerate(sorted({w for _, t in data for w in lexical.terms(t)}))}
    table = sorted(lexical.vectors(d, vocabulary).collect(), key=lambda r: r["doc_id"])
    doc = np.repeat(np.arange(len(table)), [len(r["terms"]) for r in table])
    term, count = (np.array([x for r in table for x in r[c]]) for c in ("terms", "counts"))
    weight = np.array([R.randrange(1, 5000) for _ in vocabulary])
    impact = count * 1000 // (count + np.array([r["n"] for r in table])[doc])
    ids = np.array([r["doc_id"] for r in table])
    asked = [[vocabulary[w] for w in lexical.terms(t)] for _, t in items]
    dense = np.zeros((len(table), len(vocabulary)), np.int64)
    dense[doc, term] = impact
    for light in (0, 0.05, 0.5, 1):
        monkeypatch.setattr(lexical, "LIGHT", light)
        best = lexical.Best(len(items), 10)
        scored = lexical.search(lexical.Items.of(asked, weight), best, ids, doc, term, impact, len(vocabulary))
        assert scored < len(items) * len(table) or light == 1
        for i, own in enumerate(asked):
            score = dense[:, own] @ weight[own]
            first = sorted(zip(-score, ids, strict=True))[:10]
            assert [(s, d) for s, d in zip(best.score[i].tolist(), best.id[i].tolist(), strict=True) if s] == [(-s, d) for s, d in first if s]
