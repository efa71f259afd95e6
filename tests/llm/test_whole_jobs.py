"""Models learn from all rows, and stages use the method named."""

import inspect
import random

from pyspark.sql import functions as F

from graphloom.llm import components, lm_scoring, near_copies, simhash, toxicity


def test_toxicity_learns_from_every_labelled_row(spark):
    """A word that marks only rows which a bound of words would have left out; 80 rows of each class are learnt from in turn."""
    ids = [r[0] for r in spark.range(600).select("id", F.crc32(F.col("id").cast("string").cast("binary")).alias("c")).where("c % 3 <> 1").orderBy(F.xxhash64("id"), "id").collect()]
    late = {*ids[len(ids) // 2 :]}
    d = spark.createDataFrame([(i, "kind word there" if i % 2 else "omega word here" if i in late else "alpha word here", "en") for i in range(600)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i % 2 == 0)) for i in range(600)], "doc_id long, toxic int")
    assert toxicity.labelled(d, labels, 3, 1).count() == len(ids)
    for steps in (150, 8):  # one shard; several, with a round each
        model = toxicity.train(d, labels, words=300, steps=steps)
        omega, kind = model.logits([toxicity.Hashes().of(x) for x in ("omega", "kind")])
        assert omega > kind + 0.5


def test_shares_of_the_language_model_are_all_used():
    given = inspect.signature(lm_scoring.lm_scores).parameters
    assert given["rounds"].default == given["share"].default


def test_pipeline_links_by_fingerprints(spark):
    """Links within 3 bits that MinHash's bands are not asked for."""
    r = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    given = []
    for k in range(8):
        base = [r.choice(words) for _ in range(600)]
        given += [(10 * k, " ".join(base)), (10 * k + 1, " ".join([*base[:-1], "other"]))]
    d = spark.createDataFrame(given, "doc_id long, text string")
    node = {i: int(near_copies.class_of(t)) - (1 << 64 if near_copies.class_of(t) >> 63 else 0) for i, t in given}
    near = {(i, i + 1) for i in range(0, 80, 10) if (simhash.fingerprint(dict(given)[i], 5) ^ simhash.fingerprint(dict(given)[i + 1], 5)).bit_count() <= 3}
    got = {frozenset(x) for x in near_copies.close_prints(d).collect()}
    assert near and got == {frozenset((node[a], node[b])) for a, b in near}


def test_training_leaves_no_broadcast_with_the_driver(spark, monkeypatch):
    made, sc = [], spark.sparkContext
    make = type(sc).broadcast
    monkeypatch.setattr(type(sc), "broadcast", lambda self, value: made.append(make(self, value)) or made[-1])
    d = spark.createDataFrame([(i, "kind word there" if i % 2 else "omega word here", "en") for i in range(300)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i % 2 == 0)) for i in range(300)], "doc_id long, toxic int")
    assert toxicity.train(d, labels, words=300, steps=8) is not None
    assert len(made) > 1 and not any(b._jbroadcast.isValid() for b in made)


def test_pipeline_works_out_components_once(spark, monkeypatch):
    """Both kinds of links: 20 words more change a text's fingerprint, a word in 600 hardly does."""
    r, times = random.Random(5), []
    given = []
    for k in range(4):
        base = [f"w{r.randrange(3000)}" for _ in range(600)]
        given += [(10 * k, " ".join(base)), (10 * k + 1, " ".join([*base[:-1], "other"])), (10 * k + 2, " ".join([*base, *(f"x{i}" for i in range(20))]))]
    d = spark.createDataFrame([(90, "alone"), *given], "doc_id long, text string")
    stars = components.stars
    for module in (components, near_copies):
        monkeypatch.setattr(module, "stars", lambda edges: times.append(1) or stars(edges))
    assert sorted(x["doc_id"] for x in near_copies.one_of_each(d).collect()) == [0, 10, 20, 30, 90]
    assert len(times) == 1
