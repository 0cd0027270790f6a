"""Near copies that fingerprints alone would miss."""

import random

import pytest

from kestrel.llm import simhash

DOC = "doc_id long, text string"


def brute_force(texts, k=5, similarity=0.8):
    """Ids that stay: the smallest of each connected group."""
    sets = [set(simhash.shingles(t, k)) for t in texts]
    root = list(range(len(texts)))
    for b in range(len(texts)):
        for a in range(b):
            common = len(sets[a] & sets[b])
            if common >= similarity * (len(sets[a]) + len(sets[b]) - common):
                x, y = sorted((root[a], root[b]))
                root = [x if r == y else r for r in root]
    return [i for i, r in enumerate(root) if r == i]


def test_reordered_texts_do_not_hide_near_copies(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(150)]
    texts = []
    for _ in range(40):  # all have one set of words, so one fingerprint; every second is a near copy of the one before
        words = vocabulary * 2
        rng.shuffle(words)
        copy = list(words)
        copy[7], copy[8] = copy[8], copy[7]
        texts += [" ".join(words), " ".join(copy)]
    docs = spark.createDataFrame(list(enumerate(texts)), DOC)
    assert sorted(r["doc_id"] for r in simhash.deduplicate(docs).collect()) == brute_force(texts) == list(range(0, 80, 2))


def with_added_text():
    """Pairs of a text and a copy with 15 to 27 % more at its end (similarity about 0.79 to 0.87), some with a common line."""
    rng = random.Random(6)
    texts = []
    for _ in range(60):
        words = [f"w{rng.randrange(20000)}" for _ in range(rng.randrange(100, 400))]
        more = [f"w{rng.randrange(20000)}" for _ in range(int(len(words) * rng.uniform(0.15, 0.27)))]
        texts += [" ".join(words), " ".join(words + more)]
    return texts + ["one line that all of them have in common " * 3 + t for t in texts[:20]]


def test_copies_with_added_text_are_removed(spark):
    texts = with_added_text()
    docs = spark.createDataFrame(list(enumerate(texts)), DOC)
    assert sorted(r["doc_id"] for r in simhash.deduplicate(docs).collect()) == brute_force(texts)


@pytest.mark.parametrize("tile", [32768, 5])
def test_pairs_near_the_asked_similarity_are_all_proposed(spark, tile, monkeypatch):
    monkeypatch.setattr(simhash, "PLAN", 64 if tile == 32768 else 2)  # with the small tile buckets are hot and split
    texts = with_added_text()
    docs = spark.createDataFrame(list(enumerate(texts)), DOC)
    sets = [set(simhash.shingles(t, 5)) for t in texts]
    close = {(a, b) for b in range(len(texts)) for a in range(b) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    labelled = spark.createDataFrame([(i, i) for i in range(len(texts))], "node long, label long")
    live, *_ = simhash._met(docs, labelled, 5, 0.8, tile)
    assert close and close <= {(r["a"], r["b"]) for r in simhash._best(live.join(labelled, "node"), 0.8, None).collect()}


@pytest.mark.parametrize("offers", [(1,), (2, 16, 128)])
def test_groups_left_apart_are_joined(spark, offers, monkeypatch):
    """Without any candidates before it, and from families of copies whose members are partly close and partly not."""
    monkeypatch.setattr(simhash, "OFFERS", offers)
    rng = random.Random(8)
    texts = with_added_text()
    for _ in range(3):
        words = [f"w{rng.randrange(20000)}" for _ in range(200)]
        for _ in range(25):
            copy = list(words)
            for at in rng.sample(range(200), rng.randrange(1, 6)):
                copy[at] = f"w{rng.randrange(20000)}"
            texts.append(" ".join(copy))
    docs = spark.createDataFrame(list(enumerate(texts)), DOC)
    labelled = spark.createDataFrame([(i, i) for i in range(len(texts))], "node long, label long")
    links = simhash._join_apart(docs, labelled, 5, 0.8)
    gone = {r["node"] for r in simhash.components(links).filter("node <> root").collect()}
    assert [i for i in range(len(texts)) if i not in gone] == brute_force(texts)
