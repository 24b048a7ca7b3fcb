import random
import re
from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from orbiteer.llm import near_dup, wordhash
from orbiteer.llm.components import connected_components


def sets_of(text, length):
    words = re.sub("[A-Z]", lambda m: m[0].lower(), text or "").encode().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + length]) for i in range(max(1, len(words) - length + 1)))


def brute(rows, length, percent=80):
    """doc_id -> smallest doc_id reachable, over all pairs."""
    sets = [(i, sets_of(t, length)) for i, t in rows]
    up = list(range(len(sets)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a][1] & sets[b][1])
            if both and 100 * both >= percent * len(sets[a][1] | sets[b][1]):
                up[root(a)] = root(b)
    least = defaultdict(lambda: float("inf"))
    for k, (i, _) in enumerate(sets):
        least[root(k)] = min(least[root(k)], i)
    return [(i, len(s), least[root(k)], least[root(k)] == i) for k, (i, s) in enumerate(sets)]


def found(df):
    return sorted(tuple(r) for r in df.select("doc_id", "n_shingles", "component_id", "kept").collect())


@pytest.mark.parametrize("length", [2, 5])
def test_same_as_all_pairs(spark, documents, length):
    df = spark.createDataFrame(documents, "doc_id long, text string")
    assert found(near_dup.near_duplicates(df, length)) == sorted(brute(documents, length))


def test_groups_larger_than_a_block(spark):
    """Copies with random edits, more than a block takes, and some that are near to none."""
    pick, rows = random.Random(1), []
    base = [f"w{i}" for i in range(120)]
    for i in range(150):
        words = list(base)
        for k in pick.sample(range(120), pick.randint(0, 14)):
            words[k] = f"x{pick.randint(0, 10**6)}"
        rows.append((i * 3, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    expected = sorted(brute(rows, 2))
    assert 1 < sum(r[3] for r in expected) < 100
    assert found(near_dup.near_duplicates(df, 2, block=16)) == expected


@pytest.mark.parametrize("limit", [2, 6])
def test_long_lists(spark, documents, monkeypatch, limit):
    """Lists that are too long for one task are counted in blocks: copies, near copies, and lists of others."""
    monkeypatch.setattr(near_dup, "LIST", limit)
    monkeypatch.setattr(near_dup, "CODES", 5)
    pick, rows = random.Random(4), [(i, t[:3000]) for i, t in documents[:60]]
    common = "all of these begin with words that many others have too and go on for a while like this"
    for i in range(120):
        words = (common if i % 2 else common[::-1]).split() + [f"y{pick.randint(0, 9)}" for _ in range(pick.randint(0, 12))]
        rows.append((10_000 + i, " ".join(words)))
    expected = sorted(brute(rows, 2))
    assert 10 < len({r[2] for r in expected if r[0] >= 10_000}) < 110
    assert found(near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2, block=16)) == expected


def test_odd_rows(odd, none):
    rows = near_dup.near_duplicates(odd, 2).collect()
    assert len(rows) == len(odd.rows)
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    assert {r.component_id for i in (1, 2) for r in by[i]} == {1} and [r.kept for r in by[2]] == [False]
    assert all(r.component_id is None and r.kept for r in by[None])
    for i in (4, 5, 6):
        assert (by[i][0].n_shingles, by[i][0].component_id, by[i][0].kept) == (0, i, True)
    assert near_dup.near_duplicates(none).count() == 0


def test_components(spark):
    pick = random.Random(3)
    edges = [(pick.randint(0, 400), pick.randint(0, 400)) for _ in range(230)] + [(i, i + 1) for i in range(1000, 1060)] + [(5000, 5000)]
    up = {}

    def root(x):
        up.setdefault(x, x)
        return x if up[x] == x else root(up[x])

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame([*edges, (None, 1)], "a long, b long")).collect()}
    assert got == {x: root(x) for x in list(up)}


def test_word_hashes(monkeypatch):
    texts = ["a b  a\tB", "", None, "ab ba é\x0bé", " x" * 300, "y" * 1000 + " " + "y" * 1000]
    seen, back = {}, {}
    for a, b, data, offsets in wordhash.slices(pa.array(texts), 50):
        hashes, first = wordhash.words(data, offsets)
        for i in range(a, b):
            words = (texts[i] or "").encode().split()
            own = hashes[first[i - a] : first[i - a + 1]].tolist()
            assert len(own) == len(words)
            for w, h in zip(words, own, strict=True):
                assert seen.setdefault(w, h) == h and back.setdefault(h, w) == w
    raw = ("some words of é and w\u00fcrde " * 40 + "z" * 300 + " end").encode()
    data, offsets = np.frombuffer(raw, dtype=np.uint8), np.array([0, 17, 17, 500, len(raw)])
    whole, first = wordhash.words(data, offsets, lower=True)
    chained = wordhash.runs(whole, 5)
    monkeypatch.setattr(wordhash, "PART", 32)
    again, first_again = wordhash.words(data, offsets, lower=True)
    assert whole.tolist() == again.tolist() and first.tolist() == first_again.tolist() and chained.tolist() == wordhash.runs(whole, 5).tolist()
    monkeypatch.undo()
    data = np.frombuffer(b"a b c a b c a", dtype=np.uint8)
    runs = wordhash.runs(wordhash.words(data, np.array([0, 13]))[0], 3)
    assert runs[0] == runs[3] and len(set(runs.tolist())) == 3 and len(wordhash.runs(runs[:2], 3)) == 0


@pytest.mark.parametrize("block", [near_dup.BLOCK, 2])
def test_texts_that_share_a_doc_id(spark, block):
    """Each text of a repeated doc_id is linked with its own near copies, in small groups and across blocks."""
    texts = [" ".join(f"{c}{k}" for k in range(60)) for c in "abcdef"]
    rows = [(3, t) for t in texts] + [(10 + 10 * i + k, t + f" end{k}") for i, t in enumerate(texts) for k in range(4)]
    got = found(near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2, block=block))
    assert got == sorted(brute(rows, 2)) and {r[2] for r in got} == {3}


def test_block_without_its_texts():
    block = pd.DataFrame({"set": [1, 2], "comp": [1, 2], "text": ["a b", "c d"]})
    assert near_dup._roots(2, 80, near_dup.COORDINATES, near_dup.MATCHES)(block).empty


def _template(n, own, shared, seed=4):
    """Texts of ``shared`` common words and ``own`` others each."""
    import random

    draw = random.Random(seed)
    frame = [f"t{i}" for i in range(shared)]
    return [(i, " ".join(frame + [f"w{draw.randrange(10**9)}" for _ in range(own)])) for i in range(n)]


def test_template_is_not_sent_around(spark):
    """Texts of likeness 0.6 make a group of candidates; none is left to be compared across blocks, however many they are."""
    for n in (300, 600):
        docs = spark.createDataFrame(_template(n, 50, 150), "doc_id long, text string").withColumn("hash", F.xxhash64("text"))
        signed = docs.mapInArrow(near_dup._sign(2, 48), near_dup._SETS)
        own = signed.select("doc_id", "hash", "set", F.lit(1).cast("long").alias("blob"), F.col("set").alias("comp"))
        assert near_dup._live(docs, own, 2, 80).count() == 0
    rows = near_dup.near_duplicates(docs.drop("hash"), 2, block=64).collect()
    assert len(rows) == 600 and all(r.kept for r in rows)


def test_links_across_blocks_of_a_template(spark):
    """Of the same template, some texts are near copies of others: those are found, also by a likeness of exactly 0.8."""
    texts = [t for _, t in _template(400, 50, 150)]
    for i in range(0, 60, 2):
        words = texts[i].split()
        words[-9:] = [f"x{i}y{j}" for j in range(9)]
        texts.append(" ".join(words))
    docs = list(enumerate(texts))
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), 2, block=64).collect()}
    sets = [{tuple(t.split()[k : k + 2]) for k in range(len(t.split()) - 1)} for _, t in docs]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    root = list(range(len(sets)))
    for i, j in sorted(links):
        a, b = root[i], root[j]
        root = [min(a, b) if r in (a, b) else r for r in root]
    assert got == dict(enumerate(root)) and len(links) >= 30
