"""The filter audit against a plain one, also with hashes that collide."""

import random
import re
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from orbiteer.llm import filter_audit


def plain_masks(rows):
    out = []
    for i, text, source in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = "A" * (len(words) < 50) + "B" * (100 * len(set(words)) < 65 * len(words)) + "C" * (100 * sum("A" <= x <= "Z" for x in text) > 5 * len(text)) + "D" * bool(re.search(r"[#$%&*|]", text))
        if i is not None and any(j is not None and j < i and (other or "") == text for j, other, _ in rows):
            fails += "E"
        out.append((i, source or "", fails))
    return out


def plain(rows, labels):
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    docs = plain_masks(rows)
    out = []
    for part in {p for _, p, _ in docs}:
        own = [(i, f) for i, p, f in docs if p == part]
        removed = {}
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, x in enumerate(order, 1):
                lost = [d for d in left if x in d[1]]
                left = [d for d in left if x not in d[1]]
                removed[order, step] = len(lost)
                failing = [d for d in own if x in d[1]]
                out.append([part, order, step, len(left), len(lost), len(failing) - len(lost), sum(f == x for _, f in own), sum(i in good for i, _ in lost), sum(i in toxic for i, _ in lost)])
        for row in out:
            if row[0] == part:
                row.append(sum(n for (order, step), n in removed.items() if order[step - 1] == row[1][row[2] - 1]))
    return sorted(map(tuple, out))


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(5)
    words = [f"w{chr(97 + i)}" for i in range(26)] + ["LOUD", "50%", "a|b", "ä€😀"]
    texts = [" ".join(draw.choice(words) for _ in range(draw.choice([1, 20, 49, 50, 51, 400]))) for _ in range(20)]
    # texts that part late, in each block, and copies of every kind
    texts += [base + end for base in ("x" * 63, "y " * 255, "z1 " * 1365, "q " * 17_000) for end in ("", "a", "b", "a ")] + ["", None, " ", "A", "50%"]
    return [(i, draw.choice(texts), draw.choice(["a", "b", "", None])) for i in range(150)] + [(7, texts[0], "a"), (7, texts[0], "a"), (7, None, None), (None, texts[0], "a"), (None, None, "a")]


@pytest.mark.parametrize("bits", [64, 2, 0])
def test_marks(spark, rows, bits):
    """With few bits or none, classes hold different texts, which whole texts tell apart."""
    hashed = (lambda *c: F.xxhash64(*c)) if bits == 64 else lambda *c: F.pmod(F.xxhash64(*c), F.lit(2**bits))
    got = filter_audit.marked(documents(spark, rows), hashed).collect()
    assert sorted(((r.doc_id, r.part, r.mask) for r in got), key=str) == sorted(((i, p, sum(1 << "ABCDE".index(x) for x in f)) for i, p, f in plain_masks(rows)), key=str)


def test_refinement_drops_what_is_alone(spark, rows):
    docs = documents(spark, [(1, "abc", None), (2, "abd", None), (3, "x" * 600 + "1", None), (4, "x" * 600 + "2", None), (5, "x" * 600 + "2", None), (6, "only one", None)])
    sizes = docs.select(*filter_audit._hashes(F.xxhash64))
    assert filter_audit.refined(sizes).count() == 1
    assert filter_audit.refined(sizes.where("n_chars < 100")).count() == 0


def test_audit(spark, rows):
    labels = [(i, i % 2, i % 3 % 2) for i in range(0, 150, 2)] + [(3, 0, 1), (3, 1, 0), (None, 1, 1), (7, 1, None), (9, None, None), (10_000, 1, 1)]
    docs = documents(spark, rows).withColumns({c: F.lit(1) for c in ("part", "mask", "class", "step", "b0", "n", "quality", "toxic", "first")})
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("source", F.lit("other"))
    got = filter_audit.audit(docs, known)
    names = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(map(tuple, got.select(names).collect())) == plain(rows, labels)
    assert filter_audit.audit(docs.limit(0), known).collect() == []
    none = filter_audit.audit(docs, known.limit(0))
    assert {(r.good_lost, r.toxic_lost) for r in none.collect()} == {(0, 0)}
