import hashlib
import random

import pytest

from orbiteer.llm import substring_dedup as S


def brute(rows, window):
    """(doc_id, n_words, n_removed, kept) with every window of every document in one table."""
    least, words = {}, [(i, (t or "").encode().split()) for i, t in rows]
    for i, w in words:
        for k in range(len(w) - window + 1):
            if i is not None:
                key = tuple(w[k : k + window])
                least[key] = min(i, least.get(key, i))
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if i is not None and least[tuple(w[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        out.append((i, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return out


def test_same_as_all_windows(spark, sf_dir, documents):
    got = {(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in S.op2(spark, sf_dir).collect()}
    expected = {(i, n, g, hashlib.sha256(k).hexdigest()) for i, n, g, k in brute(documents, 50)}
    assert got == expected and any(g for _, _, g, _ in expected)


@pytest.mark.parametrize("window,period", [(50, 31), (12, 7), (5, 2), (3, 1)])
def test_passages(spark, window, period):
    """Passages of just enough and too few words, at any places, inside one document and across, and repeated words."""
    pick, rows = random.Random(window), []
    passages = [[f"p{j}.{k}" for k in range(n)] for j, n in enumerate((window - 1, window, window + 1, 3 * window))] + [["the", "of"] * window, ["the"] * window]
    for i in range(60):
        words = []
        for _ in range(pick.randint(1, 4)):
            words += [f"u{pick.randint(0, 10**9)}" for _ in range(pick.randint(0, 2 * period + 3))] + pick.choice(passages)
        rows.append((i - 5, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_removed, r.kept) for r in S.remove_repeats(df, window, period).collect()}
    assert got == {i: (g, k.decode()) for i, _, g, k in brute(rows, window) if g}


@pytest.mark.parametrize("period", [1, 2, 7, 13, 31, 64])
def test_cover(period):
    cover = set(S.difference_cover(period))
    assert {(a - b) % period for a in cover for b in cover} == set(range(period))


def test_odd_rows(odd, none, spark):
    got = S.remove_repeats(odd, 4, 2).collect()
    assert [(r.doc_id, r.n_removed, r.kept) for r in got] == [(2, 8, "")]
    assert S.remove_repeats(none).count() == 0


def test_small_lots(spark, documents, monkeypatch):
    """What tasks merge before the shuffle doesn't change the result."""
    df = spark.createDataFrame(documents, "doc_id long, text string").repartition(7)
    whole = {(r.doc_id, r.kept) for r in S.remove_repeats(df).collect()}
    monkeypatch.setattr(S, "LOT", 500)
    assert {(r.doc_id, r.kept) for r in S.remove_repeats(df).collect()} == whole
