import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from orbiteer.llm import packing as P

TEXTS = ["", " ", "a.b,c", "a..b", "don't we'll 'S", "x,!y", "ÀÉß ÿ Œuvre", "tab\tx", "12.5,3", "a\nb\r\nc", "ｆｕｌｌ", "é İ Σς", "<|endoftext|> x", "a<|STARTOFTEXT|>b", "x <|endoftext|>.", "< | a <| b |>", ".", ", .", "a .b", "_x_", "a,b.c d.", "º ª µ ²", "\x1c a\x1cb", "3.14''s", "A'Sb.", "naïve", "x\x00y"]


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(P.VOCABULARY))


def test_ids(tokenizer, documents, monkeypatch):
    texts = TEXTS + [t for _, t in documents]
    ids = P.Ids(P.VOCABULARY)
    expected = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(x, "<u4").tolist() for x in ids(texts)] == expected
    assert 49407 in expected[TEXTS.index("<|endoftext|> x")]
    monkeypatch.setattr(P, "LEARNT", 7)
    assert [np.frombuffer(x, "<u4").tolist() for x in P.Ids(P.VOCABULARY)(texts)] == expected
    monkeypatch.setattr(P, "REMEMBERED", 50)
    assert [np.frombuffer(x, "<u4").tolist() for t in texts for x in ids([t])] == expected


def test_best_fit():
    """The same as looking at all open windows for the tightest."""
    pick = random.Random(2)
    lengths = np.array([pick.randint(1, 100) for _ in range(400)])
    where, offset, used = P.best_fit_decreasing(lengths, 100)
    room, expected = [], {}
    for i in np.argsort(-lengths, kind="stable"):
        fits = [r for r in room if r >= lengths[i]]
        if fits:
            room.remove(min(fits))
            room.append(min(fits) - lengths[i])
        else:
            room.append(100 - lengths[i])
        expected[i] = room[-1]
    assert used == len(room)
    filled = defaultdict(list)
    for w, o, n in zip(where, offset, lengths, strict=True):
        filled[w].append((o, n))
    for parts in filled.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:], strict=False)) and sum(n for _, n in parts) <= 100
    assert sorted(100 - sum(n for _, n in p) for p in filled.values()) == sorted(room)
    assert P.best_fit_decreasing(np.array([], dtype=np.int64), 100)[2] == 0


def check(rows, given, tokenizer, window):
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for doc, text in given.items():
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")
        own = sorted(pieces.pop(doc), key=lambda r: r.start)
        assert [r.start for r in own] == np.cumsum([0, *[r.length for r in own]])[:-1].tolist() and sum(r.length for r in own) == len(ids)
        for r in own:
            assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    assert not pieces
    for own in sequences.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == np.cumsum([0, *[r.length for r in own]])[:-1].tolist() and sum(r.length for r in own) <= window
    return sum(r.length for r in rows) / (window * len(sequences))


def test_round_trip(spark, sf_dir, documents, tokenizer):
    assert check(P.op1(spark, sf_dir).collect(), dict(documents), tokenizer, 2048) > 0.98


def test_lots_and_small_windows(spark, documents, tokenizer, monkeypatch):
    monkeypatch.setattr(P, "LOT", 30)
    df = spark.createDataFrame(documents[:150], "doc_id long, text string").repartition(3)
    check(P.pack(df, window=64).collect(), dict(documents[:150]), tokenizer, 64)


def test_odd_rows(odd, none, tokenizer):
    rows = P.pack(odd).collect()
    tokens = sorted((r.doc_id if r.doc_id is not None else -1, r.doc_tokens) for r in rows if r.start == 0)
    expected = sorted((i if i is not None else -1, len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1) for i, t, _, _ in odd.rows)
    assert tokens == expected and P.pack(none).count() == 0
