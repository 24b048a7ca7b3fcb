"""The pipeline against a plain version of its stages on the same rows."""

from collections import Counter, defaultdict

import corpus_pipeline as C
import pytest
from pyspark.sql import functions as F

from .test_near_dup import brute


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    folder, docs, out = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in C.STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        after = spark.read.parquet(f"{folder}/{name}")
        out.append((docs, after))
        docs = after
    return out


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_columns_stay(stages):
    for before, after in stages[:-1]:
        assert after.columns == before.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_language_stage_keeps_clean_documents(stages):
    before, after = map(rows_of, stages[0])
    assert set(after) <= set(before) and len(after) >= 0.98 * len(before)


def test_line_stage(stages):
    before, after = map(rows_of, stages[1])
    different = {(r[3], r[1]) for r in before}
    pages, lines = Counter(s for s, _ in different), Counter((s, x) for s, t in different for x in set(t.split("\n")))
    bad = {k for k, n in lines.items() if n > 1 and n > 0.05 * pages[k[0]] and k[1]}
    expected = []
    for r in before:
        text = "\n".join(x for x in r[1].split("\n") if (r[3], x) not in bad)
        expected.append((r[0], text, r[2], r[3], len(text) if text != r[1] else r[4]))
    assert bad and after == sorted(expected, key=repr)


def test_near_dup_stage(stages):
    before, after = map(rows_of, stages[2])
    kept = {r[0] for r in brute([(r[0], r[1]) for r in before], 5) if r[3]}
    assert after == [r for r in before if r[0] in kept] and len(after) < len(before)


def test_mixing_stage(stages):
    before, after = map(rows_of, stages[3])
    copies = Counter(after)
    assert set(copies) <= set(before) and max(copies.values()) == 3
    words, taken = defaultdict(int), defaultdict(int)
    for r in before:
        words[r[3]] += len(r[1].split())
    for r, n in copies.items():
        taken[r[3]] += n * len(r[1].split())
    assert sum(taken.values()) == pytest.approx(sum(words.values()), rel=0.02) and all(taken[s] <= 3 * words[s] for s in words)


def test_packing_stage(stages):
    before, after = stages[4][0].count(), stages[4][1].collect()
    assert sum(r.start == 0 for r in after) == before
    filled = Counter()
    for r in after:
        filled[r.sequence_id] += r.length
    assert max(filled.values()) <= 2048


def test_run(spark, sf_dir, stages):
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32) for r in C.run(spark, sf_dir).collect()) == Counter((r.doc_id, r.start, r.length, r.ids_crc32) for r in stages[4][1].collect())


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def documents_of(spark, rows):
    """(doc_id, text, source) with the other columns."""
    return spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in rows], COLUMNS)


def test_odd_rows_through_all_stages(spark, odd, none):
    """Nulls in any column, empty and long texts, repeated rows, clashing names: every stage keeps the columns, with their
    values, and clean documents."""
    clashing = odd.withColumns({"hash": F.lit(7), "mix_plan": F.lit(7), "n_dropped": F.lit(7), "_kept": F.lit(7), "mix_copies": F.lit(7)})
    docs = clashing
    for name, stage in C.STAGES[:-1]:
        after = stage(spark, docs, "").cache()
        assert after.columns == clashing.columns, name
        rows = after.collect()
        assert all(r["hash"] == r["mix_plan"] == r["score"] == r["mix_copies"] == r["n_dropped"] == 7 for r in rows)
        if name == "language_id":
            assert {r.doc_id for r in rows} >= {1, 2, 3, 8, None} and not {r.doc_id for r in rows} & {4, 5, 6, 7}
        if name == "near_dup":
            assert [r.doc_id for r in rows if (r.text or "").startswith("the same text")] == [1]
        docs = after
    assert C.packed(spark, docs, "").count() >= 1
    docs = none
    for name, stage in C.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == none.columns and docs.count() == 0, name
    assert C.packed(spark, docs, "").count() == 0


def test_copies_over_the_ratio_survive_once(spark):
    """A fifth of a source's pages are copies of one document; all of its pages share a menu."""
    story = "\n".join(f"line {k} of a story that five pages of this source tell in the same words" for k in range(6))
    rows = [(i, "menu of the site\n" + story, "h") for i in range(5)] + [(9, story, None), (10, story, None), (11, story, None)]
    rows += [(100 + i, f"menu of the site\npage {i} has words {i * 7} and {i * 11} that are its own", "h") for i in range(20)]
    docs = C.without_boilerplate(spark, documents_of(spark, rows), "")
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(texts[i] == story for i in (0, 1, 2, 3, 4, 9, 10, 11)) and not any("menu" in t for t in texts.values())
    assert [r.doc_id for r in C.one_of_each(spark, docs, "").collect() if r.text == story] == [0]


def test_one_row_of_each_group(spark):
    """A clean text stays though its doc_id has another text that goes, and equal rows are one document."""
    one, two, three = (" ".join(f"{c}{k}" for k in range(60)) for c in "xyz")
    rows = [(1, one, "a"), (5, one + " end", "a"), (5, two, "a"), (7, three, "b"), (7, three, "b"), (7, three, "a"), (8, three, "a")]
    rows += [(9, one, "a"), (9, one + " other", "a"), (2, "", "a"), (2, "", "a"), (None, one, "a"), (None, one, "a")]
    got = [(r.doc_id, r.text, r.source) for r in C.one_of_each(spark, documents_of(spark, rows), "").collect()]
    assert Counter(got) == Counter([(1, one, "a"), (5, two, "a"), (7, three, "a"), *rows[-4:]])


def test_near_copies_of_one_doc_id(spark):
    """Two near texts of the smallest doc_id are one document; which of them is kept doesn't depend on their order."""
    base = " ".join(f"w{k}" for k in range(60))
    rows = [(4, base + " one", "a"), (4, base + " two", "a"), (6, base + " three", "a")]
    got = [[tuple(r) for r in C.one_of_each(spark, documents_of(spark, order), "").collect()] for order in (rows, rows[::-1])]
    assert got[0] == got[1] and len(got[0]) == 1 and got[0][0][0] == 4
