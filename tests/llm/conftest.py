import pytest

LONG = " ".join(f"word{i % 977} of line{i}" for i in range(30_000))


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls in every column, empty and long texts, ties, repeated rows, and columns whose names clash."""
    rows = [
        (1, "the same text, twice over, by the river", "en", "a"),
        (1, "the same text, twice over, by the river", "en", "a"),
        (2, "the same text, twice over, by the river", "en", "b"),
        (3, "another text\nof two lines with mail me.too@site.org", None, None),
        (3, "a text with a doc_id that is taken", "en", None),
        (4, None, "en", "a"),
        (5, "", "de", "a"),
        (6, " \t\n\x0b\f\r ", "de", None),
        (None, "no id here, but words", "en", "a"),
        (None, None, None, None),
        (7, "12 34 !?", "en", "b"),
        (8, LONG, "en", "a"),
        (-9, "ein kurzer Text mit Umlauten: äöü", "de", "c"),
    ]
    names = ["set", "token", "size", "score", "lang_pred", "bucket", "extra", "n_lines", "mix_size", "n_replaced", "host", "rank", "tag", "copies"]
    df = spark.createDataFrame([(*r, len(r[1] or ""), *[7] * len(names)) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` int" for n in names))
    df.rows = rows
    return df


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    """(doc_id, text) of the smallest table, in order."""
    return sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())
