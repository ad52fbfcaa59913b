import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, fp bigint, kept boolean, label int"


def words(seed, n):
    """n made-up words, the same for the same seed."""
    out, x = [], seed
    for _ in range(n):
        x = (x * 1103515245 + 12345) % (1 << 31)
        out.append("".join("bcdfglmnprst"[x >> k & 7] + "aeiou"[(x >> k + 3) % 5] for k in (4, 9, 15)))
    return out


def messy_rows():
    """Nulls in every column, blank and very long texts, ties and repeated rows; extra columns clash with results."""
    clean = " ".join(words(1, 60))
    other = " ".join(words(2, 60))
    texts = [clean, clean, None, "", " \n\t ", "short text", other, " ".join(words(3, 40_000)), "x" * 100_000, "é ü ß\u2028中文 \x00 tab\tend", "a" + "\n" * 1000 + "a"]
    rows = [(i, t, "en", "s", len(t or ""), 0.5, 7, True, 1) for i, t in enumerate(texts)]
    rows += [rows[0], rows[0], (None, clean, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None), (50, clean, None, "s", 1, None, None, None, 0)]
    return rows


@pytest.fixture(scope="session")
def messy(spark):
    return spark.createDataFrame(messy_rows(), SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in range(11)] + [(0, 0, 1), (None, 1, 1), (3, None, None)], "doc_id bigint, quality int, toxic int")
