import random

import pytest

EXTRA = "batch int, size long, fp long, copies long, score double, _k string, doc string"


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    words = [r.choice("abcdefghij") + r.choice("aeiou") + r.choice("klmnprst") + r.choice(["", "an", "or", "ish"]) for _ in range(n)]
    lines, at = [], 0
    while at < n:
        k = r.randrange(5, 14)
        lines.append(" ".join(words[at : at + k]) + ".")
        at += k
    return "\n".join(lines)


@pytest.fixture(scope="session")
def messy_rows():
    """Nulls in every column, empty and very long texts, ties, repeated rows, copies, shared passages."""
    passage = prose(99, 80)
    rows = [
        (None, None, None, None, None),
        (1, None, "en", "b", 0),
        (2, "", None, "b", 0),
        (3, " \t\n\x0b ", "en", None, 5),
        (4, prose(1, 30000), "en", "a", 1),
        (5, prose(2, 200) + "\n" + passage, "en", "a", 1),
        (6, passage + "\n" + prose(3, 150), "de", "a", 1),
        (7, prose(4, 120), "de", "c", 1),
        (7, prose(4, 120), "de", "c", 1),
        (8, prose(4, 120), "fr", "c", 1),
        (9, prose(4, 119), "fr", "c", 1),
        (10, "ab " * 300, "en", "c", 1),
        (11, "tek satır çğıöşü \U0001f600 " * 20, "tr", "c", 1),
        (None, prose(4, 120), "fr", None, 1),
    ]
    return rows + [(100 + i, prose(1000 + i, 60 + i), "en", f"s{i % 3}", 1) for i in range(30)]


@pytest.fixture(scope="session")
def messy(spark, messy_rows):
    """The rows with extra columns whose names clash with inner ones."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(messy_rows, "doc_id long, text string, lang string, source string, n_chars long")
    for part in EXTRA.split(", "):
        name, kind = part.split()
        df = df.withColumn(name, F.lit("1").cast(kind))
    return df.repartition(3)


@pytest.fixture(scope="session")
def empty(messy):
    return messy.limit(0)


@pytest.fixture(scope="session")
def save(tmp_path_factory):
    """Writes tables as a driver's folder, for the contract queries."""

    def run(**tables):
        path = str(tmp_path_factory.mktemp("sf"))
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{path}/{name}.parquet")
        return path

    return run
