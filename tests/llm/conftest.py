import random

import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed: int, words: int) -> str:
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(5000)}" for _ in range(words))


@pytest.fixture(scope="session")
def texts():
    """Copies, near copies, ties, nulls, empty, spaces only, very long, odd characters."""
    base = prose(1, 60)
    words = base.split()
    near = " ".join(["changed", *words[1:]])
    far = " ".join(words[:30] + prose(2, 30).split())
    long = prose(3, 30_000)
    extra = ["Write to ann.lee@mail.example.com or 10.0.0.1.", "card 4111 1111 1111 1111, +49 (030) 123-4567", "Released under the MIT License.", "CC BY\nGNU General Public License", "1.1.1.1.1 a@b@c.d +1 2", "İΣß é 中文 😀 ▁ \x00 \x1c x", "a b c", "A B c", "W1 w2", "…", "12 34"]
    return [(0, base), (1, base.upper()), (2, near), (3, far), (4, None), (5, ""), (6, " \n\t "), (7, long), (8, long + " tail"), (9, base), (9, base)] + [(10 + k, t) for k, t in enumerate(extra)]


@pytest.fixture(scope="session")
def documents(spark, texts):
    rows = [(i, t, "en", "s", None) for i, t in texts]
    from pyspark.sql import functions as F

    return spark.createDataFrame(rows, DOCUMENTS).withColumn("node", F.lit(1)).withColumn("row", F.lit("x")).withColumn("key", F.lit(None).cast("int"))


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCUMENTS)
