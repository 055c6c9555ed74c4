from __future__ import annotations

import pytest
from pyspark.sql import functions as F

LONG = "Der lange Text. " * 4000 + "x" * 3000

ODD_TEXTS = (
    (1, None), (2, ""), (3, "   \n\t"), (4, "12 34 !!"), (5, "The cat sat on the mat near the door."),
    (6, "The cat sat on the mat near the door."), (6, "The cat sat on the mat near the door."),
    (7, LONG), (8, "Éa ñu\x85\u2003漢字 \U0001f600<|endoftext|> x\x1cy"), (None, "no id here at all"),
    (None, None), (9, "a"), (10, "\x00"), (12, "z" * 700), (11, "Mail a.b@site.org or +1 (203) 444-1234."),
)


def documents(spark, rows=ODD_TEXTS, **extra):
    """Documents with odd texts, and extra columns named like results and inner columns."""
    data = [
        (i, t, None if n % 4 == 0 else ("de", "en")[n % 2], None if n % 5 == 0 else f"s{n % 2}", None)
        for n, (i, t) in enumerate(rows)
    ]
    df = spark.createDataFrame(
        data, "doc_id long, text string, lang string, source string, n_chars long"
    )
    for name in ("id", "fp", "row", "range", "score", "lang_pred", "fingerprint", "component_id",
                 "text_key", "_kept_0", "_mix_lang", "n_tokens", "word", "start", "tokens", "topic"):
        df = df.withColumn(name, F.lit("other"))
    return df


@pytest.fixture(scope="session")
def odd(spark):
    return documents(spark)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
