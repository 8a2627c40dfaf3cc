import re

import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names operators use themselves, or might.
CLASHING = ["size", "target", "slot", "shard", "node", "key", "n", "g", "c", "h", "id", "a", "b", "x", "label", "component_id", "kept", "__id", "start", "end", "spans", "seed", "part", "length", "value"]


def frame(spark, rows):
    """(doc_id, text[, lang[, source]]) -> documents."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", len(r[1] or "")) for r in rows]
    return spark.createDataFrame(full, SCHEMA)


def clashing(df):
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit("?") for c in CLASHING})


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls, blanks, repeats, ties and a very long text."""
    long = " ".join(f"w{i % 997}x{i % 31}" for i in range(20_000))
    return frame(
        spark,
        [(1, None), (2, ""), (3, " \t\n\x0b\x0c\r "), (4, "one"), (5, "one"), (5, "one"), (6, long), (7, long), (8, "naïve café — 東京 🚢 über"), (9, "a b c d e f g h i j k"), (None, "no id here at all"), (None, None), (10, "x" * 200_000), (11, "the of and " * 50, None, None)],
    )


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
