import pytest

CLASHING = ["row", "digest", "kept", "body", "body__", "spans", "ids", "score", "patterns", "place", "node", "bucket", "bands", "doc", "id", "n"]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, extra columns with the operators' names."""
    base = "the quick brown fox jumps over the lazy dog and runs far away from the old stone mill by the river " * 2
    texts = [
        (1, base), (2, base), (2, base), (3, base.upper()), (4, None), (5, ""), (None, None), (None, base + " again"), (6, "one"), (7, "  \t\n"),
        (8, "a b"), (9, "a b"), (10, "x" * 300_000), (11, " ".join(f"w{i}" for i in range(40_000))), (12, "Äpfel ſ K ▁ <s> 日本 😀\x00end"), (13, base + " tail"),
    ]
    rows = [(i, t, None if k % 3 else "en", None, None, *[f"x{k}"] * len(CLASHING)) for k, (i, t) in enumerate(texts)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHING)
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("1 = 0")
