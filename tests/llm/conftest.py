import pytest

TEXTS = [
    None,
    "",
    " \t\n\x0b\x0c\r",
    "one",
    "The quick brown fox jumps over the lazy dog near the old river bank.",
    "The quick brown fox jumps over the lazy dog near the old river bank.",
    "the QUICK brown fox jumps over the lazy dog near the old river bank.",
    "Déjà vu — naïve café 日本語 🤷 ﬁ\u3000end",
    "\n\n",
    "x" * 30_000,
    "word " * 20_000,
    "!!! ### $$$ 123",
]
#: Names that operators use themselves, and odd ones.
CLASHES = ["size", "copies", "turn", "target", "key", "row", "a", "b", "first", "component", "n", "part", "has_letter", "_id", "_source", "_copies", "ids", "spans", "x.y"]


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls in every column, empty and long texts, repeated rows, and extra columns with clashing names."""
    rows = [(i, t, "en" if i % 2 else None, f"src{i % 3}" if i % 4 else None, None if t is None else len(t)) for i, t in enumerate(TEXTS)]
    rows += [rows[4], rows[4], rows[0]]
    rows = [(*r, *[f"{c}{r[0]}" for c in CLASHES]) for r in rows]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"`{c}` string" for c in CLASHES))


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.where("doc_id < -1")


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def small_docs(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)
