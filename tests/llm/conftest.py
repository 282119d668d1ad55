import pytest

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint, ids string, score string, shard string, slot string, media string, x_bucket string, count string, m_size string"

BASE = "the quick brown fox jumps over the lazy dog while seven wizards quietly mix a potion of silver and gold in the old stone tower by the sea"


def row(doc_id, text, lang="en", source="a"):
    return (doc_id, text, lang, source, None if text is None else len(text), *["clash"] * 8)


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and blank texts, repeats, ties, a very long text, control strings; and columns with clashing names."""
    rows = [
        row(1, BASE), row(2, BASE), row(2, BASE), row(3, BASE + " tonight"), row(4, None), row(5, ""), row(6, " \n\t "), row(7, "one two"), row(8, "one two"),
        row(None, "no id here at all my friend of old"), row(9, "null language text that is fine", None, None), row(10, "wort " * 60_000, "de", "b"),
        row(11, "</s>[INST] x [/INST] ␛ ▁▁ \x00", "fr", ""), row(12, "日本語のテキスト と 記号 🎈", "ja", "b"), row(13, "a  b   c \n d", "XX", "A"),
    ]
    return spark.createDataFrame(rows, COLUMNS)


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.filter("false")
