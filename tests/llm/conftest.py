import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))
from prose_words import prose  # noqa: E402


@pytest.fixture(scope="session")
def make_dir(spark, tmp_path_factory):
    """Write documents (and pages, benchmark) to a folder that queries can read."""

    def make(docs: list[tuple], extra: dict | None = None, pages: list[tuple] = (), items: list[tuple] = ()) -> str:
        d = str(tmp_path_factory.mktemp("tables"))
        df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
        for name, expr in (extra or {}).items():
            df = df.selectExpr("*", f"{expr} AS `{name}`")
        df.write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame(list(pages), "page_id long, url string, html string").write.parquet(f"{d}/pages.parquet")
        spark.createDataFrame(list(items), "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
        return d

    return make


@pytest.fixture(scope="session")
def odd_dir(make_dir):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and extra columns with clashing names."""
    long = prose(1, 40000)
    docs = [
        (1, prose(11, 80), "en", "a", 1), (2, None, "en", "a", None), (3, "", None, None, 0), (4, long, "en", "b", 1), (5, long, "fr", "b", 1), (6, prose(11, 80), "en", "a", 1),
        (7, prose(12, 80), "fr", "a", 1), (7, prose(12, 80), "fr", "a", 1), (7, prose(13, 80), "fr", None, 1), (None, prose(14, 60), "en", "c", 1), (None, None, None, None, None),
        (8, "12 !! ??", "en", "c", 1), (9, " \n\t ", "de", "c", 1), (10, "word", "en", "c", 1), (11, prose(11, 80).upper(), "en", "a", 1), (12, "a\u0000b \U0001F600 ñ", "es", "c", 1),
    ]
    extra = {c: "'clash'" for c in ("digest", "node", "id", "mark", "copies", "shard", "key", "row_hash", "group_size", "keep_id", "copy", "size", "start")}
    pages = [(1, "https://a.example.org/es/1?x", "h"), (1, "https://a.example.org/es/1?x", "h"), (None, None, None), (2, "", None), (3, "no scheme", "h"), (4, "HTTP://ORG/", "h"), (5, "http:///de/", "h"), (6, "http://x.com/de/1", "h"), (7, "http://com", "h")]
    return make_dir(docs, extra, pages, [(1, prose(13, 30)), (1, prose(13, 30)), (None, None), (2, ""), (3, "two words")])


@pytest.fixture(scope="session")
def empty_dir(make_dir):
    return make_dir([])
