import pytest

LONG = ("Some words of a long text, again and again. " * 5000) + "x" * 1_000


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, equal ids, and extra columns with names that operators use."""
    rows = [
        (1, "Alpha beta gamma delta epsilon zeta eta theta iota kappa", "en"),
        (2, None, "en"),
        (3, "", None),
        (None, "A text without an id, but with words.", "en"),
        (4, LONG, "en"),
        (5, "　 é", "fr"),
        (6, "one", "fr"),
        (6, "one", "fr"),
        (7, "one two", None),
        (8, "Alpha beta gamma delta epsilon zeta eta theta iota kappa", "en"),
        (9, "   \n\t \n", "en"),
    ]
    data = [(i, t, g, "src", None if t is None else len(t), "q", 7, "w", "x") for i, t, g in rows]
    return spark.createDataFrame(data, "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, id int, registers string, `row` string")


@pytest.fixture(scope="session")
def none(spark, odd):
    return spark.createDataFrame([], odd.schema)


@pytest.fixture(scope="session")
def folder(spark, odd, none, tmp_path_factory):
    """Two folders of tables: odd ones and empty ones."""
    top = tmp_path_factory.mktemp("tables")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (4, 1, None), (None, 1, 1), (8, 1, 0), (8, 1, 0)], "doc_id bigint, quality int, toxic int")
    pages = spark.createDataFrame([(1, "http://a/é?x=\r\n1", "<p>same</p>"), (2, None, "<p>same</p>"), (3, "http://b", None), (4, "http://c", ""), (None, "http://d", "<p>same</p>"), (5, "u", "é" * 300_000), (5, "u", "é" * 300_000)], "page_id bigint, url string, html string")
    for name, frames in (("odd", (odd, labels, pages)), ("none", (none, labels.limit(0), pages.limit(0)))):
        for table, frame in zip(("documents", "labels", "pages"), frames, strict=True):
            frame.write.parquet(f"{top}/{name}/{table}.parquet")
    return str(top)
