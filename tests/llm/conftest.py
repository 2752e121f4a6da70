import pytest

SECRET = "deadbeef" * 5
CLEAN = "one fine day the quick brown fox jumps over a lazy dog\nand nothing else was ever said about it again"


@pytest.fixture(scope="session")
def vocabulary():
    from leafmill.llm.queries import vocabulary

    return vocabulary()


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls, empty and very long texts, repeated rows, one long line, and extra columns whose names operators use inside."""
    rows = [
        (1, CLEAN), (None, CLEAN), (None, None), (2, None), (3, ""), (4, CLEAN * 3000), (5, f"token = {SECRET} x"), (5, f"token = {SECRET} x"), (6, "x" * 200_000),
        (7, "क़ 👍🏽\n\n\r\n<|endoftext|>\0 end "), (-8, " ".join(f"w{i}" for i in range(30_000))), (9, None), (9, CLEAN.upper()),
    ]
    names = "h, _h, line, k1, _k1, rest, rank, spans, _rows, fingerprint, component_id, root, _marked, dropped, score"
    full = [(i, t, *([k] * 15)) for k, (i, t) in enumerate(rows)]
    schema = "doc_id long, text string, " + ", ".join(f"`{n}` int" for n in names.split(", "))
    return spark.createDataFrame(full, schema)


def by_row(df):
    return sorted((str(tuple(r)) for r in df.collect()))
