import pytest

from documents_of import COLUMNS, rows


@pytest.fixture(scope="session")
def table(spark, tmp_path_factory):
    """A function from rows to a table read from files, as the operators ask for."""
    def make(data, schema=COLUMNS, parts=3):
        path = str(tmp_path_factory.mktemp("t") / "t")
        spark.createDataFrame(data, schema).repartition(parts).write.parquet(path)
        return spark.read.parquet(path)

    return make


@pytest.fixture(scope="session")
def odd(table):
    """Nulls in every column, empty and very long texts, repeated rows, ties."""
    long = " ".join(f"word{i % 977} goes on" for i in range(40_000))
    data = rows(["", None, "x", "one two three four five six seven", "one two three four five six seven", long, " \t\n", "Ünïcode ŝtrîng 漢字 😀", "a" * 900])
    return table([*data, data[3], data[5], data[1], (None, "null id", None, None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None, None)])


@pytest.fixture(scope="session")
def empty(table):
    return table([], parts=1)
