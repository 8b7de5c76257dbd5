import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


@pytest.fixture
def documents(spark):
    """Rows (doc_id, text) as documents with more columns, some with names that the operators use themselves."""

    def make(rows):
        full = [(i, t, "en", "host", len(t or ""), 1, "x", {"a": 1.5}) for i, t in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, _block int, bucket string, `od.d` map<string,double>")

    return make


def passage(k, n):
    return " ".join(f"{WORDS[(k + 7 * j * j) % 20]}{(k * 31 + j) % 97}" for j in range(n))


@pytest.fixture
def odd(documents):
    """Nulls in any column, empty and long texts, ties and repeated rows."""
    long = passage(3, 4000)
    return documents([(1, None), (2, ""), (3, " \n\t "), (None, passage(1, 60)), (5, long), (6, long), (7, passage(1, 60)), (7, passage(1, 60)), (8, "é\u2003\U0001f600 x\x00y \u00a0"), (9, "word"), (-4, passage(2, 55)), (10, passage(2, 55) + "\n" + passage(2, 55))])


@pytest.fixture
def tables(spark, tmp_path):
    """Writes rows as a table of a folder, and gives the folder and a connection that has the table as a view."""
    import duckdb

    c = duckdb.connect()

    def make(name, rows, schema):
        spark.createDataFrame(rows, schema).coalesce(2).write.parquet(f"{tmp_path}/{name}.parquet")
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
        return str(tmp_path), c

    return make
