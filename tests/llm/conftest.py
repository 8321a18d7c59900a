import duckdb
import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
TABLES = "documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def docs(spark):
    """Makes a documents table of (doc_id, text[, lang, source]) rows, with a clashing and a nested column more."""

    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", None) for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def same_as_sql():
    """Compares a query's rows with its SQL over the same tables."""

    def compare(spark, sf_dir, function, sql):
        con = duckdb.connect()
        for name in TABLES:
            con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
        wanted = con.sql(sql)
        columns = sorted(wanted.columns)
        frame = function(spark, sf_dir)
        assert sorted(frame.columns) == columns
        key = lambda r: tuple(repr(x) if isinstance(x, float) else str(x) for x in r)
        got = sorted(key(r) for r in frame.select(columns).collect())
        at = [wanted.columns.index(c) for c in columns]
        assert got == sorted(key([r[i] for i in at]) for r in wanted.fetchall())

    return compare
