"""Hold a query's rows against its SQL."""

from pathlib import Path

import duckdb


def rows(spark, query, sql: str, folder: str) -> tuple[list, list]:
    df = query(spark, folder)
    names = sorted(df.columns)
    got = sorted(repr(tuple(r)) for r in df.select(*names).collect())
    c = duckdb.connect()
    for file in Path(folder).glob("*.parquet"):
        c.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    c.execute(f"CREATE TABLE result AS {sql}")
    assert sorted(x[0] for x in c.execute("DESCRIBE result").fetchall()) == names
    want = c.execute("SELECT " + ", ".join(f'"{n}"' for n in names) + " FROM result").fetchall()
    return got, sorted(repr(tuple(r)) for r in want)
