"""Compare a query with its SQL the way a reader would: equal columns, equal rows in any order."""

from collections import Counter

import duckdb

TABLES = "events documents embeddings pages benchmark labels conversations".split()


def rounded(value):
    return round(value, 9) if isinstance(value, float) else value


def compare(spark, sf_dir, query, sql):
    frame = query(spark, sf_dir)
    columns = sorted(frame.columns)
    ours = Counter(tuple(rounded(row[c]) for c in columns) for row in frame.collect())
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{table}.parquet')")
    result = connection.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    theirs = Counter(tuple(rounded(row[i]) for i in at) for row in result.fetchall())
    assert ours == theirs
    return sum(ours.values())
