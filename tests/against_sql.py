"""A registered plan and its SQL over given rows of one table."""

import duckdb

from tracelode import plans


def both(spark, folder, name, tables):
    """(rows of the plan, rows of the SQL), each sorted; tables: SQL of DuckDB by name."""
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for table, sql in tables.items():
        c.sql(f"COPY ({sql}) TO '{folder}/{table}.parquet'")
        c.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    want = c.sql(plans.oracle_sql()[name])
    df = plans.queries()[name](spark, str(folder)).select(*want.columns)
    return sorted(map(tuple, df.collect()), key=repr), sorted(want.fetchall(), key=repr)
