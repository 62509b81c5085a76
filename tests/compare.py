"""Rows of a Spark query beside those of SQL in DuckDB, without regard to their order."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def value(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, float):
        return f"{v:.9g}"
    return str(v)


def rows(columns, records):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return [columns[k] for k in order], sorted(tuple(value(r[k]) for k in order) for r in records)


def of_spark(df):
    return rows(df.columns, [tuple(r) for r in df.collect()])


def of_sql(sql, data):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    found = con.sql(sql)
    return rows(found.columns, found.fetchall())


def with_documents(data, folder, text="text", doc_id="doc_id"):
    """A folder of the same tables, but for the text and doc_id of documents."""
    for t in TABLES:
        if t != "documents":
            os.symlink(f"{data}/{t}.parquet", f"{folder}/{t}.parquet")
    duckdb.connect().sql(f"COPY (SELECT * REPLACE ({text} AS text, {doc_id} AS doc_id) FROM '{data}/documents.parquet') TO '{folder}/documents.parquet' (FORMAT parquet)")
    return str(folder)
