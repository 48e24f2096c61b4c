"""Row sets of a Spark frame and of a DuckDB query in one comparable form."""

import math
from decimal import Decimal


def cell(v):
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (float, Decimal)):
        return "NaN" if math.isnan(v) else f"{float(v):.7g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(cell, v)) + "]"
    return str(v)


def spark_rows(df):
    names = sorted(df.columns)
    return names, sorted(tuple(cell(r[n]) for n in names) for r in df.collect())


def sql_rows(con, sql):
    rel = con.sql(sql)
    names = sorted(rel.columns)
    at = [rel.columns.index(n) for n in names]
    return names, sorted(tuple(cell(r[i]) for i in at) for r in rel.fetchall())
