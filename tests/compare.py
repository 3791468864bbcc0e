"""Results of Spark held against those of DuckDB, whatever their order."""

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


def plain(d: pd.DataFrame) -> pd.DataFrame:
    d = d[sorted(d.columns)].copy()
    for n in d.columns:
        if d[n].dtype.kind in "fi" or str(d[n].dtype) in ("Int64", "Int32"):
            d[n] = pd.to_numeric(d[n], errors="coerce").astype(float).round(6)
    d = d.astype(str).replace({"None": "nan", "NaT": "nan", "<NA>": "nan"})
    return d.sort_values(list(d.columns)).reset_index(drop=True)


#: Types of the two engines that count as the same.
FAMILY = {
    "tinyint": "int", "smallint": "int", "int": "int", "bigint": "bigint", "float": "double", "double": "double", "string": "string", "boolean": "boolean", "timestamp": "timestamp", "timestamp_ntz": "timestamp", "date": "date",
    "TINYINT": "int", "SMALLINT": "int", "INTEGER": "int", "BIGINT": "bigint", "FLOAT": "double", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean", "TIMESTAMP": "timestamp", "TIMESTAMP_NS": "timestamp", "DATE": "date",
}


def same_types(schema, relation) -> None:
    """Columns of a Spark schema and of a DuckDB relation have the same names and types."""
    got = {f.name: FAMILY.get(t := f.dataType.simpleString(), t) for f in schema}
    want = {c: FAMILY.get(str(t), str(t)) for c, t in zip(relation.columns, relation.types, strict=True)}
    assert got == want


def same(got: pd.DataFrame, want: pd.DataFrame) -> None:
    assert sorted(got.columns) == sorted(want.columns)
    pd.testing.assert_frame_equal(plain(got), plain(want))
