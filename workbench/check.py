"""Run registered queries and their SQL on one folder and compare the rows.

python -m workbench.check FOLDER [query ...]
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
from pyspark.sql import SparkSession

from paperlens.session import builder
from workbench.queries import registered
from workbench.sql import ORACLES


def local_session(cores: int = 8) -> SparkSession:
    spark = (
        builder("paperlens-check").master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def connection(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(Path(folder).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)]
    return df.sort_values(list(df.columns), ignore_index=True) if len(df.columns) else df


def differences(got: pd.DataFrame, wanted: pd.DataFrame) -> str | None:
    if sorted(got.columns) != sorted(wanted.columns):
        return f"columns {sorted(got.columns)} != {sorted(wanted.columns)}"
    if len(got) != len(wanted):
        return f"rows {len(got)} != {len(wanted)}"
    got, wanted = canonical(got), canonical(wanted)
    for name in got.columns:
        a, b = got[name], wanted[name]
        if a.dtype.kind == "f" or b.dtype.kind == "f":
            same = np.isclose(a.astype(float), b.astype(float), rtol=0, atol=0, equal_nan=True)
        else:
            same = ((a == b) | (a.isna() & b.isna())).to_numpy()
        if not same.all():
            at = int(np.flatnonzero(~same)[0])
            return f"{name}: {(~same).sum()} of {len(a)} differ, e.g. {got.iloc[at].to_dict()} != {wanted.iloc[at].to_dict()}"
    return None


def main(folder: str, *names: str) -> int:
    spark, con, failed = local_session(), connection(folder), 0
    for name, run in registered().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            got = run(spark, folder).toPandas()
            took = time.time() - start
            if name not in ORACLES:
                print(f"rows {name} {len(got)} {took:.2f}s", flush=True)
                continue
            start = time.time()
            wanted = con.execute(ORACLES[name]).df()
            problem = differences(got, wanted)
            print(f"{'ok  ' if problem is None else 'FAIL'} {name} {len(got)} {took:.2f}s sql {time.time() - start:.2f}s {problem or ''}", flush=True)
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
            print(f"FAIL {name} {problem}", flush=True)
        failed += problem is not None
    return failed


if __name__ == "__main__":
    sys.exit(main(*sys.argv[1:]))
