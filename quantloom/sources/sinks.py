"""Writers. All refuse to overwrite unless told otherwise."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.operators.reshape import pivot_wider


def write_table(df: DataFrame, path: str | None, overwrite: bool = False) -> None:
    """Parquet or CSV by suffix, else TSV; without a path 20 rows are shown."""
    if path is None:
        df.show(truncate=False)
        return
    w = df.write.mode("overwrite" if overwrite else "errorifexists")
    low = path.lower()
    if low.endswith(".parquet"):
        w.parquet(path)
    elif low.endswith(".csv"):
        w.csv(path, header=True)
    else:
        w.csv(path, sep="\t", header=True)


@dataclass
class MatrixBundle:
    """An annotated matrix: values with a row per observation, further layers, and what is known of rows and columns."""

    x: DataFrame
    obs: DataFrame
    var: DataFrame
    layers: dict[str, DataFrame] = field(default_factory=dict)
    warnings: list[str] = field(default_factory=list)


def annotated_matrix(df: DataFrame, obs: str, var: str, value: str, layers: list[str] = (), obs_metadata: list[str] = (), var_metadata: list[str] = (), columns: list | None = None) -> MatrixBundle:
    """``df`` (long) as a matrix with layers and metadata. Metadata columns that are missing are told and left out."""
    if df.isEmpty():
        raise ValueError("no rows")
    missing = [c for c in (*obs_metadata, *var_metadata) if c not in df.columns]

    def about(key: str, names: list[str]) -> DataFrame:
        have = [c for c in names if c in df.columns]
        return df.groupBy(key).agg(*[F.first(c, ignorenulls=True).alias(c) for c in have]) if have else df.select(key).distinct()

    wide = lambda v: pivot_wider(df, obs, var, v, fill=0, columns=columns)
    return MatrixBundle(wide(value), about(obs, list(obs_metadata)), about(var, list(var_metadata)), {v: wide(v) for v in layers}, [f"no column {c}" for c in missing])
