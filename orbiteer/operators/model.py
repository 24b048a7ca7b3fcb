"""Running an empirical density model over a table, batch by batch.  The model itself is given from outside."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..schemas import ALTITUDE, LATITUDE, LONGITUDE, VERSIONS

#: Flux, its 81-day mean and geomagnetic index of the runs under constant conditions.
CONSTANT = (150.0, 150.0, 0.0)


class DensityModel(Protocol):
    """Total mass density for vectors of the same length; ``aps`` is (rows, 7)."""

    def __call__(self, times: np.ndarray, lon: np.ndarray, lat: np.ndarray, alt_km: np.ndarray, f107: np.ndarray, f107a: np.ndarray, aps: np.ndarray, version: str) -> np.ndarray: ...


def _columns(versions: Sequence[str]) -> list[str]:
    return [f"msis_density_{kind}{v}" for kind in ("", "ct_") for v in versions]


def _densities(rows: pd.DataFrame, model: DensityModel, versions: Sequence[str]) -> dict[str, np.ndarray]:
    """The density columns and ap of a batch."""
    n = len(rows)
    where = rows["timestamp"].to_numpy(), rows[LONGITUDE].to_numpy(), rows[LATITUDE].to_numpy(), rows[ALTITUDE].to_numpy() / 1000.0
    aps = np.full((n, 7), np.nan)
    given = rows["aps"].notna().to_numpy()
    if given.any():
        aps[given] = np.concatenate(rows["aps"].to_numpy()[given]).astype(float).reshape(-1, 7)
    flux, mean, index = CONSTANT
    forcings = {"": (rows["f107"].to_numpy(), rows["f107a"].to_numpy(), aps), "ct_": (np.full(n, flux), np.full(n, mean), np.full_like(aps, index))}
    made = {f"msis_density_{kind}{v}": np.asarray(model(*where, *forcing, version=v), dtype=float).reshape(n, -1)[:, 0] if n else [] for kind, forcing in forcings.items() for v in versions}
    return {**made, "ap": aps[:, 0] if n else []}


def _schema(df: DataFrame, versions: Sequence[str], *more: T.StructField) -> T.StructType:
    kept = [f for f in df.schema.fields if f.name != "aps"]
    return T.StructType([*kept, *[T.StructField(n, T.DoubleType()) for n in _columns(versions)], T.StructField("ap", T.DoubleType()), *more])


def add_densities(df: DataFrame, model: DensityModel, versions: Sequence[str] = VERSIONS) -> DataFrame:
    """``df`` (timestamp, position, f107, f107a, aps and any others) with a density for each version under the actual
    conditions (msis_density_<version>) and under constant ones (msis_density_ct_<version>), and ap, the first index.

    All columns of a batch come from one call of the function, so they can't be attached to other rows; the size of a
    batch is the session's spark.sql.execution.arrow.maxRecordsPerBatch."""
    schema = _schema(df, versions)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield rows.drop(columns="aps").assign(**_densities(rows, model, versions))[schema.names]

    return df.mapInPandas(run, schema)


def densities_by_file(df: DataFrame, model: DensityModel, file: str, told: Callable[[int, str | None, float], None], versions: Sequence[str] = VERSIONS) -> DataFrame:
    """As ``add_densities``, of the rows of many files, told by the column ``file``, with _failed: a file that the model fails
    on doesn't stop the others.  A batch that fails is run again file by file; rows of a file that fails then have no
    densities.  ``told`` gets each batch's file, its error and the seconds it took."""
    schema = _schema(df, versions, T.StructField("_failed", T.BooleanType()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            began = time.monotonic()
            try:
                made = _densities(rows, model, versions)
            except Exception:  # told by file below
                made = None
            took = (time.monotonic() - began) / max(1, len(rows))
            for number, part in rows.groupby(file, sort=False):
                began, failed = time.monotonic(), False
                if made is not None:
                    own = {k: np.asarray(v)[rows.index.get_indexer(part.index)] for k, v in made.items()}
                    told(int(number), None, took * len(part))
                else:
                    try:
                        own = _densities(part, model, versions)
                        told(int(number), None, time.monotonic() - began)
                    except Exception as error:  # this file's own
                        failed, own = True, dict.fromkeys((*_columns(versions), "ap"), np.full(len(part), np.nan))
                        told(int(number), str(error)[:240], time.monotonic() - began)
                yield part.drop(columns="aps").assign(**own, _failed=failed)[schema.names]

    return df.mapInPandas(run, schema)
