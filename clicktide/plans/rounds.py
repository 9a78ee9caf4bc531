"""Rounds of a fit on storage, so that a fit that was stopped goes on where it was.

    <path>/round-<i>/vectors   (key, n, w, mu, g): weights after the round, its direction, its gradient
    <path>/round-<i>/trace     trace rows up to this round; written last

Vectors lie in ranges of dimensions, so that they may be longer than one task or the driver can hold.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from clicktide.operators.tiles import COLUMNS
from clicktide.session import drop_path, names_in, path_exists

VECTORS_SCHEMA = "key INT, n INT, w BINARY, mu BINARY, g BINARY"


@dataclass
class Rounds:
    """Saved rounds of a fit under `path`. Fits that differ in `terms` do not continue each other."""

    spark: SparkSession
    path: str
    schema: str
    terms: dict[str, float]

    def _place(self, i: int) -> str:
        return f"{self.path}/round-{i:06d}"

    def last(self) -> int | None:
        """The last finished round."""
        names = sorted(n for n in names_in(self.spark, self.path) if n.startswith("round-"))
        numbers = [int(n.removeprefix("round-")) for n in reversed(names)]
        return next((i for i in numbers if path_exists(self.spark, f"{self._place(i)}/trace/_SUCCESS")), None)

    def save(self, i: int, vectors: DataFrame, trace: list[dict]) -> None:
        """Round `i` with all trace rows so far. The round before stays until the next one is saved."""
        names = [part.split()[0] for part in self.schema.split(", ")]
        rows = [(*(r[c] for c in names), *map(float, self.terms.values())) for r in trace]
        schema = ", ".join([self.schema, *(f"_{t} DOUBLE" for t in self.terms)])
        # What an earlier attempt left unfinished goes first.
        drop_path(self.spark, self._place(i))
        vectors.write.parquet(f"{self._place(i)}/vectors")
        self.spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{self._place(i)}/trace")
        drop_path(self.spark, self._place(i - 2))

    def load(self, i: int) -> tuple[DataFrame, list[dict]]:
        """(vectors, trace rows) of round `i`."""
        rows = [r.asDict() for r in self.spark.read.parquet(f"{self._place(i)}/trace").orderBy("iter").collect()]
        for name, value in self.terms.items():
            saved = {r.pop(f"_{name}") for r in rows}
            if saved != {float(value)}:
                raise ValueError(f"{self.path} holds a fit with {name} {saved}, not {value}")
        return self.spark.read.schema(VECTORS_SCHEMA).parquet(f"{self._place(i)}/vectors"), rows


def vector_ranges(spark: SparkSession, w: np.ndarray, mu: np.ndarray, g: np.ndarray, columns: int = COLUMNS) -> DataFrame:
    """Arrays of the driver as rows of `VECTORS_SCHEMA`."""
    starts = range(0, max(len(w), 1), columns)
    cut = lambda v: pa.array([v[s : s + columns].tobytes() for s in starts], pa.binary())
    sizes = [len(w[s : s + columns]) for s in starts]
    table = {"key": pa.array(range(len(starts)), pa.int32()), "n": pa.array(sizes, pa.int32())}
    return spark.createDataFrame(pa.table({**table, "w": cut(w), "mu": cut(mu), "g": cut(g)}), VECTORS_SCHEMA)


def vector_arrays(vectors: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(w, mu, g) of saved vectors, for models that the driver holds."""
    table = vectors.orderBy("key").toArrow()
    whole = lambda name: np.concatenate([np.frombuffer(v.as_buffer(), np.float64) for v in table.column(name)])
    return whole("w").copy(), whole("mu").copy(), whole("g").copy()
