"""The operators as table functions of SQL: ``SELECT * FROM deep_thin(TABLE(samples), tolerance => 0.5)``.

A function's ``analyze`` takes the table's columns for its result and asks Spark for tiles of whole pixels in depth order, so the
query needs no PARTITION BY; Spark shuffles once, by tile. Rows are held until there are enough for array operations over many
pixels, or until a pixel's last.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import fields

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from ..operators import thin, tidy, walk
from ..operators.walk import Samples
from ..sources.image import DEPTH_ORDER, PIXEL, PLACE

#: The arrays that columns of each type become; channels are doubles.
WHOLE = {"x": np.int64, "y": np.int64, "s": np.int64}
#: Pixels on each side of the tiles that Spark deals, and samples that are held of one, unless one pixel has more.
SIDE, HELD = 32, 20_000


def _thin(samples: Samples, **settings) -> Samples:
    return thin.thinned(samples, thin.Thinning(**settings))


def _tidy(samples: Samples) -> Samples:
    return tidy.tidied(samples)


def _optimize(samples: Samples, merge_tolerance: float = 0.001, color_tolerance: float = 0.01, max_samples: int = 100) -> Samples:
    return walk.merged(tidy.tidied(samples), merge_tolerance, tidy.unpremultiplied(color_tolerance), max_samples)


def _merge(samples: Samples, tolerance: float = 0.01, color_tolerance: float = 0.01, max_samples: int = 0) -> Samples:
    return walk.merged(samples, tolerance, thin.premultiplied(color_tolerance), max_samples)


#: Each function's name, what it does to a pixel's sorted samples, and its parameters.
FUNCTIONS: dict[str, tuple[Callable[..., Samples], tuple[str, ...]]] = {
    "deep_thin": (_thin, tuple(f.name for f in fields(thin.Thinning))),
    "deep_tidy": (_tidy, ()),
    "deep_optimize": (_optimize, ("merge_tolerance", "color_tolerance", "max_samples")),
    "deep_merge": (_merge, ("tolerance", "color_tolerance", "max_samples")),
}


def table_function(apply: Callable[..., Samples], parameters: tuple[str, ...]) -> type:
    class Function:
        @staticmethod
        def analyze(samples: AnalyzeArgument, **settings: AnalyzeArgument) -> AnalyzeResult:
            names = samples.dataType.fieldNames()
            if unknown := sorted(set(settings) - set(parameters)):
                raise ValueError(f"unknown parameters {unknown}; there are {list(parameters)}")
            if missing := [c for c in (*PIXEL, "front", "back") if c not in names]:
                raise ValueError(f"the table has no columns {missing}")
            if any(v.value is None for v in settings.values()):
                raise ValueError("parameters are constants other than null")
            return AnalyzeResult(
                schema=samples.dataType,
                partitionBy=[PartitioningColumn(f"floor({c} / {SIDE})") for c in PIXEL],
                orderBy=[OrderingColumn(c) for c in (*PIXEL, *DEPTH_ORDER) if c in names],
            )

        def __init__(self):
            self.rows, self.pixel, self.settings = [], None, {}

        def eval(self, row, **settings):
            ready = None
            if len(self.rows) >= HELD:
                if self.pixel is None:
                    self.pixel = (self.rows[-1].x, self.rows[-1].y)
                if (row.x, row.y) != self.pixel:  # what is held is whole pixels
                    ready, self.rows, self.pixel = self.made(), [], None
            self.rows.append(row)
            self.settings = settings
            return ready

        def terminate(self):
            return self.made()

        def made(self) -> list[tuple]:
            if not self.rows:
                return []
            names = self.rows[0].__fields__
            columns = {}
            for n, values in zip(names, zip(*self.rows, strict=True), strict=True):
                if n not in PLACE and None in values:
                    values = [(1.0 if n == "alpha" else 0.0) if v is None else v for v in values]
                columns[n] = np.array(values, WHOLE.get(n, float))
            settings = {k: float(v) if type(v).__name__ == "Decimal" else v for k, v in self.settings.items()}
            with np.errstate(all="ignore"):
                made = apply(Samples(columns), **settings)
            return list(zip(*[made[n].tolist() for n in names], strict=True))

    return Function


def register(spark: SparkSession) -> None:
    """Makes the functions known to the session's SQL."""
    for name, (apply, parameters) in FUNCTIONS.items():
        spark.udtf.register(name, udtf(table_function(apply, parameters)))
