"""What keeps queries in proportion to their input: pixels that are worked on together, and what isn't shuffled."""

from types import SimpleNamespace

import numpy as np
from pyspark.sql import Row
from pyspark.sql import types as T

from lamella.operators import blur as B
from lamella.operators import depth_blur as D
from lamella.plans import table_functions
from lamella.plans.registry import core
from lamella.sources import tables

from .conftest import SMALL


def test_table_functions_take_many_pixels_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(table_functions, "HELD", 5)
    sizes = []

    def apply(samples):
        sizes.append((len(samples.starts), samples.size))
        return samples

    made = table_functions.table_function(apply, ())
    schema = T._parse_datatype_string("x int, y int, s int, front double, back double, alpha double")
    asked = made.analyze(SimpleNamespace(dataType=schema))
    assert [c.name for c in asked.partitionBy] == ["floor(x / 32)", "floor(y / 32)"]
    assert [c.name for c in asked.orderBy] == ["x", "y", "front", "back", "s"]
    rows = [Row(x=x, y=0, s=s, front=float(s), back=float(s), alpha=None if s else 0.5) for x in range(6) for s in range(2)]
    rows += [Row(x=6, y=0, s=s, front=float(s), back=float(s), alpha=0.5) for s in range(20)]
    function, out = made(), []
    for r in rows:
        out += function.eval(r) or []
    out += list(function.terminate())
    assert sizes == [(3, 6), (3, 6), (1, 20)]  # whole pixels, also one of more samples than are held
    assert [r[:3] for r in out] == [(r.x, r.y, r.s) for r in rows]
    assert [r[5] for r in out] == [1.0 if r.alpha is None else r.alpha for r in rows]


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_corrected_blur_shuffles_no_more_than_one_without(spark):
    image = core(tables.deep(spark, SMALL))
    plain, corrected = (B.blur2(image, (1, 0), "medium", c, 20, 0.05, 0.05) for c in (False, True))
    assert _plan(corrected.df).count("Window") == _plan(plain.df).count("Window")
    made = B.corrected(plain)
    key = lambda r: (r["x"], r["y"], r["front"], r["back"], r["s"])
    found, wanted = (sorted(i.df.collect(), key=key) for i in (corrected, made))
    assert [key(r) for r in found] == [key(r) for r in wanted]
    assert np.array_equal(*[[[r[c] for c in ("alpha", "red", "green", "blue")] for r in rows] for rows in (found, wanted)])


def test_depth_blur_sorts_samples_not_their_parts(spark):
    plan = _plan(D.depth_blur(core(tables.deep(spark, SMALL)), 2.0, 5, "exponential").df)
    assert "Generate" not in plan and "explode" not in plan
