"""A deep image made from order lines: an order is a pixel, its lines are the pixel's samples.

The expressions are plain SQL with double literals, so Spark and a second engine read the very same text.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame, SparkSession

from .image import DeepImage

#: Pixels in a row; the rows follow from the order keys.
WIDTH = 64
#: Each column's expression over ``lineitem``; later ones may use x, y, front and alpha.
BASE = {
    "x": "cast(l_orderkey % 64 as int)",
    "y": "cast(floor(l_orderkey / 64e0) as int)",
    "front": "l_quantity + l_linenumber * 1e-2",
    "back": "l_quantity + l_linenumber * 1e-2 + l_tax * 1e1",
    "alpha": "l_discount * 1e1",
    "red": "l_discount * 1e1 * l_extendedprice / 105e3",
    "green": "l_discount * 1e1 * l_tax * 12.5e0",
    "blue": "l_discount * 1e1 * (l_partkey % 100) / 1e2",
    "id": "l_discount * 1e1 * l_suppkey",
    "pos_x": "l_discount * 1e1 * (cast(l_orderkey % 64 as int) / 64e0 - 5e-1)",
    "pos_y": "l_discount * 1e1 * (cast(floor(l_orderkey / 64e0) as int) / 64e0 - 5e-1)",
    "pos_z": "l_discount * 1e1 * (l_quantity + l_linenumber * 1e-2) / 5e1",
}
ORDER = "front, l_tax, l_partkey, l_suppkey, l_extendedprice, l_discount, l_shipdate, l_returnflag, l_linestatus"
MASK = {"x": "cast(o_orderkey % 64 as int)", "y": "cast(floor(o_orderkey / 64e0) as int)", "value": "max(least(1e0, o_totalprice / 3e5))"}


def columns(ordered: bool) -> str:
    """The select list. With ``ordered``, s numbers the samples of a pixel; it needs one shuffle by pixel."""
    made = ", ".join(f"{e} as {c}" for c, e in BASE.items())
    return made + (f", cast(row_number() over (partition by cast(l_orderkey % 64 as int), cast(floor(l_orderkey / 64e0) as int) order by {ORDER}) - 1 as int) as s" if ordered else "")


def deep_sql(where: str = "1 = 1", ordered: bool = True) -> str:
    """The deep image as a query over ``lineitem``."""
    order = ORDER.replace("front", BASE["front"])
    return f"select {columns(ordered).replace(ORDER, order)} from lineitem where {where}"


def mask_sql() -> str:
    return f"select {MASK['x']} as x, {MASK['y']} as y, {MASK['value']} as value from orders group by 1, 2"


def deep(spark: SparkSession, sf_dir: str, where: str = "1 = 1", ordered: bool = True) -> DeepImage:
    """The deep image; without ``ordered`` it has no s and no shuffle."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where(where)
    order = ORDER.replace("front", BASE["front"])
    made = [f"{e} as {c}" for c, e in BASE.items()]
    if ordered:
        made.insert(2, f"cast(row_number() over (partition by {BASE['x']}, {BASE['y']} order by {order}) - 1 as int) as s")
    rows = cache(lambda: height(spark, sf_dir))
    return DeepImage(lines.selectExpr(*made), lambda: (0, 0, WIDTH, rows()), lambda: (WIDTH, rows()))


def height(spark: SparkSession, sf_dir: str) -> int:
    """The rows of pixels that all orders take, from the greatest order key: a job over one column, run when a box or format is asked for."""
    top = spark.read.parquet(f"{sf_dir}/orders.parquet").agg({"o_orderkey": "max"}).head()[0]
    return 0 if top is None else top // WIDTH + 1


def mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A flat image (x, y, value), one row per pixel."""
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr(f"{MASK['x']} as x", f"{MASK['y']} as y", "least(1e0, o_totalprice / 3e5) as value")
    return rows.groupBy("x", "y").agg({"value": "max"}).withColumnRenamed("max(value)", "value")
