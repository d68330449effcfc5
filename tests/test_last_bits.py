"""Results that hang on the last bit: what the SQL makes of exact halves of a millionth."""

import math

from lamella.operators import color as C
from lamella.operators import ordered as O
from lamella.sources.image import DeepImage


def image(spark, *samples):
    rows = [(i, 0, 0, 1.0, 2.0, a, r, g, b) for i, (a, r, g, b) in enumerate(samples)]
    return DeepImage(spark.createDataFrame(rows, "x int, y int, s int, front double, back double, alpha double, red double, green double, blue double"), (0, 0, len(samples), 1), (len(samples), 1))


def test_powers_are_those_of_the_c_library(spark):
    # 1.125 v + 0.1 is 0.9999999999999999, whose root is rounded down by the JVM
    a, b = 0.01 * 1e1, 0.01 * 1e1 * 80 / 1e2
    wanted = math.pow(1.125 * (b / a) + 0.1, 0.5) * a
    assert math.pow(1.125 * (b / a) + 0.1, 0.5) != math.sqrt(1.125 * (b / a) + 0.1)
    graded = C.grade(image(spark, (a, b, b, b)), whitepoint=0.8, black=0.1, gamma=2.0)
    assert graded.df.head()["blue"] == wanted
    assert O.flatten(graded).df.head()["blue"] == wanted


def test_slopes_are_those_of_the_numbers_as_written():
    assert C.tangents([(0, 0), (0.5, 0.71391), (1, 1)]) == [1.42782, 1.0, 0.57218]


def test_a_chain_divides_by_alpha_once(spark):
    values = [(a / 10, a / 10 * k / 7) for a in range(1, 10) for k in range(1, 60)]
    made = image(spark, *[(a, v, v, v) for a, v in values])
    wanted = [1 - (v / a + 0.2) for a, v in values]
    assert any(((v / a + 0.2) * a) / a != v / a + 0.2 for a, v in values)
    chained = C.invert(C.add(made, (0.2,) * 3)).df.orderBy("x").collect()
    assert [r["red"] for r in chained] == [w * a for w, (a, _) in zip(wanted, values)]
    assert set(chained[0].asDict()) == set(made.df.columns)


def test_a_chain_leaves_samples_without_alpha_and_other_channels(spark):
    made = image(spark, (0.0, 0.5, 0.5, 0.5), (0.5, 0.25, 0.125, 0.5))
    out = C.saturation(C.add(C.add(made, (0.5,) * 3), (0.25,) * 3, channels=("red",)), 0.0, "maximum").df.orderBy("x").collect()
    assert [out[0][c] for c in ("red", "green", "blue")] == [0.0] * 3
    assert [out[1][c] for c in ("red", "green", "blue")] == [0.75] * 3
