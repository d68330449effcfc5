"""Pixels with very many samples, boxes asked of chains of operators, tiled images, picks, counts on the way, SQL functions."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamella.operators import blur, channels, color, depth_blur, geometry, masks, matte, ordered, thin, tidy, walk
from lamella.operators.walk import Samples
from lamella.plans import table_functions
from lamella.sources import tables
from lamella.sources.image import DeepImage, manifest, read

from .conftest import SMALL

COLUMNS = "x int, y int, s int, front double, back double, alpha double, red double, green double, blue double"


def scattered_image(spark, seed=0, n=400, side=12):
    rng = random.Random(seed)
    rows = [(rng.randrange(side), rng.randrange(side), i, float(f := rng.randrange(20)), f + rng.choice([0.0, 0.5, 3.0]), *[rng.random() for _ in range(4)]) for i in range(n)]
    return DeepImage(spark.createDataFrame(rows, COLUMNS), (0, 0, side, side), (side, side))


def rows(image, digits=9):
    return sorted(tuple(round(v, digits) for v in r) for r in image.df.collect())


def pixel(n, seed=0, depth=1.0, alpha=0.9):
    rng = np.random.default_rng(seed)
    front = np.sort(rng.uniform(0, 10, n).round(2))
    zeros = np.zeros(n, np.int32)
    return Samples({"x": zeros, "y": zeros, "s": np.arange(n, dtype=np.int32), "front": front, "back": front + rng.uniform(0, depth, n).round(2), "alpha": rng.uniform(0, alpha, n), "red": rng.uniform(0, 1, n), "green": rng.uniform(0, 1, n), "blue": rng.uniform(0, 1, n)})


# walks: what is left of few large pixels, padded blocks, the sweep


def joined(parts):
    out = {}
    for c in parts[0].columns:
        out[c] = np.concatenate([np.full(p.size, i, np.int32) if c == "x" else p[c] for i, p in enumerate(parts)])
    return Samples(out)


@pytest.mark.parametrize("settings", [thin.Thinning(), thin.Thinning(occlusion_cutoff=False, contribution_min=0.05, tolerance=0.5, color_tolerance=0.4), thin.Thinning(depth_clip=True, z_near=2, z_far=7, contribution_cull=False, tolerance=0.3), thin.Thinning(cull_transparent=False, contribution_min=-1.0, occlusion_alpha=2.0, tolerance=0.2, color_tolerance=0)])
def test_few_and_many_pixels_are_walked_alike(settings, monkeypatch):
    alone = [pixel(n, n, alpha=a) for n, a in ((1, 0.9), (7, 0.9), (300, 0.01), (5000, 0.001))]
    together = thin.thinned(joined(alone), settings)
    monkeypatch.setattr(thin, "FEW", 0)
    monkeypatch.setattr(walk, "FEW", 0)
    ranked = thin.thinned(joined(alone), settings)
    for c in ranked.columns:
        assert np.array_equal(together[c], ranked[c]), c


def test_blocks_hold_every_run():
    rng = np.random.default_rng(1)
    lengths = np.concatenate((rng.integers(1, 60, 200), [3000, 2999, 1]))
    starts, size = np.cumsum(lengths) - lengths, int(lengths.sum())
    values = rng.uniform(0, 1, size)
    dealt = list(walk.blocks(starts, size))
    assert sorted(np.concatenate([run for run, _, _ in dealt])) == list(np.flatnonzero(lengths > 1))
    assert sum(at.size for _, at, _ in dealt) < 1.3 * size
    for s, n, total in zip(starts, lengths, walk.totals(values, starts, dealt)):
        want, t = 0.0, 1.0
        for i in range(s, s + n):
            want += values[i]
        assert total == want
    t = walk.let_through(values, starts)
    for s, n in zip(starts, lengths):
        want = 1.0
        for i in range(s, s + n):
            assert t[i] == want
            want *= 1 - values[i]


def plain_tidy(samples):
    """By definition: each volume cut at every depth of the pixel inside it, equal intervals composited by s."""
    depths = sorted({*samples["front"], *samples["back"]})
    pieces = {}
    for i in range(samples.size):
        f, b, a = samples["front"][i], samples["back"][i], samples["alpha"][i]
        inner = [f, *[d for d in depths if f < d < b], b]
        for lo, hi in zip(inner, inner[1:]):
            cut = a if len(inner) == 2 else 1 - (1 - a) ** ((hi - lo) / (b - f))
            share = 1.0 if len(inner) == 2 else cut / a if a > 1e-6 else 0.0
            pieces.setdefault((lo, hi), []).append((cut, samples["red"][i] * share))
    out = []
    for (lo, hi), held in sorted(pieces.items()):
        t, alpha, red = 1.0, 0.0, 0.0
        for a, r in held:
            alpha, red, t = alpha + a * t, red + r * t, t * (1 - a)
        out.append((lo, hi, alpha, red))
    return out


@pytest.mark.parametrize("block", [1, 7, 1 << 17])
def test_sweep_is_the_definition(block, monkeypatch):
    monkeypatch.setattr(tidy, "PIECES", block)
    for seed in range(6):
        samples = pixel(40, seed, depth=(0.0, 0.02, 4.0)[seed % 3])
        got = tidy.tidied(samples)
        want = plain_tidy(samples)
        assert np.allclose(np.array(want), np.stack([got[c] for c in ("front", "back", "alpha", "red")], 1), rtol=0, atol=1e-12)


def test_nested_volumes_take_little_memory():
    import tracemalloc

    n = 1500
    zeros = np.zeros(n, np.int32)
    nested = Samples({"x": zeros, "y": zeros, "s": np.arange(n, dtype=np.int32), "front": np.arange(n) * 1.0, "back": 2.0 * n - np.arange(n), "alpha": np.full(n, 0.001)})
    tracemalloc.start()
    out = tidy.tidied(nested)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert out.size == 2 * n - 1 and peak < 60 << 20  # all pieces at once: 2.2 million, over 200 MB
    assert out["alpha"].max() == pytest.approx(out["alpha"][n - 1])


def test_pixels_that_span_batches(spark):
    """A pixel is whole, however its rows are batched, and pixels beside it too."""
    image = scattered_image(spark, 3, 3000, 3)
    want = rows(thin.thin(image))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    old, walk.SAMPLES = walk.SAMPLES, 50
    try:
        assert rows(thin.thin(image)) == want
        assert rows(blur.blur(image)) == rows(blur.blur(image))
    finally:
        walk.SAMPLES = old
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_flatten_in_ranges(spark):
    n = 20_000
    one = spark.range(n).selectExpr("0 x", "0 y", "cast(id as int) s", "cast(pmod(xxhash64(id), 500) as double) front", "cast(pmod(xxhash64(id), 500) + 1 as double) back", "pmod(xxhash64(id, 1), 100) / 5e5 alpha", "0.5D red")
    other = spark.createDataFrame([(1, 0, 0, 1.0, 2.0, 0.5, 0.5), (1, 0, 1, 3.0, 4.0, 1.0, 0.5), (1, 0, 2, 5.0, 6.0, 1.0, 0.5)], one.schema)
    image = DeepImage(one.unionByName(other), (0, 0, 2, 1), (2, 1))
    assert rows(ordered.flatten(image, most=1000)) == rows(ordered.flatten(image))
    assert rows(ordered.flatten(image, most=n)) == rows(ordered.flatten(image))
    cuts = {r.x: len(r._cuts) for r in ordered._cuts(image.df, 1000).collect()}
    assert cuts.keys() == {0} and 10 <= cuts[0] <= 30  # tied depths are cut apart by s
    opaque = image.with_df(image.df.withColumn("alpha", F.lit(1.0)))
    assert rows(ordered.flatten(opaque, most=1000)) == rows(ordered.flatten(opaque))


def test_gate_of_one_large_pixel(spark):
    """100,000 samples against 100,000 of the gate are swept, not compared."""
    n = 100_000
    side = spark.range(n).selectExpr("0 x", "0 y", "cast(id as int) s", "id * 10D front", "id * 10D + 1 back", "0.5D alpha")
    gate = DeepImage(spark.range(n).selectExpr("0 x", "0 y", "id * 20D + 3 front", "id * 20D + 4 back"), (0, 0, 1, 1), (1, 1))
    out = depth_blur.depth_blur(DeepImage(side, (0, 0, 1, 1), (1, 1)), 4.0, 3, "gaussian", gate=gate)
    # within 2 of [20 k + 3, 20 k + 4] are the samples at 20 k alone, and there are n / 2 of them
    assert out.df.count() == n // 2 * 3 + n // 2


def test_gate_brute_force(spark):
    image, gate = scattered_image(spark, 5, 200, 5), scattered_image(spark, 6, 25, 5)
    for empty in ("spread", "none"):
        spread = depth_blur.depth_blur(image, 1.0, 2, "linear", gate=gate, empty_gate=empty)
        held = {}
        for g in gate.df.collect():
            held.setdefault((g.x, g.y), []).append((g.front, g.back))
        want = 0
        for r in image.df.collect():
            own = held.get((r.x, r.y))
            touched = empty == "spread" if own is None else any(r.back + 0.5 >= f and r.front - 0.5 <= b for f, b in own)
            want += 2 if touched and 1 - (1 - r.alpha) ** 0.5 >= 1e-6 else 1
        # two even weights: both parts are made
        assert spread.df.count() == want


# blurs by tiles


def test_tiles_give_what_a_scatter_gives(spark, monkeypatch):
    image = scattered_image(spark, 7, 150, 9)
    want = rows(blur.blur2(image, (2, 1), "high"))
    monkeypatch.setattr(blur, "SCATTERED", 40)
    monkeypatch.setattr(blur, "SIDE", 2)
    monkeypatch.setattr(blur, "REACHES", 1)
    assert rows(blur.blur2(image, (2, 1), "high")) == want
    monkeypatch.undo()
    kernel = blur.Kernel(blur.plane_kernel(2, 1, "high"))
    scattered = {}
    for r in image.df.collect():
        for dx, dy, w in zip(kernel.dx, kernel.dy, kernel.weight):
            scattered[(r.x + dx, r.y + dy)] = scattered.get((r.x + dx, r.y + dy), 0) + 1
    assert {(r[0], r[1]) for r in want} == set(scattered)


def test_what_tiles_copy_grows_with_their_edges(spark):
    image = DeepImage(spark.range(128 * 128).selectExpr("cast(id % 128 as int) x", "cast(id div 128 as int) y", "0 s", "1D front", "2D back", "0.5D alpha"), (0, 0, 128, 128), (128, 128))
    kernel = blur.Kernel(blur.plane_kernel(2, 2, "high"))
    copies = blur._dealt(image.df, kernel, 32).count()
    assert copies < 128 * 128 * (1 + 2 * 2 / 32) ** 2 * 1.05 and len(kernel) == 25


# boxes


CHAINS = {
    "colours": lambda i: color.saturation(color.grade(i, gamma=2.0), 0.5),
    "blurs": lambda i: blur.blur2(color.gain(blur.blur(i, 2, 1), 0.5), (1, 1)),
    "walks": lambda i: thin.thin(tidy.optimize_samples(depth_blur.depth_blur(i, 1.0, 3, gate=thin.depth_clip(i, 0, 5)))),
    "keyed": lambda i: masks.keymix(blur.blur(i), color.invert(i), i.df.groupBy("x", "y").agg(F.avg("alpha").alias("value"))),
    "boxes": lambda i: geometry.copy_bbox(geometry.adjust_bbox(blur.blur(i), (-2, -1)), geometry.crop(i, (1, 1, 11, 8))),
    "flat": lambda i: ordered.flatten(matte.position_matte(channels.add_channels(i, ["z"]), ("red", "green", "blue"))),
}


@pytest.mark.parametrize("chain", sorted(CHAINS))
def test_a_box_asked_of_a_chain(spark, chain):
    image = scattered_image(spark, 8)
    box = (3, 2, 8, 7)
    whole = CHAINS[chain](image)
    part = whole.request(box)
    cut = whole.df.where((F.col("x") >= 3) & (F.col("x") < 8) & (F.col("y") >= 2) & (F.col("y") < 7))
    assert rows(part) == rows(whole.with_df(cut))
    assert part.bbox == box and len(rows(part)) > 0


def test_a_box_reaches_the_scan_grown_by_all_reaches(spark, tmp_path):
    scattered_image(spark, 9).write(str(tmp_path / "i"), tile=4)
    image = read(spark, str(tmp_path / "i"))
    asked = blur.blur2(color.grade(blur.blur(image, 2, 1)), (1, 1)).request((6, 6, 7, 7))
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = asked.df._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    pushed = set(re.findall(r"(GreaterThanOrEqual|LessThan)\((x|y),(-?\d+)\)", plan))
    assert {("GreaterThanOrEqual", "x", "3"), ("LessThan", "x", "10"), ("GreaterThanOrEqual", "y", "4"), ("LessThan", "y", "9")} <= pushed


def files_read(df):
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    scans = [plan]
    found = []
    while scans:
        node = scans.pop()
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            scans.append(node.executedPlan())
            continue
        if node.getClass().getSimpleName() == "FileSourceScanExec":
            found.append(node.metrics().apply("numFiles").value())
        children = node.children()
        scans += [children.apply(i) for i in range(children.size())]
        if node.getClass().getSimpleName().endswith("QueryStageExec"):
            scans.append(node.plan())
    return found


def test_a_tile_is_one_file(spark, tmp_path):
    image = scattered_image(spark, 10, 800, 16)
    path = str(tmp_path / "deep")
    image.write(path, tile=4)
    assert rows(read(spark, path)) == rows(image) and read(spark, path).bbox == image.bbox and read(spark, path).format == image.format
    part = read(spark, path, (4, 8, 8, 12))
    plan = part.df._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*tile_x", plan) and "PushedFilters: [IsNotNull" in plan
    assert files_read(part.df) == [1]
    assert rows(part) == rows(image.request((4, 8, 8, 12)))
    held = manifest(spark, path).collect()
    assert len(held) == 16 and sum(r.samples for r in held) == 800
    for r in held:
        assert r.tile_x * 4 <= r.min_x <= r.max_x < r.tile_x * 4 + 4 and r.min_front <= r.max_back and r.file.startswith("file:")
    assert read(spark, path, (4, 8, 4, 8)).df.count() == 0


def test_depths_choose_tiles(spark, tmp_path):
    rows_ = [(x, y, 0, float(10 * (x // 4)), float(10 * (x // 4) + 1), 0.5, 0.1, 0.1, 0.1) for x in range(16) for y in range(4)]
    path = str(tmp_path / "deep")
    DeepImage(spark.createDataFrame(rows_, COLUMNS), (0, 0, 16, 4), (16, 4)).write(path, tile=4)
    near = read(spark, path, depth=(9.5, 12.0))
    assert {r.x // 4 for r in near.df.collect()} == {1}
    assert 1 in files_read(read(spark, path, depth=(9.5, 12.0)).df)
    with pytest.raises(ValueError):
        DeepImage(spark.createDataFrame(rows_, COLUMNS), (0, 0, 16, 4), (16, 4)).write(str(tmp_path / "plain"))
        read(spark, str(tmp_path / "plain"))


def test_sizes_are_found_when_asked_for(spark, monkeypatch):
    called = []
    monkeypatch.setattr(tables, "height", lambda s, d: called.append(1) or 7)
    image = blur.blur(color.grade(tables.deep(spark, SMALL, ordered=True)))
    assert not called
    assert image.bbox == (-1, -1, 65, 8) and image.format == (64, 7) and called == [1]


# routes, picks, counts, SQL


def test_routes_that_find_nothing_take_no_slot(spark):
    image = scattered_image(spark, 11, 5)
    outs = [f"o{i}" for i in range(8)]
    matrix = "out1:99:in1:0,out1:--3:in1:0,out1:²:in1:0,out1:1:in1:99999999999," + ",".join(f"out1:{i}:in1:0:more" for i in range(8)) + ",out2:0:in1:0"
    made = channels.shuffle(image, in1=("red",), out1=outs, out2=("late",), matrix=matrix)
    assert set(outs) <= set(made.df.columns) and "late" not in made.df.columns
    assert all(r.o7 == r.red for r in made.df.collect())
    assert channels.parse_routes("out1: 1x:in1:+2") == [("out1", 1, "in1", 2)]


def test_picks_are_parameters(spark):
    rows_ = [(0, 0, 1, 1.0, 2.0, 0.5, 3.0, 0.0, 0.0), (0, 0, 0, 1.0, 2.0, 0.5, 2.0, 0.0, 0.0), (1, 0, 0, 1.0, 2.0, 1.0, 4.0, 0.0, 0.0)]
    image = DeepImage(spark.createDataFrame(rows_, COLUMNS), (0, 0, 2, 1), (2, 1))
    assert matte.pick(image, 0, 0, ["red"]) == [4.0]  # of equal depths the first in source order
    assert matte.pick(image, 0, 0, ["red"], "furthest") == [6.0] and matte.pick(image, 5, 5, ["red"]) is None
    found = matte.id_matte(image, "red", matte.picked_id(image, 0, 0, "red"), output=["green"])
    assert {(r.red, r.green) for r in found.df.collect()} == {(3.0, 0.0), (2.0, 0.5), (4.0, 1.0)}
    assert matte.id_matte(image, "red", matte.picked_id(image, 7, 7, "red"), output=["green"]).df.where("green > 0").count() == 0
    here = matte.position_matte(image, ("red", "green", "blue"), centre=matte.picked_centre(image, 1, 0, ("red", "green", "blue")), output=["green"])
    fixed = matte.position_matte(image, ("red", "green", "blue"), [[1, 0, 0, 4.0], [0, 1, 0, 0], [0, 0, 1, 0], [0, 0, 0, 1]], output=["green"])
    assert rows(here) == rows(fixed)


def test_counts_of_the_job_that_writes(spark, tmp_path):
    image = scattered_image(spark, 12)
    seen = thin.observed(image, thin.Thinning(tolerance=2.0, color_tolerance=0.9))
    seen.image.df.write.parquet(str(tmp_path / "thin"))
    want = thin.thin_stats(image, thin.Thinning(tolerance=2.0, color_tolerance=0.9)).head().asDict()
    assert seen.report() == want and want["removed"] > 0


def test_table_functions(spark):
    table_functions.register(spark)
    image = scattered_image(spark, 13)
    image.df.withColumn("red", F.when(F.col("red") > 0.1, F.col("red"))).createOrReplaceTempView("some")
    same = image.with_df(spark.table("some"))
    sql = lambda call: image.with_df(spark.sql(f"SELECT * FROM {call}"))
    assert rows(sql("deep_thin(TABLE(some), tolerance => 2.0D, color_tolerance => 0.9D, max_samples => 2)")) == rows(thin.thin(same, thin.Thinning(tolerance=2.0, color_tolerance=0.9, max_samples=2)))
    assert rows(sql("deep_optimize(TABLE(some))")) == rows(tidy.optimize_samples(same))
    assert sql("deep_tidy(TABLE(SELECT * FROM some WHERE x < 0))").df.count() == 0
    for call in ("deep_thin(TABLE(some), size => 1)", "deep_tidy(TABLE(SELECT x, y FROM some))", "deep_thin(TABLE(some), tolerance => NULL)"):
        with pytest.raises(Exception, match="unknown parameters|no columns|other than null"):
            sql(call).df.count()
