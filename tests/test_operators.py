"""Golden vectors (independent arithmetic) and properties."""


import numpy as np
import pytest

from lamella.functions.kernels import depth_weights, half_kernel
from lamella.functions.noise import Noise, default_vectors, gradients, permutation
from lamella.operators import blur, channels, color, depth_blur, geometry, masks, matte, ordered, thin, tidy
from lamella.sources.constant import alpha_scaled, constant
from lamella.sources.image import RGB, DeepImage, read

FIELDS = ("x", "y", "s", "front", "back", "alpha", "red", "green", "blue")


@pytest.fixture
def image(spark):
    def make(rows, names=FIELDS):
        return DeepImage(spark.createDataFrame([tuple(r) for r in rows], " , ".join(f"{n} {'int' if n in ('x', 'y', 's') else 'double'}" for n in names)), (0, 0, 4, 4), (4, 4))

    return make


def sample(front, alpha=1.0, colour=(0.0, 0.0, 0.0), back=None, s=0, x=0, y=0):
    return (x, y, s, float(front), float(front if back is None else back), float(alpha), *map(float, colour))


def rows(img, *names):
    return [tuple(r) for r in img.df.orderBy("x", "y", "front", "back", "s").select(*names).collect()]


def values(img, *names):
    return pytest.approx(rows(img, *names), abs=2e-6)


def one(fn, colour, alpha=1.0, make=None, **kw):
    return rows(fn(make([sample(0, alpha, [c * alpha for c in colour])]), **kw), *RGB)[0]


def test_masked_rule(image, spark):
    img = image([sample(1, 0.5, (0.2, 0, 0)), sample(1, 0.5, (0.2, 0, 0), x=1)])
    side = spark.createDataFrame([(0, 0, 0.8)], "x int, y int, value double")
    out = color.multiply(img, (2, 2, 2), mix=0.5, side_mask=side)
    assert rows(out, "red") == [pytest.approx((0.28,)), (0.2,)]
    assert color.multiply(img, (2, 2, 2), mix=0).df is img.df


def test_colour_vectors(image):
    c = (0.8, 0.4, 0.2)
    assert one(color.saturation, c, make=image, saturation=0.5) == pytest.approx((0.6353, 0.4353, 0.3353), abs=1e-4)
    assert one(color.saturation, c, make=image, saturation=0, mode="ccir601") == pytest.approx((0.4968,) * 3)
    assert one(color.hue_shift, c, make=image, hue=120) == pytest.approx((0.489809, 0.380166, 1.115700), abs=1e-6)
    assert one(color.gamma, (0.25,) * 3, make=image, value=(2, 2, 2)) == pytest.approx((0.5,) * 3)
    assert one(color.posterize, (0.47, -0.47, 0), make=image) == pytest.approx((0.4, -0.4, 0))
    g = {"whitepoint": 0.8, "black": 0.1, "gamma": 2.0}
    assert one(color.grade, (0.4,) * 3, make=image, **g) == pytest.approx((0.741620,) * 3, abs=1e-6)
    back = color.grade(color.grade(image([sample(0, 0.5, (0.2, 0.1, 0.3))]), **g), reverse=True, **g)
    assert rows(back, *RGB)[0] == pytest.approx((0.2, 0.1, 0.3))


def test_alpha_zero_reads_zero(image):
    img = image([sample(0, 0, (0.5, 0.5, 0.5))])
    for fn in (color.add, color.saturation, color.hue_shift, color.grade):
        assert rows(fn(img), *RGB)[0] == (0, 0, 0)


def test_lookup_curves(image):
    curves = color.set_rgb((0.5, 0.5, 0.5), (0.75, 0.5, 0.25))
    assert one(color.color_lookup, (0.5, 0.5, 0.5), make=image, **curves) == pytest.approx((0.75, 0.5, 0.25))
    assert one(color.color_lookup, (0.3, 1.5, -1), make=image) == pytest.approx((0.3, 1.5, -1))


def test_smooth_curves(image):
    through = ((0, 0), (0.25, 0.4), (1, 1))
    for x, y in through:
        assert one(color.color_lookup, (x, x, x), make=image, master=through, smooth=True) == pytest.approx((y, y, y))
    near = lambda x: one(color.color_lookup, (x, x, x), make=image, master=through, smooth=True)[0]
    for x in (0.0, 0.25, 1.0):  # the slopes agree on both sides
        assert (near(x + 1e-5) - near(x)) / 1e-5 == pytest.approx((near(x) - near(x - 1e-5)) / 1e-5, rel=1e-2)
    assert near(2.0) == pytest.approx(1.8) and near(-1.0) == pytest.approx(-1.6)


def test_constant(spark):
    assert alpha_scaled(0.5, 0.5, 4, "multiplicative") == pytest.approx(0.159104, abs=1e-6)
    img = constant(spark, (3, 2), samples=2, color_front=(0, 0, 0, 0), color_back=(0, 0, 0, 0))
    assert img.df.count() == 12
    assert {r.alpha for r in img.df.collect()} == {1e-6}


def test_constant_floors_both_ends(spark):
    img = constant(spark, (1, 1), samples=2, color_front=(0, 0, 0, -0.5), color_back=(0, 0, 0, 0.5), alpha_mode="uniform")
    assert [r.alpha for r in img.df.orderBy("s").collect()] == pytest.approx([1e-6, 0.5 * 0.5 + 0.5 * 1e-6])


def placed(front, back, rgba):
    """A sample of pixel (0, 0); its place among equal depths follows from its number."""
    placed.n = getattr(placed, "n", 0) + 1
    return (0, 0, placed.n, float(front), float(back), *(None if v is None else float(v) for v in (rgba[3], *rgba[:3])))


def test_nested_keymix_numbers_samples_once(image, spark):
    mask = spark.createDataFrame([(0, 0, 0.5)], "x int, y int, value double")
    a, b, c = (image([placed(z, z, (v, v, v, 0.5)), placed(z + 1, z + 1, (v, v, v, 0.5))]) for z, v in ((1, 0.1), (2, 0.2), (3, 0.3)))
    out = masks.keymix(masks.keymix(a, b, mask), masks.keymix(b, c, mask), mask).df
    assert out.count() == 8 and out.select("x", "y", "s").distinct().count() == 8
    assert sorted(r.s for r in out.collect()) == list(range(8))


def test_a_mask_with_a_repeated_pixel_multiplies_nothing(image, spark):
    mask = spark.createDataFrame([(0, 0, 0.5), (0, 0, 0.25), (0, 0, None)], "x int, y int, value double")
    img = image([placed(1, 1, (0.4, 0.4, 0.4, 0.5)), placed(2, 2, (0.4, 0.4, 0.4, 0.5))])
    out = color.gain(img, 2.0, side_mask=mask).df.collect()
    assert [r.red for r in out] == pytest.approx([0.6, 0.6])


def test_tolerance_of_zero(image):
    img = image([placed(1, 1, (0.1, 0.1, 0.1, 0.5)), placed(1, 1, (0.4, 0.1, 0.1, 0.5)), placed(1.005, 1.005, (0.4, 0.4, 0.4, 0.5))])
    assert thin.smart_merge(img, tolerance=0).df.count() == 3
    assert thin.smart_merge(img, color_tolerance=0).df.count() == 1
    assert tidy.optimize_samples(img, merge_tolerance=0).df.count() == 2
    assert tidy.optimize_samples(img, merge_tolerance=0.01, color_tolerance=0).df.count() == 1
    assert thin.thin(img, thin.Thinning(tolerance=0, max_samples=2)).df.count() == 2


def test_missing_channels(image):
    """Without alpha samples are opaque; colours are compared as far as they are there."""
    img = image([placed(1, 1, (0.1, 0.2, 0.3, 0.5)), placed(1.0, 2, (0.1, 0.6, 0.3, 0.5)), placed(4, 4, (0.1, 0.2, 0.3, 0.5))])
    no_alpha = img.with_df(img.df.drop("alpha"))
    assert ordered.flatten(no_alpha).df.head().green == 0.2
    for fn in (thin.thin, thin.smart_merge, thin.contribution_cull, thin.volumetric_collapse, thin.occlusion, thin.alpha_cull, tidy.tidy, tidy.optimize_samples, blur.blur, depth_blur.depth_blur):
        out = fn(no_alpha)
        assert out.df.columns == no_alpha.df.columns and out.df.count() > 0, fn
    flat = img.with_df(img.df.drop("red", "blue"))
    assert thin.smart_merge(flat, 1.0, 0.1).df.count() == 3 and thin.smart_merge(flat.with_df(flat.df.drop("green")), 1.0, 0.1).df.count() == 2
    assert tidy.optimize_samples(flat, 0.001, 0.1).df.columns == flat.df.columns
    assert blur.blur(img.with_df(img.df.drop("red", "green", "blue"))).df.count() > 0


def test_nulls_read_as_missing(image):
    img = image([placed(1, 1, (0.1, None, 0.3, None)), placed(2, 2, (0.1, 0.6, 0.3, 0.5))])
    (row,) = thin.thin(img).df.collect()
    assert (row.red, row.green, row.alpha) == (0.1, 0.0, 1.0)


@pytest.mark.parametrize("fn", ["thin", "optimize"])
def test_a_pixel_of_many_samples(spark, fn):
    """All samples of one pixel, which walks take in time and memory that follow their number."""
    from time import perf_counter

    n = 20_000
    df = spark.range(n).selectExpr("0 as x", "0 as y", "cast(id as int) as s", "cast(id as double) as front", "id + 0.5D as back", "0.0005D as alpha", "0.0001D as red", "0D as green", "0D as blue")
    img = DeepImage(df, (0, 0, 1, 1), (1, 1))
    began = perf_counter()
    out = thin.thin(img, thin.Thinning(contribution_cull=False, tolerance=3.0)) if fn == "thin" else tidy.optimize_samples(img, 3.0, 0.1, 0)
    assert 2000 < out.df.count() <= n // 4 and perf_counter() - began < 10


def test_walks_across_batches(spark, monkeypatch):
    """Pixels that span batches, and batches that span pixels, come out as in one."""
    from lamella.operators import walk
    from lamella.sources import tables

    from .conftest import SMALL

    image = tables.deep(spark, SMALL)
    core = image.with_df(image.df.select("x", "y", "s", "front", "back", "alpha", *RGB))
    want = sorted(map(tuple, tidy.optimize_samples(core, 0.5, 0.2).df.collect()))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    monkeypatch.setattr(walk, "SAMPLES", 10)
    try:
        assert sorted(map(tuple, tidy.optimize_samples(core, 0.5, 0.2).df.collect())) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_noise_lookup():
    """A cellular noise that returns another noise's value at the nearest feature."""
    other = Noise("value", frequency=0.7)
    rng = np.random.default_rng(1)
    for dims in (2, 3, 4):
        p = rng.uniform(-9, 9, (dims, 200))
        got = Noise("cellular", frequency=1.0, returns="noise_lookup", lookup=other, distance="euclidean").at(p)
        near = Noise("cellular", frequency=1.0, returns="distance", distance="euclidean").at(p)
        vectors = default_vectors(dims) * 0.45
        perm = permutation(1337)
        for i in range(200):
            found = []
            for step in np.ndindex(*(5,) * dims):
                cell = np.trunc(p[:, i]).astype(int) + np.array(step) - 2
                index = 0
                for c in cell[::-1]:
                    index = perm[(c & 255) + index]
                found.append(cell + vectors[index])
            at = min(found, key=lambda f: ((f - p[:, i]) ** 2).sum())
            if abs(((at - p[:, i]) ** 2).sum() - near[i]) < 1e-9:
                assert got[i] == pytest.approx(other.at(at[:, None])[0])
    with pytest.raises(ValueError):
        Noise("cellular", returns="noise_lookup")


def test_routes(image):
    img = image([sample(0, 0.5, (0.1, 0.2, 0.3))])
    assert channels.shuffle(img) is img
    assert channels.parse_routes("rgba.red:0:in1:0,out1:0:in1:1") == []
    made = channels.shuffle(img, matrix=channels.format_routes({("out1", 0): ("in1", 2), ("out1", 3): ("const", 1)}))
    assert rows(made, "red", "green", "alpha") == [(0.3, 0.2, 1.0)]
    assert channels.layers(img) == ["none", "rgba"]


FIVE = [sample(1, 0.5, (0.25, 0, 0)), sample(2, 0, (0, 0, 0)), sample(3, 0.5, (0.4, 0, 0)), sample(4, 1, (0.6, 0, 0)), sample(5, 0.5, (0.5, 0, 0))]


def test_flatten_and_cuts(image):
    img = image(FIVE)
    assert rows(ordered.flatten(img), "alpha", "red") == [pytest.approx((1.0, 0.6))]
    cut = thin.occlusion(thin.alpha_cull(img), 0.999)
    assert [r[0] for r in rows(cut, "front")] == [1, 3, 4]
    culled = thin.contribution_cull(image([sample(i + 1, a) for i, a in enumerate((0.6, 0.2, 0.05, 0.5))]), 0.1)
    assert [r[0] for r in rows(culled, "front")] == [1, 4]


def test_groups_are_anchored(image):
    img = image([sample(z, 0.1, s=i) for i, z in enumerate((1.0, 1.006, 1.012, 1.02))])
    assert [r[0] for r in rows(thin.smart_merge(img, 0.01, 1), "front")] == [1.0, 1.012]


def test_opaque_hides_depth(image):
    out = ordered.flatten(image([sample(1, 1, back=2), sample(3, 1, back=9)]))
    assert rows(out, "front", "back") == [(1.0, 2.0)]


def test_collapse(image):
    img = image([sample(i, 0.001, s=i) for i in range(7)] + [sample(7, 0.5)] + [sample(8 + i, 0.001) for i in range(3)])
    assert [r[0] for r in rows(thin.volumetric_collapse(img), "front")] == [0, 4, 5, 6, 7, 8, 9, 10]


def test_thin_keeps_the_look(image):
    rng = np.random.default_rng(3)
    img = image([sample(z, a, np.array([0.5, 0.2, 0.1]) * a, s=i, x=i % 3) for i, (z, a) in enumerate(zip(rng.uniform(0, 9, 60), rng.uniform(0, 0.4, 60)))])
    before, after = rows(ordered.flatten(img), "alpha", "red"), rows(ordered.flatten(thin.thin(img)), "alpha", "red")
    assert np.allclose(before, after, atol=0.03)
    stats = thin.thinner_stats(img, thin.thin(img)).collect()[0]
    assert stats.samples_in == 60 and stats.removed == 60 - stats.samples_out and "reduction" in stats.report


def test_tidy_point_in_volume(image):
    out = tidy.tidy(image([sample(0, 0.75, back=10), sample(5, 0.5, s=1)]))
    assert rows(out, "front", "back", "alpha") == [pytest.approx((0, 5, 0.5)), pytest.approx((5, 5, 0.5)), pytest.approx((5, 10, 0.5))]


@pytest.mark.parametrize("seed", range(3))
def test_tidy_has_no_overlap_and_keeps_flat_alpha(image, seed):
    rng = np.random.default_rng(seed)
    img = image([sample(f, a, (a / 2, 0, 0), back=f + d, s=i) for i, (f, d, a) in enumerate(zip(rng.uniform(0, 9, 8), rng.uniform(0, 4, 8), rng.uniform(0, 1, 8)))])
    out = rows(tidy.tidy(img), "front", "back")
    assert all(b <= c + 1e-9 for (_, b), (c, _) in zip(out, out[1:]))
    assert rows(ordered.flatten(tidy.tidy(img)), "alpha")[0][0] == pytest.approx(rows(ordered.flatten(img), "alpha")[0][0])


def test_weights():
    assert depth_weights(5) == pytest.approx([0, 0.25, 0.5, 0.25, 0])
    assert depth_weights(5, "gaussian") == pytest.approx([0.006646, 0.194226, 0.598257, 0.194226, 0.006646], abs=1e-6)
    assert depth_weights(5, "smoothstep") == pytest.approx([0, 0.25, 0.5, 0.25, 0])
    assert depth_weights(5, "exponential") == pytest.approx([0.032207, 0.144343, 0.646900, 0.144343, 0.032207], abs=1e-6)
    assert depth_weights(2) == [0.5, 0.5]
    for quality, want in (("low", (1.196827, 0.013296)), ("medium", (0.978265, 0.010868)), ("high", (0.757007, 0.121496))):
        assert half_kernel(1, quality) == pytest.approx(want, abs=1e-6)
    for quality, want in (("low", (0.598413, 0.194276, 0.006648)), ("medium", (0.598257, 0.194226, 0.006646)), ("high", (0.516313, 0.224204, 0.017640))):
        assert half_kernel(2, quality) == pytest.approx(want, abs=1e-6)


@pytest.mark.parametrize("falloff", ["linear", "gaussian", "smoothstep", "exponential"])
def test_depth_blur_keeps_flat(image, falloff):
    img = image([sample(5, 0.75, (0.3, 0.2, 0.1))])
    out = depth_blur.depth_blur(img, 1, 5, falloff)
    assert rows(ordered.flatten(out), "alpha", "red") == [pytest.approx((0.75, 0.3), abs=1e-5)]
    if falloff == "linear":
        assert [r[0] for r in rows(out, "alpha")] == pytest.approx([0.292893, 0.5, 0.292893], abs=1e-6)


def test_depth_blur_gate(image):
    img = image([sample(1, 0.5), sample(8, 0.5, s=1), sample(1, 0.5, x=1)])
    out = depth_blur.depth_blur(img, 1, 5, "gaussian", gate=image([sample(1.2, 1)]))
    assert [r[0] for r in rows(out.with_df(out.df.where("x = 0 and front > 5")), "front")] == [8]
    assert out.df.where("x = 1").count() == 5
    assert depth_blur.depth_blur(img, 0).df is img.df


def test_alpha_correction(image):
    out = blur.corrected(image([sample(i, a, s=i) for i, a in enumerate((0.4, 0.3, 0.2))]))
    assert [r[0] for r in rows(out, "alpha")] == pytest.approx([0.4, 0.5, 2 / 3])


def test_blur_is_blur2_medium_and_box_is_widened(image):
    img = image([sample(1 + i, 0.5, (0.2, 0.1, 0), x=i % 3, y=i // 3) for i in range(9)])
    a, b = blur.blur(img, 1, 1), blur.blur2(img, (1, 1))
    assert rows(a, *FIELDS) == rows(b, *FIELDS)
    part = blur.blur(img, 1, 1, box=(1, 1, 2, 2))
    whole = geometry.crop(a, (1, 1, 2, 2))
    assert rows(part, "front", "alpha") == rows(whole, "front", "alpha") != []
    assert blur.blur(img, 0, 0) is img


def test_keymix(image, spark):
    a = image([sample(1, 1, (0.5, 0.5, 0.5))])
    b = image([sample(2, 1, (0.2, 0.2, 0.2)), sample(3, 1, (0.4, 0.4, 0.4), s=1)])
    mask = lambda v: spark.createDataFrame([(0, 0, v)], "x int, y int, value double")
    assert sorted(r[0] for r in rows(masks.keymix(b, a, mask(0.6)), "red")) == pytest.approx([0.08, 0.16, 0.3])
    assert rows(masks.keymix(b, a, mask(0.0)), "red") == rows(b, "red")
    assert rows(masks.keymix(b, a, mask(1.0)), "red") == rows(a, "red")
    assert masks.keymix(b, None, mask(1.0)) is b


def test_mattes(image):
    names = (*FIELDS, "px", "py", "pz", "id")
    img = image([(*sample(1, 0.5, (0.5, 0.5, 0.5)), 0.25, 0.0, 0.0, 3.5)], names)
    assert rows(matte.position_matte(img, ("px", "py", "pz"), output=["m"]), "m") == [pytest.approx((0.5 * 0.5,))]
    assert rows(matte.id_matte(img, "id", 7, output=["m"]), "m") == [(0.5,)]
    assert rows(matte.id_matte(img, "id", 7.5, output=["m"]), "m") == [(0.0,)]
    assert matte.pick(img, 0, 0, ["id"]) == [7.0]
    assert matte.pick(img, 3, 3, ["id"]) is None


def test_world_default_camera(image):
    out = matte.world_position(image([sample(10, 1, x=1, y=1)]), premultiplied_output=False)
    u = (1.5 / 4 * 2 - 1) * 10 / 2 / 50
    assert rows(out, "world_x", "world_y", "world_z") == [pytest.approx((u * 24.576, u * 18.672, -10))]


def test_noise_tables():
    assert permutation(1337)[:16].tolist() == [126, 26, 60, 40, 239, 145, 75, 108, 67, 106, 180, 51, 203, 88, 221, 191]
    assert sorted(permutation(1337)[:256]) == list(range(256))
    assert len(np.unique(gradients(), axis=0)) == 32


@pytest.mark.parametrize("kind", ["simplex", "perlin", "value", "cubic", "cellular"])
def test_noise_is_continuous_and_bounded(kind):
    p = np.random.default_rng(1).uniform(-20, 20, (4, 2000))
    for fractal in ("fbm", "billow", "rigid"):
        n = Noise(kind, fractal=fractal, returns="distance")
        a, b = n.at(p), n.at(p + 1e-7)
        assert np.abs(a - b).max() < 1e-3
        assert np.isfinite(a).all() and (kind == "cellular" or np.abs(a).max() < 3)
    assert np.array_equal(Noise(kind).at(p), Noise(kind).at(p))


@pytest.mark.parametrize("dims", [2, 3])
@pytest.mark.parametrize("kind", ["simplex", "perlin", "value", "cubic", "cellular", "white"])
def test_noise_in_fewer_dimensions(kind, dims):
    p = np.random.default_rng(1).uniform(-20, 20, (dims, 3000))
    n = Noise(kind, frequency=1, octaves=3, layered=True, returns="distance")
    assert np.isfinite(n.at(p)).all() and np.abs(n.at(p)).max() < 3
    assert np.array_equal(n.at(p)[:10], n.at(p[:, :10]))
    if kind != "white":
        assert np.abs(n.at(p) - n.at(p + 1e-8)).max() < 1e-4
    if kind == "simplex" and dims == 2:
        assert np.isfinite(Noise(kind, fractal="blend").at(p)).all()


def test_gradients():
    assert gradients(3)[[0, 1, 4, 8]].tolist() == [[1, 1, 0], [-1, 1, 0], [1, 0, 1], [0, 1, 1]]
    assert len(np.unique(gradients(3), axis=0)) == 12
    with pytest.raises(ValueError):
        Noise(fractal="blend").at(np.zeros((4, 1)))


def test_warp():
    p = np.random.default_rng(1).uniform(-5, 5, (3, 100))
    for octaves in (1, 4):
        moved = Noise(frequency=0.7).warped(p, 0.5, octaves)
        assert 0 < np.linalg.norm(moved - p, axis=0).max() <= 0.5 + 1e-9
    assert np.array_equal(Noise().warped(p, 0), p)


def test_lattice_noise_at_lattice_points():
    p = np.array([[1.0, 2], [3, 4], [5, 6], [7, 8]])
    assert Noise("perlin", frequency=1, octaves=1).at(p) == pytest.approx([0, 0])
    table = np.arange(256) / 256
    n = Noise("value", frequency=1, values=table)
    assert n.at(p) == pytest.approx(table[permutation(n.seed)[n._sum(0, p.astype(int))]])


@pytest.mark.parametrize("returns", ["cell_value", "distance2", "distance2_add", "distance2_sub", "distance2_mul", "distance2_div"])
def test_cellular_returns(returns):
    p = np.random.default_rng(2).uniform(-5, 5, (4, 50))
    f1, f2 = (Noise("cellular", returns=r).at(p) for r in ("distance", "distance2"))
    want = {"distance2": f2, "distance2_add": f2 + f1, "distance2_sub": f2 - f1, "distance2_mul": f2 * f1, "distance2_div": f1 / f2}
    got = Noise("cellular", returns=returns).at(p)
    assert np.allclose(got, want[returns]) if returns in want else (np.abs(got) <= 1).all()
    assert (f1 <= f2).all()


def test_empty_image(image):
    img = image([])
    for fn in (color.grade, ordered.flatten, thin.thin, tidy.optimize_samples, blur.blur, depth_blur.depth_blur):
        assert fn(img).df.count() == 0


def test_written_box_is_pushed_down(image, tmp_path, spark):
    img = image([sample(1, x=x, y=y) for x in range(4) for y in range(4)])
    img.write(str(tmp_path / "deep"), tile=2)
    part = read(spark, str(tmp_path / "deep"), (1, 1, 3, 3))
    assert part.df.count() == 4
    assert "PushedFilters: [IsNotNull" in part.df._jdf.queryExecution().toString()


def test_one_shuffle(image):
    plan = ordered.flatten(image(FIVE)).df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    assert "Exchange" not in color.grade(image(FIVE)).df._jdf.queryExecution().executedPlan().toString()


def test_stream(image, spark, tmp_path):
    from lamella.streaming import per_batch, read_stream, write_stream

    img = image([sample(z, 0.5, (0.2, 0.1, 0.3)) for z in range(5)])
    img.write(str(tmp_path / "in"))
    stream = read_stream(spark, str(tmp_path / "in"), img.df.schema, img.bbox, img.format)
    write_stream(color.grade(stream, gamma=2.0), str(tmp_path / "out"), str(tmp_path / "c"), once=True).awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == sorted(map(tuple, color.grade(img, gamma=2.0).df.collect()))
    seen = []
    per_batch(stream, lambda i, n: seen.append(ordered.flatten(i).df.count()), str(tmp_path / "d")).awaitTermination()
    assert sum(seen) == 1


def test_image_is_lazy(image):
    assert color.grade(image(FIVE)).channels == ["alpha", "red", "green", "blue"]
