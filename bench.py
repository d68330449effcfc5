"""Times the headline queries over whole tables and prints one JSON line. BENCH_SF_DIR and BENCH_CPUS choose data and cores."""

from __future__ import annotations

import json
import os
import statistics
import time

import numpy as np
from pyspark.sql import SparkSession

from lamella.functions.noise import TYPES, Noise
from lamella.plans.registry import QUERIES

HEADLINE = ("flatten", "grade", "saturation_rec709", "hue_shift", "grade_side_mask", "keymix", "id_matte", "position_matte_sphere", "world_position", "occlusion_cutoff", "contribution_cull", "smart_merge", "deep_thinner", "deep_thinner_default", "tidy", "depth_blur_gaussian", "depth_blur_gated", "optimize_samples", "blur2_medium", "blur2_2d", "noise_simplex", "noise_perlin", "noise_value", "noise_cubic", "noise_cellular")


def noise_points(dims: int, count: int = 32**3) -> dict[str, float]:
    """Nanoseconds a point of the bare noise functions on one thread, single octave; the median of three runs."""
    p = np.random.default_rng(0).uniform(-50, 50, (dims, count))
    out = {}
    for kind in TYPES:
        noise = Noise(kind, octaves=1)
        noise.at(p[:, :100])
        took = []
        for _ in range(3):
            began = time.perf_counter()
            noise.at(p)
            took.append((time.perf_counter() - began) / count * 1e9)
        out[kind] = round(statistics.median(took), 1)
    return out


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    points = {f"noise_ns_per_point_{dims}d": noise_points(dims) for dims in (3, 4)}  # before Spark takes cores
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        began = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - began

    for name in ("grade", "flatten", "smart_merge", "noise_value"):  # start what all queries share: code, workers, file listings
        run(name)
    took = {name: round(statistics.median(run(name) for _ in range(3)), 3) for name in HEADLINE}
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), **points}))


if __name__ == "__main__":
    main()
