"""Decode throughput by core count: bits to pixels of a generated collection (4:2:0).

    python bench_images.py [CORES ...]
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

import numpy as np

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, HERE)
os.environ.setdefault("OMP_NUM_THREADS", "1")
os.environ["PYTHONPATH"] = os.pathsep.join([HERE, os.environ.get("PYTHONPATH", "")])

STEPS = os.environ.get("BENCH_STEPS", "headers,pixels,png").split(",")
SIDE, DISTINCT, COPIES = 256, 24, int(os.environ.get("BENCH_COPIES", "270"))


def collection() -> list[bytes]:
    """Images whose blocks have about as many coefficients as photographs of medium quality."""
    from lumiframe.sinks.jpeg import encode

    out = []
    for seed in range(DISTINCT):
        rng = np.random.default_rng(seed)
        blocks = []
        for x, y in ((2, 2), (1, 1), (1, 1)):
            n = SIDE // 16
            b = rng.integers(-12, 13, (n * y, n * x, 64))
            b[..., 0] = rng.integers(-60, 61, b.shape[:2])
            i = np.arange(64)
            b[..., 1:][rng.random((*b.shape[:2], 63)) > 0.6 / (1 + (i[1:] // 8) + i[1:] % 8)] = 0
            blocks.append(b)
        out.append(encode(SIDE, SIDE, [(2, 2), (1, 1), (1, 1)], blocks, [[8] * 64] * 3))
    return out


def run(cores: int) -> None:
    from pyspark.sql import SparkSession

    from lumiframe.plans.api import RasterCollection

    spark = SparkSession.builder.master(f"local[{cores}]").config("spark.driver.memory", "6g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.files.maxPartitionBytes", "4m").config("spark.sql.files.openCostInBytes", "0").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    data = collection()
    rows = [(f"{k}-{c}", len(d), d) for c in range(COPIES) for k, d in enumerate(data)]
    path = tempfile.mkdtemp(prefix="spark-bench-images-")
    # files of about equal size, several a core, read as they lie: no shuffle is timed
    spark.createDataFrame(rows, "image_id string, length long, content binary").repartition(64).write.mode("overwrite").parquet(path)
    images = RasterCollection(spark.read.parquet(path))
    warm = RasterCollection(spark.read.parquet(path).limit(100))
    times = {}
    for name, make in (("headers", lambda c: c.frames()), ("pixels", lambda c: c.pixel_blocks()), ("png", lambda c: c.png())):
        if name not in STEPS:
            continue
        make(warm).write.format("noop").mode("overwrite").save()
        began = time.time()
        make(images).write.format("noop").mode("overwrite").save()
        times[name] = time.time() - began
    n, mp = len(rows), len(rows) * SIDE * SIDE / 1e6
    print(json.dumps({"cores": cores, "images": n, "megapixels": round(mp, 1), "mb": round(sum(r[1] for r in rows) / 1e6, 1), "seconds": {k: round(v, 1) for k, v in times.items()}, "images_per_s": {k: round(n / v, 1) for k, v in times.items()}, "mp_per_s": {k: round(mp / v, 2) for k, v in times.items()}}))
    spark.stop()


if __name__ == "__main__":
    for c in [int(x) for x in sys.argv[1:]] or [1, 2, 4, 8]:
        run(c)
