"""python -m tilespark.cli queries | run | encode | decode | experiment | bench | sweep

run NAME SF_DIR [--out DIR]: one query, shown or written as Parquet. encode IMAGES OUT [--quality 75]: image files to containers
as Parquet; with --basis (auto, or one encoder) to container files, each part by the encoder that suits it. decode IN OUT: either to PNG files. experiment IMAGES OUT [--sweep FILE]: encoders and qualities (or the profiles
of a sweep file, with quality and basis) on image files; facts, leaderboard, front and bootstrap below OUT. bench SF_DIR [--qualities 50,75,90]: sizes and errors by
quality. sweep SF_DIR: the same as an experiment, with its leaderboard.
"""

from __future__ import annotations

import argparse


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="tilespark", description=__doc__)
    sub = p.add_subparsers(dest="what", required=True)
    sub.add_parser("queries")
    run = sub.add_parser("run")
    run.add_argument("name")
    run.add_argument("sf_dir")
    run.add_argument("--out")
    for name in ("encode", "decode"):
        b = sub.add_parser(name)
        b.add_argument("source")
        b.add_argument("out")
        if name == "encode":
            b.add_argument("--quality", type=int, default=75)
            b.add_argument("--basis")
    e = sub.add_parser("experiment")
    e.add_argument("source")
    e.add_argument("out")
    e.add_argument("--sweep")
    e.add_argument("--qualities", default="50,75,90")
    for name in ("bench", "sweep"):
        b = sub.add_parser(name)
        b.add_argument("sf_dir")
        b.add_argument("--qualities", default="50,75,90")
    a = p.parse_args(argv)

    from tilespark import api, session
    from tilespark.plans import catalogue

    if a.what == "queries":
        print("\n".join(sorted(catalogue.queries())))
        return 0
    spark = session.build()
    if a.what == "run":
        df = catalogue.queries()[a.name](spark, a.sf_dir)
        df.write.parquet(a.out) if a.out else df.show(20, truncate=False)
        return 0
    if a.what == "encode" and a.basis:
        api.encode_pictures(spark, a.source, a.out, a.quality, a.basis).groupBy("basis", "error").count().show(truncate=False)
        return 0
    if a.what == "experiment":
        from tilespark.operators.encoder import ENCODERS
        from tilespark.sources import reports, sweep_files

        if a.sweep:
            rows = sweep_files.sweeps(spark, a.sweep).collect()  # profiles, few
            if broken := [r.error for r in rows if r.error]:
                p.error("; ".join(broken))
            profiles = [{"name": r["name"], "quality": r.config["quality"], "basis": r.config.get("basis", "auto")} for r in rows]
        else:
            profiles = [{"name": f"{b}-q{q}", "quality": q, "basis": b} for q in a.qualities.split(",") for b in ("auto", *ENCODERS)]
        out = api.picture_experiment(spark, a.source, profiles)
        reports.write(out, a.out)
        out["leaderboard"].orderBy("place").show(truncate=False)
        return 0
    if a.what == "encode":
        api.encode_files(spark, a.source, a.quality).write.parquet(a.out)
        return 0
    if a.what == "decode":
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.tspk").load(a.source).limit(1).count()
        made = api.decode_pictures(spark, a.source, a.out) if files else api.decode_files(spark.read.parquet(a.source), a.out)
        n = made.count()  # the count is what runs the job that saves them
        print(f"{n} images")
        return 0
    from tilespark.plans.tiles_q import embeddings

    tiles, qualities = embeddings(spark, a.sf_dir), [int(q) for q in a.qualities.split(",") if q.strip()]
    if a.what == "bench":
        api.bench(tiles, qualities).orderBy("profile", "image").show(100, truncate=False)
        return 0
    out = api.experiment(spark, {"quality": qualities}, "q{quality}", lambda _: api.bench(tiles, qualities), {"bits_per_sample": 1.0, "psnr": -0.1})
    out["leaderboard"].orderBy("place").show(truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
