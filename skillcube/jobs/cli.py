"""The stages as commands over stored tables:

    python -m skillcube.jobs.cli pull --cube STORE --out CUBE
    python -m skillcube.jobs.cli build --cube CUBE --out DATA [--missing null] [--unverified]
    python -m skillcube.jobs.cli samples --data DATA --split train --out SAMPLES
    python -m skillcube.jobs.cli fit --data DATA --out CHECKPOINTS
    python -m skillcube.jobs.cli forecast --data DATA --weights CHECKPOINTS --out FORECAST [--checkpoint epoch=3]
    python -m skillcube.jobs.cli baselines --data DATA --out RESULTS
    python -m skillcube.jobs.cli evaluate --data DATA --forecast FORECAST --out RESULTS
    python -m skillcube.jobs.cli diagnose --out RESULTS [--cube CUBE] [--nsides 16,32]

STORE: a Zarr store with the fields' own variables and levels; `pull` keeps the configured ones, verifies them and stores them as CUBE. CUBE:
rows (variable, cell_id, lat, lon, time, value), sub-daily or daily, or a Zarr store; `build` verifies grid, cadence and ranges first. FORECAST:
standardized values by (variable, cell_id, lat, lon, init, lead, member, value). `diagnose` writes the loss of waves that go to a
mesh and back. Paths are any that Spark reads (a Zarr store: that pyarrow.fs reads, marked by a name that ends in .zarr).

Every command takes --settings FILE (JSON with fields of Config, and of FitConfig under "fit") and, after its options, single settings that go before those
of the file: name=value, name.part=value for box, splits and fit, values as JSON (dev_years=[2010,2012] box.lat_min=0 fit.lr=0.001).
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame

from skillcube.config import Box, Config, Event, Splits
from skillcube.jobs import build, evaluate, fit
from skillcube.operators import geometry
from skillcube.session import session
from skillcube.sources import cube, weights, zarr

NEEDS = {
    "pull": ("cube",), "build": ("cube",), "samples": ("data", "split"), "fit": ("data",), "forecast": ("data", "weights"),
    "baselines": ("data",), "evaluate": ("data", "forecast"), "diagnose": (),
}


def overridden(got: dict, changes) -> dict:
    """Settings with changes of the form name=value or name.part=value; a value that isn't JSON is a string."""
    out = json.loads(json.dumps(got))
    for change in changes:
        name, equals, value = change.partition("=")
        if not equals:
            raise ValueError(f"{change!r} isn't of the form name=value")
        *path, last = name.split(".")
        at = out
        for part in path:
            at = at.setdefault(part, {})
        try:
            at[last] = json.loads(value)
        except ValueError:
            at[last] = value
    return out


def settings(spark, path: str | None, changes=()) -> tuple[Config, fit.FitConfig]:
    """Config and FitConfig from a JSON file and changes, defaults where they say nothing; TypeError for a name that there isn't."""
    got = json.loads("\n".join(r["value"] for r in spark.read.text(path).collect())) if path else {}
    got = overridden(got, changes)
    kinds = {"box": lambda v: Box(**v), "splits": lambda v: Splits(**{k: tuple(x) if isinstance(x, list) else x for k, x in v.items()}), "events": lambda v: tuple(Event(**e) for e in v)}

    def fixed(v):
        return tuple(map(fixed, v)) if isinstance(v, list) else v

    fitting = fit.FitConfig(**{k: fixed(v) for k, v in got.pop("fit", {}).items()})
    return Config(**{k: kinds.get(k, fixed)(v) for k, v in got.items()}), fitting


def is_zarr(path: str) -> bool:
    return path.rstrip("/").endswith(".zarr")


def pulled(spark, path: str, cfg: Config) -> DataFrame:
    """The configured variables of a store, levels in their names, in whole years of cfg.dev_years."""
    levels = dict(cfg.level_predictors)
    rows = zarr.read(spark, path, [*cfg.target_vars, *cfg.surface_predictors, *levels], cfg.dev_years)
    flat = rows.where(~rows["variable"].isin(*levels)).drop("level")
    return flat.unionByName(cube.flatten_levels(rows, cfg.level_predictors)) if levels else flat


def raw_cube(spark, path: str, cfg: Config) -> DataFrame:
    return cube.clean(pulled(spark, path, cfg) if is_zarr(path) else cube.require(cube.read_cube(spark, path, cfg), cfg.input_vars))


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="skillcube")
    parser.add_argument("stage", choices=tuple(NEEDS))
    for name in ("cube", "data", "forecast", "weights", "checkpoint", "out", "split", "settings"):
        parser.add_argument(f"--{name}")
    parser.add_argument("--nsides", default="16,32")
    parser.add_argument("--missing", choices=("raise", "null"), default="raise")
    parser.add_argument("--unverified", action="store_true")
    parser.add_argument("changes", nargs="*", metavar="name=value")
    args = parser.parse_intermixed_args(argv)
    for name in NEEDS[args.stage] + ("out",):
        if getattr(args, name) is None:
            parser.error(f"{args.stage} needs --{name}")
    spark = session()
    cfg, fitting = settings(spark, args.settings, args.changes)
    if args.stage == "pull":
        cube.write_cube(raw_cube(spark, args.cube, cfg), args.out, None)
        cube.verify(cube.read_cube(spark, args.out), cfg.grid[0], cfg.grid[1], cfg.step_hours).orderBy("variable").show(100, False)
        return
    if args.stage == "build":
        raw = raw_cube(spark, args.cube, cfg)
        if not args.unverified:
            cube.verify(raw, cfg.grid[0], cfg.grid[1], cfg.step_hours)
        built = build.build(cube.daily_mean(raw), cfg, args.missing)
        build.write(built, args.out)
        built.release()
        return
    if args.stage == "diagnose":
        nsides = tuple(map(int, args.nsides.split(",")))
        points = geometry.points_of(spark, cube.read_cube(spark, args.cube) if args.cube else None)
        evaluate.write_csv(geometry.loss_by_resolution(points, spark, nsides), f"{args.out}/loss", ["nside", "name"])
        evaluate.write_csv(geometry.loss_by_resolution(points, spark, nsides, box=cfg.box), f"{args.out}/loss_in_box", ["nside", "name"])
        return
    built = build.load(spark, args.data)
    if args.stage == "samples":
        build.samples(built.anomalies, built.norm, cfg, args.split).write.mode("overwrite").parquet(args.out)
    elif args.stage == "fit":
        state = fit.fit(build.data(built, cfg), cfg, fitting, args.out)
        print(f"epochs {state.epoch}, train {state.losses[-1][1]:.6g}, val {state.losses[-1][2]}")
    elif args.stage == "forecast":
        last = args.checkpoint or max(weights.checkpoints(spark, args.weights), key=lambda c: int(c.removeprefix("epoch=")))
        params = weights.load(weights.read(spark, args.weights, last, ("model.", "")))
        data = build.data(built, cfg)
        fit.forecast(data.test, params, data, cfg, fitting.seed).write.mode("overwrite").parquet(args.out)
    elif args.stage == "baselines":
        evaluate.write_csv(evaluate.baseline_scores(built.anomalies, cfg), f"{args.out}/baselines", ["variable", "lead_week"])
    else:
        evaluate.evaluate(cube.read_cube(spark, args.forecast), built, cfg, args.out)


if __name__ == "__main__":
    main()
