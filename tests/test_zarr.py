"""The Zarr source and sink: identity, pruning of chunks, foreign layouts, failures."""

import datetime as dt
import json
import math
import pathlib
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skillcube.sources import cube, zarr


def rows_of(df):
    return sorted((r["variable"], r["lat"], r["lon"], str(r["time"]), r["value"]) for r in df.where("value is not null").collect())


@pytest.fixture(scope="module")
def fields(spark):
    rows = [(v, float(la), float(lo), dt.datetime(2000, 1, 1) + dt.timedelta(hours=6 * t), None if (t + lo) % 7 == 0 else t + la / 100 + lo / 10_000 + (v == "b") * 1000.0) for v in ("a", "b") for la in (-10, 5, 20) for lo in (0, 90, 180, 270) for t in range(25)]
    return spark.createDataFrame(rows, "variable string, lat double, lon double, time timestamp_ntz, value double").repartition(5).cache()


def test_what_is_written_is_read(spark, fields, tmp_path):
    path = f"file://{tmp_path}/store"
    zarr.write(fields, path, (10, 2, 3))
    got = zarr.read(spark, path).persist()
    assert rows_of(got) == rows_of(fields) and got.count() == 2 * 25 * 12
    assert {(r["cell_id"], r["lat"], r["lon"]) for r in got.collect()} == {(i * 4 + j, la, lo) for i, la in enumerate((-10.0, 5.0, 20.0)) for j, lo in enumerate((0.0, 90.0, 180.0, 270.0))}
    got.unpersist()
    assert len(list(pathlib.Path(tmp_path, "store", "a").glob("[0-9]*"))) == 3 * 2 * 2 and not list(pathlib.Path(tmp_path).rglob("*.part"))
    with pytest.raises(FileExistsError):
        zarr.write(fields, path)
    zarr.write(fields.where("variable = 'a' and time < timestamp_ntz'2000-01-03'"), path, overwrite=True)
    assert {r["variable"] for r in zarr.read(spark, path).collect()} == {"a"}
    # a day's means of what is read are those of what was written
    a, b = (cube.daily_mean(x.withColumn("cell_id", F.lit(0))).orderBy("variable", "lat", "lon", "time").collect() for x in (zarr.read(spark, path), fields.where("variable = 'a' and time < timestamp_ntz'2000-01-03'")))
    assert np.allclose([r["value"] for r in a], [r["value"] for r in b], rtol=1e-12)



def test_filters_reach_the_chunks(spark, fields, tmp_path):
    path = f"file://{tmp_path}/store"
    zarr.write(fields, path, (10, 2, 3))
    chunks = lambda df: df.rdd.getNumPartitions()  # noqa: E731  (a chunk is a partition, so these are the chunks that are opened)
    all_ = zarr.read(spark, path)
    assert chunks(all_) == 24 and chunks(all_.where("variable = 'a'")) == 12 and chunks(all_.where("variable in ('b', 'c')")) == 12
    late = all_.where("time >= timestamp_ntz'2000-01-06'")
    assert chunks(late) == 8 and late.count() == fields.where("time >= timestamp_ntz'2000-01-06'").count()
    assert chunks(zarr.read(spark, path, years=(2000, 2000))) == 24 and chunks(zarr.read(spark, path, years=(2001, 2002))) in (0, 1)
    assert chunks(zarr.read(spark, path, ["b"]).where("time = timestamp_ntz'2000-01-01'")) == 4
    # what is not opened is not needed: without the other chunks the answer stands
    for file in pathlib.Path(tmp_path, "store", "b").glob("[0-9]*"):
        file.write_bytes(b"damaged")
    assert all_.where("variable = 'a'").count() == 300
    with pytest.raises(Exception):
        all_.where("variable = 'b'").agg(F.sum("value")).collect()
    with pytest.raises(Exception, match="not in the store"):
        zarr.read(spark, path, ["a", "nothing"]).count()
    with pytest.raises(Exception, match="no Zarr store"):
        zarr.read(spark, f"file://{tmp_path}/nowhere").count()


def test_failed_writes_leave_nothing(spark, fields, tmp_path):
    path = f"file://{tmp_path}/store"
    twice = fields.unionByName(fields.limit(3))
    with pytest.raises(Exception, match="two values"):
        zarr.write(twice.where("value is not null"), path, (10, 2, 3))
    assert not pathlib.Path(tmp_path, "store").exists()
    flag = tmp_path / "failed"

    def once(batches):  # the first attempt at a partition fails after it has made rows
        for pdf in batches:
            yield pdf
            if not flag.exists():
                flag.write_text("x")
                raise RuntimeError("lost")

    try:
        zarr.write(fields.coalesce(1).mapInPandas(once, fields.schema), path)
    except Exception as error:  # a local master may not repeat tasks
        assert "lost" in str(error) and not pathlib.Path(tmp_path, "store").exists()
        zarr.write(fields.coalesce(1).mapInPandas(once, fields.schema), path)
    assert rows_of(zarr.read(spark, path)) == rows_of(fields)


def test_attempts_give_the_same_chunks(fields, tmp_path):
    batch = pa.RecordBatch.from_pydict({"variable": ["a"] * 3, "ct": [0] * 3, "cy": [0] * 3, "cx": [1] * 3, "pos": [0, 5, 2], "value": [1.0, None, 3.0]})
    plan = {"axes": {"time": 2, "latitude": 2, "longitude": 4}, "chunks": [2, 2, 2], "variables": ["a"]}
    files = []
    for _ in range(2):
        writer = zarr.ZarrWriter(f"file://{tmp_path}/s", plan)
        assert writer.write(iter([batch.slice(0, 1), batch.slice(1)])).chunks == 1
        files.append({p.name: p.read_bytes() for p in pathlib.Path(tmp_path, "s", "a").iterdir()})
    assert files[0] == files[1] and list(files[0]) == ["0.0.1"]
    with pytest.raises(FileNotFoundError):
        zarr.Store(f"file://{tmp_path}/s")  # nothing is there before the commit
    writer.commit([])
    assert zarr.Store(f"file://{tmp_path}/s").arrays["a"].shape == (2, 2, 4)


def blosc(raw, typesize, codec, blocksize, split=True):
    """A frame as the format describes it: bytes shuffled by block, streams of one byte position each."""
    flags = 1 | {"lz4": 1, "zlib": 3, "zstd": 4}[codec] << 5 | (0 if split else 0x10)
    body, starts = b"", []
    blocks = [raw[i : i + blocksize] for i in range(0, len(raw), blocksize)]
    for block in blocks:
        starts.append(16 + 4 * len(blocks) + len(body))
        whole = len(block) // typesize * typesize
        block = np.frombuffer(block[:whole], np.uint8).reshape(-1, typesize).T.tobytes() + block[whole:]
        n = typesize if split and blocksize // typesize >= 128 and len(block) == blocksize else 1
        for i in range(n):
            part = block[i * len(block) // n : (i + 1) * len(block) // n]
            packed = zlib.compress(part) if codec == "zlib" else pa.compress(part, {"lz4": "lz4_raw", "zstd": "zstd"}[codec], asbytes=True)
            packed = part if len(packed) >= len(part) else packed
            body += struct.pack("<i", len(packed)) + packed
    head = bytes([2, 1, flags, typesize]) + struct.pack("<iii", len(raw), blocksize, 16 + 4 * len(blocks) + len(body))
    return head + struct.pack(f"<{len(blocks)}i", *starts) + body


@pytest.mark.parametrize("codec", ["lz4", "zlib", "zstd"])
@pytest.mark.parametrize("split", [True, False])
def test_blosc_frames(codec, split):
    rng = np.random.default_rng(0)
    raw = np.concatenate([np.arange(1500), rng.integers(0, 2**31, 700)]).astype("<i4").tobytes() + b"abc"
    assert zarr.unblosc(blosc(raw, 4, codec, 2048, split)) == raw
    assert zarr.unblosc(bytes([2, 1, 0x2, 4]) + struct.pack("<iii", 5, 5, 21) + b"plain") == b"plain"
    with pytest.raises(ValueError):
        zarr.unblosc(bytes([2, 1, 0x4, 4]) + struct.pack("<iii", 5, 5, 21))


def put(root, name, array, dims, chunks, codec=None, fill=None, sep=".", attrs=None, skip=(), order="C"):
    folder = pathlib.Path(root, name)
    folder.mkdir(parents=True)
    meta = {"zarr_format": 2, "shape": list(array.shape), "chunks": list(chunks), "dtype": array.dtype.str, "compressor": codec and {"id": codec}, "fill_value": fill, "order": order, "filters": None, "dimension_separator": sep}
    (folder / ".zarray").write_text(json.dumps(meta))
    (folder / ".zattrs").write_text(json.dumps({"_ARRAY_DIMENSIONS": dims, **(attrs or {})}))
    for at in np.ndindex(*(-(-n // c) for n, c in zip(array.shape, chunks))):
        if at in skip:
            continue
        part = np.zeros(chunks, array.dtype)
        cut = array[tuple(slice(i * c, (i + 1) * c) for i, c in zip(at, chunks))]
        part[tuple(slice(0, n) for n in cut.shape)] = cut
        raw = part.tobytes(order)
        raw = {None: lambda x: x, "zlib": zlib.compress, "blosc": lambda x: blosc(x, array.dtype.itemsize, "lz4", 1024), "lz4": lambda x: struct.pack("<i", len(x)) + pa.compress(x, "lz4_raw", asbytes=True)}[codec](raw)
        file = folder / sep.join(map(str, at))
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_bytes(raw)


def test_foreign_stores(spark, tmp_path):
    """Longitude before latitude, levels, packed integers, a missing chunk, hours since a date: as public reanalysis stores come."""
    rng = np.random.default_rng(1)
    root = tmp_path / "era"
    root.mkdir()
    (root / ".zgroup").write_text('{"zarr_format": 2}')
    put(root, "time", np.arange(0, 60, 6).astype("<i8"), ["time"], (10,), attrs={"units": "hours since 1999-12-31 18:00:00", "calendar": "proleptic_gregorian"})
    put(root, "latitude", np.array([60.0, 0.0, -60.0], "<f4"), ["latitude"], (3,))
    put(root, "longitude", np.array([0.0, 180.0], "<f8"), ["longitude"], (2,))
    put(root, "level", np.array([500, 850], "<i4"), ["level"], (2,))
    t2m = rng.normal(280, 5, (10, 2, 3)).astype("<f4")
    t2m[3, 1, 2] = np.nan
    put(root, "2m_temperature", t2m, ["time", "longitude", "latitude"], (4, 2, 3), "blosc", "NaN", skip=[(1, 0, 0)])
    wind = rng.integers(-100, 100, (10, 2, 2, 3)).astype("<i2")
    wind[0, 0, 0, 0] = -999
    put(root, "u_component_of_wind", wind, ["time", "level", "longitude", "latitude"], (5, 1, 2, 3), "lz4", 0, "/", {"scale_factor": 0.5, "add_offset": 3.0, "_FillValue": -999}, order="F")
    got = zarr.read(spark, f"file://{root}").collect()
    assert len(got) == 60 + 120
    begin = dt.datetime(1999, 12, 31, 18)
    for r in got:
        t, x, y = int((r["time"] - begin).total_seconds() // 21600), (0.0, 180.0).index(r["lon"]), (60.0, 0.0, -60.0).index(r["lat"])
        assert r["cell_id"] == y * 2 + x
        if r["variable"] == "2m_temperature":
            want = None if 4 <= t < 8 or (t, x, y) == (3, 1, 2) else float(t2m[t, x, y])
            assert r["level"] is None and r["value"] == want
        else:
            raw = wind[t, (500, 850).index(r["level"]), x, y]
            assert (r["value"] is None) if raw == -999 else math.isclose(r["value"], raw * 0.5 + 3.0)
    some = zarr.read(spark, f"file://{root}", ["u_component_of_wind"]).where("level = 850")
    assert some.rdd.getNumPartitions() == 2
    flat = cube.flatten_levels(some, (("u_component_of_wind", (850,)),))
    assert {r["variable"] for r in flat.collect()} == {"u_component_of_wind_850"} and flat.count() == 60
    pathlib.Path(root, "latitude", ".zarray").write_text(pathlib.Path(root, "latitude", ".zarray").read_text().replace("null, \"fill", '{"id": "other"}, "fill'))
    with pytest.raises(Exception, match="other"):
        zarr.read(spark, f"file://{root}").count()
