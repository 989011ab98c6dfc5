"""Zarr stores (format 2) of gridded fields as a Spark data source: a row per variable, level, cell and time.

    cube = zarr.read(spark, "gs://bucket/store.zarr", variables=["2m_temperature"], years=(1990, 1999))
    zarr.write(cube, "file:///data/anomalies.zarr", chunks=(100, 32, 64))

Reading: the driver reads the store's metadata and its one-dimensional coordinates, nothing else. Each chunk of each variable is a
partition, so tasks open one chunk each. Filters on variable, level and time reach the list of chunks (`spark.sql.python.filterPushdown.enabled`,
which `read` sets); Spark applies them to the rows as well. A chunk without a file is all fill value. Missing values (NaN, fill values) are null.

Writing: rows are dealt to chunks by a shuffle on (variable, chunk), so a chunk is made by one task, which holds that chunk alone. Chunk files get
their names by renaming; a repeated or second attempt gives the same bytes. The metadata come last, when all tasks have ended: without them
there is no store. A job that fails removes what its tasks wrote. Writing over a store removes it first, so a cube that reads from it has to be stored elsewhere.

Files are reached through pyarrow.fs (local paths, file://, hdfs://, s3://, gs://). Compressors: none, zlib, gzip, zstd, lz4, and Blosc frames of lz4, zlib or zstd.
"""

from __future__ import annotations

import gzip
import json
import uuid
import zlib
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

ROWS = "variable string, level int, cell_id int, lat double, lon double, time timestamp_ntz, value double"
CELLS = "variable string, ct int, cy int, cx int, pos int, value double"
AXES = {"time": "time", "latitude": "lat", "lat": "lat", "longitude": "lon", "lon": "lon", "level": "level"}
UNITS = {"microseconds": 1, "milliseconds": 10**3, "seconds": 10**6, "minutes": 60 * 10**6, "hours": 3600 * 10**6, "days": 86400 * 10**6}
BATCH_ROWS = 32_768
CALENDARS = ("standard", "gregorian", "proleptic_gregorian")


def _fs(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


def unblosc(frame: bytes) -> bytes:
    """The content of a Blosc (version 1) frame: header of 16 bytes, block offsets, blocks of one or typesize streams."""
    flags, typesize = frame[2], frame[3]
    nbytes, blocksize, _ = np.frombuffer(frame, "<i4", 3, 4).tolist()
    if flags & 0x2:
        return frame[16 : 16 + nbytes]
    if flags & 0x4:
        raise ValueError("Blosc frames shuffled by bits aren't read")
    codec = {1: "lz4_raw", 3: "zlib", 4: "zstd"}.get(flags >> 5)
    if codec is None:
        raise ValueError(f"Blosc codec {flags >> 5} isn't read")
    out = []
    for k, at in enumerate(np.frombuffer(frame, "<i4", -(-nbytes // blocksize) if nbytes else 0, 16).tolist()):
        size = min(blocksize, nbytes - k * blocksize)
        streams = typesize if not flags & 0x10 and typesize <= 16 and blocksize // typesize >= 128 and size == blocksize else 1
        block = b""
        for _ in range(streams):
            n, want = int.from_bytes(frame[at : at + 4], "little"), size // streams
            part = frame[at + 4 : at + 4 + n]
            block += part if n == want else zlib.decompress(part) if codec == "zlib" else pa.decompress(part, want, codec, asbytes=True)
            at += 4 + n
        if flags & 0x1 and typesize > 1:
            whole = size // typesize * typesize
            block = np.frombuffer(block[:whole], np.uint8).reshape(typesize, -1).T.tobytes() + block[whole:]
        out.append(block)
    return b"".join(out)


def _unzstd(raw: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompressobj().decompress(raw)


DECODERS = {
    "zlib": zlib.decompress, "gzip": gzip.decompress, "zstd": _unzstd, "blosc": unblosc,
    "lz4": lambda raw: pa.decompress(raw[4:], int.from_bytes(raw[:4], "little"), "lz4_raw", asbytes=True),
}


class Array:
    """One array of a store: its metadata, and its chunks on demand."""

    def __init__(self, root: str, name: str, meta: dict, attrs: dict):
        if meta.get("zarr_format") != 2 or meta.get("filters"):
            raise ValueError(f"{name}: only format 2 without filters is read")
        self.root, self.name, self.attrs = root, name, attrs
        self.shape, self.chunks, self.dtype = tuple(meta["shape"]), tuple(meta["chunks"]), np.dtype(meta["dtype"])
        self.order, self.fill, self.sep = meta.get("order", "C"), meta.get("fill_value"), meta.get("dimension_separator", ".")
        self.codec = (meta.get("compressor") or {}).get("id")
        if self.codec is not None and self.codec not in DECODERS:
            raise ValueError(f"{name}: compressor {self.codec!r} isn't read")
        self.dims = tuple(attrs.get("_ARRAY_DIMENSIONS", ()))

    def grid(self) -> tuple[int, ...]:
        """Numbers of chunks along the dimensions."""
        return tuple(-(-n // c) for n, c in zip(self.shape, self.chunks))

    def chunk(self, at: tuple[int, ...]) -> np.ndarray:
        """A chunk, cut to the array's shape."""
        fs, root = _fs(self.root)
        path = f"{root}/{self.name}/{self.sep.join(map(str, at)) or '0'}"
        cut = tuple(slice(0, min(c, n - i * c)) for i, c, n in zip(at, self.chunks, self.shape))
        if fs.get_file_info(path).type == pafs.FileType.NotFound:
            fill = np.nan if self.fill is None and self.dtype.kind == "f" else self.fill or 0
            return np.full(self.chunks, float(fill) if isinstance(fill, str) else fill, self.dtype)[cut]
        with fs.open_input_stream(path, compression=None) as f:
            raw = f.read()
        raw = DECODERS[self.codec](raw) if self.codec else raw
        return np.frombuffer(raw, self.dtype).reshape(self.chunks, order=self.order)[cut]

    def whole(self) -> np.ndarray:
        """A one-dimensional array: coordinates."""
        return np.concatenate([self.chunk((i,)) for i in range(self.grid()[0])])

    def decoded(self, raw: np.ndarray) -> np.ndarray:
        """Values as doubles, NaN where missing; packed values (scale_factor, add_offset) unpacked."""
        out = raw.astype(float)
        for missing in (self.attrs.get("_FillValue"), self.attrs.get("missing_value")):
            if isinstance(missing, (int, float)):
                out[raw == missing] = np.nan
        return out * self.attrs.get("scale_factor", 1.0) + self.attrs.get("add_offset", 0.0)

    def times(self) -> np.ndarray:
        """A time axis in microseconds since 1970: of datetime64, or of numbers with units 'steps since date'."""
        raw = self.whole()
        if self.dtype.kind == "M":
            return raw.astype("datetime64[us]")
        step, _, since = self.attrs.get("units", "").partition(" since ")
        if step not in UNITS or self.attrs.get("calendar", "standard") not in CALENDARS:
            raise ValueError(f"{self.name}: time in {self.attrs.get('units')!r}, calendar {self.attrs.get('calendar')!r}")
        return np.datetime64(since.strip().removesuffix("Z").replace(" ", "T"), "us") + np.round(raw.astype(float) * UNITS[step]).astype("timedelta64[us]")


class Store:
    """The metadata of a store."""

    def __init__(self, uri: str):
        self.uri = uri.rstrip("/")
        fs, root = _fs(self.uri)

        def load(path: str) -> dict | None:
            if fs.get_file_info(path).type == pafs.FileType.NotFound:
                return None
            with fs.open_input_stream(path, compression=None) as f:
                return json.loads(f.read())

        if all_ := load(f"{root}/.zmetadata"):
            found = {k.removesuffix("/.zarray"): (v, all_["metadata"].get(k.removesuffix(".zarray") + ".zattrs", {})) for k, v in all_["metadata"].items() if k.endswith("/.zarray")}
        elif load(f"{root}/.zgroup"):
            names = [i.base_name for i in fs.get_file_info(pafs.FileSelector(root)) if i.type == pafs.FileType.Directory]
            found = {n: (meta, load(f"{root}/{n}/.zattrs") or {}) for n in names if (meta := load(f"{root}/{n}/.zarray"))}
        else:
            raise FileNotFoundError(f"{uri} is no Zarr store")
        self.arrays = {n: Array(self.uri, n, *m) for n, m in found.items()}

    def fields(self) -> dict[str, Array]:
        """The variables: arrays over time, latitude and longitude, and over levels if there are."""
        return {n: a for n, a in self.arrays.items() if {"time", "lat", "lon"} <= {AXES.get(d) for d in a.dims} <= set(AXES.values())}


@dataclass
class Chunk(InputPartition):
    """A chunk of a variable; axes: coordinates along its dimensions (times in microseconds), and numbers of the cells."""

    array: Array
    at: tuple[int, ...]
    axes: dict[str, np.ndarray]
    lat_from: int
    lon_from: int
    n_lon: int


class ZarrReader(DataSourceReader):
    def __init__(self, uri: str, variables: list[str] | None):
        self.store = Store(uri)
        self.fields = self.store.fields()
        if variables is not None and (missing := sorted(set(variables) - set(self.fields))):
            raise KeyError(f"variables not in the store: {missing}; there are {sorted(self.fields)[:25]}")
        self.variables = sorted(self.fields if variables is None else variables)
        self.bounds: list[tuple[str, str, object]] = []

    def pushFilters(self, filters):
        """Takes note of what narrows the list of chunks; all filters stay Spark's to apply."""
        kinds = {EqualTo: "=", In: "in", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}
        for f in filters:
            if type(f) in kinds and f.attribute in (("variable",), ("level",), ("time",)) and f.value is not None:
                self.bounds.append((f.attribute[0], kinds[type(f)], f.value))
            yield f

    def _may_hold(self, column: str, values) -> bool:
        """Whether some of the values pass the noted filters; values: strings, or a numpy array with its ends at least and greatest."""
        for name, kind, x in self.bounds:
            if name != column:
                continue
            if column == "time":
                x = [np.datetime64(v, "us") for v in x] if kind == "in" else np.datetime64(x, "us")
            lo, hi = min(values), max(values)
            ok = {"=": lambda: lo <= x <= hi, "in": lambda: any(lo <= v <= hi for v in x if v is not None), ">": lambda: hi > x, ">=": lambda: hi >= x, "<": lambda: lo < x, "<=": lambda: lo <= x}
            if not ok[kind]():
                return False
        return True

    def partitions(self):
        out, axes = [], {}
        for name in self.variables:
            array = self.fields[name]
            if not self._may_hold("variable", [name]):
                continue
            for d in array.dims:
                if d not in axes:
                    coordinate = self.store.arrays[d]
                    axes[d] = coordinate.times() if AXES[d] == "time" else coordinate.whole()
            for at in product(*map(range, array.grid())):
                held = {AXES[d]: axes[d][i * c : (i + 1) * c] for d, i, c in zip(array.dims, at, array.chunks)}
                if not self._may_hold("time", held["time"]) or ("level" in held and not self._may_hold("level", held["level"])):
                    continue
                start = {AXES[d]: i * c for d, i, c in zip(array.dims, at, array.chunks)}
                n_lon = next(n for d, n in zip(array.dims, array.shape) if AXES[d] == "lon")
                out.append(Chunk(array, at, held, start["lat"], start["lon"], n_lon))
        return out

    def read(self, partition: Chunk):
        array, axes = partition.array, partition.axes
        dims = [AXES[d] for d in array.dims]
        values = array.decoded(array.chunk(partition.at))
        order = [dims.index(d) for d in ("time", "level", "lat", "lon") if d in dims]
        values = values.transpose(order).reshape(len(axes["time"]), -1)
        level, lat, lon = np.meshgrid(axes.get("level", np.zeros(1)), np.arange(len(axes["lat"])), np.arange(len(axes["lon"])), indexing="ij")
        n = level.size
        cell = (partition.lat_from + lat.ravel()) * partition.n_lon + partition.lon_from + lon.ravel()
        names = ["variable", "level", "cell_id", "lat", "lon", "time", "value"]
        step = max(1, BATCH_ROWS // n)
        for lo in range(0, len(values), step):
            some = values[lo : lo + step]
            tiled = lambda a: np.tile(a, len(some))
            levels = pa.array(tiled(level.ravel().astype(np.int32))) if "level" in axes else pa.nulls(some.size, pa.int32())
            place = [pa.array(tiled(cell.astype(np.int32))), pa.array(tiled(axes["lat"].astype(float)[lat.ravel()])), pa.array(tiled(axes["lon"].astype(float)[lon.ravel()]))]
            times = pa.array(np.repeat(axes["time"][lo : lo + step].astype("datetime64[us]"), n), pa.timestamp("us"))
            yield pa.RecordBatch.from_arrays([pa.array([array.name] * some.size), levels, *place, times, pa.array(some.ravel(), from_pandas=True)], names=names)


@dataclass
class Written(WriterCommitMessage):
    chunks: int


class ZarrWriter(DataSourceArrowWriter):
    """Writes chunks of rows (CELLS) that come together, and the metadata when all have been written."""

    def __init__(self, uri: str, plan: dict):
        self.uri, self.plan = uri, plan

    def write(self, iterator):
        shape, held, key, chunks = self.plan["chunks"], None, None, 0
        for batch in iterator:
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("variable", "ct", "cy", "cx"))))
            cuts = [i for i in range(len(keys)) if i == 0 or keys[i] != keys[i - 1]]
            pos, value = batch.column("pos").to_numpy(), batch.column("value").to_numpy(zero_copy_only=False)
            for lo, hi in zip(cuts, [*cuts[1:], len(keys)]):
                if keys[lo] != key:
                    chunks += self._put(key, held)
                    key, held = keys[lo], np.full(shape, np.nan)
                    seen = np.zeros(held.size, bool)
                at = pos[lo:hi]
                if seen[at].any() or len(np.unique(at)) < len(at):
                    raise ValueError(f"{key[0]} has two values for one cell and time")
                seen[at] = True
                held.reshape(-1)[at] = value[lo:hi]
        return Written(chunks + self._put(key, held))

    def _put(self, key, held) -> int:
        if key is None:
            return 0
        write_file(self.uri, f"{key[0]}/{'.'.join(map(str, key[1:]))}", zlib.compress(held.astype("<f8").tobytes(), 1))
        return 1

    def commit(self, messages):
        metadata = {".zgroup": {"zarr_format": 2}, ".zattrs": {}}
        axes, dims = self.plan["axes"], ("time", "latitude", "longitude")
        for name, n in axes.items():
            kind = "<i8" if name == "time" else "<f8"
            metadata[f"{name}/.zarray"] = {"zarr_format": 2, "shape": [n], "chunks": [max(1, n)], "dtype": kind, "compressor": None, "fill_value": None, "order": "C", "filters": None}
            metadata[f"{name}/.zattrs"] = {"_ARRAY_DIMENSIONS": [name]} | ({"units": "microseconds since 1970-01-01", "calendar": "proleptic_gregorian"} if name == "time" else {})
        for name in self.plan["variables"]:
            metadata[f"{name}/.zarray"] = {"zarr_format": 2, "shape": [axes[d] for d in dims], "chunks": self.plan["chunks"], "dtype": "<f8", "compressor": {"id": "zlib", "level": 1}, "fill_value": "NaN", "order": "C", "filters": None}
            metadata[f"{name}/.zattrs"] = {"_ARRAY_DIMENSIONS": list(dims)}
        for name, meta in metadata.items():
            if name != ".zgroup":
                write_file(self.uri, name, json.dumps(meta).encode())
        write_file(self.uri, ".zmetadata", json.dumps({"zarr_consolidated_format": 1, "metadata": metadata}).encode())
        write_file(self.uri, ".zgroup", json.dumps(metadata[".zgroup"]).encode())

    def abort(self, messages):
        remove(self.uri)


def write_file(uri: str, name: str, content: bytes) -> None:
    """A file under its name only when it is whole."""
    fs, root = _fs(uri)
    path = f"{root}/{name}"
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with fs.open_output_stream(part, compression=None) as f:
        f.write(content)
    fs.move(part, path)


def remove(uri: str) -> None:
    fs, root = _fs(uri)
    if fs.get_file_info(root).type == pafs.FileType.Directory:
        fs.delete_dir(root)


class ZarrSource(DataSource):
    """format("zarr"); options: path, variables (JSON list, to read), plan (JSON, to write)."""

    @classmethod
    def name(cls):
        return "zarr"

    def schema(self):
        return ROWS

    def reader(self, schema):
        names = self.options.get("variables")
        return ZarrReader(self.options["path"], json.loads(names) if names else None)

    def writer(self, schema, overwrite):
        return ZarrWriter(self.options["path"], json.loads(self.options["plan"]))


def read(spark: SparkSession, path: str, variables=None, years: tuple[int, int] | None = None) -> DataFrame:
    """The store's rows (ROWS), of the named variables (KeyError for one that isn't there) and whole years, closed."""
    spark.dataSource.register(ZarrSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format("zarr").option("path", path)
    rows = (reader if variables is None else reader.option("variables", json.dumps(sorted(variables)))).load()
    if years is not None:
        lo, hi = (F.lit(f"{y}-01-01").cast("timestamp_ntz") for y in (years[0], years[1] + 1))
        rows = rows.where((F.col("time") >= lo) & (F.col("time") < hi))
    return rows


def _axis(cube: DataFrame, column: str) -> tuple[DataFrame, np.ndarray]:
    """Distinct values in order with their numbers, and the values: as many as the grid is long in one direction."""
    rows = cube.select(F.col(column).alias("at")).where("at is not null").distinct()
    numbered = rows.withColumn("i", F.row_number().over(Window.orderBy("at")) - 1)
    return numbered.withColumnRenamed("at", column), rows.orderBy("at").toArrow().column("at").to_numpy()


def write(cube: DataFrame, path: str, chunks: tuple[int, int, int] = (100, 32, 64), overwrite: bool = False) -> None:
    """Stores rows (variable, lat, lon, time, value) with times, latitudes and longitudes in ascending order; a cell and time without a row is NaN."""
    spark = cube.sparkSession
    cube = cube.select("variable", F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"), F.col("time").cast("timestamp_ntz").alias("time"), F.col("value").cast("double").alias("value"))
    fs, root = _fs(path)
    if fs.get_file_info(root).type != pafs.FileType.NotFound and fs.get_file_info(pafs.FileSelector(root)):
        if not overwrite:
            raise FileExistsError(path)
        remove(path)
    names = sorted(r["variable"] for r in cube.select("variable").distinct().collect())
    (times, t), (lats, y), (lons, x) = (_axis(cube, c) for c in ("time", "lat", "lon"))
    chunks = tuple(max(1, min(c, len(a))) for c, a in zip(chunks, (t, y, x)))
    for name, values in (("time", t.astype("datetime64[us]").astype("<i8")), ("latitude", y.astype("<f8")), ("longitude", x.astype("<f8"))):
        write_file(path, f"{name}/0", values.tobytes())
    rows = cube
    for table, column, key in ((times, "time", "t"), (lats, "lat", "y"), (lons, "lon", "x")):
        rows = rows.join(table.withColumnRenamed("i", key), column)
    number = {k: F.floor(F.col(k) / c).cast("int") for k, c in zip("tyx", chunks)}
    inside = {k: F.col(k) % c for k, c in zip("tyx", chunks)}
    pos = ((inside["t"] * chunks[1] + inside["y"]) * chunks[2] + inside["x"]).cast("int")
    cells = rows.select("variable", number["t"].alias("ct"), number["y"].alias("cy"), number["x"].alias("cx"), pos.alias("pos"), "value")
    dealt = cells.repartition("variable", "ct", "cy", "cx").sortWithinPartitions("variable", "ct", "cy", "cx", "pos")
    plan = {"axes": {"time": len(t), "latitude": len(y), "longitude": len(x)}, "chunks": list(chunks), "variables": names}
    spark.dataSource.register(ZarrSource)
    dealt.write.format("zarr").mode("append").option("path", path).option("plan", json.dumps(plan)).save()
