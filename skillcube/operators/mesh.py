"""Operators on nested meshes and neighbour graphs: attention over neighbours and blocks, pyramids, fitted interpolation.

Channels of a point are an array column. Weights of linear maps are matrices (lists of rows) that stand in the plan as one constant
each. Groups are neighbours of a point (k of them) or pixels of a block, so lists have a bound that doesn't grow with the data.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skillcube.functions import columns as C

#: What a root mean square is kept from zero by: the spacing of 32-bit floats at 1.
RMS_EPS = 1.1920929e-07
LOWEST = -1.7976931348623157e308

Matrix = list[list[float]]


def constant(matrix: Matrix) -> Column:
    """A matrix as one folded constant."""
    return F.from_json(F.lit(json.dumps(matrix)), "array<array<double>>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def linear(matrix: Matrix, x: Column) -> Column:
    """matrix times x."""
    return F.transform(constant(matrix), lambda row: dot(row, x))


def plus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def rms_norm(x: Column) -> Column:
    """x over its root mean square."""
    return F.transform(x, lambda v: v / F.sqrt(dot(x, x) / F.size(x) + RMS_EPS))


# Softmax-weighted means as states that merge: (m, s, w) with m the greatest score, s the sum of exp(score - m) and w that of
# exp(score - m) * value, for each head. Merging rescales to the greater m, so no exponent is above zero.


def state_of(scores: Column, value: Column) -> Column:
    """The state of one row: a score per head, the heads' channels end to end."""
    return F.struct(scores.alias("m"), F.transform(scores, lambda _: F.lit(1.0)).alias("s"), value.alias("w"))


def merge(a: Column, b: Column, width: int) -> Column:
    """Two states in one; width: channels of a head."""
    m = F.zip_with(a.m, b.m, lambda x, y: F.greatest(x, y))
    ea, eb = (F.zip_with(x.m, m, lambda u, v: F.exp(u - v)) for x in (a, b))

    def scaled(x, e):
        return F.transform(x.w, lambda v, i: v * F.element_at(e, (F.floor(i / width) + 1).cast("int")))

    s = plus(F.zip_with(a.s, ea, lambda x, e: x * e), F.zip_with(b.s, eb, lambda x, e: x * e))
    return F.struct(m.alias("m"), s.alias("s"), plus(scaled(a, ea), scaled(b, eb)).alias("w"))


def folded(states: Column, heads: int, width: int) -> Column:
    empty = F.struct(F.array_repeat(F.lit(LOWEST), heads).alias("m"), F.array_repeat(F.lit(0.0), heads).alias("s"), F.array_repeat(F.lit(0.0), heads * width).alias("w"))
    return F.aggregate(states, empty, lambda a, b: merge(a, b, width))


def weighted(state: Column, width: int) -> Column:
    """The means of a state; null without rows."""
    means = F.transform(state.w, lambda v, i: v / F.element_at(state.s, (F.floor(i / width) + 1).cast("int")))
    return F.when(F.element_at(state.s, 1) > 0, means)


def softmax_pool(rows: DataFrame, by: list[str], scores: str, value: str, heads: int, width: int, parts: int = 1) -> DataFrame:
    """by, value: means of an array column with softmax weights of `scores` (one a head).

    Rows with a null score or value are left out. parts: groups come in so many partial states first (a group of n rows then
    makes lists of n / parts), for groups larger than the neighbours of a point.
    """
    whole = rows.where(F.col(scores).isNotNull() & F.col(value).isNotNull() & ~F.exists(value, lambda v: ~C.finite(v)) & ~F.exists(scores, lambda v: ~C.finite(v)))
    states = whole.select(*by, state_of(F.col(scores), F.col(value)).alias("_s"))
    if parts > 1:
        part = F.pmod(F.xxhash64("_s"), F.lit(parts)).alias("_p")
        states = states.groupBy(*by, part).agg(folded(F.collect_list("_s"), heads, width).alias("_s"))
    return states.groupBy(*by).agg(weighted(folded(F.collect_list("_s"), heads, width), width).alias(value))


@dataclass(frozen=True)
class Attention:
    """Weights of attention interpolation over `dim` channels in `heads`: to_q dim x 3, to_kv 2 dim x dim (keys, then values), to_o dim x dim."""

    to_q: Matrix
    to_kv: Matrix
    to_o: Matrix
    heads: int

    @property
    def dim(self) -> int:
        return len(self.to_o)


def attention_interpolate(edges: DataFrame, source: DataFrame, to: DataFrame, weights: Attention) -> DataFrame:
    """id, x: channels of each point of `to` out of its neighbours' (edges: to_id, from_id).

    source: id, lon, lat, x; to: id, lon, lat. A neighbour's key and value are linear in its normalized channels, the query in the
    direction from it to the point; scores are scaled by the root of a head's channels. Neighbours without channels are left out.
    """
    dim, heads = weights.dim, weights.heads
    if dim % heads:
        raise ValueError(f"{dim} channels don't part into {heads} heads")
    width = dim // heads
    held = source.select(F.col("id").alias("from_id"), C.unit_vector(F.col("lat"), F.col("lon")).alias("_f"), linear(weights.to_kv, rms_norm(F.col("x"))).alias("_kv"))
    asked = to.select(F.col("id").alias("to_id"), C.unit_vector(F.col("lat"), F.col("lon")).alias("_t"))
    rows = edges.select("to_id", "from_id").join(held, "from_id").join(asked, "to_id")
    off = F.array(*[F.col(f"_t.{c}") - F.col(f"_f.{c}") for c in "xyz"])
    length = F.greatest(F.sqrt(dot(F.col("_off"), F.col("_off"))), F.lit(1e-12))
    rows = rows.withColumn("_off", off).withColumn("_q", linear(weights.to_q, F.transform("_off", lambda v: v / length)))
    scores = F.array(*[dot(F.slice("_q", h * width + 1, width), F.slice("_kv", h * width + 1, width)) / width**0.5 for h in range(heads)])
    got = softmax_pool(rows.select("to_id", scores.alias("_scores"), F.slice("_kv", dim + 1, dim).alias("x")), ["to_id"], "_scores", "x", heads, width)
    return got.select(F.col("to_id").alias("id"), linear(weights.to_o, F.col("x")).alias("x"))


def rotated(x: Column, lon: Column, lat: Column, width: int, theta: float = 10_000.0) -> Column:
    """Channel pairs turned by the position: half of the pairs by longitude, half by latitude, at falling frequencies."""
    if width % 4:
        raise ValueError(f"a head of {width} channels has no equal halves of pairs")
    rates = [theta ** (-2 * i / (width // 2)) for i in range(width // 4)]
    angle = [F.radians(p) * r for p in (lon, lat) for r in rates]
    turned = []
    for i, a in enumerate(angle):
        u, v = F.element_at(x, 2 * i + 1), F.element_at(x, 2 * i + 2)
        turned += [u * F.cos(a) - v * F.sin(a), v * F.cos(a) + u * F.sin(a)]
    return F.array(*turned)


def block_attention(rows: DataFrame, block: int, heads: int, width: int, theta: float | None = 10_000.0, by: tuple[str, ...] = ()) -> DataFrame:
    """by, pix, x: attention of each pixel to the pixels of its block, of `block` consecutive nested numbers.

    rows: pix, lon, lat and arrays q, k, v of heads * width channels. theta: base of the rotary frequencies, None: none. A block comes together
    as one list of at most `block` pixels (repeated pixels raise), and pairs are formed inside it only.
    """

    def placed(name):
        if theta is None:
            return F.col(name)
        return F.concat(*[rotated(F.slice(name, h * width + 1, width), F.col("lon"), F.col("lat"), width, theta) for h in range(heads)])

    item = F.struct("pix", placed("q").alias("q"), placed("k").alias("k"), F.col("v"))
    blocks = rows.groupBy(*by, F.floor(F.col("pix") / block).alias("_b")).agg(F.collect_list(item).alias("_r"))
    blocks = blocks.withColumn("_r", F.when(F.size("_r") <= block, F.col("_r")).otherwise(F.raise_error(F.lit(f"a block has more than {block} rows")).cast(blocks.schema["_r"].dataType)))

    def seen(i):
        def one(j):
            scores = F.array(*[dot(F.slice(i.q, h * width + 1, width), F.slice(j.k, h * width + 1, width)) / width**0.5 for h in range(heads)])
            return state_of(scores, j.v)

        return F.struct(i.pix.alias("pix"), weighted(folded(F.transform("_r", one), heads, width), width).alias("x"))

    return blocks.select(*by, F.explode(F.transform("_r", seen)).alias("_o")).select(*by, "_o.pix", "_o.x")


def pyramid(values: DataFrame, levels: int, by: tuple[str, ...] = ()) -> DataFrame:
    """by, level, pix, mean, n: means of a field (pix, value) over nested pixels, level 0 as it is, each further one over four of the last.

    All levels group by the coarsest pixel first, so one shuffle on that serves them all. Pixels of one level have one area: a mean over
    values is that over the sphere. Missing values are left out, and n says how many there were.
    """
    names = [f"_p{level}" for level in range(levels + 1)]
    rows = values.where(C.finite(F.col("value"))).select(*by, "value", *[F.floor(F.col("pix") / 4**level).cast("long").alias(name) for level, name in enumerate(names)])
    part = rows.repartition(*by, names[-1]).groupBy(*by, *names).agg(F.sum("value").alias("_s"), F.count(F.lit(1)).alias("n"))
    out = None
    for level in range(levels + 1):
        if level:
            part = part.groupBy(*by, *names[level:]).agg(F.sum("_s").alias("_s"), F.sum("n").alias("n"))
        rows = part.select(*by, F.lit(level).alias("level"), F.col(names[level]).alias("pix"), (F.col("_s") / F.col("n")).alias("mean"), "n")
        out = rows if out is None else out.unionByName(rows)
    return out


def skips(means: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """by, level, pix, skip: what a pixel has beyond the pixel of the next level that holds it; at the coarsest level its mean."""
    above = means.select(*by, (F.col("level") - 1).alias("level"), F.col("pix").alias("_parent"), F.col("mean").alias("_above"))
    rows = means.withColumn("_parent", F.floor(F.col("pix") / 4).cast("long")).join(above, [*by, "level", "_parent"], "left")
    return rows.select(*by, "level", "pix", (F.col("mean") - F.coalesce("_above", F.lit(0.0))).alias("skip"))


def upsample(coarse: DataFrame, skip: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """by, pix, value of the next finer level: the value of the pixel (pix, value) that holds it, and its skip."""
    below = skip.withColumn("_parent", F.floor(F.col("pix") / 4).cast("long")).select(*by, "pix", "_parent", "skip")
    return below.join(coarse.select(*by, F.col("pix").alias("_parent"), "value"), [*by, "_parent"]).select(*by, "pix", (F.col("value") + F.col("skip")).alias("value"))


def downsample_linear(rows: DataFrame, factor: int, to_x: Matrix, to_place: Matrix, place: DataFrame) -> DataFrame:
    """pix, x on a mesh with `factor` times fewer pixels: a linear map of the channels of the pixels in a pixel, in nested order, and one of their places, normalized.

    rows: pix, x. place: pix (coarse), rel: the finer centres relative to the coarse one, end to end. A pixel of which a part is missing is left out.
    """
    parts = rows.groupBy(F.floor(F.col("pix") / factor).cast("long").alias("pix")).agg(F.array_sort(F.collect_list(F.struct("pix", "x"))).alias("_r"))
    whole = parts.where(F.size("_r") == factor).select("pix", F.flatten(F.transform("_r", lambda r: r.x)).alias("_x"))
    return whole.join(place, "pix").select("pix", rms_norm(plus(linear(to_x, F.col("_x")), linear(to_place, F.col("rel")))).alias("x"))


def upsample_linear(coarse: DataFrame, shortcut: DataFrame, factor: int, to_x: Matrix, to_place: Matrix, place: DataFrame) -> DataFrame:
    """pix, x on a mesh with `factor` times more pixels: a linear map of a pixel's channels and of the places in it gives those of its pixels; the finer
    mesh's own channels (shortcut: pix, x) are added and the sum normalized."""
    width = len(to_x) // factor
    both = coarse.join(place, "pix").select(F.col("pix").alias("_p"), plus(linear(to_x, F.col("x")), linear(to_place, F.col("rel"))).alias("_y"))
    each = both.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(factor - 1)), lambda i: F.struct((F.col("_p") * factor + i).alias("pix"), F.slice("_y", i * width + 1, width).alias("y")))).alias("_e"))
    return each.select("_e.pix", "_e.y").join(shortcut, "pix").select("pix", rms_norm(plus(F.col("y"), F.col("x"))).alias("x"))


def relative_places(fine: DataFrame, coarse: DataFrame, factor: int) -> DataFrame:
    """pix (coarse), rel: unit vectors of the finer centres less that of the pixel, end to end, each coordinate less its mean and over its deviation.

    fine, coarse: pix, lon, lat.
    """
    f = fine.select(F.floor(F.col("pix") / factor).cast("long").alias("_p"), (F.col("pix") % factor).cast("int").alias("_i"), C.unit_vector(F.col("lat"), F.col("lon")).alias("_f"))
    c = coarse.select(F.col("pix").alias("_p"), C.unit_vector(F.col("lat"), F.col("lon")).alias("_c"))
    rows = f.join(c, "_p").select("_p", "_i", F.explode(F.array(*[F.struct(F.lit(a).alias("a"), (F.col(f"_f.{x}") - F.col(f"_c.{x}")).alias("v")) for a, x in enumerate("xyz")])).alias("_o")).select("_p", "_i", "_o.a", "_o.v")
    usual = F.broadcast(rows.groupBy("_i", "a").agg(F.avg("v").alias("_m"), F.stddev_samp("v").alias("_s")))  # 3 * factor rows
    scaled = rows.join(usual, ["_i", "a"]).withColumn("v", (F.col("v") - F.col("_m")) / (F.col("_s") + 1e-6))
    return scaled.groupBy(F.col("_p").alias("pix")).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "a", "v"))), lambda r: r.v).alias("rel"))


def solved(matrix: Column, n: int) -> Column:
    """x of A x = b by elimination, from the rows of A (symmetric, positive definite) with b as last column."""

    def step(rows, p):
        pivot = F.element_at(rows, p)
        unit = F.transform(pivot, lambda v: v / F.element_at(pivot, p))
        return F.transform(rows, lambda row, i: F.when(i + 1 == p, unit).otherwise(F.zip_with(row, unit, lambda a, b: a - F.element_at(row, p) * b)))

    done = F.aggregate(F.sequence(F.lit(1), F.lit(n)), matrix, step)
    return F.transform(done, lambda row: F.element_at(row, n + 1))


def fitted_weights(edges: DataFrame, fields: DataFrame, truth: DataFrame, k: int, ridge: float = 1e-3, power: float = 2.0) -> DataFrame:
    """to_id, weights (by rank): inverse-distance weights corrected by least squares over training fields.

    edges: to_id, from_id, rank (1 to k), dist; fields: id, name, value at the sources; truth: the same at the targets. For each target the normal
    equations of its k neighbours are sums over the fields; a ridge (of so much of their mean diagonal) draws the correction to zero. Targets
    with fewer than k neighbours, and fields missing at a neighbour, are left out.
    """
    near = edges.join(fields.withColumnRenamed("id", "from_id"), "from_id").where(C.finite(F.col("value")))
    rows = near.groupBy("to_id", "name").agg(F.array_sort(F.collect_list(F.struct("rank", "dist", "value"))).alias("_n")).where(F.size("_n") == k)
    rows = rows.join(truth.select(F.col("id").alias("to_id"), "name", F.col("value").alias("_y")), ["to_id", "name"]).where(C.finite(F.col("_y")))
    rows = rows.select("to_id", F.transform("_n", lambda r: r.value).alias("x"), inverse_distance(F.transform("_n", lambda r: r.dist), power).alias("w"), "_y")
    rows = rows.withColumn("r", F.col("_y") - dot(F.col("x"), F.col("w")))
    x = [F.element_at("x", i + 1) for i in range(k)]
    sums = [F.sum(x[i] * x[j]).alias(f"a{i}_{j}") for i in range(k) for j in range(i, k)] + [F.sum(x[i] * F.col("r")).alias(f"b{i}") for i in range(k)]
    got = rows.groupBy("to_id").agg(F.first("w").alias("w"), *sums)
    soft = ridge * sum((F.col(f"a{i}_{i}") for i in range(k)), F.lit(0.0)) / k + 1e-12
    lines = [F.array(*[F.col(f"a{min(i, j)}_{max(i, j)}") + (soft if i == j else 0.0) for j in range(k)], F.col(f"b{i}")) for i in range(k)]
    return got.select("to_id", plus(F.col("w"), solved(F.array(*lines), k)).alias("weights"))


def inverse_distance(dist: Column, power: float = 2.0, eps: float = 1e-12) -> Column:
    """Weights 1 / (dist ** power + eps), over their sum."""
    w = F.transform(dist, lambda d: 1 / (F.pow(d, F.lit(power)) + eps))
    return F.transform(w, lambda v: v / F.aggregate(w, F.lit(0.0), lambda s, u: s + u))


def apply_weights(edges: DataFrame, weights: DataFrame, values: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """id, value: the neighbours' values summed with fitted weights."""
    rows = edges.join(weights, "to_id").select("to_id", "from_id", F.element_at("weights", F.col("rank").cast("int")).alias("_w")).join(values.withColumnRenamed("id", "from_id"), "from_id")
    return rows.groupBy(F.col("to_id").alias("id"), *by).agg(F.sum(F.col("_w") * F.col("value")).alias("value"))
