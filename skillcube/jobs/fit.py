"""Fitting predictors on samples: gradients summed over tasks, AdamW with warm-up and cosine decay, checkpoints that a fit resumes from.

A sample is a row that holds a whole grid, so it is a task's unit of work: a task turns its samples into gradients (Arrow batches,
numpy), these are summed by groups of samples and the groups' sums on the driver, which holds parameters of one number per input and
output channel. Groups are of the init's hash and are summed in order, so partitions and lost tasks don't change a bit.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skillcube.config import Config
from skillcube.jobs import build
from skillcube.sources import weights as stored

MSE, CRPS = "latitude_weighted_mse", "fair_crps"
#: Samples whose gradients meet in one list, about; and lists at most.
GROUP, MOST_GROUPS = 200, 1_024


@dataclass(frozen=True)
class FitConfig:
    """Settings of a fit; batch_size None: all samples in one step an epoch."""

    lr: float = 3e-4
    weight_decay: float = 0.1
    warmup_epochs: int = 2
    max_epochs: int = 50
    min_lr: float = 1e-6
    gradient_clip_val: float = 1.0
    batch_size: int | None = 32
    loss: str = MSE
    train_members: int = 8
    seed: int = 0
    betas: tuple[float, float] = (0.9, 0.999)
    eps: float = 1e-8

    def rate(self, epoch: int) -> float:
        """The learning rate of an epoch (from 0)."""
        if epoch < self.warmup_epochs:
            return self.lr * (epoch + 1) / self.warmup_epochs
        done = (epoch - self.warmup_epochs) / max(1, self.max_epochs - self.warmup_epochs)
        return self.min_lr + (self.lr - self.min_lr) * 0.5 * (1 + np.cos(np.pi * done))


@dataclass
class Fit:
    """Parameters and optimizer state after `epoch` epochs and `step` steps; losses: (epoch, train, val)."""

    params: dict[str, np.ndarray]
    first: dict[str, np.ndarray]
    second: dict[str, np.ndarray]
    epoch: int = 0
    step: int = 0
    losses: list[tuple[int, float, float | None]] = field(default_factory=list)

    def tensors(self) -> dict[str, np.ndarray]:
        out = {f"{kind}.{k}": v for kind, part in (("model", self.params), ("first", self.first), ("second", self.second)) for k, v in part.items()}
        return out | {"epoch": np.array(self.epoch), "step": np.array(self.step), "losses": np.array([[np.nan if x is None else x for x in row] for row in self.losses]).reshape(-1, 3)}

    @classmethod
    def of(cls, tensors: dict[str, np.ndarray]) -> Fit:
        part = lambda kind: {k.removeprefix(f"{kind}."): v for k, v in tensors.items() if k.startswith(f"{kind}.")}
        losses = [(int(e), float(t), None if np.isnan(v) else float(v)) for e, t, v in tensors["losses"]]
        return cls(part("model"), part("first"), part("second"), int(tensors["epoch"]), int(tensors["step"]), losses)


def started(cfg: Config, settings: FitConfig) -> Fit:
    """A linear predictor of zero: `weight` (outputs by inputs), `bias`, and `spread` (log of the noise's deviation) for members."""
    inputs, outputs = cfg.channels[0], len(cfg.lead_weeks) * cfg.channels[1]
    params = {"weight": np.zeros((outputs, inputs)), "bias": np.zeros(outputs)}
    if settings.loss == CRPS:
        if settings.train_members < 2:
            raise ValueError(f"{CRPS} needs two members or more, not {settings.train_members}")
        params["spread"] = np.zeros(outputs)
    elif settings.loss != MSE:
        raise ValueError(f"unknown loss: {settings.loss!r}")
    return Fit(params, *({k: np.zeros_like(v) for k, v in params.items()} for _ in range(2)))


def normal_draws(seed: int, key: str, shape: tuple[int, ...]) -> np.ndarray:
    """Standard normal draws fixed by seed and key, wherever they are made."""
    return np.random.Generator(np.random.Philox(key=[seed, int.from_bytes(key.encode()[-8:], "little")])).standard_normal(shape)


def mse_gradient(params, x, y, w):
    """Sums over a sample: loss, number of terms, gradients. x: inputs by cells, y: outputs by cells (NaN: missing), w: cells' weights."""
    there = np.isfinite(y)
    e = np.where(there, params["weight"] @ x + params["bias"][:, None] - np.where(there, y, 0.0), 0.0)
    g = 2 * e * w
    return float((e * e * w).sum()), int(there.sum()), {"weight": g @ x.T, "bias": g.sum(1)}


def crps_gradient(params, x, y, w, draws):
    """The same for the fair CRPS of members mean + exp(spread) * draw; draws: members by outputs by cells."""
    m, there = len(draws), np.isfinite(y)
    s = np.exp(params["spread"])[:, None]
    off = params["weight"] @ x + params["bias"][:, None] + s * draws - np.where(there, y, 0.0)
    ordered = np.sort(draws, axis=0)
    apart = np.tensordot(2 * np.arange(m) - (m - 1), ordered, 1) / (m * (m - 1))  # half the mean distance of two members, over s
    weight = np.where(there, w, 0.0)
    side = np.sign(off)
    mean = side.mean(0) * weight
    loss = (np.abs(off).mean(0) - s * apart) * weight
    return float(loss.sum()), int(there.sum()), {"weight": mean @ x.T, "bias": mean.sum(1), "spread": (((side * draws).mean(0) - apart) * weight * s).sum(1)}


def gradients(samples: DataFrame, params: dict[str, np.ndarray], cells: np.ndarray, settings: FitConfig, epoch: int) -> tuple[float, int, dict[str, np.ndarray]]:
    """Mean loss, number of terms and mean gradients over samples (init, input, target). cells: weights by place."""
    inputs, outputs = params["weight"].shape[1], params["weight"].shape[0]
    held = samples.sparkSession.sparkContext.broadcast((params, cells))  # a number per input and output channel, and per cell

    def of(batches):
        params, w = held.value
        for batch in batches:
            x, y = (batch.column(c).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, n, len(w)) for c, n in (("input", inputs), ("target", outputs)))
            keys, losses, counts, sums = batch.column("key").to_pylist(), [], [], []
            for key, a, b in zip(keys, x, y):
                if settings.loss == MSE:
                    loss, n, g = mse_gradient(params, a, b, w)
                else:
                    loss, n, g = crps_gradient(params, a, b, w, normal_draws(settings.seed + epoch, key, (settings.train_members, *b.shape)))
                losses.append(loss), counts.append(n), sums.append(np.concatenate([g[k].ravel() for k in sorted(g)]))
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(losses, pa.float64()), pa.array(counts, pa.int64()), pa.array([s.tolist() for s in sums], pa.list_(pa.float64()))], names=["key", "loss", "n", "g"])

    rows = samples.select(F.col("init").cast("string").alias("key"), "input", "target").mapInArrow(of, "key string, loss double, n long, g array<double>")
    groups = max(1, min(MOST_GROUPS, samples.count() // GROUP))
    in_order = F.array_sort(F.collect_list(F.struct("key", "loss", "n", "g")))
    size = sum(v.size for v in params.values())
    zero = F.struct(F.lit(0.0).alias("loss"), F.lit(0).cast("long").alias("n"), F.array_repeat(F.lit(0.0), size).alias("g"))
    add = lambda a, b: F.struct((a.loss + b.loss).alias("loss"), (a.n + b.n).alias("n"), F.zip_with(a.g, b.g, lambda u, v: u + v).alias("g"))
    parts = rows.groupBy(F.pmod(F.xxhash64("key"), F.lit(groups)).alias("group")).agg(F.aggregate(in_order, zero, add).alias("s")).select("group", "s.*").collect()
    loss, n, g = 0.0, 0, np.zeros(size)
    for r in sorted(parts, key=lambda r: r["group"]):  # groups of samples: MOST_GROUPS at most
        loss, n, g = loss + r["loss"], n + r["n"], g + np.array(r["g"])
    out, at = {}, 0
    for k in sorted(params):
        out[k] = g[at : at + params[k].size].reshape(params[k].shape) / max(1, n)
        at += params[k].size
    return loss / max(1, n), n, out


def stepped(fit: Fit, gradient: dict[str, np.ndarray], settings: FitConfig) -> None:
    """One step of AdamW, the gradient clipped to a norm."""
    norm = np.sqrt(sum(float((g * g).sum()) for g in gradient.values()))
    scale = min(1.0, settings.gradient_clip_val / norm) if settings.gradient_clip_val and norm > 0 else 1.0
    fit.step += 1
    rate, (b1, b2) = settings.rate(fit.epoch), settings.betas
    for k, p in fit.params.items():
        g = gradient[k] * scale
        fit.first[k] = b1 * fit.first[k] + (1 - b1) * g
        fit.second[k] = b2 * fit.second[k] + (1 - b2) * g * g
        move = fit.first[k] / (1 - b1**fit.step) / (np.sqrt(fit.second[k] / (1 - b2**fit.step)) + settings.eps)
        fit.params[k] = p * (1 - rate * settings.weight_decay) - rate * move


def fit(data: build.Data, cfg: Config, settings: FitConfig, path: str | None = None, epochs: int | None = None) -> Fit:
    """A linear predictor fitted on data.train, its loss on data.val noted by epoch.

    path: folder of checkpoints (sources.weights), one an epoch; a fit goes on from the last one there. epochs: stop after so many.
    """
    spark = data.train.sparkSession
    state = started(cfg, settings)
    if path is not None and (there := [int(c.removeprefix("epoch=")) for c in stored.checkpoints(spark, path)]):
        state = Fit.of(stored.load(stored.read(spark, path, f"epoch={max(there)}")))
    train, val = (s.select("init", "input", "target").persist() for s in (data.train, data.val))
    try:
        while state.epoch < min(settings.max_epochs, epochs if epochs is not None else settings.max_epochs):
            if settings.batch_size is None:
                batches = [train]
            else:
                dealt = build.batches(build.shuffled(train, settings.seed, state.epoch), settings.batch_size).persist()
                batches = [dealt.where(F.col("batch") == b) for b in range(-(-train.count() // settings.batch_size))]
            total = terms = 0.0
            for some in batches:
                loss, n, g = gradients(some, state.params, data.cell_weights(), settings, state.epoch)
                total, terms = total + loss * n, terms + n
                stepped(state, g, settings)
            if settings.batch_size is not None:
                dealt.unpersist()
            seen, n, _ = gradients(val, state.params, data.cell_weights(), settings, state.epoch)
            state.losses.append((state.epoch, total / max(1.0, terms), seen if n else None))
            state.epoch += 1
            if path is not None:
                stored.write(spark, path, f"epoch={state.epoch}", state.tensors())
    finally:
        train.unpersist(), val.unpersist()
    return state


FORECAST = "variable string, cell_id int, lat double, lon double, init date, lead int, member int, value double"


def forecast(samples: DataFrame, params: dict[str, np.ndarray], data: build.Data, cfg: Config, seed: int = 0) -> DataFrame:
    """Standardized forecasts (a row per member) of samples: of one member, or of cfg.members where the parameters have a spread."""
    held = samples.sparkSession.sparkContext.broadcast((params, data.cell_id, data.lat, data.lon))  # once per worker
    names, leads, members = list(cfg.target_vars), list(cfg.lead_weeks), cfg.members if "spread" in params else 1
    columns = [c.split()[0] for c in FORECAST.split(", ")]

    def of(batches):
        params, ids, lat, lon = held.value
        cells, per = len(ids), len(names) * len(ids)
        for batch in batches:
            x = batch.column("input").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1, cells)
            for init, key, a in zip(batch.column("init").to_pylist(), batch.column("key").to_pylist(), x):
                mean = params["weight"] @ a + params["bias"][:, None]
                drawn = mean[None] + (np.exp(params["spread"])[:, None] * normal_draws(seed, key, (members, *mean.shape)) if "spread" in params else 0.0)
                for m, values in enumerate(drawn.reshape(members, len(leads), per)):
                    for lead, row in zip(leads, values):
                        yield pa.RecordBatch.from_arrays([
                            pa.array(np.repeat(names, cells)), pa.array(np.tile(ids, len(names)), pa.int32()), pa.array(np.tile(lat, len(names))), pa.array(np.tile(lon, len(names))),
                            pa.array([init] * per, pa.date32()), pa.array(np.full(per, lead), pa.int32()), pa.array(np.full(per, m), pa.int32()), pa.array(row),
                        ], names=columns)

    return samples.select(F.col("init").cast("date").alias("init"), F.col("init").cast("string").alias("key"), "input").mapInArrow(of, FORECAST)
