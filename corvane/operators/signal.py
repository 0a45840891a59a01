"""Arithmetic on sample arrays, as higher-order functions: levels, mixing, resampling, framing, quantizing."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.folds import fold


def doubles(x: Column) -> Column:
    return x.cast("array<double>")


def let(value: Column, f) -> Column:
    """f of a value that is computed once, also where f uses it for every element of an array."""
    return F.element_at(F.transform(F.array(value), f), 1)


def rounded(x: Column, places: int) -> Column:
    """Rounded, halves away from zero; what is negative and rounds to zero stays negative, as in SQL."""
    return F.round(F.abs(x), places) * F.signum(x)


def total(x: Column, f=lambda v: v) -> Column:
    return F.aggregate(doubles(x), F.lit(0.0), lambda a, v: a + f(v))


def peak(x: Column) -> Column:
    return F.array_max(F.transform(doubles(x), F.abs))


def rms(x: Column) -> Column:
    """Root mean square in double precision; null for an empty array."""
    return F.sqrt(total(x, lambda v: v * v) / F.nullif(F.size(x), F.lit(0)))


def dbfs(level: Column) -> Column:
    """Decibels of full scale; null for silence."""
    return F.when(level > 0, 20 * F.log10(level))


def share(x: Column, test) -> Column:
    return F.size(F.filter(doubles(x), test)) / F.nullif(F.size(x), F.lit(0))


def levels(x: Column, clip: float = 0.99, silence: float = 1e-4) -> Column:
    """struct<peak, rms, rms_dbfs, clipped, silent>."""
    r = rms(x)
    return F.struct(peak(x).alias("peak"), r.alias("rms"), dbfs(r).alias("rms_dbfs"), share(x, lambda v: F.abs(v) >= clip).alias("clipped"), share(x, lambda v: F.abs(v) <= silence).alias("silent"))


def downmix(channels: Column) -> Column:
    """The mean of an array of channels, sample by sample."""
    return F.transform(F.sequence(F.lit(0), F.size(channels[0]) - 1), lambda i: F.aggregate(channels, F.lit(0.0), lambda a, c: a + c[i]) / F.size(channels))


def fit_length(x: Column, n: Column | int) -> Column:
    """Cropped, or filled up with zeros."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.slice(F.concat(doubles(x), F.array_repeat(F.lit(0.0), F.greatest(n - F.size(x), F.lit(0)))), F.lit(1), n)


def resample(x: Column, old: int, new: int) -> Column:
    """Linear interpolation onto round(n * new / old) samples, ends included; halves round to even."""
    n = F.size(x)
    m = F.greatest(F.lit(1), F.bround(n * F.lit(new / old)).cast("int"))
    d = doubles(x)

    def at(i: Column) -> Column:
        p = F.when(m > 1, i * (n - 1) / (m - 1)).otherwise(F.lit(0.0))
        low = F.floor(p).cast("int")
        a, b = F.element_at(d, low + 1), F.element_at(d, F.least(low + 2, n))
        return a + (b - a) * (p - low)

    return F.when(n > 0, F.transform(F.sequence(F.lit(0), m - 1), at)).otherwise(F.array().cast("array<double>"))


def limit_peak(x: Column, most: float) -> Column:
    """Scaled so that the peak is at most so high."""
    scaled = lambda s: F.when(s["p"] > most, F.transform(s["x"], lambda v: v * (F.lit(most) / s["p"]))).otherwise(s["x"])
    return let(F.struct(x.alias("x"), peak(x).alias("p")), scaled)


def dry_wet(dry: Column, wet: Column, strength: float, most: float = 0.99) -> Column:
    """The shares of two tracks of the shorter's length, peak-limited."""
    n = F.least(F.size(dry), F.size(wet))
    cut = lambda x: F.slice(doubles(x), F.lit(1), n)
    return limit_peak(F.zip_with(cut(dry), cut(wet), lambda a, b: (1 - strength) * a + strength * b), most)


def centered(x: Column) -> Column:
    return let(total(x) / F.size(x), lambda mean: F.transform(doubles(x), lambda v: v - mean))


def power(x: Column) -> Column:
    """Of a centered array: the mean square."""
    return total(x, lambda v: v * v) / F.size(x)


def snr_mix(clean: Column, noise: Column, snr_db: float, most: float = 0.98) -> Column:
    """struct<alpha, gain, samples: array<long>> of PCM samples mixed at an exact signal-to-noise ratio.

    Both are centered; one gain keeps the peak within the limit for both, so the ratio stays. Samples round half to even
    and end at floor(most * 32768). Null for near silence on either side or unequal lengths.
    """
    bound = float(math.floor(most * 32768))

    def mix(s: Column) -> Column:
        alpha = F.sqrt(s["pc"] / (s["pn"] * 10 ** (snr_db / 10)))
        return let(F.struct(s["c"].alias("c"), s["n"].alias("n"), alpha.alias("alpha")), lambda t: F.struct(t["alpha"].alias("alpha"), F.zip_with(t["c"], t["n"], lambda a, b: a + t["alpha"] * b).alias("x")))

    def limit(m: Column) -> Column:
        top = F.array_max(F.transform(m["x"], F.abs)) / 32768
        gain = F.when(top <= most, F.lit(1.0)).otherwise(most / top)
        return let(F.struct(m["alpha"].alias("alpha"), m["x"].alias("x"), gain.alias("gain")), lambda g: F.struct(g["alpha"].alias("alpha"), g["gain"].alias("gain"), F.transform(g["x"], lambda v: F.least(F.lit(bound), F.greatest(F.lit(-bound), F.rint(v * g["gain"]))).cast("long")).alias("samples")))

    tracks = F.struct(centered(clean).alias("c"), centered(noise).alias("n"))
    powers = let(tracks, lambda t: F.struct(t["c"].alias("c"), t["n"].alias("n"), power(t["c"]).alias("pc"), power(t["n"]).alias("pn")))
    fits = lambda s: F.when((F.size(s["c"]) == F.size(s["n"])) & (s["pc"] > 1e-12) & (s["pn"] > 1e-12), let(mix(s), limit))
    return let(powers, fits)


def crossfade(source: Column, target: Column, count: int = 80, gain: float = 1.0) -> Column:
    """From source to target over the first samples, weights 0 to 1 with both ends; gain, then clipped to -1 to 1."""
    w = lambda i: F.when(i < count, i / F.lit(max(1, count - 1))).otherwise(F.lit(1.0))
    mixed = F.transform(F.arrays_zip(doubles(source).alias("s"), doubles(target).alias("t")), lambda x, i: (x["s"] * (1 - w(i)) + x["t"] * w(i)) * gain)
    return F.transform(mixed, lambda v: F.least(F.lit(1.0), F.greatest(F.lit(-1.0), v)))


def pcm16(x: Column) -> Column:
    """Samples clipped to -1 to 1 as 16-bit integers, halves to even; null if any is not finite."""
    ok = F.forall(doubles(x), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.when(ok, F.transform(doubles(x), lambda v: F.rint(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), v)) * 32767).cast("int")))


def frames(x: Column, size: int = 1024, hop: int = 256) -> Column:
    """Sliding frames; a shorter signal is one frame filled with zeros; a trailing part is dropped."""
    n = F.greatest(F.size(x), F.lit(size))
    d = fit_length(x, n)
    return F.transform(F.sequence(F.lit(0), n - size, F.lit(hop)), lambda i: F.slice(d, i + 1, F.lit(size)))


def common_range(a: Column, b: Column) -> Column:
    """struct<a, b, top>: two tracks cropped to the shorter, and the largest amplitude of both."""
    n = F.least(F.size(a), F.size(b))
    x, y = F.slice(doubles(a), F.lit(1), n), F.slice(doubles(b), F.lit(1), n)
    return F.struct(x.alias("a"), y.alias("b"), F.greatest(peak(x), peak(y)).alias("top"))


def decibel_frames(samples: np.ndarray, size: int = 1024, hop: int = 256, floor: float = 1e-8) -> np.ndarray:
    """(frames, bins) of windowed spectra in dB."""
    x = np.asarray(samples, float)
    x = np.pad(x, (0, max(0, size - len(x))))
    at = np.lib.stride_tricks.sliding_window_view(x, size)[::hop]
    return 20 * np.log10(np.maximum(np.abs(np.fft.rfft(at * np.hanning(size), axis=1)), floor))


def spectrogram(rows: DataFrame, key: str, samples: str, size: int = 1024, hop: int = 256) -> DataFrame:
    """(key, frame, db: array<double>) of each row's samples."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k, x in zip(b[key], b[samples], strict=True):
                db = decibel_frames(np.asarray(x, float), size, hop)
                yield pd.DataFrame({key: k, "frame": np.arange(len(db)), "db": list(db)})

    return rows.select(key, samples).mapInPandas(run, f"{key} {dict(rows.dtypes)[key]}, frame long, db array<double>")


#: The levelers' settings in dB and ms.
NORMAL = {"target": -20.0, "gate": -48.0, "most": 12.0, "least": -6.0, "attack": 40.0, "release": 350.0, "gate_release": 40.0, "peak": 0.95}
QUIET = {"target": -18.0, "gate": -60.0, "most": 18.0, "least": 0.0, "attack": 35.0, "release": 120.0, "gate_release": 1500.0, "peak": 0.95}


def gain_step(gain: float, level: float, s: dict[str, float], seconds: float) -> float:
    """The gain after a block of a level (rms): toward the wanted gain, by attack, release or, below the gate, gate release."""
    linear = lambda db: 10 ** (db / 20)
    if level < linear(s["gate"]):
        wanted, tau = min(gain, 1.0), s["gate_release"]
    else:
        wanted = min(max(linear(s["target"]) / max(level, 1e-8), linear(s["least"])), linear(s["most"]))
        tau = s["attack"] if wanted < gain else s["release"]
    return gain + (1 - math.exp(-seconds / (tau / 1000))) * (wanted - gain)


def level_stream(blocks: DataFrame, key: str, order: str, samples: str, settings: dict[str, float] = NORMAL, rate: int = 16_000) -> DataFrame:
    """(key, order, gain, samples) of a stream's blocks in order: leveled and peak-limited. The gain is a recurrence, so blocks are folded."""
    kinds = dict(blocks.dtypes)

    def step(gain: float, row) -> tuple[float, tuple]:
        x = np.asarray(getattr(row, samples), float)
        gain = gain_step(gain, float(np.sqrt(np.mean(x * x))) if len(x) else 0.0, settings, len(x) / rate)
        y = x * gain
        top = float(np.abs(y).max()) if len(y) else 0.0
        return gain, (getattr(row, key), getattr(row, order), gain, y * (settings["peak"] / top) if top > settings["peak"] else y)

    return fold(blocks.select(key, order, samples), key, order, lambda: 1.0, step, f"{key} {kinds[key]}, {order} {kinds[order]}, gain double, samples array<double>")


def latency(rows: DataFrame, key: str, order: str, value: str, keep: int = 4096, block_seconds: float = 0.016) -> DataFrame:
    """(key, n, mean, p95, most, realtime) over the newest values of each key; p95 interpolates."""
    from .quality import latest_by

    last = latest_by(rows.select(key, order, F.col(value).cast("double").alias("_v")), key, order, keep)
    return last.groupBy(key).agg(F.count("*").alias("n"), F.avg("_v").alias("mean"), F.percentile("_v", 0.95).alias("p95"), F.max("_v").alias("most")).withColumn("realtime", F.col("mean") / block_seconds)
