"""Separation of overlapping callers, cleaning with a noise mask, and splicing of tracks into clips."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sonaria.functions import kernels
from sonaria.operators import frames as fr
from sonaria.operators.intervals import longest_solo, overlap_members
from sonaria.operators.registry import caller_id, clip_name
from sonaria.operators.spectral import window_rms

RATE, N_FFT, HOP = 4000, 8192, 256
TRACKS = "file string, group_id long, caller int, f0 double, separated boolean, samples array<float>"


def _contour(y: np.ndarray) -> np.ndarray | None:
    """A fundamental for each frame of a solo stretch, gaps filled; None if it is short or hardly voiced."""
    if len(y) < 0.3 * RATE:
        return None
    f0, _ = kernels.pyin(y, RATE, 8.0, 50.0, 2048, HOP)
    ok = np.flatnonzero(np.isfinite(f0))
    return np.interp(np.arange(len(f0)), ok, f0[ok]) if len(ok) >= 2 else None


def estimate_f0(y: np.ndarray) -> float | None:
    """The median fundamental of a stretch of at least 0.3 s, or else its strongest spectral peak from 8 to 50 Hz."""
    if len(y) < 0.3 * RATE:
        return None
    f0, _ = kernels.pyin(y, RATE, 8.0, 50.0)
    f0 = f0[np.isfinite(f0)]
    if len(f0) >= 2:
        return float(np.median(f0))
    mean = np.abs(kernels.stft(y, N_FFT, HOP)).mean(0)
    freqs = np.arange(len(mean)) * RATE / N_FFT
    band = np.flatnonzero((freqs >= 8) & (freqs <= 50))
    return float(freqs[band[mean[band].argmax()]]) if mean[band].max() > 0 else None


def extend(contour: np.ndarray, first: int, n: int, span: int = 10) -> np.ndarray:
    """A solo contour placed at frame `first` of n and continued on both sides along the line through its outer
    frames, within 8 to 50 Hz."""
    part = contour[max(0, -first) : max(0, n - first)]
    at = max(0, first)
    if not len(part):
        return np.full(n, 20.0)
    x = np.arange(at, at + len(part))
    k = min(span, len(part))
    down, up = (np.polyfit(x[s], part[s], 1)[0] if len(part) >= 3 else 0.0 for s in (slice(0, k), slice(len(part) - k, None)))
    out = np.empty(n)
    out[x] = part
    out[:at] = np.clip(part[0] - (at - np.arange(at)) * down, 8, 50)
    rest = np.arange(at + len(part), n)
    out[rest] = np.clip(part[-1] + (rest - x[-1]) * up, 8, 50)
    return out


def _engulfed(found: list[float], known: list[float], n: int) -> list[float | None]:
    """Fundamentals for n callers without solo: those of the mixture that are not within 3 Hz of a known one, in
    order; when they run out, the first of the mixture's that is not one of those given away (within 0.5 Hz)."""
    new = [f for f in found if all(abs(f - k) >= 3.0 for k in known)]
    out: list[float | None] = []
    for i in range(n):
        if i < len(new):
            out.append(new[i])
        else:
            out.append(next((f for f in found if all(abs(f - u) >= 0.5 for u in new[:i])), None))
    return out


def separate_group(y: np.ndarray, calls: list[dict], begin: float, end: float) -> tuple[list[np.ndarray], list[float | None]]:
    """(a track for each call, its fundamental) of an overlap group, or the mixture alone if fewer than two calls have
    a fundamental. calls: start_s, end_s, solo_start, solo_end (null without solo)."""
    spec = kernels.stft(y, N_FFT, HOP)
    freqs, n = np.arange(spec.shape[1]) * RATE / N_FFT, len(spec)
    fps = RATE / HOP
    f0: list[float | None] = [None] * len(calls)
    contours: list[np.ndarray | None] = [None] * len(calls)
    hidden = []
    for k, c in enumerate(calls):
        if c["solo_start"] is None or c["solo_end"] - c["solo_start"] < 0.3:
            hidden.append(k)
            continue
        part = y[round(c["solo_start"] * RATE) : round(c["solo_end"] * RATE)]
        contour = _contour(part)
        if contour is None:
            f0[k] = estimate_f0(part)
        else:
            f0[k], contours[k] = float(np.median(contour)), extend(contour, round(c["solo_start"] * fps), n)
    if hidden:
        known = [f for f in f0 if f is not None]
        part = y[round(begin * RATE) : round(end * RATE)]
        found = kernels.multipitch(np.abs(kernels.stft(part, N_FFT, HOP)).mean(0), RATE / N_FFT, len(known) + len(hidden)) if len(part) >= 0.2 * RATE else []
        for k, f in zip(hidden, _engulfed(found, known, len(hidden)), strict=True):
            f0[k] = f
    if sum(f is not None for f in f0) < 2:
        return [y], f0
    mag = np.abs(spec)
    combs = [kernels.comb(c, freqs) if c is not None else np.broadcast_to(kernels.comb(np.array([f]), freqs), mag.shape) if f is not None else np.full(mag.shape, 0.1) for c, f in zip(contours, f0, strict=True)]
    total = sum(c * mag for c in combs) + 1e-8
    a, b = round(begin * fps), round(end * fps)
    out = []
    for c, comb in zip(calls, combs, strict=True):
        s, e = round(c["start_s"] * fps), min(round(c["end_s"] * fps), n)
        part = np.zeros_like(spec)
        part[s : min(a, e)] = spec[s : min(a, e)]
        both = slice(max(s, a), min(e, b))
        part[both] = (comb * mag / total)[both] * spec[both]
        part[max(b, s) : e] = spec[max(b, s) : e]
        out.append(kernels.istft(part, HOP, len(y)))
    return out, f0


def separate(audio: DataFrame, calls: DataFrame) -> DataFrame:
    """A track for each member of each overlap group of a recording; a recording without groups is one track. calls:
    file, id, start_s, end_s. A group that can't be separated gives the mixture once and null tracks for the other
    members. Recordings meet their calls by file; each group is a row of its own, so groups run side by side."""
    members = overlap_members(calls)
    solo = longest_solo(members)
    m = members.select("file", "group_id", "id", "group_start", "group_end").join(solo, ["file", "group_id", "id"])
    groups = m.groupBy("file", "group_id", "group_start", "group_end").agg(F.array_sort(F.collect_list(F.struct("start_s", "end_s", "id", "solo_start", "solo_end"))).alias("calls"))
    work = audio.select("file", "samples").join(groups, "file", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(len(b)):
                file, x, g, begin, end, members = (b.column(i)[row] for i in range(6))
                y = x.values.to_numpy(zero_copy_only=False).astype(float) if x.is_valid else np.zeros(0)
                if not g.is_valid or not len(y):
                    tracks, f0, apart = [y], [None], False
                else:
                    tracks, f0 = separate_group(y, members.as_py(), begin.as_py(), end.as_py())
                    apart = len(tracks) > 1 or len(f0) == 1
                    tracks = tracks + [None] * (len(f0) - len(tracks))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([file.as_py()] * len(f0), pa.string()), pa.array([g.as_py()] * len(f0), pa.int64()), pa.array(range(len(f0)), pa.int32()), pa.array(f0, pa.float64()), pa.array([apart] * len(f0)), pa.array([t.astype(np.float32) if t is not None else None for t in tracks], pa.list_(pa.float32()))],
                    ["file", "group_id", "caller", "f0", "separated", "samples"],
                )

    tracks = work.select("file", "samples", "group_id", "group_start", "group_end", "calls").mapInArrow(run, TRACKS)
    w = Window.partitionBy("file").orderBy("group_id", "caller")
    return tracks.withColumns({"caller": (F.row_number().over(w) - 1).cast("int"), "callers": F.count("samples").over(Window.partitionBy("file")).cast("int")})


def clean(audio: DataFrame, mask, calls: DataFrame | None = None) -> DataFrame:
    """Recordings through a noise mask, then separated. mask: an array of samples to (frames by bins) weights for the
    hop of separation, missing frames and bins counting as 0; it runs on executors and is pickled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for x in b.column("samples"):
                y = x.values.to_numpy(zero_copy_only=False).astype(float) if x.is_valid else np.zeros(0)
                if len(y):
                    spec, w = kernels.stft(y, N_FFT, HOP), mask(y)
                    t, f = min(len(w), len(spec)), min(w.shape[1], spec.shape[1])
                    full = np.zeros(spec.shape)
                    full[:t, :f] = w[:t, :f]
                    y = kernels.istft(spec * full, HOP, len(y))
                out.append(y.astype(np.float32))
            yield pa.RecordBatch.from_arrays([b.column("file"), b.column("sr"), pa.array(out, pa.list_(pa.float32()))], ["file", "sr", "samples"])

    cleaned = audio.select("file", "sr", "samples").mapInArrow(run, "file string, sr int, samples array<float>")
    if calls is None:
        calls = audio.sparkSession.createDataFrame([], "file string, id long, start_s double, end_s double")
    return separate(cleaned, calls)


def murmurs(tracks: DataFrame, array: str = "samples", sr: str = "sr", key: str = "file", window_s: float = 0.25, share: float = 0.15, shortest: float = 0.3, gap: float = 0.3) -> DataFrame:
    """(key, start_s, end_s): stretches of a track louder than a share of its loudest window, joined over short gaps.
    A track shorter than a window is one stretch, and so is a silent one: every window then has the same least level."""
    size = F.greatest(F.lit(1), F.floor(F.lit(window_s) * F.col(sr))).cast("int")
    t = tracks.select(F.col(key).alias("file"), F.col(sr).alias("sr"), size.alias("size"), F.size(array).alias("n"), F.col(array).alias("x"))
    short = t.filter("n < size and n > 0").select("file", F.lit(0.0).alias("start_s"), (F.col("n") / F.col("sr")).alias("end_s"))
    rms = t.filter("n >= size").select("file", "sr", "size", F.posexplode(window_rms("x", F.col("size"))).alias("frame", "rms"))
    return _active(rms, share, shortest, gap).unionByName(short).withColumnRenamed("file", key)


def _active(rms: DataFrame, share: float, shortest: float, gap: float) -> DataFrame:
    """Stretches of windows (file, sr, size, frame, rms)."""
    top = F.max("rms").over(Window.partitionBy("file"))
    on = rms.withColumn("on", (top >= 1e-8) & (F.col("rms") > share * top))
    dt = on.select("file", (F.col("size") / F.col("sr")).alias("dt")).distinct()
    r = fr.runs(on, "on").join(dt, "file").select("file", (F.col("first") * F.col("dt")).alias("start_s"), (F.col("end") * F.col("dt")).alias("end_s"), F.lit(0).alias("id"))
    from sonaria.operators.intervals import gap_merge

    return gap_merge(r, gap).filter(F.col("end_s") - F.col("start_s") >= shortest).select("file", "start_s", "end_s")


def splice(tracks: DataFrame, kind: str = "rumble") -> DataFrame:
    """Clips of tracks (file, sr, caller, samples): parent_wav, elephant_id, clip_type, start_time, end_time,
    file_path, sr, samples. A track without a louder stretch is one clip."""
    t = tracks.filter("samples is not null").withColumn("_k", F.concat_ws("|", "file", "caller"))
    m = murmurs(t, key="_k")
    j = t.join(m, "_k", "left").withColumns({"start_time": F.coalesce("start_s", F.lit(0.0)), "end_time": F.coalesce("end_s", F.size("samples") / F.col("sr"))})
    a, b = (F.rint(F.col(c) * F.col("sr")).cast("int") for c in ("start_time", "end_time"))
    j = j.select(F.col("file").alias("parent_wav"), caller_id("caller").alias("elephant_id"), F.lit(kind).alias("clip_type"), "start_time", "end_time", "sr", F.slice("samples", a + 1, F.greatest(b - a, F.lit(0))).alias("samples"))
    return j.filter("size(samples) > 0").withColumn("file_path", clip_name("parent_wav", "elephant_id", "clip_type", "start_time"))
