"""What an application calls: clean a recording, keep its clips, look them up, rename, describe, download.

Functions take and return plain values or DataFrames; there is no web server here. What a server would answer with
an error is an exception: ValueError for a bad request, LookupError for something that isn't there.
"""

from __future__ import annotations

import json
import os
import zipfile
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonaria.operators import features, registry, separation
from sonaria.sources import wav

MEDIA = {".wav": "audio/wav", ".zip": "application/zip"}


def read_settings(text: str, into: dict[str, str] | None = None) -> dict[str, str]:
    """KEY=VALUE lines; blank lines and comments don't count, and what is already set stays."""
    out = {} if into is None else into
    for line in text.splitlines():
        line = line.strip()
        if line and not line.startswith("#") and "=" in line:
            k, v = line.split("=", 1)
            out.setdefault(k.strip(), v.strip().strip("\"'"))
    return out


@dataclass
class Service:
    """root: a folder that all executors see, for clips, cleaned tracks and the registry. mask: a noise mask for
    separation.clean, such as LogisticMask.numpy(); None keeps the sound as it is. calls: known calls (file, id,
    start_s, end_s), the recordings' annotations."""

    spark: SparkSession
    root: str
    mask: Callable | None = None
    calls: DataFrame | None = None
    registry: registry.Registry = field(init=False)

    def __post_init__(self) -> None:
        self.root = self.root.removeprefix("file://").rstrip("/")
        self.registry = registry.Registry(self.spark, f"file://{self.root}/registry")

    def health(self) -> dict:
        return {"status": "ok"}

    def clean(self, path: str) -> dict:
        """Clean and separate one sound file, register its clips, and say where everything is."""
        name = path.rsplit("/", 1)[-1]
        if not name.lower().endswith(".wav"):
            raise ValueError("a .wav file is needed")
        audio = wav.read_audio(self.spark, path)
        if audio.filter("size(samples) > 0").isEmpty():
            raise ValueError(f"{name} holds no sound that can be read")
        tracks = separation.separate(audio, self._calls()) if self.mask is None else separation.clean(audio, self.mask, self._calls())
        tracks = tracks.withColumn("sr", F.lit(wav.RATE)).persist()
        out = wav.write_audio(tracks.filter("samples is not null").withColumn("name", F.concat(F.regexp_replace("file", r"(?i)\.wav$", ""), F.lit("_"), registry.output_name("caller", "callers"))), f"{self.root}/cleaned").orderBy("name").collect()
        clips = separation.splice(tracks).persist()
        wav.write_audio(clips.withColumn("name", F.col("file_path")), f"{self.root}/clips").count()
        added = self.registry.register(clips.withColumn("file_path", F.concat(F.lit(f"file://{self.root}/clips/"), "file_path")))
        row = registry.payload(added.filter(F.col("parent_wav") == name).drop("created_at")).first()
        answer = json.loads(row.json) if row else {"parent_wav": name, "detected_callers": 0, "callers": [], "clip_count": 0}
        tracks.unpersist()
        clips.unpersist()
        return answer | {"download": self._bundle([r.path for r in out], name)}

    def _calls(self) -> DataFrame:
        return self.calls if self.calls is not None else self.spark.createDataFrame([], "file string, id long, start_s double, end_s double")

    def _bundle(self, paths: list[str], name: str) -> str:
        """The one track, or all in an archive."""
        if len(paths) == 1:
            return os.path.basename(paths[0])
        target = f"{os.path.splitext(name)[0]}_callers.zip"
        with zipfile.ZipFile(f"{self.root}/cleaned/{target}", "w") as z:
            for p in paths:
                z.write(p, os.path.basename(p))
        return target

    def registry_dump(self) -> dict:
        people, clips = self.registry.dump()
        return {"elephants": people.toPandas().to_dict("records"), "clips": clips.withColumn("created_at", F.col("created_at").cast("string")).toPandas().to_dict("records")}

    def rename(self, elephant_id: str, nickname: str) -> bool:
        if not elephant_id or not nickname or not nickname.strip():
            raise ValueError("an id and a name are needed")
        if not self.registry.rename(elephant_id, nickname.strip()):
            raise LookupError(f"there is no {elephant_id}")
        return True

    def clip_audio(self, clip_id: int) -> str:
        path = self.registry.clip_path(clip_id)
        if path is None:
            raise LookupError(f"there is no clip {clip_id}")
        return path.removeprefix("file://")

    def analyse(self, clip_ids: list[int] | None = None, ask=None) -> DataFrame:
        """clip_id, clip_type, features and analysis of clips; a clip whose file is gone has null samples and so is
        described as invalid."""
        clips = self.registry.read("clips")
        if clip_ids is not None:
            clips = clips.filter(F.col("clip_id").isin(clip_ids))
        name = F.substring_index("file_path", "/", -1)
        audio = wav.read_audio(self.spark, f"file://{self.root}/clips")
        j = clips.select("clip_id", "clip_type", name.alias("file")).join(audio, "file", "left")
        got = features.extract(j.select(F.col("clip_id").cast("string").alias("file"), "sr", "samples"))
        return features.describe(got.withColumn("clip_id", F.col("file").cast("long")).drop("file").join(clips.select("clip_id", "clip_type"), "clip_id"), ask)

    def analyse_clip(self, clip_id: int, ask=None) -> dict:
        self.clip_audio(clip_id)
        return self.analyse([clip_id], ask).first().asDict()

    def download(self, name: str) -> tuple[str, str]:
        """(path, media type) of a cleaned track or archive; nothing outside the folder."""
        folder = os.path.realpath(f"{self.root}/cleaned")
        path = os.path.realpath(f"{folder}/{name}")
        if os.path.commonpath([folder, path]) != folder or not os.path.isfile(path):
            raise LookupError(f"there is no {name}")
        return path, MEDIA.get(os.path.splitext(path)[1].lower(), "application/octet-stream")
