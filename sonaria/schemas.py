"""Schemas of the tables the operators exchange, as DDL."""

SELECTIONS = "Selection INT, Sound_file STRING, Start_time DOUBLE, End_time DOUBLE, Call_type STRING"
PREDICTIONS = SELECTIONS + ", Confidence DOUBLE, Median_F0_Hz DOUBLE"
ANNOTATIONS = "file STRING, id BIGINT, start_s DOUBLE, end_s DOUBLE, low_hz DOUBLE, high_hz DOUBLE"
AUDIO = "file STRING, sr INT, samples ARRAY<FLOAT>"
SPECTRA = "file STRING, frame INT, re ARRAY<FLOAT>, im ARRAY<FLOAT>"
FRAMES = "file STRING, frame INT, vprob DOUBLE, f0 DOUBLE"
INDIVIDUALS = "elephant_id STRING, nickname STRING"
CLIPS = "clip_id BIGINT, file_path STRING, parent_wav STRING, elephant_id STRING, start_time DOUBLE, end_time DOUBLE, clip_type STRING, human_label STRING, created_at TIMESTAMP"
