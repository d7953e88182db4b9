import os

import numpy as np
import pytest

from sonaria import session as session_module
from sonaria.operators.registry import Registry
from sonaria.sources import annotations as an
from sonaria.sources import wav
from sonaria.streaming import windows


def write(path, text):
    path.write_text(text)
    return str(path)


def test_annotation_sheets(spark, tmp_path):
    want = [("x.wav", 1.0, 2.0, None), ("y.wav", 3.0, 4.5, 12.0)]
    sheets = {
        "a.csv": "Begin File,Begin Time (s),END TIME (s),Low Freq (Hz)\n /d/x.wav ,1,2,\ny.wav,3,4.5,12\n",
        "b.txt": "Sound_file\tStart_time\tEnd_time\tlow_hz\nx.wav\t1\t2\tnan\ny.wav\t3\t4.5\t12\n",
        "c.csv": "file_name\tstart\tend\tlow_freq\nx.wav\t1\t2\t\ny.wav\t3\t4.5\t12\n",
    }
    for name, text in sheets.items():
        df = an.read_annotations(spark, write(tmp_path / name, text))
        assert [(r.file, r.start_s, r.end_s, r.low_hz) for r in df.orderBy("id").collect()] == want
    with pytest.raises(KeyError):
        an.read_annotations(spark, write(tmp_path / "d.csv", "file,begin\nx,1\n"))
    (tmp_path / "venv").mkdir()
    write(tmp_path / "venv" / "0.csv", "a\n1\n")
    write(tmp_path / "predictions.csv", "a\n1\n")
    assert an.discover(spark, str(tmp_path)).endswith("/a.csv")


def test_selection_round_trip(spark, tmp_path):
    rows = [("b.wav", 2.0, 3.0, "rumble", 0.51239, 20.456), ("a.wav", 5.0, 6.0, "rumble", 0.5, 20.0), ("a.wav", 1.0, 2.0, "rumble", 0.9, 11.0)]
    t = an.selection_table(spark.createDataFrame(rows, "file string, start_s double, end_s double, call_type string, confidence double, median_f0_hz double"))
    an.write_selections(t, f"{tmp_path}/p")
    back = an.read_selections(spark, f"{tmp_path}/p").orderBy("Selection").collect()
    assert [(r.Selection, r.Sound_file, r.Start_time) for r in back] == [(1, "a.wav", 1.0), (2, "a.wav", 5.0), (3, "b.wav", 2.0)]
    assert t.filter("Selection = 3").first().Confidence == 0.5124
    assert an.selection_table(spark.createDataFrame([], "file string, start_s double, end_s double, call_type string, confidence double, median_f0_hz double")).count() == 0


def test_sound_files(spark, tmp_path):
    y = np.sin(2 * np.pi * 25 * np.arange(8000) / 8000) * 0.5
    (tmp_path / "a.WAV").write_bytes(wav.encode(y, 8000))
    (tmp_path / "b.wav").write_bytes(wav.encode(y[:4000], 4000))
    (tmp_path / "bad.wav").write_bytes(b"RIFFnothing")
    got = {r.file: r for r in wav.read_audio(spark, str(tmp_path)).collect()}
    assert got["a.WAV"].sr == 4000 and len(got["a.WAV"].samples) == 4000 and got["bad.wav"].samples is None
    assert np.abs(np.array(got["a.WAV"].samples)[100:-100] - (np.sin(2 * np.pi * 25 * np.arange(4000) / 4000) * 0.5)[100:-100]).max() < 0.01
    assert {r.file: r.duration for r in wav.durations(spark, str(tmp_path)).collect()} == {"a.WAV": 1.0, "b.wav": 1.0}
    spark.dataSource.register(wav.WavDataSource)
    assert sorted(r.file for r in spark.read.format("wav").load(str(tmp_path)).collect()) == ["a.WAV", "b.wav"]
    out = wav.write_audio(spark.createDataFrame([("n.wav", 4000, y.tolist())], "name string, sr int, samples array<float>"), f"{tmp_path}/out").collect()
    assert out[0].n_samples == 8000 and wav.header((tmp_path / "out" / "n.wav").read_bytes()) == (4000, 2.0)


def test_registry(spark, tmp_path):
    r = Registry(spark, f"file://{tmp_path}/reg")
    assert r.dump()[0].count() == 0
    schema = "parent_wav string, elephant_id string, file_path string, start_time double, end_time double, clip_type string"
    clip = tmp_path / "clip.wav"
    clip.write_bytes(b"x")
    a = r.register(spark.createDataFrame([("p.wav", "Elephant_A", f"file://{clip}", 2.0, 4.0, "rumble"), ("p.wav", "Elephant_A", "file:///nowhere", 6.0, 8.0, "rumble")], schema))
    assert [(x.clip_id, x.start_time) for x in a.orderBy("clip_id").collect()] == [(1, 2.0), (2, 6.0)]
    b = r.register(spark.createDataFrame([("q.wav", "Elephant_B", "z", 0.0, 1.0, "rumble"), ("q.wav", "Elephant_A", "z", 0.0, 1.0, "rumble")], schema))
    assert sorted((x.clip_id, x.elephant_id) for x in b.collect()) == [(3, "Elephant_A"), (4, "Elephant_B")]
    assert [x.elephant_id for x in r.dump()[0].collect()] == ["Elephant_A", "Elephant_B"] and r.dump()[1].count() == 4
    assert r.rename("Elephant_A", "Ann") and not r.rename("Elephant_Z", "Zoe")
    assert r.dump()[0].first().nickname == "Ann"
    assert [x.clip_id for x in r.for_parent("p.wav").collect()] == [1, 2]
    assert r.clip_path(1) == f"file://{clip}" and r.clip_path(2) is None and r.clip_path(99) is None


def run_stream(spark, out, mode="append"):
    q = out.writeStream.outputMode(mode).format("memory").queryName("streamed").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return spark.table("streamed")


def test_stream_of_sessions(spark, tmp_path):
    rows = [("f", "2024-01-01 00:00:00", 1.0), ("f", "2024-01-01 00:00:02", 2.0), ("f", "2024-01-01 00:00:09", 4.0), ("g", "2024-01-01 00:00:01", 8.0), ("f", "2024-01-01 09:00:00", 0.0)]
    df = spark.createDataFrame(rows, "file string, t string, value double").selectExpr("file", "cast(t as timestamp) as ts", "value")
    df.coalesce(1).write.parquet(f"{tmp_path}/e")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/e")
    got = run_stream(spark, windows.sessions(stream, "3 seconds"))
    batch = windows.sessions(df, "3 seconds").filter("start < '2024-01-01 08:00:00'")
    key = lambda t: sorted((x.file, str(x.start), x.n, x.value) for x in t.collect())
    assert key(got) == key(batch) and len(key(got)) == 3
    rms = run_stream(spark, windows.tumbling_rms(stream, "5 seconds"))
    assert {(x.file, round(x.rms, 6)) for x in rms.collect()} >= {("f", round(2.5**0.5, 6)), ("f", 4.0), ("g", 8.0)}
    assert run_stream(spark, windows.sliding_std(stream, "4 seconds", "2 seconds")).count() > 0


def test_stream_of_overlap_groups(spark, tmp_path):
    rows = [("f", "2024-01-01 00:00:00", 0.0, 4.0), ("f", "2024-01-01 00:00:01", 3.0, 6.0), ("f", "2024-01-01 00:00:02", 5.0, 8.0), ("f", "2024-01-01 00:00:03", 9.0, 10.0), ("f", "2024-01-01 00:00:04", 11.0, 12.0)]
    df = spark.createDataFrame(rows, "file string, t string, start_s double, end_s double").selectExpr("file", "cast(t as timestamp) as ts", "start_s", "end_s")
    df.coalesce(1).write.parquet(f"{tmp_path}/e")
    got = run_stream(spark, windows.overlap_groups(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/e"))).collect()
    assert [tuple(x) for x in got] == [("f", 0.0, 8.0, 3)]


def test_stream_of_overlap_groups_out_of_order(spark, tmp_path):
    base = 1_704_067_200.0
    loads = [[(10, 20), (40, 45)], [(0, 1), (18, 30), (44, 50)], [(29, 31), (2, 3), (9, 11)], [(90_000, 90_001)], [(200_000, 200_001)]]
    for k, load in enumerate(loads):
        rows = [("f", base + a, base + b) for a, b in load]
        df = spark.createDataFrame(rows, "file string, start_s double, end_s double").selectExpr("file", "timestamp_micros(bigint(start_s * 1000000)) as ts", "start_s", "end_s")
        df.coalesce(1).write.parquet(f"{tmp_path}/e/{k}")
        os.utime([x for x in (tmp_path / "e" / str(k)).iterdir() if x.suffix == ".parquet"][0], (1e9 + k * 10, 1e9 + k * 10))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/e/*")
    got = run_stream(spark, windows.overlap_groups(stream, "10 minutes")).collect()
    assert sorted((x.group_start - base, x.group_end - base, x.group_size) for x in got) == [(9, 31, 4), (40, 50, 2)]


def test_uploads(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.wav").write_bytes(wav.encode(np.zeros(400), 4000))
    (tmp_path / "in" / "b.txt").write_text("no")
    seen = []
    windows.register_uploads(wav.uploads(spark, f"{tmp_path}/in"), lambda df, epoch: seen.extend(r.path.rsplit("/", 1)[1] for r in df.collect()), f"{tmp_path}/cp").awaitTermination()
    assert seen == ["a.wav"]


def test_workbook(spark, tmp_path):
    import zipfile

    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    strings = ["Begin File", "Begin Time (s)", "End Time (s)", "a & b.wav"]
    cell = [["<c r='A1' t='s'><v>0</v></c>", "<c r='C1' t='s'><v>1</v></c>", "<c r='D1' t='s'><v>2</v></c>"], ["<c r='A2' t='s'><v>3</v></c>", "<c r='C2'><v>1.5</v></c>", "<c r='D2'><v>2</v></c>"], ["<c r='A3' t='inlineStr'><is><t>c.wav</t></is></c>", "<c r='C3'><v>3</v></c>"]]
    with zipfile.ZipFile(tmp_path / "s.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f"<workbook xmlns='{main}' xmlns:r='{rel}'><sheets><sheet name='x' sheetId='1' r:id='rId1'/></sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships xmlns='http://schemas.openxmlformats.org/package/2006/relationships'><Relationship Id='rId1' Target='worksheets/sheet1.xml'/></Relationships>")
        z.writestr("xl/sharedStrings.xml", f"<sst xmlns='{main}'>" + "".join(f"<si><t>{s.replace('&', '&amp;')}</t></si>" for s in strings) + "</sst>")
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet xmlns='{main}'><sheetData>" + "".join(f"<row>{''.join(r)}</row>" for r in cell) + "</sheetData></worksheet>")
    got = an.read_annotations(spark, f"file://{tmp_path}/s.xlsx").collect()
    assert [(x.file, x.start_s, x.end_s) for x in got] == [("a & b.wav", 1.5, 2.0)]


def test_text_from_a_service():
    import http.server
    import json
    import threading

    import pandas as pd

    from sonaria.sources import text

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            said = {"choices": [{"message": {"content": f" {asked['messages'][0]['content']}! "}}]} if asked["messages"][0]["content"] != "bad" else {"choices": []}
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps(said).encode())

        def log_message(self, *args):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        ask = text.asker(f"http://127.0.0.1:{server.server_port}/", "m", "k", 5)
        assert ask(pd.Series(["a", "bad"], index=[4, 7])).to_dict() == {4: "a!", 7: None}
    finally:
        server.shutdown()
        server.server_close()
    assert text.asker("http://127.0.0.1:9/", "m", timeout=1)(pd.Series(["a"])).tolist() == [None]


def test_session_settings():
    assert session_module.DEFAULTS["spark.sql.session.timeZone"] == "UTC"
