"""Run folders, packet tables and streams."""

import json

from pyspark.sql import functions as F

from faultline.plans import packet
from faultline.sources import ingest
from faultline.streaming import live

FILES = "repo_id string, rel string, size_bytes long, content string"
TRACE = 'Traceback (most recent call last):\n  File "lib.py", line 1, in f\nKeyError: 1\n'


def folder(base, name, **files):
    (base / name).mkdir()
    for file, text in files.items():
        (base / name / file.replace("_json", ".json")).write_bytes(text if isinstance(text, bytes) else text.encode())


def test_captured_runs(spark, tmp_path):
    run = {"repo_id": "r", "command": ["pytest", "-x"], "exit_code": 2, "cwd": "pkg", "captured_at": "2024-01-02T03:04:05Z"}
    git = {"root": "/repo", "branch": "main", "commit": "abc"}
    env = {"python": "3.13", "node": None, "platform": "linux", "machine": "x", "env": {"HOME": "/h", "API_KEY": "k"}}
    folder(tmp_path, "one", stdout=TRACE, stderr=b"bad \xff byte", run_json=json.dumps(run), git_json=json.dumps(git), status=" M lib.py\n?? new.py\n", diff="-a\n+b\n\n", names="lib.py\n", environment_json=json.dumps(env), other="ignored")
    folder(tmp_path, "two", stdout="plain")
    held = ingest.captured_runs(spark, str(tmp_path))
    rows = {r.stdout: r for r in held["runs"].collect()}
    one, two = rows[TRACE], rows["plain"]
    assert (one.repo_id, one.command, one.exit_code, one.stderr, one.cwd, one.root) == ("r", ["pytest", "-x"], 2, "bad \ufffd byte", "pkg", "/repo")
    assert (two.repo_id, two.command, two.exit_code, two.stderr, two.root) == ("", [], None, "", None)
    (g,) = held["git"].collect()
    assert (g.run_id, g.status, g.diff, g.diff_names) == (one.run_id, " M lib.py\n?? new.py", "-a\n+b", ["lib.py"])
    files = spark.createDataFrame([("r", "pkg/lib.py", 2, "x\n"), ("r", "lib.py", 2, "y\n")], FILES)
    built = packet.build(held["runs"].where("repo_id = 'r'"), files, git=held["git"], environment=held["environment"], created_at=F.col("captured_at"))
    (p,) = built["packets"].collect()
    document = json.loads(p.json)
    assert document["created_at"] == "2024-01-02T03:04:05+00:00" and document["git"]["changed_files"] == ["lib.py", "new.py"]
    assert document["environment"]["env_var_names"] == ["HOME"] and "API_KEY" not in p.json + p.markdown
    assert [f["path"] for f in document["files"]] == ["pkg/lib.py"]


def test_packets_of_a_stream(spark, tmp_path):
    files = spark.createDataFrame([("r", "lib.py", 2, "x\n")], FILES)
    runs = [{"run_id": n, "repo_id": "r", "command": ["x"], "exit_code": 1, "stdout": TRACE.replace("1", str(n), 1), "stderr": "", "cwd": ""} for n in range(3)]
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()

    def arrive(name, some):
        (source / name).write_text("".join(json.dumps(r) + "\n" for r in some))
        live.packets(spark, str(source), files, out, str(tmp_path / "checkpoint")).awaitTermination()
        return sorted((r.run_id, r.batch, r.json) for r in ingest.read_packets(spark, out).collect())

    first = arrive("a.json", runs[:2])
    assert [r[:2] for r in first] == [(0, 0), (1, 0)]
    both = arrive("b.json", [runs[2], {**runs[0], "exit_code": 7}])
    assert [r[:2] for r in both] == [(0, 1), (1, 0), (2, 1)] and json.loads(both[0][2])["exit_code"] == 7
    again = spark.createDataFrame([tuple(r[k] for k in ("run_id", "repo_id", "command", "exit_code", "stdout", "stderr", "cwd")) for r in runs[:2] + runs[:1]], ingest.RUNS)
    live.write_batch(again, 0, files, out)  # a replay, with a repeated row
    assert sorted((r.run_id, r.batch, r.json) for r in ingest.read_packets(spark, out).collect()) == both
    assert spark.read.parquet(f"{out}/files").where("batch = 0").count() == 2


def test_failures_of_a_stream(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.json").write_text(json.dumps({"run_id": 5, "stdout": TRACE, "stderr": None}) + "\n")
    query = live.failures(spark, str(source)).writeStream.format("memory").queryName("live_failures").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    query.awaitTermination()
    assert [tuple(r) for r in spark.table("live_failures").collect()] == [(5, "KeyError: 1")]
