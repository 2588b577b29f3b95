"""Scans that split one file over many tasks, and appends that survive the job."""

import json
import os
import random
import subprocess
import sys

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siftwell.sources import arrow_files as A
from siftwell.sources import records as R

# --- Arrow files


def arrow_file(path, batches, stream, compression=None):
    options = pa.ipc.IpcWriteOptions(compression=compression, emit_dictionary_deltas=True)
    make = pa.ipc.new_stream if stream else pa.ipc.new_file
    with pa.OSFile(str(path), "wb") as out, make(out, batches[0].schema, options=options) as w:
        for b in batches:
            w.write_batch(b)
    return str(path)


def batch(i, n=50):
    rnd = random.Random(i)
    words = [f"w{rnd.randrange(10 * (i + 1))}" for _ in range(n)]
    return pa.RecordBatch.from_pydict(
        {"id": pa.array(range(i * n, (i + 1) * n), pa.int32()), "text": pa.array([None if j % 7 == 0 else f"text {j}" for j in range(n)], pa.large_string()), "word": pa.array(words), "v": pa.array([[float(j)] * (j % 3) for j in range(n)])}
    )


@pytest.mark.parametrize("stream", [True, False])
@pytest.mark.parametrize("compression", [None, "zstd"])
def test_arrow_batches_are_dealt_to_tasks(spark, tmp_path, stream, compression):
    batches = [batch(i) for i in range(20)]
    path = arrow_file(tmp_path / "a.arrow", batches, stream, compression)
    size = os.path.getsize(path)
    df = R.read_arrow(spark, path, "v array<double>, id bigint, text string, word string", range_bytes=size // 6)
    want = [r for b in batches for r in b.to_pylist()]
    got = df.select("id", "text", "word", "v", F.spark_partition_id().alias("p")).collect()
    assert sorted(((r.id, r.text, r.word, tuple(r.v)) for r in got)) == sorted((r["id"], r["text"], r["word"], tuple(r["v"])) for r in want)
    assert len({r.p for r in got}) >= 5
    for parts in (1, 3, 50):
        ids = [x for k in range(parts) for b in A.read_range(path, k, parts, ["id"]) for x in b.column("id").to_pylist()]
        assert ids == list(range(1000))


@pytest.mark.parametrize("stream", [True, False])
def test_arrow_dictionaries_that_grow(spark, tmp_path, stream):
    """Each task needs all dictionary messages in front of its batches, deltas too."""
    words = [f"word{i}" for i in range(200)]
    batches = [pa.RecordBatch.from_arrays([pa.array(range(b * 10, b * 10 + 10), pa.int64()), pa.DictionaryArray.from_arrays(pa.array(range(10), pa.int32()) if not b else pa.array([b * 10 + j for j in range(10)], pa.int32()), pa.array(words[: b * 10 + 10]))], names=["id", "word"]) for b in range(20)]
    path = arrow_file(tmp_path / "d.arrow", batches, stream)
    got = R.read_arrow(spark, path, "word string, id bigint", range_bytes=os.path.getsize(path) // 7)
    assert sorted(map(tuple, got.select("id", "word").collect())) == [(i, words[i]) for i in range(200)]


def test_arrow_reads_only_named_columns_and_the_tasks_own_bodies(tmp_path):
    batches = [batch(i) for i in range(20)]
    path = arrow_file(tmp_path / "a.arrow", batches, True)

    class Counting:
        def __init__(self, f):
            self.f, self.n = f, 0

        def read(self, n):
            out = self.f.read(n)
            self.n += len(out)
            return out

        def __getattr__(self, name):
            return getattr(self.f, name)

    counted = Counting(pa.OSFile(path))
    found = list(A.messages(counted, os.path.getsize(path)))
    assert [k for k, *_ in found] == [1] + [3] * 20
    assert counted.n < os.path.getsize(path) / 2
    got = list(A.read_range(path, 0, 4, ["word"]))
    assert 4 <= len(got) <= 6 and got[0].schema.names == ["word"]


def test_arrow_files_that_are_empty_cut_off_or_lack_a_column(spark, tmp_path):
    for stream in (True, False):
        with pa.OSFile(str(tmp_path / f"none{stream}.arrow"), "wb") as out, (pa.ipc.new_stream if stream else pa.ipc.new_file)(out, batch(0).schema):
            pass
    (tmp_path / "zero.arrow").write_bytes(b"")
    assert R.read_arrow(spark, f"{tmp_path}/*.arrow", "id int").count() == 0
    assert R.read_arrow(spark, f"{tmp_path}/zero.arrow", "id int").count() == 0
    path = arrow_file(tmp_path / "ok.arrow", [batch(i) for i in range(3)], True)
    with pytest.raises(Exception, match="none of"):
        R.read_arrow(spark, path, "other string").count()
    data = open(path, "rb").read()
    (tmp_path / "cut.arrow").write_bytes(data[: len(data) * 2 // 3])
    with pytest.raises(Exception, match="ends within"):
        R.read_arrow(spark, f"{tmp_path}/cut.arrow", "id int").count()


def test_arrow_format_by_name(spark, tmp_path):
    arrow_file(tmp_path / "a.arrow", [batch(0), batch(1)], True)
    arrow_file(tmp_path / "b.arrow", [batch(2)], False)
    spark.dataSource.register(A.ArrowFiles)
    df = spark.read.format("arrow_files").schema("id int").load(str(tmp_path))
    assert sorted(r.id for r in df.collect()) == list(range(150))
    with pytest.raises(Exception, match="schema"):
        spark.read.format("arrow_files").load(str(tmp_path))


# --- JSON documents

STRINGS = ['plain', '[{"', '\\', '\\\\', '\\"', '"', '}]', 'ünï 漢字 \U0001f600', '', 'a\\\\"b', '\n\t', '{"images":[{"id":99}]}', '\\' * 9, '\\' * 40]


def document(seed, n=120):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice(STRINGS) for _ in range(rnd.randint(0, 3)))
    rows = [{"id": i, "name": word(), "box": [rnd.random(), {"deep": [word(), [], {}]}], **({word() or "k": word()} if rnd.random() < 0.3 else {})} for i in range(n)]
    return {"info": {"images": [{"id": -1}], word() or "x": word()}, "images": rows[: n // 2], word() or "y": [1, "[", [2], None], "empty": [], "an\"n\\": rows[n // 2 :], "last": word()}


def batch_of(**columns):
    return pa.RecordBatch.from_pydict(columns)


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("size", [1, 7, 64, 999])
def test_ranges_start_anywhere(tmp_path, seed, size):
    """The passes over ranges as a plain loop, so that ranges can be a byte long."""
    from siftwell.sources import json_arrays as J

    doc = document(seed, 40)
    path = tmp_path / "d.json"
    path.write_text(json.dumps(doc, ensure_ascii=seed % 2 == 0, indent=[None, 1, None, 4][seed]))
    n = path.stat().st_size
    at = list(range(0, n, size))
    sums = [r for b in J._summed([batch_of(path=[str(path)] * len(at), nth=range(len(at)), low=at, high=[min(n, x + size) for x in at])]) for r in b.to_pylist()]
    quotes, depth, states = 0, 0, []
    for r in sums:
        states.append((r["start"], r["end"], quotes % 2 == 1, depth))
        depth += r["odd" if quotes % 2 else "even"]
        quotes += r["quotes"]
    assert depth == 0 and quotes % 2 == 0 and "".join(path.read_bytes()[s:e].decode("latin1") for s, e, *_ in states) == path.read_bytes().decode("latin1")
    marks = [r for b in J._bounds([batch_of(path=[str(path)] * len(states), **{c: [x[i] for x in states] for i, c in enumerate(("start", "end", "in_string", "depth"))})]) for r in b.to_pylist()]
    marks.sort(key=lambda r: r["at"])
    found = {o["key"]: (o["at"], c["at"]) for o, c in zip(marks[::2], marks[1::2])}
    assert set(found) == {k for k, v in doc.items() if isinstance(v, list)}
    import pyarrow.fs

    with pyarrow.fs.LocalFileSystem().open_input_file(str(path)) as file:
        for key, (low, high) in found.items():
            got = [json.loads(text) for s, e, inside, deep in states for _, text in J.objects(file, s, e, inside, deep, 2, low, high, step=max(size, 5))]
            assert got == [x for x in doc[key] if isinstance(x, dict)]


@pytest.mark.parametrize("seed", [0, 2])
def test_a_json_document_equals_a_parser(spark, tmp_path, seed):
    from siftwell.sources import json_arrays as J

    doc = document(seed)
    path = tmp_path / "d.json"
    path.write_bytes((b"\xef\xbb\xbf" if seed == 2 else b"") + json.dumps(doc, ensure_ascii=False).encode())
    read = J.JsonDocument(spark, str(path), path.stat().st_size // 5)
    assert read.keys() == {k for k, v in doc.items() if isinstance(v, list)}
    for key in ("images", 'an"n\\', "empty"):
        got = read.rows(key, "id bigint, name string, box array<string>", place=True).orderBy("at").collect()
        assert [(r.id, r.name) for r in got] == [(x["id"], x["name"]) for x in doc[key]]
        assert [json.loads(r.box[1]) for r in got] == [x["box"][1] for x in doc[key]]
    assert read.rows("images", "id bigint").select(F.spark_partition_id()).distinct().count() > 1


def test_json_lists_and_other_documents(spark, tmp_path):
    from siftwell.sources import json_arrays as J

    rows = [{"k": i, "name": random.Random(i).choice(STRINGS)} for i in range(50)]
    (tmp_path / "list.json").write_text(" \n" + json.dumps(rows))
    (tmp_path / "data.json").write_text(json.dumps({"version": "[", "data": rows}))
    (tmp_path / "other.json").write_text(json.dumps({"rows": rows}))
    (tmp_path / "cut.json").write_text(json.dumps(rows)[:-40])
    (tmp_path / "none.json").write_text("")
    for name in ("list", "data"):
        assert sorted((r.k, r.name) for r in R.read_json_any(spark, f"{tmp_path}/{name}.json", "k int, name string").collect()) == [(r["k"], r["name"]) for r in rows]
    for name in ("other", "none"):
        with pytest.raises(ValueError, match="neither"):
            R.read_json_any(spark, f"{tmp_path}/{name}.json", "k int")
    with pytest.raises(Exception, match="ends within"):
        R.read_json_any(spark, f"{tmp_path}/cut.json", "k int").count()
    (tmp_path / "more").mkdir()
    for i in range(3):
        (tmp_path / "more" / f"{i}.json").write_text(json.dumps({"images": rows[i * 10 : i * 10 + 10]}))
    both = J.JsonDocument(spark, str(tmp_path / "more"), 64)
    assert sorted(r.k for r in both.rows("images", "k int").collect()) == list(range(30))
    assert both.rows("absent", "k int").count() == 0


# --- appends


def noting(calls, dies_at=None):
    """A record of a sample; each call is noted. The worker dies at some samples, once each."""

    def fn(sample):
        i = sample["id"]
        if dies_at and i in dies_at and not os.path.exists(f"{calls}-{i}"):
            open(f"{calls}-{i}", "w").close()
            os._exit(9)
        with open(calls, "a") as f:
            f.write(f"{i}\n")
        return {"id": i, "name": sample["name"], "n": len(sample["name"])}

    return fn


def samples(spark, n=400):
    return spark.createDataFrame([(i, f"näme {i}\n") for i in range(n)], "id bigint, name string").repartition(4, "id")


FIELDS = "id bigint, name string, n bigint"


def test_a_job_that_dies_is_resumed(spark, tmp_path):
    from siftwell.sources import appends as P

    path, calls = str(tmp_path / "out"), str(tmp_path / "calls")
    with pytest.raises(Exception, match="(?i)crash|exit|abort"):
        P.append_jsonl(samples(spark), path, "id", noting(calls, {130, 131, 132, 133, 134, 135}), flush=1)
    before = open(calls).read().split()
    assert P.read_appended(spark, path, FIELDS).count() == 0  # nothing counts before the next job has taken it over
    with pytest.raises(Exception, match="(?i)crash|exit|abort"):  # dies again elsewhere
        P.append_jsonl(samples(spark), path, "id", noting(calls, {300, 301, 302, 303, 304, 305}), flush=1)
    assert P.append_jsonl(samples(spark), path, "id", noting(calls), flush=1) == 1
    got = P.read_appended(spark, path, FIELDS).collect()
    assert sorted(map(tuple, got)) == [(i, f"näme {i}\n", len(f"näme {i}\n")) for i in range(400)]
    made = open(calls).read().split()
    assert 0 < len(before) < 400 and len(made) <= 400 + 8  # no more than a line in flight for each task that died
    more = spark.createDataFrame([(5, "again"), (1000, "new")], "id bigint, name string")
    assert P.append_jsonl(more, path, "id", noting(calls)) == 0
    assert sorted(r.id for r in P.read_appended(spark, path, FIELDS).collect()) == [*range(400), 1000]


RETRY = """
import sys
sys.path.insert(0, {root!r})
from siftwell.session import build_session
from siftwell.sources import appends as P
from tests.test_sources import FIELDS, noting
spark = build_session("local[2,4]", 2, **{{"spark.ui.showConsoleProgress": "false"}})
rows = spark.createDataFrame([(i, f"name {{i}}") for i in range(300)], "id bigint, name string").repartition(3, "id")
P.append_jsonl(rows, {path!r}, "id", noting({calls!r}, {{50, 120, 200}}), flush=1)
got = sorted(r.id for r in P.read_appended(spark, {path!r}, FIELDS).collect())
print("GOT", got == list(range(300)))
"""


def test_a_task_that_dies_goes_on(tmp_path):
    """Within a job, the next attempt takes over what the last one flushed."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path, calls = str(tmp_path / "out"), str(tmp_path / "calls")
    ran = subprocess.run([sys.executable, "-c", RETRY.format(root=root, path=path, calls=calls)], capture_output=True, text=True, timeout=200, cwd=root)
    assert "GOT True" in ran.stdout, ran.stderr[-2000:]
    made = open(calls).read().split()
    assert len(made) == 300 and len(set(made)) == 300
    assert len([f for f in os.listdir(f"{path}/data/{os.listdir(path + '/data')[0]}") if f.endswith(".jsonl")]) > 3


def test_marks_cut_what_a_lost_attempt_wrote_later(spark, tmp_path):
    from siftwell.sources import appends as P

    folder = tmp_path / "data" / "job"
    folder.mkdir(parents=True)
    (folder / "00000-3.from").write_text("[]")
    (folder / "00000-3.jsonl").write_text('{"id":1}\n{"id":2}\n{"id":3}\n')
    (folder / "00000-7.from").write_text('[["data/job/00000-3.jsonl", 18]]')  # taken over before the third line was there
    (folder / "00000-7.jsonl").write_text('{"id":3,"name":"own"}\n{"id":4}\n{"id":5, "na')
    (folder / "00001-4.from").write_text("[]")
    (folder / "00002-5.jsonl").write_text("")
    assert P.recover(spark, str(tmp_path)) == 1 and P.recover(spark, str(tmp_path)) == 0
    got = sorted((r.id, r.name) for r in P.read_appended(spark, str(tmp_path), FIELDS).collect())
    assert got == [(1, None), (2, None), (3, "own"), (4, None)]
    with open(folder / "00000-7.jsonl", "a") as f:
        f.write('me":"late"}\n')
    assert sorted(r.id for r in P.read_appended(spark, str(tmp_path), FIELDS).collect()) == [1, 2, 3, 4]


def test_append_rows_as_they_are_and_without_a_key(spark, tmp_path):
    from siftwell.sources import appends as P

    path = str(tmp_path / "out")
    rows = spark.createDataFrame([("a", 1, [1.0, None]), ("b", None, None)], "id string, n bigint, v array<double>")
    assert P.append_jsonl(rows, path, "id") == 0
    assert P.append_jsonl(rows.limit(0), path, "id") == 0
    assert sorted(map(tuple, P.read_appended(spark, path, "id string, n bigint, v array<double>").collect())) == [("a", 1, [1.0, None]), ("b", None, None)]
    with pytest.raises(Exception, match="without id"):
        P.append_jsonl(rows.withColumn("id", F.lit(None).cast("string")), path, "id")
