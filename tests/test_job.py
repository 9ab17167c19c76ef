"""Jobs: the textual form, checks, and whole runs."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weftflow.operators import mapping, reducing, registry
from weftflow.plans import job
from weftflow.sources import formats, records
from weftflow.streaming.incremental import fold_stream


@registry.mapper("Tokens")
class Tokens(mapping.Mapper):
    def map(self, key, value):
        for word in (value if isinstance(value, str) else value.decode()).split():
            self.output(word if isinstance(value, str) else word.encode(), "1" if isinstance(value, str) else b"1")


@registry.mapper("Lengths")
class Lengths(mapping.Mapper):
    def map(self, key, value):
        self.output(str(len(value)), value)


@registry.batch_reducer("Totals")
class Totals(reducing.BatchReducer):
    def reduce(self, key, values):
        n = sum(map(int, values))
        self.output(key, f"{key} {n}" if isinstance(key, str) else key + b" %d" % n)


@registry.batch_reducer("Copies")
class Copies(reducing.BatchReducer):
    def reduce(self, key, values):
        for value in values:
            self.output(key, value)


@registry.incremental_reducer("Totals")
class TotalsFold(reducing.IncrementalReducer):
    def begin_reduce(self, key, value):
        return int(value)

    def partial_reduce(self, key, value, state):
        return state + int(value)

    def end_reduce(self, key, state):
        self.output(key, f"{key} {state}")


NAME = st.text("abcdefghijklmnopqrstuvwxyz0123456789-", min_size=1, max_size=8)
CLASS = st.text("ABCXYZabcxyz", min_size=1, max_size=6)
PATH = NAME.map(lambda s: f"/{s}/part-*")
FORMAT = st.sampled_from(["text", "recordio", "protofile"])
BLANK = st.sampled_from(["", " ", "  "])


@st.composite
def tasks(draw, fields):
    """The text of a list of tasks, with blanks where they don't matter, and what it should be read as."""
    text, expected = [], []
    for _ in range(draw(st.integers(1, 3))):
        machines = draw(st.lists(NAME, min_size=1, max_size=3))
        values = [draw({"class": CLASS, "input_format": FORMAT, "output_format": FORMAT}.get(field, PATH)) for field in fields]
        spelled = "{" + ",".join(draw(BLANK) + m + draw(BLANK) for m in machines) + "}"
        text.append(draw(BLANK) + ":".join([spelled, *(draw(BLANK) + v + draw(BLANK) for v in values)]))
        expected += [dict(zip(fields, values)) | {"machine": m} for m in machines]
    return ";".join(text), expected


def as_read(found):
    return [{k: v for k, v in task.items() if v is not None} for task in found]


@settings(max_examples=60, deadline=None)
@given(tasks(job.MAP_FIELDS), tasks(job.REDUCE_FIELDS), st.booleans(), st.booleans())
def test_tasks_are_read_as_written(maps, reduces, incremental, mkdir):
    switches = ["--mapreduce_incremental_mode"] * incremental + ["--mapreduce_force_mkdir"] * mkdir
    options = job.parse([f"--mapreduce_map_io={maps[0]}", f"--mapreduce_reduce_io={reduces[0]}", *switches])
    assert as_read(options.map_tasks) == maps[1] and as_read(options.reduce_tasks) == reduces[1]
    assert options.machines == {t["machine"] for t in maps[1] + reduces[1]}
    assert (options.incremental, options.force_mkdir) == (incremental, mkdir)
    assert all(set(t) == set(job.TASK) for t in options.map_tasks + options.reduce_tasks)


@settings(max_examples=30, deadline=None)
@given(tasks(job.MAP_ONLY_FIELDS))
def test_map_only_tasks_are_read_as_written(maps):
    options = job.parse([f"--mapreduce_maponly_map_io={maps[0]}"])
    assert as_read(options.map_tasks) == maps[1] and options.reduce_tasks == []


def test_folders_by_machine_and_commands():
    maps = "--mapreduce_map_io={left,right}:Tokens:text:/logs/day-?:/none"
    reduces = "--mapreduce_reduce_io={right}:Totals:/none:text:/sums,/rest"
    options = job.parse([maps, reduces, "--mapreduce_tmp_dir={left}/scratch/a/;{right}/scratch/b", "--mapreduce_log_filebase={left,right}/var/log/job", "--mapreduce_cmd=bin/count 'two words' --mr_max_input_line_length=64"])
    assert [t["tmp_dir"] for t in options.map_tasks] == ["/scratch/a", "/scratch/b"] and options.reduce_tasks[0]["log_filebase"] == "/var/log/job"
    assert (options.command, options.arguments, options.max_line) == ("bin/count", ["two words", "--mr_max_input_line_length=64"], 64)
    made = options.job()
    assert made.maps == (job.MapTask("Tokens", "/logs/day-?", "text"),)  # machines don't multiply the input
    assert made.reduces == (job.ReduceTask("Totals", ("/sums", "/rest"), "text"),) and made.max_line == 64 and not made.force_mkdir
    assert job.parse([maps, reduces]).command is None and job.parse([maps, reduces]).max_line is None


@pytest.mark.parametrize(
    "arguments",
    [
        ["--mapreduce_map_io={a}:Tokens:text:/i:/o"],
        ["--mapreduce_reduce_io={a}:Totals:/i:text:/o"],
        ["--mapreduce_unheard_of=1"],
        ["--mapreduce_maponly_map_io={a}:Tokens:text:/i"],
        ["--mapreduce_maponly_map_io=a:Tokens:text:/i:text:/o"],
        ["--mapreduce_maponly_map_io={ , }:Tokens:text:/i:text:/o"],
        ["--mapreduce_maponly_map_io={a}:Tokens:text:/i:text:/o", "--mapreduce_map_io={a}:Tokens:text:/i:/o"],
        ["--mapreduce_maponly_map_io={a}:Tokens:text:/i:text:/o", "--mapreduce_tmp_dir=/x"],
    ],
)
def test_parse_errors(arguments):
    with pytest.raises(ValueError):
        job.parse(arguments)


def test_checks(spark, tmp_path):
    good, sums = job.MapTask("Tokens", "/x"), job.ReduceTask("Totals", ("/y",))
    for maps, reduces, error, more in (
        ((job.MapTask("Nobody", "/x"),), (sums,), KeyError, {}),
        ((good,), (job.ReduceTask("Copies", ("/y",)),), KeyError, {"incremental": True}),
        ((job.MapTask("Tokens", "/x", "csv"),), (sums,), KeyError, {}),
        ((good,), (), ValueError, {}),
        ((good,), (job.ReduceTask("Totals", ()),), ValueError, {}),
        ((), (), ValueError, {}),
    ):
        with pytest.raises(error):
            job.Job(maps, reduces, **more)
    with pytest.raises(FileNotFoundError):
        job.run(spark, job.Job((job.MapTask("Tokens", f"{tmp_path}/none"),), (sums,)))
    (tmp_path / "in").write_text("a b\n")
    deep = job.ReduceTask("Totals", (f"{tmp_path}/deep/er/out",))
    with pytest.raises(FileNotFoundError):
        job.run(spark, job.Job((job.MapTask("Tokens", f"{tmp_path}/in"),), (deep,), force_mkdir=False))
    job.run(spark, job.Job((job.MapTask("Tokens", f"{tmp_path}/in"),), (deep,)))
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/deep/er/out").collect()) == ["a 1", "b 1"]


@pytest.fixture
def inputs(tmp_path):
    rng = random.Random(6)
    lines = [" ".join(rng.choices("north south east west up down".split(), k=rng.randrange(6))) for _ in range(40)]
    (tmp_path / "in-a").write_text("".join(f"{line}\n" for line in lines[:25]))
    (tmp_path / "in-b").write_text("".join(f"{line}\n" for line in lines[25:]))
    (tmp_path / "in-c").write_text("")
    counts = {}
    for line in lines:
        for word in line.split():
            counts[word] = counts.get(word, 0) + 1
    return tmp_path, lines, counts


@pytest.mark.parametrize("switch", [[], ["--mapreduce_incremental_mode"]])
def test_run_text_job(spark, inputs, switch):
    folder, lines, counts = inputs
    options = job.parse([f"--mapreduce_map_io={{one}}:Tokens:text:{folder}/in-*:/none", f"--mapreduce_reduce_io={{one,two}}:Totals:/none:text:{folder}/out", *switch])
    counters = job.run(spark, options.job())
    assert sorted(r.value for r in spark.read.text(f"{folder}/out").collect()) == sorted(f"{w} {n}" for w, n in counts.items())
    words = sum(counts.values())
    assert counters == {"map_input_0": 40, "input_shards_0": 3, "map_output_0": words, "reduce_keys": len(counts), "reduce_output": len(counts)}


def test_equal_tasks_count_apart(spark, inputs):
    folder, lines, counts = inputs
    task = job.MapTask("Tokens", f"{folder}/in-a")
    counters = job.run(spark, job.Job((task, task), (job.ReduceTask("Totals", (f"{folder}/twice",)),)))
    assert counters["map_input_0"] == counters["map_input_1"] == 25 and counters["input_shards_1"] == 1


def test_lines_through_a_buffer(spark, inputs):
    folder, lines, counts = inputs
    made = job.Job((job.MapTask("Lengths", f"{folder}/in-*"),), (job.ReduceTask("Copies", (f"{folder}/short",)),), max_line=12)
    job.run(spark, made)
    expected = [x for line in lines for x in ([line] if len(line) < 11 else [""] * -(-(len(line) + 1) // 11))]
    assert sorted(r.value for r in spark.read.text(f"{folder}/short").collect()) == sorted(expected)


def test_run_map_only_and_record_jobs(spark, inputs):
    folder, lines, counts = inputs
    job.run(spark, job.Job((job.MapTask("Tokens", f"{folder}/in-*", "text", "protofile", f"{folder}/mid"),)))
    assert records.read(spark, f"{folder}/mid").count() == sum(counts.values())
    both = job.Job(
        (job.MapTask("Tokens", f"{folder}/in-a"), job.MapTask("Tokens", f"{folder}/mid", "protofile")),
        (job.ReduceTask("Totals", (f"{folder}/a",), "text"), job.ReduceTask("Totals", (f"{folder}/b",), "protofile")),
    )
    job.run(spark, both)
    # the words of one file, and the value "1" of each record
    total = sum(len(line.split()) for line in lines[:25]) + sum(counts.values())
    assert sum(int(r.value.split()[1]) for r in spark.read.text(f"{folder}/a").collect()) + sum(int(bytes(r.value).split()[1]) for r in records.read(spark, f"{folder}/b").collect()) == total


@pytest.mark.parametrize("kind", ["text", "protofile", "own"])
def test_every_shard_and_channel_has_its_path(spark, inputs, kind):
    folder, _, _ = inputs
    passes = []
    formats.register_writer("own", lambda df, path: (passes.append(path), formats.writer("text")(df, path)))

    class Split(reducing.BatchReducer):
        def start(self):
            self.output_to_channel(1, "", "started")

        def reduce(self, key, values):
            self.output(key, key)

    registry.batch_reducer("Split")(Split)
    paths = [[f"{folder}/{kind}-{shard}-{channel}" for channel in range(2)] for shard in range(3)]
    job.run(spark, job.Job((job.MapTask("Tokens", f"{folder}/in-*"),), tuple(job.ReduceTask("Split", tuple(some), kind) for some in paths)))

    def read(path):
        return [bytes(r.value).decode() for r in records.read(spark, path).collect()] if kind == "protofile" else [r.value for r in spark.read.text(path).collect()]

    assert all(read(second) == ["started"] for _, second in paths)
    assert sorted(word for first, _ in paths for word in (read(first) if list((folder / first).glob("part*")) else [])) == sorted("north south east west up down".split())
    assert len(passes) == (6 if kind == "own" else 0)


def test_stream(spark, tmp_path):
    from pyspark.sql import functions as F

    state, folder = str(tmp_path / "state"), str(tmp_path / "in")
    (tmp_path / "in").mkdir()

    def folded():
        stream = spark.readStream.schema("key string").parquet(folder)
        return dict(fold_stream(stream, state, F.count("*").alias("n")).collect())

    assert folded() == {}
    spark.createDataFrame([("a",), ("b",), ("a",)], "key string").write.mode("append").parquet(folder)
    assert folded() == {"a": 2, "b": 1}
    spark.createDataFrame([("a",), ("c",)], "key string").write.mode("append").parquet(folder)
    assert folded() == {"a": 3, "b": 1, "c": 1}  # the state goes on
    assert folded() == {"a": 3, "b": 1, "c": 1}
