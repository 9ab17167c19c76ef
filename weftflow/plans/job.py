"""Jobs as data: which mappers read what, which reducers write where, and the plan that does it.

:func:`parse` takes the textual form (options such as ``--mapreduce_map_io={m1,m2}:Class:text:/in-*:/out``);
machines only say how many tasks there are, Spark places them. The command's arguments are kept, of which
``--mr_max_input_line_length=N`` has a meaning here: text is read through a line buffer of N bytes. Temporary
folders, log files, buffer sizes and ports are parsed and left to Spark. :class:`Job` is the same in Python.
``run`` compiles a job into DataFrame plans and writes its outputs, each format in one pass.
"""

from __future__ import annotations

import logging
import os.path
import re
import shlex
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from ..operators import mapping, reducing, registry
from ..operators.counters import Counters
from ..sources import formats
from ..sources.paths import matching

log = logging.getLogger("weftflow")

#: Fields of a task, as the textual form lists them (fixed values).
MAP_FIELDS = ("class", "input_format", "input_path", "output_path")
REDUCE_FIELDS = ("class", "input_path", "output_format", "output_path")
MAP_ONLY_FIELDS = ("class", "input_format", "input_path", "output_format", "output_path")
TASK = ("machine", "class", "input_format", "input_path", "output_format", "output_path", "tmp_dir", "log_filebase")
#: Options with a value, and switches.
VALUES = ("cmd", "map_io", "reduce_io", "maponly_map_io", "log_filebase", "tmp_dir", "buffer_size", "ssh_port")
SWITCHES = ("incremental_mode", "force_mkdir")


@dataclass(frozen=True)
class MapTask:
    mapper: str
    input_path: str | tuple[str, ...]
    input_format: str = "text"
    output_format: str | None = None
    output_path: str | None = None
    #: How many tasks share its files; by default as many as there are cores.
    tasks: int | None = None


@dataclass(frozen=True)
class ReduceTask:
    """One shard: its reducer, and a path for each output channel."""

    reducer: str
    output_paths: tuple[str, ...]
    output_format: str = "text"


@dataclass(frozen=True)
class Job:
    """Checked when made: formats and classes must be known, and map-only jobs need map outputs.

    With ``max_line`` text is read through a line buffer of so many bytes. Without ``force_mkdir`` the folders
    that outputs go to must exist.
    """

    maps: tuple[MapTask, ...]
    reduces: tuple[ReduceTask, ...] = ()
    incremental: bool = False
    max_line: int | None = None
    force_mkdir: bool = True
    counters: Counters = field(default_factory=Counters, compare=False)

    def __post_init__(self):
        if not self.maps:
            raise ValueError("a job needs a map task")
        for task in self.maps:
            registry.mapper.find(task.mapper)
            formats.reader(task.input_format)
            if self.map_only:
                if not (task.output_format and task.output_path):
                    raise ValueError("a map-only task needs an output format and path")
                formats.writer(task.output_format)
        for task in self.reduces:
            registry.reducer_class(task.reducer, self.incremental)
            formats.writer(task.output_format)
            if not task.output_paths:
                raise ValueError("a reduce task needs an output path")

    @property
    def map_only(self) -> bool:
        return not self.reduces


def _fields(text: str, mark: str) -> list[str]:
    """Parts between marks, without blanks around them; a colon before two slashes is part of a URI."""
    parts = re.split(r":(?!//)" if mark == ":" else re.escape(mark), text)
    return [x.strip() for x in parts if x.strip()]


def _machines(text: str) -> list[str]:
    if not (text.startswith("{") and text.endswith("}")) or not (names := _fields(text[1:-1], ",")):
        raise ValueError(f"not a list of machines: {text!r}")
    return names


def _by_machine(text: str) -> dict[str, str]:
    """``{m1,m2}path;{m3}path`` as machine to path."""
    found = {}
    for part in _fields(text, ";"):
        machines, brace, path = part.partition("}")
        if not brace:
            raise ValueError(f"no machines in {part!r}")
        found |= dict.fromkeys(_machines(machines.strip() + "}"), path.strip())
    return found


def _tasks(text: str, names: tuple[str, ...], tmp: dict[str, str], logs: dict[str, str]) -> list[dict]:
    tasks = []
    for part in _fields(text, ";"):
        machines, *values = _fields(part, ":")
        if len(values) != len(names):
            raise ValueError(f"{len(values) + 1} fields, not {len(names) + 1}: {part!r}")
        for machine in _machines(machines):
            given = dict(zip(names, values)) | {"machine": machine, "tmp_dir": tmp.get(machine), "log_filebase": logs.get(machine)}
            tasks.append({name: given.get(name) for name in TASK})
    return tasks


@dataclass(frozen=True)
class Options:
    """The textual form, parsed: tasks are dicts with the keys :data:`TASK`."""

    map_tasks: list[dict]
    reduce_tasks: list[dict]
    incremental: bool
    values: dict[str, str]
    force_mkdir: bool = False

    @property
    def command(self) -> str | None:
        """The program that the textual form names; here classes are found by name instead."""
        return next(iter(shlex.split(self.values.get("cmd", ""))), None)

    @property
    def arguments(self) -> list[str]:
        return shlex.split(self.values.get("cmd", ""))[1:]

    @property
    def max_line(self) -> int | None:
        found = [x.partition("=")[2] for x in self.arguments if x.lstrip("-").partition("=")[0] == "mr_max_input_line_length"]
        if found and not (found[-1].isdigit() and int(found[-1]) > 1):
            raise ValueError(f"not a line length: {found[-1]!r}")
        return int(found[-1]) if found else None

    @property
    def machines(self) -> set[str]:
        return {task["machine"] for task in (*self.map_tasks, *self.reduce_tasks)}

    def job(self) -> Job:
        """Tasks that differ only in their machine read the same files, so they are one map task; every
        reduce task is a shard."""
        maps = dict.fromkeys(
            MapTask(t["class"], t["input_path"], t["input_format"], t["output_format"], t["output_path"] if t["output_format"] else None) for t in self.map_tasks
        )
        reduces = tuple(ReduceTask(t["class"], tuple(_fields(t["output_path"], ",")), t["output_format"]) for t in self.reduce_tasks)
        return Job(tuple(maps), reduces, self.incremental, self.max_line, self.force_mkdir)


def parse(arguments: list[str]) -> Options:
    """Read ``--mapreduce_NAME=VALUE`` options; unknown ones are an error."""
    values: dict[str, str] = {}
    switches: set[str] = set()
    for argument in arguments:
        name, _, value = argument.strip().partition("=")
        name = name.removeprefix("--mapreduce_")
        if name in SWITCHES:
            switches.add(name)
        elif name in VALUES:
            values[name] = value.strip()
        else:
            raise ValueError(f"unknown option: {argument!r}")
    tmp = {machine: os.path.normpath(path) for machine, path in _by_machine(values.get("tmp_dir", "")).items()}
    logs = _by_machine(values.get("log_filebase", ""))
    if "maponly_map_io" in values:
        if "map_io" in values or "reduce_io" in values:
            raise ValueError("a map-only job has no other map or reduce tasks")
        return Options(_tasks(values["maponly_map_io"], MAP_ONLY_FIELDS, tmp, logs), [], False, values, "force_mkdir" in switches)
    if "map_io" not in values or "reduce_io" not in values:
        raise ValueError("map and reduce tasks are both needed")
    maps, reduces = _tasks(values["map_io"], MAP_FIELDS, tmp, logs), _tasks(values["reduce_io"], REDUCE_FIELDS, tmp, logs)
    return Options(maps, reduces, "incremental_mode" in switches, values, "force_mkdir" in switches)


def mapped(spark: SparkSession, job: Job, number: int) -> DataFrame:
    """``shard, key, value`` of the map task of this number, with its counters."""
    task = job.maps[number]
    context = mapping.Context(task.input_format, task.output_format or (job.reduces[0].output_format if job.reduces else ""), len(job.reduces), job.map_only)
    options = {"tasks": task.tasks} | ({"strict": True, "max_line": job.max_line} if job.max_line and task.input_format == "text" else {})
    read = formats.reader(task.input_format)(spark, list(task.input_path) if isinstance(task.input_path, tuple) else task.input_path, by_file=True, **options)
    kind = "binary" if isinstance(read.schema["value"].dataType, BinaryType) else "string"
    # rows without a key mark the files
    read = job.counters.counted(read, f"map_input_{number}", F.count("key"))
    read = job.counters.counted(read, f"input_shards_{number}", F.count_if(F.col("key").isNull()))
    out = mapping.run_mapper(read, task.mapper, context, by_file=True, kind=kind)
    return job.counters.counted(out, f"map_output_{number}")


def reduced(spark: SparkSession, job: Job) -> DataFrame:
    """``shard, channel, key, value`` of all reducers of a job."""
    parts = [mapped(spark, job, number) for number in range(len(job.maps))]
    kind = "binary" if any(isinstance(part.schema["key"].dataType, BinaryType) for part in parts) else "string"
    parts = [part.select("shard", *(F.col(c).cast(kind).alias(c) for c in ("key", "value"))) for part in parts]
    context = mapping.Context(job.maps[0].input_format, job.reduces[0].output_format, len(job.reduces), False, max(len(t.output_paths) for t in job.reduces))
    out = reducing.run_reducer(mapping.union_of(*parts), [t.reducer for t in job.reduces], context, job.incremental, kind, count_keys=True)
    keys = F.when(F.col("channel") == reducing.KEYS, F.col("value").cast("string").cast("long")).otherwise(0)
    out = job.counters.counted(out, "reduce_keys", F.sum(keys)).where(F.col("channel") != reducing.KEYS)
    return job.counters.counted(out, "reduce_output")


def check_paths(spark: SparkSession, job: Job) -> None:
    """Inputs must match files. The folder of every output must exist, or is made where ``force_mkdir`` says so."""
    for task in job.maps:
        matching(spark, list(task.input_path) if isinstance(task.input_path, tuple) else task.input_path)
    outputs = [t.output_path for t in job.maps if job.map_only] + [path for t in job.reduces for path in t.output_paths]
    path_of = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for output in dict.fromkeys(outputs):
        folder = path_of(output).getParent()
        files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if not files.exists(folder):
            if not job.force_mkdir:
                raise FileNotFoundError(f"the folder of output path {output} does not exist")
            files.mkdirs(folder)


def _write(outputs: dict[tuple[str, str], list], df: DataFrame) -> None:
    """Write ``df`` to outputs, each (format, path) with the conditions on its rows: a pass for each format."""
    for kind in dict.fromkeys(kind for kind, _ in outputs):
        paths = [path for of, path in outputs if of == kind]
        at = F.lit(None).cast("int")
        for number, path in enumerate(paths):
            for condition in outputs[kind, path]:
                at = F.when(condition, number).otherwise(at)
        log.info("%s output to %s", kind, ", ".join(paths))
        formats.write_routed(df.withColumn("at", at).where("at is not null").select("at", "key", "value"), kind, paths)


def run(spark: SparkSession, job: Job) -> dict[str, int]:
    """Run a job, write its outputs and return its counters.

    Tasks that share an output path add part files to it; each other path is overwritten. Counters by map task:
    ``input_shards`` (files), ``map_input`` and ``map_output`` with its number; of all reducers: ``reduce_keys``
    and ``reduce_output``.
    """
    check_paths(spark, job)
    outputs: dict[tuple[str, str], list] = {}
    if job.map_only:
        parts = []
        for number, task in enumerate(job.maps):
            parts.append(mapped(spark, job, number).withColumn("shard", F.lit(number)))
            outputs.setdefault((task.output_format, task.output_path), []).append(F.col("shard") == number)
        kinds = {part.schema["key"].dataType.simpleString() for part in parts}
        if len(kinds) > 1:
            parts = [part.select("shard", *(F.col(c).cast("binary").alias(c) for c in ("key", "value"))) for part in parts]
        out = mapping.union_of(*parts)
    else:
        out = reduced(spark, job)
        for shard, task in enumerate(job.reduces):
            for channel, path in enumerate(task.output_paths):
                outputs.setdefault((task.output_format, path), []).append((F.col("shard") == shard) & (F.col("channel") == channel))
    several = len({kind for kind, _ in outputs}) > 1  # passes
    out = out.persist() if several else out
    try:
        _write(outputs, out)
    finally:
        if several:
            out.unpersist()
    return job.counters.values()
