"""Readers and writers: offsets, ranges, strict lines, records, channels, globs."""

import io

import pytest
from pyspark.sql import functions as F

from weftflow.sources import formats, records, text
from weftflow.sources.paths import matching


@pytest.fixture
def tricky(tmp_path):
    path = tmp_path / "tricky.txt"
    path.write_bytes(b"apple\r\n\r\nx\ry\nlast")
    return str(path)


def rows(df):
    return [(r.key.rsplit("-", 1)[1], r.value) for r in sorted(df.collect())]


def test_lines_and_offsets(spark, tricky):
    assert rows(text.read_text(spark, tricky)) == [("0000000000", "apple"), ("0000000007", ""), ("0000000009", "x\ry"), ("0000000013", "last")]
    assert text.read_text(spark, tricky).first().file == tricky


def test_strict_lines(spark, tricky, tmp_path):
    assert [v for _, v in rows(text.read_text(spark, tricky, strict=True))] == ["apple", "", "x\ry", ""]
    (tmp_path / "long").write_bytes(b"z" * 20000 + b"\n")
    assert rows(text.read_text(spark, str(tmp_path / "long"), strict=True)) == [("0000000000", ""), ("0000016383", "")]
    assert rows(text.read_text(spark, str(tmp_path / "long"))) == [("0000000000", "z" * 20000)]
    (tmp_path / "nul").write_bytes(b"one\ntw\0o\nthree\nfour\n\0\nsix\nseven\n")
    assert [v for _, v in rows(text.read_text(spark, str(tmp_path / "nul"), strict=True, split=3))] == ["one", "", "", "four", "", "", "seven"]
    assert rows(formats.reader("text")(spark, str(tmp_path / "nul"), strict=True, max_line=5))[3:6] == [("0000000009", ""), ("0000000013", ""), ("0000000015", "")]
    with pytest.raises(ValueError):
        text.read_text(spark, tricky, max_line=1)


@pytest.mark.parametrize("step", [1, 2, 3, 5, 7, 100])
@pytest.mark.parametrize("data", [b"", b"\n", b"\n\n", b"ab\ncd", b"ab\n\ncd\n", b"abcdefgh\ni\n"])
def test_every_line_is_read_in_one_range(data, step):
    whole = list(text.lines(io.BytesIO(data), 0, max(1, len(data))))
    cut = [line for k in range(0, max(1, len(data)), step) for line in text.lines(io.BytesIO(data), k, min(len(data), k + step), buffer=2)]
    assert cut == whole
    assert b"".join(line for _, line in whole) == data


def test_values_keep_all_but_one_carriage_return(spark, tmp_path):
    (tmp_path / "f").write_bytes(b"a\r\r\nb\n")
    assert [r.value for r in text.read_values(spark, str(tmp_path / "f")).collect()] == ["a\r", "b"]


def test_globs(spark, tmp_path):
    for k in range(5):
        (tmp_path / f"in-0000{k}-of-00005").touch()
    counts = {"*": 5, "in-0000?-of-00005": 5, "in-0000[0-2]*": 3, "in-000{00,01,02}*": 3, "in-00000-of-00005": 1}
    assert {p: len(matching(spark, f"{tmp_path}/{p}")) for p in counts} == counts
    with pytest.raises(FileNotFoundError):
        matching(spark, f"{tmp_path}/none*")
    assert len(matching(spark, [f"{tmp_path}/in-00000*", f"{tmp_path}/in-00001*"])) == 2


def test_text_sink_writes_values_whole(spark, tmp_path):
    df = spark.createDataFrame([("k", "a\0b"), ("k", None), ("k", "")], "key string, value string").coalesce(1)
    text.write_text(df, str(tmp_path / "out"))
    assert b"".join(sorted(p.read_bytes() for p in (tmp_path / "out").glob("part*"))) == b"a\0b\n\n\n"


def test_record_bytes():
    first = records.pack(b"a key", b"a value")
    assert first.hex() == "100000000a0561206b65791207612076616c7565"
    second = records.pack(b"a key", first[4:])
    assert list(records.read_records(io.BytesIO(first + second))) == [(b"a key", b"a value"), (b"a key", first[4:])]
    assert list(records.read_records(io.BytesIO(b""))) == []
    assert records.unpack(b"\x12\x01v\x18\x05\x0a\x01k") == (b"k", b"v")
    assert records.unpack(b"") == (b"", b"")
    for broken in (first[:-1], first[:2], b"\xff\xff\xff\xff"):
        with pytest.raises((EOFError, ValueError)):
            list(records.read_records(io.BytesIO(broken)))


def test_records_round_trip(spark, tmp_path):
    data = [(bytes([k]), bytes(range(k))) for k in range(200)] + [(b"", b"")]
    df = spark.createDataFrame(data, "key binary, value binary").repartition(3)
    path = str(tmp_path / "records")
    records.write(df, path)
    assert sorted((bytes(r.key), bytes(r.value)) for r in records.read(spark, path).collect()) == sorted(data)
    records.write(df.limit(1), path)  # overwrites
    assert records.read(spark, path).count() == 1
    records.write(df.limit(1), path, mode="append")
    assert records.read(spark, path).count() == 2
    typed = records.read(spark, path, key=lambda c: F.hex(c), value=lambda c: F.octet_length(c))
    assert dict(typed.dtypes)["value"] == "int"


@pytest.mark.parametrize("tasks", [1, 2, 7])
def test_files_are_packed_whole(tasks):
    files = [(f"f{k}", size) for k, size in enumerate((5, 0, 900, 3, 3, 0, 40))]
    got = text.packed(files, tasks)
    assert [f for some in got for f in some] == files and len(got) == tasks and all(got)


def test_records_by_file(spark, tmp_path):
    records.write(spark.createDataFrame([(b"k", b"v")] * 3, "key binary, value binary").repartition(2), str(tmp_path / "r"))
    read = records.read(spark, str(tmp_path / "r"), by_file=True, tasks=1).collect()
    assert sum(r.key is None for r in read) == len({r.file for r in read}) and read[0].key is None and sum(r.key is not None for r in read) == 3


def test_formats():
    assert formats.reader("text") and formats.reader("protofile") and formats.writer("recordio")
    for name in ("", "something_without_name", "Text"):
        with pytest.raises(KeyError):
            formats.reader(name)
        with pytest.raises(KeyError):
            formats.writer(name)


def test_channels(spark, tmp_path):
    df = spark.createDataFrame([(0, "k", "a"), (1, "k", "b"), (1, "k", "c")], "channel int, key string, value string")
    paths = [str(tmp_path / name) for name in ("zero", "one", "two")]
    formats.write_channels(df, "text", paths)
    assert [sorted(r.value for r in spark.read.schema("value string").text(p).collect()) for p in paths] == [["a"], ["b", "c"], []]
    for channels in (1, 0):
        with pytest.raises(Exception, match="channel outside"):
            formats.checked_channels(df, channels).collect()
