"""Exports of JSON arrays: whole ones at any cut of their bytes, refused ones, values by the schema, files of many partitions."""

import gzip
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.conftest import rows
from vacancia.sources import exports

JSONS = st.recursive(st.none() | st.booleans() | st.integers() | st.text(max_size=5), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(max_size=3), x, max_size=3), max_leaves=6)


def cut(data, size):
    return [data[i : i + size] for i in range(0, len(data), size)]


def items(data, size, most=exports.MOST_ITEM):
    return list(exports.objects(exports.decoded(exports.unzipped(cut(data, size))), most))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.dictionaries(st.text(max_size=3), JSONS, max_size=4), max_size=5), st.integers(1, 40), st.booleans(), st.booleans())
def test_whole_arrays_at_any_cut(values, size, zipped, ascii_):
    data = ("﻿ " + json.dumps(values, ensure_ascii=ascii_, indent=1) + "\n ").encode("utf-8", "surrogatepass")
    assert items(gzip.compress(data) if zipped else data, size) == values


@settings(max_examples=100, deadline=None)
@given(st.lists(st.dictionaries(st.text(max_size=3), JSONS, max_size=3), min_size=1, max_size=3), st.integers(1, 20), st.data())
def test_no_part_of_an_array_is_taken_for_a_whole(values, size, data):
    whole = json.dumps(values).encode()
    for part in (whole, gzip.compress(whole)):
        with pytest.raises((exports.BrokenExport, UnicodeDecodeError)):
            items(part[: data.draw(st.integers(0, len(part) - 1))], size)


@pytest.mark.parametrize("text", ["", " ", "{}", '[{"a":1}] x', '[{"a":1}],', "[{}][]", "[1]", '["a"]', "[{},null]", '[{"a":nope}]', "[[{}]]", "null", '[{"a":1}}]', '[{"a":' + "[" * 9999 + "]" * 9999 + "}]"])
@pytest.mark.parametrize("size", [1, 7, 100_000])
def test_refused(text, size):
    with pytest.raises(exports.BrokenExport):
        items(text.encode(), size)


def test_long_items_and_bad_bytes():
    one = b'[{"a":"' + b"x" * 100 + b'"}]'
    assert len(items(one, 9, 108)) == 1
    for size in (9, 1000):
        with pytest.raises(exports.BrokenExport, match="too long"):
            items(one, size, 107)
    with pytest.raises(UnicodeDecodeError):
        items(b'[{"a":"\xff"}]', 3)
    assert items(gzip.compress(b"[{},") + gzip.compress(b"{}]"), 5) == [{}, {}]
    assert items(b'[{"a":"' + b"x" * 3_000_00 + b'"} {}]', 11)[1] == {}  # linear: not a scan a chunk


SCHEMA = "a int, b long, c string, d double, e boolean, f array<int>, g struct<h:string,i:int>"


def test_values_follow_the_schema(spark, tmp_path):
    found = [
        {"a": 1, "b": 2**40, "c": "é\ud800", "d": 1, "e": True, "f": [1, None, "x"], "g": {"h": 1, "i": 2, "z": 3}, "z": 0}, {"a": 2**31, "b": True, "c": {"k": ["ё"]}, "d": "1", "e": 1, "f": {}, "g": []}, {}, {"b": 1.0, "d": 10**400, "a": None},
    ]
    (tmp_path / "x.json").write_text(json.dumps(found))
    none = (None,) * 7
    assert [tuple(r) for r in exports.read(spark, str(tmp_path / "x.json"), SCHEMA).collect()] == [(1, 2**40, "é?", 1.0, True, [1, None, None], ("1", 2)), (None, None, '{"k": ["ё"]}', None, None, None, None), none, none]
    with pytest.raises(Exception, match="state the schema"):
        spark.read.format(exports.FORMAT).load(str(tmp_path))


def test_folders_are_written_and_read(spark, tmp_path):
    df = spark.range(5000).selectExpr("id", "if(id % 3 = 0, null, concat('n', id)) AS name", "array(id, id + 1) AS more").repartition(5)
    exports.write(df, str(tmp_path / "out"))
    back = exports.read(spark, str(tmp_path / "out"), df.schema)
    assert back.rdd.getNumPartitions() == 6 and rows(back) == rows(df)
    exports.write(df.where("false"), str(tmp_path / "empty"))
    assert exports.read(spark, str(tmp_path / "empty"), df.schema).count() == 0
    (tmp_path / "nothing").mkdir()
    assert exports.read(spark, str(tmp_path / "nothing"), df.schema).count() == 0
    (tmp_path / "out" / "bad.json").write_text('[{"id":1}')
    with pytest.raises(Exception, match="malformed export .*bad.json: the array isn't closed"):
        exports.read(spark, str(tmp_path / "out"), df.schema).count()  # files are listed when a read is planned
    with pytest.raises(Exception, match="absent"):
        exports.read(spark, str(tmp_path / "absent"), df.schema).count()
