"""The reader of large JSON arrays and objects against Python's, at every split size."""

import json
import random

import pytest

from grovespan.sources import json_rows

SCHEMA = "id bigint, t string, deep struct<a: array<string>, b: map<string, string>>"


def value(rng, depth=0):
    kinds = ["text", "number", "none"] + ["list", "map"] * (depth < 3)
    kind = rng.choice(kinds)
    text = lambda: "".join(rng.choice(['"', "\\", "[", "]", "{", "}", ",", ":", " ", "\n", "é", "🙂", "\u0000", "a", "\\\\"]) for _ in range(rng.randint(0, 9)))
    if kind == "text":
        return text()
    if kind == "number":
        return rng.choice([0, -1.5, 10**12, True, False])
    if kind == "none":
        return None
    if kind == "list":
        return [value(rng, depth + 1) for _ in range(rng.randint(0, 4))]
    return {text(): value(rng, depth + 1) for _ in range(rng.randint(0, 4))}


def ranges(path, step):
    """States of the ranges of one file, as the first job composes them."""
    size = path.stat().st_size
    cuts = [(a, min(a + step, size)) for a in range(0, size, step)]
    before = list(json_rows.states([json_rows.effect(str(path), a, b) for a, b in cuts]))
    assert before[-1][:2] == (False, 0)
    return [json_rows.Range(str(path), a, b, size, *state) for (a, b), state in zip(cuts, before)]


@pytest.mark.parametrize("seed", range(6))
def test_rows_of_any_ranges(tmp_path, monkeypatch, seed):
    rng = random.Random(seed)
    want = [value(rng) for _ in range(rng.randint(0, 25))]
    file = tmp_path / "a.json"
    file.write_text((" \n" if seed % 2 else "﻿") + json.dumps(want, ensure_ascii=bool(seed % 3), indent=rng.choice([None, 1])) + " \n", encoding="utf-8")
    for step in (1, 2, 3, 7, 64, 10**6):
        for block in (1, 5, 1 << 20):
            if step * block < 4 and len(want) > 8:
                continue
            monkeypatch.setattr(json_rows, "BLOCK", block)
            found = [x for part in ranges(file, step) for x in json_rows.elements(part)]
            assert [json.loads(x) for _, x in found] == want
            assert [s for s, _ in found] == sorted(s for s, _ in found)


def test_same_as_the_whole_reader(spark, tmp_path):
    rng = random.Random(9)
    rows = [{"id": k, "t": rng.choice([None, 'a "b" \\ [', "x" * k, "{,}"]), "deep": rng.choice([None, {"a": ["]", ","], "b": {"k,": "}"}}])} for k in range(300)]
    file = tmp_path / "rows.json"
    file.write_text(json.dumps(rows), encoding="utf-8")
    whole = spark.read.schema(SCHEMA).option("multiLine", True).json(str(file))
    own = json_rows.read_array(spark, str(file), SCHEMA, 500)
    assert own.rdd.getNumPartitions() > 20
    assert own.collect() == whole.collect()
    assert json_rows.read_array(spark, str(file), SCHEMA).collect() == whole.collect()


def test_written_files_are_read_again(spark, tmp_path):
    rows = spark.range(500).selectExpr("id", "concat('text \"', id, '\" \\\\ [,') AS t").repartition(4)
    json_rows.write_arrays(rows, str(tmp_path / "arrays"))
    parts = sorted((tmp_path / "arrays").glob("part-*"))
    assert len(parts) == 4 and sum(len(json.loads(p.read_text())) for p in parts) == 500
    assert sorted(map(tuple, json_rows.read_array(spark, str(tmp_path / "arrays"), "id bigint, t string", 900).collect())) == sorted(map(tuple, rows.collect()))
    json_rows.write_arrays(rows.limit(0), str(tmp_path / "none"))
    assert json_rows.read_array(spark, str(tmp_path / "none"), "id bigint").collect() == []
    pairs = rows.selectExpr("IF(id % 100 = 0, concat('k\":{', id), concat('q', id)) AS key", "array(t, null) AS value")
    json_rows.write_maps(pairs, str(tmp_path / "maps"))
    assert sorted(map(str, json_rows.read_map(spark, str(tmp_path / "maps"), "array<string>", 700).collect())) == sorted(map(str, pairs.collect()))


@pytest.mark.parametrize("text,error", [
    ('{"a": 1}', json_rows.WrongRoot), ("", json_rows.WrongRoot), ("  ", json_rows.WrongRoot), ('"[1]"', json_rows.WrongRoot), ("3", json_rows.WrongRoot),
    ('[{"id": 1}', json_rows.BrokenJson), ('[{"id": 1}, "', json_rows.BrokenJson), ('[{"id": 1}]]', json_rows.BrokenJson),
])
def test_wrong_files_by_type(spark, tmp_path, text, error):
    file = tmp_path / "x.json"
    file.write_text(text)
    with pytest.raises(error):
        json_rows.read_array(spark, str(file), "id bigint", 4)


@pytest.mark.parametrize("text", ['[{"id": 1},,{"id": 2}]', '[{"id": 1},]', '[{"id": 1}] x', '[{"id": 1}] [{"id": 2}]', 'x', '[{"id": }]', "[3]"])
def test_wrong_rows_fail(spark, tmp_path, text):
    file = tmp_path / "x.json"
    file.write_text(text)
    with pytest.raises(Exception, match="json|JSON|begins with|MALFORMED|Malformed"):
        json_rows.read_array(spark, str(file), "id bigint", 5).collect()


def test_objects(spark, tmp_path):
    file = tmp_path / "o.json"
    file.write_text('{"id": 1,\n "t": "x"}')
    assert [tuple(r) for r in json_rows.read_object(spark, str(file), "id bigint, t string").collect()] == [(1, "x")]
    file.write_text("[1]")
    with pytest.raises(json_rows.WrongRoot):
        json_rows.read_object(spark, str(file), "id bigint")
    with pytest.raises(json_rows.WrongRoot):
        json_rows.read_map(spark, str(file), "bigint")
    with pytest.raises(FileNotFoundError):
        json_rows.read_map(spark, str(tmp_path / "none.json"), "bigint")
    file.write_text('{"a" 1}')
    with pytest.raises(Exception, match="has no name"):
        json_rows.read_map(spark, str(file), "bigint").collect()
