"""Documents cut by their structure give the rows of whole documents."""

import json
import random

import numpy as np
import pytest

from threatlake.sources import json_arrays, logs


def plain_structure(data, inside):
    out, quotes, escaped = [], 0, False
    for i, ch in enumerate(data):
        if ch == '"' and not escaped:
            quotes += 1
        elif ch in "[]{}," and (quotes + inside) % 2 == 0:
            out.append((i, {"[": 1, "{": 1, ",": 0}.get(ch, -1)))
        escaped = ch == "\\" and not escaped
    return out, quotes % 2


@pytest.mark.parametrize("inside", [False, True])
def test_structure(inside):
    rnd = random.Random(4)
    for n in (0, 1, 7, 400):
        data = "".join(rnd.choice('[]{},"\\ab') for _ in range(n))
        places, change, parity = json_arrays.structure(np.frombuffer(data.encode(), np.uint8), inside)
        want, quotes = plain_structure(data, inside)
        assert list(zip(places.tolist(), change.tolist(), strict=True)) == want and parity == quotes


def documents():
    rnd = random.Random(1)

    def value(depth):
        kind = rnd.randrange(8 if depth else 5)
        if kind == 5:
            return [value(depth - 1) for _ in range(rnd.randrange(4))]
        if kind > 5:
            return {rnd.choice('abc}"') + str(i): value(depth - 1) for i in range(rnd.randrange(4))}
        return [None, 5, 'q"}],{[', "né\\", True][kind]

    made = [[value(3) for _ in range(rnd.randrange(60))] for _ in range(6)]
    made += [[{"a": "x" * 3000}] * 9, {"o": [1, {"p": "}"}]}, [], [{}], [[], [[]], {}], [None, {"a": 1}], [{"a": 1}, 7, "s"], 5, "[1]"]
    texts = [json.dumps(d, indent=rnd.choice([None, 1]), ensure_ascii=False) for d in made]
    texts += ["", " \n", "\n [ {\"a\":1} ]\n ", "[1,]", "[,1]", "[{\"a\":1}", "{\"a\":1", "[{\"a\":1}}", "[{\"a\" 1},{\"b\":2}]", "{\"a\":1}\n"]
    return texts


@pytest.mark.parametrize("size", ["64b", "1k", "64m"])
def test_splits_change_nothing(spark, tmp_path, size):
    for i, document in enumerate(documents()):
        (tmp_path / f"d{i:02}.json").write_text(document, encoding="utf-8")
    own = spark.newSession()
    own.conf.set("spark.sql.files.maxPartitionBytes", size)
    own.conf.set("spark.sql.files.openCostInBytes", "0")

    def rows(df):
        return sorted((r.source_file.rsplit("/", 1)[1], r.line_number, r.line, r.log_type) for r in df.collect())

    want, got = rows(logs.read_json_documents(spark, str(tmp_path))), rows(json_arrays.read_json_arrays(own, str(tmp_path)))
    assert got == want and len(want) > 100


def test_text_after_the_end_and_many_splits(spark, tmp_path):
    for i, document in enumerate(['[1] [2]', '[{"a":1}]]', '[{"a":1}] x', 'x [1]', '[{"a":1}]']):
        (tmp_path / f"d{i}.json").write_text(document)
    assert [r.line for r in json_arrays.read_json_arrays(spark, str(tmp_path)).collect()] == ['{"a":1}']
    with pytest.raises(ValueError, match="splits"):
        json_arrays.read_json_arrays(spark, str(tmp_path), max_splits=3)
