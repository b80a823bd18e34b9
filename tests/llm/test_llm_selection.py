"""Exact dedup, importance resampling and filter audit against brute force."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from threatlake.llm import exact_dedup, filter_audit, importance

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LONG = "Lorem Ipsum dolor " * 60_000


# -- exact dedup ------------------------------------------------------------------

def plain_copies(rows):
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[hashlib.sha256((t or "").translate(UPPER).encode()).hexdigest()].append(i)
    out = []
    for digest, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep, left = (max(known) if known else None), True
        for i in ids:
            out.append((i, keep, len(ids), left and i == keep, digest))
            left = left and i != keep
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def copied():
    rng = random.Random(3)
    texts = ["Hot Text", "É Hot", "é hot", "", None, LONG, LONG.upper()] + [f"w{rng.randrange(60)} x" for _ in range(90)]
    rows = [(i, rng.choice(["hot text", "HOT text"]) if i % 3 == 0 else rng.choice(texts)) for i in range(300)]
    return rows + [(7, rows[7][1]), (7, rows[7][1]), (None, "hot text"), (None, "alone"), (None, "ALONE"), (-5, "w1 x")]


@pytest.mark.parametrize("most, counters", [(1, 100), (2, 100), (100, 1000), (1000, 20_000)])
def test_copies_whatever_counts_as_frequent(spark, copied, most, counters):
    docs = spark.createDataFrame([(i, t, i, "x") for i, t in copied], "doc_id bigint, text string, digest bigint, row string").repartition(5)
    got = [tuple(r) for r in exact_dedup.copies(docs, most=most, counters=counters).select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()]
    assert sorted(got, key=repr) == plain_copies(copied)
    left = exact_dedup.drop_copies(docs, most=most, counters=counters)
    assert left.columns == docs.columns
    want = collections.Counter((i, digest) for i, _, _, kept, digest in plain_copies(copied) if kept)
    found = collections.Counter((r.doc_id, hashlib.sha256((r.text or "").translate(UPPER).encode()).hexdigest()) for r in left.collect())
    assert found == want


def test_no_copies_in_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string, kept string")
    assert exact_dedup.copies(docs).count() == 0 and exact_dedup.drop_copies(docs).count() == 0


def test_frequent_digests_are_found_whatever_their_order(spark):
    rows = spark.range(30_000).select(F.when(F.col("id") % 5 == 0, "hot").when(F.col("id") % 50 == 1, "warm").otherwise(
        F.col("id").cast("string")).alias("digest"))
    for order in ("digest", F.xxhash64("digest")):
        found = exact_dedup.frequent(rows.repartition(7, order), 10, 2000)
        assert {r.digest for r in found.collect()} >= {"hot", "warm"} and found.count() <= 10


def test_exact_dedup_stays_in_the_engine(spark, copied):
    docs = spark.createDataFrame(copied, "doc_id bigint, text string")
    plan = exact_dedup.copies(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|ExistingRDD|CartesianProduct|NestedLoop", plan)


# -- importance resampling -----------------------------------------------------------

def plain_resampling(rows, target, percent=10, least=20, buckets=10_000, seed=2024):
    def features(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER))
        return [zlib.crc32(w.encode()) % buckets for w in words]
    docs, s, t = [(i, features(x)) for i, x in rows], collections.Counter(), collections.Counter()
    for _, f in docs:
        s.update(f)
    for x in target:
        t.update(features(x))
    S, T = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in {*s, *t}}
    out = []
    for i, f in docs:
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for place, r in enumerate(able[: percent * len(able) // 100], 1):
        r[4] = place
    return sorted(map(tuple, out), key=repr)


@pytest.fixture(scope="module")
def mixed():
    rng = random.Random(6)
    def text(n):
        return " ".join(rng.choice(["Aa", "b9", "çé", "x-y", "q" * 70, "日本", "z"]) + str(rng.randrange(40)) for _ in range(n))
    rows = [(i * 1_000_003 - 5_000_000, text(rng.choice([0, 3, 19, 20, 40]))) for i in range(250)]
    same = text(30)
    rows += [(10 ** 15 + i, same) for i in range(4)] + [(44, same)] * 3 + [(None, same), (None, None), (1, ""), (2, LONG), (3, "q" * 100_000)]
    return rows, [text(10) for _ in range(12)] + [None, ""]


@pytest.mark.parametrize("percent, least", [(10, 20), (100, 1), (35, 0), (0, 20)])
def test_resampling(spark, mixed, percent, least):
    rows, target = mixed
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id bigint, text string, score int, row int").repartition(5)
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    got = importance.resample(docs, goal, percent=percent, least_words=least)
    assert sorted(map(tuple, got.collect()), key=repr) == plain_resampling(rows, target, percent, least)
    drawn = importance.draw(docs, goal, percent=percent, least_words=least, rank="score")
    assert drawn.columns == ["doc_id", "text", "row", "score"]
    want = sorted((r[4], r[0]) for r in plain_resampling(rows, target, percent, least) if r[4]) if percent < 100 else None
    if want is not None:
        assert sorted((r.score, r.doc_id) for r in drawn.collect()) == want


@pytest.mark.parametrize("digit_bits, block_bits", [(3, 2), (5, 4), (11, 14)])
def test_radix_sort_is_stable(spark, monkeypatch, digit_bits, block_bits):
    monkeypatch.setattr(importance, "DIGIT_BITS", digit_bits)
    monkeypatch.setattr(importance, "BLOCK_BITS", block_bits)
    rng = random.Random(1)
    rows = [(i, rng.randrange(3), rng.choice([0, 7, 2 ** 40, rng.randrange(50)])) for i in rng.sample(range(10_000), 300)]
    got = importance.radix_ranks(spark.createDataFrame(rows, "row bigint, high bigint, low bigint").repartition(4))
    want = {row: place for place, (_, _, row) in enumerate(sorted((h, lo, r) for r, h, lo in rows))}
    assert {r.row: r.place for r in got.collect()} == want


def test_resampling_of_empty_tables(spark, mixed):
    rows, target = mixed
    none, some = spark.createDataFrame([], "doc_id bigint, text string"), spark.createDataFrame(rows, "doc_id bigint, text string")
    assert importance.resample(none, some).count() == 0
    assert sorted(map(tuple, importance.resample(some, none).collect()), key=repr) == plain_resampling(rows, [])


def test_word_checksums():
    rng = np.random.default_rng(5)
    data = rng.integers(0, 256, 4000).astype(np.uint8)
    cuts = np.sort(rng.choice(4000, 150, replace=False))
    starts, ends = cuts[:-1], cuts[1:]
    assert importance.crc32(data, starts, ends).tolist() == [zlib.crc32(data[a:b]) for a, b in zip(starts, ends)]
    assert importance.crc32(data, starts[:0], ends[:0]).tolist() == []


# -- filter audit ---------------------------------------------------------------------

def plain_audit(rows, labels):
    least, good, toxic = {}, {i for i, q, _ in labels if q == 1} - {None}, {i for i, _, t in labels if t == 1} - {None}
    order = lambda i: (i is None, i or 0)
    for i, t, _ in rows:
        least[t or ""] = min(least.get(t or "", (True, 1 << 70)), order(i))
    failed = []
    for i, t, lang in rows:
        t, words = t or "", re.findall(r"[^\x20\x09-\x0D]+", t or "")
        f = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
             "D": bool(re.search("[#$%&*|]", t)), "E": order(i) > least[t]}
        failed.append((lang or "", {x for x in f if f[x]}, i in good, i in toxic))
    out, total = {}, collections.Counter()
    for part in {p for p, *_ in failed}:
        for letters in itertools.permutations("ABCDE"):
            for k, x in enumerate(letters):
                before, row = set(letters[:k]), [0] * 6
                for p, f, g, tox in failed:
                    if p == part:
                        gone, now = bool(f & before), x in f
                        for n, hit in enumerate((not gone and not now, now and not gone, now and gone, f == {x}, now and not gone and g, now and not gone and tox)):
                            row[n] += hit
                out[part, "".join(letters), k + 1] = row
                total[part, x] += row[1]
    return {key: (*row, total[key[0], key[1][key[2] - 1]]) for key, row in out.items()}


@pytest.mark.parametrize("files_per_batch", [1, 3])
def test_audit_with_smaller_ids_arriving_later(spark, tmp_path, files_per_batch):
    rng = random.Random(9)
    pool = ["", None, " ".join(f"w{i}" for i in range(220)), "a b " * 150, "ABC DEF", "x # y", " ".join(f"v{i}" for i in range(250)) + " $", LONG[:50_000]]
    rows = [(i, rng.choice(pool) if i % 2 else f"\x0b own {i} text ", rng.choice(["de", "en", None])) for i in range(90)]
    rows += [(20, rows[20][1], "de"), (20, rows[20][1], "fr"), (21, "", "fr"), (None, "", "en"), (None, "only here", "en"), (None, "only here", "en")]
    labels = [(i, i % 4, i % 3) for i in range(80)] + [(5, 1, 1), (None, 1, 1), (7, None, None)]
    rng.shuffle(rows)
    rows.sort(key=lambda r: -(r[0] or 0) // 20)  # the smallest ids come last, file by file
    for k in range(0, len(rows), 20):
        spark.createDataFrame([(*r, "1", 2) for r in rows[k: k + 20]], "doc_id bigint, text string, lang string, n string, mask int").repartition(
            1).write.parquet(str(tmp_path / f"part{k:03}"))
    marks = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = filter_audit.audit(spark, f"{tmp_path}/part*", marks, files_per_batch=files_per_batch)
    found = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in got.collect()}
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert found == plain_audit(rows, labels)
    changes = filter_audit.counter_changes(spark, f"{tmp_path}/part*", marks, files_per_batch=files_per_batch)
    assert changes.filter("n < 0").count() > 0


def test_audit_of_an_empty_table(spark, tmp_path):
    path = str(tmp_path / "none")
    spark.createDataFrame([], "doc_id bigint, text string, lang string").write.parquet(path)
    assert filter_audit.audit(spark, path, spark.createDataFrame([], "doc_id bigint, quality int, toxic int")).count() == 0


def test_copies_are_set_aside_inside_a_chunk():
    import pandas as pd
    rows = pd.DataFrame({"grp": 1, "digest": ["a"] * 500 + ["b"], "missing": 0, "id": [*range(500, 0, -1), 9], "part": "de", "mask": 3, "n": 1})
    out, = filter_audit.combined([rows])
    assert len(out) == 3 and out["n"].sum() == 501 and out.loc[out["digest"] == "a", "id"].tolist() == [1]
    assert out.loc[out["digest"] == "", "n"].tolist() == [499]
