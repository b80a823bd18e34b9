"""Near-duplicate vectors: cross-polytope hashing after fast Hadamard rotations, multiprobe buckets."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threatlake import session
from threatlake.llm.components import components, with_component
from threatlake.llm.textops import mix

#: Pairs at or above this cosine are links.
COSINE = 0.93
#: Hash tables, hashes joined in each, and further buckets that a vector enters in each table.
TABLES, HASHES, PROBES = 5, 3, 7
#: Best coordinates of a hash among which probes are chosen.
NEXT_BEST = 3
#: Members of a chunk, the unit in which a hot bucket is sent, and of a block, the unit in which it is compared.
#: Two chunks meet in a task (4 MB of vectors for 128 doubles), so a bucket of N is sent N / CHUNK times at most.
CHUNK, BLOCK = 2_048, 256

_STEP = 0xA0761D6478BD642F


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of every row; their length is a power of two."""
    n, width, half = len(x), x.shape[1], 1
    while half < width:
        parts = x.reshape(n, width // (2 * half), 2, half)
        x = np.stack([parts[:, :, 0] + parts[:, :, 1], parts[:, :, 0] - parts[:, :, 1]], axis=2).reshape(n, width)
        half *= 2
    return x / np.sqrt(width)


def rotated(x: np.ndarray, seed: int) -> np.ndarray:
    """Three rounds of random signs and the transform: close to a random rotation."""
    signs = np.random.default_rng(seed).choice([-1.0, 1.0], size=(3, x.shape[1]))
    for row in signs:
        x = hadamard(x * row)
    return x


def bucket_keys(units: np.ndarray, labels: np.ndarray, tables: int = TABLES, probes: int = PROBES) -> np.ndarray:
    """Keys of all buckets of unit vectors, one row each: own bucket and next best ones by table.

    A hash is the nearest signed axis after a rotation.  Probes change one or more hashes of a
    table to a next best axis, in the order of what that loses.
    """
    n, size = units.shape
    width = 1 << max(2, (size - 1).bit_length())
    padded = np.zeros((n, width))
    padded[:, :size] = units
    best = min(NEXT_BEST, width)
    combos = np.stack(np.meshgrid(*[np.arange(best)] * HASHES, indexing="ij"), axis=-1).reshape(-1, HASHES)
    base = mix(labels.astype(np.int64).view(np.uint64) * np.uint64(_STEP) + np.uint64(size))
    out = []
    for table in range(tables):
        loss, codes = np.zeros((n, len(combos))), np.zeros((n, len(combos)), dtype=np.uint64)
        for h in range(HASHES):
            y = rotated(padded, table * HASHES + h)
            size_of = np.abs(y)
            top = np.argsort(-size_of, axis=1, kind="stable")[:, :best]
            strength = np.take_along_axis(size_of, top, axis=1)
            axis = 2 * top + (np.take_along_axis(y, top, axis=1) < 0)
            loss += ((strength[:, :1] - strength) ** 2)[:, combos[:, h]]
            codes = codes * np.uint64(2 * width) + axis.astype(np.uint64)[:, combos[:, h]]
        chosen = np.argsort(loss, axis=1, kind="stable")[:, : 1 + probes]
        codes = np.take_along_axis(codes, chosen, axis=1)
        out.append(mix(base[:, None] + mix(codes * np.uint64(2 * tables) + np.uint64(2 * table + 1))))
    return np.concatenate(out, axis=1).view(np.int64)


def _by_size(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) of the usable vectors of a column, by length.

    Usable: not null, without null or non-finite components, and not zero.
    """
    column = column.slice(0)
    offsets = column.offsets.to_numpy().astype(np.int64)
    values = column.values.to_numpy(zero_copy_only=False).astype(np.float64)  # nulls become NaN
    sizes = np.where(column.is_valid().to_numpy(zero_copy_only=False), np.diff(offsets), 0)
    for size in np.unique(sizes[sizes > 0]).tolist():
        rows = np.flatnonzero(sizes == size)
        matrix = values[offsets[rows][:, None] + np.arange(size)]
        good = np.isfinite(matrix).all(axis=1) & (matrix != 0).any(axis=1)
        if good.any():
            yield rows[good], matrix[good] + 0.0  # minus zero becomes zero


def unit(matrix: np.ndarray) -> np.ndarray:
    scaled = matrix / np.abs(matrix).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


VECTORS = "id bigint, label bigint, digest binary, vector binary"


def usable_vectors(table: DataFrame, key: str, embedding: str, label: str) -> DataFrame:
    """(id, label, digest, vector) of every row; digest and vector are null if it can link with nothing."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, labels = batch.column(0), batch.column(2).to_pylist()
            digests, vectors = [None] * len(ids), [None] * len(ids)
            for rows, matrix in _by_size(batch.column(1)):
                for i, vector in zip(rows.tolist(), matrix):
                    if labels[i] is not None and ids[i].is_valid:
                        vectors[i] = vector.tobytes()
                        digests[i] = hashlib.blake2b(vectors[i] + str(labels[i]).encode(), digest_size=16).digest()
            yield pa.RecordBatch.from_arrays(
                [ids, batch.column(2), pa.array(digests, pa.binary()), pa.array(vectors, pa.binary())],
                names=["id", "label", "digest", "vector"])

    return table.select(F.col(key).cast("bigint"), embedding, F.col(label).cast("bigint")).mapInArrow(run, VECTORS)


def _matrix(column: pa.Array) -> np.ndarray:
    """The vectors of one length as rows."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.float64).reshape(len(column), -1)


def _with_keys(classes: DataFrame, tables: int, probes: int) -> DataFrame:
    """Adds `keys`, every bucket that a class enters."""
    schema = classes.select("*", F.lit(None).cast("array<bigint>").alias("keys")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors, labels = batch["vector"], batch["label"].to_numpy()
            sizes = np.array([len(v.as_py()) for v in vectors])
            keys = np.zeros((batch.num_rows, tables * (1 + probes)), dtype=np.int64)
            for size in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == size)
                keys[at] = bucket_keys(unit(_matrix(vectors.take(pa.array(at)))), labels[at], tables, probes)
            bounds = np.arange(batch.num_rows + 1, dtype=np.int32) * keys.shape[1]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.ListArray.from_arrays(pa.array(bounds), pa.array(keys.reshape(-1)))], names=schema.names)

    return classes.mapInArrow(run, schema)


def _join(parent: np.ndarray, pairs: np.ndarray) -> None:
    """Joins the trees of both ends of all pairs; every member keeps pointing at its root."""
    a, b = pairs[:, 0], pairs[:, 1]
    while len(a):
        a, b = parent[a], parent[b]
        apart = a != b
        a, b = a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := parent[parent], parent):
            parent[:] = up


def _share_key(a: np.ndarray, b: np.ndarray, below_a: np.ndarray, below_b: np.ndarray) -> np.ndarray:
    """Which rows of keys `a` have a key in common with which rows of `b`, less than the row's `below` on both sides."""
    (row_a, at_a), (row_b, at_b) = np.nonzero(a < below_a[:, None]), np.nonzero(b < below_b[:, None])
    key_a, key_b = a[row_a, at_a], b[row_b, at_b]
    common = np.intersect1d(key_a, key_b)
    sides = []
    for n, rows, keys in ((len(a), row_a, key_a), (len(b), row_b, key_b)):
        kept = np.isin(keys, common)
        side = np.zeros((n, len(common)), dtype=np.float32)
        side[rows[kept], np.searchsorted(common, keys[kept])] = 1.0
        sides.append(side)
    return sides[0] @ sides[1].T > 0


def _compare(rows: pa.RecordBatch, cosine: float) -> tuple[list[int], list[int], list[int]]:
    """(rep, links, root) of the members of whole parts, compared block by block.

    Blocks run over the borders of parts, so many small ones are one product.  A pair counts only
    in the smallest bucket that both members enter.
    """
    found: tuple[list, list, list] = ([], [], [])
    bucket, part, chunk, reps, copies = (rows.column(i).to_numpy() for i in range(5))
    lengths = pc.binary_length(rows.column(5)).to_numpy()
    keys = rows.column(6).flatten().to_numpy().reshape(len(reps), -1)
    order = np.lexsort((reps, chunk, part, bucket))
    for length in np.unique(lengths).tolist():
        at = order[lengths[order] == length]
        more = _compare_sorted(bucket[at], part[at], chunk[at], reps[at], copies[at],
                               unit(_matrix(rows.column(5).take(pa.array(at)))), keys[at], cosine)
        for out, x in zip(found, more):
            out += x
    return found


def _compare_sorted(bucket: np.ndarray, part: np.ndarray, chunk: np.ndarray, reps: np.ndarray, copies: np.ndarray,
                    units: np.ndarray, keys: np.ndarray, cosine: float) -> tuple[list[int], list[int], list[int]]:
    new = np.ones(len(reps), dtype=bool)
    new[1:] = (bucket[1:] != bucket[:-1]) | (part[1:] != part[:-1])
    starts, group = np.flatnonzero(new), np.cumsum(new) - 1
    # In a part of two chunks only pairs between them count.
    two = (np.minimum.reduceat(chunk, starts) != np.maximum.reduceat(chunk, starts))[group]
    links, parent = np.zeros(len(reps)), np.arange(len(reps))
    for i in range(0, len(reps), BLOCK):
        left = slice(i, i + BLOCK)
        for j in range(i, len(reps), BLOCK):
            right = slice(j, j + BLOCK)
            if group[j] > group[left][-1]:
                break
            close = units[left] @ units[right].T >= cosine
            close &= group[left][:, None] == group[right][None, :]
            close &= ~two[left][:, None] | (chunk[left][:, None] != chunk[right][None, :])
            if i == j:
                close = np.triu(close, 1)
            a, b = np.flatnonzero(close.any(axis=1)), np.flatnonzero(close.any(axis=0))
            if not len(a):
                continue
            close[np.ix_(a, b)] &= ~_share_key(keys[left][a], keys[right][b], bucket[left][a], bucket[right][b])
            links[left] += close @ copies[right]
            links[right] += copies[left] @ close
            _join(parent, np.argwhere(close) + [i, j])
    hit = np.flatnonzero(links)
    return reps[hit].tolist(), links[hit].astype(np.int64).tolist(), reps[parent[hit]].tolist()


def _linked(parts: DataFrame, cosine: float) -> DataFrame:
    """(rep, links, root) from the sorted parts of buckets: those of a batch at a time, and the one it cuts."""
    names = ["bucket", "part", "chunk", "rep", "copies", "vector", "keys"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            buckets, numbers = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            last = np.flatnonzero((buckets != buckets[-1]) | (numbers != numbers[-1]))
            cut = int(last[-1]) + 1 if len(last) else 0
            if held and not cut and (held[0].column(0)[-1].as_py(), held[0].column(1)[-1].as_py()) == (buckets[0], numbers[0]):
                held.append(batch)
                continue
            if held or cut:
                yield _links_batch(_compare(pa.concat_batches([*held, batch.slice(0, cut)]), cosine))
            held = [batch.slice(cut)]
        if held:
            yield _links_batch(_compare(pa.concat_batches(held), cosine))

    return parts.select(*names).repartition("bucket", "part").sortWithinPartitions("bucket", "part").mapInArrow(
        run, "rep bigint, links bigint, root bigint")


def _links_batch(found: tuple[list, list, list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=["rep", "links", "root"])


def near_duplicates(table: DataFrame, key: str = "vec_id", embedding: str = "embedding", label: str = "label",
                    cosine: float = COSINE, tables: int = TABLES, probes: int = PROBES) -> DataFrame:
    """(key, n_links, component_id, kept) for every row of `table`.

    Vectors of one label with a cosine (in double precision) of at least `cosine` are links, as
    far as they share a bucket; recall against all pairs is in the README.  Equal vectors form a
    class that is hashed once and counts with its number of copies.  A bucket of many classes is
    cut into chunks and every pair of chunks compared by itself; only sums and a
    spanning forest leave a task, never pairs.

    Null labels or ids, null or zero vectors, and null or non-finite components link with
    nothing; vectors of different lengths never link.  A null id has a null component and is kept; rows
    that share an id are vectors of their own.
    """
    rows = session.land(usable_vectors(table, key, embedding, label), "vectors")
    classes = session.land(rows.filter("digest is not null").groupBy("digest").agg(
        F.min("id").alias("id"), F.first("label").alias("label"), F.first("vector").alias("vector"),
        F.count(F.lit(1)).alias("copies")).withColumn("rep", F.monotonically_increasing_id()), "classes")
    hashed = session.land(_with_keys(classes.select("rep", "label", "copies", "vector"), tables, probes), "hashed")
    members = hashed.select(F.explode("keys").alias("bucket"), "rep")
    shared = members.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / CHUNK).alias("chunks"), F.count(F.lit(1)).alias("n"))
    placed = members.join(shared.filter("n > 1"), "bucket").withColumn(
        "chunk", F.pmod(F.xxhash64("rep"), F.col("chunks")))
    # Every member meets the others once: in the part of its chunk and each other chunk.
    parts = placed.select("bucket", "rep", "chunk", "chunks", F.explode(
        F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1)).alias("other")).withColumn(
        "part", F.least("chunk", "other") * F.col("chunks") + F.greatest("chunk", "other"))
    found = session.land(_linked(parts.join(hashed, "rep"), cosine), "links")
    component = components(found.select("rep", "root"), "rep", "root")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    grouped = with_component(classes.select("digest", "id", "rep", "copies").join(links, "rep", "left"), "rep", component)
    names = grouped.groupBy("component").agg(F.min("id").alias("component_id"))
    by_digest = grouped.join(names, "component").select(
        "digest", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    out = rows.select("id", "digest").join(by_digest, "digest", "left").select(
        F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        F.coalesce("component_id", "id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(True)))
