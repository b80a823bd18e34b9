"""Near-duplicate documents: circulant MinHash, banding, exact Jaccard verification."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threatlake import session
from threatlake.llm.components import components, with_component
from threatlake.llm.textops import Hasher, mix, text_chunks, windows, words_of

#: Words in a shingle.
SHINGLE = 5
#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 75
#: A pair at the limit shares no band with probability (1 - 0.75 ** 5) ** 32 = 0.0002.
BANDS, ROWS = 32, 5
#: Members compared with one center by one task at a time, and members of a band that meet, twice over.
MEMBERS, CHUNK = 64, 256
#: Shingles whose occurrences are multiplied at once.
COLUMNS = 8192


def scramble(x: np.ndarray, first: int, second: int) -> np.ndarray:
    """A permutation of the 32-bit numbers."""
    x = x ^ (x >> np.uint32(16))
    x *= np.uint32(first)
    x ^= x >> np.uint32(13)
    x *= np.uint32(second)
    x ^= x >> np.uint32(16)
    return x


def shingle_sets(data: np.ndarray, offsets: np.ndarray, hasher: Hasher) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one text after the other, and their number.

    A text of fewer than SHINGLE words has one shingle, the whole sequence; one without words none.
    """
    words = words_of(data, offsets, hasher)
    hashes, first = windows(words, SHINGLE)
    owner = words.owner[first]
    short = np.flatnonzero((words.counts > 0) & (words.counts < SHINGLE))
    if len(short):
        begins = np.concatenate([[0], np.cumsum(words.counts)])
        whole = [mix(np.array([sum(int(h) * (2 * k + 3) ** 9 for k, h in enumerate(
            words.hashes[begins[i]: begins[i + 1]])) + int(words.counts[i]) & (1 << 64) - 1], dtype=np.uint64))[0]
            for i in short]
        owner = np.concatenate([owner, short])
        hashes = np.concatenate([hashes, np.array(whole, dtype=np.uint64)])
    order = np.lexsort((hashes, owner))
    owner, hashes = owner[order], hashes[order]
    new = np.ones(len(owner), dtype=bool)
    new[1:] = (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])
    return hashes[new], np.bincount(owner[new], minlength=len(offsets) - 1)


def signatures(hashes: np.ndarray, sizes: np.ndarray, coordinates: int) -> np.ndarray:
    """Circulant MinHash of sets that are not empty, one row each.

    One permutation scatters the shingles; the other, shifted by k around the circle of
    32-bit numbers, ranks them for coordinate k.
    """
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    scattered = scramble((hashes >> np.uint64(32)).astype(np.uint32), 0x7FEB352D, 0x846CA68B)
    out = np.empty((len(sizes), coordinates), dtype=np.uint32)
    for k in range(coordinates):
        ranks = scramble(scattered - np.uint32(k), 0x21F0AAAD, 0xD35A2D97)
        out[:, k] = np.minimum.reduceat(ranks, starts)
    return out


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key for each band; its number is part of it."""
    parts = signature.reshape(len(signature), bands, rows).astype(np.uint64)
    keys = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(signature), bands)).copy()
    for j in range(rows):
        keys = mix(keys + parts[:, :, j])
    return keys.view(np.int64)


def sketch(docs: DataFrame, key: str = "doc_id", text: str = "text", bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(key, n_shingles, digest, keys): size and digest of the shingle set, and its band keys.

    A document without shingles has a null digest and no keys.
    """
    schema = f"`{key}` bigint, n_shingles bigint, digest binary, keys array<bigint>"
    names = [key, "n_shingles", "digest", "keys"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(lower=True)
        for batch in batches:
            for first, end, data, offsets in text_chunks(batch.column(1)):
                hashes, sizes = shingle_sets(data, offsets, hasher)
                ends = np.cumsum(sizes)
                digests = [hashlib.blake2b(hashes[e - n: e].tobytes(), digest_size=16).digest() if n else None
                           for n, e in zip(sizes, ends)]
                full = sizes > 0
                keys = band_keys(signatures(hashes, sizes[full], bands * rows), bands, rows) if full.any() else np.zeros(
                    0, dtype=np.int64)
                bounds = np.concatenate([[0], np.cumsum(full * bands)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(first, end - first), pa.array(sizes), pa.array(digests, pa.binary()),
                    pa.ListArray.from_arrays(pa.array(bounds), pa.array(keys.reshape(-1)))], names=names)

    return docs.select(F.col(key).cast("bigint"), text).mapInArrow(run, schema)


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if 100 * len(small) < percent * len(large):
        return False
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    common = int(np.count_nonzero(large[at] == small))
    return 100 * common >= percent * (len(a) + len(b) - common)


def verify(pairs: DataFrame, texts: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) whose whole shingle sets are similar enough; `texts` has (doc, text).

    A center with many partners is compared in several tasks, MEMBERS partners each; its text
    goes first in a sorted stream of its partners' texts, so a task holds one set at a time.
    """
    counts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / MEMBERS).alias("parts"))
    dealt = pairs.join(counts, "a").withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts")))
    wanted = dealt.select("a", "part", F.lit(False).alias("member"), F.col("a").alias("doc")).distinct().union(
        dealt.select("a", "part", F.lit(True), "b"))
    stream = wanted.join(texts, "doc").select("a", "part", "member", "doc", "text").repartition(
        "a", "part").sortWithinPartitions("a", "part", "member")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, at, center = Hasher(lower=True), None, []
        for batch in batches:
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(4))))
            found: list[tuple[int, int]] = []
            for first, end, data, offsets in text_chunks(batch.column(4)):
                hashes, sizes = shingle_sets(data, offsets, hasher)
                sets = np.split(hashes, np.cumsum(sizes)[:-1])
                for (a, part, member, doc), own in zip(keys[first:end], sets):
                    if member:
                        if any(_linked(x, own, percent) for x in center if len(own)):
                            found.append((a, doc))
                    elif at == (a, part):
                        center.append(own.copy())
                    else:
                        at, center = (a, part), [own.copy()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[i] for x in found], pa.int64()) for i in range(2)], names=["a", "b"])

    return stream.mapInArrow(run, "a bigint, b bigint")


def common_shingles(sets: list[np.ndarray]) -> np.ndarray:
    """Exact sizes of all intersections: products of blocks of the occurrence matrix."""
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, place, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    several = counts > 1
    column = np.where(several, np.cumsum(several) - 1, -1)[place]
    owner, column = owner[column >= 0], column[column >= 0]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((len(sets), len(sets)), dtype=np.float32)
    for first in range(0, int(several.sum()), COLUMNS):
        a, b = np.searchsorted(column, [first, first + COLUMNS])
        block = np.zeros((len(sets), COLUMNS), dtype=np.float32)
        block[owner[a:b], column[a:b] - first] = 1.0
        out += block @ block.T
    return out


def _forest(docs: list[int], sets: list[np.ndarray], own: list[int], percent: int) -> list[tuple[int, int]]:
    """Links that join what is not in one component yet, fewer than there are documents."""
    sizes = np.array([len(x) for x in sets], dtype=np.float64)
    common = common_shingles(sets).astype(np.float64)
    close = 100 * common >= percent * (sizes[:, None] + sizes[None, :] - common)
    label = {c: c for c in own}

    def root(x: int) -> int:
        while label[x] != x:
            label[x] = label[label[x]]
            x = label[x]
        return x

    found = []
    codes = np.unique(np.array(own), return_inverse=True)[1]
    for i, j in np.argwhere(np.triu(close & (codes[:, None] != codes[None, :]), 1)).tolist():
        a, b = root(own[i]), root(own[j])
        if a != b:
            label[max(a, b)] = min(a, b)
            found.append((docs[i], docs[j]))
    return found


def link_parts(parts: DataFrame, texts: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Links (a, b) between components among the documents (band, part, doc, own) that meet in a part.

    Parts come one after the other in a sorted stream, at most two chunks of documents each; all
    their pairs are compared on whole sets, and only a forest leaves the task.
    """
    stream = parts.join(texts, "doc").select("band", "part", "doc", "own", "text").repartition(
        "band", "part").sortWithinPartitions("band", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, at = Hasher(lower=True), None
        docs, sets, own = [], [], []
        for batch in batches:
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(4))))
            found: list[tuple[int, int]] = []
            for first, end, data, offsets in text_chunks(batch.column(4)):
                hashes, sizes = shingle_sets(data, offsets, hasher)
                for (band, part, doc, component), one in zip(keys[first:end], np.split(hashes, np.cumsum(sizes)[:-1])):
                    if at != (band, part):
                        found += _forest(docs, sets, own, percent) if docs else []
                        at, docs, sets, own = (band, part), [], [], []
                    if len(one):
                        docs.append(doc)
                        sets.append(one.copy())
                        own.append(component)
            yield _pairs_batch(found)
        if docs:
            yield _pairs_batch(_forest(docs, sets, own, percent))

    return stream.mapInArrow(run, "a bigint, b bigint")


def _pairs_batch(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in range(2)], names=["a", "b"])


def _sized(pairs: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """Pairs whose set sizes allow the similarity; the others cannot reach it."""
    out = pairs
    for side in ("a", "b"):
        out = out.join(sizes.select(F.col("rep").alias(side), F.col("n_shingles").alias(f"n_{side}")), side)
    return out.filter(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)").select("a", "b")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """(key, n_shingles, component_id, kept) for every row of `docs`.

    Documents with equal sets form a class, named by its smallest id; classes that share a
    band are candidates.  First every class is verified against one class of each of its bands,
    another one in every band.  Then the bands whose members are still in several components are
    compared in full, chunk by chunk.  Pairs inside one component need no check, so components
    are those of all verified links.

    A text without words, also a null one, links with nothing.  A row with a null id links with
    nothing, has a null component and is kept.  Rows that share an id are one node.  Other columns
    are not read.
    """
    rows = session.land(sketch(docs, key, text), "sketches").withColumnRenamed(key, "id")
    usable = rows.filter("digest is not null and id is not null")
    reps = session.land(usable.groupBy("digest").agg(
        F.min("id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("keys").alias("keys")), "classes")
    members = reps.select("rep", F.explode("keys").alias("band"))
    # The keys are random, so the least exclusive or picks any member.
    centers = members.groupBy("band").agg(
        F.min(F.col("rep").bitwiseXOR(F.col("band"))).alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = session.land(members.join(centers, "band").select(
        "band", "rep", "n", F.col("least").bitwiseXOR(F.col("band")).alias("center")), "bands")
    # The candidates grow with the documents, so both sides are shuffled at any size.
    texts = docs.select(F.col(key).cast("bigint").alias("doc"), F.col(text).alias("text")).filter("doc is not null")
    texts = session.land(texts.join(shared.select(F.col("rep").alias("doc")).distinct().hint("merge"), "doc"), "texts")

    pairs = shared.filter("rep <> center").select(
        F.least("rep", "center").alias("a"), F.greatest("rep", "center").alias("b")).distinct()
    pairs = session.land(_sized(pairs, reps.select("rep", "n_shingles"), percent), "pairs")
    links = session.land(verify(pairs, texts, percent), "links")
    found = components(links)

    # In a band of two the only pair has been compared.
    placed = with_component(shared.filter("n > 2").select("band", "rep"), "rep", found)
    open_bands = placed.groupBy("band").agg(
        F.min("component").alias("low"), F.max("component").alias("high"), F.ceil(F.count(F.lit(1)) / CHUNK).alias("chunks")).filter(
        "low <> high").select("band", "chunks")
    chunked = placed.join(open_bands, "band").withColumn("chunk", F.pmod(F.xxhash64("rep"), F.col("chunks")))
    parts = chunked.select("band", F.col("rep").alias("doc"), F.col("component").alias("own"), "chunk", "chunks", F.explode(
        F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1)).alias("other")).select(
        "band", "doc", "own", (F.least("chunk", "other") * F.col("chunks") + F.greatest("chunk", "other")).alias("part"))
    more = session.land(link_parts(parts, texts, percent), "links")
    found = session.land(components(links.union(more)), "components")

    classes = with_component(reps.select("digest", "rep"), "rep", found).select("digest", "component")
    out = rows.join(classes, "digest", "left").select(
        F.col("id").alias(key), "n_shingles",
        F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row of each group of near duplicates, the one of the smallest id, with the columns of `docs`.

    Rows that share an id are one document, of which one row stays; rows with a null id all stay.
    """
    dropped = near_duplicates(docs, key, text, percent).filter("not kept").select(F.col(key).alias("_dropped")).distinct()
    named = docs.filter(F.col(key).isNotNull())
    left = named.join(dropped, named[key] == dropped["_dropped"], "left_anti").dropDuplicates([key])
    return left.union(docs.filter(F.col(key).isNull()))
