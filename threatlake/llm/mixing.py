"""Mixing sources to target weights: blocks of words, drawn source counts, permuted indexes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threatlake import session

#: Words in a block, slots in an output shard, times that a block may be taken.
BLOCK_WORDS = 128
SHARD_SLOTS = 4096
MAX_EPOCHS = 3
#: Weights of the sources in order of code points, null last, repeating.
WEIGHTS = (1, 2, 3)
#: Documents whose running sums one task computes.
BUCKET_DOCUMENTS = 5_000
#: Rounds of the index permutations.
ROUNDS = 8

c = F.col


def words_in(text: Column) -> Column:
    """Number of runs of characters outside 0x20 and 0x09-0x0D; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target) for each source of rows (source, size).

    The weights share all words; a source stops at MAX_EPOCHS times its size and the excess is
    shared again by weight.  That is the one level for which min(cap, level * weight) adds up to
    all words: sources fill up in the order of cap / weight.  One row per source is ordered
    here, never documents.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(c("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (place % len(WEIGHTS) + 1).cast("int")).cast("double")
    ranked = sources.select("source", "source_size", weight.alias("weight"), (MAX_EPOCHS * c("source_size")).cast("double").alias("cap"))
    order = Window.orderBy(c("cap") / c("weight"), c("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    # The level if exactly the sources before this one are full.
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    found = ranked.withColumn("level", level).withColumn("open", c("level") * c("weight") <= c("cap"))
    shared = F.min(F.when(c("open"), F.struct(c("cap") / c("weight"), c("level")))).over(everything)
    return found.withColumn("shared", shared["level"]).select(
        "source", "source_size", "weight", F.least("cap", F.coalesce(c("shared") * c("weight"), c("cap"))).alias("target"))


def _number(seed: int, *parts: Column) -> Column:
    """A pseudorandom number from 0 up to 2 ** 31."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *parts), 33)


def permuted(index: Column, n: Column, seed: int, key: Column) -> Column:
    """A pseudorandom permutation of 0..n-1 for each key: rounds of swap-or-not.

    Each round pairs x with its mirror image k - x and swaps the pair or not by a draw that both
    members see, so every round is a permutation and so is their chain.
    """
    def swap(x: Column, step: Column) -> Column:
        other = F.pmod(_number(seed, step, key, n) - x, n)
        return F.when(_number(seed, step, key, F.greatest(x, other)) % 2 == 0, other).otherwise(x)

    return F.aggregate(F.array(*(F.lit(r) for r in range(ROUNDS))), index.cast("bigint"), swap)


def _numbered(docs: DataFrame, kept: list[str], text: str, source: str, order: list[str]) -> DataFrame:
    """(row, source, size, order, kept_0, ...): the documents with a number of their own, written once."""
    return session.land(docs.select(
        F.monotonically_increasing_id().alias("row"), c(source).alias("source"), words_in(c(text)).alias("size"),
        F.xxhash64(*order).alias("order"), *(c(f"`{n}`").alias(f"kept_{i}") for i, n in enumerate(kept))), "numbered")


def positions(numbered: DataFrame) -> DataFrame:
    """(row, source, size, start): the documents of a source end to end, in a fixed order.

    Running sums are computed inside buckets of about BUCKET_DOCUMENTS documents and carried
    over buckets through their totals, so no source meets in one task.
    """
    buckets = max(1, -(-numbered.count() // BUCKET_DOCUMENTS))
    rows = numbered.select("row", "source", "size", "order", F.pmod("order", F.lit(buckets)).alias("bucket"))
    inside = Window.partitionBy("source", "bucket").orderBy("order", "row").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("source", "bucket").agg(F.sum("size").alias("total"))
    ahead = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("source", "bucket", F.coalesce(F.sum("total").over(ahead), F.lit(0)).alias("offset"))
    placed = rows.withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    joined = placed.alias("p").join(offsets.alias("o"), (c("p.bucket") == c("o.bucket")) & c("p.source").eqNullSafe(c("o.source")))
    return joined.select("p.row", "p.source", "p.size", (c("p.before") + c("o.offset")).alias("start"))


def draw(targets: DataFrame, seed: int, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """(shard, source, n): how many slots of each output shard every source gets.

    Multinomial draws over the shards given the totals: each source is due target / source_size
    uses of each of its blocks, and the slots of all sources are dealt to shards by a
    pseudorandom permutation of the slot numbers.  Free draws would miss small sources' targets
    by the square root of their blocks.
    """
    due = targets.filter("source_size > 0").select(
        "source", "source_size", "target", F.ceil(c("source_size") / block_words).alias("blocks"))
    due = due.withColumn("uses", F.least(
        F.round(c("target") / c("source_size") * c("blocks")).cast("bigint"), MAX_EPOCHS * c("blocks"))).filter("uses > 0")
    slots = int(due.agg(F.coalesce(F.sum("uses"), F.lit(0))).first()[0])
    order = Window.orderBy(c("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    lines = due.withColumn("from", F.coalesce(F.sum("uses").over(order), F.lit(0)))
    # A slot looks up the source of its permuted number in cells of the number line.
    cell = max(1, slots // 1024)
    cells = lines.select("source", "from", (c("from") + c("uses")).alias("to"), F.explode(F.sequence(
        F.floor(c("from") / cell), F.floor((c("from") + c("uses") - 1) / cell))).alias("cell"))
    spark = targets.sparkSession
    numbers = spark.range(slots).select("id", permuted(c("id"), F.lit(slots), seed, F.lit(0)).alias("number")).withColumn(
        "cell", F.floor(c("number") / cell))
    drawn = numbers.join(cells, "cell").filter("number >= `from` and number < `to`")
    return drawn.groupBy(F.floor(c("id") / shard_slots).alias("shard"), "source").agg(F.count(F.lit(1)).alias("n"))


def _slots(targets: DataFrame, seed: int, block_words: int, shard_slots: int) -> DataFrame:
    """(shard, source, slot, epoch, block): every slot of the mix and the block it takes."""
    counts = session.land(draw(targets, seed, block_words, shard_slots), "counts")
    ahead = Window.partitionBy("source").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    numbered = counts.withColumn("first", F.coalesce(F.sum("n").over(ahead), F.lit(0)))
    blocks = targets.select(c("source").alias("s"), F.ceil(c("source_size") / block_words).alias("blocks"))
    # The counts are few, the slots they open many: deal them out first, whatever their source.
    dealt = numbered.join(blocks, c("source").eqNullSafe(c("s"))).repartition(
        int(targets.sparkSession.conf.get("spark.sql.shuffle.partitions")), "shard", "source")
    slots = dealt.select(
        "shard", "source", "blocks", F.explode(F.sequence(c("first"), c("first") + c("n") - 1)).alias("slot"))
    return slots.select(
        "shard", "source", "slot", F.floor(c("slot") / c("blocks")).alias("epoch"),
        permuted(c("slot") % c("blocks"), c("blocks"), seed + 1, c("source")).alias("block"))


def _pieces(placed: DataFrame, block_words: int) -> DataFrame:
    """One row for each block that a document reaches into: words [begin, end) of the document."""
    last = F.floor((c("start") + c("size") - 1) / block_words)
    rows = placed.filter("size > 0").select("*", F.explode(F.sequence(F.floor(c("start") / block_words), last)).alias("block"))
    begin = F.greatest(c("block") * block_words - c("start"), F.lit(0))
    end = F.least((c("block") + 1) * block_words - c("start"), c("size"))
    return rows.select("row", "source", "block", begin.alias("begin"), end.alias("end"))


def _by_block(pieces: DataFrame, slots: DataFrame) -> DataFrame:
    # Slots are opened from few counts, so their size is underrated; they grow with the words.
    return pieces.alias("p").join(
        slots.hint("merge").alias("u"), (c("p.block") == c("u.block")) & c("p.source").eqNullSafe(c("u.source")))


def taken(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = 1,
          block_words: int = BLOCK_WORDS) -> DataFrame:
    """(key, size, source_size, target, taken) for each row of `docs`.

    `taken` counts the document's words in the mix, repeats included; a block is taken at most
    MAX_EPOCHS times, so no document exceeds that multiple of its size.  Null texts have size 0
    and take 0; null sources are one source, the last; repeated rows are documents of their own;
    same input and seed, same mix.  Other columns are not read.
    """
    numbered = _numbered(docs, [key], text, source, [key, text])
    placed = session.land(positions(numbered), "positions")
    targets = session.land(source_targets(placed), "targets")
    slots = _slots(targets, seed, block_words, SHARD_SLOTS)
    uses = slots.groupBy("source", "block").agg(F.count(F.lit(1)).alias("uses"))
    sums = _by_block(_pieces(placed, block_words), uses).groupBy("row").agg(
        F.sum((c("end") - c("begin")) * c("uses")).alias("taken"))
    rows = numbered.select("row", "kept_0", "source", "size").join(sums, "row", "left")
    rows = rows.join(targets.select(c("source").alias("s"), "source_size", "target"), c("source").eqNullSafe(c("s")))
    return rows.select(c("kept_0").alias(key), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"))


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", length: str | None = None,
        seed: int = 1, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The mix itself: a row for every piece of a document in every slot, with the columns of `docs`.

    `text` holds the piece with its own white space, `length` (if named) its number of
    characters.  A block over several documents gives a piece of each.  Edge cases as in `taken`;
    documents without words are in no block.
    """
    numbered = _numbered(docs, docs.columns, text, source, [key, text])
    kept = [f"kept_{i}" for i in range(len(docs.columns))]
    placed = session.land(positions(numbered), "positions")
    targets = session.land(source_targets(placed), "targets")
    slots = _slots(targets, seed, block_words, SHARD_SLOTS)
    pieces = _by_block(_pieces(placed, block_words), slots).groupBy("row").agg(
        F.collect_list(F.struct("begin", "end", "slot")).alias("pieces"))
    space = r"[\x20\x09-\x0D]"
    begun = F.regexp_replace(c(kept[docs.columns.index(text)]), f"^{space}+", "")
    # A generator keeps the split from being repeated for each piece.
    split = numbered.join(pieces, "row").select(*kept, "pieces", F.explode(F.array(F.split(
        begun, f"(?<={space})(?={space.replace('[', '[^')})"))).alias("words"))
    cut = split.select(*kept, F.explode(F.transform("pieces", lambda p: F.array_join(
        F.slice(c("words"), (p["begin"] + 1).cast("int"), (p["end"] - p["begin"]).cast("int")), ""))).alias("piece"))
    new = {text: c("piece"), **({length: F.length("piece").cast(docs.schema[length].dataType)} if length else {})}
    return cut.select(*(new.get(n, c(k)).alias(n) for n, k in zip(docs.columns, kept)))
