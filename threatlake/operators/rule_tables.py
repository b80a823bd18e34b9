"""Rule tables of any size against lines (J1): one automaton over the literals that the rules require.

A rule can only match lines that hold one of its mandatory literals.  All literals
of a table are found in one pass over each line, whatever their number; the
rules' regexes run in the engine and only on the candidates.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark import Broadcast, cloudpickle
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threatlake import catalog, session
from threatlake.functions import text

c = F.col

#: Shorter literals are in too many lines.
LEAST_LITERAL = 3
#: Rules of at most this many bytes are one automaton and one broadcast; longer tables are joined.
PASS_BYTES = 16 << 20
#: Bytes of a run that a line and a rule are joined by; shorter literals go by runs of LEAST_LITERAL.
GRAM = 8
#: The filter of the rules' runs has 2 to this power bits; how often runs occur is counted in classes of their hashes.
FILTER_BITS, COUNT_BITS = 27, 18

_TOKEN = re.compile(r"\\.|\[\^?+(?:[^\]\[\\]|\\.)(?:[^\]\[\\]|\\.)*\]|.", re.DOTALL)
_REPEAT = re.compile(r"(?:[?*]|\+|\{(\d+)(?:,\d*)?\})[?+]?")
#: Constructs that change how the rest is read, or stand for a letter.
_UNREAD = re.compile(r"\(\?[a-z]*x|\\[QExucpPN0k]")
#: The letters beyond ASCII that match an ASCII letter when case is ignored.
FOLDED = ("\u017f\u0131\u0130\u212a", "siik")


def mandatory_literals(pattern: str, least: int = LEAST_LITERAL) -> list[str]:
    """Lower-case strings of which every match of `pattern` holds at least one; none if no such are known.

    One for each branch of the top level: its longest run of plain characters outside groups.
    """
    if _UNREAD.search(pattern):
        return []
    runs, out, run, depth, place = [], [], "", 0, 0
    while place < len(pattern):
        token = _TOKEN.match(pattern, place).group()
        place += len(token)
        if token in ("[", "{"):  # a nested class, or no pattern at all
            return []
        depth += (token == "(") - (token == ")")
        if token == "|" and not depth:
            out.append(max([*runs, run], key=len))
            runs, run = [], ""
            continue
        repeat = None if token in ("(", "|") else _REPEAT.match(pattern, place)
        place += len(repeat.group()) if repeat else 0
        plain = token[-1]
        literal = not depth and " " <= plain <= "~" and (
            not plain.isalnum() if len(token) == 2 else len(token) == 1 and token not in ".^$()|")
        once = repeat is None or repeat.group()[0] == "+" or int(repeat.group(1) or 0) > 0
        if literal and once:
            run += plain.lower()
        if not literal or repeat:
            runs.append(run)
            run = ""
    out.append(max([*runs, run], key=len))
    return out if depth == 0 and min(map(len, out)) >= least else []


def _automaton(patterns: list[str]) -> tuple[ahocorasick.Automaton | None, list[int]]:
    """The automaton of all mandatory literals, each with its rules' numbers, and the rules without any."""
    rules: dict[str, list[int]] = {}
    always = []
    for number, pattern in enumerate(patterns):
        literals = mandatory_literals(pattern)
        for literal in literals:
            rules.setdefault(literal, []).append(number)
        if not literals:
            always.append(number)
    if not rules:
        return None, always
    automaton = ahocorasick.Automaton()
    for literal, numbers in rules.items():
        automaton.add_word(literal, tuple(numbers))
    automaton.make_automaton()
    return automaton, always


def _with_candidates(shared: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Replaces `_folded` by `_rules`, the numbers of the rules that may match."""
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, always = shared.value
        for batch in batches:
            place = batch.schema.get_field_index("_folded")
            found = []
            for line in batch.column(place).to_pylist():
                if line is None:
                    found.append([])
                    continue
                numbers = set(always)
                if automaton is not None:
                    for _, hits in automaton.iter(line):
                        numbers.update(hits)
                found.append(sorted(numbers))
            yield batch.set_column(place, "_rules", pa.array(found, pa.list_(pa.int32())))
    return find


def _size(rules: DataFrame) -> int:
    return rules.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0] or 0


def _with_literals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [mandatory_literals(p) for p in batch.column("pattern").to_pylist()]
        yield batch.append_column("_literals", pa.array(found, pa.list_(pa.string())))


def _grams(values: list[str | None], n: int, used: np.ndarray | None = None) -> list[list[int]]:
    """The distinct runs of `n` bytes of each value, as numbers; only those whose bit is set in `used`."""
    data = [b"" if v is None else v.encode() for v in values]
    ends = np.cumsum([len(b) for b in data])
    every = np.frombuffer(b"".join(data), np.uint8).astype(np.uint64)
    if len(every) < n:
        return [[] for _ in values]
    grams = np.zeros(len(every) - n + 1, np.uint64)
    for i in range(n):
        grams = (grams << np.uint64(8)) | every[i: i + len(grams)]
    starts = np.arange(len(grams))
    owner = np.searchsorted(ends, starts, side="right")
    kept = starts + n <= ends[owner]
    if used is not None:
        bits = _bit(grams)
        kept &= (used[bits >> 3] >> (bits & 7).astype(np.uint8)) & 1 == 1
    out: list[list[int]] = [[] for _ in values]
    owner, grams = owner[kept], grams[kept]
    order = np.lexsort((grams, owner))
    owner, grams = owner[order], grams[order].astype(np.int64)
    fresh = np.concatenate([[True], (owner[1:] != owner[:-1]) | (grams[1:] != grams[:-1])])[: len(owner)]
    for i, gram in zip(owner[fresh].tolist(), grams[fresh].tolist(), strict=True):
        out[i].append(gram)
    return out


def _bit(grams: np.ndarray) -> np.ndarray:
    return ((grams.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def _chosen(counts: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One row for each literal of a rule: its gram that the fewest rules have, and the literals before it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = counts.value
        for batch in batches:
            rows, literals, earlier, sizes, grams, bits = [], [], [], [], [], []
            for i, listed in enumerate(batch.column("_literals").to_pylist()):
                for k, literal in enumerate(listed):
                    n = GRAM if len(literal) >= GRAM else LEAST_LITERAL
                    own = np.array(_grams([literal], n)[0], np.int64)
                    gram = own[np.argmin(often[_bit(own) >> (FILTER_BITS - COUNT_BITS)])]
                    rows.append(i), literals.append(literal), earlier.append(listed[:k]), sizes.append(n)
                    grams.append(int(gram)), bits.append(int(_bit(own[:1] * 0 + gram)[0]))
            kept = batch.drop_columns(["_literals"]).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*kept.columns, pa.array(literals, pa.string()), pa.array(earlier, pa.list_(pa.string())), pa.array(sizes, pa.int32()),
                 pa.array(grams, pa.int64()), pa.array(bits, pa.int64())],
                [*kept.schema.names, "_literal", "_earlier", "_size", "_gram", "_bit"])
    return run


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many literals of a task have a gram of each class of hashes."""
    counts = np.zeros(1 << COUNT_BITS, np.int64)
    for batch in batches:
        literals = [x for listed in batch.column("_literals").to_pylist() for x in listed]
        for n, some in ((GRAM, [x for x in literals if len(x) >= GRAM]), (LEAST_LITERAL, [x for x in literals if len(x) < GRAM])):
            own = np.array([g for listed in _grams(some, n) for g in listed], np.int64)
            np.add.at(counts, _bit(own) >> (FILTER_BITS - COUNT_BITS), 1)
    (found,) = np.nonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(counts[found])], ["cell", "n"])


def _line_grams(used: Broadcast, n: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _grams(batch.column("_folded").to_pylist(), n, used.value)
            yield batch.append_column("_grams", pa.array(found, pa.list_(pa.int64())))
    return run


def _joined_hits(kept: DataFrame, rules: DataFrame) -> DataFrame:
    """`table_hits` of a table that is too long for one pass: lines and rules meet by runs of bytes.

    Each literal is known by its gram that the fewest rules have; lines have a row for each of their
    grams that is some rule's.  A pair counts at the first of the rule's literals that the line holds.
    """
    spark = kept.sparkSession

    def schema(df: DataFrame, more: str) -> str:
        return ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields] + [more])

    # Tables are often narrow enough to lie in one partition, and long enough to keep every core busy.
    spread = rules.repartition(spark.sparkContext.defaultParallelism)
    listed = session.land(spread.mapInArrow(_with_literals, schema(rules, "_literals array<string>")), "rule-literals")
    counts = np.zeros(1 << COUNT_BITS, np.int64)
    for row in listed.select("_literals").mapInArrow(_gram_counts, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[row.cell] = row.n
    chosen = session.land(listed.mapInArrow(_chosen(spark.sparkContext.broadcast(counts)), schema(
        rules, "_literal string, _earlier array<string>, _size int, _gram bigint, _bit bigint")), "rule-grams")
    hit = F.when(text.is_plain_ascii(c("line")), F.rlike("line", F.concat(F.lit(catalog.FLAGS), "pattern"))).otherwise(
        F.rlike("line", F.concat(F.lit(catalog.UNICODE_FLAGS), "pattern")))
    # Landed, so that the engine knows their size and sends few of them to the tasks.
    always = session.land(listed.filter(F.size("_literals") == 0).drop("_literals"), "rules-always")
    out = kept.crossJoin(always).filter(hit)
    folded = kept.withColumn("_folded", F.lower(F.translate("line", *FOLDED)))
    for n in (GRAM, LEAST_LITERAL):
        sized = chosen.filter(c("_size") == n)
        used = np.zeros((1 << FILTER_BITS) // 8, np.uint8)
        for row in sized.select((c("_bit") / 8).cast("bigint").alias("byte"), F.expr("shiftleft(1, cast(_bit % 8 as int))").alias("bit")).groupBy(
                "byte").agg(F.bit_or("bit").alias("bits")).toLocalIterator():
            used[row.byte] = row.bits
        grams = folded.mapInArrow(_line_grams(spark.sparkContext.broadcast(used), n), schema(folded, "_grams array<bigint>"))
        pairs = grams.withColumn("_gram", F.explode("_grams")).drop("_grams").join(sized, "_gram")
        first = c("_folded").contains(c("_literal")) & ~F.exists("_earlier", lambda x: c("_folded").contains(x))
        out = out.unionByName(pairs.filter(first & hit).select(*kept.columns, *rules.columns))
    return out


def _check_patterns(rules: DataFrame) -> None:
    """Raises ValueError if the engine cannot run one of the patterns; one job for all."""
    try:
        rules.filter(F.rlike(F.lit(""), F.concat(F.lit(catalog.FLAGS), "pattern"))).count()
    except (PySparkException, Py4JJavaError) as error:
        raise ValueError(f"Invalid regex pattern in the rule table: {error}") from error


def table_hits(lines: DataFrame, rules: DataFrame, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """One row per (line, matching rule): the line's columns and the rule's, which are any with `pattern`.

    Patterns are read as those of the catalogue (any case, Unicode on lines that are not ASCII).
    The plan does not grow with the rules.  Only rules of `pass_bytes` together are read by the
    client and sent to the tasks at once; a longer table stays distributed and meets the lines in
    a join on runs of bytes of the literals.  Rules without a mandatory literal run on every line.  Null lines and null
    patterns match nothing, repeated rows of either side match each by itself, and columns of the
    lines that the rules have too are replaced.
    """
    rules = rules.filter("pattern is not null")
    _check_patterns(rules)
    spark = lines.sparkSession
    kept = lines.drop(*[name for name in rules.columns if name != "line"])
    long = _size(rules) > pass_bytes
    rules = rules.drop("line")
    if long:
        return _joined_hits(kept, rules)
    folded = F.lower(F.translate("line", *FOLDED))
    staged = kept.withColumn("_folded", folded)
    listed = rules.collect()
    shared = spark.sparkContext.broadcast(_automaton([row["pattern"] for row in listed]))
    candidates = staged.mapInArrow(_with_candidates(shared), staged.drop("_folded").withColumn(
        "_rules", F.lit(None).cast("array<int>")).schema)
    numbered = spark.createDataFrame([(i, *row) for i, row in enumerate(listed)], "_rule int, " + ", ".join(
        f"`{f.name}` {f.dataType.simpleString()}" for f in rules.schema.fields))
    pairs = candidates.withColumn("_rule", F.explode("_rules")).drop("_rules").join(F.broadcast(numbered), "_rule")
    hit = F.when(text.is_plain_ascii(c("line")), F.rlike("line", F.concat(F.lit(catalog.FLAGS), "pattern"))).otherwise(
        F.rlike("line", F.concat(F.lit(catalog.UNICODE_FLAGS), "pattern")))
    return pairs.filter(hit).drop("_rule")


# The steps travel with their code: workers need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
