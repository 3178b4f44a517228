"""Records of delimited text whose quoted values hold line breaks, from split files.

Whether a line begins a record depends on all lines before it, but a line does only one of
four things to that: begun outside quotes or inside, it ends outside or inside. Such
functions can be composed in any grouping, so each byte range of a file is reduced to one
of them where it is read, a running composition over one row per range gives the state in
which each range begins, and a second pass cuts every range into records by itself. Only
what crosses an end of a range, at most two pieces for each, is put together after a
shuffle.

A quote opens a value only as its first character and is doubled inside; one in the middle
of a value is text (5" pipe) and changes nothing. After a closing quote, text up to the
next delimiter belongs to the value. Lines end with \\n or \\r\\n.
"""

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# What a line does: the state behind it is bit 0 if it began outside quotes, bit 1 if inside.
CLOSES, SWAPS, STAYS, OPENS = range(4)
INSIDE = r'[^"]*+(?:""[^"]*+)*+'


def lines_of(spark: SparkSession, paths: Sequence[str], encoding: str = "utf-8") -> DataFrame:
    """file, block, line: blocks are the byte ranges that tasks read, with lines in order."""
    text = F.col("value")
    if encoding.lower().replace("-", "").replace("_", "") not in ("utf8", "usascii", "ascii"):
        text = F.decode(text.cast("binary"), encoding)
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")]
    return spark.read.text(list(paths), lineSep="\n").select(*place, text.alias("line"))


def line_function(line: Column, delimiter: str) -> Column:
    """The number of what the line does. Repetitions are possessive: they neither go back
    nor recurse, however long the line."""
    sep = re.escape(delimiter)
    other = f"[^{sep}]*+" if len(delimiter) == 1 else f"(?:(?!{sep}).)*+"
    # Whole values with their delimiters, then one whose quote is not closed.
    opened = f'(?:(?:"{INSIDE}"{other}|(?!"){other}){sep})*+"{INSIDE}\\z'
    begun_inside = f'(?s)\\A{INSIDE}(?:\\z|"{other}{sep}{opened})'
    opened = f"(?s)\\A{opened}"
    ends = F.when(F.rlike(line, F.lit(opened)), 1).otherwise(0) + F.when(F.rlike(line, F.lit(begun_inside)), 2).otherwise(0)
    return F.when(F.contains(line, F.lit('"')), ends).otherwise(STAYS)


def _states(functions: np.ndarray, start: int) -> np.ndarray:
    """The state before each line and behind the last one."""
    n = len(functions)
    fixed = np.maximum.accumulate(np.where((functions == CLOSES) | (functions == OPENS), np.arange(n), -1))
    swaps = np.concatenate([[0], np.cumsum(functions == SWAPS)])
    known = np.where(fixed >= 0, functions[np.maximum(fixed, 0)] == OPENS, start)
    since = swaps[1:] - np.where(fixed >= 0, swaps[np.maximum(fixed, 0) + 1], 0)
    return np.concatenate([[start], (known + since) % 2]).astype(np.int64)


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[str, int, int, int]]:
    """(file, block, from, to) of the batch's rows, which are in order."""
    blocks = batch.column("block").to_numpy()
    codes = batch.column("file").dictionary_encode()
    files = codes.indices.to_numpy()
    edges = np.flatnonzero((np.diff(blocks) != 0) | (np.diff(files) != 0)) + 1
    bounds = [0, *edges.tolist(), batch.num_rows]
    for a, b in zip(bounds, bounds[1:], strict=False):
        if b > a:
            yield codes.dictionary[files[a]].as_py(), int(blocks[a]), a, b


def files_with_line_breaks(lines: DataFrame, delimiter: str) -> list[str]:
    """The files in which some line that begins outside quotes ends inside; in all others
    every line is a record (the first line that did otherwise would be such a one)."""
    opened = line_function(F.col("line"), delimiter).isin(SWAPS, OPENS)
    return [r["file"] for r in lines.where(opened).select("file").distinct().collect()]


def ranges(lines: DataFrame, delimiter: str) -> DataFrame:
    """A row per byte range: file, block, what it does to the state, and whether a record
    begins in it if it is begun inside quotes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], list[int]] = {}
        for batch in batches:
            functions = batch.column("does").to_numpy().astype(np.int64)
            for file, block, a, b in _runs(batch):
                now = held.setdefault((file, block), [0, 1, 0])
                part = functions[a:b]
                inside = _states(part, now[1])
                now[2] |= int((inside[:-1] == 0).any())
                now[0], now[1] = int(_states(part, now[0])[-1]), int(inside[-1])
        rows = [(f, b, x[0] + 2 * x[1], bool(x[2])) for (f, b), x in held.items()]
        columns = list(zip(*rows, strict=True)) or [[]] * 4
        kinds = [pa.string(), pa.int64(), pa.int32(), pa.bool_()]
        names = ["file", "block", "does", "begins"]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    does = lines.select("file", "block", line_function(F.col("line"), delimiter).alias("does"))
    return does.mapInArrow(run, "file string, block bigint, does int, begins boolean")


def begun(found: DataFrame) -> DataFrame:
    """For each byte range the state it begins in, and the range in which its first line's
    record began. The windows hold one row per range of a file."""
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    upto = earlier.rowsBetween(Window.unboundedPreceding, 0)
    does = F.col("does")
    counted = found.withColumn("swaps", F.sum((does == SWAPS).cast("long")).over(upto))
    fixed = F.when(does.isin(CLOSES, OPENS), F.struct((does == OPENS).cast("long").alias("state"), "swaps"))
    last = F.last(fixed, ignorenulls=True).over(earlier)
    before = F.coalesce(F.lag("swaps").over(Window.partitionBy("file").orderBy("block")), F.lit(0))
    state = (F.coalesce(last["state"], F.lit(0)) + before - F.coalesce(last["swaps"], F.lit(0))) % 2
    stated = counted.withColumn("start", state.cast("int"))
    origin = F.when((F.col("start") == 0) | F.col("begins"), F.col("block"))
    return stated.select("file", "block", "start", F.coalesce(F.last(origin, ignorenulls=True).over(earlier), "block").alias("origin"))


def records(lines: DataFrame, found: DataFrame, delimiter: str) -> DataFrame:
    """file, first (of its file) and record, from all lines and their ``ranges``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The record that is open where a batch ends: its place, kind and text so far.
        file, block, origin, state, count = "", -1, 0, 0, 0
        pending: list[str] | None = None
        own = False

        def batch_of(texts: pa.Array, origins: list[int], firsts: list[bool], whole: bool) -> pa.RecordBatch:
            n = len(texts)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([file] * n, pa.string()), pa.array([block] * n, pa.int64()), pa.array(origins, pa.int64()),
                    pa.array(firsts, pa.bool_()), pa.array([whole] * n, pa.bool_()), texts,
                ],
                ["file", "block", "origin", "first", "whole", "record"],
            )

        def ended(whole: bool) -> pa.RecordBatch:
            """The pending record; one begun elsewhere or going on is put together later."""
            nonlocal pending
            text, pending = pa.array(["\n".join(pending or [])], pa.string()), None
            first = own and block == 0 and count == 1
            return batch_of(text, [block if own else origin], [first], whole and own)

        for batch in batches:
            functions = batch.column("does").to_numpy().astype(np.int64)
            starts, origins = batch.column("start"), batch.column("origin")
            for its, at, a, b in _runs(batch):
                if (its, at) != (file, block):
                    if pending is not None:
                        yield ended(False)
                    file, block, count = its, at, 0
                    state, origin = starts[a].as_py(), origins[a].as_py()
                    if state:
                        pending, own = [], False
                states = _states(functions[a:b], state)
                state = int(states[-1])
                texts = batch.column("line").slice(a, b - a)
                begins = np.flatnonzero(states[:-1] == 0)
                until = int(begins[0]) if len(begins) else b - a
                if pending is not None and (until or len(begins)):
                    pending += texts.slice(0, until).to_pylist()
                    if len(begins):
                        yield ended(True)
                if not len(begins):
                    continue
                edges = np.append(begins, b - a)
                if state:  # the last record goes on
                    edges = edges[:-1]
                joined = pc.binary_join(
                    pa.ListArray.from_arrays(pa.array(edges, pa.int32()), texts.cast(pa.string())), "\n"
                )
                n = len(joined)
                if n:
                    yield batch_of(joined, [block] * n, [block == 0 and count + i == 0 for i in range(n)], True)
                count += n
                if state:
                    pending, own = texts.slice(int(begins[-1])).to_pylist(), True
                    count += 1
        if pending is not None:
            yield ended(False)

    # One row per byte range, as many as the scan has tasks.
    known = lines.join(F.broadcast(begun(found)), ["file", "block"])
    does = line_function(F.col("line"), delimiter).alias("does")
    cut = known.select("file", "block", "line", does, "start", "origin").mapInArrow(
        run, "file string, block bigint, origin bigint, first boolean, whole boolean, record string"
    )
    pieces = F.array_sort(F.collect_list(F.struct("block", "record")))
    crossing = cut.where(~F.col("whole")).groupBy("file", "origin").agg(
        F.bool_or("first").alias("first"),
        F.array_join(F.transform(pieces, lambda p: p["record"]), "\n").alias("record"),
    )
    every = cut.where("whole").select("file", "first", "record").unionByName(crossing.select("file", "first", "record"))
    text = F.regexp_replace("record", r"\r\z", "")
    return every.select("file", "first", text.alias("record")).where(F.col("first") | (F.trim(text) != ""))
