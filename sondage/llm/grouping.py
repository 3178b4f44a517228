"""Packing by linear grouping, with best fit for what is small.

1. Documents are tokenized where they lie; longer ones than a sequence are cut into whole
   sequences behind a first, shorter piece. How many pieces have each length is a table of
   at most ``capacity`` rows, whatever the input.
2. Large pieces, longest first, form groups of equal cardinality; each length is rounded
   up to the longest of its group. Over these few sizes, the configurations of a sequence
   are chosen by column generation (a linear programme whose columns are found by a
   knapsack), rounded down, and what is then uncovered is packed best fit.
3. Pieces are numbered within their length by counts per worker; the number tells the
   group's slot and so the sequence. No piece passes the driver.
4. Slots hold actual pieces, which are shorter than the sizes planned for. Small pieces
   fill what is free, longest first, each in the sequence with the least room that holds
   it. This too is decided by counts: sequences with equal room are numbered, and a run of
   equal pieces goes to a run of them.

Plans depend on at most ``capacity`` lengths, so their size and time do not grow with the
input.

Defined cases: a null text counts as empty and holds only the end token; repeated rows are
packed one by one; equal lengths are numbered in the order of workers; an empty table gives
an empty table; only the named columns are read.
"""

import json
import zlib
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import cache
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sondage.session import checkpointed

# Texts tokenized at once; the ids of one batch are held in memory.
TEXTS_AT_ONCE = 256


# --- tokens -----------------------------------------------------------------------


def _bytes_by_letter() -> dict[str, int]:
    """The letter a byte-level vocabulary writes for each byte: itself where it is printed,
    else the next one from 256 on."""
    printed = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printed]
    return {chr(b): b for b in printed} | {chr(256 + i): b for i, b in enumerate(others)}


@cache
def _encoder(path: str) -> Callable[[str], np.ndarray]:
    """Ids of a text by the tokenizer's file. A byte-level vocabulary numbered in the order
    of its merges is encoded by ranks, which gives the same ids several times faster."""
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as file:
        described = json.load(file)
    model, before = described["model"], described.get("pre_tokenizer") or {}
    merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model.get("merges", [])]
    vocabulary = model.get("vocab", {})
    ordered = [vocabulary.get(m) for m in merged] == list(range(256, 256 + len(merged)))
    plain = before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
    if not (ordered and plain and described.get("normalizer") is None and not model.get("ignore_merges")):
        tokenizer = Tokenizer.from_file(path)
        return lambda text: np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4")
    import public_tokenizers
    import tiktoken

    letters = _bytes_by_letter()
    ranks = {bytes(map(letters.__getitem__, token)): i for token, i in vocabulary.items()}
    special = {t["content"]: t["id"] for t in described.get("added_tokens", [])}
    encoding: Any = tiktoken.Encoding(
        path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special
    )
    return lambda text: encoding.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False)


def tokenized_pieces(
    docs: DataFrame, path: str, id_column: str, text_column: str, end_id: int, capacity: int
) -> DataFrame:
    """A row per piece: key, piece, start, length, ids_crc32, worker, and number, the
    piece's place among the worker's pieces of its length."""
    end = np.array([end_id], "<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker, encode = TaskContext.get().partitionId(), _encoder(path)
        counts: dict[int, int] = defaultdict(int)
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS_AT_ONCE):
                part = batch.slice(at, TEXTS_AT_ONCE)
                owner, rows = [], []
                for i, text in enumerate(part.column("text").fill_null("").to_pylist()):
                    ids = memoryview(np.concatenate([encode(text), end])).cast("B")
                    start, piece, total = 0, 0, len(ids) // 4
                    length = total % capacity or capacity
                    while start < total:
                        crc = zlib.crc32(ids[4 * start : 4 * (start + length)])
                        owner.append(i)
                        rows.append((piece, start, length, crc, worker, counts[length]))
                        counts[length] += 1
                        start, piece, length = start + length, piece + 1, capacity
                values = np.array(rows, np.int64).reshape(-1, 6)
                yield pa.RecordBatch.from_arrays(
                    [part.column("key").take(pa.array(owner, pa.int64())), *map(pa.array, values.T.copy())],
                    ["key", "piece", "start", "length", "ids_crc32", "worker", "number"],
                )

    source = docs.select(docs[id_column].alias("key"), docs[text_column].alias("text"))
    kind = source.schema["key"].dataType.simpleString()
    return source.mapInArrow(
        run,
        f"key {kind}, piece bigint, start bigint, length bigint, ids_crc32 bigint, worker bigint, number bigint",
    )


# --- numbers ----------------------------------------------------------------------


def numbered(df: DataFrame, by: str) -> DataFrame:
    """``df`` with worker and number, the row's place among its task's rows of equal ``by``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker, counts = TaskContext.get().partitionId(), defaultdict(int)
        for batch in batches:
            numbers = []
            for value in batch.column(by).to_pylist():
                numbers.append(counts[value])
                counts[value] += 1
            workers = pa.array(np.full(batch.num_rows, worker, np.int64))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, workers, pa.array(numbers, pa.int64())], [*batch.schema.names, "worker", "number"]
            )

    fields = ", ".join(f"{n} {t}" for n, t in df.dtypes)
    return df.mapInArrow(run, f"{fields}, worker bigint, number bigint")


def placed(table: DataFrame, by: str) -> DataFrame:
    """The column place, a row's number among all rows of equal ``by``, from worker and
    number; what is counted is one row per worker and value."""
    held = table.groupBy("worker", by).agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy(by).orderBy("worker").rowsBetween(Window.unboundedPreceding, -1)
    before = held.select("worker", by, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    return table.join(before, ["worker", by]).withColumn("place", F.col("number") + F.col("before"))


def counts_of(table: DataFrame, by: str) -> dict[int, int]:
    """How many rows have each value of ``by``, of which there are at most capacity + 1."""
    return {r[0]: r[1] for r in table.groupBy(by).agg(F.count(F.lit(1))).collect()}


# --- large pieces -----------------------------------------------------------------


def linear_groups(counts: dict[int, int], groups: int) -> list[tuple[int, int]]:
    """(rounded size, pieces), sizes falling. Groups whose longest pieces are equal are one."""
    total = sum(counts.values())
    if not total:
        return []
    sizes = sorted(counts, reverse=True)
    upto = np.cumsum([counts[s] for s in sizes])
    cardinality = -(-total // groups)
    found: dict[int, int] = {}
    for first in range(0, total, cardinality):
        longest = sizes[int(np.searchsorted(upto, first, "right"))]
        found[longest] = found.get(longest, 0) + min(cardinality, total - first)
    return list(found.items())


def _best_configuration(sizes: np.ndarray, values: np.ndarray, capacity: int) -> np.ndarray:
    """How many of each size a sequence of the highest value holds."""
    best = np.zeros(capacity + 1)
    layers = []
    for _ in range(capacity // int(sizes.min())):
        better, choice = best.copy(), np.full(capacity + 1, -1)
        for i, (size, value) in enumerate(zip(sizes.tolist(), values.tolist(), strict=True)):
            gain = best[: capacity + 1 - size] + value
            more = gain > better[size:] + 1e-12
            better[size:][more] = gain[more]
            choice[size:][more] = i
        if (choice < 0).all():
            break
        best = better
        layers.append(choice)
    held, room = np.zeros(len(sizes)), capacity
    for choice in reversed(layers):
        if choice[room] >= 0:
            held[choice[room]] += 1
            room -= int(sizes[choice[room]])
    return held


def fractional_configurations(sizes: list[int], demands: list[int], capacity: int) -> list[tuple[np.ndarray, float]]:
    """Configurations and how often each is used, fractions allowed, so that few sequences
    cover all demands exactly."""
    size, x = np.array(sizes), np.array(demands, float)
    basis = np.diag((capacity // size).astype(float))
    x = x / basis.diagonal()
    for _ in range(100 * len(sizes)):  # ends long before: each step is a pivot towards the optimum
        prices = np.linalg.solve(basis.T, np.ones(len(sizes)))
        column = _best_configuration(size, prices, capacity)
        if column @ prices <= 1 + 1e-7:
            break
        change = np.linalg.solve(basis, column)
        able = change > 1e-9
        steps = np.where(able, x / np.where(able, change, 1), np.inf)
        leaving = int(np.argmin(steps))
        step = max(0.0, steps[leaving])
        x = np.maximum(x - step * change, 0)
        x[leaving] = step
        basis[:, leaving] = column
    return [(basis[:, i].astype(int), float(x[i])) for i in range(len(sizes))]


def configurations(groups: list[tuple[int, int]], capacity: int) -> list[tuple[np.ndarray, int]]:
    """Configurations with how many sequences each fills; together they hold every slot."""
    if not groups:
        return []
    sizes, demands = [s for s, _ in groups], [n for _, n in groups]
    chosen, left = [], np.array(demands)
    for config, times in fractional_configurations(sizes, demands, capacity):
        whole = min([int(times + 1e-6), *(int(left[i] // n) for i, n in enumerate(config) if n)])
        if whole > 0:
            chosen.append((config, whole))
            left = left - whole * config
    # Fewer pieces than fill one sequence of each configuration: best fit, longest first.
    rooms: list[int] = []
    held: list[np.ndarray] = []
    for i, size in enumerate(sizes):
        for _ in range(int(left[i])):
            fitting = [(room, j) for j, room in enumerate(rooms) if room >= size]
            j = min(fitting)[1] if fitting else len(rooms)
            if not fitting:
                rooms.append(capacity)
                held.append(np.zeros(len(sizes), int))
            rooms[j] -= size
            held[j][i] += 1
    return chosen + [(h, 1) for h in held]


class SlotPlan:
    """Where the large piece of each rank, longest first, goes: runs of ranks, each with
    its first sequence and how many pieces of the run a sequence takes."""

    def __init__(self, counts: dict[int, int], capacity: int, groups: int):
        self.sizes = np.array(sorted(counts), np.int64)
        held = np.array([counts[s] for s in self.sizes.tolist()], np.int64)
        self.longer = held.sum() - np.cumsum(held)
        types = linear_groups(counts, groups)
        configs = configurations(types, capacity)
        firsts = np.cumsum([0, *(times for _, times in configs)])
        self.sequences = int(firsts[-1])
        runs, rank = [], 0
        for i in range(len(types)):
            for (config, times), first in zip(configs, firsts.tolist(), strict=False):
                if config[i]:
                    runs.append((rank, first, config[i]))
                    rank += int(config[i]) * times
        self.starts, self.firsts, self.each = np.array(runs, np.int64).reshape(-1, 3).T.copy()

    def sequences_of(self, lengths: np.ndarray, places: np.ndarray) -> np.ndarray:
        ranks = self.longer[np.searchsorted(self.sizes, lengths)] + places
        run = np.searchsorted(self.starts, ranks, "right") - 1
        return self.firsts[run] + (ranks - self.starts[run]) // self.each[run]


# --- small pieces -----------------------------------------------------------------


class BestFitPlan:
    """Where the small piece of each rank, longest first, goes: runs of ranks, each to a
    run of sequences that had equal room at first and have equal room now."""

    def __init__(self, counts: dict[int, int], rooms: dict[int, int], capacity: int):
        self.sizes = np.array(sorted(counts), np.int64)
        held = np.array([counts[s] for s in self.sizes.tolist()], np.int64)
        self.longer = held.sum() - np.cumsum(held)
        # room now -> [(room at first, or -1 for a new sequence; from; to)]
        free: dict[int, list[tuple[int, int, int]]] = {r: [(r, 0, n)] for r, n in rooms.items() if r > 0}
        order = sorted(free)
        runs, rank, self.opened = [], 0, 0
        for size in self.sizes[::-1].tolist():
            left = counts[size]
            while left:
                at = bisect_left(order, size)
                if at == len(order):
                    new = -(-left // (capacity // size))
                    free[capacity] = [(-1, self.opened, self.opened + new)]
                    self.opened += new
                    order.append(capacity)
                room = order[at]
                origin, first, last = free[room].pop()
                taken = min(left, last - first)
                runs.append((rank, origin, first, capacity - room))
                rank, left = rank + taken, left - taken
                if taken < last - first:
                    free[room].append((origin, first + taken, last))
                if not free[room]:
                    del free[room], order[at]
                if rest := room - size:
                    if rest not in free:
                        free[rest] = []
                        order.insert(bisect_left(order, rest), rest)
                    free[rest].append((origin, first, first + taken))
        self.starts, self.origins, self.firsts, self.offsets = np.array(runs, np.int64).reshape(-1, 4).T.copy()

    def slots(self, lengths: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Room at first (-1: new), number among these, and offset."""
        ranks = self.longer[np.searchsorted(self.sizes, lengths)] + places
        run = np.searchsorted(self.starts, ranks, "right") - 1
        return self.origins[run], self.firsts[run] + ranks - self.starts[run], self.offsets[run]


# --- together ---------------------------------------------------------------------


def _with(df: DataFrame, fields: str, names: list[str], work) -> DataFrame:
    """``df`` with long columns that ``work`` makes from length and place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                made = work(batch.column("length").to_numpy(), batch.column("place").to_numpy())
                columns = [*batch.columns, *(pa.array(m, pa.int64()) for m in made)]
                yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, *names])

    return df.mapInArrow(run, fields + "".join(f", {n} bigint" for n in names))


def grouped_packing(
    docs: DataFrame,
    path: str,
    id_column: str = "doc_id",
    text_column: str = "text",
    end_id: int = 0,
    capacity: int = 2048,
    groups: int = 256,
    small: float = 1 / 3,
) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id and offset.
    ``path`` names the tokenizer's file, which every executor has; pieces of up to
    ``small`` of the capacity are small."""
    pieces = checkpointed(tokenized_pieces(docs, path, id_column, text_column, end_id, capacity))
    limit = int(small * capacity)
    counts = counts_of(pieces, "length")
    slots = SlotPlan({s: n for s, n in counts.items() if limit < s < capacity}, capacity, groups)
    width = ["key", "piece", "start", "length", "ids_crc32", "place"]
    every = placed(pieces, "length").select(*width)
    fields = ", ".join(f"{n} {t}" for n, t in every.dtypes)

    large = every.where((F.col("length") > limit) & (F.col("length") < capacity))
    large = _with(large, fields, ["bin"], lambda length, place: [slots.sequences_of(length, place)])
    # A sequence holds at most 1 / small large pieces.
    whole = Window.partitionBy("bin")
    upto = whole.orderBy(F.desc("length"), "place").rowsBetween(Window.unboundedPreceding, 0)
    large = checkpointed(
        large.select(
            *width[:-1], "bin", (F.sum("length").over(upto) - F.col("length")).alias("offset"),
            (capacity - F.sum("length").over(whole)).alias("room"),
        )
    )

    open_bins = checkpointed(numbered(large.where("offset = 0").select("bin", "room"), "room"))
    fit = BestFitPlan({s: n for s, n in counts.items() if s <= limit and s < capacity}, counts_of(open_bins, "room"), capacity)
    filled = _with(every.where((F.col("length") <= limit) & (F.col("length") < capacity)), fields, ["room", "nth", "offset"], fit.slots)
    homes = placed(open_bins, "room").select("room", F.col("place").alias("nth"), "bin")
    in_new = (F.col("nth") + slots.sequences).alias("sequence_id")
    columns = [F.col("key").alias(id_column), *width[1:-1]]
    parts = [
        large.select(*columns, F.col("bin").alias("sequence_id"), "offset"),
        filled.where("room >= 0").join(homes, ["room", "nth"]).select(*columns, F.col("bin").alias("sequence_id"), "offset"),
        filled.where("room < 0").select(*columns, in_new, "offset"),
        every.where(F.col("length") == capacity).select(
            *columns, (F.col("place") + slots.sequences + fit.opened).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
        ),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
