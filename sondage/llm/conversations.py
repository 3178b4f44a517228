"""Repair of the role order of conversations by the cheapest edits, in linear space.

A repaired conversation is empty or an optional system turn followed by pairs of user and
assistant. What has been written so far is one of four states: nothing, system, user last,
assistant last. Each row is kept, given the role that the state asks for, or deleted; empty
turns may be inserted anywhere. In each state the role to insert or to give is the only
legal one, so the letters of the edits fix the whole repair.

Hirschberg's scheme finds the letters without a table of all rows: cost vectors over the
four states go forward through the first half of the rows and backward through the second;
where they meet, the cheapest state is the crossing, and both halves are solved by
themselves. Of equal costs the crossing with the ASCII-least letters before it is taken;
for that, a forward vector carries the rank of its states' letters besides their costs. (Up
to the same row, the letters of different states differ before one of them ends, so that
ranks stay comparable as letters are added.)

The same scheme works across tasks. Rows, as one letter each, are range-partitioned by
conversation and turn, so that a long conversation is spread over many tasks; each task
sums up its stretches of at most ``SEGMENT`` rows as cost vectors from each state. Per
conversation, only these meet, and their crossings are the ends from which each stretch is
solved by itself. Texts are shuffled once, beside the finished letters, to be written out.

A conversation's letters form one value, and its SHA-256 is taken by one task, which holds
one batch of its rows at a time: both follow from what is asked for.

Defined cases: a null role or text counts as one space; a null conversation forms one with
the id of one space; rows with a null turn come first; rows of one turn follow the SHA-256
of role and text; a role with another first letter than s, u or a, or none, cannot be kept;
a conversation without rows is empty and costs nothing; an empty table gives an empty
table; only the named columns are read.
"""

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sondage.session import checkpointed

# Rows in a stretch that is summed up and solved by itself.
SEGMENT = 50_000
SPACES = " \t\n\x0b\x0c\r"
FAR = 1 << 60

NOTHING, SYSTEM, USER, ASSISTANT = STATES = range(4)
# The state after a role's first letter, where it is legal, and the role to give or insert.
LEGAL = {(NOTHING, "s"): SYSTEM, (NOTHING, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
ROLE_IN = {NOTHING: "user", SYSTEM: "user", USER: "assistant", ASSISTANT: "user"}
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5

# A row's letter: its role's first letter, o for others; upper case if it is truncated; a
# digit if it must be deleted. The end of a conversation is a letter of its own.
INITIALS = "suao"
DELETED = dict(zip(INITIALS, "0123", strict=True))
END = "$"

Edges = list[list[tuple[int, int, str]]]
Vector = tuple[tuple[int, int], ...]


def _edges(letter: str) -> Edges:
    """From each state, the states reached by the row's edits with inserts before it: (state,
    cost, letters), the cheapest and ASCII-least for each."""
    initial, extra = letter.lower(), TRUNCATED * letter.isupper()
    if letter in DELETED.values():
        initial = INITIALS[int(letter)]
    found: Edges = []
    for start in STATES:
        best: dict[int, tuple[int, str]] = {}

        def offer(state: int, cost: int, letters: str, best: dict[int, tuple[int, str]] = best) -> None:
            best[state] = min(best.get(state, (FAR, "")), (cost, letters))

        state = start
        for n in range(3):  # two inserts lead to every state that inserts can reach
            before, cost = "I" * n, INSERT * n
            given = LEGAL[state, ROLE_IN[state][0]]
            if letter == END:
                if state in (NOTHING, ASSISTANT):
                    offer(NOTHING, cost, before)
            else:
                offer(state, cost + DELETE, before + "D")
                if letter not in DELETED.values():
                    offer(given, cost + REROLE + extra, before + "R")
                    if (state, initial) in LEGAL:
                        offer(LEGAL[state, initial], cost + KEEP + extra, before + "K")
            state = given
        found.append([(q, cost, letters) for q, (cost, letters) in sorted(best.items())])
    return found


EDGES = {x: _edges(x) for x in [*INITIALS, *INITIALS.upper(), *DELETED.values(), END]}


def _unit(state: int) -> Vector:
    return tuple((0 if q == state else FAR, 0 if q == state else 4) for q in STATES)


def advance(vector: Vector, edges: list) -> Vector:
    """The forward vector, (cost, rank) by state, behind one more step."""
    best: list = [(FAR, 4, "")] * 4
    for p in STATES:
        cost, rank = vector[p]
        if cost < FAR:
            for q, more, letters in edges[p]:
                best[q] = min(best[q], (cost + more, rank, letters))
    order = sorted((q for q in STATES if best[q][0] < FAR), key=lambda q: best[q][1:])
    ranks = {q: i for i, q in enumerate(order)}
    return tuple((best[q][0], ranks.get(q, 4)) for q in STATES)


def retreat(costs: tuple[int, ...], edges: list) -> tuple[int, ...]:
    """The cost from each state to the end, before one more step."""
    return tuple(min([FAR, *(more + costs[q] for q, more, _ in edges[p])]) for p in STATES)


# Costs of the states differ by a few edits, so that reduced vectors are few.
@lru_cache(100_000)
def _advance(vector: Vector, letter: str) -> tuple[int, Vector]:
    found = advance(vector, EDGES[letter])
    least = min(c for c, _ in found)
    return least, tuple((c - least if c < FAR else FAR, r) for c, r in found)


@lru_cache(100_000)
def _retreat(costs: tuple[int, ...], letter: str) -> tuple[int, ...]:
    found = retreat(costs, EDGES[letter])
    return tuple(c - min(found) if c < FAR else FAR for c in found)


def forward(letters: Iterable[str], vector: Vector) -> tuple[int, Vector]:
    """A cost common to all states, and the vector behind the rows."""
    common = 0
    for letter in letters:
        more, vector = _advance(vector, letter)
        common += more
    return common, vector


def _crossing(vector: Vector, costs: tuple[int, ...]) -> int:
    return min(STATES, key=lambda q: (min(FAR, vector[q][0] + costs[q]), vector[q][1]))


def _solved(rows: str, start: int, end: int) -> str:
    if len(rows) == 1:
        return next(letters for q, _, letters in EDGES[rows][start] if q == end)
    middle = len(rows) // 2
    _, vector = forward(rows[:middle], _unit(start))
    costs = tuple(0 if q == end else FAR for q in STATES)
    for letter in reversed(rows[middle:]):
        costs = _retreat(costs, letter)
    state = _crossing(vector, costs)
    return solved(rows[:middle], start, state) + solved(rows[middle:], state, end)


_remembered = lru_cache(50_000)(_solved)


def solved(rows: str, start: int, end: int) -> str:
    """The ASCII-least of the cheapest edits of rows, from one state to another."""
    return _remembered(rows, start, end) if len(rows) <= 32 else _solved(rows, start, end)


def summary(rows: str) -> tuple[list[int], list[int]]:
    """Costs and ranks, from each state to each state, of the cheapest edits."""
    costs, ranks = [], []
    for p in STATES:
        common, vector = forward(rows, _unit(p))
        costs += [c + common if c < FAR else FAR for c, _ in vector]
        ranks += [r for _, r in vector]
    return costs, ranks


def crossings(steps: list[list], start: int, end: int) -> list[int]:
    """The state behind each step of stretches summed up; the last one's is ``end``."""
    if len(steps) == 1:
        return [end]
    middle = len(steps) // 2
    vector = _unit(start)
    for edges in steps[:middle]:
        vector = advance(vector, edges)
    costs = tuple(0 if q == end else FAR for q in STATES)
    for edges in reversed(steps[middle:]):
        costs = retreat(costs, edges)
    state = _crossing(vector, costs)
    return crossings(steps[:middle], start, state) + crossings(steps[middle:], state, end)


# --- over tables ------------------------------------------------------------------


def conversation_key(column: Column | str) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(column.cast("string"), F.lit(" "))


def _filled(turns: DataFrame, names: list[str]) -> DataFrame:
    """key, turn, role, text and digest of each row."""
    conv, turn, role, text = (turns[n] for n in names)
    rows = turns.select(
        conversation_key(conv).alias("key"), turn.alias("turn"),
        *(F.coalesce(c.cast("string"), F.lit(" ")).alias(n) for c, n in ((role, "role"), (text, "text"))),
    )
    named = F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")
    return rows.withColumn("digest", F.unhex(F.sha2(named, 256)))


def faults(rows: DataFrame) -> DataFrame:
    """Equal rows of a turn as one: key, turn, digest, n, initial, blank, first, truncated.
    ``first``: neither role and text nor, among equal rows, any other came earlier."""
    trimmed = F.rtrim("text", F.lit(SPACES))
    initial = F.substring("role", 1, 1)
    narrow = rows.select(
        "key", "turn", "digest", (trimmed == "").alias("blank"),
        F.when(initial.isin(*INITIALS[:3]), initial).otherwise("o").alias("initial"),
        (~F.right(trimmed, F.lit(1)).isin(".", "!", "?")).alias("open"),
    )
    equal = narrow.groupBy("key", "turn", "digest", "initial", "blank", "open").agg(F.count(F.lit(1)).alias("n"))
    # Nulls come first among turns, as in the order of rows.
    at = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    earliest = equal.groupBy("key", "digest").agg(F.min(at).alias("earliest"))
    first = ~F.col("blank") & (F.col("earliest") == at)
    return equal.join(earliest, ["key", "digest"]).select(
        "key", "turn", "digest", "n", "initial", "blank", first.alias("first"), (first & F.col("open")).alias("truncated")
    )


def _segments(found: DataFrame, most: int) -> DataFrame:
    """Rows of a conversation in order, as letters, ``most`` at once: key, piece, part, rows."""
    one = F.when(F.col("truncated"), F.upper("initial")).otherwise(F.col("initial"))
    gone = F.translate("initial", INITIALS, "".join(DELETED.values()))
    order = ["key", "turn", "digest"]
    letters = found.select(
        *order, F.when(F.col("first"), one).otherwise(gone).alias("one"), gone.alias("more"), (F.col("n") - 1).alias("again")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, key, part, held, size = TaskContext.get().partitionId(), None, 0, [], 0
        done: list[tuple] = []

        def close() -> None:
            nonlocal part, held, size
            if size:
                done.append((key, piece, part, "".join(held)))
                part, held, size = part + 1, [], 0

        def rows() -> pa.RecordBatch:
            columns = list(zip(*done, strict=True)) or [[]] * 4
            done.clear()
            kinds = [pa.string(), pa.int32(), pa.int64(), pa.string()]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["key", "piece", "part", "rows"]
            )

        for batch in batches:
            columns = [batch.column(n).to_pylist() for n in ("key", "one", "more", "again")]
            for its, one, more, again in zip(*columns, strict=True):
                if its != key:
                    close()
                    key, part = its, 0
                held.append(one)
                size += 1
                while again:  # equal rows, which may be more than fit a stretch
                    taken = min(again, max(1, most - size))
                    held.append(more * taken)
                    size, again = size + taken, again - taken
                    if size >= most:
                        close()
                        if len(done) >= 100:
                            yield rows()
                if size >= most:
                    close()
            yield rows()
        close()
        yield rows()

    ordered = letters.repartitionByRange(*order).sortWithinPartitions(*order)
    return ordered.mapInArrow(run, "key string, piece int, part bigint, rows string")


def _illegal(rows: str) -> int:
    initials = rows.lower().translate(str.maketrans("".join(DELETED.values()), INITIALS))
    return len(rows) - 1 - sum(initials.count(pair) for pair in ("su", "ua", "au"))


def _planned(segments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per stretch its first and last state, and per conversation cost, illegal and tail,
    the edits behind its last row."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column("rows").to_pylist()
            costs, ranks = zip(*map(summary, rows), strict=True) if rows else ([], [])
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(n) for n in ("key", "piece", "part")),
                    pa.array(costs, pa.list_(pa.int64())), pa.array(ranks, pa.list_(pa.int64())),
                    pa.array([r[0] + r[-1] for r in rows], pa.string()), pa.array(map(_illegal, rows), pa.int64()),
                ],
                ["key", "piece", "part", "costs", "ranks", "ends", "illegal"],
            )

    fields = "piece int, part bigint, costs array<bigint>, ranks array<bigint>, ends string, illegal bigint"
    per = segments.mapInArrow(summed, f"key string, {fields}")
    grouped = per.groupBy("key").agg(F.array_sort(F.collect_list(F.struct(*per.columns[1:]))).alias("steps"))

    def planned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            states, found = [], []
            for steps in batch.column("steps").to_pylist():
                edges = [
                    [[(q, s["costs"][4 * p + q], s["ranks"][4 * p + q]) for q in STATES if s["costs"][4 * p + q] < FAR] for p in STATES]
                    for s in steps
                ]
                behind = crossings([*edges, [[(q, c, 0) for q, c, _ in e] for e in EDGES[END]]], NOTHING, NOTHING)
                before = [NOTHING, *behind[:-1]]
                tail = EDGES[END][before[-1]][0]
                cost = tail[1] + sum(s["costs"][4 * p + q] for s, p, q in zip(steps, before, behind, strict=False))
                joints = sum(_illegal(a["ends"][1] + b["ends"][0]) for a, b in zip(steps, steps[1:], strict=False))
                found.append((cost, joints + sum(s["illegal"] for s in steps), tail[2]))
                states.append([
                    {"piece": s["piece"], "part": s["part"], "start": p, "end": q}
                    for s, p, q in zip(steps, before, behind, strict=False)
                ])
            kind = pa.list_(pa.struct([("piece", pa.int32()), ("part", pa.int64()), ("start", pa.int32()), ("end", pa.int32())]))
            cost, illegal, tail = zip(*found, strict=True) if found else ([], [], [])
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), pa.array(states, kind), pa.array(cost, pa.int64()), pa.array(illegal, pa.int64()), pa.array(tail, pa.string())],
                ["key", "states", "cost", "illegal", "tail"],
            )

    plan = checkpointed(
        grouped.mapInArrow(
            planned,
            "key string, states array<struct<piece: int, part: bigint, start: int, end: int>>, "
            "cost bigint, illegal bigint, tail string",
        )
    )
    return plan.select("key", F.inline("states")), plan.drop("states")


def _audits(segments: DataFrame) -> DataFrame:
    """key, illegal, cost and audit, the letters of all edits."""
    states, plan = _planned(segments)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(n).to_pylist() for n in ("rows", "start", "end")]
            edits = [solved(*x) for x in zip(*columns, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in ("key", "piece", "part")), pa.array(edits, pa.string())],
                ["key", "piece", "part", "edits"],
            )

    parts = segments.join(states, ["key", "piece", "part"]).mapInArrow(run, "key string, piece int, part bigint, edits string")
    whole = F.array_sort(F.collect_list(F.struct("piece", "part", "edits")))
    joined = parts.groupBy("key").agg(F.array_join(F.transform(whole, lambda x: x["edits"]), "").alias("edits"))
    return joined.join(plan, "key").select("key", "illegal", "cost", F.concat("edits", "tail").alias("audit"))


class Repair:
    """The repair of a table of turns.

    ``report``: key, gaps, blank, duplicate, truncated, illegal, cost, audit of each
    conversation with rows; ``turns()``: the repaired rows; ``digests()``: their SHA-256.
    """

    def __init__(
        self, turns: DataFrame, conv_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role",
        text_column: str = "text", most: int = SEGMENT,
    ):
        self.rows = _filled(turns, [conv_column, turn_column, role_column, text_column])
        found = checkpointed(faults(self.rows))
        self.audits = checkpointed(_audits(checkpointed(_segments(found, most))))
        rest = F.when(~F.col("blank"), F.col("n") - F.col("first").cast("long")).otherwise(0)
        per_turn = found.groupBy("key", "turn").agg(
            F.sum(F.when(F.col("blank"), F.col("n")).otherwise(0)).alias("blank"),
            F.sum(rest).alias("duplicate"), F.sum(F.col("truncated").cast("long")).alias("truncated"),
        )
        spread = F.max("turn") - F.min("turn") + 1 - F.count("turn")
        counts = per_turn.groupBy("key").agg(
            F.coalesce(spread, F.lit(0)).cast("long").alias("gaps"),
            *(F.sum(n).alias(n) for n in ("blank", "duplicate", "truncated")),
        )
        self.report = counts.join(self.audits, "key")

    def _streamed(self) -> DataFrame:
        """Each conversation's edits, then its rows in order, in one task."""
        none = F.lit(None)
        heads = self.audits.select(
            "key", F.lit(0).alias("kind"), none.cast(self.rows.schema["turn"].dataType).alias("turn"),
            none.cast("binary").alias("digest"), none.cast("string").alias("role"), F.col("audit").alias("text"),
        )
        rows = self.rows.select("key", F.lit(1).alias("kind"), "turn", "digest", "role", "text")
        order = ["key", "kind", "turn", "digest"]
        return heads.unionByName(rows).repartition("key").sortWithinPartitions(*order).select("key", "kind", "role", "text")

    def turns(self) -> DataFrame:
        """key, position (from 0), edit (K, R or I), role and text."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            made: list[tuple] = []
            last, position = None, 0
            for key, edit, role, text in _repaired(batches):
                if key != last:
                    last, position = key, 0
                if edit:
                    made.append((key, position, edit, role, text))
                    position += 1
                if len(made) >= 1000:
                    yield _batch(made)
                    made = []
            yield _batch(made)

        def _batch(made: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*made, strict=True)) or [[]] * 5
            kinds = [pa.string(), pa.int64(), *[pa.string()] * 3]
            names = ["key", "position", "edit", "role", "text"]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

        return self._streamed().mapInArrow(run, "key string, position bigint, edit string, role string, text string")

    def digests(self) -> DataFrame:
        """key and repaired_sha256, over role:text of the repaired rows, joined by newlines."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = []
            for key, rows in groupby(_repaired(batches), key=lambda x: x[0]):
                digest, between = hashlib.sha256(), b""
                for _, edit, role, text in rows:
                    if edit:
                        digest.update(between + f"{role}:{text}".encode())
                        between = b"\n"
                found.append((key, digest.hexdigest()))
                if len(found) == 5000:
                    yield _pairs(found)
                    found = []
            yield _pairs(found)

        def _pairs(found: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*found, strict=True)) or [[]] * 2
            return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], ["key", "repaired_sha256"])

        return self._streamed().mapInArrow(run, "key string, repaired_sha256 string")


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, str, str, str]]:
    """(key, edit, role, text) of each repaired row, from edits and rows in order; a row
    without edit opens each conversation."""
    key, edits, place, state = "", "", 0, NOTHING
    for batch in batches:
        columns = [batch.column(n).to_pylist() for n in ("key", "kind", "role", "text")]
        for its, kind, role, text in zip(*columns, strict=True):
            if kind == 0:
                key, edits, place, state = its, text, 0, NOTHING
                yield key, "", "", ""
            else:
                edit, place = edits[place], place + 1
                if edit != "D":
                    role = role if edit == "K" else ROLE_IN[state]
                    state = LEGAL[state, role[0]]
                    yield key, edit, role, text
            while edits[place : place + 1] == "I":
                role, place = ROLE_IN[state], place + 1
                state = LEGAL[state, role[0]]
                yield key, "I", role, ""


def damaged(
    turns: DataFrame, conv_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role",
    text_column: str = "text", every: int = 20,
) -> DataFrame:
    """Turns with faults chosen by crc32 of conversation and turn, modulo ``every``: 0 drops
    the row, 1 empties its text, 2 removes its sentence marks, 3 repeats it, 4 makes it the
    user's. A null counts as one space."""
    conv, turn = turns[conv_column], turns[turn_column]
    role, text = (F.coalesce(turns[c].cast("string"), F.lit(" ")) for c in (role_column, text_column))
    place = F.concat(conversation_key(conv), F.lit(":"), F.coalesce(turn.cast("string"), F.lit(" ")))
    rows = turns.select(
        conv.alias(conv_column), turn.alias(turn_column), role.alias("_role"), text.alias("_text"),
        (F.crc32(place.cast("binary")) % every).alias("_kind"),
    ).where("_kind <> 0")
    kind = F.col("_kind")
    times = F.when(kind == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.select(
        conv_column, turn_column, F.when(kind == 4, "user").otherwise(F.col("_role")).alias(role_column),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace("_text", "[.!?]", "")).otherwise(F.col("_text")).alias(text_column),
        F.explode(times).alias("_copy"),
    ).drop("_copy")
