"""A hierarchical Pitman-Yor language model, trained and applied as Spark jobs.

Restaurants: a root over all words, whose base is uniform over the known words and one
more; below it one restaurant per kind of preceding word (its ending, or the start of a
text); and below each kind one restaurant per preceding word, so that their number grows
with the vocabulary. A word's customers are its occurrences after that word; each table of
a restaurant is a customer of the parent. Seating is sampled by Gibbs sweeps: the
customers of one word in one restaurant are taken out and seated again, given the parent's
predictive probability and the restaurant's other tables. Within a step two arrangements
are drawn customer by customer and one is chosen by its importance weight; after 64
customers they are seated in growing groups, an eighth of those present at a time.

Distribution: all restaurants' seats of one word lie in one bucket of words, so parent and
child counts of a word meet locally. The table total of a preceding word's restaurant is
kept by the bucket of that preceding word, its owner: after a sweep the buckets send their
tables to the owners, which answer with the totals. A single customer has one table
whatever the totals, so only contexts with words seen twice or more are exchanged, as
numbers in an order that both sides know. The totals of the root and the kinds (some
numbers) go over the driver. A sweep keeps no state: given the totals so far, a bucket
replays it from its own random seed, so that lost executors change nothing. Counts are
written once, in buckets, to the shared folder, and are not shuffled again; these files
stay there.

Texts are scored in blocks, cut where they are read and moved once, as one compressed value
each. A block asks the buckets for its different (word, context) pairs and gets the
customers and seats, the parents' probabilities, and the totals of its words as contexts,
each over the sampled sweeps, with whose means probabilities still sum to one. Neither
vocabulary nor counts are broadcast or collected. A frequent word is one pair per block and
context, wherever it occurs. Lists travel as bytes, small numbers in one byte each.

Words are known by 60 bits of a hash of their lower-case (A-Z) bytes, as contexts by 40 of
these and their kind.

Defined cases: a null or empty text is its end token; rows that repeat are trained on and
scored one by one; without training rows every word is new; an empty table gives an empty
table; only the named columns are read.
"""

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sondage.llm import kernels
from sondage.session import new_path

# Text of a block, and share of the words of a bucket, in bytes of text. Both fit a task.
BLOCK_BYTES = 8_000_000
# Bytes of text whose words are hashed at a time.
HASHED_BYTES = 500_000
# Bytes of text that are counted at a time.
COUNTED_BYTES = 8_000_000
# Entries that a counting task holds before it passes them on.
HELD_ENTRIES = 1_500_000
END = np.uint64(0x5EED_0F_E4D << 4)
# Kinds of preceding word by its last byte; the start of a text is one more.
ENDINGS = (b"eE", b"nN", b"sS", b"tT", b"rR", b"aoiuAOIU", bytes(range(0x80, 0x100)))
START = len(ENDINGS) + 1
CONTEXTS = START + 1
# A word's number ends with its kind.
BITS = np.uint64(4)
# What stands before the first word of a text.
BEFORE = np.uint64(START)
# A context's number: its kind above 40 bits of the word's.
OWN_BITS = np.uint64(40)

KIND = np.full(256, len(ENDINGS), np.uint64)
for _i, _bytes in enumerate(ENDINGS):
    KIND[list(_bytes)] = _i


def as_context(words: np.ndarray) -> np.ndarray:
    """The numbers of words as contexts."""
    return (words & np.uint64(15)) << OWN_BITS | words >> (np.uint64(64) - OWN_BITS)


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, context, owner): for every token, end tokens included, its word, the word
    before it, and the text it belongs to. Hashing holds some 40 times its text, so it takes
    less at a time."""
    found, n = [], 0
    for piece in kernels.pieces([pa.RecordBatch.from_arrays([texts], ["text"])], size=HASHED_BYTES):
        words, contexts, owner = _tokens(piece.column("text"))
        found.append((words, contexts, owner + n))
        n += piece.num_rows
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    words, contexts, owner = (np.concatenate(x) for x in zip(*found, strict=True))
    return words, contexts, owner


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data, offsets = kernels.bytes_of(texts)
    n = len(offsets) - 1
    starts, ends, owner = kernels.word_bounds(data, offsets)
    words = kernels.Spans(data, kernels.LOWERED_VALUE).hashes(starts, ends)
    words = words >> BITS << BITS | (KIND[data[ends - 1]] if len(ends) else np.zeros(0, np.uint64))
    # End tokens stand behind the words of their text.
    every = np.full(len(words) + n, END)
    every[np.arange(len(words)) + owner] = words
    owner = np.repeat(np.arange(n), np.bincount(owner, minlength=n) + 1)
    before = np.empty_like(every)
    before[1:] = every[:-1]
    before[_heads(owner)] = BEFORE
    return every, as_context(before), owner


def _pair(words: np.ndarray, contexts: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each (word, context)."""
    return kernels.mixed(words ^ kernels.mixed(contexts))


def _merged(words: np.ndarray, contexts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each pair once, with its counts added up."""
    if not len(words):
        return words, contexts, counts
    pairs = _pair(words, contexts)
    order = np.argsort(pairs).astype(np.int32)
    pairs = pairs[order]
    first = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]]))
    del pairs
    at = order[first]
    return words[at], contexts[at], np.add.reduceat(counts[order], first)


class Held:
    """Pairs with their counts, collected piece by piece."""

    def __init__(self) -> None:
        self.parts: tuple[list[np.ndarray], ...] = ([], [], [])
        self.size = 0

    def add(self, *found: np.ndarray) -> None:
        for part, x in zip(self.parts, found, strict=True):
            part.append(x)
        self.size += len(found[0])

    def taken(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All pairs, each once. Nothing stays; a column's parts go before the next is joined."""
        joined = []
        for part in self.parts:
            joined.append(np.concatenate(part))
            part.clear()
        self.size = 0
        return _merged(*joined)


def _lists(values: np.ndarray, bounds: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values))


def _bytes(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """The same as bytes, which Spark moves as a whole and not number by number."""
    offsets = pa.py_buffer((bounds * values.itemsize).astype(np.int32))
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, offsets, pa.py_buffer(np.ascontiguousarray(values))])


def _values(rows: pa.Table, column: str, kind: type) -> np.ndarray:
    found = rows.column(column).combine_chunks()
    found = found.combine_chunks() if isinstance(found, pa.ChunkedArray) else found
    if not len(found):
        return np.zeros(0, kind)
    _, offsets, data = found.buffers()
    bounds = np.frombuffer(offsets, np.int32)[found.offset : found.offset + len(found) + 1]
    n = int(bounds[-1] - bounds[0]) // np.dtype(kind).itemsize
    return np.frombuffer(data, kind, n, int(bounds[0])).copy() if n else np.zeros(0, kind)


def _small(name: str, values: np.ndarray, bounds: np.ndarray) -> dict[str, pa.Array]:
    """Numbers from 0 in a byte each, those above 254 apart."""
    large = values >= 255
    more = np.append(0, np.cumsum(large))[bounds]
    return {
        name: _bytes(np.where(large, 255, values).astype(np.uint8), bounds),
        f"{name}_more": _bytes(values[large].astype(np.int64), more),
    }


def _numbers(rows: pa.Table, name: str) -> np.ndarray:
    found = _values(rows, name, np.uint8).astype(np.int64)
    found[found == 255] = _values(rows, f"{name}_more", np.int64)
    return found


def _flat(rows: pa.Table, column: str) -> np.ndarray:
    found = rows.column(column).combine_chunks()
    found = found.combine_chunks() if isinstance(found, pa.ChunkedArray) else found
    return found.flatten().to_numpy(zero_copy_only=False)


def _halves(contexts: np.ndarray) -> dict[str, np.ndarray]:
    """Contexts as two columns; in order, the first of them repeats."""
    lo = (contexts & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32)
    return {"hi": (contexts >> np.uint64(32)).astype(np.int16), "lo": lo}


def _whole(rows: pa.Table, hi: str = "hi", lo: str = "lo") -> np.ndarray:
    low = np.ascontiguousarray(_flat(rows, lo).astype(np.int32)).view(np.uint32).astype(np.uint64)
    return _flat(rows, hi).astype(np.uint64) << np.uint64(32) | low


def _context_bytes(contexts: np.ndarray, bounds: np.ndarray) -> dict[str, pa.Array]:
    """Contexts as their kind, which repeats, and two more parts."""
    parts = {"kinds": (OWN_BITS, np.uint8), "hi": (np.uint64(32), np.uint8), "lo": (np.uint64(0), np.uint32)}
    return {name: _bytes((contexts >> shift).astype(kind), bounds) for name, (shift, kind) in parts.items()}


def _context_values(rows: pa.Table) -> np.ndarray:
    found = _values(rows, "kinds", np.uint8).astype(np.uint64) << np.uint64(8)
    found |= _values(rows, "hi", np.uint8)
    return found << np.uint64(32) | _values(rows, "lo", np.uint32)


def _heads(ordered: np.ndarray) -> np.ndarray:
    """Where a new value begins."""
    first = np.ones(len(ordered), bool)
    first[1:] = ordered[1:] != ordered[:-1]
    return first


def _sorted_pairs(word: np.ndarray, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of two numbers below 2^32 as one number each, in order, and that order."""
    keys = word.astype(np.uint64) << np.uint64(32) | context.astype(np.uint64)
    order = np.argsort(keys)
    return keys[order], order


@dataclass
class ByBucket:
    """Pairs by word and context, as a row per bucket: ``words`` are the different words in
    order, in which those of a bucket lie together, ``sizes`` how many contexts each has,
    ``contexts`` these, ``present`` the buckets, ``bounds`` and ``ends`` where their words
    and pairs begin."""

    words: np.ndarray
    sizes: np.ndarray
    contexts: np.ndarray
    present: np.ndarray
    bounds: np.ndarray
    ends: np.ndarray

    def columns(self) -> dict[str, pa.Array]:
        return {
            "words": _bytes(self.words, self.bounds), **_small("sizes", self.sizes, self.bounds),
            **_context_bytes(self.contexts, self.ends),
        }


def _by_bucket(words: np.ndarray, word: np.ndarray, contexts: np.ndarray, buckets: int) -> ByBucket:
    """``words`` in order, and for each pair, in order too, the place of its word there."""
    sizes = np.bincount(word, minlength=len(words))
    bucket = _owner(as_context(words), buckets)
    start = np.flatnonzero(_heads(bucket))
    bounds = np.append(start, len(words))
    ends = np.append(0, np.cumsum(sizes))[bounds]
    return ByBucket(words, sizes, contexts, bucket[start], bounds, ends)


@dataclass
class Block:
    """The tokens of some texts: ``words`` are the different ones in order, and what stands
    before the first; the different pairs are in order of ``word`` and ``contexts``, and
    ``before`` is a place of the context in ``words``. ``pair``, ``at``, ``owner``: pair,
    word and text of each token."""

    words: np.ndarray
    word: np.ndarray
    before: np.ndarray
    contexts: np.ndarray
    pair: np.ndarray
    at: np.ndarray
    owner: np.ndarray

    @classmethod
    def of(cls, texts: pa.Array) -> "Block":
        found, owner = tokens(texts)[::2]
        # All words of a block are asked for as contexts too.
        words, at = np.unique(np.append(found, BEFORE), return_inverse=True)
        del found
        previous = np.where(_heads(owner), at[-1], np.roll(at[:-1], 1))
        at = at[:-1].astype(np.int32)
        names, place, number = np.unique(as_context(words), return_index=True, return_inverse=True)
        keys, order = _sorted_pairs(at, number[previous])
        del previous
        first = _heads(keys)
        pair = np.empty(len(order), np.int32)
        pair[order] = np.cumsum(first) - 1
        keys = keys[first]
        number = (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
        word = (keys >> np.uint64(32)).astype(np.int64)
        return cls(words, word, place[number], names[number], pair, at, owner)


def _owner(contexts: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of a context, which is that of the word itself: a range of words."""
    low = contexts & ((np.uint64(1) << OWN_BITS) - np.uint64(1))
    return (low * np.uint64(buckets) >> OWN_BITS).astype(np.int64)


def _by_owner(contexts: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of ``contexts`` (sorted) by owner, the owners present, and where each begins."""
    owner = _owner(contexts, buckets)
    order = np.argsort(owner, kind="stable")
    present, at = np.unique(owner[order], return_index=True)
    return order, present, np.append(at, len(contexts))


def _tasks(rows: DataFrame) -> int:
    return int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def in_buckets(rows: DataFrame) -> DataFrame:
    """``rows`` written to the shared folder by ``bucket``, as they are partitioned: what is
    grouped or joined by it later is not shuffled. No name stays in the catalog."""
    spark, name = rows.sparkSession, f"pitman_yor_{uuid.uuid4().hex}"
    to = rows.write.bucketBy(_tasks(rows), "bucket").format("parquet").option("compression", "zstd").option("path", new_path(spark, "pitman_yor"))
    to.saveAsTable(name)
    found = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return found


ENTRIES = "words binary, sizes binary, sizes_more binary, kinds binary, hi binary, lo binary"


def _gathered(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """The rows in tables of at most about ``size`` bytes of text."""
    held, total = [], 0
    for piece in kernels.pieces(batches, size=max(1, size // 16)):
        more = int(kernels.bytes_of(piece.column("text"))[1][-1])
        if held and total + more > size:
            yield pa.Table.from_batches(held)
            held, total = [], 0
        held.append(piece)
        total += more
    if held:
        yield pa.Table.from_batches(held)


def pair_counts(docs: DataFrame, buckets: int) -> DataFrame:
    """(bucket, words, sizes, hi, lo, counts): the training counts, a row per bucket."""

    def table(words: np.ndarray, word: np.ndarray, contexts: np.ndarray, counts: np.ndarray) -> pa.Table:
        by = _by_bucket(words, word, contexts, buckets)
        return pa.table({"bucket": by.present, **by.columns(), **_small("counts", counts, by.ends)})

    def emit(distinct: np.ndarray, word: np.ndarray, contexts: np.ndarray, counts: np.ndarray) -> pa.Table:
        names, number = np.unique(contexts, return_inverse=True)
        keys, order = _sorted_pairs(word, number)
        first = np.flatnonzero(_heads(keys))
        keys = keys[first]
        contexts = names[(keys & np.uint64(0xFFFFFFFF)).astype(np.int64)]
        return table(distinct, (keys >> np.uint64(32)).astype(np.int64), contexts, np.add.reduceat(counts[order], first))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Held()
        for part in _gathered(batches, COUNTED_BYTES):
            block = Block.of(part.column("text").combine_chunks())
            counts, words, word, contexts = np.bincount(block.pair), block.words, block.word, block.contexts
            del block
            if len(counts) > HELD_ENTRIES // 2:
                # What stands before the first word is no word.
                used = np.bincount(word, minlength=len(words)) > 0
                yield from table(words[used], (np.cumsum(used) - 1)[word], contexts, counts).to_batches()
                continue
            held.add(words[word], contexts, counts)
            if held.size > HELD_ENTRIES:
                found = held.taken()
                if len(found[0]) > HELD_ENTRIES // 2:
                    yield from emit(*np.unique(found[0], return_inverse=True), *found[1:]).to_batches()
                else:
                    held.add(*found)
                del found
        if held.size:
            words, *found = held.taken()
            yield from emit(*np.unique(words, return_inverse=True), *found).to_batches()

    def merge(rows: pa.Table) -> pa.Table:
        words, word = np.unique(_values(rows, "words", np.uint64), return_inverse=True)
        return emit(words, np.repeat(word, _numbers(rows, "sizes")), _context_values(rows), _numbers(rows, "counts"))

    kind = f"bucket bigint, {ENTRIES}, counts binary, counts_more binary"
    parts = docs.select("text").mapInArrow(kernels.tidy_batches(count), kind).repartition(_tasks(docs), F.col("bucket"))
    return parts.groupBy("bucket").applyInArrow(kernels.tidy(merge), kind)


@dataclass
class Totals:
    """What all buckets share. ``customers``, ``tables``: of each kind's restaurant;
    ``root_customers``, ``root_tables``: of the root."""

    customers: np.ndarray
    tables: np.ndarray
    root_customers: float
    root_tables: float


@dataclass(frozen=True)
class PitmanYorModel:
    """``counts`` as from ``pair_counts``, with ``rests0``, ``rests1``, ...: the tables of
    the contexts that a bucket must know before each sweep. ``contexts``: a row per owner
    with its contexts (hi, lo), their customers, and ``own0``, ...: their tables after each
    of the sampled sweeps. ``history``: the other totals before each sweep and after the
    last. ``sampled``: how many of the last sweeps are averaged. ``block_bytes``: text of a
    block that is scored."""

    counts: DataFrame
    contexts: DataFrame
    buckets: int
    words: int
    train_tokens: int
    discount: float
    kind_discount: float
    root_discount: float
    strength: float
    history: tuple[Totals, ...]
    sampled: int
    seed: int
    block_bytes: int


def seated(
    customers: np.ndarray, new: np.ndarray, discount: float, rng: np.random.Generator
) -> tuple[np.ndarray, np.ndarray]:
    """(tables, log weight) of one arrangement of each dish's customers, drawn customer by
    customer: a new table with weight ``new``, an old one with its customers less the
    discount."""
    order = np.argsort(-customers, kind="stable")
    out, weights = np.empty(len(order)), np.empty(len(order))
    out[order], weights[order] = _seated(customers[order], new[order], discount, rng)
    return out, weights


def _seated(c: np.ndarray, a: np.ndarray, discount: float, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """The same for dishes with the most customers first."""
    tables, weight, n = np.ones(len(c)), np.zeros(len(c)), 1
    below = -c
    # Weights of some customers are multiplied before their logarithm is taken.
    product, open_until = np.ones(len(c)), len(c)
    while len(c) and (k := int(np.searchsorted(below, -n, "left"))):
        group = 1 if n < 64 else n // 8
        every = a[:k] - discount * tables[:k]
        every += n
        share = a[:k] / every
        if group == 1:
            tables[:k] += rng.random(k) < share
            product[:k] *= every
            if n % 8 == 0 or n == 63:
                weight[:open_until] += np.log(product[:open_until])
                product[:k] = 1
                open_until = k
        else:
            m = np.minimum(group, c[:k] - n)
            tables[:k] += rng.binomial(m, share)
            weight[:k] += m * np.log(every)
        n += group
    if n < 64:
        weight[:open_until] += np.log(product[:open_until])
    return tables, weight


def _reseated(customers, new, discount, rng) -> np.ndarray:
    """Tables of one of two arrangements, chosen by weight. A single customer has one."""
    tables = np.ones(len(customers))
    many = np.flatnonzero(customers > 1)
    if len(many):
        many = many[np.argsort(-customers[many], kind="stable")]
        c, a = customers[many], new[many]
        one, w1 = _seated(c, a, discount, rng)
        two, w2 = _seated(c, a, discount, rng)
        pick = rng.random(len(many)) < 1 / (1 + np.exp(np.clip(w1 - w2, -500, 500)))
        tables[many] = np.where(pick, two, one)
    return tables


class Bucket:
    """The seats of the words of one bucket. ``pairs``: the different (word, kind), with
    their customers ``counts``, which are the tables below."""

    def __init__(
        self, model: PitmanYorModel, bucket: int, words: np.ndarray, sizes: np.ndarray, contexts: np.ndarray,
        occurrences: np.ndarray, rests: list[np.ndarray],
    ):
        self.model, self.bucket, self.occurrences = model, bucket, occurrences
        self.named, self.words, self.contexts = words, words >> BITS, contexts
        entry_word = np.repeat(np.arange(len(words)), sizes)
        pairs = self.words[entry_word] << BITS | contexts >> OWN_BITS
        # Contexts are in order, those of a kind together.
        first = np.ones(len(pairs), bool)
        first[1:] = pairs[1:] != pairs[:-1]
        self.pair = np.cumsum(first) - 1
        self.pairs, self.word = pairs[first], entry_word[first]
        self.context = (self.pairs & np.uint64(15)).astype(np.int64)
        self.seen = np.bincount(entry_word, occurrences, len(words))
        # One customer has one table, whatever happens elsewhere.
        self.many = np.flatnonzero(occurrences > 1)
        self.many = self.many[np.argsort(-occurrences[self.many], kind="stable")]
        self.asked, self.rest = np.unique(contexts[self.many], return_inverse=True)
        self.order, self.owners, self.at = _by_owner(self.asked, model.buckets)
        self.rests = rests
        self.seats = np.ones(len(pairs))
        self.counts = np.bincount(self.pair, self.seats, len(self.pairs)).astype(np.int64)
        self.tables = np.ones(len(self.pairs))
        self.customers = np.bincount(self.word, self.tables, len(words)).astype(np.int64)
        self.root_tables = np.ones(len(words))

    def root(self, totals: Totals) -> tuple[np.ndarray, float]:
        """Probability of each word at the root, and of a new one."""
        m = self.model
        new = (m.strength + m.root_discount * totals.root_tables) / (m.words + 1)
        every = m.strength + totals.root_customers
        return (self.customers - m.root_discount * self.root_tables + new) / every, new / every

    def sweep(self, number: int, totals: Totals) -> None:
        m, rng = self.model, np.random.default_rng([self.model.seed, number, self.bucket])
        root, _ = self.root(totals)
        kind = self.probability(self.word, np.arange(len(self.pairs)), self.context, totals)
        rests = np.empty(len(self.asked))
        rests[self.order] = self.rests[number]
        new = (m.strength + m.discount * rests[self.rest]) * kind[self.pair[self.many]]
        self.seats[self.many] = _reseated(self.occurrences[self.many], new, m.discount, rng)
        self.counts = np.bincount(self.pair, self.seats, len(self.pairs)).astype(np.int64)
        new = (m.strength + m.kind_discount * totals.tables[self.context]) * root[self.word]
        self.tables = _reseated(self.counts, new, m.kind_discount, rng)
        self.customers = np.bincount(self.word, self.tables, len(self.words)).astype(np.int64)
        base = (m.strength + m.root_discount * totals.root_tables) / (m.words + 1)
        base = np.full(len(self.words), base)
        self.root_tables = _reseated(self.customers, base, m.root_discount, rng)

    def sums(self) -> np.ndarray:
        """Tables of each kind, then customers and tables of the root."""
        tables = np.bincount(self.context, self.tables, CONTEXTS)
        return np.concatenate([tables, [self.customers.sum(), self.root_tables.sum()]])

    def kind_customers(self) -> np.ndarray:
        return np.bincount(self.context, self.counts, CONTEXTS)

    def asked_tables(self) -> np.ndarray:
        """Tables here of the contexts asked for that can have more than one, by owner."""
        return np.bincount(self.rest, self.seats[self.many], len(self.asked))[self.order].astype(np.int64)

    def probability(self, word: np.ndarray, entry: np.ndarray, context: np.ndarray, totals: Totals) -> np.ndarray:
        """Of words after kinds; ``word``, ``entry``: their places here, or -1."""
        m = self.model
        root, new = self.root(totals)
        parent = np.where(word >= 0, np.append(root, new)[word], new)
        own = np.append(self.counts - m.kind_discount * self.tables, 0.0)[entry]
        rest = m.strength + m.kind_discount * totals.tables[context]
        return (own + rest * parent) / (m.strength + totals.customers[context])


def _buckets(model: PitmanYorModel, rows: pa.Table | pa.RecordBatch) -> Iterator[Bucket]:
    for row in range(rows.num_rows):
        part = rows.slice(row, 1)
        part = pa.Table.from_batches([part]) if isinstance(part, pa.RecordBatch) else part
        rests = [_flat(part, f"rests{i}") for i in range(len(model.history)) if f"rests{i}" in part.column_names]
        yield Bucket(
            model, part.column("bucket")[0].as_py(), _values(part, "words", np.uint64), _numbers(part, "sizes"),
            _context_values(part), _numbers(part, "counts"), rests,
        )


def _light(model: PitmanYorModel) -> PitmanYorModel:
    """The model without its tables, to go into a function."""
    values = {k: getattr(model, k) for k in model.__dataclass_fields__}
    return PitmanYorModel(**values | {"counts": None, "contexts": None})


def _owners(counts: DataFrame, model: PitmanYorModel) -> DataFrame:
    """A row per owner: its contexts (hi, lo) with their customers, the tables of words seen
    once (``singles``) and how many others there are (``many``); the buckets that ask for
    some (``askers``), how many each (``asked``) and which (``at``); and sums that describe
    the words of the bucket."""

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in _buckets(model, batch):
                n = b.occurrences
                contexts, at = np.unique(b.contexts, return_inverse=True)
                order, owners, bounds = _by_owner(contexts, model.buckets)
                found = {
                    "customers": np.bincount(at, n, len(contexts)), "singles": np.bincount(at, n == 1, len(contexts)),
                    "many": np.bincount(at, n > 1, len(contexts)),
                }
                sums = [len(b.words), n.sum()]
                sums += [(x == k).sum() for x in (n, b.counts, b.customers) for k in (1, 2)]
                sums = np.concatenate([sums, b.kind_customers(), b.sums()[:CONTEXTS]]).astype(float)
                # The bucket tells itself the sums.
                halves = _halves(contexts[order])
                to = len(owners) + 1
                yield pa.RecordBatch.from_pydict({
                    "owner": np.append(owners, b.bucket), "asker": np.full(to, b.bucket),
                    **{k: _lists(v, np.append(bounds, bounds[-1])) for k, v in halves.items()},
                    **{k: _lists(v[order].astype(np.int64), np.append(bounds, bounds[-1])) for k, v in found.items()},
                    "sums": _lists(sums, np.append(np.zeros(to), len(sums))),
                })

    def keep(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("asker")
        contexts, at = np.unique(_whole(rows), return_inverse=True)
        many = _flat(rows, "many")
        totals = {k: np.bincount(at, _flat(rows, k), len(contexts)).astype(np.int64) for k in ("customers", "singles", "many")}
        sizes = _lengths(rows, "hi")
        asked = np.bincount(np.repeat(np.arange(rows.num_rows), sizes), many > 0, rows.num_rows).astype(np.int32)
        some = np.flatnonzero(asked)
        sums = _flat(rows, "sums")
        lists = {
            **_halves(contexts), **totals, "askers": rows.column("asker").to_numpy()[some], "asked": asked[some],
            "at": at[many > 0].astype(np.int32), "sums": sums,
        }
        return pa.table({
            "bucket": rows.column("owner").slice(0, 1), **{k: _lists(v, np.array([0, len(v)])) for k, v in lists.items()},
        })

    three = "hi array<smallint>, lo array<int>, customers array<bigint>, singles array<bigint>, many array<bigint>"
    told = counts.mapInArrow(kernels.tidy_batches(tell), f"owner bigint, asker bigint, {three}, sums array<double>")
    kept = f"bucket bigint, {three}, askers array<bigint>, asked array<int>, at array<int>, sums array<double>"
    return in_buckets(told.repartition(_tasks(counts), F.col("owner")).groupBy("owner").applyInArrow(kernels.tidy(keep), kept))


def _lengths(rows: pa.Table, column: str) -> np.ndarray:
    found = rows.column(column).combine_chunks()
    found = found.combine_chunks() if isinstance(found, pa.ChunkedArray) else found
    return pc.fill_null(pc.binary_length(found) if found.type == pa.binary() else pc.list_value_length(found), 0).to_numpy(zero_copy_only=False)


ANSWERED = "bucket bigint, owner bigint, tables array<bigint>, sums array<double>"


def _answered(owner: pa.Table, tables: np.ndarray, sums: np.ndarray) -> pa.Table:
    """What an owner answers to each bucket, and (owner -1) its tables of all contexts."""
    number = owner.column("bucket")[0].as_py()
    to, at = _flat(owner, "askers"), _flat(owner, "at")
    bounds = np.append(0, np.cumsum(_flat(owner, "asked")))
    n = len(to)
    return pa.table({
        "bucket": np.append(to, number), "owner": np.append(np.full(n, number), -1),
        "tables": _lists(np.concatenate([tables[at], tables]), np.append(bounds, bounds[-1] + len(tables))),
        "sums": _lists(sums, np.append(np.zeros(n + 1), len(sums))),
    })


def _gathered_answers(answers: DataFrame) -> DataFrame:
    """A row per bucket: what all owners answer to it (``rests``, in their order), its own
    tables as an owner (``own``), and ``sums``. It is put together once, for all sweeps."""
    lists = F.array_sort(F.collect_list(F.when(F.col("owner") >= 0, F.struct("owner", "tables"))))
    itself = F.col("owner") == -1
    rows = answers.repartition(_tasks(answers), F.col("bucket")).groupBy("bucket")
    return in_buckets(rows.agg(
        F.flatten(F.transform(lists, lambda x: x["tables"])).alias("rests"),
        *(F.first(F.when(itself, F.col(x)), True).alias(name) for x, name in (("tables", "own"), ("sums", "sums"))),
    ))


def _with_rests(counts: DataFrame, answers: list[DataFrame]) -> DataFrame:
    """``counts`` with the answers before each sweep. Nothing is shuffled."""
    for i, answer in enumerate(answers):
        counts = counts.join(answer.select("bucket", F.col("rests").alias(f"rests{i}")), "bucket", "left")
    return counts


def _after_sweep(model: PitmanYorModel, owners: DataFrame) -> DataFrame:
    """The owners' answers after all sweeps that the history allows; their sums are those of
    the totals."""
    light = _light(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in _buckets(light, batch):
                for number, totals in enumerate(light.history):
                    b.sweep(number, totals)
                sums, to = np.concatenate([b.kind_customers(), b.sums()]), len(b.owners) + 1
                yield pa.RecordBatch.from_pydict({
                    "to": np.append(b.owners, b.bucket), "asker": np.full(to, b.bucket),
                    "tables": _lists(b.asked_tables(), np.append(b.at, b.at[-1])),
                    "sums": _lists(sums, np.append(np.zeros(to), len(sums))),
                })

    def add(owner: pa.Table, told: pa.Table) -> pa.Table:
        told = told.sort_by("asker")
        found = _flat(owner, "singles") + np.bincount(
            _flat(owner, "at"), _flat(told, "tables"), len(_flat(owner, "singles"))
        ).astype(np.int64)
        return _answered(owner, found, _flat(told, "sums"))

    told = model.counts.mapInArrow(kernels.tidy_batches(run), "to bigint, asker bigint, tables array<bigint>, sums array<double>")
    answers = owners.groupBy("bucket").cogroup(told.groupBy("to")).applyInArrow(kernels.tidy(add), ANSWERED)
    return _gathered_answers(answers)


def _summed(rows: DataFrame, n: int) -> np.ndarray:
    """The sums of all rows, place by place."""
    out = np.zeros(n)
    for at, total in rows.select(F.posexplode("sums").alias("at", "x")).groupBy("at").agg(F.sum("x")).collect():
        out[at] = total
    return out


def _kneser_ney(ones: float, twos: float) -> float:
    return min(max(ones / max(ones + 2 * twos, 1.0), 0.05), 0.95)


def fit_pitman_yor(
    docs: DataFrame,
    training: Column,
    text_column: str = "text",
    burn_in: int = 2,
    sampled: int = 2,
    strength: float = 1.0,
    seed: int = 1,
    block_bytes: int = BLOCK_BYTES,
) -> PitmanYorModel:
    """Learns from the rows of ``docs`` that satisfy ``training``."""
    text = F.coalesce(docs[text_column], F.lit(""))
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    buckets = max(1, math.ceil(size / block_bytes))
    counts = in_buckets(pair_counts(docs.where(training).select(text.alias("text")), buckets))
    none = PitmanYorModel(None, None, buckets, 0, 0, 0.0, 0.0, 0.0, strength, (), sampled, seed, block_bytes)
    owners = _owners(counts, none)
    sums = _summed(owners, 8 + 2 * CONTEXTS)
    discounts = [_kneser_ney(ones, twos) for ones, twos in sums[2:8].reshape(3, 2).tolist()]
    customers, tables = sums[8:].reshape(2, CONTEXTS)
    # At first every word has one table in each restaurant.
    history = (Totals(customers, tables, tables.sum(), sums[0]),)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                owner = pa.Table.from_batches([batch.slice(row, 1)])
                found = _answered(owner, _flat(owner, "singles") + _flat(owner, "many"), np.zeros(0))
                yield from found.combine_chunks().to_batches()

    answers = [_gathered_answers(owners.mapInArrow(kernels.tidy_batches(first), ANSWERED))]
    for _ in range(burn_in + sampled):
        known = _with_rests(counts, answers)
        model = PitmanYorModel(
            known, None, buckets, int(sums[0]), int(sums[1]), *discounts, strength, history, sampled, seed, block_bytes
        )
        answers.append(_after_sweep(model, owners))
        found = _summed(answers[-1], 2 * CONTEXTS + 2)
        history = (*history, Totals(found[:CONTEXTS], found[CONTEXTS:-2], found[-2], found[-1]))
    contexts = owners.select("bucket", F.col("hi").alias("own_hi"), F.col("lo").alias("own_lo"), "customers")
    for i, answer in enumerate(answers[-sampled:]):
        contexts = contexts.join(answer.select("bucket", F.col("own").alias(f"own{i}")), "bucket", "left")
    return replace(model, contexts=contexts, history=history)


def score_texts(
    docs: DataFrame, model: PitmanYorModel, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: its id, n_tokens, n_known, train_tokens, base_score and
    score (log10 probabilities)."""
    text = F.coalesce(docs[text_column], F.lit(""))
    key = docs[id_column]
    rows = docs.select(key.alias("key"), text.alias("text"))
    light, buckets = _light(model), model.buckets

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts become blocks where they are read. A block moves as one compressed value."""
        task = TaskContext.get().partitionId()
        for number, part in enumerate(_gathered(batches, light.block_bytes)):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as to:
                to.write_table(part.combine_chunks())
            yield pa.RecordBatch.from_pydict({"block": [task << 32 | number], "body": [sink.getvalue().to_pybytes()]})

    def texts_of(rows: pa.Table) -> pa.Table:
        return pa.concat_tables(pa.ipc.open_stream(body.as_buffer()).read_all() for body in rows.column("body"))

    def ask(rows: pa.Table) -> pa.Table:
        block = Block.of(texts_of(rows).column("text").combine_chunks())
        by = _by_bucket(block.words, block.word, block.contexts, buckets)
        number = rows.column("block")[0].as_py()
        return pa.table({
            "bucket": by.present, "block": np.full(len(by.present), number, np.int64), **by.columns(),
        })

    def runs(word: np.ndarray, contexts: np.ndarray) -> np.ndarray:
        """Where a new word or kind begins."""
        kinds = contexts >> OWN_BITS
        first = np.ones(len(word), bool)
        first[1:] = (word[1:] != word[:-1]) | (kinds[1:] != kinds[:-1])
        return first

    def answer(asked: pa.Table, known: pa.Table) -> pa.Table:
        if not asked.num_rows:
            return ANSWERS.empty_table()
        bucket, own = None, [np.zeros(0, np.int64)] * (light.sampled + 1)
        own_contexts = np.zeros(0, np.uint64)
        if known.num_rows:
            (bucket,) = _buckets(light, known)
            own_contexts = _whole(known, "own_hi", "own_lo")
            own = [_flat(known, name) for name in ("customers", *(f"own{i}" for i in range(light.sampled)))]
        words, sizes, contexts = _values(asked, "words", np.uint64), _numbers(asked, "sizes"), _context_values(asked)
        entry_word = np.repeat(np.arange(len(words)), sizes)
        first = runs(entry_word, contexts)
        kind = (contexts[first] >> OWN_BITS).astype(np.int64)
        if bucket is None or not len(bucket.words):
            nothing = np.zeros(0, np.uint64)
            bucket = Bucket(light, 0, nothing, np.zeros(0, np.int64), nothing, np.zeros(0, np.int64), [np.zeros(0)] * len(light.history))
        place = _places(bucket.named, words)
        word = place[entry_word[first]]
        pair = _places(bucket.pairs, (words >> BITS)[entry_word[first]] << BITS | kind.astype(np.uint64))
        # Entries by the place of their word and kind, and the rest of the context.
        run_pair = pair[np.cumsum(first) - 1]
        entry = _places(_entry_keys(bucket.pair, bucket.contexts), _entry_keys(run_pair, contexts))
        entry[run_pair < 0] = -1
        seats, kinds = np.zeros(len(bucket.seats)), np.zeros(len(kind))
        last = len(light.history) - 1
        for number in range(last):
            bucket.sweep(number, light.history[number])
            if number >= last - light.sampled:
                seats += bucket.seats
                kinds += bucket.probability(word, pair, kind, light.history[number + 1])
        seen = np.append(bucket.seen, 0).astype(np.int64)[place]
        at = _places(own_contexts, as_context(words))
        customers = np.append(own[0], 0)[at]
        row = np.repeat(np.arange(asked.num_rows), _lengths(asked, "words") // 8)
        by_word = np.append(0, np.cumsum(_lengths(asked, "words") // 8))
        by_entry = np.append(0, np.cumsum(_lengths(asked, "lo") // 4))
        by_run = np.append(0, np.cumsum(np.bincount(row[entry_word[first]], minlength=asked.num_rows)))
        occurrences = np.append(bucket.occurrences, 0)[entry]
        # A single customer has one table in every sweep.
        many = occurrences > 1
        by_many = np.append(0, np.cumsum(many))[by_entry]
        return pa.table({
            "block": asked.column("block"), "bucket": asked.column("bucket"),
            **_small("occurrences", occurrences, by_entry),
            **_small("seats", seats[entry[many]].astype(np.int64), by_many),
            **_small("seen", seen, by_word),
            # A word has as many customers as a context, but for collisions, ends and starts.
            **_small("customers", np.where(customers == seen, 0, customers + 1), by_word),
            **_small("seated", light.sampled * customers - np.append(sum(own[1:]), 0)[at], by_word),
            "kind": _bytes((kinds / light.sampled).astype(np.float32), by_run),
        }).cast(ANSWERS)

    base = math.log10(model.train_tokens + model.words + 1)

    def score(rows: pa.Table, answers: pa.Table) -> pa.Table:
        texts = texts_of(rows)
        block = Block.of(texts.column("text").combine_chunks())
        answers = answers.sort_by("bucket")
        seen, customers = _numbers(answers, "seen"), _numbers(answers, "customers")
        occurrences = _numbers(answers, "occurrences")
        if len(seen) != len(block.words) or len(occurrences) != len(block.word):
            raise ValueError("the rows of a block changed while it was scored")
        customers = np.where(customers == 0, seen, customers - 1)
        tables = customers - _numbers(answers, "seated") / light.sampled
        rest = (light.strength + light.discount * tables)[block.before]
        run = np.cumsum(runs(block.word, block.contexts), dtype=np.int32) - 1
        seats = np.minimum(occurrences, 1) * light.sampled
        seats[occurrences > 1] = _numbers(answers, "seats")
        mine = occurrences - light.discount / light.sampled * seats
        del occurrences, seats
        logs = np.log10((mine + rest * _values(answers, "kind", np.float32)[run]) / (light.strength + customers)[block.before])
        del rest, run, mine
        n, owner = texts.num_rows, block.owner
        size = np.bincount(owner, minlength=n)
        return pa.table({
            "key": texts.column("key"), "n_tokens": size.astype(np.int64),
            "n_known": np.bincount(owner, (seen > 0)[block.at], n).astype(np.int64),
            "base_score": np.bincount(owner, np.log10(seen + 1.0)[block.at], n) - size * base,
            "score": np.bincount(owner, logs[block.pair], n),
        })

    blocks = rows.mapInArrow(kernels.tidy_batches(cut), "block bigint, body binary")
    asked = blocks.groupBy("block").applyInArrow(kernels.tidy(ask), f"bucket bigint, block bigint, {ENTRIES}")
    # Every bucket with counts is an owner; both lie in buckets.
    known = model.contexts.join(model.counts, "bucket", "left")
    answers = asked.groupBy("bucket").cogroup(known.groupBy("bucket")).applyInArrow(
        kernels.tidy(answer), ", ".join(f"{x.name} {'bigint' if x.type == pa.int64() else 'binary'}" for x in ANSWERS)
    )
    kind = rows.schema["key"].dataType.simpleString()
    scored = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        kernels.tidy(score), f"key {kind}, n_tokens bigint, n_known bigint, base_score double, score double"
    )
    return scored.select(
        F.col("key").alias(id_column), "n_tokens", "n_known",
        F.lit(model.train_tokens).cast("long").alias("train_tokens"), "base_score", "score",
    )


ANSWERS = pa.schema([
    ("block", pa.int64()), ("bucket", pa.int64()),
    *((f"{name}{more}", pa.binary()) for name in ("occurrences", "seats", "seen", "customers", "seated") for more in ("", "_more")),
    ("kind", pa.binary()),
])


def _entry_keys(pair: np.ndarray, contexts: np.ndarray) -> np.ndarray:
    """Places of a word and kind (below 2^24), each with the rest of a context."""
    return pair.astype(np.uint64) << OWN_BITS | contexts & ((np.uint64(1) << OWN_BITS) - np.uint64(1))


def _places(ordered: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Where ``wanted`` lie in ``ordered``, -1 for what is absent."""
    if not len(ordered):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(ordered, wanted), len(ordered) - 1)
    return np.where(ordered[at] == wanted, at, -1)


def perplexity(scored: DataFrame, score_column: str = "score") -> DataFrame:
    """(n_tokens, perplexity) of all rows together."""
    n = F.sum("n_tokens")
    return scored.agg(n.alias("n_tokens"), F.pow(F.lit(10.0), -F.sum(score_column) / n).alias("perplexity"))
