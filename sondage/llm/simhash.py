"""Near-duplicates by SimHash fingerprints and covering locality-sensitive hashing.

A fingerprint bit is the majority of that bit over the XXH64 hashes of a text's word
shingles. To link fingerprints at ``radius`` or fewer differing bits, each of the 64 bits
gets one of the non-zero vectors of radius + 1 bits, and table v keeps the bits whose
vector has odd product with v. Any ``radius`` vectors leave some v orthogonal to all of
them, so a pair within the radius agrees in all kept bits of table v: with
2^(radius + 1) - 1 tables no pair is missed.

Only distinct fingerprints are compared, so exact copies cost nothing. A bucket that holds
more than ``bucket_rows`` fingerprints is dealt out again by further bits (cut in
radius + 1 parts of the bits it left open, of which a close pair must share one) and, if
still too large, into blocks whose pairs meet in separate groups: the work is split, and
no pair is dropped. From every group only a star per linked set leaves.

Defined cases: a null text counts as empty; without words the fingerprint is zero and
links like any other; a component without any id has a null component id; repeated rows
each give a row; an empty table gives an empty table; only the named columns are read.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sondage.llm.components import connected_components
from sondage.llm.mixing import free_names
from sondage.session import checkpointed

SEED = 42
# Fewer hot buckets than this (of 12 bytes each) are broadcast; more are joined by a shuffle.
BROADCAST_BUCKETS = 10_000


def fingerprint(text: bytes, shingle: int) -> int:
    """The fingerprint of one text: words of its lower-cased (A-Z) bytes."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        size = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(size + 1) - 1
        starts = (ends - size)[: len(words) - shingle + 1].tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[s:e], SEED) for s, e in zip(starts, ends[shingle - 1 :].tolist(), strict=True)]
    ones = np.zeros(64, np.int64)
    hashes = np.array(hashes, np.uint64)
    for at in range(0, len(hashes), 1 << 16):  # the bits of 65,536 hashes at a time
        bits = np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8), bitorder="little")
        ones += bits.reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def with_fingerprints(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = 4
) -> DataFrame:
    """(key, text_hash, fp): the fingerprint of every row as a signed 64-bit number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").fill_null("").cast(pa.large_binary()).to_pylist()
            fps = np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64)
            columns = [batch.column("key"), batch.column("text_hash"), pa.array(fps)]
            yield pa.RecordBatch.from_arrays(columns, ["key", "text_hash", "fp"])

    key, text = docs[id_column], docs[text_column]
    source = docs.select(key.alias("key"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    kind = source.schema["key"].dataType.simpleString()
    return source.mapInArrow(run, f"key {kind}, text_hash bigint, fp bigint")


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def covering_masks(radius: int) -> list[int]:
    """The bits kept by each table."""
    vectors = [1 + i % ((2 << radius) - 1) for i in range(64)]
    return [
        sum(1 << i for i, a in enumerate(vectors) if (a & v).bit_count() % 2)
        for v in range(1, 2 << radius)
    ]


def finer_masks(mask: int, radius: int) -> list[int]:
    """``mask`` and one of radius + 1 parts of the other bits: a pair that agrees in
    ``mask`` and differs in at most ``radius`` bits agrees in one of these."""
    free = [i for i in range(64) if not mask >> i & 1]
    return [mask | sum(1 << i for i in free[part :: radius + 1]) for part in range(radius + 1)]


def _in_tables(fps: DataFrame, masks: dict[int, int]) -> DataFrame:
    """(t, k, fp): the bucket of every fingerprint in every table."""
    cells = [
        F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("k"))
        for t, m in masks.items()
    ]
    return fps.select("fp", F.explode(F.array(*cells)).alias("c")).select("c.t", "c.k", "fp")


def _hot(rows: DataFrame, bucket_rows: int) -> tuple[DataFrame, int]:
    counts = rows.groupBy("t", "k").agg(F.count("fp").alias("n")).where(F.col("n") > bucket_rows)
    hot = checkpointed(counts)
    return hot, hot.count()


def _split(rows: DataFrame, hot: DataFrame, n_hot: int) -> tuple[DataFrame, DataFrame]:
    """Rows outside and inside the hot buckets."""
    side = F.broadcast(hot) if n_hot <= BROADCAST_BUCKETS else hot
    return rows.join(side, ["t", "k"], "left_anti"), rows.join(side, ["t", "k"])


def _stars(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of one bucket that keep its linked sets together: each member with the
    smallest of its set."""
    n = len(fps)
    near = [
        np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= radius) + i + 1 for i in range(n - 1)
    ]
    root = np.arange(n)
    for i, found in enumerate(near):  # union by smallest index
        if len(found):
            old = np.unique(root[np.append(found, i)])
            root[np.isin(root, old)] = old[0]
    moved = np.flatnonzero(root != np.arange(n))
    return fps[moved], fps[root[moved]]


def _links_of_runs(fps: np.ndarray, bounds: np.ndarray, radius: int) -> pa.RecordBatch:
    """Links inside the runs of ``fps`` that ``bounds`` delimits."""
    size = np.diff(bounds)
    first = bounds[:-1][size == 2]
    close = np.bitwise_count(fps[first] ^ fps[first + 1]) <= radius
    found = [(fps[first + 1][close], fps[first][close])]
    for start, n in zip(bounds[:-1][size > 2], size[size > 2], strict=True):
        found.append(_stars(fps[start : start + n], radius))
    a, b = (pa.array(np.concatenate(x)) for x in zip(*found, strict=True))
    return pa.RecordBatch.from_arrays([a, b], ["a", "b"])


def _links(rows: DataFrame, keys: list[str], radius: int) -> DataFrame:
    """(a, b): links inside the buckets named by ``keys``, which are bounded in size. A
    task meets its buckets one after another in sorted batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            table = batch if rest is None else pa.concat_batches([rest, batch])
            columns = [table.column(k).to_numpy() for k in keys]
            edge = np.ones(table.num_rows + 1, bool)
            edge[1:-1] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
            bounds = np.flatnonzero(edge)[:-1]  # the last run may go on in the next batch
            yield _links_of_runs(table.column("fp").to_numpy(), bounds, radius)
            rest = table.slice(bounds[-1]) if len(bounds) else None
        if rest is not None:
            yield _links_of_runs(rest.column("fp").to_numpy(), np.array([0, rest.num_rows]), radius)

    ordered = rows.select(*keys, "fp").repartition(*keys).sortWithinPartitions(*keys)
    return ordered.mapInArrow(run, "a bigint, b bigint")


def fingerprint_links(fps: DataFrame, radius: int = 4, bucket_rows: int = 2048) -> DataFrame:
    """(a, b): links between the distinct fingerprints ``fps`` (fp) that connect exactly
    those within reach of each other by steps of at most ``radius`` differing bits."""
    masks = dict(enumerate(covering_masks(radius)))
    parts = radius + 1
    finer = {
        len(masks) + t * parts + i: m for t, mask in masks.items() for i, m in enumerate(finer_masks(mask, radius))
    }
    # A fingerprint becomes a row per table: small input partitions, not coalesced ones.
    parts_of = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = _in_tables(fps.repartition(parts_of, "fp"), masks)
    hot, n_hot = _hot(rows, bucket_rows)
    if not n_hot:
        return _links(rows, ["t", "k"], radius)
    cold, rows = _split(rows, hot, n_hot)
    links = _links(cold, ["t", "k"], radius)
    # Inside hot buckets: the same fingerprints by finer keys of their table.
    cells = F.create_map(*[
        x for t in masks for x in (
            F.lit(t),
            F.array(*[
                F.struct(F.lit(u).alias("t"), F.col("fp").bitwiseAND(F.lit(signed(finer[u]))).alias("k"))
                for u in range(len(masks) + t * parts, len(masks) + (t + 1) * parts)
            ]),
        )
    ])
    rows = rows.select("fp", F.explode(cells[F.col("t")]).alias("c")).select("c.t", "c.k", "fp")
    hot, n_hot = _hot(rows, bucket_rows)
    if not n_hot:
        return links.union(_links(rows, ["t", "k"], radius))
    cold, rows = _split(rows, hot, n_hot)
    links = links.union(_links(cold, ["t", "k"], radius))
    # Still hot: every pair of blocks of about half a bucket meets in a group of its own.
    blocks = F.ceil(2 * F.col("n") / bucket_rows).cast("int")
    rows = rows.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("fp"), "blocks"))
    rows = rows.withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1L)")))
    rows = rows.select(
        "t", "k", "fp", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y")
    )
    return links.union(_links(rows, ["t", "k", "x", "y"], radius))


def _classes(rows: DataFrame, radius: int, bucket_rows: int) -> DataFrame:
    """(fp, low, root): each distinct fingerprint, the first document that has it (by id,
    nulls last), and the smallest fingerprint it reaches."""
    first = F.min(F.struct(F.col("key").isNull().alias("no_key"), "key", "text_hash"))
    classes = rows.groupBy("fp").agg(first.alias("low"))
    links = fingerprint_links(classes.select("fp"), radius, bucket_rows)
    roots = connected_components(links).withColumnRenamed("node", "fp")
    return classes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    shingle: int = 4,
    radius: int = 4,
    bucket_rows: int = 2048,
) -> DataFrame:
    """One row per row of ``docs``: its id, ``fingerprint`` (16 lower-case hex digits) and
    ``component_id``, the smallest id reachable over links, its own included."""
    rows = checkpointed(with_fingerprints(docs, id_column, text_column, shingle))
    linked = _classes(rows, radius, bucket_rows)
    lowest = linked.groupBy("root").agg(F.min("low.key").alias("component_id"))
    named = linked.join(lowest, "root").select("fp", "component_id")
    return rows.join(named, "fp").select(
        F.col("key").alias(id_column),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def without_near_duplicates(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    shingle: int = 4,
    radius: int = 4,
    bucket_rows: int = 2048,
) -> DataFrame:
    """One row of ``docs`` for each component: that with the smallest id (nulls last, then
    by a hash of the text; of rows that repeat both, any)."""
    rows = checkpointed(with_fingerprints(docs, id_column, text_column, shingle))
    linked = _classes(rows, radius, bucket_rows)
    key, text_hash = free_names(docs, "_key", "_text_hash")
    kept = linked.groupBy("root").agg(F.min("low").alias("low")).select(
        F.col("low.key").alias(key), F.col("low.text_hash").alias(text_hash)
    )
    marked = docs.select(
        *[docs[c] for c in docs.columns],
        docs[id_column].alias(key), F.xxhash64(docs[text_column]).alias(text_hash),
    )
    same = marked[key].eqNullSafe(kept[key]) & (marked[text_hash] == kept[text_hash])
    found = marked.join(kept, same, "left_semi")
    return found.dropDuplicates([key, text_hash]).drop(key, text_hash)
