"""Harmonic packing of tokenized documents into sequences of fixed capacity.

A piece of r tokens belongs to the class k = capacity // r, whose sequences hold exactly k
pieces. A document is cut so that every class wastes little: whole capacities first; then,
while k pieces of the rest would leave more than ``waste`` of a sequence empty, a piece of
capacity // ceil(capacity / r) tokens. Cuts depend on the length alone, so pieces are cut
where the text is tokenized and no token is ever shuffled.

Every worker numbers its pieces of each class by itself. One small table of how many
pieces each worker has of each class (not of pieces) turns these into numbers per class,
and number // k is the sequence. Only the last sequence of a class may be short; the
pieces of these, fewer than k for each of at most 2 sqrt(capacity) classes whatever the
input, go to one first-fit pass.

Defined cases: a null text counts as empty and holds only the end token; repeated rows are
packed one by one; an empty table gives an empty table; only the named columns are read.
"""

import json
import zlib
from collections.abc import Iterator
from functools import cache
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from sondage.llm.grouping import _bytes_by_letter
from sondage.session import checkpointed

def cut(length: int, capacity: int, waste: float) -> list[int]:
    """The lengths of the pieces of a document, in order."""
    pieces, rest = [capacity] * (length // capacity), length % capacity
    while rest:
        k = capacity // rest
        if capacity - k * rest <= waste * capacity:
            piece = rest
        else:
            piece = capacity // -(-capacity // rest)
        pieces.append(piece)
        rest -= piece
    return pieces


@cache
def _tokenizer(path: str) -> Any:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


# White space of Unicode, and what the tokenizers with ends of words take as one word.
SPACE = r"\t-\r \x{85}\x{a0}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}"
WORD = rf"'s|'t|'re|'ve|'m|'ll|'d|\pL+|\pN|[^{SPACE}\pL\pN]+"
# Characters for which lower case and composed form are the same in every library: Latin but
# for I with a dot, Cyrillic, punctuation, kana, ideographs, Hangul. Texts with others, or
# with what may be a special token, go to the tokenizer itself.
OTHER = (
    r"[^\x{01}-\x{12f}\x{131}-\x{24f}\x{400}-\x{481}\x{2000}-\x{203f}"
    r"\x{3041}-\x{3093}\x{30a1}-\x{30f6}\x{4e00}-\x{9fa5}\x{ac00}-\x{d7a3}]|<\|"
)
# Longer ones go to the tokenizer itself, whose time does not grow with their square.
LONGEST_WORD = 1_000
# How a tokenizer with ends of words describes itself.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALIZERS = ["NFC", "Replace", "Lowercase"]


class _WordRanks:
    """A vocabulary numbered by its merges and with ends of words, encoded by ranks: the end
    is written as a byte 0, which joins the last letter before anything else is joined."""

    def __init__(self, vocabulary: dict[str, int]):
        import tiktoken

        letters, ranks = _bytes_by_letter(), {}
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, i in vocabulary.items():
            core = token.removesuffix("</w>")
            self.ends[i] = core != token
            ranks[bytes(map(letters.__getitem__, core)) + b"\0" * (core != token)] = i
        self.encoding: Any = tiktoken.Encoding(
            "words", pat_str=r"[^\s\x00]+\x00", mergeable_ranks=ranks, special_tokens={}
        )

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, edges) of all texts, of which text i has those from edges[i] to edges[i + 1].
        Each different word is encoded once; texts are gathered from these as arrays."""
        marked = pc.replace_substring_regex(pc.utf8_lower(texts), WORD, "\\0\0 ")
        split = pc.ascii_split_whitespace(marked)
        different = split.flatten().dictionary_encode()
        words = different.dictionary
        pool = self.encoding.encode_to_numpy(" ".join(words.to_pylist()), disallowed_special=()).astype("<u4", copy=False)
        # White space beyond ASCII can stand alone there, and is no word.
        sizes = np.zeros(len(words), np.int64)
        counts = np.diff(np.flatnonzero(self.ends[pool]), prepend=-1)
        sizes[pc.ends_with(words, "\0").to_numpy(zero_copy_only=False)] = counts
        codes, ends = different.indices.to_numpy(), split.offsets.to_numpy()
        upto = np.concatenate([[0], np.cumsum(sizes[codes])])
        first = np.cumsum(sizes) - sizes
        places = np.repeat(first[codes] - upto[:-1], sizes[codes]) + np.arange(upto[-1])
        return pool[places], upto[ends - ends[0]]


@cache
def _word_ranks(path: str) -> _WordRanks | None:
    """None if the file describes another kind of tokenizer."""
    with open(path, encoding="utf-8") as file:
        described = json.load(file)
    model, normalizer = described["model"], described.get("normalizer") or {}
    vocabulary = model.get("vocab")
    if model["type"] != "BPE" or model.get("end_of_word_suffix") != "</w>":
        return None
    named = [n["type"] for n in normalizer.get("normalizers", [])]
    before = described.get("pre_tokenizer") or {}
    split = [p.get("pattern", {}).get("Regex") for p in before.get("pretokenizers", [])]
    joined = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
    by_number = sorted(vocabulary, key=vocabulary.__getitem__)
    # 256 bytes, then these as ends of words, then what the merges make, in their order.
    if named != NORMALIZERS or split != [SPLIT, None] or by_number[512:] != joined:
        return None
    return _WordRanks(vocabulary)


def _apart(texts: pa.Array) -> np.ndarray:
    """Which texts the tokenizer itself must encode."""
    odd = pc.match_substring_regex(texts, OTHER).to_numpy(zero_copy_only=False).copy()
    split = pc.ascii_split_whitespace(texts)
    long = np.flatnonzero(pc.binary_length(split.flatten()).to_numpy() > LONGEST_WORD)
    ends = split.offsets.to_numpy()
    odd[np.searchsorted(ends - ends[0], long, "right") - 1] = True
    return odd


def word_ids(path: str, texts: pa.Array) -> Iterator[bytes]:
    """Ids of each text as little-endian 32-bit numbers, as the tokenizer gives them."""
    ranks = _word_ranks(path)
    apart = np.ones(len(texts), bool) if ranks is None else _apart(texts)
    others = iter(())
    if apart.any():
        taken = texts.filter(pa.array(apart)).to_pylist()
        found = _tokenizer(path).encode_batch_fast(taken, add_special_tokens=False)
        others = (np.array(e.ids, "<u4").tobytes() for e in found)
    if not apart.all():
        ids, edges = ranks.ids(texts.filter(pa.array(~apart)))
        held, edges = ids.tobytes(), (4 * edges).tolist()
        own = (held[a:b] for a, b in zip(edges, edges[1:], strict=False))
    for other in apart.tolist():
        yield next(others) if other else next(own)


def pieces_of(
    docs: DataFrame,
    path: str,
    id_column: str = "doc_id",
    text_column: str = "text",
    end_id: int = 1,
    capacity: int = 2048,
    waste: float = 1 / 128,
    texts_at_once: int = 512,
) -> DataFrame:
    """A row per piece: key, start, length, ids_crc32, doc_tokens, k, worker, and number,
    the piece's place among the worker's pieces of class k."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker = TaskContext.get().partitionId()
        counts: dict[int, int] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, texts_at_once):
                part = batch.slice(at, texts_at_once)
                texts = part.column("text").fill_null("").cast(pa.string())
                owner, rows = [], []
                for i, ids in enumerate(word_ids(path, texts)):
                    ids += end
                    total, start = len(ids) // 4, 0
                    for length in cut(total, capacity, waste):
                        k = capacity // length
                        number = counts.get(k, 0)
                        counts[k] = number + 1
                        crc = zlib.crc32(ids[4 * start : 4 * (start + length)])
                        owner.append(i)
                        rows.append((start, length, crc, total, k, worker, number))
                        start += length
                values = np.array(rows, np.int64).reshape(-1, 7)
                yield pa.RecordBatch.from_arrays(
                    [part.column("key").take(pa.array(owner, pa.int64())), *map(pa.array, values.T.copy())],
                    ["key", "start", "length", "ids_crc32", "doc_tokens", "k", "worker", "number"],
                )

    source = docs.select(docs[id_column].alias("key"), docs[text_column].alias("text"))
    kind = source.schema["key"].dataType.simpleString()
    return source.mapInArrow(
        run,
        f"key {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
        "k bigint, worker bigint, number bigint",
    )


def _first_fit(capacity: int):
    """Packs the few pieces left over, longest first, each into the fullest sequence
    that still has room."""
    import pandas as pd

    def run(pieces: pd.DataFrame) -> pd.DataFrame:
        pieces = pieces.sort_values(["length", "k", "number"], ascending=[False, True, True])
        free: list[int] = []
        sequence, offset = [], []
        for n in pieces["length"]:
            fitting = [(room, i) for i, room in enumerate(free) if room >= n]
            i = min(fitting)[1] if fitting else len(free)
            if i == len(free):
                free.append(capacity)
            sequence.append(i)
            offset.append(capacity - free[i])
            free[i] -= n
        return pieces.drop(columns="all").assign(bin=sequence, offset=offset)

    return run


def harmonic_packing(
    docs: DataFrame,
    path: str,
    id_column: str = "doc_id",
    text_column: str = "text",
    end_id: int = 1,
    capacity: int = 2048,
    waste: float = 1 / 128,
) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id and offset. ``path`` names the tokenizer's file,
    which every executor has."""
    pieces = checkpointed(pieces_of(docs, path, id_column, text_column, end_id, capacity, waste))
    # How many pieces of each class stand before a worker's: one row per worker and class.
    held = pieces.groupBy("worker", "k").agg(F.count("length").alias("n"))
    total = held.groupBy("k").agg(F.sum("n").alias("total"))
    earlier = F.sum("n").over(_by_worker())
    before = held.select("worker", "k", (F.coalesce(earlier, F.lit(0))).alias("before"))
    placed = pieces.join(before.join(total, "k"), ["worker", "k"]).withColumn(
        "number", F.col("number") + F.col("before")
    )
    full = F.col("number") < F.col("total") - F.col("total") % F.col("k")
    width = ["key", "start", "length", "ids_crc32", "doc_tokens", "k", "number"]
    in_class = F.floor(F.col("number") / F.col("k"))
    # Pieces of a class differ in length: offsets are sums over the k pieces of a sequence.
    inside = placed.where(full).select(*width, in_class.alias("bin"))
    inside = inside.withColumn("offset", F.coalesce(F.sum("length").over(_in_sequence()), F.lit(0)))
    few = placed.where(~full).select(*width)
    kind = few.schema["key"].dataType.simpleString()
    rest = few.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(
        _first_fit(capacity),
        f"key {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
        "k bigint, number bigint, bin bigint, offset bigint",
    )
    # Sequence ids: k in the low bits of class sequences; class 0 stands for the rest.
    shift = capacity + 1
    every = inside.unionByName(rest.withColumn("k", F.lit(0).cast("long")))
    return every.select(
        F.col("key").alias(id_column), "start", "length", "ids_crc32", "doc_tokens",
        (F.col("bin") * shift + F.col("k")).alias("sequence_id"), "offset",
    )


def _by_worker() -> WindowSpec:
    return Window.partitionBy("k").orderBy("worker").rowsBetween(Window.unboundedPreceding, -1)


def _in_sequence() -> WindowSpec:
    return (
        Window.partitionBy("k", "bin").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    )
