"""Fill-in-middle transformation through a learned index of token boundaries.

The boundaries of a text's tokens are a growing sequence: the k-th is the number of code
points in the first k tokens. A batch of texts is described by one piecewise-linear index:
a segment is a chord over consecutive boundaries; it is halved until no boundary lies
further than ``error`` code points from it, so that what is left over, the residual, fits
in a byte. A cut after k tokens is then predicted from its segment and made exact with the
stored residual; no text is split into tokens.

Tokens are words with the white space before them; white space behind the last word is a
token of its own. Cuts and form follow from the SHA-256 of seed and id alone, so that any
task, also one run again, gives the same result.

Defined cases: a null text counts as empty; empty texts and texts that hold a marker stay
as they are (form plain); a null id is hashed as empty text; repeated rows give repeated
results; an empty table gives an empty table; only the named columns are read.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sondage.llm.kernels import bytes_of, pieces, word_bounds

# What stands before prefix, suffix and middle.
MARKERS = ("<P>", "<S>", "<M>")


@dataclass
class RankIndex:
    """Values of several growing sequences by sequence and rank.

    ``bases`` holds the place of each sequence's rank 0; ``starts``, ``firsts`` and
    ``slopes`` describe the segments, by place; ``residuals`` has an entry per value.
    """

    bases: np.ndarray
    starts: np.ndarray
    firsts: np.ndarray
    slopes: np.ndarray
    residuals: np.ndarray

    def values(self, sequences: np.ndarray, ranks: np.ndarray) -> np.ndarray:
        places = self.bases[sequences] + ranks
        segments = np.searchsorted(self.starts, places, "right") - 1
        steps = places - self.starts[segments]
        return self.firsts[segments] + _rise(self.slopes[segments], steps) + self.residuals[places]


def _rise(slopes: np.ndarray, steps: np.ndarray) -> np.ndarray:
    return np.floor(slopes * steps + 0.5).astype(np.int64)


def fit_rank_index(values: np.ndarray, bases: np.ndarray, error: int = 127) -> RankIndex:
    """The index of the sequences that begin at ``bases`` in ``values``; none is empty."""
    residuals = np.zeros(len(values), np.int8 if error < 128 else np.int64)
    starts, ends = bases, np.append(bases[1:], len(values))
    done: list[tuple[np.ndarray, np.ndarray]] = []
    while len(starts):
        sizes = ends - starts
        slopes = (values[ends - 1] - values[starts]) / np.maximum(sizes - 1, 1)
        before = np.cumsum(sizes) - sizes
        steps = np.arange(sizes.sum()) - np.repeat(before, sizes)
        places = np.repeat(starts, sizes) + steps
        rest = values[places] - np.repeat(values[starts], sizes) - _rise(np.repeat(slopes, sizes), steps)
        near = np.maximum.reduceat(np.abs(rest), before) <= error
        inside = np.repeat(near, sizes)
        residuals[places[inside]] = rest[inside]
        done.append((starts[near], slopes[near]))
        middles = (starts + sizes // 2)[~near]
        starts, ends = (
            np.stack([starts[~near], middles], 1).ravel(), np.stack([middles, ends[~near]], 1).ravel()
        )
    found = np.concatenate([s for s, _ in done] or [bases])
    order = np.argsort(found)
    slopes = np.concatenate([s for _, s in done] or [np.zeros(0)])
    return RankIndex(bases, found[order], values[found[order]], slopes[order], residuals)


def token_boundaries(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The boundaries of all texts, each from 0 to its length in code points, and the place
    of each text's first one."""
    data, offsets = bytes_of(texts)
    n = len(offsets) - 1
    _, ends, owner = word_bounds(data, offsets)
    characters = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=characters[1:])
    # Behind the last word there may be white space; a text without words is all of it.
    last = offsets[:-1].copy()
    np.maximum.at(last, owner, ends)
    trailing = np.flatnonzero(last < offsets[1:])
    places = np.concatenate([offsets[:-1], ends, offsets[1:][trailing]])
    of = np.concatenate([np.arange(n), owner, trailing])
    order = np.lexsort((places, of))
    values = characters[places] - characters[offsets[:-1]][of]
    counts = np.bincount(of, minlength=n)
    return values[order], np.cumsum(counts) - counts


def fill_in_middle(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    seed: int = 42,
    percent: int = 50,
    suffix_first_percent: int = 80,
    error: int = 127,
) -> DataFrame:
    """One row per document: id, n (tokens), form, prefix_chars, middle_chars and output.

    ``percent`` of the documents are rearranged, of these ``suffix_first_percent`` as spm.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            values, bases = token_boundaries(batch.column("text"))
            index = fit_rank_index(values, bases, error)
            n = np.diff(np.append(bases, len(values))) - 1
            h = [batch.column(f"h{i}").to_numpy() for i in range(1, 5)]
            cuts = np.sort(np.stack([h[0] % (n + 1), h[1] % (n + 1)]), axis=0)
            rows = np.arange(batch.num_rows)
            starts, ends = index.values(rows, cuts[0]), index.values(rows, cuts[1])
            forms, outputs = [], []
            texts = batch.column("text").fill_null("").to_pylist()
            wanted = (h[2] % 100 < percent).tolist()
            spm = (h[3] % 100 < suffix_first_percent).tolist()
            for text, start, end, moved, first in zip(texts, starts.tolist(), ends.tolist(), wanted, spm, strict=True):
                if not text or not moved or any(m in text for m in MARKERS):
                    forms.append("plain")
                    outputs.append(text)
                    continue
                prefix, middle, suffix = text[:start], text[start:end], text[end:]
                p, s, m = MARKERS
                forms.append("spm" if first else "psm")
                outputs.append(
                    f"{s}{suffix}{p}{prefix}{m}{middle}" if first else f"{p}{prefix}{s}{suffix}{m}{middle}"
                )
            plain = np.array([f == "plain" for f in forms], bool)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("key"), pa.array(n, pa.int64()), pa.array(forms, pa.string()),
                    pa.array(starts, pa.int64(), mask=plain), pa.array(ends - starts, pa.int64(), mask=plain),
                    pa.array(outputs, pa.string()),
                ],
                ["key", "n", "form", "prefix_chars", "middle_chars", "output"],
            )

    key = docs[id_column]
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    numbers = [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]
    source = docs.select(key.alias("key"), docs[text_column].alias("text"), *numbers)
    kind = source.schema["key"].dataType.simpleString()
    found = source.mapInArrow(
        run, f"key {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"
    )
    return found.withColumnRenamed("key", id_column)


def restored(output: Column, form: Column) -> Column:
    """The text behind an output: no part of it holds a marker, so the first one met is the
    one written."""
    p, s, m = MARKERS
    body = F.substr(output, F.lit(len(p) + 1))

    def parts(second: str) -> tuple[Column, Column, Column]:
        one = F.substring_index(body, second, 1)
        rest = F.substr(body, F.length(one) + len(second) + 1)
        two = F.substring_index(rest, m, 1)
        return one, two, F.substr(rest, F.length(two) + len(m) + 1)

    prefix, suffix, middle = parts(s)
    suffix_first, prefix_second, middle_last = parts(p)
    return (
        F.when(form == "psm", F.concat(prefix, middle, suffix))
        .when(form == "spm", F.concat(prefix_second, middle_last, suffix_first))
        .otherwise(output)
    )
