"""Quality rules from repetition coverage: the share of characters inside repeated word
n-grams and repeated lines, from rolling hashes over whole texts.

One pass of Arrow batches over (id, text); nothing is shuffled, so hot sources and groups
of copies cost nothing extra. Each text is judged by itself.

Defined cases: a null text counts as empty; a text without words has zero everywhere and
fails the base rule; repeated rows are judged one by one; an empty table gives an empty
table; only the two named columns are read, so other columns cannot clash.
"""

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sondage.llm import kernels

SYMBOLS = b"#*$%&|<>"
IS_SYMBOL = np.zeros(256, bool)
IS_SYMBOL[list(SYMBOLS)] = True


@dataclass(frozen=True)
class RepetitionRules:
    """Largest allowed shares. ``ngrams``: of word characters inside n-grams that occur
    again, by n (the first occurrence does not count). ``line_chars``: of characters in
    lines equal to an earlier one. A fifth leaves room for a boilerplate line that a short
    text holds twice."""

    ngrams: dict[int, float] = field(default_factory=lambda: dict.fromkeys(range(5, 11), 0.20))
    line_chars: float = 0.20
    min_words: int = 50
    window_percent: int = 50


def _sum(owner: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(owner, weights, n).astype(np.int64)


def _covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of n words lie in a window of ``width`` words beginning at ``starts``."""
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + width, -1)
    return np.cumsum(edges[:-1]) > 0


def measure(texts: pa.Array, widths: list[int]) -> dict[str, np.ndarray]:
    """Counts per text; ``dup_chars_n`` for every n of ``widths``."""
    data, offsets = kernels.bytes_of(texts)
    n = len(offsets) - 1
    starts, ends, owner = kernels.word_bounds(data, offsets)
    spans = kernels.Spans(data, kernels.BYTE_VALUE)
    # Code points are the bytes that do not continue one.
    points = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=points[1:])
    length = points[ends] - points[starts]
    symbols = np.zeros(len(data) + 1, np.int64)
    np.cumsum(IS_SYMBOL[data], out=symbols[1:])
    out = {
        "n_words": np.bincount(owner, minlength=n).astype(np.int64),
        "word_chars": _sum(owner, length, n),
        "n_symbols": symbols[offsets[1:]] - symbols[offsets[:-1]],
    }
    out |= _lines(data, offsets, spans, points, starts, n)
    words = spans.hashes(starts, ends)
    salt = kernels.mixed(owner.astype(np.uint64) + np.uint64(1))
    total = len(words)
    last = np.cumsum(out["n_words"])[owner] if total else owner  # end of the text's words
    rolled, candidates = words.copy(), np.arange(total)
    factor, at = 1, 1
    for width in [3, *sorted(w for w in widths if w > 3)]:
        # A wider window can only repeat where the narrower one does.
        candidates = candidates[candidates + width <= last[candidates]]
        while at < width:
            factor = factor * int(kernels.BASE) % (1 << 64)
            rolled[: max(0, total - at)] += words[at:] * np.uint64(factor)
            at += 1
        many, again = kernels.repeated(rolled[candidates] ^ salt[candidates])
        if width == 3:
            inside = _covered(candidates[many], 3, total)
            out["n_repeat_words"] = _sum(owner, inside, n)
        if width in widths:
            inside = _covered(candidates[again], width, total)
            out[f"dup_chars_{width}"] = _sum(owner, length * inside, n)
        candidates = candidates[many]
    return out


def _lines(data, offsets, spans, points, starts, n) -> dict[str, np.ndarray]:
    """Lines with a word that equal an earlier line of their text, and their characters."""
    breaks = np.flatnonzero(data == 10)
    begins = np.concatenate([offsets[:-1], breaks + 1])
    stops = np.concatenate([offsets[1:], breaks])
    text = np.concatenate([np.arange(n), np.searchsorted(offsets, breaks, "right") - 1])
    order = np.lexsort((begins, text))
    begins, text = begins[order], text[order]
    # A line ends at the next break of its text or at the text's end.
    stops = offsets[text + 1].copy()
    if len(begins) > 1:
        inner = text[1:] == text[:-1]
        stops[:-1][inner] = begins[1:][inner] - 1
    full = np.searchsorted(starts, begins) < np.searchsorted(starts, stops)
    begins, stops, text = begins[full], stops[full], text[full]
    salt = kernels.mixed(text.astype(np.uint64) + np.uint64(1))
    again = kernels.repeated(spans.hashes(begins, stops) ^ salt)[1]
    size = points[stops] - points[begins]
    return {
        "n_lines": np.bincount(text, minlength=n).astype(np.int64),
        "line_chars": _sum(text, size, n),
        "n_dup_lines": _sum(text, again, n),
        "dup_line_chars": _sum(text, size * again, n),
    }


def repetition_quality(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    rules: RepetitionRules | None = None,
) -> DataFrame:
    """One row per row of ``docs``: its counts, ``base_failed``, and ``kept``, false if
    the base rule fails or any share passes its limit."""
    rules = rules or RepetitionRules()
    widths = sorted(rules.ngrams)
    counts = [
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines",
        "line_chars", "dup_line_chars", *[f"dup_chars_{w}" for w in widths],
    ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in kernels.pieces(batches):
            found = measure(piece.column("text"), widths)
            yield pa.RecordBatch.from_arrays(
                [piece.column("key"), *[pa.array(found[c], pa.int64()) for c in counts]],
                ["key", *counts],
            )

    source = docs.select(docs[id_column].alias("key"), docs[text_column].alias("text"))
    kind = source.schema["key"].dataType.simpleString()
    measured = source.mapInArrow(run, f"key {kind}, " + ", ".join(f"{c} bigint" for c in counts))
    base = (F.col("n_words") < rules.min_words) | (
        100 * F.col("n_repeat_words") > rules.window_percent * F.col("n_words")
    )
    over = F.col("dup_line_chars") > rules.line_chars * F.col("line_chars")
    for width, share in rules.ngrams.items():
        over |= F.col(f"dup_chars_{width}") > share * F.col("word_chars")
    return measured.select(
        F.col("key").alias(id_column), *counts, base.alias("base_failed"),
        (~base & ~over).alias("kept"),
    )
