"""Toxicity after noisy-channel deobfuscation.

A hidden word passes a channel that writes letters as look-alikes (1d1ot), repeats them
(idiiot, idiooot) or spaces them out (i d i o t, i.d.i.o.t, idi-ot). Each disguised token
becomes a lattice of letters, in which a gap between spaced letters may end a word; Viterbi
decoding under a character trigram model, counted over all documents, restores the likeliest
words. Spaced letters count with every word that lies on a path at most ``MARGIN`` below the
best one, a token with separators with its parts and its joined form, a token whose only
disguise is a doubled letter also as it stands. The restored text is scored by words and word beginnings that
mark labelled toxic documents, with a logistic curve fitted on the training rows.

The model is small whatever the corpus: 28^3 letter counts, and a lexicon of significant
features from at most ``max_training`` labelled rows, those with the smallest hashes of
their ids. Scoring is one pass of Arrow batches; nothing is shuffled. It decodes the tokens
that can have a feature of the lexicon, whatever path Viterbi takes (``Beginnings``).

Defined cases: a null or empty text has no evidence and gets the curve's value at zero; of
several labels of an id the largest counts, null labels and ids are left out; without
labels of both kinds every score is the share of toxic labels (0 without any); repeated
rows are scored one by one; only the named columns are read.
"""

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate, takewhile

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sondage.llm import kernels

LETTERS = "abcdefghijklmnopqrstuvwxyz"
OTHER, EDGE = 26, 27  # any other letter; before and after a word
CODES = {c: i for i, c in enumerate(LETTERS)}
# What a look-alike may stand for.
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t",
    "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c",
    "*": "aeiou",
}
EDGE_MARKS = ".,;:!?|\"'()[]{}<>#%&*$+-_=/~`^\\"
# Marks that stand for nothing at the edges of a word ($ may be its first letter).
OUTER_MARKS = EDGE_MARKS.replace("$", "")
RUNS = re.compile(r"(?:(.)\1*(?:(.)\2*(?:(.)\3*)?)?)?", re.DOTALL)
LOG_SUBSTITUTED = math.log(0.05)
LOG_DELETED = math.log(0.2)
# How far below the likeliest path, in logs, a word among spaced letters may lie.
MARGIN = math.log(1000)
LOG_RUN = {1: (0.0, None), 2: (math.log(0.1), math.log(0.9)), 3: (math.log(0.6), math.log(0.4))}
PREFIXES = (4, 5, 6)
# Longest word looked for among some of the parts of a token; all parts are joined at any length.
JOINED = 40
CACHE_WORDS = 150_000
HIDDEN = re.compile(r"[0-9@$!|+(*]|([^\W\d_])\1\1")
DISGUISED = re.compile(r"[0-9@$!|+(*]|([^\W\d_])\1")
SEPARATED = re.compile(r"[.\-_*~/\\]+")
SPACED = re.compile(
    rb"(?<![^\x20\x09-\x0D])[a-z0-9@$!|+(][.\-_*]?"
    rb"(?:[\x20\x09-\x0D]+[a-z0-9@$!|+(][.\-_*]?){2,}(?![^\x20\x09-\x0D])"
)


@dataclass(frozen=True)
class ToxicityModel:
    """``letters``: log probability of a letter after two others; ``lexicon``: weight of a
    feature; ``slope``, ``offset``: the curve; ``cap``: largest evidence."""

    letters: np.ndarray
    lexicon: dict[str, float]
    slope: float
    offset: float
    cap: float = 20.0

    def score(self, evidence: np.ndarray) -> np.ndarray:
        z = self.offset + self.slope * np.minimum(evidence, self.cap)
        return 1 / (1 + np.exp(-z))


def _codes() -> np.ndarray:
    """Letter code per byte; bytes of longer characters count as one other letter each."""
    codes = np.full(256, EDGE, np.int64)
    for c, i in CODES.items():
        codes[ord(c)] = codes[ord(c.upper())] = i
    codes[0xC0:] = OTHER
    return codes


def letter_counts(docs: DataFrame, text_column: str = "text") -> np.ndarray:
    """Letter trigrams of all texts: 28^3 sums, whatever the input."""
    size = 28

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, total = _codes(), np.zeros(size**3, np.int64)
        for piece in kernels.pieces(batches):
            data, offsets = kernels.bytes_of(piece.column("text"))
            x = codes[data]
            x[offsets[1:-1][offsets[1:-1] < len(x)]] = EDGE  # texts do not run on
            x = np.concatenate([[EDGE, EDGE], x[(data & 0xC0) != 0x80], [EDGE]])
            total += np.bincount((x[:-2] * size + x[1:-1]) * size + x[2:], minlength=size**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["gram", "n"])

    source = docs.select(docs[text_column].alias("text"))
    rows = source.mapInArrow(run, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n")).collect()
    counts = np.zeros(size**3)
    for gram, n in rows:
        counts[gram] = n
    return counts.reshape(size, size, size)


def letter_model(counts: np.ndarray) -> np.ndarray:
    """Log probabilities, trigrams smoothed by bigrams and these by letters."""
    single = counts.sum((0, 1)) + 1
    single = single / single.sum()
    double = counts.sum(0) + 20 * single
    double = double / double.sum(1, keepdims=True)
    triple = counts + 20 * double[None]
    return np.log(triple / triple.sum(2, keepdims=True))


def _choices(run: str) -> list[tuple[str, float]]:
    """What a run of one character may stand for, with log probabilities."""
    c, n = run[0], len(run)
    once, twice = LOG_RUN[min(n, 3)]
    if c in LOOKALIKES:
        found = [(x, LOG_SUBSTITUTED) for x in LOOKALIKES[c]]
    elif c.isalpha():
        found = [(c, 0.0)]
    else:
        return [("", LOG_DELETED)]
    out = [(x, p + once) for x, p in found]
    if twice is not None:
        out += [(x + x, p + twice) for x, p in found]
    return out


def restore(token: str, letters: np.ndarray, gaps: frozenset[int] = frozenset()) -> str:
    """The likeliest word behind ``token``: Viterbi over the lattice of its runs, where a
    state is the last two letters. At ``gaps``, places in the token, a word may end; a space
    in the result says where one does."""
    # A reading is a chain (earlier reading, piece).
    states = {(EDGE, EDGE): (0.0, None)}
    for run in re.finditer(r"(.)\1*", token, re.DOTALL):
        if len(states) == 1 and not gaps and (z := CODES.get(run[0])) is not None:
            # One way on, which costs all readings the same.
            (((_, b), (score, before)),) = states.items()
            states = {(b, z): (score, (before, run[0]))}
            continue
        reached: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        choices = _choices(run[0])
        if gaps:
            if any(i in gaps for i in range(run.start() + 1, run.end())):
                split = LOG_RUN[1][0] if len(run[0]) == 2 else LOG_RUN[3][1]
                choices += [(f"{x} {x}", p - LOG_RUN[min(len(run[0]), 3)][0] + split) for x, p in choices if len(x) == 1]
            if run.end() in gaps:
                choices += [(f"{x} ", p) for x, p in choices if x]
        for (a, b), (score, before) in states.items():
            for piece, p in choices:
                x, y, total = a, b, score + p
                for c in piece:
                    z = EDGE if c == " " else CODES.get(c, OTHER)
                    total += letters[x][y][z]
                    x, y = y, z
                if (x, y) not in reached or total > reached[x, y][0]:
                    reached[x, y] = (total, (before, piece))
        states = reached
    _, chain = max(((s + letters[a][b][EDGE], c) for (a, b), (s, c) in states.items()), key=lambda x: x[0])
    pieces = []
    while chain:
        chain, piece = chain
        pieces.append(piece)
    return "".join(reversed(pieces))


def _gaps(parts: list[str]) -> frozenset[int]:
    return frozenset(accumulate(len(p) for p in parts[:-1]))


def _plain(token: str, letters: np.ndarray) -> str:
    return restore(token, letters) if DISGUISED.search(token) else token


def spaced(parts: list[str], letters: np.ndarray) -> list[list[str]]:
    """The words that may lie behind ``parts``, between any of which a word may end: a list
    for every place where some begin. The likeliest spelling is split in all ways that are
    at most MARGIN less likely than the best."""
    token = "".join(parts)
    whole, split = _plain(token, letters), restore(token, letters, _gaps(parts))
    out = _spans(split.replace(" ", ""), letters)
    if whole not in out[0]:
        out[0].append(whole)
    if whole != split.replace(" ", ""):
        out += _spans(whole, letters)
    return [words for words in out if words]


def _spans(text: str, letters: np.ndarray) -> list[list[str]]:
    """Of each place of ``text``, the words that begin there on paths within MARGIN."""
    n, codes = len(text), [CODES.get(c, OTHER) for c in text]
    if not n:
        return [[]]
    last = lambda i: codes[i - 1] if i else EDGE
    begin = [letters[last(i)][EDGE][codes[i]] for i in range(n)]
    second = [letters[EDGE][codes[i]][codes[i + 1]] for i in range(n - 1)]
    later = [0.0, 0.0, *(letters[codes[i - 2]][codes[i - 1]][codes[i]] for i in range(2, n))]
    one = [letters[EDGE][c][EDGE] for c in codes]  # the end of a word of one letter
    end = [0.0, *(letters[codes[i - 1]][codes[i]][EDGE] for i in range(1, n))]
    # Best way on from the end of a word before i; from inside a word of several letters before i.
    after, inside = [0.0] * (n + 1), [0.0] * (n + 1)
    inside[n] = end[n - 1]
    for i in range(n - 1, -1, -1):
        following = second[i] + inside[i + 2] if i + 1 < n else -math.inf
        after[i] = begin[i] + max(one[i] + after[i + 1], following)
        if i:
            inside[i] = max(end[i - 1] + after[i], later[i] + inside[i + 1])
    # Best way to a word that begins at i, and the words from there.
    before, out = [0.0] + [-math.inf] * n, []
    least = after[0] - MARGIN
    for i in range(n):
        words, score = [], before[i] + begin[i]
        for j in range(i, n):
            if j > i:
                score += second[i] if j == i + 1 else later[j]
                if score + inside[j + 1] < least:
                    break
            stop = score + (one[i] if j == i else end[j])
            before[j + 1] = max(before[j + 1], stop)
            if stop + after[j + 1] >= least:
                words.append(text[i : j + 1])
        out.append(words)
    return out


def _parts(token: str) -> list[str]:
    """The parts of a token between separators, without marks at its edges."""
    core = token.strip(EDGE_MARKS)
    at = token.find(core) if core else 0
    if not core or not any(c.isalpha() for c in core):
        return []
    if at == 1 and token[0] in "$@" and core[0].isalpha():
        core = token[0] + core  # $tupid
    return [p for p in SEPARATED.split(core) if p]


def _letter_by_letter(parts: list[str]) -> bool:
    return len(parts) >= 3 and all(len(p) <= 2 for p in parts)


def _neighbours(parts: list[str]) -> list[str]:
    """Parts joined with those after them, as long as ``JOINED`` letters suffice."""
    return [
        w for i in range(len(parts)) for w in takewhile(lambda w: len(w) <= JOINED, accumulate(parts[i:])) if w != parts[i]
    ]


def restored(token: str, letters: np.ndarray) -> list[str]:
    """The words behind one lower-case token, without marks at its edges."""
    parts = _parts(token)
    if not parts:
        return []
    whole = "".join(parts)
    if _letter_by_letter(parts):
        found = [_plain(whole, letters), *restore(whole, letters, _gaps(parts)).split()]
    elif len(parts) > 1:
        found = [*(_plain(p, letters) for p in parts), _plain(whole, letters)]
        if len(parts) > 2:
            found += [_plain(w, letters) for w in _neighbours(parts)]
    else:
        found = [_plain(whole, letters)]
    found += [p for p in parts if len(p) > 2 and DISGUISED.search(p) and not HIDDEN.search(p)]
    return list(dict.fromkeys(found))


def readings(token: str, letters: np.ndarray) -> list[str]:
    """All words that may lie behind one lower-case token."""
    parts, found = _parts(token), restored(token, letters)
    if _letter_by_letter(parts):
        found += [w for words in spaced(parts, letters) for w in words]
    return list(dict.fromkeys(found))


def features(word: str) -> list[str]:
    """The word and its beginnings."""
    return [f"{word}$", *[word[:n] for n in PREFIXES if len(word) > n]]


def beginning(word: str) -> str:
    """The first three runs of a word, a letter each."""
    start = word[:3]
    if len(start) == 3 and start[0] != start[1] != start[2]:
        return start
    return "".join(x for x in RUNS.match(word).groups() if x)


class Beginnings:
    """Which words of letters alone may have a feature of a lexicon. The channel changes the
    length of such a word's runs and nothing else, so the word, all that it may stand for and
    their features have the same runs in the same order, as far as they go. Other tokens
    (look-alikes, separators, digits) may always have one."""

    def __init__(self, lexicon):
        self.known = {beginning(f.rstrip("$")) for f in lexicon if f.rstrip("$")}
        self.short = {x for x in self.known if len(x) < 3}

    def may_matter(self, token: str) -> bool:
        core = token.strip(OUTER_MARKS)
        if not core.isalpha():
            return True
        start = beginning(core)
        return start in self.known or any(start[:n] in self.short for n in (1, 2))


class Reader:
    """Restored words of texts; remembers what a word becomes, in bounded memory. With
    ``lexicon``, words that can have none of its features are taken as ``use([])``
    without being decoded."""

    def __init__(self, letters: np.ndarray, use, lexicon=None):
        # Lists are read faster, one value at a time.
        self.letters, self.use, self.known = letters.tolist(), use, {}
        self.may_matter = Beginnings(lexicon).may_matter if lexicon is not None else lambda token: True
        self.nothing = use([])

    def __call__(self, text: bytes) -> list:
        text = text.lower()
        words = set(text.split())
        missing = words.difference(self.known)
        if len(self.known) + len(missing) > CACHE_WORDS:
            self.known, missing = {}, words
        for w in missing:
            token = w.decode().lower()
            matters = self.may_matter(token)
            self.known[w] = self.use(readings(token, self.letters)) if matters else self.nothing
        out = [x for w in words if (x := self.known[w])]
        for m in SPACED.finditer(text):
            run = [re.sub(r"[.\-_]+", "", w) for w in m[0].decode().split()]
            if any(c.isalpha() for w in run for c in w):
                out += [x for words in spaced(run, self.letters) if (x := self.use(words))]
        return out


def _training_rows(docs, labels, id_column, text_column, label_column, training, bound):
    """(text, toxic) of the labelled rows to learn from, at most ``bound`` ids."""
    chosen = (
        labels.select(labels[id_column].alias("key"), labels[label_column].alias("toxic"))
        .where(F.col("key").isNotNull() & F.col("toxic").isNotNull() & training(F.col("key")))
        .groupBy("key")
        .agg(F.max("toxic").cast("int").alias("toxic"))
        .orderBy(F.xxhash64("key"), "key")
        .limit(bound)
    )
    source = docs.select(docs[id_column].alias("key"), docs[text_column].alias("text"))
    rows = source.join(F.broadcast(chosen), "key")
    # A text that was copied many times is one witness.
    return rows.groupBy("text").agg(F.max("toxic").alias("toxic"))


def _feature_counts(rows: DataFrame, letters: np.ndarray) -> DataFrame:
    """(feature, toxic, clean): in how many training texts; feature '' counts them all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = Reader(letters, lambda words: [f for w in words for f in features(w)])
        for batch in batches:
            counts: dict[str, list[int]] = {}
            texts, toxic = batch.column("text").fill_null(""), batch.column("toxic").to_pylist()
            for text, label in zip(texts.cast(pa.large_binary()).to_pylist(), toxic, strict=True):
                for f in {"", *(f for found in read(text) for f in found)}:
                    counts.setdefault(f, [0, 0])[label == 0] += 1
            t, c = zip(*counts.values(), strict=True) if counts else ((), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(counts, pa.string()), pa.array(t, pa.int64()), pa.array(c, pa.int64())],
                ["feature", "toxic", "clean"],
            )

    counted = rows.mapInArrow(run, "feature string, toxic bigint, clean bigint")
    return counted.groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _evidence(texts: pa.Array, read: Reader) -> np.ndarray:
    texts = texts.fill_null("").cast(pa.large_binary())
    return np.array([sum(read(t)) for t in texts.to_pylist()], np.float64)


def _reader(model: ToxicityModel) -> Reader:
    weight = model.lexicon.get

    def best(words: list[str]) -> float:
        return max((weight(f, 0.0) for w in words for f in features(w)), default=0.0)

    return Reader(model.letters, best, model.lexicon)


def _lexicon(counts: DataFrame, max_features: int) -> dict[str, float]:
    """Features that mark toxic texts; the strongest ``max_features``.

    A likelihood ratio test, whose threshold grows with the number of features tried, drops
    chance finds. The weight is how far a careful estimate (Wilson's lower bound) of the
    share of toxic texts among those with the feature, at least a half, exceeds the share
    of all, in log odds."""
    total = counts.where("feature = ''").collect()
    if not total or not total[0]["toxic"] or not total[0]["clean"]:
        return {}
    toxic, clean = total[0]["toxic"], total[0]["clean"]
    share = toxic / (toxic + clean)
    n = F.col("toxic") + F.col("clean")

    def part(x: Column, expected: Column) -> Column:
        return F.when(x > 0, 2 * x * F.log(x / expected)).otherwise(0.0)

    test = part(F.col("toxic"), n * share) + part(F.col("clean"), n * (1 - share))
    p, z2 = F.col("toxic") / n, 4.0
    low = (p + z2 / (2 * n) - F.sqrt(z2 * (p * (1 - p) / n + z2 / (4 * n * n)))) / (1 + z2 / n)
    weight = F.log(low / (1 - low)) - math.log(share / (1 - share))
    tried = counts.where((F.col("feature") != "") & (n >= 3))
    threshold = 2 * math.log(2 * max(1, tried.count()))
    rows = (
        tried.where((low >= 0.5) & (test >= threshold))
        .select("feature", weight.alias("weight"), test.alias("test"))
        .orderBy(F.desc("test"), "feature")
        .limit(max_features)
        .collect()
    )
    return {r["feature"]: r["weight"] for r in rows}


def _curve(pairs: list[tuple[float, int, int]]) -> tuple[float, float]:
    """Slope and offset of a logistic curve through (evidence, toxic, clean), fitted by
    Newton steps with a weak prior that keeps separable data finite."""
    x = np.array([p[0] for p in pairs])
    toxic, clean = (np.array([p[i] for p in pairs], float) for i in (1, 2))
    design, beta = np.stack([x, np.ones_like(x)], 1), np.zeros(2)
    prior = np.array([[0.05, 0.0], [0.0, 0.01]])
    for _ in range(60):
        p = 1 / (1 + np.exp(-design @ beta))
        n = toxic + clean
        gradient = design.T @ (toxic - n * p) - prior @ beta
        step = np.linalg.solve(design.T @ (design * (n * p * (1 - p))[:, None]) + prior, gradient)
        beta = beta + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return max(0.0, float(beta[0])), float(beta[1])


def fit_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    training=lambda key: F.lit(True),
    id_column: str = "doc_id",
    text_column: str = "text",
    label_column: str = "toxic",
    max_training: int = 20_000,
    max_features: int = 5_000,
) -> ToxicityModel:
    """Letter statistics of all ``docs``; lexicon and curve from the labelled rows whose
    id satisfies ``training``."""
    letters = letter_model(letter_counts(docs, text_column))
    rows = _training_rows(docs, labels, id_column, text_column, label_column, training, max_training)
    counts = _feature_counts(rows, letters).where("feature = '' OR toxic + clean >= 3").cache()
    try:
        lexicon = _lexicon(counts, max_features)
        total = counts.where("feature = ''").collect()
    finally:
        counts.unpersist()
    toxic, clean = (total[0]["toxic"], total[0]["clean"]) if total else (0, 0)
    if not lexicon:
        share = min(max((toxic + 1e-9) / (toxic + clean + 1e-6), 1e-9), 1 - 1e-9)
        return ToxicityModel(letters, {}, 0.0, math.log(share / (1 - share)))
    model = ToxicityModel(letters, lexicon, 1.0, 0.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = _reader(model)
        for batch in batches:
            e = np.round(np.minimum(_evidence(batch.column("text"), read), model.cap), 1)
            yield pa.RecordBatch.from_arrays([pa.array(e), batch.column("toxic")], ["e", "toxic"])

    seen = rows.mapInArrow(run, "e double, toxic int").groupBy("e").agg(
        F.sum(F.when(F.col("toxic") != 0, 1).otherwise(0)).alias("t"),
        F.sum(F.when(F.col("toxic") == 0, 1).otherwise(0)).alias("c"),
    )  # at most 10 * cap + 1 rows
    slope, offset = _curve([tuple(r) for r in seen.collect()])
    return ToxicityModel(letters, lexicon, slope, offset)


def toxicity_score(model: ToxicityModel):
    """A column function: the score of a text column."""
    spread = {}

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        if "read" not in spread:  # once per task
            spread["read"] = _reader(model)
        return pa.array(model.score(_evidence(texts, spread["read"])))

    return score


def score_toxicity(
    docs: DataFrame,
    model: ToxicityModel,
    id_column: str = "doc_id",
    text_column: str = "text",
    threshold: float = 0.7,
) -> DataFrame:
    """One row per row of ``docs``: ``score`` and ``predicted`` (1 from ``threshold`` on)."""
    scored = docs.select(
        docs[id_column].alias(id_column), toxicity_score(model)(docs[text_column]).alias("score")
    )
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
