"""Deobfuscation of words, and scores on held-out and disguised texts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sondage.llm import toxicity
from sondage.llm.queries import QUERIES


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    training = lambda key: F.crc32(key.cast("string").cast("binary")) % 3 != 1
    return toxicity.fit_toxicity(docs, labels, training)


def test_decoding_is_the_best_path(model):
    """Viterbi against all readings of a short token."""
    from itertools import groupby, product

    for token in ["1d10t", "s+up1d", "m00n", "a--b", "ll1", "5"]:
        runs = ["".join(g) for _, g in groupby(token)]
        best = max(
            (sum(p for _, p in choice) + likelihood("".join(w for w, _ in choice), model.letters), "".join(w for w, _ in choice))
            for choice in product(*map(toxicity._choices, runs))
        )
        assert toxicity.restore(token, model.letters) == best[1]


def likelihood(word, letters):
    x, y, total = toxicity.EDGE, toxicity.EDGE, 0.0
    for c in word:
        z = toxicity.CODES.get(c, toxicity.OTHER)
        total += letters[x, y, z]
        x, y = y, z
    return total + letters[x, y, toxicity.EDGE]


@pytest.mark.parametrize("token", ["1d10t", "id1ot", "i.d.i.o.t", "i-d-i-o-t", "idiooooot", "IDIOT###".lower(), "(idiot),"])
def test_restored_words(model, token):
    assert toxicity.restored(token, model.letters) == ["idiot"]


def test_held_out_rows(spark):
    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "toxic")
    rows = QUERIES["op8_deobfuscated_toxicity"](spark, folder).join(labels, "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    hit = [r["predicted"] for r in held if r["toxic"]]
    wrong = [r["predicted"] for r in held if not r["toxic"]]
    assert np.mean(hit) > 0.8 and np.mean(wrong) < 0.01


def test_disguises_score_like_plain_words(spark, model):
    texts = [(1, "the of and idiot thing moron in"), (2, "the of and 1d10t thing m0r0n in"), (3, "the i d i o t of m o r o n and"),
             (4, "the of and thing in"), (5, None), (6, ""), (6, ""), (7, "the " * 30_000)]
    df = spark.createDataFrame(texts, "doc_id long, text string").selectExpr("*", "0.0D AS score", "1 AS toxic")
    found = {r["doc_id"]: r for r in toxicity.score_toxicity(df, model).collect()}
    assert [found[i]["predicted"] for i in (1, 2, 3)] == [1, 1, 1]
    assert all(found[i]["predicted"] == 0 and 0 <= found[i]["score"] <= 1 for i in (4, 5, 6, 7))


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    for rows in ([], [(1, None), (None, 1)], [(1, 0)]):
        labels = spark.createDataFrame(rows, "doc_id long, toxic int")
        model = toxicity.fit_toxicity(docs, labels)
        assert [r["predicted"] for r in toxicity.score_toxicity(docs, model).collect()] == [0, 0]
    empty = docs.limit(0)
    assert toxicity.score_toxicity(empty, toxicity.fit_toxicity(empty, labels)).count() == 0


@pytest.mark.parametrize("token", ["stuupid", "idiiot", "stu-pid", "s.tupid", "st-up-id", "you.stu.pid", "a.i.d.i.o.t", "m-o-r-o-o-n"])
def test_words_behind_a_token(model, token):
    assert {"stupid", "idiot", "moron"} & set(toxicity.readings(token, model.letters))


@pytest.mark.parametrize(("run", "words"), [("a i d i o t", ["idiot"]), ("a s t u p i d", ["stupid"]), ("s t u p i d m o r o n", ["stupid", "moron"]),
                                            ("1 d 1 0 t", ["idiot"]), ("l o s e r", ["loser"]), ("y o u i d i o t", ["idiot"])])
def test_words_behind_spaced_letters(model, run, words):
    found = [w for group in toxicity.spaced(run.split(), model.letters) for w in group]
    assert set(words) <= set(found)


def test_words_that_begin_anywhere_are_the_near_paths(model):
    """All splits of a short text against those within the margin."""
    from itertools import combinations

    text, paths = "anidioton", {}
    for k in range(len(text)):
        for cuts in combinations(range(1, len(text)), k):
            at = (0, *cuts, len(text))
            words = [text[i:j] for i, j in zip(at, at[1:])]
            x, y, total = toxicity.EDGE, toxicity.EDGE, 0.0
            for c in " ".join(words) + " ":
                z = toxicity.EDGE if c == " " else toxicity.CODES[c]
                total += model.letters[x, y, z]
                x, y = y, z
            paths[at] = total
    best = max(paths.values())
    near = {(i, j) for at, p in paths.items() if p >= best - toxicity.MARGIN for i, j in zip(at, at[1:])}
    found = {(i, i + len(w)) for i, words in enumerate(toxicity._spans(text, model.letters)) for w in words}
    assert found == near


def test_lost_disguises_are_found(spark, model):
    texts = ["the stuupid of", "an idiiot the", "the a i d i o t of", "you are a s t u p i d the", "s t u p i d m o r o n",
             "the stu-pid of", "the s.tupid of", "the a.i.d.i.o.t of"]
    df = spark.createDataFrame([*enumerate(texts), (99, "the a b c d of well-known three"), (100, "e " * 20_000)], "doc_id long, text string")
    found = {r["doc_id"]: r["predicted"] for r in toxicity.score_toxicity(df, model).collect()}
    assert found == {**dict.fromkeys(range(len(texts)), 1), 99: 0, 100: 0}


def test_no_word_left_undecoded_matters(spark, model):
    """Every word of the table, and words with runs doubled at random, decoded and weighed."""
    rng = np.random.default_rng(5)
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    words = sorted({w for t in texts if t for w in t.lower().split()})[::3]
    known = [f.rstrip("$") for f in model.lexicon]
    words += ["".join(c * rng.integers(1, 4) for c in rng.choice(known) + rng.choice(["", "x", "eé", "!"])) for _ in range(20_000)]
    matters, letters = toxicity.Beginnings(model.lexicon).may_matter, model.letters.tolist()
    weighed = [any(f in model.lexicon for w in toxicity.readings(t, letters) for f in toxicity.features(w)) for t in words]
    assert all(matters(t) for t, found in zip(words, weighed, strict=True) if found)
    assert sum(weighed) > 5_000 and sum(map(matters, words[:-20_000])) < len(words[:-20_000]) // 2


def test_beginnings_of_short_and_repeated_features():
    matters = toxicity.Beginnings({"aaab": 1.0, "zz$": 1.0}).may_matter
    assert all(map(matters, ["ab", "aabb", "z", "zzz", "(zz),", "$b", "x1", "q-q", ""]))
    assert not any(map(matters, ["ba", "cab", "yz", "(yzz),"]))
