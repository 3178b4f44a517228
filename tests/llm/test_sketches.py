"""Sketches against exact differences of paragraph digests."""

import hashlib
import pathlib
import random
import re
import string

import pytest
from pyspark.sql import functions as F

from sondage.llm import sketches
from sondage.llm.queries import QUERIES


def after_each(text, expression):
    return re.sub(expression, lambda m: m[0] + "\n", text).split("\n")


def cut(text):
    """The paragraphs of a text, one level after the other."""
    if len(text) < sketches.SHORT:
        return after_each(text, sketches.WORD)
    parts = after_each(text, sketches.SENTENCE)
    # Only what a level has cut goes on to the next.
    done = []
    for longest, expression in sketches.LEVELS:
        done += [p for p in parts if len(p) <= longest]
        parts = [q for p in parts if len(p) > longest for q in after_each(p, expression)]
    for p in parts:
        done += [p[i : i + sketches.LONGEST] for i in range(0, len(p), sketches.LONGEST)] or [""]
    return done


def paragraphs(text):
    """(paragraph, number of equal ones before it)."""
    seen, out = {}, set()
    for p in cut(text):
        out.add((p, seen.get(p, 0)))
        seen[p] = seen.get(p, 0) + 1
    return out


def plain(rows):
    rows = sorted({(i, t or "") for i, t in rows}, key=lambda r: (r[0] is not None, r[0] or 0, order(*r)))
    out = {}
    for (i, text), (_, after) in zip(rows, rows[1:] + rows[:1]):
        k = len(text) // 4
        edited = text[: len(text) - k] + after[:k]

        def likeness(other):
            a, b = paragraphs(text), paragraphs(other)
            return 1 - len(a ^ b) / (len(a) + len(b))

        out[i, text] = (len(text), hashlib.sha256(edited.encode()).hexdigest(), likeness(edited), likeness(after))
    return out


def order(i, text):
    return hashlib.sha256(f"{'' if i is None else i}:{text}".encode()).hexdigest()


def check(found, rows):
    expected = plain(rows)
    got = sorted((str(r["doc_id"]), r["n_chars"], r["edited_sha256"], r["near_edited"], r["near_next"]) for r in found)
    wanted = sorted((str(i), *expected[i, t or ""]) for i, t in rows)
    assert [g[:3] for g in got] == [w[:3] for w in wanted]
    assert [x for g in got for x in g[3:]] == pytest.approx([x for w in wanted for x in w[3:]], abs=1e-12)


def test_query(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    found = QUERIES["op5_invertible_sketches"](spark, folder).collect()
    check(found, [tuple(r) for r in docs])
    texts = {r[0]: r[1] for r in docs}
    prints = {}
    for r in found:
        assert prints.setdefault(r["fingerprint"], texts[r["doc_id"]]) == texts[r["doc_id"]]
    assert len(prints) == len(set(texts.values()))


def test_small_cases(spark):
    rows = [
        (3, "a\nb\nc\nd"), (1, None), (2, ""), (5, "é 😀 ñ. And so. but. Any"), (5, "other"), (9, "x\n" * 300),
        (9, "x\n" * 300), (None, "null id\nx"), (12, "\n".join(f"line {i}" for i in range(700))), (20, "q"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS own", "2 AS keys", "3 AS k")
    check(sketches.edited_fingerprints(df).collect(), rows)


def test_one_and_none(spark):
    df = spark.createDataFrame([(4, "abcdefgh")], "doc_id long, text string")
    (row,) = sketches.edited_fingerprints(df).collect()
    assert row["edited_sha256"] == hashlib.sha256(b"abcdefab").hexdigest() and row["near_next"] == 1.0
    assert sketches.edited_fingerprints(df.limit(0)).count() == 0


def test_peeling_recovers_the_difference(spark):
    """Of 60 and 54 digests 14 differ, on both sides, whatever they share."""
    rows = [("x", k, 1) for k in range(60)] + [("x", k, -1) for k in range(10, 64)]
    rows += [("same", k, n) for k in range(30) for n in (1, -1)] + [("many", k, 1) for k in range(400)]
    keys = spark.createDataFrame(rows, "own string, key long, n int")
    found = {r["own"]: r for r in sketches.peeled(sketches.sketches(keys, ["own"], 96), ["own"], 96).collect()}
    assert (found["x"]["differing"], found["x"]["left"]) == (14, 0)
    assert "same" not in found and found["many"]["left"] > 0
    found = sketches.peeled(sketches.sketches(keys, ["own"], 960), ["own"], 960).where("own = 'many'").first()
    assert (found["differing"], found["left"]) == (400, 0)


def test_order_over_partitions(spark):
    rows = spark.range(1000).selectExpr("id * 7 % 1000 AS key", "concat('o', id * 7 % 1000) AS own").repartition(13)
    found = dict(sketches.in_order(rows).collect())
    assert found == {f"o{i}": f"o{(i + 1) % 1000}" for i in range(1000)}


def test_every_text_has_many_paragraphs(spark):
    """Texts on one line, in several scripts: the edited text is clearly nearer than another."""
    rng = random.Random(5)

    def words(letters, n):
        return ["".join(rng.choices(letters, k=rng.randint(2, 9))) for _ in range(n)]

    latin, cyrillic, han = string.ascii_lowercase, "абвгдежзийклмнопрстуфхцчшщыьэюя", [chr(0x4E00 + i) for i in range(3000)]
    texts = []
    for n in (12, 40, 150, 1000, 5000):
        texts += [" ".join(words(latin, n)), " ".join(words(cyrillic, n)), "".join(rng.choices(han, k=2 * n))]
        texts += [" ".join(w.capitalize() + "." for w in words("fghmnstuvw", n)), "".join(words(latin + "0123456789", n))] * (n > 40)
    texts += ["the " * 3000, "zz" * 5000, " ".join(f"{i}.{i * i % 97}" for i in range(2000))]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for r in sketches.edited_fingerprints(df).collect():
        if r["n_chars"] > 60:
            assert r["near_edited"] > r["near_next"] + 0.2, (r["doc_id"], r["n_chars"], r["near_edited"], r["near_next"])


def test_repeated_paragraphs_are_numbered(spark):
    text = "b\na\nb\nc\nb\na"
    df = spark.createDataFrame([(text + "\n" * 205,)], "text string")
    found = df.select(sketches.paragraph_digests(F.col("text"))).first()[0]
    wanted = [("a", 2), ("b", 3), ("c", 1), ("", 205)]
    rows = spark.createDataFrame([(p, k) for p, n in wanted for k in range(n)], "p string, k int")
    assert sorted(found) == sorted(r[0] for r in rows.select(F.xxhash64(F.xxhash64("p"), "k")).collect())


def cells_of(fingerprint):
    out = {}
    for cell in fingerprint.split(","):
        number, n, key, check = (int(x, 16) for x in cell.split(":"))
        out[number] = (n, key, check)
    return out


@pytest.mark.parametrize("cells", [96, 960])
def test_fingerprint_is_read_back(spark, cells):
    """Of 10,000 lines: all cells with their counts, as from the digests."""
    text = "\n".join(f"line{i % 9000}" for i in range(10_000))
    df = spark.createDataFrame([(1, text), (2, "x\ny")], "doc_id long, text string")
    row = sketches.edited_fingerprints(df, cells=cells).where("doc_id = 1").first()
    edited = text[: len(text) - len(text) // 4] + "x\ny"[: len(text) // 4]
    for name, whole in (("fingerprint", text), ("edited_fingerprint", edited)):
        keys = spark.createDataFrame([(whole,)], "text string").select(
            F.lit(1).alias("own"), F.explode(sketches.paragraph_digests(F.col("text"))).alias("key"), F.lit(1).alias("n")
        )
        wanted = {r["cell"]: tuple(x % 2**64 for x in (r["n"], r["key"], r["check"])) for r in sketches.sketches(keys, ["own"], cells).collect()}
        found = cells_of(row[name])
        assert found == wanted
        assert sum(n for n, _, _ in found.values()) == 3 * len(paragraphs(whole))


def test_cells_stay_in_their_bucket(spark):
    pairs = spark.range(20).select(F.col("id").cast("string").alias("own"), F.array("id").alias("keys"))
    placed = sketches.in_buckets(pairs)
    keys = placed.select("own", F.explode("keys").alias("key"), F.lit(1).alias("n"))
    cells = sketches.sketches(keys, ["own"], 96)
    assert cells.count() == 60
    assert "Exchange" not in cells._jdf.queryExecution().executedPlan().toString()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("sketches_")]


def test_digests_are_kept_once(spark):
    """The shared folder holds the digests of the text and of the edited one, which are
    mostly the same, and not those of the next text."""
    rows = [(i, "\n".join(f"text {i} line {j}" for j in range(4000))) for i in range(8)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    folder = pathlib.Path(spark.sparkContext.getCheckpointDir().removeprefix("file:")).parent
    size = lambda: sum(p.stat().st_size for p in folder.rglob("sketches-*/*.parquet"))
    before = size()
    found = sketches.edited_fingerprints(df).collect()
    assert [r["near_next"] for r in found] == [0.0] * 8 and all(0.5 < r["near_edited"] < 0.8 for r in found)
    # 8 bytes are a digest; a quarter of the edited text's are others.
    assert 8 * 4000 * 8 < size() - before < 8 * 4000 * 16


def test_buckets_are_smaller_than_shuffle_partitions(spark):
    rows = spark.range(50).select(F.col("id").cast("string").alias("own"))
    assert sketches.in_buckets(rows.repartition(3)).count() == 50
    assert sketches._tasks(rows) == 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
