"""Repetition coverage against a plain count over each text."""

import re

import pytest
from pyspark.sql import functions as F

from sondage.llm.repetition import RepetitionRules, repetition_quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text, rules):
    text = text or ""
    words = WORD.findall(text)

    def covered(width, later):
        seen, inside = {}, set()
        windows = [tuple(words[i : i + width]) for i in range(len(words) - width + 1)]
        for w in windows:
            seen[w] = seen.get(w, 0) + 1
        met = set()
        for i, w in enumerate(windows):
            if seen[w] > 1 and (not later or w in met):
                inside.update(range(i, i + width))
            met.add(w)
        return inside

    lines = [x for x in text.split("\n") if WORD.search(x)]
    again = [x for i, x in enumerate(lines) if x in lines[:i]]
    out = {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_dup_lines": len(again),
        "n_repeat_words": len(covered(3, False)),
        "n_lines": len(lines),
        "line_chars": sum(map(len, lines)),
        "dup_line_chars": sum(map(len, again)),
    }
    for n in rules.ngrams:
        out[f"dup_chars_{n}"] = sum(len(words[i]) for i in covered(n, True))
    out["base_failed"] = len(words) < 50 or 100 * out["n_repeat_words"] > 50 * len(words)
    over = out["dup_line_chars"] > rules.line_chars * out["line_chars"] or any(
        out[f"dup_chars_{n}"] > share * out["word_chars"] for n, share in rules.ngrams.items()
    )
    out["kept"] = not out["base_failed"] and not over
    return out


def check(found, texts):
    rules = RepetitionRules()
    expected = sorted((i, sorted(plain(t, rules).items())) for i, t in texts)
    got = sorted((r["doc_id"], sorted((k, v) for k, v in r.asDict().items() if k != "doc_id")) for r in found.collect())
    assert got == expected


def test_small_cases(spark):
    many = " ".join(f"w{i}" for i in range(60))
    texts = [
        (1, None), (2, ""), (3, " \n\t"), (4, "a"), (5, "é b c\nd\n\nd\nd \n"), (6, many),
        (7, many + "\n" + many), (7, many + "\n" + many), (8, "x y z " * 40), (9, "a b c a b c a"),
        (10, "日本 語 # $ 😀 日本 語 #\x0b\x0c\r q"), (11, many + " " + " ".join(f"w{i}" for i in range(14))),
        (12, "ab\na b\nab\n\n a b\na b"), (13, "Ä" * 3000 + " " + many),
    ]
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumn("key", F.lit("x"))
    check(repetition_quality(df.withColumn("n_words", F.lit(1))), texts)


def test_rows_of_table(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    check(repetition_quality(docs), [(r[0], r[1]) for r in docs.select("doc_id", "text").collect()])


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert repetition_quality(df).count() == 0


@pytest.mark.parametrize("size", [1, 7])
def test_pieces_do_not_matter(spark, folder, monkeypatch, size):
    from sondage.llm import kernels

    docs = spark.read.parquet(f"{folder}/documents.parquet").coalesce(1).limit(40)
    import pyarrow as pa

    batch = pa.RecordBatch.from_pandas(docs.select("doc_id", "text").toPandas())
    monkeypatch.setattr(kernels, "PIECE_BYTES", size)
    cut = list(kernels.pieces([batch]))
    assert sum(p.num_rows for p in cut) == batch.num_rows == len(cut)
