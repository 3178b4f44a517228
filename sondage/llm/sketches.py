"""Document fingerprints that can be subtracted: invertible Bloom lookup sketches of
paragraph digests.

A sketch has three tables of cells; a paragraph's 64-bit digest goes to one cell of each.
A cell holds how many digests it has and the XOR of them and of their checks. Cells of two
versions subtract; what both share cancels. Peeling then recovers the digests that differ:
a cell left with one digest (count 1 or -1 and a matching check) gives it, it is taken from
its other cells, and so on. If cells remain, the two are compared again with four times
as many cells, until all differences are recovered. The likeness of two sketches with a
and b paragraphs that differ in d is 1 - d / (a + b).

Paragraphs end at line breaks and after every sentence. A piece that is still long is cut
between two words whose touching letters have certain codes; where that leaves a long piece,
after words that end in such a letter, then after every word, then between two such letters.
Texts of less than ``SHORT`` characters are cut after every word and, in scripts without
spaces, every letter. Such cuts depend on the piece alone, so that an edit moves no cut far
away. What has no cut even so is cut into lengths of ``LONGEST``. Each step is one pass
of an expression without back-tracking. The n-th repetition of a paragraph in a text has
a digest of its own.

Everything is SQL. A text and what replaces its end are brought together by one shuffle of
the texts and one of their beginnings; the digests are then written to the shared folder in
buckets, so that cells, which are rows, are built, subtracted and peeled inside the bucket of
their document, without a shuffle. Only the digests of the next text are sent there once
more. Buckets are ``SPLITS`` times the session's shuffle partitions: cells are many times as
many as digests, and those of a bucket should fit the memory of its task.

Defined cases: a null text counts as empty, which is one empty paragraph; documents
follow each other by id, nulls first, then by a digest of their text; rows that repeat id
and text are one document in this order and give equal rows; a single document follows
itself; an empty table gives an empty table; only the named columns are read.
"""

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sondage.session import checkpointed, new_path

CELLS = 96
GROWTH = 4
ROUNDS = 4
TABLES = 3
SHORT = 200
LONGEST = 512
SPLITS = 4


def _every(first: int, last: int, width: int) -> str:
    """Ranges of a quarter of the characters from ``first`` on: ``width`` of each 4 * width."""
    return "".join(f"{chr(c)}-{chr(c + width - 1)}" for c in range(first, last, 4 * width))


def _chosen() -> str:
    """A quarter of the characters, by two bits of their codes."""
    return "(?:[#$'(+,/048<?@DHLPTX`dhlptx|]|(?=[^\\x00-\\x7f])(?:" + "|".join(
        f"(?=[{chr(a)}-{chr(b - 1)}])[{_every(a, b, width)}]"
        for a, b, width in [
            (0x80, 0x800, 4), (0x800, 0x1800, 4), (0x1800, 0x3000, 64), (0x3000, 0x3100, 4), (0x3100, 0xD800, 64),
            (0xE000, 0x10000, 64), (0x10000, 0x20000, 256), (0x20000, 0x32400, 256),
        ]
    ) + "))"


# Expressions that Java and Python read alike; a paragraph ends after each match.
CHOSEN = _chosen()
UNSPACED = "[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff]"
SENTENCE = "[.!?\u2026\u0589\u061f\u06d4\u0964\u0965\u1362][\"')\\]\u00bb\u2019\u201d]? |[\u3002\uff01\uff1f](?!\n)"
WORD = f" |{UNSPACED}(?={UNSPACED})"
# Pieces of more characters are cut by the expression, in turn.
LEVELS = ((200, f"{CHOSEN} (?={CHOSEN})"), (200, f"{CHOSEN} "), (200, " "), (200, f"{CHOSEN}(?={CHOSEN})"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _after_each(text: Column, expression: str) -> Column:
    return F.split(F.regexp_replace(text, expression, "$0\n"), "\n", -1)


def _pieces(parts: Column, levels: tuple[tuple[int, str], ...]) -> Column:
    """``parts`` with the long ones cut by the first of ``levels``, and so on."""

    def cut(p: Column) -> Column:
        if levels:
            return _pieces(_after_each(p, levels[0][1]), levels[1:])
        starts = F.sequence(F.lit(1), F.char_length(p), F.lit(LONGEST))
        return F.transform(starts, lambda i: F.substr(p, i, F.lit(LONGEST)))

    long = levels[0][0] if levels else LONGEST
    each = lambda p: F.when(F.char_length(p) > long, cut(p)).otherwise(F.array(p))
    return F.flatten(F.transform(parts, each))


def paragraphs(text: Column) -> Column:
    short = F.char_length(text) < SHORT
    return F.when(short, _after_each(text, WORD)).otherwise(_pieces(_after_each(text, SENTENCE), LEVELS))


def paragraph_digests(text: Column) -> Column:
    """A distinct 64-bit digest for every paragraph and repetition of it."""

    def numbered(parts: Column) -> Column:
        # Equal ones lie together; each group is numbered from 0.
        def counted(ordered: Column) -> Column:
            n = F.size(ordered)
            starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get(ordered, i) != F.get(ordered, i - 1)))

            def group(at: Column) -> Column:
                def digests(i: Column, j: Column) -> Column:
                    last = F.coalesce(F.get(at, j + 1), n) - i - 1
                    return F.transform(F.sequence(F.lit(0), last), lambda k: F.xxhash64(F.get(ordered, i), k))

                return F.flatten(F.transform(at, digests))

            return let(starts, group)

        # Without repetitions, as mostly, nothing has to be counted.
        single = F.size(F.array_distinct(parts)) == F.size(parts)
        plain = F.transform(parts, lambda x: F.xxhash64(x, F.lit(0)))
        return F.when(single, plain).otherwise(let(F.sort_array(parts), counted))

    return let(F.transform(paragraphs(text), lambda p: F.xxhash64(p)), numbered)


def _check(key: Column) -> Column:
    return F.xxhash64(key)


def _size(cells: int | Column) -> Column:
    """Cells of one table; ``cells`` are those of all tables, or a column with them."""
    return (cells if isinstance(cells, Column) else F.lit(cells)).cast("long") / TABLES


def _cell(key: Column, table: int | Column, size: Column) -> Column:
    size, table = F.floor(size), table if isinstance(table, Column) else F.lit(table)
    return (F.pmod(F.xxhash64(key, table), size) + table * size).cast("int")


def _held(cell: Column, n: Column, key: Column, check: Column) -> Column:
    return F.struct(cell.alias("cell"), n.cast("long").alias("n"), key.alias("key"), check.alias("check"))


def _summed(rows: DataFrame, by: list[str]) -> DataFrame:
    """Cells put together, those that hold nothing left out. Rows that are partitioned by
    the first of ``by`` stay where they are."""
    cells = rows.groupBy(*by, "cell").agg(
        F.sum("n").alias("n"), F.expr("bit_xor(key)").alias("key"), F.expr("bit_xor(check)").alias("check")
    )
    return cells.where("n <> 0 OR key <> 0 OR check <> 0")


def sketches(keys: DataFrame, by: list[str], cells: int | Column) -> DataFrame:
    """(by..., cell, n, key, check): the sketches of digests (by..., key, n), where n is 1
    for one version and -1 for the version to subtract."""
    key, table = F.col("key"), F.col("table")
    rows = keys.select("*", F.explode(F.array(*map(F.lit, range(TABLES)))).alias("table"))
    cell = _cell(key, table, _size(cells)).alias("cell")
    rows = rows.select(*by, cell, F.col("n").cast("long").alias("n"), key, _check(key).alias("check"))
    return _summed(rows, by)


def peeled(state: DataFrame, by: list[str], cells: int | Column) -> DataFrame:
    """(by..., differing, left): how many digests were recovered from a difference of
    sketches, and how many cells could not be resolved. What has no difference is absent.

    Each turn looks at one table, in which a digest has one cell: a cell that holds a
    single digest gives it, and it is taken from its cells in the other tables.
    """
    size, count = _size(cells), -1
    cell, n, key, check = (F.col(c) for c in ("cell", "n", "key", "check"))
    for turn in range(TABLES * ROUNDS):
        own = turn % TABLES
        single = (F.floor(cell / F.floor(size)) == own) & (F.abs(n) == 1) & (check == _check(key))
        nothing = F.lit(0).cast("long")
        taken = [_held(_cell(key, t, size), -n, key, check) for t in range(TABLES) if t != own]
        # Cell -1 counts what was recovered.
        after = F.when(single, F.array(*taken, _held(F.lit(count), F.lit(1), nothing, nothing)))
        after = after.otherwise(F.array(_held(cell, n, key, check)))
        state = _summed(state.select(*by, F.explode(after).alias("c")).select(*by, "c.*"), by)
    return state.groupBy(*by).agg(
        F.max(F.when(cell == count, n)).alias("differing"), F.count_if(cell != count).alias("left")
    )


def _tasks(rows: DataFrame) -> int:
    return SPLITS * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _digests(rows: DataFrame, sides: list[tuple[int, int, Column]], name: str, *more: Column) -> DataFrame:
    """(own, ``name``, n, key, ...): a row per digest of the arrays of ``sides`` (number, n,
    array)."""
    each = [F.struct(F.lit(i).alias(name), F.lit(n).alias("n"), keys.alias("keys")) for i, n, keys in sides]
    rows = rows.select("own", *more, F.explode(F.array(*each)).alias("side"))
    kept = [c for c in rows.columns if c not in ("own", "side")]
    return rows.select("own", f"side.{name}", "side.n", *kept, F.explode("side.keys").alias("key"))


def in_buckets(rows: DataFrame) -> DataFrame:
    """``rows`` written to the shared folder, by ``own``: what is grouped or joined by it
    later is not shuffled. Only the files stay, no name in the catalog."""
    spark, name = rows.sparkSession, f"sketches_{uuid.uuid4().hex}"
    # Digests repeat within a row, if anywhere: no dictionary finds that.
    how = {"path": new_path(spark, "sketches"), "compression": "zstd", "parquet.enable.dictionary": "false"}
    rows.write.bucketBy(_tasks(rows), "own").format("parquet").options(**how).saveAsTable(name)
    found = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return found


def compared(
    pairs: Callable[..., DataFrame], columns: dict[str, tuple[str, str]], cells: int = CELLS
) -> DataFrame:
    """(own, likeness...): how alike the arrays of digests named by ``columns`` (name ->
    left, right) are. ``pairs`` gives rows (own, unique, and the arrays), partitioned by
    ``own``: all, or those whose ``own`` a table lists; ``digests=False``: without arrays.
    Sketches have ``cells`` cells, or
    three for each digest if that is more; larger ones are tried for what these did not
    resolve."""
    out, again, names, growth = None, None, list(columns), 1
    while True:
        rest = pairs(again)
        sides = [
            (i, n, F.col(c)) for i, name in enumerate(names) for c, n in zip(columns[name], (1, -1), strict=True)
        ]
        totals = [sum((F.size(c) for c in columns[name]), F.lit(0)).alias(f"total{i}") for i, name in enumerate(names)]
        keys = _digests(rest, sides, "pair", *totals)
        # Room for all digests of both, since a text and the next differ in nearly all.
        total = F.get(F.array(*[f"total{i}" for i in range(len(names))]), "pair")
        room = F.greatest(F.lit(cells * growth), total * (TABLES * growth))
        keys = keys.select("own", "pair", "n", "key", total.alias("total"), room.alias("cells"))
        by = ["own", "pair", "total", "cells"]
        found = peeled(sketches(keys, by, F.col("cells")), by, F.col("cells"))
        # What has no difference is absent.
        left, alike = (
            [F.max(F.when(F.col("pair") == i, x)).alias(f"{c}{i}") for i in range(len(names))]
            for c, x in (("left", F.col("left")), ("alike", 1 - F.coalesce("differing", F.lit(0)) / F.col("total")))
        )
        found = found.groupBy("own").agg(*left, *alike)
        likeness = [
            F.when(F.coalesce(f"left{i}", F.lit(0)) == 0, F.coalesce(f"alike{i}", F.lit(1.0))).alias(name)
            for i, name in enumerate(names)
        ]
        every = pairs(again, digests=False)
        tried = checkpointed(every.join(found, "own", "left").select("own", *likeness))
        failed = F.lit(False)
        for name in names:
            failed |= F.col(name).isNull()
        done = tried.where(~failed)
        out = done if out is None else out.unionByName(done)
        again = tried.where(failed).select("own")
        if again.isEmpty():
            return out
        growth *= GROWTH


def written(pairs: DataFrame, columns: dict[str, Column], cells: int = CELLS) -> DataFrame:
    """(own, ...): the sketches of the digest arrays of ``columns`` (name -> array) of
    ``pairs`` (own, unique; from ``in_buckets``) in writing: number, count, key and check of
    every cell in use, by number, in hex, with a colon between them and a comma between
    cells. Numbers have any width."""
    rows = _digests(pairs, [(i, 1, keys) for i, keys in enumerate(columns.values())], "text")
    cell = F.concat_ws(
        ":", F.hex(F.col("cell").cast("long")), F.hex("n"), F.lpad(F.hex("key"), 16, "0"), F.lpad(F.hex("check"), 16, "0")
    )
    found = sketches(rows, ["own", "text"], cells).select("own", "text", F.struct("cell", cell.alias("written")).alias("c"))

    def of(i: int) -> Column:
        return F.array_sort(F.collect_list(F.when(F.col("text") == i, F.col("c"))))["written"]

    return found.groupBy("own").agg(*[F.array_join(of(i), ",").alias(name) for i, name in enumerate(columns)])


def in_order(rows: DataFrame) -> DataFrame:
    """(own, next): the ``own`` of each of ``rows`` (key, own) and of the row after it by
    key; after the last comes the first. ``own`` is unique."""
    part = F.spark_partition_id().alias("part")
    ranged = checkpointed(rows.select("key", "own").repartitionByRange("key", "own").select("key", "own", part))
    by = Window.partitionBy("part").orderBy("key", "own")
    # One row per partition of the sort.
    firsts = ranged.groupBy("part").agg(F.min_by("own", F.struct(F.col("key").isNotNull(), "key", "own")).alias("first"))
    every = Window.orderBy("part")
    whole = every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = F.coalesce(F.lead("first").over(every), F.first("first").over(whole))
    firsts = firsts.select("part", after.alias("after"))
    inside = ranged.withColumn("inside", F.lead("own").over(by))
    return inside.join(firsts, "part").select("own", F.coalesce("inside", "after").alias("next"))


def edited_fingerprints(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", cells: int = CELLS
) -> DataFrame:
    """One row per row of ``docs``: its text compared with an edited one, whose last
    quarter is replaced by as much of the beginning of the next text, and with that text."""
    key, text = docs[id_column], F.coalesce(docs[text_column], F.lit(""))
    # 128 bits name a document.
    own = F.unhex(F.left(F.sha2(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), text), 256), F.lit(32)))
    sizes = docs.select(key.alias("key"), own.alias("own"), F.char_length(text).cast("long").alias("n_chars"))
    sizes = checkpointed(sizes.groupBy("key", "own", "n_chars").agg(F.count(F.lit(1)).alias("copies")))
    ordered = in_order(sizes).join(sizes, "own")
    # What each text gives to the one before it. Both joins read the texts by ``own``
    # alone, so that one shuffle of them serves both. The number of tasks is fixed:
    # adaptive execution would choose it by bytes, but the work is in the cuts.
    tasks = _tasks(docs)
    texts = docs.select(own.alias("own"), text.alias("text")).repartition(tasks, "own")
    wanted = ordered.select(
        F.col("next").alias("own"), F.col("own").alias("before"), "key", "n_chars", "copies",
        F.floor(F.col("n_chars") / 4).alias("k"),
    )
    given = texts.join(wanted, "own").select(
        F.col("before").alias("own"), F.col("own").alias("next"), "key", "n_chars", "copies", "k",
        F.substr("text", F.lit(1), F.col("k").cast("int")).alias("beginning"),
    ).repartition(tasks, "own").dropDuplicates(["own"])
    head = F.substr("text", F.lit(1), (F.col("n_chars") - F.col("k")).cast("int"))
    both = texts.join(given, "own").dropDuplicates(["own"]).select(
        "own", "next", "key", "n_chars", "copies", "text", F.concat(head, "beginning").alias("edited")
    ).select(
        "own", "next", "key", "n_chars", "copies", F.unhex(F.sha2("edited", 256)).alias("edited_sha256"),
        paragraph_digests(F.col("text")).alias("keys"), paragraph_digests(F.col("edited")).alias("edited_keys"),
    )
    # Most digests of a text and of the edited one are the same: they are kept side by side.
    kept = in_buckets(both.select(
        "own", "next", "key", "n_chars", "copies", "edited_sha256", F.size("keys").alias("n"),
        F.concat("keys", "edited_keys").alias("digests"),
    ))
    keys = F.slice("digests", F.lit(1), F.col("n"))
    edited_keys = F.slice("digests", F.col("n") + 1, F.size("digests") - F.col("n"))

    def pairs(among: DataFrame | None, digests: bool = True) -> DataFrame:
        rows = kept if among is None else kept.join(among, "own", "left_semi")
        if not digests:
            return rows.select("own")
        after = rows.select(F.col("next").alias("own"), F.col("own").alias("before")).repartition(tasks, "own")
        sent = kept.select("own", keys.alias("next_keys")).join(after, "own")
        sent = sent.select(F.col("before").alias("own"), "next_keys").repartition(tasks, "own")
        return rows.join(sent, "own").select("own", keys.alias("keys"), edited_keys.alias("edited_keys"), "next_keys")

    near = {"near_edited": ("keys", "edited_keys"), "near_next": ("keys", "next_keys")}
    told = kept.select("own", "key", "n_chars", "copies", F.lower(F.hex("edited_sha256")).alias("edited_sha256"))
    prints = written(kept, {"fingerprint": keys, "edited_fingerprint": edited_keys}, cells)
    found = told.join(compared(pairs, near, cells), "own").join(prints, "own")
    found = found.withColumn("copy", F.explode(F.expr("sequence(1L, copies)")))
    return found.select(
        F.col("key").alias(id_column), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", *near
    )
