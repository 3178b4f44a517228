"""Mixing to target weights when a document's domain is only known in probability.

A naive Bayes classifier over hashed words and a few shape features, counted on labelled
rows, gives every document a posterior over the domains, softened by a temperature that is
chosen on rows kept out of the counts. Document rates r >= 0 are then fitted so that the
expected tokens of each domain, the sum of rate x tokens x posterior, match their targets:
weighted least squares with a small pull towards rate 1, by projected gradient. A rate
depends on the posterior alone, so documents whose (rounded) posteriors agree share it and
each step aggregates one row per distinct posterior, not per document.

Everything is DataFrame functions. What reaches the driver or is broadcast has a fixed
size: 2^18 buckets of features with a weight per domain, of which few are significant, and
one number per domain and step. Classifier rows are the ``max_training`` labelled ids with the
smallest hashes; tokens, posteriors and totals cover all documents.

Defined cases: a null or empty text has no words, no tokens, and the rate of its shape; of
several labels of an id the largest domain counts, null labels and ids are left out;
without labelled rows of every domain there is nothing to go by and all rates are 1; a
target of a domain without documents
cannot be met and is approached as far as others allow; rows that repeat id and text get
equal rates; an empty table gives an empty table; other columns pass through ``mixed``.
"""

from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sondage.session import checkpointed

BUCKETS = 1 << 18
BINS = 64
SPACE = "[\\x20\\x09-\\x0D]+"
PRIOR = 10.0
TEMPERATURES = (1.0, 2.0, 4.0, 8.0, 16.0, 32.0)


@dataclass(frozen=True)
class DomainModel:
    """``weights`` (feature, w: per domain, log of how much likelier the feature is there
    than overall), at most BUCKETS + 1 rows; others weigh 0. ``prior``: log shares.
    ``informed``: whether every domain had labelled rows."""

    domains: tuple[str, ...]
    weights: DataFrame
    prior: tuple[float, ...]
    temperature: float = 1.0
    informed: bool = True


def free_names(docs: DataFrame, *names: str) -> list[str]:
    """``names`` with as many underscores before them as make them no columns of ``docs``."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name in taken:
            name = f"_{name}"
        out.append(name)
    return out


def row_key(docs: DataFrame, id_column: str, text_column: str) -> list[Column]:
    """Two 64-bit hashes that together name a document."""
    key = F.coalesce(docs[id_column].cast("string"), F.lit(""))
    text = F.coalesce(docs[text_column], F.lit(""))
    return [F.xxhash64(key, text).alias("row1"), F.xxhash64(text, key, F.lit(1)).alias("row2")]


def _features(texts: DataFrame) -> DataFrame:
    """``texts`` (with ``text``) with n_tokens and ``tokens`` instead: its different words
    and its shape. The first token is every document's, so that none is lost where only
    features with a weight go on."""
    words = F.array_remove(F.split(F.lower("text"), SPACE, -1), "")
    rows = texts.withColumn("words", words).withColumn("kinds", F.array_distinct("words"))
    n, size = F.size("words"), F.greatest(F.char_length("text"), F.lit(1))

    def share(marks: str) -> Column:
        return (size - F.char_length(F.regexp_replace("text", f"[{marks}]+", ""))) / size

    def binned(x: Column, kind: int) -> Column:
        # No word has a space in it.
        at = F.least(F.greatest(F.floor(x), F.lit(0)), F.lit(BINS - 1))
        return F.concat(F.lit(f" {kind} "), at.cast("string"))

    some = F.greatest(n, F.lit(1))
    length = F.floor(F.log2(n + 1.0))
    shape = [
        binned(40 * F.sqrt(share("#*$%&|<>!")), 0),
        binned(40 * F.sqrt(share("A-Z")), 1),
        binned(40 * F.sqrt(share("0-9")), 2),
        # How many words repeat depends on the length.
        binned(8 * F.least(F.floor(length / 2), F.lit(7)) + 7 * F.size("kinds") / some, 3),
        binned(2 * (size - n) / some, 4),
        binned(length, 5),
    ]
    tokens = F.concat(F.array(F.lit(" "), *shape), F.col("kinds"))
    return rows.select(
        *[c for c in texts.columns if c != "text"], n.cast("long").alias("n_tokens"), tokens.alias("tokens")
    )


def _exploded(featured: DataFrame, keep: list[str]) -> DataFrame:
    """``keep``, ``at`` and ``feature``: a row per token."""
    # No text is without tokens. Outer, or Spark would first drop those by a filter that
    # works the tokens out from the text, several times.
    rows = featured.select(*keep, F.posexplode_outer("tokens").alias("at", "token"))
    hashed = F.pmod(F.xxhash64("token"), F.lit(BUCKETS)).cast("int")
    return rows.select(*keep, "at", F.when(F.col("at") == 0, BUCKETS).otherwise(hashed).alias("feature"))


def _scores(featured: DataFrame, model: DomainModel, keep: list[str]) -> DataFrame:
    """``keep`` columns with ``s0``, ``s1``, ...: log score of each domain, and n_copies.
    ``keep`` names a document; rows that repeat it have equal features, so that scores are
    means over copies."""
    # At most BUCKETS + 1 rows.
    rows = _exploded(featured, [*keep, "n_tokens"]).join(F.broadcast(model.weights), "feature")
    copies = F.sum(F.when(F.col("at") == 0, 1).otherwise(0))
    return rows.groupBy(*keep).agg(
        F.max("n_tokens").alias("n_tokens"), copies.alias("n_copies"),
        *[(F.sum(F.col("w")[k]) / copies + model.prior[k]).alias(f"s{k}") for k in range(len(model.domains))],
    )


def _posterior(k: int, n: int, temperature: float) -> Column:
    total = F.lit(0.0)
    for j in range(n):
        total = total + F.exp(F.least((F.col(f"s{j}") - F.col(f"s{k}")) / temperature, F.lit(700.0)))
    return 1 / total


def fit_domains(
    docs: DataFrame,
    labelled: DataFrame,
    domains: tuple[str, ...],
    id_column: str = "doc_id",
    text_column: str = "text",
    max_training: int = 20_000,
) -> DomainModel:
    """A classifier from ``labelled`` (``id_column``, ``domain``: one of ``domains``)."""
    number = F.lit(None).cast("int")
    for k, name in enumerate(domains):
        number = F.when(F.col("domain") == name, k).otherwise(number)
    chosen = (
        labelled.select(labelled[id_column].alias("key"), number.alias("k"))
        .where("key IS NOT NULL AND k IS NOT NULL")
        .groupBy("key").agg(F.max("k").alias("k"))
        .orderBy(F.xxhash64("key"), "key").limit(max_training)
    )
    texts = docs.select(
        docs[id_column].alias("key"), F.coalesce(docs[text_column], F.lit("")).alias("text"),
        *row_key(docs, id_column, text_column),
    ).join(F.broadcast(chosen), "key")
    featured = checkpointed(_features(texts))  # at most max_training ids
    tested = F.pmod(F.xxhash64("key", F.lit(7)), F.lit(4)) == 0
    n = len(domains)

    def counted(rows: DataFrame) -> DomainModel:
        sizes = {r["k"]: (r["docs"], r["held"]) for r in rows.groupBy("k").agg(
            F.count("key").alias("docs"), F.sum(F.size("tokens") - 1).alias("held")).collect()}
        docs_of = np.array([sizes.get(k, (0, 0))[0] + 0.5 for k in range(n)])
        held = np.array([sizes.get(k, (0, 0))[1] + 0.5 for k in range(n)])
        share = (held / held.sum()).tolist()
        counts = _exploded(rows, ["k"]).where("at > 0").groupBy("feature").agg(
            *[F.sum(F.when(F.col("k") == k, 1).otherwise(0)).alias(f"c{k}") for k in range(n)]
        )
        # How much likelier than overall: a domain's part of a feature's occurrences, as
        # if PRIOR more had been seen in the overall proportions.
        every = sum((F.col(f"c{k}") for k in range(n)), F.lit(0.0))
        # Features whose parts differ by more than chance explains among so many features:
        # the others would add up to noise.
        test = sum((
            F.when(F.col(f"c{k}") > 0, 2 * F.col(f"c{k}") * F.log(F.col(f"c{k}") / every / share[k])).otherwise(0.0)
            for k in range(n)
        ), F.lit(0.0))
        weights = counts.where(test >= 2 * float(np.log(2 * BUCKETS))).select("feature", F.array(*[
            F.log((F.col(f"c{k}") + PRIOR * share[k]) / (every + PRIOR) / share[k]) for k in range(n)
        ]).alias("w"))
        always = rows.sparkSession.createDataFrame([(BUCKETS, [0.0] * n)], "feature int, w array<double>")
        weights = weights.union(always)
        prior = tuple(np.log(docs_of / docs_of.sum()).tolist())
        return DomainModel(domains, checkpointed(weights), prior, informed=len(sizes) == n)

    # The temperature with the least log loss on a quarter that is not counted.
    trial = counted(featured.where(~tested))
    scored = _scores(featured.where(tested), trial, ["row1", "row2", "k"])
    losses = scored.agg(*[
        F.avg(sum((F.when(F.col("k") == k, -F.log(F.greatest(_posterior(k, n, t), F.lit(1e-12)))).otherwise(0.0) for k in range(n)), F.lit(0.0)))
        for t in TEMPERATURES
    ]).first()
    best = min((loss, t) for loss, t in zip(losses, TEMPERATURES, strict=True)) if losses[0] is not None else (0, 1.0)
    model = counted(featured)
    return replace(model, temperature=best[1])


def posteriors(
    docs: DataFrame, model: DomainModel, id_column: str = "doc_id", text_column: str = "text", digits: int = 3
) -> DataFrame:
    """(key, row1, row2, n_tokens, p0, p1, ...): one row per different document, the
    posteriors rounded to ``digits``."""
    texts = docs.select(
        docs[id_column].alias("key"), F.coalesce(docs[text_column], F.lit("")).alias("text"),
        *row_key(docs, id_column, text_column),
    )
    n = len(model.domains)
    scored = _scores(_features(texts), model, ["key", "row1", "row2"])
    return scored.select("key", "row1", "row2", "n_tokens", "n_copies", *[
        F.round(_posterior(k, n, model.temperature), digits).alias(f"p{k}") for k in range(n)
    ])


def fit_rates(
    known: DataFrame,
    weights: list[float],
    total: float | None = None,
    whole: int | None = None,
    most: float | None = None,
    pull: float = 1e-3,
    steps: int = 200,
    tolerance: float = 1e-4,
) -> DataFrame:
    """(p0, p1, ..., rate): a row for each distinct posterior of ``known``.

    ``weights`` are the shares of the domains in ``total`` tokens: by default as many as
    there are, or with ``whole`` as many as give that domain its present tokens. Rates
    stay in 0 .. ``most``."""
    n = len(weights)
    ps = [f"p{k}" for k in range(n)]
    cells = known.groupBy(*ps).agg(F.sum(F.col("n_tokens") * F.col("n_copies")).alias("n"))
    cells = checkpointed(cells.withColumn("rate", F.lit(1.0)))
    sums = [F.sum(F.col("n") * F.col("rate") * F.col(p)) for p in ps]
    present = np.array([x or 0.0 for x in cells.agg(*sums).first()], float)
    every = max(present.sum(), 1.0)
    share = np.array(weights, float) / sum(weights)
    if total is None:
        total = every if whole is None else present[whole] / share[whole]
    goal, scale = share * total, np.maximum(present, 1e-9 * every)
    # The step that suits the largest curvature of the weighted squares.
    curves = cells.agg(*[F.sum(F.col("n") * F.col(a) * F.col(b)) for a in ps for b in ps]).first()
    curve = np.array([x or 0.0 for x in curves], float).reshape(n, n) / np.sqrt(np.outer(scale, scale))
    step = 1 / (max(np.linalg.eigvalsh(curve).max(), 1e-9) + pull)
    # Accelerated: each step starts from a point beyond the last rate, by the momentum.
    rated, last, momentum = cells.withColumn("point", F.col("rate")), None, 1.0
    sums = [F.sum(F.col("n") * F.col("point") * F.col(p)) for p in ps]
    for turn in range(steps):
        totals = np.array([x or 0.0 for x in rated.agg(*sums).first()], float)
        if last is not None and np.abs(totals - last).max() <= tolerance * every:
            break
        last, error = totals, (totals - goal) / scale
        slope = F.lit(0.0)
        for p, e in zip(ps, error, strict=True):
            slope = slope + F.col(p) * float(e)
        rate = F.col("point") * (1 - step * pull) + step * pull - step * slope
        rate = F.greatest(rate, F.lit(0.0))
        rate = rate if most is None else F.least(rate, F.lit(float(most)))
        after = (1 + (1 + 4 * momentum**2) ** 0.5) / 2
        beyond = F.col("new") + (momentum - 1) / after * (F.col("new") - F.col("rate"))
        rated = rated.withColumn("new", rate).withColumn("point", beyond)
        rated = rated.select(*ps, "n", F.col("new").alias("rate"), "point")
        momentum = after
        if turn % 3 == 2:  # cut the chain of expressions
            rated = checkpointed(rated)
    return rated.select(*ps, "rate")


def document_rates(
    docs: DataFrame, model: DomainModel, weights: dict[str, float], id_column: str = "doc_id",
    text_column: str = "text", **options,
) -> DataFrame:
    """(key, row1, row2, n_copies, n_tokens, posteriors by domain name, rate, copies):
    ``copies`` is the rate rounded up or down by a hash of the document, with the rate as
    its mean. ``options`` go to ``fit_rates``."""
    known = checkpointed(posteriors(docs, model, id_column, text_column))
    ps = [f"p{k}" for k in range(len(model.domains))]
    if model.informed:
        rates = fit_rates(known, [weights.get(d, 0.0) for d in model.domains], **options)
    else:
        rates = known.select(*ps, F.lit(1.0).alias("rate")).distinct()
    rated = known.join(rates, ps)
    chance = F.pmod(F.xxhash64("row1", "row2", F.lit(11)), F.lit(1 << 30)) / float(1 << 30)
    copies = F.floor("rate") + F.when(chance < F.col("rate") - F.floor("rate"), 1).otherwise(0)
    return rated.select(
        "key", "row1", "row2", "n_copies", "n_tokens",
        *[F.col(p).alias(f"p_{d}") for p, d in zip(ps, model.domains, strict=True)],
        "rate", copies.cast("long").alias("copies"),
    )


def mixed(
    docs: DataFrame, model: DomainModel, weights: dict[str, float], id_column: str = "doc_id",
    text_column: str = "text", **options,
) -> DataFrame:
    """The rows of ``docs`` as often as their rates say."""
    rates = document_rates(docs, model, weights, id_column, text_column, **options)
    row1, row2, copies, copy = free_names(docs, "row1", "row2", "copies", "copy")
    some = rates.where("copies > 0").select(
        F.col("row1").alias(row1), F.col("row2").alias(row2), F.col("copies").alias(copies)
    )
    keys = [k.alias(c) for k, c in zip(row_key(docs, id_column, text_column), (row1, row2), strict=True)]
    found = docs.select(*[docs[c] for c in docs.columns], *keys).join(some, [row1, row2])
    found = found.withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies))))
    return found.drop(row1, row2, copies, copy)
