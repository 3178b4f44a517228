"""Secret scans with a trigram index.

A rule is a regular expression, written as a sequence of literals, alternatives of literals
and patterns. From its parse tree a Boolean trigram query is derived (``trigrams``): an OR
of alternatives, each the AND of its trigrams. The inverted index holds a posting
(trigram, row) for every trigram that some query names, so its size follows the rules, not
the alphabet. Postings of a rule's alternative are intersected by counting them per row,
never by trigram, so a trigram that a third of all texts hold makes no large group; rows
with all trigrams of an alternative are candidates, and only these are searched with the
expression. A rule without a mandatory trigram searches all rows. Trigrams are taken from
lower-case text, which can only add candidates.

Everything is DataFrame functions. Positions count code points, end exclusive: matches
(``regexp_extract_all``) and what lies between them (``split``) alternate, so starts are
sums of lengths.

Defined cases: a null or empty text has no spans; repeated rows are scanned one by one; an
empty table gives an empty table; only the named columns are read.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sondage.llm.trigrams import trigram_query


@dataclass(frozen=True)
class Rule:
    """``parts``: each a tuple of literal alternatives, or a string with an expression.
    ``tail``: the group ends the match and is the span; what is before it only leads there.
    ``any_case``: the literals match in either case. ``least``: what a match needs to
    count, at least so many characters of ``group`` (0: the whole match). ``hint``: an
    expression that every text with a counting match matches, where that is quicker."""

    kind: str
    parts: tuple
    least: int = 1
    group: int = 0
    any_case: bool = False
    hint: str | None = None
    tail: bool = False

    def expression(self) -> str:
        out = ""
        for part in self.parts:
            if isinstance(part, str):
                out += part
            else:
                found = "|".join("".join(_escaped(c, self.any_case) for c in x) for x in part)
                out += f"({found})" if len(part) > 1 else found
        return out

    def query(self) -> list[list[str]]:
        """The alternatives of the trigram query: one holds if all its trigrams occur."""
        return trigram_query(self.expression())


def _escaped(c: str, any_case: bool) -> str:
    if any_case and c.isalpha():
        return f"[{c.lower()}{c.upper()}]"
    return c if c.isalnum() else f"\\x{ord(c):02x}"


# The three base kinds, then formats that issuers of keys have published.
RULES = (
    Rule(
        "assign",
        (("password", "passwd", "secret", "token", "apikey", "api_key"),
         "[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"),
        12, 2, True,
    ),
    Rule("access", (("AKIA",), "[A-Z0-9]+"), 18),
    Rule("hex", ("[0-9a-f]+",), 16, hint="[0-9a-f]{16}"),
    Rule("github", (("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), "[A-Za-z0-9]+"), 40),
    Rule("slack", (("xoxa-", "xoxb-", "xoxp-", "xoxr-", "xoxs-"), "[A-Za-z0-9-]+"), 20),
    Rule("google", (("AIza",), "[A-Za-z0-9_-]+"), 39),
    # From the first eyJ of a run of such characters: where that leads to no match, no
    # later one of the run does, and each run is read once.
    Rule(
        "jwt",
        ("(?<![A-Za-z0-9_-])(?>[A-Za-z0-9_-]*?(?=eyJ))(", ("eyJ",), "[A-Za-z0-9_-]++\\.", ("eyJ",),
         "[A-Za-z0-9_-]++\\.[A-Za-z0-9_-]++)"),
        30, 1, tail=True,
    ),
    Rule(
        "private_key",
        (("-----BEGIN ",), "[A-Z ]*", ("PRIVATE KEY-----",)),
    ),
)
BASE_KINDS = ("assign", "access", "hex")


def trigram_postings(texts: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(trigram, row): which rows hold which trigrams of the rules' queries."""
    wanted = sorted({t for r in rules for clause in r.query() for t in clause})

    def held(low: Column) -> Column:
        found = F.array(*[F.when(F.contains(low, F.lit(t)), F.lit(t)) for t in wanted])
        return F.filter(found, lambda t: t.isNotNull())

    # The text is lowered once, not for every trigram.
    once = F.transform(F.array(F.lower("text")), held)
    return texts.select("row", F.explode(F.element_at(once, 1)).alias("trigram"))


def candidates(postings: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(row, kinds): the rules whose trigram query each row satisfies. Rows that satisfy
    none are absent."""
    held = postings.groupBy("row").agg(F.collect_set("trigram").alias("held"))
    kinds = F.filter(
        F.array(*[F.when(_holds(r.query()), F.lit(r.kind)) for r in rules if r.query()]),
        lambda k: k.isNotNull(),
    )
    return held.select("row", kinds.alias("kinds")).where(F.size("kinds") > 0)


def _holds(query: list[list[str]]) -> Column:
    """Whether all trigrams of some alternative are in ``held``."""
    out = F.lit(False)
    for clause in query:
        wanted = F.array(*map(F.lit, clause))
        out |= F.size(F.array_intersect("held", wanted)) == len(clause)
    return out


SPANS = "array<struct<start:int,order:int,end:int,kind:string>>"


def matches(text: Column, rule: Rule, order: int) -> Column:
    """The spans of a rule, leftmost and non-overlapping, failing matches dropped."""
    expression = rule.expression()
    found = F.regexp_extract_all(text, F.lit(expression), F.lit(0))
    judged = F.regexp_extract_all(text, F.lit(expression), F.lit(rule.group))
    before = F.slice(F.split(text, expression, -1), F.lit(1), F.size(found))
    parts = F.arrays_zip(before.alias("before"), found.alias("found"), judged.alias("judged"))
    none = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("spans"))

    def add(done: Column, part: Column) -> Column:
        start = done["at"] + F.char_length(part["before"])
        end = start + F.char_length(part["found"])
        if rule.tail:
            start = end - F.char_length(part["judged"])
        span = F.struct(
            start.alias("start"), F.lit(order).alias("order"), end.alias("end"),
            F.lit(rule.kind).alias("kind"),
        )
        long_enough = F.char_length(part["judged"]) >= rule.least
        spans = F.when(long_enough, F.concat(done["spans"], F.array(span))).otherwise(done["spans"])
        return F.struct(end.alias("at"), spans.alias("spans"))

    return F.aggregate(parts, none, add)["spans"]


def written(spans: Column) -> Column:
    """kind:start:end by start, then in the order of the rules, comma-joined."""
    one = F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))
    return F.array_join(one, ",")


def find_secrets(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    rules: tuple[Rule, ...] = RULES,
) -> DataFrame:
    """One row per row of ``docs``: its id and ``found``, a struct with the array of
    spans of each rule, by kind."""
    key, text = docs[id_column], F.coalesce(docs[text_column], F.lit(""))
    # A row goes by a hash of its id and text: what shares it has the same candidates or
    # a few too many, and each candidate is searched.
    texts = docs.select(key.alias("key"), text.alias("text"), F.xxhash64(key, text).alias("row"))
    named = candidates(trigram_postings(texts, rules), rules)
    both = texts.join(named, "row", "left")
    none = F.array().cast(SPANS)
    columns = []
    for order, rule in enumerate(rules):
        candidate = F.array_contains("kinds", rule.kind) if rule.query() else F.lit(True)
        candidate &= F.rlike("text", F.lit(rule.hint or rule.expression()))
        spans = F.when(candidate, matches(F.col("text"), rule, order)).otherwise(none)
        columns.append(spans.alias(rule.kind))
    return both.select(F.col("key").alias(id_column), F.struct(*columns).alias("found"))


def secret_report(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    rules: tuple[Rule, ...] = RULES,
) -> DataFrame:
    """One row per row of ``docs``: counts of the base kinds, a digest of their spans, and
    the spans of all rules in writing."""
    found = find_secrets(docs, id_column, text_column, rules)
    base = F.concat(*[F.col(f"found.{k}") for k in BASE_KINDS])
    every = F.concat(*[F.col(f"found.{r.kind}") for r in rules])
    return found.select(
        F.col(id_column),
        *[F.size(f"found.{k}").cast("long").alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(written(base), 256).alias("base_sha256"),
        written(every).alias("spans"),
    )
