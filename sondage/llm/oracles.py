"""SQL for the queries of this subpackage that SQL can express.

Without SQL: op1 (sampling), op2 (a tokenizer's ids), op3 and op5 (XXH64, which the SQL
engine lacks), op6 and op8 (fitted models), op10 (Feistel networks), op12 (a tokenizer's ids) and the
pipeline; they are tested against brute-force versions in tests/llm.
"""

from sondage.llm.secrets import BASE_KINDS, RULES

SPACE = r"[\x20\x09-\x0D]"


def repetition() -> str:
    widths = range(5, 11)

    def gram(n: int) -> str:
        words = " || ' ' || ".join(f"lead(word, {k}) OVER by_place" for k in range(n))
        return f"{words} AS g{n}"

    def covered(flag: str, n: int) -> str:
        return f"max({flag}) OVER (PARTITION BY doc_id ORDER BY place ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"

    again = ", ".join(
        f"(g{n} IS NOT NULL AND row_number() OVER (PARTITION BY doc_id, g{n} ORDER BY place) > 1)::INT AS again{n}"
        for n in widths
    )
    shares = ", ".join(f"sum(size * {f'in{n}'})::BIGINT AS dup_chars_{n}" for n in widths)
    inside = ", ".join(f"{covered(f'again{n}', n)} AS in{n}" for n in widths)
    empty = ", ".join(f"coalesce(dup_chars_{n}, 0) AS dup_chars_{n}" for n in widths)
    over = " OR ".join(f"coalesce(dup_chars_{n}, 0) > 0.20::DOUBLE * coalesce(word_chars, 0)" for n in widths)
    return f"""
    WITH texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
    split AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '{SPACE}+'), lambda x: x <> '') AS words FROM texts),
    words AS (SELECT doc_id, unnest(words) AS word, unnest(range(len(words))) AS place FROM split),
    grams AS (SELECT doc_id, place, length(word) AS size, {gram(3)}, {', '.join(map(gram, widths))}
        FROM words WINDOW by_place AS (PARTITION BY doc_id ORDER BY place)),
    marked AS (SELECT doc_id, place, size,
        (g3 IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, g3) > 1)::INT AS many3, {again} FROM grams),
    spread AS (SELECT doc_id, size, {covered('many3', 3)} AS in3, {inside} FROM marked),
    counts AS (SELECT doc_id, count(*) AS n_words, sum(size)::BIGINT AS word_chars,
        sum(in3)::BIGINT AS n_repeat_words, {shares} FROM spread GROUP BY doc_id),
    lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
        unnest(range(len(string_split(text, chr(10))))) AS place FROM texts),
    seen AS (SELECT doc_id, length(line) AS size,
        row_number() OVER (PARTITION BY doc_id, line ORDER BY place) > 1 AS again
        FROM lines WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
    per_line AS (SELECT doc_id, count(*) AS n_lines, sum(size)::BIGINT AS line_chars,
        count(*) FILTER (again) AS n_dup_lines,
        coalesce(sum(size) FILTER (again), 0)::BIGINT AS dup_line_chars FROM seen GROUP BY doc_id),
    found AS (SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars,
        (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
        coalesce(n_lines, 0) AS n_lines, coalesce(line_chars, 0) AS line_chars,
        coalesce(dup_line_chars, 0) AS dup_line_chars, {empty},
        coalesce(n_words, 0) < 50 OR 100 * coalesce(n_repeat_words, 0) > 50 * coalesce(n_words, 0) AS base_failed,
        coalesce(dup_line_chars, 0) > 0.20::DOUBLE * coalesce(line_chars, 0) OR {over} AS over
        FROM texts LEFT JOIN counts USING (doc_id) LEFT JOIN per_line USING (doc_id))
    SELECT * EXCLUDE (over), NOT base_failed AND NOT over AS kept FROM found"""


ASSIGN = (
    "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|"
    "[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    "[\"'']?\\x20*[:=]\\x20*[\"'']?([A-Za-z0-9+/_.=-]+)"
)
# The plain form: the rule reads every run once, by means that DuckDB lacks.
JWT = "eyJ[A-Za-z0-9_-]+\\.eyJ[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]+"
EXPRESSIONS = {"assign": ASSIGN, "access": "AKIA[A-Z0-9]+", "hex": "[0-9a-f]+", "jwt": JWT}


def secrets() -> str:
    def spans(order: int, rule) -> str:
        rx = EXPRESSIONS.get(rule.kind) or rule.expression().replace("'", "''")
        return f"""SELECT doc_id, {order} AS kind_order, '{rule.kind}' AS kind, place AS start, place + length(m) AS stop, length(g) AS size
            FROM (SELECT doc_id, unnest(found) AS m, unnest(judged) AS g, unnest(list_transform(range(len(found)), lambda i:
                list_sum(list_transform(gaps[1:i + 1], lambda x: length(x)))
                + coalesce(list_sum(list_transform(found[1:i], lambda x: length(x))), 0)))::BIGINT AS place
            FROM (SELECT doc_id, regexp_extract_all(text, '{rx}') AS found,
                regexp_extract_all(text, '{rx}', {0 if rule.tail else rule.group}) AS judged,
                string_split_regex(text, '{rx}') AS gaps FROM texts)) WHERE length(g) >= {rule.least}"""

    every = " UNION ALL ".join(spans(i, r) for i, r in enumerate(RULES))
    text = "coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, kind_order){}, '')"
    base = f"kind_order < {len(BASE_KINDS)}"
    counts = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in BASE_KINDS)
    return f"""
    WITH texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), spans AS ({every})
    SELECT doc_id, {counts}, sha256({text.format(f" FILTER ({base})")}) AS base_sha256, {text.format("")} AS spans
    FROM texts LEFT JOIN spans USING (doc_id) GROUP BY doc_id"""


def archive() -> str:
    def digits(part: int) -> str:
        number = " + ".join(
            f"((strpos('0123456789abcdef', substr(sha1(data), {10 * part + k + 1}, 1)) - 1)::BIGINT << {36 - 4 * k})"
            for k in range(10)
        )
        return " || ".join(
            f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((n{part} >> {35 - 5 * j}) & 31)::INT + 1, 1)" for j in range(8)
        ), f"{number} AS n{part}"

    letters = " || ".join(digits(p)[0] for p in range(4))
    numbers = ", ".join(digits(p)[1] for p in range(4))
    return f"""
    WITH rows AS (SELECT page_id, coalesce(html, '') AS data FROM pages),
    numbered AS (SELECT page_id, strlen(data) AS payload_bytes, max(page_id) OVER (PARTITION BY data) AS keeper, {numbers}
        FROM rows)
    SELECT page_id, payload_bytes, {letters} AS payload_digest,
        CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
        CASE WHEN page_id <> keeper THEN keeper END AS refers_to
    FROM numbered"""


def repair() -> str:
    crc = (
        "xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(place) + 1), "
        "lambda k: ascii(substr(place, k, 1))::BIGINT)), lambda c, b: xor(crcs[(xor(c, b) & 255) + 1], c >> 8)), 4294967295)"
    )
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return f"""
    WITH RECURSIVE bytes AS MATERIALIZED (SELECT list(crc ORDER BY i) AS crcs FROM (SELECT i, list_reduce(
        list_prepend(i, range(8)), lambda c, x: xor(c >> 1, (c & 1) * 3988292384)) AS crc FROM range(256) AS b(i))),
    turns AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS place FROM conversations),
    drawn AS (SELECT turns.*, {crc} % 20 AS kind FROM turns, bytes),
    damaged AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN ''
        WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
        unnest(CASE kind WHEN 3 THEN [1, 2] ELSE [1] END) AS copy FROM drawn WHERE kind <> 0),
    placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id
        ORDER BY turn NULLS FIRST, sha256(length(role) || ':' || role || text)) AS i FROM damaged),
    seen AS (SELECT *, NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') AS blank,
        row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
        NOT regexp_matches(text, '[.!?]{SPACE}*\\z') AS open, substr(role, 1, 1) AS initial,
        lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS earlier FROM placed),
    faults AS (SELECT *, blank OR again AS gone, NOT blank AND NOT again AND open AS truncated FROM seen),
    inserts(state, n, between, added) AS (VALUES (0, 0, 0, []::VARCHAR[]), (0, 1, 2, ['user:']),
        (0, 2, 3, ['user:', 'assistant:']), (1, 0, 1, []), (1, 1, 2, ['user:']), (1, 2, 3, ['user:', 'assistant:']),
        (2, 0, 2, []), (2, 1, 3, ['assistant:']), (2, 2, 2, ['assistant:', 'user:']),
        (3, 0, 3, []), (3, 1, 2, ['user:']), (3, 2, 3, ['user:', 'assistant:'])),
    edits(between, letter, initial, after, price, given) AS (VALUES (0, 'D', NULL, 0, 2, NULL), (1, 'D', NULL, 1, 2, NULL),
        (2, 'D', NULL, 2, 2, NULL), (3, 'D', NULL, 3, 2, NULL), (0, 'K', 's', 1, 0, NULL), (0, 'K', 'u', 2, 0, NULL),
        (1, 'K', 'u', 2, 0, NULL), (2, 'K', 'a', 3, 0, NULL), (3, 'K', 'u', 2, 0, NULL), (0, 'R', NULL, 2, 1, 'user'),
        (1, 'R', NULL, 2, 1, 'user'), (2, 'R', NULL, 3, 1, 'assistant'), (3, 'R', NULL, 2, 1, 'user')),
    moves AS (SELECT * FROM inserts JOIN edits USING (between)),
    paths AS (
        SELECT conv_id, 0::BIGINT AS i, 0 AS state, 0 AS cost, '' AS audit, []::VARCHAR[] AS turns FROM faults GROUP BY conv_id
        UNION ALL
        SELECT conv_id, i, state, cost, audit, turns FROM (
            SELECT *, row_number() OVER (PARTITION BY conv_id, state ORDER BY cost, audit) AS place FROM (
                SELECT p.conv_id, r.i, m.after AS state,
                    p.cost + 5 * m.n + m.price + CASE WHEN r.truncated AND m.letter <> 'D' THEN 5 ELSE 0 END AS cost,
                    p.audit || repeat('I', m.n) || m.letter AS audit, list_concat(list_concat(p.turns, m.added),
                        CASE m.letter WHEN 'D' THEN []::VARCHAR[] ELSE [coalesce(m.given, r.role) || ':' || r.text] END) AS turns
                FROM paths p JOIN faults r ON r.conv_id IS NOT DISTINCT FROM p.conv_id AND r.i = p.i + 1
                JOIN moves m ON m.state = p.state AND (m.initial IS NULL OR m.initial = r.initial)
                WHERE m.letter = 'D' OR NOT r.gone)) WHERE place = 1),
    counted AS (SELECT conv_id, count(*) AS rows, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
        count(*) FILTER (blank) AS blank, count(*) FILTER (again AND NOT blank) AS duplicate,
        count(*) FILTER (truncated) AS truncated,
        count(*) FILTER (i > 1 AND earlier || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM faults GROUP BY conv_id),
    ends AS (SELECT p.conv_id, p.cost + 5 * e.n AS cost, p.audit || repeat('I', e.n) AS audit, list_concat(turns, added) AS turns
        FROM paths p JOIN counted c ON c.conv_id IS NOT DISTINCT FROM p.conv_id AND c.rows = p.i
        JOIN inserts e ON e.state = p.state AND e.between IN (0, 3)),
    chosen AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY cost, audit) AS place FROM ends)
    SELECT every.conv_id, {', '.join(f'coalesce({c}, 0)::BIGINT AS {c}' for c in counts)}, coalesce(audit, '') AS audit,
        sha256(coalesce(array_to_string(turns, chr(10)), '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) every
    LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM every.conv_id
    LEFT JOIN chosen b ON b.conv_id IS NOT DISTINCT FROM every.conv_id AND b.place = 1"""


def infilling() -> str:
    def number(group: int) -> str:
        return f"('0x' || substr(digest, {8 * group + 1}, 8))::BIGINT"

    def joined(part: str) -> str:
        return f"array_to_string({part}, '')"

    return f"""
    WITH texts AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || doc_id) AS digest FROM documents),
    split AS (SELECT *, regexp_extract_all(text, '{SPACE}*[^\\x20\\x09-\\x0D]+|{SPACE}+') AS tokens FROM texts),
    drawn AS (SELECT *, len(tokens) AS n, {number(0)} % (len(tokens) + 1) AS one, {number(1)} % (len(tokens) + 1) AS two,
        CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
            OR {number(2)} % 100 >= 50 THEN 'plain' WHEN {number(3)} % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM split),
    cut AS (SELECT doc_id, n, form, text, {joined('tokens[1:least(one, two)]')} AS prefix,
        {joined('tokens[least(one, two) + 1:greatest(one, two)]')} AS middle,
        {joined('tokens[greatest(one, two) + 1:]')} AS suffix FROM drawn)
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
        CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
        sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
            ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
        sha256(text) AS restored_sha256
    FROM cut"""


ORACLES: dict[str, str] = {
    "op4_trigram_secrets": secrets(),
    "op7_warc_archive": archive(),
    "op9_repetition_quality": repetition(),
    "op11_hirschberg_repair": repair(),
    "op13_rank_index_infilling": infilling(),
}
