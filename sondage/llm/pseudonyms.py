"""Format-preserving pseudonyms for personal data: keyed Feistel networks permute each
validated value within its own format, so equal values stay equal in all documents and
nothing has to be looked up, joined or shuffled.

A value is split in two halves. In each of eight rounds one half is shifted by amounts
taken from the SHA-256 of key, format, round and the other half, modulo the size of what
is shifted; such a round can be undone, so the whole is a permutation of the format.
Texts (digits, letters) are shifted character by character within digits, small or
capital letters; dates and addresses, whose formats are no power of ten, as two numbers.

* email: the name before the @; the domain stays.
* ip: four numbers of 0 to 255, as 65,536 x 65,536.
* date: yyyy-mm-dd, yyyy/mm/dd or dd.mm.yyyy of the years 1900 to 2099 that exists in the
  calendar: 73,049 days as 319 x 229.
* ssn: ddd-dd-dddd with valid area, group and serial, as (898 x 99) x 9,999.
* phone: + and a country code (kept) with 7 to 14 digits, or ten digits written
  (ddd) ddd-dddd or ddd-ddd-dddd with one kind of separator.
* card: 13 to 19 digits, also grouped by spaces or hyphens, that pass the Luhn check; all
  but the last are permuted, the check digit is computed anew.

Everything is SQL functions: the values (``regexp_extract_all``) and what lies between
them (``split``) are put together again. Texts without a value are not rewritten.

Defined cases: null texts stay null; values that fail validation stay as they are;
repeated rows are worked on one by one; an empty table gives an empty table; other columns
pass through unchanged.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
BYTE = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
# In the order in which they are tried at one place. A repetition without a bound is
# possessive: Java repeats it in a loop, not by recursion, however long the text.
FORMATS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": rf"(?<![0-9.]){BYTE}(?:\.{BYTE}){{3}}(?![0-9])(?!\.[0-9])",
    "date": r"(?<![0-9A-Za-z])(?:(?:19|20)[0-9]{2}(?:-[0-9]{2}-|/[0-9]{2}/)[0-9]{2}"
    r"|[0-9]{2}\.[0-9]{2}\.(?:19|20)[0-9]{2})(?![0-9A-Za-z])",
    "ssn": r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])",
    "phone": r"(?<![0-9+])\+1[ .-]?\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])"
    r"|(?<![0-9+])\+[2-9][0-9]{0,2}(?:[ .-]?\(?[0-9]{2,4}\)?){2,4}(?![0-9])"
    r"|(?<![0-9])\([0-9]{3}\) ?[0-9]{3}[-. ][0-9]{4}(?![0-9])"
    r"|(?<![0-9-])[0-9]{3}([-. ])[0-9]{3}\1[0-9]{4}(?![0-9-])",
    "card": r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])",
}
PATTERN = "|".join(f"(?:{p})" for p in FORMATS.values())
# The least a text needs to hold a value, found faster than a value.
HINT = "@|[0-9]"


def _shift(key: str, tweak: Column, turn: Column, other: Column, at: Column) -> Column:
    """A number below 65,536 for place ``at`` from the other half."""
    digest = F.sha2(F.concat_ws("|", F.lit(key), tweak, turn, other), 256)
    place = (4 * (at % 16) + 1).cast("int")
    return F.conv(F.substr(digest, place, F.lit(4)), 16, 10).cast("int")


def _shifted(half: Column, key: str, tweak: Column, turn: Column, other: Column) -> Column:
    """Every digit and letter of ``half`` moved within its kind."""

    def move(c: Column, at: Column, short: Column) -> Column:
        by, code = _shift(key, tweak, turn, short, at), F.ascii(c)
        moved = [
            F.when(
                code.between(ord(first), ord(last)),
                F.char((code - ord(first) + by) % (ord(last) - ord(first) + 1) + ord(first)),
            )
            for first, last in ("09", "az", "AZ")
        ]
        return F.coalesce(*moved, c)

    # The other half is hashed once, as one element, not for every letter again. split of
    # an empty text gives one empty text, which stays.
    def moved(short: Column) -> Column:
        return F.array_join(F.transform(F.split(half, ""), lambda c, at: move(c, at, short)), "")

    return F.transform(F.array(F.sha2(other, 256)), moved)[0]


def permuted_text(value: Column, key: str, tweak: Column) -> Column:
    """``value`` with its ASCII digits and letters permuted, length and kinds kept."""
    middle = F.floor(F.char_length(value) / 2).cast("int")
    halves = F.struct(
        F.substr(value, F.lit(1), middle).alias("a"), F.substr(value, middle + 1).alias("b")
    )

    def turn(h: Column, i: Column) -> Column:
        even = i % 2 == 0
        return F.struct(
            F.when(even, _shifted(h["a"], key, tweak, i, h["b"])).otherwise(h["a"]).alias("a"),
            F.when(even, h["b"]).otherwise(_shifted(h["b"], key, tweak, i, h["a"])).alias("b"),
        )

    done = F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), halves, turn)
    return F.concat(done["a"], done["b"])


def permuted_number(value: Column, p: int, q: int, key: str, tweak: Column) -> Column:
    """A permutation of 0 .. p * q - 1."""
    value = value.cast("long")
    halves = F.struct(F.floor(value / q).cast("long").alias("a"), (value % q).alias("b"))

    def by(turn: Column, other: Column) -> Column:
        digest = F.sha2(F.concat_ws("|", F.lit(key), tweak, turn, other), 256)
        return F.conv(F.substr(digest, F.lit(1), F.lit(12)), 16, 10).cast("long")

    def turn(h: Column, i: Column) -> Column:
        even = i % 2 == 0
        return F.struct(
            F.when(even, (h["a"] + by(i, h["b"])) % p).otherwise(h["a"]).alias("a"),
            F.when(even, h["b"]).otherwise((h["b"] + by(i, h["a"])) % q).alias("b"),
        )

    done = F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), halves, turn)
    return done["a"] * q + done["b"]


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _filled(value: Column, digits: Column) -> Column:
    """``value`` with its digits replaced by ``digits``, separators kept."""

    def place(c: Column, at: Column) -> Column:
        nth = F.char_length(digits_of(F.substr(value, F.lit(1), (at + 1).cast("int"))))
        return F.when(c.between("0", "9"), F.substr(digits, nth, F.lit(1))).otherwise(c)

    return F.array_join(F.transform(F.split(value, ""), place), "")


def _luhn(digits: Column, doubled: int) -> Column:
    """Luhn sum, where places counted from the right with ``doubled`` as remainder count
    twice."""
    values = F.transform(
        F.split(F.reverse(digits), ""),
        lambda c, i: F.when(i % 2 == doubled, c.cast("int") * 2 - F.when(c >= "5", 9).otherwise(0)).otherwise(
            c.cast("int")
        ),
    )
    return F.aggregate(values, F.lit(0), lambda a, x: a + x)


def _email(value: Column, key: str) -> Column:
    name = F.regexp_extract(value, "^[^@]*", 0)
    domain = F.regexp_extract(value, "@.*$", 0)
    return F.concat(permuted_text(name, key, F.lit("email")), domain)


def _ip(value: Column, key: str) -> Column:
    parts = F.transform(F.split(value, "\\."), lambda x: x.cast("long"))
    number = F.aggregate(parts, F.lit(0).cast("long"), lambda a, x: a * 256 + x)
    moved = permuted_number(number, 1 << 16, 1 << 16, key, F.lit("ip"))
    # One number at a time, so that it is computed once.
    return F.element_at(
        F.transform(F.array(moved), lambda n: F.concat_ws(".", *[F.shiftright(n, s) % 256 for s in (24, 16, 8, 0)])), 1
    )


def _date(value: Column, key: str) -> Column:
    layouts = {"-": "yyyy-MM-dd", "/": "yyyy/MM/dd", ".": "dd.MM.yyyy"}
    out = value
    first = F.lit("1900-01-01").cast("date")
    for mark, layout in layouts.items():
        day = F.try_to_date(value, layout)
        number = permuted_number(F.datediff(day, first), 319, 229, key, F.lit("date"))
        moved = F.date_format(F.date_add(first, number.cast("int")), layout)
        out = F.when(F.contains(value, F.lit(mark)), F.coalesce(moved, value)).otherwise(out)
    return out


def _ssn(value: Column, key: str) -> Column:
    d = digits_of(value)
    area, group, serial = (F.substr(d, F.lit(s), F.lit(n)).cast("long") for s, n in ((1, 3), (4, 2), (6, 4)))
    area = area - F.when(area > 666, 2).otherwise(1)
    number = (area * 99 + group - 1) * 9999 + serial - 1
    moved = permuted_number(number, 898 * 99, 9999, key, F.lit("ssn"))

    def write(n: Column) -> Column:
        area = F.floor(n / (99 * 9999)) + 1
        area = area + F.when(area >= 666, 1).otherwise(0)
        return F.format_string("%03d-%02d-%04d", area, F.floor(n / 9999) % 99 + 1, n % 9999 + 1)

    return F.element_at(F.transform(F.array(moved), write), 1)


def _phone(value: Column, key: str) -> Column:
    # The country code ends at a separator; else its first digit is taken for it.
    code = F.regexp_extract(value, r"^\+([0-9]{1,3})(?=[ .(-])|^\+([0-9])", 0)
    kept = digits_of(code)
    rest = F.substr(digits_of(value), F.char_length(kept) + 1)
    moved = _filled(value, F.concat(kept, permuted_text(rest, key, F.lit("phone"))))
    return F.when(F.char_length(rest).between(7, 14), moved).otherwise(value)


def _card(value: Column, key: str) -> Column:
    digits = digits_of(value)
    body = permuted_text(F.substr(digits, F.lit(1), F.char_length(digits) - 1), key, F.lit("card"))

    def checked(b: Column) -> Column:
        return F.concat(b, ((10 - _luhn(b, 0) % 10) % 10).cast("string"))

    whole = F.element_at(F.transform(F.array(body), checked), 1)
    return F.when(_luhn(digits, 1) % 10 == 0, _filled(value, whole)).otherwise(value)


PERMUTE = {"email": _email, "ip": _ip, "date": _date, "ssn": _ssn, "phone": _phone, "card": _card}


def pseudonym(value: Column, key: str) -> Column:
    """The pseudonym of one value found by PATTERN."""
    out = value
    for kind, pattern in reversed(FORMATS.items()):
        whole = "^(?:" + pattern + ")$"
        out = F.when(F.rlike(value, F.lit(whole)), PERMUTE[kind](value, key)).otherwise(out)
    return out


def pseudonymised(text: Column, key: str) -> Column:
    """``text`` with every validated value replaced."""
    values = F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))
    named = F.transform(values, lambda v: pseudonym(v, key))
    gaps = F.split(text, PATTERN, -1)
    whole = F.zip_with(gaps, named, lambda gap, name: F.concat(gap, F.coalesce(name, F.lit(""))))
    found = F.rlike(text, F.lit(HINT)) & F.rlike(text, F.lit(PATTERN))
    return F.when(found, F.array_join(whole, "")).otherwise(text)


def pseudonymise(docs: DataFrame, key: str, text_column: str = "text") -> DataFrame:
    """``docs`` with the values in ``text_column`` replaced by their pseudonyms under
    ``key``; all other columns as they were."""
    return docs.withColumn(text_column, pseudonymised(docs[text_column], key))
