"""Format-preserving pseudonyms for personal data: Feistel networks in DataFrame functions over each value's own format.

A value is permuted under a key within its format: 16 digits stay 16 digits (and keep
their check digit right or wrong, as it was), dates stay dates, addresses stay addresses. A permutation gives equal values equal
pseudonyms in every document and different values different ones.

Validated: numbers with a right Luhn digit are cards (others are numbers, a kind of their own), social-security numbers have an area, a group and
a serial that are given out, addresses have parts up to 255, and dates exist. A date with its year last is read day first if that is a date, else month first.

Not looked for, so left as they are: IBANs as such (a spaced one may lose some of its digits to another kind, the rest stays), digit
runs of under 12 without separators (national numbers of 9 to 11 digits) or of 20 and more, dates with the month's name, and IPv6 addresses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from replen.llm.line_rules import let

OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
YEAR = "(?:1[789]|20)[0-9]{2}"
#: Kinds in order of precedence, each with its pattern.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]{1,63}+(?:\.[A-Za-z0-9-]{1,63})++",
    "ip": rf"(?<![0-9.]){OCTET}(?:\.{OCTET}){{3}}(?![0-9]|\.[0-9])",
    "date": r"(?<![0-9])(?:"
    + "|".join(f"{YEAR}{s}[01]?[0-9]{s}[0-3]?[0-9]|[0-3]?[0-9]{s}[0-3]?[0-9]{s}{YEAR}" for s in ("-", "/", r"\."))
    + ")(?![0-9])",
    "phone": r"(?<![0-9A-Za-z])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-]?[0-9]{4}(?![0-9])|\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,5}(?![0-9])",
    "ssn": r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])",
    "number": r"(?<![0-9])[0-9](?:[ -]?[0-9]){11,18}(?![0-9])",
}
ANY = "|".join(PATTERNS.values())
KINDS = [*PATTERNS, "card"]
#: What every match has; texts without it pass by the patterns.
MAY_HAVE = "[0-9@]"
ROUNDS = 8
#: Days from 1700-01-01 to 2099-12-31, one Gregorian cycle: 189 * 773.
DAYS = (189, 773)
#: Steps after which a month-first date is taken as it is: 12 days of 30 are not such dates, so 1e-25 of walks are as long.
WALKS = 64
#: Areas and groups, and serials, of social-security numbers.
SSN = (898 * 99, 9999)


def _hash(key: str, tweak: str, r: Column, value: Column) -> Column:
    """The round function: SHA-256 in hex of the key, the format, the round and one half."""
    return F.sha2(F.concat_ws("\x1f", F.lit(key), F.lit(tweak), r.cast("string"), value.cast("string")), 256)


def _number(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("long")


def _rounds(left: Column, right: Column, step) -> Column:
    """Alternating rounds over (l, r); step gives a half's new value from the round, itself and the other half."""
    start = F.struct(left.alias("l"), right.alias("r"))
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(ROUNDS)),
        start,
        lambda a, i: F.when(i % 2 == 1, F.struct(step(i, a["l"], a["r"]).alias("l"), a["r"].alias("r"))).otherwise(
            F.struct(a["l"].alias("l"), step(i, a["r"], a["l"]).alias("r"))
        ),
    )


def _shift(text: Column, digest: Column) -> Column:
    """Move each digit or ASCII letter within its class by an amount from the digest; other characters stay."""

    def moved(c: Column, i: Column) -> Column:
        by = F.conv(F.substr(digest, F.pmod(i, F.lit(30)) * 2 + 1, F.lit(4)), 16, 10).cast("long")
        turn = lambda base, n: F.chr(F.lit(base) + F.pmod(F.ascii(c) - base + by, F.lit(n)))
        return (
            F.when(c.between("0", "9"), turn(48, 10)).when(c.between("a", "z"), turn(97, 26)).when(c.between("A", "Z"), turn(65, 26)).otherwise(c)
        )

    return F.when(text == "", text).otherwise(F.array_join(F.transform(F.split(text, ""), moved), ""))


def permute_text(value: Column, key: str, tweak: str) -> Column:
    """Permute a string within its own format of digits, lower-case and upper-case letters."""
    half = F.floor(F.length(value) / 2).cast("int")
    halves = _rounds(
        F.substr(value, F.lit(1), half), F.substr(value, half + 1), lambda i, mine, other: _shift(mine, _hash(key, tweak, i, other))
    )
    return let(halves, lambda h: F.concat(h["l"], h["r"]))


def permute_ip(value: Column, key: str) -> Column:
    """Permute a dotted address among all 2^32."""
    part = lambda i: F.split_part(value, F.lit("."), F.lit(i)).cast("long")
    halves = _rounds(
        part(1) * 256 + part(2), part(3) * 256 + part(4), lambda i, mine, other: F.pmod(mine + _number(_hash(key, "ip", i, other)), F.lit(65536))
    )
    low, high = (lambda x: F.pmod(x, F.lit(256))), (lambda x: F.floor(x / 256))
    return let(halves, lambda h: F.concat_ws(".", high(h["l"]), low(h["l"]), high(h["r"]), low(h["r"])))


def permute_date(value: Column, key: str) -> Column:
    """Permute a valid day of 1700 to 2099 among all of them, in its format; what is no valid date stays.

    A date that is read month first (its day is over 12) is permuted on until its pseudonym is such a date too.
    """
    parts = F.split(value, "[-/.]")
    between = F.regexp_extract(value, "[-/.]", 0)
    iso = F.length(parts[0]) == 4
    two = lambda c: F.lpad(c, 2, "0")
    of = lambda y, m, d: F.try_to_date(F.concat_ws("-", y, two(m), two(d)), "yyyy-MM-dd")
    day_first = F.when(~iso, of(parts[2], parts[1], parts[0]))
    day = F.when(iso, of(parts[0], parts[1], parts[2])).otherwise(F.coalesce(day_first, of(parts[2], parts[0], parts[1])))
    month_first = ~iso & day_first.isNull()
    padded = F.when(iso, F.length(value) == 10).otherwise((F.length(parts[0]) == 2) & (F.length(parts[1]) == 2))
    first, (a, b) = F.to_date(F.lit("1700-01-01")), DAYS

    def once(n: Column) -> Column:
        halves = _rounds(
            F.floor(n / b).cast("long"),
            F.pmod(n, F.lit(b)).cast("long"),
            lambda i, mine, other: F.pmod(mine + _number(_hash(key, "date", i, other)), F.when(i % 2 == 1, F.lit(a)).otherwise(F.lit(b))),
        )
        return let(halves, lambda h: h["l"] * b + h["r"])

    def new(day: Column) -> Column:
        start = once(F.datediff(day, first).cast("long"))
        open_ = lambda n: month_first & (F.dayofmonth(F.date_add(first, n.cast("int"))) <= 12)
        moved = F.aggregate(F.when(month_first, F.sequence(F.lit(1), F.lit(WALKS))).otherwise(F.array(F.lit(1))), start, lambda n, _: F.when(open_(n), once(n)).otherwise(n))

        def written(d: Column) -> Column:
            y, m, n = F.date_format(d, "yyyy"), F.month(d).cast("string"), F.dayofmonth(d).cast("string")
            m, n = (F.when(padded, two(x)).otherwise(x) for x in (m, n))
            return F.when(iso, F.concat(y, between, m, between, n)).when(month_first, F.concat(m, between, n, between, y)).otherwise(F.concat(n, between, m, between, y))

        return let(F.date_add(first, moved.cast("int")), written)

    return F.coalesce(let(day, lambda d: F.when(d.isNotNull(), new(d))), value)


def _digits_in(form: Column, digits: Column) -> Column:
    """form with its digits replaced by `digits` in order."""
    step = lambda a, c: F.when(
        c.between("0", "9"), F.struct((a["n"] + 1).alias("n"), F.concat(a["s"], F.substr(digits, a["n"] + 1, F.lit(1))).alias("s"))
    ).otherwise(F.struct(a["n"].alias("n"), F.concat(a["s"], c).alias("s")))
    return F.aggregate(F.split(form, ""), F.struct(F.lit(0).alias("n"), F.lit("").alias("s")), step)["s"]


def luhn_sum(digits: Column) -> Column:
    """The Luhn sum of digits that stand before a check digit."""

    def step(a: Column, c: Column) -> Column:
        d = c.cast("int") * F.when(a["twice"], 2).otherwise(1)
        return F.struct((a["n"] + F.when(d > 9, d - 9).otherwise(d)).alias("n"), (~a["twice"]).alias("twice"))

    return F.aggregate(F.split(F.reverse(digits), ""), F.struct(F.lit(0).alias("n"), F.lit(True).alias("twice")), step)["n"]


def permute_number(value: Column, key: str) -> Column:
    """Permute a long number; separators stay, and the Luhn sum with the check digit keeps its remainder, so valid cards stay valid."""

    def new(digits: Column) -> Column:
        body = F.substr(digits, F.lit(1), F.length(digits) - 1)
        last = F.substring(digits, -1, 1).cast("int")
        return let(
            permute_text(body, key, "number"),
            lambda b: F.concat(b, F.pmod(last + luhn_sum(body) - luhn_sum(b), F.lit(10)).cast("string")),
        )

    return let(F.regexp_replace(value, "[^0-9]", ""), lambda d: let(new(d), lambda n: _digits_in(value, n)))


def is_card(value: Column) -> Column:
    """Whether a long number's last digit is its Luhn digit."""

    def right(digits: Column) -> Column:
        return F.pmod(luhn_sum(F.substr(digits, F.lit(1), F.length(digits) - 1)) + F.substring(digits, -1, 1).cast("int"), F.lit(10)) == 0

    return let(F.regexp_replace(value, "[^0-9]", ""), right)


def permute_ssn(value: Column, key: str) -> Column:
    """Permute among the social-security numbers that may be given out: areas 001 to 899 without 666, groups from 01, serials from 0001."""
    area = F.substring(value, 1, 3).cast("long")
    left = (area - F.when(area > 666, 2).otherwise(1)) * 99 + F.substring(value, 5, 2).cast("long") - 1
    halves = _rounds(
        left,
        F.substring(value, 8, 4).cast("long") - 1,
        lambda i, mine, other: F.pmod(mine + _number(_hash(key, "ssn", i, other)), F.when(i % 2 == 1, F.lit(SSN[0])).otherwise(F.lit(SSN[1]))),
    )
    pad = lambda n, k: F.lpad(n.cast("string"), k, "0")

    def written(h: Column) -> Column:
        area = F.floor(h["l"] / 99) + 1
        return F.concat_ws("-", pad(area + F.when(area > 665, 1).otherwise(0), 3), pad(h["l"] % 99 + 1, 2), pad(h["r"] + 1, 4))

    return let(halves, written)


def permute_phone(value: Column, key: str) -> Column:
    """Permute the last ten digits (all but the first, if there are fewer than eleven); a country code before them stays."""

    def new(digits: Column) -> Column:
        kept = F.greatest(F.length(digits) - 10, F.when(value.startswith("+"), 1).otherwise(0))
        return F.concat(F.substr(digits, F.lit(1), kept), permute_text(F.substr(digits, kept + 1), key, "phone"))

    return let(F.regexp_replace(value, "[^0-9]", ""), lambda d: let(new(d), lambda n: _digits_in(value, n)))


def permute_email(value: Column, key: str) -> Column:
    """Permute the part before the @ (in lower case, so that spellings stay linked); the host stays."""
    name = F.lower(F.split_part(value, F.lit("@"), F.lit(1)))
    return F.concat(permute_text(name, key, "email"), F.lit("@"), F.split_part(value, F.lit("@"), F.lit(2)))


def kind_of(value: Column) -> Column:
    out = F.lit(None).cast("string")
    for kind, pattern in reversed(PATTERNS.items()):
        out = F.when(value.rlike(f"^(?:{pattern})$"), F.lit(kind)).otherwise(out)
    return F.when((out == "number") & is_card(value), "card").otherwise(out)


def pseudonym(kind: Column, value: Column, key: str) -> Column:
    return (
        F.when(kind == "email", permute_email(value, key))
        .when(kind == "ip", permute_ip(value, key))
        .when(kind == "date", permute_date(value, key))
        .when(kind == "phone", permute_phone(value, key))
        .when(kind == "ssn", permute_ssn(value, key))
        .when(kind.isin("number", "card"), permute_number(value, key))
        .otherwise(value)
    )


def pseudonymise(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Replace e-mail addresses, network addresses, dates, telephone and social-security numbers and long numbers in whole texts.

    Values are leftmost matches that do not overlap. Days outside 1700 to 2099 and impossible dates are no dates; addresses
    with a part over 255 are none. key keeps the pseudonyms secret and linked between runs.

    Returns one row per input row: doc_id, text (null stays null, an empty text empty), found (array<struct<kind, value>>
    with the pseudonyms in order). Repeated rows repeat; other columns are left out.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.withColumn("hits", F.when(F.col("text").rlike(MAY_HAVE), F.regexp_extract_all("text", F.lit(ANY), F.lit(0))))
    has = F.size(F.coalesce("hits", F.array().cast("array<string>"))) > 0
    one = lambda v: let(kind_of(v), lambda k: F.struct(k.alias("kind"), pseudonym(k, v, key).alias("value")))
    none = F.array().cast("array<struct<kind:string,value:string>>")
    rows = rows.select(
        "doc_id",
        "text",
        F.when(has, F.split("text", ANY, -1)).alias("around"),
        F.when(has, F.transform("hits", one)).otherwise(none).alias("found"),
    )
    woven = F.concat(
        F.array_join(F.zip_with(F.slice("around", 1, F.size("found")), "found", lambda a, f: F.concat(a, f["value"])), ""),
        F.element_at("around", -1),
    )
    return rows.select("doc_id", F.when(F.col("around").isNotNull(), woven).otherwise(F.col("text")).alias("text"), "found")
