"""PII: format-preserving Feistel pseudonyms, in DataFrame functions alone.

A value that is validated (Luhn for cards, mod 97 for IBANs, calendar for dates, octets for addresses) is turned into a
list of digits, each with its own radix, and permuted by a keyed, alternating Feistel network whose round function is
SHA-256 of key, kind, round, place and the other half.  The radices multiply to just the valid values of a format, so the
network is a bijection on them: equal values stay equal and different ones different in all documents; check digits are
computed anew, so that the pseudonym is as valid as the value.  With inverse=True the permutation is undone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, read_table

ROUNDS = 10
DEFAULT_KEY = "lamina-demo-key"
_DIGITS, _HEX = "0123456789", "0123456789abcdef"
_LOWER, _UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: Kind: pattern; tried in this order at each place of a text.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63})+",
    "key": r"(?<![A-Za-z0-9])AKIA[A-Z0-9]{16}(?![A-Za-z0-9])",
    "hex": r"(?<![A-Za-z0-9])[0-9a-f]{40}(?![A-Za-z0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])",
    "date": r"(?<![0-9A-Za-z/.-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![0-9A-Za-z]|[/-][0-9])",
    "ip": rf"(?<![0-9.])(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9]|\.[0-9])",
    "phone": r"(?<![0-9A-Za-z])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z])",
    "card": r"(?<![0-9A-Za-z])(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4})(?![0-9A-Za-z])",
    "ssn": r"(?<![0-9A-Za-z-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9A-Za-z-])",
}
#: The back reference in the card pattern counts groups of the whole pattern; no other pattern has one.
ANY = "|".join(PATTERNS.values())
#: A full Gregorian cycle from 1 January 1800: 146097 days = 189 * 773, so that two radices cover it exactly.
CYCLE_START, CYCLE_DAYS, DAY_RADICES = "1800-01-01", 146_097, (189, 773)
#: Of these, the days behind the twelfth of their month: 88497 = 9 * 9833.
LATE_DAYS, LATE_RADICES = 88_497, (9, 9833)
#: Years in whole blocks of 400 around 1800 that have four digits.
YEARS = (200, 9799)
SSN_RADICES = (898, 99, 9999)
#: A text without any of these holds no value of any kind.
HINT = "[0-9@]|AKIA|[a-f]{40}"


def _shift(cells: Column, other: Column, key: str, tag: Column, step: Column, sign: int) -> Column:
    """cells (v, r) with a keyed number added to each v modulo r, a function of the other half."""
    seen = F.array_join(F.transform(other, lambda x: x["v"].cast("string")), ",")

    def cell(x, j):
        text = F.concat_ws("|", F.lit(key), tag, step.cast("string"), j.cast("string"), seen)
        noise = F.conv(F.substring(F.sha2(text, 256), 1, 12), 16, 10).cast("long")
        return F.struct(F.pmod(x["v"] + noise * sign, x["r"]).alias("v"), x["r"].alias("r"))

    return F.transform(cells, cell)


def feistel(cells: Column, key: str, tag: Column, inverse: bool = False) -> Column:
    """Permute an array of struct(v long, r long), 0 <= v < r; a bijection on the arrays of equal radices."""
    half = F.floor(F.size(cells) / 2).cast("int")
    start = F.struct(F.slice(cells, 1, half).alias("a"), F.slice(cells, half + 1, F.size(cells) - half).alias("b"))
    steps = list(range(ROUNDS))
    sign = -1 if inverse else 1

    def turn(s, i):
        even = F.struct(_shift(s["a"], s["b"], key, tag, i, sign).alias("a"), s["b"].alias("b"))
        odd = F.struct(s["a"].alias("a"), _shift(s["b"], s["a"], key, tag, i, sign).alias("b"))
        return F.when(i % 2 == 0, even).otherwise(odd)

    return F.aggregate(F.array(*[F.lit(i) for i in (reversed(steps) if inverse else steps)]), start, turn, lambda s: F.concat(s["a"], s["b"]))


def _chars(text: Column) -> Column:
    return F.filter(F.split(text, "", -1), lambda c: c != "")


def _cell(v: Column, r: Column | int) -> Column:
    return F.struct(v.cast("long").alias("v"), (r if isinstance(r, Column) else F.lit(r)).cast("long").alias("r"))


def _characters(m: Column, movable, key: str, kind: str, inverse: bool, hexadecimal: bool = False) -> Column:
    """m with the characters at places j (from 1) where movable(c, j) permuted, each within its alphabet."""
    if hexadecimal:
        alphabet = lambda c: F.lit(_HEX)
    else:
        alphabet = lambda c: F.when(c.rlike("[0-9]"), F.lit(_DIGITS)).when(c.rlike("[a-z]"), F.lit(_LOWER)).when(c.rlike("[A-Z]"), F.lit(_UPPER))
    mark = lambda c, j: F.struct(c.alias("c"), F.when(movable(c, j + 1), alphabet(c)).alias("s"))
    chars = F.transform(_chars(m), mark)

    def change(x):
        cells = F.transform(F.filter(x, lambda y: y["s"].isNotNull()), lambda y: _cell(F.instr(y["s"], y["c"]) - 1, F.length(y["s"])))
        tag = F.concat(F.lit(kind), F.size(x).cast("string"))

        def render(new):
            step = lambda a, y: F.when(y["s"].isNull(), F.struct(F.concat(a["t"], y["c"]).alias("t"), a["k"].alias("k"))).otherwise(F.struct(F.concat(a["t"], y["s"].substr(F.get(new, a["k"])["v"].cast("int") + 1, F.lit(1))).alias("t"), (a["k"] + 1).alias("k")))
            return F.aggregate(x, F.struct(F.lit("").alias("t"), F.lit(0).alias("k")), step, lambda a: a["t"])

        return F.when(F.size(cells) > 0, let(feistel(cells, key, tag, inverse), render)).otherwise(m)

    return let(chars, change)


def _digits_after(m: Column, j: Column) -> Column:
    return F.length(F.regexp_replace(m.substr(j + 1, F.length(m)), "[^0-9]", ""))


def _card(m: Column, key: str, inverse: bool) -> Column:
    """First digit kept, last one computed anew by Luhn's rule; separators stay."""
    digits = F.regexp_replace(m, "[^0-9]", "")
    moved = _characters(m, lambda c, j: c.rlike("[0-9]") & (j > 1) & (_digits_after(m, j) > 0), key, "card", inverse)

    def checked(x):
        body = F.regexp_replace(x.substr(F.lit(1), F.length(x) - 1), "[^0-9]", "")
        worth = F.transform(F.reverse(_chars(body)), lambda d, j: F.when(j % 2 == 0, d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)).otherwise(d.cast("int")))
        return F.concat(x.substr(F.lit(1), F.length(x) - 1), F.pmod(-F.aggregate(worth, F.lit(0), lambda a, d: a + d), F.lit(10)).cast("string"))

    return F.when(F.call_function("luhn_check", digits), let(moved, checked)).otherwise(m)


def _mod97(text: Column) -> Column:
    value = lambda c: F.when(c.rlike("[0-9]"), F.instr(F.lit(_DIGITS), c) - 1).otherwise(F.instr(F.lit(_UPPER), c) + 9)
    return F.aggregate(F.transform(_chars(text), value), F.lit(0), lambda a, v: F.pmod(a * F.when(v > 9, 100).otherwise(10) + v, F.lit(97)))


def _iban(m: Column, key: str, inverse: bool) -> Column:
    """Country kept, account permuted, check digits computed anew."""
    moved = _characters(m, lambda c, j: j > 4, key, "iban", inverse)
    rest = lambda x: x.substr(F.lit(5), F.length(x))
    checked = lambda x: F.concat(x.substr(1, 2), F.lpad((98 - _mod97(F.concat(rest(x), x.substr(1, 2), F.lit("00")))).cast("string"), 2, "0"), rest(x))
    return F.when(checked(m) == m, let(moved, checked)).otherwise(m)


def _ip(m: Column, key: str, inverse: bool) -> Column:
    cells = F.transform(F.split(m, r"\.", -1), lambda x: _cell(x.cast("int"), 256))
    return F.array_join(F.transform(feistel(cells, key, F.lit("ip"), inverse), lambda x: x["v"].cast("string")), ".")


def _permuted(number: Column, radices: tuple[int, ...], key: str, tag: str, inverse: bool) -> Column:
    """number, 0 <= number < the product of the radices, permuted; the first radix is the highest place."""
    cells, worth = [], 1
    for r in reversed(radices):
        cells.insert(0, _cell(F.pmod(F.floor(number / worth), F.lit(r)), r))
        worth *= r
    total = lambda y: F.aggregate(y, F.lit(0).cast("long"), lambda a, x: a * x["r"] + x["v"])
    return let(feistel(F.array(*cells), key, F.lit(tag), inverse), total)


def _ssn(m: Column, key: str, inverse: bool) -> Column:
    """Area (001 to 899 but 666), group (01 to 99) and serial (0001 to 9999) permuted among the valid ones."""
    part = lambda i, n: m.substr(i, n).cast("long")
    number = (((part(1, 3) - 1 - (part(1, 3) > 666).cast("long")) * 99) + part(5, 2) - 1) * 9999 + part(8, 4) - 1

    def render(x):
        area = F.floor(x / (99 * 9999)) + 1
        padded = lambda v, n: F.lpad(v.cast("string"), n, "0")
        return F.concat_ws("-", padded(area + (area > 665).cast("long"), 3), padded(F.pmod(F.floor(x / 9999), F.lit(99)) + 1, 2), padded(F.pmod(x, F.lit(9999)) + 1, 4))

    return let(_permuted(number, SSN_RADICES, key, "ssn", inverse), render)


def _date(m: Column, key: str, inverse: bool) -> Column:
    """Days permuted within their block of 400 years; month/day/year, or day/month/year where only that is a date."""
    start = F.lit(CYCLE_START).cast("date")

    def parsed(form: str) -> Column:
        return F.try_to_timestamp(m, F.lit(form)).cast("date")

    def moved(day: Column, form: str, number, radices: tuple[int, ...], back) -> Column:
        """number(day of the block, date) is permuted, back() makes a day of the block of it."""
        def change(d):
            days = F.datediff(d, start)
            block = F.floor(days / CYCLE_DAYS)
            new = let(_permuted(number(F.pmod(days, F.lit(CYCLE_DAYS)), d), radices, key, "date", inverse), back)
            return F.when(F.year(d).between(*YEARS), F.date_format(F.date_add(start, (new + block * CYCLE_DAYS).cast("int")), form))

        return let(day, change)

    def any_day(form: str) -> Column:
        return moved(parsed(form), form, lambda n, d: n, DAY_RADICES, lambda x: x)

    def late_day(form: str) -> Column:
        """Days behind the twelfth, so that the pseudonym too is no month/day/year."""
        month = lambda d: F.pmod((F.year(d) - 1800) * 12 + F.month(d) - 1, F.lit(4800))
        first = lambda k: F.datediff(F.add_months(start, k), start)

        def back(x):
            near = F.floor(x * 4800 / LATE_DAYS).cast("int")
            months = F.transform(F.array(near - 1, near, near + 1), lambda k: F.struct(k.alias("k"), (x - first(k) + k * 12).alias("rest")))
            found = F.filter(months, lambda c: (c["rest"] >= 0) & (x < first(c["k"] + 1) - (c["k"] + 1) * 12))
            return let(found[0], lambda c: first(c["k"]) + 12 + c["rest"])

        return moved(F.when(F.dayofmonth(parsed(form)) > 12, parsed(form)), form, lambda n, d: n - 12 * (month(d) + 1), LATE_RADICES, back)

    shapes = (("^....-", any_day("yyyy-MM-dd")), (r"^..\.", any_day("dd.MM.yyyy")), ("^../", any_day("MM/dd/yyyy")), ("^../", late_day("dd/MM/yyyy")))
    return F.coalesce(*[F.when(m.rlike(shape), new) for shape, new in shapes], m)


def pseudonym(m: Column, key: str = DEFAULT_KEY, inverse: bool = False) -> Column:
    """The pseudonym of one matched value; the value itself where it isn't valid."""
    kind = lambda k: m.rlike(f"^(?:{PATTERNS[k]})$")
    return (
        F.when(m.contains("@"), _characters(m, lambda c, j: c.rlike("[0-9A-Za-z]") & (j < F.instr(m, "@")), key, "email", inverse))
        .when(kind("key"), _characters(m, lambda c, j: j > 4, key, "key", inverse))
        .when(kind("hex"), _characters(m, lambda c, j: F.lit(True), key, "hex", inverse, hexadecimal=True))
        .when(kind("iban"), _iban(m, key, inverse))
        .when(kind("date"), _date(m, key, inverse))
        .when(kind("ip"), _ip(m, key, inverse))
        .when(kind("phone"), _characters(m, lambda c, j: c.rlike("[0-9]") & (_digits_after(m, j) < 10), key, "phone", inverse))
        .when(kind("ssn"), _ssn(m, key, inverse))
        .otherwise(_card(m, key, inverse))
    )


def pseudonymise(docs: DataFrame, key: str = DEFAULT_KEY, text_col: str = "text", inverse: bool = False) -> DataFrame:
    """All rows and columns, personal values in the text replaced; adds n_pii (values replaced, long).

    Kinds: see PATTERNS.  Email domains, country codes of phones and first digits of cards stay.  A pseudonym is read as
    the same kind and form again and no two values of a kind and form share one, so inverse=True gives the text back.  What
    is no value stays: cards and IBANs whose check digits are wrong, days that the calendar doesn't have, dates outside the
    years 0200 to 9799.  n_pii counts values found that changed (a permutation may leave a value as it is).  Null texts
    stay null and empty ones empty, with n_pii 0; a column named n_pii is replaced.  Row by row, no shuffle: equal rows
    give equal rows, and a text of any length is one row.
    """
    kept = [c for c in docs.columns if c.lower() != "n_pii"]
    text = F.col(text_col).cast("string")

    def build(found):
        new = F.transform(found, lambda m: pseudonym(m, key, inverse))
        parts = F.split(text, ANY, -1)
        joined = lambda n: F.struct(F.array_join(F.zip_with(parts, F.concat(n, F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "").alias("text"), F.size(F.filter(F.zip_with(found, n, lambda a, b: a != b), lambda x: x)).cast("long").alias("n_pii"))
        return F.when(F.size(found) == 0, F.struct(text.alias("text"), F.lit(0).cast("long").alias("n_pii"))).otherwise(let(new, joined))

    done = F.when(text.rlike(HINT), let(F.regexp_extract_all(text, F.lit(ANY), F.lit(0)), build)).otherwise(F.struct(text.alias("text"), F.lit(0).cast("long").alias("n_pii")))
    rows = docs.select(*[F.col(c) for c in kept], done.alias("_done"))
    return rows.select(*[F.col("_done.text").alias(c) if c == text_col else F.col(c) for c in kept], F.col("_done.n_pii").alias("n_pii"))


def query(spark, sf_dir: str) -> DataFrame:
    return pseudonymise(read_table(spark, sf_dir, "documents")).select("doc_id", "n_pii", "text")
