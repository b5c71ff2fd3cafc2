"""Format-preserving Feistel pseudonyms for validated numbers, dates and addresses (DataFrame functions only).

Found and permuted, each within its own format and under a key:

* card numbers (13 to 19 digits that pass the Luhn check): first digit kept, check digit set anew. A chain of digit groups
  with single spaces or hyphens between them is searched whole, from left to right: the first and then longest run of
  whole groups that passes is a card number, unless one grouped as cards are begins within an oddly grouped one; the next
  one is looked for behind it, and the other groups (an order number, an expiry date, a security code) stay. A chain ends before an address, date or telephone number that starts in it;
* telephone numbers: the country code after ``+`` and all punctuation kept;
* social security numbers with a valid area, group and serial, IPv4 addresses with valid octets, calendar dates from
  1900-01-01 on (73000 days): permuted as numbers in exactly that range, so results are valid again;
* local parts of e-mail addresses: letters stay letters and digits digits; the domain is kept.

Each is a permutation of its format, so equal values stay equal across documents and different ones stay different.
Texts are cut at the matches and put together again, so everything else is unchanged. The key is an argument; who holds
it can invert the permutation. There is no shuffle: each row is rewritten where it is read.

Defined cases: null text stays null, with no pseudonyms; numbers that fail validation are left; an empty table gives no
rows; repeated rows are rewritten alike; other columns pass through unless they bear the names of the new ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63})+"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
DATE = r"(?<![0-9])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![0-9])"
IP = r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])"
_GROUPED_CARD = r"(?:[0-9]{4}[ -]){3}[0-9]{1,4}(?![0-9]|[ -][0-9]{4})|[0-9]{4}[ -][0-9]{6}[ -][0-9]{4}|[0-9]{13}"
PHONE = rf"\+[0-9]{{1,3}}(?:[ .-]?(?!{_GROUPED_CARD})\(?[0-9]{{2,4}}\)?){{2,5}}(?![0-9])|(?<![0-9])\(?[0-9]{{3}}\)?[ .-][0-9]{{3}}[ .-][0-9]{{4}}(?![0-9])"
_OTHERS = "|".join(f"(?:{p})" for p in (EMAIL, SSN, DATE, IP, PHONE))
CHAIN = rf"(?<![0-9])(?=[0-9](?:[ -]?[0-9]){{12}})[0-9](?:[0-9]|[ -](?!{_OTHERS})[0-9])*+"
_USUAL_CARD = "^(?:[0-9]{13,19}|(?:[0-9]{4}[ -]){3}[0-9]{1,4}(?:[ -][0-9]{1,3})?|[0-9]{4}[ -][0-9]{6}[ -][0-9]{4,5})$"
PATTERN = f"{_OTHERS}|(?:{CHAIN})"
ROUNDS = 8
_DAYS = (365, 200)  # 73000 days from 1900-01-01


def _random(key: str, kind: str, step: Column, half: Column) -> Column:
    """64 hexadecimal digits that depend on all of these."""
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), step.cast("string"), half.cast("string")), 256)


def _number(hexadecimal: Column, first: Column | int, length: int) -> Column:
    return F.conv(F.substr(hexadecimal, first if isinstance(first, Column) else F.lit(first), F.lit(length)), 16, 10).cast("long")


def feistel_number(value: Column, high: int, low: int, key: str, kind: str) -> Column:
    """A permutation of 0 to high*low-1: the two mixed-radix digits in turn get a keyed function of the other added."""

    def step(pair: Column, i: Column) -> Column:
        left, right = pair["left"], pair["right"]
        even = i % 2 == 0
        return F.struct(
            F.when(even, (left + _number(_random(key, kind, i, right), 1, 12)) % high).otherwise(left).alias("left"),
            F.when(even, right).otherwise((right + _number(_random(key, kind, i, left), 1, 12)) % low).alias("right"),
        )

    start = F.struct(F.floor(value / low).cast("long").alias("left"), (value % low).cast("long").alias("right"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda pair: pair["left"] * low + pair["right"])


def feistel_text(value: Column, key: str, kind: str) -> Column:
    """A permutation of texts of one pattern: each character moves within its class (digits, small and capital letters), by a keyed function of the other half."""
    half = F.floor(F.length(value) / 2).cast("int")

    def moved(part: Column, other: Column, i: Column) -> Column:
        hexadecimal = _random(key, kind, i, other)

        def one(c: Column, j: Column) -> Column:
            code, by = F.ascii(c), _number(hexadecimal, j * 2 + 1, 2)
            within = lambda first, size: F.char(((code - first + by) % size + first).cast("long"))
            return F.when(c.between("0", "9"), within(48, 10)).when(c.between("a", "z"), within(97, 26)).when(c.between("A", "Z"), within(65, 26)).otherwise(c)

        return F.array_join(F.transform(F.filter(F.split(part, ""), lambda c: c != ""), one), "")

    def step(pair: Column, i: Column) -> Column:
        left, right = pair["left"], pair["right"]
        even = i % 2 == 0
        return F.struct(F.when(even, moved(left, right, i)).otherwise(left).alias("left"), F.when(even, right).otherwise(moved(right, left, i)).alias("right"))

    start = F.struct(F.substr(value, F.lit(1), half).alias("left"), F.substr(value, half + 1).alias("right"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda pair: F.concat(pair["left"], pair["right"]))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _refill(m: Column, digits: Column) -> Column:
    """m with its digits replaced in order."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("next"))

    def step(so_far: Column, c: Column) -> Column:
        digit = c.between("0", "9")
        return F.struct(
            F.concat(so_far["out"], F.when(digit, F.substr(digits, so_far["next"], F.lit(1))).otherwise(c)).alias("out"),
            (so_far["next"] + digit.cast("int")).alias("next"),
        )

    return F.aggregate(F.filter(F.split(m, ""), lambda c: c != ""), start, step, lambda x: x["out"])


def _card(m: Column, key: str) -> Column:
    digits = _digits(m)
    body = F.concat(F.substr(digits, F.lit(1), F.lit(1)), feistel_text(F.substr(digits, F.lit(2), F.length(digits) - 2), key, "card"))
    check = F.filter(F.sequence(F.lit(0), F.lit(9)), lambda c: F.call_function("luhn_check", F.concat(body, c.cast("string"))))
    return _refill(m, F.concat(body, F.element_at(check, 1).cast("string")))


def _bound(value: Column, body) -> Column:
    """body of value, which is computed once however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _card_runs(chars: Column) -> Column:
    """first and last places of the runs of whole groups of digits that are card numbers, from left to right, longer ones first.

    A run in which one grouped as cards are begins later is left out.
    """
    n = F.size(chars)
    digit = lambda i: F.element_at(chars, i).between("0", "9")
    within = lambda i: F.when((i < 1) | (i > n), F.lit(False)).otherwise(digit(F.greatest(F.lit(1), F.least(i, n))))
    begins = lambda i: digit(i) & ~within(i - 1) & (i + 12 <= n)
    ends = lambda a: F.filter(F.sequence(F.least(a + 36, n), a + 12, F.lit(-1)), lambda b: digit(b) & ~within(b + 1))
    text = lambda a, b: F.array_join(F.slice(chars, a, b - a + 1), "")
    valid = lambda d: F.length(d).between(13, 19) & F.call_function("luhn_check", d)
    usual = lambda a: F.when(begins(a), F.exists(ends(a), lambda b: text(a, b).rlike(_USUAL_CARD) & valid(_digits(text(a, b))))).otherwise(F.lit(False))

    def clear(starts: Column) -> Column:
        runs = F.flatten(F.transform(F.filter(F.sequence(F.lit(1), n), begins), lambda a: F.transform(ends(a), lambda b: F.struct(a.alias("first"), b.alias("last")))))
        hides = lambda r: F.exists(F.slice(starts, r["first"] + 1, r["last"] - r["first"]), lambda x: x) & ~text(r["first"], r["last"]).rlike(_USUAL_CARD)
        return F.filter(F.filter(runs, lambda r: valid(_digits(text(r["first"], r["last"])))), lambda r: ~hides(r))

    return _bound(F.transform(F.sequence(F.lit(1), n), usual), clear)


def _chain_parts(m: Column) -> Column:
    """kind and value of the parts of a chain: its card numbers, and with a null kind what stands before, between and after them."""

    def parts(chars: Column) -> Column:
        text = lambda a, b: F.array_join(F.slice(chars, a, F.greatest(b - a + 1, F.lit(0))), "")
        part = lambda kind, a, b: F.struct(F.lit(kind).cast("string").alias("kind"), text(a, b).alias("value"))
        none = F.array().cast("array<struct<kind:string,value:string>>")
        start = F.struct(F.lit(1).alias("next"), none.alias("out"))

        def step(so_far: Column, r: Column) -> Column:
            more = F.concat(so_far["out"], F.array(part(None, so_far["next"], r["first"] - 1), part("card", r["first"], r["last"])))
            taken = F.struct((r["last"] + 1).alias("next"), more.alias("out"))
            return F.when(r["first"] >= so_far["next"], taken).otherwise(so_far)

        return F.aggregate(_card_runs(chars), start, step, lambda x: F.concat(x["out"], F.array(part(None, x["next"], F.size(chars)))))

    return _bound(F.filter(F.split(m, ""), lambda c: c != ""), parts)


def _phone(m: Column, key: str) -> Column:
    code = F.regexp_extract(m, r"^\+([0-9]{1,3})(?=[^0-9])", 1)  # empty without a country code
    digits = _digits(m)
    return _refill(m, F.concat(code, feistel_text(F.substr(digits, F.length(code) + 1), key, "phone")))


def _ssn(m: Column, key: str) -> Column:
    area, group, serial = (F.substr(m, F.lit(a), F.lit(b)).cast("long") for a, b in ((1, 3), (5, 2), (8, 4)))
    index = F.when(area > 666, area - 2).otherwise(area - 1)  # areas 1 to 665 and 667 to 899
    new = feistel_number((index * 99 + group - 1) * 9999 + serial - 1, 898, 99 * 9999, key, "ssn")
    place = F.floor(new / (99 * 9999)).cast("long")
    pad = lambda x, n: F.lpad(x.cast("string"), n, "0")
    return F.concat(pad(F.when(place >= 665, place + 2).otherwise(place + 1), 3), F.lit("-"), pad(F.floor(new / 9999) % 99 + 1, 2), F.lit("-"), pad(new % 9999 + 1, 4))


def _octets(m: Column) -> Column:
    return F.transform(F.split(m, r"\."), lambda x: x.cast("long"))


def _ip(m: Column, key: str) -> Column:
    value = F.aggregate(_octets(m), F.lit(0).cast("long"), lambda a, x: a * 256 + x)
    new = feistel_number(value, 65536, 65536, key, "ip")
    return F.concat_ws(".", *((F.shiftright(new, s) % 256).cast("string") for s in (24, 16, 8, 0)))


def _day(m: Column) -> Column:
    """Days since 1900-01-01; null if m is no date of the range."""
    pattern = F.when(m.rlike("^[0-9]{4}-"), "yyyy-MM-dd").when(m.contains("/"), "MM/dd/yyyy").otherwise("dd.MM.yyyy")
    iso = F.when(pattern == "yyyy-MM-dd", m).when(pattern == "MM/dd/yyyy", F.concat_ws("-", F.substr(m, F.lit(7), F.lit(4)), F.substr(m, F.lit(1), F.lit(2)), F.substr(m, F.lit(4), F.lit(2)))).otherwise(
        F.concat_ws("-", F.substr(m, F.lit(7), F.lit(4)), F.substr(m, F.lit(4), F.lit(2)), F.substr(m, F.lit(1), F.lit(2)))
    )
    day = F.date_diff(iso.try_cast("date"), F.lit("1900-01-01").cast("date"))
    return F.when((day >= 0) & (day < _DAYS[0] * _DAYS[1]), day)


def _date(m: Column, key: str) -> Column:
    new = F.date_add(F.lit("1900-01-01").cast("date"), feistel_number(_day(m).cast("long"), *_DAYS, key, "date").cast("int")).cast("string")
    y, mo, d = (F.substr(new, F.lit(a), F.lit(b)) for a, b in ((1, 4), (6, 2), (9, 2)))
    return F.when(m.rlike("^[0-9]{4}-"), new).when(m.contains("/"), F.concat_ws("/", mo, d, y)).otherwise(F.concat_ws(".", d, mo, y))


def kind_of(m: Column) -> Column:
    """email, ssn, date, ip, phone, or null for a match that isn't valid or is a chain of digit groups."""
    digits = _digits(m)
    whole = lambda p: m.rlike(f"^(?:{p})$")
    return (
        F.when(m.contains("@"), "email")
        .when(whole(SSN), F.when(~m.rlike("^(?:000|666|9)") & ~m.rlike("-00-|-0000$"), "ssn"))
        .when(whole(DATE), F.when(_day(m).isNotNull(), "date"))
        .when(whole(IP), F.when(F.forall(_octets(m), lambda x: x <= 255), "ip"))
        .when(whole(PHONE), F.when(F.length(digits).between(8, 15), "phone"))
    )


def pseudonym(m: Column, kind: Column, key: str) -> Column:
    at = F.instr(m, "@")
    return (
        F.when(kind == "email", F.concat(feistel_text(F.substr(m, F.lit(1), at - 1), key, "email"), F.substr(m, at)))
        .when(kind == "ssn", _ssn(m, key))
        .when(kind == "date", _date(m, key))
        .when(kind == "ip", _ip(m, key))
        .when(kind == "phone", _phone(m, key))
        .when(kind == "card", _card(m, key))
        .otherwise(m)
    )


def pseudonymise(docs: DataFrame, key: str = "change-me", column: str = "text", report: str | None = "pseudonyms") -> DataFrame:
    """docs with the column rewritten; report: a column for the (kind, value) structs of the values put in, in order."""
    name = "__found"
    while name in docs.columns:
        name += "_"
    found = docs.withColumn(name, F.regexp_extract_all(F.col(column).cast("string"), F.lit(PATTERN), F.lit(0)))
    found = found.withColumn(name, F.transform(name, lambda m: F.struct(kind_of(m).alias("kind"), m.alias("value"))))
    chain = lambda x: x["kind"].isNull() & x["value"].rlike("^[0-9][0-9 -]*$") & (F.length(_digits(x["value"])) >= 13)
    found = found.withColumn(name, F.transform(name, lambda x: F.when(chain(x), _chain_parts(x["value"])).otherwise(F.array(x))))
    found = found.withColumn(name, F.transform(name, lambda match: F.transform(match, lambda x: F.struct(x["kind"].alias("kind"), pseudonym(x["value"], x["kind"], key).alias("value")))))
    values = F.concat(F.transform(name, lambda match: F.array_join(F.transform(match, lambda x: x["value"]), "")), F.array(F.lit("")))
    parts = F.split(F.col(column).cast("string"), PATTERN, -1)
    rebuilt = F.array_join(F.flatten(F.zip_with(parts, values, lambda a, b: F.array(a, b))), "")
    changed = found.withColumn(column, F.when(F.size(name) > 0, rebuilt).otherwise(F.col(column).cast("string")))
    if report:
        changed = changed.withColumn(report, F.coalesce(F.transform(F.filter(F.flatten(name), lambda x: x["kind"].isNotNull()), lambda x: F.struct(x["kind"].alias("kind"), x["value"].alias("value"))), F.array().cast("array<struct<kind:string,value:string>>")))
    return changed.drop(name)
