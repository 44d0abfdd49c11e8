"""Format-preserving pseudonyms for personal data, in DataFrame functions only.

Candidates are found by one pattern per kind, validated (Luhn, IBAN check
digits, calendar, number ranges), and replaced by a keyed permutation of the
same format: a Feistel network over the kind's own domain, with SHA-2 of the
key, the round and the other half as its round function. The same value gets the
same pseudonym in every document, different values get different ones, and
whoever holds the key can invert it. Check digits are computed anew, so a
pseudonym validates like its original. What doesn't validate stays as it is.

A text is split at its candidates, the candidates are mapped and the parts are
joined again: one projection, no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
SPAN = 73_000          # dates are permuted within blocks of so many days from 1900-01-01: 200 * 365
#: The blocks at both ends, which stop at 1000-01-01 and 2999-12-31: their days (first and past the last), as a product.
END_BLOCKS = ((-328_718, -292_000, 22, 1669), (292_000, 401_767, 21, 5227))

# One pattern a kind, tried in this order at each place.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@(?:[A-Za-z0-9-]{1,63}\.){1,32}[A-Za-z]{2,24}",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "date": r"(?<![A-Za-z0-9])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}"
            r"|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4})(?![A-Za-z0-9])",
    "ip": r"(?<![A-Za-z0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.?[A-Za-z0-9])",
    "ssn": r"(?<![A-Za-z0-9])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9])",
    "phone": r"(?<![A-Za-z0-9+])(?:\+?1[ .-]?)?(?:\([0-9]{3}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![A-Za-z0-9])",
    "card": r"(?<![A-Za-z0-9])[0-9](?:[ -]?[0-9]){12,18}(?![A-Za-z0-9])",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())


def _long(c: Column) -> Column:
    return c.cast("bigint")


def _prf(key: str, kind: str, i: Column, half: Column) -> Column:
    """60 pseudorandom bits."""
    text = F.concat_ws("|", F.lit(key), F.lit(kind), i.cast("string"), half.cast("string"))
    return _long(F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10))


def _permuted(a: Column, b: Column, m: Column, n: Column, key: str, kind: str) -> Column:
    """Feistel permutation of the pairs (a < m, b < n): struct a, b."""
    def step(acc, i):
        width = F.when(i % 2 == 0, m).otherwise(n)
        return F.struct(acc["b"].alias("a"), F.pmod(acc["a"] + _prf(key, kind, i, acc["b"]), width).alias("b"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)),
                       F.struct(_long(a).alias("a"), _long(b).alias("b")), step)


def _digits(d: Column, key: str, kind: str) -> Column:
    """Permutation of the digit strings of d's length."""
    n = F.length(d)
    left = F.floor(n / 2).cast("int")
    ten = lambda k: _long(F.pow(F.lit(10), k))
    p = _permuted(F.coalesce(_long(F.substring(d, F.lit(1), left)), _long(F.lit(0))),
                  _long(F.substring(d, left + 1, n - left)), ten(left), ten(n - left), key,
                  kind + "/")
    return F.concat(F.lpad(p["a"].cast("string"), left, "0"), F.lpad(p["b"].cast("string"), n - left, "0"))


def _refilled(m: Column, digits: Column) -> Column:
    """m with its digits replaced by ``digits`` in order."""
    return F.aggregate(F.split(m, ""), F.struct(F.lit("").alias("s"), F.lit(0).alias("k")), lambda acc, c: F.when(
        c.rlike("^[0-9]$"), F.struct(F.concat(acc["s"], F.substring(digits, acc["k"] + 1, F.lit(1))).alias("s"),
                                     (acc["k"] + 1).alias("k"))).otherwise(
        F.struct(F.concat(acc["s"], c).alias("s"), acc["k"].alias("k"))))["s"]


def _only_digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn_sum(d: Column) -> Column:
    """Sum in which every second digit from the right, starting with the last, counts double."""
    digits = F.reverse(F.split(d, ""))
    return F.aggregate(F.transform(digits, lambda c, i: F.when(
        i % 2 == 0, 2 * c.cast("int") - F.when(c.cast("int") > 4, 9).otherwise(0)).otherwise(c.cast("int"))),
        F.lit(0), lambda a, x: a + x)


def _check_digit(payload: Column) -> Column:
    return F.pmod(10 - F.pmod(_luhn_sum(payload), F.lit(10)), F.lit(10)).cast("string")


def _card(m: Column, key: str) -> Column:
    d = _only_digits(m)
    payload = F.substring(d, F.lit(1), F.length(d) - 1)
    fresh = _digits(payload, key, "card")
    return F.when(_check_digit(payload) == F.substring(d, F.length(d), F.lit(1)),
                  _refilled(m, F.concat(fresh, _check_digit(fresh))))


def _phone(m: Column, key: str) -> Column:
    """Area and exchange codes from 200 on, as in use, stay such codes; lower ones stay below 200."""
    d = _only_digits(m)
    lead, d = F.substring(d, F.lit(1), F.length(d) - 10), F.substring(d, F.length(d) - 9, F.lit(10))
    part = lambda at, n: _long(F.substring(d, at, n))
    area, exchange, line = part(1, 3), part(4, 3), part(7, 4)
    low = lambda c: F.when(c >= 200, 200).otherwise(0)
    size = lambda c: F.when(c >= 200, 80_000).otherwise(20_000)
    p = _permuted((area - low(area)) * 100 + F.floor(line / 100), (exchange - low(exchange)) * 100 + line % 100,
                  size(area), size(exchange), key, "phone")
    code = lambda half, c: F.lpad((F.floor(half / 100) + low(c)).cast("string"), 3, "0")
    two = lambda half: F.lpad((half % 100).cast("string"), 2, "0")
    return _refilled(m, F.concat(lead, code(p["a"], area), code(p["b"], exchange), two(p["a"]), two(p["b"])))


def _ssn(m: Column, key: str) -> Column:
    """Areas 001-899 but 666, groups 01-99, serials 0001-9999."""
    part = lambda at, n: _long(F.substring(m, at, n))
    area, group, serial = part(1, 3), part(5, 2), part(8, 4)
    p = _permuted(area - 1 - F.when(area > 666, 1).otherwise(0), (group - 1) * 9999 + serial - 1,
                  F.lit(898), F.lit(99 * 9999), key, "ssn")
    fresh = p["a"] + 1 + F.when(p["a"] >= 665, 1).otherwise(0)
    out = F.concat_ws("-", F.lpad(fresh.cast("string"), 3, "0"),
                      F.lpad((F.floor(p["b"] / 9999) + 1).cast("string"), 2, "0"),
                      F.lpad((F.pmod(p["b"], F.lit(9999)) + 1).cast("string"), 4, "0"))
    return F.when((area >= 1) & (area <= 899) & (area != 666) & (group >= 1) & (serial >= 1), out)


def _ip(m: Column, key: str) -> Column:
    o = F.transform(F.split(m, "\\."), _long)
    p = _permuted(o[0] * 256 + o[1], o[2] * 256 + o[3], F.lit(65536), F.lit(65536), key, "ip")
    part = lambda x: F.concat_ws(".", F.floor(x / 256).cast("string"), F.pmod(x, F.lit(256)).cast("string"))
    return F.when(F.forall(o, lambda x: x <= 255), F.concat_ws(".", part(p["a"]), part(p["b"])))


def _date(m: Column, key: str) -> Column:
    """ISO dates, and dates with the year last: day first, unless only month first is a date."""
    sep = F.when(m.contains("-"), "-").when(m.contains("/"), "/").otherwise(".")
    f = F.split(m, "[-/.]")
    iso = sep == "-"
    padded = lambda c: F.lpad(c, 2, "0")
    made = lambda y, mo, d: F.concat_ws("-", y, padded(mo), padded(d)).try_cast("date")
    day_first = made(f[2], f[1], f[0])
    month_first = day_first.isNull()
    value = F.when(iso, m.try_cast("date")).otherwise(F.coalesce(day_first, made(f[2], f[0], f[1])))
    at = F.datediff(value, F.lit("1900-01-01").cast("date"))
    start, m, n = F.floor(at / SPAN) * SPAN, F.lit(200), F.lit(365)
    for first, end, rows, width in END_BLOCKS:
        here = (at >= first) & (at < end)
        start, m, n = (F.when(here, F.lit(x)).otherwise(y) for x, y in ((first, start), (rows, m), (width, n)))
    p = _permuted(F.floor((at - start) / n), F.pmod(at - start, n), m, n, key, "date")
    fresh = F.date_add(F.lit("1900-01-01").cast("date"), (start + p["a"] * n + p["b"]).cast("int"))
    wide = lambda n, c: F.lpad(n.cast("string"), F.greatest(F.length(c), F.length(n.cast("string"))), "0")
    day, month, year = F.day(fresh), F.month(fresh), F.lpad(F.year(fresh).cast("string"), 4, "0")
    out = F.when(iso, F.concat_ws("-", year, F.lpad(month.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0"))) \
        .when(month_first, F.concat(wide(month, f[0]), sep, wide(day, f[1]), sep, year)) \
        .otherwise(F.concat(wide(day, f[0]), sep, wide(month, f[1]), sep, year))
    return F.when((F.year(value) >= 1000) & (F.year(value) <= 2999), out)


def _shifted(c: Column, b: Column) -> Column:
    """A letter or digit moved b places within its class; all else stays."""
    turn = lambda first, n: F.char(F.pmod(F.ascii(c) - ord(first) + b, F.lit(n)) + ord(first))
    return F.when(c.rlike("^[a-z]$"), turn("a", 26)).when(c.rlike("^[A-Z]$"), turn("A", 26)) \
        .when(c.rlike("^[0-9]$"), turn("0", 10)).otherwise(c)


def _letters(s: Column, context: Column, key: str, kind: str) -> Column:
    """Feistel permutation of the strings with s's sequence of character classes."""
    chars = F.split(s, "")
    n = F.size(chars)
    left = F.floor(n / 2).cast("int")

    def step(acc, i):
        half = F.concat_ws("|", F.array_join(acc["b"], ""), context)
        stream = lambda j: _prf(key, kind, i, F.concat_ws("|", j.cast("string"), half))
        return F.struct(acc["b"].alias("a"), F.transform(acc["a"], lambda c, j: _shifted(c, stream(j))).alias("b"))
    p = F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(
        F.slice(chars, F.lit(1), left).alias("a"), F.slice(chars, left + 1, n - left).alias("b")), step)
    return F.array_join(F.concat(p["a"], p["b"]), "")


def _email(m: Column, key: str) -> Column:
    """The local part is permuted; the domain stays and takes part in the key."""
    domain = F.substring_index(m, "@", -1)
    return F.concat(_letters(F.substring_index(m, "@", 1), F.lower(domain), key, "email"), F.lit("@"), domain)


def _mod97(s: Column) -> Column:
    """Remainder of an IBAN in checking order, letters as 10 to 35."""
    return F.aggregate(F.split(s, ""), _long(F.lit(0)), lambda acc, c: F.when(
        c.rlike("^[0-9]$"), (acc * 10 + _long(c)) % 97).otherwise((acc * 100 + F.ascii(c) - 55) % 97))


def _iban(m: Column, key: str) -> Column:
    plain = F.replace(m, F.lit(" "), F.lit(""))
    country, account = F.substring(plain, 1, 2), F.substring(plain, 5, 40)
    fresh = _letters(account, country, key, "iban")
    check = F.lpad((98 - _mod97(F.concat(fresh, country, F.lit("00")))).cast("string"), 2, "0")
    whole = F.concat(country, check, fresh)
    spaced = F.aggregate(F.split(m, ""), F.struct(F.lit("").alias("s"), F.lit(0).alias("k")), lambda acc, c: F.when(
        c == " ", F.struct(F.concat(acc["s"], c).alias("s"), acc["k"].alias("k"))).otherwise(
        F.struct(F.concat(acc["s"], F.substring(whole, acc["k"] + 1, F.lit(1))).alias("s"), (acc["k"] + 1).alias("k"))))["s"]
    return F.when(F.length(plain).between(15, 34) & (_mod97(F.concat(account, F.substring(plain, 1, 4))) == 1), spaced)


_KINDS = {"email": _email, "iban": _iban, "date": _date, "ip": _ip, "ssn": _ssn, "phone": _phone, "card": _card}


def pseudonymise(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text with pseudonyms, ``found`` (kind, pseudonym of every replaced value) and a count per kind.

    NULL texts stay NULL and hold nothing; empty texts, NULL ids and repeated rows
    are ordinary. Texts are read whole. No other input column is kept. Dates of the
    years 1000 to 2999 stay in them. A mail domain has 33 labels at most.
    """
    d = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    some = F.col("text").rlike("[0-9@]") & F.col("text").rlike(ANY)
    d = d.withColumn("hits", F.when(some, F.regexp_extract_all("text", F.lit(f"({ANY})"), 1)))

    def mapped(m):
        kind, new = None, None
        for k, f in _KINDS.items():
            fits = m.rlike(f"^(?:{PATTERNS[k]})$")
            kind = F.when(fits, k) if kind is None else kind.when(fits, k)
            new = F.when(fits, f(m, key)) if new is None else new.when(fits, f(m, key))
        return F.struct(kind.alias("kind"), m.alias("old"), new.alias("new"))

    d = d.withColumn("new", F.transform("hits", mapped))
    parts = F.split("text", ANY, -1)
    joined = F.array_join(F.flatten(F.zip_with(
        parts, "new", lambda p, h: F.array(p, F.coalesce(h["new"], h["old"], F.lit(""))))), "")
    text = F.when(F.col("hits").isNull(), F.col("text")).otherwise(joined)
    done = F.filter(F.coalesce("new", F.array().cast("array<struct<kind:string,old:string,new:string>>")),
                    lambda h: h["new"].isNotNull())
    d = d.select("doc_id", text.alias("text"), done.alias("done"))
    return d.select("doc_id", "text", F.transform("done", lambda h: F.struct(h["kind"], h["new"])).alias("found"), *[
        F.size(F.filter("done", _is(k))).cast("long").alias(f"n_{k}")
        for k in PATTERNS])


def _is(kind: str):
    return lambda h: h["kind"] == kind
