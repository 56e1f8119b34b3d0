"""Format-preserving pseudonyms for personal data, with DataFrame functions only.

Values are found by pattern and validated (check digits, calendar, ranges); what does not validate
stays as it is. A valid value is split in two halves that a keyed Feistel network mixes in turn:
``l = (l + F(r)) mod a``, then ``r = (r + F(l)) mod b``, a permutation of the ``a * b`` values of its
format. So equal values get equal pseudonyms in every document, different ones stay different, and
pseudonyms are valid again. Mail addresses have no fixed range of values: their local part becomes
a keyed digest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 10
# Days from 1900-01-01 to 2099-12-31: 17 * 4297.
_DAY_SIDES = (17, 4297)
_EPOCH = "1900-01-01"

# A local part begins where its run of characters does, or where the value before it ended, and is
# taken whole: no character is tried twice. Hosts are one class of characters, so that no repeated
# group has to be remembered, however long they are.
_EMAIL = r"(?:\G|(?<![\p{L}\p{N}._%+-]))[\p{L}\p{N}._%+-]++@[A-Za-z0-9-][A-Za-z0-9.-]*\.[A-Za-z]{2,}"
_IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
_IPV4 = r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?!\.?[0-9])"
_ISO_DAY = r"(?<![0-9-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9-])"
_DAY = r"(?<![0-9./])[0-9]{2}([./])[0-9]{2}\1[0-9]{4}(?![0-9])"
_SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
# A value by itself that may follow a phone number: day, social security number, address, card, phone.
_NEXT = (
    r"[ .-](?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}[./][0-9]{2}[./][0-9]{4}|[0-9]{3}-[0-9]{2}-[0-9]{4}"
    r"|(?:[0-9]{1,3}\.){3}[0-9]{1,3}|(?:[0-9]{4}[ -]){3}[0-9]{4}"
    r"|[2-9][0-9]{2}[.-][0-9]{3}[.-][0-9]{4})(?![0-9])"
)
_PHONE = (
    r"\+[0-9]{1,3}[ .-]?(?:\([0-9]{2,4}\)[ .-]?)?[0-9]{2,4}"
    rf"(?:(?!{_NEXT})[ .-]?[0-9]{{2,4}}){{1,4}}(?![0-9])"
)
# Four groups of four are a card, whatever number comes next, unless a shorter group goes on.
_CARD_4 = (
    r"(?<![0-9-])(?:(?:[0-9]{4} ){3}|(?:[0-9]{4}-){3})[0-9]{4}(?![0-9])(?![ -][0-9]{1,3}(?![0-9.,/:-]))"
)
_CARD = r"(?<![0-9-])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])"
# Without a country: an area in brackets or a leading zero with a gap.
# Eight to twelve digits, so that what is no card and has no plus can only be one of these.
_NATIONAL = (
    r"(?<![\p{L}0-9.+-])(?:"
    r"\((?=(?:[^0-9]{0,2}[0-9]){8,12}(?![ -]?[0-9]))[0-9]{2,5}\)[ .-]?[0-9]{2,8}(?:[ .-][0-9]{2,6}){0,3}"
    r"|(?=(?:[ /-]?[0-9]){8,12}(?![ /-]?[0-9]))0[0-9]{1,4}[ /-][0-9]{2,8}(?:[ -][0-9]{2,6}){0,3}"
    r")(?![0-9]|[.-][0-9])"
)
# Three, three and four digits; looked for before cards, which would take a number that follows in.
_LOCAL = (
    r"(?<![\p{L}0-9.+-])(?:[2-9][0-9]{2}-[0-9]{3}-[0-9]{4}|[2-9][0-9]{2}\.[0-9]{3}\.[0-9]{4})(?![0-9]|[.-][0-9])"
)
PATTERN = "|".join([_EMAIL, _IBAN, _IPV4, _ISO_DAY, _DAY, _SSN, _PHONE, _CARD_4, _LOCAL, _CARD, _NATIONAL])
# No value of any pattern is without one of these.
_SOME = "[0-9]|@"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _prf(key: str, label: str, i: Column, x: Column) -> Column:
    """Sixty keyed bits of ``x``."""
    text = F.concat_ws("/", F.lit(key), F.lit(label), i.cast("string"), x.cast("string"), F.lit(key))
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long")


def permute(key: str, label: str, left: Column, right: Column, a: Column, b: Column) -> Column:
    """The keyed permutation of pairs of longs below ``a`` and ``b``, as a struct ``l``, ``r``."""

    def step(state: Column, i: Column) -> Column:
        even = i % 2 == 0
        moved_l = F.pmod(state["l"] + F.pmod(_prf(key, label, i, state["r"]), a), a)
        moved_r = F.pmod(state["r"] + F.pmod(_prf(key, label, i, state["l"]), b), b)
        return F.struct(
            F.when(even, moved_l).otherwise(state["l"]).cast("long").alias("l"),
            F.when(even, state["r"]).otherwise(moved_r).cast("long").alias("r"),
        )

    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)


def _let(value: Column, f) -> Column:
    """``f`` of a value that is computed once."""
    return F.transform(F.array(value), f)[0]


def permute_digits(key: str, label: str, digits: Column) -> Column:
    """A digit string (2 to 30 digits) permuted among those of its length."""

    def of(d: Column) -> Column:
        n = F.length(d)
        cut = F.floor(n / 2).cast("int")
        a = F.pow(F.lit(10.0), cut).cast("long")
        b = F.pow(F.lit(10.0), n - cut).cast("long")
        left = F.substring(d, F.lit(1), cut).cast("long")
        right = F.substring(d, cut + 1, n - cut).cast("long")
        mixed = permute(key, label, left, right, a, b)
        return _let(
            mixed,
            lambda m: F.concat(F.lpad(m["l"].cast("string"), cut, "0"), F.lpad(m["r"].cast("string"), n - cut, "0")),
        )

    return _let(digits, of)


def _fill(value: Column, digits: Column) -> Column:
    """``value`` with its digits replaced, in order, by ``digits``; all other characters stay."""
    return _let(
        F.struct(value.alias("v"), digits.alias("d")),
        lambda x: F.aggregate(
            F.split(x["v"], ""),
            F.struct(F.lit(0).alias("n"), F.lit("").alias("t")),
            lambda s, c: F.when(
                c.rlike("^[0-9]$"),
                F.struct((s["n"] + 1).alias("n"), F.concat(s["t"], F.substring(x["d"], s["n"] + 1, F.lit(1))).alias("t")),
            ).otherwise(F.struct(s["n"].alias("n"), F.concat(s["t"], c).alias("t"))),
            lambda s: s["t"],
        ),
    )


def _luhn_sum(digits: Column) -> Column:
    """Sum of the digits, every second from the right, beginning with the last, doubled."""
    return F.aggregate(
        F.split(F.reverse(digits), ""),
        F.struct(F.lit(0).alias("i"), F.lit(0).alias("t")),
        lambda s, c: _let(
            c.cast("int") * F.when(s["i"] % 2 == 0, 2).otherwise(1),
            lambda v: F.struct((s["i"] + 1).alias("i"), (s["t"] + F.when(v > 9, v - 9).otherwise(v)).alias("t")),
        ),
        lambda s: s["t"],
    )


def _check_digit(payload: Column) -> Column:
    return F.pmod(10 - _luhn_sum(payload) % 10, F.lit(10)).cast("string")


def _card(key: str, value: Column) -> Column:
    def of(d: Column) -> Column:
        payload = F.substring(d, F.lit(1), F.length(d) - 1)
        valid = (_check_digit(payload) == F.right(d, F.lit(1))) & ~d.rlike("^0+$")
        new = _let(permute_digits(key, "card", payload), lambda p: F.concat(p, _check_digit(p)))
        return F.when(valid, _fill(value, new))

    return _let(_digits(value), of)


def _phone(key: str, value: Column) -> Column:
    def of(d: Column) -> Column:
        new = F.concat(F.left(d, F.lit(1)), permute_digits(key, "phone", F.substring(d, F.lit(2), F.length(d) - 1)))
        return F.when(F.length(d).between(8, 15), _fill(value, new))

    return _let(_digits(value), of)


def _ipv4(key: str, value: Column) -> Column:
    def of(p: Column) -> Column:
        valid = F.forall(p, lambda x: x <= 255)
        mixed = permute(key, "ipv4", p[0] * 256 + p[1], p[2] * 256 + p[3], F.lit(65536), F.lit(65536))
        byte = [("l", 256), ("l", 1), ("r", 256), ("r", 1)]
        new = _let(mixed, lambda m: F.concat_ws(".", *[F.floor(m[s] / d).cast("long").bitwiseAND(F.lit(255).cast("long")).cast("string") for s, d in byte]))
        return F.when(valid, new)

    return _let(F.transform(F.split(value, r"\."), lambda x: x.cast("int")), of)


def _moved_day(key: str, day: Column) -> Column:
    a, b = _DAY_SIDES
    n = F.datediff(day, F.lit(_EPOCH).cast("date"))
    mixed = permute(key, "day", F.floor(n / b), F.pmod(n, F.lit(b)), F.lit(a), F.lit(b))
    new = _let(mixed, lambda m: F.date_add(F.lit(_EPOCH).cast("date"), (m["l"] * b + m["r"]).cast("int")))
    return F.when(n.between(0, a * b - 1), new)


def _valid_day(year: Column, month: Column, day: Column) -> Column:
    """The date, or null; years from 1900 to 2099 only."""
    y, m, d = year.cast("int"), month.cast("int"), day.cast("int")
    fits = y.between(1900, 2099) & m.between(1, 12) & d.between(1, 31)
    return F.when(fits, _let(F.make_date(y, m, F.lit(1)), lambda x: F.when(d <= F.dayofmonth(F.last_day(x)), F.date_add(x, d - 1))))


def _iso_day(key: str, value: Column) -> Column:
    day = _valid_day(F.substring(value, 1, 4), F.substring(value, 6, 2), F.substring(value, 9, 2))
    return _let(day, lambda d: F.date_format(_moved_day(key, d), "yyyy-MM-dd"))


def _written_day(key: str, value: Column) -> Column:
    """``31.12.1999`` has the day first, ``12/31/1999`` the month, or the day if only that is valid."""
    one, two, year = F.substring(value, 1, 2), F.substring(value, 4, 2), F.substring(value, 7, 4)
    day_first, month_first = _valid_day(year, two, one), _valid_day(year, one, two)
    return F.when(
        F.substring(value, 3, 1) == ".", _let(day_first, lambda d: F.date_format(_moved_day(key, d), "dd.MM.yyyy"))
    ).otherwise(
        F.coalesce(
            _let(month_first, lambda d: F.date_format(_moved_day(key, d), "MM/dd/yyyy")),
            _let(day_first, lambda d: F.date_format(_moved_day(key, d), "dd/MM/yyyy")),
        )
    )


def _ssn(key: str, value: Column) -> Column:
    """Areas 001 to 899 without 666, groups and serials from 1."""

    def of(d: Column) -> Column:
        area, group, serial = (F.substring(d, a, n).cast("long") for a, n in ((1, 3), (4, 2), (6, 4)))
        valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
        left = (area - F.when(area > 666, 2).otherwise(1)) * 99 + group - 1
        mixed = permute(key, "ssn", left, serial - 1, F.lit(898 * 99), F.lit(9999))

        def text(m: Column) -> Column:
            place = F.floor(m["l"] / 99).cast("long")
            new_area = place + F.when(place >= 665, 2).otherwise(1)
            parts = [(new_area, 3), (m["l"] % 99 + 1, 2), (m["r"] + 1, 4)]
            return F.concat_ws("-", *[F.lpad(x.cast("string"), n, "0") for x, n in parts])

        return F.when(valid, _let(mixed, text))

    return _let(_digits(value), of)


def _mod97(text: Column) -> Column:
    """Letters count as 10 to 35."""
    return F.aggregate(
        F.split(text, ""),
        F.lit(0).cast("long"),
        lambda s, c: F.when(c.rlike("^[0-9]$"), (s * 10 + c.try_cast("long")) % 97).otherwise(
            (s * 100 + F.ascii(c) - 55) % 97
        ),
    )


def _iban(key: str, value: Column) -> Column:
    def of(v: Column) -> Column:
        body, country = F.substring(v, F.lit(5), F.length(v)), F.left(v, F.lit(2))
        valid = (_mod97(F.concat(body, F.left(v, F.lit(4)))) == 1) & (F.length(_digits(body)) >= 2)
        new_body = _fill(body, permute_digits(key, "iban", _digits(body)))
        check = lambda b: F.lpad((98 - _mod97(F.concat(b, country, F.lit("00")))).cast("string"), 2, "0")
        return F.when(
            valid, _let(new_body, lambda b: _fill(value, _digits(F.concat(check(b), b))))
        )

    return _let(F.replace(value, F.lit(" "), F.lit("")), of)


def _email(key: str, value: Column) -> Column:
    local, host = F.substring_index(value, "@", 1), F.substring_index(value, "@", -1)
    digest = F.substring(F.sha2(F.concat_ws("/", F.lit(key), F.lit("email"), F.lower(local), F.lower(host), F.lit(key)), 256), 1, 12)
    return F.concat(F.lit("p"), digest, F.lit("@"), host)


def _kind(value: Column) -> Column:
    return (
        F.when(value.contains("@"), "email")
        .when(value.rlike("^[A-Z]"), "iban")
        .when(value.rlike(r"^(?:[0-9]{1,3}\.){3}[0-9]{1,3}$"), "ipv4")
        .when(value.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), "iso_day")
        .when(value.rlike("^[0-9]{2}[./][0-9]{2}[./][0-9]{4}$"), "day")
        .when(value.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), "ssn")
        .when(value.rlike(r"^[+(]") | (F.length(_digits(value)) < 13), "phone")
        .otherwise("card")
    )


_BY_KIND = {
    "email": _email, "iban": _iban, "ipv4": _ipv4, "iso_day": _iso_day,
    "day": _written_day, "ssn": _ssn, "phone": _phone, "card": _card,
}


def pseudonym(key: str, value: Column) -> Column:
    """The pseudonym of a found value; null if it does not validate."""

    def of(x: Column) -> Column:
        out = F.lit(None).cast("string")
        for kind, f in _BY_KIND.items():
            out = F.when(x["k"] == kind, f(key, x["v"])).otherwise(out)
        return out

    return _let(F.struct(value.alias("v"), _kind(value).alias("k")), of)


def pseudonymise(
    docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: ``doc_id``, ``text`` with pseudonyms, ``n_found`` (validated values)
    and ``pseudonyms`` (list of kind and pseudonym, in order).

    A null text stays null with nothing found. Null ids and repeated rows are kept, an empty table
    gives an empty result. Equal values get equal pseudonyms under one ``key``.
    """
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))
    some = F.col("text").rlike(_SOME)
    found = rows.withColumn(
        "_found", F.when(some, F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0))).otherwise(F.array().cast("array<string>"))
    )
    new = found.withColumn(
        "_new",
        F.transform("_found", lambda v: F.struct(v.alias("old"), _kind(v).alias("kind"), pseudonym(key, v).alias("value"))),
    )
    texts = F.transform("_new", lambda x: F.coalesce(x["value"], x["old"]))
    joined = F.array_join(
        F.zip_with(F.split("text", PATTERN, -1), texts, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), ""
    )
    valid = F.filter("_new", lambda x: x["value"].isNotNull())
    return new.select(
        "doc_id",
        F.when(F.size("_found") > 0, joined).otherwise(F.col("text")).alias("text"),
        F.size(valid).cast("long").alias("n_found"),
        F.transform(valid, lambda x: F.struct(x["kind"].alias("kind"), x["value"].alias("value"))).alias("pseudonyms"),
    )
