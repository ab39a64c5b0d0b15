"""Checksum and structure checks as Spark columns (no Python per row).

Each check takes the matched text and returns a BOOLEAN column.  They gate
findings (a rule names its check) and audit identifier columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspan.functions.build import lit, literals
from veilspan.functions.arrays import let

Check = Callable[[Column], Column]


# ---- shared pieces -------------------------------------------------------


def digits_only(text: Column) -> Column:
    """ASCII digits of a text (SCL7)."""
    return F.regexp_replace(text, "[^0-9]", "")


def digit_array(digits: Column) -> Column:
    return F.transform(F.split(digits, ""), lambda c: c.try_cast("int"))


def _sum(values: Column) -> Column:
    return F.aggregate(values, lit(0), lambda a, b: a + b)


def weighted_sum(values: Column, weights: list[int]) -> Column:
    """Sum of the first len(weights) entries times their weights."""
    w = literals(weights, "int")
    head = F.slice(values, lit(1), lit(len(weights)))
    return _sum(F.zip_with(head, w, lambda a, b: a * b))


def weighted_mod(values: Column, weights: list[int], m: int) -> Column:
    """Weighted sum modulo m (SCL8)."""
    return weighted_sum(values, weights) % m


def mod97(numeric: Column) -> Column:
    """Remainder of a digit string by 97, digit by digit (SCL9)."""
    return F.aggregate(
        F.split(numeric, ""), lit(0), lambda acc, c: (acc * 10 + c.try_cast("int")) % 97
    )


def dual_pass_mod11(values: Column, first: list[int], second: list[int]) -> Column:
    """Second weights when the first remainder is 10, then 0 (SCL10)."""
    r1 = weighted_mod(values, first, 11)
    r2 = weighted_mod(values, second, 11)
    return F.when(r1 < 10, r1).when(r2 < 10, r2).otherwise(lit(0))


def letter_value(c: Column) -> Column:
    """0-9 as is, A-Z as 10..35."""
    return F.when(c.rlike("[0-9]"), c.try_cast("int")).otherwise(F.ascii(c) - 55)


def mrz_digit(text: Column) -> Column:
    """Travel-document check digit: weights 7,3,1, filler counts 0 (SCL11)."""
    values = F.transform(
        F.split(text, ""),
        lambda c, i: F.when(c == "<", lit(0)).otherwise(letter_value(c))
        * F.get(literals([7, 3, 1], "int"), i % 3),
    )
    return _sum(values) % 10


def expand_letters(text: Column) -> Column:
    """Each letter written as its two-digit value."""
    return F.array_join(
        F.transform(F.split(text, ""), lambda c: letter_value(c).cast("string")), ""
    )


def national_number(text: Column, cc: str) -> Column:
    """Digits without a leading country code and one trunk 0 (SCL12)."""
    return let(
        digits_only(text),
        lambda d: F.when(d.startswith(cc), F.regexp_replace(d, f"\\A{cc}0?", "")).otherwise(d),
    )


def coordinates(text: Column) -> Column:
    """Signed decimals found in a text (SCL13)."""
    tokens = F.regexp_extract_all(text, lit("[+-][0-9.]*|[0-9][0-9.]*"), lit(0))
    numbers = F.transform(
        F.filter(tokens, lambda t: t.rlike("[0-9]")), lambda t: t.try_cast("double")
    )
    return F.filter(numbers, lambda n: n.isNotNull())


def _upper_alnum(text: Column) -> Column:
    return F.upper(F.regexp_replace(text, "[^A-Za-z0-9]", ""))


def _on_digits(n: int, check: Callable[[Column], Column]) -> Check:
    """A check that needs exactly n digits; ``check`` gets them as an array."""

    def run(text: Column) -> Column:
        return let(
            digits_only(text),
            lambda d: F.when(F.length(d) == n, let(digit_array(d), check)).otherwise(False),
        )

    return run


def _number(digits: Column, start: int, n: int) -> Column:
    return F.substring(digits, start, n).try_cast("long")


# ---- checks --------------------------------------------------------------


def _luhn_digits(d: Column) -> Column:
    doubled = F.transform(
        F.reverse(digit_array(d)),
        lambda v, i: F.when(i % 2 == 0, v).when(v > 4, v * 2 - 9).otherwise(v * 2),
    )
    return (F.length(d) >= 2) & (_sum(doubled) % 10 == 0)


def luhn(text: Column) -> Column:
    return let(digits_only(text), _luhn_digits)


def _nhs(d: Column) -> Column:
    return let(
        11 - weighted_mod(d, [10, 9, 8, 7, 6, 5, 4, 3, 2], 11),
        lambda c: (c != 10) & (c % 11 == F.get(d, lit(9))),
    )


def npi_80840(text: Column) -> Column:
    return let(
        digits_only(text),
        lambda d: (F.length(d) == 10) & luhn(F.concat(lit("80840"), d)),
    )


def dea(text: Column) -> Column:
    letters = F.length(F.regexp_replace(text, "[^A-Za-z]", ""))
    seven = _on_digits(
        7, lambda d: weighted_mod(d, [1, 2, 1, 2, 1, 2], 10) == F.get(d, lit(6))
    )
    return (letters >= 2) & seven(text)


def iban_mod97(text: Column) -> Column:
    def body(raw: Column) -> Column:
        turned = F.concat(F.substr(raw, lit(5)), F.substring(raw, 1, 4))
        return F.when(
            raw.rlike("\\A[A-Z0-9]{5,34}\\z"), mod97(expand_letters(turned)) == 1
        ).otherwise(False)

    return let(F.upper(F.regexp_replace(text, "(?U)\\s", "")), body)


def mrz_td3(text: Column) -> Column:
    def line_two(z: Column) -> Column:
        def field(start: int, n: int) -> Column:
            return F.substring(z, start, n)

        def agrees(data: Column, at: int) -> Column:
            c = field(at, 1)
            given = F.when(c == "<", lit(0)).otherwise(c.try_cast("int"))
            return F.coalesce(mrz_digit(data) == given, lit(False))

        composite = F.concat(field(1, 10), field(14, 7), field(22, 22))
        return (
            agrees(field(1, 9), 10)
            & agrees(field(14, 6), 20)
            & agrees(field(22, 6), 28)
            & agrees(composite, 44)
        )

    return let(
        F.regexp_replace(text, "[^A-Z0-9<]", ""),
        lambda z: F.when(
            F.length(z) >= 88, let(F.substr(z, F.length(z) - 43), line_two)
        ).otherwise(False),
    )


def _pesel(d: Column) -> Column:
    s = weighted_mod(d, [1, 3, 7, 9, 1, 3, 7, 9, 1, 3], 10)
    return (10 - s) % 10 == F.get(d, lit(10))


def _bsn(d: Column) -> Column:
    return weighted_sum(d, [9, 8, 7, 6, 5, 4, 3, 2, -1]) % 11 == 0


def belgium_rrn(text: Column) -> Column:
    def body(d: Column) -> Column:
        base, given = _number(d, 1, 9), _number(d, 10, 2)
        ok = (97 - base % 97 == given) | (97 - (base + 2_000_000_000) % 97 == given)
        return F.when(F.length(d) == 11, ok).otherwise(False)

    return let(digits_only(text), body)


def france_nir(text: Column) -> Column:
    return let(
        digits_only(text),
        lambda d: F.when(
            F.length(d) == 15, 97 - _number(d, 1, 13) % 97 == _number(d, 14, 2)
        ).otherwise(False),
    )


def spain_dni(text: Column) -> Column:
    shape = "([XYZxyz]?)([0-9]+)([A-Za-z])[^A-Za-z]*\\z"

    def body(parts: Column) -> Column:
        prefix, digits = F.get(parts, lit(0)), F.get(parts, lit(1))
        number = F.concat(F.translate(F.upper(prefix), "XYZ", "012"), digits).try_cast("long")
        letter = F.substr(
            lit("TRWAGMYFPDXBNJZSQVHLCKE"), (number % 23).cast("int") + 1, lit(1)
        )
        return F.when(
            F.length(digits).between(7, 8), letter == F.upper(F.get(parts, lit(2)))
        ).otherwise(False)

    return let(F.array(*[F.regexp_extract(text, shape, i) for i in (1, 2, 3)]), body)


_REPEATED = "\\A(.)\\1*\\z"


def brazil_cpf(text: Column) -> Column:
    def check(d: Column) -> Column:
        def digit(n: int) -> Column:
            return (weighted_sum(d, list(range(n + 1, 1, -1))) * 10) % 11 % 10

        return (digit(9) == F.get(d, lit(9))) & (digit(10) == F.get(d, lit(10)))

    return ~digits_only(text).rlike(_REPEATED) & _on_digits(11, check)(text)


def brazil_cnpj(text: Column) -> Column:
    def check(body: Column) -> Column:
        values = F.transform(F.split(body, ""), lambda c: F.ascii(c) - 48)

        def digit(v: Column, weights: list[int]) -> Column:
            return let(
                weighted_mod(v, weights, 11), lambda r: F.when(r < 2, lit(0)).otherwise(11 - r)
            )

        def both(v: Column) -> Column:
            first = digit(v, [5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2])
            second = digit(
                F.concat(F.slice(v, 1, 12), F.array(first)),
                [6, 5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2],
            )
            return (first == F.get(v, lit(12))) & (second == F.get(v, lit(13)))

        return F.when(
            body.rlike("\\A[A-Z0-9]{12}[0-9]{2}\\z") & ~body.rlike(_REPEATED),
            let(values, both),
        ).otherwise(False)

    return let(_upper_alnum(text), check)


def _estonia(d: Column) -> Column:
    first, second = [1, 2, 3, 4, 5, 6, 7, 8, 9, 1], [3, 4, 5, 6, 7, 8, 9, 1, 2, 3]
    return dual_pass_mod11(d, first, second) == F.get(d, lit(10))


def czech_rc(text: Column) -> Column:
    def body(d: Column) -> Column:
        month, day = _number(d, 3, 2), _number(d, 5, 2)
        plain = (
            F.when(month.between(51, 62), month - 50)
            .when(month.between(71, 82), month - 70)
            .when(month.between(21, 32), month - 20)
            .otherwise(month)
        )
        dated = plain.between(1, 12) & day.between(1, 31)
        divisible = _number(d, 1, 10) % 11 == 0
        old_form = (_number(d, 1, 9) % 11 == 10) & (_number(d, 10, 1) == 0)
        return F.when(F.length(d) == 10, dated & (divisible | old_form)).otherwise(False)

    return let(digits_only(text), body)


def _romania(d: Column) -> Column:
    r = weighted_mod(d, [2, 7, 9, 1, 4, 6, 3, 5, 8, 2, 7, 9], 11)
    return F.when(r == 10, lit(1)).otherwise(r) == F.get(d, lit(12))


def china_rid(text: Column) -> Column:
    def body(c: Column) -> Column:
        r = weighted_mod(
            digit_array(c), [7, 9, 10, 5, 8, 4, 2, 1, 6, 3, 7, 9, 10, 5, 8, 4, 2], 11
        )
        expected = F.substr(lit("10X98765432"), r + 1, lit(1))
        return F.when(
            c.rlike("\\A[0-9]{17}[0-9Xx]\\z"), expected == F.upper(F.substring(c, 18, 1))
        ).otherwise(False)

    return let(F.regexp_replace(text, "[^0-9Xx]", ""), body)


def _turkey(d: Column) -> Column:
    odd = weighted_sum(d, [1, 0, 1, 0, 1, 0, 1, 0, 1])
    even = weighted_sum(d, [0, 1, 0, 1, 0, 1, 0, 1])
    tenth = (odd * 7 + 100 - even) % 10
    last = weighted_mod(d, [1] * 10, 10)
    return (
        (F.get(d, lit(0)) != 0)
        & (tenth == F.get(d, lit(9)))
        & (last == F.get(d, lit(10)))
    )


def israel_id(text: Column) -> Column:
    def body(d: Column) -> Column:
        folded = F.transform(
            digit_array(F.lpad(d, 9, "0")),
            lambda v, i: F.when(i % 2 == 0, v).when(v > 4, v * 2 - 9).otherwise(v * 2),
        )
        return F.when(F.length(d).between(1, 9), _sum(folded) % 10 == 0).otherwise(False)

    return let(digits_only(text), body)


def us_ssn(text: Column) -> Column:
    return digits_only(text).rlike("\\A(?!000|666|9)[0-9]{3}(?!00)[0-9]{2}(?!0000)[0-9]{4}\\z")


# Assigned country calling codes (as ranges) and the special
# service codes that are never a personal number.
CALLING_CODES = """
1 7 20 27 30-34 36 39-41 43-49 51-58 60-66 81-82 84 86 90-95 98 211-213 216 218
220-258 260-269 290-291 297-299 350-359 370-383 385-387 389 420-421 423 500-509
590-599 670 672-683 685-692 850 852-853 855-856 880 886 960-968 970-977 992-996
998
"""
SERVICE_CODES = "800 808 870 878 879 881 882 883 888 979"


def _calling_codes() -> list[str]:
    codes: list[str] = []
    for part in CALLING_CODES.split():
        low, _, high = part.partition("-")
        codes += [str(n) for n in range(int(low), int(high or low) + 1)]
    return codes


def e164(text: Column) -> Column:
    known = "\\A(?:" + "|".join(_calling_codes()) + ")"
    special = "\\A(?:" + "|".join(SERVICE_CODES.split()) + ")"

    def body(d: Column) -> Column:
        run = F.contains(lit("0123456789"), d) | F.contains(lit("9876543210"), d)
        return (
            F.length(d).between(8, 15)
            & ~d.rlike(_REPEATED)
            & ~run
            & ~d.rlike(special)
            & d.rlike(known)
        )

    return let(digits_only(text), body)


def vin_na(text: Column) -> Column:
    def body(vin: Column) -> Column:
        u = F.upper(vin)
        values = digit_array(
            F.translate(u, "ABCDEFGHJKLMNPRSTUVWXYZ", "12345678123457923456789")
        )
        r = weighted_mod(values, [8, 7, 6, 5, 4, 3, 2, 10, 0, 9, 8, 7, 6, 5, 4, 3, 2], 11)
        check = F.when(r == 10, lit("X")).otherwise(r.cast("string"))
        return F.when(
            u.rlike("\\A[A-HJ-NPR-Z0-9]{17}\\z") & ~vin.rlike(_REPEATED),
            F.substring(u, 9, 1) == check,
        ).otherwise(False)

    return let(
        F.regexp_replace(text, "[^A-Za-z0-9]", ""),
        lambda a: F.when(
            F.length(a) >= 17, let(F.substr(a, F.length(a) - 16), body)
        ).otherwise(False),
    )


def _imo(d: Column) -> Column:
    return weighted_mod(d, [7, 6, 5, 4, 3, 2], 10) == F.get(d, lit(6))


def iso6346(text: Column) -> Column:
    def body(c: Column) -> Column:
        def value(ch: Column) -> Column:
            k = F.ascii(ch) - 65  # letter values skip the multiples of 11
            return F.when(ch.rlike("[0-9]"), ch.try_cast("int")).otherwise(
                k + 10 + F.floor((k + 9) / 10).cast("int")
            )

        r = weighted_mod(F.transform(F.split(c, ""), value), [1 << i for i in range(10)], 11)
        return F.when(
            c.rlike("\\A[A-Z0-9]{10}[0-9]\\z"),
            r % 10 == F.substring(c, 11, 1).try_cast("int"),
        ).otherwise(False)

    return let(_upper_alnum(text), body)


def _s10(d: Column) -> Column:
    c = 11 - weighted_mod(d, [8, 6, 4, 2, 3, 5, 9, 7], 11)
    check = F.when(c == 10, lit(0)).when(c == 11, lit(5)).otherwise(c)
    return check == F.get(d, lit(8))


def geo_coord(text: Column) -> Column:
    def body(n: Column) -> Column:
        a, b = F.abs(F.get(n, lit(0))), F.abs(F.get(n, lit(1)))
        ranged = ((a <= 90) & (b <= 180)) | ((b <= 90) & (a <= 180))
        return F.when(F.size(n) >= 2, ranged).otherwise(False)

    return let(coordinates(text), body)


def orcid(text: Column) -> Column:
    def body(c: Column) -> Column:
        total = F.aggregate(
            digit_array(F.substring(c, 1, 15)), lit(0), lambda acc, v: (acc + v) * 2 % 11
        )
        r = (12 - total) % 11
        check = F.when(r == 10, lit("X")).otherwise(r.cast("string"))
        return F.when(
            c.rlike("\\A[0-9]{15}[0-9Xx]\\z"), F.upper(F.substring(c, 16, 1)) == check
        ).otherwise(False)

    return let(F.regexp_replace(text, "[^0-9Xx]", ""), body)


def isin(text: Column) -> Column:
    return let(
        _upper_alnum(text),
        lambda c: F.when(F.length(c) == 12, luhn(expand_letters(c))).otherwise(False),
    )


def phone_us(text: Column) -> Column:
    return digits_only(text).rlike("\\A1?[2-9][0-9]{2}[2-9][0-9]{6}\\z")


def _phone(cc: str, national: str) -> Check:
    return lambda text: national_number(text, cc).rlike(f"\\A(?:{national})\\z")


def phone_it(text: Column) -> Column:
    return digits_only(text).rlike("\\A39[0-9]{9,11}\\z")


VALIDATORS: dict[str, Check] = {
    "luhn": luhn,
    "nhs_mod11": _on_digits(10, _nhs),
    "npi_80840": npi_80840,
    "dea": dea,
    "iban_mod97": iban_mod97,
    "mrz_td3": mrz_td3,
    "pesel": _on_digits(11, _pesel),
    "bsn_11proef": _on_digits(9, _bsn),
    "belgium_rrn": belgium_rrn,
    "france_nir": france_nir,
    "spain_dni": spain_dni,
    "brazil_cpf": brazil_cpf,
    "brazil_cnpj": brazil_cnpj,
    "estonia_isikukood": _on_digits(11, _estonia),
    "czech_rc": czech_rc,
    "romania_cnp": _on_digits(13, _romania),
    "china_rid": china_rid,
    "turkey_tckn": _on_digits(11, _turkey),
    "israel_id": israel_id,
    "us_ssn": us_ssn,
    "e164": e164,
    "phone_us": phone_us,
    "phone_uk": _phone("44", "[1-9][0-9]{8,9}"),
    "phone_it": phone_it,
    "phone_fr": _phone("33", "[1-9][0-9]{8}"),
    "phone_de": _phone("49", "[1-9][0-9]{5,10}"),
    "phone_es": _phone("34", "[6-9][0-9]{8}"),
    "phone_br": _phone("55", "[1-9][0-9]{9}|[1-9][0-9]9[0-9]{8}"),
    "phone_in": _phone("91", "[6-9][0-9]{9}"),
    "vin_na": vin_na,
    "imo_number": _on_digits(7, _imo),
    "iso6346": iso6346,
    "usps_s10": _on_digits(9, _s10),
    "geo_coord": geo_coord,
    "orcid": orcid,
    "isin": isin,
}


def register_validator(name: str, check: Check) -> None:
    """Add a user's own check; rules refer to it by name (UDF3)."""
    VALIDATORS[name] = check


def validate_ids(df: DataFrame, col: str, kind: str, out: str = "valid") -> DataFrame:
    """Add a BOOLEAN column: does ``col`` pass the named check."""
    return df.withColumn(out, F.coalesce(VALIDATORS[kind](F.col(col)), lit(False)))


def id_quality_report(df: DataFrame, cols: dict[str, str]) -> DataFrame:
    """Count of valid and invalid values per column and check, in one pass."""
    pairs = F.array(
        *[
            F.struct(
                lit(c).alias("column"),
                lit(kind).alias("kind"),
                F.when(F.col(c).isNotNull(), F.coalesce(VALIDATORS[kind](F.col(c)), lit(False)))
                .alias("valid"),
            )
            for c, kind in cols.items()
        ]
    )
    return (
        df.select(F.inline(pairs))
        .filter("valid is not null")
        .groupBy("column", "kind", "valid")
        .agg(F.count("*").alias("n"))
    )
