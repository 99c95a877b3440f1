"""Format-preserving pseudonyms for personal numbers, dates and addresses (DataFrame functions only).

Card numbers and IBANs are looked for first, in every run of digits or capitals that can hold one:
each length that ends at a group border is tried from each group on, and what validates is added, as it
stands, to the one pattern that finds candidates in the whole text.  So a short number or a word beside
a number does not hide it.  Of overlapping cards those of the length of their issuer come first, of
overlapping IBANs those of the length of their country.  Each candidate is validated by its kind and,
if valid, replaced by a keyed permutation of itself within its format:

* card numbers (Luhn), IBANs (mod 97): all digits but the check digits go through a Feistel
  network, the check digits are computed anew;
* phone numbers: the ten national digits, the prefix stays;
* social security numbers, dotted addresses (each part at most 255), key=value secrets of any length and the
  local part of e-mail addresses;
* calendar dates from 1800 to 2199: the day number is permuted within these 146,097 days.

Equal values get equal pseudonyms in every document and in every spelling of the same kind, as
the network sees the digits without their separators; different values stay different.  The work
is one expression over one row: no shuffle, no state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cardpulse.llm.common import fresh, table

KEY = "pseudonym key of this corpus"   # give your own: equal keys link equal values
ROUNDS = 8
# Patterns of the candidates.
EMAIL = r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]++@[A-Za-z0-9\-]{1,63}(?:\.[A-Za-z0-9\-]{1,63}){1,8}"
KEY_CHAR = r"[A-Za-z0-9_\-./+~]"
# A key has no greatest length and ends in a letter or digit; one with marks among its first 12 characters has letters
# and digits, so that names in code are none.  What goes on to an e-mail address is none.
SECRET_VALUE = (r"(?:(?=[A-Za-z0-9]{12})|(?=" + KEY_CHAR + r"{12})(?=[A-Za-z_\-./+~]*+[0-9])(?=[0-9_\-./+~]*+[A-Za-z]))" + KEY_CHAR
                + r"*[A-Za-z0-9](?![A-Za-z0-9]|" + KEY_CHAR + r"*+@[A-Za-z0-9\-]{1,63}\.[A-Za-z0-9\-])")
SECRET_NAME = r"(?:token|password|passwd|secret|api_key|apikey)\s{0,3}[=:]\s{0,3}[\"']?"
SECRET = r"(?<![A-Za-z])" + SECRET_NAME + SECRET_VALUE
IBAN = r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
PHONE = r"(?<![0-9])(?:\+[0-9]{1,3}[ .\-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[.\-])[0-9]{3}[ .\-][0-9]{4}(?![0-9])"
ADDRESS = r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9])(?!\.[0-9])"
DATE = r"(?<![0-9./\-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4})(?![0-9])"
SSN = r"(?<![0-9\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9\-])"
CARD = r"(?<![0-9A-Za-z])[0-9](?:[ \-]?[0-9]){12,18}(?![0-9A-Za-z])"
NUMBER_END = "(?![A-Za-z0-9])"
# What can hold a card or an IBAN, with what stands around it.
CARD_RUN, IBAN_RUN = r"[0-9][0-9 \-]{11,}+[A-Za-z]?", r"[A-Z]{2}[0-9]{2}[A-Z0-9 ]{11,}+[a-z]?"
CARD_LENGTHS = range(13, 20)
# Digits that an issuer's numbers begin with and how many follow in all; cards of other issuers are taken in a usual layout.
ISSUERS = [(r"4|5[1-5]|222[1-9]|22[3-9]|2[3-6]|27[01]|2720|220[0-4]|35[2-8]|6011|64[4-9]|6[025]|50[689]|8[12]|9792", 16), (r"3[47]", 15), (r"30|3[689]", 14)]
LAYOUT = r"^[0-9]+$|^[0-9]{4}([ \-])[0-9]{4}\1[0-9]{4}\1[0-9]{1,4}(?:\1[0-9]{1,3})?$|^[0-9]{4}([ \-])[0-9]{6}\2[0-9]{4,5}$"
COUNTRIES = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "AO CV GW LY MZ PT ST",
    26: "DZ IR IS TR", 27: "BI CF CG CM DJ FR GA GQ GR IT KM MC MG MR SM TD", 28: "AL AZ BF BJ BY CI CY DO GT HN HU LB MA ML NE NI PL SN SV TG",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU"}
COUNTRY_IBAN = "(?:" + "|".join(
    f"(?:{names.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{(n - 4) // 4}}}" + (f" ?[A-Z0-9]{{{n % 4}}}" if n % 4 else "")
    for n, names in COUNTRIES.items()) + ")" + NUMBER_END
CANDIDATE = [EMAIL, SECRET, None, PHONE, ADDRESS, DATE, SSN, None]   # the places of the IBANs and cards of a text
FIRST_DAY, DAY_HALVES = "1800-01-01", (189, 773)   # 189 * 773 days are the 400 years from the first day


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _stream(key: str, tweak: Column, other: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), tweak, other), 512)


def _nibbles(stream: Column, j: Column | int, n: int) -> Column:
    at = (j - 1) * n + 1 if isinstance(j, Column) else F.lit((j - 1) * n + 1)
    return F.conv(F.substring(stream, at, F.lit(n)), 16, 10).cast("long")


def _let(x: Column, use) -> Column:
    """``use`` of ``x``, which is worked out once."""
    return F.get(F.transform(F.array(x), use), F.lit(0))


def _shift(x: Column, stream: Column) -> Column:
    """Every digit or letter of ``x`` moved within digits, small or capital letters; other characters stay."""
    def moved(c: Column, j: Column, k: Column) -> Column:
        a, n = F.ascii(c), _nibbles(k, (j % 64) + 1, 2)
        return (F.when(a.between(48, 57), F.char(F.lit(48) + (a - 48 + n) % 10)).when(a.between(97, 122), F.char(F.lit(97) + (a - 97 + n) % 26))
                .when(a.between(65, 90), F.char(F.lit(65) + (a - 65 + n) % 26)).otherwise(c))

    return F.when(F.length(x) == 0, x).otherwise(
        _let(stream, lambda k: F.array_join(F.transform(F.split(x, ""), lambda c, j: moved(c, j, k)), "")))


def permuted(x: Column, key: str, kind: str) -> Column:
    """A Feistel permutation of the strings of digits and letters of one shape: the halves take turns, each
    shifted, character by character within its alphabet, by a keyed hash of the other."""
    def halves(x: Column) -> Column:
        half = F.floor(F.length(x) / 2).cast("int")
        return F.struct(F.substring(x, F.lit(1), half).alias("a"), F.substring(x, half + 1, F.length(x)).alias("b"))

    def turn(s: Column, i: Column) -> Column:
        tweak = F.concat(F.lit(kind), i.cast("string"))
        return F.struct(
            F.when(i % 2 == 0, _shift(s["a"], _stream(key, tweak, s["b"]))).otherwise(s["a"]).alias("a"),
            F.when(i % 2 == 1, _shift(s["b"], _stream(key, tweak, s["a"]))).otherwise(s["b"]).alias("b"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), _let(x, halves), turn, lambda s: F.concat(s["a"], s["b"]))


def permuted_number(x: Column, key: str, kind: str, sizes: tuple[int, int]) -> Column:
    """A Feistel permutation of the numbers below sizes[0] * sizes[1]."""
    n, m = sizes
    start = F.struct(F.floor(x / m).cast("long").alias("a"), (x % m).cast("long").alias("b"))

    def turn(s: Column, i: Column) -> Column:
        tweak = F.concat(F.lit(kind), i.cast("string"))
        return F.struct(
            F.when(i % 2 == 0, (s["a"] + _nibbles(_stream(key, tweak, s["b"].cast("string")), 1, 12)) % n).otherwise(s["a"]).alias("a"),
            F.when(i % 2 == 1, (s["b"] + _nibbles(_stream(key, tweak, s["a"].cast("string")), 1, 12)) % m).otherwise(s["b"]).alias("b"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn, lambda s: s["a"] * m + s["b"])


def _luhn_sum(digits: Column, doubled_first: Column) -> Column:
    """Luhn sum of ``digits``; every second digit from the right is doubled, the last one if ``doubled_first``."""
    def total(digits: Column) -> Column:
        def add(total: Column, j: Column) -> Column:
            d = F.substring(digits, j, F.lit(1)).cast("int")
            twice = ((F.length(digits) - j) % 2 == 0) == doubled_first
            return total + F.when(twice, F.when(d > 4, d * 2 - 9).otherwise(d * 2)).otherwise(d)

        return F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(digits), F.lit(1))), F.lit(0), add)

    return _let(digits, total)


def _mod97(chars: Column) -> Column:
    """Remainder by 97 of a string of digits and capitals (A is 10)."""
    def remainder(chars: Column) -> Column:
        def add(r: Column, j: Column) -> Column:
            c = F.ascii(F.substring(chars, j, F.lit(1)))
            return F.when(c < 65, (r * 10 + c - 48) % 97).otherwise((r * 100 + c - 55) % 97)

        return F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(chars), F.lit(1))), F.lit(0), add)

    return _let(chars, remainder)


def _spelled(model: Column, chars: Column, is_char: str) -> Column:
    """``model`` with its characters of the class ``is_char`` replaced by those of ``chars`` in order."""
    other = "[^" + is_char[1:]

    def spelled(chars: Column) -> Column:
        def put(j: Column) -> Column:
            c = F.substring(model, j, F.lit(1))
            k = F.length(F.regexp_replace(F.substring(model, F.lit(1), j), other, ""))
            return F.when(c.rlike(is_char), F.substring(chars, k, F.lit(1))).otherwise(c)

        return F.array_join(F.transform(F.sequence(F.lit(1), F.length(model)), put), "")

    return _let(chars, spelled)


def _day(m: Column) -> Column:
    """The date that ``m`` spells, or null: year-month-day, month/day/year or, if that is none, day/month/year, day.month.year."""
    parts = F.split(m, r"[-/.]")
    part = [F.get(parts, F.lit(i)) for i in range(3)]

    def made(y: Column, mo: Column, d: Column) -> Column:
        return F.try_to_timestamp(F.concat_ws("-", F.lpad(y, 4, "0"), F.lpad(mo, 2, "0"), F.lpad(d, 2, "0")), F.lit("yyyy-MM-dd")).cast("date")

    return (F.when(m.contains("-"), made(part[0], part[1], part[2]))
            .when(m.contains("/"), F.coalesce(made(part[2], part[0], part[1]), made(part[2], part[1], part[0])))
            .otherwise(made(part[2], part[1], part[0])))


def _date_pseudonym(m: Column, key: str) -> Column:
    day = _day(m)
    moved = F.date_add(F.to_date(F.lit(FIRST_DAY)),
                       permuted_number(F.date_diff(day, F.to_date(F.lit(FIRST_DAY))), key, "date", DAY_HALVES).cast("int"))
    us = F.try_to_timestamp(F.concat_ws("-", F.get(F.split(m, "/"), F.lit(2)), F.lpad(F.get(F.split(m, "/"), F.lit(0)), 2, "0"),
                                        F.lpad(F.get(F.split(m, "/"), F.lit(1)), 2, "0")), F.lit("yyyy-MM-dd")).isNotNull()
    return (F.when(m.contains("-"), F.date_format(moved, "yyyy-MM-dd"))
            .when(m.contains("/") & us, F.date_format(moved, "MM/dd/yyyy"))
            .when(m.contains("/"), F.date_format(moved, "dd/MM/yyyy"))
            .otherwise(F.date_format(moved, "dd.MM.yyyy")))


def _octet(m: Column, i: int) -> Column:
    return F.get(F.split(m, r"\."), F.lit(i)).cast("long")


def _card_valid(m: Column) -> Column:
    return _let(_digits(m), lambda d: (F.length(d) >= 13) & (_luhn_sum(d, F.lit(False)) % 10 == 0))


def _iban_valid(m: Column) -> Column:
    return _let(F.regexp_replace(m, " ", ""), lambda bare: (F.length(bare) >= 15) & (
        _mod97(F.concat(F.substring(bare, F.lit(5), F.length(bare)), F.substring(bare, 1, 4))) == 1))


def _first_choice(first: Column, others: Column) -> Column:
    """The distinct strings of ``first``, then those of ``others`` that hold none of them; longer ones first."""
    def ordered(x: Column) -> Column:
        return F.transform(F.reverse(F.array_sort(F.transform(F.array_distinct(x), lambda v: F.struct(F.length(v).alias("n"), v.alias("v"))))),
                           lambda s: s["v"])

    return F.concat(ordered(first), ordered(F.filter(others, lambda o: ~F.exists(first, lambda f: o.contains(f)))))


def _all_in(runs: Column, pattern: str, group: int) -> Column:
    return F.flatten(F.transform(runs, lambda r: F.regexp_extract_all(r, F.lit(pattern), F.lit(group))))


def valid_cards(text: Column) -> Column:
    """The valid card numbers at group borders of ``text``, preferred ones first."""
    def spans(runs: Column) -> Column:
        lengths = [_all_in(runs, rf"(?<![0-9A-Za-z])(?=([0-9](?:[ \-]?[0-9]){{{n - 1}}}){NUMBER_END})", 1) for n in CARD_LENGTHS]
        return F.filter(F.array_distinct(F.concat(*lengths)), _card_valid)

    def issued(m: Column) -> Column:
        return _digits(m).rlike("^(?:" + "|".join(f"(?=[0-9]{{{n}}}$)(?:{start})" for start, n in ISSUERS) + ")")

    def chosen(runs: Column) -> Column:
        whole = F.filter(_all_in(runs, CARD, 0), _card_valid)
        return _let(spans(runs), lambda v: _let(F.filter(v, issued), lambda first: _first_choice(
            first, F.concat(F.filter(v, lambda m: m.rlike(LAYOUT) & ~issued(m)), whole))))

    return _let(F.regexp_extract_all(text, F.lit(CARD_RUN), F.lit(0)), lambda runs: F.when(F.size(runs) > 0, chosen(runs)))


def valid_ibans(text: Column) -> Column:
    """The valid IBANs of ``text``, those of their country's length first."""
    def chosen(runs: Column) -> Column:
        return _let(F.filter(_all_in(runs, f"(?=({COUNTRY_IBAN}))", 1), _iban_valid),
                    lambda first: _first_choice(first, F.filter(_all_in(runs, f"(?=({IBAN}))", 1), _iban_valid)))

    return _let(F.regexp_extract_all(text, F.lit(IBAN_RUN), F.lit(0)), lambda runs: F.when(F.size(runs) > 0, chosen(runs)))


def _alternatives(values: Column, depth: int = 3) -> Column:
    """A pattern of the strings ``values`` (no pattern characters, longer than ``depth``), tried in their order.
    Those that begin alike are grouped by their first, second and third character, so that at a place of
    the text a few characters are tried and not every string: strings of two groups never match at one place."""
    if depth == 0:
        return F.array_join(values, "|")
    heads = F.array_distinct(F.transform(values, lambda v: F.substring(v, F.lit(1), F.lit(1))))

    def group(head: Column) -> Column:
        rest = F.transform(F.filter(values, lambda v: F.startswith(v, head)), lambda v: F.substring(v, F.lit(2), F.length(v)))
        return F.concat(head, F.lit("(?:"), _let(rest, lambda r: _alternatives(r, depth - 1)), F.lit(")"))

    return F.array_join(F.transform(heads, group), "|")


def candidate_pattern(text: Column) -> Column:
    """The pattern of the candidates of ``text``; its numbers hold digits, capitals, blanks and hyphens only."""
    def listed(numbers: Column, before: str) -> Column:
        return _let(numbers, lambda v: F.when(F.size(v) > 0, F.concat(F.lit(before + "(?:"), _alternatives(v), F.lit(")" + NUMBER_END))))

    places = iter([listed(valid_ibans(text), "(?=[A-Z]{2}[0-9]{2})"), listed(valid_cards(text), "(?<![0-9A-Za-z])(?=[0-9])")])
    return F.concat_ws("|", *[next(places) if p is None else F.lit(p) for p in CANDIDATE])


def pseudonym(m: Column, key: str = KEY) -> Column:
    """struct(kind, value) for a candidate: its pseudonym, or kind null and the candidate itself if it is none."""
    digits = _digits(m)
    body = F.substring(digits, F.lit(1), F.length(digits) - 1)
    card = _let(permuted(body, key, "card"), lambda b: F.concat(b, ((10 - _luhn_sum(b, F.lit(True)) % 10) % 10).cast("string")))
    bare = F.regexp_replace(m, " ", "")
    bban = permuted(F.substring(bare, F.lit(5), F.length(bare)), key, "iban")
    country = F.substring(bare, 1, 2)
    iban = _let(bban, lambda b: F.concat(country, F.lpad((98 - _mod97(F.concat(b, country, F.lit("00")))).cast("string"), 2, "0"), b))
    national = F.substring(digits, F.length(digits) - 9, F.lit(10))
    phone = F.concat(F.substring(digits, F.lit(1), F.length(digits) - 10), permuted(national, key, "phone"))
    number = _octet(m, 0) * 16777216 + _octet(m, 1) * 65536 + _octet(m, 2) * 256 + _octet(m, 3)
    moved = permuted_number(number, key, "address", (65536, 65536))
    address = F.transform(F.array(moved), lambda v: F.concat_ws(".", *[F.floor(v / 256 ** i).cast("long") % 256 for i in (3, 2, 1, 0)]))[0]
    local = F.substring_index(m, "@", 1)
    bare_local = F.regexp_replace(local, "[^A-Za-z0-9]", "")
    email = F.concat(_spelled(local, permuted(bare_local, key, "email"), "[A-Za-z0-9]"), F.lit("@"), F.substring_index(m, "@", -1))
    value = F.regexp_extract(m, "^" + SECRET_NAME + "(.*)$", 1)
    secret = F.concat(F.substring(m, F.lit(1), F.length(m) - F.length(value)), permuted(value, key, "secret"))

    def is_(pattern: str) -> Column:
        return m.rlike("^(?:" + pattern + ")$")

    octets_valid = F.forall(F.split(m, r"\."), lambda o: o.cast("int") <= 255)
    n_digits = F.length(digits)

    def named(kind: str, value: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), value.alias("value"))

    return (F.when(is_(EMAIL), named("email", email))
            .when(is_(SECRET), named("secret", secret))
            .when(is_(IBAN) & _iban_valid(m), named("iban", _spelled(m, iban, "[A-Za-z0-9]")))
            .when(is_(PHONE) & (n_digits >= 10), named("phone", _spelled(m, phone, "[0-9]")))
            .when(is_(ADDRESS) & octets_valid, named("address", address))
            .when(is_(DATE) & _day(m).between(F.lit("1800-01-01").cast("date"), F.lit("2199-12-31").cast("date")),
                  named("date", _date_pseudonym(m, key)))
            .when(is_(SSN), named("ssn", _spelled(m, permuted(digits, key, "ssn"), "[0-9]")))
            .when(is_(CARD) & _card_valid(m), named("card", _spelled(m, card, "[0-9]")))
            .otherwise(F.struct(F.lit(None).cast("string").alias("kind"), m.alias("value"))))


def pseudonymise(docs: DataFrame, key: str = KEY, text_col: str = "text", found_col: str = "found") -> DataFrame:
    """``docs`` with ``text_col`` replaced by the text with pseudonyms, and ``found_col`` (with underscores added if
    ``docs`` has that column): array of (kind, value) in order of appearance, value being the pseudonym.

    Null and empty texts stay as they are with an empty array; candidates that do not validate stay;
    rows with null ids and repeated rows are treated like any other; other columns are kept as they are.
    """
    text, result = F.col(text_col), fresh(docs, found_col)
    pattern, candidates, each = (fresh(docs, c) for c in ("_pattern", "_candidates", "_each"))
    maybe = text.rlike(r"[0-9][ .\-]?[0-9]|@|[=:]")   # holds wherever one of the patterns does
    out = docs.withColumn(pattern, F.when(maybe, candidate_pattern(text)))
    out = out.withColumn(candidates, F.when(maybe, F.regexp_extract_all(text, F.col(pattern), F.lit(0))))
    out = out.withColumn(each, F.transform(candidates, lambda m: pseudonym(m, key)))
    pieces = F.split(text, F.col(pattern), -1)
    rebuilt = F.concat(F.array_join(F.zip_with(F.slice(pieces, F.lit(1), F.size(each)), F.col(each),
                                               lambda gap, f: F.concat(gap, f["value"])), ""), F.element_at(pieces, -1))
    empty = F.array().cast("array<struct<kind:string,value:string>>")
    found = F.coalesce(F.filter(each, lambda f: f["kind"].isNotNull()), empty)
    return (out.withColumn(result, found).withColumn(text_col, F.when(F.size(candidates) > 0, rebuilt).otherwise(text))
            .drop(pattern, candidates, each))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text, n_found, found): every document with its pseudonyms."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonymise(docs).select("doc_id", "text", F.size("found").cast("long").alias("n_found"), "found")
