"""Format-preserving pseudonyms for personal numbers and dates, by keyed Feistel permutations.

Found and, where they have rules, validated: e-mail addresses, secrets (after a word such as token: lower-case
hexadecimal of 12 characters or more, or 16 letters, digits, _ and - or more with a small letter and a digit; anywhere:
those with a known prefix), IPv4 addresses, bank account numbers (IBAN, modulo 97), card numbers (Luhn), social security numbers, telephone numbers, and dates from
1800 to 2199 (yyyy-mm-dd, dd.mm.yyyy, dd/mm/yyyy).  Each value is permuted within the values of its format: letters
stay letters, digits digits, separators where they are, check digits are made anew, dates stay real dates.  The
permutation depends on the key and the kind alone, and separators take no part, so equal values stay equal wherever and
however they are written, and different ones different.  What fails its validation is left as it is.

Only DataFrame functions are used: a text is cut at its matches, matches are replaced and the parts joined.  Rounds
are folded with aggregate().  Nulls stay null, texts without a match stay as they are, and all other columns of a
row stay; a column that has the name of the count is replaced.  Repeated rows each get a row.  An empty table gives
an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_DAY, _MONTH, _YEAR = "(?:0[1-9]|[12][0-9]|3[01])", "(?:0[1-9]|1[0-2])", "(?:1[89]|2[01])[0-9]{2}"

_PREFIX = "(?:AKIA|gh[opsu]_|sk-)"
_SECRET = r"(?:[0-9a-f]{12,}|(?=[A-Z0-9_-]*[a-z])(?=[A-Za-z_-]*[0-9])[A-Za-z0-9_-]{16,})"
_KNOWN = rf"{_PREFIX}[0-9A-Za-z]{{16,}}"

#: Kinds, tried in this order at each place of a text.
PATTERNS = {
    "email": r"[\p{L}\p{N}._%+-]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}",
    "secret": rf"(?<=(?i:token|secret|password|passwd|apikey|api_key|api-key)[ ]{{0,2}}[=:][ ]{{0,2}}[\"']?){_SECRET}(?![0-9A-Za-z])|(?<![0-9A-Za-z]){_KNOWN}(?![0-9A-Za-z])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": rf"(?<![0-9.]){_OCTET}(?:\.{_OCTET}){{3}}(?![0-9]|\.[0-9])",
    "date": rf"(?<![0-9])(?:{_YEAR}-{_MONTH}-{_DAY}|{_DAY}\.{_MONTH}\.{_YEAR}|{_DAY}/{_MONTH}/{_YEAR})(?![0-9])",
    "card": r"(?<![0-9+])(?:[0-9]{13,19}|[0-9]{4}(?:-[0-9]{4}){3}|[0-9]{4}(?: [0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"\+1[ .-]?\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])|\+[2-9](?:[ .()-]{0,2}[0-9]){7,14}(?![0-9])|(?<![0-9+])(?:\([2-9][0-9]{2}\) ?|[2-9][0-9]{2}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])",
}
ANY = "|".join(PATTERNS.values())
#: What a text with any match has: a digit, an @, or a word or prefix that stands before a secret.
MAYBE = "[0-9@]|(?i:token|secret|passw|api[_-]?key)|" + _PREFIX
_DIGITS, _HEX = "0123456789", "0123456789abcdef"
_LOWER, _UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Days of 400 years, 189 * 773, from the first day of the range.
_DAYS, _LEFT, _RIGHT, _FIRST = 146_097, 189, 773, "1800-01-01"


def _hash(*parts: Column) -> Column:
    """A number below 2 ** 60 that depends on all parts."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256), 1, 15), 16, 10).cast("long")


def _once(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value worked out once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _chars(value: Column, key: Column, alphabets: tuple[str, ...]) -> Column:
    """Permutes the characters of a string that are in an alphabet, each within its own.

    In each round the characters at even or at odd places move on by a hash of all at the others.
    """

    def shifted(ch: Column, at: Column, rest: Column, k: Column) -> Column:
        out = F.when(F.lit(False), ch)
        for letters in alphabets:
            place = (F.instr(F.lit(letters), ch) - 1 + _hash(key, k, at, rest)) % len(letters)
            out = out.when(F.instr(F.lit(letters), ch) > 0, F.lit(letters).substr((place + 1).cast("int"), F.lit(1)))
        return out.otherwise(ch)

    def one_round(text: Column, k: Column) -> Column:
        rest = F.array_join(F.filter(F.split(text, ""), lambda c, j: j % 2 != k % 2), "")
        return _once(rest, lambda r: F.array_join(F.transform(F.split(text, ""), lambda c, j: F.when(j % 2 == k % 2, shifted(c, j, r, k)).otherwise(c)), ""))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), value, one_round)


def _numbers(left: Column, right: Column, key: Column, sizes: tuple[int, int]) -> Column:
    """Permutes pairs of numbers below the two sizes."""
    start = F.struct(left.cast("long").alias("a"), right.cast("long").alias("b"))

    def one_round(pair: Column, k: Column) -> Column:
        a = F.when(k % 2 == 1, (pair["a"] + _hash(key, k, pair["b"])) % sizes[0]).otherwise(pair["a"])
        b = F.when(k % 2 == 0, (pair["b"] + _hash(key, k, pair["a"])) % sizes[1]).otherwise(pair["b"])
        return F.struct(a.alias("a"), b.alias("b"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, one_round)


def _refill(shape: Column, chars: Column) -> Column:
    """shape with its letters and digits replaced, in order, by those of chars."""
    plain = F.split(shape, "")
    count = lambda j: F.length(F.regexp_replace(shape.substr(F.lit(1), j + 1), "[^0-9A-Za-z]", ""))
    return F.array_join(F.transform(plain, lambda c, j: F.when(c.rlike("[0-9A-Za-z]"), chars.substr(count(j), F.lit(1))).otherwise(c)), "")


def _luhn(digits: Column) -> Column:
    """The Luhn sum of digits, modulo 10, the last not doubled."""
    each = F.transform(F.reverse(F.split(digits, "")), lambda c, j: F.when(j % 2 == 0, c.cast("int")).otherwise(F.element_at(F.array(*[F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), c.cast("int") + 1)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10


def _mod97(account: Column) -> Column:
    """An account number, its first four characters moved to the end and letters read as 10 to 35, modulo 97."""
    turned = F.concat(account.substr(F.lit(5), F.length(account)), account.substr(F.lit(1), F.lit(4)))
    value = lambda c: F.instr(F.lit(_DIGITS + _UPPER), c) - 1
    return F.aggregate(F.split(turned, ""), F.lit(0), lambda r, c: F.when(value(c) > 9, r * 100 + value(c)).otherwise(r * 10 + value(c)) % 97)


def _email(m: Column, key: Column) -> Column:
    return _once(F.substring_index(m, "@", 1), lambda own: F.concat(_chars(own, key, (_DIGITS, _LOWER, _UPPER)), F.lit("@"), F.substring_index(m, "@", -1)))


def _iban(m: Column, key: Column) -> Column:
    def valid(flat: Column) -> Column:
        body = _chars(flat.substr(F.lit(5), F.length(flat)), key, (_DIGITS, _UPPER))
        return _once(body, lambda b: _once(F.lpad((98 - _mod97(F.concat(flat.substr(F.lit(1), F.lit(2)), F.lit("00"), b))).cast("string"), 2, "0"), lambda c: _refill(m, F.concat(flat.substr(F.lit(1), F.lit(2)), c, b))))

    return _once(F.regexp_replace(m, " ", ""), lambda flat: F.when(_mod97(flat) == 1, valid(flat)).otherwise(m))


def _ip(m: Column, key: Column) -> Column:
    octet = lambda k: F.element_at(F.split(m, r"\."), k).cast("long")
    moved = _numbers(octet(1) * 256 + octet(2), octet(3) * 256 + octet(4), key, (1 << 16, 1 << 16))
    return _once(moved, lambda p: F.concat_ws(".", F.floor(p["a"] / 256).cast("string"), (p["a"] % 256).cast("string"), F.floor(p["b"] / 256).cast("string"), (p["b"] % 256).cast("string")))


def _date(m: Column, key: Column) -> Column:
    def moved(day: Column, style: str) -> Column:
        at = F.datediff(day, F.lit(_FIRST).cast("date"))
        pair = _numbers(F.floor(at / _RIGHT), at % _RIGHT, key, (_LEFT, _RIGHT))
        return _once(pair, lambda p: F.date_format(F.date_add(F.lit(_FIRST).cast("date"), (p["a"] * _RIGHT + p["b"]).cast("int")), style))

    def styled(style: str) -> Column:
        return _once(F.try_to_timestamp(m, F.lit(style)).cast("date"), lambda day: F.when(day.isNull(), m).otherwise(moved(day, style)))

    return F.when(F.instr(m, "-") > 0, styled("yyyy-MM-dd")).when(F.instr(m, ".") > 0, styled("dd.MM.yyyy")).otherwise(styled("dd/MM/yyyy"))


def _card(m: Column, key: Column) -> Column:
    def valid(flat: Column) -> Column:
        inner = _chars(flat.substr(F.lit(2), F.length(flat) - 2), key, (_DIGITS,))
        return _once(F.concat(flat.substr(F.lit(1), F.lit(1)), inner), lambda p: _refill(m, F.concat(p, ((10 - _luhn(F.concat(p, F.lit("0")))) % 10).cast("string"))))

    return _once(F.regexp_replace(m, "[ -]", ""), lambda flat: F.when(_luhn(flat) == 0, valid(flat)).otherwise(m))


def _ssn(m: Column, key: Column) -> Column:
    """Areas 001 to 899 but 666, groups 01 to 99, serials 0001 to 9999."""
    area, group, serial = (F.substring(m, a, n).cast("int") for a, n in ((1, 3), (5, 2), (8, 4)))
    ok = (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0)
    number = F.when(area > 666, area - 2).otherwise(area - 1)
    pair = _numbers(number * 99 + group - 1, serial - 1, key, (898 * 99, 9999))

    def written(p: Column) -> Column:
        a = F.floor(p["a"] / 99)
        a = F.when(a >= 665, a + 2).otherwise(a + 1)
        return F.concat_ws("-", F.lpad(a.cast("string"), 3, "0"), F.lpad((p["a"] % 99 + 1).cast("string"), 2, "0"), F.lpad((p["b"] + 1).cast("string"), 4, "0"))

    return F.when(ok, _once(pair, written)).otherwise(m)


def _phone(m: Column, key: Column) -> Column:
    """Keeps the country code (3 digits of it and what follows, but for 1) and the first digit of a national number;
    8 to 15 digits in all."""
    keep = F.when(m.startswith("+1"), 2).when(m.startswith("+"), 3).otherwise(1)

    def moved(digits: Column) -> Column:
        return _refill(m, F.concat(digits.substr(F.lit(1), keep), _chars(digits.substr(keep + 1, F.length(digits)), key, (_DIGITS,))))

    return _once(F.regexp_replace(m, "[^0-9]", ""), lambda digits: F.when(F.length(digits).between(8, 15), moved(digits)).otherwise(m))


def _secret(m: Column, key: Column) -> Column:
    """Hexadecimal stays that; of others a known prefix stays."""
    prefix = F.regexp_extract(m, f"^{_PREFIX}", 0)
    other = F.concat(prefix, _chars(m.substr(F.length(prefix) + 1, F.length(m)), key, (_DIGITS, _LOWER, _UPPER)))
    return F.when(m.rlike("^[0-9a-f]+$"), _chars(m, key, (_HEX,))).otherwise(other)


_MOVES = {"email": _email, "secret": _secret, "iban": _iban, "ip": _ip, "date": _date, "card": _card, "ssn": _ssn, "phone": _phone}


def pseudonym(match: Column, key: str) -> Column:
    """What stands for one match of ANY."""
    out = None
    for kind, move in _MOVES.items():
        # lookarounds see the match alone here; what they ask for was checked in the text
        inner = PATTERNS[kind] if kind != "secret" else f"{_SECRET}|{_KNOWN}"
        is_kind = match.rlike(f"^(?:{inner})$")
        if kind == "secret":
            is_kind &= ~match.rlike("^[0-9]{13,19}$")
        own = move(match, F.lit(f"{key}|{kind}"))
        out = F.when(is_kind, own) if out is None else out.when(is_kind, own)
    return out.otherwise(match)


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", count_col: str | None = "n_pseudonyms") -> DataFrame:
    """docs with pseudonyms in text_col, and, unless count_col is None, the number of values replaced in each row."""
    text = F.col(text_col)
    found = F.when(text.rlike(MAYBE), F.regexp_extract_all(text, F.lit(ANY), F.lit(0)))
    own, new = (_free(docs, name) for name in ("found", "moved"))
    out = docs.withColumn(own, found)
    out = out.withColumn(new, F.when(F.size(own) > 0, F.transform(own, lambda m: pseudonym(m, key))))
    parts = F.zip_with(F.split(text, ANY, -1), F.col(new), lambda gap, m: F.concat(gap, F.coalesce(m, F.lit(""))))
    joined = F.when(F.col(new).isNotNull(), F.array_join(parts, "")).otherwise(text)
    changed = F.coalesce(F.size(F.filter(F.zip_with(own, new, lambda a, b: a != b), lambda x: x)), F.lit(0))
    if count_col:
        out = out.withColumn(count_col, F.when(F.col(new).isNull(), 0).otherwise(changed))
    return out.withColumn(text_col, joined).drop(own, new)


def _free(docs: DataFrame, name: str) -> str:
    """A column name that docs does not have."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name
