"""Format-preserving pseudonyms for personal numbers and dates (operator 7, DataFrame functions only).

One pattern finds candidates in a text, which is taken apart into matches and the gaps between
them. A match that its kind's rule confirms is permuted by a keyed Feistel network within its
format, so equal values get equal pseudonyms in all documents and written forms:

- payment cards (13 to 19 digits, Luhn sum valid): the digits before the check digit are permuted
  and the check digit is computed anew;
- IBANs (mod 97 valid): the digits of the account part are permuted, the check digits made anew;
  (in capitals, or in small letters without blanks);
- telephone numbers: all digits but the country calling code; US social security numbers with valid parts:
  within the valid ones; IPv4 addresses: within 32 bits (what
  follows the word version or release, or a v, is none); calendar dates from 1900 to 2099, as
  year-month-day or day/month/year (month/day/year where that alone is a date) or with points:
  within those 200 years.

Domains that are no power of ten are walked through until the value is in the domain. E-mail
addresses, access keys and the values of password, token, secret and key assignments have no number
to permute, nor have bearer tokens: they are replaced by keyed digests of their kind, e-mail
addresses and assigned values by those of their small letters. An assigned value of 8 or more characters always goes, even if it looks
like a number that its rule does not confirm. What else no rule confirms stays as it is.

Round function: the leading 60 bits of SHA-256 over key, kind, round and the other half. Ten rounds.
A null text stays null and has no replacements; an empty text stays empty. All columns of the input
are kept, but for those named like an added one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROUNDS = 10
#: How often a value that fell outside its domain is permuted again; a miss has a chance under 1e-30.
WALKS = 64
EMAIL = r"(?<![\p{L}0-9._%+\-])[\p{L}0-9][\p{L}0-9._%+\-]{0,63}@(?:[A-Za-z0-9][A-Za-z0-9\-]{0,62}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9])"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
SMALL_IBAN = r"(?<![A-Za-z0-9])[a-z]{2}\d{2}[a-z0-9]{11,30}(?![A-Za-z0-9])"
ACCESS = r"(?<![A-Za-z0-9])(?:AKIA[A-Z0-9]{16}|gh[opsu]_[A-Za-z0-9]{36})(?![A-Za-z0-9])"
SECRET = r"(?<=[=:\"'\s])(?=[^\s\"'<>,;]{8})(?<=(?i:token|password|passwd|pwd|secret(?:[_\-](?:access[_\-])?key)?|(?:api|access|private|auth)[_\-]?key)[\"']?\s{0,3}[=:]\s{0,3}[\"']?|(?i:bearer)\s{1,3}(?=[^\s\"'<>,;]{16})(?=[^\s\"'<>,;]{0,200}\d))[A-Za-z0-9+/_\-][^\s\"'<>,;]*[A-Za-z0-9+/_\-=]"
IPV4 = r"(?<![\d.])(?<!(?i:version|release)[ :=]{0,2}|\b[vV]\.?)(?:\d{1,3}\.){3}\d{1,3}(?!\.?\d)"
ISO_DATE = r"(?<![\d\-])\d{4}-\d{2}-\d{2}(?![\d\-])"
DAY_DATE = r"(?<![\d/.])\d{1,2}(?:/\d{1,2}/|\.\d{1,2}\.)\d{4}(?!\d)"
SSN = r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])"
PHONE = r"(?<![\d+])\+\d{1,3}[ .\-]?\(?\d{2,4}\)?[ .\-]?\d{3}[ .\-]?\d{4}(?!\d)|(?<![\d+])\+(?=(?:[ .\-()]{0,2}\d){8})[1-9]\d{0,2}(?:[ .\-]\(?\d{1,10}\)?){2,6}(?!\d)|(?<!\d)\(\d{3}\)[ .\-]?\d{3}[ .\-]\d{4}(?!\d)|(?<![\d.\-])\d{3}[.\-]\d{3}[.\-]\d{4}(?![\d.\-])"
CARD = r"(?<![\d.\-])(?:\d{13,19}|\d{4}(?:[ \-]\d{4}){3}|\d{4}[ \-]\d{6}[ \-]\d{5})(?!\d)"
KINDS = {"email": EMAIL, "iban": IBAN, "access": ACCESS, "secret": SECRET, "small_iban": SMALL_IBAN, "ipv4": IPV4, "iso_date": ISO_DATE, "day_date": DAY_DATE, "ssn": SSN, "phone": PHONE, "card": CARD}
#: The only group is that of assigned secrets, which may look like anything else.
ANY = "|".join(f"({pattern})" if kind == "secret" else pattern for kind, pattern in KINDS.items())
#: The country calling codes of one and two digits; all others have three.
CALLING_CODE = r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
FIRST_DAY, DAYS = "1900-01-01", 73049


def _prf(key: str, kind: str, turn, half):
    said = F.concat_ws("|", F.lit(key), F.lit(kind), turn.cast("string"), half.cast("string"))
    return F.conv(F.substring(F.sha2(said, 256), 1, 15), 16, 10).cast("long")


def _rounds(key: str, kind: str, a, b, size_a, size_b):
    """(a, b) after an even number of rounds; a stays under size_a, and b under size_b."""

    def turn(s, i):
        size = F.when(i % 2 == 1, size_a).otherwise(size_b)
        return F.struct(s["b"].alias("a"), F.pmod(s["a"] + _prf(key, kind, i, s["b"]) % size, size).alias("b"))

    start = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn)


def permute_digits(key: str, kind: str, digits):
    """A permutation of the digit strings of each length from 2 to 30; shorter ones stay."""
    n = F.length(digits)
    u = F.floor(n / 2).cast("int")
    v = n - u
    ten = lambda m: F.rpad(F.lit("1"), m + 1, "0").cast("long")
    out = _rounds(key, kind, F.substring(digits, F.lit(1), u).cast("long"), F.substring(digits, u + 1, v).cast("long"), ten(u), ten(v))
    joined = F.transform(F.array(out), lambda s: F.concat(F.lpad(s["a"].cast("string"), u, "0"), F.lpad(s["b"].cast("string"), v, "0")))[0]
    return F.when(n >= 2, joined).otherwise(digits)


def permute_below(key: str, kind: str, value, size: int, digits: int):
    """A permutation of the numbers under `size`, by walking that of all `digits`-digit numbers."""

    def once(x):
        return permute_digits(key, kind, F.lpad(x.cast("string"), digits, "0")).cast("long")

    def step(s, _):
        return F.when((s["n"] > 0) & (s["x"] < size), s).otherwise(F.struct((s["n"] + 1).alias("n"), once(s["x"]).alias("x")))

    start = F.struct(F.lit(0).alias("n"), value.cast("long").alias("x"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(WALKS)), start, step)["x"]


def digits_of(text):
    return F.regexp_replace(text, "[^0-9]", "")


def refill(form, digits):
    """`form` with its digits replaced in order."""
    place = lambda i: F.length(F.regexp_replace(F.substring(form, F.lit(1), i), "[^0-9]", ""))
    letter = lambda i: F.substring(form, i, F.lit(1))
    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(form)), lambda i: F.when(letter(i).rlike("[0-9]"), F.substring(digits, place(i), F.lit(1))).otherwise(letter(i))), "")


def luhn_sum(digits):
    """The sum whose last digit is 0 for a valid number."""
    reverse = F.transform(F.split(F.reverse(digits), ""), lambda d: d.cast("int"))
    doubled = F.transform(reverse, lambda d, i: F.when(i % 2 == 1, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d)


def mod_97(letters):
    """The remainder of a text in which letters count from 10."""

    def step(r, c):
        value = F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
        return (r * F.when(value > 9, 100).otherwise(10) + value) % 97

    return F.aggregate(F.split(letters, ""), F.lit(0), lambda r, c: step(r, F.when(c.rlike("[0-9A-Z]"), c).otherwise("0")))


def _card(key: str, m):
    digits = digits_of(m)
    body = permute_digits(key, "card", F.substring(digits, F.lit(1), F.length(digits) - 1))
    full = F.transform(F.array(body), lambda b: F.concat(b, ((10 - luhn_sum(F.concat(b, F.lit("0"))) % 10) % 10).cast("string")))[0]
    return F.when(luhn_sum(digits) % 10 == 0, refill(m, full)).otherwise(m)


def _iban(key: str, m):
    plain = F.upper(F.regexp_replace(m, " ", ""))
    country, account = F.substring(plain, 1, 2), F.substring(plain, F.lit(5), F.length(plain) - 4)
    valid = (mod_97(F.concat(account, country, F.substring(plain, 3, 2))) == 1) & F.length(plain).between(15, 34)
    made = refill(account, permute_digits(key, "iban", digits_of(account)))
    fixed = F.transform(F.array(made), lambda a: F.concat(F.lpad((98 - mod_97(F.concat(a, country, F.lit("00")))).cast("string"), 2, "0"), F.regexp_replace(a, "[^0-9]", "")))[0]
    return F.when(valid, refill(m, fixed)).otherwise(m)


def _access(key: str, m):
    """The first four characters, and as much of the digest as there were others."""
    digest = F.substring(_digest(key, "access", m), F.lit(1), F.length(m) - 4)
    return F.concat(F.substring(m, 1, 4), F.when(F.startswith(m, F.lit("AKIA")), F.upper(digest)).otherwise(digest))


def _ipv4(key: str, m):
    parts = F.transform(F.split(m, r"\."), lambda p: p.cast("long"))
    out = _rounds(key, "ipv4", parts[0] * 256 + parts[1], parts[2] * 256 + parts[3], F.lit(65536), F.lit(65536))
    text = F.transform(F.array(out), lambda s: F.concat_ws(".", *[F.floor(s[h] / 256).cast("string") if top else (s[h] % 256).cast("string") for h in "ab" for top in (1, 0)]))[0]
    return F.when(F.forall(parts, lambda p: p < 256), text).otherwise(m)


def _moved(key: str, day):
    """Another day of the same 200 years."""
    first = F.lit(FIRST_DAY).cast("date")
    return F.date_add(first, permute_below(key, "date", F.datediff(day, first), DAYS, 5).cast("int"))


def _in_range(day):
    return day.between(F.lit(FIRST_DAY).cast("date"), F.date_add(F.lit(FIRST_DAY).cast("date"), DAYS - 1))


def _iso_date(key: str, m):
    day = F.try_to_date(m, "yyyy-MM-dd")
    return F.when(_in_range(day), F.date_format(_moved(key, day), "yyyy-MM-dd")).otherwise(m)


def _day_date(key: str, m):
    sign = F.when(F.contains(m, F.lit("/")), F.lit("/")).otherwise(F.lit("."))
    p = F.split(m, "[/.]")
    made = lambda d, mo: F.try_to_date(F.concat_ws("-", p[2], F.lpad(mo, 2, "0"), F.lpad(d, 2, "0")), "yyyy-MM-dd")
    first, second = made(p[0], p[1]), made(p[1], p[0])
    show = lambda day, a, b: F.transform(F.array(_moved(key, day)), lambda x: F.concat(F.date_format(x, a), sign, F.date_format(x, b), sign, F.date_format(x, "yyyy")))[0]
    return F.when(_in_range(first), show(first, "dd", "MM")).when(_in_range(second), show(second, "MM", "dd")).otherwise(m)


def _ssn(key: str, m):
    """Area 001 to 899 but 666, group 01 to 99, serial 0001 to 9999, numbered through."""
    p = F.transform(F.split(m, "-"), lambda x: x.cast("long"))
    valid = (p[0].between(1, 899)) & (p[0] != 666) & (p[1] > 0) & (p[2] > 0)
    area = F.when(p[0] > 666, p[0] - 2).otherwise(p[0] - 1)
    new = permute_below(key, "ssn", (area * 99 + p[1] - 1) * 9999 + p[2] - 1, 898 * 99 * 9999, 9)
    back = lambda x: F.format_string("%03d-%02d-%04d", F.floor(x / (99 * 9999)) + F.when(F.floor(x / (99 * 9999)) >= 665, 2).otherwise(1), F.floor(x / 9999) % 99 + 1, x % 9999 + 1)
    return F.when(valid, F.transform(F.array(new), back)[0]).otherwise(m)


def _phone(key: str, m):
    code = F.regexp_extract(m, CALLING_CODE, 0)
    rest = F.substring(m, F.length(code) + 1, F.length(m))
    return F.concat(code, refill(rest, permute_digits(key, "phone", digits_of(rest))))


def _digest(key: str, kind: str, m):
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), m), 256)


def _secret(key: str, m):
    return F.substring(F.repeat(_digest(key, "secret", F.lower(m)), F.ceil(F.length(m) / 64).cast("int")), F.lit(1), F.length(m))


def _pseudonym(key: str, m, secret):
    """Of a match and what of it is an assigned secret: all of it or nothing."""
    full = lambda pattern: m.rlike(f"^(?:{pattern})$")
    return (
        F.when(secret != "", _secret(key, m))
        .when(F.contains(m, F.lit("@")), F.concat(F.substring(_digest(key, "email", F.lower(m)), 1, 12), F.lit("@mail.invalid")))
        .when(full(IPV4), _ipv4(key, m))
        .when(full(ISO_DATE), _iso_date(key, m))
        .when(full(DAY_DATE), _day_date(key, m))
        .when(full(SSN), _ssn(key, m))
        .when(full(PHONE), _phone(key, m))
        .when(full(CARD), _card(key, m))
        .when(full(ACCESS), _access(key, m))
        .when(full(f"{IBAN}|{SMALL_IBAN}"), _iban(key, m))
        .otherwise(m)
    )


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """Replaces `text`, and adds n_replaced: the matches that were changed."""
    kept = [c for c in docs.columns if c.lower() not in ("text", "n_replaced")]
    text = F.col("text").cast("string")
    # a text without a digit or an @ holds nothing to replace but a secret, which may have letters alone
    found = F.when(text.rlike("[0-9@]|(?i:token|passw|pwd|secret|(?:api|access|private|auth)[_-]?key|bearer)"), F.regexp_extract_all(text, F.lit(ANY), F.lit(0)))
    taken = docs.select(*kept, text.alias("_t"), found.alias("_m"))
    # a text with matches is searched once more, for which of them are secrets, and once for what is between them;
    # the lists are arguments of the functions that walk them, so they are made once a text and not once a match
    listed = taken.withColumn("_x", F.when(F.size("_m") > 0, F.arrays_zip("_m", F.regexp_extract_all("_t", F.lit(ANY), F.lit(1)).alias("_s"))))
    made = listed.withColumn("_p", F.transform("_x", lambda x: _pseudonym(key, x["_m"], x["_s"])))
    parts = F.zip_with(F.split("_t", ANY, -1), "_p", lambda gap, p: F.concat(gap, F.coalesce(p, F.lit(""))))
    changed = F.when(F.size("_m") > 0, F.array_join(parts, "")).otherwise(F.col("_t"))
    count = F.coalesce(F.size(F.filter(F.zip_with("_m", "_p", lambda m, p: m != p), lambda x: x)), F.lit(0))
    return made.select(*kept, changed.alias("text"), F.when(F.size("_m") > 0, count).otherwise(0).alias("n_replaced"))
