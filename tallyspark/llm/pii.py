"""Pseudonyms for personal data that keep the format, in DataFrame operations only.

Payment cards (Luhn), IBANs (mod 97), phone numbers in international, North American and trunk-prefixed national form, IPv4 addresses, US social
security numbers, calendar dates, e-mail addresses, assigned secrets and bare tokens of two public formats are found by one expression, validated, and replaced by a value of the same format. Numbers and dates are
permuted under a key by a Feistel network over the digits' own domain: half a mod a, half b mod b, in `ROUNDS` rounds of
modular addition of a keyed SHA-256. A permutation never maps two values to one, so equal values, and only they, stay linked
across documents, and in all spellings of a phone number or date that name its country or order; a national number with a trunk prefix names none. Check digits are computed anew; separators stay. E-mail names and secrets, which have no numeric domain,
become keyed digests of their length's form; an e-mail's domain stays.

What matches but isn't valid (a 16-digit number that fails Luhn, a date on 30 February) stays as it is.
The texts are split at the matches and joined again, so nothing else changes.

The key is the argument, else the session's `spark.tallyspark.pii.key`, else a demonstration key that everybody can read here: set your own.

Nulls: a null text stays null, with no finds. Empty and very long texts, repeated rows and empty tables need nothing special.
Extra columns are passed on by `pseudonymise`; one named `kinds_as` is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import common as C

KEY_SETTING, DEMONSTRATION_KEY = "spark.tallyspark.pii.key", "tallyspark demonstration key"
ROUNDS = 8
KINDS = ("card", "iban", "phone", "national", "ip", "ssn", "date", "email", "secret")

#: What an e-mail's name is made of: anything but white space and these signs.
NAME = r"[^\s@,;:!?()\[\]<>\"'|\\/=#*$&^~{}`]"
#: What a secret is assigned by, and what it is made of without quotes: only if it has letters and digits is it no word of prose.
ASSIGNED = r"""(?i:token|secret|password|passwd|api[_ -]?key)["']? ?[=:]"""
#: How tokens of two public formats begin, wherever they stand.
BEARER, ACCESS_KEY = "Bearer ", "AKIA"
BARE = r"""[^"'\s,;&<>(){}=:]"""
#: Formats. Counted and possessive repetitions keep the search linear.
PATTERNS = {
    "token": rf"(?<![A-Za-z0-9])(?:{ACCESS_KEY}[A-Z0-9]{{16}}(?![A-Za-z0-9])|{BEARER}(?=\S*\d)[A-Za-z0-9._~+/-]{{15,}}+=*)",
    "secret": rf"""{ASSIGNED} ?(?:["'][^"'\r\n]{{8,}}+["']|(?={BARE}*\d)(?={BARE}*[A-Za-z]){BARE}{{7,}}[^"'\s,;&<>(){{}}=:.!?])""",
    "email": rf"(?<!{NAME}){NAME}++@(?:[A-Za-z0-9-]{{1,63}}+\.){{1,126}}[A-Za-z]{{2,63}}",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "phone": r"(?<![\d+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{2,4})(?:[ .-]?\d{2,4}){2,4}(?!\d)",
    "national": r"(?<![\d+(.-])(?:1[ .-])?(?:\(\d{3}\)[ -]?|\d{3}[.-])\d{3}[ .-]\d{4}(?![\d-]|\.\d)|(?<![\d+.,/-])0\d{2,4}[ /-]\d{3,4}(?:[ -]?\d{3,4})?(?![\d/-]|[.,]\d)",
    "date": r"(?<![\d./-])(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{2}[./]\d{2}[./]\d{4}|\d{2}-\d{2}-\d{4})(?![\d/-])",
    "ip": r"(?<![\d.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?![\d]|\.\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": r"(?<!\d)(?:\d{13,19}|\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{1,7}|\d{4}[ -]\d{6}[ -]\d{4,5})(?!\d|[ -]\d{4}(?!\d))",
}
NUMBERS = "(?=[0-9+(])(?:" + "|".join(PATTERNS[k] for k in ("phone", "date", "ip", "ssn", "card", "national")) + ")|" + PATTERNS["iban"]
#: (what a text must contain, the expression that it is then searched with); the first that holds is taken. Every match of an expression holds its sign. Texts without
#: the long expression's signs are spared it.
SEARCHES = (
    (f"@|{ACCESS_KEY}|{BEARER}|{ASSIGNED}", f"(?=[TtSsPpAaB])(?:{PATTERNS['token']}|{PATTERNS['secret']})|{PATTERNS['email']}|{NUMBERS}"),
    (r"\d{3}|\d\.\d|\+\d|[A-Z]{2}\d\d", NUMBERS),
)
#: Country calling codes of one and two digits; all others have three.
ONE_DIGIT = ("1", "7")
TWO_DIGITS = tuple("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
#: Stands around the matches while a text is cut up; a text that has it already is searched twice instead.
SENTINEL = "\ue0f0"


def keyed(key: str, tweak: Column | str, value: Column) -> Column:
    """A number of 60 bits from a keyed digest."""
    tweak = F.lit(tweak) if isinstance(tweak, str) else tweak
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), tweak, value.cast("string")), 256), 1, 15), 16, 10).cast("long")


def let(value: Column, body) -> Column:
    """`body` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def feistel(left: Column, right: Column, a: Column, b: Column, key: str, tweak: Column | str) -> Column:
    """A keyed permutation of (left mod a, right mod b), as struct<l, r>. Halves take turns, so domains may differ."""
    tweak = F.lit(tweak) if isinstance(tweak, str) else tweak
    zero = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))

    def step(s: Column, i: Column) -> Column:
        mix = lambda half: keyed(key, F.concat_ws("|", tweak, i.cast("string")), half)
        return F.when(i % 2 == 0, F.struct(F.pmod(s["l"] + mix(s["r"]), a).alias("l"), s["r"].alias("r"))).otherwise(
            F.struct(s["l"].alias("l"), F.pmod(s["r"] + mix(s["l"]), b).alias("r"))
        )

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), zero, step)


def unfeistel(left: Column, right: Column, a: Column, b: Column, key: str, tweak: Column | str) -> Column:
    """The inverse of `feistel`."""
    tweak = F.lit(tweak) if isinstance(tweak, str) else tweak
    zero = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))

    def step(s: Column, i: Column) -> Column:
        mix = lambda half: keyed(key, F.concat_ws("|", tweak, i.cast("string")), half)
        return F.when(i % 2 == 0, F.struct(F.pmod(s["l"] - mix(s["r"]), a).alias("l"), s["r"].alias("r"))).otherwise(
            F.struct(s["l"].alias("l"), F.pmod(s["r"] - mix(s["l"]), b).alias("r"))
        )

    return F.aggregate(F.sequence(F.lit(ROUNDS - 1), F.lit(0), F.lit(-1)), zero, step)


def _ten(n: Column) -> Column:
    return F.rpad(F.lit("1"), n + 1, "0").cast("long")


def permuted_digits(digits: Column, key: str, tweak: Column | str, inverse: bool = False) -> Column:
    """A string of 2 to 34 digits, permuted within the strings of its length."""
    network = unfeistel if inverse else feistel
    tweak = F.lit(tweak) if isinstance(tweak, str) else tweak

    def run(h: Column) -> Column:
        out = network(h["l"].cast("long"), h["r"].cast("long"), h["a"], h["b"], key, h["t"])
        return let(out, lambda o: F.concat(F.lpad(o["l"].cast("string"), F.length(h["l"]), "0"), F.lpad(o["r"].cast("string"), F.length(h["r"]), "0")))

    def halves(d: Column) -> Column:
        n = F.length(d)
        half = F.floor(n / 2).cast("int")
        return F.struct(
            F.substr(d, F.lit(1), half).alias("l"), F.substr(d, half + 1).alias("r"), _ten(half).alias("a"), _ten(n - half).alias("b"), F.concat_ws("|", tweak, n.cast("string")).alias("t")
        )

    return let(let(digits, halves), run)


def luhn_sum(digits: Column) -> Column:
    """Luhn's sum of a digit string, its last digit not doubled."""
    zero = F.struct(F.lit(0).alias("t"), F.lit(0).alias("i"))
    twice = lambda c: F.pmod(c * 2, F.lit(10)) + F.floor(c / 5).cast("int")
    step = lambda a, c: F.struct((a["t"] + F.when(a["i"] == 0, c).otherwise(twice(c))).alias("t"), (1 - a["i"]).alias("i"))
    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), lambda c: c.cast("int")), zero, step)["t"]


def mod97(text: Column) -> Column:
    """Remainder of an IBAN, moved round and spelt in digits, by 97."""
    digits = F.concat(F.substr(text, F.lit(5)), F.substr(text, F.lit(1), F.lit(4)))
    return F.aggregate(
        F.split(digits, ""), F.lit(0),
        lambda r, c: F.when(c.rlike("[0-9]"), F.pmod(r * 10 + F.ascii(c) - 48, F.lit(97))).otherwise(F.pmod(r * 100 + F.ascii(c) - 55, F.lit(97))),
    )


def in_places(shape: Column, chars: Column) -> Column:
    """`shape` with its digits replaced in turn by those of `chars`."""
    def run(x: Column) -> Column:
        return F.aggregate(
            F.split(x["shape"], ""),
            F.struct(F.lit("").alias("s"), F.lit(1).alias("i")),
            lambda a, c: F.when(c.rlike("[0-9]"), F.struct(F.concat(a["s"], F.substr(x["chars"], a["i"], F.lit(1))).alias("s"), (a["i"] + 1).alias("i"))).otherwise(
                F.struct(F.concat(a["s"], c).alias("s"), a["i"].alias("i"))
            ),
        )["s"]

    return let(F.struct(shape.alias("shape"), chars.alias("chars")), run)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _card(m: Column, key: str) -> Column:
    check = lambda body: F.pmod(10 - F.pmod(luhn_sum(F.concat(body, F.lit("0"))), F.lit(10)), F.lit(10)).cast("string")
    made = lambda d: let(permuted_digits(F.substr(d, F.lit(1), F.length(d) - 1), key, "card"), lambda body: in_places(m, F.concat(body, check(body))))
    return let(_digits(m), lambda d: F.when(F.pmod(luhn_sum(d), F.lit(10)) == 0, made(d)))


def _iban(m: Column, key: str) -> Column:
    """Country, letters and places stay; the account's digits are permuted, then the check digits follow."""
    flat = F.regexp_replace(m, " ", "")
    moved = let(F.substr(_digits(m), F.lit(3)), lambda d: F.when(F.length(d) >= 2, permuted_digits(d, key, "iban")).otherwise(d))
    shaped = in_places(F.concat(F.substr(m, F.lit(1), F.lit(2)), F.lit("00"), F.substr(m, F.lit(5))), F.concat(F.lit("00"), moved))
    made = let(shaped, lambda x: F.concat(F.substr(m, F.lit(1), F.lit(2)), F.lpad((98 - mod97(F.regexp_replace(x, " ", ""))).cast("string"), 2, "0"), F.substr(x, F.lit(5))))
    return F.when(let(flat, lambda f: F.length(f).between(15, 34) & (mod97(f) == 1)), made)


def _phone(m: Column, key: str) -> Column:
    """The country's digits stay, and a trunk prefix in brackets; the national number is permuted within its country, however it is written."""
    trunk = F.when(m.rlike(r"^\+\d{1,3}[ .-]?\(0\)"), 1).otherwise(0)

    def run(x: Column) -> Column:
        made = permuted_digits(F.substr(x["d"], x["code"] + x["trunk"] + 1), key, F.concat(F.lit("phone|"), F.substr(x["d"], F.lit(1), x["code"])))
        return in_places(m, F.concat(F.substr(x["d"], F.lit(1), x["code"] + x["trunk"]), made))

    code = lambda d: F.when(F.substr(d, F.lit(1), F.lit(1)).isin(*ONE_DIGIT), 1).when(F.substr(d, F.lit(1), F.lit(2)).isin(*TWO_DIGITS), 2).otherwise(3)
    return let(_digits(m), lambda d: F.when(F.length(d).between(8, 15), let(F.struct(d.alias("d"), code(d).alias("code"), trunk.alias("trunk")), run)))


def _national(m: Column, key: str) -> Column:
    """A trunk prefix stays, as does the country's 1; the other digits are permuted as one number, North American ones as they are in their international form."""
    kept = F.when(m.startswith("0") | m.rlike(r"^1[ .-]"), 1).otherwise(0)
    domain = F.when(m.startswith("0"), "national").otherwise("phone|1")
    made = let(F.substr(m, kept + 1), lambda rest: F.concat(F.substr(m, F.lit(1), kept), in_places(rest, permuted_digits(_digits(rest), key, domain))))
    return F.when(F.length(_digits(m)).between(9, 12), made)


def _ip(m: Column, key: str) -> Column:
    def made(o: Column) -> Column:
        out = feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], F.lit(65536), F.lit(65536), key, "ip")
        quad = lambda x: F.concat_ws(".", *(p.cast("string") for p in (F.floor(x["l"] / 256), F.pmod(x["l"], F.lit(256)), F.floor(x["r"] / 256), F.pmod(x["r"], F.lit(256)))))
        return F.when(F.forall(o, lambda x: x < 256), let(out, quad))

    return let(F.transform(F.split(m, r"\."), lambda x: x.cast("long")), made)


def _ssn(m: Column, key: str) -> Column:
    """Area 001-899 but 666, group 01-99, serial 0001-9999: 898 areas times 99 times 9999."""
    area, group, serial = (F.substr(m, F.lit(a), F.lit(n)).cast("long") for a, n in ((1, 3), (5, 2), (8, 4)))
    out = feistel(area - F.when(area > 666, 2).otherwise(1), (group - 1) * 9999 + serial - 1, F.lit(898), F.lit(99 * 9999), key, "ssn")

    def spelt(x: Column) -> Column:
        new = x["l"] + F.when(x["l"] >= 665, 2).otherwise(1)
        return F.concat_ws("-", F.lpad(new.cast("string"), 3, "0"), F.lpad((F.floor(x["r"] / 9999) + 1).cast("string"), 2, "0"), F.lpad((F.pmod(x["r"], F.lit(9999)) + 1).cast("string"), 4, "0"))

    return F.when(area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0), let(out, spelt))


def _date(m: Column, key: str) -> Column:
    """Dates of 1600 to 2399. 29 February is permuted among the 194 leap years, other days among 800 years of 365 days; so a date has one pseudonym in all its forms."""
    iso = m.rlike(r"^\d{4}")
    part = lambda at, n: F.substr(m, F.lit(at), F.lit(n))
    told = lambda y, mo, d: F.try_to_date(F.concat_ws("-", y, mo, d), "yyyy-MM-dd")
    day_first, month_first = told(part(7, 4), part(4, 2), part(1, 2)), told(part(7, 4), part(1, 2), part(4, 2))
    order = F.when(iso, "ymd").when(day_first.isNotNull(), "dmy").otherwise("mdy")
    date = F.when(iso, told(part(1, 4), part(6, 2), part(9, 2))).otherwise(F.coalesce(day_first, month_first))
    cycle = F.array(*(F.lit(y) for y in range(400) if y % 4 == 0 and (y % 100 or y == 0)))  # leap years of the calendar's 400

    def usual(d: Column) -> Column:
        year = F.year(d)
        is_leap = ((F.pmod(year, F.lit(4)) == 0) & (F.pmod(year, F.lit(100)) != 0)) | (F.pmod(year, F.lit(400)) == 0)
        place = F.dayofyear(d) - 1 - F.when(is_leap & (F.month(d) > 2), 1).otherwise(0)
        out = feistel(year - 1600, place, F.lit(800), F.lit(365), key, "date")
        return let(out, lambda x: F.make_date((x["l"] + 1600).cast("int"), *(f(F.date_add(F.lit("2001-01-01").cast("date"), x["r"].cast("int"))) for f in (F.month, F.dayofmonth))))

    def leap(d: Column) -> Column:
        place = F.array_position(cycle, F.pmod(F.year(d), F.lit(400))) - 1
        out = feistel(F.floor((F.year(d) - 1600) / 400), place, F.lit(2), F.lit(97), key, "leap")
        return let(out, lambda x: F.make_date((1600 + x["l"] * 400 + F.get(cycle, x["r"].cast("int"))).cast("int"), F.lit(2), F.lit(29)))

    def spelt(x: Column) -> Column:
        y, mo, d = F.date_format(x["new"], "yyyy"), F.date_format(x["new"], "MM"), F.date_format(x["new"], "dd")
        one, two = F.when(iso, part(5, 1)).otherwise(part(3, 1)), F.when(iso, part(8, 1)).otherwise(part(6, 1))
        joined = F.when(x["order"] == "ymd", F.concat(y, one, mo, two, d)).when(x["order"] == "dmy", F.concat(d, one, mo, two, y)).otherwise(F.concat(mo, one, d, two, y))
        return F.when(x["new"].isNotNull(), joined)

    new = let(date, lambda d: F.when(F.year(d).between(1600, 2399), F.when((F.month(d) == 2) & (F.dayofmonth(d) == 29), leap(d)).otherwise(usual(d))))
    return let(F.struct(new.alias("new"), order.alias("order")), spelt)


def _email(m: Column, key: str) -> Column:
    name = F.substring_index(m, "@", 1)
    return F.concat(F.lit("u"), F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), F.lower(m)), 256), 1, 15), F.substr(m, F.length(name) + 1))


def _secret(m: Column, key: str) -> Column:
    head = F.regexp_extract(m, rf"""^(?:{ACCESS_KEY}|{BEARER}|{ASSIGNED} ?["']?)""", 0)
    tail = F.regexp_extract(m, r"""["']$""", 0)

    def run(value: Column) -> Column:
        digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit("secret"), value), 256)
        return F.concat(head, F.substr(F.repeat(digest, F.ceil(F.length(value) / 64).cast("int")), F.lit(1), F.length(value)), tail)

    return let(F.substr(m, F.length(head) + 1, F.length(m) - F.length(head) - F.length(tail)), run)


def replaced(m: Column, key: str) -> Column:
    """struct<kind, value> for a match; a null kind means it isn't valid and stays."""
    tests = (
        ("secret", m.rlike(rf"^(?:{ACCESS_KEY}[A-Z0-9]{{16}}$|{BEARER}|{ASSIGNED})"), _secret),
        ("email", m.contains("@"), _email),
        ("iban", m.rlike("^[A-Z]{2}"), _iban),
        ("phone", m.startswith("+"), _phone),
        ("date", m.rlike(r"^(?:\d{4}[/-]\d{2}[/-]\d{2}|\d{2}[./-]\d{2}[./-]\d{4})$"), _date),
        ("ip", m.rlike(r"^\d{1,3}(?:\.\d{1,3}){3}$"), _ip),
        ("ssn", m.rlike(r"^\d{3}-\d{2}-\d{4}$"), _ssn),
        ("national", m.rlike(rf"^(?:{PATTERNS['national']})$"), _national),
    )
    kind = value = F
    for name, test, make in tests:
        kind, value = kind.when(test, F.lit(name)), value.when(test, make(m, key))
    kind, value = kind.otherwise("card"), value.otherwise(_card(m, key))
    return F.struct(F.when(value.isNotNull(), kind).alias("kind"), F.coalesce(value, m).alias("value"))


def _cut(t: Column, pattern: str) -> Column:
    """The text cut at the matches: what lies between them at even places, the matches at odd ones."""
    marked = F.split(F.regexp_replace(t, f"(?:{pattern})", f"{SENTINEL}$0{SENTINEL}"), SENTINEL, -1)
    between, found = F.split(t, pattern, -1), F.regexp_extract_all(t, F.lit(f"(?:{pattern})"), F.lit(0))
    zipped = F.flatten(F.zip_with(between, found, lambda b, f: F.array(b, f)))
    return F.when(~t.contains(SENTINEL), marked).otherwise(F.slice(zipped, 1, F.greatest(F.size(zipped) - 1, F.lit(1))))


def pseudonymise(docs: DataFrame, key: str | None = None, text: str = "text", kinds_as: str = "pii") -> DataFrame:
    """The rows with `text` rewritten, and the kinds replaced in order as the column `kinds_as`."""
    key = key or docs.sparkSession.conf.get(KEY_SETTING, DEMONSTRATION_KEY)
    t = F.col(text)
    parts = F
    for hint, pattern in SEARCHES:
        parts = parts.when(t.rlike(hint), _cut(t, pattern))
    as_is = F.struct(F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("value"))
    cut, made = "__pii_parts", "__pii_made"  # beside whatever columns there are
    rows = docs.withColumn(cut, parts)
    rows = rows.withColumn(made, F.transform(cut, lambda p, i: F.when(i % 2 == 1, replaced(p, key)).otherwise(F.struct(as_is["kind"].alias("kind"), p.alias("value")))))
    kinds = F.array_compact(F.transform(made, lambda m: m["kind"]))
    rows = rows.withColumn(kinds_as, F.coalesce(kinds, F.array().cast("array<string>")))
    joined = F.array_join(F.transform(made, lambda m: m["value"]), "")
    return rows.withColumn(text, F.when(F.size(kinds_as) > 0, joined).otherwise(t)).drop(cut, made)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pseudonymise(C.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "text", *(F.size(F.array_compact(F.transform("pii", _only(kind)))).cast("long").alias(f"n_{kind}") for kind in KINDS))


def _only(kind: str):
    return lambda k: F.when(k == kind, k)
