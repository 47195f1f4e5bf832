"""Personal data: format-preserving Feistel pseudonyms.  DataFrame functions only.

Numbers and dates that hold up to validation are permuted within their own format under a key: a card
number becomes another card number of as many digits with a right check digit, a date another date of
the same notation.  Equal values get equal pseudonyms in all documents, whatever their punctuation, and
different values different ones, as each is a bijection:

  card    13 to 19 digits, groups joined by blanks or hyphens, right by Luhn: all digits but the last
          are permuted, the last is made to check
  phone   numbers of 10 digits with a separator, maybe a country code: the 10 digits
  ssn     ddd-dd-dddd outside the areas 000, 666 and 9xx: the 898 areas that are left, and the 6 digits after
  ip      four octets up to 255: the 32 bits
  iban    a country's IBAN, right by mod 97: digits of its account, check digits made anew
  date    yyyy-mm-dd, dd.mm.yyyy and mm/dd/yyyy in the years 1700 to 2099 that exist: the 146 097 days
          of those 400 years, 627 x 233, so that a Feistel network over both factors covers them exactly
  email   the letters and digits before the @, each within its class

A digit string is a pair of halves (a, b) modulo powers of ten; each of ROUNDS rounds adds a keyed hash
of one half to the other.  What does not validate is left as it is, and so is all text in between.

Edge cases: a null text stays null, an empty one empty; values that overlap are taken from the left;
rows that repeat are treated alike; rows with null ids too; other columns are kept as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
#: For tests and demonstrations: set another one in production, and keep it secret.
DEMO_KEY = "skein demonstration key"
DAYS = (627, 233)
#: Areas of social security numbers: 001 to 899 but for 666.
AREAS = 898
KINDS = ("email", "iban", "ip", "date", "ssn", "phone", "card")

#: What values look like; each pattern matches a whole value.
PATTERNS = {
    "email": r"[\p{L}\p{N}._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "iban": r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Z0-9])",
    "ip": r"\d{1,3}(?:\.\d{1,3}){3}(?![\d]|\.\d)",
    "date": r"(?:\d{4}-\d{2}-\d{2}|\d{2}[./]\d{2}[./]\d{4})(?![\d-])",
    "ssn": r"\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\d)",
    "card": r"(?:\d{13,19}|\d{4}(?: \d{4}){2} \d{1,4}(?: \d{1,3})?|\d{4}(?:-\d{4}){2}-\d{1,4}(?:-\d{1,3})?|\d{4}[ -]\d{6}[ -]\d{5})(?!\d)",
}
_START = r"(?<![\p{L}\p{N}._%+@-])"
ANY = _START + "(?:" + "|".join(PATTERNS.values()) + ")"


def _chars(v: Column) -> Column:
    return F.regexp_extract_all(v, F.lit("(?s)."), F.lit(0))


def _hash(key: str, tweak: Column, turn, other: Column, modulus: Column) -> Column:
    """A keyed hash of the other half, below modulus (which is at most 10^10)."""
    digest = F.sha2(F.concat_ws("|", F.lit(key), tweak, turn.cast("string"), other.cast("string")), 256)
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), modulus)


def _network(left: Column, right: Column, a: Column, b: Column, key: str, tweak: Column) -> Column:
    """struct(l, r): an alternating Feistel network over numbers below a and below b."""
    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))

    def turn(s, i):
        l, r = s["l"], s["r"]
        on_left = F.pmod(l + _hash(key, tweak, i, r, a), a)
        on_right = F.pmod(r + _hash(key, tweak, i, l, b), b)
        return F.struct(F.when(i % 2 == 0, on_left).otherwise(l).cast("long").alias("l"), F.when(i % 2 == 0, r).otherwise(on_right).cast("long").alias("r"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn)


def permute_digits(digits: Column, key: str, tweak: str) -> Column:
    """Another string of as many digits, up to 19; one of 1 digit is shifted."""
    n = F.length(digits)
    k = F.floor(n / 2).cast("int")
    a, b = F.pow(F.lit(10), k).cast("long"), F.pow(F.lit(10), n - k).cast("long")
    tagged = F.concat(F.lit(f"{tweak}:"), n.cast("string"))
    left = F.coalesce(F.when(k > 0, F.substring(digits, F.lit(1), k)).cast("long"), F.lit(0))
    s = _network(left, F.substring(digits, k + 1, n - k).cast("long"), a, b, key, tagged)
    return F.concat(F.when(k > 0, F.lpad(s["l"].cast("string"), k, "0")).otherwise(F.lit("")), F.lpad(s["r"].cast("string"), n - k, "0"))


def refill(original: Column, digits: Column) -> Column:
    """original with its digits, from the left, replaced by those given."""

    def put(s, c):
        is_digit = c.between("0", "9")
        return F.struct((s["i"] + is_digit.cast("int")).alias("i"), F.concat(s["out"], F.when(is_digit, F.substring(digits, s["i"], F.lit(1))).otherwise(c)).alias("out"))

    return F.aggregate(_chars(original), F.struct(F.lit(1).alias("i"), F.lit("").alias("out")), put)["out"]


def luhn_sum(digits: Column) -> Column:
    def value(c, i):
        d = c.cast("int")
        return F.when(i % 2 == 0, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0))

    return F.aggregate(F.transform(_chars(F.reverse(digits)), value), F.lit(0), lambda s, v: s + v)


def _mod97(iban: Column) -> Column:
    turned = F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, 1, 4))

    def add(s, c):
        letter = c.between("A", "Z")
        return F.when(letter, (s * 100 + F.ascii(c) - 55) % 97).otherwise((s * 10 + F.coalesce(c.try_cast("int"), F.lit(0))) % 97)

    return F.aggregate(_chars(turned), F.lit(0), add)


def _shift(part: Column, hexes: Column) -> Column:
    """Each letter or digit moved on within its class by the numbers that hexes hold."""

    def move(c, i):
        by = F.conv(F.substring(hexes, (i % 32) * 2 + 1, F.lit(2)), 16, 10).cast("int")
        code = F.ascii(c)
        turned = lambda first, n: F.char(F.lit(first) + F.pmod(code - first + by, F.lit(n)))
        return F.when(c.between("0", "9"), turned(48, 10)).when(c.between("a", "z") & (F.length(c) == 1) & (code < 123), turned(97, 26)).when(c.between("A", "Z"), turned(65, 26)).otherwise(c)

    return F.when(F.length(part) > 0, F.array_join(F.transform(_chars(part), move), "")).otherwise(F.lit(""))


def permute_name(name: Column, key: str, tweak: str) -> Column:
    """Letters and digits permuted within their classes: a Feistel network over both halves of the string."""
    k = F.floor(F.length(name) / 2).cast("int")
    start = F.struct(F.substring(name, F.lit(1), k).alias("l"), F.substring(name, k + 1, F.length(name) - k).alias("r"))

    def turn(s, i):
        stream = lambda other: F.sha2(F.concat_ws("|", F.lit(key), F.lit(tweak), i.cast("string"), other), 256)
        return F.struct(F.when(i % 2 == 0, _shift(s["l"], stream(s["r"]))).otherwise(s["l"]).alias("l"), F.when(i % 2 == 0, s["r"]).otherwise(_shift(s["r"], stream(s["l"]))).alias("r"))

    out = F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn)
    return F.concat(out["l"], out["r"])


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, r"[^0-9]", "")


def _card(v: Column, key: str) -> Column:
    d = _digits(v)
    body = permute_digits(F.substring(d, F.lit(1), F.length(d) - 1), key, "card")
    check = F.pmod(10 - luhn_sum(F.concat(body, F.lit("0"))), F.lit(10))
    return F.when(luhn_sum(d) % 10 == 0, refill(v, F.concat(body, check.cast("string"))))


def _phone(v: Column, key: str) -> Column:
    d = _digits(v)
    keep = F.length(d) - 10
    return refill(v, F.concat(F.substring(d, F.lit(1), keep), permute_digits(F.substring(d, keep + 1, F.lit(10)), key, "phone")))


def _ssn(v: Column, key: str) -> Column:
    d = _digits(v)
    area = F.substring(d, 1, 3).cast("long")
    s = _network(area - 1 - (area > 666).cast("int"), F.substring(d, 4, 6).cast("long"), F.lit(AREAS).cast("long"), F.lit(10**6).cast("long"), key, F.lit("ssn"))
    area = s["l"] + 1 + (s["l"] >= 665).cast("int")
    return F.when(~v.rlike("^(000|666|9)"), refill(v, F.concat(F.lpad(area.cast("string"), 3, "0"), F.lpad(s["r"].cast("string"), 6, "0"))))


def _ip(v: Column, key: str) -> Column:
    o = F.transform(F.split(v, r"\."), lambda x: x.cast("long"))
    two16 = F.lit(65536).cast("long")
    s = _network(o[0] * 256 + o[1], o[2] * 256 + o[3], two16, two16, key, F.lit("ip"))
    part = lambda x: F.concat_ws(".", F.floor(x / 256).cast("string"), (x % 256).cast("string"))
    return F.when(~F.exists(o, lambda x: x > 255), F.concat_ws(".", part(s["l"]), part(s["r"])))


def _date(v: Column, key: str) -> Column:
    form = F.when(v.rlike("^....-"), "yyyy-MM-dd").when(v.contains("."), "dd.MM.yyyy").otherwise("MM/dd/yyyy")
    iso = F.when(v.rlike("^....-"), v).when(v.contains("."), F.concat_ws("-", F.substring(v, 7, 4), F.substring(v, 4, 2), F.substring(v, 1, 2))).otherwise(F.concat_ws("-", F.substring(v, 7, 4), F.substring(v, 1, 2), F.substring(v, 4, 2)))
    same = F.substring(v, 3, 1) == F.substring(v, 6, 1)  # of dd.mm.yyyy both marks alike
    day = F.date_diff(iso.try_cast("date"), F.lit("1700-01-01").cast("date")).cast("long")
    a, b = (F.lit(n).cast("long") for n in DAYS)
    s = _network(F.floor(day / DAYS[1]), day % DAYS[1], a, b, key, F.lit("date"))
    to = F.date_add(F.lit("1700-01-01").cast("date"), (s["l"] * DAYS[1] + s["r"]).cast("int"))
    y, m, d = (F.date_format(to, p) for p in ("yyyy", "MM", "dd"))
    out = F.when(form == "yyyy-MM-dd", F.concat_ws("-", y, m, d)).when(form == "dd.MM.yyyy", F.concat_ws(".", d, m, y)).otherwise(F.concat_ws("/", m, d, y))
    return F.when((day >= 0) & (day < DAYS[0] * DAYS[1]) & (v.rlike("^....-") | same), out)


def _iban(v: Column, key: str) -> Column:
    s = F.replace(v, F.lit(" "), F.lit(""))
    account = F.substring(s, F.lit(5), F.length(s))
    body = permute_name(account, key, "iban")
    check = F.lpad((98 - _mod97(F.concat(F.substring(s, 1, 2), F.lit("00"), body))).cast("string"), 2, "0")
    full = F.concat(F.substring(s, 1, 2), check, body)

    def put(t, c):
        blank = c == " "
        return F.struct((t["i"] + (~blank).cast("int")).alias("i"), F.concat(t["out"], F.when(blank, c).otherwise(F.substring(full, t["i"], F.lit(1)))).alias("out"))

    spaced = F.aggregate(_chars(v), F.struct(F.lit(1).alias("i"), F.lit("").alias("out")), put)["out"]
    return F.when(F.length(s).between(15, 34) & (_mod97(s) == 1), spaced)


def _email(v: Column, key: str) -> Column:
    at = F.instr(v, "@")
    return F.concat(permute_name(F.substring(v, F.lit(1), at - 1), key, "email"), F.substring(v, at, F.length(v)))


_MAKERS = {"email": _email, "iban": _iban, "ip": _ip, "date": _date, "ssn": _ssn, "phone": _phone, "card": _card}


def _pseudonym(value: Column, key: str) -> Column:
    """struct(kind, text): the kind is null for a value that does not validate, which stays."""
    out = F.struct(F.lit(None).cast("string").alias("kind"), value.alias("text"))
    for kind in reversed(KINDS):
        made = _MAKERS[kind](value, key)
        whole = value.rlike(f"^(?:{PATTERNS[kind]})$")
        out = F.when(whole & made.isNotNull(), F.struct(F.lit(kind).alias("kind"), made.alias("text"))).otherwise(out)
    return out


def pseudonymized(text: Column, key: str = DEMO_KEY) -> Column:
    """struct(text, kinds): the text with its pseudonyms, and the kinds of the values replaced, in order."""
    found = F.transform(F.regexp_extract_all(text, F.lit(ANY), F.lit(0)), lambda v: _pseudonym(v, key))
    kinds = F.filter(F.transform(found, lambda f: f["kind"]), lambda k: k.isNotNull())
    gaps = F.split(text, ANY, -1)
    whole = F.array_join(F.zip_with(gaps, F.transform(found, lambda f: f["text"]), lambda g, v: F.concat(g, F.coalesce(v, F.lit("")))), "")
    none = F.array().cast("array<string>")
    return F.when(text.rlike(r"[0-9]|@"), F.struct(whole.alias("text"), kinds.alias("kinds"))).when(text.isNotNull(), F.struct(text.alias("text"), none.alias("kinds"))).otherwise(F.struct(F.lit(None).cast("string").alias("text"), none.alias("kinds")))


def pseudonymize(docs: DataFrame, text_col: str = "text", key: str = DEMO_KEY) -> DataFrame:
    """docs with pseudonyms in text_col; all other columns as they were."""
    return docs.withColumn(text_col, pseudonymized(F.col(text_col), key)["text"])


def pseudonym_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: str = DEMO_KEY) -> DataFrame:
    """doc_id, text, and how many values of each kind were replaced."""
    df = docs.select(F.col(id_col).alias("doc_id"), pseudonymized(F.col(text_col), key).alias("p"))
    count = lambda kind: F.size(F.filter("p.kinds", lambda k: k == kind)).cast("long").alias(f"n_{kind}")
    return df.select("doc_id", F.col("p.text").alias("text"), *[count(k) for k in KINDS])
