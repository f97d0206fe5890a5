"""Format-preserving pseudonyms for personal data (operator 9, built-ins only).

Mail addresses, phone numbers, card-like numbers, national id numbers, IPv4
addresses and dates are found by pattern and validated (check digit, octet
range, calendar).  Each number or date is mapped by a keyed Feistel permutation
of its own format: digits stay digits in the same places, a card that passed
the check digit passes it again, a date becomes another date of the 400-year
cycle 1800-2199, so equal values stay linked across documents and no two
values of a format meet in one pseudonym.  The local part of a mail address
is replaced letter by letter with a keyed stream of the whole address (linked,
but no permutation); its host stays.

Defined results: null text stays null with no findings, empty text is
returned as it is, repeated rows are treated alike, an empty table gives an
empty result, null ids stay null, extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import regex_spans

ROUNDS = 8
# One pattern per kind, tried in this order at each place.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*+@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9])(?!\.[0-9])",
    "date": r"(?<![0-9-/.])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}[/.][0-9]{2}[/.][0-9]{4})(?![0-9-/])(?!\.[0-9])",
    "phone": r"(?<![0-9A-Za-z+])\+[0-9]{1,3}[ .-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})(?:[ .-]?[0-9]{2,4}){2,3}(?![0-9])"
             r"|(?<![0-9A-Za-z])(?:\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "card": r"(?<![0-9A-Za-z])[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z])",
}
MAIL = PATTERNS["email"]
NUMERIC = "(?=[0-9+(])(?:" + "|".join(f"(?:{p})" for k, p in PATTERNS.items() if k != "email") + ")"
ALL = f"{NUMERIC}|{MAIL}"
DAY0, DAYS, LOW, HIGH = "1800-01-01", 146097, 189, 773   # 189 * 773 days = the 400-year cycle


def _round(key: str, r: Column | int, salt: Column, half: Column) -> Column:
    """The round function: 64 hex digits keyed by round, format and one half."""
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(r).cast("string"), salt, half), 256)


def _byte(hexes: Column, i: Column) -> Column:
    """Two bytes of a hex string, the i-th pair (wrapping), as an int."""
    return F.conv(F.substring(hexes, (i % 16) * 4 + 1, F.lit(4)), 16, 10).cast("int")


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, not at each use."""
    return F.element_at(F.transform(F.array(value), body), 1)


def permute_digits(digits: Column, key: str, salt: Column) -> Column:
    """Permute a digit string within its length: an unbalanced Feistel network
    whose halves are added digit by digit modulo 10 to a keyed stream of the
    other half.  A bijection of the strings of that length; a single digit is
    shifted by the key."""
    n = F.length(digits)
    u = (n / 2).cast("int")
    left, right = F.substring(digits, F.lit(1), u), F.substring(digits, u + 1, n)

    def add(half: Column, stream: Column) -> Column:
        return _let(stream, lambda st: F.concat_ws("", F.transform(
            F.split(half, ""), lambda c, i: F.when(c == "", "").otherwise(
                ((c.cast("int") + _byte(st, i)) % 10).cast("string")))))

    def step(acc: Column, r: Column) -> Column:
        even = r % 2 == 0
        moved = add(F.when(even, acc["r"]).otherwise(acc["l"]),
                    _round(key, r, F.concat_ws("#", salt, n.cast("string")),
                           F.when(even, acc["l"]).otherwise(acc["r"])))
        return F.struct(F.when(even, acc["l"]).otherwise(moved).alias("l"),
                        F.when(even, moved).otherwise(acc["r"]).alias("r"))

    out = F.aggregate(F.array(*[F.lit(i) for i in range(ROUNDS)]),
                      F.struct(left.alias("l"), right.alias("r")), step)
    return _let(out, lambda o: F.concat(o["l"], o["r"]))


def permute_days(day: Column, key: str) -> Column:
    """Permute day numbers 0..146096: a Feistel network on 189 x 773, whose
    product is exactly the cycle, so no value leaves the range."""
    def step(acc: Column, r: Column) -> Column:
        even = r % 2 == 0
        f = F.conv(F.substring(_round(key, r, F.lit("day"), F.when(even, acc["a"]).otherwise(acc["b"]).cast("string")),
                               1, 7), 16, 10).cast("int")
        return F.struct(F.when(even, acc["a"]).otherwise((acc["a"] + f) % LOW).alias("a"),
                        F.when(even, (acc["b"] + f) % HIGH).otherwise(acc["b"]).alias("b"))

    out = F.aggregate(F.array(*[F.lit(i) for i in range(ROUNDS)]),
                      F.struct((day / HIGH).cast("int").alias("a"), (day % HIGH).alias("b")), step)
    return _let(out, lambda o: o["a"] * HIGH + o["b"])


def luhn_sum(digits: Column) -> Column:
    """Luhn total of a digit string (its last digit counts once)."""
    d = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(c == "", 0).otherwise(
        F.when(i % 2 == 1, (c.cast("int") * 2) % 10 + (c.cast("int") * 2 / 10).cast("int")).otherwise(c.cast("int"))))
    return F.aggregate(d, F.lit(0), lambda a, x: a + x)


def refill(shape: Column, digits: Column) -> Column:
    """Put ``digits`` into the digit places of ``shape``, in order."""
    cells = F.split(shape, "")
    start = F.struct(F.lit(1).alias("i"), F.lit("").alias("out"))
    return _let(digits, lambda d: F.aggregate(cells, start, lambda a, c: F.struct(
        F.when(c.rlike("^[0-9]$"), a["i"] + 1).otherwise(a["i"]).alias("i"),
        F.concat(a["out"], F.when(c.rlike("^[0-9]$"), F.substring(d, a["i"], F.lit(1))).otherwise(c)).alias("out")))["out"])


def _only_digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _iso(value: Column) -> Column:
    """The date a match states, or null: yyyy-mm-dd, dd.mm.yyyy or mm/dd/yyyy
    (dd/mm/yyyy where the first is no month)."""
    p = F.split(value, "[-/.]")
    us = F.try_to_timestamp(F.concat_ws("-", p[2], p[0], p[1]), F.lit("yyyy-MM-dd"))
    eu = F.try_to_timestamp(F.concat_ws("-", p[2], p[1], p[0]), F.lit("yyyy-MM-dd"))
    ymd = F.try_to_timestamp(value, F.lit("yyyy-MM-dd"))
    d = (F.when(value.contains("-"), ymd).when(value.contains("/"), F.coalesce(us, eu)).otherwise(eu)).cast("date")
    return F.when((d >= F.lit(DAY0).cast("date")) & (d < F.lit("2200-01-01").cast("date")), d)


def kind_of(hit: Column) -> Column:
    """The kind of a match after validation, or null: octets up to 255, real
    dates, 13-19 digit numbers by check digit ("card", else "number")."""
    dots = F.split(hit, r"\.")
    octets = F.forall(dots, lambda x: x.try_cast("int") <= 255)
    is_ip = hit.rlike(r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$")
    is_date = hit.rlike(r"^(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}[/.][0-9]{2}[/.][0-9]{4})$")
    is_ssn = hit.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$")
    is_phone = hit.startswith("+") | hit.rlike(r"^\([0-9]{3}\)|^[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}$")
    digits = _only_digits(hit)
    return (F.when(hit.contains("@"), "email")
            .when(is_ip, F.when(octets, "ip"))
            .when(is_date, F.when(_iso(hit).isNotNull(), "date"))
            .when(is_ssn, "ssn").when(is_phone, "phone")
            .when(F.length(digits) >= 13, F.when(luhn_sum(digits) % 10 == 0, "card").otherwise("number")))


def pseudonym(kind: Column, hit: Column, key: str) -> Column:
    """The format-preserving pseudonym of a validated match."""
    digits = _only_digits(hit)
    n = F.length(digits)
    body = permute_digits(F.substring(digits, F.lit(1), n - 1), key, F.lit("card"))
    card = refill(hit, _let(body, lambda b: F.concat(
        b, ((10 - luhn_sum(F.concat(b, F.lit("0"))) % 10) % 10).cast("string"))))
    plain = refill(hit, permute_digits(digits, key, kind))
    octets = F.split(hit, r"\.")
    ip_hex = F.concat_ws("", F.transform(octets, lambda x: F.lpad(F.hex(x.cast("int")), 2, "0")))

    def ip_step(acc: Column, r: Column) -> Column:
        f = F.conv(F.substring(_round(key, r, F.lit("ip"), acc["b"].cast("string")), 1, 4), 16, 10).cast("int")
        return F.struct(acc["b"].alias("a"), ((acc["a"] + f) % 65536).alias("b"))

    ip_out = F.aggregate(F.array(*[F.lit(i) for i in range(ROUNDS)]), F.struct(
        F.conv(F.substring(ip_hex, 1, 4), 16, 10).cast("int").alias("a"),
        F.conv(F.substring(ip_hex, 5, 4), 16, 10).cast("int").alias("b")), ip_step)
    ip = _let(ip_out, lambda o: F.concat_ws(".", *[(F.floor(x / d) % 256).cast("string")
                                                   for x in (o["a"], o["b"]) for d in (256, 1)]))
    day = permute_days(F.datediff(_iso(hit), F.lit(DAY0).cast("date")), key)
    us_style = F.try_to_timestamp(F.concat_ws("-", F.split(hit, "/")[2], F.split(hit, "/")[0], F.split(hit, "/")[1]),
                                  F.lit("yyyy-MM-dd")).isNotNull()
    date = _let(F.date_add(F.lit(DAY0).cast("date"), day), lambda new: (
        F.when(hit.contains("-"), F.date_format(new, "yyyy-MM-dd"))
        .when(hit.contains("/"), F.when(us_style, F.date_format(new, "MM/dd/yyyy"))
              .otherwise(F.date_format(new, "dd/MM/yyyy")))
        .otherwise(F.date_format(new, "dd.MM.yyyy"))))
    local, host = F.substring_index(hit, "@", 1), F.substring_index(hit, "@", -1)
    # letters and digits of the local part move within their class, the host stays
    stream = _round(key, 0, F.lit("email"), F.lower(hit))
    mail = F.concat(_let(stream, lambda st: F.concat_ws("", F.transform(F.split(local, ""), lambda c, i: (
        F.when(c.rlike("^[0-9]$"), ((c.try_cast("int") + _byte(st, i)) % 10).cast("string"))
        .when(c.rlike("^[a-z]$"), F.char((F.ascii(c) - 97 + _byte(st, i)) % 26 + 97))
        .when(c.rlike("^[A-Z]$"), F.char((F.ascii(c) - 65 + _byte(st, i)) % 26 + 65))
        .otherwise(c))))), F.lit("@"), host)
    return (F.when(kind == "card", card).when(kind == "ip", ip).when(kind == "date", date)
            .when(kind == "email", mail).otherwise(plain))


def find(text: Column) -> Column:
    """array<struct<start, end, hit, kind>> of the validated matches of a text."""
    t = F.coalesce(text, F.lit(""))
    mail, number = regex_spans(t, ALL, t.contains("@")), regex_spans(t, NUMERIC, t.rlike("[0-9]"))
    spans = F.when(t.contains("@"), mail).otherwise(number)
    typed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"),
                                                  s["hit"].alias("hit"), kind_of(s["hit"]).alias("kind")))
    return F.filter(typed, lambda s: s["kind"].isNotNull())


def pseudonymise(docs: DataFrame, text: str = "text", key: str = "corpus-key", out: str = "text",
                 spans: str = "pii") -> DataFrame:
    """``docs`` with ``spans`` (array<struct<start, end, hit, kind, pseudonym>>
    in code points of the old text) and ``out``, the text with every match
    replaced.  One pass over the rows, no shuffle."""
    t = F.col(text)
    df = docs.withColumn(spans, find(t))
    df = df.withColumn(spans, F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), s["hit"].alias("hit"), s["kind"].alias("kind"),
        pseudonym(s["kind"], s["hit"], key).alias("pseudonym"))))
    start = F.struct(F.lit(0).alias("pos"), F.lit("").alias("out"))
    done = F.aggregate(spans, start, lambda a, s: F.struct(
        s["end"].alias("pos"),
        F.concat(a["out"], F.substring(t, a["pos"] + 1, s["start"] - a["pos"]), s["pseudonym"]).alias("out")),
        lambda a: F.concat(a["out"], F.substring(t, a["pos"] + 1, F.length(t))))
    return df.withColumn(out, F.when(F.size(spans) > 0, done).otherwise(t))
