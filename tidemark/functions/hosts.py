"""Host canonicalisation of http(s) urls (C1, C2) as built-in expressions: names, IPv4 forms and IPv6 literals.

A name is percent-decoded, lower-cased, its full-width forms and dots mapped to ASCII, soft hyphens dropped; labels beyond ASCII are written
in Punycode (RFC 3492), which is two nested folds over the label's code points. A host whose last label is a number is an IPv4
address in any of its written forms (one to four parts, decimal, octal or hexadecimal). ``[...]`` is an IPv6 address, written in its
shortest form (RFC 5952). Whatever a browser refuses is null. Known limit: Unicode normalisation beyond the mappings named here.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Parameters of Punycode.
BASE, T_MIN, T_MAX, SKEW, DAMP, FIRST_BIAS, FIRST_CODE = 36, 1, 26, 38, 700, 72, 128
DIGITS = "abcdefghijklmnopqrstuvwxyz0123456789"
#: Steps that no code point of a label of 63 characters exceeds.
_STEPS = 8

#: A host that is its own canonical form: no upper case, nothing to decode, last label no number.
PLAIN_RE = r"^(?:[a-z0-9_-]+\.)*[a-z_-][a-z0-9_-]*\.?$"
FORBIDDEN_RE = r"[\x00-\x20\x7f#%/:<>?@\[\\\]^|]"
NUMBER_RE = r"^(?:[0-9]+|0x[0-9a-f]*)$"
_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "。｡"
_NARROW = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)) + ".."


def _bind(value: Column, fn) -> Column:
    """Evaluate ``value`` once and hand it to ``fn`` as a lambda variable."""
    return F.get(F.transform(F.array(value), fn), 0)


def _div(a: Column, b) -> Column:
    return F.floor(a / b)


def _long(n: int) -> Column:
    return F.lit(n).cast("long")


def _steps() -> Column:
    return F.sequence(F.lit(1), F.lit(_STEPS))


def _adapted(delta: Column, points: Column, first: Column) -> Column:
    """The bias after a code point was written."""
    start = _bind(F.when(first, _div(delta, DAMP)).otherwise(_div(delta, 2)), lambda d: d + _div(d, points))
    big = ((BASE - T_MIN) * T_MAX) // 2
    scaled = F.aggregate(_steps(), F.struct(start.alias("d"), _long(0).alias("k")), lambda s, _: F.when(
        s["d"] > big, F.struct(_div(s["d"], BASE - T_MIN).alias("d"), (s["k"] + BASE).alias("k"))).otherwise(s))
    return _bind(scaled, lambda s: s["k"] + _div((BASE - T_MIN + 1) * s["d"], s["d"] + SKEW))


def _written(delta: Column, bias: Column) -> Column:
    """``delta`` as a variable-length number."""
    digit = lambda n: F.substr(F.lit(DIGITS), (n + 1).cast("int"), F.lit(1))

    def step(s: Column, k: Column) -> Column:
        def one(t: Column) -> Column:
            last = s["q"] < t
            return F.struct(F.when(last, s["q"]).otherwise(_div(s["q"] - t, F.lit(BASE) - t)).alias("q"),
                            F.concat(s["out"], digit(F.when(last, s["q"]).otherwise(t + (s["q"] - t) % (F.lit(BASE) - t)))).alias("out"), last.alias("done"))

        return F.when(s["done"], s).otherwise(_bind(F.greatest(_long(T_MIN), F.least(_long(T_MAX), k * BASE - bias)), one))

    zero = F.struct(delta.alias("q"), F.lit("").alias("out"), F.lit(False).alias("done"))
    return F.aggregate(_steps(), zero, step, lambda s: s["out"])


def punycode(label: Column) -> Column:
    """A label in ASCII: itself, or "xn--" and its Punycode."""
    def encode(codes: Column) -> Column:
        basic = F.filter(F.split(label, ""), lambda c: F.ascii(c) < FIRST_CODE)
        n_basic = F.size(basic).cast("long")
        names = ["delta", "bias", "done", "out"]

        def of_code(s: Column, m: Column) -> Column:
            def of_place(x: Column, c: Column) -> Column:
                write = F.struct(_long(0).alias("delta"), _adapted(x["delta"], x["done"] + 1, x["done"] == n_basic).alias("bias"),
                                 (x["done"] + 1).alias("done"), F.concat(x["out"], _written(x["delta"], x["bias"])).alias("out"))
                pass_by = F.struct((x["delta"] + F.when(c < m, _long(1)).otherwise(_long(0))).alias("delta"), *[x[n].alias(n) for n in names[1:]])
                return F.when(c == m, write).otherwise(pass_by)

            start = F.struct((s["delta"] + (m - s["next"]) * (s["done"] + 1)).alias("delta"), *[s[n].alias(n) for n in names[1:]])
            return _bind(F.aggregate(codes, start, of_place), lambda r: F.struct(
                (r["delta"] + 1).alias("delta"), *[r[n].alias(n) for n in names[1:]], (m + 1).alias("next")))

        others = F.array_sort(F.array_distinct(F.filter(codes, lambda c: c >= FIRST_CODE)))
        head = F.concat(F.lit("xn--"), F.array_join(basic, ""), F.when(n_basic > 0, F.lit("-")).otherwise(F.lit("")))
        start = F.struct(_long(0).alias("delta"), _long(FIRST_BIAS).alias("bias"), n_basic.alias("done"), head.alias("out"), _long(FIRST_CODE).alias("next"))
        return F.aggregate(others, start, of_code, lambda s: s["out"])

    codes = F.transform(F.split(label, ""), lambda c: F.ascii(c).cast("long"))
    return F.when(label.rlike(r"^[\x00-\x7f]*$"), label).otherwise(_bind(codes, encode))


def _number(part: Column) -> Column:
    """An IPv4 part; null if it is none or beyond 32 bits."""
    hexadecimal, octal = part.startswith("0x"), part.rlike("^0[0-7]+$")
    digits = F.regexp_replace(F.when(hexadecimal, F.substr(part, F.lit(3))).otherwise(part), "^0+", "")
    fits = part.rlike(NUMBER_RE) & (F.length(digits) <= 11) & (hexadecimal | octal | part.rlike("^(?:0|[1-9][0-9]*)$"))
    value = (F.when(F.length(digits) == 0, F.lit("0")).when(hexadecimal, F.conv(digits, 16, 10)).when(octal, F.conv(digits, 8, 10)).otherwise(digits))
    return F.when(fits, value.try_cast("long"))


def ipv4(host: Column) -> Column:
    """Dotted form of a host whose last label is a number; null if it is no address."""
    def of_parts(parts: Column) -> Column:
        n, last = F.size(parts), F.element_at(parts, -1)
        small = F.forall(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda p: F.coalesce(p <= 255, F.lit(False)))
        # the last part fills the bytes that are left
        whole = F.aggregate(F.transform(F.slice(parts, F.lit(1), n - 1), lambda p, i: p * F.pow(F.lit(256), F.lit(3) - i).cast("long")), last, lambda a, p: a + p)
        fine = (n <= 4) & small & F.coalesce(last < F.pow(F.lit(256), F.lit(5) - n).cast("long"), F.lit(False))
        return F.when(fine, _bind(whole, lambda w: F.concat_ws(".", *[(_div(w, 256**k) % 256).cast("string") for k in (3, 2, 1, 0)])))

    labels = F.split(F.regexp_replace(host, r"\.$", ""), r"\.")
    return _bind(F.transform(labels, _number), of_parts)


def ipv6(inside: Column) -> Column:
    """Shortest form of the address between brackets; null if it is none."""
    quad = r"^(?:[0-9a-f:]*:)((?:(?:0|[1-9][0-9]?|1[0-9][0-9]|2[0-4][0-9]|25[0-5])(?:\.(?!$)|$)){4})$"
    bytes_of = lambda q: F.transform(F.split(q, r"\."), lambda b: b.try_cast("long"))
    in_hex = lambda q: _bind(bytes_of(q), lambda b: F.concat(
        F.lower(F.hex(F.get(b, 0) * 256 + F.get(b, 1))), F.lit(":"), F.lower(F.hex(F.get(b, 2) * 256 + F.get(b, 3)))))
    text = F.lower(inside)
    dotted = F.regexp_extract(text, quad, 1)
    text = F.when(F.length(dotted) > 0, F.concat(F.left(text, F.length(text) - F.length(dotted)), in_hex(dotted))).otherwise(text)

    def whole(t: Column) -> Column:
        at = F.instr(t, "::")
        pieces = lambda s: F.when(F.length(s) == 0, F.array().cast("array<string>")).otherwise(F.split(s, ":"))
        left = pieces(F.when(at > 0, F.left(t, at - 1)).otherwise(t))
        right = F.when(at > 0, pieces(F.substr(t, at + 2))).otherwise(F.array().cast("array<string>"))
        missing = F.lit(8) - F.size(left) - F.size(right)
        fine = F.when(at > 0, missing >= 1).otherwise(missing == 0) & F.forall(F.concat(left, right), lambda p: p.rlike("^[0-9a-f]{1,4}$"))
        full = F.concat(left, F.array_repeat(F.lit("0"), F.greatest(missing, F.lit(0))), right)
        short = F.array_join(F.transform(full, lambda p: F.regexp_replace(p, "^0+(?=.)", "")), ":")
        return F.when(fine, _bind(short, _compressed))

    return _bind(text, whole)


def _compressed(groups: Column) -> Column:
    """The first of the longest runs of two zero groups or more as "::"."""
    out = groups
    for n in range(2, 9):
        run = r"^(.*?)(?:^|:)" + ":".join("0" * n) + r"(?::|$)(.*)$"
        out = F.when(groups.rlike(run), F.regexp_replace(groups, run, "$1::$2")).otherwise(out)
    return out


def _name(host: Column) -> Column:
    decoded = F.try_url_decode(F.replace(host, F.lit("+"), F.lit("%2B")))
    plain = F.regexp_replace(F.lower(F.translate(decoded, _WIDE, _NARROW)), "­", "")

    def finish(name: Column) -> Column:
        labels = F.split(F.regexp_replace(name, r"\.$", ""), r"\.")
        number = F.element_at(labels, -1).rlike(NUMBER_RE)
        return F.when(number, ipv4(name)).when((F.length(name) > 0) & ~name.rlike(FORBIDDEN_RE), name)

    ascii_form = lambda n: F.array_join(F.transform(F.split(n, r"\."), punycode), ".")
    return _bind(_bind(plain, ascii_form), finish)


def canonical_host(host: Column) -> Column:
    """The host of an http(s) url as a browser writes it; null if it is invalid."""
    bracketed = host.rlike(r"^\[.*\]$")
    address = F.concat(F.lit("["), ipv6(F.substr(host, F.lit(2), F.length(host) - 2)), F.lit("]"))
    return F.when(host.rlike(PLAIN_RE), host).when(bracketed, address).otherwise(_name(host))
