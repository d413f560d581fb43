"""Format-preserving pseudonyms for personal data.

Values found in texts are validated and then permuted within the set of valid values of their
format by a keyed Feistel network, so equal values (but for case) get equal pseudonyms in all
documents, two different ASCII values never share one, and the key's holder can undo it
(``Pseudonyms(key).undo``).

  card     13 to 19 digits that pass the Luhn test, plain or in groups of 4-4-4-4 or 4-6-5 with one
           separator: all but the check digit are permuted, which is then computed anew
  iban     country code kept, account part permuted by class, check digits (mod 97) computed anew
  ssn      ddd-dd-dddd with a valid area, group and serial: stays valid
  phone    +country (area) number, + and 8 to 15 digits, and (ddd) ddd-dddd, ddd-ddd-dddd and ddd.ddd.dddd with or without a 1 in
           front: the last ten digits are permuted, but for at least one behind a +; numbers in other groups stay
  ip       four octets of 0 to 255: permuted as 32 bits
  date     yyyy-mm-dd, dd/mm/yyyy, mm/dd/yyyy and dd.mm.yyyy that exist in 1900 to 2099: permuted
           among the days of these years, in their own format; with slashes, day first if possible; of a
           timestamp (yyyy-mm-ddThh), the time stays
  email    letters and digits of the local part and of all labels but the last are permuted each
           within their class; letters beyond ASCII become ASCII ones chosen by the value
  secret   hexadecimal strings of 32 to 64 digits with letters and digits, and values of 16
           characters or more that are assigned to token, key, secret or password: by class

Numbers that fail their validation stay as they are.  Texts without a digit and an @ never leave
the JVM; the others pass through one Arrow function.

Nulls, ties and odd rows: null and empty texts stay; a text of any length is searched whole, in linear time; where two formats overlap, the one that
starts first wins, then the order secret, email, iban, date, ip, phone, ssn, card; repeated rows
are treated alike.  ``n_chars``, if there, follows a changed text; other columns are passed on,
but one named pseudonyms (the number of values replaced), in any case, gives way.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from datetime import date
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webloom.session import prepare

_ROUNDS = 10
_DIGITS, _LETTERS, _HEX = "0123456789", "abcdefghijklmnopqrstuvwxyz", "0123456789abcdef"
_SEP = r"[^\w\n]{1,5}"
_PATTERN = re.compile(
    r"""(?P<assigned>\b(?:token|api[_-]?key|key|secret|password)\W{1,8}(?P<value>[A-Za-z0-9_\-]{16,}))
    |(?P<hex>(?<![0-9A-Za-z])(?:[0-9a-f]{32,64}|[0-9A-F]{32,64})(?![0-9A-Za-z]))
    |(?P<email>(?<![\w.+%-])[\w+%-][\w.+%-]*@(?:[^\W_](?:[\w-]*[^\W_])?\.)+[A-Za-z]{2,})
    |(?P<iban>(?<!\w)[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\ [A-Z0-9]{4}){2,7}(?:\ [A-Z0-9]{1,4})?)(?!\w))
    |(?P<iso>(?<![\w-])(?P<y1>[0-9]{4})-(?P<m1>[0-9][0-9])-(?P<d1>[0-9][0-9])(?=T[0-9]|(?![\w-])))
    |(?P<slash>(?<![\w/])(?P<d2>[0-9]{1,2})/(?P<m2>[0-9]{1,2})/(?P<y2>[0-9]{4})(?![\w/]))
    |(?P<dots>(?<![\w.])(?P<d3>[0-9]{1,2})\.(?P<m3>[0-9]{1,2})\.(?P<y3>[0-9]{4})(?!\w|\.[0-9]))
    |(?P<ip>(?<![\w.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\w|\.[0-9]))
    |(?P<phone>\+[0-9]{1,3}"""
    + _SEP
    + r"""[0-9]{3}"""
    + _SEP
    + r"""[0-9]{3}[-.\ ][0-9]{4}(?!\w)
        |(?<!\w)\+[0-9]{8,15}(?!\w)
        |(?<![\w.-])(?:1[-.\ ])?(?:\([0-9]{3}\)\ ?[0-9]{3}-|[0-9]{3}(?P<sep3>[-.])[0-9]{3}(?P=sep3))[0-9]{4}(?![\w-]|\.[0-9]))
    |(?P<ssn>(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-]))
    |(?P<card>(?<![\w.])(?:[0-9]{13,19}|[0-9]{4}(?P<sep>[\ -])[0-9]{4}(?P=sep)[0-9]{4}(?P=sep)[0-9]{4}|[0-9]{4}(?P<sep2>[\ -])[0-9]{6}(?P=sep2)[0-9]{5})(?!\w))
    """,
    re.VERBOSE | re.IGNORECASE,
)


def luhn(digits: str) -> int:
    """The check digit that belongs behind the digits."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 - i % 2)
        total += d - 9 * (d > 9)
    return -total % 10


def _is_hex(text: str) -> bool:
    """Whether a string is hexadecimal in one case."""
    return text in (text.lower(), text.upper()) and all(c in _HEX for c in text.lower())


def _mod97(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text)) % 97


def _matches(text: str) -> Iterator[re.Match]:
    """The matches in order.  What is replaced holds a digit or an @, so the pattern is tried only around these and around
    the words of an assignment, whose value is passed over even if it stays.

    Before its first one of them, a match has no more than the run of characters that it stands in; behind its last one, no
    more than that run and the rest of a group.  A window ends where a run does, so that none cuts a value short.
    """
    end = len(text)
    done, a, z, run = 0, -1, -1, -1
    starts = _Runs(text)
    for m in _HINT.finditer(text):
        if m.start() >= z:
            if a >= 0:
                for found in _PATTERN.finditer(text, max(a, done), z):
                    done = found.end()
                    yield found
            a = max(starts.before(m.start()) - _LEAD, 0)
        if m.end() > run:
            run = _run_end(text, m.end())
            z = _run_end(text, min(run + _TAIL, end))
    if a >= 0:
        yield from _PATTERN.finditer(text, max(a, done), z)


_HINT = re.compile(r"[0-9@]+|token|key|secret|password", re.IGNORECASE)
_SPACE = re.compile(r"\s")
_LEAD, _TAIL = 24, 48


class _Runs:
    """Where the run of other characters than space, line feed and tab begins that a position stands in; positions ascend, so each character is looked at once."""

    def __init__(self, text: str):
        self.text, self.at, self.last = text, 0, -1

    def before(self, at: int) -> int:
        self.last = max(self.last, *(self.text.rfind(c, self.at, at) for c in " \n\t"))
        self.at = at
        return self.last + 1


def _run_end(text: str, at: int) -> int:
    m = _SPACE.search(text, at)
    return m.start() if m else len(text)


class Pseudonyms:
    def __init__(self, key: bytes, inverse: bool = False):
        self.key, self.inverse = hashlib.blake2b(key, digest_size=32).digest(), inverse

    def undo(self) -> Callable[[str], tuple[str, int]]:
        other = Pseudonyms(b"", True)
        other.key = self.key
        return other.text

    def _round(self, i: int, tweak: bytes, half: int, most: int) -> int:
        raw = hashlib.blake2b(b"%d|%d|" % (i, half) + tweak, key=self.key, digest_size=32).digest()
        return int.from_bytes(raw, "big") % most

    def number(self, x: int, size: int, tweak: bytes) -> int:
        """A keyed permutation of 0 to size - 1: a Feistel network over a product of two near-square halves, walked until inside."""
        if size < 2:
            return x
        a = 1
        while a * a < size:
            a <<= 1
        while True:
            left, right = divmod(x, a)
            if self.inverse:
                for i in reversed(range(_ROUNDS)):
                    left, right = (right - self._round(i, tweak, left, a)) % a, left
            else:
                for i in range(_ROUNDS):
                    left, right = right, (left + self._round(i, tweak, right, a)) % a
            x = left * a + right
            if x < size:
                return x

    def string(self, text: str, alphabet: str, tweak: bytes) -> str:
        """Permutes the strings of one length over an alphabet."""
        base, n = len(alphabet), len(text)
        x = 0
        for c in text:
            x = x * base + alphabet.index(c)
        x = self.number(x, base**n, tweak + b"|%d" % n)
        out = []
        for _ in range(n):
            x, r = divmod(x, base)
            out.append(alphabet[r])
        return "".join(reversed(out))

    def classes(self, text: str, tweak: bytes, hexa: bool = False) -> str:
        """Permutes letters and digits each within their class; case and all else stay in place."""
        low = text.lower()
        odd = "".join(c for c in low if c.isalpha() and c not in _LETTERS)
        groups = [_HEX] if hexa else [_LETTERS, _DIGITS]
        out = list(low)
        for g in groups:
            at = [i for i, c in enumerate(low) if c in g]
            mark = tweak + b"|" + g[:1].encode() + odd.encode()
            for i, c in zip(at, self.string("".join(low[i] for i in at), g, mark), strict=True):
                out[i] = c
        for k, i in enumerate(i for i, c in enumerate(low) if c.isalpha() and c not in _LETTERS):
            out[i] = _LETTERS[self._round(k, odd.encode(), i, 26)]
        if hexa and text.isupper():
            return "".join(out).upper()
        return "".join(o.upper() if c.isupper() else o for o, c in zip(out, text, strict=True)) if len(low) == len(text) else "".join(out)

    def _into(self, text: str, digits: str) -> str:
        """The text with its digits replaced, in order."""
        it = iter(digits)
        return "".join(next(it) if c in _DIGITS else c for c in text)

    def card(self, text: str) -> str | None:
        d = "".join(c for c in text if c in _DIGITS)
        if luhn(d[:-1]) != int(d[-1]):
            return None
        body = self.string(d[:-1], _DIGITS, b"card")
        return self._into(text, body + str(luhn(body)))

    def iban(self, text: str) -> str | None:
        flat = text.replace(" ", "").upper()
        if not text.isascii() or not 15 <= len(flat) <= 34 or _mod97(flat[4:] + flat[:4]) != 1 or int(flat[2:4]) not in range(2, 99):
            return None
        body = self.classes(flat[4:], b"iban" + flat[:2].encode())
        new = iter(flat[:2] + f"{98 - _mod97(body + flat[:2] + '00'):02d}" + body)
        return "".join(c if c == " " else next(new) for c in text)

    def ssn(self, text: str) -> str | None:
        a, g, s = map(int, text.split("-"))
        if a in (0, 666) or a >= 900 or not g or not s:
            return None
        area = a - 1 - (a > 666)
        x = self.number((area * 99 + g - 1) * 9999 + s - 1, 898 * 99 * 9999, b"ssn")
        x, s = divmod(x, 9999)
        area, g = divmod(x, 99)
        return f"{area + 1 + (area >= 665):03d}-{g + 1:02d}-{s + 1:04d}"

    def phone(self, text: str) -> str:
        d = "".join(c for c in text if c in _DIGITS)
        code = d[: max(len(d) - 10, text[0] == "+")]
        return self._into(text, code + self.string(d[len(code) :], _DIGITS, b"phone" + code.encode()))

    def ip(self, text: str) -> str | None:
        octets = [int(x) for x in text.split(".")]
        if max(octets) > 255 or any(len(x) > 1 and x[0] == "0" for x in text.split(".")):
            return None
        x = self.number(int.from_bytes(bytes(octets), "big"), 1 << 32, b"ip")
        return ".".join(str(b) for b in x.to_bytes(4, "big"))

    def day(self, y: int, m: int, d: int) -> date | None:
        try:
            was = date(y, m, d)
        except ValueError:
            return None
        first, last = date(1900, 1, 1).toordinal(), date(2099, 12, 31).toordinal()
        if not first <= was.toordinal() <= last:
            return None
        return date.fromordinal(first + self.number(was.toordinal() - first, last - first + 1, b"date"))

    def _date(self, m: re.Match) -> str | None:
        if m["iso"]:
            new = self.day(int(m["y1"]), int(m["m1"]), int(m["d1"]))
            return new and new.isoformat()
        if m["dots"]:
            new = self.day(int(m["y3"]), int(m["m3"]), int(m["d3"]))
            return new and f"{new.day:02d}.{new.month:02d}.{new.year}"
        a, b, y = int(m["d2"]), int(m["m2"]), int(m["y2"])
        if 1 <= b <= 12:
            new = self.day(y, b, a)
            return new and f"{new.day:02d}/{new.month:02d}/{new.year}"
        new = self.day(y, a, b)
        if not new:
            return None
        # a month-first date must stay one, or it would be read day first: move on to a day that can't be a month
        while new.day <= 12:
            new = date.fromordinal(date(1900, 1, 1).toordinal() + self.number(new.toordinal() - date(1900, 1, 1).toordinal(), 73049, b"date"))
        return f"{new.month:02d}/{new.day:02d}/{new.year}"

    def _email(self, text: str) -> str:
        head, _, top = text.rpartition(".")
        return self.classes(head, b"email" + top.lower().encode()) + "." + top

    def _one(self, m: re.Match) -> str | None:
        kind, text = m.lastgroup, m.group()
        if m["assigned"] is not None:
            value = m["value"]
            if not (value.isascii() and any(c in _DIGITS for c in value) and any(c.isalpha() for c in value)):
                return None
            return text[: -len(value)] + self.classes(value, b"secret", _is_hex(value))
        if m["hex"] is not None:
            ok = text.isascii() and any(c in _DIGITS for c in text) and any(c.isalpha() for c in text)
            return self.classes(text, b"secret", _is_hex(text)) if ok else None
        if m["email"] is not None:
            return self._email(text)
        if m["iban"] is not None:
            return self.iban(text)
        if m["iso"] is not None or m["slash"] is not None or m["dots"] is not None:
            return self._date(m)
        for kind in ("ip", "phone", "ssn", "card"):
            if m[kind] is not None:
                return getattr(self, kind)(text)
        return None

    def text(self, text: str) -> tuple[str, int]:
        """The text with its values replaced, and how many were."""
        out, at, done = [], 0, 0
        for m in _matches(text):
            new = self._one(m)
            if new is not None:
                out += [text[at : m.start()], new]
                at, done = m.end(), done + 1
        return ("".join([*out, text[at:]]), done) if done else (text, 0)


@cache
def _pseudonyms(key: bytes) -> Pseudonyms:
    return Pseudonyms(key)


_FOUND = T.StructType([T.StructField("text", T.StringType()), T.StructField("n", T.IntegerType())])


def _udf(key: bytes) -> Callable[[Column], Column]:
    @F.arrow_udf(_FOUND)
    def found(text: pa.Array) -> pa.Array:
        one = _pseudonyms(key).text
        pairs = [(None, 0) if t is None else one(t) for t in text.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([t if n else None for t, n in pairs], pa.string()), pa.array([n for _, n in pairs], pa.int32())], names=["text", "n"])

    return found


def pseudonymise(docs: DataFrame, key: bytes) -> DataFrame:
    """docs with personal data in ``text`` replaced, and ``pseudonyms``, the number of values replaced."""
    prepare(docs.sparkSession)
    text = F.col("text").cast("string")
    maybe = F.when(text.rlike("[0-9@]"), text)
    keep = [c for c in docs.columns if c.lower() != "pseudonyms"]
    found = docs.select(*[F.col(f"`{c}`") for c in keep]).withColumn("__wl_found", _udf(key)(maybe))
    new = {"text": F.coalesce(F.col("__wl_found.text"), F.col("text")), "n_chars": F.when(F.col("__wl_found.n") > 0, F.length(F.col("__wl_found.text"))).otherwise(F.col("n_chars"))}
    return found.select(*[new.get(c, F.col(f"`{c}`")).alias(c) for c in keep], F.coalesce(F.col("__wl_found.n"), F.lit(0)).alias("pseudonyms"))
