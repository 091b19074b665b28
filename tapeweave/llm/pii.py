"""Format-preserving pseudonyms by a keyed Feistel permutation.

Values that prove valid (dates on the calendar, card numbers with a right check
digit, account numbers, phone numbers, network addresses, e-mail addresses,
hexadecimal secrets) are numbered within the set of values of their own format;
a Feistel network keyed with a secret permutes that set, walking on until it is
inside.  The result has the same format and validity, equal values get equal
pseudonyms in every document, different ones stay different, and only the key
can undo it.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import date

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import slices

ROUNDS = 10
#: Dates in this range are permuted among themselves, others
#: among the rest of the calendar.
MODERN = (date(1900, 1, 1).toordinal(), date(2099, 12, 31).toordinal())
LAST_DAY = date(9999, 12, 31).toordinal()
#: The classes of characters that keep their class.
CLASSES = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")

#: Month names by language, in which dates are written out; what
#: stands between day, month and year.
MONTHS = {
    "en": "January February March April May June July August September October November December".split(),
    "de": "Januar Februar März April Mai Juni Juli August September Oktober November Dezember".split(),
    "fr": "janvier février mars avril mai juin juillet août septembre octobre novembre décembre".split(),
    "es": "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre".split(),
}
_CASES = {"lower": str.lower, "title": str.title, "upper": str.upper}
_MONTH = "|".join(sorted({f(m) for own in MONTHS.values() for m in own for f in _CASES.values()}, key=lambda m: (-len(m), m)))
_WRITTEN = re.compile(rf"(?P<day>\d{{1,2}})(?P<mark>st|nd|rd|th|\.|er)?(?P<gap>\ (?:de\ )?)(?P<month>{_MONTH})(?P<gap2>,?\ (?:de\ )?)(?P<year>\d{{4}})|(?P<month2>{_MONTH})\ (?P<day2>\d{{1,2}})(?P<mark2>st|nd|rd|th)?(?P<gap3>,?\ )(?P<year2>\d{{4}})")

#: A value's borders: no word character, and no mark behind which its run of
#: digits goes on.  A slash only carries on what has slashes itself; secrets,
#: whose ends may become digits, end at any other mark next to a digit.  A date
#: may be followed by a time.
_NUMBER = re.compile(
    rf"""(?<!\w)(?<!\d[-+.])(?:
      (?:
        (?P<date>\d{{4}}(?P<sep>[-.])\d{{1,2}}(?P=sep)\d{{1,2}} | \d{{1,2}}(?P<sep2>[-.])\d{{1,2}}(?P=sep2)\d{{4}}
          | (?<!\d/)(?<![0-9A-Fa-f]{{32}}/)(?:\d{{4}}/\d{{1,2}}/\d{{1,2}} | \d{{1,2}}/\d{{1,2}}/\d{{4}})(?!/\d|/[0-9A-Fa-f]{{32}}))
        (?: (?=[Tt]\d{{2}}:?\d{{2}}) | (?!\w|[-+.]\d) )
      )
    | (?:
        (?P<written>\d{{1,2}}(?:st|nd|rd|th|\.|er)?\ (?:de\ )?(?:{_MONTH}),?\ (?:de\ )?\d{{4}} | (?:{_MONTH})\ \d{{1,2}}(?:st|nd|rd|th)?,?\ \d{{4}})
      | (?P<ipv6>(?:[0-9A-Fa-f]{{1,4}}:){{7}}[0-9A-Fa-f]{{1,4}} | (?:[0-9A-Fa-f]{{1,4}}:){{1,6}}(?::[0-9A-Fa-f]{{1,4}}){{1,6}})(?!:)
      | (?P<ip>\d{{1,3}}(?:\.\d{{1,3}}){{3}})
      | (?P<ssn>\d{{3}}-\d{{2}}-\d{{4}})
      | (?P<iban>[A-Z]{{2}}\d{{2}}(?:[A-Z0-9]{{11,30}} | (?:\ [A-Z0-9]{{4}}){{2,7}}(?:\ [A-Z0-9]{{1,3}})?))
      | (?P<phone>(?:\+\d{{1,3}}[ .-]?)?(?:\(\d{{3}}\)[ .-]?|\d{{3}}[ .-])\d{{3}}[ .-]?\d{{4}} | \+\d{{1,3}}(?:[ ]?\(\d{{1,4}}\))?(?:[ .-]\d{{1,8}}){{1,6}} | \+\d{{8,15}})
      | (?P<card>\d{{4}}(?P<sep3>[ -])\d{{4}}(?P=sep3)\d{{4}}(?P=sep3)\d{{1,7}} | \d{{4}}(?P<sep4>[ -])\d{{6}}(?P=sep4)\d{{4,5}})
      | (?P<national>0\d(?P<sep5>[ .-])\d{{2}}(?:(?P=sep5)\d{{2}}){{3}} | 0\d{{2,4}}[ -]\d{{3,4}}[ -]\d{{3,4}} | 0\d{{2,4}}[ /-]\d{{5,8}})
      | (?P<secret>[0-9a-f]{{32,128}} | [0-9A-F]{{32,128}})
      | (?P<number>\d{{9,40}})
      )(?!\w|[-+.]\d)
    )""",
    re.VERBOSE | re.ASCII,
)
_EMAIL_LEFT = re.compile(r"[A-Za-z0-9._%+-]{1,64}\Z", re.ASCII)
_EMAIL_RIGHT = re.compile(r"[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}", re.ASCII)


_KINDS = [k for k in _NUMBER.groupindex if k[:3] != "sep"]


def _account_check(number: str) -> int:
    return int("".join(str(int(c, 36)) for c in number[4:] + number[:4])) % 97


def _account_end(text: str, start: int, end: int) -> int | None:
    """Where an account number ends: in the spaced form, a group behind it may
    belong to the text."""
    while end - start >= 15:
        if _account_check(text[start:end].replace(" ", "")) == 1:
            return end
        end = text.rfind(" ", start, end)
    return None


class Permutation:
    """A keyed bijection on ``range(size)`` for every ``tweak`` and size."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _round(self, tweak: bytes, i: int, value: int, bits: int) -> int:
        data = b"%b|%d|%d|%d" % (tweak, bits, i, value)
        return int.from_bytes(hashlib.blake2b(data, key=self.key, digest_size=64).digest(), "big") & ((1 << bits) - 1)

    def _once(self, x: int, tweak: bytes, bits: int, back: bool) -> int:
        left, right, mask = x >> bits, x & ((1 << bits) - 1), (1 << bits) - 1
        for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
            if back:
                left, right = right ^ self._round(tweak, i, left, bits), left
            else:
                left, right = right, left ^ self._round(tweak, i, right, bits)
        return left << bits | right & mask

    def __call__(self, x: int, size: int, tweak: bytes, valid: Callable[[int], bool] | None = None, back: bool = False) -> int:
        bits = max(1, -(-max(1, (size - 1).bit_length()) // 2))
        while True:  # stays on the cycle of x, so it ends and stays one-to-one
            x = self._once(x, tweak, bits, back)
            if x < size and (valid is None or valid(x)):
                return x


def luhn_digit(digits: str) -> int:
    """The check digit to append to ``digits``."""
    total = sum(d if i % 2 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, reversed(digits))))
    return -total % 10


def _refill(template: str, digits: str) -> str:
    """``template`` with its digits replaced in order."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in template)


@dataclass
class Pseudonyms:
    """Finds and replaces private values; ``day_first`` reads ``3/4/2020``."""

    key: bytes
    day_first: bool = False
    back: bool = False

    def __post_init__(self):
        self.permute = Permutation(self.key)

    def _digits(self, text: str, tweak: bytes, valid: Callable[[int], bool] | None = None) -> str:
        digits = "".join(c for c in text if c.isdigit())
        size = 10 ** len(digits)
        return _refill(text, str(self.permute(int(digits), size, tweak, valid, self.back)).zfill(len(digits)))

    def _classes(self, text: str, tweak: bytes, classes: tuple[str, ...] = CLASSES) -> str:
        """Every character stays in its class; others are kept."""
        own = [next((k for k in classes if c in k), None) for c in text]
        number, size = 0, 1
        for c, k in zip(text, own):
            if k:
                number, size = number * len(k) + k.index(c), size * len(k)
        if size == 1:
            return text
        shape = "".join("." if k is None else str(classes.index(k)) for k in own).encode()
        number, out = self.permute(number, size, tweak + b"/" + shape, None, self.back), []
        for c, k in zip(reversed(text), reversed(own)):
            if k:
                number, at = divmod(number, len(k))
                c = k[at]
            out.append(c)
        return "".join(reversed(out))

    def _date(self, text: str) -> str | None:
        parts = re.split(r"[-/.]", text)
        year_first = len(parts[0]) == 4
        a, b = (int(x) for x in (parts[1:] if year_first else parts[:2]))
        month_first = year_first or (a <= 12 and not (self.day_first and b <= 12) or b > 12)
        month, day = (a, b) if month_first else (b, a)
        if not year_first and not self.day_first and a > 12:
            month, day, month_first = b, a, False
        try:
            day_no = date(int(parts[0] if year_first else parts[2]), month, day).toordinal()
        except ValueError:
            return None
        low, high = MODERN
        # a result must read back the same way, in the order and with the padding it had
        padded = all(len(p) == 2 for p in (parts[1:] if year_first else parts[:2]))

        def same_format(n: int) -> bool:
            d = date.fromordinal(n)
            return (year_first or d.day > 12 or month_first != self.day_first) and (padded or min(d.month, d.day) < 10)

        if low <= day_no <= high:
            got = low + self.permute(day_no - low, high - low + 1, b"date", lambda x: same_format(x + low), self.back)
        else:
            got = 1 + self.permute(day_no - 1, LAST_DAY, b"far date", lambda x: not low <= x + 1 <= high and same_format(x + 1), self.back)
        new, sep = date.fromordinal(got), re.search(r"[-/.]", text)[0]
        md = (new.month, new.day) if month_first else (new.day, new.month)
        first, second = (f"{x:02d}" if padded else str(x) for x in md)
        return sep.join((f"{new.year:04d}", first, second) if year_first else (first, second, f"{new.year:04d}"))

    def _written(self, text: str) -> str | None:
        """A date with its month written out, in the same language and shape."""
        m = _WRITTEN.fullmatch(text)
        day, month, year, mark = (m[k] or m[k + "2"] for k in ("day", "month", "year", "mark"))
        case = next(k for k, f in _CASES.items() if f(month) == month)
        order = ("es", "en", "de", "fr") if " de " in text else ("de", "en", "fr", "es") if mark == "." else ("fr", "en", "de", "es") if mark == "er" else ("en", "de", "fr", "es")
        tongue = lambda name: next(k for k in order if name.lower() in map(str.lower, MONTHS[k]))
        own = tongue(month)
        names = [x.lower() for x in MONTHS[own]]
        try:
            day_no = date(int(year), names.index(month.lower()) + 1, int(day)).toordinal()
        except ValueError:
            return None
        low, high = MODERN
        if not low <= day_no <= high:
            return None
        ordinal = lambda d: "th" if 10 < d % 100 < 14 else {1: "st", 2: "nd", 3: "rd"}.get(d % 10, "th")
        if mark in ("st", "nd", "rd", "th") and mark != ordinal(int(day)):
            return None

        def same_format(n: int) -> bool:
            d = date.fromordinal(n + low)
            return tongue(names[d.month - 1]) == own and (len(day) == 2) == (d.day > 9 or day[0] == "0") and (day[0] != "0" or d.day < 10) and (mark != "er" or d.day == 1)

        if not same_format(day_no - low):
            return None
        new = date.fromordinal(low + self.permute(day_no - low, high - low + 1, f"written {own}".encode(), same_format, self.back))
        shown = f"{new.day:0{len(day)}d}" + (ordinal(new.day) if mark in ("st", "nd", "rd", "th") else mark or "")
        name = _CASES[case](names[new.month - 1])
        return f"{name} {shown}{m['gap3']}{new.year}" if m["month2"] else f"{shown}{m['gap']}{name}{m['gap2']}{new.year}"

    def _ipv6(self, text: str) -> str | None:
        """Permuted as a number; written in the shortest form."""
        if len(text.replace("::", ":").split(":")) < 3 or not any(c.isdigit() for c in text):
            return None
        try:
            n = int(ipaddress.IPv6Address(text))
        except ValueError:
            return None
        # the shortest form of a result must be seen as an address again
        seen = lambda x: len(str(ipaddress.IPv6Address(x)).replace("::", ":").strip(":").split(":")) > 2 and any(c.isdigit() for c in str(ipaddress.IPv6Address(x)))
        new = str(ipaddress.IPv6Address(self.permute(n, 1 << 128, b"ipv6", seen, self.back)))
        return new.upper() if text == text.upper() else new

    def _national(self, text: str) -> str | None:
        """A number with its trunk zero, which stays; 9 to 12 digits."""
        digits = sum(c.isdigit() for c in text)
        return "0" + self._digits(text[1:], b"national") if 9 <= digits <= 12 else None

    def _ip(self, text: str) -> str | None:
        octets = text.split(".")
        if any(int(x) > 255 or (x != "0" and x[0] == "0") for x in octets):
            return None
        n = 0
        for x in octets:
            n = n << 8 | int(x)
        n = self.permute(n, 1 << 32, b"ip", None, self.back)
        return ".".join(str(n >> s & 255) for s in (24, 16, 8, 0))

    def _card(self, text: str) -> str:
        digits = "".join(c for c in text if c.isdigit())
        if not 13 <= len(digits) <= 19 or luhn_digit(digits[:-1]) != int(digits[-1]):
            # no check digit to keep; a result must not gain one, or it would read back as a card
            wrong = lambda x: not 13 <= len(digits) <= 19 or luhn_digit(str(x).zfill(len(digits))[:-1]) != x % 10
            return self._digits(text, b"number", wrong)
        body = self.permute(int(digits[:-1]), 10 ** (len(digits) - 1), b"card", None, self.back)
        body = str(body).zfill(len(digits) - 1)
        return _refill(text, body + str(luhn_digit(body)))

    def _iban(self, text: str) -> str | None:
        """Numbered without its spaces, so both forms get one pseudonym."""
        plain = text.replace(" ", "")
        if _account_check(plain) != 1:
            return None
        body = self._classes(plain[4:], b"iban " + plain[:2].encode())
        new = iter(plain[:2] + f"{98 - _account_check(plain[:2] + '00' + body):02d}" + body)
        return "".join(c if c == " " else next(new) for c in text)

    def _ssn(self, text: str) -> str | None:
        def valid(x: int) -> bool:
            area, group, serial = x // 10**6, x // 10**4 % 100, x % 10**4
            return area not in (0, 666) and area < 900 and group > 0 and serial > 0

        return self._digits(text, b"ssn", valid) if valid(int(text.replace("-", ""))) else None

    def _phone(self, text: str) -> str | None:
        if text[0] == "+" and not 8 <= sum(c.isdigit() for c in text) <= 15:
            return None
        country = re.match(r"\+\d{1,3}(?=[ .-]|\()", text)
        at = country.end() if country else 0
        return text[:at] + self._digits(text[at:], b"phone")

    def one(self, kind: str, value: str) -> str | None:
        """The pseudonym of ``value``; None where it isn't valid."""
        if kind == "secret":
            return self._classes(value, b"secret", ("0123456789abcdef",) if value == value.lower() else ("0123456789ABCDEF",))
        if kind == "email":
            left, _, right = value.partition("@")
            return self._classes(left, b"email@" + right.lower().encode()) + "@" + right
        return {"date": self._date, "ip": self._ip, "card": self._card, "number": self._card, "iban": self._iban, "ssn": self._ssn, "phone": self._phone, "national": self._national, "ipv6": self._ipv6, "written": self._written}[kind](value)

    def find(self, text: str) -> list[tuple[int, int, str]]:
        """Spans and kinds of possible values, in order, not overlapping."""
        found = []
        for m in re.finditer("@", text):
            left, right = _EMAIL_LEFT.search(text, max(0, m.start() - 64), m.start()), _EMAIL_RIGHT.match(text, m.end())
            if left and right and (not found or left.start() >= found[-1][1]):
                found.append((left.start(), right.end(), "email"))
        emails, k = list(found), 0
        at = 0
        while m := _NUMBER.search(text, at):
            end, kind = m.end(), next(k for k in _KINDS if m[k])
            if kind == "iban":
                end = _account_end(text, m.start(), end)
                if end is None:  # what is inside may be something else
                    at = m.start() + 4
                    continue
            at = end
            while k < len(emails) and emails[k][1] <= m.start():
                k += 1
            if k == len(emails) or emails[k][0] >= end:
                found.append((m.start(), end, kind))
        found.sort()
        out: list[tuple[int, int, str]] = []
        for span in found:
            if not out or span[0] >= out[-1][1]:
                out.append(span)
        return out

    def replace(self, text: str) -> tuple[str, int]:
        """The text with every valid value replaced, and their number."""
        out, at, n = [], 0, 0
        for a, b, kind in self.find(text):
            new = self.one(kind, text[a:b])
            if new is not None:
                out += [text[at:a], new]
                at, n = b, n + 1
        return ("".join([*out, text[at:]]), n) if n else (text, 0)


def pseudonymise(docs: DataFrame, key: str | bytes, day_first: bool = False, back: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text, n_values`` for each row: the text with private values
    replaced, and how many there were.  ``back=True`` undoes it with the key.

    Covered are the formats of ``_NUMBER``: dates in figures and, in English,
    German, French and Spanish, with the month written out; IPv4 and IPv6
    addresses; account numbers, also in groups of four; cards; social security
    numbers; North American, international and zero-led national phone numbers.
    Not covered: national numbers without a leading zero outside North America,
    month names cut short, two-digit years.

    Null text stays null with 0 values; an empty table gives an empty one; an empty text is empty.  Null
    identifiers pass through, repeated rows get the same answer each, other
    columns are ignored.  Texts are searched whole.  The key is a secret of the
    caller: it travels to executors inside the function.
    """
    names = Pseudonyms(key.encode() if isinstance(key, str) else key, day_first, back)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts = batch.column("text")
            counts = [0] * len(texts)
            # every kind has an @ or, if it is long enough, a digit
            maybe = pc.fill_null(pc.match_substring_regex(texts, r"[0-9@]|[A-Fa-f]{32}"), False).to_numpy(zero_copy_only=False).nonzero()[0]
            if len(maybe):
                values = texts.to_pylist()
                for i in maybe.tolist():
                    values[i], counts[i] = names.replace(values[i])
                texts = pa.array(values, pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), texts, pa.array(counts, pa.int64())], names=["doc_id", "text", "n_values"])

    rows = docs.selectExpr(f"cast(`{id_col}` as long) AS doc_id", f"cast(`{text_col}` as string) AS text")
    return rows.mapInArrow(run, "doc_id long, text string, n_values long")
