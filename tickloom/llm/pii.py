"""Format-preserving pseudonyms for personal numbers, dates and addresses.

Each validated value is mapped by a keyed Feistel permutation of the set of all
values of its format, so equal values get equal pseudonyms in every document and
different ones different, and the result is valid again: cards keep their length
and pass Luhn, IBANs pass mod 97, dates stay dates, address parts stay in range.
Values that fail validation are not personal numbers and stay.
"""

from __future__ import annotations

import bisect
import datetime
import hashlib
import math
import re
import string
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ._shared import extended, map_arrow, without
from .words import slices

Found = tuple[int, str]  # where a value ends, and its pseudonym
KINDS = ("email", "iban", "card", "phone", "ssn", "ip", "date")
ROUNDS = 8


class Feistel:
    """Keyed permutations of the integers below any bound."""

    def __init__(self, key: bytes):
        self.key = key

    def _step(self, tweak: str, r: int, half: bytes) -> hashlib.blake2b:
        return hashlib.blake2b(tweak.encode() + b"|%d|" % r + half, key=self.key)

    def permute(self, value: int, bound: int, tweak: str) -> int:
        """Image of ``value`` under the permutation of 0..bound-1 that key and tweak select.

        Rounds add alternately to the two halves of value = left * width + right;
        results outside the bound are permuted again (cycle walking).
        """
        if bound < 2:
            return value
        width = max(2, math.isqrt(bound - 1) + 1)
        size = (bound.bit_length() + 7) // 8
        while True:
            left, right = divmod(value, width)
            for r in range(ROUNDS):
                half = right if r % 2 == 0 else left
                step = int.from_bytes(self._step(f"{tweak}|{bound}", r, half.to_bytes(size, "big")).digest(), "big") % width
                if r % 2 == 0:
                    left = (left + step) % width
                else:
                    right = (right + step) % width
            value = left * width + right
            if value < bound:
                return value

    def digits(self, values: list[int], radices: list[int], tweak: str) -> list[int]:
        """The permutation of mixed-radix numbers."""
        number, bound = 0, 1
        for v, r in zip(values, radices, strict=True):
            number, bound = number * r + v, bound * r
        number = self.permute(number, bound, f"{tweak}|{radices}")
        out = []
        for r in reversed(radices):
            number, d = divmod(number, r)
            out.append(d)
        return out[::-1]

    def sequence(self, values: list[int], radices: list[int], tweak: str) -> list[int]:
        """The permutation of sequences of any length, in time that grows with the length alone.

        The halves are the front and the back; each round adds a key stream made
        from one half to the digits of the other.
        """
        if len(values) < 2:
            return [self.permute(v, r, tweak) for v, r in zip(values, radices, strict=True)]
        cut = len(values) // 2
        halves, bases = [list(values[:cut]), list(values[cut:])], [radices[:cut], radices[cut:]]
        tweak += f"|{''.join('a' if r > 10 else '0' for r in radices)}"
        for r in range(ROUNDS):
            to, by = halves[r % 2], halves[1 - r % 2]
            seed = self._step(tweak, r, bytes(by)).digest()
            stream = b"".join(hashlib.blake2b(seed + k.to_bytes(8, "big"), key=self.key).digest() for k in range(len(to) // 16 + 1))
            halves[r % 2] = [(v + int.from_bytes(stream[4 * k : 4 * k + 4], "big")) % n for k, (v, n) in enumerate(zip(to, bases[r % 2], strict=True))]
        return halves[0] + halves[1]


def luhn_check_digit(payload: str) -> str:
    total = 0
    for i, c in enumerate(reversed(payload)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def _fill(pattern: str, digits: str) -> str:
    """The digits of ``pattern`` replaced in order, all else as it is."""
    new = iter(digits)
    return "".join(next(new) if c.isdigit() else c for c in pattern)


def card(f: Feistel, m: re.Match) -> Found | None:
    """Numbers that pass Luhn: of 16 digits any, of other lengths those that begin like payment cards (2 to 6).

    The first digit, which names the issuer's industry, stays. Of groups four by four, a last group that makes the number invalid is another
    number and stays.
    """
    d, text = re.sub(r"\D", "", m[0]), m[0]
    if m[1] and len(d) > 16 and luhn_check_digit(d[:-1]) != d[-1]:
        d, text = d[:16], text[:19]
    if not 13 <= len(d) <= 19 or luhn_check_digit(d[:-1]) != d[-1] or (len(d) != 16 and d[0] not in "23456"):
        return None
    payload = d[0] + "".join(map(str, f.digits([int(c) for c in d[1:-1]], [10] * (len(d) - 2), f"card{d[0]}")))
    return m.start() + len(text), _fill(text, payload + luhn_check_digit(payload))


# Country calling codes of one and two digits; all others have three.
SHORT_CODES = {
    "1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "53", "54", "55", "56", "57", "58",
    "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "93", "94", "95", "98",
}

# Digits after the country code, where all numbers of a country have as many.
NATIONAL_DIGITS = {"1": 10, "7": 10, "30": 10, "31": 9, "33": 9, "34": 9, "41": 9, "44": 10, "45": 8, "47": 8, "48": 9, "52": 10, "57": 10, "61": 9, "65": 8, "86": 11, "90": 10, "91": 10}


def _by_country(text: str) -> tuple[str, str]:
    """The digits without a trunk prefix, and the country code that they begin with."""
    number = re.sub(r"\(0\)|\D", "", text)
    return number, next((number[:n] for n in (1, 2) if number[:n] in SHORT_CODES), number[:3])


def phone(f: Feistel, m: re.Match) -> Found | None:
    """Country code and signs stay, wherever groups begin. Ten digits after +1, and national numbers in groups of 3, 3 and 4, are one set of numbers.

    In that set the first digits of area and exchange stay 0 or 1, or 2 to 9, so numbers that can be assigned stay such. National numbers with
    dots or spaces only could be other numbers and must be such that can be assigned. Groups after a space that exceed the country's digits,
    where they are fixed, or 15 digits in all, are another number. A trunk prefix ``(0)`` is no part of it.
    """
    text, country = m[0], "1"
    rest = re.sub(r"\D", "", text)[-10:]
    if m["plus"]:
        ends = sorted([len(m[0]), *(g.start() for g in re.finditer(r"\x20", m[0]))], reverse=True)
        country = _by_country(m[0])[1]
        exact = [e for e in ends if len(_by_country(m[0][:e])[0]) == NATIONAL_DIGITS.get(country, 99) + len(country)]
        end = next(iter(exact), None) or next((e for e in ends if len(_by_country(m[0][:e])[0]) <= 15), 0)
        text = m[0][:end]
        rest = _by_country(text)[0][len(country) :]
    if not 7 <= len(country) + len(rest) <= 15 or len(rest) < 6 or (country == "1" and len(rest) != 10):
        return None
    low, radices = [0] * len(rest), [10] * len(rest)
    if country == "1":
        if not m["plus"] and "(" not in text and text.count("-") < 2 and (rest[0] in "01" or rest[3] in "01"):
            return None
        for i in (0, 3):
            low[i], radices[i] = (0, 2) if rest[i] in "01" else (2, 8)
    new = f.digits([int(c) - a for c, a in zip(rest, low, strict=True)], radices, f"phone{country}")
    made = "".join(str(v + a) for v, a in zip(new, low, strict=True))
    mask = text.replace("(0)", "(o)")
    kept = re.sub(r"\D", "", mask)[: -len(rest)]
    return m.start() + len(text), _fill(mask, kept + made).replace("(o)", "(0)")


def ssn(f: Feistel, m: re.Match) -> Found | None:
    area, group, serial = (int(x) for x in m[0].split("-"))
    if not 0 < area < 900 or area == 666 or not group or not serial:
        return None
    a, g, s = f.digits([area - 1 - (area > 666), group - 1, serial - 1], [898, 99, 9999], "ssn")
    return m.end(), f"{a + 1 + (a >= 665):03d}-{g + 1:02d}-{s + 1:04d}"


def ip(f: Feistel, m: re.Match) -> Found | None:
    parts = [int(x) for x in m[0].split(".")]
    if max(parts) > 255 or any(len(x) > 1 and x[0] == "0" for x in m[0].split(".")):
        return None
    return m.end(), ".".join(map(str, f.digits(parts, [256] * 4, "ip")))


# Lengths of IBANs by country.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29,
    "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20,
    "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29,
    "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}


def iban(f: Feistel, m: re.Match) -> Found | None:
    """Letters are permuted among letters, digits among digits; the check digits follow from the result."""
    raw = m[0].replace(" ", "")
    if len(raw) != IBAN_LENGTHS[raw[:2]] or int("".join(str(int(c, 36)) for c in raw[4:] + raw[:4])) % 97 != 1:
        return None
    body = raw[4:]
    radices = [10 if c.isdigit() else 26 for c in body]
    new = f.digits([int(c) if c.isdigit() else ord(c) - 65 for c in body], radices, f"iban{raw[:2]}")
    body = "".join(str(v) if r == 10 else chr(65 + v) for v, r in zip(new, radices, strict=True))
    check = 98 - int("".join(str(int(c, 36)) for c in body + raw[:2] + "00")) % 97
    new_all = iter(f"{raw[:2]}{check:02d}{body}")
    return m.end(), "".join(" " if c == " " else next(new_all) for c in m[0])


def _iban_pattern() -> re.Pattern:
    """One alternative for each length, so that a number ends where its country says."""
    by_length: dict[int, list[str]] = {}
    for country, n in IBAN_LENGTHS.items():
        by_length.setdefault(n, []).append(country)
    parts = [f"(?:{'|'.join(c)})[0-9]{{2}}(?:\\x20?[A-Z0-9]){{{n - 4}}}" for n, c in sorted(by_length.items())]
    return re.compile(rf"(?<![A-Za-z0-9])(?:{'|'.join(parts)})(?![A-Za-z0-9])")


def email(f: Feistel, m: re.Match) -> Found | None:
    """Letters of the name are permuted among letters, digits among digits; the domain and other signs stay."""
    name = m["name"]
    at = [i for i, c in enumerate(name) if c.isascii() and c.isalnum()]
    if not at:
        return None
    radices = [10 if name[i].isdigit() else 26 for i in at]
    new = f.sequence([int(name[i]) if r == 10 else ord(name[i].lower()) - 97 for i, r in zip(at, radices, strict=True)], radices, f"email{m['domain'].lower()}")
    out = list(name)
    for i, r, v in zip(at, radices, new, strict=True):
        out[i] = str(v) if r == 10 else chr(v + (65 if name[i].isupper() else 97))
    return m.end(), f"{''.join(out)}@{m['domain']}"


#: Days from 1900 to 2099, those up to the 12th of a month and the later ones.
_DAYS: tuple[list[int], list[int]] = ([], [])
for _day in range(datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal() + 1):
    _DAYS[datetime.date.fromordinal(_day).day > 12].append(_day)


def date(f: Feistel, m: re.Match) -> Found | None:
    """Days from 1900 to 2099 are permuted; year first, or day first with dots or slashes, or else month first.

    Days up to the 12th and later ones are permuted each among themselves, so that month-first dates, whose day is above 12, stay readable as such.
    """
    parts = re.split(r"(\D)", m[0])
    orders = ((0, 2, 4),) if len(parts[0]) == 4 else ((4, 2, 0), (4, 0, 2))
    for order in orders:
        try:
            day = datetime.date(*(int(parts[i]) for i in order))
        except ValueError:
            continue
        break
    else:
        return None
    if not 1900 <= day.year <= 2099:
        return None
    days = _DAYS[day.day > 12]
    new = datetime.date.fromordinal(days[f.permute(bisect.bisect_left(days, day.toordinal()), len(days), "date")])
    for i, v in zip(order, (f"{new.year:04d}", f"{new.month:02d}", f"{new.day:02d}"), strict=True):
        parts[i] = v
    return m.end(), "".join(parts)


# Cards: one run of 13 to 19 digits, or groups as they are printed (four by four, or 4-6-5 and 4-6-4) with one separator throughout.
CARD = re.compile(r"(?<![0-9.+])(?:[0-9]{13,19}|[0-9]{4}([\x20-])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?:\1[0-9]{1,3})?|[0-9]{4}([\x20-])[0-9]{6}\2[0-9]{4,5})(?![0-9])")
# Phones: groups after a country code, or national groups of 3, 3 and 4 digits.
PHONE = re.compile(
    r"(?<![0-9+])(?P<plus>\+)[1-9][0-9]{0,14}(?:[\x20.-]?\([0-9]{1,4}\)[\x20.-]?[0-9]+)?(?:[.-][0-9]+|\x20[0-9]{2,}|(?:(?<=^\+[0-9])|(?<=\+[0-9]{2})|(?<=\+[0-9]{3}))\x20[0-9])*(?![0-9])"
    r"|(?<![0-9+])(?<![0-9][./-])(?:1[\x20.-])?(?:\([0-9]{3}\)[\x20.-]?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9]|[./-][0-9])"
)
RULES: dict[str, tuple[re.Pattern, Callable[[Feistel, re.Match], Found | None]]] = {
    "iban": (_iban_pattern(), iban),
    "card": (CARD, card),
    "phone": (PHONE, phone),
    "ssn": (re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"), ssn),
    "ip": (re.compile(r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.?[0-9])"), ip),
    "date": (re.compile(r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![0-9/-]|\.[0-9])"), date),
}
EMAIL = re.compile(r"(?P<name>[A-Za-z0-9._%+\-À-ɏ]+)@(?P<domain>[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)*\.[A-Za-z]{2,})")
_NAME = string.ascii_letters + string.digits + "._%+-" + "".join(map(chr, range(0xC0, 0x250)))
_NUMERIC = re.compile(r"[+A-Z]{0,2}[0-9](?:[\x20.()/-]{0,2}[A-Z0-9]){3,}")


def _name_start(text: str, at: int) -> int:
    """Where the name before an ``@`` begins, however long it is."""
    low, size = at, 64
    while low:
        front = max(0, at - size)
        low = front + len(text[front:at].rstrip(_NAME))
        if low > front:
            break
        size *= 4
    return low


def pseudonymise(text: str, f: Feistel) -> tuple[str, dict[str, int]]:
    """The text with pseudonyms, and how many values of each kind it had.

    Numeric formats are tried only inside stretches of digits and the signs that
    join them, and addresses only around an ``@``. Earlier kinds win overlaps.
    """
    found: list[tuple[int, int, str, str]] = []  # sorted and apart

    def place(start: int, end: int) -> int | None:
        """Where a value belongs in ``found``; None if it overlaps one there."""
        i = bisect.bisect_left(found, (end,))
        return None if i and found[i - 1][1] > start else i

    at = text.find("@")
    while at >= 0:
        m = EMAIL.match(text, _name_start(text, at))
        if m and m.end("name") == at and (i := place(m.start(), m.end())) is not None and (new := email(f, m)) is not None:
            found.insert(i, (m.start(), m.end(), "email", new[1]))
        at = text.find("@", at + 1)
    for zone in _NUMERIC.finditer(text):
        for kind, (pattern, rule) in RULES.items():
            at, end = max(0, zone.start() - 2), min(len(text), zone.end() + 2)
            while m := pattern.search(text, at, end):
                new = rule(f, m)
                at = new[0] if new else m.end()  # what a value leaves of its match can hold another
                if new and (i := place(m.start(), at)) is not None:
                    found.insert(i, (m.start(), at, kind, new[1]))
    counts = dict.fromkeys(KINDS, 0)
    out, done = [], 0
    for a, b, kind, new in found:
        out += [text[done:a], new]
        counts[kind] += 1
        done = b
    return "".join([*out, text[done:]]), counts


def pseudonymise_documents(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """All columns of ``docs``, the text with pseudonyms, and ``n_email, n_iban, ...`` per kind.

    One pass without a shuffle: equal values are linked by the key alone, which
    the caller keeps secret. A null text stays null, an empty one empty; counts
    are then 0. Texts of any length, and names in addresses of any length, are
    handled whole. Of overlapping values the earlier kind of ``KINDS`` wins.
    Repeated rows are each replaced alike, and an empty table gives an empty
    result. An input column with one of the new names is replaced. Texts without
    ``@`` and without digit stretches are unchanged.
    """
    names = [f"n_{k}" for k in KINDS]
    docs = without(docs, tuple(names))
    at = docs.columns.index(text_col)
    secret = hashlib.blake2b(key.encode(), digest_size=32).digest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Feistel(secret)
        for batch in batches:
            for part in slices(batch, at):
                found = [pseudonymise(t, f) if t else (t, dict.fromkeys(KINDS, 0)) for t in part.column(at).to_pylist()]
                columns = list(part.columns)
                columns[at] = pa.array([t for t, _ in found], part.schema.field(at).type)
                yield pa.RecordBatch.from_arrays([*columns, *(pa.array([n[k] for _, n in found], pa.int64()) for k in KINDS)], [*part.schema.names, *names])

    return map_arrow(docs, run, extended(docs.schema, ", ".join(f"{n} bigint" for n in names)))
