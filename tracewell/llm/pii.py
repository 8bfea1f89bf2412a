"""Operator 6. Personal data replaced by format-preserving Feistel pseudonyms.

Numbers and dates that pass their validation are permuted, under a key, among the values of their own format: cards keep their length and Luhn check, dates stay calendar
dates, addresses keep their separators. The permutation is a bijection, so equal values get equal pseudonyms in all documents and different ones stay different, and `restored_documents` undoes it with the same key. No shuffle, no
state: documents are rewritten where they are read.

Kinds: e-mail addresses (the local part: letters among letters, digits among digits; the domain stays), payment cards (whole groups of 13 to 19 digits, Luhn, whatever digit groups stand next to them), IBANs (registered length, mod 97), US social security numbers, IPv4 and
IPv6 addresses, access keys (AKIA and 16 characters), dates of the years 1900 to 2099 (year-month-day; day.month.year and month/day/year, or day/month/year if there is no such month, of one or two digits; with full English, German, French or Spanish month names and short English ones), phone
numbers (+ and 7 to 15 digits in any grouping; with an area code in the North American plan; with a trunk 0 and 9 to 12 digits in groups; Spanish ones of nine digits in groups). A number that fails its validation stays as it is.

A pseudonym keeps what its format needs: the lengths of day and month, the language of a month's name, a country code, a trunk 0. Values are looked for at each place once, earlier kinds first; work is linear in a text's length.

Null texts stay null; a text with nothing found is returned byte for byte. Repeated rows get equal results. Other columns pass through `pseudonymised_documents`, whatever their names; a column n_replaced is replaced.
"""

from __future__ import annotations

import bisect
import datetime
import hashlib
import ipaddress
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import blocks, fields, numbered, text_buffer

ROUNDS = 8

_DIGITS = "0123456789"
_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_UPPER = _DIGITS + _LETTERS.upper()

#: Start, end and replacement of what is found inside a match.
Parts = list[tuple[int, int, str]]


class Cipher:
    """A keyed permutation of range(size) for each tweak and size: a Feistel network over the next even number of bits, walked until it comes back into the range; or its inverse."""

    def __init__(self, key: bytes, inverse: bool = False):
        if not key:
            raise ValueError("pseudonyms need a key")
        self.key = hashlib.blake2b(key, digest_size=32).digest()
        self.inverse = inverse

    def __call__(self, x: int, size: int, tweak: str) -> int:
        if size < 2:
            return x
        half = max(1, ((size - 1).bit_length() + 1) // 2)
        mask, width = (1 << half) - 1, (half + 7) // 8
        salt = hashlib.blake2b(f"{tweak}/{size}".encode(), digest_size=16).digest()

        def mixed(r: int, value: int) -> int:
            return int.from_bytes(hashlib.blake2b(value.to_bytes(width, "big"), key=self.key, person=b"%d" % r, salt=salt, digest_size=max(8, width)).digest(), "big") & mask

        while True:
            left, right = x >> half, x & mask
            if self.inverse:
                for r in reversed(range(ROUNDS)):
                    left, right = right ^ mixed(r, left), left
            else:
                for r in range(ROUNDS):
                    left, right = right, left ^ mixed(r, right)
            x = left << half | right
            if x < size:
                return x


def _string(text: str, alphabets: list[str], cipher: Cipher, tweak: str) -> str:
    """Permute a string among those whose characters come from the same alphabets, place by place."""
    number, size = 0, 1
    for c, a in zip(text, alphabets):
        number, size = number * len(a) + a.index(c), size * len(a)
    number, out = cipher(number, size, tweak), []
    for a in reversed(alphabets):
        number, i = divmod(number, len(a))
        out.append(a[i])
    return "".join(reversed(out))


def _digits(text: str, cipher: Cipher, tweak: str, valid: Callable[[str], bool] = lambda d: True) -> str:
    """Permute a string of digits among the valid ones of its length."""
    while True:
        text = _string(text, [_DIGITS] * len(text), cipher, f"{tweak}{len(text)}")
        if valid(text):
            return text


def _refill(shape: str, digits: str) -> str:
    """shape with its digits replaced, in order."""
    left = iter(digits)
    return "".join(next(left) if c in _DIGITS else c for c in shape)


def luhn_digit(payload: str) -> str:
    total = sum(sum(divmod(int(d) * (2 - i % 2), 10)) for i, d in enumerate(reversed(payload)))
    return str(-total % 10)


def _card(m: str, cipher: Cipher) -> str | None:
    d = re.sub(r"\D", "", m)
    if not 13 <= len(d) <= 19 or luhn_digit(d[:-1]) != d[-1] or not d.strip("0"):
        return None
    new = _digits(d[:-1], cipher, "card")
    return _refill(m, new + luhn_digit(new))


def _cards(m: str, cipher: Cipher) -> Parts:
    """The cards in a run of digit groups: whole groups of 13 to 19 digits in all that are right, longer ones first."""
    groups = [g.span() for g in re.finditer(r"\d+", m, re.ASCII)]
    some = []
    for i, (a, _) in enumerate(groups):
        n = 0
        for c, b in groups[i:]:
            n += b - c
            if n > 19:
                break
            if n >= 13 and (new := _card(m[a:b], cipher)) is not None:
                some.append((-n, a, b, new))
    out: Parts = []
    taken = np.zeros(len(m), bool)
    for _, a, b, new in sorted(some):
        if not taken[a:b].any():
            taken[a:b] = True
            out.append((a, b, new))
    return out


def _iban_check(country: str, account: str) -> str:
    return f"{98 - int(''.join(str(int(c, 36)) for c in account + country) + '00') % 97:02d}"


#: Registered lengths of IBANs by country.
_IBAN_LENGTHS = {
    c: n
    for n, countries in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
        24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for c in countries.split()
}


def _iban(m: str, cipher: Cipher) -> Parts:
    """The IBAN that m begins with: of its country's length, or for other countries the longest that is right."""
    at = [i for i, c in enumerate(m) if c != " "]
    for n in [_IBAN_LENGTHS[m[:2]]] if m[:2] in _IBAN_LENGTHS else range(34, 14, -1):
        if n > len(at) or m[at[n - 1] + 1 : at[n - 1] + 2].isalnum():
            continue
        shape = m[: at[n - 1] + 1]
        flat = shape.replace(" ", "")
        if flat.isupper() and _iban_check(flat[:2], flat[4:]) == flat[2:4]:
            new = _string(flat[4:], [_DIGITS if c in _DIGITS else _UPPER[10:] for c in flat[4:]], cipher, f"iban{flat[:2]}")
            left = iter(flat[:2] + _iban_check(flat[:2], new) + new)
            return [(0, len(shape), "".join(c if c == " " else next(left) for c in shape))]
    return []


def _ssn_valid(d: str) -> bool:
    return d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"


def _ssn(m: str, cipher: Cipher) -> str | None:
    d = m.replace("-", "")
    return _refill(m, _digits(d, cipher, "ssn", _ssn_valid)) if _ssn_valid(d) else None


#: Country codes of two digits; 1 and 7 have one, the rest three.
_TWO_DIGITS = set("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())


def _phone(m: str, cipher: Cipher) -> str | None:
    d = re.sub(r"\D", "", m)
    keep = 0 if m[0] != "+" else 1 if d[0] in "17" else 2 if d[:2] in _TWO_DIGITS else 3
    return _refill(m, d[:keep] + _digits(d[keep:], cipher, "phone"))


def _national(m: str, cipher: Cipher) -> str | None:
    d = re.sub(r"\D", "", m)
    if d[0] == "0":
        return _refill(m, "0" + _digits(d[1:], cipher, "phone0", lambda x: x[0] != "0")) if 9 <= len(d) <= 12 else None
    if len(d) == 10:
        return _refill(m, _digits(d, cipher, "phone1", lambda x: x[0] in "23456789" and x[3] in "23456789"))
    return _refill(m, _digits(d, cipher, "phone34", lambda x: x[0] in "6789"))


def _ip(m: str, cipher: Cipher) -> str | None:
    octets = m.split(".")
    if any(int(o) > 255 or (len(o) > 1 and o[0] == "0") for o in octets):
        return None
    return ".".join(map(str, cipher(int.from_bytes(bytes(map(int, octets)), "big"), 1 << 32, "ip").to_bytes(4, "big")))


def _ip6(m: str, cipher: Cipher) -> str | None:
    try:
        ipaddress.IPv6Address(m)
    except ValueError:
        return None
    places = [i for i, c in enumerate(m) if c != ":"]
    if sum(map(bool, m.split(":"))) < 3 or not any(c in _DIGITS for c in m):
        return None
    new, out = _string("".join(m[i] for i in places), [_DIGITS if m[i] in _DIGITS else "abcdef" if m[i].islower() else "ABCDEF" for i in places], cipher, f"ip6 {len(places)}"), list(m)
    for i, c in zip(places, new):
        out[i] = c
    return "".join(out)


_FIRST_DAY, _LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()


def _day(year: str | int, month: str | int, day: str | int) -> datetime.date | None:
    try:
        found = datetime.date(int(year), int(month), int(day))
    except ValueError:
        return None
    return found if _FIRST_DAY <= found.toordinal() <= _LAST_DAY else None


def _permuted_day(day: datetime.date, cipher: Cipher, fits: Callable[[datetime.date], bool]) -> datetime.date:
    """Another day of those that fit the format of this one."""
    while True:
        day = datetime.date.fromordinal(_FIRST_DAY + cipher(day.toordinal() - _FIRST_DAY, _LAST_DAY - _FIRST_DAY + 1, "date"))
        if fits(day):
            return day


def _fits(value: int, shape: str) -> bool:
    """A value can be written with as many digits as shape has."""
    return len(shape) == 2 or value < 10


def _date(m: str, cipher: Cipher) -> str | None:
    a, mark, b, _, c = re.fullmatch(r"(\d+)([-/.])(\d+)([-/.])(\d+)", m).groups()
    if len(a) == 4:
        day = _day(a, b, c)
        return day and mark.join(_permuted_day(day, cipher, lambda d: True).isoformat().split("-"))
    if month_first := mark == "/" and int(a) <= 12:
        day = _day(c, a, b)
        fits = lambda d: _fits(d.month, a) and _fits(d.day, b)
    else:
        day = _day(c, b, a)
        fits = lambda d: _fits(d.day, a) and _fits(d.month, b) and (mark != "/" or d.day > 12)
    if day is None:
        return None
    new = _permuted_day(day, cipher, fits)
    x, y = (new.month, new.day) if month_first else (new.day, new.month)
    return mark.join((f"{x:0{len(a)}d}", f"{y:0{len(b)}d}", f"{new.year:04d}"))


#: Names of the months by language (fixed values): English in full and short, German, French, Spanish.
MONTHS = [
    "january february march april may june july august september october november december".split(),
    "jan feb mar apr may jun jul aug sep oct nov dec".split(),
    "januar februar märz april mai juni juli august september oktober november dezember".split(),
    "janvier février mars avril mai juin juillet août septembre octobre novembre décembre".split(),
    "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre".split(),
]
#: Name -> its list and month; a name of several languages belongs to the first.
_MONTH_OF = {name: (k, i + 1) for k, names in reversed(list(enumerate(MONTHS))) for i, name in enumerate(names)}
_MONTH = "|".join(sorted(_MONTH_OF, key=lambda x: (-len(x), x)))


def _named_date(m: str, cipher: Cipher) -> str | None:
    name = next(x for x in re.findall(r"[^\W\d]+", m) if x.lower() in _MONTH_OF)
    number, year = re.findall(r"\d+", m)
    which, month = _MONTH_OF[name.lower()]
    if (day := _day(year, month, number)) is None:
        return None
    own = lambda d: _MONTH_OF[MONTHS[which][d.month - 1]][0] == which
    new = _permuted_day(day, cipher, lambda d: own(d) and _fits(d.day, number))
    written = MONTHS[which][new.month - 1]
    written = written.upper() if name.isupper() else written.capitalize() if name[0].isupper() else written
    values = iter((f"{new.day:0{len(number)}d}", f"{new.year:04d}"))
    return re.sub(r"\d+|" + re.escape(name), lambda x: next(values) if x[0].isdigit() else written, m)


def _email(m: str, cipher: Cipher) -> str | None:
    local, at, domain = m.partition("@")
    places = [i for i, c in enumerate(local) if c.lower() in _LETTERS or c in _DIGITS]
    low = [local[i].lower() for i in places]
    new = _string("".join(low), [_DIGITS if c in _DIGITS else _LETTERS for c in low], cipher, f"email{len(low)}")
    out = list(local)
    for i, c in zip(places, new):
        out[i] = c.upper() if local[i].isupper() else c
    return "".join(out) + at + domain


def _access_key(m: str, cipher: Cipher) -> str | None:
    return m[:4] + _string(m[4:], [_UPPER] * (len(m) - 4), cipher, "access key")


#: Kind, what a text must contain for it, pattern, pseudonym (or the parts to replace of the match, or of its group `run`, which later matches may overlap). Earlier kinds win where matches overlap. Patterns are anchored at their left and bounded, so that a scan takes linear time.
KINDS: list[tuple[str, str, str, Callable[[str, Cipher], str | Parts | None]]] = [
    ("email", "@", r"(?<![\w.+%-])[A-Za-z0-9._+%-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,5}", _email),
    ("access_key", "AKIA", r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])", _access_key),
    ("iban", "", r"(?<![A-Za-z0-9])(?=(?P<run>[A-Z]{2}\d\d(?: ?[A-Z0-9]){11,30}[A-Za-z0-9]?))", _iban),
    ("card", "", r"(?<![\w.+-])\d(?:[ -]?\d){12,}+(?!\w)|(?<![\w.+-])\d(?:[ -]?\d){12,}(?!\w)", _cards),
    ("ssn", "", r"(?<![\w-])\d{3}-\d\d-\d{4}(?![\w-])", _ssn),
    ("ip", "", r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\w)", _ip),
    ("ip6", ":", r"(?<![\w:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![\w:.])", _ip6),
    ("date", "", r"(?<![\w./-])(?:\d{4}([-/.])\d\d\1\d\d|\d\d?([-/.])\d\d?\2\d{4})(?![\w/-]|\.\d)", _date),
    ("named_date", "", rf"(?<![\w./-])(?:\d\d?(?:\.|(?= )) ?(?:de )?(?i:{_MONTH})\.?,? (?:de )?\d{{4}}|(?i:{_MONTH})\.? \d\d?, ?\d{{4}})(?!\w)", _named_date),
    ("phone", "", r"(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{3}\)|\d{3})[ .-]?\d{3}[ .-]?\d{4}(?!\w)|(?<![\w+])\+\d(?:[ ./-]?\(?\d\)?){6,14}(?!\w)|(?<!\w)\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\w)|(?<![\w.+-])\d{3}([.-])\d{3}\1\d{4}(?![\w-])", _phone),
    ("national", "", r"(?<![\w.,+/-])(?<!\d[ ])(?:0[1-9]\d{0,3}(?:[ /-]\d{2,8}){1,4}|0[1-9](?:\.\d\d){4}|[2-9]\d\d [2-9]\d\d \d{4}|[6-9]\d\d(?: \d{3}){2}|[6-9]\d\d(?: \d\d){3})(?![\w/-]|[ .,]\d)", _national),
]
_COMPILED = [(name, need, re.compile(pattern, re.ASCII), f) for name, need, pattern, f in KINDS]


def pseudonymise(text: str, has_digit: bool, cipher: Cipher, known: dict[tuple[str, str], str | Parts | None]) -> tuple[str, int]:
    """The text with what was found replaced, and the number of replacements."""
    starts: list[int] = []  # of what was found, ascending; found parts never overlap
    found: dict[int, tuple[int, str]] = {}
    for name, need, pattern, f in _COMPILED:
        if need not in text if need else not has_digit:
            continue
        for m in pattern.finditer(text):
            what = m["run"] if "run" in pattern.groupindex else m[0]
            if (at := (name, what)) not in known:
                known[at] = f(what, cipher)
            parts = [(0, len(what), known[at])] if isinstance(known[at], str) else known[at] or []
            for a, b, new in parts:
                a, b = m.start() + a, m.start() + b
                i = bisect.bisect_left(starts, a)
                if (i == len(starts) or b <= starts[i]) and (not i or found[starts[i - 1]][0] <= a):
                    starts.insert(i, a)
                    found[a] = b, new
    if not found:
        return text, 0
    out, last = [], 0
    for a in starts:
        b, new = found[a]
        out += [text[last:a], new]
        last = b
    return "".join([*out, text[last:]]), len(found)


def _kernel(columns: list[str], cipher: Cipher):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[str, str], str | Parts | None] = {}
        for batch in batches:
            for block in blocks(batch, "text"):
                if len(known) > 200_000:
                    known.clear()
                data, offsets = text_buffer(block.column("text"))
                digit = np.searchsorted(np.flatnonzero((data >= 48) & (data < 58)), offsets)
                some = (np.diff(digit) > 0).tolist()
                out = [(t, 0) if t is None else pseudonymise(t, d, cipher, known) for t, d in zip(block.column("text").to_pylist(), some)]
                yield pa.record_batch([*(block.column(c) for c in columns), pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.int64())], [*columns, "new_text", "n_replaced"])

    return run


def pseudonymised_documents(docs: DataFrame, key: bytes, columns: list[str] | None = None, inverse: bool = False) -> DataFrame:
    """docs (or some columns, text among them) with text rewritten under a secret key, and n_replaced (which replaces a column of that name)."""
    columns = [c for c in (columns or docs.columns) if c != "n_replaced"]
    others = [c for c in columns if c != "text"]
    slim, carried, back = numbered(docs, others)
    out = slim.mapInArrow(_kernel(carried, Cipher(key, inverse)), fields(slim, carried, "new_text string, n_replaced long"))
    named = dict(zip(others, back)) | {"text": F.col("new_text").alias("text")}
    return out.select(*(named[c] for c in columns), "n_replaced")


def restored_documents(docs: DataFrame, key: bytes) -> DataFrame:
    """The documents that pseudonymised_documents made these from, under the same key."""
    return pseudonymised_documents(docs, key, inverse=True).drop("n_replaced")
