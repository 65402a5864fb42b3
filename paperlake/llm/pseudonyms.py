"""Format-preserving pseudonyms for personal data (operator 5).

A value that passes its check (Luhn, calendar, octets, mod 97) is read as a
number inside the domain of its format, permuted by a keyed Feistel network, and
written back in the same format: card numbers stay valid card numbers, dates
stay dates. Equal values get equal pseudonyms in every document and task, whatever
stands beside them and in whatever form they are written: dates with their parts in
any order, phone numbers with or without their country, addresses in any case.
No table of values is needed, and the key takes pseudonyms back (``restore``).

Where a match fails its check, its shorter ends are tried (for an IBAN first the
length of its country), then the next start inside it. A pseudonym may pass where
its value did not, together with its neighbours or in another order of its parts, so
its place and kind are recorded (``pii_spans``), and ``restore`` goes by them. What
comes back is the text as it was, but for leading zeros in groups of an IPv6 address
not all of which have four digits.
Dates with strokes or points are day first if they can be, month first otherwise.

Defined results: a null text stays null with no findings, an empty text stays
empty; values that fail their check stay as they are; texts are searched whole;
repeated rows change alike; an empty table gives no rows; columns named like an
added one are replaced, all others stay.
"""

from __future__ import annotations

import datetime
import hashlib
import ipaddress
import re
from collections import Counter
from collections.abc import Callable
from math import prod

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from paperlake.llm.sentencepiece_model import slices

ROUNDS = 8
CHUNK = 1 << 20
LOWER, UPPER, DIGITS, HEX = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "0123456789abcdef"
ACCENTED = "".join(chr(c) for c in range(0xDF, 0x100) if chr(c).isalpha())
FIRST_DAY = datetime.date(1900, 1, 1).toordinal()
DAYS = datetime.date(2100, 1, 1).toordinal() - FIRST_DAY


class Feistel:
    """Keyed permutations of range(n) for any n; the tweak gives each format its own."""

    def __init__(self, key: bytes, back: bool = False):
        self.key, self.back = hashlib.blake2b(key, digest_size=32).digest(), back

    def _round(self, tweak: bytes, step: int, value: int, bits: int) -> int:
        size = (bits + 7) // 8
        data = bytes([step]) + value.to_bytes(size, "big")
        found, block = b"", 0
        while len(found) < size:
            person = hashlib.blake2b(tweak, digest_size=16).digest()
            found += hashlib.blake2b(data + bytes([block]), key=self.key, person=person, digest_size=min(64, size)).digest()
            block += 1
        return int.from_bytes(found[:size], "big") & ((1 << bits) - 1)

    def _once(self, value: int, half: int, tweak: bytes) -> int:
        mask = (1 << half) - 1
        left, right = value >> half, value & mask
        for step in reversed(range(ROUNDS)) if self.back else range(ROUNDS):
            if self.back:
                left, right = right ^ self._round(tweak, step, left, half), left
            else:
                left, right = right, left ^ self._round(tweak, step, right, half)
        return left << half | right

    def permute(self, value: int, domain: int, tweak: bytes, good: Callable[[int], bool] = lambda v: True) -> int:
        """Walk the cycle of ``value`` until it is inside the domain and good; the start must be both."""
        if domain < 2:
            return value
        half = ((domain - 1).bit_length() + 1) // 2
        value = self._once(value, half, tweak)
        while value >= domain or not good(value):
            value = self._once(value, half, tweak)
        return value


def luhn_digit(payload: str) -> str:
    """The digit that makes ``payload`` plus it a valid number."""
    total = 0
    for place, digit in enumerate(map(int, reversed(payload))):
        doubled = 2 * digit if place % 2 == 0 else digit
        total += doubled - 9 if doubled > 9 else doubled
    return str(-total % 10)


def iban_digits(country: str, account: str) -> str:
    number = "".join(str(int(c, 36)) for c in account + country + "00")
    return f"{98 - int(number) % 97:02d}"


def _characters(text: str, cipher: Feistel, tweak: bytes) -> str:
    """Permute a text among all texts with letters, digits and other characters in the same places."""
    alphabets = [next((a for a in (LOWER, UPPER, DIGITS, ACCENTED) if c in a), "") for c in text]
    places = [k for k, a in enumerate(alphabets) if a]
    value = 0
    for k in places:
        value = value * len(alphabets[k]) + alphabets[k].index(text[k])
    shape = tweak + "".join(a[:1] or c for a, c in zip(alphabets, text)).encode()
    value = cipher.permute(value, prod(len(alphabets[k]) for k in places), shape)
    out = list(text)
    for k in reversed(places):
        value, at = divmod(value, len(alphabets[k]))
        out[k] = alphabets[k][at]
    return "".join(out)


def _digits_back(text: str, digits: str) -> str:
    """``text`` with its digits replaced in order."""
    new = iter(digits)
    return "".join(next(new) if c in DIGITS else c for c in text)


def _digits_of(text: str) -> str:
    return "".join(c for c in text if c in DIGITS)


def _card(text: str, cipher: Feistel) -> str | None:
    digits = _digits_of(text)
    payload = digits[:-1]
    if luhn_digit(payload) != digits[-1] or not int(digits):
        return None
    new = str(cipher.permute(int(payload), 10 ** len(payload), b"card%d" % len(payload), bool)).zfill(len(payload))
    return _digits_back(text, new + luhn_digit(new))


_COUNTRY = re.compile(r"(?:\+|00(?=[1-9]))[0-9]{1,3}(?=[ (./-])|0(?=[1-9])")


def _phone(text: str, cipher: Feistel) -> str | None:
    code = _COUNTRY.match(text)  # what stands before a number differs by form and is kept
    rest = text[code.end() :] if code else text
    digits = _digits_of(rest)
    if not 7 <= len(digits) <= 12:
        return None
    least = 10 ** (len(digits) - 1)
    small = int(digits) < least  # a leading zero stays one, so no form turns into another
    new = cipher.permute(int(digits), 10 * least, b"phone%d" % len(digits), lambda v: (v < least) == small)
    return (code[0] if code else "") + _digits_back(rest, str(new).zfill(len(digits)))


def _ip(text: str, cipher: Feistel) -> str | None:
    octets = [int(x) for x in text.split(".")]
    if max(octets) > 255:
        return None
    new = cipher.permute(int.from_bytes(bytes(octets), "big"), 1 << 32, b"ip")
    return ".".join(map(str, new.to_bytes(4, "big")))


def _ip6(padded: bool) -> Callable:
    """Addresses all of whose groups have four digits, or any; of the latter, groups are written without leading zeros."""

    def make(text: str, cipher: Feistel) -> str | None:
        try:
            value = int(ipaddress.IPv6Address(text))
        except ValueError:
            return None
        if padded and any(len(g) not in (0, 4) for g in text.split(":")):
            return None
        groups = [value >> 16 * k & 0xFFFF for k in range(7, -1, -1)]
        if sum(g > 0 for g in groups) < 2 or not any(c in DIGITS for c in text):
            return None
        zeros = bytes(g == 0 for g in groups)  # groups of zero stay, as they may be written in short
        number = 0
        for g in filter(None, groups):
            number = number * 0xFFFF + g - 1
        number = cipher.permute(number, 0xFFFF ** zeros.count(0), b"ip6" + zeros)
        new = []
        for _ in range(zeros.count(0)):
            number, g = divmod(number, 0xFFFF)
            new.append(f"{g + 1:04x}" if padded else f"{g + 1:x}")
        new = re.sub(r"[0-9A-Fa-f]+", lambda m: new.pop() if int(m[0], 16) else m[0], text)
        return new.upper() if text.isupper() else new

    return make


def _date(order: str) -> Callable:
    """Dates whose parts stand in the given order of y, m and d."""
    places = [order.index(c) for c in "ymd"]

    def make(text: str, cipher: Feistel) -> str | None:
        mark = next(c for c in text if c not in DIGITS)
        parts = text.split(mark)
        try:
            old = datetime.date(*(int(parts[k]) for k in places)).toordinal() - FIRST_DAY
        except ValueError:
            return None
        if not 0 <= old < DAYS:
            return None
        new = datetime.date.fromordinal(cipher.permute(old, DAYS, b"date") + FIRST_DAY)
        for k, value in zip(places, (new.year, new.month, new.day)):
            parts[k] = str(value).zfill(4 if k == places[0] else 2)
        return mark.join(parts)

    return make


def _ssn(text: str, cipher: Feistel) -> str | None:
    def good(value: int) -> bool:
        area, group, serial = value // 10**6, value // 10**4 % 100, value % 10**4
        return area not in (0, 666) and area < 900 and group > 0 and serial > 0

    digits = _digits_of(text)
    if not good(int(digits)):
        return None
    return _digits_back(text, str(cipher.permute(int(digits), 10**9, b"ssn", good)).zfill(9))


def _iban(text: str, cipher: Feistel) -> str | None:
    plain = text.replace(" ", "")
    country, account = plain[:2], plain[4:]
    if iban_digits(country, account) != plain[2:4]:
        return None
    new = _characters(account, cipher, b"iban" + country.encode())
    new = iter(country + iban_digits(country, new) + new)
    return "".join(c if c == " " else next(new) for c in text)


def _email(text: str, cipher: Feistel) -> str | None:
    name, _, host = text.partition("@")
    labels, _, top = host.rpartition(".")
    if not labels or not top.isalpha() or len(top) < 2:
        return None
    # case does not tell addresses apart: it stays where it is, and what is permuted has none
    new = _characters(_small(name), cipher, b"name") + "@" + _characters(_small(labels), cipher, b"host")
    return "".join(n.upper() if c in UPPER else n for c, n in zip(text, new)) + "." + top


def _small(text: str) -> str:
    return text.translate(_SMALL)


_SMALL = str.maketrans(UPPER, LOWER)


def _secret(text: str, cipher: Feistel) -> str | None:
    mark = re.search(r"""["'][0-9A-Fa-f]+["']$""", text).start() + 1
    value, upper = text[mark:-1], text[mark:-1].isupper()
    if not any(c in DIGITS for c in value):
        return None
    new = f"{cipher.permute(int(value, 16), 16 ** len(value), b'secret%d' % len(value)):0{len(value)}x}"
    return text[:mark] + (new.upper() if upper else new) + text[-1]


IBAN_LENGTHS = {
    country: length
    for length, countries in {
        15: "NO", 16: "BE", 18: "DK FI FO GL NL SD FK", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
        22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
        25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA",
        30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for country in countries.split()
}


def _ends(kind: str, piece: str, match: re.Match) -> list[int]:
    """Where a value that starts as ``match`` may end, in the order in which ends are tried: never inside a word or number."""
    start, last = match.span()
    ends = [last, *(k for k in range(last - 1, start, -1) if piece[k - 1].isalnum() and not piece[k].isalnum())]
    if kind == "iban":
        length = IBAN_LENGTHS.get(match[0][:2])
        ends.sort(key=lambda k: len(piece[start:k].replace(" ", "")) != length)
    return ends


_IP6 = r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:]|\.[0-9])"
_DATE_BEFORE, _DATE_AFTER = r"(?<![0-9./-])", r"(?![0-9]|[./-][0-9])"
# Kinds in order of precedence: (name, pattern, what makes the pseudonym, or null if the value fails its check).
KINDS: tuple[tuple[str, str, Callable], ...] = (
    ("email", r"(?<![\w.%+-])[\w.%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}", _email),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", _iban),
    ("card", r"(?<![0-9+.-])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9]|[.-][0-9])", _card),
    ("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", _ssn),
    ("date", _DATE_BEFORE + r"(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2})" + _DATE_AFTER, _date("ymd")),
    ("date_dmy", _DATE_BEFORE + r"[0-9]{2}([./-])[0-9]{2}\1[0-9]{4}" + _DATE_AFTER, _date("dmy")),
    ("date_mdy", _DATE_BEFORE + r"[0-9]{2}([./-])[0-9]{2}\1[0-9]{4}" + _DATE_AFTER, _date("mdy")),
    ("ip", r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])", _ip),
    ("ip6_padded", _IP6, _ip6(True)),
    ("ip6", _IP6, _ip6(False)),
    ("phone", r"(?<![0-9+])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})(?:[ .-]?[0-9]{2,4}){2,3}|\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}|[0-9]{3}-[0-9]{3}-[0-9]{4}"
     r"|(?:\+|00)[1-9][0-9]{0,2}[ .-][1-9](?:[ .-][0-9]{2}){4}|00[1-9][0-9]{0,2}[ .-](?:\([0-9]{2,4}\)|[0-9]{2,4})(?:[ .-]?[0-9]{2,4}){2,3}"
     r"|0[1-9](?:[ .-][0-9]{2}){4}|0[1-9][0-9]{1,4}[/-][0-9]{5,8})(?![0-9])", _phone),
    ("secret", r"""(?i:token|secret|key|password)\s?[=:]\s?["'](?:[0-9a-f]{16,128}|[0-9A-F]{16,128})["']""", _secret),
)


class Pseudonymiser:
    def __init__(self, key: bytes, kinds=KINDS, back: bool = False):
        self.cipher = Feistel(key, back)
        self.kinds = [(name, re.compile(pattern), make) for name, pattern, make in kinds]
        self.hint = re.compile("[0-9@]")

    def replace(self, text: str) -> tuple[str, dict[str, int]]:
        """(the text with pseudonyms, number of values by kind); of overlapping values the kind first in order wins."""
        new, spans = self.spans(text)
        found: dict[str, int] = {}
        for _, _, kind in spans:
            found[_reported(kind)] = found.get(_reported(kind), 0) + 1
        return new, found

    def spans(self, text: str) -> tuple[str, list[tuple[int, int, str]]]:
        """(the text with pseudonyms, where each stands in it, and of what kind)."""
        if not self.hint.search(text):
            return text, []
        parts: list[tuple[str, str]] = [(text, "")]  # (piece, kind of the pseudonym that it is)
        for name, pattern, make in self.kinds:
            cut: list[tuple[str, str]] = []
            for piece, kind in parts:
                at = place = 0
                while not kind and (match := pattern.search(piece, place)):
                    start, place = match.start(), match.start() + 1
                    for end in _ends(name, piece, match):
                        if end != match.end() and not pattern.fullmatch(piece, start, end):
                            continue
                        new = make(piece[start:end], self.cipher)
                        if new is not None:
                            cut += [(piece[at:start], ""), (new, name)]
                            at = place = end
                            break
                cut.append((piece[at:], kind))
            parts = cut
        out, at = [], 0
        for piece, kind in parts:
            if kind:
                out.append((at, at + len(piece), kind))
            at += len(piece)
        return ("".join(piece for piece, _ in parts) if out else text), out

    def at_spans(self, text: str, spans: list[tuple[int, int, str]]) -> str:
        """``text`` with the values at the given places replaced, each by the rule of its kind."""
        makes = {name: make for name, _, make in self.kinds}
        parts, at = [], 0
        for start, end, kind in sorted(spans):
            parts += [text[at:start], makes[kind](text[start:end], self.cipher)]
            at = end
        return "".join([*parts, text[at:]])


def _reported(kind: str) -> str:
    return kind.split("_")[0]


SPAN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("kind", T.StringType())])
_ARROW_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))


def pseudonymise(df: DataFrame, key: bytes, text_col: str = "text", kinds=KINDS) -> DataFrame:
    """``df`` with pseudonyms in its text, n_pii, pii_kinds (number of values by kind) and pii_spans (where they stand)."""
    added = {"n_pii": T.LongType(), "pii_kinds": T.MapType(T.StringType(), T.LongType()), "pii_spans": T.ArrayType(SPAN)}
    kept = [f for f in df.schema.fields if f.name not in added]
    out = T.StructType([*kept, *(T.StructField(k, v) for k, v in added.items())])

    def run(batches):
        worker = Pseudonymiser(key, kinds)
        for batch in batches:
            for part in slices(batch, pc.binary_length(batch.column(text_col)), CHUNK):
                results = [(None, []) if t is None else worker.spans(t) for t in part.column(text_col).to_pylist()]
                columns = [
                    pa.array([t for t, _ in results], pa.string()) if f.name == text_col else part.column(f.name)
                    for f in kept
                ]
                kinds_ = [sorted(Counter(_reported(kind) for _, _, kind in spans).items()) for _, spans in results]
                columns.append(pa.array([len(spans) for _, spans in results], pa.int64()))
                columns.append(pa.array(kinds_, pa.map_(pa.string(), pa.int64())))
                columns.append(pa.array([[dict(zip(SPAN.names, span)) for span in spans] for _, spans in results], _ARROW_SPANS))
                yield pa.RecordBatch.from_arrays(columns, out.names)

    return df.mapInArrow(run, out)


def restore(df: DataFrame, key: bytes, text_col: str = "text", kinds=KINDS) -> DataFrame:
    """The texts before ``pseudonymise`` with the same key, by the places it recorded in ``pii_spans``."""

    names, at = df.columns, df.columns.index(text_col)

    def run(batches):
        worker = Pseudonymiser(key, kinds, back=True)
        for batch in batches:
            for part in slices(batch, pc.binary_length(batch.column(text_col)), CHUNK):
                spans = part.column("pii_spans").to_pylist()
                texts = [
                    t if t is None else worker.at_spans(t, [tuple(s.values()) for s in of])
                    for t, of in zip(part.column(text_col).to_pylist(), spans)
                ]
                columns = [pa.array(texts, pa.string()) if k == at else part.column(k) for k in range(part.num_columns)]
                yield pa.RecordBatch.from_arrays(columns, names)

    return df.mapInArrow(run, df.schema)
