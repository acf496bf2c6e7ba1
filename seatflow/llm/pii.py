"""PII: format-preserving Feistel pseudonyms.

Numbers and dates are found by shape, validated, and replaced by a keyed
permutation of their own format: a card number becomes another card number
that passes the Luhn test, a date another valid date in the same notation, an
address another dotted quad, and so on.  The permutation depends on the key
and the kind of value only, so equal values get equal pseudonyms in every
document and stay linked; with the key, ``restore`` undoes it.

The permutation of [0, n) is a Feistel network on the two digits of x in base
ceil(sqrt n), with keyed BLAKE2 round functions added modulo each digit's
range; results outside [0, n) (or outside the valid values) are permuted again
until they are inside, which keeps it a permutation of the valid values.

Kinds: card (13 to 19 digits that pass the Luhn test; others are left alone),
iban (mod-97), ssn (valid area, group and serial), phone (international
shape, country code kept), ip (octets up to 255), date (real calendar days of
1900 to 2099, as 2024-01-31, 31.01.2024, 01/31/2024 or, where that is no day,
31/01/2024, which keeps a day above 12), email (letters and digits of the local
part, over their own classes) and secret (hexadecimal runs of 32 or more, over
their alphabet).

A card or iban shape may run on into an expiry, a security code or a further
word.  Its parts between group borders are tried as well: the longest that
validates counts, for cards also from later groups on, and the search goes on
behind it, or behind the first group where nothing validates.  A card keeps both
of its Luhn sums, so that a longer run around it validates after the change if
it did before.  Where a pseudonym would still make other finds of the text
around it, it is permuted again until it does not, so ``restore`` meets the same
finds; only there a value can get another pseudonym than elsewhere.

Defined cases: a null text stays null; a text without a find stays as it is;
long texts are searched whole; repeated rows are treated alike; an empty table
gives an empty result.  Extra columns pass through ``pseudonymise`` untouched.
"""

from __future__ import annotations

import bisect
import datetime
import hashlib
import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from seatflow.llm.textvec import slices

KINDS = ("card", "iban", "ssn", "phone", "ip", "date", "email", "secret")
ROUNDS = 8
# one key per deployment; the registered query uses a fixed one so that runs agree
KEY = b"pseudonym key of the registered query"

# a date after a blank is no group of a card or phone number
_DAY = (r"(?:(?:19|20)[0-9]{2}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])"
        r"|(?:0[1-9]|[12][0-9]|3[01])[./](?:0[1-9]|[12][0-9]|3[01])[./](?:19|20)[0-9]{2})(?![0-9-])")
_SHAPES = {
    "email": r"(?<![\w.+-])[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "secret": r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,}|[0-9A-F]{32,})(?![0-9A-Za-z])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?(?![0-9A-Za-z])",
    "phone": r"(?<![\w+])\+[0-9]{1,3}[ -]?(?:[0-9](?:[ .-](?!" + _DAY + r")[0-9]{2}){4}"
             r"|(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:(?:[.-]| (?!" + _DAY + r"))?[0-9]{1,4}){2,3})(?![0-9])",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.?[0-9])",
    "date": r"(?<![0-9.-])(?:(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}|[0-9]{2}\.[0-9]{2}\.(?:19|20)[0-9]{2}"
            r"|[0-9]{2}/[0-9]{2}/(?:19|20)[0-9]{2})(?![0-9-])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "card": r"(?<![0-9A-Za-z])[0-9](?:(?:-| (?!" + _DAY + r"))?[0-9]){12,18}(?![0-9A-Za-z])",
}
KIND_ORDER = tuple(_SHAPES)
_FIND = "|".join(f"(?P<{k}>{p})" for k, p in _SHAPES.items())
_GROUP = r"\W?[0-9A-Za-z]+"
# no decision about a find depends on text further away
_REACH = 300
_DAY0, _DAYS = datetime.date(1900, 1, 1), (datetime.date(2100, 1, 1) - datetime.date(1900, 1, 1)).days
_DATE_FORMS = (("-", "%Y-%m-%d"), (".", "%d.%m.%Y"), ("/", "%m/%d/%Y"), ("/", "%d/%m/%Y"))


# --- permutation ------------------------------------------------------------

class Permutation:
    """Keyed permutations of [0, n), one family per kind."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _round(self, kind: str, n: int, i: int, half: int) -> int:
        said = f"{kind}|{n}|{i}|{half}".encode()
        return int.from_bytes(hashlib.blake2b(said, key=self.key, digest_size=32).digest(), "big")

    def _once(self, kind: str, n: int, x: int, back: bool) -> int:
        a = math.isqrt(n - 1) + 1
        b = -(-n // a)
        left, right = divmod(x, b)  # left < a, right < b
        for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
            sign = -1 if back else 1
            if i % 2:
                left = (left + sign * self._round(kind, n, i, right)) % a
            else:
                right = (right + sign * self._round(kind, n, i, left)) % b
        return left * b + right

    def __call__(self, kind: str, n: int, x: int, back: bool = False,
                 valid: Callable[[int], bool] | None = None) -> int:
        if n < 2:
            return x
        while True:
            x = self._once(kind, n, x, back)
            if x < n and (valid is None or valid(x)):
                return x


# --- formats ----------------------------------------------------------------

def luhn_digit(payload: str) -> int:
    total = 0
    for i, c in enumerate(reversed(payload)):
        d = int(c) * (2 - i % 2)
        total += d - 9 if d > 9 else d
    return -total % 10


def luhn(digits: str) -> bool:
    return luhn_digit(digits[:-1]) == int(digits[-1])


def _refill(shape: str, digits: str) -> str:
    """``shape`` with its digits replaced in order."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in shape)


def _iban_rest(s: str) -> int:
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97


def _classes(s: str) -> list[str]:
    """The alphabet each character is permuted over; "" keeps it."""
    low, up, num = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    return [low if c in low else up if c in up else num if c in num else "" for c in s]


def _mixed(perm: Permutation, kind: str, s: str, alphabets: list[str], back: bool,
           valid: Callable[[str], bool] | None = None) -> str:
    x, n = 0, 1
    for c, a in zip(s, alphabets):
        if a:
            x, n = x * len(a) + a.index(c), n * len(a)
    tag = kind + ":" + "".join(str(len(a) % 10) for a in alphabets)

    def written(x: int) -> str:
        out = []
        for c, a in zip(reversed(s), reversed(alphabets)):
            if a:
                x, d = divmod(x, len(a))
                c = a[d]
            out.append(c)
        return "".join(reversed(out))
    return written(perm(tag, n, x, back, valid and (lambda x: valid(written(x)))))


def _ssn_ok(x: int) -> bool:
    area, group, serial = x // 1_000_000, x // 10_000 % 100, x % 10_000
    return area not in (0, 666) and area < 900 and group > 0 and serial > 0


def _day(s: str) -> tuple[datetime.date, str] | None:
    """Day and notation of a date; day/month/year where month/day/year fails."""
    for mark, form in _DATE_FORMS:
        if mark in s:
            try:
                return datetime.datetime.strptime(s, form).date(), form
            except ValueError:
                pass
    return None


def _validates(shape: str, s: str) -> bool:
    digits = "".join(c for c in s if c.isdigit())
    if shape == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    if shape == "ip":
        return max(map(int, s.split("."))) <= 255
    if shape == "date":
        return _day(s) is not None
    if shape == "ssn":
        return _ssn_ok(int(digits))
    if shape == "phone":
        return 6 <= len(digits) - len(re.match(r"\+[0-9]{1,3}", s)[0]) + 1 <= 14
    if shape == "iban":
        plain = s.replace(" ", "")
        return 15 <= len(plain) <= 34 and _iban_rest(plain) == 1
    return True


def pseudonym(perm: Permutation, shape: str, s: str, back: bool = False,
              fits: Callable[[str], bool] = lambda new: True) -> tuple[str, str] | None:
    """(kind, replacement) of a find, or None if it does not validate.  Only a
    replacement that ``fits`` is taken; ``s`` itself must."""
    if not _validates(shape, s):
        return None
    digits = "".join(c for c in s if c.isdigit())
    if shape == "email":
        local, _, domain = s.partition("@")
        return shape, _mixed(perm, "email", local, _classes(local), back, lambda x: fits(x + "@" + domain)
                             ) + "@" + domain
    if shape == "secret":
        hexa = "0123456789abcdef" if s == s.lower() else "0123456789ABCDEF"
        return shape, _mixed(perm, "secret", s, [hexa] * len(s), back, fits)
    if shape == "iban":
        plain = s.replace(" ", "")

        def account(body: str) -> str:
            check = f"{98 - _iban_rest(plain[:2] + '00' + body):02d}"
            it = iter(plain[:2] + check + body)
            return "".join(c if c == " " else next(it) for c in s)
        return shape, account(_mixed(perm, "iban", plain[4:], _classes(plain[4:]), back, lambda x: fits(account(x))))
    ok = None
    if shape == "card":
        n, other = len(digits) - 1, luhn_digit(digits)
        kind, size, x = f"card{n}", 10 ** n, int(digits[:-1])

        def number(x: int) -> str:
            body = f"{x:0{n}d}"
            return body + str(luhn_digit(body))

        def ok(x: int) -> bool:
            return luhn_digit(number(x)) == other

        def written(x: int) -> str:
            return _refill(s, number(x))
    elif shape == "ip":
        kind, size, x = "ip", 1 << 32, int.from_bytes(bytes(map(int, s.split("."))), "big")

        def written(x: int) -> str:
            return ".".join(map(str, x.to_bytes(4, "big")))
    elif shape == "date":
        day, form = _day(s)
        kind, size, x = "date", _DAYS, (day - _DAY0).days

        def written(x: int) -> str:
            return (_DAY0 + datetime.timedelta(days=x)).strftime(form)

        def ok(x: int) -> bool:  # read again in the same notation
            return form != "%d/%m/%Y" or (_DAY0 + datetime.timedelta(days=x)).day > 12
    elif shape == "ssn":
        kind, size, x, ok = "ssn", 10 ** 9, int(digits), _ssn_ok

        def written(x: int) -> str:
            return _refill(s, f"{x:09d}")
    else:
        code = re.match(r"\+[0-9]{1,3}", s)[0]
        own = "".join(c for c in s[len(code):] if c.isdigit())
        kind, size, x = f"phone{len(own)}", 10 ** len(own), int(own)

        def written(x: int) -> str:
            return code + _refill(s[len(code):], f"{x:0{len(own)}d}")
    return shape, written(perm(kind, size, x, back, lambda x: (ok is None or ok(x)) and fits(written(x))))


# --- finds --------------------------------------------------------------------

def _card_part(s: str) -> int:
    """Length of the longest card number from the start of ``s`` to a group border, 0 for none."""
    n, plain, turned, best = 0, 0, 0, 0  # sums with the last digit as it is, and doubled
    for i, c in enumerate(s):
        if c not in " -":
            d = int(c)
            n, plain, turned = n + 1, turned + d, plain + (2 * d - 9 if d > 4 else 2 * d)
            if n >= 13 and plain % 10 == 0 and (i + 1 == len(s) or s[i + 1] in " -"):
                best = i + 1
    return best


def _longest(m: re.Match, shape: str, known: dict[str, int]) -> int:
    """End of the longest part from the start of a match to a group border that
    validates, 0 if none does; ``known`` remembers card shapes."""
    s, start = m[0], m.start()
    if shape == "card":
        if s not in known:
            known[s] = _card_part(s)
        return start + known[s] if known[s] else 0
    if _validates(shape, s):
        return m.end()
    if shape == "iban":
        for i in range(len(s) - 1, 12, -1):
            if s[i] == " " and _validates(shape, s[:i]):
                return start + i
    return 0


def finds(text: str, find: re.Pattern, known: dict[str, int], start: int = 0, until: int | None = None,
          stop: int | None = None) -> tuple[list[tuple[str, int, int]], list[tuple[int, int]], list[int]]:
    """Finds (kind, start, end) of a text in order, from ``start`` on and
    beginning before ``until``; the stretches of which parts were tried; and the
    places where the search went on."""
    stop = len(text) if stop is None else stop
    until = stop if until is None else until
    found, tried, went_on = [], [], []
    at = start
    while at < until:
        went_on.append(at)
        m = find.search(text, at, stop)
        if m is None or m.start() >= until:
            break
        a, end, shape = m.start(), _longest(m, m.lastgroup, known), m.lastgroup
        if shape in ("card", "iban"):
            tried.append(m.span())
        later = iter(KIND_ORDER[KIND_ORDER.index(shape) + 1:])
        while not end and (shape := next(later, None)):  # another shape from the same place
            if m2 := re.compile(_SHAPES[shape]).match(text, a, stop):
                end = _longest(m2, shape, known)
                tried.append(m2.span())
        if not end:
            at = max(a + 1, re.compile(_GROUP).match(text, a).end())
            continue
        if shape == "card":
            first, i = a, a + 1
            while i < end:  # a longer card from a later group on
                if text[i - 1] in " -" and (m2 := re.compile(_SHAPES["card"]).match(text, i, stop)):
                    tried.append(m2.span())
                    e = _longest(m2, "card", known)
                    if e and sum(map(str.isdigit, text[i:e])) > sum(map(str.isdigit, text[a:end])):
                        a, end = i, e
                i += 1
            if a > first:
                before = finds(text, find, known, first, a, a)
                found += before[0]
                tried += before[1]
        found.append((shape, a, end))
        at = end
    return found, tried, went_on


def replace_text(text: str, perm: Permutation, find: re.Pattern, back: bool = False) -> tuple[str, list[str]]:
    known: dict[str, int] = {}
    found, tried, went_on = finds(text, find, known)
    if not found:
        return text, []
    tried.sort()
    starts = [a for a, _ in tried]
    news: dict[int, str] = {}
    order = range(len(found))
    # undone in reverse, so that each find meets the surroundings it was replaced in
    for k in reversed(order) if back else order:
        shape, a, b = found[k]
        near = tried[bisect.bisect_left(starts, a - _REACH):bisect.bisect_left(starts, b)]
        if all(span == (a, b) or span[1] <= a for span in near):
            news[k] = pseudonym(perm, shape, text[a:b], back)[1]
            continue
        # from a place where the search went on, to where no decision reaches
        p = went_on[max(0, bisect.bisect_right(went_on, a - _REACH) - 1)]
        lo, hi = max(0, p - 1), min(len(text), b + _REACH)
        around, at = [], lo
        i = k
        while i > 0 and found[i - 1][2] > lo:
            i -= 1
        while i < len(found) and found[i][1] < hi:
            _, c, d = found[i]
            if i != k and i in news and c >= lo and d <= hi:
                around += [text[at:c], news[i]]
                at = d
            elif i == k:
                around += [text[at:a], None]
                at = b
            i += 1
        around.append(text[at:hi])
        cut = around.index(None)
        left, right = "".join(around[:cut]), "".join(around[cut + 1:])

        def same(s: str) -> list[tuple[str, int, int]]:
            return finds(left + s + right, find, known, p - lo, b - lo)[0]
        now = same(text[a:b])
        news[k] = pseudonym(perm, shape, text[a:b], back, lambda s: same(s) == now)[1]
    out, at = [], 0
    for k in order:
        out += [text[at:found[k][1]], news[k]]
        at = found[k][2]
    return "".join(out) + text[at:], [f[0] for f in found]


# --- Spark ------------------------------------------------------------------

def _suspects(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Rows with an @ or four digits at all: no find has fewer."""
    digits = np.flatnonzero((buf >= 48) & (buf <= 57))
    ats = np.flatnonzero(buf == 64)
    return np.flatnonzero((np.diff(np.searchsorted(digits, off)) >= 4) | (np.diff(np.searchsorted(ats, off)) > 0))


def _replace(key: bytes, back: bool, text_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        perm, find = Permutation(key), re.compile(_FIND)
        # in slices of a few MB, whatever a batch holds
        for batch, buf, off in ((b.slice(i, j - i), buf, off) for b in batches
                                for i, j, buf, off in slices(b.column(text_at))):
            texts = batch.column(text_at)
            rows = _suspects(buf, off)
            counts = {k: np.zeros(batch.num_rows, np.int64) for k in KINDS}
            new = []
            for i in rows.tolist():
                text, kinds = replace_text(texts[i].as_py(), perm, find, back)
                new.append(text)
                for k in kinds:
                    counts[k][i] += 1
            if new:
                mask = np.zeros(batch.num_rows, bool)
                mask[rows] = True
                texts = pc.replace_with_mask(texts, pa.array(mask), pa.array(new, texts.type))
            columns = [*batch.columns]
            columns[text_at] = texts
            columns += [pa.array(counts[k]) for k in KINDS]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, *(f"pii_{k}" for k in KINDS)])
    return run


def pseudonymise(docs: DataFrame, key: bytes = KEY, back: bool = False) -> DataFrame:
    """``docs`` with pseudonyms in ``text`` and counts ``pii_<kind>`` per row
    (a column that already bears such a name is replaced)."""
    docs = docs.drop(*(f"pii_{k}" for k in KINDS)).withColumn("text", F.col("text").cast("string"))
    schema = StructType([*docs.schema.fields, *(StructField(f"pii_{k}", LongType()) for k in KINDS)])
    return docs.mapInArrow(_replace(key, back, docs.columns.index("text")), schema)


def restore(docs: DataFrame, key: bytes = KEY) -> DataFrame:
    """Undo ``pseudonymise`` with the same key."""
    cols = [c for c in docs.columns if c not in [f"pii_{k}" for k in KINDS]]
    return pseudonymise(docs.select(*cols), key, back=True).select(*cols)


def pii_report(docs: DataFrame, key: bytes = KEY) -> DataFrame:
    """doc_id, the whole pseudonymised text, its finds in all and per kind."""
    out = pseudonymise(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), key)
    total = sum((F.col(f"pii_{k}") for k in KINDS), F.lit(0).cast("long"))
    return out.select("doc_id", "text", total.alias("n_replaced"), *(f"pii_{k}" for k in KINDS))
