"""PII: format-preserving Feistel pseudonyms for validated numbers, dates, addresses and secrets."""

from __future__ import annotations

import hashlib
import re
import secrets
from datetime import date, timedelta

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.common import worker_cache

#: Session setting that holds the key; its name makes Spark redact it.
KEY_SETTING = "spark.strandline.pii.secret"
ROUNDS = 10
#: Characters permuted as one number; longer values are blocks, each tweaked by the one before it.
BLOCK = 48
DIGITS = "0123456789"
LOWER = "abcdefghijklmnopqrstuvwxyz"
_FIRST_DAY, _DAYS = date(1900, 1, 1), 73049  # 1900-01-01 to 2099-12-31
_MEMO_ROWS = 50_000


def session_key(spark: SparkSession) -> bytes:
    """The key of KEY_SETTING; where it is unset, a random one that lasts as long as the session.

    So no key stands in the code, equal values link within a session by default,
    and across sessions for who sets the key.
    """
    found = spark.conf.get(KEY_SETTING, None)
    if not found:
        found = secrets.token_hex(32)
        spark.conf.set(KEY_SETTING, found)
    return found.encode("utf-8")


class Feistel:
    """A keyed permutation of the integers below a size, per tweak; its inverse too.

    An unbalanced Feistel network on the smallest even-bit square that holds the
    size, walked along its cycle until the value lies in the domain again.
    """

    def __init__(self, key: bytes, rounds: int = ROUNDS) -> None:
        if not key:
            raise ValueError("a key is needed")
        self.key, self.rounds = key if len(key) <= 64 else hashlib.blake2b(key).digest(), rounds

    def _round(self, tweak: bytes, i: int, half: int, bits: int) -> int:
        size = (bits + 7) // 8
        data = b"%d|%d|" % (i, bits) + tweak + b"|" + half.to_bytes(size, "big")
        digest = hashlib.blake2b(data, key=self.key, digest_size=min(64, size + 8)).digest()
        for k in range(1, -(-size // 64)):  # as many digests as cover the half
            digest += hashlib.blake2b(data + b"|%d" % k, key=self.key).digest()
        return int.from_bytes(digest, "big") & ((1 << bits) - 1)

    def _once(self, x: int, bits: int, tweak: bytes, back: bool) -> int:
        left, right = x >> bits, x & ((1 << bits) - 1)
        for i in reversed(range(self.rounds)) if back else range(self.rounds):
            if back:
                left, right = right ^ self._round(tweak, i, left, bits), left
            else:
                left, right = right, left ^ self._round(tweak, i, right, bits)
        return left << bits | right

    def permute(self, x: int, size: int, tweak: bytes, back: bool = False) -> int:
        bits = max(1, ((size - 1).bit_length() + 1) // 2)
        x = self._once(x, bits, tweak, back)
        while x >= size:
            x = self._once(x, bits, tweak, back)
        return x


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (d * 2 - 9 if d > 4 else d * 2)
    return total % 10 == 0


def _luhn_check(body: str) -> str:
    return next(c for c in DIGITS if luhn(body + c))


def _iban_check(country: str, rest: str) -> str:
    number = "".join(str(int(c, 36)) for c in rest + country + "00")
    return f"{98 - int(number) % 97:02d}"


def _iban_ok(text: str) -> bool:
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1


def _country_digits(digits: str) -> int:
    """Digits of the country code that begins an international number; the codes are free of prefixes."""
    if digits[:1] in ("1", "7"):
        return 1
    two = "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98"
    return 2 if digits[:2] in two.split() else 3


class Pseudonymizer:
    """Replaces values by their kind.

    Equal values of a kind get equal pseudonyms however they are written: digits in
    groups or not, dates in any order of their parts, phone numbers with a country
    code apart, joined, or (ten digits of North America) left out, letters of either case.
    """

    def __init__(self, key: bytes, back: bool = False) -> None:
        self.net, self.back, self.memo = Feistel(key), back, {}

    def number(self, x: int, size: int, tweak: bytes) -> int:
        return self.net.permute(x, size, tweak, self.back)

    def digits(self, value: str, tweak: bytes) -> str:
        return f"{self.number(int(value), 10 ** len(value), tweak + b'%d' % len(value)):0{len(value)}d}" if value else value

    def _refill(self, text: str, digits: str) -> str:
        own = iter(digits)
        return "".join(next(own) if c.isdigit() else c for c in text)

    def card(self, text: str) -> str | None:
        d = re.sub(r"\D", "", text)
        if not 13 <= len(d) <= 19 or not luhn(d) or len(set(d)) == 1:
            return None
        body = d[:-1]  # the check digit follows from the rest, so valid numbers permute among themselves
        while True:
            body = self.digits(body, b"card")
            out = body + _luhn_check(body)
            if len(set(out)) > 1:
                return self._refill(text, out)

    def phone(self, text: str) -> str | None:
        shown = text.replace("(0)", "(o)")  # a trunk zero is no part of the number
        d = re.sub(r"\D", "", shown)
        if not 10 <= len(d) <= 15:
            return None
        keep = _country_digits(d) if "+" in text else 0  # the country code is part of the format
        code = d[:keep] or "1"  # a number without one is a North American number
        return self._refill(shown, d[:keep] + self.digits(d[keep:], b"phone" + code.encode())).replace("(o)", "(0)")

    def ssn(self, text: str) -> str | None:
        valid = lambda n: n // 10**6 not in (0, 666) and n // 10**6 < 900 and n // 10**4 % 100 and n % 10**4
        n = int(text.replace("-", ""))
        if not valid(n):
            return None
        while True:
            n = self.number(n, 10**9, b"ssn")
            if valid(n):
                return f"{n // 10**6:03d}-{n // 10**4 % 100:02d}-{n % 10**4:04d}"

    def iban(self, text: str) -> str | None:
        flat = text.replace(" ", "")
        if not 15 <= len(flat) <= 34 or not _iban_ok(flat):
            return None
        body = self.mixed(flat[4:], b"iban" + flat[:2].encode())
        out = iter(flat[:2] + _iban_check(flat[:2], body) + body)
        return "".join(c if c == " " else next(out) for c in text)

    def ip(self, text: str) -> str | None:
        parts = text.split(".")
        if any(len(p) > 3 or int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
            return None
        n = self.number(int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32, b"ip")
        return ".".join(map(str, n.to_bytes(4, "big")))

    def day(self, text: str) -> str | None:
        found = re.fullmatch(r"(\d{4})([-/.])(\d{2})\2(\d{2})", text)
        if found:
            y, m, d = found[1], found[3], found[4]
            style = "{y:04d}" + found[2] + "{m:02d}" + found[2] + "{d:02d}"
        else:
            found = re.fullmatch(r"(\d{2})([-/.])(\d{2})\2(\d{4})", text)
            first, second, y = found[1], found[3], found[4]
            swap = int(second) > 12  # month first where the second part can only be a day
            d, m = (second, first) if swap else (first, second)
            style = ("{m:02d}" if swap else "{d:02d}") + found[2] + ("{d:02d}" if swap else "{m:02d}") + found[2] + "{y:04d}"
        try:
            n = (date(int(y), int(m), int(d)) - _FIRST_DAY).days
        except ValueError:
            return None
        if not 0 <= n < _DAYS:
            return None
        late = int(d) > 12  # kept, so that a pseudonym reads in its style just as the date did
        while True:
            n = self.number(n, _DAYS, b"date")
            new = _FIRST_DAY + timedelta(n)
            if (new.day > 12) == late:
                return style.format(y=new.year, m=new.month, d=new.day)

    def blocks(self, text: str, tweak: bytes, permute) -> str:
        """permute(block, tweak) over blocks of a bounded size, each tweaked by the plain block before it."""
        if len(text) <= BLOCK:
            return permute(text, tweak)
        out, before = [], ""
        for i in range(0, len(text), BLOCK):
            own = text[i : i + BLOCK]
            new = permute(own, tweak + b"|" + before.encode("utf-8", "surrogatepass"))
            before = (new if self.back else own).lower()
            out.append(new)
        return "".join(out)

    def mixed(self, text: str, tweak: bytes) -> str:
        """Letters stay letters of their case, digits stay digits, all else stays."""
        return self.blocks(text, tweak, self._mixed)

    def _mixed(self, text: str, tweak: bytes) -> str:
        sizes = [10 if c in DIGITS else 26 if c.lower() in LOWER else 1 for c in text]
        x, total = 0, 1
        for c, s in zip(text, sizes):
            if s > 1:
                x, total = x * s + (ord(c) - 48 if s == 10 else LOWER.index(c.lower())), total * s
        if total == 1:
            return text
        shape = "".join("9" if s == 10 else "a" if s == 26 else c for c, s in zip(text, sizes))
        x, out = self.number(x, total, tweak + shape.encode("utf-8", "surrogatepass")), []
        for c, s in zip(reversed(text), reversed(sizes)):
            if s == 1:
                out.append(c)
                continue
            x, r = divmod(x, s)
            out.append(DIGITS[r] if s == 10 else LOWER[r].upper() if c.isupper() else LOWER[r])
        return "".join(reversed(out))

    def _hex(self, text: str, tweak: bytes) -> str:
        n = self.number(int(text, 16), 16 ** len(text), tweak + b"%d" % len(text))
        return f"{n:0{len(text)}x}"

    def email(self, text: str) -> str | None:
        local, _, domain = text.rpartition("@")
        return f"{self.mixed(local, b'mail')}@{domain}"

    def secret(self, text: str) -> str | None:
        if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", text):
            new = self.blocks(text.lower(), b"hex", self._hex)
            return new.upper() if re.search("[A-F]", text) else new
        return self.mixed(text, b"secret")

    def replace(self, kind: str, text: str) -> str | None:
        """The pseudonym, or None where the value fails its kind's validation."""
        if (kind, text) not in self.memo:
            if len(self.memo) >= _MEMO_ROWS:
                self.memo.clear()
            self.memo[kind, text] = getattr(self, kind)(text)
        return self.memo[kind, text]


#: Kinds in the order in which they claim text. A number may not touch other letters, digits or point-digit tails.
PATTERN = re.compile(
    r"(?P<email>(?<![\w.+-])\w(?:[\w.+-]*\w)?@(?:[A-Za-z0-9-]{1,63}\.)+[A-Za-z]{2,24}(?![A-Za-z0-9-]))"
    r"|(?:(?:token|secret|api[_-]?key|passw(?:or)?d|access[_-]?key)[\"']?\s{0,3}[=:]\s{0,3}[\"']?)(?P<secret>[A-Za-z0-9_\-]{16,}(?:[.+/][A-Za-z0-9_\-]+)*)"
    r"|(?<![A-Za-z0-9])(?P<iban>[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)(?![A-Za-z0-9])"
    r"|(?<![\w.])(?P<ip>\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})(?!\.?\d|[A-Za-z_])"
    r"|(?<![\w.])(?P<day>\d{4}([-/.])\d{2}\6\d{2}|\d{2}([-/.])\d{2}\7\d{4})(?!\.?\d|[A-Za-z_])"
    r"|(?<![\w-])(?P<ssn>\d{3}-\d{2}-\d{4})(?![\w-])"
    r"|(?<![\w+])(?P<card>\d(?:[ -]?\d){12,18})(?![\w])"
    r"|(?<![\w+])(?P<phone>\+\d{1,3}[ .\-]?\(?\d{1,4}\)?(?:[ .\-]?\d{2,4}){2,4}|\(\d{3}\) ?\d{3}[ .\-]\d{4}|\d{3}[.\-]\d{3}[.\-]\d{4})(?![\w])"
)
KINDS = ("email", "secret", "iban", "ip", "day", "ssn", "card", "phone")
_LIKELY = re.compile(r"\d|@|(?i:token|secret|key|passw)")


#: Whole groups of digits, or of capitals and digits, from which a candidate's other readings are made.
_GROUP = {"card": re.compile(r"[ -]?(\d+)(?!\w)"), "iban": re.compile(r" ?([A-Z0-9]+)(?![A-Za-z0-9])"), "phone": re.compile(r"[ .\-]?\+?\(?(\d+)\)?(?!\w)")}
_MOST = {"card": 19, "iban": 34, "phone": 15}


def _reading(kind: str, text: str, a: int, b: int, using: Pseudonymizer) -> tuple[int, str] | None:
    """(end, pseudonym) of a valid value of whole groups from a on: the first group alone, else [a, b), else the longest."""
    ends, size, at = [], 0, a
    while m := _GROUP[kind].match(text, at):
        size, at = size + len(m[1]), m.end()
        if size > _MOST[kind]:
            break
        ends.append(at)
    for end in dict.fromkeys([*ends[:1], b, *reversed(ends)]):
        if (new := using.replace(kind, text[a:end])) is not None:
            return end, new
    return None


def find(text: str, start: int = 0):
    """(kind, start, end) of the first candidate value at or after start, or None."""
    m = PATTERN.search(text, start)
    if m is None:
        return None
    kind = m.lastgroup if m.lastgroup in KINDS else next(k for k in KINDS if m[k] is not None)
    return kind, m.start(kind), m.end(kind)


def pseudonymize(text: str | None, using: Pseudonymizer) -> tuple[str | None, dict[str, int]]:
    """The text with its validated values replaced, and their number by kind.

    A card, an IBAN or a phone number is its first group where that is valid alone,
    else all that its pattern found, else the longest valid run of whole groups; where
    none is valid, the search goes on one group after its start.
    """
    if not text or not _LIKELY.search(text):
        return text, {}
    out, at, start, counts = [], 0, 0, {}
    while (found := find(text, start)) is not None:
        kind, a, b = found
        if kind not in _GROUP:
            new, start = using.replace(kind, text[a:b]), b
        elif reading := _reading(kind, text, a, b, using):
            b, new = reading
            start = b
        elif kind == "card" and text[a - 1 : a] == "+" and (new := using.replace("phone", text[a:b])):
            kind, start = "phone", b  # digits in groups may still be a phone number
        else:
            group = _GROUP[kind].match(text, a)
            new, start = None, group.end() if group else a + 1
        if new is not None:
            out += [text[at:a], new]
            at, counts[kind] = b, counts.get(kind, 0) + 1
    return ("".join(out) + text[at:] if out else text), counts


def pseudonyms(docs: DataFrame, key: bytes, text_col: str = "text") -> DataFrame:
    """docs with values in the text replaced, and pii_counts map<string,int>, n_pii int.

    The key is the caller's secret: with it Pseudonymizer(key, back=True) inverts
    every value (see session_key). E-mail local parts, secrets after key words, IBANs (mod 97), IPv4 addresses,
    calendar dates, SSNs, cards (Luhn) and phone numbers are permuted within
    their format; text that fails validation stays as it is. Null and empty
    texts stay, with no counts. Rows keep their number; a column of docs named
    like an added one is replaced.
    """
    schema = docs.drop("pii_counts", "n_pii").schema
    names = schema.fieldNames()
    at = names.index(text_col)
    using = Pseudonymizer(key)

    def run(batches):
        worker_cache("pii", dict)
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                part = batch.slice(i, 1000)
                done = [pseudonymize(t, using) for t in part.column(at).to_pylist()]
                columns = list(part.columns)
                columns[at] = pa.array([t for t, _ in done], columns[at].type)
                counts = pa.array([list(c.items()) for _, c in done], pa.map_(pa.string(), pa.int32()))
                total = pa.array([sum(c.values()) for _, c in done], pa.int32())
                yield pa.RecordBatch.from_arrays([*columns, counts, total], [*names, "pii_counts", "n_pii"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    return docs.select(*[F.col(f"`{n}`") for n in names]).mapInArrow(run, f"{kinds}, pii_counts map<string,int>, n_pii int")
