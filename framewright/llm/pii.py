"""Format-preserving Feistel pseudonyms for personal data.

A value is recognised by its form and by its checksum or calendar, and then moved within its own
format by a keyed permutation (an alternating Feistel network, walked until the result is valid
again). Equal values, however they are punctuated, get equal pseudonyms in all documents, different
values different ones, and whoever has the key can reverse them.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.llm.common import arrow, table

ROUNDS = 10
#: Used by the registered query; real use passes a secret of its own.
DEMO_KEY = b"framewright demonstration key"
_FIRST_DAY, _DAYS = datetime.date(1900, 1, 1).toordinal(), datetime.date(2100, 1, 1).toordinal() - datetime.date(1900, 1, 1).toordinal()


class Feistel:
    """Keyed permutations of 0..size-1 for any size."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _round(self, kind: str, size: int, i: int, half: int, modulus: int) -> int:
        h = hashlib.blake2b(f"{kind}|{size}|{i}|{half}".encode(), key=self.key, digest_size=64).digest()
        return int.from_bytes(h + hashlib.blake2b(h, key=self.key).digest(), "big") % modulus

    def _step(self, x: int, size: int, kind: str, back: bool) -> int:
        a = 1
        while a * a < size:  # a power of ten or of two near the root would do; any a with a * b >= size does
            a *= 2
        b = -(-size // a)
        hi, lo = divmod(x, b)
        for i in range(ROUNDS)[:: -1 if back else 1]:
            sign = -1 if back else 1
            if i % 2:
                lo = (lo + sign * self._round(kind, size, i, hi, b)) % b
            else:
                hi = (hi + sign * self._round(kind, size, i, lo, a)) % a
        return hi * b + lo

    def permute(self, x: int, size: int, kind: str, valid: Callable[[int], bool] | None = None, back: bool = False) -> int:
        """Walk the cycle of x until it is inside 0..size-1 and valid; x must be both itself."""
        while True:
            x = self._step(x, size, kind, back)
            if x < size and (valid is None or valid(x)):
                return x


def luhn(digits: str) -> int:
    """What is missing for the sum of the digits to be a multiple of ten; 0 for a valid number."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return -total % 10


def _refill(shape: str, digits: str) -> str:
    """The text with its digits replaced in order."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in shape)


class Pseudonyms:
    PATTERN = re.compile(
        r"(?P<email>(?<![\w.+-])[A-Za-z0-9_.+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)"
        r"|(?P<aws>(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9]))"
        r"|(?P<secret>(?i:\b(?:password|passwd|secret|token|api_?key)\s*[=:]\s*[\"']?)(?P<value>[A-Za-z0-9_\-]{8,}))"
        r"|(?P<iban>(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9]))"
        r"|(?P<iso>(?<![0-9-])(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}(?![0-9-]))"
        r"|(?P<dmy>(?<![0-9./-])[0-9]{2}(?P<sep>[./])[0-9]{2}(?P=sep)(?:19|20)[0-9]{2}(?![0-9]))"
        r"|(?P<phone>\+[0-9]{1,3}[ .-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})(?:[ .-]?[0-9]{2,4}){2,3}(?![0-9])|\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}(?![0-9])|(?<![0-9.-])[2-9][0-9]{2}(?P<dot>[.-])[2-9][0-9]{2}(?P=dot)[0-9]{4}(?![.-]?[0-9]))"
        r"|(?P<ssn>(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-]))"
        r"|(?P<card>(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9]))"
        r"|(?P<ip>(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?!\.?[0-9]))"
    )
    HINT = re.compile(r"[0-9@=:]|AKIA")
    HEX = re.compile("(?=.*[0-9])(?=.*[a-f])[0-9a-f]{8,}")
    #: First address and size of networks with a meaning of their own, which their addresses stay in: this host, 10/8, loopback, 172.16/12, 192.168/16, multicast and beyond.
    BLOCKS = ((0, 1 << 24), (10 << 24, 1 << 24), (127 << 24, 1 << 24), (0xAC100000, 1 << 20), (0xC0A80000, 1 << 16), (224 << 24, 1 << 29))

    def __init__(self, key: bytes):
        self.f = Feistel(key)

    def _digits(self, s: str, kind: str, valid: Callable[[str], bool] | None = None, back: bool = False) -> str:
        n = len(s)
        return str(self.f.permute(int(s), 10**n, f"{kind}{n}", valid and (lambda x: valid(str(x).zfill(n))), back)).zfill(n)

    def _classes(self, s: str, kind: str, back: bool = False) -> str:
        """Letters stay letters of their case and digits digits; other characters stay."""
        x, size, parts = 0, 1, []
        for c in s:
            base = next((b for b in ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ") if c in b), None)
            parts.append(base)
            if base:
                x, size = x * len(base) + base.index(c), size * len(base)
        if size == 1:
            return s
        shape = "".join(b[0] if b else c for b, c in zip(parts, s, strict=True))
        x = self.f.permute(x, size, kind + shape, None, back)
        out = []
        for base, c in zip(reversed(parts), reversed(s), strict=True):
            if base:
                x, i = divmod(x, len(base))
                c = base[i]
            out.append(c)
        return "".join(reversed(out))

    def _hex(self, s: str, back: bool) -> str:
        """A hexadecimal string of digits and letters as another one."""
        n = len(s)
        mixed = lambda x: self.HEX.fullmatch(f"{x:0{n}x}") is not None
        return f"{self.f.permute(int(s, 16), 16**n, f'hex{n}', mixed, back):0{n}x}"

    def value(self, kind: str, s: str, back: bool = False) -> str | None:
        """The pseudonym of a value of this kind (or with ``back`` the value of a pseudonym); None if it isn't valid."""
        d = "".join(c for c in s if c.isdigit())
        if kind == "email":
            local, _, host = s.partition("@")
            return self._classes(local, "email", back) + "@" + host
        if kind == "aws":
            return s[:4] + self._classes(s[4:], "aws", back)
        if kind == "value":
            return self._hex(s, back) if self.HEX.fullmatch(s) else self._classes(s, "secret", back)
        if kind == "card":
            if luhn(d) or len(set(d)) == 1:
                return None
            body = d[0] + self._digits(d[1:-1], "card" + d[0], None, back)
            return _refill(s, body + str(luhn(body + "0")))
        if kind == "ssn":
            ok = lambda x: x[:3] not in ("000", "666") and x[0] != "9" and x[3:5] != "00" and x[5:] != "0000"
            return _refill(s, self._digits(d, "ssn", ok, back)) if ok(d) else None
        if kind == "phone":
            north = lambda x: x[0] in "23456789" and x[3] in "23456789"
            if (len(d) == 10 and s[0] != "+" or len(d) == 11 and s.startswith("+1")) and north(d[-10:]):
                return _refill(s, d[:-10] + self._digits(d[-10:], "phone north", north, back))  # linked with and without the country code
            code = re.match(r"\+([0-9]{1,3}?)(?=[ .(-])", s)
            head = code[1] if code else ""
            rest = d[len(head) :]
            if len(rest) < 7 or len(d) > 15:
                return None
            other = (lambda x: not north(x)) if head == "1" and len(rest) == 10 or not head and s[0] != "+" else (lambda x: not (x[0] == "1" and north(x[1:]))) if not head and len(rest) == 11 else None
            return _refill(s, head + self._digits(rest, f"phone{head}", other, back))
        if kind == "ip":
            octets = [int(x) for x in s.split(".")]
            if max(octets) > 255 or any(str(o) != x for o, x in zip(octets, s.split("."), strict=True)):
                return None
            x = int.from_bytes(bytes(octets), "big")
            block = next(((b, n) for b, n in self.BLOCKS if b <= x < b + n), None)
            if block:
                x = block[0] + self.f.permute(x - block[0], block[1], f"ip{block[0]}", None, back)
            else:
                x = self.f.permute(x, 1 << 32, "ip", lambda y: not any(b <= y < b + n for b, n in self.BLOCKS), back)
            return ".".join(map(str, x.to_bytes(4, "big")))
        if kind in ("iso", "dmy"):
            y, m, day = (d[:4], d[4:6], d[6:]) if kind == "iso" else (d[4:], d[2:4], d[:2])
            try:
                x = datetime.date(int(y), int(m), int(day)).toordinal() - _FIRST_DAY
            except ValueError:
                return None
            out = datetime.date.fromordinal(_FIRST_DAY + self.f.permute(x, _DAYS, "date", None, back))
            return _refill(s, out.strftime("%Y%m%d") if kind == "iso" else out.strftime("%d%m%Y"))
        if kind == "iban":
            plain = s.replace(" ", "")
            number = lambda t: int("".join(str(int(c, 36)) for c in t))
            if number(plain[4:] + plain[:4]) % 97 != 1:
                return None
            body = self._classes(plain[4:], "iban" + plain[:2], back)
            new = plain[:2] + str(98 - number(body + plain[:2] + "00") % 97).zfill(2) + body
            it = iter(new)
            return "".join(c if c == " " else next(it) for c in s)
        raise ValueError(kind)

    def text(self, text: str | None, back: bool = False) -> tuple[str | None, list[str]]:
        """The text with all recognised values replaced, and their kinds in order."""
        if not text or not self.HINT.search(text):
            return text, []
        kinds: list[str] = []

        def swap(m: re.Match) -> str:
            kind = "value" if m["secret"] else m.lastgroup if m.lastgroup != "sep" else "dmy"
            if m["dmy"]:
                kind = "dmy"
            whole = m["value"] if kind == "value" else m[0]
            if (new := self.value(kind, whole, back)) is None:
                return m[0]
            kinds.append("secret" if kind == "value" else "date" if kind in ("iso", "dmy") else kind)
            return m[0][: len(m[0]) - len(whole)] + new

        return "".join(self.PATTERN.sub(swap, line) if self.HINT.search(line) else line for line in text.splitlines(keepends=True)), kinds


def pseudonymise(docs: DataFrame, key: bytes, back: bool = False) -> DataFrame:
    """(doc_id, text, kinds), a row for each row of ``docs`` (doc_id, text, any others).

    Emails keep their host, cards their first digit and a valid checksum, phones their country code
    and punctuation (North American numbers are linked with and without +1), private networks of a special use their addresses; dates stay in 1900-2099. What fails its
    checksum or calendar isn't personal data and stays. A null text stays null, an empty one empty,
    both without kinds; repeated rows are treated alike. Whole texts, nothing shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Pseudonyms(key)
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                part = batch.slice(i, 1000)
                got = [own.text(t.as_py(), back) for t in part.column("text")]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.list_(pa.string()))], ["doc_id", "text", "kinds"])

    return arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, "doc_id long, text string, kinds array<string>")


def query(spark, sf_dir: str) -> DataFrame:
    return pseudonymise(table(spark, sf_dir, "documents"), DEMO_KEY).select("doc_id", F.size("kinds").cast("long").alias("n_values"), F.concat_ws(",", "kinds").alias("kinds"), "text")
