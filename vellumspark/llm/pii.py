"""Personal data: format-preserving pseudonyms by a keyed Feistel network.

Numbers and dates that validate (Luhn, mod 97, calendar, numbering plan, octets) and e-mail addresses and credentials are
mapped by a keyed permutation of the set of values of their own format: a card number becomes another card number with a
right check digit, a date another date. The permutation depends on the key and on the kind only, so the same value
becomes the same pseudonym in every document and in every way of writing it, and two values never become one.

A permutation of 0..N-1 is an alternating Feistel network over a x b >= N (round function: keyed BLAKE2b), walked until it
lands below N. pseudonymise() is the forward way, and reveal=True the way back for a holder of the key.

Kinds: card (13 to 19 digits, Luhn, any groups by one blank or one hyphen each), iban (mod 97), ssn, phone (North American plan, or
+ and 8 to 15 digits), ipv4, date (year first; day, month, year; or month, day, year where it can't be read the other way),
email, access_key, hex_secret (small, capital or mixed letters; the case stays, and mixed case is a value of its own). What
doesn't validate stays as it is; but the operators permute any number written +1 ddd ddd dddd or (ddd) ddd-dddd, in and
outside of the plan each among themselves (all_phones; Formats alone has it off). A kind's characters outside the permuted
part (prefixes, separators, e-mail domains) stay. Dates of a day up to 12 stay among themselves, so that every way of
writing a date can be read after as before. Digits of any script count, and a pseudonym has the script of its value (of
several, the first that isn't ASCII's).

The key has no default. session_key() takes it from the setting spark.vellumspark.pii.secret, which Spark keeps out of its
logs; where that is unset the key is random and lasts as long as the application.

Defined results: a null text stays null, an empty one empty. Null ids and repeated rows are treated like any other row;
repeated rows give repeated results. Texts are taken whole. A text without a digit, an @ and the words before a secret never
reaches Python. Extra columns are ignored by pseudonymise() and dropped by pseudonymise_documents(). No rows give no rows.
"""

from __future__ import annotations

import datetime
import math
import re
import secrets
import unicodedata
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import lru_cache
from hashlib import blake2b

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

KEY_SETTING = "spark.vellumspark.pii.secret"
ROUNDS = 10

LOWER = "abcdefghijklmnopqrstuvwxyz"
UPPER_DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"


_OWN_KEYS: dict[str, bytes] = {}


def session_key(spark: SparkSession) -> bytes:
    """The key of the setting; where it is unset, a random one of this application, which nobody can use afterwards."""
    given = spark.conf.get(KEY_SETTING, None)
    return given.encode() if given else _OWN_KEYS.setdefault(spark.sparkContext.applicationId, secrets.token_bytes(32))


class Permutation:
    """A keyed permutation of 0..size-1."""

    def __init__(self, key: bytes, tweak: str, size: int):
        self.size, self.tweak = size, tweak.encode()
        self.key = blake2b(key, digest_size=32).digest()
        self.left = max(1, math.isqrt(size - 1) + 1)
        self.right = -(-size // self.left)

    def _round(self, turn: int, value: int, size: int) -> int:
        wide = (value.bit_length() + 7) // 8
        found = blake2b(bytes([turn]) + value.to_bytes(wide, "big"), key=self.key, person=b"feistel", salt=blake2b(self.tweak, digest_size=16).digest(), digest_size=40)
        return int.from_bytes(found.digest(), "big") % size

    def _step(self, x: int, back: bool) -> int:
        a, b = divmod(x, self.right)
        for turn in reversed(range(ROUNDS)) if back else range(ROUNDS):
            sign = -1 if back else 1
            if turn % 2:
                b = (b + sign * self._round(turn, a, self.right)) % self.right
            else:
                a = (a + sign * self._round(turn, b, self.left)) % self.left
        return a * self.right + b

    def __call__(self, x: int, back: bool = False) -> int:
        if not 0 <= x < self.size:
            raise ValueError("the value is outside the format")
        x = self._step(x, back)
        while x >= self.size:
            x = self._step(x, back)
        return x


def _digits(text: str) -> str:
    return re.sub(r"\D", "", text)


def _fill(pattern: str, digits: str) -> str:
    """pattern with its digits replaced in order."""
    left = iter(digits)
    return re.sub(r"\d", lambda _: next(left), pattern)


def luhn_digit(digits: str) -> int:
    """The check digit to follow these digits."""
    total = 0
    for k, d in enumerate(reversed(digits)):
        d = int(d) * (2 if k % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return -total % 10


FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()


@lru_cache(1)
def _days() -> tuple[list[int], list[int]]:
    """Days up to the 12th of their month, which may be read as months, and the others."""
    late = [datetime.date.fromordinal(d).day > 12 for d in range(FIRST_DAY, LAST_DAY + 1)]
    return tuple([d for d, x in enumerate(late, FIRST_DAY) if x == which] for which in (False, True))


def _ascii_digits(text: str) -> str:
    return text if text.isascii() else "".join(str(unicodedata.decimal(c)) if c.isdecimal() else c for c in text)


class Formats:
    """The mappings of each kind under one key; each returns None where the match isn't a valid value."""

    def __init__(self, key: bytes, reveal: bool = False, all_phones: bool = False):
        self.key, self.back, self.all_phones = key, reveal, all_phones
        self.permutation: Callable[[str, int], Permutation] = lru_cache(4096)(lambda tweak, size: Permutation(key, tweak, size))
        self.find = lru_cache(65536)(self._find)

    def _move(self, tweak: str, size: int, x: int) -> int:
        return self.permutation(tweak, size)(x, self.back)

    def _letters(self, tweak: str, text: str, alphabet: str) -> str:
        """Permute the characters of text that are in alphabet, all at once."""
        own = [c for c in text if c in alphabet]
        x = 0
        for c in own:
            x = x * len(alphabet) + alphabet.index(c)
        x = self._move(f"{tweak}:{len(own)}", len(alphabet) ** len(own), x) if own else 0
        out = []
        for _ in own:
            x, r = divmod(x, len(alphabet))
            out.append(alphabet[r])
        left = iter(reversed(out))
        return "".join(next(left) if c in alphabet else c for c in text)

    def card(self, text: str) -> str | None:
        d = _digits(text)
        if not 13 <= len(d) <= 19 or luhn_digit(d[:-1]) != int(d[-1]) or len(set(d)) == 1:
            return None
        # the first digit, of the card's kind, stays
        n = len(d) - 2
        body = d[0] + f"{self._move(f'card:{len(d)}:{d[0]}', 10**n, int(d[1:-1])):0{n}d}"
        return _fill(text, body + str(luhn_digit(body)))

    def iban(self, text: str) -> str | None:
        flat = text.replace(" ", "")
        # check digits 00, 01 and 99 belong to no account, though the sum may be right
        if not "02" <= flat[2:4] <= "98" or not 15 <= len(flat) <= 34 or int("".join(str(int(c, 36)) for c in flat[4:] + flat[:4])) % 97 != 1:
            return None
        account = self._letters(f"iban:{flat[:2]}:letters", self._letters(f"iban:{flat[:2]}", flat[4:], "0123456789"), UPPER_DIGITS[:26])
        check = 98 - int("".join(str(int(c, 36)) for c in account + flat[:2] + "00")) % 97
        left = iter(f"{flat[:2]}{check:02d}{account}")
        return "".join(c if c == " " else next(left) for c in text)

    def ssn(self, text: str) -> str | None:
        d = _digits(text)
        area, group, serial = int(d[:3]), int(d[3:5]), int(d[5:])
        if area in (0, 666) or area >= 900 or not group or not serial:
            return None
        x = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
        x, serial = divmod(self._move("ssn", 898 * 99 * 9999, x), 9999)
        area, group = divmod(x, 99)
        area += 1 + (area >= 665)
        return _fill(text, f"{area:03d}{group + 1:02d}{serial + 1:04d}")

    def phone(self, text: str) -> str | None:
        d = _digits(text)
        plan = d[1:] if len(d) == 11 and d[0] == "1" else d if len(d) == 10 and not text.startswith("+") else ""
        if plan:
            if plan[0] < "2" or plan[3] < "2":
                return self._outside_plan(text, d, plan) if self.all_phones and ("+" in text or "(" in text) else None
            x = ((int(plan[:3]) - 200) * 800 + int(plan[3:6]) - 200) * 10000 + int(plan[6:])
            x, line = divmod(self._move("phone:1", 800 * 800 * 10000, x), 10000)
            area, exchange = divmod(x, 800)
            return _fill(text, d[: len(d) - 10] + f"{area + 200}{exchange + 200}{line:04d}")
        if not text.startswith("+") or not 8 <= len(d) <= 15 or d[0] in "01":
            return None
        n = len(d) - 2
        return _fill(text, d[:2] + f"{self._move(f'phone:{d[:2]}:{n}', 10**n, int(d[2:])):0{n}d}")

    def _outside_plan(self, text: str, d: str, plan: str) -> str:
        """Numbers that the plan doesn't give out (area code or exchange below 200) are permuted among themselves."""
        area, exchange, line = int(plan[:3]), int(plan[3:6]), int(plan[6:])
        x = (area * 1000 + exchange if area < 200 else 200_000 + (area - 200) * 200 + exchange) * 10000 + line
        x, line = divmod(self._move("phone:1:outside", 360_000 * 10000, x), 10000)
        area, exchange = divmod(x, 1000) if x < 200_000 else divmod(x - 200_000, 200)
        area += 200 * (x >= 200_000)
        return _fill(text, d[: len(d) - 10] + f"{area:03d}{exchange:03d}{line:04d}")

    def ipv4(self, text: str) -> str | None:
        octets = text.split(".")
        if any(int(o) > 255 or (o[0] == "0" and o != "0") for o in octets):
            return None
        x = self._move("ipv4", 1 << 32, int.from_bytes(bytes(map(int, octets)), "big"))
        return ".".join(map(str, x.to_bytes(4, "big")))

    def date(self, text: str) -> str | None:
        sep = re.search(r"[-/.]", text)[0]
        parts = [int(x) for x in text.split(sep)]
        day = None
        for order in ((0, 1, 2),) if text.index(sep) == 4 else ((2, 1, 0), (2, 0, 1)):
            try:
                day = datetime.date(*(parts[k] for k in order)).toordinal()
                break
            except ValueError:
                continue
        if day is None or not FIRST_DAY <= day <= LAST_DAY:
            return None
        days = _days()[datetime.date.fromordinal(day).day > 12]
        new = datetime.date.fromordinal(days[self._move(f"date:{len(days)}", len(days), bisect_left(days, day))])
        out = [""] * 3
        for k, value, wide in zip(order, (new.year, new.month, new.day), (4, 2, 2), strict=True):
            out[k] = f"{value:0{wide}d}"
        return sep.join(out)

    def email(self, text: str) -> str:
        name, _, domain = text.rpartition("@")
        # case doesn't make another person, so the pseudonym is in lower case
        name = self._letters("email:digits", name.lower(), "0123456789")
        return f"{self._letters('email:letters', name, LOWER)}@{domain}"

    def access_key(self, text: str) -> str:
        return text[:4] + self._letters("access_key", text[4:], UPPER_DIGITS)

    def hex_secret(self, text: str) -> str | None:
        head, body = re.fullmatch(r"(.*?)([0-9a-fA-F]+)", text, re.S).groups()
        lower, upper = body.lower(), body.upper()
        if lower == upper:
            return head + self._letters("hex:digits", body, "0123456789")
        mixed = body not in (lower, upper)
        new = body if mixed else lower
        # walked until the case can be told from the letters, as it can in the value
        while True:
            new = self._letters("hex:mixed", new, "0123456789abcdefABCDEF") if mixed else self._letters("hex", new, "0123456789abcdef")
            if new.lower() != new.upper() and (not mixed or new not in (new.lower(), new.upper())):
                return head + (new.upper() if body == upper else new)

    def _find(self, kind: str, text: str) -> str | None:
        plain = _ascii_digits(text)
        new = getattr(self, kind)(plain)
        if plain == text or new is None:
            return new
        zero = next(ord(c) - unicodedata.decimal(c) for c in text if c.isdecimal() and not c.isascii())
        return "".join(chr(zero + int(c)) if c in "0123456789" else c for c in new)


_KINDS = (
    ("email", r"(?<![\w.+-])[A-Za-z0-9_][A-Za-z0-9_.+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+(?![\w-])"),
    ("hex_secret", r"(?i:\b(?:password|passwd|secret|token|api_?key)\b)\s*[=:]\s*[\"']?[0-9a-fA-F]{12,64}(?![0-9A-Za-z])"),
    ("access_key", r"(?<![A-Za-z0-9])A[KS]IA[A-Z0-9]{16}(?![A-Za-z0-9])"),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    ("date", r"(?<![\w./-])(?:\d{4}([-/.])\d{2}\1\d{2}|\d{2}([-/.])\d{2}\2\d{4})(?![\w/-]|\.\d)"),
    ("ipv4", r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?!\w|\.\d)"),
    ("ssn", r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"),
    ("phone", r"(?<![\w+])(?:\+1[ .-]?|1[ .-])?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\w)|(?<![\w+])\+1\d{10}(?!\w)|(?<![\w+])\+[2-9]\d{0,2}(?:[ .-]?\(?\d{2,5}\)?){2,5}(?!\w|\.\d)"),
    ("card", r"(?<![\w.-])(?:\d{13,19}|(?:\d(?: ?\d){12,18}|\d(?:-?\d){12,18})(?!\w|-\d|\.\d)|\d{4}(?:[ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{5})(?!\w|-\d)"),
)
_ANY = re.compile("|".join(f"(?P<{kind}>{re.sub(r'\\([12])', lambda m: f'(?P=s{m[1]})', re.sub(r'\(\[-/\.\]\)', lambda m, n=iter('12'): f'(?P<s{next(n)}>[-/.])', pattern))})" for kind, pattern in _KINDS))


#: Kinds in groups, whose match may reach into a number that follows.
_GROUPED = frozenset(("card", "phone", "iban"))


def _valid(kind: str, found: str, formats: Formats) -> tuple[str, str] | None:
    """(value, pseudonym) of the longest start of a match, in whole groups, that validates."""
    longer: list[str] = []
    while True:
        new = formats.find(kind, found)
        # a card before a number of odd length: walked until card and number together don't pass for a longer card
        while new is not None and kind == "card" and any(formats.find(kind, new + x[len(new) :]) is not None for x in longer):
            new = formats.find(kind, new)
        if new is not None or kind not in _GROUPED:
            return None if new is None else (found, new)
        groups = re.match(r"(.*\w\)?)[ .-]+\(?\w+\)?\Z", found, re.S)
        if groups is None:
            return None
        longer.append(found)
        found = groups[1]


def rewrite(text: str, formats: Formats) -> tuple[str, int]:
    """The text with every valid value replaced, and how many were."""
    out, done, count, at = [], 0, 0, 0
    while match := _ANY.search(text, at):
        valid = _valid("date" if match.lastgroup in ("s1", "s2") else match.lastgroup, match[0], formats)
        if valid is None:
            at = match.start() + 1
            # within a run of digits nothing else can start
            while at < len(text) and text[at].isdigit() and text[at - 1].isdigit():
                at += 1
            continue
        out += [text[done : match.start()], valid[1]]
        done = at = match.start() + len(valid[0])
        count += 1
    return "".join([*out, text[done:]]) if count else text, count


#: In Java's words: a digit of any script, an @, or what stands before a secret or in a key that may be letters alone.
_GATE = r"[\p{Nd}@]|(?i)password|passwd|secret|token|api_?key|A[KS]IA"


def _rewritten(text: Column, key: bytes, reveal: bool) -> Column:
    """struct(text, n): null where the text holds no candidate."""

    @F.pandas_udf("text string, n int")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        formats = Formats(key, reveal, all_phones=True)
        for texts in batches:
            found = [(None, 0) if t is None else rewrite(t, formats) for t in texts]
            yield pd.DataFrame(found, columns=["text", "n"])

    # the texts that reach Python are those that may hold a value; the others are passed as nulls
    return run(F.when(text.rlike(_GATE), text))


def pseudonymise(docs: DataFrame, key: bytes, reveal: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, n_replaced), a row for each row of docs."""
    common.tune(docs.sparkSession)
    chosen = common.pick(docs, doc_id=id_col, t=text_col).withColumn("t", F.col("t").cast("string"))
    return chosen.withColumn("r", _rewritten(F.col("t"), key, reveal)).select("doc_id", F.coalesce("r.text", "t").alias("text"), F.coalesce("r.n", F.lit(0)).alias("n_replaced"))


def pseudonymise_documents(docs: DataFrame, key: bytes) -> DataFrame:
    """docs with pseudonyms in their texts: the columns of documents; n_chars is that of the new text."""
    common.tune(docs.sparkSession)
    done = common.documents(docs).withColumn("r", _rewritten(F.col("text"), key, False))
    text = F.coalesce("r.text", "text")
    return done.select("doc_id", text.alias("text"), "lang", "source", F.when(F.col("r.n") > 0, F.length("r.text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))
