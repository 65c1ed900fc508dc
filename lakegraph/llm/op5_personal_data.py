"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, digits, plus signs before a digit, ``://``
and account cues. From each anchor a local parser walks to the left and right, decides the boundaries
and validates what is between them. Nothing else of the text is looked at again.

Kinds ``email``, ``ip``, ``card`` and ``phone`` follow their patterns exactly: leftmost and without
overlap within a kind, matches that fail their check dropped without a retry. Two kinds are added:
``login``, an address with a scheme whose authority holds a user name and a password, and ``account``,
a number of at least six digits (or an IBAN with a right check sum) after an account cue.
"""

from __future__ import annotations

import re
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakegraph.llm.shared import table, with_arrow

KINDS = ("email", "ip", "card", "phone", "login", "account")
BASE = KINDS[:4]
SCHEMES = ("http", "https", "ftp", "ftps", "sftp", "ssh", "ldap", "postgres", "mysql", "mongodb", "redis", "amqp", "smtp", "imap")
CUES = ("account", "acct", "iban", "konto", "compte", "cuenta")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_LABEL, _DOTTED = re.compile(r"[A-Za-z0-9-]+"), re.compile(r"\.[A-Za-z0-9-]+")
_NUMBERS, _CHAIN = re.compile(r"[0-9]+(?:\.[0-9]+)*"), re.compile(r"[0-9](?:[ -]?[0-9])*")
_DIAL = re.compile(r"[ ().0-9-]*")
_AUTHORITY = re.compile(r"[^\s/?#\"'<>@]+:[^\s/?#\"'<>@]+@[^\s/?#\"'<>@:]+(?::[0-9]+)?")
_AFTER_CUE = re.compile(r"[ ]?(?:no\.?|number|nr\.?|id|#)?[ ]?[:=#]?[ ]?", re.IGNORECASE)
_IBAN, _PLAIN = re.compile(r"[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]){11,30}"), re.compile(r"[0-9](?:[ -]?[0-9]){5,33}")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _iban(text: str) -> bool:
    text = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1


def email_at(text: str, at: int, least: int) -> tuple[int, int] | None:
    """The address around an at-sign, starting at ``least`` or later."""
    start = at
    while start > least and _LOCAL.match(text[start - 1]):
        start -= 1
    label = _LABEL.match(text, at + 1)
    if start == at or not label:
        return None
    end = label.end()
    while more := _DOTTED.match(text, end):
        end = more.end()
    return (start, end) if end > label.end() else None


def ips_at(text: str, start: int) -> tuple[list[tuple[int, int]], int]:
    """The addresses in the run of dotted numbers that starts here, and where it ends."""
    run = _NUMBERS.match(text, start)
    parts = run.group().split(".")
    found, at = [], start
    for i in range(0, len(parts) - 3, 4):
        four = parts[i:i + 4]
        end = at + sum(map(len, four)) + 3
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in four):
            found.append((at, end))
        at = end + 1
    return found, run.end()


def card_at(text: str, start: int) -> tuple[tuple[int, int] | None, int]:
    """The card number that is the chain of digits which starts here, and where the chain ends."""
    chain = _CHAIN.match(text, start)
    digits = re.sub(r"[ -]", "", chain.group()) if 14 <= chain.end() - start <= 37 else ""
    return (chain.span() if 14 <= len(digits) <= 19 and luhn(digits) else None), chain.end()


def phone_at(text: str, plus: int) -> tuple[int, int] | None:
    """The phone number that starts with this plus sign, which a digit follows."""
    end = _DIAL.match(text, plus + 2).end()
    while end > plus + 2 and not "0" <= text[end - 1] <= "9":
        end -= 1
    if end < plus + 4:
        return None
    return (plus, end) if 10 <= sum("0" <= c <= "9" for c in text[plus:end]) <= 15 else None


def login_at(text: str, colon: int) -> tuple[int, int] | None:
    """An address with a login around ``://``."""
    authority = _AUTHORITY.match(text, colon + 3)
    start = colon
    while start > 0 and text[start - 1].isascii() and text[start - 1].isalpha():
        start -= 1
    return (start, authority.end()) if authority and text[start:colon].lower() in SCHEMES else None


def account_at(text: str, after: int) -> tuple[int, int] | None:
    """The account number that follows a cue."""
    at = _AFTER_CUE.match(text, after).end()
    if at > after:
        for end in (m.end() for m in [_IBAN.match(text, at)] if m):
            while end > at + 14:
                if (end == len(text) or not text[end].isalnum()) and _iban(text[at:end]):
                    return at, end
                end -= 1
        plain = _PLAIN.match(text, at)
        if plain and (plain.end() == len(text) or not text[plain.end()].isalnum()):
            return plain.span()
    return None


@lru_cache(maxsize=1)
def anchors() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    found.add_word("@", "email")
    found.add_word("://", "login")
    for d in "0123456789":
        found.add_word(d, "digit")
        found.add_word("+" + d, "phone")
    for cue in CUES:
        for word in {cue, cue.upper(), cue.capitalize()}:
            found.add_word(word, "account")
    found.make_automaton()
    return found


def find(text: str) -> list[tuple[int, int, str]]:
    """All spans ``(start, end, kind)`` in code points, by start and then kind as listed."""
    spans = []
    email_end = ip_end = card_end = 0
    for last, kind in anchors().iter(text):
        if kind == "digit":
            if last >= ip_end:
                some, ip_end = ips_at(text, last)
                spans += [(a, b, "ip") for a, b in some]
            if last >= card_end:
                one, card_end = card_at(text, last)
                if one:
                    spans.append((*one, "card"))
        elif kind == "email":
            if one := email_at(text, last, email_end):
                email_end = one[1]
                spans.append((*one, kind))
        elif one := (phone_at(text, last - 1) if kind == "phone" else login_at(text, last - 2) if kind == "login" else account_at(text, last + 1)):
            spans.append((*one, kind))
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2])))


def find_personal_data(docs: DataFrame, name: str = "pii") -> DataFrame:
    """``docs`` with ``pii``: an array of ``kind, start, end`` by start and kind.

    A null or empty text has an empty array. A column of that name is replaced; others pass.
    """
    kind = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])

    def run(column: pa.Array) -> list[pa.Array]:
        rows = [[{"kind": k, "start": a, "end": b} for a, b, k in find(t.as_py() or "")] for t in column]
        return [pa.array(rows, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))]
    return with_arrow(docs, ["text"], [T.StructField(name, T.ArrayType(kind))], run)


def op5_personal_data(spark, sf_dir: str) -> DataFrame:
    """Personal data in every whole text of documents; a null text counts as empty. Counts of added kinds come last."""
    found = find_personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    def count(kind):
        return F.size(F.filter(pii, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    pii = F.col("pii")
    base = F.filter(pii, lambda s: s["kind"].isin(*BASE))
    more = [count(kind) for kind in KINDS if kind not in BASE]
    return found.select("doc_id", *map(count, BASE), F.sha2(joined(base), 256).alias("base_sha256"), joined(pii).alias("spans"), *more)
