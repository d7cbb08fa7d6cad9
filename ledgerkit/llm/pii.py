"""Operator 1 - personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, ``+``, digits, URL schemes and
identifier cues (bank, tax, passport, credentials, key blocks). At each anchor a deterministic
local parser expands to the left and right, fixes the boundaries and validates: check
digits where the identifier has them, length, character classes and entropy for credentials.
There is no shuffle: one map over the documents, one row out per row in.

Defined results: null text counts as empty; a null ``doc_id`` stays null; repeated rows
give repeated results; an empty table gives an empty result; other columns are
ignored whatever their names; texts of any length are processed whole.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

from pyspark.sql import DataFrame

from ledgerkit.llm.common import map_rows, pick

BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("url", "iban", "account", "secret", "key", "vat", "swift", "passport")
ORDER = {k: i for i, k in enumerate(BASE_KINDS + ADDED_KINDS)}

SCHEMES = ("http://", "https://", "ftp://")
IBAN_CUES = ("IBAN", "Iban", "iban")
ACCOUNT_CUES = ("account", "Account", "ACCOUNT", "acct", "Acct", "ACCT")
# Words before a credential, written in any of three cases; words of a compound are joined by one
# of the joints.
SECRET_CUES = ("token", "secret", "api*key", "access*key", "auth*key", "secret*key", "private*key", "account*key")
PASSWORD_CUES = ("password", "passwd", "passphrase", "pwd")
JOINTS = ("", "_", "-", " ")
BEARER_CUES = ("Bearer", "bearer", "BEARER")
ACCESS_IDS = ("AKIA", "ASIA")
KEY_CUES = ("-----BEGIN ",)
VAT_CUES = ("VAT", "TVA", "USt-IdNr", "USt-ID", "vat", "tva")
SWIFT_CUES = ("SWIFT", "Swift", "BIC", "Bic")
PASSPORT_CUES = ("passport", "Passport", "PASSPORT")


def spellings(cue: str) -> set[str]:
    words = {cue.replace("*", joint) for joint in JOINTS}
    return {f(w) for w in words for f in (str.lower, str.capitalize, str.upper, str.title)}

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGITS = re.compile(r"[0-9]+")
_IP = re.compile(r"([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_URL = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+(?::[0-9]{1,5})?(?:[/?#][^\s<>\"']*)?")
_IBAN = re.compile(r"[ :#]{0,3}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30})")
_ACCOUNT = re.compile(r"(?: (?:no|number|nr)\.?)?[ :#]{1,3}([0-9]{6,17})(?![0-9])", re.IGNORECASE)
_GIVEN = r"[\"']?[ \t]{0,2}(?:=>|:=|[:=])[ \t]{0,2}(?:\"([^\"\s]{8,512})\"|'([^'\s]{8,512})'|([A-Za-z0-9+/_.~=!@#$%^&*-]{8,512}))"
_VALUE = re.compile(_GIVEN)
_BEARER = re.compile(r"[ \t]{1,2}([A-Za-z0-9+/_.~=-]{16,2048})")
_ACCESS_ID = re.compile(r"[A-Z0-9]{16}(?![A-Za-z0-9])")
_KEY = re.compile(r"([A-Z ]{0,20}PRIVATE KEY)-----[A-Za-z0-9+/=\s:,-]{16,}?-----END \1-----")
_VAT = re.compile(r"(?:[ -]?(?:no|number|nr|id)\.?)?[ .:#]{1,3}((?:DE|FR) ?[0-9]{2}(?: ?[0-9]){7,9})(?![0-9A-Za-z])", re.IGNORECASE)
_SWIFT = re.compile(r"(?:[ -]?(?i:code|no)\.?)?[ /:#]{1,3}([A-Z]{6}[A-Z2-9][A-NP-Z0-9](?:[A-Z0-9]{3})?)(?![A-Za-z0-9])")
_PASSPORT = re.compile(r"(?: (?i:no|number|nr)\.?)?[ :#]{1,3}([A-Z0-9]{8,9})(?![A-Za-z0-9])")
SECRET_CHARS, SECRET_BITS = 16, 3.0
PASSWORD_CLASSES = 3


def entropy(text: str) -> float:
    """Bits per character."""
    return -sum(k / len(text) * math.log2(k / len(text)) for k in Counter(text).values())


def classes(text: str) -> int:
    """How many of lower case, upper case, digits and other characters there are."""
    return sum(map(bool, (any(c.islower() for c in text), any(c.isupper() for c in text), any(c.isdigit() for c in text), any(not c.isalnum() for c in text))))


def is_secret(value: str) -> bool:
    """Long, mixed and irregular: no word, path or sentence."""
    return len(value) >= SECRET_CHARS and any(c.isdigit() for c in value) and any(c.isalpha() for c in value) and entropy(value) >= SECRET_BITS


def vat_ok(code: str) -> bool:
    """Check digits of a German (ISO 7064, mod 11, 10) or French (mod 97) number."""
    digits = [int(c) for c in code[2:]]
    if code[:2] == "DE" and len(digits) == 9:
        product = 10
        for d in digits[:8]:
            product = 2 * ((d + product) % 10 or 10) % 11
        return (11 - product) % 10 == digits[8] and digits[0] > 0
    if code[:2] == "FR" and len(digits) == 11:
        return int(code[2:4]) == (12 + 3 * (int(code[4:]) % 97)) % 97 and luhn(code[4:])
    return False


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or (len(part) == 3 and part <= "255")


def _mod97(code: str) -> bool:
    turned = code[4:] + code[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    a.add_word("@", ("@", 1))
    a.add_word("+", ("+", 1))
    for d in "0123456789":
        a.add_word(d, ("0", 1))
    families = (
        ("s", SCHEMES), ("i", IBAN_CUES), ("a", ACCOUNT_CUES), ("b", BEARER_CUES), ("A", ACCESS_IDS), ("k", KEY_CUES), ("v", VAT_CUES),
        ("w", SWIFT_CUES), ("p", PASSPORT_CUES), ("t", sorted(set().union(*map(spellings, SECRET_CUES)))), ("P", sorted(set().union(*map(spellings, PASSWORD_CUES)))),
    )
    for kind, words in families:
        for w in words:
            a.add_word(w, (kind, len(w)))
    a.make_automaton()
    return a


def find(text: str, anchors) -> list[tuple[int, int, str]]:
    """All spans ``(start, end, kind)`` of ``text``, by start, then kind."""
    out: list[tuple[int, int, str]] = []
    email_end = ip_end = card_end = url_end = 0
    for last, (what, n) in anchors.iter(text):
        if what == "0":
            if last >= card_end:
                m = _CARD.match(text, last)
                if m is None:
                    card_end = last + 1
                else:
                    card_end = m.end()
                    digits = m.group().replace(" ", "").replace("-", "")
                    if 12 <= len(digits) <= 19 and luhn(digits):
                        out.append((last, card_end, "card"))
            if last >= ip_end:
                m = _IP.match(text, last)
                if m is None:
                    ip_end = _DIGITS.match(text, last).end()
                else:
                    ip_end = m.end()
                    if all(map(_small, m.groups())):
                        out.append((last, ip_end, "ip"))
        elif what == "@":
            start = last
            while start > email_end and text[start - 1] in _LOCAL:
                start -= 1
            if start < last and (m := _DOMAIN.match(text, last + 1)):
                email_end = m.end()
                out.append((start, email_end, "email"))
        elif what == "+":
            m = _PHONE.match(text, last)
            if m and 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append((last, m.end(), "phone"))
        elif what == "s":
            start = last + 1 - n
            if start >= url_end and (m := _URL.match(text, last + 1)):
                url_end = m.start() + len(m.group().rstrip(".,;:!?)]}"))
                out.append((start, url_end, "url"))
        elif what == "i":
            m = _IBAN.match(text, last + 1)
            if m and (end := _iban_end(m)):
                out.append((m.start(1), end, "iban"))
        elif what == "a":
            m = _ACCOUNT.match(text, last + 1)
            if m:
                out.append((m.start(1), m.end(1), "account"))
        elif (span := _identifier(text, what, last + 1, n)) and span not in out[-8:]:  # cues may end together
            out.append(span)
    out.sort(key=lambda s: (s[0], ORDER[s[2]]))
    return out


def _identifier(text: str, what: str, at: int, n: int) -> tuple[int, int, str] | None:
    """The identifier that a cue of length ``n`` ending before ``at`` announces, if it is one."""
    alone = at == n or not text[at - n - 1].isalnum()
    if what in "tP":
        if m := _VALUE.match(text, at):
            group = m.lastindex
            value = m.group(group) if group < 3 else m.group(group).rstrip(".,!")
            if is_secret(value) or (what == "P" and len(value) >= 8 and classes(value) >= PASSWORD_CLASSES):
                return m.start(group), m.start(group) + len(value), "secret"
    elif what == "b" and alone:
        if (m := _BEARER.match(text, at)) and is_secret(m.group(1)):
            return m.start(1), m.end(1), "secret"
    elif what == "A" and alone:
        if m := _ACCESS_ID.match(text, at):
            return at - n, m.end(), "secret"
    elif what == "k":
        if m := _KEY.match(text, at):
            return at - n, m.end(), "key"
    elif what == "v" and alone:
        if (m := _VAT.match(text, at)) and vat_ok(m.group(1).replace(" ", "").upper()):
            return m.start(1), m.end(1), "vat"
    elif what == "w" and alone:
        if m := _SWIFT.match(text, at):
            return m.start(1), m.end(1), "swift"
    elif what == "p" and alone:
        if (m := _PASSPORT.match(text, at)) and sum(c.isdigit() for c in m.group(1)) >= 6:
            return m.start(1), m.end(1), "passport"
    return None


def _iban_end(m: re.Match) -> int:
    """End of the longest prefix of the candidate that passes the check digits."""
    body = m.group(1)
    for cut in range(len(body), 14, -1):
        if body[cut - 1] != " ":
            code = body[:cut].replace(" ", "")
            if 15 <= len(code) <= 34 and _mod97(code):
                return m.start(1) + cut
    return 0


def spans_text(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def _worker():
    anchors = automaton()

    def work(ids, texts):
        cols: dict[str, list] = {"doc_id": ids, "base_sha256": [], "spans": []} | {f"n_{k}": [] for k in BASE_KINDS}
        for text in texts:
            spans = find(text or "", anchors)
            base = [s for s in spans if s[2] in BASE_KINDS]
            for k in BASE_KINDS:
                cols[f"n_{k}"].append(sum(s[2] == k for s in base))
            cols["base_sha256"].append(hashlib.sha256(spans_text(base).encode()).hexdigest())
            cols["spans"].append(spans_text(spans))
        return cols

    return work


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def find_personal_data(docs: DataFrame) -> DataFrame:
    """Spans of personal data for every row of ``docs`` (``doc_id``, ``text``)."""
    return map_rows(pick(docs, "doc_id", "text"), _worker, SCHEMA)


def redact(text: str, anchors=None) -> str:
    """``text`` with every span replaced by ``[kind]`` (overlaps: the first wins)."""
    parts, at = [], 0
    for a, b, kind in find(text, anchors or automaton()):
        if a >= at:
            parts += [text[at:a], f"[{kind}]"]
            at = b
    return "".join([*parts, text[at:]])
