"""Personal data in texts by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, plus signs, digits,
schemes and identifier cues. At each anchor a small deterministic parser expands
to the boundaries of the item and validates it. All parsers are linear in the
length of what they look at, and every anchor inside an item that has been read
is passed over, so a text costs time in proportion to its length.

Kinds, in the order that breaks ties:

* email, ip, card, phone: leftmost, non-overlapping for each kind, as if the
  pattern of each ran over the whole text; what fails validation is dropped and
  is not tried again from within. Parts of an ip are at most 255; a card has 12
  to 19 digits that pass Luhn's check; a phone has 9 to 15 digits.
* url: a web address that carries a user name or password before its host.
* account: an IBAN with valid check digits, or 6 to 17 digits, after a cue.
* secret: the value that is assigned to a password, token or key.
"""

import hashlib
import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textclusters.llm.shared import map_batches, narrow, texts_of

KINDS = ("email", "ip", "card", "phone", "url", "account", "secret")
BASE = KINDS[:4]

#: The words that announce an account number or a secret.
ACCOUNT_CUES = ("account", "acct", "iban", "konto", "kontonummer", "compte", "cuenta")
SECRET_CUES = ("password", "passwd", "pwd", "token", "secret", "api_key", "apikey", "api-key", "access_key", "private_key")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SCHEME = _LOCAL - frozenset("_%")
_AUTHORITY = re.compile(r"[^\s/?#@\"'<>]+@[A-Za-z0-9.-]+(?::[0-9]+)?(?:[/?#][^\s\"'<>]*)?")
_ACCOUNT = re.compile(r"(?:\x20?(?:no|nr|number|num|n)\b\.?)?\x20?[:#=]?\x20?([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}|[0-9]{6,17}(?![0-9]))", re.A)
_SECRET = re.compile(r"[\"']?\x20?[:=]\x20?(?:\"([^\"\s]{6,})\"|'([^'\s]{6,})'|([A-Za-z0-9_+/=.!#$%-]{6,}))", re.A)

#: Characters of an IBAN by country.
_IBAN_LENGTHS = {x[:2]: int(x[2:]) for x in (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DK18 DO28 EE20 EG29 ES24 FI18 FO18 FR27 "
    "GB22 GE22 GI23 GL18 GR27 GT28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 "
    "MD24 ME22 MK19 MR27 MT31 MU30 NL18 NO15 PK24 PL28 PS29 PT25 QA29 RO24 RS22 SA24 SC31 SD18 SE24 SI19 SK24 SM27 ST25 SV28 "
    "TL23 TN24 TR26 UA29 VA22 VG24 XK20"
).split()}


def _luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def _iban(text: str) -> int:
    """The length of the start of a text that is an IBAN: it has valid check digits and
    ends before a blank or with the text; 0 if there is none. Of 15 to 34 characters
    besides blanks, the country's number is tried first, then all from the longest."""
    places = [i for i, c in enumerate(text) if c != " "]
    for n in (_IBAN_LENGTHS.get(text[:2], 34), *range(34, 14, -1)):
        if n > len(places):
            continue
        end = places[n - 1] + 1
        if end < len(text) and text[end] != " ":
            continue
        own = text[:end].replace(" ", "")
        if int("".join(str(int(c, 36)) for c in own[4:] + own[:4])) % 97 == 1:
            return end
    return 0


def anchors() -> ahocorasick.Automaton:
    """The automaton of all anchors; the value is (kind of anchor, length)."""
    found = ahocorasick.Automaton()
    for word in ("@", "+", "://", *"0123456789"):
        found.add_word(word, (word if not word.isdigit() else "0", len(word)))
    for name, cues in (("account", ACCOUNT_CUES), ("secret", SECRET_CUES)):
        for cue in cues:
            for form in {cue, cue.upper(), cue.capitalize()}:
                found.add_word(form, (name, len(form)))
    found.make_automaton()
    return found


def find(text: str, automaton: ahocorasick.Automaton) -> list[tuple[int, int, int]]:
    """(start, place in KINDS, end) of every item, sorted; end is exclusive."""
    found, email_end, dotted_end, digits_end, scheme_end, secret_end, account_end = [], 0, 0, 0, 0, 0, 0
    for last, (anchor, size) in automaton.iter(text):
        at = last - size + 1
        if anchor == "@":
            start = at
            while start > email_end and text[start - 1] in _LOCAL:
                start -= 1
            if start < at and (domain := _DOMAIN.match(text, at + 1)):
                email_end = domain.end()
                found.append((start, 0, email_end))
        elif anchor == "0":
            if at >= dotted_end:
                dotted_end = (chain := _DOTTED.match(text, at)).end()
                if dotted_end - at >= 7:
                    ends = [i for i in range(at, dotted_end) if text[i] == "."] + [dotted_end]
                    starts = [at, *(e + 1 for e in ends)]
                    for k in range(3, len(ends), 4):
                        # Leading zeros may be many; the value is what counts.
                        if all(len(part) <= 3 and int(part or "0") <= 255 for part in (text[starts[j] : ends[j]].lstrip("0") for j in range(k - 3, k + 1))):
                            found.append((starts[k - 3], 1, ends[k]))
                del chain
            if at >= digits_end and (chain := _DIGITS.match(text, at)):
                digits_end = chain.end()
                digits = chain[0].replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and _luhn(digits):
                    found.append((at, 2, digits_end))
        elif anchor == "+":
            if (phone := _PHONE.match(text, at)) and 9 <= sum(c.isdigit() for c in phone[0]) <= 15:
                found.append((at, 3, phone.end()))
        elif anchor == "://":
            start, first = at, at
            while start > scheme_end and text[start - 1] in _SCHEME:
                start -= 1
                first = start if text[start].isalpha() else first
            scheme_end = at + size
            if first < at and (rest := _AUTHORITY.match(text, scheme_end)):
                found.append((first, 4, rest.end()))
        elif anchor == "account":
            if at >= account_end and not text[at - 1 : at].isalpha() and (number := _ACCOUNT.match(text, last + 1)) and (size := len(number[1]) if number[1].isdigit() else _iban(number[1])):
                account_end = number.start(1) + size
                found.append((number.start(1), 5, account_end))
        elif at >= secret_end and (value := _SECRET.match(text, last + 1)):
            secret_end = value.end()
            found.append((*(place := value.span(value.lastindex))[:1], 6, place[1]))
    return sorted(found)


def personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, items array<struct<kind, start, end>>) for every row of docs(doc_id, text).

    Offsets are code points, the end is exclusive; items are ordered by start,
    then by kind. A null or empty text has none. Rows that repeat a doc_id and
    rows without one each get their row; other columns are ignored. No shuffle.
    """

    def make():
        automaton = anchors()

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            items = [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in find(x, automaton)] for x in texts_of(batch)]
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(items, kind)], names=["doc_id", "items"])

        return work

    return map_batches(narrow(docs), make, "doc_id long, items array<struct<kind:string,start:int,end:int>>")


def digest(found: DataFrame) -> DataFrame:
    """Counts, hash and text form of personal_data's items, one row for each of its rows;
    counts of the added kinds and of all items come last."""
    told = lambda items: F.array_join(F.transform(items, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    of_base = F.filter("items", lambda x: x["kind"].isin(*BASE))
    of_kind = lambda kind: F.filter("items", lambda x: x["kind"] == kind)
    counts = [F.size(of_kind(kind)).cast("long").alias(f"n_{kind}") for kind in KINDS]
    base, added = counts[: len(BASE)], counts[len(BASE) :]
    return found.select("doc_id", *base, F.sha2(told(of_base), 256).alias("base_sha256"), told(F.col("items")).alias("spans"), *added, F.size("items").cast("long").alias("n_items"))


def base_digest(text: str, automaton: ahocorasick.Automaton) -> str:
    """The base hash of one text, for tests."""
    return hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in find(text, automaton) if k < len(BASE)).encode()).hexdigest()
