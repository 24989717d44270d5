"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors (at-signs, plus signs, digits, URL schemes, identifier cues) in one pass
over the whole text; a deterministic parser beside each anchor expands and validates the boundaries. Four base
kinds follow fixed patterns, leftmost and non-overlapping within a kind; three more come from cues:

* email, ip, card (Luhn), phone - the base kinds;
* login - ``scheme://user:password@host``; iban - mod-97 account numbers; secret - a value of 16 or more
  characters that a cue such as ``token =``, ``password:`` or ``Bearer`` introduces, an access key id, or a block
  that holds a private key. Secrets do not overlap: cues inside one are passed over.

Defined cases: null text is empty and has no spans; ties and repeated rows are answered alike, row by row; very
long texts are scanned whole, in linear time, also those of nothing but cues, digits or anchors; no rows give no
rows; other columns pass through, but those with the names of the results are replaced.
"""

from __future__ import annotations

import hashlib
import re

import ahocorasick
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelode.llm.common import add_columns, numbered, renamed

#: Kinds in the order that breaks ties between spans with one start; the first four are the base kinds.
KINDS = ("email", "ip", "card", "phone", "login", "iban", "secret")
BASE = 4
#: Fixed patterns of the base kinds, each tried only at its anchor.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
LOGIN = re.compile(r"://[^\s/@:]+:[^\s/@]+@[A-Za-z0-9.-]+")
IBAN = re.compile(r"[\s:#=]{0,3}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30})")
SECRET = re.compile(r"[\"']?\s{0,3}[:=]\s{0,3}[\"']?([A-Za-z0-9_+/=-]{16,})")
BEARER = re.compile(r"\s{1,3}([A-Za-z0-9_+/=.~-]{16,})")
KEY_ID = re.compile(r"[0-9A-Z]{16}(?![0-9A-Za-z])")
KEY_BLOCK = re.compile(r"[A-Z0-9 ]{0,40}PRIVATE KEY-----")
KEY_END = "-----END "
#: Cues that introduce an identifier.
SECRET_CUES = ("token", "secret", "password", "passwd", "pwd", "api_key", "api-key", "apikey", "access_key", "access-key", "private_key", "credential")
BEARER_CUES = ("bearer",)
IBAN_CUES = ("iban",)
#: Beginnings of access key ids and of key blocks, as they are written.
KEY_ID_CUES = ("AKIA", "ASIA")
BLOCK_CUES = ("-----BEGIN ",)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if i % 2:
            n = n * 2 - 9 if n > 4 else n * 2
        total += n
    return total % 10 == 0


def _mod97(account: str) -> bool:
    moved = account[4:] + account[:4]
    return 15 <= len(account) <= 34 and int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def finder():
    """find(text) -> spans (start, kind index, end) in order."""
    machine = ahocorasick.Automaton()
    for d in "0123456789":
        machine.add_word(d, ("d", 1))
    machine.add_word("@", ("@", 1))
    machine.add_word("+", ("+", 1))
    machine.add_word("://", ("u", 3))
    for cues, tag in ((SECRET_CUES, "s"), (BEARER_CUES, "b"), (IBAN_CUES, "i")):
        for cue in cues:
            for form in {cue, cue.upper(), cue.capitalize(), re.sub(r"(?:^|[_-])(.)", lambda m: m[0].upper(), cue)}:
                machine.add_word(form, (tag, len(form)))
    for cues, tag in ((KEY_ID_CUES, "k"), (BLOCK_CUES, "p")):
        for cue in cues:
            machine.add_word(cue, (tag, len(cue)))
    machine.make_automaton()

    def find(text: str) -> list[tuple[int, int, int]]:
        spans: list[tuple[int, int, int]] = []
        if not text:
            return spans
        email_end = ip_end = card_end = phone_end = secret_end = 0
        last_digit = -2
        closed = True  # whether a key block may still end
        for end, (tag, size) in machine.iter(text):
            if tag == "d":
                if end >= card_end and (m := CARD.match(text, end)):
                    card_end = m.end()
                    digits = "".join(c for c in m[0] if c not in " -")
                    if 14 <= len(digits) <= 19 and luhn(digits):
                        spans.append((end, 2, card_end))
                # Inside a run of digits a match begins at its first digit, or where the last match ended.
                if (end != last_digit + 1 or end == ip_end) and end >= ip_end and (m := IP.match(text, end)):
                    ip_end = m.end()
                    if all(len(x := p.lstrip("0")) <= 3 and int(x or 0) <= 255 for p in m[0].split(".")):
                        spans.append((end, 1, ip_end))
                last_digit = end
            elif tag == "@":
                at = end
                while at > email_end and text[at - 1] in LOCAL:
                    at -= 1
                if at < end and (m := DOMAIN.match(text, end + 1)):
                    email_end = m.end()
                    spans.append((at, 0, email_end))
            elif tag == "+":
                if end >= phone_end and (m := PHONE.match(text, end)):
                    phone_end = m.end()
                    if 10 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                        spans.append((end, 3, phone_end))
            elif tag == "u":
                if m := LOGIN.match(text, end - 2):
                    at = end - 2
                    while at > 0 and text[at - 1].isascii() and (text[at - 1].isalnum() or text[at - 1] in "+.-"):
                        at -= 1
                    spans.append((at, 4, m.end()))
            elif tag == "i":
                if (m := IBAN.match(text, end + 1)) and (stop := _iban_end(m[1])):
                    spans.append((m.start(1), 5, m.start(1) + stop))
            elif end < secret_end:
                continue
            elif tag == "k":
                if (end - size < 0 or not text[end - size].isalnum()) and (m := KEY_ID.match(text, end + 1)):
                    secret_end = m.end()
                    spans.append((end - size + 1, 6, secret_end))
            elif tag == "p":
                if closed and (m := KEY_BLOCK.match(text, end + 1)):
                    stop = text.find(KEY_END, m.end())
                    closed = stop >= 0
                    if closed:
                        line = text.find("\n", stop)
                        secret_end = line if line >= 0 else len(text)
                        spans.append((end - size + 1, 6, secret_end))
            elif m := (SECRET if tag == "s" else BEARER).match(text, end + 1):
                secret_end = m.end(1)
                spans.append((m.start(1), 6, secret_end))
        spans.sort()
        return spans

    return find


def _iban_end(run: str) -> int:
    """The longest prefix of run, at a word's end, that is a valid account number; 0 if none."""
    for stop in range(len(run), 14, -1):
        if (stop == len(run) or not run[stop].isalnum() or run[stop - 1] == " ") and run[stop - 1] != " " and _mod97(run[:stop].replace(" ", "")):
            return stop
    return 0


def find_pii(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs plus pii, an array of (start, end, kind) in code points, end exclusive, by start and then kind."""

    def make():
        find = finder()
        return lambda t: ([{"start": s, "end": e, "kind": KINDS[k]} for s, k, e in find(t)],)

    return add_columns(docs, [text], make, "pii array<struct<start:int,end:int,kind:string>>")


def redact_pii(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with each span (overlapping ones as one) replaced by [KIND], and n_chars, where there is one, counted again."""

    def make():
        find = finder()

        def clean(t):
            if t is None:
                return (None,)
            out, at, spans = [], 0, find(t)
            for s, k, e in spans:
                if s >= at:
                    out += [t[at:s], f"[{KINDS[k].upper()}]"]
                at = max(at, e)
            return ("".join([*out, t[at:]]),)

        return clean

    out, instead = add_columns(numbered(docs), [f"d_{docs.columns.index(text)}"], make, "clean string"), {text: "clean"}
    if "n_chars" in docs.columns:
        out, instead = out.withColumn("counted", F.length("clean").cast(docs.schema["n_chars"].dataType)), instead | {"n_chars": "counted"}
    return renamed(out, docs.columns, instead)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_pii(docs)
    line = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    base = F.filter("pii", lambda x: x["kind"].isin(*KINDS[:BASE]))
    count = lambda k: F.size(F.filter("pii", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    more = [count(k) for k in KINDS[BASE:]]
    return found.select("doc_id", *[count(k) for k in KINDS[:BASE]], F.sha2(line(base), 256).alias("base_sha256"), line(F.col("pii")).alias("spans"), *more, F.size("pii").cast("long").alias("n_spans"))


def digest(spans: list[tuple[int, int, int]]) -> str:
    """base_sha256 of spans, for tests."""
    return hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans if k < BASE).encode()).hexdigest()
