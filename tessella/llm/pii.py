"""Personal data by anchor expansion.

An Aho-Corasick automaton finds the anchors: at-signs, plus signs, digits,
URL schemes and the cue words of accounts, addresses and secrets, in English,
German, French and Spanish and whatever the case of their letters.  A
deterministic parser at each anchor grows the span to both sides and validates
it.  Texts without an anchor byte never leave the byte kernel.

Kinds, in the order that ties of start follow: email, ip, card and phone (the
base kinds), then url, account, address and secret, which the method adds.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.kernel import runs

KINDS = ("email", "ip", "card", "phone", "url", "account", "address", "secret")

_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_URL = re.compile(r"(?:[a-z][a-z0-9+.-]{1,9}://|www\.)[^\s<>\"'`{}|\\^\[\]]+", re.I)
_ACCOUNT = re.compile(r"(?:\s*(?:number|no|nr|num|id|code)\b\.?)?\s*[:#=]?\s*([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{2,4}){3,8}|[0-9](?:[\x20-]?[0-9]){4,})", re.I)
_NUMBER_BEFORE = re.compile(r"([0-9]{1,5}[A-Za-z]?\x20(?:[A-Z][\w'-]*\x20){1,3})$")  # 221B Baker | Street
_NUMBER_LEFT = re.compile(r"([0-9]{1,5}(?:\x20?(?:bis|ter))?,?\x20)$")  # 12, | rue de la Paix
_NAME_RIGHT = re.compile(r"(?:\x20(?:de|la|le|du|des|l'|d'|[A-ZÀ-Þ]))(?:[\w'-]*)(?:\x20(?:de|la|le|du|des|[A-ZÀ-Þ][\w'-]*)){0,4}")
_STEM_LEFT = re.compile(r"([A-ZÄÖÜ][\wß-]*)$")  # Haupt | straße 12
_NUMBER_AFTER = re.compile(r"\x20[0-9]{1,4}[a-z]?\b")
_NAME_AND_NUMBER = re.compile(r"(?:\x20(?:de|la|del|los|las|el|[A-ZÁÉÍÓÚÑ][\w'-]*)){1,5},?\x20(?:n[.º°]{1,2}\x20?)?[0-9]{1,5}\b")  # Calle | Mayor, 5
_SECRET = re.compile(r"\s{0,3}(?:is|ist|est|es)?\s{0,3}[\"']?\s{0,3}[:=]{0,2}>?\s{0,3}[\"']?([A-Za-z0-9+/_=.~-]{8,})")
_MARKED = {"akia": re.compile(r"AKIA[0-9A-Z]{16}(?![0-9A-Za-z])"), "ghp_": re.compile(r"ghp_[0-9A-Za-z]{30,}"), "sk-": re.compile(r"sk-[0-9A-Za-z_-]{16,}"), "eyj": re.compile(r"eyJ[0-9A-Za-z_-]{8,}\.[0-9A-Za-z_-]{8,}\.[0-9A-Za-z_-]+"), "-----begin": re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----[0-9A-Za-z+/=\s]+-----END [A-Z ]*PRIVATE KEY-----")}

# Cue words, in lower case, by kind.
_CUES = {
    "url": ("http://", "https://", "ftp://", "www."),
    "account": ("account", "acct", "iban", "ssn", "passport", "konto", "kontonummer", "reisepass", "compte", "passeport", "cuenta", "pasaporte"),
    "street": ("street", "avenue", "road", "boulevard", "lane", "drive"),
    "rue": ("rue", "avenue", "boulevard", "place", "chemin"),
    "straße": ("straße", "strasse", "platz", "allee", "gasse", "weg"),
    "calle": ("calle", "avenida", "plaza", "paseo", "camino"),
    "secret": ("token", "secret", "password", "passwd", "pwd", "api_key", "api-key", "apikey", "api key", "access_key", "private_key", "bearer", "passwort", "kennwort", "mot de passe", "jeton", "contraseña", "clave"),
    "marked": tuple(_MARKED),
}


def _automaton():
    found = ahocorasick.Automaton()
    anchors: dict[str, list[str]] = {"@": ["at"], "+": ["plus"]} | {d: ["digit"] for d in "0123456789"}
    for kind, cues in _CUES.items():
        for cue in cues:
            anchors.setdefault(cue, []).append(kind)
    for cue, kinds in anchors.items():
        found.add_word(cue, (tuple(kinds), len(cue)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        if k % 2:
            x = x * 2 - 9 if x > 4 else x * 2
        total += x
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _street_span(kind: str, text: str, at: int, end: int, past: int) -> tuple[int, int] | None:
    """The address around a street word from at to end; it starts at past or later."""
    before, ends_word = text[max(past, at - 60) : at], not text[end : end + 1].isalnum()
    starts_word = not text[at - 1 : at].isalnum() or at == 0
    if kind == "street" and ends_word and starts_word and text[at].isupper() and (m := _NUMBER_BEFORE.search(before)):
        return at - len(m[1]), end
    if kind == "rue" and ends_word and starts_word and (m := _NUMBER_LEFT.search(before)) and (n := _NAME_RIGHT.match(text, end)):
        return at - len(m[1]), n.end()
    if kind == "straße" and (n := _NUMBER_AFTER.match(text, end)) and (m := _STEM_LEFT.search(before)):
        return at - len(m[1]), n.end()
    if kind == "calle" and starts_word and text[at].isupper() and (n := _NAME_AND_NUMBER.match(text, end)):
        return at, n.end()
    return None


def _secret_value(value: str) -> bool:
    """Whether the word after a cue looks made up by a machine: digits, and letters or great length."""
    return any("0" <= c <= "9" for c in value) and (any(c.isalpha() for c in value) or len(value) >= 16)


def find_spans(text: str, automaton) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of all spans of one text, in order."""
    out = []
    past = dict.fromkeys(KINDS, 0)
    previous_digit = -2
    for last, (kinds, length) in automaton.iter(text.encode().lower().decode()):  # only ASCII changes, so places stay
        at = last - length + 1
        for kind in kinds:
            if kind == "digit":
                fresh = previous_digit != at - 1
                previous_digit = at
                if fresh and at >= past["ip"] and (m := _IP.match(text, at)):
                    past["ip"] = m.end()
                    if all(len(p) < 8 and int(p) <= 255 for p in (x.lstrip("0") or "0" for x in m[0].split("."))):
                        out.append((at, 1, m.end()))
                if fresh and at >= past["card"] and (m := _CARD.match(text, at)):
                    past["card"] = m.end()
                    if 12 <= len(d := _digits(m[0])) <= 19 and luhn(d):
                        out.append((at, 2, m.end()))
            elif kind == "at":
                start = at
                while start > past["email"] and text[start - 1] in _LOCAL:
                    start -= 1
                if start < at and (m := _EMAIL.match(text, start)):
                    past["email"] = m.end()
                    out.append((start, 0, m.end()))
            elif kind == "plus":
                if at >= past["phone"] and (m := _PHONE.match(text, at)):
                    past["phone"] = m.end()
                    if 9 <= len(_digits(m[0])) <= 15:
                        out.append((at, 3, m.end()))
            elif kind == "url":
                if at >= past["url"] and (m := _URL.match(text, at)):
                    end = at + len(m[0].rstrip(".,;:!?)"))
                    past["url"] = m.end()
                    if "." in text[at + length : end]:
                        out.append((at, 4, end))
            elif kind == "account":
                if at >= past["account"] and (m := _ACCOUNT.match(text, last + 1)):
                    past["account"] = m.end()
                    out.append((m.start(1), 5, m.end(1)))
            elif kind == "secret":
                if at >= past["secret"] and (m := _SECRET.match(text, last + 1)) and _secret_value(m[1]):
                    past["secret"] = m.end()
                    out.append((m.start(1), 7, m.end(1)))
            elif kind == "marked":
                if at >= past["secret"] and (m := _MARKED[text[at : last + 1].lower()].match(text, at)):
                    past["secret"] = m.end()
                    out.append((at, 7, m.end()))
            elif at >= past["address"] and (span := _street_span(kind, text, at, last + 1, past["address"])):
                past["address"] = span[1]
                out.append((span[0], 6, span[1]))
    return sorted(out)


_ANCHOR = np.zeros(256, dtype=bool)
_ANCHOR[[ord(c) for c in "@+0123456789"]] = True


def _has_anchor(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Texts that hold an anchor byte, "://" or "www."; accounts, addresses and secrets hold digits."""
    mark = _ANCHOR[buf]
    if len(buf) >= 4:
        mark[:-2] |= (buf[:-2] == 58) & (buf[1:-1] == 47) & (buf[2:] == 47)
        w = (buf | 32) == 119
        mark[:-3] |= w[:-3] & w[1:-2] & w[2:-1] & (buf[3:] == 46)
    at = np.flatnonzero(mark)
    return np.searchsorted(at, offsets[1:]) > np.searchsorted(at, offsets[:-1])


_DDL = "doc_id long, spans array<struct<kind:string,start:int,stop:int,value:string>>"
_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("value", pa.string())]))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    automaton = _automaton()
    for batch in batches:
        for a, b, buf, offs in runs(batch.column(1)):
            out: list[list] = [[] for _ in range(b - a)]
            for i in np.flatnonzero(_has_anchor(buf, offs)):
                text = buf[offs[i] : offs[i + 1]].tobytes().decode()
                out[i] = [(KINDS[k], s, e, text[s:e]) for s, k, e in find_spans(text, automaton)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([[dict(zip(("kind", "start", "stop", "value"), x, strict=True)) for x in row] for row in out], _SPAN)], names=["doc_id", "spans"])


def find_personal_data(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """doc_id and its spans (kind, start, stop, value), by start and then kind.

    Places count code points and ``stop`` is exclusive.  Spans of one kind do
    not overlap; spans of different kinds can, and those that start together
    (ties) follow the order of KINDS.  Null and empty texts have no spans;
    repeated rows each give a row; an empty table gives none.  Very long texts
    are searched whole, in one row.  Only ``doc_id`` and the text are read, so
    further columns of any name do no harm.
    """
    return docs.select("doc_id", F.col(text)).mapInArrow(_scan, _DDL)


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and places of personal data in all documents; see ``find_personal_data`` for nulls, ties, repeats, empty tables and long texts.

    After the columns asked for: counts of the kinds that the method adds, and
    n_private, of all kinds but url.
    """
    found = find_personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base, added = KINDS[:4], KINDS[4:]

    def joined(kinds):
        own = F.filter("spans", lambda s: s["kind"].isin(*kinds))
        return F.array_join(F.transform(own, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")

    def number(*kinds):
        return F.size(F.filter("spans", lambda s: s["kind"].isin(*kinds))).cast("long")

    counts = [number(k).alias(f"n_{k}") for k in base]
    more = [number(k).alias(f"n_{k}") for k in added]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(KINDS).alias("spans"), *more, number(*(k for k in KINDS if k != "url")).alias("n_private"))
