"""Personal data: an Aho-Corasick automaton finds anchors, local parsers expand and validate them."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import carried, in_parts, quoted

BASE_KINDS = ("email", "ip", "card", "phone")
MORE_KINDS = ("url", "secret", "ssn", "iban", "account", "address")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
URL = re.compile(r"[^\s<>\"'`{}|\\^\[\]]+")
SSN = re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
SECRET = re.compile(r"[\x20\t]?[:=][\x20\t]?[\"']?([A-Za-z0-9_./+-]{6,})")
IBAN = re.compile(r"(?:[\x20:#]|no\.?|is){0,4}([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30})")
ACCOUNT = re.compile(r"(?:[\x20:#]|number|no\.?|is){0,6}([0-9](?:-?[0-9]){5,16})(?![0-9])")
STREET = re.compile(r"[A-Z][A-Za-z'-]*")

#: Cues of identifiers, in the spellings that are looked for.
SECRET_CUES = ("password", "passwd", "secret", "token", "api_key", "apikey", "api-key", "access_key")
ACCOUNT_CUES = ("account", "acct")
STREET_CUES = ("Street", "St.", "Avenue", "Ave", "Road", "Rd", "Boulevard", "Blvd", "Lane", "Drive")


@lru_cache(maxsize=1)
def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    spelled = lambda cues: {s for c in cues for s in (c, c.capitalize(), c.upper())}
    kinds = {"email": {"@"}, "phone": {"+"}, "digit": set("0123456789"), "url": {"http://", "https://", "ftp://", "www."}}
    kinds |= {"secret": spelled(SECRET_CUES), "iban": {"IBAN", "iban", "Iban"}, "account": spelled(ACCOUNT_CUES), "address": set(STREET_CUES)}
    for kind, cues in kinds.items():
        for cue in cues:
            found.add_word(cue, (kind, len(cue)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def mod97(iban: str) -> bool:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def spans(text: str) -> list[tuple[str, int, int]]:
    """All spans (kind, start, end) of a text, in code points: by kind as listed, then by start.

    Each base kind is what its pattern finds leftmost and without overlap, less the matches that fail their
    check. Every anchor is expanded once, from where the kind's last match ended, so the work is linear.
    """
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in (*BASE_KINDS, *MORE_KINDS)}
    done = dict.fromkeys(found, 0)
    for last, (kind, length) in automaton().iter(text):
        at = last - length + 1
        if kind == "digit":
            if at >= done["ip"]:
                chain = DOTTED.match(text, at)
                done["ip"] = chain.end()
                if chain.end() - at > 6:
                    parts, start = chain.group().split("."), at
                    for i in range(0, len(parts) - 3, 4):
                        four = parts[i : i + 4]
                        end = start + sum(map(len, four)) + 3
                        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                            found["ip"].append((start, end))
                        start = end + 1
            if at >= done["card"]:
                if chain := DIGITS.match(text, at):
                    done["card"] = chain.end()
                    if chain.end() - at >= 13:
                        digits = re.sub(r"[\x20-]", "", chain.group())
                        if 13 <= len(digits) <= 19 and luhn(digits):
                            found["card"].append(chain.span())
                else:
                    done["card"] = at + 1
            if at >= done["ssn"] and (at == 0 or not text[at - 1].isalnum()) and (m := SSN.match(text, at)):
                done["ssn"] = m.end()
                found["ssn"].append(m.span())
        elif kind == "email":
            if m := DOMAIN.match(text, at + 1):
                start = at
                while start > done["email"] and text[start - 1] in LOCAL:
                    start -= 1
                if start < at:
                    done["email"] = m.end()
                    found["email"].append((start, m.end()))
        elif kind == "phone":
            if at >= done["phone"] and (m := PHONE.match(text, at)):
                done["phone"] = m.end()
                if 9 <= sum(c in "0123456789" for c in m.group()) <= 15:
                    found["phone"].append(m.span())
        elif kind == "url":
            if at >= done["url"] and (m := URL.match(text, last + 1)):
                end = last + 1 + len(m.group().rstrip(".,;:!?)"))
                if end > last + 1:
                    done["url"] = end
                    found["url"].append((at, end))
        elif kind == "address":
            if at >= done["address"] and not text[last + 1 : last + 2].isalnum() and (start := house(text, done["address"], at)) >= 0:
                done["address"] = last + 1
                found["address"].append((start, last + 1))
        else:
            if at >= done[kind] and (at == 0 or not text[at - 1].isalnum()):
                m = {"secret": SECRET, "iban": IBAN, "account": ACCOUNT}[kind].match(text, last + 1)
                if m and kind == "iban":
                    for end in range(m.end(1), m.start(1) + 14, -1):  # the longest that passes its check
                        if (text[end : end + 1] + " ")[0] in " .,;:)\n\t" and mod97(text[m.start(1) : end].replace(" ", "")):
                            done[kind] = end
                            found[kind].append((m.start(1), end))
                            break
                elif m:
                    done[kind] = m.end(1)
                    found[kind].append(m.span(1))
    return [(k, a, b) for k, own in found.items() for a, b in own]


def house(text: str, least: int, at: int) -> int:
    """Where the address begins whose street ends at `at`: one to four capitalised words back, of whatever length, at a
    number of one to six digits; -1 without. Nothing before `least` is looked at."""
    end = at
    for words in range(5):
        if end - 1 < least or text[end - 1] != " ":
            return -1
        gap = end - 1
        end = text.rfind(" ", least, gap) + 1 or least
        word = text[end:gap]
        digits = len(word) - len(word.rstrip("0123456789"))
        if words and 1 <= digits <= 6:
            return gap - digits
        if words == 4 or not STREET.fullmatch(word):
            return -1
    return -1


def masked(text: str, own: list[tuple[str, int, int]]) -> str:
    """text with each span, or run of overlapping spans, as the kind of its first in brackets."""
    out, at, end = [], 0, -1
    for kind, a, b in sorted(own, key=lambda s: (s[1], -s[2])):
        if a >= end:
            out += [text[at:a], f"[{kind.upper()}]"]
            at = end = b
        else:
            at = end = max(end, b)
    return "".join(out) + text[at:]


def find_personal_data(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", with_text: bool = False, columns: list[str] | None = None) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans): a row for each document; no shuffle.

    spans holds kind:start:end of all spans, base_sha256 is the digest of those of the base kinds alone.
    with_text adds masked, the text with each span replaced by its kind. A null text is an empty one (its
    masked text is null); null or repeated ids are told as they are; an empty table gives an empty result.
    `columns` of docs are passed through, with _ before their names; others are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in in_parts(batches, 512):
            out = []
            for t in part.column(1).to_pylist():
                own = spans(t) if t else []
                told = [f"{k}:{a}:{b}" for k, a, b in own]
                base = [x for x, (k, _, _) in zip(told, own, strict=True) if k in BASE_KINDS]
                counts = [sum(k == kind for k, _, _ in own) for kind in BASE_KINDS]
                out.append((*counts, hashlib.sha256(",".join(base).encode()).hexdigest(), ",".join(told), masked(t, own) if with_text and t else t))
            cols = list(zip(*out, strict=True))
            arrays = [part.column(0), *(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4], pa.string()), pa.array(cols[5], pa.string())]
            yield pa.RecordBatch.from_arrays([*arrays, *([pa.array(cols[6], pa.string())] if with_text else []), *part.columns[2:]], [*names, *part.schema.names[2:]])

    names = ["doc_id", *(f"n_{k}" for k in BASE_KINDS), "base_sha256", "spans", *(["masked"] if with_text else [])]
    passing, fields, _, passed = carried(docs, columns)
    schema = ", ".join([*(f"{c} {'long' if c == 'doc_id' or c.startswith('n_') else 'string'}" for c in names), *fields])
    return docs.select(quoted(doc_id).cast("long").alias("doc_id"), quoted(text).cast("string").alias("text"), *passing).mapInArrow(run, schema).select(*names, *passed)
