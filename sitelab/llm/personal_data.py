"""Personal data by anchor expansion.

One Aho-Corasick pass finds anchors: at-signs, plus signs, digits, schemes and the cue
words of identifiers. From each anchor a deterministic local parser expands to both
sides, checks the result and moves a cursor past what it took, so every stretch of
text is parsed once per kind, however many anchors it holds.

Base kinds, leftmost and without overlap per kind: ``email``, ``ip`` (parts up to 255),
``card`` (13 to 19 digits, Luhn), ``phone`` (9 to 15 digits). Further kinds:
``account`` (number after an account cue), ``iban`` (check digits), ``secret`` (access
keys by their prefixes, web tokens, private key blocks, and credentials after a cue),
``ssn``, ``url`` (scheme and host). Positions are code points, the end is exclusive.
Each kind has a count; ``has_personal_data`` tells whether there is any span but addresses
of pages.

A NULL text counts as empty and has no spans. Every row is judged by itself: repeated rows
and ids give a row each, an empty table none; extra columns are ignored. A long text is
scanned whole, each stretch once per kind.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from sitelab.llm.common import checked_columns, table, text_slices
from sitelab.llm.registry import query

BASE = ("email", "ip", "card", "phone")
MORE = ("account", "iban", "secret", "ssn", "url")

# Cue words; each is looked for in lower case, capitalised and in capitals.
ACCOUNT_CUES = ("account", "acct", "konto", "compte", "cuenta")
SECRET_CUES = ("password", "passwd", "pwd", "token", "secret", "api_key", "apikey", "api-key")

#: Starts of keys of well-known services, and what follows them.
KEYS = {
    "AKIA": r"[A-Z0-9]{16}", "ASIA": r"[A-Z0-9]{16}", "ghp_": r"[A-Za-z0-9]{36,}", "gho_": r"[A-Za-z0-9]{36,}", "ghs_": r"[A-Za-z0-9]{36,}",
    "github_pat_": r"[A-Za-z0-9_]{22,}", "glpat-": r"[A-Za-z0-9_-]{20,}", "xoxb-": r"[A-Za-z0-9-]{20,}", "xoxp-": r"[A-Za-z0-9-]{20,}",
    "sk_live_": r"[A-Za-z0-9]{16,}", "rk_live_": r"[A-Za-z0-9]{16,}", "sk-": r"[A-Za-z0-9_-]{32,}", "AIza": r"[A-Za-z0-9_-]{35}",
    "hf_": r"[A-Za-z0-9]{30,}", "npm_": r"[A-Za-z0-9]{36}", "SG.": r"[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,}",
}

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_NUMBERS = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_NUMBER = re.compile(r"[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])")
_SSN = re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_ACCOUNT = re.compile(r"(?i)(?:[ \t]*(?:no\.?|nr\.?|number|num\.?|#))?[ \t]*[:=#]?[ \t]*([0-9]{6,17})(?![0-9])")
_VALUE = re.compile(r"[ \t]*[:=][ \t]*[\"']?([A-Za-z0-9_./+=-]{8,})")
_KEYS = {start: re.compile(rest + r"(?![A-Za-z0-9])") for start, rest in KEYS.items()}
_WEB_TOKEN = re.compile(r"[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")
_BLOCK_BEGIN = re.compile(r"(?:[A-Z0-9]+ ){0,4}PRIVATE KEY(?: BLOCK)?-----")
_BLOCK_END = re.compile(r"-----END (?:[A-Z0-9]+ ){0,4}PRIVATE KEY(?: BLOCK)?-----")
_HOST = re.compile(r"://[^\s<>\"'/?#]*[A-Za-z0-9][^\s<>\"']*")
_NOT_DIGIT = re.compile(r"[^0-9]")


def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for sign in ("@", "+"):
        found.add_word(sign, sign)
    for digit in "0123456789":
        found.add_word(digit, "0")
    for scheme in ("http", "https", "ftp", "HTTP", "HTTPS"):
        found.add_word(f"{scheme}://", f"url {len(scheme)}")
    for start in KEYS:
        found.add_word(start, f"key {start}")
    found.add_word("eyJ", "web token")
    found.add_word("-----BEGIN ", "block")
    for kind, cues in (("account", ACCOUNT_CUES), ("secret", SECRET_CUES)):
        for cue in cues:
            for form in {cue, cue.capitalize(), cue.upper()}:
                found.add_word(form, kind)
    found.make_automaton()
    return found


_ANCHORS = _automaton()


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and (not part or int(part) <= 255)


def _iban(text: str) -> bool:
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1


def _apart(text: str, at: int) -> bool:
    """Whether no letter or digit stands before a place."""
    return at == 0 or not text[at - 1].isalnum()


def find_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans per kind, by start."""
    found: dict[str, list[tuple[int, int]]] = {kind: [] for kind in (*BASE, *MORE)}
    done = dict.fromkeys((*BASE, *MORE), 0)

    def took(kind: str, start: int, end: int) -> None:
        found[kind].append((start, end))
        done[kind] = end

    for at, anchor in _ANCHORS.iter(text):
        if anchor == "0":
            if at >= done["ip"]:
                chain = _NUMBERS.match(text, at)
                done["ip"] = chain.end()
                if chain.group().count(".") >= 3:
                    parts = [m.span() for m in _NUMBER.finditer(text, at, chain.end())]
                    for i in range(0, len(parts) - 3, 4):
                        if all(_octet(text[s:e]) for s, e in parts[i : i + 4]):
                            found["ip"].append((parts[i][0], parts[i + 3][1]))
            if at >= done["card"]:
                chain = _CARD.match(text, at)
                done["card"] = chain.end() if chain else at + 1
                if chain and chain.end() - at >= 13:
                    digits = _NOT_DIGIT.sub("", chain.group())
                    if 13 <= len(digits) <= 19 and _luhn(digits):
                        found["card"].append(chain.span())
            if at >= done["ssn"]:
                if (m := _SSN.match(text, at)) and (at == 0 or not (text[at - 1].isalnum() or text[at - 1] == "-")):
                    area, group, serial = m.group().split("-")
                    if area not in ("000", "666") and area[0] != "9" and group != "00" and serial != "0000":
                        took("ssn", *m.span())
            if at - 2 >= done["iban"] and (m := _IBAN.match(text, at - 2)) and _apart(text, at - 2) and _iban(m.group()):
                took("iban", *m.span())
        elif anchor == "@":
            start = at
            while start > done["email"] and text[start - 1] in _LOCAL:
                start -= 1
            if start < at and (m := _DOMAIN.match(text, at + 1)):
                took("email", start, m.end())
        elif anchor == "+":
            if at >= done["phone"] and (m := _PHONE.match(text, at)):
                done["phone"] = m.end()
                if 9 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
                    found["phone"].append(m.span())
        elif anchor.startswith("key "):
            first = anchor[4:]
            start = at + 1 - len(first)
            if start >= done["secret"] and _apart(text, start) and (m := _KEYS[first].match(text, at + 1)):
                took("secret", start, m.end())
        elif anchor == "web token":
            if at - 2 >= done["secret"] and _apart(text, at - 2) and (m := _WEB_TOKEN.match(text, at - 2)):
                took("secret", *m.span())
        elif anchor == "block":
            start = at + 1 - len("-----BEGIN ")
            if start >= done["secret"] and (m := _BLOCK_BEGIN.match(text, at + 1)):
                # A block that is never closed is a secret up to the end of the text.
                closed = _BLOCK_END.search(text, m.end())
                took("secret", start, closed.end() if closed else len(text))
        elif anchor in ("account", "secret"):
            m = (_ACCOUNT if anchor == "account" else _VALUE).match(text, at + 1)
            if m and m.start(1) >= done[anchor]:
                took(anchor, *m.span(1))
        else:
            start = at - 2 - int(anchor[4:])
            if start >= done["url"] and _apart(text, start) and (m := _HOST.match(text, at - 2)):
                took("url", start, m.end())
    return found


def _joined(found: dict, kinds) -> str:
    return ",".join(f"{kind}:{s}:{e}" for kind in kinds for s, e in found[kind])


_OUT = pa.schema(
    [
        ("doc_id", pa.int64()),
        *((f"n_{kind}", pa.int64()) for kind in BASE),
        ("base_sha256", pa.string()),
        ("spans", pa.string()),
        *((f"n_{kind}", pa.int64()) for kind in MORE),
        ("n_spans", pa.int64()),
        ("has_personal_data", pa.bool_()),
    ]
)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in text_slices(whole):
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                found = find_spans(text or "")
                base = hashlib.sha256(_joined(found, BASE).encode()).hexdigest()
                n = {kind: len(spans) for kind, spans in found.items()}
                personal = any(n[kind] for kind in n if kind != "url")
                rows.append(
                    (doc_id, *(n[k] for k in BASE), base, _joined(found, (*BASE, *MORE)), *(n[k] for k in MORE), sum(n.values()), personal)
                )
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _OUT, strict=True)], schema=_OUT
            )


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, digest of the base spans, all spans as text, the other counts."""
    docs = checked_columns(docs, {"doc_id": "long", "text": "string"})
    counts, more = (", ".join(f"n_{kind} long" for kind in kinds) for kinds in (BASE, MORE))
    return docs.mapInArrow(
        _scan, f"doc_id long, {counts}, base_sha256 string, spans string, {more}, n_spans long, has_personal_data boolean"
    )


@query("op10_personal_data")
def op10(spark, sf_dir) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))
