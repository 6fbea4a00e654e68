"""License scans by ordered signature rules.

Each text is brought to normal form (A-Z in lower case, words apart by one blank). One
Aho-Corasick pass over it finds which keywords it holds; only the rules whose keywords
are all there are run (``license_rules``: some hundreds of patterns, from sentences of
license texts down to mere mentions). Each match is a detection with the rank of its
rule. A detection goes if another one of the same or a better rank contains its
interval; of equal intervals the better rank stays, then the earlier rule. So "lesser
general public license" silences the "general public license" inside, and a notice
silences the bare name. Base phrases are always reported.

``score`` is the largest weight of a remaining detection, 0 without one. Words are counted
from 0. A NULL text counts as empty: no words, no labels, score 0. Every row is judged by
itself: repeated rows and ids give a row each, NULL ids stay NULL, an empty table gives no
rows, extra columns are ignored. A text is scanned whole, in time linear in its length and
its detections.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from sitelab.llm.common import checked_columns, table, text_slices
from sitelab.llm.license_rules import GENERIC, Rule, all_rules
from sitelab.llm.registry import query

#: Fixed value: what stands between words.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


class Rules:
    """The rules, found by their keywords."""

    def __init__(self, rules: list[Rule]):
        self.rules = rules
        self.keywords = sorted({k for r in rules for k in r.keywords})
        number = {k: i for i, k in enumerate(self.keywords)}
        self.needed = [frozenset(number[k] for k in r.keywords) for r in rules]
        # A rule is reached by one of its keywords, the longest as the rarest one.
        self.by_keyword: dict[int, list[int]] = {}
        for i, rule in enumerate(rules):
            self.by_keyword.setdefault(number[max(rule.keywords, key=len)], []).append(i)
        self.automaton = ahocorasick.Automaton()
        for keyword, i in number.items():
            self.automaton.add_word(keyword, i)
        self.automaton.make_automaton()

    def of(self, text: str) -> list[int]:
        """Numbers of the rules whose keywords all stand in the text, in order."""
        found = {i for _, i in self.automaton.iter(text)}
        return sorted(r for k in found for r in self.by_keyword.get(k, ()) if self.needed[r] <= found)


@dataclass(frozen=True)
class Detection:
    rule: int
    start: int
    end: int


def detections(text: str, rules: Rules) -> list[Detection]:
    """All matches of all rules that may match, by place in the normalised text."""
    found = []
    for number in rules.of(text):
        rule = rules.rules[number]
        for match in rule.pattern.finditer(text):
            if rule.holds in match.group():
                found.append(Detection(number, match.start() + 1, match.end()))
    return found


def kept(found: list[Detection], rules: Rules) -> list[Detection]:
    """Detections that no other one of the same or a better rank contains.

    Containment is transitive, so whether the other one stays does not matter: in the order
    of starts, the furthest end of each rank so far decides.
    """
    order = sorted(found, key=lambda d: (d.start, -d.end, rules.rules[d.rule].rank, d.rule))
    furthest = [-1] * (GENERIC + 1)
    out = []
    for d in order:
        rank = rules.rules[d.rule].rank
        if max(furthest[: rank + 1]) < d.end:
            out.append(d)
        furthest[rank] = max(furthest[rank], d.end)
    return out


def normalised(texts: pa.Array) -> pa.Array:
    """Lower case, one blank between words and at both ends; a text without words is one blank."""
    plain = pc.ascii_lower(pc.fill_null(texts, ""))
    around = pc.binary_join_element_wise(" ", plain, " ", "")
    return pc.replace_substring_regex(around, BETWEEN, " ")


def scan(text: str, rules: Rules) -> tuple:
    """(n_base, first_word, last_word, base_labels, labels, score, detections) of a normalised text."""
    found = detections(text, rules)
    if not found:
        return 0, None, None, "", "", 0.0, ""
    base = [d for d in found if rules.rules[d.rule].base]
    first = last = None
    if base:
        first = text.count(" ", 0, min(d.start for d in base)) - 1
        last = text.count(" ", 0, max(d.start for d in base)) - 1
    stay = kept(found, rules)
    label = lambda some: ",".join(sorted({rules.rules[d.rule].label for d in some}))
    places, word, at = [], -1, 0
    for d in stay:
        word += text.count(" ", at, d.start)
        at = d.start
        places.append(f"{rules.rules[d.rule].label}:{word}:{word + text.count(' ', d.start, d.end) + 1}")
    score = max(rules.rules[d.rule].weight for d in [*stay, *base])
    return len(base), first, last, label(base), label([*stay, *base]), score, ",".join(places)


_OUT = pa.schema(
    [
        ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()),
        ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
        ("detections", pa.string()),
    ]
)
_RULES: list[Rules] = []


def default_rules() -> Rules:
    """The rules of this module, built once a worker."""
    if not _RULES:
        _RULES.append(Rules(all_rules()))
    return _RULES[0]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rules = default_rules()
    for whole in batches:
        for batch in text_slices(whole):
            texts = normalised(batch.column("text"))
            words = pc.subtract(pc.count_substring(texts, " "), 1)
            rows = zip(*(scan(t, rules) for t in texts.to_pylist()), strict=True)
            columns = [batch.column("doc_id"), words.cast(pa.int64())]
            yield pa.RecordBatch.from_arrays(
                [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip([*columns, *rows], _OUT, strict=True)],
                schema=_OUT,
            )


def license_scan(docs: DataFrame) -> DataFrame:
    """doc_id, counts and places of the base phrases, labels, score, and the detections as ``label:word:end``."""
    rows = checked_columns(docs, {"doc_id": "long", "text": "string"})
    return rows.mapInArrow(
        _scan,
        "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
        "score double, detections string",
    )


@query("op11_license_scan")
def op11(spark, sf_dir) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))
