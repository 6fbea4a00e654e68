"""SentencePiece encoding and decoding by streaming Viterbi.

Over the code points of a text a best way to every boundary is kept with a pointer to
where its last piece begins. No piece is longer than ``longest``, so only boundaries
within that distance can still grow; as soon as the back pointers of all of them meet
in one boundary, the ids before it are final and go out, and the window is cut there.
The window of the trellis stays a few times ``longest`` characters, whatever the length of
the text; all ids come out of it.

Two kinds of model are read. In a unigram model a way is as good as the sum of its
piece scores. In a merge (BPE) model a way is allowed if every two neighbouring pieces
stay apart when their joined text is merged by rank; each boundary then has exactly one
allowed way, the result of merging the whole text, and the same trellis finds it.
Characters outside the vocabulary become byte pieces, or one unknown id a run where
the model has no bytes.

Stretches between places that no piece can cross are independent: before the first space
mark of a run, and between characters that no piece holds side by side. A block of texts
is cut into stretches on its bytes at once, equal stretches of the block are streamed
through the trellis once (or remembered from the last blocks, in a table of bounded size),
and the ids are gathered back in order. A block holds about 8 MB of texts, or one text.

A NULL and an empty text have no ids (an empty list); an empty list decodes to the empty
text, a NULL list to NULL. Repeated rows give repeated results, an empty table none. Extra
columns pass through ``encoded`` and ``decoded``.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitelab.llm.common import checked_columns, table, text_slices
from sitelab.llm.registry import query

MARK = "▁"
#: Characters of stretches that a worker remembers before the table becomes the older one of two, and pairs before they start anew.
REMEMBERED = 1_500_000
PAIRS = 250_000
#: Bytes of texts that are encoded together; a worker keeps what the largest block took from the system.
BLOCK = 2 << 20
#: A pair of pieces is one whole number; what stands for no piece is none of theirs.
WIDE = 1 << 32
NO_PIECE = -(1 << 30)
#: A unigram way through a character outside the vocabulary costs this much more than the worst piece.
UNKNOWN_COST = 10.0


def _aside(joints: frozenset[str]) -> frozenset[str]:
    """ASCII characters other than letters that no piece joins with any other character; a text may be cut around runs of them."""
    aside = {chr(c) for c in range(128) if not chr(c).isalpha()} - {" "}
    while True:
        bound = {a for a, b in joints if a in aside and b not in aside}
        bound |= {b for a, b in joints if b in aside and a not in aside and a != MARK}
        if not bound:
            return frozenset(aside)
        aside -= bound


_REMEMBERED: dict[int, tuple[dict, list[dict]]] = {}


@dataclass
class Vocabulary:
    """What encoding needs of a model; plain data, so that it can be sent to the tasks."""

    merges: bool
    ids: dict[str, int]
    scores: dict[str, float]
    texts: list[str]
    byte_ids: list[int]
    unknown: int
    prefix: bool
    longest: int
    crossing: bool
    worst: float
    silent: frozenset[int]
    #: Neighbouring characters that some piece holds: nothing joins two characters that are not in here.
    joints: frozenset[str]
    #: Characters of which runs stand apart from the others.
    aside: frozenset[str]
    surfaces: pa.Array | None = field(default=None, repr=False)
    pairs: dict = field(default_factory=dict, repr=False)
    memory: list[dict] = field(default_factory=lambda: [{}, {}], repr=False)
    held: int = 0
    _automaton: ahocorasick.Automaton | None = field(default=None, repr=False)

    @staticmethod
    def load(path: str) -> Vocabulary:
        """Read a model file; only the identity normaliser is supported."""
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        return Vocabulary.of(model)

    @staticmethod
    def of(model) -> Vocabulary:
        normal, spec = model.normalizer_spec, model.trainer_spec
        if normal.precompiled_charsmap or normal.remove_extra_whitespaces or not normal.escape_whitespaces:
            raise ValueError("only models with the identity normaliser are supported")
        if spec.model_type not in (1, 2) or spec.treat_whitespace_as_suffix:
            raise ValueError("only unigram and merge models with a leading space mark are supported")
        kinds = [p.type for p in model.pieces]
        if set(kinds) - {1, 2, 3, 6}:
            raise ValueError("user-defined and unused pieces are not supported")
        usable = {p.piece: i for i, p in enumerate(model.pieces) if p.type == 1}
        joints = frozenset(p[i : i + 2] for p in usable for i in range(len(p) - 1))
        byte_ids = [i for i, kind in enumerate(kinds) if kind == 6]
        if byte_ids and len(byte_ids) != 256:
            raise ValueError("a model has 256 byte pieces or none")
        return Vocabulary(
            merges=spec.model_type == 2,
            ids=usable,
            scores={p: model.pieces[i].score for p, i in usable.items()},
            texts=[p.piece for p in model.pieces],
            byte_ids=byte_ids,
            unknown=kinds.index(2),
            prefix=normal.add_dummy_prefix,
            longest=max(map(len, usable), default=1),
            worst=min((model.pieces[i].score for i in usable.values()), default=0.0) - UNKNOWN_COST,
            crossing=any(MARK in p.lstrip(MARK) for p in usable),
            silent=frozenset(i for i, kind in enumerate(kinds) if kind == 3),
            joints=joints,
            aside=_aside(joints),
        )

    @property
    def automaton(self) -> ahocorasick.Automaton:
        """All pieces with their id and length."""
        if self._automaton is None:
            self._automaton = ahocorasick.Automaton()
            for piece, i in self.ids.items():
                self._automaton.add_word(piece, (i, len(piece)))
            self._automaton.make_automaton()
        return self._automaton

    def __getstate__(self):
        return self.__dict__ | {"pairs": None, "memory": None, "surfaces": None, "_automaton": None, "held": 0}

    def __setstate__(self, state):
        """What one task has remembered serves the next one of the same worker and model."""
        self.__dict__.update(state)
        key = hash((self.merges, tuple(self.texts), tuple(self.scores.values())))
        if key not in _REMEMBERED:
            _REMEMBERED.clear()
            _REMEMBERED[key] = ({}, [{}, {}], self.automaton)
        self.pairs, self.memory, self._automaton = _REMEMBERED[key]
        self.held = sum(map(len, self.memory[0]))


def _merged(text: str, scores: dict[str, float]) -> list[str]:
    """Pieces of a short text by merging the best neighbours first, the leftmost of equals."""
    parts = list(text)
    while len(parts) > 1:
        best, at = None, -1
        for i in range(len(parts) - 1):
            score = scores.get(parts[i] + parts[i + 1])
            if score is not None and (best is None or score > best):
                best, at = score, i
        if best is None:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


def _apart(left: int, right: int, v: Vocabulary) -> bool:
    """Whether two pieces stay as they are next to each other; with no left one, whether the piece forms at all."""
    key = left * WIDE + right
    known = v.pairs.get(key)
    if known is None:
        if len(v.pairs) >= PAIRS:
            v.pairs.clear()
        parts = [v.texts[i] if i >= 0 else chr(-i - 1) for i in (left, right) if i != NO_PIECE]
        known = v.pairs[key] = _merged("".join(parts), v.scores) == parts
    return known


def _piece_ids(piece: str, v: Vocabulary, out: list[int]) -> None:
    found = v.ids.get(piece)
    if found is not None:
        out.append(found)
    elif v.byte_ids:
        out.extend(v.byte_ids[b] for b in piece.encode())
    elif not out or out[-1] != v.unknown:
        out.append(v.unknown)


class Trellis:
    """The open window of one text: characters, ways and back pointers since the last final boundary."""

    def __init__(self, v: Vocabulary):
        self.v = v
        self.text = ""
        self.back = [0]
        self.last = [NO_PIECE]  # the last piece of the way to each boundary (merge models)
        self.score = [0.0]
        self.out: list[int] = []

    def feed(self, text: str) -> None:
        """Lengthen the text; ids that are final move to ``out``."""
        step = max(2 * self.v.longest, 64)
        for at in range(0, len(text), step):
            known = len(self.text)
            self.text += text[at : at + step]
            if self.v.merges:
                self._allowed(known + 1)
            else:
                for end in range(known + 1, len(self.text) + 1):
                    self._best(end)
            if len(self.text) > step:
                self._commit()

    def _allowed(self, first: int) -> None:
        """The one allowed way to each boundary from ``first`` on; an automaton lists the pieces that end there."""
        v, text, back, last = self.v, self.text, self.back, self.last
        pairs, end, open_ = v.pairs, first, True
        for at, (piece, size) in v.automaton.iter(text, max(0, first - v.longest), len(text)):
            if at + 1 < first:
                continue
            while end <= at:
                if open_:
                    self._foreign(end)
                end, open_ = end + 1, True
            if open_:
                start = end - size
                key = last[start] * WIDE + piece
                known = pairs.get(key)
                if known or known is None and _apart(last[start], piece, v):
                    back.append(start)
                    last.append(piece)
                    open_ = False
        for rest in range(end if open_ else end + 1, len(text) + 1):
            self._foreign(rest)

    def _foreign(self, end: int) -> None:
        """The way through a single character that is no piece; it is numbered by its code point."""
        piece = -ord(self.text[end - 1]) - 1
        if not _apart(self.last[end - 1], piece, self.v):
            raise AssertionError("every boundary has a way")
        self.back.append(end - 1)
        self.last.append(piece)

    def _best(self, end: int) -> None:
        scores, text = self.v.scores, self.text
        best, at = None, end - 1
        for start in range(end - 1, max(-1, end - self.v.longest - 1), -1):
            cost = scores.get(text[start:end])
            if cost is None:
                if end - start > 1:
                    continue
                cost = self.v.worst
            total = self.score[start] + cost
            if best is None or total >= best:  # of equals the one with the longest last piece
                best, at = total, start
        self.score.append(best)
        self.back.append(at)

    def _commit(self, every: bool = False) -> None:
        n, back = len(self.text), self.back
        meet = n
        if not every:
            # Back pointers only go back, so following the furthest of the open ways ends where all meet.
            ways = set(range(max(0, n - self.v.longest + 1), n + 1))
            while len(ways) > 1:
                meet = max(ways)
                ways.remove(meet)
                ways.add(back[meet])
            meet = ways.pop()
        if meet == 0:
            return
        ends = [meet]
        while ends[-1]:
            ends.append(back[ends[-1]])
        ends.reverse()
        for start, end in zip(ends, ends[1:], strict=False):
            _piece_ids(self.text[start:end], self.v, self.out)
        self.text = self.text[meet:]
        self.back = [0, *(b - meet for b in back[meet + 1 :])]
        self.last = self.last[meet:]
        self.score = [s - self.score[meet] for s in self.score[meet:]] if self.score[1:] else [0.0]

    def finish(self) -> list[int]:
        self._commit(every=True)
        return self.out


def _streamed(stretch: str, v: Vocabulary) -> bytes:
    trellis = Trellis(v)
    trellis.feed(stretch)
    return array("i", trellis.finish()).tobytes()


def _remember(stretch: str, ids: bytes, v: Vocabulary) -> bytes:
    if v.held + len(stretch) > REMEMBERED:
        v.memory[:], v.held = [{}, v.memory[0]], 0
    v.memory[0][stretch] = ids
    v.held += len(stretch)
    return ids


def _stretch_ids(stretch: str, v: Vocabulary) -> bytes:
    """Packed ids of a stretch that no piece leaves: remembered, or block by block between characters that nothing joins."""
    found = v.memory[0].get(stretch)
    if found is not None:
        return found
    found = v.memory[1].get(stretch)
    if found is None:
        joints = v.joints
        cuts = [i for i in range(1, len(stretch)) if stretch[i - 1 : i + 1] not in joints]
        if cuts:
            found = b"".join([_stretch_ids(stretch[a:b], v) for a, b in zip([0, *cuts], [*cuts, len(stretch)], strict=True)])
            if len(stretch) > v.longest:
                # Its blocks are remembered; a long stretch as a whole hardly comes again.
                return found
        else:
            found = _streamed(stretch, v)
    return _remember(stretch, found, v)


def _starts(data: np.ndarray, ends: np.ndarray, v: Vocabulary) -> np.ndarray:
    """Where stretches begin in the bytes of a block: at texts, at the first space of a run, around characters aside."""
    at = np.zeros(len(data) + 1, dtype=bool)
    at[ends] = True
    if not v.crossing and len(data):
        kind = np.zeros(256, dtype=np.int8)
        kind[[ord(c) for c in v.aside]] = 1
        kind[32] = 2
        kind = kind[data]
        at[1:-1] |= (kind[1:] != kind[:-1]) & (kind[:-1] != 2)
    return np.flatnonzero(at)


def encode_texts(texts: pa.Array, v: Vocabulary) -> pa.ListArray:
    """Ids of a block of texts."""
    full = pc.greater(pc.fill_null(pc.binary_length(texts), 0), 0)
    # A space and its mark are one symbol; within the block it is written as a space.
    plain = pc.replace_substring(pc.fill_null(texts, ""), MARK, " ")
    if v.prefix:
        plain = pc.binary_join_element_wise(pc.if_else(full, " ", ""), plain, "")
    plain = pa.concat_arrays([plain.cast(pa.large_binary())])
    ends = np.frombuffer(plain.buffers()[1], dtype=np.int64)[plain.offset : plain.offset + len(plain) + 1]
    data = plain.buffers()[2] or pa.py_buffer(b"")
    starts = _starts(np.frombuffer(data, dtype=np.uint8)[ends[0] : ends[-1]], ends - ends[0], v) + ends[0]
    stretches = pa.Array.from_buffers(pa.large_binary(), len(starts) - 1, [None, pa.py_buffer(starts.astype(np.int64)), data])
    coded = stretches.dictionary_encode()
    # Pieces have the mark, stretches a space.
    marked = pc.replace_substring(coded.dictionary.cast(pa.large_string()), " ", MARK)
    each = [_stretch_ids(stretch, v) for stretch in marked.to_pylist()]
    sizes = np.concatenate(([0], np.cumsum([len(e) // 4 for e in each]))).astype(np.int32)
    known = pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.frombuffer(b"".join(each), dtype=np.int32)))
    gathered = known.take(coded.indices)
    bounds = np.frombuffer(gathered.buffers()[1], dtype=np.int32)[gathered.offset : gathered.offset + len(gathered) + 1]
    offsets = (bounds - bounds[0])[np.searchsorted(starts, ends)] if len(starts) else np.zeros(len(ends), dtype=np.int32)
    ids = gathered.flatten().to_numpy()
    if not v.byte_ids and len(ids):
        # A run of characters outside the vocabulary is one unknown id.
        again = np.zeros(len(ids), dtype=bool)
        again[1:] = (ids[1:] == v.unknown) & (ids[:-1] == v.unknown)
        again[offsets[:-1][offsets[:-1] < len(ids)]] = False
        ids, offsets = ids[~again], (offsets - np.concatenate(([0], np.cumsum(again)))[offsets]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids, pa.int32()))


def encode(text: str | None, v: Vocabulary) -> list[int]:
    """Ids of one text."""
    return encode_texts(pa.array([text], pa.string()), v)[0].as_py()


def _surfaces(v: Vocabulary) -> pa.Array:
    """What each id stands for, in bytes; made once."""
    if v.surfaces is not None:
        return v.surfaces
    first = v.byte_ids[0] if v.byte_ids else None
    out = []
    for i, piece in enumerate(v.texts):
        if first is not None and first <= i < first + 256:
            out.append(bytes([i - first]))
        elif i == v.unknown:
            out.append(" ⁇ ".encode())
        else:
            out.append(b"" if i in v.silent else piece.replace(MARK, " ").encode())
    v.surfaces = pa.array(out, pa.binary())
    return v.surfaces


def decode_lists(ids: pa.ListArray, v: Vocabulary) -> pa.Array:
    """Texts of lists of ids; control ids are silent, wrong bytes become U+FFFD, a NULL list gives NULL."""
    flat = pa.ListArray.from_arrays(ids.offsets, _surfaces(v).take(ids.values), mask=ids.is_null() if ids.null_count else None)
    joined = pc.binary_join(flat, b"")
    try:
        texts = joined.cast(pa.string())
    except pa.ArrowInvalid:
        texts = pa.array([None if x is None else x.decode("utf-8", "replace") for x in joined.to_pylist()], pa.string())
    return pc.replace_substring_regex(texts, "^ ", "", max_replacements=1) if v.prefix else texts


def decode(ids: list[int], v: Vocabulary) -> str:
    """Text of one list of ids."""
    return decode_lists(pa.array([ids], pa.list_(pa.int32())), v)[0].as_py()


def _appended(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, values], [*batch.schema.names, name])


def encoded(docs: DataFrame, v: Vocabulary, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with the ids of a text column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_slices(whole, text, BLOCK):
                yield _appended(batch, ids, encode_texts(batch.column(text), v))

    plain = docs.drop(ids)
    return plain.mapInArrow(run, T.StructType([*plain.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType()))]))


def decoded(coded: DataFrame, v: Vocabulary, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``coded`` with the text of a column of ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                part = part.set_column(part.schema.get_field_index(ids), ids, pa.concat_arrays([part.column(ids)]))
                yield _appended(part, text, decode_lists(part.column(ids), v))

    plain = coded.drop(text)
    return plain.mapInArrow(run, T.StructType([*plain.schema.fields, T.StructField(text, T.StringType())]))


def round_trips(docs: DataFrame, v: Vocabulary) -> DataFrame:
    """(_row, ids, n_chars_decoded, round_trip): each row as it is, its ids, and whether they give its text back.

    Encoding and decoding follow each other within a block, so no text is sent back. A NULL text gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            texts = pa.RecordBatch.from_arrays([whole.column("_row"), whole.column("_row").field("text")], ["_row", "text"])
            for batch in text_slices(texts, "text", BLOCK):
                text = batch.column("text")
                # The mark itself is the one character that comes back as a space.
                ids = encode_texts(text, v)
                back = decode_lists(ids, v)
                same = pc.equal(pc.fill_null(text, ""), back)
                columns = [batch.column("_row"), ids, pc.utf8_length(back).cast(pa.int64()), same]
                yield pa.RecordBatch.from_arrays(columns, ["_row", "ids", "n_chars_decoded", "round_trip"])

    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    rows = docs.select(row)
    added = [("ids", T.ArrayType(T.IntegerType())), ("n_chars_decoded", T.LongType()), ("round_trip", T.BooleanType())]
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, *[T.StructField(n, k) for n, k in added]]))


def default_model() -> str:
    """The public model file of this box; elsewhere pass a path to ``Vocabulary.load``."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@query("op7_sentencepiece")
def op7(spark, sf_dir) -> DataFrame:
    v = Vocabulary.load(default_model())
    docs = checked_columns(table(spark, sf_dir, "documents"), {"doc_id": "long", "text": "string"})
    return round_trips(docs, v).select(
        F.col("_row.doc_id").alias("doc_id"),
        F.size("ids").cast("long").alias("n_ids"),
        F.xxhash64("ids").alias("ids_hash"),
        "n_chars_decoded",
        "round_trip",
    )
