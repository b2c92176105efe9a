"""SentencePiece encoding and decoding for merge-type vocabularies.

A model is read from its file: pieces, scores, kinds and flags. A text becomes a row of symbols, one a character (blanks
written as U+2581, one put before the text), and all adjacent pairs that make a piece lie in an agenda ordered by score,
then by place. The best pair merges, its neighbours' new pairs enter the agenda, and entries of symbols that have since
changed are passed over when they come up. So n characters take O(n log n) however long the text is. Symbols that are no
piece become byte pieces. Ids are decoded by the same tables.

No merge crosses a place where two characters meet that are neighbours in no piece, so texts are cut before blanks and
around line breaks first (if the vocabulary allows it) and each worker remembers the ids of the stretches it has seen,
in a cache of bounded size. After each Arrow batch the sentencepiece library encodes every stretch that the batch had
merged, and decodes the ids of every text: ``library_agrees`` says whether it gives the same. The model goes to the
workers as a broadcast of the file's size.

Cases: a null text is an empty one and has the end id only; blanks, control characters, names of control pieces in a
text and U+2581 itself are text like any other (U+2581 decodes to a blank, as in the library); repeated rows stay rows;
ties of scores go to the leftmost pair; very long texts and words need no cut; an empty table gives no rows; other
columns are not read, so names may clash. A model that isn't merge-type, rewrites its input, or has user-defined or
unused pieces raises an error.
"""

from __future__ import annotations

import codecs
import gc
import hashlib
import heapq
import re
import string
import struct
from collections.abc import Callable, Iterator
from itertools import chain
from operator import concat

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLANK = "▁"
#: Stretches a worker remembers (twice as many at most), and the characters of the longest one it remembers.
CACHE_STRETCHES, CACHE_CHARS = 300_000, 48
#: Fixed values of the model file: the kinds of pieces and the merge type.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
MERGE_TYPE = 2


def message(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and values of the fields of a serialised message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte, at = raw[at], at + 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(raw):
        field, kind = divmod(number(), 8)
        if kind == 0:
            yield field, number()
        else:
            size = number() if kind == 2 else {1: 8, 5: 4}[kind]
            yield field, raw[at : at + size]
            at += size


class Codec:
    """Encodes and decodes by a model's bytes."""

    def __init__(self, model: bytes):
        pieces, trainer, normalizer = [], {}, {}
        for field, value in message(model):
            if field == 1:
                pieces.append(dict(message(value)))
            elif field == 2:
                trainer = dict(message(value))
            elif field == 3:
                normalizer = dict(message(value))
        texts = [p[1].decode() for p in pieces]
        self.kinds = kinds = [p.get(3, NORMAL) for p in pieces]
        if trainer.get(3, 1) != MERGE_TYPE or {USER, UNUSED} & set(kinds) or kinds.count(BYTE) != 256:
            raise ValueError("only merge-type models with a piece for every byte, none user-defined or unused, are handled")
        if normalizer.get(2) or normalizer.get(4, 1) or not normalizer.get(3, 1) or not normalizer.get(5, 1) or trainer.get(24, 0):
            raise ValueError("only models that keep their input, put a blank before it and escape blanks are handled")
        self.ids = {t: i for i, (t, k) in enumerate(zip(texts, kinds)) if k == NORMAL}
        scores = [struct.unpack("<f", p.get(2, bytes(4)))[0] for p in pieces]
        places = {score: place for place, score in enumerate(sorted(set(scores), reverse=True))}
        #: piece -> place of its score, 0 the best; equal scores have equal places.
        self.places = {t: places[scores[i]] for t, i in self.ids.items()}
        self.bytes_at = [i for i, k in enumerate(kinds) if k == BYTE]
        self.end = trainer.get(42, 2)
        self.control = frozenset(i for i, k in enumerate(kinds) if k == CONTROL)
        #: Neighbouring characters inside pieces: no merge crosses a place where others meet.
        self.inner = {t[i : i + 2] for t in self.ids for i in range(len(t) - 1)}
        self.cut = self.cutter()
        # Bytes of 128 and more are held as lone surrogates until the whole text is decoded.
        self.surface = [t.replace(BLANK, " ") if k == NORMAL else " ⁇ " if k == UNKNOWN else "" for t, k in zip(texts, kinds)]
        for byte, i in enumerate(self.bytes_at):
            self.surface[i] = chr(byte) if byte < 128 else chr(0xDC00 + byte)
        self.decimal = [str(i) for i in range(len(pieces))]
        self.stretches = Stretches(self)
        #: Stretches merged since the library was asked last, and those it disagreed on.
        self.fresh: dict[str, tuple[int, ...]] = {}
        self.wrong: set[str] = set()

    def cutter(self) -> Callable[[str], list[str]]:
        """Cuts a text before blanks, around line breaks and between letters and marks, as far as no piece goes across."""
        if any(pair[1] == BLANK != pair[0] for pair in self.inner):
            return lambda text: [text]
        whole_lines = any("\n" in piece for piece in self.ids)
        marks = "".join(m for m in string.punctuation if not any(a + m in self.inner for a in string.ascii_letters))
        other = f"[^{BLANK}]" if whole_lines else f"[^{BLANK}\n]"
        word = f"{other[:-1]}{re.escape(marks)}]++(?:(?<=[A-Za-z])|{other}*+)"
        return re.compile(f"{BLANK}*+(?:{word}|{other}++)|{BLANK}++" + ("" if whole_lines else "|\n++")).findall

    def parts(self, stretch: str) -> list[str]:
        """The stretch cut wherever two characters meet that are neighbours in no piece."""
        if self.inner.issuperset(map(concat, stretch, stretch[1:])):
            return [stretch]
        cuts = [i for i in range(1, len(stretch)) if stretch[i - 1 : i + 1] not in self.inner]
        return [stretch[a:b] for a, b in zip([0, *cuts], [*cuts, len(stretch)])]

    def merged(self, text: str) -> Iterator[str]:
        """The stretches of a text as they are merged."""
        return chain.from_iterable(map(self.parts, self.cut(BLANK + text.replace(" ", BLANK)))) if text else iter(())

    def merge(self, stretch: str) -> tuple[int, ...]:
        """Ids of a stretch that no merge leaves."""
        n, place = len(stretch), self.places.get
        symbols: list[str | None] = list(stretch)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        # By symbol, the place of the pair that begins there and the symbol itself as one number, or None.
        pair = [p if p is None else p * n + i for i, p in enumerate(map(place, map(concat, stretch, stretch[1:])))]
        pair.append(None)
        agenda = [p for p in pair if p is not None]
        heapq.heapify(agenda)
        push, pop = heapq.heappush, heapq.heappop
        while agenda:
            best = pop(agenda)
            left = best % n
            if pair[left] != best:
                continue
            right = after[left]
            symbols[left] = joined = symbols[left] + symbols[right]
            symbols[right] = pair[right] = None
            after[left] = stop = after[right]
            p = None
            if stop < n:
                before[stop] = left
                p = place(joined + symbols[stop])
                if p is not None:
                    p = p * n + left
                    push(agenda, p)
            pair[left] = p
            prior = before[left]
            if prior >= 0:
                p = place(symbols[prior] + joined)
                if p is not None:
                    p = p * n + prior
                    push(agenda, p)
                pair[prior] = p
        found: list[int] = []
        for symbol in symbols:
            if symbol is not None:
                i = self.ids.get(symbol)
                if i is None:
                    found.extend(self.bytes_at[b] for b in symbol.encode())
                else:
                    found.append(i)
        return tuple(found)

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text, with the end id."""
        ids = []
        if text:
            ids.extend(chain.from_iterable(map(self.stretches.__getitem__, self.cut(BLANK + text.replace(" ", BLANK)))))
        ids.append(self.end)
        return ids

    def decode(self, ids: list[int]) -> str:
        """The text of ids: without control pieces and the blank before it; bytes that are no UTF-8 become U+FFFD each."""
        kinds = self.kinds
        while ids and kinds[ids[-1]] == CONTROL:
            ids = ids[:-1]
        parts, start = [], 0
        if not self.control.isdisjoint(ids):  # bytes on both sides of a control piece don't join
            for at, i in enumerate(ids):
                if kinds[i] == CONTROL:
                    parts.append(self.whole(ids[start:at]))
                    start = at + 1
        parts.append(self.whole(ids[start:]))
        first = next((i for i in ids if kinds[i] != CONTROL), None)
        text = "".join(parts)
        return text[1:] if first is not None and kinds[first] == NORMAL and text.startswith(" ") else text

    def whole(self, ids: list[int]) -> str:
        text = "".join(map(self.surface.__getitem__, ids))
        return text if text.isascii() else text.encode("utf-8", "surrogateescape").decode("utf-8", "each-byte")


def each_byte(error: UnicodeError) -> tuple[str, int]:
    return "�" * (error.end - error.start), error.end


codecs.register_error("each-byte", each_byte)


class Stretches(dict):
    """stretch -> its ids; fills itself and notes what has been merged in the codec's ``fresh``.

    When it is full it begins anew and keeps the one before to look into: what is met often stays.
    """

    def __init__(self, codec: Codec):
        super().__init__()
        self.codec = codec
        self.before: dict[str, tuple[int, ...]] = {}

    def __missing__(self, stretch: str) -> tuple[int, ...]:
        found = self.before.get(stretch) or self.found(stretch)
        if len(stretch) <= CACHE_CHARS:
            if len(self) >= CACHE_STRETCHES:
                self.before = dict(self)
                self.clear()
            self[stretch] = found
        return found

    def found(self, stretch: str) -> tuple[int, ...]:
        parts = self.codec.parts(stretch)
        if len(parts) > 1:
            return tuple(chain.from_iterable(map(self.__getitem__, parts)))
        found = self.codec.fresh[stretch] = self.codec.merge(stretch)
        return found


def unlike(library: sentencepiece.SentencePieceProcessor, fresh: dict[str, tuple[int, ...]]) -> set[str]:
    """Of stretches and their ids those for which the library gives other ids.

    The library puts a blank before each of its inputs: a stretch that begins with one gives it up, others stand behind
    a line break, which takes part in no merge (if one does, texts are not cut there).
    """
    blank = library.piece_to_id(BLANK)
    head = library.encode("\n")
    behind = {s: s[1:].replace(BLANK, " ") if s[0] == BLANK else "\n" + s.replace(BLANK, " ") for s in fresh}
    given = library.encode(list(behind.values()), num_threads=1)
    wrong = set()
    for (stretch, ids), text, theirs in zip(fresh.items(), behind.values(), given):
        ours = [*ids] if stretch[0] == BLANK else [*head, *ids]
        if ours != (theirs if text else [blank]):
            wrong.add(stretch)
    return wrong


#: Codec and library of a worker process, by the model's digest: its cache serves all tasks that the process runs.
CODECS: dict[bytes, tuple[Codec, sentencepiece.SentencePieceProcessor]] = {}


def codec_of(model: bytes) -> tuple[Codec, sentencepiece.SentencePieceProcessor]:
    name = hashlib.sha256(model).digest()
    if name not in CODECS:
        CODECS.clear()
        codecs.register_error("each-byte", each_byte)
        CODECS[name] = Codec(model), sentencepiece.SentencePieceProcessor(model_proto=model)
    return CODECS[name]


def read_model(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


KINDS = {
    "doc_id": pa.int64(), "n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string(),
    "library_agrees": pa.bool_(), "ids": pa.list_(pa.int32()),
}
ENCODED = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string, library_agrees boolean"


def encode_pieces(docs: DataFrame, path: str, keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, library_agrees; with ``keep_ids`` also ids (array<int>).

    Digests are of the decimal ids joined by one blank and of the decoded text in UTF-8. ``library_agrees`` says that the
    library gives the same ids for the text's stretches and the same text for the ids.
    """
    shared = docs.sparkSession.sparkContext.broadcast(read_model(path))
    names = list(KINDS)[: 5 + keep_ids]

    def sha(text: str) -> str:
        return hashlib.sha256(text.encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, library = codec_of(shared.value)
        gc.disable()  # nothing here refers to itself, and passes over the cache cost a tenth of the time
        for batch in batches:
            rows: dict[str, list] = {name: [] for name in names[1:]}
            texts = [text or "" for text in batch.column(1).to_pylist()]
            for text in texts:
                ids = codec.encode(text)
                decoded = codec.decode(ids)
                rows["n_tokens"].append(len(ids))
                rows["ids_sha256"].append(sha(" ".join(map(codec.decimal.__getitem__, ids))))
                rows["decoded_sha256"].append(sha(decoded))
                rows["library_agrees"].append(library.decode(ids) == decoded)
                if keep_ids:
                    rows["ids"].append(ids)
            codec.wrong |= unlike(library, codec.fresh)
            codec.fresh.clear()
            if codec.wrong:
                rows["library_agrees"] = [
                    same and codec.wrong.isdisjoint(codec.merged(text)) for same, text in zip(rows["library_agrees"], texts)
                ]
            arrays = [batch.column(0), *(pa.array(column, KINDS[name]) for name, column in rows.items())]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, ENCODED + ", ids array<int>" * keep_ids)


def decode_pieces(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, text: from doc_id, ids (array of ids); null ids give a null text; an id that there isn't is an error."""
    shared = encoded.sparkSession.sparkContext.broadcast(read_model(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, _ = codec_of(shared.value)
        for batch in batches:
            texts = [None if ids is None else codec.decode(ids) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    rows = encoded.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>"))
    return rows.mapInArrow(run, "doc_id bigint, text string")
