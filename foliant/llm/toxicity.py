"""Toxicity by compression distance.

Two zstandard dictionaries are trained on windows of labelled texts: an ordinary one on windows of ordinary texts, and
a toxic one on windows of toxic texts. A text is cut into windows of ``WINDOW`` words; each window is compressed with
the ordinary dictionary alone and with the toxic one behind it, and what the toxic dictionary saves, in bytes, is the
window's figure. A window counts where it saves at least a threshold; the figures of a text (its largest savings, how
many windows count and what share) give its score through a logistic curve. Threshold and curve are calibrated on rows
that the dictionaries did not see: the sample is halved, each half is measured by the dictionaries of the other, and
the final dictionaries are trained on both.

A toxic text is mostly ordinary words, so a dictionary of all its windows mostly learns those. The toxic dictionary is
therefore trained in rounds, each on what the round before saved: dictionaries of all toxic windows, of the sizes
``FIRST_BYTES``, measure the windows of the other half; of a window that saves more than nearly all ordinary ones, the
stretch without which it saves least is kept; stretches that the same dictionary finds in ordinary windows too are
left out; the last rounds train on the stretches kept. Only compressed lengths decide what is kept.

The classifier is fitted on a bounded sample: of rows that may be learnt from, at most ``MOST_ROWS`` distinct texts of
each class, taken by the hash of their id, and of each at most ``MOST_WINDOWS`` windows, evenly spaced over the whole
text. Every whole text is scored. Only text is an input of a score.

Cases: null and empty texts are one empty window and get a score; with fewer than two rows of a class to learn from,
scores are the share of toxic rows among the sample (0.0 without any); a row whose label is null teaches nothing;
several labels of a document count as toxic if one says so; of several texts of one id the least is learnt from;
repeated rows stay rows; very long texts are measured window by window; an empty table gives no rows; other columns
are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_ROWS, MOST_WINDOWS = 2000, 512
WINDOW = 8
#: Bytes of the ordinary dictionary, of the first toxic ones, of those between rounds and of the final one.
ORDINARY_BYTES, FIRST_BYTES, ROUND_BYTES, TOXIC_BYTES = 110_000, (8_192, 65_536), 16_384, 8_192
#: Share of ordinary windows that save less than a window a stretch is taken from, by round.
QUANTILES = (0.97, 0.95, 0.97)
#: How often a stretch must be kept, and how much more often than in ordinary windows.
LEAST_KEPT, LEAST_RATIO = 3, 8
#: Windows that a dictionary is trained on, and ordinary windows that a quantile is taken of, spaced evenly.
MOST_TRAINED, MOST_MEASURED = 40_000, 30_000
#: A kept stretch counts at most this often, so that rare ones are learnt too.
MOST_COPIES = 4
THRESHOLDS = range(1, 8)
#: ASCII letters, digits and all bytes beyond ASCII are parts of words; A-Z become a-z, the rest is blank.
PLAIN = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)

Rows = list[tuple[list[bytes], int]]


def windows(text: str | None) -> Iterator[bytes]:
    """Windows of words, each between blanks; a word that follows itself counts once."""
    words = (text or "").encode().translate(PLAIN).split()
    words = [w for i, w in enumerate(words) if i == 0 or w != words[i - 1]]
    for at in range(0, max(1, len(words)), WINDOW):
        yield b" " + b" ".join(words[at : at + WINDOW]) + b" "


def evenly(items: list, most: int) -> list:
    """At most ``most`` of the items, evenly spaced."""
    return items[:: max(1, -(-len(items) // most))]


def dictionary(samples: list[bytes], size: int, segment: int, unit: int) -> bytes:
    """Content of a zstandard dictionary: segments of ``segment`` bytes, chosen by their frequent runs of ``unit``."""
    try:
        return zstandard.train_dictionary(size, evenly(samples, MOST_TRAINED), k=segment, d=unit).as_bytes()[-size:]
    except zstandard.ZstdError:  # too few samples for a choice: all of them, then
        return b"".join(samples)[-size:]


class Savings:
    """Bytes that the toxic dictionary saves on windows, over the ordinary one alone."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        settings = zstandard.ZstdCompressionParameters(
            window_log=18, chain_log=17, hash_log=17, search_log=5, min_match=6, target_length=16,
            strategy=zstandard.STRATEGY_GREEDY, write_content_size=0, write_checksum=0, write_dict_id=0,
        )
        self.compress = []
        for content in (ordinary, ordinary + toxic):
            shared = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            shared.precompute_compress(compression_params=settings)
            self.compress.append(zstandard.ZstdCompressor(dict_data=shared, compression_params=settings).compress)

    def __call__(self, found) -> np.ndarray:
        ordinary, toxic = self.compress
        return np.array([len(ordinary(w)) - len(toxic(w)) for w in found], dtype=np.int64)


def stretches(measure: Savings, found: list[bytes], least: int) -> list[bytes]:
    """Of each window that saves at least ``least``, the word without which it saves least."""
    kept = []
    for window, saved in zip(found, measure(found)):
        if saved >= least:
            words = window.split() or [b""]
            without = measure([b" " + b" ".join(words[:i] + words[i + 1 :]) + b" " for i in range(len(words))])
            kept.append(words[int(np.argmin(without))])
    return kept


def samples_of(kept: Counter) -> list[bytes]:
    """Kept stretches as samples; blanks fill them up to what zstandard looks at."""
    return [b" " + w + b" " * 9 for turn in range(MOST_COPIES) for w in sorted(kept) if kept[w] > turn]


def train_dictionaries(halves: tuple[Rows, Rows]) -> tuple[list[bytes], list[Counter]]:
    """The ordinary dictionary of each half and the stretches that its toxic one is trained on."""
    distinct = lambda half, y: list(dict.fromkeys(w for ws, toxic in half if toxic == y for w in ws))
    toxic_windows, ordinary_windows = ([distinct(half, y) for half in halves] for y in (1, 0))
    ordinary = [dictionary(ws, ORDINARY_BYTES, 8, 8) for ws in ordinary_windows]
    measured = [evenly(ws, MOST_MEASURED) for ws in ordinary_windows]
    kept = [Counter(), Counter()]
    for round_, quantile in enumerate(QUANTILES):
        if round_ < len(FIRST_BYTES):
            toxic = [dictionary(ws, FIRST_BYTES[round_], 8, 8) for ws in toxic_windows]
        else:
            toxic = [dictionary(samples_of(k), ROUND_BYTES, 16, 6) for k in kept]
        for mine, other in ((0, 1), (1, 0)):
            measure = Savings(ordinary[other], toxic[other])
            least = max(1, math.ceil(np.quantile(measure(measured[mine]), quantile)))
            found = Counter(stretches(measure, toxic_windows[mine], least))
            known = Counter(stretches(measure, measured[mine], least))
            scale = LEAST_RATIO * len(toxic_windows[mine]) / len(measured[mine])
            kept[mine].update({w: n for w, n in found.items() if n >= LEAST_KEPT and n + 0.5 > scale * (known[w] + 0.5)})
    return ordinary, kept


def figures(savings: np.ndarray, threshold: int) -> list[float]:
    top = np.sort(savings)[::-1][:2]
    over = savings[savings >= threshold]
    return [
        min(top[0], 12), min(top.mean(), 12), math.log1p(len(over)), math.log1p(len(savings)),
        math.sqrt(len(over) / (len(savings) + 3)), math.log1p((over - threshold + 1).sum()),
    ]


@dataclass(frozen=True)
class Model:
    ordinary: bytes
    toxic: bytes
    threshold: int
    shift: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    base: float | None = None

    def scores(self, found: list[list[float]]) -> np.ndarray:
        if self.base is not None:
            return np.full(len(found), self.base)
        x = (np.array(found).reshape(len(found), -1) - self.shift) / self.scale
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[1:] + self.weights[0], -30, 30)))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Newton's method with a ridge: shift, scale and weights (the first without a figure)."""
    shift, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.column_stack([np.ones(len(x)), (x - shift) / scale])
    w = np.zeros(z.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w)), z.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return shift, scale, w


def train(rows: Rows) -> Model:
    """``rows``: (windows, toxic 0 or 1) of the bounded sample, in a fixed order; each class is halved in turn."""
    n = sum(toxic for _, toxic in rows)
    if min(n, len(rows) - n) < 2:
        none = np.zeros(0)
        return Model(b"", b"", 1, none, none, none, n / len(rows) if rows else 0.0)
    halves: tuple[Rows, Rows] = ([], [])
    for toxic in (0, 1):
        for i, row in enumerate(r for r in rows if r[1] == toxic):
            halves[i % 2].append(row)
    ordinary, kept = train_dictionaries(halves)
    final = lambda k: dictionary(samples_of(k), TOXIC_BYTES, 16, 6) if k else b""
    measured = []
    for mine, other in ((0, 1), (1, 0)):
        measure = Savings(ordinary[other], final(kept[other]))
        measured += [(measure(found), toxic) for found, toxic in halves[mine]]
    y = np.array([toxic for _, toxic in measured], dtype=float)
    fits = []
    for threshold in THRESHOLDS:
        x = np.array([figures(s, threshold) for s, _ in measured])
        model = Model(b"", b"", threshold, *fit_logistic(x, y))
        p = np.clip(model.scores(x.tolist()), 1e-9, 1 - 1e-9)
        fits.append((-np.mean(y * np.log(p) + (1 - y) * np.log(1 - p)), threshold, model))
    best = min(fits, key=lambda f: f[:2])[2]
    both = dictionary(list(dict.fromkeys(w for ws, toxic in rows if not toxic for w in ws)), ORDINARY_BYTES, 8, 8)
    return Model(both, final(kept[0] + kept[1]), best.threshold, best.shift, best.scale, best.weights)


def is_held_out(doc_id: Column) -> Column:
    """True for the fifth of ids that is never learnt from; a null id counts as the text ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def training_rows(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS) -> Rows:
    """The bounded sample: distinct texts, at most ``most_rows`` of each class, those with the smallest hashes of ids."""
    marks = (
        labels.where("doc_id is not null and toxic is not null")
        .where(~is_held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
    )
    marks = marks.join(docs.select("doc_id"), "doc_id", "left_semi")
    ids = []
    for toxic in (0, 1):
        mine = marks.where((F.col("toxic") == 1) == F.lit(bool(toxic)))
        first = mine.orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * most_rows).collect()
        ids += [(r["doc_id"], place, toxic) for place, r in enumerate(first)]
    # At most four times most_rows small rows are broadcast, so that no other text is shuffled.
    picked = F.broadcast(docs.sparkSession.createDataFrame(ids, "doc_id long, place long, toxic int"))
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(picked, "doc_id")
    texts = texts.groupBy("toxic", "place").agg(F.min("text").alias("text"))
    texts = texts.groupBy("toxic", "text").agg(F.min("place").alias("place"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [evenly(list(windows(t.as_py())), MOST_WINDOWS) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.binary()))], names=["place", "windows"])

    rows: Rows = []
    for toxic in (0, 1):
        mine = texts.where(F.col("toxic") == toxic).orderBy("place").limit(most_rows).select("place", "text")
        found = mine.mapInArrow(cut, "place bigint, windows array<binary>").collect()
        rows += [([bytes(w) for w in r["windows"]], toxic) for r in sorted(found, key=lambda r: r["place"])]
    return rows


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted, n_windows (of the text), n_marked (windows over the threshold)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        measure = Savings(m.ordinary, m.toxic) if m.base is None else None
        for batch in batches:
            savings = [measure(windows(t.as_py())) if measure else np.zeros(1, np.int64) for t in batch.column(2)]
            scores = m.scores([figures(s, m.threshold) for s in savings])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array(scores >= 0.5).cast(pa.int32()),
                 pa.array([len(s) for s in savings], pa.int64()), pa.array([int((s >= m.threshold).sum()) for s in savings], pa.int64())],
                names=["doc_id", "held_out", "score", "predicted", "n_windows", "n_marked"],
            )

    rows = docs.select(F.col("doc_id").cast("long"), is_held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(
        run, "doc_id bigint, held_out boolean, score double, predicted int, n_windows bigint, n_marked bigint"
    )


def judge_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score_documents(docs, train(training_rows(docs, labels)))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text is not predicted toxic, with all their columns."""
    model = train(training_rows(docs, labels))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        measure = Savings(m.ordinary, m.toxic) if m.base is None else None
        for batch in batches:
            texts = batch.column(batch.schema.names.index("text"))
            savings = [measure(windows(t.as_py())) if measure else np.zeros(1, np.int64) for t in texts]
            kept = m.scores([figures(s, m.threshold) for s in savings]) < 0.5
            yield batch.filter(pa.array(kept))

    return docs.mapInArrow(run, docs.schema)
