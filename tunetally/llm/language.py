"""Language of a text by a small convolutional network over bytes.

Bytes are folded to classes (A-Z to a-z, digits, white space, other ASCII; bytes beyond
ASCII stay). A text is tiled by windows of `WINDOW` bytes, the whole of it. In a window,
filters of several widths run over the bytes, the largest answer of each filter is kept,
and a softmax over these gives a probability per language. A text's probabilities are
those of its windows, weighted by their letters.

A filter over one-hot bytes is a sum of table entries, one table per place of the filter;
for prediction, two neighbouring places are one table. Training is plain NumPy with Adam;
only the place of the largest answer gets a gradient. It learns from at most
`TRAIN_TEXTS` labelled texts (`TRAIN_PER_LANG` of each language, by hash of doc_id) and
`TRAIN_WINDOWS` windows of each, so its cost does not grow with the table.

Defined results: a null text or one without a letter is `und` with score 0; so is every
text if nothing can be learned from. Rows with a null doc_id or language are not learned
from. Rows that repeat are predicted one by one; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tunetally.llm.words import string_buffers

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
TRAIN_TEXTS = 4000
TRAIN_PER_LANG = 600
TRAIN_WINDOWS = 3
SALTS = 64
EPOCHS = 4
BATCH = 64
RATE = 0.01
UNKNOWN = "und"

_CLASS = np.full(256, 1, np.int64)
_CLASS[0] = 0
_CLASS[[0x20, *range(0x09, 0x0E)]] = 2
_CLASS[48:58] = 3
_CLASS[97:123] = np.arange(4, 30)
_CLASS[65:91] = np.arange(4, 30)
_CLASS[128:] = np.arange(30, 158)
N_CLASSES = 158
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[192:] = True


@dataclass
class Network:
    """tables[k][place]: class of byte to answer of each filter of width WIDTHS[k]."""

    langs: list[str]
    tables: list[np.ndarray]
    bias: np.ndarray
    weights: np.ndarray
    offset: np.ndarray


def tiled(data: bytes) -> np.ndarray:
    """Classes of the bytes in windows; the last one is filled up with zeros."""
    rows = -(-len(data) // WINDOW)
    out = np.zeros(rows * WINDOW, np.int64)
    out[: len(data)] = _CLASS[np.frombuffer(data, np.uint8)]
    return out.reshape(rows, WINDOW)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _answers(net: Network, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Largest answers of all filters per window, and where they are."""
    tops, places = [], []
    for width, table in zip(WIDTHS, net.tables, strict=True):
        span = WINDOW - width + 1
        sums = table[0][x[:, :span]]
        for k in range(1, width):
            sums = sums + table[k][x[:, k : k + span]]
        place = sums.argmax(axis=1)
        tops.append(np.take_along_axis(sums, place[:, None, :], 1)[:, 0])
        places.append(place)
    return np.concatenate(tops, axis=1) + net.bias, places


def train(windows: np.ndarray, labels: list[str], seed: int = 0) -> Network:
    rng = np.random.default_rng(seed)
    langs = sorted(set(labels))
    y = np.searchsorted(langs, labels)
    n = FILTERS * len(WIDTHS)
    tables = [rng.normal(0, 0.1, (w, N_CLASSES, FILTERS)) for w in WIDTHS]
    net = Network(langs, tables, np.zeros(n), rng.normal(0, 0.1, (n, len(langs))), np.zeros(len(langs)))
    balance = len(y) / (len(langs) * np.bincount(y, minlength=len(langs)))
    params = [*net.tables, net.bias, net.weights, net.offset]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for at in range(0, len(order), BATCH):
            rows = order[at : at + BATCH]
            x, want = windows[rows], y[rows]
            top, places = _answers(net, x)
            hidden = np.maximum(top, 0)
            slope = softmax(hidden @ net.weights + net.offset)
            slope[np.arange(len(rows)), want] -= 1
            slope *= (balance[want] / len(rows))[:, None]
            back = (slope @ net.weights.T) * (top > 0)
            grads = [np.zeros_like(t) for t in net.tables]
            for k, width in enumerate(WIDTHS):
                own = back[:, k * FILTERS : (k + 1) * FILTERS]
                for place in range(width):
                    byte = np.take_along_axis(x, places[k] + place, 1)
                    np.add.at(grads[k][place], (byte, np.arange(FILTERS)[None, :]), own)
            grads += [back.sum(axis=0), hidden.T @ slope, slope.sum(axis=0)]
            step += 1
            for p, g, m, v in zip(params, grads, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


class Predictor:
    """The network with tables for pairs of bytes, for many windows at a time."""

    def __init__(self, net: Network):
        self.net = net
        self.pairs, self.singles = [], []
        for width, table in zip(WIDTHS if net.langs else (), net.tables, strict=True):
            table = table.astype(np.float32)
            pairs = [
                (table[k][:, None, :] + table[k + 1][None, :, :]).reshape(-1, FILTERS)
                for k in range(0, width - 1, 2)
            ]
            self.pairs.append(pairs)
            self.singles.append(table[-1] if width % 2 else None)

    def windows(self, x: np.ndarray) -> np.ndarray:
        """Probabilities per window of byte classes."""
        out = []
        for at in range(0, len(x), 128):
            part = x[at : at + 128]
            pair = part[:, :-1] * N_CLASSES + part[:, 1:]
            tops = []
            for width, pairs, single in zip(WIDTHS, self.pairs, self.singles, strict=True):
                span = WINDOW - width + 1
                sums = pairs[0].take(pair[:, :span], axis=0)
                for k, table in enumerate(pairs[1:], 1):
                    sums += table.take(pair[:, 2 * k : 2 * k + span], axis=0)
                if single is not None:
                    sums += single.take(part[:, width - 1 :], axis=0)
                tops.append(sums.max(axis=1))
            hidden = np.maximum(np.concatenate(tops, axis=1) + self.net.bias, 0)
            out.append(softmax(hidden @ self.net.weights + self.net.offset))
        return np.concatenate(out)

    def texts(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        data, bounds = string_buffers(column)
        langs, scores = [UNKNOWN] * (len(bounds) - 1), np.zeros(len(bounds) - 1)
        if not self.net.langs:
            return langs, scores
        group: list[tuple[int, np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> None:
            chances = self.windows(np.concatenate([g[1] for g in group]))
            at = 0
            for row, x, letters in group:
                mean = (chances[at : at + len(x)] * letters[:, None]).sum(axis=0) / letters.sum()
                at += len(x)
                best = int(mean.argmax())
                langs[row], scores[row] = self.net.langs[best], min(1.0, float(mean[best]))

        for row in range(len(langs)):
            own = data[bounds[row] : bounds[row + 1]]
            if not has_letter(own):
                continue
            x = tiled(own.tobytes())
            letters = np.zeros(len(x) * WINDOW, bool)
            letters[: len(own)] = _LETTER[own]
            letters = letters.reshape(len(x), WINDOW).sum(axis=1) + 1e-9
            group.append((row, x, letters))
            size += len(x)
            if size >= 1024:
                flush()
                group, size = [], 0
        if group:
            flush()
        return langs, scores


def has_letter(data: np.ndarray) -> bool:
    lower = data | 32
    if ((lower >= 97) & (lower <= 122)).any():
        return True
    return bool((data >= 128).any()) and any(map(str.isalpha, data.tobytes().decode("utf-8", "replace")))


def remainder(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4


def fit(docs: DataFrame) -> Network:
    """A network from the labelled texts whose remainder is not 2."""
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (remainder() != 2))
    # The texts are chosen by their keys, in two rounds so that no task gets many of a
    # language; then at most `TRAIN_TEXTS` keys are sent to the texts.
    key = F.xxhash64("doc_id")
    chosen = usable.select("lang", "doc_id", key.alias("key"), F.pmod(key, F.lit(SALTS)).alias("salt"))
    for group in (["lang", "salt"], ["lang"]):
        order = Window.partitionBy(*group).orderBy("key", "doc_id")
        chosen = chosen.withColumn("n", F.row_number().over(order)).where(F.col("n") <= TRAIN_PER_LANG)
    chosen = chosen.orderBy("n", "lang").limit(TRAIN_TEXTS).groupBy("lang", "doc_id").agg(F.min("n").alias("n"))
    n_chars = F.char_length("text")
    at = F.transform(F.sequence(F.lit(0), F.lit(TRAIN_WINDOWS - 1)), lambda k: F.floor(n_chars * k / TRAIN_WINDOWS).cast("int"))
    parts = F.transform(at, lambda k: F.substring(F.col("text"), k + 1, F.lit(WINDOW)))
    few = usable.join(F.broadcast(chosen), ["lang", "doc_id"]).select("lang", F.array_distinct(parts).alias("parts"), "n")
    few = few.orderBy("n", "lang", "parts").limit(TRAIN_TEXTS)
    windows, labels = [], []
    for row in few.collect():
        for part in row["parts"]:
            data = np.frombuffer(part.encode()[:WINDOW], np.uint8)
            if has_letter(data):
                windows.append(tiled(data.tobytes()))
                labels.append(row["lang"])
    if not labels:
        return Network([], [], np.zeros(0), np.zeros((0, 0)), np.zeros(0))
    return train(np.concatenate(windows), labels)


def predicted(docs: DataFrame, net: Network) -> DataFrame:
    """doc_id, held_out (its remainder is 2), lang_pred, score of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predictor = Predictor(net)
        for batch in batches:
            for first in range(0, batch.num_rows, 1024):
                part = batch.slice(first, 1024)
                langs, scores = predictor.texts(part.column(2))
                columns = [part.column(0), part.column(1), pa.array(langs, pa.string()), pa.array(scores)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "lang_pred", "score"])

    held_out = F.coalesce(remainder() == 2, F.lit(False))
    key = docs.schema["doc_id"].dataType.simpleString()
    kind = f"doc_id {key}, held_out boolean, lang_pred string, score double"
    return docs.select("doc_id", held_out.alias("held_out"), "text").mapInArrow(run, kind)


def identified(docs: DataFrame) -> DataFrame:
    return predicted(docs, fit(docs))
