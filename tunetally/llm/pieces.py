"""SentencePiece encoding and decoding by Viterbi over a trie of shared prefixes.

A text is marked (a space becomes the mark, one mark goes in front) and cut into words at
the marks, which no piece crosses. The distinct words of a batch are sorted, so words with
a common prefix are neighbours, and are walked like a trie, depth first: the forward table
of a prefix is computed once and kept on a stack while its extensions are visited.

The forward table says for every prefix what its best path ends in:

* unigram models: the largest sum of piece scores; of equal sums, the longer last piece;
* BPE models: a path counts only if every two neighbouring pieces are what merging their
  text gives; exactly one path does, and it is what merging the word gives. So a prefix
  has one last piece, and neighbours are checked once per pair of pieces.

Which pieces end at a place is read off an automaton over all pieces, whose state is part
of the table of a prefix. What no piece covers becomes bytes if the model has bytes.

Only models without a table of character normalisation are read; others are refused.

Defined results: a null or empty text has no ids and decodes to the empty text; a text
that has marks of its own decodes to spaces; rows that repeat are encoded each; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame

MODEL = "piece_bpe_32k.model"
MARK = "▁"
#: Distinct words whose ids a task remembers before it starts anew.
MAX_WORDS = 600_000
#: Moves of the automaton beyond the pieces themselves that a task remembers.
MAX_MOVES = 1_000_000
ROWS = 2048
_UNIGRAM, _BPE = 1, 2
_NORMAL, _UNKNOWN, _USER, _UNUSED, _BYTE = 1, 2, 4, 5, 6
#: Last "pieces" of prefixes that have none: the empty prefix, a character that no piece
#: covers, and a prefix that no path reaches.
_START, _OTHER, _NONE = -1, -2, -3


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and values of the fields of a protocol buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = number()
        if tag & 7 == 0:
            yield tag >> 3, number()
            continue
        size = {1: 8, 5: 4}.get(tag & 7) or number()
        yield tag >> 3, data[at : at + size]
        at += size


class Model:
    """The pieces of a model file and the encoding of single words."""

    def __init__(self, data: bytes):
        self.kind, self.prefix, self.names, self.scores, self.types = _UNIGRAM, True, [], [], []
        for field, value in _fields(data):
            if field == 1:
                piece = dict(_fields(value))
                self.names.append(piece[1].decode())
                self.scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                self.types.append(piece.get(3, _NORMAL))
            elif field == 2:
                self.kind = dict(_fields(value)).get(3, _UNIGRAM)
            elif field == 3:
                spec = dict(_fields(value))
                self.prefix = bool(spec.get(3, 1))
                if spec.get(2) or spec.get(4, 1):
                    raise ValueError("models that normalise characters or white space are not read")
        if self.kind not in (_UNIGRAM, _BPE):
            raise ValueError(f"model type {self.kind}")
        usable = (_NORMAL, _USER, _UNUSED)
        self.ids = {n: k for k, n in enumerate(self.names) if self.types[k] in usable}
        self.unknown = self.types.index(_UNKNOWN)
        self.bytes = {int(n[3:5], 16): k for k, n in enumerate(self.names) if self.types[k] == _BYTE}
        self.unknown_score = min((s for s, t in zip(self.scores, self.types, strict=True) if t == _NORMAL), default=0.0) - 10
        # White space that no piece holds is a word of its own.
        alone = "".join(c for c in "\n\t\r\x0b\x0c" if not any(c in n for n in self.ids))
        rest = f"[^{MARK}{alone}]"
        self.words = re.compile(f"{MARK}+{rest}*|{rest}+" + (f"|[{alone}]" if alone else ""))
        self.fits: dict[int, bool] = {}
        self._build()
        self.surface = [self._surface(k) for k in range(len(self.names))]

    def _surface(self, k: int) -> bytes:
        if self.types[k] == _BYTE:
            return bytes([int(self.names[k][3:5], 16)])
        if self.types[k] == _UNKNOWN:
            return " ⁇ ".encode()
        return self.names[k].replace(MARK, " ").encode() if self.types[k] in (_NORMAL, _USER, _UNUSED) else b""

    def merged(self, word: str, stop: int = 1) -> list[str]:
        """Plain merging: again and again the neighbours whose joint piece scores best, the
        left ones of equal scores, until nothing or `stop` parts are left."""
        parts = list(word)
        while len(parts) > stop:
            best, at = None, -1
            for k in range(len(parts) - 1):
                found = self.ids.get(parts[k] + parts[k + 1])
                if found is not None and (best is None or self.scores[found] > best):
                    best, at = self.scores[found], k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _build(self) -> None:
        """The automaton: per state the next states, and the pieces that end there, longest
        first; and how BPE pieces come about."""
        self.next: list[dict[str, int]] = [{}]
        ends: list[list[int]] = [[]]
        self.halves: list[tuple[int, int] | None] = [None] * len(self.names)
        self.sizes = [len(n) for n in self.names]
        for name, piece in self.ids.items():
            if self.kind == _BPE and not self._halve(name, piece):
                continue  # merging never gives this piece
            state = 0
            for char in name:
                if char not in self.next[state]:
                    self.next[state][char] = len(self.next)
                    self.next.append({})
                    ends.append([])
                state = self.next[state][char]
            ends[state].append(piece)
        # By depth: the longest proper suffix that is a state, and what ends there as well.
        self.back = [0] * len(self.next)
        level = list(self.next[0].values())
        while level:
            deeper = []
            for state in level:
                ends[state] += ends[self.back[state]]
                for char, child in self.next[state].items():
                    suffix = self.back[state]
                    while suffix and char not in self.next[suffix]:
                        suffix = self.back[suffix]
                    self.back[child] = self.next[suffix].get(char, 0)
                    deeper.append(child)
            level = deeper
        self.ends = [tuple(e) for e in ends]
        self.known = 0

    def _halve(self, name: str, piece: int) -> bool:
        """Notes the two pieces that `piece` is merged from last; whether it ever is."""
        if len(name) == 1:
            return True
        parts = self.merged(name, stop=2)
        if len(parts) != 2 or self.merged(name) != [name]:
            return False
        if all(p in self.ids for p in parts):
            self.halves[piece] = tuple(self.ids[p] for p in parts)
        return True

    def _move(self, state: int, char: str) -> int:
        """The state after one more character, which is kept for the next time."""
        start = state
        while state and char not in self.next[state]:
            state = self.back[state]
        state = self.next[state].get(char, 0)
        if self.known < MAX_MOVES:
            self.known += 1
            self.next[start][char] = state
        return state

    def neighbours(self, left: int, right: int) -> bool:
        """Whether merging the text of two pieces gives these two.

        Seen backwards in time: of the two pieces at the border, the one that was merged
        later was its inner half before. While two pieces were neighbours at the border,
        from when both were there until one was merged, a joint piece of a better score
        would have come first; of equal scores, the left one comes first.
        """
        names, scores, ids = self.names, self.scores, self.ids
        if not names[left].strip(MARK):
            # Runs of marks have equal scores; there are few of them.
            return self.merged(names[left] + names[right]) == [names[left], names[right]]
        until, even = None, False
        while True:
            joint = ids.get(names[left] + names[right])
            if joint is not None and (until is None or scores[joint] > until or (even and scores[joint] == until)):
                return False
            a, b = self.halves[left], self.halves[right]
            if a is None and b is None:
                return True
            if b is None or (a is not None and scores[left] < scores[right]):
                until, even, left = scores[left], False, a[1]
            else:
                until, even, right = scores[right], True, b[0]

    def to_ids(self, parts: list[str]) -> list[int]:
        out = []
        for part in parts:
            found = self.ids.get(part)
            if found is not None:
                out.append(found)
            elif self.bytes:
                out += [self.bytes[b] for b in part.encode()]
            else:
                out.append(self.unknown)
        return out

    def encode_words(self, words: list[str]) -> dict[str, list[int]]:
        """The ids of distinct words, by one walk over their trie."""
        extend = self._extend_merged if self.kind == _BPE else self._extend_scored
        # Of the prefix of each length: state of the automaton, last piece, score.
        states, lasts, scores = [0], [_START], [0.0]
        out, before = {}, ""
        for word in sorted(words):
            shared = 0
            for a, b in zip(before, word):  # noqa: B905
                if a != b:
                    break
                shared += 1
            del states[shared + 1 :], lasts[shared + 1 :], scores[shared + 1 :]
            extend(word, states, lasts, scores)
            before = word
            out[word] = self._path(word, lasts)
        return out

    def _path(self, word: str, lasts: list[int]) -> list[int]:
        """The ids of the best path of a word, from its last pieces."""
        if lasts[len(word)] == _NONE:
            return self.to_ids(self.merged(word))
        found, at = [], len(word)
        while at > 0:
            piece = lasts[at]
            if piece == _OTHER:
                found += self.to_ids([word[at - 1]])[::-1]
                at -= 1
            else:
                found.append(piece)
                at -= self.sizes[piece]
        return found[::-1]

    def _extend_merged(self, word: str, states: list, lasts: list, scores: list) -> None:
        """The tables of the prefixes of `word` that are not there yet, for BPE."""
        moves, ends, sizes, fits, width = self.next, self.ends, self.sizes, self.fits, len(self.names)
        state = states[-1]
        for at in range(len(states), len(word) + 1):
            char = word[at - 1]
            following = moves[state].get(char)
            state = self._move(state, char) if following is None else following
            best = _NONE
            for piece in ends[state]:
                last = lasts[at - sizes[piece]]
                if last >= 0:
                    pair = last * width + piece
                    good = fits.get(pair)
                    if good is None:
                        if len(fits) > 2_000_000:
                            fits.clear()
                        good = fits[pair] = self.neighbours(last, piece)
                    if good:
                        best = piece
                        break
                elif last != _NONE:  # what is no piece merges with nothing
                    best = piece
                    break
            if best == _NONE and char not in self.ids and lasts[at - 1] != _NONE:
                best = _OTHER
            states.append(state)
            lasts.append(best)
            scores.append(0.0)

    def _extend_scored(self, word: str, states: list, lasts: list, scores: list) -> None:
        """The same for unigram models: the largest sum, of equal ones the longest piece."""
        state = states[-1]
        for at in range(len(states), len(word) + 1):
            char = word[at - 1]
            state = self._move(state, char)
            best, most = _NONE, None
            for piece in self.ends[state]:
                start = at - self.sizes[piece]
                score = scores[start] + self.scores[piece]
                if lasts[start] != _NONE and (most is None or score > most):
                    best, most = piece, score
            if char not in self.ids and lasts[at - 1] != _NONE:
                score = scores[at - 1] + self.unknown_score
                if most is None or score > most:
                    best, most = _OTHER, score
            states.append(state)
            lasts.append(best)
            scores.append(most or 0.0)

    def marked(self, text: str) -> str:
        if not text:
            return ""
        text = text.replace(" ", MARK)
        return MARK + text if self.prefix else text

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.surface.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


@cache
def load(name: str) -> Model:
    """The model of a file; built once per process."""
    with open(name if "/" in name else public_tokenizers.path(name), "rb") as file:
        return Model(file.read())


class _Memory:
    """Ids of the words met so far, end to end."""

    def __init__(self, model: Model):
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.codes: dict[str, int] = {}
        self.flat = np.zeros(0, np.int32)
        self.starts, self.sizes = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, end to end, and their bounds."""
        find, marked = self.model.words.findall, self.model.marked
        words = [find(marked(t)) for t in texts]
        if len(self.codes) > MAX_WORDS:
            self.clear()
        fresh = set(chain.from_iterable(words)).difference(self.codes)
        if fresh:
            new = self.model.encode_words(list(fresh))
            first = len(self.codes)
            self.codes.update(zip(new, range(first, first + len(new)), strict=True))
            sizes = np.fromiter(map(len, new.values()), np.int64, len(new))
            flat = np.fromiter(chain.from_iterable(new.values()), np.int32, int(sizes.sum()))
            self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(sizes) - sizes])
            self.sizes = np.concatenate([self.sizes, sizes])
            self.flat = np.concatenate([self.flat, flat])
        counts = np.array([len(w) for w in words], np.int64)
        at = np.fromiter(map(self.codes.__getitem__, chain.from_iterable(words)), np.int64, int(counts.sum()))
        sizes = self.sizes[at]
        ends = np.cumsum(sizes)
        places = np.repeat(self.starts[at] - ends + sizes, sizes) + np.arange(int(sizes.sum()))
        bounds = np.append(0, ends)[np.append(0, np.cumsum(counts))]
        return self.flat[places], bounds


def encoded(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, n_tokens, ids, and whether the ids decode to the text again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = _Memory(load(model))
        decode = memory.model.decode
        for batch in batches:
            for first in range(0, batch.num_rows, ROWS):
                part = batch.slice(first, ROWS)
                texts = [t or "" for t in part.column(1).to_pylist()]
                ids, bounds = memory.encode(texts)
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids))
                same = [decode(ids[a:b].tolist()) == t for a, b, t in zip(bounds[:-1], bounds[1:], texts, strict=True)]
                columns = [part.column(0), pa.array(np.diff(bounds)), lists, pa.array(same)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids", "round_trip"])

    key = docs.schema["doc_id"].dataType.simpleString()
    kind = f"doc_id {key}, n_tokens long, ids array<int>, round_trip boolean"
    return docs.select("doc_id", "text").mapInArrow(run, kind)


def decoded(rows: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id and the text of `ids` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = load(model).decode
        for batch in batches:
            texts = [decode(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    key = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "ids").mapInArrow(run, f"doc_id {key}, text string")
