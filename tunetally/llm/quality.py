"""Quality rules: count rules, and divergence of a text from the references of languages.

Every text gets two histograms: classes of characters (without digits), and common words.
Both are compared with the mean histograms of languages by Jensen-Shannon divergence, and the
nearest of them counts, as labels of languages may be wrong: those of the text's own language
and of the `COMMON` languages with the most texts. The references are means over all texts of a
language that pass the base rules and are long enough.

A label is no evidence that its texts are prose. A mean is a reference only if its classes of
characters are within `MAX_DISTANCE` of a fixed profile of written language, `PROFILES`, which
no row of the table has a part in; so no number of junk rows approves junk.

Guards for length: a text below `MIN_CHARS` or `MIN_HISTOGRAM_WORDS` is not judged by
histograms; of the divergence of words, what `n` words drawn from the reference itself
would show on average, (bins - 1) / (8 n ln 2), is taken off. A language has a reference
from `MIN_REFERENCE_TEXTS` texts on, whatever the size of the table. The common words are
those of four languages; in a text or reference of another language they fall into one bin, so
that only classes of characters tell there.

Defined results: a null text has no words and fails; a null language is compared with the
references of the common languages; a text in a language without a reference (and one without
a language if there is no reference at all) has its classes of characters compared with
`PROFILES`, letters outside ASCII counting as letters there; repeated rows are judged one by
one; equal distances need no order, as the least one counts; of languages with as many texts
the one that sorts first is common; an empty table gives an empty result.
Other columns are kept or dropped as each function says, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from tunetally.llm.words import Texts, chunks, mix, window_hashes
from tunetally.session import materialize

MIN_WORDS = 20
REPEAT_WINDOW = 8
MAX_REPEAT_PERCENT = 30
#: Fewer characters or words than this are not enough for a histogram.
MIN_CHARS = 200
MIN_HISTOGRAM_WORDS = 50
#: A mean of fewer texts than this is no reference.
MIN_REFERENCE_TEXTS = 20
#: Languages, by number of texts, that every text is compared with.
COMMON = 64
#: Bins of a reference below this share don't count as bins of the sampling noise.
SMALL_BIN = 0.004
MAX_DISTANCE = 0.28
SCALE = 1_000_000

# Frequent words of English, German, French and Spanish.
COMMON_WORDS = (
    "the of and to in a is that for it as was with be by on not he are this at from or an which"
    " der die das und ist nicht ein eine zu den von mit sich auf für im dem des als auch"
    " le la les des et une un est que pour dans qui sur pas plus par avec ce"
    " el los las y del se por con no su al lo como más de en"
).split()
COMMON_WORDS = tuple(dict.fromkeys(COMMON_WORDS))

# Classes of bytes; the last one takes what is in no other.
CHAR_CLASSES = (
    b"abcdefghijklmnopqrstuvwxyz",
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    b"0123456789",
    b" \t\x0b\x0c\r",
    b"\n",
    b".,;:",
    b"!?",
    b"#*$%&|<>",
    bytes(range(0xC0, 0x100)),
)
DIGITS = 2
LOWER, HIGH = 0, 8
# Shares of the classes in written language, letters outside ASCII and digits
# left out: of scripts with spaces between words, and of those without.
PROFILES = (
    (0.795, 0.03, 0.0, 0.15, 0.003, 0.018, 0.001, 0.0, 0.0, 0.003),
    (0.88, 0.0, 0.0, 0.01, 0.003, 0.002, 0.001, 0.0, 0.0, 0.104),
)
N_CHARS = len(CHAR_CLASSES) + 1
N_WORDS = len(COMMON_WORDS) + 1
_CLASS_OF = np.full(256, N_CHARS - 1, np.int64)
for _k, _bytes in enumerate(CHAR_CLASSES):
    _CLASS_OF[list(_bytes)] = _k
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_CONTINUES = np.zeros(256, bool)
_CONTINUES[0x80:0xC0] = True

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _own_duplicates(keys: np.ndarray) -> np.ndarray:
    """Which of the keys occur twice or more."""
    ranked = np.sort(keys)
    twice = ranked[1:][ranked[1:] == ranked[:-1]]
    if not len(twice):
        return np.zeros(len(keys), bool)
    at = np.searchsorted(twice, keys)
    return twice[np.minimum(at, len(twice) - 1)] == keys


def repeated_words(texts: Texts, size: int) -> np.ndarray:
    """Per text, the words in runs of `size` words that the text has twice or more."""
    at = texts.windows(size)
    if not len(at):
        return np.zeros(texts.n, np.int64)
    keys = window_hashes(texts.word_hashes(), size)[at]
    keys = mix(keys ^ mix(texts.text_of[at].astype(np.uint64) + np.uint64(1)))
    at = at[_own_duplicates(keys)]
    edges = np.zeros(len(texts.starts) + 1, np.int64)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + size, -1)
    return np.bincount(texts.text_of[np.cumsum(edges[:-1]) > 0], minlength=texts.n)


def duplicate_lines(texts: Texts) -> np.ndarray:
    """Per text, the lines with a word that equal an earlier line of it."""
    breaks = np.flatnonzero(texts.data == 10)
    starts = np.union1d(texts.bounds[:-1], breaks + 1)
    starts = starts[starts < len(texts.data)]
    owner = np.searchsorted(texts.bounds, starts, "right") - 1
    ends = np.minimum(np.append(starts[1:], len(texts.data)), texts.bounds[owner + 1])
    ends = np.where((ends > starts) & (texts.data[np.maximum(ends - 1, 0)] == 10), ends - 1, ends)
    words = np.searchsorted(texts.starts, ends) - np.searchsorted(texts.starts, starts)
    starts, ends, owner = starts[words > 0], ends[words > 0], owner[words > 0]
    keys = texts.spans(starts, ends).indices.to_numpy()
    order = np.lexsort((keys, owner))
    keys, owner = keys[order], owner[order]
    again = (keys[1:] == keys[:-1]) & (owner[1:] == owner[:-1])
    return np.bincount(owner[1:][again], minlength=texts.n)


def _histogram(texts: Texts, owner: np.ndarray, bins: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(owner * n + bins, minlength=texts.n * n).reshape(texts.n, n)


_common = None


def _common_bins(hashes: np.ndarray) -> np.ndarray:
    global _common
    if _common is None:
        data = np.frombuffer(" ".join(COMMON_WORDS).encode(), np.uint8)
        own = Texts(data, np.array([0, len(data)]), 0, 1).word_hashes(fold=True)
        _common = (np.sort(own), np.argsort(own))
    ranked, order = _common
    at = np.minimum(np.searchsorted(ranked, hashes), len(ranked) - 1)
    return np.where(ranked[at] == hashes, order[at], N_WORDS - 1)


def _measure(texts: Texts) -> list[np.ndarray]:
    owner = np.repeat(np.arange(texts.n), np.diff(texts.bounds))
    leads = ~_CONTINUES[texts.data]
    return [
        texts.n_words,
        texts.counted(texts.inside & leads),
        texts.counted(_SYMBOL[texts.data]),
        duplicate_lines(texts),
        repeated_words(texts, REPEAT_WINDOW),
        texts.counted(leads),
        _histogram(texts, owner[leads], _CLASS_OF[texts.data[leads]], N_CHARS),
        _histogram(texts, texts.text_of, _common_bins(texts.word_hashes(fold=True)), N_WORDS),
    ]


def measured(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The counts of `BASE`, `q_chars` and the two histograms of every text, with the
    columns `keep` and `lang`."""
    keep = tuple(dict.fromkeys([*keep, "lang"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(batch.num_columns - 1)
            for texts in chunks(text):
                values = _measure(texts)
                arrays = [batch.column(k).slice(texts.first, texts.n) for k in range(len(keep))]
                arrays += [pa.array(x, pa.int64()) for x in values[:6]]
                for x in values[6:]:
                    flat = pa.array(x.ravel(), pa.int64())
                    ends = pa.array(np.arange(texts.n + 1) * x.shape[1], pa.int32())
                    arrays.append(pa.ListArray.from_arrays(ends, flat))
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    names = [*(f"k{n}" for n in range(len(keep))), *BASE, "q_chars", "q_char_bins", "q_word_bins"]
    source = docs.select(*(F.col(c).alias(f"k{n}") for n, c in enumerate(keep)), F.col("text").alias("t"))
    kinds = [f"k{n} {docs.schema[c].dataType.simpleString()}" for n, c in enumerate(keep)]
    kinds += [f"{c} long" for c in (*BASE, "q_chars")]
    kinds += ["q_char_bins array<long>", "q_word_bins array<long>"]
    out = source.mapInArrow(run, ", ".join(kinds))
    return out.withColumnsRenamed({f"k{n}": c for n, c in enumerate(keep)})


def base_failed() -> Column:
    too_repetitive = 100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")
    return (F.col("n_words") < MIN_WORDS) | too_repetitive


def _long_enough() -> Column:
    return (F.col("q_chars") >= MIN_CHARS) & (F.col("n_words") >= MIN_HISTOGRAM_WORDS)


def languages(texts: DataFrame) -> DataFrame:
    """Per language (null is one as well) the number of judged texts and the sums of their
    frequencies, in millionths; whole numbers add up to the same sums in any order."""

    def shares(bins: str, n: int, total: Column) -> list[Column]:
        return [F.sum(F.floor(F.col(bins)[k] * SCALE / total)).alias(f"{bins}_{k}") for k in range(n)]

    letters = F.greatest(F.col("q_chars") - F.col("q_char_bins")[DIGITS], F.lit(1))
    sums = shares("q_char_bins", N_CHARS, letters) + shares("q_word_bins", N_WORDS, F.col("n_words"))
    judged = texts.where(~base_failed() & _long_enough())
    return judged.groupBy("lang").agg(F.count("*").alias("texts"), *sums).select(
        F.col("lang").alias("ref_lang"),
        "texts",
        F.array(*(F.col(f"q_char_bins_{k}") for k in range(N_CHARS))).alias("ref_chars"),
        F.array(*(F.col(f"q_word_bins_{k}") for k in range(N_WORDS))).alias("ref_words"),
    )


def _frequencies(bins: np.ndarray) -> np.ndarray:
    return bins / np.maximum(bins.sum(axis=-1, keepdims=True), 1)


def js_divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Row by row: 0 if equal, 1 if the two share no bin; its root is the distance."""
    middle = (p + q) / 2

    def part(v: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(v > 0, v * np.log2(v / middle), 0.0).sum(axis=1)

    return np.maximum((part(p) + part(np.broadcast_to(q, p.shape))) / 2, 0.0)


def _distances(chars: np.ndarray, words: np.ndarray, refs: list[tuple]) -> np.ndarray:
    """The distance of each text to its nearest reference."""
    chars = chars.astype(float)
    chars[:, DIGITS] = 0
    n_words = np.maximum(words.sum(axis=1), 1)
    chars, words = _frequencies(chars), _frequencies(words.astype(float))
    best = np.full(len(chars), np.inf)
    for ref_chars, ref_words in refs:
        noise = ((ref_words > SMALL_BIN).sum() - 1) / (8 * np.log(2) * n_words)
        excess = np.maximum(js_divergence(words, ref_words) - noise, 0.0)
        best = np.minimum(best, js_divergence(chars, ref_chars) + excess)
    return np.sqrt(best)


def _folded(chars: np.ndarray) -> np.ndarray:
    """Frequencies of classes of characters that no script is far from: without digits,
    and with letters outside ASCII as letters."""
    chars = chars.astype(float)
    chars[:, LOWER] += chars[:, HIGH]
    chars[:, [DIGITS, HIGH]] = 0
    return _frequencies(chars)


def _profile_distance(chars: np.ndarray) -> np.ndarray:
    """The distance of each row of classes to the nearest of `PROFILES`."""
    folded = _folded(chars)
    return np.sqrt(np.min([js_divergence(folded, np.array(p)) for p in PROFILES], axis=0))


def references(langs: DataFrame) -> DataFrame:
    """The rows of `languages` that are references."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                chars = batch.column(batch.schema.get_field_index("ref_chars")).flatten().to_numpy()
                near = _profile_distance(chars.reshape(batch.num_rows, -1)) <= MAX_DISTANCE
                yield batch.filter(pa.array(near))

    enough = langs.where(F.col("ref_lang").isNotNull() & (F.col("texts") >= MIN_REFERENCE_TEXTS))
    return enough.mapInArrow(run, langs.schema)


def _reference(chars: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    chars = np.array(chars, float)
    chars[DIGITS] = 0
    return _frequencies(chars), _frequencies(np.array(words, float))


def _compared(state: DataFrame, common: list[Row], out: list[str]) -> DataFrame:
    """The columns `out` of `state`, which has each text beside the reference of its own
    language, with `distance` and `profile_distance`."""
    shared = [_reference(row["ref_chars"], row["ref_words"]) for row in common]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = {c: batch.column(c) for c in batch.schema.names}
            distance, apart = np.full(batch.num_rows, np.nan), np.full(batch.num_rows, np.nan)
            at = np.flatnonzero(rows["q_judged"].to_numpy(zero_copy_only=False))
            if len(at):
                chars, words = (rows[c].flatten().to_numpy().reshape(batch.num_rows, -1)[at] for c in ("q_char_bins", "q_word_bins"))
                nearest = _distances(chars, words, shared)
                own = rows["ref_lang"].take(pa.array(at))
                beyond = rows["ref_chars"].is_valid().to_numpy(zero_copy_only=False)[at]
                for lang in own.filter(pa.array(beyond)).unique().to_pylist():
                    mine = np.flatnonzero(pc.fill_null(pc.equal(own, lang), False).to_numpy(zero_copy_only=False))
                    ref = _reference(*(rows[c][int(at[mine[0]])].as_py() for c in ("ref_chars", "ref_words")))
                    nearest[mine] = np.minimum(nearest[mine], _distances(chars[mine], words[mine], [ref]))
                known = own.is_valid().to_numpy(zero_copy_only=False)
                known = (known | rows["lang"].is_null().to_numpy(zero_copy_only=False)[at]) & np.isfinite(nearest)
                distance[at[known]] = nearest[known]
                apart[at[~known]] = _profile_distance(chars[~known])
            rows["distance"], rows["profile_distance"] = (pa.array(x, from_pandas=True) for x in (distance, apart))
            yield pa.RecordBatch.from_arrays([rows[c] for c in out], names=out)

    kinds = {f.name: f.dataType.simpleString() for f in state.schema} | {"distance": "double", "profile_distance": "double"}
    return state.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in out))


def _beside_own(state: DataFrame, refs: DataFrame, common: list[str]) -> DataFrame:
    """Each text with the reference of its own language, if it has one that is not common;
    of a common one, which all texts meet anyway, the name only. The texts of the common
    languages, which may be most rows, are not shuffled."""
    is_common = F.coalesce(F.col("lang").cast("string").isin(common), F.lit(False))
    kinds = {c: refs.schema[c].dataType for c in ("ref_lang", "ref_chars", "ref_words")}
    none = [F.lit(None).cast(kinds[c]).alias(c) for c in ("ref_chars", "ref_words")]
    near = state.where(is_common).select("*", F.col("lang").alias("ref_lang"), *none)
    if refs.count() <= len(common):
        return state.select("*", F.when(is_common, F.col("lang")).alias("ref_lang"), *none)
    far = state.where(~is_common)
    own = refs.where(~F.coalesce(F.col("ref_lang").cast("string").isin(common), F.lit(False))).drop("texts")
    return near.unionByName(far.join(own, far["lang"] == own["ref_lang"], "left"))


def judged(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep`, the counts of `BASE`, `base_failed`, `distance` to the nearest reference
    (null where the text is not judged by it), `profile_distance` to the fixed profile
    (null where it is not judged by that) and `kept` of every row."""
    texts = materialize(measured(docs, keep), "quality")
    refs = materialize(references(materialize(languages(texts), "quality-languages")), "quality-references")
    common = refs.orderBy(F.desc("texts"), "ref_lang").limit(COMMON).collect()
    state = texts.select(
        *(F.col(c).alias(f"k{n}") for n, c in enumerate(keep)), *BASE, base_failed().alias("base_failed"),
        "lang", _long_enough().alias("q_judged"), "q_char_bins", "q_word_bins",
    )
    state = _beside_own(state, refs, [row["ref_lang"] for row in common])
    names = [*(f"k{n}" for n in range(len(keep))), *BASE, "base_failed", "distance", "profile_distance"]
    out = _compared(state, common, names).withColumnsRenamed({f"k{n}": c for n, c in enumerate(keep)})
    far = F.coalesce(F.greatest("distance", "profile_distance") > MAX_DISTANCE, F.lit(False))
    return out.withColumn("kept", ~F.col("base_failed") & ~far)


def quality_filter(docs: DataFrame) -> DataFrame:
    """The rows of `docs` whose text is kept, unchanged.

    The verdict belongs to the text and its language, so rows need no key: the verdicts of
    the distinct pairs of text hash and language are joined back.
    """
    key = F.struct(F.sha2(F.coalesce("text", F.lit("")), 256).alias("h"), F.col("lang").alias("l"))
    keyed = docs.withColumn("quality_key", key)
    verdicts = judged(docs.select(key.alias("quality_key"), "text", "lang"), ("quality_key",))
    good = verdicts.where("kept").select("quality_key").distinct()
    return keyed.join(good, "quality_key", "left_semi").select(*(keyed[c] for c in docs.columns))
