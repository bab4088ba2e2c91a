"""Toxicity of texts: noisy-channel deobfuscation, then a score of what the words were meant to be.

Three things are learned: a character language model from all words of the corpus, the toxic weight of
letter runs from labelled documents, and a logistic curve over a document's heaviest words. All three
have a fixed size, whatever the corpus.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scoreloom.llm.common import (
    PARTIAL,
    aside,
    bitmap,
    crc_of_id,
    has_bit,
    key_bucket,
    mix64,
    partial,
    query,
    restored_names,
    slices,
    stored,
    summed,
    table,
)

#: Letter runs that words are scored by, and counters for them.
RUN = 5
FEATURES = 1 << 21
#: Texts with a run are counted; toxic ones apart for so many classes of the word before. A run counts only if
#: it is toxic after most of them: words of one copied text stand after one word only.
CONTEXTS = 4
#: Pseudo-texts that pull a run's weight towards none.
PRIOR = 3.0
#: Toxic texts at which half of a run's weight is believed.
DOUBT = 5.0
#: A word this heavy counts as toxic evidence.
HEAVY = 3.0
#: Labelled rows that the logistic curve is fitted on: those with the smallest hashed ids, and of
#: repeated ids no more than as many again.
SAMPLE = 20_000
THRESHOLD = 0.7

# What characters may stand for letters, besides themselves.
STANDS_FOR = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¥": "y",
}
#: Costs, in natural log units, of reading a character as a letter, of leaving out a mark or a digit,
#: and of taking a doubled letter as one.
READ, DROP_MARK, DROP_DIGIT, HALVE = 0.7, 1.0, 4.0, 1.5

_EDGES = b".,;:!?\"'()[]{}<>|`~-_=/\\"
_TRIPLE = re.compile(rb"(.)\1\1")
_TAIL = re.compile(rb"([^a-z0-9\x80-\xff])\1{2,}$")
_LETTERS = bytes(range(ord("a"), ord("z") + 1)) + bytes(range(128, 256))
ALPHABET = 32


def plain(word: bytes) -> bytes:
    """A word in lower case without the marks around it."""
    return _TAIL.sub(b"", word.lower()).strip(_EDGES)


def suspicious(word: bytes) -> bool:
    """Whether a word holds anything but letters, or a letter three times in a row."""
    return bool(word.translate(None, _LETTERS)) or _TRIPLE.search(word) is not None


# ---- character model -----------------------------------------------------------------------------


def letter_codes(text: str) -> list[int]:
    """1-26 for a-z, 27-31 for other characters by code point, 0 is the edge of a word."""
    return [ord(c) - 96 if "a" <= c <= "z" else 27 + ord(c) % 5 for c in text]


_CODE_OF_BYTE = np.array([b - 96 if 97 <= b <= 122 else 27 + b % 5 for b in range(256)], np.int64)


def _trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(ALPHABET**3, np.int64)
    for part in slices(batches, "text"):
        words: dict[bytes, int] = {}
        for text in part.column("text").to_pylist():
            for w in (text or "").encode().split():
                words[w] = words.get(w, 0) + 1
        clean = [(p, n) for w, n in words.items() if (p := plain(w)) and not suspicious(p) and p.isascii()]
        if not clean:
            continue
        lengths = np.array([len(p) for p, _ in clean])
        flat = np.zeros(int(lengths.sum()) + 2 * len(clean), np.int64)  # two edges before each word, which also end the last
        at = np.arange(int(lengths.sum())) + 2 * (np.repeat(np.arange(len(clean)), lengths) + 1)
        flat[at] = _CODE_OF_BYTE[np.frombuffer(b"".join(p for p, _ in clean), np.uint8)]
        flat = np.r_[flat, 0]
        weight = np.repeat(np.array([n for _, n in clean]), lengths + 2)
        code = flat[:-2] * ALPHABET * ALPHABET + flat[1:-1] * ALPHABET + flat[2:]
        real = (flat[1:-1] > 0) | (flat[2:] > 0)
        counts += np.bincount(code[real], weight[: len(code)][real], ALPHABET**3).astype(np.int64)
    yield partial(0, TaskContext.get().partitionId(), counts)


def character_model(texts: DataFrame) -> np.ndarray:
    """log P(letter | two letters before), from every clean word of every text."""
    found = summed(texts.mapInArrow(_trigrams, PARTIAL), np.int64, texts.rdd.getNumPartitions())
    counts = found.get(0, np.zeros(ALPHABET**3, np.int64)).reshape(ALPHABET, ALPHABET, ALPHABET).astype(np.float64)
    lower = counts.sum(0) + 0.1
    lower /= lower.sum(1, keepdims=True)
    return np.log((counts + 2.0 * lower[None]) / (counts.sum(2, keepdims=True) + 2.0))


def restored(word: str, model: np.ndarray) -> str:
    """The likeliest letters behind a noisy word: Viterbi over the lattice of its readings.

    A letter stands for itself; a digit or mark for the letters it resembles, or for nothing; a run
    of one letter for one or two of it. States are the last two letters.
    """
    runs = [(m.group()[0], len(m.group())) for m in re.finditer(r"(.)\1*", word, re.S)]
    best: dict[tuple[int, int], tuple[float, str]] = {(0, 0): (0.0, "")}
    for c, n in runs:
        if c.isalpha():
            options = [(c, 0.0)] if n == 1 else [(c * 2, 0.0), (c, HALVE)] if n == 2 else [(c, 0.0), (c * 2, HALVE)]
        else:
            drop = (DROP_DIGIT if c.isdigit() else DROP_MARK) * (n if c.isdigit() else 1)
            options = [("", drop)]
            for letter in STANDS_FOR.get(c, ""):
                options += [(letter, READ), *([(letter * 2, READ)] if n > 1 else [])]
        after: dict[tuple[int, int], tuple[float, str]] = {}
        for (a, b), (score, out) in best.items():
            for letters, cost in options:
                x, y, s = a, b, score - cost
                for code in letter_codes(letters):
                    s += model[x, y, code]
                    x, y = y, code
                if (x, y) not in after or s > after[x, y][0]:
                    after[x, y] = (s, out + letters)
        best = after
    return max(((s + model[a, b, 0], out) for (a, b), (s, out) in best.items()), default=(0.0, ""))[1]


def joined_letters(words: list[bytes]) -> list[bytes]:
    """Runs of three or more single letters, or letter-like marks, as one word: spelled-out text."""
    if sum(len(w) == 1 for w in words) < 3:
        return words
    out: list[bytes] = []
    run: list[bytes] = []
    for w in [*words, b""]:
        if len(w) == 1 and (w.isalnum() or w.decode("latin-1") in STANDS_FOR):
            run.append(w)
            continue
        out += [b"".join(run)] if len(run) >= 3 else run
        run = []
        if w:
            out.append(w)
    return out


# ---- weights of letter runs ----------------------------------------------------------------------


def run_features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Counters of the letter runs of ^word$, of many words at once, and how many each word has."""
    marked = [b"^" + w + b"$" for w in words]
    marked = [w if len(w) >= RUN else w.ljust(RUN, b"$") for w in marked]
    lengths = np.array([len(w) for w in marked])
    flat = np.frombuffer(b"".join(marked), np.uint8).astype(np.uint64)
    code = np.zeros(max(0, len(flat) - RUN + 1), np.uint64)
    for k in range(RUN):
        code |= flat[k : k + len(code)] << np.uint64(8 * k)
    ends = np.cumsum(lengths)
    inside = np.ones(len(code), bool)
    for k in range(1, RUN):
        at = ends[:-1] - k
        inside[at] = False
    return (mix64(code[inside]) & np.uint64(FEATURES - 1)).astype(np.int64), lengths - RUN + 1


class Readings:
    """What each word reads as; new words are restored once and remembered while memory allows."""

    def __init__(self, model: np.ndarray, most: int = 200_000):
        self.model, self.most = model, most
        self.of: dict[bytes, tuple[bytes, ...]] = {}

    def __call__(self, word: bytes) -> tuple[bytes, ...]:
        found = self.of.get(word)
        if found is None:
            if len(self.of) >= self.most:
                self.of.clear()
            p = plain(word)
            if not suspicious(p):
                found = (p,)
            else:
                bare = re.sub(rb"[^a-z\x80-\xff]", b"", p)
                raw = word.lower().strip(b".,;:?\"'")
                found = tuple(dict.fromkeys([restored(raw.decode("utf-8", "replace"), self.model).encode(), bare]))
            self.of[word] = found
        return found


def _run_counts(model):
    """Toxic texts with each letter run, by class of the word before, and other texts with it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = Readings(model.value)
        counts = np.zeros((CONTEXTS + 1, FEATURES), np.int64)
        for part in slices(batches, "text"):
            seen: dict[tuple[bytes, int], int] = {}
            for text, toxic in zip(part.column("text").to_pylist(), part.column("toxic").to_pylist()):
                words = joined_letters((text or "").encode().split())
                for w, before in dict(zip(words, [b"", *words])).items():  # each word of a text once
                    key = (w, (hash_of(before) % CONTEXTS) if toxic else CONTEXTS)
                    seen[key] = seen.get(key, 0) + 1
            flat = [(r, cls, n) for (w, cls), n in seen.items() for r in read(w)]
            if not flat:
                continue
            f, sizes = run_features([r for r, _, _ in flat])
            cls = np.repeat(np.array([c for _, c, _ in flat]), sizes)
            n = np.repeat(np.array([k for _, _, k in flat]), sizes)
            for c in range(CONTEXTS + 1):
                here = cls == c
                counts[c] += np.bincount(f[here], n[here], FEATURES).astype(np.int64)
        for c in range(CONTEXTS + 1):
            yield partial(c, TaskContext.get().partitionId(), counts[c])

    return run


def hash_of(word: bytes) -> int:
    return sum(word[:8]) + 31 * len(word)


def run_weights(train: DataFrame, model) -> np.ndarray:
    """How much likelier a letter run is in toxic texts, as a log ratio; 0 where that isn't certain."""
    found = summed(train.mapInArrow(_run_counts(model), PARTIAL), np.int64, train.rdd.getNumPartitions())
    zero = np.zeros(FEATURES, np.int64)
    toxic = np.stack([found.get(c, zero) for c in range(CONTEXTS)])
    other = found.get(CONTEXTS, zero).astype(np.float64)
    some = toxic.sum(0).astype(np.float64)
    rate = min(max(some.sum() / max(some.sum() + other.sum(), 1.0), 1e-6), 1 - 1e-6)
    weight = np.log((some + PRIOR * rate) / (other + PRIOR * (1 - rate)) * (1 - rate) / rate)
    sure = some / (some + DOUBT)
    return np.where((toxic > 0).sum(0) >= CONTEXTS - 1, weight * sure, 0.0).astype(np.float32)


# ---- documents -----------------------------------------------------------------------------------


class Model(NamedTuple):
    letters: np.ndarray
    runs: np.ndarray
    curve: np.ndarray


def evidence(texts: list[str | None], read: Readings, runs: np.ndarray, weights: dict[bytes, float]) -> np.ndarray:
    """Per text: 1, the weights of its two heaviest words, and the log number of heavy words."""
    docs = [joined_letters((t or "").encode().split()) for t in texts]
    new = list({w for d in docs for w in d if w not in weights})
    if new:
        readings = [(i, r) for i, w in enumerate(new) for r in read(w)]
        f, sizes = run_features([r for _, r in readings])
        each = np.zeros(len(new), np.float32)
        heaviest = np.maximum.reduceat(runs[f], np.cumsum(sizes) - sizes)
        np.maximum.at(each, np.array([i for i, _ in readings]), heaviest)
        weights.update(zip(new, each.tolist()))
    out = np.zeros((len(docs), 4))
    for k, d in enumerate(docs):
        w = np.fromiter(map(weights.__getitem__, d), np.float64, len(d))
        top = np.sort(np.partition(w, -2)[-2:])[::-1] if len(w) > 1 else np.r_[w, np.zeros(2 - len(w))]
        out[k] = 1.0, max(top[0], 0.0), max(top[1], 0.0), np.log1p((w >= HEAVY).sum())
    return out


def _evidences(model, carry: list[str], curve: np.ndarray | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, runs = model.value
        read, weights = Readings(letters), {}
        for part in slices(batches, "text"):
            if len(weights) > 300_000:
                weights.clear()
            x = evidence(part.column("text").to_pylist(), read, runs, weights)
            columns = [part.column(c) for c in carry]
            if curve is None:
                columns.append(pa.array(x.tolist(), pa.list_(pa.float64())))
            else:
                columns.append(pa.array(1 / (1 + np.exp(-np.clip(x @ curve, -50, 50)))))
            yield pa.RecordBatch.from_arrays(columns, names=[*carry, "x" if curve is None else "_score"])

    return run


def fitted(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """A logistic curve by Newton steps, with a little shrinkage; the base rate if labels agree."""
    beta = np.zeros(x.shape[1])
    if len(y) == 0:
        beta[0] = -5.0
        return beta
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -50, 50)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(x.shape[1])
        step = np.linalg.solve(h, x.T @ (y - p) - 0.1 * beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def toxic_scores(docs: DataFrame, labels: DataFrame, train_rows) -> DataFrame:
    """`docs` without its text, with _score: the probability that a text is toxic.

    `labels` (doc_id, toxic) are used of the rows where `train_rows` holds; a document labelled twice
    is toxic if any label says so, null labels are left out. Null and empty texts get the score of no
    evidence. Without labels every score is low. Repeated rows score alike; no rows give no rows.
    """
    spark = docs.sparkSession
    texts = docs.select("text")
    letters = spark.sparkContext.broadcast(character_model(texts))
    marks = stored(
        labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & train_rows)
        .groupBy(F.col("doc_id").cast("long").alias("_id"))
        .agg(F.max("toxic").cast("int").alias("toxic")),
        "labels",
    )
    bits = spark.sparkContext.broadcast(bitmap(marks.select("_id").mapInArrow(_ids, "bucket int")))
    keyed = docs.select(F.col("doc_id").cast("long").alias("_id"), "text").where("_id is not null")
    train = stored(keyed.mapInArrow(_those(bits), keyed.schema).join(marks, "_id"), "labelled")
    runs = run_weights(train, letters)
    model = spark.sparkContext.broadcast((letters.value, runs))
    # the sample's ids are found by their hashes alone; texts stay where they are
    key = F.xxhash64("_id")
    last = train.select(key.alias("k")).orderBy("k").limit(SAMPLE).agg(F.max("k")).first()[0]
    sample = train.where(key <= F.lit(last)) if last is not None else train
    rows = sample.mapInArrow(_evidences(model, ["toxic"], None), "toxic int, x array<double>").limit(2 * SAMPLE).toArrow()
    x = np.array(rows.column("x").to_pylist(), np.float64).reshape(-1, 4)
    curve = fitted(x, rows.column("toxic").to_numpy().astype(np.float64))
    inner, names = aside(docs, "text")
    carry = [m for c, m in names.items() if c != "text"]
    schema = T.StructType([*[inner.schema[m] for m in carry], T.StructField("_score", T.DoubleType())])
    scored = inner.select(*carry, "text").mapInArrow(_evidences(model, carry, curve), schema)
    return scored.select(*restored_names(names, ["_score"], without=["text"]))


def _ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(key_bucket(batch.column(0).to_numpy().view(np.uint64)).astype(np.int32))], names=["bucket"])


def _those(bits):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(has_bit(bits.value, key_bucket(batch.column("_id").to_numpy().view(np.uint64)))))

    return run


@query("op6_toxicity")
def op6(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxic_scores(docs, table(spark, sf_dir, "labels"), crc_of_id(F.col("doc_id")) % 3 != 1)
    return scored.select(
        "doc_id",
        (crc_of_id(F.col("doc_id")) % 3 == 1).alias("held_out"),
        F.col("_score").alias("score"),
        (F.col("_score") >= THRESHOLD).cast("int").alias("predicted"),
    )
