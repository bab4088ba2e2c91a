"""BPE encoding and decoding in batched numpy merge rounds."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scoreloom.llm.common import aside, query, restored_names, slices, table

# Distinct words a worker remembers; beyond this many it starts anew.
REMEMBERED = 200_000
NONE = np.uint32(0xFFFFFFFF)


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies.

    Printable Latin-1 characters stand for themselves; the other bytes, in order, for the characters
    from U+0100 on.
    """
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    letters = {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [letters[b] for b in range(256)]


class Bpe:
    """A byte-level BPE with word ends, read from a tokenizer file: its tables and its text rules."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        suffix = model["end_of_word_suffix"] or ""
        pairs = [(vocab[a], vocab[b], vocab[a + b]) for a, b in model["merges"]]
        keys = np.array([(a << 16) | b for a, b, _ in pairs], np.uint32)
        order = np.argsort(keys, kind="stable")
        self.keys = keys[order]
        self.ranks = order.astype(np.uint32)
        self.made = np.array([c for _, _, c in pairs], np.uint32)[order]
        self.of_byte = np.array([vocab[c] for c in byte_letters()], np.uint32)
        self.of_last = np.array([vocab[c + suffix] for c in byte_letters()], np.uint32)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.tokens: list[bytes] = [b""] * size
        for token, i in [*vocab.items(), *self.special.items()]:
            self.tokens[i] = token.encode()
        self.pattern: str = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]

    def pieces(self, find, cut, text: str) -> list[str]:
        """The words of a text, in order; special tokens stand whole among them.

        Letters are folded one by one, so a capital sigma at the end of a word becomes the same
        letter as elsewhere. White space only parts words, whichever kind it is.
        """
        out: list[str] = []
        for part in cut.split(text) if "<|" in text else (text,):
            if part in self.special:
                out.append(part)
            else:
                out += find(unicodedata.normalize("NFC", part).replace("Σ", "σ").lower())
        return out

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many words as one flat array, and the number of ids of each word.

        A round looks up every neighbouring pair by binary search, takes the lowest rank of each
        word, and merges all its places at once, the leftmost first where they overlap. A pair
        made by a merge ranks after it, so this is the order of one merge at a time. Words without
        a pair are done and leave.
        """
        lengths = np.array([len(w) for w in words], np.int64)
        raw = np.frombuffer(b"".join(words), np.uint8)
        ids = self.of_byte[raw]
        ends = np.cumsum(lengths) - 1
        ids[ends] = self.of_last[raw[ends]]
        word = np.repeat(np.arange(len(words)), lengths)
        done_ids: list[np.ndarray] = []
        done_word: list[np.ndarray] = []
        while len(ids):
            rank = np.full(len(ids), NONE, np.uint32)
            pair = (ids[:-1] << np.uint32(16)) | ids[1:]
            at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
            known = (self.keys[at] == pair) & (word[:-1] == word[1:])
            rank[:-1][known] = self.ranks[at[known]]
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            sizes = np.diff(np.r_[starts, len(ids)])
            lowest = np.minimum.reduceat(rank, starts)
            least = np.repeat(lowest, sizes)
            going = least != NONE
            if not going.all():
                done_ids.append(ids[~going])
                done_word.append(word[~going])
            hit = going & (rank == least)
            place = np.flatnonzero(hit)
            if len(place) == 0:
                break
            first = np.flatnonzero(np.r_[True, np.diff(place) != 1])
            run = np.repeat(place[first], np.diff(np.r_[first, len(place)]))
            place = place[(place - run) % 2 == 0]
            ids[place] = self.made[at[place]]
            keep = going
            keep[place + 1] = False
            ids, word = ids[keep], word[keep]
        all_ids, all_words = np.concatenate(done_ids), np.concatenate(done_word)
        order = np.argsort(all_words, kind="stable")
        return all_ids[order], np.bincount(all_words, minlength=len(words))


class _Codes(dict):
    """Numbers words in order of appearance."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        self.new.append(word)
        return n


class _Encoder:
    """Encodes slices of texts, each distinct word once while it is remembered."""

    def __init__(self, bpe: Bpe):
        self.bpe = bpe
        self.find = regex.compile(bpe.pattern).findall
        self.cut = re.compile("(" + "|".join(map(re.escape, bpe.special)) + ")")
        self._reset()

    def _reset(self) -> None:
        self.codes = _Codes()
        self.ids = np.zeros(0, np.uint32)
        self.starts = np.zeros(0, np.int64)
        self.lengths = np.zeros(0, np.int64)

    def __call__(self, texts: list[str | None]) -> list[np.ndarray]:
        if len(self.codes) > REMEMBERED:
            self._reset()
        words: list[str] = []
        counts = []
        for text in texts:
            p = self.bpe.pieces(self.find, self.cut, text or "")
            words += p
            counts.append(len(p))
        codes = np.fromiter(map(self.codes.__getitem__, words), np.int64, len(words))
        if self.codes.new:
            self._learn()
        n = self.lengths[codes]
        total = int(n.sum())
        offset = np.repeat(self.starts[codes] - (np.cumsum(n) - n), n)
        flat = self.ids[offset + np.arange(total)] if total else np.zeros(0, np.uint32)
        cuts = np.r_[0, np.cumsum(n)][np.cumsum(counts)[:-1]] if len(counts) > 1 else []
        return np.split(flat, cuts)

    def _learn(self) -> None:
        new, special = self.codes.new, self.bpe.special
        plain = [w for w in new if w not in special]
        ids, counts = self.bpe.merge([w.encode() for w in plain]) if plain else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
        if len(plain) < len(new):
            parts = iter(np.split(ids, np.cumsum(counts)[:-1]) if plain else [])
            each = [np.array([special[w]], np.uint32) if w in special else next(parts) for w in new]
            ids, counts = np.concatenate(each), np.array([len(x) for x in each])
        self.starts = np.r_[self.starts, len(self.ids) + np.cumsum(counts) - counts]
        self.lengths = np.r_[self.lengths, counts]
        self.ids = np.r_[self.ids, ids]
        self.codes.new = []


def decoded_text(bpe: Bpe, ids: np.ndarray) -> bytes:
    """The text of ids, special tokens among them: the tokens' names, one space between them."""
    return b" ".join(map(bpe.tokens.__getitem__, ids.tolist()))


def encoded(docs: DataFrame, path: str, decode: bool = False) -> DataFrame:
    """`docs`, its text replaced by _ids: the token ids as little-endian unsigned 32-bit numbers.

    With `decode`, also _decoded: what these ids read as. Every text is taken whole; null counts as
    empty and gives no ids. One pass over the rows without a shuffle, in slices of a few megabytes;
    the tables of the vocabulary file, whose size is fixed, go to every worker.
    """
    spark = docs.sparkSession
    bpe = spark.sparkContext.broadcast(Bpe(path))
    inner, names = aside(docs, "text")
    inner = inner.drop(names["text"])
    rest = [f for f in inner.schema.fields if f.name != "text"]
    added = ["_ids", *(["_decoded"] if decode else [])]
    schema = T.StructType([*rest, T.StructField("_ids", T.BinaryType()), *([T.StructField("_decoded", T.StringType())] if decode else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _Encoder(bpe.value)
        for part in slices(batches, "text", 2 << 20):
            ids = encode(part.column("text").to_pylist())
            columns = [part.column(f.name) for f in rest]
            columns.append(pa.array([x.tobytes() for x in ids], pa.binary()))
            if decode:
                columns.append(pa.array([decoded_text(bpe.value, x).decode() for x in ids], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return inner.mapInArrow(run, schema).select(*restored_names(names, added, without=["text"]))


def word_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op1_bpe")
def op1(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encoded(docs, word_bpe(), decode=True).select(
        "doc_id",
        (F.octet_length("_ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("_ids", 256).alias("ids_sha256"),
        F.sha2(F.col("_decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
