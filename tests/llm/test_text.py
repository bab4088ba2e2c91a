"""BPE, substring dedup and the n-gram join against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from scoreloom.llm import bpe, ngram_join, substring
from tests.llm.conftest import ODD, prose, words


def test_bpe_equals_the_library(spark, make):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(bpe.word_bpe())
    rng = random.Random(1)
    pick = lambda: chr(rng.choice([rng.randrange(1, 127), rng.randrange(0x80, 0x530), rng.randrange(0x4E00, 0x4F00)]))
    texts = ["".join(pick() for _ in range(rng.randrange(80))) for _ in range(150)]
    texts += [t for _, t in ODD] + ["a" * 3000, "ΑΣ ΣΑΣ İ don't WE'LL 123½", "x<|startoftext|>Y", "é ﬁ ǅ"]
    docs = make([(i, t) for i, t in enumerate(texts)]).withColumn("ids", F.lit("clash"))
    got = {r["doc_id"]: r for r in bpe.encoded(docs, bpe.word_bpe(), decode=True).collect()}
    for i, t in enumerate(texts):
        ids = lib.encode(t or "", add_special_tokens=False).ids
        assert np.frombuffer(got[i]["_ids"], "<u4").tolist() == ids
        assert got[i]["_decoded"] == lib.decode(ids, skip_special_tokens=False)
    assert bpe.encoded(docs.limit(0), bpe.word_bpe()).count() == 0


def cut(rows, window):
    seen, out = {}, {}
    order = sorted({(r[0] if r[0] is not None else 1 << 62, r[1]) for r in rows}, key=lambda r: (r[0], r[1] or ""))
    for d, t in order:
        w = (t or "").encode().split()
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            seen[k] = min(seen.get(k, (d, i)), (d, i))
    for d, t in order:
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] < (d, i):
                gone[i : i + window] = [True] * window
        out[d, t] = b" ".join(x for x, g in zip(w, gone) if not g).decode()
    return out


@pytest.mark.parametrize("hot", [50_000, 2])
def test_substrings_equal_brute_force(spark, make, monkeypatch, hot):
    monkeypatch.setattr(substring, "HOT", hot)
    rng = random.Random(5)
    passages = [words(900 + i, 70) for i in range(3)]
    rows = list(ODD)
    for i in range(20, 60):
        body = words(i % 30, rng.randrange(1, 120))
        at = rng.randrange(len(body) + 1)
        rows.append((i, " ".join(body[:at] + passages[i % 3][rng.randrange(30) :] + body[at:])))
    rows += [(70, "a " * 90), (71, "b a " * 60), (72, prose(1, 30) + "\n" + prose(1, 30)), (73, prose(77, 25) + " Uno")]
    docs = make(rows).withColumn("dk", F.lit(1)).withColumn("spans", F.lit("clash"))
    got = substring.without_repeats(docs, 20).collect()
    want = cut(rows, 20)
    assert len(got) == len(rows)
    texts = sorted((r["doc_id"] if r["doc_id"] is not None else 1 << 62, r["_kept"]) for r in got)
    assert texts == sorted((r[0] if r[0] is not None else 1 << 62, want[r[0] if r[0] is not None else 1 << 62, r[1]]) for r in rows)
    assert all(r["_n_words"] - r["_n_removed"] == len(r["_kept"].encode().split()) for r in got)
    assert sum(r["_n_removed"] for r in got) > 1000
    out = substring.cut_documents(make([(1, prose(2, 60)), (2, prose(2, 60)), (3, "keeps  its\nblanks")]), 50)
    assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in out.collect()} == {1: (prose(2, 60), len(prose(2, 60))), 2: ("", 0), 3: ("keeps  its\nblanks", 17)}
    assert substring.without_repeats(docs.limit(0)).count() == 0


def test_fm_index_counts_every_pattern():
    rng = np.random.default_rng(0)
    text = np.r_[rng.integers(1, 5, 60), 0, rng.integers(1, 5, 60), 0]
    index = substring.FmIndex(text, 5, 4)
    place, group = index.matches(text, np.array([0, 61]), np.array([60, 60]))
    for p, g in zip(place, group):
        pattern = text[p : p + 4]
        count = sum((text[i : i + 4] == pattern).all() for i in range(len(text) - 3))
        assert index.high[g] - index.low[g] == count
    assert len(place) == 2 * 57


def groups(rows, n, percent):
    ids = [(r[0] if r[0] is not None else ngram_join.LAST) for r in rows]
    sets = []
    for r in rows:
        w = (r[1] or "").encode().lower().split()
        sets.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    low = list(ids)
    for _ in rows:
        for i in range(len(rows)):
            for j in range(len(rows)):
                both = len(sets[i] & sets[j])
                if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                    low[i] = low[j] = min(low[i], low[j])
    return sorted((i, len(s), c) for i, s, c in zip(ids, sets, low))


@pytest.mark.parametrize("long_list", [32, 3])
def test_groups_equal_brute_force(spark, make, monkeypatch, long_list):
    monkeypatch.setattr(ngram_join, "LIST", long_list)
    monkeypatch.setattr(ngram_join, "MEMBERS", 4)
    monkeypatch.setattr(ngram_join, "PROBES", 4)
    monkeypatch.setattr(ngram_join, "CELL", 8)
    rng = random.Random(2)
    rows = [r for r in ODD if r[0] != 11]
    for i in range(100, 150):
        w = words(i % 4, 80)
        for _ in range(rng.randrange(5)):
            w[rng.randrange(80)] = f"edit{rng.random()}"
        rows.append((i, " ".join(w)))
    rows += [(200, "A b C"), (201, "a B c"), (202, "a b c d"), (203, prose(1, 80).upper())]
    got = ngram_join.near_groups(make(rows), 4, 85).collect()
    assert sorted((r["dk"], r["size"], r["component"]) for r in got) == groups(rows, 4, 85)
    assert len({r["component"] for r in got if 100 <= r["dk"] < 150}) < 40
    kept = ngram_join.one_of_each(make(rows).withColumn("size", F.lit("clash")), 4, 85)
    assert "size" in kept.columns
    want = {(i, c) for i, _, c in groups(rows, 4, 85)}
    assert {r["doc_id"] for r in kept.collect()} - {None} == {i for i, c in want if i == c and i != ngram_join.LAST}
    assert ngram_join.near_groups(make(rows).limit(0), 4, 85).count() == 0


def test_no_link_into_a_large_group_is_lost(spark):
    """Groups of many members, mixed needs, and pairs at the threshold: 184 of 216 shingles, and more of any size."""
    rng, percent = random.Random(8), 85
    sets, target = {}, {}

    def add(group, shingles):
        sets[len(sets)] = sorted(shingles)
        target[len(target)] = group

    for k in range(60):
        start = 10_000 * k
        n = rng.choice([20, 40, 200])
        core = set(range(start + 2000, start + 2000 + n))
        apart = next(e for e in range(n, -1, -1) if 100 * (n - e) >= percent * (n + e))  # the pair is at the threshold
        rare = sorted(core)[:apart] if k % 3 else rng.sample(sorted(core), apart)
        add(2 * k, core)
        add(2 * k + 1, (core - set(rare)) | set(rng.sample(range(start, start + 2000), apart)))  # what it has alone comes first
        for _ in range(8):  # members that have some of the first common shingles
            some = {c for c in sorted(core)[apart : apart + 12] if rng.random() < 0.4}
            add(2 * k + 1, some | set(rng.sample(range(start + 5000, start + 8000), n - len(some))))
    example = set(range(-184, 0))
    add(200, set(range(-900, -884)) | example)
    add(201, set(range(-800, -784)) | example)
    add(201, {-183, *range(1, 200)})
    needs = {i: rng.randrange(1, 9) for i in sets}
    needs |= {len(sets) - 3: 2, len(sets) - 2: 2, len(sets) - 1: 1}
    rows = []
    for i, s in sets.items():
        length = len(s) - -(-percent * len(s) // 100) + needs[i]
        group = [k for k in sets if target[k] == target[i]]
        rows += [(x, i, len(s), needs[i], p, target[i], len(group), min(needs[k] for k in group)) for p, x in enumerate(s[:length])]
    placed = spark.createDataFrame(rows, "token long, node long, size int, need int, place int, target long, count long, group_need int")
    got = {(r["node"], r["target"]) for r in ngram_join.candidates(placed, percent).collect()}
    links, lost = 0, []
    for i in sets:
        for j in range(i + 1, min(i + 12, len(sets))):
            a, b = set(sets[i]), set(sets[j])
            if target[i] != target[j] and 100 * len(a & b) >= percent * len(a | b):
                links += 1
                if (i, target[j]) not in got and (j, target[i]) not in got:
                    lost.append((i, j))
    assert links > 50
    assert not lost


def test_rows_without_ids_are_told_apart(spark, make):
    """Near copies go row by row, with clean rows beside them that have no id or the same one."""
    near = lambda k, i: prose(300 + k, 120) + f" end{i}"
    clean = [(None, prose(400 + i, 60)) for i in range(12)] + [(5, prose(420, 60)), (6, prose(421, 60))]
    rows = clean + [(1, near(0, 0)), (None, near(0, 1)), (5, near(0, 2)), (6, near(1, 0)), (6, near(1, 1))]
    rows += [(None, near(2, i)) for i in range(5)] + [(None, near(3, 0)), (None, near(3, 0).upper()), (None, None), (8, " ")]
    got = [(r["doc_id"], r["text"]) for r in ngram_join.one_of_each(make(rows), 5, 80).collect()]
    assert {*clean, (1, near(0, 0)), (None, None), (8, " ")} <= {*got}
    kept = lambda k: [(d, t) for d, t in got if t and t.lower().startswith(prose(300 + k, 120))]
    assert kept(0) == [(1, near(0, 0))]
    assert [d for d, _ in kept(1)] == [6]
    assert [d for d, _ in kept(2)] == [None]
    assert [d for d, _ in kept(3)] == [None]
    assert len(got) == len(clean) + 6
