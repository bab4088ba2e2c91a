"""Embeddings, quality rules, toxicity, language model and the pipeline."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from scoreloom.llm import embeddings, lm, quality, toxicity
from tests.llm.conftest import ODD, prose, words


def test_vectors_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "SMALL", 16)
    rng = np.random.default_rng(0)
    base = rng.normal(size=(8, 40))
    x = np.concatenate([base[rng.integers(0, 8, 90)] + rng.normal(size=(90, 40)) * s for s in (0.1, 0.5)])
    x[5] = x[6]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(500, None), (501, [0.0] * 40), (502, [float("nan")] + [1.0] * 39), (503, [None] + [1.0] * 39), (504, []), (505, [1.0, 2.0]), (506, [2.0, 4.0]), (507, [1e200, 0.0]), (508, [-1e-200, 0.0])]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = (u @ u.T >= 0.9) & ~np.eye(len(u), dtype=bool)
    low = np.arange(len(u))
    for _ in u:
        low = np.array([min([low[i], *low[near[i]]]) for i in range(len(u))])
    assert [got[i] for i in range(len(u))] == [(int(n), int(c)) for n, c in zip(near.sum(1), low)]
    assert near.sum() > 500
    assert all(got[i] == (0, i) for i in (500, 501, 502, 503, 504, 507, 508))
    assert got[505] == (1, 505) and got[506] == (1, 505)
    assert embeddings.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def counts(text):
    w = (text or "").replace("\r", " ").encode().split()
    eights = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    twice = {k for k, n in Counter(eights).items() if n > 1}
    again = {i + k for i, e in enumerate(eights) if e in twice for k in range(8)}
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    return (
        len(w), sum(len(x.decode()) for x in w), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(again),
        len(w) < 20 or 100 * len(again) > 30 * len(w),
    )


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def test_quality_counts_and_verdicts(spark, make):
    rows = [(*r, "en", "a") for r in ODD]
    rows += [(i, prose(i, 60), "en", "a") for i in range(100, 300)]
    rows += [(i, prose(i, 60).replace(" ", "$$$ "), "en", "a") for i in range(400, 410)]
    rows += [(i, prose(i, 60).upper(), "en", "a") for i in range(410, 420)]
    rows += [(500, prose(1, 12) + "\n" + prose(1, 12) + "\n" + prose(2, 90), None, None), (501, "x y\n" * 3 + prose(9, 50) + " é|ü <b>", "en", None)]
    docs = make(rows)
    got = quality.judged(docs.withColumn("f0", F.lit("clash")).drop("f0"), ["doc_id", "text"]).collect()
    assert len(got) == len(rows)
    for r in got:
        assert tuple(r[c] for c in NAMES) == counts(r["text"])
        assert not (r["base_failed"] and r["kept"])
    kept = {r["doc_id"] for r in got if r["kept"]}
    assert set(range(100, 300)) <= kept and not kept & set(range(400, 420))
    assert {500, 501} <= kept  # groups too small for an estimate
    out = quality.kept_documents(docs.withColumn("distance", F.lit(1)))
    assert out.columns == [*docs.columns, "distance"] and {r["doc_id"] for r in out.collect()} == kept
    assert quality.judged(docs.limit(0), ["doc_id"]).count() == 0


def test_moderate_outliers_are_rejected(spark, make):
    """The cut is a chi-square quantile, not a gap seen in some table: a symbol at every fifth word is too many."""
    assert quality.chi_square(6.6257, 5) == pytest.approx(0.75, abs=1e-4) and quality.CUT == pytest.approx(20.515, abs=1e-3)
    rows = [(i, prose(i, 60), "en", "a") for i in range(100, 300)]
    odd = [(i, "# ".join(" ".join(words(i, 60)[k : k + 5]) for k in range(0, 60, 5)), "en", "a") for i in range(400, 410)]
    kept = {r["doc_id"] for r in quality.judged(make(rows + odd), ["doc_id"]).where("kept").collect()}
    assert kept == set(range(100, 300))
    stage = dict(corpus_pipeline.STAGES)["quality_rules"]
    assert {r["doc_id"] for r in stage(spark, make(rows + odd), "").collect()} == kept


def test_estimates_equal_concentration_steps(spark):
    """Mean and covariance of the nearest share, step by step, in numpy."""
    rng = np.random.default_rng(3)
    x = np.round(rng.normal([1.6, 0, 0.2, 0, 0], [0.05, 0.02, 0.04, 0.03, 0.02], (400, 5)) * quality.GRID).astype(int)
    x[:60] += 4000
    rows = spark.createDataFrame([("g", *map(int, v)) for v in x], "_group string, f0 long, f1 long, f2 long, f3 long, f4 long")
    estimate = quality._start(rows)
    floors = np.diag(np.array(list(quality.STATISTICS.values())) ** 2)
    q = np.quantile(x, [0.25, 0.5, 0.75], axis=0) / quality.GRID
    mean, cov = q[1], np.diag(np.maximum((q[2] - q[0]) / 1.349, np.sqrt(np.diag(floors))) ** 2)
    for _ in range(3):
        measured = quality._measured(rows, estimate)
        d = x / quality.GRID - mean
        d2 = np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d)
        got = np.array([r["_d2"] for r in measured.collect()])
        assert np.sort(got) == pytest.approx(np.sort(d2), rel=1e-6)
        bins = np.floor(np.log(d2 + 1e-9) * 64)
        near = x[bins <= np.sort(bins)[int(np.ceil(0.75 * len(x))) - 1]] / quality.GRID
        mean, cov = near.mean(0), np.cov(near.T) + floors
        cut = quality._rank_cut(measured, 0.75)
        estimate = quality._estimate(measured.join(cut, "_group").where("_bin <= _cut"))


def test_restoring_reads_through_noise():
    texts = {"idiot": 40, "worthless": 30, "stupid": 30, "the": 300, "there": 60, "loser": 30, "other": 50, "sing": 20}
    model = np.zeros((32, 32, 32))
    for w, n in texts.items():
        codes = [0, 0, *toxicity.letter_codes(w), 0]
        for a, b, c in zip(codes, codes[1:], codes[2:]):
            model[a, b, c] += n
    low = model.sum(0) + 0.1
    low /= low.sum(1, keepdims=True)
    log = np.log((model + 2 * low[None]) / (model.sum(2, keepdims=True) + 2))
    for noisy, word in {"1d10t": "idiot", "w0rthl3$$": "worthless", "st-u-p.id": "stupid", "looooser": "loser", "iidiiot": "idiot", "the": "the"}.items():
        assert toxicity.restored(noisy, log) == word
    assert toxicity.joined_letters(b"you i d i o t there".split()) == [b"you", b"idiot", b"there"]
    assert toxicity.joined_letters(b"a b there a".split()) == [b"a", b"b", b"there", b"a"]


def test_toxicity_on_held_out_texts(spark, make):
    rows, labels = [], []
    insults = ["idiot", "scumbag", "worthless", "moronic"]
    for i in range(900):
        w = words(i, 40)
        toxic = i % 4 == 0
        if toxic:
            for k in range(3):
                w.insert((i * 7 + k * 11) % 40, insults[(i // 4 + k) % 4])
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    rows += [(2000, "all the 1d10t w0rthless ones and the rest of it"), (2001, "all of the i d i o t and sc-um-bag ones"), *[(3000 + i, t) for i, (_, t) in enumerate(ODD)]]
    table = spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id long, toxic int")
    docs = make(rows).select("doc_id", "text", F.lit("clash").alias("toxic"))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    got = {r["doc_id"]: r["_score"] for r in toxicity.toxic_scores(docs, table, ~held).collect()}
    assert len(got) == len(rows)
    test = [(got[i], t) for i, t in labels if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum((s >= 0.7) == bool(t) for s, t in test) >= 0.97 * len(test)
    assert got[2000] > 0.7 and got[2001] > 0.7 and got[3001] < 0.3
    none = toxicity.toxic_scores(docs.limit(3), table.limit(0), ~held)
    assert all(0 <= r["_score"] < 0.5 for r in none.collect())
    assert toxicity.toxic_scores(docs.limit(0), table, ~held).count() == 0


def test_language_model_keeps_single_pairs_in_blocks(spark, monkeypatch):
    """Blocks and buckets give each token what the table of all pairs gives; pairs met once are no rows."""
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice("abcdefgh") + rng.choice("xyz") * rng.randrange(3) for _ in range(rng.randrange(40)))) for i in range(60)]
    docs = spark.createDataFrame([*rows, (60, None), (61, "ax unheard")], "doc_id long, text string").repartition(5)
    held = F.col("doc_id") % 7 == 5
    pairs = lm.language_model(docs.select("text", held.alias("held")))[1].pairs.collect()
    score = {r["key"]: (r["score"], r["spelled"]) for r in pairs}
    monkeypatch.setattr(lm, "BUCKET", 100)
    for r in lm.lm_scores(docs.withColumn("copy", F.col("text")), held).collect():
        _, u, w = lm._token_pairs([r["copy"]])
        found = np.array([score[k] for k in lm._pair_key(u, w).view(np.int64).tolist()]).sum(0)
        assert [r["_score"], r["_spelled"]] == pytest.approx(found.tolist()) and r["_n_tokens"] == len(w)
    u, w = (np.array(x, np.uint64) for x in ([1, 1, 2], [2, 3, 3]))
    one = np.array([1], np.int32).tobytes()
    sent = {"bucket": [0, 0], "block": [4, 5], "u": [u.tobytes(), u[:1].tobytes()], "w": [w.tobytes(), w[:1].tobytes()]}
    sent |= {"c": [np.array([1, 1, 0], np.int32).tobytes(), one], "n": [np.array([1, 1, 1], np.int32).tobytes(), one]}
    met = lm._met(pa.table(sent)).to_pylist()
    assert [np.frombuffer(r["at"], np.int32).tolist() for r in met[:2]] == [[0, -1, -2], [0]]
    assert len(met[2]["u"]) == 8 and np.frombuffer(met[2]["c"], np.int64).tolist() == [2] and (met[2]["ones"], met[2]["twos"]) == (1, 1)


def test_blocks_send_pairs_packed_and_heavy_words_apart():
    """Every pair is counted once in one bucket, for a few bytes; a word before half of all pairs lies in many buckets."""
    rng = np.random.default_rng(2)
    names = [f"w{i}" for i in range(3000)]
    sent, pairs, size = [], Counter(), 0
    for block in range(3):
        ids = np.minimum(rng.geometric(0.002, 20_000), 2999)
        ids[::2] = 1
        ids[-1] = 0
        train = bool(block)
        known = [b"", *(x.encode() for x in names[1:])]
        row = {"block": block, "spelt": zlib.compress(b"\n".join(known)), "ids": lm._squeezed(ids.astype(np.int32))}
        row |= {"train": lm._squeezed(np.array([train])), "tokens": lm._squeezed(np.array([len(ids)], np.int32))}
        words_ = lm._words_of(row)
        assert words_.tolist() == lm._hashed(known).view(np.uint64).tolist()
        layout = lm.Layout(16, 3, words_[1:2], np.array([64], np.uint64))
        out = next(lm._sent(layout)(iter([pa.RecordBatch.from_pylist([row])]))).to_pylist()
        mine = Counter(zip(words_[np.r_[0, ids[:-1]]].tolist(), words_[ids].tolist()))
        size += sum(len(r["h"]) + len(r["pairs"]) for r in out)
        pairs.update({k: np.array([n * train, n]) for k, n in mine.items()})
        sent += out
    of_heavy = []
    for bucket in range(16):
        rows = [r for r in sent if r["bucket"] == bucket]
        met = lm._gathered(layout)(pa.Table.from_pylist(rows)).to_pylist()
        again = next(r for r in met if r["block"] == -1)
        heads, u, w, c = lm._often(pa.Table.from_pylist([again]))
        found = dict(zip(zip(heads[u].tolist(), heads[w].tolist()), c.tolist()))
        of_heavy.append(sum(k[0] == words_[1] for k in found))
        for k, n in found.items():
            assert pairs.pop(k)[0] == n
    assert all(c < 2 for c, _ in pairs.values())  # the rest is met once in training at most
    assert max(of_heavy) < 0.2 * sum(of_heavy)
    assert size < 16 * sum(r["pairs"] is not None and lm._unpacked(r["pairs"], np.int32).size // 4 for r in sent)  # 24 bytes before


def test_language_model(spark, make):
    rows = [(i, prose(i % 60, 50) + (f" rare{i}" if i % 3 else "")) for i in range(1000, 1200)] + ODD
    docs = make(rows).withColumn("held", F.lit("clash")).withColumn("dk", F.lit(1))
    got = lm.lm_scores(docs, F.coalesce(F.col("doc_id") % 10 == 0, F.lit(False))).collect()
    assert len(got) == len(rows)
    train = Counter()
    for d, t in rows:
        if d is None or d % 10:
            train.update([*(t or "").encode().lower().split(), b""])
    n, v = sum(train.values()), len(train)
    want = {}
    for d, t in rows:
        w = [*(t or "").encode().lower().split(), b""]
        want[d, t] = (len(w), sum(x in train for x in w), sum(math.log10((train[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w))
    by = {r["doc_id"]: r for r in got}
    for d, t in rows:
        if d is not None:
            r = by[d]
            assert (r["_n_tokens"], r["_n_known"]) == want[d, t][:2] and r["_base"] == pytest.approx(want[d, t][2]) and r["_train_tokens"] == n
            assert r["_score"] < 0
    held = [r for r in got if r["_held"]]
    assert sum(r["_score"] for r in held) > sum(r["_base"] for r in held)
    assert lm.lm_scores(docs.limit(0), F.lit(False)).count() == 0
    assert all(r["_base"] == 0 for r in lm.lm_scores(docs.limit(2), F.lit(True)).collect())


def test_words_are_scored_after_the_word_before(spark, make):
    """In every context the probabilities of all words and of an unseen one sum to one; order counts."""
    rng = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(8)]
    rows = [(i, " ".join(vocabulary[int(k) % 8] for k in np.cumsum(rng.integers(1, 3, 30)))) for i in range(80)]
    every = [*vocabulary, "never"]
    held = [(100, " ".join(f"{a} {b}" for a in every for b in every)), *[(101 + i, w) for i, w in enumerate(every)], (120, None)]
    docs = make(rows + held).select("text", (F.col("doc_id") >= 100).alias("held"))
    p = {r["key"]: 10 ** r["score"] for r in lm.language_model(docs)[1].pairs.collect()}
    codes = lm._hashed([*(w.encode() for w in every), lm.END]).view(np.uint64)
    for u in codes:
        assert sum(p[int(lm._pair_key(np.full(1, u), np.full(1, w)).view(np.int64)[0])] for w in codes) == pytest.approx(1.0, abs=1e-6)
    straight = " ".join(vocabulary * 2)
    docs = make([*rows, (100, straight), (101, " ".join(reversed(straight.split())))])
    got = {r["doc_id"]: r for r in lm.lm_scores(docs, F.col("doc_id") >= 100).collect()}
    assert got[100]["_base"] == pytest.approx(got[101]["_base"]) and got[100]["_score"] > got[101]["_score"] + 5


def test_word_probabilities_sum_to_one(spark, make):
    docs = make([(i, prose(i, 30)) for i in range(80)]).select("text", (F.col("doc_id") % 5 == 0).alias("held"))
    words_, totals = lm.language_model(docs)
    seen = words_.where("c > 0").agg(F.sum(F.pow(10.0, "log10p"))).first()[0]
    unseen = words_.where("c = 0").agg(F.max("log10p")).first()[0]
    assert totals.tables >= totals.types
    assert seen + 10**unseen == pytest.approx(1.0, abs=1e-6)


def test_reseating_keeps_customers():
    rng = np.random.default_rng(0)
    for _ in range(300):
        sizes = rng.integers(1, 9, rng.integers(0, 5)).tolist()
        c = int(rng.integers(1, 30))
        out = lm.reseat(sizes, c, 0.5, 0.6, rng.random(2 * min(8, c)).tolist())
        assert sum(out) == c and all(s > 0 for s in out)


def test_pipeline_stages(spark, sf, make):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "ngram_jaccard_join", "substring_dedup", "source_mix", "bpe"]
    passage = prose(999, 60)
    rows = [(i, prose(i, 80) + "\n" + prose(i + 5000, 40), "en", f"s{i % 3}") for i in range(100, 220)]
    rows += [(300, prose(100, 80) + "\n" + prose(5100, 39) + " other", "en", "s0"), (301, prose(101, 80).replace(" ", "### "), "en", "s0"), (302, "few words", "en", "s0")]
    rows += [(303 + i, prose(700 + i, 70) + " " + passage + " " + prose(800 + i, 70), "en", "s1") for i in range(3)]
    docs = make(rows)
    steps = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf).cache()
        steps[name] = docs.collect()
        if name != "bpe":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert {r["doc_id"] for r in steps["quality_rules"]} == {r[0] for r in rows} - {301, 302}
    assert {r["doc_id"] for r in steps["ngram_jaccard_join"]} == {r[0] for r in rows} - {300, 301, 302}
    texts = {r["doc_id"]: r["text"] for r in steps["substring_dedup"]}
    assert passage in texts[303] and passage not in texts[304] and passage not in texts[305]
    assert texts[100] == rows[0][1]
    mixed = Counter(r["doc_id"] for r in steps["source_mix"])
    assert set(mixed) <= set(texts) and max(mixed.values()) <= 2
    assert Counter(r["doc_id"] for r in steps["bpe"]) == mixed and all(len(r["ids"]) == 4 * r["n_tokens"] for r in steps["bpe"])
    empty = make([])
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, sf)
    assert empty.count() == 0


def test_every_customer_is_seated_anew():
    """Table numbers follow a**t * S(c, t): by the recursion, by seating one by one, and for frequent dishes."""
    for d in (0.1, 0.6, 0.9):
        for a in (1e-6, 0.02, 3.0, 400.0, 1e5):
            for c in (200, lm.STIRLING):
                logs = lm._log_stirling(d)[c, 1:] + np.log(a) * np.arange(1, lm.STIRLING + 1)
                want = np.exp(logs - logs.max())
                first, p = lm.table_law(c, a, d)
                assert 1 <= first <= c
                assert np.abs((want / want.sum())[first - 1 : first - 1 + len(p)] - p).sum() < 1e-6
    rng = np.random.default_rng(4)
    sizes, seen = [40], []
    for _ in range(1500):
        sizes = lm.reseat(sizes, 40, 0.5, 0.6, rng.random(2 * 40).tolist())
        seen.append(len(sizes))
    drawn = lm.tables_drawn(np.full(4000, 40), np.full(4000, 0.5), 0.6, rng.random(4000))
    assert abs(np.mean(seen) - drawn.mean()) < 0.3
    often = lm.tables_drawn(np.array([1_000_000]), np.array([200.0]), 0.6, np.array([0.5]))[0]
    assert 250 < often < 400  # the mean is near a / d; one table and 8 moves in each of 4 sweeps gave 33 at most
    assert lm.tables_drawn(np.array([0, 1]), np.ones(2), 0.6, np.ones(2) / 2).tolist() == [0, 1]
    assert lm.tables_drawn(np.array([2, 300, 100_000]), np.zeros(3), 0.95, np.ones(3) / 2).tolist() == [1, 1, 1]
