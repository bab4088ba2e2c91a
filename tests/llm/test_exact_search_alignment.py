"""Exact dedup, ranked search and token alignment against brute force."""

import hashlib
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from scoreloom.llm import alignment, exact, search
from tests.llm.conftest import ODD, prose, words

SPACE = re.compile(r"[\x20\x09-\x0D]")


def copies(seed: int) -> list[tuple]:
    rng = random.Random(seed)
    base = [prose(i, rng.randrange(1, 30)) for i in range(12)] + ["", "x"]
    rows = list(ODD)
    for i in range(100, 400):
        t = base[min(int(rng.expovariate(0.5)), len(base) - 1)]
        rows.append((i, rng.choice([t, t.replace(" ", "\n"), " " + t + "  ", t + " ", None if not t else t.upper()])))
    return rows + [(500, "z" * 300_000 + " " + "y"), (501, "z" * 300_000 + "y"), (None, "x"), (None, " x"), (100, rows[-1][1])]


def weak(content):
    """A digest under which many contents are alike."""
    return F.unhex(F.substring(F.sha2(content.cast("binary"), 256), 1, 2))


@pytest.mark.parametrize("digest", [exact.sha256, weak, lambda c: F.lit(b"1")])
@pytest.mark.parametrize("share", [1000, 3])
def test_exact_groups_equal_brute_force(spark, make, monkeypatch, digest, share):
    monkeypatch.setattr(exact, "HOT_SHARE", share)
    rows = copies(3)
    docs = make(rows).withColumns({"_kept": F.lit("clash"), "_digest": F.lit(1), "a.b": F.lit(2), "_salt": F.lit(3)})
    groups: dict[str, list] = {}
    for d, t in rows:
        groups.setdefault(SPACE.sub("", t or ""), []).append((-len(t or ""), d is None, d))
    want = Counter()
    for content, members in groups.items():
        best = min(members)
        for m in members:
            want[(m[2], best[2], len(members), hashlib.sha256(content.encode()).hexdigest() if digest is exact.sha256 else "")] += 1
    out = exact.exact_groups(docs, digest=digest)
    assert {"a.b", "_salt", "doc_id", "lang"} <= set(out.columns) and "text" not in out.columns
    found = out.collect()
    hexed = lambda r: r["_digest"].hex() if digest is exact.sha256 else ""
    assert Counter((r["doc_id"], r["_keep_id"], r["_group_size"], hexed(r)) for r in found) == want
    kept = [r for r in found if r["_kept"]]
    assert len(kept) == len(groups) and all(r["doc_id"] == r["_keep_id"] for r in kept)


def test_first_of_copies_keeps_rows_whole(spark, make):
    docs = make(copies(4)).withColumns({"_kept": F.lit("clash"), "a.b": F.lit(2)})
    out = exact.first_of_copies(docs)
    assert out.columns == docs.columns
    texts = [SPACE.sub("", r["text"] or "") for r in out.collect()]
    assert len(texts) == len(set(texts)) == len({SPACE.sub("", t or "") for _, t in copies(4)})
    assert exact.first_of_copies(docs.limit(0)).count() == 0


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def best_of(docs, items, k):
    fold = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    bags = [(d, Counter(TERM.findall(fold(t)))) for d, t in docs]
    sizes = [sum(b.values()) for _, b in bags]
    n, total = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        scored = []
        for (d, bag), size in zip(bags, sizes):
            s = 0
            for t in set(TERM.findall(fold(text))):
                if bag[t]:
                    m = 50 + (50 * size * n) // total
                    s += math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * bag[t]) // (1000 * bag[t] + 20 * m))
            if s > 0:
                scored.append((-s, d is None, d))
        scored.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(item, r, d, -s) for r, (s, _, d) in enumerate(scored[:k], 1)]
    return Counter(out)


@pytest.mark.parametrize("bucket,block", [(2_000_000, 8 << 20), (300, 400)])
def test_ranked_equals_brute_force(spark, make, monkeypatch, bucket, block):
    monkeypatch.setattr(search, "BUCKET", bucket)
    monkeypatch.setattr(search, "ITEM_BYTES", block)
    rng = random.Random(7)
    vocabulary = words(1, 150)
    text = lambda n: rng.choice(["", "\x00-"]).join([" ".join(rng.choices(vocabulary, range(150, 0, -1), k=n)), "Zz9"])
    rows = list(ODD) + [(i, text(rng.randrange(1, 80))) for i in range(100, 420)]
    rows += [(i, rows[40][1]) for i in range(600, 640)] + [(700, (prose(5, 40) + "-") * 3000)]
    items = [(i, text(rng.randrange(1, 25))) for i in range(14)] + [(3, "one"), (3, "one"), (None, "same row"), (20, None), (21, "  "), (22, "日本語")]
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    docs = make(rows).withColumns({"item_id": F.lit("clash"), "at": F.lit(2), "a.b": F.lit(2)})
    got = search.ranked(docs, asked, 10)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert Counter(tuple(r) for r in got.collect()) == best_of(rows, items, 10)
    assert search.ranked(docs.limit(0), asked, 10).count() == 0
    assert search.ranked(docs, asked.limit(0), 10).count() == 0


def test_terms_of_long_texts_are_whole():
    text = ("ab-" * 9 + "é" * 50 + " ") * 200 + "Q" * 5000
    assert [t for run in search.terms(text, 64) for t in run] == [t.lower().encode() for t in TERM.findall(text)]


@pytest.fixture(scope="module")
def paths():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def lined_up(texts, paths):
    """Per text: numbers of tokens and groups, links and groups as text; byte by byte."""
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(paths[0]), sentencepiece.SentencePieceProcessor(model_file=paths[1])
    a.encode_special_tokens = True
    back = {c: i for i, c in enumerate(alignment.byte_letters())}
    piece = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    out = []
    for text in texts:
        ids_a, ids_b = a.encode(" " + (text or ""), add_special_tokens=False).ids, b.encode(text or "")
        bytes_a = [bytes(back[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = [piece(i) for i in ids_b]
        if not text or b"".join(bytes_a) != (" " + text).encode() or b"".join(bytes_b) != (" " + text).encode():
            out.append((0, 0, 0, Counter(), ""))
            continue
        of_a = [i for i, x in enumerate(bytes_a) for _ in x]
        of_b = [i for i, x in enumerate(bytes_b) for _ in x]
        links = Counter((ids_a[i], ids_b[j]) for i, j in set(zip(of_a, of_b)))
        groups = [([], [])]
        for at, (i, j) in enumerate(zip(of_a, of_b)):
            if i not in groups[-1][0][-1:]:
                groups[-1][0].append(i)
            if j not in groups[-1][1][-1:]:
                groups[-1][1].append(j)
            if of_a[at + 1 : at + 2] != [i] and of_b[at + 1 : at + 2] != [j]:
                groups.append(([], []))
        told = ";".join(",".join(str(ids_a[i]) for i in g) + "|" + ",".join(str(ids_b[j]) for j in h) for g, h in groups[:-1])
        out.append((len(ids_a), len(ids_b), len(groups) - 1, links, hashlib.sha256(told.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("common", [1 << 20, 60, 0])
def test_alignment_equals_byte_by_byte(spark, make, monkeypatch, paths, common):
    monkeypatch.setattr(alignment, "COMMON", common)
    monkeypatch.setattr(alignment, "HELD", 500)
    rng = random.Random(2)
    pick = lambda: chr(rng.choice([rng.randrange(1, 127), rng.randrange(0x80, 0x530), rng.randrange(0x4E00, 0x4F00), 0x1F600]))
    rows = list(ODD) + [(i, prose(i % 25, 40) + ". The end of it, don't <|endoftext|> <s> ▁x") for i in range(100, 140)]
    rows += [(i, "".join(pick() for _ in range(rng.randrange(60)))) for i in range(200, 260)]
    rows += [(300, "a" * 20_000), (301, "  two  spaces\n\n"), (302, "x\x00y"), (303, "The cat sat on the mat. " * 700)]
    docs = make(rows).withColumns({"_row": F.lit("clash"), "_groups": F.lit(1), "pair": F.lit(1), "a.b": F.lit(2)})
    told = lined_up([t for _, t in rows], paths)
    count = Counter(p for x in told for p in x[3])
    most = Counter()
    for (a, _), n in count.items():
        most[a] = max(most[a], n)
    want = Counter(
        (d, n_a, n_b, n, sum(links.values()), sum(m for p, m in links.items() if count[p] == most[p[0]]), sum(m * count[p] for p, m in links.items()), digest)
        for (d, _), (n_a, n_b, n, links, digest) in zip(rows, told)
    )
    groups = alignment.token_groups(docs, *paths)
    assert {"_row", "pair", "a.b"} <= set(groups.columns)
    got = alignment.with_counts(groups.withColumn("digest", F.coalesce(F.sha2(F.col("_groups").cast("binary"), 256), F.lit(""))))
    columns = ["doc_id", "_n_a", "_n_b", "_n_groups", "_n_links", "_n_best", "_count_sum", "digest"]
    assert Counter(tuple(r) for r in got.select(*columns).collect()) == want
    assert alignment.with_counts(alignment.token_groups(docs.limit(0), *paths)).count() == 0


def test_diagonal_runs_cover_all_ends():
    rng = random.Random(9)
    for _ in range(300):
        last = rng.randrange(1, 400)
        a = sorted({*rng.sample(range(1, last + 1), rng.randrange(0, last)), last})
        b = sorted({*(a if rng.random() < 0.5 else []), *rng.sample(range(1, last + 1), rng.randrange(0, last) // 3), last})
        runs, of_a, of_b = alignment.aligned(a, b)
        assert sum(abs(n) for *_, n in runs) == len(set(a) & set(b))
        links = {(i + k, j + k) for i, j, n in runs if n > 0 for k in range(n)} | set(zip(of_a, of_b))
        byte = lambda ends: [i for i, e in enumerate(ends) for _ in range(e - ([0, *ends])[i])]
        assert links == set(zip(byte(a), byte(b)))
        assert len(links) == len(a) + len(b) - len(set(a) & set(b))
