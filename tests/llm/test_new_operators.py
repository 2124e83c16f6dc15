"""Exact dedup, centroid clustering and cross-tokenizer alignment against brute force."""

import hashlib
import math
import random
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
import sentencepiece

from tickloom.llm import op11_centroids, op12_align, op13_exact_dedup

ODD = [None, "", " ", "One", "oNE", "É", "é", "a b c", "a b c", "x" * 70_000, "X" * 70_000, "\x00ß"]
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def documents(spark, texts, ids=None):
    rows = [(i, t, "a", "b", 1, 2, "k") for i, t in zip(ids or range(len(texts)), texts, strict=True)]
    return spark.createDataFrame(rows, "doc_id long, text string, sha string, h string, n long, kind int, keep_id string")


def brute_copies(texts, ids):
    low = [(t or "").translate(AZ) for t in texts]
    rank = lambda i: (i is not None, i)
    top = {t: max((i for i, u in zip(ids, low, strict=True) if u == t), key=rank) for t in low}
    out, seen = [], set()
    for i, t in sorted(zip(ids, low, strict=True), key=str):
        kept = i == top[t] and (i, t) not in seen
        seen.add((i, t))
        out.append((i, top[t], low.count(t), kept, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize(("bucket", "buckets"), [(64 << 20, 8192), (40_000, 8192), (60_000, 4)])
def test_op13(spark, monkeypatch, bucket, buckets):
    """Also with tables so small that copies go on to further levels and to parts of the spill files."""
    monkeypatch.setattr(op13_exact_dedup, "BUCKET_BYTES", bucket)
    monkeypatch.setattr(op13_exact_dedup, "BUCKETS", buckets)
    r = random.Random(3)
    texts = ODD + ["hot text " * 5] * 60 + [r.choice("abAB") * r.randint(1, 6) for _ in range(60)]
    ids = [r.choice([None, *range(90)]) for _ in texts]
    docs = documents(spark, texts, ids).repartition(5)
    got = op13_exact_dedup.exact_dedup(docs).collect()
    assert sorted(map(tuple, got), key=str) == brute_copies(texts, ids)
    left = op13_exact_dedup.distinct_texts(docs).collect()
    assert sorted(x["text"] for x in left) == sorted({(t or "").translate(AZ) for t in texts}) and sum(x["n_copies"] for x in left) == len(texts)


def test_op13_empty(spark):
    assert op13_exact_dedup.exact_dedup(documents(spark, ["a"]).limit(0)).count() == 0


def test_op13_table_compares_contents():
    """Texts of one hash are kept apart; the largest id and its copies are counted."""
    t = op13_exact_dedup.OpenTable()
    for i in range(2000):
        assert t.put(7, str(i % 1000).encode(), b"", 1, i % 1000 if i % 3 else None, 1, 1e9)
    assert len(t.texts) == 1000 and set(t.copies) == {2}


def brute_clusters(rows, k=8, rounds=10):
    kept = [(i, [math.floor(Fraction(v) * 1024) for v in x]) for i, x in rows if x is not None and len(x) == 64 and all(v is not None and math.isfinite(v) for v in x)]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [x for _, x in first[:k]]

    def near(x):
        return min((sum((p - q) ** 2 for p, q in zip(x, c, strict=True)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        groups = [[] for _ in centroids]
        for _, x in kept:
            groups[near(x)[1]].append(x)
        centroids = [[sum(v) // len(g) for v in zip(*g, strict=True)] if g else c for g, c in zip(groups, centroids, strict=True)]
    found = [(i, *near(x)[::-1]) for i, x in kept]
    total = [sum(d for _, j, d in found if j == c) for c in range(len(centroids))]
    held = lambda v: v if v < 2**63 else None
    return sorted(((i, j, held(d), held(total[j]), held(sum(total)), hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest()) for i, j, d in found), key=str)


@pytest.mark.parametrize("size", [1.0, 3e4, 1e12])
def test_op11(spark, tmp_path, size):
    """Blocks within the bound, beyond it, and distances beyond a long; rows that take no part, ties and repeats."""
    rng = np.random.default_rng(5)
    x = (rng.normal(size=(60, 64)) * size).tolist()
    rows = [(i, v) for i, v in enumerate(x)] + [(3, x[3]), (None, x[4]), (100, None), (101, [1.0] * 63), (102, [float("nan")] * 64), (103, [1.0] * 63 + [None]), (104, [float("-inf")] * 64), (105, [0.0] * 64), (106, [0.0] * 64)]
    spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, label int, cluster int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = op11_centroids.op11_centroids(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=str) == brute_clusters(rows)


def test_op11_small_tables(spark, tmp_path):
    for n in (0, 3):
        frame = spark.createDataFrame([(i, [float(i)] * 64) for i in range(3)], "vec_id long, embedding array<float>").limit(n)
        assigned, centroids, inertia = op11_centroids.cluster(frame)
        assert assigned.count() == n and len(centroids) == n and sum(inertia) == 0


def test_op11_bound():
    """Near 2^53 the product in float64 would round: such blocks are told apart."""
    x = np.array([[2.0**26 + 1, 2.0**26], [2.0**26, 2.0**26 + 1]])
    assert op11_centroids.nearest(x, [[2**26, 2**26], [2**26 + 2, 2**26]])[1].tolist() == [1, 1]
    assert op11_centroids.nearest(x, [[2**26 + 1, 2**26]])[1].tolist() == [0, 2]


def brute_alignment(rows):
    from tokenizers import Tokenizer

    a_path, b_path = op12_align.default_tokenizers()
    one = Tokenizer.from_file(a_path)
    one.encode_special_tokens = True
    two = sentencepiece.SentencePieceProcessor(model_file=b_path)
    table = op12_align._byte_level()
    piece = {i: bytes(table[c] for c in p) for p, i in one.get_vocab(with_added_tokens=False).items() if i != 50256}
    per, docs = [], Counter()
    for i, text in rows:
        links, groups, a, b = Counter(), [], [], []
        if text:
            a, b = one.encode(" " + text, add_special_tokens=False).ids, two.encode(text)
            a_raw = [piece[t] for t in a]
            b_raw = [bytes([int(two.id_to_piece(t)[3:5], 16)]) if two.is_byte(t) else two.id_to_piece(t).replace("▁", " ").encode() for t in b]
            if not b"".join(a_raw) == b"".join(b_raw) == (" " + text).encode():
                a, b, a_raw, b_raw = [], [], [], []
            a_ends, b_ends = np.cumsum(list(map(len, a_raw))).tolist(), np.cumsum(list(map(len, b_raw))).tolist()
            low = 0
            for end in sorted({*a_ends} & {*b_ends}):
                inside = lambda ids, ends: [t for t, e in zip(ids, ends, strict=True) if low < e <= end]  # noqa: B023, E731
                groups.append((inside(a, a_ends), inside(b, b_ends)))
                low = end
        for p, q in groups:
            links.update((x, y) for x in p for y in q)
        docs.update(links.keys())
        said = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups)
        per.append((i, len(a), len(b), len(groups), links, hashlib.sha256(said.encode()).hexdigest() if a else ""))
    best = Counter()
    for (x, _), n in docs.items():
        best[x] = max(best[x], n)
    return sorted(((i, n_a, n_b, n, sum(c.values()), sum(m for p, m in c.items() if docs[p] == best[p[0]]), sum(m * docs[p] for p, m in c.items()), sha) for i, n_a, n_b, n, c, sha in per), key=str)


@pytest.mark.parametrize(("row_bytes", "short", "most"), [(8 << 20, 64, 10**6), (40, 1, 0)])
def test_op12(spark, monkeypatch, row_bytes, short, most):
    """Also with a text a row, every end counted by sorting, and counts joined by shuffles."""
    monkeypatch.setattr(op12_align, "ROW_BYTES", row_bytes)
    monkeypatch.setattr(op12_align, "SHORT", short)
    monkeypatch.setattr(op12_align, "BROADCAST_PAIRS", most)
    r = random.Random(8)
    parts = [" ", "  ", "\n", "\t", "é", "word", "Words'll", "<|endoftext|>", "</s>", "▁", "日本語の", "　", "\x00", "12345", "🙂", "antidis", "xxxxxxxx", ".", "\r\n", "\xa0", "\x1c"]
    texts = [None, "", " ", "   ", "a▁b", "The quick brown fox, the end.", "same words here", "same words here", "x" * 3000, "ab " * 2000, "日本" * 200]
    texts += ["".join(r.choice(parts) for _ in range(r.randint(1, 12))) for _ in range(150)]
    ids = [r.choice([None, *range(200)]) for _ in texts]
    docs = documents(spark, texts, ids).repartition(3)
    got, pairs = op12_align.alignment(docs)
    assert sorted(map(tuple, got.collect()), key=str) == brute_alignment(list(zip(ids, texts, strict=True)))
    found = pairs.collect()
    assert len({(x["a_id"], x["b_id"]) for x in found}) == len(found) and {x["a_id"] for x in found} == {x["a_id"] for x in found if x["best"]}
    assert op12_align.alignment(docs.limit(0))[0].count() == 0


def test_op12_pairs(spark):
    """A document has each linked pair once, with its number, and the documents of a pair are counted before Spark deals them."""
    texts = ["ab " * 2000, "ab " * 7, None, "", "x. ab"]
    rows = op12_align.tokenised(documents(spark, texts).coalesce(1), *op12_align.default_tokenizers(), "doc_id", "text").collect()
    for r in rows:
        assert len({x["pair"] for x in r["links"]}) == len(r["links"]) < 10 and sum(x["n"] for x in r["links"]) == r["n_links"]
    assert Counter({x["pair"]: x["n"] for r in rows for x in r["held"]}) == Counter(x["pair"] for r in rows for x in r["links"])
    assert sum(len(r["held"]) > 0 for r in rows) == 1 and max(r["n_links"] for r in rows) >= 2000


@pytest.mark.parametrize(("known", "long"), [(1 << 18, 32), (6, 32), (6, 0)])
def test_op12_known(monkeypatch, known, long):
    """Remembered words are not encoded again; what is forgotten, by number or length, comes out the same."""
    monkeypatch.setattr(op12_align, "KNOWN", known)
    monkeypatch.setattr(op12_align, "LONG", long)
    encoder = op12_align._encoder(*op12_align.default_tokenizers())
    asked, book, r = Counter(), op12_align.WordBook(encoder), random.Random(5)
    say = lambda b, i: (b.counts[:, i].tolist(), b.said[i], b.links[(n := b.counts[3])[:i].sum() : n[: i + 1].sum()].tolist())
    for _ in range(12):
        texts = [" ".join(r.choice(["the", "Fox,", "a\u2581b", "", "antidisestablishment.\nNot", "\u65e5\u672c\u8a9e", "x" * 40, "12 345\n", "\u3000"]) for _ in range(4)) for _ in range(3)]
        held = [book.numbers(t) for t in texts]
        asked.update(list(book.number)[len(book.said) :])
        book.learn()
        for text, numbers in zip(texts, held, strict=True):
            fresh = op12_align.WordBook(encoder)
            other = fresh.numbers(text)
            fresh.learn()
            assert [say(book, i) for i in numbers.tolist()] == [say(fresh, i) for i in other.tolist()]
        book.trim(np.concatenate(held))
        assert len(book.number) == len(book.said) == len(book.uses) <= known
    assert (max(asked.values()) == 1) == (known > 6)


@pytest.mark.parametrize("most", [1, 9, 1 << 16])
def test_op12_words(monkeypatch, most):
    """Words of random cuts, aligned in NumPy: all at once, several at a time, each by itself."""
    monkeypatch.setattr(op12_align, "SHORT", most)
    r = random.Random(4)
    sizes = [r.randint(1, 12) for _ in range(60)]
    cuts = [[[*sorted(r.sample(range(1, n), r.randint(0, n - 1))), n] for n in sizes] for _ in "ab"]
    ids = [[[r.randrange(500) for _ in ends] for ends in side] for side in cuts]
    flat = lambda side: np.array([x for word in side for x in word], np.int32)
    tokens = [x for side in (0, 1) for x in (np.array(list(map(len, cuts[side]))), flat(ids[side]), flat(cuts[side]))]
    groups, linked, links, texts = op12_align.aligned_words(*tokens, op12_align._table([b"%d," % i for i in range(500)]))
    want = []
    for a_ends, b_ends, a, b in zip(*cuts, *ids, strict=True):
        low, said, pairs = 0, "", []
        for end in sorted({*a_ends} & {*b_ends}):
            p, q = ([t for t, e in zip(x, ends, strict=True) if low < e <= end] for x, ends in ((a, a_ends), (b, b_ends)))
            said += ",".join(map(str, p)) + "|" + ",".join(map(str, q)) + ";"
            pairs += [x << 32 | y for x in p for y in q]
            low = end
        want.append((said.count(";"), pairs, said.encode()))
    held = np.split(links, np.cumsum(linked)[:-1])
    assert [(n, p.tolist(), s) for n, p, s in zip(groups.tolist(), held, texts, strict=True)] == want
