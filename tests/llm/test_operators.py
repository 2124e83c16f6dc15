"""Training-data operators against brute force, round trips and edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tickloom.llm import html_blocks, op1_html, op3_suffix_dedup, op4_mix, op5_ann, op6_quality, op7_simhash, op8_decontaminate, op9_tokens, op10_toxicity
from tickloom.llm.common import written
from tickloom.llm.components import connected_components
from tickloom.llm.html_training import labelled_pages
from tickloom.llm.op2_line_dedup import line_dedup
from tickloom.llm.suffixes import repeated_starts

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, source string, score double, fp string, size long, _shard string"


def docs_of(spark, texts, ids=None, sources=None):
    """Documents with extra columns whose names the operators use themselves."""
    n = len(texts)
    rows = [(i, t, s, 0.5, "x", 1, "y") for i, t, s in zip(ids or range(n), texts, sources or ["a"] * n, strict=True)]
    return spark.createDataFrame(rows, SCHEMA)


ODD = [None, "", " ", "one", "a b c d e f", "a b c d e f", "x" * 50_000, "w " * 20_000, "\x00é\n\n\n\nß", "l1\nl2\nl3\nl4", "l0\nl1\nl2\nl3\nl5"]


def brute_strings(texts, width):
    seen, out = Counter(), []
    raw = [(t or "").encode() for t in texts]
    for b in raw:
        seen.update(b[i : i + width] for i in range(len(b) - width + 1))
    for b in raw:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - width + 1):
            if seen[b[i : i + width]] > 1:
                gone[i : i + width] = True
        runs = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out.append((len(b), int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()))
    return out


def test_suffix_arrays():
    r = random.Random(2)
    for _ in range(60):
        depth, letters = r.choice((3, 6)), r.choice((b"ab", b"abcde", b"\x00a\xc3"))
        blocks = [bytes(r.choice(letters) for _ in range(r.randint(0, 30))) for _ in range(r.randint(0, 7))]
        seen = Counter(b[i : i + depth] for b in blocks for i in range(len(b) - depth + 1))
        assert [g.tolist() for g in repeated_starts(blocks, depth)] == [[seen[b[i : i + depth]] > 1 for i in range(max(0, len(b) - depth + 1))] for b in blocks]


@pytest.mark.parametrize("crowd", [512, 1])
def test_op3(spark, monkeypatch, crowd):
    monkeypatch.setattr(op3_suffix_dedup, "CROWD", crowd)
    r = random.Random(4)
    words = ["".join(r.choice("abcdeé") for _ in range(r.randint(2, 7))) for _ in range(400)]
    passage = " ".join(r.choice(words) for _ in range(60))
    texts = ODD + [" ".join(r.choice(words) for _ in range(r.randint(0, 80))) + passage[: r.randint(150, 300)] + " ".join(r.choice(words) for _ in range(40)) for _ in range(12)]
    texts[6], texts[7] = "x" * 700, "w " * 500
    got = op3_suffix_dedup.suffix_dedup(docs_of(spark, texts)).drop("text").collect()
    assert [tuple(x)[1:] for x in sorted(got)] == brute_strings(texts, 200)
    assert op3_suffix_dedup.suffix_dedup(docs_of(spark, ["a"]).limit(0)).count() == 0


def test_op3_sorts_no_copies(monkeypatch):
    """Cores whose blocks all occur more than once hit everywhere without a suffix array; others go in whole."""
    given = []
    monkeypatch.setattr(op3_suffix_dedup, "repeated_starts", lambda blocks, width: given.extend(blocks) or repeated_starts(blocks, width))
    blocks = [(1, b"abcdefgh", 2), (2, b"xabcd", 3), (2, b"yabcd", 2), (3, b"pqrstu", 2), (3, b"qrstuv", 1), (3, b"zzzzab", 1)]
    core, data, n = zip(*blocks, strict=True)
    batch = pa.RecordBatch.from_arrays([pa.array(core), pa.array(range(6)), pa.array(range(6)), pa.array(data), pa.array(n)], names=["core", "h1", "h2", "bytes", "n"])
    (out,) = op3_suffix_dedup._sorted_hits(4)(iter([batch]))
    masks = {h: format(m[0], "08b") for h, m in zip(out.column(0).to_pylist(), out.column(2).to_pylist(), strict=True)}
    assert given == [b"pqrstu", b"qrstuv", b"zzzzab"]
    assert masks == {0: "11111000", 1: "11000000", 2: "11000000", 3: "11100000", 4: "11000000"}


def test_op3_anchors():
    """Runs against the least gram of each string, one by one; texts too short for any lie between."""
    r = random.Random(9)
    for sizes in ([0, 3, 39, 40, 41, 200, 1, 90, 39], [39], [40], [0, 0], [300, 40, 40]):
        raw = [bytes(r.choice(b"ab") for _ in range(n)) for n in sizes]
        doc, data = np.cumsum([0, *sizes]), np.frombuffer(b"".join(raw), np.uint8)
        hashes = op3_suffix_dedup.Rolling(data).each(op3_suffix_dedup.GRAM) if len(data) >= 40 else []
        want = []
        for i, n in enumerate(sizes):
            for at in range(doc[i], doc[i] + n - 39):
                place = min(range(at, at + 9), key=lambda p: (int(hashes[p]) >> 32, p))
                if want and want[-1][0] == i and want[-1][3] == place:
                    want[-1][2] = at
                else:
                    want.append([i, at, at, place, int(hashes[place])])
        assert list(map(list, zip(*(x.tolist() for x in op3_suffix_dedup.anchors(data, doc, 40)), strict=True))) == want


def test_op2(spark):
    got = sorted(line_dedup(docs_of(spark, ODD)).collect())
    by = {x["doc_id"]: x for x in got}
    assert len(got) == len(ODD) and by[0]["text"] == "" and by[0]["n_lines"] == 1
    assert by[10]["text"] == "l0\nl5" and (by[10]["n_removed"], by[10]["n_spans"]) == (3, 1)
    assert by[8]["n_removed"] == 0 and by[9]["n_removed"] == 0
    same = line_dedup(docs_of(spark, ["a\na\na\na\na"], [None])).first()
    assert same["text"] == "" or same["n_removed"] > 0
    assert line_dedup(docs_of(spark, ["a"]).limit(0)).count() == 0


def test_op4(spark):
    r = random.Random(1)
    texts = ODD + ["w " * r.randint(1, 60) for _ in range(300)]
    texts[7] = "w " * 90
    sources = [r.choice(["b", "a", "é", None]) for _ in texts]
    plan = op4_mix.mix_plan(docs_of(spark, texts, sources=sources)).collect()
    again = op4_mix.mix_plan(docs_of(spark, texts, sources=sources).repartition(7)).collect()
    assert sorted(map(str, plan)) == sorted(map(str, again)) and sum(x["n_rows"] for x in plan) == len(texts)
    for s in {"a", "b", "é", None}:
        rows = [x for x in plan if x["source"] == s]
        taken = sum(x["size"] * x["copies"] * x["n_rows"] for x in rows)
        # First fit leaves less than the smallest unit left out, or half of that if taken.
        skipped = [x["size"] * x["n_rows"] for x in rows if x["copies"] == min(y["copies"] for y in rows)]
        assert abs(taken - rows[0]["target"]) <= min(skipped) / 2 + 1 and all(0 <= x["copies"] <= 3 and len(x["shards"]) == x["copies"] for x in rows)
    assert op4_mix.share_out([1, 2, 3], [100, 100, 100]) == pytest.approx([50, 100, 150])
    assert op4_mix.share_out([1, 2, 3], [10, 10, 400]) == pytest.approx([30, 30, 360])
    mixed = op4_mix.mix(docs_of(spark, texts, sources=sources), shards=4).collect()
    assert len(mixed) == sum(x["copies"] * x["n_rows"] for x in plan) and {x["_shard"] for x in mixed} == {0, 1, 2, 3}
    assert op4_mix.mix(docs_of(spark, ["a"]).limit(0)).count() == 0
    assert op4_mix.mix_plan(docs_of(spark, ["a"]).limit(0)).count() == 0


@pytest.mark.parametrize("shards", [1, 7, 3000])
def test_op4_tree(spark, shards):
    """Units are drawn once each; every shard has its exact share; reruns agree."""
    quotas = [1000, 0, 1, 350]
    rows = op4_mix.tree_leaves(spark, quotas, shards, 3).collect()
    drawn = Counter((r["k"], u) for r in rows for u in range(r["lo"], r["hi"]))
    assert drawn == Counter({(k, u): 1 for k, q in enumerate(quotas) for u in range(q)})
    size = Counter()
    for r in rows:
        size[r["shard"]] += r["hi"] - r["lo"]
    assert max(size.values()) - min(size.get(i, 0) for i in range(shards)) <= 2
    assert sorted(rows) == sorted(op4_mix.tree_leaves(spark, quotas, shards, 3).collect())


def test_op4_defaults(spark):
    """With the production constants: at least 16 shards, at least 8 blocks a source, draws that add
    up to each source's target, none beyond three copies, reruns alike."""
    rows = op4_mix.op4_mix(spark, "/root/testdata/sf0.01").collect()
    again = op4_mix.op4_mix(spark, "/root/testdata/sf0.01").collect()
    assert sorted(map(str, rows)) == sorted(map(str, again)) and len(rows) == 1000
    assert {s for r in rows for s in r["shards"]} == set(range(16)) and all(len(r["shards"]) <= 3 and r["taken"] == r["size"] * len(r["shards"]) for r in rows)
    for target, size in {(r["target"], r["source_size"]) for r in rows}:
        own = [r for r in rows if (r["target"], r["source_size"]) == (target, size)]
        assert abs(sum(r["taken"] for r in own) - target) < 0.01 * target and len({s for r in own for s in r["shards"]}) >= 3
    words = Counter()
    for r in rows:
        words.update({s: r["size"] for s in r["shards"]})
    assert max(words.values()) < 4 * sum(words.values()) / 16


def test_op4_draws_make_what_is_taken(spark, monkeypatch):
    """Small blocks, a hot source, repeated ids and rows: shards of the written mix against the plan."""
    monkeypatch.setattr(op4_mix, "BLOCK_DOCS", 8)
    r = random.Random(6)
    texts = ["w " * r.randint(0, 40) for _ in range(400)]
    ids = [5 if i % 10 == 0 else i for i in range(400)]
    docs = docs_of(spark, texts, ids, ["hot" if i % 3 else r.choice(["b", "c", None]) for i in range(400)])
    plan = op4_mix.mix_plan(docs, shards=9).collect()
    mixed = Counter((x["doc_id"], x["source"], len(x["text"].split()), x["_shard"]) for x in op4_mix.mix(docs, shards=9).collect())
    want = Counter()
    for x in plan:
        for s in x["shards"]:
            want[x["doc_id"], x["source"], x["size"], s] += x["n_rows"]
    assert mixed == want and sum(x["n_rows"] for x in plan) == 400
    for s in {x["source"] for x in plan}:
        rows = [x for x in plan if x["source"] == s]
        assert abs(sum(x["size"] * x["copies"] * x["n_rows"] for x in rows) - rows[0]["target"]) <= 40


def test_op5(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 16)).astype(np.float32)
    rows = [(i, v.tolist(), "q") for i, v in enumerate(x)] + [(600 + i, x[3].tolist(), "q") for i in range(40)]
    rows += [(700, None, "q"), (701, [0.0] * 16, "q"), (702, [float("nan")] * 16, "q"), (703, [1.0] + [None] * 15, "q"), (None, x[1].tolist(), "q"), (704, [1.0], "q")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank string")
    got = op5_ann.ann_search(df, df.where("vec_id % 50 = 0")).collect()
    ids = np.array([r[0] for r in rows[:640]])
    unit = np.array([r[1] for r in rows[:640]], np.float64)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    hit = 0
    asked = [i for i in ids if i % 50 == 0]
    for q in asked:
        s = unit @ unit[q]
        s[q] = -9
        want = set(ids[np.lexsort((ids, -np.round(s, 12)))[:5]])
        mine = sorted((g for g in got if g["query_id"] == q), key=lambda g: g["rank"])
        assert [g["rank"] for g in mine] == [1, 2, 3, 4, 5] and all(g["score"] == pytest.approx(s[g["vec_id"]]) for g in mine)
        hit += len(want & {g["vec_id"] for g in mine})
    assert {g["query_id"] for g in got} == set(asked) and hit >= 0.9 * 5 * len(asked)
    assert op5_ann.ann_search(df.limit(0), df).count() == 0
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (1, [0.0, 1.0]), (2, [2.0, 0.1]), (0, [1.0, 0.0])], "vec_id long, embedding array<double>")
    got = op5_ann.ann_search(few, few.where("vec_id = 0")).orderBy("rank").collect()
    assert [(g["rank"], g["vec_id"]) for g in got] == [(1, 2), (2, 1)] and got[1]["score"] == pytest.approx(0.5**0.5)


@pytest.mark.parametrize("n, cells", [(60_000, None), (8_000, 500)])
def test_op5_recall_with_more_cells_than_probes(spark, tmp_path, n, cells):
    """Without clusters a fixed number of cells loses true neighbours as the table grows."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    x = np.random.default_rng(5).normal(size=(n, 48)).astype(np.float32)
    vectors = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), 48).cast(pa.list_(pa.float32()))
    pq.write_table(pa.table({"vec_id": pa.array(np.arange(n)), "embedding": vectors}), tmp_path / "x.parquet", row_group_size=n // 8)
    df = spark.read.parquet(str(tmp_path / "x.parquet"))
    more = {} if cells is None else {"cells": cells}
    got = op5_ann.ann_search(df, df.where(f"vec_id % {n // 200} = 0"), **more).toPandas()
    unit = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    asked = np.arange(0, n, n // 200)
    score = unit[asked] @ unit.T
    score[np.arange(len(asked)), asked] = -9
    want = {q: set(np.argpartition(-s, 5)[:5]) for q, s in zip(asked, score, strict=True)}
    assert len(got) == 5 * len(asked)
    assert sum(v in want[q] for q, v in zip(got["query_id"], got["vec_id"], strict=True)) >= 0.95 * 5 * len(asked)


def test_op7(spark):
    texts = ODD + ["a b c d e f g h i j k l m n o p"] * 3
    got = {x["doc_id"]: x for x in op7_simhash.simhash_groups(docs_of(spark, texts)).collect()}
    fps = [op7_simhash.fingerprint((t or "").encode()) for t in texts]
    root = list(range(len(fps)))
    for _ in fps:
        for i, a in enumerate(fps):
            for j, b in enumerate(fps):
                if (a ^ b).bit_count() <= 2:
                    root[i] = root[j] = min(root[i], root[j])
    assert [got[i]["component_id"] for i in range(len(fps))] == root
    assert [got[i]["fp"] % 2**64 for i in range(len(fps))] == fps and fps[0] == 0
    kept = op7_simhash.simhash_dedup(docs_of(spark, [*texts, "z", "z"], [*range(len(texts)), None, 5]))
    assert kept.where("doc_id is null").count() == 0 and kept.where("text = 'z'").count() == 1 and kept.columns == docs_of(spark, ["a"]).columns
    far = ["alpha beta gamma delta", "one two three four five", "red green blue"]
    assert op7_simhash.simhash_dedup(docs_of(spark, far, [1, 1, 2])).count() == 3
    assert op7_simhash.simhash_dedup(docs_of(spark, far[:1] * 4, [1, 1, None, None])).count() == 1
    assert op7_simhash.simhash_groups(docs_of(spark, ["a"]).limit(0)).count() == 0


def plain_fingerprint(text):
    """The SimHash by its definition, one bit and one shingle at a time."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", low) if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64(x.encode(), seed=42).intdigest() for x in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def test_fingerprints_by_definition(spark):
    texts = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()] + ODD + ["A\x0bB\x0cC d", "é É Ü", "a\xa0b c d"]
    assert [op7_simhash.fingerprint((t or "").encode()) for t in texts] == [plain_fingerprint(t) for t in texts]


@pytest.mark.parametrize("crowded", [64, 3, 0])
def test_links_and_components(spark, crowded):
    r = random.Random(3)
    base = [r.getrandbits(64) for _ in range(12)]
    fps = sorted({b ^ m for b in base for m in [0, *(1 << r.randrange(64) | 1 << r.randrange(64) for _ in range(6))]})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    edges = op7_simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), crowded=crowded)
    got = {x["node"]: x["root"] for x in connected_components(edges).collect()}
    root = {f: f for f in signed}
    for _ in signed:
        for a in signed:
            for b in signed:
                if ((a ^ b) & (2**64 - 1)).bit_count() <= 2:
                    root[a] = root[b] = min(root[a], root[b])
    assert {f: got.get(f, f) for f in signed} == root
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)], "u long, v long")
    assert {x["root"] for x in connected_components(chain).collect()} == {0}


@pytest.mark.parametrize("crowded", [64, 3])
@pytest.mark.parametrize("most", [200_000, 0])
def test_links_broadcast_no_exploded_rows(spark, monkeypatch, crowded, most):
    """A few KB of fingerprints lie far below Spark's threshold; their probes must not go through
    the driver all the same. Crowded segment values do up to `most` only; links stay the same."""
    monkeypatch.setattr(op7_simhash, "BROADCAST", most)
    r = random.Random(5)
    base = [r.getrandbits(63) for _ in range(40)]
    fps = sorted({b ^ m for b in base for m in [0, *(1 << r.randrange(30) for _ in range(5))]})
    edges = op7_simhash.links(written(spark.createDataFrame([(f,) for f in fps], "fp long"), "fps"), crowded=crowded)
    got = {x["node"]: x["root"] for x in connected_components(edges).collect()}
    assert [got[f] for f in fps] == [min(b for b in fps if (b ^ f) >> 30 == 0) for f in fps]
    plan = edges._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan
    for part in plan.split("BroadcastExchange")[1:]:
        below = part.split("Scan parquet")[0]
        assert crowded == 3 and most and "Generate" not in below and "Exchange" not in below


def test_op8(spark):
    item = "The quick brown fox jumps over the lazy dog and runs"
    bench = spark.createDataFrame([(1, item), (2, "Übung macht"), (3, None), (4, "..."), (None, "secret phrase"), (10, item)], "item_id long, text string")
    texts = ["x " + item.upper().replace(" ", "--") + " y", "übung Macht! Übung-macht", "quick brown fox", None, "secret phrase"]
    got = {x["doc_id"]: x for x in op8_decontaminate.decontaminate(docs_of(spark, texts), bench).collect()}
    assert (got[0]["n_words"], got[0]["n_hit"], got[0]["items"]) == (13, 11, ["1", "10"])
    assert (got[1]["n_hit"], got[1]["items"]) == (2, ["2"])
    assert not got[2]["contaminated"] and got[3]["n_words"] == 0 and got[4]["n_hit"] == 2 and got[4]["items"] == []
    parts = op8_decontaminate.decontaminate(docs_of(spark, texts), bench, part_words=3)
    assert sorted(map(str, parts.collect())) == sorted(map(str, got.values()))
    for words in (2_000_000, 3):
        spans = op8_decontaminate.decontaminate(docs_of(spark, texts), bench, mode="spans", part_words=words).orderBy("doc_id").collect()
        assert spans[0]["text"] == "x  y" and spans[3]["text"] is None and len(spans) == len(texts)
        clean = op8_decontaminate.decontaminate(docs_of(spark, texts), bench, mode="documents", part_words=words)
        assert clean.count() == sum(not x["contaminated"] for x in got.values()) and clean.columns == docs_of(spark, ["a"]).columns
    again = docs_of(spark, [texts[0]] * 3 + [texts[2]], [0, 0, None, 0])
    assert sorted(r["n_hit"] for r in op8_decontaminate.decontaminate(again, bench, part_words=3).collect()) == [0, 11, 11, 11]
    assert op8_decontaminate.decontaminate(again.limit(0), bench).count() == 0
    assert op8_decontaminate.decontaminate(docs_of(spark, texts), bench, mode="documents").count() == sum(not x["contaminated"] for x in got.values())
    assert op8_decontaminate.decontaminate(docs_of(spark, texts), bench.limit(0)).where("contaminated").count() == 0


def test_op9(spark):
    from tokenizers import Tokenizer

    texts = ODD + ["Hello  world's 12 été　漢字 <|endoftext|> ok\n\n x", "a b\x1c c\x85d  ", "don't  stop"]
    ids = [*range(50, 50 + len(texts) - 2), None, -7]
    got = op9_tokens.token_table(docs_of(spark, texts, ids)).collect()
    t, start = Tokenizer.from_file(op9_tokens.default_tokenizer()), 0
    by = {x["doc_id"]: x for x in got}
    for i in sorted(ids, key=lambda i: (i is not None, i or 0)):
        want = np.array([*t.encode(texts[ids.index(i)] or "", add_special_tokens=False).ids, 0], "<u4")
        row = by[i]
        assert row["ids"] == want.tolist() and row["start"] == start
        assert (row["n_tokens"], row["ids_crc32"]) == (len(want), zlib.crc32(want.tobytes()))
        start += len(want)
    assert op9_tokens.token_table(docs_of(spark, ["a"]).limit(0)).count() == 0


def test_op9_pieces_against_the_library(monkeypatch):
    r, e = random.Random(5), op9_tokens.Encoder(op9_tokens.default_tokenizer())
    marks = [*"ab Z19'sdmtlvre \n\t  é\x85\xa0ß.,!-_²½'' \x1c\x1fÀ", "'ll", "'ve", "'re", " '", "  ", "\r\n", "漢", "<|endoftext|>"]
    texts = ["".join(r.choices(marks, [9] * (len(marks) - 2) + [1, 1], k=r.randint(0, 60))) for _ in range(4000)]
    want = [np.array(x.ids, e.kind).tobytes() for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]
    for size in (4 << 20, 40):
        monkeypatch.setattr(op9_tokens, "SLICE_BYTES", size)
        assert [v for i in range(0, len(texts), 50) for v in e.encode([t.encode() for t in texts[i : i + 50]])] == want
    monkeypatch.setattr(op9_tokens, "REMEMBERED", 100)
    assert e.encode([t.encode() for t in texts[:500]]) == want[:500]


def test_op9_repeated_ids(spark, tmp_path):
    got = op9_tokens.token_table(docs_of(spark, ["a b", "c", "a b", "d e f"], [3, 3, 3, 1])).collect()
    assert sorted(r["doc_id"] for r in got) == [1, 3, 3, 3] and sorted(r["start"] for r in got)[0] == 0
    assert sum(r["n_tokens"] for r in got) == max(r["start"] + r["n_tokens"] for r in got)


def test_sstable(tmp_path):
    from tickloom.llm.sstable import Reader, Writer

    with open(tmp_path / "x.sst", "wb") as f:
        w = Writer(f, block_bytes=200)
        keys = sorted([*range(-500, 500, 3), 7, 7])
        for k in [None, *keys]:
            w.add(k, np.full(5, abs(k or 0), "<u2").tobytes())
        w.close()
    with open(tmp_path / "x.sst", "rb") as f:
        r = Reader(f)
        assert [k for k, _ in r.scan()] == [None, *keys] and len(r.index) > 10
        assert len(r.get(7)) == 2 + (7 in range(-500, 500, 3)) and r.get(8) == [] and r.get(-500)[0].tolist() == [500] * 5
        assert sum(r.might_hold(k) for k in range(10_000, 20_000)) < 500


def scored(spark, query, label, base, held):
    t = query.join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert (t["held_out"] == [zlib.crc32(str(i).encode()) % base == held for i in t["doc_id"]]).all()
    assert t["score"].between(0, 1).all()
    return (t["predicted"] == t[label]).mean()


def test_op6_held_out(spark):
    assert scored(spark, op6_quality.op6_quality(spark, "/root/testdata/sf0.01"), "quality", 4, 2) > 0.93
    model = op6_quality.QualityModel([b"good text here " * 9] * 20, [b"$$$ bad %%% " * 9] * 20)
    model.calibrate(np.array([0.2, 0.1, -0.1, -0.2]), np.array([1, 1, 0, 0]))
    got = op6_quality.score_quality(docs_of(spark, ODD), model).collect()
    assert len(got) == len(ODD) and got[0]["score"] == got[1]["score"]


def test_op6_calibration(spark):
    """Held-out scores mean what they say: mean gap of score and label over tenths of the scale."""
    sf = "/root/testdata/sf0.1"
    rows = op6_quality.op6_quality(spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").select("score", "quality").collect()
    x, y = np.array([r["score"] for r in rows]), np.array([r["quality"] for r in rows])
    tenth = np.minimum((x * 10).astype(int), 9)
    gap = sum(abs(x[tenth == b].mean() - y[tenth == b].mean()) * (tenth == b).mean() for b in set(tenth))
    assert len(x) > 500 and gap < 0.04 and abs(x.mean() - y.mean()) < 0.03


def test_op10_held_out(spark):
    assert scored(spark, op10_toxicity.op10_toxicity(spark, "/root/testdata/sf0.01"), "toxic", 5, 0) > 0.93
    r = random.Random(0)
    plain = [" ".join("".join(r.choice("aeionrst") for _ in range(r.randint(2, 8))) for _ in range(30)) for _ in range(200)]
    bad = ["blockhead", "numbskull"]
    texts = [p + " " + bad[i % 2] if i % 2 or i % 4 == 0 else p for i, p in enumerate(plain)]
    model = op10_toxicity.train(texts, [int(any(b in t for b in bad)) for t in texts])
    score = lambda t: model.score(model.value(t))
    assert min(map(score, ("you blo.ckhead", "a b l o c k h e a d", "numb-skull there", "bl0ckhead"))) > 0.5 > score("an honest note") and score("") < 0.5
    assert op10_toxicity.score_toxicity(docs_of(spark, ODD), model).count() == len(ODD)


def test_fits_of_odd_tables(spark):
    """No labels, null labels, nulls and clashing names: constant or usable models, every row scored."""
    docs = docs_of(spark, ODD).withColumn("_side", F.lit(7)).withColumn("predicted", F.lit("p"))
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    some = spark.createDataFrame([(i, i % 2, i % 2) for i in range(len(ODD))] + [(None, None, None), (3, 1, 1), (3, 1, 1)], none.schema)
    for labels in (none, some):
        for got in (
            op6_quality.score_quality(docs, op6_quality.fit_quality(docs, labels)),
            op10_toxicity.score_toxicity(docs, op10_toxicity.fit_toxicity(docs, labels)),
        ):
            assert len(set(got.columns)) == len(got.columns)
            rows = got.collect()
            assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 and r["predicted"] in (0, 1) for r in rows)
    assert op10_toxicity.score_toxicity(docs.limit(0), op10_toxicity.fit_toxicity(docs.limit(0), some)).count() == 0
    assert op6_quality.score_quality(docs.limit(0), op6_quality.fit_quality(docs.limit(0), some)).count() == 0


def test_op10_text_values_do_not_depend_on_the_batch(spark):
    bad = ["blarg", "zonk"]
    texts = ["plain words of prose", "you are a blarg", "some other line", "what a zonk", "nothing here", "blarg zonk"] * 5
    model = op10_toxicity.train(texts, [int(any(b in t for b in bad)) for t in texts])
    together = model.text_values(ODD[1:] + texts)
    model.memory.clear()
    assert together == [model.value(t) for t in ODD[1:] + texts]
    phi = op10_toxicity.Words(["blarg", "b1arg", "b-l-arg", "q", "1"])
    columns = np.arange(op10_toxicity.K**3)
    weights = np.random.default_rng(1).normal(size=len(columns))
    assert np.allclose(phi.dense(columns) @ weights, phi.dot(weights), atol=1e-4)


def test_op1(spark):
    field, right, total = op1_html.fit_field(), 0, 0
    for html, labels in labelled_pages(60, 77):
        found = html_blocks.blocks(html)
        want = op1_html.align(found, labels)
        right += sum(a == b for a, b in zip(field.decode(found), want, strict=True))
        total += len(want)
    assert right / total > 0.98
    html = "<html><head><title>t</title><style>p{}</style></head><body><nav><a href=x>Home</a></nav><article><h1>Big  &amp; small</h1><p><b>One<br>two &lt;3<p>Three four five six seven.</article><div class=comments><p>Nice article, I liked it a lot.</div><footer>&copy; x</footer><script>var a='</p>'"
    rows = spark.createDataFrame([(1, "u", html, "c"), (2, "u", None, "c"), (3, "u", "", "c"), (4, "u", "<" * 5000 + "<p>" * 3000, "c")], "page_id long, url string, html string, text string")
    got = {x["page_id"]: x for x in op1_html.extract(rows).collect()}
    assert got[1]["text"] == "Big & small\n\nOne two <3\n\nThree four five six seven." and got[1]["n_chars"] == len(got[1]["text"])
    assert got[2]["text"] == "" and got[3]["n_chars"] == 0


def test_op1_unclosed_heads():
    texts = lambda html: [b.text for b in html_blocks.blocks(html)]
    assert texts("<html><head><title>t</title><meta x=1><link y><style>p{}</style><p>One<p>Two") == ["One", "Two"]
    assert texts("<head><title>t</title>\n<script>1</script>\nBare text<p>One") == ["Bare text", "One"]
    assert texts("<head><title>t</title><b>Bold</b> text") == ["Bold text"]
    assert texts("<html><head><title>t</title></head><body><p>One<head><p>Two") == ["One", "Two"]
    assert texts("<html>\n<head>\n<title>t</title>\n</head>\n<body>One") == ["One"]


def test_op1_digits_of_the_whole_block():
    late = html_blocks.Block("word " * 50 + "1234567 " * 60, (), 0, 0)
    digits = [f for f in op1_html.text_features(late, 0.5, 5) if f.startswith("digits:")]
    plain = [f for f in op1_html.text_features(late._replace(text="word " * 146), 0.5, 5) if f.startswith("digits:")]
    assert len(digits) == 1 and digits != plain


def test_pipeline_against_steps(spark):
    import corpus_pipeline as p

    docs, out = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), {}
    for name, stage in p.STAGES:
        before, docs = docs, written(stage(spark, docs, "/root/testdata/sf0.01"), name)
        out[name] = (before, docs)
    fps = [(r["doc_id"], op7_simhash.fingerprint(r["text"].encode())) for r in out["near_duplicates"][0].collect()]
    root = {i: i for i, _ in fps}
    pairs = [(a, b) for n, (a, x) in enumerate(fps) for b, y in fps[:n] if (x ^ y).bit_count() <= 2]
    for _ in range(20):
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    assert {r["doc_id"] for r in out["near_duplicates"][1].collect()} == set(root.values())
    rows = lambda name, side: out[name][side].collect()
    # quality: the scores' decision, by the operator's own model on each text alone.
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = op6_quality.fit_quality(out["quality"][0], labels)
    good = {r["doc_id"] for r in rows("quality", 0) if model.score((r["text"] or "").encode()) >= 0.7}
    assert {r["doc_id"] for r in rows("quality", 1)} == good and 0.7 < len(good) / len(rows("quality", 0)) < 0.95
    # decontaminate: a plain set of windows.
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    windows = set()
    for r in spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").collect():
        w = cut(r["text"])
        windows |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))} if w else set()
    sizes = {len(w) for w in windows}
    hit = lambda w: any(tuple(w[i : i + n]) in windows for n in sizes for i in range(len(w) - n + 1))
    assert {r["doc_id"] for r in rows("decontaminate", 1)} == {r["doc_id"] for r in rows("decontaminate", 0) if not hit(cut(r["text"]))}
    # mix: words by source near the targets, at most three copies, nothing but whole rows.
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    before, after = {r["doc_id"]: r for r in rows("mix", 0)}, rows("mix", 1)
    assert all(before[r["doc_id"]] == r for r in after) and max(Counter(r["doc_id"] for r in after).values()) <= 3
    have, took = Counter(), Counter()
    for r in before.values():
        have[r["source"]] += size(r["text"])
    for r in after:
        took[r["source"]] += size(r["text"])
    names = sorted(have, key=lambda x: (x is None, (x or "").encode()))
    target, left, free = {}, sum(have.values()), dict(zip(names, (1 + i % 3 for i in range(len(names))), strict=True))
    while free:
        share = {x: left * w / sum(free.values()) for x, w in free.items()}
        over = [x for x in free if share[x] > 3 * have[x]]
        target |= {x: 3 * have[x] for x in over} if over else share
        left -= sum(3 * have[x] for x in over)
        free = {x: w for x, w in free.items() if over and x not in over}
    assert all(took[x] == pytest.approx(target[x], abs=300) for x in names)
    # tokens: the library's ids, in ascending id order.
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(op9_tokens.default_tokenizer())
    coded = {r["doc_id"]: np.array([*t.encode(r["text"] or "", add_special_tokens=False).ids, 0], "<u4") for r in before.values()}
    start = 0
    for r in sorted(rows("tokens", 1), key=lambda r: r["start"]):
        ids = coded[r["doc_id"]]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert Counter(r["doc_id"] for r in rows("tokens", 1)) == Counter(r["doc_id"] for r in after)


def test_pipeline_of_odd_tables(spark, tmp_path):
    """Nulls, repeats, empty and long texts, further columns; an empty table."""
    import corpus_pipeline as p

    docs = docs_of(spark, [*ODD, None], [*range(len(ODD)), None]).withColumn("lang", F.lit("en")).withColumn("n_chars", F.length("text").cast("long")).withColumn("_order", F.lit(1))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))
    for before in (docs, docs.limit(0)):
        for name, stage in p.STAGES:
            after = stage(spark, before, str(tmp_path))
            assert after.columns == (["doc_id", "start", "n_tokens", "ids_crc32"] if name == "tokens" else p.COLUMNS)
            assert after.count() <= 3 * before.count()
