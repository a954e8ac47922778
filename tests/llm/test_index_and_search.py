"""Exact dedup over the extendible index, vector codes, ranked search: against brute force."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitefeed.llm import extendible_hash, lexical_search, vector_codes

# Exact dedup ----------------------------------------------------------------


def norm(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def brute_exact(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append(i)
    out = []
    for text, ids in groups.items():
        ids.sort(key=lambda i: (i is None, i))
        for k, i in enumerate(ids):
            out.append((i, ids[0], len(ids), k == 0, hashlib.sha256(text.encode()).hexdigest()))
    return out


def sorted_rows(rows):
    return sorted(map(tuple, rows), key=repr)


@pytest.fixture
def copies(prose):
    r, rows = random.Random(3), []
    for i in range(400):
        text = prose(r.randint(0, 12), r.randint(0, 120))
        rows.append((i, text.replace(" ", r.choice([" ", "  ", "\t", "\n\r"]))))
    rows += [(1000 + i, "hot text") for i in range(200)]
    rows += [(5, rows[5][1]), (5, rows[5][1]), (None, "hot  text"), (None, "lone"), (None, "lone"), (2000, None), (2001, ""), (2002, " "), (2003, "x " * 40_000)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("capacity,bits", [(4096, 63), (16, 63), (1, 63), (4, 5), (4096, 0), (1, 2)])
def test_exact_dedup_equals_brute_force_at_any_depth_and_with_collisions(documents, copies, capacity, bits):
    got = extendible_hash.exact_duplicates(documents(copies), capacity, bits)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted_rows(got.collect()) == sorted_rows(brute_exact(copies))


def test_directory_doubles_until_buckets_fit(spark):
    keys = spark.range(3000).select(F.shiftrightunsigned(F.xxhash64("id"), 1).alias("key"))
    depth, directory = extendible_hash.grow_directory(keys, capacity=50)
    rows = directory.collect()
    assert sorted(r.pointer for r in rows) == list(range(1 << depth))
    buckets = Counter()
    owner = {r.pointer: r.bucket for r in rows}
    for r in keys.collect():
        buckets[owner[r.key >> (63 - depth)]] += 1
    assert max(buckets.values()) <= 50 and sum(buckets.values()) == 3000
    # A bucket of a lesser depth has as many pointers as the directory is deeper.
    pointers = Counter(r.bucket for r in rows)
    assert all(pointers[r.bucket] == 1 << (depth - r.depth) for r in rows)
    assert len({r.depth for r in rows}) > 1


def test_a_chain_holds_every_text_of_a_key(spark, documents):
    rows = [(i, f"text {i % 7}") for i in range(70)]
    table = documents(rows).select("doc_id", "text")
    keyed = table.select("doc_id", extendible_hash.hash_key(extendible_hash.normalised("text"), 0).alias("key"))
    index, chained = extendible_hash.build_index(table, keyed.withColumn("row", F.monotonically_increasing_id()), bits=0)
    entries = index.entries.orderBy("chain").collect()
    assert [(e.chain, e.keep_id, e.group_size) for e in entries] == [(i, i, 10) for i in range(7)]
    assert chained.count() == 70 and extendible_hash.look_up_chained(chained, index).count() == 70


def test_exact_dedup_of_nothing(documents):
    assert extendible_hash.exact_duplicates(documents([])).count() == 0


# Vector codes ---------------------------------------------------------------


def brute_codes(rows, rounds=2):
    def bad(v):
        return v is None or any(x is None or not math.isfinite(x) for x in v)

    rows = sorted((r for r in rows if not bad(r[1])), key=lambda r: (r[0] is None, r[0], list(r[1])))
    size = max([len(r[1]) for r in rows], default=0)
    width = -(-size // 16)
    parts = []
    for _, v, _ in rows:
        q = [math.floor(256 * x) for x in v] + [0] * (16 * width - len(v))
        parts.append([q[p * width : (p + 1) * width] for p in range(16)])
    books = [[list(x[p]) for x in parts[:64]] for p in range(16)]

    def near(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        found = [[near(p, x[p])[1] for p in range(16)] for x in parts]
        for p in range(16):
            for k in range(len(books[p])):
                own = [x[p] for x, f in zip(parts, found, strict=True) if f[p] == k]
                if own:
                    books[p][k] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    out, total = [], Counter()
    for (i, _, label), x in zip(rows, parts, strict=True):
        best = [near(p, x[p]) for p in range(16)]
        out.append((i, label, "".join(f"{k:02x}" for _, k in best), sum(d for d, _ in best)))
        total[label] += out[-1][3]
    return sorted_rows((i, code, error, total[label], digest) for i, label, code, error in out)


def vectors(spark, rows):
    full = [(i, v, label, "x", 1) for i, v, label in rows]
    return spark.createDataFrame(full, "vec_id bigint, embedding array<float>, label int, code string, v int")


@pytest.mark.parametrize("n,size", [(300, 64), (40, 32), (150, 16), (90, 20)])
def test_codes_equal_brute_force(spark, n, size):
    rnd = np.random.default_rng(n)
    rows = []
    for i in range(n):
        v = rnd.normal(scale=rnd.choice([0.05, 0.2, 3.0]), size=size).astype(np.float32).tolist()
        rows.append((int(i * 7 % n), v, None if i % 5 == 0 else int(i % 3)))
    rows += [(n + 1, rows[3][1], 1), (n + 1, rows[4][1], 1), (None, rows[5][1], None), (n + 2, None, 1)]
    rows += [(n + 3, [None, *rows[0][1][1:]], 1), (n + 4, [float("nan"), *rows[0][1][1:]], 1), (n + 5, [float("inf"), *rows[0][1][1:]], 2), (n + 6, rows[0][1][:7], 2), (n + 7, [], 2)]
    got = vector_codes.compress(vectors(spark, rows))
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted_rows(got.collect()) == brute_codes(rows)


def test_codes_of_nothing_of_one_and_of_equal_vectors(spark):
    assert vector_codes.compress(vectors(spark, [])).count() == 0
    assert vector_codes.compress(vectors(spark, [(1, None, 2)])).count() == 0
    one = [(4, [0.5] * 64, None)]
    assert sorted_rows(vector_codes.compress(vectors(spark, one)).collect()) == brute_codes(one)
    same = [(i, [0.25, -0.25] * 32, 1) for i in range(200)]
    got = vector_codes.compress(vectors(spark, same)).collect()
    assert {r.code for r in got} == {"00" * 16} and {r.label_error for r in got} == {0}
    huge = [(1, [3e38] * 16, 1), (2, [-3e38] * 16, 1)]
    assert vector_codes.compress(vectors(spark, huge)).count() == 2


def test_remembered_cells_leave_the_nearest_entry_and_save_work():
    rnd = np.random.default_rng(1)
    entries = rnd.integers(-200, 200, (64, 4))
    parts = rnd.integers(-220, 220, (5000, 4))
    memory = vector_codes.CellMemory(entries)
    distance = ((parts[:, None] - entries[None]) ** 2).sum(axis=2)
    for _ in range(2):
        code, error = memory.nearest(parts)
        assert (code == distance.argmin(axis=1)).all() and (error == distance.min(axis=1)).all()
    assert memory.evaluated < 2 * distance.size / 3
    # Every cell under one hash: the coordinates tell them apart.
    clash = vector_codes.CellMemory(entries)
    clash.place = {k: 0 for k in memory.place}
    clash.cells, clash.held = [np.full(4, 99)], [np.array([0])]
    assert (clash.nearest(parts)[0] == distance.argmin(axis=1)).all()


# Ranked search --------------------------------------------------------------


def brute_search(documents, items):
    def terms(text):
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower)

    docs = [(i, terms(t)) for i, t in documents]
    docs = [(i, w, Counter(w)) for i, w in docs if w]
    n, total = len(docs), sum(len(w) for _, w, _ in docs)
    df = Counter(t for _, _, c in docs for t in c)
    asked = {}
    for i, t in items:
        if i is not None:
            asked.setdefault(i, set()).update(terms(t))
    out = []
    for i, query in asked.items():
        scores = []
        for d, w, c in docs:
            m = 10 + (90 * len(w) * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in query if t in c)
            if score > 0:
                scores.append((-score, d is None, d))
        out += [(i, k + 1, d, -s) for k, (s, _, d) in enumerate(sorted(scores, key=lambda x: x[:2] + (x[2] or 0,))[:10])]
    return sorted_rows(out)


@pytest.fixture
def library(prose):
    r, rows = random.Random(9), []
    for i in range(500):
        rows.append((i, prose(r.choice([1, 3, 20, 80]), i) + r.choice(["", " Über-Maß 42", " LO-kan"])))
    rows += [(600 + i, rows[7][1]) for i in range(40)] + [(7, rows[7][1]), (None, rows[8][1]), (None, rows[8][1].upper()), (900, None), (901, ""), (902, "--- !"), (903, prose(30_000, 5))]
    items = [(i, prose(r.choice([1, 5, 30]), 1000 + i)) for i in range(30)]
    items += [(50, rows[7][1]), (51, rows[8][1].title()), (52, ""), (53, None), (54, "unheard words"), (None, "lo"), (55, "kan"), (55, "lo über"), (56, prose(400, 77))]
    return rows, items


@pytest.mark.parametrize("postings,depth", [(1 << 19, 64), (300, 4), (2000, 1)])
def test_search_equals_scoring_everything(spark, documents, library, monkeypatch, postings, depth):
    rows, items = library
    monkeypatch.setattr(lexical_search, "POSTINGS", postings)
    monkeypatch.setattr(lexical_search, "DEPTH", depth)
    monkeypatch.setattr(lexical_search, "ITEMS", 20)
    queries = spark.createDataFrame([(i, t, 3, 4) for i, t in items], "item_id bigint, text string, doc_id int, score int")
    got = lexical_search.search(documents(rows), queries)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted_rows(got.collect()) == brute_search(rows, items)


def test_search_of_nothing(spark, documents):
    none = spark.createDataFrame([], "item_id bigint, text string")
    some = spark.createDataFrame([(1, "a")], "item_id bigint, text string")
    assert lexical_search.search(documents([(1, "a")]), none).count() == 0
    assert lexical_search.search(documents([]), some).count() == 0
    assert lexical_search.search(documents([(1, "--")]), some).count() == 0


def test_reads_stop_early_and_stay_exact():
    r = np.random.default_rng(5)
    lists = []
    for t in range(12):
        docs = np.union1d(np.arange(30), r.choice(20_000, r.integers(500, 15_000), replace=False))
        impacts = r.integers(1, 100 * (t + 1), len(docs))
        impacts[docs < 30] += 3000
        order = np.argsort(-impacts, kind="stable")
        lists.append((docs[order], impacts[order]))
    whole = np.zeros(20_000, np.int64)
    for docs, impacts in lists:
        whole[docs] += impacts
    found, scores, read = lexical_search.nra(lists, 20_000, 10)
    assert read < sum(len(d) for d, _ in lists) / 2
    assert (scores == whole[found]).all()
    tenth = np.sort(whole)[-10]
    assert set(np.flatnonzero(whole >= tenth)) == set(found)
    high = int(np.sort(whole)[-3])
    assert set(lexical_search.nra(lists, 20_000, 10, high)[0]) == set(np.flatnonzero(whole >= high))
