import numpy as np
import pytest

from sitefeed.llm import embedding_dedup, ngram_jaccard, substring_dedup
from sitefeed.llm.graph import components


def closure(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_components_of_chains_stars_and_cycles(spark):
    links = [(i, i + 1) for i in range(1, 30)] + [(100, i) for i in range(101, 140)]
    links += [(200, 201), (201, 202), (202, 200), (202, 202), (201, 200)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "a bigint, b bigint")).collect()))
    assert got == closure({x for e in links for x in e}, links)
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def shingles(text):
    import re

    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_jaccard(rows):
    sets = {i: shingles(t) for i, t in rows}
    links = [
        (a, b) for a in sets for b in sets if a < b and sets[a] and sets[b]
        and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])
    ]
    group = closure(sets, links)
    return {i: (sum(i in e for e in links), group[i], group[i] == i) for i in sets}


@pytest.fixture
def near_copies(prose):
    rows = [(i, prose(60 + i, i)) for i in range(6)]
    base = prose(120, 99).split()
    for i in range(10, 26):  # near copies of each other, some linked through others only
        words = list(base)
        for k in range(i - 10):
            words[(k * 7) % 120 : (k * 7) % 120 + 1] = [f"w{k // 3}x{i if k % 4 == 0 else 0}"]
        rows.append((i, " ".join(words).upper() if i % 2 else "  ".join(words)))
    rows += [(40, rows[0][1]), (41, rows[0][1] + "!"), (50, "one two"), (51, "One, two."), (52, ""), (53, None), (54, "...")]
    return rows


def test_jaccard_join_equals_brute_force(documents, near_copies, monkeypatch):
    expected = brute_jaccard(near_copies)
    for tile in (ngram_jaccard.TILE, 4):
        monkeypatch.setattr(ngram_jaccard, "TILE", tile)
        rows = ngram_jaccard.jaccard_join(documents(near_copies)).collect()
        assert {r.doc_id: (r.n_links, r.class_id, r.kept) for r in rows} == expected
    assert sum(n for n, _, _ in expected.values()) > 20


def test_keep_one_of_each(documents, near_copies):
    rows = [*near_copies, near_copies[0], near_copies[0], (None, near_copies[1][1]), (None, None)]
    kept = ngram_jaccard.keep_one_of_each(documents(rows))
    assert kept.columns == documents([]).columns
    found = sorted(r.doc_id for r in kept.collect() if r.doc_id is not None)
    assert found == sorted(i for i, x in brute_jaccard(near_copies).items() if x[2])
    assert kept.where("doc_id IS NULL").count() == 2
    assert ngram_jaccard.jaccard_join(documents([])).count() == 0


def brute_substrings(rows):
    words = [(i, (t or "").encode().split()) for i, t in rows]
    first = {}
    for i, w in words:
        for p in range(len(w) - 49):
            key = tuple(w[p : p + 50])
            if i is not None:
                first[key] = min(first.get(key, i), i)
    out = []
    for i, w in words:
        gone = set()
        for p in range(len(w) - 49):
            if i is not None and first[tuple(w[p : p + 50])] < i:
                gone.update(range(p, p + 50))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone).decode()
        out.append((i if i is not None else -1, len(w), len(gone), kept))
    return sorted(out)


def test_substring_dedup_equals_brute_force(documents, prose):
    passage, other = prose(70, 1), prose(49, 2)
    rows = [
        (5, passage), (3, f"{prose(13, 3)} {passage} {prose(20, 4)}"), (9, f"{passage} x {passage}\n{other}"),
        (10, other), (11, f"a {other}"), (12, f"b {other} {prose(3, 5)}"), (13, f"{other} {prose(3, 5)}"),
        (20, ""), (21, None), (22, prose(600, 6)), (23, prose(600, 6)), (23, prose(600, 6)), (None, passage),
        (30, " ".join(["the"] * 300)), (31, " ".join(["the"] * 51)), (32, " ".join(["the"] * 50)), (7, f"é {passage.upper()}"),
    ]
    got = substring_dedup.dedup_substrings(documents(rows)).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_words, r.n_removed, r.kept) for r in got) == brute_substrings(rows)
    assert sum(r.n_removed for r in got) > 900
    assert substring_dedup.dedup_substrings(documents([])).count() == 0


def brute_cosine(rows):
    good = {}
    for i, v, label in rows:
        if v and label is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good[i] = (np.array(v, float), label)
    links = []
    for a in good:
        for b in good:
            (u, x), (v, y) = good[a], good[b]
            if a < b and x == y and len(u) == len(v) and u @ v / (np.sqrt(u @ u) * np.sqrt(v @ v)) >= 0.93:
                links.append((a, b))
    group = closure([r[0] for r in rows], links)
    return {i: (sum(i in e for e in links), group[i], group[i] == i) for i in group}


@pytest.mark.parametrize("tile", [1024, 6])
def test_embedding_dedup_equals_brute_force(spark, tile, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "TILE", tile)
    r = np.random.default_rng(3)
    centres = r.normal(size=(8, 16)) * np.linspace(3, 0.2, 16)
    rows = []
    for i in range(90):
        v = centres[i % 8] + r.normal(size=16) * 0.16 * (1 + i % 3)
        rows.append((i, v.astype(np.float32).tolist(), i % 3 if i % 8 else 1))
    rows += [(100 + k, rows[0][1], rows[0][2]) for k in range(12)]
    rows += [(200, None, 1), (201, [], 1), (202, [0.0] * 16, 1), (203, [float("nan")] * 16, 1), (204, [None, *rows[0][1][1:]], 1)]
    rows += [(205, rows[0][1], None), (206, rows[0][1][:4], 1), (207, rows[0][1][:4], 1), (208, [3e38] * 16, 1), (209, [3e38] * 16, 1)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").selectExpr("*", "1 AS unit", "2 AS v")
    got = {x.vec_id: (x.n_links, x.component_id, x.kept) for x in embedding_dedup.near_duplicates(table).collect()}
    expected = brute_cosine(rows)
    assert got == expected
    assert sum(n for n, _, _ in expected.values()) > 150
    nothing = embedding_dedup.near_duplicates(table.where("vec_id < 0"))
    assert nothing.count() == 0
