import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from sitefeed.llm import backoff_lm, byte_cnn, mixing, toxicity
from sitefeed.llm.words import slices


def held_out(key, modulus):
    return key is not None and zlib.crc32(str(key).encode()) % modulus == 2


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute_lm(rows):
    """Scores by plain recursion over counts of words, pairs and triples."""
    texts = [(i, re.findall(r"[^\x20\x09-\x0D]+", lower(t)) + ["\n"]) for i, t in rows]
    one, two, three = Counter(), Counter(), Counter()
    for i, w in texts:
        if not held_out(i, 7):
            x = ["\n", *w]
            one.update(w)
            two.update(zip(x, x[1:], strict=False))
            three.update(zip(x, x[1:], x[2:], strict=False))
    n, v = sum(one.values()), len(one)
    n1, n2 = (sum(c == k for c in one.values()) for k in (1, 2))
    d = n1 / (n1 + 2 * n2) if n1 else 0.5
    m2, m3 = backoff_lm.MASSES
    out = []
    for i, w in texts:
        base = sum(math.log10((one[t] + 1) / (n + v + 1)) for t in w) if n else 0.0
        x, total = ["\n", *w], 0.0
        for k in range(1, len(x)) if n else ():
            p = max(one[x[k]] - d, 0) / n + d * v / n / (v + 1)
            if one[x[k - 1]] >= 2:
                p = (two[x[k - 1], x[k]] + m2 * p) / (one[x[k - 1]] + m2)
                seen = two[x[k - 2], x[k - 1]] if k > 1 and one[x[k - 2]] >= 2 else 0
                if seen >= 2:
                    p = (three[x[k - 2], x[k - 1], x[k]] + m3 * p) / (seen + m3)
            total += math.log10(p)
        out.append((i, held_out(i, 7), len(w), sum(one[t] > 0 for t in w), n, base, total))
    return out


def test_lm_equals_brute_force(documents, prose, monkeypatch):
    from sitefeed.llm import blocks

    monkeypatch.setattr(blocks, "BLOCK_ROWS", 7)
    rows = [(i, prose(5 + i * 3 % 40, i % 17)) for i in range(60)]
    rows += [(60, None), (61, ""), (62, "Ka KA ka\tka\n"), (63, prose(400, 3)), (63, prose(400, 3)), (None, prose(9, 2)), (None, None)]
    got = backoff_lm.score(documents(rows)).collect()
    order = lambda r: (-1 if r[0] is None else r[0], r[2], r[6])
    for r, e in zip(sorted(map(tuple, got), key=order), sorted(brute_lm(rows), key=order), strict=True):
        assert r[:5] == e[:5]
        assert r[5:] == pytest.approx(e[5:], rel=1e-9)


def test_lm_walks_long_texts_in_stretches(documents, prose):
    """Texts around whole stretches, among repeated ones, so that pairs and triples are states."""
    k = backoff_lm.STRIDE
    rows = [(i, prose(n, i % 3)) for i, n in enumerate([k - 2, k - 1, k, k + 1, 2 * k - 1, 2 * k, 3 * k + 5, 1, 0, 3 * k])]
    rows += [(100 + i, f"{rows[6][1]} {rows[i][1]}") for i in range(4)]
    got = backoff_lm.score(documents(rows)).collect()
    for r, e in zip(sorted(map(tuple, got)), sorted(brute_lm(rows)), strict=True):
        assert r[:5] == e[:5]
        assert r[5:] == pytest.approx(e[5:], rel=1e-9)


def test_lm_root_is_a_distribution():
    """Known tokens and one unknown share exactly one."""
    counts = np.array([1, 1, 1, 2, 2, 5, 9])
    root = backoff_lm.Root(int(counts.sum()), len(counts), 3, 2)
    assert root.probability(np.append(counts, 0)).sum() == pytest.approx(1)
    assert 10 ** root.base(counts) == pytest.approx((counts + 1) / (counts.sum() + len(counts) + 1))


def test_lm_without_anything_to_learn(documents):
    only = next(i for i in range(100) if held_out(i, 7))
    r = backoff_lm.score(documents([(only, "a b")])).first()
    assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) == (True, 3, 0, 0, 0.0, 0.0)
    assert backoff_lm.score(documents([])).count() == 0


@pytest.fixture
def labelled(spark, prose):
    """Texts with label rows: junk is of low quality, some texts hold insults."""
    r, rows, labels = random.Random(2), [], []
    for i in range(240):
        words = prose(r.randint(5, 120), i).split()
        junk, toxic = i % 4 == 0, i % 5 == 0
        if toxic:
            for _ in range(3):
                words.insert(r.randint(0, len(words)), r.choice(["stupid", "moron", "idiot"]))
        rows.append((i, "*** ".join(words) + "$$$" if junk else " ".join(words)))
        labels.append((i, 0 if junk else 1, 1 if toxic else 0))
    labels += [(0, None, None), (None, 1, 1), (9999, 0, 1)]
    return rows, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


SPECIAL = [(1000, ""), (1001, None), (1002, "x" * 300_000), (None, "a b c"), (1003, "é" * 700), (1003, "é" * 700)]


@pytest.mark.parametrize("which", ["quality", "toxic"])
def test_classifiers_on_held_out_rows(documents, labelled, which):
    rows, labels = labelled
    work = byte_cnn.quality if which == "quality" else toxicity.toxicity
    got = work(documents(rows + SPECIAL), labels).collect()
    assert len(got) == len(rows) + len(SPECIAL)
    assert all(r.held_out == held_out(r.doc_id, 4) and 0 <= r.score <= 1 for r in got)
    truth = {i: (i % 4 != 0 if which == "quality" else i % 5 == 0) for i, _ in rows}
    apart = [r for r in got if r.held_out and r.doc_id in truth]
    right = sum(bool(r.predicted) == truth[r.doc_id] for r in apart)
    assert len(apart) > 40 and right >= 0.93 * len(apart)
    again = {(r.doc_id, r.score) for r in work(documents(rows + SPECIAL), labels).collect()}
    assert again == {(r.doc_id, r.score) for r in got}


def test_classifiers_never_learn_held_out_labels(documents, labelled, spark):
    rows, labels = labelled
    flipped = labels.selectExpr("doc_id", "CASE WHEN crc32(cast(doc_id AS string)) % 4 = 2 THEN 1 - quality ELSE quality END AS quality", "toxic")
    a, b = (sorted((r.doc_id, r.score) for r in byte_cnn.quality(documents(rows), t).collect()) for t in (labels, flipped))
    assert a == b


def test_classifiers_without_labels(documents, labelled):
    rows, labels = labelled
    none = labels.where("doc_id < 0")
    assert {r.score for r in byte_cnn.quality(documents(rows[:3]), none).collect()} == {0.5}
    assert {r.score for r in toxicity.toxicity(documents(rows[:3]), none).collect()} == {0.1}
    assert byte_cnn.quality(documents([]), none).count() == 0
    assert toxicity.toxicity(documents([]), labels).count() == 0


def test_network_sees_every_byte():
    """A text's score does not depend on how it is cut into slices, and its last bytes count."""
    model, r = byte_cnn.ByteCNN(), np.random.default_rng(0)
    tables = model.pair_tables()
    long = "ab " * 3000
    assert np.allclose(model.responses(byte_cnn.chunk_bytes(r.integers(0, 255, 600, dtype=np.uint8), np.array([0, 192]), np.array([256, 448]))),
                       model.responses(byte_cnn.chunk_bytes(np.random.default_rng(0).integers(0, 255, 600, dtype=np.uint8), np.array([0, 192]), np.array([256, 448])), tables), atol=1e-4)

    def score(texts, limit):
        return np.concatenate([byte_cnn.score_texts(model, tables, t.data, t.offsets) for t in slices(pa.array(texts), limit=limit)])

    texts = ["", "a", long, long + "$$$$$$$$$$"]
    assert np.allclose(score(texts, 1), score(texts, 1 << 20))
    assert score(texts, 1 << 20)[2] != score(texts, 1 << 20)[3]


def test_gradients_are_those_of_the_loss():
    model, r = byte_cnn.ByteCNN(3), np.random.default_rng(1)
    chunks = r.integers(97, 110, (5, byte_cnn.CHUNK)).astype(np.uint8)
    text, label = np.array([0, 0, 1, 2, 2]), np.array([1, 0, 1], np.float32)

    def loss():
        hidden = np.maximum(np.maximum(model.responses(chunks).max(1) + model.bias, 0) @ model.w1 + model.b1, 0)
        mean = np.array([hidden[text == k].mean(0) for k in range(3)])
        top = np.array([hidden[text == k].max(0) for k in range(3)])
        p = 1 / (1 + np.exp(-model.logits(mean, top)))
        return -(label * np.log(p) + (1 - label) * np.log(1 - p)).mean()

    grads = model.gradients(chunks, text, label)
    for part, grad in zip(model.parts, grads, strict=True):
        at = np.unravel_index(np.abs(grad).argmax(), grad.shape)
        kept, step = part[at], 1e-2
        part[at] = kept + step
        up = loss()
        part[at] = kept - step
        down = loss()
        part[at] = kept
        assert grad[at] == pytest.approx((up - down) / (2 * step), rel=0.1, abs=2e-3)


def test_kneser_ney_is_a_distribution():
    counts = [Counter({b"abc": 3, b"abd": 2, b"xyz": 1}), Counter({b"abc": 1, b"stupid": 4})]
    model = toxicity.KneserNey(counts)
    prefix = int.from_bytes(b"\x20ab", "big")
    for side in (0, 1):
        p = np.full(256, 1 / 256)
        keys = np.array([(prefix << 8) | b for b in range(256)], np.uint64)
        for k in range(1, 5):
            p, _ = model._level(k, side).refine(keys & np.uint64((1 << 8 * k) - 1), p)
        assert p.sum() == pytest.approx(1)
    gain = model.evidence([b"stupid", b"abd", b"qqq"])
    assert gain[0] > 1 > abs(gain[2]) and gain[1] < 0


def languages(prose):
    r, rows, labels = random.Random(5), [], []
    marks = {"en": ["the", "and", "of"], "de": ["der", "und", "ein"], "fr": ["le", "et", "une"]}
    for i in range(300):
        lang = r.choice(["en", "en", "en", "de", "fr"])
        words = prose(r.randint(4, 60), i).split()
        words = [x for w in words for x in (w, r.choice(marks[lang]))]
        rows.append((i, " ".join(words)))
        labels.append((i, lang if i % 3 else None))
    return rows, labels


def test_mixing_matches_targets_and_brute_force(spark, documents, prose):
    rows, labels = languages(prose)
    rows += [(900, ""), (901, None), (902, "der"), (902, "der"), (None, "the of and le et une")]
    targets = {"en": 1.0, "de": 2.0, "fr": 1.0}
    mixture = mixing.Mixture(documents(rows), spark.createDataFrame(labels, "doc_id bigint, domain string"), targets)
    got = mixture.rates().collect()
    assert len(got) == len(rows) and all(r.rate >= 0 for r in got)
    n = np.array([r.n_tokens for r in got], float)
    assert sorted(n) == sorted(len((t or "").split()) for _, t in rows)
    p = np.array([[r.p_de, r.p_en, r.p_fr] for r in got])
    assert np.allclose(p.sum(1), 1)
    rate = np.array([r.rate for r in got])
    goal = np.array([0.5, 0.25, 0.25]) * n.sum()
    assert np.allclose((rate * n) @ p, goal, rtol=1e-4)
    assert all(r.rate == 1 for r in got if r.n_tokens == 0)
    # The same steps in numpy.
    x, again = n / mixture.mean, np.ones(len(n))
    for step in mixture.steps:
        again = np.maximum(0, again - x * (p @ np.array(step)))
    assert np.allclose(rate, again)
    known = dict(labels)
    sure = [(known[r.doc_id], max(zip((r.p_de, r.p_en, r.p_fr), ("de", "en", "fr"), strict=True))[1]) for r in got if known.get(r.doc_id)]
    assert sum(a == b for a, b in sure) > 0.95 * len(sure)


def test_mixing_of_a_target_out_of_reach_and_of_nothing(spark, documents, prose):
    rows, labels = languages(prose)
    labels = spark.createDataFrame(labels, "doc_id bigint, domain string")
    gone = mixing.Mixture(documents(rows), labels, {"en": 1.0, "de": 0.0, "fr": 0.0})
    rates = gone.rates().collect()
    share = sum(r.rate * r.n_tokens * r.p_en for r in rates) / sum(r.rate * r.n_tokens for r in rates)
    assert share > 0.95 and min(r.rate for r in rates) == 0
    none = mixing.rates(documents([]), labels, {"en": 1.0, "de": 1.0})
    assert none.count() == 0
    unlabelled = mixing.rates(documents(rows[:5]), labels.where("doc_id < 0"), {"en": 3.0, "de": 1.0}).collect()
    assert all(r.p_en == pytest.approx(0.75) and r.rate == pytest.approx(1) for r in unlabelled)
    clashing = documents(rows).selectExpr("*", "1 AS rate", "'x' AS domain")
    assert mixing.with_rates(clashing, labels, {"en": 1.0, "de": 1.0}).columns == ["doc_id", "text", "lang", "score", "n", "key", "domain", "rate"]


def test_mixing_sees_capitals_line_breaks_and_tables(spark, documents):
    said = {
        "de": "der hund und die katze sind nicht im haus aber auf dem dach",
        "en": "the dog and the cat are not in the house but on the roof",
        "fr": "le chien et le chat ne sont pas dans la maison mais sur le toit",
    }
    rows = [(i, said[d]) for i, d in enumerate(sorted(said) * 20)]
    labels = spark.createDataFrame([(i, d) for i, d in enumerate(sorted(said) * 20)], "doc_id bigint, domain string")
    forms = [str.upper, lambda t: t.replace(" ", "\n"), lambda t: "| " + t.replace(" ", "!! |\t") + ",", lambda t: " ".join(t.split()[-2:])]
    tried = [(d, f(t)) for d, t in said.items() for f in forms]
    rows += [(100 + i, t) for i, (_, t) in enumerate(tried)] + [(200, "12 zzz 7")]
    got = {r.doc_id: r for r in mixing.rates(documents(rows), labels, {d: 1.0 for d in said}).collect()}
    for i, (d, text) in enumerate(tried):
        assert got[100 + i][f"p_{d}"] > 0.9, text
    assert got[200].p_de == pytest.approx(1 / 3)


def brute_posteriors(texts, labels, domains, evidence):
    """Naive Bayes over hashed words by plain counting; texts: (id, text), labels: {id: domain}."""
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    words = {i: set(re.findall(r"[^\W\d_]+", (t or "").lower())) for i, t in texts}
    every = sorted(set().union(*words.values()))
    hashed = spark.createDataFrame([(w,) for w in every], "w string").selectExpr("w", f"cast(xxhash64(w) & {mixing.FEATURES - 1} as int) f").collect()
    number = {r.w: r.f for r in hashed}
    features = {i: {number[w] for w in ws} for i, ws in words.items()}
    held, count = Counter(labels.values()), {d: Counter() for d in domains}
    for i, d in labels.items():
        count[d].update(features[i])
    total = sum(count.values(), Counter())
    n = sum(total.values())
    out = {}
    for i, fs in features.items():
        known = [f for f in fs if total[f]]
        weight = len(known) * evidence / (len(known) + evidence)
        z = []
        for d in domains:
            own = sum(count[d].values())
            logs = [math.log((count[d][f] + mixing.SMOOTHING * total[f] / n) / (own + mixing.SMOOTHING)) for f in known]
            z.append(math.log(held[d] + 0.5) + weight * sum(logs) / max(len(known), 1))
        top = max(z)
        e = [math.exp(x - top) for x in z]
        out[i] = [x / sum(e) for x in e]
    return out


def test_posteriors_equal_plain_naive_bayes_and_are_soft(spark, documents, prose):
    rows, labels = languages(prose)
    both = " ".join(rows[0][1].split()[:30] + next(t for i, t in rows if dict(labels).get(i) != dict(labels)[rows[0][0]]).split()[:30])
    rows = [*rows, (900, both), (901, "unheard")]
    labels = [x for x in labels if x[1]]
    domains = sorted(set(dict(labels).values()))
    mixture = mixing.Mixture(documents(rows), spark.createDataFrame(labels, "doc_id bigint, domain string"), {d: 1.0 for d in domains})
    assert mixture.model.evidence in mixing.EVIDENCE
    taught = {i: d for i, d in dict(labels).items() if i in dict(rows)}
    expected = brute_posteriors(rows, taught, domains, mixture.model.evidence)
    for r in mixture.rates().collect():
        assert [r[f"p_{d}"] for d in domains] == pytest.approx(expected[r.doc_id], abs=2e-3)


def test_any_vocabulary_finds_its_place(spark):
    """Two hundred vocabularies of random letters, learnt and looked up without a failure."""
    import random

    rows = []
    for i in range(200):
        r = random.Random(i)
        rows.append((i, " ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9)) for _ in range(300))))
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(200)], "doc_id bigint, domain string")
    got = mixing.rates(table, labels, {"a": 1.0, "b": 3.0}).collect()
    assert len(got) == 200 and all(0 <= r.rate < math.inf for r in got)


def test_rates_are_an_optimum_of_the_least_squares(spark, documents, prose):
    """Against bounded coordinate descent from the same start: the same, least, error."""
    rows, labels = languages(prose)
    targets = {"en": 1.0, "de": 0.0, "fr": 1.0}
    mixture = mixing.Mixture(documents(rows), spark.createDataFrame(labels, "doc_id bigint, domain string"), targets)
    got = mixture.rates().collect()
    x = np.array([r.n_tokens for r in got], float) / mixture.mean
    a = (np.array([[r.p_de, r.p_en, r.p_fr] for r in got]) * x[:, None]).T
    goal = np.array([0.0, 0.5, 0.5]) * x.sum()
    rate = np.ones(len(x))
    for _ in range(300):
        for j in range(len(x)):
            if x[j]:
                rest = goal - a @ rate + a[:, j] * rate[j]
                rate[j] = max(0.0, a[:, j] @ rest / (a[:, j] @ a[:, j]))
    least = np.abs(a @ rate - goal).sum() / goal.sum()
    found = np.abs(a @ np.array([r.rate for r in got]) - goal).sum() / goal.sum()
    assert found <= least + 0.02
