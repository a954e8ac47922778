import random

import pytest

import corpus_pipeline
from sitefeed.llm import byte_cnn, secret_scan
from tests.llm.test_pairs import brute_jaccard
from tests.llm.test_scans import brute_contamination, plain_base

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture
def tables(spark, tmp_path, prose):
    r, rows, labels = random.Random(4), [], []
    passage = prose(14, 900)
    for i in range(260):
        words = prose(r.randint(20, 90), i).split()
        lang = r.choice(["en", "en", "de", "fr"])
        mark = {"en": "the", "de": "der", "fr": "le"}[lang]
        words = [x for w in words for x in (w, mark)]
        if i % 6 == 0:
            words = [w + "***" for w in words]
        if i % 9 == 1:
            words[5:5] = passage.split()
        if i % 10 == 2:
            words.append(f"token = \"{i:040x}\"")
        rows.append((i, " ".join(words), lang, "s", 0))
        labels.append((i, 0 if i % 6 == 0 else 1, 0))
    rows += [(500 + k, rows[k][1] + (" end" if k % 2 else ""), rows[k][2], "s", 0) for k in range(1, 30, 2)]
    rows += [(700, None, "en", None, None), (701, "", None, "s", 0), (1, rows[1][1], "en", "s", 0), (None, rows[2][1], None, None, None)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, passage), (2, prose(12, 901))], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path), passage


def ids(rows):
    return sorted(-1 if r.doc_id is None else r.doc_id for r in rows)


def test_every_stage_decides_on_what_the_one_before_kept(spark, tables):
    sf_dir, passage = tables
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert len(names) == 5 and "Jaccard" in names[1]
    docs, seen = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = corpus_pipeline.materialize(stage(spark, docs, sf_dir), "stage")
        seen.append((before, docs.collect()))
        assert docs.columns == (COLUMNS if name != names[-1] else [*COLUMNS, "rate"])

    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    before, after = seen[0]
    judged = byte_cnn.quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), labels).where("predicted = 1")
    assert ids(after) == ids(judged.collect()) and len(after) < len(before)
    assert sum(r.doc_id is not None and r.doc_id % 6 == 0 and r.doc_id < 260 for r in after) <= 2

    before, after = seen[1]
    by_id = {r.doc_id: r.text for r in before if r.doc_id is not None}
    group = brute_jaccard(list(by_id.items()))
    nameless = [r for r in before if r.doc_id is None]
    assert ids(after) == sorted([i for i, x in group.items() if x[2]] + [-1] * len(nameless))
    assert len(after) < len(before)

    before, after = seen[2]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    clean = [x[0] for x in brute_contamination([(r.doc_id, r.text) for r in before], items) if not x[5]]
    assert ids(after) == sorted(clean) and len(after) < len(before)
    assert not any(passage in (r.text or "") for r in after)

    before, after = seen[3]
    assert ids(after) == ids(before)
    assert any(plain_base(r.text) for r in before) and not any(plain_base(r.text) for r in after)
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in after)
    kept = {r.doc_id: r.text for r in after}
    assert all(kept[r.doc_id] == r.text for r in before if not secret_scan.base_spans(r.text or ""))

    before, after = seen[4]
    assert ids(after) == ids(before) and all(r.rate >= 0 for r in after)
    tokens = {}
    for r in after:
        tokens[r.lang] = tokens.get(r.lang, 0) + r.rate * len((r.text or "").split())
    # There is no Spanish here: English is to have 0.4 of 0.8.
    assert tokens["en"] / sum(tokens.values()) == pytest.approx(0.5, abs=0.05)

    assert ids(corpus_pipeline.run(spark, sf_dir).collect()) == ids(after)


def test_stages_of_no_documents(spark, tables):
    sf_dir, _ = tables
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id < 0")
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialize(stage(spark, docs, sf_dir), "stage")
        assert docs.count() == 0


def test_stages_keep_columns_whose_names_are_inner_ones(spark, tables):
    """Every stage with every inner name as a further column, and a very long text."""
    sf_dir, _ = tables
    names = (
        "quality_score quality_predicted _kept_id _rows kept kept_id n row of_text links class_id node rep copies key places words matches "
        "_text_key _hit_key text_key hit_key start win secret_spans spans _tokens _text _h _at _f _known _row _p0 _s0 _x _r label toxic"
    ).split()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    long = docs.limit(1).selectExpr("9000 AS doc_id", "repeat('lokan rest vimi ', 200000) AS text", "lang", "source", "n_chars")
    docs = docs.unionByName(long).selectExpr("*", *[f"'{n}' AS {n}" for n in names])
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, sf_dir)
        rows = after.collect()
        assert after.columns[: len(docs.columns)] == docs.columns, name
        assert rows and all(r[n] == n for r in rows[:50] for n in names), name
