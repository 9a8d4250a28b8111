"""The stages on planted cases, and what every stage has to return."""

import random

import pytest

import corpus_pipeline

BAD = ["trashy", "worthless", "stupid"]


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    random.seed(9)
    text = lambda n: " ".join(f"w{random.randint(0, 4000)}" for _ in range(n))
    shared = " ".join(f"s{i}" for i in range(60))
    items = [(i, text(40)) for i in range(5)]
    base = text(120)
    rows, labels = [], []
    for d in range(300):
        body = "\n".join(text(30) for _ in range(random.randint(1, 4)))
        kind = "clean"
        if d % 10 == 1:
            body, kind = body + f" {random.choice(BAD)} {random.choice(BAD)}", "toxic"
        elif d % 10 == 2:
            body, kind = f"{body}\n{shared}", "shared line"
        elif d % 50 == 3:
            body, kind = f"{body} {items[d % 5][1]} more", "leak"
        elif d % 50 == 4:
            body, kind = base if d < 100 else base + f" end{d}", "copy"
        rows.append((d, body, kind, "src0", len(body), "extra"))
        if d % 2:
            labels.append((d, 1, int(kind == "toxic")))
    rows.append((None, None, None, None, None, None))
    folder = str(tmp_path_factory.mktemp("planted"))
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, rep string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows, shared


def test_stages(spark, planted):
    folder, rows, shared = planted
    kind = {r[0]: r[2] for r in rows}
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = [sorted(kind, key=str)]
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        if number + 1 < len(corpus_pipeline.STAGES):
            assert out.columns == docs.columns and out.schema == docs.schema or set(out.dtypes) == set(docs.dtypes)
        docs = spark.createDataFrame(out.collect(), out.schema)
        seen.append(sorted((r["doc_id"] for r in docs.collect()), key=str))
        if name == "line dedup":
            assert [r["doc_id"] for r in docs.collect() if shared in (r["text"] or "")] == [292]
            assert all(r["n_chars"] == len(r["text"]) for r in docs.collect())
    gone = [{kind[d] for d in before if d not in after} for before, after in zip(seen, seen[1:])]
    assert gone == [{"toxic"}, set(), {"copy"}, {"leak"}, set()]
    assert sum(kind[d] == "copy" for d in seen[-1]) == 1
    assert all(kind[d] not in ("toxic", "leak") for d in seen[-1])
    assert sum(kind[d] == "clean" for d in seen[-1]) == sum(k == "clean" for k in kind.values())


def test_run_applies_all_stages(spark, planted):
    out = corpus_pipeline.run(spark, planted[0])
    assert out.columns == ["doc_id", "lang", "source", "n_chars", "n_tokens", "token_ids"]
    assert 0 < out.count() < len(planted[1])


def test_empty_table(spark, planted, tmp_path):
    for table in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{planted[0]}/{table}.parquet").limit(0).write.parquet(f"{tmp_path}/{table}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
