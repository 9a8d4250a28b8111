import random
import re

from cohortlens.llm.line_dedup import SortedRuns, dedup_lines

UPPER = re.compile("[A-Z]")


def key_of(line):
    return UPPER.sub(lambda m: m.group().lower(), line.strip(" \t\n\x0b\x0c\r"))


def brute(rows, min_chars, min_docs):
    held = {}
    for d, t in rows:
        for line in (t or "").split("\n"):
            if d is not None and len(key_of(line)) >= min_chars:
                held.setdefault(key_of(line), set()).add(d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        gone = lambda k: d is not None and len(held.get(k, ())) >= min_docs and d < max(held[k])
        kept = [x for x in lines if not gone(key_of(x))]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def compare(frame, rows, **options):
    mine = dedup_lines(frame, **options).select("doc_id", "n_lines", "n_dropped", "text").collect()
    key = lambda r: str(r)
    assert sorted(map(tuple, mine), key=key) == sorted(brute(rows, options["min_chars"], options["min_docs"]), key=key)


def test_against_brute_force(docs_of):
    random.seed(5)
    lines = ["Alpha beta", "alpha BETA ", "\tgamma delta", "", "Ärger über Öl", "ÄRGER über öl", "zeta eta theta"]
    rows = [(random.randint(1, 60), "\n".join(random.choice(lines) for _ in range(random.randint(0, 6)))) for _ in range(150)]
    rows += [(None, "alpha beta\nalpha beta"), (70, None), (71, "alpha beta")]
    for batches, fanout in ((1, 3), (5, 2)):
        compare(docs_of(rows), rows, min_chars=4, min_docs=3, batches=batches, fanout=fanout)


def test_awkward_rows_and_columns(awkward, nothing):
    rows = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    compare(awkward, rows, min_chars=3, min_docs=2)
    out = dedup_lines(awkward)
    assert out.columns[: len(awkward.columns)] == awkward.columns
    assert {r["component_id"] for r in out.collect()} == {"y"}
    assert dedup_lines(nothing).count() == 0


def test_runs_are_compacted_and_hold_a_key_once(spark):
    runs = SortedRuns(spark, fanout=2)
    for start in (0, 5, 10, 15, 20):
        batch = spark.range(start, start + 8).selectExpr("id AS h1", "id AS h2", "id AS keeper")
        runs.add(runs.unseen(batch))
    assert sum(map(len, runs.levels)) <= 3
    assert sorted(r["h1"] for r in runs.all().collect()) == list(range(28))


def test_no_python_in_the_plan(docs_of):
    plan = dedup_lines(docs_of([(1, "a")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
