import random

from cohortlens.llm.merkle import with_edits, with_tree


def plain(rows):
    """Edited texts by their definition, for distinct ids."""
    order = sorted(((d, t or "") for d, t in rows), key=lambda r: -r[0])
    out = {}
    for i, (d, t) in enumerate(order):
        after = order[(i + 1) % len(order)][1]
        k = len(t) // 3
        out[d] = t[: len(t) - k] + after[:k]
    return out


def test_edited_texts(docs_of):
    random.seed(6)
    rows = [(d * 7 - 50, "".join(random.choice("ab cä中😀\n") for _ in range(random.randint(0, 40)))) for d in range(60)]
    rows += [(1000, None), (1001, ""), (1002, "x" * 5000)]
    out = {r["doc_id"]: r for r in with_edits(docs_of(rows).repartition(5)).collect()}
    assert {d: r["edited"] for d, r in out.items()} == plain(rows)
    assert all(out[d]["n_chars"] == len(t or "") for d, t in rows)
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in out.values())


def test_equal_texts_and_only_they_have_equal_fingerprints(docs_of):
    random.seed(7)
    texts = ["", "\n", "\n\n", "a", "a\n", "\na", "a b", "b a", "a\nb", "b\na", None] + [
        "\n".join(random.choice("xyz") for _ in range(random.randint(1, 30))) for _ in range(100)
    ]
    out = with_tree(docs_of(list(enumerate(texts)))).collect()
    assert len({r["fingerprint"] for r in out}) == len({t or "" for t in texts})
    by_print = {}
    for r in out:
        by_print.setdefault(r["fingerprint"], set()).add(r["text"] or "")
    assert all(len(v) == 1 for v in by_print.values())


def test_likeness_and_place_of_an_edit(docs_of):
    lines = [" ".join(f"word{random.randint(0, 999)}" for _ in range(30)) for _ in range(30)]
    out = {r["doc_id"]: r for r in with_edits(docs_of([(2, "\n".join(lines)), (1, "other words " * 400)])).collect()}
    assert 0.6 < out[2]["near_edited"] < 0.75 and out[2]["near_next"] == 0
    assert min(out[2]["edited_at"]) in (19, 20)
    same = {r["doc_id"]: r for r in with_edits(docs_of([(2, "all the same"), (1, "all the same")])).collect()}
    assert same[2]["near_next"] == 1 and same[1]["near_next"] == 1 and same[2]["fingerprint"] == same[1]["fingerprint"]


def test_an_insertion_moves_no_other_section(docs_of):
    lines = [f"paragraph number {i}" for i in range(200)]
    moved = lines[:50] + ["something new"] + lines[50:]
    out = with_tree(docs_of([(1, "\n".join(lines)), (2, "\n".join(moved))])).orderBy("doc_id").collect()
    a, b = (set(r["sections"]) for r in out)
    assert len(a - b) <= 2 and len(a & b) > 10


def test_awkward_rows(awkward, nothing, docs_of):
    out = with_edits(awkward)
    assert out.count() == awkward.count()
    again = {(r["doc_id"], r["edited"]) for r in out.collect()}
    assert again == {(r["doc_id"], r["edited"]) for r in with_edits(awkward.repartition(7)).collect()}
    assert with_edits(nothing).count() == 0
    one = with_edits(docs_of([(1, "abcdef")])).first()
    assert one["edited"] == "abcdab"


def test_no_python_in_the_plan(docs_of):
    plan = with_edits(docs_of([(1, "a"), (2, "b")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_repeated_pieces_count_as_often_as_they_come(docs_of):
    passage = "a passage of the text that comes again and again all over\n"
    other = "".join(f"line {i} is nowhere else in any of these two texts here\n" for i in range(200))
    out = {r["doc_id"]: r for r in with_edits(docs_of([(2, passage * 300), (1, other)])).collect()}
    assert out[2]["near_edited"] < 0.05 and 0.6 < out[2]["kept_edited"] < 0.7
    assert out[2]["kept_next"] == 0
    out = {r["doc_id"]: r for r in with_edits(docs_of([(2, passage * 1000), (1, passage), (0, "x")])).collect()}
    assert out[2]["near_next"] == 1 and out[2]["kept_next"] < 0.01
    same = {r["doc_id"]: r for r in with_edits(docs_of([(2, passage * 3), (1, passage * 3), (0, "")])).collect()}
    assert same[2]["kept_next"] == 1 and same[0]["kept_next"] == 0
