import hashlib
import re

from pyspark.sql import functions as F
from tables import awkward, docs, empty, prose

from evwarden.llm.merkle import differing, edited_fingerprints, fingerprint_table, fingerprints, root_of


def sha(level, text):
    return hashlib.sha256(f"{level}:{text}".encode()).hexdigest()


def cut(items, ends):
    out = [[]]
    for x in items:
        out[-1].append(x)
        if ends(x):
            out.append([])
    return [x for x in out if x]


def naive(text):
    """Fingerprint and distinct leaf hashes, by loops."""
    leaves = re.findall(r"[^.!?\n]{0,80}[.!?\n]+|[^.!?\n]{1,80}", text)
    assert "".join(leaves) == text
    nodes = [(sha("leaf", x), x) for x in leaves]
    lines = []
    for run in cut(nodes, lambda x: x[1].endswith("\n")):
        below = ",".join(h[:12] for h, _ in run)
        lines.append((sha("paragraph", ",".join(h for h, _ in run)), run[-1][1].endswith("\n\n"), below))
    sections = []
    for run in cut(lines, lambda x: x[1] or x[0] < "2"):
        sections.append((sha("section", ",".join(h for h, _, _ in run)), ";".join(f"{h[:12]}:{b}" for h, _, b in run)))
    parts = [sha("text", ",".join(h for h, _ in sections)), *(f"{h[:12]}={b}" for h, b in sections)]
    return "|".join(parts), {h[:12] for h, _ in nodes}


def alike(a, b):
    return 1.0 if not a and not b else 2 * len(a & b) / (len(a) + len(b))


def naive_rows(rows):
    """Rows of (id, text), ids different."""
    rows, out = sorted(rows), {}
    for at, (i, text) in enumerate(rows):
        following = rows[(at + 1) % len(rows)][1]
        k = len(text) // 4
        edited = text[: len(text) - k] + following[:k]
        (f, v), (g, w), (_, z) = naive(text), naive(edited), naive(following)
        out[i] = (len(text), edited, f, g, alike(v, w), alike(v, z))
    return out


def pages(seed):
    words = prose(seed, 40 + seed * 7 % 200, 300)
    marks = [". ", "! ", "\n", "\n\n", "?\n", " ", " "]
    return "".join(w + marks[(seed * 31 + n * n) % (7 if seed % 3 else 6)] for n, w in enumerate(words)) + "é€😀"


def test_tree_and_neighbours_against_loops(spark):
    rows = [(i * 3, pages(i)) for i in range(60)] + [(1, ""), (2, "x"), (4, "y" * 400), (400, pages(5)), (401, "...!!\n\n\n"), (402, "\n")]
    want = naive_rows(rows)
    got = edited_fingerprints(docs(spark, [(i, t, "a") for i, t in rows])).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_chars, r.edited, r.fingerprint, r.edited_fingerprint) == want[r.id][:4]
        assert abs(r.near_edited - want[r.id][4]) < 1e-12 and abs(r.near_next - want[r.id][5]) < 1e-12
    long = [r for r in got if r.n_chars > 400 and r.id != 4]
    assert sum(r.near_edited for r in long) > 0.6 * len(long) > 4 * sum(r.near_next for r in long)


def test_equal_texts_and_only_these_have_equal_roots(spark):
    texts = ["a b.\nc", "a b.\nc", "a b. \nc", "a b.\n\nc", "a b.c", "", None, "a b.\nc "]
    rows = fingerprints(docs(spark, [(i, t, "a") for i, t in enumerate(texts)])).select("id", "fingerprint", root_of(F.col("fingerprint")).alias("root")).collect()
    by = {r.id: r for r in rows}
    for a in by:
        for b in by:
            same = (texts[a] or "") == (texts[b] or "")
            assert (by[a].fingerprint == by[b].fingerprint) == same == (by[a].root == by[b].root)


def test_differing_branches_locate_an_edit(spark):
    lines = [f"{' '.join(prose(i, 12))}. {' '.join(prose(900 + i, 12))}." for i in range(30)]
    changed = list(lines)
    changed[17] = lines[17].replace(" ", "  ", 1)
    inserted = lines[:3] + ["A new line."] + lines[3:]
    table = fingerprints(docs(spark, [(i, "\n".join(x), "a") for i, x in enumerate((lines, changed, inserted))]))
    prints = {r.id: r.fingerprint for r in table.collect()}
    pair = spark.createDataFrame([(prints[a], prints[b]) for a, b in ((1, 0), (2, 0), (0, 0))], "a string, b string")
    found = [r.d for r in pair.select(differing(F.col("a"), F.col("b")).alias("d")).collect()]

    def leaf(f, place):
        section = f.split("|")[1:][place.section]
        return section.split("=")[1].split(";")[place.paragraph].split(":")[1].split(",")[place.leaf]

    own = naive("\n".join(changed))[1] - naive("\n".join(lines))[1]
    assert [x.h for x in found[0]] == list(own) and len(own) == 1
    assert all(leaf(prints[1], x) == x.h for x in found[0])
    assert [x.h for x in found[1]] == [sha("leaf", "A new line.\n")[:12]]
    assert found[2] == []


def test_awkward_rows(spark):
    table = awkward(spark)
    rows = fingerprint_table(table).collect()
    assert len(rows) == 11 and fingerprint_table(empty(spark)).count() == 0
    assert sum(r.doc_id == 4 for r in rows) == 2 and sum(r.doc_id is None for r in rows) == 1
    texts = sorted({(r.doc_id is not None, r.doc_id or 0, r.text or "") for r in table.collect()})
    want = naive_rows([(n, t) for n, (_, _, t) in enumerate(texts)])
    place = {(i if known else None): n for n, (known, i, _) in enumerate(texts)}
    for r in rows:
        n_chars, edited, f, g, _, _ = want[place[r.doc_id]]
        assert (r.n_chars, r.fingerprint, r.edited_fingerprint) == (n_chars, f, g), r.doc_id
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
    alone = fingerprint_table(docs(spark, [(5, "one two.", "a")])).first()
    assert alone.near_next == 1.0 and alone.edited_sha256 == hashlib.sha256(b"one two"[:6] + b"on").hexdigest()


def test_rows_repeated_very_often(spark):
    rows = docs(spark, [(1, "same text.", "a")] * 2_500 + [(2, "other.", "a")])
    out = fingerprint_table(rows).groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in out} == {1: 2_500, 2: 1}


def test_no_python_in_the_plan(spark, sf):
    plan = fingerprint_table(spark.read.parquet(f"{sf}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "InPandas" not in plan
