import random

from tables import awkward, docs, empty, prose

from evwarden.llm.decontaminate import Items, benchmark_passages, edits_allowed, fitting_distance, passages, without_passages, words_of


def naive_fit(item, window):
    best = [0] * (len(window) + 1)
    for i, w in enumerate(item):
        row = [i + 1]
        for j, v in enumerate(window):
            row.append(min(best[j] + (w != v), best[j + 1] + 1, row[j] + 1))
        best = row
    return min(best)


def naive(text, items, share):
    words = words_of(text)
    out = set()
    for item, t in items:
        seq = words_of(t)
        if seq and words and naive_fit(seq, words) <= edits_allowed(len(seq), share):
            out.add(item)
    return out


def edited(words, k, draw):
    words = list(words)
    for _ in range(k):
        at = draw.randrange(len(words))
        kind = draw.randrange(3)
        words[at : at + (kind != 1)] = [] if kind == 0 else [f"new{draw.randrange(99)}"]
    return words


def test_recall_against_every_placement():
    """Items edited up to the limit: at least 0.97 of what comparing with every stretch finds, and nothing else."""
    draw = random.Random(4)
    items = [(i, " ".join(prose(i, draw.randrange(5, 60), 500))) for i in range(40)]
    tables = Items.build(items)
    found = expected = 0
    for seed in range(120):
        _, text = items[seed % 40]
        words = text.split()
        k = draw.randrange(edits_allowed(len(words)) + 3)
        filler = prose(1000 + seed, 120, 500)
        at = draw.randrange(100)
        doc = " ".join([*filler[:at], *edited(words, k, draw), *filler[at:]])
        want = naive(doc, items, 0.2)
        got = {p[0] for p in passages(doc, tables)}
        assert got <= want
        found, expected = found + len(got), expected + len(want)
    assert expected > 80 and found >= 0.97 * expected


def test_edit_distance_of_the_best_stretch():
    draw = random.Random(2)
    import numpy as np

    for _ in range(200):
        item = [draw.randrange(4) for _ in range(draw.randrange(1, 8))]
        window = [draw.randrange(4) for _ in range(draw.randrange(0, 14))]
        want = naive_fit(item, window)
        edits, start, end = fitting_distance(np.array(item), np.array(window, np.int64), len(item))
        assert edits == want
        assert naive_fit(item, window[start:end]) == want


def test_rows(spark):
    item = prose(1, 20)
    bench = spark.createDataFrame([(1, " ".join(item)), (2, None), (3, ""), (4, "two words"), (5, "")], "item_id long, text string")
    inside = [*prose(2, 30), *item[:9], "other", *item[10:], *prose(3, 30)]
    table = docs(
        spark, [(1, " ".join(inside).upper() + "!", "a"), (2, None, "a"), (3, "two, words.", "a"), (None, " ".join(item), "a"), (5, " ".join(item[:8]), "a"), (None, " ".join(item), "a")]
    )
    rows = benchmark_passages(table, bench).collect()
    assert sorted((r.id or -1, r.item_id, r.edits) for r in rows) == [(-1, 1, 0), (-1, 1, 0), (1, 1, 1), (3, 4, 0)]
    r = next(r for r in rows if r.id == 1)
    assert (r.first_word, r.end_word, r.n_words) == (30, 50, 20)
    kept = without_passages(table, bench)
    assert kept.columns == table.columns and sorted(r.doc_id for r in kept.collect()) == [2, 5]
    assert benchmark_passages(table, bench.limit(0)).count() == 0 and benchmark_passages(empty(spark), bench).count() == 0
    assert without_passages(awkward(spark), bench).count() == 11


def test_items_in_lots_give_the_same(spark):
    items = [(i, " ".join(prose(i, 15))) for i in range(7)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    table = docs(spark, [(i, " ".join(prose(50, 20)) + " " + t, "a") for i, t in items])
    one = sorted(map(tuple, benchmark_passages(table, bench).collect()))
    assert one == sorted(map(tuple, benchmark_passages(table, bench, items_per_pass=3).collect())) and len(one) == 7
