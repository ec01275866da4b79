import random

import corpus_pipeline
from pyspark.sql import functions as F
from tables import awkward, docs, empty, prose

from evwarden.llm.near import BANDS, _further, band_keys, fingerprint_links, least_hashes, near_copies, near_roots, one_of_near_copies, shingles, similarity, text_bands
from evwarden.llm.simhash import wide_bits, wide_keys


def edited(seed, words, edits):
    draw, out = random.Random(seed), list(words)
    for at in draw.sample(range(len(out)), edits):
        out[at] = f"e{seed}x{at}"
    return out


def families():
    """(id, words): texts and copies of them with so many edits that similarities lie on both sides of 0.8."""
    rows = []
    for f in range(60):
        words = prose(f, 200, 400_000)
        rows += [words, *(edited(1_000 * f + e, words, e) for e in (1, 3, 4, 5, 6, 8, 12))]
    return list(enumerate(rows))


def naive(rows):
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = []
    for f in range(0, len(rows), 8):
        for a in range(f, f + 8):
            for b in range(a + 1, f + 8):
                if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                    links.append((a, b))
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
    return {i: find(i) for i in root}, links


def test_fingerprints_meet():
    rows = dict(families())
    _, links = naive(list(rows.items()))
    keys = {i: band_keys(least_hashes(list(shingles(" ".join(w))))) for i, w in rows.items()}
    assert len(keys[0]) == BANDS and len(links) > 200
    assert sum(bool(set(keys[a]) & set(keys[b])) for a, b in links) >= 0.99 * len(links)
    assert similarity(shingles("A b c d e"), shingles("a B c d e")) == 1 and similarity(shingles("a b"), shingles("a c")) == 0


def test_components_are_those_of_all_pairs(spark):
    rows = families()
    want, links = naive(rows)
    got = {r.id: r.component for r in near_copies(docs(spark, [(i, " ".join(w), "a") for i, w in rows])).collect()}
    assert sum(got[a] == got[b] for a, b in links) >= 0.99 * len(links)
    assert all(want[i] == want[c] for i, c in got.items())  # nothing else is linked


def test_stage_takes_near_copies_beyond_three_bits(spark):
    words = prose(1, 300)
    table = docs(spark, [(i, " ".join(edited(i, words, 3)), "a") for i in range(40)] + [(99, " ".join(prose(2, 300)), "a")])
    kept = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, table, "")
    assert sorted(r.doc_id for r in kept.collect()) == [0, 99]


def star(n=220, length=150):
    """A text and copies of it with 1 to 9 edits, copies of these, and texts cut at the end: links only in part over the first text."""
    words = prose(3, length, 400_000)
    rows = [words]
    for i in range(n):
        rows.append(edited(i, words, 1 + i % 9))
        if i % 6 == 0:
            rows.append(edited(50_000 + i, rows[-1], 2))
        if i % 10 == 0:
            rows += [words[: length * 7 // 10 - i % 9], words[i % 40 :] + prose(9_000 + i, 30)]
    return list(enumerate(rows))


def pairs_of(rows):
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in rows}
    ids = list(sets)
    return [(a, b) for n, a in enumerate(ids) for b in ids[:n] if 9 * len(sets[a] ^ sets[b]) <= len(sets[a]) + len(sets[b])]


def classes_of(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {i: find(i) for i in ids}


def test_star_family_against_all_pairs(spark):
    rows = star()
    links = pairs_of(rows)
    want = classes_of([i for i, _ in rows], links)
    got = {r.id: r.component for r in near_copies(docs(spark, [(i, " ".join(w), "a") for i, w in rows])).collect()}
    assert len(set(want.values())) > 40 and all(want[i] == want[c] for i, c in got.items())
    assert sum(got[a] == got[b] for a, b in links) >= 0.99 * len(links)


def test_pairs_compared_do_not_grow_with_the_square(spark):
    """A family of one centre: members that are similar to nothing are not compared with each other."""
    def compared(n):
        words = prose(3, 150, 400_000)
        rows = [(0, words), *((1 + i, edited(i, words, 4 + i % 6)) for i in range(n))]
        table = docs(spark, [(i, " ".join(w), "a") for i, w in rows])
        bands = _classes_rows(table)
        hub = hubs_of(table, bands)
        return _further(hub, spark.createDataFrame([], "node bigint, root bigint")).count()

    assert compared(200) <= 0.02 * 200 * 200 / 2


def _classes_rows(table):
    return {r.doc_id: (shingles(r.text), text_bands(r.text)) for r in table.collect()}


def hubs_of(table, bands):
    """What ``near_roots`` finds for one bucket of all members around the first."""
    first = bands[0][0]
    signed = lambda xs: [x - (1 << 64) if x >> 63 else x for x in xs]
    rows = [(i, 0, 9 * len(s ^ first) <= len(s) + len(first), len(s), len(first), signed(s ^ first)) for i, (s, _) in bands.items() if i]
    return table.sparkSession.createDataFrame(rows, "a bigint, b bigint, same boolean, size_a int, size_b int, apart array<bigint>")


def test_further_pairs_lose_none(spark):
    """Every similar pair not wholly on the hub's side is among the pairs to compare."""
    rows = star(150)
    table = docs(spark, [(i, " ".join(w), "a") for i, w in rows])
    bands = _classes_rows(table)
    met = hubs_of(table, bands)
    linked = {r.a for r in met.where("same").collect()} | {0}
    parts = spark.createDataFrame([(i, 0) for i in linked], "node bigint, root bigint")
    found = {(r.a, r.b) for r in _further(met, parts).collect()}
    wanted = {(b, a) for a, b in pairs_of(rows) if not (a in linked and b in linked)}
    known = {(0, r.a) for r in met.collect()}
    assert wanted - known <= found and len(wanted - known) > 20
    assert len(found) < len(rows) ** 2 / 8


def kept_hash(spark, text):
    return spark.sql("SELECT xxhash64(:t)", args={"t": text}).first()[0]


def test_awkward_rows(spark):
    kept = one_of_near_copies(awkward(spark))
    assert kept.columns == awkward(spark).columns
    ids = sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect())
    assert [i for none, i in ids if not none] == [1, 3, 4, 5, 6, 7] and ids[-1] == (True, 0)
    rows = [(None, " ".join(prose(i, 60)), "a") for i in range(6)] + [(7, " ".join(prose(10 + i, 60)), "a") for i in range(2)]
    assert one_of_near_copies(docs(spark, rows)).count() == 8  # texts that only share an id, or have none
    again = rows[6:] * 3 + [(7, rows[6][1] + " and more", "a"), (None, rows[6][1], "a")]
    assert sorted(r.text for r in one_of_near_copies(docs(spark, again)).collect()) == sorted([min(rows[6][1], rows[6][1] + " and more", key=lambda t: kept_hash(spark, t)), rows[7][1]])
    assert one_of_near_copies(empty(spark)).count() == 0 and near_copies(awkward(spark)).count() == 11


def _prints(table, spark):
    """(node, fp, segments) and the node of each id."""
    made = {r.doc_id: (kept_hash(spark, r.text), *wide_keys(wide_bits(list(shingles(r.text))))) for r in table.collect()}
    return spark.createDataFrame(list(made.values()), "node bigint, fp bigint, segments array<bigint>"), {i: m[0] for i, m in made.items()}


def test_fingerprints_and_their_segments_link_by_themselves(spark):
    """Without any least hashes, SimHash and its segment tables join most near copies, and nothing else."""
    rows = families()
    _, links = naive(rows)
    table = docs(spark, [(i, " ".join(w), "a") for i, w in rows])
    prints, node = _prints(table, spark)
    found = {(r.a, r.b) for r in fingerprint_links(prints, table).collect()}
    true = {tuple(sorted((node[a], node[b]), reverse=True)) for a, b in links}
    assert found and found <= true
    none = prints.select("node", F.array().cast("array<bigint>").alias("keys"))
    got = {r.node: r.root for r in near_roots(none, table, links=spark.createDataFrame(list(found), "a bigint, b bigint")).collect()}
    want = naive(rows)[0]
    joined = sum(got.get(node[a]) is not None and got.get(node[a]) == got.get(node[b]) for a, b in links)
    assert joined >= 0.9 * len(links)  # two pairs a text; least hashes find the rest
    assert all(want[a] == want[b] for a, b in links)


def test_least_hashes_skip_what_fingerprints_have_joined(spark):
    """A bucket of one component is not compared again; one of two is."""
    words = prose(1, 300)
    table = docs(spark, [(i, " ".join(edited(i, words, 1)), "a") for i in range(4)])
    _, node = _prints(table, spark)
    nodes = sorted(node.values())
    bands = spark.createDataFrame([(n, [7]) for n in nodes], "node bigint, keys array<bigint>")
    missing = docs(spark, [])  # no text can be compared
    links = spark.createDataFrame([(n, nodes[0]) for n in nodes[1:]], "a bigint, b bigint")
    assert {r.root for r in near_roots(bands, missing, links=links).collect()} == {nodes[0]}
    partly = near_roots(bands, table, links=links.limit(1)).collect()
    assert {r.root for r in partly} == {nodes[0]} and len(partly) == 4
