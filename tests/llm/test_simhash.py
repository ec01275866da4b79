import random

import numpy as np
import xxhash
from tables import awkward, docs, empty, prose

from evwarden.llm.components import components
from evwarden.llm.simhash import fingerprint, fingerprint_components, one_of_each, simhash_duplicates


def naive_fingerprint(text):
    words = [w.lower() for w in text.encode().split()]
    runs = [words[i : i + 3] for i in range(len(words) - 2)] if len(words) >= 3 else ([words] if words else [])
    hashes = [xxhash.xxh64_intdigest(b" ".join(r), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def naive_components(fps, radius):
    fps = sorted(set(fps))
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if ((a ^ b) & (2**64 - 1)).bit_count() <= radius and find(a) != find(b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {f: find(f) for f in fps}


def test_fingerprint_is_the_majority_of_each_bit():
    for seed in range(20):
        text = " ".join(prose(seed, seed))
        assert fingerprint(text) % 2**64 == naive_fingerprint(text)
    assert fingerprint("") == 0 and fingerprint(" \n") == 0
    assert fingerprint("A B") == fingerprint("a b") != fingerprint("a b c")


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def clusters(seed, radius):
    """Chains, dense balls and values exactly at and just beyond the radius, some at both ends of the number range."""
    draw = random.Random(seed)
    out = set()
    for _ in range(12):
        centre = draw.getrandbits(64)
        out.add(centre)
        for d in (1, 2, radius, radius + 1, radius + 1):
            out.add(centre ^ sum(1 << b for b in draw.sample(range(64), d)))
        chain = centre
        for _ in range(4):
            chain ^= sum(1 << b for b in draw.sample(range(64), radius))
            out.add(chain)
    dense = draw.getrandbits(64)
    bits = draw.sample(range(64), 9)
    out |= {dense ^ sum(1 << b for b in draw.sample(bits, draw.randrange(1, 7))) for _ in range(120)}
    return [signed(x) for x in out | {0, 7, 2**64 - 1, 2**64 - 8, 1 << 63}]


def test_components_hold_every_link(spark):
    for seed, radius, bucket in ((1, 3, 64), (2, 3, 1), (3, 3, 4), (4, 5, 2)):
        fps = clusters(seed, radius)
        got = {r.fp: r.root for r in fingerprint_components(spark.createDataFrame([(f,) for f in fps], "fp long"), radius, bucket).collect()}
        want = naive_components(fps, radius)
        for f in fps:
            assert got.get(f, f) == want[f], (seed, f)


def test_links_that_only_a_split_bucket_finds(spark):
    """Sparse values three bits apart that share half their bits with very many others."""
    draw = random.Random(9)
    low = 0x0F0F0F0F
    codes = []
    while len(codes) < 60:
        c = draw.getrandbits(32)
        if all((c ^ d).bit_count() > 6 for d in codes):
            codes.append(c)
    fps = [signed(c << 32 | low) for c in codes] + [signed((c ^ 0b111 << draw.randrange(29)) << 32 | low) for c in codes[:30]]
    got = {r.fp: r.root for r in fingerprint_components(spark.createDataFrame([(f,) for f in fps], "fp long"), 3, 8).collect()}
    want = naive_components(fps, 3)
    assert {f: got.get(f, f) for f in fps} == want
    assert len(set(want.values())) == 60


def test_components_of_long_chains_and_no_edges(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (200, 200), (None, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_documents(spark):
    words = prose(5, 400)
    near = [*words[:200], "changed", *words[201:]]
    table = docs(spark, [(10, " ".join(words), "a"), (4, " ".join(words).upper(), "b"), (7, " ".join(near), "a"), (5, " ".join(prose(6, 300)), "a"), (2, None, "a"), (3, "", "b")])
    rows = {r.id: r for r in simhash_duplicates(table).collect()}
    assert rows[10].fp == rows[4].fp and rows[10].component == 4 and rows[4].component == 4
    assert rows[5].component == 5 and rows[2].component == rows[3].component == 2 and rows[2].fp == 0
    apart = (rows[10].fp ^ rows[7].fp) & (2**64 - 1)
    assert (rows[7].component == 4) == (apart.bit_count() <= 3)


def test_one_of_each(spark):
    kept = one_of_each(awkward(spark))
    assert kept.columns == awkward(spark).columns
    ids = sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect())
    assert [i for none, i in ids if not none] == [1, 3, 4, 5, 6, 7] and ids[-1] == (True, 0)
    assert one_of_each(empty(spark)).count() == 0 and simhash_duplicates(empty(spark)).count() == 0


def test_repeated_rows_stay(spark):
    assert simhash_duplicates(awkward(spark)).count() == 11


def test_bits_are_counted_over_blocks():
    text = " ".join(np.random.default_rng(1).integers(0, 50, 40_000).astype(str))
    assert fingerprint(text) % 2**64 == naive_fingerprint(text)
