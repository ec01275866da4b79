import random
import re
import zlib
from collections import Counter

from tables import awkward, docs, empty

from evwarden.llm.variants import corpus_words, level_ends, near_words, spelling_variants, variant_table, words_of


def naive_words(rows):
    """Words with their counts, by code points."""
    out = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= 6 and n >= 5}


def one_edit(a, b):
    if len(a) < len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def naive_variants(words, ratio=5):
    near = {w: [v for v in words if v != w and one_edit(w, v)] for w in words}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-words[v], v.encode()), default=None)
        form[w] = best if best is not None and words[best] >= ratio * words[w] else None
    out = {}
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, words[w], len(near[w]), words.get(form[w]))
    return out


def letters(draw, alphabet, length):
    return "".join(draw.choice(alphabet) for _ in range(length))


def families(seed, n, alphabet, lengths):
    """Words and words one or two edits from them, many with runs of one letter and common beginnings."""
    draw, out = random.Random(seed), {}
    for _ in range(n):
        word = letters(draw, alphabet[:3], draw.choice(lengths) // 2) + letters(draw, alphabet, draw.choice(lengths) // 2 + 3)
        out[word] = draw.choice([5, 30, 200, 5_000])
        for _ in range(draw.randrange(4)):
            at = draw.randrange(len(word) + 1)
            word = draw.choice([word[:at] + word[at + 1 :], word[:at] + draw.choice(alphabet) + word[at:], word[:at] + draw.choice(alphabet) + word[at + 1 :]])
            out[word] = draw.choice([5, 30, 200, 5_000])
    return {w: c for w, c in out.items() if w}


def check(spark, words, **trie):
    table = spark.createDataFrame(list(words.items()), "word string, n bigint")
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling_variants(table, **trie).collect()}
    assert got == naive_variants(words)


def test_random_words_against_all_pairs(spark):
    check(spark, families(1, 90, "abcé", [2, 4, 8]))


def test_blocks_of_several_code_points(spark):
    """Levels of more than one code point from the second on, as very long words have them."""
    check(spark, families(2, 70, "abÿ", [2, 6, 20, 40]), single=2)


def test_hot_nodes_and_large_levels(spark):
    check(spark, families(3, 70, "abc", [6, 8, 10]), sent_edges=3, hot_words=4)


def test_very_long_words(spark):
    long = "ab" * 5_000
    words = {long: 100, long[:-1]: 7, long[1:]: 5, long[:6_000] + long[6_001:]: 6, long[:4_000] + "x" + long[4_001:]: 9, long + "b": 5, long * 2: 5}
    check(spark, words, single=6)
    assert len(level_ends(50_000)) < 50


def test_runs_of_one_letter(spark):
    words = {"a" * n: 5 for n in range(1, 30)}
    pairs = [(r.word, r.other) for r in near_words(spark.createDataFrame(list(words.items()), "word string, n bigint"), single=4).collect()]
    assert sorted(pairs) == sorted(("a" * n, "a" * m) for n in range(1, 30) for m in (n - 1, n + 1) if 1 <= m < 30)


def corpus():
    draw = random.Random(4)
    vocabulary = [letters(draw, "abcdeéÀ", draw.choice([4, 6, 7, 9])) for _ in range(60)]
    rows = []
    for i in range(300):
        words = [draw.choice(vocabulary[: draw.choice([5, 20, 60])]) for _ in range(60)]
        rows.append((i, " ".join(w.upper() if draw.random() < 0.1 else w for w in words) + ", x-ray×Œ 1st"))
    return rows


def test_words_and_losses(spark):
    rows = corpus()
    want = naive_words(rows)
    got = {r.word: r.n for r in corpus_words(docs(spark, [(i, t, "a") for i, t in rows])).collect()}
    assert got == want and len(want) > 60  # some have lost a letter often enough
    assert words_of(b"1", b"short no") == {}


def test_whole_operator(spark):
    rows = corpus()
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in variant_table(docs(spark, [(i, t, "a") for i, t in rows])).collect()}
    want = naive_variants(naive_words(rows))
    assert got == want and any(f for f, *_ in want.values())


def test_awkward_rows(spark):
    table = awkward(spark)
    assert variant_table(table).count() == 0 and variant_table(empty(spark)).count() == 0  # no word of six letters five times
    many = docs(spark, [(None, "singular plurals", None)] * 5 + [(3, "y" * 50_000, "a")] * 5 + [(4, None, "a")] * 5)
    got = {r.word: (r.form, r.root, r.n, r.n_near) for r in variant_table(many).collect()}
    rows = [(None, "singular plurals")] * 5 + [(3, "y" * 50_000)] * 5
    assert {w: v[2] for w, v in got.items()} == naive_words(rows) and all(v == (None, w, 5, 0) for w, v in got.items())
