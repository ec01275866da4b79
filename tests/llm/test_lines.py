import random
import re
from collections import Counter, defaultdict

from tables import awkward, docs, empty, prose

from evwarden.llm.lines import base_counts, kept_documents, line_rules


def naive(text):
    words = text.encode().split()
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    lines = [x for x in text.split("\n") if x.encode().split()]
    return {
        "n_words": len(words), "word_chars": sum(len(w.decode()) for w in words), "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_dup_lines": sum(x in lines[:i] for i, x in enumerate(lines)), "n_repeat_words": len(covered),
    }


def test_base_counts():
    texts = ["", " \n", "a", "a a a a", "a b c a b c d", "x\ny\nx\n\nx ", "é# ü ß <b>&", "a b a b a b a", "one two three\none two three\nfour"]
    for text in [*texts, " ".join(prose(1, 300, 6)), "\n".join(prose(2, 100, 9))]:
        counts = base_counts(text)
        assert {k: counts[k] for k in naive(text)} == naive(text), text


def corpus(spark):
    rows = []
    for i in range(30):  # half of each of these is a line that they share with all others of their host
        own = " ".join(prose(i, 60))
        rows.append((i, own + "\nShared LINE  number 7 of the host\n" + " ".join(prose(1000 + i, 20)), "h"))
    long_line = " ".join(prose(77, 90))
    rows += [(100 + i, " ".join(prose(200 + i, 55)) + f"\n{long_line}", "deep") for i in range(12)]
    rows += [(200 + i, " ".join(prose(300, 80)) + "\n" + " ".join(prose(301, 80)), "copies") for i in range(20)]
    near = prose(302, 200)
    rows += [(300 + i, " ".join(near[:100]) + "\n" + " ".join([*near[100:150], f"e{i}", *near[151:]]), "near") for i in range(20)]
    rows += [(400 + i, f"shared line number {i} of the host\n" + " ".join(prose(400 + i, 60)), "few") for i in range(5)]
    return docs(spark, rows)


def test_shared_lines_go_and_depleted_documents_are_rejected(spark):
    rows = {r.id: r for r in line_rules(corpus(spark)).collect()}
    assert all(rows[i].kept and rows[i].removed_words == 7 for i in range(30))
    assert all(not rows[100 + i].kept and rows[100 + i].removed_words == 90 for i in range(12))
    assert all(rows[i].kept and rows[i].removed_words == 0 for b in (200, 300) for i in range(b, b + 20))  # copies are one document
    assert all(rows[400 + i].kept and rows[400 + i].removed_words == 0 for i in range(5))


def test_kept_documents_lose_the_lines(spark):
    table = corpus(spark)
    kept = kept_documents(table)
    assert kept.columns == table.columns
    texts = {r.doc_id: r.text for r in kept.collect()}
    assert texts[3] == " ".join(prose(3, 60)) + "\n" + " ".join(prose(1003, 20))
    assert 105 not in texts and len(texts) == 30 + 20 + 20 + 5


def test_awkward_rows(spark):
    rows = line_rules(awkward(spark)).collect()
    assert len(rows) == 11 and sum(r.id == 4 for r in rows) == 2
    by = {r.id: r for r in rows}
    assert by[1].n_words == by[2].n_words == by[9].n_words == 0 and by[1].base_failed and not by[1].kept
    assert by[6].base_failed and by[6].n_repeat_words == 20_000  # all one word
    assert line_rules(empty(spark)).count() == 0 and kept_documents(empty(spark)).count() == 0
    many = docs(spark, [(1, " ".join(prose(1, 80)), None)] * 3)
    assert kept_documents(many).count() == 3


def common_parts(i, common, own):
    """Documents of which ``common`` words are two lines that all share and ``own`` words are their own."""
    shared = prose(5_000, common)
    return "\n".join([" ".join(shared[: common // 2]), " ".join(prose(6_000 + i, own, 400_000)), " ".join(shared[common // 2 :])])


def test_common_lines_go_whatever_their_share_of_the_documents(spark):
    sizes = [(c, o, seed) for c, o in ((60, 140), (60, 60), (90, 60), (60, 20), (150, 50)) for seed in range(2)]
    rows = [(100 * k + i, common_parts(100 * k + i, c, o), f"h{k}") for k, (c, o, _) in enumerate(sizes) for i in range(40)]
    for r in line_rules(docs(spark, rows)).collect():
        assert r.removed_words == sizes[r.id // 100][0], sizes[r.id // 100]


def test_near_copies_count_as_one_beside_others(spark):
    base = prose(7_000, 150)
    line = "a line that all of them have"
    rows = []
    for host, others in (("ten", 9), ("eleven", 10)):
        rows += [(i, "\n".join([" ".join(base[:100]), line, " ".join([*base[100:140], f"e{i}", *base[141:]])]), host) for i in range(30)]
        rows += [(100 + i, f"{line}\n" + " ".join(prose(7_100 + i, 80, 400_000)), host) for i in range(others)]
    assert all(r.removed_words == (7 if r.host == "eleven" else 0) for r in line_rules(docs(spark, rows)).collect())


def random_hosts(seed):
    """Hosts of documents made of a few common lines, own lines and copies with edits."""
    draw = random.Random(seed)
    rows = []
    for host in ("a", "b", None):
        common = [" ".join(prose(draw.randrange(10**6), draw.choice([4, 12, 60]))) for _ in range(6)]
        for _ in range(45):
            own = [" ".join(prose(draw.randrange(10**6), draw.choice([20, 50, 90]), 400_000)) for _ in range(draw.choice([1, 2]))]
            lines = own + draw.sample(common, draw.choice([0, 1, 2, 4]))
            draw.shuffle(lines)
            text = "\n".join(lines)
            for _ in range(draw.choice([1, 1, 1, 2, 6])):
                words = text.split(" ")
                words[draw.randrange(len(words))] = f"e{draw.randrange(10**6)}"
                rows.append((len(rows), text if draw.random() < 0.5 else " ".join(words), host))
    return rows


def naive_verdicts(rows, limit):
    """Words to remove of each document: lines of more than ``limit`` groups of near copies of one host."""
    def form(line):
        return " ".join(re.sub("[0-9]", "0", line.lower()).split())

    sets = {i: {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} for i, w in ((i, t.lower().split()) for i, t, _ in rows)}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in range(a):
            if 9 * len(sets[a] ^ sets[b]) <= len(sets[a]) + len(sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    seen = defaultdict(set)
    for i, t, host in rows:
        for line in t.split("\n"):
            seen[host, form(line)].add(find(i))
    return {i: sum(len(x.split()) for x in t.split("\n") if form(x) and len(seen[host, form(x)]) > limit) for i, t, host in rows}


def test_line_verdict_on_random_hosts(spark):
    for seed in (1, 2):
        rows = random_hosts(seed)
        want = naive_verdicts(rows, 7)
        got = {r.id: r for r in line_rules(docs(spark, rows), max_documents=7).collect()}
        assert {i: r.removed_words for i, r in got.items()} == want and len({n > 0 for n in want.values()}) == 2
        assert all(r.kept == (not r.base_failed and 2 * r.removed_words <= r.n_words) for r in got.values())
