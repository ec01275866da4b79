import math
import random
import re
import time

from tables import awkward, docs, empty, prose

from evwarden.llm.disclosure import base_spans, entities_of, private_spans, spans_text, without_disclosure


def naive(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub(r"\D", "", m[0])
        total = sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(reversed(digits)))
        if 12 <= len(digits) <= 19 and total % 10 == 0:
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub(r"\D", "", m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def test_base_spans_are_those_of_the_patterns():
    draw = random.Random(1)
    parts = ["a", "@", "b.c", ".", "1", "22", "300", "-", " ", "+", "4", "(", "é", "x@y.z", "4111 1111 1111 1111", "+1 (555) 123-4567", "٣"]
    for _ in range(20_000):
        text = "".join(draw.choice(parts) for _ in range(draw.randrange(40)))
        assert base_spans(text) == naive(text), text


def test_long_texts_take_linear_time():
    began = time.time()
    for text in ("a" * 300_000, "@" * 300_000, "1" * 300_000, "1.1." * 90_000, "+1((" * 90_000, "a@b." * 90_000, "9" * 5_000 + ".1.1.1"):
        base_spans(text)
    assert time.time() - began < 20


def corpus(spark):
    rows = []
    for i in range(12):  # one term always stands near one address, in surroundings of its own
        rows.append((i, f"{' '.join(prose(i, 20))} alpha{chr(97 + i)} Zanzibar mail joe@site.org beta{chr(97 + i)} " + " ".join(prose(90 + i, 20)) + " Zanzibar", "a"))
    rows += [(100 + i, f"mail the {' '.join(prose(500 + i, 30))}", "a") for i in range(60)]
    rows += [(200, "Zanzibar and nothing private", "a"), (201, "other@site.org Zanzibarx mail", "a")]
    rows += [(300 + i, "copied words Quagga near kim@site.org here", "a") for i in range(9)]
    return docs(spark, rows)


def test_terms_that_reveal_an_address_are_marked_where_it_stands(spark):
    rows = {r.id: r for r in private_spans(corpus(spark)).collect()}
    texts = {r.doc_id: r.text for r in corpus(spark).collect()}
    for i in range(12):
        spans = [s.split(":") for s in rows[i].spans.split(",")]
        terms = [texts[i][int(a) : int(b)] for k, a, b in spans if k == "term"]
        assert terms == ["Zanzibar", "Zanzibar"] and [s for s in spans if s[0] != "term"] == [rows[i].base.split(":")]
    assert rows[200].spans == "" and rows[100].spans == ""
    assert all(rows[i].spans == rows[i].base for i in range(300, 309))  # copies are no evidence
    assert all(r.base == spans_text(naive(texts[i])) for i, r in rows.items())


def naive_spans(rows, support=3, disclosed=0.9):
    """All spans of each row by loops over pairs of entity and term; texts are near copies only if equal."""
    texts = {i: t or "" for i, t in rows}
    held, terms, where = {}, {}, {}
    for i, text in texts.items():
        base = naive(text)
        held[i] = {e for a, k, b in base for e in entities_of(k, text[a:b])}
        where[i] = [m for m in re.finditer(r"[^\W\d_][\w'-]{2,}", text) if not any(a < m.end() and m.start() < b for a, _, b in base)]
        terms[i] = {m[0].lower() for m in where[i]}
    anywhere = {i: {w.lower() for w in re.findall(r"[^\W\d_][\w'-]{2,}", t)} for i, t in texts.items()}
    shown = {}
    for e in {e for es in held.values() for e in es}:
        holders = [i for i in texts if e in held[i]]
        if len(holders) == len(texts):
            continue
        for t in {t for i in holders for t in terms[i]}:
            both = [i for i in holders if t in terms[i]]
            if len({texts[i] for i in both}) < support:
                continue
            n_t = sum(t in a for a in anywhere.values())
            share = math.log(len(texts) * len(both) / (len(holders) * n_t)) / math.log(len(texts) / len(holders))
            if share >= disclosed:
                shown.setdefault(e, set()).add(t)
    out = {}
    for i, text in texts.items():
        marked = {t for e in held[i] for t in shown.get(e, ())}
        spans = sorted([*naive(text), *((m.start(), 4, m.end()) for m in where[i] if m[0].lower() in marked)])
        out[i] = spans_text(spans)
    return out


def test_share_and_threshold_against_loops(spark):
    draw = random.Random(7)
    people = ["ann", "bob", "cyd"]
    rows = []
    for i in range(160):
        words = [f"w{draw.randrange(60)}ord" for _ in range(draw.randrange(3, 14))]
        if draw.random() < 0.4:
            who = draw.choice(people)
            words += [f"{who}{draw.randrange(3)}@{who}.example", draw.choice([who + "son", "filler", who + "burg"])]
        if draw.random() < 0.2:
            words += [f"10.0.{draw.randrange(2)}.{draw.randrange(9)}", draw.choice(["router", "filler", "rack" + "x" * 90])]
        if draw.random() < 0.1:
            words += ["annson", "router"][: draw.randrange(3)]
        draw.shuffle(words)
        rows.append((i, " ".join(words)))
    rows += [(200 + i, rows[3][1]) for i in range(6)] + [(300, None), (301, "")]
    want = naive_spans(rows)
    got = {r.id: r.spans for r in private_spans(docs(spark, [(i, t, "a") for i, t in rows])).collect()}
    assert got == want and sum("term" in s for s in want.values()) > 20


def test_sanitised_texts(spark):
    out = without_disclosure(corpus(spark))
    assert out.columns == corpus(spark).columns
    texts = {r.doc_id: r.text for r in out.collect()}
    assert "[TERM] mail [EMAIL]" in texts[0] and "Zanzibar" not in texts[0] and texts[200] == "Zanzibar and nothing private"


def test_awkward_rows(spark):
    rows = private_spans(awkward(spark)).collect()
    assert len(rows) == 11 and all(r.spans == r.base == "" for r in rows)
    assert private_spans(empty(spark)).count() == 0 and without_disclosure(empty(spark)).count() == 0
    assert [r.text for r in without_disclosure(awkward(spark)).where("doc_id = 1").collect()] == [None]
    twice = private_spans(docs(spark, [(1, "a@b.cd", "x"), (1, "a@b.cd", "x"), (None, "1.2.3.4", "x")])).collect()
    assert sorted(r.base for r in twice) == ["email:0:6", "email:0:6", "ip:0:7"]
