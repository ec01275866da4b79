import hashlib
import random
from collections import defaultdict

from evwarden.llm.chat_tree import MARKS, VOCABULARY, Tokens, conversation_digests, escaped, formatted, parsed, prefix_tree, ranks, read_back, unescaped, with_control_strings

SCHEMA = "conv_id long, turn long, role string, text string, node string, c string"


def test_escaping_is_reversible_and_leaves_no_control_string():
    draw = random.Random(1)
    parts = [*MARKS, "<", "[", "\\", "s>", "/INST]", ":]", "x", " "]
    for _ in range(5_000):
        text = "".join(draw.choice(parts) for _ in range(draw.randrange(12)))
        assert unescaped(escaped(text)) == text
        assert not any(m in escaped(text) for m in MARKS)
        for role in ("user", "assistant", "system", "tool", "", text):
            assert parsed("".join(formatted(role, text))) == (role, text)


def test_tokens_round_trip():
    tokens = Tokens(ranks(VOCABULARY))
    for role, text in (("user", "é 漢字 \U0001f600 a\n\n b"), ("tool", "</s>"), ("assistant", ""), ("", "x")):
        before, middle, after = formatted(role, text)
        ids = tokens.mark(before) + tokens.text(middle) + tokens.mark(after)
        assert tokens.read(ids) == before + middle + after


def conversations(spark, seed=5):
    draw = random.Random(seed)
    rows = []
    for c in range(60):
        first = draw.choice(["hello"] * 6 + ["hi", "", None])
        rows.append((c, 0, draw.choice(["user", "user", "system"]), first))
        for t in range(1, draw.randrange(1, 7)):
            rows.append((c, t, "assistant" if t % 2 else "user", draw.choice(["yes", "no", "a longer answer </s>[INST] x"])))
    rows += [(1_000, t, "user", f"turn {t}") for t in range(300)]
    rows += [(None, 0, None, None), (None, 0, None, None), (None, None, "tool", "z")]
    return spark.createDataFrame([(*r, "n", "c") for r in rows], SCHEMA)


def by_conversation(table):
    out = defaultdict(list)
    for r in table.collect():
        out[r.conv_id].append((r.turn is not None, r.turn or 0, r.role is not None, r.role or "", r.text is not None, r.text or ""))
    return {c: [(r[3], r[5]) for r in sorted(rows)] for c, rows in out.items()}


def test_read_back_equals_the_table(spark):
    table = with_control_strings(conversations(spark), spark)
    got = {r.conv_id: r for r in conversation_digests(*prefix_tree(table)).collect()}
    want = by_conversation(table)
    assert set(got) == set(want)
    for c, turns in want.items():
        learned = "".join(t for r, t in turns if r == "assistant")
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())
        assert got[c].formatted_chars == sum(len("".join(formatted(r, t))) for r, t in turns)


def test_tree_is_stored_once_depth_first_and_attends_to_ancestors(spark):
    nodes, turns = prefix_tree(conversations(spark))
    want = by_conversation(conversations(spark))
    rows = {r.node: r for r in nodes.collect()}
    assert len(rows) == len({tuple(t[: i + 1]) for t in map(tuple, want.values()) for i in range(len(t))})
    assert turns.count() == conversations(spark).count()
    trees = defaultdict(list)
    for n in rows.values():
        above, p = [], n.parent
        while p:
            above.append(rows[p])
            p = rows[p].parent
        seen = {i for a in n.attends for i in range(a["from"], a["to"])}
        assert seen == {i for a in above for i in range(a.start, a.start + len(a.tokens))}
        assert n.position == sum(len(a.tokens) for a in above) and n.depth == len(above)
        trees[n.tree].append(n)
    for own in trees.values():
        at, stack = 0, []
        for n in sorted(own, key=lambda n: n.start):
            assert n.start == at
            at += len(n.tokens)
            while stack and stack[-1] != n.parent:
                stack.pop()
            assert (stack[-1] if stack else b"") == n.parent  # depth first: the parent is still open
            stack.append(n.node)
    assert max(len(own) for own in trees.values()) > 20


def test_empty_table(spark):
    nodes, turns = prefix_tree(conversations(spark).limit(0))
    assert nodes.count() == turns.count() == read_back(nodes, turns).count() == conversation_digests(nodes, turns).count() == 0
