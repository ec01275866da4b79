import math
import zlib
from collections import Counter

import pytest
from tables import awkward, docs, empty, prose

from evwarden.llm.lattice import Pieces, fit_pieces, lattice_scores, token_counts


def brute(scores, text):
    if not text:
        return 1.0
    return sum(math.exp(scores[text[:k]]) * brute(scores, text[k:]) for k in range(1, len(text) + 1) if text[:k] in scores)


def test_forward_recursion_sums_all_segmentations():
    scores = {bytes([b]): math.log(0.001) for b in range(256)}
    scores |= {p.encode(): math.log(w) for p, w in {"▁": 0.1, "▁a": 0.2, "ab": 0.3, "ba": 0.05, "aba": 0.02, "b": 0.2, "é": 0.1, "▁ab": 0.01}.items()}
    model = Pieces.build(scores, -1.0)
    for word in ("a", "abab", "bbaab", "é", "aéb", "zq"):
        assert model.log_probability(word) == pytest.approx(math.log(brute(scores, ("▁" + word).encode())), rel=1e-12)


def tokens(text):
    return [*(text or "").encode().lower().split(), b"\n"]


def is_held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1


def compare(rows, table):
    seen = Counter(t for r in table for t in tokens(r.text) if not is_held(r.doc_id))
    total, kinds = sum(seen.values()), len(seen)
    want = sorted(
        (r.doc_id or -1, len(tokens(r.text)), sum(seen[t] > 0 for t in tokens(r.text)),
         round(sum(math.log10((seen[t] + 0.5) / (total + 0.5 * (kinds + 1))) for t in tokens(r.text)), 6), is_held(r.doc_id))
        for r in table
    )
    assert sorted((r.id or -1, r.n_tokens, r.n_known, round(r.base_score, 6), r.held_out) for r in rows) == want
    assert {r.train_tokens for r in rows} == {total}


def test_scores_are_the_same_whether_tokens_are_sent_or_joined(spark):
    table = docs(spark, [(i, " ".join(prose(i % 37, i % 60, 400)), "a") for i in range(150)])
    few = lattice_scores(table, sent_tokens=3).collect()
    many = lattice_scores(table).collect()
    compare(few, table.collect())
    scores = {r.id: r.score for r in many}
    assert all(r.score == pytest.approx(scores[r.id], rel=1e-9) for r in few)


def test_document_score_is_that_of_its_words_and_end(spark):
    table = docs(spark, [(i, " ".join(prose(i, 30, 50)), "a") for i in range(40)])
    import pyspark.sql.functions as F

    from evwarden.llm.lattice import VOCABULARY, held_out

    model = fit_pieces(spark, token_counts(table.select("text", held_out(F.col("doc_id")).alias("held_out"))), VOCABULARY)
    assert sum(map(math.exp, model.scores.values())) + math.exp(model.end) == pytest.approx(1, abs=1e-6)
    texts = {r.doc_id: r.text for r in table.collect()}
    for r in lattice_scores(table).collect():
        want = (sum(model.log_probability(w) for w in texts[r.id].split()) + model.end) / math.log(10)
        assert r.score == pytest.approx(want, rel=1e-9)


def test_held_out_text_like_the_training_text_scores_better(spark):
    table = docs(spark, [(i, " ".join(prose(i, 40, 60)) if i < 150 else " ".join(f"q{j}x{i}z" for j in range(40)), "a") for i in range(160)])
    rows = lattice_scores(table).collect()
    like = [r.score / r.n_tokens for r in rows if r.held_out and r.id < 150]
    assert like and min(like) > max(r.score / r.n_tokens for r in rows if r.id >= 150)


def test_awkward_rows(spark):
    rows = lattice_scores(awkward(spark)).collect()
    compare(rows, awkward(spark).collect())
    assert all(math.isfinite(r.score) and r.score < 0 for r in rows)
    assert lattice_scores(empty(spark)).count() == 0
    held = [i for i in range(50) if is_held(i)][:2]
    only = lattice_scores(docs(spark, [(i, "some words", "a") for i in held])).collect()
    assert len(only) == 2 and all(r.train_tokens == 0 and r.n_known == 0 and math.isfinite(r.score) for r in only)
