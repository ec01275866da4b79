import hashlib

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from tables import awkward, docs, empty, prose

from evwarden.llm.fill_middle import arranged, draws, fill_in_middle, middle_digests, rearranged, restore, restored, rotate


def naive(key, text):
    """n, form, prefix_chars, middle_chars and output by slices of code points."""
    h = [int(hashlib.sha256(f"1:{key}".encode()).hexdigest()[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(text)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = text[:a], text[a:b], text[b:]
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", a, b - a, f"<P>{pre}<S>{suf}<M>{mid}"


def test_rotation_is_that_of_slices():
    draw = np.random.default_rng(1)
    for _ in range(300):
        data = bytes(draw.integers(0, 256, draw.integers(0, 40), np.uint8))
        start, middle, end = sorted(draw.integers(0, len(data) + 1, 3).tolist())
        block = bytearray(data)
        rotate(block, start, middle, end)
        assert bytes(block) == data[:start] + data[middle:end] + data[start:middle] + data[end:]


@given(st.text(alphabet="aé€😀<PSM>\n", max_size=40), st.integers(0, 10_000))
def test_round_trip(text, key):
    row = arranged(text.encode(), str(key))
    assert (row["n"], row["form"], row["prefix_chars"], row["middle_chars"], row["output"].decode()) == naive(key, text)
    assert restored(row["output"], row["form"]) == text.encode()


@pytest.mark.parametrize("form", ["psm", "spm"])
def test_every_cut_of_pieces_of_sentinels(form):
    text = b"<P<S<M<PS>>P><"
    for a in range(len(text) + 1):
        for b in range(a, len(text) + 1):
            assert restored(rearranged(text, a, b, form), form) == text


def test_table_against_slices(spark):
    rows = [(i, " ".join(prose(i, 30)) + " é€😀 " * (i % 3), "a") for i in range(400)] + [(500, "has <S> in it", "a")]
    table = docs(spark, rows)
    out = {r.id: r for r in restore(fill_in_middle(table)).collect()}
    for i, text, _ in rows:
        r = out[i]
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == naive(i, text) and r.restored == text
    forms = [r.form for r in out.values()]
    assert 10 < forms.count("plain") < 90 and 30 < forms.count("spm") < 130
    assert [(r.output, r.form) for r in fill_in_middle(table, percent=0).collect()] == [(t, "plain") for _, t, _ in rows]
    assert {r.form for r in fill_in_middle(table, percent=100, suffix_first=0).collect()} == {"psm", "plain"}


def test_awkward_rows(spark):
    rows = middle_digests(awkward(spark)).collect()
    assert len(rows) == 11 and middle_digests(empty(spark)).count() == 0
    none = [r for r in rows if r.doc_id is None]
    assert len(none) == 1 and none[0].n == len("no id here at all")
    by = {r.doc_id: r for r in rows}
    assert by[1].form == by[2].form == "plain" and by[1].n == 0 and by[1].output_sha256 == hashlib.sha256(b"").hexdigest()
    assert len({r.output_sha256 for r in rows if r.doc_id == 4}) == 1 and sum(r.doc_id == 4 for r in rows) == 2
    texts = {r.doc_id: r.text or "" for r in awkward(spark).collect()}
    assert all(r.restored_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() for r in rows)
    extra = restore(spark.createDataFrame([("<P><S>b<M>a", "psm", 1, "x"), (None, "psm", 2, "y")], "output string, form string, id int, restored string"))
    assert [r.restored for r in extra.orderBy("id").collect()] == ["ab", None]


def test_draws_depend_on_seed_and_key():
    assert draws("7") == draws("7") != draws("8") and draws("7", "2") != draws("7")
