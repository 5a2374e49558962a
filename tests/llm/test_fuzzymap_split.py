import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from slicelake.llm import fuzzymap as M
from slicelake.llm import split as P


def lev(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


@given(st.lists(st.text("ACG", min_size=1, max_size=7), min_size=1, max_size=20), st.text("ACGN", max_size=8), st.integers(0, 3))
@settings(deadline=None)
def test_trie_finds_every_entry_within_the_distance(entries, word, limit):
    want = {e: d for e in set(entries) if (d := lev(word, e)) <= limit}
    assert M.Trie(entries).within(word, limit) == want


def test_aliases_lead_to_their_entry():
    t = M.Trie(["Copenhagen", "Oslo"], [("Kobenhavn", "Copenhagen"), ("Christiania", "Oslo")])
    assert t.within("Kobenhaven", 2) == {"Copenhagen": 1} and t.within("Oslo", 0) == {"Oslo": 0}
    assert [M.by_length(n) for n in (3, 5, 8, 20)] == [0, 1, 2, 3]


@pytest.mark.parametrize("typed", ["cact-tgct", " C A C T T G C T", "5'-CACTTGCT-3'", "ＣＡＣＴＴＧＣＴ", "CACTTGCT (tube 11)", "Barcode CACTTGCT", "bc: CACTTGCT", "no. 42 = CACTTGCT", "#CACTTGCT", "Cacttgct.", "CAC_TTG_CT", "CACTTGCT\t", "cacttgct\r", "CACT TGCT (old list)"])
def test_layout_is_no_change(typed):
    assert M.barcode_letters(typed) == "CACTTGCT"


def test_letters_within_are_kept():
    assert M.barcode_letters("  A 7 A C A G A C") == "A7ACAGAC" and M.barcode_letters("CCUNC4AA") == "CCUNC4AA" and M.barcode_letters("??") == ""


def mapped(spark, values, entries, **kw):
    rows = spark.createDataFrame([("t", i, v) for i, v in enumerate(values)], "source_table string, row_id long, value string")
    ref = spark.createDataFrame([(e,) for e in entries], "barcode string")
    return {r["row_id"]: r["entry"] for r in M.nearest_entries(rows, ref, "barcode", **kw).collect()}


def test_unique_nearest_or_unmatched_in_one_block_or_many(spark):
    random.seed(4)
    entries = ["".join(random.choices("ACGT", k=8)) for _ in range(60)] + [None, ""]
    values = ["".join(random.choices("ACGTN", k=random.choice((5, 7, 8, 8, 9, 10)))) for _ in range(150)] + [e for e in entries if e][:20] + ["", None, "x" * 5000, "see notebook"]
    known = [e for e in entries if e]
    want = {}
    for i, v in enumerate(values):
        if v is None:
            continue
        w = M.barcode_letters(v)
        near = sorted((lev(w, e), e) for e in set(known) if abs(len(w) - len(e)) <= 2)
        near = [x for x in near if x[0] <= 2 and x[0] == near[0][0]]
        want[i] = near[0][1] if len(near) == 1 else M.UNMATCHED
    assert mapped(spark, values, entries) == want
    assert mapped(spark, values, entries, max_block=25) == want
    assert set(mapped(spark, ["ACGT"], [None]).values()) == {M.UNMATCHED}


@pytest.mark.parametrize("most", [1000, 40, 7])
def test_all_candidates_in_one_trie_or_a_divided_one(spark, most):
    r = random.Random(6)
    entries = ["pre" + "".join(r.choices("abc", k=r.randint(1, 9))) for _ in range(120)] + ["a", "ab"]
    aliases = [("x" + e[:6], e) for e in entries[:20]]
    words = ["".join(r.choices("abcxpre", k=r.randint(0, 12))) for _ in range(40)] + [e[:-1] + "c" for e in entries[:40]] + entries[:5] + ["", "pre" * 400]
    want = {}
    for w in words:
        near = {}
        for path, e in [(e, e) for e in entries] + aliases:
            if abs(len(path) - len(w)) <= 3 and (d := lev(w, path)) <= M.by_length(len(w)):
                near[e] = min(d, near.get(e, 9))
        want[w] = sorted((d, e) for e, d in near.items())
    df = spark.createDataFrame([(w, i) for i, w in enumerate(words + words[:3])] + [(None, -1)], "value string, extra int")
    ref, also = spark.createDataFrame([(e,) for e in entries + [None, ""]], "e string"), spark.createDataFrame(aliases, "alias string, entry string")
    got = M.candidates(df, ref, "e", also, letters=str, max_block=most).collect()
    assert len(got) == len(words) + 3 and all([tuple(n) for n in g["near"]] == want[g["value"]] for g in got)
    assert M.candidates(df.limit(0), ref, "e", max_block=most).count() == 0


def slow_furthest(data, limit, k):
    """The rule read line by line."""
    n = len(data)
    lines = [i for i in range(n) if i == 0 or data[i - 1] == 10]
    recs = [a for j, a in enumerate(lines) if data[a] == 64 and j + 2 < len(lines) and data[lines[j + 2]] == 43]
    out, s, p = [], 0, 0
    while True:
        if n - s <= limit:
            return out + [(s, n)]
        first = [r for r in recs if p < r <= s + limit]
        second = [x for x in lines if p < x <= s + limit]
        e = first[-1] if first else second[-1] if second else s + limit
        out.append((s, e))
        nxt = e
        if first and k > 0:
            inside = [r for r in recs if s < r < e]
            if inside:
                nxt = inside[-k] if len(inside) >= k else inside[0]
        s, p = nxt, e


@given(st.text("@+A\n", min_size=1, max_size=200), st.integers(1, 60), st.integers(0, 3))
@settings(deadline=None, max_examples=300)
def test_exact_parameters_match_the_rule(text, limit, k):
    assert P.content_defined(text.encode(), limit, k, **P.EXACT) == slow_furthest(text.encode(), limit, k)


def fastq(n, seed=0):
    r = random.Random(seed)
    return "".join(f"@N:{i}\n{(s := ''.join(r.choices('ACGT', k=r.randint(5, 60))))}\n+\n{'I' * len(s)}\n" for i in range(n)).encode()


@pytest.mark.parametrize("overlap", [0, 2])
def test_content_defined_pieces_cover_within_limit_and_are_local(overlap):
    data = fastq(400)
    pieces = P.content_defined(data, 2000, overlap)
    assert pieces[0][0] == 0 and pieces[-1][1] == len(data)
    assert all(b - a <= 2000 for a, b in pieces) and all(x[1] >= y[0] for x, y in zip(pieces, pieces[1:]))
    records = set(P.boundaries(data)[0].tolist())
    assert all(a in records for a, _ in pieces)
    edited = data[:10_000] + b"A" + data[10_000:]
    texts, after = {data[a:b] for a, b in pieces}, {edited[a:b] for a, b in P.content_defined(edited, 2000, overlap)}
    assert len(texts - after) <= 4 < len(texts)
    if overlap:
        starts = sorted(records)
        assert all(sum(a <= r < b for r in starts) == overlap for (a, _), (_, b) in zip(pieces[1:], pieces))
    # an overlap costs room only for its own records
    assert len(pieces) < 2.2 * len(data) / 1000
    assert P.content_defined(b"", 10, 0) == [] and P.content_defined(b"x" * 95, 10, 0)[-1][1] == 95


def test_prescribed_pieces_are_cut_at_landmarks_of_the_rolling_hash(monkeypatch):
    data, hashed, rolled = fastq(200), [], P._rolled
    monkeypatch.setattr(P, "_BLOCK", 1000)
    monkeypatch.setattr(P, "_rolled", lambda a, window: hashed.append(len(a)) or rolled(a, window))
    pieces = P.content_defined(data, 2000, 2, **P.EXACT)
    assert pieces == slow_furthest(data, 2000, 2) and sum(hashed) >= len(data) and max(hashed) <= 1001
    assert {b for _, b in pieces[:-1]} <= set(P.openings(data)[0].tolist())
    # a hash that marks nothing leaves nothing but the limit
    monkeypatch.setattr(P, "_rolled", lambda a, window: np.zeros(len(a), dtype=np.uint64))
    assert P.content_defined(data, 2000, 2, **P.EXACT) == [(i, min(i + 2000, len(data))) for i in range(0, len(data), 2000)]


@given(st.binary(max_size=200), st.integers(32, 60))
@settings(deadline=None, max_examples=200)
def test_hashes_and_openings_of_any_bytes_whatever_the_block(data, block):
    data, whole, old = data.replace(b"\x07", b"\n"), P.rolling_hash(data.replace(b"\x07", b"\n")), P._BLOCK
    try:
        P._BLOCK = block
        places, opened = P.openings(data)
        assert places.tolist() == [i for i in range(1, len(data)) if data[i - 1] == 10] and opened.tolist() == [data[i] for i in places]
        assert (P.rolling_hash(data) == whole).all() and P.landmarks(data, 3).tolist() == [i + 1 for i, h in enumerate(whole.tolist()) if h % 3 == 0]
    finally:
        P._BLOCK = old


def test_split_files_edges(spark):
    big = fastq(50).decode()
    rows = [(1, big, len(big), 500, 1), (2, None, 900, 5, 0), (3, "", 0, 5, 0), (4, big, len(big), 10**6, 0), (5, big, len(big), None, 0), (6, "ab\ncd", 5, 2, None), (7, big, len(big), 0, 1)]
    df = spark.createDataFrame(rows, "file_id long, content string, n_bytes long, size_limit int, overlap_records int")
    got = [tuple(r) for r in P.split_files(df, **P.EXACT).orderBy("file_id", "chunk_start").collect()]
    assert {g[0] for g in got} == {1, 6} and [g[1:] for g in got if g[0] == 6] == [(0, 2), (2, 3), (3, 5)]
    assert [g[1:] for g in got if g[0] == 1] == slow_furthest(big.encode(), 500, 1)
    assert P.split_files(df.limit(0)).count() == 0
    report = P.piece_report(df, P.split_files(df)).collect()
    assert {(r["file_id"], r["covered"], r["within_limit"], r["gaps"], r["progress"]) for r in report} == {(1, len(big), True, 0, True), (6, 5, True, 0, True)}


@given(st.text("@+A\n", min_size=1, max_size=300), st.integers(1, 60), st.integers(0, 3), st.sampled_from(["first", "last"]), st.integers(1, 9))
@settings(deadline=None, max_examples=200)
def test_pieces_always_cover_and_move_on(text, limit, k, take, spacing):
    pieces = P.content_defined(text.encode(), limit, k, spacing=spacing, take=take)
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text) and all(0 < b - a <= limit for a, b in pieces)
    assert all(a < c <= b < d for (a, b), (c, d) in zip(pieces, pieces[1:]))


def test_blocks_answer_each_row_by_its_own_value(spark):
    values = spark.createDataFrame([("a", 1, "ACGTACGA"), ("a", 1, "ACGTACGA"), ("a", 1, "TTTTTTGG"), ("b", 2, "GGGGGGGG"), ("b", 3, None), ("b", 4, "")], "source_table string, row_id long, value string")
    listed = spark.createDataFrame([("ACGTACGT",), ("TTTTTTTT",), ("CCCCCCCC",)], "entry string")
    aliases = spark.createDataFrame([("GGGGGGGA", "CCCCCCCC")] + [("NNNNNNN" + c, "TTTTTTTT") for c in "ACGTNU"], "alias string, entry string")
    want = [("a", 1, "ACGTACGT"), ("a", 1, "ACGTACGT"), ("a", 1, "TTTTTTTT"), ("b", 2, "CCCCCCCC"), ("b", 4, "UNMATCHED")]
    for most in (100, 9, 3):
        got = M.nearest_entries(values, listed, "entry", aliases, max_block=most)
        assert sorted(map(tuple, got.collect())) == want


def test_pieces_outlast_an_edit(spark):
    big = fastq(300).decode()
    df = spark.createDataFrame([(1, big, len(big), 1500, 1), (2, big, len(big), 10**6, 0), (3, None, 9, 2, 0)], "file_id long, content string, n_bytes long, size_limit int, overlap_records int")
    edited = df.selectExpr("file_id", "concat('@N:0\\nA\\n+\\nI\\n', content) AS content")
    row = P.kept_after_edit(df, edited).collect()
    assert [r["file_id"] for r in row] == [1] and row[0]["pieces"] - row[0]["kept"] <= 3 < row[0]["pieces"]
    assert P.kept_after_edit(df, edited, **P.EXACT).first()["kept"] < row[0]["kept"]
