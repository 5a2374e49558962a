import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from slicelake.llm import leak, mix, mojibake

random.seed(11)
LATIN = {"de": "abcdefghiklmnoprstuäöüß", "fr": "abcdefgilmnopqrstuéèêâî", "pl": "abcdegiklmnoprstuwyząęółżćś", "ru": "абвгдежзийклмнопрстуфхцчшыьэюя", "en": "abcdefghiklmnoprstuw"}


def vocabulary(lang, n=900):
    r = random.Random(lang)
    letters = r.sample(LATIN[lang], len(LATIN[lang]))  # as uneven as letters are in a language
    return ["".join(r.choices(letters, [1 / (k + 1) for k in range(len(letters))], k=r.randint(3, 9))) for _ in range(n)]


VOC = {x: vocabulary(x) for x in LATIN}


def page(lang, seed, lines=14):
    r = random.Random(seed)
    out = [" ".join(r.choices(VOC[lang], k=6)).capitalize() for _ in range(lines)]
    out[0] = out[0].upper()
    if lang == "en":
        out[3] += " — yes"
    return "\n".join(out)


@pytest.fixture(scope="module")
def clean():
    return [(i, page(lang, i), lang) for i, lang in enumerate(lang for lang in LATIN for _ in range(60))]


@pytest.fixture(scope="module")
def model(spark, clean):
    return mojibake.train(spark.createDataFrame(clean, "doc_id long, text string, lang string"))


def chain(*steps):
    return mojibake.Chain(steps)


@pytest.mark.parametrize(
    ("lang", "c"),
    [("de", chain(("utf_8", "cp1252"))), ("fr", chain(("utf_8", "latin_1"))), ("pl", chain(("utf_8", "cp1252"), ("utf_8", "cp1252"))), ("ru", chain(("utf_8", "mac_roman"))), ("ru", chain(("cp1251", "cp1252"))), ("ru", chain(("koi8_r", "cp1251"))), ("pl", chain(("cp1250", "cp852"))), ("fr", chain(("cp1252", "cp437"))), ("de", chain(("cp1252", "mac_roman"))), ("en", chain(("utf_8", "cp1252")))],
    ids=lambda x: x if isinstance(x, str) else x.name,
)
def test_held_out_pages_are_found_and_restored(model, lang, c):
    found = restored = 0
    for seed in range(5000, 5020):
        text = page(lang, seed)
        got = mojibake.judge(model, c.garble(text))
        found += got[0]
        restored += got[2] == text
    assert found == 20 and restored >= 16


def test_clean_pages_and_a_foreign_line_are_no_case(model):
    for lang in LATIN:
        assert sum(mojibake.judge(model, page(lang, s))[0] for s in range(7000, 7040)) == 0
    assert not mojibake.judge(model, page("en", 1) + "\n" + page("ru", 2, 3))[0]


def test_some_garbled_lines_are_enough(model):
    lines = page("de", 9001).split("\n")
    garbled = lines[:5] + [chain(("utf_8", "cp1252")).garble(x) for x in lines[5:8]] + lines[8:]
    got = mojibake.judge(model, "\n".join(garbled))
    assert got[0] and got[2] == "\n".join(lines)


def test_lost_letters_are_reported_not_restored(model):
    text = page("fr", 9002)
    got = mojibake.judge(model, text.encode("cp1252", "replace").decode("utf-8", "replace"))
    assert got[0] and got[3] > 5


def test_lines_of_a_rarer_chain_are_restored_on_a_garbled_page(model):
    lines = page("fr", 9100, 20).split("\n")
    main, other = chain(("utf_8", "cp1252")), chain(("cp1252", "mac_roman"))
    garbled = [main.garble(x) for x in lines[:18]] + [other.garble(x) for x in lines[18:]]
    got = mojibake.judge(model, "\n".join(garbled))
    assert got[0] and sum(a == b for a, b in zip(got[2].split("\n"), lines)) >= 19


def test_ascii_pages_with_lost_letters_count_their_lines(model):
    assert mojibake.judge(model, "one\nt\ufffdo\nthr\ufffd\ufffd") == (True, None, None, 2)


def test_edges(spark, model, clean):
    rows = [(1, None), (2, ""), (3, "plain ascii"), (4, "x" * 200_000), (5, "�"), (5, "�")]
    got = {r["doc_id"]: r["garbled"] for r in mojibake.detect(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert got == {1: False, 2: False, 3: False, 4: False, 5: True}
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert mojibake.detect(empty).count() == 0


@pytest.mark.parametrize("c", mojibake.CHAINS, ids=lambda c: c.name)
def test_chains_invert(c):
    text = "Größe naïve łąka" if c.steps[0][0] in ("utf_8", "cp1250") else "Größe" if c.steps[0][0] in (*mojibake.WESTERN, *mojibake.CENTRAL) else "слово дело"
    garbled = c.garble(text, "ignore")
    if not c.lossy:
        assert c.restore(garbled) == encode_known(text, c)


def encode_known(text, c):
    first = c.steps[0][0]
    return mojibake.decode(mojibake.encode(text, first, "ignore"), first)


@pytest.mark.parametrize("at", [0, 1])
def test_multi_index_finds_all_pairs_within_the_radius(at):
    r = random.Random(5)
    items = [(i, " ".join(r.choices(VOC["en"], k=40))) for i in range(30)]
    scale = leak.Index(items).scales[at]
    probes = scale.prints[:300].copy()
    for n in range(len(probes)):
        for b in r.sample(range(64), r.randint(0, scale.radius + 3)):
            probes[n] ^= np.uint64(1 << b)
    far = np.bitwise_count(probes[:, None] ^ scale.prints[None, :])
    who, window, d = scale.near(probes)
    assert set(zip(who.tolist(), window.tolist())) == set(zip(*(x.tolist() for x in np.nonzero(far <= scale.radius))))
    assert (far[who, window] == d).all()


def test_fingerprints_are_signs_of_sums():
    r = random.Random(3)
    signs, ws = leak.Signs(), r.choices(VOC["de"], k=60)
    ids = signs.ids_of(ws)
    for size in (3, 5, 15, 31):
        want = [[int(sum(signs.table[i][b] for i in ids[k : k + size]) > 0) for b in range(64)] for k in range(60 - size + 1)]
        got = np.unpackbits(signs.prints(ids, size).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        assert got.tolist() == want


def test_shingle_similarity():
    a = "one two three four five".split()
    assert leak.similarity(a, a) == (1.0, (0, 0)) and leak.similarity(a, a[::-1]) == (0.0, None)
    alike, at = leak.similarity(["x", *a], a)
    assert at == (1, 0) and alike == pytest.approx(31 / 35)
    assert leak.similarity(["a"] * 4, ["a"] * 3)[0] == pytest.approx(2 / 3)


def typeset(ws, per=6):
    return "\n".join(" ".join(ws[i : i + per]) for i in range(0, len(ws), per))


def leaks(spark, pages, items):
    docs = spark.createDataFrame(pages, "doc_id long, text string, line_boxes array<struct<x0:int,y0:int>>")
    return sorted((r["doc_id"], r["item_id"]) for r in leak.find_leaks(docs, spark.createDataFrame(items, "item_id long, text string")).collect())


def test_planted_passages(spark):
    r = random.Random(6)
    words = lambda n: r.choices(VOC["en"], k=n)
    items = [(i, " ".join(words(60))) for i in range(20)] + [(90, None), (91, ""), (92, "too short")]
    item = items[3][1].split()

    part = item[10:32]
    exchanged = part[:9] + ["zzzzz"] + part[10:]
    damaged = [w.replace("e", "c") if i % 3 == 0 else w for i, w in enumerate(part)]
    shuffled = part[:]
    r.shuffle(shuffled)
    around = lambda mid: typeset(words(40) + mid + words(40))
    one, two = typeset(words(30) + part + words(20)).split("\n"), typeset(words(72)).split("\n")
    woven, boxes = [], []
    for a, b in zip(one, two):
        woven += [a, b]
        boxes += [(90, 0), (700, 0)]
    pages = [
        (1, around(part), None), (2, around(exchanged), None), (3, around(damaged), None), (4, around([w.upper() + "," for w in part]), None), (5, "\n".join(woven), boxes), (6, "\n".join(woven), None),
        (7, around(part[:11]), None), (8, around(shuffled), None), (9, None, None), (10, "", None), (11, typeset(words(200)), None), (12, around(part[:8]) + "\n" + around(part[14:]), None), (1, around(part), None),
        (13, "\n".join(f"{a:<45}{b}" for a, b in zip(one, two)), None), (14, "word " * 20000, None),
    ]
    got = leaks(spark, pages, items)
    assert got == sorted([(d, 3) for d in (1, 1, 2, 3, 4, 5, 6, 13)])
    assert leaks(spark, [], items) == [] and leaks(spark, pages, []) == []


def brute_leaks(pages, items, least=15):
    """Longest run of an item's words on a page, words alike up to damage, one exchanged word stepped over; quadratic."""
    out = []
    for d, text, _ in pages:
        page = [leak.skeleton(w) for w in leak.words(text or "")]
        for i, t in items:
            item = [leak.skeleton(w) for w in leak.words(t or "")]
            best, before = 0, {}
            for x, p in enumerate(page):
                now = {}
                for y, q in enumerate(item):
                    n, gap = before.get(y - 1, (0, 1))
                    if leak._close(p, q):
                        now[y] = (n + 1, 0)
                        best = max(best, n + 1)
                    elif n and not gap:
                        now[y] = (n + 1, 1)
                before = now
            if best >= least:
                out.append((d, i))
    return sorted(out)


def test_recall_against_brute_force(spark):
    r = random.Random(21)
    items = [(i, " ".join(r.choices(VOC["de"], k=60))) for i in range(12)]
    pages = []
    for d in range(45):
        ws = r.choices(VOC["de"], k=150)
        item, n = items[d % 12][1].split(), r.randint(9, 30)
        part = item[(a := r.randint(0, 30)) : a + n]
        if d % 3 == 0 and n > 4:
            part[n // 2] = r.choice(VOC["en"])
        if d % 4 == 0:
            part = [w.replace("e", "c") if k % 4 == 0 else w for k, w in enumerate(part)]
        pages.append((d, typeset(ws[:70] + part + ws[70:]), None))
    want, got = brute_leaks(pages, items), leaks(spark, pages, items)
    assert len(want) > 20 and len(set(want) & set(got)) >= 0.95 * len(want) and len(set(got) - set(want)) <= 1


def test_long_lists_are_joined_with_the_same_result(spark):
    r = random.Random(8)
    langs = ["en", "de", "ru"]
    items = spark.createDataFrame([(i, " ".join(r.choices(VOC[langs[i % 3]], k=40))) for i in range(30)] + [(90, None), (91, "")], "item_id long, text string")
    pages = [(100 + i, typeset(r.choices(VOC["en"], k=30) + t.split()[3 : 10 + i] + r.choices(VOC["fr"], k=30))) for i, t in items.where("length(text) > 0").collect()]
    pages += [pages[20], (131, pages[20][1]), (132, None), (133, ""), (134, chain(("utf_8", "cp1251")).garble(pages[29][1], "ignore"))]
    docs = spark.createDataFrame(pages, "doc_id long, text string")
    a = sorted(map(tuple, leak.find_leaks(docs, items).collect()))
    b = sorted(map(tuple, leak.find_leaks(docs, items, max_words=100).collect()))
    assert a == b and len(a) > 20 and a.count(a[-3]) >= 1
    assert leak.find_leaks(docs.limit(0), items, max_words=100).count() == 0


@pytest.mark.parametrize("alphabet", ["αβγδεζηθικλμνξοπρστυφχψω", "אבגדהוזחטיכלמנסעפצקרשת", "աբգդեզէըթժիլխծկհձղճմ", "가나다라마바사아자차카타파하"])
def test_items_of_other_scripts(spark, alphabet):
    r = random.Random(alphabet)
    voc = ["".join(r.choices(alphabet, k=r.randint(3, 8))) for _ in range(400)]
    items = [(i, " ".join(r.choices(voc, k=40))) for i in range(5)]
    part = items[2][1].split()
    pages = [(1, typeset(r.choices(VOC["en"], k=50) + part[5:25] + r.choices(voc, k=50)), None), (2, typeset(part[:11]), None), (3, typeset(r.choices(voc, k=100)), None)]
    assert leaks(spark, pages, items) == [(1, 2)]


def test_words_of_every_kind():
    assert leak.words("Größe m\u03a3dchen 1945 w0rd \u65e5\u672c \u03bb\u03cc\u03b3\u03bf\u03c2 слово") == ["gre", "mdchen", "lgas", "word", "\u65e5", "\u672c", "\u03bb\u03cc\u03b3\u03bf\u03c2", "слово"]


def test_the_longest_passage_counts(spark):
    r = random.Random(31)
    item = r.choices(VOC["en"], k=80)
    page = r.choices(VOC["de"], k=100) + item[:16] + r.choices(VOC["de"], k=100) + item[20:70] + r.choices(VOC["de"], k=100)
    docs, items = spark.createDataFrame([(1, typeset(page))], "doc_id long, text string"), spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    assert 48 <= leak.find_leaks(docs, items).first()["n_words"] <= 52


def test_one_page_of_very_many_copies(spark):
    item = random.Random(32).choices(VOC["en"], k=40)
    docs, items = spark.createDataFrame([(1, typeset(item * 500)), (2, "same " * 8_000)], "doc_id long, text string"), spark.createDataFrame([(1, " ".join(item)), (2, "same " * 40)], "item_id long, text string")
    assert sorted(tuple(r)[:2] for r in leak.find_leaks(docs, items).collect()) == [(1, 1), (2, 2)]


def test_mix_matches_sorting_by_hash(spark):
    r = random.Random(9)
    docs = [(i, " ".join(["word"] * r.randint(0, 30)) if i % 17 else None, ["a", "a", "a", "b", "c", None, "other"][i % 7]) for i in range(400)]
    targets = [("a", 0.2, 1), ("b", 0.5, 3), ("c", 0.1, None), ("none", 0.1, 2), ("zero", None, 1)]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumn("tokens", F.lit("clash"))
    t = spark.createDataFrame(targets, "source string, target_share double, max_repeats int")
    used, shares = mix.mix(d, t)
    got = {r["doc_id"]: r["copies"] for r in used.collect()}
    counts = mix.token_counts(d).toPandas()
    total, want = counts["tokens"].sum(), {}
    for source, share, repeats in targets:
        own = counts[counts["source"] == source].sort_values("h")
        have = own["tokens"].sum()
        budget = min((share or 0) * total, have * (1 if repeats is None else repeats))
        full = int(budget // have) if have else 0
        extra = (own["tokens"].cumsum() <= budget - full * have).to_numpy()
        for i, e in zip(own["doc_id"], extra):
            if full + e:
                want[i] = full + int(e)
    assert got == want
    report = {r["source"]: r for r in shares.collect()}
    assert not report["b"]["reachable"] and report["a"]["reachable"] and not report["none"]["reachable"] and report["b"]["most_copies"] == 3
    assert abs(sum(r["reached_share"] for r in report.values()) - 1) < 1e-4
    assert mix.mix(d.limit(0), t)[0].count() == 0


def test_all_shares_hold_in_a_smaller_mix(spark):
    r = random.Random(10)
    docs = spark.createDataFrame([(i, "word " * r.randint(1, 20), "abc"[min(2, i % 9 // 4)]) for i in range(1500)] + [(None, "word", "a"), (None, "other words here", "a")], "doc_id long, text string, source string")
    targets = spark.createDataFrame([("a", 0.3, 1), ("b", 0.3, 1), ("c", 0.4, 2)], "source string, target_share double, max_repeats int")
    free, held = ({r["source"]: r for r in mix.mix(docs, targets, hold_shares=h)[1].collect()} for h in (False, True))
    assert not free["c"]["reachable"] and abs(free["c"]["reached_share"] - 0.4) > 0.05
    assert all(abs(r["reached_share"] - r["target_share"]) < 0.01 and r["most_copies"] <= r["max_repeats"] for r in held.values())
    assert mix.token_counts(docs.where("doc_id IS NULL")).select("h").distinct().count() == 2


def test_thresholds_nest(spark):
    d = spark.createDataFrame([(i, "w " * (i % 9 + 1), "a") for i in range(300)], "doc_id long, text string, source string")
    counts = mix.token_counts(d)
    took = []
    for share in (0.1, 0.3, 0.9):
        plan = mix.budgets(mix.histogram(counts), spark.createDataFrame([("a", share, 1)], "source string, target_share double, max_repeats int"))
        at = mix.thresholds(counts, plan).first()["threshold"]
        took.append({r["doc_id"] for r in counts.where(F.col("h") < at).collect()})
    assert took[0] < took[1] < took[2]


def test_short_russian_passage_on_a_latin_page(spark):
    r = random.Random(12)
    items = [(i, " ".join(r.choices(VOC["ru"], k=50))) for i in range(12)] + [(50 + i, " ".join(r.choices(VOC["de"], k=50))) for i in range(12)]
    part, de = items[4][1].split()[20:36], items[15][1].split()[20:40]
    latin = lambda n: r.choices(VOC["en"], k=n)
    around = lambda mid: typeset(latin(300)) + "\n" + mid + "\n" + typeset(latin(300))
    garbled = mojibake.Chain((("utf_8", "cp1252"),)).garble(typeset(part))
    as_cyrillic = [mojibake.Chain((steps,)).garble(typeset(de), "ignore") for steps in (("utf_8", "cp1251"), ("cp1252", "cp1251"))]
    pages = [(1, around(typeset(part)), None), (2, around(garbled), None), (3, around(typeset(part[:11])), None), (4, around(typeset(de)), None)]
    pages += [(5 + k, around(x), None) for k, x in enumerate(as_cyrillic)]
    assert leaks(spark, pages, items) == [(1, 4), (2, 4)] + [(k, items[15][0]) for k in (4, 5, 6)]


def test_passages_garbled_by_every_cyrillic_chain(spark):
    r = random.Random(13)
    items = [(i, " ".join(r.choices(VOC["ru"], k=50)).capitalize()) for i in range(12)]
    part = items[4][1].split()[20:38]
    near = lambda lang: typeset(r.choices(VOC[lang], k=60))
    chains = [c for c in mojibake.CHAINS if not c.lossy and c.steps[0][0] in ("utf_8", *mojibake.CYRILLIC)]
    pages = [(2 * k + odd, near(lang) + "\n" + c.garble(typeset(part)) + "\n" + near(lang), None) for k, c in enumerate(chains) for odd, lang in enumerate(("ru", "en"))]
    # whole pages, and letters misread after decoding
    pages += [(1000 + k, c.garble(near("ru") + "\n" + typeset(part)), None) for k, c in enumerate(chains)]
    pages += [(2000 + k, near("ru") + "\n" + c.garble(typeset(part)).replace(c.garble(part[7]), c.garble(part[7])[:-1] + "☆"), None) for k, c in enumerate(chains)]
    pages += [(3000, near("ru"), None), (3001, chains[0].garble(typeset(part[:11])), None)]
    assert len(chains) > 50 and leaks(spark, pages, items) == sorted((d, 4) for d, _, _ in pages if d < 3000)


@pytest.mark.parametrize("between", [5, 79, 80, 300, 20_000])
def test_other_print_within_a_passage_may_be_of_any_length(spark, between):
    item, other = VOC["en"][:24], VOC["de"]
    r = random.Random(between)
    print_ = [r.choice(other) for _ in range(between)]
    rows = [(1, " ".join(item[:10] + print_ + item[10:])), (2, " ".join(item[:10] + print_)), (3, " ".join(item[12:] + print_ + item[:12]))]
    docs, items = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    want = [(1, 7, 24)]  # neither too few words nor the other order
    assert [tuple(r) for r in leak.find_leaks(docs, items).collect()] == want
    assert [tuple(r) for r in leak.find_leaks(docs, items, max_words=1).collect()] == want


def test_places_are_those_of_a_plain_search():
    r = random.Random(5)
    page, item = [r.choice(["ab", "cd", "longword", "longwerd", "other"]) for _ in range(400)], ["ab", "cd", "longword", "ab", "other", "other"]
    places = leak.Places(page, [item])
    for y in range(len(item) - 2):
        a, b, c = item[y : y + 3]
        for x in range(-1, 400):
            want = next((z for z in range(x + 1, 398) if page[z] == a and page[z + 1] == b and leak._close(page[z + 2], c)), None)
            assert places.after(x, a, b, c) == want
    assert leak.Places([], [item]).after(0, "ab", "cd", "ab") is None


def test_a_long_page_of_one_items_words_takes_no_square_of_its_length():
    item = VOC["en"][:20]
    index = leak.Index([(1, " ".join(item))])
    texts = [(item[:14] + ["zzz"]) * 3000, item[:14] * 3000, [item[0]] * 40_000]
    got = leak.find_passages(index, leak.Signs(), texts, 15)
    assert got == [[], [], []]
