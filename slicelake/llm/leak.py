"""Evaluation texts leaking into training text: which pages hold a passage of which test item.

Windows as long as the smallest passage that counts get SimHash fingerprints; a multi-index over blocks of their
bits finds every pair of page and item windows within a Hamming radius; candidates are verified by the exact
weighted similarity of their shingles, and then word by word, as order and length of the passage decide a case.
Shorter windows go through the same steps, for passages that other print breaks up. Pages are read in print order
(columns apart), and words are compared by skeletons that scanning and decoding damage mostly leave alone.
Fingerprints depend on the words alone, on no vocabulary or count, so that results are the same however items are
divided.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slicelake.llm.mojibake import CHAINS, CYRILLIC, Chain
from slicelake.session import cut, spread

#: Words that must stand in the item's order.
PASSAGE = 15
#: (words, fingerprint radius) of the windows. Sizes are odd, so that no bit of a fingerprint is a tie.
WINDOWS = ((15, 7), (5, 3))
#: Blocks of 16 bits of the multi-index. Within radius 7 one of four blocks differs in at most one bit.
BLOCKS, BLOCK_BITS = 4, 16
#: Words in a shingle of the exact check, and the least similarity of two windows. One exchanged word spoils a third of a
#: window's five-word shingles but two of its fourteen pairs, and must not undo a case; so shingles are pairs here.
SHINGLE, LEAST_SIMILAR = 2, 0.15
#: Most item words whose index goes to every task; longer lists are joined by block keys instead.
MAX_WORDS = 200_000
#: How many words on each side tell the script of a word that may be of either.
BESIDE = 3

# Letters that scanners misread for one another, each class written as one letter.
_CLASSES = ("ceo0", "ijl1!|", "un", "hb68", "vy", "ft", "gq9", "s5")
_MERGED = {ord(c): g[0] for g in _CLASSES for c in g}
_PAIRS = (("rn", "m"), ("vv", "w"), ("cl", "d"), ("iu", "m"))
_LATIN = re.compile("[a-z]+")
_ANY = re.compile("[a-zа-яё]+")
# Code points of letters beyond the Latin and Cyrillic scripts, and of those written without spaces.
_FURTHER = "\u0370-\u03ff\u0530-\u0e00\u0e80-\u0fff\u10a0-\u1dff\u1f00-\u1fff\u2c80-\u2dff\ua4d0-\ua63f\ua800-\uaaff\uac00-\ud7ff\ufb13-\ufeff"
_SPACELESS = "\u0e01-\u0e7f\u1000-\u109f\u3005-\u312f\u31a0-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_OTHER = re.compile(f"[{_FURTHER}{_SPACELESS}]")
_BESIDE_LATIN = re.compile(f"(?<=[a-z])[{_FURTHER}{_SPACELESS}]+|[{_FURTHER}{_SPACELESS}]+(?=[a-z])")
_ALL_BUT_LETTERS = re.compile(f"[^\x00-\x7fа-яё{_FURTHER}{_SPACELESS}]+")
_EVERY = re.compile(f"[a-zа-яё]+|[{_SPACELESS}]|[{_FURTHER}]+")
_NUMBER = re.compile(r"\b[0-9]+\b")
_CYR = re.compile("[а-яё]")
_CYR_RUN = re.compile("[а-яё]+")
_CYRILLIC_LETTERS = "абвгдежзийклмнопрстуфхцчшщъыьэюяё"
_BEYOND = re.compile("[^\x00-\x7fа-яё]+")
#: Any Russian word of three letters is such a run under every chain; Latin words with marks have letters within ASCII.
_RUN = re.compile("(?<![a-zA-Z\x80-\U0010ffff])[\x80-\U0010ffff]{3,}(?![a-zA-Z\x80-\U0010ffff])")
#: Print that Russian lines hold besides letters.
_MARK = re.compile("[–—«»„“”‘’…№§]")
_DIGITS = str.maketrans("01596", "olsgb")
_NUMERALS = str.maketrans("0123456789", "olzeasbtbg")
_GAP = re.compile(r"(?<=\S) {3,}(?=\S)")
_RU_CHAINS = tuple(c for c in CHAINS if not c.lossy and (c.steps[0][0] == "utf_8" or c.steps[0][0] in CYRILLIC))


class CyrillicFit:
    """Log odds that text is like the items' Cyrillic words, by their letter pairs, against evenly drawn letters."""

    def __init__(self, vocabulary: Iterable[str]):
        self.vocabulary = {w for w in vocabulary if _CYR.search(w)}
        pairs = Counter(f" {w} "[k : k + 2] for w in self.vocabulary for k in range(len(w) + 1))
        first = Counter()
        for pair, n in pairs.items():
            first[pair[0]] += n
        letters = " " + _CYRILLIC_LETTERS
        self.pairs = {a + b: float(np.log((pairs[a + b] * len(letters) + 5) / (first[a] + 5))) for a in letters for b in letters}
        self.memo: dict[str, float] = {}

    def word(self, w: str) -> float:
        got = self.memo.get(w)
        if got is None:
            if len(self.memo) > 200_000:
                self.memo.clear()
            whole = f" {w} "
            got = self.memo[w] = 3.0 * len(w) if w in self.vocabulary else sum(self.pairs[whole[k : k + 2]] for k in range(len(w) + 1))
        return got

    def line(self, line: str) -> tuple[float, int, int]:
        """(log odds of the Cyrillic words, their letters, other characters beyond ASCII)."""
        runs = [w for w in _ANY.findall(line.lower()) if not w.isascii()]
        whole = [w for w in runs if _CYR_RUN.fullmatch(w)]
        letters = sum(map(len, whole))
        other = len(_MARK.sub("", line)) - len(line.encode("ascii", "ignore")) - letters
        return sum(map(self.word, whole)), letters, other

    def restore(self, line: str) -> str:
        """The line by the chain after which it is most like the items' Cyrillic words, or as it is.

        Where a chain does not decode the whole line (a letter misread afterwards), the words that decode are restored.
        """
        now, letters, other = self.line(line)
        if not other and now > letters:
            return line
        best = line
        most = before = now - 2.0 * other
        for chain in _RU_CHAINS:
            try:
                back = chain.restore(line)
            except UnicodeError:
                back = " ".join(w if w.isascii() else _restored(chain, w) for w in line.split(" "))
                if back == line:
                    continue
            odds, _, other = self.line(back)
            # a word of two letters that is in an item weighs 6 by itself
            if odds > 4 and odds - 2.0 * other > most:
                best, most = back, odds - 2.0 * other
        return best if most > before + 6 else line


def _restored(chain: Chain, word: str) -> str:
    try:
        return chain.restore(word)
    except UnicodeError:
        return word


def words(text: str) -> list[str]:
    """Lower-case words. Latin letters with marks are left out of their words; so are Cyrillic ones in Latin words.

    The script is chosen word by word: a wholly Cyrillic word of four letters is kept on any page. Shorter ones and
    words of both scripts (marked letters read by a Cyrillic codec, digits for letters) go by the words beside them.
    Runs of letters of further scripts are words unless they touch Latin letters (marked ones read by another codec);
    in scripts without spaces each letter is one. Numbers are words; digits in words stand for letters.
    """
    low = _NUMBER.sub(lambda m: m.group().translate(_NUMERALS), text.lower())
    if low.isascii():
        return _LATIN.findall(low.translate(_DIGITS))
    if _OTHER.search(low):
        both = _EVERY.findall(_BESIDE_LATIN.sub("", _ALL_BUT_LETTERS.sub("", low)).translate(_DIGITS))
    else:
        both = _ANY.findall(_BEYOND.sub("", low).translate(_DIGITS))
    latin = [len(w) if w.isascii() else len(w.encode("ascii", "ignore")) for w in both]
    out = []
    for k, w in enumerate(both):
        if latin[k] < len(w) and (latin[k] or len(w) < 4) and not _OTHER.match(w):
            near = slice(max(0, k - BESIDE), k + BESIDE + 1)
            if sum(map(len, both[near])) <= 2 * sum(latin[near]):
                w = _CYR.sub("", w)
        if w:
            out.append(w)
    return out


def skeleton(word: str) -> str:
    """The word with letters that are misread for one another merged."""
    for a, b in _PAIRS:
        if a in word:
            word = word.replace(a, b)
    return word.translate(_MERGED)


def print_order(text: str, x0: list | None) -> str:
    """The page's lines column by column, words broken at line ends rejoined.

    Lines are split where a gap of three spaces runs through them, each part getting a place across the page
    from its line's box (where there is one) and its offset. Places where many parts begin are column starts.
    """
    lines = text.split("\n")
    boxed = x0 is not None and len(x0) == len(lines)
    parts: list[tuple[float, str]] = []
    for i, line in enumerate(lines):
        left = x0[i] if boxed and x0[i] is not None else 90
        if "   " in line:
            at = 0
            body = line.rstrip()
            for piece in _GAP.split(body):
                place = body.find(piece, at)
                at = place + len(piece)
                lead = len(piece) - len(piece.lstrip())
                parts.append((left + 14.5 * (place + lead), piece.strip()))
        else:
            parts.append((left, line.strip()))
    if len(parts) > 3:
        bins = Counter(int(p[0]) // 29 for p in parts)
        least = max(3, 0.12 * len(parts))
        starts = []
        for b in sorted(bins):
            if bins[b] + bins.get(b + 1, 0) >= least and (not starts or b - starts[-1] > 6):
                starts.append(b)
        if len(starts) > 1:
            column = [max((k for k, s in enumerate(starts) if p[0] // 29 >= s - 1), default=0) for p in parts]
            parts = [parts[i] for i in sorted(range(len(parts)), key=lambda i: (column[i], i))]
    out: list[str] = []
    for _, p in parts:
        if out and out[-1].endswith("-") and len(out[-1]) > 1 and p[:1].islower():
            out[-1] = out[-1][:-1] + p
        else:
            out.append(p)
    return "\n".join(out)


def page_words(text: str, x0: list | None, fit: CyrillicFit | None = None) -> list[str]:
    """Words in print order. fit: of the items; without Cyrillic items there is nothing to restore, as marked letters are left out."""
    if fit is not None and not text.isascii():
        text = "\n".join(fit.restore(line) if _RUN.search(line) else line for line in text.split("\n"))
    return words(print_order(text, x0))


#: Most words whose signs a worker remembers.
MAX_REMEMBERED = 300_000
#: Windows looked up at a time, and pairs compared at a time: they bound memory for texts of any length.
STEP, MAX_PAIRS = 16_384, 2_000_000


class Signs:
    """The 64 signs of each word, by a hash of the word; remembered."""

    def __init__(self):
        self.ids: dict[str, int] = {}
        self.table = np.zeros((0, 64), dtype=np.int8)

    def ids_of(self, words: list[str]) -> np.ndarray:
        new = [w for w in dict.fromkeys(words) if w not in self.ids]
        if new and len(self.ids) + len(new) > MAX_REMEMBERED:
            self.ids.clear()
            self.table, new = self.table[:0], list(dict.fromkeys(words))
        if new:
            hashed = b"".join(hashlib.blake2b(w.encode("utf-8", "replace"), digest_size=8).digest() for w in new)
            bits = np.unpackbits(np.frombuffer(hashed, dtype=np.uint8)).reshape(-1, 64)
            self.ids.update(zip(new, range(len(self.ids), len(self.ids) + len(new))))
            self.table = np.concatenate([self.table, bits.astype(np.int8) * 2 - 1])
        return np.fromiter((self.ids[w] for w in words), np.int32, len(words))

    def prints(self, ids: np.ndarray, size: int) -> np.ndarray:
        """SimHash fingerprint of each window of ``size`` words."""
        if len(ids) < size:
            return np.zeros(0, dtype=np.uint64)
        signs = self.table[ids].astype(np.int8 if size < 128 else np.int32, copy=False)
        n = len(ids) - size + 1
        total, run, at, width = None, signs, 0, 1  # run: sums over ``width`` words, doubled in turn
        while True:
            if size & width:
                total = run[at : at + n] if total is None else total + run[at : at + n]
                at += width
            if 2 * width > size:
                break
            run, width = run[:-width] + run[width:], 2 * width
        return np.packbits(total > 0, axis=1, bitorder="little").view(np.uint64).ravel()


def near_masks(radius: int) -> np.ndarray:
    """What a block key may differ by: of windows within the radius, one block is off by at most radius // BLOCKS bits."""
    masks = {0}
    for _ in range(radius // BLOCKS):
        masks |= {m ^ (1 << k) for m in masks for k in range(BLOCK_BITS)}
    return np.array(sorted(masks), dtype=np.int64)


class Scale:
    """The items' windows of one size in a multi-index."""

    def __init__(self, size: int, radius: int, prints: np.ndarray, item: np.ndarray, place: np.ndarray):
        self.size, self.radius, self.prints, self.item, self.place = size, radius, prints, item, place
        masks, self.blocks = near_masks(radius), []
        for b in range(BLOCKS):
            keys = (self._key(prints, b)[None, :] ^ masks[:, None]).ravel()
            order = np.argsort(keys, kind="stable")
            starts = np.searchsorted(keys[order], np.arange((1 << BLOCK_BITS) + 1))
            self.blocks.append((starts, (order % max(1, len(prints))).astype(np.int32)))

    @staticmethod
    def _key(prints: np.ndarray, block: int) -> np.ndarray:
        return ((prints >> np.uint64(block * BLOCK_BITS)) & np.uint64((1 << BLOCK_BITS) - 1)).astype(np.int64)

    def near(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index of print, index of item window, distance) of all pairs within the radius."""
        n = max(1, len(self.prints))
        found = [np.zeros(0, dtype=np.int64)]
        for b, (starts, target) in enumerate(self.blocks):
            key = self._key(prints, b)
            first, many = starts[key], starts[key + 1] - starts[key]
            upto = np.cumsum(many)
            low = 0
            while low < len(prints):
                done = int(upto[low - 1]) if low else 0
                high = max(low + 1, int(np.searchsorted(upto, done + MAX_PAIRS, side="right")))
                part = slice(low, high)
                who = np.repeat(np.arange(low, min(high, len(prints))), many[part])
                at = np.repeat(first[part] - (upto[part] - many[part] - done), many[part]) + np.arange(len(who))
                other = target[at]
                ok = np.bitwise_count(prints[who] ^ self.prints[other]) <= self.radius
                found.append(who[ok] * n + other[ok])
                low = high
        pairs = np.unique(np.concatenate(found))
        who, other = pairs // n, pairs % n
        return who, other, np.bitwise_count(prints[who] ^ self.prints[other]).astype(np.int64) if len(pairs) else pairs


class Index:
    """Items as words, and their windows of every size in multi-indexes."""

    def __init__(self, items: list[tuple[int, str]], windows: tuple = WINDOWS, fit: CyrillicFit | None = None):
        words_of = {i: words(t) for i, t in items}
        self.fit = fit or cyrillic_fit(w for ws in words_of.values() for w in ws)
        self.skeletons = {i: [skeleton(w) for w in ws] for i, ws in words_of.items()}
        signs, self.scales = Signs(), []
        for size, radius in windows:
            prints, item, place = [], [], []
            for i, ws in self.skeletons.items():
                fp = signs.prints(signs.ids_of(ws), size)
                prints.append(fp), item.append(np.full(len(fp), i)), place.append(np.arange(len(fp)))
            self.scales.append(Scale(size, radius, *(np.concatenate(x) if x else np.zeros(0, kind) for x, kind in ((prints, np.uint64), (item, np.int64), (place, np.int64)))))


def cyrillic_fit(vocabulary: Iterable[str]) -> CyrillicFit | None:
    """None without Cyrillic words: then there is nothing to restore, as marked Latin letters are left out."""
    fit = CyrillicFit(vocabulary)
    return fit if fit.vocabulary else None


def similarity(a: list[str], b: list[str], size: int = SHINGLE) -> tuple[float, tuple[int, int] | None]:
    """(weighted Jaccard similarity, places of the first shared shingle) of two windows by their shingles.

    A shingle weighs its letters; one that stands several times counts as often as both windows hold it.
    """
    left = [tuple(a[k : k + size]) for k in range(len(a) - size + 1)]
    right: dict[tuple, list[int]] = {}
    whole = 0
    for k in range(len(b) - size + 1):
        s = tuple(b[k : k + size])
        right.setdefault(s, []).append(k)
        whole += sum(map(len, s))
    shared, first, used = 0, None, Counter()
    for k, s in enumerate(left):
        weight = sum(map(len, s))
        at = right.get(s, ())
        if used[s] < len(at):
            if first is None:
                first = (k, at[used[s]])
            used[s] += 1
            shared += weight
        else:
            whole += weight
    return shared / whole if whole else 0.0, first


def _close(a: str, b: str) -> bool:
    """Whether two skeletons are one word, up to damage: edit distance of at most a fourth of the letters."""
    if a == b:
        return True
    most = max(len(a), len(b)) // 4
    if not most or abs(len(a) - len(b)) > most:
        return False
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        if min(row) > most:
            return False
    return row[-1] <= most


class Places:
    """Where a page holds two words of some item in a row, by these and the word behind them."""

    def __init__(self, page: list[str], items: Iterable[list[str]]):
        wanted = {pair for q in items for pair in zip(q, q[1:])}
        self.behind: dict[tuple[str, str], dict[str, list[int]]] = {}
        for k, (a, b, c) in enumerate(zip(page, page[1:], page[2:])):
            if (a, b) in wanted:
                self.behind.setdefault((a, b), {}).setdefault(c, []).append(k)
        self.known: dict[tuple[str, str, str], list[list[int]]] = {}

    def after(self, x: int, a: str, b: str, c: str) -> int | None:
        """The first place beyond x of a, b and a word that is c up to damage; None without one."""
        some = self.known.get((a, b, c))
        if some is None:
            some = self.known[a, b, c] = [at for w, at in self.behind.get((a, b), {}).items() if _close(w, c)]
        return min((at[k] for at in some if (k := bisect_right(at, x)) < len(at)), default=None)


def _follow(p: list[str], q: list[str], x: int, y: int, known: dict[tuple[int, int], int], places: Places) -> int:
    """Furthest item place reached from p[x], q[y], past the last word that agrees.

    Other print (an advert, a neighbouring column) may stand in between: the walk goes on at the next place where
    three words of the item follow, however far on the page that is.

    known: where walks from earlier places ended. A walk that meets one goes the same way, so each place is walked once.
    """
    end, passed = y, []
    while x < len(p) and y < len(q):
        if _close(p[x], q[y]):
            if (x, y) in known:
                end = known[x, y]
                break
            passed.append((x, y))
            x, y = x + 1, y + 1
            end = y
            continue
        step = None
        if x + 1 < len(p) and _close(p[x] + p[x + 1], q[y]):
            step = (2, 1)
        elif y + 1 < len(q) and _close(p[x], q[y] + q[y + 1]):
            step = (1, 2)
        elif x + 1 < len(p) and y + 1 < len(q) and _close(p[x + 1], q[y + 1]):
            step = (1, 1)
        elif x + 1 < len(p) and _close(p[x + 1], q[y]) and (y + 1 >= len(q) or x + 2 >= len(p) or _close(p[x + 2], q[y + 1])):
            step = (1, 0)
        elif y + 1 < len(q) and _close(p[x], q[y + 1]) and (x + 1 >= len(p) or y + 2 >= len(q) or _close(p[x + 1], q[y + 2])):
            step = (0, 1)
        elif x + 2 < len(p) and y + 2 < len(q) and _close(p[x + 2], q[y + 2]) and (x + 3 >= len(p) or y + 3 >= len(q) or _close(p[x + 3], q[y + 3])):
            step = (2, 2)
        if step:
            x, y = x + step[0], y + step[1]
            continue
        if y + 2 >= len(q):
            break
        here = places.after(x, q[y], q[y + 1], q[y + 2])
        skipped = places.after(x, q[y + 1], q[y + 2], q[y + 3]) if y + 3 < len(q) else None
        if here is None and skipped is None:
            break
        if skipped is None or here is not None and here <= skipped:
            x = here
        else:
            x, y = skipped, y + 1
    known.update(dict.fromkeys(passed, end))
    return end


class Passages:
    """Passages of one item on one page."""

    def __init__(self, page: list[str], places: Places, back: list[str], back_places: Places, item: list[str]):
        self.page, self.places, self.back, self.back_places = page, places, back, back_places
        self.item, self.item_back = item, item[::-1]
        self.longest, self.ahead, self.behind = 0, {}, {}

    def add(self, d: int, i: int, size: int) -> None:
        """Follows the passage through the windows at page[d] and item[i], if their shingles are similar enough.

        From a shared shingle both ways: words must be the same up to damage; one exchanged word, a word split or run
        together, or a detour through other print is stepped over where the item goes on behind it. Places on a
        passage followed before need no further check of similarity.
        """
        on = next((k for k in (0, size // 2, size - 1) if (d + k, i + k) in self.ahead), None)
        if on is not None:
            at = (on, on)
        else:
            alike, at = similarity(self.page[d : d + size], self.item[i : i + size])
            if at is None or alike < LEAST_SIMILAR:
                return
        d, i = d + at[0], i + at[1]
        past = _follow(self.page, self.item, d, i, self.ahead, self.places)
        first = len(self.item) - _follow(self.back, self.item_back, len(self.page) - 1 - d, len(self.item) - 1 - i, self.behind, self.back_places)
        self.longest = max(self.longest, past - first)


def find_passages(index: Index, signs: Signs, pages: list[list[str]], least: int) -> list[list[tuple[int, int]]]:
    """For each page the (item, words of its longest passage) with at least ``least`` words in order."""
    out: list[list[tuple[int, int]]] = [[] for _ in pages]
    known: dict[str, str] = {}
    skeletons = [[known[w] if w in known else known.setdefault(w, skeleton(w)) for w in ws] for ws in pages]
    starts = np.cumsum([0] + [len(s) for s in skeletons])
    ids = signs.ids_of([s for page in skeletons for s in page])
    owner = np.repeat(np.arange(len(pages)), np.diff(starts))
    seeds: dict[tuple[int, int], list[tuple[int, int, int, int]]] = {}
    for scale in index.scales:
        for at in range(0, len(ids) - scale.size + 1, STEP):
            prints = signs.prints(ids[at : at + STEP + scale.size - 1], scale.size)
            who, window, far = scale.near(prints)
            who = who + at
            whole = owner[who] == owner[who + scale.size - 1]  # a window lies on one page
            for w, i, d, f in zip(who[whole].tolist(), scale.item[window[whole]].tolist(), scale.place[window[whole]].tolist(), far[whole].tolist()):
                seeds.setdefault((int(owner[w]), i), []).append((-scale.size, f, w - int(starts[owner[w]]), d))
    of_page: dict[int, list[int]] = {}
    for k, item in seeds:
        of_page.setdefault(k, []).append(item)
    for k, some in of_page.items():
        page, back = skeletons[k], skeletons[k][::-1]
        places, back_places = Places(page, (index.skeletons[i] for i in some)), Places(back, (index.skeletons[i][::-1] for i in some))
        for item in some:
            found = Passages(page, places, back, back_places, index.skeletons[item])
            for size, _, d, i in sorted(seeds[k, item]):
                found.add(d, i, -size)
            if found.longest >= least:
                out[k].append((item, found.longest))
    return out


_FOUND = "doc_id bigint, item_id bigint, n_words int"


def _batch(rows: list[tuple], of: pa.DataType = pa.int64(), name: str = "doc_id") -> pa.RecordBatch:
    return pa.record_batch([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((of, pa.int64(), pa.int32()))], names=[name, "item_id", "n_words"])


def find_leaks(documents: DataFrame, items: DataFrame, windows: tuple = WINDOWS, least: int = PASSAGE, max_words: int = MAX_WORDS) -> DataFrame:
    """(doc_id, item_id, n_words) for each page that holds at least ``least`` words of an item in its order.

    n_words is the length of the longest passage. NULL and empty texts hold nothing; items shorter than ``least``
    words can't leak. Each page is judged alone: repeated pages give repeated rows. Words of every script count.
    Items of up to ``max_words`` words go to every task as an index; beyond, page and item windows meet in one join
    on the multi-index keys, with the same result. Only the distinct Cyrillic words of the items go to every task
    in both ways, for lines garbled by a wrong Cyrillic codec.
    """
    known = items.where("text IS NOT NULL AND item_id IS NOT NULL").select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text"))
    n = known.agg(F.coalesce(F.sum(F.greatest(F.size(F.split("text", r"\s+")), F.floor(F.length("text") / 6))), F.lit(0))).first()[0]
    boxes = F.col("line_boxes.x0") if "line_boxes" in documents.columns else F.lit(None).cast("array<int>")
    rows = documents.where("text IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), boxes.cast("array<int>").alias("x0"))
    if n > max_words:
        return _joined(rows, known, windows, least)
    shared = documents.sparkSession.sparkContext.broadcast(Index(sorted((r[0], r[1]) for r in known.collect()), windows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, signs = shared.value, Signs()
        for whole in batches:
            for at in range(0, whole.num_rows, 250):
                b = whole.slice(at, 250)
                pages = [page_words(t, x, index.fit) for t, x in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
                yield _batch([(d, i, c) for d, hits in zip(b.column(0).to_pylist(), find_passages(index, signs, pages, least)) for i, c in hits])

    return spread(rows).mapInArrow(run, _FOUND)


def _windows_of(windows: tuple, fit) -> Callable:
    """(id, size, print) of the windows of each text (id, text, x0); fit: None for items, which are clean."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signs = Signs()
        for b in batches:
            for key, text, x0 in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                ids = signs.ids_of([skeleton(w) for w in (page_words(text, x0, fit.value) if fit else words(text))])
                for size, _ in windows:
                    for at in range(0, len(ids) - size + 1, STEP):
                        fp = np.unique(signs.prints(ids[at : at + STEP + size - 1], size))
                        yield pa.record_batch([pa.repeat(pa.scalar(key, b.schema.types[0]), len(fp)), pa.array(np.full(len(fp), size, dtype=np.int32)), pa.array(fp.view(np.int64))], names=["id", "size", "print"])

    return run


def _block_keys(prints: DataFrame, masks: Column) -> DataFrame:
    """Adds (block, key): the bits of each block, and with masks other than 0 their neighbours too."""
    blocks = prints.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1))))
    key = F.expr(f"shiftrightunsigned(print, block * {BLOCK_BITS}) & {(1 << BLOCK_BITS) - 1}")
    return blocks.withColumn("key", F.explode(F.transform(masks, lambda m: key.bitwiseXOR(m))))


def _joined(pages: DataFrame, items: DataFrame, windows: tuple, least: int) -> DataFrame:
    """The same for lists too long to index in one task: windows meet by block key, then texts by what met.

    Pages of one text and one layout are compared once, as are fingerprints that stand on many pages.
    """
    sc = pages.sparkSession.sparkContext
    cyrillic = items.where(F.col("text").rlike("[А-Яа-яЁё]"))

    def spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([pa.array(sorted({w for t in b.column(0).to_pylist() for w in words(t) if _CYR.search(w)}), pa.string())], names=["word"])

    fit = sc.broadcast(cyrillic_fit(r[0] for r in cyrillic.select("text").mapInArrow(spelled, "word string").distinct().toLocalIterator()))
    keyed = pages.withColumn("page", F.md5(F.concat_ws("|", F.to_json("x0"), "text")))
    texts = cut(keyed.groupBy("page").agg(F.first("text").alias("text"), F.first("x0").alias("x0")))
    rest = "size int, print bigint"
    here = cut(texts.select("page", "text", "x0").mapInArrow(_windows_of(windows, fit), f"id string, {rest}"))
    there = items.select("item_id", "text", F.lit(None).cast("array<int>").alias("x0")).mapInArrow(_windows_of(windows, None), f"id bigint, {rest}")
    radius = F.coalesce(*[F.when(F.col("size") == size, F.lit(r)) for size, r in windows])
    masks = F.coalesce(*[F.when(F.col("size") == size, F.array(*[F.lit(int(m)).cast("bigint") for m in near_masks(r)])) for size, r in windows])
    probes = _block_keys(here.select("size", "print").distinct(), F.array(F.lit(0).cast("bigint")))
    entries = _block_keys(there.select("size", "print").distinct(), masks).withColumnRenamed("print", "of_item")
    met = probes.join(entries, ["size", "block", "key"]).where(F.bit_count(F.col("print").bitwiseXOR(F.col("of_item"))) <= radius).select("size", "print", "of_item").distinct()
    with_items = met.join(there.select("size", F.col("print").alias("of_item"), F.col("id").alias("item_id")), ["size", "of_item"]).select("size", "print", "item_id").distinct()
    pairs = here.join(with_items, ["size", "print"]).select(F.col("id").alias("page"), "item_id").distinct()
    both = pairs.join(texts, "page").join(items.withColumnRenamed("text", "item_text"), "item_id").select("page", "item_id", "text", "x0", "item_text")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signs = Signs()
        for b in batches:
            found = []
            for page, item, text, x0, item_text in zip(*(c.to_pylist() for c in b.columns)):
                index = Index([(item, item_text)], windows, fit.value)
                for hits in find_passages(index, signs, [page_words(text, x0, fit.value)], least):
                    found += [(page, item, n) for _, n in hits]
            yield _batch(found, pa.string(), "page")

    found = both.mapInArrow(check, "page string, item_id bigint, n_words int")
    return keyed.select("doc_id", "page").join(found, "page").select("doc_id", "item_id", "n_words")
