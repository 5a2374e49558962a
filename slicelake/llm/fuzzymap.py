"""Mapping free-entered values to a canonical list: a trie of reference entries walked by a Levenshtein automaton."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slicelake.session import cut

#: Most entries and aliases that are sent to every task as one trie; a longer list's trie is divided.
MAX_BLOCK = 50_000
#: Most branches of a divided trie's top, which goes to every task; tasks that a branch's values are spread over.
MAX_TOP, SPREAD = 50_000, 4
#: Most answers a Python worker keeps for repeated values.
MAX_CACHED = 500_000

UNMATCHED = "UNMATCHED"


class Trie:
    """Reference entries, and aliases that lead to the same entries."""

    def __init__(self, entries: Iterable[str], aliases: Iterable[tuple[str, str]] = ()):
        self.root: dict = {}
        self.answers: dict = {}  # of earlier values: a Python worker keeps the trie, and with it these, from task to task
        for path, entry in [(e, e) for e in entries] + list(aliases):
            self.add(path, entry)

    def add(self, path: str, entry: str) -> None:
        node = self.root
        for c in path:
            node = node.setdefault(c, {})
        node.setdefault("", set()).add(entry)

    def _walk(self, word: str, limit: int):
        """(entries, changes with which the whole word is consumed there) of every node with entries that an automaton reaches alive.

        The automaton for ``word`` is kept as bit sets: bit i of states[d] says that i letters of the word are
        consumed with d changes. One step per trie edge; a subtree is left as soon as no state is alive.
        """
        n = len(word)
        at: dict[str, int] = {}
        for i, c in enumerate(word):
            at[c] = at.get(c, 0) | (1 << i)
        full, final = (1 << (n + 1)) - 1, 1 << n
        start, grown = [], 1
        for _ in range(limit + 1):
            start.append(grown & full)
            grown |= grown << 1
        stack = [(self.root, start)]
        while stack:
            node, states = stack.pop()
            for c, child in node.items():
                if c == "":
                    yield child, next((d for d, s in enumerate(states) if s & final), None)
                    continue
                m = at.get(c, 0)
                last, before, nxt = 0, 0, []
                for s in states:
                    # the same letter; left out, replaced or added at one more change
                    before = ((s & m) << 1 | last | last << 1 | before << 1) & full
                    last = s
                    nxt.append(before)
                if before:  # the most changes allow whatever fewer do
                    stack.append((child, nxt))

    def within(self, word: str, limit: int) -> dict[str, int]:
        """Every entry within ``limit`` single-letter changes of ``word``, with its distance."""
        found: dict[str, int] = {}
        for entries, d in self._walk(word, limit):
            if d is not None:
                for e in entries:
                    if d < found.get(e, limit + 1):
                        found[e] = d
        return found

    def branches(self, word: str, limit: int) -> list[str]:
        """The marks on all nodes the automaton reaches alive: what of a divided trie may hold an entry within the limit."""
        return sorted({e for entries, _ in self._walk(word, limit) for e in entries})


def at_most_two(length: int) -> int:
    """Two changes whatever the length."""
    return 2


def by_length(length: int) -> int:
    """Changes allowed by length, for general lists: none up to 3 letters, one up to 5, two up to 11, then three."""
    return 0 if length <= 3 else 1 if length <= 5 else 2 if length <= 11 else 3


#: Letters that stand in written barcodes: bases, the codes N and U, digits, and O written for 0 or C.
_LETTERS = re.compile(r"[ACGTNUO0-9]+")
_TOKEN = re.compile(r"[^\W_]+")


def barcode_letters(value: str) -> str:
    """The letters of a typed barcode: without case, width, white space, punctuation and remarks.

    Remarks are text in brackets, what stands before ``:`` or ``=``, end marks such as ``5'-`` and ``-3'``, and
    words that hold other letters. A value without any barcode-like word gives all its letters, so that it is
    reported as unmatched rather than lost.
    """
    s = unicodedata.normalize("NFKC", value).upper()
    s = re.sub(r"\([^()]*\)|\[[^\[\]]*\]", " ", s)
    s = re.sub(r"\A[^:=]{0,40}[:=]", " ", s)
    s = re.sub(r"\A\s*5['’′`]\s*-?|-?\s*3['’′`]\s*\Z", " ", s)
    tokens = _TOKEN.findall(s)
    like = [bool(_LETTERS.fullmatch(t)) or (len(t) >= 5 and sum(c in "ACGT" for c in t) >= 0.7 * len(t)) for t in tokens]
    if sum(len(t) == 1 for t in tokens) < 5:  # not written letter by letter
        while tokens and not (like[-1] and not (tokens[-1].isdigit() and len(tokens) > 1)):
            tokens.pop(), like.pop()
        while tokens and not (like[0] and not (tokens[0].isdigit() and len(tokens) > 1)):
            tokens.pop(0), like.pop(0)
    kept = "".join(t for t, ok in zip(tokens, like) if ok)
    return kept or "".join(_TOKEN.findall(s))


_NEAR = "array<struct<distance: int, entry: string>>"


def _near(trie: Trie, word: str, limit: int) -> list[tuple[int, str]]:
    return sorted((d, e) for e, d in trie.within(word, limit).items())


def _search(shared: Broadcast, letters: Callable[[str], str], limit: Callable[[int], int]):
    kind = pa.list_(pa.struct([("distance", pa.int32()), ("entry", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = shared.value
        known = trie.answers
        for b in batches:
            coded = b.column("value").dictionary_encode()  # each distinct value of a batch is answered and converted once
            answers = []
            for v in coded.dictionary.to_pylist():
                got = known.get(v)
                if got is None:
                    if len(known) >= MAX_CACHED:
                        known.clear()
                    word = letters(v)
                    got = known[v] = [{"distance": d, "entry": e} for d, e in _near(trie, word, limit(len(word)))]
                answers.append(got)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(answers, kind).take(coded.indices)], names=[*b.schema.names, "near"])

    return run


def candidates(values: DataFrame, reference: DataFrame, entry_col: str, aliases: DataFrame | None = None, letters: Callable[[str], str] = barcode_letters, limit: Callable[[int], int] = by_length, max_block: int = MAX_BLOCK) -> DataFrame:
    """The columns of ``values`` (any, with value) and near: all entries within ``limit(length)`` changes, nearest first.

    near is an array of (distance, entry). NULL values are left out; an empty list of entries or a value that none is
    near gives an empty array. Repeated rows give repeated results. aliases: (alias, entry) further spellings; an entry
    counts with its nearest spelling.

    Up to ``max_block`` entries and aliases go to every task as one trie. A longer list's trie is divided at a prefix
    length: its top goes to every task and tells which branches a value's automaton reaches alive; values and branches
    then meet in one shuffle, where a task holds one branch at a time.
    """
    paths = reference.select(F.col(entry_col).alias("path"), F.col(entry_col).alias("entry")).where("path IS NOT NULL AND path <> ''")
    if aliases is not None:
        paths = paths.unionByName(aliases.select(F.col("alias").alias("path"), "entry").where("path <> '' AND entry IS NOT NULL"))
    known, paths = values.drop("near").where("value IS NOT NULL"), paths.distinct()
    block = [(r[0], r[1]) for r in paths.limit(max_block + 1).collect()]
    sc = values.sparkSession.sparkContext
    kinds = {f.name: f.dataType.simpleString() for f in known.schema.fields}
    if len(block) <= max_block:
        shared = sc.broadcast(Trie([], sorted(block)))
        return known.mapInArrow(_search(shared, letters, limit), ", ".join(f"`{c}` {t}" for c, t in kinds.items()) + f", near {_NEAR}")
    answers = _divided(known.select("value").distinct(), paths, letters, limit, max_block)
    return known.join(answers, "value", "left").withColumn("near", F.coalesce("near", F.array().cast(_NEAR))).select(*known.columns, "near")


def _divided(values: DataFrame, paths: DataFrame, letters: Callable[[str], str], limit: Callable[[int], int], max_block: int) -> DataFrame:
    """(value, near) of distinct values: for lists whose trie is too large for one task."""
    paths = cut(paths)
    for size in range(8, -1, -1):  # the longest prefixes of which there are few enough
        sizes = paths.groupBy(F.left("path", F.lit(size)).alias("prefix")).agg(F.count(F.lit(1)).alias("n"))
        top = [(r[0], r[1]) for r in sizes.limit(MAX_TOP + 1).collect()]
        if len(top) <= MAX_TOP:
            break
    # a prefix of very many entries is several branches, all of which its values visit
    shared = values.sparkSession.sparkContext.broadcast(Trie([], [(p, f"{k}/{p}") for p, n in top for k in range(-(-n // max_block))]))

    def visits(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = [(b, v, w) for v in f["value"] for w in (letters(v),) for b in shared.value.branches(w, limit(len(w)))]
            yield pd.DataFrame(out, columns=["branch", "value", "path"])

    asked = values.mapInPandas(visits, "branch string, value string, path string").withColumn("salt", F.pmod(F.xxhash64("value"), F.lit(SPREAD)).cast("int"))
    many = F.broadcast(sizes.select("prefix", F.ceil(F.col("n") / max_block).alias("many")))  # at most MAX_TOP rows
    held = paths.withColumn("prefix", F.left("path", F.lit(size))).join(many, "prefix")
    held = held.select(F.concat_ws("/", F.pmod(F.xxhash64("path", "entry"), "many"), "prefix").alias("branch"), F.lit(None).cast("string").alias("value"), "path", "entry", F.explode(F.array(*[F.lit(k) for k in range(SPREAD)])).alias("salt"))
    both = held.unionByName(asked.withColumn("entry", F.lit(None).cast("string"))).repartition("branch", "salt").sortWithinPartitions("branch", "salt", F.col("entry").isNull())

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here, trie = None, Trie([])
        for f in frames:
            out = []
            for branch, salt, value, path, entry in zip(f["branch"], f["salt"], f["value"], f["path"], f["entry"]):
                if (branch, salt) != here:
                    here, trie = (branch, salt), Trie([])
                if value is None:
                    trie.add(path, entry)
                else:
                    out += [(value, d, e) for d, e in _near(trie, path, limit(len(path)))]
            yield pd.DataFrame(out, columns=["value", "distance", "entry"])

    found = both.mapInPandas(search, "value string, distance int, entry string").groupBy("value", "entry").agg(F.min("distance").alias("distance"))
    return found.groupBy("value").agg(F.sort_array(F.collect_list(F.struct("distance", "entry"))).alias("near"))


def nearest_entries(values: DataFrame, reference: DataFrame, entry_col: str, aliases: DataFrame | None = None, letters: Callable[[str], str] = barcode_letters, limit: Callable[[int], int] = at_most_two, max_block: int = MAX_BLOCK) -> DataFrame:
    """(source_table, row_id, entry) for every row of ``values`` (source_table, row_id, value).

    entry is the only one of the ``candidates`` with the fewest changes; UNMATCHED if there is none or several are
    equally near. NULL values are left out; an empty text is UNMATCHED, and so is everything when the list is empty.
    Repeated rows give repeated results.
    """
    found = candidates(values.select("source_table", "row_id", "value"), reference, entry_col, aliases, letters, limit, max_block)
    first, second = F.get("near", F.lit(0)), F.get("near", F.lit(1))
    alone = first.isNotNull() & (second.isNull() | (second["distance"] > first["distance"]))
    return found.select("source_table", "row_id", F.when(alone, first["entry"]).otherwise(UNMATCHED).alias("entry"))
