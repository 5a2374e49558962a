"""Garbled text from wrong character encodings: find it, name the chain of codecs, restore the printed text.

A multinomial classifier (naive Bayes) over hashed byte bigrams is trained on records garbled synthetically by
every known chain, for each language. A page's language is read from its ASCII bigrams, which are the same under
every chain; the other bigrams are the evidence for a chain. A line gets the chain whose likelihood most exceeds
that of rightly decoded text; the chain is then inverted, and the line counts as restored only if that decodes
strictly and reads more like printed text.
"""

from __future__ import annotations

import codecs
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slicelake.session import cut, spread

HASH_BITS = 13
BUCKETS = 1 << HASH_BITS
#: Share of probability spread evenly over all buckets, the same for every chain: unknown bigrams are no evidence.
EVEN = 2e-3
#: Bounds of the training sample: about the most documents of a language, the fewest a language must have, and the most
#: languages. With them the model is bounded: about 2 MB a language.
SAMPLE_DOCS, LEAST_DOCS, MAX_LANGUAGES = 600, 5, 200
#: Documents that one task of the training garbles.
TASK_DOCS = 300
#: Log likelihood ratio that a page must reach over its lines, and its best line alone.
PAGE_EVIDENCE, LINE_EVIDENCE = 18.0, 18.0
#: Line evidence from which a page is garbled even where no chain decodes strictly (letters misread afterwards).
SURE_EVIDENCE = 35.0
#: Line evidence from which a document is left out of the training text; rounds of training.
DOUBT, ROUNDS = 8.0, 3
#: What a clean line of another language than the page's costs, as log likelihood.
OTHER_LANGUAGE = 4.0
#: What a clean line in capitals costs.
CAPITALS = 3.0

# Names of public codecs. Bytes that a single-byte codec leaves undefined decode to the control
# character of the same number, as browsers do.
SINGLE = ("cp1252", "latin_1", "cp437", "cp850", "mac_roman", "cp1250", "iso8859_2", "cp852", "cp1251", "koi8_r", "cp866", "mac_cyrillic", "iso8859_5")
WESTERN = ("cp1252", "mac_roman", "cp850", "cp437")
CENTRAL = ("cp1250", "iso8859_2", "cp852")
CYRILLIC = ("cp1251", "koi8_r", "cp866", "mac_cyrillic", "iso8859_5")


@cache
def _table(codec: str) -> tuple[str, object]:
    """(the 256 characters, the map for encoding)."""
    chars = []
    for b in range(256):
        try:
            chars.append(bytes([b]).decode(codec))
        except UnicodeDecodeError:
            chars.append(chr(b))
    return "".join(chars), codecs.charmap_build("".join(chars))


def encode(text: str, codec: str, errors: str = "strict") -> bytes:
    """Raises UnicodeEncodeError where a character isn't in the codec."""
    if codec == "utf_8":
        return text.encode("utf-8", errors)
    return codecs.charmap_encode(text, errors, _table(codec)[1])[0]


def decode(data: bytes, codec: str) -> str:
    """Raises UnicodeDecodeError where bytes aren't UTF-8; single-byte codecs read anything."""
    if codec == "utf_8":
        return data.decode("utf-8")
    if codec == "utf_8_replace":
        return data.decode("utf-8", "replace")
    return codecs.charmap_decode(data, "strict", _table(codec)[0])[0]


@dataclass(frozen=True)
class Chain:
    """Steps (written as, read as), in the order they happened."""

    steps: tuple[tuple[str, str], ...]

    @property
    def name(self) -> str:
        return " | ".join(f"{a} as {b}" for a, b in self.steps)

    @property
    def lossy(self) -> bool:
        return any(b == "utf_8_replace" for _, b in self.steps)

    def garble(self, text: str, errors: str = "strict") -> str:
        """errors: "ignore" leaves out letters that the first codec lacks."""
        for written, read in self.steps:
            text = decode(encode(text, written, errors), read)
        return text

    def restore(self, text: str) -> str:
        """The text before the chain; raises UnicodeError where it isn't strictly decodable."""
        for written, read in reversed(self.steps):
            text = decode(encode(text, read), written)
        return text


def known_chains() -> tuple[Chain, ...]:
    """UTF-8 read as each single-byte codec, once and twice; codecs of one script read as other codecs; single bytes read as UTF-8."""
    out = [Chain((("utf_8", c),)) for c in SINGLE]
    out += [Chain((("utf_8", c), ("utf_8", c))) for c in ("cp1252", "latin_1", "cp437", "cp850", "mac_roman", "cp1250", "cp1251")]
    out += [Chain((("utf_8", "cp1252"),) * 3)]
    pairs = [(a, b) for group, readers in ((WESTERN, ("cp1252", "cp437", "cp850", "mac_roman", "cp1250", "cp1251", "cp852")), (CENTRAL, ("cp1252", "cp1250", "iso8859_2", "cp852", "cp437", "mac_roman")), (CYRILLIC, (*CYRILLIC, "cp1252", "mac_roman", "cp437"))) for a in group for b in readers if a != b]
    out += [Chain((p,)) for p in pairs]
    out += [Chain(((c, "utf_8_replace"),)) for c in ("cp1252", "cp1250", "cp1251")]
    return tuple(out)


CHAINS = known_chains()


def _hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    pair = (first.astype(np.uint32) << np.uint32(8)) | second
    return ((pair * np.uint32(2654435761)) >> np.uint32(32 - HASH_BITS)).astype(np.int64)


def _bigrams(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position, bucket) of each byte bigram that holds a byte above 127."""
    if len(data) < 2:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    high = data > 127
    at = np.flatnonzero(high[:-1] | high[1:])
    return at, _hash(data[at], data[at + 1])


def _ascii_bigrams(data: np.ndarray) -> np.ndarray:
    """Buckets of the bigrams of two ASCII letters, without case."""
    low = data | 32
    letter = (low >= 97) & (low <= 122) & (data < 128)
    at = np.flatnonzero(letter[:-1] & letter[1:])
    return _hash(low[at], low[at + 1])


def _bytes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-8", "replace") + b"\n", dtype=np.uint8)


_NO_LETTER = bytes(b for b in range(256) if not (chr(b).isascii() and chr(b).isalpha()))
_BEYOND = bytes(range(128, 256))


def _letters(text: str) -> tuple[int, int]:
    """(ASCII letters, characters beyond ASCII)."""
    data = text.encode("utf-8", "replace")
    continuing = bytes(range(128, 192))
    return len(data.translate(None, _NO_LETTER)), len(data.translate(None, continuing)) - len(data.translate(None, _BEYOND))


def _garbled_counts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(lang, chain, bucket, n): bigram counts of the texts under every chain, a row a chain with its buckets.

    Chain -3 has the letters within ASCII and those beyond, -1 the ASCII bigrams, -2 the clean lines in capitals, as headlines are. Clean text also counts
    with each word's first letter capital, at a tenth, for letters that seldom begin a sentence.
    """
    for f in frames:
        rows = []
        for lang, texts in f.groupby("lang")["text"]:
            whole = "\n".join(texts)
            lines = "\n".join(x for x in whole.split("\n") if not x.isascii())
            got = {-1: np.bincount(_ascii_bigrams(_bytes(whole)), minlength=BUCKETS), 0: 10 * np.bincount(_bigrams(_bytes(lines))[1], minlength=BUCKETS) + np.bincount(_bigrams(_bytes(lines.title()))[1], minlength=BUCKETS), -2: np.bincount(_bigrams(_bytes(lines.upper()))[1], minlength=BUCKETS)}
            beyond = sum(not c.isascii() for c in lines)
            for k, chain in enumerate(CHAINS, 1):
                first = chain.steps[0][0]
                if first != "utf_8":
                    kept = encode(lines, first, "ignore")
                    if beyond and len(lines) - len(kept) > 0.1 * beyond:
                        continue  # not this language's encoding
                got[k] = np.bincount(_bigrams(_bytes(chain.garble(lines, "ignore")))[1], minlength=BUCKETS)
            got[-3] = np.array(_letters(whole))
            for k, n in got.items():
                b = np.flatnonzero(n)
                rows.append((lang, k, b, n[b]))
        yield pd.DataFrame(rows, columns=["lang", "chain", "bucket", "n"])


_COUNTS = "lang string, chain int, bucket array<int>, n array<bigint>"


def _add_counts(f: pd.DataFrame) -> pd.DataFrame:
    total = np.bincount(np.concatenate(f["bucket"].to_list()), weights=np.concatenate(f["n"].to_list()), minlength=1)
    b = np.flatnonzero(total)
    return pd.DataFrame({"lang": [f["lang"].iloc[0]], "chain": [f["chain"].iloc[0]], "bucket": [b], "n": [total[b].astype(np.int64)]})


class Model:
    """log P(bucket | language, chain); chain 0 is clean text. Built from (lang, chain, buckets, their counts)."""

    def __init__(self, counts: pd.DataFrame, ascii_share: dict[str, float]):
        self.langs = sorted(set(counts["lang"]))
        self.share = np.array([ascii_share.get(x, 1.0) for x in self.langs])
        self.chains: list[np.ndarray] = []
        self.log: list[np.ndarray] = []
        spelling, capitals = np.zeros((len(self.langs), BUCKETS)), np.zeros((len(self.langs), BUCKETS))
        for i, lang in enumerate(self.langs):
            own = counts[counts["lang"] == lang]
            ks = sorted(set(own["chain"]) - {-3, -2, -1, 0})
            table = np.zeros((len(ks) + 1, BUCKETS))
            row = {0: 0} | {k: j for j, k in enumerate(ks, 1)}
            for k, b, n in zip(own["chain"], own["bucket"], own["n"]):
                if k >= 0:
                    table[row[k], b] = n
            self.chains.append(np.array(ks, dtype=np.int64) - 1)
            self.log.append(self._smooth(table))
            for k, out in ((-1, spelling), (-2, capitals)):
                for b, n in own.loc[own["chain"] == k, ["bucket", "n"]].itertuples(index=False):
                    out[i, b] = n
        self.spelling = self._smooth(spelling)
        if self.langs:  # clean text as usual, in capitals, and with words of both
            usual, capital = np.stack([t[:, 0] for t in self.log], axis=1), self._smooth(capitals)
            self.clean = np.concatenate([usual, capital, np.logaddexp(usual, capital) - np.float32(np.log(2))], axis=1)

    @staticmethod
    def _smooth(counts: np.ndarray) -> np.ndarray:
        total = counts.sum(axis=1, keepdims=True)
        p = (1 - EVEN) * counts / np.maximum(total, 1) + EVEN / BUCKETS
        return np.ascontiguousarray(np.log(p).T.astype(np.float32))

    def language(self, text: str, data: np.ndarray) -> int:
        """The page's language: of those of like script, the one whose spelling fits the ASCII bigrams best."""
        bucket = _ascii_bigrams(data)
        within, beyond = _letters(text)
        share = within / max(1, within + beyond)
        if len(bucket) < 20:
            return int(np.argmin(np.abs(self.share - share)))
        like = (self.share < 0.3) == (share < 0.3)
        score = self.spelling[bucket].sum(axis=0)
        return int(np.argmax(np.where(like, score, -np.inf) if like.any() else score))

    def line_ratios(self, data: np.ndarray, lang: int) -> tuple[np.ndarray, np.ndarray]:
        """(position of a line's first evidence, log likelihood ratio of each chain to clean text), for lines with evidence.

        Clean text may be of any language: an inserted line of another one is no sign of a wrong encoding.
        """
        at, bucket = _bigrams(data)
        ends = np.flatnonzero(data == 10)
        line = np.searchsorted(ends, at)
        first = np.flatnonzero(np.r_[True, line[1:] != line[:-1]]) if len(at) else np.zeros(0, dtype=np.int64)
        own = self.log[lang]
        scores = np.empty((len(first), own.shape[1]), dtype=np.float32)
        clean = np.empty((len(first), self.clean.shape[1]), dtype=np.float32)
        step = 2000  # lines at a time, to bound memory
        for i in range(0, len(first), step):
            a, b = first[i], first[i + step] if i + step < len(first) else len(at)
            cut = first[i : i + step] - a
            scores[i : i + step] = np.add.reduceat(own[bucket[a:b]], cut, axis=0)
            clean[i : i + step] = np.add.reduceat(self.clean[bucket[a:b]], cut, axis=0)
        cost = np.full(3 * len(self.langs), OTHER_LANGUAGE, dtype=np.float32)
        cost[lang :: len(self.langs)] = 0
        cost[len(self.langs) :] += CAPITALS
        base = (clean - cost).max(axis=1) if len(first) else scores[:, 0]
        return at[first], scores[:, 1:] - base[:, None]

    def clean_mean(self, text: str, lang: int) -> float:
        """Mean log likelihood of the evidence bigrams as clean text of the language; 0 without any."""
        bucket = _bigrams(_bytes(text))[1]
        return float(self.clean[bucket][:, lang :: len(self.langs)].mean(axis=0).max()) if len(bucket) else 0.0


def _restore_line(model: Model, lang: int, line: str, chains: list[int]) -> tuple[str, int] | None:
    """(restored line, chain) by the first of ``chains`` that decodes strictly and reads better; None without one."""
    now = model.clean_mean(line, lang)
    for k in dict.fromkeys(chains):
        if CHAINS[k].lossy:
            continue
        try:
            back = CHAINS[k].restore(line)
        except UnicodeError:
            continue
        if model.clean_mean(back, lang) > now + 0.5:
            return back, k
    return None


def judge(model: Model, text: str | None) -> tuple[bool, str | None, str | None, int]:
    """(garbled, chain, restored text, lines that lost letters) of a page; NULL, empty and ASCII texts are clean."""
    if not text or text.isascii() or not model.langs:
        lost = text.count("\ufffd") and sum("\ufffd" in x for x in text.split("\n")) if text else 0
        return lost > 0, None, None, lost
    data = _bytes(text)
    lang = model.language(text, data)
    starts, ratios = model.line_ratios(data, lang)
    lost = "\ufffd" in text
    support = np.maximum(ratios, 0).sum(axis=0)
    if not lost and (not ratios.size or ratios.max() < LINE_EVIDENCE or support.max() < PAGE_EVIDENCE):
        return False, None, None, 0
    # the page's own chains first, as a line alone holds little evidence; then what the line itself points to
    own = model.chains[lang]
    leading = [int(own[k]) for k in np.argsort(-support)[:3] if support[k] >= 0.5 * support.max()]
    lines, lines_lost, used, left = text.split("\n"), 0, {}, []
    for i, r in zip(np.searchsorted(np.flatnonzero(data == 10), starts).tolist(), ratios):
        if "\ufffd" in lines[i]:
            lines_lost += 1
            continue
        further = [int(own[k]) for k in np.argsort(-r)[:4]] if r.max() >= LINE_EVIDENCE else []
        got = _restore_line(model, lang, lines[i], leading + further)
        if got:
            lines[i] = got[0]
            used[got[1]] = used.get(got[1], 0) + 1
        elif r.max() >= LINE_EVIDENCE:
            left.append(i)
    if not used and not lost and ratios.max() < SURE_EVIDENCE:
        return False, None, None, 0
    for i in left:  # evidence, but for none of the leading chains: any other of the language
        got = _restore_line(model, lang, lines[i], [int(k) for k in own])
        if got:
            lines[i] = got[0]
            used[got[1]] = used.get(got[1], 0) + 1
    chain = CHAINS[max(used, key=used.get)].name if used else None
    return True, chain, "\n".join(lines) if used else None, lines_lost


def train(documents: DataFrame, sample_docs: int = SAMPLE_DOCS, id_col: str = "doc_id", lang_col: str = "lang", least_docs: int = LEAST_DOCS, max_languages: int = MAX_LANGUAGES) -> Model:
    """The classifier, from about ``sample_docs`` labelled documents of each language, chosen by hash.

    Each language has its own share, so that a rare one is learned as well as a frequent one; labels with fewer than
    ``least_docs`` documents, and those beyond the ``max_languages`` most frequent, are left out. Labels may be partly wrong.
    Trained in rounds: documents in which a classifier finds evidence of a chain are left out of the next. Counts are
    added up by the tasks; a row of them a language and chain reaches the driver, as the model that is sent to all
    tasks is made there. Sizes of languages are counted from the labels alone; texts are read once. Pages of a language without labelled
    documents are judged by the others. Without any labelled document the model calls only replacement characters
    garbled.
    """
    label = F.lower(F.trim(lang_col))
    labelled = documents.select(F.col(id_col).alias("id"), label.alias("lang"), "text").where("lang IS NOT NULL AND lang NOT IN ('', 'und')")
    sizes = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_docs).orderBy(F.desc("n"), "lang").limit(max_languages).collect()
    every = F.lit(None).cast("int")
    for r in sizes:
        every = F.when(F.col("lang") == r["lang"], F.lit(max(1, -(-r["n"] // sample_docs)))).otherwise(every)
    sample = labelled.where(F.pmod(F.xxhash64("id"), every) == 0).where("text IS NOT NULL").select("lang", "text")
    sample = cut(sample.repartition(max(1, -(-sum(min(r["n"], sample_docs) for r in sizes) // TASK_DOCS))))
    model = _fit(sample)
    for _ in range(ROUNDS - 1):

        def keep_clean(frames: Iterator[pd.DataFrame], model: Model = model) -> Iterator[pd.DataFrame]:
            for f in frames:
                yield f[[doubt(model, t) < DOUBT for t in f["text"]]]

        model = _fit(sample.mapInPandas(keep_clean, "lang string, text string"))
    return model


def doubt(model: Model, text: str) -> float:
    """The most evidence a line of the text gives for a chain."""
    if text.isascii() or not model.langs:
        return 0.0
    data = _bytes(text)
    ratios = model.line_ratios(data, model.language(text, data))[1]
    return np.inf if "\ufffd" in text else float(ratios.max()) if ratios.size else 0.0


def _fit(sample: DataFrame) -> Model:
    partial = sample.mapInPandas(_garbled_counts, _COUNTS)
    counts = partial.groupBy("lang", "chain").applyInPandas(_add_counts, _COUNTS).toArrow().to_pandas()
    share = {}
    for lang, b, n in counts.loc[counts["chain"] == -3, ["lang", "bucket", "n"]].itertuples(index=False):
        letters = dict(zip(b.tolist(), n.tolist()))  # 0: within ASCII, 1: beyond
        share[lang] = letters.get(0, 0) / max(1, letters.get(0, 0) + letters.get(1, 0))
    return Model(counts, share)


def detect(documents: DataFrame, model: Model | None = None, id_col: str = "doc_id") -> DataFrame:
    """(id, garbled, chain, restored, lines_lost) for each document.

    chain and restored are NULL for clean text and where nothing could be restored; lines_lost counts lines with
    replacement characters, whose letters are gone. NULL and empty texts are clean. Each row is judged alone:
    repeated rows give repeated results, an empty table an empty one. The whole text is read, however long.
    """
    model = model or train(documents, id_col=id_col)
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [judge(shared.value, t) for t in b.column(1).to_pylist()]
            columns = [pa.array([g[i] for g in got], kind) for i, kind in enumerate((pa.bool_(), pa.string(), pa.string(), pa.int32()))]
            yield pa.record_batch([b.column(0), *columns], names=[id_col, "garbled", "chain", "restored", "lines_lost"])

    rows = documents.select(F.col(id_col).cast("bigint"), F.col("text").cast("string"))
    return spread(rows).mapInArrow(run, f"{id_col} bigint, garbled boolean, chain string, restored string, lines_lost int")
