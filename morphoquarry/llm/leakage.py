"""Problem 9: passages of held-out items in documents, by winnowed fingerprints whose hits are extended."""

from __future__ import annotations

import html
import itertools
import re
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from morphoquarry.sources.tables import table

#: Most words of a fingerprint, and fingerprints of a window. Every shared run of GRAM + WINDOW − 1 = 6 words is found.
GRAM, WINDOW = 5, 2
#: Consecutive words that make a leak.
SPAN = 12
#: Of an item's words, one in so many may be replaced, dropped or added.
ONE_IN = 7
#: Items of a block; the corpus is read once for each block, whose words and fingerprints (under 30 MB) are broadcast.
BLOCK_ITEMS = 20_000
#: Words of documents that are fingerprinted at a time.
FLUSH_WORDS = 500_000

_TAGS = re.compile(r"</?[A-Za-z!][^<>]*>")
#: Blocks that hold no text, with what ends them.
_BLOCKS = ((re.compile(r"<!--.*?-->", re.S), "-->"), (re.compile(r"<script\b.*?</script\s*>", re.S | re.I), "</script"), (re.compile(r"<style\b.*?</style\s*>", re.S | re.I), "</style"))
_INLINE = re.compile(r"</?(?:a|abbr|b|code|em|font|i|mark|s|small|span|strong|sub|sup|tt|u)\b[^<>]*>", re.I)
_LINK = re.compile(r"!?\[([^\]\n]*)\]\([^()\s]*\)")
_BREAK = re.compile(r"[-­‐‑](?<=\w.)[ \t]*+(?>(?:\n[ \t>*+|#\-]*+)++)(?=[^\W\d_])")
_SIGN = r"[>|*+#•·‣\-–—]+|\[[ xX]?\]|\[\d{1,2}:\d{2}(?::\d{2})?\](?:\s*\w+:)?"
_COUNT = r"\(?(?:\d{1,4}|[A-Za-z])[.):]|\d{1,4}(?=\t| {2,})"
#: What may stand before a line's words. A number there may be a mark or the text's own, so each reading is tried.
_ALL_MARKS = re.compile(rf"\n[ \t]*(?:(?:{_SIGN}|{_COUNT})[ \t]*)+")
_FEWER_MARKS = (re.compile(rf"\n[ \t]*(?:{_SIGN}|{_COUNT})[ \t]*"), re.compile(rf"\n[ \t]*(?:(?:{_SIGN})[ \t]*)+"))
_SIGNS, _LETTER = re.compile(_SIGN), re.compile(r"[^\W_]")
_INNER = re.compile(r"[-'’ʼ­‐‑](?<=\w.)(?=\w)")
_HIDDEN = re.compile(r"[­​-‏⁠﻿‪-‮]")
_WORD = re.compile(r"[^\W_]+")
#: ASCII letters in lower case and digits; all else parts words.
_LOWER = bytes(c if chr(c).isalnum() and c < 128 else 32 for c in bytes(range(256)).lower())


def _without_blocks(text: str) -> str:
    """Only what lies before the last end of a block is searched, so that every opening found is closed and the search stays linear."""
    for block, end in _BLOCKS:
        last = text.lower().rfind(end) if end != "-->" else text.rfind(end)
        if last >= 0:
            last = text.find(">", last) + 1 or len(text)
            text = block.sub("\n", text[:last]) + text[last:]
    return text


def _tokens(text: str) -> list[bytes]:
    text = _INNER.sub("", text)
    if text.isascii():
        return text.encode().translate(_LOWER, b"*`").split()
    return [w.encode() for w in _WORD.findall(text.replace("*", "").replace("`", "").replace("_", " ").casefold())]


def encoded_readings(text: str | None) -> list[list[bytes]]:
    """The words by which texts are compared: without markup, line marks, hyphens of line breaks, case, punctuation or variant encodings.

    The first reading leaves out all marks and numbers at line starts. Where numbers or single letters stand there, the
    others leave out one of them, or marks only.
    """
    if not text:
        return [[]]
    text = unicodedata.normalize("NFKC", html.unescape(text)) if "&" in text or not text.isascii() else text
    text = "\n" + (text.replace("\r\n", "\n").replace("\r", "\n") if "\r" in text else text)
    if "<" in text:
        text = _TAGS.sub("\n", _INLINE.sub("", _without_blocks(text)))
    if "](" in text:
        text = _LINK.sub(r"\1", text)
    if not text.isascii():
        text = _HIDDEN.sub("", text.replace("­\n", "-\n"))
    text = _BREAK.sub("", text)
    met: list[str] = []

    def leave(found: re.Match) -> str:
        met.append(found[0])
        return "\n"

    out = [_tokens(_ALL_MARKS.sub(leave, text))]
    if _LETTER.search(_SIGNS.sub(" ", "".join(met))):
        for marks in _FEWER_MARKS:
            tokens = _tokens(marks.sub("\n", text))
            if tokens not in out:
                out.append(tokens)
    return out


def readings(text: str | None) -> list[list[str]]:
    return [[w.decode() for w in tokens] for tokens in encoded_readings(text)]


def words(text: str | None) -> list[str]:
    return readings(text)[0]


_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def gram_hashes(codes: np.ndarray, at: np.ndarray, gram: int) -> np.ndarray:
    """A number for the run of ``gram`` words from each position of ``at``."""
    out = np.zeros(len(at), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(gram):
            out = out * _MULTIPLIER + codes[at + i].astype(np.uint64)
        out ^= out >> np.uint64(31)
        out *= _MULTIPLIER
        return out ^ (out >> np.uint64(29))


def runs(codes: np.ndarray, gram: int) -> np.ndarray:
    """Positions from which ``gram`` words follow each other without a 0, which stands for a word of no item or the end of a text."""
    if len(codes) < gram:
        return np.zeros(0, np.int64)
    known = np.concatenate([[0], np.cumsum(codes != 0)])
    return np.flatnonzero(known[gram:] - known[:-gram] == gram)


def winnow(at: np.ndarray, grams: np.ndarray, window: int) -> np.ndarray:
    """Which of the grams at ascending positions are the smallest of some window of ``window`` positions; equal ones: the first.

    A window that holds no gram at some positions keeps the smallest of those it has, so runs of fewer grams than a
    window keep one too.
    """
    if window == 1 or not len(at):
        return np.arange(len(at))
    size = int(at[-1]) + 1 + 2 * (window - 1)
    dense = np.full(size, np.iinfo(np.uint64).max)
    dense[at + window - 1] = grams
    best = np.arange(size - window + 1)
    low = dense[best].copy()
    for step in range(1, window):
        other = dense[step : step + len(best)]
        less = other < low
        best[less] = np.flatnonzero(less) + step
        low[less] = other[less]
    keep = np.zeros(size, bool)
    keep[best] = True
    return np.flatnonzero(keep[at + window - 1])


def least_run(words_of_item: int) -> int:
    """The run of words that a copy keeps whole at least, wherever one word in ``ONE_IN`` is replaced, dropped or added."""
    changes = words_of_item // ONE_IN
    return -(-(words_of_item - changes) // (changes + 1))


def fingerprint_shape(words_of_item: int) -> tuple[int, int]:
    """(words, window) so that a run of the item's ``least_run`` words holds a whole window."""
    run = least_run(words_of_item)
    gram = min(GRAM, run)
    return gram, min(WINDOW, run - gram + 1)


def run_lengths(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each pair of positions (i in a, j in b) the longest run of equal words through it; 0 in b equals nothing."""
    length = np.zeros(len(i), np.int64)
    for step, x, y in ((1, i, j), (-1, i - 1, j - 1)):
        left = np.arange(len(i))
        while len(left):
            left = left[(x[left] >= 0) & (x[left] < len(a)) & (y[left] >= 0) & (y[left] < len(b))]
            left = left[(a[x[left]] == b[y[left]]) & (b[y[left]] > 0)]
            length[left] += 1
            x, y = x + step, y + step
    return length


def least_hits(words_of_item: int) -> int:
    """Winnowed fingerprints that a copy with the permitted changes shares with the item at least: one for each window of its whole runs."""
    gram, window = fingerprint_shape(words_of_item)
    changes = words_of_item // ONE_IN
    return max(1, -(-(words_of_item - changes - (gram + window - 2) * (changes + 1)) // window))


def holds_whole(item: np.ndarray, doc: np.ndarray, offsets: np.ndarray, most: int) -> bool:
    """Whether some part of doc becomes the item by at most ``most`` words replaced, dropped or added.

    ``offsets``: of hits, the position in doc less that in the item. Only columns near the diagonals of hits are looked at: with so few edits, the part lies within ``most`` words of one.
    """
    n = len(item)
    ranges: list[list[int]] = []
    for o in np.unique(offsets).tolist():
        lo, hi = max(0, o - most), min(len(doc), o + n + most)
        if ranges and lo <= ranges[-1][1]:
            ranges[-1][1] = max(ranges[-1][1], hi)
        else:
            ranges.append([lo, hi])
    for lo, hi in ranges:
        part = doc[lo:hi]
        m = len(part)
        row = np.zeros(m + 1, np.int32)  # the part may begin anywhere
        steps = np.arange(m + 1, dtype=np.int32)
        for i in range(n):
            change = row[:-1] + (part != item[i])
            new = np.empty(m + 1, np.int32)
            new[0] = i + 1
            new[1:] = np.minimum(row[1:] + 1, change)
            row = np.minimum.accumulate(new - steps) + steps  # words added in between
            if row.min() > most:
                break
        else:
            if row.min() <= most:
                return True
    return False


class Items:
    """The held-out side: words by number, and for each shape of fingerprints the winnowed ones, sorted for lookups of whole arrays."""

    def __init__(self, ids: list, texts: list[str | None]):
        self.ids, self.number, self.words, shapes = ids, {}, [], {}
        for k, text in enumerate(texts):
            item = np.array([self.number.setdefault(w, len(self.number) + 1) for w in encoded_readings(text)[0]], np.int32)
            self.words.append(item)
            if len(item):
                gram, window = fingerprint_shape(len(item))
                at = np.arange(len(item) - gram + 1)
                prints = gram_hashes(item, at, gram)
                keep = winnow(at, prints, window)
                held = shapes.setdefault((gram, window), ([], [], []))
                held[0].append(prints[keep]), held[1].append(np.full(len(keep), k)), held[2].append(keep)
        # one after another with −1 behind each, which equals no word
        self.flat = np.concatenate([np.append(w, -1) for w in self.words]) if self.words else np.zeros(0, np.int32)
        self.first = np.cumsum([0] + [len(w) + 1 for w in self.words])[:-1]
        self.least = np.array([least_hits(len(w)) if len(w) else 1 for w in self.words])
        self.shapes = []
        for (gram, window), parts in sorted(shapes.items()):
            prints, item, at = map(np.concatenate, parts)
            order = np.argsort(prints, kind="stable")
            self.shapes.append((gram, window, prints[order], item[order], at[order]))

    def hits(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(item, its position, the stream's position) wherever a fingerprint of the word stream is one of an item."""
        out = []
        for gram, window, prints, item, at in self.shapes:
            where = runs(codes, gram)
            seen = gram_hashes(codes, where, gram)
            keep = winnow(where, seen, window)
            where, seen = where[keep], seen[keep]
            lo, hi = np.searchsorted(prints, seen, "left"), np.searchsorted(prints, seen, "right")
            n = hi - lo
            row = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            out.append((item[row], at[row], np.repeat(where, n)))
        return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 3

    def leaked(self, streams: list[tuple[int, list[int]]]) -> set[tuple[int, int]]:
        """(document, item) for word streams, each with its document's id, that hold SPAN words of an item in a row or nearly the whole."""
        found: set[tuple[int, int]] = set()
        lengths = np.array([len(s) for _, s in streams])
        ends = np.cumsum(lengths + 1)
        codes = np.zeros(int(ends[-1]) if len(ends) else 0, np.int32)
        starts = ends - lengths - 1
        inside = np.ones(len(codes), bool)
        inside[ends - 1] = False
        codes[inside] = np.fromiter(itertools.chain.from_iterable(s for _, s in streams), np.int32, int(lengths.sum()))
        item, at, where = self.hits(codes)
        if not len(item):
            return found
        stream = np.searchsorted(starts, where, "right") - 1
        order = np.lexsort((where, item, stream))
        item, at, where, stream = item[order], at[order], where[order], stream[order]
        runs_met = run_lengths(self.flat, codes, self.first[item] + at, where)
        pair = np.flatnonzero(np.append(True, (np.diff(stream) != 0) | (np.diff(item) != 0)))
        spans = np.maximum.reduceat(runs_met, pair) >= SPAN
        hits = np.diff(np.append(pair, len(item)))
        for p in np.flatnonzero(spans | (hits >= self.least[item[pair]])):
            one = slice(pair[p], pair[p] + hits[p])
            s, k = stream[pair[p]], item[pair[p]]
            key = (streams[s][0], self.ids[k])
            if key in found:
                continue
            # an item can be held whole only if the document has all its words but ``most``
            doc, words_of, most = codes[starts[s] : ends[s] - 1], self.words[k], len(self.words[k]) // ONE_IN
            if spans[p] or (len(words_of) - np.isin(words_of, doc).sum() <= most and holds_whole(words_of, doc, where[one] - starts[s] - at[one], most)):
                found.add(key)
        return found


def leaks(documents: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str) -> DataFrame:
    """(doc_id, item_id): the document holds at least 12 consecutive words of the item, or the item with at most one word in seven changed.

    An item's fingerprints are as long as the run of words that any permitted change leaves whole, 5 at most, so items
    of every length are found, single words included. Items of the same text are one to the search, however many copies
    there are, and get their ids afterwards. Texts are handled in blocks of bounded size whose fingerprints are
    broadcast; the corpus's fingerprints meet them where the documents are and are never moved. Documents are read
    whole. NULL and empty texts, texts without words and NULL ids leak nothing; repeated items and rows come out once.
    """
    spark = documents.sparkSession
    block = items.where(F.col(item_id).isNotNull() & F.col(item_text).isNotNull()).select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).alias("text"), F.sha2(F.col(item_text), 256).alias("key")).distinct()
    texts = block.select("key", "text").distinct()
    blocks = -(-texts.count() // BLOCK_ITEMS)
    docs = documents.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    out = None
    for b in range(max(1, blocks)):
        held = (texts if blocks <= 1 else texts.where(F.pmod(F.xxhash64("key"), F.lit(blocks)) == b)).toPandas()
        shared = spark.sparkContext.broadcast(Items(held["key"].tolist(), held["text"].tolist()))

        def run(batches, shared=shared):
            known = shared.value
            number, other = known.number.get, itertools.repeat(0)
            for pdf in batches:
                rows, streams, size = set(), [], 0
                for d, t in zip(pdf["doc_id"], pdf["text"]):
                    for tokens in encoded_readings(t):
                        streams.append((d, list(map(number, tokens, other))))
                        size += len(tokens)
                    if size > FLUSH_WORDS:
                        rows |= known.leaked(streams)
                        streams, size = [], 0
                rows |= known.leaked(streams)
                yield pd.DataFrame(sorted(rows), columns=["doc_id", "key"])

        part = docs.mapInPandas(run, "doc_id long, key string")
        out = part if out is None else out.unionAll(part)
    ids = block.select("key", "item_id")
    pairs = out.distinct().join(ids, "key").select("doc_id", "item_id")
    # only an item of several texts can come out twice now; the pairs of many copies are not moved again for nothing
    several = block.groupBy("item_id").count().where("count > 1").limit(1).count()
    return pairs.distinct() if several else pairs


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return leaks(table(spark, folder, "documents"), "doc_id", "text", table(spark, folder, "benchmark"), "item_id", "text")


QUERIES = {"p9_found": p9_found}
