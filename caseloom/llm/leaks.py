"""Held-out passages inside a training corpus, found by winnowed fingerprints.

Texts become words that ignore case, accents, punctuation, markup, invisible characters and line-break
hyphens. Of every window of consecutive word shingles the one with the smallest hash is a fingerprint, on both
sides; any stretch of ``WINDOW + SHINGLE - 1`` words shared with an item therefore shares a fingerprint with
it. Fingerprints of both sides are joined, and only documents and items that share one go on: there, stretches
of the item are aligned with the text, allowing words changed, added and dropped.
"""

from __future__ import annotations

import html
import re
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, small, spread

SHINGLE, WINDOW = 5, 2
#: An item counts as contained from a stretch of this part of its words on; the data has nothing between 0.3 and 0.6.
#: A stretch of 0.6 loses at most 0.05 to the distance of starts, and edits can widen one of 0.4 to 0.48 only.
LEAST_PART = 0.5
#: Of the aligned stretch, so much may be changed, added or dropped (one in ten, and an edge's width of slack).
MOST_EDITS = 0.16
#: A stretch of 0.6 of an item with one word in ten edited keeps at least 0.6 - 5 * 0.06 of the item's shingles,
#: less the four that end each stretch; a little below that, texts need not be aligned.
LEAST_GRAMS = 0.27
#: Bits of the sieve that keeps fingerprints no item has from being shuffled: at least 32 a fingerprint of the
#: items, at most 2**28 (32 MB). A fuller sieve lets more through; the join decides.
_SIEVE_BITS, _MOST_SIEVE_BITS = 32, 1 << 28
_PAGE = 32_768
#: Items of one document are verified in lots of about this many.
_LOT = 2048

_INLINE = re.compile(r"(?i)</?(?:b|i|em|strong|span|a|u|s|code|mark|sub|sup|small|font|tt|wbr)(?:\s[^<>]*)?/?>")
_TAG = re.compile(r"<!--.*?-->|</?[a-zA-Z][^<>]*>|<![^<>]*>", re.S)
_BROKEN = re.compile(r"[-‐‑](?<=\w[-‐‑])\s*\n[\s>|#*]*(?=\w)|=\r?\n")
_JOINT = re.compile(r"[-‐‑'’‘ʼ`´](?<=\w[-‐‑'’‘ʼ`´])[-‐‑'’‘ʼ`´]*(?=\w)")
_WORD = re.compile(r"[^\W_]+")


def _unseen() -> re.Pattern[str]:
    """Combining marks and format characters, as ranges of code points."""
    spans: list[list[int]] = []
    for c in range(sys.maxunicode + 1):
        if unicodedata.category(chr(c)) in ("Mn", "Me", "Cf"):
            if spans and spans[-1][1] == c - 1:
                spans[-1][1] = c
            else:
                spans.append([c, c])
    return re.compile("[" + "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in spans) + "]+")


_UNSEEN = _unseen()


def words_of(text: str | None) -> list[str]:
    """The words of a text in the form in which passages are compared; a null text has none."""
    if not text:
        return []
    if "<" in text:
        text = _TAG.sub(" ", _INLINE.sub("", text))
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = _UNSEEN.sub("", unicodedata.normalize("NFKD", text))
    return _WORD.findall(_JOINT.sub("", _BROKEN.sub("", text)).casefold())


class Vocabulary(dict):
    """64-bit hashes of words, remembering recent ones."""

    def __init__(self, remembered: int = 500_000) -> None:
        super().__init__()
        self.remembered = remembered

    def __missing__(self, word: str) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h

    def hashes(self, words: list[str]) -> np.ndarray:
        if len(self) > self.remembered:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), "uint64", len(words))


def shingles(hashes: np.ndarray) -> np.ndarray:
    """A hash for every run of SHINGLE words."""
    n = len(hashes) - SHINGLE + 1
    if n <= 0:
        return np.empty(0, "uint64")
    out = np.zeros(n, "uint64")
    for k in range(SHINGLE):
        out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + n]
        out ^= out >> np.uint64(29)
    return out


def winnow(grams: np.ndarray) -> np.ndarray:
    """Positions of the least hash of every window; all positions of a text shorter than a window."""
    if len(grams) <= WINDOW:
        return np.arange(len(grams))
    windows = np.lib.stride_tricks.sliding_window_view(grams, WINDOW)
    return np.unique(np.arange(len(windows)) + windows.argmin(axis=1))


def holds(item: np.ndarray, text: np.ndarray) -> bool:
    """Whether a stretch of LEAST_PART of an item or more lies in a text with at most MOST_EDITS of it edited.

    Row by row, the fewest edits that turn the item's words from each start on into words that end at each place of
    the text. Starts are a twentieth of the item apart, which takes no more than that off a stretch's front.
    """
    size, m = len(item), len(text)
    least = max(1, int(np.ceil(LEAST_PART * size)))
    starts = np.arange(0, size - least + 1, max(1, size // 20))
    differs = (item[:, None] != text[None, :]).astype("int32")
    places = np.arange(m + 1, dtype="int32")
    edits = np.zeros((len(starts), m + 1), "int32")
    for i in range(size):
        # A start whose edits exceed what its longest stretch may have is given up.
        on = (starts + i < size) & (edits.min(axis=1) <= MOST_EDITS * (size - starts))
        starts, edits = starts[on], edits[on]
        if not len(starts):
            return False
        new = edits + 1
        np.minimum(new[:, 1:], edits[:, :-1] + differs[starts + i], out=new[:, 1:])
        # Words added in the text cost one edit each.
        edits = np.minimum.accumulate(new - places, axis=1) + places
        if i + 1 >= least and edits.min() <= MOST_EDITS * (i + 1):
            return True
    return False


def contains(text: np.ndarray, item: np.ndarray) -> bool:
    """Whether a text, given as word hashes, holds a large enough part of an item, given alike."""
    size = len(item)
    grams, own = shingles(text), shingles(item)
    if not len(grams) or not len(own):
        return False
    order = np.argsort(own, kind="stable")
    own = own[order]
    lo, hi = np.searchsorted(own, grams, "left"), np.searchsorted(own, grams, "right")
    n = hi - lo
    where = np.repeat(np.arange(len(grams)), n)
    place = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    d = np.sort(where - order[place])
    slack = max(3, size // 5)
    # Shingles that lie within one edit-wide diagonal, counted once per place in the text.
    count = np.searchsorted(d, d + slack, "right") - np.arange(len(d))
    for first in _starts(d, count, max(1, LEAST_GRAMS * size - SHINGLE + 1), slack):
        a, z = max(0, int(d[first]) - slack), min(len(text), int(d[first]) + size + 2 * slack)
        if holds(item, text[a:z]):
            return True
    return False


def _starts(d: np.ndarray, count: np.ndarray, least: float, slack: int) -> Iterator[int]:
    """Places on the diagonal axis that hold enough, the fullest first, each a good way from the others."""
    taken: dict[int, int] = {}  # by stretches of the axis that are too short for two
    for i in np.argsort(-count, kind="stable"):
        if count[i] < least:
            return
        at = int(d[i])
        k = at // (slack + 1)
        if all(abs(at - taken.get(n, at + slack + 1)) > slack for n in (k - 1, k, k + 1)):
            taken[k] = at
            yield int(i)


def least_shared(size: int) -> int:
    """How many fingerprints an item of ``size`` words shares with any text that holds 60 percent of it, one word in ten edited.

    The edits part the stretch; a piece of c words has c - 5 windows whose least hash both sides choose, and one hash is
    the least of WINDOW windows at most.
    """
    stretch = -(-size * 6 // 10)
    windows = stretch - stretch // 10 - (SHINGLE + WINDOW - 2) * (stretch // 10 + 1)
    return max(1, -(-windows // WINDOW))


def _item_prints(items: DataFrame, kind: str) -> DataFrame:
    """(item_id, words, prints, need): word hashes as bytes, winnowed fingerprints, and how many a document must share.

    An item that repeats a fingerprint may share fewer different ones; there, one is enough to go on.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocabulary = Vocabulary()
        for batch in batches:
            rows = []
            for i, t in zip(batch["item_id"], batch["text"]):
                words = vocabulary.hashes(words_of(t))
                grams = shingles(words)
                if len(grams):
                    places = winnow(grams)
                    prints = np.unique(grams[places]).view("int64")
                    rows.append((i, words.tobytes(), prints, least_shared(len(words)) if len(prints) == len(places) else 1))
            yield pd.DataFrame(rows, columns=["item_id", "words", "prints", "need"])

    return items.mapInPandas(run, f"item_id {kind}, words binary, prints array<long>, need int")


def _sieve(prints: DataFrame) -> np.ndarray:
    """A bitmap of the items' fingerprints modulo its length; built in the JVM, of bounded size whatever the items."""
    n = prints.count()
    bits = min(_MOST_SIEVE_BITS, max(_PAGE, 1 << (max(1, n) * _SIEVE_BITS - 1).bit_length()))
    at = prints.select(F.pmod("print", F.lit(bits)).alias("at"))
    pages = at.groupBy(F.floor(F.col("at") / _PAGE).alias("page")).agg(F.bitmap_construct_agg((F.col("at") % _PAGE).cast("long")).alias("bitmap"))
    sieve = np.zeros(bits // 8, "uint8")
    for r in pages.toLocalIterator():
        own = np.frombuffer(r["bitmap"], "uint8")
        sieve[r["page"] * (_PAGE // 8) : r["page"] * (_PAGE // 8) + len(own)] = own
    return sieve


def _document_prints(documents: DataFrame, sieve: np.ndarray) -> DataFrame:
    """(doc_id, words, prints) of documents with a fingerprint that passes the sieve, those prints only."""
    bits = np.int64(len(sieve) * 8)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocabulary = Vocabulary()
        for batch in batches:
            rows = []
            for d, t in zip(batch["doc_id"], batch["text"]):
                words = vocabulary.hashes(words_of(t))
                grams = shingles(words)
                prints = grams[winnow(grams)].view("int64")
                at = prints % bits
                prints = prints[(sieve[at >> 3] >> (at & 7).astype("uint8")) & 1 == 1]
                if len(prints):
                    rows.append((d, words.tobytes(), np.unique(prints)))
            yield pd.DataFrame(rows, columns=["doc_id", "words", "prints"])

    return documents.mapInPandas(run, "doc_id long, words binary, prints array<long>")


def leaked_items(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id) of every document and each held-out item it contains in good part.

    An item is contained if one stretch of the document holds 60 percent of its words or more in order, with at
    most one word in ten changed, added or dropped; below half of the words it is not. Null and empty texts contain nothing and are contained in nothing;
    items of fewer than five words cannot be told from chance and are not looked for; of items of fewer than 20
    words an edited part may share no stretch of six words and be missed. Repeated rows count once, null ids are left
    out, extra columns are ignored. Documents are read whole, once; what is shuffled are the fingerprints that
    some item may have, and the words of documents that share enough of them with an item.
    """
    kind = dict(items.dtypes)["item_id"]
    wanted = items.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select("item_id", "text").distinct()
    held_out = cut(_item_prints(wanted, kind))
    item_prints = held_out.select("item_id", "need", F.explode("prints").alias("print"))
    texts = spread(documents.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text"))
    # Of several texts of one id, each is looked at; rows are told apart by their words.
    seen = cut(_document_prints(texts, _sieve(item_prints)).withColumn("row", F.xxhash64("doc_id", "words")))
    met = seen.select("doc_id", "row", F.explode("prints").alias("print")).join(small(item_prints, 2_000_000), "print")
    pairs = met.groupBy("doc_id", "row", "item_id").agg(F.count(F.lit(1)).alias("n"), F.min("need").alias("need")).where(F.col("n") >= F.col("need")).select("doc_id", "row", "item_id")
    words = held_out.groupBy("item_id").agg(F.collect_set("words").alias("forms"))  # texts of one item
    lots = F.pmod(F.xxhash64("item_id"), F.lit(max(1, -(-held_out.count() // _LOT))))
    lists = pairs.join(small(words, 200_000), "item_id").groupBy("doc_id", "row", lots.alias("lot")).agg(F.collect_list(F.struct("item_id", "forms")).alias("items"))
    both = lists.join(seen.select("doc_id", "row", "words"), ["doc_id", "row"])

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for d, own, held in zip(batch["doc_id"], batch["words"], batch["items"]):
                text = np.frombuffer(own, "uint64")
                rows += [(d, x["item_id"]) for x in held if any(contains(text, np.frombuffer(f, "uint64")) for f in x["forms"])]
            yield pd.DataFrame(rows, columns=["doc_id", "item_id"])

    return both.select("doc_id", "words", "items").mapInPandas(verify, f"doc_id long, item_id {kind}").distinct()
