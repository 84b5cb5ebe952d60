"""Reading level of documents by a Rasch-style model of word difficulty.

Documents and words share one latent scale. Whether a word occurs in a document is a response: its log-odds
are, as in the unfolding form of the Rasch model, a word's ease less a quadratic in the distance of the
document's level from the word's difficulty, so that a word is likeliest where the document's level meets its
difficulty, and words of the ends of the scale go one way all along it. Lengths of sentences and words take part
as graded thresholds. Word parameters are estimated with document levels held, document levels with words
held, in turn, until the levels settle; the readers' labels, each reader with a precision of their own,
anchor the scale.
"""

from __future__ import annotations

import html
import math
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, small, spread

#: The scale of levels.
LEVELS = {"easy": -1.0, "medium": 0.0, "hard": 1.0}
#: Documents of fewer words of running prose have no level.
LEAST_WORDS = 40
#: Estimation ends when the mean level moves by less than SETTLED in a round; the rounds are bounded in any case.
SETTLED, MOST_ROUNDS = 0.005, 30
#: A word of the model occurs in at least this part of the labelled documents, and in at least so many. As a
#: document has some hundred different words, this bounds the model to some ten thousand words at any size.
LEAST_SHARE, LEAST_DOCS = 0.002, 3
#: Prior precision of a word's two slopes.
RIDGE = 0.1
#: Words of one document are not independent responses: all of them together count as a hundredth of their sum.
TEMPER = 0.01
#: A reader's judgements stray by at least this variance.
_LEAST_STRAY = 0.05

STEP = 0.05
GRID = np.round(np.arange(-50, 51) * STEP, 2)
_POWERS = np.stack([np.ones_like(GRID), GRID, GRID**2])
#: Documents fall into classes of length, half a doubling wide; a longer one is more exposed to every word.
LENGTHS = 10
_EXPOSURE = np.arange(LENGTHS) * 0.5 * math.log(2)

_TAG = re.compile(r"</?[a-zA-Z][^<>]*>")
#: Tokens that are no words: with digits or code signs, paths, addresses and file names; and what every such one has.
_NO_WORD = re.compile(r"[\d_=@#{}\[\]|\\/]|\.[A-Za-z]{2,5}[.,;:!?)]*$")
_ODD = re.compile(r"[\d_=@#{}\[\]|\\/]|\.[A-Za-z]")
_BYTE = re.compile(r"[0-9a-fA-F]{2}")
_MARK = re.compile(r"^[\s>*#•·–—+-]+(?=\s|[^\W\d_])")
_WORD = re.compile(r"[^\W\d_](?:[^\W\d_]|['’-])*")
_STOP = re.compile(r"[.!?…](?:(?<=[\w)\]\"”»'’]{2}[.!?…])[.!?…]*(?=\s|$)|[.!?…]*$)")


def _latin(letter: str) -> bool:
    return letter < "ɐ" or "Ḁ" <= letter <= "ỿ"


def prose_sentences(text: str | None) -> list[list[str]]:
    """Sentences of running prose as lists of lower-case words; logs, tables, dumps and listings give none.

    A line counts if words make up most of it; markup, bullets and quoting are taken off, and paths, file
    names, hashes and numbers are left out. A line break ends a sentence unless the next line goes on in
    lower case.
    """
    if not text:
        return []
    if "<" in text:
        text = _TAG.sub("\n", text)
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = unicodedata.normalize("NFC", text)
    sentences: list[list[str]] = []
    going: list[str] = []
    for line in text.splitlines():
        rest = _MARK.sub("", line) if line and not line[0].isalpha() else line
        dump = False
        if _ODD.search(rest):
            tokens = rest.split()
            kept: list[str] = []
            for t in tokens:
                if t.isalpha() or not _NO_WORD.search(t):
                    kept.append(t)
                elif kept and t[-1] in ".!?":
                    kept[-1] += "."
            size = len(tokens)
            dump = size >= 8 and 2 * sum(len(t) == 2 and _BYTE.fullmatch(t) is not None for t in tokens) > size
            rest = " ".join(kept)
        else:
            size = len(rest.split())
        parts = [_WORD.findall(p) for p in _STOP.split(rest.lower())] if size else []
        n = sum(map(len, parts))
        first = _WORD.search(rest) if n >= 2 else None
        if first is None or dump or not _latin(first[0][0]) or sum(len(w) > 1 for p in parts for w in p) < 0.5 * size:
            if going and size:
                sentences.append(going)
                going = []
            continue
        if going and (first[0][0].isupper() or not rest.lstrip()[:1].isalpha()):
            sentences.append(going)
            going = []
        for k, part in enumerate(parts):
            going = going + part
            if k < len(parts) - 1 and going:
                sentences.append(going)
                going = []
    if going:
        sentences.append(going)
    return [s for s in sentences if len(s) > 1]


def evidence(text: str | None) -> tuple[int, list[str]]:
    """(number of prose words, different words and length thresholds reached)."""
    sentences = prose_sentences(text)
    n = sum(map(len, sentences))
    if n < LEAST_WORDS:
        return n, []
    marks = {w for s in sentences for w in s if len(w) > 1}
    # Every threshold of the mean and the middle length of sentences and of words, in steps of a third of a doubling.
    lengths = sorted(map(len, sentences))
    for name, x in (("mean", n / len(sentences)), ("middle", lengths[len(lengths) // 2]), ("letters", sum(len(w) for s in sentences for w in s) / n * 2)):
        marks.update(f"#{name}{k}" for k in range(round(3 * math.log2(x)) + 1))
    return n, sorted(marks)


def length_class(n: int) -> int:
    return min(LENGTHS - 1, max(0, round(2 * math.log2(n / LEAST_WORDS))))


def _texts(documents: DataFrame) -> DataFrame:
    lang = F.col("lang").cast("string") if "lang" in documents.columns else F.lit(None).cast("string")
    return documents.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", lang.alias("lang"))


def _occurrences(documents: DataFrame) -> DataFrame:
    """(doc_id, lang, size, marks) of every document with enough running prose; size is its class of length."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [(d, g, length_class(n), marks) for d, g, (n, marks) in zip(batch["doc_id"], batch["lang"], map(evidence, batch["text"])) if n >= LEAST_WORDS]
            yield pd.DataFrame(found, columns=["doc_id", "lang", "size", "marks"])

    return spread(_texts(documents)).mapInPandas(run, "doc_id long, lang string, size int, marks array<string>")


class Vocabulary:
    """The marks of the model and the communities of documents that use the same words.

    A French text says nothing by lacking English words: difficulties are estimated within communities of
    documents. A document belongs where the stated languages of the documents that share its words point,
    whatever its own stated language is.
    """

    def __init__(self, shares: dict[str, dict[str, int]], totals: dict[str, int]) -> None:
        self.communities = sorted({g for c in shares.values() for g in c}) or ["-"]
        self.marks = {m: k for k, m in enumerate(sorted(totals))}
        self.leaning = np.zeros((len(self.marks), len(self.communities)))
        for m, k in self.marks.items():
            if not m.startswith("#"):
                c = np.array([shares.get(m, {}).get(g, 0) + 0.5 for g in self.communities])
                self.leaning[k] = np.log(c / c.sum())
        #: Exposure does not raise a length threshold.
        self.exposed = np.array([not m.startswith("#") for m in sorted(totals)])

    def place(self, marks: list[str]) -> tuple[int, np.ndarray]:
        """(community, positions of the known marks)."""
        at = np.array([k for m in marks if (k := self.marks.get(m)) is not None], "int64")
        return (int(self.leaning[at].sum(axis=0).argmax()) if len(at) else 0), at

    @property
    def size(self) -> int:
        return len(self.marks) * len(self.communities)

    def items(self, community: int, at: np.ndarray) -> np.ndarray:
        """A mark is an item of its own in every community."""
        return community * len(self.marks) + at


class LevelModel:
    """Word parameters (ease, slope, bend) of every item and the two bounds between the levels."""

    def __init__(self, vocabulary: Vocabulary, ease: np.ndarray, slope: np.ndarray, bend: np.ndarray, bounds: tuple[float, float] = (-0.5, 0.5)) -> None:
        self.vocabulary, self.slope, self.bend, self.ease, self.bounds = vocabulary, slope, bend, ease, bounds
        m, exposed = len(vocabulary.marks), vocabulary.exposed
        #: Log-likelihood that nothing occurs, by community, class of length and level.
        self.silence = np.zeros((len(vocabulary.communities), LENGTHS, len(GRID)))
        for g in range(len(vocabulary.communities)):
            own = slice(g * m, (g + 1) * m)
            base = np.stack([ease[own], slope[own], bend[own]], axis=1) @ _POWERS
            for size in range(LENGTHS):
                self.silence[g, size] = -np.logaddexp(0, base + np.where(exposed, _EXPOSURE[size], 0.0)[:, None]).sum(axis=0)

    def curve(self, community: int, size: int, items: np.ndarray) -> np.ndarray:
        """Log-likelihood of a document at every level of the grid, up to a constant."""
        return self.silence[community, size] + self.slope[items].sum() * GRID + self.bend[items].sum() * GRID**2

    def latent_of(self, community: int, size: int, items: np.ndarray) -> float:
        """The most likely level given the words only, under a standard normal prior."""
        return float(GRID[(self.curve(community, size, items) - GRID**2 / 2).argmax()])

    def latent(self, n: int, marks: list[str]) -> float:
        community, at = self.vocabulary.place(marks)
        return self.latent_of(community, length_class(n), self.vocabulary.items(community, at))

    def level(self, x: float) -> str:
        return list(LEVELS)[(x >= self.bounds[0]) + (x >= self.bounds[1])]


def _fit_items(counts: np.ndarray, at_risk: np.ndarray, cells: np.ndarray, exposed: np.ndarray) -> np.ndarray:
    """(ease, slope, bend) of items by Newton steps on penalised binomial likelihoods, all items at once.

    ``counts`` and ``at_risk`` are items x cells; a cell is a class of length and a level of the grid.
    """
    features = _POWERS[:, cells % len(GRID)]
    offset = np.where(exposed[:, None], _EXPOSURE[cells // len(GRID)][None], 0.0)
    prior = np.array([0.01, RIDGE, RIDGE])
    share = (counts.sum(axis=1) + 0.5) / (at_risk.sum(axis=1) + 1.0)
    w = np.zeros((len(counts), 3))
    w[:, 0] = np.log(share / (1 - share)) - offset.mean(axis=1)
    for _ in range(25):
        p = 1 / (1 + np.exp(-(w @ features + offset)))
        pull = (counts - at_risk * p) @ features.T - np.array([0.0, RIDGE, RIDGE]) * w
        weight = at_risk * p * (1 - p)
        bend = np.einsum("wk,ik,jk->wij", weight, features, features, optimize=True) + np.diag(prior)
        step = np.clip(np.linalg.solve(bend, pull[..., None])[..., 0], -1, 1)
        w += step
        if np.abs(step).max(initial=0) < 1e-3:
            break
    return w


def _estimate_items(placed: DataFrame, at_risk: np.ndarray, vocabulary: Vocabulary) -> np.ndarray:
    """The item step: one aggregation of occurrences by item and cell, then all items of a task at once."""
    cells = np.flatnonzero(at_risk.sum(axis=0))
    place = np.full(at_risk.shape[1], -1)
    place[cells] = np.arange(len(cells))
    m, exposed = len(vocabulary.marks), vocabulary.exposed

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in range(0, len(batch), 256):
                part = batch.iloc[i : i + 256]
                counts = np.zeros((len(part), len(cells)))
                for k, (c, n) in enumerate(zip(part["cells"], part["n"])):
                    counts[k, place[np.asarray(c)]] = n
                item = part["item"].to_numpy()
                w = _fit_items(counts, at_risk[item // m][:, cells], cells, exposed[item % m])
                yield pd.DataFrame({"item": item, "ease": w[:, 0], "slope": w[:, 1], "bend": w[:, 2]})

    occurs = placed.select(F.explode("items").alias("item"), "cell").groupBy("item", "cell").agg(F.count(F.lit(1)).alias("n"))
    # An item has at most LENGTHS x len(GRID) cells.
    lists = occurs.groupBy("item").agg(F.collect_list(F.struct("cell", "n")).alias("x")).select("item", F.col("x.cell").alias("cells"), F.col("x.n").alias("n"))
    w = np.zeros((vocabulary.size, 3))
    w[:, 0] = -20.0  # never seen in this community
    for r in lists.mapInPandas(run, "item long, ease double, slope double, bend double").toLocalIterator():  # bounded by LEAST_SHARE
        w[r["item"]] = r["ease"], r["slope"], r["bend"]
    return w


def _estimate_levels(known: DataFrame, model: LevelModel) -> DataFrame:
    """The document step: the most likely level of each labelled document given its words and its labels."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            words = [model.curve(g, s, np.asarray(i, "int64")) for g, s, i in zip(batch["community"], batch["size"], batch["items"])]
            words = np.stack(words) if words else np.zeros((0, len(GRID)))
            said = batch["w"].to_numpy()[:, None] * (GRID - batch["x"].to_numpy()[:, None]) ** 2 / 2
            theta, latent = GRID[(TEMPER * words - said).argmax(axis=1)], GRID[(words - GRID**2 / 2).argmax(axis=1)]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "new": theta, "latent": latent})

    return known.select("doc_id", "community", "size", "items", "x", "w").mapInPandas(run, "doc_id long, new double, latent double")


def _best_bound(rows: list, above: float, otherwise: float) -> float:
    """The bound between latent levels that parts labels above ``above`` from the others with fewest errors."""
    hist = np.zeros((2, len(GRID)))
    for r in rows:
        hist[int(r["y"] > above), int(round((r["latent"] - GRID[0]) / STEP))] += r["n"]
    if not hist.sum(axis=1).all():
        return otherwise
    errors = np.concatenate([[0], np.cumsum(hist[1])]) + hist[0].sum() - np.concatenate([[0], np.cumsum(hist[0])])
    best = np.flatnonzero(errors == errors.min())
    return float(GRID[0] + STEP * (best[0] + best[-1] - 1) / 2)


def fit_levels(documents: DataFrame, labels: DataFrame, most_rounds: int = MOST_ROUNDS) -> LevelModel | None:
    """Estimate the model from all labelled documents by alternating between words, documents and readers.

    Labels that are null or not a level of the scale teach nothing; None if nothing is left to learn from.
    """
    scale = F.create_map(*[F.lit(x) for kv in LEVELS.items() for x in kv])
    judged = labels.select("doc_id", F.coalesce("reader", F.lit("")).alias("reader"), F.try_element_at(scale, F.lower(F.trim("level"))).alias("y"))
    judged = cut(judged.where(F.col("doc_id").isNotNull() & F.col("y").isNotNull()).distinct())
    wanted = documents.join(small(judged.select("doc_id").distinct(), 200_000), "doc_id", "left_semi")
    seen = cut(_occurrences(wanted).dropDuplicates(["doc_id"]))
    n = seen.count()
    if not n:
        return None
    least = min(n, max(LEAST_DOCS, math.ceil(LEAST_SHARE * n)))
    counts = seen.select("lang", F.explode("marks").alias("mark")).groupBy("mark", "lang").agg(F.count(F.lit(1)).alias("n"))
    frequent = counts.groupBy("mark").agg(F.sum("n").alias("n"), F.collect_list(F.struct("lang", "n")).alias("langs")).where(F.col("n") >= least)
    shares, totals = {}, {}
    for r in frequent.toLocalIterator():  # bounded by LEAST_SHARE
        totals[r["mark"]] = r["n"]
        shares[r["mark"]] = {x["lang"]: x["n"] for x in r["langs"] if x["lang"]}
    vocabulary = Vocabulary(shares, totals)

    def locate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(d, s, *vocabulary.place(m)) for d, s, m in zip(batch["doc_id"], batch["size"], batch["marks"])]
            yield pd.DataFrame([(d, g, s, vocabulary.items(g, at)) for d, s, g, at in rows], columns=["doc_id", "community", "size", "items"])

    located = cut(seen.mapInPandas(locate, "doc_id long, community int, size int, items array<long>"))
    readers = judged.select("reader").distinct().withColumn("precision", F.lit(8.0))
    level = F.col("theta")
    model, theta = None, None
    for _ in range(most_rounds):
        anchors = judged.join(small(readers, 100_000), "reader").groupBy("doc_id").agg(F.sum("precision").alias("w"), (F.sum(F.col("precision") * F.col("y")) / F.sum("precision")).alias("x"))
        known = located.join(anchors, "doc_id")
        known = known.join(theta, "doc_id") if theta is not None else known.withColumn("theta", F.col("x"))
        cell = F.col("size") * len(GRID) + F.round((level - float(GRID[0])) / STEP).cast("int")
        placed = cut(known.withColumn("cell", cell))
        at_risk = np.zeros((len(vocabulary.communities), LENGTHS * len(GRID)))
        for r in placed.groupBy("community", "cell").count().collect():  # communities x LENGTHS x len(GRID) rows at most
            at_risk[r["community"], r["cell"]] = r["count"]
        model = LevelModel(vocabulary, *_estimate_items(placed, at_risk, vocabulary).T)
        new = cut(_estimate_levels(placed, model).join(placed.select("doc_id", "theta"), "doc_id"))
        moved = new.agg(F.avg(F.abs(F.col("new") - level)).alias("m")).head()["m"]
        theta = new.select("doc_id", F.col("new").alias("theta"))
        said = judged.join(new.select("doc_id", "latent"), "doc_id")
        readers = cut(said.groupBy("reader").agg((1.0 / F.greatest(F.lit(_LEAST_STRAY), F.avg((F.col("y") - F.col("latent")) ** 2))).alias("precision")))
        if moved < SETTLED:
            break
    rows = said.groupBy("y", "latent").agg(F.count(F.lit(1)).alias("n")).collect()  # three times len(GRID) rows at most
    model.bounds = _best_bound(rows, -1.0, -0.5), _best_bound(rows, 0.0, 0.5)
    return model


def reading_levels(documents: DataFrame, labels: DataFrame, most_rounds: int = MOST_ROUNDS) -> DataFrame:
    """(doc_id, level, latent) of every document with at least LEAST_WORDS words of running prose.

    ``documents`` has ``doc_id`` and ``text`` and perhaps ``lang``, ``labels`` ``doc_id``, ``level`` and
    ``reader``. Null and empty texts, logs, tables, dumps and loose snippets have no level; whole texts count,
    however long. A document none of whose words the model knows gets what its lengths say. Without usable
    labels there is nothing to go by and no rows come back. Repeated labels count once, extra columns are ignored.
    """
    model = fit_levels(documents, labels, most_rounds)
    if model is None:
        return documents.sparkSession.createDataFrame([], "doc_id long, level string, latent double")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(d, model.latent(n, marks)) for d, (n, marks) in zip(batch["doc_id"], map(evidence, batch["text"])) if n >= LEAST_WORDS]
            yield pd.DataFrame([(d, model.level(x), x) for d, x in rows], columns=["doc_id", "level", "latent"])

    return spread(_texts(documents).select("doc_id", "text")).mapInPandas(run, "doc_id long, level string, latent double")
