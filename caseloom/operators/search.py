"""Ranking searches over hashes, vectors and words."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema
from ..functions import scalars as S
from ..functions.text import hex_digits, hex_to_long


def find_similar(files: DataFrame, target: int, bits: int = 12, limit: int = 200) -> DataFrame:
    """(id, distance, similarity) of the files nearest to one file by perceptual hash, itself first.

    Where both second hashes are known they may differ in ``bits + 2``. The probe is one row.
    """
    hashed = files.select("id", hex_to_long(hex_digits(F.col("phash"), 16)).alias("h"), hex_to_long(hex_digits(F.col("dhash"), 16)).alias("d")).where(S.meaningful_hash(F.col("h")))
    probe = hashed.where(F.col("id") == target).select(F.col("h").alias("ph"), F.col("d").alias("pd")).limit(1)
    distance = F.bit_count(F.col("h").bitwiseXOR(F.col("ph")))
    near = hashed.join(F.broadcast(probe), distance <= bits).where(F.col("d").isNull() | F.col("pd").isNull() | (F.bit_count(F.col("d").bitwiseXOR(F.col("pd"))) <= bits + 2))
    ranked = near.select("id", distance.alias("distance")).orderBy((F.col("id") != target), "distance", "id").limit(limit)
    return ranked.select("id", "distance", F.round(100.0 * (1 - F.col("distance") / 64.0), 1).alias("similarity"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; 0 for a vector without length."""
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))


def nearest_vectors(queries: DataFrame, vectors: DataFrame, least: float, per_pass: int = 4096) -> DataFrame:
    """(query_id, id, score) of all vectors with a cosine of at least ``least`` to a query vector.

    ``queries`` (id, vec) is a stated set, compared with all rows of ``vectors`` (id, vec) in passes of a
    bounded number of queries, one matrix product per batch of rows; only pairs that reach ``least`` leave a
    task. Vectors that are null, of another length than the queries', not finite or all zero match nothing.
    """
    wanted = queries.where(F.col("id").isNotNull() & F.col("vec").isNotNull()).select("id", "vec").dropDuplicates(["id"])
    passes = max(1, -(-wanted.count() // per_pass))
    out = None
    for k in range(passes):
        block = wanted.where(F.pmod(F.xxhash64("id"), F.lit(passes)) == k) if passes > 1 else wanted
        got = [(r["id"], np.asarray(r["vec"], "float64")) for r in block.collect()]
        good = [(i, v / np.linalg.norm(v)) for i, v in got if len(v) and np.isfinite(v).all() and np.linalg.norm(v) > 0]
        dims = Counter(len(v) for _, v in good).most_common(1)[0][0] if good else 0
        ids = np.array([i for i, v in good if len(v) == dims], "int64")
        unit = np.stack([v for _, v in good if len(v) == dims]) if len(ids) else np.empty((0, 1))

        def run(batches: Iterator[pd.DataFrame], ids: np.ndarray = ids, unit: np.ndarray = unit, dims: int = dims) -> Iterator[pd.DataFrame]:
            for batch in batches:
                fit = [(i, v) for i, v in zip(batch["id"], batch["vec"]) if v is not None and len(v) == dims]
                rows = np.array([v for _, v in fit], "float64").reshape(len(fit), dims or 1)
                norm = np.linalg.norm(rows, axis=1)
                usable = np.isfinite(rows).all(axis=1) & (norm > 0)
                rows, own = rows[usable] / norm[usable][:, None], np.array([i for i, _ in fit], "int64")[usable]
                score = np.round(rows @ unit.T, 6) if len(own) and len(ids) else np.empty((0, 0))
                at, q = np.nonzero(score >= least)
                yield pd.DataFrame({"query_id": ids[q] if len(q) else np.empty(0, "int64"), "id": own[at] if len(at) else np.empty(0, "int64"), "score": score[at, q] if len(q) else np.empty(0)})

        found = vectors.select("id", "vec").where(F.col("id").isNotNull()).mapInPandas(run, "query_id long, id long, score double")
        out = found if out is None else out.unionByName(found)
    return out


def word_overlap(documents: DataFrame, target: int, limit: int = 150) -> DataFrame:
    """(id, score): shared words weighted by rarity, over the root of the number of words of each document.

    ``documents`` has id and words (an array). Document frequencies are counted over all documents.
    """
    words = documents.select("id", F.explode(F.array_distinct("words")).alias("w"))
    total = documents.agg(F.count(F.lit(1)).alias("total"))
    df = words.groupBy("w").agg(F.count(F.lit(1)).alias("df"))
    probe = words.where(F.col("id") == target).select("w")
    weight = df.join(F.broadcast(probe), "w").join(F.broadcast(total)).select("w", F.ln(F.col("total") / F.col("df")).alias("idf"))
    sizes = documents.select("id", F.size(F.array_distinct("words")).alias("n"))
    scores = words.join(weight, "w").groupBy("id").agg(F.sum("idf").alias("s"))
    return scores.join(sizes, "id").select("id", F.round(F.col("s") / F.sqrt("n"), 6).alias("score")).orderBy(F.desc("score"), "id").limit(limit)


def document_frequencies(documents: DataFrame) -> DataFrame:
    """(word, df, idf) over all documents."""
    words = documents.select("id", F.explode(F.array_distinct("words")).alias("word"))
    total = documents.agg(F.count(F.lit(1)).alias("total"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("df")).join(F.broadcast(total)).select("word", "df", F.round(F.ln(F.col("total") / F.col("df")), 6).alias("idf"))


def merged_search(*engines: tuple[str, DataFrame]) -> DataFrame:
    """Hits (id, engine) of several searches: each file once, under the first engine that found it."""
    parts = [df.select("id", F.lit(i).alias("rank"), F.lit(name).alias("engine")) for i, (name, df) in enumerate(engines)]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.groupBy("id").agg(F.min(F.struct("rank", "engine")).alias("b")).select("id", "b.engine")


def face_matches(vectors: DataFrame, target: int, least: float = schema.FACE_COSINE, limit: int = 200) -> DataFrame:
    """(id, score) of faces alike to one face, itself first."""
    probe = vectors.where(F.col("id") == target).select(F.col("vec").alias("pv")).limit(1)
    scored = vectors.join(F.broadcast(probe)).select("id", F.round(cosine(F.col("vec"), F.col("pv")), 6).alias("score")).where(F.col("score") >= least)
    return scored.orderBy(F.col("id") != target, F.desc("score"), "id").limit(limit)
