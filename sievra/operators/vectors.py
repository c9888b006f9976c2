"""Embedding, clustering, product codes, rotation and inverted-list search."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sievra.functions.text import query_terms
from sievra.functions.vector import MAX_LISTS, choose_nlist
from sievra.operators import clustering
from sievra.operators.candidates import code_places, search_candidates
from sievra.operators.chunks import CHUNK_OVERLAP, CHUNK_WORDS, chunk_words
from sievra.operators.code_search import SHARE, search_codes
from sievra.operators.lexical import top_k
from sievra.operators.neighbours import MAX_QUERY_NUMBERS, TOP_K, embedding_matrix, knn_exact, matrix, nearest, pair_scores
from sievra.operators.sampling import TRAIN_VECTORS_PER_LIST, random_sample
from sievra.session import broadcast_if_fits, settle

# Vector length, subvectors, codes per subvector, lists searched, encoder batch.
DIM = 384
SUBVECTORS = 12
CODES = 256
NPROBE = 512
ENCODE_BATCH = 1024
# Vectors that the codes hand on to the exact ranking, unless a number is chosen for the data.
CANDIDATES = 1000
ROTATED_ROWS = 256
# Words of a batch that are added up at a time.
HASHED_WORDS = 1 << 18

Encoder = Callable[[list[str]], np.ndarray]
IDS = ("doc_id", "chunk_no")


# Embedding ------------------------------------------------------------------------------------


def hash_embedding(text_col, dim: int):
    """Unit vector of hashed words (floats); the offline stand-in for a sentence encoder.

    The words of a text are hashed by MD5 on the JVM: the number in the first eight hex digits picks the
    position, the ninth digit the sign. Only these numbers go to Python, which adds them up.
    """

    def hashed(word):
        return F.conv(F.substring(F.md5(word), 1, 9), 16, 10).cast("bigint")

    @F.arrow_udf("array<float>")
    def add_up(column: pa.Array) -> pa.Array:
        number, offsets = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy() - column.offsets[0].as_py()
        out = np.zeros((len(column), dim), np.float32)
        for start, end in _portions(offsets, HASHED_WORDS):
            some = number[offsets[start] : offsets[end]]
            place = np.repeat(np.arange(end - start) * dim, np.diff(offsets[start : end + 1])) + (some >> 4) % dim
            sums = np.bincount(place, np.where((some & 15) < 8, -1.0, 1.0), (end - start) * dim)
            out[start:end] = _unit_rows(sums.reshape(-1, dim))
        return _as_lists(out, pa.float32())

    return add_up(F.transform(query_terms(F.coalesce(text_col, F.lit(""))), hashed))


def _portions(offsets: np.ndarray, most: int):
    """Ranges of rows, in order, with at most ``most`` words each, or one row: working memory does not grow with a batch."""
    start = 0
    while start < len(offsets) - 1:
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + most, side="right")) - 1)
        yield start, end
        start = end


def _unit_rows(m: np.ndarray) -> np.ndarray:
    norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, norm, out=np.zeros_like(m, dtype=np.float64), where=norm > 0)


def _as_lists(m: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.arange(0, m.size + 1, m.shape[1] or 1, dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(m.ravel(), kind))


def _encode(text_col, encoder: Encoder | None, dim: int):
    if encoder is None:
        return hash_embedding(text_col, dim)

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        out = []
        for at in range(0, len(texts), ENCODE_BATCH):
            batch = texts.iloc[at : at + ENCODE_BATCH].fillna("").tolist()
            made = np.asarray(encoder(batch), dtype=np.float64)
            if made.shape != (len(batch), dim):
                raise ValueError(f"encoder returned {made.shape} for {len(batch)} texts of {dim} numbers")
            out += list(_unit_rows(made).astype(np.float32))
        return pd.Series(out)

    return run(text_col)


def embed_chunks(
    df: DataFrame,
    encoder: Encoder | None = None,
    dim: int = DIM,
    size: int = CHUNK_WORDS,
    overlap: int = CHUNK_OVERLAP,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``(doc_id, chunk_no, embedding)``: padded overlapping chunks at unit length, other columns dropped.

    ``encoder`` maps a list of texts to a matrix and runs inside the tasks.
    """
    chunks = chunk_words(df.select(F.col(id_col).alias("doc_id"), text_col), text_col, size, overlap, pad=True)
    return chunks.select("doc_id", "chunk_no", _encode(F.col("chunk"), encoder, dim).alias("embedding"))


def embed_queries(
    df: DataFrame, encoder: Encoder | None = None, dim: int = DIM, id_col: str = "query_id", text_col: str = "text"
) -> DataFrame:
    """``(query_id, embedding)`` at unit length; the same encoder as for the chunks."""
    return df.select(F.col(id_col).alias("query_id"), _encode(F.col(text_col), encoder, dim).alias("embedding"))


def validate_vectors(df: DataFrame, dim: int = DIM, id_cols: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row about all vectors: ``n, n_empty, min_dim, max_dim, as_expected``.

    Missing columns are an error; every row is looked at, not the first one only.
    """
    missing = [c for c in (*id_cols, "embedding") if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; found {df.columns}")
    n = F.size("embedding")
    report = df.agg(
        F.count("*").alias("n"),
        F.count_if(F.col("embedding").isNull() | (n <= 0)).alias("n_empty"),
        F.min(F.when(n > 0, n)).alias("min_dim"),
        F.max(F.when(n > 0, n)).alias("max_dim"),
    )
    good = (F.col("n_empty") == 0) & (F.col("min_dim") == dim) & (F.col("max_dim") == dim)
    return report.withColumn("as_expected", F.coalesce(good, F.lit(False)))


# Coarse lists ---------------------------------------------------------------------------------


def list_count(vectors: DataFrame, most: int = MAX_LISTS) -> int:
    """Number of lists for a table of vectors, at most ``most``."""
    return vectors.agg(choose_nlist(F.count("*"), most).alias("n")).first()["n"]


def training_sample(vectors: DataFrame, nlist: int, seed: int = 0, ids: tuple[str, ...] = IDS) -> DataFrame:
    """Exactly ``min(100 * nlist, n)`` vectors."""
    return random_sample(vectors, TRAIN_VECTORS_PER_LIST * nlist, seed, *ids)


def train_centroids(
    sample: DataFrame, nlist: int, seed: int = 0, max_iter: int = 10, column: str = "embedding"
) -> DataFrame:
    """``(list_id, center)``: exactly ``nlist`` centres by k-means over a training sample, the same for any partitioning.

    The driver and every task hold the centres when vectors are placed.
    """
    centers = clustering.train(sample, nlist, 1, seed, max_iter, column)[0]
    table = pa.table({"list_id": np.arange(len(centers), dtype=np.int32), "center": _as_lists(centers, pa.float64())})
    return sample.sparkSession.createDataFrame(table)


def _center_matrix(centroids: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Ids and centres, in id order: as many as the index was trained with (``nlist``)."""
    rows = centroids.select("list_id", "center").orderBy("list_id").toArrow()
    return rows["list_id"].to_numpy().astype(np.int32), matrix(rows["center"])


def _closest_lists(centroids: DataFrame, n: int):
    list_ids, centers = _center_matrix(centroids)

    @F.arrow_udf("array<int>")
    def find(column: pa.Array) -> pa.Array:
        rows = matrix(column) if len(column) else np.zeros((0, centers.shape[1]))
        return _as_lists(list_ids[clustering.nearest_centers(rows, centers, n)[0]], pa.int32())

    return find


def assign_lists(vectors: DataFrame, centroids: DataFrame) -> DataFrame:
    """Add ``list_id``, the nearest centre of each vector; the lower id on ties. No shuffle."""
    nearest_list = _closest_lists(centroids, 1)(F.col("embedding"))
    return vectors.withColumn("list_id", F.get(nearest_list, F.lit(0)))


def probe_lists(queries: DataFrame, centroids: DataFrame, nprobe: int) -> DataFrame:
    """Add ``lists``, the ``nprobe`` nearest centres of each query, nearest first."""
    return queries.withColumn("lists", _closest_lists(centroids, nprobe)(F.col("embedding")))


def lloyd_step(vectors: DataFrame, centroids: DataFrame) -> DataFrame:
    """``(list_id, center)`` after one k-means step; a list without vectors keeps its centre.

    Every task sums its vectors by list and hands on one row per list; these are added number by number, combined
    before the shuffle, so a list with most of the vectors costs no more than another.
    """
    assigned = assign_lists(vectors.select("embedding"), centroids)
    dim = len(centroids.first()["center"])

    def sums(batches):
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            rows, lists = matrix(batch.column("embedding")), batch.column("list_id").to_numpy()
            found, place = np.unique(lists, return_inverse=True)
            part = np.zeros((len(found), dim + 1))
            np.add.at(part[:, :dim], place, rows)
            part[:, dim] = np.bincount(place, minlength=len(found))
            for list_id, row in zip(found.tolist(), part):
                totals[list_id] = totals[list_id] + row if list_id in totals else row
        if totals:
            ids = np.array(sorted(totals), np.int32)
            yield pa.RecordBatch.from_pydict({"list_id": ids, "sums": _as_lists(np.stack([totals[i] for i in ids]), pa.float64())})

    added = assigned.mapInArrow(sums, "list_id INT, sums ARRAY<DOUBLE>").groupBy("list_id").agg(
        *[F.sum(F.get("sums", F.lit(d))).alias(f"s{d}") for d in range(dim + 1)]
    )
    moved = added.select("list_id", F.array(*[F.col(f"s{d}") / F.col(f"s{dim}") for d in range(dim)]).alias("moved"))
    return centroids.join(moved, "list_id", "left").select(
        "list_id", F.coalesce("moved", "center").alias("center")
    )


# Product codes --------------------------------------------------------------------------------


def _residuals(vectors: DataFrame, centroids: DataFrame) -> DataFrame:
    """Vectors with their list's centre taken off, as ``embedding``; those of lists without a centre are left out."""
    known = vectors.join(broadcast_if_fits(centroids.select("list_id")), "list_id", "left_semi")
    list_ids, centers = _center_matrix(centroids)

    @F.arrow_udf("array<double>")
    def take(column: pa.Array, lists: pa.Array) -> pa.Array:
        if not len(column):
            return pa.array([], pa.list_(pa.float64()))
        return _as_lists(matrix(column) - centers[np.searchsorted(list_ids, lists.to_numpy())], pa.float64())

    return known.withColumn("embedding", take(F.col("embedding"), F.col("list_id")))


def pq_train(
    sample: DataFrame, subvectors: int = SUBVECTORS, codes: int = CODES, seed: int = 0, max_iter: int = 10
) -> DataFrame:
    """``(sub, code, center)``: a k-means codebook for each part of the vectors, all trained in the same passes."""
    books = clustering.train(sample, codes, subvectors, seed, max_iter)
    table = pa.table({
        "sub": np.repeat(np.arange(subvectors, dtype=np.int32), codes),
        "code": np.tile(np.arange(codes, dtype=np.int32), subvectors),
        "center": _as_lists(books.reshape(subvectors * codes, -1), pa.float64()),
    })
    return sample.sparkSession.createDataFrame(table)


def _books(codebooks: DataFrame) -> list[np.ndarray]:
    """Codebooks by subvector, rows in code order; 12 x 256 short vectors by default."""
    rows = codebooks.select("sub", "code", "center").orderBy("sub", "code").toArrow()
    sub = rows["sub"].to_numpy()
    code = rows["code"].to_numpy()
    centers = matrix(rows["center"])
    books = [centers[sub == j] for j in range(int(sub.max()) + 1)]
    for j, book in enumerate(books):
        if not np.array_equal(code[sub == j], np.arange(len(book))):
            raise ValueError(f"codes of subvector {j} are not numbered from 0")
    return books


def _coder(codebooks: DataFrame):
    """A function that gives the nearest code of each subvector."""
    books = _books(codebooks)
    width = books[0].shape[1]

    def code(rows: np.ndarray) -> np.ndarray:
        rows = rows.reshape(len(rows), len(books) * width)
        codes = [clustering.nearest_centers(rows[:, j * width : (j + 1) * width], book)[0] for j, book in enumerate(books)]
        return np.concatenate(codes, axis=1).astype(np.int32)

    return code


def pq_encode(vectors: DataFrame, codebooks: DataFrame, centroids: DataFrame | None = None) -> DataFrame:
    """Replace ``embedding`` by ``codes ARRAY<INT>``, the nearest code of each subvector.

    With ``centroids`` the difference to the centre of the vector's list is encoded.
    """
    coded = _coder(codebooks)

    @F.arrow_udf("array<int>")
    def encode(column: pa.Array) -> pa.Array:
        return _as_lists(coded(matrix(column)) if len(column) else np.zeros((0, 1), np.int32), pa.int32())

    source = vectors if centroids is None else _residuals(vectors, centroids)
    return source.withColumn("codes", encode(F.col("embedding"))).drop("embedding")


def _decoder(codebooks: DataFrame, centroids: DataFrame | None):
    books = _books(codebooks)
    list_ids, centers = _center_matrix(centroids) if centroids is not None else (None, None)

    def decode(table: pa.Table) -> np.ndarray:
        codes = matrix(table["codes"]).astype(np.int64)
        rows = np.concatenate([book[codes[:, j]] for j, book in enumerate(books)], axis=1)
        if centers is not None:
            rows = rows + centers[np.searchsorted(list_ids, table["list_id"].to_numpy())]
        return rows

    return decode


# Rotation -------------------------------------------------------------------------------------


def pq_rotation(sample: DataFrame, subvectors: int = SUBVECTORS) -> np.ndarray:
    """Orthogonal matrix that spreads the variance evenly over the subvectors.

    The parametric form of optimised product quantisation: principal axes of the sample, each handed to
    the subvector with the smallest product of variances so far. The covariance is a distributed
    aggregate; only a matrix of dimension by dimension reaches the driver.
    """
    spread = clustering.scatter(sample)
    dim = len(spread)
    if dim % subvectors:
        raise ValueError(f"{subvectors} subvectors do not divide {dim} numbers")
    share, axes = np.linalg.eigh(spread)
    share = np.maximum(share / max(share.sum(), 1e-300), 1e-12)
    parts: list[list[int]] = [[] for _ in range(subvectors)]
    weight = np.zeros(subvectors)
    for axis in np.argsort(-share, kind="stable"):
        open_parts = [j for j in range(subvectors) if len(parts[j]) < dim // subvectors]
        j = min(open_parts, key=lambda p: weight[p])
        parts[j].append(int(axis))
        weight[j] += np.log(share[axis])
    return axes[:, [axis for part in parts for axis in part]]


def rotate(vectors: DataFrame, rotation: np.ndarray) -> DataFrame:
    """Vectors times the rotation, as doubles; distances stay as they are."""

    @F.arrow_udf("array<double>")
    def turn(column: pa.Array) -> pa.Array:
        return _as_lists(_turned(matrix(column).reshape(len(column), len(rotation)), rotation), pa.float64())

    return vectors.withColumn("embedding", turn(F.col("embedding")))


def _turned(rows: np.ndarray, rotation: np.ndarray) -> np.ndarray:
    # Whole blocks, so that a product is made in the same steps whatever the number of rows around it.
    padded = np.concatenate([rows, np.zeros((-len(rows) % ROTATED_ROWS, len(rotation)))])
    return (padded @ rotation)[: len(rows)]


# Index and search -----------------------------------------------------------------------------


@dataclass(frozen=True)
class VectorIndex:
    """Inverted lists of vectors or codes.

    ``centroids(list_id, center)``; ``lists(list_id, *ids, embedding)``, ``(list_id, *ids, codes)`` or both, the vectors as
    they were given; ``codebooks(sub, code, center)`` with codes; ``rotation`` if vectors were rotated first.
    """

    centroids: DataFrame
    lists: DataFrame
    ids: tuple[str, ...]
    dim: int
    metric: str = "l2"
    nprobe: int = NPROBE
    codebooks: DataFrame | None = None
    rotation: np.ndarray | None = None
    residual: bool = False

    @property
    def kind(self) -> str:
        return "IVFFlat" if self.codebooks is None else "IVFPQ"


def build_vector_index(
    vectors: DataFrame,
    ids: tuple[str, ...] = IDS,
    nlist: int | None = None,
    subvectors: int | None = SUBVECTORS,
    codes: int = CODES,
    rotated: bool = True,
    residual: bool = True,
    metric: str = "l2",
    nprobe: int = NPROBE,
    seed: int = 0,
    max_iter: int = 10,
    keep_vectors: bool = False,
) -> VectorIndex:
    """Train on a sample, then place (and encode) every vector in its list.

    ``subvectors=None`` stores the vectors themselves, ``keep_vectors`` stores them beside their codes. The rotation applies to training, stored and
    query vectors alike. Assigning and encoding are map-only.
    """
    if metric == "cosine":
        raise ValueError("normalise the vectors and use metric 'ip' or 'l2'")
    nlist = nlist or list_count(vectors)
    sample = settle(training_sample(vectors.select(*ids, "embedding"), nlist, seed, ids), "sample")
    rotation = None
    if subvectors is not None and rotated:
        rotation = pq_rotation(sample, subvectors)
        sample = rotate(sample, rotation)
    centroids = train_centroids(sample, nlist, seed, max_iter)
    dim = len(centroids.first()["center"])
    if subvectors is None:
        codebooks = None
    else:
        training = _residuals(assign_lists(sample, centroids), centroids) if residual else sample
        codebooks = pq_train(training, subvectors, codes, seed, max_iter)
    coded = codebooks is not None
    lists = place_vectors(vectors, ids, centroids, codebooks, rotation, residual, keep_vectors)
    return VectorIndex(centroids, lists, ids, dim, metric, nprobe, codebooks, rotation, residual and coded)


def place_vectors(
    vectors: DataFrame, ids: tuple[str, ...], centroids: DataFrame, codebooks: DataFrame | None, rotation: np.ndarray | None,
    residual: bool, keep_vectors: bool = False,
) -> DataFrame:
    """The rows of :attr:`VectorIndex.lists` for ``vectors(*ids, embedding)`` under a trained quantiser; map-only.

    With codes, the steps of :func:`rotate`, :func:`assign_lists` and :func:`pq_encode` are made in one call of Python, so a vector
    goes there once and only its list and codes come back.
    """
    rows = vectors.select(*ids, "embedding")
    if codebooks is None:
        return assign_lists(rows if rotation is None else rotate(rows, rotation), centroids)
    list_ids, centers = _center_matrix(centroids)
    code = _coder(codebooks)

    @F.arrow_udf("struct<list_id:int,codes:array<int>>")
    def place(column: pa.Array) -> pa.Array:
        if not len(column):
            return pa.array([], pa.struct([("list_id", pa.int32()), ("codes", pa.list_(pa.int32()))]))
        given = matrix(column)
        given = given if rotation is None else _turned(given.reshape(len(column), len(rotation)), rotation)
        nearest_center = clustering.nearest_centers(given, centers)[0][:, 0]
        codes = code(given - centers[nearest_center] if residual else given)
        return pa.StructArray.from_arrays([pa.array(list_ids[nearest_center]), _as_lists(codes, pa.int32())], ["list_id", "codes"])

    placed = rows.withColumn("__at", place(F.col("embedding")))
    return placed.select("__at.list_id", *ids, "__at.codes", *(["embedding"] if keep_vectors else []))


def ivf_search(
    queries: DataFrame, idx: VectorIndex, k: int = TOP_K, nprobe: int | None = None,
    vectors: DataFrame | None = None, candidates: int = CANDIDATES, share: float = SHARE,
) -> DataFrame:
    """``(query_id, rank, *ids, score)`` from the ``nprobe`` lists nearest to each query.

    Only those lists are read. An index that has vectors beside its codes is searched by code tables: the best ``share`` of
    a batch by the codes are ranked by their exact distances where they are read (:mod:`sievra.operators.code_search`).
    With codes alone, scores are distances to the decoded vectors; with ``vectors(*ids,
    embedding)``, the vectors the index was built of, at least the ``candidates`` best by the codes are ranked again by their
    exact distances, in the tasks that read them (:mod:`sievra.operators.candidates`). A query whose lists hold fewer than ``k`` vectors has fewer rows.
    """
    asked = queries.select("query_id", "embedding", F.col("embedding").alias("__asked"))
    if idx.rotation is not None:
        asked = rotate(asked, idx.rotation)
    asked = probe_lists(asked, idx.centroids, nprobe or idx.nprobe)
    if idx.codebooks is None:
        return nearest(asked, idx.lists, list(idx.ids), k, idx.metric, embedding_matrix)
    if "embedding" in idx.lists.columns and idx.metric == "l2":
        turned = asked.select("query_id", F.col("__asked").alias("embedding"), F.col("embedding").alias("turned"), "lists")
        return search_codes(turned, idx.lists, list(idx.ids), k, np.stack(_books(idx.codebooks)), *_center_matrix(idx.centroids), idx.residual, share)
    decode = _decoder(idx.codebooks, idx.centroids if idx.residual else None)
    if vectors is None:
        return nearest(asked, idx.lists, list(idx.ids), k, idx.metric, decode, "codes")
    turned = asked.select("query_id", F.col("__asked").alias("embedding"), F.col("embedding").alias("turned"), "lists")
    return search_candidates(turned, idx.lists, vectors, list(idx.ids), k, idx.metric, decode, max(k, candidates))


def rerank(
    queries: DataFrame, hits: DataFrame, vectors: DataFrame, k: int = TOP_K, metric: str = "l2", ids: tuple[str, ...] = IDS,
    max_query_numbers: int = MAX_QUERY_NUMBERS,
) -> DataFrame:
    """``(query_id, rank, *ids, score)``: the best ``k`` of ``hits(query_id, *ids)`` by the exact vectors.

    Hits are joined with ``vectors(*ids, embedding)`` by the ids, and with the queries, which are sent to the tasks if
    their numbers fit.
    """
    asked = settle(queries.select("query_id", F.col("embedding").alias("__query")), "queries")
    shape = asked.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("__query")), F.lit(0)).alias("dim")).first()
    asked = F.broadcast(asked) if shape["n"] * shape["dim"] <= max_query_numbers else asked
    pairs = hits.select("query_id", *ids).join(vectors.select(*ids, "embedding"), list(ids)).join(asked, "query_id")
    scored = pairs.select("query_id", *ids, pair_scores(metric)(F.col("__query"), F.col("embedding")).alias("score"))
    return top_k(scored, k, "score", descending=metric != "l2", tie_cols=tuple(ids)).select("query_id", "rank", *ids, "score")


def choose_candidates(
    queries: DataFrame, idx: VectorIndex, vectors: DataFrame, k: int = TOP_K, least: float = 0.95, sample: int = 256, seed: int = 0
) -> int:
    """How many candidates the codes have to give so that, after ranking them again, a sample of the queries reaches a
    recall of ``least`` against exact search. Doubled from ``10 * k`` until it does, or all vectors are candidates."""
    some = settle(random_sample(queries.select("query_id", "embedding"), sample, seed, "query_id"), "sample")
    truth = settle(knn_exact(some, vectors, k, idx.metric, idx.ids), "truth")
    total, n = idx.lists.count(), 10 * k
    turned = some.select("query_id", "embedding") if idx.rotation is None else rotate(some, idx.rotation)
    turned = settle(probe_lists(turned, idx.centroids, idx.nprobe).withColumnRenamed("embedding", "turned"), "sample-lists")
    decode = _decoder(idx.codebooks, idx.centroids if idx.residual else None)
    # A true neighbour among the candidates is among the best k of them after ranking: the candidates' recall is enough.
    places, true = code_places(turned, idx.lists, truth, list(idx.ids), idx.metric, decode)
    while n < total and true and (places <= n).sum() < least * true:
        n *= 2
    return min(n, max(total, k))


def list_sizes(idx: VectorIndex) -> DataFrame:
    """``(list_id, n)``."""
    return idx.lists.groupBy("list_id").agg(F.count("*").alias("n"))


def vector_stats(idx: VectorIndex) -> DataFrame:
    """One row: kind, dimension, lists, lists searched, vectors, filled lists, largest list."""
    sizes = list_sizes(idx)
    return sizes.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"),
        F.count("*").alias("filled_lists"),
        F.max("n").alias("largest_list"),
    ).select(
        F.lit(idx.kind).alias("kind"),
        F.lit(idx.dim).alias("dim"),
        idx.centroids.agg(F.count("*")).scalar().alias("nlist"),
        F.lit(idx.nprobe).alias("nprobe"),
        "total",
        "filled_lists",
        "largest_list",
    )


def recall(found: DataFrame, truth: DataFrame, ids: tuple[str, ...] = IDS) -> DataFrame:
    """One row: the share of the true neighbours that were found."""
    both = truth.select("query_id", *ids).join(
        found.select("query_id", *ids, F.lit(1).alias("hit")), ["query_id", *ids], "left"
    )
    return both.agg((F.count("hit") / F.count("*")).alias("recall"))
