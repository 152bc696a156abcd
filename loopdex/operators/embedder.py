"""Text to vector: the pluggable embedder and where it is called.

An ``Embedder`` says what a worker is sent for a text (``features``, a native column) and how a worker loads its model
(``load``, once per worker process, whatever the number of batches and tasks). ``embed`` runs it over Arrow batches in
iterator form. A batch that fails is tried again row by row, so a failure costs its own row alone: its vector is null and
``embed_error`` says why. ``ingest`` and ``search`` both come here.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loopdex import config as C
from loopdex.functions.text import tokens
from loopdex.operators.util import spread

#: Texts of a model call at most.
BATCH = 256


class Embedder(ABC):
    """A model that turns texts into vectors of ``dim`` floats. Instances are sent to workers and must pickle; what they
    load there need not."""

    dim: int = C.TEXT_DIM

    def features(self, text: Column) -> Column:
        """What a worker gets for a text; by default the text (null: empty)."""
        return F.coalesce(text, F.lit(""))

    @abstractmethod
    def load(self) -> Callable[[list], np.ndarray]:
        """The model, as a function from a list of features to a row a feature (len x dim). It may raise."""

    def key(self) -> str:
        """Embedders with equal keys share a loaded model."""
        return f"{type(self).__module__}.{type(self).__qualname__}:{sorted(vars(self).items())}"


class HashEmbedder(Embedder):
    """The default: L2-normalised hashed term counts. Tokens and their buckets are native columns, so only numbers reach
    Python; bucket = first 8 hex digits of md5(token) mod dim."""

    def __init__(self, dim: int = C.TEXT_DIM, pattern: str = "[\\p{L}\\p{N}]+"):
        self.dim, self.pattern = dim, pattern

    def features(self, text: Column) -> Column:
        bucket = lambda t: F.pmod(F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("long"), F.lit(self.dim)).cast("int")
        return F.transform(tokens(text, self.pattern), bucket)

    def load(self):
        dim = self.dim

        def run(lists: list) -> np.ndarray:
            if any(x is None for x in lists):
                raise ValueError("no text")
            length = np.array([len(x) for x in lists], np.int64)
            flat = np.concatenate([np.asarray(x, np.int64) for x in lists]) if len(lists) else np.zeros(0, np.int64)
            at = np.repeat(np.arange(len(lists)), length) * dim + flat
            counts = np.bincount(at, minlength=len(lists) * dim).reshape(len(lists), dim).astype(np.float64)
            norm = np.sqrt((counts * counts).sum(1, keepdims=True))
            return counts / np.where(norm > 0, norm, 1)

        return run


#: Models of this worker process by their embedder's key.
_LOADED: dict[str, Callable] = {}


def _model(embedder: Embedder) -> Callable:
    key = embedder.key()
    if key not in _LOADED:
        _LOADED[key] = embedder.load()
    return _LOADED[key]


def _checked(rows, n: int, dim: int) -> np.ndarray:
    out = np.asarray(rows, np.float64)
    if out.shape != (n, dim):
        raise ValueError(f"the embedder returned shape {out.shape}, not {(n, dim)}")
    if not np.isfinite(out).all():
        raise ValueError("the embedder returned a component that is not finite")
    return out


def vectors_of(embedder: Embedder, features: list) -> tuple[list, list]:
    """(vectors, errors) of features, in order; exactly one of the two is None for each."""
    vectors, errors = [], []
    try:
        model = _model(embedder)
    except Exception as e:  # a model that can't be loaded fails every row, with its reason
        return [None] * len(features), [f"{type(e).__name__}: {e}"] * len(features)
    for i in range(0, len(features), BATCH):
        part = features[i : i + BATCH]
        try:
            vectors += list(_checked(model(part), len(part), embedder.dim).astype(np.float32))
            errors += [None] * len(part)
        except Exception:
            for one in part:
                try:
                    vectors.append(_checked(model([one]), 1, embedder.dim).astype(np.float32)[0])
                    errors.append(None)
                except Exception as e:
                    vectors.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
    return vectors, errors


def embed(df: DataFrame, text_col: str, embedder: Embedder | None = None) -> DataFrame:
    """Df with ``embedding`` (array<float>, null where it failed) and ``embed_error`` (null where it didn't)."""
    embedder = embedder or HashEmbedder()
    keep = [c for c in df.columns if c not in ("embedding", "embed_error")]
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    rows = spread(df, df.columns[0]).select(*keep, embedder.features(F.col(text_col)).alias("_features"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            vectors, errors = vectors_of(embedder, batch.column("_features").to_pylist())
            columns = [batch.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(vectors, pa.list_(pa.float32())), pa.array(errors, pa.string())], names=[*keep, "embedding", "embed_error"])

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep)
    return rows.mapInArrow(run, f"{schema}, embedding array<float>, embed_error string")


def embedded(docs: DataFrame, text_col: str, embedder: Embedder | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents with their vector, failures (doc_id, embed_error)): rows whose vector fails are dropped from the
    first and listed in the second. Write ``embed`` once and split that where the model is dear."""
    rows = embed(docs, text_col, embedder)
    good = rows.where(F.col("embedding").isNotNull()).drop("embed_error")
    return good, rows.where(F.col("embedding").isNull()).select("doc_id", "embed_error")
