"""Embedding and rerank models behind small interfaces: over HTTP, or deterministic and local."""

from __future__ import annotations

import hashlib
import json
import math
import time
import urllib.error
import urllib.request
from collections.abc import Callable
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Texts per request when importing and when asking, and seconds until a request is given up.
IMPORT_BATCH, QUERY_BATCH, EMBED_SECONDS, RERANK_SECONDS = 8, 1000, 30, 20


class Embedder(Protocol):
    """Anything that turns texts into vectors, and can be sent to executors."""

    name: str

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class Reranker(Protocol):
    """Anything that scores documents for a query: (index, score), in any order, not all of them."""

    def rank(self, query: str, documents: list[str]) -> list[tuple[int, float]]: ...


class HashingEmbedder:
    """Signed hashes of words and word pairs, of unit length: no model, the same everywhere, also in SQL.

    Words lie between ASCII white space, with A-Z lower-cased. The first eight
    hex digits of a gram's MD5 give its place, the next two its sign.
    """

    def __init__(self, dim: int = 64):
        self.name, self.dim = f"hashing-{dim}", dim

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.dim))
        for n, text in enumerate(texts):
            words = text.encode("utf-8", "surrogatepass").lower().split()
            for gram in [*words, *map(b" ".join, zip(words, words[1:]))]:
                h = hashlib.md5(gram, usedforsecurity=False).digest()
                out[n, int.from_bytes(h[:4], "big") % self.dim] += 1 if h[4] & 128 else -1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, norm, out=out, where=norm > 0).tolist()


class OverlapReranker:
    """Share of the query's words that a document holds."""

    def rank(self, query: str, documents: list[str]) -> list[tuple[int, float]]:
        wanted = set(query.lower().split())
        return [(n, len(wanted & set(d.lower().split())) / max(1, len(wanted))) for n, d in enumerate(documents)]


def _post(url: str, body: dict, key: str, seconds: float) -> dict:
    headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {key}"} if key else {})
    request = urllib.request.Request(url, json.dumps(body).encode(), headers)
    try:
        with urllib.request.urlopen(request, timeout=seconds) as answer:
            return json.load(answer)
    except urllib.error.HTTPError as e:
        raise RuntimeError(f"HTTP {e.code}: {e.read(400).decode('utf-8', 'replace')}") from e


class HttpEmbedder:
    """POST {endpoint}/embeddings with {model, input}; vectors are taken in the order of the answer."""

    def __init__(self, endpoint: str, model: str, key: str = ""):
        self.url, self.name, self.key = endpoint.rstrip("/") + "/embeddings", model, key

    def embed(self, texts: list[str]) -> list[list[float]]:
        if not texts:
            return []
        answer = _post(self.url, {"model": self.name, "input": texts}, self.key, EMBED_SECONDS)
        if answer.get("error") or not isinstance(answer.get("data"), list):
            raise RuntimeError(f"no embeddings: {answer.get('error') or 'data is missing'}")
        return [x["embedding"] for x in answer["data"]]


class HttpReranker:
    """POST {endpoint}/rerank with {model, query, documents}."""

    def __init__(self, endpoint: str, model: str, key: str = ""):
        self.url, self.model, self.key = endpoint.rstrip("/") + "/rerank", model, key

    def rank(self, query: str, documents: list[str]) -> list[tuple[int, float]]:
        return parse_ranking(_post(self.url, {"model": self.model, "query": query, "documents": documents}, self.key, RERANK_SECONDS))


def parse_ranking(answer: dict) -> list[tuple[int, float]]:
    """(index, score) of an answer's ``results`` or else ``data``; what is missing or no number counts as 0."""
    rows = answer.get("results") if isinstance(answer.get("results"), list) else answer.get("data")
    number = lambda x: x if isinstance(x, (int, float)) and not isinstance(x, bool) else 0
    found = [(int(number(r.get("index"))), float(number(r.get("relevance_score")))) for r in rows or [] if isinstance(r, dict)]
    return sorted((x for x in found if math.isfinite(x[1])), key=lambda x: -x[1])


def probe(embedder: Embedder) -> dict:
    """Whether a model answers, the dimension of its vectors or what went wrong, and how long it took."""
    began = time.monotonic()
    try:
        found = {"ok": True, "dim": len(embedder.embed(["ping"])[0])}
    except Exception as e:  # noqa: BLE001
        found = {"ok": False, "error": str(e)[:400]}
    return {**found, "latencyMs": round(1000 * (time.monotonic() - began)), "model": embedder.name}


def embed_texts(embedder: Embedder, texts: list[str], batch: int = QUERY_BATCH) -> list[list[float]]:
    out: list[list[float]] = []
    for at in range(0, len(texts), batch):
        out += embedder.embed(texts[at : at + batch])
    return out


#: Rows whose vectors Python holds as objects at once.
_SLICE = 256


def embedded(
    rows: DataFrame,
    embedder: Embedder,
    text_col: str = "text",
    vector_col: str = "vector",
    batch: int = IMPORT_BATCH,
    told: Callable[[pa.RecordBatch], None] | None = None,
) -> DataFrame:
    """``rows`` with a vector per text, asked for in small batches on the executors.

    Rows without a text get no vector and are not sent. Where the model fails
    for a batch, its rows have no vector and an ``embed_error``; the job goes on.
    ``told`` is shown rows, on the executors, when they have been through.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    kind = pa.list_(pa.float32())

    def asked(texts: list[str]) -> tuple[list, str | None]:
        try:
            found = embedder.embed(texts)
            if len(found) != len(texts):
                raise RuntimeError(f"{len(found)} vectors for {len(texts)} texts")
            if not all(len(x) for x in found):
                raise RuntimeError("a vector is empty")
            return found, None
        except Exception as e:  # noqa: BLE001
            return [None] * len(texts), str(e)[:400]

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, _SLICE):
                part = whole.slice(at, _SLICE)
                texts = part.column(part.schema.get_field_index(text_col)).to_pylist()
                places = [n for n, t in enumerate(texts) if t is not None]
                vectors, errors = [None] * len(texts), [None] * len(texts)
                for some in (places[k : k + batch] for k in range(0, len(places), batch)):
                    found, error = asked([texts[n] for n in some])
                    for n, vector in zip(some, found):
                        vectors[n], errors[n] = vector, error
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(vectors, kind), pa.array(errors, pa.string())], names=[*part.schema.names, vector_col, "embed_error"])
                if told:
                    told(part)

    return rows.mapInArrow(run, f"{schema}, `{vector_col}` array<float>, embed_error string")
