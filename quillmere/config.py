"""Configuration: defaults, shallow merge of stored JSON, validation of what search and chunking need."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Config:
    """Fixed default values are those users of the reference know; unknown stored keys survive in ``extra``."""

    endpointBaseUrl: str = "http://127.0.0.1:1234/v1"
    embeddingModel: str = "text-embedding-bge-m3"
    apiKey: str = ""
    rerankModel: str = ""
    rerankEndpoint: str = ""
    chunkSize: int = 1200
    chunkOverlap: int = 150
    defaultTopK: int = 5
    stripMarkup: bool = True
    extra: dict[str, Any] = field(default_factory=dict)

    @staticmethod
    def merged(stored: str | dict | None, patch: dict | None = None) -> Config:
        """Defaults under the stored JSON under a patch.

        A stored document that is missing or broken, and stored values of a
        wrong type, count as not there; a patch with one is a ValueError.
        """
        if isinstance(stored, str):
            try:
                stored = json.loads(stored)
            except ValueError:
                stored = {}
        kinds = {f.name: type(f.default) for f in fields(Config) if f.name != "extra"}
        fits = lambda k, v: k not in kinds or (isinstance(v, kinds[k]) and isinstance(v, bool) == (kinds[k] is bool))
        wrong = [k for k, v in (patch or {}).items() if not fits(k, v)]
        if wrong:
            raise ValueError(f"{wrong[0]} must be of type {kinds[wrong[0]].__name__}")
        both = {k: v for k, v in (stored if isinstance(stored, dict) else {}).items() if fits(k, v)} | (patch or {})
        return Config(**{k: v for k, v in both.items() if k in kinds}, extra={k: v for k, v in both.items() if k not in kinds})

    def to_json(self) -> str:
        flat = asdict(self)
        return json.dumps({**flat.pop("extra"), **flat}, sort_keys=True)

    def rerank_endpoint(self) -> str:
        """The rerank endpoint, or the embedding one where none is set."""
        return self.rerankEndpoint or self.endpointBaseUrl

    def checked(self) -> Config:
        """Raises ValueError where chunking or search could not work."""
        if not 0 <= self.chunkOverlap < self.chunkSize:
            raise ValueError("0 <= chunkOverlap < chunkSize is needed")
        if not 1 <= self.defaultTopK <= MAX_TOP_K:
            raise ValueError(f"defaultTopK must lie between 1 and {MAX_TOP_K}")
        return self


#: Fixed value: the most hits a search gives.
MAX_TOP_K = 20


def candidate_budget(top_k: int, candidate_k: int | None = None) -> int:
    """How many candidates a search recalls before the rerank."""
    return candidate_k if candidate_k is not None else max(4 * top_k, 20)


def search_arguments(body: dict, default_top_k: int = Config.defaultTopK) -> dict:
    """Search arguments as they come from outside: ids that are no strings drop out, top_k is cut to its range.

    ``kbIds`` that is given and keeps no id is as if it weren't there.
    """
    given = body.get("kbIds")
    ids = [x for x in (given if isinstance(given, list) else []) if isinstance(x, str) and x.strip()]
    if isinstance(body.get("kbId"), str) and body["kbId"].strip():
        ids.append(body["kbId"])
    workspace = body.get("workspace") or body.get("workspaceId")
    top_k = body.get("topK")
    valid = isinstance(top_k, (int, float)) and not isinstance(top_k, bool) and 1 <= top_k < float("inf")
    return {
        "query": body["query"] if isinstance(body.get("query"), str) else "",
        "kb_ids": ids,
        "workspace_id": workspace if isinstance(workspace, str) and workspace.strip() else None,
        "top_k": min(int(top_k), MAX_TOP_K) if valid else default_top_k,
        "use_rerank": body.get("useRerank") is not False,
    }


def required(body: Any, *names: str) -> dict:
    """``body`` if it is an object that holds these names as strings that aren't blank; else a ValueError."""
    if not isinstance(body, dict):
        raise ValueError("an object is needed")
    for name in names:
        if not isinstance(body.get(name), str) or not body[name].strip():
            raise ValueError(f"{name} is needed")
    return body


def merged_columns(stored: Column, defaults: dict[str, str]) -> list[Column]:
    """Stored JSON over defaults, column by column, inside a plan."""
    return [F.coalesce(F.get_json_object(stored, f"$.{k}"), F.lit(v)).alias(k) for k, v in defaults.items()]
