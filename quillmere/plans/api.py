"""The request interface: (method, path, body) to a JSON-ready answer, and the search tool."""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Callable
from urllib.parse import parse_qsl, urlsplit

from pyspark.sql import DataFrame

from quillmere.config import required, search_arguments
from quillmere.plans.engine import KnowledgeEngine

#: Columns whose public names are not just their names in camel case.
_PUBLIC = {"idx": "index"}


def public_name(column: str) -> str:
    return _PUBLIC.get(column) or re.sub(r"_([a-z])", lambda m: m[1].upper(), column)


def rows(df: DataFrame) -> list[dict]:
    """Rows of a listing under public names; listings are of the catalog or bounded by top_k."""
    return [{public_name(k): v for k, v in r.asDict(recursive=True).items()} for r in df.collect()]


def found(engine: KnowledgeEngine, body: dict) -> dict:
    """Answer to a search: {query, count, hits}; a hit has a heading or a rerank score only where there is one."""
    a = search_arguments(body, engine.get_config().defaultTopK)
    hits = rows(engine.search(a["query"], a["kb_ids"], a["workspace_id"], a["top_k"], a["use_rerank"]))
    optional = ("rerankScore", "heading")
    return {"query": a["query"], "count": len(hits), "hits": [{k: v for k, v in h.items() if k not in optional or v is not None} for h in hits]}


def knowledge_search(engine: KnowledgeEngine, query: str, workspace: str | None = None, kbId: str | None = None, topK: int | None = None) -> dict:
    """The tool: the best passages for a question, reranked where a model is set. A base wins over a workspace."""
    answer = found(engine, {"query": query, "workspace": workspace, "kbId": kbId, "topK": topK})
    return {**answer, "hits": [{k: v for k, v in h.items() if k != "heading"} for h in answer["hits"]]}


def _search(engine: KnowledgeEngine, body: dict) -> dict:
    return found(engine, required(body, "query"))


def _new_base(engine: KnowledgeEngine, body: dict) -> dict:
    text = body.get("description")
    kb_id = engine.create_base(required(body, "name")["name"].strip(), text if isinstance(text, str) else "")
    return rows(engine.base(kb_id))[0]


def _file(engine: KnowledgeEngine, body: dict) -> dict:
    """Import of one file: its bytes as they are, or in base 64."""
    content = required(body, "kbId").get("content") or b""
    content = content if isinstance(content, bytes) else base64.b64decode(content, validate=True)
    name = body.get("name") or "upload.bin"
    file = rows(engine.import_file(body["kbId"], name if isinstance(name, str) else "upload.bin", content))[0]
    stopped = {"stopped": True} if file["error"] == "stopped by user" else {}
    return {"file": file, "chunkCount": file["chunkCount"], "embeddingDim": file["embeddingDim"] or 0, **stopped}


def _mount(engine: KnowledgeEngine, body: dict) -> dict:
    b = required(body, "kbId", "workspaceId")
    note = b.get("note")
    return rows(engine.set_mount(b["kbId"], b["workspaceId"], b.get("enabled") is not False, note if isinstance(note, str) else ""))[0]


def _health(engine: KnowledgeEngine, body: dict) -> dict:
    counts = engine.health().first()
    return {"ok": True, "baseCount": counts.bases, "fileCount": counts.files}


def _done(_) -> dict:
    return {"ok": True}


_CONFIG = lambda e, b: json.loads(e.get_config().to_json())
ROUTES: dict[tuple[str, str], Callable[[KnowledgeEngine, dict], object]] = {
    ("GET", ""): _CONFIG,
    ("GET", "config"): _CONFIG,
    ("POST", "config"): lambda e, b: json.loads(e.save_config(required(b)).to_json()),
    ("POST", "config/test"): lambda e, b: e.probe(b),
    ("GET", "bases"): lambda e, b: rows(e.list_bases()),
    ("POST", "bases"): _new_base,
    ("POST", "bases/delete"): lambda e, b: _done(e.delete_base(required(b, "id")["id"])),
    ("GET", "files"): lambda e, b: rows(e.files(required(b, "kbId")["kbId"])),
    ("POST", "files"): _file,
    ("POST", "files/delete"): lambda e, b: _done(e.delete_file(required(b, "fileId")["fileId"])),
    ("GET", "mounts"): lambda e, b: rows(e.mounts()),
    ("POST", "mounts"): _mount,
    ("POST", "mounts/delete"): lambda e, b: _done(e.delete_mount(required(b, "kbId", "workspaceId")["kbId"], b["workspaceId"])),
    ("GET", "workspaces"): lambda e, b: e.workspaces,
    ("POST", "search"): _search,
    ("GET", "health"): _health,
    ("GET", "operations"): lambda e, b: e.operations.active(),
    ("POST", "operations/stop"): lambda e, b: {"ok": e.operations.stop(required(b, "operationId")["operationId"])},
    ("POST", "stop"): lambda e, b: {"ok": True, "stopped": e.operations.stop_all()},
    ("POST", "reindex"): lambda e, b: {"operationId": e.reindex(required(b, "kbId")["kbId"])},
    ("POST", "reindex-all"): lambda e, b: {"operationId": e.reindex()},
}


def handle(engine: KnowledgeEngine, method: str, path: str, body: dict | bytes | None = None, same_origin: bool = True) -> tuple[int, object]:
    """(status, answer) of a request; values in the query of the path count as body values.

    403 for requests of another origin, 404 for unknown routes, 400 for what
    goes wrong. A failed import is an answer, not an error. ``body`` may be the
    bytes of an upload.
    """
    if not same_origin:
        return 403, {"error": "forbidden"}
    parts = urlsplit(path)
    route = ROUTES.get((method.upper(), parts.path.strip("/")))
    if route is None:
        return 404, {"error": "not found"}
    given = {"content": body} if isinstance(body, bytes) else {} if body is None else body
    try:
        return 200, route(engine, {**dict(parse_qsl(parts.query)), **required(given)})
    except Exception as e:  # noqa: BLE001  said to the client
        return 400, {"error": str(e)[:400]}
