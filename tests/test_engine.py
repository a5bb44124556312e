"""The engine from import to search and deletion, its request interface, operations and streaming."""

import pytest

from quillmere.config import Config, candidate_budget, search_arguments
from quillmere.operators.search import rerank_merge
from quillmere.plans.api import handle, knowledge_search
from quillmere.plans.engine import KnowledgeEngine
from quillmere.sources.models import HashingEmbedder, OverlapReranker, parse_ranking


class Failing:
    name = "failing"

    def embed(self, texts):
        raise RuntimeError("model is away")

    def rank(self, query, documents):
        raise RuntimeError("model is away")


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    return KnowledgeEngine(spark, str(tmp_path_factory.mktemp("kb")), HashingEmbedder(), OverlapReranker(), [{"id": "w"}])


@pytest.fixture(scope="module")
def base(engine, tmp_path_factory):
    folder = tmp_path_factory.mktemp("files")
    (folder / "a.md").write_text("# Cats\ncats sleep all day\n\nand dogs run")
    (folder / "b.html").write_text("<html><body><p>birds fly<br>high</p></body></html>")
    (folder / "c.txt").write_bytes("河水很清\r\n山也很高\r\n".encode("gb18030"))
    (folder / "d.pdf").write_bytes(b"%PDF-1.4")
    (folder / "e.txt").write_text("  \n ")
    kb = engine.create_base("animals")
    engine.import_folder(kb, str(folder))
    return kb


def test_import_states(engine, base):
    found = {r.name: (r.status, r.chunk_count) for r in engine.files(base).collect()}
    assert found == {"a.md": ("ready", 1), "b.html": ("ready", 1), "c.txt": ("ready", 1), "d.pdf": ("failed", 0), "e.txt": ("failed", 0)}
    row = engine.list_bases().first()
    assert (row.file_count, row.chunk_count) == (5, 3)


def test_search_scopes_and_rerank(engine, base):
    assert engine.search("cats sleep", top_k=1).first().file_name == "a.md"
    assert engine.search("cats", kb_ids=["none"]).count() == 0
    assert engine.search("cats", workspace_id="w").count() == 0
    engine.set_mount(base, "w")
    assert engine.search("birds", workspace_id="w", top_k=1).first().file_name == "b.html"
    engine.set_mount(base, "w", enabled=False)
    assert engine.search("birds", workspace_id="w").count() == 0
    assert engine.search("   ").count() == 0


def test_failing_reranker_leaves_cosine_order(engine, base, spark):
    other = KnowledgeEngine(spark, engine.store.root, HashingEmbedder(), Failing())
    plain = [r.chunk_id for r in engine.search("cats sleep", use_rerank=False).collect()]
    assert [r.chunk_id for r in other.search("cats sleep").collect()] == plain


def test_failed_reembedding_keeps_old_chunks(engine, base, spark):
    other = KnowledgeEngine(spark, engine.store.root, Failing())
    op = other.reindex(base)
    other.operations.wait(op, 120)
    assert [o["finished"] for o in other.operations.active()] == [True]
    assert engine.list_bases().first().chunk_count == 3
    assert {r.status for r in engine.files(base).collect()} == {"failed"}
    op = engine.reindex()
    engine.operations.wait(op, 120)
    assert {r.name for r in engine.files(base).collect() if r.status == "ready"} == {"a.md", "b.html", "c.txt"}


def test_requests(engine, base):
    assert handle(engine, "GET", "health") == (200, {"ok": True, "baseCount": 1, "fileCount": 5})
    assert handle(engine, "GET", "health", same_origin=False)[0] == 403
    assert handle(engine, "POST", "bases", {"name": " "})[0] == 400
    assert handle(engine, "POST", "bases", ["x"])[0] == 400
    assert handle(engine, "POST", "nope")[0] == 404
    assert handle(engine, "POST", "config", {"chunkSize": 10})[0] == 400
    assert handle(engine, "POST", "config", {"chunkSize": "abc"})[0] == 400
    assert handle(engine, "POST", "config", {"stripMarkup": 1})[0] == 400
    assert handle(engine, "POST", "config", {"chunkSize": 900, "extra": 1})[1]["chunkSize"] == 900
    assert engine.get_config().extra == {"extra": 1}
    probe = handle(engine, "POST", "config/test")[1]
    assert probe["ok"] and (probe["dim"], probe["model"]) == (64, "hashing-64") and "error" not in probe
    away = handle(engine, "POST", "config/test", {"endpointBaseUrl": "http://127.0.0.1:9/v1", "embeddingModel": "m"})[1]
    assert not away["ok"] and away["model"] == "m" and away["error"] and "dim" not in away
    assert engine.get_config().endpointBaseUrl != "http://127.0.0.1:9/v1"
    assert handle(engine, "POST", "operations/stop", {"operationId": "none"}) == (200, {"ok": False})
    assert handle(engine, "POST", "files/delete", {"id": "x"})[0] == 400
    files = handle(engine, "GET", f"files?kbId={base}")[1]
    assert len(files) == 5 and {"id", "kbId", "relPath", "charCount", "chunkCount", "embeddingModel"} <= set(files[0])
    assert handle(engine, "GET", "files")[0] == 400


def test_search_requests_keep_to_their_bases(engine, base):
    status, answer = handle(engine, "POST", "search", {"query": "cats", "topK": 2, "kbId": base})
    assert status == 200 and (answer["query"], answer["count"], len(answer["hits"])) == ("cats", 2, 2)
    assert {"kbId", "kbName", "fileId", "fileName", "chunkId", "text", "index", "score", "rerankScore"} <= set(answer["hits"][0])
    assert "rerankScore" not in handle(engine, "POST", "search", {"query": "cats", "useRerank": False})[1]["hits"][0]
    empty = handle(engine, "POST", "bases", {"name": "empty", "description": "d"})[1]
    assert (empty["name"], empty["description"], empty["fileCount"], empty["chunkCount"]) == ("empty", "d", 0, 0)
    assert handle(engine, "POST", "search", {"query": "cats", "kbIds": [empty["id"]]})[1] == {"query": "cats", "count": 0, "hits": []}
    assert handle(engine, "POST", "search", {"query": "cats", "kbIds": [empty["id"], base]})[1]["count"] == 3
    assert handle(engine, "POST", "search", {"query": " "})[0] == 400
    tool = knowledge_search(engine, "cats", kbId=empty["id"], topK=3)
    assert tool == {"query": "cats", "count": 0, "hits": []} and knowledge_search(engine, "cats", workspace="", topK=1)["count"] == 1
    mount = handle(engine, "POST", "mounts", {"kbId": empty["id"], "workspaceId": "v", "note": "n"})[1]
    assert (mount["workspaceId"], mount["enabled"], mount["note"]) == ("v", True, "n")
    assert handle(engine, "POST", "bases/delete", {"id": empty["id"]}) == (200, {"ok": True})
    assert all(m["kbId"] != empty["id"] for m in handle(engine, "GET", "mounts")[1])


def test_uploads(engine, base):
    status, answer = handle(engine, "POST", f"files?kbId={base}&name=up.txt", "whales sing".encode())
    assert status == 200 and (answer["chunkCount"], answer["embeddingDim"], answer["file"]["status"]) == (1, 64, "ready")
    assert handle(engine, "POST", f"files?kbId={base}&name=up.txt", b"")[0] == 400
    assert handle(engine, "POST", "files", b"x")[0] == 400
    assert handle(engine, "POST", "files/delete", {"fileId": answer["file"]["id"]}) == (200, {"ok": True})


class Counting:
    """Writes each text that it is asked for to a file of its own, since it runs in other processes."""

    name = "counting"

    def __init__(self, folder, seconds=0.0):
        self.folder, self.seconds = str(folder), seconds

    def embed(self, texts):
        import pathlib
        import time
        import uuid

        time.sleep(self.seconds)
        for t in texts:
            (pathlib.Path(self.folder) / uuid.uuid4().hex).write_text(t)
        return [[1.0, 2.0] for _ in texts]


def test_every_text_is_embedded_once(spark, tmp_path):
    (tmp_path / "in").mkdir(), (tmp_path / "seen").mkdir()
    for n in range(4):
        (tmp_path / "in" / f"{n}.txt").write_text(f"text number {n}")
    engine = KnowledgeEngine(spark, str(tmp_path / "kb"), Counting(tmp_path / "seen"))
    kb = engine.create_base("b")
    engine.import_folder(kb, str(tmp_path / "in"))
    seen = lambda: sorted(x.read_text() for x in (tmp_path / "seen").iterdir())
    assert seen() == [f"text number {n}" for n in range(4)]
    engine.operations.wait(engine.reindex(kb), 120)
    assert seen() == sorted(2 * [f"text number {n}" for n in range(4)])
    assert engine.store._names("staging") == []
    engine.import_folder(kb, str(tmp_path / "in"))  # again: the same ids
    assert engine.files(kb).count() == 4 and engine.store.read("chunks").count() == 4


def folders(engine, table):
    return {part.rpartition("/")[0] for part in engine.store.snapshot(table).parts}


@pytest.fixture(scope="module")
def bulk(spark, tmp_path_factory):
    """A base of 1,000 files from one import, and one of a few."""
    folder, root = tmp_path_factory.mktemp("bulk"), tmp_path_factory.mktemp("kb")
    for n in range(1000):
        (folder / f"{n}.txt").write_text(f"number {n} of many texts")
    engine = KnowledgeEngine(spark, str(root), HashingEmbedder(), OverlapReranker())
    kb, other = engine.create_base("many"), engine.create_base("few")
    engine.import_folder(kb, str(folder))
    engine.import_file(other, "lion.txt", b"lions roar")
    return engine, kb, other, root


def test_deleting_one_of_a_bulk_import_rewrites_one_bucket(bulk):
    engine, kb, _, _ = bulk
    assert {len(folders(engine, t)) for t in ("raw", "chunks", "files")} == {65}  # 64 buckets of one base, one of the other
    before = {t: set(engine.store.snapshot(t).parts) for t in ("raw", "chunks", "files")}
    gone = engine.files(kb).filter("name = '7.txt'").first().id
    engine.delete_file(gone)
    for t, old in before.items():
        now = set(engine.store.snapshot(t).parts)
        assert len(old - now) == len(now - old) == 1
        assert {x.rpartition("/")[0] for x in old - now} == {x.rpartition("/")[0] for x in now - old}
    assert engine.files(kb).count() == engine.store.read("chunks", [kb]).count() == 999
    versions = {t: engine.store.versions(t) for t in before}
    engine.delete_file("none")
    assert versions == {t: engine.store.versions(t) for t in before}


def test_bytes_of_other_files_and_bases_are_never_opened(bulk):
    """Folders of other buckets are moved away: what doesn't read them does not notice."""
    engine, kb, other, root = bulk
    file = engine.files(kb).filter("name = '500.txt'").first()
    (bucket,) = engine.store.buckets_of([file.id], 64)
    plan = engine.store.read("raw", [kb], [file.id])._jdf.queryExecution().executedPlan().toString()
    filters = plan.split("PartitionFilters: ")[1].split("PushedFilters")[0]
    assert "kb_id#" in filters and "bucket#" in filters  # the text of a plan is cut before their values
    away = root.parent / "away"
    (root / "raw" / f"kb_id={kb}").rename(away)
    (root / "raw" / f"kb_id={kb}").mkdir()
    (away / f"bucket={bucket}").rename(root / "raw" / f"kb_id={kb}" / f"bucket={bucket}")
    assert engine.reembed_file(file.id).first().status == "ready"
    assert engine.read_file_bytes(file.rel_path) == b"number 500 of many texts"
    assert engine.import_file(other, "tiger.txt", b"tigers sleep").first().status == "ready"
    (root / "raw" / f"kb_id={kb}" / f"bucket={bucket}").rename(away / f"bucket={bucket}")
    (root / "raw" / f"kb_id={kb}").rmdir()
    away.rename(root / "raw" / f"kb_id={kb}")
    (root / "chunks" / f"kb_id={kb}").rename(away)
    assert engine.search("lions", kb_ids=[other], top_k=1).first().file_name == "lion.txt"
    away.rename(root / "chunks" / f"kb_id={kb}")


def scans(plan):
    """File scans of a plan that has run, those within its stages too."""
    leaves = plan.collectLeaves()
    for leaf in (leaves.apply(k) for k in range(leaves.size())):
        if leaf.nodeName().startswith("Scan"):
            yield leaf
        elif "QueryStage" in leaf.getClass().getSimpleName():
            yield from scans(leaf.plan())


def test_plans_of_a_search(bulk):
    """Nothing but ids and vectors is read below the top-k; a workspace's bases prune folders while the plan runs."""
    from quillmere.operators import search

    engine, kb, other, _ = bulk
    engine.set_mount(other, "w")
    t = engine.store.tables()
    vector = HashingEmbedder().embed(["lions"])[0]
    found = search.recall(search.in_scope(t["chunks"], t["mounts"], workspace_id="w"), t["bases"], t["files"], vector, 5)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan and "text:string" not in plan and "heading" not in plan and "vector:array<float>" in plan
    assert [r.score > 0 for r in found.collect()][:1] == [True]
    read = [x.metrics().get("filesSize").get().value() for x in scans(found._jdf.queryExecution().executedPlan().executedPlan()) if "vector" in x.toString()]
    whole = sum(engine.store.snapshot("chunks").parts.values())
    assert read and max(read) < whole / 20  # one of 65 folders
    assert engine.search("lions", workspace_id="w", top_k=1).first().file_name == "lion.txt"


def test_lost_bytes_fail_a_file(spark, tmp_path):
    engine = KnowledgeEngine(spark, str(tmp_path / "kb"), HashingEmbedder())
    kb = engine.create_base("b")
    ids = [engine.import_file(kb, f"{n}.txt", f"text {n}".encode()).first().id for n in range(2)]
    engine.store.replace("raw", "file_id", spark.createDataFrame([(ids[0],)], "id string"))
    assert engine.reembed_file(ids[0]) is None and engine.reembed_file("none") is None
    assert {r.id: r.status for r in engine.files(kb).collect()} == {ids[0]: "failed", ids[1]: "ready"}
    assert engine.reembed_file(ids[1]).first().status == "ready"


class Slow:
    """Counts the texts of a run in a folder, and waits after each."""

    name = "slow"

    def __init__(self, folder, seconds):
        self.folder, self.seconds = str(folder), seconds

    def embed(self, texts):
        import pathlib
        import time
        import uuid

        time.sleep(self.seconds * len(texts))
        for _ in texts:
            (pathlib.Path(self.folder) / uuid.uuid4().hex).touch()
        return [[1.0, 2.0] for _ in texts]


def test_a_stopped_run_leaves_files_ready_failed_and_as_they_were(spark, tmp_path):
    import time

    (tmp_path / "in").mkdir(), (tmp_path / "seen").mkdir()
    for n in range(19):
        (tmp_path / "in" / f"{n}.txt").write_text(f"text {n}")
    engine = KnowledgeEngine(spark, str(tmp_path / "kb"), HashingEmbedder(2), clock=lambda: 1, batch_files=4)
    kb = engine.create_base("b")
    engine.import_folder(kb, str(tmp_path / "in"))
    again = KnowledgeEngine(spark, engine.store.root, Slow(tmp_path / "seen", 0.5), clock=lambda: 2, batch_files=4)
    op = again.reindex(kb)
    began = time.time()
    while time.time() - began < 120 and len([r for r in again.files(kb).collect() if r.updated_at == 2]) < 4:
        time.sleep(0.1)
    shown = again.operations.active()[0]
    assert again.operations.stop(op)
    again.operations.wait(op, 60)
    (view,) = again.operations.active()
    assert view["finished"] and view["failed"] and view["error"] == "stopped by user" and (shown["total"], shown["chunkTotal"]) == (19, 19)
    states = {}
    for r in again.files(kb).collect():
        states.setdefault((r.status, r.embedding_model, r.updated_at), []).append(r.name)
        assert (r.error == "stopped by user") == (r.status == "failed")
    assert {(s, m, at) for s, m, at in states} == {("ready", "slow", 2), ("failed", "hashing-2", 2), ("ready", "hashing-2", 1)}
    assert again.store.read("chunks").count() == 19 and again.store._names("staging") == []


def test_batches_grow_with_the_files_and_not_in_number(engine):
    for files in (0, 499, 501, 1_999, 2_001, 26_000, 1_000_000):
        batches = engine._batches(list(range(64)), files)
        assert len(batches) == max(1, min(4, -(-files // 500)))
        assert sorted(x for some in batches for x in some) == list(range(64)) and max(map(len, batches)) <= -(-64 // len(batches))
    assert [engine._batches([7], 10_000), engine._batches([], 0)] == [[[7]], [[]]]


def test_staged_rows_that_fail_leave_nothing(spark, tmp_path):
    from pyspark.sql import functions as F

    store = KnowledgeEngine(spark, str(tmp_path / "kb"), HashingEmbedder(2)).store
    broken = spark.range(8).select(F.when(F.col("id") == 5, F.raise_error(F.lit("broken"))).otherwise(F.col("id").cast("string")).alias("x"))
    with pytest.raises(Exception, match="broken"):
        store.staged(broken)
    assert store._names("staging") == []


def test_progress_rises_while_files_are_imported(spark, tmp_path):
    import threading
    import time

    (tmp_path / "in").mkdir(), (tmp_path / "seen").mkdir()
    for n in range(40):
        (tmp_path / "in" / f"{n}.txt").write_text(f"text {n}")
    engine = KnowledgeEngine(spark, str(tmp_path / "kb"), Slow(tmp_path / "seen", 0.05), batch_files=10)
    kb, seen = engine.create_base("b"), []
    thread = threading.Thread(target=lambda: engine.import_folder(kb, str(tmp_path / "in")))
    thread.start()
    while thread.is_alive():
        seen += [(o["done"], o["chunkDone"], o["progress"]) for o in engine.operations.active()]
        time.sleep(0.1)
    files, chunks, shares = zip(*seen)
    assert list(files) == sorted(files) and list(chunks) == sorted(chunks) and max(shares) <= 1
    assert len({x for x in files if 0 < x < 40}) >= 2 and len({x for x in chunks if 0 < x < 40}) >= 2
    assert {r.status for r in engine.files(kb).collect()} == {"ready"}


def test_an_import_can_be_watched_and_stopped(spark, tmp_path):
    import threading
    import time

    (tmp_path / "seen").mkdir()
    engine = KnowledgeEngine(spark, str(tmp_path / "kb"), Counting(tmp_path / "seen", 60.0))
    kb, out = engine.create_base("b"), []
    thread = threading.Thread(target=lambda: out.append(engine.import_file(kb, "slow.txt", b"slow text").first()))
    thread.start()
    began = time.time()
    while time.time() - began < 60 and [r.status for r in engine.files(kb).collect()] != ["indexing"]:
        time.sleep(0.2)
    (op,) = engine.operations.active()
    assert (op["kind"], op["label"], op["current"], op["total"], op["finished"]) == ("import", "slow.txt", "slow.txt", 1, False)
    assert engine.operations.stop(op["id"]) and engine.operations.stop_all() <= 1
    thread.join(60)
    assert (out[0].status, out[0].error) == ("failed", "stopped by user") and engine.operations.active() == []


def test_streaming_import(engine, base, tmp_path):
    from quillmere.streaming.ingest import watch_folder

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "z.txt").write_text("zebras have stripes")
    for _ in range(2):
        watch_folder(engine, base, str(tmp_path / "in"), str(tmp_path / "checkpoint")).awaitTermination(120)
    assert sum(r.name == "z.txt" for r in engine.files(base).collect()) == 1
    assert engine.search("zebras stripes", top_k=1).first().file_name == "z.txt"


def test_delete(engine, base):
    file = engine.files(base).filter("name = 'a.md'").first()
    assert engine.read_file_bytes(file.rel_path).startswith(b"# Cats")
    engine.delete_file(file.id)
    assert engine.read_file_bytes(file.rel_path) is None
    engine.delete_base(base)
    assert handle(engine, "GET", "health")[1] == {"ok": True, "baseCount": 0, "fileCount": 0}
    assert engine.mounts().count() == 0
    with pytest.raises(ValueError):
        engine.import_file(base, "x.txt", b"x")
    with pytest.raises(ValueError):
        engine.store.delete("../x")


def test_arguments_and_config():
    assert search_arguments({"query": "q", "kbIds": [1, "a"], "topK": 99}) == {"query": "q", "kb_ids": ["a"], "workspace_id": None, "top_k": 20, "use_rerank": True}
    assert search_arguments({"topK": 0.5})["top_k"] == 5
    assert (candidate_budget(2), candidate_budget(9), candidate_budget(9, 3)) == (20, 36, 3)
    assert Config.merged("not json").chunkSize == Config.merged('{"chunkSize": "x"}').chunkSize == 1200
    assert Config.merged('{"endpointBaseUrl": "u", "embeddingModel": "m", "other": 1}', {"apiKey": "k"}) == Config("u", "m", "k", extra={"other": 1})
    with pytest.raises(ValueError):
        Config(chunkOverlap=1200).checked()


def test_ranking_rules(spark):
    assert parse_ranking({"data": [{"index": 1, "relevance_score": 2}, {"index": "x"}, {"relevance_score": float("nan")}]}) == [(1, 2.0), (0, 0.0)]
    hits = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "ordinal int, chunk_id string")
    scores = spark.createDataFrame([(1, 0.5), (1, 0.25), (2, -1.0), (0, float("nan"))], "index int, relevance double")
    assert [(r.chunk_id, r.rerank_score) for r in rerank_merge(hits, scores, 5).collect()] == [("b", 0.25), ("a", 0.0), ("c", -1.0)]


@pytest.mark.parametrize("block", [3, 1024])
def test_many_questions_in_blocks(spark, monkeypatch, block):
    import numpy as np

    from quillmere.operators import search

    monkeypatch.setattr(search, "QUERY_BLOCK", block)
    rng = np.random.default_rng(1)
    rows = [(f"c{n:02}", [float(x) for x in rng.normal(size=4)]) for n in range(40)] + [("zero", [0.0] * 4), ("short", [1.0]), ("none", None), ("twin", None)]
    rows[-1] = ("twin", rows[0][1])
    chunks = spark.createDataFrame(rows, "id string, vector array<float>")
    asked = spark.createDataFrame([(n, rows[n][1]) for n in range(8)] + [(99, [1.0])], "query_id int, vector array<float>")
    cos = lambda a, b: float(np.dot(a, b) / max(1e-300, np.linalg.norm(a) * np.linalg.norm(b)))
    same = [(i, np.float32(v).astype(float)) for i, v in rows if v and len(v) == 4]
    expected = {(q, r + 1): i for q in range(8) for r, (_, i) in enumerate(sorted((-round(cos(dict(same)[f"c{q:02}"], v), 9), i) for i, v in same)[:3])}
    expected[99, 1] = "short"
    assert {(r.query_id, r["rank"]): r.chunk_id for r in search.batch_nearest(asked, chunks, 3).collect()} == expected


def test_store_appends_and_cleans(spark, tmp_path):
    from quillmere.sources.store import KEPT, MERGED, TableStore

    store = TableStore(spark, str(tmp_path), {"t": "id int"})
    rows = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id int").coalesce(1)
    assert store.read("t").count() == 0
    store.write("t", rows(1, 2))
    store.append("t", rows(3))
    before = store.read("t")
    store.replace("t", "id", rows(1, 9))
    assert sorted(r.id for r in store.read("t").collect()) == [2, 3] and before.count() == 3
    store.replace("t", "id", rows(3), rows(3, 4))
    store.replace("t", "id", rows(77), rows(5))
    assert sorted(r.id for r in store.read("t").collect()) == [2, 3, 4, 5]
    for k in range(KEPT + 2):
        store.write("t", rows(k))
    assert len(store.versions("t")) == KEPT and len([x for x in store._names("t") if x.startswith("data-")]) == KEPT
    for k in range(MERGED + 3):
        store.append("t", rows(100 + k))
    assert len(store.snapshot("t").parts) < MERGED and store.read("t").count() == MERGED + 4
    assert store._names("staging") == []


@pytest.mark.parametrize("change", ["replace", "delete", "append", "rewrite"])
def test_of_two_writers_neither_loses_rows(spark, tmp_path, change):
    """Another writer appends while this one has its rows made."""
    from quillmere.sources.store import TableStore

    schemas, keys = {"t": "kb_id string, id string"}, {"t": "id"} if change != "rewrite" else {}
    store, other = (TableStore(spark, str(tmp_path), schemas, keys, buckets=2) for _ in range(2))
    rows = lambda *ids: spark.createDataFrame([("k", i) for i in ids], "kb_id string, id string")
    ids = lambda *x: rows(*x).select("id")
    store.append("t", rows("a", "b", "c", "d"))
    written, calls = store._written, []

    def slowly(*args):
        found = written(*args)
        if not calls:
            calls.append(1)
            other.append("t", rows("new"))
        return found

    store._written = slowly
    if change == "replace":
        store.replace("t", "id", ids("a"), rows("a", "e"))
    elif change == "delete":
        store.replace("t", "id", ids("a"))
    elif change == "append":
        store.append("t", rows("e"))
    else:
        store.rewrite("t", lambda t: t.filter("id <> 'a'"))
    left = {"replace": "abcde", "delete": "bcd", "append": "abcde", "rewrite": "bcd"}[change]
    assert sorted(r.id for r in store.read("t").collect()) == [*left, "new"] and calls == [1]
    named = {x for v in store.versions("t") for x in store._read_list("t", v).parts}
    assert {x[len("t/"):] for x, _ in store._folders("t/kb_id=*/bucket=*/data-*" if keys else "t/data-*")} == named


def test_configuration_and_mounts_of_two_writers(engine, spark):
    other = KnowledgeEngine(spark, engine.store.root, HashingEmbedder())
    written, calls = engine.store._written, []

    def slowly(*args):
        if not calls:
            calls.append(1)
            other.save_config({"rerankModel": "r"})
        return written(*args)

    engine.store._written = slowly
    try:
        engine.save_config({"apiKey": "k"})
    finally:
        engine.store._written = written
    assert (engine.get_config().rerankModel, engine.get_config().apiKey) == ("r", "k")
    engine.save_config({"rerankModel": "", "apiKey": ""})


def test_what_a_killed_import_leaves_is_removed(spark, tmp_path, monkeypatch):
    engine = KnowledgeEngine(spark, str(tmp_path / "kb"), HashingEmbedder())
    kb = engine.create_base("b")
    engine.import_file(kb, "a.txt", b"text a")

    class Killed(BaseException):
        pass

    def die(*_):
        raise Killed

    monkeypatch.setattr(engine.store, "_commit", die)
    monkeypatch.setattr(engine.store, "delete", die)
    with pytest.raises(Killed):
        engine.import_file(kb, "b.txt", b"text b")
    engine.store.staged(engine.store.read("files"))
    monkeypatch.undo()
    assert len(engine.store._folders("raw/kb_id=*/bucket=*/data-*")) == 2 and engine.clean_up(3600) == []
    gone = engine.clean_up(0)
    assert len(gone) == 2 and any(x.startswith("raw/") for x in gone) and any(x.startswith("staging/") for x in gone)
    assert [r.name for r in engine.files(kb).collect()] == ["a.txt"] and engine.search("text", top_k=3).count() == 1
    engine.store.replace("bases", "id", spark.createDataFrame([(kb,)], "id string"))  # a deletion that was interrupted
    assert engine.clean_up(0) and engine.store.read("raw").count() == engine.store.read("chunks").count() == 0


def test_old_checkpoints_are_removed_and_others_stay(spark):
    import os
    import uuid
    from pathlib import Path
    from urllib.parse import urlsplit

    from quillmere.sources.checkpoint import remove_old

    own = Path(urlsplit(spark.sparkContext.getCheckpointDir()).path)
    old, other, fresh = own.parent / str(uuid.uuid4()), own.parent / "of-somebody-else", own.parent / f"pipeline-{uuid.uuid4().hex}"
    for folder in (old, other, fresh):
        folder.mkdir()
    for folder in (old, other, own):
        os.utime(folder, (1, 1))
    assert remove_old(spark, 3600) == [old.name]
    assert other.exists() and fresh.exists() and own.exists() and not old.exists()
