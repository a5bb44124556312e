"""The pipeline's stages against plain Python, stage by stage."""

import collections
import re

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from quillmere.llm.queries import tokenizer_path  # noqa: E402
from quillmere.llm.simhash import near_duplicates  # noqa: E402
from tests.compare import DATA  # noqa: E402


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, out[-1], DATA).write.parquet(f"{folder}/{k}")
        out.append(spark.read.parquet(f"{folder}/{k}"))
    return out


def test_columns_stay(stages):
    assert all(s.dtypes == stages[0].dtypes for s in stages[1:-1])


def test_clean_documents_stay(stages):
    assert stages[1].count() >= 0.99 * stages[0].count()


def test_one_of_each_group_stays(stages):
    least = {r.component_id for r in near_duplicates(stages[1]).collect()}
    assert sorted(r.doc_id for r in stages[2].collect()) == sorted(least)


def test_secrets_go_and_documents_stay(stages):
    from quillmere.llm.secrets import SecretScanner
    import public_tokenizers

    scan = SecretScanner(tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    before, after = ({r.doc_id: r for r in s.collect()} for s in stages[2:4])
    assert set(before) == set(after)
    for k, r in before.items():
        assert after[k].text == r.text if not scan.spans(r.text) else not scan.spans(after[k].text)
        assert after[k].n_chars == len(after[k].text)


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow_targets(sizes):
    """Targets of sources, those above twice their size cut and the excess reshared until none is."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    target, left, open_ = {}, 1.5 * sum(sizes.values()), set(order)
    while open_:
        share = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if share * weight[s] > 2 * sizes[s]}
        if not full:
            return target | {s: share * weight[s] for s in open_}
        target |= {s: 2 * sizes[s] for s in full}
        left -= sum(2 * sizes[s] for s in full)
        open_ -= full
    return target


def check_mix(before, after):
    size = lambda r: len(WORD.findall(r.text or ""))
    words, mixed, longest = collections.Counter(), collections.Counter(), collections.Counter()
    for r in before:
        words[r.source] += size(r)
        longest[r.source] = max(longest[r.source], size(r))
    for r in after:
        mixed[r.source] += size(r)
    for source, target in slow_targets(words).items():
        assert abs(mixed[source] - target) <= longest[source] + 1  # whole documents, but for the last one of a pass
    allowed = collections.Counter(tuple(r) for r in before)
    taken = collections.Counter(tuple(r) for r in after)
    assert all(n <= 2 * allowed[r] for r, n in taken.items())


def test_sources_come_near_their_targets(stages):
    check_mix(stages[3].collect(), stages[4].collect())


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in any column, repeated ids and rows, empty and very long texts, extra columns of clashing names."""
    words = ["the", "quick", "brown", "fox", "jumps", "over", "lazy", "dogs", "while", "rain", "falls", "softly"]
    text = lambda k: " ".join(words[(k * 7 + j * (k % 5 + 1)) % 12] + ("s" if j % (k % 4 + 2) else "") for j in range(20 + k))
    rows = [(k, text(k), ["en", None][k % 9 == 0], ["b", "a", None][k % 3]) for k in range(60)]
    rows += [(k, text(k), "en", "a") for k in range(0, 60, 6)] + rows[:3]  # repeated ids and rows
    rows += [(7, text(100 + k), "en", "b") for k in range(5)]  # one id, several texts
    rows += [(None, text(3), None, None), (None, text(200), "en", "c"), (None, None, None, None), (300, None, "en", "a"), (301, "", "en", "b"), (302, " \n", None, None), (303, "12 34", "en", "a")]
    rows += [(400, "token = 0123456789abcdef0123456789abcdef " + text(9), "en", "b"), (401, "long words here " * 30000, "en", "a")]
    table = [(i, t, x, s, None if k % 5 == 0 else len(t or "")) for k, (i, t, x, s) in enumerate(rows)]
    docs = spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    from pyspark.sql import functions as F

    return docs.select("*", *(F.lit(k).alias(c) for k, c in enumerate(("fp", "root", "row", "a", "b", "spread", "copies", "row_hash", "size", "rank"))))


def test_stages_on_odd_rows(spark, odd, tmp_path):
    import sentencepiece

    from quillmere.llm.language import fit, held_out
    from quillmere.llm.secrets import SecretScanner
    from pyspark.sql import functions as F
    from tests.llm.test_operators import components, slow_simhash
    import public_tokenizers

    out = [odd]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, out[-1], DATA).write.parquet(f"{tmp_path}/{k}")
        out.append(spark.read.parquet(f"{tmp_path}/{k}"))
    assert all(s.dtypes == odd.dtypes for s in out[:-1])
    rows = [s.collect() for s in out]
    known = fit(odd.filter(~held_out(F.col("doc_id"), 4, 2)), "doc_id", "text", "lang")
    assert sorted(map(str, rows[1])) == sorted(str(r) for r in rows[0] if known.predict(r.text)[2]) and len(rows[1]) > 60
    prints = {r: slow_simhash(r.text) for r in rows[1]}
    distinct = sorted(set(prints.values()))
    root = components(distinct, [(a, b) for a in distinct for b in distinct if a < b and (a ^ b).bit_count() <= 2])
    groups = collections.defaultdict(list)
    for r in rows[1]:
        groups[root[prints[r]]].append(r)
    least = lambda g: min((r.doc_id is None, r.doc_id) for r in g)
    assert sorted((r.doc_id is None, r.doc_id) for r in rows[2]) == sorted(map(least, groups.values()))
    assert {root[slow_simhash(r.text)] for r in rows[2]} == set(groups) and all(r in rows[1] for r in rows[2])
    scan = SecretScanner(tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    assert sorted((str(r.doc_id), r.text) for r in rows[3]) == sorted((str(r.doc_id), scan.redacted(r.text)) for r in rows[2])
    assert any("[secret]" in r.text for r in rows[3])
    check_mix(rows[3], rows[4])
    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    expected = collections.Counter((r.doc_id, tuple(library.encode(r.text))) for r in rows[4])
    assert collections.Counter((r.doc_id, tuple(r.ids)) for r in rows[5]) == expected


def test_stages_on_no_rows(spark, odd):
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        found = stage(spark, odd.limit(0), DATA)
        assert found.count() == 0 and (k == len(corpus_pipeline.STAGES) - 1 or found.dtypes == odd.dtypes)


def test_stages_between_are_removed(spark, stages):
    import pathlib

    root = pathlib.Path(spark.sparkContext.getCheckpointDir().removeprefix("file:"))
    known = set(root.glob("pipeline-*"))
    corpus_pipeline.run(spark, DATA)
    (own,) = set(root.glob("pipeline-*")) - known
    assert [x.name for x in own.iterdir()] == ["3-mixture"]


def test_ids_are_those_of_the_library(stages):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    texts = {r.doc_id: r.text for r in stages[4].collect()}
    rows = stages[5].collect()
    assert len(rows) == stages[4].count()
    assert all(r.ids == library.encode(texts[r.doc_id]) and r.n_tokens == len(r.ids) for r in rows)


def test_decoded_texts_are_those_of_the_library(stages):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    rows = stages[5].collect()
    assert rows and all(r.decoded == library.decode(r.ids) for r in rows)


def test_run_gives_the_last_stage(spark, stages):
    own = collections.Counter((r.doc_id, r.n_tokens) for r in stages[5].collect())
    assert collections.Counter((r.doc_id, r.n_tokens) for r in corpus_pipeline.run(spark, DATA).collect()) == own
