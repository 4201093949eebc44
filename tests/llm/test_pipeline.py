"""The pipeline's stages in order, each against a brute-force version on what the one before kept."""

import collections
import re

import corpus_pipeline
import pytest
from test_linedup import brute as brute_lines
from test_operators import WORDS, brute_components, brute_targets

from loomsift.llm import langid

SF = "/root/testdata/sf0.001"


def five(text):
    w = re.findall(r"[^\W_]+", text.lower())
    return set(zip(w, w[1:], w[2:], w[3:], w[4:]))


def expected(spark, name, docs):
    """doc_id -> text that the stage has to leave of ``docs``."""
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    if name == "language_id":
        model = langid.train(docs, ~langid.held_out())
        said = {i: model.predict(t) for i, t in rows}
        return {i: t for i, t in rows if said[i][0] != "und" and said[i][1] >= model.floor}
    if name == "line_dedup":
        return {i: t for i, t in brute_lines(rows).items() if t.strip() or t == dict(rows)[i]}
    if name == "near_dedup":
        group = brute_components(rows, 5, 80)
        return {i: t for i, t in rows if group[i][1] == i}
    if name == "decontamination":
        items = [s for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if (s := five(r.text))]
        return {i: t for i, t in rows if not any(len(s & five(t)) >= 0.8 * len(s) - 1e-9 for s in items)}
    return None


def test_stage_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontamination", "mixture"]


@pytest.fixture(scope="module")
def mixed(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        want = expected(spark, name, docs)
        docs = corpus_pipeline.materialize(stage(spark, docs, SF), name)
        got = docs.collect()
        assert docs.columns == first
        assert {r.doc_id: r.text for r in got} == want and len(got) == len(want)
    return docs, corpus_pipeline.materialize(corpus_pipeline.STAGES[-1][1](spark, docs, SF), "mixture")


def test_mixture(mixed):
    docs, out = mixed
    size = {r.doc_id: len(WORDS.findall(r.text)) for r in docs.collect()}
    per, taken, longest = collections.Counter(), collections.Counter(), collections.Counter()
    for r in docs.collect():
        per[r.source] += size[r.doc_id]
        longest[r.source] = max(longest[r.source], size[r.doc_id])
    for r in out.collect():
        assert 1 <= r.copies <= 3 and r.taken == r.copies * size[r.doc_id]
        taken[r.source] += r.taken
    for s, want in brute_targets(per).items():
        assert abs(taken[s] - want) <= longest[s]


def test_run_gives_the_stages_rows(spark, mixed):
    again = corpus_pipeline.run(spark, SF).select("doc_id", "copies", "text").collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, mixed[1].select("doc_id", "copies", "text").collect()))


def _run(spark, tmp_path, docs):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    return corpus_pipeline.run(spark, str(tmp_path))


def test_empty_table(spark, tmp_path):
    out = _run(spark, tmp_path, spark.read.parquet(f"{SF}/documents.parquet").limit(0))
    assert out.count() == 0 and out.columns[-2:] == ["copies", "taken"]


def test_nulls_repeats_and_further_columns(spark, tmp_path):
    """Odd rows among real ones go through all stages with their further columns."""
    real = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    odd = [(None, None, None, None, None), (None, real[0][1] + " and more", "en", None, 5), (-1, None, "en", "s", 0), (-2, "", None, "s", 0), (-3, "word " * 40000, "en", "s", 1), (real[1][0], real[1][1], "en", "src0", 3)]
    names = ["id", "key", "v", "a", "b", "n", "h", "cut", "component_id", "kept", "size", "taken", "loomsift_id"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in names)
    docs = spark.createDataFrame([(*r, *[f"{c}!" for c in names]) for r in real + odd], schema).repartition(3)
    out = _run(spark, tmp_path, docs).collect()
    assert 0 < len(out) <= len(real) + len(odd)
    for r in out:
        assert r.text and r.key == "key!" and r.component_id == "component_id!" and isinstance(r.taken, int) and 1 <= r.copies <= 3


def test_line_dedup_leaves_most_documents_alone(spark):
    shared = " ".join(f"word{i}" for i in range(20))
    docs = spark.createDataFrame([(i, f"own {i}\n{shared}" if i < 2000 else f"own {i}", 7) for i in range(8000)], "doc_id long, text string, n_chars long")
    got = corpus_pipeline.line_dedup(spark, docs, SF).collect()
    assert {r.doc_id: r.text for r in got} == {i: f"own {i}" if i else f"own 0\n{shared}" for i in range(8000)}
    assert all(r.n_chars == (len(r.text) if 0 < r.doc_id < 2000 else 7) for r in got)
