import os
import subprocess
import sys

import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from sievra.llm import queries
from tests.compare import connect, difference
from tests.llm.test_links import groups
from tests.llm.helpers import messy, sentence

SF = os.environ.get("QUERY_SF_DIR", "/root/testdata/sf0.001")


def test_registered_names():
    names = set(queries.REGISTRY)
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert names | {"pipeline"} <= set(entry.queries()) and "pipeline" not in entry.oracle_sql()


@pytest.mark.parametrize("name", [n for n, (_, sql) in queries.REGISTRY.items() if sql])
def test_queries_against_their_sql(spark, name):
    assert difference(entry.queries()[name](spark, SF), connect(SF), entry.oracle_sql()[name]) is None


@pytest.mark.parametrize("name", [n for n, (_, sql) in queries.REGISTRY.items() if not sql])
def test_queries_return_a_row_for_every_document(spark, name):
    found = entry.queries()[name](spark, SF).toPandas()
    docs = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id"]).to_pandas()
    assert set(found.doc_id) == set(docs.doc_id) and (name.startswith("op10") or len(found) == len(docs))


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    item = sentence(30, 2, 5)
    rows = [
        (50, sentence(80, 4, 7), "en"), (51, sentence(80, 4, 7) + " extra", "en"), (52, "Intro: " + item + " and more " + sentence(20, 9), "en"),
        (53, sentence(40, 6, 3) + " write to a.b@c.example.com now " + sentence(12, 2), "en"), (54, "12345 67890", "en"),
    ]
    messy(spark, rows).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id BIGINT, text STRING").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_stages_keep_columns_and_do_their_work(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, small)
        assert after.schema == docs.schema
        path = f"{small}/{name}.parquet"
        after.write.parquet(path)
        seen[name], docs = (docs.collect(), spark.read.parquet(path).collect()), spark.read.parquet(path)
    ids = {n: [sorted((r.doc_id for r in rows if r.doc_id is not None)) for rows in pair] for n, pair in seen.items()}
    assert set(ids["language_id"][0]) - set(ids["language_id"][1]) == {3, 4, 5, 54}
    before, after = ids["near_dedup"]
    texts = [(r.doc_id, r.text) for r in seen["near_dedup"][0] if r.doc_id is not None]
    parts, _ = groups(dict(texts).items(), 5, 80)
    # Of the two equal rows of id 6 one stays.
    assert after == sorted({i for i in before if parts[i] == i}) and 51 not in after and 50 in after
    assert set(ids["decontamination"][0]) - set(ids["decontamination"][1]) == {52}
    assert ids["pii"][0] == ids["pii"][1]
    changed = [(a, b) for a, b in zip(*(sorted(rows, key=repr) for rows in seen["pii"])) if a != b]
    for _, b in changed:
        assert "@" not in b.text and b.n_chars == len(b.text)
    whole = {r.doc_id: r.text for r in docs.collect()}
    assert "<EMAIL>" in whole[53] and "a.b@c" not in whole[53]


def test_run_packs_what_is_left(spark, small):
    found = corpus_pipeline.run(spark, small).collect()
    # The text without id has the same shingles as that of id 1, and goes.
    assert {r.doc_id for r in found} == {1, 6, 7, 8, 50, 53}
    fills = {}
    for r in found:
        fills[r.sequence_id] = fills.get(r.sequence_id, 0) + r.length
    assert max(fills.values()) <= 2048


def test_the_rest_works_without_this_subpackage(tmp_path):
    """A copy of the repository without the folders of this subpackage still imports, with the other queries."""
    root = os.path.dirname(os.path.abspath(entry.__file__))
    for name in ("__spark_entry__.py", "sievra"):
        os.symlink(os.path.join(root, name), tmp_path / name) if name.endswith(".py") else None
    package = tmp_path / "sievra"
    package.mkdir()
    for name in os.listdir(os.path.join(root, "sievra")):
        if name not in ("llm", "__pycache__"):
            os.symlink(os.path.join(root, "sievra", name), package / name)
    (tmp_path / "copy.py").write_text(open(os.path.join(root, "__spark_entry__.py")).read())
    code = "import copy_entry as e; assert len(e.queries()) >= 100; assert not any(n.startswith('op') for n in e.queries()); print('fine')"
    os.rename(tmp_path / "copy.py", tmp_path / "copy_entry.py")
    env = {**os.environ, "PYTHONPATH": str(tmp_path)}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert "fine" in done.stdout, done.stderr
