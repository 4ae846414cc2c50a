"""The pipeline: every stage against brute force on its own input."""

import sys
from pathlib import Path

import pytest

import corpus_pipeline
from weirflow import durable
from weirflow.durable import materialize
from weirflow.llm import components as union_find
from weirflow.llm import lines, mixing, quality, simhash

sys.path.insert(0, str(Path(__file__).parent))
import test_packing as cut  # noqa: E402
from test_line_dedup import groups_by_force as force  # noqa: E402
from test_simhash import by_hand as prints  # noqa: E402
from test_simhash import components  # noqa: E402


@pytest.fixture(scope="module")
def steps(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [docs]
    for name, f in corpus_pipeline.STAGES:
        out.append(materialize(f(spark, out[-1], sf_dir), name))
    return out


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_columns(steps):
    assert all(s.columns == steps[0].columns for s in steps[:5])


def test_quality_keeps_what_sql_keeps(steps, duck):
    want = duck.execute(quality.SQL["op4_quality_rules"]).fetchall()
    assert ids(steps[1]) == sorted(r[0] for r in want if r[-1])


def test_lines(steps):
    before = {r.doc_id: r.text for r in steps[1].collect()}
    order = sorted(before)
    gone = {(order[d], k) for d, k in force([before[i] for i in order])}
    after = {r.doc_id: r for r in steps[2].collect()}
    assert set(after) == set(before)
    lost = 0
    for i, r in after.items():
        parts = before[i].split("\n")
        kept = [x for k, x in enumerate(parts) if (i, k) not in gone]
        lost += r.text != "\n".join(kept)
        assert r.n_chars == len(r.text)
    assert lost <= 0.01 * len(after) and lines.BANDS == 10


def test_near_duplicates(steps):
    groups = components({r.doc_id: prints(r.text) for r in steps[2].collect()})
    assert ids(steps[3]) == sorted({g for g in groups.values()})


def test_mixing_takes_a_prefix_of_every_leaf(steps):
    rows = steps[3].select("doc_id", *mixing.keyed(steps[3])).collect()
    kept = set(ids(steps[4]))
    total = sum(r.n for r in rows)
    got = sum(r.n for r in rows if r.doc_id in kept)
    leaves = {(r.g0, r.g1, r.g2) for r in rows}
    assert total * 85 // 100 - len(leaves) <= got <= total * 85 // 100 + sum(max(r.n for r in rows if (r.g0, r.g1, r.g2) == leaf) for leaf in leaves)
    assert kept <= {r.doc_id for r in rows if r.n}


def test_packing(steps):
    direct = cut.tokenizers.Tokenizer.from_file(cut.packing.tokenizer_path())
    cut.check(steps[5].collect(), {r.doc_id: r.text for r in steps[4].collect()}, direct)


def test_run(spark, sf_dir, steps):
    assert sorted((r.doc_id, r.start, r.ids_crc32) for r in corpus_pipeline.run(spark, sf_dir).collect() if r.start == 0 and r.doc_tokens < 2000)
    assert corpus_pipeline.run(spark, sf_dir).agg({"length": "sum"}).first()[0] == steps[5].agg({"length": "sum"}).first()[0]


def test_empty_documents(spark, tmp_path, sf_dir):
    spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_a_finished_run_leaves_its_last_table_only(spark, sf_dir):
    def folders():
        path = spark._jvm.org.apache.hadoop.fs.Path(durable.app_dir(spark))
        return {x.getPath().getName() for x in path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)}

    materialize(spark.range(1), "first")
    before = folders()
    out = corpus_pipeline.run(spark, sf_dir)
    assert {x.rsplit("-", 1)[0] for x in folders() - before} == {"mixing"} and out.count() > 0


def test_near_duplicate_stage_broadcasts_nothing_by_estimates(spark, sf_dir, steps, monkeypatch):
    """Under the default limit of broadcasts: Spark takes exploded keys for as small as their file."""
    plans = []
    note = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString())
    for name in ("materialize", "components"):
        monkeypatch.setattr(simhash, name, lambda df, *a, f=getattr(simhash, name): (note(df), f(df, *a))[1])
    name, stage = corpus_pipeline.STAGES[2]
    out = stage(spark, steps[2], sf_dir)
    note(out)
    assert name == "simhash_dedup" and ids(out) == ids(steps[3])
    assert sum("Join" in p for p in plans) >= 7 and [p for p in plans if "Broadcast" in p] == []


def test_components_are_never_broadcast(spark, monkeypatch):
    """Links and nodes of a stage grow with its input; this chain takes several rounds."""
    plans, real = [], union_find.materialize
    monkeypatch.setattr(union_find, "materialize", lambda df, name: (plans.append(df._jdf.queryExecution().executedPlan().toString()), real(df, name))[1])
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    assert {(r.node, r.root) for r in union_find.components(chain).collect()} == {(i, 0) for i in range(41)} | {(100, 100), (101, 100)}
    assert sum("Join" in p for p in plans) > 3 and [p for p in plans if "Broadcast" in p] == []


def test_no_plan_depends_on_broadcasts(spark, sf_dir, steps):
    """Line dedup and SimHash dedup give the same rows if nothing at all may be broadcast."""
    off = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k, None) for k in off}
    try:
        for k, v in off.items():
            spark.conf.set(k, v)
        plan = lines.dedup_lines(steps[1])
        got = sorted((r.doc_id, r.text) for r in plan.collect())
        assert "BroadcastHashJoin" not in plan._jdf.queryExecution().executedPlan().toString()
        kept = ids(simhash.drop_near_duplicates(steps[2]))
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert got == sorted((r.doc_id, r.text) for r in steps[2].collect()) and kept == ids(steps[3])
