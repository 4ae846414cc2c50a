"""Mixing: SQL, budgets by hand, odd rows."""

from collections import defaultdict


from weirflow.llm import mixing

DOC = "doc_id long, text string, lang string, source string, n_chars long, take string"


def test_query(same):
    same(mixing.op2_mixing, mixing.SQL["op2_mixing"])


def pour_by_hand(budget, caps, weights):
    """Fill children in rounds; whole shares of what is left."""
    got, open_, left = {}, dict(caps), budget
    while open_:
        total = sum(weights[k] for k in open_)
        full = [k for k in open_ if open_[k] * total <= weights[k] * left]
        if not full:
            got |= {k: weights[k] * left // total for k in open_}
            for k in sorted(open_, key=lambda k: (caps[k] / weights[k], k))[: budget - sum(got.values())]:
                got[k] += 1
            break
        for k in full:
            got[k] = open_.pop(k)
        left = budget - sum(got.values())
    return got


def test_shortages_go_to_siblings_first(spark):
    caps = {("web", "en", "a"): 100, ("web", "en", "b"): 1000, ("web", "de", "c"): 50, ("news", "en", "d"): 5000, ("news", "fr", "e"): 10}
    leaves = spark.createDataFrame([(*k, v, 1) for k, v in caps.items()], "g0 string, g1 string, g2 string, total long, docs long")
    for share in ((1, 10), (1, 4), (1, 2), (9, 10), (1, 1)):
        got = {(r.g0, r.g1, r.g2): r.quota for r in mixing.budgets(leaves, mixing.WEIGHTS, share, 1).collect()}
        want = {}
        for level0, b0 in pour_by_hand(sum(caps.values()) * share[0] // share[1], {g: sum(v for k, v in caps.items() if k[0] == g) for g in ("web", "news")}, {"web": 50, "news": 20}).items():
            sums = defaultdict(int)
            for k, v in caps.items():
                if k[0] == level0:
                    sums[k[1]] += v
            for level1, b1 in pour_by_hand(b0, dict(sums), {x: mixing.WEIGHTS["lang"].get(x, 1) for x in sums}).items():
                own = {k[2]: v for k, v in caps.items() if k[:2] == (level0, level1)}
                want |= {(level0, level1, s): q for s, q in pour_by_hand(b1, own, dict.fromkeys(own, 1)).items()}
        assert got == want and sum(got.values()) == sum(caps.values()) * share[0] // share[1]
    web = {k: v for k, v in got.items()}
    assert web == caps


def test_slices_find_the_same_prefix(spark, monkeypatch):
    """Many slices per leaf give the same documents as one."""
    rows = [(i, "abcd" * (i % 13), "en", f"src{i % 2}", 0, "x") for i in range(3000)]
    docs = spark.createDataFrame(rows, DOC).repartition(4)
    picks = []
    for size in (1024, 16):
        monkeypatch.setattr(mixing, "SLICE", size)
        out = mixing.mix_documents(docs, share=(37, 100))
        assert out.columns == docs.columns
        picks.append(sorted(r.doc_id for r in out.collect()))
    assert picks[0] == picks[1] and 0 < len(picks[0]) < 3000
    tokens = sum(len(rows[i][1]) // 4 for i in picks[0])
    whole = sum(len(r[1]) // 4 for r in rows)
    assert 0 <= tokens - whole * 37 // 100 < 2 * 13


def test_epochs_and_takes(spark):
    rows = [(i, "word" * 10, "en", "src0") for i in range(10)] + [(100 + i, "word" * 10, "de", "src1") for i in range(100)]
    slim = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    slim = slim.select(*mixing.keyed(slim))
    out = mixing.take(slim, mixing.plan(slim, mixing.WEIGHTS, (1, 2), 4, 3), 3).collect()
    per = defaultdict(int)
    for r in out:
        per[r.g0] += r["take"]
        assert 0 < r["take"] <= r.n
    assert per["web"] + per["reference"] == 550 and per["web"] in (50 * 550 // 70, 50 * 550 // 70 + 1)
    whole = defaultdict(set)
    for r in out:
        if r.g0 == "web":
            whole[r.epoch].add(r.id)
    assert all(len(whole[e]) == 10 for e in range(max(whole)))


def test_odd_rows(spark):
    rows = [(None, "some text here", None, None, 0, "x"), (1, None, "en", "src1", 0, "x"), (2, "", "en", "src1", 0, "x"), (3, "text " * 9, "en", "src99999999999", 0, "x"), (4, "a" * 300_000, "zz", "other", 0, "x"), (5, "same", "en", "src1", 0, "x"), (5, "same", "en", "src1", 0, "x")]
    docs = spark.createDataFrame(rows, DOC)
    everything = mixing.mix_documents(docs, share=(1, 1)).collect()
    assert sorted(str(r.doc_id) for r in everything) == ["3", "4", "5", "5", "None"]
    assert mixing.mix_documents(docs, share=(0, 1)).count() == 0
    assert mixing.mix_documents(docs.limit(0)).count() == 0


def test_main_path_is_native(spark, sf_dir):
    plan = mixing.op2_mixing(spark, sf_dir)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan
