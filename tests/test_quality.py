"""The data-quality operators on small fixtures, against brute force and in the corner cases."""

import json
import math
import random

import numpy as np
import pytest

from ctmcflow.operators import drift, fill, profile
from ctmcflow.session import Scratch


def ks(a, b):
    at = sorted(set(a) | set(b))
    return max(abs(sum(x <= v for x in a) / len(a) - sum(x <= v for x in b) / len(b)) for v in at)


def test_profile_is_exact(spark):
    rnd = random.Random(1)
    rows = [(i % 3, None if rnd.random() < 0.1 else float("nan") if rnd.random() < 0.1 else round(rnd.gauss(i % 3, 1), 1), rnd.choice(["a", "b", "cc", None]), rnd.randint(-2, 2), "x") for i in range(400)]
    df = spark.createDataFrame(rows, "load_id int, d double, s string, k long, _load string")
    got = {(r["load"], r["column_name"]): r for r in profile.profile(df, ["d", "s", "k", "_load"], patterns={"s": "s RLIKE '^[ab]$'", "k": "k >= 0"}).collect()}
    for l in range(3):
        for i, c in enumerate(["d", "s", "k"], 1):
            own = [r[i] for r in rows if r[0] == l and r[i] is not None and r[i] == r[i]]
            rest = [r[i] for r in rows if r[0] != l and r[i] is not None and r[i] == r[i]]
            r = got[l, c]
            n = sum(x[0] == l for x in rows)
            assert r["n_rows"] == n and r["n_null"] == n - len(own) and r["n_distinct"] == len(set(own))
            assert r["ks"] == pytest.approx(ks(own, rest), abs=1e-12)
            if c != "s":
                assert [r["q25"], r["q50"], r["q75"]] == pytest.approx(list(np.quantile(np.array(own, float), [0.25, 0.5, 0.75])))
                assert float(r["min_value"]) == min(own) and float(r["max_value"]) == max(own)
        assert got[l, "s"]["violations"] == sum(r[0] == l and r[2] == "cc" for r in rows)
    whole = got[None, "d"]
    assert whole["n_rows"] == 400 and whole["n_distinct"] == len({r[1] for r in rows if r[1] is not None and r[1] == r[1]})


def test_profile_corner_cases(spark):
    empty = spark.createDataFrame([], "load_id int, a double")
    assert profile.profile(empty, ["a"]).count() == 0
    rows = spark.createDataFrame([(None, None, None), (1, None, "x" * 200_000), (1, None, "")], "load_id int, a double, t string")
    got = {(r["load"], r["column_name"]): r for r in profile.profile(rows, ["a", "t"]).collect()}
    assert got[-1, "a"]["null_rate"] == 1.0 and got[1, "a"]["min_value"] is None
    assert got[1, "t"]["n_distinct"] == 2 and got[1, "t"]["max_value"] == "x" * 200_000
    assert profile.changed_loads(profile.profile(empty, ["a"])).count() == 0


def test_profile_finds_changed_loads(spark):
    rnd = random.Random(3)
    rows = []
    for l in range(10):
        for _ in range(300):
            v = rnd.gauss(0, 1) + (5 if l == 4 else 0)
            rows.append((l, None if rnd.random() < (0.6 if l == 7 else 0.05) else v, "OK" if l != 2 or rnd.random() < 0.4 else " ok "))
    df = spark.createDataFrame(rows, "load_id int, v double, status string")
    p = profile.profile(df, ["v", "status"], patterns={"status": "status RLIKE '^[A-Z]+$'"}, quantiles=False)
    assert {(r["load_id"], r["column_name"]) for r in profile.changed_loads(p).collect()} == {(4, "v"), (7, "v"), (2, "status")}


FEATURES = "feature_id long, dps_dir string, sequence string, variant string, status string, n_nodes long, degree_mean double, n_communities int, modularity double, community_size_entropy double, largest_community_frac double, u_status string"


def feature_rows(n=600, seed=5):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        g = i % 6
        c = g + 2
        rows.append([i, f"/a/s{g}", f"s{g}", "19sb", "OK" if rnd.random() < 0.9 else "PARTIAL(x)", 500 + 10 * g, 8.0, c, min(1.0, 0.3 + 0.1 * g + rnd.gauss(0, 0.02)), 1 + 0.2 * g, 0.3, "clash"])
    return rows


def test_fill_marks_and_recovers(spark):
    rows = feature_rows()
    truth = {}
    for r in rows[::10]:
        truth[r[0]] = (r[8], r[7])
        r[8], r[7], r[4] = [(None, -1, "?"), (float("nan"), 9999, None), (1e30, None, " ")][r[0] % 3]
    rows.append([9999, None, None, None, None, None, None, None, None, None, None, None])  # never computed
    rows.append([10000, None, None, None, "ok", 5, None, None, None, None, None, None])
    df = spark.createDataFrame(rows, FEATURES)
    got = {r["feature_id"]: r for r in fill.fill_features(Scratch(spark, "t"), df, k=8).collect()}
    assert 9999 not in got and got[10000]["modularity_filled"] and got[10000]["status"] == "ok" and not got[10000]["status_filled"]
    assert {i for i, r in got.items() if r["modularity_filled"]} == {*truth, 10000}
    assert np.mean([abs(got[i]["modularity"] - m) for i, (m, _) in truth.items()]) < 0.05
    assert np.mean([got[i]["n_communities"] == c for i, (_, c) in truth.items()]) > 0.9
    assert all(got[i]["status_filled"] and got[i]["status"] in fill.KINDS for i in truth)
    assert all(-0.5 <= r["modularity"] <= 1 and 1 <= r["n_communities"] <= 12 for r in got.values())


def test_fill_empty(spark):
    df = spark.createDataFrame([], FEATURES)
    assert fill.fill_features(Scratch(spark, "t"), df).count() == 0


def test_em_likelihood_rises():
    rng = np.random.default_rng(0)
    x = np.r_[rng.normal(0, 1, (200, 2)), rng.normal(5, 1, (200, 2))]
    x[::7, 0] = np.nan
    c = np.r_[np.zeros(200, int), np.ones(200, int)][:, None]
    m = fill.start(x, [2], 2, np.nanmean(x, 0), np.nanstd(x, 0))
    last = -np.inf
    for _ in range(15):
        s = fill.statistics(m, x, c)
        assert s[0] >= last - 0.5  # the ridge on covariances costs a little
        last, m = s[0], fill.maximise(m, s)
    assert np.isfinite(last)


def drift_case(spark, files):
    rows, fid = [], 0
    for source, seq, lines in files:
        fid += 1
        rows += [(fid, source, seq, f"{source}/{seq}", k, line if line is None or isinstance(line, str) else json.dumps(line), "clash") for k, line in enumerate(lines)]
    df = spark.createDataFrame(rows, "file_id long, source string, file_seq int, file_name string, line_no int, record string, v string")
    scripts = Scratch(spark, "d").put(drift.file_scripts(drift.file_fields(df)), "s")
    return df, scripts


def test_drift_changes(spark):
    one = {"network_id": "n", "MFPT_AB": 1e-8, "Var_AB": 1e-15, "nA": 1}
    df, scripts = drift_case(spark, [
        ("a", 0, [one, one, "# note", "", None, '{"net']),
        ("a", 1, [one | {"solver": "x"}] * 3),
        ("a", 2, [{"network_id": "n", "mfpt_fwd": [1e-8], "VarAB": "1e-15", "nA": 1}] * 3),
        ("a", 3, [{"network_id": "n", "mfpt_fwd": None, "VarAB": 1e-15, "nA": 1}] * 2),
        ("a", 4, [{"network_id": "n", "mfpt_fwd": {"value": 1e-8, "unit": "s"}, "VarAB": 1e-15, "nA": "1"}] * 2),
        ("b", 0, [one]), ("b", 1, ["broken"]), ("b", 2, [one]),
    ])
    got = {tuple(r) for r in drift.changes(df, scripts).collect()}
    assert got == {
        (2, "solver", "added"), (3, "solver", "removed"), (3, "MFPT_AB", "renamed"), (3, "MFPT_AB", "type_changed"), (3, "Var_AB", "renamed"), (3, "Var_AB", "type_changed"),
        (4, "Var_AB", "type_changed"), (5, "MFPT_AB", "type_changed"), (5, "nA", "type_changed"),
        *((7, f, "removed") for f in one), *((8, f, "added") for f in one),
    }
    t = {(r["file_id"], r["line_no"]): r for r in drift.unified(df, scripts).collect()}
    assert t[3, 0]["MFPT_AB"] == 1e-8 and t[5, 0]["MFPT_AB"] == 1e-8 and t[3, 0]["Var_AB"] == 1e-15 and t[5, 0]["nA"] == 1
    assert t[1, 1]["line"] == "repeat" and {t[1, k]["line"] for k in (2, 3, 4, 5)} == {"broken"} and json.loads(t[2, 0]["other"]) == {"solver": "x"}


def test_drift_empty_and_moved(spark):
    df, scripts = drift_case(spark, [])
    assert drift.changes(df, scripts).count() == 0 and drift.unified(df, scripts).count() == 0
    df, scripts = drift_case(spark, [("a", 0, [{"network_id": "n", "kin": {"MFPT_AB": 2e-8}, "big": "y" * 100_000}])])
    r = drift.unified(df, scripts).first()
    assert r["MFPT_AB"] == 2e-8 and scripts.filter("operation = 'moved'").first()["path"] == "kin.MFPT_AB"


def test_assignment_is_optimal():
    from itertools import permutations

    rng = np.random.default_rng(2)
    for n in range(1, 6):
        c = rng.random((n, n))
        a = drift.assign(c)
        assert sum(c[i, a[i]] for i in range(n)) == pytest.approx(min(sum(c[i, p[i]] for i in range(n)) for p in permutations(range(n))))


def random_tree(rnd, n, names):
    fields, places = [], [()]
    for i in range(n - 1):
        above = rnd.choice(places)
        s = (*above, f"{rnd.choice(names)}{i}")
        fields.append((s, rnd.choice(["number", "string"]), 1.0))
        places.append(s)
    kinds = {s: "object" for s, _, _ in fields if any(o[:-1] == s for o, _, _ in fields)}
    return drift.tree_of([(s, kinds.get(s, k), x) for s, k, x in fields])


def brute_distance(a, b):
    """The least cost of all constrained mappings: nodes keep their ancestors, and separate subtrees stay separate."""
    x, y = [a, *drift.below(a)], [b, *drift.below(b)]
    over = lambda p, q: p.steps == q.steps[: len(p.steps)]

    def lca(p, q):
        i = 0
        while i < min(len(p.steps), len(q.steps)) and p.steps[i] == q.steps[i]:
            i += 1
        return p.steps[:i]

    best = [float(len(x) + len(y))]

    def fits(m, p, q):
        if any(over(p, u) != over(q, v) or over(u, p) != over(v, q) for u, v in m):
            return False
        t = [*m, (p, q)]
        for i, (u1, v1) in enumerate(t):
            for u2, v2 in t[i + 1 :]:
                for u3, v3 in t:
                    l1, l2 = lca(u1, u2), lca(v1, v2)
                    if (l1 == u3.steps[: len(l1)] and l1 != u3.steps) != (l2 == v3.steps[: len(l2)] and l2 != v3.steps):
                        return False
        return True

    def go(i, m, free, cost):
        best[0] = min(best[0], cost)
        for k in range(i, len(x)):
            for q in free:
                if fits(m, x[k], q):
                    go(k + 1, [*m, (x[k], q)], [z for z in free if z is not q], cost - 2 + drift._one(x[k], q))

    go(0, [], y, best[0])
    return best[0]


def test_tree_distance_equals_brute_force():
    rnd = random.Random(7)
    for _ in range(60):
        a, b = random_tree(rnd, rnd.randint(1, 5), ["MFPT_AB", "nA", "x", "solver"]), random_tree(rnd, rnd.randint(1, 5), ["mfpt_fwd", "n_A", "y", "solve"])
        got = drift.distance(a, b)[0]
        assert got == pytest.approx(brute_distance(a, b)), (a, b)
        assert got == pytest.approx(drift.distance(b, a)[0])
    t = random_tree(rnd, 12, ["a", "b", "c"])
    assert drift.distance(t, t)[0] == 0


def test_schema_text():
    text = "OBJECT<``: BIGINT, arr: ARRAY<OBJECT<p: VARIANT, q: STRING>>, b: OBJECT<c: ARRAY<DECIMAL(21,1)>, `d e`: VOID, `x.y`: STRING>, `we``ird<>,: k`: BOOLEAN, w: OBJECT<unit: STRING, value: DOUBLE>, aa: ARRAY<ARRAY<OBJECT<z: BIGINT>>>>"
    assert dict(drift.schema_fields(text)) == {
        ("",): "number", ("arr",): "array", ("arr", "[]"): "object", ("arr", "[]", "p"): "number", ("arr", "[]", "q"): "string", ("b",): "object", ("b", "c"): "array", ("b", "d e"): "null", ("b", "x.y"): "string",
        ("we`ird<>,: k",): "boolean", ("w",): "object", ("aa",): "array", ("aa", "[]"): "array", ("aa", "[]", "[]"): "object", ("aa", "[]", "[]", "z"): "number",
    }
    assert drift.schema_fields("OBJECT<>") == []


def test_drift_at_depth(spark):
    """Fields three levels down and inside arrays are found, renamed, moved as a whole, and read into the table."""
    deep = {"network_id": "n", "run": {"kin": {"MFPT_AB": "1e-8", "mfpt_rev": {"value": 2e-8, "unit": "s"}}, "set": {"solver": "x", "tol": 1}}, "hist": [{"Var_AB": 3e-15, "step": 1}]}
    moved = {"network_id": "n", "MFPT.AB": 1e-8, "job": {"opts": {"set": {"solver": "x", "tol": 1}}, "kin": {"MFPT_BA": 2e-8}}, "hist": [{"var_fwd": [4e-15], "stepp": 1}]}
    df, scripts = drift_case(spark, [("a", 0, [deep] * 2), ("a", 1, [moved] * 2)])
    ops = {(r["file_id"], r["path"]): (r["field"], r["operation"]) for r in scripts.collect()}
    assert ops[1, "run.kin.MFPT_AB"] == ("MFPT_AB", "moved") and ops[1, "run.kin.mfpt_rev"] == ("MFPT_BA", "moved") and ops[1, "hist.[].Var_AB"] == ("Var_AB", "moved")
    assert ops[2, "MFPT.AB"] == ("MFPT_AB", "renamed") and ops[2, "job.kin.MFPT_BA"] == ("MFPT_BA", "moved") and ops[2, "hist.[].var_fwd"] == ("Var_AB", "moved")
    t = {r["file_id"]: r for r in drift.unified(df, scripts).collect()}
    assert [t[1][c] for c in ("MFPT_AB", "MFPT_BA", "Var_AB")] == [1e-8, 2e-8, 3e-15] and [t[2][c] for c in ("MFPT_AB", "MFPT_BA", "Var_AB")] == [1e-8, 2e-8, 4e-15]
    got = {tuple(r)[1:] for r in drift.changes(df, scripts).collect()}
    assert {("MFPT_AB", "renamed"), ("MFPT_AB", "type_changed"), ("MFPT_BA", "renamed"), ("Var_AB", "renamed"), ("Var_AB", "type_changed"), ("job.opts.set.solver", "renamed"), ("job.opts.set", "renamed"), ("hist.[].stepp", "renamed")} <= got
    assert not {f for f, c in got if c in ("added", "removed")} & {"MFPT_AB", "MFPT_BA", "Var_AB", "run.set.solver", "job.opts.set.solver", "hist.[].step", "hist.[].stepp"}
    empty, s = drift_case(spark, [("a", 0, ["broken"]), ("a", 1, [None, "[1]"])])
    assert s.count() == 0 and drift.unified(empty, s).count() == 3


def test_tree_distance_prefers_same_quantity():
    assert drift.relabel("passage_time_AB", "MFPT_AB") < 2 < drift.relabel("passage_time_BA", "MFPT_AB")
    assert math.isclose(drift.distance(drift.tree_of([]), drift.tree_of([]))[0], 0.0)
