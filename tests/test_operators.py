import random

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from palaver.operators import budgets, graph, lexical, merge, ranking, sessions, usage
from palaver.plans import catalog
from palaver.schema import DDL, Store, violations

SF = "/root/testdata/sf0.001"


def make(spark, **rows):
    empty = Store.empty(spark)
    return empty.with_tables(**{n: spark.createDataFrame(r, DDL[n]) for n, r in rows.items()})


def naive_mainline(placements, edges, times):
    """The contract, stated over one session: (chain, error)."""
    by_id = {p[0]: p for p in placements}
    order = lambda p: (0 if times[p[3]] is None else 2, times[p[3]] or "", p[2], p[4], p[0])
    parent = dict(edges)
    cand = [p for p in placements if not p[5]] or list(placements)
    used = {parent[p[0]] for p in cand if p[0] in parent}
    leaves = [p for p in cand if p[3] not in used]
    pool = [p for p in leaves if p[0] in parent] or leaves or cand
    at, chain, seen = max(pool, key=order)[0], [], set()
    while at and at not in seen:
        seen.add(at)
        chain.append(at)
        if at not in parent:
            break
        hits = [p for p in placements if p[3] == parent[at]]
        if len(hits) > 1:
            hits = [p for p in hits if p[2] == by_id[at][2]]
            if len(hits) != 1:
                return None
        at = hits[0][0] if hits else None
    return chain[::-1]


def test_mainline_equals_a_naive_walk_on_random_graphs(spark):
    placements, edges, messages, expected = [], [], {}, {}
    for k in range(60):
        r = random.Random(k)
        session, n = f"ses_v1_{k:02}", r.randrange(1, 9)
        own, own_edges = [], {}
        for j in range(n):
            m = f"msg_v1_{k}_{r.randrange(max(1, n - 1)) if r.random() < 0.2 else j}"
            messages[m] = r.choice([None, f"2024-01-01T00:00:{r.randrange(60):02}Z"])
            own.append((f"plc_v1_{k}_{j}", session, f"doc_v1_{r.randrange(2)}", m, j, r.random() < 0.3, None, None))
        for p in own:
            if r.random() < 0.8:
                own_edges[p[0]] = f"msg_v1_{k}_{r.randrange(n + 1)}"
        placements += own
        edges += [(c, p, None, "reply") for c, p in own_edges.items()]
        expected[session] = (own, own_edges)
    rows = [(m, "user", "t", t, None, None, "p") for m, t in messages.items()]
    s = make(spark, placements=placements, edges=edges, messages=rows)
    got = {}
    for row in graph.mainline(s).orderBy("session_id", "position").collect():
        got.setdefault(row["session_id"], []).append(None if row["error"] else row["placement_id"])
    for session, (own, own_edges) in expected.items():
        want = naive_mainline(own, own_edges, messages)
        assert got[session] == ([None] if want is None else want), session


def test_mainline_of_a_long_chain(spark):
    n = 400
    s = make(
        spark,
        placements=[(f"plc_v1_{k}", "ses_v1_a", "doc_v1_a", f"msg_v1_{k}", k, False, None, None) for k in range(n)],
        edges=[(f"plc_v1_{k}", f"msg_v1_{k - 1}", None, "reply") for k in range(1, n)],
        messages=[(f"msg_v1_{k}", "user", "t", None, None, None, "p") for k in range(n)],
    )
    chain = graph.mainline(s)
    assert chain.count() == n and violations(s).filter("n > 0 AND rule != 'missing_document'").count() == 0
    window = sessions.message_window(chain.join(s.placements, ["session_id", "placement_id"]), "msg_v1_0", 2)
    assert [r["position"] for r in window.orderBy("position").collect()] == [0, 1, 2]
    with pytest.raises(LookupError):
        sessions.message_window(chain.join(s.placements, ["session_id", "placement_id"]), "msg_v1_zz", 2)


def test_usage_fold():
    q = lambda n: (n, 0, 0, 0)
    assert usage.fold_totals([(0, q(100), q(100)), (1, q(100), q(5)), (2, q(99), q(5)), (3, q(130), q(30))], False) == [(0, q(100)), (3, q(30))]
    assert usage.fold_totals([(0, q(100), None), (1, q(50), None), (2, q(120), None)], False) == [(0, q(100)), (2, q(20))]
    assert usage.fold_totals([(0, q(100), q(7)), (1, q(110), q(10))], True) == [(1, q(10))]
    assert usage.fold_totals([(0, None, q(4)), (1, None, q(6)), (2, q(10), None)], False) == [(0, q(4)), (1, q(6))]
    assert usage.observation((10, 2, 4, 1)) == (6, 2, 4, 0, 1)


def test_index_and_scan_find_the_same(spark, tmp_path):
    docs = spark.createDataFrame([(1, "the mcp.json file"), (2, "mcp and json"), (3, "a JSON file, mcp json"), (4, None), (5, "日本語の file"), (6, "x " * 9000 + "tail")], "id long, t string")
    path = f"file://{tmp_path}/index"
    lexical.write_index(docs, "id", "t", path)
    for query in ("mcp.json", "json mcp", "OR", "日本", "file", "tail", "  "):
        scan = {r["id"]: round(r["bm25"], 9) for r in lexical.scan_search(docs, "id", "t", query).collect()}
        index = {r["id"]: round(r["bm25"], 9) for r in lexical.index_search(spark, path, query).collect()}
        assert scan == index, query
    assert {r["id"] for r in lexical.scan_search(docs, "id", "t", "mcp.json").collect()} == {1, 3}
    assert {r["id"] for r in lexical.scan_search(docs, "id", "t", "日本").collect()} == {5}


def test_budget_is_a_prefix(spark):
    items = spark.createDataFrame([(1, 5), (2, 9), (3, 1)], "k int, cost long")
    assert [r["k"] for r in ranking.running_budget(items, [F.col("k")], "cost", 8).collect()] == [1]
    page = spark.createDataFrame([("a", "x" * 100), ("b", "y" * 5000), ("c", "z")], "id string, text string")
    kept = budgets.clamp(page, [F.col("id")], budgets.hit_cost(), 10, 4096).collect()
    assert [(r["id"], r["reason"]) for r in kept] == [("a", "max_bytes")]


def test_budget_prefix_of_any_table_equals_its_sql(spark, tmp_path):
    r = random.Random(3)
    empty = [(k, 0) for k in range(2500)] + [(2500, 20_000), (2501, 1)]  # more rows within the budget than a page has
    keys = [None, None, -(2**63), 2**63 - 1, -1, 0, *(r.randrange(-(10**k), 10**k) for k in range(1, 18) for _ in range(20))]
    mixed = [(k, r.choice([None, 0, 5, 700, 3000, -2000])) for k in keys + keys[:30]]
    for name, rows in (("empty", empty), ("mixed", mixed), ("nulls", [(1, None), (2, None), (3, 4)]), ("none", [])):
        spark.createDataFrame(rows, "doc_id long, n_chars long").write.parquet(f"{tmp_path}/{name}/documents.parquet")
        con = duckdb.connect()
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/{name}/documents.parquet/*.parquet'")
        want = con.sql(catalog.ORACLE_SQL["budget_prefix"]).fetchall()
        got = [tuple(x) for x in catalog.QUERIES["budget_prefix"](spark, f"{tmp_path}/{name}").collect()]
        assert sorted(map(repr, got)) == sorted(map(repr, want))
        assert name != "empty" or len(got) == 2501


def test_sessions_are_found_by_the_whole_first_request(spark):
    from palaver.api import Engine, Search

    placed = [(f"plc_v1_{k}", "ses_v1_a", "doc_v1_a", f"msg_v1_{k}", k, False, None, None) for k in range(3)]
    said = [("msg_v1_0", "user", " \n", None, None, None, "p"), ("msg_v1_1", "user", "word " * 80 + "needle", None, None, None, "p"), ("msg_v1_2", "user", "other", None, None, None, "p")]
    s = make(spark, placements=placed, messages=said, sessions=[("ses_v1_a", None, None)])
    engine = Engine(spark, s, now_ms=0)
    assert {h["id"] for h in engine.search(Search("needle")).collect()} == {"msg_v1_1", "ses_v1_a"}
    assert {h["id"] for h in engine.search(Search("other")).collect()} == {"msg_v1_2"}


def test_peek_fits(spark):
    rows = [("s", "😀" * 190, "é" * 190), ("t", "a", "b")]
    df = spark.createDataFrame(rows, "session_id string, first_user_text string, last_user_text string")
    got = {r["session_id"]: r for r in sessions.fit_peek(df).collect()}
    import json

    for r in got.values():
        assert len(json.dumps({"first_user_text": r[1], "last_user_text": r[2]}, ensure_ascii=False, separators=(",", ":")).encode()) <= 1024
    assert got["t"][1:] == ("a", "b") and len(got["s"][1]) < 190


def test_tombstones_need_complete_scans_and_survivors(spark):
    known = spark.createDataFrame([("/a", "p"), ("/b", "p"), ("/c", "q")], "source_path string, provider_id string")
    found = spark.createDataFrame([("/a",)], "source_path string")
    gone = merge.tombstones(known, found, spark.createDataFrame([("p",)], "provider_id string"))
    assert [r["source_path"] for r in gone.collect()] == ["/b"]
    claims = spark.createDataFrame([("m1", "/a"), ("m1", "/b"), ("m2", "/b")], "entity_id string, source_path string")
    stay, lost = merge.survivors(claims, gone)
    assert {(r["entity_id"], r["source_path"]) for r in stay.collect()} == {("m1", "/a")} and [r[0] for r in lost.collect()] == ["m2"]


def test_empty_store(spark):
    s = Store.empty(spark)
    assert graph.mainline(s).count() == 0 and usage.totals(s).first()["sessions"] == 0 and sessions.titles(s).count() == 0


def rows_of(df):
    df = df[sorted(df.columns)]
    simple = lambda v: None if v is None or v is pd.NA or v != v else float(v) if isinstance(v, int | float) and not isinstance(v, bool) else v.item() if hasattr(v, "item") else v
    out = []
    for row in df.astype(object).itertuples(index=False):
        out.append(tuple(round(x, 9) if isinstance(x := simple(v), float) else x for v in row))
    return sorted(map(repr, out))


def test_han_spreads_over_all_documents(spark):
    import re

    han = "\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0002fa1f"

    def spread(t):
        if not re.search(f"[{han}]", t):
            return t
        runs = re.findall(f"[{han}]+|[^{han}]+", t)
        return " ".join(x for r in runs if (x := " ".join([*r, *map("".join, zip(r, r[1:], strict=False))]) if re.match(f"[{han}]", r) else r.strip(" ")))

    want = {}
    for d, t in duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall():
        want[d] = t and spread(t.replace("\n", "日本語").replace("of", "字𠀀").replace("th", "漢"))
    got = dict(catalog.QUERIES["han_bigrams_documents"](spark, SF).collect())
    assert got == want and sum("日 本 語" in (t or "") for t in got.values()) > 100


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_registered_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF).toPandas()
    if name in catalog.ORACLE_SQL:
        want = duck.sql(catalog.ORACLE_SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns) and rows_of(got) == rows_of(want)
    else:
        assert len(got)
