"""The stages of the pipeline, each on its own input, against plain versions."""

import re

import corpus_pipeline
from palaver.llm import pii, quality
from palaver.llm.tables import table

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def five(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def test_stages(spark):
    docs = table(spark, SF, "documents")
    columns, before = docs.columns, {r["doc_id"]: r["text"] for r in docs.collect()}
    verdict = {r["doc_id"]: r["kept"] for r in quality.judge_documents(docs).collect()}
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_rules", "exact_duplicates", "near_duplicates", "personal_data", "sequences"]

    good = stages["quality_rules"](spark, docs, SF)
    kept = {r["doc_id"]: r["text"] for r in good.collect()}
    assert good.columns == columns and set(kept) == {d for d, k in verdict.items() if k}

    single = stages["exact_duplicates"](spark, good, SF)
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t)
    best = {}
    for d, t in kept.items():
        best[norm(t)] = min(best.get(norm(t), (0, 1 << 60)), (-len(t), d))
    once = {r["doc_id"]: r["text"] for r in single.collect()}
    assert single.columns == columns and set(once) == {d for _, d in best.values()}

    sets = {d: five(t) for d, t in once.items()}
    up = {d: d for d in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    apart = stages["near_duplicates"](spark, single, SF)
    left = {r["doc_id"]: r["text"] for r in apart.collect()}
    assert apart.columns == columns and set(left) == {d for d in ids if find(d) == d}

    clean = stages["personal_data"](spark, apart, SF)
    rows = {r["doc_id"]: r for r in clean.collect()}
    assert clean.columns == columns and set(rows) == set(left)
    for d, r in rows.items():
        assert r["n_chars"] == len(r["text"]) and not pii.base_spans(r["text"])
        if not pii.find_spans([left[d]], pii.model())[0][1]:
            assert r["text"] == left[d] == before[d]

    pieces = stages["sequences"](spark, clean, SF).toPandas()
    assert set(pieces.doc_id) == set(rows) and pieces.groupby("sequence_id").length.sum().max() <= 4096
    assert len(corpus_pipeline.run(spark, SF).toPandas()) == len(pieces)


def test_stages_on_awkward_rows(spark):
    """Repeated ids and rows, nulls, blank and very long texts, extra columns with names that stages use, and an empty table."""
    import random

    r = random.Random(4)
    say = lambda n: " ".join("".join(r.choice("abcdefghij") for _ in range(r.randrange(3, 9))) + r.choice(["", "", "", "", ".", ","]) for _ in range(n))
    one, two, long = say(120), say(130), say(30_000)
    texts = [(1, one), (1, one), (1, two), (2, one.replace(" ", "  ")), (3, None), (4, ""), (5, " \n"), (6, long), (7, one + " tail"), (None, two), (None, say(90)), (8, say(100))]
    extra = ["_id", "_gone", "_spans", "_row", "_many", "kept", "shard", "votes", "n", "family"]
    schema = "doc_id long, text string, n_chars long, " + ", ".join(f"{c} string" for c in extra)
    docs = spark.createDataFrame([(d, t, len(t or ""), *extra) for d, t in texts], schema)
    survivors = sorted(map(len, [long, two, one.replace(" ", "  "), texts[10][1], texts[11][1]]))
    for df, want in ((docs, survivors), (docs.limit(0), [])):
        left = df
        for name, stage in corpus_pipeline.STAGES[:3]:
            left = stage(spark, left, SF)
            assert left.columns == docs.columns, name
        assert sorted(len(x["text"]) for x in left.collect()) == want
        left = corpus_pipeline.STAGES[3][1](spark, left, SF)
        assert left.columns == docs.columns and left.count() == len(want)
        pieces = corpus_pipeline.STAGES[4][1](spark, left, SF).toPandas()
        assert (pieces.start == 0).sum() == len(want) and pieces.groupby("sequence_id").length.sum().le(4096).all()


def test_personal_data_far_from_any_sign(spark):
    plain = "the rain was over and people went back to work some time after it " * 3
    docs = spark.createDataFrame([(1, f"{plain}so send it to Delu Schmidt, {plain}")], "doc_id long, text string")
    stages = dict(corpus_pipeline.STAGES)
    assert stages["personal_data"](spark, docs, SF).first()["text"] == f"{plain}so send it to [NAME], {plain}"
