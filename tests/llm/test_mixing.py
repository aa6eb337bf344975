import random

from pyspark.sql import functions as F

from tickloom.llm import mixing as M

DOCS = "doc_id long, source string, lang string, n_tokens long, topic int, copies int, rank int"
TARGETS = "source string, target_share double, max_repeats int"


def mixture(spark, docs, targets):
    d = spark.createDataFrame([(*x, 1, 2) for x in docs], DOCS)
    t = spark.createDataFrame(targets, TARGETS)
    out = M.mix(d, t)
    return [tuple(r) for r in out.collect()], {r["source"]: r for r in M.shares(out, d, t).collect()}


def corpus(n=6000, seed=1):
    rng = random.Random(seed)
    return [(i, rng.choice("aaaaaabbc"), rng.choice(["en", "de"]), int(rng.lognormvariate(5, 1)) + 1, rng.randrange(3)) for i in range(n)]


def test_shares_and_caps(spark):
    rows, report = mixture(spark, corpus(), [("a", 0.4, 1), ("b", 0.4, 2), ("c", 0.2, 4), ("missing", 0.1, None)])
    assert len({r[0] for r in rows}) == len(rows) and all(r[3] <= {"a": 1, "b": 2, "c": 4}[r[1]] for r in rows)
    for s, share in (("a", 0.4), ("b", 0.4), ("c", 0.2)):
        assert abs(report[s]["reached_share"] - share) < 0.01
    assert report["missing"]["reached_share"] == 0 and report["missing"]["held_tokens"] == 0


def test_sources_without_cap_or_target(spark):
    docs = corpus() + [(9000, None, "en", 50, 0), (9001, "z", "en", 50, 0), (9002, "a", "en", 0, 0)]
    rows, report = mixture(spark, docs, [("a", 0.5, None), ("b", 0.5, None), ("c", 0.0, 1), (None, 0.3, 1)])
    assert {r[1] for r in rows} == {"a", "b"} and not {9000, 9001, 9002} & {r[0] for r in rows}
    assert abs(report["a"]["reached_share"] - 0.5) < 0.01


def test_empty(spark):
    assert mixture(spark, [], [("a", 1.0, 1)])[0] == []
    assert mixture(spark, corpus(50), [])[0] == []
    assert mixture(spark, corpus(50), [("a", 1.0, 0)])[0] == []


def test_raking_meets_all_marginals_when_it_can():
    cells = {(s, lang, t): 100.0 + 10 * i for i, (s, lang, t) in enumerate((s, g, t) for s in "ab" for g in ("en", "de") for t in (0, 1))}
    w = M.raked(cells, {"a": (0.7, None), "b": (0.3, None)})
    total = sum(w[c] * t for c, t in cells.items())
    assert abs(sum(w[c] * t for c, t in cells.items() if c[0] == "a") / total - 0.7) < 1e-9
    assert abs(sum(w[c] * t for c, t in cells.items() if c[1] == "en") / total - sum(t for c, t in cells.items() if c[1] == "en") / sum(cells.values())) < 1e-6


def test_measured_documents(spark):
    rows = [(1, "a", "EN-us", "The mill."), (2, None, None, None), (3, "a", "de", ""), (4, "b", "en", "word " * 20000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, source string, lang string, text string, topic string")
    got = {r["doc_id"]: r for r in M.measured(df, "doc_id", "source", "lang", "text").collect()}
    assert {i: (r["lang"], r["n_tokens"] > 0) for i, r in got.items()} == {1: ("en", True), 2: ("und", False), 3: ("de", False), 4: ("en", True)}
    assert got[4]["n_tokens"] >= 20000
    assert M.measured(df.where(F.lit(False)), "doc_id", "source", "lang", "text").count() == 0


def test_topics_separate_documents_of_different_words(spark):
    rng = random.Random(2)
    words = ["mill ferry harbour wagon", "Straße Mühle Hafen Brücke", "0 1 2 3 4 5 6 7", "récolte été hiver", "niño señor año", "XII IV VII", "a,b;c:d"]
    rows = [(i, "a", "en", " ".join(rng.choice(words[i % 7].split(" ")) for _ in range(60))) for i in range(700)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, text string")
    topics = {}
    for r in M.measured(df, "doc_id", "source", "lang", "text", topics=7).collect():
        topics.setdefault(r["doc_id"] % 7, []).append(r["topic"])
    most = {max(set(t), key=t.count) for t in topics.values()}
    assert len(most) == 7 and all(t.count(max(set(t), key=t.count)) == 100 for t in topics.values())
