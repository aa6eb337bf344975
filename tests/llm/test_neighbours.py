import numpy as np

from tickloom.llm import neighbours as N

SCHEMA = "id long, v array<float>, rep long, cell string, vec_id string"


def found(spark, rows, k, **options):
    df = spark.createDataFrame([(i, v, 1, "x", "y") for i, v in rows], SCHEMA)
    return {r["vec_id"]: [(x["id"], round(x["cosine"], 9)) for x in r["neighbours"]] for r in N.nearest_neighbours(df, "id", "v", k, **options).collect()}


def brute(rows, k):
    ok = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if v is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    ids = np.array([i for i, _ in ok])
    x = np.array([v / np.linalg.norm(v) for _, v in ok])
    out = {}
    for n, i in enumerate(ids):
        c = np.round(x @ x[n], 12)
        order = [m for m in np.lexsort((ids, -c)) if m != n][:k]
        out[int(i)] = [(int(ids[m]), round(float(c[m]), 9)) for m in order]
    return out


def test_recall_over_cells_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(N, "CELL_ROWS", (150, 400))
    monkeypatch.setattr(N, "SAMPLE", 300)
    rng = np.random.default_rng(8)
    centres = rng.standard_normal((30, 16))
    rows = [(i, (centres[rng.integers(30)] + 0.4 * rng.standard_normal(16)).astype(np.float32).tolist()) for i in range(1200)]
    got, want = found(spark, rows, 10), brute(rows, 10)
    assert got.keys() == want.keys()
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits / sum(map(len, want.values())) >= 0.95


def test_a_least_cosine_over_many_cells(spark, monkeypatch):
    monkeypatch.setattr(N, "CELL_ROWS", (100, 400))
    rng = np.random.default_rng(3)
    base = rng.standard_normal((1500, 16))
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(np.r_[base, base[:600] + 0.12 * rng.standard_normal((600, 16))])]
    got, whole = found(spark, rows, 10, at_least=0.9), brute(rows, 10)
    want = {q: [x for x in near if x[1] >= 0.9] for q, near in whole.items()}
    pairs = lambda lists: {(q, i) for q, near in lists.items() for i, _ in near}
    assert got.keys() == want.keys() and pairs(got) <= pairs(want)
    assert len(pairs(got)) >= 0.99 * len(pairs(want)) > 500


def test_stated_queries_against_all_rows(spark, monkeypatch):
    monkeypatch.setattr(N, "CELL_ROWS", (100, 400))
    rng = np.random.default_rng(4)
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(rng.standard_normal((900, 8)))]
    rows += [(900 + i, rows[i][1]) for i in range(0, 900, 7)]
    asked = N.F.expr("vec_id % 50 = 0")
    df = spark.createDataFrame(rows, "id long, v array<float>")
    exact = {r["vec_id"]: [(x["id"], round(x["cosine"], 9)) for x in r["neighbours"]] for r in N.exact_neighbours(df, "id", "v", 10, asked, part_rows=200).collect()}
    want = {q: near for q, near in brute(rows, 10).items() if q % 50 == 0}
    got = found(spark, rows, 10, queries=asked)
    assert exact == want and got.keys() == want.keys()
    assert sum(len(set(got[q]) & set(want[q])) for q in want) >= 0.95 * 10 * len(want)


def test_a_direction_that_a_third_of_the_vectors_share(spark, monkeypatch):
    monkeypatch.setattr(N, "CELL_ROWS", (100, 400))
    rng = np.random.default_rng(6)
    one = rng.standard_normal(8)
    rows = [(i, (one * (1 + i)).astype(np.float32).tolist()) for i in range(400)] + [(400 + i, v.astype(np.float32).tolist()) for i, v in enumerate(rng.standard_normal((800, 8)))]
    got, want = found(spark, rows, 5, at_least=0.9), brute(rows, 5)
    for q in range(400):
        assert [round(c, 6) for _, c in got[q]] == [1.0] * 5
    assert sum(len({i for i, c in want[q] if c >= 0.9} - {i for i, _ in got[q]}) for q in range(400, 1200)) <= 5


def test_copies_ties_and_unusable_vectors(spark):
    a, b = [1.0, 2.0, 0.0, 0.0], [0.0, 0.0, 3.0, 1.0]
    rows = [(i, a) for i in range(40)] + [(50 + i, b) for i in range(3)] + [(60, None), (61, [0.0] * 4), (62, [float("nan"), 1.0, 1.0, 1.0]), (63, [None, 1.0, 1.0, 1.0]), (64, [float("inf"), 1.0, 1.0, 1.0]), (65, [-0.0, 0.0, 3.0, 1.0])]
    assert found(spark, rows, 5) == brute(rows, 5)


def test_different_norms(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((80, 8))
    rows = [(i, (v * 10.0 ** rng.integers(-15, 15)).astype(np.float32).tolist()) for i, v in enumerate(base)]
    assert {q: [i for i, _ in x] for q, x in found(spark, rows, 3).items()} == {q: [i for i, _ in x] for q, x in brute(rows, 3).items()}


def test_few_and_no_vectors(spark):
    assert found(spark, [], 5) == {}
    assert found(spark, [(1, [1.0, 0.0])], 5) == {1: []}


def test_chi_square_quantile():
    assert abs(N.chi_square_quantile(0.95, 8) - 15.507) < 1e-3 and abs(N.chi_square_quantile(0.99, 2) - 9.210) < 1e-3
