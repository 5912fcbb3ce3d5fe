import numpy as np
import pytest

from kinfold.llm import rp_forest

from .test_simhash import groups_of

SCHEMA = "vec_id long, embedding array<double>, label int, v int, rep string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1, "x") for i, v in rows], SCHEMA)


def brute(rows, threshold=0.95):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and len(v) and None not in v and np.isfinite(np.array(v, float)).all() and np.any(np.array(v, float))]
    x = [v / np.abs(v).max() for _, v in ok]
    x = [v / np.linalg.norm(v) for v in x]
    edges, deg = [], [0] * len(ok)
    for a in range(len(ok)):
        for b in range(a):
            if len(x[a]) == len(x[b]) and x[a] @ x[b] >= threshold:
                edges.append((ok[a][0], ok[b][0]))
                deg[a] += 1
                deg[b] += 1
    comp = groups_of({i for i, _ in ok}, [e for e in edges if e[0] != e[1]])
    return sorted((i, d, comp[i], comp[i] == i) for (i, _), d in zip(ok, deg, strict=True))


def clustered(n, dim, seed, noise=0.05, size=12):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dim))
    for c in range(0, n, 3 * size):
        x[c : c + size] = x[c] / np.linalg.norm(x[c]) + noise / np.sqrt(dim) * 3 * rng.standard_normal((min(size, n - c), dim))
    return x


def test_links_of_small_and_odd_vectors(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(1, v), (2, v), (2, v), (5, [2.0, 4.0, 6.01]), (6, [-1.0, 0.0, 0.0]), (7, None), (8, [0.0, 0.0, 0.0]), (9, [1.0, None, 2.0]), (10, [float("nan"), 1.0, 1.0]), (11, [float("inf"), 1.0, 1.0]), (12, []), (13, [1e-200, 2e-200, 3e-200]), (14, [1e200, 2e200, 3e200]), (15, [1.0, 2.0]), (None, v)]
    got = rp_forest.near_duplicates(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    linked = {(r.vec_id, r.n_links, r.component_id, r.kept) for r in got if r.n_links}
    assert linked == {(1, 5, 1, True), (2, 5, 1, False), (5, 5, 1, False), (13, 5, 1, False), (14, 5, 1, False)}
    lone = {r.vec_id for r in got if r.n_links == 0 and r.kept and r.component_id == r.vec_id}
    assert lone == {6, 7, 8, 9, 10, 11, 12, 15}
    assert [(r.component_id, r.kept) for r in got if r.vec_id is None] == [(None, False)]


@pytest.mark.parametrize("leaf", [64, 4096])
def test_equals_brute_force(spark, leaf):
    x = clustered(1500, 24, 4)
    rows = [(i, row.tolist()) for i, row in enumerate(x)] + [(2000 + i, x[5].tolist()) for i in range(40)]
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in rp_forest.near_duplicates(frame(spark, rows), leaf=leaf, sample=800).collect())
    want = brute(rows)
    found, there = sum(r[1] for r in got), sum(r[1] for r in want)
    assert found <= there and found >= 0.99 * there
    if leaf == 4096:
        assert got == want


def test_dense_group_is_counted_without_pairs(spark):
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.standard_normal((1, 16)) * 4 + 0.05 * rng.standard_normal((700, 16)), rng.standard_normal((700, 16))])
    rows = [(i, r.tolist()) for i, r in enumerate(x)]
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in rp_forest.near_duplicates(frame(spark, rows), leaf=64).collect())
    assert got == brute(rows)


def loose_group(rng, m, dim, cosine, centre=None):
    """Vectors whose mean pairwise cosine is about ``cosine``, around one centre."""
    c = rp_forest.unit(rng.standard_normal((1, dim)))[0] if centre is None else centre
    z = rng.standard_normal((m, dim))
    z = rp_forest.unit(z - np.outer(z @ c, c))
    return np.sqrt(cosine) * c + np.sqrt(1 - cosine) * z


def no_links(x):
    return rp_forest.Links(x[:0], np.zeros(0, np.int32), 0.95, 0)


def test_large_leaves_are_split_in_rounds_and_keep_their_links(spark):
    x = clustered(6000, 32, 12)
    rows = [(i, row.tolist()) for i, row in enumerate(x)]
    got = rp_forest.near_duplicates(frame(spark, rows), leaf=64, sample=128, most=400).collect()
    u = rp_forest.unit(x)
    there = int((u @ u.T >= 0.95).sum()) - len(u)
    found = sum(r.n_links for r in got)
    assert len(got) == 6000 and found <= there and found >= 0.97 * there


def placed_frame(spark, x, trees=2):
    schema = "rep long, copies long, k string, v array<double>, ball int, leaves array<long>"
    roots = [int(rp_forest.leaf_number(t, 1)[0]) for t in range(trees)]
    return spark.createDataFrame([(i, 1, str(i), row.tolist(), -1, roots) for i, row in enumerate(x)], schema), roots


def test_rounds_lose_no_row_and_end_with_small_leaves(spark):
    x = np.concatenate([np.random.default_rng(3).standard_normal((7000, 12)), [[1.0] * 12]])
    placed, roots = placed_frame(spark, x)
    out, sizes = rp_forest.refined(placed, 120, 500, 0.06, 0.999999)
    assert sizes.agg({"n": "max"}).first()[0] <= 500
    got = out.select("rep", "leaves").toPandas()
    assert sorted(got["rep"]) == list(range(7001))
    assert all(len(v) >= 2 and len(set(v)) == len(v) and not set(v) & set(roots) for v in got["leaves"])


def test_a_dense_leaf_and_one_without_sampled_rows_stay_whole(spark):
    rng = np.random.default_rng(5)
    x = rp_forest.unit(rng.standard_normal((300, 8)))
    d = rp_forest.directions(0, 0, 8)
    whole = rp_forest.bounds(x[:20], np.full(20, -1), d, 9, 0.06, 0.95)
    rows, child = rp_forest.descend(x, d, *[np.tile(c, (300, 1)) for c in whole])
    assert rows.tolist() == list(range(300)) and set(child.tolist()) == {0}
    dense = loose_group(rng, 900, 64, 0.957)
    assert not np.isfinite(rp_forest.bounds(dense, np.full(900, -1), rp_forest.directions(0, 0, 64), 9, 0.06, 0.95)[1][0])
    # In rounds it is left as one leaf, however large.
    placed, roots = placed_frame(spark, dense)
    out, sizes = rp_forest.refined(placed, 50, 100, 0.06, 0.95)
    assert {(r.leaf, r.n) for r in sizes.collect()} == {(i, 900) for i in roots}


@pytest.mark.parametrize("share", [0.002, 0.01, 0.05, 0.2, 0.3])
def test_recall_in_loose_groups_at_512_leaves(share):
    """Members of one loose group, as the production forest at 524,288 rows routes them."""
    rng, dim = np.random.default_rng(int(1000 * share)), 64
    c = rp_forest.unit(rng.standard_normal((1, dim)))[0]
    m = round(share * rp_forest.SAMPLE)
    x = np.concatenate([loose_group(rng, m, dim, 0.957, c), rp_forest.unit(rng.standard_normal((rp_forest.SAMPLE - m, dim)))])
    near = rp_forest.half_angle(0.95)
    links = rp_forest.Links(x, rp_forest.ball_of(x, rp_forest.dense_centres(x, near), near), 0.95, 1)
    group = loose_group(rng, 300, dim, 0.957, c)
    where = [set() for _ in group]
    for t in range(rp_forest.TREES):
        nodes = rp_forest.grow(x, 512, rp_forest.SPILL, rp_forest.SEED + t, links)
        for leaf, rows in rp_forest.route(group, nodes):
            for r in rows:
                where[r].add((t, leaf))
    i, j = np.nonzero(np.triu(group @ group.T >= 0.95, 1))
    assert len(i) > 10_000 and np.mean([bool(where[a] & where[b]) for a, b in zip(i, j, strict=True)]) >= 0.98


def test_loose_groups_are_counted_in_blocks_without_listing_pairs(spark, monkeypatch):
    """Two loose groups, one of near copies of each other's members, amid strangers; leaves, blocks and sample are far smaller than they."""
    rng, dim = np.random.default_rng(8), 32
    x = np.concatenate([loose_group(rng, 900, dim, 0.956), loose_group(rng, 300, dim, 0.96), loose_group(rng, 60, dim, 0.99), rng.standard_normal((1200, dim))])
    rows = [(i, r.tolist()) for i, r in enumerate(x[rng.permutation(len(x))])]
    rows += [(9000 + i, rows[3][1]) for i in range(5)]
    seen = []
    real = rp_forest.compared

    def spy(*a):
        out = real(*a)
        seen.append(out.count())
        return out

    monkeypatch.setattr(rp_forest, "compared", spy)
    df = frame(spark, rows)
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in rp_forest.near_duplicates(df, leaf=32, sample=600, block=128).collect())
    want = brute(rows)
    found, there = sum(r[1] for r in got), sum(r[1] for r in want)
    assert there > 400_000 and 0.99 * there <= found <= there
    assert all(a[1] <= b[1] for a, b in zip(got, want, strict=True))
    assert sum(a[2:] != b[2:] for a, b in zip(got, want, strict=True)) <= 0.01 * len(want)
    assert seen[0] < there / 8
    # The whole table in blocks gives every link.
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in rp_forest.near_duplicates(df, leaf=32, block=300, exact=True).collect()) == want


def test_a_link_counts_once_whatever_leaves_share_it():
    rng = np.random.default_rng(4)
    x = rp_forest.unit(loose_group(rng, 40, 16, 0.96))
    s = np.triu(x @ x.T >= 0.95, 1)
    copies = rng.integers(1, 4, 40)
    member = rng.random((5, 40)) < 0.7
    pad = -(1 << 63)
    total = np.zeros(40, np.int64)
    for number in range(5):
        rows = np.flatnonzero(member[number])
        leaves = np.array([[k if k < number and member[k, r] else pad for k in range(5)] for r in rows])
        degree, label = rp_forest.leaf_links(x[rows], copies[rows], np.full(len(rows), -1), leaves, None, 0.95, pad + 1)
        total[rows] += degree
        pairs = [(a, b) for a, b in zip(*np.nonzero(s[np.ix_(rows, rows)]), strict=True)]
        assert dict(enumerate(label.tolist())) == groups_of(range(len(rows)), pairs)
    want = np.zeros(40, np.int64)
    for a, b in zip(*np.nonzero(s), strict=True):
        if (member[:, a] & member[:, b]).any():
            want[a] += copies[b]
            want[b] += copies[a]
    assert total.tolist() == want.tolist()


def test_every_row_is_routed_and_leaves_shrink():
    x = rp_forest.unit(np.random.default_rng(2).standard_normal((4000, 16)))
    nodes = rp_forest.grow(x[:1000], 16, 0.06, 3, no_links(x))
    leaves = list(rp_forest.route(x, nodes))
    assert set(np.concatenate([r for _, r in leaves])) == set(range(4000))
    assert len(leaves) == 16 and max(len(r) for _, r in leaves) < 900


def test_recall_at_the_threshold():
    rng = np.random.default_rng(1)
    a = rp_forest.unit(rng.standard_normal((1500, 64)))
    n = rng.standard_normal(a.shape)
    n = rp_forest.unit(n - (n * a).sum(1, keepdims=True) * a)
    b = 0.951 * a + np.sqrt(1 - 0.951**2) * n
    crowd = rp_forest.unit(rng.standard_normal((20_000, 64)))
    missed = np.ones(len(a), bool)
    for t in range(rp_forest.TREES):
        nodes = rp_forest.grow(crowd[:8192], 23, rp_forest.SPILL, t, no_links(crowd))
        la, lb = ([set() for _ in a] for _ in range(2))
        for m, v in ((la, a), (lb, b)):
            for leaf, rows in rp_forest.route(v, nodes):
                for r in rows:
                    m[r].add(leaf)
        missed &= ~np.array([bool(p & q) for p, q in zip(la, lb, strict=True)])
    assert missed.mean() <= 0.001


def test_empty_table(spark):
    assert rp_forest.near_duplicates(frame(spark, [])).count() == 0
