import os

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quiverlake.llm import areas, chunks, clusters, fuse_ranks, leaks, neighbours, pairs, queries, subset, tokens
from quiverlake.llm.arrays import from_binary, live_embeddings, to_binary, unit, usable
from quiverlake.llm.words import words

DOC = "id string, precomputed_vector array<float>, received_at timestamp, batch_no bigint, vec string, score string"


def docs_frame(spark, rows):
    """(id, vector, second) -> a table with columns whose names clash with the operators' own."""
    import datetime as dt

    t0 = dt.datetime(2025, 1, 1)
    return spark.createDataFrame([(i, v, t0 + dt.timedelta(seconds=s), 0, "x", "y") for i, v, s in rows], DOC)


def grouped_embeddings(seed=0, n=240, dim=64, groups=12, noise=0.03):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(groups, dim))
    centers /= np.linalg.norm(centers, axis=1, keepdims=True)
    x = centers[rng.integers(0, groups, n)] + noise * rng.normal(size=(n, dim))
    x[: n // 5] = rng.normal(size=(n // 5, dim))
    return (x * rng.uniform(0.5, 12, (n, 1))).astype(np.float32)


@pytest.fixture(scope="module")
def vector_docs(spark):
    x = grouped_embeddings()
    rows = [(f"r{i:04d}", v.tolist(), 10) for i, v in enumerate(x)]
    rows += [(f"c{i:02d}", (x[100] * (1 + i % 3)).tolist(), 10) for i in range(20)]  # scaled copies
    rows += [("r0001", [0.0] * 64, 5), ("r0002", x[2].tolist(), 10), (None, x[3].tolist(), 1)]  # stale, repeated, no id
    rows += [("null", None, 1), ("short", [1.0] * 63, 1), ("zero", [0.0] * 64, 1), ("nan", [float("nan")] + [1.0] * 63, 1), ("late", x[0].tolist(), 1), ("late", None, 2)]
    return docs_frame(spark, rows)


def truth(df):
    """id -> unit vector of the live usable rows."""
    live = {}
    for r in df.collect():
        if r.id is not None and (r.id not in live or r.received_at > live[r.id].received_at):
            live[r.id] = r
    ok = {i: np.array(r.precomputed_vector, float) for i, r in live.items() if r.precomputed_vector is not None and len(r.precomputed_vector) == 64}
    return {i: v / np.linalg.norm(v) for i, v in ok.items() if np.isfinite(v).all() and (v != 0).any()}


def same_groups(vs, alike=0.84):
    ids = sorted(vs)
    m = np.array([vs[i] for i in ids])
    adj = np.round(m @ m.T, 6) >= alike
    label = {}
    for i in range(len(ids)):
        if i not in label:
            stack = [i]
            label[i] = i
            while stack:
                for j in np.flatnonzero(adj[stack.pop()]):
                    if j not in label:
                        label[j] = i
                        stack.append(j)
    return {ids[i]: ids[g] for i, g in label.items()}


# -- embeddings, neighbours, clusters ---------------------------------------------------------------------

def test_usable_and_bytes():
    import pyarrow as pa

    rows, x = usable(pa.array([[1.0, 2.0], None, [0.0, 0.0], [1.0], [None, 1.0], [3.0, 4.0]], pa.list_(pa.float32())), 2)
    assert rows.tolist() == [0, 5] and x.tolist() == [[1, 2], [3, 4]]
    assert from_binary(to_binary(x).slice(1), 2).tolist() == [[3, 4]]
    assert np.allclose(np.linalg.norm(unit(np.array([[1e-30, 0], [1e30, 1e30]], np.float32)), axis=1), 1)


@pytest.mark.parametrize(("dims", "bits"), [(2, 4), (3, 3), (4, 2)])
def test_hilbert_curve_visits_every_cell_by_single_steps(dims, bits):
    grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
    keys = neighbours.hilbert_keys(grid, bits)
    assert sorted(keys.tolist()) == list(range(len(grid)))
    path = grid[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_nearest_equals_brute_force(spark, vector_docs):
    vs = truth(vector_docs)
    found = {r.id: [(f.id, round(-f.s, 6)) for f in r.found] for r in neighbours.nearest_records(vector_docs, k=5, rows_per_part=100, block=64).collect()}
    assert set(found) == set(vs)
    hit = total = 0
    for i in vs:
        want = sorted(((-round(float(vs[i] @ vs[j]), 6), j) for j in vs if j != i))[:5]
        total += 5
        hit += len({j for _, j in want} & {j for j, _ in found[i]})
        assert found[i] == sorted(found[i], key=lambda f: (-f[1], f[0])) and i not in [j for j, _ in found[i]]
    assert hit / total >= 0.9
    copies = sorted([f"c{i:02d}" for i in range(20)] + ["r0100"])
    assert [j for j, _ in found["c19"]] == copies[:5]  # ties: the smaller ids


def test_nearest_inside_a_large_dense_group(spark):
    """A third of the rows are one group with even noise, far longer than the window and the stretches."""
    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(size=64) + 0.2 * rng.normal(size=(6000, 64)), rng.normal(size=(12000, 64))]).astype(np.float32)
    x[6:600:3] = x[3] * 2  # copies inside the group
    ids = np.array([f"r{i:05d}" for i in rng.permutation(len(x))])
    df = spark.createDataFrame([(i, v.tobytes()) for i, v in zip(ids, x)], "id string, vec binary")
    found = {r.id: [f.id for f in r.found] for r in neighbours.nearest(df, fit=x[::2], total=len(x), dim=64, floor=0.84, rows_per_part=4000, block=64).collect()}
    assert sum(len(c) > 1 for c in neighbours.DenseGroups(x[::2], len(x), 128, 1000).chunks) == 1
    u = unit(x)[:6000]
    s = np.round(u @ u.T, 6)
    np.fill_diagonal(s, -1)
    hit = sum(len({ids[j] for j in np.lexsort((ids[:6000], -s[i]))[:5]} & set(found[ids[i]])) for i in range(0, 6000, 7))
    assert hit / (5 * len(range(0, 6000, 7))) >= 0.99


@pytest.mark.parametrize("rows", [300, 700, 5000])
def test_cells_of_a_dense_group_hold_every_pair_once(rows):
    rng = np.random.default_rng(4)
    u = unit(rng.normal(size=64) + 0.2 * rng.normal(size=(2000, 64)))
    g = neighbours.DenseGroups(u, len(u), 1000, rows)
    met = np.zeros((2000, 2000), int)
    for cell in range(len(g.cells)):
        at = np.concatenate([r for c, r, _ in g.place(u) if c == cell])
        chunk = np.concatenate([neighbours.chunk_of(k, g.cells[cell]) for c, _, k in g.place(u) if c == cell])
        met[np.ix_(at, at)] += (chunk[:, None] != chunk) | np.isin(chunk, list(g.owned[cell]))
    assert (met == 1).all()


def test_nearest_in_full(spark, vector_docs, monkeypatch):
    monkeypatch.setattr(neighbours.DenseGroups.everything.__func__, "__defaults__", (64,))  # several chunks
    vs = truth(vector_docs)
    ids = sorted(vs)
    m = np.round(np.array([vs[i] for i in ids]) @ np.array([vs[i] for i in ids]).T, 6)
    np.fill_diagonal(m, -2)
    want = {i: [ids[j] for j in np.lexsort((ids, -m[a]))[:5]] for a, i in enumerate(ids)}
    got = {r.id: [f.id for f in r.found] for r in neighbours.nearest_records(vector_docs, exact=True).collect()}
    assert got == want


def alike_groups(rng, sizes, alone, noise=0.2):
    x = np.vstack([rng.normal(size=64) + noise * rng.normal(size=(n, 64)) for n in sizes] + [rng.normal(size=(alone, 64))])
    return x[rng.permutation(len(x))].astype(np.float32)


def test_nearest_among_many_groups_the_sample_hardly_sees(spark):
    """Groups of every size, most with few rows in the sample or none: all true pairs come out, and no others."""
    rng = np.random.default_rng(8)
    x = alike_groups(rng, [3000, *[400] * 12, *[60] * 80, *[6] * 400], 5000)
    ids = np.array([f"r{i:05d}" for i in rng.permutation(len(x))])
    df = spark.createDataFrame([(i, v.tobytes()) for i, v in zip(ids, x)], "id string, vec binary")
    found = neighbours.nearest(df, fit=x[rng.choice(len(x), 1000, replace=False)], total=len(x), dim=64, floor=0.84, rows_per_part=2000, block=64)
    got = {(r.id_a, r.id_b) for r in neighbours.similar_pairs(found).collect()}
    u, by_id = unit(x), np.argsort(np.argsort(ids))
    s = np.round(u @ u.T, 6)
    np.fill_diagonal(s, -1)
    want = set()
    for i in range(len(x)):
        near = np.flatnonzero(s[i] >= 0.84)
        want |= {tuple(sorted((ids[i], ids[j]))) for j in near[np.lexsort((by_id[near], -s[i, near]))[:5]]}
    assert len(got & want) >= 0.998 * len(want) and len(got & want) >= 0.998 * len(got)


def test_rows_near_a_centre_meet_all_alike_in_cells():
    rng = np.random.default_rng(9)
    u = unit(np.vstack([alike_groups(rng, [900, *[30] * 20, *[4] * 50], 300), (np.eye(64)[0] + np.linspace(0, 3, 200)[:, None] * np.eye(64)[1]).astype(np.float32)]))  # the last are a chain
    g = neighbours.Cells(u[::3].astype(np.float32), len(u), 0.84, rows_per_center=20, whole=100, rows=200, most_rows=200, copies=1e-3)
    rows, cell, keys = g.place_all(u)
    met = np.zeros((len(u), len(u)), int)
    for c in range(len(g.cells)):
        at, chunk = rows[cell == c], neighbours.chunk_of(keys[cell == c], g.cells[c])
        met[np.ix_(at, at)] += (chunk[:, None] != chunk) | np.isin(chunk, list(g.owned[c]))
    settled = (u @ g.centers.T).max(axis=1) >= 0.9
    assert len(g.cells) > len(g.centers) > 20 and 900 < settled.sum() < len(u)
    assert (met[settled] > 0)[(u @ u.T >= 0.84)[settled]].all()
    assert (np.bincount(rows, minlength=len(u)) > 0).all() and g.tasks.max() < g.n_tasks


@pytest.mark.parametrize("axis", [0, 1])
def test_candidates_under_a_floor_of_each_line(axis):
    s = np.random.default_rng(10).uniform(-1, 1, (301, 335) if axis == 1 else (335, 301)).astype(np.float32)
    lines = s if axis == 1 else s.T
    floor = np.where(np.arange(301) % 3 == 0, np.float32(0.999), np.float32(-1))
    got = set(zip(*(x.tolist() for x in neighbours._block_candidates(s, 5, floor, axis))))
    for i, line in enumerate(lines):
        assert {(i, j) for j in np.argsort(-line)[:5].tolist() if line[j] >= floor[i]} <= got
    assert all(lines[i, j] >= floor[i] for i, j in got) and len(got) < 301 * 60


def test_nearest_floor_pairs_and_empty(spark, vector_docs):
    vs = truth(vector_docs)
    got = {(r.id_a, r.id_b) for r in neighbours.similar_pairs(neighbours.nearest_records(vector_docs, floor=0.84)).collect()}
    assert got and all(a < b and round(float(vs[a] @ vs[b]), 6) >= 0.84 for a, b in got)
    assert neighbours.nearest_records(vector_docs.limit(0)).count() == 0
    assert neighbours.nearest_records(docs_frame(spark, [("a", [1.0] * 64, 1)])).count() == 0


def test_groups_equal_brute_force(spark, vector_docs):
    want = same_groups(truth(vector_docs))
    sizes = {}
    for g in want.values():
        sizes[g] = sizes.get(g, 0) + 1
    points = clusters.live_points(vector_docs)
    got = {r.id: r.cluster_id for r in clusters.similarity_groups(points, dim=64, at_least=5, rows_per_cell=40).collect()}
    assert got == {i: g for i, g in want.items() if sizes[g] >= 5}
    about = clusters.describe_groups(clusters.similarity_groups(points, dim=64, at_least=5), points, dim=64).collect()
    assert {r.cluster_id: r["size"] for r in about} == {g: n for g, n in sizes.items() if n >= 5} and all(len(r.typical) == 3 for r in about)


def members(groups):
    return {r.id: r.cluster_id for r in groups.collect()}


def test_groups_in_a_tree_of_cells_cut_again_and_exact(spark, vector_docs, monkeypatch):
    want = same_groups(truth(vector_docs))
    sizes = {g: list(want.values()).count(g) for g in want.values()}
    want = {i: g for i, g in want.items() if sizes[g] >= 5}
    points = clusters.live_points(vector_docs)
    assert members(clusters.similarity_groups(points, dim=64, at_least=5, exact=True)) == want
    assert members(clusters.similarity_groups(points, dim=64, at_least=5, rows_per_cell=150, most_rows=50)) == want
    tree = clusters.cell_tree(points, dim=64, total=240, rows_per_cell=20, most_flat=4)
    assert tree.leaves is not None and sum(len(x) for _, x in tree.leaves) >= 8
    u = unit(np.array([v for v in truth(vector_docs).values()]).astype(np.float32)).astype(np.float32)
    near = tree.nearest(u, 3)
    x = np.concatenate([x for _, x in tree.leaves])[np.argsort(np.concatenate([n for n, _ in tree.leaves]))]
    assert (near[:, 0] == (u @ x.T).argmax(axis=1)).mean() > 0.9


def test_lloyd_steps_lower_the_cost(spark, vector_docs):
    points = clusters.live_points(vector_docs)
    u = unit(np.array(list(truth(vector_docs).values())).astype(np.float32)).astype(np.float32)
    cost = [float((1 - (u @ clusters.kmeans_centroids(points, dim=64, k=8, steps=n)[0].T).max(axis=1)).sum()) for n in (0, 3)]
    assert cost[1] < cost[0]


def test_groups_of_texts(spark):
    rows = [(f"t{i}", f"the quick brown fox jumps over the lazy dog near river {i % 2} {'again ' * (i % 3)}") for i in range(6)] + [("u", "completely different words about bread and butter"), ("e", ""), ("n", None)]
    points = clusters.text_points(spark.createDataFrame([(*r, "x") for r in rows], "id string, text string, vec string")).cache()
    assert {r.id for r in points.collect()} == {r[0] for r in rows} - {"e", "n"}
    got = members(clusters.similarity_groups(points, dim=256, alike=0.5))
    assert set(got) == {f"t{i}" for i in range(6)} and set(got.values()) == {"t0"}


def test_groups_of_nothing(spark, vector_docs):
    points = clusters.live_points(vector_docs.limit(0))
    assert clusters.similarity_groups(points, dim=64).count() == 0


@pytest.mark.parametrize("limit", [10, 60, 100_000])
def test_link_cell_paths_agree(monkeypatch, limit):
    monkeypatch.setattr(clusters, "SPLIT_ABOVE", limit)
    x = grouped_embeddings(4, 300)
    chain = np.array([[np.cos(a), np.sin(a)] + [0] * 62 for a in np.arange(0, 3, 0.5)])  # linked only through others
    u = unit(np.vstack([x, chain]).astype(np.float32))
    labels = clusters.link_cell(u, 0.84, np.random.default_rng(0))
    want = same_groups({f"{i:04d}": v for i, v in enumerate(u)})
    names = {}
    for i, label in enumerate(labels):
        names.setdefault(label, []).append(f"{i:04d}")
    assert {i: min(g) for g in names.values() for i in g} == want


def test_hashed_features():
    x = clusters.hashed_features(["a b", "B a", None, ""])
    assert np.allclose(x[0], x[1]) and not x[2:].any()


# -- subset -----------------------------------------------------------------------------------------------

def hits_frame(spark, rows):
    return spark.createDataFrame(rows, "qid string, id string, score double, vec binary, text string")


@pytest.mark.parametrize("part_rows", [10_000, 30])
def test_subset_takes_the_best_of_every_theme(spark, part_rows):
    x = grouped_embeddings(5, 200)
    rng = np.random.default_rng(0)
    score = rng.random(200).round(2)  # with ties
    score[::17] = np.nan
    rows = [("q", f"h{i:03d}", float(score[i]), x[i].tobytes(), "t") for i in range(200)]
    u = unit(x)
    want = {}
    for i, g in same_groups({f"h{i:03d}": u[i] for i in range(200)}).items():
        s = score[int(i[1:])]
        key = (-(s if s == s else -9), i)
        want[g] = min(want.get(g, key), key)
    n = len(want)
    sizes = spark.createDataFrame([("q", n), ("none", 3), ("zero", 0), (None, 2)], "qid string, subset_size int")
    got = subset.varied_subset(hits_frame(spark, [*rows, ("monitor", "h", 0.5, x[0].tobytes(), "")]), sizes, part_rows=part_rows, one_per_theme=True)
    assert {r.id for r in got.collect()} == {i for _, i in want.values()}
    assert subset.varied_subset(hits_frame(spark, rows), sizes.limit(0)).count() == 0


def test_subset_finds_a_chained_theme_over_all_parts(spark):
    """Neighbours of the chain are alike, all others are not, and they lie in different parts."""
    turns = np.deg2rad(30 * np.arange(60))
    x = np.zeros((80, 64))
    for i, t in enumerate(turns):
        at, t = divmod(t + 1e-9, np.pi / 2)
        x[i, int(at)], x[i, int(at) + 1] = np.cos(t), np.sin(t)
    x[60:70, 40] = x[70:, 50] = 1
    x += 0.002 * np.random.default_rng(6).normal(size=x.shape)
    score = np.random.default_rng(7).permutation(80) / 80
    score[:60] += 1  # a splinter of the chain outscores the other themes
    want = {f"h{a + int(score[a:b].argmax()):03d}" for a, b in ((0, 60), (60, 70), (70, 80))}
    rows = [(q, f"h{i:03d}", float(score[i]), x[i].astype(np.float32).tobytes(), "t") for q in ("q", "r") for i in range(80)]
    rows += [("few", f"h{i:03d}", 1.0, x[0].astype(np.float32).tobytes(), "t") for i in range(4)]
    sizes = spark.createDataFrame([("q", 3), ("r", 3), ("few", 3)], "qid string, subset_size int")
    for part_rows in (8, 1000):
        got = subset.varied_subset(hits_frame(spark, rows), sizes, part_rows=part_rows, one_per_theme=True).collect()
        assert sorted((r.qid, r.id) for r in got) == sorted([("few", "h000"), *[(q, i) for q in ("q", "r") for i in want]])
        assert sorted(r.place for r in got if r.qid == "q") == [1, 2, 3]


@pytest.mark.parametrize("n", [20_000])
def test_a_large_query_gives_the_same_with_and_without_parts(spark, n):
    x = grouped_embeddings(11, n, groups=9, noise=0.02)[n // 5 :]
    score = np.random.default_rng(12).permutation(len(x)) / len(x)
    hits = spark.createDataFrame([("q", f"h{i:05d}", float(score[i]), x[i].tobytes()) for i in range(len(x))], "qid string, id string, score double, vec binary")
    sizes = spark.createDataFrame([("q", 9)], "qid string, subset_size int")
    cut, whole = ({r.id for r in subset.varied_subset(hits, sizes, part_rows=m, one_per_theme=True).collect()} for m in (4096, 100_000))
    assert cut == whole and len(whole) == 9
    for m in (4096, 100_000):  # and by determinants alone every theme is shown
        at = [int(r.id[1:]) for r in subset.varied_subset(hits, sizes, part_rows=m).collect()]
        s = unit(x[at]) @ unit(x[at]).T
        assert len(at) == 9 and (s - np.eye(9)).max() < 0.84


def test_greedy_map_matches_determinants():
    rng = np.random.default_rng(1)
    u = unit(rng.normal(size=(12, 5)).astype(np.float32))
    q = rng.uniform(1, 1.7, 12)
    k = np.outer(q, q) * ((1 - subset.RIDGE) * (u @ u.T) + subset.RIDGE * np.eye(12))
    picked = []
    for _ in range(8):
        picked.append(max((j for j in range(12) if j not in picked), key=lambda j: np.linalg.det(k[np.ix_([*picked, j], [*picked, j])])))
    assert [j for j, _ in zip(subset.greedy_map(q, u), range(8))] == picked
    assert sorted(subset.greedy_map(q, u)) == list(range(12))


def test_hits_take_the_live_vector(spark):
    docs = docs_frame(spark, [("a", [1.0] * 64, 1), ("a", [2.0] * 64, 2), ("b", None, 1)])
    hits = spark.createDataFrame([("q", "a", float("nan"), None), ("q", "a", 0.5, None), ("q", "b", 0.4, None), ("q", "c", 0.3, [3.0] * 64), (None, "a", 1.0, None)], "qid string, id string, score double, vector array<float>")
    got = {r.id: (r.score, from_binary(__import__("pyarrow").array([bytes(r.vec)]), 64)[0, 0]) for r in subset.hits_with_embeddings(hits, docs).collect()}
    assert got == {"a": (0.5, 2.0), "c": (0.3, 3.0)}


# -- chunks -------------------------------------------------------------------------------------------------

texts = st.text(alphabet="ab .\n\t。é", max_size=400) | st.text(alphabet="ab ", min_size=50, max_size=300)


@settings(max_examples=300, deadline=None)
@given(texts, st.integers(8, 60), st.integers(0, 7))
def test_pieces(text, most, overlap):
    if len(text) <= most:
        return
    out = chunks.cut_points(text, most, overlap)
    assert out[0][0] == 0 and out[-1][1] == len(text)
    assert all(0 < b - a <= most for a, b, _ in out)
    longest = max(map(len, __import__("re").split("[ \t\r\n。！？]", text)))
    for (_, end, forced), (start, nxt, _) in zip(out, out[1:]):
        assert start <= end < nxt and end - start <= overlap
        natural = any(c in " \t\r\n。！？" for c in text[end - 1 : end + 1])
        assert forced == (not natural)
        if longest <= most - overlap:
            assert end - start == overlap
    assert any(f for _, _, f in out) == (longest > most)


def test_an_edit_moves_only_near_cuts():
    rng = np.random.default_rng(0)
    text = " ".join("".join(rng.choice(list("abcdefgh"), rng.integers(2, 9))) for _ in range(6000))
    cut = lambda t: {t[a:b] for a, b, _ in chunks.cut_points(t, 1000, 100)}
    before, after = cut(text), cut(text[:9000] + "inserted words here " + text[9000:])
    assert len(before - after) <= 4


def test_oversized(spark):
    limits = spark.createDataFrame([("text/plain", 10, 2), ("*/*", 20, 2)], "mime string, max_chars int, overlap_chars int")
    rows = [
        ("s", "long", "Text/Plain; charset=x", "word " * 5, 2, 0), ("s", "long", "text/plain", "short", 1, 0), ("s", "short", "text/plain", "word", 1, 0),
        ("s", "stale", None, "x" * 50, 1, 0), ("s", "stale", None, None, 2, 0), ("s", "forced", "unknown/type", "y" * 50, 1, 0), ("s", "forced", "unknown/type", "y" * 50, 1, 0),
        ("s", "other", None, "word " * 3, 1, 0), (None, None, None, "z" * 99, 1, 0), ("s", "empty", "", "", 1, 0),
    ]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "source string, id string, mime string, text string, version int, tie int, most string")
    p = chunks.oversized_pieces(df, limits)
    assert {tuple(r) for r in chunks.cut_kinds(p).collect()} == {("long", "natural"), ("forced", "forced")}
    assert chunks.oversized_pieces(df.limit(0), limits).count() == 0
    assert chunks.oversized_pieces(df, limits.limit(0)).count() == 0


def test_a_very_long_text():
    out = chunks.cut_points("abc def. " * 200_000, 1200, 120)
    assert len(out) > 1500 and not any(f for _, _, f in out)


# -- ranks --------------------------------------------------------------------------------------------------

def test_borda(spark):
    s = [("q", "a", i, v) for i, v in (("x", 9.0), ("y", 9.0), ("z", None), ("w", float("nan")))] + [("q", "b", "x", -1000.0), ("q", "b", "z", -2.0), ("q", "b", "z", -5.0), ("m", "a", "x", 1.0), (None, "a", "x", 1.0)]
    scores = spark.createDataFrame([(*r, 1) for r in s], "qid string, list string, id string, score double, n_ids int").drop("n_ids")
    top = spark.createDataFrame([("q", 4), ("q", 4), ("m", None), ("gone", 2)], "qid string, top_n int")
    got = {r.id: (r.points, r.place) for r in fuse_ranks.borda(scores, top).collect()}
    # list a: x and y share 1.5, z and w the rest 3.5; list b: z 1, x 2, y and w the rest 3.5
    assert got == {"x": (3.5, 1), "z": (2.5, 2), "y": (2.0, 3), "w": (0.0, 4)}
    got = {r.id: r.points for r in fuse_ranks.borda(scores, top, weights={"b": 2.0}).collect()}
    assert got["z"] == 5.0 and got["x"] == 5.0
    assert fuse_ranks.borda(scores.limit(0), top).count() == 0


def test_latest_runs(spark):
    import datetime as dt

    t = dt.datetime(2025, 1, 1)
    l = spark.createDataFrame([(1, "q", "r", "a", 1.0, t), (2, "q", "r", "b", 2.0, t + dt.timedelta(1)), (3, "q", None, "c", 1.0, t)], "list_id int, qid string, retriever string, id string, score float, ran_at timestamp")  # noqa: E741
    assert [r.id for r in fuse_ranks.latest_runs(l).collect()] == ["b"]


# -- pairs --------------------------------------------------------------------------------------------------

Q = "How do I open the gate before the bell rings?"


@pytest.mark.parametrize(("prompt", "answer", "want"), [
    (Q, None, ["empty"]), (Q, " ​\n", ["empty"]), (Q, "**N/A**", ["empty"]), (Q, "<p> </p>", ["empty"]), (Q, "```\n```", ["empty"]), (Q, "…", ["empty"]), ("How many?", "0", []), ("How many?", "**42**", []),
    (Q, Q.upper(), ["copy"]), (Q, "> " + Q, ["copy"]), (Q, f"{Q}\n{Q}", ["copy"]), (Q, "You asked: " + Q, ["copy"]), ("Context:\nThe gate is old.\n\nQuestion: " + Q, Q, ["copy"]), (Q, Q.replace("gate", "gatte"), ["copy"]),
    (Q, Q + " Turn the key twice and pull.", []),
    (Q, "I'm sorry, but I can’t help with that.", ["refusal"]), (Q, "Thank you for asking, but this falls outside of what I may talk about. Is there anything else?", ["refusal"]),
    ("Wie geht das mit dem Tor auf?", "Das muss ich ablehnen. Bitte wende dich an eine Fachperson.", ["refusal"]), ("¿Cómo se abre la puerta de la casa?", "No puedo ayudarte con eso. ¿Hay otra cosa en que pueda ayudar?", ["refusal"]),
    ("Comment ouvrir la porte de la maison ?", "Il ne m’est pas permis de répondre à cette demande.", ["refusal"]),
    (Q, 'A client that sees "I can\'t help with that" has the wrong key; turn it and ask again.', []), (Q, "Sorry for the confusion earlier. Turn the key twice and pull.", []),
    (Q, "Man sieht, dass das Tor nach der Pause wieder offen ist, und die Glocke bleibt ruhig.", ["other_language"]), ("Translate this into German: The gate is open.", "Das Tor ist nach der Pause wieder offen, und es bleibt so.", []),
    (Q, "処理が終わるまで待つと、結果が見えるようになります。", ["other_language"]),
    (Q, "Turn the key twice and then pull the", ["truncated"]), (Q, "Turn the key.\n\n```java\nint a = 1;", ["truncated"]), (Q, "There are 3 points to keep in mind:\n1. Turn the key.\n2. Pull the gate.", ["truncated"]),
    (Q, "Turn the key twice (not once.", ["truncated"]), (Q, "Turn the key twice.\n- key\n- gate", []), (Q, "```java\nint a = 1;\n```", []), (Q, "Turn the key. 🙂", []), (Q, "Turn the key.\n\nhttp://docs.example/page/1", []),
    (None, "Turn the key twice.", []), ("", "", ["empty"]),
])
def test_defects(prompt, answer, want):
    assert pairs.defects(prompt, answer) == want


def test_a_long_prompt_given_back_with_slips_is_a_copy():
    rng = np.random.default_rng(8)
    text = lambda: " ".join("".join(rng.choice(list("abcdefghijklmnop"), rng.integers(2, 9))) for _ in range(2000))
    prompt = text()
    slips = list(prompt)
    for i in range(0, len(slips), 150):
        slips[i] = "z"
    assert len(prompt) > 8000 and pairs.is_copy(prompt, "".join(slips)) and not pairs.is_copy(prompt, text())
    assert pairs._in_common("abcbdab", "bdcaba") == 4


def test_defects_come_in_the_order_of_the_rules():
    """The dealt method emits every triggered defect; p6_found takes the first."""
    assert pairs.defects("How do I bake bread?", "I cannot help with that because the") == ["refusal", "truncated"]


def test_session_pairs(spark):
    import datetime as dt

    t = dt.datetime(2025, 1, 1)
    rows = [("s", f"m{n}", role, text, t + dt.timedelta(minutes=m)) for n, (m, role, text) in enumerate([(50, "ASSISTANT", "late"), (0, "USER", "one"), (1, "USER", "two"), (2, "ASSISTANT", "a"), (300, "ASSISTANT", "b"), (301, "USER", "open")])]
    rows += [rows[0], ("t", "x", "ASSISTANT", "alone", t), (None, "y", "USER", "u", t), ("s", None, "USER", "u", t), ("s", "z", "USER", "u", None)]
    m = spark.createDataFrame([(*r, "k") for r in rows], "session_id string, id string, role string, content string, sent_at timestamp, slice string").drop("slice")
    for seconds in (60, 3600, 10**9):
        got = {r.pair_key: (r.prompt, r.answer) for r in pairs.session_pairs(m, slice_seconds=seconds).collect()}
        assert got == {"m0": ("two", "late"), "m3": ("two", "a"), "m4": ("two", "b")}
    assert pairs.session_pairs(m.limit(0)).count() == 0


# -- tokens ---------------------------------------------------------------------------------------------------

needs_vocabulary = pytest.mark.skipif(not os.path.exists(tokens.VOCABULARY), reason="no vocabulary")


@pytest.fixture(scope="module")
def encoding():
    import base64

    import tiktoken

    with open(tokens.VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tokens.PairTable(ranks), tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={}), {v: k for k, v in ranks.items()}


@needs_vocabulary
@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet="aA b'sé=\n0", max_size=120))
def test_tokens_equal_a_public_encoder(encoding, text):
    import regex

    table, public, back = encoding
    ids = [i for w in table.encode_words([w.encode() for w in regex.findall(tokens.PATTERN, text)]) for i in w] if text else []
    assert ids == public.encode_ordinary(text)
    assert b"".join(back[i] for i in ids).decode() == text


@needs_vocabulary
def test_tokens_column(spark, encoding):
    texts = ["", None, "<|endoftext|>", "a" * 5000, "नमस्ते  \r\n", "same", "same"]
    df = spark.createDataFrame([(i, t, [9]) for i, t in enumerate(texts)], "doc_id bigint, text string, ids array<int>")
    got = {r.doc_id: list(r.ids) for r in tokens.encode(df).collect()}
    assert got == {i: encoding[1].encode_ordinary(t) if t else [] for i, t in enumerate(texts)}
    assert tokens.encode(df.limit(0)).count() == 0


# written apart from the tables and the rules; before the folding of Japanese, Korean and Turkish patterns 36 of the 41 were found
REFUSED = [
    "I'm sorry, but I can't help with that request.",
    "I won't be able to assist with this. You should talk to a qualified professional.",
    'Unfortunately, I am not comfortable providing that information.',
    "No, I won't write that.",
    "That's something I must decline.",
    'Das kann ich leider nicht beantworten.',
    'Es tut mir leid, dabei kann ich nicht behilflich sein.',
    'Ich bin nicht befugt, darüber Auskunft zu geben.',
    'Je suis désolé, mais je ne peux pas vous aider avec cette demande.',
    "Il m'est impossible de répondre à cette question.",
    'Je regrette, nous ne pouvons pas traiter cette demande.',
    'Lo siento, pero no puedo ayudarte con eso.',
    'No me es posible proporcionar esa información.',
    'No estoy autorizada a responder a esa pregunta.',
    'Desculpe, mas não posso ajudar com isso.',
    'Infelizmente não consigo responder a essa pergunta.',
    'Tenho de recusar este pedido.',
    'Mi dispiace, ma non posso aiutarti con questa richiesta.',
    'Non sono in grado di rispondere a questa domanda.',
    'Devo rifiutare questa richiesta.',
    'Sorry, daar kan ik je niet mee helpen.',
    'Ik mag deze vraag niet beantwoorden.',
    'Het spijt me, ik kan geen antwoord geven op deze vraag.',
    'К сожалению, я не могу помочь с этим запросом.',
    'Извините, но я не могу ответить на этот вопрос.',
    'Я вынужден отказаться от ответа.',
    '申し訳ありませんが、そのご質問にはお答えできません。',
    'すみません、その件については回答を控えさせていただきます。',
    '恐れ入りますが、お手伝いできません。',
    'Przykro mi, ale nie mogę pomóc w tej sprawie.',
    'Niestety nie jestem w stanie odpowiedzieć na to pytanie.',
    'Muszę odmówić odpowiedzi.',
    '抱歉，我无法回答这个问题。',
    '对不起，我不能提供这方面的帮助。',
    '很抱歉，我只能拒绝这个请求。',
    'Tyvärr kan jag inte hjälpa till med det.',
    'Jag måste avböja den här frågan.',
    '죄송하지만 그 요청은 도와드릴 수 없습니다.',
    '죄송합니다. 그 질문에는 답변할 수 없습니다.',
    'عذرًا، لا أستطيع مساعدتك في هذا الطلب.',
    'Üzgünüm, bu konuda yardımcı olamam.',
]
ANSWERED = [
    "You can't reset the counter from the menu, but a restart clears it.",
    "I'm sorry for the delay. The invoice was sent on Monday.",
    "The server won't start because the port is taken.",
    'Der Zug kann heute nicht fahren, weil die Strecke gesperrt ist.',
    "Le magasin n'ouvre pas le dimanche.",
    'No hay trenes después de las once.',
    'Il negozio non apre prima delle nove.',
    'De winkel is vandaag niet open.',
    'Магазин не работает по воскресеньям.',
    'この店は日曜日には開いていません。',
    'Nie ma pociągu po północy.',
    '这家商店星期天不营业。',
    'Butiken är inte öppen på söndagar.',
    '이 가게는 일요일에 열지 않습니다.',
    'O comboio não chega antes das dez.',
]


def test_refusals_in_other_languages():
    assert [r for r in REFUSED if pairs.is_refusal(r)] == REFUSED
    assert [a for a in ANSWERED if pairs.is_refusal(a)] == []


def test_every_triggered_defect():
    assert pairs.defects("Pourquoi le serveur est-il lent ?", "Je suis désolé, je ne peux pas vous aider avec") == ["refusal", "truncated"]
    assert pairs.defects("Why does the old server need so long to answer?", "Es tut mir leid, dabei kann ich nicht helfen.") == ["refusal", "other_language"]
    assert pairs.defects("x", None) == ["empty"]


# -- leaks ------------------------------------------------------------------------------------------------------

def test_words():
    assert words("<b>Café</b>s Ｆｕｌｌ wi​dth har-\n> bour &amp; so­ft [x](http://y) ß") == ["cafes", "full", "width", "harbour", "soft", "x", "ss"]
    assert words(None) == words("") == words("… ;") == []


def test_leaks(spark):
    rng = np.random.default_rng(0)
    vocabulary = [f"w{i}" for i in range(400)]
    item = {f"e{k}": [vocabulary[i] for i in rng.integers(0, 400, n)] for k, n in enumerate((9, 10, 30, 80))}
    item["twin"] = item["e2"][5:20]
    noise = lambda n: [f"n{i}" for i in rng.integers(0, 5000, n)]
    texts = {}
    for d in range(60):
        k = ["e1", "e2", "e3"][d % 3]
        w = item[k]
        a = int(rng.integers(0, len(w) - 9))
        length = 9 if d % 4 == 0 else int(rng.integers(10, len(w) - a + 1))
        texts[d] = " ".join([*noise(int(rng.integers(0, 700))), *[x.upper() for x in w[a : a + length]], *noise(int(rng.integers(0, 90)))])
    texts[100] = None
    texts[101] = ""
    texts[102] = " ".join(item["e3"]) * 3
    texts[103] = " ".join(noise(60_000) + item["e1"] + noise(10))
    want = set()
    for d, t in texts.items():
        w = words(t)
        runs = {tuple(w[i : i + 10]) for i in range(len(w) - 9)}
        want |= {(d, k) for k, x in item.items() if any(tuple(x[i : i + 10]) in runs for i in range(len(x) - 9))}
    docs = spark.createDataFrame([(d, t, "clash") for d, t in texts.items()] + [(0, texts[0], "clash")], "doc_id bigint, text string, item_id string")
    items = spark.createDataFrame([(k, " ".join(w)) for k, w in item.items()] + [("none", None), (None, "a b")], "item_id string, text string")
    assert {tuple(r) for r in leaks.leaked_items(docs, items).collect()} == want and len(want) > 40
    assert {tuple(r) for r in leaks.leaked_items(docs, items, items_per_pass=2).collect()} == want
    assert leaks.leaked_items(docs, items.limit(0)).count() == 0 and leaks.leaked_items(docs.limit(0), items).count() == 0


# -- areas --------------------------------------------------------------------------------------------------------

def test_units():
    t = "# Quantizer\nThe quantizer is\n> small. A broth!  - x\n- the broth is warm\n* a whisk\n\n| broth | whisk |\n```\nbroth\n```\nEnd"
    assert list(areas.units(t)) == ["The quantizer is small.", "A broth!", "- x", "- the broth is warm", "* a whisk", "End"] or len(list(areas.units(t))) == 6


def test_areas(spark):
    law = "The indemnity was early. We read the licence clause. An injunction followed. The weather was nice."
    rows = [(1, law), (2, law.replace("indemnity", "weather")), (3, None), (4, ""), (5, law + " The broth was thin. A whisk broke. Olive oil helps."), (6, "The ball is in our court now. It was a race against time. We will cook something up."), (1, law)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, area string")
    got = areas.subject_areas(docs)
    assert sorted((r.doc_id, r.area) for r in got.collect()) == [(1, "law"), (1, "law"), (5, "food"), (5, "law")]
    assert areas.subject_areas(docs.limit(0)).count() == 0
    assert {r.area: r.n_docs for r in areas.area_shares(got, docs).collect()} == {"law": 2, "food": 1}


def test_area_accuracy_on_labelled_documents(spark):
    d = "/root/testdata/sf0.01"
    got = areas.calibrate(queries.table(spark, d, "documents"), queries.table(spark, d, "area_labels"), grid=(areas.THRESHOLD,))
    assert areas.f1(*got[areas.THRESHOLD]) >= 0.95


# Ordinary sentences that were not written from the tables, by the hand that wrote the terms; six ambiguous terms were narrowed
# after the first look at the results.
UNSEEN = {
    'sport': [
        'The striker curled the ball past the keeper in stoppage time to seal the win.',
        'Our swimmers took two golds at the regional championships last weekend.',
        'She returned from injury and won the opening set six games to three.',
        'Fans queued outside the stadium hours before the derby.',
        "The coach rested four players ahead of Saturday's cup tie.",
        'He ran the second half of the marathon faster than the first.',
        'Der Torwart hielt in der Nachspielzeit einen Elfmeter.',
        "L'équipe a gagné le tournoi après une prolongation éprouvante.",
        'El delantero marcó un gol de cabeza en el último minuto.',
        'The referee sent off two defenders after a scuffle near the touchline.',
        'Rowers train at dawn so that the river is calm.',
        'A hat-trick before half-time put the game beyond doubt.',
    ],
    'law': [
        'The judge ruled that the evidence had been obtained unlawfully.',
        'Tenants may withhold rent if the landlord fails to carry out repairs.',
        'Her lawyer filed an appeal against the sentence within two weeks.',
        "The contract may be terminated by either party with thirty days' notice.",
        'A jury found the company liable for negligence.',
        'Copyright in the photographs remains with the author.',
        'Das Gericht wies die Klage wegen Verjährung ab.',
        "Le tribunal a condamné l'entreprise à verser des dommages et intérêts.",
        'El juez admitió la demanda presentada por los inquilinos.',
        'The defendant pleaded guilty to two counts of fraud.',
        'Parliament passed legislation restricting the sale of personal data.',
        'Witnesses testified under oath for three days.',
    ],
    'medicine': [
        'The surgeon removed the tumour in a four-hour operation.',
        'Patients with diabetes should have their blood sugar checked regularly.',
        'He was admitted to hospital with chest pain and shortness of breath.',
        'The vaccine protects most adults against severe illness.',
        'Nurses changed the dressing on the wound twice a day.',
        'She was prescribed antibiotics for a throat infection.',
        'Der Arzt verschrieb ein Medikament gegen den hohen Blutdruck.',
        'Le médecin a posé le diagnostic après une radiographie du genou.',
        'La paciente recibió quimioterapia durante seis meses.',
        'An MRI showed a torn ligament in the left knee.',
        'Children with asthma carry an inhaler at school.',
        'The clinical trial was stopped because of side effects.',
    ],
    'science': [
        'Astronomers detected a faint galaxy behind the nebula.',
        'The enzyme breaks down starch into simple sugars.',
        'Electrons jump between energy levels when the atom absorbs a photon.',
        'Geologists dated the fossil to the Jurassic period.',
        'The experiment measured how quickly the bacteria divided.',
        'Volcanic ash cooled the atmosphere for two years.',
        'Die Forscher untersuchten das Erbgut der Bakterien im Labor.',
        'Les physiciens ont mesuré la masse du proton avec une précision inédite.',
        'El telescopio captó la luz de un planeta lejano.',
        'Tectonic plates drift a few centimetres each year.',
        "A mutation in this gene alters the protein's shape.",
        'The comet passes close to the sun every seventy-six years.',
    ],
    'food': [
        'Chop the onions finely and fry them in butter until soft.',
        'Leave the dough to rise for an hour in a warm place.',
        'The soup needs a little more salt and a squeeze of lemon.',
        'Serve the roast chicken with potatoes and green beans.',
        'Whisk the eggs with sugar until the mixture is pale.',
        'This restaurant is known for its seafood and its chocolate cake.',
        'Den Teig kneten und im Ofen goldbraun backen.',
        'Ajoutez la crème et laissez mijoter la sauce dix minutes.',
        'Mezcla la harina con la leche y añade los huevos.',
        'Simmer the lentils with garlic, cumin and tomatoes.',
        'We had pancakes with berries for breakfast.',
        'Toast the spices in a dry pan before grinding them.',
    ],
    'storage': [
        'Every write goes to the write-ahead log before it is acknowledged.',
        'Compaction merges small files and drops deleted rows.',
        'A checksum on each block detects corrupted data after a crash.',
        'Snapshots are copied to object storage every night.',
        'The file system ran out of disk space during the backup.',
        'Recovery replays the log from the last checkpoint.',
    ],
    'serving': [
        'The load balancer sends traffic only to healthy replicas.',
        'We rolled back the deployment after latency doubled.',
        'Requests above the rate limit are rejected with an error code.',
        'An alert fired when the service returned too many timeouts.',
        'Kubernetes restarted the container after the health check failed.',
        'The outage lasted twenty minutes because failover did not trigger.',
    ],
    'evaluation': [
        'Precision and recall are reported on a held-out test set.',
        'The new ranking beats the baseline by two points of NDCG.',
        'Three annotators judged each result, and disagreements were discussed.',
        'The difference is not statistically significant; the confidence interval includes zero.',
        'We repeated the benchmark with five random seeds.',
        'An ablation study shows which metric drives the gain.',
    ],
    'chat_models': [
        'The chatbot hallucinated a reference that does not exist.',
        'A longer system prompt leaves less room in the context window.',
        'The language model was fine-tuned on support conversations.',
        "Few-shot examples in the prompt improve the model's answer.",
        'The assistant cites retrieved passages to ground its reply.',
        'Token limits force us to summarise the chat history.',
    ],
    'vector_search': [
        'The index returns the nearest neighbours by cosine similarity.',
        'Product quantization shrinks each vector to a few bytes.',
        'HNSW builds a layered proximity graph over the points.',
        'Distances become less informative in high dimensions.',
        'Queries visit the inverted lists whose centroids are closest.',
        'Approximate search trades a little recall for speed.',
    ],
}
NO_AREA = [
    'The train to the coast leaves at nine and arrives before noon.',
    'My neighbour painted the fence green last summer.',
    'They met at the library every Tuesday to talk about novels.',
    'The museum opens late on Fridays and entry is free.',
    'He forgot his umbrella on the bus again.',
    'Children built a castle out of sand near the pier.',
    'The old bridge was closed for repairs in spring.',
    'She plays the violin in a small orchestra.',
    'Wir fahren im August für zwei Wochen an die See.',
    'Le village organise un marché tous les dimanches.',
    'Mi abuela vive en una casa con jardín.',
    'The committee will meet again after the holidays.',
    'Rain is expected in the afternoon with some wind.',
    'I bought a new desk for the spare room.',
    'The film lasted nearly three hours and nobody left.',
    'We moved to the city because of the schools.',
]


def test_areas_of_unseen_sentences(spark):
    """Three sentences of an area are a document."""
    rows = [(f"{a}-{i}", a, " ".join(ss[i : i + 3])) for a, ss in UNSEEN.items() for i in range(0, len(ss), 3)]
    rows += [(f"none-{i}", "", " ".join(NO_AREA[i : i + 4])) for i in range(0, len(NO_AREA), 4)]
    docs = spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id string, text string")
    got = {tuple(r) for r in areas.subject_areas(docs).select("doc_id", "area").collect()}
    want = {(i, a) for i, a, _ in rows if a}
    assert areas.f1(len(want), len(got), len(got & want)) >= 0.85


def test_copied_texts_keep_their_areas(spark):
    law = "The tenant signed the lease. The judge dismissed the suit. A witness testified under oath."
    docs = spark.createDataFrame([(i, law) for i in range(50)] + [(99, "It rained.")], "doc_id bigint, text string")
    assert areas.subject_areas(docs).where("area = 'law'").count() == 50


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_queries_run_on_the_small_tables(spark, small, name):
    assert queries.queries()[name](spark, small).count() > 0


def test_live_embeddings_ignores_clashing_columns(vector_docs):
    assert live_embeddings(vector_docs, order=["received_at", "batch_no"], dim=64).columns == ["id", "vec"]


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_equal_sql(spark, small, name):
    import compare

    assert compare.differences(spark, compare.connect(small), name, queries.queries()[name], queries.oracle_sql()[name], small) == ""
