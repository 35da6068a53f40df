import random

import numpy as np
import pytest

from docrecon.llm import ngram


def shingles(text, words):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\x0b", " ").split(" ")
    w = [x for y in w for x in y.replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0c", " ").split(" ") if x]
    if not w:
        return frozenset()
    return frozenset(tuple(w[k:k + words]) for k in range(max(1, len(w) - words + 1)))


def brute(rows, words, num, den):
    sets = [shingles(t, words) for _, t in rows]
    at = list(range(len(rows)))

    def root(k):
        while at[k] != k:
            k = at[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                at[root(i)] = root(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root(k)] = min(i, least.get(root(k), i))
    return sorted(((i, len(s), i if not s else least.get(root(k))) for k, ((i, _), s) in enumerate(zip(rows, sets))), key=str)


def corpus(seed):
    draw = random.Random(seed)
    word = lambda: draw.choice("abcdefghij") + draw.choice("klmnopqrst") + draw.choice("uvwxyz")
    texts = []
    for size in (8, 20, 60, 200):
        for _ in range(4):
            base = [word() for _ in range(size)]
            chain = list(base)
            for _ in range(14):  # a chain: each is near the one before, not the first
                for _ in range(draw.randint(0, max(1, size // 40))):
                    chain[draw.randrange(len(chain))] = word()
                texts.append(" ".join(chain))
            texts += [" ".join(base), " ".join(base).upper(), " ".join(base[:-1])]
        shared = [word() for _ in range(max(3, size // 3))]
        texts += [" ".join(shared + [word() for _ in range(size)]) for _ in range(25)]
    draw.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("words,num,den", [(4, 85, 100), (5, 80, 100)])
def test_equals_brute_force(spark, words, num, den):
    rows = corpus(words) + [(None, "one two three"), (5000, "one two three"), (5001, ""), (5002, None), (None, None), (7, "twice")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in ngram.jaccard_components(df, words=words, num=num, den=den).collect()), key=str)
    assert got == brute(rows, words, num, den)


def test_no_near_pair_without_a_common_cell():
    cells = ngram.Cells(85, 100)
    draw = np.random.default_rng(4)
    for n in (7, 12, 40, 150, 900):
        for _ in range(60):
            a = np.unique(draw.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
            gone = draw.integers(0, max(1, n // 7) + 1)
            b = np.unique(np.concatenate([a[gone:], draw.integers(0, 1 << 63, draw.integers(0, gone + 1)).astype(np.uint64)]))
            common = len(np.intersect1d(a, b))
            if 100 * common >= 85 * (len(a) + len(b) - common) and common < max(len(a), len(b)):
                assert np.intersect1d(cells.keys(a), cells.keys(b)).size


@pytest.mark.parametrize("num,of", [(80, 5), (70, 4)])
def test_no_near_pair_without_a_common_cell_at_lower_thresholds(num, of):
    cells = ngram.Cells(num, 100)
    draw, tried = np.random.default_rng(6), 0
    for n in (7, 12, 40, 150, 900):
        for _ in range(60):
            a = np.unique(draw.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
            gone = draw.integers(0, max(1, n // of) + 1)
            b = np.unique(np.concatenate([a[gone:], draw.integers(0, 1 << 63, draw.integers(0, gone + 1)).astype(np.uint64)]))
            common = len(np.intersect1d(a, b))
            if 100 * common >= num * (len(a) + len(b) - common) and common < max(len(a), len(b)):
                assert np.intersect1d(cells.keys(a), cells.keys(b)).size
                tried += 1
    assert tried > 50


@pytest.mark.parametrize("num", [80, 85])
def test_sets_without_a_common_shingle_rarely_share_a_cell(num):
    """Cells of empty groups are for sets with more weak groups than spare ones, which must be few."""
    cells, draw = ngram.Cells(num, 100), np.random.default_rng(7)
    keys = [np.unique(cells.keys(np.unique(draw.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))))
            for n in draw.integers(200, 1500, 300)]
    counts = np.unique(np.concatenate(keys), return_counts=True)[1]
    assert counts[counts > 1].sum() < 0.02 * sum(map(len, keys))


def test_trees_find_all_that_the_bound_allows():
    draw = np.random.default_rng(5)
    at = draw.poisson(3, (700, ngram.AXES)).astype(np.int32)
    at[350:] = at[:350] + draw.integers(0, 2, (350, ngram.AXES)).astype(np.int32)
    size, group = at.sum(axis=1), np.tile([1, 1, 1, 4, 4, 9, 1], 100)
    asks = np.append(group, 5)
    q, p, shared = ngram.Forest(group, at, size, 85, 100).near(asks, np.vstack([at, at[:1]]), np.append(size, size[0]))
    bound = np.minimum(at[:, None], at[None]).sum(axis=2)
    fits = (185 * bound >= 85 * (size[:, None] + size[None])) & (group[:, None] == group)
    assert sorted(zip(q.tolist(), p.tolist())) == sorted(map(tuple, np.argwhere(fits).tolist()))
    assert (bound[q, p] == shared).all()


def test_fine_points_bound_what_sets_share():
    draw = np.random.default_rng(6)
    for n, m in ((1, 3), (50, 300), (255, 260), (900, 1100), (5000, 4000)):
        both = draw.integers(0, 1 << 63, min(n, m) // 2).astype(np.uint64) * np.uint64(2)
        a, b = (np.unique(np.append(both, draw.integers(0, 1 << 63, k - len(both)).astype(np.uint64))) for k in (n, m))
        shared = ngram.most_shared(ngram.fine_point(a), ngram.fine_point(b))
        assert len(np.intersect1d(a, b)) <= shared <= min(len(a), len(b))
        assert shared == ngram.most_shared(ngram.fine_point(b), ngram.fine_point(a))


def test_large_cells_are_cut_into_tiles_and_pages(spark, monkeypatch):
    """Cells of many more nodes than a page holds, with links across tiles and pages."""
    monkeypatch.setattr(ngram, "PAGE", 4)
    monkeypatch.setattr(ngram, "ASKED", 3)
    draw = random.Random(8)
    base = [f"w{k}" for k in range(70)]
    rows = []
    for k in range(90):
        own = list(base[:draw.choice((48, 54, 60, 66, 70))])
        for _ in range(draw.randint(0, 3)):
            own[draw.randrange(len(own))] = f"x{draw.randrange(40)}"
        rows.append((k, " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in ngram.jaccard_components(df).collect()), key=str)
    assert got == brute(rows, 4, 85, 100)


def test_a_pair_is_written_in_one_cell(spark, monkeypatch):
    """Sets just below the threshold share many cells; each pair of them is written once."""
    real, found = ngram.across, []

    def spy(paged, *rest):
        with monkeypatch.context() as m:
            m.setattr(type(paged), "distinct", lambda self: self)
            out = real(paged, *rest)
        found.extend(tuple(r) for r in out.collect())
        return ngram.settled(out.distinct(), "spied")

    monkeypatch.setattr(ngram, "across", spy)
    base = [f"w{k}" for k in range(200)]
    rows = [(0, " ".join(base)), (1, " ".join(base[:-1]))]
    for k in range(2, 14):
        own = list(base)
        for j in range(5):
            own[(k * 17 + j * 38) % 200] = f"x{k}y{j}"
        rows.append((k, " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in ngram.jaccard_components(df).collect()), key=str)
    assert got == brute(rows, 4, 85, 100)
    assert len(found) > 5 and len(set(found)) == len(found)


def test_middle_points_bound_what_sets_share():
    draw = np.random.default_rng(9)
    sets = []
    for n in (1, 60, 300, 900, 2100, 30_000, 400_000):
        both = draw.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2)
        more = [draw.integers(0, 1 << 63, n // 9 + 1).astype(np.uint64) for _ in range(2)]
        sets += [np.unique(np.append(both, x)) for x in more]
    middles = ngram.Middles(np.array([ngram.middle_point(ngram.fine_point(s)) for s in sets], object))
    assert (middles.coarse() == ngram.points_of(sets)).all()
    p, q = (x.ravel() for x in np.indices((len(sets), len(sets))))
    for k, shared in zip(zip(p.tolist(), q.tolist()), middles.shared(p, q).tolist()):
        a, b = sets[k[0]], sets[k[1]]
        assert len(np.intersect1d(a, b)) <= shared <= min(len(a), len(b))


def test_all_links_come_from_the_trees(spark, monkeypatch):
    """With trees that find nothing, only equal sets are one component."""
    monkeypatch.setattr(ngram, "likeliest", lambda paged, num, den: paged.sparkSession.createDataFrame(
        [], "a long, b long, shared double"))
    monkeypatch.setattr(ngram, "across", lambda paged, *rest: ngram.settled(
        paged.sparkSession.createDataFrame([], "a long, b long"), "none"))
    rows = [(k, " ".join(f"w{j}" for j in range(60 + k % 3))) for k in range(9)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in ngram.jaccard_components(df).collect()} == {k: k % 3 for k in range(9)}


def test_awkward_rows(awkward, nothing):
    rows = ngram.jaccard_components(awkward).collect()
    assert len(rows) == awkward.count()
    assert {r.component_id for r in rows if r.doc_id == 0} == {0}
    assert ngram.jaccard_components(nothing).count() == 0


def families(many: int) -> list[tuple[int, str]]:
    """Texts around a common one, some of which link."""
    rows = []
    for f in range(many):
        base = [f"f{f}w{k}" for k in range(200)]
        rows += [(100 * f, " ".join(base)), (100 * f + 1, " ".join(base[:-1]))]
        for k in range(2, 12):
            own = list(base)
            for j in range(2 + k % 4):
                own[(k * 17 + j * 38) % 200] = f"x{k}y{j}"
            rows.append((100 * f + k, " ".join(own)))
    return rows


def test_written_cells_hold_no_points(spark, monkeypatch):
    """Points are written once a node, and what the searches do not read is deleted before them."""
    real, gone, across, live, columns = ngram.settled, ngram.forget, ngram.across, set(), {}

    def settled(df, name):
        live.add(name)
        columns[name] = set(df.columns)
        out = real(df, name)
        out.named = name
        return out

    def forget(*tables):
        live.difference_update(x.named for x in tables if hasattr(x, "named"))
        gone(*tables)

    def search(*given):
        assert not live & {"ngram-sets", "cell-points"}
        return across(*given)

    for name, spy in (("settled", settled), ("forget", forget), ("across", search)):
        monkeypatch.setattr(ngram, name, spy)
    rows = families(2)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((tuple(r) for r in ngram.jaccard_components(df).collect()), key=str) == brute(rows, 4, 85, 100)
    assert "cell-inside" in columns
    for name, own in columns.items():
        assert "cell" not in own or not own & {"at", "fine", "middle", "listed"}, name


def test_cells_are_searched_in_slices(spark, monkeypatch):
    real, slices = ngram.sliced_cells, []

    def spy(*given):
        out = real(*given)
        slices.append(len(out))
        return out

    monkeypatch.setattr(ngram, "sliced_cells", spy)
    monkeypatch.setattr(ngram, "SLICE_ROWS", 40)
    monkeypatch.setattr(ngram, "PAGE", 4)
    rows = families(3)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((tuple(r) for r in ngram.jaccard_components(df).collect()), key=str) == brute(rows, 4, 85, 100)
    assert len(slices) == 2 and min(slices) > 1 and max(slices) <= ngram.SLICES
