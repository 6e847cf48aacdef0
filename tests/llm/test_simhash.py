import numpy as np
import pytest
import xxhash

from loomgraph.llm import common, components, simhash


def brute_fp(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(len(words) - 2, min(len(words), 1)))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def brute(rows):
    fps = [(i, brute_fp(t)) for i, t in rows]
    comp = {i: i for i, _ in fps}
    changed = True
    while changed:
        changed = False
        for i, x in fps:
            for j, y in fps:
                if (x ^ y).bit_count() <= 3 and comp[i] > comp[j]:
                    comp[i], changed = comp[j], True
    return {(i, f"{f:016x}", comp[i]) for i, f in fps}


def test_against_brute_force(make_docs):
    rng = np.random.default_rng(5)
    vocab = [f"w{i}" for i in range(300)]
    base = [list(rng.choice(vocab, 60)) for _ in range(12)]
    rows = []
    for i in range(80):
        words = list(base[i % 12])
        for _ in range(rng.integers(0, 3)):
            words[rng.integers(0, 60)] = "changed"
        rows.append((i, " ".join(words)))
    rows += [(100, None), (101, ""), (102, " \t\n"), (103, "One"), (104, "one"), (105, "a b"), (106, "É x y Z\x1cq w"), (107, "A A A A A A")]
    rows += [(200, "word " * 30_000)]
    got = {tuple(r) for r in simhash.near_duplicates(make_docs(rows)).collect()}
    assert got == brute(rows)


def test_links_of_random_flips_in_small_cells(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    fps = set(map(int, base)) | {0, 2**64 - 1, 7, 15}
    for x in base[:20]:
        for _ in range(6):
            y = int(x)
            for bit in rng.choice(64, rng.integers(1, 5), replace=False):
                y ^= 1 << int(bit)
            fps.add(y)
    fps = np.array(sorted(fps), np.uint64)
    want = parts(fps, [(int(a), int(b)) for i, a in enumerate(fps) for b in fps[:i] if (int(a) ^ int(b)).bit_count() <= 3])
    frame = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    for cell in (4096, 3):
        found = [(r.a % 2**64, r.b % 2**64) for r in simhash.links(frame, cell=cell).collect()]
        assert parts(fps, found) == want


def parts(fps, pairs):
    root = {int(x): int(x) for x in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        root[max(find(a), find(b))] = min(find(a), find(b))
    return {x: find(x) for x in root}


def test_empty_table_nulls_repeats_and_extra_columns(spark, make_docs):
    assert simhash.near_duplicates(make_docs([(1, "a")]).limit(0)).collect() == []
    frame = spark.createDataFrame([(None, "a b c", 1, "k"), (5, "a b c", 1, "k"), (5, "a b c", 2, None)], "doc_id long, text string, fp int, component_id string")
    got = simhash.near_duplicates(frame).collect()
    assert sorted((r.doc_id is None, r.component_id) for r in got) == [(False, 5), (False, 5), (True, 5)]


def test_manhattan_is_a_lower_bound():
    rng = np.random.default_rng(2)
    fp = rng.integers(0, 2**63, 200, dtype=np.uint64)
    pop = lambda x: np.array([[(int(v) >> 2 * s & 3).bit_count() for s in range(32)] for v in x])
    e = fp - ((fp >> np.uint64(1)) & np.uint64(0x5555555555555555))
    low, high = e & np.uint64(0x3333333333333333), (e >> np.uint64(2)) & np.uint64(0x3333333333333333)
    i, j = np.arange(199), np.arange(1, 200)
    exact = np.abs(pop(fp[i]) - pop(fp[j])).sum(axis=1)
    assert (exact <= np.bitwise_count(fp[i] ^ fp[j])).all()
    for d in (5, 20, 24):
        assert (simhash._manhattan_at_most(low, high, i, j, d) == (exact <= d)).all()


@pytest.mark.parametrize("bound", [1000, 3])
def test_components_with_hubs_and_chains(spark, monkeypatch, bound):
    monkeypatch.setattr(common, "HOT_ROWS", bound)
    hub = [(500, i) for i in range(100, 160)] + [(i, 1000 + i) for i in range(100, 160, 7)]
    chain = [(i, i + 1) for i in range(20)]
    edges = spark.createDataFrame(hub + chain + [(9, 9), (5, 4)], "a long, b long")
    got = {(r.node, r.root) for r in components.connected_components(edges).collect()}
    assert got == {(n, 100) for n in {x for e in hub for x in e}} | {(n, 0) for n in range(21)}
    assert components.connected_components(edges.limit(0)).collect() == []
