import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ripplemark.llm import components, exact_dedup, simhash


def brute_groups(rows, keep=max):
    by = defaultdict(list)
    for i, t, *_ in rows:
        by[t or ""].append(i)
    out = []
    for t, ids in by.items():
        known = [i for i in ids if i is not None]
        best, seen = keep(known) if known else None, set()
        for i in ids:
            out.append((i, best, len(ids), i == best and i not in seen, hashlib.sha256(t.encode()).hexdigest()))
            seen.add(i)
    return sorted(out, key=str)


@pytest.mark.parametrize("runs,fan_in", [(1, 2), (7, 2), (64, 4), (9, 100)])
def test_exact_groups_match_brute_force(docs, rows, runs, fan_in):
    got = exact_dedup.exact_groups(docs, runs=runs, fan_in=fan_in).collect()
    assert sorted([tuple(r) for r in got], key=str) == brute_groups(rows)


def test_exact_groups_can_keep_the_smallest_and_normalise(docs, rows):
    got = exact_dedup.exact_groups(docs, keep="smallest").collect()
    assert sorted([tuple(r) for r in got], key=str) == brute_groups(rows, min)
    trimmed = exact_dedup.exact_groups(docs, normalise=F.trim).where("doc_id IN (5, 4)").collect()
    assert {r["group_size"] for r in trimmed} == {2}


def test_exact_dedup_keeps_whole_rows(clashing, rows):
    got = exact_dedup.exact_dedup(clashing)
    assert got.columns == clashing.columns
    kept = [(i, t or "") for i, t, *_ in rows]
    want = {(b, hashlib.sha256(t.encode()).hexdigest()) for i, t in kept for b in [max([j for j, u in kept if u == t and j is not None], default=None)]}
    assert sorted((r["doc_id"], hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in got.collect() if r["doc_id"]) == sorted(w for w in want if w[0])


def test_extra_columns_change_nothing(docs, clashing):
    a = sorted(map(str, exact_dedup.exact_groups(docs).collect()))
    assert a == sorted(map(str, exact_dedup.exact_groups(clashing).collect()))
    a = sorted(map(str, simhash.near_components(docs).collect()))
    assert a == sorted(map(str, simhash.near_components(clashing).collect()))


def test_empty_tables(empty):
    assert exact_dedup.exact_groups(empty).count() == 0
    assert exact_dedup.exact_dedup(empty).count() == 0
    assert simhash.near_components(empty).count() == 0
    assert simhash.near_dedup(empty).count() == 0
    assert simhash.similar_dedup(empty).count() == 0


def plain_fingerprint(text):
    import xxhash

    w = (text or "").encode().lower().split()
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    hs = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def brute_components(rows, bits):
    prints = [plain_fingerprint(t) for _, t, *_ in rows]
    label = list(range(len(rows)))
    while True:
        new = [min(label[j] for j in range(len(rows)) if (prints[i] ^ prints[j]).bit_count() <= bits) for i in range(len(rows))]
        if new == label:
            break
        label = new
    groups = defaultdict(list)
    for i, lab in enumerate(label):
        groups[lab].append(i)
    out = []
    for members in groups.values():
        least = min((rows[i][0] for i in members if rows[i][0] is not None), default=None)
        out += [(rows[i][0], f"{prints[i]:016x}", least) for i in members]
    return sorted(out, key=str)


def test_blocks_grow_with_the_number_of_fingerprints():
    found = [simhash.blocks_for(n) for n in (0, 10**6, 10**8, 10**9, 10**11, 10**13)]
    assert found[:3] == [6, 6, 6] and found == sorted(found) and found[3] == 7 and found[-1] < 32


@pytest.mark.parametrize("bits,blocks", [(4, 6), (4, None), (4, 8), (20, 22)])
def test_near_components_match_brute_force(docs, rows, bits, blocks):
    got = simhash.near_components(docs, bits=bits, blocks=blocks).collect()
    assert sorted([tuple(r) for r in got], key=str) == brute_components(rows, bits)


def test_popular_keys_are_split_without_losing_links(spark):
    import random

    rng = random.Random(3)
    base = rng.getrandbits(64)
    prints = {base}
    while len(prints) < 400:
        p = rng.choice(sorted(prints)) if rng.random() < 0.7 else rng.getrandbits(64)
        for _ in range(rng.randint(0, 5)):
            p ^= 1 << rng.randrange(64)
        prints.add(p)
    signed = [p - (1 << 64) if p >> 63 else p for p in sorted(prints)]
    df = spark.createDataFrame([(p,) for p in signed], "_fp long")
    roots = {}
    for chunk in (8, 64, 512):
        found = components.components(simhash.links(df, chunk=chunk))
        roots[chunk] = sorted(tuple(r) for r in found.collect())
    assert roots[8] == roots[64] == roots[512]
    label = {p: p for p in signed}
    near = [(p, q) for p in signed for q in signed if p < q and ((p ^ q) & (1 << 64) - 1).bit_count() <= 4]
    while any(label[p] != label[q] for p, q in near):
        for p, q in near:
            label[p] = label[q] = min(label[p], label[q])
    want = sorted((p, r) for p, r in label.items() if any(p in e for e in near))
    assert roots[8] == want


def test_near_dedup_keeps_one_of_each_component(clashing, rows):
    got = simhash.near_dedup(clashing)
    assert got.columns == clashing.columns
    want = {(least, fp) for _, fp, least in brute_components(rows, 4) if least is not None}
    assert {r["doc_id"] for r in got.collect()} - {None} == {i for i, _ in want}


def test_similar_dedup_finds_texts_that_share_four_fifths(spark):
    import random

    rng = random.Random(5)
    rows, originals = [], 40
    for i in range(originals):
        w = ["".join(rng.choices("abcdefghijkl", k=5)) for _ in range(300)]
        rows.append((i, " ".join(w)))
        for at in rng.sample(range(300), 5):  # 25 of 296 shingles go
            w[at] = "changed"
        rows.append((1000 + i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r["doc_id"] for r in simhash.similar_dedup(df).collect()}
    assert set(range(originals)) <= kept
    assert len(kept - set(range(originals))) <= 1


def plain_similarity(a, b):
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (a.split(), b.split())]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def test_similar_dedup_keeps_texts_below_four_fifths(spark):
    import random

    rng = random.Random(6)
    rows, pairs = [], []
    for i in range(60):
        w = ["".join(rng.choices("abcdefghijkl", k=5)) for _ in range(300)]
        rows.append((i, " ".join(w)))
        for at in range(10, 10 + 20 * (i % 6 + 7), 20):  # 35 to 60 of 296 shingles go
            w[at] = "changed"
        rows.append((1000 + i, " ".join(w)))
        pairs.append(plain_similarity(rows[-2][1], rows[-1][1]))
    assert min(pairs) < 0.68 and max(pairs) < 0.8
    for i in range(2):  # one line many times, and a rest of its own
        rest = " ".join("".join(rng.choices("abcdefghijkl", k=5)) for _ in range(80))
        rows.append((2000 + i, "all rights reserved by the owner of this page " * 150 + rest))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in simhash.similar_dedup(df).collect()) == sorted(i for i, _ in rows)


def test_what_many_short_texts_have_in_common_is_no_key(spark):
    rng = random.Random(8)
    common = " ".join(f"common{i}" for i in range(12))
    texts = [" ".join([*(f"w{rng.randrange(10**6)}" for _ in range(20)), common]) for _ in range(60)]
    late, rank = simhash._late(spark.createDataFrame([(t.encode(),) for t in texts], "_text binary"), simhash.WIDE_SHINGLE, simhash.SEED)
    keys = [simhash.prefix(simhash.distinct_shingles(t.encode(), simhash.WIDE_SHINGLE), simhash.SIMILARITY, late, rank) for t in texts]
    assert max(np.unique(np.concatenate(keys), return_counts=True)[1]) == 1


def test_prefixes_of_similar_sets_share_a_shingle_in_any_order():
    import random

    import numpy as np

    rng = random.Random(8)
    for _ in range(300):
        pool = rng.sample(range(1 << 40), rng.randint(2, 120))
        late = np.array(sorted(rng.sample(pool, rng.randint(0, len(pool)))), np.uint64)
        rank = np.array(rng.sample(range(len(late)), len(late)), np.int64)
        a = set(rng.sample(pool, rng.randint(1, len(pool))))
        b = set(a)
        while a and len(a & b) >= 0.8 * len(a | b):  # as far apart as similar sets may be
            want, of = set(b), sorted(b)
            b = b - {rng.choice(of)} if rng.random() < 0.5 and len(b) > 1 else b | {rng.choice(pool)}
            if b == want and len(b) == len(pool):
                break
            if len(a & b) < 0.8 * len(a | b):
                b = want
                break
        p, q = (set(simhash.prefix(np.array(sorted(x), np.uint64), 0.8, late, rank).tolist()) for x in (a, b))
        assert len(a & b) >= 0.8 * len(a | b) and p & q and len(p) <= len(a) // 5 + 1


@pytest.mark.parametrize("texts", [128, 8])
def test_similar_dedup_tries_every_candidate_of_a_large_group(spark, monkeypatch, texts):
    import random

    monkeypatch.setattr(simhash, "_TEXTS", texts)  # so that groups are compared in several chunks
    rng = random.Random(7)
    rows = []
    for family in range(3):
        base = ["".join(rng.choices("abcdefghijkl", k=5)) for _ in range(200)]
        for i in range(60):
            w = list(base)
            for at in rng.sample(range(200), rng.randint(0, 9)):
                w[at] = f"w{i}"
            rows.append((family * 1000 + i, " ".join(w)))
    root = {i: i for i, _ in rows}
    by_id = dict(rows)
    links = [(i, j) for i in by_id for j in by_id if i < j and i // 1000 == j // 1000 and plain_similarity(by_id[i], by_id[j]) >= 0.8]
    while any(root[i] != root[j] for i, j in links):
        for i, j in links:
            root[i] = root[j] = min(root[i], root[j])
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"] for r in simhash.similar_dedup(df).collect()} == set(root.values())


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(50)] + [(1000, 1000 + i) for i in range(1, 200)] + [(7, 7), (None, 3)]
    df = spark.createDataFrame(edges, "u long, v long")
    got = {r["node"]: r["root"] for r in components.components(df).collect()}
    assert {got[i] for i in range(51)} == {0} and {got[1000 + i] for i in range(200)} == {1000}
    assert components.components(df.limit(0)).count() == 0
