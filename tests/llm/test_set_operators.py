import hashlib
import math
import random

import numpy as np
import pytest

from quantloom.llm import embeddings, graph, minhash, mixing, sharding
from quantloom.llm.common import scratch, shared_dir, sized_broadcast

DOCS = "doc_id long, text string, source string, bucket int"


def components_of(nodes, linked):
    top = {n: n for n in nodes}

    def root(n):
        while top[n] != n:
            n = top[n]
        return n

    for a, b in linked:
        a, b = root(a), root(b)
        top[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def brute_near(docs, k, percent):
    sets = {d: minhash.shingle_set(minhash.words_of(t), k) for d, t in docs}
    pairs = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and minhash.linked(sets[a], sets[b], percent)]
    return {d: (len(sets[d]), c) for d, c in components_of(sets, pairs).items()}


def mutated(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
    return words


@pytest.mark.parametrize(("seed", "k"), [(0, 2), (1, 5)])
def test_near_duplicates_equal_brute_force(spark, seed, k):
    rng = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(4000)]
    passage = rng.choices(vocabulary, k=60)
    docs = []
    for _ in range(12):  # groups around the threshold
        base = rng.choices(vocabulary, k=rng.randint(20, 120))
        docs += [" ".join(mutated(rng, base, rng.randint(0, 8))) for _ in range(rng.randint(1, 9))]
    docs += [" ".join(rng.choices(vocabulary, k=rng.randint(15, 40)) + passage) for _ in range(50)]  # share much, not enough
    docs += ["", "  ", "one", "One", "one two", "ONE\ttwo"] + [" ".join(passage)] * 20 + ["x y z " * 2000]
    rows = [(i, t, "s", 1) for i, t in enumerate(docs)] + [(1000, None, None, None)]
    frame = spark.createDataFrame(rows, DOCS)
    out = {r["doc_id"]: r for r in minhash.near_duplicates(frame, k).collect()}
    expected = brute_near([(r[0], r[1]) for r in rows], k, 80)
    assert {d: (r["n_shingles"], r["component_id"]) for d, r in out.items()} == expected
    assert all(r["kept"] == (d == r["component_id"]) for d, r in out.items())


@pytest.mark.parametrize("small", [0, 2, 64])
def test_large_buckets_equal_brute_force(spark, monkeypatch, small):
    """Chains, in which neighbours reach the threshold, others don't; copies of one text with changes of their own and shared changes."""
    monkeypatch.setattr(minhash, "SMALL", small)
    rng = random.Random(3)
    words = [f"v{rng.randrange(10**6)}" for _ in range(100)]
    docs = [" ".join(words)]
    for _ in range(40):
        words = words[4:] + [f"v{rng.randrange(10**6)}" for _ in range(4)]
        docs.append(" ".join(words))
    base = [f"u{rng.randrange(10**6)}" for _ in range(90)]
    docs += [" ".join(mutated(rng, base, rng.randint(3, 14))) for _ in range(50)]
    for _ in range(8):
        far = mutated(rng, base, 10)
        docs += [" ".join(mutated(rng, far, rng.randint(0, 4))) for _ in range(5)]
    docs = [docs[i] for i in rng.sample(range(len(docs)), len(docs))]
    frame = spark.createDataFrame([(i, t, "s", 1) for i, t in enumerate(docs)], DOCS)
    for k in (2, 5):
        out = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(frame, k).collect()}
        assert out == brute_near(list(enumerate(docs)), k, 80)


def test_near_duplicate_edge_rows(spark):
    rows = [(7, "a b c d e f", "s", 1), (7, "other words altogether here now", "s", 1), (9, "a b c d e f", "s", 2), (None, "a b c d e f", "s", 3), (7, "a b c d e f", "s", 1)]
    frame = spark.createDataFrame(rows, DOCS)
    out = minhash.near_duplicates(frame).collect()
    assert len(out) == 5 and {r["component_id"] for r in out if r["doc_id"]} == {7}
    assert [(r["component_id"], r["kept"]) for r in out if r["doc_id"] is None] == [(None, False)]
    kept = minhash.drop_near_duplicates(frame)
    assert kept.columns == frame.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["7", "None"]
    assert minhash.near_duplicates(frame.limit(0)).count() == 0
    clash = frame.selectExpr("doc_id", "text", "source as row", "bucket as th", "1 as _ql_doc", "2 as doc")
    assert minhash.drop_near_duplicates(clash).columns == clash.columns


def test_signature_is_circulant(spark):
    c = minhash.Circulant(4, 2, 8)
    pi = c.windows[:, 0]
    x = np.array([3, 77, 200], np.uint64)
    twin = c.signature(np.array([3, 77, 201], np.uint64))
    frame = spark.createDataFrame([(c.remains(c.signature(x)).tolist(), c.remains(twin).tolist())], "a array<long>, b array<long>")
    same = int((c.signature(x) % 16 == twin % 16).sum())
    assert frame.select(minhash.agreeing(minhash.F.col("a"), minhash.F.col("b"), 4, 2)).first()[0] == same
    assert c.signature(x).tolist() == [min(int(pi[(c.sigma[int(v)] + k) % 256]) for v in x) for k in range(8)]


def test_components(spark):
    rng = random.Random(0)
    edges = [(i, i + 1) for i in range(60)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(40)] + [(5, 5)]
    out = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {n for e in edges if e[0] != e[1] for n in e}
    assert out == components_of(nodes, edges)
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_vectors(rows, threshold):
    def unit(v):
        if v is None or not v or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            return None
        return np.array(v) / np.linalg.norm(v)

    u = {i: unit(v) for i, v in rows}
    links = [(a, b) for a in u for b in u if a < b and u[a] is not None and u[b] is not None and len(u[a]) == len(u[b]) and u[a] @ u[b] >= threshold]
    top = components_of(u, links)
    return {i: (sum(i in e for e in links), top[i]) for i in u}


@pytest.mark.parametrize("size", [1, 3, 10, 1000])
def test_panels_of_neighbouring_cells_meet_once(size):
    rng = random.Random(size)
    cells = {(rng.randrange(4), rng.randrange(4)): rng.randint(1, 12) for _ in range(12)}
    placed, meet = embeddings.plan_panels(list(cells.items()), size)
    panels = {tuple(c): range(first, first + parts) for c, first, parts in placed}
    assert all(len(panels[c]) == -(-n // size) for c, n in cells.items())
    met = [(x, y) for a, m, b, n in meet for x in range(a, a + m) for y in range(b, b + n) if x <= y]
    assert len(met) == len(set(met))
    near = {(x, y) for c in cells for d in cells if max(abs(i - j) for i, j in zip(c, d, strict=True)) <= 1 for x in panels[c] for y in panels[d] if x <= y}
    assert near <= set(met)


@pytest.mark.parametrize("tile", [8, 1024])
def test_vectors_equal_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(embeddings, "TILE_ROWS", tile)
    monkeypatch.setattr(embeddings, "PANEL_ROWS", 3 * tile if tile < 100 else 8192)
    rng = np.random.default_rng(tile)
    centres = rng.normal(size=(9, 20))
    rows = [(i, (centres[i % 9] + rng.normal(size=20) * (0.15 if i % 2 else 0.45)).tolist()) for i in range(120)]
    rows += [(200 + i, centres[0].tolist()) for i in range(15)] + [(300, [0.0] * 20), (301, None), (302, [math.nan] + [1.0] * 19), (303, [None] + [1.0] * 19), (304, [math.inf] + [1.0] * 19), (305, [1.0, 2.0]), (306, [2.0, 4.0]), (307, [])]
    frame = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, rep int")
    out = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embeddings.link_vectors(frame).collect()}
    assert out == brute_vectors(rows, 0.9)


def test_vector_edge_rows(spark):
    schema = "vec_id long, embedding array<float>"
    frame = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [1.0, 0.0])], schema)
    out = sorted((str(r["vec_id"]), r["n_links"], r["kept"]) for r in embeddings.link_vectors(frame).collect())
    assert out == [("1", 1, True), ("1", 1, True), ("None", 0, False)]
    assert embeddings.link_vectors(frame.limit(0)).count() == 0


def test_shards(spark):
    rng = random.Random(1)
    texts = [f"t{rng.randrange(60)}" if rng.random() < 0.5 else f"own {i}" for i in range(400)] + ["hot"] * 200 + [None, "", "", "é" * 9000]
    rows = [(i, t, "s", 1) for i, t in enumerate(texts)] + [(3, "again", "s", 1), (3, "again", "s", 1), (None, "x", "s", 1)]
    out = sharding.shard_documents(spark.createDataFrame(rows, DOCS), shards=7).collect()
    assert len(out) == len(rows)
    counts = [sorted(r["slot"] for r in out if r["shard"] == k) for k in range(7)]
    assert max(map(len, counts)) - min(map(len, counts)) <= 1 and all(c == list(range(len(c))) for c in counts)
    assert {r["size"] for r in out if r["doc_id"] == 600} == {16} and {r["text_crc32"] for r in out if r["doc_id"] == 600} == {0}

    def cut(key):
        groups = {}
        for r in out:
            groups.setdefault((r["text_crc32"], r["size"]), []).append(r[key])
        return sum(len(set(g)) - 1 for g in groups.values())

    assert cut("shard") < 0.3 * cut("start_shard")
    again = sharding.shard_documents(spark.createDataFrame(rows, DOCS), shards=7).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))
    assert sharding.shard_documents(spark.createDataFrame([], DOCS)).count() == 0
    assert sharding.shard_documents(spark.createDataFrame(rows[:3], DOCS)).count() == 3


def brute_shards(spark, frame, shards, rounds=sharding.ROUNDS):
    """(doc_id, text's checksum) -> sorted (shard, slot), by plain loops; only the hashes come from Spark."""
    F = sharding.F

    def hashed(kind, values, expression):
        values = sorted(set(values))
        rows = spark.createDataFrame([(i, *(v if isinstance(v, tuple) else (v,))) for i, v in enumerate(values)], f"i int, {kind}")
        return {values[r["i"]]: r["h"] for r in rows.select("i", expression.alias("h")).collect()}

    def of_rid(salt):
        return hashed("rid string", [r["rid"] for r in rows], sharding._hash01(F.col("rid"), salt=salt))

    text = F.coalesce(F.col("text"), F.lit(""))
    rows, seen, members = [], {}, {}
    for r in frame.select("doc_id", F.crc32(text.cast("binary")).alias("crc"), F.unhex(F.sha2(text, 256)).alias("key")).collect():
        key = bytes(r["key"])
        n = seen[r["doc_id"], key] = seen.get((r["doc_id"], key), 0) + 1
        name = "|".join(["" if r["doc_id"] is None else str(r["doc_id"]), key.hex().upper(), str(n)])
        rows.append({"doc_id": r["doc_id"], "crc": r["crc"], "key": key, "rid": hashlib.md5(name.encode()).hexdigest()})
        members[key] = members.get(key, 0) + 1
    total = len(rows)
    quota = -(-total // shards)
    start, chunk = of_rid("start"), of_rid("chunk")
    for r in rows:
        r["shard"], r["chunk"] = int(start[r["rid"]] * shards), int(chunk[r["rid"]] * -(-members[r["key"]] // quota))
    linked = [r for r in rows if members[r["key"]] > 1]
    hubs = hashed("k binary, c long", [(r["key"], r["chunk"]) for r in linked], F.xxhash64("k", "c"))
    ties = hashed("h long, s int", [(h, s) for h in hubs.values() for s in range(shards)], F.xxhash64("h", "s"))
    for r in linked:
        r["hub"] = hubs[r["key"], r["chunk"]]
    for k in range(rounds):
        luck, held = of_rid(f"round{k}"), {}
        for r in linked:
            held[r["hub"], r["shard"]] = held.get((r["hub"], r["shard"]), 0) + 1
        wish = {h: max((n, ties[h, s], s) for (g, s), n in held.items() if g == h)[2] for h in set(hubs.values())}
        now = [sum(r["shard"] == s for r in linked) for s in range(shards)]
        come = [sum(wish[r["hub"]] == s != r["shard"] for r in linked) for s in range(shards)]
        rate = [min(1.0, max(0.0, (quota - now[s]) / come[s])) if come[s] else 0.0 for s in range(shards)]
        for r in linked:
            if wish[r["hub"]] != r["shard"] and luck[r["rid"]] < rate[wish[r["hub"]]]:
                r["shard"] = wish[r["hub"]]
    of_hub, alone = hashed("hub long", list(hubs.values()), sharding._hash01(F.col("hub"), salt="order")), of_rid("order")
    buckets = max(8, 2 * total // (shards * sharding.BUCKET_ROWS))
    place = lambda r: (int((of_hub[r["hub"]] if "hub" in r else 1 + alone[r["rid"]]) * buckets), r.get("hub", 0), r["rid"])
    held = [sorted((r for r in rows if r["shard"] == s), key=place) for s in range(shards)]
    own = [total // shards + (s < total % shards) for s in range(shards)]
    spilled = [r for s in range(shards) for r in held[s][own[s] :]]
    for s in range(shards):
        held[s] = held[s][: own[s]]
    for s in range(shards):
        while len(held[s]) < own[s]:
            held[s].append(spilled.pop(0))
    out = {}
    for s in range(shards):
        for slot, r in enumerate(held[s]):
            out.setdefault((r["doc_id"], r["crc"]), []).append((s, slot))
    return {k: sorted(v) for k, v in out.items()}


@pytest.mark.parametrize(("seed", "shards"), [(0, 5), (1, 9)])
def test_shards_equal_plain_loops(spark, seed, shards):
    rng = random.Random(seed)
    texts = [f"t{rng.randrange(30)}" if rng.random() < 0.6 else f"own {i}" for i in range(150)] + ["hot"] * 70 + [None, ""]
    frame = spark.createDataFrame([(i, t, "s", 1) for i, t in enumerate(texts)] + [(3, "again", "s", 1)] * 2 + [(None, "hot", "s", 1)], DOCS)
    got = {}
    for r in sharding.shard_documents(frame, shards=shards).collect():
        got.setdefault((r["doc_id"], r["text_crc32"]), []).append((r["shard"], r["slot"]))
    assert {k: sorted(v) for k, v in got.items()} == brute_shards(spark, frame, shards)


def water(sizes, weights, total):
    target = dict.fromkeys(sizes, 0.0)
    free = set(sizes)
    while free:
        left = total - sum(2 * sizes[s] for s in sizes if s not in free)
        level = left / sum(weights[s] for s in free)
        over = {s for s in free if weights[s] * level > 2 * sizes[s] + 1e-9}
        if not over:
            break
        free -= over
    return {s: weights[s] * level if s in free else 2 * sizes[s] for s in target}


def test_mix(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(["w"] * rng.randint(0, 30)), rng.choice(["a", "b", "c", "ä", None, "hot", "hot", "hot", "hot"]), i) for i in range(900)]
    rows += [(5000, None, "a", 1), (5001, "", "empty", 1), (1, "w w", "a", 1), (1, "w w", "a", 1), (None, "w", "a", 1)]
    frame = spark.createDataFrame(rows, DOCS)
    out = mixing.mix(frame, mixing.word_count(mixing.F.col("text")), mixing.F.lit(None)).collect()
    assert len(out) == len(rows) and all(r["taken"] <= 2 * r["size"] for r in out)
    sizes, taken, target = {}, {}, {}
    for r in out:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        target[r["source"]] = r["target"]
    names = sorted(s for s in sizes if s is not None) + [None]
    expected = water(sizes, {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}, 1.5 * sum(sizes.values()))
    assert all(abs(target[s] - expected[s]) < 1e-6 and abs(taken[s] - target[s]) <= 2 for s in names)
    again = mixing.mix(frame, mixing.word_count(mixing.F.col("text")), mixing.F.lit(None)).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))
    assert mixing.mix(frame.limit(0), mixing.word_count(mixing.F.col("text"))).count() == 0


def test_heavier_documents_are_taken_more_often(spark):
    rows = [(i, "w w w w", "a" if i % 2 else "b", i % 4) for i in range(2000)]
    out = mixing.mix(spark.createDataFrame(rows, DOCS), mixing.F.lit(4), mixing.F.when(mixing.F.col("bucket") < 2, 3.0).otherwise(1.0), weights=(1, 3)).collect()
    less = {r["doc_id"]: r["taken"] for r in out if r["source"] == "b"}
    more = {r["doc_id"]: r["taken"] for r in out if r["source"] == "a"}
    for taken in (more, less):
        heavy = [v for d, v in taken.items() if d % 4 < 2]
        light = [v for d, v in taken.items() if d % 4 >= 2]
        if sum(taken.values()) % (4 * len(taken)):
            assert sum(heavy) / len(heavy) > sum(light) / len(light)


def test_mixed_documents_with_repeated_rows_and_clashing_names(spark):
    rows = [(i, "w " * (1 + i % 7), f"s{i % 2}", i, i) for i in range(60)] + [(7, "same words here", "s1", 1, 1)] * 40 + [(7, "same words here", "s1", 2, 1)] * 3 + [(90, "w " * 100_000, "s0", 0, 0), (91, None, None, 0, 0)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, key int, copies int")
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, quality int")
    out = mixing.mixed_documents(frame, labels)
    assert out.columns == frame.columns
    sizes, got = {}, {}
    for r in rows:
        sizes[r[2]] = sizes.get(r[2], 0) + len((r[1] or "").split())
    for r in out.collect():
        assert tuple(r) in rows
        got[r["source"]] = got.get(r["source"], 0) + len((r["text"] or "").split())
    expected = water({s: sizes[s] for s in ("s0", "s1")}, {"s0": 3, "s1": 1}, 1.5 * sum(sizes.values()))
    assert abs(got["s1"] - expected["s1"]) <= 3 and abs(got["s0"] - expected["s0"]) <= 100_000
    assert mixing.mixed_documents(frame.limit(0), labels).count() == 0


def test_scratch_tables_are_in_the_shared_folder(spark):
    out = scratch(spark.range(5), "t")
    assert out._scratch_path.startswith(shared_dir(spark)) and out.count() == 5
    assert "broadcast" in sized_broadcast(out, 10)._jdf.queryExecution().logical().toString().lower()
    assert "broadcast" not in sized_broadcast(out, 3)._jdf.queryExecution().logical().toString().lower()
