"""Phrases, near-duplicate embeddings and centroids against brute force and DuckDB, with edge cases."""

import contextlib
import hashlib
import math
import os
import random
import re
import threading
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from epispark.llm import centroids, embeddings, phrases, queries
from epispark.llm.common import session_defaults


@pytest.fixture(autouse=True)
def defaults(spark):
    session_defaults(spark)


def plain(rows):
    """Rows as plain values, sorted."""
    return sorted((tuple(r) for r in rows), key=repr)


# 11 Phrases


def counted(rows, least, most, top):
    """Collocations by the contract's words, from (lang, text)."""
    f, n = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for i in range(len(words)):
                for k in range(1, most + 1):
                    if i + k <= len(words):
                        f.setdefault(lang, Counter())[tuple(words[i : i + k])] += 1
    out = []
    for lang, counts in f.items():
        found = {w: a for w, a in counts.items() if len(w) > 1 and a >= least}
        kept = []
        for w, a in found.items():
            cuts = [(2_000_000 * a // (counts[w[:k]] + counts[w[k:]]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            inside = any(len(v) > len(w) and 100 * b >= 80 * a and any(v[i : i + len(w)] == w for i in range(len(v))) for v, b in found.items())
            if not inside:
                kept.append((-score, -a, " ".join(w).encode(), counts[w[:k]], counts[w[k:]]))
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -score) for i, (score, a, p, l, r) in enumerate(sorted(kept)[:top])]
    return sorted(out)


def corpus():
    rnd = random.Random(4)
    words = ["Red", "river", "stone", "été", "ÉTÉ", "a-b", "New", "york", "city", "hall", "#1", "😀"]
    texts = [(rnd.choice(["en", "de", None, "und"]), "".join(rnd.choice(words) + rnd.choice([" ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", "!?"]) for _ in range(rnd.randint(0, 60)))) for _ in range(150)]
    texts += [("en", "New York City Hall " * 30), ("de", None), (None, ""), ("fr", "new york. " * 40), ("en", "x" * 5000 + " " + "y" * 5000), ("en", "one two " * 20_000), ("", " \t "), ("fr", "no\x85break no\x85break")]
    return texts + texts[:20]


def test_phrases_equal_brute_force_and_sql(spark, tmp_path):
    rows = corpus()
    df = spark.createDataFrame([(i, *r, "x", 1) for i, r in enumerate(rows)], "doc_id long, lang string, text string, phrase string, n int").repartition(4)
    for least, most, top in ((3, 4, 2000), (5, 3, 7), (2, 2, 50)):
        got = phrases.mine_phrases(df, least=least, most=most, top=top).collect()
        assert sorted(tuple(r) for r in got) == counted(rows, least, most, top)
    df.select("doc_id", "lang", "text").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op11_phrases(spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(queries.OP11_SQL)
    assert sorted(got.columns) == sorted(want.columns) and plain(got.select(*want.columns).collect()) == plain(want.fetchall())
    assert got.count() == len(counted(rows, 30, 4, 2000)) > 0


def test_phrases_of_nothing(spark):
    empty = spark.createDataFrame([], "lang string, text string")
    assert phrases.mine_phrases(empty).count() == 0
    assert phrases.mine_phrases(spark.createDataFrame([("en", "a b"), (None, None)], empty.schema)).count() == 0
    with pytest.raises(ValueError):
        phrases.mine_phrases(empty, most=1)


def test_colliding_keys_are_made_again(spark, monkeypatch):
    rows = [("en", "red river red stone " * 3)]
    df = spark.createDataFrame(rows, "lang string, text string")
    made, seeds = phrases.count_words, []

    def colliding(docs, seed):
        seeds.append(seed)
        out = made(docs, seed)
        return out.withColumn("key", out["key"] * 0) if seed == 0 else out

    monkeypatch.setattr(phrases, "count_words", colliding)
    got = phrases.mine_phrases(df, least=2).collect()
    assert seeds == [0, 1] and sorted(tuple(r) for r in got) == counted(rows, 2, 4, 2000)


def test_cutter_finds_words_as_a_pattern_does():
    rnd = random.Random(9)
    texts = ["".join(rnd.choice("aB é.\n\t,😀 z") for _ in range(rnd.randint(0, 40))) for _ in range(300)]
    seen = {}
    cutter = phrases.Cutter(0)
    for low, starts, ends, keys, pieces, rows in cutter.chunks(pa.array(["skipped", *texts], pa.string())[1:], ["en"] * 300):
        for s, e, k, piece, row in zip(starts, ends, keys, pieces, rows):
            word = bytes(low[s:e]).decode()
            seen.setdefault(row, {}).setdefault(piece, []).append(word)
            assert seen.setdefault(("key", word), k) == k
    for i, t in enumerate(texts):
        pieces = [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", t.replace("B", "b"))]
        assert list(seen.get(i, {}).values()) == [p for p in pieces if p]


# 12 Embeddings


def linked(rows, similarity=0.93):
    """(id, n_links, component_id, kept) from (id, vector, label), by comparing all pairs."""
    ok = [v is not None and lab is not None and len(v) > 0 and all(c is not None and math.isfinite(c) for c in v) and any(v) for _, v, lab in rows]
    links = [set() for _ in rows]
    unit = [np.array(v, float) / np.linalg.norm(np.array(v, float) / max(map(abs, v))) / max(map(abs, v)) if o else None for (_, v, _), o in zip(rows, ok)]
    for i in range(len(rows)):
        for j in range(i):
            if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= similarity:
                links[i].add(j), links[j].add(i)
    out, seen = [None] * len(rows), set()
    for i in range(len(rows)):
        if i not in seen:
            part, todo = {i}, [i]
            while todo:
                for k in links[todo.pop()] - part:
                    part.add(k), todo.append(k)
            seen |= part
            ids = [rows[k][0] for k in part if rows[k][0] is not None]
            for k in part:
                least = min(ids) if ids else None
                out[k] = (rows[k][0], len(links[k]), least, rows[k][0] is not None and rows[k][0] == least)
    return out


def vectors():
    rng = np.random.default_rng(6)
    base = rng.normal(size=(60, 16))
    rows = [(base[i], int(i % 3)) for i in range(60)]
    for i in range(0, 12):  # near copies, chains, copies, scaled copies
        rows += [(base[i] + rng.normal(0, 0.12, 16) * np.linalg.norm(base[i]) / 4, i % 3) for _ in range(12)]
    rows += [(base[1], 1)] * 9 + [(base[1] * 3, 1), (base[1] * 1e-300, 1), (base[2], 0)]
    rows = [(v.tolist(), lab) for v, lab in rows]
    bad = [float("nan")] * 16, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, [0.0] * 16, None, []
    rows += [(v, 1) for v in bad] * 2 + [(base[1].tolist(), None), (base[1][:8].tolist(), 1), (base[1][:8].tolist(), 1), ([1e308] * 16, 2), ([1e308] * 16, 2), ([-0.0] + [1.0] * 15, 2), ([0.0] + [1.0] * 15, 2)]
    ids = list(range(len(rows)))
    rng.shuffle(ids)
    out = [(None if i % 17 == 0 else i, *r) for i, r in zip(ids, rows)]
    return out + out[:5]


SCHEMA = "vec_id long, embedding array<double>, label int"


@pytest.mark.parametrize("sizes", [None, (40, 8, 16)])
def test_embeddings_equal_brute_force(spark, monkeypatch, sizes):
    if sizes:  # many rounds, leaves and blocks
        for name, value in zip(("GROUP", "LEAF", "BLOCK"), sizes):
            monkeypatch.setattr(embeddings, name, value)
    rows = vectors()
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as n_links", "'x' as node", "2 as id", "3 as u").repartition(5)
    assert plain(embeddings.near_embeddings(df).collect()) == plain(linked(rows))


def test_embeddings_of_one_dense_group(spark, monkeypatch):
    """More near copies than a group holds, which no split divides: balls, then blocks of their centres."""
    for name, value in (("GROUP", 64), ("LEAF", 16), ("BLOCK", 32)):
        monkeypatch.setattr(embeddings, name, value)
    rng = np.random.default_rng(2)
    centre = rng.normal(size=24)
    for spread in (0.05, 0.35):
        rows = [(i, (centre + rng.normal(0, spread, 24)).tolist(), 0) for i in range(500)]
        got, want = plain(embeddings.near_embeddings(spark.createDataFrame(rows, SCHEMA)).collect()), plain(linked(rows))
        if spread == 0.05:
            assert got == want
        else:  # leaves of 16 in one cloud: most links are near the threshold
            assert sum(r[1] for r in got) >= 0.998 * sum(r[1] for r in want) and [r[2:] for r in got] == [r[2:] for r in want]


def test_embeddings_recall_near_the_threshold(spark, monkeypatch):
    for name, value in (("GROUP", 256), ("LEAF", 64)):
        monkeypatch.setattr(embeddings, name, value)
    rng = np.random.default_rng(3)
    base = rng.normal(size=(1500, 64))
    base /= np.linalg.norm(base, axis=1)[:, None]
    away = rng.normal(size=(1500, 64))
    away -= (away * base).sum(axis=1)[:, None] * base
    away /= np.linalg.norm(away, axis=1)[:, None]
    cosine = rng.uniform(0.9301, 0.94, 1500)[:, None]
    pairs = np.concatenate([base, cosine * base + np.sqrt(1 - cosine**2) * away])
    got = embeddings.near_embeddings(spark.createDataFrame([(i, v.tolist(), 7) for i, v in enumerate(pairs)], SCHEMA)).toPandas()
    assert got["n_links"].sum() >= 0.99 * 3000
    alone = embeddings.near_embeddings(spark.createDataFrame([(i, v.tolist(), i) for i, v in enumerate(pairs[:50])], SCHEMA)).toPandas()
    assert (alone["n_links"] == 0).all() and alone["kept"].all()


def test_embeddings_in_parts_and_beside_the_threshold(spark, monkeypatch):
    """Many parts and slices; pairs, also of members of balls, that 16 bits can't tell from the threshold."""
    for name, value in (("GROUP", 48), ("BLOCK", 16), ("PART", 1), ("ROWS", 100)):
        monkeypatch.setattr(embeddings, name, value)
    rng = np.random.default_rng(8)
    rows, made = vectors(), []
    for k in range(80):
        a = rng.normal(size=16)
        a /= np.linalg.norm(a)
        b = rng.normal(size=16)
        b -= b @ a * a
        b /= np.linalg.norm(b)
        cosine = 0.93 + (1 - 2 * (k % 2)) * 10.0 ** -(5 + k % 8)
        made += [(a, k % 3), (cosine * a + np.sqrt(1 - cosine**2) * b, k % 3)]
        if k % 4 < 2:  # with a ball around it
            made += [(a + rng.normal(0, 0.01, 16), k % 3) for _ in range(3)]
    cloud = rng.normal(size=16)
    made += [(cloud + rng.normal(0, 0.02, 16), 5) for _ in range(150)]
    rows += [(1000 + i, v.tolist(), lab) for i, (v, lab) in enumerate(made)]
    assert plain(embeddings.near_embeddings(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()) == plain(linked(rows))


def test_embeddings_need_little_disk(spark, monkeypatch, tmp_path):
    """A deep forest has dozens of copies of each vector, which must not lie on disk at once: staged tables and shuffle files stay under 4 x input."""
    for name, value in (("GROUP", 64), ("LEAF", 16), ("ROWS", 1000)):
        monkeypatch.setattr(embeddings, name, value, raising=False)
    rng = np.random.default_rng(5)
    many, width = 6000, 64
    pq.write_table(pa.table({"vec_id": np.arange(many), "embedding": list(rng.normal(size=(many, width))), "label": np.arange(many) % 3}), f"{tmp_path}/embeddings.parquet")
    df = spark.read.parquet(f"{tmp_path}/embeddings.parquet")
    folders = [spark.sparkContext.getCheckpointDir().removeprefix("file:"), *spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()]

    def used():
        total = 0
        for folder in folders:
            for d, _, names in os.walk(folder):
                for n in names:
                    with contextlib.suppress(OSError):
                        total += os.path.getsize(f"{d}/{n}")
        return total

    begun, most, over = used(), [0], threading.Event()

    def watch():
        while not over.wait(0.1):
            most[0] = max(most[0], used() - begun)

    thread = threading.Thread(target=watch)
    thread.start()
    try:
        assert embeddings.near_embeddings(df).count() == many
    finally:
        over.set(), thread.join()
    assert 0 < most[0] < 4 * many * width * 8


def test_embeddings_of_nothing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert embeddings.near_embeddings(empty).count() == 0
    assert plain(embeddings.near_embeddings(spark.createDataFrame([(3, None, 1), (None, [0.0], 1)], SCHEMA)).collect()) == plain([(3, 0, 3, True), (None, 0, None, False)])
    with pytest.raises(ValueError):
        embeddings.near_embeddings(empty, similarity=1.0)


# 13 Centroids


def clustered(rows, k, rounds, width, seed=3, scale=1024):
    """The contract's steps in plain whole numbers, from (id, vector)."""
    kept = [(i, [math.floor(scale * float(c)) for c in v]) for i, v in rows if v is not None and len(v) == width and all(c is not None and math.isfinite(c) for c in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{'null' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    points = [q for _, q in order[:k]]
    near = lambda q: min((sum((a - b) ** 2 for a, b in zip(q, p)), c) for c, p in enumerate(points))
    for _ in range(rounds):
        groups = {}
        for _, q in kept:
            groups.setdefault(near(q)[1], []).append(q)
        points = [[sum(x) // len(groups[c]) for x in zip(*groups[c])] if c in groups else p for c, p in enumerate(points)]
    placed = [(i, *near(q)) for i, q in kept]
    inertia = Counter()
    for _, d, c in placed:
        inertia[c] += d
    return [(i, c, d, inertia[c], sum(inertia.values()), hashlib.sha256(",".join(map(str, points[c])).encode()).hexdigest()) for i, d, c in placed]


def test_centroids_equal_plain_integers(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(0, 1 + i % 3, 5).tolist()) for i in range(300)] + [(i, [0.25 * (i % 2)] * 5) for i in range(300, 330)]  # ties
    rows += [(1, rows[1][1]), (None, [0.5] * 5), (None, [-0.5] * 5), (400, None), (401, [1.0] * 4), (402, [1.0] * 6), (403, [None] + [1.0] * 4), (404, [float("nan")] * 5), (405, [float("inf")] * 5), (406, [-1e-9] * 5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as cluster", "2 as id", "3 as q").repartition(4)
    for k, rounds in ((8, 10), (40, 3), (1, 2), (1000, 1)):
        assert plain(centroids.cluster(df, k=k, rounds=rounds, width=5).collect()) == plain(clustered(rows, k, rounds, 5)), k


def test_centroids_equal_sql(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = [(i, v.astype(np.float32).tolist(), 0) for i, v in enumerate(rng.normal(0, 0.2, (200, 64)))]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    for query, sql in ((queries.op13_centroids, queries.OP13_SQL), (queries.op12_embeddings, queries.OP12_SQL)):
        got, want = query(spark, str(tmp_path)), con.sql(sql)
        assert sorted(got.columns) == sorted(want.columns) and plain(got.select(*want.columns).collect()) == plain(want.fetchall())


def test_tree_finds_the_nearest_with_fewer_distances():
    rng = np.random.default_rng(0)
    points = rng.integers(-1000, 1000, (400, 3))
    points[200:210] = points[100:110]  # equal centroids: the smaller number counts
    x = np.concatenate([rng.integers(-1000, 1000, (1000, 3)), points])
    tree, visits = centroids.build(points), []
    where, best = centroids.nearest(tree, x, visits)
    away = ((x[:, None] - points) ** 2).sum(axis=2)
    assert (best == away.min(axis=1)).all() and (where == away.argmin(axis=1)).all()
    assert sum(visits) < 0.3 * away.size
    huge = points * 100_000  # where roots are not exact
    where, best = centroids.nearest(centroids.build(huge), huge[::-1].copy())
    assert (best == 0).all() and (huge[where] == huge[::-1]).all()


def test_centroids_at_the_edges(spark):
    schema = "vec_id long, embedding array<double>"
    assert centroids.cluster(spark.createDataFrame([], schema), width=2).count() == 0
    assert centroids.cluster(spark.createDataFrame([(1, None)], schema), width=2).count() == 0
    few = [(7, [1.0, 2.0]), (9, [3.0, 4.0])]
    assert plain(centroids.cluster(spark.createDataFrame(few, schema), width=2).collect()) == plain(clustered(few, 8, 10, 2))
    with pytest.raises(Exception, match="too large"):
        centroids.cluster(spark.createDataFrame([(1, [1e9, 0.0])], schema), width=2).count()
    with pytest.raises(ValueError):
        centroids.cluster(spark.createDataFrame(few, schema), k=0, width=2)
