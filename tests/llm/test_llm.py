"""The corpus operators against plain Python, libraries and exact round trips, with edge cases."""

import hashlib
import math
import os
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from epispark.llm import bpe, exact_dedup, fingerprints, line_dedup, metric_join, mixing, near_dedup, pii, quality, toxicity, urls
from epispark.llm.common import bit_filter, may_hold, session_defaults

SPACE = r"[^\x20\x09-\x0D]+"


@pytest.fixture(autouse=True)
def defaults(spark):
    session_defaults(spark)


def frame(spark, texts, parts=3):
    """Texts with ids, an extra column and one whose name clashes with an output."""
    rows = [(i, t, "x", f"s{i}") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, spans string, source string").repartition(parts)


EDGE = [None, "", " ", "a", "a", "A b", "x" * 5000, "one two three " * 2000, "Σίσυφος été <|endoftext|> 12,5", None, "a"]


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


# 1 BPE


def test_bpe_equals_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    path = bpe.default_tokenizer()
    library = tokenizers.Tokenizer.from_file(path)
    rnd = random.Random(1)
    pieces = list("abcdefghijklmnop'0123456789 \n.,!?") + ["é", "ß", "İ", "Σ", "中", "😀", "<|endoftext|>", "\x1c", "\u0301", "'s", "'re", "the", "ing", "\xa0", "ا", "क"]
    texts = EDGE + ["".join(rnd.choice(pieces) for _ in range(rnd.randint(0, 60))) for _ in range(800)]
    got = {r.doc_id: r for r in bpe.round_trip(frame(spark, texts), path).collect()}
    for i, t in enumerate(texts):
        want = library.encode(t or "", add_special_tokens=False).ids
        assert got[i].ids == want
        assert got[i].decoded == library.decode(want, skip_special_tokens=False)
    assert bpe.round_trip(empty(spark), path).count() == 0


def test_words_are_encoded_once_and_kept_in_bounded_memory(monkeypatch):
    text = bpe.read_tokenizer(bpe.default_tokenizer())
    words = [f"{a}{b}{c}" for a in ("Qu", "th", "zor") for b in ("ble", "xi", "ou") for c in ("ntsh", "ing", "qq")]
    line = " ".join(x for w in words for x in (w, w.upper(), w + ".", f"({w},"))
    tokenizer, calls = bpe.Tokenizer(text), []
    encode = tokenizer.automaton.encode
    monkeypatch.setattr(tokenizer.automaton, "encode", lambda w: calls.append(w) or encode(w))
    whole = tokenizer.encode_bytes(line)
    assert len(calls) == len(set(calls)) == len({w.lower() for w in words}) + len({".", "(", ","})
    monkeypatch.setattr(bpe, "_CACHED_WORDS", 8)
    small = bpe.Tokenizer(text)
    assert small.encode_bytes(line + " " + line) == whole + whole
    assert max(len(x) + len(x.older) for x in (small.chunk_ids, small.word_ids)) <= 8


def test_automaton_equals_merging_by_hand():
    merges = [("a", "b"), ("a", "a"), ("ab", "c"), ("aa", "b"), ("b", "c"), ("aa", "abc")]
    base = ["a", "b", "c", "a</w>", "b</w>", "c</w>"]
    ends = [("a", "b</w>"), ("b", "c</w>"), ("aa", "a</w>")]
    vocab = {t: i for i, t in enumerate(dict.fromkeys(base + [u + v for u, v in merges + ends]))}
    rank = {m: i for i, m in enumerate(merges + ends)}
    machine = bpe.Automaton(vocab, merges + ends)
    rnd = random.Random(2)
    for _ in range(3000):
        word = "".join(rnd.choice("abc") for _ in range(rnd.randint(1, 12)))
        parts = list(word[:-1]) + [word[-1] + "</w>"]
        while len(parts) > 1 and (best := min(((rank.get(p, 99), i) for i, p in enumerate(zip(parts, parts[1:])))))[0] < 99:
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        assert machine.encode(word) == [vocab[p] for p in parts], word


# 2 mixing


def test_raking_meets_the_targets_and_sampling_the_rate(spark):
    rnd = random.Random(4)
    rows = [(i, " ".join(["w"] * rnd.randint(1, 50)), rnd.choice(["a", "a", "a", "b", None]), rnd.choice("xyz")) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    targets = {"source": spark.createDataFrame([("a", 0.5), ("b", 0.3), ("(none)", 0.2)], "source string, target double"), "lang": spark.createDataFrame([("x", 0.2), ("y", 0.2), ("z", 0.6)], "lang string, target double")}
    out = mixing.mix_sources(df, dimensions={"source": F.col("source"), "lang": F.col("lang")}, targets=targets, keep=0.4).toPandas()
    assert len(out) == 3000 and out.mix_weight.sum() == pytest.approx(1, abs=1e-6)
    assert out.groupby("lang").mix_weight.sum().to_dict() == pytest.approx({"x": 0.2, "y": 0.2, "z": 0.6}, abs=1e-5)
    assert out[out.source.isna()].mix_weight.sum() == pytest.approx(0.2, abs=1e-5)
    tokens = out.text.str.split().str.len()
    assert (tokens * out.mix_probability).sum() == pytest.approx(0.4 * tokens.sum(), rel=1e-6)
    assert (tokens * out.mix_kept).sum() == pytest.approx(0.4 * tokens.sum(), rel=0.1)
    # the same fit in numpy
    cells = defaultdict(float)
    for (_, t, s, g) in rows:
        cells[s or "(none)", g] += len(t.split())
    w = {k: v / sum(cells.values()) for k, v in cells.items()}
    aims = [{"a": 0.5, "b": 0.3, "(none)": 0.2}, {"x": 0.2, "y": 0.2, "z": 0.6}]
    for _ in range(40):
        for d, aim in enumerate(aims):
            m = Counter()
            for k, v in w.items():
                m[k[d]] += v
            w = {k: v * aim[k[d]] / m[k[d]] for k, v in w.items()}
    got = out.assign(source=out.source.fillna("(none)")).groupby(["source", "lang"]).mix_weight.sum().to_dict()
    assert got == pytest.approx(w, abs=1e-5)


def test_mixing_edges(spark):
    df = frame(spark, EDGE).withColumn("lang", F.lit(None).cast("string"))
    assert mixing.mix_sources(df).count() == len(EDGE)
    assert mixing.mix_sources(df.limit(0)).count() == 0


# 3 line dedup


def _full(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(q[-1] + 1, p[j] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


def _edited(rnd, s, k, alphabet="abc"):
    b = list(s)
    for _ in range(k):
        q = rnd.randint(0, len(b))
        c = rnd.random()
        if c < 0.34 or not b:
            b.insert(q, rnd.choice(alphabet))
        elif c < 0.67:
            del b[min(q, len(b) - 1)]
        else:
            b[min(q, len(b) - 1)] = rnd.choice(alphabet)
    return "".join(b)


def test_edit_distance_and_keys():
    rnd = random.Random(1)
    for _ in range(6000):
        a = "".join(rnd.choice("abc") for _ in range(rnd.randint(0, 12)))
        b, most = _edited(rnd, a, rnd.randint(0, 5)), rnd.randint(0, 4)
        d = _full(a, b)
        assert line_dedup.edit_distance(a, b, most) == min(d, most + 1)
        if d <= 2 and min(len(a), len(b)) > 2:
            assert line_dedup.line_keys(a, 2) & line_dedup.line_keys(b, 2)


def test_line_dedup_equals_brute_force(spark):
    rnd = random.Random(6)
    base = ["".join(rnd.choice("abcdefgh ") for _ in range(rnd.randint(8, 30))) for _ in range(40)]
    lines = base + [_edited(rnd, rnd.choice(base), rnd.randint(0, 4), "abcdefgh ") for _ in range(120)] + ["short", "short"]
    texts = [None, "", "\n\n"] + ["\n".join(rnd.choice(lines) for _ in range(rnd.randint(1, 6))) for _ in range(60)]
    got = {r.doc_id: r for r in line_dedup.dedup_lines(frame(spark, texts), threshold=2, min_chars=8).collect()}
    first = {}
    for i, t in enumerate(texts):
        for x in (t or "").split("\n"):
            if len(x) >= 8:
                first.setdefault(x, i)
    keys = list(first)
    parent = {x: x for x in keys}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(keys):
        for b in keys[:i]:
            if abs(len(a) - len(b)) <= 2 and _full(a, b) <= 2:
                parent[root(a)] = root(b)
    best = {}
    for x in keys:
        r = (first[x], line_dedup.line_hash(x))
        if root(x) not in best or r < best[root(x)][0]:
            best[root(x)] = (r, x)
    for i, t in enumerate(texts):
        out, seen = [], set()
        for x in (t or "").split("\n"):
            if len(x) >= 8:
                if best[root(x)][1] != x or first[x] != i or x in seen:
                    continue
                seen.add(x)
            out.append(x)
        assert (got[i].text or "") == "\n".join(out), i
        assert got[i].n_dropped == len((t or "").split("\n")) - len(out)
    assert got[0].text is None
    assert line_dedup.dedup_lines(empty(spark)).count() == 0


def test_line_dedup_takes_short_lines(spark):
    """Equal lines go at any length, near ones by edits in proportion to their length; copies leave no stub."""
    long = "a line of more than forty characters stands here"
    texts = [
        f"All rights reserved.\n{long}\n\nok\nok",
        f"All rights reserved.\n\nok\n{long}",  # a copy: all its lines go
        "All rights reserved!\nbut not this",  # 20 characters: one edit
        "All rights reservid!\nbut nod this",  # a chain's next; below 20 characters no edits
        "All rights withheld.",
        "\n \n",
        None,
        "x" * 39 + "\n" + "y" * 40,
        "x" * 40 + "\n" + "y" * 38 + "zz",  # 39 and 40: one edit; 40 and 40: two
        "x" * 37 + "zz\nvalue",  # 39: two edits are too many
    ]
    want = [f"All rights reserved.\n{long}\n\nok", "", "but not this", "but nod this", texts[4], "\n \n", None, texts[7], "", texts[9]]
    got = {r.doc_id: r for r in line_dedup.dedup_lines(frame(spark, texts)).collect()}
    assert [got[i].text for i in range(len(texts))] == want
    assert got[0].n_dropped == 1 and got[1].n_dropped == 3
    kept = {r.doc_id for r in line_dedup.dedup_lines(frame(spark, texts), drop_emptied=True).collect()}
    assert kept == {0, 2, 3, 4, 5, 6, 7, 9}


# 4 URL filters


def test_urls_equal_plain_python(spark):
    cases = [None, "", "no scheme", "http://NET", "http://a.NET/", "HTTP://x.example.net/en/1", "http://example.net/english", "http://example.net/en/", "https://a.b.example.com/de/x?q=1#f", "http://example.com/de", "http://v.org/fr/?a", "http://xorg/fr/", "http://org/fr/", "a://b://c/d", "http://u?x=/en/", "http://h#/", "http://ÄB.net/", "http://e.net/p#a?b"]
    df = spark.createDataFrame([(i, u, "keep") for i, u in enumerate(cases * 2)], "page_id long, url string, rule string")
    got = {r.page_id: r for r in urls.judge_rules(df).collect()}
    for i, u in enumerate(cases * 2):
        host = path = ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            host = re.match(r"[^/?#]*", rest).group()
            path = re.match(r"[^?#]*", rest[len(host) :]).group()
            host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
        fits = [r for r in urls.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = max(fits, key=lambda r: len(r.text), default=None)
        assert (got[i].host, got[i].path) == (host, path), u
        assert got[i].rule == (best.text if best else None), u
        assert got[i].verdict == (best.verdict if best else None), u


def test_url_trees_learn_labels(spark):
    rnd = random.Random(9)
    rows = []
    for i in range(600):
        bad = rnd.random() < 0.5
        host = f"{rnd.choice('abcdef')}{rnd.randint(0, 99999) if bad else ''}.site.test"
        rows.append((i, f"http://{host}/{'/'.join(['x'] * rnd.randint(1, 3))}{'?a=1&b=2&c=3' if bad else ''}", int(bad) if i % 3 else None))
    df = spark.createDataFrame(rows, "page_id long, url string, y int")
    got = {r.page_id: r.verdict for r in urls.filter_urls(df, rules=(), label_col="y").collect()}
    right = [got[i] == ("block" if "?" in u else "allow") for i, u, y in rows if y is None]
    assert sum(right) / len(right) > 0.95
    assert urls.filter_urls(df.limit(0)).count() == 0
    assert urls.filter_urls(spark.createDataFrame([(1, None)], "page_id long, url string")).first().verdict == "allow"


# 5 fingerprints


def test_next_document_and_edited_text(spark):
    texts = [f"text {i} " * (i % 7) for i in range(50)]
    df = spark.createDataFrame([(i * 3, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    for per_range in (4, 1000):
        got = {r.doc_id: r.next_text for r in fingerprints.with_next(df, "doc_id", ["text"], rows_per_range=per_range).collect()}
        assert got == {i * 3: texts[i - 1] if i else texts[-1] for i in range(50)}
    assert fingerprints.with_next(df.limit(0), "doc_id", ["text"]).count() == 0
    assert fingerprints.with_next(df.filter("doc_id = 3"), "doc_id", ["text"]).first().next_text == texts[1]


def test_fingerprints_tell_edits_from_others(spark):
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(3000)]
    texts = [" ".join(rnd.choice(words) for _ in range(rnd.randint(30, 300))) for _ in range(300)]
    lexicon = fingerprints.band_lexicon(frame(spark, texts))
    df = Counter(w for t in texts for w in set(t.split()))
    low, high = 300 * math.exp(-8), 300 * math.exp(-2)
    assert len(lexicon) == sum(max(2, low) <= n <= max(2, high) for n in df.values())
    h = fingerprints.BandHashes(lexicon)
    prints = [fingerprints.fingerprint(t, h) for t in texts]
    assert prints[0] == fingerprints.fingerprint(" ".join(reversed(texts[0].split())), h)
    near = [fingerprints.likeness(p, fingerprints.fingerprint(" ".join(t.split()[: len(t.split()) * 2 // 3]), h)) for p, t in zip(prints, texts)]
    far = [fingerprints.likeness(a, b) for a, b in zip(prints, prints[1:])]
    assert np.mean(near) > 0.4 and np.mean(far) < 0.1 and fingerprints.likeness(prints[0], prints[0]) == 1
    edge = fingerprints.add_fingerprints(frame(spark, EDGE), lexicon, {"text": "fp"}).orderBy("doc_id").collect()
    assert edge[0].fp == edge[1].fp == "e" and edge[3].fp == edge[4].fp


# 6 exact dedup


def test_exact_dedup_equals_brute_force(spark):
    rnd = random.Random(5)
    texts = EDGE + [rnd.choice(["a b", "a  b", "a\tb", "a b ", "c", "a\xa0b", ""]) for _ in range(200)]
    groups = defaultdict(list)
    for i, t in enumerate(texts):
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    got = {r.doc_id: r for r in exact_dedup.exact_dedup(frame(spark, texts), runs=8, fan_in=2).collect()}
    assert len(got) == len(texts)
    for t, ids in groups.items():
        for i in ids:
            assert (got[i].keep_id, got[i].group_size, got[i].kept, got[i].text_sha256) == (ids[0], len(ids), i == ids[0], hashlib.sha256(t.encode()).hexdigest())
    assert exact_dedup.exact_dedup(empty(spark)).count() == 0


# 7 n-gram Jaccard join


def _jaccard_components(texts, n, num, den):
    sets = []
    for t in texts:
        w = re.findall(SPACE, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets.append(frozenset([tuple(w)] if 0 < len(w) < n else [tuple(w[k : k + n]) for k in range(len(w) - n + 1)]))
    low = list(range(len(texts)))
    changed = True
    links = [(i, j) for i in range(len(texts)) for j in range(i) if sets[i] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j])]
    while changed:
        changed = False
        for i, j in links:
            m = min(low[i], low[j])
            changed |= low[i] != m or low[j] != m
            low[i] = low[j] = m
    return [(len(s), c) for s, c in zip(sets, low)]


@pytest.mark.parametrize("n, num, den", [(3, 9, 10), (5, 4, 5)])
def test_near_duplicates_equal_brute_force(spark, n, num, den):
    rnd = random.Random(3)
    vocabulary = [f"w{i}" for i in range(300)]
    texts = list(EDGE)
    for _ in range(14):
        base = [rnd.choice(vocabulary) for _ in range(rnd.choice([3, 12, 40, 100, 200]))]
        for _ in range(rnd.choice([1, 3, 12])):
            w = list(base)
            for _ in range(rnd.choice([0, 0, 1, 2, 4])):
                w[rnd.randrange(len(w))] = rnd.choice(vocabulary)
            texts.append(" ".join(w))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(frame(spark, texts), words=n, similarity=(num, den)).collect()}
    assert [got[i] for i in range(len(texts))] == _jaccard_components(texts, n, num, den)


def test_near_duplicates_link_rows_without_ids(spark):
    """Sets that only rows without an id have are pivots like others, and lose no link between rows with ids."""
    rnd = random.Random(11)
    rows, want = [], {}
    for g in range(12):
        base = [f"g{g}w{k}" for k in range(60)]
        edits = [list(base) for _ in range(3)]
        for e, k in zip(edits, (5, 30, 55)):
            e[k] = "edit"
        # the middle one has the id null: 60 words, each edit changes 3 of 58 shingles
        order = rnd.sample(range(3), 3)
        rows += [(None, " ".join(base)), (3 * g, " ".join(edits[order[0]])), (3 * g + 1, " ".join(edits[order[1]]))]
        want |= {3 * g: 3 * g, 3 * g + 1: 3 * g}
    rows += [(None, "no other has this text"), (None, "")]
    for words, similarity in ((3, (8, 10)), (3, (9, 10))):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
        got = near_dedup.near_duplicates(df, words=words, similarity=similarity).collect()
        assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == want
        assert sorted(str(r.component_id) for r in got if r.doc_id is None) == sorted([str(3 * g) for g in range(12)] + ["None"] * 2)


def test_pipeline_keeps_rows_without_ids(spark):
    import corpus_pipeline

    base = [f"w{k}" for k in range(80)]
    near = " ".join(base[:40] + ["edit"] + base[41:])
    other = " ".join(f"v{k}" for k in range(80))
    rows = [(7, " ".join(base)), (None, near), (None, other), (None, other), (None, other + " more"), (None, ""), (None, ""), (8, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r.doc_id, r.text) for r in corpus_pipeline.near_dedup(spark, docs, "").collect()]
    assert sorted(i for i, _ in got if i is not None) == [7, 8]
    alone = [t for i, t in got if i is None]
    assert len(alone) == 2 and "" in alone and near not in alone


def test_pipeline_decodes_what_it_encodes(spark):
    import corpus_pipeline

    docs = frame(spark, ["Two  words, été", None]).withColumn("lang", F.lit("en"))
    name, stage = corpus_pipeline.STAGES[-1]
    got = {r.doc_id: r for r in stage(spark, docs, "").collect()}
    assert name == "BPE encoding and decoding" and got[0].n_tokens == len(got[0].ids) > 0
    decode = bpe.Tokenizer(bpe.read_tokenizer(bpe.default_tokenizer())).decode
    assert all(r.decoded_sha256 == hashlib.sha256(decode(r.ids).encode()).hexdigest() for r in got.values())


def test_fitted_rows_are_bounded_with_repeated_ids(spark, monkeypatch):
    rows = [(1, f"bad words {k}") for k in range(40)] + [(k, f"good text {k}") for k in range(2, 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k == 1), k % 2) for k in range(1, 8)], "doc_id long, toxic int, quality int")
    seen = {}
    monkeypatch.setattr(toxicity, "fit_nnpu", lambda pos, unl, prior: seen.update(pos=len(pos), unl=len(unl)))
    toxicity.train_toxicity(docs, labels, unlabelled=5)
    monkeypatch.setattr(quality, "fit_network", lambda x, y: seen.update(quality=len(x)))
    quality.train_quality(docs, labels)
    assert seen == {"pos": 1, "unl": 5, "quality": 7}


def test_near_duplicates_of_nothing(spark):
    assert near_dedup.near_duplicates(empty(spark)).count() == 0


def test_signatures_meet_at_the_threshold():
    """Sets at the similarity limit always share a region, whatever their sizes."""
    rng = np.random.default_rng(8)
    for num, den in ((9, 10), (4, 5)):
        bands = near_dedup.Bands(num, den)
        for _ in range(1500):
            size = int(rng.integers(1, 400))
            a = np.unique(rng.integers(0, 2**64, size, dtype=np.uint64))
            extra = int(rng.integers(0, max(1, len(a) * (den - num) // num + 1)))
            lost = int(rng.integers(0, max(1, len(a) * (den - num) // den + 1)))
            b = np.unique(np.r_[rng.permutation(a)[lost:], rng.integers(0, 2**64, extra, dtype=np.uint64)])
            same = len(np.intersect1d(a, b))
            if len(b) and den * same >= num * (len(a) + len(b) - same) and not np.array_equal(a, b):
                assert np.intersect1d(near_dedup.signatures(a, bands), near_dedup.signatures(b, bands)).size


def _line_space(spark, at, length):
    """Points on a line: a sketch's first x bits are set, so sketches differ by the points' distance."""
    sketches = [(i, 0, np.packbits((np.arange(length) < x).astype(np.uint8), bitorder="little").tobytes()) for i, x in enumerate(at)]
    return spark.createDataFrame(sketches, "node long, n int, sk binary")


@pytest.mark.parametrize("cells, leaf", [(8, 8), (32, 64), (16, 1000), (1000, 1000)])
@pytest.mark.parametrize("scattered", [False, True])
def test_cells_windows_and_blocks_are_exact(spark, monkeypatch, cells, leaf, scattered):
    """One region: whatever its size, cells and windows, or blocks, must find every component and no more."""
    rnd = random.Random(12)
    if scattered:  # all far from each other but for some pairs: cells don't help
        rng = np.random.default_rng(3)
        codes = rng.integers(0, 2**64, (150, 16), dtype=np.uint64)
        codes = np.concatenate([codes, codes[:60] ^ np.eye(1, 16, dtype=np.uint64) * np.uint64(0b10110)])
        points = spark.createDataFrame([(i, 0, c.tobytes()) for i, c in enumerate(codes)], "node long, n int, sk binary")
        near = {(i, 150 + i) for i in range(60)}
        groups = [i if i < 150 else i - 150 for i in range(210)]
        within = lambda a, b: (a, b) in near
    else:
        at = sorted(rnd.sample(range(4096), 260))
        points = _line_space(spark, at, 4096)
        groups = np.cumsum(np.r_[0, np.diff(at) > 12]).tolist()
        within = lambda a, b: at[b] - at[a] <= 12
    star = spark.createDataFrame([(1, 0, i) for i in range(1, len(groups))], "region long, pivot long, node long")
    asked = []

    def verify(pairs):
        asked.extend(found := [(r.a, r.b) for r in pairs.collect()])
        return spark.createDataFrame([p for p in found if within(*p)], "a long, b long")

    split = []
    real = metric_join.voronoi
    monkeypatch.setattr(metric_join, "voronoi", lambda reach: split.append(1) or real(reach))
    monkeypatch.setattr(metric_join, "CELLS", cells)
    monkeypatch.setattr(metric_join, "LEAF", leaf)
    roots = metric_join.connect(star, points, lambda total: np.full_like(total, 12), verify)
    got = {r.node: r.root for r in roots.collect()}
    for g in set(groups):
        assert len({got.get(m, m) for m, x in enumerate(groups) if x == g}) == 1
    assert len({got.get(m, m) for m in range(len(groups))}) == len(set(groups))
    assert len(asked) == len(set(asked)) and bool(split) == (cells < 1000)


def test_one_cluster_sends_few_pairs(spark):
    """A region of near copies around a far pivot: pairs verified grow with its members, not with their square."""
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**64, 8, dtype=np.uint64)
    codes = [rng.integers(0, 2**64, 8, dtype=np.uint64)] + [base ^ (np.uint64(1) << rng.integers(0, 64, 8, dtype=np.uint64)) for _ in range(600)]
    points = spark.createDataFrame([(i, 0, c.tobytes()) for i, c in enumerate(codes)], "node long, n int, sk binary")
    star = spark.createDataFrame([(1, 0, i) for i in range(1, 601)], "region long, pivot long, node long")
    asked = []

    def verify(pairs):
        asked.append(pairs.count())
        return pairs

    roots = metric_join.connect(star, points, lambda total: np.full_like(total, 16), verify)
    assert roots.count() == 600 and roots.select("root").distinct().count() == 1
    assert sum(asked) <= 4 * 600


def test_sketches_never_exceed_the_distance():
    rng = np.random.default_rng(5)
    for _ in range(200):
        a = np.unique(rng.integers(0, 2**64, int(rng.integers(1, 900)), dtype=np.uint64))
        b = np.unique(np.r_[rng.permutation(a)[: int(rng.integers(0, len(a) + 1))], rng.integers(0, 2**64, int(rng.integers(1, 100)), dtype=np.uint64)])
        x, y = near_dedup.sketch_of(a), near_dedup.sketch_of(b)
        words = min(len(x), len(y)) // 8
        assert metric_join.bits_apart(metric_join.folded([x], words), metric_join.folded([y], words))[0] <= len(np.setxor1d(a, b))
    rnd = random.Random(6)
    for _ in range(500):
        a = "".join(rnd.choice("abcdefgh 中") for _ in range(rnd.randint(2, 60)))
        b = _edited(rnd, a, rnd.randint(0, 3), "abcdefgh ")
        x, y = (np.frombuffer(line_dedup.line_sketch(z), np.uint64) for z in (a, b))
        assert metric_join.bits_apart(x, y) <= 4 * _full(a, b)


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, i) for i in range(101, 130)] + [(200, 200)]
    got = {r.node: r.root for r in metric_join.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len({got[i] for i in range(31)}) == 1 and len({got[i] for i in range(100, 130)}) == 1 and got[0] != got[100] and 200 not in got


def _union(edges):
    parent = {}
    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x
    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {x: root(x) for x in parent}


def test_forest_equals_union_find(spark, monkeypatch):
    rng = np.random.default_rng(8)
    shapes = [rng.integers(-50, 50, (60, 2)), rng.integers(-(1 << 62), 1 << 62, (9, 2)), np.stack([np.arange(500), np.arange(1, 501)], 1)[::-1], np.array([[7, 7]]), np.array([[9, k] for k in range(9)])]
    for edges in shapes:
        root, node = metric_join.forest(edges[:, 0], edges[:, 1])
        want = _union(edges.tolist())
        assert dict(zip(node.tolist(), root.tolist())) == {x: r for x, r in want.items() if x != r}
    # a partition with more edges than a task holds sends stars on early, and loses no connection
    monkeypatch.setattr(metric_join, "EDGES", 20)
    edges = rng.integers(0, 300, (400, 2)).tolist()
    stars = metric_join.local_forest(spark.createDataFrame(edges, "a long, b long").coalesce(1)).collect()
    want = _union(edges)
    got = _union([(r.a, r.b) for r in stars])
    assert {x: got.get(x, x) for x in want} == want and len(stars) <= len(edges)
    found = {r.node: r.root for r in metric_join.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len({(found.get(x, x), r) for x, r in want.items()}) == len(set(want.values()))


def test_bit_filter_has_no_false_negatives(spark):
    bits = bit_filter(spark.range(5000).select((F.col("id") * 7919).alias("k")), "k").view(np.uint64)
    assert all(may_hold(bits, k) for k in range(0, 5000 * 7919, 7919))
    assert sum(may_hold(bits, k) for k in range(1, 5000 * 7919, 7919)) < 1000


# 8 personal data


def _luhn(s):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(s))) % 10 == 0


def test_pii_equals_plain_python(spark):
    patterns = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]

    def valid(kind, x):
        digits = re.sub("[^0-9]", "", x)
        return {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in x.split(".")), "card": lambda: 12 <= len(digits) <= 19 and _luhn(digits), "phone": lambda: 9 <= len(digits) <= 15}[kind]()

    rnd = random.Random(5)
    parts = ["a", "b@c.d", "@", ".", "1", "23", "255", "4111 1111 1111 1111", "+49 (0) 30 123456", "-", " ", "1.2.3.4", "é", "😀", "_", "%", "5555-5555-5555-4444", "+", "001.02.3.0300", "x@y.z_d@e.f", "\n"]
    texts = EDGE + ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 40))) for _ in range(1500)] + ["1" * 20000, "a." * 8000, "x@" + "a." * 8000 + "b"]
    for r in pii.find_pii(frame(spark, texts)).collect():
        want = sorted((m.start(), i, k, m.end()) for i, (k, p) in enumerate(patterns) for m in (re.finditer(p, texts[r.doc_id] or "") if r.doc_id < 1500 + len(EDGE) else ()) if valid(k, m.group()))
        if r.doc_id < 1500 + len(EDGE):
            assert [(s.start, s.kind, s.end) for s in r.spans if s["rank"] < 4] == [(a, k, e) for a, _, k, e in want]


def test_pii_added_kinds(spark):
    texts = ["IBAN DE89 3704 0044 0532 0130 00 ok", "DE89 3704 0044 0532 0130 01", "ssn: 123-45-6789", "part 123-45-6789", "mail me: a@b.co"]
    got = [{s.kind: s.score for s in r.spans} for r in pii.find_pii(frame(spark, texts)).orderBy("doc_id").collect()]
    assert got[0]["iban"] == pytest.approx(0.9) and "iban" not in got[1] and "ssn" in got[2] and "ssn" not in got[3] and got[4]["email"] == pytest.approx(1.0)


# 9 quality, 10 toxicity


def _prose(rnd, n, junk=False):
    words = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 7))) for _ in range(n)]
    return " ".join(w + "%%%" if junk else w for w in words)


def test_quality_held_out_accuracy(spark):
    rnd = random.Random(7)
    texts = [_prose(rnd, rnd.randint(5, 80), junk=i % 4 == 0) for i in range(600)] + EDGE
    docs = frame(spark, texts)
    labels = spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(0, 600, 2)], "doc_id long, quality int")
    scored = {r.doc_id: r.score for r in quality.score_quality(docs, quality.train_quality(docs, labels)).collect()}
    right = [(scored[i] >= 0.5) == (i % 4 != 0) for i in range(1, 600, 2)]
    assert len(scored) == len(texts) and all(0 <= s <= 1 for s in scored.values()) and sum(right) / len(right) > 0.95
    none = quality.train_quality(docs, labels.limit(0))
    assert quality.score_quality(docs, none).first().score == 0.5


def test_toxicity_from_positives_and_unlabelled(spark):
    rnd = random.Random(8)
    bad = ["grumble", "snarl", "hissing", "vile"]
    texts, truth = [], []
    for _ in range(1200):
        words = _prose(rnd, rnd.randint(20, 60)).split()
        toxic = rnd.random() < 0.2
        if toxic:
            for w in rnd.sample(bad, rnd.randint(1, 3)):
                words.insert(rnd.randrange(len(words)), w)
        texts.append(" ".join(words))
        truth.append(toxic)
    docs = frame(spark, texts + EDGE)
    labels = spark.createDataFrame([(i, int(t)) for i, t in enumerate(truth) if i % 2 == 0], "doc_id long, toxic int")
    scored = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, toxicity.train_toxicity(docs, labels)).collect()}
    held = range(1, 1200, 2)
    caught = [scored[i] >= 0.7 for i in held if truth[i]]
    false = [scored[i] >= 0.7 for i in held if not truth[i]]
    assert sum(caught) / len(caught) > 0.9 and sum(false) / len(false) < 0.02
    none = toxicity.train_toxicity(docs, labels.filter("toxic = 0"))
    assert max(r.score for r in toxicity.score_toxicity(docs, none).collect()) < 0.01


# the pipeline


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_pipeline_stages(spark):
    import corpus_pipeline as pipeline
    from epispark.llm.common import stage

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for i, (_, function) in enumerate(pipeline.STAGES):
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = stage(function(spark, docs, sf))
        ids = [r.doc_id for r in docs.select("doc_id").collect()]
        assert len(ids) == len(set(ids)) and set(ids) <= set(before)
        if i < len(pipeline.STAGES) - 1:
            assert docs.columns == columns
        if pipeline.STAGES[i][1] is pipeline.near_dedup:
            keys = sorted(before)
            want = _jaccard_components([before[k] for k in keys], 5, 4, 5)
            assert sorted(ids) == [k for j, k in enumerate(keys) if want[j][1] == j]
    assert {"n_tokens", "ids"} <= set(docs.columns) and docs.filter("n_tokens > 0").count() == docs.count()


def test_tasks_with_pivots_of_their_own_lose_no_pair(spark):
    """A region's tasks may have several pivots, and send a node twice: distances to different pivots are no window, sketches
    of different lengths neither, and two regions with the same nodes are told apart from two with different ones."""
    at = {0: 0, 1: 400, 2: 100, 3: 105, 4: 3000, 5: 2000, 6: 2005, 7: 2010, 8: 2500, 9: 2600}
    points = _line_space(spark, list(at.values()), 4096)
    star = [(1, 0, 1), (1, 0, 2), (1, 1, 3)]  # 2 is 100 from its pivot, 3 is 295 from its own
    star += [(2, 8, 5), (2, 9, 5), (2, 8, 6)] + [(3, 8, 6), (3, 8, 7), (3, 9, 7)]  # one node twice: hashes of copies cancel out
    starred = spark.createDataFrame(star, "region long, pivot long, node long")
    roots = metric_join.connect(starred, points, lambda total: np.full(len(total), 12, np.int32), lambda pairs: pairs)
    assert {(r.node, r.root) for r in roots.collect()} == {(2, 2), (3, 2), (5, 5), (6, 5), (7, 5)}
    code = np.random.default_rng(7).integers(0, 2**64, 16, dtype=np.uint64)
    uneven = [(0, 0, (~code).tobytes()), (1, 0, code.tobytes()), (2, 0, (code[:8] ^ code[8:]).tobytes())]
    points = spark.createDataFrame(uneven, "node long, n int, sk binary")
    starred = spark.createDataFrame([(1, 0, 1), (1, 0, 2), (1, 0, 3)], "region long, pivot long, node long")
    points = points.unionByName(spark.createDataFrame([(3, 0, (code ^ np.uint64(1)).tobytes())], "node long, n int, sk binary"))
    roots = metric_join.connect(starred, points, lambda total: np.full_like(total, 12), lambda pairs: pairs.filter("a > 0"))
    assert {r.node for r in roots.collect()} >= {1, 2, 3}


def test_finer_keys_are_shared_by_near_lines():
    rnd = random.Random(8)
    for _ in range(600):
        most, parts = rnd.choice((1, 2)), rnd.choice(line_dedup.FINER)
        a = "".join(rnd.choice("abcd é中") for _ in range(rnd.randint(most + 1, 80)))
        b = _edited(rnd, a, rnd.randint(0, most), "abcdx ")
        if len(b) > most:
            assert set(line_dedup.finer_keys(a, most, parts).tolist()) & set(line_dedup.finer_keys(b, most, parts).tolist()), (a, b)


def test_a_large_group_of_copies_with_other_words(spark, monkeypatch):
    """Lines that share segments but differ in words: all links are found, and what is joined grows with the lines."""
    rnd = random.Random(9)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(3, 7))) for _ in range(40)]

    def copy():
        out = list(words)
        for i in rnd.sample(range(40), 3):
            out[i] = "".join(rnd.choice("stuvwxyz") for _ in range(len(out[i])))
        return " ".join(out)

    dealt, real = [], metric_join.deal_blocks
    monkeypatch.setattr(metric_join, "deal_blocks", lambda placed: dealt.append(placed.count()) or real(placed))
    rows = {}
    for size in (300, 1200):
        lines = [copy() for _ in range(size)]
        near = [_edited(rnd, x, 2, "xyz") for x in lines[:50]]
        dealt.clear()
        got = line_dedup.dedup_lines(frame(spark, lines + near)).collect()
        rows[size] = sum(dealt)
        assert sum(r.n_dropped for r in got) == 50 and {r.doc_id for r in got if r.n_dropped} == set(range(size, size + 50))
    assert rows[1200] <= 6 * max(rows[300], 1500)


def test_pairs_measured_on_sketches_of_two_lengths_end(spark):
    """A pair that shares two regions, one of them with a shorter sketch, has two distances there, but is one candidate: where
    it is no link the join must end all the same."""
    rng = np.random.default_rng(11)
    far, code, other = (rng.integers(0, 2**64, 16, dtype=np.uint64) for _ in range(3))
    near = code.copy()
    near[[0, 8]] ^= np.uint64(1)  # two bits apart, none when folded
    sketches = [far, code, near, rng.integers(0, 2**64, 8, dtype=np.uint64), other]
    points = spark.createDataFrame([(i, 0, x.tobytes()) for i, x in enumerate(sketches)], "node long, n int, sk binary")
    starred = spark.createDataFrame([(1, 0, 1), (1, 0, 2), (1, 0, 4), (2, 0, 1), (2, 0, 2), (2, 0, 3)], "region long, pivot long, node long")
    asked = []

    def verify(pairs):
        asked.extend((r.a, r.b) for r in pairs.collect())
        return pairs.limit(0)

    assert metric_join.connect(starred, points, lambda total: np.full_like(total, 12), verify).isEmpty() and asked == [(1, 2)]
