"""Prefix tries, whitening and license notices against plain versions and on odd input."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from feldspark.llm import licenses, tries, whitening


# Prefix tries


def plain_nodes(told):
    """Nodes of {id: [(role, text)]}: first, parent's first, depth, members, children, leaves, saved and ids that end there."""
    through, ends = {}, {}
    for c, turns in told.items():
        for d in range(len(turns) + 1):
            through.setdefault(tuple(turns[:d]), []).append(c)
        ends.setdefault(tuple(turns), []).append(c)
    children = {p: 0 for p in through}
    for p in through:
        if p:
            children[p[:-1]] += 1
    leaves, saved = {p: 0 for p in through}, {p: 0 for p in through}
    for p, held in through.items():
        own = (len(held) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += children[p] == 0
            saved[p[:d]] += own
    return sorted(
        (min(h), min(through[p[:-1]]) if p else -1, len(p), len(h), children[p], leaves[p], saved[p], tuple(sorted(ends.get(p, ()))))
        for p, h in through.items()
    )


def random_conversations(seed=2, n=120):
    rng = random.Random(seed)
    said = [("user", "a b"), ("user", "c"), ("assistant", ""), ("assistant", "d e f"), ("", "x")]
    told = {}
    for c in range(n):
        if c % 3 == 0:  # a hot beginning
            told[c] = [said[0], said[3]] + [rng.choice(said) for _ in range(rng.randrange(0, 4))]
        elif c % 10 == 1:  # one conversation told over and over
            told[c] = [said[1]] * 9
        else:
            told[c] = [rng.choice(said) for _ in range(rng.randrange(1, 6))]
    told[n] = [("user", f"t{i}") for i in range(70)]
    told[n + 1] = told[n][:67] + [("user", "long " * 20_000)]
    told[n + 2] = told[n][:40]
    return told


def trie_rows(spark, told):
    rows = [(c, i, r or None, t or None, "n", "e") for c, turns in told.items() for i, (r, t) in enumerate(turns)]
    return spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, node string, end string").repartition(4)


def got_nodes(sequences, shard_turns):
    nodes, ends = tries.prefix_nodes(sequences, shard_turns)
    held = {}
    for r in ends.collect():
        held.setdefault(bytes(r["end"]), []).append(r["id"])
    rows = nodes.collect()
    digests = {bytes(r["end"]): r["sha256"] for r in tries.end_digests(ends).collect()}
    assert digests == {e: hashlib.sha256(",".join(map(str, sorted(i))).encode()).hexdigest() for e, i in held.items()}
    return sorted(
        (r["first"], -1 if r["parent_first"] is None else r["parent_first"], r["depth"], r["members"], r["children"], r["leaves"], r["saved"],
         tuple(sorted(held.get(bytes(r["node"]), ()))))
        for r in rows
    )


@pytest.mark.parametrize("shard_turns", [3, 40, 10_000])
def test_prefix_nodes(spark, monkeypatch, shard_turns):
    monkeypatch.setattr(tries, "BLOCK_BYTES", 10)
    told = random_conversations()
    assert got_nodes(tries.sequences(trie_rows(spark, told)), shard_turns) == plain_nodes(told)


def test_prefix_nodes_of_odd_turns(spark):
    rows = [
        (1, None, "user", "late id"), (1, 0, "user", "b"), (1, 0, "user", "b"), (2, 5, None, None), (2, 7, "", ""),
        (None, 1, "user", "nobody"), (3, 1, "us", "er x"), (4, 1, "use", "r x"),
    ]
    told = tries.sequences(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))
    expected = {1: [("user", "late id"), ("user", "b"), ("user", "b")], 2: [("", ""), ("", "")], 3: [("us", "er x")], 4: [("use", "r x")]}
    assert got_nodes(told, 2) == plain_nodes(expected)
    # Conversations without turns are members of the root.
    bare = told.where("id = 3").unionByName(told.where("id = 2").withColumn("turns", F.array().cast(tries.TURNS)))
    assert got_nodes(bare, 1) == plain_nodes({3: expected[3], 2: []})
    nodes, ends = tries.prefix_nodes(told.where(F.lit(False)))
    assert nodes.count() == 0 and ends.count() == 0 and tries.end_digests(ends).count() == 0


def test_double_array_finds_what_was_packed_and_nothing_else():
    rng = np.random.default_rng(4)
    lengths = rng.integers(0, 9, 400)
    at = np.concatenate(([0], np.cumsum(lengths)))[:-1]
    symbols = rng.integers(1, 60, lengths.sum())
    array = tries.packed(symbols, at, lengths, 60)
    wanted = {tuple(symbols[a : a + d]) for a, n in zip(at, lengths) for d in range(n + 1)}
    assert (array.check >= 0).sum() == len(wanted)
    states = {(): 0}
    for p in sorted(wanted, key=len):
        if p:
            states[p] = int(array.step(np.array([states[p[:-1]]]), np.array([p[-1]]))[0])
    assert len(set(states.values())) == len(wanted) and min(states.values()) == 0
    for p, s in states.items():
        for symbol in range(1, 61):
            assert (int(array.step(np.array([s]), np.array([symbol]))[0]) >= 0) == ((*p, symbol) in wanted)


# Whitening


def orthogonal(rng, n):
    q = np.linalg.qr(rng.normal(size=(n, n)))[0].astype(np.longdouble)
    for _ in range(4):
        q = q + q @ ((np.eye(n) - q.T @ q) / 2)
    return q


@pytest.mark.parametrize(
    "values,error",
    [
        (np.linspace(1, 100, 40), 1e-16),
        (np.r_[1 + 1e-9 * np.arange(6), np.linspace(5, 9, 30)], 1e-8),
        (10.0 ** np.linspace(-5, 5, 40), 1e-7),
    ],
)
def test_refined_eigenvectors(values, error):
    rng = np.random.default_rng(7)
    values = np.sort(values.astype(np.longdouble))[::-1]
    q = orthogonal(rng, len(values))
    a = (q * values) @ q.T
    found, vectors = whitening.refined_eigenvectors((a + a.T) / 2)
    assert np.abs(found - values).max() < 1e-17 * values[0]
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-17
    assert np.abs(vectors * np.sign((q * vectors).sum(axis=0)) - q).max() < error


def test_equal_eigenvalues_give_a_basis():
    values = np.r_[np.full(5, 3.0), 1.0, 0.0].astype(np.longdouble)
    q = orthogonal(np.random.default_rng(1), 7)
    a = (q * values) @ q.T
    a = (a + a.T) / 2
    found, vectors = whitening.refined_eigenvectors(a)
    assert np.abs(a @ vectors - vectors * found).max() < 1e-17 and np.abs(vectors.T @ vectors - np.eye(7)).max() < 1e-17
    assert (whitening.refined_eigenvectors(np.zeros((3, 3), np.longdouble))[0] == 0).all()


def test_products_are_exact():
    rng = np.random.default_rng(3)
    rows = rng.integers(-(2**20), 2**20, (50, 4))
    rows[7, 2] = 2**41
    whole = rows.astype(object)
    assert (whitening.exact_products(rows) == whole.T @ whole).all()


def vectors_of(spark, vectors, ids=None):
    ids = range(len(vectors)) if ids is None else ids
    rows = [(i, v, "w", 1) for i, v in zip(ids, vectors)]
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, white string, component int").repartition(3)


def plain_whitening(vectors, components):
    x = np.floor(1024 * np.array(vectors)).astype(np.int64) + 100_000
    n, total = len(x), x.sum(axis=0)
    departures = (n * x - total).astype(object)
    values, vectors = np.linalg.eigh(np.cov(x.T, bias=True))
    white = (x - total / n) @ vectors[:, ::-1][:, :components] / np.sqrt(values[::-1][:components])
    return (departures * departures).sum(axis=1), white, values[::-1][:components] / values.sum()


def test_whitening(spark):
    rng = np.random.default_rng(11)
    good = (rng.normal(size=(300, 12)) * np.linspace(1, 4, 12)).tolist()
    good += [good[0], good[0]]
    bad = [None, [], [None] * 12, [float("nan")] * 12, [float("inf")] + [0.0] * 11, [1.0] * 5]
    got = whitening.whiten(vectors_of(spark, good + bad)).toPandas().sort_values(["vec_id", "component"])
    deviation, white, explained = plain_whitening(good, 8)
    assert sorted(set(got["vec_id"])) == list(range(len(good))) and set(got["n"]) == {len(good)} and got["identity_error"].nunique() == 1
    assert [int(d) for d in got["deviation"][got["component"] == 1]] == list(deviation)
    found = got["whitened"].to_numpy().reshape(-1, 8)
    signs = np.sign((found * white).sum(axis=0))
    assert np.abs(found * signs - white).max() < 1e-9 and got["identity_error"].iloc[0] < 1e-9
    assert np.allclose(got["explained"].to_numpy().reshape(-1, 8), explained, rtol=1e-9)


def test_whitening_of_odd_tables(spark):
    empty = whitening.whiten(vectors_of(spark, [[1.0, 2.0]]).limit(0))
    assert empty.count() == 0 and empty.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert whitening.whiten(vectors_of(spark, [[1.0, 2.0]] * 4)).count() == 0
    flat = [[float(i), 2.0 * i, 1e300] for i in range(5)]
    got = whitening.whiten(vectors_of(spark, flat, [1, 1, None, None, 3])).toPandas()
    assert len(got) == 5 and set(got["component"]) == {1} and got["identity_error"].iloc[0] < 1e-9
    wild = [[1e300 if i == 3 else float(i), float(i % 4), 0.5] for i in range(40)]
    held = np.clip(np.floor(1024 * np.array(wild)), -(2.0**40), 2.0**40).astype(np.int64).astype(object) + 100_000
    departures = 40 * held - held.sum(axis=0)
    got = whitening.whiten(vectors_of(spark, wild)).where("component = 1").collect()
    assert {r["vec_id"]: int(r["deviation"]) for r in got} == dict(enumerate((departures**2).sum(axis=1)))


# License notices


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_labels(text, templates=licenses.TEMPLATES, percent=licenses.THRESHOLD_PERCENT):
    w = plain_words(text)
    places = [(label, i) for label, p in licenses.PHRASES for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    width = licenses.block_words(templates)
    labels, score = set(), 0.0
    for start in range(0, len(w), width // 2):
        held = set(w[start : start + width])
        met = []
        for label, notice in templates:
            own = set(notice.split())
            if 100 * len(own & held) >= percent * len(own):
                met.append((label, own & held, len(own & held) / len(own)))
        for label, shared, c in met:
            if not any(shared <= s and d >= c and (len(s) > len(shared) or d > c) for _, s, d in met):
                labels.add(label)
                score = max(score, c)
    base = {label for label, _ in places}
    starts = [i for _, i in places]
    return (len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | labels)), 1.0 if starts else score)


def notice_texts():
    rng = random.Random(9)
    filler = ["the", "and", "of", "mit", "license", "under", "öl", "Zürich", "x1", "public", "to", "in", "version"]
    some = lambda n: " ".join(rng.choice(filler) for _ in range(n))
    texts = [None, "", " \n\t", "!!", "under the MIT License under the mit license", "cc-by-nc", "Licensed under CC BY-NC 4.0.", "Licensed under CC BY 4.0"]
    for label, notice in licenses.TEMPLATES:
        parts = notice.split()
        texts += [some(50) + " " + notice.upper() + ", " + some(30), some(3) + " " + " ".join(rng.sample(parts, max(1, int(len(parts) * 0.85))))]
    texts += [some(20_000) + " released under the MIT-License. " + some(9), some(400), "cc by nc " * 3000]
    return texts + [texts[4], texts[4]]


COLUMNS = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]


def test_license_labels(spark):
    texts = notice_texts()
    rows = [(None if i % 7 == 0 else i % 9, t, str(i), "b") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, words string, blocks string").repartition(3)
    got = sorted(map(repr, (tuple(r[c] for c in ["doc_id", *COLUMNS]) for r in licenses.license_labels(docs).collect())))
    assert got == sorted(repr((r[0], *plain_labels(r[1]))) for r in rows)
    found = licenses.notices(docs).collect()
    assert found and all(0 <= r["first_word"] < r["end_word"] and 0.8 <= r["containment"] <= 1 for r in found)
    assert licenses.license_labels(docs.limit(0)).count() == 0 and licenses.notices(docs.limit(0)).count() == 0


def test_templates_of_a_caller(spark):
    templates = [("short", "alpha beta"), ("long", " ".join(f"w{i}" for i in range(40)))]
    texts = ["alpha gamma beta", "alpha", " ".join(f"W{i}" for i in range(4, 40)), " ".join(f"w{i}" for i in range(10, 40))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: r["labels"] for r in licenses.license_labels(docs, templates=templates, percent=90).collect()}
    assert got == {0: "short", 1: "", 2: "long", 3: ""}
