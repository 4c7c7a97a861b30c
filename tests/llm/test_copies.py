"""Exact and near duplicates against brute force."""

import hashlib
import re
from collections import Counter, defaultdict
from itertools import combinations

import pytest

from gridlineage.llm import exact_dedup, minhash

SPACE = "[\x20\x09-\x0d]"


def test_levels_and_digests(spark):
    """Texts of one length, of one length and prefix, and equal ones; every digest against hashlib, groups against a dictionary."""
    long = "x" * exact_dedup.PREFIX
    texts = ["ab", "ba", "a b", long + "ab", long + "ba", f" {long}ab\n", "", None, " \t", "é", "e\u0301", "\u00a0a", "ab"]
    rows = [(i, t, "old") for i, t in enumerate(texts)]
    norm = [re.sub(r"[\x20\x09-\x0D]", "", t or "") for t in texts]
    out = exact_dedup.exact_groups(spark.createDataFrame(rows, "doc_id long, text string, text_sha256 string"), digests=True)
    assert out.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    for r in out.collect():
        same = [i for i, n in enumerate(norm) if n == norm[r.doc_id]]
        best = min(same, key=lambda i: (-len(texts[i] or ""), i))
        assert (r.keep_id, r.group_size, r.kept) == (best, len(same), best == r.doc_id)
        assert r.text_sha256 == hashlib.sha256(norm[r.doc_id].encode()).hexdigest()
    assert exact_dedup.exact_groups(spark.createDataFrame([], "doc_id long, text string"), digests=True).count() == 0


def test_exact_groups(docs, nothing):
    rows = docs.collect()
    groups = defaultdict(list)
    for r in rows:
        groups[re.sub(SPACE, "", r.text or "")].append(r)
    best = {k: min(v, key=lambda r: (-len(r.text or ""), r.doc_id is None, r.doc_id or 0)).doc_id for k, v in groups.items()}
    key = {r.doc_id: re.sub(SPACE, "", r.text or "") for r in rows}
    out = exact_dedup.exact_groups(docs).collect()
    assert Counter(r.doc_id for r in out) == Counter(r.doc_id for r in rows)
    for r in out:
        assert (r.keep_id, r.group_size) == (best[key[r.doc_id]], len(groups[key[r.doc_id]]))
    assert sum(r.kept for r in out) == len(groups)
    assert exact_dedup.exact_groups(nothing).count() == 0


def test_exact_copies_are_dropped_with_all_columns(docs):
    kept = exact_dedup.drop_exact_copies(docs)
    assert kept.columns == docs.columns
    texts = [re.sub(SPACE, "", r.text or "") for r in kept.collect()]
    assert len(texts) == len(set(texts)) == len({re.sub(SPACE, "", r.text or "") for r in docs.collect()})


def shingles(text, width):
    w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


@pytest.fixture(scope="module")
def near(unique):
    """Near duplicates by the default of five words."""
    return {r.doc_id: r for r in minhash.near_duplicates(unique).collect()}


def test_near_duplicates(unique, near):
    width = 5
    sets = {r.doc_id: shingles(r.text, width) for r in unique.collect()}
    parent = {k: k for k in sets}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= 80 * len(x | y):
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    assert {k: (len(sets[k]), root(k), root(k) == k) for k in sets} == {k: (r.n_shingles, r.component_id, r.kept) for k, r in near.items()}


def test_near_duplicates_of_nothing(nothing):
    assert minhash.near_duplicates(nothing).count() == 0


@pytest.mark.parametrize("small", [False, True])
def test_a_dense_group_whose_members_are_links_in_part(spark, monkeypatch, small):
    import random

    if small:  # cells of few members, so that blocks, stars and labels are dealt over several
        monkeypatch.setattr(minhash, "BLOCK", 16)
        monkeypatch.setattr(minhash, "STAR", 20)
        monkeypatch.setattr(minhash, "CELL", 20_000)

    rng = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(150):
        words = list(base)
        for _ in range(rng.randint(0, 5)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    sets = {k: shingles(t, 4) for k, t in rows}
    parent = {k: k for k in sets}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in combinations(sorted(sets), 2):
        if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    out = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=4)
    assert {r.doc_id: r.component_id for r in out.collect()} == {k: root(k) for k in sets}


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 130)] + [(200, 200)]
    out = {r.id: r.comp for r in minhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert out == {**{i: 0 for i in range(41)}, **{k: 100 for k in range(100, 130)}, 200: 200}


def test_a_long_path_takes_few_rounds(spark):
    path = spark.range(10_000).selectExpr("id as a", "id + 1 as b").repartition(4)
    assert len(list(minhash.contractions(path))) == 1
    # Tasks that contract five edges at once leave the rest to the rounds.
    rounds = list(minhash.contractions(path.limit(400).repartition(80), chunk=5))
    assert 1 <= len(rounds) <= 5
    out = minhash.components(path.filter("a < 300"), chunk=20).collect()
    assert {(r.id, r.comp) for r in out} == {(i, 0) for i in range(301)}


def test_roots_of_mutual_neighbours(spark):
    edges = spark.createDataFrame([(1, 9), (9, 3), (3, 8), (8, 2), (20, 21)], "a long, b long")
    roots = {r.a: r.up for r in minhash.rooted(edges).collect()}
    # 9 and 1, 8 and 2, 20 and 21 are each other's smallest neighbours; 3 goes to 8.
    assert roots == {1: 1, 9: 1, 2: 2, 8: 2, 3: 2, 20: 20, 21: 20}


def test_rows_that_share_an_id_or_have_none(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, text, 0), (1, "another text of its own here", 0), (2, text.upper(), 0), (2, text, 1), (None, text, 0), (None, "", 0), (None, "five words that stand alone", 0), (3, None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, gone int")
    out = sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in minhash.near_duplicates(docs, width=5).collect())
    assert out == sorted([("1", 36, "1", True), ("1", 2, "1", True), ("2", 36, "1", False), ("2", 36, "1", False), ("None", 36, "1", False), ("None", 0, "None", True), ("None", 1, "None", True), ("3", 0, "3", True)])
    kept = minhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "1", "3", "None", "None", "None"]


def test_near_duplicates_are_dropped_with_all_columns(unique, near):
    kept = minhash.drop_near_duplicates(unique)
    assert kept.columns == unique.columns
    assert {r.doc_id for r in kept.collect()} == {k for k, r in near.items() if r.kept}
