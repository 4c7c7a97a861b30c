"""The pipeline stage by stage against plain versions, on documents with nulls, repeats and further columns."""

import random
import re
from collections import Counter
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from gridlineage.llm import quality, toxicity

PATH = public_tokenizers.path("word_bpe_49k.json")
SPACE = "[\x20\x09-\x0d]"


def rows():
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    out, labels = [], []
    for i in range(240):
        text = [rng.choice(words) for _ in range(rng.randint(20, 60))]
        toxic, good = i % 5 == 0, i % 3 != 1
        for _ in range(3 if toxic else 0):
            text.insert(rng.randrange(len(text)), rng.choice(["scumbag", "vilest", "rotten"]))
        if not good:
            text = [w + rng.choice(["***", "%%%"]) for w in text]
        out.append((i, " ".join(text), "en", f"s{i % 3}", 1, True, None))
        labels.append((i, int(good), int(toxic)))
    base = out[2][1]
    out += [(300 + k, base.replace(" ", "  ", k + 1), "en", "s1", 1, False, None) for k in range(3)]
    out += [(310 + k, f"{base} more{k}", "en", "s1", 1, False, None) for k in range(3)]
    out += [(None, "text without an id " + base, None, None, None, None, None), (400, None, None, None, None, None, None), (401, "", "en", "s0", 0, None, None), out[3], out[3]]
    return out, labels


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("pipeline")
    docs, labels = rows()
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, kept boolean, label int").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def shingles(text):
    w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def test_every_stage(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    bag = lambda df: Counter(tuple(r) for r in df.collect())
    for name, stage in pipeline.STAGES[:4]:
        out = stage(spark, docs, folder).cache()
        assert out.columns == docs.columns
        before, after = bag(docs), bag(out)
        assert not after - before
        if name in ("toxicity", "quality"):
            # Scores of whole texts by a model that is fitted again decide.
            scores = toxicity.score(docs, toxicity.train(docs, labels)) if name == "toxicity" else quality.score(docs, quality.train(docs, labels))
            keep = Counter((r.doc_id, (r.score < 0.7) if name == "toxicity" else (r.score >= 0.5)) for r in scores.collect())
            assert Counter(r[0] for r in after.elements()) == Counter({k: n for (k, ok), n in keep.items() if ok})
            truth = {k: (not t if name == "toxicity" else q) for k, q, t in rows()[1]}
            seen = {r[0] for r in after.elements()}
            assert np.mean([(k in seen) == bool(ok) for k, ok in truth.items() if k in {r[0] for r in before}]) > 0.95
        elif name == "exact dedup":
            groups = {}
            for r in before.elements():
                groups.setdefault(re.sub(SPACE, "", r[1] or ""), []).append(r)
            best = {k: min(v, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0))[0] for k, v in groups.items()}
            assert sorted(str(r[0]) for r in after.elements()) == sorted(map(str, best.values())) and len(best) < sum(before.values())
        else:
            held = [r for r in before.elements() if r[0] is not None]
            up = {r[0]: r[0] for r in held}

            def root(k):
                while up[k] != k:
                    k = up[k]
                return k

            sets = {r[0]: shingles(r[1]) for r in held}
            for a, b in combinations(sorted(sets), 2):
                if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    a, b = root(a), root(b)
                    up[max(a, b)] = min(a, b)
            gone = [k for k in up if root(k) != k]
            assert gone and {r[0] for r in after} == {r[0] for r in before} - set(gone)
        docs = spark.createDataFrame(out.collect(), out.schema)
    library = Tokenizer.from_file(PATH)
    pieces = pipeline.STAGES[4][1](spark, docs, folder).collect()
    want = sorted((str(r.doc_id), [*library.encode(r.text or "", add_special_tokens=False).ids, 2]) for r in docs.collect())
    got, places = {}, Counter()
    for p in sorted(pieces, key=lambda p: p.start):
        got.setdefault(str(p.doc_id), []).extend(np.frombuffer(p.ids, "<u4").tolist())
        places.update((p.sequence_id, p.offset + k) for k in range(p.length))
    assert sorted(got.items()) == want and max(places.values()) == 1


def test_the_whole_run(spark, folder):
    out = pipeline.run(spark, folder)
    ids = {r.doc_id for r in out.select("doc_id").distinct().collect()}
    truth = rows()[1]
    assert ids and ids <= {r[0] for r in rows()[0]}
    clean = {k for k, q, t in truth if q and not t}
    assert len(ids & clean) > 0.9 * len(clean) and len({k for k, q, t in truth if t or not q} & ids) < 5


def test_empty_tables(spark, tmp_path):
    docs, labels = rows()
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("labels", [[], [(1, 1, 0), (2, 1, 0), (3, 1, 0)]])
def test_labels_that_say_nothing(spark, docs, labels):
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    toxic = toxicity.score(docs, toxicity.train(docs, known)).collect()
    good = quality.score(docs, quality.train(docs, known)).collect()
    assert len({r.score for r in toxic}) == 1 and toxic[0].score < 0.7 and all(r.score >= 0.5 for r in good) and len({r.score for r in good}) == 1
