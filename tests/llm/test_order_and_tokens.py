"""Sharding, packing, records and BPE against brute force and exact round trips."""

import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from gridlineage.llm import bpe, packing, records, sharding, tokens

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return {p: Tokenizer.from_file(p) for p in (WORD, BYTE)}


def test_shards_are_even_gapless_and_mixed(docs, nothing):
    rows = sharding.interleave(docs, 4, ties=("text",)).collect()
    assert len(rows) == docs.count()
    sizes, slots, mix = Counter(r.shard for r in rows), defaultdict(list), Counter((r.shard, r.source) for r in rows)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    for source, n in Counter(r.source for r in rows).items():
        assert all(abs(mix[k, source] - n / 4) <= 2 for k in sizes)
    assert sharding.interleave(nothing, 4).count() == 0


def test_shards_do_not_depend_on_partitions(spark, unique):
    one = {r.doc_id: (r.shard, r.slot) for r in sharding.interleave(unique, 5).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        assert one == {r.doc_id: (r.shard, r.slot) for r in sharding.interleave(unique.repartition(7), 5).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


@pytest.mark.parametrize("tokens", [[50, 23, 7], [1000, 170, 31, 2501], [7], [30, 30, 30], [4] * 40])
def test_turns_come_by_deficit_and_leave_no_hole(tokens):
    quantum, size = 10, 32
    units = [-(-n // quantum) for n in tokens]
    row, at = {}, 0
    for _, s, j in sorted(((Fraction(2 * j + 1, u), s, j) for s, u in enumerate(units) for j in range(u))):
        for k in range(j * quantum, min((j + 1) * quantum, tokens[s])):
            row[s, k], at = at, at + 1
    plan = packing.Schedule(tokens, quantum)
    runs = [(s, lo, min(17, n - lo)) for s, n in enumerate(tokens) for lo in range(0, n, 17)]
    found = {}
    for d, start, length, sequence, offset in plan.pieces(*(np.array(c) for c in zip(*runs, strict=True)), size).tolist():
        assert 0 < length and offset + length <= size
        for k in range(length):
            found[runs[d][0], runs[d][1] + start + k] = sequence * size + offset + k
    assert found == row


def test_turns_of_very_large_queues_are_exact():
    tokens = [3 * 10**13 + 1, 10**13 + 7, 5, 999_999_937]
    plan = packing.Schedule(tokens, 1)
    for q, k in ((0, 10**13), (1, 10**13 + 6), (0, 3 * 10**13), (3, 999_999_936), (2, 4)):
        want = sum(min(n, len_before(2 * k + 1, tokens[q], n, other < q)) for other, n in enumerate(tokens))
        assert plan.starts(np.array([q]), np.array([k])).tolist() == [want]


def len_before(k, own, other, wins):
    """Odd numbers below k * other / own, or up to it."""
    whole, rest = divmod(k * other, own)
    return (whole + (rest > 0 or wins)) // 2


def test_packing_puts_each_id_in_one_place(unique, nothing, library):
    texts = {r.doc_id: r.text or "" for r in unique.collect()}
    ids = {k: library[WORD].encode(t, add_special_tokens=False).ids + [2] for k, t in texts.items()}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in packing.pack(unique, WORD, size=512, quantum=64).collect():
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert pieces.keys() == ids.keys()
    for k, v in ids.items():
        at = 0
        for r in sorted(pieces[k], key=lambda r: r.start):
            part = np.array(v[at : at + r.length], "<u4").tobytes()
            assert (r.start, r.doc_tokens, r.ids_crc32, bytes(r.ids)) == (at, len(v), zlib.crc32(part), part)
            at += r.length
        assert at == len(v)
    for k, rows in sequences.items():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == 512 or k == max(sequences)
    assert packing.pack(nothing, WORD).count() == 0


def test_records_come_back_in_order(spark, docs, nothing, library):
    folder = records.new_folder(spark)
    files = records.write_records(docs, folder, WORD, files=3)
    back = records.read_records(files, folder).collect()
    rows = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or ""))
    want, at = [], 0
    for r in rows:
        ids = library[WORD].encode(r.text or "", add_special_tokens=False).ids + [2]
        want.append((r.doc_id, at, len(ids), np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert sorted(((r.doc_id, r.start, r.n_tokens, bytes(r.ids)) for r in back), key=lambda r: r[1]) == want
    empty = records.new_folder(spark)
    assert records.read_records(records.write_records(nothing, empty, WORD), empty).count() == 0


def test_a_damaged_record_is_refused():
    data = bytearray(records.frame(b"payload") + records.frame(b"more"))
    assert records.unframe(memoryview(data), 0)[0] == b"payload"
    data[14] ^= 1
    with pytest.raises(ValueError):
        records.unframe(memoryview(data), 0)


def test_bpe_is_the_library(docs, nothing, library):
    texts = Counter((r.doc_id, r.text or "") for r in docs.collect())
    out = bpe.bpe_decode(bpe.bpe_encode(docs, BYTE), BYTE).collect()
    assert Counter((r.doc_id, r.decoded) for r in out) == texts
    for r in out:
        assert r.ids == library[BYTE].encode(r.decoded, add_special_tokens=False).ids
    assert bpe.bpe_encode(nothing, BYTE).count() == 0


def test_bpe_on_odd_texts(library):
    import random

    rng, letters = random.Random(3), "ab'sltdre \n\t\x1c\x85éΣ12٣五_<|endoftext|>.,!😀̀a"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 50))) for _ in range(500)] + ["a" * 2000, "<|endoftext|>"]
    model = bpe.NumpyBPE(BYTE)
    got = [x.tolist() for x in model.encode(texts)]
    texts += ["".join(rng.choice(a) for _ in range(n)) for a in ("abcdefghijklmnopqrstuvwxyz", "aab", "ABab01+/", "日本語一二") for n in (201, 1000, 30_000)]
    got = [x.tolist() for x in model.encode(texts)]
    assert got == [e.ids for e in library[BYTE].encode_batch(texts, add_special_tokens=False)]
    assert model.decode([np.array(x) for x in got]) == texts


def test_chunks_are_the_library_on_odd_texts(library):
    import random

    from gridlineage.llm.tokens import ChunkEncoder

    rng, letters = random.Random(4), "abAB',-._²́éİ <|endoftext|>1\x1c\n"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(800)] + ["<|ENDOFTEXT|> A<|endoftext|>B"]
    got = [x[:-1].tolist() for x in ChunkEncoder(WORD).encode(texts, 2)]
    assert got == [e.ids for e in library[WORD].encode_batch(texts, add_special_tokens=False)]


def test_chunks_of_every_letter_before_punctuation(library):
    import unicodedata

    from gridlineage.llm.tokens import ChunkEncoder

    letters = [c for c in map(chr, range(0x80, 0x30000)) if c.isalpha()]
    marks = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
    leave = [c for c in letters if not unicodedata.normalize("NFC", c.lower()).isalpha()]
    assert len(leave) > 50
    chunks = [f"{c}." for c in letters] + [f"a{c}{m}" for c in leave for m in marks] + [c + "b" for c in leave]
    texts = [" ".join(chunks[i : i + 500]) for i in range(0, len(chunks), 500)]
    got = [x[:-1].tolist() for x in ChunkEncoder(WORD).encode(texts, 2)]
    assert got == [e.ids for e in library[WORD].encode_batch(texts, add_special_tokens=False)]


def test_more_sources_than_queues_are_packed_whole(spark, library, monkeypatch):
    monkeypatch.setattr(packing, "QUEUES", 4)
    rows = [(i, "word " * (i % 9 + 1) + str(i), None if i % 31 == 0 else f"host{i % 17}" if i % 3 else "hot") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    whole, sequences = defaultdict(dict), defaultdict(list)
    for r in packing.pack(docs, WORD, size=64, quantum=16).collect():
        whole[r.doc_id][r.start] = bytes(r.ids)
        sequences[r.sequence_id].append((r.offset, r.length))
    assert {k: b"".join(v[s] for s in sorted(v)) for k, v in whole.items()} == {k: np.array([*library[WORD].encode(t, add_special_tokens=False).ids, 2], "<u4").tobytes() for k, t, _ in rows}
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 64


def test_chunks_that_come_again_are_encoded_once(library, monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 40_000)
    tool, asked = tokens.ChunkEncoder(WORD), Counter()
    learn = tool.learn
    monkeypatch.setattr(tool, "learn", lambda new: (asked.update(new), learn(new)))
    rare = ["".join(chr(97 + (i // 26**k) % 26) for k in range(4)) for i in range(4_000)]
    for lo in range(0, len(rare), 50):
        texts = [f"The common, words. {' '.join(rare[lo : lo + 25])}; again! {' '.join(rare[lo + 25 : lo + 50])}... é. x.y"]
        assert tool.encode(texts, 2)[0].tolist() == library[WORD].encode(texts[0], add_special_tokens=False).ids + [2]
        assert len(tool.known) + len(tool.known.earlier) < 40_000 / tokens.ENTRY + 200
    # Of a word with and without a mark behind it one is encoded.
    assert {asked[w] for w in (b"the", b"common", b"words", b"again", b".", b",")} == {1} and not asked[b"words."]
    assert len(asked) > len(rare) and max(asked.values()) == 1


def test_a_text_that_fails_leaves_nothing_half_known():
    tool = tokens.ChunkEncoder(WORD)
    for _ in range(2):
        with pytest.raises(Exception):
            tool.encode(["fine words \ud800"], 2)
    assert len(tool.encode(["fine words"], 2)[0]) > 2
