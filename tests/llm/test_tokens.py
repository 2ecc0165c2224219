import random
import zlib

import numpy as np
import pytest

from quern.llm import arrow_ids, attribution, packing
from quern.llm.tokens import encoder

from .fixtures import SCHEMA, documents, frame, odd

public_tokenizers = pytest.importorskip("public_tokenizers")
BYTES, WORDS = (public_tokenizers.path(f) for f in ("byte_bpe_50k.json", "word_bpe_49k.json"))


def plain(path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_ids_are_those_of_whole_texts(path):
    rng = random.Random(1)
    want, enc = plain(path), encoder(path)
    parts = ["a", "B", " ", "  ", "\n", "\t", "é", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endof", "text|>", "<|", " 's", "'t", "1", "\x1c", " ", "　", "Σ", "ά", "\r\n", "!", "日本", "🙂", "́", "\x85", "ǅ", ",", ".\n", "word,", "İ", "\nNext", "'ll", "word!!", "½", "_", "||"]
    for _ in range(8000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))
        assert enc.encode(text).tolist() == want(text), repr(text)


def test_arrow_round_trip(spark):
    rows = documents()
    docs = odd(frame(spark, [*rows, (None, "null key", None, None, None)]))
    folder, parts = arrow_ids.write_ids(docs, BYTES, 2, length=128)
    got = arrow_ids.read_back(docs, folder, parts).collect()
    want, at = plain(BYTES), 0
    assert len(got) == len(rows) + 1
    for r, (i, t, *_) in zip(sorted(got, key=lambda r: -1 if r["doc_id"] is None else r["doc_id"]), [(None, "null key"), *sorted(rows)], strict=True):
        ids = np.array([*want(t), 2], "<u4")
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (i, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_random_access_is_a_view(spark):
    rows = documents()
    folder, parts = arrow_ids.write_ids(frame(spark, rows).coalesce(1), BYTES, 2, length=64)
    want = plain(BYTES)
    stream = [x for _, t, *_ in sorted(rows) for x in [*want(t), 2]]
    at = 0
    for name, _, n in parts:
        f = arrow_ids.SequenceFile(folder, name)
        assert f.n_ids == n and f.n_sequences == -(-n // 64)
        for k in range(f.n_sequences):
            ids, mask = f.sequence(k)
            assert len(ids) == 64 and ids.base is not None
            real = [x for x, m in zip(ids.tolist(), mask.to_pylist(), strict=True) if m]
            assert real == stream[at + 64 * k : at + min(n, 64 * k + 64)]
        at += n
    assert at == len(stream)


def test_packing(spark):
    rows = [*documents(), (None, "null key", None, None, None), (1, "again", "en", "s", 0)]
    got = packing.pack(odd(frame(spark, rows)), WORDS, 1, size=256).collect()
    want = plain(WORDS)
    ids = {}
    for i, t, *_ in rows:
        ids.setdefault(i, []).append(np.array([*want(t), 1], "<u4"))
    assert sum(r["length"] for r in got) == sum(len(x) for v in ids.values() for x in v)
    for r in got:
        assert any(len(x) == r["doc_tokens"] and zlib.crc32(x[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for x in ids[r["doc_id"]])
    by: dict[int, list] = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sorted(by) == list(range(len(by)))
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 256


@pytest.mark.parametrize("seed", range(20))
def test_patterns(seed):
    rng = random.Random(seed)
    histogram = {rng.randint(1, 64): rng.randint(1, 400) for _ in range(rng.randint(1, 40))}
    packs = packing.patterns(histogram, 64)
    held: dict[int, int] = {}
    for count, content in packs:
        assert sum(a * b for a, b in content) <= 64
        for a, b in content:
            held[a] = held.get(a, 0) + count * b
    assert held == histogram
    table = packing.places(packs)
    taken = set()
    for length, n in histogram.items():
        s, o = packing.locate(table, np.full(n, length), np.arange(n))
        for a, b in zip(s.tolist(), o.tolist(), strict=True):
            cells = {(a, k) for k in range(b, b + length)}
            assert not cells & taken
            taken |= cells


def test_little_padding():
    rng = random.Random(0)
    lengths = [min(2048, int(rng.lognormvariate(6, 0.9)) + 1) for _ in range(5000)]
    histogram = {k: lengths.count(k) for k in set(lengths)}
    n = sum(c for c, _ in packing.patterns(histogram, 2048))
    assert sum(lengths) / (n * 2048) > 0.98


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    folder, parts = arrow_ids.write_ids(none, BYTES, 2)
    assert arrow_ids.read_back(none, folder, parts).count() == 0
    assert packing.pack(none, WORDS, 1).count() == 0


def plain_attribution(path, text):
    """Encode with offsets, and give each token to the line that holds most of its bytes."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    raw = text.encode()
    owner, line = [], 0
    for k, byte in enumerate(raw):
        owner.append(line)
        line += byte == 10 and k + 1 < len(raw)
    counts = [0] * (line + 1)
    at = 0
    for token in t.encode(text, add_special_tokens=False).tokens:  # letters that stand for bytes, or an added token itself
        held = owner[at : at + len(token)]
        at += len(token)
        counts[max(sorted(set(held)), key=held.count)] += 1
    assert at == len(raw)
    return counts


def test_attribution(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice(("a", "word ", "<|endoftext|>", "<|startoftext|>\n", "\n", "\n\n\n", " \n ", "é", "日本", "🙂", "\t")) for _ in range(rng.randint(1, 60))) for _ in range(200)]
    rows = [(i, t, None, None, None) for i, t in enumerate(texts)] + [(900, None, None, None, None), (901, "", None, None, None)]
    got: dict = {}
    for r in attribution.section_tokens(odd(frame(spark, rows)), BYTES).orderBy("doc_id", "section").collect():
        got.setdefault(r["doc_id"], []).append(r)
    for i, t in enumerate(texts):
        assert [r["n_tokens"] for r in got[i]] == plain_attribution(BYTES, t), repr(t)
        assert got[i][0]["start_byte"] == 0 and got[i][-1]["end_byte"] == len(t.encode())
    assert [r["n_tokens"] for r in got[900] + got[901]] == [0, 0]
    assert sum(r["n_crossing"] for v in got.values() for r in v) > 0


def test_attribution_of_other_kinds(spark):
    got = attribution.section_tokens(frame(spark, [(1, "One two,\nthrée four\n\nfive", None, None, None)]), WORDS).orderBy("section").collect()
    assert [r["n_tokens"] for r in got] == [3, len(plain(WORDS)("thrée four")), 0, 1]
    assert attribution.section_tokens(spark.createDataFrame([], SCHEMA), BYTES).count() == 0
