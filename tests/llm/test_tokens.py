import random
import zlib

import numpy as np
import pytest

from tidemark.llm import arrowstore, packing, tokens

ODD = ["", " ", "a  b", "a\n\nb", "a \nb", "a\n b", "a\tb", " a", "a ", "\n", "a\n", "\0a \0b", "a \0", "a b", "á c ́d", "ΑΣ.", "İstanbul", "don't I'll 'tis", "12 34,5 ½", "漢字 かな　x", "\x1c a", "<|endoftext|> x", "🙂🙂 a🙂", "a\r\nb"]
SCHEMA = "doc_id bigint, text string, id string, length string"


@pytest.mark.parametrize(("name", "leading"), [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
def test_pieces_give_the_ids_of_the_whole_text(name, leading):
    e, rng = tokens.Encoder(tokens.vocabulary(name), leading), random.Random(1)
    texts = ODD + ["".join(rng.choices(" \n\tabAé'1.,s ́-", k=rng.randint(1, 20))) for _ in range(2000)]
    for text, ids in zip(texts, e.encode(texts)):
        assert ids.tolist() == e.whole(text).tolist(), repr(text)


@pytest.mark.parametrize(("name", "leading"), [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
def test_white_space_of_any_kind(name, leading):
    e, rng = tokens.Encoder(tokens.vocabulary(name), leading), random.Random(2)
    spaces = " \n\t\r\x0b\x0c\xa0\u1680\u2003\u2028\u202f\u3000\x85\x1c\0"
    texts = ["".join(rng.choice(spaces) if rng.random() < 0.5 else rng.choice(["ab", "'s", "é", "1", ",", "漢", "́", "don't", "\u200b"]) for _ in range(rng.randint(0, 14))) for _ in range(4000)]
    for end in (None, 2):
        ids, counts = e.flat_ids(texts, end)
        for text, own in zip(texts, np.split(ids, np.cumsum(counts)[:-1])):
            assert own.tolist() == [*e.whole(text).tolist(), *([] if end is None else [end])], repr(text)


def test_memory_does_not_grow_with_doubtful_texts():
    e, rng = tokens.Encoder(tokens.vocabulary("byte_bpe_50k.json"), True), random.Random(3)
    words = [f"word{i}" for i in range(300)]

    def batch(sign):
        return [f"\n\n{sign}".join("  ".join(rng.choices(words, k=20)) for _ in range(5)) for _ in range(100)]

    for sign in ("", "\x1c"):
        e.flat_ids(batch(sign), 2)
        before = e.used, len(e.index), e.count
        for _ in range(50):
            e.flat_ids(batch(sign), 2)
        assert e.used <= before[0] + 3000 and len(e.index) <= before[1] + 600 and e.count <= before[2] + 600


def test_memory_starts_anew_beyond_its_bound(monkeypatch):
    monkeypatch.setattr(tokens, "MEMORY_IDS", 2000)
    e = tokens.Encoder(tokens.vocabulary("byte_bpe_50k.json"), True)
    for k in range(30):
        texts = [f"unseen{k}x{i} twice unseen{k}x{i}" for i in range(100)]
        assert [x.tolist() for x in e.encode(texts)] == [e.whole(t).tolist() for t in texts]
        assert e.used < 6000


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in rows], SCHEMA)


def texts(seed, n=60):
    rng = random.Random(seed)
    out = [(i * 3, " ".join(rng.choices(["the", "an", "Word", "x1,"], k=rng.choice([0, 3, 200, 3000])))) for i in range(n)]
    return [*out, (1, None), (1, None), (2, "ab " * 30_000), (0, out[0][1])]


def test_store_round_trip(spark):
    vocab = tokens.vocabulary("word_bpe_49k.json")
    e = tokens.Encoder(vocab, False)
    rows = texts(2)
    folder, manifest = arrowstore.write_store(frame(spark, rows), vocab, 1, leading_space=False, length=64)
    got = sorted((r.start, r.id, r.n_tokens, r.ids_crc32) for r in arrowstore.read_store(spark, folder, manifest).collect())
    ids = sorted((i, [*e.whole(t or "").tolist(), 1]) for i, t in rows)
    assert sorted((i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in ids) == sorted(g[1:] for g in got)
    assert [g[1] for g in got] == [i for i, _ in ids]
    total = 0
    for start, _, n, _ in got:
        assert start == total
        total += n
    flat = []
    for m in sorted(manifest.collect(), key=lambda m: m.part):
        reader = arrowstore.PartReader(folder, m["name"])
        assert reader.batches[0].column(0).type.list_size == 64
        for i in range(len(reader)):
            seq, mask = reader.sequence(i)
            assert len(seq) == 64 and not seq.flags.owndata
            flat += seq[mask].tolist()
    assert len(flat) == total and flat.count(1) >= len(rows)


def test_store_of_an_empty_table(spark):
    folder, manifest = arrowstore.write_store(frame(spark, []), tokens.vocabulary("word_bpe_49k.json"), 1, leading_space=False)
    assert arrowstore.read_store(spark, folder, manifest).collect() == []


def plain_best_fit(lengths, capacity):
    bins = []
    for n in sorted(lengths, reverse=True):
        fit = [b for b in range(len(bins)) if bins[b] >= n]
        if fit:
            b = min(fit, key=lambda b: bins[b])
            bins[b] -= n
        else:
            bins.append(capacity - n)
    return sorted(bins)


@pytest.mark.parametrize("seed", range(12))
def test_plan_is_best_fit_decreasing(seed):
    rng = random.Random(seed)
    capacity = rng.choice([7, 32, 100])
    lengths = [rng.randint(1, capacity) for _ in range(rng.randint(1, 400))]
    plan = packing.plan({n: lengths.count(n) for n in set(lengths)}, capacity)
    used = [0] * plan.sequences
    keys, rank, first, each, offset = plan.arrays()
    for n in sorted(set(lengths), reverse=True):
        for own in range(lengths.count(n)):
            i = int(np.searchsorted(keys, n << 44 | own, "right")) - 1
            b = int(first[i] + (own - rank[i]) // each[i])
            assert int(offset[i] + (own - rank[i]) % each[i] * n) == used[b]
            used[b] += n
    assert sorted(capacity - u for u in used) == plain_best_fit(lengths, capacity)


def test_pack_whole_texts(spark):
    vocab = tokens.vocabulary("byte_bpe_50k.json")
    e = tokens.Encoder(vocab, True)
    rows = texts(3)
    got = packing.pack(frame(spark, rows), vocab, 2, leading_space=True).collect()
    bins, docs = {}, {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
        docs.setdefault(r.id, []).append((r.piece, r.start, np.frombuffer(r.ids, "<u2").tolist()))
        assert r.ids_crc32 == zlib.crc32(np.frombuffer(r.ids, "<u2").astype("<u4").tobytes())
    for parts in bins.values():
        total = 0
        for offset, length in sorted(parts):
            assert offset == total
            total += length
        assert total <= 1024
    for i in {i for i, _ in rows}:
        want = sorted([*e.whole(t or "").tolist(), 2] for j, t in rows if j == i)
        if len(want) == 1:
            pieces = sorted(docs[i])
            assert [x for p in pieces for x in p[2]] == want[0]
            assert all(len(p[2]) == 1024 for p in pieces[1:])
    assert len(bins) == len(plain_best_fit([r.length for r in got], 1024))


def test_pack_an_empty_table(spark):
    assert packing.pack(frame(spark, []), tokens.vocabulary("byte_bpe_50k.json"), 2, leading_space=True).collect() == []


@pytest.mark.parametrize(("name", "leading"), [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
def test_every_latin_letter_before_every_sign(name, leading):
    encoder = tokens.Encoder(tokens.vocabulary(name), leading)
    letters = [chr(c) for c in range(0x80, 0x250) if chr(c).isalpha()] + ["a", "Z", "ß", "ſ"]
    texts = [f"{a}{x}{s} {x}{s}{b}" for x in letters for s in "!\"#$%&()*+,-./:;<=>?@[]^_`{|}~'\\" for a, b in (("ab", ""), ("", "c"))]
    texts += ["BELEDİYESİ.", "İ", "İ.", "DİYARBAKIR'DA, İZMİR!", "Iİiı... (İ)"]
    assert [x.tolist() for x in encoder.encode(texts)] == [encoder.whole(t).tolist() for t in texts]


@pytest.mark.parametrize(("name", "leading"), [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
def test_many_mixed_texts(name, leading):
    rng = random.Random(12)
    encoder = tokens.Encoder(tokens.vocabulary(name), leading)
    alphabet = [*"abcXYZ.,!?'-()\"/:;# ", " ", "  ", "\n", "İ", "ı", "ğ", "Ş", "é", "É", "ß", "ǅ", "ŉ", "\u0307", "\u0301", "Ω", "漢", "1", "23", "'s", "\t", "\xa0"]
    for _ in range(10):
        texts = ["".join(rng.choices(alphabet, k=rng.randint(1, 12))) for _ in range(5_000)]
        assert [x.tolist() for x in encoder.encode(texts)] == [encoder.whole(t).tolist() for t in texts]
