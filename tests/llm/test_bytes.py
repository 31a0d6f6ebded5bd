"""BPE, audio and suffix dedup: round trips, reference tokens, brute force."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from rosterloom.llm import audio, bpe, suffix_dedup, suffix_sort
from rosterloom.llm import queries as q

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary(bpe.read_ranks(q.RANKS))


@pytest.fixture(scope="module")
def reference():
    tokens = bpe.read_ranks(q.RANKS)
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})


def test_tokens_equal_the_library(vocabulary, reference, monkeypatch):
    r = random.Random(1)
    letters = list(" \n\t 'strevmlld aZ09½²é漢字🎉_-.!\0")
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 60))) for _ in range(3000)]
    texts += ["", "'s's''s \n's", "don't we'll", "a" * 3000, "x" * 700 + "é" * 600, " " * 40, *("".join(r.choice("abcdefgh") for _ in range(n)) for n in (25, 33, 64, 65, 200, 511, 512, 900))]
    for most in (bpe.GROUP_CHARS, 50):
        ids, n = [], []
        for part in bpe.groups([len(t) for t in texts], most):
            got = bpe.encode_texts(texts[part], vocabulary)
            ids += got[0].tolist()
            n += got[1].tolist()
        ends = np.cumsum(n)
        assert all(ids[e - k : e] == reference.encode_ordinary(t) for t, k, e in zip(texts, n, ends.tolist()))


def test_bpe_query(spark, reference):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    for r in q.op8_bpe(spark, DATA).collect():
        ids = reference.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_bpe_edge_rows(spark):
    df = spark.createDataFrame([(1, None), (1, ""), (None, "hi there"), (4, "hi there"), (5, "ab" * 100_000)], "id int, text string").withColumn("TOKEN_IDS", F.lit(1))
    back = bpe.decode(bpe.encode(df, q.RANKS), q.RANKS).collect()
    assert all(bytes(r.decoded) == (r.text or "").encode() for r in back) and len(back) == 5
    assert bpe.encode(df.filter("false"), q.RANKS).collect() == []


def test_audio_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    rows, by_text = q.op9_audio(spark, DATA).collect(), {}
    for r in rows:
        raw = texts[r.doc_id].encode()
        payload = raw + b" " * (max(1, -(-len(raw) // 192)) * 192 - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-16:]) and r.media_bytes > len(payload)
        assert by_text.setdefault(texts[r.doc_id], (r.media_sha256, r.feature)) == (r.media_sha256, r.feature)


def test_resampling_and_blocks(monkeypatch):
    rng = np.random.default_rng(0)
    x = rng.integers(0, 256, 50_000).astype(np.uint8)
    whole = audio.resample(x, 0, audio.resampled_size(len(x)))
    assert np.array_equal(whole[3000:6000], audio.resample(x, 3000, 3000))
    mel = np.concatenate([m for m, _ in audio.log_mel(x)])
    monkeypatch.setattr(audio, "BLOCK", 7)
    assert np.allclose(np.concatenate([m for m, _ in audio.log_mel(x)]), mel, atol=1e-4)
    n = np.arange(64_000)
    tone = (128 + 100 * np.sin(2 * np.pi * 440 * n / audio.RATE)).astype(np.uint8)
    y = audio.resample(tone, 0, audio.resampled_size(len(tone)))[100:-100]
    assert abs(np.abs(np.fft.rfft(y * np.hanning(len(y)))).argmax() * audio.TO_RATE / len(y) - 440) < 1


def test_segments_and_tensors():
    energy = np.array([0, 0, 5, 5, 2.4, 5, 0, 0, 5.0, 0])
    start, end = audio.segments(energy)
    assert list(zip(start.tolist(), end.tolist())) == [(2, 6), (8, 9)]
    table = audio.read_tensors(audio.tensor_stream(np.ones((70, audio.MELS), np.float32)))
    assert table.num_rows == 2 and table.schema.field("mel").type.shape == [audio.TENSOR_FRAMES, audio.MELS]
    assert table["end_s"][1].as_py() == pytest.approx((70 * audio.HOP + audio.WINDOW - audio.HOP) / audio.TO_RATE)


def test_audio_edge_rows(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "é" * 500)], "id int, text string").withColumn("PAYLOAD", F.lit(1))
    rows = {r.id: r for r in audio.describe(audio.store(df)).collect()}
    assert bytes(rows[1].payload) == bytes(rows[2].payload) == b" " * 192 and rows[3].n_bytes == 1000
    with pytest.raises(Exception, match="not an 8-bit"):
        audio.from_wav(audio.to_wav(b"x" * 192).replace(b"\x80\x3e\0\0", b"\x40\x1f\0\0"))


@pytest.mark.parametrize("memory,chunk", [(3, 2), (16, 3), (64, 64), (1 << 20, 1 << 18)])
def test_suffix_order_and_shared_lengths(memory, chunk):
    r = random.Random(5)
    for _ in range(60):
        alphabet = r.choice([b"ab", b"a", b"abc\0", bytes(range(256))])
        parts = [bytes(r.choice(alphabet) for _ in range(r.randint(0, 20))) for _ in range(r.randint(1, 6))]
        parts += [parts[0] * 3] if r.random() < 0.4 else []
        symbols, _ = suffix_sort.join_parts(parts)
        cap = r.choice([3, 5, 1000])
        got = list(suffix_sort.Text(symbols, cap, suffix_sort.BYTE_BITS, suffix_sort.Scratch(memory), chunk).sorted_chunks())
        order, lengths, s = np.concatenate([g[0] for g in got]).tolist(), np.concatenate([g[1] for g in got]).tolist(), symbols.tolist()
        keys = [s[i : i + cap] for i in order]
        assert keys == sorted(keys) and sorted(order) == list(range(len(s)))
        shared = lambda a, b: next((k for k in range(cap) if s[a + k : a + k + 1] != s[b + k : b + k + 1]), cap)
        assert lengths == [0] + [shared(a, b) for a, b in zip(order, order[1:])]


def texts_with_repeats():
    r = random.Random(2)
    words = ["".join(r.choice("abcde") for _ in range(r.randint(2, 7))) for _ in range(300)]
    say = lambda n: " ".join(r.choice(words) for _ in range(n))
    texts, passage = [say(r.randint(0, 200)) for _ in range(40)], say(30)
    return [*texts, *[t[:50] + passage + t[60:] for t in texts[:20]], "a" * 500, "a" * 700, "ab" * 300, None, "", texts[0], texts[0], "é" * 90]


def test_shard_far_larger_than_memory():
    """The queue merges its runs, names recurse on disk, and the flags equal those of a sort in memory."""
    r = random.Random(9)
    words = [bytes(r.choice(b"abcdefgh") for _ in range(r.randint(2, 6))) for _ in range(80)]
    parts = [b" ".join(r.choice(words) for _ in range(120)) for _ in range(12)]
    parts += [p[100:400] + b"z" * 50 for p in parts[:5]] + [b"a" * 900]
    symbols, _ = suffix_sort.join_parts(parts)
    want = suffix_sort.repeated(symbols, 40)
    assert want.any() and (np.asarray(suffix_sort.repeated(symbols, 40, memory=len(symbols) // 60, chunk=50)) == want).all()


@pytest.mark.parametrize("shard_bytes,memory,depth,block", [(4_000_000, 1 << 23, 3, 4_000_000), (400, 1 << 23, 2, 200), (400, 300, 1, 97), (400, 500, 0, 4_000_000)])
def test_repeats_against_brute_force(spark, monkeypatch, shard_bytes, memory, depth, block):
    """Small shards deal every owner again; a small memory sends shards to disk; small blocks cut every text."""
    monkeypatch.setattr(suffix_dedup, "DEPTH", depth)
    monkeypatch.setattr(suffix_dedup, "BLOCK", block)
    texts = texts_with_repeats()
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id int, text string")
    for name in ("KEPT", "n_Bytes", "n_removed", "n_spans", "tid", "t", "of", "copies"):
        df = df.withColumn(name, F.lit(1))
    out = suffix_dedup.drop_repeated(df, width=60, shard_bytes=shard_bytes, memory=memory)
    assert {"tid", "t"} <= set(out.columns)
    got = {r.id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in out.collect()}
    assert [got[k] for k in range(len(texts))] == suffix_dedup.brute_force(texts, 60)


def test_repeats_in_an_empty_table(spark):
    assert suffix_dedup.drop_repeated(spark.createDataFrame([], "text string")).collect() == []


def test_suffix_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in q.op10_suffix_dedup(spark, DATA).collect()}
    assert [got[k] for k in texts] == suffix_dedup.brute_force(list(texts.values()))


def test_planted_passages_are_gone_from_what_the_suffix_query_keeps(spark, tmp_path):
    """Passages of over 50 words go from unlike texts if they have 400 bytes; shorter ones and all else stay."""
    r = random.Random(31)
    say = lambda n, least, most: " ".join("".join(r.choice("aeiourstlnéß") for _ in range(r.randint(least, most))) for _ in range(n))
    long, short, exact = [say(r.randint(60, 160), 6, 9) for _ in range(6)], [say(52, 2, 4) for _ in range(6)], say(60, 7, 7)
    exact = exact[: next(n for n in range(len(exact)) if len(exact[:n].encode()) >= 400)]
    assert min(len(p.encode()) for p in long) >= 400 > max(len(p.encode()) for p in short)
    rows, passages = [], []
    for k, p in enumerate(long + short):
        for _ in range(3):
            edge = chr(65 + len(rows))  # no two texts of a passage agree beside it
            head, tail = say(30, 2, 9) + edge, edge + say(30, 2, 9)
            rows.append((head + p + tail, head + tail if k < len(long) else head + p + tail))
            passages.append(p)
    clean = [say(80, 2, 9) for _ in range(20)]
    rows += [(t, t) for t in clean]
    # the repeated string starts in the middle of a character, of which one byte is left
    rows += [("0\u00e9" + exact + "1", "0\ufffd1"), ("2\u0129" + exact + "3", "2\ufffd3"), (None, "")]
    spark.createDataFrame([(k, t) for k, (t, _) in enumerate(rows)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {x.doc_id: x for x in q.op10_suffix_dedup(spark, str(tmp_path)).collect()}
    assert [got[k].kept_text for k in range(len(rows))] == [left for _, left in rows]
    assert all((p in got[k].kept_text) == (len(p.encode()) < 400) == (got[k].n_removed == 0) for k, p in enumerate(passages))
    assert got[len(rows) - 3].kept_sha256 == hashlib.sha256(b"0\xc31").hexdigest()


def test_long_rows_merge_like_the_short_ones_do():
    """Rows whose rounds merge many pairs give the ids of one pair a round, low new ranks included."""
    r = random.Random(12)
    vocabulary = bpe.Vocabulary(bpe.read_ranks(q.RANKS))
    for alphabet in ("a", "ab", "aA1", "etaoin", "中文字", "=-_", "0123456789abcdef"):
        for n in (1, 2, 40, 300):
            piece = np.frombuffer("".join(r.choice(alphabet) for _ in range(n)).encode(), np.uint8)
            ids, counts = bpe.merge_rows(piece[None, :].copy(), np.array([len(piece)]), vocabulary)
            assert bpe.merge_long(piece, vocabulary).tolist() == ids[0, : counts[0]].tolist()
    # a made vocabulary in which a merge makes a pair of lower rank
    tokens = [bytes([b]) for b in range(256)] + [b"xbc", b"bc", b"bcb", b"xb", b"cbc"]
    made = bpe.Vocabulary(tokens)
    for _ in range(300):
        piece = np.frombuffer(bytes(r.choice(b"xbc") for _ in range(r.randint(2, 30))), np.uint8)
        ids, counts = bpe.merge_rows(piece[None, :].copy(), np.array([len(piece)]), made)
        assert bpe.merge_long(piece, made).tolist() == ids[0, : counts[0]].tolist()


def test_features_against_direct_formulas(spark):
    """Resampling as the sum over taps, the filterbank as a plain transform, one frame at a time."""
    rng = np.random.default_rng(3)
    samples = rng.integers(0, 256, 2000).astype(np.uint8)
    wave = samples.astype(float) / 128 - 1
    h = np.zeros(audio.UP * audio.TAPS)
    for j in range(audio.UP):
        h[j :: audio.UP] = audio.phase_filters()[j][::-1]
    size = audio.resampled_size(len(samples))
    want = [sum(h[m * audio.DOWN - audio.UP * k] * wave[k] for k in range(len(wave)) if 0 <= m * audio.DOWN - audio.UP * k < len(h)) for m in range(size)]
    got = audio.resample(samples, 0, size)
    assert np.allclose(got, want, atol=1e-4)
    mel, energy = (np.concatenate(x) for x in zip(*audio.log_mel(samples)))
    n = np.arange(audio.WINDOW)
    for f in (0, 3, len(mel) - 1):
        frame = np.zeros(audio.WINDOW)
        part = np.array(want[f * audio.HOP : f * audio.HOP + audio.WINDOW])
        frame[: len(part)] = part
        frame *= 0.5 - 0.5 * np.cos(2 * np.pi * n / (audio.WINDOW - 1))
        power = np.array([abs(sum(frame * np.exp(-2j * np.pi * k * n / audio.WINDOW))) ** 2 for k in range(audio.WINDOW // 2 + 1)])
        assert np.allclose(10 ** mel[f], np.maximum(power @ audio.mel_filters(), 1e-10), rtol=2e-2, atol=1e-5)
        assert np.isclose(10 ** energy[f], power.sum(), rtol=1e-2)
    df = spark.createDataFrame([(1, None), (2, bytearray(audio.to_wav(b" " * 192)))], "id int, media binary")
    rows = {r.id: r for r in audio.describe(df).collect()}
    assert rows[1].payload is None and rows[1].segments is None and rows[2].n_frames > 0
    assert audio.describe(df.filter("false")).collect() == []


def test_audio_query_stores_every_text(spark):
    import zlib

    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    for r in q.op9_audio(spark, DATA).collect():
        payload = texts[r.doc_id] + b" " * (-len(texts[r.doc_id]) % 192 or (192 if not texts[r.doc_id] else 0))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(texts[r.doc_id]), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
