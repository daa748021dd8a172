import random
import zlib

import numpy as np
import pyarrow.fs as pafs
import pytest
import public_tokenizers
from tokenizers import Tokenizer

from shelfmark.llm import tokens
from shelfmark.llm.bitplane import PlaneReader, PlaneWriter, from_planes, to_planes, token_files
from shelfmark.llm.mixture_packing import Schedule, deficit_windows, pack
from shelfmark.llm.tokens import Encoder
from tests_llm_odd import FIELDS, frame, rows

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def model():
    model = Tokenizer.from_file(PATH)
    model.encode_special_tokens = True
    return model


def ids_of(model, text, end):
    return model.encode(text or "", add_special_tokens=False).ids + [end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_remembered_words_give_the_ids_of_whole_texts(model):
    rng, own = random.Random(1), Encoder(PATH)
    parts = ["a", "B", "é", "ß", " ", "  ", "\n", "\t", ".", ",", "!!", "1", "<|endoftext|>",
             "'s", " 's", " ", "ñ", "word", "\x1c", "日本", "’", "x" * 60]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 30))) for _ in range(3000)]
    got = [np.frombuffer(b, own.dtype).tolist() for b in own.encode(texts)]
    assert got == [e.ids for e in model.encode_batch(texts, add_special_tokens=False)]


def test_marks_and_line_breaks_are_cut_off_before_the_library(model):
    rng, own = random.Random(4), Encoder(PATH)
    words = ["".join(rng.choices("abcdéñouß", k=rng.randint(1, 60))) for _ in range(300)]
    ends = ["", ".", "$$$", ".***", "!\n", ",\n", "\n", "'", "_", "?\nthe\n", "\t", "\n\n", "1"]
    texts = [" ".join(rng.choice(words) + rng.choice(ends) + rng.choice(["", rng.choice(words)])
                      for _ in range(200)) for _ in range(40)]
    plain = [" ".join(w + rng.choice(("", ".***", "$$$", ".\n" + w)) for w in words) for _ in range(9)]
    for some in (texts, plain, texts):
        got = [np.frombuffer(b, own.dtype).tolist() for b in own.encode(some)]
        assert got == [e.ids for e in model.encode_batch(some, add_special_tokens=False)]

    class Counted:
        sent = 0

        def encode(self, text, **options):
            self.sent += len(text)
            return model.encode(text, **options)

    own = Encoder(PATH)
    own.model = Counted()
    own.encode(plain)  # of all words only the first of a text goes through the pattern
    assert own.model.sent < sum(map(len, plain)) // 20


def test_no_word_is_held_twice(model, monkeypatch):
    monkeypatch.setattr(tokens, "GENERATION", 100)
    rng, own = random.Random(5), Encoder(PATH)
    common = ["".join(rng.choices("abcdé", k=6)) for _ in range(60)]
    texts = [" ".join([*rng.choices(common, k=30), "".join(rng.choices("xyz", k=9))]) for _ in range(200)]
    for text in texts:
        (got,) = own.encode([text])
        assert np.frombuffer(got, own.dtype).tolist() == ids_of(model, text, 0)[:-1]
        assert not own.words.keys() & own.words.old.keys()
        assert len(own.words) <= 100 and len(own.words.old) <= 100


@pytest.mark.parametrize("bits", [False, True])
def test_planes_round_trip_and_ranges(tmp_path, bits):
    rng = np.random.default_rng(1)
    docs = [rng.integers(0, 1 << 32, n, np.uint32).astype("<u4") for n in (5, 0, 300, 64, 1)]
    store = pafs.LocalFileSystem()
    writer = PlaneWriter(store.open_output_stream(str(tmp_path / "f")), 64, bits)
    for i, d in enumerate(docs):
        writer.add(i if i else None, d)
    writer.close()
    flat = np.concatenate(docs)
    with store.open_input_file(str(tmp_path / "f")) as source:
        reader = PlaneReader(source)
        assert len(reader.chunks) == -(-len(flat) // 64)
        assert list(reader.documents()) == [
            (i if i else None, len(d), crc(d)) for i, d in enumerate(docs)]
        for a, b in ((0, 370), (63, 65), (100, 100), (128, 200)):
            assert (reader.ids(a, b) == flat[a:b]).all()
    assert (from_planes(to_planes(flat, bits), len(flat), bits) == flat).all()


@pytest.mark.parametrize("bits", [False, True])
def test_files_hold_every_document_in_order(spark, model, bits):
    data = rows()
    got = token_files(frame(spark, data), PATH, block=64, file_ids=500, bits=bits).collect()
    want, at = [], 0
    for i, text, _ in sorted(data, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None,
                                                  (r[1] or "").encode())):
        ids = ids_of(model, text, 2)
        want.append((i, at, len(ids), crc(ids)))
        at += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    assert token_files(spark.createDataFrame([], FIELDS), PATH).count() == 0


def test_packing_places_every_token_once(spark, model):
    data = rows()
    got = pack(frame(spark, data), PATH, length=64, window_sequences=4, group_windows=2).collect()
    # Ids that come twice hold the same text here, so pieces are matched by their ids.
    texts = {}
    for i, text, _ in data:
        texts.setdefault(i, []).append(ids_of(model, text, 1))
    copies = {i: len(t) for i, t in texts.items() if i is not None}
    total = sum(len(t) for ts in texts.values() for t in ts)
    assert sum(r.length for r in got) == total
    cover = {}
    for r in got:
        if r.doc_id is not None:
            ids = texts[r.doc_id][0]
            assert r.doc_tokens == len(ids)
            assert r.ids_crc32 == crc(ids[r.start:r.start + r.length])
            for k in range(r.start, r.start + r.length):
                cover[r.doc_id, k] = cover.get((r.doc_id, k), 0) + 1
    assert all(n == copies[i] for (i, _), n in cover.items())
    places = sorted((r.sequence_id, r.offset, r.length) for r in got)
    at = 0
    for sequence, offset, n in places:
        assert sequence * 64 + offset == at and offset + n <= 64
        at += n
    assert at == total
    assert pack(spark.createDataFrame([], FIELDS), PATH).count() == 0


def test_targets_hold_in_every_window(spark, model):
    rng = random.Random(2)
    data = [(i, " ".join(rng.choices(["the", "of", "and"], k=rng.randint(50, 200))),
             "big" if i % 3 else "small") for i in range(120)]
    got = pack(frame(spark, data), PATH, length=64, window_sequences=4, group_windows=2,
               targets={"big": 0.5, "small": 0.5}).collect()
    total = sum(len(ids_of(model, t, 1)) for _, t, s in data if s == "small")
    even = 2 * total // 256  # windows until the small source is used up
    share = {}
    for r in got:
        share.setdefault(r.sequence_id // 4, [0, 0])[data[r.doc_id][2] == "big"] += r.length
    assert even > 3
    assert all(abs(share[w][0] - 128) <= 2 for w in range(even - 1))


def test_schedule_is_exact_and_monotone():
    rng = random.Random(3)
    for _ in range(50):
        totals = [rng.randint(1, 400) for _ in range(rng.randint(1, 6))]
        weights = totals if rng.random() < 0.5 else [rng.randint(1, 9) for _ in totals]
        plan = Schedule(totals, weights)
        tokens = sorted(((2 * k - 1) / w, q) for q, (n, w) in enumerate(zip(totals, weights))
                        for k in range(1, n + 1))
        before = [0] * len(totals)
        for x in range(0, sum(totals) + 7, 7):
            now = plan.given(x)
            assert sum(now) == min(x, sum(totals))
            assert all(a <= b for a, b in zip(before, now))
            last = max(((2 * n - 1) / w for n, w in zip(now, weights) if n), default=0)
            assert all(t >= last - 1e-12 for t, _ in tokens[min(x, len(tokens)):])
            before = now


def test_windows_use_up_quotas():
    quotas, weights = {0: 100, 3: 7, 5: 0}, {0: 10, 3: 1, 5: 3}
    given = {0: 0, 3: 0}
    for queue, n in deficit_windows(quotas, {0: 0.4, 3: -0.4, 5: 0.0}, weights, 16):
        given[queue] += n
    assert given == {0: 100, 3: 7}
