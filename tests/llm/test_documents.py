"""Operators that look at documents one by one, against brute force, round trips and held-out accuracy."""

import hashlib
import json
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pagewright.llm import language, media, packing, quality, scoring, tokens

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = [
    (1, None), (1, ""), (None, "a <|endoftext|><|endoftext|>b  c\n\n d x\x1cy ź ́"), (2, "it's  we'll\t 12 34.5 é\r\n "), (2, "it's  we'll\t 12 34.5 é\r\n "),
    (3, "Σς  ΑΣ <|startoftext|>x <|ENDOFTEXT|> É́ ẞ ª１２"), (4, "x" * 9000), (5, " \n\t"), (6, "日本語 テキスト 한국어 🙂🙂"), (7, "don't!!! ***a|b|| Été,,, ÿŸ"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string").withColumn("length", F.lit(1)).withColumn("n_words", F.lit("x"))


def empty(df):
    return df.filter("false")


@pytest.mark.parametrize("most", [tokens.CACHE, 3])
def test_token_counts(spark, odd, monkeypatch, most):
    monkeypatch.setattr(tokens, "CACHE", most)
    library = Tokenizer.from_file(BYTES)
    texts = [*ODD, *((20 + i, " ".join(f"word{i * k % 7}, it's\n" for k in range(40 * i))) for i in range(30))]
    want = sorted(((i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in texts), key=repr)
    docs = spark.createDataFrame([(*t, "x", 1) for t in texts], "doc_id long, text string, part string, shard int").repartition(3)
    assert sorted(map(tuple, tokens.token_counts(docs, BYTES).collect()), key=repr) == want
    assert tokens.token_counts(empty(odd), BYTES).count() == 0
    assert [tuple(r) for r in tokens.token_counts(odd.filter("doc_id = 1").drop("length"), BYTES).collect()] == [(1, 0, 0)] * 2


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        tokens.PreTokens(WORDS)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(list("ab'sé  \n\t.!|1<> 　\x1ćΣ") + ["<|endoftext|>", "'ll"]), max_size=30).map("".join))
def test_stretches_and_words_are_the_library(text):
    by = tokens.pre_tokens(BYTES)
    found, special = by.stretches(text)
    words, sizes = by.of(*tokens.sorted_out(found))
    assert sorted(words) == sorted(p for x in found for p, _ in by.library.pre_tokenizer.pre_tokenize_str(x))
    assert len(words) == sizes.sum() and len(sizes) == len(found)
    assert sum(map(by.pieces, words)) + special == len(by.library.encode(text, add_special_tokens=False).ids)
    ids = packing._ids(WORDS)
    assert ids.all([text.encode()])[0] == np.array(ids.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_packing(spark, odd):
    rows = packing.pack(packing.cut_documents(odd, WORDS)).collect()
    library, per, parts = Tokenizer.from_file(WORDS), Counter(), defaultdict(list)
    full = {(i, t): [*library.encode(t or "", add_special_tokens=False).ids, 1] for i, t in ODD}
    for r in rows:
        assert any(zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32 for (i, _), ids in full.items() if i == r.doc_id)
        per[r.doc_id] += r.length
        parts[r.sequence_id].append((r.offset, r.length))
    assert per == Counter({k: sum(len(full[d]) for d in ODD if d[0] == k) for k, _ in ODD})
    for own in parts.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 4096
    assert packing.pack(packing.cut_documents(empty(odd), WORDS)).count() == 0


def test_sum_of_squares():
    rng = np.random.default_rng(5)
    lengths = np.sort(rng.integers(1, 101, 3000))[::-1]
    bins, offsets = packing.sum_of_squares(lengths, 100)
    fill = np.bincount(bins, lengths)
    assert fill.max() <= 100 and len(fill) <= math.ceil(lengths.sum() / 100) * 1.01 + 1
    slow, gaps = 0, []  # the same rule, counted out
    for s in lengths[:300].tolist():
        fits = [g for g in set(gaps) if g >= s]
        if not fits:
            gaps.append(100)
            fits = [100]
        def cost(g):
            count = Counter(x for x in gaps if 0 < x < 100)
            count[g] -= g < 100
            if g - s:
                count[g - s] += 1
            return sum(n * n for n in count.values()), g
        g = min(fits, key=cost)
        gaps.remove(g)
        gaps.append(g - s)
        slow = len(gaps)
    assert packing.sum_of_squares(lengths[:300], 100)[0].max() + 1 == slow


@settings(max_examples=40, deadline=None)
@given(st.lists(st.binary(max_size=3000), min_size=1, max_size=4))
def test_media_round_trip(raws):
    payloads = [media.padded(x) for x in raws]
    stored = media.encode_all(payloads)
    for payload, data, thumbs in zip(payloads, stored, media.thumbnails(stored), strict=True):
        assert b"".join(t.tobytes() for t in thumbs) == payload and len(payload) % 576 == 0 and media.encode(payload) == data


def test_media_sizes_and_faults():
    for n in (0, 576, 577, 24 * 8184, 24 * 8184 + 1):
        payload = media.padded(bytes(i * 31 % 256 for i in range(n)))
        data = media.encode(payload)
        assert b"".join(t.tobytes() for t in media.thumbnails([data])[0]) == payload
    good = media.encode(media.padded(b"x" * 600))
    for bad in (b"GIF", good[:30], good[:-2], good.replace(b"\xff\xc0", b"\xff\xc2", 1), good[:-40] + good[-2:]):
        with pytest.raises(ValueError):
            media.thumbnails([bad])


def jpeg(blocks, sampling, interval):
    """A JPEG by the book: usual DC codes, AC coefficients, several components; blocks: per MCU, per block (component, dc, ac)."""
    dc_codes = [(0b00, 2), (0b010, 3), (0b011, 3), (0b100, 3), (0b101, 3), (0b110, 3), (0b1110, 4), (0b11110, 5), (0b111110, 6), (0b1111110, 7), (0b11111110, 8), (0b111111110, 9)]
    dc = bytes([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0]) + bytes(range(12))
    ac = bytes([0, 1, 2, 1] + [0] * 12) + bytes([0x00, 0x01, 0x12, 0xF0])  # codes 00, 010, 011, 1000
    ac_codes = {0x00: (0b00, 2), 0x01: (0b010, 3), 0x12: (0b011, 3), 0xF0: (0b1000, 4)}
    out, bits, last = b"", "", [0] * len(sampling)

    def flush():
        nonlocal bits
        bits += "1" * (-len(bits) % 8)
        raw = bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00")
        bits = ""
        return raw

    for i, mcu in enumerate(blocks):
        if interval and i and i % interval == 0:
            out += flush() + bytes((0xFF, 0xD0 + (i // interval - 1) % 8))
            last = [0] * len(sampling)
        for c, value, coefficients in mcu:
            diff, last[c] = value - last[c], value
            s = abs(diff).bit_length()
            code, n = dc_codes[s]
            bits += f"{code:0{n}b}" + (f"{diff if diff > 0 else diff + (1 << s) - 1:0{s}b}" if s else "")
            for symbol in coefficients:
                code, n = ac_codes[symbol]
                bits += f"{code:0{n}b}" + "1" * (symbol & 15)
            bits += "00"
    out += flush()
    head = b"\xff\xd8" + media._marker(0xDB, b"\x00" + b"\x10" + b"\x01" * 63)
    h, v = max(s[0] for s in sampling), max(s[1] for s in sampling)
    head += media._marker(0xC0, b"\x08" + (16 * v).to_bytes(2, "big") + (8 * h * len(blocks) // 2).to_bytes(2, "big") + bytes([len(sampling)]) + b"".join(bytes([i + 1, a << 4 | b, 0]) for i, (a, b) in enumerate(sampling)))
    head += media._marker(0xC4, b"\x00" + dc) + media._marker(0xC4, b"\x10" + ac) + (media._marker(0xDD, interval.to_bytes(2, "big")) if interval else b"")
    return head + media._marker(0xDA, bytes([len(sampling)]) + b"".join(bytes([i + 1, 0]) for i in range(len(sampling))) + b"\x00\x3f\x00") + out + b"\xff\xd9"


@pytest.mark.parametrize("sampling", [[(1, 1)], [(2, 2), (1, 1), (1, 1)], [(2, 1), (1, 1), (1, 1)]])
@pytest.mark.parametrize("interval", [0, 3])
def test_media_reads_other_jpegs(sampling, interval):
    rng = random.Random(repr((sampling, interval)))
    own = [c for c, (h, v) in enumerate(sampling) for _ in range(h * v if len(sampling) > 1 else 1)]
    blocks = [[(c, rng.randrange(-60, 60), rng.choices([0x01, 0x12, 0xF0], k=rng.randrange(3))) for c in own] for _ in range(12)]
    (thumb,) = media.thumbnails([jpeg(blocks, sampling, interval)])[0]
    h, v = sampling[0] if len(sampling) > 1 else (1, 1)
    want = np.zeros((2 * v, 6 * h), int)
    for i, mcu in enumerate(blocks):
        for k, (_, value, _) in enumerate([b for b in mcu if b[0] == 0]):
            want[i // 6 * v + k // h, i % 6 * h + k % h] = np.clip((value * 16 + 4) // 8 + 128, 0, 255)
    assert (thumb == want).all()


def test_media_faults_are_rows(spark):
    good, rng = media.encode(media.padded(b"some text " * 70)), random.Random(5)
    for _ in range(600):  # whatever is damaged, it is a ValueError or an image
        bad = bytearray(good)
        for _ in range(rng.randrange(1, 4)):
            bad[rng.randrange(len(bad) if rng.random() < 0.3 else 220)] = rng.randrange(256)
        try:
            media.thumbnails([bytes(bad[: rng.choice([len(bad), rng.randrange(len(bad))])])])
        except ValueError:
            pass
    for code in (0xDB, 0xC0, 0xC4, 0xDA, 0xDD):
        for length in range(2, 12):
            at = good.index(bytes((0xFF, code))) if bytes((0xFF, code)) in good else 2
            with pytest.raises(ValueError):
                media.parse(good[:at] + bytes((0xFF, code)) + length.to_bytes(2, "big") + bytes(length - 2) + b"\xff\xd9")
    rows = [(1, bytearray(good)), (2, bytearray(b"GIF89a")), (3, None), (4, bytearray()), (5, bytearray(good[:-9]))]
    found = {r.doc_id: r for r in media.read_media(spark.createDataFrame(rows, "doc_id int, media binary").coalesce(1)).collect()}
    assert set(found) == {1, 2, 5} and found[1].error is None and found[1].hash and found[2].error and found[2].image is None and found[5].error


def test_media_sizes_are_the_frames(spark):
    """Sizes that aren't whole blocks, bytes behind the last image, images of very different sizes in one batch."""
    good = media.encode(media.padded(b"some text " * 70))
    sof = good.index(b"\xff\xc0")
    h, w = int.from_bytes(good[sof + 5 : sof + 7], "big"), int.from_bytes(good[sof + 7 : sof + 9], "big")
    odd = good[: sof + 5] + (h - 3).to_bytes(2, "big") + (w - 7).to_bytes(2, "big") + good[sof + 9 :]
    rows = [(1, good), (2, odd), (3, good + b"\0\0"), (4, odd + b"trailing \xff\xd8"[:9]), (5, media.encode(media.padded(bytes(200_000)))), (6, good + odd)]
    found = {}
    for r in media.read_media(spark.createDataFrame([(i, bytearray(m)) for i, m in rows], "doc_id int, media binary").coalesce(1)).collect():
        found.setdefault(r.doc_id, []).append((r.width, r.height, bytes(r.thumbnail)))
    thumb = found[1][0][2]
    assert found[1] == [(w, h, thumb)] and found[2] == [(w - 7, h - 3, thumb)] and found[3] == found[1] and found[4] == found[2] and found[6] == found[1] + found[2]
    assert b"".join(t for _, _, t in found[5]) == media.padded(bytes(200_000))
    assert [[t.tobytes() for t in own] for own in media.thumbnails([m for _, m in rows], 1)] == [[t for _, _, t in found[i]] for i, _ in rows]


def test_media_reads_a_scan_a_component():
    """Luminance in a scan of its own, with another component's scan before and after."""
    plain = jpeg([[(0, 10 * i, [])] for i in range(12)], [(1, 1)], 0)
    dqt, sof, rest = plain.index(b"\xff\xdb"), plain.index(b"\xff\xc0"), plain.index(b"\xff\xc4")
    sos = plain.index(b"\xff\xda")
    other = plain[sos:-2].replace(b"\x01\x01\x00", b"\x01\x02\x00", 1)  # the same scan, named for component 2
    frame = media._marker(0xC0, plain[sof + 4 : sof + 9] + b"\x02" + bytes([1, 0x11, 0, 2, 0x11, 0]))
    whole = plain[:dqt] + plain[dqt:sof] + frame + plain[rest:sos] + other + plain[sos:-2] + other + b"\xff\xd9"
    (want,), (got,) = media.thumbnails([plain])[0], media.thumbnails([whole])[0]
    assert (got == want).all()


def test_tokenizers_for_packing(tmp_path):
    with pytest.raises(ValueError):
        packing.Ids(BYTES)  # its tokens hold white space
    changed = json.loads(open(WORDS).read())
    assert packing.Ids(WORDS).simple is packing._SIMPLE
    changed["normalizer"] = None  # capitals are kept, so simple words aren't what they were
    (tmp_path / "t.json").write_text(json.dumps(changed))
    ids = packing.Ids(str(tmp_path / "t.json"))
    text = "Hello naïve, ÉTÉ don't STRASSE! x&|*"
    assert ids.simple("Hello") is None and ids.all([text.encode()])[0] == np.array(ids.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_media_query(odd):
    rows = media.media_features(odd).collect()
    assert len(rows) == len(ODD)
    by = {r.n_bytes: r for r in rows}
    for _, text in ODD:
        raw = (text or "").encode()
        payload, r = media.padded(raw), by[len(raw)]
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
    back = media.read_media(media.media_column(odd)).collect()
    assert len(back) == len(ODD) and media.media_features(empty(odd)).count() == 0


def test_language(spark, odd):
    rng = random.Random(2)
    words = {"aa": ["karo", "milu", "tena", "sora"], "bb": ["gruschel", "pfint", "zwack"], "cc": ["éloué", "çanté", "réau"]}
    rows = [(i, " ".join(rng.choices(words[lang], k=rng.randrange(5, 40))), lang) for i in range(240) for lang in words]
    docs = spark.createDataFrame([*rows, (999, None, "aa"), (998, "karo milu", None)], "doc_id long, text string, lang string")
    model = language.learn(docs.filter("doc_id % 4 <> 2"))
    assert model[0] == ["aa", "bb", "cc"]
    found = language.predict(docs.filter("doc_id % 4 = 2 AND lang IS NOT NULL").select(F.struct("doc_id", "lang").alias("row"), "text"), model, "row").collect()
    assert all(r.lang_pred == r.row.lang and 0 <= r.score <= 1 for r in found if r.lang_pred != "und") and sum(r.lang_pred == "und" for r in found) == 0
    got = {(r.doc_id, r.lang_pred) for r in language.predict(odd, model).collect()}
    assert (5, "und") in got and (1, "und") in got
    nothing = language.learn(empty(docs))
    assert nothing[0] == [] and {r.lang_pred for r in language.predict(docs, nothing).collect()} == {"und"}


def test_language_vectors_bind_and_bundle():
    grams = language.Grams()
    distinct, owner, at = grams.of(["ab", None, "a"])
    first, second, third = language._letters(64)
    a, b, edge = 1, 2, 0
    want = first[edge] * second[a] * third[b] + first[a] * second[b] * third[edge]
    counts = language._counts(owner, at, 3, len(distinct))
    assert (counts[0] @ language._vectors(distinct, 64) == want).all() and counts[1].sum() == 0 and counts[2].sum() == 1


def slow_repeats(words):
    seen = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    return len({i + k for i in range(len(words) - 2) if seen[tuple(words[i : i + 3])] > 1 for k in range(3)})


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from(list("ab #é|\n\t")), max_size=60))
def test_quality_measures(text):
    got = dict(zip(quality.FEATURES, quality.measures(text.encode()), strict=True))
    words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in text).split(" ") if w]
    lines = [x for x in text.split("\n") if x.strip(" \t\x0b\x0c\r")]
    assert got["n_words"] == len(words) and got["word_chars"] == sum(map(len, words)) and got["n_symbols"] == sum(c in "#*$%&|<>" for c in text)
    assert got["n_dup_lines"] == len(lines) - len(set(lines)) and got["n_repeat_words"] == slow_repeats(words)


def test_expectation_maximisation():
    rng = np.random.default_rng(1)
    good = rng.random(20_000) < 0.8
    right = np.array([0.9, 0.8, 0.75, 0.85])
    votes = np.where(rng.random((20_000, 4)) < right, 1, -1) * np.where(good, 1, -1)[:, None]
    votes[rng.random(votes.shape) < 0.2] = 0
    patterns, times = np.unique(votes, axis=0, return_counts=True)
    found = quality.expectation_maximisation(patterns, times.astype(float))
    assert found.prior == pytest.approx(0.8, abs=0.03) and np.abs(found.right.mean(1) - right).max() < 0.04
    assert ((found.posterior(votes) > 0.5) == good).mean() > 0.93
    assert quality.expectation_maximisation(np.zeros((0, 3), int), np.zeros(0)).prior == 0.8


def test_quality(spark, odd):
    rng = random.Random(4)
    clean = [(i, " ".join(rng.choice(["lorem", "ipsum", "dolor", "sit"]) + str(rng.random())[2:5].translate(str.maketrans("0123456789", "abcdefghij")) + rng.choice(["", "", ",", "."]) for _ in range(80))) for i in range(150)]
    junk = [(1000 + i, t.replace(" ", "*** ")) for i, t in clean[:20]]
    rows = {r.doc_id: r for r in quality.judged(spark.createDataFrame(clean + junk, "doc_id long, text string")).collect()}
    assert all(rows[i].kept for i, _ in clean) and not any(rows[i].kept for i, _ in junk)
    found = quality.judged(odd).collect()
    assert len(found) == len(ODD) and all(r.base_failed and not r.kept for r in found)
    assert quality.judged(empty(odd)).count() == 0


@pytest.mark.parametrize("most", [scoring.BROADCAST_BYTES, 0])
def test_scoring(spark, odd, most):
    train = [(i, f"The cat sat on the mat {'again ' * (i % 3)}") for i in range(30)]
    model = scoring.Model(spark.createDataFrame(train, "doc_id long, text string"), broadcast_bytes=most)
    assert (model.filter is None) == (most == 0)
    of = lambda t: [*(t or "").encode().lower().split(), b"\n"]
    count = Counter(w for _, t in train for w in of(t))
    total, floor = sum(count.values()), sum(count.values()) + 0.5 * (len(count) + 1)
    docs = odd.unionByName(spark.createDataFrame([(50, "the CAT sat"), (51, "sat cat THE")], "doc_id long, text string"), allowMissingColumns=True)
    texts = {**{i: t for i, t in ODD}, 50: "the CAT sat", 51: "sat cat THE"}
    rows = scoring.scores(docs, model).collect()
    assert len(rows) == len(ODD) + 2
    for r in rows:
        options = [t for i, t in [*ODD, (50, texts[50]), (51, texts[51])] if i == r.doc_id]
        want = [(len(of(t)), sum(count[w] > 0 for w in of(t))) for t in options]
        assert (r.n_tokens, r.n_known) in want and r.train_tokens == total
        assert any(r.base_score == pytest.approx(sum(math.log10((count[w] + 0.5) / floor) for w in of(t))) for t in options)
    by = {r.doc_id: r for r in rows}
    assert by[50].base_score == pytest.approx(by[51].base_score) and by[50].score > by[51].score
    assert scoring.scores(empty(docs), model).count() == 0
    blank = scoring.Model(empty(docs), broadcast_bytes=most, filter_bytes=-1 if most == 0 else scoring.FILTER_BYTES)
    assert blank.total == 0 and all(r.n_known == 0 for r in scoring.scores(docs, blank).collect())


def test_pairs_seen_once_count(spark):
    train = [(1, "alpha beta"), (2, "gamma delta")]
    model = scoring.Model(spark.createDataFrame(train, "doc_id long, text string"))
    words = Counter(w for _, t in train for w in [*t.split(), "\n"])
    pairs = Counter(p for _, t in train for p in zip(["\n", *t.split()], [*t.split(), "\n"], strict=True))
    texts = {1: "alpha beta", 3: "alpha delta"}
    floor = 6 + 0.5 * 6
    for r in scoring.scores(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), model).collect():
        own = texts[r.doc_id].split()
        chances = [(pairs[v, w] + scoring.MASS * (words[w] + 0.5) / floor) / (words[v] + scoring.MASS) for v, w in zip(["\n", *own], [*own, "\n"], strict=True)]
        assert r.score == pytest.approx(sum(map(math.log10, chances)), rel=1e-9)


@pytest.mark.parametrize("most", [scoring.BROADCAST_BYTES, 0])
def test_scores_do_not_depend_on_filter_bytes(spark, odd, most):
    rng = random.Random(9)
    texts = [" ".join(f"w{int(rng.paretovariate(0.7)) % 5000}" for _ in range(rng.randrange(120))) for _ in range(400)]
    docs = odd.select("doc_id", "text").unionByName(spark.createDataFrame([(1000 + i, t) for i, t in enumerate(texts)], "doc_id long, text string")).repartition(3)
    whole, dealt = (scoring.Model(docs.filter("doc_id % 5 <> 1"), **sizes) for sizes in ({}, {"broadcast_bytes": 0} if most == 0 else {"filter_bytes": 64}))
    assert dealt.filter is None and whole.filter is not None
    got = [sorted(map(tuple, scoring.scores(docs, m).select("doc_id", "n_tokens", "n_known", "score", "base_score").collect()), key=repr) for m in (whole, dealt)]
    assert len(got[0]) == len(ODD) + len(texts) and got[0] == got[1]
    assert scoring.scores(empty(docs), dealt).count() == 0


def test_filter():
    rng = np.random.default_rng(3)
    keys, counts = rng.integers(0, 1 << 63, 5000).astype(np.uint64), rng.integers(1, 3000, 5000)
    levels, shard = scoring.level_of(counts), scoring.shard_of(keys, 4)
    filt = scoring.Filter([scoring.slice_bits(keys[shard == s], levels[shard == s]).tobytes() for s in range(4)])
    got = filt.levels(keys)
    assert (got >= levels).all() and (got == levels).mean() > 0.98
    assert (filt.levels(rng.integers(0, 1 << 63, 5000).astype(np.uint64)) > 0).mean() < 0.02
    assert (np.abs(scoring.ESTIMATES[levels] / counts - 1) < 0.34).all()
