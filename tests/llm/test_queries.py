"""The ten queries as registered, over the smallest tables: against their SQL, or against brute force."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from pagewright.llm import jaccard, language, media, packing, quality, queries, scoring

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables here")


@pytest.fixture(scope="module")
def docs():
    return pd.read_parquet(f"{DATA}/documents.parquet").astype(object).where(lambda x: x.notna(), None).to_dict("records")


def run(spark, name):
    return queries.QUERIES[name](spark, DATA).collect()


def rest(doc_id, modulus):
    return zlib.crc32(str(doc_id).encode()) % modulus


def words(text):
    return (text or "").encode().lower().split()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, name):
    found = queries.QUERIES[name](spark, DATA)
    con = duckdb.connect()
    for path in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    want = con.execute(queries.ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(found.columns)
    plain = lambda rows: sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows), key=repr)
    assert plain(map(tuple, found.select(*columns).collect())) == plain(want.fetchall())


def test_language(spark, docs):
    rows = {r.doc_id: r for r in run(spark, "op2_language_id")}
    assert len(rows) == len(docs) and all(r.held_out == (rest(i, 4) == 2) and 0 <= r.score <= 1 for i, r in rows.items())
    judged = [d for d in docs if d["lang"] and rest(d["doc_id"], 4) == 2 and any(c.isalpha() for c in d["text"] or "")]
    right = sum(rows[d["doc_id"]].lang_pred == d["lang"] for d in judged)
    assert len(judged) > 20 and right >= 0.95 * len(judged)
    # the vectors bound and bundled one trigram after the other
    kinds, (first, second, third) = language._classes(), language._letters(language.DIM)

    def vector(text):
        own, codes = np.zeros(language.DIM), [0, *(int(kinds[ord(c)]) for c in text or ""), 0]
        for a, b, c in zip(codes, codes[1:], codes[2:], strict=False):
            if b:
                own += first[a] * second[b] * third[c]
        return own

    sums, vectors = defaultdict(lambda: np.zeros(language.DIM)), {d["doc_id"]: vector(d["text"]) for d in docs}
    for d in docs:
        if d["lang"] and rest(d["doc_id"], 4) != 2:
            sums[d["lang"]] += vectors[d["doc_id"]]
    for i, own in vectors.items():
        r = rows[i]
        assert (r.lang_pred == "und") == (not own.any())
        if own.any():
            cosines = {x: own @ v / np.linalg.norm(own) / np.linalg.norm(v) for x, v in sums.items()}
            assert r.score == pytest.approx(max(0, cosines[r.lang_pred]), abs=1e-4) and cosines[r.lang_pred] >= max(cosines.values()) - 1e-4


def test_scoring(spark, docs):
    of = lambda t: [*words(t), scoring.END]
    train = [of(d["text"]) for d in docs if rest(d["doc_id"], 5) != 1]
    count = Counter(w for t in train for w in t)
    pairs = Counter(p for t in train for p in zip([scoring.END, *t], t, strict=False))
    total, floor = sum(count.values()), sum(count.values()) + 0.5 * (len(count) + 1)
    about = lambda n: scoring.ESTIMATES[scoring.level_of(np.array([n]))[0]] if n else 0.0
    texts, off = {d["doc_id"]: of(d["text"]) for d in docs}, 0
    for r in run(spark, "op3_lm_scoring"):
        own = texts[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (rest(r.doc_id, 5) == 1, len(own), sum(count[w] > 0 for w in own), total)
        assert r.base_score == pytest.approx(sum(math.log10((count[w] + 0.5) / floor) for w in own))
        chances = [(min(about(pairs[v, w]), about(count[v])) + scoring.MASS * (about(count[w]) + 0.5) / floor) / (about(count[v]) + scoring.MASS) for v, w in zip([scoring.END, *own], own, strict=False)]
        want = sum(map(math.log10, chances))  # of the quantised counts, without false members
        assert r.score >= want - 1e-6 * abs(want) - 0.02 * len(own) and r.score <= want + max(0.03 * abs(want), 3)
        off += r.score != pytest.approx(want, rel=1e-2)
    assert off < 0.05 * len(docs)


def test_a_full_filter_ends():
    full = scoring.Filter([b"\xff" * 64])
    assert (full.levels(np.arange(100, dtype=np.uint64)) == len(scoring.ESTIMATES) - 1).all()


def test_quality(spark, docs):
    rows = {r.doc_id: r for r in run(spark, "op4_quality_rules")}
    inf = math.inf
    votes = {}
    for d in docs:
        f = dict(zip(quality.FEATURES, quality.measures((d["text"] or "").encode()), strict=True))
        n, r = f["n_words"], rows[d["doc_id"]]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == tuple(f[c] for c in quality.FEATURES[:5])
        assert r.base_failed == (n < 50 or 100 * f["n_repeat_words"] > 50 * n)
        share = lambda a, b: a / b if b else None
        measured = [  # value, bounds outside which the vote is bad, bounds within which it is good
            (share(f["n_symbols"], n), 0, 0.1, (0, 0.02)), (share(f["n_plain"], n), 0.7, 1, (0.9, 1)), (share(f["n_marks"], f["word_chars"]), 0, 0.12, (0, 0.06)), (share(f["word_chars"], n), 2.5, 12, None),
            (share(f["n_upper"], f["n_upper"] + f["n_lower"]), 0, 0.3, None), (share(f["n_shouts"], n), 0, 0.15, None), (share(f["n_dup_lines"], f["n_lines"]) if f["n_lines"] >= 3 else None, 0, 0.3, None),
            (share(f["n_repeat_words"], n) if n >= 20 else None, 0, 0.3, None), (share(f["n_stops"], n) if n >= 20 else None, 0.03, inf, (0.06, inf)),
        ]
        votes[d["doc_id"]] = [0 if x is None else -1 if x < low or x > high else 1 if good and good[0] <= x <= good[1] else 0 for x, low, high, good in measured]
    # expectation-maximisation, a document and a rule at a time
    prior, right = 0.8, [[0.8, 0.8] for _ in range(9)]

    def posterior(own):
        good, bad = prior, 1 - prior
        for (b, g), v in zip(right, own, strict=True):
            good *= {1: g, -1: 1 - g, 0: 1}[v]
            bad *= {1: 1 - b, -1: b, 0: 1}[v]
        return good / (good + bad)

    for _ in range(200):
        now = {i: posterior(v) for i, v in votes.items()}
        after = []
        for k in range(9):
            pair = []
            for side, vote in ((0, -1), (1, 1)):
                weight = {i: p if side else 1 - p for i, p in now.items()}
                agree, cast = sum(weight[i] for i, v in votes.items() if v[k] == vote), sum(weight[i] for i, v in votes.items() if v[k])
                pair.append(min(max((agree + 0.8) / (cast + 1), 0.5), 1 - 1e-6))
            after.append(pair)
        moved = max(abs(a - b) for x, y in zip(after, right, strict=True) for a, b in zip(x, y, strict=True))
        prior, right = min(max(sum(now.values()) / len(now), 1e-6), 1 - 1e-6), after
        if moved < 1e-9:
            break
    for i, r in rows.items():
        assert r.quality == pytest.approx(posterior(votes[i]), abs=1e-5) and r.kept == (not r.base_failed and r.quality >= 0.5)


def test_media(spark, docs):
    texts = {d["doc_id"]: (d["text"] or "").encode() for d in docs}
    for r in run(spark, "op5_media_columns"):
        raw = texts[r.doc_id]
        payload = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        stored = media.encode(payload)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())


def test_jaccard(spark, docs):
    sets, root = [], list(range(len(docs)))
    for d in docs:
        w = words(d["text"])
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 4 * min(len(a), len(b)) >= 3 * max(len(a), len(b)) and 100 * len(a & b) >= 75 * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(docs):
        least[find(i)] = min(least.get(find(i), d["doc_id"]), d["doc_id"])
    assert sorted(map(tuple, run(spark, "op6_jaccard_join"))) == sorted((d["doc_id"], len(s), least[find(i)]) for i, (d, s) in enumerate(zip(docs, sets, strict=True)))


def packed(rows, ids):
    """Whether rows are the pieces of ids by document, laid side by side."""
    mine, place = defaultdict(list), defaultdict(list)
    for r in rows:
        mine[r.doc_id].append(r)
        place[r.sequence_id].append((r.offset, r.length))
    for doc_id, own in ids.items():
        pieces = sorted(mine.pop(doc_id), key=lambda r: r.piece)
        assert [(r.piece, r.start, r.length) for r in pieces] == [(k, at, min(4096, len(own) - at)) for k, at in enumerate(range(0, len(own), 4096))]
        assert all(r.ids_crc32 == zlib.crc32(np.array(own[r.start : r.start + r.length], "<u4").tobytes()) for r in pieces)
    assert not mine
    for own in place.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 4096
    return len(place), sum(map(len, ids.values()))


def test_packing(spark, docs):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    n, total = packed(run(spark, "op8_best_fit_packing"), {d["doc_id"]: [*library.encode(d["text"] or "", add_special_tokens=False).ids, 1] for d in docs})
    assert n <= math.ceil(total / 4096) + 1


def test_long_documents_are_cut(spark):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    whole = next(f"{'to ' * n}to" for n in range(4093, 4096) if len(library.encode(f"{'to ' * n}to", add_special_tokens=False).ids) == 4095)
    texts = {1: "naïve words, and 1,234 more! " * 3000, 2: whole, 3: whole + " to", 4: "x" * 70_000, 5: ""}
    rows = packing.pack(packing.cut_documents(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), public_tokenizers.path("word_bpe_49k.json"))).collect()
    packed(rows, {i: [*library.encode(t, add_special_tokens=False).ids, 1] for i, t in texts.items()})
    assert Counter(r.doc_id for r in rows)[2] == 1 and Counter(r.doc_id for r in rows)[3] == 2


def test_token_counts(spark, docs):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for d in docs:
        n = len(library.encode(d["text"] or "", add_special_tokens=False).ids)
        want.append((d["doc_id"], len((d["text"] or "").encode()), n, n > 512))
    assert sorted(map(tuple, run(spark, "op9_token_counts"))) == sorted(want)


def test_very_long_texts(spark):
    """Texts of some megabytes go through the operators that look at documents one by one, and through the join."""
    rng = np.random.default_rng(4)
    text = " ".join(np.array(["alpha", "beta", "gamma", "delta", "épsilon", "zeta.", "eta\n"])[rng.integers(0, 7, 400_000)])
    docs = spark.createDataFrame([(1, text, "aa"), (2, text + " end", "aa"), (3, None, None), (4, "", "bb"), (5, "beta " * 9, "bb")], "doc_id long, text string, lang string")
    found = {r.doc_id: r for r in language.predict(docs, language.learn(docs)).collect()}
    assert found[1].lang_pred == "aa" and found[3].lang_pred == "und"
    n = len(text.split())
    assert {r.doc_id: r.n_tokens for r in scoring.scores(docs, scoring.Model(docs)).collect()} == {1: n + 1, 2: n + 2, 3: 1, 4: 1, 5: 10}
    assert {r.doc_id: r.n_words for r in quality.judged(docs).collect()} == {1: n, 2: n + 1, 3: 0, 4: 0, 5: 9}
    assert {r.doc_id: r.component_id for r in jaccard.linked(docs).collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5}
