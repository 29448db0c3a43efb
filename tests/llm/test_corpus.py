"""Operators over the corpus, against brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pagewright.llm import components, jaccard, lines, mixing, warc


def empty(df):
    return df.filter("false")


# --- mixing ---------------------------------------------------------------------------------------------------------


def test_targets():
    sizes = {"a": 10, "b": 1000, "c": 30, None: 0}
    got = mixing.targets(sizes, {"a": 3, "b": 1, "c": 2, None: 3}, 1.5, 2.0)
    assert sum(got.values()) == pytest.approx(1.5 * 1040) and got["a"] == 20 and got["c"] == 60 and got[None] == 0
    assert mixing.targets({}, {}, 1.5, 2.0) == {}
    assert mixing.by_code_point(["b", None, "ä", "a"]) == ["a", "b", "ä", None]


def test_mixing(spark):
    rng = random.Random(8)
    rows = [(i, rng.choice(["s1", "s2", "s3", None]), " ".join("w" * rng.randrange(1, 5) for _ in range(rng.randrange(0, 60)))) for i in range(600)]
    rows += [(None, "s1", "no id here"), (None, None, None), (600, "s4", ""), (5, "s2", "again " * 4), (5, "s2", "again " * 4)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = mixing.mix(mixing.sized(docs), mixing.repeating()).collect()
    assert len(got) == len(rows) and sum(r.size for r in got) == sum(len((t or "").split()) for *_, t in rows)
    taken, most = defaultdict(int), max(r.size for r in got)
    for r in got:
        assert r.taken <= 2 * r.size
        taken[r.source] += r.taken
    for r in got:
        assert abs(taken[r.source] - r.target) <= most
    # nested: a larger budget takes what a smaller one takes
    small = {(r.key, r.hash): r.copies for r in mixing.mix(mixing.sized(docs), mixing.repeating(), share=0.4).collect()}
    large = {(r.key, r.hash): r.copies for r in mixing.mix(mixing.sized(docs), mixing.repeating(), share=0.9).collect()}
    assert all(large[k] >= v for k, v in small.items())
    again = mixing.mix(mixing.sized(docs.repartition(7)), mixing.repeating()).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))
    assert mixing.mix(mixing.sized(empty(docs)), mixing.repeating()).count() == 0


def test_too_many_sources(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MOST_SOURCES", 3)
    docs = spark.createDataFrame([(i, f"s{i % 4}", "a b", 7, "x") for i in range(8)], "doc_id long, source string, text string, target int, copies string")
    with pytest.raises(ValueError):
        mixing.mix(mixing.sized(docs), mixing.repeating())
    three = docs.filter("doc_id % 4 < 3").withColumn("hash", mixing.hash60("doc_id", "text"))
    found = mixing.with_copies(three, mixing.plan(mixing.sized(three), mixing.repeating()))
    assert found.columns.count("target") == found.columns.count("copies") == 1 and found.count() == 6


# --- near-duplicates ------------------------------------------------------------------------------------------------


def slow_sets(rows):
    out = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        out.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    return out


def slow_components(rows):
    sets, root = slow_sets(rows), list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        least[find(i)] = min((x for x in (least.get(find(i)), k) if x is not None), default=None)
    return sorted(((k, len(s), least[find(i)]) for i, ((k, _), s) in enumerate(zip(rows, sets, strict=True))), key=repr)


def corpus(seed):
    """Unrelated texts, shared passages, exact copies, and groups of copies with more and more words changed."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    passage = [word() for _ in range(60)]
    rows = [" ".join(word() for _ in range(rng.randrange(1, 60))) for _ in range(60)]
    rows += [" ".join([word() for _ in range(20)] + passage + [word() for _ in range(rng.randrange(40))]) for _ in range(40)]
    for size in (4, 7, 12, 30, 200):
        base = [word() for _ in range(size)]
        for k in range(25):
            own = list(base)
            for _ in range(k * size // 250 + k % 2):
                own[rng.randrange(size)] = word()
            rows.append(" ".join(own).upper() if k % 5 == 0 else "\n".join(own))
    rows += rng.sample(rows, 30) + ["", None, "one", "One", "one two three", "a b c d e", "  \t"]
    rows += ["u v w x y z q", "u v w x y z q extra", "u v w x y z q extra more"]
    rng.shuffle(rows)
    return [*enumerate(rows), (None, rows[0]), (None, "alone without any id at all"), (3, rows[3])]


@pytest.mark.parametrize(("seed", "at", "most"), [(1, 2, jaccard.BITMAP_BYTES), (2, 8, 8), (3, 6, jaccard.BITMAP_BYTES), (4, 10**9, jaccard.BITMAP_BYTES)])
def test_jaccard(spark, seed, at, most):
    rows = corpus(seed)
    docs = spark.createDataFrame([(*r, 0, 1) for r in rows], "doc_id long, text string, node int, root int").repartition(3)
    assert sorted(map(tuple, jaccard.linked(docs, frequent_at=at, bitmap_bytes=most).collect()), key=repr) == slow_components(rows)


@pytest.mark.parametrize("blocks", [5, 10**6])
def test_jaccard_of_many_alike(spark, monkeypatch, blocks):
    """Groups whose sets are about as far apart as the bound, over several blocks and in one."""
    monkeypatch.setattr(jaccard, "BLOCK_SETS", blocks)
    rng, rows = random.Random(17), corpus(5)
    for size, changes in ((40, 2), (120, 3), (160, 5)):
        base = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(size)]
        for _ in range(40):
            own = list(base)
            for _ in range(rng.randrange(2 * changes)):
                own[rng.randrange(size)] = "x" * rng.randrange(1, 9)
            rows.append((len(rows) + 1000, " ".join(own[: size - rng.randrange(size // 8)])))
    assert sorted(map(tuple, jaccard.linked(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()), key=repr) == slow_components(rows)


def classes_of(docs, at=jaccard.FREQUENT_AT):
    survey = docs.select("doc_id", "text").mapInArrow(jaccard._surveyed(4, jaccard.WORDS, jaccard.PERCENT, "long"), "id long, n_shingles long, node long, shard int, values binary, other binary")
    return jaccard.Classes(survey.filter("shard IS NOT NULL").select("shard", "values", "other"), at, jaccard.BITMAP_BYTES)


def test_jaccard_of_frequent_shingles(spark):
    rng = random.Random(12)
    base = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(150)]
    rows = [(i, " ".join([*base[:i], "changed", *base[i + 1 :]] if i % 2 else base)) for i in range(40, 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    classes = classes_of(docs)
    whole, changed = jaccard.sets_of([rows[0][1].encode(), rows[11][1].encode()])
    assert (classes.of(whole) == jaccard.FREQUENT).mean() > 0.9 and len(whole) > 100
    assert (classes.of(np.setdiff1d(changed, whole)) == jaccard.LONE).all()
    found = [jaccard.entries(x, classes.of(x)) for x in (whole, changed)]
    assert not np.isin(found[0], whole[classes.of(whole) == jaccard.FREQUENT]).any()  # frequent ones in pairs only
    assert len(np.intersect1d(*found))
    assert sorted(map(tuple, jaccard.linked(docs).collect()), key=repr) == slow_components(rows)


def test_which_entries_the_test_tables_get(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text").repartition(8)
    classes, how = classes_of(docs), Counter()
    for own in jaccard.sets_of([(r.text or "").encode() for r in docs.collect()]):
        kind, need = classes.of(own) if len(own) else np.zeros(0, int), jaccard.slack(len(own)) + 1
        found, single = jaccard.entries(own, kind), int((kind != jaccard.FREQUENT).sum())
        if not jaccard.can_link(len(own)) or (kind == jaccard.LONE).sum() >= need:
            how["none"] += 1
            assert not len(found)
        elif single >= need:
            how["single"] += 1
            assert np.isin(found, own[kind == jaccard.RARE]).all() and len(found) == need - (kind == jaccard.LONE).sum()
        else:
            how["pairs"] += 1
            assert len(np.setdiff1d(found, own))  # every set whose prefix reaches the frequent ones is indexed by pairs of them
            assert not np.isin(found, own[kind == jaccard.FREQUENT]).any()
    assert how["pairs"] > 100 and how["single"] > 100 and how["none"] > 5000, how


def test_jaccard_of_nothing(spark):
    assert jaccard.linked(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert [tuple(r) for r in jaccard.linked(spark.createDataFrame([(1, None)], "doc_id long, text string")).collect()] == [(1, 0, 1)]


@settings(max_examples=300, deadline=None)
@given(st.integers(1, 60), st.integers(0, 20), st.integers(0, 20), st.floats(0, 1), st.integers(0, 10**6))
def test_similar_sets_share_an_entry(n, out, more, share, seed):
    rng = np.random.default_rng(seed)
    a = np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64))
    b = np.unique(np.r_[rng.permutation(a)[min(out, n - 1) :], rng.integers(0, 1 << 62, more).astype(np.uint64)])
    both = len(np.intersect1d(a, b))
    # lone: what only one has; of the rest a share is frequent
    kind = lambda x, y: np.where(np.isin(x, y) | (x % np.uint64(2) > 0), 1 + ((x >> np.uint64(3)) % np.uint64(1000) < np.uint64(int(1000 * share))), 0)
    one, two = jaccard.entries(a, kind(a, b)), jaccard.entries(b, kind(b, a))
    similar = 100 * both >= 75 * (len(a) + len(b) - both)
    if similar and len(a) + len(b) > 2 * both:
        assert len(np.intersect1d(one, two))
    share, alone = [np.zeros(1, np.uint64)] * 2, [np.zeros(1, np.uint64), np.ones(1, np.uint64)]
    assert len(jaccard.joining_links([a, b], np.zeros(2, int), np.arange(2), share)) == similar == len(jaccard.joining_links([a, b], np.arange(2), np.arange(2), share))
    assert not jaccard.joining_links([a, b], np.zeros(2, int), np.arange(2), alone) and not jaccard.joining_links([a, b], np.zeros(2, int), np.zeros(2, int), share)


def test_components(spark):
    rng = random.Random(6)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- lines ----------------------------------------------------------------------------------------------------------


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return a == b
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def slow_dedup(rows):
    every = [((k is None, k or 0), n, line) for k, t in rows if t is not None for n, line in enumerate(t.split("\n"))]
    out = []
    for k, t in rows:
        if t is None:
            out.append((k, None, 0, 0))
            continue
        own, kept = t.split("\n"), []
        for n, line in enumerate(own):
            here = ((k is None, k or 0), n)
            same = lambda x: near(x, line)  # noqa: B023, E731
            if not any(c > " " and c != "\x7f" for c in line) or not any((p, m) < here and same(x) for p, m, x in every):
                kept.append(line)
        out.append((k, "\n".join(kept), len(own), len(own) - len(kept)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("most", [lines.BROADCAST_BYTES, 0])
def test_lines(spark, most):
    rng = random.Random(11)
    base = ["".join(rng.choice("abé 🙂") for _ in range(size)) for size in (1, 1, 2, 2, 3, 4, 5, 7, 9, 12, 15, 19, 20, 21, 33, 60, 2047, 2049, 7000)]

    def changed(line):
        i, kind = rng.randrange(len(line)), rng.randrange(4)
        return [line, line[:i] + line[i + 1 :], line[:i] + "z" + line[i:], line[:i] + "z" + line[i + 1 :]][kind]

    rows = [(i, "\n".join(changed(rng.choice(base)) for _ in range(rng.randrange(1, 6)))) for i in range(45)]
    rows += [(50 + i, "\n".join("".join(rng.choice("abcé") for _ in range(rng.randrange(1, 8))) for _ in range(4))) for i in range(12)]
    rows += [(100, None), (101, ""), (102, "\n \n"), (103, base[3]), (103, base[3]), (None, base[3] + "\nnew line without a number here")]
    docs = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], "doc_id long, text string, line string, id int, n_lines string").repartition(3)
    got = lines.deduplicated(docs, broadcast_bytes=most)
    assert {"line", "id"} <= set(got.columns)
    assert sorted(map(tuple, got.select("doc_id", "text", "n_lines", "n_dropped").collect()), key=repr) == slow_dedup(rows)
    assert lines.deduplicated(empty(docs)).count() == 0


# --- archives -------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("groups", [warc.BROADCAST_GROUPS, 0])
def test_archives(spark, groups):
    big = "<p>é" + "x" * 1200
    rows = [(i, f"http://www.h{i % 7}.example.com/p{i}?q=1", f"{big}{i % 5}" if i % 3 else f"small {i % 2}") for i in range(60)]
    rows += [(100, None, None), (101, "http://h1.example.com/p1?q=1", ""), (None, "not a url \n at all", big + "0"), (59, "https://h0.example.com:8443/", big + "4"), (102, "http://[broken", "x")]
    pages = spark.createDataFrame([(*r, "d") for r in rows], "page_id long, url string, html string, digest string")
    capture = warc.write(pages.repartition(3), block_lines=10, broadcast_groups=groups)
    least = defaultdict(list)
    for i, _, h in rows:
        least[h or ""].append(i)
    want = []
    for i, _, h in rows:
        raw = (h or "").encode()
        response = max((x for x in least[h or ""] if x is not None), default=None)
        again = len(raw) >= 1000 and response is not None and i != response
        want.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", response if again else None))
    got = warc.read(spark, capture, payload=True).collect()
    columns = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted((tuple(r[c] for c in columns) for r in got), key=repr) == sorted(want, key=repr)
    assert all(hashlib.sha1(bytes(r.payload)).hexdigest() == r.payload_digest for r in got if r.record_type == "response")
    found = warc.lookup(spark, capture, ["http://h1.example.com/p1?q=1", "https://nowhere.example.org/"]).collect()
    assert sorted(r.page_id for r in found) == [1, 101]
    for i, u, _ in rows[:60]:
        assert i in [r.page_id for r in warc.lookup(spark, capture, [u], payload=False).collect()] or i % 20
    assert sum(f[5] for f in capture.files) >= 7 and sum(f[6] for f in capture.files) == len(rows)
    again = warc.read(spark, warc.opened(capture.folder), payload=True)  # in another session
    assert again.dtypes == warc.read(spark, capture).dtypes and sorted(map(tuple, again.collect()), key=repr) == sorted(map(tuple, got), key=repr)
    assert warc.read(spark, warc.write(empty(pages))).count() == 0


def test_archives_of_one_url(spark):
    """A URL with many records has several blocks, over several files; keys may be of another type."""
    pages = spark.range(200).selectExpr("cast(id as decimal(20,0)) AS page_id", "if(id % 4 = 0, 'http://a.b/' || id, 'http://one.example.com/') AS url", "repeat('y', 1100 + cast(id % 50 as int)) AS html")
    capture = warc.write(pages.repartition(5), block_lines=7)
    got = warc.read(spark, capture).collect()
    assert sorted(int(r.page_id) for r in got) == list(range(200)) and sum(r.record_type == "response" for r in got) == 50
    assert all(int(r.refers_to) == 150 + int(r.page_id) % 50 for r in got if r.record_type == "revisit")
    assert warc.lookup(spark, capture, ["http://one.example.com/"]).count() == 150


def test_keys_of_any_text(spark):
    """Keys and URLs with what ends a field, a column or an escape; empty and null keys; repeated rows."""
    import gzip

    keys = ["a\r\nX: y", "tab\there", "100%41", "", None, "<urn>", "ü \u2028", " ends ", "a", "a"]
    pages = spark.createDataFrame([(k, f"http://h/{i}\r\nWARC-Type: x\tz", f"<p>{i}") for i, k in enumerate(keys)], "page_id string, url string, html string")
    capture = warc.write(pages.coalesce(1), least=1, block_lines=2)
    got = warc.read(spark, capture, payload=True).collect()
    assert Counter(r.page_id for r in got) == Counter(keys) and {(r.page_id, bytes(r.payload)) for r in got} == {(k, f"<p>{i}".encode()) for i, k in enumerate(keys)}
    files, root = warc._filesystem(capture.folder)
    from pyarrow import fs

    ids = []
    for f in files.get_file_info(fs.FileSelector(root)):
        if f.base_name.endswith(".warc.gz"):
            plain = gzip.decompress(files.open_input_stream(f.path, compression=None).read()).decode()
            assert plain.startswith("WARC/1.1\r\nWARC-Type: warcinfo\r\n")
            ids += [line for line in plain.split("\r\n") if line.startswith("WARC-Record-ID: ")]
    assert len(ids) == len(set(ids)) == len(keys) + 1


def foreign(kind, url, body, version="WARC/1.0", http=True, **more):
    import gzip

    body = b"HTTP/1.1 200 OK\r\nServer: x\r\n\r\n" + body if http else body
    fields = {"warc-type": kind, "WARC-Record-ID": "<urn:uuid:1>", "WARC-Target-URI": url, "Content-Type": "application/http; msgtype=response" if http else "text/plain", "Content-Length": str(len(body)), **{k.replace("_", "-"): v for k, v in more.items()}}
    head = "\r\n".join([version, *(f"{k}:{v}" if k == "warc-type" else f"{k}: {v}" for k, v in fields.items() if v is not None)])
    return gzip.compress(head.encode() + b"\r\n\r\n" + body + b"\r\n\r\n")


def test_archives_of_other_tools(spark, tmp_path):
    import base64

    page = b"<html>" + b"z" * 300_000
    digest = "sha1:" + base64.b32encode(hashlib.sha1(page).digest()).decode()
    (tmp_path / "one.warc.gz").write_bytes(
        foreign("warcinfo", None, b"software: other", http=False) + foreign("request", "http://a.org/", b"") + foreign("response", "<http://a.org/>", page, WARC_Payload_Digest=digest) + foreign("metadata", "http://a.org/", b"x", http=False)
        + foreign("revisit", "http://b.org/again", b"", "WARC/1.1", WARC_Payload_Digest=digest, WARC_Profile="a\r\n b")
    )
    (tmp_path / "two.warc.gz").write_bytes(foreign("resource", "http://c.org/f.txt", b"plain\r\n\r\ntext", http=False) + foreign("response", "http://d.org/", b"no digest", WARC_Payload_Digest="sha256:00"))
    (tmp_path / "empty.warc.gz").write_bytes(b"")
    capture = warc.indexed(spark, f"file://{tmp_path}", block_lines=2)
    plain = hashlib.sha1(page).hexdigest()
    want = {
        ("http://a.org/", len(page), plain, "response"), ("http://b.org/again", None, plain, "revisit"), ("http://c.org/f.txt", 13, hashlib.sha1(b"plain\r\n\r\ntext").hexdigest(), "resource"), ("http://d.org/", 9, "sha256:00", "response"),
    }
    for found in (capture, warc.opened(f"file://{tmp_path}")):
        rows = warc.read(spark, found, payload=True).collect()
        assert {(r.url, r.payload_bytes, r.payload_digest, r.record_type) for r in rows} == want and len(rows) == 4 and all(r.page_id is None for r in rows)
        assert [bytes(r.payload) for r in warc.lookup(spark, found, ["http://c.org/f.txt", "http://nowhere/"]).collect()] == [b"plain\r\n\r\ntext"]
    (tmp_path / "three.warc.gz").write_bytes((tmp_path / "two.warc.gz").read_bytes()[:-9])
    with pytest.raises(Exception, match="ends within a record"):
        warc.indexed(spark, f"file://{tmp_path}", ["three.warc.gz"])
    with pytest.raises(ValueError, match="isn't what was written"):
        warc.parse(foreign("response", "http://a.org/", b"other", WARC_Payload_Digest=digest))


def test_url_keys():
    assert warc.url_key("http://www.A.example.com:80/x?y#z") == "com,example,a)/x?y"
    assert warc.url_key("https://a.b:8443") == "b,a:8443)/" and warc.url_key(None) == ""
    with pytest.raises(ValueError):
        warc.parse(warc.record(1, "u", b"x", 2, "0", None))
