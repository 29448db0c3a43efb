import difflib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagewright.functions import diffs, distance
from pagewright.functions import text as T
from pagewright.plans import text_queries  # noqa: F401  registers its queries


def slow_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(st.text("abé ", max_size=40), st.text("abé ", max_size=40))
def test_distance_is_levenshtein(a, b):
    assert T.edit_distance(a, b) == slow_distance(a, b) == T.edit_distance(b, a)
    assert T.word_distance(a, b) == slow_distance([w for w in a.split(" ") if w], [w for w in b.split(" ") if w])


def test_distance_of_long_texts():
    rng = random.Random(3)
    a = "".join(rng.choice("abcdefgh ") for _ in range(900))
    b = "".join(c for c in a if rng.random() > 0.05) + "xyz"
    assert T.edit_distance(a, b) == slow_distance(a, b)


@pytest.mark.parametrize(("words", "few", "long"), [(1, 1, 10**6), (64, 1, 10**6), (4096, 12, 2500), (4096, 10**6, 0)])
def test_distances_of_many_pairs(monkeypatch, words, few, long):
    """Groups of one pair, of some, of all, and none; lengths around the words' borders."""
    monkeypatch.setattr(distance, "WORDS", words)
    monkeypatch.setattr(distance, "FEW", few)
    monkeypatch.setattr(distance, "LONG", long)
    rng = random.Random(words)
    made = lambda n: "".join(rng.choice("abé 日\U0001f600") for _ in range(n))
    a = [made(rng.choice([0, 1, 2, 30, 63, 64, 65, 127, 128, 129, 200])) for _ in range(60)]
    b = [rng.choice([made(rng.randrange(150)), x, x[3:], "".join(c for c in x if rng.random() > 0.1), ""]) for x in a]
    assert distance.of_texts(a, b).tolist() == [slow_distance(x, y) for x, y in zip(a, b, strict=True)]
    cut = lambda t: [w for w in t.split(" ") if w]
    assert distance.of_words(a, b).tolist() == [slow_distance(cut(x), cut(y)) for x, y in zip(a, b, strict=True)]
    assert distance.of_texts([], []).tolist() == [] and distance.of_texts([""], ["xyz"]).tolist() == [3]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.text("ab", max_size=140), st.text("ab", max_size=140)), max_size=30))
def test_distances_of_pairs_are_those_of_each(pairs):
    a, b = [x for x, _ in pairs], [y for _, y in pairs]
    assert distance.of_texts(a, b).tolist() == [distance.single(list(x), list(y)) for x, y in pairs]


@settings(max_examples=200, deadline=None)
@given(st.text("ab\U0001f600", max_size=30), st.text("ab\U0001f600", max_size=30))
def test_bounds_hold(a, b):
    coded = [np.frombuffer(x.encode("utf-32-le"), np.uint32) for x in (a, b)]
    least, most = distance.bounds(*coded)
    assert least <= slow_distance(a, b) <= most


def test_long_texts_of_exchanged_letters_need_no_matrix(monkeypatch):
    """Letters that are exchanged for others that the text lacks: the bounds meet."""
    a = "".join(random.Random(5).choice("abcdenos ") for _ in range(60_000))
    b = a.translate(str.maketrans("eosn", "C05u"))
    changed = sum(x in "eosn" for x in a)
    expected = [changed, distance.single(list(a[:3000]), list(a[5:3005]))]
    monkeypatch.setattr(distance, "single", lambda x, y, f=distance.single: f(x, y) if len(x) < 4000 else pytest.fail("a matrix of 60,000 x 60,000"))
    assert distance.of_texts([a, a[:3000]], [b, a[5:3005]]).tolist() == expected


def test_rates_of_texts_whose_cells_are_beyond_an_int(spark):
    """Two texts of 50,000 characters have 2.5 * 10^9 cells."""
    a = "ab cd " * 8_400
    rows = spark.createDataFrame([(1, a, a[:-6] + "ab ce "), (2, a, a), (3, a, ""), (4, "abc", "abd")], "page_id int, truth string, raw string")
    found = {r.page_id: r for r in rows.select("page_id", T.edits(F.col("truth"), F.col("raw")).alias("n")).collect()}
    assert {k: r.n for k, r in found.items()} == {1: 1, 2: 0, 3: len(a), 4: 1}


def _long_tables(spark, folder):
    """documents of which one is a single line of 50,400 characters, every one with a label."""
    texts = ["one sees no end " * 3_150, "short\nno one", None]
    spark.createDataFrame(list(enumerate(texts, 1)), "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1,), (2,), (3,)], "doc_id long").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


#: Edits a character of that line: e, o, s and n are changed, then c and 0 back to e and o.
LONG_RATES = 11 * 3_150 / (16 * 3_150 - 1), 5 * 3_150 / (16 * 3_150 - 1)


def test_eval_per_page_takes_long_documents(spark, tmp_path):
    found = {r.page_id: r for r in text_queries.eval_per_page(spark, _long_tables(spark, tmp_path)).collect()}
    assert found[1].cer_raw == pytest.approx(LONG_RATES[0]) and found[1].cer_corrected == pytest.approx(LONG_RATES[1]) and found[1].wer_raw == 1
    assert sorted(found) == [1, 2]  # a null text has no truth


def test_eval_report_takes_long_documents(spark, tmp_path):
    (row,) = text_queries.eval_report(spark, _long_tables(spark, tmp_path)).collect()
    assert (row.evaluated, row.total_processed) == (2, 3) and 0 < row.cer_corrected_mean < row.cer_raw_mean < 1


def test_accuracy_ext_takes_long_lines(spark, tmp_path):
    found = {r.doc_id: r for r in text_queries.accuracy_ext(spark, _long_tables(spark, tmp_path)).collect()}
    assert found[1].accuracy_raw == pytest.approx(1 - LONG_RATES[0]) and found[1].accuracy_corrected == pytest.approx(1 - LONG_RATES[1])


def test_cer_lines_takes_long_lines(spark, tmp_path):
    found = {r.page_id: r for r in text_queries.cer_lines(spark, _long_tables(spark, tmp_path)).collect()}
    assert sorted(found) == ["1_0", "2_0", "2_1"] and (found["1_0"].cer_raw, found["1_0"].cer_corrected) == pytest.approx(LONG_RATES)


def test_cer_report_lines_takes_long_lines(spark, tmp_path):
    (row,) = text_queries.cer_report_lines(spark, _long_tables(spark, tmp_path)).collect()
    assert (row.evaluated, row.total_processed) == (3, 3) and 0 < row.cer_corrected_mean < row.cer_raw_mean < 1


def test_normalized_as_python_does(spark):
    spaces = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())
    rows = [("\n a \tb \n",), (spaces + "x" + spaces + "y" + spaces,), ("",), (None,), ("  ",), ("nospace",)]
    df = spark.createDataFrame(rows, "t string").select("t", T.normalized(F.col("t")).alias("n"), T.strip(F.col("t")).alias("s"))
    for r in df.collect():
        assert r.n == (None if r.t is None else " ".join(r.t.split()))
        assert r.s == (None if r.t is None else r.t.strip())


def test_lines_as_python_does(spark):
    rows = [("a\n\nb\n",), ("a\r\nb\rc",), ("",), ("\n",), ("a\x0bb\x0cc\x1cd\x85e f ",), (None,), ("x\n\r\ny",)]
    for r in spark.createDataFrame(rows, "t string").select("t", T.split_lines(F.col("t")).alias("l")).collect():
        assert r.l == (None if r.t is None else r.t.splitlines())


def test_rates(spark):
    rows = [("abc", "abc", 0.0, 0.0), ("abc", "", 1.0, 1.0), ("a", "a b c", 4.0, 2.0), ("", "x", None, None), (None, "x", None, None), ("der Hund", "der Hand", 1 / 8, 0.5)]
    df = spark.createDataFrame(rows, "a string, b string, c double, w double")
    out = df.select("c", "w", T.cer(F.col("a"), F.col("b")).alias("c1"), T.cer_builtin(F.col("a"), F.col("b")).alias("c2"), T.wer(F.col("a"), F.col("b")).alias("w1"), T.wer_builtin(F.col("a"), F.col("b")).alias("w2"))
    for r in out.collect():
        for got, want in ((r.c1, r.c), (r.c2, r.c), (r.w1, r.w), (r.w2, r.w)):
            assert got == want if want is None else got == pytest.approx(want)


@pytest.mark.parametrize("cells", [0, 12, 10**9])
def test_rates_do_not_depend_on_the_kind_of_distance(spark, monkeypatch, cells):
    monkeypatch.setattr(T, "BUILT_IN_CELLS", cells)
    rows = [("abc", "abd"), ("kitten on the mat", "sitting at a mat"), ("", "x"), (None, "x"), ("x", None), ("é", "e"), ("a" * 600, "ab" * 400)]
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", T.edits(F.col("a"), F.col("b")).alias("n")).collect()
    assert [r.n for r in got] == [None if r.a is None or r.b is None else T.edit_distance(r.a, r.b) for r in got]


def test_whole_pages(spark, tmp_path):
    """The flagship against a matrix filled cell by cell."""
    from pagewright.plans.registry import QUERIES

    texts = {1: "one sea\nnoise é", 2: "no son\n\ncosy", 3: "unlabelled", 6: None}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i,) for i in (1, 2, 6)], "doc_id long").write.parquet(f"{tmp_path}/labels.parquet")
    fold, noisy, repaired = lambda t: " ".join(t.split()), str.maketrans("eosn", "c05u"), str.maketrans("c0", "eo")
    want = {}
    for i in (1, 2):
        truth, raw = fold(texts[i]), fold(texts[i].translate(noisy))
        fixed = fold(texts[i].translate(noisy).translate(repaired))
        want[i] = [slow_distance(cut(truth), cut(x)) / len(cut(truth)) for x in (raw, fixed) for cut in (str, str.split)]
    got = {r.page_id: r for r in QUERIES["eval_per_page"](spark, str(tmp_path)).collect()}
    assert set(got) == set(want)
    for i, r in got.items():
        assert [r.cer_raw, r.wer_raw, r.cer_corrected, r.wer_corrected] == pytest.approx(want[i])
    report = QUERIES["eval_report"](spark, str(tmp_path)).first()
    assert (report.evaluated, report.total_processed) == (2, 4) and report.wer_raw_mean == pytest.approx((want[1][1] + want[2][1]) / 2)


def test_diff():
    assert T.diff_text("a\nb\n", "a\nc\n") == "--- ocr_raw+++ llm_corrected@@ -1,2 +1,2 @@ a\n-b\n+c\n"
    assert T.diff_text("same", "same") == ""


def applied(before, found):
    """What hunks make of a text."""
    lines, out, at = before.splitlines(keepends=True), [], 0
    for h in found:
        out += lines[at : h["old_start"]]
        body = h["text"][h["text"].index(" @@") + 3 :].splitlines(keepends=True)
        at = h["old_start"] + h["old_lines"]
        assert len(out) == h["new_start"]
        new = [x[1:] for x in body if x[0] in " +"]
        assert [x[1:] for x in body if x[0] in " -"] == lines[h["old_start"] : at] and len(new) == h["new_lines"]
        out += new
    return "".join(out + lines[at:])


def longest_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=40), st.lists(st.sampled_from("abce"), max_size=40))
def test_scripts_are_shortest(a, b):
    kept = diffs.kept(a, b)
    assert all(a[i] == b[j] for i, j in kept) and len(kept) == longest_common(a, b)
    assert all(i < x and j < y for (i, j), (x, y) in zip(kept, kept[1:], strict=False))
    before, after = "".join(x + "\n" for x in a), "".join(x + "\n" for x in b)
    found = diffs.hunks(before, after)
    assert applied(before, found) == after and applied(after, diffs.hunks(after, before)) == before
    assert all(y["old_start"] - x["old_start"] - x["old_lines"] > 0 for x, y in zip(found, found[1:], strict=False))


def test_diffs_have_the_usual_form():
    """Where the script is plain, as the standard library writes it."""
    rng = random.Random(5)
    for _ in range(200):
        a = [f"line {i}\n" for i in range(rng.randrange(40))]
        b = [f"new {x}" if rng.random() < 0.1 else x for x in a if rng.random() > 0.05]
        b = [y for x in b for y in ([x, f"more after {x}"] if rng.random() < 0.05 else [x])]
        want = "".join(difflib.unified_diff(a, b, *T.DIFF_NAMES, lineterm=""))
        assert T.diff_text("".join(a), "".join(b)) == want
    assert T.diff_text("", "x") == "--- ocr_raw+++ llm_corrected@@ -0,0 +1 @@+x" and T.diff_text("a\r\nb", "a\r\n") == "--- ocr_raw+++ llm_corrected@@ -1,2 +1 @@ a\r\n-b"


def test_long_diffs():
    a = [f"{i} c\n" for i in range(30_000)]
    b = [x.replace("c", "e") if i % 3 else x for i, x in enumerate(a)]
    assert len(diffs.kept(a, b)) == 10_000  # lines without a partner are set aside
    moved = a[5000:5200] + a[:5000] + a[5200:]
    assert len(diffs.kept(a, moved)) == 29_800


def test_diff_columns(spark):
    rows = [("a\nb\n", "a\nc\n"), ("same", "same"), (None, "x"), ("x", None), ("", "y"), ("a\n" * 30 + "z\n" + "a\n" * 30, "b\n" + "a\n" * 59 + "c")]
    df = spark.createDataFrame(rows, "a string, b string").select("a", "b", T.unified_diff(F.col("a"), F.col("b")).alias("d"), F.size(T.hunks(F.col("a"), F.col("b"))).alias("n"))
    for r in df.collect():
        assert r.d == (None if r.a is None or r.b is None else T.diff_text(r.a, r.b))
        assert r.n == (None if r.a is None or r.b is None else len(diffs.hunks(r.a, r.b)))


def test_page_end(spark):
    assert spark.createDataFrame([("  x \n\n",)], "t string").select(T.page_terminated(F.col("t"))).first()[0] == "x\n"


def test_line_rates_are_of_whole_lines(spark, tmp_path):
    from pagewright.plans.registry import QUERIES

    texts = {1: "sea één noise\nÜberseße  nose \n日本 one", 2: "éso\n\nno", 3: "nés sonné", 4: "unlabelled é"}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i,) for i in (1, 2, 3)], "doc_id long").write.parquet(f"{tmp_path}/labels.parquet")
    noisy, repaired, fold = str.maketrans("eosn", "c05u"), str.maketrans("c0", "eo"), lambda t: " ".join(t.split())
    cer, wer = {}, {}
    for i in (1, 2, 3):
        for n, line in enumerate(texts[i].split("\n")):
            raw = line.translate(noisy)
            truth, *read = (fold(x) for x in (line, raw, raw.translate(repaired)))
            for rates, cut in ((cer, str), (wer, str.split)):
                found = [slow_distance(cut(truth), cut(x)) / len(cut(truth)) if truth else None for x in read]
                rates[f"{i}_{n}"] = (found[0], found[1] if i % 3 else None)
    rows = lambda name: {r[0]: pytest.approx(tuple(r)[1:], abs=1e-8) for r in QUERIES[name](spark, str(tmp_path)).collect()}
    mean = lambda values: sum(own) / len(own) if (own := [x for x in values if x is not None]) else None
    assert cer == rows("cer_lines") and wer == rows("wer_lines")
    own = {i: [v for k, v in cer.items() if k.startswith(f"{i}_")] for i in (1, 2, 3)}
    assert {i: tuple(mean(None if v[s] is None else 1 - v[s] for v in x) for s in (0, 1)) for i, x in own.items()} == rows("accuracy_ext")
    report = QUERIES["cer_report_lines"](spark, str(tmp_path)).first()
    assert (report.evaluated, report.total_processed) == (7, 8)
    assert (report.cer_raw_mean, report.cer_corrected_mean) == pytest.approx(tuple(mean(v[s] for v in cer.values()) for s in (0, 1)), abs=1e-8)
