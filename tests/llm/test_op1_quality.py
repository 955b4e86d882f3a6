"""Quality rules beside a plain count over word windows."""

import random
import re
from collections import Counter

import pytest

from flowloom.llm import op1_quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    runs = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    inside = {j for i in range(len(words) - 7) if runs[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    base = len(words) < 20 or 100 * len(inside) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside), base


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    out = [None, "", " \n\t ", "a", "\n\n", "é  à b", "x" * 3_000_000 + " y", "word " * 50, "line one two\n" * 30]
    for n in (5, 30, 200, 4000):
        for letters in ("ab", "abcdefgh", "aé中🙂"):
            out.append("".join(rng.choice(letters + " \n") for _ in range(n)))
    clean = " ".join(f"w{i}" for i in range(300))
    return out + [clean, clean, clean + " " + " ".join(f"w{i}" for i in range(60))]


def test_counts_match_brute_force(spark, texts):
    docs = spark.createDataFrame([(i // 2, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_words string").repartition(3)
    got = op1_quality.quality_rules(docs).drop("line_coverage")
    assert got.columns[:7] == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    want = sorted((i // 2, *plain(t)) for i, t in enumerate(texts))
    assert sorted(tuple(r)[:7] for r in got.collect()) == want
    assert all(not (r.base_failed and r.kept) for r in got.collect())


def coverage(text, n):
    """Share of word characters inside runs of n words that the text holds twice or more."""
    words = WORD.findall(text)
    runs = Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
    inside = {j for i in range(len(words) - n + 1) if runs[tuple(words[i : i + n])] > 1 for j in range(i, i + n)}
    return sum(len(words[j]) for j in inside) / sum(map(len, words))


def line_coverage(text):
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return sum(len(x) for i, x in enumerate(lines) if x in lines[:i]) / sum(map(len, lines))


def planted(run, share, total=400):
    """Clean words in which runs of ``run`` words, each standing twice far apart, make up a share; letters of 1 to 3 bytes."""
    runs = [[f"é中{k}x{j}" for j in range(run)] for k in range(round(total * share / (2 * run)))]
    rest = [f"abc{i}" for i in range(total - 2 * run * len(runs))]
    step, out = max(1, len(rest) // (2 * len(runs) + 1)) if runs else 1, []
    for k, part in enumerate([*runs, *runs]):
        out += rest[k * step : (k + 1) * step] + part
    return " ".join(out + rest[2 * len(runs) * step :])


def test_each_limit_decides_by_itself(spark):
    # runs of 5 to 7 words are seen by the limit of 5 alone, runs of 8 and 9 also by that of 8
    texts = [planted(run, share) for run in (5, 8, 10) for share in (0.0, 0.1, 0.18, 0.22, 0.26, 0.28, 0.34, 0.45)]
    clean = [f"line {i} with words of its own {i * 7}" for i in range(40)]
    texts += ["\n".join(clean + clean[:n]) for n in (0, 1, 4, 8, 12, 20)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    alone = Counter()
    for r in op1_quality.quality_rules(docs).collect():
        text = texts[r.doc_id]
        shares = {n: coverage(text, n) for n in op1_quality.MAX_COVERAGE}
        assert [r[f"coverage_{n}"] for n in shares] == pytest.approx(list(shares.values()))
        assert r.line_coverage == pytest.approx(line_coverage(text))
        over = [n for n, most in op1_quality.MAX_COVERAGE.items() if shares[n] > most]
        over += ["lines"] if r.line_coverage > op1_quality.MAX_LINE_COVERAGE else []
        assert r.kept == (not r.base_failed and not over)
        if len(over) == 1 and not r.base_failed:
            alone[over[0]] += 1
    assert all(alone[n] for n in op1_quality.MAX_COVERAGE), alone


def test_lines_decide_where_runs_are_short(spark):
    short = [f"ab{i} cd{i}" for i in range(40)]
    text = "\n".join(x for i, line in enumerate(short) for x in ([line, f"other{i}", line] if i < 30 else [line]))
    docs = spark.createDataFrame([(1, text), (2, "\n".join(short))], "doc_id long, text string")
    got = {r.doc_id: r for r in op1_quality.quality_rules(docs).collect()}
    assert got[1].line_coverage > op1_quality.MAX_LINE_COVERAGE and got[1].coverage_5 == 0 and not got[1].base_failed
    assert not got[1].kept and got[2].kept


def test_filter_keeps_clean_rows_and_columns(spark):
    clean = " ".join(f"w{i}" for i in range(300))
    rows = [(1, clean, "a"), (2, "ha ha " * 40, "b"), (3, clean + "\n" + clean, "c"), (4, None, "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    got = op1_quality.quality_filter(docs)
    assert got.columns == docs.columns
    assert [tuple(r) for r in got.collect()] == [rows[0]]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert op1_quality.quality_rules(docs).count() == 0
    assert op1_quality.quality_filter(docs).count() == 0
