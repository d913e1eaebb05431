import random
import re
from collections import Counter

import regex

from roomsense.llm import licenses, quality_rules
from tests.llm.helpers import ODD, documents


def figures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    times, covered = Counter(zip(words, words[1:], words[2:])), set()
    for i in range(len(words) - 2):
        if times[tuple(words[i:i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def verdict(text):
    n, chars, symbols, dup, repeat = figures(text)
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\x0b\f\r")]
    base = n < 50 or 100 * repeat > 50 * n
    upper = len(re.findall("[A-Z]", text or ""))
    return base, not (base or 10 * symbols > n or 2 * upper > chars or 2 * dup > len(lines) or chars < 2 * n or chars > 25 * n)


def texts():
    rng = random.Random(3)
    out = ODD + ["A\x0bB\x0cC\x1cD", "\n\n a\n a\n b", "q " * 500, "a b c a b c x y a b"]
    out += [" ".join(rng.choice("ab") for _ in range(rng.randint(0, 12))) for _ in range(150)]
    for n in range(60):
        words = ["w%d" % rng.randrange(400) for _ in range(rng.randint(40, 300))]
        words += rng.choice([[], ["###"] * 30, ["SHOUTED%d" % i for i in range(400)], ["\nline\n"] * 40, words])
        out.append(" ".join(words))
    return out


def test_figures_and_verdict_equal_brute_force(spark):
    rows = texts()
    got = {r["doc_id"]: r for r in quality_rules.measure(documents(spark, rows)).collect()}
    for i, t in enumerate(rows):
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == figures(t), repr(t)[:80]
        assert (r["base_failed"], r["kept"]) == verdict(t), repr(t)[:80]
    assert {r["kept"] for r in got.values()} == {True, False}


def test_repeats_are_found_where_hashes_share_their_high_bits(spark):
    # words are digits, a window's hash is its number below 1000: in a text of 1,000 words or more all high bits are alike
    rng = random.Random(11)
    rows = [" ".join(rng.choice("0123456789") for _ in range(n)) for n in (1100, 1500, 5000)]
    rows += [" ".join("0123456789"[(i * i // 7) % 10] for i in range(1200)), "1 2 3 " * 400, "1 2"]
    number = lambda a, b, c: (a.cast("long") * 100 + b.cast("long") * 10 + c.cast("long"))
    found = quality_rules.with_words(documents(spark, rows, clash=False)).select(
        "doc_id", quality_rules.n_repeat_words(number).alias("n"), quality_rules.n_repeat_words().alias("m"))
    for r in found.collect():
        assert (r["n"], r["m"]) == (figures(rows[r["doc_id"]])[4],) * 2


def test_keep_gives_the_kept_rows_with_their_columns(spark):
    rows = texts()
    docs = documents(spark, rows)
    kept = quality_rules.keep(docs)
    assert kept.columns == docs.columns
    # names that clash but for case are read by place
    assert sorted(r[0] for r in kept.collect()) == [i for i, t in enumerate(rows) if verdict(t)[1]]
    assert quality_rules.keep(documents(spark, rows[:3], clash=False).limit(0)).collect() == []


def test_order_changes_no_verdict(spark):
    rows = documents(spark, texts(), clash=False)
    names = list(quality_rules.RULES)
    plan = quality_rules.plan(rows)
    assert sorted(p["name"] for p in plan) == sorted(names)
    found = []
    for order in (names, names[::-1]):
        kept = quality_rules.with_words(rows.select("doc_id", "text")).where(quality_rules.cascade(order).isNull())
        found.append(sorted(r["doc_id"] for r in kept.select("doc_id").collect()))
    assert found[0] == found[1]


def scanned(text, least=0.8):
    """Best window by trying all windows that the operator defines."""
    words = regex.findall(r"[\p{L}\p{N}]+", (text or "").lower())
    out = {}
    for name, template in licenses.TEMPLATES.items():
        wanted = regex.findall(r"[\p{L}\p{N}]+", template.lower())
        k = min(5, len(wanted))
        have = {tuple(wanted[i:i + k]) for i in range(len(wanted) - k + 1)}
        t = len(have)
        step = max(1, t // 4) if t > 1 else 1
        size = t + step if t > 1 else 1
        best = (0.0, 0)
        for s in range(0, max(0, len(words) - k + 1), step):
            share = len(have & {tuple(words[i:i + k]) for i in range(s, min(s + size, len(words) - k + 1))}) / t
            best = max(best, (share, -s))
        if best[0] >= least:
            out[name] = (best[0], -best[1])
    return out


def test_scan_equals_trying_all_windows(spark):
    rng = random.Random(6)
    rows = list(ODD)
    for name, template in licenses.TEMPLATES.items():
        filler = [f"w{rng.randrange(1000)}" for _ in range(rng.randint(0, 120))]
        words = template.split()
        if len(words) > 20:
            words[rng.randrange(len(words))] = "changed"
        rows += [template, " ".join(filler + words + filler), " ".join(filler + words[: len(words) // 2] + filler), template.upper() + "\n" + template]
    got = {}
    for r in licenses.scan(documents(spark, rows)).collect():
        got.setdefault(r["doc_id"], {})[r["template"]] = (r["containment"], r["start_word"])
    assert got == {i: x for i, t in enumerate(rows) if (x := scanned(t))}
    assert licenses.scan(documents(spark, rows).limit(0)).collect() == []
    assert licenses.scan(documents(spark, rows), templates={}).collect() == []


def test_bands_meet_the_miss_probability():
    for t, step in ((3, 1), (8, 2), (63, 15)):
        j = 0.8 * t / (t + step + 0.2 * t)
        n = licenses.band_count(t, step, 0.8, 1e-4)
        assert (1 - j) ** n <= 1e-4 < (1 - j) ** (n - 1)


def test_native_plans_hold_no_python(spark):
    docs = documents(spark, ["a b c"], clash=False)
    for df in (quality_rules.measure(docs), quality_rules.keep(docs), licenses.scan(docs)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


def test_bodies_of_licences_are_found(spark):
    tail = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED"
    names = ["mit", "isc", "zlib", "bsd-2-clause", "bsd-3-clause", "agpl-notice", "epl-2.0-notice", "boost-1.0-notice", "cc0-notice", "cc-by-nc-4.0", "cc-by-nd-4.0"]
    assert tail in licenses.TEMPLATES["mit"]
    docs = documents(spark, [f"// {licenses.TEMPLATES[n]} and code" for n in names], clash=False)
    got = {(r["doc_id"], r["template"]) for r in licenses.scan(docs).collect()}
    assert got >= set(enumerate(names))
