"""Quality rules as a short-circuit cascade, in DataFrame functions only.

A document is rejected by the first rule that fails.  Rules that fail seldom or cost much should come late, so the order
is planned: over a sample of at most ``sample_rows`` rows every rule is timed and its rejections counted, and the rules
are put in order of rejections per second.  The sample decides the order alone; a document's verdict is the same in every
order, and every rule reads the whole text.

``measure`` gives the figures that the rules use; ``cascade`` computes a figure only when its rule is reached.

Words are ``[^\\x20\\x09-\\x0D]+``.  A null or empty text has no words and fails the first rule; repeated rows get
equal verdicts; an empty table gives an empty result; further columns are kept by ``keep`` and ignored elsewhere.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roomsense.llm.common import SPACE_CHARS, SPACES, pick, written

SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _without(text, chars: str) -> Column:
    return F.length(F.translate(text, chars, ""))


def with_words(rows: DataFrame) -> DataFrame:
    """Adds words and n_words to rows with a text.

    The words come out of a generator: a filter above cannot then be pushed below it, where the split would be repeated
    for every element that a rule looks at.
    """
    bare = F.btrim("text", F.lit(SPACE_CHARS))
    rows = rows.withColumn("text", F.coalesce("text", F.lit(""))).select("*", F.explode_outer(F.array(F.split(bare, f"[{SPACES}]+"))).alias("words"))
    return rows.withColumn("n_words", F.when(F.col("words")[0] == "", 0).otherwise(F.size("words")).cast("long"))


def word_chars() -> Column:
    return _without("text", SPACE_CHARS)


def n_symbols() -> Column:
    return F.length("text") - _without("text", SYMBOLS)


def n_upper() -> Column:
    return F.length("text") - _without("text", UPPER)


def _lines() -> Column:
    return F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(SPACE_CHARS)) != "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value``, which is evaluated once."""
    return F.transform(F.array(value), body)[0]


def n_dup_lines() -> Column:
    return let(_lines(), lambda x: F.size(x) - F.size(F.array_distinct(x)))


def mostly_dup_lines() -> Column:
    return let(_lines(), lambda x: 2 * (F.size(x) - F.size(F.array_distinct(x))) > F.size(x))


def n_repeat_words(window_hash: Callable[..., Column] = F.xxhash64) -> Column:
    """Words in a 3-word window that the text holds twice or more.

    Windows are hashed to 64 bits.  The low bits of a hash give way to the window's place, the packed numbers are
    sorted, and neighbours with equal hashes are repeats; sorted again by place, each repeat covers the words up to
    the next.  Where unlike hashes share their high bits, as can happen among millions of windows, their places may
    interleave; such a text's (hash, place) pairs are sorted whole instead.
    """
    words = F.col("words")
    hashes = F.when(F.col("n_words") >= 3, F.transform(F.sequence(F.lit(0), (F.col("n_words") - 3).cast("int")),
                                                       lambda i: window_hash(words[i], words[i + 1], words[i + 2])))
    bits = F.length(F.bin("n_words"))
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1

    def twice(s: Column, same: Callable[[Column, Column], Column], place: Callable[[Column], Column]) -> Column:
        found = F.transform(s, lambda x, i: F.when(((i > 0) & same(F.get(s, i - 1), x)) | ((i < F.size(s) - 1) & same(F.get(s, i + 1), x)), place(x)))
        return F.sort_array(F.filter(found, lambda x: x.isNotNull()))

    def by_pairs(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return let(pairs, lambda s: twice(s, lambda a, b: a["h"] == b["h"], lambda x: x["i"]))

    def places(h: Column, mask: Column) -> Column:
        def high(x):
            return x.bitwiseAND(F.bitwise_not(mask))

        def low(x):
            return x.bitwiseAND(mask).cast("int")

        def unlike(a, b):
            return (high(a) == high(b)) & (h[low(a)] != h[low(b)])

        def alike(a, b):
            return (high(a) == high(b)) & (h[low(a)] == h[low(b)])

        def search(s: Column) -> Column:
            mixed = F.exists(F.transform(s, lambda x, i: (i > 0) & unlike(F.get(s, i - 1), x)), lambda x: x)
            return F.when(mixed, by_pairs(h)).otherwise(twice(s, alike, low))

        return let(F.sort_array(F.transform(h, lambda x, i: high(x).bitwiseOR(i.cast("long")))), search)

    def covered(at: Column) -> Column:
        return F.aggregate(at, F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
                           lambda acc, x: F.struct((acc["n"] + F.least(F.lit(3), x - acc["last"])).alias("n"), x.alias("last")),
                           lambda acc: acc["n"])

    found = let(F.struct(hashes.alias("h"), mask.alias("m")), lambda x: let(places(x["h"], x["m"]), covered))
    return F.coalesce(F.when(F.col("n_words") >= 3, found), F.lit(0)).cast("long")


#: Name -> the condition under which a document is rejected, over (text, words, n_words).
RULES: dict[str, Callable[[], Column]] = {
    "few_words": lambda: F.col("n_words") < 50,
    "repeated_words": lambda: 100 * n_repeat_words() > 50 * F.col("n_words"),
    "symbols": lambda: 10 * n_symbols() > F.col("n_words"),
    "capitals": lambda: 2 * n_upper() > word_chars(),
    "repeated_lines": mostly_dup_lines,
    "word_length": lambda: let(word_chars(), lambda n: (n < 2 * F.col("n_words")) | (n > 25 * F.col("n_words"))),
}
BASE = ("few_words", "repeated_words")
#: Texts of the sample that orders the rules are no longer than this; it decides the order alone, never a verdict.
SAMPLE_CHARS = 20_000


def plan(docs: DataFrame, text_col: str = "text", sample_rows: int = 1000, rules: dict | None = None) -> list[dict]:
    """The rules in order of rejections per second over a sample: name, seconds, rejected, rows.

    The sample is the first ``sample_rows`` texts of at most ``SAMPLE_CHARS`` characters that a reader meets; Spark reads no
    more partitions than that takes and shuffles nothing."""
    rules = RULES if rules is None else rules
    first = pick(docs, text=text_col).where(F.coalesce(F.length("text"), F.lit(0)) <= SAMPLE_CHARS).limit(sample_rows).collect()
    sample = written(docs.sparkSession.createDataFrame(first, "text string"), "rule-sample")
    rows = with_words(sample).select("text", "words", "n_words")
    found, n = [], rows.agg(F.sum("n_words"), F.count("*")).first()[1]
    for name, rule in rules.items():
        began = time.perf_counter()
        rejected = rows.agg(F.count_if(rule())).first()[0]
        found.append({"name": name, "seconds": time.perf_counter() - began, "rejected": rejected, "rows": n})
    return sorted(found, key=lambda x: (-(x["rejected"] + 0.5) / (x["seconds"] + 1e-6), x["name"]))


def cascade(order: list[str], rules: dict | None = None) -> Column:
    """Name of the first rule, in this order, that rejects; null for a kept document.  Later rules are not evaluated."""
    rules = RULES if rules is None else rules
    out = None
    for name in order:
        out = F.when(rules[name](), name) if out is None else out.when(rules[name](), name)
    return F.lit(None).cast("string") if out is None else out


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = 1000) -> DataFrame:
    """Every row's figures and verdict: ``id_col``, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept and rejected_by.  The figures are asked for every row, so the cascade reuses them here."""
    order = [x["name"] for x in plan(docs, text_col, sample_rows)]
    rows = with_words(pick(docs, id=id_col, text=text_col))
    rows = rows.select("id", "text", "n_words", word_chars().cast("long").alias("word_chars"), n_symbols().cast("long").alias("n_symbols"),
                       n_dup_lines().cast("long").alias("n_dup_lines"), n_repeat_words().alias("n_repeat_words"))
    known = RULES | {
        "repeated_words": lambda: 100 * F.col("n_repeat_words") > 50 * F.col("n_words"),
        "symbols": lambda: 10 * F.col("n_symbols") > F.col("n_words"),
        "capitals": lambda: 2 * n_upper() > F.col("word_chars"),
        "word_length": lambda: (F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 25 * F.col("n_words")),
    }
    base = known["few_words"]() | known["repeated_words"]()
    rows = rows.withColumn("base_failed", base).withColumn("rejected_by", cascade(order, known))
    return rows.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                       F.col("rejected_by").isNull().alias("kept"), "rejected_by")


def keep(docs: DataFrame, text_col: str = "text", sample_rows: int = 1000) -> DataFrame:
    """The rows that no rule rejects, with their columns."""
    order = [x["name"] for x in plan(docs, text_col, sample_rows)]
    names = docs.columns
    at = names.index(text_col)
    rows = docs.toDF(*(f"c{i}" for i in range(len(names)))).withColumn("text", F.col(f"c{at}"))
    kept = with_words(rows).where(cascade(order).isNull())
    return kept.select(*(f"c{i}" for i in range(len(names)))).toDF(*names)


#: DuckDB SQL for ``measure``'s figures and verdict over the view ``documents`` (unique doc_id).
MEASURES_SQL = r"""
d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
split AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
place AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM split),
three AS (SELECT doc_id, i, word, lead(word, 1) OVER o AS b, lead(word, 2) OVER o AS c FROM place
          WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
seen AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, word, b, c) AS times FROM three WHERE c IS NOT NULL),
hit AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM seen WHERE times > 1)
        GROUP BY doc_id),
line AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM d),
dup AS (SELECT doc_id, count(*) AS lines, count(*) - count(DISTINCT x) AS n FROM line
        WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (SELECT doc_id, t, CAST(len(w) AS BIGINT) AS n_words,
             CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_upper,
             CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, coalesce(dup.lines, 0) AS n_lines,
             CAST(coalesce(hit.n, 0) AS BIGINT) AS n_repeat_words
      FROM split LEFT JOIN dup USING (doc_id) LEFT JOIN hit USING (doc_id)),
verdict AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
                   NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 10 * n_symbols > n_words OR 2 * n_upper > word_chars
                        OR 2 * n_dup_lines > n_lines OR word_chars < 2 * n_words OR word_chars > 25 * n_words) AS kept FROM m)"""
ORACLE_SQL = f"WITH {MEASURES_SQL}\nSELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM verdict"
