"""Quality rules: a learned decision list over text statistics, in Spark expressions throughout.

Sequential covering on labelled rows: a rule is grown literal by literal on two thirds of the rows,
pruned on the rest, and kept when it is precise enough; rows it covers leave, and the next rule is
grown.  The result is an ordered list of threshold conjunctions, emitted as one conditional
expression.  Statistics, learning counts and verdicts all use DataFrame functions only.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docrecon.llm.common import forget, settled

WHITE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
CUTS = 16  # thresholds tried for each feature
RULES = 8
LITERALS = 3
PRECISION = 0.9  # of a rule on the pruning rows
COVER = 0.005  # of the bad rows; rules that cover less are noise
CHANCE = 0.05  # toxic words that chance alone would be expected to name, of all words together
AROUND = WHITE + "".join(c for c in map(chr, range(33, 127)) if not c.isalnum())  # taken off the ends of words
HITS = (1.0, 2.0, 4.0)  # thresholds of toxic words besides the quantiles, as most texts have none


class Literal(NamedTuple):
    feature: str
    above: bool
    cut: float

    def test(self) -> Column:
        c = F.col(self.feature)
        return c >= F.lit(self.cut) if self.above else c < F.lit(self.cut)


def removed(text: Column, chars: str) -> Column:
    return F.length(F.translate(text, chars, ""))


def word_list(t: Column) -> Column:
    inner = F.btrim(t, F.lit(WHITE))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, r"[\x20\x09-\x0D]+"))


def plain(word: Column) -> Column:
    """A word in lower case, without ASCII marks at its ends."""
    return F.lower(F.btrim(word, F.lit(AROUND)))


def toxic_words(docs: DataFrame, labels: DataFrame) -> list[str]:
    """Words of ``docs(doc_id, text)`` found in toxic labelled texts and hardly elsewhere.

    Of the labelled texts that hold such a word, a share of PRECISION or more is toxic, and by the
    Chernoff bound fewer than CHANCE of all words would reach its counts by chance.  All labelled
    rows count; their texts meet the labels in one join, of one kind at every size, and only the
    words found reach the driver.
    """
    known = labels.where("toxic is not null").groupBy("doc_id").agg((F.max("toxic") == 1).alias("toxic"))
    words = F.array_distinct(F.transform(word_list(F.coalesce("text", F.lit(""))), plain))
    # Every text holds the empty word, whose counts are those of the classes.
    words = F.array_union(words, F.array(F.lit("")))
    counts = settled(
        docs.join(known.hint("merge"), "doc_id").select("toxic", F.explode(words).alias("word")).groupBy("word").agg(
            F.count("*").alias("n"), F.sum(F.col("toxic").cast("long")).alias("t")), "quality-words")
    of, kinds = counts.where("word = ''").first(), counts.count()
    if of is None or not 0 < of.t < of.n:
        forget(counts)
        return []
    p, q = of.t / of.n, F.col("t") / F.col("n")
    far = q * F.log(q / p) + F.when(q < 1, (1 - q) * F.log((1 - q) / (1 - p))).otherwise(0.0)
    found = counts.where((F.col("word") != "") & (F.col("t") > 0) & (q > p) & (q >= PRECISION)).where(
        F.col("n") * far >= math.log(kinds / CHANCE))
    out = [r.word for r in found.orderBy("word").collect()]
    forget(counts)
    return out


def statistics(df: DataFrame, text_col: str = "text", toxic: list[str] = ()) -> DataFrame:
    """Pack the columns of ``df`` into ``row`` and add the statistics of its text (null: empty).

    Words are runs without ASCII white space.  Three-word windows are compared by 64-bit hashes,
    sorted within their row, so a row costs n log n and no row leaves its task.
    """
    n = F.size("words")
    start = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"),
                      F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("t"))
    words = word_list(F.col("t"))
    lines = F.filter(F.split("t", "\n"), lambda x: F.btrim(x, F.lit(WHITE)) != "")
    counted = start.select(
        "row", words.alias("words"), lines.alias("lines"), F.length("t").alias("n_chars"),
        removed(F.col("t"), WHITE).alias("word_chars"),
        (F.length("t") - removed(F.col("t"), SYMBOLS)).alias("n_symbols"),
        (F.length("t") - removed(F.col("t"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ")).alias("n_upper"),
        (F.length("t") - removed(F.col("t"), "!?")).alias("n_marks"),
    )
    windows = F.when(n >= 3, F.slice(
        F.arrays_zip(F.col("words").alias("a"), F.slice("words", F.lit(2), F.greatest(n, F.lit(1))).alias("b"),
                     F.slice("words", F.lit(3), F.greatest(n, F.lit(1))).alias("c")), F.lit(1), F.greatest(n - 2, F.lit(0))))
    hashes = F.transform(windows, lambda w: F.xxhash64(w["a"], w["b"], w["c"]))
    keep = ["row", "n_chars", "word_chars", "n_symbols", "n_upper", "n_marks"]
    hits = F.size(F.filter("words", lambda w: plain(w).isin(list(toxic)))) if toxic else F.lit(0)
    hashed = counted.select(
        *keep, n.alias("n_words"), F.size("lines").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"), hits.alias("n_toxic_words"),
        hashes.alias("h"))
    keep += ["n_words", "n_lines", "n_dup_lines", "n_toxic_words"]
    ordered = hashed.select(*keep, F.when(
        F.size(F.array_distinct("h")) < F.size("h"),
        F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))).alias("o"))
    pairs = F.filter(F.arrays_zip(F.col("o").alias("p"), F.slice("o", F.lit(2), F.greatest(F.size("o"), F.lit(1))).alias("q")),
                     lambda z: z["p"]["h"] == z["q"]["h"])
    places = F.array_distinct(F.flatten(F.transform(pairs, lambda z: F.array(z["p"]["i"], z["q"]["i"]))))
    covered = F.array_distinct(F.flatten(F.transform(places, lambda i: F.array(i, i + 1, i + 2))))
    done = ordered.select(*keep, F.when(F.col("o").isNull(), 0).otherwise(F.size(covered)).alias("n_repeat_words"))
    keep += ["n_repeat_words"]
    return done.select("row", *[F.col(c).cast("long").alias(c) for c in keep[1:]])


FEATURES = {
    "words": lambda: F.col("n_words").cast("double"),
    "word_length": lambda: F.col("word_chars") / F.greatest("n_words", F.lit(1)),
    "symbols": lambda: F.col("n_symbols") / F.greatest("n_words", F.lit(1)),
    "marks": lambda: F.col("n_marks") / F.greatest("n_words", F.lit(1)),
    "upper": lambda: F.col("n_upper") / F.greatest("word_chars", F.lit(1)),
    "repeated": lambda: F.col("n_repeat_words") / F.greatest("n_words", F.lit(1)),
    "same_lines": lambda: F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1)),
    "toxic_words": lambda: F.col("n_toxic_words").cast("double"),
    "line_words": lambda: F.col("n_words") / F.greatest("n_lines", F.lit(1)),
}


def featured(stats: DataFrame) -> DataFrame:
    """Add the features of the statistics under names that no statistic has."""
    return stats.select("*", *[make().alias(f"f_{name}") for name, make in FEATURES.items()])


def _gain(good: float, bad: float, good0: float, bad0: float) -> float:
    """Information gained on bad rows by narrowing (good0, bad0) to (good, bad)."""
    if not bad:
        return 0.0
    return bad * (math.log2(bad / (good + bad)) - math.log2(bad0 / (good0 + bad0)))


def learn(labelled: DataFrame, rules: int = RULES, literals: int = LITERALS) -> list[list[Literal]]:
    """Decision list from ``labelled``: feature columns, ``bad`` boolean and ``prune`` boolean.

    All labelled rows count.  What reaches the driver is, for each step, one number for each feature,
    bin and class.  No rule comes from an empty table, or from one with a single class.
    """
    names = [f"f_{name}" for name in FEATURES]
    shares = [(k + 0.5) / CUTS for k in range(CUTS)]
    got = labelled.agg(
        *[F.percentile_approx(c, shares, 10_000).alias(c) for c in names], F.sum(F.col("bad").cast("int")).alias("n")
    ).first()
    total = got["n"] or 0
    cuts = {c: sorted({*(got[c] or []), *(HITS if c == "f_toxic_words" else ())}) for c in names}
    if not total:
        return []
    bins = [sum(((F.col(c) >= F.lit(x)).cast("int") for x in cuts[c]), F.lit(0)).alias(c) for c in names]
    rows = settled(labelled.select("bad", "prune", *bins), "quality-bins")

    def test(rule) -> Column:
        """A rule over bins: ``(feature, above, number of cuts passed)``."""
        out = F.lit(True)
        for c, above, k in rule:
            out = out & (F.col(c) >= k if above else F.col(c) < k)
        return out

    left, found = rows, []
    while len(found) < rules:
        rule: list[tuple[str, bool, int]] = []
        for _ in range(literals):
            part = left.where(~F.col("prune") & test(rule))
            counts = part.select("bad", F.explode(F.array(*[
                F.struct(F.lit(c).alias("f"), F.col(c).alias("k")) for c in names])).alias("x")
            ).groupBy("x.f", "x.k").agg(
                F.sum(F.col("bad").cast("int")).alias("bad"), F.sum((~F.col("bad")).cast("int")).alias("good")).collect()
            of = {(r.f, r.k): (r.good, r.bad) for r in counts}
            good0 = sum(v[0] for (f, _), v in of.items() if f == names[0])
            bad0 = sum(v[1] for (f, _), v in of.items() if f == names[0])
            best = (1e-9, None)
            for c in names:
                for k in range(1, len(cuts[c]) + 1):
                    up = [sum(of.get((c, j), (0, 0))[s] for j in range(k, len(cuts[c]) + 1)) for s in (0, 1)]
                    for above, (g, b) in ((True, up), (False, (good0 - up[0], bad0 - up[1]))):
                        if b >= COVER * total and (c, above, k) not in rule:
                            best = max(best, (_gain(g, b, good0, bad0), (c, above, k)), key=lambda x: x[0])
            if best[1] is None:
                break
            rule.append(best[1])
            if not good0:
                break
        if not rule:
            break
        heads = [rule[:k] for k in range(1, len(rule) + 1)]
        sums = [F.sum((test(h) & (F.col("bad") == bad)).cast("int")) for h in heads for bad in (True, False)]
        n = [x or 0 for x in left.where("prune").agg(*sums).first()]
        worth = [((n[2 * k] - n[2 * k + 1]) / max(1, n[2 * k] + n[2 * k + 1]), k) for k in range(len(heads))]
        at = max(worth, key=lambda w: (w[0], -w[1]))[1]
        if n[2 * at] < PRECISION * max(1, n[2 * at] + n[2 * at + 1]):
            break
        found.append(heads[at])
        left = left.where(~test(heads[at]))
    forget(rows)
    return [[Literal(c, above, float(cuts[c][k - 1])) for c, above, k in rule] for rule in found]


def verdict(rules: list[list[Literal]]) -> Column:
    """Name of the first rule that a row meets, else null."""
    out = None
    for k, rule in enumerate(rules, 1):
        test = F.lit(True)
        for literal in rule:
            test = test & literal.test()
        name = F.lit(f"{k}: " + " and ".join(f"{x.feature[2:]} {'>=' if x.above else '<'} {x.cut:.6g}" for x in rule))
        out = F.when(test, name) if out is None else out.when(test, name)
    return F.lit(None).cast("string") if out is None else out


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def learn_from(stats: DataFrame, labels: DataFrame) -> list[list[Literal]]:
    """Decision list from the statistics ``(doc_id, ...)`` of documents that ``labels(doc_id,
    quality, toxic)`` covers; quality 0 is bad, and so is toxic 1.  Rows without a label or an id
    teach nothing."""
    toxic = F.coalesce(F.col("toxic") == 1, F.lit(False))
    known = labels.where(F.col("quality").isNotNull() | toxic).groupBy("doc_id").agg(
        F.max(toxic | F.coalesce(F.col("quality") == 0, F.lit(False))).alias("bad"))
    rows = featured(stats).join(known, "doc_id").withColumn("prune", F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0)
    return learn(rows.select("bad", "prune", *[f"f_{name}" for name in FEATURES]))


def judge(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, statistics, base_failed, rule, kept)`` of every row.

    A row fails with fewer than 50 words, or when more than half of them stand in repeated
    three-word windows; else the learned list decides (``rule`` is the one that rejects it).  Null
    and empty texts have no words and fail.  Rows are judged one by one: repeated rows and null ids
    pass through; other columns are not read.  Texts are shuffled once, to meet their labels, from
    which the toxic words are learned; else only labelled statistics are.
    """
    narrow = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    stats = statistics(narrow, toxic=toxic_words(narrow, labels)).select("row.doc_id", *[c for c in STATISTICS])
    stats = settled(stats, "quality-statistics")
    rules = learn_from(stats, labels)
    judged = featured(stats).select(
        "doc_id", *STATISTICS, base_failed().alias("base_failed"), verdict(rules).alias("rule"))
    return judged.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull()).withColumnRenamed("doc_id", id_col)


STATISTICS = ("n_chars", "word_chars", "n_symbols", "n_upper", "n_marks", "n_words", "n_lines", "n_dup_lines",
              "n_toxic_words", "n_repeat_words")


def keep_good(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``df`` that ``judge`` keeps, with all their columns and no join on the id.

    Rows are written once with their statistics; the rules are learned from that table and filter it,
    so no statistic is worked out again for each rule that reads it.
    """
    narrow = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    stats = settled(statistics(df, text_col, toxic_words(narrow, labels)), "quality-rows")
    rules = learn_from(stats.select(F.col(f"row.`{id_col}`").alias("doc_id"), *STATISTICS), labels)
    return featured(stats).where(~base_failed() & verdict(rules).isNull()).select("row.*")
