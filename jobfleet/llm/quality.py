"""Quality rules as weak supervision, built from DataFrame functions only.

Each rule votes good (1), bad (-1) or abstains (0). Expectation-maximisation over the counts of
vote patterns of all documents (at most 3 to the number of rules, whatever the corpus size)
estimates how often each rule is right; a document's posterior probability of being good then
decides, in place of a list of rules that must all pass.

Model: a document is good with some prior probability. A rule that votes says bad of a good
document at its error rate and of a bad document at its recall, independently of the other rules.
Recall never falls below the error rate, so no rule can turn against its meaning, and an
abstention is no evidence. Vote patterns are counted over all documents, and the steps work on those counts alone.

Defined results: null and empty texts have no words and fail the base; very long texts are read
whole; repeated rows are counted as often as they occur and judged alike; an empty table gives an
empty result; extra columns pass through, and of clashing names the new column wins.
"""

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobfleet.llm.common import BLANK, let, stage, words

RULES = ("length", "word_length", "symbols", "lines", "repeats", "letters", "stop_words", "variety", "endings")
STEPS = 12
START_PRIOR, PRIOR_RANGE = 0.9, (0.5, 0.99)
START_ERROR, ERROR_RANGE = 0.02, (0.002, 0.2)
START_RECALL, RECALL_RANGE = 0.4, (0.1, 0.95)
KEEP_FROM = 0.5
REPEAT_WINDOW = 5
FIGURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "p_good", "kept")
SYMBOLS = "#*$%&|<>"
#: Frequent function words of the four languages of the corpus.
STOP_WORDS = (
    "the of and to in is was that for with on as are "
    "der die das und in den von zu mit auf ist im "
    "le la les de et des en un une du que pour "
    "el los las y del que en por con para se no"
).split()


def repeat_words(terms: Column, window: int = REPEAT_WINDOW) -> Column:
    """How many words lie in windows of consecutive words found twice or more in the text."""

    def covered(starts: Column) -> Column:
        gaps = F.transform(
            starts,
            lambda p, i: F.when(i + 1 < F.size(starts), F.least(F.get(starts, i + 1) - p, F.lit(window))).otherwise(window),
        )
        return F.aggregate(gaps, F.lit(0), lambda total, g: total + g)

    def repeated(hashes: Column) -> Column:
        """Starts of repeated windows: runs of equal hashes after sorting (hash, start) pairs."""
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        same = let(
            pairs,
            lambda s: F.filter(
                s,
                lambda x, k: ((k > 0) & (F.get(s, k - 1)["h"] == x["h"]))
                | ((k + 1 < F.size(s)) & (F.get(s, k + 1)["h"] == x["h"])),
            ),
        )
        return let(F.sort_array(F.transform(same, lambda x: x["i"])), covered)

    hashes = F.transform(
        F.sequence(F.lit(0), F.size(terms) - window), lambda i: F.xxhash64(*[terms[i + k] for k in range(window)])
    )
    found = let(
        hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(repeated(h))
    )
    return F.when(F.size(terms) <= window, F.lit(0)).otherwise(found)


def measures(text: Column) -> Column:
    """A struct of whole-text figures."""
    text = F.coalesce(text, F.lit(""))
    long = lambda value: value.cast("long")
    solid = F.regexp_replace(text, BLANK, "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    ended = lambda x: x.rlike(r"[.!?:;\"'”»)\]][\x20\x09-\x0D]*$")
    line_figures = let(
        lines,
        lambda x: F.struct(
            long(F.size(x)).alias("n_lines"),
            long(F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines"),
            long(F.size(F.filter(x, ended))).alias("n_ended"),
        ),
    )
    word_figures = let(
        words(text),
        lambda w: F.struct(
            long(F.size(w)).alias("n_words"),
            long(repeat_words(w)).alias("n_repeat_words"),
            long(F.size(F.array_distinct(w))).alias("n_distinct"),
            long(F.size(F.array_intersect(w, F.array(*map(F.lit, dict.fromkeys(STOP_WORDS)))))).alias("n_stop"),
        ),
    )
    return F.struct(
        long(F.length(solid)).alias("word_chars"),
        long(F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).alias("n_symbols"),
        long(F.length(F.regexp_replace(text, r"\P{L}+", ""))).alias("n_letters"),
        line_figures.alias("line"),
        word_figures.alias("word"),
    )


def votes(m: Column) -> dict[str, Column]:
    """A vote for each rule from the measures."""
    n, line, word = m["word"]["n_words"], m["line"], m["word"]

    def vote(bad: Column, good: Column) -> Column:
        return F.when(bad, -1).when(good, 1).otherwise(0)

    return {
        "length": vote(n < 10, n >= 50),
        "word_length": vote((m["word_chars"] < 2 * n) | (m["word_chars"] > 15 * n), m["word_chars"].between(3 * n, 10 * n)),
        "symbols": vote(10 * m["n_symbols"] > n, (m["n_symbols"] == 0) & (n >= 50)),
        "lines": vote(10 * line["n_dup_lines"] > 3 * line["n_lines"], (line["n_dup_lines"] == 0) & (line["n_lines"] >= 3)),
        "repeats": vote(100 * word["n_repeat_words"] > 20 * n, (100 * word["n_repeat_words"] <= 2 * n) & (n >= 50)),
        "letters": vote(10 * m["n_letters"] < 8 * m["word_chars"], 10 * m["n_letters"] >= 9 * m["word_chars"]),
        "stop_words": vote((word["n_stop"] == 0) & (n >= 30), word["n_stop"] >= 3),
        "variety": vote(10 * word["n_distinct"] < n, (10 * word["n_distinct"] >= 4 * n) & (n >= 50)),
        "endings": vote((10 * line["n_ended"] < 3 * line["n_lines"]) & (line["n_lines"] >= 3), 10 * line["n_ended"] >= 8 * line["n_lines"]),
    }


def posterior(cast: list[Column], model: dict) -> Column:
    """Probability that a document with these votes is good; an abstention is no evidence."""
    score = F.lit(_logit(model["prior"]))
    for vote, good, bad in zip(cast, model["bad_if_good"], model["bad_if_bad"], strict=True):
        score += F.when(vote < 0, math.log(good / bad)).when(vote > 0, math.log((1 - good) / (1 - bad))).otherwise(0.0)
    return 1 / (1 + F.exp(-score))


def _logit(p: float) -> float:
    return math.log(p / (1 - p))


def _within(value: float, bounds: tuple[float, float]) -> float:
    return min(bounds[1], max(bounds[0], value))


def fit(patterns: DataFrame, steps: int = STEPS) -> dict:
    """Fit the model to a table of vote patterns: one column per rule, and ``n``.

    There are at most 3 to the number of rules (19,683) patterns, whatever the corpus is; these counts are all that
    comes to the driver. Sums are exact ones, so the order of the rows does not matter.
    """
    rows = [(tuple(r[name] for name in RULES), r["n"]) for r in patterns.select(*RULES, "n").collect()]
    model = {"prior": START_PRIOR, "bad_if_good": [START_ERROR] * len(RULES), "bad_if_bad": [START_RECALL] * len(RULES)}
    total = sum(n for _, n in rows)
    for _ in range(steps if total else 0):
        good = [n * _posterior(cast, model) for cast, n in rows]
        bad = [n - g for (_, n), g in zip(rows, good, strict=True)]

        def rate(weights: list[float], rule: int, start: float) -> float:
            # one pseudo vote at the starting rates stands in where a rule never votes
            against = math.fsum(w for (cast, _), w in zip(rows, weights, strict=True) if cast[rule] < 0)
            either = math.fsum(w for (cast, _), w in zip(rows, weights, strict=True) if cast[rule])
            return (against + start) / (either + 1)

        errors = [_within(rate(good, i, START_ERROR), ERROR_RANGE) for i in range(len(RULES))]
        recalls = [_within(rate(bad, i, START_RECALL), RECALL_RANGE) for i in range(len(RULES))]
        model = {
            "prior": _within(math.fsum(good) / total, PRIOR_RANGE),
            "bad_if_good": errors,
            "bad_if_bad": [max(e, r) for e, r in zip(errors, recalls, strict=True)],
        }
    return model


def _posterior(cast: tuple[int, ...], model: dict) -> float:
    """``posterior`` of one pattern."""
    score = _logit(model["prior"])
    for vote, good, bad in zip(cast, model["bad_if_good"], model["bad_if_bad"], strict=True):
        score += math.log(good / bad) if vote < 0 else math.log((1 - good) / (1 - bad)) if vote > 0 else 0.0
    return 1 / (1 + math.exp(-score))


def measured(docs: DataFrame, keep_text: bool) -> DataFrame:
    """``row`` (the columns of ``docs``), ``m`` (measures) and ``votes``.

    Without the texts this is staged, so that they are measured once. With them it would be the corpus written once more;
    they are measured a second time instead.
    """
    kept = [c for c in docs.columns if c not in FIGURES and (keep_text or c != "text")]
    row = F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row")  # out of the way of the names used here
    rows = docs.select(row, measures(F.col("text")).alias("m"))
    cast = votes(F.col("m"))
    voted = rows.withColumn("votes", F.struct(*[cast[r].alias(r) for r in RULES]))
    return voted if keep_text else stage(voted, "measures")


def judge(docs: DataFrame, keep_text: bool = True) -> DataFrame:
    """``docs`` with the base figures, base_failed, p_good and kept; every row stays, and its text if wanted."""
    rows = measured(docs, keep_text)
    model = fit(rows.groupBy("votes").agg(F.count(F.lit(1)).alias("n")).select("votes.*", "n"))
    m = F.col("m")
    n = m["word"]["n_words"]
    failed = (n < 10) | (100 * m["word"]["n_repeat_words"] > 20 * n)
    good = posterior([F.col("votes")[r] for r in RULES], model)
    figures = {
        "n_words": n,
        "word_chars": m["word_chars"],
        "n_symbols": m["n_symbols"],
        "n_dup_lines": m["line"]["n_dup_lines"],
        "n_repeat_words": m["word"]["n_repeat_words"],
        "base_failed": failed,
        "p_good": good,
        "kept": ~failed & (good >= KEEP_FROM),
    }
    return rows.select("row.*", *[figures[c].alias(c) for c in FIGURES])
