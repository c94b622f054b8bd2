"""Personal data: base patterns, and boosted trees over the spans that loose generators propose.

The base finds four kinds by fixed patterns and checks (see ``base``). Generators with high
recall propose further, overlapping spans: digit groups with other separators or without a plus
sign, parts of long runs of groups, addresses with written-out signs, and a fifth kind, ``secret``: strings of letters and
digits such as passwords and keys. A span's format (lengths, groups, checks, mix of characters)
and its context (neighbouring characters, cue words before it) are features of gradient-boosted
trees; the marks by which the base itself tells a kind (plus sign, at sign) are not among them.

Labels are weak ones, and proposals without one are left out. Positive are what the base confirms, and strings that are given as a password
or key by the words before them, for which those words are no features. Negative are number proposals inside longer
strings of letters and digits. Examples made from templates (``EXAMPLES``) stand for the formats that
corpora rarely label, so that there is a model at every size. Every labelled span of every distinct text
is used. Two thirds by hash fit the trees, a level of a tree in a pass over all of them, of which only sums
by feature and bin reach the driver; on the rest a threshold per kind is calibrated: the least score whose
precision there is ``PRECISION`` (and never under ``LEAST_SCORE``), or none. Selected spans are disjoint and never touch a base span.

Defined results: null and empty texts have no spans; texts are searched whole, in linear time;
equal scores are settled by position; repeated rows are searched each; an empty table gives an
empty result; all columns are kept, and columns named like the results are replaced.
"""

from collections.abc import Iterator
import random
import re
import string

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobfleet.llm.common import stage

KINDS = ("email", "ip", "card", "phone")
ALL_KINDS = (*KINDS, "secret")
PRECISION = 0.98
LEAST_SCORE = 0.5
PLACES = 1 << 20  # hashes of spans' places, which deal them to fit or to calibrate
VARIANTS = 40  # of each example
TREES, DEPTH, RATE = 40, 3, 0.2
CONTEXT = 24

_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_WORTH = re.compile(r"[0-9@]|[(\[]at[)\]]", re.IGNORECASE)

_NUMBERS = re.compile(r"\+?\(?[0-9](?:[ ().\-/]{0,2}[0-9]){6,}")
_FOUR = re.compile(r"(?<![0-9])[0-9]{1,3}(?:[.,:][0-9]{1,3}){3}(?![0-9])")
_SIGN = re.compile(r" ?(?:@|[(\[]at[)\]]) ?", re.IGNORECASE)
_BEFORE = re.compile(r"[\w.%+-]{1,64}\Z")
_DOMAIN = re.compile(r"[\w-]{1,63}(?: ?(?:\.|[(\[]dot[)\]]) ?[\w-]{1,63}){1,5}", re.IGNORECASE)
_CUES = {
    "email": re.compile(r"mail|contact|write", re.IGNORECASE),
    "ip": re.compile(r"\bip\b|host|server|address", re.IGNORECASE),
    "card": re.compile(r"card|visa|credit|payment", re.IGNORECASE),
    "phone": re.compile(r"tel|phone|call|mobile|fax", re.IGNORECASE),
}
_SECRET = re.compile(r"[=:#$\"']\s*\Z|token|password|key|serial|order", re.IGNORECASE)
_STRING = re.compile(r"[A-Za-z0-9+/_-]{12,200}")
_LETTERS = re.compile("[A-Za-z]+")
_DIGIT, _LETTER, _GROUP = re.compile("[0-9]"), re.compile("[A-Za-z]"), re.compile("[0-9]+")
_GIVEN = re.compile(r"(?:password|passwd|pwd|secret|token|api[ _-]?key|access[ _-]?key)[\"']?\s*[:=]\s*[\"']?\Z", re.IGNORECASE)
RUN_GROUPS = 6  # of a long run of digit groups, the parts of up to so many groups are proposed

#: Templates of labelled texts, those of the kind and those that only look like it. The span stands in <>; {d3} are three
#: digits, {x8} hexadecimal ones, {A9} capitals or digits, {b9} letters or digits, {w} is a word and {y} a year.
EXAMPLES = {
    "email": (
        ["{w} <{w} (at) {w} (dot) {w3}> {w}", "<{w}.{w} [at] {w}.{w2}>", "mail <{w}@{w}.{w3}>", "<{w}{d2}(at){w}-{w}.{w3}>", "{w} <{w}_{w} @ {w}.{w3}>"],
        ["{w} <{d2} @ {d1}.{d2}> {w}", "<{w} @ {d3}.{d1}>", "<{w} (at) {w}. {w9} {w}", "<{w} [at] {d1}.{d1}>"],
    ),
    "ip": (
        ["{w} <10.{d2}.{d1}.{d2}> {w}", "host <192.168.{d1}.{d2}>:80", "<172.16.{d1}.1{d2}>"],
        ["<{d1},{d3},{d3},{d3}>", "{w} <{d2}:{d2}:{d2}:{d2}> {w}", "{w} <9{d2}.8{d2}.7{d2}.{d3}> {w}", "{w} <{d1},{d2},{d2},{d1}> {w}"],
    ),
    "card": ([], ["{w} {x1}f<{d16}>", "serial <{d4} {d4} {d4} {d4} {d1}>", "{x2}a<{d15}>b{d1}", "{w} <{d2} {d3} {d2} {d3} {d3}> {w}"]),
    "phone": (
        ["<{d3}-{d3}-{d4}>", "call <({d3}) {d3}-{d4}>", "{w} <(0{d2}) {d4} {d4}>.", "{w} <0{d2} {d4} {d4}> {w}", "tel. <0044 {d2} {d4} {d4}>", "{w} <0{d3} {d4} {d4}> {w}", "phone: <{d2} {d2} {d2} {d2} {d2}>",
         "{w} <{d3}.{d3}.{d4}>", "fax <0{d2}/{d7}>", "{w} <{d3} {d3} {d4}>, {w}"],
        ["on <{y}-0{d1}-1{d1} 1{d1}>:30", "<{d1}.{d1}.{d1}.{d4}>", "<{y}/{d2}/{d2} {d2}>", "<{y}-{y}>/{d2}", "{w} <{d1} {d2} {d3} {d1} {d2}> {w}", "{x2}a<{d8}>b{x3}", "{x1}c<{d7}>f{d1}", "no. <{d9}> {w}", "{w} <{d1}.{d1}.{d1} {d1}.{d1}.{d2}>",
         "${w}<{d3} {d3} {d3}>", "#<{d8}>", "{w}=<{d7}>", "ISBN <{d3}-{d1}-{d2}-{d6}-{d1}>", "{w} <{y} {y} {y}> {w}", "{w} <{y}.0{d1}.1{d1}> {w}"],
    ),
    "secret": (
        ["{w} <{x18}> {w}", '"<{x40}>"', "{w} <{A20}> {w}", "'<{b32}>'", "{w} <{b16}>", "<{b6}-{b8}_{b10}>", "{w} <{x32}> {w}", "<{b24}>,", "{w} <{A16}>"],
        ["{w} <{y}-0{d1}-1{d1}T0{d1}-1{d1}> {w}", "<{w9}-{d2}-{w}-{d1}>", "<{w}_{w9}_{d2}>", "{w} <{w9}{w9}{d1}> {w}", "<{w}{d2}-{w}{d2}-{w9}>", "<{d8}-{d7}a>",
         "img_<{d8}_{d6}_{w3}>", "<{w9}/{w}/{w}{d1}/{w}>", "<{w9}{w9}{y}>", "{w} <{d12}{w2}>", "<{w}-{w}-{w}-{d1}>"],
    ),
}

Span = tuple[str, int, int]


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    total = 0
    for place, c in enumerate(reversed(digits)):
        d = int(c) * (1 + place % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base(text: str) -> list[Span]:
    """Confirmed spans by kind, then start: leftmost matches; those that fail their check are dropped."""
    spans: list[Span] = []
    done = 0
    for m in _AT.finditer(text):
        start = m.start()
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            spans.append(("email", start, m.end()))
            done = m.end()
    for m in _IP.finditer(text):
        parts = [p.lstrip("0") for p in m.group().split(".")]
        if all(len(p) <= 3 and int(p or "0") <= 255 for p in parts):
            spans.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = digits_of(m.group())
        if 16 <= len(digits) <= 19 and luhn(digits):
            spans.append(("card", *m.span()))
    for m in _PHONE.finditer(text):
        if 8 <= len(digits_of(m.group())) <= 15:
            spans.append(("phone", *m.span()))
    return spans


def proposals(text: str) -> list[Span]:
    """Spans that might be personal data; they overlap, and one place may be proposed as several kinds."""
    spans: list[Span] = []
    for m in _SIGN.finditer(text):
        before = _BEFORE.search(text, max(0, m.start() - 64), m.start())
        after = _DOMAIN.match(text, m.end())
        if before and after:
            spans.append(("email", before.start(), after.end()))
    spans += [("ip", *m.span()) for m in _FOUR.finditer(text)]
    for m in _NUMBERS.finditer(text):
        for start, end, n in _runs(m.group()):
            start, end = m.start() + start, m.start() + end
            if 7 <= n <= 15:
                spans.append(("phone", start, end))
            if 13 <= n <= 19:
                spans.append(("card", start, end))
    for m in _STRING.finditer(text):
        if _DIGIT.search(m.group()) and _LETTER.search(m.group()):
            spans.append(("secret", *m.span()))
    return spans


def _runs(body: str) -> Iterator[tuple[int, int, int]]:
    """(start, end, digits) of a run of digit groups; of one that is too long for a number, of its parts."""
    total = len(digits_of(body))
    if total <= 19:
        yield 0, len(body), total
    if total <= 15:
        return
    groups = [g.span() for g in _GROUP.finditer(body)]
    for i, (start, _) in enumerate(groups):
        n = 0
        for a, end in groups[i : i + RUN_GROUPS]:
            n += end - a
            if n > 19:
                break
            if n >= 7 and (start, end) != (0, len(body)):
                yield start, end, n


def features(text: str, span: Span) -> list[float]:
    """Format and context of a span, without the marks that the base or the weak labels go by."""
    kind, start, end = span
    body, before = text[start:end], text[max(0, start - CONTEXT) : start]
    groups = _GROUP.findall(body)
    digits = "".join(groups)
    lengths = [len(g) for g in groups] or [0]
    secret = kind == "secret"
    letters = [c for c in body if c.isalpha()]
    return [
        ALL_KINDS.index(kind),
        len(body.lstrip("+")),
        len(digits),
        len(groups),
        max(lengths),
        min(lengths),
        max((min(int(g[:6]), 999) for g in groups), default=0),
        float(luhn(digits[:40])),
        body.count("."),
        body.count("-") + body.count(" ") + body.count("/") + body.count("_"),
        body.count(",") + body.count(":"),
        float(1900 <= int(groups[0][:4]) < 2100) if groups and len(groups[0]) >= 4 else 0.0,
        len(body.rsplit(".", 1)[-1]) if "." in body else 0,
        start > 0 and text[start - 1].isalnum(),
        end < len(text) and text[end].isalnum(),
        not secret and start > 0 and text[start - 1] in ".-/=\"'#$",
        not secret and end < len(text) - 1 and text[end] in ".-/=\"'" and text[end + 1].isalnum(),
        not secret and bool(_CUES[kind].search(before)),
        not secret and bool(_SECRET.search(before)),
        len(letters) / len(body),
        sum(c.isupper() for c in letters) / max(1, len(letters)),
        sum(c in "aeiouAEIOU" for c in letters) / max(1, len(letters)),
        sum(a.isdigit() != b.isdigit() for a, b in zip(body, body[1:])) / len(body),
        len(set(body)) / min(len(body), 36),
        max((len(w) for w in _LETTERS.findall(body)), default=0),
    ]


def weak_label(text: str, span: Span, sure: set[Span]) -> float | None:
    """1 or 0 where something beside the features tells; else None."""
    kind, start, end = span
    if span in sure or (kind == "secret" and _GIVEN.search(text, max(0, start - CONTEXT), start)):
        return 1.0
    inside = (start > 0 and text[start - 1].isalpha()) or (end < len(text) and text[end].isalpha())
    return 0.0 if inside and kind in ("card", "phone") else None


def examples() -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of ``EXAMPLES``, each in ``VARIANTS`` ways that are the same every time."""
    rng = random.Random(1)
    signs = {"d": "0123456789", "x": "0123456789abcdef", "A": string.ascii_uppercase + string.digits, "b": string.ascii_letters + string.digits}
    syllables = [a + b for a in "bcdfghklmnprst" for b in ("a", "e", "i", "o", "u", "an", "er", "is")]

    def made(m: re.Match) -> str:
        kind, n = m.group(1), int(m.group(2) or 0)
        if kind == "w":
            return "".join(rng.choices(syllables, k=5))[: n or rng.randrange(3, 9)]
        if kind == "y":
            return str(rng.randrange(1900, 2100))
        return "".join(rng.choices(signs[kind], k=n))

    x, y = [], []
    for kind, sides in EXAMPLES.items():
        for label, templates in zip((1.0, 0.0), sides, strict=True):
            for template in templates * VARIANTS:
                text = re.sub(r"\{([dxAbwy])([0-9]*)\}", made, template)
                start = text.index("<")
                end = text.index(">") - 1 if ">" in text else len(text) - 1
                text = text.replace("<", "", 1).replace(">", "", 1)
                x.append([*map(float, features(text, (kind, start, end)))])
                y.append(label)
    return np.array(x), np.array(y)


# --- boosted trees -------------------------------------------------------------------------

class Boosted:
    """Logistic gradient boosting with small trees over at most 32 cut points per feature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE):
        self.bias = float(np.log(y.mean() / (1 - y.mean())))
        self.cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, 33)))[:-1] for f in range(x.shape[1])]
        binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(self.cuts)], axis=1)
        score, self.trees = np.full(len(y), self.bias), []
        for _ in range(trees):
            p = 1 / (1 + np.exp(-score))
            tree = self._grow(binned, y - p, p * (1 - p), np.arange(len(y)), depth, rate)
            self.trees.append(tree)
            score += self._apply(tree, x)

    def _grow(self, binned, gradient, hessian, rows, depth, rate):
        g, h = gradient[rows], hessian[rows]
        leaf = float(rate * g.sum() / (h.sum() + 1.0))
        if depth == 0 or len(rows) < 10:
            return leaf
        best = (1e-6, None, None)
        for f, cuts in enumerate(self.cuts):
            if not len(cuts):
                continue
            sums_g = np.cumsum(np.bincount(binned[rows, f], g, len(cuts) + 1))[:-1]
            sums_h = np.cumsum(np.bincount(binned[rows, f], h, len(cuts) + 1))[:-1]
            gain = sums_g**2 / (sums_h + 1) + (g.sum() - sums_g) ** 2 / (h.sum() - sums_h + 1) - g.sum() ** 2 / (h.sum() + 1)
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (float(gain[k]), f, k)
        _, f, k = best
        if f is None:
            return leaf
        left = binned[rows, f] <= k
        return (
            f,
            float(self.cuts[f][k]),
            self._grow(binned, gradient, hessian, rows[left], depth - 1, rate),
            self._grow(binned, gradient, hessian, rows[~left], depth - 1, rate),
        )

    def _apply(self, tree, x: np.ndarray) -> np.ndarray:
        if isinstance(tree, float):
            return np.full(len(x), tree)
        f, cut, low, high = tree
        return np.where(x[:, f] <= cut, self._apply(low, x), self._apply(high, x))

    def probability(self, x: np.ndarray) -> np.ndarray:
        score = np.full(len(x), self.bias)
        for tree in self.trees:
            score += self._apply(tree, x)
        return 1 / (1 + np.exp(-score))


def thresholds(scores: np.ndarray, y: np.ndarray, kinds: np.ndarray, precision: float = PRECISION) -> dict[str, float]:
    """Per kind the least score, ``LEAST_SCORE`` or more, from which on the precision holds."""
    found = {}
    for number, kind in enumerate(ALL_KINDS):
        mine = kinds == number
        order = np.argsort(-scores[mine], kind="stable")
        s, right = scores[mine][order], y[mine][order]
        if len(s):
            last = np.append(s[1:] != s[:-1], True)  # a threshold takes all of equal scores
            good = np.nonzero(last & (np.cumsum(right) / np.arange(1, len(s) + 1) >= precision))[0]
            if len(good):
                found[kind] = max(LEAST_SCORE, float(s[good[-1]]))
    return found


def labelled_spans(documents: DataFrame) -> DataFrame:
    """``(x, y, key)`` of every span with a weak label in every distinct text: features, label and a hash of its place."""

    def labelled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text, key in zip(batch["text"], batch["key"], strict=True):
                if _WORTH.search(text):
                    sure = set(base(text))
                    for span in {*proposals(text), *sure}:
                        told = weak_label(text, span, sure)
                        if told is not None:
                            rows.append(([*map(float, features(text, span))], told, key, span[1], span[2]))
            yield pd.DataFrame(rows, columns=["x", "y", "key", "start", "end"])

    keyed = documents.select("text").filter("text is not null").withColumn("key", F.xxhash64(F.lit(11), "text"))
    spans = keyed.mapInPandas(labelled, "x array<double>, y double, key long, start long, end long")
    spans = spans.withColumn("kind", F.col("x")[0]).dropDuplicates(["key", "kind", "start", "end"])  # copies of a text count once
    place = F.pmod(F.xxhash64(F.lit(12), "key", "start", "end"), F.lit(PLACES))
    return spans.select("x", F.col("y").cast("int").alias("y"), place.alias("key"))


def cut_points(spans: DataFrame, width: int) -> list[np.ndarray]:
    """Up to 32 cut points of each feature, at equal shares of all spans that fit the trees."""
    shares = ",".join(str(i / 32) for i in range(33))
    fit = spans.filter("key % 3 <> 0")
    found = fit.agg(*[F.expr(f"percentile(x[{f}], array({shares}))").alias(f"c{f}") for f in range(width)]).first()
    return [np.unique(np.array(found[f"c{f}"]))[:-1] for f in range(width)]


SCALE = float(1 << 24)  # gradients are added up as whole numbers, so that their sums do not depend on the order
LEVELS = 1 << 16  # of scores, for the thresholds
BINS = 33


def _binned(spans: DataFrame, cuts: list[np.ndarray]) -> DataFrame:
    def bins(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                x = np.stack(batch["x"])
                b = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1).astype(np.uint8)
                yield pd.DataFrame({"bins": [r.tobytes() for r in b], "kind": x[:, 0].astype(int), "y": batch["y"], "rest": batch["key"] % 3 == 0})

    return spans.mapInPandas(bins, "bins binary, kind int, y int, rest boolean")


def _scores(bins: np.ndarray, bias: float, trees: list) -> np.ndarray:
    score = np.full(len(bins), bias)
    for tree in trees:
        leaves = np.array([node if isinstance(node, float) else 0.0 for node in tree])
        score += leaves[_reached(bins, tree)]
    return score


def _reached(bins: np.ndarray, tree: list) -> np.ndarray:
    """The number of the node that each row comes to; a node is a leaf's value, (feature, bin, left, right), or None while it grows."""
    steps = [node if isinstance(node, tuple) else (0, 0, number, number) for number, node in enumerate(tree)]
    feature, last, low, high = map(np.array, zip(*steps, strict=True))
    at, rows = np.zeros(len(bins), int), np.arange(len(bins))
    for _ in range(DEPTH):
        at = np.where(bins[rows, feature[at]] <= last[at], low[at], high[at])
    return at


def _sums(binned: DataFrame, bias: float, trees: list, tree: list, width: int) -> dict[int, np.ndarray]:
    """Per growing node of ``tree`` the sums of gradients, Hessians and spans, by feature and bin, over all spans that fit the trees."""
    size = width * BINS

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((3, len(tree) * size))
        for batch in batches:
            if len(batch):
                bins = np.frombuffer(b"".join(batch["bins"]), np.uint8).reshape(len(batch), width)
                p = 1 / (1 + np.exp(-_scores(bins, bias, trees)))
                g, h = np.rint((batch["y"].to_numpy() - p) * SCALE), np.rint(p * (1 - p) * SCALE)
                slots = (_reached(bins, tree) * size)[:, None] + np.arange(width) * BINS + bins
                for into, value in zip(total, (g, h, np.ones(len(batch))), strict=True):
                    into += np.bincount(slots.ravel(), np.repeat(value, width), len(into))
        slot = np.nonzero(total[2])[0]
        yield pd.DataFrame({"slot": slot, **{n: t[slot].astype(np.int64) for n, t in zip("ghn", total, strict=True)}})

    parts = binned.filter("not rest").mapInPandas(summed, "slot long, g long, h long, n long")
    rows = parts.groupBy("slot").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n")).collect()
    sums = np.zeros((len(tree), width, BINS, 3))
    for row in rows:
        sums[row.slot // size, row.slot % size // BINS, row.slot % BINS] = (row.g / SCALE, row.h / SCALE, row.n)
    return {number: sums[number] for number, node in enumerate(tree) if node is None}


def _split(sums: np.ndarray, cuts: list[np.ndarray]) -> tuple[int, int] | None:
    """The (feature, bin) whose two sides gain most."""
    g, h, _ = sums[0].sum(axis=0)
    best = (1e-6, None)
    for f, cut in enumerate(cuts):
        if not len(cut):
            continue
        left = np.cumsum(sums[f], axis=0)[: len(cut)]
        gain = left[:, 0] ** 2 / (left[:, 1] + 1) + (g - left[:, 0]) ** 2 / (h - left[:, 1] + 1) - g**2 / (h + 1)
        k = int(np.argmax(gain))
        if gain[k] > best[0]:
            best = (float(gain[k]), (f, k))
    return best[1]


def boost(binned: DataFrame, cuts: list[np.ndarray]) -> tuple[float, list]:
    """(bias, trees over bins): each level of a tree is one pass over all spans, of which only sums by bin come back."""
    width = len(cuts)
    sure, count = binned.filter("not rest").agg(F.sum("y"), F.count(F.lit(1))).first()
    bias, trees = float(np.log(sure / (count - sure))), []
    for _ in range(TREES):
        tree: list = [None]
        for depth in range(DEPTH):
            for number, sums in _sums(binned, bias, trees, tree, width).items():
                g, h, n = sums[0].sum(axis=0)
                found = _split(sums, cuts) if n >= 10 else None
                if found is None:
                    tree[number] = float(RATE * g / (h + 1))
                    continue
                f, k = found
                tree[number] = (f, k, len(tree), len(tree) + 1)
                left = sums[f, : k + 1].sum(axis=0)
                for side in (left, sums[f].sum(axis=0) - left):
                    # the sums of a split are those of its sides, so the last level needs no pass of its own
                    tree.append(None if depth + 1 < DEPTH else float(RATE * side[0] / (side[1] + 1)))
        trees.append(tree)
    return bias, trees


def calibrated(binned: DataFrame, bias: float, trees: list, cuts: list[np.ndarray]) -> dict[str, float]:
    """``thresholds`` over all spans that did not fit the trees, from counts by kind and ``LEVELS`` levels of scores."""
    width = len(cuts)

    def told(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                bins = np.frombuffer(b"".join(batch["bins"]), np.uint8).reshape(len(batch), width)
                p = 1 / (1 + np.exp(-_scores(bins, bias, trees)))
                yield pd.DataFrame({"kind": batch["kind"], "level": np.floor(p * LEVELS).astype(int), "y": batch["y"]})

    rest = binned.filter("rest").mapInPandas(told, "kind int, level long, y int")
    counts = rest.groupBy("kind", "level").agg(F.sum("y").alias("right"), F.count(F.lit(1)).alias("n")).toPandas()
    found = {}
    for number, kind in enumerate(ALL_KINDS):
        mine = counts[counts["kind"] == number].sort_values("level", ascending=False)
        good = np.nonzero((mine["right"].cumsum() / mine["n"].cumsum() >= PRECISION).to_numpy())[0]
        if len(good):
            found[kind] = max(LEAST_SCORE, float(mine["level"].to_numpy()[good[-1]]) / LEVELS)
    return found


def train(documents: DataFrame, sample_docs: int | None = None, sample_spans: int | None = None):
    """(trees, thresholds) from the examples and every labelled span of every distinct text.

    A caller who asks for it gets a model of about ``sample_docs`` texts and ``sample_spans`` of their spans.
    """
    made, label = examples()
    if sample_docs or sample_spans:
        return _train_on_sample(documents, made, label, sample_docs, sample_spans)
    rows = [(list(map(float, x)), int(y), i) for i, (x, y) in enumerate(zip(made, label, strict=True))]
    given = documents.sparkSession.createDataFrame(rows, "x array<double>, y int, key long")
    spans = stage(labelled_spans(documents).unionByName(given), "labelled-spans")
    cuts = cut_points(spans, made.shape[1])
    binned = stage(_binned(spans, cuts), "binned-spans")
    bias, trees = boost(binned, cuts)
    return (bias, [_with_cuts(tree, 0, cuts) for tree in trees]), calibrated(binned, bias, trees, cuts)


def _train_on_sample(documents: DataFrame, made: np.ndarray, label: np.ndarray, sample_docs: int | None, sample_spans: int | None):
    scale, key = PLACES, F.xxhash64(F.lit(11), "text")
    if sample_docs:
        total = documents.filter("text is not null").select(key.alias("key")).distinct().count()
        documents = documents.filter(F.pmod(key, F.lit(scale)) < int(scale * min(1.0, sample_docs / max(total, 1))))
    spans = stage(labelled_spans(documents), "labelled-spans")
    share = int(scale * min(1.0, (sample_spans or scale) / max(spans.count(), 1)))
    rows = sorted(spans.filter(F.col("key") < share).toPandas().itertuples(index=False), key=lambda r: (list(r.x), r.y, r.key))
    x = np.vstack([made, *[np.array(r.x)[None] for r in rows]])
    y = np.concatenate([label, [float(r.y) for r in rows]])
    fold = np.concatenate([np.arange(len(label)), np.array([r.key for r in rows], int)]) % 3
    trees = Boosted(x[fold > 0], y[fold > 0])
    rest = fold == 0
    return (trees.bias, trees.trees), thresholds(trees.probability(x[rest]), y[rest], x[rest, 0])


def _with_cuts(tree: list, number: int, cuts: list[np.ndarray]):
    """A tree over bins as ``Boosted`` holds it, with the features' own values."""
    node = tree[number]
    if isinstance(node, float):
        return node
    f, k, left, right = node
    return f, float(cuts[f][k]), _with_cuts(tree, left, cuts), _with_cuts(tree, right, cuts)


class Finder:
    def __init__(self, model):
        self.cuts = {}
        if model is not None:
            (bias, trees), self.cuts = model
            self.trees = Boosted.__new__(Boosted)
            self.trees.bias, self.trees.trees = bias, trees

    def find(self, text: str | None) -> tuple[list[Span], list[Span]]:
        """Base spans, and all spans; by kind, then start."""
        if not text or not _WORTH.search(text):
            return [], []
        sure = base(text)
        taken = sorted((s, e) for _, s, e in sure)
        if self.cuts:
            starts = np.array([s for s, _ in taken], int)
            reach = np.maximum.accumulate([e for _, e in taken]) if taken else np.zeros(0, int)
            fresh = []
            for span in proposals(text):
                i = int(np.searchsorted(starts, span[2]))  # base spans that start before the end
                if span[0] in self.cuts and (i == 0 or reach[i - 1] <= span[1]):
                    fresh.append(span)
            if fresh:
                chance = self.trees.probability(np.array([features(text, s) for s in fresh], float))
                picked = sorted((-p, s[1], s[2], s[0]) for p, s in zip(chance, fresh, strict=True) if p >= self.cuts[s[0]])
                used = np.zeros(len(text) + 1, bool)
                more = []
                for _, start, end, kind in picked:
                    if not used[start:end].any():
                        used[start:end] = True
                        more.append((kind, start, end))
                return sure, sorted(sure + more, key=lambda s: (ALL_KINDS.index(s[0]), s[1]))
        return sure, sure


def find(documents: DataFrame, model) -> DataFrame:
    """``documents`` with ``base_spans`` and ``all_spans``: arrays of (kind, start, end) in code points, end exclusive."""
    held = documents.sparkSession.sparkContext.broadcast(model)
    one = "array<struct<kind:string,start:int,end:int>>"

    @F.pandas_udf(f"base_spans {one}, all_spans {one}")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        finder = Finder(held.value)
        as_rows = lambda spans: [dict(zip(("kind", "start", "end"), s, strict=True)) for s in spans]
        for batch in batches:
            rows = [tuple(map(as_rows, finder.find(t))) for t in batch]
            yield pd.DataFrame(rows, columns=["base_spans", "all_spans"])

    kept = [c for c in documents.columns if c not in ("base_spans", "all_spans")]
    row = F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row")  # out of the way of the names used here
    return documents.select(row, found("text").alias("found")).select("row.*", "found.*")


def redact(found: DataFrame, spans: str = "all_spans") -> DataFrame:
    """Replace the column ``text`` of a result of ``find`` by the text with [KIND] for each span, overlaps merged."""

    @F.pandas_udf("string")
    def redacted(texts: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for text, row in zip(texts, spans, strict=True):
            parts, at = [], 0
            for s in sorted(row if text is not None else (), key=lambda s: (s["start"], -s["end"])):
                if s["start"] >= at:
                    parts += [text[at : s["start"]], f"[{s['kind'].upper()}]"]
                at = max(at, s["end"])
            out.append(None if text is None else "".join(parts) + text[at:])
        return pd.Series(out, dtype=object)

    return found.withColumn("text", redacted("text", F.col(spans)))
