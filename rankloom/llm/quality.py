"""Quality rules: gradient-boosted trees over document statistics.

The statistics are computed with numpy on the UTF-8 buffers of Arrow batches. The trees are grown here from labelled rows
by histograms, with monotonic constraints on chosen statistics, and flattened into numpy node arrays for scoring.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import cut, give_back, mix, segment_sum, slices, unused, utf8, words

#: Statistic -> sign of its monotonic constraint on the score (0: none).
FEATURES = {
    "log_words": 0, "mean_word": 0, "symbol_share": -1, "digit_share": 0, "upper_share": -1, "space_share": 0, "pipe_share": -1,
    "bang_share": -1, "repeat_next_share": -1, "distinct_share": 0, "repeat_line_share": -1, "mean_line": 0, "punct_share": 0, "lines_per_word": 0,
}
#: Labels, and labelled texts, that fitting uses, at most: those of least hash.
SAMPLE_ROWS = 20_000
THRESHOLD = 0.5

_SYMBOL, _PUNCT = (np.isin(np.arange(256), list(s)) for s in (b"#$%&*@^~<>{}[]\\=+_", b".,;:"))
_DIGIT, _UPPER, _SPACE = (np.isin(np.arange(256), list(s)) for s in (b"0123456789", bytes(range(65, 91)), b" \t\r\n"))


def statistics(texts: pa.Array) -> np.ndarray:
    """A row of len(FEATURES) numbers for each text, all finite; null and empty texts give zeros."""
    parts = [_statistics(texts.slice(lo, hi - lo)) for lo, hi in slices(texts)]
    return np.concatenate(parts) if parts else np.zeros((0, len(FEATURES)))


def _statistics(texts: pa.Array) -> np.ndarray:
    data, offs = utf8(texts)
    n = len(texts)
    size = np.maximum(np.diff(offs), 1)
    share = lambda mask: segment_sum(mask, offs) / size
    doc, start, end, hashed = words(*utf8(pc.utf8_lower(pc.fill_null(texts, ""))))
    number = np.bincount(doc, minlength=n).astype(float)
    some = np.maximum(number, 1)
    chars = np.bincount(doc, weights=end - start, minlength=n)
    same = np.zeros(len(doc), bool)
    same[1:] = (hashed[1:] == hashed[:-1]) & (doc[1:] == doc[:-1])
    pairs = _distinct(doc, hashed)
    # lines: hash of each line's words; lines without words don't count
    breaks = np.flatnonzero(data == 10)
    edges = np.union1d(breaks, offs[:-1])
    w_doc, w_start, _, w_hash = words(data, offs)
    line = np.searchsorted(edges, w_start, side="right")
    line_ids, first = np.unique(line, return_index=True)
    line_doc = w_doc[first]
    line_hash = np.add.reduceat(mix(w_hash + np.uint64(0x51ED27)) * np.uint64(3) + w_hash * w_hash, first) if len(first) else np.zeros(0, np.uint64)
    lines = np.bincount(line_doc, minlength=n).astype(float)
    kinds = np.bincount(_distinct(line_doc, line_hash), minlength=n)
    upper, bang = share(_UPPER[data]), share(data == 33)
    return np.stack(
        [np.log1p(number), chars / some, share(_SYMBOL[data]), share(_DIGIT[data]), upper, share(_SPACE[data]), share(data == 124),
         bang, np.bincount(doc, weights=same, minlength=n) / some, np.bincount(pairs, minlength=n) / some,
         1 - kinds / np.maximum(lines, 1) * (lines > 0) - (lines == 0), number / np.maximum(lines, 1), share(_PUNCT[data]), lines / some], 1,
    )


def _distinct(group: np.ndarray, hashed: np.ndarray) -> np.ndarray:
    """The group of each distinct (group, hash)."""
    if not len(group):
        return np.zeros(0, np.int64)
    key = mix(hashed ^ mix(group.astype(np.uint64) + np.uint64(1)))
    _, at = np.unique(key, return_index=True)
    return group[at]


@dataclass
class Trees:
    """Flattened trees: node arrays of shape (trees, nodes). A leaf has feature -1 and points to itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    base: float
    depth: int

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of each row of x, all rows of one tree level at a time."""
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, t, le, ri, v in zip(self.feature, self.threshold, self.left, self.right, self.value):
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                k = f[at]
                at = np.where(k < 0, at, np.where(x[rows, np.maximum(k, 0)] <= t[at], le[at], ri[at]))
            out += v[at]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -40, 40)))


def boost(x: np.ndarray, y: np.ndarray, signs: list[int], rounds: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 64, least: int = 5, ridge: float = 1.0) -> Trees:
    """Histogram gradient boosting of the logistic loss. signs[j]=+1 (-1): the score never falls (rises) with x[:, j].

    A split on a constrained feature must order its children's values, and their midpoint bounds every later value of
    either side, which makes each tree, and so the sum, monotonic. Without rows, or with one class only, the result is constant.
    """
    n, d = x.shape if x.ndim == 2 else (0, len(signs))
    p = (y.sum() + 1) / (n + 2)
    base = float(np.log(p / (1 - p)))
    empty = np.zeros((0, 1))
    if n == 0 or y.min() == y.max():
        return Trees(empty.astype(int), empty, empty.astype(int), empty.astype(int), empty, base, depth)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(d)]
    code = np.stack([np.searchsorted(cuts[j], x[:, j], side="left") for j in range(d)], 1)
    width = max(len(c) for c in cuts) + 1
    flat = code + np.arange(d) * width
    size = 2 ** (depth + 1) - 1
    feats, thrs, vals = [], [], []
    lefts = np.minimum(2 * np.arange(size) + 1, size - 1)
    score = np.full(n, base)
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-score))
        g, h = y - q, np.maximum(q * (1 - q), 1e-9)
        feature, threshold, value = np.full(size, -1), np.zeros(size), np.zeros(size)
        low, high = np.full(size, -np.inf), np.full(size, np.inf)
        node = np.zeros(n, dtype=np.int64)
        value[0] = np.clip(g.sum() / (h.sum() + ridge), -np.inf, np.inf)
        for at in range(2**depth - 1):
            rows = np.flatnonzero(node == at) if (at == 0 or feature[(at - 1) // 2] >= 0) else np.zeros(0, int)
            if len(rows) < 2 * least:
                continue
            cells = flat[rows].ravel()
            hist = [np.bincount(cells, weights=np.repeat(w, d), minlength=d * width).reshape(d, width) for w in (g[rows], h[rows], np.ones(len(rows)))]
            gl, hl, nl = (np.cumsum(a, 1)[:, :-1] for a in hist)
            gt, ht, nt = g[rows].sum(), h[rows].sum(), len(rows)
            vl, vr = (np.clip(a / (b + ridge), low[at], high[at]) for a, b in ((gl, hl), (gt - gl, ht - hl)))
            gain = lambda a, b, v: 2 * a * v - (b + ridge) * v * v
            better = gain(gl, hl, vl) + gain(gt - gl, ht - hl, vr) - gain(gt, ht, np.clip(gt / (ht + ridge), low[at], high[at]))
            s = np.array(signs)[:, None]
            better[(nl < least) | (nt - nl < least) | (s * (vr - vl) < 0)] = -np.inf
            for j in range(d):
                better[j, len(cuts[j]) :] = -np.inf
            j, b = np.unravel_index(int(np.argmax(better)), better.shape)
            if not better[j, b] > 1e-9:
                continue
            feature[at], threshold[at] = j, cuts[j][b]
            le, ri = 2 * at + 1, 2 * at + 2
            value[le], value[ri] = vl[j, b], vr[j, b]
            low[[le, ri]], high[[le, ri]] = low[at], high[at]
            if signs[j]:
                mid = (vl[j, b] + vr[j, b]) / 2
                if signs[j] > 0:
                    high[le], low[ri] = mid, mid
                else:
                    low[le], high[ri] = mid, mid
            node[rows] = np.where(code[rows, j] <= b, le, ri)
        score += rate * value[node]
        feats.append(feature), thrs.append(threshold), vals.append(rate * value)
    k = len(feats)
    return Trees(np.array(feats), np.array(thrs), np.tile(lefts, (k, 1)), np.tile(np.minimum(lefts + 1, size - 1), (k, 1)), np.array(vals), base, depth)


def _features(text: Column) -> Column:
    @F.arrow_udf("array<double>")
    def run(texts: pa.Array) -> pa.Array:
        x = statistics(texts)
        give_back()
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))

    return run.asNondeterministic()(text)


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Trees:
    """Trees from at most `sample_rows` labelled texts (labels: doc_id of any type, quality 0/1), those of least hash.

    Labels that are null or not 0/1 don't count; ids without a document are passed over. A document labelled both ways counts
    for each; an id that several texts share gives each of them its label; rows repeated in either table count once. No
    usable row: a constant model of probability 1/2, which keeps everything.
    """
    marks = labels.select(F.col("doc_id").alias("i"), F.col("quality").cast("int").alias("q")).where("i is not null and q in (0, 1)").distinct()
    chosen = F.broadcast(marks.orderBy(F.xxhash64("i"), "i", "q").limit(sample_rows))  # the bound on labels
    texts = docs.select(F.col("doc_id").alias("i"), F.col("text").alias("t")).where("t is not null").withColumn("h", F.xxhash64("t"))
    pairs = texts.join(chosen, "i").select("i", "q", "h").distinct()
    drawn = F.broadcast(cut(pairs.orderBy(F.xxhash64("i", "h"), "i", "h", "q").limit(sample_rows)))  # the bound on texts: an id may have any number
    found = texts.join(drawn, ["i", "h"]).select("i", "q", "h", _features(F.col("t")).alias("x"))
    rows = found.groupBy("i", "q", "h").agg(F.min("x").alias("x")).select("q", "h", "x").collect()
    rows.sort(key=lambda r: (r[1], r[0]))
    x = np.array([r[2] for r in rows]).reshape(len(rows), len(FEATURES))
    return boost(x, np.array([r[0] for r in rows], dtype=float), list(FEATURES.values()))


def score(text: Column, model: Trees) -> Column:
    """Probability of good quality. Null and empty texts score 0."""

    @F.arrow_udf("double")
    def run(texts: pa.Array) -> pa.Array:
        p = model.probability(statistics(texts))
        give_back()
        p[np.asarray(pc.fill_null(pc.binary_length(texts), 0)) == 0] = 0.0
        return pa.array(p)

    return run.asNondeterministic()(text)


def judge(docs: DataFrame, model: Trees, threshold: float = THRESHOLD) -> DataFrame:
    """A row for each input row: doc_id, score (6 places), keep (score >= threshold).

    Null and empty texts score 0 and aren't kept; repeated rows are judged one by one and alike; an empty table gives an
    empty result; further columns don't matter.
    """
    s = docs.select("doc_id", score(F.col("text"), model).alias("s"))
    return s.select("doc_id", F.round("s", 6).alias("score"), (F.col("s") >= threshold).alias("keep"))


def keep_good(docs: DataFrame, model: Trees, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of at least the threshold, with all their columns unchanged. Null and empty texts go."""
    name = unused(docs, "quality_score")
    return docs.withColumn(name, score(F.col("text"), model)).where(F.col(name) >= threshold).select(*docs.columns)
