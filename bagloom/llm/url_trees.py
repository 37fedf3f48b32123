"""URL filter: longest matching rule first, gradient-boosted trees for the rest.

Rules are (host, path) prefixes with a verdict. A rule fits its host and every subdomain
if the URL's path starts with the rule's path; of the fitting rules the longest text
decides. The trees judge what no rule decides. They are fitted on URLs with labels (by
default those that rules decide), from lexical features: lengths, depth, digit ratio,
entropy, parameter counts and the suffix statistics of the training URLs.

The fit uses a bounded sample: at most `sample` labelled URLs, the ones with the smallest
hashes; everything else covers all rows. Boosting is second order on histogrammed
features, in numpy, on the driver.

Defined results: a null URL, or one without `://`, has an empty host and path; the trees
judge it by its text. Repeated rows are judged each; an empty table gives no rows; with no
labelled URL of one kind the trees give the other kind's verdict (allow if there is none).
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bagloom.llm.common import lean

#: (host, path, verdict), as the contract of op8 states them
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
SAMPLE = 20_000
FEATURES = ("length", "host_length", "path_length", "depth", "labels", "digit_ratio", "entropy", "host_entropy", "parameters", "dashes", "https", "fragment", "suffix_block_rate", "suffix_share")


def split_url(url: str | None) -> tuple[str, str]:
    """(host in lower case A-Z, path) of a URL."""
    at = url.find("://") if url is not None else -1
    if at < 0:
        return "", ""
    rest = url[at + 3 :]
    ends = [i for i in map(rest.find, "/?#") if i >= 0]
    end = min(ends, default=len(rest))
    host = rest[:end].translate(LOWER_TABLE)
    path = rest[end:]
    return host, path[: min((i for i in (path.find("?"), path.find("#")) if i >= 0), default=len(path))]


LOWER_TABLE = {i: i + 32 for i in range(65, 91)}


class Rules:
    """Look-up by host suffix, so the cost of a URL doesn't depend on the number of rules."""

    def __init__(self, rules: tuple[tuple[str, str, str], ...]):
        self.by_host: dict[str, list[tuple[str, str]]] = {}
        for host, path, verdict in rules:
            self.by_host.setdefault(host, []).append((path, verdict))

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        """(rule as text, verdict) of the longest rule that fits; of equal lengths the longer host."""
        best = None
        at = 0
        while True:
            suffix = host[at:]
            for p, verdict in self.by_host.get(suffix, ()):
                if path.startswith(p):
                    text = suffix + p
                    if best is None or len(text) > len(best[0]):
                        best = (text, verdict)
            dot = host.find(".", at)
            if dot < 0:
                return best
            at = dot + 1


def entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values()) if n else 0.0


def suffixes(host: str) -> str:
    """The last label, as the key of suffix statistics."""
    return host.rpartition(".")[2]


class Lexical:
    """Features of URLs; the suffix statistics come from the training URLs."""

    def __init__(self, urls: list[str | None], blocked: np.ndarray):
        seen, bad = Counter(), Counter()
        for url, b in zip(urls, blocked.tolist(), strict=True):
            s = suffixes(split_url(url)[0])
            seen[s] += 1
            bad[s] += int(b)
        n, base = max(1, len(urls)), (float(blocked.mean()) if len(blocked) else 0.0)
        self.stats = {s: ((bad[s] + 5 * base) / (c + 5), c / n) for s, c in seen.items()}
        self.other = (base, 0.0)

    def rows(self, urls: list[str | None]) -> np.ndarray:
        out = np.zeros((len(urls), len(FEATURES)))
        for i, url in enumerate(urls):
            host, path = split_url(url)
            s = url or ""
            rate, share = self.stats.get(suffixes(host), self.other)
            query = s.partition("#")[0].partition("?")[2]
            out[i] = (len(s), len(host), len(path), path.count("/"), host.count(".") + 1, sum(c in "0123456789" for c in s) / max(1, len(s)), entropy(s), entropy(host), query.count("&") + 1 if query else 0, s.count("-"), s.startswith("https"), "#" in s, rate, share)
        return out


class Trees:
    """Boosted regression trees for the logistic loss on binned features."""

    def __init__(self, rounds: int = 40, depth: int = 4, rate: float = 0.2, bins: int = 32, smooth: float = 1.0, least: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.smooth, self.least = rounds, depth, rate, bins, smooth, least
        self.trees: list[list[tuple]] = []
        self.edges: list[np.ndarray] = []
        self.start = 0.0

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)], axis=1) if len(self.edges) else x.astype(int)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        n, m = x.shape
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(m)]
        b, p = self.binned(x), float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
        self.start = math.log(p / (1 - p))
        score = np.full(n, self.start)
        for _ in range(self.rounds):
            q = 1 / (1 + np.exp(-score))
            g, h = q - y, q * (1 - q)
            tree: list[tuple] = []
            self.grow(tree, b, g, h, np.arange(n), 0)
            self.trees.append(tree)
            score += self.value(tree, b)
        return self

    def grow(self, tree: list, b: np.ndarray, g: np.ndarray, h: np.ndarray, rows: np.ndarray, depth: int) -> int:
        at = len(tree)
        tree.append(())
        gs, hs = g[rows].sum(), h[rows].sum()
        best = (1e-6, -1, 0)
        if depth < self.depth and len(rows) > 1:
            for j in range(b.shape[1]):
                k = len(self.edges[j]) + 1
                gl = np.cumsum(np.bincount(b[rows, j], g[rows], k))[:-1]
                hl = np.cumsum(np.bincount(b[rows, j], h[rows], k))[:-1]
                gain = gl**2 / (hl + self.smooth) + (gs - gl) ** 2 / (hs - hl + self.smooth) - gs**2 / (hs + self.smooth)
                gain[(hl < self.least) | (hs - hl < self.least)] = 0
                if len(gain) and gain.max() > best[0]:
                    best = (float(gain.max()), j, int(gain.argmax()))
        if best[1] < 0:
            tree[at] = (-1, 0, -self.rate * gs / (hs + self.smooth), 0)
            return at
        left = b[rows, best[1]] <= best[2]
        one = self.grow(tree, b, g, h, rows[left], depth + 1)
        two = self.grow(tree, b, g, h, rows[~left], depth + 1)
        tree[at] = (best[1], best[2], one, two)
        return at

    def value(self, tree: list[tuple], b: np.ndarray) -> np.ndarray:
        out, todo = np.zeros(len(b)), [(0, np.arange(len(b)))]
        while todo:
            at, rows = todo.pop()
            j, cut, one, two = tree[at]
            if j < 0:
                out[rows] = one
            elif len(rows):
                left = b[rows, j] <= cut
                todo += [(one, rows[left]), (two, rows[~left])]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        b = self.binned(x)
        score = np.full(len(x), self.start)
        for tree in self.trees:
            score += self.value(tree, b)
        return 1 / (1 + np.exp(-score))


def labelled_sample(urls: DataFrame, rules: tuple, sample: int) -> tuple[list[str], np.ndarray]:
    """At most `sample` URLs that rules decide, by smallest hash, and whether they are blocked."""
    table = Rules(rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [(u, f[1] == "block") for u in batch.column(0).to_pylist() if u is not None and (f := table.find(*split_url(u)))]
            yield pa.RecordBatch.from_arrays([pa.array([u for u, _ in got], pa.string()), pa.array([b for _, b in got], pa.bool_())], names=["url", "blocked"])

    decided = urls.select(F.col("url").cast("string").alias("url")).mapInArrow(lean(run), "url string, blocked boolean")
    n = decided.count()
    # an even draw a little above the bound first, so that no task sends a whole sample of its own
    share = min(1.0, 1.5 * (sample + 200) / max(1, n))
    drawn = decided.withColumn("h", F.xxhash64("url")).filter(F.pmod("h", F.lit(1 << 30)) < F.lit(share * (1 << 30)))
    rows = drawn.orderBy("h", "url").select("url", "blocked").limit(sample).collect()
    return [r[0] for r in rows], np.array([float(r[1]) for r in rows])


def judge(pages: DataFrame, rules: tuple = RULES, key: str = "page_id", sample: int = SAMPLE, threshold: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict, score: the score is the trees' probability of a block (null where a rule decides)."""
    urls, blocked = labelled_sample(pages, rules, sample)
    lexical = Lexical(urls, blocked)
    trees = Trees().fit(lexical.rows(urls), blocked) if len(set(blocked.tolist())) == 2 else None
    flat = float(blocked[0]) if trees is None and len(blocked) else 0.0
    table = Rules(rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column(1).to_pylist()
            parts = [split_url(u) for u in found]
            hits = [table.find(*p) for p in parts]
            open_ = [i for i, h in enumerate(hits) if h is None]
            score = np.full(len(found), np.nan)
            if open_:
                score[open_] = trees.probability(lexical.rows([found[i] for i in open_])) if trees else flat
            verdict = [h[1] if h else ("block" if s >= threshold else "allow") for h, s in zip(hits, score.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([p[0] for p in parts], pa.string()), pa.array([p[1] for p in parts], pa.string()), pa.array([h[0] if h else None for h in hits], pa.string()), pa.array(verdict, pa.string()), pa.array(score, pa.float64(), mask=np.isnan(score))], names=["page_id", "host", "path", "rule", "verdict", "score"])

    return pages.select(F.col(key).cast("long").alias("page_id"), F.col("url").cast("string").alias("url")).mapInArrow(lean(run), "page_id long, host string, path string, rule string, verdict string, score double")
