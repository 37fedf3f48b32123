"""Secret scans: three base patterns, and a character convolutional network over every other candidate.

Base findings (leftmost, non-overlapping, per kind) are assign, access and hex; a match
that is too short is dropped after it has consumed its text. Candidates are the maximal
runs of token characters of LEAST or more, and the values of the base findings. The network
sees windows of 48 characters of a candidate and 24 characters on either side, as character
classes: an embedding, one convolution of width 5, maximum and mean over places, one hidden
layer. Windows overlap by half and cover the whole candidate, whose score is their greatest.

It is trained in numpy on every labelled window of all documents, copies counted: values of
base findings are positive, candidates are negative, so it learns from all that it judges.
Each pass gives each negative a bare one: a value drawn anew (hexadecimal, base 62 or base 64,
20 characters or more) in its surroundings, so that neither a key word before it nor the base
patterns' alphabet decides. A third of the distinct windows, by hash, is held back with its
bare ones: they set the threshold, the highest step of 1 / STEPS of the logit that keeps
`recall` of the held-back positives, and nothing else; a logistic fit on them turns scores into
probabilities. `Network.report` has recall, recall of bare ones, precision and the numbers of windows.

The windows are dealt over shards of about `rows` (at most MOST shards, which then grow), copies
of one window over all of them. In each round every shard starts from the same parameters and
passes over all its windows; the mean of the shards' parameters, weighted by their windows,
starts the next round. Scores of held-back windows are counted by step in each shard, so only
parameters and counts reach the driver. The same documents give the same shards in any partitioning.

What the network adds has kind `model` and never touches a base span; base findings are
scored too (`base_probability`: the least of a text's) and stay whatever their score.

Defined results: null texts count as empty and have no spans. Offsets are code points.
Repeated rows are scanned each; extra columns are ignored; without both labels among the
windows to learn from, or without held-back ones, the network adds nothing.
"""

from __future__ import annotations

import copy
import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bagloom.llm.common import Tables, lean, lean_group, pack, slices, unpack, utf8

ASSIGN = re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "model")
#: least length of a candidate run
LEAST = 16
RUN = re.compile(r"[A-Za-z0-9+/_.=-]{%d,}" % LEAST)
BEFORE, INSIDE, AFTER = 24, 48, 24
WIDE = BEFORE + INSIDE + AFTER
STEP = INSIDE // 2
RECALL = 0.98
#: rounds of training, Adam steps of a shard in all of them at least, windows of a step
ROUNDS, LEAST_STEPS, BATCH = 8, 700, 64
#: windows of a shard, and the most shards
ROWS, MOST = 8192, 512
#: steps of the logit by which held-back scores are counted
STEPS = 256
TOKEN = np.zeros(256, bool)
TOKEN[[*range(48, 58), *range(65, 91), *range(97, 123), *b"+/_.=-"]] = True
HEXADECIMAL = np.zeros(256, bool)
HEXADECIMAL[[*range(48, 58), *range(97, 103)]] = True


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base findings, in order."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if len(m[0]) >= 24]
    return sorted(out)


def values(text: str) -> list[tuple[int, int]]:
    """(start, end) of the secret strings themselves in the base findings: what a candidate run would be."""
    out = [m.span(2) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [m.span() for p, least in ((ACCESS, 20), (HEX, 24)) for m in p.finditer(text) if len(m[0]) >= least]
    return sorted(set(out))


def runs_of(mask: np.ndarray, offsets: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of runs of at least `least` set bytes that don't cross texts."""
    n = len(mask)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    head, tail = mask.copy(), mask.copy()
    head[1:] &= ~mask[:-1] | first[1:n]
    tail[:-1] &= ~mask[1:] | first[1:n]
    starts, ends = np.flatnonzero(head), np.flatnonzero(tail) + 1
    long = ends - starts >= least
    return starts[long], ends[long]


def suspects(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each text whether it has a candidate run, and whether it has a hexadecimal run."""
    n = len(offsets) - 1
    run = np.zeros(n, bool)
    run[np.searchsorted(offsets, runs_of(TOKEN[data], offsets, LEAST)[0], "right") - 1] = True
    hexa = np.zeros(n, bool)
    hexa[np.searchsorted(offsets, runs_of(HEXADECIMAL[data], offsets, 24)[0], "right") - 1] = True
    return run, hexa


def classes(text: str) -> np.ndarray:
    """A small integer for each character: letters and digits by themselves, others by group; 0 is no character."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return TABLE[np.minimum(points, 255)]


TABLE = np.full(256, 1, np.int64)
TABLE[97:123] = np.arange(2, 28)
TABLE[65:91] = np.arange(28, 54)
TABLE[48:58] = np.arange(54, 64)
TABLE[[*b" \t\n\r"]] = 64
for _i, _c in enumerate(b"=:\"'+/_.-"):
    TABLE[_c] = 65 + _i
N_CLASSES = 74


def window(text: str, start: int, end: int) -> np.ndarray:
    out = np.zeros(WIDE, np.int64)
    left = classes(text[max(0, start - BEFORE) : start])
    own = classes(text[start : min(end, start + INSIDE)])
    right = classes(text[end : end + AFTER])
    out[BEFORE - len(left) : BEFORE] = left
    out[BEFORE : BEFORE + len(own)] = own
    out[BEFORE + INSIDE : BEFORE + INSIDE + len(right)] = right
    return out


def windows(text: str, start: int, end: int) -> list[np.ndarray]:
    """Overlapping windows over all of a run."""
    if end - start <= INSIDE:
        return [window(text, start, end)]
    return [window(text, s, s + INSIDE) for s in [*range(start, end - INSIDE, STEP), end - INSIDE]]


def candidates(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """(start, end) of token runs that no taken span touches; full stops at the end don't belong to a run."""
    out = []
    for m in RUN.finditer(text):
        own = m[0].rstrip(".")
        a, b = m.start(), m.start() + len(own)
        if b - a >= LEAST and not any(x < b and a < z for x, _, z in taken):
            out.append((a, b))
    return out


class Network:
    """Embedding, convolution, pooling, hidden layer; Adam on the logistic loss."""

    def __init__(self, dim: int = 8, filters: int = 24, hidden: int = 24, width: int = 5, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.width = width
        self.p = {"e": rng.normal(0, 0.3, (N_CLASSES, dim)), "c": rng.normal(0, (2 / (width * dim)) ** 0.5, (width * dim, filters)), "cb": np.zeros(filters), "h": rng.normal(0, (1 / filters) ** 0.5, (2 * filters, hidden)), "hb": np.zeros(hidden), "o": rng.normal(0, (1 / hidden) ** 0.5, hidden), "ob": np.zeros(1)}
        self.threshold, self.platt, self.report = 2.0, (0.0, 1.0), {}

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, tuple]:
        p, n = self.p, len(x)
        e = p["e"][x]
        places = WIDE - self.width + 1
        u = np.concatenate([e[:, k : k + places] for k in range(self.width)], axis=2)
        a = u.reshape(n * places, -1) @ p["c"] + p["cb"]
        r = np.maximum(a, 0).reshape(n, places, -1)
        top = r.argmax(axis=1)
        pooled = np.concatenate([np.take_along_axis(r, top[:, None], 1)[:, 0], r.mean(axis=1)], axis=1)
        z = pooled @ p["h"] + p["hb"]
        h = np.maximum(z, 0)
        return 1 / (1 + np.exp(-np.clip(h @ p["o"] + p["ob"], -40, 40))), (u, r, top, pooled, h)

    def step(self, x: np.ndarray, y: np.ndarray, m: dict, v: dict, t: int, rate: float) -> None:
        p, n = self.p, len(x)
        q, (u, r, top, pooled, h) = self.forward(x)
        d = (q - y) / n
        g = {"o": h.T @ d, "ob": np.array([d.sum()])}
        dz = d[:, None] * p["o"] * (h > 0)
        g |= {"h": pooled.T @ dz, "hb": dz.sum(axis=0)}
        dp, f = dz @ p["h"].T, r.shape[2]
        dr = np.repeat(dp[:, None, f:] / r.shape[1], r.shape[1], axis=1)
        np.put_along_axis(dr, top[:, None], np.take_along_axis(dr, top[:, None], 1) + dp[:, None, :f], 1)
        da = (dr * (r > 0)).reshape(-1, f)
        flat = u.reshape(len(da), -1)
        g |= {"c": flat.T @ da, "cb": da.sum(axis=0)}
        du = (da @ p["c"].T).reshape(u.shape)
        k = p["e"].shape[1]
        de = np.zeros((n, WIDE, k))
        for i in range(self.width):
            de[:, i : i + u.shape[1]] += du[:, :, i * k : (i + 1) * k]
        g["e"] = np.stack([np.bincount(x.ravel(), de[:, :, i].ravel(), N_CLASSES) for i in range(k)], axis=1)
        for name in p:
            m[name] = 0.9 * m[name] + 0.1 * g[name]
            v[name] = 0.999 * v[name] + 0.001 * g[name] ** 2
            p[name] = p[name] - rate * (m[name] / (1 - 0.9**t)) / (np.sqrt(v[name] / (1 - 0.999**t)) + 1e-8)

    def descend(self, x: np.ndarray, y: np.ndarray, passes: int, rng: np.random.Generator, size: int = BATCH, rate: float = 3e-3) -> None:
        """Passes over all windows in random order, each with bare ones drawn anew."""
        m, v, t = {k: 0.0 for k in self.p}, {k: 0.0 for k in self.p}, 0
        for _ in range(passes):
            own_x, own_y, _ = with_bare(x, y, rng)
            rows = rng.permutation(len(own_x))
            for i in range(0, len(rows), size):
                t += 1
                self.step(own_x[rows[i : i + size]], own_y[rows[i : i + size]], m, v, t, rate)

    def tally(self, x: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> Counter:
        """How many windows of each label (0, 1, 2 for bare ones) have a score at each step of the logit."""
        x, y, bare = with_bare(x, y, rng)
        label = np.where(bare, 2, y).astype(np.int64)
        out: Counter = Counter()
        for i in range(0, len(x), 2048):
            at = np.floor(logit(self.forward(x[i : i + 2048])[0]) * STEPS).astype(np.int64)
            out.update(zip(label[i : i + 2048].tolist(), at.tolist(), strict=True))
        return out

    def settle(self, counts: Counter, recall: float = RECALL) -> None:
        """Threshold, logistic fit and report from the counts of tally()."""
        label, at, n = np.array([(y, k, n) for (y, k), n in sorted(counts.items())], np.int64).reshape(-1, 3).T
        good, bare = label > 0, label == 2
        if not good.any():
            return
        order = np.argsort(at[good], kind="stable")
        reached = np.cumsum(n[good][order])
        edge = at[good][order][np.searchsorted(reached, int((1 - recall) * reached[-1]), "right")]
        self.threshold = float(1 / (1 + np.exp(-edge / STEPS)))
        hit = at >= edge
        share = lambda part, whole: float(n[part & whole].sum() / n[whole].sum()) if whole.any() else float("nan")
        self.report = {"recall": share(hit, good), "recall_bare": share(hit, bare), "precision": share(good, hit), "held_positive": int(n[label == 1].sum()), "held_bare": int(n[bare].sum()), "held_negative": int(n[label == 0].sum())}
        self.platt = platt((at + 0.5) / STEPS, good.astype(float), n)

    def fit(self, x: np.ndarray, y: np.ndarray, recall: float = RECALL, steps: int = LEAST_STEPS, size: int = BATCH, seed: int = 7) -> Network:
        """The same on windows in memory, as one shard, with every third held back."""
        held, rng = np.arange(len(x)) % 3 == 2, np.random.default_rng(seed)
        if len(set(y[~held].tolist())) > 1 and held.any():
            rows = int((~held).sum() + (y[~held] == 0).sum())
            self.descend(x[~held], y[~held], -(-steps * size // rows), rng, size)
            self.settle(self.tally(x[held], y[held], rng), recall)
        return self

    def probability(self, score: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.platt[0] + self.platt[1] * logit(score))))


def logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-9, 1 - 1e-9)
    return np.log(p / (1 - p))


def platt(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Intercept and slope of the logistic fit to n of each (x, y), with the usual targets (n1 + 1) / (n1 + 2) and 1 / (n0 + 2)."""
    n1, n0 = (n * y).sum(), (n * (1 - y)).sum()
    aim, design, w = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2)), np.stack([np.ones(len(x)), x], axis=1), np.array([0.0, 1.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        step = np.linalg.solve((design * (n * p * (1 - p))[:, None]).T @ design + 1e-6 * np.eye(2), design.T @ (n * (aim - p)))
        w = w + np.clip(step, -1, 1)
    return float(w[0]), float(w[1])


HEX_CLASSES = np.array([*range(2, 8), *range(54, 64)])
ALPHABETS = (HEX_CLASSES, np.arange(2, 64), np.array([*range(2, 64), TABLE[ord("+")], TABLE[ord("/")]]))


def with_bare(x: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows, labels, which are bare): those given, and for each negative one with a value drawn anew in its place."""
    out = x[y != 1].copy()
    n = len(out)
    long = rng.integers(20, INSIDE + 1, n)
    kind = rng.integers(0, len(ALPHABETS), n)
    drawn = np.choose(kind[:, None], [a[rng.integers(0, len(a), (n, INSIDE))] for a in ALPHABETS])
    out[:, BEFORE : BEFORE + INSIDE] = np.where(np.arange(INSIDE) < long[:, None], drawn, 0)
    return np.concatenate([x, out]), np.concatenate([(y == 1).astype(float), np.ones(n)]), np.append(np.zeros(len(x), bool), np.ones(n, bool))


def suspicious(text: str, hexadecimal: bool) -> bool:
    """Whether a text may have base findings."""
    low = text.lower()
    return hexadecimal or "AKIA" in text or "passw" in low or "secret" in low or "token" in low or "api" in low


def every_window(docs: DataFrame, batch_bytes: int = 4 << 20) -> DataFrame:
    """x (a window's classes) and y (1: of a base finding's value, 0: of a candidate) of all documents, a row for each occurrence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i, j in slices(whole.column(0), batch_bytes):
                column = whole.column(0).slice(i, j - i)
                data, offsets = utf8(column)
                long, hexa = suspects(data, offsets)
                xs: list[bytes] = []
                ys: list[int] = []
                for text, has_hex, has_run in zip(column.to_pylist(), hexa.tolist(), long.tolist(), strict=True):
                    asks = bool(text) and suspicious(text, has_hex)
                    if not asks and not has_run:
                        continue
                    base = base_spans(text) if asks else []
                    found = [(1, a, b) for a, b in values(text)] if asks else []
                    found += [(0, a, b) for a, b in candidates(text, base)] if has_run else []
                    for y, a, b in found:
                        own = [x.astype(np.uint8).tobytes() for x in windows(text, a, b)]
                        xs += own
                        ys += [y] * len(own)
                yield pa.RecordBatch.from_arrays([pa.array(xs, pa.binary()), pa.array(ys, pa.int32())], names=["x", "y"])

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(lean(run), "x binary, y int")


def labelled(docs: DataFrame, sample: int) -> tuple[np.ndarray, np.ndarray]:
    """(windows, labels) with the `sample` smallest hashes of each label, to look at on the driver. train() doesn't use it: it takes all."""
    place = F.row_number().over(Window.partitionBy("y").orderBy(F.xxhash64("x"), "x"))
    got = sorted((bytes(r[0]), r[1]) for r in every_window(docs).withColumn("place", place).filter(F.col("place") <= sample).select("x", "y").collect())
    x = np.array([np.frombuffer(a, np.uint8) for a, _ in got], np.int64).reshape(-1, WIDE)
    return x, np.array([b for _, b in got], float)


def dealt(seen: DataFrame, n_shards: int) -> DataFrame:
    """shard, blob: all windows of seen (x, y, n, held) over shards. The copies of one window go to as many shards as there are."""
    n = F.col("n")
    spread = seen.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.least(n, F.lit(n_shards)) - 1)))
    own = F.floor(n / n_shards) + F.when(F.col("j") < n % n_shards, 1).otherwise(0)
    spread = spread.select(F.pmod(F.pmod(F.xxhash64(F.lit(1), "x"), F.lit(n_shards)) + F.col("j"), F.lit(n_shards)).cast("int").alias("shard"), "x", "y", own.cast("long").alias("n"), "held")

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("x", "ascending"), ("y", "ascending")])
        x = np.frombuffer(b"".join(group["x"].to_pylist()), np.uint8)
        y, n, held = (np.array(group[k].to_pylist()).astype(np.uint64) for k in ("y", "n", "held"))
        return pa.table({"shard": group["shard"][:1], "blob": pa.array([pack(x, y, n, held)], pa.binary())})

    return spread.repartition(n_shards, "shard").groupBy("shard").applyInArrow(lean_group(run), "shard int, blob binary")


def opened(blob: bytes, held: bool) -> tuple[np.ndarray, np.ndarray]:
    """(windows, labels) of a shard, copies repeated: those held back, or the others."""
    x, y, n, back = unpack(blob)
    which = np.repeat(np.arange(len(y)), np.where(back == held, n, 0).astype(np.int64))
    return x.reshape(-1, WIDE)[which].astype(np.int64), y[which].astype(float)


def train(docs: DataFrame, recall: float = RECALL, rounds: int = ROUNDS, steps: int = LEAST_STEPS, rows: int = ROWS, seed: int = 7) -> Network:
    """The network fitted on all labelled windows of docs (text)."""
    tables, network = Tables(docs.sparkSession, "windows"), Network(seed=seed)
    seen = every_window(docs).groupBy("x", "y").agg(F.count("*").alias("n")).withColumn("held", F.pmod(F.xxhash64("x"), F.lit(3)) == 2)
    seen = tables.write(seen)
    counts = {(r[0], r[1]): r[2] for r in seen.groupBy("y", "held").agg(F.sum("n")).collect()}
    if not (counts.get((0, False)) and counts.get((1, False)) and (counts.get((0, True)) or counts.get((1, True)))):
        return network
    n_shards = min(MOST, -(-sum(counts.values()) // rows))
    shards = tables.write(dealt(seen, n_shards))
    passes = max(1, -(-steps * BATCH * n_shards // (rounds * (2 * counts[0, False] + counts[1, False]))))

    for k in range(rounds):

        def learn(batches: Iterator[pa.RecordBatch], start: dict = network.p, k: int = k) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for shard, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    own = Network()
                    own.p = copy.deepcopy(start)
                    x, y = opened(blob, False)
                    own.descend(x, y, passes, np.random.default_rng([seed, k, shard]))
                    yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([len(x)], pa.int64()), pa.array([np.concatenate([a.ravel() for a in own.p.values()]).tobytes()], pa.binary())], names=["shard", "n", "p"])

        got = sorted((r[0], r[1], bytes(r[2])) for r in shards.mapInArrow(lean(learn), "shard int, n long, p binary").collect())
        mean, at = np.average([np.frombuffer(p) for _, _, p in got], axis=0, weights=[n for _, n, _ in got]), 0
        for name, a in network.p.items():
            network.p[name] = mean[at : at + a.size].reshape(a.shape)
            at += a.size

    def judge(batches: Iterator[pa.RecordBatch], fitted: Network = network) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = fitted.tally(*opened(blob, True), np.random.default_rng([seed, rounds, shard]))
                yield pa.RecordBatch.from_arrays([pa.array([y for y, _ in found], pa.int32()), pa.array([s for _, s in found], pa.int32()), pa.array(list(found.values()), pa.int64())], names=["y", "step", "n"])

    tallied = shards.mapInArrow(lean(judge), "y int, step int, n long").groupBy("y", "step").agg(F.sum("n"))
    network.settle(Counter({(r[0], r[1]): r[2] for r in tallied.collect()}), recall)
    network.report |= {"shards": n_shards, "learnt_positive": counts[1, False], "learnt_negative": counts[0, False]}
    tables.drop(seen)
    tables.drop(shards)
    return network


def scan_batch(column: pa.Array, network: Network) -> list[tuple[str, list[tuple[int, int, int]], float | None]]:
    """(text, spans as (start, kind, end), least probability of the base findings) of each text; kind indexes KINDS."""
    data, offsets = utf8(column)
    run, hexa = suspects(data, offsets)
    found, asked, where = [], [], []
    for i, text in enumerate(column.to_pylist()):
        text = text or ""
        spans = base_spans(text) if suspicious(text, hexa[i]) else []
        for own, (a, b) in [(True, v) for v in (values(text) if spans else [])] + [(False, c) for c in (candidates(text, spans) if run[i] else [])]:
            seen = windows(text, a, b)
            asked += seen
            where += [(i, own, a, b)] * len(seen)
        found.append((text, spans))
    best: dict[tuple[int, bool, int, int], float] = {}
    for k in range(0, len(asked), 2048):
        p = network.forward(np.array(asked[k : k + 2048]))[0]
        for w, q in zip(where[k : k + 2048], p.tolist(), strict=True):
            best[w] = max(best.get(w, 0.0), q)
    least: dict[int, float] = {}
    for (i, own, a, b), q in best.items():
        if own:
            least[i] = min(least.get(i, 1.0), q)
        elif q >= network.threshold:
            found[i][1].append((a, 3, b))
    return [(t, sorted(s), float(network.probability(np.array(least[i]))) if i in least else None) for i, (t, s) in enumerate(found)]


def said(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(docs: DataFrame, network: Network, batch_bytes: int = 4 << 20) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_model, base_probability (null without base findings)."""
    shared = docs.sparkSession.sparkContext.broadcast(network)
    names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_model", "base_probability"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i, j in slices(whole.column(1), batch_bytes):
                part = whole.slice(i, j - i)
                scanned = scan_batch(part.column(1), shared.value)
                found = [s for _, s, _ in scanned]
                count = [[sum(x[1] == k for x in s) for s in found] for k in range(4)]
                base = [hashlib.sha256(said([x for x in s if x[1] < 3]).encode()).hexdigest() for s in found]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, pa.int64()) for c in count[:3]), pa.array(base, pa.string()), pa.array([said(s) for s in found], pa.string()), pa.array(count[3], pa.int64()), pa.array([p for _, _, p in scanned], pa.float64())], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lean(run), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_model long, base_probability double")


def redact(text: str, spans: list[tuple[int, int, int]], mark: str = "[secret]") -> str:
    """The text with every span, or touching spans together, replaced by the mark."""
    out, at, end = [], 0, -1
    for a, _, b in spans:
        if a >= end:
            out += [text[at:a], mark]
        end = at = max(end, b)
    return "".join(out) + text[at:] if spans else text


def redacted(docs: DataFrame, network: Network, batch_bytes: int = 4 << 20) -> DataFrame:
    """docs with the secrets in text replaced by a mark, and n_chars, where there is one, of the new text. Null texts stay null."""
    shared = docs.sparkSession.sparkContext.broadcast(network)
    at, size = docs.columns.index("text"), docs.columns.index("n_chars") if "n_chars" in docs.columns else -1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i, j in slices(whole.column(at), batch_bytes):
                part = whole.slice(i, j - i)
                found = scan_batch(part.column(at), shared.value)
                null = part.column(at).is_null().to_pylist()
                texts = [None if z else redact(t, s) for (t, s, _), z in zip(found, null, strict=True)]
                columns = list(part.columns)
                columns[at] = pa.array(texts, part.schema.field(at).type)
                if size >= 0:
                    old = columns[size].to_pylist()
                    columns[size] = pa.array([len(t) if t is not None and s else o for t, (_, s, _), o in zip(texts, found, old, strict=True)], pa.int64())
                yield pa.RecordBatch.from_arrays(columns, names=whole.schema.names)

    return docs.mapInArrow(lean(run), docs.schema)
