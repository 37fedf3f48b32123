"""Language identification by interpolated Kneser-Ney character models, one per language.

Texts are lower-cased; letters form words (other characters end one), and a model gives
the probability of a word's characters and its end from up to `order - 1` characters
before, beginning with a boundary. Highest orders use counts, lower ones the number of
distinct characters to the left; each order has one absolute discount n1 / (n1 + 2 n2).
The tables of all languages share sorted arrays of 64-bit n-gram hashes: a row has the
interpolated log-probability under every language, and the log of its back-off weight.
A text's score under a language is its length-normalised cross-entropy; the lowest wins.

All languages share one alphabet (every character learned, the word's end, and one unknown
character), whose uniform distribution ends the interpolation, so the probabilities of the
alphabet add up to 1 in every context of every language and likelihoods are comparable.

Words repeat, so a batch scores its distinct words once. The fit takes a bounded sample:
at most `sample` distinct documents of each language, the smallest hashes of id and text.

Rejection has two rules. A text goes if the uniform model is 1 / ALPHA times as likely as
the best language: by Markov's inequality a text that follows a language's model is lost
with a probability of at most ALPHA, whatever the language's number of rows. And for
languages with ENOUGH documents, folds of the sample are scored by tables fitted on the
other folds; a text of SHORT predicted characters or more goes if its cross-entropy is
nearer the uniform model's than the language's held-out mean, as texts in other languages
of the same script are. Rare languages thus have no limit of their own. The tables are then
fitted on all of the sample.

The score is the probability that the language is right: a logistic function of the
evidence, log2(1 + bits by which the best language beats the second), fitted on whole texts
and runs of one to eight words of the held-out folds, whose short runs are often mistaken.

Defined results: a text that is null or has no letter is `und` with score 0, rejected.
Languages and texts that are null are not learned from, nor languages without a letter in
their texts. With nothing to learn from, all texts are `und`. Repeated rows are judged each; extra columns are ignored; ties go to the
first language by code point.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bagloom.llm.common import U, hash_spans, lean, mix, padded, slices, utf8

ORDER, SAMPLE, FOLDS = 5, 150, 3
ALPHA, ENOUGH, SHORT = 1e-3, 30, 100
BOUND = 0x20


def letter_table() -> np.ndarray:
    """For each code point whether it is a letter."""
    import unicodedata

    out = np.zeros(0x110000, bool)
    out[[i for i in range(0x110000) if unicodedata.category(chr(i))[0] == "L"]] = True
    return out


_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    if not _letters:
        _letters.append(letter_table())
    return _letters[0]


def letter_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(code points of the lower-cased batch, word starts, word ends, text of each word)."""
    low = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    data, offsets = utf8(low)
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    # where each text begins, in code points
    lead = np.append(0, np.cumsum((data & 0xC0) != 0x80))
    begin = lead[offsets]
    n = len(points)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = letters()[points]
    first = np.zeros(n + 1, bool)
    first[begin] = True
    head = inside[1:] & (~inside[:-1] | first)
    tail = inside[:-1] & (~inside[1:] | first)
    starts, ends = np.flatnonzero(head), np.flatnonzero(tail)
    return points, starts, ends, np.searchsorted(begin, starts, "right") - 1


def contexts(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(characters with a boundary before and after each word, place of each predicted character)."""
    size = ends - starts + 2
    total = np.cumsum(size)
    out = np.full(int(total[-1]) if len(size) else 0, BOUND, np.uint32)
    inner = np.repeat(starts - (total - size) - 1, size) + np.arange(len(out))
    edge = np.zeros(len(out), bool)
    edge[total - 1] = edge[total - size] = True
    out[~edge] = points[inner[~edge]]
    predicted = ~edge
    predicted[total - 1] = True
    return out, np.flatnonzero(predicted)


def gram_hashes(chars: np.ndarray, place: np.ndarray, since: np.ndarray, order: int) -> list[np.ndarray]:
    """For n = 1 to order the hash of the n characters that end at each place; shorter words' n-grams reach to their boundary.

    since: characters from the word's boundary to each place. Where n exceeds it, the hash is 0.
    """
    out = []
    with np.errstate(over="ignore"):
        h = np.zeros(len(place), U)
        for n in range(1, order + 1):
            c = chars[np.maximum(place - n + 1, 0)].astype(U)
            h = h + mix(c + U(n << 32))
            h = mix(h)
            out.append(np.where(since >= n - 1, h, U(0)))
    return out


def context_hashes(chars: np.ndarray, place: np.ndarray, since: np.ndarray, order: int) -> list[np.ndarray]:
    """For n = 1 to order the hash of the n - 1 characters before each place (n = 1: the empty context)."""
    out = [np.full(len(place), 1, U)]
    with np.errstate(over="ignore"):
        h = np.zeros(len(place), U)
        for n in range(2, order + 1):
            c = chars[np.maximum(place - n + 1, 0)].astype(U)
            h = mix(h + mix(c + U(n << 32)) + U(0x51ED27))
            out.append(np.where(since >= n - 1, h, U(0)))
    return out


class Models:
    """Sorted hash arrays: per order n-gram keys with log-probabilities and context keys with log back-off weights, a column per language."""

    def __init__(self, langs: list[str], order: int = ORDER):
        self.langs, self.order = langs, order
        self.keys: list[np.ndarray] = []
        self.prob: list[np.ndarray] = []
        self.heads: list[np.ndarray] = []
        self.back: list[np.ndarray] = []
        self.floor = -1.0
        self.limit = np.full(len(langs), np.inf)
        self.odds = np.array([0.0, 1.0])

    def fit(self, texts: list[tuple[str, str]]) -> Models:
        """texts: (language, text)."""
        per = []
        for lang in self.langs:
            points, starts, ends, _ = letter_words(pa.array([t for own, t in texts if own == lang], pa.string()))
            chars, place = contexts(points, starts, ends)
            since = self.since(starts, ends)
            per.append((chars, place, since))
        self.floor = -np.log2(len(np.unique(np.concatenate([c[p] for c, p, _ in per]))) + 1.0)
        grams = [gram_hashes(c, p, s, self.order) for c, p, s in per]
        heads = [context_hashes(c, p, s, self.order) for c, p, s in per]
        lower = None
        for n in range(1, self.order + 1):
            seen = []
            for k, (chars, place, since) in enumerate(per):
                ok = grams[k][n - 1] != 0
                key, at, count = np.unique(grams[k][n - 1][ok], return_index=True, return_counts=True)
                at = np.flatnonzero(ok)[at]
                # counts at the top order and for n-grams that begin at the boundary; else distinct left characters
                if n < self.order:
                    longer = grams[k][n]
                    has = longer != 0
                    pair, first = np.unique(longer[has], return_index=True)
                    left = np.flatnonzero(has)[first]
                    owner = np.searchsorted(key, grams[k][n - 1][left])
                    kinds = np.bincount(owner, minlength=len(key))
                    count = np.where(kinds > 0, kinds, count)
                seen.append((key, at, count.astype(float)))
            keys = np.unique(np.concatenate([s[0] for s in seen])) if seen else np.zeros(0, U)
            tops = np.unique(np.concatenate([h[n - 1][h[n - 1] != 0] for h in heads]))
            prob = np.zeros((len(keys), len(per)), np.float64)
            back = np.zeros((len(tops), len(per)), np.float64)
            for k, (key, at, count) in enumerate(seen):
                n1, n2 = (count == 1).sum(), (count == 2).sum()
                discount = min(0.95, max(0.1, n1 / (n1 + 2 * n2))) if n1 + n2 else 0.5
                own = np.searchsorted(tops, heads[k][n - 1][at])
                total = np.bincount(own, count, len(tops))
                taken = np.bincount(own, np.minimum(discount, count), len(tops))
                weight = np.divide(taken, total, out=np.ones(len(tops)), where=total > 0)
                back[:, k] = np.log2(weight)
                direct = np.zeros(len(keys))
                direct[np.searchsorted(keys, key)] = np.maximum(count - discount, 0) / total[own]
                # the context and the shorter n-gram of each key, from any place where it stands
                prob[:, k] = direct
            source = np.zeros((len(keys), 2), np.int64)
            for k, (key, at, _) in enumerate(seen):
                source[np.searchsorted(keys, key)] = np.stack([np.full(len(at), k), at], axis=1)
            context, shorter = np.zeros(len(keys), np.int64), np.zeros(len(keys), U)
            for k in range(len(per)):
                mine = source[:, 0] == k
                context[mine] = np.searchsorted(tops, heads[k][n - 1][source[mine, 1]])
                if n > 1:
                    shorter[mine] = grams[k][n - 2][source[mine, 1]]
            base = np.full(prob.shape, 2.0**self.floor) if n == 1 else 2.0 ** lower(shorter)
            prob = np.log2(prob + 2.0 ** back[context] * base)
            self.keys.append(keys)
            self.prob.append(prob)
            self.heads.append(tops)
            self.back.append(back)

            def lower(want: np.ndarray, keys=keys, prob=prob) -> np.ndarray:
                return prob[np.searchsorted(keys, want)]

        return self

    @staticmethod
    def since(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        size = ends - starts + 1
        total = np.cumsum(size)
        return np.arange(int(total[-1]) if len(size) else 0) - np.repeat(total - size, size) + 1

    def log_probabilities(self, chars: np.ndarray, place: np.ndarray, since: np.ndarray) -> np.ndarray:
        """Base-2 logarithms for each place and language: the longest known n-gram, times the weights of longer contexts."""
        n_lang = len(self.langs)
        out = np.zeros((len(place), n_lang))
        open_ = np.arange(len(place))
        grams, heads = gram_hashes(chars, place, since, self.order), context_hashes(chars, place, since, self.order)
        for n in range(self.order, 0, -1):
            want = grams[n - 1][open_]
            keys = self.keys[n - 1]
            at = np.minimum(np.searchsorted(keys, want), max(0, len(keys) - 1))
            hit = (keys[at] == want) & (want != 0) if len(keys) else np.zeros(len(want), bool)
            out[open_[hit]] += self.prob[n - 1][at[hit]]
            open_ = open_[~hit]
            tops, head = self.heads[n - 1], heads[n - 1][open_]
            at = np.minimum(np.searchsorted(tops, head), max(0, len(tops) - 1))
            known = (tops[at] == head) & (head != 0) if len(tops) else np.zeros(len(head), bool)
            out[open_[known]] += self.back[n - 1][at[known]]
        out[open_] += self.floor
        return out

    def cross_entropies(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(bits per character under each language, characters predicted) of each text."""
        points, starts, ends, owner = letter_words(texts)
        n, n_lang = len(texts), len(self.langs)
        bits, chars_n = np.zeros((n, n_lang)), np.zeros(n)
        if len(starts):
            raw = padded(points.view(np.uint8))
            keys = hash_spans(raw, starts * 4, (ends - starts) * 4)
            _, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
            own_s, own_e = starts[first], ends[first]
            chars, place = contexts(points, own_s, own_e)
            size = own_e - own_s + 1
            logs = self.log_probabilities(chars, place, self.since(own_s, own_e))
            per_word = np.add.reduceat(logs, np.cumsum(size) - size, axis=0)
            for k in range(n_lang):
                bits[:, k] = -np.bincount(owner, per_word[inverse, k], n)
            chars_n = np.bincount(owner, size[inverse], n)
        return bits / np.maximum(chars_n, 1)[:, None], chars_n

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, score from 0 to 1, rejected) of each text."""
        if not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        bits, n = self.cross_entropies(texts)
        best = bits.argmin(axis=1)
        least = bits[np.arange(len(bits)), best]
        none = n == 0
        score = np.where(none, 0.0, 1 / (1 + np.exp(-np.clip(self.odds[0] + self.odds[1] * evidence(bits, n), -40, 40))))
        names = [("und" if z else self.langs[b]) for b, z in zip(best.tolist(), none.tolist(), strict=True)]
        unlike = ((least + self.floor) * n > -np.log2(ALPHA)) | ((n >= SHORT) & (least > self.limit[best]))
        return names, score, none | unlike


def evidence(bits: np.ndarray, n: np.ndarray) -> np.ndarray:
    """log2(1 + bits by which the best language beats the second)."""
    if bits.shape[1] < 2:
        return np.log2(1 + n)
    two = np.partition(bits, 1, axis=1)
    return np.log2(1 + (two[:, 1] - two[:, 0]) * n)


def logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """(intercept, slope) of the most likely logistic curve, with one right and one wrong case at each end of x for a prior."""
    x = np.concatenate([x, [0, 0], [x.max(initial=1.0)] * 2])
    y = np.concatenate([y, [0, 1, 0, 1]]).astype(float)
    design, w = np.stack([np.ones(len(x)), x], axis=1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        step = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + 1e-9 * np.eye(2), design.T @ (y - p))
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return np.array([w[0], max(w[1], 0.0)])


def runs_of_words(texts: list[str], seed: int) -> list[str]:
    """For each text one run of one to eight of its words."""
    rng, out = np.random.default_rng(seed), []
    for t in texts:
        own = t.split()
        k = int(rng.integers(1, 9))
        i = int(rng.integers(0, max(1, len(own) - k + 1)))
        out.append(" ".join(own[i : i + k]))
    return out


def fitted(rows: list[tuple[str, int, str]], order: int = ORDER, folds: int = FOLDS) -> Models:
    """Models of (language, hash, text) rows, with limits and scores from held-out folds."""
    lettered = {lang for lang in {r[0] for r in rows} if len(letter_words(pa.array([t for a, _, t in rows if a == lang], pa.string()))[1])}
    rows = [r for r in rows if r[0] in lettered]
    langs = sorted(lettered)
    if not langs:
        return Models([], order)
    out = Models(langs, order).fit([(a, t) for a, _, t in rows])
    # folds are dealt within a language, so that each has some of it wherever it has as many rows
    place: dict[str, int] = {}
    fold = []
    for a, _, _ in rows:
        place[a] = place.get(a, -1) + 1
        fold.append(place[a] % folds)
    own_bits: dict[str, list[float]] = {a: [] for a in langs}
    seen_x, seen_y = [], []
    for f in range(folds):
        rest = [(a, t) for (a, _, t), g in zip(rows, fold, strict=True) if g != f]
        there = {a for a, _ in rest}
        held = [(a, t) for (a, _, t), g in zip(rows, fold, strict=True) if g == f and a in there]
        if not held:
            continue
        trial = Models(sorted(there), order).fit(rest)
        truth = np.array([trial.langs.index(a) for a, _ in held])
        for whole, texts in ((True, [t for _, t in held]), (False, runs_of_words([t for _, t in held], f))):
            bits, n = trial.cross_entropies(pa.array(texts, pa.string()))
            some = n > 0
            seen_x.append(evidence(bits, n)[some])
            seen_y.append((bits.argmin(axis=1) == truth)[some])
            if whole:
                for i in np.flatnonzero(n >= SHORT).tolist():
                    own_bits[held[i][0]].append(float(bits[i, truth[i]]))
    for k, a in enumerate(langs):
        if len(own_bits[a]) >= ENOUGH:
            out.limit[k] = (np.mean(own_bits[a]) - out.floor) / 2
    if len(langs) > 1 and seen_x:
        out.odds = logistic(np.concatenate(seen_x), np.concatenate(seen_y))
    return out


def learn(labelled: DataFrame, sample: int = SAMPLE, order: int = ORDER) -> Models:
    """Fits on at most `sample` distinct rows of each language of labelled (doc_id, text, lang)."""
    good = labelled.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), F.xxhash64("doc_id", "text").alias("h"))
    counts = {r[0]: r[1] for r in good.groupBy("lang").count().collect()}

    def drawn(shares: dict[str, float]) -> dict[str, list[tuple[str, int, str]]]:
        # an even draw a little above the bound first, so that no language's rows meet in one task; copies count once
        share = F.lit(0.0)
        for lang, x in shares.items():
            share = F.when(F.col("lang") == lang, x).otherwise(share)
        some = good.filter(F.pmod("h", F.lit(1 << 30)) < share * float(1 << 30)).dropDuplicates(["lang", "h"])
        top = some.withColumn("__r", F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))).filter(F.col("__r") <= sample)
        out: dict[str, list[tuple[str, int, str]]] = {a: [] for a in shares}
        for r in top.select("lang", "h", "text").collect():
            out[r["lang"]].append((r["lang"], r["h"], r["text"]))
        return out

    found = drawn({a: min(1.0, 2.0 * (sample + 20) / n) for a, n in counts.items()}) if counts else {}
    # a language of few distinct rows, each many times, may have none drawn
    few = {a: 1.0 for a, own in found.items() if len(own) < min(sample, counts[a])}
    found |= drawn(few) if few else {}
    return fitted(sorted(r for own in found.values() for r in own), order)


def accepted(docs: DataFrame, models: Models) -> DataFrame:
    """The rows of docs that the models don't reject, with their columns."""
    kept = docs.columns
    return identify(docs.select(F.struct(*kept).alias("__row"), F.col("text").cast("string").alias("text")), models, ["__row"]).filter(~F.col("rejected")).select("__row.*")


def identify(docs: DataFrame, models: Models, keep: list[str] | None = None, batch_bytes: int = 2 << 20) -> DataFrame:
    """The columns `keep` of docs (doc_id by default) with lang_pred, score and rejected."""
    keep = ["doc_id"] if keep is None else keep
    shared = docs.sparkSession.sparkContext.broadcast(models)  # bounded by the sample
    inside = "text" in keep
    source = docs.select(*keep) if inside else docs.select(*keep, F.col("text").cast("string").alias("__text"))
    at = keep.index("text") if inside else len(keep)
    schema = source.select(*keep).schema.add("lang_pred", "string").add("score", "double").add("rejected", "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i, j in slices(whole.column(at), batch_bytes):
                part = whole.slice(i, j - i)
                lang, score, rejected = shared.value.predict(part.column(at))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected)], names=[*keep, "lang_pred", "score", "rejected"])

    return source.mapInArrow(lean(run), schema)
