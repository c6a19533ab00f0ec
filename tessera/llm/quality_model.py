"""Quality classifier from weak labels.

Overlapping labellers vote good (1), bad (2) or abstain (0) on every document: heuristics on the text and,
where a document has them, its human labels. Votes depend on a latent class (clean, or one of several kinds
of bad text); expectation-maximisation over the counts of vote patterns of all documents (at most
3^labellers rows) estimates each labeller's behaviour per class, and so its accuracy: of the human labels as of
the heuristics. A class has rates of its own for the labellers that tell it, all others vote there as they do
on clean texts, and what tells a class votes bad on at least half of its texts; a missing label says nothing. The posterior of clean given the votes is the soft label on which a
logistic scorer over hashed features (words, their beginnings, shape) is trained by stochastic gradient steps.
Only this last fit uses a sample of about `sample` documents, all of one weight: half from the labelled ones, half
from all, by the smallest hashes of their ids; patterns and scores cover all documents.

Only narrow rows (patterns, sampled features) are joined to the labels; texts are never shuffled. Null texts
are empty texts. Repeated rows are scored alike; a null doc_id is scored but not sampled. Of several labels
of a document the worst counts. Empty tables give no rows, and without labels their two labellers abstain.
Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import bounded, chunks, utf8

#: Words that abuse a reader.
ABUSE = ("idiot", "moron", "loser", "stupid", "scum", "trash", "pathetic", "worthless", "disgusting", "clown")
HEURISTICS = ("length", "symbols", "shouting", "exclaiming", "variety", "lines", "pipes", "abuse")
LABELLERS = (*HEURISTICS, "label_quality", "label_toxic")
#: Classes of bad text, each with the labellers that tell it.
KINDS = {"symbols": ("symbols",), "shouting": ("shouting", "exclaiming"), "repeating": ("variety",), "lines": ("lines",), "pipes": ("pipes",), "abusive": ("abuse", "label_toxic"), "labelled_low": ("label_quality",), "labelled_toxic": ("label_toxic",)}
#: Words over which variety is measured; the least varied block of a text counts.
BLOCK = 400
BUCKETS, SAMPLE = 1 << 18, 20_000
_UPPER = bytes(range(65, 91))
_SYMBOLS = b"#*$%&<>"
_ABUSE = frozenset(w.encode() for w in ABUSE)


def three(bad: bool, good: bool) -> int:
    return 2 if bad else 1 if good else 0


def votes(text: bytes) -> tuple[int, list[bytes], list[str]]:
    """The pattern (base-3 number of the votes), the lower-cased words, and the shape features."""
    words = text.lower().split()
    n, size = len(words), max(1, len(text))
    symbols = (len(text) - len(text.translate(None, _SYMBOLS))) / size
    upper = (len(text) - len(text.translate(None, _UPPER))) / size
    exclaim, pipes = text.count(b"!") / max(1, n), text.count(b"|") / max(1, n)
    kinds = min((len(set(words[a : a + BLOCK])) / min(BLOCK, n - a) for a in range(0, n, BLOCK)), default=0.0)
    repeated = sum(a == b for a, b in zip(words, words[1:])) / max(1, n)
    lines = [x for x in text.split(b"\n") if x.strip()]
    same = 1 - len(set(lines)) / max(1, len(lines))
    abuse = sum(1 for w in words if w in _ABUSE or w.strip(b".,;:!?\"'()") in _ABUSE)
    all_votes = (
        three(n < 5, n >= 50), three(symbols > 0.02, symbols < 0.002), three(upper > 0.3, upper < 0.1), three(exclaim > 0.2, exclaim == 0), three(repeated > 0.05, repeated < 0.01 and kinds > 0.3),
        three(same > 0.3, same == 0), three(pipes > 0.05, pipes == 0), three(abuse >= 1, abuse == 0),
    )
    pattern = 0
    for v in all_votes:
        pattern = 3 * pattern + v
    shape = [f"{k}>{t}" for k, x in (("symbols", symbols), ("upper", upper), ("exclaim", exclaim), ("repeated", repeated), ("same", same), ("pipes", pipes)) for t in (0.02, 0.1, 0.3) if x > t]
    shape += [f"words<{t}" for t in (20, 50) if n < t]
    return pattern, words, shape


def features(words: list[bytes], shape: list[str], cache: dict[bytes, tuple]) -> np.ndarray:
    """Distinct hashed buckets of the words (outer punctuation off), of beginnings of long words, and of the
    shape; bucket 0 is the bias."""
    import xxhash

    found: set[int] = set()
    for w in set(words):
        h = cache.get(w)
        if h is None:
            bare = w.strip(b".,;:!?\"'()")
            parts = [bare, *(b"\1" + bare[:k] for k in (4, 5, 6) if len(bare) > k)]
            h = cache[w] = tuple(1 + xxhash.xxh64_intdigest(x) % (BUCKETS - 1) for x in parts)
        found.update(h)
    if len(cache) > 150_000:
        cache.clear()
    found.update(1 + xxhash.xxh64_intdigest(b"\0" + s.encode()) % (BUCKETS - 1) for s in shape)
    return np.fromiter(found, np.int64, len(found))


def label_votes(labels: DataFrame) -> DataFrame:
    """doc_id, by_label: the last two digits of a pattern."""
    worst = labels.groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("toxic").alias("t"))
    digit = lambda good, bad: F.when(bad, 2).when(good, 1).otherwise(0)
    return worst.where("doc_id is not null").select("doc_id", (3 * digit(F.col("q") == 1, F.col("q") == 0) + digit(F.col("t") == 0, F.col("t") == 1)).cast("long").alias("by_label"))


def vote_counts(docs: DataFrame, labels: DataFrame) -> dict[int, int]:
    """How often each pattern of votes occurs among all documents; at most 3^labellers patterns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "pattern": pa.array([votes(t)[0] for t in utf8(batch.column("text"))], pa.int64())})

    each = bounded(docs).mapInArrow(run, "doc_id long, pattern long").join(label_votes(labels), "doc_id", "left")
    return {r["p"]: r["n"] for r in each.groupBy((9 * F.col("pattern") + F.coalesce("by_label", F.lit(0))).alias("p")).agg(F.count("*").alias("n")).collect()}


def unpacked(patterns: np.ndarray) -> np.ndarray:
    k = len(LABELLERS)
    return (patterns[:, None] // 3 ** np.arange(k - 1, -1, -1)) % 3


class WeakLabels:
    """EM over vote patterns. prior[c]; table[c, labeller, vote]; class 0 is clean."""

    def __init__(self, counts: dict[int, int], rounds: int = 100):
        patterns = np.array(sorted(counts), np.int64)
        n, v = np.array([counts[p] for p in patterns.tolist()], float), unpacked(patterns)
        self.prior = np.array([1 - 0.02 * len(KINDS)] + [0.02] * len(KINDS))
        start = np.tile((0.2, 0.78, 0.02), (len(KINDS) + 1, len(LABELLERS), 1))
        start[:, -2:] = (1.0, 0.99, 0.01)
        own, tells = np.zeros((2, len(KINDS) + 1, len(LABELLERS)), bool)
        for c, told_by in enumerate(KINDS.values(), 1):
            start[c, -2], own[c, -2] = (1.0, 0.5, 0.5), True  # a bad text's quality label may well say so
            for name in told_by:
                own[c, LABELLERS.index(name)] = tells[c, LABELLERS.index(name)] = True
                start[c, LABELLERS.index(name)] = (1.0, 0.05, 0.95) if name.startswith("label_") else (0.1, 0.05, 0.85)
        self.table = start.copy()
        last = -np.inf
        for _ in range(rounds if len(patterns) else 0):
            post, like = self._posterior(v)
            weight = post * n[:, None]
            self.prior = (weight.sum(0) + 1) / (n.sum() + len(self.prior))
            seen = np.stack([np.einsum("pc,pk->ck", weight, v == vote) for vote in range(3)], 2)
            # where a labeller does not tell a class, it votes as on clean texts; the start counts as one text
            seen = np.where(own[:, :, None], seen, (seen * ~own[:, :, None]).sum(0)) + start
            seen[:, -2:, 0] = 0
            self.table = seen / seen.sum(2, keepdims=True)
            # a class stays what it is called: what tells it votes bad on half of its texts or more
            weak = tells & (self.table[:, :, 2] < 0.5)
            self.table[weak, :2] *= 0.5 / self.table[weak, :2].sum(1, keepdims=True)
            self.table[weak, 2] = 0.5
            self.table[:, -2:, 0] = 1  # a missing label says nothing
            now = float((n * like).sum())
            if now - last < 1e-7 * abs(now):
                break
            last = now
        self.accuracy = {name: float(1 - self.prior[1:] @ self.table[1:, j, 1] - self.prior[0] * self.table[0, j, 2]) for j, name in enumerate(LABELLERS)}

    def _posterior(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        log = np.log(self.prior) + np.log(self.table[:, np.arange(v.shape[1]), v]).sum(-1).T
        top = log.max(1, keepdims=True)
        total = np.log(np.exp(log - top).sum(1, keepdims=True)) + top
        return np.exp(log - total), total[:, 0]

    def clean(self) -> np.ndarray:
        """The posterior of clean for every possible pattern."""
        return self._posterior(unpacked(np.arange(3 ** len(LABELLERS))))[0][:, 0]


def training_rows(docs: DataFrame, labels: DataFrame, clean: np.ndarray, counts: dict[int, int], sample: int) -> list[tuple[float, np.ndarray]]:
    """(soft label, buckets) of about `sample` documents: a bound, not a share, of what reaches the driver.
    Half are drawn from the labelled documents, half from all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[bytes, tuple] = {}
        for batch in chunks(batches):
            got = [votes(t) for t in utf8(batch.column("text"))]
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "pattern": pa.array([g[0] for g in got], pa.int64()), "x": pa.array([features(g[1], g[2], cache).astype("<i4").tobytes() for g in got], pa.binary())})

    def near(total: int) -> Column:
        return F.xxhash64("doc_id").bitwiseAND(F.lit((1 << 62) - 1)) < int(min(1.0, sample / 2 / max(1, total)) * (1 << 62))

    said = label_votes(labels).where("by_label <> 0")
    drawn = said.where(near(max(said.count(), sum(n for p, n in counts.items() if p % 9)))).select("doc_id", F.lit(True).alias("drawn"))
    # about sample / 2 ids: texts are not shuffled
    rows = bounded(docs).where("doc_id is not null").join(F.broadcast(drawn), "doc_id", "left").where(F.coalesce("drawn", F.lit(False)) | near(sum(counts.values()))).select("doc_id", "text")
    rows = rows.mapInArrow(run, "doc_id long, pattern long, x binary").join(said, "doc_id", "left")
    return [(float(clean[9 * r["pattern"] + (r["by_label"] or 0)]), np.frombuffer(r["x"], "<i4").astype(np.int32)) for r in rows.orderBy(F.xxhash64("doc_id"), "pattern").toLocalIterator()]


def fit(rows: list[tuple[float, np.ndarray]], epochs: int = 12, rate: float = 0.05, decay: float = 1e-3, least: int = 20, seed: int = 7) -> np.ndarray:
    """Weights of a logistic scorer by mini-batches with per-weight step sizes. Bad documents weigh as much
    as good ones; buckets of fewer than `least` documents get no weight."""
    w, g2, rng = np.zeros(BUCKETS, np.float64), np.full(BUCKETS, 1e-8), np.random.default_rng(seed)
    if not rows:
        return w
    often = np.bincount(np.concatenate([r[1] for r in rows]), minlength=BUCKETS) >= min(least, len(rows) // 10)
    kept = [np.append(r[1][often[r[1]]], np.int32(0)) for r in rows]
    p = np.array([r[0] for r in rows])
    lengths, flat = np.array([len(x) for x in kept]), np.concatenate(kept)
    starts = np.cumsum(lengths) - lengths
    share = min(max(float((1 - p).mean()), 0.01), 0.99)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for a in range(0, len(order), 256):
            own = order[a : a + 256]
            at = np.concatenate([flat[starts[i] : starts[i] + lengths[i]] for i in own])
            of = np.repeat(np.arange(len(own)), lengths[own])
            z = np.bincount(of, w[at], len(own))
            error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - p[own]
            error *= (p[own] * 0.5 / (1 - share) + (1 - p[own]) * 0.5 / share) / len(own)
            used, back = np.unique(at, return_inverse=True)
            grad = np.bincount(back, error[of]) + decay * w[used]
            g2[used] += grad * grad
            w[used] -= rate * grad / np.sqrt(g2[used])
    return w


def accuracies(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """labeller, accuracy: the estimated share of documents on which a labeller does not contradict the class (it abstains,
    or votes good on clean and bad on other texts). One row per labeller."""
    counts = vote_counts(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), labels)
    return docs.sparkSession.createDataFrame(list(WeakLabels(counts).accuracy.items()), "labeller string, accuracy double")


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, weak (posterior of clean from the heuristics' votes alone), score (of the hashed scorer) and
    keep (score of a half or more). labels: doc_id, quality, toxic."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    counts = vote_counts(rows, labels)
    clean = WeakLabels(counts).clean()
    weights = fit(training_rows(rows, labels, clean, counts, sample))
    told = rows.sparkSession.sparkContext.broadcast((clean[::9].copy(), weights.astype(np.float32)))  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        clean, w = told.value
        cache: dict[bytes, tuple] = {}
        for batch in chunks(batches):
            got = [votes(t) for t in utf8(batch.column("text"))]
            z = np.array([w[features(g[1], g[2], cache)].sum(dtype=np.float64) + w[0] for g in got])
            score = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "weak": clean[[g[0] for g in got]], "score": score, "keep": score >= 0.5})

    return bounded(rows).mapInArrow(run, "doc_id long, weak double, score double, keep boolean")


def op9_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: posterior of the weak labels, score and verdict."""
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
