"""Toxicity by compression distance: a zstandard dictionary trained on toxic text and one trained on ordinary text.

Texts are cut into windows of WINDOW words. A window's distance is its compressed length under the ordinary
dictionary less that under both dictionaries one after the other, so what ordinary text has costs the same on both sides and
only what the toxic dictionary alone holds makes a distance. Every window is followed by a fixed anchor that both sides hold,
since zstandard looks for no match in the last eight bytes of its input.

Both dictionaries come from zstandard's own trainer. Most of a toxic text is ordinary, so the toxic one is trained in rounds, in FOLDS parts:
the windows of each part that stand out most under dictionaries trained on the other parts are what the next round is
trained on, and ordinary windows that stand out likewise join the ordinary dictionary's samples. What one text alone holds never stands
out, since its own part is left out.

Two thresholds are calibrated, on windows and texts that their dictionaries haven't seen: the distance from which a window
counts, and the sum of what counted windows have beyond it, for the logarithm of the text's windows, from which a text is toxic.
Windows of one word are in use: of the lengths tried they tell toxic texts best (see the README).

The model is fitted on a bounded sample of labelled rows (the bounds below). Scoring reads whole texts of all documents, in one pass
without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The sample's bounds: labelled rows of each class (those with the smallest hashes), bytes of a text that may be sampled, bytes of a class.
MAX_TOXIC, MAX_ORDINARY, MAX_BYTES, CLASS_BYTES = 1000, 2000, 32_768, 16 << 20
#: Parts of the sample, rounds of training, windows that a toxic text gives to a round, distance from which one stands out, ordinary texts searched for such windows in a round.
FOLDS, ROUNDS, GIVEN, STANDS_OUT, SEARCHED = 4, 2, 5, 2, 400
#: Texts that a rare window may stand in.
RARE_IN = 8
#: Words of a window, characters of a piece of a longer word and their step.
WINDOW, PIECE, STEP = 1, 64, 32
#: Bytes of each dictionary, windows that one is trained on, length of the segments that the trainer picks for each, of the strings it counts, compression level.
TOXIC_BYTES, ORDINARY_BYTES, TRAINED, TOXIC_SEGMENT, ORDINARY_SEGMENT, COUNTED, LEVEL = 16_000, 64_000, 150_000, 16, 48, 6, 3
#: How often a window that ordinary texts stood out with is shown to the trainer.
EMPHASIS = 4
#: The score at which a text is called toxic.
THRESHOLD = 0.3
ANCHOR = b"\x01<~anchor~window~>\x01"
STRIP = ".,;:!?\"'()[]"
CACHED = 200_000

_scorers: dict = {}


def windows(text: str | None) -> list[bytes]:
    """The windows of a text in order: WINDOW words in lower case without punctuation around them; a word beyond PIECE characters gives overlapping pieces."""
    words = [w.strip(STRIP) for w in (text or "").lower().split()]
    groups = [" ".join(words[i : i + WINDOW]) for i in range(0, len(words), WINDOW)]
    pieces = [g[i : i + PIECE] for g in groups for i in range(0, max(1, len(g) - STEP), STEP)] if any(len(g) > PIECE for g in groups) else groups
    return [f" {g} ".encode(errors="replace") for g in pieces]


def dictionary(samples: list[bytes], size: int, segment: int) -> bytes:
    """What zstandard's trainer keeps of samples; the samples themselves where they are too few to train on."""
    import zstandard as zs

    total = sum(map(len, samples))
    try:
        return zs.train_dictionary(min(size, max(256, total // 4)), samples, k=segment, d=COUNTED).as_bytes()
    except zs.ZstdError:
        return b"".join(samples)[-size:]


class Distances:
    """Compression distances of windows; kept for windows seen before, up to CACHED of them."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        import zstandard as zs

        def make(raw: bytes):
            data = zs.ZstdCompressionDict(ANCHOR + raw, dict_type=zs.DICT_TYPE_RAWCONTENT)
            data.precompute_compress(level=LEVEL)
            return zs.ZstdCompressor(level=LEVEL, dict_data=data, write_content_size=False, write_dict_id=False)

        self.ordinary, self.both, self.kept = make(ordinary), make(ordinary + toxic), {}

    def of(self, window: bytes) -> int:
        found = self.kept.get(window)
        if found is None:
            if len(self.kept) >= CACHED:
                self.kept.clear()
            found = self.kept[window] = len(self.ordinary.compress(window + ANCHOR)) - len(self.both.compress(window + ANCHOR))
        return found

    def all(self, found: list[bytes]) -> np.ndarray:
        return np.array([self.of(w) for w in found], np.int64)


def excess(distances: np.ndarray, least: int) -> float:
    """What the windows of a text have beyond the distance from which they count, for the logarithm of their number."""
    return float(np.maximum(0, distances - least).sum() / np.log(10 + len(distances)))


def _picked(rng, xs: list, n: int) -> list:
    return xs if len(xs) <= n else [xs[i] for i in sorted(rng.permutation(len(xs))[:n])]


class Agreed:
    """The lower of the two middle distances under several toxic dictionaries: chance likenesses differ from one to another."""

    def __init__(self, several: list[Distances]):
        self.several = several

    def of(self, window: bytes) -> int:
        return sorted(d.of(window) for d in self.several)[(len(self.several) - 1) // 2]


def _standing_out(d, text_windows: list[bytes]) -> list[bytes]:
    own = list(dict.fromkeys(text_windows))
    order = sorted((-d.of(w), i) for i, w in enumerate(own))[:GIVEN]
    return [own[i] for far, i in order if -far >= STANDS_OUT]


def without_copies(texts: list[list[bytes]]) -> list[list[bytes]]:
    """texts less those that are much like an earlier one: a third or more of their rare windows stand in it. Copies would stand out as what toxic texts share."""
    held: dict[bytes, list[int]] = {}
    for i, t in enumerate(texts):
        for w in set(t):
            held.setdefault(w, []).append(i)
    out = []
    for i, t in enumerate(texts):
        rare = [w for w in set(t) if len(held[w]) <= RARE_IN]
        earlier: dict[int, int] = {}
        for w in rare:
            for j in held[w]:
                if j < i:
                    earlier[j] = earlier.get(j, 0) + 1
        if 3 * max(earlier.values(), default=0) < max(2, len(rare)):
            out.append(t)
    return out


def train_dictionaries(toxic: list[list[bytes]], ordinary: list[list[bytes]]) -> tuple[list[bytes], bytes]:
    """Toxic dictionaries, one for each part with that part left out and then one of all, and the ordinary dictionary; from windows of texts."""
    rng = np.random.RandomState(0)
    plain = _picked(rng, [w for t in ordinary for w in t], TRAINED)
    hard: list[bytes] = []
    parts = [[w for t in toxic[f::FOLDS] for w in t] for f in range(FOLDS)]
    common = dictionary(plain, ORDINARY_BYTES, ORDINARY_SEGMENT)
    toxic_of = lambda xs: dictionary(_picked(rng, xs, TRAINED), TOXIC_BYTES, TOXIC_SEGMENT)
    for n in range(ROUNDS):
        own = [Distances(toxic_of(p), common) for p in parts]
        others = [Agreed([own[g] for g in range(FOLDS) if g != f]) for f in range(FOLDS)]
        fresh = [[w for t in toxic[f::FOLDS] for w in _standing_out(others[f], t)] for f in range(FOLDS)]
        hard += [w for t in ordinary[n * SEARCHED : (n + 1) * SEARCHED] for w in _standing_out(others[0], t)]
        if min(map(len, fresh)) < FOLDS:  # too little text to learn from in parts
            break
        parts = fresh
        common = dictionary(plain + hard * EMPHASIS, ORDINARY_BYTES, ORDINARY_SEGMENT)
    without = [toxic_of([w for g in range(FOLDS) if g != f for w in parts[g]]) for f in range(FOLDS)]
    return [*without, toxic_of([w for p in parts for w in p])], common


def fit(toxic: list[str], ordinary: list[str], prior: float = 0.5, most_lost: float | None = None) -> dict:
    """The model: two dictionaries and two thresholds. Without texts of both classes every score is 0.

    prior: the share of toxic rows among all labelled ones, for which the thresholds reach the best F1. Every other ordinary
    text is left out of training and calibrates them. With most_lost they catch the most toxic texts that can be caught while no larger share of ordinary ones is called toxic.
    """
    if not toxic or not ordinary:
        return {"toxic": None}
    bad, good = without_copies([windows(t) for t in dict.fromkeys(toxic)]), [windows(t) for t in dict.fromkeys(ordinary)]
    unseen = good[1::2] or good
    dictionaries, common = train_dictionaries(bad, good[0::2])
    held = [Distances(d, common) for d in dictionaries[:-1]]
    far = [held[i % FOLDS].all(t) for i, t in enumerate(bad)] + [held[i % FOLDS].all(t) for i, t in enumerate(unseen)]
    hit = np.r_[np.full(len(bad), prior / len(bad)), np.zeros(len(unseen))]
    called = hit + np.r_[np.zeros(len(bad)), np.full(len(unseen), (1 - prior) / len(unseen))]
    best = bound = (-1.0, 1, 1.0)
    for least in range(1, 8):
        x = np.array([excess(d, least) for d in far])
        for cut in np.unique(x[x > 0]):
            f1 = 2 * hit[x >= cut].sum() / (called[x >= cut].sum() + prior)
            best = max(best, (f1, least, float(cut)))
            if most_lost is not None and (x[len(bad) :] >= cut).mean() <= most_lost:
                bound = max(bound, (float((x[: len(bad)] >= cut).mean()), least, float(cut)))
    best = bound if bound[0] > 0 else best
    return {"toxic": dictionaries[-1], "ordinary": common, "least": best[1], "cut": best[2]}


def _within(texts: list[str]) -> list[str]:
    """The first texts that have CLASS_BYTES together."""
    upto = np.cumsum([len(t.encode(errors="replace")) for t in texts])
    return texts[: int(np.searchsorted(upto, CLASS_BYTES, "right"))]


def sample(docs: DataFrame, labels: DataFrame, where=None) -> tuple[list[str], list[str], float]:
    """Texts of both classes, smallest hashes first, and the share of toxic rows; at most MAX_TOXIC and MAX_ORDINARY labelled rows and CLASS_BYTES of each reach the driver.

    Labels are picked before documents are read, so the documents are only filtered by a table of bounded size.
    Labels that contradict each other, null labels and texts over MAX_BYTES aren't sampled.
    """
    one = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("_most")).where(F.col("toxic") == F.col("_most"))
    if where is not None:
        one = one.where(where)
    shares = {r["toxic"]: r["count"] for r in one.groupBy("toxic").count().collect()}
    order = F.md5(F.col("doc_id").cast("string").cast("binary"))
    pick = lambda value, n: one.where(F.col("toxic") == value).orderBy(order, "doc_id").limit(n)
    chosen = pick(1, MAX_TOXIC).unionByName(pick(0, MAX_ORDINARY)).select(F.col("doc_id").alias("_id"), F.col("toxic").alias("_toxic"), order.alias("_order"))
    rows = docs.select("doc_id", "text").where(F.octet_length("text").between(1, MAX_BYTES)).join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).groupBy("_id").agg(F.min(F.struct("_toxic", "_order", "text")).alias("x")).select("x.*")
    found = sorted(rows.collect(), key=lambda r: (r["_order"], r["text"]))
    toxic, ordinary = (_within([r["text"] for r in found if r["_toxic"] == v]) for v in (1, 0))
    return toxic, ordinary, shares.get(1, 0) / max(1, sum(shares.values()))


def score(docs: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """docs with score double and predicted int: 1 - 0.7 ** (excess / cut), which is THRESHOLD where a text's excess is at the cut.

    Null and empty texts have score 0, equal texts equal scores; columns of docs with these names are replaced.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = sent.value
        if m["toxic"] is None:
            for s in batches:
                yield pd.Series(np.zeros(len(s)))
            return
        key = hash((m["toxic"], m["ordinary"]))
        if key not in _scorers:
            _scorers.clear()
            _scorers[key] = Distances(m["toxic"], m["ordinary"])
        for s in batches:
            x = np.array([excess(_scorers[key].all(windows(t)), m["least"]) for t in s])
            yield pd.Series(1 - (1 - THRESHOLD) ** (x / m["cut"] * (1 + 1e-12)))

    keep = [c for c in docs.columns if c not in ("score", "predicted")]
    return docs.select(*keep, scored(F.col(text)).alias("score")).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def held_out(doc_id):
    """True for the rows whose labels are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, most_lost: float | None = None) -> DataFrame:
    """docs with held_out, score, predicted; the model is fitted on the labelled rows that aren't held out.

    A row without an id is scored like any other and isn't held out; repeated rows have equal scores; labels without an id, null or
    contradicting labels teach nothing, and an empty table gives no rows. most_lost: see fit.
    """
    model = fit(*sample(docs, labels, ~held_out(F.col("doc_id"))), most_lost)
    return score(docs, model).withColumn("held_out", held_out(F.col("doc_id")))


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return classify(docs, labels).select("doc_id", "held_out", "score", "predicted")
