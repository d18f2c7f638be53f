"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on windows of toxic and one on windows of
ordinary texts, and each window of `window` words of a text is compressed with either.
A window's gain is what the toxic dictionary saves against the ordinary one.

1. Both dictionaries start with one trained on all ordinary windows of the sample, so that
   lengths differ only by what follows: bytes trained on windows of the own class.
2. Most windows of a toxic text are ordinary. So the toxic part is trained in rounds: the
   toxic rows are dealt into parts, windows of a part get their gains from a dictionary
   trained on the other parts, and the next round trains on those windows that gained
   `KEEP` bytes or more. What only one text holds gains nothing from the others' dictionary.
3. Thresholds on gains are calibrated by rows that the dictionaries haven't seen: for each
   threshold the share of ordinary windows that pass it, and a logistic regression on how
   far a text's windows exceed those shares. `FOLDS` pairs of dictionaries are trained, each
   without a fold that calibrates it; the pair that tells its fold's labels best is used.

A window is followed by a tail that both dictionaries hold: the compressor searches no
matches in the last bytes of its input, and stores input that hardly shrinks as it is.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard as zs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm import common

WINDOW = 2
#: Thresholds on a window's gain in bytes.
GAINS = (3, 4, 5, 6, 7)
SHARED_BYTES, OWN_BYTES = 65536, 4096
ROUNDS, PARTS, KEEP, FOLDS = 4, 4, 4, 3
#: Bytes of a segment of the own part, and of the pieces whose frequencies choose it.
SEGMENT, PIECE = 32, 6
#: Of ordinary rows that a model hasn't seen, the share that `cutoff` keeps.
CLEAN = 0.985
TAIL = bytes(range(128, 192))
#: Bounds of the labelled rows that a model is fitted on.
TOXIC_ROWS, ORDINARY_ROWS, SAMPLE_CHARS = 2000, 2000, 16_000_000
BLOCK = 50_000
KNOWN = 300_000


def _params() -> zs.ZstdCompressionParameters:
    return zs.ZstdCompressionParameters(window_log=18, hash_log=17, chain_log=17, search_log=4, min_match=4, target_length=32, strategy=zs.STRATEGY_LAZY2, write_content_size=0, write_checksum=0, write_dict_id=0, format=zs.FORMAT_ZSTD1_MAGICLESS)


def _compressor(content: bytes) -> zs.ZstdCompressor:
    own = zs.ZstdCompressionDict(content + TAIL, dict_type=zs.DICT_TYPE_RAWCONTENT)
    own.precompute_compress(compression_params=_params())
    return zs.ZstdCompressor(dict_data=own, compression_params=_params())


def _lengths(packer: zs.ZstdCompressor, windows: list[bytes]) -> np.ndarray:
    out = np.zeros(len(windows), np.int32)
    for at in range(0, len(windows), BLOCK):
        packed = packer.multi_compress_to_buffer([w + TAIL for w in windows[at : at + BLOCK]])
        out[at : at + BLOCK] = np.fromiter(map(len, packed), np.int32, len(packed))
    return out


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def windows_of(words: list[bytes], window: int = WINDOW) -> list[bytes]:
    if window == 2:
        both = [b" %b %b " % x for x in zip(words[::2], words[1::2], strict=False)]
        return both + [b" " + words[-1] + b" "] if len(words) % 2 else both
    return [b" " + b" ".join(words[i : i + window]) + b" " for i in range(0, len(words), window)]


def _train(size: int, samples: list[bytes], **how) -> bytes:
    """A trained dictionary, or the samples themselves where they are too few to train one."""
    try:
        return zs.train_dictionary(size, samples, **how).as_bytes()
    except zs.ZstdError:
        return b"".join(dict.fromkeys(samples))[-size:]


@dataclass
class Model:
    """shares: of ordinary windows that reach each of GAINS. cutoff: the score that the share CLEAN of unseen ordinary rows is below."""

    toxic: bytes
    ordinary: bytes
    window: int = WINDOW
    shares: np.ndarray = field(default_factory=lambda: np.full(len(GAINS), 0.01))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(len(GAINS) + 2))
    cutoff: float = 0.5
    _packers: tuple | None = None
    _gains: dict[bytes, int] = field(default_factory=dict)

    def __getstate__(self):
        return self.__dict__ | {"_packers": None, "_gains": {}}

    def gains(self, windows: list[bytes]) -> np.ndarray:
        """Of each window. Equal ones are compressed once while the table of them holds at most KNOWN."""
        if self._packers is None:
            self._packers = _compressor(self.ordinary), _compressor(self.toxic)
        if len(self._gains) > KNOWN:
            self._gains = {}
        new = [x for x in dict.fromkeys(windows) if x not in self._gains]
        self._gains |= zip(new, (_lengths(self._packers[0], new) - _lengths(self._packers[1], new)).tolist(), strict=True)
        return np.fromiter(map(self._gains.__getitem__, windows), np.int64, len(windows))

    def reached(self, texts: list[list[bytes]]) -> np.ndarray:
        """A row for each text, of all its windows: how many reach each of GAINS, and how many there are."""
        each = [windows_of(w, self.window) for w in texts]
        size = np.array([len(w) for w in each], np.int64)
        flat = [x for w in each for x in w]
        gain = self.gains(flat)
        text = np.repeat(np.arange(len(texts)), size)
        return np.stack([*(np.bincount(text[gain >= k], minlength=len(texts)) for k in GAINS), size], axis=1).astype(float)

    def features(self, reached: np.ndarray) -> np.ndarray:
        n = reached[:, -1:]
        return np.c_[np.log((reached[:, :-1] + 0.5) / (n * self.shares + 0.5)), np.log(n + 3), np.ones(len(reached))]

    def score(self, texts: list[list[bytes]]) -> np.ndarray:
        return _chance(self.features(self.reached(texts)) @ self.weights)


def _chance(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def dictionaries(toxic: list[list[bytes]], ordinary: list[list[bytes]], window: int = WINDOW) -> Model:
    """A model without thresholds, of rows of words."""
    usual = list(dict.fromkeys(x for w in ordinary for x in windows_of(w, window)))
    part: dict[bytes, int] = {}  # of each window's first row
    for i, w in enumerate(toxic):
        for x in windows_of(w, window):
            part.setdefault(x, i % PARTS)
    rows, parts = list(part), np.array(list(part.values()), np.int64)
    shared = _train(SHARED_BYTES, usual)
    some = np.random.default_rng(0).permutation(len(usual))[: len(rows)]
    full = lambda samples: shared + _train(OWN_BYTES, samples, k=SEGMENT, d=PIECE).rjust(OWN_BYTES)
    plain = full([usual[i] for i in some])
    base = _lengths(_compressor(plain), rows)
    kept = np.ones(len(rows), bool)
    for _ in range(ROUNDS):
        gain = np.zeros(len(rows), np.int64)
        for p in range(PARTS):
            mine = np.flatnonzero(parts == p)
            own = full([rows[i] for i in np.flatnonzero(kept & (parts != p))])
            gain[mine] = base[mine] - _lengths(_compressor(own), [rows[i] for i in mine])
        kept = gain >= KEEP
    return Model(full([rows[i] for i in np.flatnonzero(kept)]), plain, window)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Newton's method; the last column is the constant, which isn't shrunk."""
    mean, spread = x[:, :-1].mean(0), x[:, :-1].std(0) + 1e-6
    z = np.c_[(x[:, :-1] - mean) / spread, np.ones(len(x))]
    pull = np.diag([ridge] * (z.shape[1] - 1) + [1e-6])
    w = np.zeros(z.shape[1])
    for _ in range(50):
        p = _chance(z @ w)
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + pull, z.T @ (p - y) + pull @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return np.r_[w[:-1] / spread, w[-1] - (w[:-1] * mean / spread).sum()]


def fit(texts: list[str | None], toxic: list[int], share: float | None = None, window: int = WINDOW) -> Model:
    """A model of rows (text, 0 or 1). share: of toxic rows where the sample comes from, if it isn't the sample's.

    Without rows of both labels all texts get one score: near 1 for toxic rows alone, else
    near 0. Of labels all but 1 count as 0; repeated rows count each; texts may be null or empty.
    """
    rows, y = [_words(t) for t in texts], np.array([t == 1 for t in toxic], float)
    split = [[w for w, t in zip(rows, y, strict=True) if t == k] for k in (1, 0)]
    if not (split[0] and split[1]):
        model = Model(b"", b"", window)
        model.weights[-1] = 4.0 if split[0] else -4.0
        return model
    fold = np.zeros(len(rows), np.int64)
    for k in (1, 0):  # dealt within each label
        own = np.flatnonzero(y == k)
        fold[own] = np.arange(len(own)) % FOLDS
    found = []
    for f in range(FOLDS):
        seen = [[w for w, t, g in zip(rows, y, fold, strict=True) if t == k and g != f] for k in (1, 0)]
        if all(seen) and len(set(y[fold == f])) == 2:
            found.append(_calibrated(dictionaries(*seen, window), [w for w, g in zip(rows, fold, strict=True) if g == f], y[fold == f]))
    if not found:  # too few rows to hold some back
        found.append(_calibrated(dictionaries(*split, window), rows, y))
    model = min(found, key=lambda x: x[0])[1]
    if share and share < 1:  # the sample has its own share of toxic rows
        move = np.log(share / (1 - share)) - np.log(y.mean() / (1 - y.mean()))
        model.weights[-1] += move
        model.cutoff = float(_chance(np.log(model.cutoff / (1 - model.cutoff)) + move))
    return model


def _calibrated(model: Model, rows: list[list[bytes]], y: np.ndarray) -> tuple[float, Model]:
    """The model with thresholds from rows that its dictionaries haven't seen, and how it does there: labels' mean log loss, each label weighing as much as the other."""
    reached = model.reached(rows)
    clean = reached[y == 0].sum(0)
    model.shares = (clean[:-1] + 0.5) / (clean[-1] + 1)
    x = model.features(reached)
    model.weights = _logistic(x, y)
    p = np.clip(_chance(x @ model.weights), 1e-6, 1 - 1e-6)
    model.cutoff = float(np.quantile(p[y == 0], CLEAN))
    return -(np.log(p[y == 1]).mean() + np.log(1 - p[y == 0]).mean()), model


def sample(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> tuple[list[str], list[int], float]:
    """Labelled rows to fit on, and the share of toxic ones among all that could be.

    Rows come by hash of the key, TOXIC_ROWS and ORDINARY_ROWS at most, and of those as many
    as hold SAMPLE_CHARS characters together; held-out folds aren't among them. A key with
    several labels counts as toxic if one is 1, and one with several texts has the least;
    null keys, null texts and labels other than 0 and 1 are left out.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull() & (common.fold(key, 4) != 2)).select(key, F.col(label).cast("int").alias("_toxic"))
    known = known.groupBy(key).agg(F.max("_toxic").alias("_toxic"))
    n, ones = known.agg(F.count("*"), F.coalesce(F.sum("_toxic"), F.lit(0))).first()
    order = F.xxhash64(F.col(key).cast("string"), F.lit(3))
    picked = known.where("_toxic = 1").orderBy(order, key).limit(TOXIC_ROWS).unionByName(known.where("_toxic = 0").orderBy(order, key).limit(ORDINARY_ROWS))
    rows = docs.where(F.col(text).isNotNull()).select(key, F.col(text).alias("_text")).join(F.broadcast(picked), key)  # at most TOXIC_ROWS + ORDINARY_ROWS small rows
    rows = common.spool(rows.groupBy(key).agg(F.max("_toxic").alias("_toxic"), F.min("_text").alias("_text")).withColumn("_order", order), "toxicity-sample")
    sofar = F.sum(F.length("_text")).over(Window.orderBy("_order", key).rowsBetween(Window.unboundedPreceding, 0))  # over the sample's lengths
    room = rows.select(key, sofar.alias("_sofar")).where(F.col("_sofar") <= SAMPLE_CHARS).select(key)
    texts, toxic = [], []
    for r in rows.join(F.broadcast(room), key).orderBy("_order", key).select("_text", "_toxic").toLocalIterator():  # SAMPLE_CHARS at most
        texts.append(r["_text"])
        toxic.append(r["_toxic"])
    return texts, toxic, ones / max(1, n)


def classify(docs: DataFrame, model: Model, threshold: float = 0.3, key: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Rows (key, *carry, score, predicted), one for each row of docs; whole texts.

    Null texts count as empty, and texts without words get the score of no windows.
    Repeated rows get equal scores; other columns of docs are ignored; an empty table
    gives an empty one. predicted: 1 where score >= threshold.
    """
    rows = docs.select(F.col(text).alias("_text"), F.col(key), *carry)
    schema = T.StructType([*rows.schema.fields[1:], T.StructField("score", T.DoubleType())])
    sent = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of SHARED_BYTES + OWN_BYTES

    def run(batches):
        own = sent.value
        for b in batches:
            scores: list[float] = []
            held, chars = [], 0
            for t in b.column(0):
                held.append(_words(t.as_py()))
                chars += sum(map(len, held[-1]))
                if chars > 2_000_000:
                    scores += own.score(held).tolist()
                    held, chars = [], 0
            scores += own.score(held).tolist() if held else []
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(scores, pa.float64())], schema.fieldNames())

    return rows.mapInArrow(run, schema).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    model = fit(*sample(docs, common.table(spark, sf_dir, "labels")))
    return classify(docs, model).select("doc_id", (common.fold("doc_id", 4) == 2).alias("held_out"), "score", "predicted")


QUERIES = {"op3_toxicity": op3_toxicity}
ORACLES: dict[str, str] = {}
