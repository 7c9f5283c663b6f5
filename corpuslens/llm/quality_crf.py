"""Quality classifier: a linear-chain conditional random field over the lines of a text.

Every line is labelled good or bad from its own features and those of its neighbours; forward-backward marginals,
weighted by line length, are the quality of the text, which a logistic map turns into a probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.llm.common import Words, arrow_map, chunks, key_type, ragged
from corpuslens.llm.langid import remainder

#: Labelled documents learned from, those with the smallest hash of doc_id, half of each label; a documented bound.
SAMPLE = 3000
#: Texts are learned from in runs of so many lines; scoring always takes whole texts.
RUN = 32
#: Lines learned from of a text at most: of a longer one, whole runs at even distances.  Their features come from the whole text.
LINES = 1024
EPOCHS, RATE, DECAY = 100, 0.1, 1e-3
#: Rounds in which line labels are latent, epochs of each, and the share of a text's length that its label claims.
TURNS, TURN_EPOCHS, CLAIM = 2, 30, 0.8
CUT = 0.3

_SETS = {
    "upper": [*range(0x41, 0x5B)],
    "digit": [*range(0x30, 0x3A)],
    "symbol": [ord(c) for c in "#*$%&|<>{}[]\\^~_=@"],
    "shout": [ord("!"), ord("?")],
    "stop": [ord("."), ord(","), ord(";"), ord(":")],
    "wide": [*range(0x80, 0xC0)],
}
#: Upper limits of the bins of each measure.
_BINS = {
    "upper": (0.001, 0.02, 0.06, 0.15, 0.4, 0.7),
    "digit": (0.001, 0.02, 0.1, 0.3),
    "symbol": (0.001, 0.02, 0.08, 0.2, 0.4),
    "shout": (0.001, 0.01, 0.05, 0.15),
    "stop": (0.001, 0.01, 0.03, 0.08),
    "wide": (0.001, 0.02, 0.1),
    "words": (3, 6, 12, 24, 48, 96),
    "length": (3.0, 4.0, 5.0, 6.5, 9.0, 14.0),
    "unique": (0.3, 0.5, 0.7, 0.85, 0.97),
    "copies": (1.5, 2.5, 5.5, 10.5),
    "lines": (1.5, 3.5, 8.5, 20.5, 60.5),
    "repeats": (0.02, 0.1, 0.3, 0.6),
}
_TABLES = {}
for _name, _codes in _SETS.items():
    _TABLES[_name] = np.zeros(256, np.int64)
    _TABLES[_name][_codes] = 1
WIDTH = sum(len(b) + 1 for b in _BINS.values())


@dataclass
class Model:
    weights: np.ndarray  #: (3 * WIDTH + 1,) of the good label: the line, the one before, the one after, the bias
    moves: np.ndarray  #: (2, 2) from label to label
    scale: np.ndarray  #: slope and offset of the logistic map


def line_features(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature columns, text, bytes) of the lines with a word: one column of each measure's bins is set."""
    words = Words(raw, off)
    breaks = np.concatenate([[0], np.cumsum(raw == 0x0A)])
    line = breaks[words.start]
    new = np.ones(len(words), bool)
    new[1:] = (line[1:] != line[:-1]) | (words.doc[1:] != words.doc[:-1])
    first = np.flatnonzero(new)
    n = len(first)
    if not n:
        return np.zeros((0, len(_BINS)), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    size = np.diff(np.append(first, len(words)))
    doc = words.doc[first]
    start, end = words.start[first], words.end[first + size - 1]
    length = end - start
    measure = {}
    for name, table in _TABLES.items():
        total = np.concatenate([[0], np.cumsum(table[raw])])
        measure[name] = (total[end] - total[start]) / length
    measure["words"] = size
    letters = np.add.reduceat(words.end - words.start, first)
    measure["length"] = letters / size
    owner = np.repeat(np.arange(n), size)
    order = np.lexsort((words.hash, owner))
    fresh = np.ones(len(words), bool)
    fresh[1:] = (words.hash[order][1:] != words.hash[order][:-1]) | (owner[order][1:] != owner[order][:-1])
    measure["unique"] = np.bincount(owner[order][fresh], minlength=n) / size
    place = (np.arange(len(words)) - np.repeat(first, size)).astype(np.uint64)
    with np.errstate(over="ignore"):
        whole = np.add.reduceat((words.hash + place) * np.uint64(0x9E3779B97F4A7C15) ^ words.hash >> np.uint64(7), first)
    _, group, copies = np.unique(np.stack([doc.astype(np.uint64), whole], axis=1), axis=0, return_inverse=True, return_counts=True)
    measure["copies"] = copies[group.ravel()]
    in_doc = np.bincount(doc, minlength=len(off) - 1)
    measure["lines"] = in_doc[doc]
    again = np.bincount(doc, weights=measure["copies"] > 1, minlength=len(off) - 1)
    measure["repeats"] = (again / np.maximum(in_doc, 1))[doc]
    columns, base = np.empty((n, len(_BINS)), np.int64), 0
    for j, (name, cuts) in enumerate(_BINS.items()):
        columns[:, j] = base + np.searchsorted(np.array(cuts, float), measure[name], side="right")
        base += len(cuts) + 1
    return columns, doc, length


def _emissions(model: Model, columns: np.ndarray, chain: np.ndarray) -> np.ndarray:
    """Score of the good label of each line; neighbours count inside one chain only."""
    own, before, after = (model.weights[i * WIDTH : (i + 1) * WIDTH][columns].sum(axis=1) for i in range(3))
    score = own + model.weights[-1]
    same = chain[1:] == chain[:-1]
    score[1:] += np.where(same, before[:-1], 0)
    score[:-1] += np.where(same, after[1:], 0)
    return score


def _forward_backward(score: np.ndarray, chain: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals of the good label, expected moves (2, 2), and log normaliser of each chain.

    Chains are laid side by side, longest first, so that one step handles the same place of all chains.
    """
    n_chain = int(chain[-1]) + 1 if len(chain) else 0
    length = np.bincount(chain, minlength=n_chain)
    order = np.argsort(-length, kind="stable")
    start = (np.cumsum(length) - length)[order]
    length = length[order]
    steps = int(length.max()) if n_chain else 0
    alpha, beta = np.zeros((len(chain), 2)), np.zeros((len(chain), 2))
    active = np.searchsorted(-length, -np.arange(1, steps + 1), side="right")
    for t in range(steps):
        at = start[: active[t]] + t
        if t:
            a = alpha[at - 1]
            alpha[at, 0] = np.logaddexp(a[:, 0] + moves[0, 0], a[:, 1] + moves[1, 0])
            alpha[at, 1] = np.logaddexp(a[:, 0] + moves[0, 1], a[:, 1] + moves[1, 1])
        alpha[at, 1] += score[at]
    expected = np.zeros((2, 2))
    norm = np.zeros(n_chain)
    norm[order] = np.logaddexp(*alpha[start + length - 1].T) if n_chain else 0
    for t in range(steps - 2, -1, -1):
        k = active[t + 1]
        at = start[:k] + t
        b0, b1 = beta[at + 1, 0], beta[at + 1, 1] + score[at + 1]
        beta[at, 0] = np.logaddexp(moves[0, 0] + b0, moves[0, 1] + b1)
        beta[at, 1] = np.logaddexp(moves[1, 0] + b0, moves[1, 1] + b1)
        z = norm[order[:k]]
        for i in (0, 1):
            for j, b in ((0, b0), (1, b1)):
                expected[i, j] += np.exp(alpha[at, i] + moves[i, j] + b - z).sum()
    good = np.exp(alpha[:, 1] + beta[:, 1] - norm[chain]) if n_chain else np.zeros(0)
    return np.clip(good, 0, 1), expected, norm


def _gradient(columns: np.ndarray, chain: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """Sum of features weighted by ``rest`` of each line: own, before, after, bias."""
    out = np.zeros(3 * WIDTH + 1)
    same = chain[1:] == chain[:-1]
    w = len(_BINS)
    out[:WIDTH] = np.bincount(columns.ravel(), np.repeat(rest, w), WIDTH)
    out[WIDTH : 2 * WIDTH] = np.bincount(columns[:-1].ravel(), np.repeat(np.where(same, rest[1:], 0), w), WIDTH)
    out[2 * WIDTH : 3 * WIDTH] = np.bincount(columns[1:].ravel(), np.repeat(np.where(same, rest[:-1], 0), w), WIDTH)
    out[-1] = rest.sum()
    return out


def _quality(good: np.ndarray, doc: np.ndarray, length: np.ndarray, n: int) -> np.ndarray:
    """Length-weighted mean of the marginals; 0 for a text without a line."""
    total = np.bincount(doc, length, n)
    return np.bincount(doc, good * length, n) / np.maximum(total, 1)


def _logit(q: np.ndarray) -> np.ndarray:
    q = np.clip(q, 1e-4, 1 - 1e-4)
    return np.log(q / (1 - q))


def _run_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``k, y, place, bytes, columns`` of the lines learned from, LINES of a text at most."""
    for batch in batches:
        for lo, _, raw, off in chunks(batch.column("text")):
            columns, doc, length = line_features(raw, off)
            head = np.flatnonzero(np.diff(doc, prepend=-1))
            count = np.diff(np.append(head, len(doc)))
            place = np.arange(len(doc)) - np.repeat(head, count)
            # run r of n is kept where the wanted number of runs steps on at it
            runs, run, most = np.repeat(-(-count // RUN), count), place // RUN, LINES // RUN
            kept = np.flatnonzero((runs <= most) | ((run + 1) * most // np.maximum(runs, 1) > run * most // np.maximum(runs, 1)))
            owner = pa.array(doc[kept] + lo)
            yield pa.RecordBatch.from_arrays(
                [batch.column("k").take(owner), batch.column("y").take(owner), pa.array(place[kept], pa.int64()), pa.array(length[kept], pa.int64()),
                 ragged(columns[kept].ravel(), np.full(len(kept), len(_BINS)), pa.int16())],
                ["k", "y", "place", "bytes", "columns"],
            )


def fit(columns: np.ndarray, doc: np.ndarray, place: np.ndarray, length: np.ndarray, labels: np.ndarray) -> Model:
    """Maximum likelihood of the chains by Adam, from lines in order of text (0 to n - 1) and place, and the texts' labels.

    At first every line has its document's label.  Then lines are latent: in each turn a text's chain is shifted by one
    offset until the length-weighted share of good lines is at least CLAIM in good texts and at most 1 - CLAIM in bad ones,
    and its marginals and expected moves are the next targets.  So a text may hold lines of both kinds, and the moves learn
    how often the kind changes from line to line.
    """
    model = Model(np.zeros(3 * WIDTH + 1), np.zeros((2, 2)), np.array([1.0, 0.0]))
    if not len(doc) or len(set(labels.tolist())) < 2:
        model.scale = np.array([0.0, _logit(np.array([(labels.sum() + 1) / (len(labels) + 2)]))[0]])
        return model
    broken = (np.diff(doc, prepend=-1) != 0) | (np.diff(place, prepend=-1) != 1)  # lines left out break a chain
    chain = np.cumsum(broken | (place % RUN == 0)) - 1
    y = labels[doc].astype(float)
    y_moves = np.zeros((2, 2))
    inner = chain[1:] == chain[:-1]
    np.add.at(y_moves, (y[:-1][inner].astype(int), y[1:][inner].astype(int)), 1)
    theta, m, v = np.zeros(3 * WIDTH + 5), np.zeros(3 * WIDTH + 5), np.zeros(3 * WIDTH + 5)
    for step in range(1, EPOCHS + TURNS * TURN_EPOCHS + 1):
        if step > EPOCHS and (step - EPOCHS - 1) % TURN_EPOCHS == 0:
            y, y_moves = _latent(_emissions(model, columns, chain), chain, model.moves, doc, length, labels)
        model.weights, model.moves = theta[:-4], theta[-4:].reshape(2, 2)
        good, expected, _ = _forward_backward(_emissions(model, columns, chain), chain, model.moves)
        g = np.concatenate([_gradient(columns, chain, y - good), (y_moves - expected).ravel()]) / len(doc) - DECAY * theta
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta + RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    model.weights, model.moves = theta[:-4].copy(), theta[-4:].reshape(2, 2).copy()
    n = len(labels)
    whole = np.cumsum(broken) - 1
    good, _, _ = _forward_backward(_emissions(model, columns, whole), whole, model.moves)
    x, t = _logit(_quality(good, doc, length, n)), labels.astype(float)
    some = np.bincount(doc, minlength=n) > 0
    a, b = 1.0, 0.0
    for _ in range(500):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        err = (t - p) * some
        a, b = max(0.05, a + 0.05 * ((err * x).mean() - 0.01 * (a - 1))), b + 0.2 * err.mean()
    model.scale = np.array([a, b])
    return model


def _latent(score: np.ndarray, chain: np.ndarray, moves: np.ndarray, doc: np.ndarray, length: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals and expected moves of chains shifted until each text's share of good lines fits its label."""
    low, high = np.where(labels == 1, 0.0, -20.0), np.where(labels == 1, 20.0, 0.0)
    good, _, _ = _forward_backward(score, chain, moves)
    share = _quality(good, doc, length, len(labels))
    fits = np.where(labels == 1, share >= CLAIM, share <= 1 - CLAIM)
    low, high = np.where(fits, 0.0, low), np.where(fits, 0.0, high)
    for _ in range(12):
        shift = (low + high) / 2
        good, _, _ = _forward_backward(score + shift[doc], chain, moves)
        above = _quality(good, doc, length, len(labels)) > np.where(labels == 1, CLAIM, 1 - CLAIM)
        low, high = np.where(above, low, shift), np.where(above, shift, high)
    good, expected, _ = _forward_backward(score + ((low + high) / 2)[doc], chain, moves)
    return good, expected


def train(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality") -> Model:
    """A model from labelled rows whose fold is not 0.

    Features of SAMPLE texts and of LINES lines each at most come to the driver, half of the texts of each label if there are
    so many; a doc_id with several labels takes the smallest, one with several texts the smallest text.  Rows without label,
    text or doc_id are left out, and texts without a word; none is left out for its length.
    """
    given = labels.where(F.col(label).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.min(label).cast("int").alias("y"))
    given = given.where(F.col("k").isNotNull() & (remainder(F.col("k")) != 0))
    nth = F.row_number().over(Window.partitionBy("y").orderBy(F.xxhash64("k"), "k"))
    picked = given.withColumn("nth", nth).where(F.col("nth") <= SAMPLE // 2).select("k", "y")
    rows = docs.select(F.col(key).alias("doc_key"), F.col(text).cast("string").alias("text")).where("text is not null")
    rows = rows.join(F.broadcast(picked), rows.doc_key == picked.k).groupBy("k").agg(F.min("text").alias("text"), F.first("y").alias("y"))
    lines = rows.transform(arrow_map, _run_lines, f"k {key_type(docs, key)}, y int, place long, bytes long, columns array<short>")
    found = lines.orderBy("k", "place").toArrow()  # SAMPLE * LINES rows of small numbers
    columns = found["columns"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, len(_BINS))
    k = found["k"].to_numpy()
    heads = np.append(np.ones(min(len(k), 1), bool), k[1:] != k[:-1])
    return fit(columns, np.cumsum(heads) - 1, found["place"].to_numpy(), found["bytes"].to_numpy(), found["y"].to_numpy()[heads].astype(np.int64))


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, raw, off in chunks(batch.column("text")):
                columns, doc, length = line_features(raw, off)
                q = np.zeros(hi - lo)
                if len(doc):
                    chain = np.cumsum(np.diff(doc, prepend=-1) != 0) - 1
                    good, _, _ = _forward_backward(_emissions(model, columns, chain), chain, model.moves)
                    q = _quality(good, doc, length, hi - lo)
                p = 1 / (1 + np.exp(-np.clip(model.scale[0] * _logit(q) + model.scale[1], -30, 30)))
                p = np.where(np.bincount(doc, minlength=hi - lo) > 0, p, 0.0)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(p)], ["doc_id", "score"])

    return run


def score_documents(docs: DataFrame, model: Model, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row.

    A null text or one without a word has score 0; repeated rows are scored each; without labels of both kinds the
    score is the same for all; an empty table gives no rows; other columns are ignored.  One pass, no shuffle.
    """
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"))
    out = rows.transform(arrow_map, _score(model), f"doc_id {key_type(docs, key)}, score double")
    held = F.coalesce(remainder(F.col("doc_id")) == 0, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
