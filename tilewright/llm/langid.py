"""Language of whole texts by a bidirectional gated recurrent network over bytes.

The network reads a text's UTF-8 bytes in windows of 64, forwards and backwards
(its state starts anew in each, so a text's windows run side by side), and gives every position a probability for each language; a document's probabilities
are the mean over its letters.  It is trained here, in numpy, by backpropagation
through time, on a bounded sample of labelled rows.  Whole texts are labelled on
the executors, many windows at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tilewright.llm.common import saved, slices
from tilewright.llm.shingles import string_bytes

#: Training rows per language and in all at most (one of each language always), and characters of each that are used.
SAMPLE_ROWS, SAMPLE_TOTAL, SAMPLE_CHARS = 400, 80_000, 600
#: Languages whose shares may be broadcast, checked by a count.
MOST_BROADCAST = 10_000
UNKNOWN = "und"
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def _by_byte(windows: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Sums of rows by the byte at their position."""
    flat = windows.reshape(-1)
    order = np.argsort(flat, kind="stable")
    found, first = np.unique(flat[order], return_index=True)
    out = np.zeros((256, rows.shape[1]), np.float32)
    out[found] = np.add.reduceat(rows[order], first)
    return out


@dataclass
class Network:
    """Parameters by name: per direction d in "fb" the byte table x_d (256, 3h),
    the recurrence u_d (h, 3h) and the output o_d (h, k); bias c (k)."""

    languages: list[str]
    p: dict[str, np.ndarray]

    @property
    def hidden(self) -> int:
        return self.p["u_f"].shape[0]

    def states(self, d: str, windows: np.ndarray, keep: bool = False):
        """Hidden states of one direction, time first; windows is (time, n) bytes."""
        h, (steps, n) = self.hidden, windows.shape
        table, u = self.p[f"x_{d}"], self.p[f"u_{d}"]
        out = np.zeros((steps + 1, n, h), np.float32)
        saved = []
        order = range(steps) if d == "f" else range(steps - 1, -1, -1)
        state = out[0]
        for k, t in enumerate(order):
            x, r = table[windows[t]], state @ u
            gates = x[:, : 2 * h] + r[:, : 2 * h]
            gates *= 0.25
            gates += 0.5
            np.clip(gates, 0, 1, out=gates)
            new = np.tanh(x[:, 2 * h :] + gates[:, h:] * r[:, 2 * h :])
            z = gates[:, :h]
            if keep:
                saved.append((t, state, gates, r[:, 2 * h :], new))
            state = out[k + 1]
            np.multiply(z, (out[k] - new), out=state)
            state += new
        return out[1:], saved

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        """(languages, time, n) probabilities of every position of (time, n) bytes.

        The same recurrence as in :meth:`states`, with one table for each gate so
        that all arrays are contiguous, and the gates' slope and offset folded in."""
        h, (steps, n) = self.hidden, windows.shape
        logits = np.zeros((len(self.languages), steps * n), np.float32)
        z, r, new = (np.empty((n, h), np.float32) for _ in range(3))
        out = np.empty((steps, n, h), np.float32)
        for d in "fb":
            table, u = self.p[f"x_{d}"], self.p[f"u_{d}"]
            tz, tr, tn = (np.ascontiguousarray(table[:, k * h : (k + 1) * h]) for k in range(3))
            uz, ur, un = (np.ascontiguousarray(u[:, k * h : (k + 1) * h]) for k in range(3))
            tz, tr, uz, ur = 0.25 * tz + 0.5, 0.25 * tr + 0.5, 0.25 * uz, 0.25 * ur
            state = np.zeros((n, h), np.float32)
            for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
                byte = windows[t]
                np.take(tz, byte, axis=0, out=z, mode="clip")
                z += state @ uz
                np.clip(z, 0, 1, out=z)
                np.take(tr, byte, axis=0, out=r, mode="clip")
                r += state @ ur
                np.clip(r, 0, 1, out=r)
                np.take(tn, byte, axis=0, out=new, mode="clip")
                r *= state @ un
                new += r
                np.tanh(new, out=new)
                z *= state - new
                state = out[t]
                np.add(z, new, out=state)
            logits += self.p[f"o_{d}"].T @ out.reshape(-1, h).T
        logits += self.p["c"][:, None]
        logits -= logits.max(axis=0)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=0)
        return logits.reshape(-1, steps, n)

    def gradients(self, windows: np.ndarray, target: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over positions and its gradients, through time."""
        steps, n = windows.shape
        h, k = self.hidden, len(self.languages)
        runs = {d: self.states(d, windows, keep=True) for d in "fb"}
        hidden = {"f": runs["f"][0], "b": runs["b"][0][::-1]}  # by position
        logits = sum(hidden[d].reshape(-1, h) @ self.p[f"o_{d}"] for d in "fb").reshape(steps, n, k) + self.p["c"]
        logits -= logits.max(axis=2, keepdims=True)
        prob = np.exp(logits)
        prob /= prob.sum(axis=2, keepdims=True)
        loss = -np.log(prob[:, np.arange(n), target] + 1e-9).mean()
        prob[:, np.arange(n), target] -= 1
        prob /= steps * n
        flat = prob.reshape(-1, k)
        g = {"c": flat.sum(axis=0)}
        for d in "fb":
            g[f"o_{d}"] = hidden[d].reshape(-1, h).T @ flat
            into = (flat @ self.p[f"o_{d}"].T).reshape(steps, n, h)
            u = self.p[f"u_{d}"]
            gu, inputs = np.zeros_like(u), np.empty((steps, n, 3 * h), np.float32)
            back = np.zeros((n, h), np.float32)
            for t, before, gates, rn, new in reversed(runs[d][1]):
                z, r = gates[:, :h], gates[:, h:]
                dh = into[t] + back
                da = dh * (1 - z) * (1 - new * new)
                dgates = np.concatenate((dh * (before - new), da * rn), axis=1) * (0.25 * ((gates > 0) & (gates < 1)))
                dx = np.concatenate((dgates, da), axis=1)
                dr = np.concatenate((dgates, da * r), axis=1)
                gu += before.T @ dr
                inputs[t] = dx
                back = dh * z + dr @ u.T
            g[f"u_{d}"], g[f"x_{d}"] = gu, _by_byte(windows, inputs.reshape(-1, 3 * h))
        return float(loss), g


def new_network(languages: list[str], hidden: int, seed: int = 11) -> Network:
    r = np.random.default_rng(seed)
    p = {"c": np.zeros(len(languages))}
    for d in "fb":
        p[f"x_{d}"] = r.normal(0, 0.3, (256, 3 * hidden))
        p[f"u_{d}"] = np.hstack([np.linalg.qr(r.normal(size=(hidden, hidden)))[0] for _ in range(3)])
        p[f"o_{d}"] = r.normal(0, 0.3, (hidden, len(languages)))
    return Network(languages, {k: v.astype(np.float32) for k, v in p.items()})


def train(texts: list[str], labels: list[str], hidden: int | None = None, window: int = 48, batch: int = 128, steps: int | None = None, rate: float = 0.02, seed: int = 11) -> Network | None:
    """Fits a network to labelled snippets with Adam; None without any.  Hidden
    units and steps grow with the number of languages unless they are given."""
    raw = [np.frombuffer(t.encode(), np.uint8) for t in texts]
    usable = [k for k, t in enumerate(raw) if _LETTER[t].any()]
    if not usable:
        return None
    languages = sorted({labels[k] for k in usable})
    hidden = hidden or min(64, 8 + max(0, len(languages) - 8) // 2)
    steps = steps or 300 + 30 * max(0, len(languages) - 8)
    of = [np.array([k for k in usable if labels[k] == name]) for name in languages]
    net, r = new_network(languages, hidden, seed), np.random.default_rng(seed)
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    v2 = {k: np.zeros_like(v) for k, v in net.p.items()}
    for step in range(1, steps + 1):
        target = r.integers(0, len(languages), batch)
        windows = np.full((batch, window), 32, np.uint8)
        for row, y in enumerate(target):
            text = raw[r.choice(of[y])]
            at = r.integers(0, max(len(text) - window, 0) + 1)
            part = text[at : at + window]
            windows[row, : len(part)] = part
        _, g = net.gradients(windows.T.copy(), target)
        size = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
        now = rate * min(1, 4 * (1 - step / (steps + 1)))
        for k, x in g.items():
            x = x * min(1, 1 / (size + 1e-12))
            m[k] = 0.9 * m[k] + 0.1 * x
            v2[k] = 0.99 * v2[k] + 0.01 * x * x
            net.p[k] -= (now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v2[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def label_bytes(net: Network, raw: np.ndarray, at: np.ndarray, window: int = 64, at_once: int = 4096) -> np.ndarray:
    """Mean probabilities over the letters of each row; (rows, languages)."""
    n = np.diff(at)
    pieces = -(-n // window)
    owner = np.repeat(np.arange(len(n)), pieces)
    first = np.repeat(at[:-1], pieces) + window * (np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    stop = np.repeat(at[1:], pieces)
    k = len(net.languages)
    total, letters = np.zeros((len(n), k)), np.zeros(len(n))
    steps = np.arange(window)[:, None]
    for lo in range(0, len(owner), at_once):
        where = first[lo : lo + at_once] + steps
        inside = where < stop[lo : lo + at_once]
        windows = np.where(inside, raw[np.minimum(where, len(raw) - 1)], np.uint8(32)).astype(np.intp)
        weight = _LETTER[windows] & inside
        prob = net.probabilities(windows)
        prob *= weight
        rows = owner[lo : lo + at_once]
        base = rows[0]
        for j, each in enumerate(prob.sum(axis=1)):
            got = np.bincount(rows - base, each)
            total[base : base + len(got), j] += got
        got = np.bincount(rows - base, weight.sum(axis=0))
        letters[base : base + len(got)] += got
    return total / np.maximum(letters, 1)[:, None]


def training_sample(docs: DataFrame) -> tuple[list[str], list[str]]:
    """At most SAMPLE_ROWS snippets of SAMPLE_CHARS characters of each language, fewer
    where SAMPLE_TOTAL is reached, from rows that aren't held out: rows by the hash
    of doc_id, snippets from anywhere in the text.  The bounds are parameters, not
    shares of the input, and no language is left out."""
    rows = docs.where("lang is not null and text is not null and doc_id is not null and length(text) > 0").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    top = 1 << 40
    key = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(top))
    at = F.pmod(F.xxhash64("doc_id", F.lit(8)), F.greatest(F.length("text") - SAMPLE_CHARS, F.lit(0)) + 1).cast("int") + 1
    # a share of each language first, so that what is sorted doesn't grow with the number of tasks
    counts = saved(rows.groupBy("lang").count(), "language-counts")
    languages = counts.count()
    each = max(1, min(SAMPLE_ROWS, SAMPLE_TOTAL // max(languages, 1)))
    share = counts.select("lang", F.least(F.lit(float(top)), (4.0 * each + 40) / F.col("count") * top).alias("below"))
    rows = rows.withColumn("key", key).join(F.broadcast(share) if languages <= MOST_BROADCAST else share, "lang").where("key < below")
    rows = rows.select("lang", "doc_id", "key", F.substring(F.col("text"), at, F.lit(SAMPLE_CHARS)).alias("snippet"))
    first = Window.partitionBy("lang").orderBy("key", "doc_id", "snippet")
    chosen = rows.withColumn("k", F.row_number().over(first)).where(F.col("k") <= each)
    found = chosen.select("lang", "snippet").orderBy("k", "lang").collect()
    return [r["snippet"] for r in found], [r["lang"] for r in found]


SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"


def predict(docs: DataFrame, net: Network | None) -> DataFrame:
    """Predictions from the text alone.  ``und`` with score 0 where the text is
    null or has no letter, and where nothing was learned."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column(2)
            known = np.array([t is not None and any(map(str.isalpha, t)) for t in texts.to_pylist()], bool)
            names, score = np.full(len(known), UNKNOWN, object), np.zeros(len(known))
            if net is not None and known.any():
                raw, at = string_bytes(texts)
                prob = label_bytes(net, raw, at)
                names[known] = np.array(net.languages, object)[prob.argmax(axis=1)][known]
                score[known] = np.clip(prob.max(axis=1), 0, 1)[known]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])

    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return docs.select("doc_id", held_out.alias("held_out"), "text").mapInArrow(run, SCHEMA)


def identify(docs: DataFrame) -> DataFrame:
    """Trains on the rows of ``docs`` that aren't held out, and predicts for all.

    A null doc_id is never held out nor trained on; rows are predicted one by
    one, so repeated rows agree; an empty table gives no rows; further columns
    play no part."""
    return predict(docs, train(*training_sample(docs)))


def keep_known(docs: DataFrame, least: float | None = None) -> DataFrame:
    """The documents whose language is known with a score of ``least`` at least;
    all columns stay.  Texts that are null or have no letter go.  Unless given,
    ``least`` is 1.6 times what each language would get by chance, 0.4 at most.

    Repeated rows are judged alike; an empty table stays empty; columns may have
    any names."""
    net = train(*training_sample(docs))
    if least is None:
        least = min(0.4, 1.6 / len(net.languages)) if net else 0.4

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        known = texts.map(lambda t: t is not None and any(map(str.isalpha, t))).to_numpy(bool)
        if net is None:
            return pd.Series(known.astype(float))
        raw, at = string_bytes(pa.array(texts, pa.string(), from_pandas=True))
        return pd.Series(np.where(known, label_bytes(net, raw, at).max(axis=1), 0.0) if len(known) else np.empty(0))

    return docs.where(score("text") >= least)
