"""Language of whole texts: averaged hashed subword embeddings, linear softmax.

Features are the character n-grams (on UTF-8 bytes, A-Z lower-cased, each run
of ASCII that is no letter taken as one blank) of SIZES bytes, hashed into
``buckets`` rows of an embedding table. A text is the mean of its rows, and a
linear layer with softmax gives the languages. Both layers are trained by
stochastic gradient descent in numpy on the driver, on a bounded sample of
labelled documents (``rows_per_label`` for each label, by a fixed hash of the
id; whole texts, and a short stretch of each so that short texts are learned
too). For scoring the two layers are multiplied into one table of
buckets x labels, which has a fixed size and goes to every task.

Calibration uses a second sample of labelled documents, disjoint from the
first: a temperature is fitted to their log loss, and the rejection threshold
is ``margin`` times the lowest score of those predicted rightly, at most
``most_threshold``, so that clean documents stay.

The number of n-grams is not bounded: every text is read whole, in steps.

Edge cases: null text, or a text without a letter, is ``und`` with score 0 and
rejected; ties between languages go to the first in alphabetical order;
without labelled documents everything is ``und`` and nothing with a letter is
rejected; rows repeating a doc_id are
predicted one by one; a null doc_id belongs to the training fold if labelled
(crc32 of null is null, which is not 1) but never to the sample.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelwright.llm.common import _LOWER, arrow_map, crc_third, read, small_batches, steps
from panelwright.llm.registry import query

SIZES = (2, 3, 4)
_LETTERS = np.zeros(256, bool)
_LETTERS[0x61:0x7B] = _LETTERS[0x80:] = True
_BLANK = np.uint8(0x20)


def grams(texts: list[str], buckets: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per n-gram size: hashed n-grams of texts, and where each text's begin (one more at the end)."""
    raw = [b" " + (t or "").encode("utf-8", "surrogatepass") + b" " for t in texts]
    edge = np.cumsum([0, *map(len, raw)])
    buf = _LOWER[np.frombuffer(b"".join(raw), np.uint8)]
    letter = _LETTERS[buf]
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # one blank after a run of letters
    keep[edge[:-1]] = True  # and one before the first
    begin = np.concatenate([[0], np.cumsum(keep)])[edge]
    code = np.where(letter, buf, _BLANK)[keep].astype(np.uint32)
    out, run = [], code
    for n in range(2, max(SIZES) + 1):
        run = (run[:-1] << np.uint32(8)) | code[n - 1 :]
        if n in SIZES:
            inside = np.ones(len(code), bool)  # n-grams that do not run into the next text
            for k in range(1, n):
                inside[np.maximum(begin[1:] - k, 0)] = False
            inside = inside[: len(run)]
            hashed = (run * np.uint32(2654435761) + np.uint32(n * 40503)) >> np.uint32(7)
            out.append(((hashed % np.uint32(buckets))[inside].astype(np.int64), np.concatenate([[0], np.cumsum(inside)])[np.minimum(begin, len(run))]))
    return out


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


@dataclass
class Model:
    """labels (sorted), table: buckets x labels, bias, temperature, threshold."""

    labels: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def logits(self, texts: list[str]) -> np.ndarray:
        out, total = np.zeros((len(texts), len(self.labels))), np.zeros(len(texts))
        for g, begin in grams(texts, len(self.table)):
            n = np.diff(begin)
            full = np.flatnonzero(n)
            total += n
            if len(full):
                out[full] += np.add.reduceat(self.table[g], begin[full], axis=0)
        return out / np.maximum(total, 1)[:, None] + self.bias

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
        """Language, score and whether it is accepted."""
        names, scores = ["und"] * len(texts), [0.0] * len(texts)
        accepted = [has_letter(t) for t in texts]  # all of them if nothing could be learned
        usable = [i for i, ok in enumerate(accepted) if ok and self.labels]
        own = [texts[i] for i in usable]
        for a, b in steps(own):
            z = self.logits(own[a:b]) / self.temperature
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            best = p.argmax(1)
            for i, k, row in zip(usable[a:b], best.tolist(), p):
                names[i], scores[i] = self.labels[k], float(row[k])
                accepted[i] = scores[i] >= self.threshold
        return names, scores, accepted


def _sgd(texts, labels, n_labels, buckets, size, epochs, rate, seed):
    """Embeddings and linear layer by minibatch descent over unique (text, n-gram) counts."""
    rng = np.random.default_rng(seed)
    rows = []
    for t in texts:
        u, n = np.unique(np.concatenate([g for g, _ in grams([t], buckets)]), return_counts=True)
        rows.append((u, (n / max(1, n.sum())).astype(np.float32)))
    table = rng.normal(0, 1 / size, (buckets, size)).astype(np.float32)
    weight, bias = np.zeros((size, n_labels), np.float32), np.zeros(n_labels, np.float32)
    labels = np.asarray(labels)
    total, done, batch = epochs * len(rows), 0, 16
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for x in range(0, len(order), batch):
            some = [i for i in order[x : x + batch] if len(rows[i][0])]
            if not some:
                continue
            at = np.concatenate([rows[i][0] for i in some])
            share = np.concatenate([rows[i][1] for i in some])[:, None]
            edge = np.cumsum([0, *(len(rows[i][0]) for i in some)])
            mean = np.add.reduceat(table[at] * share, edge[:-1])
            z = mean @ weight + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(some)), labels[some]] -= 1
            step = rate * (1 - done / total)
            back = np.repeat(p @ weight.T, np.diff(edge), 0) * share
            by = np.argsort(at, kind="stable")
            first = np.flatnonzero(np.diff(at[by], prepend=-1))
            table[at[by][first]] -= step * np.add.reduceat(back[by], first)
            weight -= step * (mean.T @ p) / len(some)
            bias -= step * p.mean(0)
            done += len(some)
    return table @ weight, bias


def fit(labelled: DataFrame, rows_per_label: int = 400, buckets: int = 1 << 16, size: int = 8, epochs: int = 6, rate: float = 3.0, seed: int = 7, margin: float = 0.8, most_threshold: float = 0.4) -> Model:
    """Train and calibrate on (doc_id, text, lang); samples 1.5 x rows_per_label rows a label."""
    usable = labelled.where("doc_id IS NOT NULL AND text IS NOT NULL AND lang IS NOT NULL")
    by_hash = W.partitionBy("lang").orderBy(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)), "doc_id")
    take = rows_per_label + rows_per_label // 2
    # ids alone are ranked, and of a frequent label only those of low hash (some four
    # times the sample); its texts are fetched by a table of take x labels rows
    sizes = {r.lang: r["count"] for r in usable.groupBy("lang").count().collect()}
    part = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    wanted = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, 4.0 * take / n)] or [F.lit(""), F.lit(0.0)])[F.col("lang")]
    low = usable.select("doc_id", "lang").where(part < wanted)
    ranked = low.withColumn("n", F.row_number().over(by_hash)).where(F.col("n") <= take)
    picked = usable.select("doc_id", "lang", "text").join(F.broadcast(ranked.dropDuplicates(["doc_id", "lang"])), ["doc_id", "lang"])
    sample = [r for r in picked.orderBy("lang", "n", "text").collect() if has_letter(r.text)]
    names = sorted({r.lang for r in sample})
    if not names:
        return Model([], np.zeros((buckets, 0)), np.zeros(0))
    number = {x: i for i, x in enumerate(names)}
    train, rest = [r for r in sample if r.n <= rows_per_label], [r for r in sample if r.n > rows_per_label]
    rng = np.random.default_rng(seed)
    texts, labels = [], []
    for r in train:
        words = r.text.split()
        n = int(rng.integers(2, 30))
        a = int(rng.integers(0, max(1, len(words) - n)))
        texts += [r.text, " ".join(words[a : a + n])]
        labels += [number[r.lang]] * 2
    table, bias = _sgd(texts, labels, len(names), buckets, size, epochs, rate, seed)
    model = Model(names, table.astype(np.float64), bias.astype(np.float64))
    return calibrate(model, [r.text for r in rest or train], [number[r.lang] for r in rest or train], margin, most_threshold)


def calibrate(model: Model, texts: list[str], labels: list[int], margin: float, most_threshold: float) -> Model:
    """Temperature by log loss, then the rejection threshold."""
    z, y = np.concatenate([model.logits(texts[a:b]) for a, b in steps(texts)]), np.asarray(labels)

    def loss(t):
        s = z / t
        s = s - s.max(1, keepdims=True)
        return float((np.log(np.exp(s).sum(1)) - s[np.arange(len(y)), y]).mean())

    model.temperature = min((float(t) for t in np.geomspace(0.2, 8, 41)), key=loss)
    _, scores, _ = model.predict(texts)
    right = np.sort([s for s, row, k in zip(scores, z, y) if row.argmax() == k]) if len(y) else np.zeros(0)
    if len(right):
        model.threshold = min(most_threshold, margin * float(right[0]))
    return model


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of ``docs`` with lang_pred, score and accepted added (replacing such)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # buckets x labels, a fixed size
    added = [("lang_pred", T.StringType(), pa.string()), ("score", T.DoubleType(), pa.float64()), ("accepted", T.BooleanType(), pa.bool_())]
    own = docs.drop(*[a[0] for a in added])
    at = own.columns.index("text")

    def run(batch):
        got = shared.value.predict(batch.column(at).to_pylist())
        columns = [batch.column(i) for i in range(batch.num_columns)] + [pa.array(v, a[2]) for v, a in zip(got, added)]
        yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, *[a[0] for a in added]])

    small_batches(docs.sparkSession)
    schema = T.StructType(own.schema.fields + [T.StructField(name, kind) for name, kind, _ in added])
    return arrow_map(own, run, schema)


def accepted_rows(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` the model does not reject, all columns as they came."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batch):
        yield batch.filter(pa.array(shared.value.predict(batch.column(at).to_pylist())[2], pa.bool_()))

    small_batches(docs.sparkSession)
    return arrow_map(docs, run, docs.schema)


def training_fold(docs: DataFrame) -> DataFrame:
    """Labelled documents that may be learned from."""
    return docs.where(crc_third() != 1).select("doc_id", "text", "lang").where("lang IS NOT NULL")


@query("op3_language")
def op3_language(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    model = fit(training_fold(docs))
    out = predict(docs.select("doc_id", "text", F.coalesce(crc_third() == 1, F.lit(False)).alias("held_out")), model)
    return out.select("doc_id", "held_out", "lang_pred", "score", "accepted")
