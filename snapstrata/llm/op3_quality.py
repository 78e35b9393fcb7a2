"""Document quality from a linear-chain conditional random field over lines."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapstrata.llm.common import flat, sliced, words

#: At most so many labelled documents are fitted, each with all its lines.
FIT_DOCS = 4000
#: Lines that texts advance through step by step; longer texts go in blocks of so many, or of the root of their lines.
STEPS = 256
#: Features are made for so many bytes of text at a time; a line counts for so many more.
BLOCK_COST, LINE_COST = 4 << 20, 64
_NOT_SPACE = np.ones(256, bool)
_NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False


def _of(chars: bytes) -> np.ndarray:
    t = np.zeros(256, bool)
    t[np.frombuffer(chars, np.uint8)] = True
    return t


_UPPER, _LOWER, _DIGIT = (_of(bytes(range(a, b + 1))) for a, b in ((65, 90), (97, 122), (48, 57)))
_HIGH = np.arange(256) >= 128
_STOP, _COMMA, _BANG, _BAR = _of(b".?"), _of(b",;:"), _of(b"!"), _of(b"|")
_MARK = _of(b"#$%&*@^~<>{}[]()\\/=+_`\"")
N_OWN = 15


def text_lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, lines of each text). A text without line ends is one line, even if empty; lines tile the data."""
    n_docs = len(offsets) - 1
    breaks = np.flatnonzero(data == 10) + 1
    # a text's first line starts where the text does; the texts of a slice are contiguous
    doc_of_break = np.searchsorted(offsets, breaks - 1, "right") - 1
    starts = np.concatenate([offsets[:-1], breaks])
    docs = np.concatenate([np.arange(n_docs), doc_of_break])
    order = np.lexsort((np.concatenate([np.zeros(n_docs, np.int64), np.ones(len(breaks), np.int64)]), starts, docs))
    starts = starts[order]
    return starts, np.append(starts[1:], offsets[-1:])[: len(starts)], np.bincount(docs, minlength=n_docs)


def line_blocks(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of consecutive lines whose features are made at a time (a longer line alone)."""
    cost = ends - (starts[0] if len(starts) else 0) + LINE_COST * np.arange(1, len(ends) + 1)
    out, at, spent = [], 0, 0
    while at < len(ends):
        stop = max(int(np.searchsorted(cost, spent + BLOCK_COST, "right")), at + 1)
        out.append((at, stop))
        at, spent = stop, cost[stop - 1]
    return out


def line_features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Features of each of these consecutive lines, from its own bytes."""
    data, ends, starts = data[starts[0] : ends[-1]], ends - starts[0], starts - starts[0]
    size = ends - starts
    count = np.maximum(size, 1).astype(float)

    def number(t: np.ndarray) -> np.ndarray:
        c = np.zeros(len(data) + 1, np.int32)
        np.cumsum(t[data], out=c[1:])
        return (c[ends] - c[starts]).astype(float)

    _, lens, h, line = words(data, np.append(starts, ends[-1]), _NOT_SPACE)
    n_words = np.bincount(line, minlength=len(starts)).astype(float)
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (line[1:] == line[:-1])
    some = np.maximum(n_words, 1)
    upper, lower = number(_UPPER), number(_LOWER)
    head, tail = np.zeros(len(starts), bool), np.zeros(len(starts), bool)
    if len(data):
        full = size > 0
        head[full] = (_UPPER | _HIGH)[data[starts[full]]]
        last = np.maximum(ends - 1 - (data[np.maximum(ends - 1, 0)] == 10), starts)
        tail[full] = _STOP[data[np.minimum(last, len(data) - 1)[full]]]
    x = np.column_stack([
        np.log1p(size) / 5, upper / np.maximum(upper + lower, 1), number(_DIGIT) / count, number(~_NOT_SPACE) / count, number(_BAR) / some,
        number(_BANG) / some, number(_MARK) / some, number(_STOP) / some, number(_COMMA) / some, number(_HIGH) / count,
        np.bincount(line, again, minlength=len(starts)) / some, np.bincount(line, lens, minlength=len(starts)) / some / 10, n_words < 4, tail, head,
    ])
    return np.minimum(x, 4.0)


def inner_lines(counts: np.ndarray) -> np.ndarray:
    """True for lines that have a line before them in their text."""
    inner = np.ones(int(counts.sum()), bool)
    inner[(np.cumsum(counts) - counts)[counts > 0]] = False
    return inner


def with_neighbours(parts: np.ndarray, inner: np.ndarray) -> np.ndarray:
    """Sums of a line's own part, the line before's second and the line after's third (none at a text's ends)."""
    out, near = parts[:, 0].copy(), inner[1:]
    out[1:][near] += parts[:-1, 1][near]
    out[:-1][near] += parts[1:, 2][near]
    return out


def _steps(lengths: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(step, the chains that are longer than it), for all chains together."""
    order = np.argsort(-lengths, kind="stable")
    live = np.searchsorted(-lengths[order], -np.arange(int(lengths.max(initial=0))), "left")
    return [(s, order[:n]) for s, n in enumerate(live.tolist())]


def forward_backward(unary: np.ndarray, counts: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(marginal of label 1 for each line, expected transitions of each text summed, log partition summed).

    unary: score of label 1 against label 0 for each line. Texts advance together, step by step. Longer ones than
    STEPS lines are cut into blocks that advance together too: their transfer matrices tell what enters and leaves each, so
    that the number of steps grows with the square root of the longest text."""
    e = np.column_stack([np.zeros(len(unary)), unary])
    size = max(STEPS, math.isqrt(int(counts.max(initial=0))))
    n_blocks = -(-counts // size)
    head = np.cumsum(n_blocks) - n_blocks
    text = np.repeat(np.arange(len(counts)), n_blocks)
    nth = np.arange(len(text)) - head[text]
    first = (np.cumsum(counts) - counts)[text] + nth * size
    length = np.minimum(counts[text] - nth * size, size)
    lead = nth == 0
    steps = _steps(length)
    enter, leave = np.zeros((len(text), 2)), np.zeros((len(text), 2))
    if not lead.all():
        # m: from the label before a block to that of its last line; before a text there is one label only
        m = np.where(lead[:, None, None], 0, trans) + e[first][:, None, :]
        for s, b in _steps(np.where(n_blocks[text] > 1, length, 0))[1:]:
            m[b] = np.logaddexp(m[b][:, :, :1] + trans[0], m[b][:, :, 1:] + trans[1]) + e[first[b] + s][:, None, :]
        enter[lead] = (0, -np.inf)
        hops = _steps(n_blocks - 1)
        for s, t in hops:
            b = head[t] + s
            enter[b + 1] = np.logaddexp(enter[b][:, :1] + m[b][:, 0], enter[b][:, 1:] + m[b][:, 1])
        for s, t in reversed(hops):
            b = head[t] + s + 1
            leave[b - 1] = np.logaddexp(m[b][:, :, 0] + leave[b][:, :1], m[b][:, :, 1] + leave[b][:, 1:])
    alpha, beta = np.zeros((len(unary), 2)), np.zeros((len(unary), 2))
    for s, b in steps:
        at = first[b] + s
        before = alpha[at - 1] if s else enter[b]
        reached = np.logaddexp(before[:, :1] + trans[0], before[:, 1:] + trans[1])
        alpha[at] = e[at] + (reached if s else np.where(lead[b][:, None], 0, reached))
    last = (first + length - 1)[head + n_blocks - 1]
    z = np.logaddexp(alpha[last, 0], alpha[last, 1])
    beta[first + length - 1] = leave
    pairs = np.zeros((2, 2))
    for s, b in reversed(steps):
        if not s:
            b = b[~lead[b]]
        at = first[b] + s
        before = alpha[at - 1] if s else enter[b]
        joint = before[:, :, None] + trans + (e[at] + beta[at])[:, None, :]
        if s:
            beta[at - 1] = np.logaddexp(joint[:, :, 0], joint[:, :, 1]) - before
        pairs += np.exp(joint - z[text[b], None, None]).sum(0)
    score = alpha + beta
    return 1 / (1 + np.exp(np.clip(score[:, 0] - score[:, 1], -500, 500))), pairs, z.sum()


class LineCRF:
    """Weights, transitions and the scaling of features: a line's own, those of the line before and after it (0 where there is
    none), and a constant."""

    def __init__(self, weights, trans, mean, scale):
        self.weights, self.trans, self.mean, self.scale = weights, trans, mean, scale

    @classmethod
    def fit(cls, own: np.ndarray, counts: np.ndarray, labels: np.ndarray, rounds: int = 250, ridge: float = 1e-3) -> LineCRF:
        """Maximum likelihood by full-batch steps of Adam; every line of a text carries the text's label. own: the lines' own
        features; those of neighbours are the same numbers and are not copied."""
        inner = inner_lines(counts)
        tail = np.append(~inner[1:], True)  # a text's last lines, of which no line is behind
        sums = [own.sum(0), own[~tail].sum(0), own[inner].sum(0)]
        squares = [np.einsum("ij,ij->j", x, x) for x in (own, own[~tail], own[inner])]
        mean = np.concatenate(sums) / len(own)
        scale = np.sqrt(np.maximum(np.concatenate(squares) / len(own) - mean * mean, 0)) + 1e-6
        y = np.repeat(labels, counts).astype(float)
        seen = np.zeros((2, 2))
        for k in (0, 1):
            seen[k, k] = (counts[labels == k] - 1).sum()
        theta = np.zeros(len(mean) + 5)
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        n = len(counts)
        r = np.zeros((len(own), 3))
        for t in range(1, rounds + 1):
            model = cls(theta[:-4], theta[-4:].reshape(2, 2), mean, scale)
            p, pairs, _ = forward_backward(model.unary(own @ model.parts(), inner), counts, model.trans)
            r[:, 0] = p - y
            r[:-1, 1], r[1:, 2] = r[1:, 0] * inner[1:], r[:-1, 0] * inner[1:]  # a line is in the scores of its neighbours
            total = r[:, 0].sum()
            grad = np.concatenate([((own.T @ r).T.ravel() - mean * total) / scale, [total], (pairs - seen).ravel()]) / n + ridge * theta
            m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
            theta = theta - 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        return cls(theta[:-4], theta[-4:].reshape(2, 2), mean, scale)

    def parts(self) -> np.ndarray:
        """What a line's own features add to its own score, to that of the line behind it and of the line before it."""
        return (self.weights[:-1] / self.scale).reshape(3, -1).T

    def unary(self, parts: np.ndarray, inner: np.ndarray) -> np.ndarray:
        return with_neighbours(parts, inner) + (self.weights[-1] - self.weights[:-1] @ (self.mean / self.scale))

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Length-weighted mean of the lines' marginals of label 1, for each text. Features are made and used block by block of
        lines; about 200 bytes a line are held, however many there are."""
        starts, ends, counts = text_lines(data, offsets)
        weigh = self.parts()
        parts = np.concatenate([np.zeros((0, 3)), *(line_features(data, starts[a:b], ends[a:b]) @ weigh for a, b in line_blocks(starts, ends))])
        p, _, _ = forward_backward(self.unary(parts, inner_lines(counts)), counts, self.trans)
        doc, size = np.repeat(np.arange(len(counts)), counts), (ends - starts).astype(float) + 1
        return np.bincount(doc, p * size, minlength=len(counts)) / np.bincount(doc, size, minlength=len(counts))


def _sample_features(batches):
    for batch in batches:
        for part in sliced(batch):
            data, offsets = flat(part.column("text"))
            starts, ends, counts = text_lines(data, offsets)
            x = np.concatenate([np.zeros((0, N_OWN), np.float32), *(line_features(data, starts[a:b], ends[a:b]).astype(np.float32) for a, b in line_blocks(starts, ends))])
            first = np.cumsum(counts) - counts
            yield pa.RecordBatch.from_arrays([part.column("label"), pa.array([x[a : a + c].tobytes() for a, c in zip(first, counts, strict=True)], pa.binary())], names=["label", "x"])


def held_out(doc_id) -> F.Column:
    """True for ids that must not teach: crc32 of the id as text, mod 3, is 1 (and ids that are null)."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(True))


def fit_quality(docs: DataFrame, labels: DataFrame, fit_docs: int = FIT_DOCS, id_col: str = "doc_id", text_col: str = "text") -> LineCRF:
    """Fits on at most fit_docs labelled ids that are not held out, those with the least id hash. An id with several
    rows teaches once, with the least of its texts (null counts as empty).

    All lines of their texts teach: the number of ids bounds the driver's memory, about 400 bytes a line while fitting.
    Labels that are null or contradict each other do not teach. Without any usable label every text scores 0.5."""
    usable = labels.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("label"), F.max("quality").alias("most")).where("label = most")
    sample = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_docs).select(F.col("doc_id").alias("__id"), F.col("label").cast("int").alias("label"))
    texts = docs.select(F.col(id_col).alias("__doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(sample), F.col("__doc") == F.col("__id"))
    texts = texts.groupBy("__id").agg(F.min("label").alias("label"), F.min("text").alias("text")).select("label", "text")  # at most fit_docs rows
    rows = sorted(texts.mapInArrow(_sample_features, "label int, x binary").collect(), key=lambda r: (r.label, bytes(r.x)))
    if not rows:
        return LineCRF(np.zeros(3 * N_OWN + 1), np.zeros((2, 2)), np.zeros(3 * N_OWN), np.ones(3 * N_OWN))
    xs = [np.frombuffer(r.x, np.float32).reshape(-1, N_OWN) for r in rows]
    return LineCRF.fit(np.concatenate(xs).astype(float), np.asarray([len(x) for x in xs]), np.asarray([r.label for r in rows]))


def _score(batches, model: LineCRF):
    for batch in batches:
        for part in sliced(batch):
            s = model.score(*flat(part.column("text")))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **fit) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted; one row per row of docs, from its text alone.

    Null counts as an empty text: one empty line, which gets a score as any other. Ids select what teaches and are no input of
    a score; repeated rows get equal scores. Extra columns are ignored."""
    model = fit_quality(docs, labels, id_col=id_col, text_col=text_col, **fit)
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(lambda b: _score(b, model), f"doc_id {dict(docs.dtypes)[id_col]}, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.5, text_col: str = "text", **fit) -> DataFrame:
    """The rows of docs whose score is ``least`` or more, with all their columns."""
    model = fit_quality(docs, labels, text_col=text_col, **fit)

    def run(batches):
        for batch in batches:
            for part in sliced(batch, text_col):
                yield part.filter(pa.array(model.score(*flat(part.column(text_col))) >= least))

    return docs.mapInArrow(run, docs.schema)
