"""Document quality from a linear-chain conditional random field over lines."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Byte classes of ``_CLASS``; continuation bytes of UTF-8 count nowhere.
LOWER, UPPER, DIGIT, SPACE, NEWLINE, BANG, PIPE, MARK, STOP, OTHER, LETTER, TAIL = range(12)


def _classes() -> np.ndarray:
    table = np.full(256, OTHER, dtype=np.uint8)
    for chars, kind in (("!", BANG), ("|", PIPE), ("#*$%&<>", MARK), (".,;:?", STOP), (" \t\x0b\x0c\r", SPACE), ("\n", NEWLINE), ("0123456789", DIGIT)):
        table[[ord(c) for c in chars]] = kind
    table[ord("a") : ord("z") + 1] = LOWER
    table[ord("A") : ord("Z") + 1] = UPPER
    table[0x80:0xC0] = TAIL
    table[0xC0:] = LETTER
    return table


_CLASS = _classes()
N_FEATURES = 15


@dataclass
class Lines:
    """The lines of some documents: features, lengths and each one's document."""

    x: np.ndarray
    length: np.ndarray
    doc: np.ndarray


@dataclass
class Counts:
    """What is counted in each line of some texts (columns as ``COUNTED``),
    its last byte (0 for an empty line), and its document."""

    of: np.ndarray
    last: np.ndarray
    doc: np.ndarray


COUNTED = ("chars", "words", "twins", "repeats", "marks", "bangs", "pipes", "upper", "lower", "digits", "stops")


@dataclass
class Held:
    """What a text cut in pieces carries from one to the next: the hash of its
    last word (none yet: None), whether that word's line goes on, and the
    pairs of words so far, in order."""

    word: np.uint64 | None = None
    same_line: bool = False
    pairs: np.ndarray | None = None
    #: Hash and bytes of a word that the next piece goes on with.
    open_hash: np.uint64 = np.uint64(0)
    open_bytes: int = 0


#: A word's hash sums its bytes weighted by powers of an odd number, modulo 2**64.
_BASE = 0x9E3779B97F4A7C15


def _word_hashes(data: np.ndarray, gap: np.ndarray, first: np.ndarray, word_at: np.ndarray) -> np.ndarray:
    index = np.cumsum(first) - 1
    offset = np.arange(len(data)) - word_at[np.maximum(index, 0)]
    powers = np.cumprod(np.full(int(offset[~gap].max()) + 1, _BASE, dtype=np.uint64))
    weighted = np.where(gap, np.uint64(0), (data.astype(np.uint64) + np.uint64(1)) * powers[np.where(gap, 0, np.minimum(offset, len(powers) - 1))])
    return np.add.reduceat(weighted, word_at)


def count_lines(texts: list[str], held: Held | None = None, goes_on: bool = False) -> Counts:
    """Counts of every line. All bytes of the texts are handled at once: class
    counts of a line are differences of running sums, and a word is known by a
    polynomial hash. ``held`` goes with one text at a time and is renewed; with
    ``goes_on`` the last word is not complete and counts where it ends."""
    raw = [t.encode("utf-8", "surrogatepass") + b"\n" for t in texts]
    data = np.frombuffer(b"".join(raw), dtype=np.uint8)
    kind = _CLASS[data]
    doc_end = np.cumsum([len(r) for r in raw])
    ends = np.flatnonzero(kind == NEWLINE)
    starts = np.concatenate([[0], ends[:-1] + 1])
    doc = np.searchsorted(doc_end, ends, side="right")

    def per_line(flag: np.ndarray) -> np.ndarray:
        run = np.concatenate([[0], np.cumsum(flag, dtype=np.int32)])
        return (run[ends] - run[starts]).astype(np.float64)

    gap = (kind == SPACE) | (kind == NEWLINE)
    first = ~gap
    first[1:] &= gap[:-1]
    chars = per_line((kind != TAIL) & ~gap)
    word_at = np.flatnonzero(first)
    hashes = _word_hashes(data, gap, first, word_at) if len(word_at) else np.array([], dtype=np.uint64)
    if held is not None:
        if held.open_bytes and len(word_at):
            hashes[:1] = hashes[:1] * np.uint64(pow(_BASE, held.open_bytes, 2**64)) + held.open_hash
        if goes_on:
            held.open_bytes = (held.open_bytes if len(word_at) == 1 else 0) + len(data) - 1 - int(word_at[-1])
            held.open_hash = hashes[-1]
            word_at, hashes = word_at[:-1], hashes[:-1]
        else:
            held.open_bytes = 0
    word_line = np.searchsorted(ends, word_at, side="right")
    word_doc = doc[word_line] if len(word_at) else np.array([], dtype=np.int64)
    n_words = np.bincount(word_line, minlength=len(ends)).astype(np.float64)
    twin, seen = np.zeros(len(word_at)), np.zeros(len(word_at))
    if len(word_at):
        twin[1:] = (hashes[1:] == hashes[:-1]) & (word_line[1:] == word_line[:-1])
        # pairs of words that their document has already held in another place
        begins = np.concatenate([[True], word_doc[1:] != word_doc[:-1]])
        pair = np.concatenate([[np.uint64(0)], hashes[:-1]]) * np.uint64(31) + hashes
        pair[begins] = ~hashes[begins]
        if held is not None and held.word is not None:
            twin[0] = float(held.same_line and word_line[0] == 0 and held.word == hashes[0])
            pair[:1] = np.array([held.word]) * np.uint64(31) + hashes[:1]
        order = np.lexsort((np.arange(len(pair)), pair, word_doc))
        again = (pair[order][1:] == pair[order][:-1]) & (word_doc[order][1:] == word_doc[order][:-1])
        seen[order[1:][again]] = 1
        if held is not None:
            if held.pairs is not None:
                seen = np.maximum(seen, np.isin(pair, held.pairs))
            held.pairs = np.unique(pair) if held.pairs is None else np.union1d(held.pairs, pair)
            held.word, held.same_line = hashes[-1], bool(word_line[-1] == len(ends) - 1)
        twins, repeats = (np.bincount(word_line, weights=w, minlength=len(ends)) for w in (twin, seen))
    else:
        twins = repeats = np.zeros(len(ends))
        if held is not None:
            held.same_line &= len(ends) == 1
    of = [chars, n_words, twins, repeats, *[per_line(kind == k) for k in (MARK, BANG, PIPE, UPPER, LOWER, DIGIT, STOP)]]
    return Counts(np.stack(of, axis=1), np.where(ends > starts, data[np.maximum(ends - 1, 0)], 0), doc)


def as_features(counts: Counts) -> np.ndarray:
    """Features of lines from their counts."""
    chars, n_words, twins, repeats, marks, bangs, pipes, upper, lower, digits, stops = counts.of.T
    safe, many = np.maximum(chars, 1), np.maximum(n_words, 1)
    return np.stack(
        [
            np.ones(len(chars)),
            np.minimum(marks / many, 3),
            np.minimum(bangs / many, 3),
            np.minimum(pipes / many, 2),
            upper / safe,
            lower / safe,
            digits / safe,
            np.minimum(stops / many, 2),
            twins / many,
            repeats / many,
            np.minimum(chars / many, 20) / 5,
            np.minimum(np.log1p(n_words), 6) / 3,
            (upper > 0.5 * safe).astype(float),
            (pipes > 0).astype(float),
            np.isin(counts.last, np.frombuffer(b".!?", dtype=np.uint8)).astype(float),
        ],
        axis=1,
    )


def line_features(texts: list[str]) -> Lines:
    """Features of every line with a word; a text without one has one empty line."""
    counts = count_lines(texts)
    chars, full, doc = counts.of[:, 0], counts.of[:, 1] > 0, counts.doc
    keep = full.copy()
    keep[np.searchsorted(doc, np.setdiff1d(np.arange(len(texts)), doc[full]))] = True
    return Lines(as_features(counts)[keep], np.maximum(chars[keep], 1), doc[keep])


#: Texts of more characters are taken in pieces of about so many.
LONG = 1_000_000


def pieces(text: str, most: int = LONG) -> Iterator[tuple[str, bool, bool]]:
    """A text in pieces, whether a line ends with each (its newline is left
    out), and whether the next one goes on with its last word: cut at the last
    newline in reach, else after the last ASCII space, else anywhere."""
    at = 0
    while len(text) - at > most:
        cut = text.rfind("\n", at, at + most)
        if cut >= 0:
            yield text[at:cut], True, False
            at = cut + 1
            continue
        cut = max(text.rfind(c, at, at + most) for c in common.SPACES)
        cut = cut + 1 if cut >= 0 else at + most
        yield text[at:cut], False, text[cut - 1] not in common.SPACES and text[cut] not in common.SPACES
        at = cut
    yield text[at:], True, False


def long_marginal(text: str, model: Model, most: int = LONG) -> float:
    """``document_marginal`` of one long text. Pieces are counted one by one;
    of a line only three sums and its length stay."""
    held, open_, open_last = Held(), np.zeros(len(COUNTED)), 0
    parts = []
    weights = model.weight.reshape(3, N_FEATURES).T  # of a line, the one before and the one after
    for piece, ended, goes_on in pieces(text, most):
        c = count_lines([piece], held, goes_on)
        c.of[0] += open_
        c.last[0] = c.last[0] or open_last
        stop = len(c.of) if ended else len(c.of) - 1
        open_, open_last = (np.zeros(len(COUNTED)), 0) if ended else (c.of[-1], c.last[-1])
        held.same_line = held.same_line and not ended
        keep = np.flatnonzero(c.of[:stop, 1] > 0)
        done = Counts(c.of[keep], c.last[keep], c.doc[keep])
        parts.append((as_features(done) @ weights, np.maximum(done.of[:, 0], 1)))
    sums, length = (np.concatenate(p) for p in zip(*parts))
    if not len(sums):  # no word at all: one empty line
        return float(document_marginal(line_features([""]), with_neighbours(line_features([""])), model, 1)[0])
    score = sums[:, 0].copy()
    score[1:] += sums[:-1, 1]
    score[:-1] += sums[1:, 2]
    (bb, bg), (gb, gg) = np.exp(model.move).tolist()

    def step(odds: float, a: float, b: float, c: float, d: float) -> float:
        """log((a + b x) / (c + d x)) of the log of x."""
        if odds > 0:
            x = math.exp(-odds)
            return math.log((a * x + b) / (c * x + d))
        x = math.exp(odds)
        return math.log((a + b * x) / (c + d * x))

    s = score.tolist()
    odds = np.empty(len(s))
    now = odds[0] = s[0]
    for t in range(1, len(s)):
        now = odds[t] = s[t] + step(now, bg, gg, bb, gb)
    now = 0.0
    for t in range(len(s) - 2, -1, -1):
        now = step(now + s[t + 1], gb, gg, bb, bg)
        odds[t] += now
    good = np.exp(-np.logaddexp(0, -odds))
    return float((good * length).sum() / length.sum())


def _all_lines(texts: list[str]) -> Lines:
    """``line_features`` slice by slice, to hold few bytes at a time."""
    parts = []
    for a, b in in_slices(texts):
        part = line_features(texts[a:b])
        parts.append(Lines(part.x, part.length, part.doc + a))
    return Lines(*(np.concatenate([getattr(p, f) for p in parts]) for f in ("x", "length", "doc")))


def with_neighbours(lines: Lines) -> np.ndarray:
    """Each line's features, those of the line before and of the line after
    (zeros at a document's ends)."""
    x, doc = lines.x, lines.doc
    before, after = np.zeros_like(x), np.zeros_like(x)
    same = (doc[1:] == doc[:-1])[:, None] if len(doc) > 1 else np.zeros((0, 1))
    before[1:] = x[:-1] * same
    after[:-1] = x[1:] * same
    return np.concatenate([x, before, after], axis=1)


@dataclass
class Model:
    """Weights of label good over bad for a line, 2 x 2 transition scores (bad
    first), and the logistic map from a document's marginal to its score."""

    weight: np.ndarray
    move: np.ndarray
    slope: float = 1.0
    shift: float = 0.0


def _chains(doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])) if len(doc) else np.array([], dtype=int)
    return starts, np.diff(np.append(starts, len(doc)))


def marginals(score: np.ndarray, move: np.ndarray, doc: np.ndarray, pairs: bool = False):
    """P(line good), and on request the summed pair marginals and log Z of each
    chain, by forward-backward over all chains at once, longest first."""
    starts, sizes = _chains(doc)
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = starts[order], sizes[order]
    emit = np.stack([np.zeros_like(score), score], axis=1)
    fwd, bwd = np.zeros_like(emit), np.zeros_like(emit)
    steps = int(sizes[0]) if len(sizes) else 0
    alive = np.searchsorted(-sizes, -np.arange(steps), side="left")  # chains longer than t
    add = lambda a, b: np.logaddexp(a[:, 0] + b[0], a[:, 1] + b[1])
    for t in range(steps):
        at = starts[: alive[t]] + t
        fwd[at] = emit[at]
        if t:
            past = fwd[at - 1]
            fwd[at, 0] += add(past, move[:, 0])
            fwd[at, 1] += add(past, move[:, 1])
    for t in range(steps - 2, -1, -1):
        at = starts[: alive[t + 1]] + t
        ahead = bwd[at + 1] + emit[at + 1]
        bwd[at, 0] = add(ahead, move[0])
        bwd[at, 1] = add(ahead, move[1])
    both = fwd + bwd
    total = np.logaddexp(both[:, 0], both[:, 1])
    good = np.exp(both[:, 1] - total)
    if not pairs:
        return good
    inner = np.flatnonzero(doc[1:] == doc[:-1]) if len(doc) > 1 else np.array([], dtype=int)
    joint = fwd[inner][:, :, None] + move[None] + (emit[inner + 1] + bwd[inner + 1])[:, None, :] - total[inner][:, None, None]
    return good, np.exp(joint).sum(axis=0), total[starts].sum(), inner


def fit(texts: list[str], labels: np.ndarray, rounds: int = 150, rate: float = 0.1, decay: float = 1e-3) -> Model:
    """Penalised likelihood by Adam, lines taking their document's label, each
    line weighing one; then the logistic map of documents by Newton steps."""
    lines = _all_lines(texts)
    x, doc = with_neighbours(lines), lines.doc
    y = np.asarray(labels, dtype=float)[doc]
    weight, move = np.zeros(x.shape[1]), np.zeros((2, 2))
    params = np.zeros(x.shape[1] + 4)
    m, v = np.zeros_like(params), np.zeros_like(params)
    for step in range(1, rounds + 1):
        weight, move = params[:-4], params[-4:].reshape(2, 2)
        good, joint, _, inner = marginals(x @ weight, move, doc, pairs=True)
        seen = np.zeros((2, 2))
        np.add.at(seen, (y[inner].astype(int), y[inner + 1].astype(int)), 1)
        grad = np.concatenate([x.T @ (y - good), (seen - joint).ravel()]) / len(doc) - decay * params
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        params = params + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    model = Model(params[:-4], params[-4:].reshape(2, 2))
    z, target = _logit(document_marginal(lines, x, model, len(texts))), np.asarray(labels, dtype=float)
    beta = np.zeros(2)
    design = np.stack([z, np.ones_like(z)], axis=1)
    for _ in range(25):
        p = 1 / (1 + np.exp(-(design @ beta)))
        h = design.T @ (design * (p * (1 - p))[:, None]) + 1e-2 * np.eye(2)
        beta = beta + np.linalg.solve(h, design.T @ (target - p) - 1e-2 * beta)
    return Model(model.weight, model.move, max(float(beta[0]), 1e-3), float(beta[1]))


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def document_marginal(lines: Lines, x: np.ndarray, model: Model, n: int) -> np.ndarray:
    """Mean of P(line good) over a document's lines, weighted by their length."""
    good = marginals(x @ model.weight, model.move, lines.doc)
    return np.bincount(lines.doc, weights=good * lines.length, minlength=n) / np.bincount(lines.doc, weights=lines.length, minlength=n)


def score_texts(texts: list[str], model: Model) -> np.ndarray:
    short = [i for i, t in enumerate(texts) if len(t) <= LONG]
    mean = np.array([0.0 if len(t) <= LONG else long_marginal(t, model) for t in texts])
    if short:
        lines = line_features([texts[i] for i in short])
        mean[short] = document_marginal(lines, with_neighbours(lines), model, len(short))
    z = _logit(mean)
    return 1 / (1 + np.exp(-(model.slope * z + model.shift)))


def in_slices(texts: list[str], most: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``most`` characters together, one at least."""
    begin = size = 0
    for i, t in enumerate(texts):
        if i > begin and size + len(t) > most:
            yield begin, i
            begin, size = i, 0
        size += len(t)
    if texts:
        yield begin, len(texts)


def train(docs: DataFrame, labels: DataFrame, most_rows: int = 4000, longest: int = 200_000, most_chars: int = 32_000_000, most_lines: int = 300_000) -> Model:
    """A model from at most ``most_rows`` labelled documents (those of least
    hash of doc_id) of at most ``longest`` characters and a tenth of
    ``most_lines`` lines, and of those in that order only as many as hold
    ``most_chars`` and ``most_lines`` together (a line takes some 0.7 KB while
    it is fitted); that is the documented bound of the sample. Without any,
    every document scores 0.5.

    Rows that repeat a doc_id are one document, the least text of them."""
    order = F.xxhash64("doc_id")
    chosen = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = chosen.orderBy(order, "doc_id").limit(most_rows)
    # at most most_rows narrow rows: a bounded broadcast
    pairs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id").where(F.length("text") <= longest)
    pairs = pairs.withColumn("lines", F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1).where(F.col("lines") <= most_lines // 10)
    pairs = common.settled(pairs.groupBy("doc_id").agg(F.min_by("lines", "text").alias("lines"), F.min("text").alias("text"), F.max("quality").alias("quality")))
    chars = lines = 0
    fit_in = []
    for r in pairs.select("doc_id", F.length("text").alias("n"), "lines", order.alias("h")).orderBy("h", "doc_id").collect():
        chars, lines = chars + r["n"], lines + r["lines"]
        if chars > most_chars or lines > most_lines:
            break
        fit_in.append(r["doc_id"])
    rows = sorted(pairs.where(F.col("doc_id").isin(fit_in)).select("doc_id", "text", "quality").collect()) if fit_in else []
    if not rows:
        return Model(np.zeros(3 * N_FEATURES), np.zeros((2, 2)))
    return fit([r["text"] for r in rows], np.array([r["quality"] for r in rows]))


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the quality score (0 to 1) of each whole text in ``out``.

    Null and blank texts are one empty line. Columns are kept; one named
    ``out`` is replaced.
    """

    @F.pandas_udf("double")
    def scored(col: pd.Series) -> pd.Series:
        texts = [t or "" for t in col]
        return pd.Series(np.concatenate([score_texts(texts[a:b], model) for a, b in in_slices(texts)]) if texts else [], dtype=float)

    return docs.withColumn(out, scored(F.col(text)))


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """All documents with held_out, score and predicted; learned from the
    labelled rows that are not held out (crc32(doc_id) mod 5 is not 0)."""
    fold = common.crc_bucket(F.col("doc_id"), 5)
    model = train(docs, labels.where(fold != 0))
    scored = score(docs.withColumn("held_out", F.coalesce(fold == 0, F.lit(False))), model)
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op5_crf_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document by the line model, as ``labels`` marks it."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_scores(docs, common.table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")
