"""Document likelihood over all segmentations by a unigram piece model."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import compress, repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .crf import in_slices

#: What a SentencePiece vocabulary writes before a word.
WORD_MARK = "▁".encode()
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Words up to so many bytes (with the mark) are handled many at a time.
_SHORT = 72


def vocabulary(path: str | None = None) -> tuple[list[bytes], np.ndarray]:
    """The pieces of a SentencePiece model as bytes, each once, with weights.

    The file gives no log-probabilities but merge ranks (its scores are 0, -1,
    -2, ...), so a piece weighs 1 / (10 + rank), as Zipf's law has it. The 256
    byte pieces are pieces of one byte with the weight of the last.
    """
    import sentencepiece

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i))]
    least = 1 / (10 + len(ids))
    weights: dict[bytes, float] = {bytes([b]): least for b in range(256)}
    for i in ids:
        if not model.is_byte(i):
            piece = model.id_to_piece(i).encode()
            weights[piece] = weights.get(piece, 0.0) + 1 / (10 - model.get_score(i))
    total = sum(weights.values())
    return list(weights), np.array([w / total for w in weights.values()])


def _hash(piece: bytes) -> int:
    h = 0
    for b in piece:
        h = (h * int(_BASE) + b + 1) & 0xFFFFFFFFFFFFFFFF
    return h


@dataclass
class Units:
    """Pieces with natural-log probabilities, found by rolling hash."""

    pieces: list[bytes]
    logp: np.ndarray

    def __post_init__(self):
        keys = np.array([_hash(p) for p in self.pieces], dtype=np.uint64)
        self.order = np.argsort(keys)
        self.keys = keys[self.order]
        self.maybe = np.zeros(1 << 20, dtype=bool)
        self.maybe[self.keys >> np.uint64(44)] = True
        self.lengths = sorted({len(p) for p in self.pieces})

    def find(self, h: np.ndarray) -> np.ndarray:
        """The unit of each hash, or -1."""
        out = np.full(h.shape, -1, dtype=np.int32)
        at = np.flatnonzero(self.maybe[h.ravel() >> np.uint64(44)])
        some = h.ravel()[at]
        pos = np.minimum(np.searchsorted(self.keys, some), len(self.keys) - 1)
        hit = self.keys[pos] == some
        out.ravel()[at[hit]] = self.order[pos[hit]]
        return out

    def edges(self, words: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """For words of one length (rows of bytes): length of piece, unit and
        log-probability of each place where such a piece may stand."""
        m, n = words.shape
        run = np.zeros((m, n + 1), dtype=np.uint64)
        for j in range(n):
            run[:, j + 1] = run[:, j] * _BASE + words[:, j] + np.uint64(1)
        out = []
        for size in self.lengths:
            if size > n:
                break
            power = np.uint64(pow(int(_BASE), size, 1 << 64))
            unit = self.find(run[:, size:] - run[:, :-size] * power)
            if (unit >= 0).any():
                out.append((size, unit, np.where(unit >= 0, self.logp[unit], -np.inf)))
        return out


def _log_sum(terms: list[np.ndarray]) -> np.ndarray:
    x = np.stack(terms)
    top = x.max(axis=0)
    top = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(divide="ignore"):
        return top + np.log(np.exp(x - top).sum(axis=0))


def forward(edges: list, m: int, n: int) -> np.ndarray:
    """alpha[j]: log of the summed probability of all segmentations of the
    first j bytes."""
    alpha = np.full((n + 1, m), -np.inf)
    alpha[0] = 0
    for j in range(1, n + 1):
        terms = [alpha[j - size] + logp[:, j - size] for size, _, logp in edges if size <= j]
        alpha[j] = _log_sum(terms)
    return alpha


def backward(edges: list, m: int, n: int) -> np.ndarray:
    beta = np.full((n + 1, m), -np.inf)
    beta[n] = 0
    for i in range(n - 1, -1, -1):
        terms = [logp[:, i] + beta[i + size] for size, _, logp in edges if i + size <= n]
        beta[i] = _log_sum(terms)
    return beta


def _by_length(words: list[bytes], chosen: np.ndarray, most_cells: int = 40_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(indices, rows of bytes) of the chosen words of one length each, in slices."""
    sizes = np.array([len(words[k]) for k in chosen], dtype=np.int64)
    for n in np.unique(sizes):
        at = chosen[sizes == n]
        for i in range(0, len(at), step := max(1, most_cells // int(n))):
            part = at[i : i + step]
            yield part, np.frombuffer(b"".join(words[k] for k in part), dtype=np.uint8).reshape(len(part), n)


def word_log_probs(words: list[bytes], units: Units) -> np.ndarray:
    """Natural log of each word's marginal probability (without the mark)."""
    marked = [WORD_MARK + w for w in words]
    sizes = np.array([len(w) for w in marked], dtype=np.int64)
    out, long = np.zeros(len(words)), np.flatnonzero(sizes > _SHORT)
    for at, rows in _by_length(marked, np.flatnonzero(sizes <= _SHORT)):
        n = rows.shape[1]
        out[at] = forward(units.edges(rows), len(at), n)[n]
    for part in _alike(sizes[long]):
        out[long[part]] = _long_forward([marked[k] for k in long[part]], units)[2]
    return out


def _alike(sizes: np.ndarray, most: int = 64, spread: float = 1.25) -> Iterator[np.ndarray]:
    """Indices of words in batches of ``most`` of about the same length."""
    order, i = np.argsort(sizes, kind="stable"), 0
    while i < len(order):
        j = i + 1
        while j < min(len(order), i + most) and sizes[order[j]] <= spread * sizes[order[i]]:
            j += 1
        yield order[i:j]
        i = j


def _padded(words: list[bytes]) -> np.ndarray:
    out = np.zeros((len(words), max(map(len, words))), dtype=np.uint8)
    for row, w in zip(out, words):
        row[: len(w)] = np.frombuffer(w, dtype=np.uint8)
    return out


def _ending(rows: np.ndarray, a: int, b: int, units: Units) -> tuple[np.ndarray, np.ndarray]:
    """Log-probability and unit (-1: none) of the pieces of each length that
    end after a + 1 to b bytes: (ends, lengths, words)."""
    start = max(0, a - units.lengths[-1])
    logs = np.full((b - a, len(units.lengths), len(rows)), -np.inf)
    found = np.full(logs.shape, -1, dtype=np.int32)
    place = {size: k for k, size in enumerate(units.lengths)}
    for size, unit, logp in units.edges(rows[:, start:b]):
        first = max(0, a + 1 - size - start)
        ends = slice(start + first + size - a - 1, b - a)
        logs[ends, place[size]], found[ends, place[size]] = logp[:, first:].T, unit[:, first:].T
    return logs, found


def _forward_block(window: np.ndarray, logs: np.ndarray, units: Units) -> np.ndarray:
    """The forward values of the block behind those before it (the window)."""
    held, back = len(window), np.array(units.lengths)
    alpha = np.concatenate([window, np.empty((len(logs), window.shape[1]))])
    for t, here in enumerate(logs):
        x = alpha[held + t - back] + here
        top = x.max(axis=0)
        x -= top
        np.exp(x, out=x)
        alpha[held + t] = top + np.log(x.sum(axis=0))
    return alpha


def _long_forward(words: list[bytes], units: Units, block: int = 512) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """The rows of bytes of a batch of words, the window before each block and
    the log of each word's probability. Every byte is a piece, so that no
    value before a word's end is minus infinity."""
    rows, sizes, longest = _padded(words), np.array([len(w) for w in words]), units.lengths[-1]
    window = np.full((longest, len(words)), -np.inf)
    window[-1] = 0
    windows, whole = [], np.zeros(len(words))
    for a in range(0, rows.shape[1], block):
        b = min(rows.shape[1], a + block)
        windows.append(window)
        alpha = _forward_block(window, _ending(rows, a, b, units)[0], units)
        done = np.flatnonzero((sizes > a) & (sizes <= b))
        whole[done] = alpha[longest + sizes[done] - a - 1, done]
        window = alpha[-longest:]
    return rows, windows, whole


def _long_counts(words: list[bytes], weights: np.ndarray, units: Units, total: np.ndarray, block: int = 512) -> None:
    """Add the expected uses of each unit in a batch of long words to ``total``.

    Forward by blocks of which only the last values are kept, then backward
    from the last block, whose forward values are found again from those."""
    longest, sizes, back = units.lengths[-1], np.array([len(w) for w in words]), np.array(units.lengths)
    block = max(block, longest)
    rows, windows, whole = _long_forward(words, units, block)
    n = rows.shape[1]
    carried = np.full((longest + 1, len(words)), -np.inf)  # backward values of the block's end and the places before it
    for k in range(len(windows) - 1, -1, -1):
        a, b = k * block, min(n, (k + 1) * block)
        logs, found = _ending(rows, a, b, units)
        alpha = _forward_block(windows[k], logs, units)
        beta = np.full((longest + b - a + 1, len(words)), -np.inf)  # from longest places before a to b
        beta[-longest - 1 :] = carried
        ends = np.flatnonzero((sizes > a) & (sizes <= b))
        beta[longest + sizes[ends] - a, ends] = 0
        for t in range(b - a - 1, -1, -1):
            j = longest + t + 1
            beta[j - back] = np.logaddexp(beta[j - back], logs[t] + beta[j])
        place = longest + np.arange(b - a)
        share = alpha[place[:, None] - back[None]] + logs + beta[place + 1][:, None] - whole
        hit = (found >= 0) & (share > -745)
        total += np.bincount(found[hit], weights=(np.exp(share) * weights)[hit], minlength=len(total))
        carried = beta[: longest + 1]


def expected_counts(words: list[bytes], weights: np.ndarray, units: Units) -> np.ndarray:
    """Expected uses of each unit over the weighted words (E step). Words up
    to a bound are taken by length, longer ones in blocks of bytes."""
    total = np.zeros(len(units.pieces))
    marked = [WORD_MARK + w for w in words]
    sizes = np.array([len(w) for w in marked], dtype=np.int64)
    long = np.flatnonzero(sizes > _SHORT)
    for at, rows in _by_length(marked, np.flatnonzero(sizes <= _SHORT)):
        m, n = rows.shape
        edges = units.edges(rows)
        alpha, beta = forward(edges, m, n), backward(edges, m, n)
        for size, unit, logp in edges:
            share = alpha[: n + 1 - size].T + logp + beta[size:].T - alpha[n][:, None]
            hit = unit >= 0
            total += np.bincount(unit[hit], weights=(np.exp(share) * weights[at][:, None])[hit], minlength=len(total))
    for part in _alike(sizes[long]):
        _long_counts([marked[k] for k in long[part]], np.asarray(weights, dtype=float)[long[part]], units, total)
    return total


def split_words(text: str | None) -> list[bytes]:
    """Words by ASCII white space, A-Z in lower case, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def count_words(docs: DataFrame, flush: int = 250_000) -> DataFrame:
    """word, n_train and n_all of all words of ``docs`` (text, held_out); the
    empty word counts the ends of documents."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = (Counter(), Counter())

        def emptied() -> pd.DataFrame:
            train, held = counts
            words = list(train) + [w for w in held if w not in train]
            n_train = np.fromiter((train.get(w, 0) for w in words), dtype=np.int64, count=len(words))
            n_held = np.fromiter((held.get(w, 0) for w in words), dtype=np.int64, count=len(words))
            train.clear()
            held.clear()
            return pd.DataFrame({"word": pd.Series(words, dtype=object), "n_train": n_train, "n_all": n_train + n_held})

        for batch in batches:
            for text, held in zip(batch["text"], batch["held_out"]):
                own = counts[bool(held)]
                own.update(split_words(text))
                own[b""] += 1
                if len(counts[0]) + len(counts[1]) > flush:
                    yield emptied()
        if counts[0] or counts[1]:
            yield emptied()

    parts = docs.select("text", "held_out").mapInPandas(work, "word binary, n_train long, n_all long")
    return parts.groupBy("word").agg(F.sum("n_train").alias("n_train"), F.sum("n_all").alias("n_all"))


def learn_units(counted: DataFrame, n_ends: int, path: str | None = None, rounds: int = 2, prior: float = 1000.0) -> tuple[Units, float]:
    """Unit log-probabilities and that of an end, from the vocabulary's own
    weights by ``rounds`` of expectation-maximisation over all training words.

    Each task sums its expected counts; a number for each unit is what comes
    to the driver. The vocabulary's weights stay as ``prior`` pseudo-counts.
    """
    pieces, start = vocabulary(path)
    train = counted.where("n_train > 0 and word <> X''").select("word", "n_train")
    p = start
    p_end = 0.1
    for _ in range(rounds):
        units = Units(pieces, np.log(p))

        def work(batches: Iterator[pd.DataFrame], units: Units = units) -> Iterator[pd.DataFrame]:
            total = np.zeros(len(units.pieces))
            for batch in batches:
                total += expected_counts(list(map(bytes, batch["word"])), batch["n_train"].to_numpy(float), units)
            used = np.flatnonzero(total)
            yield pd.DataFrame({"unit": used.astype(np.int32), "n": total[used]})

        sums = np.zeros(len(pieces))
        for row in train.mapInPandas(work, "unit int, n double").groupBy("unit").agg(F.sum("n").alias("n")).collect():
            sums[row["unit"]] = row["n"]
        whole = sums.sum() + prior + n_ends + 1
        p_end = (n_ends + 1) / whole
        p = (sums + prior * start) / whole
    return Units(pieces, np.log(p)), math.log(p_end)


def _bucket(h: np.ndarray, n: int) -> np.ndarray:
    return (h % np.uint64(n)).astype(np.int32)


def _word_hash(words: list[bytes]) -> np.ndarray:
    if not words:
        return np.array([], dtype=np.uint64)
    column = np.empty(len(words), dtype=object)
    column[:] = words
    return pd.util.hash_array(column, categorize=False)


def score_documents(docs: DataFrame, path: str | None = None, hot_share: int = 32_768, per_bucket: int = 2_000_000) -> DataFrame:
    """Scores of all rows of ``docs`` (doc_id, text, held_out).

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score (the
    add-one unigram score of whole words) and score (log10 of the probability
    of the text summed over all segmentations). Null and blank texts hold one
    end token.

    1. Words are counted over all documents; each different word's marginal
       probability is computed once (``learn_units``, ``word_log_probs``).
    2. Words that make 1 / ``hot_share`` of all tokens or more (so at most
       ``hot_share`` words) are looked up where the document is read.
    3. All others meet their documents by hash: slices of documents give each
       bucket one array of (document, word hash, count), buckets are cut so
       that they hold about ``per_bucket`` words, and sums return by slice.
    """
    counted = common.settled(count_words(docs))
    n, v, tokens, ends = counted.agg(
        F.coalesce(F.sum("n_train"), F.lit(0)), F.count_if(F.col("n_train") > 0), F.coalesce(F.sum("n_all"), F.lit(0)), F.coalesce(F.sum(F.when(F.expr("word = X''"), F.col("n_train"))), F.lit(0))
    ).first()
    units, end = learn_units(counted, int(ends), path)
    end_count = int(ends)
    n_buckets = max(1, math.ceil(tokens / per_bucket / 2))
    hot_floor = max(1, math.ceil(tokens / hot_share))

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            words = list(map(bytes, batch["word"]))
            h = _word_hash(words)
            yield pd.DataFrame(
                {
                    "word": pd.Series([w if c >= hot_floor else None for w, c in zip(words, batch["n_all"])], dtype=object),
                    "h": h.view(np.int64),
                    "bucket": _bucket(h, n_buckets),
                    "n_train": batch["n_train"],
                    "n_all": batch["n_all"],
                    "logp": word_log_probs(words, units) / math.log(10),
                }
            )

    weighed = common.settled(counted.where("word <> X''").mapInPandas(weigh, "word binary, h long, bucket int, n_train long, n_all long, logp double"))
    hot_rows = weighed.where("word is not null").select("word", "n_train", "logp").collect()  # hot_share rows at most
    hot = {bytes(r["word"]): i for i, r in enumerate(hot_rows)}
    hot_count = np.array([r["n_train"] for r in hot_rows], dtype=np.int64)
    hot_logp = np.array([r["logp"] for r in hot_rows], dtype=float)
    cold = weighed.where("word is null")
    cuts = np.ones(n_buckets, dtype=np.int32)
    for r in cold.groupBy("bucket").agg(F.sum("n_all").alias("s")).collect():  # a number for each bucket
        cuts[r["bucket"]] = max(1, math.ceil(r["s"] / per_bucket / 2))

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A head row for each slice of documents, and one for each bucket."""
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            texts = batch["text"].fillna("").tolist()
            for a, b in in_slices(texts, 2_000_000):
                keys: list[bytes] = []
                times: list[int] = []
                ns, sizes = [], []
                for t in texts[a:b]:
                    words = split_words(t)
                    c = Counter(words)
                    keys += c.keys()
                    times += c.values()
                    ns.append(len(c))
                    sizes.append(len(words))
                doc = np.repeat(np.arange(b - a, dtype=np.int32), ns)
                tf = np.array(times, dtype=np.int32)
                at = np.fromiter(map(hot.get, keys, repeat(-1)), dtype=np.int64, count=len(keys))
                is_hot = at >= 0
                own, many = doc[is_hot], tf[is_hot].astype(float)
                c = hot_count[at[is_hot]] if len(hot_count) else np.zeros(0, dtype=np.int64)
                total = lambda w: np.bincount(own, weights=w, minlength=b - a)
                head = {
                    "doc_id": batch["doc_id"].iloc[a:b].astype("Int64").tolist(),
                    "held_out": batch["held_out"].iloc[a:b].tolist(),
                    "n_tokens": [x + 1 for x in sizes],
                }
                sums = (total(many * np.log10(c + 1)), total(many * (c > 0)), total(many * hot_logp[at[is_hot]] if len(hot_logp) else many))
                empty = np.array([], dtype=np.int32)
                rows = [(number, -1, 0, head["doc_id"], head["held_out"], head["n_tokens"], *sums, empty, empty.astype(np.int64), empty)]
                h = _word_hash(list(compress(keys, ~is_hot)))
                bucket, doc, tf = _bucket(h, n_buckets), doc[~is_hot], tf[~is_hot]
                order = np.argsort(bucket, kind="stable")
                edges = np.flatnonzero(np.diff(bucket[order], prepend=-1)) if len(order) else []
                for i, k in enumerate(edges):
                    part = order[k : edges[i + 1] if i + 1 < len(edges) else len(order)]
                    x = int(bucket[part[0]])
                    rows.append((number, x, number % int(cuts[x]), None, None, None, None, None, None, doc[part], h[part].view(np.int64), tf[part]))
                number += 1
                yield pd.DataFrame(rows, columns=_COLUMNS)

    dealt = common.settled(docs.select("doc_id", "text", "held_out").mapInPandas(deal, _DEALT))
    sequence = F.explode(F.sequence(F.lit(0), F.get(F.array(*[F.lit(int(x)) for x in cuts]), F.col("bucket")) - 1)) if n_buckets <= 4096 else None
    lookup = cold.select("bucket", "h", "n_train", "logp")
    if sequence is None:
        table = docs.sparkSession.createDataFrame(pd.DataFrame({"bucket": np.arange(n_buckets, dtype=np.int32), "cuts": cuts}))
        lookup = lookup.join(table, "bucket").select("bucket", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("cut"), "h", "n_train", "logp")
    else:
        lookup = lookup.select("bucket", sequence.alias("cut"), "h", "n_train", "logp")

    def meet(words: pd.DataFrame, slices: pd.DataFrame) -> pd.DataFrame:
        out = []
        order = np.argsort(words["h"].to_numpy())
        keys, count, logp = (words[c].to_numpy()[order] for c in ("h", "n_train", "logp"))
        for r in slices.itertuples():
            at = np.searchsorted(keys, r.word)
            c, tf = count[at], np.asarray(r.times, dtype=float)
            found, doc = np.unique(r.doc, return_inverse=True)
            total = lambda w: np.bincount(doc, weights=w, minlength=len(found))  # noqa: B023, E731
            out.append((r.number, found.astype(np.int32), total(tf * np.log10(c + 1)), total(tf * (c > 0)), total(tf * logp[at])))
        return pd.DataFrame(out, columns=["number", "doc", "base", "known", "lattice"])

    sums = (
        lookup.groupBy("bucket", "cut")
        .cogroup(dealt.where("bucket >= 0").select(F.col("bucket").alias("b"), F.col("cut").alias("c"), "number", "doc", "word", "times").groupBy("b", "c"))
        .applyInPandas(meet, "number long, doc array<int>, base array<double>, known array<double>, lattice array<double>")
    )
    heads = dealt.where("bucket < 0").select("number", "doc_id", "held_out", "n_tokens", "base", "known", "lattice", F.lit(None).cast("array<int>").alias("doc"))
    lean = sums.select("number", *[F.lit(None).cast(t).alias(c) for c, t in (("doc_id", "array<long>"), ("held_out", "array<boolean>"), ("n_tokens", "array<long>"))], "base", "known", "lattice", "doc")
    log_n = math.log10(int(n) + int(v) + 1)
    log_end = end / math.log(10)

    def gather(pdf: pd.DataFrame) -> pd.DataFrame:
        head = pdf[pdf["doc_id"].notna()].iloc[0]
        base, known, lattice = (np.array(head[c], dtype=float) for c in ("base", "known", "lattice"))
        for r in pdf[pdf["doc_id"].isna()].itertuples():
            base[r.doc] += r.base
            known[r.doc] += r.known
            lattice[r.doc] += r.lattice
        size = np.array(head["n_tokens"], dtype=np.int64)
        ids = pd.array([None if x is None or x != x else int(x) for x in head["doc_id"]], dtype="Int64")
        return pd.DataFrame(
            {
                "doc_id": ids,
                "held_out": np.array(head["held_out"], dtype=bool),
                "n_tokens": size,
                "n_known": known.round().astype(np.int64) + int(end_count > 0),
                "train_tokens": int(n),
                "base_score": base + math.log10(end_count + 1) - size * log_n,
                "score": lattice + log_end,
            }
        )

    result = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return heads.select(*lean.columns).unionByName(lean).groupBy("number").applyInPandas(gather, result)


_COLUMNS = ["number", "bucket", "cut", "doc_id", "held_out", "n_tokens", "base", "known", "lattice", "doc", "word", "times"]
_DEALT = (
    "number long, bucket int, cut int, doc_id array<long>, held_out array<boolean>, n_tokens array<long>, base array<double>, "
    "known array<double>, lattice array<double>, doc array<int>, word array<long>, times array<int>"
)


def op10_subword_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every document; learned from those not held out."""
    held = F.coalesce(common.crc_bucket(F.col("doc_id"), 7) == 2, F.lit(False))
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", held.alias("held_out"))
    return score_documents(docs)
