"""Log-bilinear language model, trained by noise-contrastive estimation in numpy.

Tokens are the words of a text, ASCII letters folded to lower case, and one end
mark. All training tokens of the corpus are counted; those counts give the base
score, sum log10((c + 0.5) / (N + 0.5 (V + 1))).

The model predicts a token's class from the two classes before it. The
``n_words`` most frequent tokens are classes of their own; every other word
falls into one of ``n_tails`` classes by its last letters and is then drawn from
its class by the base probabilities, so the token probabilities sum to one over
all known words and one unknown word per class. With context vectors R, position
matrices C1 and C2, target vectors Q and biases b,

    s(w | u, v) = (R[v] C1 + R[u] C2) . Q[w] + b[w].

Training runs over all training tokens, in rounds over disjoint slices of the documents
that grow from a sixteenth to a half (``SLICES``): in a round every partition goes on from
the same parameters by stochastic gradient steps on its own tokens, with noise from the
unigram classes of all of them, and the partitions' parameters are averaged by their
tokens, in a shuffle. What is learnt from thus grows with the corpus; a small one is gone
over several times, until ``LEAST_TOKENS`` tokens or ``MOST_EPOCHS``.
Scores are exactly normalised: the sums over w for all pairs (u, v) are one
matrix product exp(G1 + b) exp(G2)^T, G1 and G2 being the products of the context
and target matrices.

The number of classes is fixed, as the table of normalisers has its square. Counts of the
``n_frequent`` commonest words go to every task (a fixed bound), and that of the end mark;
rarer words meet their counts in a shuffled join on a 64-bit hash, pre-aggregated
by document, so no word's rows can fill a task.

Null and empty texts hold the end mark only. Equal rows are scored alike and all
kept; a null id counts as training. An empty table gives an empty result.
"""

from __future__ import annotations

import copy
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_of, cut, ids_of, small_batches, texts_of
from .decontaminate import PIECE as TEXT_PIECE
from .decontaminate import _piece_words

N_WORDS = 1536
N_TAILS = 512
N_FREQUENT = 1 << 17
DIM = 24
#: Sixteenths of the documents that the rounds of an epoch take.
SLICES = ((0, 1), (1, 4), (4, 8), (8, 16))
LEAST_TOKENS, MOST_EPOCHS = 2_000_000, 6
BATCH, NOISE, RATE = 2048, 48, 0.1
END = b"\n"
#: Words held by a worker's lookup before it starts afresh.
MEMO = 200_000
#: Bytes of texts that are scored at once.
GROUP = 1 << 19
#: ASCII letters folded, all white space one sign.
_FOLD = bytes(32 if 9 <= c <= 13 else c + 32 if 65 <= c <= 90 else c for c in range(256))


def word_hash(word: bytes) -> int:
    h = xxhash.xxh64_intdigest(word)
    return h - (1 << 64) if h >= 1 << 63 else h


def tail_class(word: bytes, n_tails: int = N_TAILS) -> int:
    """Class of a word by its last four bytes."""
    return xxhash.xxh64_intdigest(word[-4:], 7) % n_tails


def keys_of(words: list[bytes]) -> np.ndarray:
    """A second 64-bit hash of each word, one that numpy works out for a whole text at once (``Classer``)."""
    return _piece_words(b" ".join(words))[0].view(np.int64)


class Classer:
    """Whole texts -> places of their tokens among known words, and model classes, without a step in Python for each word."""

    def __init__(self, keys: np.ndarray, cls: np.ndarray, n_words: int):
        self.order = np.argsort(keys).astype(np.int32)
        self.keys, self.cls = keys[self.order], cls[self.order].astype(np.uint16)
        self.n_words, self.tails = n_words, {}

    def tail_classes(self, a: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """``tail_class`` of words by their bounds in ``a``; a space stands for bytes that a word does not have."""
        packed = np.zeros(len(ends), np.uint32)
        for k in range(4, 0, -1):
            at = ends - k
            packed = packed << np.uint32(8) | np.where(at >= starts, a[np.maximum(at, 0)], 32).astype(np.uint32)
        some, inverse = np.unique(packed, return_inverse=True)
        for x in some.tolist():
            if x not in self.tails:
                self.tails[x] = tail_class(x.to_bytes(4, "big").lstrip(b" "))
        out = np.fromiter(map(self.tails.__getitem__, some.tolist()), np.uint16, len(some))[inverse]
        if len(self.tails) > MEMO:
            self.tails.clear()
        return out

    def texts(self, texts: list[bytes], rare: list[bytes] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(class, place or -1) of the texts' tokens, one text after the other, each with its end mark; words without a place go to ``rare``."""
        b = b"".join([t.translate(_FOLD) + b" \n " for t in texts])
        out, places, at = [np.zeros(0, np.uint16)], [np.zeros(0, np.int32)], 0
        while at < len(b):
            end = len(b) if len(b) - at <= TEXT_PIECE else b.rfind(b" ", at + 1, at + TEXT_PIECE)
            if end < 0:  # one word fills the piece; the last sign is a space
                end = b.find(b" ", at + TEXT_PIECE)
            piece = b[at:end]
            at = end
            h, starts, ends = _piece_words(piece)
            h = h.view(np.int64)
            near = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
            cls, place = self.cls[near], self.order[near]
            far = np.flatnonzero(self.keys[near] != h)
            cls[far] = self.n_words + self.tail_classes(np.frombuffer(piece, np.uint8), starts[far], ends[far])
            place[far] = -1
            if rare is not None:
                rare.extend([piece[x:y] for x, y in zip(starts[far].tolist(), ends[far].tolist())])
            out.append(cls)
            places.append(place)
        return np.concatenate(out), np.concatenate(places)


def triples(cls: np.ndarray, end: int) -> np.ndarray:
    """(class two before, one before, own class) of every token of texts that follow each other."""
    out = np.full((3, len(cls)), end, np.uint16)
    out[2], out[1, 1:], out[0, 2:] = cls, cls[:-1], cls[:-2]
    out[0, out[1] == end] = end
    return out


def train_rows(ids: list) -> np.ndarray:
    return crc_of(ids) % 5 != 1


def count_tokens(docs: DataFrame) -> DataFrame:
    """(h, key, tail, c): every training token's hash, ``keys_of`` hash, tail class and count."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            words = list(held)
            return pa.RecordBatch.from_arrays([pa.array([word_hash(w) for w in words], pa.int64()), pa.array(keys_of(words)), pa.array([tail_class(w) for w in words], pa.int32()), pa.array(list(held.values()), pa.int64())], ["h", "key", "tail", "c"])

        for b in batches:
            for t, use in zip(texts_of(b), train_rows(ids_of(b))):
                if use:
                    held.update(t.lower().split())
                    held[END] += 1
                    if len(held) > MEMO:
                        yield out()
                        held.clear()
        if held:
            yield out()

    return docs.select("doc_id", "text").mapInArrow(run, "h long, key long, tail int, c long").groupBy("h").agg(F.min("key").alias("key"), F.min("tail").alias("tail"), F.sum("c").alias("c"))


class Trainer:
    """R, C1, C2 and Q, whose last column is b, fitted by noise-contrastive estimation with Adagrad."""

    KEYS = ("R", "C1", "C2", "Q")

    def __init__(self, unigram: np.ndarray, dim: int = DIM, seed: int = 5):
        rng = np.random.default_rng(seed)
        n = len(unigram)
        p = {"R": rng.normal(0, 0.1, (n, dim)), "C1": np.eye(dim), "C2": np.eye(dim) * 0.3, "Q": np.column_stack([rng.normal(0, 0.1, (n, dim)), np.log(unigram)])}
        self.p = {k: p[k].astype(np.float32) for k in self.KEYS}
        self.g2 = {k: np.full_like(v, 1e-3) for k, v in self.p.items()}
        self.unigram = unigram

    def start(self, seed: int) -> None:
        self.rng = np.random.default_rng(seed)
        self.log_noise = np.log(self.unigram * NOISE).astype(np.float32)
        self.cum = np.cumsum(self.unigram)
        self.held = {}

    def room(self, name: str, *shape: int) -> np.ndarray:
        """An array that later steps use again, so that a step asks the system for no memory."""
        got = self.held.get((name, *shape))
        if got is None:
            got = self.held[name, *shape] = np.empty(shape, self.p["Q"].dtype)
        return got

    def step(self, k: str, rows: np.ndarray | None, grad: np.ndarray) -> None:
        p, g2 = self.p[k], self.g2[k]
        if rows is not None:
            width = p.shape[1]
            summed = self.room(f"sum {k}", p.size)
            summed.fill(0)
            at = self.held.setdefault(("at", *grad.shape), np.empty(grad.shape, np.int64))
            np.add((rows * width)[:, None], np.arange(width), out=at)
            np.add.at(summed, at.ravel(), grad.ravel())
            grad = summed.reshape(p.shape)
        x = self.room(f"step {k}", *p.shape)
        g2 += np.multiply(grad, grad, out=x)
        np.sqrt(g2, out=x)
        np.divide(grad, x, out=x)
        x *= np.float32(RATE)
        p -= x

    def learn(self, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> None:
        """One step on tokens of classes w after u and v."""
        p, m, d = self.p, len(w), self.p["C1"].shape[0]
        u, v, w = (x.astype(np.int64) for x in (u, v, w))
        z = np.minimum(np.searchsorted(self.cum, self.rng.random(NOISE)), len(self.cum) - 1)
        # the biases are the targets' last column; both contexts lie in one array, the nearer first
        vu, wz = np.concatenate([v, u]), np.concatenate([w, z])
        r = p["R"].take(vu, axis=0, out=self.room("r", 2 * m, d), mode="clip")
        q = p["Q"].take(wz, axis=0, out=self.room("q", m + NOISE, d + 1), mode="clip")
        rv, ru, qw, qz = r[:m], r[m:], q[:m], q[m:]
        h, mid = self.room("h", m, d + 1), self.room("mid", m, d)
        h[:, d] = 1
        np.add(np.matmul(rv, p["C1"], out=mid), ru @ p["C2"], out=h[:, :d])
        s_pos = np.einsum("ij,ij->i", h, qw) - self.log_noise[w]
        d_pos = (-1 / m) / (1 + np.exp(np.minimum(s_pos, 30)))
        # gradients of the noise, 1 / (1 + exp(-s)) / m
        d_neg = np.matmul(h, qz.T, out=self.room("neg", m, NOISE))
        d_neg -= self.log_noise[z]
        np.negative(d_neg, out=d_neg)
        np.minimum(d_neg, 30, out=d_neg)
        np.exp(d_neg, out=d_neg)
        d_neg += 1
        np.divide(d_neg.dtype.type(1 / m), d_neg, out=d_neg)
        dh = np.matmul(d_neg, qz[:, :d], out=self.room("dh", m, d))
        dh += np.multiply(d_pos[:, None], qw[:, :d], out=mid)
        to_r, to_q = self.room("to r", 2 * m, d), self.room("to q", m + NOISE, d + 1)
        np.matmul(dh, p["C1"].T, out=to_r[:m])
        np.matmul(dh, p["C2"].T, out=to_r[m:])
        np.multiply(d_pos[:, None], h, out=to_q[:m])
        np.matmul(d_neg.T, h, out=to_q[m:])
        d1, d2 = rv.T @ dh, ru.T @ dh
        self.step("Q", wz, to_q)
        self.step("R", vu, to_r)
        self.step("C1", None, d1)
        self.step("C2", None, d2)

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for held in (self.p, self.g2) for x in (held[k] for k in self.KEYS)])

    def load(self, flat: np.ndarray) -> None:
        at = 0
        for held in (self.p, self.g2):
            for k in self.KEYS:
                n = held[k].size
                held[k] = flat[at : at + n].astype(np.float32).reshape(held[k].shape)
                at += n


#: Numbers in a piece of the parameters that partitions send to be averaged.
PIECE = 1 << 14


def averaged(pieces: DataFrame) -> np.ndarray:
    """Mean of the partitions' parameters, weighted by tokens; summed in the tasks of a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        for b in batches:
            for k, n, x in zip(*(ids_of(b, c) for c in ("piece", "n", "x"))):
                held = total.setdefault(k, [0.0, 0.0])
                held[0] += n
                held[1] = held[1] + n * np.frombuffer(x, np.float32).astype(np.float64)
        keys = sorted(total)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array([(total[k][1] / total[k][0]).astype(np.float32).tobytes() for k in keys], pa.binary())], ["piece", "x"])

    got = pieces.repartition("piece").mapInArrow(run, "piece int, x binary").toArrow().to_pydict()
    return np.concatenate([np.frombuffer(x, np.float32) for _, x in sorted(zip(got["piece"], got["x"]))]) if got["x"] else np.zeros(0, np.float32)


def train(docs: DataFrame, keys: np.ndarray, end: int, unigram: np.ndarray, n: int) -> dict[str, np.ndarray]:
    """Parameters learnt from all training tokens; see the module. ``keys`` are those of the words with a class of their own."""
    spark = docs.sparkSession
    model = Trainer(unigram)
    rest = F.pmod(F.coalesce(F.crc32(F.col("doc_id").cast("string")), F.lit(0)), F.lit(5))
    place = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(23)), F.lit(16))
    epochs = max(1, min(MOST_EPOCHS, -(-LEAST_TOKENS // max(n, 1)))) if n else 0
    for turn, (low, high) in enumerate(SLICES * epochs):
        held = spark.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch], held=held, turn=turn) -> Iterator[pa.RecordBatch]:
            look, mine, n, left = Classer(keys, np.arange(len(keys)), len(keys)), copy.deepcopy(held.value), 0, []
            for b in batches:
                if not n:
                    mine.start(int(crc_of(ids_of(b))[0]) + turn if b.num_rows else turn)
                left.append(triples(look.texts(texts_of(b))[0], end))
                every = np.concatenate(left, axis=1)
                # tokens of one text are dealt over the steps
                every = every[:, mine.rng.permutation(every.shape[1])]
                full = every.shape[1] // BATCH * BATCH
                for k in range(0, full, BATCH):
                    mine.learn(*every[:, k : k + BATCH])
                n += full
                left = [every[:, full:]]
            if left and left[0].shape[1]:
                mine.learn(*left[0])
                n += left[0].shape[1]
            if n:
                flat = mine.flat()
                parts = [flat[k : k + PIECE].tobytes() for k in range(0, len(flat), PIECE)]
                yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([n] * len(parts), pa.int64()), pa.array(parts, pa.binary())], ["piece", "n", "x"])

        some = docs.where((rest != 1) & (place >= low) & (place < high)).select("doc_id", "text")
        flat = averaged(some.mapInArrow(run, "piece int, n long, x binary"))
        if len(flat):
            model.load(flat)
        held.unpersist()
    return model.p


def normalised(p: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Tables whose sum G1[v, w] + G2[u, w] - log_z[u, v] is the exact natural log-probability."""
    q = p["Q"][:, :-1].astype(np.float64).T
    g1 = p["R"].astype(np.float64) @ p["C1"] @ q + p["Q"][:, -1]
    g2 = p["R"].astype(np.float64) @ p["C2"] @ q
    m1, m2 = g1.max(axis=1, keepdims=True), g2.max(axis=1, keepdims=True)
    z = np.exp(g2 - m2) @ np.exp(g1 - m1).T
    log_z = np.log(np.maximum(z, 1e-300)) + m2 + m1.T
    return {"g1": g1.astype(np.float32), "g2": g2.astype(np.float32), "log_z": log_z.astype(np.float32)}


def most_frequent(counts: DataFrame, most: int) -> DataFrame:
    """The words whose counts are in the highest bands that hold at most ``most`` words; no sort is needed."""
    band = F.floor(F.log2(F.col("c")) * 16).cast("int")
    sizes = counts.groupBy(band.alias("band")).count().orderBy(F.desc("band")).collect()
    total, least = 0, 1 << 30
    for r in sizes:
        total += r["count"]
        if total > most:
            break
        least = r.band
    return counts.where(band >= least)


def fit(docs: DataFrame) -> tuple[DataFrame, dict]:
    """Counts of all training tokens and the model that scoring needs."""
    counts = cut(count_tokens(docs))
    whole = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    n, v = int(whole.n or 0), int(whole.v)
    end_hash = word_hash(END)
    # the end mark's count, whatever band of counts it falls into
    ends = counts.where(F.col("h") == F.lit(end_hash)).select("h", "tail", "c", "key").toArrow()
    top = most_frequent(counts, N_FREQUENT).where(F.col("h") != F.lit(end_hash)).select("h", "tail", "c", "key").toArrow()
    h, tails, c, keys = (np.concatenate([x.column(k).to_numpy() for x in (top, ends)]) for k in range(4))
    if not len(ends):  # no training document
        h, tails, c, keys = np.append(h, end_hash), np.append(tails, 0), np.append(c, 0), np.append(keys, keys_of([END]))
    order = np.argsort(h)
    hashes, tails, c, keys = h[order].astype(np.int64), tails[order].astype(np.int64), c[order].astype(np.float64), keys[order].astype(np.int64)
    words = hashes[np.lexsort((hashes, -c))[:N_WORDS]]
    if end_hash not in words:
        words = np.append(words[: N_WORDS - 1], end_hash)
    size = len(words) + N_TAILS
    frequent_class = len(words) + tails
    frequent_class[np.searchsorted(hashes, words)] = np.arange(len(words))
    denominator = n + 0.5 * (v + 1)
    base = np.log10((c + 0.5) / denominator)
    # mass of every tail class over all its words, with one unknown word
    mass = np.full(N_TAILS, 0.5)
    named = counts.where(~F.col("h").isin(words.tolist()))
    for r in named.groupBy("tail").agg(F.sum(F.col("c") + F.lit(0.5)).alias("m")).collect():
        mass[r.tail] += r.m
    word_mass = np.array([c[np.searchsorted(hashes, w)] for w in words]) + 0.5
    unigram = np.concatenate([word_mass, mass])
    unigram /= unigram.sum()
    end = int(np.nonzero(words == end_hash)[0][0])
    model = normalised(train(docs, keys[np.searchsorted(hashes, words)], end, unigram, n)) | {"keys": keys, "cls": frequent_class, "base": base, "seen": c > 0, "log_mass": np.log10(mass / denominator), "n_words": len(words), "end": end, "n": n, "denominator": denominator, "size": size}
    return counts, model


def score_texts(texts: list[bytes], look: Classer, m: dict) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, ...]]:
    """(n_tokens, known, base, model) of every text but for the base log-probabilities of rare words, and (text, hash, times) of these."""
    rare: list[bytes] = []
    cls, place = look.texts(texts, rare)
    u, v, w = triples(cls, m["end"]).astype(np.int64)
    ends = np.flatnonzero(w == m["end"])
    starts = np.concatenate([[0], ends[:-1] + 1])
    near, tail = place >= 0, w >= m["n_words"]
    base, known = np.zeros(len(w)), np.zeros(len(w), np.int64)
    base[near], known[near] = m["base"][place[near]], m["seen"][place[near]]
    logp = (m["g1"][v, w] + m["g2"][u, w] - m["log_z"][u, v]).astype(np.float64) / math.log(10)
    logp[tail] += base[tail] - m["log_mass"][w[tail] - m["n_words"]]
    sums = [np.add.reduceat(x, starts) for x in (known, base, logp)]
    h = np.fromiter(map(word_hash, rare), np.int64, len(rare))
    text = np.searchsorted(ends, np.flatnonzero(~near))
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (text[1:] != text[:-1])])) if len(h) else np.zeros(0, np.int64)
    return (ends - starts + 1, *sums), (text[first], h[first], np.diff(np.append(first, len(h))))


def groups(texts: list[bytes]) -> Iterator[slice]:
    """Runs of texts of about ``GROUP`` bytes, a longer text alone."""
    low, size = 0, 0
    for k, t in enumerate(texts):
        size += len(t)
        if size >= GROUP or k == len(texts) - 1:
            yield slice(low, k + 1)
            low, size = k + 1, 0


STAT = "struct<doc_id: bigint, held_out: boolean, n_tokens: bigint, n_known: bigint, base: double, score: double>"


def score(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every document."""
    counts, model = fit(docs)
    held = docs.sparkSession.sparkContext.broadcast(model)
    stat_type = T._parse_datatype_string(STAT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        look = Classer(m["keys"], m["cls"], m["n_words"])
        kind = pa.struct([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64())])
        for b in batches:
            every, texts = ids_of(b), texts_of(b)
            for some in groups(texts):
                ids = every[some]
                figures, (at, h, tf) = score_texts(texts[some], look, m)
                rids = np.array([word_hash(b"%d:" % i + t if i is not None else b":" + t) for i, t in zip(ids, texts[some])], np.int64)
                stats = pa.StructArray.from_arrays([pa.array(ids, pa.int64()), pa.array(~train_rows(ids)), *map(pa.array, figures)], fields=list(kind))
                # the row's own figures travel under a hash of their own
                cols = [pa.array(np.concatenate([rids, h])), pa.array(np.concatenate([rids, rids[at]])), pa.array(np.concatenate([np.zeros(len(ids)), tf]).astype(np.int32)), pa.concat_arrays([stats, pa.nulls(len(h), kind)])]
                yield pa.RecordBatch.from_arrays(cols, ["h", "rid", "tf", "stat"])

    schema = T.StructType([T.StructField("h", T.LongType()), T.StructField("rid", T.LongType()), T.StructField("tf", T.IntegerType()), T.StructField("stat", stat_type)])
    rows = docs.select("doc_id", "text").mapInArrow(run, schema)
    logp = F.log10((F.coalesce("c", F.lit(0)) + 0.5) / F.lit(float(model["denominator"])))
    summed = rows.join(counts.select("h", "c"), "h", "left").groupBy("rid").agg(F.sum(F.col("tf") * logp).alias("rare"), F.sum(F.when(F.col("c").isNotNull(), F.col("tf")).otherwise(0)).alias("known"), F.sum(F.when(F.col("stat").isNotNull(), 1).otherwise(0)).alias("copies"), F.max("stat").alias("s"))
    each = summed.withColumn("_", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    rare = F.col("rare") / F.col("copies")
    return each.select("s.doc_id", "s.held_out", "s.n_tokens", (F.col("s.n_known") + F.col("known") / F.col("copies")).cast("long").alias("n_known"), F.lit(int(model["n"])).cast("long").alias("train_tokens"), (F.col("s.base") + rare).alias("base_score"), (F.col("s.score") + rare).alias("score"))
