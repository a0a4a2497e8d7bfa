"""Language-model scoring by masked pseudo-likelihood (operator 1).

A bidirectional window network predicts every token from the tokens to both of its sides.  A document's score is the
sum of those conditional log-probabilities.

1. Tokens are lower-case words.  Texts are cut into words once: each block of documents becomes numbers of its own, with a
   dictionary, whose counts are added up by shuffle over all documents.
2. The commonest words have an id each, the others share ``hashed`` ids, so the network has ``side * side`` ids whatever
   the input.  A rare word's probability is the network's for its id times the word's share of all tokens of that id; the
   counts of all words, however many, go back to the dictionaries by shuffle.  One more token an id is kept for words that
   were never counted, so that no word has probability zero.
3. Network: one input table per window position, summed and squashed to a hidden layer; the output is factored into a
   class of ``side`` and a member of ``side`` given class and hidden layer, which sums to one over all ids.
4. Training: every token of every document is a target, in one of every ``stride`` rounds; by its position in its document
   it takes turns with its neighbours, so that only a document shorter than the stride skips a round.  Documents are dealt
   by a hash of their ids into groups of about GROUP_TOKENS; each group starts from the same parameters, runs Adagrad over
   its documents in the order of their hashes, and the mean of all groups' parameters, weighted by tokens, starts the next
   round.  Groups depend on the documents alone, not on files or partitions, so neither do scores.  Equal documents are
   one row with a number of copies, which are spread over the groups, so no group grows with a hot document.

Defined cases: a null or wordless text has no tokens, score 0.0 and a null mean; words beyond the text's ends are a pad
id; equal texts get equal scores, so do repeated rows; ties between common words go by the word; a text is read and scored
whole, however long; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow, cut, give_back, release, slices
from .fingerprints import words_of

SIDE, HASHED, HIDDEN, WINDOW = 64, 256, 32, 2
#: With as many rounds as the stride every token is a target.
ROUNDS, STRIDE, STEP, BATCH = 2, 2, 0.1, 2048
#: Tokens of a group that trains by itself.
GROUP_TOKENS = 2_000_000
#: A block of documents ends beyond so many distinct words, or tokens.
WORDS_HELD, TOKENS_HELD = 200_000, 4_000_000
#: Parameters that are averaged as one row; groups that are averaged together.
_BLOCK, _FAN = 1 << 13, 256
_UNITS = float(1 << 30)


class _Numbers(dict):
    """Words, numbered as they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


@dataclass(frozen=True)
class Corpus:
    """``texts``: (block, id, codes) of every row; ``words``: (block, words, times), the dictionary of each block.  Both are views of one cut."""

    whole: DataFrame
    id_col: str

    @property
    def texts(self) -> DataFrame:
        return self.whole.filter("_words IS NULL").select("_block", self.id_col, "_codes")

    @property
    def words(self) -> DataFrame:
        zipped = F.arrays_zip(F.col("_words").alias("w"), F.col("_times").alias("t"))
        each = self.whole.filter("_words IS NOT NULL").select("_block", F.posexplode(zipped).alias("pos", "x"))
        return each.select("_block", "pos", F.col("x.w").alias("word"), F.col("x.t").alias("times"))


def read(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Corpus:
    """All texts as numbers of their blocks' words."""
    kind = docs.schema[id_col].dataType.simpleString()

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, times, tokens, number, names = _Numbers(), np.zeros(0, np.int64), 0, 0, ["_block", id_col, "_codes", "_words", "_times"]

        def dictionary() -> pa.RecordBatch:
            cols = [pa.array([block], pa.int64()), pa.nulls(1, id_type), pa.nulls(1, pa.binary()), pa.array([list(known)], pa.list_(pa.binary())), pa.array([times.tolist()], pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays(cols, names)

        for b in slices(batches, text_col):
            block, id_type = (b.column("_pid")[0].as_py() << 32) + number, b.column(id_col).type
            codes = [array("I", map(known.__getitem__, words_of(t or ""))).tobytes() for t in b.column(text_col).to_pylist()]
            n = b.num_rows
            yield pa.RecordBatch.from_arrays([pa.array([block] * n, pa.int64()), b.column(id_col), pa.array(codes, pa.binary()), pa.nulls(n, pa.list_(pa.binary())), pa.nulls(n, pa.list_(pa.int64()))], names)
            flat = np.frombuffer(b"".join(codes), np.uint32)
            grown = np.bincount(flat, minlength=len(known))
            grown[: len(times)] += times
            times, tokens = grown, tokens + len(flat)
            if len(known) > WORDS_HELD or tokens > TOKENS_HELD:
                yield dictionary()
                known, times, tokens, number = _Numbers(), np.zeros(0, np.int64), 0, number + 1
        if known:
            yield dictionary()

    rows = arrow(docs.select(F.spark_partition_id().alias("_pid"), id_col, text_col), kernel, f"_block long, `{id_col}` {kind}, _codes binary, _words array<binary>, _times array<long>")
    return Corpus(cut(rows, "coded"), id_col)


def word_counts(corpus: Corpus) -> DataFrame:
    """(word, n) of all words of all documents."""
    return cut(corpus.words.groupBy("word").agg(F.sum("times").alias("n")), "words")


@dataclass(frozen=True)
class Vocabulary:
    """``common``: words that have an id of their own, with their counts; ``totals``: tokens that share each hashed id."""

    common: list[tuple[bytes, int]]
    totals: list[int]
    side: int = SIDE

    @property
    def hashed(self) -> int:
        return len(self.totals)

    @property
    def first(self) -> int:
        """The first hashed id."""
        return self.side * self.side - self.hashed

    def bucket(self, word: str = "word"):
        """The hashed id, from 0, that a word shares if it isn't common."""
        return (F.crc32(word) % self.hashed).cast("int")

    def table(self, spark) -> DataFrame:
        """(word, nid) of common words: as many rows as the network has ids."""
        return spark.createDataFrame([(bytearray(w), i) for i, (w, _) in enumerate(self.common)], "word binary, nid int")

    def start(self) -> np.ndarray:
        """Tokens of each id."""
        out = np.zeros(self.side * self.side)
        out[: len(self.common)] = [n for _, n in self.common]
        out[self.first :] = self.totals
        return out

    def ids(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, tokens of each)."""
        known = {w: i for i, (w, _) in enumerate(self.common)}
        split = [words_of(t or "") for t in texts]
        return np.array([known.get(w, self.first + crc32(w) % self.hashed) for words in split for w in words], np.int64), np.array([len(x) for x in split], np.int64)


def vocabulary(counts: DataFrame, side: int = SIDE, hashed: int = HASHED) -> Vocabulary:
    """The most frequent words, ties by the word, and what the others share."""
    common = [(bytes(r["word"]), int(r["n"])) for r in counts.orderBy(F.desc("n"), "word").limit(side * side - hashed).collect()]
    empty = Vocabulary(common, [0] * hashed, side)
    rare = counts.join(F.broadcast(empty.table(counts.sparkSession).select("word")), "word", "left_anti")
    totals = [0] * hashed
    for r in rare.groupBy(empty.bucket().alias("b")).agg(F.sum("n").alias("n")).collect():
        totals[r["b"]] = int(r["n"])
    return Vocabulary(common, totals, side)


def numbered(corpus: Corpus, words: Vocabulary, counts: DataFrame) -> DataFrame:
    """(id, n_tokens, ids, share): per document its ids of the network, and the sum of its rare words' log-shares of theirs."""
    id_col, kind = corpus.id_col, corpus.whole.schema[corpus.id_col].dataType.simpleString()
    known = corpus.words.join(F.broadcast(words.table(counts.sparkSession)), "word", "left")
    common = known.filter("nid IS NOT NULL").select("_block", "pos", "nid", F.lit(0).cast("long").alias("n"))
    rare = known.filter("nid IS NULL").join(counts, "word", "left").select("_block", "pos", (F.lit(words.first) + words.bucket()).alias("nid"), F.coalesce("n", F.lit(0).cast("long")).alias("n"))
    first, totals = words.first, np.array(words.totals, np.float64)

    def kernel(texts: pa.Table, known: pa.Table) -> pa.Table:
        pos, nid, n = (known.column(c).to_numpy() for c in ("pos", "nid", "n"))
        of, share = np.zeros(len(pos), "<u2"), np.zeros(len(pos))
        of[pos] = nid
        own = nid >= first
        # whole units, so that a sum doesn't depend on anything but the words
        share[pos[own]] = np.rint(np.log(np.maximum(n[own], 1) / (totals[nid[own] - first] + 1)) * _UNITS)
        codes = texts.column("_codes").to_pylist()
        flat, lens = np.frombuffer(b"".join(codes), "<u4"), np.array([len(c) // 4 for c in codes], np.int64)
        raw, ends = of[flat].tobytes(), np.cumsum(lens) * 2
        shares = np.bincount(np.repeat(np.arange(len(lens)), lens), share[flat], len(lens))
        cols = [texts.column(id_col), pa.array(lens), pa.array([raw[e - 2 * k : e] for e, k in zip(ends.tolist(), lens.tolist())], pa.binary()), pa.array(shares / _UNITS)]
        give_back()
        return pa.table(cols, names=[id_col, "n_tokens", "_ids", "_share"])

    made = corpus.texts.groupBy("_block").cogroup(common.unionByName(rare).withColumnRenamed("_block", "_b").groupBy("_b"))
    return cut(made.applyInArrow(kernel, f"`{id_col}` {kind}, n_tokens long, _ids binary, _share double"), "ids")


def windows(ids: np.ndarray, lens: np.ndarray, pad: int, window: int = WINDOW) -> np.ndarray:
    """[2 * window, position]: ids to the left and right of each position, ``pad`` beyond its text."""
    doc = np.repeat(np.arange(len(lens), dtype=np.int32), lens)
    out = np.full((2 * window, len(ids)), pad, np.int64)
    for k in range(1, window + 1):
        if len(ids) > k:
            same = doc[k:] == doc[:-k]
            out[k - 1, k:][same] = ids[:-k][same]
            out[window + k - 1, :-k][same] = ids[k:][same]
    return out


def targets(lens: np.ndarray, number: int, stride: int) -> np.ndarray:
    """Positions that round ``number`` trains, of texts with ``lens`` tokens: ``stride`` rounds in a row take each position once."""
    own = np.arange(int(lens.sum())) - np.repeat(np.cumsum(lens) - lens, lens)
    return np.flatnonzero(own % stride == number % stride)


class Network:
    """Parameters in one flat array of float32, and views of it."""

    def __init__(self, side: int = SIDE, hidden: int = HIDDEN, window: int = WINDOW, flat: np.ndarray | None = None, counts: np.ndarray | None = None, seed: int = 7):
        self.side, self.hidden, self.window = side, hidden, window
        # the table has a row for each id and the pad id, at each window position
        shapes = {"table": (2 * window * (side * side + 1), hidden), "bias": (hidden,), "to_class": (hidden, side), "class_bias": (side,), "shift": (side, hidden), "to_member": (hidden, side), "member_bias": (side, side)}
        size = sum(int(np.prod(s)) for s in shapes.values())
        fresh = flat is None
        self.flat = np.zeros(size, np.float32) if fresh else flat.astype(np.float32)
        at = 0
        for name, s in shapes.items():
            n = int(np.prod(s))
            setattr(self, name, self.flat[at : at + n].reshape(s))
            at += n
        #: Mean squared gradients of the table's rows, where this network holds those of another.
        self.row_sums = np.zeros(len(self.table), np.float32)
        self.rows_at = (np.arange(2 * window) * (side * side + 1))[:, None]
        self.ones = np.ones(side, np.float32)
        if fresh:
            rng = np.random.default_rng(seed)
            for name, scale in (("table", 0.1), ("to_class", 0.1), ("to_member", 0.1)):
                a = getattr(self, name)
                a[...] = rng.normal(0, scale, a.shape)
            if counts is not None:  # start from the words' own frequencies
                p = (counts.reshape(side, side) + 1.0) / (counts.sum() + side * side)
                self.class_bias[...] = np.log(p.sum(1))
                self.member_bias[...] = np.log(p / p.sum(1, keepdims=True))

    def forward(self, context: np.ndarray, target: np.ndarray):
        """(log-probabilities, what the gradient needs)."""
        keys = context + self.rows_at
        h = self.table.take(keys[0], 0)
        for k in keys[1:]:
            h += self.table.take(k, 0)
        h += self.bias
        np.tanh(h, out=h)
        a, b = np.divmod(target, self.side)
        at = np.arange(len(target))
        # within these bounds no exponential overflows, and a sum of them is above zero
        la = h @ self.to_class
        la += self.class_bias
        np.clip(la, -80, 80, out=la)
        ea = np.exp(la)
        sa = ea @ self.ones
        z = h + self.shift.take(a, 0)
        lb = z @ self.to_member
        lb += self.member_bias.take(a, 0)
        np.clip(lb, -80, 80, out=lb)
        eb = np.exp(lb)
        sb = eb @ self.ones
        out = la[at, a] - np.log(sa) + lb[at, b] - np.log(sb)
        return out, (keys, h, a, b, at, ea, sa, z, eb, sb)

    def train(self, context: np.ndarray, target: np.ndarray, sums: Network, weight: np.ndarray | None = None, step: float = STEP) -> None:
        """One Adagrad step; ``sums`` holds the squared gradients so far, ``weight`` how often each position counts."""
        _, (keys, h, a, b, at, ea, sa, z, eb, sb) = self.forward(context, target)
        w = np.full(len(target), 1 / len(target), np.float32) if weight is None else (weight / weight.sum()).astype(np.float32)
        ga, gb = ea, eb
        ga *= (w / sa)[:, None]
        gb *= (w / sb)[:, None]
        ga[at, a] -= w
        gb[at, b] -= w
        dz = gb @ self.to_member.T
        dh = ga @ self.to_class.T
        dh += dz
        dh *= 1 - h * h

        def move(name: str, grad: np.ndarray, which=...) -> None:
            s, p = getattr(sums, name), getattr(self, name)
            grown = s[which] + grad * grad
            s[which] = grown
            p[which] -= step * grad / (np.sqrt(grown) + 1e-6)

        for name, grad in (("to_class", h.T @ ga), ("to_member", z.T @ gb)):
            move(name, grad)
        move("class_bias", ga.sum(0))
        move("bias", dh.sum(0))
        order = np.argsort(a.astype(np.uint16), kind="stable")
        rows, first = np.unique(a[order], return_index=True)
        move("shift", np.add.reduceat(dz.take(order, 0), first), rows)
        move("member_bias", np.add.reduceat(gb.take(order, 0), first), rows)
        # all window positions at once
        flat = keys.ravel()
        order = np.argsort(flat.astype(np.uint16) if len(self.table) < 1 << 16 else flat, kind="stable")
        flat = flat[order]
        first = np.flatnonzero(np.append(True, flat[1:] != flat[:-1]))
        rows, grad = flat[first], np.add.reduceat(dh.take(order % len(target), 0), first)
        # a row of the table has one step size
        grown = sums.row_sums[rows] + np.einsum("ij,ij->i", grad, grad) / self.hidden
        sums.row_sums[rows] = grown
        grad *= (-step / (np.sqrt(grown) + 1e-6))[:, None]
        grad += self.table.take(rows, 0)
        self.table[rows] = grad

    def score(self, ids: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """Sum of log-probabilities of each text."""
        context = windows(ids, lens, self.side * self.side, self.window)
        each = np.empty(len(ids), np.float64)
        for i in range(0, len(ids), BATCH):
            each[i : i + BATCH] = self.forward(context[:, i : i + BATCH], ids[i : i + BATCH])[0]
        return np.bincount(np.repeat(np.arange(len(lens)), lens), each, len(lens))


def dealt(ids: DataFrame, group_tokens: int = GROUP_TOKENS) -> tuple[DataFrame, int]:
    """((group, hash, ids, copies), groups): every document in a group; copies of one document are spread over all groups."""
    one = cut(ids.filter("n_tokens > 0").groupBy("_ids").agg(F.count("*").alias("_all")), "distinct")
    tokens = one.agg(F.sum(F.col("_all") * F.octet_length("_ids") / 2)).head()[0] or 0
    n = int(-(-tokens // group_tokens))
    if not n:
        return one.select(F.lit(0).cast("long").alias("group"), F.lit(0).cast("long").alias("hash"), "_ids", F.col("_all").alias("copies")), 0
    k = F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.col("_all"), F.lit(n).cast("long")) - 1))
    each = one.select("_ids", "_all", F.xxhash64("_ids").alias("hash"), k.alias("_k"))
    copies = F.floor(F.col("_all") / n) + F.when(F.col("_k") < F.col("_all") % n, 1).otherwise(0)
    return each.select(F.pmod(F.col("hash") + F.col("_k"), F.lit(n).cast("long")).alias("group"), "hash", "_ids", copies.cast("long").alias("copies")), n


def train_round(groups: DataFrame, n_groups: int, network: Network, number: int, stride: int = STRIDE) -> Network:
    """The mean of what all groups make of ``network``."""
    start = groups.sparkSession.sparkContext.broadcast((network.flat, network.side, network.hidden, network.window))
    pad = network.side * network.side

    def local(table: pa.Table) -> pa.Table:
        flat, side, hidden, window = start.value
        net, sums = Network(side, hidden, window, flat.copy()), Network(side, hidden, window, np.zeros_like(flat))
        # the order follows from the documents alone
        rows = sorted(zip(table.column("hash").to_pylist(), table.column("_ids").to_pylist(), table.column("copies").to_pylist()))
        at, seen = 0, 0
        while at < len(rows):
            some, size = [], 0
            while at < len(rows) and size < 64 * BATCH:
                some.append(rows[at])
                size += len(rows[at][1]) // 2
                at += 1
            lens, copies = np.array([len(r[1]) // 2 for r in some], np.int64), np.array([r[2] for r in some], np.int64)
            ids = np.frombuffer(b"".join(r[1] for r in some), "<u2").astype(np.int64)
            context, chosen, often = windows(ids, lens, pad, window), targets(lens, number, stride), np.repeat(copies, lens)
            plain = bool((copies == 1).all())
            for i in range(0, len(chosen), BATCH):
                j = chosen[i : i + BATCH]
                net.train(context[:, j], ids[j], sums, None if plain else often[j])
            seen += int(often.sum())
        parts = [net.flat[i : i + _BLOCK].astype("<f4").tobytes() for i in range(0, len(net.flat), _BLOCK)]
        group = table.column("group")[0].as_py()
        give_back()
        return pa.table({"group": pa.array([group] * len(parts), pa.int64()), "block": pa.array(range(len(parts)), pa.int32()), "n": pa.array([seen] * len(parts), pa.int64()), "part": pa.array(parts, pa.binary())})

    def mean(table: pa.Table) -> pa.Table:
        total, tokens = 0.0, 0
        for _, n, raw in sorted(zip(*(table.column(c).to_pylist() for c in ("group", "n", "part")))):
            total, tokens = total + n * np.frombuffer(raw, "<f4").astype(np.float64), tokens + n
        return pa.table({"group": table.column("above")[:1], "block": table.column("block")[:1], "n": pa.array([tokens], pa.int64()), "part": pa.array([(total / tokens).astype("<f4").tobytes()], pa.binary())})

    schema = "group long, block int, n long, part binary"
    made = groups.groupBy("group").applyInArrow(local, schema)
    while n_groups > 0:
        # at most _FAN rows of one block meet in a task, whatever the input
        made = made.withColumn("above", F.floor(F.col("group") / _FAN)).groupBy("above", "block").applyInArrow(mean, schema)
        n_groups = n_groups // _FAN if n_groups > _FAN else 0
    flat = network.flat.copy()
    # as many rows as the network has blocks
    for r in made.collect():
        part = np.frombuffer(bytes(r["part"]), "<f4")
        flat[r["block"] * _BLOCK : r["block"] * _BLOCK + len(part)] = part
    return Network(network.side, network.hidden, network.window, flat)


def train(ids: DataFrame, words: Vocabulary, rounds: int = ROUNDS, stride: int = STRIDE, hidden: int = HIDDEN, window: int = WINDOW, group_tokens: int = GROUP_TOKENS) -> Network:
    """A network that has learned ``numbered`` documents."""
    network = Network(words.side, hidden, window, counts=words.start())
    groups, n = dealt(ids, group_tokens)
    for k in range(rounds if n else 0):
        network = train_round(groups, n, network, k, stride)
    return network


def scored(ids: DataFrame, network: Network, id_col: str = "doc_id") -> DataFrame:
    """Per ``numbered`` document: n_tokens, log_likelihood (sum over all tokens) and its mean per token."""
    kind = ids.schema[id_col].dataType.simpleString()
    held = ids.sparkSession.sparkContext.broadcast((network.flat, network.side, network.hidden, network.window))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat, side, hidden, window = held.value
        net = Network(side, hidden, window, flat)
        for b in slices(batches, "_ids", 1 << 20):
            lens = b.column("n_tokens").to_numpy()
            total = net.score(np.frombuffer(b"".join(b.column("_ids").to_pylist()), "<u2").astype(np.int64), lens) + b.column("_share").to_numpy()
            mean = [t / n if n else None for t, n in zip(total.tolist(), lens.tolist())]
            yield pa.RecordBatch.from_arrays([b.column(id_col), b.column("n_tokens"), pa.array(total), pa.array(mean, pa.float64())], [id_col, "n_tokens", "log_likelihood", "mean_log_likelihood"])

    return arrow(ids, kernel, f"`{id_col}` {kind}, n_tokens long, log_likelihood double, mean_log_likelihood double")


@dataclass(frozen=True)
class Model:
    """What ``fit`` has learned; ``counts``: all words with their counts, a cut."""

    words: Vocabulary
    counts: DataFrame
    network: Network


def fit(docs: DataFrame, rounds: int = ROUNDS, stride: int = STRIDE, side: int = SIDE, hashed: int = HASHED, group_tokens: int = GROUP_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A model of all documents, to score others.  ``side`` is 256 at most: ids are stored in 16 bits."""
    if side * side > 1 << 16:
        raise ValueError("side is 256 at most")
    corpus = read(docs, id_col, text_col)
    counts = word_counts(corpus)
    words = vocabulary(counts, side, hashed)
    ids = numbered(corpus, words, counts)
    network = train(ids, words, rounds, stride, group_tokens=group_tokens)
    release(corpus.whole, ids)
    return Model(words, counts, network)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scores of any documents under ``model``."""
    corpus = read(docs, id_col, text_col)
    return scored(numbered(corpus, model.words, model.counts), model.network, id_col)


def pseudo_likelihood(docs: DataFrame, rounds: int = ROUNDS, stride: int = STRIDE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Train on all documents, then score all documents."""
    corpus = read(docs, id_col, text_col)
    counts = word_counts(corpus)
    words = vocabulary(counts)
    ids = numbered(corpus, words, counts)
    release(corpus.whole, counts)
    return scored(ids, train(ids, words, rounds, stride), id_col)
