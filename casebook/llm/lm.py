"""Log-bilinear language model (operator 4), trained with noise-contrastive estimation.

The model predicts a *symbol*: one of the most frequent words (as many as cover the
share ``coverage`` of the training tokens, up to ``shortlist``), the end of the text, or
a class of the remaining words (their last two bytes; the commonest endings have a class
each, the others share one).  A rarer word's probability is its class's times its
smoothed share of the class, (c + 1) / (N_class + V_class + 1), where every class keeps
one share for all words never seen.  Symbols are predicted in two steps: first the
*top*, which is a rare word's class or the group of a listed word (groups hold equal
shares of the tokens, by falling frequency), then the word in its group.  Both steps are
softmaxes of bounded width, so the probabilities of a token sum to one over an open
vocabulary and cost little.

The context is the last ``order`` symbols: h = sum_j C_j * R[w_-j], score = Q h + b for
symbols and T h + t for tops; both output layers learn by noise contrast.  Word counts
cover all training documents.  In a round every task passes once over all its training
tokens; the tasks' parameters and AdaGrad sums (of a fixed size) are averaged by tokens,
the rate falls from round to round, and of several rounds the one that is best on a fold
of the training rows is kept (that fold's rows are counted, but give no updates).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casebook.llm.scratch import stored
from casebook.llm.words import Words, hash_bytes, last_bytes, mix, slices, split_words
from casebook.session import ship_package

SLICE_BYTES = 5 << 20
END_HASH = hash_bytes(pa.array([b"\n"]))[0]  # no word holds a line break
END_ENDING = 0x0A


@dataclass
class Vocabulary:
    """Symbols and the counts behind them; of fixed size."""
    words: np.ndarray       # hashes of the shortlist, ascending; END_HASH among them
    counts: np.ndarray      # their training counts
    class_of: np.ndarray    # class number of each of the 65,536 endings
    class_tokens: np.ndarray
    class_types: np.ndarray
    group_of: np.ndarray    # group of each listed word
    tokens: int             # N
    types: int              # V

    @property
    def symbols(self) -> int:
        return len(self.words) + len(self.class_tokens)

    @property
    def top_of(self) -> np.ndarray:
        """The top of every symbol: a listed word's group, or a class of its own."""
        return np.concatenate([self.group_of, self.group_of.max() + 1 + np.arange(len(self.class_tokens))])

    def top_noise(self) -> np.ndarray:
        return np.bincount(self.top_of, weights=self.noise())

    def noise(self) -> np.ndarray:
        q = np.concatenate([self.counts, self.class_tokens]).astype(np.float64) + 1.0
        return q / q.sum()

    def symbol_of(self, hashes: np.ndarray, ending: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbol of each word, whether it stands for the word itself)."""
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        listed = self.words[at] == hashes
        return np.where(listed, at, len(self.words) + self.class_of[ending]), listed


def with_ends(w: Words, per_word: np.ndarray, end) -> np.ndarray:
    """``per_word`` with ``end`` put after the words of each text."""
    return np.insert(per_word, np.cumsum(w.counts), end)


def contexts(symbols: np.ndarray, starts: np.ndarray, order: int, pad: int) -> list[np.ndarray]:
    """For j = 1..order the symbol j places back, ``pad`` before a text's beginning."""
    n = len(symbols)
    place = np.arange(n) - np.repeat(starts, np.diff(np.append(starts, n)))
    out = []
    for j in range(1, order + 1):
        back = np.full(n, pad, np.int64)
        back[j:] = symbols[:-j]
        back[place < j] = pad
        out.append(back)
    return out


class Model:
    """r, c: context; q, b: symbols; t, u: tops."""

    def __init__(self, r, c, q, b, t, u):
        self.r, self.c, self.q, self.b, self.t, self.u = r, c, q, b, t, u

    @classmethod
    def initial(cls, vocabulary: Vocabulary, dim: int, order: int, seed: int = 7) -> Model:
        rng = np.random.default_rng(seed)
        noise, tops = vocabulary.noise(), vocabulary.top_noise()
        m = len(noise)
        return cls(rng.normal(0, 0.3, (m + 1, dim)).astype(np.float32), np.ones((order, dim), np.float32) / order,
                   rng.normal(0, 0.1, (m, dim)).astype(np.float32), np.log(noise).astype(np.float32),
                   rng.normal(0, 0.1, (len(tops), dim)).astype(np.float32), np.log(tops).astype(np.float32))

    def arrays(self) -> list[np.ndarray]:
        return [self.r, self.c, self.q, self.b, self.t, self.u]

    def hidden(self, ctx: list[np.ndarray]) -> np.ndarray:
        return sum((self.r * self.c[j])[x] for j, x in enumerate(ctx))

    def log_prob(self, symbols: np.ndarray, ctx: list[np.ndarray], top_of: np.ndarray, chunk: int = 1 << 13) -> np.ndarray:
        """Normalised natural log probability of each symbol in its context."""
        members = np.split(np.argsort(top_of, kind="stable"), np.cumsum(np.bincount(top_of))[:-1])
        place = np.empty(len(top_of), np.int64)
        for group in members:
            place[group] = np.arange(len(group))
        out = np.empty(len(symbols))
        for i in range(0, len(symbols), chunk):
            h, w = self.hidden([x[i:i + chunk] for x in ctx]), symbols[i:i + chunk]
            top = top_of[w]
            out[i:i + chunk] = picked_log_softmax(h @ self.t.T + self.u, top)
            by = np.argsort(top, kind="stable")
            for rows in np.split(by, np.flatnonzero(np.diff(top[by])) + 1):
                group = members[top[rows[0]]] if len(rows) else ()
                if len(group) > 1:
                    out[i + rows] += picked_log_softmax(h[rows] @ self.q[group].T + self.b[group], place[w[rows]])
        return out


def picked_log_softmax(scores: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Overwrites ``scores``."""
    scores -= scores.max(axis=1, keepdims=True)
    picked = scores[np.arange(len(scores)), at].astype(np.float64)
    np.exp(scores, out=scores)
    return picked - np.log((scores @ np.ones(scores.shape[1], np.float32)).astype(np.float64))


def flat(arrays: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([a.ravel() for a in arrays]).astype(np.float64)


def shaped(values: np.ndarray, like: list[np.ndarray]) -> list[np.ndarray]:
    cuts = np.cumsum([a.size for a in like])[:-1]
    return [x.reshape(a.shape).astype(np.float32) for x, a in zip(np.split(values, cuts), like)]


class Trainer:
    """Noise-contrastive AdaGrad over mini-batches; the noise of a batch is shared."""

    def __init__(self, arrays: list[np.ndarray], sums: list[np.ndarray], vocabulary: Vocabulary, seed: int, rate: float,
                 batch: int = 4096, samples: int = 64):
        self.m, self.sums = Model(*(a.copy() for a in arrays)), [s.copy() for s in sums]
        self.rate, self.batch, self.samples, self.top_of = rate, batch, samples, vocabulary.top_of
        self.rng = np.random.default_rng(seed)
        self.noise = [(np.cumsum(q), (np.log(q) + np.log(samples)).astype(np.float32)) for q in (vocabulary.noise(), vocabulary.top_noise())]

    def _step(self, grads: list[np.ndarray]) -> None:
        for a, g, s in zip(self.m.arrays(), grads, self.sums):
            s += g * g
            a += self.rate * g / np.sqrt(s)

    def _scatter(self, index: np.ndarray, rows: np.ndarray, size: int) -> np.ndarray:
        dim = rows.shape[1]
        at = (index[:, None] * dim + np.arange(dim)).ravel()
        return np.bincount(at, weights=rows.ravel(), minlength=size * dim).reshape(size, dim).astype(np.float32)

    def learn(self, symbols: np.ndarray, ctx: list[np.ndarray]) -> None:
        for i in range(0, len(symbols), self.batch):
            self._batch(symbols[i:i + self.batch], [x[i:i + self.batch] for x in ctx])

    def _contrast(self, h: np.ndarray, w: np.ndarray, q: np.ndarray, b: np.ndarray, noise) -> tuple:
        """(gradients of h, q and b) of one output layer."""
        cdf, log_noise = noise
        n, size = np.float32(len(w)), len(b)
        fake = np.minimum(np.searchsorted(cdf, self.rng.random(self.samples)), size - 1)
        true_score = np.einsum("ij,ij->i", h, q[w]) + b[w] - log_noise[w]
        fake_score = h @ q[fake].T + b[fake] - log_noise[fake]
        np.exp(np.minimum(true_score, 30, out=true_score), out=true_score)
        up = 1 / ((true_score + 1) * n)                                     # (1 - P(data)) / n
        np.exp(np.minimum(-fake_score, 30), out=fake_score)
        down = -1 / ((fake_score + 1) * n)
        dq = self._scatter(w, up[:, None] * h, size)
        np.add.at(dq, fake, down.T @ h)
        db = (np.bincount(w, weights=up, minlength=size) + np.bincount(fake, weights=down.sum(0), minlength=size)).astype(np.float32)
        return up[:, None] * q[w] + down @ q[fake], dq, db

    def _batch(self, w: np.ndarray, ctx: list[np.ndarray]) -> None:
        m = self.m
        h = m.hidden(ctx)
        dh, dq, db = self._contrast(h, w, m.q, m.b, self.noise[0])
        more, dt, du = self._contrast(h, self.top_of[w], m.t, m.u, self.noise[1])
        dh = dh + more
        dc = np.stack([np.einsum("ij,ij->j", dh, m.r[x]) for x in ctx])
        dr = np.zeros_like(m.r)
        for j, x in enumerate(ctx):
            dr += self._scatter(x, dh, len(m.r)) * m.c[j]
        self._step([dr, dc, dq, db, dt, du])


def read_batch(texts: pa.Array, vocabulary: Vocabulary):
    """(words, hashes with ends, symbols with ends, listed with ends, token start of each text)."""
    w = split_words(texts, lower=True)
    hashes = w.hashes()
    symbol, listed = vocabulary.symbol_of(hashes, last_bytes(w.vocab))
    end = int(np.searchsorted(vocabulary.words, END_HASH))
    starts = np.cumsum(w.counts + 1) - (w.counts + 1)
    return (w, with_ends(w, hashes[w.codes], END_HASH), with_ends(w, symbol[w.codes], end),
            with_ends(w, listed[w.codes], True), starts)


def count_words(docs: DataFrame) -> DataFrame:
    """(hash, ending, c) of every token of the training documents, ends included."""
    def count(batches):
        for b in slices(batches, "text", SLICE_BYTES):
            w = split_words(b.column("text"), lower=True)
            n = np.bincount(w.codes, minlength=len(w.vocab))
            used = n > 0
            hashes = np.append(w.hashes()[used], END_HASH)
            ending = np.append(last_bytes(w.vocab)[used], END_ENDING)
            yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(ending, pa.int32()),
                                              pa.array(np.append(n[used], len(w.counts)), pa.int64())],
                                             names=["hash", "ending", "c"])

    return (docs.where("NOT held_out").select("text").mapInArrow(count, "hash long, ending int, c long")
            .groupBy("hash").agg(F.first("ending").alias("ending"), F.sum("c").alias("c")))


def fit_vocabulary(counts: DataFrame, coverage: float, shortlist: int, classes: int, groups: int) -> Vocabulary:
    per_ending = counts.groupBy("ending").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect()
    tokens, types = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
    for r in per_ending:
        tokens[r["ending"]], types[r["ending"]] = r["n"], r["v"]
    total, distinct, ends = int(tokens.sum()), int(types.sum()), int(tokens[END_ENDING])
    tokens[END_ENDING] = types[END_ENDING] = 0
    # At most ``shortlist`` rows, the most frequent words; as many of them as the coverage asks for.
    top = counts.where(F.col("hash") != F.lit(int(END_HASH.view(np.int64)))).orderBy(F.desc("c"), "hash").limit(shortlist).collect()
    covered = np.cumsum([r["c"] for r in top])
    top = top[:int(np.searchsorted(covered, coverage * total)) + 1]
    for r in top:
        tokens[r["ending"]] -= r["c"]
        types[r["ending"]] -= 1
    words = np.array([r["hash"] for r in top], np.int64).view(np.uint64)
    words = np.append(words, END_HASH)
    c = np.array([r["c"] for r in top] + [ends], np.int64)
    falling = np.lexsort((words, -c))
    share = np.cumsum(c[falling]) - c[falling]
    group_of = np.empty(len(c), np.int64)
    group_of[falling] = np.unique(share * groups // max(int(c.sum()), 1), return_inverse=True)[1]
    order = np.argsort(words)
    used = int((tokens > 0).sum())
    classes = max(1, min(classes, used))
    class_of = np.full(1 << 16, classes - 1, np.int64)
    common = np.lexsort((np.arange(1 << 16), -tokens))[:classes - 1]
    class_of[common] = np.arange(len(common))
    return Vocabulary(words[order], c[order], class_of,
                      np.bincount(class_of, weights=tokens, minlength=classes).astype(np.int64),
                      np.bincount(class_of, weights=types, minlength=classes).astype(np.int64), group_of[order], total, distinct)


def train(docs: DataFrame, vocabulary: Vocabulary, dim: int, order: int, rounds: int, rate: float = 0.1) -> Model:
    """Parameter averaging: in each round every task starts from the shared model,
    passes once over its training tokens and returns its parameters.  The model kept is
    the best of the rounds on the rows of the fold."""
    spark = docs.sparkSession
    known = spark.sparkContext.broadcast(vocabulary)
    model = Model.initial(vocabulary, dim, order)
    sums = [np.full(a.shape, 1e-6, np.float32) for a in model.arrays()]
    fold = (F.pmod(F.xxhash64("text"), F.lit(50)) == 0) if rounds > 1 else F.lit(False)
    texts = docs.where("NOT held_out").select("text")
    best, best_score = model, -np.inf
    for turn in range(rounds):
        start = spark.sparkContext.broadcast((model.arrays(), sums))

        def learn(batches, turn=turn, start=start):
            trainer = Trainer(*start.value, known.value, seed=1000 * turn + TaskContext.get().partitionId(), rate=rate / (1 + turn))
            seen = 0
            for b in slices(batches, "text", SLICE_BYTES):
                _, _, symbols, _, starts = read_batch(b.column("text"), known.value)
                trainer.learn(symbols, contexts(symbols, starts, order, known.value.symbols))
                seen += len(symbols)
            if seen:
                x = flat(trainer.m.arrays() + trainer.sums) * seen
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(x.size), pa.int32()), pa.array(x), pa.array(np.full(x.size, seen), pa.int64())],
                    names=["i", "x", "n"])

        rows = (texts.where(~fold).mapInArrow(learn, "i int, x double, n long")
                .groupBy("i").agg((F.sum("x") / F.sum("n")).alias("x")).toArrow())
        if not rows.num_rows:
            break
        x = np.empty(rows.num_rows)
        x[rows["i"].to_numpy()] = rows["x"].to_numpy()
        arrays = shaped(x, model.arrays() + sums)
        model, sums = Model(*arrays[:len(arrays) // 2]), arrays[len(arrays) // 2:]
        if rounds == 1:
            return model
        found = fold_score(texts.where(fold), known, model)
        if found is None or found > best_score:
            best, best_score = model, found if found is not None else best_score
    return best


def fold_score(texts: DataFrame, known, model: Model) -> float | None:
    """The model's log probability of the symbols of ``texts``; None without any."""
    shared = texts.sparkSession.sparkContext.broadcast(model.arrays())
    order = len(model.c)

    def run(batches):
        m, v, total = Model(*shared.value), known.value, 0.0
        for b in slices(batches, "text", SLICE_BYTES):
            _, _, symbols, _, starts = read_batch(b.column("text"), v)
            total += float(m.log_prob(symbols, contexts(symbols, starts, order, v.symbols), v.top_of).sum())
        yield pa.RecordBatch.from_arrays([pa.array([total])], names=["x"])

    return texts.mapInArrow(run, "x double").agg(F.sum("x")).first()[0]


def score(docs: DataFrame, counts: DataFrame, vocabulary: Vocabulary, model: Model, key: str) -> DataFrame:
    """Per row of ``docs``: ``key``, held_out, n_tokens, n_known, base_score, score.

    Listed words are scored on the spot.  A text's other words go, once per
    distinct word and text, to the task that holds the word's count, and come
    back as sums; no count table is broadcast.  A text's own row (no ``times``)
    travels under a hash of its number, so that those rows are spread as well.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((vocabulary, model.arrays()))
    order = len(model.c)
    base_denominator = np.log10(vocabulary.tokens + vocabulary.types + 1)

    def local(batches):
        v, arrays = shared.value
        m = Model(*arrays)
        top_of = v.top_of
        class_share = np.log10(v.class_tokens + v.class_types + 1.0)
        listed_log = np.log10(v.counts + 1.0)
        row = TaskContext.get().partitionId() << 33
        for b in slices(batches, "text", SLICE_BYTES):
            w, hashes, symbols, listed, starts = read_batch(b.column("text"), v)
            text = np.repeat(np.arange(len(w.counts)), w.counts + 1)
            lm = m.log_prob(symbols, contexts(symbols, starts, order, v.symbols), top_of) / np.log(10)
            lm[~listed] -= class_share[symbols[~listed] - len(v.words)]
            base = np.zeros(len(symbols))
            base[listed] = listed_log[symbols[listed]]
            rows, n = row + np.arange(len(w.counts)), len(w.counts)
            row += n
            known = np.bincount(text, weights=listed & (v.counts[np.minimum(symbols, len(v.words) - 1)] > 0), minlength=n)
            rare = np.flatnonzero(~listed)
            pairs = np.empty(rare.size, [("t", np.int64), ("h", np.uint64)])
            pairs["t"], pairs["h"] = text[rare], hashes[rare]
            by = np.lexsort((pairs["h"], pairs["t"]))
            pairs = pairs[by]
            head = np.flatnonzero(np.append(True, pairs[1:] != pairs[:-1])) if rare.size else np.zeros(0, np.int64)
            times = np.diff(np.append(head, rare.size))
            pairs = pairs[head]
            m_rows = len(pairs)

            def column(values, kind, absent, first=True):
                """One value per text, none per rare word, or the other way round."""
                gap = pa.nulls(absent, kind)
                return pa.concat_arrays([pa.array(values, kind), gap] if first else [gap, pa.array(values, kind)])

            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([rows, rows[pairs["t"]]])),
                 pa.array(np.concatenate([mix(rows.astype(np.uint64)), pairs["h"]]).view(np.int64)),
                 column(times, pa.int32(), n, False),
                 column(w.counts + 1, pa.int64(), m_rows), column(known.astype(np.int64), pa.int64(), m_rows),
                 column(np.bincount(text, weights=base, minlength=n), pa.float64(), m_rows),
                 column(np.bincount(text, weights=lm, minlength=n), pa.float64(), m_rows),
                 pa.concat_arrays([b.column("key"), pa.nulls(m_rows, b.column("key").type)]),
                 pa.concat_arrays([b.column("held_out"), pa.nulls(m_rows, pa.bool_())])],
                names=["row", "hash", "times", "n_tokens", "n_known", "base", "lm", "key", "held_out"])

    kind = docs.schema[key].dataType.simpleString()
    parts = docs.select("text", F.col(key).alias("key"), "held_out").mapInArrow(
        local, f"row long, hash long, times int, n_tokens long, n_known long, base double, lm double, key {kind}, held_out boolean")
    c = F.coalesce(F.col("c"), F.lit(0))
    rare = F.col("times").isNotNull()
    log_c = F.col("times") * F.log10(c + 1)
    resolved = parts.join(counts.select("hash", "c"), "hash", "left").select(
        "row", "key", "held_out", "n_tokens",
        F.when(rare, F.when(c > 0, F.col("times")).otherwise(0)).otherwise(F.col("n_known")).alias("n_known"),
        F.when(rare, log_c).otherwise(F.col("base")).alias("base"),
        F.when(rare, log_c).otherwise(F.col("lm")).alias("lm"))
    return (resolved.groupBy("row")
            .agg(F.max("key").alias(key), F.max("held_out").alias("held_out"), F.max("n_tokens").alias("n_tokens"),
                 F.sum("n_known").alias("n_known"), F.sum("base").alias("base"), F.sum("lm").alias("score"))
            .select(key, "held_out", "n_tokens", F.col("n_known").cast("long").alias("n_known"),
                    (F.col("base") - F.col("n_tokens") * F.lit(float(base_denominator))).alias("base_score"), "score"))


def lm_scores(docs: DataFrame, key: str = "doc_id", text: str = "text", folds: int = 7, held: int = 2,
              coverage: float = 0.5, shortlist: int = 2047, classes: int = 128, groups: int = 32, dim: int = 10, order: int = 3,
              rounds: int = 1) -> DataFrame:
    """Score every whole text with a model trained on the rows whose
    crc32(key as text) mod ``folds`` is not ``held``.

    Returns key, held_out, n_tokens, n_known, train_tokens, base_score (add-one
    unigram) and score (this model), both log10 of the text's probability.  Null
    text is empty: its end alone is scored.  A null key is a training row.  Rows
    with equal keys are scored each on its own.  Columns beside key and text are
    left behind.  Without training rows every word is unseen and scored as such;
    an empty table gives no rows.
    """
    spark: SparkSession = docs.sparkSession
    ship_package(spark)
    own = F.col(f"`{key}`")
    held_out = F.coalesce(F.crc32(own.cast("string").cast("binary")) % folds == held, F.lit(False))
    docs = docs.select(own.alias(key), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"),
                       held_out.alias("held_out"))
    counts = stored(count_words(docs), "lm-counts")
    vocabulary = fit_vocabulary(counts, coverage, shortlist, classes, groups)
    model = train(docs, vocabulary, dim, order, rounds)
    return (score(docs, counts, vocabulary, model, key)
            .withColumn("train_tokens", F.lit(vocabulary.tokens).cast("long")))
