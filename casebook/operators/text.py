"""Conversation and language operators.

Both avoid windows partitioned by conversation or document: one conversation
(or language) may hold a large share of all rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casebook.functions.indexing import dense_index
from casebook.functions.partitioning import spread
from casebook.functions.quantiles import kept
from casebook.functions.text import normalise
from casebook.session import ship_package

CONTEXT_ROLES = ("user", "assistant")


def context_window(msgs: DataFrame, size: int = 10, conv: str = "conv_id", turn: str = "turn",
                   method: str = "index", block: int = 4096) -> DataFrame:
    """For each message, the ``size`` messages before it in its conversation
    (the slice is taken first, then only user/assistant turns are kept), as an
    ordered ``array<struct<turn, role, text>>``.

    ``method="index"`` (default, skew-proof): rows get a dense global index in
    (conv, turn) order -- range-partitioned, so one huge conversation is spread
    over many tasks -- and are cut into blocks of ``block`` rows.  The last ``size``
    rows of a block are copied into the next one, and a sliding window runs per
    (block, conversation): a bounded group, each text shipped about once.
    ``method="window"`` uses a sliding window per conversation (one shuffle,
    but a whole conversation lands in one task).
    """
    base = msgs.select(conv, turn, "role", "text")
    item = F.struct(F.col(turn).alias("turn"), "role", "text")

    def kept(ctx):
        return F.filter(ctx, lambda e: e["role"].isin(*CONTEXT_ROLES)).alias("context")

    if method == "window":
        w = Window.partitionBy(conv).orderBy(turn).rowsBetween(-size, -1)
        return base.select(conv, turn, kept(F.collect_list(item).over(w)))
    block = max(block, size)
    idx = dense_index(base, [conv, turn], "_i")
    home = F.call_function("div", F.col("_i"), F.lit(block))
    both = F.when(F.col("_i") % block >= block - size, F.array(home, home + 1)).otherwise(F.array(home))
    placed = idx.withColumn("_home", home).withColumn("_b", F.explode(both))
    w = Window.partitionBy("_b", conv).orderBy("_i").rowsBetween(-size, -1)
    out = placed.withColumn("context", kept(F.collect_list(item).over(w)))
    return out.where(F.col("_b") == F.col("_home")).select(conv, turn, "context")


# The greetings that a cleaned text of fewer than 5 characters can be,
# with their language.
SHORT_MAP = {
    "hi": "en", "hey": "en", "hola": "es", "ciao": "it", "おはよう": "ja", "もしもし": "ja", "안녕": "ko",
    "你好": "zh-cn", "您好": "zh-cn", "哈喽": "zh-cn", "ஹலோ": "ta", "chào": "vi", "سلام": "fa", "درود": "fa",
    "أهلا": "ar", "שלום": "he", "אהלן": "he", "hei": "fi", "hej": "sv", "molo": "xh", "ہیلو": "ur",
}
DEFAULT_LANG = "en"
SHORT_LEN = 5
NGRAM = 3

BITS = 21  # code points fit in 21 bits; three of them fit one signed long

#: Cells (grams x languages) of a profile that is broadcast: at most 128 MB of doubles.
PROFILE_CELLS = 1 << 24
POSITIONS_AT_ONCE = 1 << 19
SALTS = 16


def code_points(texts) -> tuple:
    """(code points of all texts, offset of each text); null counts as empty."""
    import numpy as np
    encoded = [(t or "").encode("utf-32-le", "surrogatepass") for t in texts]
    ends = np.cumsum([0, *(len(e) // 4 for e in encoded)])
    return np.frombuffer(b"".join(encoded), np.uint32).astype(np.int64), ends


def grams_at(codes, ends, n: int = NGRAM):
    """Pieces (text, key) of all overlapping ``n``-grams, in order: the text each lies in
    and its code points packed ``BITS`` apart.  No piece holds more than
    ``POSITIONS_AT_ONCE`` grams, however long a text is."""
    import numpy as np
    assert n * BITS < 64
    for a in range(0, max(len(codes) - n + 1, 0), POSITIONS_AT_ONCE):
        z = min(a + POSITIONS_AT_ONCE, len(codes) - n + 1)
        keys = np.zeros(z - a, np.int64)
        for j in range(n):
            keys = (keys << BITS) | codes[a + j:z + j]
        at = np.arange(a, z)
        text = np.searchsorted(ends, at, side="right") - 1
        inside = at + n <= ends[text + 1]
        yield text[inside], keys[inside]


def counted(keys, weights=None) -> tuple:
    """(distinct keys, how often)."""
    import numpy as np
    found, which = np.unique(keys, return_inverse=True)
    return found, np.bincount(which.ravel(), weights=weights, minlength=len(found)).astype(np.int64)


def language_profiles(docs: DataFrame, text: str = "text", lang: str = "lang",
                      n: int = NGRAM) -> DataFrame:
    """M13 training: character n-gram counts per language from labelled whole
    texts, as (lang, gram, cnt) with grams packed into longs.

    Each task adds up its texts' grams per language and sends one row per language and
    gram; a frequent gram or a dominant language costs one row per task.
    """
    import numpy as np
    import pyarrow as pa
    from pyspark.sql import types as T

    ship_package(docs.sparkSession)
    kind = docs.schema[lang].dataType
    d = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), normalise(F.col(text)).alias("text"))
    schema = T.StructType([T.StructField(lang, kind), T.StructField("gram", T.LongType()), T.StructField("cnt", T.LongType())])

    def run(batches):
        sums: dict = {}  # language -> (sorted grams, counts)
        key_type = pa.null()

        def rows():
            for name, (grams, counts) in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(grams), key_type), pa.array(grams), pa.array(counts)],
                                                 names=[lang, "gram", "cnt"])
            sums.clear()

        for b in batches:
            key_type = b.column("lang").type
            names = b.column("lang").dictionary_encode()
            which = names.indices.to_numpy()
            for text_at, keys in grams_at(*code_points(b.column("text").to_pylist()), n):
                for i, name in enumerate(names.dictionary.to_pylist()):
                    grams, counts = counted(keys[which[text_at] == i])
                    if name in sums:
                        old = sums[name]
                        grams, counts = counted(np.concatenate([old[0], grams]), np.concatenate([old[1], counts]))
                    sums[name] = (grams, counts)
            if sum(len(g) for g, _ in sums.values()) > POSITIONS_AT_ONCE:
                yield from rows()
        yield from rows()

    return spread(d).mapInArrow(run, schema).groupBy(lang, "gram").agg(F.sum("cnt").alias("cnt"))


def detect_language(msgs: DataFrame, profiles: DataFrame, keys, text: str = "text",
                    lang: str = "lang", n: int = NGRAM, max_cells: int = PROFILE_CELLS) -> DataFrame:
    """Language per text.  Cleaned texts under 5 characters use the phrase
    table (default 'en'); longer texts take the language maximising the
    add-one-smoothed n-gram log-likelihood
        sum_g n_g * ln(c_lg + 1) - N * ln(T_l + V)
    (T_l = grams seen for l, V = distinct grams); ties go to the smaller language code.
    Every text gets a row: null is empty, and with empty profiles the default is taken.

    The profile's size is counted first.  One of at most ``max_cells`` grams x languages
    becomes a sorted key array with a matrix of logarithms, which every task looks its
    texts' grams up in: one Python stage, nothing shuffled.  A larger one is joined with
    the grams, in ``SALTS`` parts so that a frequent gram is no hot key.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    ship_package(msgs.sparkSession)
    profiles = kept(profiles.select(F.col(lang).alias("lang"), "gram", "cnt"))
    size = profiles.agg(F.countDistinct("lang").alias("langs"), F.countDistinct("gram").alias("grams")).first()
    cleaned = msgs.select(*keys, F.coalesce(normalise(F.col(text)), F.lit("")).alias("_clean"))
    if size["langs"] * size["grams"] <= max_cells:
        return _detect_by_lookup(cleaned, profiles, keys, lang, n)
    return _detect_by_join(cleaned, profiles, keys, lang, n)


def _detect_by_lookup(cleaned: DataFrame, profiles: DataFrame, keys, lang: str, n: int) -> DataFrame:
    import numpy as np
    import pyarrow as pa
    from pyspark.sql import types as T

    table = profiles.toArrow()  # at most ``max_cells`` rows
    names = sorted(set(table["lang"].to_pylist()))
    grams = np.unique(table["gram"].to_numpy())
    logs = np.zeros((len(grams) + 1, len(names)))  # the last row: grams of no language
    which = np.searchsorted(names, table["lang"].to_pylist()) if names else np.zeros(0, np.int64)
    logs[np.searchsorted(grams, table["gram"].to_numpy()), which] = np.log(table["cnt"].to_numpy() + 1.0)
    totals = np.bincount(which, weights=table["cnt"].to_numpy(), minlength=len(names))
    shared = cleaned.sparkSession.sparkContext.broadcast((names, grams, logs, np.log(totals + len(grams))))
    short, default, short_len = SHORT_MAP, DEFAULT_LANG, SHORT_LEN
    schema = T.StructType([*[cleaned.schema[k] for k in keys], T.StructField(lang, T.StringType())])

    def run(batches):
        names, grams, logs, norm = shared.value
        for b in batches:
            texts = b.column("_clean").to_pylist()
            codes, ends = code_points(texts)
            score = np.zeros((len(texts), len(names)))
            for text_at, key in grams_at(codes, ends, n):
                at = np.minimum(np.searchsorted(grams, key), max(len(grams) - 1, 0))
                at = np.where(grams[at] == key, at, len(grams)) if len(grams) else np.zeros(len(key), np.int64)
                for i in range(len(names)):
                    score[:, i] += np.bincount(text_at, weights=logs[at, i], minlength=len(texts))
            score -= np.maximum(np.diff(ends) - n + 1, 0)[:, None] * norm
            best = score.argmax(1) if names else None  # the first of equals
            found = [short.get(t, default) if len(t) < short_len or best is None else names[best[i]] for i, t in enumerate(texts)]
            yield pa.RecordBatch.from_arrays([*[b.column(k) for k in keys], pa.array(found, pa.string())], names=[*keys, lang])

    return spread(cleaned).mapInArrow(run, schema)


def _detect_by_join(cleaned: DataFrame, profiles: DataFrame, keys, lang: str, n: int) -> DataFrame:
    import pyarrow as pa

    # The rows' own key columns wait beside a row number, for keys may repeat.
    numbered = kept(cleaned.withColumn("_row", F.monotonically_increasing_id()))

    def run(batches):
        import numpy as np
        for b in batches:
            rows = b.column("_row").to_numpy()
            for text_at, key in grams_at(*code_points(b.column("_clean").to_pylist()), n):
                order = np.lexsort((key, text_at))
                t, k = text_at[order], key[order]
                first = np.flatnonzero(np.append(True, (t[1:] != t[:-1]) | (k[1:] != k[:-1]))) if len(t) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(rows[t[first]]), pa.array(k[first]), pa.array(np.diff(np.append(first, len(t))))],
                                                 names=["_row", "gram", "ng"])

    grams = numbered.select("_row", "_clean").mapInArrow(run, "_row long, gram long, ng long").withColumn(
        "_salt", F.pmod(F.xxhash64("_row"), F.lit(SALTS)))
    salted = profiles.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    hit = (grams.join(salted, ["gram", "_salt"]).groupBy("_row", "lang").agg(F.sum(F.col("ng") * F.log(F.col("cnt") + 1)).alias("_s1")))
    vocab = profiles.agg(F.countDistinct("gram").alias("V"))
    # One row per language.
    norm = F.broadcast(profiles.groupBy("lang").agg(F.sum("cnt").alias("T")).crossJoin(F.broadcast(vocab))
                       .select("lang", F.log(F.col("T") + F.col("V")).alias("_lz")))
    long = numbered.where(F.length("_clean") >= SHORT_LEN).select("_row", (F.length("_clean") - n + 1).alias("N"))
    scored = long.crossJoin(norm).join(hit, ["_row", "lang"], "left").select(
        "_row", "lang", (F.coalesce("_s1", F.lit(0.0)) - F.col("N") * F.col("_lz")).alias("_score"))
    best = scored.groupBy("_row").agg(F.min_by("lang", F.struct((-F.col("_score")).alias("s"), F.col("lang").alias("l"))).alias("_best"))
    short_map = F.create_map(*[F.lit(x) for kv in SHORT_MAP.items() for x in kv])
    return numbered.join(best, "_row", "left").select(
        *keys, F.coalesce(F.col("_best"), F.when(F.length("_clean") < SHORT_LEN, F.try_element_at(short_map, F.col("_clean"))),
                          F.lit(DEFAULT_LANG)).alias(lang))
