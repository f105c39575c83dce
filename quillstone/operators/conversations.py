"""Conversation features: stylometry, asymmetry, timing, shifts and stage symbols."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions import text as T
from quillstone.operators.comments import small

#: The lexicon proxy of sentiment.
POSITIVE = ("love", "miss", "dear", "happy", "wonderful", "beautiful", "sweetheart")
NEGATIVE = ("urgent", "problem", "trouble", "worried", "emergency", "lost", "stuck")


def moving_ttr(tokens: DataFrame, id_column: str = "doc_id", width: int = 100) -> DataFrame:
    """Mean type-token ratio of all windows of `width` tokens; plain ratio of shorter texts.

    Linear: every token adds the number of windows in which it is the first of its type.
    """
    whole = Window.partitionBy(id_column)
    held = tokens.select(id_column, "pos", "token", F.count("*").over(whole).alias("n"), F.coalesce(F.lag("pos").over(Window.partitionBy(id_column, "token").orderBy("pos")), F.lit(-1)).alias("before"))
    lo, hi = F.greatest(F.lit(0), F.col("pos") - width + 1, F.col("before") + 1), F.least("pos", F.col("n") - width)
    sums = held.groupBy(id_column).agg(F.first("n").alias("n"), F.sum(F.greatest(F.lit(0), hi - lo + 1)).alias("firsts"), F.count_if(F.col("before") < 0).alias("types"))
    return sums.select(id_column, F.when(F.col("n") < width, F.col("types") / F.greatest(F.lit(1), F.col("n"))).otherwise(F.col("firsts") / (width * (F.col("n") - width + 1))).alias("mattr"))


def type_counts(tokens: DataFrame, id_column: str = "doc_id") -> DataFrame:
    return tokens.groupBy(id_column, "token").agg(F.count("*").alias("c"))


def yule_k(counts: DataFrame, id_column: str = "doc_id") -> DataFrame:
    n = F.sum("c")
    return counts.groupBy(id_column).agg((1e4 * (F.sum(F.col("c") * F.col("c")) - n) / (n * n)).alias("yule_k"))


def zipf_deviation(counts: DataFrame, id_column: str = "doc_id", least: int = 150, first: int = 10, last: int = 1000) -> DataFrame:
    """|-slope - 1| of ln count on ln rank over ranks 10 to 1000 (all ranks if there are too few); null under 150 tokens."""
    order = Window.partitionBy(id_column).orderBy(F.desc("c"), "token")
    ranked = counts.select(id_column, "c", F.row_number().over(order).alias("r"), F.sum("c").over(Window.partitionBy(id_column)).alias("n"), F.count("*").over(Window.partitionBy(id_column)).alias("types"))
    inside = F.when(F.least("types", F.lit(last)) - first >= 2, (F.col("r") >= first) & (F.col("r") <= last)).otherwise(F.lit(True))
    slope = ranked.where(F.col("n") >= least).where(inside).groupBy(id_column).agg(F.regr_slope(F.ln("c"), F.ln("r")).alias("s"))
    return counts.select(id_column).distinct().join(slope, id_column, "left").select(id_column, F.abs(-F.col("s") - 1).alias("zipf_deviation"))


def length_asymmetry(messages: DataFrame, key: str = "conv_id", own: str = "S", other: str = "V") -> DataFrame:
    """ln ratio of the mean word counts of the two speakers; null if one is silent."""
    w = messages.withColumn("w", T.n_words(F.col("text")))
    s = w.groupBy(key).agg(F.avg(F.when(F.col("speaker") == own, F.col("w"))).alias("a"), F.avg(F.when(F.col("speaker") == other, F.col("w"))).alias("b"))
    return s.select(key, F.ln((F.col("a") + 1) / (F.col("b") + 1)).alias("length_asymmetry"))


def gaps(rows: DataFrame, key: str, at_micros: Column) -> DataFrame:
    """Positive time differences in seconds between successive rows of a key."""
    held = rows.select(key, at_micros.alias("at"))
    held = held.withColumn("gap", (F.col("at") - F.lag("at").over(Window.partitionBy(key).orderBy("at"))) / 1e6)
    return held.where("gap > 0").select(key, "gap")


def bimodality(found: DataFrame, key: str, value: str = "gap") -> DataFrame:
    """Bimodality coefficient with bias-corrected skewness and kurtosis; null under four values or without spread."""
    s = found.groupBy(key).agg(F.count(value).cast("double").alias("n"), F.skewness(value).alias("g1"), F.kurtosis(value).alias("g2"))
    n, g1, g2 = F.col("n"), F.col("g1"), F.col("g2")
    big1 = g1 * F.sqrt(n * (n - 1)) / (n - 2)
    big2 = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6)
    low = big2 + 3 * (n - 1) * (n - 1) / ((n - 2) * (n - 3))
    return s.select(key, F.when((n >= 4) & F.nanvl(g1, F.lit(None).cast("double")).isNotNull() & (low != 0), (big1 * big1 + 1) / low).alias("bimodality"))


def cusum_peak(values: DataFrame, key: str, order: str, value: str, slack: float = 0.25, least: int = 4) -> DataFrame:
    """Peak of the one-sided downward cumulative sum from the median of the first half; null under four values.

    Closed form: S_t - min(0, min over k <= t of S_k), two windows instead of a recursion.
    """
    w = Window.partitionBy(key).orderBy("_at")
    held = values.select(key, F.col(order).alias("_at"), F.col(value).cast("double").alias("_s"))
    held = held.select(key, "_at", "_s", F.row_number().over(w).alias("_i"), F.count("*").over(Window.partitionBy(key)).alias("_n"))
    base = held.where(F.col("_i") <= F.greatest(F.lit(2), F.floor(F.col("_n") / 2))).groupBy(key).agg(F.median("_s").alias("_mu"))
    up_to = w.rowsBetween(Window.unboundedPreceding, 0)
    run = held.join(base, key).withColumn("_run", F.sum(F.col("_mu") - F.col("_s") - slack).over(up_to))
    run = run.withColumn("_g", F.col("_run") - F.least(F.lit(0.0), F.min("_run").over(up_to)))
    return run.groupBy(key).agg(F.when(F.first("_n") >= least, F.max("_g")).alias("cusum_peak"))


def ordinal_slope(values: DataFrame, key: str, order: str, value: str, least: int = 3) -> DataFrame:
    held = values.select(key, F.col(value).cast("double").alias("s"), (F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1).alias("i"))
    return held.groupBy(key).agg(F.when(F.count("*") >= least, F.regr_slope("s", "i")).alias("slope"))


def halves(rows: DataFrame, key: str, order: str) -> DataFrame:
    """rows with late: whether they stand in the second half."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1
    return rows.withColumn("late", place >= F.floor(F.count("*").over(Window.partitionBy(key)) / 2))


def topic_shift(marked: DataFrame, key: str, lexicon: DataFrame, alpha: float = 0.5) -> DataFrame:
    """KL divergence of late from early token shares, smoothed over the vocabulary, and the late share of lexicon tokens.

    marked: key, token, late.  Null if a half is empty.
    """
    counts = marked.groupBy(key, "token").agg(F.count_if("late").alias("l"), F.count_if(~F.col("late")).alias("e"))
    w = Window.partitionBy(key)
    held = counts.join(small(lexicon.select(F.col("word").alias("token"), F.lit(1).alias("hit")).distinct()), "token", "left")
    held = held.select(key, "l", "e", "hit", F.sum("l").over(w).alias("nl"), F.sum("e").over(w).alias("ne"), F.count("*").over(w).alias("v"))
    pl, pe = (F.col("l") + alpha) / (F.col("nl") + alpha * F.col("v")), (F.col("e") + alpha) / (F.col("ne") + alpha * F.col("v"))
    both = (F.first("nl") > 0) & (F.first("ne") > 0)
    return held.groupBy(key).agg(F.when(both, F.sum(pl * F.ln(pl / pe))).alias("topic_shift"), F.when(both, F.sum(F.when(F.col("hit") == 1, F.col("l")).otherwise(0)) / F.first("nl")).alias("late_mass"))


def lexicon_sentiment(text: Column, positive=POSITIVE, negative=NEGATIVE) -> Column:
    """-1, 0 or 1 by which list has more tokens: the offline default for message sentiment."""
    t = T.tokens(text)
    p, n = F.size(F.filter(t, lambda x: x.isin(*positive))), F.size(F.filter(t, lambda x: x.isin(*negative)))
    return F.signum((p - n).cast("double"))


def stage_symbol(text: Column, position: Column, lexicon: tuple[str, ...]) -> Column:
    """A message's symbol, 0 to 161: sentiment, length, lexicon, question and position bins in mixed radix."""
    t = T.tokens(text)
    n, q = F.size(t), T.occurrences(text, "?")
    length = F.when(n < 8, 0).when(n < 25, 1).otherwise(2)
    hit = F.exists(t, lambda x: x.isin(*lexicon)).cast("int")
    asked = F.when(q == 0, 0).when(q <= 1, 1).otherwise(2)
    place = F.when(position < 0.33, 0).when(position < 0.66, 1).otherwise(2)
    return (lexicon_sentiment(text) + 1).cast("int") + 3 * length + 9 * hit + 18 * asked + 54 * place


def stage_symbols(messages: DataFrame, lexicon: tuple[str, ...], key: str = "conv_id", order: str = "turn") -> DataFrame:
    w = Window.partitionBy(key)
    place = (F.row_number().over(w.orderBy(order)) - 1) / F.count("*").over(w)
    return messages.withColumn("position", place).select(key, order, stage_symbol(F.col("text"), F.col("position"), lexicon).alias("symbol"))


class StageModel:
    """A hidden Markov model with discrete symbols; states only move on."""

    #: Where the fit starts.
    START = (0.85, 0.10, 0.03, 0.01, 0.01)
    MOVES = ((0.55, 0.35, 0.05, 0.04, 0.01), (0.0, 0.55, 0.30, 0.10, 0.05), (0.0, 0.0, 0.55, 0.30, 0.15), (0.0, 0.0, 0.0, 0.55, 0.45), (0.0, 0.0, 0.0, 0.0, 1.0))
    SYMBOLS = 162

    def __init__(self, start=None, moves=None, emit=None):
        import numpy as np

        self.start, self.moves = np.array(start or self.START), np.array(moves if moves is not None else self.MOVES)
        self.emit = np.full((len(self.start), self.SYMBOLS), 1 / self.SYMBOLS) if emit is None else np.array(emit)

    def forward(self, symbols) -> tuple[float, object, object]:
        import numpy as np

        alpha, scale = np.zeros((len(symbols), len(self.start))), np.zeros(len(symbols))
        for t, s in enumerate(symbols):
            a = (self.start if t == 0 else alpha[t - 1] @ self.moves) * self.emit[:, s]
            scale[t] = max(a.sum(), 1e-300)
            alpha[t] = a / scale[t]
        return float(np.log(scale).sum()), alpha, scale

    def viterbi(self, symbols) -> list[int]:
        import numpy as np

        with np.errstate(divide="ignore"):
            start, moves, emit = np.log(self.start), np.log(self.moves), np.log(self.emit)
        best, back = start + emit[:, symbols[0]], []
        for s in symbols[1:]:
            step = best[:, None] + moves
            back.append(step.argmax(0))
            best = step.max(0) + emit[:, s]
        path = [int(best.argmax())]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        return path[::-1]

    def counts(self, symbols):
        """Expected starts, moves and emissions of one sequence."""
        return self.counts_of([symbols])

    def counts_of(self, sequences):
        """Log likelihood and expected starts, moves and emissions of sequences of one length, all worked through together."""
        import numpy as np

        s = np.asarray(sequences, dtype=np.int64)
        length, states = s.shape[1], len(self.start)
        seen = self.emit.T[s]  # sequence, place, state
        alpha, scale = np.zeros((len(s), length, states)), np.zeros((len(s), length))
        for t in range(length):
            a = (self.start if t == 0 else alpha[:, t - 1] @ self.moves) * seen[:, t]
            scale[:, t] = np.maximum(a.sum(1), 1e-300)
            alpha[:, t] = a / scale[:, t, None]
        beta, xi = np.ones_like(alpha), np.zeros_like(self.moves)
        for t in range(length - 2, -1, -1):
            ahead = seen[:, t + 1] * beta[:, t + 1] / scale[:, t + 1, None]
            beta[:, t] = ahead @ self.moves.T
            xi += self.moves * (alpha[:, t].T @ ahead)
        gamma = alpha * beta
        gamma /= gamma.sum(2, keepdims=True)
        emit = np.zeros((self.SYMBOLS, states))
        np.add.at(emit, s.ravel(), gamma.reshape(-1, states))
        return float(np.log(scale).sum()), gamma[:, 0].sum(0), xi, emit.T


#: Symbols of sequences that are worked through together.
TOGETHER = 100_000


def _of_one_length(sequences):
    """Sequences that are not empty, in lists of one length and TOGETHER symbols at most (or one sequence)."""
    held = {}
    for s in sequences:
        if len(s):
            held.setdefault(len(s), []).append(s)
    for length, own in held.items():
        step = max(1, TOGETHER // length)
        yield from (own[k : k + step] for k in range(0, len(own), step))


def fit_stages(sequences: DataFrame, rounds: int = 30, symbols: str = "symbols") -> StageModel:
    """Baum-Welch: each round sums expected counts over the cluster; one fixed-size row for each partition meets on the driver."""
    import numpy as np
    import pandas as pd

    model, last = StageModel(), None
    for k in range(rounds):
        now = model

        def add(batches: Iterator[pd.DataFrame], m: StageModel = now) -> Iterator[pd.DataFrame]:
            like, first, moves, emit, seen = 0.0, np.zeros(len(m.start)), np.zeros_like(m.moves), np.zeros_like(m.emit), False
            for b in batches:
                for s in _of_one_length(b[symbols]):
                    one = m.counts_of(s)
                    like, first, moves, emit, seen = like + one[0], first + one[1], moves + one[2], emit + one[3], True
            if seen:
                yield pd.DataFrame({"v": [np.concatenate([[like], first, moves.ravel(), emit.ravel()]).tolist()]})

        parts = sequences.select(symbols).mapInPandas(add, "v array<double>").select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).collect()
        if not parts:
            return model
        total = np.zeros(len(parts))
        for r in parts:
            total[r["i"]] = r["x"]
        n = len(model.start)
        first, moves, emit = total[1 : 1 + n], total[1 + n : 1 + n + n * n].reshape(n, n), total[1 + n + n * n :].reshape(n, -1)
        share = lambda x, old: np.where(x.sum(-1, keepdims=True) > 0, x / np.maximum(x.sum(-1, keepdims=True), 1e-300), old)
        model = StageModel(share(first, model.start).tolist(), share(moves, model.moves), share(emit, model.emit))
        if last is not None and abs(total[0] - last) < 1e-2:
            break
        last = total[0]
    return model


def stage_scores(sequences: DataFrame, scam: StageModel, normal: StageModel, key: str = "conv_id", symbols: str = "symbols") -> DataFrame:
    """Log-likelihood difference of two models and whether the likeliest path reaches the last state; null under two messages."""
    import pandas as pd

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, None, None) if len(s) < 2 else (k, scam.forward(list(s))[0] - normal.forward(list(s))[0], float(len(scam.start) - 1 in scam.viterbi(list(s)))) for k, s in zip(b[key], b[symbols], strict=True)]
            yield pd.DataFrame(rows, columns=[key, "log_ratio", "reaches_last"]).astype({"log_ratio": "float64", "reaches_last": "float64"})

    return sequences.select(key, symbols).mapInPandas(run, f"{key} long, log_ratio double, reaches_last double")
