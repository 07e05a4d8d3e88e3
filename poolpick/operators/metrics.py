"""Evaluation metrics as Spark aggregates (MET-2..7).

These follow the public definitions (seqeval-style span F1, weighted F1,
SQuAD exact match / token F1, corpus BLEU with exponential smoothing);
tokenisation is plain whitespace splitting, not a library tokenizer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from poolpick.functions.scores import _bind
from poolpick.functions.text import squad_tokens, whitespace_tokens

# ------------------------------------------------------------------ spans


def token_spans(df: DataFrame, tag_col: str, id_col: str = "row_id", pos_col: str = "pos") -> DataFrame:
    """Entity spans from BIO tags ('B-T', 'I-T', 'O') by gaps-and-islands.

    A tagged token opens a span when it is 'B-*', or its type differs from
    the previous token's, or the previous token is 'O'; otherwise it
    continues the open span. Bare tags (no B-/I- prefix) form maximal runs
    of equal tags. Returns (row_id, start, end, type).
    """
    tag = F.col(tag_col)
    has_prefix = tag.rlike("^[BI]-")
    typ = F.when(tag == "O", F.lit(None)).when(has_prefix, F.substr(tag, F.lit(3))).otherwise(tag)
    w = Window.partitionBy(id_col).orderBy(pos_col)
    x = df.withColumn("_t", typ).withColumn("_pt", F.lag("_t").over(w))
    opens = F.col("_t").isNotNull() & (tag.startswith("B-") | F.col("_pt").isNull() | (F.col("_pt") != F.col("_t")))
    x = x.withColumn("_open", opens.cast("int"))
    x = x.withColumn("_span", F.sum("_open").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return x.where(F.col("_t").isNotNull()).groupBy(id_col, "_span").agg(
        F.min(pos_col).alias("start"), F.max(pos_col).alias("end"), F.first("_t").alias("type")) \
        .drop("_span")


def span_f1(gold: DataFrame, pred: DataFrame, id_col: str = "row_id") -> DataFrame:
    """Micro precision / recall / F1 over exact (row, start, end, type) span matches.

    One full outer join on the span key and one conditional aggregate.
    """
    keys = [id_col, "start", "end", "type"]
    j = gold.withColumn("_g", F.lit(1)).join(pred.withColumn("_p", F.lit(1)), keys, "full")
    r = j.agg(F.count_if(F.col("_g").isNotNull()).alias("n_gold"), F.count_if(F.col("_p").isNotNull()).alias("n_pred"),
              F.count_if(F.col("_g").isNotNull() & F.col("_p").isNotNull()).alias("tp"))
    prec = F.col("tp") / F.nullif(F.col("n_pred"), F.lit(0))
    rec = F.col("tp") / F.nullif(F.col("n_gold"), F.lit(0))
    return r.select("n_gold", "n_pred", "tp", F.coalesce(prec, F.lit(0.0)).alias("precision"),
                    F.coalesce(rec, F.lit(0.0)).alias("recall")) \
        .withColumn("f1", F.coalesce(2 * F.col("precision") * F.col("recall")
                                     / F.nullif(F.col("precision") + F.col("recall"), F.lit(0.0)), F.lit(0.0)))


def token_accuracy(df: DataFrame, pred_col: str = "pred", gold_col: str = "gold") -> DataFrame:
    return df.agg(F.avg((F.col(pred_col) == F.col(gold_col)).cast("double")).alias("accuracy"),
                  F.count("*").alias("n"))


# ------------------------------------------------------------------ classes
def weighted_f1(df: DataFrame, pred_col: str = "pred", gold_col: str = "gold") -> DataFrame:
    """F1 per class weighted by gold support (classes never predicted score 0)."""
    gold_n = df.groupBy(F.col(gold_col).alias("cls")).agg(F.count("*").alias("support"))
    pred_n = df.groupBy(F.col(pred_col).alias("cls")).agg(F.count("*").alias("n_pred"))
    tp = df.where(F.col(pred_col) == F.col(gold_col)).groupBy(F.col(gold_col).alias("cls")) \
        .agg(F.count("*").alias("tp"))
    c = gold_n.join(pred_n, "cls", "full").join(tp, "cls", "left").fillna(0, ["support", "n_pred", "tp"])
    p = F.coalesce(F.col("tp") / F.nullif(F.col("n_pred"), F.lit(0)), F.lit(0.0))
    r = F.coalesce(F.col("tp") / F.nullif(F.col("support"), F.lit(0)), F.lit(0.0))
    f1 = F.coalesce(2 * p * r / F.nullif(p + r, F.lit(0.0)), F.lit(0.0))
    per = c.select("cls", "support", f1.alias("f1"))
    return per.agg((F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("weighted_f1"),
                   F.sum("support").alias("n"))


# ------------------------------------------------------------------ QA text
def multiset_overlap(a: Column, b: Column) -> Column:
    """Size of the multiset intersection of two arrays, inside the row and linear but for a sort.

    If one side repeats nothing, it is the size of the set intersection; else both sides are sorted and merged.
    """

    def merged(two):
        def step(at, _):
            x, y = F.get(two["a"], at["i"]), F.get(two["b"], at["j"])  # NULL behind the end: nothing moves
            one = lambda c: F.coalesce(c.cast("int"), F.lit(0))
            return F.struct((at["i"] + one(x <= y)).alias("i"), (at["j"] + one(y <= x)).alias("j"), (at["n"] + one(x == y)).alias("n"))

        zero = F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("n"))
        return F.aggregate(F.sequence(F.lit(0), F.size(two["a"]) + F.size(two["b"])), zero, step, lambda at: at["n"])

    def count(two):
        once = lambda x: F.size(F.array_distinct(x)) == F.size(x)
        # bound by the lambda: mentioned in the merge itself the lists would be sorted again at every step
        in_order = _bind(F.struct(F.sort_array(two["a"]).alias("a"), F.sort_array(two["b"]).alias("b")), merged)
        return F.when(once(two["a"]) | once(two["b"]), F.size(F.array_intersect(two["a"], two["b"]))).otherwise(in_order)

    known = lambda x: F.filter(x, lambda t: t.isNotNull())
    return F.when(a.isNotNull() & b.isNotNull(), _bind(F.struct(known(a).alias("a"), known(b).alias("b")), count))


def qa_scores(df: DataFrame, pred_col: str, golds_col: str, id_col: str) -> DataFrame:
    """Per question: best exact match and best token F1 over the gold answers.

    Token overlap is counted inside the row (predictions and golds sit in the
    same row), so no token is shuffled; only the per-question max groups.
    """
    x = df.select(id_col, pred_col, F.posexplode(golds_col).alias("g", "gold"))
    x = x.withColumn("pt", squad_tokens(F.col(pred_col))).withColumn("gt", squad_tokens(F.col("gold")))
    em = (F.array_join("pt", " ") == F.array_join("gt", " ")).cast("double")
    same = multiset_overlap(F.col("pt"), F.col("gt"))
    np_, ng = F.size("pt"), F.size("gt")
    prec = same / F.nullif(np_, F.lit(0))
    rec = same / F.nullif(ng, F.lit(0))
    f1 = F.when((np_ == 0) | (ng == 0), (np_ == ng).cast("double")) \
        .when(same == 0, F.lit(0.0)).otherwise(2 * prec * rec / (prec + rec))
    return x.groupBy(id_col).agg(F.max(em).alias("exact_match"), F.max(f1).alias("f1"))


def qa_summary(scores: DataFrame) -> DataFrame:
    return scores.agg((F.avg("exact_match") * 100).alias("exact_match"), (F.avg("f1") * 100).alias("f1"),
                      F.count("*").alias("n"))


# ------------------------------------------------------------------ BLEU
def _ngrams(tokens: Column, n: int) -> Column:
    """The n-grams of a token list; tokens hold no blank, so a blank joins them without loss."""
    none = F.array().cast("array<string>")
    return F.when(F.size(tokens) >= n, F.transform(F.sequence(F.lit(1), F.size(tokens) - n + 1), lambda i: F.array_join(F.slice(tokens, i, n), " "))).otherwise(none)


def clipped_counts(hyp: Column, ref: Column, max_n: int) -> Column:
    """Per pair: clipped n-gram matches and hypothesis n-gram counts for n = 1..max_n, and the reference length."""
    tokens = lambda x: F.coalesce(x, F.array().cast("array<string>"))

    def count(two):
        h, r = two["h"], two["r"]
        same = [multiset_overlap(_ngrams(h, n), _ngrams(r, n)) for n in range(1, max_n + 1)]
        return F.array(*same, *[F.greatest(F.size(h) - n + 1, F.lit(0)) for n in range(1, max_n + 1)], F.size(r))

    # both token lists are cut once, though every n mentions them
    return _bind(F.struct(tokens(hyp).alias("h"), tokens(ref).alias("r")), count)


def corpus_bleu(df: DataFrame, hyp_col: str, ref_col: str, id_col: str = "row_id", max_n: int = 4) -> DataFrame:
    """Corpus BLEU (x100) on whitespace tokens of stripped text, with clipped counts,
    brevity penalty and exponential smoothing of zero-match orders.

    Clipped counts are per pair, and a pair's hypothesis and reference sit in
    the same row: sorted n-gram lists are merged inside the row, in the JVM, so no
    n-gram is ever shuffled; only 2 x max_n + 1 sums per task reach the
    final aggregate.
    """
    # the explode of one element is a Generate node: the counts are made once a row, though nine sums read them
    counts = clipped_counts(whitespace_tokens(F.col(hyp_col)), whitespace_tokens(F.col(ref_col)), max_n)
    v = df.select(F.explode(F.array(counts)).alias("v"))
    sums = v.agg(*[F.sum(F.col("v")[i]).alias(f"s{i}") for i in range(2 * max_n + 1)])
    correct = [F.col(f"s{i}") for i in range(max_n)]
    total = [F.col(f"s{max_n + i}") for i in range(max_n)]
    zeros = None
    precs = []
    for i in range(max_n):  # exponential smoothing: k-th zero-match order gets 1 / (2^k * total)
        z = (correct[i] == 0).cast("int")
        zeros = z if zeros is None else zeros + z
        precs.append(F.when(total[i] == 0, F.lit(None))
                     .when(correct[i] == 0, 100.0 / (F.pow(F.lit(2.0), zeros) * total[i]))
                     .otherwise(100.0 * correct[i] / total[i]).alias(f"p{i + 1}"))
    out = sums.select(total[0].alias("sys_len"), F.col(f"s{2 * max_n}").alias("ref_len"), *precs)
    bp = F.when(F.col("sys_len") >= F.col("ref_len"), F.lit(1.0)) \
        .when(F.col("sys_len") == 0, F.lit(0.0)) \
        .otherwise(F.exp(1 - F.col("ref_len") / F.col("sys_len")))
    logs = [F.log(F.col(f"p{i}") / 100.0) for i in range(1, max_n + 1)]
    mean_log = sum(logs[1:], logs[0]) / max_n
    return out.withColumn("bp", bp).withColumn("bleu", F.col("bp") * F.exp(mean_log) * 100.0)
