"""Chunking (CHK-*) and evaluation-metric (MET-*) queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from poolpick import fixtures as fx
from poolpick.fixtures import with_views
from poolpick.functions.scores import argmax
from poolpick.functions.text import ARTICLES, PUNCT_CLASS, whitespace_tokens
from poolpick.operators import chunking as ch
from poolpick.operators import metrics as me
from poolpick.plans.registry import r6, register
from poolpick.session import dealt, dealt_if_few

# ------------------------------------------------------------------ chunking
W, O = 128, 64          # CHK-1 window and overlap (stride 64), in whitespace tokens
CW, CO, CH = 64, 32, 4  # CHK-2 window/overlap in fixed-width tokens of 4 characters
_DTOKS = "list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')"


@register("chunk_windows", with_views(
    f"SELECT row_id, CAST(row_number() OVER (PARTITION BY row_id ORDER BY start) - 1 AS INTEGER) AS win, "
    f"CAST(start AS INTEGER) AS start, CAST(len(list_slice(toks, start + 1, start + {W})) AS INTEGER) AS n_tok, "
    f"md5(array_to_string(list_slice(toks, start + 1, start + {W}), ' ')) AS window_md5 FROM "
    f"(SELECT row_id, toks, unnest(range(0, greatest(len(toks) - {O}, 1), {W - O})) AS start FROM "
    f"(SELECT row_id, {_DTOKS} AS toks FROM docs))", "docs"))
def q_chunk_windows(spark, sf_dir):
    d = dealt_if_few(fx.docs_df(spark, sf_dir).select("row_id", "text"), "row_id")
    d = d.select("row_id", whitespace_tokens(F.col("text")).alias("toks"))
    c = ch.chunk_windows(d, "toks", W, O)
    return c.select("row_id", "win", "start", F.size("window").alias("n_tok"),
                    F.md5(F.array_join("window", " ")).alias("window_md5"))


def _char_windows(docs):
    """Fixed-width (4-character) token windows of each document with their offsets."""
    n_tok = F.ceil(F.length("text") / CH).cast("int")
    x = docs.select("row_id", F.length("text").alias("len"), n_tok.alias("ntok"))
    x = x.select("row_id", "len", "ntok", F.posexplode(ch.window_starts(F.col("ntok"), CW, CO)).alias("win", "ws"))
    size = F.least(F.lit(CW), F.col("ntok") - F.col("ws"))
    return x.withColumn("offsets", ch.fixed_offsets(F.col("ws"), size, CH, F.col("len")))


@register("span_in_window", with_views(
    f"SELECT item_id, row_id, win, CASE WHEN inside THEN CAST(answer_start // {CH} - ws AS INTEGER) ELSE 0 END "
    f"AS start_positions, CASE WHEN inside THEN CAST((answer_start + length(answer) - 1) // {CH} - ws AS INTEGER) "
    f"ELSE 0 END AS end_positions FROM (SELECT a.item_id, a.row_id, w.win, w.ws, a.answer_start, a.answer, "
    f"({CH} * w.ws <= a.answer_start AND least({CH} * (w.ws + least({CW}, w.ntok - w.ws)), w.len) "
    f">= a.answer_start + length(a.answer)) AS inside FROM answers a JOIN "
    f"(SELECT row_id, len, ntok, CAST(row_number() OVER (PARTITION BY row_id ORDER BY ws) - 1 AS INTEGER) AS win, ws "
    f"FROM (SELECT row_id, len, ntok, unnest(range(0, greatest(ntok - {CO}, 1), {CW - CO})) AS ws FROM "
    f"(SELECT row_id, length(text) AS len, CAST(ceil(length(text) / {CH}) AS INTEGER) AS ntok FROM docs))) w "
    f"USING (row_id))", "docs", "answers"))
def q_span_in_window(spark, sf_dir):
    """JOIN-8 + CHK-2: answer spans against every window of their document."""
    a = fx.answers_df(spark, sf_dir)
    docs = fx.docs_df(spark, sf_dir).join(a.select("row_id").distinct(), "row_id", "left_semi")
    j = _char_windows(docs).join(a, "row_id")
    lab = ch.span_labels(F.col("offsets"), F.col("answer_start"), F.col("answer_start") + F.length("answer"))
    return j.select("item_id", "row_id", "win", lab["start_positions"].cast("int").alias("start_positions"),
                    lab["end_positions"].cast("int").alias("end_positions"))


# QA feature layout of the fixture: positions 0..3 hold the question, positions 4..31 are
# 28 context tokens of 4 characters; consecutive windows start 14 context tokens apart.
QA_Q, QA_POS, QA_STRIDE = 4, 32, 14


def qa_window_offsets(ws, text_len):
    """(offsets, sequence ids) of one 32-position feature whose context starts at token ``ws``.

    Question positions get question-relative spans (sequence id 0); context
    positions map into the whole text (id 1); positions past the end of the
    text are padding (id NULL)."""
    last = F.lit((QA_Q - 1) * CH)

    def places(by):  # where each position begins (or ends, ``by`` characters later)
        return F.concat(F.sequence(F.lit(by), last + by, F.lit(CH)), F.sequence(ws * CH + by, (ws + (QA_POS - QA_Q - 1)) * CH + by, F.lit(CH)))

    offs = F.arrays_zip(places(0).alias("s"), places(3).alias("e"))
    n_text = F.least(F.ceil(text_len / CH).cast("int") - ws, F.lit(QA_POS - QA_Q))
    seq = F.concat(F.array_repeat(F.lit(0), QA_Q), F.array_repeat(F.lit(1), n_text), F.array_repeat(F.lit(None).cast("int"), F.lit(QA_POS - QA_Q) - n_text))
    return offs, seq


@register("mask_offsets", with_views(
    f"SELECT row_id, win, count(*) FILTER (WHERE live) AS n_live, "
    f"CAST(min(s) FILTER (WHERE live) AS INTEGER) AS first_s, CAST(max(e) FILTER (WHERE live) AS INTEGER) AS last_e "
    f"FROM (SELECT row_id, win, p >= {QA_Q} AND {CH} * (ws + p - {QA_Q}) < len AS live, {CH} * (ws + p - {QA_Q}) AS s, "
    f"{CH} * (ws + p - {QA_Q}) + 3 AS e FROM (SELECT row_id, len, "
    f"CAST(row_number() OVER (PARTITION BY row_id ORDER BY ws) - 1 AS INTEGER) AS win, ws FROM "
    f"(SELECT row_id, len, unnest(range(0, greatest(ntok - {QA_STRIDE}, 1), {QA_STRIDE})) AS ws FROM "
    f"(SELECT row_id, length(text) AS len, CAST(ceil(length(text) / {CH}) AS BIGINT) AS ntok FROM docs))), "
    f"range({QA_POS}) t(p)) GROUP BY row_id, win", "docs"))
def q_mask_offsets(spark, sf_dir):
    """CHK-3: every QA window over every whole document; question and padding positions
    lose their offsets. Reported per window: live positions and the covered span."""
    d = fx.docs_df(spark, sf_dir).select("row_id", F.length("text").alias("len"))
    n_tok = F.ceil(F.col("len") / CH).cast("int")
    w = d.select("row_id", "len", F.posexplode(ch.window_starts(n_tok, 2 * QA_STRIDE, QA_STRIDE)).alias("win", "ws"))
    w = dealt(w, "row_id", F.col("win").bitwiseAND(~0xFFF))
    offs, seq = qa_window_offsets(F.col("ws"), F.col("len"))
    m = w.select("row_id", "win", F.filter(ch.mask_offsets(offs, seq), lambda o: o.isNotNull()).alias("live"))
    return m.select("row_id", "win", F.size("live").cast("long").alias("n_live"),
                    F.array_min(F.transform("live", lambda o: o["s"])).alias("first_s"),
                    F.array_max(F.transform("live", lambda o: o["e"])).alias("last_e"))


def _word_ids(t):
    return t.withColumn("word_id", F.when((F.col("pos") == 0) | (F.col("pos") == 15), F.lit(None))
                        .otherwise(F.expr("pos div 2"))) \
        .withColumn("word_label", (F.col("row_id") + F.col("word_id")) % 4)


@register("align_labels", with_views(
    "SELECT row_id, CAST(pos AS INTEGER) AS pos, CAST(CASE WHEN word_id IS NOT NULL AND (pw IS NULL OR pw <> word_id) THEN word_label "
    "ELSE -100 END AS INTEGER) AS aligned FROM (SELECT *, lag(word_id) OVER (PARTITION BY row_id ORDER BY pos) AS pw "
    "FROM (SELECT row_id, pos, CASE WHEN pos = 0 OR pos = 15 THEN NULL ELSE pos // 2 END AS word_id, "
    "(row_id + CASE WHEN pos = 0 OR pos = 15 THEN NULL ELSE pos // 2 END) % 4 AS word_label FROM tok))", "tok"))
def q_align_labels(spark, sf_dir):
    t = _word_ids(fx.tok_df(spark, sf_dir).select("row_id", "pos"))
    return ch.align_labels(t).select("row_id", "pos", "aligned")


def _label_lists(spark, sf_dir):
    return ch.ordered_list(fx.tok_df(spark, sf_dir), "row_id", "pos", "lab", "labels")


@register("pad_truncate", with_views(
    "SELECT 12 AS max_len, row_id, CAST(pos AS INTEGER) AS pos, lab AS label FROM tok WHERE pos < 12 UNION ALL "
    "SELECT 20, r.row_id, CAST(x.p AS INTEGER), coalesce(t.lab, -100) FROM (SELECT DISTINCT row_id FROM tok) r "
    "CROSS JOIN range(20) x(p) LEFT JOIN tok t ON t.row_id = r.row_id AND t.pos = x.p", "tok"))
def q_pad_truncate(spark, sf_dir):
    """CHK-5: label lists cut to 12 and padded (with -100) to 20."""
    l = _label_lists(spark, sf_dir)
    out = None
    for n in (12, 20):
        x = l.select(F.lit(n).alias("max_len"), "row_id",
                     F.posexplode(ch.pad_truncate(F.col("labels"), n, -100)).alias("pos", "label"))
        out = x if out is None else out.unionByName(x)
    return out


@register("unmask_labels", with_views(
    "SELECT row_id, CAST(pos AS INTEGER) AS pos, CASE WHEN lab = -100 THEN 1 ELSE lab END AS label FROM tok", "tok"))
def q_unmask_labels(spark, sf_dir):
    """CHK-6: -100 becomes the pad id (1) before decoding."""
    l = _label_lists(spark, sf_dir)
    return l.select("row_id", F.posexplode(ch.unmask(F.col("labels"), 1)).alias("pos", "label"))


# ------------------------------------------------------------------ metrics
@register("token_accuracy", with_views(
    "SELECT round(avg(CASE WHEN list_position(z, list_max(z)) - 1 = lab THEN 1.0 ELSE 0.0 END), 6) AS accuracy, "
    "count(*) AS n FROM tok WHERE lab <> -100", "tok"))
def q_token_accuracy(spark, sf_dir):
    t = fx.tok_df(spark, sf_dir).where(F.col("lab") != -100).select(argmax(F.col("z")).alias("pred"),
                                                                      F.col("lab").alias("gold"))
    return me.token_accuracy(t).select(r6("accuracy").alias("accuracy"), "n")


# Fixed values of the fixture: BIO tag names of label ids 0..3.
BIO_TAGS = ["O", "B-PER", "I-PER", "B-LOC"]


def _tag(c):
    return F.element_at(F.array(*[F.lit(t) for t in BIO_TAGS]), c + 1)


_SPAN_SQL = """
(SELECT row_id, min(p) AS start, max(p) AS "end", first(t) AS type FROM (
  SELECT *, sum(CASE WHEN t IS NOT NULL AND (tag LIKE 'B-%' OR pt IS NULL OR pt <> t) THEN 1 ELSE 0 END)
         OVER (PARTITION BY row_id ORDER BY p ROWS UNBOUNDED PRECEDING) AS sp FROM (
    SELECT *, lag(t) OVER (PARTITION BY row_id ORDER BY p) AS pt FROM (
      SELECT row_id, p, tag, CASE WHEN tag = 'O' THEN NULL ELSE substring(tag, 3) END AS t FROM (
        SELECT row_id, row_number() OVER (PARTITION BY row_id ORDER BY pos) AS p,
               (['O','B-PER','I-PER','B-LOC'])[{col} + 1] AS tag FROM u)))) WHERE t IS NOT NULL GROUP BY row_id, sp)
"""


@register("span_f1", with_views(
    "SELECT n_gold, n_pred, tp, round(pr, 6) AS precision, round(rc, 6) AS recall, "
    "round(CASE WHEN pr + rc = 0 THEN 0.0 ELSE 2 * pr * rc / (pr + rc) END, 6) AS f1 FROM ("
    "SELECT *, coalesce(tp / NULLIF(n_pred, 0), 0.0) AS pr, coalesce(tp / NULLIF(n_gold, 0), 0.0) AS rc FROM ("
    "SELECT count(g.row_id) AS n_gold, count(pr.row_id) AS n_pred, "
    "count(CASE WHEN g.row_id IS NOT NULL AND pr.row_id IS NOT NULL THEN 1 END) AS tp "
    f"FROM {_SPAN_SQL.format(col='lab')} g FULL JOIN {_SPAN_SQL.format(col='pred')} pr "
    "ON g.row_id = pr.row_id AND g.start = pr.start AND g.\"end\" = pr.\"end\" AND g.type = pr.type))",
    "tok", extra=[("u", "SELECT row_id, pos, lab, CAST(list_position(z, list_max(z)) - 1 AS INTEGER) AS pred "
                        "FROM tok WHERE lab <> -100")]))
def q_span_f1(spark, sf_dir):
    """MET-2: exact-match entity spans on BIO tags over the unmasked positions."""
    t = fx.tok_df(spark, sf_dir).where(F.col("lab") != -100)
    w = Window.partitionBy("row_id").orderBy("pos")
    t = t.select("row_id", F.row_number().over(w).alias("p"), _tag(F.col("lab")).alias("gold_tag"),
                 _tag(argmax(F.col("z"))).alias("pred_tag"))
    gold = me.token_spans(t, "gold_tag", pos_col="p")
    pred = me.token_spans(t, "pred_tag", pos_col="p")
    s = me.span_f1(gold, pred)
    return s.select("n_gold", "n_pred", "tp", r6("precision").alias("precision"), r6("recall").alias("recall"),
                    r6("f1").alias("f1"))


@register("weighted_f1", with_views(
    "SELECT round(sum(f1 * support) / sum(support), 6) AS weighted_f1, CAST(sum(support) AS BIGINT) AS n FROM ("
    "SELECT g.cls, g.support, CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END AS f1 FROM ("
    "SELECT g.cls, g.support, coalesce(tp.n / NULLIF(pc.n, 0), 0.0) AS p, coalesce(tp.n / g.support, 0.0) AS r "
    "FROM (SELECT gold AS cls, count(*) AS support FROM sp GROUP BY gold) g "
    "LEFT JOIN (SELECT pred AS cls, count(*) AS n FROM sp GROUP BY pred) pc USING (cls) "
    "LEFT JOIN (SELECT gold AS cls, count(*) AS n FROM sp WHERE pred = gold GROUP BY gold) tp USING (cls)) g)",
    "seqlog", extra=[("sp", "SELECT CAST(list_position(z, list_max(z)) - 1 AS INTEGER) AS pred, gold FROM seqlog")]))
def q_weighted_f1(spark, sf_dir):
    s = fx.seqlog_df(spark, sf_dir).select(argmax(F.col("z")).alias("pred"), "gold")
    return me.weighted_f1(s).select(r6("weighted_f1").alias("weighted_f1"), "n")


def _qa_inputs(spark, sf_dir):
    """Predictions shifted from the gold answer by 0/5/10 characters; golds = answer and its first half."""
    a = fx.answers_df(spark, sf_dir)
    d = fx.docs_df(spark, sf_dir).select("row_id", "text")
    j = a.join(d, "row_id")
    pred = F.substring(F.col("text"), F.col("answer_start") + 1 + (F.col("item_id") % 3) * 5, F.length("answer"))
    golds = F.array(F.col("answer"), F.substring(F.col("answer"), 1, F.expr("length(answer) div 2")))
    return j.select(F.concat_ws(":", "item_id", "row_id").alias("qid"), pred.alias("pred"),
                    golds.alias("golds"))


_ART = ", ".join(f"'{a}'" for a in ARTICLES)
_QA_TOKS = ("list_filter(string_split_regex(regexp_replace(lower(@X@), '" + PUNCT_CLASS.replace("'", "''")
            + "', '', 'g'), '\\s+'), lambda t: t <> '' AND t NOT IN (" + _ART + "))")
_QA_CTES = [
    ("qi", "SELECT concat(a.item_id, ':', a.row_id) AS qid, substring(d.text, a.answer_start + 1 + "
           "(a.item_id % 3) * 5, length(a.answer)) AS pred, [a.answer, substring(a.answer, 1, length(a.answer) // 2)] "
           "AS golds FROM answers a JOIN docs d USING (row_id)"),
    ("qg", f"SELECT qid, g, {_QA_TOKS.replace('@X@', 'pred')} AS pt, {_QA_TOKS.replace('@X@', 'golds[g]')} AS gt "
           f"FROM qi, range(1, 3) r(g)"),
    ("pc", "SELECT qid, g, tok, count(*) AS a FROM (SELECT qid, g, unnest(pt) AS tok FROM qg) GROUP BY ALL"),
    ("gc", "SELECT qid, g, tok, count(*) AS b FROM (SELECT qid, g, unnest(gt) AS tok FROM qg) GROUP BY ALL"),
    ("sm", "SELECT qid, g, sum(least(a, b)) AS same FROM pc JOIN gc USING (qid, g, tok) GROUP BY ALL"),
    ("qs", "SELECT qid, max(CASE WHEN array_to_string(pt, ' ') = array_to_string(gt, ' ') THEN 1.0 ELSE 0.0 END) "
           "AS em, max(CASE WHEN len(pt) = 0 OR len(gt) = 0 THEN CASE WHEN len(pt) = len(gt) THEN 1.0 ELSE 0.0 END "
           "WHEN coalesce(same, 0) = 0 THEN 0.0 ELSE 2 * (same / len(pt)) * (same / len(gt)) / "
           "((same / len(pt)) + (same / len(gt))) END) AS f1 FROM qg LEFT JOIN sm USING (qid, g) GROUP BY qid"),
]


@register("qa_exact_match", with_views("SELECT round(avg(em) * 100, 6) AS exact_match, count(*) AS n FROM qs",
                                       "docs", "answers", extra=_QA_CTES))
def q_qa_exact_match(spark, sf_dir):
    s = me.qa_summary(me.qa_scores(_qa_inputs(spark, sf_dir), "pred", "golds", "qid"))
    return s.select(r6("exact_match").alias("exact_match"), "n")


@register("qa_token_f1", with_views("SELECT round(avg(f1) * 100, 6) AS f1, count(*) AS n FROM qs",
                                    "docs", "answers", extra=_QA_CTES))
def q_qa_token_f1(spark, sf_dir):
    s = me.qa_summary(me.qa_scores(_qa_inputs(spark, sf_dir), "pred", "golds", "qid"))
    return s.select(r6("f1").alias("f1"), "n")


_WS = "list_filter(string_split_regex({x}, '\\s+'), lambda t: t <> '')"
_BLEU_CTES = [
    ("bt", f"SELECT row_id, {_WS.format(x='source')} AS h, {_WS.format(x='target')} AS r FROM pairs"),
    ("hg", "SELECT row_id, n, gram, count(*) AS cnt FROM (SELECT row_id, n, array_to_string(list_slice(h, i, i + n - 1), "
           "' ') AS gram FROM bt, range(1, 5) o(n), LATERAL (SELECT unnest(range(1, len(h) - n + 2)) AS i) "
           "WHERE len(h) >= n) GROUP BY ALL"),
    ("rg", "SELECT row_id, n, gram, count(*) AS rcnt FROM (SELECT row_id, n, array_to_string(list_slice(r, i, i + n - 1), "
           "' ') AS gram FROM bt, range(1, 5) o(n), LATERAL (SELECT unnest(range(1, len(r) - n + 2)) AS i) "
           "WHERE len(r) >= n) GROUP BY ALL"),
    ("pn", "SELECT o.n, coalesce(c.correct, 0) AS correct, coalesce(c.total, 0) AS total, "
           "coalesce(rt.rtotal, 0) AS rtotal FROM range(1, 5) o(n) "
           "LEFT JOIN (SELECT n, sum(least(cnt, coalesce(rcnt, 0))) AS correct, sum(cnt) AS total FROM hg "
           "LEFT JOIN rg USING (row_id, n, gram) GROUP BY n) c USING (n) "
           "LEFT JOIN (SELECT n, sum(rcnt) AS rtotal FROM rg GROUP BY n) rt USING (n)"),
    ("pz", "SELECT *, sum(CASE WHEN correct = 0 THEN 1 ELSE 0 END) OVER (ORDER BY n ROWS UNBOUNDED PRECEDING) AS z, "
           "CASE WHEN total = 0 THEN NULL WHEN correct = 0 THEN 100.0 / (pow(2.0, sum(CASE WHEN correct = 0 THEN 1 "
           "ELSE 0 END) OVER (ORDER BY n ROWS UNBOUNDED PRECEDING)) * total) ELSE 100.0 * correct / total END AS p "
           "FROM pn"),
    ("bl", "SELECT CAST(max(CASE WHEN n = 1 THEN total END) AS BIGINT) AS sys_len, "
           "CAST(max(CASE WHEN n = 1 THEN rtotal END) AS BIGINT) AS ref_len, "
           "max(CASE WHEN n = 1 THEN p END) AS p1, max(CASE WHEN n = 2 THEN p END) AS p2, "
           "max(CASE WHEN n = 3 THEN p END) AS p3, max(CASE WHEN n = 4 THEN p END) AS p4 FROM pz"),
]


@register("corpus_bleu", with_views(
    "SELECT sys_len, ref_len, round(p1, 6) AS p1, round(p2, 6) AS p2, round(p3, 6) AS p3, round(p4, 6) AS p4, "
    "round(bp, 6) AS bp, round(bp * exp((ln(p1 / 100) + ln(p2 / 100) + ln(p3 / 100) + ln(p4 / 100)) / 4) * 100, 6) "
    "AS bleu FROM (SELECT *, CASE WHEN sys_len >= ref_len THEN 1.0 WHEN sys_len = 0 THEN 0.0 "
    "ELSE exp(1 - ref_len / sys_len) END AS bp FROM bl)", "pairs", extra=_BLEU_CTES))
def q_corpus_bleu(spark, sf_dir):
    """MET-5: corpus BLEU of user turns scored against the assistant replies."""
    b = me.corpus_bleu(fx.pairs_df(spark, sf_dir), "source", "target")
    return b.select(F.col("sys_len").cast("long").alias("sys_len"), F.col("ref_len").cast("long").alias("ref_len"),
                    *[r6(f"p{i}").alias(f"p{i}") for i in range(1, 5)], r6("bp").alias("bp"), r6("bleu").alias("bleu"))


@register("predictions_by_language", with_views(
    "SELECT v.language, count(*) AS n, count(*) FILTER (WHERE list_position(s.z, list_max(s.z)) - 1 = s.gold) "
    "AS n_correct FROM seqlog s JOIN vec v USING (row_id) GROUP BY v.language", "seqlog", "vec"))
def q_predictions_by_language(spark, sf_dir):
    """MET-7: predictions pooled per language."""
    s = fx.vec_logits_df(spark, sf_dir)
    return s.groupBy("language").agg(F.count("*").alias("n"),
                                     F.count_if(argmax(F.col("z")) == F.col("gold")).alias("n_correct"))
