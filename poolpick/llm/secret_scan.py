"""Secret scan, in DataFrame functions only.

Base kinds are regular expressions (assign, access, hex). The method adds
kind ``markov``: runs of key characters outside the base spans whose
characters look drawn at random. Two first-order character models are
trained from labelled samples, one of random strings (the values that the base kinds
found), one of ordinary identifiers (words of texts without base match);
a run is a secret if the log-likelihood ratio of the two reaches
``MIN_MEAN`` a character and ``MIN_SUM`` in all.

The two transition tables have one row per pair of the 66 symbols, whatever the
corpus; only they reach the driver. Random samples come from all documents;
ordinary samples from about ``SAMPLE_DOCS`` documents chosen by id hash (a documented
bound for fitting; scanning always covers all).

Positions count code points, end exclusive. A regular expression's matches are placed
by the lengths of the pieces between them, at a cost that grows with their number (not its square). Cases: a null or empty text has no
spans; a null doc_id is scanned alike; repeated rows are scanned
each; without samples of both kinds there is no markov span; an empty table
gives an empty result. Further columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from poolpick.llm.common import has, text_of, write_out

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS, HEX = r"AKIA[A-Z0-9]+", r"[0-9a-f]{32,}"
RUN = r"[A-Za-z0-9+/_=-]{20,}"
WORDLIKE = r"[A-Za-z][A-Za-z0-9_]{7,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_="  # '-' and all others share the last place
SIZE = len(ALPHABET) + 1
KINDS = ("assign", "access", "hex", "markov")
SAMPLE_DOCS = 20_000
MIN_MEAN, MIN_SUM = 0.8, 16.0
GROUP = 256  # matches that are placed together
NONE = "cast(array() as array<struct<s:int,e:int,v:string>>)"


def _placed(text: str, pattern: str, value_group: int, fits: str, when: str) -> str:
    """SQL for the matches of ``pattern`` that fit, as array<struct<s, e, v>>.

    Places are running sums of lengths. A list that grows inside an ``aggregate`` is copied at every step, so
    matches are placed in groups of ``GROUP``: the groups' own lengths first, then each group from its offset.
    """
    p = "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"
    pairs = f"arrays_zip(regexp_extract_all({text}, {p}, 0), regexp_extract_all({text}, {p}, {value_group}), split({text}, {p}, -1))"
    groups = f"transform(sequence(0, (size(ps) - 1) div {GROUP}), g -> slice(ps, g * {GROUP} + 1, {GROUP}))"
    offsets = """aggregate(gs, struct(0 as at, cast(array() as array<int>) as all),
        (acc, g) -> struct(acc.at + aggregate(g, 0, (n, m) -> n + length(m['2']) + length(m['0'])) as at, concat(acc.all, array(acc.at)) as all)).all"""
    inside = f"""aggregate(g, struct(o as at, {NONE} as found),
        (acc, m) -> struct(acc.at + length(m['2']) + length(m['0']) as at,
                           concat(acc.found, array(struct(acc.at + length(m['2']) as s, acc.at + length(m['2']) + length(m['0']) as e, m['1'] as v))) as found)).found"""
    # a lambda over one element binds its value: mentioned below, an expression would be evaluated at every step
    grouped = f"element_at(transform(array({groups}), gs -> flatten(zip_with(gs, {offsets}, (g, o) -> {inside}))), 1)"
    # arrays_zip pads: the last piece between has no match
    matches = f"element_at(transform(array(filter({pairs}, m -> m['0'] is not null)), ps -> if(size(ps) = 0, {NONE}, {grouped})), 1)"
    return f"case when {when} then filter({matches}, x -> {fits}) else {NONE} end"


def base_spans(docs: DataFrame) -> DataFrame:
    """doc_id, the three base kinds and the runs of key characters that touch none of them, each array<struct<s, e, v>>."""
    t = docs.select("doc_id", text_of(docs).alias("text"))
    low = "lower(text)"
    named = " or ".join(f"contains({low}, '{w}')" for w in ("password", "passwd", "secret", "token", "apikey", "api_key"))
    found = write_out(t.selectExpr(
        "monotonically_increasing_id() as row", "doc_id", _placed("text", ASSIGN, 2, "length(x.v) >= 8", named) + " as assign",
        _placed("text", ACCESS, 0, "length(x.v) >= 16", "contains(text, 'AKIA')") + " as access",
        _placed("text", HEX, 0, "true", f"text rlike '{HEX}'") + " as hex",
        _placed("text", RUN, 0, "true", f"text rlike '{RUN}'") + " as runs"), "secret_matches")  # texts are searched once
    both = (F.size("runs") > 0) & (F.size("assign") + F.size("access") + F.size("hex") > 0)
    if not has(found.where(both)):
        return found.drop("row")
    part = lambda kinds, k: F.transform(kinds, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["v"].alias("v"), F.lit(k).alias("k")))
    m = found.where(both).select("row", F.explode(F.concat(part(F.concat("assign", "access", "hex"), 0), part(F.col("runs"), 1))).alias("m")).select("row", "m.*")
    # spans in order, both ways: the furthest base end before a run, and the nearest base start behind it
    ahead = Window.partitionBy("row").orderBy("s", "k").rowsBetween(Window.unboundedPreceding, -1)
    back = Window.partitionBy("row").orderBy(F.desc("s"), F.desc("k")).rowsBetween(Window.unboundedPreceding, -1)
    m = m.withColumn("ended", F.max(F.when(F.col("k") == 0, F.col("e"))).over(ahead)).withColumn("starts", F.min(F.when(F.col("k") == 0, F.col("s"))).over(back))
    clear = m.where("k = 1 and coalesce(ended <= s, true) and coalesce(starts >= e, true)")
    clear = clear.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("s", "e", "v"))).alias("clear"))
    runs = F.when(both, F.coalesce("clear", F.expr(NONE))).otherwise(F.col("runs"))
    return found.join(clear, "row", "left").select("doc_id", "assign", "access", "hex", runs.alias("runs"))


def random_samples(spans: DataFrame) -> DataFrame:
    return spans.select(F.explode(F.concat("assign", "access", "hex")).alias("m")).select(F.col("m.v").alias("value"), F.lit(1).alias("random"))


def ordinary_samples(docs: DataFrame, n_docs: int, limit: int = SAMPLE_DOCS) -> DataFrame:
    """Words of texts without a base match, from about ``limit`` documents."""
    share = min(1.0, limit / max(n_docs, 1))
    t = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000)).select(text_of(docs).alias("text"))
    clean = ~(F.col("text").rlike(ASSIGN) | F.col("text").contains("AKIA") | F.col("text").rlike(HEX))
    return (t.where(clean).select(F.explode(F.regexp_extract_all("text", F.lit(WORDLIKE), F.lit(0))).alias("value"))
            .select("value", F.lit(0).alias("random")))


def _codes(value: str) -> str:
    """SQL for the symbol numbers of a string: place in the alphabet, the last for others."""
    return f"transform(split({value}, ''), c -> (instr('{ALPHABET}', c) + {SIZE - 1}) % {SIZE})"


def train(samples: DataFrame) -> list[float] | None:
    """Log ratios of the two transition tables (row-major), from rows (value, random)."""
    pairs = (samples.where("length(value) > 1").selectExpr("random", f"{_codes('value')} as c")
             .selectExpr("random", f"explode(zip_with(slice(c, 1, size(c) - 1), slice(c, 2, size(c) - 1), (a, b) -> a * {SIZE} + b)) as pair"))
    counts = {(r.random, r.pair): r["count"] for r in pairs.groupBy("random", "pair").count().collect()}
    if {k for k, _ in counts} != {0, 1}:
        return None
    logs = {}
    for kind in (0, 1):
        for a in range(SIZE):
            row = [counts.get((kind, a * SIZE + b), 0) for b in range(SIZE)]
            total = sum(row)
            logs[kind, a] = [math.log((n + 0.5) / (total + 0.5 * SIZE)) for n in row]
    return [logs[1, a][b] - logs[0, a][b] for a in range(SIZE) for b in range(SIZE)]


def _with_ratio(spans: DataFrame, ratios: list[float]) -> DataFrame:
    """Runs that look random, as ``markov``."""
    table = F.split(F.lit(",".join(f"{r:.6f}" for r in ratios)), ",").cast("array<double>")  # folded to one literal
    codes = lambda v: F.transform(F.split(v, ""), lambda c: (F.call_function("instr", F.lit(ALPHABET), c) + (SIZE - 1)) % SIZE)

    def ratio(v):
        c, n = codes(v), F.length(v)
        steps = F.zip_with(F.slice(c, F.lit(1), n - 1), F.slice(c, F.lit(2), n - 1), lambda a, b: F.get(table, a * SIZE + b))
        return F.aggregate(steps, F.lit(0.0), lambda acc, x: acc + x)

    def random(run):
        score = ratio(run["v"])
        return (score >= MIN_SUM) & (score >= MIN_MEAN * (F.length(run["v"]) - 1))

    return spans.withColumn("markov", F.filter("runs", random))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256, spans of every row of ``docs``."""
    spans = write_out(base_spans(docs), "secret_spans")
    samples = random_samples(spans).unionByName(ordinary_samples(docs, spans.count()))
    ratios = train(samples)
    spans = _with_ratio(spans, ratios) if ratios else spans.withColumn("markov", F.expr(NONE))

    def listed(kinds):
        parts = [F.expr(f"transform({k}, x -> struct(x.s as s, {KINDS.index(k)} as k, x.e as e))") for k in kinds]
        named = F.array(*[F.lit(k) for k in KINDS])
        return F.array_join(F.transform(F.array_sort(F.concat(*parts)), lambda x: F.concat_ws(":", F.get(named, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")

    return spans.select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]],
                        F.sha2(listed(KINDS[:3]).cast("binary"), 256).alias("base_sha256"), listed(KINDS).alias("spans"),
                        F.size("markov").cast("long").alias("n_markov"))
