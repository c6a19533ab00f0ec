"""Quality rules with risk-controlled thresholds, with DataFrame functions only.

Base rules reject texts under 50 words or with more than half of their words in repeated 3-word windows. For
the rest, each metric gets a cutoff per stratum from labelled documents, and a document goes if any metric exceeds
its cutoff. The bound holds for that whole rule: with confidence 1 - delta, the cutoffs of every stratum reject at most
`risk` of its good documents. Labelled documents are split in two by a hash of their ids. On one half each metric's
cutoff is proposed: of those that reject hardly any good document the largest one that still rejects nearly as many bad
ones as the best. On the other half the proposal is tested, first loosened by LOOSEST steps of the grid, then step by
step less: each step's rule is used only if the exact binomial test rejects "it rejects more than `risk` of the good
documents" at level delta / strata (Bonferroni), and the first step that fails ends the stratum's sequence, so the
sequence needs no further correction. A stratum with too few labels gets no cutoffs and rejects nothing.

The text is read once; the metrics (a few numbers a document) are written to the shared folder and give the
counts. Only counts per stratum reach the driver. Beyond MAX_STRATA strata with labelled documents, those with
the fewest good ones (and strata without labels) are one pooled stratum with cutoffs of its own.

Null texts have no words. Null strata are the stratum ''. Repeated rows are judged alike; a document with
several labels counts as bad if one of them is. Labels of unknown documents count nowhere. Empty tables give
no rows. Rows with equal doc_id are one labelled document, with the largest of their metrics. Other columns of the
input are kept by `filter_documents`.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import discard, leave, materialize

SPACE = r"[\x20\x09-\x0D]+"
MAX_STRATA = 1000
#: Steps of the grid by which a proposal is loosened at first.
LOOSEST = 3
#: Windows of a text that occur again, up to which a plain look-up is used.
FEW = 32

#: Metric (larger is worse): expression over the columns of `measured`, and the cutoffs that are tried.
GRID = (0.01, 0.02, 0.03, 0.05, 0.07, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)
METRICS = {
    "symbols": "n_symbols / greatest(word_chars, 1)",
    "shouting": "n_upper / greatest(word_chars, 1)",
    "exclaiming": "n_exclaim / greatest(n_words, 1)",
    "repeating": "n_repeat_words / greatest(n_words, 1)",
    "same_lines": "n_dup_lines / greatest(n_lines, 1)",
}

def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_upper, n_exclaim."""
    t = F.coalesce(F.col(text), F.lit(""))
    one = docs.withColumns({
        "__t": t,
        "__words": F.filter(F.split(t, SPACE), lambda w: w != ""),
        "__lines": F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
    })
    two = one.withColumn("__wins", F.when(F.size("__words") < 3, F.array().cast("array<long>")).otherwise(F.expr("transform(slice(__words, 1, size(__words) - 2), (w, i) -> xxhash64(w, __words[i + 1], __words[i + 2]))")))
    three = two.withColumn("__sorted", F.sort_array("__wins"))
    four = three.withColumn("__again", F.expr("array_distinct(filter(__sorted, (h, i) -> i > 0 AND h = __sorted[greatest(i - 1, 0)]))"))
    # places of windows that occur again: by look-up if few differ, else by sorting (window, place)
    few = "filter(transform(__wins, (h, i) -> if(array_contains(__again, h), i, -1)), i -> i >= 0)"
    pairs = "sort_array(transform(__wins, (h, i) -> named_struct('h', h, 'i', i)))"
    five = four.withColumn("__pairs", F.expr(f"CASE WHEN size(__again) > {FEW} THEN {pairs} END"))
    many = "sort_array(transform(filter(transform(__pairs, (x, i) -> named_struct('i', x.i, 'ok', (i > 0 AND __pairs[greatest(i - 1, 0)].h = x.h) OR (i < size(__pairs) - 1 AND __pairs[least(i + 1, size(__pairs) - 1)].h = x.h))), x -> x.ok), x -> x.i))"
    six = five.withColumn("__at", F.expr(f"CASE WHEN size(__again) = 0 THEN array() WHEN size(__again) <= {FEW} THEN {few} ELSE {many} END"))
    covered = "aggregate(__at, named_struct('to', 0, 'n', 0L), (a, p) -> named_struct('to', p + 3, 'n', a.n + p + 3 - greatest(a.to, p)), a -> a.n)"
    return six.withColumns({
        "n_words": F.size("__words").cast("long"),
        "word_chars": F.length(F.regexp_replace("__t", SPACE, "")).cast("long"),
        "n_symbols": (F.length("__t") - F.length(F.regexp_replace("__t", "[#*$%&|<>]", ""))).cast("long"),
        "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
        "n_repeat_words": F.expr(covered),
        "n_lines": F.size("__lines").cast("long"),
        "n_upper": F.length(F.regexp_replace("__t", r"\P{Lu}+", "")).cast("long"),
        "n_exclaim": F.length(F.regexp_replace("__t", "[^!]+", "")).cast("long"),
    }).drop("__t", "__words", "__lines", "__wins", "__sorted", "__again", "__pairs", "__at")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X binomial, summed in logarithms."""
    if k >= n:
        return 1.0
    log = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
    top = max(log)
    return min(1.0, math.exp(top) * sum(math.exp(x - top) for x in log))


def allowed(k: int, n: int, risk: float, level: float) -> bool:
    """Whether k of n good documents rejected bounds the false rejection rate by `risk` at this level: the
    exact (Clopper-Pearson) upper bound of the rate is at most `risk`."""
    return n > 0 and k <= risk * n and binomial_tail(k, n, risk) <= level


def propose(row: dict, risk: float) -> dict:
    """row: good, and g_<metric>_<j>, b_<metric>_<j>: how many good and bad documents exceed cutoff j. The place in
    the grid of each metric's cutoff (None: none)."""
    out = {}
    for m in METRICS:
        fit = [j for j in range(len(GRID)) if row[f"g_{m}_{j}"] <= risk * row["good"] / (2 * len(METRICS))]
        best = max((row[f"b_{m}_{j}"] for j in fit), default=0)
        out[m] = max((j for j in fit if row[f"b_{m}_{j}"] >= 0.98 * best), default=None) if best else None
    return out


def loosened(place: int | None, steps: int) -> float | None:
    """The cutoff so many steps above a place of the grid; above the grid there is none."""
    return None if place is None or place + steps >= len(GRID) else GRID[place + steps]


def accepted(rejected: list[int], good: int, risk: float, level: float) -> int | None:
    """rejected: good documents that the rule loosened by 0, 1, .. steps rejects. The fewest steps that the sequence
    of tests, from the loosest on, reaches (None: even the loosest fails)."""
    found = None
    for steps in reversed(range(len(rejected))):
        if not allowed(rejected[steps], good, risk, level):
            break
        found = steps
    return found


def exceeds(cut: str = "cut_{}") -> Column:
    """Whether any metric exceeds its cutoff, in the columns that `cut` names."""
    out = F.lit(False)
    for m in METRICS:
        out = out | F.coalesce(F.col(m) > F.col(cut.format(m)), F.lit(False))
    return out


def thresholds(metrics: DataFrame, labels: DataFrame, risk: float = 0.005, delta: float = 0.05) -> DataFrame:
    """metrics: doc_id, stratum, base_failed and the metrics; labels: doc_id, good. A row of cutoffs per stratum;
    the pooled one's, if there is one, has a null stratum."""
    spark = metrics.sparkSession
    known = labels.groupBy("doc_id").agg(F.min(F.col("good").cast("int")).alias("good")).where("good is not null")
    once = metrics.where("not base_failed and doc_id is not null").groupBy("doc_id").agg(F.min("stratum").alias("stratum"), *[F.max(m).alias(m) for m in METRICS])
    once = materialize(once.join(known, "doc_id").withColumn("tests", F.substring(F.md5(F.col("doc_id").cast("string")), 1, 1).isin(*"13579bdf")), "labelled")
    sizes = [r["stratum"] for r in once.groupBy("stratum").agg(F.sum("good").alias("n")).orderBy(F.desc("n"), "stratum").limit(MAX_STRATA + 1).collect()]
    named = spark.createDataFrame([(x, x) for x in sizes[:MAX_STRATA]], "stratum string, cell string")
    cells = once.join(F.broadcast(named), "stratum", "left")  # MAX_STRATA rows at most; beyond them the cell is null

    aggs = [F.sum("good").alias("good")]
    for m in METRICS:
        for j, t in enumerate(GRID):
            over = (F.col(m) > t).cast("int")
            aggs += [F.sum(over * F.col("good")).alias(f"g_{m}_{j}"), F.sum(over * (1 - F.col("good"))).alias(f"b_{m}_{j}")]
    places = {r["cell"]: propose(r.asDict(), risk) for r in cells.where("not tests").groupBy("cell").agg(*aggs).collect()}

    fields = "cell string, " + ", ".join(f"cut_{m}_{s} double" for m in METRICS for s in range(LOOSEST + 1))
    tried = spark.createDataFrame([(c, *(loosened(x[m], s) for m in METRICS for s in range(LOOSEST + 1))) for c, x in places.items()], fields)
    tested = cells.where("tests").join(F.broadcast(tried), cells["cell"].eqNullSafe(tried["cell"])).drop(tried["cell"])
    counts = tested.groupBy("cell").agg(F.sum("good").alias("good"), *[F.sum(F.col("good") * exceeds(f"cut_{{}}_{s}").cast("int")).alias(f"r_{s}") for s in range(LOOSEST + 1)]).collect()
    out = []
    for r in counts:
        steps = accepted([r[f"r_{s}"] for s in range(LOOSEST + 1)], r["good"], risk, delta / len(counts))
        out.append((r["cell"], *(None if steps is None else loosened(places[r["cell"]][m], steps) for m in METRICS)))
    discard(once)
    return spark.createDataFrame(out, "stratum string, " + ", ".join(f"cut_{m} double" for m in METRICS))


def with_cuts(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """rows with their stratum's cutoffs, or the pooled stratum's if their own isn't named in cuts."""
    pooled = cuts.where("stratum is null").first()
    named = cuts.where("stratum is not null").withColumn("__named", F.lit(True))
    joined = rows.join(F.broadcast(named), "stratum", "left")  # MAX_STRATA rows at most
    if pooled:
        joined = joined.withColumns({f"cut_{m}": F.when(F.col("__named"), F.col(f"cut_{m}")).otherwise(F.lit(pooled[f"cut_{m}"])) for m in METRICS})
    return joined.drop("__named")


def judged(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", stratum: str = "lang", risk: float = 0.005, delta: float = 0.05) -> DataFrame:
    """doc_id, the base columns, base_failed and kept, for every row of docs."""
    named = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("stratum"), F.col(text).alias("text"))
    rows = materialize(measured(named).drop("text").withColumn("base_failed", base_failed()).withColumns({m: F.expr(e) for m, e in METRICS.items()}), "metrics")
    cuts = thresholds(rows, labels, risk, delta)
    return with_cuts(rows, cuts).withColumn("kept", ~F.col("base_failed") & ~exceeds()).drop(*[f"cut_{m}" for m in METRICS])


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def good_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", (F.col("quality") == 1).alias("good"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract: all documents; strata are the languages, labels those of the labels table."""
    return judged(spark.read.parquet(f"{sf_dir}/documents.parquet"), good_labels(spark, sf_dir)).select("doc_id", *BASE, "base_failed", "kept")


def filter_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the rules keep, with all their columns."""
    own = [f"__own_{i}" for i in range(len(docs.columns))]
    rows = docs.toDF(*own).withColumns({"doc_id": F.col(own[docs.columns.index("doc_id")]).cast("long"), "stratum": F.coalesce(F.col(own[docs.columns.index("lang")]).cast("string"), F.lit(""))})
    rows = measured(rows, own[docs.columns.index("text")]).withColumn("base_failed", base_failed()).withColumns({m: F.expr(e) for m, e in METRICS.items()})
    # written before anything is filtered: a filter pushed below would repeat the nested expressions
    written = leave(materialize(rows, "measured")).where("not base_failed")
    kept = with_cuts(written, thresholds(written, labels)).where(~exceeds())
    return kept.select(*own).toDF(*docs.columns)


_SPACE = r"[\x20\x09-\x0D]+"
_METRICS = ", ".join(f"{e}::DOUBLE AS {m}" for m, e in METRICS.items())
_GRID = ", ".join(f"({j}, {t}::DOUBLE)" for j, t in enumerate(GRID))
#: The same rules in DuckDB's SQL (for up to MAX_STRATA languages).
OP10_SQL = rf"""
WITH texts AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS t FROM documents),
cut AS (SELECT *, list_filter(string_split_regex(t, '{_SPACE}'), lambda x: x <> '') AS words, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM texts),
windows AS (SELECT rid, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS w FROM (SELECT rid, words, unnest(range(1, len(words) - 1)) AS i FROM cut)),
again AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, w) AS n FROM windows) WHERE n > 1),
covered AS (SELECT rid, count(DISTINCT i + k) AS n FROM again, range(3) r(k) GROUP BY rid),
base AS (SELECT rid, doc_id, stratum, len(words)::BIGINT AS n_words, length(regexp_replace(t, '{_SPACE}', '', 'g'))::BIGINT AS word_chars, (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words, len(lines)::BIGINT AS n_lines,
  length(regexp_replace(t, '\P{{Lu}}+', '', 'g')) AS n_upper, length(regexp_replace(t, '[^!]+', '', 'g')) AS n_exclaim FROM cut LEFT JOIN covered USING (rid)),
measured AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, {_METRICS} FROM base),
known AS (SELECT doc_id, min((quality = 1)::INT) AS good FROM labels GROUP BY doc_id HAVING min((quality = 1)::INT) IS NOT NULL),
once AS (SELECT doc_id, min(stratum) AS stratum, {', '.join(f'max({m}) AS {m}' for m in METRICS)} FROM measured WHERE NOT base_failed AND doc_id IS NOT NULL GROUP BY doc_id),
labelled AS (SELECT *, substr(md5(doc_id::VARCHAR), 1, 1) IN ('1', '3', '5', '7', '9', 'b', 'd', 'f') AS tests FROM once JOIN known USING (doc_id)),
long AS (UNPIVOT labelled ON {', '.join(METRICS)} INTO NAME metric VALUE x),
grid(j, t) AS (VALUES {_GRID}),
tried AS (SELECT stratum, metric, j, sum(good) AS n, sum(good) FILTER (x > t) AS g, coalesce(sum(1 - good) FILTER (x > t), 0) AS b FROM long, grid WHERE NOT tests GROUP BY ALL),
fit AS (SELECT *, max(b) OVER (PARTITION BY stratum, metric) AS best FROM tried WHERE coalesce(g, 0) <= 0.005::DOUBLE * n / {2 * len(METRICS)}),
proposed AS (SELECT stratum, metric, max(j) FILTER (b >= 0.98::DOUBLE * best AND best > 0) AS place FROM fit GROUP BY ALL),
loosened AS (SELECT stratum, metric, s, t AS cut FROM proposed, range({LOOSEST + 1}) r(s) LEFT JOIN grid ON j = place + s),
cells AS (SELECT DISTINCT stratum FROM labelled WHERE NOT tests INTERSECT SELECT stratum FROM labelled WHERE tests),
judged AS (SELECT stratum, doc_id, s, any_value(good) AS good, coalesce(bool_or(x > cut), false) AS gone FROM long JOIN cells USING (stratum) LEFT JOIN loosened USING (stratum, metric) WHERE tests GROUP BY ALL),
steps AS (SELECT stratum, s, sum(good)::BIGINT AS n, coalesce(sum(good) FILTER (gone), 0)::BIGINT AS k FROM judged GROUP BY ALL),
bounded AS (SELECT *, n > 0 AND k <= 0.005::DOUBLE * n AND CASE WHEN k >= n THEN 1 ELSE list_sum(list_transform(range(k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.005::DOUBLE) + (n - i) * ln(1 - 0.005::DOUBLE)))) END
  <= 0.05::DOUBLE / (SELECT count(*) FROM cells) AS ok FROM steps WHERE s IS NOT NULL),
reached AS (SELECT stratum, min(s) AS s FROM (SELECT *, bool_and(ok) OVER (PARTITION BY stratum ORDER BY s DESC) AS so_far FROM bounded) WHERE so_far GROUP BY stratum),
cuts AS (SELECT stratum, {', '.join(f"max(cut) FILTER (metric = '{m}') AS cut_{m}" for m in METRICS)} FROM loosened JOIN reached USING (stratum, s) GROUP BY stratum)
SELECT doc_id, {', '.join(BASE)}, base_failed, NOT base_failed AND NOT ({' OR '.join(f'coalesce({m} > cut_{m}, false)' for m in METRICS)}) AS kept FROM measured LEFT JOIN cuts USING (stratum)"""
