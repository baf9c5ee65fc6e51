"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each source gets a budget of tokens: its share of the target weights times the whole budget. As many complete epochs of
the source as fit go in first; the rest of its budget is filled with a weighted sample without replacement: every
document draws the exponential key -ln(u) / quality weight, with u from a hash of seed, doc_id and text, documents are taken
in ascending key, and the running sum of their tokens stays within what is left (the first document that would pass it ends
the selection). Tokens are runs of characters other than white space.

The order within a source is exact but needs no task to hold a source: keys fall into ranges of equal ratio, a thousandth
apart, so that whatever the weights a range holds less than a thousandth of a weight's documents; ranges before the one where
the budget ends are taken by their sums, and only documents of one (source, range) are sorted together. Rows that repeat id,
source and text are counted first and are one document with the tokens of all of them.

Defined results: a null source is a source of its own (its weight is looked up as the empty string). A null or empty text
has 0 tokens: it goes with the epochs, and with the sample where its turn comes. A document without an id draws by its text
alone. Rows that repeat an id with different texts are documents of their own; those that repeat id, source and text are
taken together or not at all. A null, missing or infinite quality weight, or one that isn't a number, is that of an
unlabelled document; zero and negative ones are LEAST_WEIGHT; of weights that repeat an id the least counts. A source
without a target weight, or of weight 0, gets nothing. Sources without tokens get nothing. Ties in key go by id, then text.
Extra columns are ignored by sample() and dropped by mix_documents(). No rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Target weights of sources are their tokens to this power: small sources gain, the largest loses.
TEMPERATURE = 0.5
#: Tokens asked for, as a share of all tokens.
BUDGET_SHARE = 1.0
#: Weight of a document by its label: quality 1, quality 0, no label; toxic ones weigh a tenth of that.
QUALITY_WEIGHT = {"good": 2.0, "poor": 0.5, "unknown": 1.0, "toxic": 0.1}
LEAST_WEIGHT = 1e-6
#: Ranges of keys in a factor of e.
RANGES = 1024
SEED = 17


def tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


def draw(doc_id: Column, text_md5: Column, seed: int) -> Column:
    """A number in (0, 1) from the first 52 bits of an MD5."""
    digits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), text_md5)), 1, 13), 16, 10).cast("long")
    return (digits.cast("double") + 0.5) / float(1 << 52)


def label_weights(labels: DataFrame) -> DataFrame:
    """(doc_id, weight) from labels (doc_id, quality, toxic); repeated labels: the least weight."""
    w = QUALITY_WEIGHT
    base = F.when(F.col("quality") == 1, w["good"]).when(F.col("quality") == 0, w["poor"]).otherwise(w["unknown"])
    weight = base * F.when(F.col("toxic") == 1, w["toxic"]).otherwise(1.0)
    labels = common.pick(labels, doc_id="doc_id", quality="quality", toxic="toxic")
    return labels.select(F.col("doc_id").cast("long").alias("doc_id"), weight.alias("weight")).where("doc_id is not null").groupBy("doc_id").agg(F.min("weight").alias("weight"))


def _keyed(docs: DataFrame) -> DataFrame:
    """The columns that tell a document: doc_id, source, h (MD5 of the text), besides s and n."""
    text = F.col("text").cast("string")
    return docs.select("*", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("s"), tokens(text).alias("n"), F.md5(F.coalesce(text, F.lit(""))).alias("h"))


def _sampled(docs: DataFrame, weights: DataFrame, targets: dict[str, float] | None, budget_tokens: int | None, temperature: float, budget_share: float, seed: int, ranges: int) -> DataFrame:
    """sample() with s and h."""
    rows = _keyed(common.pick(docs, doc_id="doc_id", source="source", text="text")).groupBy("doc_id", "source", "s", "n", "h").agg(F.count("*").alias("m"))
    weighed = common.pick(weights, w_id="doc_id", w="weight").where("w_id is not null").groupBy(F.col("w_id").cast("long").alias("w_id")).agg(F.min(F.col("w").cast("double")).alias("w"))
    # rows without an id have no weight to find: they are spread by their text, under a mark that no weight has
    rows = rows.withColumn("j", F.coalesce("doc_id", F.xxhash64("h"))).withColumn("j_null", F.col("doc_id").isNull())
    rows = rows.join(weighed.withColumn("w_null", F.lit(False)), (F.col("j") == F.col("w_id")) & (F.col("j_null") == F.col("w_null")), "left").drop("j", "j_null", "w_id", "w_null")
    finite = F.when(~F.isnan("w") & (F.abs("w") < float("inf")), F.col("w"))
    rows = rows.withColumn("weight", F.when(F.col("w") <= 0, LEAST_WEIGHT).otherwise(F.coalesce(finite, F.lit(QUALITY_WEIGHT["unknown"]))))
    rows = common.Saved(docs.sparkSession, "mixing").put(rows.drop("w").withColumn("key", -F.log(draw(F.col("doc_id"), F.col("h"), seed)) / F.col("weight")), "drawn")
    return _take(rows, targets, budget_tokens, temperature, budget_share, ranges)


def sample(docs: DataFrame, weights: DataFrame, targets: dict[str, float] | None = None, budget_tokens: int | None = None, temperature: float = TEMPERATURE, budget_share: float = BUDGET_SHARE, seed: int = SEED, ranges: int = RANGES) -> DataFrame:
    """(doc_id, source, n_tokens, n_rows, weight, key, epochs, copies): each document of which at least one copy is taken.

    n_rows: how many rows of docs it is; n_tokens: of one of them; copies: of each of them. weights: (doc_id, weight).
    targets: weight by source; None: tokens of the source to `temperature`. budget_tokens: tokens in all; None: budget_share
    of those of docs.
    """
    found = _sampled(docs, weights, targets, budget_tokens, temperature, budget_share, seed, ranges)
    return found.select("doc_id", "source", F.col("n").alias("n_tokens"), F.col("m").alias("n_rows"), "weight", F.round("key", 9).alias("key"), "epochs", "copies")


def _budgets(rows: DataFrame, targets: dict[str, float] | None, budget_tokens: int | None, temperature: float, budget_share: float) -> DataFrame:
    """(s, epochs, room): complete epochs of each source and tokens left for the sample."""
    per = rows.groupBy("s").agg(F.sum(F.col("n") * F.col("m")).alias("have"))
    if targets is None:
        per = per.withColumn("target", F.when(F.col("have") > 0, F.pow(F.col("have").cast("double"), temperature)).otherwise(0.0))
    else:
        given = rows.sparkSession.createDataFrame([(k, float(v)) for k, v in targets.items()], "t_s string, target double")
        per = per.join(given, F.col("s") == F.col("t_s"), "left").withColumn("target", F.greatest(F.coalesce("target", F.lit(0.0)), F.lit(0.0))).drop("t_s")
    whole = per.agg(F.sum("have").alias("all_have"), F.sum("target").alias("all_target"))
    asked = F.lit(float(budget_tokens)) if budget_tokens is not None else F.col("all_have") * budget_share
    budget = F.floor(asked * F.round(F.col("target") / F.col("all_target"), 9)).cast("long")
    per = per.crossJoin(whole).where("have > 0 and all_target > 0").withColumn("budget", budget)
    return per.select("s", F.floor(F.col("budget") / F.col("have")).cast("long").alias("epochs"), F.pmod("budget", "have").alias("room"))


def _take(rows: DataFrame, targets: dict[str, float] | None, budget_tokens: int | None, temperature: float, budget_share: float, ranges: int) -> DataFrame:
    # the logarithm of an exponential key is spread alike for every weight: it only moves
    rows = rows.withColumn("r", F.floor(F.log(F.greatest("key", F.lit(1e-300))) * ranges).cast("long"))
    budgets = _budgets(rows, targets, budget_tokens, temperature, budget_share)
    # a row for each source and range: its size hangs on the number of sources, not of documents
    sums = rows.groupBy("s", "r").agg(F.sum(F.col("n") * F.col("m")).alias("n_range"))
    before = F.sum("n_range").over(Window.partitionBy("s").orderBy("r").rowsBetween(Window.unboundedPreceding, -1))
    plan = sums.withColumn("before", F.coalesce(before, F.lit(0))).join(budgets, "s")
    plan = plan.select(F.col("s").alias("p_s"), F.col("r").alias("p_r"), "before", "n_range", "epochs", "room")
    joined = rows.join(plan, (F.col("s") == F.col("p_s")) & (F.col("r") == F.col("p_r"))).drop("p_s", "p_r")
    # ranges that end within the room are in, those that start beyond it are out, and the one between is sorted
    edge = (F.col("before") <= F.col("room")) & (F.col("before") + F.col("n_range") > F.col("room"))
    sure = joined.where(~edge).withColumn("in_sample", F.col("before") + F.col("n_range") <= F.col("room"))
    run = F.sum(F.col("n") * F.col("m")).over(Window.partitionBy("s", "r").orderBy("key", "doc_id", "h", "source").rowsBetween(Window.unboundedPreceding, 0))
    partly = joined.where(edge).withColumn("in_sample", F.col("before") + run <= F.col("room"))
    every = sure.unionByName(partly)
    copies = (F.col("epochs") + F.col("in_sample").cast("long")).alias("copies")
    return every.select("doc_id", "source", "s", "h", "n", "m", "weight", "key", "epochs", copies).where("copies > 0")


def mix_documents(docs: DataFrame, weights: DataFrame, targets: dict[str, float] | None = None, budget_tokens: int | None = None, temperature: float = TEMPERATURE, budget_share: float = BUDGET_SHARE, seed: int = SEED, ranges: int = RANGES) -> DataFrame:
    """docs as often as they are taken: the columns of documents, a row for each copy."""
    docs = common.documents(docs)
    taken = _sampled(docs, weights, targets, budget_tokens, temperature, budget_share, seed, ranges)
    taken = taken.select(F.col("doc_id").alias("t_id"), F.col("h").alias("t_h"), F.col("source").alias("t_source"), "copies")
    same = F.col("doc_id").eqNullSafe(F.col("t_id")) & F.col("source").eqNullSafe(F.col("t_source")) & (F.col("h") == F.col("t_h"))
    both = _keyed(docs).join(taken, same)
    return both.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*common.DOCUMENT_COLUMNS)


def oracle(budget_share: float = BUDGET_SHARE, temperature: float = TEMPERATURE, seed: int = SEED) -> str:
    """sample() over documents and labels, in DuckDB's SQL, by one running sum a source."""
    w = QUALITY_WEIGHT
    return f"""
    WITH l AS (SELECT doc_id AS w_id, min((CASE quality WHEN 1 THEN {w["good"]} WHEN 0 THEN {w["poor"]} ELSE {w["unknown"]} END::DOUBLE) * (CASE WHEN toxic = 1 THEN {w["toxic"]} ELSE 1.0 END::DOUBLE)) AS w FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
    g AS (SELECT doc_id, source, text, count(*) AS m FROM documents GROUP BY doc_id, source, text),
    d AS (SELECT doc_id, source, coalesce(source, '') AS s, m, md5(coalesce(text, '')) AS h, coalesce(len(regexp_extract_all(text, '\\S+')), 0)::BIGINT AS n, coalesce(w, {w["unknown"]})::DOUBLE AS weight,
        -ln((('0x' || substr(md5('{seed}:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, 13))::BIGINT::DOUBLE + 0.5) / {1 << 52}::DOUBLE) / coalesce(w, {w["unknown"]})::DOUBLE AS key
        FROM g LEFT JOIN l ON doc_id = w_id),
    per AS (SELECT s, sum(n * m)::BIGINT AS have, CASE WHEN sum(n * m) > 0 THEN pow(sum(n * m)::DOUBLE, {temperature}::DOUBLE) ELSE 0.0::DOUBLE END AS target FROM d GROUP BY s),
    b AS (SELECT s, have, floor(sum(have) OVER ()::DOUBLE * {budget_share}::DOUBLE * round(target / sum(target) OVER (), 9))::BIGINT AS budget FROM per),
    r AS (SELECT d.*, budget // have AS epochs, budget % have AS room, sum(n * m) OVER (PARTITION BY d.s ORDER BY key, doc_id, h ROWS UNBOUNDED PRECEDING) AS running FROM d JOIN b ON d.s = b.s WHERE have > 0)
    SELECT doc_id, source, n AS n_tokens, m AS n_rows, weight, round(key, 9) AS key, epochs::BIGINT AS epochs, (epochs + CASE WHEN running <= room THEN 1 ELSE 0 END)::BIGINT AS copies
    FROM r WHERE epochs + CASE WHEN running <= room THEN 1 ELSE 0 END > 0
    """
