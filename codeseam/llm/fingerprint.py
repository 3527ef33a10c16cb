"""Document fingerprints: consistent weighted sampling of word weights, in SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Samples of one aggregation; a fingerprint is BLOCKS of them.
SAMPLES, BLOCKS = 8, 8
#: Bits of a sample that are kept, as hexadecimal digits.
DIGITS = 5
LOW = (1 << 4 * DIGITS) - 1
#: Second draws of a sample are hashed with its number plus this.
MORE = 1 << 20
#: Bits of each of a sample's uniform draws: two for r, two for c, one for beta.
R_BITS, C_BITS, BETA_BITS = 32, 24, 16


def uniform(bits: Column, shift: int, n: int) -> Column:
    """n of 64 random bits, from `shift` on, as a number in the open interval (0, 1)."""
    part = (F.shiftrightunsigned(bits, shift) if shift else bits).bitwiseAND(F.lit((1 << n) - 1))
    return (part + 0.5) / float(1 << n)


def words_of(text: Column) -> Column:
    """Words between white space, lower-cased; without empty ones."""
    return F.split(F.lower(text), r"[\s]+", -1)


def next_ids(sizes: DataFrame) -> DataFrame:
    """(doc_id, n, next_id) for rows (doc_id, n) of distinct ids: next in descending order, the
    first after the last. The ids are ranged over partitions; only each part's first id is
    gathered, so no task sees them all."""
    spark = sizes.sparkSession
    ranged = written(sizes.repartitionByRange(F.desc("doc_id")).withColumn("part", F.spark_partition_id()), "ids")
    firsts = [(r["part"], r["top"]) for r in ranged.groupBy("part").agg(F.max("doc_id").alias("top")).orderBy("part").collect()]
    after = [(part, firsts[(i + 1) % len(firsts)][1]) for i, (part, _) in enumerate(firsts)]
    border = spark.createDataFrame(after, "part int, after long") if after else spark.createDataFrame([], "part int, after long")
    lead = F.lead("doc_id").over(Window.partitionBy("part").orderBy(F.desc("doc_id")))
    return ranged.withColumn("lead", lead).join(F.broadcast(border), "part").select("doc_id", "n", F.coalesce("lead", "after").alias("next_id"))


def sample(weight: Column, draws: Column, more: Column) -> Column:
    """One consistent weighted sample of a term of the given log weight, as a number whose order
    is that of ln a and whose low bits tell (term, t). draws and more: 64 random bits
    of (term, sample) each.

    With r and c from Gamma(2, 1), as -ln of a product of two uniform draws, and beta uniform: t = floor(ln w / r + beta) and
    ln a = ln c - r (t - beta + 1); the least a over a text's terms is its sample.
    """
    r = -F.ln(uniform(draws, 0, R_BITS) * uniform(draws, R_BITS, R_BITS))
    ln_c = F.ln(-F.ln(uniform(more, BETA_BITS, C_BITS) * uniform(more, BETA_BITS + C_BITS, C_BITS)))
    beta = uniform(more, 0, BETA_BITS)
    t = F.floor(weight / r + beta)
    ln_a = ln_c - r * (t - beta + 1.0)
    mark = draws.bitwiseXOR(t * 40503).bitwiseAND(F.lit(LOW))
    # -100 < ln a < 4 for the weights of texts
    return F.shiftleft(((ln_a + 1024.0) * float(1 << 30)).cast("long"), 4 * DIGITS).bitwiseOR(mark)


def signatures(texts: DataFrame) -> DataFrame:
    """(doc_id, rid, fp0, fp1) for rows (doc_id, rid, text, edited) that lie by doc_id: the
    fingerprints of both texts, null for one without words.

    Words are counted and sampled where the text is: both aggregations have doc_id among their
    keys and need no further exchange.
    """
    both = texts.select("doc_id", "rid", F.posexplode(F.array("text", "edited")).alias("later", "part"))
    each = both.select("doc_id", "rid", "later", F.explode(words_of(F.col("part"))).alias("word")).where("word <> ''")
    terms = each.select("doc_id", "rid", F.xxhash64("word").alias("term"), "later").groupBy("doc_id", "rid", "term").agg(F.count("*").alias("n"), F.sum("later").alias("n1"))
    logs = terms.select("doc_id", "rid", "term", F.ln((F.col("n") - F.col("n1")).cast("double")).alias("w0"), F.ln(F.col("n1").cast("double")).alias("w1"))
    logs = logs.select("*", F.explode(F.array(*(F.lit(b * SAMPLES) for b in range(BLOCKS)))).alias("block"))
    # the log of no occurrence is null, and so is its sample; draws and their logs are shared
    draws = [(F.xxhash64(F.col("term"), F.col("block") + k), F.xxhash64(F.col("term"), F.col("block") + (k + MORE))) for k in range(SAMPLES)]
    least = [F.min(sample(F.col(w), *d)).alias(f"{w}_{k}") for w in ("w0", "w1") for k, d in enumerate(draws)]
    got = logs.groupBy("doc_id", "rid", "block").agg(*least)
    hexes = lambda w: F.concat(*(F.lpad(F.lower(F.hex(F.col(f"{w}_{k}").bitwiseAND(F.lit(LOW)))), DIGITS, "0") for k in range(SAMPLES)))
    parts = got.select("doc_id", "rid", "block", hexes("w0").alias("h0"), hexes("w1").alias("h1"))
    pick = lambda h, b: F.max(F.when(F.col("block") == b * SAMPLES, F.col(h)))
    return parts.groupBy("doc_id", "rid").agg(F.concat(*(pick("h0", b) for b in range(BLOCKS))).alias("fp0"), F.concat(*(pick("h1", b) for b in range(BLOCKS))).alias("fp1"))


#: Stands for a null doc_id.
NO_ID = -(1 << 63)
#: The fingerprint of a text without words.
EMPTY = "0" * (DIGITS * SAMPLES * BLOCKS)


def likeness(a: Column, b: Column) -> Column:
    """The share of equal samples of two fingerprints."""
    n = SAMPLES * BLOCKS
    same = F.aggregate(F.sequence(F.lit(0), F.lit(n - 1)), F.lit(0), lambda s, k: s + (F.substr(a, k * DIGITS + 1, F.lit(DIGITS)) == F.substr(b, k * DIGITS + 1, F.lit(DIGITS))).cast("int"))
    return same / float(n)


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text.

    Returns for each row of docs: doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next. The edited text is the text with its last
    floor(n_chars / 3) characters replaced by as many (or all) first characters of the next
    document by descending doc_id (after the last: the first). A null text is empty; texts
    without words share one fingerprint. Rows with equal doc_id share their next document, of
    which the least text and fingerprint count. A row with a null doc_id has no next document: its
    text is only cut, and near_next is null. Extra columns are not read.
    """
    # Both joins below read one exchange of the texts: same columns, and a key that is never null.
    base = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), F.monotonically_increasing_id().alias("rid"), F.coalesce("text", F.lit("")).alias("text"))
    sizes = docs.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.char_length(F.coalesce("text", F.lit("")))).cast("long").alias("n"))
    order = written(next_ids(sizes), "order")
    given = order.select(F.col("next_id").alias("doc_id"), F.col("doc_id").alias("to"), (F.col("n") / 3).cast("int").alias("need"))
    heads = base.join(given, "doc_id").select("to", F.struct(F.substr("text", F.lit(1), F.col("need")).alias("head"), "rid").alias("head")).groupBy("to").agg(F.min("head").alias("head"))
    n = F.char_length("text")
    third = (n / 3).cast("int")
    texts = base.join(heads, base["doc_id"] == heads["to"], "left").select("doc_id", "rid", "text", F.concat(F.substr("text", F.lit(1), n - third), F.substr(F.coalesce("head.head", F.lit("")), F.lit(1), third)).alias("edited"))
    digests = texts.select("doc_id", "rid", F.char_length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"))
    full = digests.join(signatures(texts), ["doc_id", "rid"], "left")
    full = full.select(F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), "n_chars", "edited_sha256", F.unhex(F.coalesce("fp0", F.lit(EMPTY))).alias("own"), F.unhex(F.coalesce("fp1", F.lit(EMPTY))).alias("edited"))
    full = written(full, "fingerprints")
    of_next = full.where("doc_id is not null").groupBy("doc_id").agg(F.min("own").alias("next"))
    nexts = order.select(F.col("doc_id").alias("_id"), "next_id").join(of_next, F.col("next_id") == of_next["doc_id"]).select("_id", "next")
    out = full.join(nexts, full["doc_id"] == nexts["_id"], "left")
    own, edited, after = (F.lower(F.hex(c)) for c in ("own", "edited", "next"))
    out = out.select("doc_id", "n_chars", "edited_sha256", own.alias("fingerprint"), edited.alias("edited_fingerprint"), after.alias("next"))
    own = F.col("fingerprint")
    return out.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness(own, F.col("edited_fingerprint")).alias("near_edited"), F.when(F.col("next").isNotNull(), likeness(own, F.col("next"))).alias("near_next"))
